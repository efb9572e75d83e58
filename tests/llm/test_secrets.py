import random
import string

import odd
from plumbob.llm import secrets as S


def held_out(seed=99, n=400):
    rng = random.Random(seed)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(20, 48))) for _ in range(n)] + ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(n)]
    words = "customer order index session handler parse remote config value export default window buffer search result table".split()
    names = ["_".join(rng.choices(words, k=3)) + str(rng.randint(1, 99)) for _ in range(n)] + ["".join(w.title() for w in rng.choices(words, k=3)) + "V2" for _ in range(n)]
    return keys, [x for x in names if len(x) >= S.SHORTEST]


def test_held_out_accuracy():
    s = S.Scanner()
    keys, names = held_out()
    assert sum(bool(s.find(k)) for k in keys) / len(keys) > 0.95
    assert sum(bool(s.find(k)) for k in names) / len(names) < 0.05


def test_places_and_redaction():
    s = S.Scanner()
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    text = f'token = "{key}" and {key}; number 1219538112535716123, rule -------------------------------- end'
    spans = s.find(text)
    assert [text[a:b] for a, b, _ in spans] == [key, key]
    assert s.redact(text) == text.replace(key, S.MASK)
    assert s.redact(None) is None and s.redact("") == "" and s.find(None) == []


def test_markov_is_the_product_of_its_steps():
    m = S.Markov(["abab", "abb"], 0.5)
    n = len(S.ALPHABET)
    assert abs(2 ** m.log[n, 0] - 2.5 / (2 + n / 2)) < 1e-12 and abs(2 ** m.log[0, 1] - 3.5 / (3 + n / 2)) < 1e-12
    assert abs(m.bits(S.codes("ab")) - m.log[n, 0] - m.log[0, 1]) < 1e-12


def brute(scanner, text):
    """Runs of characters found one by one, all choices of disjoint stretches
    tried, and each stretch scored from the models' tables."""
    runs, run = [], []
    for i, c in enumerate(text + " "):
        if c.isascii() and (c.isalnum() or c in "+/_-"):
            run.append(i)
        else:
            runs, run = runs + [run] * (len(run) >= S.SHORTEST), []
    whole = lambda i, j: all(c.isascii() and (c.isalnum() or c in "+/_-=") for c in text[i:j])
    assert all(whole(r[0], r[-1] + 1) for r in runs)
    start = len(S.ALPHABET)

    def bits(model, s):
        out, last = 0.0, start
        for c in s:
            if c in "+/_-":
                last = start
                continue
            out, last = out + model.log[last, S.ALPHABET.index(c)], S.ALPHABET.index(c)
        return out

    found = []
    for r in runs:
        begins = [i for i in r if text[i].isalnum() and (i == r[0] or not text[i - 1].isalnum())]
        ends = [i + 1 for i in r if text[i].isalnum() and (i == r[-1] or not text[i + 1].isalnum())]
        score = {}
        for x, b in enumerate(begins):
            for e in ends[x:]:
                core = text[b:e]
                if len(core) >= S.SHORTEST and any(c.isalpha() for c in core):
                    score[b, e] = (bits(scanner.random, core) - bits(scanner.ordinary, core)) / len(core)
        best = {r[-1] + 1: (0.0, [])}  # from a place on: the largest sum and its stretches
        for i in reversed(r):
            best[i] = best[i + 1]
            for (b, e), x in score.items():
                if b == i and x > scanner.threshold and (x - scanner.threshold) * (e - b) + best[e][0] > best[i][0] + 1e-9:
                    best[i] = ((x - scanner.threshold) * (e - b) + best[e][0], [(b, e), *best[e][1]])
        found += best[r[0]][1]
    return [text[b:e] for b, e in found]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scanner = S.trained(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = sorted((i, x) for i, t in texts.items() for x in brute(scanner, t))
    got = sorted((r.doc_id, texts[r.doc_id][r.begin : r.finish]) for r in S.op4_secrets(spark, sf).collect())
    assert got == want and len(got) > 0


def test_brute_force_on_joined_strings():
    s, rng = S.Scanner(), random.Random(8)
    pieces = ["order", "index", "remote", "v2", "2024", "a1b2c3d4e5f6", "9f8e7d6c5b4a3928", "Xk29qLpZ", "deadbeef01", "handler", "qzjxkvwpmtrb", "é"]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice("/_-+= ") for _ in range(rng.randint(2, 9)))
        assert [text[a:b] for a, b, _ in s.find(text)] == brute(s, text), text


def test_odd_documents(spark):
    docs = odd.documents(spark)
    scanner = S.trained(docs)
    got = S.redacted(docs, scanner)
    assert got.columns == docs.columns and got.count() == docs.count()
    assert {r.doc_id: r.text for r in got.collect()}[3] is None
    assert S.secrets(docs.limit(0), S.trained(docs.limit(0))).count() == 0
    key = "qX7mP2vR9sT4wZ1kL8nB3dF6"
    late = odd.plain(spark, [(1, "fine words " * 50_000 + key), (None, key), (2, key), (2, key)])
    assert S.secrets(late, scanner).count() == 4
    row = S.redacted(late.where("doc_id = 2").limit(1), scanner).first()
    assert (row.text, row.n_chars) == (S.MASK, len(S.MASK))


def test_secrets_joined_to_names_and_paths():
    s, rng = S.Scanner(), random.Random(17)
    alphanumeric, hexadecimal = string.ascii_letters + string.digits, "0123456789abcdef"
    places = [("", ""), ("api_key=", ""), ("customer_service_access_token=", ""), ("/usr/local/share/application/config/production/", ""), ("https://host.example/services/hooks/incoming/messages/", ""), ("/api/users/list/", "/settings/profile/view"), ("export-service-account-key_", "&next=customer_order_index")]
    for before, after in places:
        for alphabet, k in ((hexadecimal, 32), (alphanumeric, 20), (alphanumeric, 32), (string.ascii_letters, 32)):
            keys = ["".join(rng.choices(alphabet, k=k)) for _ in range(200)]
            exact = sum([(a, b) for a, b, _ in s.find(before + key + after)] == [(len(before), len(before) + k)] for key in keys)
            assert exact / len(keys) >= 0.95, (before, k, exact)
        keys = ["".join(rng.choices(string.ascii_lowercase, k=32)) for _ in range(200)]
        assert sum(bool(s.find(before + key + after)) for key in keys) / len(keys) >= 0.9
    a, b = "9b0b3c6a43eb78aa99cbd7049c572391", "qX7mP2vR9sT4wZ1kL8nB3dF6"
    assert s.redact(f"customer_connection_settings/{a}/remote_window_handler/{b}/default_export_table") == f"customer_connection_settings/{S.MASK}/remote_window_handler/{S.MASK}/default_export_table"
    base64 = "Zm9/v3QxYkE+d2hK/0pTZ1V4UnA+bUw5"
    assert s.redact(f"database_connection_password_of_customers={base64}==") == f"database_connection_password_of_customers={S.MASK}=="
    names = ["/".join("_".join(rng.choices(["customer", "order", "index", "session", "handler", "remote", "config", "export", "window", "search"], k=3)) + str(rng.randint(1, 2024)) for _ in range(4)) for _ in range(400)]
    assert sum(bool(s.find(x)) for x in names) / len(names) < 0.05
    assert s.find("1234-5678-9012-3456-7890") == [] and s.find("order-" * 100_000 + "v2") == []
