"""Operator 4 - secret scans by character Markov models.

A candidate is a run of at least ``SHORTEST`` letters, digits and ``+/=_-`` of
a text.  Secrets are joined to names and paths (``NAME=key``, ``path/key``), so
it isn't judged as a whole: it is cut at ``=``, and of the parts that ``+/_-``
leave, stretches of neighbouring ones are scored.  Two order-1 Markov models of
characters, smoothed by ``ALPHA``, judge its parts: one of random strings, one
of ordinary identifiers; signs between parts speak for neither.  The score is the log-likelihood ratio per character,
in bits; a stretch of at least ``SHORTEST`` characters is a secret if its score
is above ``THRESHOLD`` and it holds a letter (numbers alone, like card or phone
numbers, are personal data and not secrets).  Of the disjoint secrets in a
candidate those are found that together are likeliest random, exactly.

Both models are trained here on labelled samples: generated random strings of
the usual alphabets (hexadecimal, base 32, base 64, alphanumeric, letters), and
identifiers: names of Python's own modules in the usual spellings, and the
``WORDS`` most frequent words of two to twenty Latin letters of at most
``SAMPLE`` documents (those of the smallest hashes of their ids), joined with
underscores, hyphens or capitals as identifiers are.

Null and empty texts have no secrets; texts are scanned whole, however long;
equal secrets at different places are different rows, and repeated rows give
theirs again; rows with null ids are scanned like others; of equally likely
stretches the shorter ones are found.  Redaction keeps all rows and columns,
whatever their names.  Without documents the models know Python's names only.
"""

from __future__ import annotations

import keyword
import random
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import require, table, tuned

SHORTEST = 16
THRESHOLD = 0.5
ALPHA = 0.5
SAMPLE, WORDS = 1000, 5000
MASK = "<SECRET>"

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"
SIGNS = ALPHABET.index("+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_\-]{%d,}" % SHORTEST)
_LETTER, _LETTERS = re.compile("[A-Za-z]"), re.compile(".*[A-Za-z]")
_SIDE, _PART = re.compile("[^=]+"), re.compile("[A-Za-z0-9]+")
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))


class Markov:
    """Order-1 model of strings over ALPHABET; log2 probabilities."""

    def __init__(self, samples: list[str], alpha: float = ALPHA):
        n = len(ALPHABET)
        counts = np.full((n + 1, n), alpha)  # the last row: how strings begin
        for s in samples:
            c = codes(s)
            if len(c):
                np.add.at(counts, (np.append(n, c[:-1]), c), 1)
        self.log = np.log2(counts / counts.sum(1, keepdims=True))

    def bits(self, c: np.ndarray) -> float:
        return float(self.log[np.append(len(ALPHABET), c[:-1]), c].sum())


def codes(s: str) -> np.ndarray:
    c = _CODE[np.frombuffer(s.encode(), np.uint8)]
    return c[c >= 0]


def random_strings(count: int = 6000, seed: int = 7) -> list[str]:
    """Labelled sample of secrets: in turn hexadecimal, base 32, base 64,
    URL-safe base 64, alphanumeric, letters."""
    rng = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = ["0123456789abcdef", "0123456789abcdef", letters + "234567", letters + letters.lower() + "0123456789+/", letters + letters.lower() + "0123456789-_", letters + letters.lower() + "0123456789", letters.lower(), letters + letters.lower()]
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(16, 64))) for i in range(count)]


def identifiers(words: list[str], count: int = 6000, seed: int = 11) -> list[str]:
    """Labelled sample of identifiers: names of one to four words in snake,
    kebab, camel, path or constant spelling, some with a number."""
    rng = random.Random(seed)
    names = sorted({p for m in [*sys.stdlib_module_names, *keyword.kwlist, *dir(str), *dir(np)] for p in re.split(r"[\W_0-9]+", m) if len(p) > 1})
    words = sorted({w for w in words if w.isascii() and w.isalpha()})
    out = []
    for _ in range(count):
        parts = [rng.choice(words if words and rng.random() < 0.5 else names) for _ in range(rng.randint(1, 4))]
        style = rng.randrange(6)
        if style < 3:
            s = "_-/"[style].join(p.lower() for p in parts)
        else:
            s = "".join(p.title() for p in parts) if style == 3 else parts[0].lower() + "".join(p.title() for p in parts[1:]) if style == 4 else "_".join(p.upper() for p in parts)
        if rng.random() < 0.25:
            s += ("_" if style in (0, 5) else "-" if style == 1 else "") + str(rng.randint(0, 2024))
        out.append(s)
    return out


class Scanner:
    def __init__(self, words: list[str] = (), threshold: float = THRESHOLD):
        self.random, self.ordinary, self.threshold = Markov(random_strings()), Markov(identifiers(list(words))), threshold
        self.ratio = self.random.log - self.ordinary.log

    def ratios(self, s: str) -> np.ndarray:
        """Bits by which each character is likelier random: in its part between
        signs, as its first or after the one before it; a sign has none."""
        c = codes(s)
        before = np.append(len(ALPHABET), c[:-1])
        sign = c >= SIGNS
        before[np.append(True, sign[:-1])] = len(ALPHABET)
        return np.where(sign, 0.0, self.ratio[before, c])

    def score(self, s: str) -> float:
        """Bits per character by which ``s`` is likelier random."""
        return float(self.ratios(s).mean()) if s else 0.0

    def stretches(self, s: str) -> list[tuple[int, int, float]]:
        """The disjoint stretches of whole parts, secrets each, whose scores
        above the threshold have the largest sum.  Exact, in one pass."""
        total = np.append(0.0, np.cumsum(self.ratios(s)))  # before a character
        above = total - self.threshold * np.arange(len(total))
        parts = [m.span() for m in _PART.finditer(s)]
        best, back = [0.0], []  # of the first k parts: the sum, and the first part of the stretch that ends them
        letter = -1  # the last one so far
        open_, first, q = -np.inf, None, 0  # the best start among the first q parts
        for k, (begin, end) in enumerate(parts):
            if m := _LETTERS.match(s, begin, end):
                letter = m.end() - 1
            while q <= k and parts[q][0] <= min(end - SHORTEST, letter):
                x = best[q] - above[parts[q][0]]
                if x > open_:
                    open_, first = x, q
                q += 1
            x = open_ + above[end]
            back.append(first if x > best[-1] else None)
            best.append(max(x, best[-1]))
        out, k = [], len(parts)
        while k:
            i = back[k - 1]
            if i is not None:
                begin, end = parts[i][0], parts[k - 1][1]
                out.append((begin, end, float(total[end] - total[begin]) / (end - begin)))
            k = k - 1 if i is None else i
        return out[::-1]

    def find(self, text: str | None) -> list[tuple[int, int, float]]:
        """``(begin, end, score)`` of a text's secrets, in characters."""
        out = []
        for m in CANDIDATE.finditer(text or ""):
            for side in _SIDE.finditer(m.group()):
                if side.end() - side.start() >= SHORTEST and _LETTER.search(side.group()):
                    at = m.start() + side.start()
                    out += [(at + begin, at + end, round(x, 6)) for begin, end, x in self.stretches(side.group())]
        return out

    def redact(self, text: str | None, mask: str = MASK) -> str | None:
        spans = self.find(text)
        if not spans:
            return text
        out, at = [], 0
        for begin, end, _ in spans:
            out += [text[at:begin], mask]
            at = end
        return "".join(out) + text[at:]


def trained(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, words: int = WORDS) -> Scanner:
    """A scanner whose identifiers use words of a bounded sample of texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).dropna()
    few = rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    found = rows.join(F.broadcast(few), "doc_id").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) between 2 and 20").groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return Scanner([r.w for r in found.collect()], threshold)


def secrets(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``(doc_id, begin, finish, score)`` of each secret; characters from 0,
    ``finish`` excluded."""
    require(docs, "doc_id", "text")
    tuned(docs.sparkSession)

    kind = pa.list_(pa.struct([("begin", pa.int32()), ("finish", pa.int32()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<begin:int,finish:int,score:double>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"begin": b, "finish": e, "score": s} for b, e, s in scanner.find(t)] for t in texts.to_pylist()], kind)

    found = docs.select("doc_id", run(F.col("text").cast("string")).alias("s"))
    return found.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.begin", "s.finish", "s.score")


def redacted(docs: DataFrame, scanner: Scanner, mask: str = MASK) -> DataFrame:
    """``docs`` with each secret replaced; ``n_chars``, if there, is renewed."""
    require(docs, "text")
    tuned(docs.sparkSession)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([scanner.redact(t, mask) for t in texts.to_pylist()], pa.string())

    out = docs.withColumn("text", run(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets(docs, trained(docs))
