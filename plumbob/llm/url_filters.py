"""Operator 8 - URL filters by empirical-Bayes reputation of hosts.

A page's outcome is bad if its label says toxic or of low quality.  Outcomes
are counted by host; counts sum up to registered domains and to suffixes.  From
the top down each level's rate is a beta-binomial posterior whose prior is the
posterior mean of the level above: suffixes shrink to the overall rate, domains
to their suffix, hosts to their domain.  A level's prior strength is estimated
by moments over its members:

    rho = (sum (b - n*p)**2 - sum n*p*(1-p)) / sum n*(n-1)*p*(1-p),  M = 1/rho - 1

with rho held between ``RHO``'s bounds.  A page is rejected if its host's bad
rate is above ``THRESHOLD`` with the posterior's lower bound, mean - Z standard
deviations of the beta posterior; so a host with few labels is rejected only if
its whole domain is bad.

The host is the lower-case name of a URL with a scheme, without user, port and
trailing dot.  Its suffix is what the longest of the suffix rules covers, or the
last label without one; the registered domain has one label more.  Rules are
data, in the form of the public suffix list: ``co.uk``, ``*.ck`` (any one label
before it), ``!www.ck`` (which isn't a suffix though ``*.ck`` covers it).
``SUFFIXES`` has the most usual of them; a whole list can be given.  An IP
address or a host that is itself a suffix is its own domain.

Labels of null or unknown pages, or with both flags null, are ignored; of
repeated labels a bad one counts, once; a repeated page counts as one page and
is returned as often as it came.  Pages without a host (null, empty or relative
URLs) are kept with null reputation.  Without any label all pages are kept.
Very long URLs are read whole.  Other columns may have any names.  An empty
table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbob.llm.common import free_name, require, shared_dir, table

THRESHOLD = 0.35
Z = 1.645
RHO = (0.001, 0.5)
#: Usual suffixes of more than one label, by their last one, and those of hosting services.
_KINDS = {
    "ac co gov ltd me net nhs org plc police sch": "uk", "asn com edu gov id net org": "au", "ac co cri geek gen govt health iwi kiwi maori mil net org parliament school": "nz", "ac ad co ed go gr lg ne or": "jp", "ac co es go hs kg mil ms ne or pe re sc": "kr",
    "art blog com edu eco gov ind inf jus leg mil net org": "br", "com edu gob net org": "mx", "com edu gob int mil net org tur": "ar", "ac com edu gov mil net org": "cn", "av bbs bel biz com dr edu gen gov info k12 mil name net org pol tel tv web": "tr",
    "ac co edu firm gen gov ind mil net nic org res": "in", "ac agric alt co edu gov law mil net ngo nic nom org school web": "za", "ac co gov idf k12 muni net org": "il", "com edu gov net org per": "sg", "com edu gov idv net org": "hk", "club com ebiz edu game gov idv mil net org": "tw",
    "ac co go in mi net or": "th", "ac biz co desa go mil my net or sch web": "id", "com edu gov mil name net org": "my", "com edu gov i mil net ngo org": "ph", "ac biz com edu gov health info int name net org pro": "vn", "com edu fam gob gok gon gop gos gov info net org web": "pk",
    "com edu gov net org": "lk", "com edu eun gov mil name net org sci": "eg", "com edu gov med net org pub sch": "sa", "ac co gov mil net org sch": "ae", "com edu gob net nom org mil": "pe", "com edu gob gov mil net org": "co", "co com edu gob gov mil": "cl", "com edu fin gob gov info med mil net org": "ec",
    "com edu gub mil net org": "uy", "co com e12 edu gob gov info int mil net org web": "ve", "com edu gov net ngo org": "ng", "ac co go info me mobi ne or sc": "ke", "ac co com go ne or sc": "ug", "com edu gov net org": "gr", "com edu gov in kiev kyiv net org": "ua", "com edu gov info net org waw": "pl",
    "asso com gouv nom prd tm": "fr", "com edu gob nom org": "es", "com edu gov int net nome org publ": "pt", "ac co gv or": "at", "2000 agrar co film hotel info org": "hu", "com firm info nom nt org rec ro store tm www": "ro", "ac co edu gov in org": "rs", "ac com edu gov int mil msk net org pp spb": "ru",
}
SUFFIXES = tuple(f"{a}.{b}" for names, b in _KINDS.items() for a in names.split()) + (
    "*.ck", "!www.ck", "*.bd", "*.np", "*.kh", "*.mm", "*.er", "*.fk", "*.pg", "*.kawasaki.jp", "!city.kawasaki.jp", "*.compute.amazonaws.com", "s3.amazonaws.com",
    "github.io", "gitlab.io", "blogspot.com", "appspot.com", "herokuapp.com", "netlify.app", "vercel.app", "pages.dev", "workers.dev", "web.app", "firebaseapp.com", "azurewebsites.net", "cloudfront.net", "wordpress.com", "tumblr.com", "weebly.com", "wixsite.com", "neocities.org", "readthedocs.io", "fly.dev", "onrender.com", "glitch.me", "us.com", "uk.com", "eu.org", "in.net",
)
#: Up to so many hosts the verdicts are sent to the tasks that hold pages.
SENT_HOSTS = 500_000

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]+)"


def host_of(url: Column) -> Column:
    name = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"\.+$", "")
    return F.when(name != "", name)


def _rules(suffixes: tuple[str, ...]) -> tuple[list[str], list[str], list[str], int]:
    """Plain rules, wildcards' ends, exceptions, and labels of the longest."""
    plain = [r for r in suffixes if r[0] not in "*!"]
    wild, kept = [r[2:] for r in suffixes if r.startswith("*.")], [r[1:] for r in suffixes if r[0] == "!"]
    return plain, wild, kept, max([2, *(r.count(".") + 1 for r in suffixes)])


def parts_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """``(suffix, registered domain)``."""
    plain, wild, kept, most = _rules(suffixes)
    end = lambda k: F.substring_index(host, ".", -k)
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    size = F.when(labels < 2, 1)
    for k in range(most, 1, -1):
        here = labels >= k
        if kept:
            size = size.when(here & end(k).isin(*kept), k - 1)
        size = size.when(here & (end(k).isin(*plain) | end(k - 1).isin(*wild)), k)
    size = size.otherwise(1)
    suffix, domain = end(1), host
    for k in range(1, most + 1):
        suffix, domain = F.when(size == k, end(k)).otherwise(suffix), F.when(size == k, end(k + 1)).otherwise(domain)
    number = host.rlike(r"^[0-9.]+$")
    return F.when(number, host).otherwise(suffix), F.when(number, host).otherwise(domain)


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(host, n, bad)`` of the hosts of labelled pages."""
    require(pages, "page_id", "url")
    require(labels, "doc_id", "quality", "toxic")
    known = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.greatest(F.col("toxic").cast("int"), 1 - F.col("quality").cast("int")).alias("bad")).where("page_id IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    return hosts.join(known, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("bad"))


def _shrunk(level: DataFrame, prior: DataFrame, key: str, rho: tuple[float, float]) -> DataFrame:
    """``level(key, n, bad, up)`` with the posterior ``a_key``, ``b_key`` and
    mean ``p_key``; ``prior(up, p)`` has the means of the level above."""
    rows = level.join(prior, "up")
    var = F.col("n") * F.col("p") * (1 - F.col("p"))
    got = rows.agg(F.sum((F.col("bad") - F.col("n") * F.col("p")) ** 2).alias("s"), F.sum(var).alias("v"), F.sum(var * (F.col("n") - 1)).alias("w"))
    r = F.when(F.col("w") > 0, F.greatest(F.lit(rho[0]), F.least(F.lit(rho[1]), (F.col("s") - F.col("v")) / F.col("w")))).otherwise(F.lit(rho[1]))
    strength = got.select((1 / r - 1).alias("m"))  # one row
    out = rows.crossJoin(F.broadcast(strength))
    out = out.withColumn("a", F.col("m") * F.col("p") + F.col("bad")).withColumn("b", F.col("m") * (1 - F.col("p")) + F.col("n") - F.col("bad"))
    return out.select(key, "a", "b", (F.col("a") / (F.col("a") + F.col("b"))).alias("q"), "n", "bad")


def reputation(pages: DataFrame, labels: DataFrame, rho: tuple[float, float] = RHO, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(host, n, bad, mean, lower)`` of the hosts of all pages."""
    if not 0 < rho[0] <= rho[1] < 1:
        raise ValueError("0 < least rho <= largest rho < 1")
    counted = outcomes(pages, labels)
    suffix, domain = parts_of(F.col("host"), suffixes)
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    hosts = hosts.join(counted, "host", "left").select("host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")).checkpoint()
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")).checkpoint()
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).checkpoint()
    top = suffixes.agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("p")).select(F.lit(0).alias("up"), "p")
    s = _shrunk(suffixes.withColumn("up", F.lit(0)), top, "suffix", rho)
    d = _shrunk(domains.withColumnRenamed("suffix", "up"), s.select(F.col("suffix").alias("up"), F.col("q").alias("p")), "domain", rho)
    h = _shrunk(hosts.select("host", F.col("domain").alias("up"), "n", "bad"), d.select(F.col("domain").alias("up"), F.col("q").alias("p")), "host", rho)
    total = F.col("a") + F.col("b")
    return h.select("host", "n", "bad", F.col("q").alias("mean"), (F.col("q") - z * F.sqrt(F.col("q") * (1 - F.col("q")) / (total + 1))).alias("lower"))


def judged(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rho: tuple[float, float] = RHO, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """``(page_id, host, n, bad, mean, lower, kept)``, a row for each page."""
    require(pages, "page_id", "url")
    shared_dir(pages.sparkSession)
    known = reputation(pages, labels, rho, z, suffixes).checkpoint()
    if known.count() <= SENT_HOSTS:
        known = F.broadcast(known)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host")).join(known, "host", "left")
    return rows.select("page_id", "host", "n", "bad", F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"), F.coalesce(F.round("lower", 6) <= threshold, F.lit(True)).alias("kept"))


def filtered(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The pages that are kept, with their columns; pages aren't shuffled while
    the rejected hosts are few."""
    require(pages, "page_id", "url")
    shared_dir(pages.sparkSession)
    name = free_name(pages, "rejected_host")
    bad = reputation(pages, labels, suffixes=suffixes).where(F.round("lower", 6) > threshold).select(F.col("host").alias(name)).checkpoint()
    if bad.count() <= SENT_HOSTS:
        bad = F.broadcast(bad)
    return pages.join(bad, host_of(pages["url"]) == bad[name], "left_anti")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    plain, wild, kept, most = _rules(SUFFIXES)
    quoted = lambda rules: ", ".join(f"'{r}'" for r in rules)
    end = lambda k: f"array_to_string(list_slice(parts, -{k}, -1), '.')"
    size = "CASE WHEN len(parts) < 2 THEN 1"
    for k in range(most, 1, -1):
        size += f" WHEN len(parts) >= {k} AND {end(k)} IN ({quoted(kept)}) THEN {k - 1} WHEN len(parts) >= {k} AND ({end(k)} IN ({quoted(plain)}) OR {end(k - 1)} IN ({quoted(wild)})) THEN {k}"
    size += " ELSE 1 END"

    def level(name: str, key: str, source: str, prior: str) -> str:
        return f"""
{name}_in AS (SELECT l.*, u.p FROM {source} l JOIN {prior} u ON l.up = u.up),
{name}_m AS (SELECT 1 / (CASE WHEN sum(n * (n - 1) * p * (1 - p)) > 0 THEN greatest({RHO[0]}::DOUBLE, least({RHO[1]}::DOUBLE, (sum((bad - n * p) * (bad - n * p)) - sum(n * p * (1 - p))) / sum(n * (n - 1) * p * (1 - p)))) ELSE {RHO[1]}::DOUBLE END) - 1 AS m FROM {name}_in),
{name} AS (SELECT {key}, n, bad, m * p + bad AS a, m * (1 - p) + n - bad AS b FROM {name}_in, {name}_m)"""

    return f"""
WITH u AS (SELECT page_id, regexp_replace(regexp_extract(lower(trim(url)), '{HOST}', 1), '\\.+$', '') AS h FROM pages),
p AS (SELECT page_id, nullif(h, '') AS host FROM u),
k AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels WHERE doc_id IS NOT NULL AND coalesce(toxic, quality) IS NOT NULL GROUP BY 1),
c AS (SELECT host, count(*) AS n, sum(bad) AS bad FROM (SELECT DISTINCT page_id, host FROM p WHERE host IS NOT NULL) x JOIN k ON k.doc_id = x.page_id GROUP BY 1),
q AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM p WHERE host IS NOT NULL),
t AS (SELECT host, parts, CAST({size} AS INTEGER) AS k, regexp_matches(host, '^[0-9.]+$') AS number FROM q),
hosts AS (SELECT q.host, CASE WHEN number THEN q.host ELSE array_to_string(list_slice(parts, -(k + 1), -1), '.') END AS up, CASE WHEN number THEN q.host ELSE array_to_string(list_slice(parts, -k, -1), '.') END AS suffix,
  coalesce(n, 0)::DOUBLE AS n, coalesce(bad, 0)::DOUBLE AS bad FROM t q LEFT JOIN c ON c.host = q.host),
domains AS (SELECT up AS domain, any_value(suffix) AS up, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY 1),
suffixes AS (SELECT up AS suffix, 0 AS up, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY 1),
p0 AS (SELECT 0 AS up, (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS p FROM suffixes),{level("s", "suffix", "suffixes", "p0")},
p1 AS (SELECT suffix AS up, a / (a + b) AS p FROM s),{level("d", "domain", "domains", "p1")},
p2 AS (SELECT domain AS up, a / (a + b) AS p FROM d),{level("h", "host", "hosts", "p2")},
r AS (SELECT host, n, bad, a / (a + b) AS mean, a / (a + b) - {Z}::DOUBLE * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS lower FROM h)
SELECT p.page_id, p.host, CAST(r.n AS BIGINT) AS n, CAST(r.bad AS BIGINT) AS bad, round(r.mean, 6) AS mean, round(r.lower, 6) AS lower, coalesce(round(r.lower, 6) <= {THRESHOLD}, true) AS kept
FROM p LEFT JOIN r ON r.host = p.host"""


ORACLE = _oracle()
