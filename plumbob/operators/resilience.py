"""Failures: classes, backoff, circuit breaker, dead letters, health."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

TRANSIENT, PERMANENT = ("500", "503", "504", "429", "timeout", "connection reset"), ("403", "404", "400")
BASE_MS, MOST_MS = 1000, 64_000
WINDOW_S, LEAST_REQUESTS, OPEN_RATE, OPEN_S, CLOSING = 60, 10, 0.5, 300, 10
DEAD_LETTERS = 10_000


def error_class(message: Column) -> Column:
    """transient or permanent by parts of the message, the former first; what is
    unknown is transient."""
    def any_of(parts):
        hit = F.lit(False)
        for p in parts:
            hit = hit | message.contains(p)
        return hit

    return F.when(any_of(TRANSIENT), "transient").when(any_of(PERMANENT), "permanent").otherwise("transient")


def backoff_ms(attempt: Column, base: int = BASE_MS, most: int = MOST_MS) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30))), F.lit(float(most))).cast("long")


def error_rates(log: DataFrame, ts: str, failed: Column, by: str | None = None, seconds: int = WINDOW_S) -> DataFrame:
    """``log`` with ``error_rate`` and ``requests`` of the seconds up to a row.

    Without ``by`` the log is one sequence.  It is cut into time buckets as
    long as the window; a row's window lies in its own bucket and the one
    before, so every bucket goes to two groups and none holds the whole log.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = F.floor(at / (seconds * 1_000_000)).cast("long")
    rows = log.withColumn("_at", at).withColumn("_bad", failed.cast("int")).withColumn("_b", F.explode(F.array(bucket, bucket + 1))).withColumn("_own", F.col("_b") == bucket)
    w = Window.partitionBy(*([by] if by else []), "_b").orderBy("_at").rangeBetween(-seconds * 1_000_000, 0)
    out = rows.withColumn("error_rate", F.avg("_bad").over(w)).withColumn("requests", F.count("*").over(w))
    return out.where("_own").drop("_at", "_bad", "_b", "_own")


def breaker_steps(times: list[float], failed: list[bool], state: dict | None = None) -> tuple[list[str], dict]:
    """The breaker's state after each request, and all that it remembers.

    Closed: opens if of at least LEAST_REQUESTS in the last WINDOW_S seconds
    more than OPEN_RATE failed.  Open: requests count for nothing; after OPEN_S
    seconds the next one finds it half open.  Half open: a failure opens it,
    CLOSING successes close it.
    """
    s = state or {"name": "closed", "since": 0.0, "good": 0, "recent": []}
    name, since, good, recent = s["name"], s["since"], s["good"], deque(s["recent"])
    errors, out = sum(x[1] for x in recent), []
    for t, bad in zip(times, failed):
        if name == "open" and t - since >= OPEN_S:
            name, good = "half_open", 0
        if name == "half_open":
            if bad:
                name, since = "open", t
            else:
                good += 1
                if good >= CLOSING:
                    name, errors = "closed", 0
                    recent.clear()
        elif name == "closed":
            recent.append((t, bad))
            errors += bad
            while recent[0][0] < t - WINDOW_S:
                errors -= recent.popleft()[1]
            if len(recent) >= LEAST_REQUESTS and errors / len(recent) > OPEN_RATE:
                name, since, errors = "open", t, 0
                recent.clear()
        out.append(name)
    return out, {"name": name, "since": since, "good": good, "recent": list(recent)}


def breaker_states(log: DataFrame, key: str, ts: str, failed: Column, order: str) -> DataFrame:
    """``(key, order, state)``: each backend's breaker after each request, in
    the order of time, then of ``order``.

    A backend's requests are a sequence; they stream through one task, sorted,
    and only the window's requests are held.
    """
    rows = log.select(key, order, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("t"), failed.cast("boolean").alias("bad"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in (key, order)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            keys, times, bad = (b.column(c).to_pylist() for c in (key, "t", "bad"))
            states, i = [], 0
            while i < len(keys):
                j = i + 1
                while j < len(keys) and keys[j] == keys[i]:
                    j += 1
                some, state = breaker_steps(times[i:j], bad[i:j], state if keys[i] == current else None)
                states += some
                current, i = keys[i], j
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(order), pa.array(states, pa.string())], [key, order, "state"])

    ordered = rows.repartition(key).sortWithinPartitions(key, "t", order)
    return ordered.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, state string")


def newest(letters: DataFrame, order: str, size: int = DEAD_LETTERS) -> DataFrame:
    """The queue after its oldest letters were evicted."""
    return letters.orderBy(F.desc(order)).limit(size)


def unexpired(letters: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    return letters.where(F.col(expires) >= now)


def redriven(letters: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The letters that can be inserted again and those whose key is taken."""
    known = stored.select(key).distinct()
    return letters.join(known, key, "left_anti"), letters.join(known, key, "left_semi")


def hit_rate(hits: Column, misses: Column) -> Column:
    total = hits + misses
    return F.when(total == 0, 0.0).otherwise(hits / total)


def rollup(metrics: DataFrame, sums: list[str], maxima: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of counters and maxima of states, over all or by group."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    return metrics.groupBy(*(by or [])).agg(*aggs)


def cache_health(used: Column, size: Column) -> Column:
    share = F.when(size == 0, 0.0).otherwise(used / size)
    return F.when(share >= 0.9, "unhealthy").when(share >= 0.75, "degraded").otherwise("healthy")


def worst_health(parts: DataFrame, by: list[str], health: str = "health") -> DataFrame:
    """``(*by, health)``: the worst component decides."""
    level = F.when(F.col(health) == "unhealthy", 2).when(F.col(health) == "degraded", 1).otherwise(0)
    top = parts.groupBy(*by).agg(F.max(level).alias("_l"))
    return top.select(*by, F.when(F.col("_l") == 2, "unhealthy").when(F.col("_l") == 1, "degraded").otherwise("healthy").alias("health"))


def ready(collections: DataFrame, breaker: str = "breaker") -> DataFrame:
    """``(ready)``: there are collections and no breaker is open."""
    return collections.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_and(F.col(breaker) != "open"), F.lit(True)).alias("fine")).select((F.col("some") & F.col("fine")).alias("ready"))


# ------------------------------------------------------------- read-through


def cached_reads(log: DataFrame, key: str, order: str, entries: int = 10_000, chunks: int = 64) -> DataFrame:
    """``log`` with ``hit``: whether a read-through cache that holds the last
    ``entries`` different keys read (LRU) had the key.

    Exact, and parallel: what a cache holds is the last ``entries`` different
    keys, so the log is cut into ``chunks`` by ``order``, each gives its last
    keys, these are run together (chunks times entries at most), and each chunk
    is played from the cache that it finds.  Null keys miss.
    """
    cuts = log.agg(F.percentile_approx(order, [i / chunks for i in range(1, chunks)], 10 * chunks).alias("c")).first().c or []
    chunk = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    rows = log.withColumn("_chunk", chunk)
    kind = rows.schema[key].dataType.simpleString()

    def last_keys(group: pa.Table) -> pa.Table:
        keys = group.sort_by(order).column(key).to_pylist()
        held = list(dict.fromkeys(k for k in reversed(keys) if k is not None))[:entries]
        return pa.table({"_chunk": group.column("_chunk").slice(0, 1), "_last": pa.array([held[::-1]], pa.list_(group.schema.field(key).type))})

    def begins(group: pa.Table) -> pa.Table:
        group = group.sort_by("_chunk")
        held, out = OrderedDict(), []
        for keys in group.column("_last").to_pylist():
            out.append(list(held))
            for k in keys:
                held.pop(k, None)
                held[k] = True
            while len(held) > entries:
                held.popitem(last=False)
        return pa.table({"_chunk": group.column("_chunk"), "_held": pa.array(out, group.schema.field("_last").type)})

    def play(x: pa.Table, y: pa.Table) -> pa.Table:
        x = x.sort_by(order)
        held = OrderedDict.fromkeys(y.column("_held")[0].as_py()) if len(y) else OrderedDict()
        hits = []
        for k in x.column(key).to_pylist():
            hits.append(k is not None and k in held)
            if k is not None:
                held.pop(k, None)
                held[k] = True
                if len(held) > entries:
                    held.popitem(last=False)
        return x.drop_columns(["_chunk"]).append_column("hit", pa.array(hits, pa.bool_()))

    small = rows.select(key, order, "_chunk")
    last = small.groupBy("_chunk").applyInArrow(last_keys, f"_chunk int, _last array<{kind}>")
    first = last.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(begins, f"_chunk int, _held array<{kind}>")
    schema = StructType([*log.schema.fields, StructField("hit", BooleanType())])
    return rows.groupBy("_chunk").cogroup(first.groupBy("_chunk")).applyInArrow(play, schema)


# ------------------------------------------------------- dead letters on disk


def keep_letters(letters: DataFrame, path: str, now: Column, order: str = "created_at", size: int = DEAD_LETTERS) -> None:
    """Write the queue: the newest letters that aren't expired, as one version
    beside those before it, named by its time."""
    spark = letters.sparkSession
    stamp = spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("t")).first().t
    newest(unexpired(letters, now), order, size).write.parquet(f"{path}/version={stamp}")


def kept_letters(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The last version of the queue, without letters that expired since."""
    rows = spark.read.parquet(path)
    last = rows.select("version").agg(F.max("version")).first()[0]
    return unexpired(rows.where(F.col("version") == last).drop("version"), now)
