"""Tiering, resilience, metrics, embedding, streaming."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbob import errors
from plumbob.functions import embedding
from plumbob.operators import metrics, resilience, tiering
from plumbob.streaming import jobs

NOW = datetime(2024, 1, 31)


def states(spark, rows):
    return spark.createDataFrame([(k, tier, NOW - timedelta(hours=h), n, NOW - timedelta(hours=w), p) for k, tier, h, n, w, p in rows], "k string, tier string, last_accessed_at timestamp, access_count long, access_window_start timestamp, pinned boolean")


def test_tiering(spark):
    s = states(spark, [("fresh", "hot", 1, 5, 1, False), ("idle", "hot", 7, 5, 9, False), ("ancient", "hot", 200, 5, 300, False), ("pin", "hot", 200, 5, 300, True), ("warm", "warm", 169, 1, 300, False), ("busy", "warm", 0, 10, 0, True), ("edge", "hot", 6, 1, 9, False)])
    now = F.lit(NOW)
    got = {r.k: r.new_tier for r in tiering.cycle(s, now).collect()}
    assert got == {"fresh": "hot", "idle": "warm", "ancient": "cold", "pin": "hot", "warm": "cold", "busy": "hot", "edge": "hot"}
    assert {r.k for r in tiering.idle_hot(s, now).collect()} == {"idle", "ancient"}
    assert {r.k for r in tiering.idle_warm(s, now).collect()} == {"warm"}
    assert {r.k for r in tiering.busy_warm(s, now).collect()} == {"busy"}
    assert {r.k for r in tiering.pinned(s, s.where("k = 'idle'"), "k").where("pinned").collect()} == {"pin", "busy", "idle"}
    with pytest.raises(errors.ValidationError):
        tiering.Policy(hot_hours=0)
    assert tiering.move({"tier": "cold", "snapshot_id": "s"}, "warm")["tier"] == "warm"
    for state, to in (({"tier": "cold"}, "warm"), ({"tier": "warm"}, "cold"), ({"tier": "hot", "pinned": True}, "warm"), ({"tier": "hot"}, "cold")):
        with pytest.raises(errors.InvalidState):
            tiering.move(state, to)


def test_errors(spark):
    m = spark.createDataFrame([("HTTP 503",), ("404 and timeout",), ("403 Forbidden",), ("odd",)], "m string")
    assert [r[0] for r in m.select(resilience.error_class(F.col("m"))).collect()] == ["transient", "transient", "permanent", "transient"]
    assert [r[0] for r in spark.range(8).select(resilience.backoff_ms(F.col("id") * 10)).collect()] == [1000] + [64000] * 7


def test_breaker():
    steps, state = resilience.breaker_steps(list(range(12)), [True] * 12)
    assert steps == ["closed"] * 9 + ["open"] * 3
    steps, state = resilience.breaker_steps([400.0 + i for i in range(10)], [False] * 10, state)
    assert steps == ["half_open"] * 9 + ["closed"]
    _, state = resilience.breaker_steps(list(range(10)), [True] * 10)
    assert resilience.breaker_steps([309.0, 310.0], [True, False], state)[0] == ["open", "open"]
    assert set(resilience.breaker_steps([100.0 * i for i in range(50)], [True] * 50)[0]) == {"closed"}


def test_error_rates_meet_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, NOW + timedelta(seconds=float(t)), bool(b)) for i, (t, b) in enumerate(zip(rng.integers(0, 600, 300), rng.random(300) < 0.3))]
    got = {r.i: (round(r.error_rate, 9), r.requests) for r in resilience.error_rates(spark.createDataFrame(rows, "i int, ts timestamp, bad boolean"), "ts", F.col("bad")).collect()}
    for i, t, _ in rows:
        near = [b for _, u, b in rows if t - timedelta(seconds=60) <= u <= t]
        assert got[i] == (round(sum(near) / len(near), 9), len(near))


def test_queue_and_health(spark):
    q = spark.createDataFrame([(i, NOW + timedelta(days=i - 2)) for i in range(5)], "i int, expires_at timestamp")
    assert sorted(r.i for r in resilience.newest(q, "i", 2).collect()) == [3, 4]
    assert sorted(r.i for r in resilience.unexpired(q, F.lit(NOW)).collect()) == [2, 3, 4]
    again, taken = resilience.redriven(q, q.where("i < 2"), "i")
    assert (again.count(), taken.count()) == (3, 2)
    parts = spark.createDataFrame([("x", 95, 100), ("x", 1, 100), ("y", 75, 100), ("z", 0, 0)], "c string, used int, size int").withColumn("health", resilience.cache_health(F.col("used"), F.col("size")))
    assert {r.c: r.health for r in resilience.worst_health(parts, ["c"]).collect()} == {"x": "unhealthy", "y": "degraded", "z": "healthy"}
    b = spark.createDataFrame([("closed",), ("open",)], "breaker string")
    assert [resilience.ready(x).first().ready for x in (b, b.limit(1), b.limit(0))] == [False, True, False]
    assert spark.range(1).select(resilience.hit_rate(F.lit(0), F.lit(0))).first()[0] == 0


def test_metrics(spark):
    log = spark.createDataFrame([(NOW + timedelta(seconds=i), float(i), i % 4 == 0) for i in range(100)], "ts timestamp, v double, bad boolean")
    assert metrics.indexed_percentiles(log.withColumn("g", F.lit(1)), "v", (0.5, 0.99, 1.0), ("g",)).first().asDict() == {"g": 1, "n": 100, "p50": 50, "p99": 99, "p100": 99}
    assert metrics.slopes(log, "ts", "v").first().slope == pytest.approx(1)
    assert metrics.exact_percentile(log, "v", 0.95).first().p95 == 94
    assert abs(metrics.sketch_percentile(log, "v", 0.95).first().p95 - 94) <= 1
    s = metrics.load_summary(log, "ts", "v", F.col("bad")).first()
    assert (s.requests, s.failures, s.error_rate, s.slope_per_minute) == (100, 25, 0.25, 60)
    empty = metrics.load_summary(log.limit(0), "ts", "v", F.col("bad")).first()
    assert (empty.requests, empty.error_rate, empty.per_second) == (0, 0, 0)
    assert [r["count"] for r in metrics.bucket_counts(log, "v", (9.0, 49.0)).orderBy(F.col("le").asc_nulls_last()).collect()] == [10, 50, 100]


@pytest.mark.parametrize("accuracy", [10, 100_000])
def test_ranks_are_exact(spark, accuracy):
    rng = np.random.default_rng(accuracy)
    rows = [(k, float(x)) for k, n in (("a", 1000), ("b", 7), (None, 40), ("ties", 300)) for x in (rng.integers(0, 5, n) if k == "ties" else rng.normal(size=n))] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    picks = {"low": (0.0, lambda n: F.lit(0)), "mid": (0.5, lambda n: F.floor(n * 0.5)), "top": (1.0, lambda n: n - 1)}
    for r in metrics.ranked_values(df, "v", picks, ("k",), accuracy).collect():
        v = sorted(x for k, x in rows if k == r.k and x is not None)
        assert (r.n, r.low, r.mid, r.top) == (len(v), v[0], v[len(v) // 2], v[-1])


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "hi"), (2, "hi"), (3, "there"), (4, None), (5, "")], "k int, t string")
    got = {r.k: r.embedding for r in embedding.embed(docs, "k", "t").collect()}
    assert got[1] == got[2] != got[3] and got[4] is None and len(got[5]) == 64
    with pytest.raises(errors.NotFound):
        embedding.embed(docs, "k", "t", model="other")
    with pytest.raises(errors.ValidationError):
        embedding.embed(docs, "k", "t", batch=33)
    assert embedding.model_info(embedding.HashProvider())["healthy"]
    assert embedding.token_estimate(docs, "t").first().total_tokens == 5
    assert [r[0] for r in docs.select(embedding.word_count(F.col("t"))).collect()] == [1, 1, 1, 1, 1]


def run(query):
    q = query.start()
    q.processAllAvailable()
    q.stop()


def test_streamed_log_equals_batch(spark, tmp_path):
    source = tmp_path / "log"
    source.mkdir()
    lines = ['[1,{"type":"upsert","doc_id":"a"}]', '[4,{"type":"delete","doc_id":"a"}]', '[2,{"type":"upsert","doc_id":"b"}]', '[3,{"type":"upsert","doc_id":"a"}]', "broken"]
    for i, line in enumerate(lines):
        (source / f"{i}.log").write_text(line + "\n")
    changes = jobs.log_tail(spark, str(source), 1).select("lsn", "type", "doc_id", "metadata")
    run(jobs.maintain_state(changes, str(tmp_path / "state"), str(tmp_path / "check")))
    last = max(int(p.name) for p in (tmp_path / "state").iterdir() if p.name.isdigit())
    assert [(r.doc_id, r.lsn) for r in jobs.state_of(spark, str(tmp_path / "state"), last).collect()] == [("b", 2)]


def test_streamed_windows_drop_late_rows(spark, tmp_path):
    schema = "k string, ts timestamp"
    source = tmp_path / "in"
    for i, (k, t) in enumerate([("a", NOW), ("a", NOW + timedelta(hours=5)), ("a", NOW + timedelta(minutes=1)), ("b", NOW + timedelta(hours=9))]):
        spark.createDataFrame([(k, t)], schema).coalesce(1).write.mode("append").parquet(str(source))
        if i == 0:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
            q = jobs.windowed_access(stream, "k", "ts").writeStream.format("memory").queryName("access").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    got = {(r.k, r.accesses) for r in spark.table("access").collect()}
    assert got == {("a", 1)} and spark.table("access").count() == 2  # the late row isn't counted


def test_streamed_breaker(spark, tmp_path):
    schema = "k string, ts timestamp, bad boolean"
    source = tmp_path / "in"
    for part in range(2):
        spark.createDataFrame([("s3", NOW + timedelta(seconds=10 * part + i), True) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(str(source))
        if not part:
            q = jobs.breakers(spark.readStream.schema(schema).parquet(str(source)), "k", "ts", "bad").writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.stop()
    assert [r.state for r in spark.table("states").orderBy("t").collect()] == ["closed"] * 9 + ["open"] * 11


@pytest.mark.parametrize("entries, chunks", [(1, 5), (7, 1), (7, 6), (40, 16)])
def test_cache_is_the_sequential_one(spark, entries, chunks):
    rng = random.Random(entries)
    rows = [(i, rng.choice([None, *range(5), *range(30)])) for i in range(400)]
    held, want = [], {}
    for i, k in rows:
        want[i] = k is not None and k in held
        if k is not None:
            held = [x for x in held if x != k][-(entries - 1) :] + [k] if entries > 1 else [k]
    log = spark.createDataFrame(rng.sample(rows, len(rows)), "i long, k int")
    got = resilience.cached_reads(log, "k", "i", entries, chunks)
    assert got.columns == ["i", "k", "hit"] and {r.i: r.hit for r in got.collect()} == want
    assert resilience.cached_reads(log.limit(0), "k", "i", entries, chunks).count() == 0


def test_letters_are_kept_and_expire(spark, tmp_path):
    path = str(tmp_path / "letters")
    at = lambda day: F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp")
    letters = spark.range(1, 11).select("id", F.expr("timestamp'2024-01-01' + make_dt_interval(int(id))").alias("expires_at"))
    resilience.keep_letters(letters, path, at(1), "id", 6)
    assert [r.id for r in resilience.kept_letters(spark, path, at(8)).orderBy("id").collect()] == [7, 8, 9, 10]
    resilience.keep_letters(letters.where("id < 3"), path, at(1), "id", 6)
    assert [r.id for r in resilience.kept_letters(spark, path, at(1)).orderBy("id").collect()] == [1, 2]
