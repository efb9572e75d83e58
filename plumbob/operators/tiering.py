"""Tiers by access: statistics, candidates, one cycle of moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.errors import InvalidState, ValidationError


@dataclass(frozen=True)
class Policy:
    hot_hours: int = 6
    warm_days: int = 7
    hot_accesses: int = 10
    window_hours: int = 1
    interval_seconds: int = 300

    def __post_init__(self):
        if min(self.hot_hours, self.warm_days, self.hot_accesses, self.window_hours) < 1:
            raise ValidationError("a policy's values are 1 at least")
        if self.interval_seconds < 60:
            raise ValidationError("the interval is 60 seconds at least")


POLICY = Policy()


def access_stats(log: DataFrame, key: str, ts: str) -> DataFrame:
    """``(key, last_accessed_at, access_count)``."""
    return log.groupBy(key).agg(F.max(ts).alias("last_accessed_at"), F.count("*").alias("access_count"))


def window_counts(log: DataFrame, key: str, ts: str, now: Column, policy: Policy = POLICY) -> DataFrame:
    """``(key, recent)``: accesses in the hours before ``now`` that a promotion
    looks at; a true sliding window."""
    recent = (F.col(ts) > now - F.expr(f"INTERVAL {policy.window_hours} HOURS")) & (F.col(ts) <= now)
    return log.groupBy(key).agg(F.sum(F.when(recent, 1).otherwise(0)).cast("long").alias("recent"))


def idle_hot(states: DataFrame, now: Column, policy: Policy = POLICY) -> DataFrame:
    return states.where((F.col("tier") == "hot") & (F.col("last_accessed_at") < now - F.expr(f"INTERVAL {policy.hot_hours} HOURS")) & ~F.col("pinned"))


def idle_warm(states: DataFrame, now: Column, policy: Policy = POLICY) -> DataFrame:
    return states.where((F.col("tier") == "warm") & (F.col("last_accessed_at") < now - F.expr(f"INTERVAL {policy.warm_days} DAYS")) & ~F.col("pinned"))


def busy_warm(states: DataFrame, now: Column, policy: Policy = POLICY) -> DataFrame:
    """Pinned collections are promoted too."""
    return states.where((F.col("tier") == "warm") & (F.col("access_window_start") >= now - F.expr(f"INTERVAL {policy.window_hours} HOURS")) & (F.col("access_count") >= policy.hot_accesses))


def cycle(states: DataFrame, now: Column, policy: Policy = POLICY) -> DataFrame:
    """``states`` with ``new_tier`` after the three steps in their order: idle
    hot to warm, idle warm to cold, busy warm to hot.  One pass, no shuffle."""
    free, last = ~F.col("pinned"), F.col("last_accessed_at")
    one = F.when((F.col("tier") == "hot") & (last < now - F.expr(f"INTERVAL {policy.hot_hours} HOURS")) & free, "warm").otherwise(F.col("tier"))
    rows = states.withColumn("new_tier", one)
    two = F.when((F.col("new_tier") == "warm") & (last < now - F.expr(f"INTERVAL {policy.warm_days} DAYS")) & free, "cold").otherwise(F.col("new_tier"))
    rows = rows.withColumn("new_tier", two)
    busy = (F.col("access_window_start") >= now - F.expr(f"INTERVAL {policy.window_hours} HOURS")) & (F.col("access_count") >= policy.hot_accesses)
    return rows.withColumn("new_tier", F.when((F.col("new_tier") == "warm") & busy, "hot").otherwise(F.col("new_tier")))


def move(state: dict, to: str) -> dict:
    """One collection's state after a move by hand."""
    tier, order = state["tier"], ("cold", "warm", "hot")
    if to not in order or tier not in order:
        raise ValidationError(f"unknown tier: {to}")
    if order.index(to) < order.index(tier) and state.get("pinned"):
        raise InvalidState("pinned collections aren't demoted")
    if abs(order.index(to) - order.index(tier)) != 1:
        raise InvalidState(f"no move from {tier} to {to}")
    if (tier, to) == ("cold", "warm") and not state.get("snapshot_id"):
        raise InvalidState("a cold collection needs a snapshot")
    if (tier, to) == ("warm", "cold") and not state.get("warm_file_path"):
        raise InvalidState("a warm collection needs a file")
    return state | {"tier": to}


def pinned(states: DataFrame, keys: DataFrame, key: str, value: bool = True) -> DataFrame:
    """``states`` with the collections of ``keys`` pinned or not."""
    mark = keys.select(key).distinct().withColumn("_p", F.lit(True))
    return states.join(mark, key, "left").withColumn("pinned", F.when(F.col("_p"), F.lit(value)).otherwise(F.col("pinned"))).drop("_p")


def tier_counts(states: DataFrame, tier: str = "tier") -> DataFrame:
    return states.groupBy(tier).agg(F.count("*").alias("collections"))


#: Where a collection's vectors are kept: in memory, in an object store.
STORAGE = {"memory": (True, False), "memory_s3": (True, True), "s3_only": (False, True)}


def storage_flags(policy: Column) -> list[Column]:
    """What a storage policy means: every one keeps a change log."""
    known = policy.isin(*STORAGE)
    flag = lambda i: policy.isin(*(k for k, v in STORAGE.items() if v[i]))
    return [known.alias("known"), flag(0).alias("keeps_memory"), flag(1).alias("needs_store"), known.alias("needs_log")]


def moves(states: DataFrame, key: str) -> DataFrame:
    """``(key, from_tier, to_tier, action)`` of a cycle's result: what has to be
    done with the data of the collections that change tiers."""
    rows = states.where(F.col("tier") != F.col("new_tier"))
    action = F.when(F.col("new_tier") == "hot", "load").when((F.col("tier") == "hot") & (F.col("new_tier") == "cold"), "write file and snapshot").when(F.col("new_tier") == "cold", "snapshot").when(F.col("tier") == "hot", "write file").otherwise("restore")
    return rows.select(key, F.col("tier").alias("from_tier"), F.col("new_tier").alias("to_tier"), action.alias("action"))
