"""Catalog: tenants, databases, collections, users, keys, audit log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbob.errors import AlreadyExists, InvalidState, NotFound, ValidationError

LEAST_DIM, MOST_DIM = 16, 4096
NAME_BYTES, MODEL_BYTES = 255, 256

ACTIONS = (
    "user::create", "user::read", "user::update", "user::delete", "database::create", "database::read", "database::update", "database::delete",
    "collection::create", "collection::read", "collection::update", "collection::delete", "document::insert", "document::search", "document::update", "document::delete", "audit::read",
)
ROLES = {
    "admin": ACTIONS,
    "developer": ("database::read", "collection::create", "collection::read", "collection::update", "collection::delete", "document::insert", "document::search", "document::update", "document::delete"),
    "viewer": ("database::read", "collection::read", "document::search"),
    "auditor": ("database::read", "collection::read", "audit::read"),
}


# ------------------------------------------------------------------ listings


def listed(df: DataFrame, by: str = "created_at", key: str | None = None, newest: bool = False) -> DataFrame:
    """Rows in order of creation; ties by key."""
    order = [F.desc(by) if newest else F.asc(by)]
    return df.orderBy(*order, *([F.asc(key)] if key else []))


def page(df: DataFrame, limit: int, offset: int = 0, by: str = "created_at", key: str | None = None) -> DataFrame:
    """A page of the newest rows."""
    if limit < 0 or offset < 0:
        raise ValidationError("limit and offset mustn't be negative")
    return listed(df, by, key, True).offset(offset).limit(limit)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the largest ``order`` of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def users_by_email(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Users of ``wanted(tenant_id, email)``."""
    return users.join(wanted.select("tenant_id", "email").distinct(), ["tenant_id", "email"], "left_semi")


# --------------------------------------------------------------- constraints


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """``(*key, rows)`` of keys that aren't unique."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of ``child`` whose reference isn't null and isn't in ``parent``."""
    known = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return child.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def cascaded(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``child`` after its parents in ``gone`` were deleted."""
    return child.join(gone.select(key).distinct(), key, "left_anti")


def nulled(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``child`` with references to ``gone`` set to null."""
    mark = gone.select(F.col(key).alias("_gone")).distinct()
    rows = child.join(mark, F.col(key) == F.col("_gone"), "left")
    return rows.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(child.columns)


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    if row := repeated(df, *key).first():
        raise AlreadyExists(", ".join(f"{k}={row[k]}" for k in key))
    return df


def require_parents(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    if row := orphans(child, parent, key, parent_key).first():
        raise InvalidState(f"{key} {row[key]} doesn't exist")
    return child


# ---------------------------------------------------------------- validation


def name_problem(name: Column) -> Column:
    """What is wrong with a collection's name, or null."""
    return (
        F.when(name.isNull() | (name == ""), "empty")
        .when(F.octet_length(name) > NAME_BYTES, "too long")
        .when(name.contains(".."), "path traversal")
        .when(name.rlike(r"[/\\\x00]"), "path separator")
        .when(name.rlike(r'[<>:"|?*]'), "reserved character")
        .when(name.rlike(r"[\x01-\x1f\x7f-\x9f]"), "control character")
    )


def check_collection(name: str, dimension: int, model: str = "none") -> None:
    """Raise what is wrong with a new collection's settings."""
    if not name or len(name.encode()) > NAME_BYTES:
        raise ValidationError("a name has 1 to 255 bytes")
    if ".." in name or any(c in '/\\<>:"|?*' or ord(c) < 32 or 127 <= ord(c) < 160 for c in name):
        raise ValidationError("a name mustn't hold path parts, reserved or control characters")
    if not LEAST_DIM <= dimension <= MOST_DIM:
        raise ValidationError(f"a dimension is from {LEAST_DIM} to {MOST_DIM}")
    if not 1 <= len(model.encode()) <= MODEL_BYTES:
        raise ValidationError("a model's name has 1 to 256 bytes")


# ------------------------------------------------------------------ security


def allowed(role: Column, status: Column, action: Column) -> Column:
    """Whether an active user's role permits an action."""
    by_role = F.lit(False)
    for name, actions in ROLES.items():
        by_role = F.when(role == name, action.isin(*actions)).otherwise(by_role)
    return (status == "active") & by_role


def permission_matrix(users: DataFrame) -> DataFrame:
    """``users`` times actions, with ``allowed``."""
    rows = users.withColumn("action", F.explode(F.array(*map(F.lit, ACTIONS))))
    return rows.withColumn("allowed", F.coalesce(allowed(F.col("role"), F.col("status"), F.col("action")), F.lit(False)))


def key_shape(key: Column) -> Column:
    """Whether a text can be an API key: ``ak_`` and 64 more characters."""
    return key.startswith("ak_") & (F.length(key) == 67)


def key_hash(key: Column) -> Column:
    return F.sha2(key, 256)


def key_problem(expires_at: Column, permissions: Column, permission: Column, now: Column) -> Column:
    """Why a known key doesn't permit something, or null."""
    return F.when(expires_at.isNotNull() & (now > expires_at), "expired").when(~F.array_contains(permissions, permission), "not permitted")


def quota_flags(memory: Column, storage: Column, qps: Column) -> list[Column]:
    """A quota of 0 has no bound."""
    return [(memory == 0).alias("memory_unbounded"), (storage == 0).alias("storage_unbounded"), (qps == 0).alias("qps_unbounded")]


def over_quota(used: Column, quota: Column) -> Column:
    return (quota > 0) & (used > quota)


# -------------------------------------------------------------------- changes


def created(df: DataFrame, rows: DataFrame, key: str, unique: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with new ``rows``; a key that is taken, or other columns that must
    be unique together and aren't, are an error."""
    out = df.unionByName(rows)
    require_unique(out, key)
    if unique:
        require_unique(out, *unique)
    return out


def updated(df: DataFrame, changes: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """``df`` with the columns of ``changes`` replaced where its key occurs;
    ``updated_at``, if there, is renewed.  A missing or repeated key is an error."""
    require_unique(changes, key)
    if row := changes.join(df.select(key), key, "left_anti").first():
        raise NotFound(f"{key} {row[key]} not found")
    fresh = [c for c in changes.columns if c != key]
    rows = df.join(changes.select(key, F.struct(*fresh).alias("_new")), key, "left")
    hit = F.col("_new").isNotNull()
    values = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in fresh}
    if "updated_at" in df.columns and "updated_at" not in fresh:
        values["updated_at"] = F.when(hit, F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in df.columns))


def removed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``df`` without ``keys``; a missing one is an error."""
    gone = keys.select(key).distinct()
    if row := gone.join(df.select(key), key, "left_anti").first():
        raise NotFound(f"{key} {row[key]} not found")
    return df.join(gone, key, "left_anti")


def touched(keys: DataFrame, used: DataFrame, key: str = "key_id", ts: str = "used_at") -> DataFrame:
    """API keys with ``last_used_at`` renewed from a log of uses."""
    last = used.groupBy(key).agg(F.max(ts).alias("_at"))
    rows = keys.join(last, key, "left")
    return rows.withColumn("last_used_at", F.greatest("last_used_at", "_at")).select(*keys.columns)
