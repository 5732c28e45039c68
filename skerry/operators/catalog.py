"""Tenants, databases and collections as tables, and metadata rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.errors import QuotaExceeded

DEFAULT_TENANT, DEFAULT_DATABASE = "default_tenant", "default"
#: Limits of a vector's metadata: keys, and bytes of a text value; and what a key looks like.
MAX_KEYS, MAX_VALUE, KEY = 50, 1024, r"^[a-zA-Z0-9_-]{1,64}$"


def scope(df: DataFrame, tenant: str, database: str | None = None) -> DataFrame:
    """Rows of a tenant (and database) only; another tenant's rows don't exist for it."""
    own = df.where(F.col("tenant") == tenant)
    return own if database is None else own.where(F.col("database") == database)


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def collections_per_tenant(collections: DataFrame, tenants: DataFrame) -> DataFrame:
    """(tenant, n), also for tenants without collections."""
    return tenants.select("tenant").join(counts(collections, "tenant"), "tenant", "left").select("tenant", F.coalesce("n", F.lit(0)).alias("n"))


def check_quota(n: int, limit: int) -> None:
    """A limit of 0 is none."""
    if limit and n >= limit:
        raise QuotaExceeded(f"{n} of {limit} in use")


def to_eav(df: DataFrame, *columns: str) -> DataFrame:
    """(id, meta_key, meta_value) of columns; nulls have no row."""
    pairs = F.array(*(F.struct(F.lit(c).alias("meta_key"), F.col(c).cast("string").alias("meta_value")) for c in columns))
    return df.select("id", F.explode(pairs).alias("m")).select("id", "m.*").where("meta_value is not null")


def from_eav(eav: DataFrame) -> DataFrame:
    """(id, metadata map); of several values of a key the largest."""
    one = eav.groupBy("id", "meta_key").agg(F.max("meta_value").alias("meta_value"))
    return one.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("meta_key", "meta_value")))).alias("metadata"))


def upsert_eav(eav: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows (id, meta_key, meta_value) after ``changes`` of the same columns: a changed key has its new value, and new keys come in."""
    new = changes.groupBy("id", "meta_key").agg(F.max("meta_value").alias("meta_value"))
    return eav.join(new, ["id", "meta_key"], "left_anti").select("id", "meta_key", "meta_value").unionByName(new)


def delete_eav(eav: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of all ids but those of ``ids``."""
    return eav.join(ids.select("id").distinct(), "id", "left_anti").select("id", "meta_key", "meta_value")


def merge_json(metadata, changes):
    """JSON objects as text: the keys of ``changes`` replace those of ``metadata``; null counts as no key."""
    of = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>")
    old = F.map_filter(of(metadata), lambda k, _: ~F.array_contains(F.map_keys(of(changes)), k))
    return F.when(changes.isNull(), metadata).otherwise(F.to_json(F.map_concat(old, of(changes))))


def metadata_errors(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """(id, error) of rows whose metadata map breaks a limit."""
    m = F.col(metadata)
    error = F.when(F.size(m) > MAX_KEYS, "too many keys").when(F.exists(F.map_keys(m), lambda k: ~k.rlike(KEY)), "bad key").when(F.exists(F.map_values(m), lambda v: F.octet_length(v) > MAX_VALUE), "value too long")
    return df.select("id", error.alias("error")).where("error is not null")


def valid_keys(keys: DataFrame, now) -> DataFrame:
    """API keys that have not run out."""
    return keys.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
