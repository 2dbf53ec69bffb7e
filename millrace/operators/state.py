"""State changes as pure functions: a table and a command give the table's new state.

Plain files cannot be changed row by row, so a change is a new state that a sink swaps
in (``sources.store``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.crypto import short_digest


def inserted(state: DataFrame, rows: DataFrame) -> DataFrame:
    return state.unionByName(rows, allowMissingColumns=True)


def upserted(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those of the same keys; the others are added. Keys of ``rows`` are unique."""
    return state.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def deleted(state: DataFrame, predicate: Column) -> DataFrame:
    """Without the rows for which the predicate is true; null is not true."""
    return state.where(~F.coalesce(predicate, F.lit(False)))


def replaced(state: DataFrame, predicate: Column, rows: DataFrame) -> DataFrame:
    """The rows of the predicate give way to ``rows``."""
    return deleted(state, predicate).unionByName(rows, allowMissingColumns=True)


def ensured(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose keys are not there yet, the first of each."""
    once = rows.dropDuplicates(keys)
    return state.unionByName(once.join(state.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def cascaded(definitions: DataFrame, authorities: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Definitions and authorities after a definition and its four authorities are gone."""
    gone = [f"{key}:{action}" for action in ("create", "read", "update", "delete")]
    return deleted(definitions, F.col("key") == key), deleted(authorities, F.col("name").isin(gone))


def synced(records: DataFrame, as_of: Column) -> DataFrame:
    """Every record saved again: data stays as it is, only the time of update moves."""
    return records.withColumn("updatedAt", as_of)


def audited(rows: DataFrame, as_of: Column, user: str | None) -> DataFrame:
    return rows.withColumns({"createdAt": F.coalesce("createdAt", as_of), "updatedAt": as_of, "createdBy": F.coalesce("createdBy", F.lit(user or "system"))})


def index_names(indexes: DataFrame) -> DataFrame:
    """``indexes`` (name, fields: array of path and direction) with the name that each is given."""
    signature = F.lower(F.array_join(F.transform("fields", lambda f: F.concat(F.coalesce(f["path"], F.lit("")), F.lit(":"), F.coalesce(f["direction"].cast("string"), F.lit("null")))), "|"))
    own = F.when(F.col("name").rlike(r"\S"), F.col("name"))
    return indexes.withColumn("name", F.coalesce(own, F.concat(F.lit("entity_idx_"), short_digest(signature))))


#: Fields of a record that do not lie below its data.
OWN_FIELDS = ["_id", "createdAt", "updatedAt", "createdBy"]


def index_specs(indexes: DataFrame) -> DataFrame:
    """(name, keys, unique, sparse) of the indexes to make; ``indexes`` also has the flags unique and sparse.

    keys: array of path, as it lies in a record, and direction: -1 as given, else 1. A
    field without a path is left out; an index without fields is not made.
    """
    path = lambda f: F.when(f["path"].startswith("data.") | f["path"].isin(OWN_FIELDS), f["path"]).otherwise(F.concat(F.lit("data."), f["path"]))
    down = lambda f: F.coalesce(f["direction"] == -1, F.lit(False))
    told = F.filter("fields", lambda f: F.coalesce(f["path"].rlike(r"\S"), F.lit(False)))
    keys = F.transform(told, lambda f: F.struct(path(f).alias("path"), F.when(down(f), -1).otherwise(1).alias("direction")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return index_names(indexes.where(F.size("fields") > 0)).select("name", keys.alias("keys"), flag("unique"), flag("sparse"))


def index_changes(desired: DataFrame, existing: DataFrame) -> DataFrame:
    """(name, change): replace, create or drop; the index on the key stays."""
    d, e = desired.select("name").distinct().withColumn("d", F.lit(True)), existing.select("name").distinct().where("name != '_id_'").withColumn("e", F.lit(True))
    change = F.when(F.col("d").isNull(), "drop").when(F.col("e").isNull(), "create").otherwise("replace")
    return d.join(e, "name", "full").select("name", change.alias("change"))


def expired(tokens: DataFrame, as_of: Column, column: str = "expires_at") -> DataFrame:
    """Strictly before the moment."""
    return tokens.where(F.col(column) < as_of)


def live(rows: DataFrame, as_of: Column, ttl_seconds: int, column: str = "created_at") -> DataFrame:
    """Rows whose time to live has not run out."""
    return rows.where(F.col(column) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds)) > as_of)


def garbage(files: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Files that nothing links and that are older than so many hours."""
    return files.where(~F.col("is_linked") & (F.col("created_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))


def evicted(devices: DataFrame, limit: int) -> DataFrame:
    """The one oldest device of every user that has reached the limit."""
    counted = devices.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("device_id", "created_at"), F.struct("created_at", "device_id")).alias("d"))
    return counted.where(F.col("n") >= limit).select("user_id", "d.device_id", "d.created_at")


def logged_in(devices: DataFrame, logins: DataFrame, limit: int) -> DataFrame:
    """Devices (user_id, device_id, client_type, created_at) after one login a user: first evict, then upsert."""
    full = evicted(devices.join(logins.select("user_id").distinct(), "user_id", "left_semi"), limit).select("user_id", "device_id")
    kept = devices.join(full, ["user_id", "device_id"], "left_anti")
    known = kept.select("user_id", "device_id", F.col("created_at").alias("__since"))
    new = logins.join(known, ["user_id", "device_id"], "left").withColumn("created_at", F.coalesce("__since", "created_at")).drop("__since")
    return upserted(kept, new, ["user_id", "device_id"])


def revoked(tokens: DataFrame, devices: DataFrame) -> DataFrame:
    """Refresh tokens (user_id, device_id, ...) without those of devices that are evicted or signed out."""
    return tokens.join(devices.select("user_id", "device_id"), ["user_id", "device_id"], "left_anti")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def completed(uploads: DataFrame, names: DataFrame) -> DataFrame:
    """Pending uploads (file_name, status) that have arrived are completed."""
    done = names.select("file_name", F.lit(True).alias("__done")).distinct()
    return uploads.join(done, "file_name", "left").withColumn("status", F.when(F.col("__done") & (F.col("status") == "PENDING"), "COMPLETED").otherwise(F.col("status"))).drop("__done")


def key_changes(old: DataFrame, new: DataFrame, key: str = "key", by: str = "id") -> DataFrame:
    """The updates that would change a definition's key, which is not allowed."""
    before = old.select(by, F.col(key).alias("__before"))
    return new.join(before, by).where(~F.col(key).eqNullSafe(F.col("__before"))).drop("__before")
