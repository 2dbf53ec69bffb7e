"""Roles, authorities and who may see what."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.language import Definition


def generated(resources: DataFrame, actions: DataFrame) -> DataFrame:
    """(name): resource:action for every pair; both are configuration, of a handful of rows each."""
    return resources.select("resource").distinct().crossJoin(F.broadcast(actions.select("action").distinct())).select(F.concat_ws(":", "resource", "action").alias("name"))


def missing(wanted: DataFrame, existing: DataFrame, key: str = "name") -> DataFrame:
    """What is wanted but not there, once each."""
    return wanted.select(key).distinct().join(existing.select(key), key, "left_anti")


def of_names(authorities: DataFrame, names: Iterable[str]) -> DataFrame:
    return authorities.where(F.col("name").isin(list(names)))


def union(*frames: DataFrame) -> DataFrame:
    """The distinct names of all frames."""
    out = frames[0].select("name")
    for f in frames[1:]:
        out = out.unionByName(f.select("name"))
    return out.distinct()


def through(left: DataFrame, bridge: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The pairs of a many-to-many relation: left ⋈ bridge ⋈ right."""
    return left.join(bridge, left["id"] == bridge[left_id]).join(right, right["id"] == bridge[right_id]).select(bridge[left_id].alias("owner_id"), right["name"])


def name_sets(pairs: DataFrame) -> DataFrame:
    """(owner_id, names): distinct and sorted."""
    return pairs.groupBy("owner_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def effective(active: DataFrame, sub_roles: DataFrame) -> DataFrame:
    """(owner_id, authorities): of the active role and of all sub-roles; pairs (owner_id, name) in."""
    return name_sets(active.unionByName(sub_roles)).withColumnRenamed("names", "authorities")


def claims(users: DataFrame, authorities: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """What a token of each user (id, email, full_name, role) says."""
    return users.join(authorities.withColumnRenamed("owner_id", "id"), "id", "left").select(
        F.col("id").cast("string").alias("sub"), "id", "email", "full_name", "role", F.coalesce("authorities", F.array()).alias("authorities"), as_of.alias("iat"), (as_of + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))).alias("exp")
    )


def _open(d: Definition | None, flag: bool | None, authority: str, held: Iterable[str], active: bool = True) -> bool:
    if d is None or (active and d.active is not True):
        return False
    return flag is True or authority in set(held)


def can_read_definition(d: Definition | None, held: Iterable[str]) -> bool:
    """Reading a definition does not ask whether it is active."""
    return _open(d, d and d.public_get, "entity:read", held, active=False)


def can_create(d: Definition | None, held: Iterable[str]) -> bool:
    return _open(d, d and d.public_post, f"{d.key}:create" if d else "", held)


def can_update(d: Definition | None, held: Iterable[str]) -> bool:
    """Also the permission to delete."""
    return _open(d, d and d.public_put, f"{d.key}:update" if d else "", held)


def can_read_records(d: Definition | None, held: Iterable[str]) -> bool:
    return _open(d, d and d.public_get, f"{d.key}:read" if d else "", held)


def can_read_private(d: Definition | None, held: Iterable[str]) -> bool:
    return _open(d, False, f"{d.key}:read" if d else "", held)


def readable_rows(rows: DataFrame, definitions: DataFrame, authorities: Column) -> DataFrame:
    """Rows (entity_key, ...) of active definitions (key, active, public_get) that are public or named in ``authorities``."""
    may = F.coalesce("active", F.lit(False)) & (F.coalesce("public_get", F.lit(False)) | F.array_contains(authorities, F.concat("key", F.lit(":read"))))
    return rows.join(definitions.where(may).select(F.col("key").alias("entity_key")), "entity_key", "left_semi")


def usable(users: DataFrame) -> DataFrame:
    """Enabled and not blocked."""
    return users.where(F.coalesce("enabled", F.lit(False)) & ~F.coalesce("blocked", F.lit(False)))


def owned(rows: DataFrame, user_id: int, column: str = "user_id") -> DataFrame:
    """The rows that belong to a user."""
    return rows.where(F.col(column) == user_id)


def member_rows(rows: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Rows (conversation_id, ...) of conversations that a user is a member of."""
    return rows.join(members.where(F.col("user_id") == user_id).select("conversation_id"), "conversation_id", "left_semi")


def active_roles(users: DataFrame, roles: DataFrame, allowed: Column, fallback: str) -> DataFrame:
    """(id, role) for users (id, last_role): the last role if held and ``allowed``, else the smallest allowed one, else ``fallback``.

    roles: id, role; ``allowed`` is a predicate on role, the policy of the application.
    """
    held = roles.where(allowed).groupBy("id").agg(F.collect_set("role").alias("held"))
    last = F.when(F.array_contains("held", F.col("last_role")), F.col("last_role"))
    return users.join(held, "id", "left").select("id", F.coalesce(last, F.array_min("held"), F.lit(fallback)).alias("role"))


def linked_accounts(users: DataFrame, logins: DataFrame, provider: str) -> DataFrame:
    """Users (email, <provider>_id) after social logins (email, subject): known e-mails get the id, others are added."""
    column = f"{provider}_id"
    once = logins.groupBy("email").agg(F.min("subject").alias("__subject"))
    return users.join(once, "email", "full").withColumn(column, F.coalesce("__subject", column)).drop("__subject")
