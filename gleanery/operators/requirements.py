"""Requirement groups (AND of ORs) and what an account can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare(left: Column, op: Column, right: Column) -> Column:
    """A comparison whose operator is data."""
    return (
        F.when(op == ">=", left >= right).when(op == "<=", left <= right).when(op == ">", left > right)
        .when(op == "<", left < right).when(op == "==", left == right).when(op == "!=", left != right)
    )


def satisfied(members: DataFrame, entity: str, group: str, met: Column) -> DataFrame:
    """Whether each entity meets all of its groups, a group being met by any member."""
    groups = members.groupBy(entity, group).agg(F.bool_or(F.coalesce(met, F.lit(False))).alias("met"))
    return groups.groupBy(entity).agg(F.bool_and("met").alias("available"), F.count_if(~F.col("met")).alias("unmet_groups"))


def available_flat(entities: DataFrame, members: DataFrame, entity: str, met: Column) -> DataFrame:
    """Entities with no unmet member: grouping is ignored, so every member must be met."""
    unmet = members.where(~F.coalesce(met, F.lit(False))).select(entity).distinct()
    return entities.join(unmet, entity, "left_anti")


def levels_after(actions: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Fold of experience gains: per account and skill the total and the level reached (account, skill, amount)."""
    total = actions.groupBy("account", "skill").agg(F.sum("amount").alias("xp"))
    met = total.join(F.broadcast(thresholds), F.col("xp") >= F.col("needs"), "left")
    return met.groupBy("account", "skill", "xp").agg(F.coalesce(F.max("level"), F.lit(1)).alias("level"))


#: The kinds of a group's members, with what names the thing, what's needed of it, and whether it says how to compare.
MEMBER_KINDS = {
    "skill": ("skill", "level", True),
    "quest": ("required_quest_id", None, False),
    "quest_points": (None, "points", True),
    "item": ("item_id", "quantity", True),
    "diary": ("diary", None, False),
    "region": ("region", None, False),
    "equipment": ("item_id", "quantity", True),
    "varbit": ("var_id", "value", True),
    "varp": ("var_id", "value", True),
}


def typed_members(tables: dict[str, DataFrame]) -> DataFrame:
    """group_id, kind, key, operator, needed of all members, one table for each kind. What only has to be there needs 1."""
    out = None
    for kind, rows in tables.items():
        key, needed, says = MEMBER_KINDS[kind]
        rows = rows.select(
            "group_id",
            F.lit(kind).alias("kind"),
            (F.col(key).cast("long") if key else F.lit(0).cast("long")).alias("key"),
            (F.col("operator") if says else F.lit(">=")).alias("operator"),
            (F.col(needed).cast("long") if needed else F.lit(1).cast("long")).alias("needed"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def groups_of(parents: DataFrame, kind: str, entity: int) -> DataFrame:
    """Groups of one entity, of any of the kinds that have some. parents: entity_kind, entity_id, group_id."""
    return parents.where((F.col("entity_kind") == kind) & (F.col("entity_id") == entity)).select("group_id")


def met_by(members: DataFrame, state: DataFrame) -> DataFrame:
    """The members with met: whether an account's state (kind, key, have) fulfils them; what it doesn't name is 0."""
    both = members.join(state, ["kind", "key"], "left")
    return both.withColumn("met", compare(F.coalesce("have", F.lit(0)), F.col("operator"), F.col("needed"))).drop("have")


def with_new_groups(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """The links (entity_id, group_id) with a new group for every wanted row (entity_id, request): never an old one. Groups are numbered
    by request, entities in one task apiece."""
    top = links.agg(F.coalesce(F.max("group_id"), F.lit(0)).alias("top"))
    sizes = wanted.groupBy("entity_id").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.sum("n").over(Window.orderBy("entity_id").rowsBetween(Window.unboundedPreceding, -1)))
    own = wanted.withColumn("place", F.row_number().over(Window.partitionBy("entity_id").orderBy("request")))
    fresh = own.join(base, "entity_id").crossJoin(F.broadcast(top))
    return links.select("entity_id", "group_id").unionByName(fresh.select("entity_id", (F.col("top") + F.coalesce("base", F.lit(0)) + F.col("place")).cast("long").alias("group_id")))
