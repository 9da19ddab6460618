"""Accounts as folds over their actions: quests with their prerequisites, points, unlocks, rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import checkpointed


def completed(actions: DataFrame, needs: DataFrame) -> DataFrame:
    """account, quest, at: what each account has done, prerequisites included, with the first action (seq) that implies it.
    actions: account, quest, seq. needs: quest, required."""
    done = frontier = checkpointed(actions.groupBy("account", "quest").agg(F.min("seq").alias("at")))
    needs = needs.select("quest", "required").distinct()
    while not frontier.isEmpty():
        met = frontier.join(needs, "quest").groupBy("account", F.col("required").alias("quest")).agg(F.min("at").alias("at"))
        known = done.withColumnRenamed("at", "was")
        frontier = checkpointed(met.join(known, ["account", "quest"], "left").where("was is null or at < was").drop("was"))
        done = checkpointed(done.unionByName(frontier).groupBy("account", "quest").agg(F.min("at").alias("at")))
    return done


def points(done: DataFrame, quests: DataFrame) -> DataFrame:
    """Quest points of each account."""
    return done.join(quests, "quest").groupBy("account").agg(F.sum("points").cast("long").alias("points"))


def unlocked(actions: DataFrame, always: list[int], most: int) -> DataFrame:
    """account, region: regions open from the start, and the first `most` others in order of unlocking."""
    w = Window.partitionBy("account").orderBy("seq", "region")
    first = actions.where(~F.col("region").isin(always)).groupBy("account", "region").agg(F.min("seq").alias("seq"))
    picked = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("account", "region")
    start = actions.select("account").distinct().withColumn("region", F.explode(F.array(*map(F.lit, always))))
    return picked.unionByName(start)


def rewards(done: DataFrame, fixed: DataFrame, chosen: DataFrame, eligible: DataFrame) -> DataFrame:
    """account, skill, xp: rewards of one skill go to it, lamps to the skill an account chose. A choice that isn't eligible is an
    error. fixed: quest, skill, amount; chosen: account, quest, skill; eligible: quest, mask, amount, with skills as bits."""
    single = done.join(fixed, "quest").select("account", "skill", "amount")
    lamp = done.join(eligible, "quest").join(chosen, ["account", "quest"])
    allowed = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("skill").cast("int"))) != 0
    refused = F.raise_error(F.concat(F.lit("not eligible: skill "), F.col("skill").cast("string"))).cast("long")
    lamp = lamp.select("account", "skill", F.when(allowed, F.col("amount").cast("long")).otherwise(refused).alias("amount"))
    return single.unionByName(lamp).groupBy("account", "skill").agg(F.sum("amount").cast("long").alias("xp"))
