"""Experience, combat, shop prices and ticks."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Experience of each style for a point of damage, hitpoints besides.
HITPOINTS_RATE = 1.33
STYLE_RATES = {
    "melee_accurate": {"attack": 4.0},
    "melee_aggressive": {"strength": 4.0},
    "melee_defensive": {"defence": 4.0},
    "melee_controlled": {"attack": 1.33, "strength": 1.33, "defence": 1.33},
    "ranged_accurate": {"ranged": 4.0},
    "ranged_rapid": {"ranged": 4.0},
    "ranged_longrange": {"ranged": 2.0, "defence": 2.0},
    "magic_standard": {"magic": 2.0},
    "magic_defensive": {"magic": 1.33, "defence": 1.0},
}


def thresholds() -> list[int]:
    """Least experience of levels 1 to 99."""
    return [0, *(p // 4 for p in accumulate(math.floor(n + 300 * 2 ** (n / 7)) for n in range(1, 99)))]


def experience_table(spark: SparkSession) -> DataFrame:
    """level, xp: running sums over 98 rows."""
    steps = spark.range(1, 99).select((F.col("id") + 1).cast("int").alias("level"), F.floor(F.col("id") + 300 * F.pow(F.lit(2.0), F.col("id") / 7.0)).cast("long").alias("step"))
    w = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select("level", F.floor(F.sum("step").over(w) / 4).cast("long").alias("xp"))
    return spark.range(1).select(F.lit(1).alias("level"), F.lit(0).cast("long").alias("xp")).unionByName(summed)


def level_for_xp(xp: Column) -> Column:
    """Highest level reached; 1 below every threshold."""
    table = F.array(*map(F.lit, thresholds()))
    return F.greatest(F.lit(1), F.size(F.filter(table, lambda t: t <= xp)))


def xp_for_level(level: Column) -> Column:
    """Raises outside 1 to 99."""
    table = F.array(*map(F.lit, thresholds()))
    return F.when(level.between(1, 99), F.get(table, level - 1)).otherwise(F.raise_error(F.lit("a level is 1 to 99")).cast("int"))


def combat_level(attack: Column, strength: Column, defence: Column, hitpoints: Column, ranged: Column, magic: Column, prayer: Column) -> Column:
    base = (defence + hitpoints + F.floor(prayer / 2)) / 4
    shot = lambda skill: F.lit(13 / 40) * F.floor(3 * skill / 2)
    return F.floor(base + F.greatest(F.lit(13 / 40) * (attack + strength), shot(ranged), shot(magic))).cast("int")


def combat_xp(hits: DataFrame) -> DataFrame:
    """skill totals of hits (style, damage, spell_xp): rates joined, spells' own experience to magic styles alone."""
    spark = hits.sparkSession
    rows = [(style, skill, rate) for style, r in STYLE_RATES.items() for skill, rate in [*r.items(), ("hitpoints", HITPOINTS_RATE)]]
    rates = F.broadcast(spark.createDataFrame(rows, "style string, skill string, rate double"))
    spell = F.when(F.col("style").startswith("magic_") & (F.col("skill") == "magic"), F.coalesce("spell_xp", F.lit(0.0))).otherwise(0.0)
    return hits.join(rates, "style").groupBy("style", "skill").agg(F.sum(F.col("damage") * F.col("rate") + spell).alias("xp"))


def sell_price(override: Column, value: Column, multiplier: Column) -> Column:
    return F.coalesce(override, F.greatest(F.floor(value * multiplier / 1000), F.lit(1)).cast("long"))


def buy_price(override: Column, value: Column, multiplier: Column) -> Column:
    return F.coalesce(override, F.greatest(F.floor(value * multiplier / 1000), F.floor(value / 10)).cast("long"))


def tier_multiplier(tier: Column, multipliers: list[float]) -> Column:
    """The tier's multiplier, the last one beyond the list, 1 at tier 0."""
    table = F.array(*map(F.lit, multipliers))
    return F.when(tier <= 0, F.lit(1.0)).otherwise(F.get(table, F.least(tier, F.lit(len(multipliers))) - 1))


def ticks(seconds: Column) -> Column:
    return F.ceil(F.round(seconds / 0.6, 9)).cast("long")


#: Points of a league task by its difficulty.
TASK_POINTS = {"easy": 10, "medium": 30, "hard": 80, "elite": 200, "master": 400}


def task_points(difficulty: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in TASK_POINTS.items() for x in kv)), F.lower(difficulty))


def diary_rewards(df: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what the rates (a fixed table by place and tier) give for their keys; rows that it doesn't name go."""
    return df.join(F.broadcast(rates), keys)
