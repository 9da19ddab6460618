"""Numbers, flags and coordinates out of page text; null where the text says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import strip

#: Words that count.
NUMBER_WORDS = {"a": 1, "an": 1, "the": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}


def parse_int(c: Column) -> Column:
    clean = F.regexp_replace(strip(c), "[,+%]", "")
    return F.when(clean.rlike(r"^-?\d+$"), clean.try_cast("long"))


def parse_xp(c: Column) -> Column:
    clean = F.regexp_replace(strip(c), ",", "")
    number = F.when(clean.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)$"), clean.try_cast("double"))
    return F.when(clean == "-1", F.lit(0.0)).otherwise(F.coalesce(number, F.lit(0.0)))


def parse_ticks(c: Column) -> Column:
    clean = F.replace(F.lower(strip(c)), F.lit(","))
    return F.when(clean.rlike(r"^-?\d+$"), clean.try_cast("long"))


def first_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("long")


def parse_members(c: Column) -> Column:
    """Members only unless it says no."""
    return F.when(F.lower(strip(c)) == "no", False).otherwise(True)


def parse_flag(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(low == "yes", True).when(low == "no", False)


def parse_float(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s*kg$|,", "").try_cast("double")


def parse_count(c: Column) -> Column:
    """Digits with or without thousands marks, or a number word; 1 for anything else."""
    clean = F.replace(c, F.lit(","))
    words = F.create_map(*(F.lit(x) for kv in NUMBER_WORDS.items() for x in kv))
    return F.when(clean.rlike(r"^\d+$"), clean.try_cast("int")).otherwise(F.coalesce(F.try_element_at(words, F.lower(c)), F.lit(1)))


#: The notations of a place, in the order in which they count.
PLACES = {"x": r"\|x\s*=\s*\d+", "y": r"\|y\s*=\s*\d+", "pair": r"x:\d+,y:\d+", "bare": r"\|\d{3,5},\d{3,5}"}


def coordinates(c: Column) -> Column:
    """Pairs in the first of three notations that has any: |x=..|y=.. (one pair), x:..,y:.. and |n,n (all of them)."""

    def token(said: Column) -> Column:
        kind = F.when(F.startswith(said, F.lit("|x")), "x").when(F.startswith(said, F.lit("|y")), "y").when(F.startswith(said, F.lit("x")), "pair").otherwise("bare")
        return F.struct(kind.alias("kind"), F.transform(F.regexp_extract_all(said, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int")).alias("n"))

    tokens = F.transform(F.regexp_extract_all(c, F.lit("|".join(PLACES.values())), F.lit(0)), token)
    of = lambda kind: F.filter(tokens, lambda t: t["kind"] == kind)
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    every = lambda kind: F.transform(of(kind), lambda t: place(F.get(t["n"], 0), F.get(t["n"], 1)))
    x, y = (F.get(F.get(of(k), 0)["n"], 0) for k in "xy")
    return F.when((F.size(of("x")) > 0) & (F.size(of("y")) > 0), F.array(place(x, y))).when(F.size(of("pair")) > 0, every("pair")).otherwise(every("bare"))


def skill_levels(c: Column) -> Column:
    """(skill, level) of {{SCP|Skill|Level}} marks, levels 1 to 99."""
    pattern = r"\{\{SCP\|([^|}]+)\|(\d+)[^}]*\}\}"
    zipped = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("s"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("l"))
    pairs = F.transform(zipped, lambda p: F.struct(F.lower(p["s"]).alias("skill"), p["l"].cast("int").alias("level")))
    return F.filter(pairs, lambda p: p["level"].between(1, 99))


def skills_mask(c: Column, members: dict[str, int], groups: dict[str, list[str]]) -> Column:
    """Bits of all skills named in a comma list; group names stand for their members."""
    whole = {n.lower(): m for n, m in members.items()}
    for group, names in groups.items():
        whole[group] = 0
        for n in names:
            whole[group] |= members[n]
    pairs = F.create_map(*(F.lit(x) for kv in whole.items() for x in kv))
    return F.aggregate(F.split(F.lower(c), ","), F.lit(0), lambda a, s: a.bitwiseOR(F.coalesce(F.try_element_at(pairs, strip(s)), F.lit(0))))


def region_label(c: Column, known: list[str]) -> Column:
    """The first region that a label names: of alternatives the first, of regions together the first; null for none or an unknown one."""
    plain = F.regexp_replace(c, "(?s)<!--.*?-->", "")
    first = F.lower(strip(F.substring_index(F.substring_index(plain, ",", 1), "&", 1)))
    return F.when(first.isin(known), first)


def enum_label(c: Column, labels: list[str], aliases: dict[str, str]) -> Column:
    """The label that a text is, or that it's another name of, or else the first that it holds."""
    low = F.lower(strip(c))
    exact = F.when(low.isin(labels), low)
    other = F.try_element_at(F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)), low) if aliases else F.lit(None).cast("string")
    held = F.get(F.filter(F.array(*map(F.lit, labels)), lambda x: F.contains(low, x)), 0)
    return F.coalesce(exact, other, held)
