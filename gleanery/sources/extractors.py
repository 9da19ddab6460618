"""Typed rows out of page text: one table of specifications, one plan for all of them.

A specification names the templates that carry a record and, for each column, the parameter and its type. Infoboxes may hold
several versions (version1, version2 …): each gives a row, a parameter without a number standing for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import markup, numeric

PARSERS = {
    "text": lambda c: F.nullif(markup.strip_markup(markup.strip_refs(c)), F.lit("")),
    "name": lambda c: F.nullif(markup.strip(markup.strip_links(markup.strip_plinks(c))), F.lit("")),
    "int": numeric.parse_int,
    "float": numeric.parse_float,
    "xp": numeric.parse_xp,
    "ticks": numeric.parse_ticks,
    "members": numeric.parse_members,
    "flag": numeric.parse_flag,
    "raw": lambda c: c,
    "list": lambda c: F.filter(F.transform(F.split(markup.strip_markup(c), ","), markup.strip), lambda s: s != ""),
    "skills": numeric.skill_levels,
}


@dataclass(frozen=True)
class Record:
    templates: tuple[str, ...]
    columns: dict[str, tuple[str, str]] = field(default_factory=dict)  # column: (parameter, parser)
    versions: bool = False
    coordinates: bool = False
    numbered: tuple[str, ...] = ()  # parameters that come alone and as id1, id2 …: gathered in one array


def _each(kind: str, *names: str) -> dict[str, tuple[str, str]]:
    return {n: (n, kind) for n in names}


#: Template names and parameters of the pages' records.
RECORDS = {
    "item": Record(("Infobox Item",), _each("text", "name", "examine") | _each("members", "members") | _each("flag", "tradeable") | _each("float", "weight") | _each("int", "value"), numbered=("id",)),
    "monster": Record(
        ("Infobox Monster",),
        _each("text", "name", "examine", "attributes") | {"combat_level": ("combat", "int"), "hitpoints": ("hitpoints", "int"), "attack_speed": ("attack speed", "ticks"), "max_hit": ("max hit", "text"), "attack_style": ("attack style", "text"), "slayer_xp": ("slayxp", "xp"), "slayer_category": ("cat", "text"), "aggressive": ("aggressive", "flag"), "members": ("members", "members")}
        | {f"{n}_level": (p, "int") for n, p in (("attack", "att"), ("strength", "str"), ("defence", "def"), ("magic", "mage"), ("ranged", "range"))} | _each("int", "size", "respawn"),
        versions=True, numbered=("id",),
    ),
    "equipment": Record(("Infobox Bonuses",), {"slot": ("slot", "text"), "speed": ("speed", "ticks"), "attack_range": ("attackrange", "int"), "combat_style": ("combatstyle", "text")} | {f"attack_{n}": (f"a{n}", "int") for n in ("stab", "slash", "crush", "magic", "range")} | {f"defence_{n}": (f"d{n}", "int") for n in ("stab", "slash", "crush", "magic", "range")} | {"melee_strength": ("str", "int"), "ranged_strength": ("rstr", "int"), "magic_damage": ("mdmg", "int"), "prayer": ("prayer", "int")}, versions=True),
    "npc": Record(("Infobox NPC",), _each("text", "name", "location", "options"), versions=True, coordinates=True, numbered=("id",)),
    "shop": Record(("Infobox Shop",), _each("text", "name", "location", "owner", "special") | _each("members", "members")),
    "store_head": Record(("StoreTableHead",), {"sell_multiplier": ("sellmultiplier", "int"), "buy_multiplier": ("buymultiplier", "int"), "delta": ("delta", "int"), "currency": ("currency", "text")}),
    "store_line": Record(("StoreLine",), {"item_name": ("name", "name"), "stock": ("stock", "raw"), "restock": ("restock", "int"), "sell_price": ("sell", "int"), "buy_price": ("buy", "int")}),
    "drop": Record(("DropsLine", "DropsLineClue"), {"item_name": ("name", "name"), "quantity": ("quantity", "raw"), "rarity": ("rarity", "raw")}),
    "spawn": Record(("LocLine",), {"name": ("name", "name"), "location": ("location", "name"), "levels": ("levels", "text"), "members": ("mem", "members")}, coordinates=True),
    "ground_item": Record(("ItemSpawnLine",), {"item_name": ("name", "name"), "location": ("location", "name"), "members": ("members", "members"), "plane": ("plane", "int")}, coordinates=True),
    "object": Record(("ObjectLocLine",), {"name": ("name", "name"), "location": ("location", "name")}, coordinates=True),
    "location": Record(("Infobox Location",), _each("text", "name", "type") | _each("members", "members"), coordinates=True),
    "adjacency": Record(("Adjacent locations", "Map relative location"), {d: (d, "name") for d in ("north", "east", "south", "west", "northeast", "southeast", "southwest", "northwest")}),
    "activity": Record(("Infobox Activity",), _each("text", "name", "type", "location", "players") | {"skills": ("skills", "list"), "members": ("members", "members")}, coordinates=True),
    "spell": Record(("Infobox Spell",), _each("text", "name", "element", "type") | {"level": ("level", "int"), "xp": ("exp", "xp"), "speed": ("speed", "ticks"), "members": ("members", "members"), "cost": ("cost", "raw")}),
    "rune_cost": Record(("RuneReq",), {n: (n, "int") for n in ("Air", "Water", "Earth", "Fire", "Mind", "Body", "Chaos", "Cosmic", "Nature", "Law", "Death", "Blood", "Soul", "Astral", "Wrath")}),
    "quest": Record(("Quest rewards",), {"points": ("qp", "int"), "rewards": ("rewards", "raw")}),
    "quest_details": Record(("Quest details",), {"requirements": ("requirements", "raw"), "skills": ("requirements", "skills"), "items": ("items", "raw")}),
    "league_task": Record(("DPLTaskRow", "TRELTaskRow", "LeagueTaskRow"), {"name": ("name", "name"), "description": ("desc", "text"), "difficulty": ("tier", "text"), "region": ("region", "text"), "skills": ("s", "skills")}),
    "game_variable": Record(("Infobox Var",), {"name": ("name", "text"), "var_id": ("index", "int"), "var_type": ("type", "text"), "content": ("content", "text")}),
}

def extract(pages: DataFrame, record: Record | str, text: str = "wikitext") -> DataFrame:
    """title, position among the page's templates, version (null for a page without), and the record's columns.

    One Arrow call finds the templates; all parsing after it is expressions.
    """
    record = RECORDS[record] if isinstance(record, str) else record
    found = None
    for name in record.templates:
        rows = pages.select("title", F.posexplode(markup.template_rows(text, F.lit(name))).alias("position", "t"))
        found = rows if found is None else found.unionByName(rows)
    found = found.select("title", "position", F.col("t.named").alias("named"), F.col("t.positional").alias("positional"))
    get = lambda key: F.try_element_at("named", key)
    if record.versions:
        said = F.regexp_extract_all(F.array_join(F.map_keys("named"), "\n"), F.lit(r"(?m)^version([1-9]\d{0,8})$"), F.lit(1))
        numbers = F.array_sort(F.transform(said, lambda k: k.cast("int")))
        found = found.withColumn("number", F.explode_outer(numbers))
        own = lambda key: F.coalesce(get(F.concat(F.lit(key), F.col("number").cast("string"))), get(F.lit(key)))
        version = get(F.concat(F.lit("version"), F.col("number").cast("string")))
    else:
        own, version = (lambda key: get(F.lit(key))), F.lit(None).cast("string")
    out: list[Column] = ["title", "position", version.alias("version")]
    for column, (key, kind) in record.columns.items():
        out.append(PARSERS[kind](own(key)).alias(column))
    for key in record.numbered:
        keys = F.filter(F.map_keys("named"), lambda k: k.rlike(rf"^{key}\d*$"))
        values = F.flatten(F.transform(keys, lambda k: F.split(F.try_element_at("named", k), r"\s*,\s*")))
        out.append(F.array_sort(F.filter(F.transform(values, numeric.parse_int), lambda v: v.isNotNull())).alias(f"{key}s"))
    if record.coordinates:
        said = F.concat_ws("", F.lit("|"), F.array_join("positional", "|"), F.concat(F.lit("|x="), get(F.lit("x"))), F.concat(F.lit("|y="), get(F.lit("y"))), F.concat(F.lit("|"), get(F.lit("map"))))
        out.append(numeric.coordinates(said).alias("coordinates"))
    return found.select(*out)


def requirement_rows(quests: DataFrame) -> DataFrame:
    """title, skill, level out of a quest's or task's skill marks."""
    return quests.select("title", F.explode("skills").alias("s")).select("title", "s.skill", "s.level")


def rune_costs(spells: DataFrame) -> DataFrame:
    """title, rune, count of spells' costs: counts stand before {{plink}}s or in rune parameters."""
    pattern = r"(\d+)\s*\{\{[Pp]link\|([^}|]+)"
    pairs = F.arrays_zip(F.regexp_extract_all("cost", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("cost", F.lit(pattern), F.lit(2)).alias("rune"))
    return spells.select("title", F.explode(pairs).alias("p")).select("title", F.col("p.rune").alias("rune"), F.col("p.n").cast("int").alias("count"))


def base_names(names: DataFrame) -> DataFrame:
    """(id, alias) of the part before brackets of `Name (variant)`: four characters at least, no name itself, the least id first."""
    base = markup.strip(F.regexp_extract("name", r"^(.*?)\s*\([^()]*\)$", 1))
    found = names.select("id", base.alias("alias")).where(F.char_length("alias") >= 4)
    return found.join(names.select(F.col("name").alias("alias")), "alias", "left_anti").groupBy("alias").agg(F.min("id").alias("id")).select("id", "alias")


def classifier_rows(response: DataFrame, text: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines `name | tag, tag` of a classifier's answer: rows (name, tag) of known tags, and the unknown ones."""
    lines = response.select(F.explode(F.split(text, "\n")).alias("line")).where(F.contains("line", F.lit("|")))
    parts = F.split("line", r"\|", 2)
    rows = lines.select(markup.strip(F.get(parts, 0)).alias("name"), F.explode(F.split(F.get(parts, 1), ",")).alias("tag")).withColumn("tag", F.lower(markup.strip(F.col("tag")))).where("tag != ''")
    return rows.join(known, "tag", "left_semi").select("name", "tag"), rows.join(known, "tag", "left_anti").select("name", "tag")


def matched_tags(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(name, tag) with the known tag that a tag is, or is but for spaces and underscores, or (above three letters) holds or is part of; the first
    in order, exact ones before others. known: a vocabulary, one column."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[ _]", "")
    words = known.toDF("_known").withColumn("_plain", plain(F.col("_known")))
    asked = rows.select("tag").distinct().withColumn("_said", plain(F.col("tag")))
    part = (F.char_length("_said") > 3) & (F.char_length("_plain") > 3) & (F.contains("_said", "_plain") | F.contains("_plain", "_said"))
    rank = F.when(F.col("_known") == F.col("tag"), 0).when(F.lower("tag") == F.col("_known"), 1).when(F.regexp_replace(F.lower("tag"), " ", "_") == F.col("_known"), 2).when(F.col("_plain") == F.col("_said"), 3).when(part, 4)
    met = asked.crossJoin(F.broadcast(words)).withColumn("_rank", rank).where("_rank is not null")
    best = met.groupBy("tag").agg(F.min_by("_known", F.struct("_rank", "_known")).alias("_best"))
    return rows.join(best, "tag").select("name", F.col("_best").alias("tag"))


def page_ids(pages: DataFrame, kinds: tuple[str, ...] = ("item", "monster", "npc"), text: str = "wikitext") -> DataFrame:
    """title, kind, id: all game ids that a page's infoboxes name, by their kind."""
    out = None
    for kind in kinds:
        rows = extract(pages, kind, text).select("title", F.lit(kind).alias("kind"), F.explode("ids").alias("id")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def linked_items(c: Column) -> Column:
    """Names that a list of items links to, plain links and picture links alike, in order and once each."""
    found = F.regexp_extract_all(c, F.lit(r"(?:\[\[|\{\{[Pp]link\|)([^\]|}#]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, markup.strip))


def region_mask(candidates: list[Column], regions: dict[str, int]) -> Column:
    """Bits of the regions that the first candidate which names any names (lists of labels); 0 for none."""
    pairs = F.create_map(*(F.lit(x) for kv in regions.items() for x in kv))
    masks = [F.aggregate(c, F.lit(0), lambda a, r: a.bitwiseOR(F.coalesce(F.try_element_at(pairs, F.lower(r)), F.lit(0)))) for c in candidates]
    return F.coalesce(*(F.nullif(m, F.lit(0)) for m in masks), F.lit(0))


def category_pages(categories: DataFrame, members: DataFrame) -> DataFrame:
    """category, pages: the pages that are in it themselves: all that it lists less its subcategories, not below 0. categories: category, listed.
    members: category, page, of subcategories."""
    below = members.groupBy("category").agg(F.count("*").alias("below"))
    left = categories.join(below, "category", "left")
    return left.select("category", F.greatest(F.col("listed") - F.coalesce("below", F.lit(0)), F.lit(0)).alias("pages"))
