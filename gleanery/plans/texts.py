"""Queries over page text: functions of strings, and every kind of record out of pages that hold it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import conditions, game, markup, numeric
from gleanery.operators.base import table
from gleanery.plans.registry import flat, query
from gleanery.sources import extractors

# --- strings ---------------------------------------------------------------------------------------------------------


def _text(*parts):
    return F.concat(*(F.col(p) if p.startswith(("p_", "n_")) else F.lit(p) for p in parts))


@query("select p_partkey, p_name || ' by ' || split_part(p_brand, '#', 1) as said, p_name as plain from part")
def clean_reference(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        markup.clean_reference(_text("{{PAGENAME}} by ", "p_brand", "#part"), F.col("p_name")).alias("said"),
        markup.clean_reference(_text(" ", "p_name", "{{!}}")).alias("plain"),
    )


@query("select p_partkey, replace(p_name, ' ', '_') as slug, p_name as intro, 3 as heading, p_partkey % 9 as floor, 'brand' as category, p_brand as name from part")
def page_parts(spark, sf):
    tag = markup.content_tag(_text("brand:", "p_brand"), ["brand", "type"])
    near = F.concat(F.lit("On the "), (F.col("p_partkey") % 9).cast("string"), F.lit("th floor"))
    return table(spark, sf, "part").select(
        "p_partkey",
        markup.slug(_text(" ", "p_name", " ")).alias("slug"),
        markup.intro(_text("p_name", "\n== More ==\n", "p_brand")).alias("intro"),
        markup.heading_depth(_text("=== ", "p_name", " ===")).alias("heading"),
        markup.floor_of(near).cast("long").alias("floor"),
        tag["category"].alias("category"),
        tag["name"].alias("name"),
    )


@query("select p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9])ring($|[^a-z0-9])') as ring, case when length(p_name) > 8 then p_name[:7] || '…' else p_name end as short, lpad(p_partkey::varchar, 4, '0') || repeat(' ', 4) || p_name as row from part where p_partkey < 10000")
def word_and_width(spark, sf):
    out = table(spark, sf, "part").where("p_partkey < 10000")
    return out.select("p_partkey", markup.has_word(F.col("p_name"), "ring").alias("ring"), markup.truncated(F.col("p_name"), 8).alias("short"), markup.row_text(F.col("p_partkey"), F.lit(2), _text("p_name")).substr(1, 400).alias("_r")).select("p_partkey", "ring", "short", F.concat(F.substring("_r", 1, 4), F.lit("    "), F.ltrim(F.substr("_r", F.lit(5)))).alias("row"))


@query("select p_partkey, base64(encode(p_name)) as coded, p_name as decoded, to_json([p_name, p_brand]) as list, p_brand as second, coalesce(nullif(p_size, 10), -1) as size from part")
def encodings(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.base64(F.col("p_name").cast("binary")).alias("coded"),
        F.unbase64(F.base64(F.col("p_name").cast("binary"))).cast("string").alias("decoded"),
        F.to_json(F.array("p_name", "p_brand")).alias("list"),
        F.get(F.from_json(F.to_json(F.array("p_name", "p_brand")), "array<string>"), 1).alias("second"),
        F.coalesce(F.try_element_at(F.create_map(F.lit("size"), F.nullif("p_size", F.lit(10))), F.lit("size")), F.lit(-1)).alias("size"),
    )


@query("select p_partkey, t.label, t.target from part, unnest([{'label': p_name, 'target': p_size}, {'label': p_brand, 'target': p_size + 1}]) u(t)")
def parallel_zip(spark, sf):
    pairs = F.arrays_zip(F.array("p_name", "p_brand").alias("label"), F.array("p_size", F.col("p_size") + 1).alias("target"))
    return table(spark, sf, "part").select("p_partkey", F.explode(pairs).alias("t")).select("p_partkey", "t.label", "t.target")


@query("select p_partkey, case when p_size % 3 = 0 then true when p_size % 3 = 1 then false end as flag, p_size / 2.0::double as weight, p_size % 4 <> 0 as members from part")
def flags_and_floats(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        numeric.parse_flag(F.when(size % 3 == 0, " Yes").when(size % 3 == 1, "no").otherwise("n/a")).alias("flag"),
        numeric.parse_float(F.concat((size / 2).cast("string"), F.lit(" kg"))).alias("weight"),
        numeric.parse_members(F.when(size % 4 == 0, "No").otherwise("Yes")).alias("members"),
    )


@query("select p_partkey, p_size % 99 + 1 as attack, 4 + p_size % 2 * 16 as mask from part")
def skill_marks(spark, sf):
    said = F.concat(F.lit("{{SCP|Attack|"), (F.col("p_size") % 99 + 1).cast("string"), F.lit("|link=yes}} and {{SCP|Magic|120}}"))
    mask = numeric.skills_mask(F.when(F.col("p_size") % 2 == 1, "Magic, Attack").otherwise("attack,none"), {"Attack": 4, "Magic": 16}, {"combat": ["Attack", "Magic"]})
    return table(spark, sf, "part").select("p_partkey", F.get(numeric.skill_levels(said), 0)["level"].alias("attack"), mask.alias("mask"))


@query("""select p_partkey, case when p_size % 3 = 0 then 'north' when p_size % 3 = 1 then 'south' end as region, ['easy', 'hard', 'elite', 'easy'][p_size % 4 + 1] as tier,
[10, 30, 80, 200, 400][p_size % 5 + 1] as points, [1.0, 1.5, 2.0, 2.0][p_size % 4 + 1]::double as multiplier from part""")
def labels_and_points(spark, sf):
    size = F.col("p_size")
    said = F.when(size % 3 == 0, "North<!-- x -->&South, East").when(size % 3 == 1, " south ").otherwise("n/a")
    tier = F.get(F.array(*map(F.lit, ("Easy", "HARD", "elite clue", "simple"))), size % 4)
    return table(spark, sf, "part").select(
        "p_partkey",
        numeric.region_label(said, ["north", "south", "east"]).alias("region"),
        numeric.enum_label(tier, ["easy", "hard", "elite"], {"simple": "easy"}).alias("tier"),
        game.task_points(F.get(F.array(*map(F.lit, game.TASK_POINTS)), size % 5)).alias("points"),
        game.tier_multiplier(size % 4, [1.5, 2.0]).alias("multiplier"),
    )


@query("select p_partkey, 'see ' || case when p_size % 2 = 0 then '[a](item:' || p_name || ')' else '[a](wiki:none ' || p_name || ')' end as said from part")
def typed_links(spark, sf):
    known = table(spark, sf, "part").select(F.lower("p_name").alias("name"), F.lit("item").alias("type")).distinct()
    said = F.concat(F.lit("see [a](wiki:"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("none "), F.col("p_name"))), F.lit(")"))
    return markup.typed_links(table(spark, sf, "part").select("p_partkey", said.alias("said")), "p_partkey", "said", known)


@query("select p_partkey, '* ' || p_name || chr(10) || '{{x|y=1|z}}' as body from part")
def section_extract(spark, sf):
    body = F.concat(F.lit("{{Page|intro=a|items=* "), F.col("p_name"), F.lit("\n{{x|y=1|z}}|next=b}}"))
    return table(spark, sf, "part").select("p_partkey", markup.section(body, "items").alias("body"))


@query("""select p_partkey, case p_size % 4 when 0 then 'hit' when 1 then 'valid' when 2 then 'stale' else 'miss' end as state from part""")
def cache_freshness(spark, sf):
    from gleanery.sources import readers

    size, title = F.col("p_size"), F.col("p_partkey").cast("string").alias("title")
    part = table(spark, sf, "part")
    cache = part.where("p_size % 4 < 3").select(title, F.when(size % 4 == 0, F.lit("2024-01-02 11:00:00")).otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp").alias("fetched_at"), F.lit(5).alias("revid"))
    revisions = part.select(title, F.when(size % 4 == 1, 5).otherwise(6).alias("revid"))
    return readers.freshness(cache, part.select(title), "2024-01-02 12:00:00", 86_400, revisions).select(F.col("title").cast("long").alias("p_partkey"), "state")


@query("select p_partkey, ['the player does not have ', 'the player''s ', 'the player cannot see ', 'see '][p_size % 4 + 1] || '{item}' as said from part where p_name = 'red ring' or p_name = 'blue bolt'")
def condition_slots(spark, sf):
    said = F.concat(F.get(F.array(*map(F.lit, ("You don't  have ", "Your ", "you can't see ", "See "))), F.col("p_size") % 4), F.col("p_name"), F.lit("."))
    rows = table(spark, sf, "part").where("p_name in ('red ring', 'blue bolt')").select("p_partkey", said.alias("said"))
    return conditions.normalised(rows, "p_partkey", "said", {"red ring": "item", "blue bolt": "item"}).select("p_partkey", "said")


# --- records ---------------------------------------------------------------------------------------------------------

#: A parameter's text and the value that it means, by kind, over part: Spark and SQL.
_KINDS = {
    "text": (lambda: F.concat(F.lit("'''"), F.col("p_name"), F.lit("'''<ref>x</ref>")), "p_name"),
    "name": (lambda: F.concat(F.lit("[["), F.col("p_name"), F.lit("#x"), F.lit("|shown]]")), "p_name || '#x'"),
    "int": (lambda: F.concat(F.col("p_size").cast("string"), F.lit(",000")), "p_size::bigint * 1000"),
    "float": (lambda: F.concat((F.col("p_size") / 4).cast("string"), F.lit("kg")), "(p_size / 4.0)::double"),
    "xp": (lambda: (F.col("p_size") / 2).cast("string"), "(p_size / 2.0)::double"),
    "ticks": (lambda: F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("Varies"), "case when p_size % 2 = 0 then p_size::bigint end"),
    "members": (lambda: F.when(F.col("p_size") % 2 == 0, "No").otherwise("Yes"), "p_size % 2 <> 0"),
    "flag": (lambda: F.when(F.col("p_size") % 2 == 0, "No").otherwise("Yes"), "p_size % 2 <> 0"),
    "raw": (lambda: F.concat(F.lit("3 {{plink|"), F.col("p_name"), F.lit("}}")), "'3 {{plink|' || p_name || '}}'"),
    "list": (lambda: F.concat(F.col("p_brand"), F.lit(", [["), F.col("p_name"), F.lit("]]")), "p_brand || ',' || p_name"),
    "skills": (lambda: F.concat(F.lit("{{SCP|Attack|"), (F.col("p_size") % 99 + 1).cast("string"), F.lit("}}")), "'attack:' || (p_size % 99 + 1)"),
}


def _record_sql(record: extractors.Record) -> str:
    kinds, said = {}, ["p_partkey::varchar as title", "0 as position"]
    for parameter, kind in record.columns.values():
        kinds.setdefault(parameter, kind)
    said.append("v::varchar as version" if record.versions else "null::varchar as version")
    for column, (parameter, kind) in record.columns.items():
        said.append(f'{_KINDS[kind][1]} as "{column}"' if kinds[parameter] == kind else f"null as {column}")
    said += [f"p_partkey || ',' || (p_partkey + 1) as {n}s" for n in record.numbered]
    if record.coordinates:
        said.append("(p_partkey % 1000) || ':' || p_size as coordinates")
    rows = "part, (values ('one'), ('two')) t(v)" if record.versions else "part"
    return f"select {', '.join(said)} from {rows}"


def _record_pages(part, record: extractors.Record):
    body = [F.lit(f"{{{{{record.templates[0]}")]
    done = set()
    for parameter, kind in record.columns.values():
        if parameter not in done:
            done.add(parameter)
            body += [F.lit(f"|{parameter} = "), _KINDS[kind][0](), F.lit("\n")]
    for n in record.numbered:
        body += [F.lit(f"|{n}1 = "), F.col("p_partkey").cast("string"), F.lit(f"|{n}2 = "), (F.col("p_partkey") + 1).cast("string")]
    if record.versions:
        body.append(F.lit("|version1 = one|version2 = two"))
    if record.coordinates:
        body += [F.lit("|x:"), (F.col("p_partkey") % 1000).cast("string"), F.lit(",y:"), F.col("p_size").cast("string")]
    return part.select(F.col("p_partkey").cast("string").alias("title"), F.concat(F.lit("before "), *body, F.lit("}} after")).alias("wikitext"))


def _register(kind: str) -> None:
    record = extractors.RECORDS[kind]
    mixed = {p: k for p, k in record.columns.values()}
    if any(mixed[p] != k for p, k in record.columns.values()):  # one parameter read in two ways: its text can't be made for both
        record = extractors.Record(record.templates, {c: (p, k) for c, (p, k) in record.columns.items() if mixed[p] == k}, record.versions, record.coordinates, record.numbered)

    def run(spark, sf):
        return flat(extractors.extract(_record_pages(table(spark, sf, "part"), record), record))

    run.__name__ = f"records_{kind}"
    query(_record_sql(record))(run)


for _kind in extractors.RECORDS:
    _register(_kind)


@query("select p_partkey::varchar as title, p_name as rune, p_size as count from part")
def rune_costs(spark, sf):
    cost = F.concat(F.col("p_size").cast("string"), F.lit("{{plink|"), F.col("p_name"), F.lit("|pic=x}} and no more"))
    return extractors.rune_costs(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("title"), cost.alias("cost")))


@query("select p_partkey::varchar as title, 'attack' as skill, p_size % 99 + 1 as level from part")
def skill_requirements(spark, sf):
    marks = numeric.skill_levels(_KINDS["skills"][0]())
    return extractors.requirement_rows(table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("title"), marks.alias("skills")))


@query("select min(p_partkey) as id, 'base ' || (p_partkey % 50) as alias from part group by 2")
def base_names(spark, sf):
    key = F.col("p_partkey")
    return extractors.base_names(table(spark, sf, "part").select(key.alias("id"), F.concat(F.lit("base "), (key % 50).cast("string"), F.lit(" ("), F.col("p_brand"), F.lit(")")).alias("name")))


@query("select p_partkey::varchar as name, t as tag from part, (values ('ring'), ('bolt')) v(t) where p_size % 2 = 0 or t = 'ring'")
def classifier_answers(spark, sf):
    answer = F.concat(F.lit("no line\n"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, " | Ring, bolt, what").otherwise(" | ring,"))
    known = spark.createDataFrame([("ring",), ("bolt",)], "tag string")
    return extractors.classifier_rows(table(spark, sf, "part").select(answer.alias("answer")), "answer", known)[0]


@query("select p_partkey::varchar as name, case p_size % 4 when 0 then 'redring' when 1 then 'red_ring' when 2 then 'bolts' end as tag from part where p_size % 4 < 3")
def tag_matches(spark, sf):
    said = F.get(F.array(*map(F.lit, ("redring", "red ring", "bol", "zz"))), F.col("p_size") % 4)
    known = spark.createDataFrame([("red_ring",), ("redring",), ("bolts",)], "tag string")
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), F.when(said == "bol", "some bolts").otherwise(said).alias("tag"))
    return extractors.matched_tags(rows, known)
