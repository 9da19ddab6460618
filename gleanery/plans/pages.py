"""Queries over whole pages and tiles: tables, trees, files, walls, walks, batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanery.cluster import shared_folder
from gleanery.functions import dialogue, game, markup
from gleanery.operators import spatial
from gleanery.operators.base import table
from gleanery.plans import catalogue
from gleanery.plans.registry import query
from gleanery.sources import extractors, readers
from gleanery.streaming import events as streams


def _part(spark, sf):
    return table(spark, sf, "part")


@query("select p_partkey, r, c, cell from (select p_partkey, unnest([0, 0, 1, 1]) as r, unnest([0, 1, 0, 1]) as c, unnest([p_name, p_size::varchar, '[[' || p_brand || ']]', 'x']) as cell from part)")
def wiki_table_cells(spark, sf):
    text = F.concat(F.lit('{| class="t"\n! A !! B\n|-\n|'), F.col("p_name"), F.lit(" || "), F.col("p_size").cast("string"), F.lit("\n|- valign=top\n| [["), F.col("p_brand"), F.lit("]]\n| x\n|}\n|after"))
    rows = _part(spark, sf).select("p_partkey", F.posexplode(markup.table_rows(text)).alias("r", "cells"))
    return rows.select("p_partkey", "r", F.posexplode("cells").alias("c", "cell"))


@query("select p_partkey, r, c, cell from (select p_partkey, unnest([0, 0, 1]) as r, unnest([0, 1, 0]) as c, unnest([p_name, p_size::varchar, 'b & ' || p_brand]) as cell from part)")
def html_table_cells(spark, sf):
    text = F.concat(F.lit("<table><tr><th>A</th></tr><tr><td><b>"), F.col("p_name"), F.lit("</b></td><td>"), F.col("p_size").cast("string"), F.lit("</td></tr><tr><td>b &amp; "), F.col("p_brand"), F.lit("</td></tr></table><p>z</p>"))
    rows = _part(spark, sf).select("p_partkey", F.posexplode(markup.html_rows(text)).alias("r", "cells"))
    return rows.select("p_partkey", "r", F.posexplode("cells").alias("c", "cell"))


@query("select title, kind, id from (select p_partkey::varchar as title, unnest(['item', 'item', 'npc']) as kind, unnest([p_partkey, p_partkey + 5, p_size]) as id from part)")
def page_ids(spark, sf):
    key = F.col("p_partkey")
    text = F.concat(F.lit("{{Infobox Item|id1="), key.cast("string"), F.lit("|id2="), (key + 5).cast("string"), F.lit("}}{{Infobox NPC|id="), F.col("p_size").cast("string"), F.lit("}}"))
    return extractors.page_ids(_part(spark, sf).select(key.cast("string").alias("title"), text.alias("wikitext")))


@query("select p_partkey, p_name || ',' || p_brand as items from part")
def linked_items(spark, sf):
    said = F.concat(F.lit("1 [["), F.col("p_name"), F.lit("|x]], {{plink|"), F.split_part(F.col("p_brand"), F.lit("#"), F.lit(1)), F.lit("}} [["), F.col("p_name"), F.lit("]]"))
    return _part(spark, sf).select("p_partkey", F.concat(F.array_join(extractors.linked_items(said), ","), F.lit("#"), F.split_part(F.col("p_brand"), F.lit("#"), F.lit(2))).alias("items"))


@query("select p_partkey, case p_size % 3 when 0 then 3 when 1 then 4 else 0 end as mask from part")
def region_masks(spark, sf):
    size = F.col("p_size")
    first = F.when(size % 3 == 0, F.array(F.lit("North"), F.lit("south"))).otherwise(F.array(F.lit("?")))
    second = F.when(size % 3 != 2, F.array(F.lit("east"))).otherwise(F.array().cast("array<string>"))
    return _part(spark, sf).select("p_partkey", extractors.region_mask([first, second], {"north": 1, "south": 2, "east": 4}).alias("mask"))


@query("select n_regionkey as category, greatest(4 - count(*) filter (where n_nationkey % 2 = 0), 0) as pages from nation group by 1")
def category_pages(spark, sf):
    nation = table(spark, sf, "nation")
    listed = nation.select(F.col("n_regionkey").alias("category")).distinct().withColumn("listed", F.lit(4).cast("long"))
    below = nation.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("category"), F.col("n_name").alias("page"))
    return extractors.category_pages(listed, below)


@query("select p_partkey, ['A / B', 'C'][1 + p_size % 2] as section, p_size % 2 as sort_order from part")
def section_paths(spark, sf):
    odd = F.col("p_size") % 2 == 1
    text = F.when(odd, F.lit("= A =\n== B ==\n* one\n= C =\n* two")).otherwise(F.lit("= A =\n== B ==\n* one"))
    nodes = dialogue.trees(_part(spark, sf).select(F.col("p_partkey").alias("page_id"), text.alias("wikitext")))
    last = nodes.groupBy(F.col("page_id").alias("p_partkey")).agg(F.max(F.struct("sort_order", "section")).alias("n"))
    return last.select("p_partkey", "n.section", "n.sort_order")


@query("""with t as (select conv_id as page_id, role, turn, row_number() over (partition by conv_id order by turn) - 1 as id from conversations), n as (select page_id, count(*) as n from t group by 1),
s(k, up, depth, kind, text) as (values (0, null, 1, 'select', 'Pick'), (1, null, 1, 'option', 'Yes'), (2, 1, 2, 'line', repeat(chr(39), 3) || 'Player:' || repeat(chr(39), 3) || ' Yes'), (3, 1, 2, 'condition', 'has item'),
(4, 3, 3, 'line', repeat(chr(39), 3) || 'Guide:' || repeat(chr(39), 3) || ' Here.'), (5, null, 1, 'option', 'No'), (6, 5, 2, 'line', repeat(chr(39), 3) || 'Player:' || repeat(chr(39), 3) || ' No'), (7, null, 1, 'action', 'end'))
select page_id, id::int as id, null::int as parent_id, id::int as sort_order, 1 as depth, 'line' as node_type, repeat(chr(39), 3) || case role when 'user' then 'Player' else 'Guide' end || ':' || repeat(chr(39), 3) || ' Turn ' || turn as text, null as section from t
union all select page_id, (n + k)::int, (n + up)::int, (n + k)::int, depth, kind, text, 'Choice' from n, s""")
def tree_nodes(spark, sf):
    return dialogue.trees(catalogue._transcripts(spark, sf))


@query("select n_nationkey as id, n_name as name, n_regionkey as region from nation")
def json_array_rows(spark, sf):
    row = F.to_json(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")))
    whole = table(spark, sf, "nation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value"))
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    whole.coalesce(1).write.text(path)
    return readers.json_rows(spark, path, "id int, name string, region int")


@query("select case when n_regionkey < 3 then 'low' else 'high' end as type, n_nationkey as id, n_name as name from nation")
def json_entry_rows(spark, sf):
    entry = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    kind = F.when(F.col("n_regionkey") < 3, "low").otherwise("high")
    docs = table(spark, sf, "nation").groupBy(kind.alias("type")).agg(F.collect_list(entry).alias("entries"))
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    docs.repartition(2, "type").write.option("maxRecordsPerFile", 1).json(path)
    return readers.json_entries(spark, path, "id int, name string")


@query("select s_suppkey as id, 'Talk-to,Trade' as options from supplier where s_suppkey < 20")
def option_map(spark, sf):
    docs = table(spark, sf, "supplier").where("s_suppkey < 20").select(F.col("s_suppkey").alias("id"), F.array(F.lit("Talk-to"), F.lit("null"), F.lit("Trade"), F.lit("")).alias("ops"))
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    docs.write.option("maxRecordsPerFile", 1).json(path)
    return readers.option_map(spark, path).select("id", F.array_join("options", ",").alias("options"))


@query("select p_partkey, ['easy', 'hard'][1 + p_size % 2] as tier, [30, 70][1 + p_size % 2] as least, [500, 2500][1 + p_size % 2] as reward from part")
def diary_rewards(spark, sf):
    tier = F.when(F.col("p_size") % 2 == 1, "hard").otherwise("easy")
    rates = spark.createDataFrame([("easy", 30, 500), ("hard", 70, 2500), ("elite", 90, 9000)], "tier string, least int, reward int")
    return game.diary_rewards(_part(spark, sf).select("p_partkey", tier.alias("tier")), rates, ["tier"])


@query("select p_partkey, p_size as size, p_name as name from part")
def nested_values(spark, sf):
    held = F.parse_json(F.to_json(F.struct(F.create_map(F.lit("a"), F.struct(F.col("p_size").alias("s"), F.array("p_name").alias("n"))).alias("m"))))
    rows = _part(spark, sf).select("p_partkey", held.alias("v"))
    return rows.select("p_partkey", F.try_variant_get("v", "$.m.a.s", "int").alias("size"), F.try_variant_get("v", "$.m.a.n[0]", "string").alias("name"))


@query("select user_id, props, ((row_number() over (partition by user_id order by first, props) - 1) // 5)::int as batch from (select user_id, props, min(event_id) as first from events where length(props) >= 8 group by 1, 2)")
def text_batches(spark, sf):
    return streams.batched(table(spark, sf, "events"), "user_id", "props", "event_id", 5, 8)


@query()
def watchdog_respawns(spark, sf):
    return streams.watchdog(table(spark, sf, "events").select((F.col("user_id") % 20).alias("actor"), (F.col("event_id") * 3).alias("tick")))


_STAMPS = ", ".join(map(str, spatial.stamps()))


@query(f"""with w as (select s_suppkey * 13 % 40 as x, s_suppkey * 17 % 40 as y, (s_suppkey % 4)::int as type, (s_suppkey // 4 % 4)::int as o from supplier), k(type, o, dx, dy, bits) as (values {_STAMPS})
select x + dx as x, y + dy as y, bit_or(bits)::int as flags from w join k using (type, o) group by 1, 2""")
def wall_stamps(spark, sf):
    key = F.col("s_suppkey")
    walls = table(spark, sf, "supplier").select((key * 13 % 40).alias("x"), (key * 17 % 40).alias("y"), (key % 4).cast("int").alias("type"), F.pmod(F.floor(key / 4), F.lit(4)).cast("int").alias("orientation"))
    return spatial.stamped(walls)


_NODE = "({x} * 1048576::bigint + {y})"
_STEPS = f"e as materialized (select {_NODE.format(x='x', y='y')} as s, {_NODE.format(x='tx', y='ty')} as d from m where sf & cs = 0 and gf & cd = 0)"


@query(f"""with recursive {catalogue._WALK}, {_STEPS}, p as (select n_nationkey as a, (n_nationkey % 10) * 1048576::bigint + n_nationkey as b from nation),
c as (select a, a::bigint as node, 0 as hops from p union select c.a, e.d, hops + 1 from c join e on e.s = c.node where hops < 6)
select p.a, p.b, min(hops) as hops from p join c on c.a = p.a and c.node = p.b group by 1, 2""")
def crossing_steps(spark, sf):
    n = F.col("n_nationkey").cast("long")
    pairs = table(spark, sf, "nation").select(n.alias("a"), ((n % 10) * (1 << 20) + n).alias("b"))
    number = lambda x, y: F.col(x).cast("long") * (1 << 20) + F.col(y)
    steps = spatial.moves(catalogue._tiles(spark, sf)).select(number("x", "y").alias("src"), number("tx", "ty").alias("dst"))
    return spatial.crossings(pairs, steps, 6)


@query(f"""with recursive {catalogue._WALK}, {_STEPS}, c(node, hops) using key (node) as (select 0::bigint, 0 union select e.d, min(c.hops + 1) from c join e on e.s = c.node left join recurring.c r on r.node = e.d where r.node is null group by 1)
select node // 1048576 as x, node % 1048576 as y, hops from c order by greatest(abs(node // 1048576 - 38), abs(node % 1048576 - 21)), hops, y, x limit 1""")
def closest_reachable(spark, sf):
    return spatial.closest_reachable(catalogue._tiles(spark, sf), (0, 0), (38, 21))
