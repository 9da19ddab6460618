"""Every query of the engine's own operators over the supplied tables, with its SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import conditions, dialogue, game, markup, numeric
from gleanery.operators import accounts, graphs, joins, lookups, requirements, sequences, sinks, spatial
from gleanery.operators.base import table, with_point
from gleanery.plans.registry import flat, oracle_sql, queries, query
from gleanery.streaming import events as streams

# --- lookups and predicates ------------------------------------------------------------------------------------------


@query("select n_nationkey, n_name, n_regionkey from nation where n_name = 'NATION_7'")
def lookup_by_name(spark, sf):
    return lookups.by_key(table(spark, sf, "nation"), n_name="NATION_7")


@query("select p_name, min(p_brand) as p_brand, count(*) as n from part group by p_name")
def lookup_first_version(spark, sf):
    part = table(spark, sf, "part")
    first = lookups.first_version(part.select("p_name", "p_brand").distinct(), "p_name", "p_brand")
    return first.join(part.groupBy("p_name").agg(F.count("*").alias("n")), "p_name").select("p_name", "p_brand", "n")


@query("select p_partkey, p_name from part where p_brand = 'Brand#2' and p_type = 'ECONOMY'")
def optional_filters(spark, sf):
    return lookups.optional_filters(table(spark, sf, "part"), p_brand="Brand#2", p_type="ECONOMY", p_size=None).select("p_partkey", "p_name")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '5-LOW') and o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def dynamic_in_list(spark, sf):
    some = lookups.one_of(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"])
    buyers = table(spark, sf, "customer").where("c_nationkey = 3").select("c_custkey")
    return lookups.one_of(some, "o_custkey", buyers).select("o_orderkey", "o_orderpriority")


@query("select p_partkey, p_name from part where p_name ilike '%RiNg%'")
def search_substring(spark, sf):
    return lookups.search(table(spark, sf, "part"), "p_name", "RiNg").select("p_partkey", "p_name")


@query("select p_partkey, p_size from part where p_size <= 7")
def level_at_most(spark, sf):
    return lookups.at_most(table(spark, sf, "part"), "p_size", 7).select("p_partkey", "p_size")


def _masked(spark, sf):
    return table(spark, sf, "supplier").withColumn("mask", F.call_function("shiftleft", F.lit(1), (F.col("s_suppkey") % 7).cast("int")).bitwiseOR(F.call_function("shiftleft", F.lit(1), (F.col("s_suppkey") % 5).cast("int"))))


_MASKED = "(select *, ((1 << (s_suppkey % 7)::int) | (1 << (s_suppkey % 5)::int)) as mask from supplier)"


@query(f"select s_suppkey, mask::int as mask from {_MASKED} where mask & 12 <> 0")
def mask_any(spark, sf):
    return _masked(spark, sf).where(lookups.mask_any(F.col("mask"), 12)).select("s_suppkey", "mask")


@query(f"select s_suppkey, mask::int as mask from {_MASKED} where mask & 5 = 5")
def mask_all(spark, sf):
    return _masked(spark, sf).where(lookups.mask_all(F.col("mask"), [1, 4])).select("s_suppkey", "mask")


@query(f"select s_suppkey, concat_ws(',', case when mask & 1 <> 0 then 'a' end, case when mask & 2 <> 0 then 'b' end, case when mask & 4 <> 0 then 'c' end) as members, bit_count(mask)::int as bits from {_MASKED}")
def mask_to_list(spark, sf):
    members = F.array_join(lookups.mask_members(F.col("mask"), {"a": 1, "b": 2, "c": 4}), ",")
    return _masked(spark, sf).select("s_suppkey", members.alias("members"), F.bit_count("mask").alias("bits"))


_POINT = "(select *, {k} * 7919 % 1000 as x, {k} * 104729 % 1000 as y from {t})"


@query(f"select c_custkey, abs(x - 500) + abs(y - 500) as distance from {_POINT.format(k='c_custkey', t='customer')} where abs(x - 500) <= 50 and abs(y - 500) <= 50")
def box_near(spark, sf):
    return lookups.box_near(with_point(table(spark, sf, "customer"), "c_custkey"), 500, 500).select("c_custkey", "distance")


@query("select a.n_nationkey as a, b.n_nationkey as b from nation a, nation b where (a.n_nationkey = 3 and b.n_nationkey = 5) or (a.n_nationkey = 5 and b.n_nationkey = 3)")
def symmetric_pair(spark, sf):
    pairs = joins.complete_graph(table(spark, sf, "nation"), "n_nationkey").toDF("a", "b")
    return lookups.symmetric_pair(pairs, "a", "b", 3, 5)


@query("select event_id, json_extract(props, '$.k')::int as k from events where json_extract(props, '$.k')::int in (3, 30)")
def tag_membership(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.array(F.concat(F.lit("k:"), k.cast("string")), F.concat(F.lit("type:"), F.col("event_type")))
    tagged = table(spark, sf, "events").withColumn("tags", tags)
    return tagged.where(lookups.tag_exact(F.col("tags"), "k", "3") | lookups.tag_exact(F.col("tags"), "k", "30")).select("event_id", k.alias("k"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def roots_anti(spark, sf):
    return lookups.roots(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey").select("c_custkey")


@query("select floor((c_custkey - 700) / 64.0)::bigint as region, count(*) as n from customer group by 1")
def tile_key(spark, sf):
    region, _ = lookups.tile_key(F.col("c_custkey") - 700, F.lit(0))
    return table(spark, sf, "customer").groupBy(region.alias("region")).agg(F.count("*").alias("n"))


@query("""select 'balance' as "check", count(*) filter (where c_acctbal < 0) as broken from customer union all
select 'segment', count(*) filter (where c_mktsegment not in ('BUILDING', 'MACHINERY')) from customer""")
def constraint_violations(spark, sf):
    return lookups.violations(table(spark, sf, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})


@query("select event_type, count(*) as n from events where regexp_full_match(event_type, 'c.*|error') group by event_type")
def sender_regex(spark, sf):
    return table(spark, sf, "events").where(lookups.sender_matches(F.col("event_type"), "c.*|error")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select n_nationkey, case n_regionkey when 0 then 'south' when 1 then 'west' end as label from nation")
def enum_decode(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", lookups.decode(F.col("n_regionkey"), {0: "south", 1: "west"}).alias("label"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("select l_orderkey, p_partkey, p_name from lineitem join part on l_partkey = p_partkey where p_size >= 48")
def junction_requirements(spark, sf):
    bridge = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    out = joins.junction(table(spark, sf, "orders"), bridge, table(spark, sf, "part").where("p_size >= 48"), "o_orderkey", "p_partkey")
    return out.select(F.col("o_orderkey").alias("l_orderkey"), "p_partkey", "p_name")


@query("""select s_suppkey, s_name, s_nationkey from supplier where s_nationkey = 3 and s_suppkey in
(select l_suppkey from lineitem join part on l_partkey = p_partkey where p_name ilike '%ring%')""")
def sellers_semi(spark, sf):
    rings = lookups.search(table(spark, sf, "part"), "p_name", "ring").select(F.col("p_partkey").alias("l_partkey"))
    sold = joins.exists_in(table(spark, sf, "lineitem"), rings, "l_partkey").select(F.col("l_suppkey").alias("s_suppkey"))
    return joins.exists_in(table(spark, sf, "supplier").where("s_nationkey = 3"), sold, "s_suppkey").select("s_suppkey", "s_name", "s_nationkey")


@query("select s_suppkey, p_partkey from supplier join lineitem on l_suppkey = s_suppkey join part on p_partkey = l_partkey where p_size = 1")
def producers_dup(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    small = table(spark, sf, "part").where("p_size = 1").select("p_partkey")
    return table(spark, sf, "supplier").join(lines, "s_suppkey").join(small, "p_partkey").select("s_suppkey", "p_partkey")


@query("select o_custkey, o_orderstatus, min(o_orderkey) as least_o_orderkey from orders group by 1, 2")
def distinct_order_hidden(spark, sf):
    return joins.distinct_by_hidden(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")


@query("""select a.l_orderkey, a.l_linenumber as line, b.l_linenumber as other_line from lineitem a join lineitem b
on a.l_orderkey = b.l_orderkey and a.l_returnflag = b.l_returnflag and a.l_linestatus = b.l_linestatus and a.l_linenumber <> b.l_linenumber""")
def self_pair_residual(spark, sf):
    return _line_pairs(table(spark, sf, "lineitem"))


def _line_pairs(lines):
    lines = lines.withColumnRenamed("l_linenumber", "line")
    pairs = joins.paired_sides(lines.select("l_orderkey", "l_returnflag", "l_linestatus", "line"), ["l_orderkey", "l_returnflag", "l_linestatus"], "line")
    return pairs.select("l_orderkey", "line", "other_line")


def _places(spark, sf):
    left = with_point(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "x", "y")
    right = with_point(table(spark, sf, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return left, right


_PAIRS = f"(select c_custkey, s_suppkey, greatest(abs(c.x - s.x), abs(c.y - s.y)) as distance, c.x - s.x as dx, c.y - s.y as dy from {_POINT.format(k='c_custkey', t='customer')} c, {_POINT.format(k='s_suppkey', t='supplier')} s)"


@query(f"select c_custkey, s_suppkey as rid, distance from (select *, row_number() over (partition by c_custkey order by distance, s_suppkey) as place from {_PAIRS}) where place = 1")
def nearest_join(spark, sf):
    return joins.nearest(*_places(spark, sf)).select("c_custkey", "rid", "distance")


@query(f"select c_custkey, s_suppkey as rid, distance from (select *, row_number() over (partition by c_custkey order by distance, s_suppkey) as place from {_PAIRS}) where place = 1")
def nearest_join_rings(spark, sf):
    return joins.nearest(*_places(spark, sf), small=0).select("c_custkey", "rid", "distance")


@query(f"select c_custkey, s_suppkey as rid, distance from {_PAIRS} where distance <= 40")
def within_distance(spark, sf):
    return joins.within(*_places(spark, sf), 40).select("c_custkey", "rid", "distance")


@query(f"select c_custkey, s_suppkey as rid, abs(dx) + abs(dy) as distance from {_PAIRS} where abs(dx) + abs(dy) <= 30")
def within_manhattan(spark, sf):
    return joins.within(*_places(spark, sf), 30, "manhattan").select("c_custkey", "rid", "distance")


@query("""with asked as (select p_partkey, case p_partkey % 4 when 0 then p_name when 1 then upper(p_name) when 2 then p_name || ' (4)' else 'no such ' || p_name end as said from part),
known as (select p_name, min(p_partkey) as id from part group by p_name)
select p_partkey, coalesce(a.id, b.id, c.id) as found from asked left join known a on said = a.p_name
left join known b on lower(said) = b.p_name left join known c on regexp_replace(said, ' \\(\\d+\\)$', '') = c.p_name""")
def fallback_resolve(spark, sf):
    part = table(spark, sf, "part")
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    said = F.when(kind == 0, name).when(kind == 1, F.upper(name)).when(kind == 2, F.concat(name, F.lit(" (4)"))).otherwise(F.concat(F.lit("no such "), name))
    known, said_col = part.select("p_name", "p_partkey"), F.col("said")
    steps = [(said_col, known), (F.lower(said_col), known), (F.regexp_replace(said_col, r" \(\d+\)$", ""), known)]
    return joins.first_found(part.select("p_partkey", said.alias("said")), steps, "found").select("p_partkey", "found")


_NAMES = """(select lower(p_name) as name, 'part' as type, p_partkey as id, 0 as place from part union all
select lower(n_name), 'nation', n_nationkey, 1 from nation union all select 'red ring', 'region', r_regionkey, 2 from region)"""


def _named(spark, sf):
    region = table(spark, sf, "region").select("r_regionkey", F.lit("Red Ring").alias("r_name"))
    return [("part", table(spark, sf, "part").select("p_partkey", "p_name")), ("nation", table(spark, sf, "nation").select("n_nationkey", "n_name")), ("region", region)]


@query(f"select name, type, id from (select *, row_number() over (partition by name order by place desc, id) as r from {_NAMES}) where r = 1")
def priority_lookup(spark, sf):
    return joins.merged_lookup(_named(spark, sf), last_wins=True)


@query(f"select name, type, id from (select *, row_number() over (partition by name order by place, id) as r from {_NAMES}) where r = 1")
def first_type_lookup(spark, sf):
    return joins.merged_lookup(_named(spark, sf), last_wins=False)


@query("select a.n_nationkey as src, b.n_nationkey as dst from nation a, nation b where a.n_nationkey <> b.n_nationkey")
def complete_graph(spark, sf):
    return joins.complete_graph(table(spark, sf, "nation"), "n_nationkey")


@query("""select a.p_partkey, min(b.p_partkey) as match_id from part a join part b on a.p_brand = b.p_brand and a.p_size = b.p_size
and (contains(lower(left(a.p_name, 30)), lower(left(b.p_name, 30))) or contains(lower(left(b.p_name, 30)), lower(left(a.p_name, 30)))) group by 1""")
def prefix_fuzzy(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    return joins.prefix_fuzzy(part, part.withColumnRenamed("p_partkey", "id"), ["p_brand", "p_size"], "p_name").select("p_partkey", "match_id")


@query("select 'item' as kind, count(*) as n from (select distinct p_name from part) where p_name like 'red%' union all select 'virtual', count(*) from (select distinct p_name from part) where p_name not like 'red%'")
def match_split(spark, sf):
    names = table(spark, sf, "part").select("p_name").distinct()
    known = names.where("p_name like 'red%'").withColumn("key", F.lit(1))
    physical, virtual = joins.match_split(names, known, "p_name", "key")
    return physical.agg(F.lit("item").alias("kind"), F.count("*").alias("n")).unionByName(virtual.agg(F.lit("virtual").alias("kind"), F.count("*").alias("n")))


@query("""select a.n_nationkey as location_id, concat_ws(',', 'e=' || coalesce(e.n_nationkey::varchar, ''), 'w=' || coalesce(w.n_nationkey::varchar, '')) as neighbours from nation a
left join nation e on e.n_nationkey = a.n_nationkey + 1 left join nation w on w.n_nationkey = a.n_nationkey - 1""")
def neighbour_map(spark, sf):
    nation = table(spark, sf, "nation")
    places = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    name = lambda step: F.concat(F.lit("NATION_"), (F.col("n_nationkey") + step).cast("string"))
    edges = nation.select(F.col("n_nationkey").alias("location_id"), F.explode(F.array(*(F.struct(F.lit(d).alias("direction"), name(s).alias("neighbor")) for d, s in (("e", 1), ("w", -1))))).alias("e")).select("location_id", "e.*")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("neighbours")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit("")))), ",")
    return joins.neighbours_by_name(places, edges).select("location_id", said.alias("neighbours"))


@query("""with p as (select 'r' || c_custkey as name, case when c_custkey % 3 = 0 then 'r' || (c_custkey + 1) end as target, c_mktsegment as content from customer)
select a.name, coalesce(b.content, a.content) as content from p a left join p b on a.target = b.name""")
def redirect_chase(spark, sf):
    label = lambda c: F.concat(F.lit("r"), c.cast("string"))
    key = F.col("c_custkey")
    pages = table(spark, sf, "customer").select(label(key).alias("name"), F.when(key % 3 == 0, label(key + 1)).alias("target"), F.col("c_mktsegment").alias("content"))
    return joins.follow_redirects(pages, "name", "target").select("name", "content")


@query("""select c_custkey, case when n_nationkey is not null then n_nationkey else 0 end as n_nationkey from customer left join nation on n_nationkey = c_nationkey and n_regionkey = 1""")
def ordered_candidates(spark, sf):
    candidates = F.array(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), F.lit("fallback"))
    known = table(spark, sf, "nation").where("n_regionkey = 1").select("n_name", "n_nationkey")
    known = known.unionByName(spark.range(1).select(F.lit("fallback").alias("n_name"), F.lit(0).alias("n_nationkey")))
    asked = table(spark, sf, "customer").select("c_custkey", candidates.alias("names"))
    return joins.ordered_candidates(asked, "names", known, "n_name", "n_nationkey")


# --- aggregates and sets ---------------------------------------------------------------------------------------------


@query("select event_type, count(*) as n from events group by 1")
def histogram_desc(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("select count(*) as n, count(distinct user_id) as users, count(*) filter (where event_type = 'error') as errors from events")
def distinct_count(spark, sf):
    return table(spark, sf, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query(f"select c_nationkey, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from {_POINT.format(k='c_custkey', t='customer')} group by 1")
def bounding_box(spark, sf):
    return with_point(table(spark, sf, "customer"), "c_custkey").groupBy("c_nationkey").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


@query(f"select s_nationkey, bit_or(mask)::int as mask from {_MASKED} group by 1")
def bit_or_group(spark, sf):
    return _masked(spark, sf).groupBy("s_nationkey").agg(F.bit_or("mask").alias("mask"))


@query("select p_name, min(p_partkey) as id, count(distinct p_brand) as brands from part group by 1")
def canonical_min(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"), F.count_distinct("p_brand").alias("brands"))


@query("select user_id, event_type, min(event_id) as first_seen from events group by 1, 2")
def ordered_distinct(spark, sf):
    return sequences.ordered_distinct(table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by 1")
def grouped_text(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))


@query("select n_name as name from nation union select r_name from region union select p_name from part")
def union_names(spark, sf):
    parts = [table(spark, sf, t).select(F.col(c).alias("name")) for t, c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'F'")
def set_difference(spark, sf):
    return table(spark, sf, "customer").select("c_custkey").subtract(table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


# --- requirements ----------------------------------------------------------------------------------------------------


@query("""select l_orderkey, bool_and(met) as available, (count(*) filter (where not met)) as unmet_groups from
(select l_orderkey, l_linestatus, bool_or(l_quantity >= 20) as met from lineitem group by 1, 2) group by 1""")
def requirement_and_or(spark, sf):
    met = requirements.compare(F.col("l_quantity"), F.lit(">="), F.lit(20))
    return requirements.satisfied(table(spark, sf, "lineitem"), "l_orderkey", "l_linestatus", met)


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity < 10)")
def availability_flat(spark, sf):
    members = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return requirements.available_flat(table(spark, sf, "orders"), members, "o_orderkey", F.col("l_quantity") >= 10).select("o_orderkey")


_XP = ", ".join(f"({k + 1}, {x})" for k, x in enumerate(game.thresholds()))


@query(f"""with t(level, needs) as (values {_XP}), g as (select o_custkey as account, o_orderstatus as skill, sum(o_orderkey) as xp from orders group by 1, 2)
select account, skill, xp::bigint as xp, coalesce(max(level), 1) as level from g left join t on xp >= needs group by 1, 2, 3""")
def account_levels(spark, sf):
    gains = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderstatus").alias("skill"), F.col("o_orderkey").alias("amount"))
    return requirements.levels_after(gains, game.experience_table(spark).withColumnRenamed("xp", "needs"))


_DONE = """with recursive a as (select o_custkey as account, o_orderkey % 500 as quest, o_orderkey as seq from orders where o_orderkey % 500 > 0),
d as (select account, quest, seq from a union select account, quest // 2, seq from d where quest // 2 > 0),
done as (select account, quest, min(seq) as "at" from d group by 1, 2)"""


def _actions(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 500).alias("quest"), F.col("o_orderkey").alias("seq")).where("quest > 0")


def _done(actions):
    needs = actions.sparkSession.range(2, 500).select(F.col("id").alias("quest"), F.floor(F.col("id") / 2).cast("long").alias("required"))
    return accounts.completed(actions, needs)


def _points(done):
    return accounts.points(done, done.sparkSession.range(500).select(F.col("id").alias("quest"), (F.col("id") % 5).alias("points")))


@query(f"{_DONE} select account, quest, \"at\" from done")
def account_quests(spark, sf):
    return _done(_actions(spark, sf))


@query(f"{_DONE} select account, sum(quest % 5)::bigint as points from done group by 1")
def account_points(spark, sf):
    return _points(_done(_actions(spark, sf)))


@query("""with f as (select o_custkey as account, o_orderkey % 7 as region, min(o_orderkey) as seq from orders where o_orderkey % 7 not in (0, 1) group by 1, 2),
p as (select account, region, row_number() over (partition by account order by seq, region) as n from f)
select account, region from p where n <= 2 union all select distinct o_custkey, unnest([0, 1]) from orders""")
def account_regions(spark, sf):
    actions = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 7).alias("region"), F.col("o_orderkey").alias("seq"))
    return accounts.unlocked(actions, [0, 1], 2)


# --- ordered rows ----------------------------------------------------------------------------------------------------


@query("""select user_id, island, event_type, min(pos) as first_pos, max(pos) as last_pos, count(*) as length, ((min(pos) + max(pos)) // 2) as middle from
(select *, cast(sum(new) over (partition by user_id order by pos) as bigint) as island from
(select user_id, event_type, pos, case when pos = 0 or event_type <> lag(event_type) over (partition by user_id order by pos) then 1 else 0 end as new from
(select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as pos from events))) group by 1, 2, 3""")
def islands(spark, sf):
    return sequences.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])


@query("""select conv_id, turn, coalesce(lag(role) over w is null or role <> lag(role) over w or lag(length(text)) over w > 200, true) as is_entry from conversations window w as (partition by conv_id order by turn)""")
def entry_detection(spark, sf):
    rows = table(spark, sf, "conversations")
    return sequences.entries(rows, "conv_id", "turn", F.col("role"), F.char_length("text") <= 200).select("conv_id", "turn", "is_entry")


_ADDR = "select conv_id, turn, case when not dead then sum(case when dead then 0 else 1 end) over (partition by conv_id order by turn) - 1 end::bigint as new_addr from (select *, length(text) % 3 = 0 as dead from conversations)"


@query(_ADDR)
def dense_renumber(spark, sf):
    return sequences.renumber(table(spark, sf, "conversations"), "conv_id", "turn", F.char_length("text") % 3 == 0).select("conv_id", "turn", "new_addr")


@query(f"select conv_id, turn, min(new_addr) over (partition by conv_id order by turn rows between current row and unbounded following) as remap from ({_ADDR})")
def forward_fill(spark, sf):
    return sequences.renumber(table(spark, sf, "conversations"), "conv_id", "turn", F.char_length("text") % 3 == 0).select("conv_id", "turn", "remap")


@query("select event_id, lag(event_type) over w as previous_event_type, lead(event_type) over w as next_event_type from events window w as (partition by user_id order by event_id)")
def siblings(spark, sf):
    return sequences.previous_and_next(table(spark, sf, "events"), "user_id", "event_id", "event_type").select("event_id", "previous_event_type", "next_event_type")


@query("""select a.event_id, coalesce(max(b.event_id) filter (where b.value > 50), max(b.event_id)) as reference from events a
left join events b on a.user_id = b.user_id and a.event_type = b.event_type and b.event_id < a.event_id group by 1""")
def nearest_equal(spark, sf):
    return sequences.nearest_equal(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", F.col("value") > 50).select("event_id", "reference")


@query("select c_custkey, (c_acctbal >= 0)::int + (c_acctbal >= 1000)::int + (c_acctbal >= 5000)::int as step from customer")
def step_threshold(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", sequences.step_value(F.col("c_acctbal"), [0, 1000, 5000]).alias("step"))


@query("""select 1 as level, 0::bigint as xp union all select (n + 1)::int, (sum(floor(n + 300 * pow(2, n / 7.0))::bigint) over (order by n) // 4)::bigint from range(1, 99) t(n)""")
def experience_table(spark, sf):
    return game.experience_table(spark)


@query("select event_id, (event_id % 4)::int as worker from events")
def round_robin(spark, sf):
    return sequences.round_robin(table(spark, sf, "events"), "event_id", 4).select("event_id", "worker")


# --- graphs ----------------------------------------------------------------------------------------------------------


def _tree(spark, sf, cyclic=True):
    part = table(spark, sf, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).cast("long").alias("dst"))
    return part.unionByName(spark.range(1).select(F.lit(1).cast("long").alias("src"), F.lit(3).cast("long").alias("dst"))) if cyclic else part


_TREE = "select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 0"
_CYCLE = f"{_TREE} union all select 1, 3"


@query(f"with recursive e as ({_CYCLE}), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst from c")
def closure_up(spark, sf):
    return graphs.closure(_tree(spark, sf))


@query(f"with recursive e as ({_CYCLE}), c as (select src, dst from e where dst = 3 union select e.src, c.dst from c join e on e.dst = c.src) select src from c")
def closure_down(spark, sf):
    back = _tree(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    below = graphs.reachable(back, spark.range(3, 4))
    met = _tree(spark, sf).join(below.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src").distinct()
    return met


@query(f"with recursive e as ({_CYCLE}), c as (select 40::bigint as node, 0 as hops union select e.dst, hops + 1 from c join e on e.src = c.node where hops < 3) select node, min(hops) as hops from c group by 1")
def hops_k(spark, sf):
    return graphs.hops(_tree(spark, sf), spark.range(40, 41), 3)


@query("with recursive c as (select p_partkey as node, 0 as level from part where p_partkey = 0 union all select p.p_partkey, level + 1 from c join part p on p.p_partkey // 2 = c.node and p.p_partkey > 0) select node, level from c")
def dependency_order(spark, sf):
    return graphs.dependency_levels(_tree(spark, sf, cyclic=False))


#: Labels spread until none shrinks, a row for each node.
_SPREAD = """c(node, component) using key (node) as (select s, min(least(s, d)) from b group by 1
union select b.d, min(c.component) from c join b on b.s = c.node join recurring.c r on r.node = b.d where c.component < r.component group by 1)"""


@query(f"""with recursive b as materialized (select l_suppkey as s, l_partkey + 1000000 as d from lineitem union select l_partkey + 1000000, l_suppkey from lineitem),
{_SPREAD} select node, component from c""")
def components(spark, sf):
    return graphs.components(_bipartite(table(spark, sf, "lineitem")))


def _bipartite(lines):
    return lines.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"))


_ROADS = """select n_nationkey::bigint as src, ((n_nationkey * 7 + 3) % 25)::bigint as dst, (n_nationkey % 5 + 1)::bigint as weight from nation union all
select n_nationkey, (n_nationkey + 1) % 25, 9 from nation"""


def _roads(spark, sf):
    n = F.col("n_nationkey").cast("long")
    a = table(spark, sf, "nation").select(n.alias("src"), ((n * 7 + 3) % 25).alias("dst"), (n % 5 + 1).alias("weight"))
    return a.unionByName(table(spark, sf, "nation").select(n.alias("src"), ((n + 1) % 25).alias("dst"), F.lit(9).cast("long").alias("weight")))


_COSTS = f"""with recursive e as materialized ({_ROADS}), c(node, cost) using key (node) as (select 0::bigint, 0::bigint
union select e.dst, min(c.cost + e.weight) from c join e on e.src = c.node left join recurring.c r on r.node = e.dst where r.node is null or c.cost + e.weight < r.cost group by 1)"""


@query(f"{_COSTS} select node, cost from c")
def shortest_path(spark, sf):
    return graphs.shortest_paths(_roads(spark, sf), spark.range(1)).select("node", "cost")


@query(f"""with recursive e as ({_ROADS}), c as (select * from (values (0::bigint, 0::bigint, 0), (5, 5, 0)) t(source, node, hops) union
select c.source, e.dst, hops + 1 from c join e on e.src = c.node where hops < 4) select source, node, min(hops) as hops from c group by 1, 2""")
def distances_from(spark, sf):
    return graphs.distances(_roads(spark, sf), spark.createDataFrame([(0,), (5,)], "node long"), 4)


@query(f"""{_COSTS}, p as (select 24::bigint as node, 0 as back union all select (select min(e.src) from e join c a on a.node = e.src join c b on b.node = p.node where e.dst = p.node and a.cost + e.weight = b.cost), back + 1 from p where p.node <> 0)
select (select max(back) from p) - back as step, node, cost from p join c using (node)""")
def shortest_path_steps(spark, sf):
    return graphs.path_steps(graphs.shortest_paths(_roads(spark, sf), spark.range(1)), 24)


@query("with recursive c as (select 5::bigint as node, 0 as depth union all select p_partkey, depth + 1 from c join part on p_partkey // 2 = c.node and p_partkey > 0) select node, depth from c")
def subtree(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent_id"))
    return graphs.subtree(nodes, 5)


# --- tiles -----------------------------------------------------------------------------------------------------------


def _tiles(spark, sf):
    n = F.col("id")
    flags = F.when(n * 7919 % 11 < 3, F.lit(spatial.FULL | spatial.PRESENT)).otherwise(F.call_function("shiftleft", F.lit(1), (n * 31 % 9).cast("int")).bitwiseAND(F.lit(15)).bitwiseOR(F.lit(spatial.PRESENT)))
    return spark.range(1600).select((n % 40).cast("int").alias("x"), F.floor(n / 40).cast("int").alias("y"), flags.alias("flags"))


_TILES = "(select (n % 40)::int as x, (n // 40)::int as y, case when n * 7919 % 11 < 3 then 48 else (((1 << (n * 31 % 9)::int) & 15) | 32) end as flags from range(1600) t(n))"


_WALK = f"""t as materialized (select * from {_TILES}), steps as (values (-1, 0, 1, 0, 0, 0), (1, 0, 4, 0, 0, 0), (0, 1, 0, 2, 0, 0), (0, -1, 0, 8, 0, 0),
(-1, 1, 1, 2, 256, 1024), (1, 1, 4, 2, 512, 2048), (1, -1, 4, 8, 1024, 256), (-1, -1, 1, 8, 2048, 512)),
m as materialized (select s.x, s.y, s.x + dx as tx, s.y + dy as ty, cs, cd, s.flags as sf, g.flags as gf from t s, steps p(dx, dy, h, v, cs, cd) join t g on g.x = s.x + dx and g.y = s.y + dy
left join t a on a.x = s.x + dx and a.y = s.y left join t b on b.x = s.x and b.y = s.y + dy
where s.flags & (h | v) = 0 and g.flags & 16 = 0 and (dx = 0 or dy = 0 or (a.flags & (v | 16) = 0 and b.flags & (h | 16) = 0)))"""


@query(f"with {_WALK} select x, y, tx, ty from m where sf & cs = 0 and gf & cd = 0")
def all_moves(spark, sf):
    return spatial.moves(_tiles(spark, sf))


@query(f"with {_WALK} select x, y, tx, ty from m where x = tx or y = ty")
def cardinal_moves(spark, sf):
    return spatial.moves(_tiles(spark, sf)).where("x = tx or y = ty")


@query(f"""with recursive {_WALK}, b as materialized (select x * 1048576::bigint + y as s, tx * 1048576::bigint + ty as d from m where sf & 16 = 0 union select tx * 1048576::bigint + ty, x * 1048576::bigint + y from m where sf & 16 = 0),
{_SPREAD} select x, y, coalesce(component, x * 1048576::bigint + y) as component from t left join c on node = x * 1048576::bigint + y where flags & 16 = 0""")
def walkable_components(spark, sf):
    return spatial.walkable_components(_tiles(spark, sf))


_OWNERS = f"select x, y, s_suppkey as owner from (select x, y, s_suppkey, row_number() over (partition by x, y order by (x - px) * (x - px) + (y - py) * (y - py), s_suppkey) as r from {_TILES} , (select s_suppkey, s_suppkey * 7 % 40 as px, s_suppkey * 11 % 40 as py from supplier)) where r = 1"


def _owned(spark, sf):
    points = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 40).alias("px"), (F.col("s_suppkey") * 11 % 40).alias("py"))
    return spatial.owners(_tiles(spark, sf).select("x", "y"), points)


@query(_OWNERS)
def tile_owners(spark, sf):
    return _owned(spark, sf)


@query(f"with o as ({_OWNERS}) select distinct least(a.owner, b.owner) as a, greatest(a.owner, b.owner) as b from o a join o b on abs(a.x - b.x) + abs(a.y - b.y) = 1 and a.owner <> b.owner")
def component_borders(spark, sf):
    return spatial.component_borders(tile_owners(spark, sf).withColumnRenamed("owner", "component"))


@query(f"""with o as materialized ({_OWNERS}),
m as (select 0 as axis, least(a.owner, b.owner) as a, greatest(a.owner, b.owner) as b, a.owner, a.x as across, a.y as along from o a join o b on b.x = a.x + 1 and b.y = a.y and a.owner <> b.owner
union all select 1, least(a.owner, b.owner), greatest(a.owner, b.owner), a.owner, a.y, a.x from o a join o b on b.x = a.x and b.y = a.y + 1 and a.owner <> b.owner),
r as (select axis, a, b, owner, across, min(along) as first, max(along) as last from (select *, along - row_number() over (partition by axis, a, b, owner, across order by along) as run from m) group by all)
select a, b, owner, 1 as component, 1 as "to", case axis when 0 then across else (first + last) // 2 end as x, case axis when 0 then (first + last) // 2 else across end as y, last - first + 1 as width from (select axis, a, b, owner, across, first, last from r)""".replace("group by all", "group by axis, a, b, owner, across, run"))
def area_ports(spark, sf):
    cells = _tiles(spark, sf).select("x", "y", F.lit(1).cast("long").alias("component"))
    return spatial.ports(cells, _owned(spark, sf))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query("select p_partkey, trim(regexp_replace(lower(p_name || 's ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') as said from part")
def snake_case(spark, sf):
    said = markup.snake_case(F.concat("p_name", F.lit("'s "), "p_brand"))
    return table(spark, sf, "part").select("p_partkey", said.alias("said"))


@query("select p_partkey, p_brand || ' of ' || p_name as links, p_name || ' x' as markup, p_name as plink, 'a ' || p_name as refs from part")
def strip_links(spark, sf):
    text = lambda *parts: F.concat(*(F.lit(p) if not p.startswith("p_") else F.col(p) for p in parts))
    return table(spark, sf, "part").select(
        "p_partkey",
        markup.strip_links(text("[[", "p_brand", "|shown]] of [[", "p_name", "]]")).alias("links"),
        markup.strip_markup(text("'''[[T|", "p_name", "]]''' {{a|b}}x")).alias("markup"),
        markup.strip_plinks(text("{{Plink|", "p_name", "|pic=1}}")).alias("plink"),
        markup.strip_refs(text("a <ref name=1>x\ny</ref>", "p_name", "{{Refn|z}}")).alias("refs"),
    )


@query("select p_partkey, case when p_partkey % 2 = 0 then p_partkey * 1000 end as number, case when p_partkey % 3 = 0 then 0.0 else p_size / 2.0 end::double as xp, case when p_size > 10 then p_size end::bigint as ticks, p_size % 2 <> 0 as members, p_size as count from part")
def parse_numbers(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    thousands = F.concat(F.lit(" +"), key.cast("string"), F.when(key == 0, F.lit("")).otherwise(F.lit(",000%")))
    return table(spark, sf, "part").select(
        "p_partkey",
        numeric.parse_int(F.when(key % 2 == 0, thousands).otherwise(F.lit("12x"))).alias("number"),
        numeric.parse_xp(F.when(key % 3 == 0, F.lit("-1")).otherwise((size / 2).cast("string"))).alias("xp"),
        numeric.parse_ticks(F.when(size > 10, size.cast("string")).otherwise(F.lit("Varies"))).alias("ticks"),
        numeric.parse_members(F.when(size % 2 == 0, F.lit(" No ")).otherwise(F.lit("Yes"))).alias("members"),
        numeric.parse_count(size.cast("string")).alias("count"),
    )


@query("select p_partkey, case p_partkey % 3 when 0 then p_partkey || ':' || p_size when 1 then p_partkey || ':' || p_size || ';' || p_size || ':' || p_partkey else (p_partkey % 90000 + 1000) || ':' || (p_size + 1000) end as pairs from part")
def coordinates(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    one = F.concat(F.lit("{{Map|x = "), s(key), F.lit("|y="), s(size), F.lit("|1111,2222}}"))
    two = F.concat(F.lit("{{Map|x:"), s(key), F.lit(",y:"), s(size), F.lit("|x:"), s(size), F.lit(",y:"), s(key), F.lit("}}"))
    bare = F.concat(F.lit("{{Map|"), s(key % 90000 + 1000), F.lit(","), s(size + 1000), F.lit("}}"))
    text = F.when(key % 3 == 0, one).when(key % 3 == 1, two).otherwise(bare)
    pairs = F.array_join(F.transform(numeric.coordinates(text), lambda p: F.concat(s(p["x"]), F.lit(":"), s(p["y"]))), ";")
    return table(spark, sf, "part").select("p_partkey", pairs.alias("pairs"))


@query("""select c_custkey, floor((d + h + p // 2) / 4.0::double + greatest(13 / 40.0::double * (a + s), 13 / 40.0::double * (3 * r // 2), 13 / 40.0::double * (3 * m // 2)))::int as level from
(select c_custkey, c_custkey % 99 + 1 as a, c_custkey * 3 % 99 + 1 as s, c_custkey * 5 % 99 + 1 as d, c_custkey * 7 % 90 + 10 as h, c_custkey * 11 % 99 + 1 as r, c_custkey * 13 % 99 + 1 as m, c_custkey * 17 % 99 + 1 as p from customer)""")
def combat_level(spark, sf):
    key = F.col("c_custkey")
    skills = [key * f % (90 if f == 7 else 99) + (10 if f == 7 else 1) for f in (1, 3, 5, 7, 11, 13, 17)]
    return table(spark, sf, "customer").select("c_custkey", game.combat_level(*skills).alias("level"))


@query("""select p_partkey, case when p_size % 5 = 0 then 77 else greatest(floor(p_partkey * p_size / 1000.0)::bigint, 1) end as sell, greatest(floor(p_partkey * p_size / 1000.0)::bigint, p_partkey // 10) as buy from part""")
def prices(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", game.sell_price(F.when(size % 5 == 0, F.lit(77).cast("long")), key, size).alias("sell"), game.buy_price(F.lit(None).cast("long"), key, size).alias("buy"))


@query(f"with t(level, needs) as (values {_XP}) select c_custkey, max(level) as level from customer join t on c_custkey * 500 >= needs group by 1")
def level_for_xp(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", game.level_for_xp(F.col("c_custkey") * 500).alias("level"))


@query("select l_shipdate as day, count(*) as n, ceil(round(count(*) / 0.6::double, 9))::bigint as ticks from lineitem group by 1")
def tick_conversion(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.count("*").alias("n"), game.ticks(F.count("*")).alias("ticks"))


# --- writes ----------------------------------------------------------------------------------------------------------


@query("select o_custkey as id, min(o_orderkey) as seq from orders where o_custkey >= 100 group by 1 union all select c_custkey, -1 from customer where c_custkey < 100")
def insert_or_ignore(spark, sf):
    old = table(spark, sf, "customer").where("c_custkey < 100").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("seq"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return sinks.insert_or_ignore(old, new, ["id"], "seq")


@query("select c_custkey as id, coalesce(max(o_orderkey), -1) as seq from customer left join orders on o_custkey = c_custkey group by 1")
def insert_or_replace(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("seq"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"))
    return sinks.insert_or_replace(old, new, ["id"], "seq")


@query("select n_nationkey::bigint as id, n_name as name from nation union all select 24 + row_number() over (order by p_name), p_name from (select distinct p_name from part)")
def insert_or_get_id(spark, sf):
    dimension = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return sinks.insert_or_get_id(dimension, table(spark, sf, "part").select(F.col("p_name").alias("name")), ["name"])


@query("select s_suppkey, (s_nationkey | coalesce(m, 0))::int as s_nationkey from supplier left join (select l_suppkey, bit_or(l_linenumber) as m from lineitem where l_quantity = 50 group by 1) on l_suppkey = s_suppkey")
def or_update(spark, sf):
    masks = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_linenumber").alias("mask"))
    return sinks.or_update(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), masks, "s_suppkey", "s_nationkey")


@query("select o_custkey, o_orderstatus, count(*) as n from orders where o_custkey % 10 <> 0 group by 1, 2 union all select c_custkey, 'new', 1 from customer where c_custkey % 10 = 0")
def replace_scope(spark, sf):
    old = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    new = table(spark, sf, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("new").alias("o_orderstatus"), F.lit(1).cast("long").alias("n"))
    return sinks.replace_scope(old, new, ["o_custkey"])


@query("""select 'orders' as name, count(*) as n from orders where o_custkey % 7 <> 0 union all
select 'lineitem', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_custkey % 7 = 0)""")
def cascade_delete(spark, sf):
    tables = {t: table(spark, sf, t) for t in ("customer", "orders", "lineitem")}
    doomed = tables["customer"].where("c_custkey % 7 = 0").select("c_custkey")
    links = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")]
    orders = tables["orders"].join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    left = sinks.cascade_delete(tables | {"orders": orders}, links, "customer", doomed, "c_custkey")
    return left["orders"].agg(F.lit("orders").alias("name"), F.count("*").alias("n")).unionByName(left["lineitem"].agg(F.lit("lineitem").alias("name"), F.count("*").alias("n")))


@query("select 'part' as table_name, p_name as wiki_page, string_agg(distinct p_brand, ', ' order by p_brand) as authors from part group by p_name")
def lineage(spark, sf):
    return sinks.lineage(table(spark, sf, "part").select(F.col("p_name").alias("page"), F.col("p_brand").alias("author")), "part")


# --- streams ---------------------------------------------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts) as tick, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as cents from events group by 1, 2")
def tick_window(spark, sf):
    return streams.run(streams.ticks(streams.events(spark, sf)), "update", ["tick", "event_type"]).withColumn("tick", F.col("tick").cast("timestamp_ntz"))


@query("""select user_id, min(ts) as start, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
(select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events)) group by user_id, s""")
def session_per_user(spark, sf):
    return streams.run(streams.sessions(streams.events(spark, sf)), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select json_extract(props, '$.k')::int as k, count(distinct user_id) as n from events group by 1")
def loot_totals(spark, sf):
    return streams.run(streams.totals(streams.events(spark, sf)), "complete")


@query("select user_id, max_by(event_id, (ts, event_id)) as event_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1")
def latest_snapshot(spark, sf):
    return streams.run(streams.snapshot(streams.events(spark, sf)), "update", ["user_id"])


@query("select user_id, round(max_by(value, (ts, event_id)) * 100)::bigint - round(min_by(value, (ts, event_id)) * 100)::bigint as gain from events group by 1")
def baseline_delta(spark, sf):
    return streams.run(streams.baselines(streams.events(spark, sf)), "update", ["user_id"])


@query("select event_id, s as subscriber from events join (values ('click', 'a'), ('click', 'b'), ('error', 'c')) t(e, s) on event_type = e")
def event_dispatch(spark, sf):
    subscriptions = spark.createDataFrame([("click", "a"), ("click", "b"), ("error", "c")], "event_type string, subscriber string")
    return streams.run(streams.dispatch(streams.events(spark, sf), subscriptions).select("event_id", "subscriber"), "append")


@query("""select user_id % 9 as "to", event_id as seq from events where user_id % 9 < 6""")
def mailbox_routing(spark, sf):
    mail = streams.events(spark, sf).select((F.col("user_id") % 9).alias("to"), F.col("event_id").alias("seq"))
    return streams.run(streams.mailboxes(mail, spark.range(6).select(F.col("id").alias("actor"))), "append")


@query("""select user_id % 9 as "to", event_id as seq from (select *, row_number() over (partition by user_id % 9 order by event_id) as r from events where user_id % 9 < 6) where r <= 5""")
def mailbox_drain(spark, sf):
    mail = table(spark, sf, "events").select((F.col("user_id") % 9).alias("to"), F.col("event_id").alias("seq"), F.col("event_type").alias("from"))
    live = spark.range(6).select(F.col("id").alias("actor"))
    return streams.drain(streams.mailboxes(mail, live), 5).select("to", "seq")


# --- page text -------------------------------------------------------------------------------------------------------


def _wiki(spark, sf):
    key, name = F.col("p_partkey"), F.col("p_name")
    body = F.concat(F.lit("{{Infobox Item|name = "), name, F.lit("|id1="), key.cast("string"), F.lit("|id2 = {{plus|1|2}}|members="), F.when(key % 2 == 0, F.lit("No")).otherwise(F.lit("Yes")), F.lit("}}\n'''"), name, F.lit("''' is [[Item|an item]].\n{{infobox item|name=x}}"))
    return table(spark, sf, "part").select(key.alias("page_id"), body.alias("wikitext"))


@query("select p_partkey as page_id, p_name as name, p_partkey::varchar as id1, '{{plus|1|2}}' as id2, p_partkey % 2 <> 0 as members from part")
def template_extract(spark, sf):
    rows = _wiki(spark, sf).withColumn("t", F.get(markup.template_rows("wikitext", F.lit("Infobox Item")), 0)["named"])
    get = lambda k: F.try_element_at("t", F.lit(k))
    return rows.select("page_id", get("name").alias("name"), get("id1").alias("id1"), get("id2").alias("id2"), numeric.parse_members(get("members")).alias("members"))


@query("select p_partkey as page_id, p_name || ' is an item.' as said from part")
def template_expand(spark, sf):
    return _wiki(spark, sf).select("page_id", F.get(F.split(markup.expanded("wikitext"), "\n"), 0).alias("said"))


def _transcripts(spark, sf):
    key = F.col("conv_id").cast("string")
    lines = F.concat(F.lit("* '''"), F.when(F.col("role") == "user", F.lit("Player")).otherwise(F.lit("Guide")), F.lit(":''' Turn "), F.col("turn").cast("string"))
    talk = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", lines.alias("line")))), lambda r: r["line"]), "\n").alias("talk"))
    menu = F.lit("\n== Choice ==\n* {{tselect|Pick}}\n* {{topt|Yes}}\n** '''Player:''' Yes\n** {{tcond|has item}}\n*** '''Guide:''' Here.\n* {{topt|No}}\n** '''Player:''' No\n* {{tact|end}}")
    return talk.select("page_id", F.concat("talk", menu).alias("wikitext"))


@query("select conv_id as page_id, count(*) + 8 as n, 3 as depth from conversations group by 1")
def tree_parse(spark, sf):
    return dialogue.trees(_transcripts(spark, sf)).groupBy("page_id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


@query("""with t as (select conv_id as page_id, role, turn, row_number() over (partition by conv_id order by turn) - 1 as addr from conversations),
n as (select page_id, count(*) as n from t group by 1),
s(k, op, text, speaker, falls, targets, labels) as (values (0, 'MENU', 'Pick', null, false, [1, 6], 'Yes,No'), (1, 'SPEAK', 'Yes', 'Player', true, [], ''), (2, 'JUMP_IF', 'has item', null, true, [4], 'has item'),
(3, 'JUMP', '', null, false, [7], ''), (4, 'SPEAK', 'Here.', 'Guide', true, [], ''), (5, 'JUMP', '', null, false, [7], ''), (6, 'SPEAK', 'No', 'Player', true, [], ''), (7, 'END', 'end', null, false, [], ''), (8, 'END', '', null, false, [], ''))
select page_id, addr::int as addr, 'SPEAK' as op, 'Turn ' || turn as text, null as section, case role when 'user' then 'Player' else 'Guide' end as speaker, true as falls, '' as targets, '' as labels, null::varchar as error from t
union all select page_id, (n + k)::int, op, text, 'Choice', speaker, falls, array_to_string(list_transform(targets, lambda x: x + n), ','), labels, null from n, s""")
def tree_flatten(spark, sf):
    return flat(dialogue.programs(dialogue.trees(_transcripts(spark, sf))))


@query("""select p_partkey as key, 'quest_state' as frame, 'quest=the quest;state=completed' as args from part union all
select p_partkey, 'has_item', 'count=' || (p_size + 1) || ';item=' || case p_name when 'red ring' then '{item}' else p_name end || ';neg=do not;where=bank' from part
where p_name = 'red ring' or not regexp_matches(p_name, '(^| )(ring|widget)($| )')""")
def condition_frames(spark, sf):
    said = F.concat(F.lit("If you don't have "), (F.col("p_size") + 1).cast("string"), F.lit(" "), F.col("p_name"), F.lit(" in your bank and the player has completed the quest."))
    found = conditions.parse_conditions(table(spark, sf, "part").select(F.col("p_partkey").alias("key"), said.alias("said")), "key", "said", {"ring": "item", "red ring": "item", "widget": "item"})
    args = F.array_join(F.transform(F.array_sort(F.map_entries("args")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("key", "frame", args.alias("args"))


@query("""select distinct conv_id as key, n_name as name, 'word' as type from conversations, (values ('tion'), ('heat'), ('that'), ('with')) t(n_name)
where regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || n_name || '($|[^\\p{L}\\p{N}])')""")
def entity_tags(spark, sf):
    names = spark.createDataFrame([("word", w) for w in ("Tion", "Heat", "That", "With", "12345", "the")], "type string, name string")
    tags = dialogue.tag_entities(table(spark, sf, "conversations").withColumnRenamed("conv_id", "key"), names, "key", "text")
    return tags.distinct()

from gleanery.plans import pages, relations, texts  # noqa: E402, F401 - registers its queries
