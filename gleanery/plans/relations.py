"""Queries over relations: further lookups, joins, aggregates, requirements, links and routes, writes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanery.cluster import shared_folder
from gleanery.operators import accounts, graphs, joins, links, lookups, requirements, sequences, sinks, spatial
from gleanery.operators.base import table, with_point
from gleanery.plans.registry import flat, query
from gleanery.streaming import events as streams

# --- lookups ---------------------------------------------------------------------------------------------------------


@query("select s_suppkey, s_name, s_nationkey from supplier")
def full_scan(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").orderBy("s_nationkey", "s_suppkey")


@query("select p_partkey, p_size from part where p_partkey = 7")
def alternate_key(spark, sf):
    return lookups.by_either(table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size")), "p_partkey", "p_size", 7).select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


_AT = "(select *, {k} * 7919 % 1000 as x, {k} * 104729 % 1000 as y from {t})"


@query(f"select c_custkey, x, y from {_AT.format(k='c_custkey', t='customer')} where x // 64 between 2 and 5 and y // 64 between 3 and 9")
def region_window(spark, sf):
    return lookups.region_window(with_point(table(spark, sf, "customer"), "c_custkey"), 2, 5, 3, 9).select("c_custkey", "x", "y")


@query("select n_nationkey from nation where lower(n_name) = 'nation_12'")
def same_name(spark, sf):
    return table(spark, sf, "nation").where(lookups.same_name(F.col("n_name"), "Nation_12")).select("n_nationkey")


@query("select event_id from events where nullif(event_type, 'click') is null")
def null_key(spark, sf):
    return lookups.by_key(table(spark, sf, "events").withColumn("version", F.nullif("event_type", F.lit("click"))), version=None).select("event_id")


@query("select o_orderkey from orders where nullif(o_orderstatus, 'F') is not null and nullif(o_custkey % 3, 0) is not null")
def placed_rows(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("x"), F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("y"))
    return lookups.placed(rows, "x", "y").select("o_orderkey")


@query("select p_partkey from part where nullif(p_partkey // 5, 0) is null")
def root_rows(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.nullif(F.floor(F.col("p_partkey") / 5), F.lit(0)).alias("parent_id"))
    return lookups.root_rows(rows).select("p_partkey")


@query("select p_partkey, lower(p_brand) || ',' || lower(p_type) as options, lower(p_type) = 'economy' as has from part")
def option_lists(spark, sf):
    said = F.concat(F.lower("p_brand"), F.lit(" , "), F.lower("p_type"), F.lit(","))
    return table(spark, sf, "part").select("p_partkey", F.array_join(lookups.option_list(said), ",").alias("options"), lookups.has_option(said, "Economy").alias("has"))


@query("select p_partkey from part where (contains(lower(p_name), 'ring') or contains(lower(p_name), 'bolt')) and not contains(lower(p_name), 'red') and p_type in ('ECONOMY', 'PROMO')")
def named_like(spark, sf):
    fits = lookups.named_like(F.col("p_name"), F.array("p_type"), ["ring", "bolt"], ["red"], ["ECONOMY", "PROMO"])
    return table(spark, sf, "part").where(fits).select("p_partkey")


@query("select p_partkey from part where contains(lower(p_name), 'ring') and p_size > 0 and p_type = 'ECONOMY' order by p_partkey limit 5")
def criteria_search(spark, sf):
    rows = table(spark, sf, "part").withColumn("text", F.col("p_name"))
    return lookups.widest(rows, 5, "p_partkey", text="Ring", p_type="ECONOMY", p_brand=None).select("p_partkey")


# --- joins -----------------------------------------------------------------------------------------------------------


def _places(spark, sf):
    left = with_point(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "x", "y")
    right = with_point(table(spark, sf, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return left, right


_FAR = f"(select c_custkey, s_suppkey as rid, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y))::double as distance from {_AT.format(k='c_custkey', t='customer')} c, {_AT.format(k='s_suppkey', t='supplier')} s)"


@query(f"select c_custkey, rid from {_FAR} where distance <= 35")
def within_euclidean(spark, sf):
    return joins.within(*_places(spark, sf), 35, "euclidean").select("c_custkey", "rid")


@query("select n_name as parent, p_partkey as child, p_name as label from nation join part on p_partkey % 25 = n_nationkey")
def edge_labels(spark, sf):
    edges = table(spark, sf, "part").select((F.col("p_partkey") % 25).cast("int").alias("n_nationkey"), F.col("p_partkey").alias("child"))
    labels = table(spark, sf, "part").select(F.col("p_partkey").alias("child"), F.col("p_name").alias("label"))
    return joins.detail_labels(table(spark, sf, "nation"), edges, "n_nationkey", labels, "child").select(F.col("n_name").alias("parent"), "child", "label")


@query("select s_suppkey, n_nationkey as id from supplier join nation on n_name = 'NATION_' || (s_nationkey * 2)")
def dictionary_join(spark, sf):
    said = F.concat(F.lit("NATION_"), (F.col("s_nationkey") * 2).cast("string"))
    known = table(spark, sf, "nation").select("n_name", "n_nationkey")
    return joins.dictionary(table(spark, sf, "supplier").select("s_suppkey", said.alias("name")), "name", known).select("s_suppkey", F.col("found").alias("id"))


@query(f"""with l as (select c_custkey, x, y, case c_custkey % 3 when 0 then 'S' || (c_custkey % 7) when 1 then 'S' || (c_custkey % 7) || ', cellar' else 'nowhere' end as name from {_AT.format(k='c_custkey', t='customer')}),
n as (select c_custkey, rid from (select l.c_custkey, s_suppkey as rid, row_number() over (partition by l.c_custkey order by greatest(abs(l.x - s.x), abs(l.y - s.y)), s_suppkey) as r from l, {_AT.format(k='s_suppkey', t='supplier')} s where l.name = 'nowhere') where r = 1)
select c_custkey, c_custkey % 7 as rid from l where name <> 'nowhere' union all select c_custkey, rid from n""")
def or_nearest(spark, sf):
    left, right = _places(spark, sf)
    key = F.col("c_custkey")
    own = F.concat(F.lit("S"), (key % 7).cast("string"))
    said = F.when(key % 3 == 0, own).when(key % 3 == 1, F.concat(own, F.lit(", cellar"))).otherwise("nowhere")
    known = right.withColumn("name", F.concat(F.lit("S"), F.col("rid").cast("string")))
    return joins.or_nearest(left.withColumn("name", said), "name", known).select("c_custkey", "rid")


@query("""select c_custkey, c_nationkey as id from customer where c_custkey % 4 < 2 union all
select c_custkey, n_nationkey from customer join nation on n_regionkey = c_custkey % 5 where c_custkey % 4 = 2""")
def expanded_lookup(spark, sf):
    key, name = F.col("c_custkey"), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    said = F.when(key % 4 == 0, name).when(key % 4 == 1, F.lower(name)).when(key % 4 == 2, F.concat(F.lit("all of "), (key % 5).cast("string"))).otherwise("none")
    nation = table(spark, sf, "nation")
    members = nation.select(F.concat(F.lit("all of "), F.col("n_regionkey").cast("string")).alias("category"), F.col("n_nationkey").alias("id"))
    rows = table(spark, sf, "customer").select("c_custkey", said.alias("name"))
    return joins.expanded_lookup(rows, "name", nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id")), members).select("c_custkey", "id")


@query("""select s_suppkey, case when k < 25 then 'physical' when k < 30 then 'virtual' end as kind, case when k < 30 then k end as id from
(select s_suppkey, coalesce(nullif(s_suppkey % 35, 34), 0) as k from supplier)""")
def either_target(spark, sf):
    said = F.concat(F.lit("NATION_"), F.nullif(F.col("s_suppkey") % 35, F.lit(34)).cast("string"))
    physical = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("k"))
    virtual = spark.range(25, 30).select(F.concat(F.lit("NATION_"), F.col("id").cast("string")).alias("n_name"), F.col("id").alias("k"))
    return joins.either_target(table(spark, sf, "supplier").select("s_suppkey", said.alias("name")), "name", physical, virtual, "NATION_0").select("s_suppkey", "kind", "id")


@query("select p_partkey, n_nationkey from part join nation on p_name || '' = p_name and n_name = 'NATION_' || (p_partkey % 40) where p_type = 'ECONOMY'")
def names_across_domains(spark, sf):
    part = table(spark, sf, "part").where("p_type = 'ECONOMY'").select("p_partkey", F.concat(F.lit("NATION_"), (F.col("p_partkey") % 40).cast("string")).alias("n_name"))
    return part.join(table(spark, sf, "nation"), "n_name").select("p_partkey", "n_nationkey")


@query("select s_suppkey, a, b from supplier, (values (1), (2)) u(a), (values (0), (5), (9)) v(b)")
def within_record(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.array(F.lit(1), F.lit(2)).alias("a"), F.array(F.lit(0), F.lit(5), F.lit(9)).alias("b"))
    return joins.within_record(rows, "s_suppkey", "a", "b")


# --- aggregates and order --------------------------------------------------------------------------------------------


@query("select l_suppkey % 7 as label, count(*) as n from lineitem group by 1")
def label_histogram(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("label")).agg(F.count("*").alias("n"))


@query("select o_custkey, o_orderstatus, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as orders from orders group by 1, 2")
def map_of_lists(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders"))


@query("select user_id, string_agg(event_type, ',' order by first) as types from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by 1")
def first_occurrences(spark, sf):
    seen = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda r: r["event_type"])
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(sequences.first_occurrences(seen), ",").alias("types"))


@query("select l_suppkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by 1")
def gathered_sets(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@query("select l_orderkey, count(distinct l_returnflag) = 1 as one from lineitem group by 1")
def all_equal(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("t")).select("l_orderkey", (F.size(F.array_distinct("t")) == 1).alias("one"))


@query("""select conv_id, turn, max(new) over (partition by conv_id order by turn) as start from
(select conv_id, turn, case when lag(role) over w is distinct from role then turn end as new from conversations window w as (partition by conv_id order by turn))""")
def block_starts(spark, sf):
    return sequences.block_starts(table(spark, sf, "conversations"), ["conv_id"], "turn", "role").select("conv_id", "turn", "start")


_PREFER = "coalesce({f}(b.event_id) filter (where b.value > 50), {f}(b.event_id))"


@query(f"""select a.event_id, {_PREFER.format(f='max')} as earlier, (select {_PREFER.format(f='min')} from events b where b.user_id = a.user_id and b.event_type = a.event_type and b.event_id > a.event_id) as later from events a
left join events b on a.user_id = b.user_id and a.event_type = b.event_type and b.event_id < a.event_id group by a.event_id, a.user_id, a.event_type""")
def nearest_equal_either_side(spark, sf):
    return sequences.nearest_equal_either_side(table(spark, sf, "events"), ["user_id", "event_type"], "event_id", F.col("value") > 50).select("event_id", "earlier", "later")


_DEPTH = "(select conv_id, turn, (turn * 7 + conv_id) % 3 + 1 as depth from conversations)"


@query(f"""select a.conv_id, a.turn, case when a.depth > 1 then (select max(b.turn) from {_DEPTH} b where b.conv_id = a.conv_id and b.turn < a.turn and b.depth = a.depth - 1
and not exists (select 1 from {_DEPTH} c where c.conv_id = a.conv_id and c.turn < a.turn and c.turn > b.turn and c.depth < a.depth - 1)) end as parent from {_DEPTH} a""")
def line_parents(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("turn") * 7 + F.col("conv_id")) % 3 + 1).cast("int").alias("depth"))
    return sequences.parents(rows, "conv_id", "turn", "depth", 3).select("conv_id", "turn", "parent")


@query("with recursive c as (select max(p_partkey) as node, 0 as height from part union all select node // 2, height + 1 from c where node > 0) select node, height from c")
def path_to_root(spark, sf):
    part = table(spark, sf, "part")
    nodes = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 2).cast("long")).alias("parent_id"))
    return graphs.ancestors(nodes, part.agg(F.max("p_partkey")).first()[0]).select("node", "height")


# --- requirements ----------------------------------------------------------------------------------------------------

_OPS = (">=", "<=", ">", "<", "==", "!=")
_KINDS = ("skill", "item", "varbit")


def _groups(spark, sf):
    n, group = F.col("l_linenumber"), (F.col("l_orderkey") * 2 + (F.col("l_linestatus") == "O").cast("int")).alias("group_id")
    op = F.get(F.array(*map(F.lit, _OPS)), (n + F.col("l_orderkey")) % 6).alias("operator")
    key, quantity = (F.col("l_partkey") % 10).alias("key"), F.col("l_quantity").cast("long")
    tables = {}
    for k, (kind, own, needed) in enumerate((("skill", "skill", "level"), ("item", "item_id", "quantity"), ("varbit", "var_id", "value"))):
        rows = table(spark, sf, "lineitem").where(n % 4 == k)
        tables[kind] = rows.select(group, key.alias(own), quantity.alias(needed), op)
    tables["quest"] = table(spark, sf, "lineitem").where(n % 4 == 3).select(group, key.alias("required_quest_id"))
    return requirements.typed_members(tables)


_MEMBERS = """(select l_orderkey * 2 + (l_linestatus = 'O')::int as group_id, ['skill', 'item', 'varbit', 'quest'][l_linenumber % 4 + 1] as kind, l_partkey % 10 as key,
case when l_linenumber % 4 = 3 then '>=' else ['>=', '<=', '>', '<', '==', '!='][(l_linenumber + l_orderkey) % 6 + 1] end as operator, case when l_linenumber % 4 = 3 then 1 else l_quantity::bigint end as needed from lineitem)"""
_MET = f"""(select *, case operator when '>=' then h >= needed when '<=' then h <= needed when '>' then h > needed when '<' then h < needed when '==' then h = needed else h <> needed end as met
from (select *, case when key = 9 then 0 else key * 5 end as h from {_MEMBERS}))"""


def _state(spark):
    kinds = F.explode(F.array(*map(F.lit, (*_KINDS, "quest"))))
    return spark.range(9).select(kinds.alias("kind"), F.col("id").alias("key"), (F.col("id") * 5).alias("have"))


@query(f"select group_id, kind, key, operator, needed from {_MEMBERS}")
def typed_members(spark, sf):
    return _groups(spark, sf)


@query(f"select group_id, kind, key, operator, needed, met from {_MET}")
def members_met(spark, sf):
    return requirements.met_by(_groups(spark, sf), _state(spark))


@query(f"select entity, bool_and(met) as available, count(*) filter (where not met) as unmet_groups from (select group_id // 2 as entity, group_id, bool_or(met) as met from {_MET} group by 1, 2) group by 1")
def requirements_of_an_account(spark, sf):
    met = requirements.met_by(_groups(spark, sf), _state(spark)).withColumn("entity", F.floor(F.col("group_id") / 2))
    return requirements.satisfied(met, "entity", "group_id", F.col("met"))


@query("select distinct l_orderkey * 2 + (l_linestatus = 'O')::int as group_id from lineitem where l_orderkey = 5")
def groups_of_an_entity(spark, sf):
    lines = table(spark, sf, "lineitem")
    group = F.col("l_orderkey") * 2 + (F.col("l_linestatus") == "O").cast("int")
    parents = lines.select(F.lit("quest").alias("entity_kind"), F.col("l_orderkey").alias("entity_id"), group.alias("group_id")).distinct()
    return requirements.groups_of(parents, "quest", 5)


@query("""select n_nationkey::bigint as entity_id, n_nationkey::bigint + 1 as group_id from nation union all
select s_nationkey, 25 + row_number() over (order by s_nationkey, s_suppkey) from supplier""")
def new_groups(spark, sf):
    have = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("entity_id"), (F.col("n_nationkey") + 1).cast("long").alias("group_id"))
    wanted = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("entity_id"), F.col("s_suppkey").alias("request"))
    return requirements.with_new_groups(have, wanted)


@query("""with d as (select distinct o_custkey as account, o_orderkey % 20 as quest from orders)
select account, skill, sum(amount)::bigint as xp from (select account, quest % 3 as skill, quest * 100 as amount from d where quest % 2 = 0
union all select account, account % 3, quest * 10 from d where quest % 2 = 1) group by 1, 2""")
def quest_rewards(spark, sf):
    done = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), (F.col("o_orderkey") % 20).alias("quest")).distinct()
    quests = spark.range(20).select(F.col("id").alias("quest"))
    fixed = quests.where("quest % 2 = 0").select("quest", (F.col("quest") % 3).alias("skill"), (F.col("quest") * 100).alias("amount"))
    lamps = quests.where("quest % 2 = 1").select("quest", F.lit(7).alias("mask"), (F.col("quest") * 10).alias("amount"))
    chosen = done.select("account", "quest", (F.col("account") % 3).alias("skill"))
    return accounts.rewards(done, fixed, chosen, lamps)


# --- links and routes ------------------------------------------------------------------------------------------------

_TYPES = ("fairy_ring", "walkable", "canoe", "shortcut", "teleport")
_LINKS = """(select l, ['fairy_ring', 'walkable', 'canoe', 'shortcut', 'teleport'][l % 5 + 1] as kind, case when l % 5 = 4 then 'ANYWHERE' else 'P' || (l % 25) end as src_place, 'P' || (l * 7 + 3) % 25 as dst_place,
case when l % 5 < 4 then l * 7919 % 1000 end as src_x, case when l % 5 < 4 then l * 104729 % 1000 end as src_y, case when l % 5 < 4 then l % 25 + 1 end as src_blob,
(l + 500) * 7919 % 1000 as dst_x, (l + 500) * 104729 % 1000 as dst_y, (l * 7 + 3) % 25 + 1 as dst_blob from (select n_nationkey::bigint as l from nation))"""


def _links(spark, sf):
    n = F.col("n_nationkey").cast("long")
    held = n % 5 < 4
    kind = F.get(F.array(*map(F.lit, _TYPES)), (n % 5).cast("int"))
    place = lambda c: F.concat(F.lit("P"), c.cast("string"))
    return table(spark, sf, "nation").select(
        n.alias("link"), kind.alias("kind"), F.when(held, place(n % 25)).otherwise(links.ANYWHERE).alias("src_place"), place((n * 7 + 3) % 25).alias("dst_place"),
        F.when(held, n * 7919 % 1000).alias("src_x"), F.when(held, n * 104729 % 1000).alias("src_y"), F.when(held, n % 25 + 1).alias("src_blob"),
        ((n + 500) * 7919 % 1000).alias("dst_x"), ((n + 500) * 104729 % 1000).alias("dst_y"), ((n * 7 + 3) % 25 + 1).alias("dst_blob"),
    )


def _ports(spark, sf):
    return with_point(table(spark, sf, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("port"), (F.col("s_nationkey") + 1).cast("long").alias("blob"), "x", "y")


def _walks(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").where("s_suppkey > 0").select(key.alias("src"), F.floor(key / 3).cast("long").alias("dst"), (key % 90 + 10).alias("weight"))


@query(f"select l as link, kind, dst_place from {_LINKS} where src_place = 'P2' and kind = 'canoe'")
def links_departing(spark, sf):
    return links.departing(_links(spark, sf), "P2", "canoe").select("link", "kind", "dst_place")


@query(f"select l as link, kind, src_place from {_LINKS} where dst_place = 'P10'")
def links_arriving(spark, sf):
    return links.arriving(_links(spark, sf), "P10").select("link", "kind", "src_place")


@query(f"select l as link from {_LINKS} where (src_place = 'P1' and dst_place = 'P10') or (src_place = 'P10' and dst_place = 'P1')")
def links_between(spark, sf):
    return links.between(_links(spark, sf), "P1", "P10").select("link")


@query(f"select dst_place, string_agg(l::varchar, ',' order by l) as links from {_LINKS} where src_place = 'ANYWHERE' group by 1")
def links_reachable(spark, sf):
    return flat(links.reachable_from(_links(spark, sf), links.ANYWHERE))


_NEAR = "greatest(abs({a}x - {b}x), abs({a}y - {b}y))"
_PORTS = f"(select s_suppkey as port, s_nationkey + 1 as blob, x, y from {_AT.format(k='s_suppkey', t='supplier')})"


@query(f"select port, l as \"end\", {_NEAR.format(a='p.', b='k.src_')}::bigint as weight from {_PORTS} p join {_LINKS} k on blob = src_blob")
def port_link_edges(spark, sf):
    ends = _links(spark, sf).where("src_blob is not null").select(F.col("link").alias("end"), F.col("src_blob").alias("blob"), F.col("src_x").alias("x"), F.col("src_y").alias("y"))
    return links.bipartite(_ports(spark, sf), ends)


def _route_sql(kinds: str) -> str:
    """Least cost of the way from (1, 2) in blob 4 to (900, 800) in blob 12, by keyed recursion."""
    c = lambda a, b: _NEAR.format(a=a, b=b)
    return f"""with recursive k as materialized (select * from {_LINKS} where {kinds}), p as materialized (select * from {_PORTS}),
    h as materialized (select * from k where src_place <> 'ANYWHERE'), j as materialized (select * from k where src_place = 'ANYWHERE'),
    e as materialized (select 'p' || s_suppkey as s, 'p' || s_suppkey // 3 as d, s_suppkey % 90 + 10 as w from supplier where s_suppkey > 0
    union all select 'p' || port, 'a' || l, {c('p.', 'h.src_')} from p join h on blob = src_blob union all select 'b' || l, 'p' || port, {c('k.dst_', 'p.')} from k join p on blob = dst_blob
    union all select 'a' || l, 'b' || l, case when kind in ('fairy_ring', 'canoe', 'teleport') then 0 else {c('src_', 'dst_')} end from h union all select 's', 'b' || l, 0 from j
    union all select 's', 'a' || l, greatest(abs(1 - src_x), abs(2 - src_y)) from h where src_blob = 4 union all select 'b' || l, 'g', greatest(abs(900 - dst_x), abs(800 - dst_y)) from k where dst_blob = 12
    union all select 's', 'p' || port, greatest(abs(1 - x), abs(2 - y)) from p where blob = 4 union all select 'p' || port, 'g', greatest(abs(900 - x), abs(800 - y)) from p where blob = 12),
    c(node, cost) using key (node) as (select 's', 0::bigint union select e.d, min(c.cost + e.w)::bigint from c join e on e.s = c.node left join recurring.c r on r.node = e.d where r.node is null or c.cost + e.w < r.cost group by 1)
    select cost from c where node = 'g'"""


def _route(spark, sf, kinds=None):
    return links.route(_ports(spark, sf), _walks(spark, sf), _links(spark, sf), (1, 2, 4), (900, 800, 12), kinds)


@query(_route_sql("true"))
def route_cost(spark, sf):
    return _route(spark, sf).agg(F.max("cost").alias("cost")).where("cost is not null")


@query(_route_sql("kind in ('walkable', 'canoe')"))
def route_cost_by_kinds(spark, sf):
    return _route(spark, sf, ["walkable", "canoe"]).agg(F.max("cost").alias("cost")).where("cost is not null")


@query()
def route_steps(spark, sf):
    return _route(spark, sf)


# --- tiles -----------------------------------------------------------------------------------------------------------

_CELLS = "(select c % 40 as x, c // 40 as y, c % 7 as component from (select c_custkey as c from customer where c_custkey % 3 <> 1) where c < 1600)"


def _cells(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").where("c_custkey % 3 <> 1 and c_custkey < 1600").select((c % 40).alias("x"), F.floor(c / 40).cast("long").alias("y"), (c % 7).alias("component"))


@query(f"""select id, component from (select s_suppkey as id, component, row_number() over (partition by s_suppkey order by greatest(abs(x - px), abs(y - py)), y - py, x - px) as r from
(select s_suppkey, s_suppkey * 13 % 40 as px, s_suppkey * 17 % 40 as py from supplier) join {_CELLS} on abs(x - px) <= 8 and abs(y - py) <= 8) where r = 1""")
def nearest_free_tile(spark, sf):
    key = F.col("s_suppkey")
    return spatial.nearest_free(table(spark, sf, "supplier").select(key.alias("id"), (key * 13 % 40).alias("x"), (key * 17 % 40).alias("y")), _cells(spark, sf))


@query(f"""with w as (select s_suppkey as id, s_suppkey * 13 % 40 as x, s_suppkey * 17 % 40 as y, s_suppkey % 4 as o from supplier),
m as (select w.id, a.component as a, b.component as b from w join {_CELLS} a on a.x = w.x and a.y = w.y join {_CELLS} b on b.x = w.x + [-1, 0, 1, 0][o + 1] and b.y = w.y + [0, 1, 0, -1][o + 1] where a.component <> b.component)
select id, a as src, b as dst from m union all select id, b, a from m""")
def gate_links(spark, sf):
    key = F.col("s_suppkey")
    walls = table(spark, sf, "supplier").select(key.alias("id"), (key * 13 % 40).alias("x"), (key * 17 % 40).alias("y"), (key % 4).cast("int").alias("orientation"))
    return spatial.gates(walls, _cells(spark, sf))


@query("""select p_partkey, case when f & 32 = 0 or p_partkey % 9 = 0 then f | 16 else f end as flags from
(select p_partkey, (((p_partkey * 7919 % 16777216)::int & 65280) | ((p_partkey * 7919 % 16777216)::int & 255)) as f from part)""")
def raster_flags(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", spatial.decode_flags((key * 7919 % 16777216).cast("int"), key % 9 == 0).alias("flags"))


@query(f"select floor(x / 16)::bigint as rx, floor(y / 16)::bigint as ry, count(*) as n, sum((y % 16 * 16 + x % 16) * component)::bigint as weight from {_CELLS} group by 1, 2")
def tile_regions(spark, sf):
    rows = spatial.tile_runs(_cells(spark, sf), 16)
    weight = F.aggregate(F.map_entries("cells"), F.lit(0).cast("long"), lambda a, e: a + e["key"] * e["value"])
    return rows.select("rx", "ry", F.size("cells").cast("long").alias("n"), weight.alias("weight"))


@query(f"select s_suppkey, coalesce(component, 0) as component from supplier left join {_CELLS} on x = s_suppkey * 13 % 40 and y = s_suppkey * 17 % 40")
def cell_read(spark, sf):
    key = F.col("s_suppkey")
    return spatial.cell_at(table(spark, sf, "supplier").select("s_suppkey", (key * 13 % 40).alias("x"), (key * 17 % 40).alias("y")), _cells(spark, sf)).select("s_suppkey", "component")


# --- writes ----------------------------------------------------------------------------------------------------------


@query("select s_suppkey, case when s_suppkey % 3 = 0 then -1 else s_nationkey end as s_nationkey from supplier")
def update_by_key(spark, sf):
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return sinks.update(suppliers, suppliers.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit(-1).alias("s_nationkey")), "s_suppkey", "s_nationkey")


@query("select n_nationkey, n_name from nation union all select n_nationkey, p_name from part join nation on n_nationkey = p_partkey % 50")
def insert_select(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    source = table(spark, sf, "part").select((F.col("p_partkey") % 50).cast("int").alias("n_nationkey"), "p_name")
    return sinks.insert_select(nation, source, "n_nationkey", {"n_nationkey": F.col("n_nationkey"), "n_name": F.col("p_name")})


@query("select s_suppkey, s_name from supplier where s_nationkey < 5")
def reload(spark, sf):
    path = f"{shared_folder(spark)}/reload-{uuid.uuid4().hex}"
    sinks.reloaded(path, table(spark, sf, "supplier").select("s_suppkey", "s_name"))
    return sinks.reloaded(path, table(spark, sf, "supplier").where("s_nationkey < 5").select("s_suppkey", "s_name"))


@query("select r_regionkey as id, r_name as name, null::varchar as label from region union all select n_nationkey, n_name, 'n' || n_regionkey from nation")
def schema_evolution(spark, sf):
    old = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    new = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("label"))
    return sinks.evolved(old, new)


@query("select distinct n_nationkey as key, 'alias ' || s_suppkey as alias from supplier join nation on n_nationkey = s_nationkey where s_suppkey % 2 = 0")
def page_aliases(spark, sf):
    name = lambda c: F.concat(F.lit("NATION_"), c.cast("string"))
    said = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("alias "), F.col("s_suppkey").cast("string"))).otherwise(name(F.col("s_nationkey")))
    redirects = table(spark, sf, "supplier").select(name(F.col("s_nationkey")).alias("target"), said.alias("alias"))
    return sinks.aliases(redirects, table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))


@query("select n_regionkey, string_agg('* ' || n_name || ' (' || n_nationkey || ')', chr(10) order by n_nationkey) as report from nation group by 1")
def report_text(spark, sf):
    line = F.concat(F.lit("* "), F.col("n_name"), F.lit(" ("), F.col("n_nationkey").cast("string"), F.lit(")"))
    return sinks.report(table(spark, sf, "nation"), ["n_regionkey"], line, "n_nationkey")


# --- event state -----------------------------------------------------------------------------------------------------


@query("""select user_id % 50 as name, ts, ts + interval 3600 second as ends from (select user_id, ts, event_type, lead(ts) over (partition by user_id % 50 order by ts, case when event_type = 'click' then 'start' else 'cancel' end, event_id) as nxt from events)
where event_type = 'click' and (nxt is null or nxt >= ts + interval 3600 second)""")
def named_timers(spark, sf):
    action = F.when(F.col("event_type") == "click", "start").otherwise("cancel")
    return streams.timers(table(spark, sf, "events").select((F.col("user_id") % 50).alias("name"), "ts", action.alias("action")), 3600)


@query("select user_id, string_agg(k, ',' order by k) as marks from (select user_id, event_type as k, max_by(value, event_id) as v from events group by 1, 2) where v > 50 group by 1")
def marker_sets(spark, sf):
    marks = table(spark, sf, "events").select("user_id", F.col("event_type").alias("mark"), "event_id", (F.col("value") > 50).alias("add"))
    return flat(streams.marker_sets(marks, "user_id", "mark", "event_id", "add"))


@query("select name from (select 'a/' || (p_partkey % 3) || '/' || p_partkey as name, p_partkey % 3 as parent from part where p_partkey < 60 ) qualify row_number() over (partition by parent order by name) > 10 union all select 'a/b/c/d/e'")
def actor_limits(spark, sf):
    key = F.col("p_partkey")
    names = table(spark, sf, "part").where("p_partkey < 60").select(F.concat(F.lit("a/"), (key % 3).cast("string"), F.lit("/"), key.cast("string")).alias("name"))
    return streams.actor_limits(names.unionByName(spark.createDataFrame([("a/b/c/d/e",)], "name string")), 3, 10)
