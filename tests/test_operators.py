"""Operators on hand-made rows: what the supplied tables don't show."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from gleanery.functions import conditions, dialogue, game, markup, numeric
from gleanery.operators import graphs, joins, lookups, sequences, sinks, spatial
from gleanery.sources import readers
from gleanery.streaming import events


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(f(F.col("v"))).collect()]


def test_markup(spark):
    assert one(spark, markup.snake_case, "Cook's Assistant", "Dragon Slayer I", "  A--b ") == ["cooks_assistant", "dragon_slayer_i", "a_b"]
    assert one(spark, markup.strip_links, "[[A|b]] and [[C]]") == ["A and C"]
    assert one(spark, markup.strip_markup, "'''[[A|b]]''' {{x|y}}c") == ["b c"]
    assert one(spark, lambda c: markup.clean_reference(c, F.lit("Page")), "{{PAGENAME}} a#b", "x{{!}}") == ["Page a", "x"]
    assert one(spark, markup.intro, "a\nb\n== H ==\nc") == ["a\nb"]
    assert one(spark, markup.heading_depth, "== H ==", "text", "===x===") == [2, 0, 3]
    assert one(spark, lambda c: markup.has_word(c, "ring"), "a ring.", "string", "RING") == [True, False, True]
    assert one(spark, markup.floor_of, "2nd floor", "Cellar", None) == [2, 0, 0]
    assert [tuple(x) if x else None for x in one(spark, lambda c: markup.content_tag(c, ["quest"]), "quest:a:b", "other:a", "quest:", "x")] == [("quest", "a:b"), None, None, None]


def test_nested_templates():
    text = "x {{Infobox Item|a={{b|c=d}}|e|name = [[f|g]]|empty=}} {{infobox item|z}} {{Infobox Item Two|q}} {{Infobox Item|open"
    assert list(markup.templates(text, "Infobox Item")) == ["a={{b|c=d}}|e|name = [[f|g]]|empty=", "z"]
    assert markup.parameters("a={{b|c=d}}|e|name = [[f|g]]|empty=") == ({"a": "{{b|c=d}}", "name": "[[f|g]]"}, ["e"])
    assert markup.versioned({"hp": "1", "hp2": "3"}, "hp", 2) == "3" and markup.versioned({"hp": "1"}, "hp", 2) == "1"
    assert markup.expand("{{sic|{{colour|red|a}}}} '''b''' [[c|d]] {{x|y}}") == "a b d"
    assert markup.expand(markup.expand("{{gender|he|she}} {{plink|Z|pic=1}}")) == "he Z"


def test_numbers(spark):
    assert one(spark, numeric.parse_int, "1,234", "+5%", "x", "", None) == [1234, 5, None, None, None]
    assert one(spark, numeric.parse_xp, "1,234.5", "-1", "x", None, "3") == [1234.5, 0.0, 0.0, 0.0, 3.0]
    assert one(spark, numeric.parse_ticks, "1,200", "N/A", "varies", "3 ticks") == [1200, None, None, None]
    assert one(spark, numeric.parse_count, "2,000", "Three", "many") == [2000, 3, 1]
    assert one(spark, numeric.parse_flag, "Yes", "no", "?") == [True, False, None]
    assert [[tuple(p) for p in x] for x in one(spark, numeric.coordinates, "|x = 1|y=2|3333,4444", "x:1,y:2 x:3,y:4", "|123,4567|12,13", "none")] == [[(1, 2)], [(1, 2), (3, 4)], [(123, 4567)], []]
    assert [[tuple(p) for p in x] for x in one(spark, numeric.skill_levels, "{{SCP|Magic|55}} {{SCP|Mining|120}} {{SCP|Agility|9|link=yes}}")] == [[("magic", 55), ("agility", 9)]]
    mask = lambda c: numeric.skills_mask(c, {"Attack": 1, "Magic": 2, "Mining": 4}, {"combat": ["Attack", "Magic"]})
    assert one(spark, mask, "Mining", "combat, mining", "x") == [4, 7, 0]


def test_game(spark):
    xp = game.thresholds()
    assert (len(xp), xp[0], xp[1], xp[98]) == (99, 0, 83, 13034431)
    rows = spark.createDataFrame([(99, 99, 99, 99, 99, 99, 99), (1, 1, 1, 10, 1, 1, 1), (60, 70, 50, 65, 1, 1, 43)], "a int, s int, d int, h int, r int, m int, p int")
    assert [r[0] for r in rows.select(game.combat_level(*map(F.col, "asdhrmp"))).collect()] == [126, 3, 76]
    hits = spark.createDataFrame([("magic_defensive", 10, 5.5), ("melee_controlled", 3, 5.5)], "style string, damage int, spell_xp double")
    got = {(r.style, r.skill): round(r.xp, 6) for r in game.combat_xp(hits).collect()}
    assert got["magic_defensive", "magic"] == 18.8 and got["magic_defensive", "hitpoints"] == 13.3 and got["melee_controlled", "attack"] == 3.99
    with pytest.raises(Exception, match="1 to 99"):
        spark.range(1).select(game.xp_for_level(F.lit(100))).collect()


def test_conditions():
    names = {"abyssal whip": "item", "whip": "item", "cook's assistant": "quest", "lumbridge": "location"}
    read = lambda t: conditions.atoms(conditions.normalise(t, names), unknown=True)
    assert read("If you don't have an Abyssal whip.") == [("has_item", {"count": "an", "item": "{item}", "neg": "do not"})]
    assert read("the player has completed Cook's Assistant") == [("quest_state", {"quest": "{quest}", "state": "completed"})]
    assert [f for f, _ in read("the player is wearing a whip and has at least 1,000 coins")] == ["wearing", "has_coins"]
    assert read("the player is in Lumbridge") == [("location_at", {"place": "{location}"})]
    frames = {"the player is on a PvP world": "world_type", "you've planted a herb": "patch_planted", "the door is locked": "world_state", "you have completed all the tasks": "all_completed", "you took": "unknown", "you have opened the chest": "has_event_action", "the player is too far from the bank": "proximity_check"}
    assert {t: read(t)[0][0] for t in frames} == frames
    assert read("zzz qqq") == [("unknown", {"text": "zzz qqq"})]


def test_jumps_land_where_a_walk_ends():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 14)
        kinds = [rng.choice(["JUMP", "MENU", "SPEAK", "GOTO"]) for _ in range(n)]
        size = {"JUMP": 1, "MENU": 3, "SPEAK": 0, "GOTO": 0}
        program = [dialogue.Instruction(k, targets=[rng.randrange(n + 1) for _ in range(size[k])], labels=[rng.choice("ab") for _ in range(size[k] - rng.randint(0, 1))] if k == "MENU" else []) for k in kinds]

        def walk(at, label):
            met = set()
            while at < n and at not in met:
                met.add(at)
                x = program[at]
                if x.op in ("JUMP", "GOTO") and x.targets:
                    at = x.targets[0]
                elif x.op == "MENU" and label in x.labels:
                    at = x.targets[x.labels.index(label)]
                else:
                    break
            return at

        for x, y in zip(program, dialogue.thread(program)):
            labels = [*(x.labels if x.op == "MENU" else []), None, None, None]
            assert y.targets == [walk(t, label) for t, label in zip(x.targets, labels)]


def test_dialogue_passes():
    menu = dialogue.Instruction("MENU", falls=False, targets=[2, 4], labels=["Yes", "No"])
    speak = lambda t, who=None: dialogue.Instruction("SPEAK", t, speaker=who)
    jump = lambda t: dialogue.Instruction("JUMP", falls=False, targets=[t])
    program = [dialogue.Instruction("SELECT", "Pick"), menu, speak("Yes", "Player"), jump(5), speak("b"), jump(6), dialogue.Instruction("END", falls=False), speak("lost")]
    assert [x.targets for x in dialogue.thread(program)][3] == [6]
    titled = dialogue.title_menus(program)
    assert titled[0].dead and titled[1].text == "Pick"
    assert not any(x.dead for x in dialogue.sweep(program))  # what follows an end is an entry of its own
    small = dialogue.compact(dialogue.sweep(dialogue.collapse(dialogue.thread(dialogue.resolve_gotos(titled[:-1])))))
    assert [x.op for x in small] == ["MENU", "SPEAK", "JUMP", "SPEAK", "END"] and small[0].targets == [1, 3] and small[2].targets == [4]
    nodes = dialogue.parse_tree("== A ==\n* '''Guide:''' Hi\n* {{topt|Yes}}\n** Ok\n* {{topt|No}}\n== B ==\n* x\n*** deep")
    assert [(n["parent_id"], n["depth"], n["node_type"], n["section"]) for n in nodes] == [(None, 1, "line", "A"), (None, 1, "option", "A"), (1, 2, "line", "A"), (None, 1, "option", "A"), (None, 1, "line", "B"), (4, 3, "line", "B")]


def test_tagging(spark):
    texts = spark.createDataFrame([(1, "A Red Ring and a string"), (2, "redring ring-ring"), (3, None)], "key long, text string")
    names = spark.createDataFrame([("item", "Red ring"), ("item", "ring"), ("npc", "ring"), ("item", "1234"), ("item", "a")], "type string, name string")
    want = {(1, "item", "red ring"), (1, "item", "ring"), (1, "npc", "ring"), (2, "item", "ring"), (2, "npc", "ring")}
    assert {tuple(r) for r in dialogue.tag_entities(texts, names, "key", "text").collect()} == want
    assert {tuple(r) for r in dialogue._tag_by_join(texts, names, "key", "text", 4).collect()} == want


def test_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 30), rng.randint(0, 30), rng.randint(1, 9)) for _ in range(60)]
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    cost = {0: 0}
    queue = deque([0])
    while queue:
        a = queue.popleft()
        for b, w in near.get(a, []):
            if cost[a] + w < cost.get(b, 10**9):
                cost[b] = cost[a] + w
                queue.append(b)
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    best = graphs.shortest_paths(df, spark.range(1))
    assert {r.node: r.cost for r in best.collect()} == cost
    target = max(cost, key=cost.get)
    steps = graphs.path_steps(best, target).orderBy("step").collect()
    assert steps[0].node == 0 and steps[-1].node == target and steps[-1].cost == cost[target]
    assert graphs.path_steps(best, 999).count() == 0
    levels = {r.node: r.level for r in graphs.dependency_levels(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (6, 4)], "src long, dst long")).collect()}
    assert levels == {3: 0, 2: 1, 1: 2}
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "id long, parent_id long")
    assert {r.node: r.height for r in graphs.ancestors(nodes, 3).collect()} == {3: 0, 2: 1, 1: 2}


def test_moves_match_the_rules(spark):
    rng = random.Random(2)
    grid = {(x, y): rng.choice([32, 33, 34, 36, 40, 48, 32 | 256, 32 | 1024, 32]) for x in range(7) for y in range(7)}
    free = lambda p, bits: not grid[p] & bits
    want = set()
    for (x, y), f in grid.items():
        for dx, dy, h, v, cs, cd in spatial.STEPS:
            t = (x + dx, y + dy)
            if t not in grid or f & (h | v | cs) or grid[t] & (spatial.FULL | cd):
                continue
            if dx and dy and not (free((x + dx, y), spatial.FULL | v) and free((x, y + dy), spatial.FULL | h)):
                continue
            want.add((x, y, *t))
    tiles = spark.createDataFrame([(x, y, f) for (x, y), f in grid.items()], "x int, y int, flags int")
    assert {tuple(r) for r in spatial.moves(tiles).collect()} == want
    cells = {(r.x, r.y): r.component for r in spatial.walkable_components(tiles, corners=True).collect()}
    assert set(cells) == {p for p, f in grid.items() if not f & 16}
    assert all(cells[a, b] == cells[c, d] for a, b, c, d in want if (a, b) in cells)
    points = spark.createDataFrame([(1, 3, 3)], "id int, x int, y int")
    assert spatial.nearest_free(points, spatial.walkable_components(tiles)).count() == 1
    assert one(spark, lambda c: spatial.decode_flags(c.cast("int"), F.lit(False)), "8225", "1") == [8225, 17]


def test_ports_are_runs_on_the_border(spark):
    cells = spark.createDataFrame([(x, y, 1) for x in range(4) for y in range(6) if (x, y) != (2, 3)], "x int, y int, component long")
    owned = spark.createDataFrame([(x, y, 7 if x < 2 else 9) for x in range(4) for y in range(6)], "x int, y int, owner int")
    assert sorted((r.x, r.y, r.width) for r in spatial.ports(cells, owned).collect()) == [(1, 1, 3), (1, 4, 2)]


def test_joins_and_writes(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    old, new = df([(1, "a"), (None, "n")], "k int, v string"), df([(1, "x"), (2, "y"), (2, "z"), (None, "q")], "k int, v string")
    assert sorted(map(repr, map(tuple, sinks.insert_or_ignore(old, new, ["k"], "v").collect()))) == ["(1, 'a')", "(2, 'y')", "(None, 'n')"]
    assert {r.k: r.v for r in sinks.insert_or_replace(old, new, ["k"], "v").collect()} == {1: "x", 2: "z", None: "q"}
    assert {r.k: r.v for r in sinks.update(old, df([(1, "u")], "k int, v string"), "k", "v").collect()} == {1: "u", None: "n"}
    known = df([(1, "A"), (2, "B")], "id int, name string")
    redirects = df([("A", "x"), ("B", "A"), ("C", "y")], "target string, alias string")
    assert [tuple(r) for r in sinks.aliases(redirects, known).collect()] == [(1, "x")]
    left, right = df([(1, 0, 0), (2, 900, 900)], "c_custkey int, x int, y int"), df([(5, 10, 0), (4, 0, 10), (6, -900, 3)], "rid int, rx int, ry int")
    for small in (100, 0):
        assert {(r.c_custkey, r.rid, r.distance) for r in joins.nearest(left, right, small=small, cell=4).collect()} == {(1, 4, 10), (2, 4, 900)}
    assert joins.nearest(left, right.limit(0)).count() == 0
    assert lookups.search(df([("a_b",), ("axb",), ("É",)], "n string"), "n", "A_B", wildcards=False).count() == 1
    rows = sequences.parents(df([(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 0), (1, 4, 2), (1, 5, 1)], "page int, id int, depth int"), "page", "id", "depth", 2)
    assert {r.id: r.parent for r in rows.collect()} == {0: None, 1: 0, 2: 1, 3: None, 4: None, 5: 3}


def test_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "objects.json").write_text("[[1, 2, 3], [4, 5, 6]]")
    rows = readers.json_rows(spark, str(tmp_path / "objects.json"), "game_id int, x int, y int")
    assert sorted(map(tuple, rows.collect())) == [(1, 2, 3), (4, 5, 6)]
    (tmp_path / "vars").mkdir()
    (tmp_path / "vars" / "a.json").write_text('{"type": "varbit",\n "entries": [{"id": 1, "name": "n"}]}')
    assert [tuple(r) for r in readers.json_entries(spark, str(tmp_path / "vars"), "id int, name string").collect()] == [("varbit", 1, "n")]
    (tmp_path / "tiles").mkdir()
    (tmp_path / "tiles" / "0_50_51.png").write_bytes(b"p")
    (tmp_path / "tiles" / "other.png").write_bytes(b"q")
    assert [tuple(r) for r in readers.tile_files(spark, str(tmp_path / "tiles")).collect()] == [(0, 50, 51, bytearray(b"p"))]
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("dir/1_2_3.png", b"z")
    assert [tuple(r) for r in readers.tile_archive(spark, str(tmp_path / "t.zip")).collect()] == [(1, 2, 3, bytearray(b"z"))]
    cache = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1), ("b", "2023-01-01 00:00:00", 1), ("c", "2023-01-01 00:00:00", 1)], "title string, fetched_at string, revid int").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    asked = spark.createDataFrame([(t,) for t in "abcd"], "title string")
    got = readers.freshness(cache, asked, "2024-01-01 10:00:00", 86400, spark.createDataFrame([("b", 1), ("c", 2)], "title string, revid int"))
    assert {r.title: r.state for r in got.collect()} == {"a": "hit", "b": "valid", "c": "stale", "d": "miss"}
    assert list(readers.paged(lambda t: ([t or 0], (t or 0) + 1 if (t or 0) < 3 else None))) == [0, 1, 2, 3]
    assert list(readers.in_batches([1, 2, 3], lambda k: [len(k)], 2)) == [2, 1]


def test_actors(spark):
    actors = spark.createDataFrame([("a",), ("a/b",), ("a/c",), ("a/d",), ("a/b/c/d",)], "name string")
    assert {r.name for r in events.actor_limits(actors, 2, 2).collect()} == {"a/d", "a/b/c/d"}
    marks = spark.createDataFrame([("t", "2024-01-01 00:00:00", "start"), ("t", "2024-01-01 00:00:05", "cancel"), ("u", "2024-01-01 00:00:00", "start")], "name string, ts string, action string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.name for r in events.timers(marks, 10).collect()] == ["u"]
