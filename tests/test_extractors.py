import pytest
from pyspark.sql import functions as F

from gleanery.sources import extractors


def pages(spark, *texts):
    return spark.createDataFrame([(f"P{k}", t) for k, t in enumerate(texts)], "title string, wikitext string")


def test_versions_share_what_has_no_number(spark):
    text = "{{Infobox Monster|version1=Low|version2=High|name=Imp|combat1=2|combat2=1,007|hitpoints=8|members1=No|id1=5,6|id2=7|max hit=1<ref>x</ref>}}"
    rows = {r.version: r for r in extractors.extract(pages(spark, text, None, "nothing"), "monster").collect()}
    assert set(rows) == {"Low", "High"}
    assert (rows["Low"].combat_level, rows["High"].combat_level, rows["High"].hitpoints, rows["Low"].max_hit) == (2, 1007, 8, "1")
    assert rows["Low"].members is False and rows["High"].members is True and rows["Low"].ids == [5, 6, 7]


def test_items_lines_and_coordinates(spark):
    text = "{{Infobox Item|name=[[Pot|pot]]|value=1,200|weight=0.5 kg|tradeable=Yes|members=no|id=3}} {{StoreLine|name=[[Pot]]|stock=5|restock=10}}{{StoreLine|name=Jug|stock=∞}} {{ItemSpawnLine|name=Pot|location=[[Inn|the inn]]|3012,3200|x:1,y:2}} {{DropsLine|name=Pot|rarity=1/128}}{{DropsLineClue|name=Clue}}"
    df = pages(spark, text)
    item = extractors.extract(df, "item").first()
    assert (item["name"], item.value, item.weight, item.tradeable, item.members, item.ids, item.version) == ("pot", 1200, 0.5, True, False, [3], None)
    assert [(r.position, r.item_name, r.stock, r.restock) for r in extractors.extract(df, "store_line").orderBy("position").collect()] == [(0, "Pot", "5", 10), (1, "Jug", "∞", None)]
    spawn = extractors.extract(df, "ground_item").first()
    assert spawn.location == "Inn" and [tuple(c) for c in spawn.coordinates] == [(1, 2)]
    assert sorted(r.item_name for r in extractors.extract(df, "drop").collect()) == ["Clue", "Pot"]


def test_skills_runes_aliases_and_classifier(spark):
    df = pages(spark, "{{Quest details|requirements=* {{SCP|Magic|33}} {{SCP|Mining|5}}}} {{Infobox Spell|name=Bolt|level=17|cost=1 {{plink|Chaos rune}} 2{{Plink|Air rune|pic=x}}}}")
    assert sorted(tuple(r)[1:] for r in extractors.requirement_rows(extractors.extract(df, "quest_details")).collect()) == [("magic", 33), ("mining", 5)]
    assert sorted(tuple(r)[1:] for r in extractors.rune_costs(extractors.extract(df, "spell")).collect()) == [("Air rune", 2), ("Chaos rune", 1)]
    names = spark.createDataFrame([(1, "Sword (a)"), (2, "Sword (b)"), (3, "Axe (x)"), (4, "Helm"), (5, "Helm (t)")], "id int, name string")
    assert [tuple(r) for r in extractors.base_names(names).collect()] == [(1, "Sword")]
    answer = spark.createDataFrame([("a | Quest, nope\nplain\nb|quest",)], "t string")
    good, bad = extractors.classifier_rows(answer, "t", spark.createDataFrame([("quest",)], "tag string"))
    assert sorted(map(tuple, good.collect())) == [("a", "quest"), ("b", "quest")] and [tuple(r) for r in bad.collect()] == [("a", "nope")]


@pytest.mark.parametrize("name", sorted(extractors.RECORDS))
def test_every_record_runs_on_any_text(spark, name):
    text = "".join(f"{{{{{t}|name=x|version1=a|1,2|id=4}}}}" for t in extractors.RECORDS[name].templates)
    rows = extractors.extract(pages(spark, text, "", None), name)
    assert rows.count() == len(extractors.RECORDS[name].templates)
    assert rows.where(F.col("title") != "P0").isEmpty()
