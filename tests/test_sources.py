from __future__ import annotations

import json

from galley.operators import corpus as C
from galley.sources import files


def test_article_files(spark, tmp_path):
    for lang, name, text in (
        ("en", "b two+x.md", '---\ntitle: "Two"\nlang: "en"\nauthor:\n  - "[[Ann]]"\ntag:\n  - "[[AI]]"\n---\n# Two\n\nBody\n\n## Part\ntext\n'),
        ("en", "a.md", "no front matter\n"),
        ("en", ".hidden.md", "x"),
        ("nl", "c.md", '---\ntitle: "Drie"\npublished: 2020-01-13\ndescription: "Over [[X]]"\n---\nTekst\n\n## Lees meer\n- x\n'),
    ):
        (tmp_path / lang).mkdir(exist_ok=True)
        (tmp_path / lang / name).write_text(text, encoding="utf-8")
    read = files.read_articles(spark, str(tmp_path))
    rows = {(r.corpus, r.slug) for r in read.collect()}
    assert rows == {("corpus_en", "a"), ("corpus_en", "b two+x"), ("corpus_nl", "c")}
    nodes = {(r.corpus, r.node_id): r for r in C.flatten(C.article_trees(read)).collect()}
    assert nodes["corpus_en", "0000"].title == "a"
    assert nodes["corpus_en", "0001"].text == "# Two\n\nBody\n\n## Part\ntext\n"
    child = nodes["corpus_en", "0001.0001"]
    assert (child.title, child.article_title, child.line_num, child.root_tags) == ("Part", "Two", 3, ["AI"])
    dutch = nodes["corpus_nl", "0000"]
    assert (dutch.text, dutch.prefix_summary, dutch.published) == ("# Drie\n\nTekst\n", "Over X", "2020-01-13")


def test_tree_files(spark, tmp_path):
    root = {"node_id": "g", "title": "Guide", "text": "t", "source": "url", "nodes": [{"node_id": "g.1", "title": "P", "text": "p"}]}
    for name, data in (("a.json", [root]), ("b.json", {"doc_name": "d", "structure": [root, {**root, "node_id": "h", "nodes": []}]})):
        (tmp_path / name).write_text(json.dumps(data, indent=1))
    one = C.flatten(files.read_tree_assets(spark, str(tmp_path / "a.json"), "guide")).collect()
    assert [(r.node_id, r.article_title, r.source_url) for r in one] == [("g", "Guide", "url"), ("g.1", "Guide", "url")]
    assert C.flatten(files.read_tree_assets(spark, str(tmp_path / "b.json"), "guide")).count() == 3


def test_kpi_file_defaults(spark, tmp_path):
    (tmp_path / "k.json").write_text(json.dumps({"kpis": [{"id": "a", "name": "A"}, {"id": "b", "name": "B", "weight": "High", "relevance": {"human": None}}]}))
    rows = {r.id: r for r in files.read_kpis(spark, str(tmp_path / "k.json")).collect()}
    assert (rows["a"].weight, rows["a"].monitoring, rows["a"].relevance) == ("Medium", "Optional", {})
    assert rows["b"].weight == "High"


def test_profiles_coerce_and_reject(spark, tmp_path):
    lines = [
        {"id": "w", "name": "W", "description": "d", "category": "workflow", "activates_on": {"intent_codes": "T1_DRAFT"}, "knowledge": ["x", "y"]},
        {"id": "e", "name": "E", "description": "d", "category": "domain_expert", "activates_on": {"sector": "S", "topic_keywords": ["k"]}},
        {"id": "q", "name": "Q", "description": "d", "category": "other"},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    good, bad = files.read_profiles(spark, str(tmp_path / "p.json"))
    rows = {r.id: r for r in good.collect()}
    assert rows["w"].codes == ["T1_DRAFT"] and rows["w"].knowledge == ["x", "y"] and rows["w"].skills == []
    assert rows["e"].sector == "S" and rows["e"].keywords == ["k"]
    assert [r.id for r in bad.collect()] == ["q"]


def test_a_changed_profile_table_changes_the_match(spark):
    from galley.operators import profiles as P

    intents = spark.createDataFrame([(["T1_DRAFT"], None, [])], "task_codes array<string>, sector string, topic_keywords array<string>")
    table = spark.createDataFrame([("w", "W", "workflow", ["T1_DRAFT"], None, []), ("a", "A", "workflow", ["T1_DRAFT"], None, [])],
                                  "id string, name string, category string, codes array<string>, sector string, keywords array<string>")
    assert [p.id for p in P.select_profiles(intents, table).first().workflow] == ["a", "w"]
    assert [p.id for p in P.select_profiles(intents, table.where("id = 'w'")).first().workflow] == ["w"]
