"""Trees of any depth and changes in order, next to plain Python."""

from __future__ import annotations

import json
import random

import pytest

from galley.operators import profiles as P
from galley.operators import scale
from galley.operators import trees as D

NODE = "corpus string, node_id string, parent_id string, ord int, title string, source_url string, text string, depth_hint int"


def walk_by_hand(rows):
    nodes = {(r[0], r[1]): r for r in rows}
    out = {}
    for key, r in nodes.items():
        chain, now = [], r
        while now is not None and len(chain) <= len(rows):
            chain.append(now)
            if now[2] is None:
                break
            now = nodes.get((r[0], now[2]))
        if now is None or now[2] is not None:
            continue
        titles = [n[4].strip() for n in reversed(chain) if n[4] and n[4].strip()]
        links = [n[5].strip() for n in chain if n[5] and n[5].strip()]
        out[key] = (chain[-1][1], len(chain), [n[3] for n in reversed(chain)], titles[0] if titles else None, links[0] if links else None)
    return out


def bush(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        up = None if i % 40 == 0 else str(rnd.randrange(i - i % 40, i))
        rows.append(("a", str(i), up, i, rnd.choice([None, "", " t ", f"T{i}"]), rnd.choice([None, " ", f"http://{i}"]), f'line "{i}"\nnext', 0))
    return rows


def test_bushes_chains_and_lost_nodes(spark):
    chain = [("b", f"c{i}", f"c{i - 1}" if i else None, 0, f"C{i}" if i == 3 else None, "http://b" if i in (0, 100) else None, "x", 0) for i in range(200)]
    lost = [("c", "x", "gone", 0, "X", None, "x", 0), ("c", "y", "x", 0, "Y", None, "x", 0), ("c", "r", None, 0, "R", None, "x", 0),
            ("c", "p", "q", 0, "P", None, "x", 0), ("c", "q", "p", 0, "Q", None, "x", 0), ("c", "s", "s", 0, "S", None, "x", 0), ("c", "t", "s", 0, "S", None, "x", 0)]
    rows = bush(1) + chain + lost
    walked, rejected = D.walk(spark.createDataFrame(rows, NODE).repartition(5), deepest=300)
    got = {(r.corpus, r.node_id): (r.root_id, r.depth, list(r.path), r.article_title, r.source_url) for r in walked.collect()}
    assert got == walk_by_hand(rows)
    assert got["b", "c199"][1] == 200 and got["b", "c199"][3:] == ("C3", "http://b")
    assert {(r.node_id, r.reason) for r in rejected.collect()} == {("x", D.NO_PARENT), ("y", D.NO_PARENT), *((n, D.TOO_DEEP) for n in "pqst")}


def test_too_deep_is_rejected(spark):
    rows = [("b", f"c{i}", f"c{i - 1}" if i else None, 0, None, None, "x", 0) for i in range(60)]
    walked, rejected = D.walk(spark.createDataFrame(rows, NODE), deepest=20)
    assert walked.count() + rejected.select("node_id").distinct().count() == 60
    assert walked.agg({"depth": "max"}).first()[0] >= 20 and rejected.where("reason <> 'circle of parents, or more levels than allowed' and reason <> 'parent not found'").count() == 0


@pytest.fixture
def uneven(spark):
    """Small ranges are not put together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("stretch", [3, 8192])
def test_objects_are_json_and_come_back(spark, tmp_path, monkeypatch, stretch):
    monkeypatch.setattr(D, "STRETCH", stretch)
    rows = bush(2) + [('q"uote', "1", None, 1, "only", None, "", 0)] + [("b", f"c{i}", f"c{i - 1}" if i else None, 0, None, None, "x", 0) for i in range(200)]
    walked = D.walk(spark.createDataFrame(rows, NODE).repartition(4))[0].cache()
    path = str(tmp_path / "out")
    D.write_tree_objects(walked, path)
    files = sorted(tmp_path.rglob("*.txt"))
    assert len(files) == 3
    for f in files:
        whole = json.loads(f.read_text())
        roots = [r for r in rows if r[0] == whole["doc_name"] and r[2] is None]
        assert [n["node_id"] for n in whole["structure"]] == [r[1] for r in sorted(roots, key=lambda r: r[3])]
        assert whole["line_count"] == sum(r[6].count("\n") for r in roots) + 4 * (len(roots) - 1)
    back = D.read_tree_objects(spark, path)
    columns = ("node_id", "root_id", "parent_id", "depth", "title", "article_title", "own_url", "source_url", "text")
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    assert key(back) == key(walked)
    order = [r.node_id for r in D.numbered(walked.where("corpus = 'a'")).orderBy("seq").collect()]
    assert [n["node_id"] for n in D._nodes_of(json.loads(next(f for f in files if "corpus=a" in str(f)).read_text())["structure"])] == order


def test_reader_takes_odd_objects(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps([{"title": 5, "node_id": 1, "nodes": [{"nodes": [{"node_id": "x", "source": " s "}]}], "tags": None}, {}]))
    (tmp_path / "two.json").write_text('{"other": 1}')
    rows = D.read_tree_objects(spark, str(tmp_path), D.F.lit("k")).collect()
    assert sorted((r.depth, r.root_ord, r.article_title, r.source_url, r.node_id) for r in rows) == [
        (1, 0, "5", None, "1"), (1, 1, None, None, "None"), (2, 0, "5", None, "None"), (3, 0, "5", "s", "x")]


@pytest.mark.parametrize("read", [1, 7, 1 << 22])
def test_roots_are_read_one_by_one(monkeypatch, read):
    monkeypatch.setattr(D, "READ", read)
    roots = [{"node_id": i, "text": 'a "{" b }' * i, "nodes": [{"title": "late", "nodes": [], "n": -1.5e3}], "source": " s "} for i in range(40)]
    texts = [json.dumps(roots), json.dumps({"line_count": 12, "x": {"structure": [1]}, "structure": roots, "y": [1, 2]}, indent=1) + "\n"]
    for text in texts:
        for size in (1, 5, 1000):
            assert [*D._roots_of(text[i : i + size] for i in range(0, len(text), size))] == roots
    for text in ("{}", '{"structure": null}', "[]", ' {"a": 1, "structure" : [ ] } '):
        assert [*D._roots_of([text])] == []
    for text in ("", "3", "[{}", '{"structure": 5}', "[{}] 1", '{"structure": [{}], "structure": [{}]}', '{"a" 1}', "[{},]"):
        with pytest.raises(ValueError):
            [*D._roots_of([text])]


def test_a_file_is_not_read_whole(monkeypatch):
    monkeypatch.setattr(D, "READ", 100)
    taken = []
    pieces = ['{"structure": [{}', *[', {"text": "' + "x" * 50 + '"}'] * 1000, "]}"]
    nodes = D._nodes_of(D._roots_of(taken.append(p) or p for p in pieces))
    assert next(nodes)["path"] == [0] and len(taken) < 5
    assert len([*nodes]) == 1000 and len(taken) == 1002


def test_reader_puts_cut_files_in_order(spark, tmp_path):
    def nested(n, i):
        return {"title": f"t{i}" if i % 3 else None, "node_id": f"{n}.{i}", "text": "{}" * (i % 7) + "\n}{" + "é" * i, "nodes": [nested(n, j) for j in (i // 2, i // 3) if i > 2], "source": f"u{i}" if i % 2 else ""}

    trees = {n: [nested(n, i) for i in range(n, 40)] for n in range(5)}
    for n, roots in trees.items():
        (tmp_path / f"{n}.json").write_text(json.dumps({"structure": roots, "n": n}, ensure_ascii=False, indent=n or None))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = D.read_tree_objects(spark, str(tmp_path), D.F.regexp_extract("_metadata.file_name", r"\d", 0)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    key = lambda r: (r["corpus"], r["path"])
    want = [row | {"corpus": str(n)} for n, roots in trees.items() for row in D._nodes_of(roots)]
    columns = ("corpus", "path", "node_id", "parent_id", "root_id", "root_ord", "depth", "title", "article_title", "text", "own_url", "source_url")
    assert [[r[c] for c in columns] for r in sorted(got, key=key)] == [[r[c] for c in columns] for r in sorted(want, key=key)]


def test_one_second_is_numbered_by_several_tasks(spark, uneven):
    rows = spark.range(20_000).selectExpr("'hot' as run", "timestamp'2024-01-01 00:00:00' as ts", "id", "id % 3 as clash").union(
        spark.range(10).selectExpr("'r' || id", "timestamp'2024-01-01 00:00:00'", "id", "id")
    )
    cut = scale.in_ranges(rows, ["run"], ["ts", "id"])
    assert cut.where("run = 'hot'").select("_part").distinct().count() > 1
    got = scale.number_in_ranges(rows, ["run"], ["ts", "id"], "seq")
    assert got.where("run = 'hot' and seq <> id + 1 or run <> 'hot' and seq <> 1").count() == 0 and got.count() == 20_010
    empty = scale.number_in_ranges(rows.where("false"), ["run"], ["ts", "id"], "seq")
    assert empty.collect() == [] and empty.columns == ["run", "ts", "id", "clash", "seq"]


CHANGE = "change_id bigint, op string, target_category string, target_id string, category string, id string, name string, description string, keywords array<string>"


def change(n, op, key, category="workflow", **other):
    row = dict(change_id=n, op=op, target_category=category, target_id=key, category=category, id=key, name="n", description="d", keywords=None)
    return tuple((row | other).values())


def changes_by_hand(have, rows):
    place, out = dict(have), {}
    for n, op, tc, tid, c, i, *_ in sorted(rows, key=lambda r: r[:2]):
        if op == "create":
            out[n] = "conflict" if i in place else "applied"
            place.setdefault(i, c)
        elif op == "update" and (c, i) != (tc, tid):
            out[n] = "rejected"
        elif place.get(tid) != tc:
            out[n] = "not_found"
        else:
            out[n] = "applied"
            if op == "delete":
                del place[tid]
    return out, place


def test_changes_take_effect_in_order(spark, uneven):
    have = {"old": "workflow", "expert": "domain_expert"}
    table = spark.createDataFrame([(i, "n", "d", c, []) for i, c in have.items()], "id string, name string, description string, category string, keywords array<string>")
    rows = [change(1, "create", "new"), change(2, "update", "new"), change(3, "delete", "new"), change(4, "create", "new", "domain_expert"),
            change(5, "delete", "new"), change(6, "update", "expert", "domain_expert", id="moved"), change(7, "create", "old"), change(8, "delete", "old")]
    rnd = random.Random(4)
    rows += [change(n, rnd.choice(["create", "delete", "update"]), "hot" if n % 3 else f"k{n % 20}", rnd.choice(["workflow", "domain_expert"])) for n in range(10, 3000)]
    want, left = changes_by_hand(have, rows)
    assert [want[n] for n in range(1, 5)] == ["applied"] * 4
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    judged = P.judge_changes(table, spark.createDataFrame(shuffled, CHANGE).repartition(6)).cache()
    assert {r.change_id: r.outcome for r in judged.collect()} == want
    assert {r.id: r.category for r in P.apply_changes(table, judged).collect()} == left


def test_odd_changes(spark):
    table = spark.createDataFrame([], "id string, name string, description string, category string, keywords array<string>")
    rows = [change(1, "create", None), change(2, "delete", None), change(3, "create", "a", "other"), change(4, "create", "Bad"), change(5, "update", "a", target_category=None), change(None, "create", "z")]
    got = {r.change_id: r.outcome for r in P.judge_changes(table, spark.createDataFrame(rows, CHANGE)).collect()}
    assert got == {1: "invalid", 2: "not_found", 3: "invalid", 4: "invalid", 5: "rejected", None: "applied"}
    assert P.judge_changes(table, spark.createDataFrame([], CHANGE)).collect() == []


def test_parts_joined_are_the_list(spark, monkeypatch):
    from galley.operators import retrieval as R

    monkeypatch.setattr(R, "PART_LINES", 7)
    rows = [(c, i, 0, f"n{i}", f"line {c} {i}" if i % 3 else None, f"tree {i}") for c in "ab" for i in range(50)]
    lines = spark.createDataFrame(rows, "corpus string, root_ord int, node_ord int, node_id string, article_line string, tree_line string").repartition(3)
    parts = sorted(R.article_lists(lines).collect())
    assert max(p.text.count("\n") for p in parts) == 6
    for c in "ab":
        assert "\n".join(p.text for p in parts if p.corpus == c).split("\n") == [r[4] for r in rows if r[0] == c and r[4]]
    short = spark.createDataFrame([("r1", "a", ["n9", "n2"]), ("r2", "b", None), ("r3", "b", ["n1", "gone"])], "run_id string, corpus string, node_ids array<string>")
    assert sorted(map(tuple, R.tree_lists(short, lines).collect())) == [("r1", "a", 0, "tree 9\ntree 2"), ("r3", "b", 0, "tree 1")]
