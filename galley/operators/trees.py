"""Trees of any depth, as rows with parent pointers.

A node takes the first title on its path from the root as article title, and
the nearest link on the way up. Walking down would take a job per level;
instead every node holds the stretch of its path that it knows, and joins the
stretch of the node above it. Stretches double, so a chain of 200 levels needs
eight joins, and only nodes that have not reached their root take part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.functions import text as T
from galley.operators.scale import join_small, number_in_ranges
from galley.session import cut_lineage

#: Levels a tree may have; more, or a circle of parents, is rejected.
DEEPEST = 10_000
NO_PARENT, TOO_DEEP = "parent not found", "circle of parents, or more levels than allowed"

# ---- from parent pointers ------------------------------------------------------


def walk(nodes: DataFrame, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(walked, rejected) from nodes with corpus, node_id, parent_id (null for roots), ord among siblings, title, source_url.

    ``walked`` has the node's columns and root_id, depth (1 for roots), path
    (the ``ord`` of every node from the root on, so paths sort depth first),
    article_title and the inherited source_url (its own one is own_url).
    ``rejected`` holds nodes whose path does not end in a root, with a reason.
    Ids are unique in a corpus; of rows that repeat an id, each is walked, under
    one of the parents of that id.
    """
    start = nodes.select(
        "corpus", "node_id", F.col("parent_id").alias("up"), F.array(F.col("ord").cast("bigint")).alias("path"),
        F.col("node_id").alias("root_id"), T.present(F.col("title")).alias("article_title"), T.present(F.col("source_url")).alias("link"),
    ).dropDuplicates(["corpus", "node_id"])
    known = cut_lineage(start)
    done, lost = known.where("up IS NULL"), []
    going = known.where("up IS NOT NULL")
    while not going.isEmpty():
        above = known.select(*[F.col(c).alias(f"_{c}") for c in ("corpus", "node_id", "up", "path", "root_id", "article_title", "link")])
        joined = going.join(above, (F.col("corpus") == F.col("_corpus")) & (F.col("up") == F.col("_node_id")), "left")
        lost.append(joined.where("_node_id IS NULL").select("corpus", "node_id", F.lit(NO_PARENT).alias("reason")))
        longer = cut_lineage(
            joined.where("_node_id IS NOT NULL").select(
                "corpus", "node_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.col("_root_id").alias("root_id"),
                F.coalesce("_article_title", "article_title").alias("article_title"), F.coalesce("link", "_link").alias("link"),
            )
        )
        done = done.unionByName(longer.where("up IS NULL"))
        lost.append(longer.where((F.col("up").isNotNull()) & (F.size("path") > deepest)).select("corpus", "node_id", F.lit(TOO_DEEP).alias("reason")))
        going = longer.where((F.col("up").isNotNull()) & (F.size("path") <= deepest))
        # those that have arrived stay for the others to join; those that are lost lose all below them
        known = done.unionByName(going)
    found = done.select("corpus", "node_id", "root_id", F.size("path").cast("bigint").alias("depth"), "path", "article_title", F.col("link").alias("_link"))
    walked = nodes.join(found, ["corpus", "node_id"]).withColumns(
        {"own_url": T.present(F.col("source_url")), "source_url": F.col("_link")}
    ).drop("_link")
    reasons = lost[0] if lost else known.limit(0).select("corpus", "node_id", F.lit("").alias("reason"))
    for more in lost[1:]:
        reasons = reasons.unionByName(more)
    return walked, reasons


def numbered(walked: DataFrame) -> DataFrame:
    """``walked`` with ``seq``, the place of a node in the depth-first order of its corpus, from 1."""
    return number_in_ranges(walked, ["corpus"], ["path", "node_id"], "seq")


# ---- one object per corpus -----------------------------------------------------

#: Nodes whose neighbours are looked up together.
STRETCH = 8192
FIELDS = ("title", "node_id", "line_num", "page_index", "text", "summary", "prefix_summary", "source", "tags", "published", "slug", "lang")


def write_tree_objects(walked: DataFrame, path: str) -> None:
    """One JSON object per corpus: doc_name, line_count and the nested structure.

    In depth-first order a tree is written node by node: a node opens itself
    and its list, and closes as many as the next node lies above it. So no node
    holds its children in memory; a corpus is one sorted stream into one file.
    """
    rows = numbered(walked)
    place = F.floor(F.col("seq") / STRETCH)
    heads = rows.select("corpus", (place - 1).alias("stretch"), "seq", "depth").groupBy("corpus", "stretch").agg(
        F.min_by("depth", "seq").alias("after")
    )
    near = Window.partitionBy("corpus", "stretch").orderBy("seq")
    lined = join_small(rows.withColumn("stretch", place), heads, ["corpus", "stretch"], "left").withColumn(
        "next", F.coalesce(F.lead("depth").over(near), "after")
    )
    lines = F.coalesce(T.line_breaks(F.col("text")), F.lit(0)).cast("bigint")
    counts = walked.where("depth = 1").groupBy("corpus").agg((F.sum(lines) + 4 * (F.count(F.lit(1)) - 1)).alias("line_count"))
    known = {f: F.col("own_url" if f == "source" else f) for f in FIELDS if f == "source" or f in walked.columns}
    whole = F.to_json(F.struct(*[c.alias(f) for f, c in known.items()]))
    opened = F.concat(F.left(whole, F.length(whole) - 1), F.lit(', "nodes": ['))
    closing = lambda to: F.repeat(F.lit("]}"), (F.col("depth") - to + 1).cast("int"))
    after = F.when(F.col("next").isNull(), F.concat(closing(F.lit(1)), F.lit("]}"))).otherwise(
        F.when(F.col("next") > F.col("depth"), "").otherwise(F.concat(closing(F.col("next")), F.lit(",")))
    )
    name = F.regexp_extract(F.to_json(F.struct(F.col("corpus").alias("d"))), r'(?s)^\{"d":(.*)\}$', 1)
    head = F.when(
        F.col("seq") == 1, F.concat(F.lit('{"doc_name": '), name, F.lit(', "line_count": '), F.col("line_count").cast("string"), F.lit(', "structure": ['))
    ).otherwise("")
    pieces = join_small(lined, counts, ["corpus"], "left").select("corpus", "seq", F.concat(head, opened, after).alias("value"))
    pieces.repartition("corpus").sortWithinPartitions("corpus", "seq").select("corpus", "value").write.partitionBy("corpus").text(path)


_ROW = (
    "node_id string, parent_id string, root_id string, root_ord bigint, depth bigint, path array<bigint>, title string, "
    "article_title string, text string, summary string, prefix_summary string, own_url string, source_url string, "
    "line_num bigint, page_index bigint, tags array<string>, published string, slug string, lang string"
)


def _text(value) -> str | None:
    return None if value is None else str(value).strip() or None


#: What tree files are cut at: no file ends with it, and a node of any kind has one.
OPENS = "{"
#: Characters of a file that are read on at least.
READ = 1 << 22
_BLANK = re.compile(r"[ \t\n\r]*")
_JSON = json.JSONDecoder()


class _Text:
    """The text of a file, read on in pieces as far as it is parsed."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.pieces, self.known, self.at, self.ended = iter(pieces), "", 0, False

    def read_on(self) -> None:
        """At least double what is not parsed, so that a value is not tried again too often."""
        parts = [self.known[self.at :]]
        missing = max(READ, len(parts[0]))
        for piece in self.pieces:
            parts.append(piece)
            missing -= len(piece)
            if missing <= 0:
                break
        else:
            self.ended = True
        self.known, self.at = "".join(parts), 0

    def coming(self) -> str:
        """The next character that is not blank, empty at the end."""
        while True:
            self.at = _BLANK.match(self.known, self.at).end()
            if self.at < len(self.known) or self.ended:
                return self.known[self.at : self.at + 1]
            self.read_on()

    def take(self, allowed: str) -> str:
        found = self.coming()
        if not found or found not in allowed:
            raise ValueError(f"a tree file has {found!r} in place of one of {allowed!r}")
        self.at += 1
        return found

    def value(self):
        self.coming()
        while True:
            try:
                found, end = _JSON.raw_decode(self.known, self.at)
                if end < len(self.known) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.read_on()

    def items(self) -> Iterator:
        """The items of a list, each parsed when it is asked for."""
        self.take("[")
        if self.coming() == "]":
            self.take("]")
            return
        yield self.value()
        while self.take(",]") == ",":
            yield self.value()


def _roots_of(pieces: Iterable[str]) -> Iterator:
    """Roots of a tree file one by one: the items of ``structure``, or of a plain list."""
    text, seen = _Text(pieces), False
    if text.coming() == "[":
        yield from text.items()
    else:
        text.take("{")
        more = text.coming() != "}" or text.take("}") == ","
        while more:
            key = text.value()
            text.take(":")
            if key == "structure":
                if seen:
                    raise ValueError("a tree file has two structures")
                seen = True
            if key == "structure" and text.coming() == "[":
                yield from text.items()
            elif text.value() and key == "structure":
                raise ValueError("the structure of a tree file is not a list")
            more = text.take(",}") == ","
    if text.coming():
        raise ValueError("a tree file goes on after its end")


def _nodes_of(roots: Iterable) -> Iterator[dict]:
    """Rows of nested nodes, depth first, with a stack of its own; a root is held until its last node is given."""
    above = {"node_id": None, "root_id": None, "root_ord": None, "path": [], "article_title": None, "source_url": None}
    for i, node in enumerate(roots):
        yield from _nodes_under(node, i, above)


def _nodes_under(node: dict, i: int, above: dict) -> Iterator[dict]:
    stack = [(node, i, above)]
    while stack:
        node, i, up = stack.pop()
        own = _text(node.get("source"))
        row = {k: None if node.get(k) is None else str(node[k]) for k in ("title", "text", "summary", "prefix_summary", "published", "slug", "lang")}
        row |= {
            "node_id": str(node.get("node_id")), "parent_id": up["node_id"], "path": [*up["path"], i], "depth": len(up["path"]) + 1,
            "article_title": up["article_title"] or _text(node.get("title")), "own_url": own, "source_url": own or up["source_url"],
            "line_num": node.get("line_num"), "page_index": node.get("page_index"), "tags": [str(t) for t in node.get("tags") or []],
            "root_ord": i if up["root_ord"] is None else up["root_ord"], "root_id": up["root_id"] or str(node.get("node_id")),
        }
        yield row
        stack += [(child, j, row) for j, child in reversed([*enumerate(node.get("nodes") or [])])]


def read_tree_objects(spark: SparkSession, path: str, corpus: Column | None = None) -> DataFrame:
    """Nodes of tree files of any depth: an object with ``structure`` or a plain list of roots.

    Fields may be missing or of another kind than usual, and may follow a node's
    children; ``corpus`` defaults to the folder of ``partitionBy``. A file is
    read in pieces and its roots one by one, so a task holds one root (an
    article with all below it) and never a corpus. The walk keeps a stack of its
    own, so depth is bounded by the JSON parser only.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = chain.from_iterable(zip(*(batch.column(i).to_pylist() for i in range(3))) for batch in batches)
        for (name, _), of_file in groupby(lines, itemgetter(0, 1)):
            pieces = chain([next(of_file)[2]], (OPENS + line[2] for line in of_file))
            found = []
            for row in _nodes_of(_roots_of(pieces)):
                found.append(row | {"corpus": name})
                if len(found) == 1000:
                    yield pa.RecordBatch.from_pylist(found, schema)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in f"corpus string, {_ROW}".split(", ")])
    lines = spark.read.text(path, lineSep=OPENS).select(
        (F.col("corpus") if corpus is None else corpus).alias("corpus"), F.col("_metadata.file_path").alias("file"), "value",
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    )
    in_order = lines.repartition("file").sortWithinPartitions("file", "start", "at")
    return in_order.select("corpus", "file", "value").mapInArrow(rows, f"corpus string, {_ROW}")
