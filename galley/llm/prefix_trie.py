"""The trie of conversation prefixes: what conversations share, from their first turn on.

*Rollup over turns.* A conversation becomes a row with its turns' ids in
positional columns t1 to tB. ``GROUP BY ROLLUP (t1, ..., tB)`` then groups
every conversation by all its prefixes at once, and ``grouping_id`` tells their
depth: each group is a node of the trie. A longer conversation goes on in
further rows of B columns, keyed by the node that its row before ended in, so
the same rollup serves all blocks of all conversations in one job, whatever
their length. Groups are pre-aggregated in the tasks, so a first turn that a
third of all conversations share costs each task one row.

*Sums over subtrees without walking the tree.* A conversation owns the nodes
whose smallest member it is; these are the deepest nodes of its path, from
depth o on. Let q be the code points in front of depth o. In a subtree under a
node v, every member but the smallest saves what it has between v and its own o,
so ``saved(v) = sum of q - q of the smallest - (n - 1) * code points above v``.
And a leaf is counted by the member that owns it. So both sums are sums of one
number per conversation over the members of a node: a second rollup gives them,
over the blocks that hold shared nodes only.

*Ids.* A turn's id is the MD5 of its role and text with the text's length; a
node's id is the exclusive or of two 64-bit hashes of each of its blocks, so
exact but for collisions of 128 bits.

Defined results: a null role or text is empty; rows with a null conversation id
take no part; turns are ordered by number, null first, and turns of equal number
(repeated rows too, which count as turns) by the MD5 of role and text; an empty
table gives no row, not even the root; other columns are not read. A turn of any
length is one MD5, texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.operators.scale import fits
from galley.session import cut_lineage

#: Turns per block, the columns of a rollup.
BLOCK = 8
#: Turn numbers per range when the turns of a conversation are numbered; a long conversation is numbered by many tasks.
TURN_RANGE = 4096
#: Ids that are joined to one piece of text before it is hashed.
PIECE_IDS = 1024
#: Nodes up to which a list of nodes may be broadcast (40 bytes each).
BROADCAST_NODES = 500_000

# ---- turns ---------------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """Twenty bytes: the MD5 of role and text, and the text's length in code points."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(whole.cast("binary"))), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))


def _chars(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("bigint")


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id) with positions from 1, from (conv_id, turn, id).

    Numbered range by range of turn numbers; the few conversations that span
    several ranges get the turns of the ranges before added.
    """
    cut = F.coalesce(F.floor(F.col("turn") / TURN_RANGE), F.lit(-(1 << 62)))
    ranged = turns.withColumn("range", cut)
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
        .select("conv_id", "range", F.sum("n").over(before).alias("shift")).where("shift > 0")
    )
    local = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(F.asc_nulls_first("turn"), "id"))
    placed = ranged.withColumn("local", local).join(_small(shifts), ["conv_id", "range"], "left")
    return placed.select("conv_id", (F.col("local") + F.coalesce("shift", F.lit(0))).alias("pos"), "id")


def _small(table: DataFrame) -> DataFrame:
    """A table of ids, broadcast if it is proven small; otherwise Spark splits skewed keys."""
    return F.broadcast(table) if fits(table, BROADCAST_NODES) else table


# ---- blocks --------------------------------------------------------------------


def _columns(block: int) -> list[str]:
    return [f"t{j}" for j in range(1, block + 1)]


def _hashes(columns: list[Column]) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def blocks_of(placed: DataFrame, block: int) -> DataFrame:
    """A row per conversation and block: conv_id, block, t1.., the node before it (k1, k2), the code points before it."""
    number = F.floor((F.col("pos") - 1) / block)
    slot = (F.col("pos") - 1) % block
    slots = [F.max(F.when(F.col("slot") == j, F.col("id"))).alias(t) for j, t in enumerate(_columns(block))]
    rows = placed.select("conv_id", number.alias("block"), slot.alias("slot"), "id").groupBy("conv_id", "block").agg(*slots)
    h1, h2 = _hashes([F.col("block"), *map(F.col, _columns(block))])
    chars = sum((F.coalesce(_chars(F.col(t)), F.lit(0)) for t in _columns(block)), F.lit(0).cast("bigint"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = lambda f, c: F.coalesce(f(c).over(before), F.lit(0).cast("bigint"))
    return rows.withColumns({"h1": h1, "h2": h2, "chars": chars}).select(
        "conv_id", "block", *_columns(block), over(F.bit_xor, F.col("h1")).alias("k1"), over(F.bit_xor, F.col("h2")).alias("k2"),
        over(F.sum, F.col("chars")).alias("above"),
    )


def rollup(blocks: DataFrame, block: int, measures: str) -> DataFrame:
    """A row per node: its id (n1, n2), its parent's (p1, p2), depth, code points above it and in it, and the measures."""
    turns = _columns(block)
    spark, name = blocks.sparkSession, "blocks"
    at_depth = " OR ".join(f"(g = {(1 << (block - d)) - 1} AND t{d} IS NOT NULL)" for d in range(1, block + 1))
    grouped = spark.sql(
        f"""
        SELECT * FROM (
          SELECT k1, k2, block, above, {', '.join(turns)}, grouping_id() AS g, {measures}
          FROM {{{name}}}
          GROUP BY k1, k2, block, above, ROLLUP ({', '.join(turns)})
        ) WHERE {at_depth}
        """,
        **{name: blocks},
    )
    depth = sum((F.col(t).isNotNull().cast("bigint") for t in turns), F.lit(0).cast("bigint"))
    full = [F.col("block"), *map(F.col, turns)]
    # the parent's columns: the last turn is left out
    short = [F.col("block")] + [F.when(F.col("_depth") > j + 1, F.col(t)) for j, t in enumerate(turns)]
    chars = F.coalesce(*[_chars(F.col(t)) for t in reversed(turns)])
    upper = sum(
        (F.when(F.col("_depth") > j + 1, _chars(F.col(t))).otherwise(F.lit(0)) for j, t in enumerate(turns)), F.col("above")
    )
    names = [c for c in grouped.columns if c not in {"k1", "k2", "block", "above", "g", *turns}]
    key = [F.col("k1"), F.col("k2")]
    first = F.col("_depth") == 1
    return grouped.withColumn("_depth", depth).select(
        *[k.bitwiseXOR(h).alias(n) for k, h, n in zip(key, _hashes(full), ("n1", "n2"))],
        *[F.when(first, k).otherwise(k.bitwiseXOR(h)).alias(n) for k, h, n in zip(key, _hashes(short), ("p1", "p2"))],
        (F.col("block") * block + F.col("_depth")).alias("depth"), chars.alias("chars"), upper.alias("before"), *names,
    )


# ---- ends ----------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n2, first, ids): runs of ascending ids of one node, joined, from rows sorted by node and id."""
    names = ["n1", "n2", "first", "ids"]
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        out, at = [], 0
        while at < len(rows):
            end = at + 1
            while end < len(rows) and end - at < PIECE_IDS and rows[end][:2] == rows[at][:2]:
                end += 1
            out.append((*rows[at], ",".join(str(r[2]) for r in rows[at:end])))
            at = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n2, ends_sha256) from pieces sorted by node and first id; one piece is held at a time."""
    node, state = None, None
    for batch in batches:
        done = []
        for n1, n2, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (n1, n2) == node:
                state.update(b"," + ids.encode())
            else:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (n1, n2), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["n1", "n2", "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], names=["n1", "n2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) from (n1, n2, conv_id): SHA-256 of the ascending ids of each node.

    The ids of one node may be a third of all: ranges of them are joined to
    pieces in many tasks, and only pieces pass through the one hash of a node,
    in order and one at a time.
    """
    pieces = (
        ends.repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id")
        .mapInArrow(_pieces, "n1 bigint, n2 bigint, first bigint, ids string")
    )
    dealt = pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first").select("n1", "n2", "ids")
    return dealt.mapInArrow(_digests, "n1 bigint, n2 bigint, ends_sha256 string")


# ---- the trie ------------------------------------------------------------------


def prefix_trie(convs: DataFrame, placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie, root included.

    ``convs``: (conv_id, total) of all conversations, with their numbers of
    turns; ``placed``: (conv_id, pos, id), their turns at positions 1 to total.
    """
    blocks = cut_lineage(blocks_of(placed, block).join(convs, "conv_id"))
    counts = "count(*) AS n_convs, min(conv_id) AS conv_id, max(total) AS longest"
    nodes = cut_lineage(rollup(blocks, block, counts))

    # per conversation: code points before its own nodes, whether it owns its leaf, its first depth alone
    alone = F.col("n_convs") == 1
    owned = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", "before"))["before"].alias("q"),
        F.max(F.when(F.col("depth") == F.col("longest"), 1).otherwise(0)).cast("bigint").alias("leaf"),
        F.min(F.when(alone, F.col("depth"))).alias("alone"),
    )
    chars = blocks.groupBy("conv_id").agg(
        F.max(F.col("above") + sum((F.coalesce(_chars(F.col(t)), F.lit(0)) for t in _columns(block)), F.lit(0))).alias("all_chars")
    )
    none = F.lit(0).cast("bigint")
    known = cut_lineage(
        convs.join(owned, "conv_id", "left").join(chars, "conv_id", "left").select(
            "conv_id", "total", F.coalesce("q", "all_chars", none).alias("q"), F.coalesce("leaf", none).alias("leaf"), "alone"
        )
    )

    # the blocks of shared nodes, without the turns from the first depth alone on
    is_shared = lambda j: F.col("alone").isNull() | (F.col("block") * block + j < F.col("alone"))
    shared_blocks = blocks.drop("total").join(known, "conv_id").where(is_shared(1)).select(
        "conv_id", "block", "k1", "k2", "above", "total", "q", "leaf",
        *[F.when(is_shared(j + 1), F.col(t)).alias(t) for j, t in enumerate(_columns(block))],
    )
    sums = "sum(q) AS sum_q, min_by(q, conv_id) AS own_q, sum(leaf) AS n_leaves"
    shared = rollup(shared_blocks, block, f"{counts}, {sums}").withColumn(
        "saved_tokens", F.col("sum_q") - F.col("own_q") - (F.col("n_convs") - 1) * F.col("before")
    )
    columns = ["n1", "n2", "p1", "p2", "depth", "conv_id", "n_convs", "longest", "n_leaves", "saved_tokens"]
    root = known.agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("total").alias("longest"),
        F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("q").alias("saved_tokens"),
    ).where("n_convs > 0").select(
        none.alias("n1"), none.alias("n2"), F.lit(None).cast("bigint").alias("p1"), F.lit(None).cast("bigint").alias("p2"),
        none.alias("depth"), "conv_id", "n_convs", "longest", "n_leaves", "saved_tokens",
    )
    shared = cut_lineage(shared.select(*columns).unionByName(root))
    single = nodes.where(alone).select(
        "n1", "n2", "p1", "p2", "depth", "conv_id", "n_convs", "longest", F.lit(1).cast("bigint").alias("n_leaves"), none.alias("saved_tokens")
    )

    # parents: a node that is not among the shared ones has the same only member as its child
    lookup = shared.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("above_id"))
    linked = cut_lineage(single.unionByName(shared).join(_small(lookup), ["p1", "p2"], "left"))
    children = linked.where("above_id IS NOT NULL").groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), "n_children")

    # ends: of a conversation with no depth alone the end is shared
    last = blocks.groupBy("conv_id").agg(
        *[F.max(F.struct("block", F.col(k).bitwiseXOR(h)))["col2"].alias(n) for k, h, n in zip(("k1", "k2"), _hashes([F.col("block"), *map(F.col, _columns(block))]), ("n1", "n2"))]
    )
    ends = known.where("alone IS NULL").select("conv_id").join(last, "conv_id", "left").select(
        F.coalesce("n1", none).alias("n1"), F.coalesce("n2", none).alias("n2"), "conv_id"
    )
    digests = end_digests(cut_lineage(ends))

    of_one = F.sha2(F.when(F.col("longest") == F.col("depth"), F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256)
    is_single = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    single_rows = linked.where(is_single).select(
        "conv_id", "depth", F.coalesce("above_id", "conv_id").alias("parent_conv_id"), "n_convs",
        (F.col("depth") < F.col("longest")).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens", of_one.alias("ends_sha256"),
    )
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    shared_rows = linked.where(~is_single).join(children, ["n1", "n2"], "left").join(digests, ["n1", "n2"], "left").select(
        "conv_id", "depth", F.col("above_id").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", none).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
    return single_rows.unionByName(shared_rows)


def conversation_trie(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """The trie of a table of turns."""
    rows = _turns(turns, id_col, turn_col, role_col, text_col)
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
    return prefix_trie(convs, numbered_turns(rows), block)


def _turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        turn_id(F.col(role_col).cast("string"), F.col(text_col).cast("string")).alias("id"),
    )


# ---- the query -----------------------------------------------------------------

#: Ids that start alike: the first turns of a conversation are those of the one at the head of its hundred.
GROUP = 100
HEADS = 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(convs, placed) of conversations whose first turns are replaced by those of the head of their group.

    Conversation c begins with the first h turns of conversation c - c % 100,
    h being the CRC-32 of its decimal id modulo 6, and goes on with its own
    turns after the first h. At most five turns of a head are copied, to the
    ids of one group.
    """
    numbered = cut_lineage(numbered_turns(_turns(turns, "conv_id", "turn", "role", "text")))
    c = F.col("conv_id")
    sizes = numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", (F.crc32(c.cast("string").cast("binary")) % HEADS).alias("h"), (c - c % GROUP).alias("base")
    )
    heads = (
        numbered.where((c % GROUP == 0) & (F.col("pos") < HEADS)).groupBy(c.alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("head"))  # five turns at most
    )
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,id:binary>>")), F.lit(1), F.col("h").cast("int"))
    known = cut_lineage(sizes.join(heads, "base", "left").select("conv_id", "own", "h", taken.alias("head")))
    started = F.size("head").cast("bigint")
    convs = known.select("conv_id", (started + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total"))
    own = numbered.join(known.select("conv_id", "h", started.alias("started")), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("started")).alias("pos"), "id"
    )
    copied = known.select("conv_id", F.explode("head").alias("x")).select("conv_id", "x.pos", "x.id")
    return convs, own.unionByName(copied)


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), length(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b:
      list_reduce(range(8), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, b)), 4294967295), 4294967295) % 6 AS h
  FROM raw
), parts AS (
  SELECT i.conv_id, 0 AS part, r.pos, r.role, r.text FROM ids i JOIN raw r ON r.conv_id = i.base WHERE r.pos <= i.h
  UNION ALL
  SELECT i.conv_id, 1, r.pos, r.role, r.text FROM ids i JOIN raw r USING (conv_id) WHERE r.pos > i.h
), placed AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, length(role) || ':' || role || text AS turn FROM parts
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), paths AS (
  SELECT conv_id, depth, chars, list(md5(turn) || chars) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM ids
), lengths AS (SELECT conv_id, max(depth) AS longest FROM paths GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS own, max(longest) = depth AS leaf,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE longest = depth), '')) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id) GROUP BY path, depth
), above AS (
  SELECT path[1:d] AS path, sum(own) AS saved, sum(leaf::BIGINT) AS leaves, sum((d = depth - 1)::BIGINT) AS children
  FROM (SELECT path, depth, own, leaf, unnest(range(depth + 1)) AS d FROM nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, a.children::BIGINT AS n_children, a.leaves::BIGINT AS n_leaves,
  a.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a USING (path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1 : n.depth - 1]
"""
