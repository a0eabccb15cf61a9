"""Joins, ranks and numbering that keep working when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galley.session import cut_lineage

#: Rows up to which a side may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 1_000_000
#: Copies of the smaller side in a salted join.
SALTS = 16
#: Ranges used to number rows in parallel.
RANGES = 256
SAMPLE_ROWS = 4096


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when the input comes in fewer splits than there are cores.

    A no-op on inputs of many splits, so large tables are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the table has at most ``rows`` rows; reads no further than that."""
    return df.select(F.lit(1).alias("one")).limit(rows + 1).count() <= rows


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a side that is broadcast if it is proven small, else shuffled."""
    if fits(small, rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def join_skewed(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    spread_by: list[str],
    rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join whose keys may be very uneven.

    A small side that is proven small is broadcast: the big side does not move.
    Otherwise the rows of one key are split over ``salts`` tasks by a hash of
    ``spread_by``, and the other side is copied once per salt.
    """
    if fits(small, rows):
        return big.join(F.broadcast(small), on)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"]).drop("_salt")


#: Rows a catalogue (KPIs, profiles) has at most.
CATALOGUE_ROWS = 10_000


def catalogue(entries: Sequence[dict] | DataFrame, order: str) -> list[dict]:
    """A catalogue as a list, as it is compiled into column expressions; a table must be proven small."""
    if not isinstance(entries, DataFrame):
        return list(entries)
    rows = entries.orderBy(order).limit(CATALOGUE_ROWS + 1).collect()
    if len(rows) > CATALOGUE_ROWS:
        raise ValueError(f"a catalogue has at most {CATALOGUE_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def top_rows(df: DataFrame, by: list[str], order: list[Column], limit: int, rank: str) -> DataFrame:
    """The first ``limit`` rows per group.

    The literal bound lets Spark keep only ``limit`` rows per group and task
    before the shuffle, so a group of any size is cut down where it lies.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)


def _range_of(c: Column, bounds: list, kind: str) -> Column:
    """How many of the sorted bounds are not above the value: first every 16th is looked at, then those between two of them."""
    width = 16
    marks = lambda some: F.array(*[F.lit(b) for b in some]).cast(f"array<{kind}>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= c))
    passed = F.transform(
        F.array(below(marks(bounds[width - 1 :: width])) * width),
        lambda n: n + below(F.slice(marks(bounds), n + 1, F.lit(width - 1))),
    )
    return passed[0]


def ordinals(df: DataFrame, by: list[str], order: str, out: str) -> DataFrame:
    """Number the rows of every group from 0 in the order of a unique key.

    One group may be most of the table, so it is not sorted in one task: the
    key is cut into ranges at sampled bounds, rows are numbered inside their
    range and shifted by the rows in the ranges before. The bounds only steer
    how even the ranges are; the numbers are exact with any bounds. The sample
    is the rows with the smallest hashes, so it is the same on every run.
    """
    sample = (
        df.select(order)
        .orderBy(F.xxhash64(order), order)
        .limit(SAMPLE_ROWS)
        .collect()
    )
    keys = sorted(r[0] for r in sample if r[0] is not None)
    step = max(1, len(keys) // RANGES)
    bounds = keys[step::step][: RANGES - 1]
    part = _range_of(F.col(order), bounds, df.schema[order].dataType.simpleString()) if bounds else F.lit(0)
    keys_only = df.select(*by, order)
    ranged = keys_only.withColumn("_range", part)
    sizes = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    local = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order))
    numbers = (
        ranged.withColumn("_local", local)
        .join(shifts, [*by, "_range"])
        .select(*by, order, (F.col("_local") + F.col("_shift") - 1).alias(out))
    )
    # only the keys are sorted; wide rows meet their number in one join
    return df.join(F.broadcast(numbers) if fits(keys_only) else numbers, [*by, order])


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def running_number(df: DataFrame, by: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 1 in time order.

    A group is numbered bucket by bucket (``bucket`` must grow with the
    order), and the rows of earlier buckets are added, so one busy group is
    spread over as many tasks as it has buckets.
    """
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return (
        cut.withColumn("_local", local)
        .join(shifts, [*by, "_bucket"])
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_bucket", "_local", "_shift")
    )


def in_ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` cut at sampled bounds into ranges of (by, order), sorted inside, with the number of the range in ``_part``.

    A group of any size lies in as many ranges as its share of the rows, also if
    all its rows have one time. The ranges are written, so later passes see the same.
    """
    keys = [*by, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def number_in_ranges(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Number the rows of each group from 1 in order; a group is numbered range by range.

    Rows that are equal in ``by`` and ``order`` may lie in two ranges and are
    numbered in any order among themselves.
    """
    cut = in_ranges(df, by, order)
    sizes = cut.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*by, "_part", F.sum("_n").over(before).alias("_shift")).where("_shift > 0")
    # only groups in several ranges have a shift: one row per range
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_part"]]
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    small = shifts.select(*[F.col(c).alias(f"_{c}") for c in [*by, "_part"]], "_shift")
    if fits(small):
        small = F.broadcast(small)
    joined = cut.withColumn("_local", local).join(small, reduce(lambda a, b: a & b, same), "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce("_shift", F.lit(0))).select(*df.columns, out)
