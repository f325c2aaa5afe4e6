"""Relational operators of the pipeline: lists, ranks, ranges, upserts, samples, splits and folds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import written


def numbered(df: DataFrame, order: str, most: int = 500_000) -> DataFrame:
    """df with _number, its place from 0 by order: sorted by range and counted in parts, so that no task gets all rows."""
    parts = max(1, -(-df.count() // most))
    ranged = written(df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("_first")).collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], r["_first"], total))
        total += r["n"]
    offset = df.sparkSession.createDataFrame(starts or [(0, 0, 0)], "_part int, _first bigint, _start bigint")
    return ranged.join(F.broadcast(offset), "_part").withColumn("_number", F.col("_row") - F.col("_first") + F.col("_start")).select(*df.columns, "_number")


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, most: int = 500_000) -> DataFrame:
    """df with its place (from 1) in its group by order, which tells the rows of a group apart.

    Sorted by range over group and order and counted in parts: a group of any size spreads over tasks, and what came
    before a part is summed from one row for each part and group.
    """
    parts = max(1, -(-df.count() // most))
    parted = written(df.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = parted.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], before.alias("_start"))
    own = parted.withColumn("_row", F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)))
    same = own["_part"] == starts["_p"]
    for i, c in enumerate(by):
        same = same & own[c].eqNullSafe(starts[f"_by{i}"])
    return own.join(starts, same).select(*df.columns, (F.col("_row") + F.col("_start")).alias(name))


def restrict(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(listed, on, "left_semi")


def missing(df: DataFrame, existing: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(existing, on, "left_anti")


def missing_range(df: DataFrame, key: str, low: Column, high: Column) -> DataFrame:
    """Numbers of low..high (inclusive) that key lacks, without the driver: each gap is spelled out where it begins."""
    bounds = df.agg(low.alias("lo"), high.alias("hi")).select((F.col("lo") - 1).alias("a"), (F.col("hi") + 1).alias("b"))
    edges = bounds.select(F.explode(F.array("a", "b")).alias("k"))
    keys = df.select(F.col(key).cast("bigint").alias("k")).unionByName(edges.select(F.col("k").cast("bigint"))).distinct()
    step = 1 << 16  # keys of one stretch lie together, so that no task gets all
    stretch = keys.withColumn("s", F.floor(F.col("k") / step))
    inner = stretch.withColumn("after", F.lead("k").over(W.partitionBy("s").orderBy("k")))
    ends = stretch.groupBy("s").agg(F.max("k").alias("k"), F.min("k").alias("first"))
    across = ends.select("k", F.lead("first").over(W.orderBy("s")).alias("after"))
    gaps = inner.where("after is not null").select("k", "after").unionByName(across.where("after is not null"))
    return gaps.where("after > k + 1").select(F.explode(F.sequence(F.col("k") + 1, F.col("after") - 1)).alias(key))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def zero_filled(groups: DataFrame, keys: DataFrame, counts: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """A row for each pair of a small dimension `groups` and the listed keys; absent counts are 0."""
    listed = keys.agg(F.collect_set(key).alias("_keys"))
    pairs = groups.select(group).distinct().join(F.broadcast(listed)).select(group, F.explode("_keys").alias(key))
    return pairs.join(counts, [group, key], "left").select(group, key, F.coalesce(value, F.lit(0)).alias(value))


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, default) -> DataFrame:
    return df.join(table.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def upsert(old: DataFrame, new: DataFrame, on: str | list[str]) -> DataFrame:
    return old.join(new, on, "left_anti").unionByName(new)


def arg_max(df: DataFrame, by: list[str], value: str, *ties: str) -> DataFrame:
    """The row of the greatest value in each group; of equals the first by ties."""
    w = W.partitionBy(*by).orderBy(F.col(value).desc(), *ties)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def to_ranges(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    """First and last of each run of consecutive numbers."""
    island = F.col(key) - F.row_number().over(W.partitionBy(*by).orderBy(key))
    return df.select(*by, key).distinct().withColumn("_i", island).groupBy(*by, "_i").agg(F.min(key).alias("first"), F.max(key).alias("last")).drop("_i")


def interleaved(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds turn and place: the first of all groups, the second of all groups, and so on. Place is by turn and group."""
    return ranked(df, [group], list(order), "turn")


def first_n(df: DataFrame, n: int, by: list[str], *order) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def offsets(groups: DataFrame, size: str, *order: str) -> DataFrame:
    """Where each group begins if all lie one after the other. groups is a small dimension."""
    w = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return groups.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def reindexed(df: DataFrame, by: list[str], *order: str) -> DataFrame:
    return ranked(df, by, list(order), "new_index").withColumn("new_index", F.col("new_index") - 1)


def sampled(df: DataFrame, n: int | None, by: list[str], key: str, seed: str = "42") -> DataFrame:
    """n rows of each group by a hash of the key: the same in any run and engine; all of a smaller group."""
    if n is None:
        return df
    return first_n(df, n, by, F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)


def bucket(key: Column, buckets: int = 100_000) -> Column:
    """Number below `buckets` from the MD5 of a key."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def cut_off(df: DataFrame, key: str, limit: int, unlabeled: Column) -> DataFrame:
    """Drops unlabelled rows whose bucket is limit or more."""
    return df.where(~(unlabeled & (bucket(F.col(key).cast("string")) >= limit)))


def cyclic_folds(n: int, length: int) -> list[list[int]]:
    return [[(p + i) % n for i in range(length)] for p in range(n)]


def folds(groups: DataFrame, name: str, train: int) -> DataFrame:
    """fold, name, part: in each of n folds, `train` groups in cyclic order are for training, the rest for validation."""
    ranked = groups.select(name).distinct().withColumn("_k", F.row_number().over(W.orderBy(name)) - 1).withColumn("_n", F.count("*").over(W.partitionBy()))
    spread = ranked.select(name, "_k", "_n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("fold"))
    return spread.select("fold", name, F.when(F.pmod(F.col("_k") - F.col("fold"), F.col("_n")) < train, "train").otherwise("val").alias("part"))
