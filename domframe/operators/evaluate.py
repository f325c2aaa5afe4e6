"""Evaluation of predictions: page-level top-1 and exact match, node-level micro scores, and tables over runs."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, ratio(2 * p * r, p + r)


def page_flags(predictions: DataFrame, gold: DataFrame, exact: bool = False, count_unpredicted: bool = False) -> DataFrame:
    """label_key, page_id, tp, fp, fn of predictions(page_id, label_key, node_id, confidence) and gold(.., group_idx, node_id).

    Top-1: the prediction of highest confidence (then least node) is in the gold. Exact: some gold group is predicted in
    full. A wrong top-1 is a false positive only. count_unpredicted: gold of pages without a prediction is missed.
    """
    key = ["page_id", "label_key"]
    top = predictions.groupBy(*key).agg(F.max_by("node_id", F.struct("confidence", -F.col("node_id"))).alias("node_id"))
    if exact:
        held = gold.join(predictions.select(*key, "node_id").distinct().withColumn("_p", F.lit(True)), [*key, "node_id"], "left")
        groups = held.groupBy(*key, "group_idx").agg(F.every(F.coalesce("_p", F.lit(False))).alias("_g"))
        hit = groups.groupBy(*key).agg(F.some("_g").alias("hit"))
        flagged = top.join(hit, key, "left")
    else:
        flagged = top.join(gold.select(*key, "node_id").distinct().withColumn("hit", F.lit(True)), [*key, "node_id"], "left")
    hit = F.coalesce("hit", F.lit(False))
    out = flagged.select(*key, hit.cast("int").alias("tp"), (~hit).cast("int").alias("fp"), F.lit(0).alias("fn"))
    if count_unpredicted:
        lost = gold.select(*key).distinct().join(top, key, "left_anti")
        out = out.unionByName(lost.select(*key, F.lit(0).alias("tp"), F.lit(0).alias("fp"), F.lit(1).alias("fn")))
    return out


def label_scores(flags: DataFrame) -> DataFrame:
    sums = flags.groupBy("label_key").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("label_key", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def macro(scored: DataFrame) -> DataFrame:
    return scored.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def node_micro(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Micro scores over classes from 1; class 0 counts as no label."""
    p, g = F.col(predicted), F.col(gold)
    sums = df.agg(F.count_if((p == g) & (g > 0)).alias("tp"), F.count_if((p != g) & (p > 0)).alias("fp"), F.count_if((p != g) & (g > 0)).alias("fn"))
    a, b, c = scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return sums.select("tp", "fp", "fn", a.alias("precision"), b.alias("recall"), c.alias("f1"))


def run_statistics(metrics: DataFrame) -> DataFrame:
    """mean, population deviation, count, min and max of metrics(run, metric, value) by metric."""
    return metrics.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"))


def combined(stats: DataFrame, by: str) -> DataFrame:
    """Mean of the means and square root of the mean variance."""
    return stats.groupBy(by).agg(F.avg("mean").alias("mean"), F.sqrt(F.avg(F.col("std") * F.col("std"))).alias("std"))


def mean_with_std(mean: Column, std: Column) -> Column:
    return F.format_string("%.2f ± %.2f", mean * 100, std * 100)
