"""Comparison of trees by digests of subtrees: only what differs is opened."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, written


def digested(rows: DataFrame, tree: str = "page_id") -> DataFrame:
    """tree, xpath, parent, depth, value, pos, digest of rows(tree, xpath, value, pos): a digest covers the whole subtree.

    Subtrees with one digest have the same steps, values and places throughout. Levels are folded from the deepest up: each
    is one aggregation of children by parent, and a join. A node without a parent row stands as a tree of its own.
    """
    steps = F.size(F.split("xpath", "/")) - 1
    parent = F.when(steps > 1, F.regexp_replace("xpath", r"/[^/]*$", ""))
    own = written(rows.select(tree, "xpath", parent.alias("parent"), steps.alias("depth"), F.coalesce("value", F.lit("\0")).alias("value"), F.col("pos").cast("int").alias("pos")), "steps")
    step = F.regexp_extract("xpath", r"([^/]*)$", 1)
    depth = own.agg(F.max("depth")).first()[0] or 0
    below, levels = None, []
    for level in range(depth, 0, -1):
        now = own.where(F.col("depth") == level)
        children = F.lit("")
        if below is not None:
            held = below.groupBy(tree, F.col("parent").alias("xpath")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("xpath", "digest"))), lambda x: x["digest"]), "").alias("_below"))
            now, children = now.join(held, [tree, "xpath"], "left"), F.coalesce("_below", F.lit(""))
        text = F.concat_ws("\1", step, F.col("value"), F.coalesce(F.col("pos").cast("string"), F.lit("")), children)
        below = written(now.select(*own.columns, F.sha2(text, 256).alias("digest")), "digests")
        levels.append(below)
    if below is None:
        return own.withColumn("digest", F.lit(None).cast("string"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    result = written(out, "digested")
    discard(*levels, own)
    return result


def differences(a: DataFrame, b: DataFrame, tree: str = "page_id") -> tuple[DataFrame, list[int]]:
    """tree, xpath, problem (only first, only second, value, place) of two digested() tables, and the rows opened by level.

    Roots are compared first; below a pair with one digest nothing is read, and below a node of one side only neither: it
    stands for its subtree.
    """
    spark = a.sparkSession
    side = lambda df, c: df.select(tree, "xpath", F.col("parent").alias(f"_p{c}"), "depth", *[F.col(x).alias(f"{x}_{c}") for x in ("value", "pos", "digest")])
    kind = dict(a.dtypes)[tree]
    found = spark.createDataFrame([], f"{tree} {kind}, xpath string, problem string")
    last = max(x.agg(F.max("depth")).first()[0] or 0 for x in (a, b))
    open_, opened, held = None, [], []
    for level in range(1, last + 1):
        left, right = (side(df.where(F.col("depth") == level), c) for df, c in ((a, "a"), (b, "b")))
        if open_ is not None:
            left, right = (df.join(open_.withColumnRenamed("xpath", c), [tree, c], "left_semi") for df, c in ((left, "_pa"), (right, "_pb")))
        both = written(left.drop("depth", "_pa").join(right.drop("depth", "_pb"), [tree, "xpath"], "full"), "compared")
        held.append(both)
        number = both.count()
        if not number:
            break
        opened.append(number)
        moved, other = ~F.col("pos_a").eqNullSafe(F.col("pos_b")), F.col("value_a") != F.col("value_b")
        problems = F.filter(F.array(F.when(F.col("digest_b").isNull(), "only first"), F.when(F.col("digest_a").isNull(), "only second"), F.when(other, "value"), F.when(F.col("digest_a").isNotNull() & F.col("digest_b").isNotNull() & moved, "place")), lambda x: x.isNotNull())
        found = found.unionByName(both.select(tree, "xpath", F.explode(problems).alias("problem")))
        open_ = both.where("digest_a != digest_b").select(tree, "xpath")
    out = written(found, "differences")
    discard(*held)
    return out, opened
