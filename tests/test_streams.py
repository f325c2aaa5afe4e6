"""The router as a stream against the batch form, the metric log, early stops and comparison by digests."""
import random

import pytest
from pyspark.sql import functions as F

from domframe.functions.urls import ignored
from domframe.operators import labels, routing, structure
from domframe.sources import metrics
from domframe.streaming import router


@pytest.fixture
def states(spark):
    spark.conf.set(*router.PROVIDER)
    yield spark
    spark.conf.unset(router.PROVIDER[0])


REQUEST = "page_id bigint, request_id bigint, url string"


def asked(n=160):
    r = random.Random(5)
    names = [f"http://Host{k}.example.com:80/{x}" for k in range(2) for x in ("a", "b", "c")] + ["http://ads.example.com/", "file:///x", "https://web.archive.org/web/2011id_/http://e.com/"]
    return [(r.randrange(4), k, r.choice(names)) for k in range(n)]


def test_stream_routes_like_the_batch(states, tmp_path):
    spark = states
    rows = asked()
    pages = spark.createDataFrame([(k, "http://host0.example.com/c") for k in range(4)], "page_id bigint, page_url string")
    assets = spark.createDataFrame([("http://host1.example.com/a", "x"), ("http://host1.example.com/b", None)], "url string, body string")
    want = {(x.request_id, x.route) for x in routing.routed(spark.createDataFrame(rows, REQUEST), pages, assets, ["http://ads."], same_url=6, same_page=25).collect()}
    assert {x[1] for x in want} >= {"ignored", "closed", "page", "local", "aborted", "cached", "redirect", "live"}

    def run(name):
        stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/{name}/in")
        out = router.routed_stream(stream, pages, assets, ["http://ads."], same_url=6, same_page=25)
        out.writeStream.format("parquet").option("path", f"{tmp_path}/{name}/out").option("checkpointLocation", f"{tmp_path}/{name}/state").trigger(availableNow=True).start().awaitTermination()

    for name, cuts in (("one", [0, 160]), ("several", [0, 3, 50, 51, 160])):
        (tmp_path / name / "in").mkdir(parents=True)
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            text = spark.createDataFrame(rows[lo:hi], REQUEST).toJSON().collect()
            (tmp_path / name / "in" / f"{k}.json").write_text("\n".join(text))
            run(name)  # each time the stream starts again from its checkpoint
        got = [(x.request_id, x.route) for x in spark.read.parquet(f"{tmp_path}/{name}/out").collect()]
        assert len(got) == len(rows) and set(got) == want


def test_assets_are_fetched_once_at_a_time(states, tmp_path):
    spark = states
    rows = [("t", "u", 1, 0), ("t", "u", 2, 50), ("t", "v", 3, 60), ("t2", "u", 4, 60), ("t", "u", 5, 99), ("t", "u", 6, 100), ("t", "u", 7, 150), ("t", "u", 8, 400)]
    schema = "timestamp string, url string, request_id bigint, asked_ms bigint"
    for k, part in enumerate((rows[:2], rows[2:7], rows[7:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
        router.fetched_once(stream, 100).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = {x.request_id: (x.fetch, x.of_request) for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: (True, 1), 2: (False, 1), 3: (True, 3), 4: (True, 4), 5: (False, 1), 6: (True, 6), 7: (False, 6), 8: (True, 8)} and k == 2


def test_metric_log(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = metrics.logged(spark, "a", [("loss", 1, 0.5), ("loss", 2, 0.25), ("f1", 2, 0.9)])
    metrics.append(rows, path, 0)
    metrics.append(rows, path, 0)  # replayed
    metrics.append(metrics.logged(spark, "b", [("loss", 2, 0.75)]), path, 1)
    metrics.append(metrics.logged(spark, "a", [("loss", 2, 0.2)]), path, 2)  # resumed from step 1
    log = metrics.read(spark, path)
    assert sorted(map(tuple, log.collect())) == [("a", 1, "loss", 0.5), ("a", 2, "f1", 0.9), ("a", 2, "loss", 0.2), ("b", 2, "loss", 0.75)]
    assert [tuple(r) for r in metrics.compared(log, "loss", ["a", "b"]).orderBy("step").collect()] == [(1, 0.5, None), (2, 0.2, 0.75)]
    source = f"{tmp_path}/in"
    for k in range(2):
        metrics.logged(spark, "s", [("loss", k, k / 2)]).coalesce(1).write.mode("append").json(source)
        metrics.stream(spark.readStream.schema(metrics.SCHEMA).json(source), f"{tmp_path}/streamed", f"{tmp_path}/state").awaitTermination()
    assert sorted(r.step for r in metrics.read(spark, f"{tmp_path}/streamed").collect()) == [0, 1]


def test_validation_stops_early(spark, tmp_path):
    bad = {5, 70, 71, 300, 900}
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.when(F.col("id").isin(*bad), "bad").otherwise("fine").alias("html"))
    pages.repartitionByRange(8, "page_id").sortWithinPartitions("page_id").write.parquet(f"{tmp_path}/pages")
    table = spark.read.parquet(f"{tmp_path}/pages")

    def check(limit):
        def run(own):
            late = F.when(F.col("page_id") >= limit, F.raise_error(F.lit("read too far"))).otherwise(F.col("html") == "fine")
            return own.select("page_id", late.cast("boolean").alias("valid"))

        return run

    assert labels.first_invalid(table, check(192), 3) == ([5, 70, 71], 72, 2)  # pages from 192 on would fail
    assert labels.first_invalid(table, check(9999), 9) == (sorted(bad), 2000, 6)
    assert labels.first_invalid(table.limit(0), check(0), 3) == ([], 0, 0)


def walk(a, b):
    """Differences of two tables {xpath: (value, pos)}, node by node."""
    out = set()
    up = lambda x: x.rsplit("/", 1)[0]
    for x in a.keys() | b.keys():
        parent = up(x)
        if parent and not (parent in a and parent in b):
            continue
        if x not in b:
            out.add((x, "only first"))
        elif x not in a:
            out.add((x, "only second"))
        else:
            out |= {(x, p) for p, k in (("value", 0), ("place", 1)) if a[x][k] != b[x][k]}
    return out


def test_trees_compared_by_digests(spark):
    r = random.Random(8)

    def grown(path, depth, out):
        seen = {}
        for pos in range(r.randrange(1, 4) if depth < 5 else 0):
            tag = r.choice("abc")
            seen[tag] = seen.get(tag, 0) + 1
            x = f"{path}/{tag}[{seen[tag]}]"
            out[x] = (r.choice(["", "v", None]), pos)
            grown(x, depth + 1, out)
        return out

    first = {t: grown("/html", 0, {"/html": ("", 0)}) for t in range(8)}
    second = {t: dict(x) for t, x in first.items()}
    some = sorted(second[0])
    del second[0][some[-1]]  # a leaf is missing
    second[1]["/html/new"] = ("", 9)  # one too many
    second[1]["/html/new/text()"] = ("x", 0)
    children = [x for x in second[2] if x.count("/") == 2][:2]
    if len(children) == 2:  # two children have changed places
        (v, p), (w, q) = second[2][children[0]], second[2][children[1]]
        second[2][children[0]], second[2][children[1]] = (v, q), (w, p)
    deep = max(second[3], key=lambda x: x.count("/"))
    second[3][deep] = ("changed", second[3][deep][1])
    second[4] = {}
    table = lambda d: structure.digested(spark.createDataFrame([(t, x, v, p) for t, rows in d.items() for x, (v, p) in rows.items()], "page_id bigint, xpath string, value string, pos int"))
    found, opened = structure.differences(table(first), table(second))
    none = lambda d: {x: ("\0" if v is None else v, p) for x, (v, p) in d.items()}
    assert {(x.page_id, x.xpath, x.problem) for x in found.collect()} == {(t, *x) for t in first for x in walk(none(first[t]), none(second[t]))}
    assert sum(opened) < sum(map(len, first.values())) / 2
    same, opened = structure.differences(table(first), table(first))
    assert same.count() == 0 and opened == [8]


def test_refused_requests_do_not_count(spark):
    rows = spark.createDataFrame([(1, k, "http://ads.x/") for k in range(5)], REQUEST)
    assert routing.guarded(rows, ignored(F.col("url"), ["http://ads."], None), same_url=2).where("guard is not null").count() == 0
