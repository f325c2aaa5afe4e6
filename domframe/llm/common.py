"""Shared helpers: the folder all executors see, written tables, and words of whole texts as numpy arrays."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Bytes of text that a vectorised step holds at once; single longer texts are handled alone, whole.
SLICE_BYTES = 2_000_000

#: Rows and bytes of an Arrow batch of texts.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20

_LOCAL: dict[str, str] = {}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: A word, as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="domframe-")
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, and survives lost executors.

    What is not deleted before goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "written_path", None)
        if path:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def texts_of(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """docs.select(*columns), on its way to Python: batches of texts are kept small, in bytes too, on both sides of the pipe."""
    conf = docs.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        try:
            now = int(conf.get(name))
        except (ValueError, PySparkException):  # in units, or not known to this version
            now = 0
        if not 0 < now <= most:
            conf.set(name, str(most))
    return docs.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_index(df: DataFrame, name: str) -> DataFrame:
    """df in its present partitions and order, written with a dense bigint column `name` from 0.

    Only one count per partition reaches the driver.
    """
    raw = written(df.withColumn("_mono", F.monotonically_increasing_id()), "index")
    part, row = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in raw.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((int(p), total))
        total += n
    offsets = raw.sparkSession.createDataFrame(starts or [(0, 0)], "_part bigint, _start bigint")
    out = raw.withColumn("_part", part).join(F.broadcast(offsets), "_part", "left").withColumn(name, F.col("_start") + row).drop("_part", "_start", "_mono")
    out.written_path = raw.written_path
    return out


def running(df: DataFrame, group: list[str], order: list[str], value: str, most: int = 50_000) -> DataFrame:
    """df with rank (from 0) and upto (the sum of value so far, its own included) of each row in its group, by order.

    Rows are sorted by range and summed in parts of about `most`, so that a group of any size spreads over tasks; what
    came before a part is summed from one row for each part and group. group holds no nulls, and order tells rows apart.
    """
    df = written(df, "unordered")
    parts = max(1, -(-df.count() // most))
    parted = written(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    discard(df)
    own = W.partitionBy("_part", *group).orderBy(*order)
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = parted.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    sums = sums.select("_part", *group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_v")])
    upto = parted.withColumn("rank", F.row_number().over(own) - 1).withColumn("upto", F.sum(value).over(own))
    out = upto.join(sums, ["_part", *group]).select(*df.columns, (F.col("rank") + F.col("_n")).alias("rank"), (F.col("upto") + F.col("_v")).alias("upto"))
    out.written_path = parted.written_path
    return out


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from row, to row, UTF-8 texts) of a batch; nulls are empty. A slice holds `most` bytes, or one longer text."""
    texts = batch.column(column)
    texts = (texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts).cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, texts.slice(lo, hi - lo).to_pylist()
        lo = hi


def learning_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int, folds: int) -> DataFrame:
    """doc_id, text, _y: the labelled texts that a classifier is fitted on, chosen by a hash of doc_id.

    Of labels(doc_id, label) outside the held-out fold, `most` rows at most, and of their texts so many that they hold
    most_bytes together; larger ones are left out whole. A repeated doc_id counts once, with its least label and the text
    of the least hash. The driver sees one number for each chosen row.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isNotNull() & (fold != 0))
    order = F.xxhash64("doc_id")
    chosen = known.groupBy("doc_id").agg(F.min("_y").alias("_y")).orderBy(order, "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")
    sizes = found.groupBy("doc_id", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("s")).select("doc_id", "_y", "s.h", "s.size", order.alias("o")).collect()
    rows, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["o"], r["doc_id"])):
        if total + r["size"] <= most_bytes:
            total += r["size"]
            rows.append((r["doc_id"], r["h"], r["_y"]))
    taken = docs.sparkSession.createDataFrame(rows, "doc_id bigint, _h bigint, _y int")
    same = texts.withColumn("_h", F.xxhash64("text")).join(F.broadcast(taken), ["doc_id", "_h"])
    return same.dropDuplicates(["doc_id"]).select("doc_id", "text", "_y")


class Words:
    """Words of several texts, joined by one space each.

    buf: their bytes, each word followed by one space; start, end: of each word in buf; first: index of each text's
    first word, and the number of all words at last.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        space = _SPACE[raw]
        after = np.empty(len(raw), dtype=bool)
        after[0] = True
        after[1:] = space[:-1]
        starts = np.flatnonzero(~space & after)
        keep = ~(space & after)
        self.buf = (_LOWER[raw] if lower else raw)[keep].copy()
        ends = np.flatnonzero(space & ~after)  # the space after each word
        sizes = ends - starts
        begin = np.cumsum(sizes + 1)
        self.start = begin - sizes - 1
        self.end = begin - 1
        self.buf[self.end] = 0x20
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(starts, bounds)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def encoded(self) -> tuple[np.ndarray, list[bytes]]:
        """Index of each word among the distinct words, and those."""
        if not len(self):
            return np.zeros(0, np.int64), []
        mask = np.ones(len(self.buf), dtype=bool)
        mask[self.end] = False
        offsets = np.concatenate(([0], np.cumsum(self.end - self.start))).astype(np.int64)
        arr = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.buf[mask])])
        coded = arr.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] for each i; empty segments sum to 0."""
    cum = np.concatenate(([0], np.cumsum(values)))
    return cum[first[1:]] - cum[first[:-1]]
