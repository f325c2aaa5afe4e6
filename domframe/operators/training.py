"""Training of the node network over Spark: a step's rows give summed gradients, and the driver holds the parameters only.

Rows are written once, in as many slices as an epoch has steps, so that a step reads just its own. Tasks compute gradients
on Arrow batches and sum them; lookup tables give a row for each number that occurs. Sums over tasks are taken in the order
of the tasks, so that a step gives the same parameters whenever it runs.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from . import network
from .network import Batch, Lists, Nodes, Settings

#: Rows of an Arrow batch that a gradient is computed on.
ROWS = 256
#: Files of a slice at least, and rows of a file at most on average.
FILES, FILE_ROWS = 16, 20_000
LISTS = "array<array<int>>"
#: Columns of the network's input beside the key and y.
INPUT = f"words {LISTS}, tag int, attrs array<int>, dense array<double>, path array<int>, path_attrs {LISTS}, neighbors array<struct<words: {LISTS}, tag: int, attrs: array<int>, dense: array<double>, edge: array<double>>>"
_COLUMNS = ("words", "tag", "attrs", "dense", "path", "path_attrs", "neighbors", "y")
#: Column of packed().
PACKED = "packed"
_GRADIENT = "slot string, row bigint, piece int, value array<double>"


def _lists(column: pa.Array) -> Lists:
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return Lists(np.concatenate(([0], np.cumsum(size))).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64))


def _dense(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width) if width else np.zeros((len(column), 0))


def _joined(a: Lists, b: Lists) -> Lists:
    return Lists(np.concatenate((a.first, b.first[1:] + a.first[-1])), np.concatenate((a.ids, b.ids)))


def batch_of(s: Settings, rows: pa.RecordBatch) -> Batch:
    """The network's input from an Arrow batch with the columns of INPUT and y."""
    near = rows.column("neighbors")
    first = np.concatenate(([0], np.cumsum(near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    flat = near.flatten()
    part = (lambda c: pa.concat_arrays([rows.column(c), flat.field(c)])) if s.neighbors else rows.column
    tag = part("tag").to_numpy(zero_copy_only=False).astype(np.int64)
    nodes = Nodes(_lists(part("words").flatten()), tag, _dense(part("dense"), s.dense), _lists(part("attrs")))
    edge = _dense(flat.field("edge"), s.edge) if s.neighbors else np.zeros((0, s.edge))
    y = rows.column("y").to_numpy(zero_copy_only=False).astype(np.int64) if "y" in rows.schema.names else np.zeros(len(rows), np.int64)
    return Batch(nodes, len(rows), first if s.neighbors else np.zeros(len(rows) + 1, np.int64), edge, _lists(rows.column("path")), _lists(rows.column("path_attrs").flatten()), y)


def packed(rows: DataFrame, path: str) -> None:
    """Writes rows(INPUT, y) as a column of bytes, up to ROWS rows each, in the order in which they come.

    A step then reads them as they are, in place of making nested columns of Spark's into Arrow's in each epoch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _parts([whole]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[PACKED])

    rows.select(*[c for c in rows.columns if c in _COLUMNS]).mapInArrow(run, f"{PACKED} binary").write.parquet(path)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to ROWS rows each, of batches of rows or of packed() ones."""
    for whole in batches:
        if whole.schema.names == [PACKED]:
            for data in whole.column(PACKED):
                yield from pa.ipc.open_stream(data.as_buffer())
        else:
            for lo in range(0, len(whole), ROWS):
                yield whole.slice(lo, ROWS)


class State(NamedTuple):
    """Parameters with Adam's moments, the numbers of steps and epochs done, and the best loss on validation rows."""

    params: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int
    epoch: int
    best: float


def started(s: Settings, seed: int = 42, vectors: np.ndarray | None = None) -> State:
    params = network.initial(s, seed, vectors)
    return State(params, {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}, 0, 0, float("inf"))


class Optimizer(NamedTuple):
    """Adam with weight decay added to gradients and a bound on their common length; frozen: parameters that stay."""

    rate: float = 1e-3
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    decay: float = 0.0
    clip: float | None = 1.0
    frozen: tuple[str, ...] = ()


def updated(state: State, o: Optimizer, grads: dict[str, np.ndarray]) -> State:
    """One step; grads are of the mean loss, whole. Rows of lookup tables without a gradient move on by their moments."""
    grads = {k: g for k, g in grads.items() if k not in o.frozen}
    if o.clip is not None:
        length = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        grads = {k: g * (o.clip / (length + 1e-6)) for k, g in grads.items()} if length > o.clip else grads
    step = state.step + 1
    params, first, second = dict(state.params), dict(state.first), dict(state.second)
    for k, g in grads.items():
        g = g + o.decay * params[k]
        first[k] = o.betas[0] * first[k] + (1 - o.betas[0]) * g
        second[k] = o.betas[1] * second[k] + (1 - o.betas[1]) * g * g
        rise, spread = first[k] / (1 - o.betas[0] ** step), second[k] / (1 - o.betas[1] ** step)
        params[k] = params[k] - o.rate * rise / (np.sqrt(spread) + o.epsilon)
        if k == "words":
            params[k][0] = 0
    return State(params, first, second, step, state.epoch, state.best)


def summed(rows: DataFrame, s: Settings, params: dict[str, np.ndarray], seed: int | None) -> DataFrame:
    """slot, row, value: gradients of the summed loss over rows(INPUT, y), or packed() ones; seed: of dropout, none without.
    Slot loss: sum, rows.

    Each task sums its own batches; what leaves it is as large as the parameters that its rows touch.
    """
    held = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        dense: dict[str, np.ndarray] = {}
        sparse: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        loss = np.zeros(2)
        for k, part in enumerate(_parts(batches)):
            b = batch_of(s, part)
            t = network.Tape(held.value, None if seed is None else np.random.default_rng([seed, task, k]))
            loss += t.loss(network.logits(t, s, b), b.y, s.smoothing), b.count
            own, looked_up = t.gradients()
            for name, g in own.items():
                dense[name] = dense[name] + g if name in dense else g
            for name, (ids, g) in looked_up.items():
                before = sparse.get(name)
                sparse[name] = network.summed_by(np.concatenate((before[0], ids)), np.concatenate((before[1], g))) if before else (ids, g)
        if loss[1]:
            out = [("loss", 0, loss)] + [(n, i, x) for n, g in dense.items() for i, x in enumerate(g)] + [(n, i, x) for n, (ids, g) in sparse.items() for i, x in zip(ids.tolist(), g, strict=True)]
            slot, row, value = zip(*out, strict=True)
            for lo in range(0, len(out), 10_000):
                n = len(slot[lo : lo + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(slot[lo : lo + n]), pa.array(row[lo : lo + n], pa.int64()), pa.array([task] * n, pa.int32()), pa.array(value[lo : lo + n], pa.list_(pa.float64()))], names=["slot", "row", "piece", "value"])

    pieces = rows.mapInArrow(run, _GRADIENT).groupBy("slot", "row").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("p"))
    total = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), F.get("p", F.lit(0))["value"], lambda a, x: F.zip_with(a, x["value"], lambda u, v: u + v))
    return pieces.select("slot", "row", total.alias("value"))


def gathered(sums: DataFrame, params: dict[str, np.ndarray]) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss and number of rows, and gradients of the mean loss; the driver sees a row for each row of a parameter."""
    got = sums.toArrow()
    slot, row = np.array(got.column("slot").to_pylist(), object), got.column("row").to_numpy()
    value = got.column("value").combine_chunks()
    flat, first = value.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(value.value_lengths().to_numpy(zero_copy_only=False))))
    grads: dict[str, np.ndarray] = {}
    loss = np.zeros(2)
    for k in range(len(slot)):
        x = flat[first[k] : first[k + 1]]
        if slot[k] == "loss":
            loss = x
        else:
            grads.setdefault(slot[k], np.zeros_like(params[slot[k]]))[row[k]] = x
    n = max(1, int(loss[1]))
    return float(loss[0]) / n, int(loss[1]), {k: g / n for k, g in grads.items()}


def sliced(rows: DataFrame, keys: list[str], slices: int, path: str | None = None, together: list[str] | None = None) -> str:
    """Folder of rows, dealt to slices by a hash of their keys; a row without y is no training row.

    together: columns that are dealt by in place of keys. Rows that are neighbours are then mostly in one batch, which
    encodes texts that several rows have just once. Each file of a slice is a task's output, numbered and not hashed again,
    so that files have like numbers of rows and a step's tasks like work; their number grows with the rows.
    """
    path = path or f"{shared_dir(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    by = together or keys
    known = rows.where("y is not null")
    files = max(FILES, -(-known.count() // (slices * FILE_ROWS)))
    dealt = known.withColumn("slice", F.pmod(F.xxhash64(*by), F.lit(slices)).cast("int")).withColumn("file", F.pmod(F.xxhash64(F.lit(1), *by), F.lit(files)).cast("int"))
    own = dealt.repartitionById(slices * files, F.col("slice") * files + F.col("file")).drop("file")
    own.sortWithinPartitions("slice", *keys).write.partitionBy("slice").parquet(path)
    _until_end(rows.sparkSession, path)
    return path


def _until_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def mean_loss(rows: DataFrame, s: Settings, params: dict[str, np.ndarray]) -> float:
    held = rows.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                b = batch_of(s, whole.slice(lo, ROWS))
                t = network.Tape(held.value, keep=False)
                yield pa.RecordBatch.from_pydict({"loss": [t.loss(network.logits(t, s, b), b.y, s.smoothing)], "n": [b.count]})

    r = rows.mapInArrow(run, "loss double, n bigint").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    return float(r["loss"] or 0) / max(1, int(r["n"] or 0))


def train(spark: SparkSession, path: str, val: DataFrame | None, s: Settings, o: Optimizer, state: State, epochs: int, slices: int, seed: int = 42, checkpoints: str | None = None) -> tuple[State, list[tuple[str, int, float]]]:
    """State after `epochs` epochs over the slices in path, and the log (name, step, value) of losses; goes on from state.

    The order of an epoch's steps depends on seed and epoch only. Each epoch's state goes to checkpoints, if given.
    """
    log = []
    store = f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}"
    _until_end(spark, store)
    for k in range(slices if state.epoch < epochs else 0):
        packed(spark.read.parquet(path).where(F.col("slice") == k), f"{store}/{k}")
    for epoch in range(state.epoch + 1, epochs + 1):
        for k in np.random.default_rng([seed, epoch]).permutation(slices).tolist():
            rows = spark.read.schema(f"{PACKED} binary").parquet(f"{store}/{k}")
            loss, n, grads = gathered(summed(rows, s, state.params, seed + state.step), state.params)
            if n:
                state = updated(state, o, grads)
                log.append(("train_loss", state.step, loss))
        found = mean_loss(val, s, state.params) if val is not None else float("nan")
        state = state._replace(epoch=epoch, best=min(state.best, found) if found == found else state.best)
        log.append(("val_loss", state.step, found))
        if checkpoints:
            save(spark, state, s, f"{checkpoints}/epoch-{epoch:06d}")
    top = spark._jvm.org.apache.hadoop.fs.Path(store)
    top.getFileSystem(spark._jsc.hadoopConfiguration()).delete(top, True)
    return state, log


def predict(rows: DataFrame, s: Settings, params: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """keys, predicted, logits and probabilities of rows(keys, INPUT)."""
    held = rows.sparkSession.sparkContext.broadcast(params)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), ROWS):
                part = whole.slice(lo, ROWS)
                z = network.logits(network.Tape(held.value, keep=False), s, batch_of(s, part)).value
                e = np.exp(z - z.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array(z.argmax(axis=1).astype(np.int32)), pa.array(list(z), pa.list_(pa.float64())), pa.array(list(p), pa.list_(pa.float64()))], names=[*keys, "predicted", "logits", "probabilities"])

    return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", predicted int, logits array<double>, probabilities array<double>")


def save(spark: SparkSession, state: State, s: Settings, path: str) -> None:
    """Parameters and moments as rows, with the settings and the place in training."""
    rows = [(kind, name, i, x.tolist()) for kind, held in (("params", state.params), ("first", state.first), ("second", state.second)) for name, m in held.items() for i, x in enumerate(m)]
    told = json.dumps({"step": state.step, "epoch": state.epoch, "best": state.best, "settings": s._asdict()})
    frame = pd.DataFrame([*rows, ("state", told, 0, [])], columns=["kind", "name", "row", "value"])
    spark.createDataFrame(frame, "kind string, name string, row bigint, value array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> tuple[State, Settings]:
    held: dict[str, dict[str, list]] = {"params": {}, "first": {}, "second": {}}
    told = {}
    for r in spark.read.parquet(path).toPandas().sort_values(["kind", "name", "row"]).itertuples():
        if r.kind == "state":
            told = json.loads(r.name)
        else:
            held[r.kind].setdefault(r.name, []).append(r.value)
    params, first, second = ({k: np.array([np.asarray(x) for x in v]) for k, v in held[kind].items()} for kind in ("params", "first", "second"))
    own = told["settings"] | {"hidden": tuple(told["settings"]["hidden"])}
    return State(params, first, second, told["step"], told["epoch"], told["best"]), Settings(**own)


def latest(spark: SparkSession, path: str) -> str | None:
    """The last whole checkpoint in a folder."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(f.getPath().toString() for f in fs.listStatus(top) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) if fs.exists(top) else []
    return found[-1] if found else None
