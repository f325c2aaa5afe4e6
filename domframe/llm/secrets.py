"""Secret scans: patterns find candidates, and their ownership over the corpus tells live credentials from examples.

Every text is scanned for three base kinds and for other tokens that look like credentials. Only digests of what was found
leave a task. Candidates are aggregated by digest to the numbers of distinct repositories and owners that hold them: what
several owners share is copied from documentation, what one owner alone holds and what looks random is most likely live.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans of one start are listed; `token` is what the method adds.
KINDS = ("assign", "access", "hex", "token")
#: The base patterns, and the least length of what they find.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
#: Other tokens: least and most length, least bits of entropy a character, and words that mark placeholders.
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]+")
LEAST_TOKEN, MOST_TOKEN, LEAST_BITS = 20, 512, 3.0
PLACEHOLDER = re.compile(rb"example|sample|dummy|changeme|placeholder|redacted|your|xxxx|test|0123456|1234567|abcdef0", re.IGNORECASE)
#: Owners from which on a candidate counts as widely copied.
SHARED_BY = 3

_HEX, _TOKEN, _DIGIT, _ALPHA = (np.zeros(256, dtype=bool) for _ in range(4))
_DIGIT[[*range(0x30, 0x3A)]] = True
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_TOKEN[[*b"+/_=-"]] = True
_TOKEN |= _DIGIT | _ALPHA


def bits(value: bytes) -> float:
    """Entropy of a value's bytes, in bits a byte."""
    n = np.bincount(np.frombuffer(value, np.uint8))
    p = n[n > 0] / len(value)
    return float(-(p * np.log2(p)).sum())


def looks_live(value: bytes) -> bool:
    """Long enough, of letters and digits, random by its entropy, and no placeholder."""
    raw = np.frombuffer(value, np.uint8)
    return len(value) >= 16 and bool(_DIGIT[raw].any() and _ALPHA[raw].any()) and bits(value) >= LEAST_BITS and not PLACEHOLDER.search(value)


def runs(inside: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of at least that length."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return zip(start[long].tolist(), end[long].tolist(), strict=True)


def found(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """Kind number, start, end (bytes) and value of all candidates of a text, by start and kind.

    Base kinds are matched from the left without overlap in each kind, and matches that are too short are dropped then.
    Tokens are runs that look live and touch no base span.
    """
    raw = np.frombuffer(text, np.uint8)
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(2, lo, hi, text[lo:hi]) for lo, hi in runs(_HEX[raw], LEAST_HEX)]
    taken = sorted((lo, hi) for _, lo, hi, _ in out)
    at = 0
    reach = 0  # the furthest end of the base spans that begin before the run's end
    for lo, hi in runs(_TOKEN[raw], LEAST_TOKEN):
        while at < len(taken) and taken[at][0] < hi:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= lo and hi - lo <= MOST_TOKEN and looks_live(text[lo:hi]):
            out.append((3, lo, hi, text[lo:hi]))
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def code_points(text: bytes, places: list[int]) -> list[int]:
    """The code points before each place (bytes)."""
    if text.isascii():
        return places
    order = np.argsort(places, kind="stable")
    out, at, count = np.zeros(len(places), np.int64), 0, 0
    for k in order.tolist():
        part = np.frombuffer(text[at : places[k]], np.uint8)
        count += int(((part & 0xC0) != 0x80).sum())
        at = places[k]
        out[k] = count
    return out.tolist()


SPAN = "kind int, start bigint, stop bigint, digest binary, live boolean"


def candidates(docs: DataFrame, owner: Column | str = "source", repository: Column | None = None) -> DataFrame:
    """Per row of docs: row, doc_id, owner, repository, spans (array of kind, start, stop, digest, live); places in code points.

    owner and repository are read as strings, null as empty; a repository belongs to its owner, and is the owner's own one
    where none is given. Digests are SHA-256 of the values, so that no secret leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary()), ("live", pa.bool_())])
        for batch in batches:
            spans = []
            for _, _, texts in common.text_slices(batch):
                for text in texts:
                    own = found(text)
                    places = code_points(text, [p for x in own for p in x[1:3]]) if own else []
                    spans.append([{"kind": k, "start": lo, "stop": hi, "digest": hashlib.sha256(value).digest(), "live": looks_live(value)} for (k, _, _, value), lo, hi in zip(own, places[::2], places[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "owner", "repository")], pa.array(spans, pa.list_(item))], names=["doc_id", "owner", "repository", "spans"])

    own = F.coalesce((F.col(owner) if isinstance(owner, str) else owner).cast("string"), F.lit(""))
    part = F.lit("") if repository is None else F.coalesce(repository.cast("string"), F.lit(""))
    read = common.texts_of(docs, F.col("doc_id").cast("bigint"), own.alias("owner"), part.alias("repository"), "text")
    return read.mapInArrow(run, f"doc_id bigint, owner string, repository string, spans array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SPAN.split(', '))}>>").withColumn("row", F.monotonically_increasing_id())


def ownership(rows: DataFrame) -> DataFrame:
    """digest, repositories, owners, places: how many distinct repositories and owners, and places in all, hold each candidate."""
    each = rows.select("owner", "repository", F.explode("spans.digest").alias("digest"))
    repositories = each.groupBy("digest", "owner", "repository").agg(F.count("*").alias("n"))
    owners = repositories.groupBy("digest", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"), F.sum("n").alias("places"))


def scan(docs: DataFrame, owner: Column | str = "source", repository: Column | None = None, shared_by: int = SHARED_BY) -> DataFrame:
    """Per row of docs(doc_id, text, owner's columns): doc_id and spans, an array of (kind, start, stop, digest, owners,
    repositories, verdict) by start, then kind.

    verdict: `shared` for values of shared_by owners or more, `live` for those of one owner that look live, else `open`.
    Spans of base kinds all stay; tokens stay only where they are live. Null and empty texts have no spans. Null owners
    are one owner, the empty one. Rows stay as they are, repeats included; texts are scanned whole; other columns are
    ignored; an empty table gives an empty result. Nothing is gathered by value: a value is counted by partial sums, and
    its counts are joined to its places, which adaptive execution can split.
    """
    rows = common.written(candidates(docs, owner, repository), "candidates")
    known = common.written(ownership(rows), "ownership")
    each = rows.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(known, "digest")
    verdict = F.when(F.col("owners") >= shared_by, "shared").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("open")
    judged = each.withColumn("verdict", verdict).where((F.col("kind") < len(KINDS) - 1) | (F.col("verdict") == "live"))
    item = F.struct("start", "kind", "stop", "digest", "owners", "repositories", "verdict")
    by_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    named = F.array(*[F.lit(k) for k in KINDS])
    kind = lambda x: F.get(named, x["kind"])
    out = rows.select("row", "doc_id").join(by_row, "row", "left")
    spans = F.transform("spans", lambda x: F.struct(kind(x).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), x["digest"].alias("digest"), x["owners"].alias("owners"), x["repositories"].alias("repositories"), x["verdict"].alias("verdict")))
    nothing = F.array().cast("array<struct<kind: string, start: bigint, stop: bigint, digest: binary, owners: bigint, repositories: bigint, verdict: string>>")
    return out.select("doc_id", F.coalesce(spans, nothing).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
