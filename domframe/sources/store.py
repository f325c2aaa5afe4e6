"""Stores: pages as Parquet tables with upsert, SQLite page stores, word vectors, assets, parameters, lists and results."""
from __future__ import annotations

import re
import uuid
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.relational import numbered, upsert
from . import files

PAGES = "id bigint, url string, html string, visuals string"


class PageStore:
    """A Parquet folder of versions; each write makes a new version, which a pointer file then names."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        found = [s.getPath() for s in fs.listStatus(fs_path) if s.isDirectory()]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(p.toString() for p in found if fs.exists(done(p.toString() + "/_SUCCESS")))

    def read(self) -> DataFrame:
        versions = self._versions()
        return self.spark.read.schema(PAGES).parquet(versions[-1]) if versions else self.spark.createDataFrame([], PAGES)

    def _write(self, df: DataFrame) -> None:
        df.select("id", "url", "html", "visuals").write.parquet(f"{self.path}/v{len(self._versions()):08d}-{uuid.uuid4().hex[:8]}")

    def add(self, pages: DataFrame) -> None:
        self._write(self.read().unionByName(pages.select("id", "url", "html", "visuals")))

    def replace(self, pages: DataFrame) -> None:
        self._write(upsert(self.read(), pages.select("id", "url", "html", "visuals"), "id"))

    def window(self, first: int, count: int) -> DataFrame:
        """The pages of one website in a store of several: `count` ids from `first` on, numbered from 0."""
        own = self.read().where((F.col("id") >= first) & (F.col("id") < first + count))
        return own.withColumn("id", F.col("id") - first)

    def __len__(self) -> int:
        return self.read().count()

    def get(self, id_: int) -> dict:
        rows = self.read().where(F.col("id") == id_).take(1)
        if not rows:
            raise RuntimeError(f"no page {id_}")
        return rows[0].asDict()


class SqlitePages(DataSource):
    """Pages of SQLite files: spark.read.format("sqlite_pages").option("parts", n).load(path). Ids are read in ranges.

    path is one SQLite file, or a store: a folder whose manifest names its files. df.write.format("sqlite_pages") makes or
    adds to a store: each task writes a file of its own, and only the commit makes all of them visible, by a new manifest.
    Of pages with one id the last written counts.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _SqliteWriter(self.options["path"].rstrip("/"), [f.name for f in schema.fields], overwrite)


class _Range(InputPartition):
    def __init__(self, low: int, high: int, names: list[str] | None = None):
        self.low, self.high, self.names = low, high, names


class _Part(WriterCommitMessage):
    def __init__(self, name: str | None, low: int = 0, high: int = -1, rows: int = 0):
        self.name, self.low, self.high, self.rows = name, low, high, rows


_TABLE = "CREATE TABLE IF NOT EXISTS pages (id INTEGER PRIMARY KEY, url TEXT NOT NULL, html TEXT NOT NULL, visuals TEXT NULL)"
_WANTED = "SELECT id, url, html, visuals FROM pages WHERE id >= ? AND id < ? ORDER BY id"


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"].rstrip("/"), int(options.get("parts", 4))

    def _open(self, name: str | None = None):
        import sqlite3

        if name is None:
            return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        db = sqlite3.connect(":memory:")
        db.deserialize(files.read(f"{self.path}/{name}"))
        return db

    def partitions(self):
        manifest = files.read_json(f"{self.path}/manifest.json")
        if manifest is None:
            with self._open() as db:
                low, high = db.execute("SELECT min(id), max(id) FROM pages").fetchone()
            held = None
        else:
            held = [x for x in manifest["files"] if x["rows"]]
            low, high = min((x["low"] for x in held), default=None), max((x["high"] for x in held), default=None)
        if low is None:
            return [_Range(0, 0, [])]
        step = max(1, -(-(high + 1 - low) // self.parts))
        return [_Range(a, min(a + step, high + 1), None if held is None else [x["name"] for x in held if x["low"] < a + step and x["high"] >= a]) for a in range(low, high + 1, step)]

    def read(self, partition):
        if partition.names is None:
            with self._open() as db:
                yield from db.execute(_WANTED, (partition.low, partition.high))
            return
        seen: set[int] = set()
        for name in reversed(partition.names):
            with self._open(name) as db:
                for row in db.execute(_WANTED, (partition.low, partition.high)):
                    if row[0] not in seen:
                        seen.add(row[0])
                        yield row


class _SqliteWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.at = [columns.index(c) for c in ("id", "url", "html", "visuals")]

    def write(self, iterator) -> WriterCommitMessage:
        import sqlite3

        db = sqlite3.connect(":memory:")
        db.execute(_TABLE)
        db.executemany("INSERT OR REPLACE INTO pages VALUES (?, ?, ?, ?)", (tuple(row[k] for k in self.at) for row in iterator))
        db.commit()
        low, high, rows = db.execute("SELECT min(id), max(id), count(*) FROM pages").fetchone()
        if not rows:
            return _Part(None)
        name = f"pages-{low:012d}-{uuid.uuid4().hex}.db"
        files.write(f"{self.path}/{name}", db.serialize())
        return _Part(name, low, high, rows)

    def commit(self, messages) -> None:
        old = None if self.overwrite else files.read_json(f"{self.path}/manifest.json")
        new = [{"name": m.name, "low": m.low, "high": m.high, "rows": m.rows} for m in messages if m is not None and m.name]
        files.write_json(f"{self.path}/manifest.json", {"files": (old["files"] if old else []) + new})

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.name:
                files.delete(f"{self.path}/{m.name}")


def write_sqlite(pages: DataFrame, path: str, parts: int = 8) -> int:
    """Writes pages to a store of SQLite files, one for each range of ids; the number of pages written."""
    pages.sparkSession.dataSource.register(SqlitePages)
    dealt = pages.select("id", "url", "html", "visuals").repartitionByRange(parts, "id")
    dealt.write.format("sqlite_pages").mode("overwrite").save(path)
    return sum(x["rows"] for x in files.read_json(f"{path.rstrip('/')}/manifest.json")["files"])


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """token, id (from 1, by line), vector of a text file: a token and its numbers on each line.

    Lines are numbered within each partition, after the lines of those before: one count of each reaches the driver.
    """
    rows = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_m"))
    part, line = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for p, n in sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        starts.append((p, total))
        total += n
    offset = spark.createDataFrame(starts or [(0, 0)], "_p bigint, _start bigint")
    parts = F.split("value", " ")
    listed = rows.withColumn("_p", part).join(F.broadcast(offset), "_p")
    return listed.select(F.get(parts, F.lit(0)).alias("token"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("float")).alias("vector"), (F.col("_start") + line + 1).alias("id"))


def cache_assets(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (timestamp, url, status, sha256; null: aborted) and blobs (sha256, body) of assets(timestamp, url, status, body)."""
    hashed = assets.withColumn("sha256", F.when(F.col("body").isNotNull(), F.sha2(F.col("body").cast("binary"), 256)))
    entries = hashed.groupBy("timestamp", "url").agg(F.min(F.struct("status", "sha256")).alias("e")).select("timestamp", "url", "e.*")
    return entries, hashed.where("sha256 is not null").groupBy("sha256").agg(F.min("body").alias("body"))


def lookup_assets(requests: DataFrame, entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """requests(timestamp, url) with outcome (miss, aborted or hit), status and body."""
    e = entries.withColumn("_e", F.lit(True))
    out = requests.join(e, ["timestamp", "url"], "left").join(blobs, "sha256", "left")
    return out.withColumn("outcome", F.when(F.col("_e").isNull(), "miss").when(F.col("sha256").isNull(), "aborted").otherwise("hit")).drop("_e")


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON, one on each line of the files of a folder."""
    df.write.mode("overwrite").json(path)


def write_record_arrays(df: DataFrame, path: str) -> None:
    """Records as JSON, each file of a folder one array of objects; absent values are written as null."""

    def run(batches):
        first = True
        for batch in batches:
            for text in batch["value"]:
                yield pd.DataFrame({"value": [("[\n" if first else ",\n") + text]})
                first = False
        if not first:
            yield pd.DataFrame({"value": ["]"]})

    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    lines.mapInPandas(run, "value string").write.mode("overwrite").text(path)


#: What opening a website does, by whether a store exists, exact pages exist, and what is asked for.
USE_STORE, CONVERT_SLIM, CONVERT_FULL, READ_SLIM, READ_FULL = "use store", "convert slim", "convert full", "read slim", "read full"


def opening(has_store: bool, exact_html: bool, convert: bool, convert_slim: bool) -> str:
    """The way a website's pages are opened: a store that exists is used; else records are converted, or read as they are.

    Records without pages (slim ones) do for a conversion where exact pages lie beside them.
    """
    if convert:
        return USE_STORE if has_store else CONVERT_SLIM if exact_html else CONVERT_FULL
    return READ_SLIM if convert_slim else READ_FULL


def converted(store: PageStore, pages: DataFrame, exact: DataFrame | None = None, with_visuals_only: bool = False) -> DataFrame:
    """Fills an empty store from pages(url, html, visuals), with exact(url, html) in place of their html where it exists.

    Pages are numbered from 0 in the order of index; those without visuals go first, if asked for. A store that holds
    pages is left as it is. Returns the store's pages.
    """
    if len(store):
        return store.read()
    rows = pages if exact is None else pages.join(exact.select("url", F.col("html").alias("_exact")), "url", "left").withColumn("html", F.coalesce("_exact", "html")).drop("_exact")
    if with_visuals_only:
        rows = rows.where("visuals is not null")
    store.add(numbered(rows, "index").withColumnRenamed("_number", "id"))
    return store.read()


def reloaded(store: PageStore, fresh: DataFrame, ids: list[int] | DataFrame) -> None:
    """Takes the pages of ids (a list, or a table of them) anew from fresh(id, url, html, visuals); those that it lacks stay."""
    store.replace(fresh.join(ids.select("id"), "id", "left_semi") if isinstance(ids, DataFrame) else fresh.where(F.col("id").isin(*ids)))


def cached_xpaths(spark: SparkSession, path: str, make) -> DataFrame:
    """website, xpath, texts, labeled from the Parquet folder at path; make() fills it where it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _natural(name: str) -> list:
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.findall(r"[0-9]+|[^0-9]+", name)]


def versions(root: str) -> list[str]:
    """Paths of version folders, in natural order of their names."""
    return [f"{root.rstrip('/')}/{d}" for d in sorted(files.listed(root, folders=True), key=_natural)]


def latest_model(root: str) -> tuple[str, dict, dict]:
    """The last version's folder with its model card (info.json) and parameters (params.json)."""
    found = versions(root)
    if not found:
        raise FileNotFoundError(f"no version in {root}")
    card, params = (files.read_json(f"{found[-1]}/{name}") for name in ("info.json", "params.json"))
    if card is None or params is None:
        raise FileNotFoundError(f"no model card or parameters in {found[-1]}")
    return found[-1], card, params


def write_card(version: str, labels: list[str], vertical: str, websites: list[dict]) -> None:
    """The model card of a version: its labels, its vertical, and of each website its name and common URL prefix."""
    files.write_json(f"{version}/info.json", {"labels": labels, "vertical": vertical, "websites": websites})


def write_results(version: str, results: dict) -> None:
    """Metrics of a version as results.json in its folder; these are small, and written by the driver."""
    files.write_json(f"{version}/results.json", results)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """run, metric, value of all versions with results, in natural order of their names; absent metrics are null."""
    rows = []
    for i, path in enumerate(versions(root)):
        held = files.read_json(f"{path}/results.json")
        rows += [(i, path.rsplit("/", 1)[1], k, None if v is None else float(v)) for k, v in (held or {}).items()]
    return spark.createDataFrame(rows, "place int, run string, metric string, value double")


def load_params(path: str, defaults: dict) -> dict:
    """Parameters from JSON over defaults; the file is made if it is missing; unknown names are an error."""
    own = files.read_json(path)
    if own is None:
        files.write_json(path, defaults)
        return dict(defaults)
    if unknown := set(own) - set(defaults):
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    return defaults | own


def params_difference(a: dict, b: dict, ignored: tuple[str, ...] = ()) -> dict:
    return {k: (a.get(k), b.get(k)) for k in sorted(a.keys() | b.keys()) if k not in ignored and a.get(k) != b.get(k)}


def for_inference(params: dict) -> dict:
    """Parameters of a trained model as inference takes them: no validation of pages, and nodes beyond variable ones too."""
    return params | {"validate_data": False, "classify_only_variable_nodes": False}


class Version(NamedTuple):
    """A numbered folder of a run, v<number> or v<number>-<name>."""

    root: str
    number: int
    name: str

    @property
    def folder(self) -> str:
        return f"v{self.number}" + (f"-{self.name}" if self.name else "")

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.folder}"

    @classmethod
    def all(cls, root: str) -> list[Version]:
        """Versions in a folder, by number."""
        found = [re.fullmatch(r"v(\d+)(?:-(.*))?", d) for d in files.listed(root, folders=True)]
        return sorted((cls(root, int(m[1]), m[2] or "") for m in found if m), key=lambda v: v.number)

    @classmethod
    def created(cls, root: str, name: str = "") -> Version:
        """The next version; an unnamed last one is used again for another unnamed one, a last one of the same name is an error."""
        last = (cls.all(root) or [None])[-1]
        if last and last.name == name and name:
            raise RuntimeError(f"the last version is {last.folder} already")
        out = cls(root, 1 if last is None else last.number + (name != "" or last.name != ""), name)
        files.make_dir(out.path)
        return out

    def trashed(self) -> str:
        """Moves the version out of the way; its path in the trash beside the versions' folder."""
        target = f"{self.root.rstrip('/')}-trash/{self.folder}-{uuid.uuid4().hex[:8]}"
        files.move(self.path, target)
        return target


def copied_versions(source: str, target: str, first: int, dry: bool = False) -> list[tuple[str, str]]:
    """Copies all versions of one folder to another, numbered anew from `first` in their order; the paths of each."""
    pairs = [(v.path, Version(target, first + k, v.name).path) for k, v in enumerate(Version.all(source))]
    for a, b in [] if dry else pairs:
        files.make_dir(b)
        files.copy_dir(a, b)
    return pairs


def next_version(root: str) -> str:
    """Path of a new version folder: one more than the greatest number found."""
    out = Version(root, max((v.number for v in Version.all(root)), default=0) + 1, "")
    files.make_dir(out.path)
    return out.path


def updated_list(listed: DataFrame, invalid: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """A list of invalid keys with new ones added and valid ones dropped, sorted."""
    return listed.select(key).unionByName(invalid.select(key)).distinct().join(valid, key, "left_anti").orderBy(key)
