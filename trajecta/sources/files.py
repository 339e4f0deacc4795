"""Recorded files: what is there of what is expected, what changed since it was read, and sinks with digests."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from trajecta.sources.store import EPISODE, BadInput

# Names of recorded files, what a parser finds in them, and what may be wrong with one.
FILE_NAME = r"train_([0-9a-f]{16})_r(\d+)\.json(?:\.gz)?$"
MISSING, CORRUPT, CHANGED, OTHER = "source_missing", "source_corrupt", "source_changed", "source_of_another_job"


def task_hash(task: Column) -> Column:
    """The part of a file's name that stands for its task."""
    return F.substring(F.sha2(task.cast("binary"), 256), 1, 16)


def recorded_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name_hash, rep, sha256, length, doc): recorded files of a folder with the keys that their names hold; doc is
    null where a file isn't an episode."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    doc = F.from_json(F.decode("content", "UTF-8"), T.StructType([*EPISODE.fields, T.StructField("bad_", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_"})
    rows = raw.select("path", F.regexp_extract(name, FILE_NAME, 1).alias("name_hash"), F.regexp_extract(name, FILE_NAME, 2).try_cast("int").alias("rep"), F.sha2("content", 256).alias("sha256"), "length", doc.alias("doc"))
    return rows.withColumn("doc", F.when(F.col("doc.bad_").isNull() & F.col("doc.task").isNotNull(), F.col("doc")))


def inventory(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(task, rep, path, sha256, issue) of every expected job (task, rep, expected: a digest or null): the file
    that its name belongs to, and what is wrong: missing, unreadable, changed since the manifest, of another job."""
    jobs = expected.withColumn("name_hash", task_hash(F.col("task")))
    both = jobs.join(files, ["name_hash", "rep"], "left")
    other = (F.col("doc.task") != F.col("task")) | ~F.col("doc.rep").eqNullSafe(F.col("rep"))
    issue = F.when(F.col("path").isNull(), MISSING).when(F.col("expected").isNotNull() & (F.col("sha256") != F.col("expected")), CHANGED).when(F.col("doc").isNull(), CORRUPT).when(other, OTHER)
    return both.select("task", "rep", "path", "sha256", issue.alias("issue"))


def readable_steps(files: DataFrame, found: DataFrame) -> DataFrame:
    """The recorded steps of the jobs without an issue."""
    good = found.where("issue IS NULL").select("path")
    return files.join(good, "path", "left_semi").select("doc.task", "doc.rep", "doc.won", F.posexplode("doc.steps").alias("t", "s")).select("task", "rep", "won", "t", "s.*")


def file_states(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(path, modified, length) of files; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


class ReadOnce:
    """Documents of files kept in a table, each as of the path, time and size it was read at; only files of which one
    of these changed are read again. The table is written anew beside the old one, so a reader never sees half of it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.current: str | None = None

    def refresh(self, path: str, glob: str = "*.json") -> tuple[DataFrame, int]:
        """(documents, how many files were read): path, modified, length, content of the files that are there now."""
        now = file_states(self.spark, path, glob)
        if self.current is None:
            kept, changed = None, now
        else:
            kept = self.spark.read.parquet(self.current).join(now, ["path", "modified", "length"], "left_semi")
            changed = now.join(self.spark.read.parquet(self.current).select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")
        # names of files, as the driver has them anyway to plan the reading
        names = sorted(r["path"] for r in changed.select("path").collect())
        out = kept
        if names:
            fresh = self.spark.read.format("binaryFile").load(names).select("path", F.col("modificationTime").alias("modified"), "length", F.decode("content", "UTF-8").alias("content"))
            out = fresh if kept is None else kept.unionByName(fresh)
        if out is not None and (names or kept is None or kept.count() < self.spark.read.parquet(self.current).count()):
            target = f"{self.folder}/read-{uuid.uuid4().hex}"
            out.write.parquet(target)
            self.current = target
        if self.current is None:
            return self.spark.createDataFrame([], "path string, modified timestamp, length long, content string"), 0
        return self.spark.read.parquet(self.current), len(names)


class _Part(WriterCommitMessage):
    def __init__(self, name: str, sha256: str, files: int, size: int) -> None:
        self.name, self.sha256, self.files, self.size = name, sha256, files, size


class _DocumentWriter(DataSourceWriter):
    """Every row becomes a file `<name>.json.gz`, the same bytes whenever it is written; every task lists its files in a
    manifest part; the commit lists the parts and sets the marker READY, last."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        system, base = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        return system, base.rstrip("/")

    @staticmethod
    def _put(system: fs.FileSystem, path: str, data: bytes) -> None:
        """Written under another name first, so no reader sees half a file; a second attempt writes the same bytes."""
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with system.open_output_stream(temporary, compression=None) as out:
            out.write(data)
        system.move(temporary, path)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, base = self._open()
        system.create_dir(base, recursive=True)
        listed, size = [], 0
        for row in iterator:
            body = row["body"].encode()
            data = gzip.compress(body, compresslevel=3, mtime=0)
            self._put(system, f"{base}/{row['name']}.json.gz", data)
            listed.append({"path": f"{row['name']}.json.gz", "sha256": hashlib.sha256(data).hexdigest(), "compressed_bytes": len(data), "json_bytes": len(body)})
            size += len(data)
        if not listed:
            return _Part("", "", 0, 0)
        part = f"manifest-{TaskContext.get().partitionId():06d}.json"
        text = "".join(json.dumps(x, sort_keys=True) + "\n" for x in sorted(listed, key=lambda x: x["path"])).encode()
        self._put(system, f"{base}/{part}", text)
        return _Part(part, hashlib.sha256(text).hexdigest(), len(listed), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._open()
        system.create_dir(base, recursive=True)
        parts = [{"part": m.name, "sha256": m.sha256, "files": m.files, "compressed_bytes": m.size} for m in messages if m is not None and m.files]
        self._put(system, f"{base}/MANIFEST.json", json.dumps({"parts": sorted(parts, key=lambda p: p["part"]), "files": sum(p["files"] for p in parts)}, sort_keys=True).encode())
        self._put(system, f"{base}/READY", b"")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """No marker is set; what tasks wrote stays without one and is written over by the next run."""


class Documents(DataSource):
    """A sink for (name, body) rows: `df.write.format("trajecta_documents").option("path", ...)`. It refuses a
    folder that is ready already (S13)."""

    @classmethod
    def name(cls) -> str:
        return "trajecta_documents"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields] != ["name", "body"]:
            raise BadInput("documents are rows of name and body")
        made = _DocumentWriter(self.options["path"])
        system, base = made._open()
        if system.get_file_info(f"{base}/READY").type != fs.FileType.NotFound:
            raise BadInput(f"{base} is ready already")
        return made


def write_documents(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """(name, body) rows as compressed files with a manifest; which task writes which follows from the names alone."""
    rows.sparkSession.dataSource.register(Documents)
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("name", "body").repartition(n, "name").sortWithinPartitions("name")
    dealt.write.format("trajecta_documents").option("path", path).mode("append").save()


#: Digits of a digest that are summed; so many of them fit a long.
DIGITS = 15


def fingerprint(rows: DataFrame, keys: list[str], ranges: int = 64, columns: list[str] | None = None) -> DataFrame:
    """(range, n, digest): an order-free fingerprint of a table by ranges of its keys' digests: how many rows, and the sum
    of their digests. Equal tables have equal fingerprints, in one aggregation without a sort or a join."""
    said = lambda names: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in names))
    number = lambda text: F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("long")
    rest = columns if columns is not None else [c for c in rows.columns if c not in keys]
    placed = rows.select((number(said(keys)) % ranges).alias("range"), number(said([*keys, *rest])).alias("d"))
    return placed.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.col("d").cast("decimal(38,0)")).alias("digest"))


def guard(base: DataFrame, other: DataFrame, keys: list[str], ranges: int = 64, columns: list[str] | None = None) -> DataFrame:
    """(range, n_base, n_other) of the ranges whose rows differ. With columns=[] only the keys are compared."""
    a, b = (fingerprint(x, keys, ranges, columns).withColumnsRenamed({"n": f"n_{s}", "digest": f"digest_{s}"}) for x, s in ((base, "base"), (other, "other")))
    both = a.join(b, "range", "full").fillna(0, ["n_base", "n_other"])
    return both.where(~F.col("digest_base").eqNullSafe(F.col("digest_other")) | (F.col("n_base") != F.col("n_other"))).select("range", "n_base", "n_other")


def require_same(base: DataFrame, other: DataFrame, keys: list[str], ranges: int = 64, columns: list[str] | None = None) -> None:
    """Raises, naming the first range that differs and how many there are."""
    found = guard(base, other, keys, ranges, columns).agg(F.min(F.struct("range", "n_base", "n_other")).alias("f"), F.count("*").alias("n")).first()
    if found["n"]:
        raise BadInput(f"tables differ in {found['n']} of {ranges} ranges, first in {found['f'].asDict()}")


def unfinished(expected: DataFrame, done: DataFrame, keys: list[str], signature: str) -> DataFrame:
    """Expected jobs that no result holds yet. done: keys and the signature of the settings it was made under; a
    result of other settings is an error, since it could neither be kept nor silently be made again."""
    odd = done.where(~F.col("signature").eqNullSafe(F.lit(signature))).limit(1).collect()
    if odd:
        raise BadInput(f"a result of other settings: {odd[0].asDict()}")
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def resolved_tasks(catalog: DataFrame) -> DataFrame:
    """(task_id, gamefile) of a household catalog; ids and files each occur once, and a file lies below the root."""
    from trajecta.sources.store import refuse, unsafe_path

    refuse(catalog.where(F.col("task_id").isNull() | unsafe_path(F.col("gamefile"))), "not a game file")
    for key in ("task_id", "gamefile"):
        refuse(catalog.groupBy(key).count().where("count > 1"), f"{key} twice")
    return catalog.select("task_id", "gamefile")
