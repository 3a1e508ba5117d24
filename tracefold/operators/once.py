"""Tables to which every id is appended once, whatever its date, and whatever batch is replayed.

A table is a folder of three parts:

* ``rows/write=W``: the rows of one write, by partition column;
* ``ids/write=W/bucket=B``: their ids, by hash bucket. An append reads the buckets of its own ids and nothing else, so it
  finds an id under any date without reading any rows;
* ``log/N.json``: the writes that count, in order. A write exists for readers once its log entry does.

An append reads the log, plans against the ids of committed writes, writes its rows and ids, and claims the next log number
by creating that file, which fails if another writer was faster; it then plans again, against the ids that were added. A
batch whose id is in the log has been appended and is not looked at again. A writer that dies leaves a write without an
entry: nobody sees it, and ``compact_once`` removes it.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.sinks import append_counts, append_plan, valid_capture
from tracefold.session import cut_lineage, drop_stage

BUCKETS = 256
_ENTRY = "version long, batch string, write string, base boolean, partition array<string>, schema string"


class _Files:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def create(self, name: str, text: str) -> bool:
        """Create a file that must not exist; False where it does."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.fs.create(self._path(name), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _log(spark: SparkSession, files: _Files, patience: float = 20.0) -> tuple[list, int]:
    """Entries since the last base, in order, and the last number claimed. An entry is written at once when its number is claimed; one that stays
    empty was left by a writer that died, and counts as no write."""
    until = time.time() + patience
    if (there := files.names("")) and "log" not in there and not set(there) <= {"rows", "ids"}:
        raise ValueError(f"{files.root} holds something else than Parquet rows with a log")
    while True:
        names = [n for n in files.names("log") if n.endswith(".json") and not n.startswith((".", "_"))]
        found = spark.read.schema(_ENTRY).json([f"{files.root}/log/{n}" for n in names]).where("write IS NOT NULL").collect() if names else []
        if len(found) == len(names) or time.time() > until:
            break
        time.sleep(0.1)
    found.sort(key=lambda r: r.version)
    last = max([i for i, r in enumerate(found) if r.base], default=0)
    return found[last:], max([int(n.split(".")[0]) for n in names], default=-1)


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int").alias("bucket")


def _committed(spark: SparkSession, files: _Files, entries: list, part: str, schema: T.StructType) -> DataFrame:
    paths = [f"{files.root}/{part}/write={r.write}" for r in entries]
    return spark.read.schema(schema).option("recursiveFileLookup", "false").option("basePath", f"{files.root}/{part}").parquet(*paths)


def _ids(spark: SparkSession, files: _Files, entries: list, key: str, kind: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField(key, kind), T.StructField("bucket", T.IntegerType()), T.StructField("write", T.StringType())])
    return _committed(spark, files, entries, "ids", schema)


def _known(batch: DataFrame, ids: DataFrame) -> DataFrame:
    """Committed ids in the buckets of a batch; their numbers, at most ``BUCKETS``, prune the index before it is read."""
    asked = [r.bucket for r in batch.select(_bucket("_key")).distinct().collect() if r.bucket is not None]
    return ids.where(F.col("bucket").isin(asked)).select("_key")


def read_once(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of all committed writes; None where there are none."""
    files = _Files(spark, path)
    entries, _ = _log(spark, files)
    if not entries:
        return None
    schema = T.StructType.fromJson(json.loads(entries[-1].schema))
    return _committed(spark, files, entries, "rows", T.StructType([*schema.fields, T.StructField("write", T.StringType())])).drop("write")


def append_once(
    batch: DataFrame, path: str, *, key: str, seq: str | None = None, partition: tuple[str, ...] = (), batch_id: str | None = None, valid: Column | None = None,
) -> DataFrame:
    """Append the rows of ``batch`` whose id the table does not hold; each row with its verdict, as ``append_plan`` gives it.

    A batch whose ``batch_id`` was committed before adds nothing: its valid rows are duplicates. Rows without an id are
    rejected. Of rows that share an id the one with the smallest ``seq`` stays, or any one where ``seq`` is not named.
    """
    spark, files = batch.sparkSession, _Files(batch.sparkSession, path)
    place = F.monotonically_increasing_id()  # tells rows with equal ``seq`` apart
    rows = batch.withColumn("_seq", F.struct(F.col(seq).alias("seq"), place.alias("place")) if seq else place)
    given = cut_lineage(rows.withColumn("_key", F.col(key)), "append-batch")  # read by each attempt, and the same for all
    try:
        while True:
            entries, last = _log(spark, files)
            known = given.select("_key").where(F.lit(False))
            if entries:
                known = _known(given, _ids(spark, files, entries, "_key", batch.schema[key].dataType))
            plan = append_plan(given, known, "_key", "_seq", (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))) & F.col("_key").isNotNull())
            if batch_id is not None and any(r.batch == batch_id for r in entries):
                plan = plan.withColumn("verdict", F.when(F.col("verdict") == "accepted", "duplicate").otherwise(F.col("verdict")))
                return cut_lineage(plan.drop("_seq", "_key"), "append-verdicts")
            plan = cut_lineage(plan, "append-plan")
            write = uuid.uuid4().hex
            fresh = plan.where("verdict = 'accepted'")
            fresh.select(*batch.columns).write.partitionBy(*partition).parquet(f"{files.root}/rows/write={write}")
            fresh.select("_key", _bucket("_key")).repartition("bucket").write.partitionBy("bucket").parquet(f"{files.root}/ids/write={write}")
            if _claim(files, last + 1, batch_id, write, False, partition, batch.schema):
                return plan.drop("_seq", "_key")
            drop_stage(plan)
            files.delete(f"rows/write={write}")
            files.delete(f"ids/write={write}")
    finally:
        # The verdicts are stages of their own.
        drop_stage(given)


def _claim(files: _Files, version: int, batch_id: str | None, write: str, base: bool, partition, schema: T.StructType) -> bool:
    entry = {"version": version, "batch": batch_id, "write": write, "base": base, "partition": list(partition), "schema": schema.json()}
    return files.create(f"log/{version:012d}.json", json.dumps(entry))


def compact_once(spark: SparkSession, path: str, *, key: str) -> bool:
    """Rewrite all committed writes as one, which becomes the base of the log; then remove what is no longer read.

    False where another writer committed meanwhile: the table is as it was, and nothing is removed. Batch ids before the
    base are forgotten; the ids of their rows are not, so a replay still adds nothing. Nobody may be reading the table.
    """
    files = _Files(spark, path)
    entries, last = _log(spark, files)
    if not entries:
        return True
    rows, schema = read_once(spark, path), T.StructType.fromJson(json.loads(entries[-1].schema))
    partition, write = entries[-1].partition or [], uuid.uuid4().hex
    rows.write.partitionBy(*partition).parquet(f"{files.root}/rows/write={write}")
    ids = _ids(spark, files, entries, "_key", schema[key].dataType)
    ids.select("_key", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{files.root}/ids/write={write}")
    done = _claim(files, last + 1, None, write, True, partition, schema)
    for number in range(last + 1) if done else ():
        files.delete(f"log/{number:012d}.json")
    for part in ("rows", "ids"):
        keep = {f"write={write}"} if done else {f"write={r.write}" for r in entries}
        for name in files.names(part):
            if name.startswith("write=") and (name not in keep if done else name == f"write={write}"):
                files.delete(f"{part}/{name}")
    return done


def append_new(batch: DataFrame, path: str, key: str = "event_id", seq: str = "ingest_seq", batch_id: str | None = None) -> DataFrame:
    """Append a batch of captures, by date; returns the counts of its verdicts."""
    return append_counts(append_once(batch, path, key=key, seq=seq, partition=("date",), batch_id=batch_id, valid=valid_capture()))
