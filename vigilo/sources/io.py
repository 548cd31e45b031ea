"""Reading vendor files, write-once artifacts with provenance, and the repair store that writers share."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_any(spark: SparkSession, path: str, schema: T.StructType | str | None = None, rows: int | None = None) -> DataFrame:
    """By extension: parquet (or pq, or a folder), json, xlsx or xls through pandas, else csv with a header.

    ``rows`` takes only so many rows, for a look at a file; a canonical write of such a sample is marked incomplete.
    """
    low = path.lower().rstrip("/")
    if low.endswith((".xlsx", ".xls")):
        import pandas as pd  # the reader for sheets is optional

        out = spark.createDataFrame(pd.read_excel(path, dtype=str))
    else:
        reader = spark.read if schema is None else spark.read.schema(schema)
        kind = "json" if low.endswith((".json", ".jsonl")) else "orc" if low.endswith(".orc") else "csv" if "." in low.rsplit("/", 1)[-1] and not low.endswith((".parquet", ".pq")) else "parquet"
        out = reader.option("header", True).csv(path) if kind == "csv" else getattr(reader, kind)(path)
    return out if rows is None else out.limit(rows)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, body: str) -> None:
    """A small text file, write-once, through the file system of the path."""
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def canonical_json(body: dict) -> str:
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def content_fingerprint(df: DataFrame) -> tuple[int, str]:
    """(rows, hash) independent of row order and partitioning: sums of the rows' hashes, columns by name."""
    row = F.xxhash64(*sorted(df.columns))
    got = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("a"), F.bit_xor(row).alias("b")).first()
    return got["n"], f"{got['a']}:{got['b']}"


def write_canonical(df: DataFrame, path: str, provenance: Callable[[int, str], dict], overwrite: bool = False, complete: bool = True) -> dict:
    """Parquet and its provenance sidecar, together or not at all.

    Both are staged beside the target and renamed; what stood there before is kept aside until the new pair is in
    place and comes back if that fails.
    """
    spark = df.sparkSession
    fs, target, Path = _fs(spark, path)
    side = Path(path.rstrip("/") + ".provenance.json")
    if not overwrite and (fs.exists(target) or fs.exists(side)):
        raise FileExistsError(path)
    tag = uuid.uuid4().hex[:8]
    part, part_side = Path(f"{path}.{tag}.partial"), Path(f"{path}.{tag}.partial.json")
    df.write.parquet(part.toString())
    n, digest = content_fingerprint(spark.read.parquet(part.toString()))
    body = {**provenance(n, digest), "rows": n, "content": digest, "complete_input": complete}
    write_text(spark, part_side.toString(), canonical_json(body))
    backups = []
    try:
        for old in (target, side):
            if fs.exists(old):
                kept = Path(f"{old.toString()}.{tag}.backup")
                fs.rename(old, kept)
                backups.append((kept, old))
        if not (fs.rename(part, target) and fs.rename(part_side, side)):
            raise OSError(f"could not move into {path}")
    except Exception:
        for kept, old in backups:
            fs.delete(old, True)
            fs.rename(kept, old)
        raise
    for kept, _ in backups:
        fs.delete(kept, True)
    return body


def sidecar_problems(spark: SparkSession, path: str) -> list[str]:
    """What no longer matches between a canonical table and its sidecar."""
    side = path.rstrip("/") + ".provenance.json"
    if not exists(spark, side):
        return ["no provenance"]
    body = json.loads(read_text(spark, side))
    n, digest = content_fingerprint(spark.read.parquet(path))
    return [t for bad, t in ((body["rows"] != n, "row count changed"), (body["content"] != digest, "content changed"), (not body["complete_input"], "made from a sample")) if bad]


def put_if_absent(spark: SparkSession, path: str, body: str) -> bool:
    """Whether ``path`` was made, whole, with ``body``; false where it stood already.  Of two writers one succeeds.

    The text is written beside the path and moved to it: by a link on a local disk, by a rename that does not overwrite
    elsewhere; both are one step of the file system.
    """
    aside = f"{path}.{uuid.uuid4().hex}"
    write_text(spark, aside, body)
    fs, p, make = _fs(spark, path)
    if fs.getScheme() == "file":
        try:
            os.link(make(aside).toUri().getPath(), p.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(make(aside), False)
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(make(aside), p, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as refused:
        if not fs.exists(p):
            raise
        fs.delete(make(aside), False)
        if "Exist" not in refused.java_exception.getClass().getName():
            raise
        return False


class RepairStore:
    """Append-only records, assessments and follow-ups that several writers share; keys are never written twice.

    Rows lie in Parquet parts; a numbered manifest lists the parts of each table, and the highest number is the state.
    A writer checks its keys against the state it read and puts the next number, which only one can: who comes second
    reads the new state and checks again.  Readers hold on to one manifest, so they see whole commits only.
    """

    TABLES = {
        "records": ("job_id string, asset_id string, started_at timestamp_ntz, completed_at timestamp_ntz, recorded_at timestamp_ntz, operator string, finding string, work_performed string", ["job_id"]),
        "assessments": ("job_id string, asset_id string, as_of timestamp_ntz, status string, body string", ["job_id", "as_of"]),
        "followups": ("job_id string, asset_id string, opened_at timestamp_ntz, state string", ["job_id"]),
    }

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False):
        self.spark, self.root, self.readonly = spark, root.rstrip("/"), readonly
        if readonly and (problems := self.problems()):
            raise ValueError("; ".join(problems))

    def head(self) -> int:
        """The number of the newest manifest; 0 for an empty store."""
        fs, p, _ = _fs(self.spark, f"{self.root}/_commits")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _parts(self, version: int) -> dict[str, list[str]]:
        return json.loads(read_text(self.spark, f"{self.root}/_commits/{version:012d}.json"))["parts"] if version else {}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a manifest, the newest by default."""
        schema, _ = self.TABLES[name]
        parts = self._parts(self.head() if version is None else version).get(name, [])
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{x}" for x in parts)) if parts else self.spark.createDataFrame([], schema)

    def problems(self) -> list[str]:
        """Why the store cannot be read as declared: unknown tables, and parts whose columns or types differ."""
        found = []
        for name, parts in self._parts(self.head()).items():
            if name not in self.TABLES:
                found.append(f"unknown table {name}")
                continue
            want = [(f.name, f.dataType) for f in T._parse_datatype_string(self.TABLES[name][0])]
            for x in parts:
                if [(f.name, f.dataType) for f in self.spark.read.parquet(f"{self.root}/{x}").schema] != want:
                    found.append(f"{x} is not a part of {name}")
        return found

    def collisions(self, other: RepairStore, name: str = "records") -> DataFrame:
        """Keys of a table that both stores hold."""
        keys = self.TABLES[name][1]
        return self.read(name).select(*keys).join(other.read(name).select(*keys), keys, "left_semi").distinct()

    def _commit(self, tables: dict[str, tuple[DataFrame, bool]]) -> dict[str, int]:
        """Rows of several tables, all or none; (rows, ignore): known keys are refused, or skipped with ``ignore``."""
        if self.readonly:
            raise PermissionError("the store was opened to be read")
        while True:
            base = self.head()
            parts, added, written = self._parts(base), {}, []
            try:
                for name, (rows, ignore) in tables.items():
                    schema, keys = self.TABLES[name]
                    fresh = rows.dropDuplicates(keys).join(self.read(name, base).select(*keys), keys, "left_anti").select(*T._parse_datatype_string(schema).fieldNames())
                    added[name], given = fresh.count(), rows.count()
                    if added[name] < given and not ignore:
                        raise ValueError(f"{given - added[name]} rows of {name} repeat a key")
                    if added[name]:
                        part = f"{name}/{uuid.uuid4().hex}"
                        written.append(part)
                        fresh.write.parquet(f"{self.root}/{part}")
                        parts[name] = [*parts.get(name, []), part]
                if not written or put_if_absent(self.spark, f"{self.root}/_commits/{base + 1:012d}.json", canonical_json({"parts": parts})):
                    written = []
                    return added
            finally:
                for part in written:  # of an attempt that did not come to be
                    fs, p, _ = _fs(self.spark, f"{self.root}/{part}")
                    fs.delete(p, True)

    def append(self, name: str, rows: DataFrame, ignore: bool = False) -> int:
        """Rows whose key is new; a known key is refused, or skipped with ``ignore``."""
        return self._commit({name: (rows, ignore)})[name]

    def record(self, rows: DataFrame) -> int:
        bad = (F.col("started_at") > F.col("completed_at")) | (F.col("completed_at") > F.col("recorded_at"))
        blank = F.lit(False)
        for c in ("job_id", "asset_id", "operator", "finding", "work_performed"):
            blank = blank | (F.length(F.trim(F.coalesce(c, F.lit("")))) == 0)
        if not rows.where(bad | blank).isEmpty():
            raise ValueError("records need text fields and start <= completion <= recording")
        return self.append("records", rows)

    def assess(self, assessments: DataFrame) -> int:
        """Stores assessments of known jobs and opens a follow-up, once per job, where an abnormality persists."""
        if not assessments.join(self.read("records"), ["job_id", "asset_id"], "left_anti").isEmpty():
            raise ValueError("assessment of an unknown job")
        bad = assessments.where("status = 'abnormality_persists'").select("job_id", "asset_id", F.col("as_of").alias("opened_at"), F.lit("open").alias("state"))
        return self._commit({"assessments": (assessments, False), "followups": (bad, True)})["assessments"]

    def history(self, asset_id: str) -> DataFrame:
        return self.read("records").where(F.col("asset_id") == asset_id).join(self.read("assessments"), ["job_id", "asset_id"], "left").orderBy("completed_at", "as_of")

    def open_followups(self, visible_by: Column) -> DataFrame:
        return self.read("followups").where(F.col("state") == "open").join(self.read("assessments").where(F.col("as_of") <= visible_by), ["job_id", "asset_id"], "left_semi")
