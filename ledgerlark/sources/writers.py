"""Readers and writers: validated sources, guarded sinks, versioned indexes and snapshots on any Hadoop file system."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.functions.text import normal_lines

#: Columns whose names hold one of these are never written to an event log.
FORBIDDEN = ("text", "prompt", "chunk", "content", "tenant_id", "output", "secret", "password", "token")
#: Suffixes that may be ingested, suffixes that are refused outright, and the largest size.
ALLOWED_SUFFIXES = (".txt", ".md", ".json", ".csv", ".pdf", ".docx")
FORBIDDEN_SUFFIXES = (".exe", ".bat", ".cmd", ".ps1", ".sh", ".js", ".vbs", ".zip", ".rar", ".7z")
MOST_BYTES = 2_000_000
#: Suffixes of Windows programs, which have an executable type.
EXECUTABLE_SUFFIXES = (".exe", ".dll", ".com", ".bat", ".msi")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a stated schema; a malformed line or a missing file is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A file that holds a JSON array of objects, with or without a byte-order mark; a missing file gives no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def violations(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """(key, problem) rows of a load: required fields that are null or blank, and keys seen more than once."""
    blank = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(f"missing {c}")) for c in required)))
    missing = df.select(F.col(key).cast("string").alias("key"), F.explode(blank).alias("problem"))
    doubled = df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate key").alias("problem"))
    return missing.unionByName(doubled)


def load_validated(df: DataFrame, required: list[str], key: str) -> DataFrame:
    """The rows, if they have no violation; else an error that names the first ones."""
    found = violations(df, required, key).limit(5).collect()
    if found:
        raise ValueError(f"{key}: {[tuple(r) for r in found]}")
    return df


def ingest_errors(path: Column, size: Column) -> Column:
    """Error codes of a file by path and size, in order."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[^/.]*)$", 1))
    return F.array_compact(F.array(
        F.when(F.array_contains(F.split(path, "/"), ".."), "PATH_TRAVERSAL_BLOCKED"), F.when(suffix.isin(*FORBIDDEN_SUFFIXES), "FORBIDDEN_FILE_TYPE"),
        F.when(~suffix.isin(*ALLOWED_SUFFIXES), "UNSUPPORTED_FILE_TYPE"), F.when(size > MOST_BYTES, "FILE_TOO_LARGE"), F.when(suffix.isin(*EXECUTABLE_SUFFIXES), "EXECUTABLE_MIME_BLOCKED"),
    ))


def ingest_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, errors and, where there are none, the normalised text of the files under a folder. Sizes and names are
    judged first; contents come from the same scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    judged = files.select("path", F.col("length").alias("size"), ingest_errors(F.col("path"), F.col("length")).alias("errors"), "content")
    return judged.select("path", "size", "errors", F.when(F.size("errors") == 0, normal_lines(F.decode("content", "UTF-8"))).alias("text"))


def append_events(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines; a frame with a forbidden column is refused before anything is written."""
    bad = [c for c in df.columns if any(f in c.lower() for f in FORBIDDEN)]
    if bad:
        raise ValueError(f"columns not allowed in an event log: {bad}")
    df.write.mode("append").json(path)


def with_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """The frame with every column of schema, missing ones null, in its order: schema evolution without rewriting."""
    there = set(df.columns)
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


class VersionedIndex:
    """Parquet versions under a root with a pointer to the active one: staged, verified, published, rolled back. The
    pointer is a one-row table of its own, so any file system that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def exists(self, version: str) -> bool:
        return self._fs.exists(self._path(f"v-{version}/_SUCCESS"))

    def stage(self, df: DataFrame, version: str) -> None:
        """Writes a version and its manifest; an existing one is an error."""
        if self.exists(version):
            raise ValueError(f"version {version} exists")
        df.write.mode("overwrite").parquet(f"{self.root}/v-{version}")
        count, check = self._fingerprint(version)
        self.spark.createDataFrame([(version, count, check)], "version string, rows long, fingerprint long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/m-{version}")

    def _fingerprint(self, version: str) -> tuple[int, int]:
        df = self.spark.read.parquet(f"{self.root}/v-{version}")
        row = df.agg(F.count("*"), F.coalesce(F.sum(F.hash(*df.columns).cast("bigint")), F.lit(0))).first()
        return int(row[0]), int(row[1])

    def publish(self, version: str) -> None:
        """Makes a version active once it agrees with its manifest."""
        if not self.exists(version):
            raise ValueError(f"version {version} not found")
        told = self.spark.read.parquet(f"{self.root}/m-{version}").first()
        if (told["rows"], told["fingerprint"]) != self._fingerprint(version):
            raise ValueError(f"version {version} doesn't match its manifest")
        active = [*self.history(), version]
        self.spark.createDataFrame([(i, v) for i, v in enumerate(active)], "nth int, version string").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/active-{len(active)}")

    def history(self) -> list[str]:
        """Published versions, the active one last."""
        if not self._fs.exists(self._path("")):
            return []
        marks = sorted(int(s.getPath().getName().removeprefix("active-")) for s in self._fs.listStatus(self._path("")) if s.getPath().getName().startswith("active-") and self._fs.exists(self._path(f"{s.getPath().getName()}/_SUCCESS")))
        return [r["version"] for r in self.spark.read.parquet(f"{self.root}/active-{marks[-1]}").orderBy("nth").collect()] if marks else []

    def load(self) -> DataFrame:
        past = self.history()
        if not past:
            raise ValueError("no active version")
        return self.spark.read.parquet(f"{self.root}/v-{past[-1]}")

    def rollback(self) -> str:
        """Makes the version before the active one active again."""
        past = self.history()
        if len(past) < 2:
            raise ValueError("no version to go back to")
        self.publish(past[-2])
        return past[-2]


def write_dense_index(vectors: DataFrame, path: str, about: dict[str, str]) -> None:
    """(id, vector) as Parquet of unit vectors and a JSON line about them. Zero, broken or uneven vectors are refused before
    anything is written."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x))
    seen = vectors.agg(F.count("*").alias("rows"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("dim"), F.count(F.when(F.coalesce((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.lit(False)), 1)).alias("good")).first()
    if seen["good"] < seen["rows"] or seen["least"] != seen["dim"]:
        raise ValueError(f"{seen['rows'] - seen['good']} zero or broken vectors; sizes {seen['least']} to {seen['dim']}")
    vectors.select("id", F.transform("vector", lambda x: x / norm).alias("vector")).write.parquet(f"{path}/vectors")
    told = about | {"rows": str(seen["rows"]), "dim": str(seen["dim"])}
    vectors.sparkSession.createDataFrame([(json.dumps(told, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/about")


def load_dense_index(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The vectors and what is known about them; another number of rows than was written is an error."""
    told = json.loads(spark.read.text(f"{path}/about").first()["value"])
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.count() != int(told["rows"]):
        raise ValueError(f"{path} doesn't hold the {told['rows']} vectors that were written")
    return vectors, told | {"rows": int(told["rows"]), "dim": int(told["dim"])}


def snapshot(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes tables as Parquet and tells their row counts."""
    out = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    return out


def restore(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a snapshot by name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = sorted(x.getPath().getName() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if x.isDirectory())
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def dual_export(df: DataFrame, path: str) -> None:
    """The rows as CSV with a header and as JSON lines, side by side."""
    df.write.option("header", True).csv(f"{path}/csv")
    df.write.json(f"{path}/json")


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def summary_json(df: DataFrame) -> str:
    """A one-row frame of figures as JSON, for a metrics endpoint."""
    return json.dumps(df.limit(1).collect()[0].asDict(), default=str, sort_keys=True)
