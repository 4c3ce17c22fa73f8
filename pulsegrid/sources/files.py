"""Readers and writers: strict CSV, case folders, JSON, partitioned facts, manifests, inventories, and pickles that are never executed."""

from __future__ import annotations

import pickletools
import re
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASE_SCHEMA = "timestamp BIGINT, level STRING, cmdb_id STRING, failure_type STRING"


def read_strict_csv(spark: SparkSession, path: str, schema: str = CASE_SCHEMA) -> DataFrame:
    """A CSV whose header has exactly the schema's names in order; a malformed row or an empty table is an error."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def read_case_folders(spark: SparkSession, root: str, file: str = "simple_data.csv", side: str = "inject_time.txt") -> DataFrame:
    """The long form (service, fault, run, time, inject_time, metric, value) of CSVs in <service>_<fault>/<run> folders whose columns differ.

    Files are read as text and each row is split by its own file's header, so one scan serves all schemas. Empty cells are NaN.
    """
    parts = [F.regexp_extract("f", r"/([^/]+)_([^_/]+)/([^/]+)/[^/]+$", k).alias(n) for k, n in ((1, "service"), (2, "fault"), (3, "run"))]
    text = spark.read.option("recursiveFileLookup", True)
    rows = text.option("pathGlobFilter", file).text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("f")).select("value", *parts)
    times = text.option("pathGlobFilter", side).text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("f")).select(F.regexp_replace("value", r"\s", "").cast("long").alias("inject_time"), *parts)
    keys = ["service", "fault", "run"]
    lines = rows.select(*keys, F.split(F.regexp_replace("value", r"\s+$|\r", ""), "\n").alias("l"))
    cells = lines.select(*keys, F.split(F.col("l")[0], ",").alias("h"), F.explode(F.slice("l", 2, F.greatest(F.lit(0), F.size("l") - 1))).alias("line"))
    cells = cells.select(*keys, F.arrays_zip("h", F.split("line", ",").alias("v")).alias("z"))
    long = cells.select(*keys, F.element_at(F.filter("z", lambda x: x["h"] == "time"), 1)["v"].cast("long").alias("time"), F.explode(F.filter("z", lambda x: x["h"] != "time")).alias("c"))
    value = F.when(F.trim("c.v") == "", F.lit(float("nan"))).otherwise(F.col("c.v").cast("double"))
    return long.select(*keys, "time", F.col("c.h").alias("metric"), value.alias("value")).join(times, keys, "left")


def read_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV with a header as rows of text columns; empty cells are null."""
    return spark.read.option("header", True).csv(path)


def write_case_folders(cases: DataFrame, root: str, file: str = "simple_data.csv", side: str = "inject_time.txt") -> None:
    """Writes each row (service, fault, run, csv, inject) as the files of a <service>_<fault>/<run> folder; executors write, a repeated task the same bytes."""

    def run(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        for pdf in batches:
            for r in pdf.itertuples():
                store, base = fs.FileSystem.from_uri(root)
                folder = f"{base}/{r.service}_{r.fault}/{r.run}"
                store.create_dir(folder, recursive=True)
                for name, text in ((file, r.csv), (side, r.inject)):
                    part = f"{folder}/_{uuid.uuid4().hex}"
                    with store.open_output_stream(part) as out:
                        out.write(text.encode("utf-8"))
                    store.move(part, f"{folder}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    cases.select("service", "fault", "run", "csv", "inject").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines; numbers that aren't finite become null."""
    cols = [F.when(~(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, columns: Iterable[str]) -> None:
    """CSV files with a header and these columns in this order."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def build_cache(parts: Iterable[DataFrame], key: str, path: str) -> DataFrame:
    """Parts put together by name, sorted by key and stored; a key that occurs twice is an error."""
    frames = list(parts)
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"repeated {key}")
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_fact(df: DataFrame, path: str, date: str = "utc_date", order: tuple[str, ...] = ("timestamp",), mode: str = "overwrite", files_per_day: int = 1, inside: bool = False) -> None:
    """A fact table in a folder per date. ``files_per_day`` spreads a day over several tasks; ``mode`` is overwrite, errorifexists or append.

    With ``inside`` the files have the date's column too, and the folders are named <date>_day, so a file is whole by itself.
    """
    slot, by = F.pmod(F.xxhash64(*order), F.lit(files_per_day)), f"{date}_day" if inside else date
    df = df.withColumn(by, F.col(date)) if inside else df
    df.repartition(F.col(date), slot).sortWithinPartitions(date, *order).write.mode(mode).option("compression", "zstd").partitionBy(by).parquet(path)


def first_days(df: DataFrame, n: int, date: str = "utc_date") -> DataFrame:
    """Only the first ``n`` dates; the dates are literals, so partitions are pruned."""
    days = [r[0] for r in df.select(date).distinct().orderBy(date).limit(n).collect()]
    return df.where(F.col(date).isin(days))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file below a folder but hidden ones. Spark reads no empty files, so these come from its list of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = spark.createDataFrame([(re.sub(r"^([^:/]+):///", r"\1:/", unquote(f)),) for f in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(b""), 256).alias("sha256"))
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).union(empty)


def write_dimension(df: DataFrame, path: str, name: str) -> DataFrame:
    """Writes a small table as one file; its line of the manifest (name, n_rows, bytes, sha256). Rows are counted in what was written."""
    spark, at = df.sparkSession, f"{path}/{name}"
    df.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(at)
    n = spark.read.parquet(at).agg(F.count("*").alias("n_rows"))
    return inventory(spark, at).where("path like '%.parquet'").crossJoin(n).select(F.lit(name).alias("name"), "n_rows", "bytes", "sha256")


def verify_inventory(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status): ok, missing, unexpected or changed."""
    j = found.alias("f").join(expected.alias("e"), F.col("f.path") == F.col("e.path"), "full_outer")
    same = (F.col("f.bytes") == F.col("e.bytes")) & (F.col("f.sha256") == F.col("e.sha256"))
    status = F.when(F.col("f.path").isNull(), "missing").when(F.col("e.path").isNull(), "unexpected").when(same, "ok").otherwise("changed")
    return j.select(F.coalesce("f.path", "e.path").alias("path"), status.alias("status"))


def expand_spans(df: DataFrame, column: str) -> DataFrame:
    """The indices of every ``a-b`` span (both ends included) in a text column, sorted and once each."""
    spans = df.select(F.explode(F.regexp_extract_all(column, F.lit(r"(\d+)\s*-\s*(\d+)"), F.lit(0))).alias("s"))
    lo, hi = F.regexp_extract("s", r"^(\d+)", 1).cast("int"), F.regexp_extract("s", r"(\d+)$", 1).cast("int")
    return spans.select(F.explode(F.sequence(lo, hi)).alias("i")).distinct().orderBy("i")


def pickle_summary(data: bytes) -> tuple[int, list[str], list[int], str | None]:
    """(number of opcodes, sorted global names, integers, error) of a pickle, from its opcodes alone; nothing is loaded or executed."""
    names: set[str] = set()
    strings: list[str] = []
    numbers: list[int] = []
    count = 0
    try:
        for op, arg, _ in pickletools.genops(data):
            count += 1
            if op.name in ("GLOBAL", "INST"):
                names.add(str(arg).replace(" ", "."))
            elif op.name == "STACK_GLOBAL":
                names.add(".".join(strings[-2:]) if len(strings) > 1 else "?")
            elif isinstance(arg, str):
                strings.append(arg)
            elif isinstance(arg, int) and op.name not in ("PROTO", "FRAME") and "PUT" not in op.name and "GET" not in op.name:
                numbers.append(arg)
    except Exception as e:  # a damaged or foreign file is a row with an error, not a failed job
        return count, sorted(names), numbers, f"{type(e).__name__}: {e}"
    return count, sorted(names), numbers, None


def read_pickles(spark: SparkSession, path: str) -> DataFrame:
    """(path, opcodes, globals, numbers, error) of pickle files, read symbolically."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [pickle_summary(bytes(c)) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "opcodes": [r[0] for r in rows], "globals": [r[1] for r in rows], "numbers": [r[2] for r in rows], "error": [r[3] for r in rows]})

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("opcodes", T.LongType()), T.StructField("globals", T.ArrayType(T.StringType())), T.StructField("numbers", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())])
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, schema)
