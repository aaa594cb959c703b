"""JSON lines in and out: strict, tolerant, validated and resumable reads; writers by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every line must fit the schema; blank lines are skipped; a bad line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_tolerant(spark: SparkSession, path: str, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): lines that don't parse, or lack a required value, are set aside with their text."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    ok: Column = F.col(f"r.{CORRUPT}").isNull() & F.col("r").isNotNull()
    for c in required:
        ok = ok & (F.coalesce(F.trim(F.col(f"r.{c}").cast("string")), F.lit("")) != "")
    return parsed.where(ok).select(*[F.col(f"r.{f.name}") for f in schema.fields]), parsed.where(~ok).select("value")


def read_levels(spark: SparkSession, paths: list[str], schema: T.StructType, exclude: str | None = None) -> DataFrame:
    """Several files with the level taken from the parent folder's name (the value, for folders named key=value); files whose
    path matches `exclude` are left out."""
    path = F.col("_metadata.file_path")
    df = spark.read.schema(schema).json(paths).select("*", F.regexp_extract(path, r"(?:[^/=]*=)?([^/]+)/[^/]+$", 1).alias("level"), path.alias("_file"))
    return (df.where(~F.regexp("_file", F.lit(exclude))) if exclude else df).drop("_file")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): the lines of a folder of text files with what orders them: file name, where the task began in it, place in the task."""
    return spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines in file order; blank ones don't count. Each task gives at most n."""
    return numbered_lines(spark, path).where(F.trim("value") != "").orderBy("file", "block", "at").limit(n).select("value")


def line_kinds(spark: SparkSession, path: str) -> DataFrame:
    """(kind, n): how many lines hold an object, another JSON value ('other'), or no JSON ('torn'); blank lines aren't counted."""
    value = F.trim("value")
    is_object = F.from_json(value, "map<string,string>").isNotNull() & F.startswith(value, F.lit("{"))
    is_other = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "struct<v string>")["v"].isNotNull() & ~F.startswith(value, F.lit("{"))
    lines = spark.read.text(path).where(value != "")
    return lines.groupBy(F.when(is_object, "object").when(is_other, "other").otherwise("torn").alias("kind")).agg(F.count("*").alias("n"))


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(valid, bytes): lines before the first that holds no JSON object, and the bytes they take with their line ends.

    What a log that broke off is cut back to. Two passes: the place of the first bad line is one row."""
    lines = numbered_lines(spark, path)
    good = F.coalesce(F.from_json("value", "map<string,string>").isNotNull(), F.lit(False))
    place = F.struct("file", "block", "at")
    bad = lines.where(~good).agg(F.min(place).alias("bad"))
    kept = lines.join(F.broadcast(bad), F.lit(True)).where(F.col("bad").isNull() | (place < F.col("bad")))  # one row
    return kept.agg(F.count("*").alias("valid"), F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0)).alias("bytes"))


def snapshot(cases: DataFrame, outputs: DataFrame, key: str, order: str) -> DataFrame:
    """The outputs in the order of their cases; outputs without a case are left out."""
    return outputs.join(cases.select(key, order), key).orderBy(order)


def report(df: DataFrame, title: str, columns: list[str], order: str) -> DataFrame:
    """(line_no, line): a small table as Markdown: title, head, and a line for each row. The rows must be few (an aggregate)."""
    own = df.select(*[F.col(c).cast("string").alias(c) for c in columns], F.row_number().over(Window.orderBy(order)).alias("_n"))
    rows = own.select((F.col("_n") + 3).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in columns]), F.lit(" |")).alias("line"))
    head = [f"# {title}", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    fixed = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(head, 1)], "line_no int, line string")
    return fixed.unionByName(rows)


def completed(outputs: DataFrame, key: str, order: str) -> DataFrame:
    """The last output of each key of an append-only log."""
    rest = [c for c in outputs.columns if c not in (key,)]
    return outputs.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in rest])


def still_open(cases: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """The cases without an output yet: what a resumed run has to do."""
    return cases.join(outputs.select(key), key, "left_anti")


def write_json(df: DataFrame, path: str, gzip: bool = False, mode: str = "error") -> None:
    """One JSON object a line; tasks commit their files, so a torn write leaves none behind."""
    df.write.mode(mode).option("compression", "gzip" if gzip else "none").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def mismatches(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Files that a manifest names and the folder lacks or holds otherwise."""
    f = found.toDF("path", "found_bytes", "found_sha256")
    return expected.join(f, "path", "left").where(F.col("found_sha256").isNull() | (F.col("found_sha256") != F.col("sha256")) | (F.col("found_bytes") != F.col("bytes")))
