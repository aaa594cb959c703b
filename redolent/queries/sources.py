"""Sources and sinks: JSON lines, CSV and reports written from the tables into the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from redolent.operators.relational import numbered
from redolent.queries.common import CASES, PLAIN, cases, plain_items, query
from redolent.session import scratch, table
from redolent.sources import jsonl

ITEM = T.StructType([T.StructField("perfume_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("brand", T.StringType())])


def _place(spark, name: str) -> str:
    return scratch(spark, f"{name}-{uuid.uuid4().hex}")


def _log(spark, d, torn):
    """A log of item records, one JSON object a line in the order of the ids, in which the lines that `torn` names broke off."""
    own = table(spark, d, "perfumes").where("perfume_id IS NOT NULL").orderBy("perfume_id", "ingested_at")
    line = F.to_json(F.struct("perfume_id", "name", "brand"))
    path = _place(spark, "log")
    own.select(F.when(torn, F.substring(line, 1, 12)).otherwise(line).alias("value")).write.text(path)
    return path


@query("s01_strict_scan", "SELECT perfume_id, name, brand FROM perfumes WHERE perfume_id IS NOT NULL")
def strict_scan(spark, d):
    return jsonl.read_strict(spark, _log(spark, d, F.lit(False)), ITEM)


@query("s02_tolerant_scan", "SELECT perfume_id, name, brand FROM perfumes WHERE perfume_id % 7 <> 0 AND trim(coalesce(name, '')) <> '' AND trim(coalesce(brand, '')) <> ''")
def tolerant_scan(spark, d):
    """Torn lines and records without name or brand are set aside."""
    return jsonl.read_tolerant(spark, _log(spark, d, F.col("perfume_id") % 7 == 0), ITEM, ("name", "brand"))[0]


@query("s02_set_aside", "SELECT count(*) AS bad FROM perfumes WHERE perfume_id % 7 = 0 OR trim(coalesce(name, '')) = '' OR trim(coalesce(brand, '')) = ''")
def set_aside(spark, d):
    return jsonl.read_tolerant(spark, _log(spark, d, F.col("perfume_id") % 7 == 0), ITEM, ("name", "brand"))[1].agg(F.count("*").alias("bad"))


@query("s03_limited_scan", "SELECT perfume_id, name FROM perfumes WHERE perfume_id IS NOT NULL ORDER BY perfume_id, ingested_at LIMIT 100")
def limited_scan(spark, d):
    """The first hundred records of the log (the limit is the feature)."""
    lines = jsonl.first_lines(spark, _log(spark, d, F.lit(False)), 100)
    return lines.select(F.from_json("value", ITEM).alias("r")).select("r.perfume_id", "r.name")


@query("s04_line_kinds", "SELECT CASE WHEN perfume_id % 11 = 0 THEN 'torn' ELSE 'object' END AS kind, count(*) AS n FROM perfumes WHERE perfume_id IS NOT NULL GROUP BY 1")
def line_kinds(spark, d):
    return jsonl.line_kinds(spark, _log(spark, d, F.col("perfume_id") % 11 == 0))


@query(
    "s05_resume",
    f"WITH {CASES}, o AS (SELECT id FROM cases WHERE strlen(id) % 2 = 0 AND query IS NOT NULL) SELECT id FROM cases WHERE id NOT IN (SELECT id FROM o)",
)
def resume(spark, d):
    """Cases without an output in a log that has some outputs twice and a torn line."""
    own = cases(spark, d)
    path = _place(spark, "outputs")
    done = own.where("octet_length(id) % 2 = 0 AND query IS NOT NULL").select(F.to_json(F.struct("id", F.length("query").alias("n"))).alias("value"))
    done.unionByName(done).unionByName(spark.createDataFrame([('{"id": "torn',)], "value string")).write.text(path)
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    outputs = jsonl.completed(jsonl.read_tolerant(spark, path, schema, ("id",))[0], "id", "n")
    return jsonl.still_open(own.select("id"), outputs, "id")


@query(
    "s06_torn_tail",
    "WITH p AS (SELECT perfume_id, row_number() OVER (ORDER BY perfume_id, ingested_at) AS k FROM perfumes WHERE perfume_id IS NOT NULL), "
    "b AS (SELECT coalesce(min(k) FILTER (WHERE perfume_id % 997 = 0), 1000000000) AS bad FROM p) "
    "SELECT count(*) AS valid, coalesce(sum(strlen('{\"id\":' || perfume_id || '}') + 1), 0)::BIGINT AS bytes FROM p, b WHERE k < bad",
)
def torn_tail(spark, d):
    """How much of a log stands before its first torn line."""
    own = table(spark, d, "perfumes").where("perfume_id IS NOT NULL").orderBy("perfume_id", "ingested_at")
    path = _place(spark, "tail")
    line = F.concat(F.lit('{"id":'), F.col("perfume_id").cast("string"), F.lit("}"))
    own.select(F.when(F.col("perfume_id") % 997 == 0, F.lit('{"id":')).otherwise(line).alias("value")).write.text(path)
    return jsonl.progress(spark, path)


_MESSAGE = T.StructType([T.StructField("sample_id", T.LongType()), T.StructField("role", T.StringType())])


def _by_level(spark, d):
    path = _place(spark, "levels")
    table(spark, d, "sample_messages").where("level IS NOT NULL").select("sample_id", "role", F.col("level").alias("of")).write.partitionBy("of").json(path)
    return path


@query("s07_level_folders", "SELECT level, count(*) AS n FROM sample_messages WHERE level IS NOT NULL GROUP BY level")
def level_folders(spark, d):
    """Files in a folder for each level; the level is read off the folder."""
    return jsonl.read_levels(spark, [f"{_by_level(spark, d)}/*/*"], _MESSAGE).groupBy("level").agg(F.count("*").alias("n"))


@query("s08_excluding", "SELECT level, count(*) AS n FROM sample_messages WHERE level NOT IN ('L1', 'L5') GROUP BY level")
def excluding(spark, d):
    return jsonl.read_levels(spark, [f"{_by_level(spark, d)}/*/*"], _MESSAGE, r"of=L[15]/").groupBy("level").agg(F.count("*").alias("n"))


@query("s10_gzip_recount", "SELECT count(*) AS n, count(DISTINCT perfume_id) AS items FROM perfumes")
def gzip_recount(spark, d):
    path = _place(spark, "gzip")
    jsonl.write_json(table(spark, d, "perfumes").select("perfume_id", "name", "brand"), path, gzip=True)
    return jsonl.read_strict(spark, path, ITEM).agg(F.count("*").alias("n"), F.count_distinct("perfume_id").alias("items"))


@query("s12_vector_store", "SELECT vec_id, len(embedding)::INT AS dims, label FROM embeddings WHERE vec_id % 3 = 0")
def vector_store(spark, d):
    """A store of vectors built in two runs, of which the second adds only what isn't there yet; then looked up by id."""
    own, path = table(spark, d, "embeddings").select("vec_id", "embedding", "label"), _place(spark, "vectors")
    own.where("vec_id % 2 = 0").write.parquet(path)
    jsonl.still_open(own, spark.read.parquet(path), "vec_id").write.mode("append").parquet(path)
    asked = own.where("vec_id % 3 = 0").select("vec_id")
    return spark.read.parquet(path).join(asked, "vec_id", "left_semi").select("vec_id", F.size("embedding").alias("dims"), "label")


@query("s14_json_sink", f"WITH {PLAIN} SELECT perfume_id, name, brand FROM items")
def json_sink(spark, d):
    path = _place(spark, "json")
    jsonl.write_json(plain_items(spark, d).select("perfume_id", "name", "brand"), path)
    return jsonl.read_strict(spark, path, ITEM)


@query(
    "s15_snapshot",
    f"WITH {PLAIN}, o AS (SELECT perfume_id, row_number() OVER (ORDER BY perfume_id) - 1 AS pos, length(name) AS n FROM items) SELECT perfume_id, pos, n FROM o WHERE pos % 3 <> 0",
)
def snapshot(spark, d):
    """Outputs of the finished cases, in the order of the cases (dense positions by ranges, no single sort task)."""
    own = numbered(plain_items(spark, d).select("perfume_id", "name"), "perfume_id")
    outputs = own.where("pos % 3 <> 0").select("perfume_id", F.length("name").cast("long").alias("n"))
    path = _place(spark, "snapshot")
    jsonl.write_json(jsonl.snapshot(own, outputs, "perfume_id", "pos").select("perfume_id", "pos", "n"), path)
    return spark.read.schema("perfume_id long, pos long, n long").json(path)


@query("s16_csv_sink", f"WITH {PLAIN} SELECT perfume_id, name_norm, year::BIGINT AS year, popularity FROM items WHERE name_norm <> ''")
def csv_sink(spark, d):
    path = _place(spark, "csv")
    jsonl.write_csv(plain_items(spark, d).where("name_norm <> ''").select("perfume_id", "name_norm", F.col("year").cast("long").alias("year"), "popularity"), path)
    return spark.read.option("header", True).option("escape", '"').schema("perfume_id long, name_norm string, year long, popularity long").csv(path)


@query(
    "s17_report",
    "WITH c AS (SELECT level, split, count(*) AS n FROM sample_messages WHERE level IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2), "
    "r AS (SELECT level || '/' || split AS part, n FROM c) "
    "SELECT 1 AS line_no, '# Messages' AS line UNION ALL SELECT 2, '| part | n |' UNION ALL SELECT 3, '| --- | --- |' "
    "UNION ALL SELECT (row_number() OVER (ORDER BY part) + 3)::INT, '| ' || part || ' | ' || n || ' |' FROM r",
)
def report(spark, d):
    """A Markdown report of message counts."""
    by = table(spark, d, "sample_messages").where("level IS NOT NULL AND split IS NOT NULL").groupBy(F.concat_ws("/", "level", "split").alias("part")).agg(F.count("*").alias("n"))
    return jsonl.report(by, "Messages", ["part", "n"], "part")


@query("s19_manifest_check", "SELECT 1::BIGINT AS mismatches")
def manifest_check(spark, d):
    """Files that differ from a manifest of which one entry was altered."""
    path = _place(spark, "release")
    table(spark, d, "perfumes").select("perfume_id", "name").repartition(4).write.json(path)
    found = jsonl.manifest(spark, path).where("path LIKE '%.json'")
    first = found.agg(F.min("path")).scalar()
    expected = found.withColumn("bytes", F.when(F.col("path") == first, F.col("bytes") + 1).otherwise(F.col("bytes")))
    return jsonl.mismatches(expected, found).agg(F.count("*").alias("mismatches"))
