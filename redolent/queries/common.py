"""What the query modules share: the registry, the base tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redolent.operators import catalog
from redolent.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FOLD = "trim(regexp_replace(strip_accents(translate(lower(nfc_normalize({})), 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'abcdefghijklmnopqrstuvwxyz0123456789')), '[^a-z0-9]+', ' ', 'g'))"


def _terms(column: str) -> str:
    return f"[{FOLD.format('x')} for x in string_split(coalesce({column}, ''), ',') if {FOLD.format('x')} <> '']"


ONCE = "once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY perfume_id ORDER BY ingested_at DESC NULLS LAST) AS rn FROM perfumes WHERE perfume_id IS NOT NULL) WHERE rn = 1)"
#: Items without their term lists, and with them.
PLAIN = f"{ONCE}, items AS (SELECT * REPLACE (coalesce(popularity, 0) AS popularity, lower(trim(coalesce(gender, ''))) AS gender) FROM once)"
ITEMS = f"{ONCE}, items AS (SELECT * REPLACE (coalesce(popularity, 0) AS popularity, lower(trim(coalesce(gender, ''))) AS gender), list_distinct({_terms('accords_csv')}) AS accords, list_distinct({_terms('notes_csv')}) AS notes, list_distinct({_terms('seasons_csv')}) AS seasons, list_distinct({_terms('time_profile_csv')}) AS times FROM once)"
_FACETS = {"accords": "accords_csv", "notes": "notes_csv", "seasons": "seasons_csv", "times": "time_profile_csv"}
#: Items whose term lists keep the order of the fields.
ORDERED = (
    f"{ONCE}, raw AS (SELECT *, " + ", ".join(f"{_terms(c)} AS {k}" for k, c in _FACETS.items()) + " FROM once), "
    "items AS (SELECT * REPLACE (coalesce(popularity, 0) AS popularity, lower(trim(coalesce(gender, ''))) AS gender, " + ", ".join(f"[x for x, i in {k} if list_position({k}, x) = i] AS {k}" for k in _FACETS) + ") FROM raw)"
)
EDGES = "edges AS (SELECT source_id, target_id, coalesce(up_votes, 0) AS up_votes, coalesce(down_votes, 0) AS down_votes FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY ingested_at DESC NULLS LAST, coalesce(up_votes, 0) DESC, coalesce(down_votes, 0) DESC) AS rn FROM similarity_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL) WHERE rn = 1)"
CASES = "cases AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY query DESC NULLS LAST) AS rn FROM retrieval_eval_cases WHERE id IS NOT NULL) WHERE rn = 1)"
PAIRS = """msg AS (SELECT *, row_number() OVER (PARTITION BY sample_id, CASE role WHEN 'user' THEN 'u' WHEN 'system' THEN 's' ELSE 'a' END ORDER BY ingested_at DESC NULLS LAST, content DESC NULLS LAST) AS rn FROM sample_messages WHERE sample_id IS NOT NULL),
pairs AS (SELECT sample_id, max(level) AS level, max(split) AS split, max(source) AS source, max(CASE WHEN role = 'user' THEN content END) AS question, max(CASE WHEN role IN ('model', 'assistant') THEN content END) AS answer,
 max(CASE WHEN role = 'system' THEN content END) AS system, max(best_pick_id) AS best_pick_id FROM msg WHERE rn = 1 GROUP BY sample_id)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with the SQL it must agree with where SQL can say it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def items(spark: SparkSession, d: str) -> DataFrame:
    return catalog.items(table(spark, d, "perfumes"))


def plain_items(spark: SparkSession, d: str) -> DataFrame:
    """Items without term arrays: JVM-side only."""
    own = catalog.last_wins(table(spark, d, "perfumes").where("perfume_id IS NOT NULL"), ["perfume_id"], [F.col("ingested_at").desc_nulls_last()])
    return own.withColumns({"popularity": F.coalesce("popularity", F.lit(0)), "gender": F.lower(F.trim(F.coalesce("gender", F.lit(""))))})


def edges(spark: SparkSession, d: str) -> DataFrame:
    return catalog.edges(table(spark, d, "similarity_edges"))


def cases(spark: SparkSession, d: str) -> DataFrame:
    return catalog.last_wins(table(spark, d, "retrieval_eval_cases").where("id IS NOT NULL"), ["id"], [F.col("query").desc_nulls_last()])


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row a conversation record: level, split, source, system, question, answer, best_pick_id."""
    kind = F.when(F.col("role") == "user", "u").when(F.col("role") == "system", "s").otherwise("a")
    own = table(spark, d, "sample_messages").where("sample_id IS NOT NULL").withColumn("_k", kind)
    own = catalog.last_wins(own, ["sample_id", "_k"], [F.col("ingested_at").desc_nulls_last(), F.col("content").desc_nulls_last()])
    of = lambda k: F.max(F.when(F.col("_k") == k, F.col("content")))
    return own.groupBy("sample_id").agg(F.max("level").alias("level"), F.max("split").alias("split"), F.max("source").alias("source"), of("u").alias("question"), of("a").alias("answer"), of("s").alias("system"), F.max("best_pick_id").alias("best_pick_id"))


def six(column, name: str):
    """A score rounded to six places."""
    return F.round(column, 6).alias(name)
