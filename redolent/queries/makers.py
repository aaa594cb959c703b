"""Generated records: facts of single items, recommendations with evidence, and the tables a retrieval service is built from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from redolent.operators import catalog as C
from redolent.operators import relational as R
from redolent.operators import scoring
from redolent.queries.common import EDGES, ORDERED, PLAIN, edges, items, plain_items, query
from redolent.queries.search import CONF, sim
from redolent.session import scratch

_HASH = "(perfume_id * 2654435761 + {}) % 4294967296"
_LABEL = "CASE WHEN trim(coalesce(brand, '')) = '' OR name_norm = brand_norm OR ends_with(name_norm, ' by ' || brand_norm) THEN trim(name) ELSE trim(name) || ' by ' || trim(brand) END"
#: Questions about one item, by what they ask for.
ASKS = {
    "notes": "Which notes does {} have?",
    "accords": "What are the accords of {}?",
    "seasons": "When is {} best worn?",
    "rating": "How is {} rated?",
    "info": "Tell me about {}.",
}


@query(
    "g09_fact_records",
    f"""WITH {ORDERED}, k AS (SELECT *, {_LABEL} AS label, ({_HASH.format(11)}) % 5 AS pick FROM items WHERE trim(coalesce(name, '')) <> '')
SELECT perfume_id, CASE pick WHEN 0 THEN 'notes' WHEN 1 THEN 'accords' WHEN 2 THEN 'seasons' WHEN 3 THEN 'rating' ELSE 'info' END AS category,
 CASE pick WHEN 0 THEN 'Which notes does ' || label || ' have?' WHEN 1 THEN 'What are the accords of ' || label || '?' WHEN 2 THEN 'When is ' || label || ' best worn?' WHEN 3 THEN 'How is ' || label || ' rated?' ELSE 'Tell me about ' || label || '.' END AS question,
 label || ': ' || CASE pick WHEN 0 THEN coalesce(nullif(array_to_string(notes, ', '), ''), 'not recorded') WHEN 1 THEN coalesce(nullif(array_to_string(accords, ', '), ''), 'not recorded')
  WHEN 2 THEN coalesce(nullif(array_to_string(seasons, ', '), ''), 'not recorded') WHEN 3 THEN CASE WHEN rating IS NOT NULL AND popularity > 0 THEN printf('%.2f', rating) || '/5 (' || popularity || ' votes)' ELSE 'not recorded' END
  ELSE coalesce(nullif(gender, ''), 'not recorded') || ', ' || coalesce(year::VARCHAR, 'not recorded') END || '.' AS answer FROM k""",
)
def fact_records(spark, d):
    """One question and answer about each named item; what is asked goes by a hash of the id, and nothing is said that isn't recorded."""
    own = items(spark, d).where("trim(coalesce(name, '')) <> ''").withColumn("label", C.label(F.col("name"), F.col("brand"), F.col("name_norm"), F.col("brand_norm")))
    told = {
        "notes": C.or_unknown(F.array_join("notes", ", ")),
        "accords": C.or_unknown(F.array_join("accords", ", ")),
        "seasons": C.or_unknown(F.array_join("seasons", ", ")),
        "rating": F.coalesce(C.rating_text(F.col("rating"), F.col("popularity")), F.lit("not recorded")),
        "info": F.concat_ws(", ", C.or_unknown(F.col("gender")), C.or_unknown(F.col("year"))),
    }
    pick = R.hash_order(F.col("perfume_id"), 11) % 5
    of = lambda values: F.element_at(F.array(*values), (pick + 1).cast("int"))
    asks = [F.concat(F.lit(a), F.col("label"), F.lit(b)) for a, b in (x.split("{}") for x in ASKS.values())]
    return own.select("perfume_id", of([F.lit(k) for k in ASKS]).alias("category"), of(asks).alias("question"), F.concat(F.col("label"), F.lit(": "), of(list(told.values())), F.lit(".")).alias("answer"))


@query(
    "g11_reasoned_records",
    f"""WITH {ORDERED}, {EDGES}, s AS (SELECT source_id, b.perfume_id, {_LABEL.replace('brand_norm', 'b.brand_norm').replace('name_norm', 'b.name_norm').replace('trim(name)', 'trim(b.name)').replace('coalesce(brand', 'coalesce(b.brand').replace('trim(brand)', 'trim(b.brand)')} AS label,
 [x for x in a.accords if list_contains(b.accords, x)][1:3] AS shared, round(({CONF}) * 0.7 + ({sim('a.accords', 'b.accords')}) * 0.3, 6) AS score
 FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id WHERE source_id <> target_id AND trim(coalesce(b.name, '')) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, perfume_id) AS rank FROM s)
SELECT source_id, string_agg(rank || '. ' || label, chr(10) ORDER BY rank) || chr(10) || 'Best pick: ' || max(CASE WHEN rank = 1 THEN label END) || chr(10) || 'Why: '
 || max(CASE WHEN rank = 1 THEN CASE WHEN len(shared) > 0 THEN 'it shares ' || array_to_string(shared, ', ') || '.' ELSE 'readers find it alike.' END END) AS answer FROM r WHERE rank <= 3 GROUP BY source_id""",
)
def reasoned_records(spark, d):
    """For every source of the graph an answer of up to three neighbours, a pick, and up to three shared accords as the reason.

    Each source keeps its three best edges before texts are put together."""
    own = items(spark, d)
    a = own.select(F.col("perfume_id").alias("source_id"), F.col("accords").alias("wanted"))
    b = own.where("trim(coalesce(name, '')) <> ''").select("perfume_id", "accords", C.label(F.col("name"), F.col("brand"), F.col("name_norm"), F.col("brand_norm")).alias("label"))
    both = edges(spark, d).where("source_id <> target_id").join(b, F.col("target_id") == F.col("perfume_id")).join(a, "source_id")
    score = scoring.vote_confidence(F.col("up_votes"), F.col("down_votes")) * 0.7 + scoring.set_similarity(F.col("wanted"), F.col("accords")) * 0.3
    shared = F.slice(F.array_intersect("wanted", "accords"), 1, 3)
    best = R.top_k_per(both.select("source_id", "perfume_id", "label", shared.alias("shared"), F.round(score, 6).alias("score")), ["source_id"], 3, F.col("score").desc(), F.col("perfume_id"))
    why = F.when(F.size("shared") > 0, F.concat(F.lit("it shares "), F.array_join("shared", ", "), F.lit("."))).otherwise("readers find it alike.")
    by = best.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", why.alias("why")))).alias("r"))  # three at most
    lines = F.array_join(F.transform("r", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["label"])), "\n")
    return by.select("source_id", F.concat(lines, F.lit("\nBest pick: "), F.col("r")[0]["label"], F.lit("\nWhy: "), F.col("r")[0]["why"]).alias("answer"))


@query("q22_catalog_tables", f"WITH {PLAIN} SELECT gender, count(*) AS n, max(popularity) AS most FROM items WHERE gender IN ('male', 'unisex') GROUP BY gender")
def catalog_tables(spark, d):
    """The catalog as a table partitioned by gender and sorted by popularity in each file, read back through partition pruning."""
    path = scratch(spark, f"catalog-{uuid.uuid4().hex}")
    own = plain_items(spark, d).withColumn("part", F.when(F.col("gender") == "", "none").otherwise(F.col("gender")))
    own.repartitionByRange("part", F.col("popularity").desc()).sortWithinPartitions("part", F.col("popularity").desc()).write.partitionBy("part").parquet(path)
    return spark.read.parquet(path).where(F.col("part").isin("male", "unisex")).groupBy("gender").agg(F.count("*").alias("n"), F.max("popularity").alias("most"))
