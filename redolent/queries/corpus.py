"""Text and record transforms, profiles and audits over the catalog, the documents and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redolent.operators import catalog as C
from redolent.operators import relational as R
from redolent.operators import state
from redolent.queries.common import EDGES, ITEMS, ORDERED, PLAIN, edges, items, plain_items, query
from redolent.session import table


@query("t01_clean_markup", "SELECT doc_id, trim(regexp_replace(text, '<.*?>', '', 'g')) AS plain FROM documents")
def clean_markup(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_markup(F.col("text")).alias("plain"))


@query("t02_first_sentences")
def first_sentences(spark, d):
    """The first two sentences of every document (SQL engines without lookbehind have no counterpart)."""
    return table(spark, d, "documents").select("doc_id", C.first_sentences(F.col("text")).alias("lead"))


@query("n1_clean_key", "SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'), '[^a-z0-9\\s\\-.]', '', 'g') AS cleaned FROM documents WHERE lang = 'en' AND regexp_full_match(text, '[ -~\\n]*')")
def clean_key(spark, d):
    from redolent.functions.text import clean

    return table(spark, d, "documents").where("lang = 'en' AND text RLIKE '^[ -~\\n]*$'").select("doc_id", clean(F.col("text")).alias("cleaned"))


@query("n1_clean_all")
def clean_all(spark, d):
    """The key of every document, whatever its language, label and spacing (n1_clean_key has those that SQL cleans alike)."""
    from redolent.functions.text import clean_any

    return table(spark, d, "documents").select("doc_id", clean_any(F.col("text")).alias("cleaned"))


@query("n1_fold", f"WITH {PLAIN} SELECT perfume_id, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM items WHERE name IS NOT NULL")
def fold(spark, d):
    from redolent.functions.text import fold as exact

    return plain_items(spark, d).where("name IS NOT NULL").select("perfume_id", exact(F.col("name")).alias("folded"))


@query("n1_fold_latin", f"WITH {PLAIN} SELECT DISTINCT brand, trim(regexp_replace(strip_accents(lower(brand)), '[^a-z0-9]+', ' ', 'g')) AS folded FROM items WHERE brand IS NOT NULL")
def fold_latin(spark, d):
    """The fold as built-in expressions only."""
    from redolent.functions.text import fold_latin as fast

    return plain_items(spark, d).where("brand IS NOT NULL").select("brand", fast(F.col("brand")).alias("folded")).distinct()


@query("t06_vote_shares", "WITH c AS (SELECT l_partkey, quarter(l_shipdate)::INT AS q, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY l_partkey) AS t FROM c) SELECT l_partkey, string_agg(q::VARCHAR, ',' ORDER BY q) AS quarters FROM s WHERE n / t >= 0.2 GROUP BY l_partkey")
def vote_shares(spark, d):
    """The quarters that hold at least a fifth of a part's shipments, through the map form."""
    by = table(spark, d, "lineitem").groupBy("l_partkey", F.quarter("l_shipdate").cast("string").alias("q")).agg(F.count("*").alias("n"))
    maps = by.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(F.struct("q", "n"))).alias("votes"))  # 4 entries at most
    return maps.select("l_partkey", F.array_join(F.array_sort(C.vote_shares(F.col("votes"))), ",").alias("quarters"))


_TITLED = "array_to_string([upper(x[1]) || lower(x[2:]) for x in seasons], ', ')"
_CARD = f"""concat_ws(chr(10), 'Name: ' || trim(name), 'Brand: ' || nullif(trim(brand), ''), 'Gender: ' || nullif(gender, ''), 'Year: ' || year::VARCHAR, 'Accords: ' || nullif(array_to_string(accords, ', '), ''),
 'Notes: ' || nullif(array_to_string(notes, ', '), ''), 'Seasons: ' || nullif({_TITLED}, ''), CASE WHEN rating IS NOT NULL AND popularity > 0 THEN 'Rating: ' || printf('%.2f', rating) || '/5 (' || popularity || ' votes)' END,
 nullif(concat_ws(' | ', CASE WHEN longevity > 0 THEN 'Longevity: ' || printf('%.2f', longevity) || '/5' END, CASE WHEN sillage > 0 THEN 'Sillage: ' || printf('%.2f', sillage) || '/5' END), ''))"""


@query("t08_cards", f"WITH {ITEMS} SELECT perfume_id, concat_ws(chr(10), 'Name: ' || trim(name), 'Brand: ' || nullif(trim(brand), ''), 'Gender: ' || nullif(gender, ''), 'Year: ' || year::VARCHAR, CASE WHEN rating IS NOT NULL AND popularity > 0 THEN 'Rating: ' || printf('%.2f', rating) || '/5 (' || popularity || ' votes)' END) AS head FROM items")
def cards(spark, d):
    own = items(spark, d).select("perfume_id", "name", "brand", "gender", "year", "rating", "popularity", *[F.array().cast("array<string>").alias(c) for c in ("accords", "notes", "seasons")], F.lit(None).cast("double").alias("longevity"), F.lit(None).cast("double").alias("sillage"))
    return C.card(own).select("perfume_id", F.col("card_text").alias("head"))


@query("t08_cards_all", f"WITH {ORDERED} SELECT perfume_id, {_CARD} AS card_text FROM items")
def cards_all(spark, d):
    """The whole card of every item, with accords, notes, seasons, longevity and sillage."""
    return C.card(items(spark, d)).select("perfume_id", "card_text")


@query("t11_card_metrics", f"WITH {PLAIN} SELECT perfume_id, CASE WHEN longevity > 0 THEN printf('%.2f', longevity)::DOUBLE END AS longevity, CASE WHEN sillage > 0 THEN printf('%.2f', sillage)::DOUBLE END AS sillage FROM items")
def card_metrics(spark, d):
    """Numbers written into cards and parsed back."""
    text = C.card(items(spark, d))
    return text.select("perfume_id", C.metric(F.col("card_text"), "Longevity").alias("longevity"), C.metric(F.col("card_text"), "Sillage").alias("sillage"))


@query("t12_card_lists", f"WITH {ITEMS} SELECT perfume_id, len(accords)::INT AS accords, len(notes)::INT AS notes FROM items")
def card_lists(spark, d):
    text = C.card(items(spark, d))
    return text.select("perfume_id", F.size(C.card_list(F.col("card_text"), "Accords")).alias("accords"), F.size(C.card_list(F.col("card_text"), "Notes")).alias("notes"))


@query(
    "t16_documents",
    f"""WITH {ORDERED} SELECT perfume_id, md5(concat_ws(chr(10), nullif({_CARD}, ''), 'Name: ' || trim(name), 'Brand: ' || nullif(trim(brand), ''), 'Gender: ' || nullif(gender, ''), 'Accords: ' || nullif(array_to_string(accords, ', '), ''),
 'Notes: ' || nullif(array_to_string(notes, ', '), ''), 'Best seasons: ' || nullif(array_to_string(seasons, ', '), ''), 'Time profile: ' || nullif(array_to_string(times, ', '), ''))) AS document FROM items""",
)
def documents(spark, d):
    """The embedding text of every item, by its hash."""
    return C.embedding_document(items(spark, d)).select("perfume_id", F.md5("document").alias("document"))


@query(
    "t13_note_tiers",
    f"WITH {ORDERED} SELECT perfume_id, array_to_string(notes[1:2], '|') AS top, array_to_string(notes[3:4], '|') AS middle, array_to_string(notes[5:], '|') AS base, array_to_string(notes, '|') AS flat FROM items",
)
def note_tiers(spark, d):
    """Note tiers written into a card and parsed back (the catalog's first notes stand in for the upper tiers)."""
    part = lambda a, n: F.array_join(F.slice("notes", a, n), ", ")
    tiers = [F.concat(F.lit(f"{head} Notes: "), part(a, n)) for head, a, n in (("Top", 1, 2), ("Middle", 3, 2), ("Base", 5, 10_000))]
    text = F.concat_ws("\n", F.concat_ws(" | ", *tiers), F.concat(F.lit("Notes: "), part(1, 10_000)))
    parsed = items(spark, d).select("perfume_id", C.note_tiers(text).alias("t"))
    return parsed.select("perfume_id", *[F.array_join(f"t.{k}", "|").alias(k) for k in ("top", "middle", "base", "flat")])


@query(
    "t22_profile_blocks",
    f"""WITH {ORDERED}, {EDGES}, r AS (SELECT source_id, name, row_number() OVER (PARTITION BY source_id ORDER BY up_votes DESC, target_id) AS rn FROM edges JOIN items ON perfume_id = target_id WHERE up_votes > down_votes AND trim(name) <> ''),
l AS (SELECT source_id, string_agg(trim(name), ', ' ORDER BY rn) AS liked, count(*) AS n FROM r WHERE rn <= 3 GROUP BY 1)
SELECT perfume_id, '[USER PROFILE]' || chr(10) || CASE WHEN liked IS NULL AND len(accords) = 0 THEN 'No stable preferences recorded yet.'
 ELSE concat_ws(chr(10), 'Liked perfumes: ' || liked, 'Liked accords: ' || nullif(array_to_string(accords[1:2], ', '), '')) || chr(10) || 'Profile confidence: ' || CASE WHEN n >= 3 THEN 'high' ELSE 'low' END END || chr(10) || '[/USER PROFILE]' AS block
FROM items LEFT JOIN l ON source_id = perfume_id""",
)
def profile_blocks(spark, d):
    """A profile for every item taken as a user: its three best liked neighbours and its first accords."""
    own = items(spark, d)
    named = own.where("trim(name) <> ''").select("perfume_id", F.trim("name").alias("name"))
    liked = edges(spark, d).where("up_votes > down_votes").join(named, F.col("target_id") == F.col("perfume_id")).select("source_id", "target_id", "up_votes", "name")
    best = R.top_k_per(liked, ["source_id"], 3, F.col("up_votes").desc(), F.col("target_id"))
    lists = best.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("liked"))  # three at most
    both = own.join(lists, F.col("perfume_id") == F.col("source_id"), "left")
    parts = {"Liked perfumes": F.coalesce("liked", F.array().cast("array<string>")), "Liked accords": F.slice("accords", 1, 2)}
    return both.select("perfume_id", C.profile_block(parts, F.when(F.size("liked") >= 3, "high").otherwise("low")).alias("block"))


@query("t17_vector_metadata", f"WITH {ITEMS} SELECT perfume_id, coalesce(rating, 0.0) AS rating, popularity, " + ", ".join(f"list_contains(seasons, '{s}') AS season_{s}" for s in ("spring", "summer", "autumn", "winter")) + ", list_contains(times, 'day') AS time_day, list_contains(times, 'night') AS time_night FROM items")
def vector_metadata(spark, d):
    return C.vector_metadata(items(spark, d)).drop("top_accord", "top_note")


@query("t18_catalog_rows", f"WITH {PLAIN} SELECT perfume_id, slug, name, brand, name_norm, brand_norm, label_norm, gender, year::BIGINT AS year, rating, popularity FROM items")
def catalog_rows(spark, d):
    return plain_items(spark, d).select("perfume_id", "slug", "name", "brand", "name_norm", "brand_norm", "label_norm", "gender", F.col("year").cast("long").alias("year"), "rating", "popularity")


@query("t19_edges", f"WITH {EDGES} SELECT * FROM edges")
def edge_rows(spark, d):
    return edges(spark, d).select("source_id", "target_id", "up_votes", "down_votes")


@query("t24_labels", f"WITH {PLAIN} SELECT perfume_id, CASE WHEN trim(coalesce(brand, '')) = '' OR name_norm = brand_norm OR ends_with(name_norm, ' by ' || brand_norm) THEN trim(name) ELSE trim(name) || ' by ' || trim(brand) END AS label FROM items")
def labels(spark, d):
    return plain_items(spark, d).select("perfume_id", C.label(F.col("name"), F.col("brand"), F.col("name_norm"), F.col("brand_norm")).alias("label"))


def _bands(name: str) -> str:
    bounds, names = C.BANDS[name]
    whens = " ".join(f"WHEN {name} < {b} THEN '{t}'" for b, t in zip(bounds, names, strict=False))
    return f"CASE WHEN {name} IS NULL THEN 'not recorded; do not infer performance' {whens} ELSE '{names[-1]}' END AS {name}, CASE WHEN {name} IS NULL THEN 'unknown' WHEN {name} < {bounds[0]} THEN 'low' WHEN {name} < {bounds[2]} THEN 'moderate' ELSE 'high' END AS {name}_group"


@query("t25_performance_bands", f"WITH {PLAIN} SELECT perfume_id, {_bands('longevity')}, {_bands('sillage')} FROM items")
def performance_bands(spark, d):
    return plain_items(spark, d).select("perfume_id", *[c for n in C.BANDS for c in (C.performance_band(n).alias(n), C.performance_group(n).alias(f"{n}_group"))])


@query("t25_thresholds", f"WITH {PLAIN} SELECT round(quantile_cont(longevity, 0.25), 6) AS p25, round(quantile_cont(longevity, 0.5), 6) AS p50, round(quantile_cont(longevity, 0.75), 6) AS p75, round(quantile_cont(longevity, 0.95), 6) AS p95 FROM items WHERE longevity > 0")
def thresholds(spark, d):
    """The catalog's own band thresholds (interpolated percentiles)."""
    return plain_items(spark, d).where("longevity > 0").agg(*[F.round(F.percentile("longevity", p), 6).alias(f"p{round(p * 100)}") for p in (0.25, 0.5, 0.75, 0.95)])


@query("t27_compact_cards", f"WITH {PLAIN} SELECT perfume_id, concat_ws(' | ', 'Gender: ' || coalesce(nullif(trim(gender), ''), 'not recorded'), 'Year: ' || coalesce(year::VARCHAR, 'not recorded'), 'Votes: ' || popularity) AS card FROM items")
def compact_cards(spark, d):
    line = lambda head, value: F.concat(F.lit(head), value)
    card = F.concat_ws(" | ", line("Gender: ", C.or_unknown(F.col("gender"))), line("Year: ", C.or_unknown(F.col("year"))), line("Votes: ", F.col("popularity").cast("string")))
    return plain_items(spark, d).select("perfume_id", card.alias("card"))


@query("t30_length_stats", "SELECT source, count(*) AS docs, round(avg(length(text)), 4) AS mean_chars, max(length(text))::BIGINT AS most, count(*) FILTER (length(text) > 2000) AS beyond FROM documents GROUP BY source")
def length_stats(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.max(F.length("text")).cast("long").alias("most"), F.count_if(F.length("text") > 2000).alias("beyond"))


@query("a05_null_profile", f"WITH {PLAIN} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL OR trim({c}::VARCHAR) = '') AS missing FROM items" for c in ("name", "brand", "year", "rating", "longevity", "accords_csv", "notes_csv", "seasons_csv")))
def null_profile(spark, d):
    fields = ("name", "brand", "year", "rating", "longevity", "accords_csv", "notes_csv", "seasons_csv")
    one = plain_items(spark, d).agg(*[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in fields])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in fields])))


@query("a06_distributions", f"WITH {PLAIN} SELECT gender, count(*) AS n, count(DISTINCT brand_norm) AS brands, count(*) FILTER (notes_csv IS NULL) AS without_notes FROM items GROUP BY gender")
def distributions(spark, d):
    return plain_items(spark, d).groupBy("gender").agg(F.count("*").alias("n"), F.count_distinct("brand_norm").alias("brands"), F.count_if(F.col("notes_csv").isNull()).alias("without_notes"))


@query("a17_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentiles(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("a18_latency_summary", "SELECT count(*) AS n, round(avg(value), 4) AS mean, max(value) AS most FROM events")
def latency_summary(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.max("value").alias("most"))


@query("a22_collection_coverage", f"WITH {ITEMS}, {EDGES}, t AS (SELECT DISTINCT source_id, unnest(accords) AS term FROM edges JOIN items ON perfume_id = target_id) SELECT source_id, count(*) AS covered FROM t GROUP BY source_id")
def collection_coverage(spark, d):
    """How many accords an item's neighbours cover together."""
    own = items(spark, d).select(F.col("perfume_id").alias("target_id"), F.explode("accords").alias("term"))
    return edges(spark, d).join(own, "target_id").select("source_id", "term").distinct().groupBy("source_id").agg(F.count("*").alias("covered"))


@query("s18_content_hashes", "SELECT source, sha256(string_agg(h, '' ORDER BY h)) AS tree, count(*) AS docs FROM (SELECT concat_ws(':', source, doc_id // 1000) AS source, sha256(coalesce(text, '')) AS h FROM documents) GROUP BY source")
def content_hashes(spark, d):
    """Tree hashes over chunks of content hashes (1,000 documents a chunk at most)."""
    own = table(spark, d, "documents").select(F.concat_ws(":", "source", F.floor(F.col("doc_id") / 1000).cast("string")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return own.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("tree"), F.count("*").alias("docs"))


@query("s13_not_yet_embedded", f"WITH {PLAIN} SELECT perfume_id FROM items WHERE perfume_id NOT IN (SELECT vec_id FROM embeddings)")
def not_yet_embedded(spark, d):
    done = table(spark, d, "embeddings").select(F.col("vec_id").alias("perfume_id"))
    return plain_items(spark, d).join(done, "perfume_id", "left_anti").select("perfume_id")


@query(
    "w13_carry_forward",
    """WITH o AS (SELECT event_id, user_id, ts, (floor(value)::BIGINT % 12) AS id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seg FROM events),
f AS (SELECT *, CASE WHEN id IS NOT NULL AND row_number() OVER (PARTITION BY user_id, seg, id ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS fst FROM o),
b AS (SELECT *, coalesce(sum(fst) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (CASE WHEN id IS NULL THEN 0 ELSE 1 - fst END)::BIGINT AS again FROM f)
SELECT event_id, before, again, CASE WHEN before > 0 AND id IS NOT NULL THEN again = 0 END AS fresh FROM b""",
)
def carry_forward(spark, d):
    """What a session has given before each event, and whether the event repeats any of it; a signup starts afresh."""
    own = table(spark, d, "events").select("event_id", "user_id", "ts", F.array((F.floor("value") % 12).cast("long")).alias("ids"), (F.col("event_type") == "signup").alias("is_new"))
    return R.carry_forward(own, "user_id", ["ts", "event_id"], "ids", "is_new").select("event_id", "before", "again", "fresh")


@query("w15_inherited", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def inherited(spark, d):
    own = table(spark, d, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("value")))
    return state.inherited(own, "user_id", ["ts", "event_id"], ["p"]).select("event_id", F.col("p_now").alias("last_purchase"))


@query("w16_monotonic", "WITH l AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS falls FROM events) SELECT user_id, coalesce(bool_or(falls), false) AS ever_falls FROM l GROUP BY user_id")
def monotonic(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = table(spark, d, "events").select("user_id", (F.col("value") < F.lag("value").over(w)).alias("falls"))
    return own.groupBy("user_id").agg(F.coalesce(F.bool_or("falls"), F.lit(False)).alias("ever_falls"))


@query("w17_contiguous", "SELECT l_orderkey, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY l_orderkey")
def contiguous(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(((F.min(n) == 1) & (F.max(n) == F.count("*")) & (F.count("*") == F.count_distinct(n))).alias("contiguous"))


@query("x01_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3600 SECOND THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM s GROUP BY user_id, k")
def sessions(spark, d):
    return state.sessions(table(spark, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("started"), "events")


@query("x01_live_sessions", "WITH l AS (SELECT user_id, max(ts) AS last_seen, count(*) AS events FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY user_id) SELECT user_id, events FROM l WHERE last_seen > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 3600 SECOND ORDER BY last_seen DESC, user_id LIMIT 1000")
def live_sessions(spark, d):
    return state.live_sessions(table(spark, d, "events"), "2024-01-10 00:00:00").select("user_id", "events")


@query("x02_last_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def last_status(spark, d):
    return state.last_status(table(spark, d, "events")).select("user_id", "status")


@query("x03_active_intervals", "WITH i AS (SELECT user_id % 10 AS k, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events), o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM i), g AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT k, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS jobs FROM g GROUP BY k, g")
def active_intervals(spark, d):
    own = table(spark, d, "events").select((F.col("user_id") % 10).alias("k"), F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("e"))
    return state.overlapping(own, "k", "s", "e").select("k", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "jobs")


@query("x04_rate_limits", "WITH w AS (SELECT event_type AS scope, sha256(user_id::VARCHAR) AS actor, time_bucket(INTERVAL 1 HOUR, ts) AS s, count(*) AS requests FROM events GROUP BY 1, 2, 3) SELECT scope, actor, strftime(s, '%Y-%m-%d %H:%M:%S') AS started, requests, greatest(0, requests - 1) AS rejected FROM w")
def rate_limits(spark, d):
    own = state.rate_limited(table(spark, d, "events"), 1, "1 hour")
    return own.select("scope", "actor", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("started"), "requests", "rejected")


@query("x06_retention", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) SELECT event_id, rank FROM r WHERE rank <= 5")
def retention(spark, d):
    own = state.retained(table(spark, d, "events"), "user_id", 5, F.col("ts").desc(), F.col("event_id").desc())
    return own.select("event_id", "rank")


@query("j05_composite_key", f"WITH {PLAIN}, k AS (SELECT lower(name) || '::' || lower(brand) AS key, bool_or(rating >= 4) AS good FROM items WHERE name IS NOT NULL AND brand IS NOT NULL GROUP BY 1) SELECT lower(l.name) || '::' || lower(b.brand) AS key, coalesce(good, false) AS good FROM label_list l JOIN brand_list b USING (brand_id) LEFT JOIN k ON k.key = lower(l.name) || '::' || lower(b.brand)")
def composite_key(spark, d):
    key = lambda n, b: F.concat(F.lower(n), F.lit("::"), F.lower(b))
    own = plain_items(spark, d).where("name IS NOT NULL AND brand IS NOT NULL").groupBy(key(F.col("name"), F.col("brand")).alias("key")).agg(F.bool_or(F.col("rating") >= 4).alias("good"))
    listed = table(spark, d, "label_list").join(F.broadcast(table(spark, d, "brand_list")), "brand_id").select(key(F.col("name"), F.col("brand")).alias("key"))
    return listed.join(own, "key", "left").select("key", F.coalesce("good", F.lit(False)).alias("good"))


@query("j06_neighbour_records", f"WITH {EDGES}, {PLAIN}, r AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY up_votes DESC, target_id) AS pos FROM edges) SELECT source_id, pos, name FROM r JOIN items ON perfume_id = target_id WHERE pos <= 8")
def neighbour_records(spark, d):
    cut = R.top_k_per(edges(spark, d), ["source_id"], 8, F.col("up_votes").desc(), F.col("target_id")).withColumnRenamed("rank", "pos")
    return cut.join(plain_items(spark, d), F.col("target_id") == F.col("perfume_id")).select("source_id", "pos", "name")


@query("d05_hierarchy", "SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)")
def hierarchy(spark, d):
    """Hierarchical counts in one pass: small dimensions joined, then a rollup."""
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    own = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
    return own.rollup("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
