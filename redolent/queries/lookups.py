"""Catalog lookups: the statements a retrieval service sends to its catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from redolent.functions.text import fold
from redolent.operators import relational as R
from redolent.operators import resolve
from redolent.plans import search
from redolent.queries.common import CASES, EDGES, FOLD, ITEMS, PLAIN, cases, edges, items, plain_items, query
from redolent.session import materialize, table



@query("q01_brand_popularity", f"WITH {PLAIN} SELECT brand, sum(popularity)::BIGINT AS total_popularity FROM items WHERE brand <> '' GROUP BY brand")
def brand_popularity(spark, d):
    return plain_items(spark, d).where("brand <> ''").groupBy("brand").agg(F.sum("popularity").alias("total_popularity"))


@query("q02_counts", f"WITH {PLAIN}, {EDGES} SELECT (SELECT count(*) FROM items) AS perfumes, (SELECT count(*) FROM edges) AS similarity_edges")
def counts(spark, d):
    return plain_items(spark, d).agg(F.count("*").alias("perfumes")).join(edges(spark, d).agg(F.count("*").alias("similarity_edges")))


@query("q04_brand_spelling", f"WITH {PLAIN}, s AS (SELECT brand_norm, trim(brand) AS b, sum(popularity)::BIGINT AS n FROM items WHERE coalesce(trim(brand), '') <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY brand_norm ORDER BY n DESC, b DESC) AS rn, sum(n) OVER (PARTITION BY brand_norm) AS t FROM s) SELECT brand_norm, b AS brand, t::BIGINT AS total FROM r WHERE rn = 1")
def brand_spelling(spark, d):
    return resolve.brand_totals(plain_items(spark, d))


_EXACT = "{} ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 20"


@query("q05_exact_name", f"WITH {PLAIN} " + _EXACT.format("SELECT perfume_id, name, popularity FROM items WHERE name_norm = 'valusim cuir' OR label_norm = 'nousite lizete'"))
def exact_name(spark, d):
    own = plain_items(spark, d).where("name_norm = 'valusim cuir' OR label_norm = 'nousite lizete'")
    return R.top_k(own, 20, F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")).select("perfume_id", "name", "popularity")


@query("q06_exact_branded", f"WITH {PLAIN} " + _EXACT.format("SELECT perfume_id, name, brand FROM items WHERE (name_norm = 'nousite' AND brand_norm = 'lizete') OR label_norm = 'valusim cuir gilzamend'"))
def exact_branded(spark, d):
    own = plain_items(spark, d).where("(name_norm = 'nousite' AND brand_norm = 'lizete') OR label_norm = 'valusim cuir gilzamend'")
    return R.top_k(own, 20, F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")).select("perfume_id", "name", "brand")


@query("q08_token_search", f"WITH {PLAIN} SELECT perfume_id, name, popularity FROM items WHERE name_norm LIKE '%nocturne%' OR name_norm LIKE '%cuir%' OR name_norm LIKE '%song%' ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 500")
def token_search(spark, d):
    hit = F.lit(False)
    for t in ("nocturne", "cuir", "song"):
        hit = hit | F.col("name_norm").contains(t)
    return R.top_k(plain_items(spark, d).where(hit), 500, F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")).select("perfume_id", "name", "popularity")


@query("q09_brand_catalog", f"WITH {PLAIN} SELECT perfume_id, name, rating FROM items WHERE brand_norm = 'lizete' ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 500")
def brand_catalog(spark, d):
    return R.top_k(plain_items(spark, d).where("brand_norm = 'lizete'"), 500, F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")).select("perfume_id", "name", "rating")


@query("q10_prefix", f"WITH {PLAIN} SELECT perfume_id, name_norm FROM items WHERE name_norm LIKE 'eau de %' ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 25")
def prefix(spark, d):
    return R.top_k(plain_items(spark, d).where(F.startswith("name_norm", F.lit("eau de "))), 25, F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")).select("perfume_id", "name_norm")


@query("q11_neighbours", f"WITH {PLAIN}, {EDGES}, r AS (SELECT source_id, perfume_id, name, up_votes, down_votes, row_number() OVER (PARTITION BY source_id ORDER BY up_votes - down_votes DESC, up_votes DESC, perfume_id) AS rank FROM edges JOIN items ON perfume_id = target_id) SELECT * FROM r WHERE rank <= 10")
def neighbours(spark, d):
    """The best neighbours of every item at once; edges to items that aren't there fall away."""
    joined = edges(spark, d).join(plain_items(spark, d).select("perfume_id", "name"), F.col("target_id") == F.col("perfume_id"))
    return R.top_k_per(joined, ["source_id"], 10, (F.col("up_votes") - F.col("down_votes")).desc(), F.col("up_votes").desc(), F.col("perfume_id")).select("source_id", "perfume_id", "name", "up_votes", "down_votes", "rank")


@query("q12_filtered_pool", f"WITH {PLAIN} SELECT perfume_id, popularity, rating FROM items WHERE gender IN ('male', 'unisex') AND rating >= 3.5 AND popularity >= 10 ORDER BY popularity DESC, rating DESC, perfume_id LIMIT 4000")
def filtered_pool(spark, d):
    own = plain_items(spark, d).where("gender IN ('male', 'unisex') AND rating >= 3.5 AND popularity >= 10")
    return R.top_k(own, 4000, F.col("popularity").desc(), F.col("rating").desc(), F.col("perfume_id")).select("perfume_id", "popularity", "rating")


@query("q13_point_lookup", f"WITH {PLAIN} SELECT perfume_id, name, brand, rating FROM items WHERE perfume_id IN (SELECT DISTINCT best_pick_id FROM sample_messages)")
def point_lookup(spark, d):
    """The records of all ids that the conversations pick, as one semi join."""
    ids = table(spark, d, "sample_messages").select(F.col("best_pick_id").alias("perfume_id"))
    return plain_items(spark, d).join(ids, "perfume_id", "left_semi").select("perfume_id", "name", "brand", "rating")


_NGRAM = f"""WITH {PLAIN}, {CASES}, w AS (SELECT id, string_split({FOLD.format('query')}, ' ') AS t FROM cases WHERE query IS NOT NULL),
s AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM w), g AS (SELECT DISTINCT id, array_to_string(t[i:i + n - 1], ' ') AS gram FROM s, range(1, 9) r(n) WHERE i + n - 1 <= len(t)),
n AS (SELECT DISTINCT name_norm FROM items WHERE length(name_norm) >= 4)
SELECT id, gram AS mention FROM g JOIN n ON gram = name_norm"""


@query("q19_ngram_mentions", _NGRAM)
def ngram_mentions(spark, d):
    """Catalog names that questions mention: all word windows of 1 to 8 words held against the names on equality.

    A semi join, as Spark sizes the windows like the questions they come from and would broadcast them all in another join.
    """
    words = F.split("folded", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    grams = cases(spark, d).where("query IS NOT NULL").select("id", fold(F.col("query")).alias("folded")).select("id", words.alias("w")).select("id", F.explode(F.array_distinct(spans)).alias("mention"))
    names = plain_items(spark, d).where(F.length("name_norm") >= 4).select(F.col("name_norm").alias("mention")).distinct()
    return grams.join(names, "mention", "left_semi").select("id", "mention")


@query("q20_labels", f"WITH {PLAIN} SELECT DISTINCT name || ' by ' || brand AS label FROM items WHERE name IS NOT NULL AND brand IS NOT NULL")
def labels(spark, d):
    return plain_items(spark, d).where("name IS NOT NULL AND brand IS NOT NULL").select(F.concat("name", F.lit(" by "), "brand").alias("label")).distinct()


@query("q23_integrity", f"WITH {PLAIN}, {EDGES} SELECT (SELECT count(*) - count(DISTINCT perfume_id) FROM perfumes) AS repeated_items, (SELECT count(*) FROM edges WHERE source_id = target_id) AS self_edges, (SELECT count(*) FROM edges WHERE target_id NOT IN (SELECT perfume_id FROM items)) AS dangling, (SELECT count(*) FROM items WHERE year < 1800 OR year > 2026) AS impossible_years")
def integrity(spark, d):
    p, e, i = table(spark, d, "perfumes"), edges(spark, d), plain_items(spark, d)
    checks = [p.agg((F.count("*") - F.count_distinct("perfume_id")).alias("repeated_items")), e.agg(F.count_if(F.col("source_id") == F.col("target_id")).alias("self_edges")), e.join(i, F.col("target_id") == F.col("perfume_id"), "left_anti").agg(F.count("*").alias("dangling")), i.agg(F.count_if(F.expr("year < 1800 OR year > 2026")).alias("impossible_years"))]
    out = checks[0]
    for c in checks[1:]:
        out = out.join(c)  # one row each
    return out


@query("a02_alias_index", f"""WITH {PLAIN}, b AS (SELECT DISTINCT brand_norm, string_split(brand_norm, ' ') AS w FROM items WHERE coalesce(trim(brand), '') <> ''),
a AS (SELECT brand_norm, brand_norm AS alias FROM b UNION ALL SELECT brand_norm, array_to_string([x[1] for x in w], '') FROM b WHERE len(w) BETWEEN 2 AND 5 UNION ALL SELECT brand_norm, array_to_string([x[1] for x in w], ' ') FROM b WHERE len(w) BETWEEN 2 AND 5)
SELECT alias, min(brand_norm) AS brand_norm FROM a WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT brand_norm) = 1""")
def alias_index(spark, d):
    return resolve.alias_index(plain_items(spark, d))


@query("w10_dominant_member", f"""WITH {PLAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY brand_norm ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id) AS rn, lead(popularity) OVER (PARTITION BY brand_norm ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id) AS nxt FROM items WHERE brand_norm <> '')
SELECT brand_norm, perfume_id, popularity, CASE WHEN popularity >= 500 AND popularity >= 2 * coalesce(nxt, 0) THEN 'dominant' ELSE 'ambiguous' END AS outcome FROM r WHERE rn = 1""")
def dominant_member(spark, d):
    return R.dominant(plain_items(spark, d).where("brand_norm <> ''"), ["brand_norm"]).select("brand_norm", "perfume_id", "popularity", "outcome")


_HINTS = f"""WITH {PLAIN}, {CASES}, h AS (SELECT id AS hint_id, {FOLD.format('expected_resolved_reference')} AS hint_norm FROM cases WHERE trim(expected_resolved_reference) <> ''),
s AS (SELECT *, trim(regexp_extract(hint_norm, '^(.*) by (.*)$', 1)) AS n, trim(regexp_extract(hint_norm, '^(.*) by (.*)$', 2)) AS b FROM h),
o AS (SELECT hint_id, hint_norm, CASE WHEN n <> '' AND b <> '' THEN n ELSE hint_norm END AS name_hint, CASE WHEN n <> '' AND b <> '' THEN b END AS brand_hint FROM s),
x1 AS (SELECT hint_id, i.* FROM o JOIN items i ON hint_norm = name_norm UNION ALL SELECT hint_id, i.* FROM o JOIN items i ON concat_ws(' ', name_hint, brand_hint) = label_norm),
e AS (SELECT hint_id, perfume_id, 'exact' AS stage FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id) AS rn FROM x1) WHERE rn = 1),
x2 AS (SELECT hint_id, i.* FROM o JOIN items i ON name_hint = name_norm AND starts_with(brand_norm, brand_hint) WHERE hint_id NOT IN (SELECT hint_id FROM e)),
f AS (SELECT hint_id, perfume_id, 'branded' AS stage FROM (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id) AS rn FROM x2) WHERE rn = 1),
x3 AS (SELECT hint_id, i.* FROM o JOIN items i ON starts_with(name_norm, name_hint || ' ') WHERE hint_id NOT IN (SELECT hint_id FROM e) AND hint_id NOT IN (SELECT hint_id FROM f)),
g AS (SELECT hint_id, CASE WHEN ok THEN perfume_id END AS perfume_id, CASE WHEN ok THEN 'family' ELSE 'ambiguous' END AS stage FROM (SELECT *, popularity >= 500 AND popularity >= 2 * coalesce(nxt, 0) AS ok FROM (SELECT *, row_number() OVER w AS rn, lead(popularity) OVER w AS nxt FROM x3 WINDOW w AS (PARTITION BY hint_id ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id)) WHERE rn = 1)),
a AS (FROM e UNION ALL FROM f UNION ALL FROM g) SELECT h.hint_id, a.perfume_id, coalesce(a.stage, 'unresolved') AS stage FROM h LEFT JOIN a USING (hint_id)"""


@query("e05_resolve_cascade", _HINTS)
def resolve_cascade(spark, d):
    hints = cases(spark, d).where("trim(expected_resolved_reference) <> ''").select(F.col("id").alias("hint_id"), fold(F.col("expected_resolved_reference")).alias("hint_norm"))
    return resolve.resolve(hints, plain_items(spark, d))


_CONF = "CASE WHEN up_votes + down_votes <= 0 THEN 0.0 ELSE (up_votes + 1) / (up_votes + down_votes + 2) * 0.72 + least(ln(1 + up_votes + down_votes) / ln(501), 1.0) * 0.28 END"


def _sim(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) * 0.65 + len(list_intersect({a}, {b})) / least(len({a}), len({b})) * 0.35 END"


@query(
    "v10_from_hints",
    f"""WITH r AS ({_HINTS}), {ITEMS}, {EDGES}, {CASES}, asked AS (SELECT hint_id, perfume_id AS source_id FROM r WHERE perfume_id IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY up_votes - down_votes DESC, up_votes DESC, target_id) AS rc FROM edges),
s AS (SELECT c.source_id, b.perfume_id, b.label_norm, b.brand_norm, b.gender, b.popularity, list_concat(b.accords, b.notes) AS traits,
 round(({_CONF}) * 0.68 + (({_sim('a.accords', 'b.accords')}) * 0.68 + ({_sim('a.notes', 'b.notes')}) * 0.32) * 0.24 + (CASE WHEN b.popularity > 0 THEN least(log10(b.popularity + 1) / log10(50000.0), 1.0) ELSE 0.0 END) * 0.08, 6) AS score
 FROM c JOIN items b ON b.perfume_id = target_id JOIN items a ON a.perfume_id = source_id WHERE rc <= 200 AND b.label_norm IS DISTINCT FROM a.label_norm),
f AS (SELECT hint_id, s.* FROM asked JOIN s USING (source_id) JOIN cases ON cases.id = hint_id
 WHERE (coalesce(len(allowed_genders), 0) = 0 OR list_contains(allowed_genders, gender)) AND s.popularity >= coalesce(min_popularity, 0) AND (coalesce(len(must_exclude), 0) = 0 OR NOT list_has_any(traits, must_exclude))),
l AS (SELECT *, row_number() OVER (PARTITION BY hint_id, label_norm ORDER BY score DESC, perfume_id) AS r1 FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY hint_id, brand_norm ORDER BY score DESC, perfume_id) AS r2 FROM l WHERE r1 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY score DESC, perfume_id) AS rank FROM b WHERE r2 <= 2)
SELECT hint_id, perfume_id, score, rank FROM k WHERE rank <= 10""",
)
def graph_from_hints(spark, d):
    """Graph search for the typed reference of every case, with the case's genders, popularity and exclusions."""
    own = cases(spark, d)
    hints = own.where("trim(expected_resolved_reference) <> ''").select(F.col("id").alias("hint_id"), fold(F.col("expected_resolved_reference")).alias("hint_norm"))
    resolved = materialize(resolve.resolve(hints, plain_items(spark, d)), "resolved")
    asked = own.select(F.col("id").alias("hint_id"), F.col("allowed_genders").alias("genders"), F.col("min_popularity"), F.col("must_exclude").alias("excluded"))
    return search.similar_to_hints(asked, items(spark, d), edges(spark, d), resolved)


@query("e05_resolve_fuzzy")
def resolve_fuzzy(spark, d):
    """The cascade with its last stage, the sequence ratio, which SQL has no counterpart for."""
    hints = cases(spark, d).where("trim(expected_resolved_reference) <> ''").select(F.col("id").alias("hint_id"), fold(F.col("expected_resolved_reference")).alias("hint_norm"))
    return resolve.resolve(hints, plain_items(spark, d), fuzzy=True)


@query("e03_split_hints", f"WITH {CASES}, h AS (SELECT id, {FOLD.format('expected_resolved_reference')} AS t FROM cases WHERE trim(expected_resolved_reference) <> ''), s AS (SELECT *, trim(regexp_extract(t, '^(.*) by (.*)$', 1)) AS n, trim(regexp_extract(t, '^(.*) by (.*)$', 2)) AS b FROM h) SELECT id, CASE WHEN n <> '' AND b <> '' THEN n ELSE t END AS name_hint, CASE WHEN n <> '' AND b <> '' THEN b END AS brand_hint FROM s")
def split_hints(spark, d):
    own = cases(spark, d).where("trim(expected_resolved_reference) <> ''").select("id", fold(F.col("expected_resolved_reference")).alias("t"))
    name, brand = resolve.split_hint(F.col("t"))
    return own.select("id", name.alias("name_hint"), brand.alias("brand_hint"))


@query("e01_concentrations", f"WITH {PLAIN} SELECT perfume_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name_norm, '\\be ?d ?p\\b|\\bepd\\b', 'eau de parfum', 'g'), '\\be ?d ?t\\b|\\betd\\b', 'eau de toilette', 'g'), '\\be ?d ?c\\b', 'eau de cologne', 'g'), '\\bparfume\\b', 'parfum', 'g') AS expanded FROM items")
def concentrations(spark, d):
    return plain_items(spark, d).select("perfume_id", resolve.expand_concentrations(F.col("name_norm")).alias("expanded"))


@query("e02_signature", f"WITH {PLAIN}, w AS (SELECT perfume_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name_norm, '\\be ?d ?p\\b', 'edp', 'g'), '\\be ?d ?t\\b', 'edt', 'g'), '\\be ?d ?c\\b', 'edc', 'g'), '\\beau de (parfum|toilette|cologne)\\b', 'ed\\1', 'g'), ' ') AS t FROM items WHERE name_norm IS NOT NULL), n AS (SELECT perfume_id, [CASE x WHEN 'edparfum' THEN 'edp' WHEN 'edtoilette' THEN 'edt' WHEN 'edcologne' THEN 'edc' ELSE x END for x in t] AS t FROM w) SELECT perfume_id, array_to_string([x for x in t if x <> '' AND NOT list_contains(string_split('{' '.join(resolve.EDITIONS + resolve.CONNECTORS)}', ' '), x)], ' ') AS core FROM n")
def signature(spark, d):
    core, _ = resolve.signature(F.col("name_norm"))
    return plain_items(spark, d).where("name_norm IS NOT NULL").select("perfume_id", F.array_join(core, " ").alias("core"))


_EDGE = f"""WITH {PLAIN}, {CASES}, b AS (SELECT DISTINCT brand_norm, string_split(brand_norm, ' ') AS w FROM items WHERE coalesce(trim(brand), '') <> ''),
a0 AS (SELECT brand_norm, brand_norm AS alias FROM b UNION ALL SELECT brand_norm, array_to_string([x[1] for x in w], '') FROM b WHERE len(w) BETWEEN 2 AND 5 UNION ALL SELECT brand_norm, array_to_string([x[1] for x in w], ' ') FROM b WHERE len(w) BETWEEN 2 AND 5),
a AS (SELECT alias, min(brand_norm) AS brand_norm FROM a0 WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT brand_norm) = 1),
h AS (SELECT id AS hint_id, {FOLD.format('expected_resolved_reference')} AS hint_norm, string_split({FOLD.format('expected_resolved_reference')}, ' ') AS t FROM cases WHERE trim(expected_resolved_reference) <> ''),
s AS (SELECT hint_id, n, array_to_string(t[1:n], ' ') AS alias, array_to_string(t[n + 1:], ' ') AS rest FROM h, range(1, 6) r(n) WHERE n <= len(t) UNION ALL SELECT hint_id, n, array_to_string(t[len(t) - n + 1:], ' '), array_to_string(t[1:len(t) - n], ' ') FROM h, range(1, 6) r(n) WHERE n <= len(t)),
m AS (SELECT hint_id, n, alias, brand_norm, regexp_replace(rest, '^s ', '') AS rest FROM s JOIN a USING (alias)),
x AS (SELECT *, row_number() OVER (PARTITION BY hint_id ORDER BY n DESC, length(rest) DESC, alias DESC, rest DESC) AS rn FROM m)
SELECT h.hint_id, h.hint_norm, x.brand_norm AS brand_hint, coalesce(x.rest, h.hint_norm) AS name_hint FROM h LEFT JOIN x ON h.hint_id = x.hint_id AND x.rn = 1"""


@query("e04_edge_brand", _EDGE)
def edge_brand(spark, d):
    hints = cases(spark, d).where("trim(expected_resolved_reference) <> ''").select(F.col("id").alias("hint_id"), fold(F.col("expected_resolved_reference")).alias("hint_norm"))
    return resolve.edge_brand(hints, resolve.alias_index(plain_items(spark, d)))


@query("e11_brand_collision", f"WITH {PLAIN}, {CASES}, b AS (SELECT DISTINCT brand_norm FROM items WHERE length(brand_norm) >= 4), w AS (SELECT id, string_split({FOLD.format('query')}, ' ') AS t FROM cases WHERE query IS NOT NULL), g AS (SELECT DISTINCT id, array_to_string(t[i:i + n - 1], ' ') AS gram FROM w, range(1, 60) p(i), range(1, 9) r(n) WHERE i + n - 1 <= len(t)) SELECT id, brand_norm FROM g JOIN b ON gram = brand_norm")
def brand_collision(spark, d):
    """Brands that a question happens to mention, found by word windows instead of comparing each question with each brand.

    A semi join, so that no windows are broadcast.
    """
    own = cases(spark, d).where("query IS NOT NULL").select("id", F.split(fold(F.col("query")), " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), " "))))
    brands = plain_items(spark, d).where(F.length("brand_norm") >= 4).select("brand_norm").distinct()
    return own.select("id", F.explode(F.array_distinct(spans)).alias("brand_norm")).join(brands, "brand_norm", "left_semi").select("id", "brand_norm")


@query("j03_enrich_metadata", f"WITH {PLAIN}, {EDGES} SELECT source_id, target_id, coalesce(p.year, -1)::BIGINT AS year, coalesce(p.longevity, 0.0) AS longevity FROM edges LEFT JOIN items p ON p.perfume_id = target_id")
def enrich_metadata(spark, d):
    own = plain_items(spark, d).select(F.col("perfume_id").alias("target_id"), "year", "longevity")
    return edges(spark, d).join(own, "target_id", "left").select("source_id", "target_id", F.coalesce("year", F.lit(-1)).cast("long").alias("year"), F.coalesce("longevity", F.lit(0.0)).alias("longevity"))


@query("j09_labels_missing", f"WITH {PLAIN} SELECT l.label_id FROM label_list l WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.name = l.name)")
def labels_missing(spark, d):
    return table(spark, d, "label_list").join(plain_items(spark, d).select("name"), "name", "left_anti").select("label_id")


@query("j12_multi_reference", f"WITH {EDGES}, r AS (SELECT target_id, count(*) AS refs, sum(up_votes)::BIGINT AS up, sum(down_votes)::BIGINT AS down FROM edges WHERE source_id IN (1, 2, 3, 4, 5) GROUP BY target_id) SELECT target_id, refs, up, down, round(up / 5.0, 6) AS mean_up FROM r")
def multi_reference(spark, d):
    own = edges(spark, d).where(F.col("source_id").isin(1, 2, 3, 4, 5))
    by = own.groupBy("target_id").agg(F.count("*").alias("refs"), F.sum("up_votes").alias("up"), F.sum("down_votes").alias("down"))
    return by.select("*", F.round(F.col("up") / 5.0, 6).alias("mean_up"))


@query("j12_every_request")
def every_request(spark, d):
    """The merge for every source as a request, all its neighbours being the references."""
    own = edges(spark, d)
    return R.merged_neighbours(own.select(F.col("source_id").alias("request"), F.col("target_id").alias("source_id")), own)


@query("v11_every_source")
def every_source(spark, d):
    """Every source's neighbours, filled up to 20 with the best known of 50 items, in one job."""
    own = plain_items(spark, d).select("perfume_id", "popularity")
    found = edges(spark, d).join(own, F.col("target_id") == F.col("perfume_id"), "left_semi").select("source_id", F.col("target_id").alias("perfume_id"), F.col("up_votes").cast("double").alias("score"))
    more = R.top_k(own, 50, F.col("popularity").desc(), F.col("perfume_id")).select("perfume_id", F.col("popularity").cast("double").alias("score"))
    return R.supplemented_each(found, more, 20).select("source_id", "perfume_id", "score", "rank")


@query("w19_longest_label", f"WITH {PLAIN} SELECT brand_norm, name_norm FROM (SELECT brand_norm, name_norm, row_number() OVER (PARTITION BY brand_norm ORDER BY length(name_norm) DESC, name_norm DESC) AS rn FROM items WHERE name_norm IS NOT NULL AND brand_norm IS NOT NULL) WHERE rn = 1")
def longest_label(spark, d):
    return R.longest_match(plain_items(spark, d).where("name_norm IS NOT NULL AND brand_norm IS NOT NULL"), ["brand_norm"], "name_norm")


