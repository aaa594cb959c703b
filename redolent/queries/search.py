"""Filters, scores, searches and vectors over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from redolent.functions.text import fold
from redolent.operators import filters, resolve, scoring, vector
from redolent.operators import relational as R
from redolent.operators.catalog import facets
from redolent.plans import search
from redolent.queries.common import CASES, EDGES, ITEMS, PLAIN, cases, edges, items, plain_items, query, six
from redolent.session import table

POP = "CASE WHEN popularity > 0 THEN least(log10(popularity + 1) / log10(50000.0), 1.0) ELSE 0.0 END"
SHRUNK = "CASE WHEN coalesce(rating, 0.0) <= 0 THEN 0.0 ELSE rating * (CASE WHEN popularity > 0 THEN popularity / (popularity + 250) ELSE 0.0 END) + 3.8 * (1 - (CASE WHEN popularity > 0 THEN popularity / (popularity + 250) ELSE 0.0 END)) END"
RATING = f"CASE WHEN ({SHRUNK}) > 0 THEN least(greatest((({SHRUNK}) - 3.2) / 1.3, 0.0), 1.0) ELSE 0.0 END"
CONF = "CASE WHEN up_votes + down_votes <= 0 THEN 0.0 ELSE (up_votes + 1) / (up_votes + down_votes + 2) * 0.72 + least(ln(1 + up_votes + down_votes) / ln(501), 1.0) * 0.28 END"


def sim(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) * 0.65 + len(list_intersect({a}, {b})) / least(len({a}), len({b})) * 0.35 END"


def strength(term: str, traits: str) -> str:
    family = scoring.FAMILIES.get(term, (term,))
    cases_ = f"WHEN x IN ({', '.join(map(repr, family))}) THEN 1.0"
    if term in ("spicy", "floral"):
        cases_ += f" WHEN list_contains(string_split(x, ' '), '{term}') THEN 0.75"
    if " " in term:
        cases_ += f" WHEN contains(' ' || x || ' ', ' {term} ') OR contains(' {term} ', ' ' || x || ' ') THEN 0.65"
    return f"coalesce(list_max([CASE {cases_} ELSE 0.0 END for x in {traits}]), 0.0)"


@query("f01_criteria", f"WITH {ITEMS} SELECT perfume_id FROM items WHERE gender IN ('female', 'unisex') AND list_has_any(seasons, ['winter', 'autumn']) AND list_contains(accords, 'woody') AND len([x for x in list_concat(accords, notes) if regexp_matches(x, '\\bvanilla\\b')]) = 0 AND rating >= 3.0 AND popularity > 0 AND CASE WHEN longevity > 0 THEN longevity ELSE 0.0 END >= 1.0")
def criteria(spark, d):
    c = filters.Criteria(gender_any_of=("female", "unisex"), seasons=("winter", "autumn"), accords=("woody",), not_terms=("vanilla",), min_rating=3.0, min_longevity=1.0)
    return items(spark, d).where(filters.compile_criteria(c)).select("perfume_id")


@query("f02_forbidden", f"WITH {ITEMS} SELECT perfume_id, len([x for x in list_concat(accords, notes) if x IN ('rose', 'oud') OR regexp_matches(x, '\\brose\\b|\\boud\\b')]) > 0 AS forbidden FROM items")
def forbidden(spark, d):
    return items(spark, d).select("perfume_id", filters.forbidden(F.concat("accords", "notes"), ("rose", "oud")).alias("forbidden"))


@query("f04_rating_floor", f"WITH {PLAIN} SELECT perfume_id, rating FROM items WHERE rating IS NOT NULL AND rating >= 4.0 AND popularity > 0")
def rating_floor(spark, d):
    return plain_items(spark, d).where(filters.rating_floor(4.0)).select("perfume_id", "rating")


@query("f05_positive_metrics", f"WITH {PLAIN} SELECT perfume_id, CASE WHEN longevity > 0 THEN longevity ELSE 0.0 END AS longevity, CASE WHEN sillage > 0 THEN sillage ELSE 0.0 END AS sillage, CASE WHEN value_score > 0 THEN value_score ELSE 0.0 END AS value_score FROM items")
def positive_metrics(spark, d):
    return plain_items(spark, d).select("perfume_id", *[scoring.positive(F.col(c)).alias(c) for c in ("longevity", "sillage", "value_score")])


@query("f06_metadata_filter", f"WITH {ITEMS} SELECT perfume_id FROM items WHERE gender IN ('male', 'unisex') AND list_contains(seasons, 'winter') AND list_contains(times, 'night') AND rating >= 3.0 AND popularity >= 5")
def metadata_filter(spark, d):
    return items(spark, d).where(filters.metadata_filter("male", "winter", "night", 3.0, 5)).select("perfume_id")


@query("f07_filter_years", f"WITH {PLAIN} SELECT perfume_id, year::BIGINT AS year FROM items WHERE year >= 1990 AND year <= 2010 AND gender IN ('female', 'unisex')")
def filter_years(spark, d):
    own = plain_items(spark, d).where(filters.metadata_filter("female", year=(1990, 2010), soft=False))
    return own.select("perfume_id", F.col("year").cast("long").alias("year"))


_WANTED = ("musk", "spicy", "fresh spicy", "oud")


@query("f09_match_strength", f"WITH {ITEMS}, t AS (SELECT perfume_id, list_concat(accords, notes) AS traits FROM items) SELECT perfume_id, " + ", ".join(f"{strength(w, 'traits')}::DOUBLE AS {w.replace(' ', '_')}" for w in _WANTED) + " FROM t")
def match_strength(spark, d):
    traits = F.concat("accords", "notes")
    return items(spark, d).select("perfume_id", *[scoring.best_strength(w, traits).alias(w.replace(" ", "_")) for w in _WANTED])


@query("f11_has_term", f"WITH {ITEMS}, t AS (SELECT perfume_id, ' ' || concat_ws(' ', name_norm, brand_norm, array_to_string(accords, ' '), array_to_string(notes, ' ')) || ' ' AS text, list_concat(accords, notes) AS traits FROM items) SELECT perfume_id FROM t WHERE contains(text, ' leather ') OR {strength('leather', 'traits')} > 0")
def has_term(spark, d):
    return items(spark, d).where(filters.has_term("leather")).select("perfume_id")


@query("f13_required_gate", f"WITH {ITEMS}, t AS (SELECT perfume_id, list_concat(accords, notes) AS traits FROM items), s AS (SELECT bool_or({strength('oud', 'traits')} > 0) AND bool_or({strength('vanilla', 'traits')} > 0) AS ok FROM t) SELECT perfume_id FROM t, s WHERE ok AND {strength('oud', 'traits')} > 0 AND {strength('vanilla', 'traits')} > 0")
def required_gate(spark, d):
    """Items that answer every required term, none at all if some term has no answer in the whole pool."""
    own, traits, terms = items(spark, d), F.concat("accords", "notes"), ("oud", "vanilla")
    ok = search.supported(own, terms)
    return own.where(filters.all_of([F.lit(len(ok) == len(terms)), *[scoring.best_strength(t, traits) > 0 for t in terms]])).select("perfume_id")


@query("f15_exclude_ids", f"WITH {PLAIN} SELECT perfume_id FROM items WHERE perfume_id NOT IN (SELECT source_id FROM similarity_edges WHERE source_id IS NOT NULL)")
def exclude_ids(spark, d):
    gone = table(spark, d, "similarity_edges").select(F.col("source_id").alias("perfume_id"))
    return plain_items(spark, d).join(gone, "perfume_id", "left_anti").select("perfume_id")


@query("m01_shrunk_rating", f"WITH {PLAIN} SELECT perfume_id, round({SHRUNK}, 6) AS shrunk, round(CASE WHEN popularity <= 0 THEN 0.0 ELSE (popularity * coalesce(rating, 0.0) + 200.5) / (popularity + 50) END, 6) AS by_mean FROM items")
def shrunk_rating(spark, d):
    return plain_items(spark, d).select("perfume_id", six(scoring.shrunk_rating(F.col("rating"), F.col("popularity")), "shrunk"), six(scoring.shrunk_rating_by_mean(F.col("rating"), F.col("popularity")), "by_mean"))


@query("m03_popularity_score", f"WITH {PLAIN} SELECT perfume_id, round({POP}, 6) AS popularity_score, round({RATING}, 6) AS rating_score FROM items")
def popularity_score(spark, d):
    return plain_items(spark, d).select("perfume_id", six(scoring.popularity_score(F.col("popularity")), "popularity_score"), six(scoring.rating_score(scoring.shrunk_rating(F.col("rating"), F.col("popularity"))), "rating_score"))


@query("m05_vote_confidence", f"WITH {EDGES} SELECT source_id, target_id, round({CONF}, 6) AS confidence FROM edges")
def vote_confidence(spark, d):
    return edges(spark, d).select("source_id", "target_id", six(scoring.vote_confidence(F.col("up_votes"), F.col("down_votes")), "confidence"))


@query("u01_set_similarity", f"WITH {ITEMS}, {EDGES} SELECT source_id, target_id, round({sim('a.accords', 'b.accords')}, 6) AS accord_similarity, round({sim('a.notes', 'b.notes')}, 6) AS note_similarity FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id")
def set_similarity(spark, d):
    own = items(spark, d).select("perfume_id", "accords", "notes")
    both = edges(spark, d).join(own.alias("a"), F.col("source_id") == F.col("a.perfume_id")).join(own.alias("b"), F.col("target_id") == F.col("b.perfume_id"))
    return both.select("source_id", "target_id", *[six(scoring.set_similarity(F.col(f"a.{f}s"), F.col(f"b.{f}s")), f"{f}_similarity") for f in ("accord", "note")])


_FIT = "CASE WHEN a.gender = '' OR b.gender = '' THEN 0.0 WHEN a.gender = b.gender THEN 1.0 WHEN a.gender = 'unisex' OR b.gender = 'unisex' THEN 0.75 ELSE 0.0 END"


def _avail(f: str, w: float, value: bool) -> str:
    return f"CASE WHEN len(a.{f}) > 0 AND len(b.{f}) > 0 THEN {f'({sim(f'a.{f}', f'b.{f}')}) * {w}' if value else w} ELSE 0.0 END"


_TOP = f"({sim('a.accords', 'b.accords')}) * 0.5 + {_avail('notes', 0.27, True)} + {_avail('seasons', 0.1, True)} + {_avail('times', 0.08, True)} + ({_FIT}) * 0.05"
_BOTTOM = f"0.5 + {_avail('notes', 0.27, False)} + {_avail('seasons', 0.1, False)} + {_avail('times', 0.08, False)} + 0.05"


@query("m09_structural_similarity", f"WITH {ITEMS}, {EDGES} SELECT source_id, target_id, round(({_TOP})::DOUBLE / ({_BOTTOM})::DOUBLE, 6) AS structural FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id")
def structural_similarity(spark, d):
    own = items(spark, d).select("perfume_id", "accords", "notes", "seasons", "times", "gender")
    both = edges(spark, d).join(own.alias("a"), F.col("source_id") == F.col("a.perfume_id")).join(own.alias("b"), F.col("target_id") == F.col("b.perfume_id"))
    return both.select("source_id", "target_id", six(scoring.structural_similarity("a", "b"), "structural"))


@query("m11_bridge", f"WITH {ITEMS}, {EDGES}, s AS (SELECT source_id, target_id, {sim('a.accords', 'b.accords')} AS x FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id) SELECT target_id, count(*) AS refs, round(avg(x) * 0.65 + min(x) * 0.35, 6) AS bridge FROM s GROUP BY target_id HAVING count(*) >= 2")
def bridge(spark, d):
    """How well an item bridges all the references that point to it: mean and worst similarity."""
    own = items(spark, d).select("perfume_id", "accords")
    both = edges(spark, d).join(own.alias("a"), F.col("source_id") == F.col("a.perfume_id")).join(own.alias("b"), F.col("target_id") == F.col("b.perfume_id"))
    by = both.select("target_id", scoring.set_similarity(F.col("a.accords"), F.col("b.accords")).alias("x")).groupBy("target_id")
    return by.agg(F.count("*").alias("refs"), six(F.avg("x") * 0.65 + F.min("x") * 0.35, "bridge")).where("refs >= 2")


_PROFILE = "CASE WHEN gender NOT IN ('male', 'unisex') OR NOT list_has_any(seasons, ['winter']) OR list_has_any(list_concat(accords, notes), ['aquatic']) THEN -1.0 ELSE (list_contains(accords, 'woody')::INT + list_contains(accords, 'amber')::INT) * 4.0 + list_contains(notes, 'vanilla')::INT * 4.0 + list_contains(accords, 'sweet')::INT * 2.0 + list_contains(notes, 'musk')::INT * 1.5 - list_contains(accords, 'powdery')::INT * 2.5 + CASE WHEN gender = 'male' THEN 0.75 ELSE 0.0 END + 1.0 + CASE WHEN rating > 0 AND popularity > 0 THEN least((rating - 3.5) * 0.6, 0.8) ELSE 0.0 END + least(popularity / 50000, 0.8) END"
_SPEC = filters.SemanticProfile(gender_any_of=("male", "unisex"), prefer_gender="male", hard_seasons=("winter",), wanted_accords=("woody", "amber"), wanted_notes=("vanilla",), soft_accords=("sweet",), soft_notes=("musk",), avoid=("aquatic",), soft_avoid_accords=("powdery",))


@query("m12_profile_score", f"WITH {ITEMS} SELECT perfume_id, round({_PROFILE}, 6) AS score FROM items")
def profile_score(spark, d):
    return items(spark, d).select("perfume_id", six(filters.profile_score(_SPEC), "score"))


@query("w03_profile_matches", f"WITH {ITEMS}, s AS (SELECT perfume_id, popularity, round({_PROFILE}, 6) AS score FROM items) SELECT perfume_id, score FROM s WHERE score >= 3.0 ORDER BY score DESC, popularity DESC, perfume_id LIMIT 10")
def profile_matches(spark, d):
    own = items(spark, d).withColumn("score", F.round(filters.profile_score(_SPEC), 6)).where("score >= 3.0")
    return R.top_k(own, 10, F.col("score").desc(), F.col("popularity").desc(), F.col("perfume_id")).select("perfume_id", "score")


@query("m14_minmax", f"WITH {PLAIN} SELECT perfume_id, round(CASE WHEN max(popularity) OVER w > min(popularity) OVER w THEN (popularity - min(popularity) OVER w) / (max(popularity) OVER w - min(popularity) OVER w) ELSE 0.0 END, 6) AS norm FROM items WHERE brand_norm IS NOT NULL WINDOW w AS (PARTITION BY brand_norm)")
def minmax(spark, d):
    own = plain_items(spark, d).where("brand_norm IS NOT NULL").select("perfume_id", "brand_norm", "popularity")
    span = own.groupBy("brand_norm").agg(F.min("popularity").alias("low"), F.max("popularity").alias("high"))
    return own.join(span, "brand_norm").select("perfume_id", six(scoring.minmax(F.col("popularity"), F.col("low"), F.col("high")), "norm"))


@query(
    "m18_levenshtein",
    f"WITH {PLAIN}, b AS (SELECT DISTINCT brand_norm FROM items WHERE length(brand_norm) >= 4) SELECT a.brand_norm AS left_brand, b.brand_norm AS right_brand, levenshtein(a.brand_norm, b.brand_norm)::INT AS distance "
    "FROM b a JOIN b ON a.brand_norm < b.brand_norm WHERE levenshtein(a.brand_norm, b.brand_norm) <= 2",
)
def levenshtein(spark, d):
    """All brands that differ by two letters at most, wherever these are."""
    own = plain_items(spark, d).where(F.length("brand_norm") >= 4).select("brand_norm").distinct()
    near = resolve.within_edits(own.toDF("left_brand"), own.toDF("right_brand"), "left_brand", "right_brand")
    return near.where("left_brand < right_brand")


@query("m17_sequence_ratio")
def sequence_ratio(spark, d):
    """The sequence ratio of typed references and all labels they share a word with (but 'by', which every label has), where it is 0.6 or more; SQL has no counterpart.

    Distinct references meet distinct labels; a pair whose letters alone can't give 0.6 isn't aligned."""
    refs = cases(spark, d).where("expected_resolved_reference IS NOT NULL").select("id", fold(F.col("expected_resolved_reference")).alias("typed"))
    words = refs.select("typed").distinct().select("typed", F.explode(F.array_distinct(F.split("typed", " "))).alias("w")).where("w NOT IN ('', 'by')")
    names = table(spark, d, "label_list").select("label_id", fold(F.col("label")).alias("label"))
    listed = names.select("label_id", "label", F.explode(F.array_distinct(F.split("label", " "))).alias("w"))
    pairs = words.join(listed, "w").select("typed", "label_id", "label").distinct()
    scored = pairs.withColumn("ratio", resolve.ratio_if_close(F.col("typed"), F.col("label"))).where("ratio >= 0.6")
    return refs.join(scored, "typed").select("id", "label_id", six(F.col("ratio"), "ratio"))


@query("m22_compare", f"WITH {PLAIN}, {EDGES} SELECT source_id, target_id, CASE WHEN a.rating IS NULL OR b.rating IS NULL THEN 'missing' WHEN a.rating > b.rating THEN 'higher' WHEN a.rating < b.rating THEN 'lower' ELSE 'tie' END AS rating FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id")
def compare(spark, d):
    own = plain_items(spark, d).select("perfume_id", "rating")
    both = edges(spark, d).join(own.alias("a"), F.col("source_id") == F.col("a.perfume_id")).join(own.alias("b"), F.col("target_id") == F.col("b.perfume_id"))
    return both.select("source_id", "target_id", scoring.compare(F.col("a.rating"), F.col("b.rating")).alias("rating"))


_SCORED = f"scored AS (SELECT *, round({POP} * 0.5 + {RATING} * 0.5, 6) AS score FROM items WHERE label_norm IS NOT NULL AND brand_norm IS NOT NULL)"
_DIV = "l AS (SELECT *, row_number() OVER (PARTITION BY label_norm ORDER BY score DESC, perfume_id) AS r1 FROM scored), b AS (SELECT *, row_number() OVER (PARTITION BY brand_norm ORDER BY score DESC, perfume_id) AS r2 FROM l WHERE r1 = 1)"


@query("w05_diversify", f"WITH {PLAIN}, {_SCORED}, {_DIV} SELECT perfume_id, score FROM b WHERE r2 <= 2 ORDER BY score DESC, perfume_id LIMIT 30")
def diversify(spark, d):
    score = scoring.popularity_score(F.col("popularity")) * 0.5 + scoring.rating_score(scoring.shrunk_rating(F.col("rating"), F.col("popularity"))) * 0.5
    own = plain_items(spark, d).where("label_norm IS NOT NULL AND brand_norm IS NOT NULL").withColumn("score", F.round(score, 6))
    return R.diversify(own, 30, 2).select("perfume_id", "score")


@query("w01_top_matches", f"WITH {PLAIN} SELECT perfume_id, sillage FROM items WHERE gender = 'female' ORDER BY CASE WHEN sillage > 0 THEN sillage ELSE 0.0 END DESC, perfume_id LIMIT 50")
def top_matches(spark, d):
    own = plain_items(spark, d).where(filters.compile_criteria(filters.Criteria(gender="female")))
    return R.top_k(own, 50, filters.sort_key("sillage").desc(), F.col("perfume_id")).select("perfume_id", "sillage")


@query("w07_first_wins", f"WITH {PLAIN}, a AS (SELECT perfume_id, 0 AS priority FROM items ORDER BY popularity DESC, perfume_id LIMIT 100), b AS (SELECT perfume_id, 1 AS priority FROM items ORDER BY rating DESC NULLS LAST, perfume_id LIMIT 100) SELECT perfume_id, min(priority)::INT AS priority FROM (FROM a UNION ALL FROM b) GROUP BY perfume_id")
def first_wins(spark, d):
    own = plain_items(spark, d)
    a, b = R.top_k(own, 100, F.col("popularity").desc(), F.col("perfume_id")), R.top_k(own, 100, F.col("rating").desc_nulls_last(), F.col("perfume_id"))
    return R.first_wins([a.select("perfume_id"), b.select("perfume_id")], "perfume_id", "perfume_id").select("perfume_id", "priority")


@query("w08_provenance", f"WITH {PLAIN}, a AS (SELECT perfume_id, 'popular' AS s FROM items ORDER BY popularity DESC, perfume_id LIMIT 100), b AS (SELECT perfume_id, 'rated' AS s FROM items ORDER BY rating DESC NULLS LAST, perfume_id LIMIT 100) SELECT perfume_id, string_agg(s, ',' ORDER BY s) AS sources FROM (FROM a UNION ALL FROM b) GROUP BY perfume_id")
def provenance(spark, d):
    own = plain_items(spark, d)
    a, b = R.top_k(own, 100, F.col("popularity").desc(), F.col("perfume_id")), R.top_k(own, 100, F.col("rating").desc_nulls_last(), F.col("perfume_id"))
    return R.with_sources({"popular": a, "rated": b}, "perfume_id").select("perfume_id", F.array_join("candidate_sources", ",").alias("sources"))


@query("w09_metric_sort", f"WITH {PLAIN}, r AS (SELECT perfume_id, round({SHRUNK}, 6) AS shrunk FROM items) SELECT perfume_id, shrunk FROM r ORDER BY shrunk DESC NULLS LAST, perfume_id LIMIT 40")
def metric_sort(spark, d):
    own = plain_items(spark, d).select("perfume_id", six(scoring.shrunk_rating(F.col("rating"), F.col("popularity")), "shrunk"))
    return R.top_k(own, 40, F.col("shrunk").desc_nulls_last(), F.col("perfume_id"))


@query("a04_inverted_index", f"WITH {ITEMS}, f AS (SELECT perfume_id, 'accords' AS facet, unnest(accords) AS term FROM items UNION ALL SELECT perfume_id, 'notes', unnest(notes) FROM items UNION ALL SELECT perfume_id, 'seasons', unnest(seasons) FROM items UNION ALL SELECT perfume_id, 'times', unnest(times) FROM items) SELECT facet, term, perfume_id FROM f")
def inverted_index(spark, d):
    return facets(items(spark, d)).select("facet", "term", "perfume_id")


@query("a03_most_common", f"WITH {ITEMS}, f AS (SELECT 'accords' AS facet, unnest(accords) AS term FROM items UNION ALL SELECT 'notes', unnest(notes) FROM items), c AS (SELECT facet, term, count(*) AS n FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, term) AS rank FROM c) SELECT facet, term, n, rank FROM r WHERE rank <= 40")
def most_common(spark, d):
    by = facets(items(spark, d)).where("facet IN ('accords', 'notes')").groupBy("facet", "term").agg(F.count("*").alias("n"))
    return R.top_k_per(by, ["facet"], 40, F.col("n").desc(), F.col("term"))


@query("a23_supported_terms", f"WITH {ITEMS}, t AS (SELECT list_concat(accords, notes) AS traits FROM items) " + " UNION ALL ".join(f"SELECT '{w}' AS term, max({strength(w, 'traits')}) > 0 AS supported FROM t" for w in ("musk", "vanilla", "office", "clean linen")))
def supported_terms(spark, d):
    terms = ("musk", "vanilla", "office", "clean linen")
    traits = F.concat("accords", "notes")
    one = items(spark, d).agg(*[(F.max(scoring.best_strength(t, traits)) > 0).alias(t) for t in terms])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("supported")) for t in terms])))


_GRAPH = f"""WITH {ITEMS}, {EDGES}, c AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY up_votes - down_votes DESC, up_votes DESC, target_id) AS rc FROM edges),
s AS (SELECT c.source_id, b.perfume_id, b.label_norm, b.brand_norm, round(({CONF}) * 0.68 + (({sim('a.accords', 'b.accords')}) * 0.68 + ({sim('a.notes', 'b.notes')}) * 0.32) * 0.24 + ({POP.replace('popularity', 'b.popularity')}) * 0.08, 6) AS score FROM c JOIN items b ON b.perfume_id = target_id JOIN items a ON a.perfume_id = source_id WHERE rc <= 200),
l AS (SELECT *, row_number() OVER (PARTITION BY source_id, label_norm ORDER BY score DESC, perfume_id) AS r1 FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY source_id, brand_norm ORDER BY score DESC, perfume_id) AS r2 FROM l WHERE r1 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, perfume_id) AS rank FROM b WHERE r2 <= 2) SELECT source_id, perfume_id, score, rank FROM k WHERE rank <= 10"""


@query("v10_graph_search", _GRAPH)
def graph_search(spark, d):
    """Graph search for every source of the catalog in one job."""
    return search.similar(items(spark, d), edges(spark, d))


_HYBRID = f"""WITH {ITEMS}, a AS (SELECT *, list_concat(accords, notes) AS traits FROM items), w AS (SELECT * FROM a WHERE gender IN ('male', 'unisex') AND rating >= 3.0 ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 4000),
p AS (SELECT * FROM w WHERE list_contains(seasons, 'winter') AND {strength('woody', 'traits')} > 0 AND NOT (contains(' ' || concat_ws(' ', name_norm, brand_norm, array_to_string(accords, ' '), array_to_string(notes, ' ')) || ' ', ' aquatic ') OR {strength('aquatic', 'traits')} > 0) ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 140),
u AS (SELECT max({strength('musk', 'traits')}) > 0 AS m, max({strength('amber', 'traits')}) > 0 AS b FROM p),
scored AS (SELECT p.*, round(({POP}) * 0.16 + ({RATING}) * 0.08 + (CASE WHEN m AND b THEN (({strength('musk', 'traits')})::DOUBLE + {strength('amber', 'traits')}) / 2 WHEN m THEN {strength('musk', 'traits')} WHEN b THEN {strength('amber', 'traits')} ELSE 0.0 END) * 0.14, 6) AS score FROM p, u), {_DIV}
SELECT perfume_id, name, brand, 0.0::DOUBLE AS semantic, score::DOUBLE AS score FROM b WHERE r2 <= 2 ORDER BY score DESC, perfume_id LIMIT 8"""


@query("v09_hybrid_catalog", _HYBRID)
def hybrid_catalog(spark, d):
    """Hybrid search without a vector: the popular branch, gates, blended score and diversity."""
    spec = search.SearchSpec(gender="male", season="winter", min_rating=3.0, wanted=("musk", "amber"), required=("woody",), excluded=("aquatic",))
    return search.hybrid(items(spark, d), None, spec)




_TEXT = "' ' || concat_ws(' ', name_norm, brand_norm, array_to_string(accords, ' '), array_to_string(notes, ' ')) || ' '"
_NEAR = "1 - list_sum([x[1]::DOUBLE * x[2]::DOUBLE for x in list_zip(e.embedding, q.qe)])"
_ASKED = "something warm like lizete for the evening"
_POOLED = f"""WITH {ITEMS}, a AS (SELECT *, list_concat(accords, notes) AS traits FROM items), q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
near AS (SELECT a.*, {_NEAR} AS distance FROM a JOIN embeddings e ON e.vec_id = a.perfume_id, q ORDER BY distance, perfume_id LIMIT 120),
w AS (SELECT * FROM a ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 4000),
p AS (SELECT * FROM w WHERE NOT (contains({_TEXT}, ' aquatic ') OR {strength('aquatic', 'traits')} > 0) ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 140),
pool AS (SELECT * FROM near UNION ALL SELECT p.*, {_NEAR} FROM p JOIN embeddings e ON e.vec_id = p.perfume_id, q WHERE p.perfume_id NOT IN (SELECT perfume_id FROM near)),
t AS (SELECT *, {strength('musk', 'traits')}::DOUBLE AS t0, {strength('amber', 'traits')}::DOUBLE AS t1, {strength('office', 'traits')}::DOUBLE AS t2, coalesce(length(brand_norm) >= 4 AND contains(' {_ASKED} ', ' ' || brand_norm || ' '), false) AS hit FROM pool),
u AS (SELECT (max(t0) > 0)::INT AS a0, (max(t1) > 0)::INT AS a1, (max(t2) > 0)::INT AS a2 FROM t),
scored AS (SELECT t.*, round(greatest(0.0, 1 - distance), 6) AS semantic, CASE WHEN hit THEN 1 ELSE 2 END AS cap,
 round(greatest(0.0, 1 - distance) * 0.62 + ({POP}) * 0.16 + ({RATING}) * 0.08 + (CASE WHEN a0 + a1 + a2 > 0 THEN (t0 * a0 + t1 * a1 + t2 * a2) / (a0 + a1 + a2) ELSE 0.0 END) * 0.14 - CASE WHEN hit THEN 0.14 ELSE 0.0 END, 6) AS score
 FROM t, u WHERE NOT (contains({_TEXT}, ' aquatic ') OR {strength('aquatic', 'traits')} > 0)),
l AS (SELECT *, row_number() OVER (PARTITION BY label_norm ORDER BY score DESC, perfume_id) AS r1 FROM scored),
b AS (SELECT *, row_number() OVER (PARTITION BY brand_norm ORDER BY score DESC, perfume_id) AS r2 FROM l WHERE r1 = 1)
SELECT perfume_id, name, brand, semantic::DOUBLE AS semantic, score::DOUBLE AS score FROM b WHERE r2 <= cap ORDER BY score DESC, perfume_id LIMIT 8"""


@query("v9_hybrid_search", _POOLED)
def hybrid_search(spark, d):
    """The whole hybrid search with a query vector (embeddings stand in for the items' vectors by id), a wanted term that no item
    answers, and a brand in the words of the query."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("perfume_id"), "embedding")
    row = vectors.orderBy("perfume_id").select("embedding").first()
    spec = search.SearchSpec(vector=tuple(row.embedding) if row else (), wanted=("musk", "amber", "office"), excluded=("aquatic",), query=_ASKED)
    return search.hybrid(items(spark, d), vectors, spec)


@query("v02_filtered_nearest", "WITH q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(1 - list_sum([a[1]::DOUBLE * a[2]::DOUBLE for a in list_zip(embedding, qe)]), 6) AS distance FROM embeddings, q WHERE label < 5 ORDER BY 1 - list_sum([a[1]::DOUBLE * a[2]::DOUBLE for a in list_zip(embedding, qe)]), vec_id LIMIT 100")
def filtered_nearest(spark, d):
    own = table(spark, d, "embeddings")
    row = own.orderBy("vec_id").select("embedding").first()
    if row is None:
        return own.select("vec_id", F.lit(0.0).alias("distance")).limit(0)
    near = vector.nearest(own, list(row.embedding), 100, where=F.col("label") < 5)
    return near.select("vec_id", six(F.col("distance"), "distance"))


@query("v04_neighbours_batch", "WITH q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, 1 - list_sum([a[1]::DOUBLE * a[2]::DOUBLE for a in list_zip(embedding, qe)]) AS dist FROM embeddings, q WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank, round(dist, 6) AS distance FROM r WHERE rank <= 10")
def neighbours_batch(spark, d):
    """Every row whose id is divisible by 20 as a query against all rows, exact, in blocks."""
    own = table(spark, d, "embeddings")
    asked = own.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.nearest_batch(own, asked, 10).select("query_id", "vec_id", "rank", six(F.col("distance"), "distance"))


@query("v05_relax", f"WITH {ITEMS}, l AS (SELECT * FROM items WHERE gender IN ('male', 'unisex')), s AS (SELECT * FROM l WHERE list_contains(seasons, 'winter') AND list_contains(times, 'day')) SELECT perfume_id, CASE WHEN perfume_id IN (SELECT perfume_id FROM s) THEN 0 ELSE 1 END AS tier FROM l WHERE perfume_id IN (SELECT perfume_id FROM s) OR (SELECT count(*) FROM s) < 20")
def relax(spark, d):
    own = items(spark, d)
    strict, loose = own.where(filters.metadata_filter("male", "winter", "day")), own.where(filters.metadata_filter("male", "winter", "day", soft=False))
    return search.relaxed(strict, loose, 20)


@query("v05_relax_scarce", f"WITH {ITEMS}, l AS (SELECT * FROM items WHERE gender IN ('male', 'unisex') AND rating >= 4.9), s AS (SELECT * FROM l WHERE list_contains(seasons, 'winter') AND list_contains(times, 'day') AND popularity >= 1000000) SELECT perfume_id, CASE WHEN perfume_id IN (SELECT perfume_id FROM s) THEN 0 ELSE 1 END AS tier FROM l WHERE perfume_id IN (SELECT perfume_id FROM s) OR (SELECT count(*) FROM s) < 20")
def relax_scarce(spark, d):
    """So few strict matches that the loose ones come too."""
    own = items(spark, d).where("rating >= 4.9")
    strict, loose = own.where(filters.metadata_filter("male", "winter", "day", min_popularity=1_000_000)), own.where(filters.metadata_filter("male", "winter", "day", soft=False))
    return search.relaxed(strict, loose, 20)


@query("v07_popular_pool", f"WITH {ITEMS}, w AS (SELECT * FROM items WHERE gender IN ('female', 'unisex') ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 4000) SELECT perfume_id, popularity FROM w WHERE list_contains(seasons, 'summer') ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 140")
def popular_pool(spark, d):
    order = (F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id"))
    window = R.top_k(items(spark, d).where(filters.metadata_filter("female")), 4000, *order)
    return R.top_k(window.where(filters.metadata_filter(season="summer")), 140, *order).select("perfume_id", "popularity")


@query("a21_retrieval_eval", f"WITH {ITEMS}, {CASES}, t AS (SELECT id, unnest(must_include_any) AS term FROM cases), f AS (SELECT perfume_id, unnest(list_distinct(list_concat(accords, notes))) AS term FROM items), h AS (SELECT id, term, count(*) AS hits FROM t JOIN f USING (term) GROUP BY 1, 2) SELECT id, count(*) AS terms_hit, sum(hits)::BIGINT AS hits FROM h GROUP BY id")
def retrieval_eval(spark, d):
    """For each evaluation case, how many of its terms any item answers and how often; the evaluation itself is a21_case_results."""
    terms = cases(spark, d).select("id", F.explode("must_include_any").alias("term"))
    postings = items(spark, d).select(F.explode(F.array_distinct(F.concat("accords", "notes"))).alias("term")).groupBy("term").agg(F.count("*").alias("hits"))
    by = terms.groupBy("id", "term").agg(F.count("*").alias("times")).join(postings, "term")
    return by.groupBy("id").agg(F.count("*").alias("terms_hit"), F.sum(F.col("hits") * F.col("times")).alias("hits"))


@query("j11_specs_by_items", f"WITH {ITEMS}, {CASES}, s AS (SELECT id, must_include_any[1] AS term, allowed_genders FROM cases WHERE len(must_include_any) > 0), f AS (SELECT perfume_id, gender, unnest(list_distinct(list_concat(accords, notes))) AS term FROM items) SELECT id, count(*) AS matches FROM s JOIN f USING (term) WHERE coalesce(len(allowed_genders), 0) = 0 OR list_contains(allowed_genders, gender) GROUP BY id")
def specs_by_items(spark, d):
    """Many specifications against all items: an equality join on the first wanted term, with items counted by term and gender first; j11_specs_all_conditions has the rest."""
    specs = cases(spark, d).where(F.size("must_include_any") > 0).select("id", F.element_at("must_include_any", 1).alias("term"), "allowed_genders")
    postings = items(spark, d).select("gender", F.explode(F.array_distinct(F.concat("accords", "notes"))).alias("term")).groupBy("term", "gender").agg(F.count("*").alias("n"))
    fit = (F.coalesce(F.size("allowed_genders"), F.lit(0)) <= 0) | F.array_contains("allowed_genders", F.col("gender"))
    return specs.join(postings, "term").where(fit).groupBy("id").agg(F.sum("n").alias("matches"))
