"""Specifications, answers and contexts for generated records, answer rules, and the remaining scores and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redolent.functions.text import fold
from redolent.operators import catalog as C
from redolent.operators import conversations as V
from redolent.operators import evaluate, resolve, scoring, vector
from redolent.operators import relational as R
from redolent.plans import search
from redolent.queries.common import CASES, EDGES, FOLD, ITEMS, PAIRS, PLAIN, cases, edges, items, pairs, plain_items, query, six
from redolent.queries.conversations import CARDS
from redolent.queries.search import POP, RATING, sim, strength
from redolent.session import materialize, table

_DOT = "list_sum([a[1]::DOUBLE * a[2]::DOUBLE for a in list_zip(e.embedding, q.qe)])"
_Q = "q AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _first_vector(spark, d):
    row = table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in (row.embedding if row else [])])


@query("m07_blended_modes", f"WITH {ITEMS}, {_Q}, s AS (SELECT i.perfume_id, greatest(0.0, {_DOT}) AS s, {POP} AS p, {RATING} AS r FROM items i JOIN embeddings e ON e.vec_id = i.perfume_id, q) SELECT perfume_id, " + ", ".join(f"round(s * {w[0]} + p * {w[1]} + r * {w[2]}, 6) AS {m}" for m, w in scoring.MODE_WEIGHTS.items()) + " FROM s")
def blended_modes(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("perfume_id"), "embedding")
    own = plain_items(spark, d).join(v, "perfume_id")
    s = vector.semantic(1 - vector.dot(F.col("embedding"), _first_vector(spark, d)))
    p, r = scoring.popularity_score(F.col("popularity")), scoring.rating_score(scoring.shrunk_rating(F.col("rating"), F.col("popularity")))
    return own.select("perfume_id", *[six(scoring.blended(s, p, r, F.lit(0.0), m), m) for m in scoring.MODE_WEIGHTS])


@query("m08_blended_fixed", f"WITH {ITEMS}, {_Q}, s AS (SELECT i.perfume_id, greatest(0.0, {_DOT}) AS s, {POP} AS p, {RATING} AS r, list_contains(seasons, 'winter') AS w, gender IN ('male', 'unisex') AS g FROM items i JOIN embeddings e ON e.vec_id = i.perfume_id, q) SELECT perfume_id, round(s * 0.66 + p * 0.16 + r * 0.10 + CASE WHEN w THEN 0.04 ELSE 0.0 END + CASE WHEN g THEN 0.04 ELSE 0.0 END, 6) AS score FROM s")
def blended_fixed(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("perfume_id"), "embedding")
    own = items(spark, d).join(v, "perfume_id")
    s = vector.semantic(1 - vector.dot(F.col("embedding"), _first_vector(spark, d)))
    p, r = scoring.popularity_score(F.col("popularity")), scoring.rating_score(scoring.shrunk_rating(F.col("rating"), F.col("popularity")))
    soft = F.when(F.array_contains("seasons", "winter"), 0.04).otherwise(0.0) + F.when(F.col("gender").isin("male", "unisex"), 0.04).otherwise(0.0)
    return own.select("perfume_id", six(s * 0.66 + p * 0.16 + r * 0.10 + soft, "score"))


@query("v03_rescored_popular", f"WITH {PLAIN}, {_Q}, t AS (SELECT perfume_id FROM items ORDER BY popularity DESC, rating DESC NULLS LAST, perfume_id LIMIT 200) SELECT perfume_id, round({_DOT}, 6) AS similarity FROM t JOIN embeddings e ON e.vec_id = perfume_id, q")
def rescored_popular(spark, d):
    own = R.top_k(plain_items(spark, d), 200, F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")).select("perfume_id")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("perfume_id"), "embedding")
    return own.join(v, "perfume_id").select("perfume_id", six(vector.dot(F.col("embedding"), _first_vector(spark, d)), "similarity"))


@query("v08_semantic_clamp", f"WITH {_Q} SELECT e.vec_id, round(greatest(0.0, {_DOT}), 6) AS semantic FROM embeddings e, q")
def semantic_clamp(spark, d):
    own = table(spark, d, "embeddings")
    return own.select("vec_id", six(vector.semantic(1 - vector.dot(F.col("embedding"), _first_vector(spark, d))), "semantic"))


@query("v11_supplement", f"WITH {ITEMS}, {EDGES}, g AS (SELECT target_id AS perfume_id, 0 AS priority, up_votes::DOUBLE AS score FROM edges JOIN items ON perfume_id = target_id WHERE source_id = 1), m AS (SELECT perfume_id, 1 AS priority, popularity::DOUBLE AS score FROM items ORDER BY popularity DESC, perfume_id LIMIT 50), u AS (SELECT *, row_number() OVER (PARTITION BY perfume_id ORDER BY priority) AS rn FROM (FROM g UNION ALL FROM m)) SELECT perfume_id, score FROM u WHERE rn = 1 ORDER BY priority, score DESC, perfume_id LIMIT 20")
def supplement(spark, d):
    own = plain_items(spark, d)
    found = edges(spark, d).where("source_id = 1").join(own, F.col("target_id") == F.col("perfume_id"), "left_semi").select(F.col("target_id").alias("perfume_id"), F.col("up_votes").cast("double").alias("score"))
    more = R.top_k(own, 50, F.col("popularity").desc(), F.col("perfume_id")).select("perfume_id", F.col("popularity").cast("double").alias("score"))
    return search.supplemented(found, more, 20).select("perfume_id", "score")


@query("m06_wanted_score", f"WITH {ITEMS}, t AS (SELECT perfume_id, list_concat(accords, notes) AS traits FROM items) SELECT perfume_id, round((({strength('musk', 'traits')})::DOUBLE + {strength('white floral', 'traits')} + {strength('vanilla', 'traits')}) / 3, 6) AS wanted FROM t")
def wanted_score(spark, d):
    return items(spark, d).select("perfume_id", six(scoring.wanted_score(["musk", "white floral", "vanilla"], F.concat("accords", "notes")), "wanted"))


@query("m13_soft_score", f"WITH {ITEMS} SELECT perfume_id, (CASE WHEN list_contains(seasons, 'summer') THEN 2 ELSE 0 END + 3 * len([x for x in ['citrus', 'aquatic'] if list_contains(accords, x)]) + 3 * len([x for x in ['bergamot', 'lemon'] if list_contains(notes, x)]))::INT AS score FROM items")
def soft_score(spark, d):
    hits = lambda f, terms: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(f, t)))
    return items(spark, d).select("perfume_id", (F.when(F.array_contains("seasons", "summer"), 2).otherwise(0) + 3 * hits("accords", ("citrus", "aquatic")) + 3 * hits("notes", ("bergamot", "lemon"))).alias("score"))


@query("m15_resolution_score")
def resolution_score(spark, d):
    """The best item of each reference by score, 0.6 at least, among all that share a word of their name or have their brand
    (sequence ratios have no SQL counterpart).

    Distinct hints meet distinct pairs of name and brand, of which only the most popular item can win, in blocks."""
    refs = cases(spark, d).where("trim(expected_resolved_reference) <> ''").select("id", fold(F.col("expected_resolved_reference")).alias("t")).where("t <> ''")
    name, brand = resolve.split_hint(F.col("t"))
    hints = resolve.with_core(refs.select("t").distinct().select("t", name.alias("hint"), brand.alias("brand_hint")), "hint", "_h")
    own = plain_items(spark, d).where("name_norm <> ''").groupBy("name_norm", "brand_norm").agg(F.max(F.struct("popularity", (-F.col("perfume_id")).alias("minus"))).alias("p"))
    own = resolve.with_core(own.select("name_norm", "brand_norm", "p.popularity", (-F.col("p.minus")).alias("perfume_id")), "name_norm", "_n")
    keys = lambda words, house: F.filter(F.array_distinct(F.concat(F.split(words, " "), F.array_compact(F.array(F.concat(F.lit("@"), house))))), lambda w: w != "").alias("keys")
    hints, own = materialize(hints, "hints"), materialize(own, "names")
    sizes = [max(2, -(-x.count() // n)) for x, n in ((hints, 2048), (own, 65536))]
    final = resolve.score_finalists(hints.select("t", "hint", "brand_hint", keys("hint", F.col("brand_hint"))), own.select(F.col("perfume_id").alias("at"), "name_norm", "brand_norm", "popularity", keys("name_norm", F.col("brand_norm"))), *sizes)
    pairs = materialize(final.join(hints, "t").join(own, F.col("at") == F.col("perfume_id")).drop("at"), "pairs")
    scored = resolve.scored_pairs(pairs, "hint", "brand_hint").withColumn("score", F.round("score", 6)).where(F.col("score") >= resolve.LEAST_SCORE)
    best = scored.groupBy("t").agg(F.max(F.struct("score", "popularity", (-F.col("perfume_id")).alias("minus"))).alias("b"))
    return refs.join(best, "t").select("id", (-F.col("b.minus")).alias("perfume_id"), "b.score")


@query("m19_ratio_counts", f"WITH {PAIRS}, t AS (SELECT count(*) AS n FROM pairs), r(k, pos, ratio) AS (VALUES ('L1', 1, 0.15), ('L2', 2, 0.25), ('L3', 3, 0.22), ('L4', 4, 0.2), ('L5', 5, 0.18)), b AS (SELECT k, pos, round_even(n * ratio, 0)::BIGINT AS c, n FROM r, t) SELECT k AS level, (c + CASE WHEN pos = 1 THEN n - (SELECT sum(c) FROM b) ELSE 0 END)::BIGINT AS n FROM b")
def ratio_counts(spark, d):
    """Ratios to counts: rounded half to even, the remainder to the first."""
    ratios = [("L1", 0.15), ("L2", 0.25), ("L3", 0.22), ("L4", 0.2), ("L5", 0.18)]
    n = F.col("n")
    each = [F.bround(n * F.lit(r)).cast("long") for _, r in ratios]
    rest = n - sum(each, F.lit(0))
    rows = F.array(*[F.struct(F.lit(k).alias("level"), (e + rest if i == 0 else e).alias("n")) for i, ((k, _), e) in enumerate(zip(ratios, each, strict=True))])
    return pairs(spark, d).agg(F.count("*").alias("n")).select(F.inline(rows))


@query("m21_weighted_order", f"WITH {PLAIN}, w AS (SELECT perfume_id, -ln((((perfume_id * 2654435761 + 5) % 4294967296) + 1) / 4294967297.0) / (popularity + 1) AS k FROM items) SELECT perfume_id, row_number() OVER (ORDER BY k, perfume_id) AS pos FROM w ORDER BY k, perfume_id LIMIT 100")
def weighted_order(spark, d):
    """A weighted random order without replacement: smallest exponential keys first."""
    u = (R.hash_order(F.col("perfume_id"), 5) + 1) / F.lit(4294967297.0)
    cut = R.top_k(plain_items(spark, d).select("perfume_id", (-F.log(u) / (F.col("popularity") + 1)).alias("k")), 100, F.col("k"), F.col("perfume_id"))
    return cut.withColumn("pos", F.row_number().over(Window.orderBy("k", "perfume_id"))).select("perfume_id", "pos")  # 100 rows


@query("u02_set_checks", f"WITH {ITEMS}, {EDGES} SELECT source_id, target_id, len([x for x in a.accords if NOT list_contains(b.accords, x)]) = 0 AS subset, NOT list_has_any(a.notes, b.notes) AS disjoint FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id WHERE len(a.notes) > 0 AND len(b.notes) > 0")
def set_checks(spark, d):
    own = items(spark, d).select("perfume_id", "accords", "notes").where(F.size("notes") > 0)
    both = edges(spark, d).join(own.alias("a"), F.col("source_id") == F.col("a.perfume_id")).join(own.alias("b"), F.col("target_id") == F.col("b.perfume_id"))
    return both.select("source_id", "target_id", (F.size(F.array_except("a.accords", "b.accords")) == 0).alias("subset"), (~F.arrays_overlap("a.notes", "b.notes")).alias("disjoint"))


@query("e08_canonical_brand", f"WITH {PLAIN}, {CASES}, s AS (SELECT brand_norm, trim(brand) AS b, sum(popularity) AS n FROM items WHERE coalesce(trim(brand), '') <> '' GROUP BY 1, 2), c AS (SELECT brand_norm, arg_max(b, (n, b)) AS brand FROM s GROUP BY 1), w AS (SELECT DISTINCT brand_norm, string_split(brand_norm, ' ') AS w FROM s), a0 AS (SELECT brand_norm, brand_norm AS alias FROM w UNION ALL SELECT brand_norm, array_to_string([x[1] for x in w], '') FROM w WHERE len(w) BETWEEN 2 AND 5 UNION ALL SELECT brand_norm, array_to_string([x[1] for x in w], ' ') FROM w WHERE len(w) BETWEEN 2 AND 5), a AS (SELECT alias, min(brand_norm) AS brand_norm FROM a0 WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT brand_norm) = 1), h AS (SELECT id, {FOLD.format('required_brand')} AS alias FROM cases WHERE required_brand IS NOT NULL) SELECT id, brand FROM h LEFT JOIN a USING (alias) LEFT JOIN c USING (brand_norm)")
def canonical_brand(spark, d):
    """The most popular spelling of each brand that a case asks for."""
    own = plain_items(spark, d)
    hints = cases(spark, d).where("required_brand IS NOT NULL").select("id", fold(F.col("required_brand")).alias("alias"))
    spelled = resolve.brand_totals(own).select("brand_norm", "brand")
    return hints.join(resolve.alias_index(own), "alias", "left").join(spelled, "brand_norm", "left").select("id", "brand")


@query("j02_ordered_lookup", f"WITH {EDGES}, {PLAIN}, r AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY down_votes, target_id) AS pos FROM edges) SELECT source_id, pos, perfume_id, name FROM r JOIN items ON perfume_id = target_id WHERE pos <= 3")
def ordered_lookup(spark, d):
    """Records of listed ids in the order asked for."""
    cut = R.top_k_per(edges(spark, d), ["source_id"], 3, F.col("down_votes"), F.col("target_id")).withColumnRenamed("rank", "pos")
    return cut.join(plain_items(spark, d), F.col("target_id") == F.col("perfume_id")).select("source_id", "pos", "perfume_id", "name")


@query("j08_route", f"WITH {PAIRS}, q AS (SELECT sample_id, lower(regexp_replace(question, '(?is)^\\s*\\[PERFUMES\\].*?\\n\\s*\\n', '')) AS q FROM pairs WHERE question IS NOT NULL) SELECT sample_id, CASE WHEN regexp_matches(q, '^(compare|put side by side|vergleiche|compara)') THEN 'compare' WHEN regexp_matches(q, '(how .* (smells|performs|develops)|anlatır mısın|açıklar mısın)') THEN 'lookup' WHEN regexp_matches(q, '^(i own|i wear|i finished|elimde|ich besitze|je possède|tengo)') THEN 'alternatives' ELSE 'recommend' END AS route FROM q")
def route(spark, d):
    q = F.lower(F.regexp_replace("question", r"(?is)^\s*\[PERFUMES\].*?\n\s*\n", ""))
    out = F.when(F.regexp("q", F.lit("^(compare|put side by side|vergleiche|compara)")), "compare").when(F.regexp("q", F.lit("(how .* (smells|performs|develops)|anlatır mısın|açıklar mısın)")), "lookup").when(F.regexp("q", F.lit("^(i own|i wear|i finished|elimde|ich besitze|je possède|tengo)")), "alternatives").otherwise("recommend")
    return pairs(spark, d).where("question IS NOT NULL").select("sample_id", q.alias("q")).select("sample_id", out.alias("route"))


@query(
    "j13_fuzzy_brands",
    f"WITH {PLAIN}, t AS (SELECT DISTINCT brand_norm AS typed FROM items WHERE length(brand_norm) > 4), l AS (SELECT brand_id, {FOLD.format('brand')} AS listed FROM brand_list) "
    "SELECT typed, brand_id, levenshtein(typed, listed)::INT AS distance FROM t, l WHERE levenshtein(typed, listed) BETWEEN 1 AND 2",
)
def fuzzy_brands(spark, d):
    """Typed brands within two letters of a listed one, wherever the slips are."""
    typed = plain_items(spark, d).where(F.length("brand_norm") > 4).select(F.col("brand_norm").alias("typed")).distinct()
    listed = table(spark, d, "brand_list").select("brand_id", fold(F.col("brand")).alias("listed"))
    return resolve.within_edits(typed, listed, "typed", "listed").where("distance >= 1").select("typed", "brand_id", "distance")


_SPANS = f"WITH {PLAIN}, {CASES}, w AS (SELECT id, string_split({FOLD.format('query')}, ' ') AS t FROM cases WHERE query IS NOT NULL), g AS (SELECT id, i AS first, n, array_to_string(t[i:i + n - 1], ' ') AS mention FROM w, range(1, 60) p(i), range(1, 9) r(n) WHERE i + n - 1 <= len(t)), m AS (SELECT g.* FROM g JOIN (SELECT DISTINCT name_norm FROM items WHERE length(name_norm) >= 4) ON mention = name_norm)"


@query("w20_longest_mentions", _SPANS + " SELECT id, first, mention FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.id = m.id AND o.n > m.n AND o.first <= m.first AND o.first + o.n >= m.first + m.n)")
def longest_mentions(spark, d):
    """Mentions of names in questions, less those inside a longer one.

    Names are met by a semi join, so that no windows are broadcast. Of the mentions of a question in order, the longer first
    where two begin at one word, one is inside another if an earlier one ends no sooner than it.
    """
    own = cases(spark, d).where("query IS NOT NULL").select("id", F.split(fold(F.col("query")), " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size("w") - i + 1)), lambda n: F.struct(i.alias("first"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("mention")))))
    names = plain_items(spark, d).where(F.length("name_norm") >= 4).select(F.col("name_norm").alias("mention")).distinct()
    m = own.select("id", F.inline(spans)).join(names, "mention", "left_semi").withColumn("_end", F.col("first") + F.col("n"))
    before = Window.partitionBy("id").orderBy("first", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_upto", F.max("_end").over(before)).where("_upto IS NULL OR _upto < _end")
    return m.select("id", F.col("first").cast("long").alias("first"), "mention")


@query("w12_review_order", f"WITH {PAIRS}, p AS (SELECT sample_id, CASE WHEN coalesce(trim(answer), '') = '' THEN 0 WHEN length(answer) < 60 THEN 1 ELSE 2 END AS priority FROM pairs) SELECT sample_id, priority::INT AS priority FROM p ORDER BY priority, sample_id LIMIT 50")
def review_order(spark, d):
    priority = F.when(F.coalesce(F.trim("answer"), F.lit("")) == "", 0).when(F.length("answer") < 60, 1).otherwise(2)
    return R.top_k(pairs(spark, d).select("sample_id", priority.alias("priority")), 50, F.col("priority"), F.col("sample_id"))


@query("f16_constraints", f"WITH {CASES}, q AS (SELECT id, lower(query) AS q FROM cases WHERE query IS NOT NULL) SELECT id, nullif(regexp_extract(q, '\\b(spring|summer|autumn|winter)\\b', 1), '') AS season, CASE WHEN regexp_matches(q, '\\bfor men\\b|\\bmasculine\\b') THEN 'male' WHEN regexp_matches(q, '\\bfor women\\b|\\bfeminine\\b') THEN 'female' END AS gender, array_to_string(regexp_extract_all(q, '\\b(?:no|without|minus the|less) (\\w+)', 1), ',') AS excluded FROM q")
def constraints(spark, d):
    """What a question asks for in so many words."""
    q = F.col("q")
    gender = F.when(F.regexp(q, F.lit(r"\bfor men\b|\bmasculine\b")), "male").when(F.regexp(q, F.lit(r"\bfor women\b|\bfeminine\b")), "female")
    own = cases(spark, d).where("query IS NOT NULL").select("id", F.lower("query").alias("q"))
    return own.select("id", F.nullif(F.regexp_extract(q, r"\b(spring|summer|autumn|winter)\b", 1), F.lit("")).alias("season"), gender.alias("gender"), F.array_join(F.regexp_extract_all(q, F.lit(r"\b(?:no|without|minus the|less) (\w+)"), 1), ",").alias("excluded"))


@query("r05_answer_rules", f"WITH {PAIRS}, l AS (SELECT sample_id, answer, [x for x in string_split(answer, chr(10)) if trim(x) <> ''] AS lines FROM pairs WHERE answer IS NOT NULL) SELECT sample_id, concat_ws(',', CASE WHEN len(lines) <> list_unique(lines) THEN 'repeated_line' END, CASE WHEN regexp_matches(answer, '(?i)perfume_id|label_norm|\\[PERFUMES\\]') THEN 'internal_label' END, CASE WHEN length(answer) > 900 THEN 'too_long' END) AS failures FROM l")
def answer_rules(spark, d):
    """The rules each answer breaks, by name."""
    lines = F.filter(F.split("answer", "\n"), lambda x: F.trim(x) != "")
    rules = {"repeated_line": F.size(lines) != F.size(F.array_distinct(lines)), "internal_label": F.regexp("answer", F.lit(r"(?i)perfume_id|label_norm|\[PERFUMES\]")), "too_long": F.length("answer") > 900}
    return pairs(spark, d).where("answer IS NOT NULL").select("sample_id", F.array_join(V.failures(rules), ",").alias("failures"))


@query("r07_grounding", f"WITH {PAIRS}, c AS (SELECT sample_id, answer, [lower(trim(regexp_extract(x, '(?i)(?:^|\\|)\\s*name\\s*:\\s*([^|]*)', 1))) for x in string_split({CARDS}, chr(10)) if trim(x) <> ''] AS names FROM pairs WHERE question ILIKE '[PERFUMES]%' AND answer IS NOT NULL), i AS (SELECT sample_id, names, [lower(trim(regexp_extract(x, '^(.*?) by ', 1))) for x in regexp_extract_all(answer, '(?m)^\\s*\\d+[.)]\\s*(.+)$', 1)] AS items FROM c) SELECT sample_id, len(items)::INT AS items, len([x for x in items if NOT list_contains(names, x)])::INT AS unsupported FROM i")
def grounding(spark, d):
    """Listed items of an answer that the cards it was given don't have."""
    own = pairs(spark, d).where("question ILIKE '[PERFUMES]%' AND answer IS NOT NULL")
    names = F.transform(C.context_cards(F.col("question")), lambda x: F.lower(C.card_field(x, "name")))
    listed = F.transform(V.numbered_items(F.col("answer")), lambda x: F.lower(F.trim(F.regexp_extract(x, r"^(.*?) by ", 1))))
    own = own.select("sample_id", names.alias("names"), listed.alias("items"))
    return own.select("sample_id", F.size("items").alias("items"), F.size(F.filter("items", lambda x: ~F.array_contains(F.col("names"), x))).alias("unsupported"))


@query("r18_case_difficulty", f"WITH {CASES} SELECT id, CASE WHEN exclude_exact_reference THEN 'similarity' WHEN required_brand IS NOT NULL THEN 'brand' WHEN len(must_exclude) > 0 THEN 'avoidance' ELSE 'vibe' END AS category, (coalesce(len(must_include_any), 0) + 2 * coalesce(len(must_exclude), 0) + CASE WHEN required_brand IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN expected_season IS NOT NULL THEN 1 ELSE 0 END)::INT AS points FROM cases")
def case_difficulty(spark, d):
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    category = F.when(F.col("exclude_exact_reference"), "similarity").when(F.col("required_brand").isNotNull(), "brand").when(n("must_exclude") > 0, "avoidance").otherwise("vibe")
    points = n("must_include_any") + 2 * n("must_exclude") + F.when(F.col("required_brand").isNotNull(), 2).otherwise(0) + F.when(F.col("expected_season").isNotNull(), 1).otherwise(0)
    return cases(spark, d).select("id", category.alias("category"), points.alias("points"))


@query("g01_schedule", f"WITH {PAIRS}, c AS (SELECT level, count(*) AS n FROM pairs GROUP BY 1), s AS (SELECT level, unnest(range(1, n + 1)) AS idx FROM c) SELECT level, idx, 42 * 1000003 + idx AS seed FROM s")
def schedule(spark, d):
    """Category counts laid out as numbered slots with a seed each."""
    by = pairs(spark, d).groupBy("level").agg(F.count("*").alias("n"))
    return by.select("level", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("idx")).withColumn("seed", F.lit(42 * 1000003) + F.col("idx"))


@query("g05_sample_backfill", f"WITH {PAIRS}, h AS (SELECT sample_id, level, (sample_id * 2654435761 + 13) % 4294967296 AS h FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY h, sample_id) AS rn FROM h) SELECT sample_id, level FROM r ORDER BY CASE WHEN rn <= 12 THEN 0 ELSE 1 END, h, sample_id LIMIT 80")
def sample_backfill(spark, d):
    """Twelve of each level, filled up to 80 from what is left (sampling is the feature here)."""
    own = pairs(spark, d).select("sample_id", "level", R.hash_order(F.col("sample_id"), 13).alias("h"))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("h", "sample_id"))
    return own.withColumn("rn", rank).where("rn <= 80").orderBy(F.when(F.col("rn") <= 12, 0).otherwise(1), "h", "sample_id").limit(80).select("sample_id", "level")


_TOPA = "ta AS (SELECT term FROM (SELECT term, count(*) AS n FROM f GROUP BY 1) ORDER BY n DESC, term LIMIT 40)"
_FACC = "f AS (SELECT perfume_id, popularity, unnest(accords) AS term FROM items)"


@query("g07_filter_answers", f"WITH {ITEMS}, {_FACC}, {_TOPA}, r AS (SELECT term, perfume_id, row_number() OVER (PARTITION BY term ORDER BY popularity DESC, perfume_id) AS rank FROM f JOIN ta USING (term)) SELECT term, perfume_id, rank FROM r WHERE rank <= 5")
def filter_answers(spark, d):
    """One specification for each of the 40 commonest accords, all answered in one job."""
    own = items(spark, d).select("perfume_id", "popularity", F.explode("accords").alias("term"))
    top = R.top_k(own.groupBy("term").agg(F.count("*").alias("n")), 40, F.col("n").desc(), F.col("term")).select("term")
    return R.top_k_per(own.join(F.broadcast(top), "term"), ["term"], 5, F.col("popularity").desc(), F.col("perfume_id")).select("term", "perfume_id", "rank")


@query("g08_hard_negatives", f"WITH {ITEMS}, {_FACC}, {_TOPA}, pool AS (SELECT perfume_id, accords FROM items ORDER BY popularity DESC, perfume_id LIMIT 400), n AS (SELECT term, perfume_id, row_number() OVER (PARTITION BY term ORDER BY (perfume_id * 2654435761 + 17) % 4294967296, perfume_id) AS rank FROM ta, pool WHERE NOT list_contains(accords, term)) SELECT term, perfume_id, rank FROM n WHERE rank <= 5")
def hard_negatives(spark, d):
    """For each of 40 specifications five well-known items that don't satisfy it, from a pool of 400."""
    own = items(spark, d).select("perfume_id", "popularity", "accords")
    terms = own.select(F.explode("accords").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = R.top_k(terms, 40, F.col("n").desc(), F.col("term")).agg(F.collect_list("term").alias("terms"))  # 40 terms
    pool = R.top_k(own, 400, F.col("popularity").desc(), F.col("perfume_id")).select("perfume_id", "accords")
    lacking = pool.join(F.broadcast(top)).select("perfume_id", F.explode(F.array_except("terms", "accords")).alias("term"))  # one row joined
    return R.top_k_per(lacking, ["term"], 5, R.hash_order(F.col("perfume_id"), 17), F.col("perfume_id")).select("term", "perfume_id", "rank")


@query("g10_profile_answers", f"WITH {ITEMS}, {CASES}, f AS (SELECT perfume_id, popularity, unnest(list_distinct(list_concat(accords, notes))) AS term FROM items), t AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY popularity DESC, perfume_id) AS rn FROM f), c AS (SELECT DISTINCT id, unnest(must_include_any) AS term FROM cases), s AS (SELECT id, perfume_id, popularity, count(*) * 4.0 AS score FROM c JOIN t USING (term) WHERE rn <= 50 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, popularity DESC, perfume_id) AS rank FROM s) SELECT id, perfume_id, score::DOUBLE AS score, rank FROM r WHERE rank <= 3")
def profile_answers(spark, d):
    """Three answers for every case: of all items those that answer most of its terms, the best known first, in one job."""
    own = items(spark, d).select("perfume_id", "popularity", F.array_distinct(F.concat("accords", "notes")).alias("terms"))
    asked = cases(spark, d).select("id", F.array_distinct(F.array_compact("must_include_any")).alias("terms"))
    return R.most_hits(asked, own, 3).select("id", "perfume_id", (F.col("hits") * 4.0).alias("score"), "rank")


@query("a21_case_results")
def case_results(spark, d):
    """The retrieval evaluation: 8 candidates for every case in one job, then its hits, violations and verdict.

    Candidates are the graph search of the item that the question names, then the items with most of the terms it names. The
    reference's own retriever (query analysis and vectors of the questions) isn't built.
    """
    own, every = materialize(items(spark, d), "items"), materialize(cases(spark, d), "cases")
    asked = every.where("query IS NOT NULL").select("id", F.split(fold(F.col("query")), " ").alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.size("w") - i + 1)), lambda n: F.struct(i.alias("first"), n.alias("n"), F.array_join(F.slice("w", i, n), " ").alias("mention")))))
    spans = materialize(asked.select("id", F.inline(spans)), "spans")
    names = resolve.best_item(own.where(F.length("name_norm") >= 4).select(F.col("name_norm").alias("mention"), "perfume_id", "popularity", "rating"), "mention")
    named = materialize(spans.join(names, "mention").groupBy("id").agg(F.max_by("perfume_id", F.struct("n", -F.col("first"))).alias("query_id")), "named")
    terms = own.select(F.explode(F.concat("accords", "notes")).alias("mention")).distinct()
    wanted = spans.join(terms, "mention", "left_semi").groupBy("id").agg(F.collect_set("mention").alias("terms"))
    hits = R.most_hits(wanted, own.select("perfume_id", "popularity", F.array_distinct(F.concat("accords", "notes")).alias("terms")), 8)
    near = named.join(search.similar(own, edges(spark, d)).withColumnRenamed("source_id", "query_id"), "query_id")
    both = near.select("id", "perfume_id", F.lit(0).alias("p"), "rank").unionByName(hits.select("id", "perfume_id", F.lit(1).alias("p"), "rank"))
    first = both.groupBy("id", "perfume_id").agg(F.min(F.struct("p", "rank")).alias("at"))
    found = materialize(R.top_k_per(first, ["id"], 8, F.col("at"), F.col("perfume_id")).select("id", "perfume_id"), "found")
    hints = every.where("trim(expected_resolved_reference) <> ''").select(F.col("id").alias("hint_id"), fold(F.col("expected_resolved_reference")).alias("hint_norm"))
    expected = resolve.resolve(hints, own).select(F.col("hint_id").alias("id"), F.col("perfume_id").alias("expected_id"))
    return evaluate.case_results(every, found, own, materialize(expected.join(named, "id", "full"), "resolved"))


@query("j11_specs_all_conditions")
def specs_all_conditions(spark, d):
    """Many specifications against all items with every term and condition of each; about 65,536 items and 16,384 cases meet at a time."""
    own, every = items(spark, d), cases(spark, d)
    sizes = [max(4, -(-table(spark, d, t).count() // n)) for t, n in (("retrieval_eval_cases", 16384), ("perfumes", 65536))]
    return evaluate.count_matches(every, own, sizes[0], sizes[1])


@query("t28_records", f"WITH {PLAIN} SELECT perfume_id, concat_ws(chr(10), 'Name: ' || coalesce(nullif(trim(name), ''), 'not recorded'), 'Brand: ' || coalesce(nullif(trim(brand), ''), 'not recorded'), 'Year: ' || coalesce(year::VARCHAR, 'not recorded'), 'Votes: ' || popularity) AS record FROM items")
def records(spark, d):
    line = lambda head, value: F.concat(F.lit(head), value)
    text = F.concat_ws("\n", line("Name: ", C.or_unknown(F.col("name"))), line("Brand: ", C.or_unknown(F.col("brand"))), line("Year: ", C.or_unknown(F.col("year"))), line("Votes: ", F.col("popularity").cast("string")))
    return plain_items(spark, d).select("perfume_id", text.alias("record"))


@query("t29_left_truncation", "WITH w AS (SELECT doc_id, [x for x in regexp_split_to_array(trim(text), '\\s+') if x <> ''] AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, least(len(w), 50)::INT AS kept, len(w) > 50 AS truncated, array_to_string(w[greatest(1, len(w) - 49):], ' ') AS tail FROM w")
def left_truncation(spark, d):
    """The last 50 words of a text, as training keeps the answer's end."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    own = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", words.alias("w"))
    tail = F.slice("w", F.greatest(F.lit(1), F.size("w") - 49), F.lit(50))
    return own.select("doc_id", F.least(F.size("w"), F.lit(50)).alias("kept"), (F.size("w") > 50).alias("truncated"), F.array_join(tail, " ").alias("tail"))


@query("a25_repeats_by_source", f"WITH {PAIRS}, g AS (SELECT source, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS k, count(*) AS n FROM pairs WHERE question IS NOT NULL GROUP BY 1, 2) SELECT source, sum(n - 1)::BIGINT AS repeats FROM g GROUP BY source")
def repeats_by_source(spark, d):
    from redolent.functions.text import ws_lower

    by = pairs(spark, d).where("question IS NOT NULL").groupBy("source", ws_lower(F.col("question")).alias("k")).agg(F.count("*").alias("n"))
    return by.groupBy("source").agg(F.sum(F.col("n") - 1).alias("repeats"))


@query("a12_neighbour_agreement", f"WITH {ITEMS}, {EDGES}, s AS (SELECT source_id, {sim('a.accords', 'b.accords')} AS x FROM edges JOIN items a ON a.perfume_id = source_id JOIN items b ON b.perfume_id = target_id) SELECT source_id, count(*) AS n, count(*) FILTER (x < 0.2) AS unlike, round(avg(x), 12) AS mean FROM s GROUP BY source_id")
def neighbour_agreement(spark, d):
    """How many of an item's community neighbours have little in common with it."""
    own = items(spark, d).select("perfume_id", "accords")
    both = edges(spark, d).join(own.alias("a"), F.col("source_id") == F.col("a.perfume_id")).join(own.alias("b"), F.col("target_id") == F.col("b.perfume_id"))
    x = both.select("source_id", scoring.set_similarity(F.col("a.accords"), F.col("b.accords")).alias("x"))
    return x.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("x") < 0.2).alias("unlike"), F.round(F.avg("x"), 12).alias("mean"))


