"""Validation, audit, evaluation and sampling of conversation records and evaluation cases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from redolent.operators import catalog as C
from redolent.operators import conversations as V
from redolent.operators import filters
from redolent.operators import relational as R
from redolent.queries.common import CASES, FOLD, PAIRS, PLAIN, cases, pairs, plain_items, query
from redolent.session import table

CARDS = "regexp_extract(question, '(?is)^\\s*\\[PERFUMES\\]\\s*(.*?)(?:\\n\\s*\\n|\\[/PERFUMES\\]|$)', 1)"


@query("t14_context_cards", f"WITH {PAIRS}, l AS (SELECT sample_id, unnest([x for x in string_split({CARDS}, chr(10)) if trim(x) <> '']) AS line FROM pairs WHERE question ILIKE '[PERFUMES]%') SELECT sample_id, trim(regexp_extract(line, '(?i)(?:^|\\|)\\s*name\\s*:\\s*([^|]*)', 1)) AS name, trim(regexp_extract(line, '(?i)(?:^|\\|)\\s*brand\\s*:\\s*([^|]*)', 1)) AS brand FROM l")
def context_cards(spark, d):
    lines = pairs(spark, d).where("question ILIKE '[PERFUMES]%'").select("sample_id", F.explode(C.context_cards(F.col("question"))).alias("line"))
    return lines.select("sample_id", C.card_field(F.col("line"), "name").alias("name"), C.card_field(F.col("line"), "brand").alias("brand"))


@query("t15_context_block", f"WITH {PAIRS}, c AS (SELECT sample_id, [x for x in string_split({CARDS}, chr(10)) if trim(x) <> ''] AS l FROM pairs WHERE question ILIKE '[PERFUMES]%') SELECT sample_id, '[PERFUMES]' || chr(10) || array_to_string(l, chr(10)) AS context FROM c")
def context_block(spark, d):
    return pairs(spark, d).where("question ILIKE '[PERFUMES]%'").select("sample_id", C.context_block(C.context_cards(F.col("question"))).alias("context"))


@query("t20_messages", f"WITH {PAIRS} SELECT sample_id, 'system|user|model' AS roles, length(coalesce(system, '')) + length(coalesce(question, '')) + length(coalesce(answer, '')) AS chars FROM pairs")
def messages(spark, d):
    own = pairs(spark, d).select("sample_id", V.messages(F.col("system"), F.col("question"), F.col("answer")).alias("m"))
    chars = F.aggregate("m", F.lit(0), lambda a, x: a + F.coalesce(F.length(x["content"]), F.lit(0)))
    return own.select("sample_id", F.array_join(F.transform("m", lambda x: x["role"]), "|").alias("roles"), chars.alias("chars"))


@query("t21_roles", "SELECT CASE role WHEN 'assistant' THEN 'model' ELSE role END AS role, count(*) AS n FROM sample_messages GROUP BY 1")
def roles(spark, d):
    one = F.array(F.struct("role", "content"))
    return table(spark, d, "sample_messages").select(V.convert_roles(one).getItem(0)["role"].alias("role")).groupBy("role").agg(F.count("*").alias("n"))


@query("r13_record_schema", f"WITH {PAIRS} SELECT sample_id, trim(coalesce(system, '')) <> '' AND trim(coalesce(question, '')) <> '' AND trim(coalesce(answer, '')) <> '' AS valid FROM pairs")
def record_schema(spark, d):
    return pairs(spark, d).select("sample_id", V.valid_record(V.messages(F.col("system"), F.col("question"), F.col("answer"))).alias("valid"))


@query("a09_level_counts", f"WITH {PAIRS} SELECT level, source, split, count(*) AS n FROM pairs GROUP BY ROLLUP (level, source, split)")
def level_counts(spark, d):
    return pairs(spark, d).rollup("level", "source", "split").agg(F.count("*").alias("n"))


@query("a10_average_lengths", f"WITH {PAIRS} SELECT level, round(avg(length(question)), 2) AS question_chars, round(avg(length(answer)), 2) AS answer_chars FROM pairs GROUP BY level")
def average_lengths(spark, d):
    return pairs(spark, d).groupBy("level").agg(F.round(F.avg(F.length("question")), 2).alias("question_chars"), F.round(F.avg(F.length("answer")), 2).alias("answer_chars"))


@query("a07_duplicate_questions", f"WITH {PAIRS}, g AS (SELECT question, count(*) AS n FROM pairs WHERE question IS NOT NULL GROUP BY 1) SELECT coalesce(sum(n), 0)::BIGINT AS rows, count(*) AS distinct_keys, coalesce(sum(n - 1), 0)::BIGINT AS repeated_rows, count(*) FILTER (n > 1) AS repeated_groups FROM g")
def duplicate_questions(spark, d):
    return V.duplicate_stats(pairs(spark, d).where("question IS NOT NULL"), "question")


@query("a08_delivered_twice", "WITH g AS (SELECT sample_id, msg_no, count(*) AS n FROM sample_messages GROUP BY 1, 2) SELECT n AS deliveries, count(*) AS messages FROM g GROUP BY n")
def delivered_twice(spark, d):
    by = table(spark, d, "sample_messages").groupBy("sample_id", "msg_no").agg(F.count("*").alias("deliveries"))
    return by.groupBy("deliveries").agg(F.count("*").alias("messages"))


@query("a11_openings", f"WITH {PAIRS}, w AS (SELECT array_to_string(regexp_extract_all(lower(question), '([a-z'']+)', 1)[1:3], ' ') AS opening FROM pairs WHERE question IS NOT NULL), c AS (SELECT opening, count(*) AS n FROM w GROUP BY 1) SELECT opening, n FROM c ORDER BY n DESC, opening LIMIT 12")
def openings(spark, d):
    by = pairs(spark, d).where("question IS NOT NULL").select(V.opening(F.col("question"), 3).alias("opening")).groupBy("opening").agg(F.count("*").alias("n"))
    return R.top_k(by, 12, F.col("n").desc(), F.col("opening"))


@query("a11_word_stats", f"WITH {PAIRS}, w AS (SELECT source, len(regexp_extract_all(lower(question), '([a-z'']+)', 1)) AS n FROM pairs WHERE question IS NOT NULL) SELECT source, min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean FROM w GROUP BY source")
def word_stats(spark, d):
    n = F.size(V.words(F.col("question")))
    return pairs(spark, d).where("question IS NOT NULL").groupBy("source").agg(F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.round(F.avg(n), 4).alias("mean"))


_OPENINGS = " OR ".join("starts_with(o, '{}')".format(x.replace("'", "''")) for x in filters.BANNED_OPENINGS)
_TALK = " OR ".join(f"contains(q, '{x}')" for x in filters.OWN_TALK)


@query(
    "f22_bad_questions",
    f"WITH {PAIRS}, q AS (SELECT sample_id, question, lower(question) AS q, array_to_string(regexp_extract_all(translate(lower(question), '’', chr(39)), '([a-z\\x27]+)', 1)[1:5], ' ') AS o FROM pairs) "
    "SELECT sample_id FROM q WHERE length(question) < 25 OR len([x for x in regexp_split_to_array(trim(question), '\\s+') if x <> '']) < 5 "
    f"OR regexp_matches(question, '[\\x27\",:]$') OR {_TALK} OR starts_with(q, 'think ') OR {_OPENINGS}",
)
def bad_questions(spark, d):
    return pairs(spark, d).where(filters.bad_question(F.col("question"))).select("sample_id")


@query("f20_unsupported", f"WITH {PAIRS} SELECT sample_id, CASE " + " ".join(f"WHEN regexp_matches(question, '{p}', 'i') THEN '{k}'" for k, p in filters.UNSUPPORTED) + " END AS family FROM pairs")
def unsupported(spark, d):
    return pairs(spark, d).select("sample_id", filters.unsupported_intent(F.col("question")).alias("family"))


@query(
    "f21_exact_lookup",
    f"WITH {PAIRS}, t AS (SELECT sample_id, string_split(question, '[/PERFUMES]')[-1] AS tail FROM pairs WHERE question IS NOT NULL) SELECT sample_id FROM t WHERE "
    + " OR ".join(f"regexp_matches(tail, '{p}', 'i')" for p in filters.EXACT_LOOKUP),
)
def exact_lookups(spark, d):
    """Questions that ask for a record's fields as they stand."""
    return pairs(spark, d).where(filters.exact_lookup(F.col("question"))).select("sample_id")


@query("f23_first_seen", f"WITH {PAIRS}, k AS (SELECT sample_id, lower(trim(regexp_replace(question, '\\s+', ' ', 'g'))) AS key FROM pairs WHERE question IS NOT NULL) SELECT min(sample_id) AS sample_id FROM k GROUP BY key")
def first_seen(spark, d):
    from redolent.functions.text import ws_lower

    return pairs(spark, d).where("question IS NOT NULL").groupBy(ws_lower(F.col("question")).alias("k")).agg(F.min("sample_id").alias("sample_id")).select("sample_id")


@query("r01_answer_items", f"WITH {PAIRS}, l AS (SELECT sample_id, unnest(regexp_extract_all(answer, '(?m)^\\s*\\d+[.)]\\s*(.+)$', 1)) AS x FROM pairs) SELECT sample_id, trim(x) AS item FROM l")
def answer_items(spark, d):
    return pairs(spark, d).select("sample_id", F.explode(V.numbered_items(F.col("answer"))).alias("item"))


@query("r02_min_votes_asked", f"WITH {PAIRS} SELECT sample_id, try_cast(regexp_extract(question, '(?i)(?:with more than|mehr als|plus de|más de)\\s+(\\d+)\\s+(?:votes|Stimmen|votos)', 1) AS INT) AS votes FROM pairs WHERE regexp_matches(question, '(?i)(?:with more than|mehr als|plus de|más de)\\s+\\d+\\s+(?:votes|Stimmen|votos)')")
def min_votes_asked(spark, d):
    pattern = r"(?i)(?:with more than|mehr als|plus de|más de)\s+(\d+)\s+(?:votes|Stimmen|votos)"
    own = pairs(spark, d).where(F.regexp("question", F.lit(pattern)))
    return own.select("sample_id", F.regexp_extract("question", pattern, 1).cast("int").alias("votes"))


@query("r03_rule_violations", f"WITH {PAIRS} SELECT 'no_answer' AS rule, count(*) FILTER (coalesce(trim(answer), '') = '') AS violations FROM pairs UNION ALL SELECT 'short_answer', count(*) FILTER (length(answer) < 40) FROM pairs UNION ALL SELECT 'leaked_block', count(*) FILTER (contains(answer, '[PERFUMES]')) FROM pairs UNION ALL SELECT 'no_question', count(*) FILTER (question IS NULL) FROM pairs UNION ALL SELECT 'too_many_items', count(*) FILTER (len(regexp_extract_all(answer, '(?m)^\\s*\\d+[.)]\\s*(.+)$', 1)) > 4) FROM pairs")
def rule_violations(spark, d):
    a = F.col("answer")
    rules = {"no_answer": F.coalesce(F.trim(a), F.lit("")) == "", "short_answer": F.length(a) < 40, "leaked_block": a.contains("[PERFUMES]"), "no_question": F.col("question").isNull(), "too_many_items": F.size(V.numbered_items(a)) > 4}
    return V.violations(pairs(spark, d), rules)


@query("r04_context_subset", f"WITH {PAIRS}, q AS (SELECT sample_id, answer, [lower(trim(regexp_extract(x, '(?i)(?:^|\\|)\\s*name\\s*:\\s*([^|]*)', 1))) for x in string_split({CARDS}, chr(10)) if trim(x) <> ''] AS names FROM pairs WHERE question ILIKE '[PERFUMES]%' AND answer IS NOT NULL) SELECT sample_id, len([n for n in names if contains(lower(answer), n)])::INT AS mentioned, len(names)::INT AS given FROM q")
def context_subset(spark, d):
    """How many of the given cards' names an answer mentions."""
    own = pairs(spark, d).where("question ILIKE '[PERFUMES]%' AND answer IS NOT NULL")
    names = F.transform(C.context_cards(F.col("question")), lambda x: F.lower(C.card_field(x, "name")))
    own = own.select("sample_id", F.lower("answer").alias("a"), names.alias("names"))
    return own.select("sample_id", F.size(F.filter("names", lambda n: F.contains(F.col("a"), n))).alias("mentioned"), F.size("names").alias("given"))


def _found(pattern: str) -> str:
    return f"[lower(trim(x)) for x in regexp_extract_all(answer, '{pattern}', 1)]"


def _has(patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches(answer, '{p}')" for p in patterns) + ")"


_OUTSIDE = "len(cards) > 0 AND len([n for n in names if NOT list_contains(cards, n)]) > 0"
_PICKED = "(pick = '' OR NOT list_contains(items, pick))"
_RULES = {
    "L3": {"list_format": "(len(names) = 0 OR len(names) <> len([x for x in string_split(answer, chr(10)) if trim(x) <> '']))", "rag_subset": _OUTSIDE},
    "L4": {"format": "(len(items) = 0 OR NOT contains(answer, 'Why:'))", "rag_subset": _OUTSIDE, "best_pick": _PICKED, "unsupported_claim": _has(V.UNSUPPORTED_CLAIMS), "internal_label": _has(V.INTERNAL_LABELS), "repetitive_phrase": _has(V.WORN_PHRASES)},
    "L5": {"format": "(len(items) = 0 OR NOT contains(answer, 'Why:'))", "rag_subset": _OUTSIDE, "best_pick": _PICKED, "unsupported_claim": _has(V.UNSUPPORTED_CLAIMS), "profile_block": "(NOT contains(question, '[USER PROFILE]') OR NOT contains(question, '[/USER PROFILE]'))"},
}


def _rule_sql(level: str) -> str:
    card = "lower(trim(regexp_extract(x, '(?i)(?:^|\\|)\\s*name\\s*:\\s*([^|]*)', 1)))"
    cards = f"CASE WHEN question ILIKE '[PERFUMES]%' THEN [{card} for x in string_split({CARDS}, chr(10)) if trim(x) <> ''] ELSE [] END"
    own = f"r AS (SELECT question, answer, {_found(V.NAME_LINE)} AS names, {_found(V.ITEM_LINE)} AS items, lower(trim(regexp_extract(answer, '{V.PICK_LINE}', 1))) AS pick, {cards} AS cards FROM pairs WHERE level = '{level}' AND question IS NOT NULL AND answer IS NOT NULL)"
    return f"WITH {PAIRS}, {own} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM r" for k, c in _RULES[level].items())


def _level_rules(spark, d, level: str):
    own = pairs(spark, d).where(F.col("level") == level).where("question IS NOT NULL AND answer IS NOT NULL")
    cards = F.transform(C.context_cards(F.col("question")), lambda x: F.lower(C.card_field(x, "name")))
    own = own.select("question", "answer", F.when(F.expr("question ILIKE '[PERFUMES]%'"), cards).otherwise(F.array().cast("array<string>")).alias("cards"))
    return V.violations(own, V.answer_rules(level, F.col("question"), F.col("answer"), F.col("cards")))


@query("r04_l3_rules", _rule_sql("L3"))
def l3_rules(spark, d):
    """How many answers of level 3 break each of its rules."""
    return _level_rules(spark, d, "L3")


@query("r05_l4_rules", _rule_sql("L4"))
def l4_rules(spark, d):
    """How many answers of level 4 break each of its rules."""
    return _level_rules(spark, d, "L4")


@query("r06_l5_rules", _rule_sql("L5"))
def l5_rules(spark, d):
    """How many answers of level 5 break each of its rules."""
    return _level_rules(spark, d, "L5")


@query("r12_marker_language", f"WITH {PAIRS}, t AS (SELECT sample_id, lower(question) AS q, regexp_split_to_array(lower(question), '[^a-zçğıöşüâîû'']+') AS w FROM pairs WHERE question IS NOT NULL) SELECT sample_id, CASE WHEN len([x for x in w if list_contains(string_split('{' '.join(V.TR_MARKERS)}', ' '), x)]) + length(regexp_replace(q, '[^çğış]', '', 'g')) > len([x for x in w if list_contains(string_split('{' '.join(V.EN_MARKERS)}', ' '), x)]) THEN 'tr' ELSE 'en' END AS lang FROM t")
def marker_language(spark, d):
    return pairs(spark, d).where("question IS NOT NULL").select("sample_id", V.marker_language(F.col("question")).alias("lang"))


@query("r14_case_set", f"WITH {CASES} SELECT 'missing_query' AS rule, count(*) FILTER (coalesce(trim(query), '') = '') AS violations FROM cases UNION ALL SELECT 'no_terms', count(*) FILTER (len(must_include_any) = 0 OR must_include_any IS NULL) FROM cases UNION ALL SELECT 'bad_season', count(*) FILTER (expected_season NOT IN ('spring', 'summer', 'autumn', 'winter')) FROM cases UNION ALL SELECT 'repeated_query', (SELECT count(*) FROM (SELECT lower(query) FROM cases WHERE query IS NOT NULL GROUP BY 1 HAVING count(*) > 1))")
def case_set(spark, d):
    own = cases(spark, d)
    rules = {"missing_query": F.coalesce(F.trim("query"), F.lit("")) == "", "no_terms": (F.size("must_include_any") == 0) | F.col("must_include_any").isNull(), "bad_season": ~F.col("expected_season").isin("spring", "summer", "autumn", "winter")}
    again = own.where("query IS NOT NULL").groupBy(F.lower("query").alias("q")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    return V.violations(own, rules).unionByName(again.select(F.lit("repeated_query").alias("rule"), "violations"))


_CHECKS = "season AS (SELECT id, expected_season IS NOT NULL AS has_season, expected_season IN ('autumn', 'winter') AS cold, required_brand IS NOT NULL AS has_brand, length(required_brand) > 10 AS long_brand FROM cases)"


@query("r15_case_checks", f"WITH {CASES}, {_CHECKS} SELECT id, concat_ws(',', CASE WHEN has_brand THEN 'brand=' || long_brand END, CASE WHEN has_season THEN 'season=' || cold END) AS checks FROM season")
def case_checks(spark, d):
    """Named checks of each case; one that doesn't apply is absent."""
    own = cases(spark, d).select("id", V.checks({"brand": F.length("required_brand") > 10, "season": F.col("expected_season").isin("autumn", "winter")}).alias("m"))
    return own.select("id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("checks"))


@query("a16_applicable_rate", f"WITH {CASES}, {_CHECKS} SELECT round(coalesce(count(*) FILTER ((has_season OR has_brand) AND coalesce(cold, true) AND coalesce(long_brand, true)) / nullif(count(*) FILTER (has_season OR has_brand), 0), 1.0), 6) AS rate FROM season")
def applicable_rate(spark, d):
    own = cases(spark, d).select(V.checks({"brand": F.length("required_brand") > 10, "season": F.col("expected_season").isin("autumn", "winter")}).alias("m"))
    return own.agg(F.round(V.applicable_rate(own, "m", ["brand", "season"]), 6).alias("rate"))


@query("a13_evaluation_summary", f"WITH {CASES} SELECT count(*) AS cases, count(*) FILTER (expected_resolved_reference IS NOT NULL) AS with_reference, round(avg(CASE WHEN expected_season IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS season_rate, round(avg(min_hits_in_top_k), 6) AS mean_hits FROM cases")
def evaluation_summary(spark, d):
    return cases(spark, d).agg(F.count("*").alias("cases"), F.count("expected_resolved_reference").alias("with_reference"), F.round(F.avg(F.when(F.col("expected_season").isNotNull(), 1.0).otherwise(0.0)), 6).alias("season_rate"), F.round(F.avg("min_hits_in_top_k"), 6).alias("mean_hits"))


@query("a14_by_key", f"WITH {CASES} SELECT coalesce(expected_season, 'unknown') AS season, count(*) AS n, count(*) FILTER (allow_low_popularity) AS low FROM cases GROUP BY 1")
def by_key(spark, d):
    return cases(spark, d).groupBy(F.coalesce("expected_season", F.lit("unknown")).alias("season")).agg(F.count("*").alias("n"), F.count_if("allow_low_popularity").alias("low"))


@query("a15_by_tag", f"WITH {CASES}, t AS (SELECT unnest(CASE WHEN coalesce(len(allowed_genders), 0) = 0 THEN ['untagged'] ELSE allowed_genders END) AS tag FROM cases) SELECT tag, count(*) AS n FROM t GROUP BY tag")
def by_tag(spark, d):
    tags = F.when(F.coalesce(F.size("allowed_genders"), F.lit(0)) <= 0, F.array(F.lit("untagged"))).otherwise(F.col("allowed_genders"))
    return cases(spark, d).select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("a19_gates", f"WITH {PAIRS}, m AS (SELECT count(*) FILTER (coalesce(trim(answer), '') = '') / count(*) AS empty_rate, avg(length(answer)) AS mean_chars, count(*)::DOUBLE AS records FROM pairs) SELECT 'empty_rate' AS metric, round(empty_rate, 6) AS value, '<=' AS op, 0.05::DOUBLE AS threshold, empty_rate <= 0.05 AS passed FROM m UNION ALL SELECT 'mean_chars', round(mean_chars, 6), '>=', 100.0, mean_chars >= 100 FROM m UNION ALL SELECT 'records', records, '>=', 1000000000.0, records >= 1000000000 FROM m")
def gates(spark, d):
    empty = F.count_if(F.coalesce(F.trim("answer"), F.lit("")) == "") / F.count("*")
    metrics = pairs(spark, d).agg(empty.alias("empty_rate"), F.avg(F.length("answer")).alias("mean_chars"), F.count("*").alias("records"))
    out = V.gates(metrics, {"empty_rate": ("<=", 0.05), "mean_chars": (">=", 100.0), "records": (">=", 1_000_000_000.0)})
    return out.withColumn("value", F.round("value", 6))


@query("a20_split_counters", f"WITH {PAIRS} SELECT split, count(*) AS total, count(*) FILTER (length(answer) >= 40) AS passed, count(*) FILTER (coalesce(length(answer), 0) < 40) AS failed FROM pairs GROUP BY split")
def split_counters(spark, d):
    return pairs(spark, d).groupBy("split").agg(F.count("*").alias("total"), F.count_if(F.length("answer") >= 40).alias("passed"), F.count_if(F.coalesce(F.length("answer"), F.lit(0)) < 40).alias("failed"))


@query("a24_fingerprints", f"WITH {PAIRS}, h AS (SELECT sample_id // 1000 AS chunk, sample_id, sha256(coalesce(question, '') || chr(0) || coalesce(answer, '')) AS h FROM pairs) SELECT chunk, count(*) AS rows, sha256(string_agg(h, '' ORDER BY sample_id)) AS fingerprint FROM h GROUP BY chunk")
def fingerprints(spark, d):
    payload = F.concat(F.coalesce("question", F.lit("")), F.lit("\x00"), F.coalesce("answer", F.lit("")))
    return V.fingerprint(pairs(spark, d).withColumn("chunk", F.floor(F.col("sample_id") / 1000)), "chunk", "sample_id", payload)


@query("g03_stratified_split", f"WITH {PAIRS}, r AS (SELECT sample_id, level, row_number() OVER (PARTITION BY level ORDER BY (sample_id * 2654435761 + 7) % 4294967296, sample_id) AS rn, count(*) OVER (PARTITION BY level) AS n FROM pairs) SELECT sample_id, CASE WHEN rn <= round_even(n * 0.05, 0) THEN 'validation' ELSE 'train' END AS split FROM r")
def stratified_split(spark, d):
    return R.stratified(pairs(spark, d).select("sample_id", "level"), "level", "sample_id", 0.05, 7).select("sample_id", "split")


@query("g04_pilot_sample", f"WITH {PAIRS}, c AS (SELECT level, count(*) AS n FROM pairs GROUP BY 1), s AS (SELECT level, 100 * n / sum(n) OVER () AS exact FROM c), f AS (SELECT level, exact, floor(exact) AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, level) AS rk FROM s), q AS (SELECT level, (fl + CASE WHEN rk <= 100 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END)::BIGINT AS quota FROM f), r AS (SELECT sample_id, level, row_number() OVER (PARTITION BY level ORDER BY (sample_id * 2654435761 + 11) % 4294967296, sample_id) AS rn FROM pairs) SELECT sample_id, level FROM r JOIN q USING (level) WHERE rn <= quota")
def pilot_sample(spark, d):
    """A sample of 100 records whose levels are dealt by largest remainder (sampling is the feature here)."""
    own = pairs(spark, d).select("sample_id", "level")
    quota = R.largest_remainder(own.groupBy("level").agg(F.count("*").alias("n")), 100)
    rank = F.row_number().over(Window.partitionBy("level").orderBy(R.hash_order(F.col("sample_id"), 11), "sample_id"))
    return own.withColumn("rn", rank).where("rn <= 100").join(F.broadcast(quota), "level").where("rn <= quota").select("sample_id", "level")


@query("m20_largest_remainder", f"WITH {PAIRS}, c AS (SELECT level, count(*) AS n FROM pairs GROUP BY 1), s AS (SELECT level, 997 * n / sum(n) OVER () AS exact FROM c), f AS (SELECT level, exact, floor(exact) AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, level) AS rk FROM s) SELECT level, (fl + CASE WHEN rk <= 997 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END)::BIGINT AS quota FROM f")
def largest_remainder(spark, d):
    return R.largest_remainder(pairs(spark, d).groupBy("level").agg(F.count("*").alias("n")), 997)


@query("w11_round_robin", f"WITH {PAIRS}, p AS (SELECT sample_id, level, coalesce(length(answer), 0) < 20 AS failed FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY level, failed ORDER BY sample_id) AS turn FROM p) SELECT sample_id, level, turn FROM r ORDER BY CASE WHEN failed THEN 0 ELSE 1 END, turn, level, sample_id LIMIT 60")
def round_robin(spark, d):
    own = pairs(spark, d).select("sample_id", "level", (F.coalesce(F.length("answer"), F.lit(0)) < 20).alias("failed"))
    return R.round_robin(own, "level", F.col("failed"), 60, "sample_id").select("sample_id", "level", "turn")


@query("s09_positional_zip", f"WITH {PAIRS}, a AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS pos, level AS l FROM pairs WHERE split = 'train'), b AS (SELECT row_number() OVER (ORDER BY sample_id) - 1 AS pos, level AS r FROM pairs WHERE split <> 'train') SELECT coalesce(a.pos, b.pos) AS pos, l AS left_level, r AS right_level FROM a FULL JOIN b ON a.pos = b.pos")
def positional_zip(spark, d):
    own = pairs(spark, d).select("sample_id", "level", "split")
    both = R.positional_zip(own.where("split = 'train'"), own.where("split <> 'train'"), "sample_id", "level")
    return both.select("pos", F.col("left").alias("left_level"), F.col("right").alias("right_level"))


@query("j04_picks_known", f"WITH {PAIRS}, {PLAIN} SELECT sample_id, best_pick_id, l.name FROM pairs JOIN label_list l ON l.label_id = best_pick_id")
def picks_known(spark, d):
    own = table(spark, d, "label_list").select(F.col("label_id").alias("best_pick_id"), "name")
    return pairs(spark, d).join(F.broadcast(own), "best_pick_id").select("sample_id", "best_pick_id", "name")


@query("j07_cases_and_outputs", f"WITH {CASES}, {PLAIN}, c AS (SELECT id, lower(trim(required_brand)) AS k FROM cases WHERE required_brand IS NOT NULL), o AS (SELECT DISTINCT lower(trim(brand)) AS k FROM items WHERE brand IS NOT NULL) SELECT coalesce(c.k, o.k) AS brand, CASE WHEN c.k IS NULL THEN 'not_asked' WHEN o.k IS NULL THEN 'unknown' ELSE 'ok' END AS status, count(*) AS n FROM c FULL JOIN o ON c.k = o.k GROUP BY 1, 2")
def cases_and_outputs(spark, d):
    """Both sides' misses as rows: a full outer join on the key."""
    c = cases(spark, d).where("required_brand IS NOT NULL").select(F.lower(F.trim("required_brand")).alias("c"))
    o = plain_items(spark, d).where("brand IS NOT NULL").select(F.lower(F.trim("brand")).alias("o")).distinct()
    both = c.join(o, F.col("c") == F.col("o"), "full")
    status = F.when(F.col("c").isNull(), "not_asked").when(F.col("o").isNull(), "unknown").otherwise("ok")
    return both.groupBy(F.coalesce("c", "o").alias("brand"), status.alias("status")).agg(F.count("*").alias("n"))


@query("u06_atomic_pruning", f"WITH {CASES}, a AS (SELECT id, list_distinct([x for x in must_include_any if x IS NOT NULL]) AS t FROM cases WHERE len(must_include_any) > 0) SELECT id, len([x for x in t if NOT (contains(x, ' ') AND len([w for w in string_split(x, ' ') if NOT list_contains(t, w)]) = 0)])::INT AS kept, len(t)::INT AS given FROM a")
def atomic_pruning(spark, d):
    """Compound terms go where all of their words are wanted on their own."""
    own = cases(spark, d).where(F.size("must_include_any") > 0).select("id", F.array_distinct(F.filter("must_include_any", lambda x: x.isNotNull())).alias("t"))
    kept = F.filter("t", lambda x: ~(x.contains(" ") & F.forall(F.split(x, " "), lambda w: F.array_contains(F.col("t"), w))))
    return own.select("id", F.size(kept).alias("kept"), F.size("t").alias("given"))


@query("u03_term_sets", f"WITH {CASES} SELECT id, len(list_distinct(list_concat(must_include_any, coalesce(must_exclude, []))))::INT AS united, len([x for x in list_distinct(must_include_any) if NOT list_contains(coalesce(must_exclude, []), x)])::INT AS wanted FROM cases WHERE must_include_any IS NOT NULL")
def term_sets(spark, d):
    none = F.array().cast("array<string>")
    gone = F.coalesce("must_exclude", none)
    return cases(spark, d).where("must_include_any IS NOT NULL").select("id", F.size(F.array_union("must_include_any", gone)).alias("united"), F.size(F.array_except("must_include_any", gone)).alias("wanted"))


@query("s05_last_wins", f"WITH {CASES} SELECT id, query FROM cases")
def last_wins(spark, d):
    return cases(spark, d).select("id", "query")


@query("f18_evidence", f"WITH {CASES}, q AS (SELECT id, ' ' || {FOLD.format('query')} || ' ' AS q, must_include_any AS t FROM cases WHERE query IS NOT NULL) SELECT id, len([x for x in t if contains(q, ' ' || lower(x) || ' ')])::INT AS supported FROM q WHERE t IS NOT NULL")
def evidence(spark, d):
    """How many of a case's terms its question quotes as whole words."""
    from redolent.functions.text import fold

    own = cases(spark, d).where("query IS NOT NULL AND must_include_any IS NOT NULL").select("id", F.concat(F.lit(" "), fold(F.col("query")), F.lit(" ")).alias("q"), "must_include_any")
    return own.select("id", F.size(F.filter("must_include_any", lambda x: F.contains(F.col("q"), F.concat(F.lit(" "), F.lower(x), F.lit(" "))))).alias("supported"))


@query("f19_contradiction", f"WITH {CASES}, q AS (SELECT id, lower(query) AS q FROM cases WHERE query IS NOT NULL), n AS (SELECT id, q, regexp_extract(q, '\\b(?:no|less|minus the|not too)\\s+(\\w+)', 1) AS term FROM q) SELECT id, term, contains(q[1:instr(q, regexp_extract(q, '\\b(?:no|less|minus the|not too)\\s+\\w+')) - 1], term) AS contradicts FROM n WHERE term <> ''")
def contradiction(spark, d):
    """Whether a refused term was asked for before."""
    own = cases(spark, d).where("query IS NOT NULL").select("id", F.lower("query").alias("q"))
    own = own.select("id", "q", F.regexp_extract("q", r"\b(?:no|less|minus the|not too)\s+(\w+)", 1).alias("term"), F.regexp_extract("q", r"\b(?:no|less|minus the|not too)\s+\w+", 0).alias("hit")).where("term <> ''")
    before = F.substring(F.col("q"), F.lit(1), F.instr(F.col("q"), F.col("hit")) - 1)
    return own.select("id", "term", F.contains(before, F.col("term")).alias("contradicts"))
