"""Operators that must look at all of their input: plain Python over the same rows gives what is expected."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from redolent.functions import text
from redolent.operators import evaluate, relational, resolve
from redolent.queries import QUERIES


@pytest.mark.parametrize("most", [2, 8])
def test_most_hits_takes_items_outside_every_short_list(spark, most):
    rng = random.Random(7)
    own = [(i, 1000 - i, rng.sample("abcdef", 1)) for i in range(1, 401)] + [(900 + i, i, list("abc")) for i in range(3)] + [(950, 0, list("abcde"))]
    asked = [("x", list("cba")), ("y", list("edcba")), ("z", ["f"]), ("again", list("abc")), ("none", ["q"]), ("empty", [])]
    found = relational.most_hits(spark.createDataFrame(asked, "id string, terms array<string>"), spark.createDataFrame(own, "perfume_id long, popularity long, terms array<string>"), 3, most)
    expected = set()
    for case, terms in asked:
        hits = sorted((-len(set(terms) & set(t)), -p, i) for i, p, t in own if set(terms) & set(t))
        expected |= {(case, i, -h, rank) for rank, (h, _, i) in enumerate(hits[:3], 1)}
    assert {(r.id, r.perfume_id, r.hits, r.rank) for r in found.collect()} == expected


def test_fuzzy_stage_reaches_names_of_common_and_short_words(spark):
    rng = random.Random(3)
    names = [f"garden {''.join(rng.choices('aeioulmnrst', k=6))}" for _ in range(700)] + ["oud xi"]
    rows = [(i, n, f"Brand {i % 3}", f"brand {i % 3}", f"{n} brand {i % 3}", i % 50, 4.0) for i, n in enumerate(names, 1)]
    own = spark.createDataFrame(rows, "perfume_id long, name_norm string, brand string, brand_norm string, label_norm string, popularity long, rating double")
    hints = [("plain", "garden aelomns"), ("short", "oud x1"), ("branded", "gardne aelomns by brand 2"), ("gone", "zzzzzzzz")]
    found = {r.hint_id: (r.perfume_id, r.stage) for r in resolve.resolve(spark.createDataFrame(hints, "hint_id string, hint_norm string"), own, fuzzy=True).collect()}

    def best(text, keep):
        return max((difflib.SequenceMatcher(None, text, r[1]).ratio(), r[5], -r[0]) for r in rows if keep(r))

    assert found["plain"] == (-best("garden aelomns", lambda r: "garden" in r[1])[2], "fuzzy")
    assert found["short"] == (701, "fuzzy")
    assert found["branded"] == (-best("gardne aelomns", lambda r: r[3] == "brand 2")[2], "brand")
    assert found["gone"] == (None, "unresolved")


def test_case_results_reads_every_condition(spark):
    schema = "id string, must_include_any array<string>, term_min_hits map<string,int>, must_exclude array<string>, allowed_genders array<string>, expected_season string, expected_time string, required_brand string, excluded_brand_terms array<string>, expected_resolved_reference string, exclude_exact_reference boolean, min_hits_in_top_k int, min_popularity int, allow_low_popularity boolean"
    fields = [f.split()[0] for f in schema.split(", ")]
    case = lambda **k: tuple(k.get(f) for f in fields)
    base = {"must_include_any": ["rose"], "min_hits_in_top_k": 2}
    given = {
        "good": {"term_min_hits": {"rose": 2}, "allowed_genders": ["female"], "expected_season": "summer", "required_brand": "kurkdijan", "min_popularity": 5, "allow_low_popularity": True, "expected_resolved_reference": "Ref"},
        "excluded": {"must_exclude": ["oud"]}, "gender": {"allowed_genders": ["male"]}, "season": {"expected_season": "winter"}, "time": {"expected_time": "night"}, "low": {"min_popularity": 5},
        "brand": {"required_brand": "Zara"}, "not_brand": {"excluded_brand_terms": ["kurkdjian"]}, "terms": {"term_min_hits": {"oud": 2}}, "leak": {"expected_resolved_reference": "Ref", "exclude_exact_reference": True},
        "other": {"expected_resolved_reference": "Ref"}, "nothing": {},
    }
    own = spark.createDataFrame([(1, "Maison Kurkdjian", "female", ["summer"], ["day"], 3, ["rose"], ["oud wood"]), (2, "Maison Kurkdjian", "female", ["summer"], ["day"], 9, ["tea rose"], ["rose"])], "perfume_id long, brand string, gender string, seasons array<string>, times array<string>, popularity long, accords array<string>, notes array<string>")
    found = spark.createDataFrame([(i, p) for i in given if i != "nothing" for p in (1, 2)], "id string, perfume_id long")
    resolved = spark.createDataFrame([("good", 7, 7), ("leak", 1, 1), ("other", 7, 2)], "id string, expected_id long, query_id long")
    rows = {r.id: r for r in evaluate.case_results(spark.createDataFrame([case(id=i, **base | k) for i, k in given.items()], schema), found, own, resolved).collect()}
    assert {i for i, r in rows.items() if r.passed} == {"good"}
    assert {i: r.violations for i, r in rows.items() if r.violations} == {"excluded": 1, "gender": 2, "season": 2, "time": 2, "low": 1, "brand": 2, "not_brand": 2}
    assert (rows["good"].hit_count, rows["good"].avg_popularity, rows["terms"].term_misses, rows["leak"].leaked, rows["other"].reference_ok, rows["nothing"].candidates) == (2, 6.0, 1, True, False, 0)


def test_specifications_meet_all_items_with_every_condition(spark):
    rng = random.Random(5)
    own = [(i, rng.choice(["Maison Roux", "Zara", None]), rng.choice(["male", "female"]), rng.sample(["summer", "winter"], rng.randint(0, 2)), rng.sample(["day", "night"], 1), rng.randint(0, 200), rng.sample(["rose", "oud", "musk"], rng.randint(0, 2)), rng.sample(["oud wood", "fig", "rose"], 1)) for i in range(200)]
    schema = "id string, must_include_any array<string>, must_exclude array<string>, allowed_genders array<string>, expected_season string, expected_time string, required_brand string, excluded_brand_terms array<string>, min_popularity int, allow_low_popularity boolean"
    some = lambda v: rng.choice([None, v])
    specs = [(str(i), rng.sample(["rose", "fig", "musk", "none"], 2), some(["oud"]), some(["male"]), some("winter"), some("day"), some("roux"), some(["zara"]), some(100), some(True)) for i in range(60)]
    items = spark.createDataFrame(own, "perfume_id long, brand string, gender string, seasons array<string>, times array<string>, popularity long, accords array<string>, notes array<string>")
    found = {r.id: r.matches for r in evaluate.count_matches(spark.createDataFrame(specs, schema), items, 3, 2).collect()}

    def fits(s, p):
        terms = set(p[6] + p[7])
        brand = (p[1] or "").lower()
        return bool(terms & set(s[1])) and not any(x in t for x in s[2] or [] for t in terms) and (not s[3] or p[2] in s[3]) and (not s[4] or s[4] in p[3]) and (not s[5] or s[5] in p[4]) and (not s[6] or s[6] in brand) and not any(x in brand for x in s[7] or []) and (s[9] or not s[8] or p[5] >= s[8])

    expected = {s[0]: sum(fits(s, p) for p in own) for s in specs}
    assert found == {k: n for k, n in expected.items() if n}


def test_clean_takes_texts_of_any_language_and_spacing(spark):
    texts = ["\tÇok  güzel\u00a0KOKU!\n", "Très\u3000bien - n°5.", "\x1f A\x85b \u2028", "İstanbul \u212a", "", None, "香水 Rose "]
    plain = [re.sub(r"[^a-z0-9\s\-\.]", "", re.sub(r"\s+", " ", (x or "").lower().strip())) for x in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", text.clean_any(F.col("x")).alias("y")).collect()
    assert [r.y for r in sorted(rows)] == plain


def test_every_document_gets_a_key_and_every_card_its_lists(spark, data):
    from redolent.queries import QUERIES
    from redolent.session import table

    assert QUERIES["n1_clean_all"](spark, data).count() == table(spark, data, "documents").count()
    cards = [r.card_text for r in QUERIES["t08_cards_all"](spark, data).collect()]
    assert len(cards) == table(spark, data, "perfumes").select("perfume_id").distinct().count()
    assert all(any(f"\n{head}" in c for c in cards) for head in ("Accords: ", "Notes: ", "Seasons: ", "Longevity: ", "Sillage: "))


def test_neighbours_are_merged_for_every_request(spark):
    edges = [(1, 2, 10, 1), (1, 3, 4, 0), (2, 9, 6, 2), (3, 9, 1, 1), (3, 8, 5, 0), (77, 1, 3, 0)]
    found = relational.merged_neighbours(spark.createDataFrame([("a", 2), ("a", 3), ("b", 77), ("b", 5)], "request string, source_id long"), spark.createDataFrame(edges, "source_id long, target_id long, up_votes long, down_votes long"))
    rows = {(r.request, r.target_id, r.refs, r.up, r.down, r.mean_up) for r in found.collect()}
    assert rows == {("a", 9, 2, 7, 3, 3.5), ("a", 8, 1, 5, 0, 2.5), ("b", 1, 1, 3, 0, 1.5)}


def test_every_source_is_supplemented(spark):
    found = [(1, 5, 2.0), (77, 6, 1.0), (77, 7, 9.0), (77, 8, 3.0)]
    filled = relational.supplemented_each(spark.createDataFrame(found, "source_id long, perfume_id long, score double"), spark.createDataFrame([(5, 50.0), (6, 90.0), (9, 70.0)], "perfume_id long, score double"), 3)
    rows = {(r.source_id, r["rank"]): (r.perfume_id, r.score) for r in filled.collect()}
    assert rows == {(1, 1): (5, 2.0), (1, 2): (6, 90.0), (1, 3): (9, 70.0), (77, 1): (7, 9.0), (77, 2): (8, 3.0), (77, 3): (6, 1.0)}


def test_finalists_hold_the_best_score_of_every_hint_and_few_others(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aeilnorst", k=rng.randint(1, 6)))
    names = [(i, " ".join(["rose", word(), rng.choice(["", "edp", "edt", "sport", word()])]).strip(), rng.choice(["zara", "roux", None]), rng.randint(0, 60_000)) for i in range(400)]
    hints = [(f"t{i}", rng.choice([word(), "rose " + word(), rng.choice(names)[1][:-1], "eau de parfum rose"]), rng.choice(["zara", None, "other"])) for i in range(60)]
    own = spark.createDataFrame(names, "at long, name_norm string, brand_norm string, popularity long").withColumn("keys", F.split("name_norm", " "))
    asked = spark.createDataFrame(hints, "t string, hint string, brand_hint string").withColumn("keys", F.split("hint", " "))
    met = asked.join(own.withColumnRenamed("keys", "other"), F.arrays_overlap("keys", "other"))
    every = {(r.t, r.at): round(r.score, 6) for r in met.select("t", "at", resolve.resolution_score("hint", "brand_hint").alias("score")).collect()}
    found = {(r.t, r.at) for r in resolve.score_finalists(asked, own, 2, 3).collect()}
    best = {}
    for (t, _), score in every.items():
        best[t] = max(score, best.get(t, 0.0))
    assert {k for k, score in every.items() if score == best[k[0]] and score >= 0.6} <= found <= set(every)
    assert len(best) > 30 and len(found) < len(every) / 20


def test_blocks_of_items_are_written_once_however_many_specifications_meet_them(spark):
    items = spark.range(300).select(F.col("id").alias("perfume_id"), F.lit("Zara").alias("brand"), F.lit("male").alias("gender"), F.array(F.lit("summer")).alias("seasons"), F.array(F.lit("day")).alias("times"), (F.col("id") % 100).alias("popularity"), F.array(F.lit("rose")).alias("accords"), F.array().cast("array<string>").alias("notes"))
    none = F.lit(None).cast("string")
    specs = spark.range(40).select(F.col("id").cast("string").alias("id"), F.array(F.lit("Rose")).alias("must_include_any"), *[F.array(none).alias(c) for c in ("must_exclude", "allowed_genders", "excluded_brand_terms")], none.alias("expected_season"), none.alias("expected_time"), F.lit("zara").alias("required_brand"), F.col("id").cast("int").alias("min_popularity"), F.lit(False).alias("allow_low_popularity"))
    found = evaluate.count_matches(specs, items, 20, 2)
    assert {int(r.id): r.matches for r in found.collect()} == {i: 3 * (100 - i) for i in range(40)}
    shuffled = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in shuffled and "perfume_id" not in shuffled


def broadcasts_windows(df):
    """Whether a plan sends exploded rows to the driver: Spark takes them to be as few as the rows they are made of."""
    above = None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = None if above is not None and depth <= above else above
        if above is not None and "Generate" in line:
            return True
        if "BroadcastExchange" in line and above is None:
            above = depth
    return False


@pytest.fixture
def asked(spark, tmp_path):
    """A folder of many items and one long question."""
    many = [(i, f"amber {i} {'rose ' * 40}", f"house {i}", None) for i in range(2000)] + [(9000 + i, n, "maison noir", None) for i, n in enumerate(("noir", "bois noir", "bois noir blanc", "noir blanc", "blanc", "blanc rose"))]
    spark.createDataFrame(many, "perfume_id long, name_norm string, brand_norm string, ingested_at timestamp").selectExpr("*", "0 AS popularity", "'' AS gender").write.parquet(f"{tmp_path}/perfumes.parquet")
    spark.createDataFrame([("a", f"Noir, Maison Noir: Bois Noir Blanc {'rose ' * 40}")], "id string, query string").write.parquet(f"{tmp_path}/retrieval_eval_cases.parquet")
    return str(tmp_path)


def test_word_windows_of_questions_are_not_broadcast(spark, asked):
    assert not broadcasts_windows(QUERIES["q19_ngram_mentions"](spark, asked))


def test_longest_mentions_broadcast_no_windows_and_keep_what_overlaps(spark, asked):
    found = QUERIES["w20_longest_mentions"](spark, asked)
    assert not broadcasts_windows(found)
    assert {tuple(r) for r in found.collect()} == {("a", 1, "noir"), ("a", 3, "noir"), ("a", 4, "bois noir blanc"), ("a", 6, "blanc rose")}


def test_brand_collisions_broadcast_no_windows(spark, asked):
    found = QUERIES["e11_brand_collision"](spark, asked)
    assert not broadcasts_windows(found)
    assert [tuple(r) for r in found.collect()] == [("a", "maison noir")]
