"""Table-driven cases of single operators."""

import difflib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redolent.functions import text
from redolent.operators import catalog, conversations, filters, relational, resolve, scoring, state, vector
from redolent.plans import search
from redolent.sources import jsonl
from redolent.streaming import events as streaming


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "folded"), [("Estée Lauder / L'Homme", "estee lauder l homme"), ("  ＮＯＩＲ ", "noir"), ("", ""), (None, None), ("ÇİĞ—köfte", "cig kofte")])
def test_fold(spark, raw, folded):
    assert text.fold_text(raw) == folded
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(text.fold(F.col("x")).alias("y")).first().y == folded


def test_fold_items_split_at_commas_only():
    assert text.fold_items("Rose; oud, ,Crème-Brûlée,") == ["rose oud", "creme brulee"]
    assert text.fold_items(None) == []


@pytest.mark.parametrize(("wanted", "trait", "strength"), [("fresh", "fresh", 1), ("fresh", "fresh spicy", 0), ("warm spicy", "spicy", 0.65), ("spicy", "warm spicy", 0.75), ("musk", "musky", 1), ("leather", "suede", 1), ("oud", "agarwood", 1), ("suede", "leather", 0)])
def test_trait_strength(spark, wanted, trait, strength):
    assert one(spark, scoring.match_strength(wanted, F.lit(trait))) == strength


def test_shrunk_rating_prefers_many_votes(spark):
    few, many = one(spark, scoring.shrunk_rating_by_mean(F.lit(5.0), F.lit(1))), one(spark, scoring.shrunk_rating_by_mean(F.lit(4.6), F.lit(1000)))
    assert few < many
    assert one(spark, scoring.shrunk_rating(F.lit(None).cast("double"), F.lit(0))) == 0
    assert one(spark, scoring.shrunk_rating(F.lit(4.0), F.lit(0))) == 3.8


def test_vote_confidence(spark):
    assert one(spark, scoring.vote_confidence(F.lit(5900), F.lit(886))) > 0.7
    assert one(spark, scoring.vote_confidence(F.lit(0), F.lit(0))) == 0


def test_word_borders(spark):
    terms = F.array(F.lit("cloud"), F.lit("vanilla pod"))
    assert not one(spark, filters.forbidden(terms, ("oud",)))
    assert one(spark, filters.forbidden(terms, ("vanilla",)))


def test_label(spark):
    same = F.lit("Laundry by Shelli Segal"), F.lit("laundry by shelli segal")
    assert one(spark, catalog.label(same[0], same[0], same[1], same[1])) == "Laundry by Shelli Segal"
    assert one(spark, catalog.label(F.lit("A"), F.lit("B"), F.lit("a"), F.lit("b"))) == "A by B"


ITEMS = "perfume_id long, name string, brand string, name_norm string, brand_norm string, label_norm string, gender string, rating double, popularity long, accords array<string>, notes array<string>, seasons array<string>, times array<string>"


def catalog_of(spark):
    rows = [(1, "Aventus", "Creed", "aventus", "creed", "aventus creed", "male", 4.3, 26000, ["fruity", "clean"], ["pineapple"], ["summer"], ["day"]), (2, "Club de Nuit Intense Man", "Armaf", "club de nuit intense man", "armaf", "club de nuit intense man armaf", "male", 4.1, 27000, ["fruity"], ["vanilla"], ["winter"], ["night"]), (3, "Club de Nuit Bling", "Armaf", "club de nuit bling", "armaf", "club de nuit bling armaf", "female", 3.9, 300, ["sweet"], ["clean musk"], [], [])]
    return spark.createDataFrame(rows, ITEMS)


@pytest.mark.parametrize(("hint", "item", "stage"), [("aventus by creed", 1, "exact"), ("club de nuit", 2, "family"), ("club de nuit by armaf", 2, "family"), ("nothing like it", None, "unresolved"), ("club de nuit bling by arm", 3, "branded")])
def test_resolve(spark, hint, item, stage):
    r = resolve.resolve(spark.createDataFrame([("h", hint)], "hint_id string, hint_norm string"), catalog_of(spark)).first()
    assert (r.perfume_id, r.stage) == (item, stage)


def test_resolve_fuzzy(spark):
    r = resolve.resolve(spark.createDataFrame([("h", "aventus extra")], "hint_id string, hint_norm string"), catalog_of(spark), fuzzy=True).first()
    assert (r.perfume_id, r.stage) == (1, "fuzzy")


def test_sequence_ratio_is_the_matching_blocks_ratio(spark):
    pairs = [("kurkdijan", "maison francis kurkdjian"), ("", ""), ("abc", "abd"), (None, "x")]
    got = [r.r for r in spark.createDataFrame(pairs, "a string, b string").select(resolve.sequence_ratio("a", "b").alias("r")).collect()]
    assert got == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_search_gates(spark):
    own = catalog_of(spark)
    ids = lambda **k: {r.perfume_id for r in search.hybrid(own, None, search.SearchSpec(**k)).collect()}
    assert ids(required=("clean",)) == {1}
    assert ids(required=("oud",)) == set()
    assert ids(excluded=("vanilla",)) == {1, 3}
    assert ids(wanted=("office",)) == {1, 2, 3}
    with pytest.raises(ValueError, match="unknown"):
        filters.metadata_filter(gender="robot")
    assert search.SearchSpec(top_k=99, fetch_k=9).clamped() == (30, 30)


def test_hybrid_with_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "perfume_id long, embedding array<float>")
    rows = search.hybrid(catalog_of(spark), v, search.SearchSpec(vector=(1.0, 0.0))).collect()
    assert [r.perfume_id for r in rows] == [1, 2]  # an item without a vector isn't in the store
    niche = search.hybrid(catalog_of(spark), v, search.SearchSpec(vector=(1.0, 0.0), mode="niche")).collect()
    assert {r.perfume_id for r in niche} == {1, 2}


@pytest.mark.parametrize(("query", "cut"), [("something clean and fresh", 0.14), ("something cleaner", 0.0), ("clean by clean", 0.14)])
def test_a_brand_in_the_words_of_the_query(spark, query, cut):
    """Brand 'clean' is held by the query by accident: its items lose 0.14 and take one place."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.435889894]), (3, [0.95, 0.312249899])], "perfume_id long, embedding array<float>")
    own = catalog_of(spark).withColumns({"brand_norm": F.when(F.col("perfume_id") < 3, "clean").otherwise("other"), "popularity": F.lit(0), "rating": F.lit(0.0)})
    got = {r.perfume_id: r.score for r in search.hybrid(own, v, search.SearchSpec(vector=(1.0, 0.0), query=query)).collect()}
    assert got[1] == pytest.approx(0.62 - cut) and set(got) == ({1, 3} if cut else {1, 2, 3})
    asked = {r.perfume_id: r.score for r in search.hybrid(own.withColumn("brand", F.col("brand_norm")), v, search.SearchSpec(vector=(1.0, 0.0), query=query, brand="clean")).collect()}
    assert asked[1] == pytest.approx(0.62) and set(asked) == {1, 2}


def test_graph_search_for_hints(spark):
    edges_ = spark.createDataFrame([(1, 2, 5900, 886), (1, 3, 10, 0), (1, 1, 9, 0)], "source_id long, target_id long, up_votes long, down_votes long")
    hints = spark.createDataFrame([("a", None, None, None), ("b", None, 1000, None), ("c", ["nobody"], None, None), ("d", None, None, ["vanilla"]), ("e", None, None, None)], "hint_id string, genders array<string>, min_popularity int, excluded array<string>")
    resolved = spark.createDataFrame([(k, None if k == "e" else 1) for k in "abcde"], "hint_id string, perfume_id long")
    got = search.similar_to_hints(hints, catalog_of(spark), edges_, resolved).collect()
    by = {k: [r.perfume_id for r in sorted(got, key=lambda r: r["rank"]) if r.hint_id == k] for k in "abcde"}
    assert by == {"a": [2, 3], "b": [2], "c": [], "d": [3], "e": []} and max(r.score for r in got) > 0.7 * 0.68


def test_diversify_is_the_greedy_pick(spark):
    rows = [(1, "a x", "x", 0.9), (2, "a x", "x", 0.8), (3, "b x", "x", 0.7), (4, "c x", "x", 0.6), (5, "d y", "y", 0.5)]
    df = spark.createDataFrame(rows, "perfume_id long, label_norm string, brand_norm string, score double")
    assert [r.perfume_id for r in relational.diversify(df, 10, 2).collect()] == [1, 3, 5]
    assert [r.perfume_id for r in relational.diversify(df, 10, 1).collect()] == [1, 5]


def test_stratified_split_sizes(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 400, "a").otherwise("b").alias("s"))
    n = {(r.s, r.split): r["count"] for r in relational.stratified(df, "s", "id", 0.05, 3, buckets=16).groupBy("s", "split").count().collect()}
    assert n == {("a", "validation"): 20, ("a", "train"): 380, ("b", "validation"): 80, ("b", "train"): 1520}


def test_positions_and_empty(spark):
    df = spark.createDataFrame([(5,), (9,), (7,)], "k long")
    assert [(r.k, r.pos) for r in relational.numbered(df, "k").orderBy("k").collect()] == [(5, 0), (7, 1), (9, 2)]
    assert relational.numbered(df.limit(0), "k").count() == 0


def test_vector_batch_is_exact(spark):
    rows = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(40)]
    own = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vector.nearest_batch(own, own.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 3).orderBy("query_id", "rank").collect()
    for r in got:
        q = rows[r.query_id][1]
        best = sorted((1 - sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in rows if i != r.query_id)[:3]
        assert best[r["rank"] - 1][1] == r.vec_id
    assert vector.nearest_batch(own, own.limit(0).withColumnRenamed("vec_id", "query_id"), 3).count() == 0


def test_checks_absent_is_not_false(spark):
    df = spark.createDataFrame([(1, True, None), (2, None, None), (3, False, True)], "id int, a boolean, b boolean")
    m = df.select("id", conversations.checks({"a": F.col("a"), "b": F.col("b")}).alias("m"))
    assert [r.m for r in m.orderBy("id").collect()] == [{"a": True}, {}, {"a": False, "b": True}]
    assert m.agg(conversations.applicable_rate(m, "m", ["a", "b"]).alias("r")).first().r == 0.5
    assert m.limit(0).agg(conversations.applicable_rate(m, "m", ["a"]).alias("r")).first().r == 1.0


def test_cards_of_a_nested_record(spark):
    accords = F.from_json(F.lit('[{"name":"rose","strength":40},{"name":"oud","strength":90},{"name":"tea","strength":10}]'), "array<struct<name:string,strength:double>>")
    assert one(spark, catalog.strong_accords(accords)) == ["oud (90%)", "rose (40%)"]
    kind = "struct<tiered:struct<top:array<struct<name:string>>,middle:array<struct<name:string>>,base:array<struct<name:string>>>,flat:array<struct<name:string>>>"
    assert one(spark, catalog.note_list(F.from_json(F.lit('{"tiered":{"top":[{"name":"lemon"}],"base":[{"name":"musk"},{}]},"flat":[{"name":"x"}]}'), kind))) == ["lemon", "musk"]
    assert one(spark, catalog.note_list(F.from_json(F.lit('{"flat":[{"name":"x"}]}'), kind))) == ["x"]
    assert one(spark, catalog.vote_shares(F.create_map(F.lit("summer"), F.lit(8).cast("long"), F.lit("winter"), F.lit(1).cast("long")))) == ["summer"]
    assert one(spark, catalog.first_sentences(F.lit("Dr. Who came. He saw! He left."))) == "dr. Who came. He saw!"
    assert one(spark, catalog.clean_markup(F.lit("<p>a <b>b</b></p>"))) == "a b"


def test_json_lines(spark, tmp_path):
    p = tmp_path / "l3" / "a.jsonl"
    p.parent.mkdir()
    p.write_text('{"id": 1, "name": "a"}\n\nnot json\n{"id": 2, "name": ""}\n{"id": 3, "name": "c"}\n')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    good, bad = jsonl.read_tolerant(spark, str(p), schema, ("name",))
    assert [r.id for r in good.orderBy("id").collect()] == [1, 3] and bad.count() == 2
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_strict(spark, str(p), schema).collect()
    jsonl.write_json(good, str(tmp_path / "l4"), gzip=True)
    assert {(r.level, r.id) for r in jsonl.read_levels(spark, [str(tmp_path / "l4")], schema).collect()} == {("l4", 1), ("l4", 3)}
    done = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "id long, out string, n int")
    assert jsonl.completed(done, "id", "n").first().out == "y"
    assert [r.id for r in jsonl.still_open(good, done, "id").collect()] == [3]
    m = jsonl.manifest(spark, str(tmp_path / "l4"))
    assert m.count() >= 1 and jsonl.mismatches(m, m).count() == 0
    assert jsonl.mismatches(m, m.limit(0)).count() == m.count()


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {8 + i // 20:02d}:{i % 20 * 2:02d}:00", i % 3, "click" if i % 4 else "view", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.lit("{}"))
    df.write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(999, "2030-01-01 00:00:00", 9, "view", 0.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("props", F.lit("{}"))
    late.write.parquet(str(tmp_path / "in2"))
    for name, make, batch, keys in (("rate", lambda s: streaming.rate_limits(s, 1, "1 hour"), state.rate_limited(df, 1, "1 hour"), ["scope", "actor", "start", "requests", "rejected"]), ("sess", lambda s: streaming.sessions(s, "30 minutes"), state.sessions(df, ttl="30 minutes"), ["user_id", "session_start", "session_end", "events"])):
        src = tmp_path / f"{name}-src"
        df.write.parquet(str(src))
        out, ck = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck")
        streaming.run_available(make(streaming.read_events(spark, str(src))), out, ck).awaitTermination()
        late.write.mode("append").parquet(str(src))  # a much later event closes all windows
        streaming.run_available(make(streaming.read_events(spark, str(src))), out, ck).awaitTermination()
        got = {tuple(r) for r in spark.read.parquet(out).select(*keys).collect()}
        assert got == {tuple(r) for r in batch.select(*keys).collect()}


def test_fold_agrees_with_the_exact_fold(spark):
    from redolent.functions import text

    odd = ["Estée Lauder / L'Homme", "İYİ Çok ŞIK ıı", "ＯＵＤ, Rose", "ß ø ł đ", "äb̧, ć", None, "", " , ,", "“Niogapri” – Cendre…", "ﬁn de siècle", "Ǆ Ⅻ ²", "ªº", "ẋ", "ﾊﾞ", "Σίσυφος", "k, Å", "­so­ft", "tab\tnew\nline"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, x string")
    for r in df.select("x", text.fold(F.col("x")).alias("f"), text.folded_items(F.col("x")).alias("g")).collect():
        assert r.f == text.fold_text(r.x) and list(r.g) == text.fold_items(r.x), r.x


def test_within_edits_finds_every_pair(spark):
    import itertools
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(40)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {(r.a, r.b): r.distance for r in resolve.within_edits(df.toDF("a"), df.toDF("b"), "a", "b").collect()}
    assert got == {(a, b): d for a, b in itertools.product(texts, repeat=2) if (d := distance(a, b)) <= 2}


@pytest.mark.parametrize(("hint", "item", "stage"), [("club de nuit inense man by armaf", 2, "brand"), ("club de nuit blng", 3, "fuzzy"), ("adventus by creed", 1, "brand"), ("something else entirely", None, "unresolved"), ("zzz by creed", None, "unresolved")])
def test_resolution_score_ranks_what_the_stages_leave(spark, hint, item, stage):
    r = resolve.resolve(spark.createDataFrame([("h", hint)], "hint_id string, hint_norm string"), catalog_of(spark), fuzzy=True).first()
    assert (r.perfume_id, r.stage) == (item, stage)


def test_curated_aliases_win(spark):
    own = spark.createDataFrame([("tom ford", "Tom Ford", 5), ("two foxes", "Two Foxes", 9), ("creed", "Creed", 1)], "brand_norm string, brand string, popularity long")
    plain = {r.alias: r.brand_norm for r in resolve.alias_index(own).collect()}
    fixed = {r.alias: r.brand_norm for r in resolve.alias_index(own, resolve.CURATED).collect()}
    assert "tf" not in plain and fixed["tf"] == "tom ford" and "ysl" not in fixed and fixed["creed"] == "creed"


def test_carry_forward_and_repeats(spark):
    rows = [(1, 1, [5, 6], True), (1, 2, [6, 7], False), (1, 3, None, False), (1, 4, [8, 8], False), (1, 5, [5], True), (2, 1, [], True), (2, 2, [1], False)]
    df = spark.createDataFrame(rows, "s int, t int, ids array<int>, is_new boolean")
    got = {(r.s, r.t): (r.before, r.again, r.fresh) for r in relational.carry_forward(df, "s", ["t"], "ids", "is_new").collect()}
    assert got == {(1, 1): (0, 0, None), (1, 2): (2, 1, False), (1, 3): (3, 0, None), (1, 4): (3, 0, True), (1, 5): (0, 0, None), (2, 1): (0, 0, None), (2, 2): (0, 0, None)}


def test_answer_rules_of_each_level(spark):
    profile = "[USER PROFILE]\nx\n[/USER PROFILE]\n\nwhat now?"
    good = "1. Aventus by Creed\n2. Bling by Armaf\nBest pick: Aventus by Creed\nWhy: it is fresh."
    rows = [
        ("q", "1. Aventus by Creed\n2. Bling by Armaf", ["aventus", "bling"]),
        ("q", "Here you are:\n1. Aventus by Creed", []),
        ("q", "1. Other by Creed", ["aventus"]),
        (profile, good, ["aventus", "bling"]),
        ("q", good.replace("Best pick: Aventus", "Best pick: Other") + " The price is $30, a compliment beast for date_night.", []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, a string, cards array<string>")
    for level, want in (
        ("L3", {0: set(), 1: {"list_format"}, 2: {"rag_subset"}}),
        ("L4", {0: {"format", "best_pick"}, 3: set(), 4: {"best_pick", "unsupported_claim", "internal_label"}}),
        ("L5", {3: set(), 4: {"best_pick", "unsupported_claim", "profile_block"}}),
    ):
        rules = conversations.answer_rules(level, F.col("q"), F.col("a"), F.col("cards"))
        got = {r.i: set(r.f) for r in df.select("i", conversations.failures(rules).alias("f")).collect()}
        assert {i: got[i] for i in want} == want, level
