"""The training-data operators against brute force, exact round trips and hand-made edge cases."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from redolent.functions.text import fold_items
from redolent.llm import bpe, canonical, contamination, language, packing, qa_defects, setjoin
from redolent.llm import term_frequency as tf
from redolent.llm.queries import QUERIES, SQL

VOCABULARY = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"

# ---- 1 term frequency


def perfumes(spark, rows):
    """rows: (perfume_id, accords_csv, notes_csv, loads)."""
    flat = [(i, a, n, None, None, f"2024-01-{k + 1:02d} 00:00:00", "x", "y") for i, a, n, loads in rows for k in range(loads)]
    return spark.createDataFrame(flat, "perfume_id long, accords_csv string, notes_csv string, brand string, name string, ingested_at string, term string, record string").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def test_term_frequency_counts_once_and_marks(spark):
    rows = [(i, "Rose,rose , ", "oud" if i < 3 else None, 1 + i % 2) for i in range(30)] + [(100, "", None, 1), (101, None, "ＯＵＤ", 3)]
    got = {(r.field, r.term): (r.occurrences, r.records, r.mark) for r in tf.term_frequency(perfumes(spark, rows), "perfume_id", ["accords_csv", "notes_csv"], "ingested_at").collect()}
    assert got == {("accords_csv", "rose"): (60, 30, "common"), ("notes_csv", "oud"): (4, 4, "rare")}


def test_term_frequency_hot_term_over_many_partitions(spark):
    rng = random.Random(1)
    rows = [(i, ",".join(rng.choice(["a", "a", "b", "c", f"t{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 6))), None, 1) for i in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {(r.term): (r.occurrences, r.records) for r in tf.term_frequency(perfumes(spark, rows), "perfume_id", ["accords_csv", "notes_csv"], "ingested_at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    occ, rec = Counter(), Counter()
    for _, a, _, _ in rows:
        items = fold_items(a)
        occ.update(items)
        rec.update(set(items))
    assert got == {t: (occ[t], rec[t]) for t in occ}


def test_term_frequency_empty(spark):
    assert tf.term_frequency(perfumes(spark, [(1, "a", "b", 1)]).limit(0), "perfume_id", ["accords_csv"], "ingested_at").count() == 0


# ---- 2 defects

ENDS = frozenset({"on skin", "000 voters", "of rose"})


@pytest.fixture(scope="module")
def known(spark, data):
    """What the corpus of sf0.01 tells, with the ends of the fixtures below."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    ends, weights = qa_defects.learn(read("sample_messages"))
    return qa_defects.Known(ends | ENDS, weights, language.fit(read("documents"), read("language_codes")))


QUESTION = "Which perfumes would you pick for a cold evening if I like rose but not oud, and which lasts over 8 hours?"
FULL = "From the cards, 2 perfumes fit:\n1. A by B: rose over musk, 9 hours on skin\n2. C by D: rose over tea, 7 hours on skin"


@pytest.mark.parametrize(
    ("question", "answer", "kind"),
    [
        (QUESTION, None, "empty"),
        (QUESTION, " ​\n", "empty"),
        (QUESTION, "N/A", "empty"),
        (QUESTION, "<br>", "empty"),
        (QUESTION, "---", "empty"),
        (QUESTION, "I'm sorry, but I cannot help with that.", "refusal"),
        ("Elimde X var, ne önerirsin?", "Bu isteği yerine getiremem. Lütfen bir uzmana danışın.", "refusal"),
        (QUESTION, "No perfume in the catalog has both; I can't list a match unless you drop the oud, while A by B comes close with 9 hours.", None),
        (QUESTION, f"“{QUESTION}”", "copy"),
        (QUESTION, "You asked: " + QUESTION.replace("cold ", ""), "copy"),
        (QUESTION, QUESTION + "\n" + FULL, None),
        ("[PERFUMES]\nName: A | Brand: B\n\n" + QUESTION, QUESTION, "copy"),
        (QUESTION, "Ich würde mit diesem Duft anfangen, weil die Rose hier mehr zu hören ist und das Oud nicht so laut ist.", "language"),
        (QUESTION + " Please answer in German.", "Ich würde mit diesem Duft anfangen, weil die Rose hier mehr zu hören ist und das Oud nicht so laut ist.", None),
        (QUESTION, FULL, None),
        (QUESTION, FULL + " 🙂", None),
        (QUESTION, FULL[:-12], "truncated"),
        (QUESTION, FULL.split("\n2.")[0], "truncated"),
        (QUESTION, "This one is the better choice. It lasts for the whole eve", "truncated"),
        (QUESTION, "This one is the better choice. It lasts for the...", "truncated"),
        (QUESTION, "This one is the better choice. It lasts.", None),
        (None, "This one is the better choice.", None),
        ("Aventus?", "Aventus?", "copy"),
        ("Aventus or Silver Rain?", "Silver Rain", "truncated"),
        (QUESTION, "None given", "empty"),
        (QUESTION, "No response was provided.", "empty"),
        ("", "x" * 200_000 + ".", None),
    ],
)
def test_defects(known, question, answer, kind):
    assert qa_defects.defect(question, answer, known) == kind


#: Held out: none of these sentences stands in a list of the operator or was used to set it.
ASKED = {
    "en": "Could you suggest something for the office that has iris but no vanilla?",
    "de": "Kannst du mir etwas fürs Büro nennen, das Iris hat, aber keine Vanille?",
    "fr": "Peux-tu me conseiller quelque chose pour le bureau avec de l'iris mais sans vanille ?",
    "es": "¿Puedes sugerirme algo para la oficina que tenga iris pero no vainilla?",
    "tr": "Ofis için süsen içeren ama vanilya içermeyen bir şey önerir misin?",
}
REFUSED = {
    "en": ["I must refuse to pick anything for you.", "I'm not permitted to talk about that.", "Answering this would violate my policy.", "Unfortunately that lies beyond what I can discuss.", "I'd prefer not to weigh in on this.", "I am unable to comment on those 5 bottles.", "My guidelines forbid me to give any suggestion.", "We are not authorized to advise customers. Have a pleasant evening.", "I have decided to abstain from this one.", "It is not my place to choose for you, sorry."],
    "de": ["Dazu kann ich leider nichts sagen.", "Ich muss es ablehnen, hier etwas zu empfehlen.", "Meine Richtlinien verbieten mir jede Empfehlung.", "Das liegt außerhalb meiner Zuständigkeit, dazu sage ich nichts.", "Ich möchte diese Frage lieber nicht beantworten.", "Mir ist es nicht gestattet, Ratschläge zu geben."],
    "fr": ["Je refuse de choisir à votre place.", "Je ne peux malheureusement rien conseiller.", "Mes règles m'interdisent de répondre.", "Cela sort de mon domaine, je ne peux pas en parler.", "Je préfère m'abstenir sur ce sujet.", "Il ne m'est pas permis de donner un avis."],
    "es": ["No puedo aconsejarte en esto.", "Me abstengo de responder.", "Mis reglas prohíben dar consejos.", "No deseo opinar sobre esa cuestión.", "Esto supera lo que puedo hacer por ti, no puedo contestar.", "No estoy autorizada para recomendar nada."],
    "tr": ["Bu soruya cevap veremeyeceğim.", "Öneri yapmam yasak, kurallarım izin vermiyor.", "Bu konuda konuşmayı reddediyorum.", "Size tavsiye veremem, özür dilerim.", "Bu istek benim yetkimi aşıyor.", "Yorum yapmaktan kaçınıyorum."],
}
ANSWERED = {
    "en": ["Nothing in the records has iris without vanilla.", "I can't verify the launch year, yet Grey Iris has 310 votes and stays close to the skin.", "I would skip Grey Iris: the musk is sweet and the iris fades in an hour.", "Only one card fits, and it is too sweet for a small room.", "Try Grey Iris first; it is dry, powdery and quiet."],
    "de": ["Keine der Karten passt zu beiden Wünschen.", "Das Jahr lässt sich nicht bestätigen, aber Grey Iris hat 310 Stimmen und bleibt leise.", "Nimm Grey Iris, der Duft ist trocken und pudrig."],
    "fr": ["Aucune fiche ne convient aux deux demandes.", "L'année reste incertaine, mais Grey Iris a 310 votes et reste discret.", "Essaie Grey Iris, sec et poudré sur la peau."],
    "es": ["Ninguna ficha cumple las dos condiciones.", "No consta el año, pero Grey Iris tiene 310 votos y es discreto.", "Prueba Grey Iris, seco y empolvado sobre la piel."],
    "tr": ["Kartların hiçbiri iki isteğe birden uymuyor.", "Yılını bulamadım ama Grey Iris 310 oy almış ve oldukça sakin.", "Önce Grey Iris dene, kuru ve pudralı bir koku."],
}
SHORT = {
    "en": ["The iris here is dry and soft.", "It stays close to the skin."],
    "de": ["Die Iris ist hier trocken und weich.", "Der Duft bleibt nah an der Haut."],
    "fr": ["Ici, l'iris est sec et doux.", "Il reste près de la peau."],
    "es": ["Aquí el iris es seco y suave.", "Se queda cerca de la piel."],
    "tr": ["Buradaki süsen kuru ve yumuşak.", "Koku tene yakın kalıyor."],
}
SHORT_OTHER = ["Qui l'iris è secco e morbido.", "Aqui a íris é seca e suave, não doce.", "De iris is hier droog en zacht.", "Здесь ирис сухой и мягкий."]


def test_unlisted_defects_are_found(known):
    want, got = [], []
    for lang, question in ASKED.items():
        cases = [(x, "refusal") for x in REFUSED[lang]] + [(x, None) for x in ANSWERED[lang] + SHORT[lang]]
        cases += [(x, "language") for other, texts in SHORT.items() if other != lang for x in texts] + [(x, "language") for x in SHORT_OTHER]
        words = question.rstrip("?").split()
        cases += [(question, "copy"), (" ".join(words[1:]) + "?", "copy"), (question.upper(), "copy")]
        for answer, kind in cases:
            want.append(kind)
            got.append(qa_defects.defect(question, answer, known))
    for kind in ("refusal", "copy", "language"):
        right = sum(w == g == kind for w, g in zip(want, got, strict=True))
        assert right >= 0.9 * want.count(kind) and right >= 0.9 * got.count(kind), (kind, right, want.count(kind), got.count(kind))
    assert sum(k is not None for k in want) >= 100


def test_a_long_refusal_is_one_and_costs_little(known):
    long = "I am sorry to say that after thinking about what you have asked me for quite some time now I am not, and will never be, in a position to give you any advice about it."
    assert qa_defects.defect(QUESTION, long, known) == "refusal"
    assert qa_defects.decline(["not", "word"] * 100_000) < 1


def test_lcs_is_the_plain_one():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert qa_defects.lcs(a, b) == plain(a, b)


def messages(spark, rows):
    """rows: (sample_id, role, content, split)."""
    full = [(i, r, c, s, "src", k) for k, (i, r, c, s) in enumerate(rows)]
    return spark.createDataFrame(full, "sample_id long, role string, content string, split string, source string, k int").withColumn("ingested_at", F.timestamp_seconds("k")).withColumn("defect", F.lit("clash")).withColumn("line_end", F.lit(1))


def test_defective_pairs(spark):
    rows = [(1, "user", QUESTION, "train"), (1, "model", None, "train"), (2, "user", QUESTION, "train"), (3, "user", QUESTION, "train"), (3, "assistant", FULL, "train"), (3, "assistant", FULL, "train"), (4, "model", "null", "test"), (None, "model", "", "test"), (5, "system", "x", "test"), (6, None, "", "train")]
    got = {r.sample_id: r.defect for r in qa_defects.defective_pairs(messages(spark, rows)).collect()}
    assert got == {1: "empty", 2: "empty", 4: "empty"}
    assert qa_defects.defective_pairs(messages(spark, rows).limit(0)).count() == 0


# ---- 3 canonical mapping

BRANDS = [(1, "Lizete"), (2, "Maison Skupeşkerk"), (3, "Stezilteth"), (4, "Stizilteth"), (5, "Talfrelur & Fazatobais"), (6, "L'Atelier Banuplar"), (7, "L'Atelier Budülri")]
LABELS = [(1, "Nousite", 1, "Nousite by Lizete"), (2, "Valusim Cuir", 3, "Valusim Cuir by Stezilteth"), (3, "Suzoufer 80", 2, "Suzoufer 80 by Maison Skupeşkerk"), (4, "Nousite Intense", 1, "Nousite Intense by Lizete"), (5, "Rivolia", 6, "Rivolia by L'Atelier Banuplar")]


@pytest.mark.parametrize(
    ("value", "ref"),
    [(" Lizete ", 1), ("LIZETE", 1), ("Lizee", 1), ("Liz3te", 1), ("Lizete Paris", 1), ("lziete parfum", 1), ("Skupeşkerk, Maison", 2), ("Maison  Skupeskerk", 2), ("MaisonSkupeşkerk", 2), ("Skupeşkerk", 2), ("Stezilteth S.A.", 3), ("stizilteth", 4), ("Talfrelur and Fazatobais", 5), ("Maison Vikepelt", 0), ("N/A", 0), ("???", 0), ("unknown", 0), ("Zotizelt", 0)],
)
def test_brands(value, ref):
    c = canonical.Catalog(BRANDS, LABELS)
    assert min(c.brand_ids(value), default=0) == ref


@pytest.mark.parametrize(
    ("value", "ref"),
    [("nousite edp", 1), ("“Nousite”", 1), ("Nousite Intense", 4), ("Nousite Sport", 0), ("Cuir Valusim", 2), ("Valusim_Cuir", 2), ("Valusim Cuir 50ml spray", 2), ("Valusim Cuir (2001)", 2), ("suzoufer 80", 3), ("Suzoufer 81", 0), ("Nousite by Lizete", 1), ("Nousite from LIZETE PARIS", 1), ("Lizete: Nousite", 1), ("Lizete Nousite", 1), ("Nousite (Lizete)", 1), ("Nuosite by Lizette", 1), ("Nousite by Stezilteth", 0), ("discovery set", 0), ("", 0)],
)
def test_names_and_references(value, ref):
    c = canonical.Catalog(BRANDS, LABELS)
    assert min(c.name_ids(value), default=0) == ref


def test_initials_are_settled_by_the_name():
    c = canonical.Catalog(BRANDS, LABELS)
    assert len(c.brand_ids("LAB")) == 2
    assert c.resolve("L.A.B.", "Rivolia")[0] == 6
    assert c.resolve("LAB", "something else")[0] == 0


def test_map_values(spark):
    p = spark.createDataFrame([(1, "lizete", "Nousite", 1), (1, "lizete", "Nousite", 2), (2, "Lizete", " ", 1), (3, None, "xxx", 1), (None, "q", "q", 1)], "perfume_id long, brand string, name string, k int").withColumn("ingested_at", F.timestamp_seconds("k")).withColumn("kind", F.lit(0))
    c = spark.createDataFrame([("a", "NOUSITE BY LIZETE"), ("a", "NOUSITE BY LIZETE"), ("b", None), ("c", "Nousite by Lizete"), (None, "x")], "id string, expected_resolved_reference string")
    b, lab = spark.createDataFrame(BRANDS, "brand_id long, brand string"), spark.createDataFrame(LABELS, "label_id long, name string, brand_id long, label string")
    got = {tuple(r) for r in canonical.map_values(p, c, b, lab).collect()}
    assert got == {("brand", "1", 1), ("name", "3", 0), ("reference", "a", 1)}
    none = {tuple(r) for r in canonical.map_values(p, c, b.limit(0), lab.limit(0)).collect()}
    assert ("brand", "2", 0) in none and all(r[2] == 0 for r in none)
    assert canonical.map_values(p.limit(0), c.limit(0), b, lab).count() == 0


# ---- 4 similar sets


def brute_pairs(rows, similarity=0.8, least=6):
    sets = {}
    for i, a, n, _ in rows:
        sets[i] = {("a", x) for x in fold_items(a)} | {("n", x) for x in fold_items(n)}
    keep = sorted(i for i, s in sets.items() if len(s) >= least)
    return {(i, j) for i, j in itertools.combinations(keep, 2) if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize(("pivots", "cell"), [(None, None), (3, None), (25, 40)])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, pivots, cell):
    rng = random.Random(4)
    base = [[f"t{rng.randint(0, 60)}" for _ in range(rng.randint(4, 18))] for _ in range(60)]
    rows = []
    for i in range(400):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = f"t{rng.randint(0, 90)}"
        rows.append((i, ",".join(own[:3]), ", ".join(own[2:]).upper(), 1 + i % 2))
    rows += [(1000, None, None, 1), (1001, "", ",,", 1)]
    if cell:
        monkeypatch.setattr(setjoin, "CELL", cell)
    own = perfumes(spark, rows)
    if pivots:
        monkeypatch.setattr(setjoin, "similar_classes", lambda s, t, f=setjoin.similar_classes: f(s, t, pivots))
    got = [(r.id_a, r.id_b) for r in setjoin.similar_pairs(own, "perfume_id", ["accords_csv", "notes_csv"], "ingested_at").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)


def test_large_class_keeps_every_link(spark):
    csv = "a,b,c,d,e,f,g"
    rows = [(i, csv, None, 1) for i in range(20)] + [(50, csv, "h", 1)]
    got = {(r.id_a, r.id_b) for r in setjoin.similar_pairs(perfumes(spark, rows), "perfume_id", ["accords_csv", "notes_csv"], "ingested_at", full=4).collect()}
    assert {(0, i) for i in range(1, 20)} <= got and all((i, 50) in got for i in range(20))
    assert setjoin.similar_pairs(perfumes(spark, rows).limit(0), "perfume_id", ["accords_csv", "notes_csv"], "ingested_at").count() == 0


# ---- 5 overlaps across splits


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(5)
    for _ in range(500):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(2))
        d, most = plain(a, b), rng.randint(0, 20)
        assert contamination.edits(a, b, most) == (d if d <= most else most + 1)


def test_words_ignore_case_marks_and_forms():
    assert contamination.words("ÇOK—güzel!  Ｋoku, İYİ ı") == contamination.words("cok guzel koku iyi i")


def test_overlaps_are_all_overlaps(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(120)]
    texts, rows, records = [[rng.choice(vocabulary) for _ in range(rng.randint(64, 110))] for _ in range(12)], [], {}
    for i in range(160):
        w = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 3, 6, 9, 12])):
            at = rng.randrange(len(w))
            kind = rng.randint(0, 2)
            if kind == 0:
                w[at] = rng.choice(vocabulary)
            elif kind == 1:
                w.insert(at, rng.choice(vocabulary))
            else:
                del w[at]
        split = rng.choice(["train", "train", "validation", "test"])
        cut = rng.randint(1, len(w) - 1)
        rows += [(i, "user", " ".join(w[:cut]), split), (i, "model", ", ".join(w[cut:]).upper(), split), (i, "system", "same for all", split)]
        records[i] = (split, w)
    rows += [(900, "user", None, "train"), (901, "user", "short", "test"), (902, "user", "x " * 100, None)]
    found = contamination.overlap_classes(messages(spark, rows))
    links = contamination.overlaps(found)
    got = [(r.train_id, r.eval_id) for r in links.collect()]
    want = set()
    for (i, (s, w)), (j, (t, v)) in itertools.product(records.items(), repeat=2):
        if s == "train" and t != "train" and min(len(w), len(v)) >= 64:
            most = max(len(w), len(v)) // 10
            if contamination.edits(w, v, most) <= most:
                want.add((i, j))
    assert len(got) == len(set(got)) and set(got) == want and want
    by = {(r.split, r.source): (r.records, r.exact + r.near) for r in contamination.counts(found).collect()}
    assert sum(n for _, n in by.values()) == len({e for _, e in want})


def test_overlap_classes(spark):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(i, "user", text, "train" if i < 6 else "test") for i in range(12)]
    found = contamination.overlap_classes(messages(spark, rows))
    assert [tuple(r) for r in found.links.collect()] == [(0, 6, 0, 6, 6)]
    assert {(r.sample_id, r.class_id, r.copies, r.links, r.distance) for r in contamination.memberships(found).collect()} == {(i, 0 if i < 6 else 6, 6, 6, 0) for i in range(12)}
    links = contamination.overlaps(found, full=4)
    got = {(r.train_id, r.eval_id) for r in links.collect()}
    assert got == {(0, e) for e in range(6, 12)} | {(t, 6) for t in range(6)}
    none = contamination.overlap_classes(messages(spark, rows).limit(0))
    assert contamination.overlaps(none).count() == 0 and contamination.counts(none).count() == 0


# ---- 6 encoding


def test_encoding_is_the_public_one():
    tokenizers = pytest.importorskip("tokenizers")
    own, public = bpe.load(VOCABULARY), tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    public.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh etaoin's  İéüЖ中🙂​\n-=_<|endoftext|>0123") for _ in range(rng.randint(1, 80))) for _ in range(3000)]
    texts += ["a" * 5000 + " " * 700 + "zqxj" * 900, "<|endoftext|>", "\x00퟿"]
    for t in texts:
        ids = own.encode(t)
        assert ids == public.encode(t, add_special_tokens=False).ids and own.decode(ids) == t and own.count(t) == len(ids)


def test_encode_corpus(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "roses"), (3, "roses"), (None, "x" * 100_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()), key=str)
    own = bpe.load(VOCABULARY)
    assert got == sorted([(1, []), (2, []), (3, own.encode("roses")), (3, own.encode("roses")), (None, own.encode("x" * 100_000))], key=str)
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# ---- 7 packing


def best_fit_decreasing(sizes, capacity):
    """What is left in each container after placing item by item."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        best = min((i for i, r in enumerate(rooms) if r >= s), key=lambda i: (rooms[i], i), default=None)
        if best is None:
            rooms.append(capacity)
            best = len(rooms) - 1
        rooms[best] -= s
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(400):
        capacity = rng.choice([5, 8, 17, 33, 100])
        sizes = [rng.randint(1, max(1, capacity // rng.choice([1, 2, 3]))) for _ in range(rng.randint(0, 60))]
        rooms, seen = {}, Counter()
        for r in packing.plan(Counter(sizes), capacity):
            for k in range(r.count):
                b = r.bin + k // r.each
                rooms[b] = rooms.get(b, capacity) - r.size
                seen[r.size] += 1
        assert seen == Counter(sizes) and sorted(rooms.values()) == best_fit_decreasing(sizes, capacity)


def test_pack(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, 7, 7, 7, rng.randint(1, 50), 210])) for i in range(600)]
    limits = spark.createDataFrame([(1, 50), (2, 64), (3, None), (None, 9)], "limit_id int, capacity_tokens int")
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, tokens int").withColumn("size", F.lit("clash")), limits, per_bucket=100).collect()
    for limit, capacity in ((1, 50), (2, 64)):
        own = [r for r in got if r.limit_id == limit]
        fill, parts = Counter(), {}
        for r in own:
            if r.seq_id is not None:
                fill[r.seq_id] += r.tokens
            parts.setdefault(r.doc_id, []).append(r.tokens)
        assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
        for i, n in rows:
            assert sum(parts[i]) == n and len(parts[i]) == max(1, -(-n // capacity))
        assert sorted(capacity - f for f in fill.values()) == best_fit_decreasing([r.tokens for r in own if r.seq_id is not None], capacity)
    assert len(got) == len({(r.limit_id, r.doc_id, r.piece_no) for r in got})
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), limits).count() == 0


# ---- 8 languages


LANGUAGES = [("en", "eng", "English", "English"), ("tr", "tur", "Turkish", "Türkçe"), ("de", "deu", "German", "Deutsch"), ("fr", "fra", "French", "français")]


@pytest.mark.parametrize(("label", "lang"), [("en", "en"), (" EN ", "en"), ("eng", "en"), ("en-GB", "en"), ("tr_TR", "tr"), ("Türkçe", "tr"), ("français", "fr"), ("German", "de"), ("zz", None), ("", None), (None, None), ("n/a", None), ("und", None), ("xx-YY", None)])
def test_labels(spark, label, lang):
    codes = {x.casefold(): r[0] for r in LANGUAGES for x in r}
    assert language.read_label(label, codes) == lang


def test_lists_and_names_tell_nothing():
    assert not language.tells("notes: oakmoss, coffee, tonka bean, hay") and not language.tells("Nousite Lizete") and not language.tells("oakmoss, coffee, hay, fig")
    assert language.tells("the rose is loud, the oud is quiet, and the musk stays for hours")


def test_held_out_accuracy_and_segments(spark, data):
    docs, codes = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/language_codes.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"), codes)
    found = language.languages_of(docs.where("doc_id % 2 = 1"), codes, model)
    heads = found.where("seg_no = 0 AND label IS NOT NULL AND parts = 1")
    rate = heads.agg(F.avg((F.col("label") == F.col("lang")).cast("int")).alias("r")).first().r
    assert rate > 0.9  # labels are wrong in about one of twenty
    text = "The dry down is where the rose and the musk finally agree. On my skin it stays for hours. Pour ce prix, on obtient beaucoup de rose et une projection timide. Sur ma peau, la note de rose tient longtemps.\nNotes: oakmoss, coffee, hay, fig"
    df = spark.createDataFrame([(1, "fr", text), (2, None, ""), (3, "en", None), (4, "en", "1234 !!"), (5, None, "Nousite"), (6, "de", "The bottle says papyrus, yet my nose finds milk with a handful of plum. " * 500)], "doc_id long, lang string, text string").withColumn("parts", F.lit("clash"))
    got = language.missing_or_wrong(language.languages_of(df, codes, model)).collect()
    segs = {(r.doc_id, r.seg_no): r.lang for r in got}
    assert (segs[1, 1], segs[1, 2]) == ("en", "fr") and (1, 3) not in segs
    assert segs[6, 0] == "en" and (6, 1) not in segs and {d for d, _ in segs} <= {1, 5, 6}
    assert all(0 <= r.confidence <= 1 for r in got)
    assert language.languages_of(df.limit(0), codes, model).count() == 0


# ---- all queries


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.count() >= 0 and (name in SQL or name not in ("p1_found", "p1_terms", "p4_found"))


def test_sentences_stay_whole_and_one_word_tells_little(spark, data):
    docs, codes = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/language_codes.parquet")
    model = language.fit(docs, codes)
    english = "the dry down is where the rose and the musk finally agree and "
    assert [s.lang for s in language.segments(english * 40 + "that is all.", model)] == ["en"]
    assert len(language.sentences(english * 40)) == 1
    assert [s.lang for s in language.segments("I would give aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa it eight out of ten.", model)] == ["en"]
    two = language.segments("Very good. " + "Sur ma peau, la note de rose tient longtemps. " * 2, model)
    assert two[-1].lang == "fr" and not language.tells("Silver Rain") and language.tells("very good")
    assert language.segments("Nousite", model)[0].chars == 7 and language.segments(None, model) == []


# ---- 3 again: mentions in running text, slips and abbreviations that no list holds


@pytest.mark.parametrize(
    ("value", "ref"),
    [
        ("something like Rivolia please", 5),
        ("the one called Valusim Cuir my sister wears", 2),
        ("I want something close to Nousite Intense for winter", 4),
        ("any perfume by Lizete like Nousite", 1),
        ("Vlausim Ciur", 2),
        ("Valusim Cuirr edp", 2),
        ("Nousite Kelebort", 0),
        ("something like Nousite Sport please", 0),
        ("Rivolia Sport", 6),
        ("something like Nousite or Rivolia", 0),
        ("Valusim", 0),
        ("Suzoufer 81 please", 0),
    ],
)
def test_names_in_running_text(value, ref):
    learned = {"name": frozenset({"sport"})}  # a word that many values have beside an entry is noise, unless two entries differ by it
    c = canonical.Catalog(BRANDS, [*LABELS, (6, "Rivolia Sport", 6, "Rivolia Sport by L'Atelier Banuplar")], learned)
    assert "sport" in c.names.editions and min(c.name_ids(value), default=0) == ref


@pytest.mark.parametrize(("short", "full", "yes"), [("prfms", "parfums", True), ("atl", "atelier", True), ("mson", "maison", True), ("off", "officina", True), ("xy", "maison", False), ("m", "maison", False), ("maisons", "maison", False), ("sn", "maison", False)])
def test_abbreviations(short, full, yes):
    assert canonical.abbreviates(short, full) == yes


def test_recall_on_held_out_noise(spark, data):
    """Entries of the lists, dirtied in ways no list of the operator names: recall and precision of 0.9 at least."""
    read = lambda t: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect()]
    brands = [(r[0], r[1]) for r in read("brand_list")]
    labels = [(r[0], r[1], r[2], r[3]) for r in read("label_list")]
    c, rng = canonical.Catalog(brands, labels), random.Random(30)
    known = {" ".join(canonical.words(n)) for _, n, _, _ in labels}

    def slip(word):
        k = rng.randrange(1, len(word) - 2)
        return rng.choice([word[:k] + word[k + 1] + word[k] + word[k + 2 :], word[:k] + word[k + 1 :], word[:k] + word[k] + word[k:]])

    right = answered = asked = 0
    for i, name, _, label in rng.sample(labels, 300):
        own = name.split()
        longest = max(own, key=len)
        dirty = [f"do they still sell {name} anywhere", f"My friend adores {name} in winter", " ".join(slip(w) if w == longest and len(w) > 5 else w for w in own), f"{label} please", " ".join(reversed(own))]
        for value in dirty:
            if " ".join(canonical.words(value)) in known:
                continue
            got = c.name_ids(value)
            same = {k for k, n, _, _ in labels if n == name}
            asked, answered, right = asked + 1, answered + bool(got), right + bool(got and got <= same)
    assert right >= 0.9 * asked and right >= 0.9 * answered


def test_lists_beyond_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr(canonical, "ENTRIES", 3)
    b, lab = spark.createDataFrame(BRANDS, "brand_id long, brand string"), spark.createDataFrame(LABELS, "label_id long, name string, brand_id long, label string")
    with pytest.raises(ValueError):
        canonical.load(b, lab)


def test_hot_triples_are_lengthened_and_lose_nothing(monkeypatch):
    import numpy as np

    rng = random.Random(31)
    calls = []
    monkeypatch.setattr(setjoin, "HOT", 4)
    lengthen = setjoin._lengthen
    monkeypatch.setattr(setjoin, "_lengthen", lambda *a: calls.append(a[-1]) or lengthen(*a))
    common = list(range(1, 6))  # the rarest members by the order below stand in almost every set
    sets = {}
    for i in range(500):
        own = set(rng.sample(common, rng.choice([3, 4, 5, 5]))) | set(rng.sample(range(10, 34), rng.randint(3, 12)))
        if len(own) >= 6:
            sets[i] = tuple(sorted(own))
    for i in range(500, 560):  # near copies of one
        own = list(sets[min(sets)])
        own[-1] = 100 + i % 7
        sets[i] = tuple(sorted(own))
    ids = np.array(sorted(sets))
    flat = np.array([x for i in ids.tolist() for x in sets[i]], dtype=np.int64)
    offsets = np.cumsum([0, *(len(sets[i]) for i in ids.tolist())])
    want = {(a, b) for a, b in itertools.combinations(ids.tolist(), 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) - 1e-9}
    for width in (setjoin.KEY, setjoin.WIDE):
        for splits in (1, 3):
            got = set()
            for split in range(splits):
                for x, y in setjoin._match(ids, np.ones(len(ids), dtype=bool), flat, offsets, 0.8, width, split, splits):
                    got |= {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist(), strict=True)}
            assert got == want
    assert set(calls) >= {5}


def test_links_and_members_say_the_same_for_classes_of_any_size(spark):
    csv = "a,b,c,d,e,f,g"
    rows = [(i, csv, None, 1) for i in range(100)] + [(200, csv, "h", 1), (201, csv, "h", 1), (300, "a,b", None, 1)]
    own = setjoin.set_classes(perfumes(spark, rows), "perfume_id", ["accords_csv", "notes_csv"], "ingested_at")
    links = setjoin.class_links(own)
    assert [tuple(r) for r in links.collect()] == [(0, 200, 100, 2)]
    got = {r.id: (r.cls, r.copies, r.links) for r in setjoin.memberships(own, links).collect()}
    assert got[7] == (0, 100, 101) and got[201] == (200, 2, 101) and 300 not in got and len(got) == 102


def test_defects_without_labelled_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    codes = spark.createDataFrame(LANGUAGES, "lang string, lang3 string, english_name string, own_name string")
    model = language.fit(docs, codes)
    rows = [(1, "user", QUESTION, "train"), (1, "model", "I must refuse to pick anything for you.", "train"), (2, "user", QUESTION, "train"), (2, "model", "Il profumo è secco e morbido, con molto muschio e poca rosa.", "train")]
    got = {r.sample_id: r.defect for r in qa_defects.defective_pairs(messages(spark, rows), model).collect()}
    assert got == {1: "refusal"}  # a model without text tells no languages apart


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_partners_share_a_key_of_parts(similarity):
    import numpy as np

    rng = random.Random(8)
    for seed in range(2):
        for n in (1, 2, 6, 9, 14, 17, 23, 40, 75, 130):
            for _ in range(30):
                a = rng.sample(range(10**9), n)
                b = a[rng.randint(0, max(0, n // 8)) :] + rng.sample(range(10**9), rng.randint(0, max(1, n // 8)))
                flat, offsets = np.array(a + b, dtype=np.int64), np.array([0, len(a), len(a) + len(b)])
                key, row = setjoin._part_keys(flat, offsets, similarity, seed)
                if b and set(a) != set(b) and len(set(a) & set(b)) >= similarity * len(set(a) | set(b)):
                    assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_sets_without_a_partner_are_not_copied_to_cells(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, ",".join(rng.sample([f"t{k}" for k in range(5000)], 15)), None, 1) for i in range(600)]
    rows += [(1000 + i, rows[i][1] + ",more", None, 1) for i in range(10)]
    written = {}

    def counted(df, name, f=setjoin.materialize):
        out = f(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(setjoin, "materialize", counted)
    got = {(r.id_a, r.id_b) for r in setjoin.similar_pairs(perfumes(spark, rows), "perfume_id", ["accords_csv", "notes_csv"], "ingested_at").collect()}
    assert got == {(i, 1000 + i) for i in range(10)}
    assert written["classes"] == 610 and written["sets"] < 305
