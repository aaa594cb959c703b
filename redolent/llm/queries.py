"""The queries of this package, each over its whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redolent.llm import bpe, canonical, contamination, language, packing, qa_defects, setjoin
from redolent.llm import term_frequency as tf
from redolent.session import materialize, table

CSV_FIELDS = ["accords_csv", "notes_csv"]


def p1_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of accords and notes with its occurrences, its perfumes and its mark (null: useful)."""
    return tf.term_frequency(table(spark, d, "perfumes"), "perfume_id", CSV_FIELDS, "ingested_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms too rare or too common to help retrieval."""
    return p1_terms(spark, d).where("mark IS NOT NULL").select("field", "term", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The records whose answer is unusable, and how."""
    model = language.fit(table(spark, d, "documents"), table(spark, d, "language_codes"))
    return qa_defects.defective_pairs(table(spark, d, "sample_messages"), model)


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    """Defective records by kind."""
    return p2_found(spark, d).groupBy("defect").agg(F.count("*").alias("records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """What each typed brand, name and reference means."""
    return canonical.map_values(table(spark, d, "perfumes"), table(spark, d, "retrieval_eval_cases"), table(spark, d, "brand_list"), table(spark, d, "label_list"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """How many typed values of each field have no entry in their list, and how many have one."""
    return p3_found(spark, d).groupBy("field").agg(F.count("*").alias("typed"), F.count_if(F.col("ref_id") == 0).alias("unmatched"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of perfumes whose accords and notes are nearly the same set."""
    return setjoin.similar_pairs(table(spark, d, "perfumes"), "perfume_id", CSV_FIELDS, "ingested_at", similarity=0.8, least=6, names=("perfume_id_a", "perfume_id_b"))


def _p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return setjoin.set_classes(table(spark, d, "perfumes"), "perfume_id", CSV_FIELDS, "ingested_at", 6)


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different, nearly equal sets, by the least perfume of each, with the number of perfumes that have the set."""
    links = setjoin.class_links(_p4_classes(spark, d), 0.8)
    return links.select(F.col("a").alias("perfume_id_a"), F.col("b").alias("perfume_id_b"), "copies_a", "copies_b")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """The set class of every perfume with at least six terms, its copies and its number of links."""
    own = _p4_classes(spark, d)
    return setjoin.memberships(own, materialize(setjoin.class_links(own, 0.8), "sized")).select(F.col("id").alias("perfume_id"), F.col("cls").alias("class_id"), "copies", "links")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The close pairs of a training record and one of validation or test."""
    links = contamination.overlaps(contamination.overlap_classes(table(spark, d, "sample_messages")))
    return links.select(F.least("train_id", "eval_id").alias("sample_id_a"), F.greatest("train_id", "eval_id").alias("sample_id_b"))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """The close pairs of a training and an evaluation class of equal records, by their least ids, with word edits and copies."""
    return contamination.overlap_classes(table(spark, d, "sample_messages")).links


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of every record long enough, its copies, and how many records of the other side it is close to."""
    return contamination.memberships(contamination.overlap_classes(table(spark, d, "sample_messages")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records that stand in the training split, by split and source."""
    return contamination.counts(contamination.overlap_classes(table(spark, d, "sample_messages")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_corpus(table(spark, d, "documents"))


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Which training sequence each document, or piece of one, stands in, for each capacity."""
    return packing.pack(bpe.count_tokens(table(spark, d, "documents")), table(spark, d, "pack_limits"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Sequences, items and unused positions of each capacity."""
    return packing.report(materialize(p7_sequences(spark, d), "packed"), table(spark, d, "pack_limits"))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """The language of every document with words (seg_no 0) and of each of its stretches, with confidence."""
    found = language.languages_of(table(spark, d, "documents"), table(spark, d, "language_codes"))
    return found.select("doc_id", "seg_no", "lang", "confidence", "chars")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of documents with a missing or wrong label, and the stretches of mixed documents."""
    found = language.languages_of(table(spark, d, "documents"), table(spark, d, "language_codes"))
    return language.missing_or_wrong(found).select("doc_id", "seg_no", "lang")


_FOLD = "trim(regexp_replace(strip_accents(translate(lower(nfc_normalize({})), 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９', 'abcdefghijklmnopqrstuvwxyz0123456789')), '[^a-z0-9]+', ' ', 'g'))"
_ONCE = """one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY perfume_id ORDER BY ingested_at DESC NULLS LAST, accords_csv DESC NULLS LAST, notes_csv DESC NULLS LAST) AS rn
 FROM perfumes WHERE perfume_id IS NOT NULL) WHERE rn = 1),
item AS (SELECT perfume_id, 'accords_csv' AS field, unnest(string_split(accords_csv, ',')) AS x FROM one UNION ALL SELECT perfume_id, 'notes_csv', unnest(string_split(notes_csv, ',')) FROM one),
folded AS (SELECT perfume_id, field, """ + _FOLD.format("x") + """ AS term FROM item)"""
_TERMS = f"""WITH {_ONCE},
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT perfume_id) AS records FROM folded WHERE term <> '' GROUP BY field, term),
marked AS (SELECT *, CASE WHEN records < 5 THEN 'rare' WHEN records > 0.1 * (SELECT count(DISTINCT perfume_id) FROM perfumes) THEN 'common' END AS mark FROM counts)
"""

_SIMILAR = f"""WITH {_ONCE},
member AS (SELECT DISTINCT perfume_id, field, term FROM folded WHERE term <> ''),
sized AS (SELECT perfume_id, count(*) AS n FROM member GROUP BY perfume_id HAVING count(*) >= 6),
own AS (SELECT m.*, n FROM member m JOIN sized USING (perfume_id)),
pair AS (SELECT a.perfume_id AS perfume_id_a, b.perfume_id AS perfume_id_b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb
 FROM own a JOIN own b ON a.field = b.field AND a.term = b.term AND a.perfume_id < b.perfume_id AND b.n >= 0.8 * a.n AND a.n >= 0.8 * b.n GROUP BY 1, 2),
found AS (SELECT * FROM pair WHERE shared * 10 >= 8 * (na + nb - shared)),
equal AS (SELECT * FROM found WHERE shared = na AND shared = nb),
cls AS (SELECT s.perfume_id, least(s.perfume_id, coalesce(min(e.perfume_id_a), s.perfume_id)) AS class_id FROM sized s LEFT JOIN equal e ON e.perfume_id_b = s.perfume_id GROUP BY s.perfume_id),
copies AS (SELECT class_id, count(*) AS copies FROM cls GROUP BY class_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_counts, p3_found, p3_unmatched, p4_found, p4_links, p4_members, p5_found, p5_links, p5_members, p5_counts, p6_ids, p7_sequences, p7_fill, p8_found, p8_languages)}

SQL: dict[str, str] = {
    "p1_found": _TERMS + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p1_terms": _TERMS + "SELECT field, term, occurrences, records, mark FROM marked",
    "p4_found": _SIMILAR + "SELECT perfume_id_a, perfume_id_b FROM found",
    "p4_links": _SIMILAR + "SELECT DISTINCT perfume_id_a, perfume_id_b, ca.copies AS copies_a, cb.copies AS copies_b FROM found JOIN copies ca ON ca.class_id = perfume_id_a JOIN copies cb ON cb.class_id = perfume_id_b WHERE NOT (shared = na AND shared = nb)",
    "p4_members": _SIMILAR + ", ends AS (SELECT perfume_id_a AS perfume_id FROM found UNION ALL SELECT perfume_id_b FROM found), deg AS (SELECT perfume_id, count(*) AS links FROM ends GROUP BY 1) SELECT perfume_id, class_id, copies, coalesce(links, 0) AS links FROM cls JOIN copies USING (class_id) LEFT JOIN deg USING (perfume_id)",
}
