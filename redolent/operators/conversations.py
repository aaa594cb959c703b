"""Conversation records: building, validating, auditing and splitting them, and scoring answers against their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES_OK = (("system", "user", "model"), ("system", "user", "assistant"))
#: Marker words of the two languages answers are checked for.
EN_MARKERS = "the and with for that this you from which but".split()
TR_MARKERS = "ve ile bir bu için ama daha çok kadar gibi".split()


def messages(system: Column, question: Column, answer: Column, context: Column | None = None, role: str = "model") -> Column:
    """array<struct<role, content>> of one training record; a context goes before the question."""
    asked = F.concat_ws("\n\n", context, question) if context is not None else question
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", system), ("user", asked), (role, answer))])


def convert_roles(msgs: Column, old: str = "assistant", new: str = "model") -> Column:
    return F.transform(msgs, lambda m: F.struct(F.when(m["role"] == old, F.lit(new)).otherwise(m["role"]).alias("role"), m["content"].alias("content")))


def valid_record(msgs: Column) -> Column:
    """Three messages in the right order, none empty."""
    roles = F.transform(msgs, lambda m: m["role"])
    order = (roles == F.array(*map(F.lit, ROLES_OK[0]))) | (roles == F.array(*map(F.lit, ROLES_OK[1])))
    return (F.size(msgs) == 3) & order & F.forall(msgs, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) != "")


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters and apostrophes, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)


def opening(text: Column, n: int) -> Column:
    """The first n words."""
    return F.array_join(F.slice(words(text), 1, n), " ")


def marker_language(text: Column) -> Column:
    """'en' or 'tr' by marker words (repeats count) and Turkish letters."""
    tokens = F.split(F.lower(text), r"[^a-zçğıöşüâîû']+")
    hits = lambda ms: F.size(F.filter(tokens, lambda t: t.isin(*ms)))
    turkish = hits(TR_MARKERS) + F.length(F.regexp_replace(F.lower(text), "[^çğış]", ""))
    return F.when(turkish > hits(EN_MARKERS), "tr").otherwise("en")


def numbered_items(answer: Column) -> Column:
    """The titles of numbered lines of an answer."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"(?m)^\s*\d+[.)]\s*(.+)$"), 1), lambda x: F.trim(x))


def listed_items(answer: Column) -> Column:
    """The titles of numbered or bulleted lines, up to the first mark after the title."""
    lines = F.regexp_extract_all(answer, F.lit(r"(?m)^\s*(?:\d+[.)]|[-•*])\s*(.+)$"), 1)
    return F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^(.*?)(?:,|:| - |$)", 1)))


#: Claims that no record supports, names of internal categories, and phrases that generated answers wear out.
UNSUPPORTED_CLAIMS = (r"\$\d+", r"(?i)\bprice\b", r"(?i)\bbudget\b", r"(?i)\bguaranteed compliments?\b", r"(?i)\bcompliment beast\b")
INTERNAL_LABELS = (r"\bwinter_evening\b", r"\bdate_night\b", r"\bgym_after\b", r"\bsummer_day\b")
WORN_PHRASES = (r"(?i)which makes it a grounded fit for the request", r"(?i)Based on your preferences, I would prioritize perfumes that fit the .* direction")
#: The parts of an answer: the name of a numbered 'name by brand' line, such a line, and the pick.
NAME_LINE, ITEM_LINE, PICK_LINE = r"(?m)^[ \t]*\d+[.)][ \t]+(.+?) by .+$", r"(?m)^[ \t]*\d+[.)][ \t]+(.+? by .+)$", r"(?m)^[ \t]*Best pick:[ \t]+(.+? by .+)$"


def answer_rules(level: str, question: Column, answer: Column, cards: Column) -> dict[str, Column]:
    """The rules of answers of a level (L3, L4, L5) by name: true where one is broken.

    cards: the lower-case names of the cards in the question (empty without cards). L3 answers are numbered lines of 'name by
    brand' and nothing else; L4 and L5 answers have such lines, a pick among them and a reason, claim nothing the records don't
    hold, and, for L5, answer a question with a user profile."""
    found = lambda pattern: F.transform(F.regexp_extract_all(answer, F.lit(pattern), 1), lambda x: F.lower(F.trim(x)))
    has = lambda patterns: F.exists(F.array(*[F.regexp(answer, F.lit(p)) for p in patterns]), lambda x: x)
    names, items = found(NAME_LINE), found(ITEM_LINE)
    lines = F.size(F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != ""))
    pick = F.lower(F.trim(F.regexp_extract(answer, PICK_LINE, 1)))
    outside = (F.size(cards) > 0) & F.exists(names, lambda n: ~F.array_contains(cards, n))
    if level == "L3":
        return {"list_format": (F.size(names) == 0) | (F.size(names) != lines), "rag_subset": outside}
    rules = {"format": (F.size(items) == 0) | ~F.contains(answer, F.lit("Why:")), "rag_subset": outside, "best_pick": (pick == "") | ~F.array_contains(items, pick), "unsupported_claim": has(UNSUPPORTED_CLAIMS)}
    if level == "L4":
        return rules | {"internal_label": has(INTERNAL_LABELS), "repetitive_phrase": has(WORN_PHRASES)}
    return rules | {"profile_block": ~F.contains(question, F.lit("[USER PROFILE]")) | ~F.contains(question, F.lit("[/USER PROFILE]"))}


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) over all rows in one pass: each rule is a column, nulls are no violation."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("violations")) for k in rules])))


def failures(rules: dict[str, Column]) -> Column:
    """The names of the rules a row breaks, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]))


def checks(named: dict[str, Column]) -> Column:
    """map<string, boolean> of the checks that apply: a null check is absent, which isn't the same as false."""
    return F.map_filter(F.create_map(*[x for k, c in named.items() for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())


def applicable_rate(df: DataFrame, check_map: str, names: list[str], empty: float = 1.0) -> Column:
    """Share of rows that have any of the checks in which all they have are true; `empty` without such rows."""
    has = F.coalesce(*[F.when(F.map_contains_key(check_map, n), F.lit(True)) for n in names], F.lit(False))
    good = F.lit(True)
    for n in names:
        good = good & F.coalesce(F.try_element_at(check_map, F.lit(n)), F.lit(True))
    return F.coalesce(F.count_if(has & good) / F.nullif(F.count_if(has), F.lit(0)), F.lit(empty))


def gates(metrics: DataFrame, table: dict[str, tuple[str, float]]) -> DataFrame:
    """(metric, value, op, threshold, passed) of a one-row table of metrics against its gates."""
    test = {">=": lambda v, t: v >= t, "<=": lambda v, t: v <= t, "==": lambda v, t: v == t}
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(op).alias("op"), F.lit(float(t)).alias("threshold"), test[op](F.col(m), F.lit(t)).alias("passed")) for m, (op, t) in table.items()]
    return metrics.select(F.inline(F.array(*rows)))


def duplicate_stats(df: DataFrame, key: str) -> DataFrame:
    """(rows, distinct_keys, repeated_rows, repeated_groups) of a key: rows beyond the first of each, and keys that repeat."""
    by = df.groupBy(key).agg(F.count("*").alias("n"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_rows"), F.count_if(F.col("n") > 1).alias("repeated_groups"))


def fingerprint(df: DataFrame, chunk: str, order: str, payload: Column) -> DataFrame:
    """(chunk, rows, fingerprint): one hash over a chunk's rows in order, built from row hashes so that no long text is gathered."""
    rows = df.select(chunk, order, F.sha2(payload, 256).alias("h"))
    ordered = F.array_sort(F.collect_list(F.struct(order, "h")))
    return rows.groupBy(chunk).agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("fingerprint"))
