"""Entity resolution: hints to catalog items, in stages; each stage sees only the hints that are still open."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redolent.operators.relational import dominant
from redolent.session import materialize

#: Concentration spellings (folded) and what they stand for.
CONCENTRATIONS = ((r"\be ?d ?p\b|\bepd\b", "eau de parfum"), (r"\be ?d ?t\b|\betd\b", "eau de toilette"), (r"\be ?d ?c\b", "eau de cologne"), (r"\bparfume\b", "parfum"))
#: Words that tell editions apart, and words that say nothing about identity.
EDITIONS = "edp edt edc extrait parfum cologne absolu absolute elixir extreme fraiche intense limited edition oil sport spray".split()
#: The least sequence ratio at which a name answers a hint, and the least resolution score.
LEAST_RATIO, LEAST_SCORE = 0.6, 0.6
#: Short names of houses that their initials don't give.
CURATED = {"armani": "giorgio armani", "cdg": "comme des garcons", "ch": "carolina herrera", "d g": "dolce gabbana", "dg": "dolce gabbana", "jpg": "jean paul gaultier", "lv": "louis vuitton", "mfk": "maison francis kurkdjian", "pdm": "parfums de marly", "tf": "tom ford", "ysl": "yves saint laurent"}
CONNECTORS = "a by de des du for le la of pour the".split()


def expand_concentrations(folded: Column) -> Column:
    for pattern, full in CONCENTRATIONS:
        folded = F.regexp_replace(folded, pattern, full)
    return folded


def signature(folded: Column) -> tuple[Column, Column]:
    """(core words, edition words) of a name: what identifies it and which edition it is."""
    short = expand_concentrations(folded)
    for full, mark in (("extrait de parfum", "extrait"), ("eau de parfum", "edp"), ("eau de toilette", "edt"), ("eau de cologne", "edc")):
        short = F.regexp_replace(short, rf"\b{full}\b", mark)
    words = F.filter(F.split(short, " "), lambda w: w != "")
    editions, skip = F.array(*map(F.lit, EDITIONS)), F.array(*map(F.lit, [*EDITIONS, *CONNECTORS]))
    return F.filter(words, lambda w: ~F.array_contains(skip, w)), F.array_intersect(words, editions)


def split_hint(folded: Column) -> tuple[Column, Column]:
    """(name, brand) of 'name by brand' at the last ' by '; brand null without one."""
    name, brand = F.regexp_extract(folded, r"^(.*) by (.*)$", 1), F.regexp_extract(folded, r"^(.*) by (.*)$", 2)
    both = (F.trim(name) != "") & (F.trim(brand) != "")
    return F.when(both, F.trim(name)).otherwise(folded), F.when(both, F.trim(brand))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (Ratcliff and Obershelp), in Arrow batches; null if one is."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def ratio_from(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The sequence ratio where it can be `least` or more by the letters of both texts, else null; null for empty texts."""
    letters = {x: Counter(x) for x in {*a, *b}}

    def ratio(x: str, y: str, low: float) -> float | None:
        if not x or not y or 2.0 * min(len(x), len(y)) < low * (len(x) + len(y)):
            return None
        p, q = letters[x], letters[y]
        if 2.0 * sum(min(n, q[c]) for c, n in p.items() if c in q) / (len(x) + len(y)) < low:
            return None
        return difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([ratio(x, y, low) for x, y, low in zip(a, b, least, strict=True)], dtype="float64")


def ratio_if_close(a: Column, b: Column, least: float = LEAST_RATIO) -> Column:
    """The sequence ratio where it can be `least` or more by the letters of both texts, else null."""
    return ratio_from(a, b, F.lit(least))


def deletions(text: Column, most: int = 2) -> Column:
    """array<string>: a text and all that is left of it with up to `most` letters taken out (1 + n + n(n-1)/2 for two)."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    level = F.array(text)
    out = [level]
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out.append(level)
    return F.array_distinct(F.concat(*out))


def within_edits(left: DataFrame, right: DataFrame, a: str, b: str, most: int = 2) -> DataFrame:
    """All pairs of texts of two tables that differ by at most `most` edits, with their distance; columns of both are kept.

    Texts within n edits have a text in common that each gives with at most n letters taken out, so an equality join on these
    finds every pair, whichever letters are wrong. Both sides should hold distinct texts."""
    l = left.select("*", F.explode(deletions(F.col(a), most)).alias("_k"))  # noqa: E741
    r = right.select("*", F.explode(deletions(F.col(b), most)).alias("_k"))
    pairs = l.join(r, "_k").drop("_k").distinct()
    return pairs.withColumn("distance", F.levenshtein(a, b, most)).where("distance >= 0")


def brand_totals(items: DataFrame) -> DataFrame:
    """(brand_norm, brand, total): each brand's popularity and its most popular spelling."""
    spelled = items.where("coalesce(trim(brand), '') <> ''").groupBy("brand_norm", F.trim("brand").alias("brand")).agg(F.sum("popularity").alias("n"))
    return spelled.groupBy("brand_norm").agg(F.max_by("brand", F.struct("n", "brand")).alias("brand"), F.sum("n").alias("total"))


def alias_index(items: DataFrame, curated: dict[str, str] | None = None) -> DataFrame:
    """(alias, brand_norm): folded names and initials of brands; an alias of several brands is none.

    curated: aliases that hold whatever the catalog's initials say, as far as their brand is in the catalog."""
    words = F.split("brand_norm", " ")
    initials = F.transform(words, lambda w: F.substring(w, 1, 1))
    short = F.when((F.size(words) >= 2) & (F.size(words) <= 5), F.array(F.col("brand_norm"), F.array_join(initials, ""), F.array_join(initials, " "))).otherwise(F.array(F.col("brand_norm")))
    totals = brand_totals(items)
    pairs = totals.select("brand_norm", F.explode(short).alias("alias")).where("alias <> ''")
    own = pairs.groupBy("alias").agg(F.min("brand_norm").alias("brand_norm"), F.count_distinct("brand_norm").alias("_n")).where("_n = 1").drop("_n")
    if not curated:
        return own
    fixed = items.sparkSession.createDataFrame(sorted(curated.items()), "alias string, brand_norm string").join(totals.select("brand_norm"), "brand_norm", "left_semi").select("alias", "brand_norm")
    return own.join(fixed, "alias", "left_anti").unionByName(fixed)


def edge_brand(hints: DataFrame, aliases: DataFrame, key: str = "hint_id", text: str = "hint_norm", width: int = 5) -> DataFrame:
    """Hints with the brand at their beginning or end: the longest alias wins, then the longer rest."""
    words = F.split(text, " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(width), F.size(words))), lambda n: F.array(F.struct(n.alias("n"), F.array_join(F.slice(words, 1, n), " ").alias("alias"), F.array_join(F.slice(words, n + 1, F.size(words)), " ").alias("rest")), F.struct(n.alias("n"), F.array_join(F.slice(words, -n, n), " ").alias("alias"), F.array_join(F.slice(words, 1, F.size(words) - n), " ").alias("rest")))))
    found = hints.select(key, text, F.inline(spans)).join(aliases, "alias")
    rest = F.regexp_replace("rest", "^s ", "")
    best = found.groupBy(key).agg(F.max_by(F.struct("brand_norm", rest.alias("name_hint")), F.struct("n", F.length(rest), "alias", rest)).alias("_b"))
    return hints.join(best, key, "left").select(*[hints[c] for c in hints.columns], F.col("_b.brand_norm").alias("brand_hint"), F.coalesce("_b.name_hint", F.col(text)).alias("name_hint"))


def best_item(candidates: DataFrame, key: str) -> DataFrame:
    """The most popular candidate of each hint."""
    w = Window.partitionBy(key).orderBy(F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id"))
    return candidates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_core(df: DataFrame, name: str, core: str) -> DataFrame:
    """A table of distinct texts with the core words of each, so that a join of them needn't find them again for every pair."""
    return df.withColumn(core, F.array_distinct(signature(F.col(name))[0]))


def scored_pairs(pairs: DataFrame, hint: str, brand_hint: str) -> DataFrame:
    """pairs (hint, brand hint, _h, name_norm, brand_norm, popularity, _n, ...) with their resolution score; those that can't
    reach LEAST_SCORE are left out. _h, _n: the core words of hint and name.

    Where cores share a word it takes cores half alike; where they share none, a ratio of 0.72, as all below is penalised."""
    both, own = F.size(F.array_intersect("_h", "_n")), F.size("_h")
    marked = pairs.withColumns({"_both": both, "_covered": both >= F.greatest(own, F.lit(1)) * 0.5})
    least = F.when(F.col("_covered"), F.lit(2.0)).when(F.col("_both") > 0, F.lit(0.5)).otherwise(F.lit(0.72))  # 2: the ratio isn't asked for
    # no ratio is above that of the lengths
    a, b = F.length(F.array_join("_h", " ")), F.length(F.array_join("_n", " "))
    bare = (own == 0) | (F.size("_n") == 0)
    marked = marked.withColumn("_least", least).where(F.col("_covered") | bare | (2.0 * F.least(a, b) >= F.col("_least") * (a + b)))
    sure = marked.where(F.col("_covered") | bare)
    asked = marked.where(~F.col("_covered") & ~bare).withColumn("_ratio", ratio_from(F.array_join("_h", " "), F.array_join("_n", " "), F.col("_least")))
    near = sure.select(*pairs.columns).unionByName(asked.where(F.col("_ratio") >= F.col("_least")).select(*pairs.columns))
    return near.withColumn("score", resolution_score(hint, brand_hint)).drop("_h", "_n")


def score_finalists(hints: DataFrame, names: DataFrame, chunks: int, blocks: int) -> DataFrame:
    """(t, at): for each hint t the names (their ids in `at`) that may have its best resolution score, LEAST_SCORE at least, among
    all names that share a key with it; ties and all within MARGIN of the best of their block come out.

    hints (t, hint, brand_hint, keys), names (at long, name_norm, brand_norm, popularity, keys). Chunks of hints meet blocks of
    names. A pair costs a few vector operations on letter counts, which bound its ratios from above; ratios are taken in the
    order of these bounds until none left can be the best."""
    from redolent.operators.scoring import popularity_score

    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.array(*map(F.lit, range(n))))

    def parts(df: DataFrame, text: str) -> DataFrame:
        core, editions = signature(F.col(text))
        return df.withColumns({"core": core, "editions": editions})

    left = parts(hints, "hint").select("t", "brand_hint", "keys", "core", "editions", expand_concentrations(F.col("hint")).alias("full"), part("t", chunks).alias("chunk"))
    right = parts(names, "name_norm").select("at", "brand_norm", popularity_score(F.col("popularity")).alias("known"), "keys", "core", "editions", F.col("name_norm").alias("full"), part("at", blocks).alias("block"))
    left, right = left.select("*", each(blocks).alias("block")), right.select("*", each(chunks).alias("chunk"))
    return left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(_score_block, "t string, at long")


#: Scores this near to each other are told apart by the caller, who rounds them to six places.
MARGIN = 2e-6
_LETTERS = 38


def _letter_counts(texts: list[str]) -> np.ndarray:
    """(texts x letters) counts of a-z, 0-9, space and all else."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    kind = np.select([(code >= 97) & (code <= 122), (code >= 48) & (code <= 57), code == 32], [code - 97, code - 48 + 26, 36], _LETTERS - 1)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    return np.bincount(row * _LETTERS + kind, minlength=len(texts) * _LETTERS).reshape(-1, _LETTERS).astype(np.int32)


def _postings(lists: list[list[str]]) -> dict[str, np.ndarray]:
    out: dict[str, list[int]] = {}
    for i, words in enumerate(lists):
        for w in set(words):
            out.setdefault(w, []).append(i)
    return {w: np.array(rows, dtype=np.int64) for w, rows in out.items()}


def _score_block(hints: pa.Table, names: pa.Table) -> pa.Table:
    n = names.num_rows
    found_t: list[str] = []
    found_at: list[int] = []
    if n and hints.num_rows:
        bits = {e: 1 << i for i, e in enumerate(EDITIONS)}
        strong = sum(bits[e] for e in ("edp", "edt", "edc", "extrait", "parfum", "cologne"))
        marks = lambda editions: sum(bits[e] for e in set(editions))
        at, brands, known = names["at"].to_pylist(), np.array(names["brand_norm"].to_pylist(), dtype=object), names["known"].to_numpy()
        cores, full = names["core"].to_pylist(), names["full"].to_pylist()
        joined = [" ".join(c) for c in cores]
        by_key, by_core = _postings(names["keys"].to_pylist()), _postings(cores)
        n_size = np.array([len(set(c)) for c in cores], dtype=np.int64)
        n_marks = np.array([marks(e) for e in names["editions"].to_pylist()], dtype=np.int64)
        c_len, f_len = np.array([len(x) for x in joined]), np.array([len(x) for x in full])
        c_count, f_count = _letter_counts(joined), _letter_counts(full)
        seen, shared = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        for h in hints.to_pylist():
            h_join, h_core, h_marks = " ".join(h["core"]), set(h["core"]), marks(h["editions"])
            rows = [by_key[k] for k in h["keys"] if k in by_key]
            for r in rows:
                seen[r] = True
            own = np.flatnonzero(seen)
            seen[own] = False
            for w in h_core:
                shared[by_core.get(w, none)] += 1
            both = shared[own]
            for w in h_core:
                shared[by_core.get(w, none)] = 0
            m = len(h_core)
            words = np.maximum(both / np.maximum(m + n_size[own] - both, 1), both / max(m, 1))  # overlap, coverage
            kept = np.bitwise_count(n_marks[own] & h_marks) / max(h_marks.bit_count(), 1)
            asked = h_marks != 0
            h_c, n_c = h_marks & strong, n_marks[own] & strong
            edition = kept if asked else np.full(len(own), 0.5)
            fit = 0.5 if h["brand_hint"] is None else (brands[own] == h["brand_hint"]).astype(float)
            rest = fit * 0.07 + known[own] * 0.03 - (0.06 * (1 - kept) if asked else 0.0) - np.where((h_c != 0) & (n_c != 0) & (n_c & h_c == 0), 0.32, 0.0)
            strange = (both == 0) & (m > 0) & (n_size[own] > 0)

            def score(ratio, of_full, on, words=words, edition=edition, rest=rest, strange=strange):
                core = np.maximum(ratio, words[on])
                return (core * 0.9 + of_full * 0.1) * 0.72 + edition[on] * core * 0.18 + rest[on] - np.where(strange[on] & (ratio < 0.72), 0.38, 0.0)

            def bound(shorter, a, b):
                return np.where(a + b > 0, 2.0 * shorter / np.maximum(a + b, 1), 1.0)

            every, h_full = np.arange(len(own)), h["full"]
            least = max(LEAST_SCORE, float(score(np.zeros(len(own)), 0.0, every).max(initial=0.0))) - MARGIN
            a, b = c_len[own], f_len[own]
            most = score(bound(np.minimum(a, len(h_join)), a, len(h_join)), bound(np.minimum(b, len(h_full)), b, len(h_full)), every)
            on = np.flatnonzero(most >= least)
            counts = _letter_counts([h_join, h_full])
            for first in range(0, len(on), 8192):  # so that the counts of a common word's names take bounded memory
                some = on[first : first + 8192]
                c = np.minimum(c_count[own[some]], counts[0]).sum(axis=1)
                f = np.minimum(f_count[own[some]], counts[1]).sum(axis=1)
                most[some] = score(bound(c, a[some], len(h_join)), bound(f, b[some], len(h_full)), some)
            on = on[np.argsort(-most[on], kind="stable")]
            exact: list[tuple[float, int]] = []
            ratios: dict[tuple[str, str], float] = {}

            def ratio(x: str, y: str, ratios=ratios) -> float:
                if (x, y) not in ratios:
                    ratios[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
                return ratios[x, y]

            for i in on.tolist():
                if most[i] < least:
                    break
                j = own[i]
                value = float(score(ratio(h_join, joined[j]), ratio(h_full, full[j]), i))
                least = max(least, value - MARGIN)
                exact.append((value, at[j]))
            best = [x for value, x in exact if value >= least]
            found_t += [h["t"]] * len(best)
            found_at += best
    return pa.table({"t": pa.array(found_t, pa.string()), "at": pa.array(found_at, pa.int64())})


def _ranked(rest: DataFrame, cols: DataFrame, house: str | None, stage: str, salts: int = 8) -> DataFrame:
    """(hint_id, perfume_id, stage): the item with the best resolution score of each hint, LEAST_SCORE at least, among the items
    of its house or, without one, those that share a word of two letters or more with it in name or brand.

    Distinct hints meet distinct pairs of name and brand, of which only the most popular item can win; common keys are dealt
    over salts."""
    words = lambda *c: F.explode(F.array_distinct(F.filter(F.split(F.concat_ws(" ", *c), " "), lambda x: F.length(x) > 1))).alias("w")
    own = cols.where("name_norm IS NOT NULL").groupBy("name_norm", "brand_norm").agg(F.max(F.struct("popularity", (-F.col("perfume_id")).alias("minus"))).alias("item"))
    own = own.select("name_norm", "brand_norm", F.col("item.popularity").alias("popularity"), F.col("item.minus").alias("minus"))
    asked = rest.select("name_hint", F.col(house).alias("house") if house else F.lit(None).cast("string").alias("house")).distinct()
    asked, own = materialize(with_core(asked, "name_hint", "_h"), "asked"), materialize(with_core(own, "name_norm", "_n"), "names")
    left = asked.select("*", F.col("house").alias("w")) if house else asked.select("*", words("name_hint"))
    right = own.select("*", F.col("brand_norm").alias("w") if house else words("name_norm", "brand_norm")).withColumn("salt", F.pmod(F.xxhash64("name_norm"), F.lit(salts)))
    pairs = left.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))).join(right, ["w", "salt"]).drop("w", "salt")
    pairs = materialize(pairs if house else pairs.distinct(), "pairs")
    scored = scored_pairs(pairs, "name_hint", "house").where(F.col("score") >= LEAST_SCORE)
    best = scored.groupBy("name_hint", "house").agg(F.max(F.struct("score", "popularity", "minus")).alias("b"))
    same = rest["name_hint"] == best["name_hint"]
    found = rest.join(best, same & (rest[house] == best["house"]) if house else same)
    return found.select("hint_id", (-F.col("b.minus")).alias("perfume_id"), F.lit(stage).alias("stage"))


def resolve(hints: DataFrame, items: DataFrame, least: int = 500, fuzzy: bool = False) -> DataFrame:
    """(hint_id, perfume_id, stage): hints (hint_id, hint_norm, folded) to items.

    Stages: exact name or label; name and brand; a dominant member of the family of names that begin with the hint; with
    fuzzy, the best resolution score (0.6 at least) among all items of the hint's brand or, if it names no known one, among all
    items that share a word of two letters or more with it. Each stage takes what is still open and is written once, as the
    later ones read it. Hints of a known brand by a curated alias are of that brand.
    """
    cols = items.select("perfume_id", "name_norm", "brand_norm", "label_norm", "popularity", "rating")
    name, brand = split_hint(F.col("hint_norm"))
    open_hints = hints.select("hint_id", "hint_norm", name.alias("name_hint"), brand.alias("brand_hint"))
    by_name = open_hints.join(cols, F.col("hint_norm") == F.col("name_norm")).select("hint_id", *cols.columns)
    by_label = open_hints.withColumn("_l", F.concat_ws(" ", "name_hint", "brand_hint")).join(cols, F.col("_l") == F.col("label_norm")).select("hint_id", *cols.columns)
    exact = materialize(best_item(by_name.unionByName(by_label), "hint_id").select("hint_id", "perfume_id", F.lit("exact").alias("stage")), "exact")
    rest = open_hints.join(exact, "hint_id", "left_anti")
    branded = rest.where("brand_hint IS NOT NULL").join(cols, (F.col("name_hint") == F.col("name_norm")) & F.startswith(F.col("brand_norm"), F.col("brand_hint")))
    second = best_item(branded.select("hint_id", *cols.columns), "hint_id").select("hint_id", "perfume_id", F.lit("branded").alias("stage"))
    second = materialize(second, "branded")
    rest = rest.join(second, "hint_id", "left_anti")
    # a family is found by equality: every item offers its name's leading words
    heads = cols.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name_norm", " "))), lambda n: F.array_join(F.slice(F.split("name_norm", " "), 1, n), " "))).alias("head")).where("head <> name_norm")
    family = dominant(rest.join(heads, F.col("name_hint") == F.col("head")).select("hint_id", *cols.columns), ["hint_id"], least)
    clear = F.col("outcome") == "dominant"
    third = family.select("hint_id", F.when(clear, F.col("perfume_id")).alias("perfume_id"), F.when(clear, F.lit("family")).otherwise(F.lit("ambiguous")).alias("stage"))
    third = materialize(third, "family") if fuzzy else third
    out = exact.unionByName(second).unionByName(third)
    if fuzzy:
        rest = rest.join(third, "hint_id", "left_anti")
        known = alias_index(items, CURATED).select(F.col("alias").alias("brand_hint"), F.col("brand_norm").alias("house"))
        rest = materialize(rest.select("hint_id", "name_hint", "brand_hint").join(known, "brand_hint", "left"), "open")
        out = out.unionByName(_ranked(rest.where("house IS NOT NULL"), cols, "house", "brand"))
        out = out.unionByName(_ranked(rest.where("house IS NULL"), cols, None, "fuzzy"))
    return hints.select("hint_id").join(out, "hint_id", "left").select("hint_id", "perfume_id", F.coalesce("stage", F.lit("unresolved")).alias("stage"))


def resolution_score(hint: str, brand_hint: str, name: str = "name_norm", brand: str = "brand_norm", popularity: str = "popularity") -> Column:
    """How well an item answers a hint (column names): the core of the name first, then edition, brand and popularity.

    Editions that contradict the hint's concentration, and cores without a common word, are held against it."""
    from redolent.operators.scoring import popularity_score

    h_core, h_ed = signature(F.col(hint))
    n_core, n_ed = signature(F.col(name))
    size = lambda a: F.size(F.array_distinct(a))
    both = F.size(F.array_intersect(h_core, n_core))
    overlap, coverage = both / F.greatest(F.size(F.array_union(h_core, n_core)), F.lit(1)), both / F.greatest(size(h_core), F.lit(1))
    core_ratio = sequence_ratio(F.array_join(h_core, " "), F.array_join(n_core, " "))
    full_ratio = sequence_ratio(expand_concentrations(F.col(hint)), F.col(name))
    core = F.greatest(core_ratio, overlap, coverage)
    apart = (size(h_core) > 0) & (size(n_core) > 0) & (both == 0) & (core_ratio < 0.72)
    asked = size(h_ed) > 0
    kept = F.size(F.array_intersect(h_ed, n_ed)) / F.greatest(size(h_ed), F.lit(1))
    strengths = F.array(*map(F.lit, ("edp", "edt", "edc", "extrait", "parfum", "cologne")))
    h_c, n_c = F.array_intersect(h_ed, strengths), F.array_intersect(n_ed, strengths)
    clash = (F.size(h_c) > 0) & (F.size(n_c) > 0) & ~F.arrays_overlap(h_c, n_c)
    edition = F.when(asked, kept).otherwise(F.lit(0.5))
    penalty = F.when(asked, 0.06 * (1 - kept)).otherwise(F.lit(0.0)) + F.when(clash, F.lit(0.32)).otherwise(F.lit(0.0)) + F.when(apart, F.lit(0.38)).otherwise(F.lit(0.0))
    brand_fit = F.when(F.col(brand_hint).isNull(), F.lit(0.5)).when(F.col(brand_hint) == F.col(brand), F.lit(1.0)).otherwise(F.lit(0.0))
    return (core * 0.9 + full_ratio * 0.1) * 0.72 + edition * core * 0.18 + brand_fit * 0.07 + popularity_score(F.col(popularity)) * 0.03 - penalty
