"""The catalog as typed tables: items, edges, facets, labels, cards and documents for embedding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redolent.functions.text import folded_items


def last_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by `order`. One shuffle on the keys; Spark limits each task's groups before it."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def items(perfumes: DataFrame) -> DataFrame:
    """One row for each perfume: rows loaded again count once, popularity null is 0, CSV fields as folded distinct arrays."""
    own = last_wins(perfumes.where("perfume_id IS NOT NULL"), ["perfume_id"], [F.col("ingested_at").desc_nulls_last()])
    terms = {a: F.array_distinct(folded_items(F.col(c))) for a, c in (("accords", "accords_csv"), ("notes", "notes_csv"), ("seasons", "seasons_csv"), ("times", "time_profile_csv"))}
    return own.withColumns({**terms, "popularity": F.coalesce("popularity", F.lit(0)), "gender": F.lower(F.trim(F.coalesce("gender", F.lit(""))))})


def edges(similarity: DataFrame) -> DataFrame:
    """Directed edges, one for each (source, target): the latest load wins, null ids dropped, missing votes 0."""
    own = similarity.where("source_id IS NOT NULL AND target_id IS NOT NULL").withColumns({"up_votes": F.coalesce("up_votes", F.lit(0)), "down_votes": F.coalesce("down_votes", F.lit(0))})
    return last_wins(own, ["source_id", "target_id"], [F.col("ingested_at").desc_nulls_last(), F.col("up_votes").desc(), F.col("down_votes").desc()])


def facets(catalog: DataFrame) -> DataFrame:
    """(perfume_id, facet, pos, term): the inverted view of all multi-valued fields, for posting-list joins."""
    parts = [catalog.select("perfume_id", F.lit(f).alias("facet"), F.posexplode(f).alias("pos", "term")) for f in ("accords", "notes", "seasons", "times")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def label(name: Column, brand: Column, name_norm: Column, brand_norm: Column) -> Column:
    """Display label: the brand is left out where the name already is or ends with it."""
    bare = (F.trim(F.coalesce(brand, F.lit(""))) == "") | (name_norm == brand_norm) | F.endswith(name_norm, F.concat(F.lit(" by "), brand_norm))
    return F.when(bare, F.trim(name)).otherwise(F.concat(F.trim(name), F.lit(" by "), F.trim(brand)))


def or_unknown(value: Column, text: str = "not recorded") -> Column:
    """A value as text, or a fixed text where it is null or empty."""
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.lit(text))


def joined(terms: Column, sep: str = ", ") -> Column:
    """An array as text, null where it is empty (so that concat_ws drops the line)."""
    return F.nullif(F.array_join(terms, sep), F.lit(""))


def title(terms: Column) -> Column:
    """Each term with its first letter in upper case, the rest in lower case."""
    return F.transform(terms, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 10_000))))


def rating_text(rating: Column, votes: Column, denominator: int = 5) -> Column:
    """'4.12/5 (153 votes)', null without a rating or votes."""
    return F.when(rating.isNotNull() & (votes > 0), F.format_string(f"%.2f/{denominator} (%d votes)", rating, votes))


def card(catalog: DataFrame) -> DataFrame:
    """(perfume_id, card_text): the record card."""
    return catalog.select("perfume_id", card_text().alias("card_text"))


def card_text() -> Column:
    """The record card of an item; parts without data have no line."""
    line = lambda head, value: F.concat(F.lit(head), value)
    of_five = lambda c: F.when(F.col(c) > 0, F.format_string("%.2f/5", F.col(c)))
    performance = F.concat_ws(" | ", line("Longevity: ", of_five("longevity")), line("Sillage: ", of_five("sillage")))
    return F.concat_ws(
        "\n",
        line("Name: ", F.trim("name")),
        line("Brand: ", F.nullif(F.trim("brand"), F.lit(""))),
        line("Gender: ", F.nullif(F.col("gender"), F.lit(""))),
        line("Year: ", F.col("year").cast("string")),
        line("Accords: ", joined("accords")),
        line("Notes: ", joined("notes")),
        line("Seasons: ", joined(title(F.col("seasons")))),
        line("Rating: ", rating_text(F.col("rating"), F.col("popularity"))),
        F.nullif(performance, F.lit("")),
    )


def metric(card_text: Column, name: str, denominator: int = 5) -> Column:
    """The number of a 'Name: 3.21/5' mention in a card, case ignored; null if there is none."""
    return F.nullif(F.regexp_extract(card_text, rf"(?i){name}:\s*([\d.]+)/{denominator}", 1), F.lit("")).try_cast("double")


def card_list(card_text: Column, head: str) -> Column:
    """The items of a 'Head: a (80%), b' line of a card."""
    body = F.regexp_extract(card_text, rf"(?m)^{head}:(.*)$", 1)
    return F.filter(F.transform(F.split(body, ","), lambda x: F.trim(F.substring_index(x, " (", 1))), lambda x: x != "")


def context_cards(text: Column) -> Column:
    """array<string>: the cards of a [PERFUMES] block, one a line of 'Name: .. | Brand: .. | Notes: ..'."""
    block = F.regexp_extract(text, r"(?is)^\s*\[PERFUMES\]\s*(.*?)(?:\n\s*\n|\[/PERFUMES\]|$)", 1)
    return F.filter(F.split(block, r"\n"), lambda x: F.trim(x) != "")


def card_field(line: Column, name: str) -> Column:
    """One 'Name: value' segment of a card line."""
    return F.trim(F.regexp_extract(line, rf"(?i)(?:^|\|)\s*{name}\s*:\s*([^|]*)", 1))


def context_block(lines: Column) -> Column:
    """A [PERFUMES] block of card lines."""
    return F.concat(F.lit("[PERFUMES]\n"), F.array_join(lines, "\n"))


def embedding_document(catalog: DataFrame) -> DataFrame:
    """(perfume_id, document): the text that is embedded: the record card, then a line for each field with all of its terms; blank parts are dropped."""
    line = lambda head, value: F.concat(F.lit(head), value)
    fields = [line("Name: ", F.trim("name")), line("Brand: ", F.nullif(F.trim("brand"), F.lit(""))), line("Gender: ", F.nullif(F.col("gender"), F.lit("")))]
    fields += [line(head, joined(terms)) for head, terms in (("Accords: ", "accords"), ("Notes: ", "notes"), ("Best seasons: ", "seasons"), ("Time profile: ", "times"))]
    return catalog.select("perfume_id", F.concat_ws("\n", F.nullif(card_text(), F.lit("")), *fields).alias("document"))


def vector_metadata(catalog: DataFrame) -> DataFrame:
    """Scalar metadata beside a vector: one-hot seasons and times, top terms, missing rating 0."""
    hot = {f"season_{s}": F.array_contains("seasons", s) for s in ("spring", "summer", "autumn", "winter")} | {f"time_{t}": F.array_contains("times", t) for t in ("day", "night")}
    return catalog.select("perfume_id", F.coalesce("rating", F.lit(0.0)).alias("rating"), "popularity", F.try_element_at("accords", F.lit(1)).alias("top_accord"), F.try_element_at("notes", F.lit(1)).alias("top_note"), *[c.alias(k) for k, c in hot.items()])


def clean_markup(text: Column) -> Column:
    """Tags dropped, trimmed."""
    return F.trim(F.regexp_replace(text, "<.*?>", ""))


#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = "mr mrs ms dr st prof gen rep sen col capt ltd inc co vs eg ie ca approx est min max vol temp wt oz ml p.m a.m".split()


def first_sentences(text: Column, n: int = 2, fallback: int = 200) -> Column:
    """The first n sentences; points of abbreviations end none (and the abbreviation comes out in lower case)."""
    held = text
    for a in ABBREVIATIONS:
        held = F.regexp_replace(held, rf"(?i)\b{a.replace('.', '[.]')}\.", a.replace(".", "\x01") + "\x01")
    parts = F.slice(F.split(held, r"(?<=[.?!])\s+"), 1, n)
    found = F.trim(F.translate(F.array_join(parts, " "), "\x01", "."))
    return F.coalesce(F.nullif(found, F.lit("")), F.substring(text, 1, fallback))


def vote_shares(votes: Column, least: float = 0.2) -> Column:
    """Keys of a map<string, long> that hold at least a share of all votes."""
    total = F.aggregate(F.map_values(votes), F.lit(0).cast("long"), lambda a, v: a + v)
    return F.map_keys(F.map_filter(votes, lambda _, v: (total > 0) & (v / total >= least)))


def strong_accords(accords: Column, least: int = 30) -> Column:
    """array<struct<name, strength>> to 'name (80%)' texts: strong ones only, strongest first."""
    kept = F.filter(accords, lambda a: a["strength"] >= least)
    ordered = F.array_sort(kept, lambda a, b: F.when(a["strength"] > b["strength"], -1).when(a["strength"] < b["strength"], 1).otherwise(0))
    return F.transform(ordered, lambda a: F.concat(a["name"], F.lit(" ("), a["strength"].cast("int").cast("string"), F.lit("%)")))


def note_list(notes: Column) -> Column:
    """Notes of a nested record: the three tiers in order if any has a note, else the flat list; unnamed ones dropped."""
    named = lambda a: F.filter(F.transform(F.coalesce(a, F.array()), lambda x: x["name"]), lambda x: x.isNotNull() & (F.trim(x) != ""))
    tiers = F.concat(*[named(notes["tiered"][t]) for t in ("top", "middle", "base")])
    return F.when(F.size(tiers) > 0, tiers).otherwise(named(notes["flat"]))


#: The bands of each metric: four upper bounds (exclusive; quartiles and 95th percentile of a full catalog) and five names.
BANDS = {
    "longevity": ((2.31, 3.01, 3.57, 4.30), ("light; bottom catalog quartile", "moderate-light; below catalog median", "moderate; typical catalog range", "strong; top catalog quartile", "very strong; approximately top 5% of the catalog")),
    "sillage": ((1.68, 2.15, 2.57, 3.15), ("restrained; bottom catalog quartile", "moderate-restrained; below catalog median", "moderate; typical catalog range", "noticeable/strong; top catalog quartile", "very strong; approximately top 5% of the catalog")),
}


def performance_band(name: str) -> Column:
    """The band of a metric of an item; without a value, that there is none."""
    bounds, names = BANDS[name]
    out = F.when(F.col(name).isNull(), "not recorded; do not infer performance")
    for bound, text in zip(bounds, names, strict=False):
        out = out.when(F.col(name) < bound, text)
    return out.otherwise(names[-1])


def performance_group(name: str) -> Column:
    """One of three groups: low in the first band, moderate up to the third, else high; unknown without a value."""
    bounds, _ = BANDS[name]
    return F.when(F.col(name).isNull(), "unknown").when(F.col(name) < bounds[0], "low").when(F.col(name) < bounds[2], "moderate").otherwise("high")


def note_tiers(text: Column) -> Column:
    """struct<top, middle, base, flat: array<string>> of the note lines of a card."""
    parts = lambda x: F.filter(F.transform(F.split(F.substring_index(x, "|", 1), ","), lambda n: F.trim(n)), lambda n: n != "")
    tier = lambda head: parts(F.regexp_extract(text, rf"{head} Notes:([^\n]*)", 1))
    return F.struct(*[tier(t.capitalize()).alias(t) for t in ("top", "middle", "base")], parts(F.regexp_extract(text, r"(?m)^Notes:([^\n]*)", 1)).alias("flat"))


def profile_block(lines: dict[str, Column], confidence: Column) -> Column:
    """A [USER PROFILE] text of the parts that are there (arrays of texts); one sentence where none is."""
    body = F.concat_ws("\n", *[F.when(F.size(a) > 0, F.concat(F.lit(f"{head}: "), F.array_join(a, ", "))) for head, a in lines.items()])
    full = F.concat(body, F.lit("\nProfile confidence: "), confidence)
    return F.concat(F.lit("[USER PROFILE]\n"), F.when(body == "", "No stable preferences recorded yet.").otherwise(full), F.lit("\n[/USER PROFILE]"))
