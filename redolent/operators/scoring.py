"""Scores as Columns: every one is built-in expressions only, so they fuse into the scan's generated code."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of semantic fit, popularity, rating and wanted terms by discovery mode.
MODE_WEIGHTS = {"balanced": (0.62, 0.16, 0.08, 0.14), "mainstream": (0.48, 0.29, 0.09, 0.14), "niche": (0.70, 0.05, 0.11, 0.14)}
#: Trait families; what a wanted trait also accepts.
FAMILIES = {"musk": ("musk", "musky", "white musk"), "musky": ("musk", "musky", "white musk"), "leather": ("leather", "leathery", "suede"), "leathery": ("leather", "leathery", "suede"), "oud": ("oud", "aoud", "agarwood"), "aoud": ("oud", "aoud", "agarwood"), "agarwood": ("oud", "aoud", "agarwood"), "smoke": ("smoke", "smoky"), "smoky": ("smoke", "smoky")}


def positive(value: Column) -> Column:
    """Null, zero and negative metrics are 0."""
    return F.when(value > 0, value).otherwise(F.lit(0.0))


def shrunk_rating(rating: Column, votes: Column, prior: float = 3.8, weight: int = 250) -> Column:
    """A rating drawn to the prior by few votes; no rating is 0."""
    w = F.when(votes > 0, votes / (votes + F.lit(weight))).otherwise(F.lit(0.0))
    return F.when(F.coalesce(rating, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(rating * w + F.lit(prior) * (1 - w))


def shrunk_rating_by_mean(rating: Column, votes: Column, mean: float = 4.01, weight: int = 50) -> Column:
    """The other formula: a weighted mean with `weight` votes of the average; no votes is 0."""
    return F.when(F.coalesce(votes, F.lit(0)) <= 0, F.lit(0.0)).otherwise((votes * F.coalesce(rating, F.lit(0.0)) + F.lit(weight * mean)) / (votes + F.lit(weight)))


def popularity_score(votes: Column, full: int = 50_000) -> Column:
    """0..1 on a log scale, 1 at `full` votes."""
    return F.when(votes > 0, F.least(F.log10(votes + 1) / F.log10(F.lit(float(full))), F.lit(1.0))).otherwise(F.lit(0.0))


def rating_score(rating: Column, low: float = 3.2, span: float = 1.3) -> Column:
    """A shrunk rating on 0..1; 0 (no rating) stays 0."""
    return F.when(rating > 0, F.least(F.greatest((rating - F.lit(low)) / F.lit(span), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def vote_confidence(up: Column, down: Column) -> Column:
    """Community similarity of an edge: smoothed approval and how many voted."""
    n = up + down
    return F.when(n <= 0, F.lit(0.0)).otherwise((up + 1) / (n + 2) * 0.72 + F.least(F.log1p(n) / F.lit(log(501)), F.lit(1.0)) * 0.28)


def set_similarity(a: Column, b: Column) -> Column:
    """0.65 Jaccard + 0.35 overlap of two arrays taken as sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)) * 0.65 + both / least * 0.35)


def gender_fit(a: Column, b: Column) -> Column:
    """1 for the same gender, 0.75 if one is unisex, else 0 (also where one is missing)."""
    a, b = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).when((a == "unisex") | (b == "unisex"), F.lit(0.75)).otherwise(F.lit(0.0))


def weighted_available(parts: list[tuple[Column, Column, float]]) -> Column:
    """Weighted mean of (available, value, weight) over the available parts; 0 without any."""
    total = sum((F.when(ok, F.lit(w)).otherwise(F.lit(0.0)) for ok, _, w in parts), F.lit(0.0))
    value = sum((F.when(ok, v * F.lit(w)).otherwise(F.lit(0.0)) for ok, v, w in parts), F.lit(0.0))
    return F.when(total > 0, value / total).otherwise(F.lit(0.0))


def structural_similarity(a: str, b: str) -> Column:
    """How alike two joined items (aliases a and b) are: accords, notes, seasons, times and gender, over what both have."""
    sides = lambda f: (F.col(f"{a}.{f}"), F.col(f"{b}.{f}"))
    has = lambda f: (F.size(F.col(f"{a}.{f}")) > 0) & (F.size(F.col(f"{b}.{f}")) > 0)
    return weighted_available([(F.lit(True), set_similarity(*sides("accords")), 0.50), (has("notes"), set_similarity(*sides("notes")), 0.27), (has("seasons"), set_similarity(*sides("seasons")), 0.10), (has("times"), set_similarity(*sides("times")), 0.08), (F.lit(True), gender_fit(*sides("gender")), 0.05)])


def match_strength(wanted: str, trait: Column) -> Column:
    """How well a trait answers a wanted one: 1 the same or of its family, 0.75 'spicy' or 'floral' as a word, 0.65 contained words."""
    family = FAMILIES.get(wanted, (wanted,))
    out = F.when(trait.isin(*family), F.lit(1.0))
    if wanted in ("spicy", "floral"):
        out = out.when(F.array_contains(F.split(trait, " "), wanted), F.lit(0.75))
    if " " in wanted:
        padded = F.concat(F.lit(" "), trait, F.lit(" "))
        out = out.when(padded.contains(f" {wanted} ") | F.lit(f" {wanted} ").contains(padded), F.lit(0.65))
    return out.otherwise(F.lit(0.0))


def best_strength(wanted: str, traits: Column) -> Column:
    """The best match among an item's traits, 0 without any."""
    return F.coalesce(F.array_max(F.transform(traits, lambda t: match_strength(wanted, t))), F.lit(0.0))


def wanted_score(wanted: list[str], traits: Column) -> Column:
    """Mean best strength over the wanted (and supported) terms, 0 without any."""
    return sum((best_strength(w, traits) for w in wanted), F.lit(0.0)) / F.lit(float(len(wanted))) if wanted else F.lit(0.0)


def blended(semantic: Column, popularity: Column, rating: Column, wanted: Column, mode: str = "balanced", collision: Column | None = None, penalty: float = 0.14) -> Column:
    """The final score of hybrid search by mode; an accidental brand mention costs a penalty."""
    s, p, r, w = MODE_WEIGHTS[mode]
    score = semantic * s + popularity * p + rating * r + wanted * w
    return score if collision is None else score - F.when(collision, F.lit(penalty)).otherwise(F.lit(0.0))


def graph_score(graph: Column, accords: Column, notes: Column, popularity: Column) -> Column:
    """The final score of graph search."""
    return graph * 0.68 + (accords * 0.68 + notes * 0.32) * 0.24 + popularity * 0.08


def minmax(value: Column, low: Column, high: Column) -> Column:
    """A score on 0..1 between the least and the greatest of its group; 0 where all are equal."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))


def compare(a: Column, b: Column) -> Column:
    """'higher', 'lower', 'tie' or 'missing' of two metrics."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a > b, "higher").when(a < b, "lower").otherwise("tie")
