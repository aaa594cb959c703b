"""Filters compiled from small specifications into one predicate, which Catalyst pushes into the scan as far as it can."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from redolent.operators.scoring import FAMILIES, best_strength, positive

GENDERS, SEASONS, TIMES = ("male", "female", "unisex"), ("spring", "summer", "autumn", "winter"), ("day", "night")


@dataclass(frozen=True)
class Criteria:
    """What an item must satisfy; empty fields ask for nothing."""

    gender: str | None = None
    gender_any_of: tuple[str, ...] = ()
    seasons: tuple[str, ...] = ()
    times: tuple[str, ...] = ()
    accords: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()
    not_terms: tuple[str, ...] = ()
    min_rating: float | None = None
    min_votes: int | None = None
    min_longevity: float | None = None
    min_sillage: float | None = None
    min_value: float | None = None
    sort_by: str = "popularity"
    descending: bool = True


@dataclass(frozen=True)
class SemanticProfile:
    """A scoring wish: hard terms gate, the others add or take points."""

    gender_any_of: tuple[str, ...] = ()
    prefer_gender: str | None = None
    hard_seasons: tuple[str, ...] = ()
    hard_times: tuple[str, ...] = ()
    wanted_accords: tuple[str, ...] = ()
    wanted_notes: tuple[str, ...] = ()
    soft_accords: tuple[str, ...] = ()
    soft_notes: tuple[str, ...] = ()
    avoid: tuple[str, ...] = ()
    soft_avoid_accords: tuple[str, ...] = ()
    soft_avoid_notes: tuple[str, ...] = ()
    extra: dict[str, str] = field(default_factory=dict)


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def overlaps(terms: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(terms, F.array(*map(F.lit, wanted)))


def word_in(terms: Column, word: str) -> Column:
    """A term of an item is the word or has it between word borders."""
    return F.exists(terms, lambda t: (t == word) | F.regexp(t, F.lit(rf"\b{re.escape(word)}\b")))


def forbidden(terms: Column, words: tuple[str, ...], card: Column | None = None) -> Column:
    """Whether one of the words stands in a term (per term; never across two) or in the card."""
    found = [word_in(terms, w) for w in words]
    if card is not None:
        found += [F.regexp(F.lower(card), F.lit(rf"\b{re.escape(w)}\b")) for w in words]
    return F.coalesce(any_of(found), F.lit(False))


def compile_criteria(c: Criteria) -> Column:
    """The predicate of a Criteria over items."""
    traits = F.concat("accords", "notes")
    checks: list[Column] = []
    if c.gender:
        checks.append(F.col("gender") == c.gender.lower())
    if c.gender_any_of:
        checks.append(F.col("gender").isin(*[g.lower() for g in c.gender_any_of]))
    checks += [overlaps(F.col(f), v) for f, v in (("seasons", c.seasons), ("times", c.times)) if v]
    checks += [F.array_contains(f, x) for f, v in (("accords", c.accords), ("notes", c.notes)) for x in v]
    if c.not_terms:
        checks.append(~forbidden(traits, c.not_terms))
    if c.min_rating is not None:
        checks.append(rating_floor(c.min_rating))
    if c.min_votes is not None:
        checks.append(F.col("popularity") >= c.min_votes)
    checks += [positive(F.col(f)) >= v for f, v in (("longevity", c.min_longevity), ("sillage", c.min_sillage), ("value_score", c.min_value)) if v is not None]
    return all_of(checks)


def rating_floor(least: float) -> Column:
    """A rating of at least `least` that someone voted for."""
    return F.col("rating").isNotNull() & (F.col("rating") >= least) & (F.col("popularity") > 0)


def sort_key(name: str) -> Column:
    """The value that a search sorts by."""
    keys = {"popularity": F.col("popularity").cast("double"), "rating": F.when(F.col("popularity") > 0, F.coalesce("rating", F.lit(0.0))).otherwise(F.lit(0.0)), "longevity": positive(F.col("longevity")), "sillage": positive(F.col("sillage")), "value": positive(F.col("value_score"))}
    if name not in keys:
        raise ValueError(f"no sort field {name}")
    return keys[name]


def metadata_filter(gender: str | None = None, season: str | None = None, time: str | None = None, min_rating: float | None = None, min_popularity: int | None = None, brand: str | None = None, year: tuple[int | None, int | None] = (None, None), soft: bool = True) -> Column:
    """The filter of a search: a gender also admits unisex; season and time are soft and can be left out."""
    for value, valid in ((gender, GENDERS), (season, SEASONS), (time, TIMES)):
        if value is not None and value not in valid:
            raise ValueError(f"unknown value {value}")
    checks: list[Column] = []
    if gender:
        checks.append(F.col("gender").isin(*{gender, "unisex"}))
    if season and soft:
        checks.append(F.array_contains("seasons", season))
    if time and soft:
        checks.append(F.array_contains("times", time))
    if min_rating is not None:
        checks.append(F.col("rating") >= min_rating)
    if min_popularity is not None:
        checks.append(F.col("popularity") >= min_popularity)
    if brand:
        checks.append(F.col("brand") == brand)
    if year[0] is not None:
        checks.append(F.col("year") >= year[0])
    if year[1] is not None:
        checks.append(F.col("year") <= year[1])
    return all_of(checks)


def has_term(term: str) -> Column:
    """An item mentions a term: as whole words of name, brand, accords or notes, or through a matching trait."""
    text = F.concat_ws(" ", F.lit(""), "name_norm", "brand_norm", F.array_join("accords", " "), F.array_join("notes", " "), F.lit(""))
    return text.contains(f" {term} ") | (best_strength(term, F.concat("accords", "notes")) > 0)


def profile_score(p: SemanticProfile) -> Column:
    """Points of an item for a profile; -1 where a gate closes. Repeated wanted terms count each time."""
    hits = lambda f, terms, w: F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.array_contains(f, t))) * F.lit(w) if terms else F.lit(0.0)
    gates: list[Column] = []
    if p.gender_any_of:
        gates.append(~F.col("gender").isin(*p.gender_any_of))
    gates += [~overlaps(F.col(f), v) for f, v in (("seasons", p.hard_seasons), ("times", p.hard_times)) if v]
    if p.avoid:
        gates.append(overlaps(F.concat("accords", "notes"), p.avoid))
    score = hits("accords", p.wanted_accords, 4.0) + hits("notes", p.wanted_notes, 4.0) + hits("accords", p.soft_accords, 2.0) + hits("notes", p.soft_notes, 1.5) - hits("accords", p.soft_avoid_accords, 2.5) - hits("notes", p.soft_avoid_notes, 2.0)
    if p.prefer_gender:
        score = score + F.when(F.col("gender") == p.prefer_gender, F.lit(0.75)).otherwise(F.lit(0.0))
    score = score + F.lit((1.0 if p.hard_seasons else 0.0) + (0.75 if p.hard_times else 0.0))
    score = score + F.when((F.col("rating") > 0) & (F.col("popularity") > 0), F.least((F.col("rating") - 3.5) * 0.6, F.lit(0.8))).otherwise(F.lit(0.0))
    score = score + F.least(F.col("popularity") / 50000, F.lit(0.8))
    return F.when(any_of(gates), F.lit(-1.0)).otherwise(score)


def family(term: str) -> tuple[str, ...]:
    """The traits a wanted one also accepts."""
    return FAMILIES.get(term, (term,) if term else ())


#: Question families that the catalog can't answer, by what gives them away (case ignored); the first that fits counts.
UNSUPPORTED = (
    ("live_price", r"[$€£₺]\s*\d|\b(?:price|cost|dollars?|euros?|lira|tl|under \d+|cheap|cheaper|affordable)\b|\b(?:kaç para|fiyatı ne|ucuz|daha ucuz)\b"),
    ("availability", r"\b(?:in stock|available now|availability|discontinued|where can i buy|still sold)\b|\b(?:stokta|satışta mı|satista mi|nereden alabilirim|üretiliyor mu)\b"),
    ("medical_safety", r"\b(?:asthma|allergy|allergic|pregnan|eczema|migraine|safe for skin)\b|\b(?:astım|astim|alerji|hamile|egzama|migren)\b"),
    ("compliments", r"\b(?:most complimented|compliment getter|gets? compliments?)\b|\ben çok iltifat\b"),
    ("layering", r"\b(?:layer|layering|mix together)\b|\b(?:katmanla|katmanlama|birlikte sık)\b"),
)


def unsupported_intent(query: Column) -> Column:
    """Which closed family a question belongs to, null if none."""
    out = F.when(F.regexp(query, F.lit(f"(?i){UNSUPPORTED[0][1]}")), UNSUPPORTED[0][0])
    for name, pattern in UNSUPPORTED[1:]:
        out = out.when(F.regexp(query, F.lit(f"(?i){pattern}")), name)
    return out


#: Openings that generated questions may not have (of words of a-z and '), and what gives a model's own talk away.
BANNED_OPENINGS = ("could you suggest", "could you recommend", "can you suggest", "can you recommend", "i'm looking for", "im looking for")
OWN_TALK = ("<think", "</think", "do you love", "are you more into")


def bad_question(query: Column) -> Column:
    """A generated question that can't be used: under 25 letters or 5 words, broken off at the end, a banned opening, or the model's own talk."""
    words = F.size(F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != ""))
    low = F.lower(query)
    opening = F.array_join(F.slice(F.regexp_extract_all(F.translate(low, "’", "'"), F.lit("([a-z']+)"), 1), 1, 5), " ")
    talk = any_of([low.contains(x) for x in OWN_TALK]) | F.startswith(low, F.lit("think "))
    return (F.length(query) < 25) | (words < 5) | F.regexp(query, F.lit("['\",:]$")) | talk | any_of([F.startswith(opening, F.lit(x)) for x in BANNED_OPENINGS])


#: Requests that ask for the fields of a record as they stand (case ignored).
EXACT_LOOKUP = (
    r"\b(database record|database says|recorded parameters|all fields)\b",
    r"\b(display|show|list|give me|what are|what is)\b.*\b(fields|notes|accords|rating|longevity|sillage|value)\b",
    r"\b(display|show|list|give me|what are|what is)\b.*\b(accord profile|seasonal suitability|suitability data|seasonal data|time profile)\b",
    r"\b(exact|verbatim|full)\b.*\b(record|notes|accords|fields|database)\b",
)


def exact_lookup(message: Column) -> Column:
    """Whether a message, without the record cards before it, asks for a record's fields as they stand."""
    tail = F.substring_index(message, "[/PERFUMES]", -1)
    return any_of([F.regexp(tail, F.lit(f"(?i){p}")) for p in EXACT_LOOKUP])
