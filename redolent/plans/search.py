"""Whole searches as one DataFrame program each: hybrid, graph, and graph supplemented by hybrid."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redolent.operators import filters, scoring
from redolent.operators.relational import diversify, first_wins
from redolent.operators.vector import dot, semantic


@dataclass(frozen=True)
class SearchSpec:
    """What a hybrid search asks for; query: its folded words; top_k is held to 1..30 and fetch_k to top_k..300."""

    vector: tuple[float, ...] = ()
    gender: str | None = None
    season: str | None = None
    time: str | None = None
    min_rating: float | None = None
    min_popularity: int | None = None
    brand: str | None = None
    wanted: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    exclude_ids: tuple[int, ...] = field(default_factory=tuple)
    mode: str = "balanced"
    query: str = ""
    top_k: int = 8
    fetch_k: int = 120
    popular_window: int = 4000
    popular_keep: int = 140

    def clamped(self) -> tuple[int, int]:
        k = min(max(self.top_k, 1), 30)
        return k, min(max(self.fetch_k, k), 300)


def supported(pool: DataFrame, terms: tuple[str, ...]) -> list[str]:
    """The terms that some item of the pool answers: one row comes back."""
    if not terms:
        return []
    row = pool.agg(*[F.max(scoring.best_strength(t, F.concat("accords", "notes"))).alias(f"t{i}") for i, t in enumerate(terms)]).first()
    return [t for i, t in enumerate(terms) if (row[f"t{i}"] or 0.0) > 0]


def candidates(items: DataFrame, vectors: DataFrame | None, spec: SearchSpec) -> DataFrame:
    """The pool of a hybrid search: the nearest fetch_k items and, except in niche mode, popular ones that fit, each once.

    Both branches push their filters into the scan; the popular window is cut before the term checks, as a later filter may
    not move below a limit. At most fetch_k + popular_keep rows."""
    _, fetch = spec.clamped()
    near = None
    distance = F.lit(1.0)
    if vectors is not None and spec.vector:
        distance = 1 - dot(F.col("embedding"), F.array(*map(F.lit, spec.vector)))
        where = filters.metadata_filter(spec.gender, spec.season, spec.time, spec.min_rating, spec.min_popularity, spec.brand)
        near = items.where(where).join(vectors, "perfume_id").withColumn("distance", distance).drop("embedding")
        near = near.orderBy("distance", "perfume_id").limit(fetch)
        if spec.mode == "niche":
            return near
    traits = F.concat("accords", "notes")
    ahead = filters.metadata_filter(spec.gender, None, None, spec.min_rating, spec.min_popularity, spec.brand)
    best = [F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")]
    window = items.where(ahead).orderBy(*best).limit(spec.popular_window)
    answers = [scoring.best_strength(t, traits) > 0 for t in spec.required]
    fits = filters.all_of([filters.metadata_filter(season=spec.season, time=spec.time), *answers, *[~filters.has_term(t) for t in spec.excluded]])
    popular = window.where(fits).orderBy(*best).limit(200 if spec.mode == "mainstream" else spec.popular_keep)
    if near is None:
        return popular.withColumn("distance", distance)
    popular = popular.join(vectors, "perfume_id").withColumn("distance", distance).drop("embedding")
    return first_wins([near, popular], "perfume_id", "perfume_id").drop("priority")


def hybrid(items: DataFrame, vectors: DataFrame | None, spec: SearchSpec) -> DataFrame:
    """(perfume_id, name, brand, semantic, score): nearest vectors and popular items together, filtered, scored, diversified.

    vectors: (perfume_id, embedding of unit length). Wanted terms that no item of the pool answers are ignored; a required one
    that none answers leaves nothing. A brand that the query's words hold by accident (spec.query, folded; no brand asked for;
    four letters or more) costs its items a penalty and gets one place. Which terms the pool answers is settled over the pool
    itself, a few hundred rows, in the same job: the pool is computed once.
    """
    k, _ = spec.clamped()
    traits, whole = F.concat("accords", "notes"), Window.partitionBy()
    names = {t: f"_t{i}" for i, t in enumerate(dict.fromkeys((*spec.wanted, *spec.required)))}
    pool = candidates(items, vectors, spec).withColumns({c: scoring.best_strength(t, traits) for t, c in names.items()})
    pool = pool.withColumns({f"{c}_any": F.max(c).over(whole) > 0 for c in names.values()})
    wanted = [names[t] for t in spec.wanted]
    hits = sum((F.when(F.col(f"{c}_any"), F.col(c)).otherwise(0.0) for c in wanted), F.lit(0.0))
    many = sum((F.col(f"{c}_any").cast("int") for c in wanted), F.lit(0))
    collision = F.lit(False)
    if spec.query and not spec.brand:
        collision = F.coalesce((F.length("brand_norm") >= 4) & F.lit(f" {spec.query} ").contains(F.concat(F.lit(" "), F.col("brand_norm"), F.lit(" "))), F.lit(False))
    keep = [~F.col("perfume_id").isin(*spec.exclude_ids)] if spec.exclude_ids else []
    keep += [~filters.has_term(t) for t in spec.excluded] + [F.col(names[t]) > 0 for t in spec.required]
    rating = scoring.shrunk_rating(F.col("rating"), F.col("popularity"))
    semantics = semantic(F.coalesce("distance", F.lit(1.0)))
    score = scoring.blended(semantics, scoring.popularity_score(F.col("popularity")), scoring.rating_score(rating), F.when(many > 0, hits / many).otherwise(0.0), spec.mode, collision)
    scored = pool.where(filters.all_of(keep)).withColumns({"semantic": F.round(semantics, 6), "score": F.round(score, 6), "_cap": F.when(collision, 1).otherwise(k if spec.brand else 2)})
    return diversify(scored, k, F.col("_cap")).select("perfume_id", "name", "brand", "semantic", "score")


def similar(items: DataFrame, edges: DataFrame, k: int = 10, limit: int = 200, sources: DataFrame | None = None) -> DataFrame:
    """(source_id, perfume_id, score, rank): community neighbours of every source, scored by votes, structure and popularity.

    sources: (source_id) to answer for, else all. Each source keeps its `limit` best edges before anything is compared.
    """
    from redolent.operators.relational import top_k_per

    own = edges if sources is None else edges.join(sources.select("source_id"), "source_id", "left_semi")
    cut = top_k_per(own, ["source_id"], limit, (F.col("up_votes") - F.col("down_votes")).desc(), F.col("up_votes").desc(), F.col("target_id")).drop("rank")
    source = items.select(F.col("perfume_id").alias("source_id"), F.col("accords").alias("s_accords"), F.col("notes").alias("s_notes"))
    both = cut.join(items, F.col("target_id") == F.col("perfume_id")).join(source, "source_id")
    score = scoring.graph_score(scoring.vote_confidence(F.col("up_votes"), F.col("down_votes")), scoring.set_similarity(F.col("s_accords"), F.col("accords")), scoring.set_similarity(F.col("s_notes"), F.col("notes")), scoring.popularity_score(F.col("popularity")))
    return diversify(both.withColumn("score", F.round(score, 6)), k, 2, partition=["source_id"]).select("source_id", "perfume_id", "score", "rank")


def similar_to_hints(hints: DataFrame, items: DataFrame, edges: DataFrame, resolved: DataFrame, k: int = 10, limit: int = 200) -> DataFrame:
    """(hint_id, perfume_id, score, rank): graph search for many hints at once, each with its own filters.

    resolved: (hint_id, perfume_id) of resolve(); hints: (hint_id, genders, min_popularity, excluded), of which each may be null.
    A hint of no item has no rows. Neighbours of the item's own label are left out; so are those of another gender, fewer
    votes, or with an excluded trait. Each source is cut to its `limit` best edges once, however many hints name it."""
    from redolent.operators.relational import top_k_per

    asked = resolved.where("perfume_id IS NOT NULL").select("hint_id", F.col("perfume_id").alias("source_id"))
    sources = asked.select("source_id").distinct()
    ranked = [(F.col("up_votes") - F.col("down_votes")).desc(), F.col("up_votes").desc(), F.col("target_id")]
    cut = top_k_per(edges.join(sources, "source_id", "left_semi"), ["source_id"], limit, *ranked).drop("rank")
    source = items.select(F.col("perfume_id").alias("source_id"), F.col("accords").alias("s_accords"), F.col("notes").alias("s_notes"), F.col("label_norm").alias("s_label"))
    both = cut.join(items, F.col("target_id") == F.col("perfume_id")).join(source, "source_id").where("label_norm IS DISTINCT FROM s_label")
    traits = [scoring.set_similarity(F.col(f"s_{f}"), F.col(f)) for f in ("accords", "notes")]
    score = scoring.graph_score(scoring.vote_confidence(F.col("up_votes"), F.col("down_votes")), *traits, scoring.popularity_score(F.col("popularity")))
    own = asked.join(hints, "hint_id").join(both.withColumn("score", F.round(score, 6)), "source_id")
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    fits = (free("genders") | F.array_contains("genders", F.col("gender"))) & (F.col("popularity") >= F.coalesce("min_popularity", F.lit(0)))
    fits = fits & (free("excluded") | ~F.coalesce(F.arrays_overlap(F.concat("accords", "notes"), "excluded"), F.lit(False)))
    return diversify(own.where(fits), k, 2, partition=["hint_id"]).select("hint_id", "perfume_id", "score", "rank")


def supplemented(found: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """A short result filled up from another search, ids once, the first list's rows first."""
    return first_wins([found, more], "perfume_id", "perfume_id").orderBy("priority", F.col("score").desc(), "perfume_id").limit(k)


def relaxed(strict: DataFrame, loose: DataFrame, least: int) -> DataFrame:
    """Strict matches if there are at least `least`, else the loose ones too: both tiers computed once, chosen by count."""
    tiers = strict.select("perfume_id", F.lit(0).alias("tier")).unionByName(loose.select("perfume_id", F.lit(1).alias("tier"))).groupBy("perfume_id").agg(F.min("tier").alias("tier"))
    enough = tiers.select(F.count_if(F.col("tier") == 0)).scalar() >= least
    return tiers.where((F.col("tier") == 0) | ~enough)
