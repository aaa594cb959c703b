"""Top-k, merges, diversity and session windows: the order-dependent loops of a ranking pipeline as windows.

Every order ends in an explicit tiebreak, as rows have no order of their own here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redolent.session import materialize


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps k, the driver merges them (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def top_k_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank; groups are cut to k before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def most_hits(asked: DataFrame, own: DataFrame, k: int, most: int = 8) -> DataFrame:
    """(id, perfume_id, popularity, hits, rank): the k items that answer most terms of each asked set, the popular ones first.

    asked (id, terms), own (perfume_id, popularity, terms), terms distinct. Exact: an item among the best k that answers
    the subset s of a set is among the k most popular items with all of s, as each of those answers as much. So each subset
    of an asked set keeps k items, whatever the length of its list; sets of more than most terms take the whole lists.
    """
    asked = asked.select("id", F.array_sort("terms").alias("terms")).where(F.size("terms") > 0)
    order = (F.col("popularity").desc(), F.col("perfume_id"))
    sets = materialize(asked.groupBy("terms").agg(F.lit(1).alias("_n")).select("terms"), "sets")
    grown = lambda acc, x: F.concat(acc, F.array(F.array(x)), F.transform(acc, lambda a: F.concat(a, F.array(x))))
    subsets = F.explode(F.aggregate("terms", F.array().cast("array<array<string>>"), grown)).alias("key")
    parts = materialize(sets.where(F.size("terms") <= most).select("terms", subsets), "subsets")
    wanted = parts.select("key").distinct()
    vocabulary = sets.select(F.explode("terms").alias("t")).distinct()
    postings = own.select("perfume_id", "popularity", F.explode("terms").alias("t")).join(vocabulary, "t", "left_semi")
    traits = postings.groupBy("perfume_id", "popularity").agg(F.sort_array(F.collect_set("t")).alias("_rest"))
    level, tops = traits.withColumn("key", F.array().cast("array<string>")), None
    for n in range(1, min(most, sets.agg(F.max(F.size("terms"))).first()[0] or 0) + 1):
        more = level.select("perfume_id", "popularity", "key", "_rest", F.posexplode("_rest").alias("_i", "_t"))
        more = more.select("perfume_id", "popularity", F.concat("key", F.array("_t")).alias("key"), F.slice("_rest", F.col("_i") + 2, F.size("_rest")).alias("_rest"))
        level = materialize(more.join(wanted.where(F.size("key") == n), "key", "left_semi"), f"hits{n}")
        top = top_k_per(level.drop("_rest"), ["key"], k, *order).drop("rank")
        tops = top if tops is None else tops.unionByName(top)
    many = sets.where(F.size("terms") > most).select("terms", F.explode("terms").alias("t")).join(postings, "t").groupBy("terms", "perfume_id", "popularity").agg(F.count("*").alias("hits"))
    found = many if tops is None else many.unionByName(parts.join(tops, "key").groupBy("terms", "perfume_id", "popularity").agg(F.max(F.size("key")).cast("long").alias("hits")))
    best = top_k_per(found, ["terms"], k, F.col("hits").desc(), *order)
    return asked.join(best, "terms").select("id", "perfume_id", "popularity", "hits", "rank")


def merged_neighbours(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, target_id, refs, up, down, mean_up): the neighbour maps of all references (request, source_id) of each request."""
    sizes = requests.groupBy("request").agg(F.count("*").alias("_n"))
    by = requests.join(edges, "source_id").groupBy("request", "target_id").agg(F.count("*").alias("refs"), F.sum("up_votes").alias("up"), F.sum("down_votes").alias("down"))
    return by.join(sizes, "request").withColumn("mean_up", F.round(F.col("up") / F.col("_n"), 6)).drop("_n")


def supplemented_each(found: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """Every source's result (source_id, perfume_id, score) filled up to k from one list of fixed size, its own rows first."""
    sources = found.select("source_id").distinct()
    filled = sources.crossJoin(F.broadcast(more)).select("source_id", "perfume_id", "score", F.lit(1).alias("priority"))
    both = found.select("source_id", "perfume_id", "score", F.lit(0).alias("priority")).unionByName(filled)
    once = both.groupBy("source_id", "perfume_id").agg(F.min_by("score", "priority").alias("score"), F.min("priority").alias("priority"))
    return top_k_per(once, ["source_id"], k, F.col("priority"), F.col("score").desc(), F.col("perfume_id"))


def first_wins(parts: list[DataFrame], key: str, pos: str) -> DataFrame:
    """Candidate lists in order of priority, each id once, from the first list that has it."""
    tagged = [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("priority", pos))
    return whole.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def with_sources(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, candidate_sources): which lists each id came from."""
    tagged = [p.select(key, F.lit(name).alias("source")) for name, p in parts.items()]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t)
    return whole.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("candidate_sources"))


def diversify(scored: DataFrame, k: int, per_brand: int | Column = 2, score: str = "score", partition: list[str] | None = None) -> DataFrame:
    """The greedy pick as two windows: each label once, at most per_brand of a brand, then the best k (of each partition).

    The same rows as taking them one by one, since a label determines its brand; per_brand may be a column."""
    part = partition or []
    best = [F.col(score).desc(), F.col("perfume_id")]
    label = F.row_number().over(Window.partitionBy(*part, "label_norm").orderBy(*best))
    once = scored.withColumn("_l", label).where("_l = 1").drop("_l")
    brand = F.row_number().over(Window.partitionBy(*part, "brand_norm").orderBy(*best))
    capped = once.withColumn("_b", brand).where(F.col("_b") <= per_brand).drop("_b")
    return top_k_per(capped, part, k, *best) if part else top_k(capped, k, *best)


def dominant(df: DataFrame, keys: list[str], least: int = 500, ratio: float = 2.0) -> DataFrame:
    """The top member of each family with its outcome: 'dominant' if popular enough and `ratio` times the runner-up, else 'ambiguous'.

    Each family is cut to its first two before anything is compared, so a family of a third of all rows costs no more."""
    order = [F.col("popularity").desc(), F.col("rating").desc_nulls_last(), F.col("perfume_id")]
    two = top_k_per(df, keys, 2, *order)
    ranked = two.withColumn("runner_up", F.lead("popularity").over(Window.partitionBy(*keys).orderBy("rank")))
    clear = (F.col("popularity") >= least) & (F.col("popularity") >= F.lit(ratio) * F.coalesce("runner_up", F.lit(0)))
    return ranked.where("rank = 1").drop("rank").withColumn("outcome", F.when(clear, "dominant").otherwise("ambiguous"))


def round_robin(df: DataFrame, group: str, failed: Column, limit: int, tiebreak: str) -> DataFrame:
    """Failures first, then one of each group in turn, up to the limit (no group gives more than that)."""
    rank = F.row_number().over(Window.partitionBy(group, failed).orderBy(tiebreak))
    cut = df.withColumn("turn", rank).where(F.col("turn") <= limit)
    return cut.orderBy(F.when(failed, 0).otherwise(1), "turn", group, tiebreak).limit(limit)


def carry_forward(turns: DataFrame, session: str, order: list[str], ids: str, is_new: str) -> DataFrame:
    """Each turn with `before` (different ids that its session has given since its last new request), `again` (how many of the
    turn's own different ids are among them) and `fresh` (null for the first turn with ids, else whether none is).

    turns have a unique order within a session; a turn without ids gives none. Linear in the ids: each is marked where it
    first comes, and counts run over the marks; no list grows with a session."""
    w = Window.partitionBy(session).orderBy(*order)
    own = turns.withColumn("_segment", F.sum(F.coalesce(F.col(is_new), F.lit(False)).cast("int")).over(w))
    key = [session, "_segment"]
    each = own.select(*key, *order, F.explode_outer(F.array_distinct(F.array_compact(ids))).alias("_id"))
    first = F.row_number().over(Window.partitionBy(*key, "_id").orderBy(*order)) == 1
    by = each.withColumn("_first", F.col("_id").isNotNull() & first).groupBy(*key, *order).agg(F.count_if("_first").alias("_new"), F.count("_id").alias("_n"))
    past = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = by.withColumn("before", F.coalesce(F.sum("_new").over(past), F.lit(0)))
    again = F.col("_n") - F.col("_new")
    run = run.select(*key, *order, "before", again.alias("again"), F.when((F.col("before") > 0) & (F.col("_n") > 0), again == 0).alias("fresh"))
    return own.join(run, [*key, *order]).drop("_segment")


def sessionize(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Events with the number of their session: a gap of more than gap_seconds starts a new one."""
    w = Window.partitionBy(user).orderBy(ts, "event_id")
    idle = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(F.col(ts).cast("timestamp")).over(w)) > gap_seconds * 1_000_000
    return events.withColumn("_new", F.coalesce(idle, F.lit(True)).cast("int")).withColumn("session_no", F.sum("_new").over(w)).drop("_new")


def positional_zip(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """Rows of two tables side by side by position, with nulls where one is shorter.

    Positions are numbered in ranges: each partition counts its rows first, so no task sorts a whole table."""
    return numbered(a, order).select("pos", F.col(value).alias("left")).join(numbered(b, order).select("pos", F.col(value).alias("right")), "pos", "full")


def numbered(df: DataFrame, order: str, buckets: int = 64) -> DataFrame:
    """A dense position from 0 in the order of a unique numeric column, without a single-partition window.

    Ranges of the column are cut by its span; positions are ranks within a range plus the sizes of the ranges before it."""
    low, high = (F.min(order), F.max(order))
    span = df.agg(low.alias("low"), high.alias("high")).first()
    if span is None or span.low is None:
        return df.withColumn("pos", F.lit(0).cast("long")).limit(0)
    width = max(1, -(-(span.high - span.low + 1) // buckets))
    cut = df.withColumn("_range", F.floor((F.col(order) - span.low) / width).cast("int"))
    sizes = {r._range: r.n for r in cut.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # at most `buckets` rows
    before, starts = 0, []
    for k in sorted(sizes):
        starts += [F.lit(k), F.lit(before)]
        before += sizes[k]
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return cut.withColumn("pos", F.element_at(F.create_map(*starts), F.col("_range")).cast("long") + rank - 1).drop("_range")


def longest_match(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The longest value of each group, ties by text."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.length(value).alias("n"), F.col(value))).alias("_m")).select(*keys, F.col(f"_m.{value}").alias(value))


def largest_remainder(counts: DataFrame, total: int, key: str = "level", n: str = "n") -> DataFrame:
    """(key, quota): a total dealt in proportion to counts; floors first, then by the largest fractions, ties by key."""
    all_n = counts.select(F.sum(n)).scalar()
    share = counts.withColumn("exact", F.lit(total) * F.col(n) / all_n).withColumn("floor", F.floor("exact"))
    left = F.lit(total) - share.select(F.sum("floor")).scalar()
    rank = F.row_number().over(Window.orderBy((F.col("exact") - F.col("floor")).desc(), key))
    return share.select(key, (F.col("floor") + F.when(rank <= left, 1).otherwise(0)).cast("long").alias("quota"))


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffled order of an integer key, the same in any engine."""
    return (key * 2654435761 + seed) % 4294967296


def stratified(df: DataFrame, stratum: str, key: str, ratio: float, seed: int, buckets: int = 1024) -> DataFrame:
    """Rows with split 'validation' for round(ratio * n) of each stratum, chosen by hash order, else 'train'.

    Strata are counted by hash bucket first; only the bucket in which the cut falls is ranked, so that no task sorts a
    whole stratum. Rows with a null stratum are a stratum of their own."""
    own = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.floor(F.col("_h") / (4294967296 // buckets)).cast("int")).withColumn("_s", F.coalesce(F.col(stratum).cast("string"), F.lit("")))
    by = own.groupBy("_s", "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_s")
    cuts = by.withColumns({"_take": F.bround(F.sum("_n").over(w) * F.lit(ratio)), "_before": F.sum("_n").over(w.orderBy("_b")) - F.col("_n")})
    cuts = cuts.select("_s", "_b", F.greatest(F.lit(0), F.least("_n", F.col("_take") - F.col("_before"))).cast("long").alias("_of"), "_n")
    joined = own.join(cuts, ["_s", "_b"])
    edge = (F.col("_of") > 0) & (F.col("_of") < F.col("_n"))
    ranked = joined.where(edge).withColumn("_rn", F.row_number().over(Window.partitionBy("_s", "_b").orderBy("_h", key)))
    inside = ranked.withColumn("split", F.when(F.col("_rn") <= F.col("_of"), "validation").otherwise("train")).drop("_rn")
    rest = joined.where(~edge).withColumn("split", F.when(F.col("_of") > 0, "validation").otherwise("train"))
    return inside.unionByName(rest).drop("_s", "_b", "_h", "_of", "_n")
