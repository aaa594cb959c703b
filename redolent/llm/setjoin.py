"""All pairs of records whose sets overlap above a Jaccard similarity, by metric pivot partitioning.

Pivots are a bounded, hash-ordered choice of the sets themselves. Every set goes home to its nearest pivot under Jaccard
distance (ties: lower pivot). It is also copied to each lower-numbered pivot that could be home of a partner: by the
triangle inequality a set y within distance t of x has d(y, q) <= d(x, q) + t and d(y, p) >= d(x, p) - t, so q can be y's
home only if d(x, q) <= d(x, p) + 2t. The same inequality on set differences is sharper, since a partner can add at most
`more` and lack at most `less` members, so the bound is taken over the distances those leave possible (reach()). A pair
thus meets in exactly one cell: the lower of its two homes. In a cell the join is exact: two sets above the threshold have
all but a few members in common, so they share three among the few rarest of each; sets are matched on such triples and
every match is verified. Where many sets share a triple it is lengthened by two members: partners that share a key of three
members among their rarest also share one of five that holds it, among two members more.

Before any of that, sets without a partner are mostly left out: members are dealt into a few more parts by hash than two
partners can differ in members, so partners agree on whole parts, and only sets go on that have such parts in common with
another set. The hashes of the parts are all that is shuffled for it, and chance agreements do no harm.

Equal sets are one class and are joined once. Cells that outgrow a task are split by the hash of keys of five members, which
loses nothing, as partners share such a key, and which deals the sets of a hot triple over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redolent.functions.text import folded_items
from redolent.llm.term_frequency import latest
from redolent.session import materialize, slots, spread

#: Members in a matching key: two sets above the threshold share at least so many of their rarest members. WIDE: of the keys that split a cell.
KEY, WIDE = 3, 5
#: Sets that share a key before it is lengthened.
HOT = 400
#: Sets in a cell (or split of one) that one task joins, and matching keys it holds at a time.
CELL, KEYS = 600_000, 2_000_000
#: Terms above this share of all sets are ranked by their count; there can be at most mean size / share of them.
RANKED_SHARE = 0.0005
#: How many parts must agree by differing members, up to TWO_PARTS two else, beyond it one. Keys of parts in a bucket, bits of the
#: filter for a set and in all at most; sets above which those left are dealt into other parts again, and how often in all.
AGREE, TWO_PARTS, BUCKET, BITS, MOST_BITS, AGAIN, ROUNDS = {1: 4, 2: 4, 3: 3, 4: 3}, 10, 1_500_000, 64, 1 << 29, 20_000, 3


def reach(overlap: np.ndarray, size: np.ndarray, pivot_size: np.ndarray, home: np.ndarray, similarity: float) -> np.ndarray:
    """(sets x pivots) bool: whether a partner of a set may have the pivot as its home. overlap: set x pivot intersections."""
    out = np.zeros(overlap.shape, dtype=bool)
    rows = np.arange(len(size))
    own, own_size = overlap[rows, home][:, None], pivot_size[home][:, None]
    n, q_size = size[:, None], pivot_size[None, :]
    most = int(size.max()) if len(size) else 0
    for less in range(int(np.floor((1 - similarity) * most + 1e-9)) + 1):
        more_most = np.floor((n - less) / similarity - n + 1e-9)  # (n - less) / (n + more) >= similarity
        for more in range(int(more_most.max(initial=-1)) + 1):
            fine = more_most >= more
            m = n - less + more
            near = np.minimum(np.minimum(overlap + more, q_size), m)  # as near to the pivot as the partner can be
            far = np.maximum(own - less, 0)  # as far from x's home as it can be
            out |= fine & (near * (m + own_size - far) >= far * (m + q_size - near))
    return out


def _pivot_table(pivots: list[list[int]]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    hit: dict[int, np.ndarray] = {}
    for j, p in enumerate(pivots):
        for t in p:
            hit.setdefault(t, np.zeros(len(pivots), dtype=np.int16))[j] = 1
    return hit, np.array([len(p) for p in pivots], dtype=np.int64)


def _overlaps(flat: np.ndarray, offsets: np.ndarray, hit_terms: np.ndarray, hits: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hit_terms, flat), len(hit_terms) - 1)
    rows = np.where((hit_terms[at] == flat)[:, None], hits[at], 0)
    return np.add.reduceat(rows, offsets[:-1], axis=0).astype(np.int64) if len(flat) else np.zeros((0, hits.shape[1]), dtype=np.int64)


def _padded(sizes: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sets as rows of equal length, filled up with -1."""
    sets = np.full((len(sizes), int(sizes.max(initial=1))), -1, dtype=np.int64)
    sets[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)] = flat
    return sets


def _hash(h: np.ndarray, members: np.ndarray) -> np.ndarray:
    h = (h ^ members.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _width(least: int, similarity: float, wanted: int) -> int:
    """Members that a key can have if no set has fewer than `least`: partners share ceil(similarity * least) at least.

    At 0.75 and above sets of 3 and more members share 3, and smaller ones are equal."""
    return min(wanted, max(int(np.ceil(similarity * least - 1e-9)), KEY)) if similarity >= 0.75 else 1


def _prefix(n: int, similarity: float, width: int) -> int:
    return min(n, n - int(np.ceil(similarity * n - 1e-9)) + width)


def _keys(sets: np.ndarray, sizes: np.ndarray, similarity: float, width: int, of: int = 1, part: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, row of each, its places): one key for every choice of `width` members among the rarest few of a set; every of-th key only.

    places: which members a key has, as bits (of the first 63)."""
    keys, rows, places = [], [], []
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        for combo in combinations(range(_prefix(n, similarity, width)), min(width, n)):
            h = np.zeros(len(own), dtype=np.uint64)
            for c in combo:
                h = _hash(h, sets[own, c])
            mine = h % np.uint64(of) == np.uint64(part) if of > 1 else slice(None)
            keys.append(h[mine])
            rows.append(own[mine])
            places.append(np.full(len(keys[-1]), sum(1 << c for c in combo if c < 63), dtype=np.int64))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(places)


def _lengthen(key: np.ndarray, row: np.ndarray, places: np.ndarray, sets: np.ndarray, sizes: np.ndarray, similarity: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every key with each choice of members more among the rarest, up to `width` in all; none of the sets is smaller than the key allows."""
    keys, rows, marks = [], [], []
    kind = np.stack([places, sizes[row]], axis=1)
    for place, n in np.unique(kind, axis=0).tolist():
        own = np.flatnonzero((kind[:, 0] == place) & (kind[:, 1] == n))
        free = [c for c in range(_prefix(n, similarity, width)) if not place >> c & 1]
        for combo in combinations(free, width - place.bit_count()):
            h = key[own]
            for c in combo:
                h = _hash(h, sets[row[own], c])
            keys.append(h)
            rows.append(row[own])
            marks.append(np.full(len(own), place | sum(1 << c for c in combo), dtype=np.int64))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(marks)


def _signatures(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit signatures of each padded set: one bit for each member. Two sets differ in at least as many members as bits."""
    low, high = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
    for column in sets.T:
        bit = np.uint64(1) << (column.view(np.uint64) >> np.uint64(58))
        upper = (column.view(np.uint64) >> np.uint64(57)) & np.uint64(1) == 1
        low |= np.where((column != -1) & ~upper, bit, np.uint64(0))
        high |= np.where((column != -1) & upper, bit, np.uint64(0))
    return low, high


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(), offsets - offsets[0]


def _match(ids: np.ndarray, home: np.ndarray, flat: np.ndarray, offsets: np.ndarray, similarity: float, width: int, split: int, splits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one cell with at least one member at home that reach the similarity; members of each set: rarest first."""
    sizes = np.diff(offsets)
    sets = _padded(sizes, flat, offsets)
    signs = _signatures(sets)
    parts = max(1, len(ids) * 20 // splits // KEYS)  # keys are worked off in parts of about KEYS, so that memory is bounded
    for part in range(parts):
        yield from _match_keys(ids, home, sizes, sets, signs, similarity, width, *_keys(sets, sizes, similarity, width, splits * parts, split + splits * part))


def _match_keys(ids: np.ndarray, home: np.ndarray, sizes: np.ndarray, sets: np.ndarray, signs: tuple[np.ndarray, np.ndarray], similarity: float, width: int, key: np.ndarray, row: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share a key and reach the similarity. Keys that more than HOT rows share are lengthened to WIDE members, once:
    a cluster of near copies shares longer keys as well, and its pairs are mostly links."""
    order = np.lexsort((row, key))
    key, row, places = key[order], row[order], places[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(starts, len(key)))
    if len(counts) and counts.max() > HOT and similarity >= 0.75 and int(sets.shape[1]) < 63:
        least = np.minimum.reduceat(sizes[row], starts)
        longer = np.minimum(max(width, WIDE), np.ceil(similarity * least - 1e-9).astype(np.int64))
        for w in range(width + 1, width + 3):
            hot = np.repeat((counts > HOT) & (longer == w), counts)
            if hot.any():
                at = np.flatnonzero(hot)
                step = max(HOT, KEYS // 20)
                bounds = starts[(counts > HOT) & (longer == w)]
                ends = bounds + counts[(counts > HOT) & (longer == w)]
                first = 0
                while first < len(bounds):  # whole keys at a time, about `step` rows together
                    last = first + 1
                    while last < len(bounds) and ends[last] - bounds[first] <= step:
                        last += 1
                    own = at[(at >= bounds[first]) & (at < ends[last - 1])]
                    yield from _match_keys(ids, home, sizes, sets, signs, similarity, w, *_lengthen(key[own], row[own], places[own], sets, sizes, similarity, w))
                    first = last
        cold = np.repeat(~((counts > HOT) & (longer > width)), counts)
        key, row = key[cold], row[cold]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.append(starts, len(key)))
    partners = np.repeat(starts + counts, counts) - np.arange(len(key)) - 1  # later entries of the same key
    upto_here = np.append(0, np.cumsum(partners))
    at = 0
    while at < len(key):  # pairs in blocks, so that a key of any length takes bounded memory
        upto = max(at + 1, int(np.searchsorted(upto_here, upto_here[at] + 1_000_000, side="right")) - 1)
        own = partners[at:upto]
        left = np.repeat(np.arange(at, upto), own)
        right = left + 1 + np.arange(len(left)) - np.repeat(upto_here[at:upto] - upto_here[at], own)
        a, b = row[left], row[right]
        most = sizes[a] + sizes[b] - 2 * np.ceil(similarity / (1 + similarity) * (sizes[a] + sizes[b]) - 1e-9).astype(np.int64)
        # members that only one of the two has set at least as many different bits in one signature alone
        apart = np.bitwise_count(signs[0][a] ^ signs[0][b]) + np.bitwise_count(signs[1][a] ^ signs[1][b])
        keep = (home[a] | home[b]) & (np.abs(sizes[a] - sizes[b]) <= most) & (apart <= most)
        pair = np.unique(a[keep].astype(np.int64) * len(ids) + b[keep])
        for p in range(0, len(pair), 50_000):
            x, y = pair[p : p + 50_000] // len(ids), pair[p : p + 50_000] % len(ids)
            both = np.sort(np.concatenate([sets[x], sets[y]], axis=1), axis=1)
            shared = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != -1)).sum(axis=1)
            good = shared >= similarity * (sizes[x] + sizes[y] - shared) - 1e-9
            if good.any():
                yield ids[x[good]], ids[y[good]]
        at = upto


def _apart(size: int, similarity: float) -> list[int]:
    """How many members a set and a larger or equal partner can differ in, by the sizes that partner can have; large numbers rounded up to a few."""
    out = set()
    for most in range(size, int(np.floor(size / similarity + 1e-9)) + 1):
        d = int(np.floor((1 - similarity) / (1 + similarity) * 2 * most + 1e-9))
        step = 1 << max(0, d.bit_length() - 3)
        out.add(d if d <= TWO_PARTS else -(-d // step) * step)
    return sorted(out)


def _part_keys(flat: np.ndarray, offsets: np.ndarray, similarity: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each): any two different sets at or above the similarity have a key in common.

    If they differ in d members at most, they agree on one of d + 1 parts of all terms, on two of d + 2, and so on. The larger
    set's size says what d is, so a smaller one has the keys for each size that a larger partner can have."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    of = {n: _apart(n, similarity) for n in np.unique(sizes).tolist()}
    keys, rows = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
    for d in sorted({d for ds in of.values() for d in ds}):
        own = np.flatnonzero(np.isin(sizes, [n for n, ds in of.items() if d in ds]))
        at = np.full(len(sizes), -1, dtype=np.int64)
        at[own] = np.arange(len(own))
        mine = at[row] >= 0
        agree, members = AGREE.get(d, 2 if d <= TWO_PARTS else 1), flat[mine]
        parts = d + agree
        h = _hash(_hash(np.full(len(members), d + 1 + (seed << 32), dtype=np.uint64), members), members)
        sums = np.zeros(len(own) * parts, dtype=np.uint64)
        np.add.at(sums, at[row[mine]] * parts + (h >> np.uint64(32)).astype(np.int64) % parts, _hash(h, members))
        sums = sums.reshape(len(own), parts)
        for combo in combinations(range(parts), agree):
            key = np.full(len(own), d + 1, dtype=np.uint64)
            for c in combo:
                key = _hash(_hash(key, np.full(len(own), c + 1, dtype=np.int64)), sums[:, c].view(np.int64))
            keys.append(key)
            rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


def with_partners(sets: DataFrame, n: int, similarity: float, seed: int = 0) -> DataFrame:
    """The sets that share a key of parts with another one: all that have a partner, and not many others. seed: deals the parts.

    sets (n rows of id, members) is read twice. Keys are shuffled as 32 bits each and packed; which of them came twice is kept
    in a filter of fixed size, made of a piece for each bucket, so a key taken for another lets one set more through."""
    buckets = max(slots(sets.sparkSession), n * 25 // BUCKET)
    bits = max(8, min(n * BITS, MOST_BITS) // buckets // 8 * 8)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                yield whole.slice(start, 4000)

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, row = _part_keys(*_lists(batch.column(1)), similarity, seed)
        return (key % np.uint64(buckets)).astype(np.int32), (key // np.uint64(buckets)).astype(np.uint32), row

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            bucket, key, _ = keyed(batch)
            order = np.argsort(bucket, kind="stable")
            bucket, key = bucket[order], key[order]
            starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
            packed = [key[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(packed, pa.binary())], names=["bucket", "keys"])

    def twice(data: pa.Table) -> pa.Table:
        key = np.sort(np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in data.column("keys").to_pylist()]))
        hit = np.zeros(bits, dtype=bool)
        hit[key[1:][key[1:] == key[:-1]] % bits] = True
        return pa.table({"bucket": data.column("bucket").slice(0, 1), "hit": pa.array([np.packbits(hit).tobytes()], pa.binary())})

    own = spread(sets)
    hits = np.zeros((buckets, bits // 8), dtype=np.uint8)
    for r in own.mapInArrow(emit, "bucket int, keys binary").groupBy("bucket").applyInArrow(twice, "bucket int, hit binary").collect():
        hits[r.bucket] = np.frombuffer(r.hit, dtype=np.uint8)
    shared = sets.sparkSession.sparkContext.broadcast(hits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            bucket, key, row = keyed(batch)
            at = key % np.uint32(bits)
            met = shared.value[bucket, at >> np.uint32(3)] << (at & np.uint32(7)).astype(np.uint8) & 128 > 0
            yield batch.filter(pa.array(np.bincount(row[met], minlength=batch.num_rows) > 0))

    return own.mapInArrow(keep, "id long, members array<long>")


def similar_classes(sets: DataFrame, similarity: float = 0.8, pivots: int | None = None) -> DataFrame:
    """(a, b): ids of all pairs of different sets at or above the Jaccard similarity, a < b.

    sets: (id long, members array<long>), ids unique and members distinct, no two sets equal; read three times, so best
    a table. Sets with fewer than KEY members are joined too (their key is all of their members).
    """
    spark = sets.sparkSession
    own = sets.select("id", "members").where(F.size("members") > 0)
    n = own.count()
    for seed in range(ROUNDS):  # another seed leaves out those that met by chance
        if seed and n <= AGAIN:
            break
        before = n
        own = materialize(with_partners(own, n, similarity, seed), "sets")
        n = own.count()
        if n > 0.8 * before:
            break
    size = own.agg(F.count("*").alias("n"), F.min(F.size("members")).alias("least")).first()
    n, least = size.n, size.least
    if not n:
        return own.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    # terms in more than a share of all sets: their number is bounded by mean size / share
    counts = own.select(F.explode("members").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > RANKED_SHARE * n + 1)
    ranked = sorted((r.n, r.t) for r in counts.collect())
    k = pivots or int(np.clip(n // 40_000, 8, 1024))
    chosen = [r.members for r in own.orderBy(F.xxhash64(F.lit(7), "members")).limit(k).collect()]  # at most 1024 sets
    hit, pivot_size = _pivot_table(chosen)
    hit_terms = np.array(sorted(hit), dtype=np.int64)
    shared = spark.sparkContext.broadcast((np.array([t for _, t in ranked], dtype=np.int64), hit_terms, np.stack([hit[t] for t in hit_terms.tolist()]), pivot_size))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked_terms, terms, hits, p_size = shared.value
        by_term = np.argsort(ranked_terms)
        sorted_terms = ranked_terms[by_term]
        for whole in batches:
            for start in range(0, whole.num_rows, 4000):
                batch = whole.slice(start, 4000)
                lists = batch.column(1)
                flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                offsets = offsets - offsets[0]
                size = np.diff(offsets)
                # the common order of members: those not ranked first, by hash, then the ranked by count
                rank = np.zeros(len(flat), dtype=np.int64)
                if len(sorted_terms):
                    at = np.minimum(np.searchsorted(sorted_terms, flat), len(sorted_terms) - 1)
                    rank = np.where(sorted_terms[at] == flat, by_term[at] + 1, 0)
                order = np.lexsort((flat, rank, np.repeat(np.arange(len(size)), size)))
                over = _overlaps(flat, offsets, terms, hits)
                union = size[:, None] + p_size[None, :] - over
                home = np.argmin(1 - over / union, axis=1)
                far = reach(over, size, p_size, home, similarity) & (np.arange(len(p_size))[None, :] < home[:, None])
                far[np.arange(len(size)), home] = True
                row, cell = np.nonzero(far)
                ordered = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[order]))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), batch.column(0).take(pa.array(row)), ordered.take(pa.array(row))], names=["cell", "home", "id", "members"])

    cells = materialize(own.repartition(max(slots(spark) * 2, n // 20_000)).mapInArrow(assign, "cell int, home boolean, id long, members array<long>"), "cells")
    filled = {r.cell: r.n for r in cells.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each pivot
    # beyond a task's share a row goes to the splits of its keys only, about 20 of them, however many splits there are
    splits = {c: 1 if m <= CELL else -(-m * 20 // CELL) for c, m in filled.items()}
    narrow, wide = _width(least, similarity, KEY), _width(least, similarity, WIDE)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_numpy()
            of = np.array([splits[c] for c in cell.tolist()], dtype=np.uint64)
            row, split = np.flatnonzero(of == 1), np.zeros(int((of == 1).sum()), dtype=np.int64)
            if len(row) < len(of):
                flat, offsets = _lists(batch.column(3))
                sizes = np.diff(offsets)
                key, whose, _ = _keys(_padded(sizes, flat, offsets), sizes, similarity, wide)
                many = of[whose] > 1
                both = np.unique(np.stack([whose[many], (key[many] % of[whose[many]]).astype(np.int64)]), axis=1)
                row, split = np.append(row, both[0]), np.append(split, both[1])
            out = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(split.astype(np.int32)), *out.columns[1:]], names=["cell", "split", "home", "id", "members"])

    dealt = cells.mapInArrow(deal, "cell int, split int, home boolean, id long, members array<long>")

    def join(key: tuple, data: pa.Table) -> pa.Table:
        flat, offsets = _lists(data.column("members"))
        home = data.column("home").to_numpy().astype(bool)
        found = list(_match(data.column("id").to_numpy(), home, flat, offsets, similarity, narrow if (of := splits[key[0].as_py()]) == 1 else wide, key[1].as_py(), of))
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, dtype=np.int64)
        b = np.concatenate([y for _, y in found]) if found else np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("cell", "split").applyInArrow(join, "a long, b long").distinct()


def set_classes(df: DataFrame, key: str, fields: list[str], loaded: str | None = None, least: int = 6) -> DataFrame:
    """(id, members array<long>, cls, copies): the set of each record over several CSV fields and its class of equal sets.

    A member is a folded term together with its field. cls is the least id of the class. Sets under `least` members are
    left out, as are null keys; rows delivered again count once. Terms are 64-bit hashes: two of a million different
    terms are taken for one with a chance under 1 in 10 million.
    """

    def hashed(i: int, field: str) -> Column:
        return F.transform(folded_items(F.col(field)), lambda t: F.xxhash64(F.lit(i), t))

    members = F.concat(*[hashed(i, f) for i, f in enumerate(fields)])
    sets = latest(df, key, fields, loaded).select(F.col(key).cast("long").alias("id"), F.array_sort(F.array_distinct(members)).alias("members"))
    sets = materialize(sets.where(F.size("members") >= least), "members")
    # the key is 128 bits of hash, so that the members are shuffled once only
    keyed = sets.select("*", F.xxhash64("members").alias("h"), F.xxhash64(F.lit(1), "members").alias("g"))
    own = keyed.join(keyed.groupBy("h", "g").agg(F.min("id").alias("cls"), F.count("*").alias("copies")), ["h", "g"])
    return materialize(own.select("id", "members", "cls", "copies"), "classes")


def class_links(own: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b, copies_a, copies_b): all pairs of different classes of set_classes at or above the similarity, a < b, with their sizes.

    The record pairs behind a link are all copies of a with all of b, however many these are: nothing is expanded here."""
    linked = materialize(similar_classes(own.where("id = cls").select("id", "members"), similarity), "links")
    size = own.where("id = cls").select("cls", "copies")
    return linked.join(size.toDF("a", "copies_a"), "a").join(size.toDF("b", "copies_b"), "b").select("a", "b", "copies_a", "copies_b")


def memberships(own: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cls, copies, links): the class of every record that has a set, the copies in it, and how many other records it is linked with."""
    ends = links.select(F.col("a").alias("cls"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("cls"), F.col("copies_a").alias("n")))
    by = ends.groupBy("cls").agg(F.sum("n").alias("others"))
    return own.select("id", "cls", "copies").join(by, "cls", "left").select("id", "cls", "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))


def similar_pairs(df: DataFrame, key: str, fields: list[str], loaded: str | None = None, similarity: float = 0.8, least: int = 6, full: int = 64, names: tuple[str, str] = ("id_a", "id_b")) -> DataFrame:
    """All pairs (a < b) of records of df whose sets have at least `least` members and the Jaccard similarity or more.

    Nulls and empty fields have no members and so no pairs; rows delivered again count once; a column that happens to have
    one of the names used here is no matter, as only key and fields are read. Equal sets are joined as one class. A class
    of up to `full` copies comes out as all of its pairs; a larger one as pairs of its least id with each copy, and a pair
    of classes of more than full * full record pairs as each record with the least id of the other class: no record loses
    its link, but a class of a third of all rows isn't squared. class_links and memberships have the same result for classes
    of every size alike.
    """
    own = set_classes(df, key, fields, loaded, least)
    sized = materialize(class_links(own, similarity), "sized").select("a", "b", F.col("copies_a").alias("n_a"), F.col("copies_b").alias("n_b"))
    m = own.select("id", "cls", "copies")
    few = m.where((F.col("copies") > 1) & (F.col("copies") <= full))
    inside = few.alias("x").join(few.alias("y"), (F.col("x.cls") == F.col("y.cls")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    spokes = m.where((F.col("copies") > full) & (F.col("id") != F.col("cls"))).select(F.col("cls").alias("a"), F.col("id").alias("b"))
    within = F.col("n_a") * F.col("n_b") <= full * full
    of_a, of_b = m.select(F.col("cls").alias("a"), F.col("id").alias("x")), m.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    across = sized.where(within).join(of_a, "a").join(of_b, "b").select("x", "y")
    large = sized.where(~within)
    across = across.unionByName(large.join(of_a, "a").select("x", F.col("b").alias("y"))).unionByName(large.join(of_b, "b").where("y <> b").select(F.col("a").alias("x"), "y"))
    return inside.unionByName(spokes).unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).toDF(*names)
