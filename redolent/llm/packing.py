"""Filling fixed-capacity containers: best-fit decreasing over the whole corpus.

Items are taken by falling size; each goes into the open container with the least room that still holds it, found by a
segment tree over remaining capacities. Items of one size are alike, so the plan is made for runs of them: the driver sees
only how many items there are of each size (at most `capacity` numbers) and gets the very containers that placing item by
item would give. Best fit keeps filling the container it has just used while the size still fits, so a run of c items over
containers with room r takes r // size in each. The number of runs is bounded by the capacity alone (at most 3 new runs a
size, each taking at most sqrt(2 * capacity) different sizes), never by the corpus.

Which item of a size goes where is settled on the executors: items are numbered within their size by hash bucket and id,
and the plan maps number ranges to containers.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redolent.session import materialize, slots


class Run(NamedTuple):
    """Items first..first+count-1 of a size go into containers bin, bin+1, ..., each taking `each` of them."""

    size: int
    first: int
    count: int
    bin: int
    each: int


class RoomTree:
    """Segment tree over remaining capacities: which are open, and the least that holds a size, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.leaves)
        self.at: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, count: int) -> None:
        """Containers first..first+count-1 have this room."""
        insort(self.at.setdefault(room, []), (first, count))
        i = room + self.leaves
        while i and not self.open[i]:
            self.open[i] = 1
            i >>= 1

    def take(self, room: int) -> tuple[int, int]:
        """The earliest interval with this room."""
        intervals = self.at[room]
        out = intervals.pop(0)
        if not intervals:
            i = room + self.leaves
            self.open[i] = 0
            while i > 1:
                i >>= 1
                if self.open[2 * i] or self.open[2 * i + 1]:
                    break
                self.open[i] = 0
        return out

    def tightest(self, size: int) -> int:
        """The least open room >= size, -1 if none."""
        i = size + self.leaves
        if i >= 2 * self.leaves:
            return -1
        if self.open[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        if i <= 1:
            return -1
        while i < self.leaves:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing for counts[size] items of each size 1..capacity; ties go to the container opened first."""
    rooms, runs, opened = RoomTree(capacity), [], 0
    for size in sorted((s for s, c in counts.items() if c), reverse=True):
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} doesn't fit capacity {capacity}")
        left, first = counts[size], 0
        while left:
            room = rooms.tightest(size)
            if room < 0:
                room, at, n, opened = capacity, opened, -(-left // (capacity // size)), opened + -(-left // (capacity // size))
            else:
                at, n = rooms.take(room)
            each = room // size
            full = min(n, left // each)
            if full:
                runs.append(Run(size, first, full * each, at, each))
                first, left = first + full * each, left - full * each
                if room - each * size:
                    rooms.put(room - each * size, at, full)
            if full < n and 0 < left < each:  # the last items of the size fill one container in part
                runs.append(Run(size, first, left, at + full, left))
                if room - left * size:
                    rooms.put(room - left * size, at + full, 1)
                first, left, full = first + left, 0, full + 1
            if full < n:
                rooms.put(room, at + full, n - full)
    return runs


def for_each_limit(lengths: DataFrame, limits: dict[int, int]) -> DataFrame:
    """Every row once for each limit, with limit_id and capacity_tokens."""
    if not limits:
        return lengths.limit(0).withColumns({"limit_id": F.lit(0), "capacity_tokens": F.lit(1)})
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("limit_id"), F.lit(c).cast("int").alias("capacity_tokens")) for i, c in sorted(limits.items())])
    return lengths.select("*", F.inline(each))


def pieces(lengths: DataFrame, limits: dict[int, int], key: str = "doc_id") -> DataFrame:
    """(limit_id, capacity_tokens, key, piece_no, size): each text once for each limit; one longer than the capacity is cut.

    All pieces of a cut text but the last are exactly the capacity."""
    whole = F.ceil(F.col("tokens") / F.col("capacity_tokens")).cast("int")
    return (
        for_each_limit(lengths.where("tokens > 0"), limits)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(1), whole)))
        .select("limit_id", "capacity_tokens", key, "piece_no", F.least("capacity_tokens", F.col("tokens") - (F.col("piece_no") - 1) * F.col("capacity_tokens")).cast("int").alias("size"))
    )


def pack(lengths: DataFrame, limits: DataFrame, key: str = "doc_id", per_bucket: int = 50_000) -> DataFrame:
    """(limit_id, seq_id, key, piece_no, tokens): which sequence each piece of each text stands in, for every capacity.

    lengths: (key, tokens), key unique; more columns are ignored. Texts without tokens (null, empty) need no place: they
    come out once a limit with seq_id and piece_no null. Null or non-positive capacities are no limits; null keys are kept
    and count as one more document. Sequences of a limit are numbered from 0. Empty tables give an empty table.
    Shuffles rows of five numbers twice; a size that a third of all items share is numbered in buckets of about
    per_bucket rows, so no task holds more of it.
    """
    spark = lengths.sparkSession
    lengths = materialize(lengths.select(key, F.coalesce("tokens", F.lit(0)).alias("tokens")), "lengths")
    # a row for each capacity, no table that grows with the corpus
    asked = {r[0]: r[1] for r in limits.where("limit_id IS NOT NULL AND capacity_tokens > 0").groupBy("limit_id").agg(F.max("capacity_tokens")).collect()}
    buckets = max(slots(spark), lengths.count() // per_bucket)
    bucket: Column = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    items = pieces(lengths, asked, key).withColumn("bucket", bucket)
    # how many items of each size, and where each bucket's numbers begin
    counted = materialize(items.groupBy("limit_id", "capacity_tokens", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("limit_id", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("limit_id", "size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    runs: dict[int, list[Run]] = {}
    sizes: dict[tuple[int, int], dict[int, int]] = {}
    for r in counted.groupBy("limit_id", "capacity_tokens", "size").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows a limit
        sizes.setdefault((r.limit_id, r.capacity_tokens), {})[r.size] = r.n
    for (limit, capacity), counts in sizes.items():
        runs[limit] = plan(counts, capacity)
    table = {k: np.array(sorted(v, key=lambda r: (r.size, r.first)), dtype=np.int64).reshape(-1, 5) for k, v in runs.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacities, see above
    kind = lengths.schema[key].dataType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limit, size, number = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3, 4))
            seq = np.zeros(len(size), dtype=np.int64)
            for k in np.unique(limit):
                own, runs_k = limit == k, shared.value[int(k)]
                wide = np.int64(1) << 40
                at = np.searchsorted(runs_k[:, 0] * wide + runs_k[:, 1], size[own] * wide + number[own], side="right") - 1
                r = runs_k[at]
                seq[own] = r[:, 3] + (number[own] - r[:, 1]) // r[:, 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seq), batch.column(1), batch.column(2), batch.column(3)], names=["limit_id", "seq_id", key, "piece_no", "tokens"])

    order = Window.partitionBy("limit_id", "size", "bucket").orderBy(F.col(key).asc_nulls_first(), "piece_no")
    numbered = items.withColumn("rn", F.row_number().over(order)).join(starts, ["limit_id", "size", "bucket"]).select("limit_id", key, "piece_no", "size", (F.col("start") + F.col("rn") - 1).alias("number"))
    placed = numbered.mapInArrow(place, f"limit_id int, seq_id long, `{key}` {kind.simpleString()}, piece_no int, tokens int")
    none = for_each_limit(lengths.where("tokens <= 0"), asked).select("limit_id", F.lit(None).cast("long").alias("seq_id"), key, F.lit(None).cast("int").alias("piece_no"), F.lit(0).alias("tokens"))
    return placed.unionByName(none)


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """(limit_id, capacity_tokens, sequences, items, tokens, unused, fewest): the fill of each limit; fewest: no packing has fewer."""
    by = packed.where("seq_id IS NOT NULL").groupBy("limit_id").agg((F.max("seq_id") + 1).alias("sequences"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return by.join(F.broadcast(limits.select("limit_id", "capacity_tokens")), "limit_id").select("limit_id", "capacity_tokens", "sequences", "items", "tokens", (F.col("sequences") * F.col("capacity_tokens") - F.col("tokens")).alias("unused"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))
