"""Records of evaluation splits that stand in the training split, exactly or almost: a prefix-filter bipartite join.

Two word sequences are close if they differ in at most a tenth of the words of the longer one. One edit touches at most
`width` shingles of that many words, so of the distinct shingles of either side all but width * edits are shared: in one
order of all shingles, rare ones first, the first width * edits + k of both sides have k in common. These prefixes of the
evaluation records are the index, those of the training records probe it. A hit counts if the lengths allow the edits, if
the shingle stands at about the same place (an edit moves it by one word at most), and if enough of the prefix is left
behind it. Pairs with k hits (fewer where the texts have too few different shingles) are verified by word edit distance.

Equal word sequences are one class and take part once. The order only speeds the join up, results don't depend on it: it
comes from a table of fixed size that counts the shingles of all records by hash slot. A bitmap of the index's shingles,
also of fixed size, spares the shuffle most training shingles.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redolent.session import materialize, spread

#: Words in a shingle.
WIDTH = 5
#: Shingles that the prefixes of a close pair must share (k above): a longer prefix for far fewer pairs to verify.
SHARED = 8
#: Slots of the frequency table (4 bytes each) and bits of the bitmap; fixed, whatever the corpus.
FREQUENCY_SLOTS, BITMAP_BITS = 1 << 18, 1 << 23
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits; case, punctuation, spacing and Unicode form don't matter."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold())
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("ı", "i")
    return _WORD.findall(text.casefold())


def allowed(longer: int) -> int:
    """Edits two sequences may differ in, by the length of the longer one."""
    return longer // 10


def most_edits(n: int) -> int:
    """Edits that any partner of a sequence of n words may need: a partner has at most n / 0.9 words."""
    return allowed(n * 10 // 9)


def edits(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences by bits (one big-integer step an item), most + 1 if above most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    n = len(a)
    if not n:
        return len(b)
    full, last = (1 << n) - 1, 1 << (n - 1)
    plus, minus, distance = full, 0, n
    for k, y in enumerate(b):
        eq = where.get(y, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & last:
            distance += 1
        if down & last:
            distance -= 1
            if distance > most + (len(b) - k):
                return most + 1
        elif distance > most + (len(b) - k):
            return most + 1
        up, down = ((up << 1) | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return distance if distance <= most else most + 1


_KNOWN: dict[str, int] = {}


def _word_hash(word: str) -> int:
    h = _KNOWN.get(word)
    if h is None:
        if len(_KNOWN) > 200_000:
            _KNOWN.clear()
        h = _KNOWN[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the shingles at each place of a normalised text (words joined by one space)."""
    w = np.array([_word_hash(x) for x in text.split(" ")], dtype=np.uint64)
    n = len(w) - WIDTH + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    for i in range(WIDTH if n > 0 else 0):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def records(messages: DataFrame, least_words: int = 64) -> DataFrame:
    """(sample_id, split, source, words, n): question and answer of each record taken together, of at least least_words words.

    Rows delivered again count once (the latest); null ids and splits are left out; a null content has no words."""
    latest = F.struct("ingested_at", "content", "split", "source")
    by = messages.where("sample_id IS NOT NULL AND role IN ('user', 'model', 'assistant')").select("sample_id", F.when(F.col("role") == "user", latest).alias("u"), F.when(F.col("role") != "user", latest).alias("a"))
    whole = by.groupBy("sample_id").agg(F.max("u").alias("u"), F.max("a").alias("a"))
    both = whole.select("sample_id", F.coalesce("u.split", "a.split").alias("split"), F.coalesce("u.source", "a.source").alias("source"), F.concat_ws("\n", "u.content", "a.content").alias("text")).where("split IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t) for t in batch.column(3).to_pylist()]
            keep = [i for i, w in enumerate(found) if len(w) >= least_words]
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array([" ".join(found[i]) for i in keep], pa.string()), pa.array([len(found[i]) for i in keep], pa.int32())], names=["sample_id", "split", "source", "words", "n"])

    return both.mapInArrow(run, "sample_id long, split string, source string, words string, n int")


def classes(recs: DataFrame, train: str, evaluation: tuple[str, ...]) -> DataFrame:
    """(id, side, words, n): a class of equal word sequences of one side, by its least sample_id. side: 't' or 'e'."""
    side = F.when(F.col("split") == train, "t").when(F.col("split").isin(*evaluation), "e")
    own = recs.withColumn("side", side).where("side IS NOT NULL")
    # keyed by a 128-bit hash, so that no long text is a shuffle key
    return own.groupBy("side", F.md5("words").alias("cls"), "n").agg(F.min(F.struct("sample_id", "words")).alias("r"), F.count("*").alias("copies")).select(F.col("r.sample_id").alias("id"), "side", "cls", "n", "copies", F.col("r.words").alias("words"))


def shingle_counts(recs: DataFrame) -> np.ndarray:
    """How many shingles of all records fall into each of the fixed slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FREQUENCY_SLOTS, dtype=np.int64)
        for batch in batches:
            found = [shingles(text) for text in batch.column(0).to_pylist()]
            total += np.bincount((np.concatenate([np.zeros(0, dtype=np.uint64), *found]) >> np.uint64(46)).astype(np.int64), minlength=FREQUENCY_SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], names=["slot", "n"])

    counts = recs.select("words").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(FREQUENCY_SLOTS, dtype=np.int64)
    for r in counts.toLocalIterator():  # at most FREQUENCY_SLOTS rows
        out[r.slot] = r.n
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def prefixes(recs: DataFrame, frequency, bitmap=None) -> DataFrame:
    """(h, id, n, d, place, left): the rarest width * edits + SHARED of the d distinct shingles of each record.

    place: where it stands, -1 if more than once; left: distinct shingles of the record from here on in the common order.
    bitmap: only shingles that are in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequency.value
        bits = bitmap.value if bitmap is not None else None
        for batch in batches:
            parts: list[tuple[np.ndarray, ...]] = []
            for key, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, place, times = np.unique(shingles(text), return_index=True, return_counts=True)
                if not len(h):
                    continue
                place = np.where(times > 1, -1, place)
                order = np.lexsort((h, table[(h >> np.uint64(46)).astype(np.int64)]))[: WIDTH * most_edits(n) + SHARED]
                left = len(h) - np.arange(len(order))
                if bits is not None:
                    bit = (h[order] & np.uint64(BITMAP_BITS - 1)).astype(np.int64)
                    hit = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    order, left = order[hit], left[hit]
                k = len(order)
                parts.append((h[order].view(np.int64), np.full(k, key), np.full(k, n, dtype=np.int32), np.full(k, len(h), dtype=np.int32), place[order].astype(np.int32), left.astype(np.int32)))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "id", "n", "d", "place", "left"])

    return recs.select("id", "n", "words").mapInArrow(run, "h long, id long, n int, d int, place int, left int")


def _bitmap(index: DataFrame) -> np.ndarray:
    """The fixed-size bitmap of the index's shingles (JVM-side bitmap aggregation, 4 KB a row)."""
    slot = F.pmod(F.col("h"), F.lit(BITMAP_BITS)) + 1
    rows = index.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("m"))
    out = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for r in rows.toLocalIterator():  # BITMAP_BITS / 32768 rows
        raw = np.frombuffer(bytes(r.m), dtype=np.uint8)
        out[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(raw)] |= raw
    return out


def class_links(own: DataFrame) -> DataFrame:
    """(e, t, distance): ids of evaluation and training classes whose word sequences are close (0: equal)."""
    sc = own.sparkSession.sparkContext
    left, right = own.where("side = 'e'"), own.where("side = 't'")
    frequency = sc.broadcast(shingle_counts(own))
    index = materialize(prefixes(spread(left), frequency), "index")
    bitmap = sc.broadcast(_bitmap(index))
    probe = prefixes(spread(right), frequency, bitmap)
    e, t = index.toDF("h", "e", "ne", "de", "place_e", "left_e"), probe.toDF("h", "t", "nt", "dt", "place_t", "left_t")
    most = F.floor(F.greatest("ne", "nt") / 10)
    lengths = F.abs(F.col("ne") - F.col("nt")) <= most
    places = (F.col("place_e") < 0) | (F.col("place_t") < 0) | (F.abs(F.col("place_e") - F.col("place_t")) <= most)
    # of a close pair, the first shingles that no edit touches have all those behind them that must be shared
    sure = F.greatest("de", "dt") - WIDTH * most
    left_over = F.least("left_e", "left_t") >= sure - (SHARED - 1)
    hits = e.join(t, "h").where(lengths & places & left_over).groupBy("e", "t").agg(F.count("*").alias("shared"), F.max(F.least(F.lit(SHARED), F.greatest(F.lit(1), sure))).alias("needed"))
    pairs = hits.where("shared >= needed").select("e", "t")
    texts = own.select("id", "words")
    candidates = pairs.join(texts.toDF("e", "we"), "e").join(texts.toDF("t", "wt"), "t")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x == y:
                    out.append((a, b, 0))
                    continue
                u, v = x.split(" "), y.split(" ")
                most = allowed(max(len(u), len(v)))
                d = edits(u, v, most)
                if d <= most:
                    out.append((a, b, d))
            columns = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["e", "t", "distance"])

    return candidates.select("e", "t", "we", "wt").mapInArrow(verify, "e long, t long, distance int")


class Overlap(NamedTuple):
    """links: (train_id, eval_id, distance, copies_train, copies_eval) between classes; members: (sample_id, split, source, side, class_id, copies)."""

    links: DataFrame
    members: DataFrame


def overlap_classes(messages: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("validation", "test"), least_words: int = 64) -> Overlap:
    """Close classes of equal word sequences, one of the training and one of the evaluation side, and the records in each class.

    A class is named by its least sample_id. The record pairs behind a link are all records of one class with all of the other,
    however many; nothing is expanded here. Records of other splits are left out; repeated rows count once; an empty table
    gives neither links nor members."""
    recs = materialize(records(messages, least_words), "records")
    own = materialize(classes(recs, train, evaluation), "classes")
    linked = class_links(own)
    sizes = own.select("id", "copies")
    links = linked.join(sizes.toDF("e", "copies_eval"), "e").join(sizes.toDF("t", "copies_train"), "t")
    links = materialize(links.select(F.col("t").alias("train_id"), F.col("e").alias("eval_id"), "distance", "copies_train", "copies_eval"), "links")
    side = F.when(F.col("split") == train, "t").when(F.col("split").isin(*evaluation), "e")
    keyed = recs.select("sample_id", "split", "source", side.alias("side"), F.md5("words").alias("cls"), "n").where("side IS NOT NULL")
    members = keyed.join(own.select(F.col("id").alias("class_id"), "side", "cls", "n", "copies"), ["side", "cls", "n"]).select("sample_id", "split", "source", "side", "class_id", "copies")
    return Overlap(links, materialize(members, "members"))


def overlaps(found: Overlap, full: int = 4096) -> DataFrame:
    """(train_id, eval_id, distance): one row for each close pair of a training and an evaluation record.

    A pair of classes comes out as all its record pairs if these are at most `full`; beyond that as every record of each side
    with the least id of the other side, so that no record loses its link and a class of a third of all rows isn't multiplied
    with itself. Overlap has the same result for classes of every size alike.
    """
    of_e = found.members.where("side = 'e'").select(F.col("class_id").alias("e"), F.col("sample_id").alias("of_e"))
    of_t = found.members.where("side = 't'").select(F.col("class_id").alias("t"), F.col("sample_id").alias("of_t"))
    links = found.links.withColumnsRenamed({"train_id": "t", "eval_id": "e"})
    small = F.col("copies_eval") * F.col("copies_train") <= full
    some = links.where(small).join(of_e, "e").join(of_t, "t").select(F.col("of_t").alias("train_id"), F.col("of_e").alias("eval_id"), "distance")
    many = links.where(~small)
    rest = many.join(of_e, "e").select(F.col("t").alias("train_id"), F.col("of_e").alias("eval_id"), "distance").unionByName(many.join(of_t, "t").where("of_t <> t").select(F.col("of_t").alias("train_id"), F.col("e").alias("eval_id"), "distance"))
    return some.unionByName(rest)


def memberships(found: Overlap) -> DataFrame:
    """(sample_id, split, source, class_id, copies, links, distance): every record, how many records of the other side it is close to, and the least distance (null: none)."""
    e = found.links.groupBy(F.col("eval_id").alias("class_id")).agg(F.sum("copies_train").alias("links"), F.min("distance").alias("distance")).withColumn("side", F.lit("e"))
    t = found.links.groupBy(F.col("train_id").alias("class_id")).agg(F.sum("copies_eval").alias("links"), F.min("distance").alias("distance")).withColumn("side", F.lit("t"))
    own = found.members.join(e.unionByName(t), ["side", "class_id"], "left")
    return own.select("sample_id", "split", "source", "class_id", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "distance")


def counts(found: Overlap) -> DataFrame:
    """(split, source, records, exact, near): evaluation records and how many of them stand in the training split, by split and source.

    records counts those long enough to compare; a null source is a source of its own."""
    hit = found.links.groupBy(F.col("eval_id").alias("class_id")).agg(F.min("distance").alias("distance"))
    own = found.members.where("side = 'e'").join(hit, "class_id", "left")
    return own.groupBy("split", "source").agg(F.count("*").alias("records"), F.count_if(F.col("distance") == 0).alias("exact"), F.count_if(F.col("distance") > 0).alias("near"))
