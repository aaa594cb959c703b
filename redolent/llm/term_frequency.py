"""Frequency of every distinct term by an external sort: how often it occurs and in how many records.

(field, term, record) triples are range-partitioned and sorted by all three, so that the rows of one hot term are dealt
over as many partitions as its share asks for, and Spark's sorter spills where a partition outgrows memory. One scan over
the sorted rows then counts run lengths: occurrences are rows of a term's run, records are the changes of record in it.
All rows of one (term, record) fall into one partition, so the counts of a run that spans partitions add up; that last
addition moves at most one row for each partition and boundary term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redolent.functions.text import folded_items
from redolent.session import materialize


def latest(df: DataFrame, key: str, fields: list[str], loaded: str | None) -> DataFrame:
    """One row a key: of rows loaded again, the latest; null keys are no records."""
    own = df.where(F.col(key).isNotNull())
    at = [F.col(loaded)] if loaded else []
    row = F.max(F.struct(*at, *[F.col(f) for f in fields]))
    return own.groupBy(key).agg(row.alias("_r")).select(key, *[F.col("_r")[f].alias(f) for f in fields])


def term_rows(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, term, record): one row for each occurrence of a folded term in a CSV field."""

    def tagged(field: str) -> Column:
        return F.transform(folded_items(F.col(field)), lambda t: F.struct(F.lit(field).alias("field"), t.alias("term")))

    # folded once: sorting by range reads its input twice, once to sample it
    folded = materialize(records.select(F.concat(*[tagged(f) for f in fields]).alias("_t"), F.col(key).alias("record")), "folded")
    return folded.select(F.inline("_t"), "record")


def run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(field, term, occurrences, records) of sorted rows; a run that goes on in the next batch is carried over."""
    names = ["field", "term", "occurrences", "records"]
    carry: list | None = None  # field, term, occurrences, records, last record
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new_term, new_record = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        if n > 1:
            same = [pc.equal(c.slice(0, n - 1), c.slice(1)).to_numpy(zero_copy_only=False) for c in batch.columns]
            new_term[1:] = ~(same[0] & same[1])
            new_record[1:] = new_term[1:] | ~same[2]
        first = [c[0].as_py() for c in batch.columns]
        if carry and carry[:2] == first[:2]:
            new_record[0] = carry[4] != first[2]
        starts = np.flatnonzero(new_term)
        rows = np.diff(np.append(starts, n))
        records = np.add.reduceat(new_record.astype(np.int64), starts)
        field, term = batch.column(0).take(pa.array(starts)).to_pylist(), batch.column(1).take(pa.array(starts)).to_pylist()
        if carry:
            if carry[:2] == [field[0], term[0]]:
                rows[0] += carry[2]
                records[0] += carry[3]
            else:
                field, term = [carry[0], *field], [carry[1], *term]
                rows, records = np.append(carry[2], rows), np.append(carry[3], records)
        carry = [field[-1], term[-1], int(rows[-1]), int(records[-1]), batch.column(2)[n - 1].as_py()]
        if len(field) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(field[:-1], pa.string()), pa.array(term[:-1], pa.string()), pa.array(rows[:-1].astype(np.int64)), pa.array(records[:-1].astype(np.int64))], names=names)
    if carry:
        yield pa.RecordBatch.from_arrays([pa.array([carry[0]], pa.string()), pa.array([carry[1]], pa.string()), pa.array([carry[2]], pa.int64()), pa.array([carry[3]], pa.int64())], names=names)


def term_frequency(df: DataFrame, key: str, fields: list[str], loaded: str | None = None, rare_below: int = 5, common_above: float = 0.1) -> DataFrame:
    """(field, term, occurrences, records, mark) of every folded term in CSV fields.

    mark: 'rare' below rare_below records, 'common' above the share common_above of all records, else null. A record is a
    distinct non-null key; rows delivered again count once (the latest by `loaded`). Records whose fields are null or
    empty count among all records but have no terms; items that fold to nothing are none. A term can't be both: rare is
    asked first. Other columns are ignored whatever their names; an empty table gives no rows.
    """
    records = latest(df, key, fields, loaded)
    total: Column = df.select(F.count_distinct(key)).scalar()
    rows = term_rows(records, key, fields)
    ordered = rows.repartitionByRange("field", "term", "record").sortWithinPartitions("field", "term", "record")
    runs = ordered.mapInArrow(run_lengths, "field string, term string, occurrences long, records long")
    counts = runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * total, "common")
    return counts.select("field", "term", "occurrences", "records", mark.alias("mark"))
