"""Rows that move between tasks as small compressed tables: where all rows of a large table must meet another twice, this is a fraction of what a join shuffles.

Parts are ranges of a column: rows that lie beside one another in a table mostly have ids that do, so a task's rows go to few parts however many there are, and what they take grows with their number only.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

#: Rows that a task packs, or opens, at once.
ROWS = 1 << 20
#: Values read for each bound between parts. They only balance the parts; every row is in one.
BOUND_VALUES = 100
PACKED, SCHEMA = pa.schema([("part", pa.int32()), ("rows", pa.binary())]), "part int, rows binary"


def bounds(rows: DataFrame, by: str, n: int, count: int) -> list:
    """Values of a column that part its so many rows into n ranges of about as many rows, or fewer where values are few. The rows of one value stay together."""
    some = sorted(x for (x,) in rows.select(by).where(f"{by} IS NOT NULL").sample(min(1.0, n * BOUND_VALUES / max(count, 1)), 1).collect())
    return sorted({some[len(some) * i // n] for i in range(1, n)}) if some else []


def pack(t: pa.Table, by: str, at: list) -> pa.Table:
    """(part, rows) of a table: its rows in parts that begin at the bounds, in the order of the column. Nulls are in the last."""
    t = t.sort_by(by).combine_chunks()
    known = t[by].combine_chunks().slice(0, len(t) - t[by].null_count)
    if pa.types.is_string(known.type):  # in bytes, as both sort
        known, at = known.cast(pa.binary()), [x.encode() for x in at]
    ends = np.array([0, *(bisect.bisect_left(known, x, key=lambda v: v.as_py()) for x in at), len(t)])
    found = np.flatnonzero(np.diff(ends))
    return pa.table([pa.array(found, pa.int32()), pa.array([shut(t.slice(ends[p], ends[p + 1] - ends[p]), by) for p in found], pa.binary())], PACKED)


def shut(t: pa.Table, by: str) -> bytes:
    """Texts go by what they share with the row before, but those that repeat, out of order, by number."""
    texts = [f.name for f in t.schema if pa.types.is_string(f.type) and (f.name == by or 4 * pc.count_distinct(t[f.name], mode="all").as_py() > len(t))]
    whole = [by] if pa.types.is_integer(t.schema.field(by).type) else []
    to = pa.BufferOutputStream()
    pq.write_table(
        t, to, compression="zstd", use_dictionary=[c for c in t.column_names if c not in texts and c not in whole], dictionary_pagesize_limit=64 << 20,
        column_encoding={c: "DELTA_BYTE_ARRAY" for c in texts} | {c: "DELTA_BINARY_PACKED" for c in whole}, write_statistics=False, store_schema=False,
    )
    return to.getvalue().to_pybytes()


def opened(packed: pa.Table) -> Iterator[pa.Table]:
    """The rows of (part, rows), about ROWS at a time."""
    some, n = [], 0
    for rows in packed["rows"]:
        some.append(pq.read_table(pa.BufferReader(rows.as_buffer()), use_threads=False))
        n += len(some[-1])
        if n >= ROWS:
            yield pa.concat_tables(some)
            some, n = [], 0
    if some:
        yield pa.concat_tables(some)


def packed(rows: DataFrame, by: str, at: list, once: bool = False) -> DataFrame:
    """(part, rows) of rows of strings and numbers, parted by bounds of a column. once: rows that a task packs at once and that are equal go as one."""

    def some_packed(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some)
        yield from pack(distinct_of(t) if once else t, by, at).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, have = [], 0
        for batch in batches:
            some.append(batch)
            have += len(batch)
            if have >= ROWS:
                yield from some_packed(some)
                some, have = [], 0
        if have:
            yield from some_packed(some)

    return rows.mapInArrow(run, SCHEMA)


def distinct_of(t: pa.Table) -> pa.Table:
    return t.group_by(t.column_names, use_threads=False).aggregate([])


def distinct(rows: DataFrame, by: str) -> DataFrame:
    """rows.distinct() of rows of strings and whole numbers; more than a task packs at once move packed, in ranges of a column."""
    count = rows.count()
    if count <= ROWS:
        return rows.distinct()
    names = rows.columns

    def run(part: pa.Table) -> pa.Table:
        seen = []
        for some in opened(part):
            seen.append(some)
            if sum(map(len, seen[1:])) >= len(seen[0]):  # as many again
                seen = [distinct_of(pa.concat_tables(seen))]
        return distinct_of(pa.concat_tables(seen)).select(names)

    return packed(rows, by, bounds(rows, by, -(-count // ROWS), count), once=True).groupBy("part").applyInArrow(run, rows.schema)


def meet(left: DataFrame, on: str, right: DataFrame, step: Callable[[pa.Table], pa.Table], of: pa.Schema = PACKED, schema: str = SCHEMA) -> DataFrame:
    """What a step makes of the rows of left beside those of right, both packed, whose id is the column on, which goes. The step gets some rows of a part at a time."""

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        out = [of.empty_table()]
        if len(rows) and len(others):
            known = pa.concat_tables(opened(others))
            out += [step(t.join(known, on, "id", "inner", use_threads=False).drop_columns(on)).select(of.names).cast(of) for t in opened(rows)]
        return pa.concat_tables(out)

    return left.groupBy("part").cogroup(right.groupBy("part")).applyInArrow(run, schema)
