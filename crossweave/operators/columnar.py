"""Ranks of many columns inside groups, from one histogram, without a row per cell.

The rows are written in chunks. Each task turns its rows into sorted arrays of different values and their counts, one pair for every
(chunk, group, column); the arrays of a (group, column) meet in one task, which finds every value's place among all; the
places go back to the chunks that asked, where each row looks up its own. So a cell costs eight or sixteen bytes in two
exchanges, and a row crosses the network once, however many columns are ranked. A group of more than LARGE rows is cut into
ranges of about as many by approximate quantiles; any cuts give the same ranks, and a value with very many copies is one
entry of an array. Means and spreads of the ranks follow from the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from crossweave.session import stage

#: Rows of a chunk (a power of two), and rows of a group and column that meet in one task.
CHUNK_BITS, LARGE = 15, 200_000

#: Column that numbers the rows of a written table, and so spares the rank a copy of them (see `numbered`).
ROW = "__row"

PIECES = "chunk long, key string, feature int, cell int, values array<double>, counts array<long>"
PLACES = ("chunk long, key string, feature int, cell int, values array<double>, dense array<long>, below array<long>, copies array<long>, "
          "different long, rows long, ties double")


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values, kind))


def _double(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values with -0 as 0, is known); NaN is a value, above all others."""
    known = ~column.is_null().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else ~np.asarray(column.is_null())
    return np.asarray(column.fill_null(0.0), dtype=float) + 0.0, known


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins; NaNs are equal."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= (c[1:] != c[:-1]) & ((c[1:] == c[1:]) | (c[:-1] == c[:-1]))
    return np.flatnonzero(new)


def _count(columns: list[str], edges: dict[tuple[str, int], list[float]]):
    """Sorted different values and their counts of every (chunk, key, column) of a batch, cut at the edges of large groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("__key").dictionary_encode()
            names, group = coded.dictionary.to_pylist(), coded.indices.to_numpy()
            chunk = batch.column("__chunk").to_numpy()
            for j, name in enumerate(columns):
                value, known = _double(batch.column(name))
                order = np.flatnonzero(known)
                order = order[np.lexsort((value[order], group[order], chunk[order]))]
                c, g, v = chunk[order], group[order], value[order]
                at = _starts(c, g, v)
                count = np.diff(np.append(at, len(v)))
                c, g, v = c[at], g[at], v[at]
                cell = np.zeros(len(v), dtype=np.int64)
                for k in [k for k, n in enumerate(names) if (n, j) in edges]:
                    cell[g == k] = np.searchsorted(edges[names[k], j], v[g == k], side="right")
                at = _starts(c, g, cell)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[at]), pa.array([names[k] for k in g[at]]), pa.array(np.full(len(at), j), pa.int32()), pa.array(cell[at], pa.int32()),
                         _lists(v, at, pa.float64()), _lists(count, at, pa.int64())], names=["chunk", "key", "feature", "cell", "values", "counts"])
    return run


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the values of each (key, column, cell), whose pieces follow each other, handed back piece by piece."""
    def made(key: tuple, pieces: list[tuple]) -> pa.RecordBatch:
        values = np.concatenate([p[1] for p in pieces])
        every, of = np.unique(values, return_inverse=True)
        copies = np.bincount(of, np.concatenate([p[2] for p in pieces])).astype(np.int64)
        below = np.cumsum(copies) - copies
        starts = np.cumsum([0, *[len(p[1]) for p in pieces]])[:-1]
        n, t = len(pieces), copies.astype(float)
        same = [pa.array([x] * n, kind) for x, kind in ((len(every), pa.int64()), (int(copies.sum()), pa.int64()), (float((t ** 3 - t).sum()), pa.float64()))]
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pieces], pa.int64()), *[pa.array([x] * n, kind) for x, kind in zip(key, (pa.string(), pa.int32(), pa.int32()))],
             _lists(values, starts, pa.float64()), *[_lists(x, starts, pa.int64()) for x in (of, below[of], copies[of])], *same],
            names=["chunk", "key", "feature", "cell", "values", "dense", "below", "copies", "different", "rows", "ties"])

    at, held = None, []
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))
        chunks, lists = batch.column(0).to_pylist(), [(batch.column(i).flatten().to_numpy(), np.asarray(batch.column(i).offsets) - batch.column(i).offsets[0].as_py()) for i in (4, 5)]
        (values, v_at), (counts, c_at) = lists
        for i, key in enumerate(keys):
            if key != at:
                if held:
                    yield made(at, held)
                at, held = key, []
            held.append((chunks[i], values[v_at[i]:v_at[i + 1]], counts[c_at[i]:c_at[i + 1]]))
    if held:
        yield made(at, held)


def _form(form: str, dense, below, copies, different, rows, ties) -> np.ndarray:
    if form == "scaled":
        return (dense / (different - 1)) * 2 - 1 if different > 1 else np.full(len(dense), np.nan)
    average = below + (copies + 1) / 2
    if form == "average":
        return average
    if form == "percentile":
        return (average - 1) / (rows - 1) - 0.5 if rows > 1 else np.zeros(len(dense))
    spread = np.sqrt(max((rows ** 3 - rows - ties) / (12 * rows), 0.0))
    if form == "z" and not spread > 0:
        return np.full(len(dense), np.nan)
    return (average - (rows + 1) / 2) / (spread if spread > 0 else 1.0)


FORMS = ("scaled", "average", "percentile", "unit", "z")


def _look_up(columns: list[str], outs: list[str], form: str, schema: StructType):
    kept = [f.name for f in schema.fields if f.name not in outs]

    def run(rows: pa.Table, places: pa.Table) -> pa.Table:
        out = [np.full(rows.num_rows, np.nan) for _ in columns]
        given = [_double(rows.column(c)) for c in columns]
        coded = rows.column("__key").combine_chunks().dictionary_encode()
        group = coded.indices.to_numpy()
        order = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[order], np.arange(len(coded.dictionary) + 1))
        mine = {k: order[edge[i]:edge[i + 1]] for i, k in enumerate(coded.dictionary.to_pylist())}
        for p in places.to_batches():
            lists = {n: (p.column(n).flatten().to_numpy(), np.asarray(p.column(n).offsets) - p.column(n).offsets[0].as_py()) for n in ("values", "dense", "below", "copies")}
            rest = [p.column(n).to_pylist() for n in ("key", "feature", "different", "rows", "ties", "dense_before", "rows_before")]
            for i, (key, j, different, n, ties, dense_before, rows_before) in enumerate(zip(*rest)):
                values, dense, below, copies = (v[a[i]:a[i + 1]] for v, a in lists.values())
                value, known = given[j]
                here = mine[key][known[mine[key]]]
                at = np.minimum(np.searchsorted(values, value[here]), len(values) - 1)
                hit = (values[at] == value[here]) | (np.isnan(values[at]) & np.isnan(value[here]))
                here, at = here[hit], at[hit]
                out[j][here] = _form(form, dense[at] + dense_before, below[at] + rows_before, copies[at], different, float(n), ties)
        return pa.Table.from_arrays([rows.column(c) for c in kept] + [pa.array(o, pa.float64(), from_pandas=True) for o in out], names=kept + outs)
    return run


def _edges(rows: DataFrame, columns: list[str]) -> dict[tuple[str, int], list[float]]:
    """Inner cuts of the groups of more than LARGE rows, by approximate quantiles of each column."""
    large = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).collect()
    edges = {}
    for r in large:
        points = [i / -(-r["n"] // LARGE) for i in range(1, -(-r["n"] // LARGE))]
        cuts = rows.where(F.col("__key") == r["__key"]).agg(*[F.percentile_approx(F.col(c), points, 10 * len(points) + 100).alias(f"c{j}") for j, c in enumerate(columns)]).first()
        edges |= {(r["__key"], j): sorted(set(cuts[j])) for j in range(len(columns)) if cuts[j]}
    return edges


def numbered(df: DataFrame) -> DataFrame:
    """df with a number for each row, to be written before it is ranked: a number must stay with its row."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def ranked_columns(df: DataFrame, keys: list[str], columns: dict[str, str], form: str) -> DataFrame:
    """df with the rank of each column inside `keys` beside it; `columns` maps input to output columns, nulls stay null.

    form: "average" (ties share their mean rank), "percentile" (the same from -0.5 to 0.5, 0 for a single row), "scaled" (dense ranks from -1 to 1, null where a group has one value), "unit"
    (average ranks less their mean, over their population sd, or over 1 where that is 0) or "z" (the same, null where it is 0).
    A null key is a group; NaN ranks above all other values; an empty table stays empty. Rows of a written table that `numbered` has
    numbered are read again where others are written first; their numbers go.
    """
    if form not in FORMS:
        raise ValueError(f"form is one of {FORMS}")
    names, outs = list(columns), list(columns.values())
    inner = [f"__v{j}" for j in range(len(names))]
    given = df.select("*", F.to_json(F.struct(*keys)).alias("__key"), *[F.col(c).cast("double").alias(v) for c, v in zip(names, inner)])
    rows = given if ROW in df.columns else stage(numbered(given), "rows", codec="zstd")
    rows = rows.withColumn("__chunk", F.shiftright(ROW, CHUNK_BITS)).drop(ROW)
    edges = _edges(rows, inner)
    pieces = rows.select("__chunk", "__key", *inner).mapInArrow(_count(inner, edges), PIECES)
    pieces = pieces.repartition("key", "feature", "cell").sortWithinPartitions("key", "feature", "cell")
    places = stage(pieces.mapInArrow(_place, PLACES), "places", codec="zstd")
    if edges:
        group, lower = W.partitionBy("key", "feature"), W.partitionBy("key", "feature").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
        totals = places.groupBy("key", "feature", "cell").agg(*[F.first(c).alias(c) for c in ("different", "rows", "ties")])
        totals = totals.select("key", "feature", "cell", *[F.sum(c).over(group).alias(c) for c in ("different", "rows", "ties")],
                               *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(n) for c, n in (("different", "dense_before"), ("rows", "rows_before"))])
        places = places.drop("different", "rows", "ties").join(totals, ["key", "feature", "cell"])
    else:
        places = places.withColumn("dense_before", F.lit(0).cast("long")).withColumn("rows_before", F.lit(0).cast("long"))
    schema = StructType(rows.schema.fields + [StructField(o, DoubleType()) for o in outs])
    found = rows.groupBy("__chunk").cogroup(places.withColumnRenamed("chunk", "__chunk").groupBy("__chunk")).applyInArrow(_look_up(inner, outs, form, schema), schema)
    return found.drop("__chunk", "__key", *inner)
