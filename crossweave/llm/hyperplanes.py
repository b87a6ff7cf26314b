"""Near-duplicate vectors: random-hyperplane sign hashing, exact cosine, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.components import components
from crossweave.llm.registry import query, table
from crossweave.session import stage

#: Rows of a bucket that one task compares with as many others.
BLOCK = 256


def table_plan(rows: int, threshold: float, miss: float = 1e-4) -> tuple[int, int]:
    """(bits a table, tables): about one chance neighbour a bucket, and at most `miss` of the pairs at the
    threshold in no common bucket. Pairs above it are missed less."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def _signs(planes: int, bits: int, seed: int):
    """Adds the bucket of every table: the signs of `bits` random projections as one integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors, out = batch.column("embedding").to_pylist(), [None] * batch.num_rows
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for d, rows in by_size.items():
                if d not in normals:
                    normals[d] = np.random.default_rng((seed, d)).standard_normal((d, planes * bits))
                x = np.array([vectors[i] for i in rows], dtype=np.float64)
                # the direction is all that counts, and very large components must not overflow
                sign = (x / np.abs(x).max(axis=1, keepdims=True)) @ normals[d] > 0
                keys = sign.reshape(len(rows), planes, bits) @ weights
                for i, k in zip(rows, keys):
                    out[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))],
                                             names=[*batch.schema.names, "buckets"])
    return run


def _compare(threshold: float):
    """For rows sorted by (table, group, bucket, one, two): link counts and a spanning set of links of each block pair."""
    def links(rows: list[dict]) -> list[tuple[int, int, int]]:
        if len(rows) < 2:
            return []
        x = np.array([r["embedding"] for r in rows], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        norm = np.sqrt((x * x).sum(axis=1))
        near = (x @ x.T) / np.outer(norm, norm) >= threshold
        np.fill_diagonal(near, False)
        if rows[0]["one"] != rows[0]["two"]:
            block = np.array([r["block"] for r in rows])
            near &= block[:, None] != block[None, :]
        if not near.any():
            return []
        a, b = np.nonzero(near)
        buckets = np.array([r["buckets"] for r in rows])
        # a pair that shares buckets of several tables counts in the first of them
        first = (buckets[a] == buckets[b]).argmax(axis=1) == rows[0]["plane"]
        size = np.array([r["copies"] for r in rows])
        count = np.bincount(a[first], weights=size[b[first]], minlength=len(rows)).astype(np.int64)
        label = np.array([r["rep"] for r in rows], dtype=np.int64)
        rep, most = label.copy(), np.iinfo(np.int64).max
        while True:
            new = np.minimum(label, np.where(near, label[None, :], most).min(axis=1))
            if (new == label).all():
                break
            label = new
        return [(int(r), int(c), int(t)) for r, c, t in zip(rep, count, label) if c or r != t]

    key = ("plane", "label", "bucket", "one", "two", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 3], names=["rep", "links", "to"])

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (now := tuple(row[k] for k in key)) != at:
                    out += links(held)
                    held, at = [], now
                held.append(row)
            yield batch_of(out)
        yield batch_of(links(held))
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label", seed: int = 11) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector; links join equal labels at cosine >= threshold.

    Equal vectors of a label are one node with a number of copies, so copies are never paired out. Buckets that
    one node alone has are dropped before vectors are shuffled. A larger bucket is cut into blocks, each pair of blocks
    compared by a matrix product in its own group; what leaves it is one count a vector and a spanning set of links.
    A task so holds two blocks, however large a bucket is; all pairs of different vectors in it are looked at.

    Vectors that are null, empty, zero, or hold nulls or non-finite numbers, and rows with a null label or id
    have 0 links and are kept. Ids name vectors: rows that repeat an id and its vector count as copies. Only
    vectors of one length are compared. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"),
                          F.col(label_col).cast("string").alias("label"))
    good = F.expr("""id is not null and label is not null and size(embedding) > 0
        and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)""")
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    nodes = stage(rows.where("good").groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "vectors")
    bits, planes = table_plan(nodes.count(), threshold)
    schema = "label string, embedding array<double>, rep long, copies long, buckets array<long>"
    signed = stage(nodes.mapInArrow(_signs(planes, bits, seed), schema), "signs")
    places = signed.select("rep", "label", F.size("embedding").alias("size"), F.posexplode("buckets").alias("plane", "bucket"))
    shared = places.groupBy("plane", "label", "size", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    places = places.join(shared, ["plane", "label", "size", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    places = places.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    places = places.select("rep", "label", "size", "plane", "bucket", "block", F.least("block", "other").alias("one"),
                           F.greatest("block", "other").alias("two"))
    key = ["plane", "label", "bucket", "one", "two", "size"]
    groups = places.join(signed.drop("label"), "rep").repartition(*key).sortWithinPartitions(*key)
    found = stage(groups.mapInArrow(_compare(threshold), "rep long, links long, to long"), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    known = nodes.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "embedding", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                         F.coalesce("component", "rep").alias("c"))
    out = rows.where("good").join(known, ["label", "embedding"]).select("id", "n", "c")
    out = out.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("c")).alias("kept"))


@query("op3_near_vectors")
def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
