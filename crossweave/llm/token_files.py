"""Token ids of documents in range-coded block files, and reading them back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crossweave.llm.encoding import encoder
from crossweave.llm.range_coder import BLOCK, decode_blocks, encode_blocks, shift_crc32
from crossweave.llm.registry import query, table, tokenizer_path
from crossweave.session import stage_root

LANES = 512
FILE_SCHEMA = "part int, block long, before long, docs array<long>, first_doc long, sizes array<long>, starts boolean, payload binary"


def _shares(n: int) -> list[tuple[int, int]]:
    """Ranges of n blocks that are coded in step: about equal ones of at most LANES."""
    parts = -(-n // LANES)
    return [(n * k // parts, n * (k + 1) // parts) for k in range(parts)]


def write_tokens(docs: DataFrame, folder: str, path: str, spaces: str, end_id: int, vocabulary: int,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each with end_id behind it, in ascending id order.

    Folder layout: one file per range of ids, one row per block of at most BLOCK ids: the part and
    block number, the ids before it in the part, the ids of its documents with their share of the
    block, whether the first document starts here, and the checksummed payload. Files are written by
    Spark's committer, so a task that is lost and run again leaves one copy.

    A null text is an empty one (end_id only); rows with a null id come first; rows with equal ids stay
    separate documents, one after the other; an empty table gives an empty folder of the same schema;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, spaces).encode_many, TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        marks: list[tuple] = []  # (id, document number, length) of what is held
        size = before = block = number = 0
        cut = -1  # number of the document whose first ids went out with an earlier block

        def flush(last: bool):
            nonlocal held, marks, size, before, block, cut
            data = np.concatenate(held)
            n = len(data) if last else len(data) // BLOCK * BLOCK
            blocks = [data[i:min(i + BLOCK, n)] for i in range(0, n, BLOCK)]
            rows, k, left = [], 0, marks[0][2] if marks else 0
            for ids in blocks:
                room, mine = len(ids), []
                starts = marks[k][1] != cut
                first = marks[k][1]
                while room:
                    take = min(room, left)
                    mine.append((marks[k][0], take))
                    room, left, cut = room - take, left - take, marks[k][1]
                    if not left:
                        k += 1
                        left = marks[k][2] if k < len(marks) else 0
                rows.append((part, block, before, [d for d, _ in mine], first, [t for _, t in mine], starts))
                block, before = block + 1, before + len(ids)
            coded = [c for a, b in _shares(len(blocks)) for c in encode_blocks(blocks[a:b], vocabulary)]
            marks = ([(marks[k][0], marks[k][1], left)] + marks[k + 1:]) if k < len(marks) else []
            held, size = [data[n:].copy()], len(data) - n
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k_) for c, k_ in zip(columns, kinds)] + [pa.array(coded, pa.binary())],
                                              names=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            docs, at = batch.column(0).to_pylist(), 0
            for ids, counts in encode(batch.column(1).to_pylist()):
                held.append(np.insert(ids, np.cumsum(counts), end_id))
                marks += zip(docs[at:at + len(counts)], range(number, number + len(counts)), (counts + 1).tolist())
                at, number, size = at + len(counts), number + len(counts), size + len(held[-1])
                if size >= LANES * BLOCK:
                    yield flush(False)
        if size:
            yield flush(True)

    ordered = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, vocabulary: int, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document from the files; every block is checked.

    Blocks decode where they are read. Only sizes and checksums are shuffled: a document that lies in
    several blocks gets its checksum from those of its pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _shares(batch.num_rows):
                rows = batch.slice(lo, hi - lo).to_pylist()
                out = []
                for row, ids in zip(rows, decode_blocks([r["payload"] for r in rows], vocabulary)):
                    raw, at = ids.astype("<u4").tobytes(), 0
                    for k, (doc, n) in enumerate(zip(row["docs"], row["sizes"])):
                        out.append((doc, row["part"], row["first_doc"] + k, row["before"] + at, n, zlib.crc32(raw[4 * at:4 * (at + n)])))
                        at += n
                kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 6, kinds)],
                                                 names=["doc", "part", "number", "place", "n", "crc"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("pieces")
            n, crc = (pieces.flatten().field(k).to_numpy() for k in ("n", "crc"))
            first = np.concatenate([[0], np.cumsum(pieces.value_lengths().to_numpy())])
            ends = np.concatenate([[0], np.cumsum(n)])
            behind = np.repeat(ends[first[1:]], np.diff(first)) - ends[1:]
            crc = np.bitwise_xor.reduceat(shift_crc32(crc, 4 * behind), first[:-1]) if len(crc) else crc
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(crc, pa.int64())], names=["doc", "part", "place", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(FILE_SCHEMA).parquet(folder)
    pieces = blocks.select("payload", "docs", "sizes", "part", "first_doc", "before").mapInArrow(
        run, "doc long, part int, number long, place long, n long, crc long")
    whole = pieces.groupBy("doc", "part", "number").agg(
        F.min("place").alias("place"), F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("place", "n", "crc"))).alias("pieces"))
    whole = whole.select("doc", "part", "place", "n_tokens", "pieces").mapInArrow(
        combine, "doc long, part int, place long, n_tokens long, ids_crc32 long")
    # one row per range of ids, as many as tasks wrote
    parts = blocks.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    return whole.join(parts, "part").select(F.col("doc").alias(id_col), (F.col("base") + F.col("place")).alias("start"),
                                            "n_tokens", "ids_crc32")


@query("op1_range_coded_ids")
def op1_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_root(spark)}/token-files-{uuid.uuid4().hex[:12]}"
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), "drop", 1, 49408)
    return read_tokens(spark, folder, 49408)
