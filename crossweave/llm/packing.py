"""Hierarchical packing of token sequences into windows of several lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.encoding import encoder
from crossweave.llm.registry import query, table, tokenizer_path

TIERS = (64, 128, 256, 512, 1024)


class Packer:
    """Packs pieces (document, start, length) into windows whose lengths are the tiers.

    A document is first cut into full windows of the longest tier; its rest goes to the shortest tier
    that holds it. Windows are made from the longest rest down: what a rest leaves open in its window
    is filled with the longest shorter rests that fit, and the last gap with a cut from the shortest
    rest that is longer. So every window is full until the pieces run out; what then remains is laid
    into powers of two, and under the shortest tier into one padded window. Windows of a tier are
    dealt in step groups of `step` tokens; the last, incomplete groups of the tiers are put together.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, step: int = 8192):
        self.tiers, self.longest, self.step = sorted(tiers), max(tiers), step
        self.rests: dict[int, list] = {}
        self.mask = self.held = 0
        self.open: dict[int, list] = {t: [] for t in self.tiers}
        self.groups: list[list] = []

    def add(self, doc, tokens: int) -> None:
        full = tokens // self.longest * self.longest
        for start in range(0, full, self.longest):
            self.close([(doc, start, self.longest)], self.longest)
        if tokens > full:
            self.put((doc, full, tokens - full))

    def put(self, piece: tuple) -> None:
        self.rests.setdefault(piece[2], []).append(piece)
        self.mask |= 1 << piece[2]
        self.held += piece[2]

    def take(self, length: int) -> tuple:
        piece = self.rests[length].pop()
        if not self.rests[length]:
            self.mask ^= 1 << length
        self.held -= length
        return piece

    def close(self, pieces: list, tier: int) -> None:
        mine = self.open.setdefault(tier, [])
        mine.append(pieces)
        if len(mine) * tier >= self.step:
            self.groups.append(mine)
            self.open[tier] = []

    def pack(self, down_to: int = 0) -> None:
        """Makes windows until at most down_to tokens are held; 0 packs all there is."""
        while self.mask and self.held > down_to:
            n = self.mask.bit_length() - 1
            tier = next(t for t in self.tiers if t >= n)
            window, gap = [self.take(n)], tier - n
            while gap and self.mask:
                fits = (self.mask & ((2 << gap) - 1)).bit_length() - 1
                if fits > 0:
                    window.append(self.take(fits))
                    gap -= fits
                else:
                    above = self.mask >> gap + 1
                    doc, start, length = self.take(gap + (above & -above).bit_length())
                    window.append((doc, start, gap))
                    self.put((doc, start + gap, length - gap))
                    gap = 0
            if gap:
                self.lay_out(window)
            else:
                self.close(window, tier)

    def lay_out(self, pieces: list) -> None:
        """Windows of powers of two from the last pieces; a rest below the shortest tier stays one window."""
        left = sum(p[2] for p in pieces)
        pieces = pieces[::-1]
        while left:
            size = 1 << left.bit_length() - 1
            if size < self.tiers[0]:
                size = left
            window, room = [], size
            while room:
                doc, start, length = pieces.pop()
                if length > room:
                    pieces.append((doc, start + room, length - room))
                    length = room
                window.append((doc, start, length))
                room -= length
            self.close(window, size)
            left -= size

    def finish(self) -> None:
        self.pack()
        group, tokens = [], 0
        for tier in sorted(self.open, reverse=True):
            for window in self.open[tier]:
                group.append(window)
                tokens += tier
                if tokens >= self.step:
                    self.groups.append(group)
                    group, tokens = [], 0
        self.open = {}
        if group:
            self.groups.append(group)


def pack_documents(docs: DataFrame, path: str, spaces: str, end_id: int, tiers: tuple[int, ...] = TIERS, step: int = 8192,
                   pool: int = 1_000_000, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
                   memory: int = 1_600_000) -> DataFrame:
    """One row per piece: where it comes from, its checksum, and its place in a sequence.

    Texts are encoded, some megabytes at a time, and packed in the task that reads them, so no token crosses the network and no group
    is gathered; at most about `pool` tokens wait in a task, and a worker
    remembers the ids of up to `memory` pieces (it changes the speed only). A task leaves one sequence that may need padding.
    with_ids adds the ids themselves. step_group numbers groups of sequences with equal numbers of tokens.

    A null text is empty and has end_id only; null ids and repeated rows are packed like any other row;
    an empty table gives no rows; other columns are not read.
    """
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, spaces, memory).encode_many, end_id.to_bytes(4, "little")
        packer = Packer(tiers, step)
        base = TaskContext.get().partitionId() << 32
        sequence = group_no = 0
        kind = None

        def emit():
            nonlocal sequence, group_no
            out = []
            for group in packer.groups:
                for window in group:
                    size, offset = sum(p[2] for p in window), 0
                    for (doc, ids), start, length in window:
                        raw = ids[4 * start:4 * (start + length)]
                        out.append((doc, start, length, zlib.crc32(raw), len(ids) // 4, base + sequence, offset, size, base + group_no)
                                   + ((raw,) if with_ids else ()))
                        offset += length
                    sequence += 1
                group_no += 1
            packer.groups = []
            kinds = [kind] + [pa.int64()] * 8 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * len(kinds), kinds)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            docs = iter(batch.column(0).to_pylist())
            for many, counts in encode(text.as_py() for text in batch.column(1)):
                raw, at = many.tobytes(), 0
                for n in counts.tolist():
                    ids = raw[at:at + 4 * n] + end
                    at += 4 * n
                    packer.add((next(docs), ids), n + 1)
                    if packer.held > pool:
                        packer.pack(pool // 2)
                    if len(packer.groups) > 64:
                        yield emit()
        packer.finish()
        if packer.groups:
            yield emit()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, "
        "step_group long" + ", ids binary" * with_ids)


@query("op2_packed_sequences")
def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), "lead", 0)
