"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.held import held
from crossweave.llm.registry import query, refuse_names, table

# Words are runs of ASCII digits, ASCII letters (lower-cased) and characters from U+0080 up.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_SPLIT).split() if text else []


class SuffixAutomaton:
    """All word sequences of the items; states know which windows end in them and whose they are.

    A window is `width` consecutive words of an item; an item of fewer words, but not none, is one window.
    """

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        coded = [(key, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for key, words in items if words]
        for _, ids in coded:
            last = 0
            for w in ids:
                last = self.extend(last, w)
        marks: dict[int, dict[int, set]] = {}
        self.shortest = width
        for key, ids in coded:
            size = min(width, len(ids))
            self.shortest = min(self.shortest, size)
            state = 0
            for i, w in enumerate(ids):
                state = self.next[state][w]
                if i + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    marks.setdefault(at, {}).setdefault(size, set()).add(key)
        # windows that end in a state: its own and those of the states its suffix links lead to
        self.ends: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = marks.get(state, {})
            self.ends[state] = self.ends[self.link[state]] + tuple((n, frozenset(own[n])) for n in sorted(own))

    def extend(self, last: int, w: int) -> int:
        have = self.next[last].get(w)
        if have is not None:
            return have if self.length[have] == self.length[last] + 1 else self.split(last, w, have)
        new = self.state({}, -1, self.length[last] + 1)
        while last != -1 and w not in self.next[last]:
            self.next[last][w] = new
            last = self.link[last]
        if last == -1:
            self.link[new] = 0
        else:
            to = self.next[last][w]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self.split(last, w, to)
        return new

    def split(self, source: int, w: int, to: int) -> int:
        """A copy of state `to` for the shorter words that reach it from source and its suffixes."""
        copy = self.state(dict(self.next[to]), self.link[to], self.length[source] + 1)
        self.link[to] = copy
        while source != -1 and self.next[source].get(w) == to:
            self.next[source][w] = copy
            source = self.link[source]
        return copy

    def state(self, follow: dict, link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """(word ranges [start, end) inside windows, merged and in order; items with a window here).

        The longest match that ends at each word is followed through the automaton. It cannot reach past a word that
        no item has, so only runs of known words of at least the shortest window are streamed.
        """
        if len(words) < self.shortest or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate(([False], ids > 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        first, last = edge[0::2], edge[1::2]
        long = last - first >= self.shortest
        spans, items = [], set()
        for a, b in zip(first[long].tolist(), last[long].tolist()):
            state = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                to = self.next[state].get(w)
                while to is None and state:
                    state = self.link[state]
                    matched = self.length[state]
                    to = self.next[state].get(w)
                if to is None:
                    matched = 0
                    continue
                state, matched = to, matched + 1
                if matched >= self.shortest and self.ends[state]:
                    found = [e for e in self.ends[state] if e[0] <= matched]
                    if found:
                        for _, keys in found:
                            items |= keys
                        start = i + 1 - found[-1][0]
                        while spans and spans[-1][1] >= start:
                            start = min(start, spans.pop()[0])
                        spans.append((start, i + 1))
        return spans, items


def _automaton(items: list[tuple], width: int) -> SuffixAutomaton:
    """One automaton per worker and item block, kept from task to task."""
    key = hashlib.sha256(repr((width, items)).encode()).hexdigest()
    return held(("automaton", key), lambda: SuffixAutomaton([(k, words_of(t)) for k, t in items], width))


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, limit_bytes: int) -> list[list[tuple]]:
    """The query set in blocks of about block_bytes; more than limit_bytes in all is refused, not cut."""
    blocks, held, total = [[]], 0, 0
    for key, text in items.select(id_col, text_col).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).distinct().toLocalIterator():
        size = len(text.encode())
        held, total = held + size, total + size
        if total > limit_bytes:
            raise ValueError(f"the benchmark has more than {limit_bytes} bytes; pass it in parts")
        if blocks[-1] and held > block_bytes:
            blocks.append([])
            held = size
        blocks[-1].append((key, text))
    return [sorted(b, key=repr) for b in blocks]


def overlaps(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", block_bytes: int = 2_000_000, limit_bytes: int = 64_000_000, keep: bool = False, finish=None) -> DataFrame:
    """(id, text, n_words, spans, items) of every document: word ranges inside windows of items, and the items found.

    The items are a stated query set with a checked bound. Their automata (one per block of items) travel with the tasks,
    and documents stream past them in one stage, without a shuffle. keep=True carries all columns of docs, else id and text.
    finish, if given, turns a batch and what was found in its rows into rows of docs, in the pass over the last block.

    Null texts and texts without words have no words and no hits; items with a null id or text or without words have no
    window; repeated rows are judged each, and repeated items count once; empty tables are fine on both sides. A column named
    __found is refused.
    """
    refuse_names(docs, "__found")
    docs = docs if keep else docs.select(id_col, text_col)
    blocks = item_blocks(items, item_id, item_text, block_bytes, limit_bytes)
    added = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>>"
    out = docs.withColumn("__found", F.lit(None).cast(added))
    schema = out.schema
    for number, block in enumerate(blocks, 1):
        last = finish if number == len(blocks) else None

        def run(batches: Iterator[pa.RecordBatch], block=block, last=last) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(block, width)
            for batch in batches:
                found = []
                for text, before in zip(batch.column(text_col), batch.column("__found").to_pylist()):
                    words = words_of(text.as_py())
                    spans, keys = automaton.stream(words)
                    if before:
                        spans = merge([*spans, *((s["first"], s["last"]) for s in before["spans"])])
                        keys = {*map(str, keys), *before["items"]}
                    found.append({"n_words": len(words), "spans": [{"first": a, "last": b} for a, b in spans], "items": sorted(map(str, keys))})
                at = batch.schema.get_field_index("__found")
                yield last(batch, found) if last else batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))
        out = out.mapInArrow(run, docs.schema if last else schema)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, max_span: int = 0, max_coverage: float = 0.5, width: int = 10,
                  id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """docs without documents of which more than max_coverage of the words lie in windows; spans of more than max_span
    words are cut out of the others (from the first byte of the first word to the last of the last). Columns stay."""
    columns = docs.columns

    def cut(batch: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        texts, stay = batch.column(text_col).to_pylist(), []
        for i, f in enumerate(found):
            hit = sum(s["last"] - s["first"] for s in f["spans"])
            if f["n_words"] and hit > max_coverage * f["n_words"]:
                continue
            stay.append(i)
            spans = [(s["first"], s["last"]) for s in f["spans"] if s["last"] - s["first"] > max_span]
            if spans:
                raw = texts[i].encode()
                place = [m.span() for m in _WORD.finditer(raw)]
                parts, at = [], 0
                for a, b in spans:
                    parts.append(raw[at:place[a][0]])
                    at = place[b - 1][1]
                texts[i] = b"".join([*parts, raw[at:]]).decode()
        at = batch.schema.get_field_index(text_col)
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(columns).take(pa.array(stay, pa.int64()))

    return overlaps(docs, items, width, id_col, text_col, keep=True, finish=cut, **more)


@query("op6_benchmark_overlap")
def op6_benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(__found.spans, 0L, (n, s) -> n + s.last - s.first)")
    return found.select("doc_id", F.col("__found.n_words").alias("n_words"), n_hit.alias("n_hit"),
                        F.size("__found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
