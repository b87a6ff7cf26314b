"""Token counts by compiled finite-state transducers, without running a tokenizer over the text.

Two deterministic machines stand in a row:

* The splitter reads characters by class and marks where the tokenizer's pre-tokens begin. Texts are
  cut into chunks of equal length; every chunk computes its state map (exit state for each entry
  state), the maps are composed by a parallel prefix scan, and a second pass from the true entry
  states writes the marks. No chunk waits for another.
* The counter reads the bytes of a pre-token; each transition carries the change in the number of
  tokens that the byte-pair encoding of the bytes read so far has. Its transitions are compiled from the
  merge list when first met, then kept per worker in a hash table and followed for all pre-tokens in step.

A counter state holds what later bytes can depend on: the longest suffix of the input that begins
some token, and, for each place in it where a token may still begin, the last token of the encoding
up to there and how many tokens were counted since.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.registry import query, table, tokenizer_path
from crossweave.llm.words import sub_batches

# Splitter states, and classes of characters.
START, LETTERS, NUMBERS, OTHERS, MARK, MARK_RV, MARK_L, SHORT, SPACE, BLANK = range(10)
END, C_SPACE, C_BLANK, C_LETTER, C_STMD, C_RV, C_L, C_E, C_NUMBER, C_MARK, C_OTHER = range(11)
STATES, CLASSES, CHUNK = 10, 11, 256


def _begin(c: int) -> int:
    """State after a pre-token's first character."""
    if c == END:
        return START
    if c in (C_SPACE, C_BLANK):
        return SPACE if c == C_SPACE else BLANK
    if c <= C_E:
        return LETTERS
    return {C_NUMBER: NUMBERS, C_MARK: MARK, C_OTHER: OTHERS}[c]


def _step(s: int, c: int) -> tuple[int, int]:
    """(next state, marks): mark 1 begins a pre-token at this character, mark 2 at the one before."""
    letter, other = C_LETTER <= c <= C_E, c in (C_MARK, C_OTHER)
    if c == END or s == START:
        return _begin(c), 1
    if s == LETTERS:
        return (LETTERS, 0) if letter else (_begin(c), 1)
    if s == NUMBERS:
        return (NUMBERS, 0) if c == C_NUMBER else (_begin(c), 1)
    if s == OTHERS:
        return (OTHERS, 0) if other else (_begin(c), 1)
    if s == MARK:
        if c in (C_STMD, C_RV, C_L):
            return {C_STMD: SHORT, C_RV: MARK_RV, C_L: MARK_L}[c], 0
        return (OTHERS, 0) if other else (_begin(c), 1)
    if s in (MARK_RV, MARK_L):
        if c == (C_E if s == MARK_RV else C_L):
            return SHORT, 0
        return (LETTERS, 2) if letter else (_begin(c), 3)
    if s == SHORT:
        return _begin(c), 1
    if c in (C_SPACE, C_BLANK):
        return _begin(c), 0
    if s == BLANK:
        return _begin(c), 3
    return (LETTERS if letter else NUMBERS if c == C_NUMBER else OTHERS), 2


_NEXT = np.array([[_step(s, c)[0] for s in range(STATES)] for c in range(CLASSES)], dtype=np.uint8)
_MARKS = np.array([[_step(s, c)[1] for s in range(STATES)] for c in range(CLASSES)], dtype=np.uint8)


def character_classes() -> np.ndarray:
    """Class of every code point, for the pattern that byte-level BPE files of this kind split with."""
    import regex
    table_ = np.full(0x110000, C_OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, c in ((r"\p{L}+", C_LETTER), (r"\p{N}+", C_NUMBER), (r"\s+", C_BLANK)):
        for m in regex.finditer(pattern, every):
            shift = 0x800 if m.start() >= 0xD800 else 0
            table_[m.start() + shift:m.end() + shift] = c
    for chars, c in ((" ", C_SPACE), ("stmd", C_STMD), ("rv", C_RV), ("l", C_L), ("e", C_E), ("'", C_MARK)):
        for x in chars:
            table_[ord(x)] = c
    return table_


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of chunk state maps, in log2(chunks) parallel rounds."""
    maps, width = maps.copy(), 1
    while width < len(maps):
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width], axis=1)
        width *= 2
    return maps


def pre_token_marks(classes: np.ndarray) -> np.ndarray:
    """Whether a pre-token (or an END) begins at each character."""
    n = len(classes)
    lanes = -(-n // CHUNK)
    padded = np.zeros(lanes * CHUNK, dtype=np.intp)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T) * STATES
    follow, marks = _NEXT.ravel(), _MARKS.ravel()
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (lanes, 1))
    for column in columns:
        maps = follow[column[:, None] + maps]
    state = np.full(lanes, START, dtype=np.uint8)
    state[1:] = compose(maps)[:-1, START]
    out = np.empty((CHUNK, lanes), dtype=np.uint8)
    for k, column in enumerate(columns):
        at = column + state
        out[k] = marks[at]
        state = follow[at]
    flat = np.ascontiguousarray(out.T).ravel()[:n]
    begins = (flat & 1).astype(bool)
    begins[:-1] |= (flat[1:] & 2).astype(bool)
    return begins


def _byte_characters() -> dict[str, int]:
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """The counting transducer of one merge list; transitions are compiled on first use."""

    #: Bound on compiled transitions a worker keeps; beyond it the machine starts again from the empty table.
    LIMIT = 1_500_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        code = _byte_characters()
        as_bytes = lambda s: bytes(code[c] for c in s)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.rank, self.parts, self.birth = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.rank[a, b] = r
            if a + b not in self.parts:
                self.parts[a + b], self.birth[a + b] = (a, b), r
        self.begins = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.spines: dict[tuple[bytes, bool], list] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, None, 0),)]
        self.heads: list[bytes] = [b""]
        self.known = {(b"", self.states[0]): 0}
        self.resize(1 << 16)
        self.used = 0

    def resize(self, size: int) -> None:
        self.keys = np.full(size, -1, dtype=np.int64)
        self.target = np.zeros(size, dtype=np.int32)
        self.emit = np.zeros(size, dtype=np.int8)

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int, float]]:
        """(piece, rank that makes it, rank that consumes it) along one edge of a token's merge tree."""
        out = self.spines.get((token, right))
        if out is None:
            out, piece, death = [], token, float("inf")
            while True:
                born = self.birth.get(piece, -1)
                out.append((piece, born, death))
                if born < 0:
                    break
                piece, death = self.parts[piece][right], born
            self.spines[token, right] = out
        return out

    def stands(self, left: bytes | None, token: bytes) -> bool:
        """Whether no merge crosses the border of two tokens while both are being built."""
        if left is None:
            return True
        out = self.pairs.get((left, token))
        if out is None:
            out = True
            for x, made_x, gone_x in self.spine(left, True):
                for y, made_y, gone_y in self.spine(token, False):
                    r = self.rank.get((x, y))
                    if r is not None and max(made_x, made_y) < r < gone_x and r <= gone_y:
                        out = False
            if len(self.pairs) >= self.LIMIT:
                self.pairs.clear()
            self.pairs[left, token] = out
        return out

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, tokens added); a place is (depth, last token before it, tokens since)."""
        head, places = self.heads[state] + bytes((byte,)), self.states[state]
        token, gain = None, 0
        for depth, last, since in places:
            piece = head[len(head) - depth - 1:]
            if piece in self.ids and self.stands(last, piece):
                token, gain = piece, 1 - since
                break
        if token is None:
            raise ValueError("this vocabulary is not a byte-level merge list")
        kept = [(0, token, 0)]
        for depth, last, since in places:
            if head[len(head) - depth - 1:] in self.begins:
                kept.append((depth + 1, last, since + gain))
        kept = tuple(kept)
        head = head[len(head) - max(d for d, _, _ in kept):] if kept[-1][0] or len(kept) > 1 else b""
        to = self.known.get((head, kept))
        if to is None:
            to = self.known[head, kept] = len(self.states)
            self.states.append(kept)
            self.heads.append(head)
        return to, gain

    @staticmethod
    def slots(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)

    def put(self, keys: np.ndarray, target: np.ndarray, emit: np.ndarray) -> None:
        """Adds new distinct keys, by rounds of writes in which one of several for a free slot wins."""
        while 2 * (self.used + len(keys)) > len(self.keys):
            old = self.keys, self.target, self.emit
            self.resize(2 * len(self.keys))
            live = old[0] >= 0
            self.used = 0
            self.put(old[0][live], old[1][live], old[2][live])
        self.used += len(keys)
        at = self.slots(keys, len(self.keys))
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.target[at[won]], self.emit[at[won]] = target[won], emit[won]
            keys, target, emit, at = keys[~won], target[~won], emit[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 where there is none."""
        at = self.slots(keys, len(self.keys))
        found = self.keys[at]
        open_ = np.flatnonzero(found != keys)
        while len(open_):
            open_ = open_[self.keys[at[open_]] >= 0]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            open_ = open_[self.keys[at[open_]] != keys[open_]]
        at[self.keys[at] != keys] = -1
        return at

    def count(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[first:first+size]; all advance one byte per step, the longest first."""
        if self.used > self.LIMIT:
            self.reset()
        order = np.argsort(-size, kind="stable")
        start, length = first[order], size[order]
        state = np.zeros(len(order), dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        live = len(order)
        for k in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -k, side="left"))
            keys = state[:live] << 8 | data[start[:live] + k]
            at = self.find(keys)
            if len(missing := np.flatnonzero(at < 0)):
                new = np.unique(keys[missing])
                made = [self.compile(int(x) >> 8, int(x) & 255) for x in new]
                self.put(new, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int8))
                at = self.find(keys)
            state[:live] = self.target[at]
            total[:live] += self.emit[at]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total
        return out


class TokenCounter:
    """Counts of whole texts, special strings counted as one token each, as the library does by default."""

    def __init__(self, path: str):
        self.counter = Counter(path)
        self.classes = character_classes()

    def counts(self, texts: list[str]) -> np.ndarray:
        special = np.zeros(len(texts), dtype=np.int64)
        pieces, owners = [], []
        for i, text in enumerate(texts):
            parts = [text]
            for s in self.counter.special:
                if s in text:
                    parts = [p for x in parts for p in x.split(s)]
            special[i] = len(parts) - 1
            pieces += parts
            owners += [i] * len(parts)
        points = np.frombuffer("\0".join([*pieces, ""]).encode("utf-32-le"), dtype=np.uint32)
        if not len(points):
            return special
        classes = self.classes[points]
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        classes[ends] = END
        begins = pre_token_marks(classes)
        width = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        place = np.cumsum(width) - width
        at = np.flatnonzero(begins)
        stop = np.append(at[1:], len(points))
        real = classes[at] != END
        data = np.frombuffer("\0".join([*pieces, ""]).encode(), dtype=np.uint8).astype(np.int64)
        edge = np.append(place, len(data))
        first, size = edge[at[real]], edge[stop[real]] - edge[at[real]]
        tokens = self.counter.count(data, first, size)
        owner = np.asarray(owners)[np.searchsorted(ends, at[real])]
        return special + np.bincount(owner, weights=tokens, minlength=len(texts)).astype(np.int64)


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row, whole texts, in one pass without a shuffle.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows stay repeated; other
    columns, whatever their names, are not read. Unpaired surrogates cannot occur in Spark strings.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = TokenCounter(path)
        for batch in batches:
            for part in sub_batches(zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist())), 1, 2_000_000):
                ids, texts = zip(*part)
                n = _counters[path].counts(list(texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
