"""Long repeated byte strings: anchors bring candidates together, a Burrows-Wheeler transform decides.

1. Every string of LENGTH bytes is named by one of its GRAM-byte substrings, the one with the least hash (the first of
   equals). Equal strings name equal substrings at equal places. Neighbouring strings mostly share theirs, so a text has
   about one anchor for each (LENGTH - GRAM) / 2 bytes.
2. Anchors whose gram occurs once cannot lie in a repeat and are dropped. Of the others, the bytes around the gram that its strings
   reach form a context. Equal contexts are one node.
3. The contexts of a gram meet in one task. There the gram is a single symbol, so that a string of LENGTH bytes has
   LENGTH - GRAM + 1 symbols. A breadth-first backward extension on the Burrows-Wheeler transform of the contexts finds the
   common prefix lengths of neighbouring suffixes in increasing order and stops at that length: what is then still
   undecided is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.registry import query, table
from crossweave.llm.words import _BASE, _INVERSE, mix, powers, sub_batches
from crossweave.session import stage

GRAM = 200
#: Symbols of contexts that one transform holds, and contexts of a gram up to which a task takes them all (at most twice as many
#: meet in a transform, so that all symbols stay below 2 ** 16).
BIN, GROUP = 1_000_000, 20_000
#: String starts of a text that anchors() sees at a time; with what is held beside them, places stay far below 2 ** 24.
SLICE = 2_000_000


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every substring of `size` bytes."""
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=run[1:])
    n = len(data) - size + 1
    return mix((run[size:] - run[:-size]) * powers(_INVERSE, max(n, 1))[:n])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, gram start, first string, last string) of every anchor; strings are named by their start."""
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    if len(data) > 1 << 24:
        raise ValueError("24 bits of a rated hash hold the place")
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    # hash above place: the minimum is the least hash, and the first of equal ones
    rated = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(rated) // width)
    padded = np.full((blocks + 1) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(rated)] = rated
    grid = padded.reshape(blocks + 1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - length + 1
    best = (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(texts)), size)[:n]
    inside = np.arange(n) + length <= (begin + size)[owner]
    change = np.ones(n, dtype=bool)
    change[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1])
    ends = np.ones(n, dtype=bool)
    ends[:-1] = change[1:] | ~inside[1:]
    first, last = np.flatnonzero(change & inside), np.flatnonzero(ends & inside)
    o = owner[first]
    return o, hashes[best[first]].astype(np.int64), best[first] - begin[o], first - begin[o], last - begin[o]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, for symbols below 2 ** 16. Suffixes that are told apart stay where they are; only the others are sorted again."""
    n = len(text)
    padded = np.zeros(n + 4, dtype=np.uint64)
    padded[:n] = text + 1
    key = padded[:n] << np.uint64(48) | padded[1:n + 1] << np.uint64(32) | padded[2:n + 2] << np.uint64(16) | padded[3:n + 3]
    order = np.argsort(key)
    key, suffix, place, reach = key[order], order, np.arange(n), 4
    # the first place of equal ones, counted from 1; a suffix that is over comes first
    rank = np.zeros(n, dtype=np.int64)
    while len(suffix):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(first, append=len(key))
        rank[suffix] = np.repeat(place[first] + 1, size)
        tied = np.repeat(size > 1, size)
        suffix, place = suffix[tied], place[tied]
        later = suffix + reach
        key = rank[suffix] << 32 | np.where(later < n, rank.take(later, mode="clip"), 0)
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[place] = suffix
        reach *= 2
    return order


def undecided(transform: np.ndarray, length: int) -> np.ndarray:
    """Places i of the suffix array whose common prefix with place i - 1 has at least `length` symbols.

    Level k knows the borders between intervals of equal prefixes of k symbols. Extending an interval to the left by a
    symbol c maps its rows before which c stands to a run of rows that begin with c, in the same order. So between two
    neighbouring rows of that run lies a border of level k + 1 exactly if one of level k lies between their sources. All extensions
    of a level are made at once; rows leave when their border is found, so the work follows what is repeated.
    """
    source = np.argsort(transform.astype(np.uint16) if transform.max(initial=0) < 1 << 16 else transform, kind="stable")
    n = len(source)
    same = np.zeros(n, dtype=bool)
    same[1:] = transform[source[1:]] == transform[source[:-1]]
    rows = np.flatnonzero(same)
    # counted from 1: place 0 stands before all and is no border
    place, lo, hi = rows + 1, source[rows - 1] + 1, source[rows] + 1
    fresh = np.concatenate(([False], ~same))

    def near_first():  # rows whose sources are neighbours have one place to look at
        near = hi - lo == 1
        by = np.concatenate((np.flatnonzero(near), np.flatnonzero(~near)))
        return rows[by], place[by], lo[by], hi[by], np.count_nonzero(near)

    rows, place, lo, hi, near = near_first()
    stay, gone = np.ones(len(rows), dtype=bool), 0
    for _ in range(length - 1):
        found = np.empty(len(rows), dtype=bool)
        fresh.take(hi[:near], out=found[:near], mode="clip")
        if near < len(rows):
            upto = np.cumsum(fresh, dtype=np.int32)
            np.greater(upto.take(hi[near:]), upto.take(lo[near:]), out=found[near:])
        found &= stay
        at = np.flatnonzero(found)
        if not len(at):
            break
        fresh = np.zeros(len(fresh), dtype=bool)
        fresh[place[at]] = True
        stay[at] = False
        gone += len(at)
        if gone > 0.1 * len(rows):
            near = np.count_nonzero(stay[:near])
            rows, place, lo, hi = rows[stay], place[stay], lo[stay], hi[stay]
            stay, gone = np.ones(len(rows), dtype=bool), 0
            if len(rows) < 0.7 * len(fresh):  # drop the places of borders that no row's sources can enclose any more
                kept = fresh.copy()
                kept[place] = kept[0] = True
                at = np.cumsum(kept) - 1
                fresh = fresh[kept]
                place, lo, hi = at[place], at[lo], at[hi]
                rows, place, lo, hi, near = near_first()
    return np.sort(rows[stay])


def repeated_starts(contexts: list[tuple[int, bytes, bytes]], length: int, gram: int) -> list[np.ndarray]:
    """For each (gram hash, bytes before, bytes after): which of its strings of `length` bytes occur in another context."""
    symbol: dict[int, int] = {}
    grams = [symbol.setdefault(h, 256 + len(symbol)) for h, _, _ in contexts]
    end = 256 + len(symbol)
    pieces, starts, n = [], [], 0
    for i, ((_, left, right), g) in enumerate(zip(contexts, grams)):
        pieces += [np.frombuffer(left, np.uint8), [g], np.frombuffer(right, np.uint8), [end + i]]
        starts.append(n)
        n += len(left) + len(right) + 2
    text = np.concatenate(pieces).astype(np.int64)
    order = suffix_order(text)
    rows = undecided(text[order - 1], length - gram + 1)
    flags = np.zeros(n, dtype=bool)
    flags[order[rows]] = True
    flags[order[rows - 1]] = True
    return [np.flatnonzero(flags[s:s + len(left) + 1]) for s, (_, left, _) in zip(starts, contexts)]


def _runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Runs [first, last] of increasing integers."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate(([0], cut + 1))].tolist(), places[np.concatenate((cut, [len(places) - 1]))].tolist()))


_COVERED = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _covered_batch(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 2
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in r] for r in columns[1]], _COVERED)],
                                      names=["context", "covered"])


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = GRAM) -> DataFrame:
    """(key, text, spans) of each distinct text that shares strings of `length` bytes with another text, or repeats one itself:
    the merged byte ranges [a, b) they cover. docs has id and text, not null; key is the text's md5. Whole copies are one text."""
    keyed = docs.select(F.unhex(F.md5("text")).alias("key"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("key").to_pylist(), (t.encode() for t in batch.column("text").to_pylist()))
            # an anchor depends on its string alone, so slices that overlap by length - 1 bytes name every string once and alike
            slices = ((k, at, t[at:at + SLICE + length - 1]) for k, t in rows for at in range(0, len(t) - length + 1, SLICE))
            for part in sub_batches(slices, 2, 2_000_000):
                o, h, p, lo, hi = anchors([t for _, _, t in part], length, gram)
                keys = pa.array([k for k, _, _ in part], pa.binary()).take(pa.array(o))
                p, lo, hi = (x + np.array([at for _, at, _ in part], dtype=np.int64)[o] for x in (p, lo, hi))
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, k) for x, k in zip((h, p, lo, hi), [pa.int64()] + [pa.int32()] * 3))],
                                                 names=["key", "gram", "place", "first", "last"])

    long = keyed.where(F.octet_length("text") >= length)
    named = stage(long.mapInArrow(find, "key binary, gram long, place int, first int, last int"), "anchors")
    at = F.xxhash64("key", "place")
    # written first, so that the join reads plain tables on both sides and a gram with very many rows is split
    again = stage(named.groupBy("gram").agg(F.min(at).alias("lo"), F.max(at).alias("hi")).where("lo <> hi").select("gram"), "again")
    # copies of a text repeat its anchors, which the set removes
    wanted = named.join(again, "gram").groupBy("key").agg(F.collect_set(F.struct("place", "gram", "first", "last")).alias("anchors"))
    # one row of each text, picked by its least id, so that no copies meet in a task
    one = keyed.where(F.octet_length("text") >= length).groupBy("key").agg(F.min("id").alias("id"))
    texts = stage(keyed.join(wanted.join(one, "key"), ["key", "id"]).dropDuplicates(["key", "id"]), "texts")

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["context", "gram", "left", "right", "key", "starts", "strings"]
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        for batch in batches:
            out = []
            for key, text, found in zip(*(batch.column(c) for c in ("key", "text", "anchors"))):
                key, data, mine = key.as_py(), text.as_py().encode(), {}
                for x in found.as_py():
                    left, right = data[x["first"]:x["place"]], data[x["place"] + gram:x["last"] + length]
                    h = hashlib.md5(b"%d %d " % (x["gram"], len(left)) + left + right).digest()
                    if h in mine:
                        mine[h][5].append(x["first"])
                    else:
                        mine[h] = (h, x["gram"], left, right, key, [x["first"]], x["last"] - x["first"] + 1)
                out += mine.values()
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=names)

    places = stage(texts.mapInArrow(around, "context binary, gram long, left binary, right binary, key binary, starts array<long>, strings long"), "contexts")
    mark = F.xxhash64("key")
    nodes = places.groupBy("context").agg(F.sum(F.size("starts")).alias("n"), F.min(mark).alias("mark"))
    nodes = places.withColumn("mark", mark).join(nodes, ["context", "mark"]).select("context", "gram", "left", "right", "strings", "n")
    sizes = places.groupBy("gram").agg(F.approx_count_distinct("context").alias("near"))
    nodes = nodes.join(sizes.where(F.col("near") > GROUP), "gram", "left")

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def done():
            found = repeated_starts([(r["gram"], r["left"], r["right"]) for r in held], length, gram) if held else []
            return _covered_batch([(r["context"], _runs(f)) for r, f in zip(held, found) if len(f) and r["n"] == 1])

        for batch in batches:
            for row in batch.to_pylist():
                if row["gram"] != last and (size > BIN or len(held) > GROUP):
                    yield done()
                    held, size = [], 0
                last = row["gram"]
                held.append(row)
                size += len(row["left"]) + len(row["right"]) + 2
        yield done()

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                whole = row["left"] + row["gram"].to_bytes(8, "little", signed=True) + row["right"]
                out += [(row["context"], k, hashlib.md5(b"%d %d " % (row["gram"], len(row["left"]) - k) + whole[k:k + length - gram + 8]).digest())
                        for k in range(row["strings"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 3, (pa.binary(), pa.int64(), pa.binary()))],
                                             names=["context", "k", "string"])

    few = nodes.where("near is null").drop("near", "strings").repartition("gram").sortWithinPartitions("gram")
    covered = few.mapInArrow(transform, "context binary, covered array<struct<a:bigint,b:bigint>>")
    # a gram with more contexts than a task should hold: its strings are told apart one by one, counted with map-side sums
    each = nodes.where("near is not null").drop("near").mapInArrow(strings, "context binary, k long, string binary")
    twice = each.groupBy("string").agg(F.count("*").alias("m")).where("m > 1")
    covered = covered.unionByName(each.join(twice, "string").groupBy("context").agg(F.collect_list(F.struct(F.col("k").alias("a"), F.col("k").alias("b"))).alias("covered")))
    whole = nodes.where("n > 1").select("context", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("strings") - 1).alias("b"))).alias("covered"))
    covered = covered.unionByName(whole)
    spans = places.select("context", "key", F.explode("starts").alias("start")).join(covered, "context")
    spans = spans.select("key", F.explode(F.transform("covered", lambda r: F.struct((F.col("start") + r.a).alias("a"), (F.col("start") + r.b + length).alias("b")))).alias("s"))
    spans = spans.groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    merged = F.aggregate("spans", F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)"), lambda done, s: F.when(
        (F.size(done) > 0) & (s.a <= F.try_element_at(done, F.lit(-1)).b),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.try_element_at(done, F.lit(-1)).a.alias("a"), F.greatest(s.b, F.try_element_at(done, F.lit(-1)).b).alias("b")))))
        .otherwise(F.concat(done, F.array(s))))
    return texts.select("key", "text").join(spans, "key").select("key", "text", merged.alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; kept is the binary remainder where bytes were removed from a
    part of the text, else null.

    A string counts as repeated if it starts anywhere else, in this text or another; copies of a whole text are all removed if
    they have `length` bytes. Null texts count as empty; rows with null or repeated ids are documents of their own; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    plain = stage(rows.select("id", F.unhex(F.md5("text")).alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "plain")
    parts = repeated_spans(rows, length, gram)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text, spans in zip(*(batch.column(c) for c in ("key", "text", "spans"))):
                data, at, left, gone = text.as_py().encode(), 0, [], 0
                spans = spans.as_py()
                for s in spans:
                    left.append(data[at:s["a"]])
                    at, gone = s["b"], gone + s["b"] - s["a"]
                rest = b"".join([*left, data[at:]])
                out.append((key.as_py(), gone, len(spans), rest, hashlib.sha256(rest).hexdigest()))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["key", "gone", "runs", "rest", "rest_sha"])

    done = parts.mapInArrow(cut, "key binary, gone long, runs long, rest binary, rest_sha string")
    copies = plain.groupBy("key").agg(F.count("*").alias("copies"))
    out = plain.join(copies.join(done, "key", "left"), "key")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(F.col("id").alias(id_col), "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
                      F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("runs", F.lit(0))).alias("n_spans"),
                      F.when(~whole, F.col("rest")).alias("kept"),
                      F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest_sha", "sha")).alias("kept_sha256"))


@query("op10_long_repeats")
def op10_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
