"""Near-duplicate documents: ProbMinHash signatures of weighted word shingles, banding, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.components import components
from crossweave.llm.held import release
from crossweave.llm.registry import query, table
from crossweave.llm.words import mix, shingles, sub_batches, word_hashes
from crossweave.session import stage

#: Components of a signature: BANDS bands of ROWS. A text has the bands of two signatures, one for each similarity that verification
#: accepts. At 0.8 of either, (1 - 0.8 ** 6) ** 32 = 6e-5 of the pairs share no band of its signature.
BANDS, ROWS = 32, 6
#: Members that are compared with one copy of their partner's text, and members of a block of a bucket.
SHARE, BLOCK = 256, 128
#: Columns of the incidence matrix of a block pair that are held at a time.
COLUMNS = 8192


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted within it, and how often each occurs."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def signatures(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int, size: int) -> np.ndarray:
    """texts x size ProbMinHash signatures.

    Every element sends arrivals of a Poisson process whose rate is its weight, each to a random component;
    a component keeps the element that came first. An element stops once its next arrival is later than the latest
    first arrival of its text, so heavy and early elements do most of the work. Times and components are hashes of
    the element and the arrival's number, hence equal for equal elements of any two texts. Two texts agree in a component with the
    probability Jaccard similarity of their weights. All texts of a batch go through the rounds together.
    """
    if size > 2048:
        raise ValueError("11 bits of a hash choose the component")
    first = np.full(texts * size, np.inf)
    kept = np.zeros(texts * size, dtype=np.uint64)
    time = np.zeros(len(element))
    live = np.arange(len(element))
    latest = np.full(texts, np.inf)
    n = 0
    while len(live):
        drawn = mix(element[live] + np.uint64(0x9E3779B97F4A7C15 * (n + 1) & 0xFFFFFFFFFFFFFFFF))
        time[live] += -np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / weight[live]
        live_now = time[live] < latest[owner[live]]
        live, drawn = live[live_now], drawn[live_now]
        to = owner[live] * size + ((drawn & np.uint64(0x7FF)) * np.uint64(size) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(first, to, time[live])
        won = first[to] == time[live]
        kept[to[won]] = element[live[won]]
        active = np.unique(owner[live])
        latest[active] = first.reshape(texts, size)[active].max(axis=1)
        n += 1
    return kept.reshape(texts, size)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum_j max(x_j / x_i, y_j / y_i), for sorted (elements, weights)."""
    (ea, wa), (eb, wb) = a, b
    every = np.union1d(ea, eb)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, ea)], y[np.searchsorted(every, eb)] = wa, wb
    with np.errstate(divide="ignore"):
        ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(-ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    # where x_j / y_j >= x_i / y_i the maximum is x_j / x_i, else y_j / y_i
    upto = np.searchsorted(-ratio, -ratio, side="right")
    over, rest = np.append(0, np.cumsum(x))[upto], y.sum() - np.append(0, np.cumsum(y))[upto]
    both = (x > 0) & (y > 0)
    return float((1 / (over[both] / x[both] + rest[both] / y[both])).sum())


def similarity(a, b) -> float:
    """The larger of the probability Jaccard similarities with occurrences and with equal weights (plain Jaccard)."""
    common = len(np.intersect1d(a[0], b[0], assume_unique=True))
    if not common:
        return 0.0
    plain = common / (len(a[0]) + len(b[0]) - common)
    return max(plain, probability_jaccard(a, b))


def banded(sign: np.ndarray) -> np.ndarray:
    """texts x BANDS buckets of signatures."""
    band = np.zeros((len(sign), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        band = mix(band + sign.reshape(len(sign), BANDS, ROWS)[:, :, r] + np.arange(BANDS, dtype=np.uint64) * np.uint64(2 * r + 1))
    return band.astype(np.int64)


def buckets(element: np.ndarray, owner: np.ndarray, weight: np.ndarray, texts: int) -> list[np.ndarray]:
    """Distinct buckets of each text: the bands of its shingles weighted by occurrences, and those of its shingles with equal weights.

    Both signatures are hashed alike, so a text that repeats nothing has the same bands twice, and meets others in either set.
    """
    out = list(banded(signatures(element, owner, weight, texts, BANDS * ROWS)))
    again = np.unique(owner[weight > 1])
    of = np.isin(owner, again)
    equal = banded(signatures(element[of], np.searchsorted(again, owner[of]), np.ones(int(of.sum())), len(again), BANDS * ROWS))
    for i, b in zip(again.tolist(), equal):
        out[i] = np.union1d(out[i], b)
    return out


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = ((t or "").encode() for t in batch.column("text").to_pylist())
            for part in sub_batches(zip(batch.column("doc").to_pylist(), texts), 1):
                hashes, ends = word_hashes([t for _, t in part])
                starts = np.concatenate(([0], ends[:-1]))
                element, owner, weight = weighted(*shingles(hashes, ends, width))
                band = buckets(element, owner, weight, len(part))
                keys = [hashlib.md5(hashes[s:e].tobytes()).digest() if e > s else None for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in part], pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([b if k else None for b, k in zip(band, keys)], pa.list_(pa.int64()))], names=["doc", "words", "bands"])
    return run


def _verify(width: int, threshold: float):
    """Rows sorted by (a, salt), the text of a (b null) before those of its partners; yields the pairs that are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            out = []
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), (t.encode() for t in batch.column("text").to_pylist()))
            for part in sub_batches(rows, 2):
                element, owner, weight = weighted(*shingles(*word_hashes([t for _, _, t in part]), width))
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                for i, (a, b, _) in enumerate(part):
                    mine = element[edge[i]:edge[i + 1]], weight[edge[i]:edge[i + 1]]
                    if b is None:
                        head = mine
                    elif similarity(head, mine) >= threshold:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 2], names=["a", "b"])
    return run


def links_within(texts: list[tuple[np.ndarray, np.ndarray]], open_: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs marked in open_ are similar, for all pairs of a few hundred texts at once.

    Products of the text-by-shingle incidence matrix count the common shingles, which decides the plain Jaccard
    similarity. The probability Jaccard similarity is at most the share of either text's weight that lies in common
    shingles (each of its terms is at most x_i / sum x, and y_i / sum y), so it is computed only where both shares
    reach the threshold. Where no shingle of either text repeats, both similarities are the same.
    """
    n, count = len(texts), np.array([len(e) for e, _ in texts])
    element, owner = np.concatenate([e for e, _ in texts]), np.repeat(np.arange(n), count)
    weight = np.concatenate([w / w.sum() if len(w) else w for _, w in texts]).astype(np.float64)
    repeats = np.array([bool((w > 1).any()) for _, w in texts])
    _, column, uses = np.unique(element, return_inverse=True, return_counts=True)
    shared = uses > 1
    place = (np.cumsum(shared) - 1)[column]
    keep = shared[column]
    owner, place, weight = owner[keep], place[keep], weight[keep]
    common, mass = np.zeros((n, n)), np.zeros((n, n))
    order = np.argsort(place, kind="stable")
    owner, place, weight = owner[order], place[order], weight[order]
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(place, (lo, lo + COLUMNS))
        has, part = np.zeros((n, COLUMNS), np.float32), np.zeros((n, COLUMNS), np.float32)
        has[owner[a:b], place[a:b] - lo], part[owner[a:b], place[a:b] - lo] = 1, weight[a:b]
        common += has @ has.T
        mass += part @ has.T
    union = count[:, None] + count[None, :] - common
    near = open_ & (common >= threshold * union - 1e-9) & (common > 0)
    maybe = open_ & ~near & (repeats[:, None] | repeats[None, :]) & (np.minimum(mass, mass.T) >= threshold - 1e-4)
    for i, j in zip(*np.nonzero(np.triu(maybe))):
        near[i, j] = near[j, i] = similarity(texts[i], texts[j]) >= threshold
    return near


def _across(width: int, threshold: float):
    """Rows sorted by (bucket, one, two): a spanning set of the links between classes of each block pair."""
    def links(rows: list[tuple], one: int, two: int) -> list[tuple[int, int]]:
        group, block = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        open_ = group[:, None] != group[None, :]
        if one != two:
            open_ &= block[:, None] != block[None, :]
        if not open_.any():
            return []
        near = links_within([r[3] for r in rows], open_, threshold)
        node = np.array([r[0] for r in rows], dtype=np.int64)
        label, most = node.copy(), np.iinfo(np.int64).max
        while True:
            new = np.minimum(label, np.where(near, label[None, :], most).min(axis=1))
            if (new == label).all():
                return [(int(a), int(b)) for a, b in zip(label, node) if a != b]
            label = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*out)) or [()] * 2], names=["a", "b"])

        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("bucket", "one", "two", "node", "class", "block")),
                       (t.encode() for t in batch.column("text").to_pylist()))
            for part in sub_batches(rows, 6):
                element, owner, weight = weighted(*shingles(*word_hashes([r[6] for r in part]), width))
                edge = np.searchsorted(owner, np.arange(len(part) + 1))
                for i, (bucket, one, two, node, group, block, _) in enumerate(part):
                    if (bucket, one, two) != at:
                        out += links(held, *at[1:]) if held else []
                        held, at = [], (bucket, one, two)
                    held.append((node, group, block, (element[edge[i]:edge[i + 1]].copy(), weight[edge[i]:edge[i + 1]].copy())))
            yield batch_of(out)
        yield batch_of(links(held, *at[1:]) if held else [])
    return run


def block_pairs(placed: DataFrame) -> DataFrame:
    """(bucket, one, two, node, class, block): the members of every pair of blocks that is to be compared; placed has bucket, node and class.

    Buckets with one class are left out. Of the others, a class of BLOCK members or more is cut into blocks of its own, and smaller
    classes share blocks whole. Every pair of blocks that holds different classes is compared whole, in a group of its own, which returns
    at most one link a member: all pairs of classes are looked at, none is emitted for its own sake. A group of copies that are
    connected already is never compared with itself, so a few strangers beside it cost it as many copies as the strangers fill blocks.
    """
    sizes = placed.groupBy("bucket", "class").agg(F.count("*").alias("n"))
    small = F.col("n") < BLOCK
    open_ = sizes.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"),
                                        F.ceil(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)) / BLOCK).cast("int").alias("shared"))
    sizes = stage(sizes.join(open_.where("lo < hi"), "bucket").select(
        "bucket", "class", small.alias("small"), F.when(small, F.col("shared")).otherwise(F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks")), "sizes")
    # shared blocks are numbered from -1 down, a class's own from 0 up
    dealt = F.when(F.col("small"), -1 - F.pmod(F.xxhash64("class"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks"))).cast("int")
    owner = F.when(F.col("small"), F.lit(None).cast("long")).otherwise(F.col("class"))
    members = stage(placed.join(sizes, ["bucket", "class"]).select("bucket", "node", "class", F.struct(owner.alias("owner"), dealt.alias("part")).alias("block")), "members")
    blocks = members.groupBy("bucket", "block").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    one, two = (blocks.select("bucket", F.col("block").alias(k), F.col("lo").alias(f"lo_{k}"), F.col("hi").alias(f"hi_{k}")) for k in ("one", "two"))
    pairs = one.join(two, "bucket").where((F.col("one") <= F.col("two")) & (F.least("lo_one", "lo_two") < F.greatest("hi_one", "hi_two")))
    pairs = pairs.select("bucket", F.xxhash64("one").alias("one"), F.xxhash64("two").alias("two"), F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    return members.join(pairs, ["bucket", "block"]).select("bucket", "one", "two", "node", "class", F.xxhash64("block").alias("block"))


def across_classes(placed: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) that connect what is similar across the classes of a bucket; placed has bucket, node and class."""
    rows = block_pairs(placed)
    rows = rows.join(texts.withColumnRenamed("doc", "node"), "node").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    return rows.mapInArrow(_across(width, threshold), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar; texts has doc and text.

    A document with very many partners is compared in shares: its text goes once to each share, the partners' texts
    to one share each, so no task holds more than one text and a batch.
    """
    # written first, so that the join below reads plain tables on both sides and a hot document is split
    shares = stage(pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares")), "shares")
    members = pairs.join(shares, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("shares")))
    members = members.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "salt", "b", "text")
    heads = shares.join(texts.withColumnRenamed("doc", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "text")
    rows = members.unionByName(heads).repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))
    return rows.select("a", "b", "text").mapInArrow(_verify(width, threshold), "a long, b long")


def near_documents(docs: DataFrame, threshold: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept) of every document; a class is what links of similar texts connect, named by its least id.

    1. Texts with the same words are one node. One pass over the texts makes signatures, without a shuffle of text: one with
       occurrences as weights and, where a shingle repeats, one with equal weights.
    2. Every band bucket links its members to its least one, as candidates; these are verified on whole texts and connected.
    3. In buckets whose members are still in different classes, every pair across classes is compared too, in blocks. So no
       pair that shares a bucket stays untested unless it is connected already, and groups of copies cost a pair a member.

    Words are lower-cased for A-Z; a text of fewer than `width` words has one shingle of all its words. Texts
    without words, nulls among them, link with nothing. Rows with a null id are classes of their own with a null class_id.
    Rows that repeat an id are one document (of their least text, if the texts differ). An empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    signed = stage(docs.mapInArrow(_sign(width), "doc long, words binary, bands array<long>"), "signatures")
    nodes = stage(signed.where("words is not null and doc is not null").groupBy("words").agg(
        F.min("doc").alias("node"), F.first("bands").alias("bands")), "nodes")
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    places = stage(places.join(shared, "bucket").select("bucket", "node", "least"), "buckets")
    pairs = stage(places.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    wanted = places.select(F.col("node").alias("doc")).distinct()
    texts = stage(docs.join(wanted, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")), "texts")
    sure = stage(verified(pairs, texts, width, threshold), "verified")
    roots = components(sure)
    placed = places.join(roots.withColumnRenamed("component", "class"), "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    placed = stage(placed, "placed")
    found = sure.unionByName(stage(across_classes(placed, texts, width, threshold), "verified"))
    roots = components(found)
    classes = nodes.join(roots, "node", "left").select("words", F.coalesce("component", "node").alias("class"))
    out = signed.select("doc", "words").join(classes, "words", "left").select("doc", F.coalesce("class", "doc").alias("class"))
    return out.select(F.col("doc").alias(id_col), F.col("class").alias("class_id"), F.col("doc").eqNullSafe(F.col("class")).alias("kept"))


@query("op8_near_documents")
def op8_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(table(spark, sf_dir, "documents"))
