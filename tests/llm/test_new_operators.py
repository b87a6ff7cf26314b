"""Fill-in-the-middle, the Merkle manifest and language codes against brute force, their SQL and held-out rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from checks.compare import compare, duck
from crossweave.llm import additive, automaton, hyperplanes, infill, language_codes, manifest, packing, probminhash, registry

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    queries, sql = registry.load()
    con = duck(SF)
    assert compare(queries[name](spark, SF), con, sql[name]) is None


def infill_by_units(doc, text):
    units = UNIT.findall(text)
    n, h = len(units), sha(f"1:{'' if doc is None else doc}")
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n):
    rng = random.Random(2)
    parts = ["a", "Zz", "é", "漢", "😀", " ", "\n", "<", ">", "P", "<S", "12", "́", "\x00", "abcdefghij" * 3]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", "a" * 5000, "é" * 3000, "x<P>y", "<<", "M>"]


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1024])
def test_infill_equals_units(monkeypatch, block):
    monkeypatch.setattr(infill, "SPAN", 100)
    for doc, text in enumerate(odd_texts(400)):
        assert infill.transform(doc, text, block=block) == infill_by_units(doc, text)


@pytest.mark.parametrize("block", [1, 3, 16])
def test_every_border_of_a_text(block):
    text = "ab é!cd\n漢x" * 5
    units = UNIT.findall(text)
    tree = infill.BlockTree(text.encode(), block)
    for k in range(len(units) + 1):
        head = "".join(units[:k])
        assert tree.border(k) == (len(head.encode()), len(head))


def test_infill_edges_and_round_trip(spark, edge_docs):
    rows = [(i, t) for i, t in enumerate(odd_texts(200))] + [(r.doc_id, r.text) for r in edge_docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    made = infill.fill_in_middle(docs)
    got = made.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, *infill_by_units(d, t or ""), t or "") for d, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(docs.limit(0)).count() == 0


def manifest_by_hand(rows, arity):
    """{(key, leaf): (idx, subroot, root, proof hashes)} of (key, group, leaf) rows."""
    def rise(digests):
        """(root, siblings of every leaf from the leaf up, left to right)."""
        proofs, places, level = [[] for _ in digests], list(range(len(digests))), digests
        while len(level) > 1:
            for i, p in enumerate(places):
                lo = p // arity * arity
                proofs[i] += [level[j] for j in range(lo, min(lo + arity, len(level))) if j != p]
                places[i] = p // arity
            level = [sha("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
        return level[0], proofs

    groups = sorted({g for _, g, _ in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        mine = sorted(((k, d) for k, h, d in rows if h == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = mine, *rise([d for _, d in mine])
    root, above = rise([trees[g][1] for g in groups])
    return sorted(((k, i, d, trees[g][1], root, trees[g][2][i] + above[j])
                   for j, g in enumerate(groups) for i, (k, d) in enumerate(trees[g][0])), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_equals_recursion(spark, edge_docs, arity):
    rng = random.Random(arity)
    rows = [(i if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(["a", "a", "a", "b", "é", "", None, "B"]), rng.choice(["x\ny", None, "", "é"])) for i in range(90)]
    rows += [(500, "lone", "t")] + rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("idx", F.lit(1)).withColumn("leaf", F.lit("clash"))
    got = manifest.merkle_manifest(docs, ["doc_id", "text"], "source", "doc_id", arity)
    checked = got.withColumn("again", manifest.folded(F.col("leaf"), F.col("proof"))).collect()

    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = manifest_by_hand([(k, g, sha(part(k) + part(t))) for k, g, t in rows], arity)
    assert sorted(((r.doc_id, r.idx, r.leaf.hex(), r.subroot.hex(), r.root.hex(), [bytes(x).hex() for s in r.proof for x in s.others]) for r in checked), key=repr) == want
    assert all(r.again == r.root.hex() for r in checked)


def test_manifest_edges(spark, edge_docs):
    made = manifest.merkle_manifest(edge_docs, list(manifest.FIELDS), "source", "doc_id", 3, {"other": F.sha2("text", 256)})
    rows = made.withColumn("again", manifest.folded(F.unhex("other"), F.col("proof"))).collect()
    assert len(rows) == 11 and sorted(r.idx for r in rows) == list(range(11))
    assert all(r.again != r.root.hex() for r in rows if r.other)
    assert manifest.merkle_manifest(edge_docs.limit(0), ["text"], "source", "doc_id").count() == 0
    one = manifest.merkle_manifest(edge_docs.where("doc_id = 9"), ["text"], "source", "doc_id").first()
    assert one.leaf == one.subroot == one.root and one.proof == []


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 7, 12, 40):
        code = language_codes.codewords(n)
        assert all(0 < c.sum() < n for c in code.T)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2 if n == 3 else code.shape[1] // 4)


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_codes.train(docs)
    rows = language_codes.identify(docs, model).join(docs, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    # the same decisions from plain sums over every n-gram of a text
    for r in rows[:60]:
        x = bytes(language_codes._FOLD[b] for b in b' ' + r.text.encode())
        total, count = np.zeros(model.code.shape[1]), 0
        for n in language_codes.GRAMS:
            for i in range(len(x)):
                gram = x[i:i + n].ljust(n, b" ")
                if gram[:2] != b"  ":
                    total += model.weight[slot(gram)]
                    count += 1
        margin = model.slope * (total / count - model.shift) * count / (count + language_codes.PRIOR)
        loss = [sum(t * np.log1p(np.exp(-m * (2 * bit - 1))) for m, bit, t in zip(margin, code, trust)) for code, trust in zip(model.code, model.trust)]
        assert model.languages[int(np.argmin(loss))] == r.lang_pred
        assert 1 / sum(np.exp(min(loss) - np.array(loss))) == pytest.approx(r.score, abs=1e-6)


def slot(gram):
    key = len(gram)
    for b in gram:
        key = key * 0x01000193 & 0xFFFFFFFF ^ b
    key ^= key >> 15
    key = key * 0x2C1B3C6D & 0xFFFFFFFF
    return (key ^ key >> 13) & language_codes.SLOTS - 1


def test_errors_of_single_classifiers_are_corrected():
    model = language_codes.LanguageCodes(list("abcd"), np.eye(4, language_codes.SLOTS))
    signs = 2.0 * model.code - 1
    for k in range(4):
        for bit in range(model.code.shape[1]):
            margin = 3 * signs[[k]]
            margin[0, bit] *= -1
            best, score, lead = model.decode(margin)
            assert best[0] == k and 0.25 < score[0] < 1 and lead[0] > 0
    best, score, lead = model.decode(np.zeros((1, 7)))
    assert best[0] == 0 and score[0] == 0.25 and lead[0] == 0


def test_language_pieces_and_edges(spark, edge_docs, monkeypatch):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["der", "und", "schön"] if i % 2 else ["the", "and", "that"]) for _ in range(30)), "de" if i % 2 else "en") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_codes.train(docs)
    texts = [b"the and that", b"", b"der und " * 400, b"that"]
    whole = model.means(texts)[0]
    assert np.allclose(whole, [model.means([t])[0][0] for t in texts]) and (whole[1] == 0).all()
    monkeypatch.setattr(language_codes, "PIECE", 500)
    split = model.means(texts)[0]
    assert np.allclose(whole[[0, 1, 3]], split[[0, 1, 3]]) and np.allclose(whole, split, atol=0.1)
    monkeypatch.undo()
    got = {(r.doc_id, r.lang_pred, r.score > 0.9, r.ambiguous) for r in language_codes.identify(
        spark.createDataFrame([(1, "the that and the that and the and that the and the that"), (2, None), (3, "12 !!"), (4, ""), (None, "schön und der und schön und der und schön"), (5, "x")],
                              "doc_id long, text string"), model).collect()}
    assert {(1, "en", True, False), (2, "und", False, True), (3, "und", False, True), (4, "und", False, True), (None, "de", True, False)} <= got
    assert len(language_codes.identify(edge_docs, model).collect()) == 11
    assert language_codes.identify(edge_docs.limit(0), model).count() == 0


@pytest.mark.parametrize("label,want", [(None, "und"), ("xx", "xx")])
def test_no_or_one_language(spark, label, want):
    docs = spark.createDataFrame([(i, "some words", label) for i in range(20)] + [(99, None, label)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_codes.identify(docs, language_codes.train(docs)).collect()}
    assert got[0] == want and got[99] == "und"
    with pytest.raises(ValueError):
        language_codes.train(docs.withColumn("lang", F.col("doc_id").cast("string")), most_languages=3)


@pytest.mark.parametrize("n", [300, 1200])
def test_near_copies_are_compared_in_linear_rows(spark, monkeypatch, n):
    """One group of near copies, and beside it texts that are like none: members of a class never meet each other again."""
    rng = random.Random(n)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.randrange(10 ** 9)}"
        rows.append((i, " ".join(words)))
    seen = []
    whole = probminhash.block_pairs

    def counted(placed):
        out = probminhash.stage(whole(placed), "counted")
        seen.append((placed.count(), out.count()))
        return out
    monkeypatch.setattr(probminhash, "block_pairs", counted)
    got = {r.doc_id: r.class_id for r in probminhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert seen[0][1] <= 2 * seen[0][0]
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert all(got[i] == find(i) for i in range(n))


def test_blocks_hold_every_pair_of_classes(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 4)
    rng = random.Random(3)
    placed = [(b, 100 * b + i, rng.choice([1, 1, 1, 1, 2, 3, 4, 5, 6]) if b else 1) for b in range(3) for i in range(40)]
    rows = probminhash.block_pairs(spark.createDataFrame(placed, "bucket long, node long, class long")).collect()
    held = {}
    for r in rows:
        held.setdefault((r.bucket, r.one, r.two), []).append(r)
    met = set()
    for group in held.values():
        assert len({r.node for r in group}) == len(group) <= 20
        met |= {(a.node, b.node) for a in group for b in group}
    for b, x, c in placed:
        for d, y, e in placed:
            if b == d and c != e:
                assert (x, y) in met
    assert not any(r.bucket == 0 for r in rows)


def test_reserved_names_are_refused(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    with pytest.raises(ValueError, match="__score"):
        additive.quality_scores(edge_docs.withColumn("__Score", F.lit(1)), labels)
    with pytest.raises(ValueError, match="__found"):
        automaton.overlaps(edge_docs.withColumn("__found", F.lit(1)), items, keep=True)


def test_planted_near_vectors_equal_brute_force(spark):
    """Groups of vectors around 0.98, some within and some across labels, and repeated rows."""
    rng = np.random.default_rng(31)
    rows = []
    for g in range(40):
        centre = rng.normal(size=64)
        for _ in range(int(rng.integers(2, 9))):
            x = centre + rng.normal(size=64) * rng.choice([0.05, 0.1, 0.14, 0.2])
            rows.append((len(rows), [float(v) for v in x * rng.uniform(0.1, 5)], int(g % 3 if rng.random() < 0.9 else 7)))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in hyperplanes.near_vectors(df).collect()}
    assert near.sum() > 200
    assert [got[i].n_links for i in range(len(rows))] == near.sum(1).tolist()
    least = np.arange(len(rows))
    for _ in range(len(rows)):
        least = np.minimum(least, np.where(near, least[None, :], len(rows)).min(axis=1))
    assert [got[i].component_id for i in range(len(rows))] == least.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_packed_pieces_equal_the_ids(spark):
    """Every id of every document lies in exactly one piece, with its checksum, and windows are gapless and full but for powers of two."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(900001, None), (900002, ""), (900003, "long text " * 3000)], "doc_id long, text string"))
    rows = docs.collect()
    encoded = Tokenizer.from_file(path).encode_batch([r.text or "" for r in rows], add_special_tokens=False)
    ids = {r.doc_id: np.array([*e.ids, 0], "<u4") for r, e in zip(rows, encoded)}
    pieces, windows = defaultdict(list), defaultdict(list)
    for p in packing.pack_documents(docs, path, "lead", 0).collect():
        mine = ids[p.doc_id]
        assert p.doc_tokens == len(mine) and p.ids_crc32 == zlib.crc32(mine[p.start:p.start + p.length].tobytes())
        pieces[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
    assert pieces.keys() == ids.keys()
    for held, size in [(pieces[d], len(ids[d])) for d in ids] + [(w, None) for w in windows.values()]:
        at = 0
        for start, length in sorted(held):
            assert start == at and length > 0
            at += length
        assert at == size if size is not None else at <= 1024


def test_scores_equal_table_sums():
    """The additive model's score is the logistic curve of an intercept and one entry of each table and each pair's grid."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(1500, len(additive.FEATURES))), 1)
    model = additive.AdditiveModel().fit(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float))
    for row in x[:200]:
        total = model.intercept
        fine, rough = model.place(row[None, :], model.edges)[0], model.place(row[None, :], model.wide)[0]
        for j, t in enumerate(model.tables):
            total += t[fine[j]]
        for (a, b), grid in zip(model.pairs, model.grids):
            total += grid[rough[a], rough[b]]
        assert model.score(row[None, :])[0] == pytest.approx(1 / (1 + np.exp(-total)))
        # a value on an edge falls on one side for good
        assert (model.place(row[None, :], model.edges) == model.place(np.vstack([row, row]), model.edges)[:1]).all()
