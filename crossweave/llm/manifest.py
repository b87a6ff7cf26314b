"""Merkle manifest of a dataset: roots and a proof for every row, by sibling-shift self-joins.

The rows of a group are the numbered leaves of a tree. On every level a node meets its siblings by joining the level with itself
on their computed indices (XOR 1 where a parent has two children, slot offsets otherwise), and the node in slot zero emits the
parent. A last tree stands over the roots of the groups. Proofs are handed down from parents to children in the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crossweave.llm.registry import query, table
from crossweave.session import stage

#: The fields of a leaf of `documents`, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as it goes into a leaf: - for null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of the fields of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(digests: Column) -> Column:
    return F.array_join(F.transform(digests, hexed), "")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (32 bytes) and a proof lead to, as hex text; null if either is null.

    proof is an array of (slot, others), from the leaf up: the node's slot among the children of its parent and the other
    children from left to right. So the others before the node are as many as its slot says.
    """
    def up(node, step):
        after = F.size(step["others"]) - step["slot"]
        return F.sha2(F.concat(_joined(F.slice(step["others"], F.lit(1), step["slot"])), node,
                               _joined(F.slice(step["others"], step["slot"] + 1, after))), 256)
    return F.aggregate(proof, hexed(leaf), up)


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with idx, their place (from 0) in their tree by `order`, and n, the number of rows of the tree.

    Rows are dealt out by ranges of (tree, order, row number), so that a tree, and equal rows, are spread over many tasks, and
    sorted there. Written once: places within a task and the counts of the tasks before it must come from the same ranges.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [tree, *order, "tie"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id())
    dealt = stage(dealt, "dealt").withColumn("cell", F.shiftright("at", 33))
    cells = dealt.groupBy(tree, "cell").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    before = Window.partitionBy(tree).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(tree, "cell", (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                         F.sum("here").over(Window.partitionBy(tree)).alias("n"))
    return dealt.join(cells, [tree, "cell"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "cell", "shift")


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, idx, n, digest) with slot, others (digests of the siblings, left to right) and, in slot zero, parent."""
    slot = F.expr(f"idx % {arity}")
    out = nodes.withColumn("slot", slot.cast("int"))
    shifts = range(1, arity)
    for k in shifts:
        if arity == 2:
            wanted = F.expr("idx ^ 1")
        else:
            wanted = F.col("idx") - slot + (slot + k) % arity
        sibling = nodes.select("tree", F.col("idx").alias(f"idx{k}"), F.col("digest").alias(f"digest{k}"))
        out = out.withColumn(f"idx{k}", wanted).join(sibling, ["tree", f"idx{k}"], "left")
    each = [F.struct(F.col(f"idx{k}").alias("at"), F.col(f"digest{k}").alias("digest")) for k in shifts]
    found = F.array_sort(F.filter(F.array(*each), lambda s: s["digest"].isNotNull()))
    run = F.concat(hexed(F.col("digest")), *[F.coalesce(hexed(F.col(f"digest{k}")), F.lit("")) for k in shifts])
    return out.select("tree", "idx", "n", "slot", F.transform(found, lambda s: s["digest"]).alias("others"),
                      F.when(slot == 0, F.unhex(F.sha2(run, 256))).alias("parent"))


def _rise(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) of the trees of nodes (tree, idx, n, digest); tops has the tree, depth and digest of what remains.

    Every level is written to the shared folder. Trees that have come down to one node leave; the number of levels follows
    from the largest tree, whose size is all that the driver gets.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], [nodes.where("n = 1").select("tree", F.lit(0).alias("depth"), "digest")]
    while most > 1:
        levels.append(stage(_siblings(nodes.where("n > 1"), arity), "level"))
        nodes = levels[-1].where("slot = 0").select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
                                                    F.col("parent").alias("digest"))
        tops.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("depth"), "digest"))
        most = -(-most // arity)
    return levels, reduce(DataFrame.unionByName, tops)


def _descend(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, digest of the tree's top, proof) of every leaf; tops also has the proof of each top."""
    def at(depth):
        return tops.where(F.col("depth") == depth).select("tree", F.lit(0).cast("long").alias("idx"), "digest", "proof")
    known = at(len(levels))
    for depth in reversed(range(len(levels))):
        above = known.withColumnRenamed("idx", "up")
        here = levels[depth].withColumn("up", F.expr(f"idx div {arity}")).join(above, ["tree", "up"])
        step = F.array(F.struct("slot", "others"))
        known = here.select("tree", "idx", "digest", F.concat(step, "proof").alias("proof")).unionByName(at(depth))
        if depth:
            known = stage(known, "proofs")
    return known


def merkle_manifest(rows: DataFrame, fields: list[str], group: str, order: str, arity: int = 3, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each of `rows`: its `order` value, group, idx, leaf, subroot, root (32 bytes each) and proof, for folded().

    Leaves hash `fields`; those of a group ascend by `order` (nulls first, ties by leaf; equal rows are leaves of their own).
    Subroots ascend by group (null first, UTF-8 bytewise) under the root. `carry` names expressions over `rows` that
    are returned too. A null field is hashed as -; a null group is a group. An empty table gives no rows. Other columns
    are not read. Names of the result: `order`, "tree" (the group, marked), idx, leaf, proof, subroot, root and those of carry.

    Texts are read once and stay in their task; ids and digests are shuffled. Joins are on (tree, idx), which no two nodes of a level
    share, so a group that holds most rows is spread as well as any other.
    """
    carry = carry or {}
    # "-" sorts before "=", so the null group comes first
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    leaves = rows.select(F.col(order).alias("key"), tree.alias("tree"), leaf_digest([F.col(c) for c in fields]).alias("digest"),
                         *[e.alias(f"carry{i}") for i, e in enumerate(carry.values())])
    leaves = stage(numbered(stage(leaves, "leaves"), "tree", ["key", "digest"]), "numbered")
    levels, tops = _rise(leaves.select("tree", "idx", "n", "digest"), arity)
    tops = stage(numbered(stage(tops.withColumnRenamed("tree", "name").withColumn("tree", F.lit("")), "tops"), "tree", ["name"]), "tops")
    above, root = _rise(tops.select("tree", "idx", "n", "digest"), arity)
    root = root.first()
    none = F.array().cast("array<struct<slot:int,others:array<binary>>>")
    proofs = _descend(above, root_row(rows, root).withColumn("proof", none), arity).select("idx", "proof")
    tops = stage(tops.select("idx", F.col("name").alias("tree"), "depth", "digest").join(proofs, "idx"), "tops")
    proofs = _descend(levels, tops, arity).withColumnRenamed("digest", "subroot")
    out = leaves.withColumnRenamed("digest", "leaf").join(proofs, ["tree", "idx"])
    return out.select(F.col("key").alias(order), "tree", "idx", "leaf", "proof", "subroot",
                      F.lit(bytes(root.digest) if root else None).cast("binary").alias("root"),
                      *[F.col(f"carry{i}").alias(name) for i, name in enumerate(carry)])


def root_row(rows: DataFrame, root) -> DataFrame:
    """The top of the last tree as a table of one row, of none if there is no tree."""
    held = [(root.tree, root.depth, bytes(root.digest))] if root else []
    return rows.sparkSession.createDataFrame(held, "tree string, depth int, digest binary")


OP12_SQL = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256(concat(
      coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'),
      coalesce(concat(strlen(text), ':', text), '-'))) AS leaf,
    sha256(concat(
      coalesce(concat(strlen(doc_id::VARCHAR), ':', doc_id), '-'), coalesce(concat(strlen(source), ':', source), '-'),
      coalesce(concat(strlen(lang), ':', lang), '-'), coalesce(concat(strlen(n_chars::VARCHAR), ':', n_chars), '-'),
      coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-'))) AS altered,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda a, c: list_reduce([xor(a, c)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS crc
  FROM documents),
placed AS (
  SELECT *, coalesce('=' || source, '-') AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
low AS (
  SELECT 0 AS lvl, tree, idx, n, leaf AS digest FROM placed
  UNION ALL
  SELECT any_value(lvl) + 1, tree, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM low WHERE n > 1 GROUP BY tree, idx // 3),
subroots AS (SELECT tree, lvl, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, idx, n, digest FROM subroots
  UNION ALL
  SELECT any_value(lvl) + 1, idx // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY idx // 3),
steps AS (
  SELECT p.doc_id, p.leaf, p.tree, p.idx, l.lvl, (p.idx // (3 ** l.lvl)::BIGINT) % 3 AS slot, l.idx % 3 AS place, l.digest
  FROM placed p JOIN low l ON l.tree = p.tree AND l.n > 1 AND l.idx // 3 = p.idx // (3 ** (l.lvl + 1))::BIGINT AND l.idx <> p.idx // (3 ** l.lvl)::BIGINT
  UNION ALL
  SELECT p.doc_id, p.leaf, p.tree, p.idx, s.lvl + h.lvl, (s.idx // (3 ** h.lvl)::BIGINT) % 3, h.idx % 3, h.digest
  FROM placed p JOIN subroots s ON s.tree = p.tree
  JOIN high h ON h.n > 1 AND h.idx // 3 = s.idx // (3 ** (h.lvl + 1))::BIGINT AND h.idx <> s.idx // (3 ** h.lvl)::BIGINT),
sides AS (
  SELECT tree, idx, lvl, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < slot), '') AS lefts,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > slot), '') AS rights, string_agg(digest, '' ORDER BY place) AS whole
  FROM steps GROUP BY tree, idx, lvl),
proofs AS (SELECT tree, idx, string_agg(whole, '' ORDER BY lvl) AS whole FROM sides GROUP BY tree, idx),
heights AS (SELECT tree, lvl + (SELECT max(lvl) FROM high) AS height FROM subroots),
fold AS (
  SELECT tree, idx, 0 AS lvl, CASE WHEN crc % 2 = 0 THEN altered ELSE leaf END AS digest FROM placed
  UNION ALL
  SELECT f.tree, f.idx, f.lvl + 1, sha256(concat(coalesce(s.lefts, ''), f.digest, coalesce(s.rights, '')))
  FROM fold f JOIN heights h ON h.tree = f.tree AND f.lvl < h.height LEFT JOIN sides s ON s.tree = f.tree AND s.idx = f.idx AND s.lvl = f.lvl),
top AS (SELECT digest AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.digest AS subroot, t.root, sha256(coalesce(q.whole, '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.root AS verified
FROM placed p JOIN subroots s ON s.tree = p.tree JOIN heights h ON h.tree = p.tree JOIN fold f ON f.tree = p.tree AND f.idx = p.idx AND f.lvl = h.height
LEFT JOIN proofs q ON q.tree = p.tree AND q.idx = p.idx CROSS JOIN top t
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, checked against rows of which every second (by a checksum of its id) has lost its line ends."""
    altered = [F.regexp_replace("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    # an unaltered leaf is not carried a second time
    carry = {"altered": F.when(hit, leaf_digest(altered))}
    made = merkle_manifest(table(spark, sf_dir, "documents"), list(FIELDS), "source", "doc_id", 3, carry)
    again = folded(F.coalesce("altered", "leaf"), F.col("proof"))
    siblings = F.flatten(F.transform("proof", lambda s: s["others"]))
    return made.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"),
                       F.sha2(_joined(siblings), 256).alias("proof_sha256"), again.alias("folded_root"),
                       ).withColumn("verified", F.col("folded_root") == F.col("root"))
