"""Fill-in-the-middle examples: texts are cut at unit borders that a Fenwick tree over text blocks finds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.registry import query, table

#: Bytes of a block, and of a text whose marks are held at a time (a multiple of it).
BLOCK, SPAN = 1024, 1 << 20
#: Bytes of outputs that are returned at a time.
YIELD = 1 << 20
# The marks before prefix, suffix and middle, and the shares of plain and of suffix-first examples in percent.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_SHARE, SUFFIX_FIRST_SHARE = 10, 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


def _marks(data: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is the first byte of a unit, is the first byte of a code point) of UTF-8 bytes.

    A unit is a run of ASCII letters or any other single code point.
    """
    letter = _LETTER[data]
    before = np.empty(len(data), dtype=bool)
    before[:1] = after_letter
    before[1:] = letter[:-1]
    point = (data & 0xC0) != 0x80
    return point & ~(letter & before), point


class BlockTree:
    """Fenwick trees of the units and the code points that begin in each block of a text.

    Entry i holds the counts of the blocks (i - lowest set bit of i, i], so a descent over the powers of two finds the block
    of a unit in as many steps as the number of blocks has bits, and adds up the code points before it on the way. Unit marks
    are made for a span at a time and not kept; that of the block found is made again.
    """

    def __init__(self, text: bytes, block: int = BLOCK):
        self.data, self.block = np.frombuffer(text, dtype=np.uint8), block
        span = max(1, SPAN // block) * block
        counts = []
        for lo in range(0, len(text), span):
            unit, point = self._marks(lo, lo + span)
            starts = np.arange(0, len(unit), block)
            counts.append((np.add.reduceat(unit, starts, dtype=np.int64), np.add.reduceat(point, starts, dtype=np.int64)))
        units, points = (np.concatenate(c) for c in zip(*counts)) if counts else (np.zeros(0, np.int64),) * 2
        self.blocks, self.n, self.n_points = len(units), int(units.sum()), int(points.sum())
        self.units, self.points = self._tree(units), self._tree(points)

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        total = np.append(0, np.cumsum(counts))
        i = np.arange(len(total))
        return (total - total[i - (i & -i)]).tolist()

    def _marks(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return _marks(self.data[lo:hi], lo > 0 and bool(_LETTER[self.data[lo - 1]]))

    def border(self, k: int) -> tuple[int, int]:
        """(byte, code point) at which unit k (from 0) begins; the end of the text for k = n."""
        if k >= self.n:
            return len(self.data), self.n_points
        at = points = 0
        step = 1 << self.blocks.bit_length()
        while step := step >> 1:
            if at + step <= self.blocks and self.units[at + step] <= k:
                at += step
                k -= self.units[at]
                points += self.points[at]
        lo = at * self.block
        unit, point = self._marks(lo, lo + self.block)
        offset = int(np.flatnonzero(unit)[k])
        return lo + offset, points + int(np.count_nonzero(point[:offset]))


def draws(doc, seed: int = 1) -> list[int]:
    """Four 32-bit draws of a document: the first hexadecimal digits of the SHA-256 of seed and id. A null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def transform(doc, text: str, seed: int = 1, block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one document."""
    raw = text.encode()
    tree = BlockTree(raw, block)
    n = tree.n
    one, two, three, four = draws(doc, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or three % 100 >= 100 - PLAIN_SHARE:
        return n, "plain", None, None, text
    (a, a_points), (b, b_points) = (tree.border(k) for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = raw[:a].decode(), raw[a:b].decode(), raw[b:].decode()
    if four % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", a_points, b_points - a_points, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a_points, b_points - a_points, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its marks occur once each, since texts that hold one of them stay plain."""
    def between(first: str, second: str) -> Column:
        lo, hi = F.locate(first, output) + len(first), F.locate(second, output)
        return F.substr(output, lo, hi - lo)
    middle = F.substr(output, F.locate(MIDDLE, output) + len(MIDDLE))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output))


def fill_in_middle(docs: DataFrame, seed: int = 1, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every document, in the pass that reads it, without a shuffle.

    n is the number of units; prefix and middle end at borders of units drawn by a hash of seed and id. form is plain, psm
    (prefix, suffix, middle) or spm (suffix, prefix, middle). A null text is empty, hence plain; a null id draws as an empty one;
    repeated rows give equal rows; an empty table gives none. A text is held whole, its marks a span at a time. Other columns
    are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            out, size = [], 0

            def made():
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.append((doc, *transform(doc, text.as_py() or "", seed, block)))
                size += len(out[-1][-1])
                if size >= YIELD:
                    yield made()
                    out, size = [], 0
            if out:
                yield made()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


OP11_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
    sha256(concat('1:', coalesce(doc_id::VARCHAR, ''))) AS h FROM documents),
drawn AS (
  SELECT *, len(unit) AS n, ('0x' || h[1:8])::BIGINT % (len(unit) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(unit) + 1) AS two,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (
  SELECT *, array_to_string(unit[1:least(one, two)], '') AS a, array_to_string(unit[least(one, two) + 1:greatest(one, two)], '') AS b,
    array_to_string(unit[greatest(one, two) + 1:], '') AS c FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', a, '<S>', c, '<M>', b) ELSE concat('<S>', c, '<P>', a, '<M>', b) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
