"""Language identification by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.registry import query, table
from crossweave.llm.words import sub_batches

#: Slots of the hashed n-grams and their lengths in bytes.
SLOTS, GRAMS = 1 << 15, (2, 3, 4)
#: N-grams without a word to say that are added to every text, so that a short text cannot be sure of its language.
PRIOR = 30
#: Bytes of text whose n-grams are held at a time; a longer text is taken in pieces of that size.
PIECE = 500_000
_ASCII_LETTER = re.compile("[A-Za-z]")
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(ord("a"), ord("z") + 1):
    _FOLD[[_c, _c - 32]] = _c


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script."""
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def slots_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every n-gram, the byte where it begins), A-Z lower-cased, everything but letters and bytes from 128 a space.

    N-grams that begin with two spaces, or lie in none but spaces, say nothing and are left out.
    """
    x = _FOLD[np.frombuffer(data, dtype=np.uint8)].astype(np.uint32)
    slots, places = [], []
    for n in GRAMS:
        if len(x) < n:
            continue
        key = np.full(len(x) - n + 1, n, dtype=np.uint32)
        for i in range(n):
            key = key * np.uint32(0x01000193) ^ x[i:len(x) - n + 1 + i]
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x2C1B3C6D)
        key ^= key >> np.uint32(13)
        at = np.flatnonzero((x[:len(key)] != 32) | (x[1:len(key) + 1] != 32))
        slots.append((key[at] & np.uint32(SLOTS - 1)).astype(np.int64))
        places.append(at)
    if not slots:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(slots), np.concatenate(places)


def codewords(classes: int, longest: int = 31, tries: int = 200) -> np.ndarray:
    """classes x bits matrix of 0 and 1, every column splitting the classes, with far codewords.

    Up to six classes have every split once (an exhaustive code). More have random splits, from a fixed seed: of `tries` codes of `longest` bits,
    or ten bits for each doubling of the classes if that is more, the one whose nearest codewords are farthest apart.
    """
    if classes < 2:
        return np.zeros((classes, 0), dtype=np.int8)
    if classes <= 6:
        return np.array([[k >> c & 1 for k in range(1, 1 << classes - 1)] for c in range(classes - 1)] + [[0] * ((1 << classes - 1) - 1)], dtype=np.int8)[::-1].copy()
    rng = np.random.default_rng(13)
    bits = max(longest, 10 * int(np.ceil(np.log2(classes))))
    best, most = None, -1
    for _ in range(tries):
        code = np.array([rng.permutation(np.arange(classes) % 2) for _ in range(bits)], dtype=np.int8).T
        far = bits - (code @ code.T + (1 - code) @ (1 - code).T)
        np.fill_diagonal(far, bits)
        if far.min() > most:
            best, most = code, int(far.min())
    return best


class LanguageCodes:
    """Linear n-gram classifiers, one for each bit of the languages' codewords, and their loss-weighted decoding.

    A bit's classifier weighs a slot by the logarithm of its share in the languages with that bit over its share in those without, each
    language counting alike, and takes the mean over a text. A logistic curve from the means and spreads of both sides turns
    that into a margin. The loss of a language is the sum of the logistic losses of its bits, each weighted by how often
    the bit's classifier is right on that language (bits no better than chance count nothing).
    """

    def __init__(self, languages: list[str], mass: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = mass / np.maximum(mass.sum(1, keepdims=True), 1e-300)
        side = self.code.T.astype(float)
        ones, zeros = side @ share / np.maximum(side.sum(1), 1)[:, None], (1 - side) @ share / np.maximum((1 - side).sum(1), 1)[:, None]
        floor = 0.1 / SLOTS
        self.weight = np.log((ones + floor) / (zeros + floor)).T.astype(np.float32)
        bits = self.code.shape[1]
        self.slope, self.shift = np.ones(bits), np.zeros(bits)
        self.trust = np.full(self.code.shape, 1 / max(bits, 1))

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x bits: the mean weight of each text's n-grams, their number); a text of any length takes the memory of a piece."""
        total, count = np.zeros((len(texts), self.weight.shape[1])), np.zeros(len(texts))
        for data, last, lo in pieces(texts):
            slots, places = slots_of(data)
            owner = np.searchsorted(last, places, side="right")
            order = np.argsort(owner, kind="stable")
            slots, owner = slots[order], owner[order]
            edge = np.searchsorted(owner, np.arange(len(last)))
            held = np.diff(np.append(edge, len(owner)))
            full = held > 0
            if full.any():
                total[lo:lo + len(last)][full] += np.add.reduceat(self.weight[slots], edge[full], axis=0, dtype=np.float64)
            count[lo:lo + len(last)] += held
        return total / np.maximum(count, 1)[:, None], count

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """texts x bits: above 0 where the bit is more likely 1, drawn towards 0 in texts with few n-grams."""
        mean, count = self.means(texts)
        return self.slope * (mean - self.shift) * (count / (count + PRIOR))[:, None]

    def calibrate(self, count: np.ndarray, mean: np.ndarray, square: np.ndarray) -> None:
        """Curves of the bits from the number of texts of each language and their mean classifier values and squares (languages x bits)."""
        side = self.code.astype(bool)
        known = (count > 0)[:, None]
        for b in range(self.code.shape[1]):
            centre, spread = [], []
            for s in (side[:, b], ~side[:, b]):
                s = s & known[:, 0]
                m = mean[s, b].mean() if s.any() else 0.0
                centre.append(m)
                spread.append((square[s, b] - 2 * m * mean[s, b] + m * m).mean() if s.any() else 1.0)
            variance = max(np.mean(spread), 1e-9)
            self.shift[b], self.slope[b] = np.mean(centre), max(centre[0] - centre[1], 0) / variance

    def trust_in(self, right: np.ndarray) -> None:
        """Weights of the bits for each language from the share of its texts in which they are right (languages x bits)."""
        gain = np.maximum(right - 0.5, 1e-6)
        self.trust = gain / gain.sum(1, keepdims=True)

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, lead) of each row of margins; lead is how much larger the next language's loss is."""
        if not self.code.shape[1]:
            return np.zeros(len(margin), np.int64), np.ones(len(margin)), np.full(len(margin), np.inf)
        signs = 2.0 * self.code - 1
        loss = np.stack([(np.logaddexp(0, -margin * s) * t).sum(1) for s, t in zip(signs, self.trust)], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")
        rows = np.arange(len(loss))
        best = order[:, 0]
        chance = np.exp(loss[rows, best][:, None] - loss)
        return best, 1 / chance.sum(1), loss[rows, order[:, 1]] - loss[rows, best]


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """(bytes, place behind each text, number of the first text) of runs of texts of about PIECE bytes.

    A space stands before each text and so many line ends behind it that no n-gram belongs to two texts. Of a text longer than PIECE
    the few n-grams at its cuts count twice.
    """
    held, size, lo = [], 0, 0
    gap = b"\n" * (max(GRAMS) - 1)

    def joined():
        return b"".join(b" " + t + gap for t in held), np.cumsum([len(t) + len(gap) + 1 for t in held]), lo

    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), PIECE):
            if size >= PIECE:
                yield joined()
                held, size = [], 0
            if not held:
                lo = i
            # each further piece begins with the last bytes of the one before, so that no n-gram is lost at the cut
            held.append(text[max(at - max(GRAMS) + 1, 0):at + PIECE])
            size += len(held[-1])
    if held:
        yield joined()


def _unit_masses(texts: list[bytes], language: list[int], languages: int) -> np.ndarray:
    """languages x SLOTS: the n-grams of each text, which together weigh one, added up by language."""
    mass = np.zeros((languages, SLOTS))
    for text, k in zip(texts, language):
        count = np.zeros(SLOTS)
        for data, *_ in pieces([text]):
            count += np.bincount(slots_of(data)[0], minlength=SLOTS)
        mass[k] += count / max(count.sum(), 1)
    return mass


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _learned_rows(docs: DataFrame, sample: int, most_languages: int, id_col: str, text_col: str, label_col: str) -> tuple[list[str], DataFrame | None]:
    """(languages, texts with the number of their language): about `sample` rows of each language, chosen by a hash of the id."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")).where(
        F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    found = known.groupBy("label").count().limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"More than {most_languages} languages")
    if not found:
        return [], None
    found.sort(key=lambda r: r["label"])
    chance = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(1 << 40)) / float(1 << 40)
    number, rate = (F.coalesce(*[F.when(F.col("label") == r["label"], F.lit(v(i, r))) for i, r in enumerate(found)])
                    for v in (lambda i, r: i, lambda i, r: min(1.0, sample / r["count"])))
    return [r["label"] for r in found], known.where(chance < rate).select("text", number.alias("language"))


def train(docs: DataFrame, sample: int = 4_000, most_languages: int = 400, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "lang") -> LanguageCodes:
    """The model, from about `sample` texts of each language that are not held out (each row by a hash of its id, so that large languages
    are sampled evenly and small ones taken whole). That bound is the only use of a sample. Tasks return sums alone: of n-grams,
    then of classifier values, then of right bits. More than most_languages labels are refused.
    """
    languages, rows = _learned_rows(docs, sample, most_languages, id_col, text_col, label_col)
    if rows is None:
        return LanguageCodes([], np.zeros((0, SLOTS)))

    def sums(fn, width: int) -> np.ndarray:
        """languages x width: what fn(texts, languages) adds up over all rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(languages), width))
            for batch in batches:
                texts = [(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist()) if has_letter(t)]
                for part in sub_batches(((t.encode(), k) for t, k in texts), 0, PIECE):
                    fn([t for t, _ in part], np.array([k for _, k in part]), total)
            row, slot = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[row, slot])], names=["row", "slot", "value"])
        out = np.zeros((len(languages), width))
        added = rows.mapInArrow(run, "row int, slot int, value double").groupBy("row", "slot").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value"))
        got = added.toArrow()
        out[got["row"].to_numpy(), got["slot"].to_numpy()] = got["value"].to_numpy()
        return out

    def grams(texts, language, total):
        total += _unit_masses(texts, language.tolist(), len(languages))

    model = LanguageCodes(languages, sums(grams, SLOTS))
    bits = model.code.shape[1]
    if not bits:
        return model

    def moments(texts, language, total):
        value = model.means(texts)[0]
        np.add.at(total, language, np.hstack([np.ones((len(texts), 1)), value, value ** 2]))

    got = sums(moments, 1 + 2 * bits)
    count = np.maximum(got[:, :1], 1)
    model.calibrate(got[:, 0], got[:, 1:1 + bits] / count, got[:, 1 + bits:] / count)

    def right(texts, language, total):
        np.add.at(total, language, (model.margins(texts) > 0) == model.code[language].astype(bool))

    model.trust_in((sums(right, bits) + 1) / (count + 2))
    return model


def identify(docs: DataFrame, model: LanguageCodes, unclear: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous) of every document, from its whole text, in one pass without a shuffle.

    lang_pred is a learned language, or und where the text is null or has no letter or nothing was learned; then the score is 0.
    ambiguous: the next language's loss is less than `unclear` larger (always so for und). Equal losses go to the language first in
    the alphabet. A null id is not held out; repeated rows give equal rows; an empty table gives none. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "lang_pred", "score", "ambiguous"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i, h, t.encode() if has_letter(t) else b"") for i, h, t in zip(*(batch.column(c).to_pylist() for c in range(3))))
            for part in sub_batches(rows, 2, PIECE):
                language, score, lead = model.decode(model.margins([t for *_, t in part]))
                known = [bool(t) and bool(model.languages) for *_, t in part]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i, *_ in part], batch.schema.field(0).type), pa.array([h for _, h, _ in part]),
                    pa.array([model.languages[k] if ok else "und" for k, ok in zip(language, known)]),
                    pa.array(np.where(known, score, 0.0)), pa.array((lead < unclear) | ~np.array(known))], names=names)

    return docs.select(F.col(id_col), held_out(id_col).alias("held"), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


@query("op13_language_codes")
def op13_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
