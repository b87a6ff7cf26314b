"""Personal data: base patterns, and terms that give a protected entity away by their co-occurrence with it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossweave.llm.automaton import words_of
from crossweave.llm.held import release
from crossweave.llm.registry import query, table
from crossweave.session import stage

# The kinds of base spans in their order, and their patterns. A match cannot begin inside a run of
# digits whose start failed, so runs are entered at their start only and never rescanned.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


#: Characters from which a word of letters and digits also counts by its shape.
LONG = 16


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base span, in code points, ordered by start and kind."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        # a match has one @: the local part is the run before it, as far as no earlier match holds it
        run = text[max(done, at - 64):at]
        start = at - (len(run) - len(run.rstrip(_LOCAL)))
        while start == at - len(run) and start > done:
            run = text[max(done, at - 2 * len(run)):at]
            start = at - (len(run) - len(run.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of a text outside its base spans; terms in lower case for A-Z."""
    for start, _, end in spans:
        text = text[:start] + " " * (end - start) + text[end:]
    return [(m[0], m.start(), m.end()) for m in _TERM.finditer(text.translate(_LOWER))]


def shape(word: str) -> str | None:
    """The general term that a long word of both letters and digits stands for, by its length; None for other words.

    Keys and tokens are different in every text, so only what they have in common can occur together with anything.
    """
    if len(word) < LONG or word.isalpha() or not _DIGIT.search(word) or word.isdigit():
        return None
    return f"\x00mixed:{len(word).bit_length()}"


def _with_shapes(words: set[str]) -> set[str]:
    return words | {s for w in words if len(w) >= LONG and (s := shape(w))}


def _distinct(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Distinct terms of a text outside its base spans: its words, and the shapes of the long ones."""
    return _with_shapes({t for t, _, _ in terms_of(text, spans)} if spans else {w.decode() for w in words_of(text)})


def levels(kind: int, value: str) -> list[str]:
    """A protected entity at its levels: the value, and what it shares with others (an e-mail's domain, an address' network, a number's head)."""
    value = value.lower()
    general = {"email": lambda: value.partition("@")[2], "ip": lambda: value.rpartition(".")[0],
               "card": lambda: _NOT_DIGIT.sub("", value)[:6], "phone": lambda: _NOT_DIGIT.sub("", value)[:4]}
    name = KINDS[kind]
    return [f"{name}:{value}", f"{name} group:{general[name]()}"]


def document_frequencies(docs: DataFrame, text_col: str = "text", flush: int = 150_000) -> DataFrame:
    """(term, n): in how many documents each word occurs outside base spans, over all of them, counted in the tasks before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        tally: Counter = Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                tally.update(_distinct(text, base_spans(text)))
                if len(tally) >= flush:
                    yield batch_of()
                    tally.clear()
        yield batch_of()

    return docs.select(text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _holding(common: frozenset):
    """Entities and distinct words, without the common ones, of every text that holds an entity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                text = text.as_py()
                spans = base_spans(text)
                if spans:
                    out.append((row, sorted({e for a, k, b in spans for e in levels(k, text[a:b])}), sorted({KINDS[k] for _, k, _ in spans}),
                                f"{KINDS[spans[0][1]]}:{text[spans[0][0]:spans[0][2]].lower()}", sorted(_distinct(text, spans) - common)))
            kinds = pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 5, kinds)], names=["row", "entities", "kinds", "value", "terms"])
    return run


def _beyond_chance(n: Column, q: Column, p: Column, pairs: int, alarm: float) -> Column:
    """Whether the share q of n documents is beyond what chance gives any of `pairs` terms but with probability `alarm`.

    Were a term independent of an entity that the share p of all documents hold, at least the share q of its n documents
    would hold it with probability 2 ** -(n * KL(q, p)) at most (Chernoff).
    """
    def part(x, y):
        return F.when(x > 0, x * F.log2(x / y)).otherwise(0.0)
    return (q > p) & (p < 1) & (n * (part(q, p) + part(1 - q, 1 - p)) >= F.log2(F.lit(max(pairs, 1) / alarm)))


def _kind_terms(held: DataFrame, words: DataFrame, total: int, certainty: float, alarm: float) -> DataFrame:
    """(entity, term, bits) of terms that reveal that a document holds personal data, of one kind or of any.

    A kind is too common for many bits, so the threshold is on chance (see _beyond_chance), besides `certainty` for the share of a term's documents.
    Documents with the same first value count once in it, so that copies of one document prove nothing.
    """
    rows = held.select("row", "value", F.explode(F.array_union(F.array(F.lit("any")), "kinds")).alias("kind"), "terms")
    base = stage(rows.groupBy("kind").agg(F.count("*").alias("n_kind")), "kinds")
    both = rows.select("kind", "value", F.explode("terms").alias("term")).groupBy("kind", "term").agg(F.count_distinct("value").alias("n_both"))
    both = both.join(words, "term").join(F.broadcast(base), "kind")  # a row for each kind
    p, q = F.col("n_kind") / total, F.col("n_both") / F.col("n")
    sure = _beyond_chance(F.col("n"), q, p, words.count() * len(KINDS), alarm)
    return both.where((q >= certainty) & sure).select(F.concat(F.lit("kind:"), "kind").alias("entity"), "term", F.log2(q / p).alias("bits"))


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = 3, bits: float = 5.0, certainty: float = 0.5, alarm: float = 0.01) -> DataFrame:
    """(entity, term, bits) of the terms that reveal an entity. A term is a word, or the shape of long words of letters and digits.

    Entities are protected at three levels: the value, the group it belongs to (see levels) and its kind (see _kind_terms). Groups and
    kinds are common, so their terms must also be beyond chance, with the probability `alarm` of one wrong term of a level.
    With n documents in all, a term reveals log2(n * n(term, entity) / (n(term) * n(entity))) bits about an entity, the pointwise
    mutual information of their occurrence in whole documents. It discloses a value or group from `bits` on, if at least `support`
    documents show both and at least the share `certainty` of the term's documents do. Counts are over all documents; words inside
    base spans are not counted.

    n(term, entity) is at most n(term) and n(entity), so terms and entities that cannot reach the thresholds by their own counts go
    before they are paired. Words of more than n / 2 ** bits documents are the only ones that fill a task's share alone, and
    are few whatever n is (2 ** bits times the mean number of words of a document at most): they go while texts are read.
    """
    total, slack = docs.count(), 1 + 1e-9
    most = total / 2.0 ** bits * slack
    words = stage(document_frequencies(docs, text_col).where(F.col("n") >= support), "words")
    common = frozenset(r.term for r in words.where(F.col("n") > most).select("term").collect())
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    held = stage(rows.mapInArrow(_holding(common), "row long, entities array<string>, kinds array<string>, value string, terms array<string>"), "holding")
    words = words.where(F.col("n") <= most)
    # written first, so that the joins read plain tables on both sides and a hot entity is split
    known = stage(held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
                  .where((F.col("n_entity") >= support) & (F.col("n_entity") <= most)), "entities")
    of = stage(held.select("row", F.explode("entities").alias("entity")).join(known, "entity"), "entities")
    candidates = held.join(of.select("row").distinct(), "row", "left_semi").select("row", F.explode("terms").alias("term"))
    pairs = candidates.join(words, "term").join(of, "row").where(F.col("n") * certainty <= F.col("n_entity") * slack)
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n").alias("n"), F.first("n_entity").alias("n_entity"))
    gain = F.log2(total * F.col("n_both") / (F.col("n") * F.col("n_entity")))
    share = F.col("n_both") / F.col("n")
    sure = _beyond_chance(F.col("n"), share, F.col("n_entity") / total, words.count() * known.count(), alarm)
    told = both.where((F.col("n_both") >= support) & (share >= certainty) & (~F.contains("entity", F.lit(" group:")) | sure))
    told = told.select("entity", "term", gain.alias("bits")).where(F.col("bits") >= bits)
    return told.unionByName(_kind_terms(held, words, total, certainty, alarm))


def _found(text: str | None, telling: frozenset, encoded: frozenset) -> tuple[list, list]:
    """(base spans, spans of disclosing terms) of a text."""
    base = base_spans(text)
    if not telling:
        return base, []
    words = words_of(text)
    if encoded.isdisjoint(words) and not any(len(w) >= LONG and shape(w.decode()) in telling for w in words):
        return base, []
    return base, [(a, KINDS.index("term"), b) for t, a, b in terms_of(text, base) if t in telling or (len(t) >= LONG and shape(t) in telling)]


def _mark(telling: frozenset):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64())]))
        encoded = frozenset(t.encode() for t in telling)
        for batch in batches:
            spans, terms = [], []
            for text in batch.column("text"):
                for out, of in zip((spans, terms), _found(text.as_py(), telling, encoded)):
                    out.append([dict(zip(("start", "kind", "end"), s)) for s in of])
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(spans, kind), pa.array(terms, kind)],
                                             names=["doc", "key", "spans", "terms"])
    return run


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **thresholds) -> DataFrame:
    """(doc, key, spans, terms) of every row: base spans (start, kind, end), and those of disclosing terms wherever they stand.

    key is a hash of the text. Three passes over the texts, none of which shuffles them: one counts the words of all documents, one
    takes entities and words of the documents with entities, one marks. A term that discloses an entity is marked at every place
    outside base spans in every text, with or without the entity. The disclosing terms, distinct, are held by each worker.
    A null or empty text has no spans; rows with null ids or repeated ids are judged each by its own text; other columns are not read.
    """
    telling = frozenset(r.term for r in disclosing_terms(docs, text_col, **thresholds).select("term").distinct().collect())
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    span = "array<struct<start:bigint,kind:bigint,end:bigint>>"
    return rows.mapInArrow(_mark(telling), f"doc {docs.schema[id_col].dataType.simpleString()}, key long, spans {span}, terms {span}")


def _generalised(text: str, spans: list[tuple[int, int, int]]) -> str:
    merged: list[list[int]] = []
    for a, kind, b in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][1:] = min(kind, merged[-1][1]), max(b, merged[-1][2])
        else:
            merged.append([a, kind, b])
    parts, at = [], 0
    for a, kind, b in merged:
        parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with base spans generalised to [EMAIL], [IP], [CARD] or [PHONE] and disclosing terms to [TERM]; columns stay.

    Overlapping spans become one, named by the first kind listed. Rows without spans are unchanged. Spans are found and replaced in one
    pass over the texts, which stay in their tasks.
    """
    telling = frozenset(r.term for r in disclosing_terms(docs, text_col, **options).select("term").distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoded = frozenset(t.encode() for t in telling)
        for batch in batches:
            texts = []
            for text in batch.column(text_col):
                text = text.as_py()
                base, terms = _found(text, telling, encoded)
                texts.append(_generalised(text, base + terms) if base or terms else text)
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s.kind + 1).cast("int")), s.start.cast("string"), s.end.cast("string"))), ",")


@query("op9_personal_spans")
def op9_personal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    every = F.sort_array(F.concat("spans", "terms"))
    return found.select(F.col("doc").alias("doc_id"), *[of(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
                        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(every).alias("spans"),
                        F.size("terms").cast("long").alias("n_term"))
