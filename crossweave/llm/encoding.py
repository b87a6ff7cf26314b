"""Ids of whole texts by a public tokenizer, with a bounded memory of chunks already encoded."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from crossweave.llm.held import held

# Fixed value: the characters with the Unicode property White_Space, without the space itself.
ODD_SPACE = "\t\n\x0b\x0c\r\x85\xa0  -     　"
_PAIRED = re.compile(f"[{ODD_SPACE}] | [{ODD_SPACE} ]")
_CHUNK = re.compile(f"[ {ODD_SPACE}]*[^ {ODD_SPACE}]+|[ {ODD_SPACE}]+")


# Letters and marks that stand for themselves in every normal form; no apostrophe, < or |, which start contractions and special strings.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ!-&(-;=-@\[-`{}~ \t\n\r]+")
_PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9 \t\n\r]+")
_AT_ONCE = 1 << 16
# Kinds of bytes: white space, letters, digits, other marks that stand for themselves, and all others.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
for _kind, _bytes in ((_MARK, b"!\"#$%&()*+,-./:;=>?@[\\]^_`{}~"), (_DIGIT, b"0123456789"), (_SPACE, b" \t\n\r"),
                      (_LETTER, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _KIND[list(_bytes)] = _kind
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# For tokenizers that count a space to what follows it: white space that is left to the library's own rule, kinds of bytes
# (an apostrophe may start a contraction, so its word stays whole), and runs that are one piece.
_ODD_WHITE = re.compile("[" + re.sub("[\t\n\r]", "", ODD_SPACE) + "]")
_LEAD_KIND = _KIND.copy()
_LEAD_KIND[list(b"'<")] = _ODD, _MARK
_GAP = 5
_RUN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|[ \t\n\r]+")
# Characters of texts that are cut at once, and how often that is done before their pieces are looked up.
_TEXT_AT_ONCE, _PARTS_AT_ONCE = 1 << 22, 4


class _Known(dict):
    """chunk -> its ids as little-endian 32-bit integers; emptied when it holds `limit` chunks."""

    def __init__(self, tokenizer, lead: str, limit: int):
        super().__init__()
        self.tokenizer, self.lead, self.limit = tokenizer, lead, limit

    def __missing__(self, chunk: str) -> bytes:
        ids = self.tokenizer.encode(self.lead + chunk, add_special_tokens=False).ids
        if len(self) >= self.limit:
            self.clear()
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) < 64:
            self[chunk] = out
        return out


class _Pieces:
    """Ids of pieces that the tokenizer looks at alone; remembers up to `limit` short ones."""

    def __init__(self, tokenizer, limit: int):
        self.tokenizer, self.limit = tokenizer, limit
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _merge(self, pieces: list[str], spelt: list[str]) -> None:
        """Learns pieces that reach the merges as they are spelt."""
        found = list(map(self.tokenizer.model.tokenize, spelt))
        raw = np.array([token.id for tokens in found for token in tokens], dtype="<u4").tobytes()
        edges = [0, *(4 * np.cumsum(list(map(len, found)))).tolist()]
        self.known.update(zip(pieces, (raw[a:b] for a, b in zip(edges, edges[1:]))))

    def each(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words."""
        out = list(map(self.known.get, words))
        if None in out:
            long = self._know({w for w, ids in zip(words, out) if ids is None})
            out = [self.known[w] if ids is None else ids for w, ids in zip(words, out)]
            for w in long:
                self.known.pop(w, None)
        return out

    def many(self, parts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts: their ids, one after the other, and how many each text has. Every distinct piece of all is looked up once."""
        cut = [self._cut(texts) for texts in parts]
        pieces = pa.chunked_array([p for p, _ in cut]).unify_dictionaries()
        raw = self.each(pieces.chunk(0).dictionary.to_pylist())
        size, flat = np.fromiter(map(len, raw), np.int64, len(raw)) // 4, np.frombuffer(b"".join(raw), dtype="<u4")
        first = np.cumsum(size) - size
        del raw
        for chunk, (_, texts) in zip(pieces.chunks, cut):
            which = chunk.indices.to_numpy()
            n = size[which]
            ends = np.concatenate([[0], np.cumsum(n)])
            at = np.repeat(first[which] - ends[:-1], n)
            at += np.arange(len(at))
            yield flat[at], np.diff(ends[texts])


class _Words(_Pieces):
    """Ids of words between spaces for a tokenizer that marks where a word ends; remembers up to `limit` short words.

    New words of a text are cut into runs of letters, digits and other marks, as the tokenizer does itself,
    and runs not seen before are encoded in one call, whose ids are cut behind those that end a word. Words
    with other characters, or all words if the tokenizer has no such ids, are encoded one by one.
    """

    def __init__(self, tokenizer, limit: int):
        super().__init__(tokenizer, limit)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
        if suffix:
            self.ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        # an ASCII letter is the same in either case if the tokenizer makes it small itself
        small = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("AZ") == "az"
        self.case = _LOWER if small else np.arange(256, dtype=np.uint8)
        # small letters alone reach the merges as they are
        letters = "abcdefghijklmnopqrstuvwxyz"
        plain = tokenizer.normalizer is None or tokenizer.normalizer.normalize_str(letters) == letters
        cut = tokenizer.pre_tokenizer.pre_tokenize_str(letters) if tokenizer.pre_tokenizer is not None else []
        self.merges = plain and cut == [(letters, (0, 26))]

    def _learn(self, pieces: list[str]) -> None:
        ids = self._ids(" ".join(pieces))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(pieces) and (not len(ids) or cuts[-1] == len(ids)):
            raw, edges = ids.tobytes(), [0, *(4 * cuts).tolist()]
            self.known.update(zip(pieces, (raw[a:b] for a, b in zip(edges, edges[1:]))))
        else:
            self.known.update((p, self._ids(p).tobytes()) for p in pieces)

    def _know(self, fresh: set[str]) -> list[str]:
        """Learns words; returns what is too long to be remembered longer than its text."""
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
        alone = {w for w in fresh if w.isascii() and w.isalpha()}
        plain = {w: _PIECE.findall(w) for w in fresh.difference(alone) if _PLAIN.fullmatch(w)}
        pieces = alone.union(p for run in plain.values() for p in run).difference(self.known)
        small = [p for p in pieces if p.isascii() and p.isalpha() and p.islower()] if self.merges else []
        for learn, them in ((lambda them: self._merge(them, them), small), (self._learn, list(pieces.difference(small)))):
            for i in range(0, len(them), _AT_ONCE):
                learn(them[i:i + _AT_ONCE])
        get = self.known.__getitem__
        self.known.update({w: b"".join(map(get, plain[w])) if w in plain else self._ids(w).tobytes() for w in fresh.difference(alone)})
        return [w for w in fresh.union(pieces) if len(w) >= 64]

    def _look(self, words: list[str]) -> bytes:
        return b"".join(self.each(words))

    def encode(self, text: str) -> bytes:
        words = text.split(" ")
        return b"".join(self._look(words[i:i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE))

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of these texts, one after the other, and how many come before each text and after the last.

        All texts are cut at once where the kind of a byte changes, before each digit too; white space, which has no ids, is left out.
        Words between spaces that hold a byte of no such kind stay whole.
        """
        data = np.frombuffer(" ".join([*texts, ""]).encode(), dtype=np.uint8)
        sizes = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], dtype=np.int64) + 1
        kind = _KIND[data]
        # the letters from À to ÿ are two bytes, of which × and ÷ alone are others
        wide = np.flatnonzero(data == 0xC3)
        wide = wide[(data[wide + 1] & 0xDF) != 0x97]
        kind[wide] = kind[wide + 1] = _LETTER
        cut = np.ones(len(data), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut |= kind == _DIGIT
        small = self.case[data]
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            # the word around each odd byte: from behind the space before it to the next space, which the last text has too
            spaces = np.concatenate([[-1], np.flatnonzero(data == 32)])
            word = np.searchsorted(spaces, odd)
            word = word[np.diff(word, prepend=0) > 0]
            first, last = spaces[word - 1] + 1, spaces[word]
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            inside[first] = 1
            inside[last] = -1
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            small[inside] = data[inside]
            cut[inside] = False
            cut[first] = cut[last] = True
            kind = np.where(inside, _ODD, kind)
        start = np.flatnonzero(cut)
        length = np.diff(start, append=len(data))
        some = np.flatnonzero(kind[start])
        start = start[some]
        edges = np.concatenate([[0], np.cumsum(length[some])])
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(small[kind != _SPACE])).dictionary_encode()
        return pieces, np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))


class _Leads(_Pieces):
    """Ids of pieces for a byte-level tokenizer, where one space belongs to the run of letters, digits or other marks after it.

    Runs reach the merges spelt as the tokenizer spells their bytes. A word with an apostrophe or a byte of no such kind stays
    whole and goes through the library's encode(). Texts with other white space or special strings are not for it.
    """

    PROBE, CUT = "Aß  b12 3,;\n\né <\t\n", ["Aß", " ", " b", "12", " 3", ",;", "\n", "\n", "é", " <", "\t\n"]

    def __init__(self, tokenizer, limit: int):
        super().__init__(tokenizer, limit)
        cut = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer is not None else lambda text: []
        self.fits = tokenizer.normalizer is None and [self.PROBE[a:b] for _, (a, b) in cut(self.PROBE)] == self.CUT
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.spell = {ord(c): "".join(p for p, _ in cut(c)) for c in map(chr, range(256)) if _RUN.fullmatch(c)} if self.fits else {}

    def takes(self, text: str) -> bool:
        return self.fits and not _ODD_WHITE.search(text) and not any(t in text for t in self.special)

    def _know(self, fresh: set[str]) -> list[str]:
        """Learns pieces; returns what is too long to be remembered longer than its text."""
        if len(self.known) + len(fresh) > self.limit:
            self.known.clear()
        plain = [p for p in fresh if _RUN.fullmatch(p)]
        for i in range(0, len(plain), _AT_ONCE):
            them = plain[i:i + _AT_ONCE]
            self._merge(them, "\0".join(them).translate(self.spell).split("\0"))
        self.known.update({p: self._ids(p).tobytes() for p in fresh.difference(plain)})
        return [p for p in fresh if len(p) >= 64]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of these texts, one after the other, and how many come before each text and after the last.

        All texts are cut at once where the kind of a byte changes. Of white space before something else, the last character is
        cut off; a space goes with what follows.
        """
        data = np.frombuffer("\0".join([*texts, ""]).encode(), dtype=np.uint8)
        ends = np.cumsum(np.array([len(t) + 1 if t.isascii() else len(t.encode()) + 1 for t in texts], dtype=np.int64)) - 1
        kind = _LEAD_KIND[data]
        wide = np.flatnonzero(data == 0xC3)
        wide = wide[(data[wide + 1] & 0xDF) != 0x97]
        kind[wide] = kind[wide + 1] = _LETTER
        kind[ends] = _GAP
        cut = np.ones(len(data), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut[ends] = True
        cut[ends[:-1] + 1] = True
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & (kind[1:] != _GAP))
        cut[last] = True
        cut[last + 1] = data[last] != 32
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            # the word around each odd byte, with the space before it
            borders = np.concatenate([[-1], np.flatnonzero((kind == _SPACE) | (kind == _GAP))])
            word = np.searchsorted(borders, odd)
            word = word[np.diff(word, prepend=0) > 0]
            first, after = borders[word - 1] + 1, borders[word]
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            inside[first] = 1
            inside[after] = -1
            cut[np.cumsum(inside[:-1], dtype=np.int8).view(bool)] = False
            cut[np.where((first > 0) & (data[first - 1] == 32), first - 1, first)] = True
        start = np.flatnonzero(cut)
        length = np.diff(start, append=len(data))
        some = np.flatnonzero(kind[start] != _GAP)
        start = start[some]
        edges = np.concatenate([[0], np.cumsum(length[some])])
        pieces = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(edges), pa.py_buffer(data[kind != _GAP])).dictionary_encode()
        return pieces, np.searchsorted(start, np.concatenate([[0], ends + 1]))


class TextEncoder:
    """Encodes texts cut at single spaces, where neither tokenizer joins what stands on both sides.

    spaces='drop': the tokenizer throws white space away, so every space is a border.
    spaces='lead': one space belongs to the word after it; a border lies before every space with no
    other white space beside it. Texts with such neighbours are cut before each run of white space,
    which goes with what follows it, as the tokenizer's own rule looks one character ahead.
    Chunks are encoded by the tokenizers library itself; equality with the uncut text is tested.
    """

    def __init__(self, path: str, spaces: str, limit: int = 1_600_000):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.spaces = spaces
        if spaces == "drop":
            self.words = _Words(tokenizer, limit)
        else:
            self.first, self.later = _Known(tokenizer, "", limit), _Known(tokenizer, " ", limit)
            self.leads = _Leads(tokenizer, limit)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.spaces == "drop":
            return self.words.encode(text)
        if "  " in text or " \n" in text or "\n " in text or _PAIRED.search(text):
            return b"".join(map(self.first.__getitem__, _CHUNK.findall(text)))
        parts = text.split(" ")
        return (self.first[parts[0]] if parts[0] else b"") + b"".join(map(self.later.__getitem__, parts[1:]))

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of consecutive texts as one array, and how many each has, for some texts at a time."""
        parts: list[list[str]] = []
        size, total = _TEXT_AT_ONCE, 0
        for text in texts:
            if size >= _TEXT_AT_ONCE:
                if len(parts) == _PARTS_AT_ONCE or total >= _TEXT_AT_ONCE * _PARTS_AT_ONCE:
                    yield from self._parts(parts)
                    parts, total = [], 0
                parts.append([])
                size = 0
            parts[-1].append(text or "")
            size += len(parts[-1][-1])
            total += len(parts[-1][-1])
        if parts:
            yield from self._parts(parts)

    def _parts(self, parts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.spaces == "drop":
            yield from self.words.many(parts)
            return
        alone = [[i for i, t in enumerate(part) if not self.leads.takes(t)] for part in parts]
        many = self.leads.many([[t for i, t in enumerate(part) if i not in mine] for part, mine in zip(parts, map(set, alone))])
        for part, mine, (ids, counts) in zip(parts, alone, many):
            if mine:
                raw = [np.frombuffer(self.encode(part[i]), dtype="<u4") for i in mine]
                before = np.array(mine) - np.arange(len(mine))
                at = np.concatenate([[0], np.cumsum(counts)])[before]
                edges = [0, *at.tolist(), len(ids)]
                ids = np.concatenate([x for k, r in enumerate([*raw, ids[:0]]) for x in (ids[edges[k]:edges[k + 1]], r)])
                counts = np.insert(counts, before, [len(r) for r in raw])
            yield ids, counts


def encoder(path: str, spaces: str, memory: int = 1_600_000) -> TextEncoder:
    """One encoder per worker process that remembers up to `memory` chunks, kept from task to task."""
    return held(("encoder", path, spaces, memory), lambda: TextEncoder(path, spaces, memory))
