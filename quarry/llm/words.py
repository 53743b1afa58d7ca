"""Encoding by words: a text's ids are the joined ids of its words, each word encoded once per worker.

``WordCache`` keeps the little-endian unsigned 32-bit ids of words as bytes, so that a document's ids
are one join.  It is bounded: beyond ``most`` words the older half goes, and words of more than ``KEEP`` bytes, such as
whole texts in scripts without spaces, are never kept.  ``WordBpe`` encodes by the
tokenizers library: NumPy finds the words of many texts at once and their different ones, only those are
looked up or encoded, and their ids are put in place for all.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable
from itertools import islice

import numpy as np

from .common import worker_table

#: The longest words that a table keeps; with the number of words, this bounds its bytes.
KEEP = 64


class WordCache(dict):
    """``encode`` gets the words that are new in some texts, all at once; None is for those that have no ids of their own."""

    def __init__(self, encode: Callable[[list], list[bytes | None]], most: int = 300_000):
        super().__init__()
        self.encode, self.most = encode, most
        self.new: dict = {}

    def __missing__(self, word):
        """A place that is filled before it is read."""
        if (place := self.new.get(word)) is None:
            place = self.new[word] = bytearray()
        return place

    def joined(self, texts: list[list]) -> list[bytes | None]:
        """The ids of each text's words, joined; None if a word has none."""
        look = self.__getitem__
        found = [list(map(look, words)) for words in texts]
        new, self.new = self.new, {}
        if new:
            ids = self.encode(list(new))
            for place, x in zip(new.values(), ids, strict=True):
                place += x or b""
            if len(self) + len(new) > self.most:
                for w in list(islice(self, len(self) // 2)):
                    del self[w]
            self.update((w, x) for w, x in islice(zip(new, ids, strict=True), self.most) if len(w) <= KEEP)
            if None in ids:
                none = {w for w, x in zip(new, ids, strict=True) if x is None}
                found = [[None] if not none.isdisjoint(words) else x for words, x in zip(texts, found, strict=True)]
        out = []
        for x in found:
            try:
                out.append(b"".join(x))
            except TypeError:
                out.append(None)
        return out


# White space by which texts are cut.
SPACE = b"\t\n\x0b\x0c\r "
#: Bytes of text that are cut at once, and the length from which words of one hash are compared.
PART, LONG = 3 << 20, 256


def _classes() -> np.ndarray:
    """Of bytes: 0 white space, 1 letters (and what follows 0xC3), 2 digits, 3 the other signs, 4 what the library must see in context."""
    c = np.full(256, 3, np.uint8)
    c[list(SPACE)] = 0
    c[ord("a") : ord("z") + 1] = 1
    c[ord("0") : ord("9") + 1] = 2
    c[0x80:] = 4
    c[0x80:0xC0] = c[0xC3] = 1
    c[[*range(9), *range(14, 32), 127, ord("'"), *range(ord("A"), ord("Z") + 1)]] = 4
    return c


class WordBpe:
    """A vocabulary of the tokenizers library, by words.

    No step of the vocabulary's normaliser or pattern looks across ASCII white space.  Between white
    space, its pattern cuts lower-case texts into runs of letters, single digits, and runs of other signs; so a
    stretch of ASCII and accented Latin letters is cut that way here, and each run goes to the library's BPE
    model.  A stretch with an apostrophe or any other character goes through the library whole.  The strings
    of special tokens are ordinary text.
    """

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        # The usual characters for bytes: printable ones stand for themselves, the others follow from 256 on.
        own = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.shown = {b: b if b in own else next(rest) for b in range(256)}
        self.known: dict[bytes, bytes] = {}  # little-endian unsigned 32-bit ids
        self.most = most
        self.classes = _classes()
        rng = np.random.default_rng(1)
        self.code = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, np.uint64)

    def _new(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the table doesn't have."""
        new, other = {}, []
        for w in words:
            c = self.classes[np.frombuffer(w, np.uint8)] if not w.isalpha() else None
            if c is not None and (c.max() == 4 or b"\xc3\x97" in w or b"\xc3\xb7" in w):
                other.append(w)
            else:
                shown = w.decode().lower() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(self.shown)
                new[w] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        for w, e in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False) if other else (), strict=True):
            new[w] = array("I", e.ids).tobytes()
        return new

    def _make_room(self, n: int) -> None:
        """The older half of the table goes if ``n`` more words would be too many."""
        if len(self.known) + n > self.most:
            for w in list(islice(self.known, (len(self.known) + 1) // 2)):
                del self.known[w]

    def _cut(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words in a text that begins and ends with white space."""
        c = self.classes[a]
        odd = c == 4
        odd[1:] |= (a[:-1] == 0xC3) & ((a[1:] == 0x97) | (a[1:] == 0xB7))
        if odd.any():  # their stretches between white space are words
            space = c == 0
            stretch = np.cumsum(space)
            whole = np.zeros(stretch[-1] + 1, bool)
            whole[stretch[odd]] = True
            c[whole[stretch] & ~space] = 5
        edge = (c[1:] != c[:-1]) | (c[1:] == 2)
        at = np.flatnonzero(edge) + 1
        starts = at[c[at] != 0]
        ends = at[c[at - 1] != 0]
        return starts, ends

    def _encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of words, number of ids of each, and all ids."""
        a = np.frombuffer(data, np.uint8)
        starts, ends = self._cut(a)
        if not len(starts):
            return starts, starts, np.zeros(0, np.uint32)
        if len(self.powers) <= len(a):
            base = np.full(len(a) * 9 // 8 + 1, 0x9E3779B97F4A7C15, np.uint64)
            base[0] = 1
            self.powers = np.cumprod(base)
            self.inverse = np.cumprod(np.where(base == 1, base, np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[a] * self.powers[: len(a)])])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        first = order[new]
        words = [data[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        for k in np.flatnonzero(ends - starts >= LONG).tolist():
            if (w := data[starts[k] : ends[k]]) != words[kind[k]]:
                kind[k] = len(words)
                words.append(w)
        known = self.known
        ids = list(map(known.get, words))  # held here, so the table may drop them
        if missing := [i for i, x in enumerate(ids) if x is None]:
            self._make_room(len(missing))
            new = self._new([words[i] for i in missing])
            for i, x in zip(missing, map(new.__getitem__, [words[i] for i in missing]), strict=True):
                ids[i] = x
            known.update(islice(((w, x) for w, x in new.items() if len(w) <= KEEP), max(self.most - len(known), 0)))
            del new
        sizes = np.array(list(map(len, ids)), np.int64) // 4
        flat, offsets = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[kind]
        at = np.repeat(offsets[kind] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return starts, n, flat[at]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        lo = size = 0
        for i, x in enumerate(texts):
            size += len(x)
            if size >= PART or i + 1 == len(texts):
                out += self._encode_some(texts[lo : i + 1])
                lo, size = i + 1, 0
        return out

    def _encode_some(self, texts: list[bytes]) -> list[bytes]:
        if len(texts) == 1 and len(texts[0]) > 2 * PART:  # a very long text, in parts
            parts, at, text = [], 0, texts[0]
            while at < len(text):
                end = at + PART
                while end < len(text) and text[end] not in SPACE:
                    end += 1
                parts += self._encode_some([text[at:end]])
                at = end
            return [b"".join(parts)]
        # A capital before an accent of its own could compose otherwise than its small letter.
        low = [x if b"\xcc" in x or b"\xcd" in x else x.lower() for x in texts]
        data = b" " + b" ".join(low) + b" "
        starts, n, ids = self._encode(data)
        ends = np.cumsum([len(x) + 1 for x in texts])
        cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.searchsorted(starts, ends, "right")])].tolist()
        little = ids.astype("<u4", copy=False)
        return [little[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False)]


_coders: dict[str, WordBpe] = worker_table()


def encode_texts(texts: list[bytes], path: str, end: int | None = None) -> list[bytes]:
    """Ids of each UTF-8 text as little-endian unsigned 32-bit integers, with the id ``end`` after them."""
    if path not in _coders:
        _coders[path] = WordBpe(path)
    tail = b"" if end is None else end.to_bytes(4, "little")
    return [x + tail for x in _coders[path].encode(texts)]
