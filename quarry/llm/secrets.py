"""Secret scans: fixed forms, and strings that a character Markov model takes for random.

Fixed forms (``BASE``) are found first.  The method then looks at every other run of token
characters, and at what is left of one beside a fixed form: first-order Markov models of several kinds of random strings, and one of
ordinary identifiers and words, give it a log-likelihood ratio, and it is a secret if the best is high enough.  The models
are trained from labelled samples: generated strings of all kinds, and the words of at most
``TRAIN_ROWS`` documents (those of least hashed id), labelled by the fixed forms.  Only their counts
of character pairs reach the driver.  Strings of digits alone look like any number, and are not told apart by it.

Spans are in code points, end exclusive.  Cases: null text is empty; an empty or clean text gives no
span; repeated rows are kept; an empty table is scanned with the models of the generated strings
alone.  Very long texts are scanned whole.  Other columns are not read, or kept as they are by
``redact``.  Nothing but the training counts is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, field, pick, slices, struct, trimmed

# The forms, their least lengths and the group whose length counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a run of [0-9a-f]+ is a match from its start or not at all
KINDS = ("assign", "access", "hex", "markov")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

TRAIN_ROWS = 2000
#: Strings considered by the models: so many token characters or more, and so many different ones.
LEAST, DIFFERENT = 16, 8
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Nats by which a random model must be likelier, in all and for each character: chosen on held-out strings.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.5

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1  # the last stands for the start and for any other character
CODE = np.full(256, SIZE - 1, np.int64)
CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))

_assign, _access, _hex, _candidate = (re.compile(x, re.A) for x in (ASSIGN, ACCESS, HEX, CANDIDATE))
_word = re.compile(r"[A-Za-z0-9_-]{4,}", re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the fixed forms, leftmost and non-overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(found)


def pair_counts(strings: list[str]) -> np.ndarray:
    """Counts of character pairs, the start included."""
    codes = CODE[np.frombuffer(("\0" + "\0".join(strings)).encode("latin-1", "replace"), np.uint8)]
    if not strings:
        return np.zeros((SIZE, SIZE), np.int64)
    keep = codes[1:] != SIZE - 1
    return np.bincount((codes[:-1] * SIZE + codes[1:])[keep], minlength=SIZE * SIZE).reshape(SIZE, SIZE)


def generated(n: int = 4000, seed: int = 7) -> tuple[list[str], list[str]]:
    """Labelled strings made by rule: random ones in four alphabets, and identifiers of common parts."""
    rng = random.Random(seed)
    noise = [_random(rng, ("alphanumeric", "url", "hex", "HEX")[i % 4], rng.randint(20, 48)) for i in range(n)]
    return noise, [_identifier(rng, i) for i in range(n)]


#: Kinds of random strings, each with a model of its own.
RANDOM = {
    "alphanumeric": ALPHABET[:62], "url": ALPHABET[:64], "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "small": ALPHABET[:26] + "0123456789",
    "capital": ALPHABET[26:62], "letters": ALPHABET[:52], "small letters": ALPHABET[:26], "capital letters": ALPHABET[26:52], "base64": ALPHABET[:64].replace("+", "").replace("/", "") + "+/",
}
# Parts of ordinary identifiers.
PARTS = "user name file path get set list index count value data table column row key type size max min total order line item part customer region date time start end version test config server client request response message error status update create delete insert select"


def _random(rng: random.Random, kind: str, n: int) -> str:
    return "".join(rng.choices(RANDOM[kind], k=n))


def _identifier(rng: random.Random, i: int) -> str:
    some = rng.choices(PARTS.split(), k=rng.randint(2, 5))
    number = str(rng.choice((rng.randint(0, 99), rng.randint(1990, 2035), rng.randint(10**5, 10**9)))) if i % 3 == 0 else ""
    glue = ("_", "-", "")[i % 3]
    return glue.join(x.title() if i % 3 == 2 and k else x for k, x in enumerate(some)) + (glue + number if number else "")


def labelled(n: int = 1500, seed: int = 11) -> tuple[dict[str, list[str]], list[str]]:
    """Random strings of every kind, and identifiers of more forms: constants, paths, dates and numbers."""
    rng = random.Random(seed)
    noise = {kind: [_random(rng, kind, rng.randint(LEAST, 48)) for _ in range(n)] for kind in RANDOM}
    plain = [_identifier(rng, i) for i in range(2 * n)]
    for i in range(n):
        some = rng.choices(PARTS.split(), k=rng.randint(2, 5))
        stamp = f"{rng.randint(1990, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        plain.append(("_".join(some).upper(), "/".join(some), "/" + "/".join(some) + "/" + stamp, f"{some[0]}_{stamp}T{rng.randint(0, 23):02}", str(rng.randint(10**8, 10**16)))[i % 5])
    return noise, plain


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratios of each character pair: a kind of random strings against ordinary ones."""

    ratio: np.ndarray

    @staticmethod
    def of(noise: np.ndarray, plain: np.ndarray) -> Markov:
        """From counts of one kind of random strings or several."""
        def logs(counts: np.ndarray) -> np.ndarray:
            c = counts[..., :-1] + 0.5
            return np.log(c / c.sum(axis=-1, keepdims=True))

        ratio = logs(noise.reshape(-1, SIZE, SIZE)) - logs(plain)
        return Markov(np.concatenate([ratio, np.zeros((len(ratio), SIZE, 1))], axis=2))

    def score(self, s: str) -> float:
        c = CODE[np.frombuffer(("\0" + s).encode("ascii"), np.uint8)]
        return float(self.ratio[:, c[:-1], c[1:]].sum(axis=1).max())

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Random-looking strings outside the fixed forms."""
        found = []
        for m in _candidate.finditer(text):
            lo, parts = m.start(), []
            for a, _, b in base:  # ascending; they are few
                if a < m.end() and b > lo:
                    parts.append((lo, a))
                    lo = b
            for a, b in [*parts, (lo, m.end())]:
                s = text[a:b]
                if b - a >= LEAST and len(set(s)) >= DIFFERENT and (x := self.score(s)) >= LEAST_TOTAL and x >= LEAST_MEAN * len(s):
                    found.append((a, 3, b))
        return found


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Markov:
    """The models from generated strings and the words of at most ``rows`` documents."""
    strings, ordinary = labelled()
    noise, plain = np.stack([*map(pair_counts, strings.values()), pair_counts([])]), pair_counts(ordinary)  # the last is for the fixed forms
    if rows:
        docs = pick(df, id=id_col, text=text_col)
        ids = [r.id for r in docs.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(rows).collect()]
        arrow = arrow_schema(schema := struct(("label", "int"), ("pair", "int"), ("n", "bigint")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((2, SIZE * SIZE), np.int64)
            for batch in slices(batches, "text"):
                for text in batch.column("text").to_pylist():
                    spans, strings, at = base_spans(text or ""), ([], []), 0
                    for a, _, b in spans:
                        strings[1].append((text or "")[at:a])
                        strings[0].append(text[a:b])
                        at = max(at, b)
                    strings[1].append((text or "")[at:])
                    secret = [w for s in strings[0] for w in _candidate.findall(s)]
                    words = [w for s in strings[1] for w in _word.findall(s)]
                    sums[0] += pair_counts(secret).ravel()
                    sums[1] += pair_counts(words).ravel()
            at = np.flatnonzero(sums.ravel())
            yield batch_of(arrow, label=at // (SIZE * SIZE), pair=at % (SIZE * SIZE), n=sums.ravel()[at])

        sample = docs.where(F.col("id").isin(ids)) if ids else docs.limit(0)
        for r in sample.mapInArrow(trimmed(run), schema).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect():
            (noise[-1], plain)[r.label][divmod(r.pair, SIZE)] += r.n
    return Markov.of(noise if noise[-1].any() else noise[:-1], plain)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Markov | None = None) -> DataFrame:
    """Every document with its spans: ``spans`` is an array of (kind, start, end) by start, then kind."""
    model = model or fit(df, id_col, text_col)
    schema = struct((id_col, field(df, id_col)), ("spans", "array<struct<kind:string,start:bigint,end:bigint>>"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                spans = sorted(base + model.spans(text, base)) if text else []
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield batch_of(arrow, **{id_col: batch.column("id"), "spans": out})

    return pick(df, id=id_col, text=text_col).mapInArrow(trimmed(run), schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the fixed forms, the SHA-256 of their list, and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select(id_col, *map(count, KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("markov"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Markov | None = None, mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mark``; texts without one, and other columns, stay as they are."""
    model = model or fit(df, id_col, text_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    parts, done = [], 0
                    for a, _, b in sorted(base + model.spans(text, base)):
                        if b > done:  # spans of two kinds may overlap: one mark for both
                            parts += [text[done:a], mark] if a >= done else []
                            done = b
                    text = "".join(parts) + text[done:]
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, type=batch.schema.field(at).type))

    return df.mapInArrow(trimmed(run), df.schema)
