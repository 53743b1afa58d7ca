"""Language-model scores from Elias-Fano n-gram tries that all training documents fill.

A word's probability after a context is smoothed by the one after the context without its first word:
p(w | h) = (c(h, w) + MU p(w | h')) / (c(h) + MU), with a MU for each level, and p(w) = (c(w) + 1) / (N + V + 1).
The trie of level k has every context of k-1 words, its successors, and the smoothed p(w | h) of each, quantised to
8 bits of its logarithm; a successor that is not there has p(w | h) = MU / (c(h) + MU) p(w | h').  A document's first word
follows the end of another, its end is a token, and no context goes beyond its start.

Neither the vocabulary nor a trie is ever in one place.  Documents are turned into parts of a few million tokens, numbered
by their own different words, which wait in the shared folder.  A part sends its words, as they are, with their counts to shards
by hash; each shard adds up equal words, numbers them and answers every part.  Then, level by level, a part sends its different
n-grams to shards by context: the context by its number, which the level below gave it, with its count; the
successor by its number, with its probability of the level below.  Each shard adds up, builds its trie in mapped memory, and
looks up every n-gram it was sent: the context, then the successor among that context's.  A context with more than a fraction of a shard's
share of tokens is dealt to several shards by its successors.  Words and n-grams are told apart by their bytes and numbers alone; hashes only
deal them out.  There are as many shards as the bytes of the texts ask for, so a shard is as large with any input; what
the driver sees are its two sums.  What is sent grows with the different n-grams of a part; copies and frequent ones weigh once for a part.

Cases: null text is empty: its end is its one token; a document of null id is held out; with nothing to train
on, every token has probability 1; repeated rows and ids count and are scored each; a very long text is a part
of its own; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import mmap
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, bundle, field, opened, pick, raw, shared_dir, slices, small, stored, struct, trimmed, unbundle
from .elias_fano import Trie

#: Words of the longest n-grams, and MU of the levels from 2 on; levels beyond have the last.
ORDER = 3
MU = (100.0, 30.0, 10.0)
#: Tokens after which a part ends with its slice of the input, and bytes of text for each shard.
PART, SHARD = 1_500_000, 8 << 20
#: Shares of a shard's tokens beyond which a context is dealt to several shards.
SPREAD = 4
#: Stands for the end: no word has a space.
END = b" "


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All words, A-Z in lower case, with END after each text; and the number of tokens of each text."""
    data = b" ".join(texts).lower() + b" "
    a = np.frombuffer(data, np.uint8)
    word = (a != 32) & ((a < 9) | (a > 13))
    last = np.cumsum([len(x) + 1 for x in texts]) - 1  # the byte after each text
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[last] = True
    starts = np.flatnonzero(first)
    word[last] = True
    offsets = np.append(np.cumsum(word)[starts] - 1, word.sum()).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[word])])
    return found, np.diff(np.searchsorted(starts, last, "right"), prepend=0)


def bits(x: np.ndarray) -> int:
    return int(x.max()).bit_length() if len(x) else 0


def keys(*columns: np.ndarray) -> np.ndarray:
    """Integers in the order of the rows of some columns of integers, and equal for equal rows."""
    columns = tuple(x.astype(np.uint64) for x in columns)
    if sum(map(bits, columns)) > 64:  # numbered anew by what there is
        columns = tuple(np.unique(x, return_inverse=True)[1].astype(np.uint64) for x in columns)
    if sum(map(bits, columns)) > 64:
        columns = (np.unique(keys(*columns[:-1]), return_inverse=True)[1].astype(np.uint64), columns[-1])
    out = columns[0]
    for x in columns[1:]:
        out = (out << np.uint64(bits(x))) | x
    return out


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key is, in ascending order, and each key's place among those."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


class Codes:
    """Probabilities as 8 bits of their logarithm, from 1 to 1 / ``most``; 0 stands for none."""

    def __init__(self, most: float):
        self.least = min(-np.log10(most), -1e-9)
        self.logs = np.concatenate([[0.0], self.least * (1 - np.arange(255) / 254)])

    def of(self, logs: np.ndarray) -> np.ndarray:
        return (1 + np.clip(np.rint(254 * (1 - logs / self.least)), 0, 254)).astype(np.uint8)


# -- steps ---------------------------------------------------------------------------------------------


_MESSAGE = struct(("part", "bigint"), ("shard", "int"), ("level", "int"), ("data", "binary"))


def _parts(docs: DataFrame, shards: int, folder: str) -> DataFrame:
    """A row with the file of each part (shard -1), and one for each message of it to a shard of words."""
    arrow = arrow_schema(_MESSAGE)

    def emit(part: int, pieces: list, attempt: int) -> pa.RecordBatch:
        index = pa.concat_arrays([p[0] for p in pieces]).dictionary_encode()
        vocab, index = index.dictionary, index.indices.to_numpy()
        sizes, held = (np.concatenate([p[k] for p in pieces]) for k in (1, 3))
        often = np.argsort(-np.bincount(index, minlength=len(vocab)), kind="stable")  # frequent words have small numbers, which take less room
        place = np.empty(len(often), np.int64)
        place[often] = np.arange(len(often))
        own, vocab = place[index], vocab.take(pa.array(often))
        trained = np.bincount(own, np.repeat(~held, sizes), len(often)).astype(np.int64)
        shard = np.fromiter(map(zlib.crc32, vocab.to_pylist()), np.uint32, len(vocab)) % np.uint32(shards)
        ids = pa.RecordBatch.from_arrays([pa.concat_arrays([p[2] for p in pieces])], ["id"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, ids.schema) as out:
            out.write_batch(ids)
        end = place[int(index[sizes[0] - 1])]
        path = f"{folder}/part-{part}-{attempt}"
        fs, name = opened(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(name) as out:
            out.write(bundle(small(own), small(sizes), held.astype(np.uint8), small(shard), np.array([end]), np.frombuffer(sink.getvalue(), np.uint8)))
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        sent = vocab.take(pa.array(order))
        at, data = np.frombuffer(sent.buffers()[1], np.int32, len(sent) + 1), np.frombuffer(sent.buffers()[2] or b"", np.uint8)
        length, trained = small(np.diff(at)), small(trained[order])
        rows = [(s, bundle(data[at[a] : at[b]], length[a:b], trained[a:b])) for s, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if b > a]
        return batch_of(arrow, part=[part] * (len(rows) + 1), shard=[-1, *(s for s, _ in rows)], level=[0] + [1] * len(rows), data=[path.encode(), *(d for _, d in rows)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, pieces, size = TaskContext.get(), 0, [], 0
        for batch in slices(batches, "text", 2 << 20):
            found, sizes = tokens(raw(batch.column("text")).to_pylist())
            pieces.append((found, sizes, batch.column("id"), batch.column("held").to_numpy(zero_copy_only=False)))
            size += len(found)
            if size >= PART:
                yield emit(task.partitionId() << 32 | k, pieces, task.taskAttemptId())
                pieces, size, k = [], 0, k + 1
        if pieces:
            yield emit(task.partitionId() << 32 | k, pieces, task.taskAttemptId())

    return docs.mapInArrow(trimmed(run), _MESSAGE)


def _words(messages: DataFrame) -> DataFrame:
    """Answers of the word shards: each word's count, and its rank in the shard by that; to part -1 the shard's sums."""
    arrow = arrow_schema(_MESSAGE)

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, counts = [], []
        for data, length, n in map(unbundle, table.column("data").to_pylist()):
            at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            words.append(pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(data)]))
            counts.append(n)
        sizes = list(map(len, words))
        index = pa.chunked_array(words).combine_chunks().dictionary_encode().indices.to_numpy()
        n = np.bincount(index, np.concatenate(counts)).astype(np.int64)
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        out, at = [bundle(np.array([(n > 0).sum(), n.sum()], np.int64))], 0
        for size in sizes:
            k = index[at : at + size]
            at += size
            out.append(bundle(small(n[k]), small(np.where(n[k] > 0, rank[k], 0))))
        return pa.Table.from_batches([batch_of(arrow, part=[-1, *table.column("part").to_pylist()], shard=[shard] * len(out), level=[1] * len(out), data=out)])

    return messages.groupBy("shard").applyInArrow(run, _MESSAGE)


class Model:
    """What all tasks know: numbers of shards, tokens N and words V, the smoothing, and the most tokens of a context for one shard."""

    def __init__(self, shards: int, n: int, v: int, order: int, mu: Sequence[float]):
        self.shards, self.n, self.v, self.order, self._mu = shards, n, v, order, mu
        self.most = max(n / shards / SPREAD, 1.0)
        self.codes = Codes(n + v + 1 + max(mu))

    def mu(self, level: int) -> float:
        return self._mu[min(level - 2, len(self._mu) - 1)]


class Part:
    """A part's tokens, and what shards answered of its words and n-grams.

    ``logs`` has the logarithm of each token's probability up to the level reached; ``number`` and ``count`` are those
    of the n-gram of that level which ends there, 0 where there is none in training.
    """

    def __init__(self, model: Model, rows: pa.Table):
        self.model = model
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for shard, level, data in zip(*(rows.column(n).to_pylist() for n in ("shard", "level", "data")), strict=True):
            answers.setdefault(level, []).append((shard, data))
        fs, name = opened(answers[0][0][1].decode())
        with fs.open_input_file(name) as file:
            words, self.sizes, self.held, shard, end, ids = unbundle(file.read())
        with pa.ipc.open_stream(pa.py_buffer(ids)) as stream:
            self.ids = stream.read_all().column("id").combine_chunks()
        self.answers = {level: dict(some) for level, some in answers.items()}
        n, number = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(model.shards + 1))
        for s, data in self.answers[1].items():
            count, rank = unbundle(data)
            at = order[cuts[s] : cuts[s + 1]]
            n[at], number[at] = count, rank.astype(np.int64) * model.shards + s
        self.at = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.trained = np.repeat(self.held == 0, self.sizes)
        self.n, self.word = n[words], number[words]
        self.base = np.log10((n + 1) / (model.n + model.v + 1))[words]
        self.logs = self.base.copy()
        self.level, self.number, self.count = 1, self.word, self.n
        self.end = int(end[0])
        self.start = (int(number[self.end]), int(n[self.end]))

    def grams(self) -> None:
        """The different n-grams of the next level whose context and last word are in training, ordered as they are sent."""
        m, level = self.model, self.level + 1
        context, total = (np.concatenate([[0], x[:-1]]) for x in (self.number, self.count))
        if level == 2:
            context[self.at], total[self.at] = self.start
        else:  # no context goes beyond the document's start
            total[self.at] = 0
        known = total > 0
        lower = self.logs
        self.logs = np.where(known, lower + np.log10(m.mu(level) / (total + m.mu(level))), lower)
        spots = np.flatnonzero(known & (self.n > 0))
        total, second = total[spots], self.word[spots].astype(np.uint64)
        place, owner = np.divmod(context[spots], m.shards)
        ways = np.maximum(np.ceil(total / m.most), 1).astype(np.uint64)
        salt = np.where(ways > 1, mixed(second) % ways, np.uint64(0)).astype(np.int64)
        shard = (owner + salt) % m.shards
        first, index = distinct(keys(shard, salt, place, second))
        self.level, self.spots, self.index = level, spots, index
        self.sent = (shard[first], salt[first], place[first], second[first], total[first], m.codes.of(lower[spots[first]]))
        self.cuts = np.searchsorted(self.sent[0], np.arange(m.shards + 1))

    def messages(self) -> Iterator[tuple[int, bytes]]:
        n = np.bincount(self.index, self.trained[self.spots], len(self.sent[0])).astype(np.int64)
        for s in np.unique(self.sent[0]).tolist():
            a, b = self.cuts[s], self.cuts[s + 1]
            _, salt, place, second, total, lower = (x[a:b] for x in self.sent)
            new = _new(salt, place)
            step = np.diff(place, prepend=0)  # falls where the salt rises
            yield s, bundle(small(salt), step if salt.any() else small(step), small(second), small(n[a:b]), small(total[new]), lower)

    def answered(self) -> None:
        """Goes on to the level of ``grams``."""
        k = len(self.sent[0])
        code, place, count = np.zeros(k, np.uint8), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for s, data in self.answers.get(self.level, {}).items():
            a, b = self.cuts[s], self.cuts[s + 1]
            code[a:b], step, n = unbundle(data)
            if len(n):
                place[a:b], count[a:b] = np.cumsum(step, dtype=np.int64) * self.model.shards + s, n
        found = code[self.index]
        self.logs[self.spots] = np.where(found > 0, self.model.codes.logs[found], self.logs[self.spots])
        self.number, self.count = np.zeros(len(self.n), np.int64), np.zeros(len(self.n), np.int64)
        self.number[self.spots], self.count[self.spots] = place[self.index], count[self.index]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def _grams(answers: DataFrame, model: Model, level: int) -> DataFrame:
    """Messages of the parts to the shards of a level."""
    arrow = arrow_schema(_MESSAGE)

    def run(table: pa.Table) -> pa.Table:
        p = Part(model, table)
        for _ in range(2, level):
            p.grams()
            p.answered()
        p.grams()
        out = list(p.messages())
        return pa.Table.from_batches([batch_of(arrow, part=[table.column("part")[0].as_py()] * len(out), shard=[s for s, _ in out], level=[level] * len(out), data=[d for _, d in out])])

    return answers.groupBy("part").applyInArrow(run, _MESSAGE)


def _lookups(messages: DataFrame, model: Model, level: int, keep: bool) -> DataFrame:
    """Builds each shard's trie and answers with the code, place and count of every n-gram that was sent; to part -1 the trie, with ``keep``."""
    arrow = arrow_schema(_MESSAGE)

    def run(table: pa.Table) -> pa.Table:
        shard, mu, codes = table.column("shard")[0].as_py(), model.mu(level), model.codes
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        for data in table.column("data").to_pylist():
            salt, step, second, n, total, lower = unbundle(data)
            place = np.cumsum(step.astype(np.int64))
            for column, x in zip(columns, (salt, place, second, n, total[np.cumsum(_new(salt, place)) - 1], lower), strict=True):
                column.append(x)
        sizes = np.cumsum(list(map(len, columns[0])))
        salt, place, second, n, total, lower = map(np.concatenate, columns)
        del columns
        context = keys(salt, place)
        at, index = distinct(keys(context, second))
        n = np.bincount(index, n, len(at)).astype(np.int64)
        there = n > 0
        some = at[there]
        # Every part has the same code of the level below for an n-gram in training.
        value = (n[there] + mu * 10 ** codes.logs[np.maximum(lower[some], 1)]) / (total[some] + mu)
        block = Trie.build(context[some], second[some], codes.of(np.log10(np.minimum(value, 1.0))))
        asked = context[at], second[at].astype(np.uint64)
        del salt, place, second, total, lower, context
        with mmap.mmap(-1, len(block)) as mapped:
            mapped.write(block)
            trie = Trie.read(mapped)
            where = trie.find(*asked)
            code = np.where(where >= 0, trie.codes[np.maximum(where, 0)], 0).astype(np.uint8) if there.any() else np.zeros(len(at), np.uint8)
            del trie
        out, to = ([block], [-1]) if keep else ([], [])
        before = np.maximum(np.cumsum(there) - 1, 0)
        none = np.zeros(0, np.uint32)
        for a, b in zip([0, *sizes[:-1].tolist()], sizes.tolist(), strict=True):
            k = index[a:b]
            more = (small(np.diff(before[k], prepend=0)), small(n[k])) if level < model.order else (none, none)
            out.append(bundle(code[k], *more))
        parts = to + table.column("part").to_pylist()
        return pa.Table.from_batches([batch_of(arrow, part=parts, shard=[shard] * len(out), level=[level] * len(out), data=out)])

    return messages.groupBy("shard").applyInArrow(run, _MESSAGE)


def _scores(answers: DataFrame, model: Model, id_col: str, kind) -> DataFrame:
    schema = struct(
        (id_col, kind), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double"),
    )
    arrow = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        p = Part(model, table)
        for _ in range(2, model.order + 1):
            p.grams()
            p.answered()
        total = lambda x: np.add.reduceat(x, p.at)
        cols = {
            "held_out": p.held > 0, "n_tokens": p.sizes, "n_known": total((p.n > 0).astype(np.int64)), "train_tokens": np.full(len(p.at), model.n),
            "base_score": total(p.base), "score": np.minimum(total(p.logs), 0.0),
        }
        return pa.Table.from_batches([batch_of(arrow, **{id_col: p.ids}, **cols)])

    return answers.groupBy("part").applyInArrow(run, schema)


def scores(
    df: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, mu: Sequence[float] = MU, model_path: str | None = None, shard_bytes: int = SHARD
) -> DataFrame:
    """Trains on the documents where the condition ``held_out`` is false, and scores all.

    Columns: the id, ``held_out``, ``n_tokens`` (with the end), ``n_known`` (of them with a count in training),
    ``train_tokens``, ``base_score`` (log10 of the add-one unigram probability) and ``score`` (of the model's).
    With ``model_path`` the tries are written there as Parquet, a row for each shard and level.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    folder = shared_dir(df.sparkSession)
    size = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    docs = pick(df.withColumn(held := "_held_out_", F.coalesce(held_out, F.lit(True))), id=id_col, text=text_col, held=held)
    first = stored(_parts(docs, shards, f"{folder}/files"), "parts", folder)
    words = stored(_words(first.where("level = 1")), "words", folder)
    sums = [unbundle(r.data)[0] for r in words.where("part = -1").select("data").collect()]  # a row for each shard
    model = Model(shards, sum(int(x[1]) for x in sums), sum(int(x[0]) for x in sums), order, mu)
    answers = first.where("level = 0").union(words.where("part >= 0"))
    for level in range(2, order + 1):
        found = stored(_lookups(_grams(answers, model, level), model, level, model_path is not None), f"level-{level}", folder)
        if model_path:
            found.where("part = -1").select("level", "shard", F.col("data").alias("trie")).write.mode("overwrite" if level == 2 else "append").parquet(model_path)
        answers = answers.union(found.where("part >= 0"))
    return _scores(answers, model, id_col, field(docs, "id"))
