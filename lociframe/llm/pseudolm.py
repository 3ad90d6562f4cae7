"""Masked pseudo-likelihood with a bidirectional window network, trained in NumPy.

A document's score is the sum over its words of log p(word | the REACH words on either side). The network adds one
learned vector per neighbour and place, takes tanh, and predicts the word in two steps: its class, then the word within
the class, so a prediction costs CLASSES + MEMBERS products instead of one per vocabulary entry.

Vocabulary: the most frequent words of the whole corpus, as many as make up COVERAGE of its words (SIZE - TAIL at least,
where there are so many), in order of count, in rows whose number and length grow with the square root of the vocabulary;
words beyond it share TAIL entries by hash. A word of such an entry has the entry's probability times its own share of
the entry: its count plus UNSEEN, over the entry's count plus UNSEEN for each of its words and once more, which is left
for words that the corpus does not have. The shares come from a join of the documents' words beyond the vocabulary with the counts. Training: every task passes over its share of the corpus (every document, every word as a
target) from the same start, and the weights are averaged by the number
of targets, in two summing steps whose rows are bounded by the size of the model; ROUNDS passes are made. Spark counts,
trains and averages; the driver holds one vocabulary and one set of weights, which grow with the number of words that COVERAGE takes.

Defined results: null texts and texts without words have 0 words, log-probability 0 and a null mean; words beyond the
start or end of a document are a padding entry; equal counts order words by name; with no words in the corpus the start
weights are used; rows are scored one by one, so repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import PIECE_BYTES, pieces, text_function
from lociframe.llm.bytewords import BREAK, SPACE, Words, word_hashes, words_of
from lociframe.session import cut_lineage

REACH = 2
CLASSES, MEMBERS, TAIL = 32, 64, 64  # the least vocabulary; TAIL holds at every size
SIZE = CLASSES * MEMBERS
COVERAGE, UNSEEN = 0.75, 0.5
HIDDEN = 16
BATCH, RATE, ROUNDS = 8192, 0.3, 1
ROWS = 1024  # targets whose logits are held at a time
SAFE = 40  # logits of this size, their exponentials and the inverse of a sum of those stay far from the bounds of 32 bits
BLOCK = 1 << 14  # numbers in a row of weights
SALTS = 16
COUNTED = 4 * PIECE_BYTES
PARTS = "n_words long, log_prob double, tail array<long>"


@dataclass
class Vocabulary:
    """Sorted hashes of the known words and the entry of each. The last TAIL entries are for all others."""

    hashes: np.ndarray
    entry: np.ndarray
    shape: tuple[int, int] = field(default=(CLASSES, MEMBERS))

    @property
    def first_tail(self) -> int:
        return self.shape[0] * self.shape[1] - TAIL

    def entries(self, w: Words) -> np.ndarray:
        return self.entries_of(word_hashes(w))

    def entries_of(self, hashes: np.ndarray) -> np.ndarray:
        other = self.first_tail + tail_entry(hashes)
        if not len(self.hashes):
            return other
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.entry[at], other)


def tail_entry(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(TAIL)).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`word`, `n` over all texts. The words of COUNTED bytes of text are counted where they are read, and the counts summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(0), COUNTED):
                counted = pc.value_counts(word_strings(words_of(piece)))
                yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], ["word", "n"])

    words = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def word_strings(w: Words) -> pa.Array:
    """The words as strings."""
    inside = (w.stream[: len(w.stream) - 8] != SPACE) & (w.stream[: len(w.stream) - 8] != BREAK)
    bounds = np.concatenate([[0], np.cumsum(w.end - w.start)])
    data = pa.py_buffer(w.stream[: len(w.stream) - 8][inside])
    return pa.LargeStringArray.from_buffers(len(w.start), pa.py_buffer(bounds.astype(np.int64)), data).cast(pa.string())


def shape_for(n_words: int) -> tuple[int, int]:
    """Classes and members for so many words and TAIL more: about equal numbers, the least shape at least."""
    if n_words + TAIL <= SIZE:
        return CLASSES, MEMBERS
    members = 1 << int(np.ceil(np.log2(n_words + TAIL) / 2))
    return -(-(n_words + TAIL) // members), members


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the share of each entry in the corpus (smoothed)."""
    by_count = sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)  # few: at most the root of twice all words
    total = sum(r.n * r.words for r in by_count)
    size, got, least = 0, 0, 1
    for r in by_count:
        if size >= SIZE - TAIL and got >= COVERAGE * total:
            break
        wanted = max(SIZE - TAIL - size, -int(-(COVERAGE * total - got) // r.n))
        size, got, least = size + min(r.words, wanted), got + r.n * min(r.words, wanted), r.n
    top = counts.where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(size).collect() if size else []
    hashes = word_hashes(words_of(pa.array([r.word for r in top], pa.string())))
    order = np.argsort(hashes)
    shape = shape_for(len(top))
    shares = np.ones(shape[0] * shape[1])
    shares[: len(top)] += [r.n for r in top]
    shares[-TAIL:] += (total - sum(r.n for r in top)) / TAIL
    return Vocabulary(hashes[order], order.astype(np.int64), shape), shares / shares.sum()


class Network:
    """Weights: `side` (place, entry or padding, hidden), `bias`, class weights and biases, member weights and biases."""

    @staticmethod
    def shapes(classes: int, members: int) -> tuple[tuple[int, ...], ...]:
        return (2 * REACH, classes * members + 1, HIDDEN), (HIDDEN,), (HIDDEN, classes), (classes,), (classes, HIDDEN, members), (classes, members)

    SHAPES = shapes(CLASSES, MEMBERS)

    def __init__(self, flat: np.ndarray, shape: tuple[int, int] = (CLASSES, MEMBERS)):
        self.classes, self.members = shape
        shapes = self.shapes(*shape)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        parts = np.split(flat.astype(np.float32), cuts[:-1])
        self.weights = [p.reshape(s).copy() for p, s in zip(parts, shapes, strict=True)]
        # one table of weights and biases each; `weights` holds views of them
        self.class_table, self.member_table = [np.concatenate([self.weights[k], self.weights[k + 1][..., None, :]], axis=-2) for k in (2, 4)]
        for k, both in ((2, self.class_table), (4, self.member_table)):
            self.weights[k], self.weights[k + 1] = both[..., :HIDDEN, :], both[..., HIDDEN, :]
        self.seen = [np.full(shape, 1e-2, np.float32) for shape in (shapes[0][:2], self.class_table.shape, self.member_table.shape, shapes[1])]

    @classmethod
    def fresh(cls, shares: np.ndarray, shape: tuple[int, int] = (CLASSES, MEMBERS)) -> Network:
        """Small random vectors; biases that give every entry its share."""
        rng = np.random.default_rng(11)
        own = cls(rng.normal(0, 0.1, sum(int(np.prod(s)) for s in cls.shapes(*shape))), shape)
        table = shares.reshape(shape)
        own.weights[1][:] = 0
        own.weights[3][:] = np.log(table.sum(1))
        own.weights[5][:] = np.log(table / table.sum(1, keepdims=True))
        return own

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """One row per target: the hidden values and a 1, which meets the biases."""
        side, bias = self.weights[:2]
        total = np.take(side[0], around[:, 0], axis=0)
        for place in range(1, 2 * REACH):
            total += np.take(side[place], around[:, place], axis=0)
        total += bias
        out = np.ones((len(around), HIDDEN + 1), np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, int]]]]:
        """Targets in order of class: that order, their classes and members, and for each ROWS of them the runs
        (class, start, end) of one class."""
        kind, member = np.divmod(target, self.members)
        order = stable_order(kind, self.classes)
        kind, member = kind[order], member[order]
        blocks = []
        for start in range(0, len(kind), ROWS):
            own = kind[start : start + ROWS]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]) + start
            blocks.append(list(zip(own[cuts[:-1] - start].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)))
        return order, kind, member, blocks

    def _safe(self) -> list[bool]:
        """Whether no logit can go beyond SAFE, of classes and of members."""
        return [bool(np.abs(table).sum(axis=-2).max() <= SAFE) for table in (self.class_table, self.member_table)]

    def _logits(self, h: np.ndarray, block: list[tuple[int, int, int]], safe: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Of the targets of a block, for the classes and for the members of their own class; less the largest of each
        where that is not `safe`."""
        first, last = block[0][1], block[-1][2]
        for_class = h[first:last] @ self.class_table
        for_member = np.empty((last - first, self.members), np.float32)
        for k, a, b in block:
            np.matmul(h[a:b], self.member_table[k], out=for_member[a - first : b - first])
        for x, is_safe in zip((for_class, for_member), safe, strict=True):
            if not is_safe:
                x -= x.max(axis=1, keepdims=True)
        return for_class, for_member

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order, kind, member, blocks = self.by_class(target)
        h, safe = self.hidden(around[order]), self._safe()
        out = np.zeros(len(target))
        for block in blocks:
            first, last = block[0][1], block[-1][2]
            for x, pick in zip(self._logits(h, block, safe), (kind, member), strict=True):
                own = x[np.arange(last - first), pick[first:last]]
                np.exp(x, out=x)
                out[order[first:last]] += own - np.log(row_sums(x))
        return out

    def _move(self, weights: np.ndarray, seen: np.ndarray, grad: np.ndarray) -> None:
        """Adagrad."""
        seen += grad * grad
        weights -= RATE * grad / np.sqrt(seen)

    def learn(self, around: np.ndarray, target: np.ndarray) -> None:
        """One step on a batch, by the mean gradient.

        A gradient of logits is (e - s at the target) / s / n, with e = exp(logits) and s their sum; the division is done
        on the narrow side of each product.
        """
        n = len(target)
        order, kind, member, blocks = self.by_class(target)
        around = around[order]
        h, safe = self.hidden(around), self._safe()
        back = np.empty((n, HIDDEN), np.float32)
        class_grad, member_grad = np.zeros_like(self.class_table), np.zeros_like(self.member_table)
        for block in blocks:
            first, last = block[0][1], block[-1][2]
            scaled = []
            for x, pick in zip(logits := self._logits(h, block, safe), (kind, member), strict=True):
                np.exp(x, out=x)
                sums = row_sums(x)
                x[np.arange(last - first), pick[first:last]] -= sums
                scaled.append((1 / (sums * n))[:, None])
            by_kind, by_member = [h[first:last] * s for s in scaled]
            class_grad += by_kind.T @ logits[0]
            back[first:last] = (logits[0] @ self.class_table[:HIDDEN].T) * scaled[0]
            inner = np.empty((last - first, HIDDEN), np.float32)
            for k, a, b in block:
                own = logits[1][a - first : b - first]
                member_grad[k] += by_member[a - first : b - first].T @ own
                np.matmul(own, self.member_table[k, :HIDDEN].T, out=inner[a - first : b - first])
            back[first:last] += inner * scaled[1]
        back *= 1 - h[:, :HIDDEN] ** 2
        self._move(self.class_table, self.seen[1], class_grad)
        self._move(self.member_table, self.seen[2], member_grad)
        self._move(self.weights[1], self.seen[3], back.sum(0))
        for place in range(2 * REACH):
            order = stable_order(around[:, place], self.classes * self.members + 1)
            entries = around[order, place]
            starts = np.flatnonzero(np.diff(entries, prepend=-1))
            entries = entries[starts]
            grad = np.add.reduceat(np.take(back, order, axis=0), starts, axis=0)
            seen = self.seen[0][place, entries] + np.einsum("ij,ij->i", grad, grad) / HIDDEN
            self.seen[0][place, entries] = seen
            self.weights[0][place, entries] -= grad * (RATE / np.sqrt(seen))[:, None]


def stable_order(values: np.ndarray, bound: int) -> np.ndarray:
    """Order of whole numbers from 0 to `bound` - 1; 16-bit ones are sorted by digits."""
    return np.argsort(values.astype(np.uint16) if bound <= 1 << 16 else values, kind="stable")


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def neighbours(w: Words, entries: np.ndarray, padding: int = SIZE) -> np.ndarray:
    """Entries of the words around each word; `padding` beyond its document."""
    n = len(entries)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    out = np.full((n, 2 * REACH), padding, np.int64)
    for place, step in enumerate([*range(-REACH, 0), *range(1, REACH + 1)]):
        a, b = max(0, -step), min(n, n - step)
        if b > a:
            same = doc[a:b] == doc[a + step : b + step]
            out[a:b, place] = np.where(same, entries[a + step : b + step], padding)
    return out


def targets(w: Words, entries: np.ndarray) -> np.ndarray:
    """Words that the network is to predict in training: all."""
    return np.arange(len(entries))


def _train_task(words: Vocabulary, start: np.ndarray):
    """Rows of weights, times the number of targets, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, done = Network(start, words.shape), 0
        for batch in batches:
            for piece in pieces(batch.column(0)):
                w = words_of(piece)
                entries = words.entries(w)
                at = targets(w, entries)
                around = neighbours(w, entries, words.first_tail + TAIL)[at]
                order = np.random.default_rng(len(at)).permutation(len(at))
                for k in range(0, len(order), BATCH):
                    own = order[k : k + BATCH]
                    net.learn(around[own], entries[at[own]])
                done += len(at)
        if done:
            yield _weight_rows(net.flat().astype(np.float64) * done, done)

    return run


def _weight_rows(flat: np.ndarray, n: float) -> pa.RecordBatch:
    parts = [flat[k : k + BLOCK].astype(np.float32).tobytes() for k in range(0, len(flat), BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(n)] * len(parts)), pa.array(parts, pa.binary())], ["block", "n", "part"])


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the parts and numbers of each block; holds one sum per block that the task has."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, n, part in zip(*[c.to_pylist() for c in batch.select(["block", "n", "part"]).columns], strict=True):
            own = sums.setdefault(block, [0.0, 0.0])
            own[0] += n
            own[1] = own[1] + np.frombuffer(part, np.float32).astype(np.float64)
    keys = sorted(sums)
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k][0] for k in keys]), pa.array([sums[k][1].astype(np.float32).tobytes() for k in keys], pa.binary())], ["block", "n", "part"])


def train(docs: DataFrame, words: Vocabulary, shares: np.ndarray, text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Weights after `rounds` passes over all documents."""
    flat = Network.fresh(shares, words.shape).flat()
    schema = "block int, n double, part binary"
    texts = docs.select(F.col(text_col).alias("text"))
    for _ in range(rounds):
        rows = texts.mapInArrow(_train_task(words, flat), schema).withColumn("salt", F.spark_partition_id() % SALTS)
        some = rows.repartition("block", "salt").drop("salt").mapInArrow(_sum_rows, schema)
        done = sorted(some.repartition("block").mapInArrow(_sum_rows, schema).collect())  # as many rows as the model has blocks
        if done:
            flat = np.concatenate([np.frombuffer(r.part, np.float32) / r.n for r in done]).astype(np.float32)
    return flat


def score_column(text: Column, words: Vocabulary, flat: np.ndarray) -> Column:
    """Struct of PARTS: the log-probability of the words' entries, and the hashes of the words beyond the vocabulary."""

    def make():
        net = Network(flat, words.shape)

        def run(texts: pa.Array) -> pa.Array:
            w = words_of(texts)
            hashes = word_hashes(w)
            entries = words.entries_of(hashes)
            around = neighbours(w, entries, words.first_tail + TAIL)
            logs = [net.log_probs(around[k : k + BATCH], entries[k : k + BATCH]) for k in range(0, len(entries), BATCH)]
            total = np.concatenate([[0.0], np.cumsum(np.concatenate(logs))]) if logs else np.zeros(1)
            beyond = entries >= words.first_tail
            before = np.concatenate([[0], np.cumsum(beyond)])
            tail = pa.ListArray.from_arrays(pa.array(before[w.first], pa.int32()), pa.array(hashes[beyond].view(np.int64)))
            return pa.StructArray.from_arrays([pa.array(np.diff(w.first), pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]]), tail], ["n_words", "log_prob", "tail"])

        return run

    return text_function(make, PARTS)(text)


def tail_shares(counts: DataFrame, words: Vocabulary) -> DataFrame:
    """`hash` and `log_share` of the counted words beyond the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column(0))
            own = words.entries(w) - words.first_tail
            rest = own >= 0
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(w)[rest].view(np.int64)), pa.array(own[rest].astype(np.int32)), batch.column(1).filter(pa.array(rest))], ["hash", "entry", "n"])

    tail = counts.select("word", "n").mapInArrow(run, "hash long, entry int, n long")
    sums = {r.entry: (r.t, r.d) for r in tail.groupBy("entry").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("d")).collect()}
    whole = [sums.get(k, (0, 0)) for k in range(TAIL)]
    logs = F.array(*[F.lit(float(np.log(t + UNSEEN * (d + 1)))) for t, d in whole])
    return tail.select("hash", (F.log(F.col("n") + UNSEEN) - F.get(logs, F.col("entry"))).alias("log_share"))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: its id, n_words, log_prob, mean_log_prob."""
    counts = cut_lineage(word_counts(docs, text_col))
    words, shares = vocabulary(counts)
    flat = train(docs, words, shares, text_col, rounds)
    found = cut_lineage(docs.select(F.col(id_col).alias("id"), score_column(F.col(text_col), words, flat).alias("r"), F.monotonically_increasing_id().alias("row")).select("id", "row", "r.*"))
    # every word was counted, so each has its share
    own = found.select("row", F.explode("tail").alias("hash")).join(tail_shares(counts, words), "hash").groupBy("row").agg(F.sum("log_share").alias("own"))
    log_prob = F.col("log_prob") + F.coalesce("own", F.lit(0.0))
    whole = found.select("id", "row", "n_words", "log_prob").join(own, "row", "left")
    return whole.select(F.col("id").alias(id_col), "n_words", log_prob.alias("log_prob"), F.when(F.col("n_words") > 0, log_prob / F.col("n_words")).alias("mean_log_prob"))
