"""Benchmark decontamination: multi-pattern search of benchmark windows in whole documents.

Wu and Manber's method over bytes. Patterns are windows of ten words in normal form. A shift table over blocks of up to
eight bytes says how far a search position may move, a suffix-hash bucket lists the patterns that may end at a block
with shift zero, their first bytes are compared, and a direct comparison with the words on both sides confirms.

Many positions of a piece of text move at once, each over its own stretch, so the loop runs in NumPy.

Defined results: null or empty texts have no words and are not contaminated; benchmark rows without words are ignored;
equal windows of several items count for each of them; an item_id that is null contaminates but is neither counted nor
listed; an empty benchmark marks nothing; rows of documents are judged one by one, so repeated rows repeat.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import packed, text_function
from lociframe.llm.bytewords import Words, normalise, words_of

WINDOW_WORDS = 10
#: Bytes of benchmark text whose tables are broadcast together; a longer benchmark is searched in as many passes.
SLICE_BYTES = 512 << 10
RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LEAD = 256  # bytes of a pattern that shifts look at
_LENGTHS = (1, 8, 24)  # patterns are searched apart by least length, so that a short one does not shorten all shifts


@dataclass
class Group:
    """Tables of the patterns of about one length. `shortest`: m; `block`: B bytes; `suffix`: sorted hashes of the last
    block of the first m bytes, `pattern`: the pattern of each."""

    shortest: int
    block: int
    bits: int
    shift: np.ndarray
    suffix: np.ndarray
    pattern: np.ndarray
    front: np.ndarray


@dataclass
class Patterns:
    """`texts`: distinct windows; `n_words` of each; `items`: the item ids (None left out) of each."""

    texts: list[bytes]
    n_words: np.ndarray
    items: list[list[str]]
    groups: list[Group]


def item_windows(text: str | None, size: int = WINDOW_WORDS) -> list[bytes]:
    words = normalise(text or "").split(b" ")
    if words == [b""]:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def _blocks(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes at each place as a number; `data` has eight bytes more than the largest place."""
    view = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    got = view[at].astype(np.uint64)
    return got if width == 8 else got & np.uint64((1 << (8 * width)) - 1)


def _group(texts: list[bytes], members: np.ndarray) -> Group:
    lengths = np.array([len(texts[i]) for i in members])
    m = min(_LEAD, int(lengths.min()))
    block = min(8, m)
    blob = np.frombuffer(b"".join(texts[i] for i in members) + bytes(8), np.uint8)
    base = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    spots = m - block + 1
    bits = min(22, max(12, int(np.ceil(np.log2(8 * len(members) * spots)))))
    at = base[:, None] + np.arange(spots)
    hashes = (_blocks(blob, at.ravel(), block) * _SPREAD) >> np.uint64(64 - bits)
    shift = np.full(1 << bits, spots, np.uint16)
    np.minimum.at(shift, hashes, np.tile(spots - 1 - np.arange(spots), len(members)).astype(np.uint16))
    last = hashes.reshape(len(members), spots)[:, -1]
    order = np.argsort(last, kind="stable")
    return Group(m, block, bits, shift, last[order], members[order], _blocks(blob, base, block)[order])


def compile_patterns(items: list[tuple[object, str | None]], size: int = WINDOW_WORDS) -> Patterns:
    owners: dict[bytes, set] = {}
    for item, text in items:
        for window in item_windows(text, size):
            owners.setdefault(window, set()).add(item)
    texts = sorted(owners)
    lengths = np.array([len(t) for t in texts], np.int64)
    groups = []
    for low, high in zip(_LENGTHS, [*_LENGTHS[1:], np.inf], strict=True):
        members = np.flatnonzero((lengths >= low) & (lengths < high))
        if len(members):
            groups.append(_group(texts, members))
    return Patterns(texts, np.array([t.count(b" ") + 1 for t in texts], np.int64), [sorted(str(x) for x in owners[t] if x is not None) for t in texts], groups)


def occurrences(w: Words, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Places in the stream where a pattern stands between word bounds, and the pattern."""
    stream, n = w.stream, len(w.stream) - 8
    raw = stream.tobytes()
    places, kinds = [], []
    for g in patterns.groups:
        ends = n - g.shortest + 1  # window starts are below this
        if ends <= 0:
            continue
        lanes = max(1, min(4096, ends // 64))
        at = np.linspace(0, ends, lanes + 1).astype(np.int64)
        stop, at, back = at[1:], at[:-1], g.shortest - g.block
        zero = []
        while len(at):
            step = g.shift[(_blocks(stream, at + back, g.block) * _SPREAD) >> np.uint64(64 - g.bits)].astype(np.int64)
            zero.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        at = np.concatenate(zero)
        key = (_blocks(stream, at + back, g.block) * _SPREAD) >> np.uint64(64 - g.bits)
        low, high = np.searchsorted(g.suffix, key), np.searchsorted(g.suffix, key, side="right")
        many = high - low
        at, low = np.repeat(at, many), np.repeat(low, many)
        member = low + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        same = _blocks(stream, at, g.block) == g.front[member]
        for p, k in zip(at[same].tolist(), g.pattern[member[same]].tolist(), strict=True):
            text = patterns.texts[k]
            if raw[p - 1] in b" \n" and raw[p + len(text)] in b" \n" and raw.startswith(text, p):
                places.append(p)
                kinds.append(k)
    return np.array(places, np.int64), np.array(kinds, np.int64)


def scan(texts: pa.Array, passes: list[Patterns]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Per text: number of words, number of words inside an occurrence, and the items found."""
    w = words_of(texts)
    n = len(texts)
    change = np.zeros(len(w.start) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(n)]
    for patterns in passes:
        places, kinds = occurrences(w, patterns)
        word = np.searchsorted(w.start, places)
        np.add.at(change, word, 1)
        np.add.at(change, word + patterns.n_words[kinds], -1)
        for doc, k in zip(w.text_of(word).tolist(), kinds.tolist(), strict=True):
            found[doc].update(patterns.items[k])
    hit = np.concatenate([[0], np.cumsum(np.cumsum(change[:-1]) > 0)])
    return np.diff(w.first), hit[w.first[1:]] - hit[w.first[:-1]], found


def load_passes(benchmark: DataFrame, item_col: str, text_col: str, size: int, slice_bytes: int = SLICE_BYTES) -> list:
    """Broadcast tables of the benchmark, one for each slice of at most about `slice_bytes` of text."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // slice_bytes)
    part = F.pmod(F.xxhash64("item", "text"), F.lit(max(n, 1)))
    return [
        spark.sparkContext.broadcast(compile_patterns([tuple(r) for r in rows.where(part == k).collect()], size))
        for k in range(n)
    ]


def hit_columns(text: Column, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW_WORDS) -> Column:
    """Struct of RESULT for a text column."""
    shared = load_passes(benchmark, item_col, text_col, size)

    def make():
        passes = [b.value for b in shared]

        def run(texts: pa.Array) -> pa.Array:
            words, hits, found = scan(texts, passes)
            return pa.StructArray.from_arrays(
                [
                    pa.array(words, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found], pa.string()),
                    pa.array(hits > 0),
                ],
                ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

        return run

    return text_function(make, RESULT, 4 << 20)(text)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and RESULT."""
    return docs.select(F.col(id_col), hit_columns(F.col(text_col), benchmark).alias("r")).select(id_col, "r.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a benchmark window, with their columns."""
    kept = packed(docs, hit_columns(F.col(text_col), benchmark).alias("r"))
    return kept.where(~F.col("r.contaminated")).select("doc.*")
