"""Secret scans with DataFrame functions only.

Base kinds are the leftmost non-overlapping matches of a pattern, filtered by length afterwards. The method's own kind,
`entropy`, looks at candidate strings (long runs of key characters): a window of WINDOW characters slides over each,
and the counts of its characters change by the one that leaves and the one that enters, so that the sum of c*log2(c)
is carried from window to window. The sum is kept in fixed point, so it is exact and has no drift. Each character class
has its own threshold: `hex` for candidates of hexadecimal digits, `mixed` for all others. A candidate that an
allow-list pattern covers is no secret. A span runs from its first to its last window above the threshold.

Places are found without searching again: the gaps between matches come from a split by the same pattern, and places
are running sums of lengths, in code points.

Defined results: null and empty texts have no spans; an entropy span may lie over a base span, and both are listed;
rows are scanned one by one, so repeated rows repeat; very long texts and candidates cost time in proportion to their
length.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import packed

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX, CANDIDATE = r"AKIA[A-Z0-9]+", r"[0-9a-f]{32,}", r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Bits a character that a window must reach, by character class.
THRESHOLDS = {"hex": 2.9, "mixed": 3.75}
HEX_CLASS = r"\A[0-9A-Fa-f]+\z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Candidates that are no secrets: words, snake, kebab and path forms of words, numbers, UUIDs, published examples.
ALLOWED = (
    r"\A[A-Z]?[a-z]+\z",
    r"\A[A-Z]+\z",
    r"\A[/_=+-]?(?:(?:[A-Z]?[a-z]+|[A-Z]+)[/_=+-]+)+(?:[A-Z]?[a-z]+|[A-Z]+)?\z",
    r"\A[0-9/_=+-]+\z",
    r"\A[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}\z",
    r"EXAMPLE",
)
_POINT = 1 << 32
TERMS = [round(c * math.log2(c) * _POINT) if c else 0 for c in range(WINDOW + 1)]
#: Largest sum of terms at which a window reaches the threshold of its class.
LIMITS = {k: round((math.log2(WINDOW) - bits) * WINDOW * _POINT) for k, bits in THRESHOLDS.items()}
MASK = "[SECRET]"
BLOCK = 128  # elements that a running fold takes at once
STRETCH = 1024  # code points of a piece of a text that is masked

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _no_spans() -> Column:
    return F.array().cast(_SPAN)


def _let(value: Column, fn) -> Column:
    """`fn` of a value that is computed once; a plain expression inside a lambda runs again for every element."""
    return F.get(F.transform(F.array(value), fn), 0)


def running(values: Column, zero: Column, combine) -> Column:
    """What `combine` makes of all elements in front of each element, `zero` for the first.

    A fold that appends to its result copies it at every step, so only blocks of BLOCK elements are folded that way.
    """

    def fold(items, start):
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, begin, step, lambda acc: acc["out"])

    def of(v):
        numbers = F.filter(F.sequence(F.lit(0), F.floor(F.size(v) / BLOCK).cast("int")), lambda k: k * BLOCK < F.size(v))
        blocks = F.transform(numbers, lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        whole = lambda bs: fold(F.transform(bs, lambda b: F.aggregate(b, zero, combine)), zero)
        return _let(blocks, lambda bs: _let(whole(bs), lambda offsets: F.flatten(F.transform(bs, lambda b, k: fold(b, F.get(offsets, k))))))

    return _let(values, of)


def _placed(text: Column, pattern: str) -> Column:
    """start, match for every leftmost non-overlapping match."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.zip_with(found, gaps, lambda m, gap: F.struct(m.alias("match"), gap.alias("gap")))
    # The last gap has no match behind it.
    rows = F.filter(rows, lambda r: r["match"].isNotNull())

    def place(rs):
        sizes = F.transform(rs, lambda r: r["gap"] + F.length(r["match"]))
        starts = running(sizes, F.lit(0), lambda at, size: at + size)
        return F.zip_with(rs, starts, lambda r, at: F.struct((at + r["gap"]).alias("start"), r["match"].alias("match")))

    return _let(rows, place)


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def _base_spans(text: Column, kind: int, guard: Column, pattern: str, keep) -> Column:
    spans = F.transform(F.filter(_placed(text, pattern), lambda m: keep(m["match"])), lambda m: _span(m["start"], kind, m["start"] + F.length(m["match"])))
    return F.when(guard, spans).otherwise(_no_spans())


def hot_windows(candidate: Column) -> Column:
    """first, last: numbers (from 0) of the first and last window above the threshold; null without one."""
    chars = F.split(candidate, "")
    limit = F.when(candidate.rlike(HEX_CLASS), F.lit(LIMITS["hex"])).otherwise(F.lit(LIMITS["mixed"])).cast("long")
    terms = F.array(*[F.lit(t).cast("long") for t in TERMS])
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0).cast("long").alias("total"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    slots = F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    # Each character next to the one that leaves when it enters.
    late = lambda s: F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), s), F.lit(1), F.size(s))
    pairs = lambda s: F.zip_with(s, late(s), lambda come, go: F.struct(come.alias("come"), go.alias("go")))
    steps = F.transform(_let(slots, pairs), lambda p, i: F.struct(p["come"].alias("come"), p["go"].alias("go"), i.alias("i")))

    def watch(acc, x):
        come, go = x["come"], x["go"]
        leaving, same = F.get(acc["counts"], go), F.when(come == go, 1).otherwise(0)
        entering = F.get(acc["counts"], come) - same
        lost = F.when(go >= 0, F.get(terms, leaving) - F.get(terms, leaving - 1)).otherwise(F.lit(0).cast("long"))
        total = acc["total"] - lost + F.get(terms, entering + 1) - F.get(terms, entering)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when(k == go, 1).otherwise(0))
        at = x["i"] - (WINDOW - 1)
        hot = (at >= 0) & (total <= limit)
        return F.struct(counts.alias("counts"), total.alias("total"), F.when(hot & acc["first"].isNull(), at).otherwise(acc["first"]).alias("first"), F.when(hot, at).otherwise(acc["last"]).alias("last"))

    return F.aggregate(steps, start, watch, lambda acc: F.when(acc["first"].isNotNull(), F.struct(acc["first"].alias("first"), acc["last"].alias("last"))))


def _entropy_spans(text: Column) -> Column:
    allowed = lambda m: reduce(lambda a, b: a | b, [m.rlike(p) for p in ALLOWED])
    candidates = F.filter(_placed(text, CANDIDATE), lambda m: ~allowed(m["match"]))
    seen = F.transform(candidates, lambda m: F.struct(m["start"].alias("start"), hot_windows(m["match"]).alias("hot")))
    spans = F.transform(F.filter(seen, lambda s: s["hot"].isNotNull()), lambda s: _span(s["start"] + s["hot"]["first"], 3, s["start"] + s["hot"]["last"] + WINDOW))
    return F.when(text.rlike(CANDIDATE), spans).otherwise(_no_spans())


def span_column(text: Column) -> Column:
    """All spans of a text (start, kind number, end) by start, then kind; places in code points, ends exclusive."""
    text = F.coalesce(text, F.lit(""))
    value = lambda m: F.length(F.regexp_extract(m, r"\A" + ASSIGN, 2)) >= 8
    return F.array_sort(
        F.concat(
            _base_spans(text, 0, text.rlike(ASSIGN), ASSIGN, value),
            _base_spans(text, 1, F.contains(text, F.lit("AKIA")), ACCESS, lambda m: F.length(m) >= 16),
            _base_spans(text, 2, text.rlike(HEX), HEX, lambda m: F.length(m) >= 32),
            _entropy_spans(text),
        )
    )


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = docs.select(F.col(id_col).alias("id"), span_column(F.col(text_col)).alias("spans"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """`text` with every stretch that spans cover replaced by MASK; overlapping and touching spans are one stretch.

    The text is cut into pieces of STRETCH code points, so that taking a part of it does not read it from its start.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % STRETCH), F.lit(0))
    number = lambda at: F.floor(at / STRETCH).cast("int")

    def between(cuts, a, b):
        held = F.slice(cuts, number(a) + 1, number(b) - number(a) + 1)
        return F.substring(F.array_join(held, ""), a - number(a) * STRETCH + 1, b - a)

    def kept(cuts):
        before = running(F.transform(spans, lambda s: s["end"]), F.lit(-1), lambda at, end: F.greatest(at, end))
        reached = F.zip_with(spans, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start")))
        begins = F.filter(reached, lambda r: r["start"] > r["at"])
        parts = F.transform(begins, lambda r: F.concat(between(cuts, F.greatest(r["at"], F.lit(0)), r["start"]), F.lit(MASK)))
        return F.concat(F.array_join(parts, ""), between(cuts, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    return F.when(F.size(spans) > 0, _let(pieces, kept)).otherwise(text)


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with their secrets masked; `length_col`, if there is one, follows the new text."""
    found = packed(docs, span_column(F.col(text_col)).alias("spans"))
    clean = found.select("doc", masked(F.col(f"doc.{text_col}"), F.col("spans")).alias("clean"), (F.size("spans") > 0).alias("hit"))
    columns = []
    for name, kind in docs.dtypes:
        own = F.col(f"doc.`{name}`")
        if name == text_col:
            own = F.col("clean")
        elif name == length_col:
            own = F.when(F.col("hit"), F.length("clean").cast(kind)).otherwise(own)
        columns.append(own.alias(name))
    return clean.select(*columns)
