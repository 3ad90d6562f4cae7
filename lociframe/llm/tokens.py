"""Token counts by offset-mapped attribution.

A document is encoded once, whole, with a byte-level BPE vocabulary. The bytes of the tokens in a row give every token's
span; spans are joined with the spans of sections by binary search over both sorted lists. A token inside one section is
that section's; a token that crosses a bound goes by a stated rule:

`most`   to the section with the most of its bytes, the first on a tie
`first`  to the section with its first byte
`last`   to the section with its last byte

Every token goes to one section, so the sections' counts add up to the document's.

Sections are stretches between bounds: for texts, the lines (each with its line feed), a line's kind being `blank`,
`heading` (the first line that is not blank, if more follow) or `body`.

Defined results: null and empty texts have no tokens and no sections; lines end with a line feed only; rows are counted
one by one, so repeated rows repeat. A run of more than RUN white-space characters, which the splitting pattern's engine
has no stack for, is given to the merges as the one piece that the pattern makes of it: the tokens are the same.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import text_function

#: The vocabulary file (token in base64 and rank on each line), present on every machine; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that this vocabulary was made with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RUN = 500_000
RULES = ("most", "first", "last")
SECTIONS = "array<struct<section:int,kind:string,start:long,end:long,n_tokens:long,n_crossing:long>>"


class Encoder:
    """Token ids of a whole text and the length of each token in bytes."""

    def __init__(self, path: str = VOCABULARY, run: int = RUN):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        # White space as the pattern knows it: Python also counts the separators 1C to 1F.
        self.long = re.compile(r"[^\S\x1c-\x1f]{%d,}" % run)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _parts(self, text: str):
        """Stretches of the text with whether each is one piece. The last white space before a word goes to the word."""
        at = 0
        for run in self.long.finditer(text):
            end = run.end() - (run.end() < len(text))
            yield text[at : run.start()], False
            yield text[run.start() : end], True
            at = end
        yield text[at:], False

    def __call__(self, text: str) -> np.ndarray:
        parts = [
            np.asarray(self.encoding._encode_single_piece(p), np.int64) if whole
            else self.encoding.encode_to_numpy(p, disallowed_special=()).astype(np.int64)
            for p, whole in self._parts(text) if p
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses a bound. `ends`: ends of the tokens, `bounds`: starts of all
    sections but the first; both sorted, in bytes. Token and section lists cover the same bytes."""
    starts = np.concatenate([[0], ends[:-1]])
    low = np.searchsorted(bounds, starts, side="right")
    high = np.searchsorted(bounds, ends, side="left")
    section = {"first": low, "last": high, "most": low.copy()}[rule]
    if rule == "most":
        edges = np.concatenate([[0], bounds, [ends[-1] if len(ends) else 0]])
        for i in np.flatnonzero(high > low).tolist():
            own = np.arange(low[i], high[i] + 1)
            share = np.minimum(edges[own + 1], ends[i]) - np.maximum(edges[own], starts[i])
            section[i] = own[np.argmax(share)]
    return section, high > low


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Starts of all lines but the first."""
    starts = np.flatnonzero(data == 10) + 1
    return starts[starts < len(data)]


def count(text: str, encode: Encoder, rule: str) -> list[dict]:
    """Sections of a text; places in code points."""
    if not text:
        return []
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    bounds = line_bounds(data)
    ends = np.cumsum(encode.sizes[encode(text)])
    section, crossing = attribute(ends, bounds, rule)
    n = len(bounds) + 1
    tokens = np.bincount(section, minlength=n)
    crossed = np.bincount(section[crossing], minlength=n)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    edges = np.concatenate([[0], bounds, [len(data)]])
    full = [bool(raw[a:b].strip()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    head = full.index(True) if sum(full) > 1 else -1
    kinds = ["blank" if not f else "heading" if k == head else "body" for k, f in enumerate(full)]
    places = chars[edges].tolist()
    return [
        {"section": k, "kind": kinds[k], "start": places[k], "end": places[k + 1], "n_tokens": t, "n_crossing": c}
        for k, (t, c) in enumerate(zip(tokens.tolist(), crossed.tolist(), strict=True))
    ]


def section_column(text: Column, vocabulary: str = VOCABULARY, rule: str = "most") -> Column:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def make():
        encode = encoder(vocabulary)
        kind = pa.list_(pa.struct([("section", pa.int32()), ("kind", pa.string()), *[(c, pa.int64()) for c in ("start", "end", "n_tokens", "n_crossing")]]))

        def run(texts: pa.Array) -> pa.Array:
            return pa.array([count(t or "", encode, rule) for t in texts.to_pylist()], kind)

        return run

    return text_function(make, SECTIONS)(text)


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per section: the document's id, section, kind, start, end, n_tokens, n_crossing."""
    found = docs.select(F.col(id_col).alias("id"), F.explode(section_column(F.col(text_col), **options)).alias("s"))
    return found.select(F.col("id").alias(id_col), "s.*")
