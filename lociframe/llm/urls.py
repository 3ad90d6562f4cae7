"""URL filters by a sorted digest array.

Entries are host and path prefixes like `net/`, each with a verdict. They are kept as three files: sorted 64-bit xxhash
keys, bounds, and the full strings. Executors get the files through Spark, map them into memory, probe all prefixes of a
batch of URLs with one vectorised binary search, and compare the stored string of every key found, so a collision of
digests never decides. The longest entry that fits wins.

Two lists are probed: the rules, by the host and its parent domains with each prefix of the path that has a rule's
length, and the method's own list of blocked names, by the parts of the host's labels. A host with a blocked part is
blocked. Both lists are parameters, so what executors load does not grow with the pages, and no page takes part in a
shuffle. A list of more than MAX_ENTRIES is kept as several arrays that are probed one after the other.

A rule fits its host and all subdomains if the path starts with the rule's path. A rule decides before the method; a URL
that neither decides is allowed.

Defined results: a null URL or one without `://` has an empty host and path and is allowed without a rule; user names
and ports stay part of the host; equal entries count once; equal lengths do not tie, as two fitting entries of one
length would be equal in host and path; repeated rows repeat.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm.base import lower_ascii, text_function

#: The rules.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: Names that block a host when they are a label of it or a hyphenated part of one.
BLOCKED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez", "xxx")
MAX_ENTRIES = 1_000_000
RESULT = "struct<entry:string,verdict:string>"
_SEP = "\x1f"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def write_array(entries: dict[str, str], folder: str) -> list[str]:
    """The three files of the entries, sorted by digest; names are unique."""
    rows = sorted((xxhash.xxh64_intdigest(k.encode()), k, v) for k, v in entries.items())
    stored = [f"{k}{_SEP}{v}".encode() for _, k, v in rows]
    name = uuid.uuid4().hex
    paths = [os.path.join(folder, f"{name}.{part}") for part in ("keys", "bounds", "strings")]
    np.array([r[0] for r in rows], np.uint64).tofile(paths[0])
    np.concatenate([[0], np.cumsum([len(s) for s in stored])]).astype(np.int64).tofile(paths[1])
    with open(paths[2], "wb") as f:
        f.write(b"".join(stored) or b"\0")
    return paths


class DigestArray:
    """Mapped files of one array."""

    def __init__(self, paths: list[str]):
        self.keys = np.memmap(paths[0], np.uint64, "r") if os.path.getsize(paths[0]) else np.zeros(0, np.uint64)
        self.bounds = np.memmap(paths[1], np.int64, "r")
        self.strings = np.memmap(paths[2], np.uint8, "r")

    def probe(self, wanted: list[bytes]) -> dict[int, str]:
        """Verdict of each wanted string that is stored, by its number."""
        if not len(self.keys) or not wanted:
            return {}
        digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in wanted), np.uint64, len(wanted))
        low = np.searchsorted(self.keys, digests)
        high = np.searchsorted(self.keys, digests, side="right")
        found = {}
        for i in np.flatnonzero(high > low).tolist():
            for j in range(low[i], high[i]):  # more than one entry only if digests collide
                stored, verdict = self.strings[self.bounds[j] : self.bounds[j + 1]].tobytes().rsplit(_SEP.encode(), 1)
                if stored == wanted[i]:
                    found[i] = verdict.decode()
        return found


def prefixes(host: str, path: str, lengths: list[int]) -> list[str]:
    """Entries that could fit: the host and its parent domains, each with the path's prefixes of the given lengths."""
    labels = host.split(".")
    own = [".".join(labels[i:]) for i in range(len(labels))] if host else []
    return [h + path[:n] for n in lengths if n <= len(path) for h in own]


def name_parts(host: str) -> list[str]:
    """Labels of a host and their hyphenated parts, as entries without a path; a port is no part."""
    return [part.split(":", 1)[0] + "/" for part in re.split("[.-]", host)] if host else []


def longest(wanted: list[list[str]], arrays: list[DigestArray]) -> list[tuple[str, str] | None]:
    """Of the strings wanted for each URL the longest that is stored, with its verdict."""
    flat = [w for own in wanted for w in own]
    owner = np.repeat(np.arange(len(wanted)), [len(own) for own in wanted])
    keys = [w.encode("utf-8", "replace") for w in flat]
    best: list[tuple[str, str] | None] = [None] * len(wanted)
    for array in arrays:
        for k, verdict in array.probe(keys).items():
            i = int(owner[k])
            if best[i] is None or len(flat[k]) > len(best[i][0]):
                best[i] = (flat[k], verdict)
    return best


def send(spark: SparkSession, entries: dict[str, str]) -> list[list[str]]:
    """Hand the entries to all executors, in arrays of at most MAX_ENTRIES; the names of each array's files."""
    names = sorted(entries)
    sent = []
    for k in range(0, len(names), MAX_ENTRIES):
        paths = write_array({e: entries[e] for e in names[k : k + MAX_ENTRIES]}, SparkFiles.getRootDirectory())
        for path in paths:
            spark.sparkContext.addFile(path)
        sent.append([os.path.basename(p) for p in paths])
    return sent


def entry_column(host: Column, path: Column, sent: list[list[str]], ask: Callable[[str, str], list[str]]) -> Column:
    """Struct of RESULT, null without an entry that fits. `ask`: the strings wanted for a host and a path."""

    def make():
        arrays = [DigestArray([SparkFiles.get(n) for n in own]) for own in sent]

        def run(urls: pa.Array) -> pa.Array:
            # a host holds no slash, and a path is empty or begins with one
            parts = [url.partition("/") for url in urls.to_pylist()]
            found = longest([ask(host, slash + rest) for host, slash, rest in parts], arrays)
            return pa.array([f and {"entry": f[0], "verdict": f[1]} for f in found], pa.struct([("entry", pa.string()), ("verdict", pa.string())]))

        return run

    return text_function(make, RESULT)(F.concat(host, path))


def judge(pages: DataFrame, rules: dict[str, str] = RULES, blocked: tuple[str, ...] = BLOCKED_WORDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: its id, host, path, rule, verdict."""
    spark = pages.sparkSession
    lengths = sorted({len(e) - e.index("/") for e in rules})
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    host, path = F.col("host"), F.col("path")
    given = entry_column(host, path, send(spark, rules), lambda h, p: prefixes(h, p, lengths))
    own = entry_column(host, F.lit(""), send(spark, {f"{name}/": "block" for name in blocked}), lambda h, _: name_parts(h))
    marked = seen.select("*", given.alias("g"), own.alias("m"))
    return marked.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("g.entry").alias("rule"),
        F.coalesce("g.verdict", "m.verdict", F.lit("allow")).alias("verdict"),
    )
