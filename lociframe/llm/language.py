"""Language identification by compression.

A text is put in normal form (lower case, letters only, single spaces), cut into even chunks, and each chunk is
compressed once for every language with a zstandard compressor primed with that language's raw-content dictionary. The
language with the fewest bytes over all chunks is chosen. Where the margin to the second is narrow (mostly short texts),
the sizes are taken again at STRONG_LEVEL, whose search is finer; a margin that is still narrow is a rejection.

Learning reads a bounded sample of labelled rows: at most SAMPLE_TEXTS texts of at most SAMPLE_CHARS characters per
language (the texts with the least hash in each of SAMPLE_TEXTS hash classes), of which DICTIONARY_BYTES go into the
dictionary. Prediction reads every text whole.

Defined results: `und` with score 0 and a rejection for null, empty and letterless texts, and for every text if nothing
was learned; a tie between languages goes to the first by name and is rejected; rows are judged one by one, so repeated
rows repeat; labels that are null teach nothing. Chunks bound the memory for very long texts.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import packed, text_function

SAMPLE_TEXTS = 64
SAMPLE_CHARS = 20_000
DICTIONARY_BYTES = 96 << 10
MAX_LANGUAGES = 500
CHUNK_BYTES = 4096
LEVEL, STRONG_LEVEL = 3, 12
#: Least margin to the second language, as a share of the smallest size and in bytes: to be sure at LEVEL, and to be
#: accepted at STRONG_LEVEL.
SURE, SURE_BYTES = 0.05, 6
MARGIN, MARGIN_BYTES = 0.005, 1
RESULT = "lang_pred string, score double, rejected boolean"
#: Letters only: fractions, superscripts and Roman-numeral signs are word characters, but no letters.
_OTHER = regex.compile(r"\P{L}+")


def normal_form(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, bytes]:
    """Dictionary of each label, from the bounded sample described above."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), F.xxhash64(F.col(text_col)).alias("h"))
    rows = rows.where(F.col("label").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & F.col("text").rlike(r"\p{L}"))
    least = rows.groupBy("label", F.pmod("h", F.lit(SAMPLE_TEXTS)).alias("k")).agg(F.min("h").alias("h"))
    picks = least.limit(MAX_LANGUAGES * SAMPLE_TEXTS + 1).collect()
    if len(picks) > MAX_LANGUAGES * SAMPLE_TEXTS:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    if not picks:
        return {}
    chosen = rows.where(F.col("h").isin([r.h for r in picks])).dropDuplicates(["label", "h"]).collect()
    texts: dict[str, list[bytes]] = {}
    for r in sorted(chosen, key=lambda r: (r.label, r.h)):
        texts.setdefault(r.label, []).append(normal_form(r.text))
    return {label: b" ".join(parts)[:DICTIONARY_BYTES] for label, parts in texts.items() if any(parts)}


class Classifier:
    """Sizes of a text under each dictionary, and the choice between them."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.labels = sorted(dictionaries)
        self.levels = {level: [self._compressor(dictionaries[k], level) for k in self.labels] for level in (LEVEL, STRONG_LEVEL)}

    @staticmethod
    def _compressor(dictionary: bytes, level: int):
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_dict_id=False).compress

    def sizes(self, data: bytes, level: int = LEVEL) -> list[int]:
        n = -(-len(data) // CHUNK_BYTES)
        cuts = [len(data) * k // n for k in range(n + 1)]
        chunks = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return [sum(len(compress(c)) for c in chunks) for compress in self.levels[level]]

    @staticmethod
    def narrow(sizes: list[int], share: float, least: int) -> bool:
        first, second = sorted(sizes)[:2] if len(sizes) > 1 else (sizes[0], 2 * sizes[0])
        return second - first < max(least, share * first)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        data = normal_form(text or "")
        if not data or not self.labels:
            return "und", 0.0, True
        sizes = self.sizes(data)
        if self.narrow(sizes, SURE, SURE_BYTES):
            sizes = self.sizes(data, STRONG_LEVEL)
        least = min(sizes)
        score = 1 / sum(2.0 ** -min(s - least, 60) for s in sizes)
        return self.labels[sizes.index(least)], score, self.narrow(sizes, MARGIN, MARGIN_BYTES)


def language_columns(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """Struct of RESULT for a text column."""

    def make():
        judge = Classifier(dictionaries).judge

        def run(texts: pa.Array) -> pa.Array:
            found = [judge(t) for t in texts.to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            return pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], ["lang_pred", "score", "rejected"])

        return run

    return text_function(make, RESULT)(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that learning leaves out; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row per document: its id, `held_out` and RESULT."""
    learned = learn(docs.where(~held_out(id_col)), text_col, label_col)
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"), language_columns(F.col(text_col), learned).alias("r")).select(id_col, "held_out", "r.*")


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """The documents whose language is clear, with their columns."""
    learned = learn(docs.where(~held_out(id_col)), text_col, label_col)
    return packed(docs, language_columns(F.col(text_col), learned).alias("r")).where(~F.col("r.rejected")).select("doc.*")
