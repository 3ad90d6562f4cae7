"""Mixing sources to target weights.

Tokens are summed per cell (source, language, topic). Iterative proportional fitting then scales the cells until their
shares meet the target shares of all three margins: a cell's weight is its tokens times a source factor, a language
factor and a topic factor. Languages and topics are few (MAX_PAIRS pairs at most, checked), sources may be any number:
the source factors are computed by Spark, one row per source, and a pass over the sources returns only the table of
languages by topics, from which the other two factors follow. So the driver holds numbers for languages and topics.

A document's expected copies are the wanted share of all tokens times the factor of its cell, so the expected tokens of
the copies have the fitted shares in all margins; `copies` is their whole part, and one more by a draw for the rest. A
document of a rare category that is to be raised has more than one.

A sample without repeats cannot raise a category beyond its tokens: there a document is kept with probability min(1, scale * factor of its cell), the scale being calibrated so that the
expected number of tokens is the wanted share of all; its shares miss the targets where that minimum is 1. The draw is a hash of seed, id and text, so it does not depend on
the layout; equal rows share it.

Defined results: null source, language or topic is a category of its own; a category's target is its share of the
tokens to the power given (1: as it is, 0: even), over the categories that occur; null and empty texts have no tokens
and probability 0, as do cells of such texts only; an empty table gives no rows; where no weights of the cells that occur
can meet all three targets (fitting stands still or takes MAX_ROUNDS), all targets move towards the shares as they are,
by the next part in EASED, and fitting starts again; the last part is the shares as they are, which the cells meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.llm.base import packed
from lociframe.session import cut_lineage

MAX_PAIRS = 50_000
TOLERANCE, MAX_ROUNDS = 1e-6, 200
#: Parts of the way from the targets to the shares as they are, tried in turn.
EASED = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Fitting stands still if the gap is not below this part of what it was STILL_ROUNDS before.
STILL, STILL_ROUNDS = 0.97, 10
#: Cells that are broadcast at most; more are joined by key.
MAX_SENT_CELLS = 100_000
SEED = 7
POWERS = {"source": 0.7, "lang": 0.5, "topic": 0.5}
RATE = 0.5


def token_count(text: Column) -> Column:
    """Words between white space, as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def form_topic(text: Column) -> Column:
    """A topic by the form of a text, for tables without a topic column."""
    n = F.length(text)
    digits = n - F.length(F.translate(text, "0123456789", ""))
    return (
        F.when(n.isNull() | (n == 0), "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(digits * 20 > n, "figures")
        .when(n < 600, "note")
        .when(n > 6000, "essay")
        .otherwise("article")
    )


@dataclass
class Fit:
    """`cells`: source, lang, topic, tokens, factor; factors times tokens sum to 1. `gap`: largest difference to a target share.
    `eased`: how far the targets were moved towards the shares as they are."""

    cells: DataFrame
    n_cells: int
    tokens: int
    gap: float
    rounds: int
    eased: float


def _targets(tokens: np.ndarray, power: float) -> np.ndarray:
    raised = np.where(tokens > 0, tokens.astype(float) ** power, 0.0)
    return raised / raised.sum() if raised.sum() else raised


def rake(cells: DataFrame, powers: dict[str, float] = POWERS) -> Fit:
    """Fit the cells (source, lang, topic, tokens), each given once, to the target shares."""
    cells = cut_lineage(cells.where("tokens > 0"))
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("cells")).limit(MAX_PAIRS + 1).collect()
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of language and topic")
    if not pairs:
        return Fit(cells.withColumn("factor", F.lit(0.0)), 0, 0, 0.0, 0, 0.0)
    order = lambda values: sorted(set(values), key=lambda x: (x is None, x))
    langs, topics = order(p.lang for p in pairs), order(p.topic for p in pairs)
    shape = (len(langs), len(topics))
    tokens = np.zeros(shape)
    for p in pairs:
        tokens[langs.index(p.lang), topics.index(p.topic)] = p.n
    targets = [_targets(tokens.sum(1), powers["lang"]), _targets(tokens.sum(0), powers["topic"])]
    as_is = [_targets(tokens.sum(1), 1), _targets(tokens.sum(0), 1)]

    index = lambda col, values: F.coalesce(*[F.when(col.eqNullSafe(F.lit(v)), F.lit(k)) for k, v in enumerate(values)])
    rows = cells.groupBy("source").agg(
        F.sum("tokens").cast("double").alias("n"),
        F.collect_list(F.struct(index(F.col("lang"), langs).alias("l"), index(F.col("topic"), topics).alias("k"), F.col("tokens").cast("double").alias("t"))).alias("own"),
    )  # one entry per pair, so at most MAX_PAIRS
    raised = F.pow("n", F.lit(powers["source"]))
    norm = rows.agg(F.sum(raised)).first()[0]
    given = cut_lineage(rows.select("source", "own", (raised / F.lit(norm)).alias("target"), (F.col("n") / F.lit(float(tokens.sum()))).alias("share")))

    def weighted() -> Column:
        a, b = (F.array(*[F.lit(float(x)) for x in v]) for v in (by_lang, by_topic))
        return F.aggregate("own", F.lit(0.0), lambda s, x: s + x["t"] * F.get(a, x["l"]) * F.get(b, x["k"]))

    done = 0
    for eased in EASED:
        rows = given.select("source", "own", ((1 - eased) * F.col("target") + eased * F.col("share")).alias("want"))
        want_lang, want_topic = ((1 - eased) * t + eased * s for t, s in zip(targets, as_is, strict=True))
        by_lang, by_topic = np.ones(shape[0]), np.ones(shape[1])
        gaps: list[float] = []
        while True:
            scaled = rows.select((F.col("want") / weighted()).alias("u"), F.explode("own").alias("x"))
            table = np.zeros(shape)
            for r in scaled.groupBy("x.l", "x.k").agg(F.sum(F.col("u") * F.col("x.t")).alias("s")).collect():
                table[r.l, r.k] = r.s
            done += 1
            now = table * by_lang[:, None] * by_topic[None, :]
            gap = max(np.abs(now.sum(1) - want_lang).max(), np.abs(now.sum(0) - want_topic).max())  # sources fit exactly here
            gaps.append(gap)
            still = len(gaps) > STILL_ROUNDS and gap > STILL * gaps[-1 - STILL_ROUNDS]
            if gap < TOLERANCE or still or len(gaps) == MAX_ROUNDS:
                break
            by_lang = want_lang / (table * by_topic[None, :]).sum(1)
            by_topic = want_topic / (table * by_lang[:, None]).sum(0)
        if gap < TOLERANCE:
            break
    pick = lambda v, values: F.get(F.array(*[F.lit(x) for x in values]), v)
    factor = F.col("want") / weighted() * F.get(F.array(*[F.lit(float(x)) for x in by_lang]), F.col("x.l")) * F.get(F.array(*[F.lit(float(x)) for x in by_topic]), F.col("x.k"))
    fitted = rows.select("*", F.explode("own").alias("x")).select(
        "source", pick(F.col("x.l"), langs).alias("lang"), pick(F.col("x.k"), topics).alias("topic"), F.col("x.t").alias("tokens"), factor.alias("factor")
    )
    return Fit(cut_lineage(fitted), sum(p.cells for p in pairs), int(tokens.sum()), float(gap), done, eased)


def calibrate(fit: Fit, rate: float) -> float:
    """The scale at which sum(tokens * min(1, scale * factor)) is `rate` of all tokens (in 40 bits)."""
    if not fit.n_cells:
        return 0.0
    least = fit.cells.agg(F.min(F.when(F.col("factor") > 0, F.col("factor")))).first()[0]
    low, high = 0.0, 1.0 / least
    for _ in range(8):
        marks = np.linspace(low, high, 33)[1:]
        got = fit.cells.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(x)) * F.col("factor"))) for x in marks]).first()
        over = [k for k, x in enumerate(got) if x >= rate * fit.tokens]
        k = over[0] if over else len(marks) - 1
        low, high = (marks[k - 1] if k else low), marks[k]
    return float(high)


def with_probability(docs: DataFrame, topic: Column | None = None, rate: float = RATE, powers: dict[str, float] = POWERS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """`doc` (the row), topic, n_tokens, factor, probability, sampled, expected_copies, copies, and the fit's eased and gap for every document."""
    keys = {"source": F.col("source"), "lang": F.col("lang"), "topic": form_topic(F.col(text_col)) if topic is None else topic}
    counted = docs.select(*[c.alias(k) for k, c in keys.items()], token_count(F.col(text_col)).alias("tokens"))
    fit = rake(counted.groupBy(*keys).agg(F.sum("tokens").alias("tokens")), powers)
    scale = calibrate(fit, rate)
    draw = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rows = packed(docs, *[c.alias(k) for k, c in keys.items()], token_count(F.col(text_col)).alias("n_tokens"), draw.alias("draw"))
    cells = fit.cells.select(*[F.col(k).alias(f"c_{k}") for k in keys], "factor")
    if fit.n_cells <= MAX_SENT_CELLS:
        cells = F.broadcast(cells)
    same = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in keys]
    chance = F.when(F.col("n_tokens") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("factor"))).otherwise(0.0)
    joined = rows.join(cells, same[0] & same[1] & same[2], "left").withColumn("probability", F.coalesce(chance, F.lit(0.0)))
    expected = F.when(F.col("n_tokens") > 0, F.coalesce("factor", F.lit(0.0)) * F.lit(rate * fit.tokens)).otherwise(0.0)
    joined = joined.withColumn("expected_copies", expected)
    whole = F.floor("expected_copies")
    return joined.select(
        "doc", "topic", "n_tokens", F.coalesce("factor", F.lit(0.0)).alias("factor"), "probability", (F.col("draw") < F.col("probability")).alias("sampled"),
        "expected_copies", (whole + (F.col("draw") < F.col("expected_copies") - whole).cast("long")).alias("copies"), F.lit(fit.eased).alias("eased"), F.lit(fit.gap).alias("gap"),
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: its id, source, lang, topic, n_tokens, probability, sampled, expected_copies, copies, eased, gap."""
    needed = docs.select(id_col, "text", "source", "lang")
    return with_probability(needed, id_col=id_col, **options).select(F.col(f"doc.{id_col}"), "doc.source", "doc.lang", "topic", "n_tokens", "probability", "sampled", "expected_copies", "copies", "eased", "gap")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their columns."""
    return with_probability(docs, **options).where("sampled").select("doc.*")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as its copies, with its columns."""
    rows = with_probability(docs, **options).where("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
