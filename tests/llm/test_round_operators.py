"""Whitening, line dedup and the Merkle manifest: against plain versions and on borders."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import linededup as ld
from lociframe.llm import merkle as mk
from lociframe.llm import whitening as wh

from llm_cases import prose

VECTORS = "vec_id long, embedding array<float>, label int, x string, i int, deviation double"


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, None, "x", 1, 0.5) for i, v in rows], VECTORS)


def whitened(df, **more):
    model = wh.fit(df, **more)
    return model, wh.components_of(wh.whiten(df, model), model).collect()


def plain_whitening(rows, k):
    x = np.floor(64 * np.array(rows, np.float32).astype(float)).astype(np.int64) + wh.SHIFT
    n, s = len(x), x.sum(axis=0)
    off = n * x - s
    z = off / n
    values, basis = np.linalg.eigh(z.T @ z / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return (off**2).sum(axis=1), z @ basis / np.sqrt(values), values / np.trace(z.T @ z / n)


@pytest.mark.parametrize(("dims", "components", "guard"), [(48, 6, 4), (5, 32, 16)])
def test_whitening_is_the_eigendecomposition(spark, dims, components, guard):
    rng = np.random.default_rng(3)
    rows = (rng.standard_normal((400, dims)) * np.linspace(3, 0.5, dims) + rng.standard_normal(dims)).astype(np.float32)
    rows[100:250] = rows[100]  # a group of copies
    table = vectors_table(spark, [(k, r.tolist()) for k, r in enumerate(rows)]).repartition(7)
    model, got = whitened(table, components=components, guard=guard)
    k = min(components, dims)
    deviations, values, shares = plain_whitening(rows, k)
    assert len(got) == 400 * k and {r.n for r in got} == {400} and model.residual <= 1e-12
    by = {(r.vec_id, r.component): r for r in got}
    ours = np.array([[by[i, c + 1].whitened for c in range(k)] for i in range(400)])
    signs = np.sign((ours * values).sum(axis=0))
    assert np.abs(ours - signs * values).max() < 1e-8
    assert [by[i, 1].deviation for i in range(400)] == deviations.tolist()
    assert all(abs(by[0, c + 1].explained / shares[c] - 1) < 1e-9 for c in range(k))
    assert {r.identity_error < 1e-9 for r in got} == {True}
    if dims > components + guard:
        assert model.passes > wh.LANCZOS + 3  # the filter was put to use


def test_parts_are_added_in_groups(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    rows = np.random.default_rng(4).standard_normal((90, 6))
    _, got = whitened(vectors_table(spark, list(enumerate(rows.tolist()))).repartition(9), components=3, guard=1)
    _, values, _ = plain_whitening(rows, 3)
    first = np.array([r.whitened for r in sorted(got, key=lambda r: r.vec_id) if r.component == 1])
    assert min(np.abs(first - values[:, 0]).max(), np.abs(first + values[:, 0]).max()) < 1e-9


def test_whitening_borders(spark):
    good = [(k, [float(k % 3), float(k % 5), 1.0]) for k in range(20)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [math.nan, 0.0, 0.0]), (94, [math.inf, 0.0, 0.0]), (95, [1.0]), (96, [1.0, 2.0, 3.0, 4.0])]
    repeated = [(None, [2.0, 2.0, 1.0]), (3, [0.0, 3.0, 1.0])]
    model, got = whitened(vectors_table(spark, good + bad + repeated))
    assert model.n == 22 and {r.component for r in got} == {1, 2}  # the third dimension does not vary
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == list(range(20)) and sum(r.vec_id is None for r in got) == 2
    assert sum(r.vec_id == 3 for r in got) == 4
    assert whitened(vectors_table(spark, []))[1] == []
    assert whitened(vectors_table(spark, bad[:1]))[1] == []
    assert whitened(vectors_table(spark, [(1, [1.0, 2.0])]))[1] == []  # one vector does not vary
    assert whitened(vectors_table(spark, [(1, []), (2, [])]))[1] == []
    _, wide = whitened(vectors_table(spark, [(1, [1e12]), (2, [-1e12]), (3, [0.0])]))
    assert [r.deviation for r in sorted(wide, key=lambda r: r.vec_id)] == [None, None, 0] or wide[0].deviation is None


def plain_lines(docs):
    fold = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line).strip(ld.WHITE)
    split = [(i, (t or "").split("\n")) for i, t in docs]
    held = {}
    for row, (i, lines) in enumerate(split):
        for key in {fold(x) for x in lines}:
            if len(key) >= ld.LENGTH:
                held.setdefault(key, []).append((row, i))
    rank = lambda i: (i is not None, i or 0)
    top = {k: max((i for _, i in v), key=rank) for k, v in held.items() if len(v) >= ld.COPIES}
    out = []
    for i, lines in split:
        kept = [x for x in lines if fold(x) not in top or top[fold(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows(df):
    return sorted([(r.doc.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()], key=str)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines_against_the_plain_rule(spark, make_docs, batches):
    rng = random.Random(5)
    shared = [f"Shared line number {k}, long enough to count as a passage Ä." for k in range(9)]
    long = shared[0] + "x" * 2000
    docs = []
    for k in range(80):
        lines = [rng.choice(shared[: 1 + k % 9]) for _ in range(rng.randint(0, 6))] + [f"own line {k} " + "y" * rng.randint(10, 60)]
        lines = [rng.choice([x, x.upper() if x.isascii() else x.replace("S", "s", 1), f"\t {x}\r", x]) for x in lines] + rng.choice([[], [""], ["short"], [long]])
        rng.shuffle(lines)
        docs.append((rng.choice([k, k, k // 2, None]) if k % 7 == 0 else k, "\n".join(lines)))
    docs += [(None, None), (200, ""), (201, "\n\n"), (3, docs[3][1]), (3, docs[3][1])]
    table = make_docs([(i, t, "en", "a") for i, t in docs]).repartition(5)
    assert line_rows(ld.dedupe_lines(table, batches=batches)) == sorted(plain_lines(docs), key=str)


def test_lines_on_awkward_rows(awkward, no_docs, make_docs):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert line_rows(ld.dedupe_lines(awkward)) == sorted(plain_lines(docs), key=str)
    assert ld.dedupe_lines(no_docs).collect() == []
    assert set(ld.dedupe_lines(awkward).select("doc.*").columns) == set(awkward.columns)
    one = [(k, "the same line in every document of this table, and no other") for k in range(300)]
    got = line_rows(ld.dedupe_lines(make_docs([(i, t, "en", "a") for i, t in one])))  # one heavy key
    assert [n for i, _, n, _ in got if i == 299] == [0] and sum(n for _, _, n, _ in got) == 299


def test_runs_are_levelled_and_merge_anti_joined(spark, scratch):
    runs, seen = ld.LineRuns(spark, scratch, fan=2), {}
    for batch in range(5):
        keys = [(h, h * 7, 100 - batch * 10 - d) for h in range(batch, batch + 6) for d in range(1 + h % 3)]
        fresh = runs.add(spark.createDataFrame(keys, "h1 long, h2 long, id long"))
        assert {r.h1 for r in fresh.collect()} == {h for h, _, _ in keys} - set(seen)
        for h, _, i in keys:
            n, top = seen.get(h, (0, i))
            seen[h] = (n + 1, max(top, i))
        assert all(len(level) < 2 for level in runs.levels)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert {r.h1: (r.n, r.top) for r in runs.whole().collect()} == seen
    plan = runs.runs()[0].join(runs.runs()[1].select(*ld.KEY), ld.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(leaves, fan):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    return levels


def plain_proof(levels, at, fan):
    found = []
    for level in levels[:-1]:
        run = range(at // fan * fan, min(len(level), (at // fan + 1) * fan))
        found += [level[j] for j in run if j != at]
        at //= fan
    return found


def plain_fold(levels, at, fan, now):
    for level in levels[:-1]:
        run = level[at // fan * fan : (at // fan + 1) * fan]
        now = h(*[now if j == at % fan else x for j, x in enumerate(run)])
        at //= fan
    return now


def plain_manifest(rows, fan):
    """rows: (group, id, leaf, instead); sorted rows with subroot, root, proof and folded root."""
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(r[0], []).append(r)
    trees = {g: plain_levels([r[2] for r in own], fan) for g, own in groups.items()}
    top = plain_levels([t[-1][0] for t in trees.values()], fan)
    out = []
    for place, (g, own) in enumerate(groups.items()):
        for k, (_, i, leaf, instead) in enumerate(own):
            proof = plain_proof(trees[g], k, fan) + plain_proof(top, place, fan)
            folded = plain_fold(top, place, fan, plain_fold(trees[g], k, fan, instead or leaf))
            out.append((i, leaf, trees[g][-1][0], top[-1][0], "".join(proof), folded))
    return sorted(out, key=str)


def test_midstates_are_sha256():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2**32, (8, 5), dtype=np.uint32)
    texts = [t.tobytes().decode() for t in mk.text_of(words)]
    state = mk._fed(np.repeat(mk.START[:, None], 5, axis=1), words)
    assert [t.tobytes().decode() for t in mk.text_of(mk._closed(state, 1))] == [h(t) for t in texts]
    twice = mk._fed(state, words[:, ::-1])
    assert [t.tobytes().decode() for t in mk.text_of(mk._closed(twice, 2))] == [h(a, b) for a, b in zip(texts, texts[::-1], strict=True)]


@pytest.mark.parametrize(("fan", "block", "sizes"), [(2, 4, {"a": 37, None: 1, "ü": 8, "": 5, "b": 2}), (3, 9, {"a": 30, "b": 10, "c": 1}), (2, 4096, {"x": 70}), (2, 2, {f"g{k:02d}": 1 for k in range(11)})])
def test_manifest_against_plain_trees(spark, monkeypatch, fan, block, sizes):
    monkeypatch.setattr(mk, "RANGE_ROWS", 9)
    rng, rows = random.Random(fan), []
    for g, n in sizes.items():
        ids = rng.sample(range(1000), n)
        rows += [(g, i, h(str(g), str(i)), h("other", str(i)) if rng.random() < 0.5 else None) for i in ids]
    rows.append((next(iter(sizes)), None, h("no id"), None))
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "lang string, doc_id long, d string, r string").repartition(3)
    got = mk.manifest(df, F.col("d"), F.col("r"), fan=fan, block=block)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain_manifest(rows, fan)


def test_leaf_fields_and_borders(spark, awkward, no_docs):
    own = mk.leaf([F.col(c) for c in ("doc_id", "source", "text")])
    df = spark.createDataFrame([(1, None, "ü"), (None, "", "a:b")], "doc_id long, source string, text string")
    assert [r[0] for r in df.select(own).collect()] == [h("1:1", "-", "2:ü"), h("-", "0:", "3:a:b")]
    got = mk.manifest(awkward, own)
    assert got.count() == awkward.count() and got.where("root <> folded_root").count() == 0 and got.select("root").distinct().count() == 1
    assert mk.manifest(no_docs, own).collect() == []
    alone = mk.manifest(df.limit(1).withColumn("lang", F.lit("x")), own).first()
    assert alone.proof == "" and alone.leaf == alone.subroot == alone.root == alone.folded_root


def test_long_texts(make_docs):
    long = "\n".join(f"{prose('en', k % 40, 12)} and this is line".replace("\n", " ") for k in range(20_000))
    docs = make_docs([(k, long, "en", "a") for k in range(5)])
    got = {r.doc.doc_id: r.n_dropped for r in ld.dedupe_lines(docs).select("doc", "n_dropped").collect()}
    assert got == {4: 0, **{k: 20_000 for k in range(4)}}


def test_control_characters_in_urls(spark):
    from lociframe.llm import urls

    given = [("http://evil\x1f.com/fr/x", "com/fr/"), ("http://com/fr/\x1f", "com/fr/"), ("http://\x1f.com/en", None), ("x://a.com", None), ("http://a.com/fr/?/de/", "com/fr/")]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(given)], "page_id long, url string")
    assert [r.rule for r in sorted(urls.judge(pages).collect(), key=lambda r: r.page_id)] == [rule for _, rule in given]
