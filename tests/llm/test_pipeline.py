"""The pipeline: its stages on planted rows, and the registered queries on the smallest tables."""

import random
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_queries import TABLES, compare  # noqa: E402

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402

from llm_cases import prose  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_ordered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mix"]


def test_stages_on_planted_rows(spark, make_docs, scratch):
    item = prose("en", 77, 40)
    rows = [(k, prose(("en", "de", "fr")[k % 3], k, 200), ("en", "de", "fr")[k % 3], "ab"[k % 2]) for k in range(90)]
    rows += [(200, rows[5][1], "fr", "b"), (201, rows[5][1].replace("\n", "\n "), "fr", "b"), (202, "12 34", "en", "a")]
    rows += [(203, prose("en", 203, 100) + " " + item + " " + prose("en", 204, 100), "en", "a"), (204, prose("de", 205, 150) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "de", "a")]
    docs = make_docs(rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], scratch)
        assert name == "mix" or out.columns == docs.columns
        out.write.parquet(f"{scratch}/{name}")
        seen.append(spark.read.parquet(f"{scratch}/{name}"))
    ids = [{r.doc_id for r in x.collect()} for x in seen]
    assert ids[0] - ids[1] == {202}
    assert ids[1] - ids[2] == {200, 201}
    assert ids[2] - ids[3] == {203}
    assert ids[3] == ids[4]
    masked = seen[4].where("doc_id = 204").first()
    assert "04dbebab" not in masked.text and "[SECRET]" in masked.text and masked.n_chars == len(masked.text)
    assert ids[5] < ids[4] and len(ids[5]) > 15
    docs.write.parquet(f"{scratch}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, scratch).collect()} == ids[5]


def test_near_copies_with_edited_words_go(spark, make_docs, awkward, scratch):
    rng = random.Random(3)
    rows, far = [], set()
    for k in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((100 * k, " ".join(base), "en", "a"))
        for j in range(1, 6):  # 1 to 5 edited words of 200: similarity 0.95 to 0.77
            other = list(base)
            for i in range(j):
                other[20 + 40 * i] = f"new{k}x{j}x{i}"
            rows.append((100 * k + j, " ".join(other), "en", "a"))
        rows.append((100 * k + 9, " ".join(base[:100] + [f"o{k}x{i}" for i in range(100)]), "en", "a"))
        far.add(100 * k + 9)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs(rows), scratch).collect()}
    assert not {100 * k + j for k in range(30) for j in range(1, 5)} & kept
    assert {100 * k for k in range(30)} | far <= kept
    ids = [r.doc_id for r in corpus_pipeline.near_dedup(spark, awkward, scratch).collect()]
    assert len(ids) == 9 and ids.count(1) == 1 and ids.count(7) == 2 and ids.count(3) == 1


def test_stages_stand_awkward_rows(spark, awkward, no_docs, scratch):
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, scratch).columns == awkward.columns
        assert stage(spark, no_docs, scratch).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, no_docs, scratch).count() == 0


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_secret_scan", "op8_benchmark_decontamination", "op10_url_filter"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    verdict, _ = compare(spark, con, name, SF)
    assert verdict.startswith("ok"), verdict


def test_every_operator_has_its_query():
    found = sorted(int(n[2:].split("_")[0]) for n in queries() if n.startswith("op") and n[2:].split("_")[0].isdigit())
    assert found == list(range(1, 14)) and "pipeline" in queries()
    assert {n for n in oracle_sql() if n.startswith("op")} >= {"op1_license_scan", "op3_secret_scan", "op8_benchmark_decontamination", "op10_url_filter"}


def test_near_copies_of_template_families(spark, make_docs):
    """Families of texts from one template, against all pairs with an exact similarity of 0.8 or more."""
    import random

    from lociframe.llm import nearcopies

    rng, texts = random.Random(12), []
    words = [f"w{k}" for k in range(400)]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(90)]
        for _ in range(25):
            edited = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                edited[rng.randrange(90)] = rng.choice(words)
            texts.append(" ".join(edited))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(86)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                linked += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    classes = {find(k) for k in range(len(texts))}
    kept = {r.doc_id for r in nearcopies.keep_one(make_docs([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    assert classes <= kept  # nothing but near copies goes
    gone = len(texts) - len(classes)
    assert linked > 300 and len(texts) - len(kept) >= 0.95 * gone, (len(kept), len(classes), gone)


def test_fingerprints_bring_near_copies_together(spark):
    """The links of the fingerprints are candidates on their own: no node here shares a band with another."""
    from lociframe.llm import nearcopies

    rows = [(11, 0b0, 100, [1]), (12, 0b11, 99, [2]), (13, 0b1111, 98, [3]), (14, 0b1111, 97, [4]), (15, 0b1111, 20, [5]), (16, 1 << 40, 100, [6]), (17, -1, 0, []), (18, -1, 0, [])]
    classes = spark.createDataFrame(rows, "node long, fp long, n int, bands array<long>")
    found = nearcopies.candidate_pairs(classes.select("node", "n", "bands"), nearcopies.fingerprint_pairs(classes))
    pairs = {(r.a, r.b) for r in found.where("first").collect()}
    assert {(12, 11), (13, 12), (14, 13)} <= pairs  # 15 is too small, 17 and 18 have no words
    assert not {15, 17, 18} & {x for p in pairs for x in p}


def test_near_dedup_asks_for_the_links_of_the_fingerprints(spark, make_docs, scratch, monkeypatch):
    from lociframe.llm import nearcopies, simhash

    asked = []
    monkeypatch.setattr(nearcopies, "fingerprint_links", lambda fps: asked.append(fps.count()) or simhash.links(fps))
    text = prose("en", 1, 200)
    docs = make_docs([(1, text, "en", "a"), (2, text + " end", "en", "a"), (3, prose("de", 2, 200), "de", "a")])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, scratch).collect()} == {1, 3}
    assert len(asked) == 1 and asked[0] in (2, 3)


def test_near_copies_whose_leaders_are_far(spark, make_docs, monkeypatch):
    """Every pair of a bucket is compared, also if its leaders are near to neither: all nodes share the buckets here."""
    import numpy as np
    import pyarrow as pa

    from lociframe.llm import nearcopies

    rng, texts = random.Random(4), []
    for k in range(30):  # pairs of similarity above 0.8, each far from all others
        base = [f"p{k}x{i}" for i in range(100)]
        texts += [" ".join(base), " ".join(base[:60] + [f"e{k}"] + base[61:])]
    chain = [f"c{i}" for i in range(160)]
    texts += [" ".join(chain[2 * k : 2 * k + 60]) for k in range(50)]  # each near to its neighbours only
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = {(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = list(range(len(texts)))
    for _ in texts:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    plain = nearcopies.sketch

    def crowded(found: pa.Array) -> pa.Array:
        node, n, _ = plain(found).flatten()
        same = np.tile(np.arange(nearcopies.BANDS), len(found))
        return pa.StructArray.from_arrays([node, n, nearcopies._lists(np.arange(len(found) + 1) * nearcopies.BANDS, same)], ["node", "n", "bands"])

    monkeypatch.setattr(nearcopies, "sketch_column", lambda text: nearcopies.text_function(lambda: crowded, nearcopies.SKETCH)(text))
    monkeypatch.setattr(nearcopies, "TILE", 16, raising=False)
    kept = {r.doc_id for r in nearcopies.keep_one(make_docs([(k, t, "en", "a") for k, t in enumerate(texts)])).collect()}
    assert len(set(root)) == 31 and kept == set(root)


def test_digests_drop_no_link(spark):
    import pyarrow as pa

    from lociframe.llm import nearcopies

    rng = random.Random(8)
    texts = []
    for size in (5, 9, 40, 300, 3000):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(base)] + [" ".join(base[: size - cut] + [f"o{i}" for i in range(cut)]) for cut in (1, size // 20, size // 12, size // 5)]
    found = nearcopies.shingle_sets(pa.array(texts)).to_pylist()
    for x in found:
        for y in found:
            a, b = set(x["shingles"]), set(y["shingles"])
            differ = sum(((p ^ q) & (2**64 - 1)).bit_count() for p, q in zip(x["bits"], y["bits"], strict=True))
            assert len(x["bits"]) == nearcopies.WORDS and differ <= len(a ^ b)
            if len(a & b) >= nearcopies.SIMILARITY * len(a | b):
                assert differ * 9 <= len(a) + len(b)
