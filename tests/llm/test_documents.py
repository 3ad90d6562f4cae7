"""Near duplicates, language, fingerprints, token counts, scores, mixing, URLs: against plain versions and on borders."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lociframe.llm import language as la
from lociframe.llm import mixing as mi
from lociframe.llm import pseudolm as lm
from lociframe.llm import simhash as sh
from lociframe.llm import sketches as sk
from lociframe.llm import tokens as to
from lociframe.llm import urls as ur

from llm_cases import as_dict, prose


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    digests = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(d >> b & 1 for d in digests) > len(digests))


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [least.get(find(i)) for i in range(len(fps))]


def test_masks_cover_every_pair_of_bits():
    masks = sh.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_near_duplicates_match_all_pairs(make_docs):
    rng = random.Random(1)
    texts = [None, "", " ", "One two", "one TWO", "ä b c", "é É"]
    for k in range(12):
        base = prose("en", k, 250).split()
        texts.append(" ".join(base))
        for _ in range(12):
            other = list(base)
            other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    rng.shuffle(texts)
    ids = [3 * k + 5 for k in range(len(texts))]
    found = as_dict(sh.near_duplicates(make_docs([(i, t, "en", "a") for i, t in zip(ids, texts, strict=True)])))
    fps = [plain_fingerprint(t) for t in texts]
    roots = plain_components(fps, ids)
    assert len(set(roots)) < len(set(fps))
    for i, f, r in zip(ids, fps, roots, strict=True):
        assert (found[i].fingerprint, found[i].component_id) == (f"{f:016x}", r)


def test_links_lose_no_component(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):  # long chains and a dense group, and pairs that just miss
        for _ in range(30):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)} | {f ^ 0b111 for f in list(fps)[:10]}
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    roots = {r.node: r.root for r in sh.connected(sh.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = plain_components(sorted(fps), signed)
    assert [roots.get(f, f) for f in signed] == want


def test_one_of_each_group_stays(awkward, make_docs, no_docs):
    kept = sh.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = [r.doc_id for r in kept.collect()]
    found = sh.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    assert len(ids) == 9 and ids.count(1) == 1 and ids.count(7) == 2 and ids.count(3) == 1 and 4 not in ids and 5 not in ids
    assert sh.keep_one(no_docs).count() == 0 and sh.near_duplicates(no_docs).count() == 0
    same = make_docs([(None, "a b c d", "en", "a")] * 3 + [(2, "a b c d", None, "b")] * 2)
    assert [r.doc_id for r in sh.keep_one(same).collect()] == [2]


def test_language_on_held_out_documents(make_docs):
    docs = make_docs([(k, prose(("en", "de", "fr")[k % 3], k), ("en", "de", "fr")[k % 3], "a") for k in range(120)])
    rows = la.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 120 and 20 < len(held) < 60
    assert all(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] and not r.rejected and 0.9 < r.score <= 1 for r in held)


def test_language_never_reads_held_out_labels(make_docs):
    rows = [(k, prose(("en", "de")[k % 2], k), ("en", "de")[k % 2], "a") for k in range(60)]
    docs = make_docs(rows)
    wrong = docs.withColumn("lang", F.when(la.held_out(), "xx").otherwise(F.col("lang")))
    assert sorted(map(str, la.identify(docs).collect())) == sorted(map(str, la.identify(wrong).collect()))


def test_language_matches_a_plain_classifier(make_docs):
    own = {k: prose(("en", "de", "fr")[k % 3], k, 2 + k % 7 * 40) for k in range(60)}
    own |= {100: "½ ²", 101: "Ⅷ ① ٣", 102: "straße ½", 103: "12 ³", 104: "e\u0301te\u0301", 105: "die" * 5000, 106: None}
    docs = make_docs([(k, t, ("en", "de", "fr")[k % 3], "a") for k, t in own.items()])
    learned = la.learn(docs.where(~la.held_out()))

    def judged(text):
        data = " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()).encode()
        if not data:
            return "und", 0.0
        n = -(-len(data) // la.CHUNK_BYTES)
        chunks = [data[len(data) * k // n : len(data) * (k + 1) // n] for k in range(n)]
        for level in (la.LEVEL, la.STRONG_LEVEL):
            sizes = {}
            for label, raw in learned.items():
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_dict_id=False)
                sizes[label] = sum(len(packer.compress(c)) for c in chunks)
            first, second = sorted(sizes.values())[:2]
            if second - first >= max(la.SURE_BYTES, la.SURE * first):
                break
        return min(sizes, key=lambda k: (sizes[k], k)), 1 / sum(2.0 ** -min(v - first, 60) for v in sizes.values())

    found = as_dict(la.identify(docs))
    for k, text in own.items():
        want, score = judged(text)
        assert found[k].lang_pred == want and abs(found[k].score - score) < 1e-9, text
    assert [found[k].lang_pred for k in (100, 101, 103, 106)] == ["und"] * 4


def test_language_borders(awkward, no_docs, make_docs):
    rows = la.identify(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in rows if r.doc_id in (3, 4, 5))
    assert all(r.held_out is not None for r in rows)
    kept = la.drop_rejected(awkward)
    assert kept.columns == awkward.columns and {1, 2, 6} <= {r.doc_id for r in kept.collect()}
    assert la.identify(no_docs).count() == 0
    unlabelled = make_docs([(1, "words without a label", None, "a"), (2, "123", "en", "a")])
    assert {r.lang_pred for r in la.identify(unlabelled).collect()} == {"und"}


def plain_pieces(text):
    return {p.strip(" ") for p in re.findall(sk.PARAGRAPH, text)} - {""}


def test_fingerprints_match_plain_sets(make_docs):
    rng = random.Random(4)
    texts = [prose("en", k, rng.choice((3, 40, 400, 3000))) for k in range(25)]
    texts[3:6] = ["", "🦊é. " * 40, texts[2] + " more."]
    rows = [(7 * k + 1, t, "en", "a") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    found = as_dict(sk.fingerprints(make_docs(rows)))
    order = sorted((r[:2] for r in rows), reverse=True)
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (plain_pieces(t) for t in (text, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r.near_edited - like(a, b)) < 1e-12 and abs(r.near_next - like(a, c)) < 1e-12


def test_fingerprints_of_equal_texts_are_equal(make_docs):
    found = sk.fingerprints(make_docs([(1, "One. Two.", "en", "a"), (2, None, "en", "a"), (3, "One. Two.", "en", "a"), (4, "", "en", "a")]))
    r = as_dict(found)
    assert r[1].fingerprint == r[3].fingerprint != r[2].fingerprint == r[4].fingerprint
    assert r[2].near_next == 0 and r[4].near_next == 0 and r[1].near_next == 0 and r[2].near_edited == 1


def test_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(sk, "ORDER_ROWS", 7)
    ids = [k * k for k in range(50)] + [None]
    keys = spark.createDataFrame([(i, 5, 2 if i is None else i) for i in ids], "id long, h long, n int")
    found = {r.id: r.prev_id for r in sk.successors(keys).collect()}
    order = sorted(ids[:-1], reverse=True) + [None]
    assert found == {x: order[k - 1] for k, x in enumerate(order)}


def test_fingerprints_stand_awkward_rows(awkward, no_docs, make_docs):
    rows = sk.fingerprints(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert sk.fingerprints(no_docs).count() == 0
    only = sk.fingerprints(make_docs([(1, "abcdef", "en", "a")])).first()
    assert only.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and only.near_next == 1
    plan = sk.fingerprints(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_token_counts_round_trip(make_docs):
    texts = ["", None, "one\n\ntwo  three\n", "ß🦊 naïve\r\n\n\n  x", "a" * 25_000, prose("de", 1), "\n", " \n \n word"]
    encode = to.encoder(to.VOCABULARY)
    for rule in to.RULES:
        for text in texts:
            found = to.count(text or "", encode, rule)
            ids = encode(text or "")
            assert sum(s["n_tokens"] for s in found) == len(ids)
            assert "".join((text or "")[s["start"] : s["end"]] for s in found) == (text or "")
            assert encode.encoding.decode(ids.tolist()) == (text or "")
    got = to.section_tokens(make_docs([(k, t, "en", "a") for k, t in enumerate(texts)]))
    assert got.count() == sum(len(to.count(t or "", encode, "most")) for t in texts)


def test_crossing_tokens_follow_the_rule(spark):  # F.col needs a session
    ends, bounds = np.array([2, 6, 7, 12]), np.array([5, 8, 9])
    plain = {"first": [], "last": [], "most": []}
    edges = [0, 5, 8, 9, 12]
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        share = [max(0, min(b, y) - max(a, x)) for x, y in zip(edges, edges[1:], strict=False)]
        own = [k for k, s in enumerate(share) if s]
        plain["first"].append(own[0])
        plain["last"].append(own[-1])
        plain["most"].append(share.index(max(share)))
    for rule, want in plain.items():
        section, crossing = to.attribute(ends, bounds, rule)
        assert section.tolist() == want and crossing.tolist() == [False, True, False, True]
    with pytest.raises(ValueError):
        to.section_column(F.col("text"), rule="other")


def test_tokens_stand_awkward_rows(awkward, no_docs):
    rows = to.section_tokens(awkward).collect()
    assert {r.doc_id for r in rows} == {1, 2, 5, 6, 7, None, 10, 11}
    assert to.section_tokens(no_docs).count() == 0


def test_scores_match_a_plain_network():
    rng = np.random.default_rng(0)
    net = lm.Network(rng.normal(0, 0.3, sum(int(np.prod(s)) for s in lm.Network.SHAPES)))
    words = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    w = lm.words_of(pa.array(["a b c d e f", "", "x", "y z"]))
    entries = words.entries(w)
    around = lm.neighbours(w, entries)
    got = net.log_probs(around, entries)
    side, bias, tc, cb, tm, mb = [x.astype(float) for x in net.weights]
    docs = [entries[a:b].tolist() for a, b in zip(w.first, w.first[1:], strict=False)]
    want = []
    for doc in docs:
        for i, t in enumerate(doc):
            h = bias.copy()
            for place, step in enumerate((-2, -1, 1, 2)):
                h += side[place][doc[i + step] if 0 <= i + step < len(doc) else lm.SIZE]
            h = np.tanh(h)
            k, m = divmod(t, lm.MEMBERS)
            for logits, pick in ((h @ tc + cb, k), (h @ tm[k] + mb[k], m)):
                t_ = logits - logits.max()
                want.append(t_[pick] - np.log(np.exp(t_).sum()))
    assert np.allclose(got, np.array(want).reshape(-1, 2).sum(1), atol=1e-4)


def test_gradient_lowers_the_loss():
    words = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    w = lm.words_of(pa.array([prose("en", k) for k in range(20)]))
    entries = words.entries(w)
    around = lm.neighbours(w, entries)
    net = lm.Network.fresh(np.full(lm.SIZE, 1 / lm.SIZE))
    first = net.log_probs(around, entries).mean()
    for _ in range(30):
        net.learn(around, entries)
    assert net.log_probs(around, entries).mean() > first + 2


def test_training_tells_prose_from_noise(make_docs):
    rng = random.Random(8)
    docs = make_docs([(k, prose("en", k, 300), "en", "a") for k in range(60)] + [(100 + k, " ".join(rng.sample(prose("en", k, 300).split() * 2 + ["zq"] * 200, 300)), "en", "a") for k in range(3)])
    rows = as_dict(lm.scores(docs))
    assert min(rows[k].mean_log_prob for k in range(60)) > max(rows[100 + k].mean_log_prob for k in range(3))
    r = rows[5]
    assert r.n_words == 300 and abs(r.log_prob / 300 - r.mean_log_prob) < 1e-9


def test_unique_random_words_score_below_prose_of_rare_words(make_docs):
    rng = random.Random(12)
    rare = [f"word{k}" for k in range(1500)]
    clean = [(k, " ".join(rng.choices(rare, k=200)), "en", "a") for k in range(300)]
    noise = [(1000 + k, " ".join(f"{rng.getrandbits(60):x}" for _ in range(200)), "en", "a") for k in range(100)]
    rows = as_dict(lm.scores(make_docs(clean + noise)))
    assert min(rows[k].mean_log_prob for k in range(300)) > max(rows[1000 + k].mean_log_prob for k in range(100)) + 1


def test_the_vocabulary_covers_its_share(make_docs):
    counts = lm.word_counts(make_docs([(1, " ".join(f"w{k} w{k}" for k in range(9000)), "en", "a")])).cache()
    words, shares = lm.vocabulary(counts)
    assert len(words.hashes) == lm.COVERAGE * 9000 and len(shares) == words.shape[0] * words.shape[1] >= len(words.hashes) + lm.TAIL
    own = np.exp([r.log_share for r in lm.tail_shares(counts, words).collect()])
    assert len(own) == 9000 - len(words.hashes) and lm.TAIL - 1 < own.sum() < lm.TAIL


def test_scores_stand_awkward_rows(awkward, no_docs):
    rows = lm.scores(awkward).collect()
    assert len(rows) == awkward.count()
    assert all((r.n_words, r.log_prob, r.mean_log_prob) == (0, 0, None) for r in rows if r.doc_id in (3, 4, 5))
    assert lm.scores(no_docs).count() == 0


def test_every_document_gives_targets():
    words = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    w = lm.words_of(pa.array(["a", "", "b c", prose("en", 3)]))
    at = lm.targets(w, words.entries(w))
    assert set(w.text_of(at).tolist()) == {0, 2, 3}


def test_every_word_is_a_target_once():
    words = lm.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    w = lm.words_of(pa.array([prose("en", k, 1 + 9 * k) for k in range(5)] + [""]))
    assert sorted(lm.targets(w, words.entries(w)).tolist()) == list(range(1 + 10 + 19 + 28 + 37))


def plain_rake(cells, powers, rounds=500):
    keys = sorted(cells, key=str)
    t = np.array([cells[k] for k in keys], float)
    target = []
    for j, name in enumerate(("source", "lang", "topic")):
        values = sorted({k[j] for k in keys}, key=str)
        index = np.array([values.index(k[j]) for k in keys])
        sums = np.bincount(index, t) ** powers[name]
        target.append((index, sums / sums.sum()))
    x = t.copy()
    for _ in range(rounds):
        for index, want in target:
            x *= (want / np.bincount(index, x))[index]
    return {k: v / w for k, v, w in zip(keys, x, t, strict=True)}


def test_rake_matches_plain_fitting(spark):
    rng = random.Random(6)
    cells = {(s, lang, topic): rng.randrange(1, 1000) for s in ("a", "b", None, "d") for lang in ("x", "y", None) for topic in ("p", "q")}
    del cells[("a", "x", "p")]
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    fit = mi.rake(rows)
    want = plain_rake(cells, mi.POWERS)
    got = {(r.source, r.lang, r.topic): r.factor for r in fit.cells.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 1e-4 for k in want)
    scale = mi.calibrate(fit, 0.4)
    kept = sum(cells[k] * min(1, scale * want[k]) for k in want)
    assert abs(kept / sum(cells.values()) - 0.4) < 1e-4


def test_targets_that_cannot_be_met_are_eased(spark):
    rows = spark.createDataFrame([("a", "x", "p", 10), ("b", "y", "q", 90)], "source string, lang string, topic string, tokens long")
    fit = mi.rake(rows)
    assert fit.eased == 1.0 and fit.gap < mi.TOLERANCE
    assert {(r.source, round(r.factor * r.tokens, 9)) for r in fit.cells.collect()} == {("a", 0.1), ("b", 0.9)}
    assert mi.rake(rows, {"source": 0.7, "lang": 0.7, "topic": 0.7}).eased == 0.0


def test_sampling_meets_the_rate(make_docs):
    docs = make_docs([(k, prose(("en", "de")[k % 2], k, 50 + k % 7 * 100), ("en", "de", None)[k % 3], "abc"[k % 5 % 3]) for k in range(900)])
    rows = mi.mixture(docs).collect()
    total = sum(r.n_tokens for r in rows)
    assert abs(sum(r.n_tokens * r.probability for r in rows) / total - mi.RATE) < 1e-3
    assert abs(sum(r.n_tokens for r in rows if r.sampled) / total - mi.RATE) < 0.08
    assert mi.sample(docs).count() == sum(r.sampled for r in rows)


def test_expected_copies_meet_the_targets(make_docs):
    langs = ["en"] * 80 + ["de"] * 15 + ["fr"] * 5
    docs = make_docs([(k, prose(langs[k % 100], k, 50 if k % 9 == 0 else 300), langs[k % 100], "aaaab"[k // 100 % 5]) for k in range(1500)])
    rows = mi.mixture(docs).collect()
    total = sum(r.n_tokens for r in rows)
    assert any(r.expected_copies > 1.5 for r in rows) and {r.eased for r in rows} == {0.0} and max(r.gap for r in rows) < mi.TOLERANCE
    assert abs(sum(r.n_tokens * r.expected_copies for r in rows) / total - mi.RATE) < 1e-3
    for margin, power in mi.POWERS.items():
        own, got, drawn = {}, {}, {}
        for r in rows:
            own[r[margin]] = own.get(r[margin], 0) + r.n_tokens
            got[r[margin]] = got.get(r[margin], 0) + r.n_tokens * r.expected_copies
            drawn[r[margin]] = drawn.get(r[margin], 0) + r.n_tokens * r.copies
        norm = sum(n**power for n in own.values())
        for c, n in own.items():
            assert abs(got[c] / sum(got.values()) - n**power / norm) < 1e-4
            assert abs(drawn[c] / sum(drawn.values()) - n**power / norm) < 0.05
    found = mi.repeated(docs)
    assert found.count() == sum(r.copies for r in rows) and found.columns == docs.columns


def test_mixing_stands_awkward_rows(awkward, no_docs):
    rows = mi.with_probability(awkward, powers={"source": 1, "lang": 1, "topic": 1})
    found = rows.collect()
    assert len(found) == awkward.count()
    assert all(r.probability == 0 and not r.sampled for r in found if r.n_tokens == 0)
    assert mi.sample(awkward, powers={"source": 1, "lang": 1, "topic": 1}).columns == awkward.columns
    assert mi.with_probability(awkward).count() == awkward.count()
    assert mi.sample(no_docs).count() == 0 and mi.mixture(no_docs).count() == 0


def plain_judge(url):
    url = url or ""
    host, path = "", ""
    if "://" in url:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    best = None
    for entry, verdict in ur.RULES.items():
        h, p = entry.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(entry) > len(best[0])):
            best = (entry, verdict)
    blocked = re.search(rf"(^|[.-])({'|'.join(ur.BLOCKED_WORDS)})([.:-]|$)", host)
    return host, path, best and best[0], best[1] if best else "block" if blocked else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "http://example.org/", "http://example.org/es/x?y=1", "https://m.example.org/en/12#t",
    "http://notexample.org/es/", "http://org/", "http://x.com/fr/1", "http://x.com/de", "http://x.com/de/", "http://com/de/?a://b", "http://www.cheap-pills.net/x",
    "http://spam.net:80/", "http://spamfarm.net/", "http://user@adult-x.net?q", "a://b://c/", "http://..org//", "http://ÄB.org/é", "http://x.org\n/y", "http://example.org/en/2",
]


def test_urls_match_plain_rules(spark):
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    found = as_dict(ur.judge(pages), "page_id")
    for k, u in enumerate(URLS):
        r = found[k]
        assert (r.host, r.path, r.rule, r.verdict) == plain_judge(u), u
    assert ur.judge(pages.limit(0)).count() == 0
    assert ur.judge(pages.unionAll(pages)).count() == 2 * len(URLS)


def test_collisions_never_decide(monkeypatch, scratch):
    monkeypatch.setattr(ur.xxhash, "xxh64_intdigest", lambda x: 7)
    array = ur.DigestArray(ur.write_array({"a/": "block", "b/": "allow", "c/d": "block"}, scratch))
    assert array.probe([b"b/", b"z/", b"c/d", b"a/"]) == {0: "allow", 2: "block", 3: "block"}
    assert ur.DigestArray(ur.write_array({}, scratch)).probe([b"a"]) == {}


def test_a_list_beyond_the_bound_is_split(spark, monkeypatch):
    monkeypatch.setattr(ur, "MAX_ENTRIES", 2)
    pages = spark.createDataFrame([(k, f"http://ads{'-' * (k % 2)}{'.x' * k}.ads.net/") for k in range(9)], "page_id long, url string")
    assert [r.verdict for r in ur.judge(pages).collect()] == ["block"] * 9
