import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptloom.llm import ftrl, lm_score, quality, queries, toxicity

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
HARD = [(1, None), (2, ""), (3, " \n"), (4, "ab " * 40_000), (4, "ab"), (None, "ab"), (5, "Éa 日本 !!!")]


def test_ftrl_learns_a_line():
    rng = np.random.default_rng(0)
    rows = [(np.sort(rng.choice(50, 5, replace=False)), np.ones(5)) for _ in range(600)]
    y = np.array([float(3 in i or 7 in i) for i, _ in rows])
    w = ftrl.train(rows, y, 50, ftrl.Ftrl(l1=0.5))
    assert {3, 7} == set(np.argsort(w[:50])[-2:]) and np.mean([(ftrl.dot(r, w) > 0) == t for r, t in zip(rows, y, strict=True)]) > 0.97
    p = ftrl.out_of_fold(rows, y, np.arange(600) % 4, 50, ftrl.Ftrl())
    assert np.mean((p > 0.5) == y) > 0.95


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [r for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in held]) >= 0.9
    # held-out labels don't matter, nor do other columns
    changed = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (quality.fit(docs, changed) == quality.fit(docs.withColumn("lang", F.lit("x")), labels)).all()


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.where("doc_id % 4 > 0"), queries.categories())
    assert chain.categories == ("toxic", "toxic_junk") and chain.links[0].any() == np.False_
    scored = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    held = labels.where("doc_id % 4 = 0").collect()
    flagged = [r for r in held if scored[r.doc_id].toxic]
    assert len(scored) == docs.count() and np.mean([r.toxic for r in flagged]) > 0.8
    english = {r.doc_id for r in docs.where("lang = 'en'").collect()}
    assert np.mean([scored[r.doc_id].toxic for r in held if r.toxic and r.doc_id in english]) > 0.6
    kept = toxicity.drop_toxic(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(not r.toxic for r in scored.values())


def test_hard_rows(spark):
    df = spark.createDataFrame([(i, t, 1.0, True) for i, t in HARD], "doc_id long, text string, score double, toxic boolean")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 1, 1), (2, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.score(df, quality.fit(df, labels)).collect()
    assert len(rows) == len(HARD) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    chain = toxicity.fit(df, labels, queries.categories())
    assert toxicity.score(df, chain).count() == len(HARD)
    none = df.where("false")
    for part in (quality.score(none, quality.fit(none, labels)), toxicity.score(none, toxicity.fit(none, labels, queries.categories())), lm_score.score(none)):
        assert part.count() == 0


def plain_ftrl(rows, labels, bias, how):
    """FTRL-proximal over dicts, weight by weight."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= how.l1:
            return 0.0
        return (math.copysign(how.l1, z[i]) - z[i]) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    rng = np.random.default_rng(how.seed)
    for _ in range(how.epochs):
        for r in rng.permutation(len(rows)):
            x = {**rows[r], bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - labels[r]) * x[i]
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / how.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def plain_score(row, w, bias):
    return 1 / (1 + math.exp(-(sum(w.get(i, 0.0) * x for i, x in row.items()) + w.get(bias, 0.0))))


def plain_quality_features(text):
    """Counts of single tokens and pairs by the top 20 bits of their hashes, scaled to length 1."""
    hashes = []
    for token in re.findall(r"\w+|[^\w\s]+", text or ""):
        hashes.append(xxhash.xxh64_intdigest("\x01capitals" if len(token) > 1 and token.isupper() else token.lower().encode()))
    pairs = [0 if a == b else (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) % 2**64 for a, b in zip(hashes, hashes[1:], strict=False)]
    counts = Counter(h >> 44 for h in hashes + pairs)
    length = max(1.0, math.sqrt(sum(c * c for c in counts.values())))
    return {i: c / length for i, c in counts.items()}


def plain_toxicity_features(text):
    out = {}
    for w in re.findall(r"\w+", (text or "").lower()):
        for part in [w, *("\x01" + w[:k] for k in range(4, 9) if len(w) >= k)]:
            out[xxhash.xxh64_intdigest(part.encode()) >> 44] = 1.0
    return out


def model_rows():
    rng = np.random.default_rng(8)
    vocabulary = [f"{a}{b}" for a in ("good", "plain", "insult", "JUNK", "word") for b in range(12)]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(3, 30))) + "!" * (i % 3)) for i in range(90)]
    labels = [(i, int("JUNK" not in t), int(t.count("insult") > 3)) for i, t in docs]
    return docs + [(90, None), (91, ""), (92, "Éa 日本 !!!"), (93, "word " * 30_000)], labels


def test_quality_by_plain_loops(spark):
    docs, labels = model_rows()
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    df, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chosen = [(plain_quality_features(t), q) for (i, t), (_, q, _) in zip(docs, labels, strict=False) if not held(i)]
    w = plain_ftrl([x for x, _ in chosen], [q for _, q in chosen], "bias", quality.SETTINGS)
    got = {r.doc_id: r for r in quality.score(df, quality.fit(df, known)).collect()}
    assert len({round(got[i].score, 2) for i in got}) > 10
    for i, t in docs:
        assert got[i].score == pytest.approx(plain_score(plain_quality_features(t), w, "bias"), abs=1e-5)
        assert got[i].held_out == held(i)


def test_chain_by_plain_loops(spark):
    docs, labels = model_rows()
    df, known = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = [plain_toxicity_features(t) for _, t in docs[:90]]
    toxic = [float(t) for _, _, t in labels]
    junk = [float(t and not q) for _, q, t in labels]
    first = plain_ftrl(rows, toxic, "bias", toxicity.SETTINGS)
    seen = {}
    for fold in range(toxicity.FOLDS):
        others = [k for k in range(90) if k % toxicity.FOLDS != fold]
        w = plain_ftrl([rows[k] for k in others], [toxic[k] for k in others], "bias", toxicity.SETTINGS)
        seen |= {k: plain_score(rows[k], w, "bias") for k in range(fold, 90, toxicity.FOLDS)}
    second = plain_ftrl([{**rows[k], "p0": seen[k]} for k in range(90)], junk, "bias", toxicity.SETTINGS)
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.fit(df, known, queries.categories())).collect()}
    assert max(r.p_toxic for r in got.values()) > 0.5 > min(r.p_toxic for r in got.values())
    for i, t in docs:
        p = plain_score(plain_toxicity_features(t), first, "bias")
        q = plain_score({**plain_toxicity_features(t), "p0": p}, second, "bias")
        assert (got[i].p_toxic, got[i].p_toxic_junk) == pytest.approx((p, q), abs=1e-4)
        assert got[i].toxic == (max(got[i].p_toxic, got[i].p_toxic_junk) >= toxicity.REJECT)


def test_an_id_that_repeats_is_one_training_row(spark):
    docs, labels = model_rows()
    df, known = spark.createDataFrame(docs + [(0, "another text")] * 50, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows, y = ftrl.labelled_sample(df, known.select("doc_id", "toxic"), ["toxic"], toxicity.features, 1000, "doc_id", "text")
    assert len(rows) == len(y) == 90


def brute_scores(rows, min_count):
    docs = [[w for w in (t or "").encode().lower().split()] for _, t in rows]
    one, two = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:], strict=False))
    n = sum(one.values())
    out = []
    for d in docs:
        s = math.log(one[d[0]] / n) if d else 0.0
        for v, w in zip(d, d[1:], strict=False):
            s += math.log(two[v, w] / one[v]) if two[v, w] >= min_count else math.log(0.4 * one[w] / n)
        out.append((len(d), round(s, 6)))
    return out


@pytest.mark.parametrize("small, min_count", [(False, 1), (True, 1), (True, 2)])
def test_stupid_backoff(spark, monkeypatch, small, min_count):
    """With tiny runs and buckets, and with thresholds under which nothing or nearly everything is frequent."""
    if small:
        monkeypatch.setattr(lm_score, "RUN_WORDS", 50)
        monkeypatch.setattr(lm_score, "BUCKET_PAIRS", 64)
        monkeypatch.setattr(lm_score, "WORD_BITS", 5)
        monkeypatch.setattr(lm_score, "PAIR_BITS", 3)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice([f"w{k}" for k in range(40)], rng.integers(0, 60), p=np.array([1 / (k + 1) for k in range(40)]) / sum(1 / (k + 1) for k in range(40))))) for i in range(60)] + HARD
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, row int").repartition(3)
    got = lm_score.score(df, min_count).collect()
    expected = sorted((-1 if i is None else i, *s) for (i, _), s in zip(rows, brute_scores(rows, min_count), strict=True))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.log_score) for r in got)
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert [f[2] for f in found] == pytest.approx([e[2] for e in expected], abs=1e-5)
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
