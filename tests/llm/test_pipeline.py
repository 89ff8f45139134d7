import os

import pytest

import corpus_pipeline as cp

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]


@needs_tables
def test_stages_chain_like_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, last = spark.read.parquet(str(tmp_path / name)), k == len(cp.STAGES) - 1
        assert last or docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert before is None or (ids == before if last else ids <= before)
        before = ids
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(docs) == key(cp.run(spark, SF))


HARD = [(1, None, "en", "src1", 0), (2, "", None, None, 0), (3, "same text here", "en", "src1", 1), (4, "same text here", "en", "src1", 1), (4, "same text here", "en", "src1", 1), (None, "no id", "en", "x", 1), (5, "z " * 60_000, "fr", "src2", 9)]


@needs_tables
@pytest.mark.parametrize("rows", [HARD, []])
def test_hard_rows(spark, rows):
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _row_key int")
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert k == 4 or out.columns == docs.columns
        out.collect()


def near_misses(seed):
    """Families of edited copies, some above 0.8 and some below, exact copies, and texts alone; ids in no order."""
    import random

    rnd = random.Random(seed)
    words = lambda k: [f"w{rnd.randrange(10**6)}" for _ in range(k)]
    texts = [" ".join(words(rnd.randint(1, 90))) for _ in range(60)]
    for edits in (1, 2, 4, 6, 9):
        base = words(120)
        for _ in range(16):
            text = list(base)
            for at in rnd.sample(range(120), edits):
                text[at] = f"v{rnd.randrange(10**6)}"
            texts.append(" ".join(text))
    texts += [rnd.choice(texts) for _ in range(50)] + ["", "one two", "One  two"]
    ids = rnd.sample(range(1000), len(texts))
    return [(i, t, rnd.choice(["en", "en", "de", None]), rnd.choice(["src0", "src1", "src6", None]), len(t)) for i, t in zip(ids, texts)]


@needs_tables
def test_like_a_plain_pipeline(spark):
    """Every stage by plain loops over about 200 rows; what the chain calls toxic is taken from its scores."""
    import numpy as np
    from test_mix_and_pack import WORD, brute, waste
    from test_near_dedup import closure

    from scriptloom.llm import packing, simhash, toxicity
    from scriptloom.llm.queries import categories

    rows = near_misses(11)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labelled = spark.read.parquet(f"{SF}/documents.parquet").select(docs.columns)
    real = [tuple(r) for r in labelled.collect()]
    rows += [(r[0] + 10_000, *r[1:]) for r in real]
    docs = spark.createDataFrame(rows, docs.schema)

    chain = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), categories())
    scored = toxicity.score(docs, chain).collect()
    toxic = {r.doc_id for r in scored if any(r[f"p_{c}"] >= toxicity.REJECT for c in categories())}
    left = [r for r in rows if r[0] not in toxic]
    stage = cp.reject_toxic(spark, docs, SF)
    assert sorted(r.doc_id for r in stage.collect()) == sorted(r[0] for r in left)

    largest = {}
    for r in left:
        largest[r[1]] = max(largest.get(r[1], -1), r[0])
    left = [r for r in left if largest[r[1]] == r[0]]
    docs = cp.drop_exact(spark, stage, SF)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in left)

    def shingles(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r[0]: shingles(r[1]) for r in left}
    ids = sorted(sets)
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    group = closure(ids, [(a, b) for a in ids for b in ids if b < a and alike(sets[a], sets[b])])
    assert len(set(group.values())) < len(ids) - 10 and simhash.SIMILAR_320.width == 5
    left = [r for r in left if group[r[0]] == r[0]]
    docs = cp.drop_near(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(r[0] for r in left)

    domain = lambda s: f"d{int(s[3:]) % 4}" if s else "d"
    taken = {r[0] for r in brute([(r[0], r[1], r[2], r[3]) for r in left], cp.MIX, domain) if r[-1]}
    left = [r for r in left if r[0] in taken]
    docs = cp.mix_sources(spark, docs, SF)
    assert sorted(r.doc_id for r in docs.collect()) == sorted(taken)

    packed = cp.pack_batches(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.tokens) for r in packed) == sorted((r[0], len(WORD.findall(r[1] or ""))) for r in left)
    lengths, counts = np.unique([r.tokens for r in packed], return_counts=True)
    assert sum(r.padding for r in packed) == waste(lengths, counts, packing.best_boundaries(lengths, counts, packing.Packing().buckets))
