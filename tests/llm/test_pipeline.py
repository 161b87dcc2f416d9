import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tabulark.llm import op1_langid, op5_packing, op7_secrets

from .test_operators import near_by_brute_force

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in op1_langid.predict(docs, op1_langid.fit(op1_langid.training(docs))).where("lang_pred != 'und' and score >= 0.1").collect()}
    step = {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF).cache()
        if name != "packing":
            assert new.columns == docs.columns
        step[name], docs = new, new
    assert {r.doc_id for r in step["language ID"].collect()} == known
    first = sorted(known)
    label = near_by_brute_force([texts[i] for i in first])
    assert {r.doc_id for r in step["near-dedup"].collect()} == {first[k] for k in label}
    kept = {r.doc_id: r.text for r in step["secret scan"].collect()}
    assert kept == {i: op7_secrets.redact(texts[i]) for i in kept}
    assert not any(op7_secrets.base_spans(t) for t in kept.values())
    mixed = Counter(r.doc_id for r in step["mixing"].collect())
    assert set(mixed) == set(kept)
    encode = op5_packing.ChunkEncoder(op5_packing.tokenizer_path())
    want = sum(n * (len(encode(kept[i])) // 4 + 1) for i, n in mixed.items())
    assert sum(r.length for r in step["packing"].collect()) == want


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept_n int, mix_blocks int, block_tokens int, quota double, piece int, label string"


def _odd_rows():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    texts = [None, "", "  \n", "42 !!", words(60), words(60), words(3), words(30_000), "x" * 60_000, "token: abcdef123456 " + words(40), None]
    texts += [texts[4], texts[9], words(60) + " secret='Zx81kQp0LmT4'"]
    got = [(i, t, "en" if i % 3 else None, ["a", "b", None][i % 3], len(t or ""), 1, 2, 3, 0.5, 4, "l") for i, t in enumerate(texts)]
    return got + [got[5], (None, texts[5], None, None, None, None, None, None, None, None, None), (None,) * 11]


@pytest.mark.parametrize("rows", [_odd_rows(), [], [(None,) * 11]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        alone = stage(spark, spark.createDataFrame(rows, ODD), SF)  # each stage by itself, on all rows
        n = alone.count()
        if name == "packing":
            assert n == sum(1 for r in rows if len(r[1] or "") < 4096) + sum(r.length > 0 for r in alone.collect() if len(dict((x[0], x[1]) for x in rows).get(r.doc_id) or "") >= 4096)
            continue
        assert alone.columns == docs.columns and alone.dtypes == docs.dtypes
        if name == "secret scan":
            assert n == len(rows) and sorted(str(r.text) for r in alone.collect()) == sorted(str(op7_secrets.redact(r[1])) for r in rows)
        if name == "mixing":
            assert {r.doc_id for r in alone.collect()} == {r[0] for r in rows} and n >= len(rows)
        if name == "near-dedup":
            label = near_by_brute_force([r[1] for r in rows])
            assert n == len(set(label))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    left = docs.count()
    assert left == 0 if len(rows) < 2 else left > 4
    assert docs.where(F.col("offset") + F.col("length") > 4096).count() == 0
