"""The pipeline on a small corpus, each stage held against a plain version on its own input."""

import random

import corpus_pipeline
import numpy as np
from cadenza.llm import exact_dedup, langid, mixing, packing, simhash
from pyspark.sql import functions as F

from .test_dedup import brute_components, brute_fingerprint, edited, sentence


def corpus(spark, path):
    rng = random.Random(11)
    base = sentence(rng, 150)
    texts = [sentence(rng, 80) for _ in range(40)] + [edited(rng, base) for _ in range(8)] + ["copy " + sentence(random.Random(1), 30)] * 5
    texts += ["123 456", "", None, " \n", "x" * 3000, sentence(rng, 3000)]
    rows = [(n, t, "en", ["a", "b", None][n % 3], len(t or "")) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return {n: t for n, t, *_ in rows}


def test_stages(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        at = f"{tmp_path}/{len(seen)}.parquet"
        out.write.parquet(at)
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.read.parquet(at)
        seen.append(name)
        if name == corpus_pipeline.STAGES[-1][0]:
            rows = docs.collect()
            words = packing.WordIds(packing.default_tokenizer())
            lengths = {i: len(words.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in before.items()}
            got = {}
            for r in rows:
                got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
            assert got == lengths and max(r["offset"] + r["length"] for r in rows) <= 2048
            continue
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language ID":
            # No letter, or one letter over and over: no language covers a fifth of those n-grams.
            assert set(before) - set(after) == {i for i, t in texts.items() if not any(c.isalpha() for c in t or "") or set(t) == {"x"}}
        elif name == "exact dedup":
            keep = {}
            for i, t in before.items():
                keep[t] = max(i, keep.get(t, i))
            assert set(after) == set(keep.values())
        elif name == "SimHash near-dedup":
            want = brute_components([(i, brute_fingerprint(t)) for i, t in before.items()])
            assert set(after) == set(want.values())
        else:
            rows = spark.createDataFrame([(i, t, None) for i, t in before.items()], "doc_id long, text string, source string")
            assert set(after) <= set(before) and rows.count() == len(before)
            for i, t in after.items():
                pieces = set(before[i].split())
                assert set(t.split()) <= pieces and len(t.split()) <= 2 * len(before[i].split())
            total = sum(len(t.split()) for t in after.values())
            assert abs(total - 1.5 * sum(len(t.split()) for t in before.values())) <= 3 * mixing.BLOCK
    assert seen == [n for n, _ in corpus_pipeline.STAGES]


def test_stages_keep_rows_of_null_and_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    got = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    exact = exact_dedup.drop_exact_copies
    assert got(exact(make([(None, "a"), (9, "a"), (None, "z")]))) == sorted([(9, "a"), (None, "z")], key=str)
    assert got(exact(make([(1, "a"), (1, "b"), (2, "a")]))) == [(1, "b"), (2, "a")]
    assert got(exact(make([(1, "a"), (1, "a"), (None, "q"), (None, "q")]))) == [(1, "a"), (None, "q")]
    unlabelled = make([(None, "a"), (3, "é 1"), (4, "12 !"), (4, "b")]).withColumn("lang", F.lit(None).cast("string"))
    assert got(langid.drop_undetermined(unlabelled)) == sorted([(None, "a"), (3, "é 1"), (4, "b")], key=str)
    one, other = "one two three four five", "lonely words stand over here"
    near = simhash.drop_near_copies
    assert got(near(make([(5, one), (5, other), (1, one)]))) == [(1, one), (5, other)]
    long = " ".join(f"w{n}" for n in range(200))
    rows = [(None, long), (None, "p q r"), (7, long + " end"), (7, "x y"), (8, long), (8, long)]
    mixed = got(mixing.mixed_documents(make(rows), block=1))
    assert [i for i, _ in mixed] == [7, 7, 8, 8, None, None]
    words = {t: len(t.split()) for _, t in rows}
    for i, t in mixed:
        assert any(j == i and set(t.split()) <= set(o.split()) and len(t.split()) <= 2 * words[o] for j, o in rows)


def test_run_chains_the_stages(spark, tmp_path):
    corpus(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and np.all([r["length"] > 0 for r in rows])
    assert corpus_pipeline.ORACLE_SQL is None
