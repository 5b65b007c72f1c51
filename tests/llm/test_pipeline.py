"""The corpus pipeline: each stage on its own input, against brute force."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partigrid.llm import quality, simhash

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], DATA).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def test_columns(staged):
    for docs in staged[1:-1]:
        assert docs.columns == staged[0].columns
    assert staged[-1].columns[:3] == ["doc_id", "start", "length"]


def test_quality_stage_keeps_good_documents(spark, staged):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where(quality.held_out())
    kept = staged[1].select("doc_id").withColumn("kept", F.lit(1))
    n = labels.join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r.quality: r.share for r in n}
    assert share[1] > 0.97 and share[0] < 0.25


def test_language_stage(spark, staged):
    """Everything in a learned language stays; other scripts, noise and texts without a letter go; missing labels are filled."""
    assert staged[2].count() == staged[1].where(F.col("text").rlike(r"\p{L}")).count()
    assert staged[2].where("lang is null").count() == 0
    odd = [(10**6, "абвгд ежзий клмн опрс туфх цчшщ " * 20, None), (10**6 + 1, "12345 !? " * 30, "en"), (10**6 + 2, None, "en"), (10**6 + 3, "the and of", None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(1).cast("long"))
    rows = staged[1].unionByName(odd)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, rows, DATA).collect()}
    assert [i in kept for i in range(10**6, 10**6 + 4)] == [False, False, False, True] and kept[10**6 + 3] == "en"
    french = corpus_pipeline.language_stage(spark, rows, DATA, languages=("fr",))
    assert 0 < french.count() < staged[2].count() / 3 and french.where("lang = 'fr'").count() > 0.99 * french.count()


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_one_of_similar_documents_stays(staged):
    rows = {r.doc_id: r.text or "" for r in staged[2].select("doc_id", "text").collect()}
    kept = {r.doc_id for r in staged[3].select("doc_id").collect()}
    sets, near = {i: shingles(t) for i, t in rows.items()}, {}
    ids = sorted(rows)
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    for i in ids:
        for j in {j for s in sets[i] for j in by[s] if j < i}:
            near[i, j] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    texts = [" ".join(rows[i].lower().split()) for i in kept]
    assert len(set(texts)) == len(texts)
    both = lambda low: [i in kept and j in kept for (i, j), s in near.items() if low <= s < 1]
    assert len(both(0.8)) > 10 and sum(both(0.8)) == 0
    alike = {i for (a, b), s in near.items() if s >= 0.8 for i in (a, b)}
    assert set(rows) - kept <= alike


def test_mix_and_packing_stages(staged):
    words = lambda df: df.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))).first()[0]
    assert abs(words(staged[4]) / words(staged[3]) - 1) < 0.02
    pieces = staged[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("own")).collect()
    copies = {r.doc_id: r["count"] for r in staged[4].groupBy("doc_id").count().collect()}
    assert {r.doc_id: r.n for r in pieces} == {r.doc_id: r.own * copies[r.doc_id] for r in pieces} and len(pieces) == len(copies)


def test_run_on_an_empty_table_with_clashing_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0).withColumn("score", F.lit("x")).withColumn("text_hash", F.lit(1.5)).withColumn("lang_pred", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{DATA}/labels.parquet", f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_are_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).withColumn("score", F.lit("x")).withColumn("text_hash", F.lit(1.5)).withColumn("_copies", F.lit(1)).withColumn("place", F.lit(2))
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, DATA)
        assert out.dtypes == docs.dtypes and out.count() > 0


def test_near_duplicates_are_found_by_fingerprints_first(spark, monkeypatch):
    """Classes of fingerprints are checked by shingles and join texts without the wider search; that one adds the others."""
    rng = np.random.default_rng(11)

    def edited(words, n):
        at = set(rng.choice(len(words), n, replace=False).tolist())
        return " ".join(f"x{rng.integers(10**9)}" if i in at else w for i, w in enumerate(words))

    long = [edited([f"l{i}" for i in range(6000)], 1) for _ in range(12)]  # fingerprints alike, shingles alike
    same = [" ".join(["v w x y z"] * 2000 + [f"r{i}x{k}" for k in range(60)]) for i in range(6)]  # shingles differ
    far = [edited([f"f{i}" for i in range(400)], 3) for _ in range(6)]  # fingerprints differ
    texts = [*long, *same, *far]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    coded = {r.doc_id: r["class"] for r in simhash.near_duplicates(docs).collect()}
    assert len({coded[i] for i in range(12)}) == len({coded[i] for i in range(12, 18)}) == 1 and len({coded[i] for i in range(18, 24)}) > 1
    similar = lambda i, j: 9 * len(shingles(texts[i]) & shingles(texts[j])) >= 4 * (len(shingles(texts[i])) + len(shingles(texts[j])))
    assert similar(0, 11) and similar(18, 23) and not any(similar(12, j) for j in range(13, 18))
    kept = lambda: sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, DATA).collect())
    assert kept() == [0, *range(12, 18), 18]

    def none(flush):
        def run(batches):
            for _ in batches:
                pass
            yield from ()

        return run

    monkeypatch.setattr(simhash, "_meet", none)
    alone = kept()
    assert alone[:7] == [0, *range(12, 18)] and len(alone) > 8


def test_pairs_of_fingerprint_classes_are_not_compared_again(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (5, 6)], "a long, b long")
    same = spark.createDataFrame([(1, 2), (1, 3), (0, 5), (2, 5)], "a long, b long")
    assert sorted(map(tuple, simhash._apart(pairs, same).collect())) == [(3, 4), (4, 5), (5, 6)]
