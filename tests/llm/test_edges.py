"""Every registered training-data query on tables of edge cases, and on empty ones."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__

ROWS = {"op7_maxscore": 100, "op8_url_filters": 54, "op9_warc": 54, "op2_packing": None, "pipeline": None}
NAMES = sorted(q for q in __spark_entry__.queries() if q.startswith("op") or q == "pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("edges")
    rng = np.random.default_rng(0)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60_000))
    rows = [
        (1, long, "en", "s1", 1), (2, long[:-5], "en", None, 1), (3, "x" * 200_000, "fr", "s1", 1), (4, "a\n" * 50_000, None, "s2", 1), (5, None, None, None, None), (6, "", "en", "s1", 0),
        (None, None, None, None, None), (None, "some words here", None, "s1", 3), (7, "emoji 😀 \x00\x01 ctrl   sep", None, "s1", 3), (8, " ", "de", "s9", 1), (8, " ", "de", "s9", 1),
        (9, "é" * 50_000, "de", "s9", 1), (10, "<|endoftext|> <|startoftext|>", "de", "s9", 1), *[(20 + i, "the very same text of some words", "en", "hot", 1) for i in range(60)],
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "lang_pred", "text_hash", "fp", "copies", "class", "p", "size", "group", "ids"):
        docs = docs.withColumn(c, F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0), (6, 0, 0), (999, 1, 1), (20, 1, 0), (20, 0, 0), (21, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    pages = [(1, "u", long), (2, None, None), (None, None, None), (3, "http://é.net/\x00", "")] + [(10 + i, "http://a.net/x", "same") for i in range(50)]
    vectors = [(i, [0.5] * 8) for i in range(100)] + [(100, None), (120, [float("inf")] * 8), (None, [1.0])]
    out = {
        "documents": docs, "labels": labels, "pages": spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("host", F.lit(1)),
        "embeddings": spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("qb", F.lit(1)),
    }
    for name, df in out.items():
        df.write.parquet(f"{base}/some/{name}.parquet")
        df.limit(0).write.parquet(f"{base}/none/{name}.parquet")
    return str(base), len(rows)


@pytest.mark.parametrize("name", NAMES)
def test_edge_cases(spark, tables, name):
    base, n_docs = tables
    n = __spark_entry__.queries()[name](spark, f"{base}/some").count()
    want = ROWS.get(name, n_docs)
    assert n == want if want is not None else n >= n_docs // 8


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tables, name):
    assert __spark_entry__.queries()[name](spark, f"{tables[0]}/none").count() == 0


@pytest.fixture(scope="module")
def rows(spark, tables):
    """Result rows of a query on the edge tables, and (doc_id, text, source) of its documents."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{tables[0]}/some/documents.parquet").collect()]
    return docs, lambda name: __spark_entry__.queries()[name](spark, f"{tables[0]}/some").collect()


def ids_of(name, text, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = ids_of.known.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)))
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


ids_of.known = {}


def test_values_of_token_ids(rows):
    docs, run = rows
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t, _ in docs for x in [ids_of("byte_bpe_50k.json", t, 0)])
    got = sorted(run("op1_token_store"), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda i: (i is not None, i or 0))
    pieces = Counter()
    for r in run("op2_packing"):
        pieces[r.doc_id, r.doc_tokens] += r.length
    want = Counter()
    for i, t, _ in docs:
        n = len(ids_of("word_bpe_49k.json", t, 1))
        want[i, n] += n
    assert pieces == want


def test_values_of_fingerprints(rows):
    docs, run = rows
    from partigrid.llm.simhash import simhash

    fps = {t: f"{simhash((t or '').encode()):016x}" for _, t, _ in docs}
    got = run("op3_simhash")
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((i, fps[t]) for i, t, _ in docs)
    assert fps[None] == fps[""] == fps[" "] == "0" * 16
    by = {}
    for r in got:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(c) == 1 for c in by.values()) and by["0" * 16] == {5} and by[fps["the very same text of some words"]] == {20}
    near = run("op5_fingerprints")
    assert Counter((r.doc_id, r.n_chars) for r in near) == Counter((i, len(t or "")) for i, t, _ in docs)
    same = {r.fingerprint for r in near if r.doc_id in range(20, 80)}
    assert len(same) == 1 and sum(r.near_next == 1 for r in near if r.doc_id in range(21, 80)) == 59


def test_values_of_scores(rows):
    docs, run = rows
    texts = {}
    for i, t, _ in docs:
        texts.setdefault(i, []).append(t)
    quality_, lang = run("op4_quality"), run("op6_language")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in quality_)
    assert len({r.score for r in quality_ if r.doc_id in range(20, 80)}) == 1 and len({r.score for r in quality_ if r.doc_id in (5, 6)}) == 1
    learned = {"en", "fr", "de"}
    for r in lang:
        letters = any(c.isalpha() for t in texts[r.doc_id] for c in t or "")
        assert 0 <= r.score <= 1 and (r.doc_id is None or r.lang_pred in (learned if letters else {"und"}))


def test_values_of_pages(spark, tables, rows):
    _, run = rows
    pages = spark.read.parquet(f"{tables[0]}/some/pages.parquet").collect()
    data = [(r.page_id, (r.html or "").encode()) for r in pages]
    last = {}
    for i, d in data:
        last[d] = max((x for x, e in data if e == d and x is not None), default=None)
    sha = lambda d: base64.b32encode(hashlib.sha1(d).digest()).decode()
    want = Counter((i, len(d), sha(d), "response" if last[d] in (i, None) else "revisit", None if last[d] in (i, None) else last[d]) for i, d in data)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in run("op9_warc")) == want
    hosts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run("op8_url_filters")}
    assert hosts[1] == hosts[2] == hosts[None] == ("", "", None, "allow") and hosts[3] == ("é.net", "/\x00", "net/", "block") and hosts[10] == ("a.net", "/x", "net/", "block")
    for r in run("op7_maxscore"):
        assert r.score == 8 * 32 * 32 and r.query_id % 20 == 0 and r.vec_id == [i for i in range(100) if i != r.query_id][r["rank"] - 1]


def test_values_of_the_mix(rows):
    docs, run = rows
    got = run("op10_mix")
    size = lambda t: len((t or "").encode().split())
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, size(t), s) for i, t, s in docs)
    for s in {s for _, _, s in docs}:
        own = [r for r in got if r.source == s]
        total = sum(r["size"] for r in own)
        assert all(r.source_size == total and r.target <= 3 * total + 1e-6 and r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in own)
    assert sorted(map(str, got)) == sorted(map(str, run("op10_mix")))
