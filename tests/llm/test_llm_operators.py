"""Training-data operators against brute force, round trips and held-out accuracy, and their edge cases on small tables."""

import base64
import datetime
import functools
import hashlib
import io
import math
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from partigrid.llm import common, cube, langid, maxscore, packing, quality, quartile, simhash, token_store, urlrules, warc

DATA = "/root/testdata/sf0.001"
TEXTS = ["", None, "one", "One two  three\n\nfour", "a " * 3000, "x\ty z <|endoftext|>", "é ß 日本 語 ́", "same text here again", "same text here again", "w" * 900 + " end", " lead and trail "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "s1", "s2"][i % 3], datetime.date(2024, 1, 1), 0.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s1", None, None), (7, "same text here again", "en", "s1", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score date, fp double")


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.where("false")


@functools.cache
def plain_tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def tokens(name, text, end):
    return plain_tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokenizer_is_exact(spark, name):
    import public_tokenizers

    tok = common.CachedTokenizer(public_tokenizers.path(name), max_words=500)
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + [t or "" for t in TEXTS]
    for _ in range(2):
        for s in range(0, len(texts), 40):
            got = tok.encode(texts[s : s + 40])
            want = [e.ids for e in tok.tok.encode_batch(texts[s : s + 40], add_special_tokens=False)]
            assert [x.tolist() for x in got] == want


def test_long_words_with_one_hash_are_told_apart(monkeypatch):
    import public_tokenizers

    key = common.WordTable.key

    def weak(buffer, starts, ends):
        out = key(buffer, starts, ends)
        out[0][ends - starts > 16] = 7
        return out

    monkeypatch.setattr(common.WordTable, "key", staticmethod(weak))
    tok = common.CachedTokenizer(public_tokenizers.path("byte_bpe_50k.json"), max_words=6)
    words = [f"beginning{x}theending" for x in ("one", "two", "six", "three", "sevenandeight")]
    for texts in [[f"x {w} y"] for w in words] * 2 + [[f"x {w} y {w}" for w in words], [" ".join(["a", *words, *words])]] * 2 + [[f"q{i} w{i}" for i in range(9)], [f"x {words[1]}"]]:
        assert [x.tolist() for x in tok.encode(texts)] == [e.ids for e in tok.tok.encode_batch(texts, add_special_tokens=False)]


def test_repeats_are_numbered_whatever_the_slices():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 40, 3000).astype(np.uint64) * np.uint64(1 << 58)
    for cuts in ([0, 3000], [0, 1, 2, 700, 701, 3000]):
        count, seen = common.Repeats(), {}
        got = np.concatenate([count.number(keys[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)])
        for k, n in zip(keys.tolist(), got.tolist(), strict=True):
            assert n == seen.get(k, 0)
            seen[k] = n + 1
    assert len(common.Repeats().number(keys[:0])) == 0


def test_store_round_trip(spark, docs, no_docs, tmp_path):
    store = f"file://{tmp_path}/store"
    token_store.write_store(docs, store, "byte_bpe_50k.json", end_id=0)
    rows = token_store.read_documents(spark, store).orderBy("start").collect()
    whole = token_store.read_documents(spark, store, with_ids=True).orderBy("start").collect()
    want = sorted([(i, tokens("byte_bpe_50k.json", t, 0)) for i, t in [(r.doc_id, r.text) for r in docs.collect()]], key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    start = 0
    assert sorted(zlib.crc32(np.array(ids, "<u4").tobytes()) for _, ids in want) == sorted(r.ids_crc32 for r in rows)
    assert sorted(str(ids) for _, ids in want) == sorted(str(r.ids) for r in whole)
    for (i, _), r in zip(want, rows, strict=True):
        assert (r.doc_id, r.start) == (i, start)
        start += r.n_tokens
    token_store.write_store(no_docs, f"file://{tmp_path}/none", "byte_bpe_50k.json", end_id=0)
    assert token_store.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_store_of_whole_documents(spark, tmp_path):
    docs, store = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), f"file://{tmp_path}/store"
    token_store.write_store(docs, store, "byte_bpe_50k.json", end_id=0)
    sums = {r.doc_id: r for r in token_store.read_documents(spark, store).collect()}
    whole = {r.doc_id: r for r in token_store.read_documents(spark, store, with_ids=True).collect()}
    start = 0
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        ids = tokens("byte_bpe_50k.json", r.text, 0)
        assert whole[r.doc_id].ids == ids and whole[r.doc_id].start == sums[r.doc_id].start == start
        assert sums[r.doc_id].n_tokens == len(ids) and sums[r.doc_id].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_store_keeps_shared_passages_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    passage = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 4000))
    docs = spark.createDataFrame([(i, f"start {i} " + passage) for i in range(20)], "doc_id long, text string").repartition(4)
    made = token_store.write_store(docs, f"file://{tmp_path}/s", "byte_bpe_50k.json", end_id=0)
    assert made["packs"]["n_ids"] < made["recipes"]["n_ids"] / 8
    assert sorted(x.name for x in (tmp_path / "s").iterdir()) == ["manifest.json", "pack-index", "packs", "recipe-index", "recipes"]
    size = {d: sum(f.stat().st_size for f in (tmp_path / "s" / d).iterdir()) for d in ("packs", "recipes")}
    assert size["packs"] < 1.2 * 2 * made["packs"]["n_ids"]


def test_store_of_equal_rows_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "RECIPES", 100)
    docs = spark.range(0, 6000, 1, 12).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    docs = docs.union(spark.range(300).select("id", F.concat(F.lit("text "), "id")))
    store = f"file://{tmp_path}/e"
    token_store.write_store(docs, store, "byte_bpe_50k.json", end_id=0)
    per_part = [r.n for r in spark.read.parquet(f"{store}/recipe-index").groupBy("part").agg(F.sum("n").alias("n")).collect()]
    assert sum(per_part) == 6300 and max(per_part) <= 2500
    rows = sorted(token_store.read_documents(spark, store).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None] * 6000 + list(range(300))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows[:-1]]]).tolist()


def test_store_notices_damage(spark, docs, tmp_path):
    store = f"file://{tmp_path}/store"
    token_store.write_store(docs, store, "byte_bpe_50k.json", end_id=0)
    path = next((tmp_path / "store" / "packs").iterdir())
    whole = path.read_bytes()
    path.write_bytes(whole[:40] + bytes([whole[40] ^ 1]) + whole[41:])
    with pytest.raises(Exception, match="(?s)digest|Merkle|zstd|decompress"):
        token_store.read_documents(spark, store).collect()
    path.write_bytes(whole)
    manifest = tmp_path / "store" / "manifest.json"
    manifest.write_text(manifest.read_text().replace('"root": "', '"root": "0'))
    with pytest.raises(Exception, match="Merkle"):
        token_store.read_documents(spark, store).collect()


def test_combined_checksums():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 50000, n) for n in (1, 5, 0, 700, 3)]
    group = np.array([0, 0, 1, 2, 2])
    got = token_store.combine_crcs(np.array([common.crc_ids(p) for p in parts]), np.array([len(p) for p in parts]), group)
    assert got.tolist() == [common.crc_ids(np.concatenate([p for p, g in zip(parts, group, strict=True) if g == k])) for k in range(3)]


def pieces_are_whole(rows, want, capacity):
    """Each id of each document stands in one piece, and sequences are filled without gaps; rows with ids, want: all documents' ids."""
    by_seq, by_doc = {}, {}
    for r in rows:
        assert len(r.ids) == r.length > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == np.cumsum([0, *[r.length for r in seq[:-1]]]).tolist()
        n = sum(r.length for r in seq)
        assert n == capacity or n < capacity and n & (n - 1) == 0
    docs = {}
    for i, ids in want:
        docs.setdefault(i, []).append(ids)
    assert set(docs) == set(by_doc)
    for i, pieces in by_doc.items():
        if len(docs[i]) == 1:
            ids, upto = docs[i][0], 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == upto and r.ids == ids[upto : upto + r.length] and r.doc_tokens == len(ids)
                upto += r.length
            assert upto == len(ids)
        else:  # rows with one id: every position of each is covered as often as there are such rows
            seen, held = {}, {}
            for r in pieces:
                for k, x in enumerate(r.ids):
                    seen[r.doc_tokens, r.start + k, x] = seen.get((r.doc_tokens, r.start + k, x), 0) + 1
            for ids in docs[i]:
                for k, x in enumerate(ids):
                    held[len(ids), k, x] = held.get((len(ids), k, x), 0) + 1
            assert seen == held


def test_packing(spark, docs, no_docs):
    rows = packing.pack_documents(docs, "word_bpe_49k.json", end_id=1, capacity=64, with_ids=True).collect()
    pieces_are_whole(rows, [(r.doc_id, tokens("word_bpe_49k.json", r.text, 1)) for r in docs.collect()], 64)
    assert packing.pack_documents(no_docs, "word_bpe_49k.json", end_id=1).count() == 0


def test_packing_of_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = [(r.doc_id, tokens("word_bpe_49k.json", r.text, 1)) for r in docs.select("doc_id", "text").collect()]
    rows = packing.pack_documents(docs, "word_bpe_49k.json", end_id=1, with_ids=True).collect()
    pieces_are_whole(rows, want, 2048)
    assert len({r.sequence_id for r in rows}) * 2048 < 1.02 * sum(len(ids) for _, ids in want) + 12 * 2048


def test_packing_deals_equal_rows_out(spark, monkeypatch):
    docs = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    some = spark.createDataFrame([(i, f"some text of document {i}") for i in range(500)], "doc_id long, text string")
    pack = packing._pack

    def spy(*args):
        run = pack(*args)

        def inner(key, table):
            if table.num_rows > 2 * packing.GROUP_DOCS:
                raise ValueError("a large group")
            return run(key, table)

        return inner

    monkeypatch.setattr(packing, "_pack", spy)
    rows = packing.pack_documents(docs.union(some), "word_bpe_49k.json", end_id=1).agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.sum("length")).first()
    assert rows[1] == 50_000 and rows[0] >= 50_500 and rows[2] == 50_000 + sum(len(tokens("word_bpe_49k.json", f"some text of document {i}", 1)) for i in range(500))


def test_first_fit_decreasing_places_where_it_first_fits():
    rng = np.random.default_rng(3)
    tree, free = packing.CapacityTree(100, 2), []
    for n in sorted(rng.integers(1, 100, 300).tolist(), reverse=True):
        at = next((i for i, f in enumerate(free) if f >= n), len(free))
        if at == len(free):
            free.append(100)
        free[at] -= n
        assert tree.place(n) == at


def brute_classes(fps, limit=3):
    up = list(range(len(fps)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("kind", ["random", "dense", "ball"])
def test_gray_index_links_what_brute_force_links(kind):
    rng = np.random.default_rng(5)
    if kind == "random":
        fps = rng.integers(0, 2**63, 400, np.int64).astype(np.uint64)
    else:
        centre = rng.integers(0, 2**63, 4, np.int64)
        fps = np.array([int(centre[i % 4]) ^ sum(1 << int(b) for b in rng.integers(0, 48 if kind == "dense" else 20, rng.integers(0, 9))) for i in range(700)], np.uint64)
    fps = np.unique(fps)
    order = np.argsort(simhash.gray_rank(fps))
    classes = simhash.Classes(len(fps))
    simhash.GrayIndex(fps[order], order.tolist(), classes).join()
    want = brute_classes([int(f) for f in fps])
    got = [classes.find(i) for i in range(len(fps))]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))
    assert len(classes.links) == len(fps) - len(set(want))


@pytest.mark.parametrize("hot, flush", [(500_000, 200_000), (30, 50), (0, 1)])
def test_links_of_split_blocks(spark, monkeypatch, hot, flush):
    rng = np.random.default_rng(12)
    centres = rng.integers(-(2**63), 2**63 - 1, 30, np.int64)
    few = lambda n: sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {int(c) & (1 << 64) - 1 for c in centres}
    for c in sorted(fps):
        at = c
        for _ in range(6):
            at ^= few(int(rng.integers(1, 6)))
            fps.add(at)
    top = sorted(fps)[3] >> 48 << 48
    fps |= {top | int(x) for x in rng.integers(0, 1 << 48, 300)}  # one block for very many
    fps |= {(f ^ few(3)) for f in sorted(fps)[-40:]}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "FLUSH", flush)
    nodes = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root for r in simhash.connected_components(simhash._gray_links(nodes, 3)).collect()}
    want = brute_classes(fps)
    got = [roots.get(f, f - (f >> 63 << 64)) for f in fps]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got)) < len(fps) - 100


def test_one_of_many_equal_rows_stays(spark):
    docs = spark.range(0, 50_000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("x").alias("row"))
    docs = docs.union(spark.createDataFrame([(3, "a text of five words", "y"), (3, "a text of five words", "z"), (4, "a text of five words", "z")], docs.schema))
    for found in (simhash.near_duplicates(docs), simhash.similar_documents(docs)):
        kept = simhash.keep_first(docs, found)
        assert kept.columns == docs.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("3", "a text of five words"), ("None", None)]


def test_near_duplicates(spark, docs, no_docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    both = rows.unionByName(docs.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 10**6))
    found = {r.doc_id: r for r in simhash.near_duplicates(both).dropDuplicates(["doc_id"]).collect()}
    ids = sorted(found)
    want = brute_classes([found[i].fp & (2**64 - 1) for i in ids])
    assert [found[i].component_id for i in ids] == [ids[w] for w in want]
    assert found[10**6].fp == found[10**6 + 1].fp == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.near_duplicates(docs).count() == docs.count()
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns and kept.where("text = 'same text here again'").count() == 1
    assert sorted(r.doc_id for r in kept.where("text is null or text = ''").collect()) == [0]


def test_similar_documents(spark, docs, no_docs):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(30):
        words = list(base)
        for at in rng.choice(400, 3, replace=False):
            words[at] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join([*base[:100], *[f"y{x}" for x in rng.integers(0, 10**6, 300)]])) for i in range(5)]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(30)} == {0} and all(found[i] == i for i in range(100, 105))
    assert simhash.similar_documents(docs).count() == docs.count() and simhash.similar_documents(no_docs).count() == 0
    kept = simhash.keep_first(docs, simhash.similar_documents(docs))
    assert kept.columns == docs.columns and kept.where("text = 'same text here again'").count() == 1


def shingle_classes(texts):
    """Least place of each text's class by brute force: links where 4/5 of all five-word shingles of two texts are in both."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("cut", [3, 50, 20_000])
def test_keys_of_more_rows_than_are_held_lose_no_link(monkeypatch, cut):
    monkeypatch.setattr(simhash, "CUT", cut)
    rng = np.random.default_rng(2)
    key = np.sort(np.concatenate((np.full(700, 5), np.full(33, 6), np.full(3, 7), rng.integers(8, 400, 300))))
    fp = np.concatenate([np.sort(rng.choice(10**9, n, replace=False)) for _, n in zip(*np.unique(key, return_counts=True), strict=True)])
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(np.full(len(key), 10)), pa.array(np.zeros(len(key), np.int64))], names=["key", "fp", "n", "at"])
    for flush in (10, 100, 695, 10**6):
        batches = [rows.slice(s, 7) for s in range(0, len(key), 7)]
        out = [b for b in simhash._meet(flush)(iter(batches))]
        many = {(k, a) for b in out for k, a in zip(b.column("key").to_pylist(), b.column("a").to_pylist(), strict=True) if k is not None}
        pairs = {(a, c) for b in out for k, a, c in zip(b.column("key").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True) if k is None}
        for k in np.unique(key).tolist():
            own = fp[key == k].tolist()
            whole = all((k, f) in many for f in own)
            assert whole or all((x, y) in pairs for i, x in enumerate(own) for y in own[i + 1 :])


def edited(rng, words, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"x{rng.integers(10**9)}"
    return words


@pytest.mark.parametrize("block", [512, 40])
def test_similar_documents_of_a_shared_passage(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "HELD", 50 * block)
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(150)]
    texts = []
    for i in range(60):  # each pair shares the passage with all texts and most of its own words with one
        own = [*passage, *[f"q{i}x{k}" for k in range(150)]]
        texts += [" ".join(own), " ".join(edited(rng, own, int(rng.integers(2, 9))))]
    base = [f"b{i}" for i in range(200)]
    texts += [" ".join(edited(rng, base, int(rng.integers(2, 8)))) for _ in range(600)]  # some are linked by others only
    texts += [" ".join([*passage, f"e{i}"]) for i in range(40)]
    rows = spark.createDataFrame([(int(i), texts[i]) for i in rng.permutation(len(texts))], "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    want = shingle_classes(texts)
    assert len(set(want[:120])) > 60 and len(set(want[120:720])) > 1
    assert [found[i] for i in range(len(texts))] == want


def test_texts_below_the_limit_stay_apart(spark):
    rng = np.random.default_rng(10)
    texts = []
    for i in range(40):  # an edit in 40 words or so leaves 0.77 of the shingles, in 50 words 0.82
        words = [f"t{i}x{k}" for k in range(400)]
        at = list(range(10, 390, 38 if i % 2 else 48))
        texts += [" ".join(words), " ".join(f"z{rng.integers(10**9)}" if k in at else w for k, w in enumerate(words))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs = simhash.keep_first(rows, simhash.similar_documents(rows))
    want = shingle_classes(texts)
    assert sum(want[i] < i for i in range(80)) == 20
    assert sorted(r.doc_id for r in docs.collect()) == sorted(set(want))


def test_fingerprint_of_words():
    import xxhash

    h = lambda s: xxhash.xxh64_intdigest(s.encode(), 42)
    assert simhash.simhash(b"One\vTWO") == h("one two") and simhash.simhash(b" \n") == 0
    parts = [h("a b c"), h("b c d"), h("c d a"), h("d a b")]
    assert simhash.simhash(b"A b c\nD a b") == sum(1 << b for b in range(64) if 2 * sum(p >> b & 1 for p in parts) > 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(300, 300)]
    found = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(100, 151)} == {100} and 300 not in found


@pytest.mark.parametrize("edges_at_once", [simhash.EDGES, 300])
def test_few_edges_are_one_step(spark, monkeypatch, edges_at_once):
    """Edges that fit in one file take one step behind the first; more go through rounds, and give the same."""
    steps = []
    monkeypatch.setattr(simhash, "EDGES", edges_at_once)
    monkeypatch.setattr(simhash, "stage", lambda df, path, *a, f=simhash.stage: (steps.append(path), f(df, path, *a))[1])
    rng = np.random.default_rng(7)
    edges = [*rng.integers(-900, 900, (700, 2)).tolist(), *[[i, i + 1] for i in range(2000, 2090)], [5000, 5000], [-(2**63), 2**63 - 1]]
    found = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(want)):
        before = dict(want)
        for x, y in edges:
            if x != y:
                want[x] = want[y] = min(want[x], want[y])
        if before == want:
            break
    assert found == want
    assert len(steps) == 2 if edges_at_once > 300 else len(steps) > 2


def test_quality_is_learned(spark, docs, no_docs):
    rows, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(rows.select("doc_id", "text"), labels).join(labels, "doc_id").where(quality.held_out())
    right = scored.agg(F.avg(((F.col("score") >= 0.7) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.93
    out = quality.score_quality(docs, labels, "fresh_score")
    assert out.columns == [*docs.columns, "fresh_score"] and out.where("fresh_score between 0 and 1").count() == docs.count()
    assert quality.score_quality(no_docs, labels, "s").count() == 0
    assert {r.s for r in quality.score_quality(docs, labels.where("quality = 1"), "s").collect()} == {1.0}
    assert {r.s for r in quality.score_quality(docs, labels.where("false"), "s").collect()} == {0.5}


def test_quality_samples_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(1000)] + [(2, "x" * 9000), (3, "small"), (4, None), (None, "no")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (None, 1), (3, None)], "doc_id long, quality int")
    texts, y = quality.sample_labelled(docs, labels, F.lit(True), fit_bytes=1000)
    assert len(texts) == 3 and texts[1:] == ["small", ""] and y == [1, 0, 0]
    assert quality.sample_labelled(docs.repartition(5), labels, F.lit(True), fit_bytes=1000) == (texts, y)
    assert len(quality.sample_labelled(docs, labels, F.lit(True), fit_rows=2)[0]) <= 2


def test_quality_score_is_the_pooled_vectors_through_the_network():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdef"), rng.integers(2, 6)))
    good = [" ".join(word() for _ in range(80)) + "\nlast line" for _ in range(60)]
    bad = [" ".join(w for _ in range(40) for w in [word()] * 2) for _ in range(30)] + ["the same line here\n" * 20 for _ in range(30)]
    model = quality.fit(good + bad, [1] * 60 + [0] * 60)
    kinds = quality.Kinds(model.vocabulary, model.n_forms)
    for text in ["", "a", "a a\na a\nb", good[0], bad[0], bad[-1]]:
        words, total, lines = text.split(), np.zeros(quality.DIM), text.split("\n")
        for i, w in enumerate(words):
            total += model.vectors[kinds[w]]
            total += model.vectors[-4] * (i > 0 and words[i - 1] == w) + model.vectors[-2] * (w in words[:i])
            total += model.vectors[-3] * (w in words[:i] and kinds[w] >= model.n_forms)
        total += model.vectors[-1] * sum(len(x.split()) for i, x in enumerate(lines) if x in lines[:i])
        x = (total / max(len(words), 1) - model.mean) / model.scale
        z = (np.tanh(x @ model.w1 + model.b1) @ model.w2 + model.b2) / model.temperature
        assert model.scores([text], kinds)[0] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-8)
    assert (model.scores(good, kinds) > 0.7).mean() > 0.9 and (model.scores(bad, kinds) < 0.7).mean() > 0.9


def test_languages_are_learned(spark, docs, no_docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    samples, held = langid.sample_languages(rows, ~langid.held_out())
    names = ("guess", "sure", "cost", "ok")
    found = langid.identify_languages(rows, samples, held, names).where(langid.held_out() & (F.length("text") > 40))
    assert found.where("guess = lang").count() > 0.97 * found.count() and found.where("not ok").count() == 0
    out = {r.text: r for r in langid.identify_languages(docs, samples, held, names).collect()}
    assert out[""].guess == out[None].guess == "und" and out[None].sure == 0 and not out[""].ok and len(out[""]) == 10
    assert langid.identify_languages(no_docs, samples, held, names).count() == 0
    none = langid.identify_languages(docs, {})
    assert none.columns == [*docs.columns, "lang_pred", "_score", "bits", "accepted"] and {r.lang_pred for r in none.collect()} == {"und"}


def phrases_by_brute_force(samples, text):
    plain = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
    sample, text, n, at = plain("\n".join(samples)), plain(text), 0, 0
    while at < len(text):
        m = 1
        while at + m < len(text) and text[at : at + m + 1] in sample:
            m += 1
        n, at = n + 1, at + m
    return n


def written_in(rng, letters, n):
    syllables = ["".join(rng.choice(letters, rng.integers(1, 4))) for _ in range(60)]
    return lambda size: " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(size // 6 + n))[:size]


def test_cross_parsing_equals_brute_force_in_three_scripts(monkeypatch):
    rng = np.random.default_rng(6)
    scripts = {"la": [chr(c) for c in range(97, 123)], "ko": [chr(c) for c in range(0xAC00, 0xAC00 + 900)], "zh": [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]}
    write = {k: written_in(rng, v, 1) for k, v in scripts.items()}
    samples = {k: [f(3000), f(40) + ". ", f(2500)] for k, f in write.items()}
    texts = [write[k](n) for k in scripts for n in (3, 250, 2600, 5000)] + [samples["ko"][0], write["la"](1500) + write["zh"](1500) + "é?ß", "", "...", "abracadabra" * 300]
    want = [[phrases_by_brute_force(samples[k], t) for k in sorted(samples)] for t in texts]
    for few, dense in ((160, 8_000_000), (2, 8_000_000), (2, 0), (0, 200_000)):
        monkeypatch.setattr(langid, "FEW", few)
        monkeypatch.setattr(langid, "DENSE", dense)
        parser = langid.Parser(samples)
        assert parser.phrases(texts)[0].tolist() == want
    assert parser.phrases([samples["ko"][0]])[0][0, 0] == 1  # a text of the sample is one phrase
    assert parser.predict(texts[:12])[0] == [k for k in scripts for _ in range(4)]


def test_languages_of_many_scripts_and_what_is_rejected(spark):
    rng = np.random.default_rng(7)
    scripts = {"la": "abcdefghijklm", "el": "αβγδεζηθικλμ", "ru": "абвгдежзиклм", "zh": [chr(c) for c in range(0x4E00, 0x5400)]}
    write = {k: written_in(rng, list(v), 1) for k, v in scripts.items()}
    rows = [(i, k, write[k](600)) for i, k in enumerate(list(scripts) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    samples, held = langid.sample_languages(docs, ~langid.held_out(), fit_chars=6000)
    assert sorted(samples) == sorted(held) == sorted(scripts)
    other = [(1000, None, written_in(rng, list("ابتثجحخدذرزسش"), 1)(800)), (1001, None, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 800))), (1002, None, "абв")]
    found = {r.doc_id: r for r in langid.identify_languages(docs.union(spark.createDataFrame(other, docs.schema)), samples, held).collect()}
    assert all(found[i].lang_pred == k and found[i].accepted for i, k, _ in rows)
    assert [found[i].accepted for i in (1000, 1001, 1002)] == [False, False, True] and found[1002].lang_pred == "ru"


def test_language_samples_are_bounded(spark):
    rows = [(7, "en", f"words of the text number {i} here") for i in range(1000)] + [(8, "en", "x" * 5000), (9, "de", "y" * 9000), (10, "fr", None), (None, "fr", "a b"), (11, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    samples, held = langid.sample_languages(docs, F.lit(True), fit_chars=4000)
    assert sorted(samples) == ["de", "en"] and samples["de"] == ["y" * 4000] and len(samples["en"]) == 1 and sorted(held) == ["en"]
    again, _ = langid.sample_languages(docs.repartition(5), F.lit(True), fit_chars=4000)
    assert again == samples


def test_more_languages_than_once(spark):
    rng = np.random.default_rng(11)
    rows = [(i * 10 + j, f"l{i:03d}", t) for i in range(260) for f in [written_in(rng, list("abcdefghijklmnop"), 1)] for j, t in enumerate([f(400), f(400)])]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    samples, held = langid.sample_languages(docs, F.col("doc_id") % 10 == 0)
    assert len(samples) == 260
    found = langid.identify_languages(docs.where("doc_id % 10 = 1 and doc_id < 400"), samples, held)
    assert found.where("lang_pred = lang").count() == 40


def plain_digest(data):
    """The digest by its definition, byte after byte: length code, quartile ratios, quartile of each bucket."""
    counts = [0] * 256
    for i in range(len(data) - 3):
        a, b, c, d = data[i : i + 4]
        for salt, (p, q) in enumerate(((b, c), (b, d), (c, d))):
            counts[(a * 0x9E37 + p * 0x85EB + q * 0xC2B3 + salt * 0x3D4D & 0xFFFF) >> 8] += 1
    q1, q2, q3 = (sorted(counts)[k - 1] for k in (64, 128, 192))
    ratios = [q1 * 15 // q3, q2 * 15 // q3] if q3 else [0, 0]
    return min(int(math.log(1 + len(data)) * 10), 255), ratios, [(c > q1) + (c > q2) + (c > q3) for c in counts]


def plain_likeness(a, b):
    gaps = [abs(x - y) for x, y in zip(a[2], b[2], strict=True)]
    diff = sum(gaps) + 3 * gaps.count(3) + max(abs(a[0] - b[0]) - 1, 0) + sum(max(abs(x - y) - 1, 0) for x, y in zip(a[1], b[1], strict=True))
    return 1 - min(diff, 416) / 416


def plain_hex(digest):
    bits = "".join(f"{c:02b}" for c in digest[2])
    return f"{digest[0]:02x}{digest[1][0]:x}{digest[1][1]:x}{int(bits, 2):0128x}"


def neighbours_by_brute_force(rows):
    """Result rows of (doc_id, text) in descending id order, the last with the first."""
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(t) // 3
        edited = (t[: len(t) - k] + after[:k]).encode()
        own, changed, beside = plain_digest(t.encode()), plain_digest(edited), plain_digest(after.encode())
        out.append((i, len(t), hashlib.sha256(edited).hexdigest(), plain_hex(own), plain_hex(changed), plain_likeness(own, changed), plain_likeness(own, beside)))
    return out


def test_quartile_digests(spark, docs, no_docs):
    some = [(r.doc_id, r.text or "") for r in docs.where("doc_id is not null and doc_id <> 7").collect()]
    some += [(r.doc_id + 100, (r.text or "")[:4000]) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    table = spark.createDataFrame(some, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    for rows in (table.repartition(5), table.where("doc_id in (3, 104)"), table.where("doc_id = 3")):
        want = neighbours_by_brute_force(sorted([r for r in some if r[0] in {x.doc_id for x in rows.collect()}], reverse=True))
        got = quartile.fingerprint_neighbours(rows)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert quartile.fingerprint_neighbours(no_docs).count() == 0


def test_quartile_neighbours_of_repeated_and_null_ids(spark, docs):
    found = quartile.fingerprint_neighbours(docs).collect()
    assert len(found) == docs.count() and sum(r.doc_id is None for r in found) == 1
    hot = spark.range(0, 4000, 1, 8).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the very same text of many rows").alias("text"))
    both = hot.union(spark.createDataFrame([(1, "first"), (1, "first"), (1, None), (9, "last text of all")], "doc_id long, text string"))
    got = quartile.fingerprint_neighbours(both).groupBy("doc_id", "fingerprint", "near_next").count().collect()
    assert sum(r["count"] for r in got) == 4004 and max(r["count"] for r in got if r.near_next == 1) >= 3999


def brute_top_k(rows, k, kind):
    """(query_id, rank, vec_id, score) by exact integers over all pairs of rows; lists in ``kind``, as the column holds them."""
    vecs = []
    for i, v in rows:
        v = None if v is None else [None if x is None else float(kind(x)) for x in v]
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vecs.append((i, [math.floor(Fraction(x) * 64) for x in v]))
    out = []
    for at, (q, v) in enumerate(vecs):
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for j, (i, w) in enumerate(vecs) if j != at)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("size", [0.2, 3e4, 1e7])
def test_top_k_is_exact(spark, kind, size):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, size, 16)]) for i in range(300)]
    rows += [(400, None), (420, [None] * 16), (440, [float("nan")] * 16), (445, [float("-inf")] * 16), (460, [1.0]), (480, rows[5][1]), (None, rows[0][1]), (500, [])]
    rows += [(20, rows[20][1]), (20, rows[7][1]), (31, rows[31][1]), (1, [1.0, 2.0])]  # repeated rows, repeated ids
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).repartition(3)
    for k in (1, 7, 400):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(table, F.col("vec_id") % 20 == 0, k).collect())
        assert got == brute_top_k(rows, k, np.float32 if kind == "float" else float)
    assert maxscore.top_k(table.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_keeps_large_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(0, [4e7, 5e7, 0.0]), (1, [5e7, 1.0, 0.0]), (20, [0.0, 0.0, 1e9]), (3, [1.0, 2.0, 1.0]), (40, [1.0, 1.0, 0.0]), (5, [-1e9, 1.0, 0.5])]
    rows += [(100 + i, [float(x) for x in rng.integers(-9, 9, 3)]) for i in range(50)]
    found = maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, 3)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute_top_k(rows, 3, np.float32)
    far = spark.createDataFrame([(20, [1e200, 0.0]), (1, [0.0, 1e308]), (2, [0.0, -7.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(far, F.col("vec_id") % 20 == 0, 3).collect()) == [(20, 1, 1, 0), (20, 2, 2, 0)]
    with pytest.raises(Exception, match="beyond 64 bits"):
        maxscore.top_k(spark.createDataFrame([(20, [1e10]), (1, [1e10])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()


def test_top_k_equals_its_sql(spark):
    import duckdb

    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in maxscore.top_k(table, F.col("vec_id") % 20 == 0).collect())
    assert got == sorted(db.sql(maxscore.ORACLE_SQL).select("query_id, rank, vec_id, score").fetchall())


def test_url_rules(spark):
    urls = ["http://a.example.net/de/1", "https://x.Example.NET/en/1?q", "http://example.com/de/", "http://www.example.org/fr/x#y", "http://m.casino-win.example.com/en/1", "http://net", "http://net/", None, "no scheme", "", "HTTP://FREE-BETS.example.org", "ftp://bad.net?x", "http://casino-winner.org/a", "http://x.org/banner/77/click?z"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.filter_urls(rows).collect()}
    assert got[0] == ("a.example.net", "/de/1", "net/", "block") and got[1] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == ("example.com/de/", "block") and got[3] == ("www.example.org", "/fr/x", "org/fr/", "allow")
    assert got[4][2:] == (None, "block") and got[5] == ("net", "", None, "allow") and got[6][2:] == ("net/", "block")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow") and got[10] == ("free-bets.example.org", "", None, "block")
    assert got[11] == ("bad.net", "", None, "allow") and got[12][3] == "allow" and got[13][3] == "block"
    assert urlrules.filter_urls(rows.where("false")).count() == 0


def test_patterns_run_by_rarest_token_only():
    rules = tuple(f"||host{i}." for i in range(50)) + ("/ads/^", "@@||host3.*^good^")
    index = urlrules.RuleIndex((), rules, {})
    plain = [(p.allow, __import__("re").compile(p.regex)) for p in map(urlrules.parse_pattern, rules)]
    for url in ["http://host3.org/x", "http://host3.org/good/", "http://a.host49.org/", "http://b.org/ads/1", "http://host500.org/"]:
        hits = [a for a, r in plain if r.search(url)]
        assert index.pattern(url) == ("allow" if not hits or any(hits) else "block")


def test_few_of_many_rules_are_tried():
    rng = np.random.default_rng(5)
    rules = [f"||site{i}." for i in range(4000)] + [f"/path{i}/*/item^" for i in range(500)] + [f"@@||site{i}.^good^" for i in range(0, 4000, 40)]
    urls = [f"http://a.site{rng.integers(6000)}.org/path{rng.integers(900)}/x/{'item' if i % 3 else 'good'}/{i}" for i in range(400)]
    domains, patterns = urlrules.read_rules("\n".join(["! a list", "# of rules", "", "block net/", "allow example.net/en/", "block net/", *rules, rules[0]]))
    assert domains == (("block", "net/"), ("allow", "example.net/en/")) and patterns == tuple(rules)
    counts = {}
    for u in urls:
        for t in set(urlrules.url_tokens(u)):
            counts[t] = counts.get(t, 0) + 1
    index = urlrules.RuleIndex(domains, patterns, counts)
    plain = [(p.allow, re.compile(p.regex, re.S)) for p in map(urlrules.parse_pattern, rules)]
    for u in urls:
        hits = [a for a, r in plain if r.search(u)]
        assert index.pattern(u) == ("allow" if not hits or any(hits) else "block")
    assert 0 < index.tried < 3 * len(urls)


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, "http://b\r\nx", "same"), (3, None, "same"), (4, "u", ""), (5, "u", None), (6, "u", "é" * 5000), (6, "u", "é" * 5000), (None, "u", "same"), (None, "v", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, folder).collect())
    top = {"same": 3, "": 5, "é" * 5000: 6, "alone": None}
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        kept = top[html or ""]
        want.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if kept in (i, None) else "revisit", None if kept in (i, None) else kept))
    assert got == sorted(want)
    archives = [open(f, "rb") for f in sorted(tmp_path.glob("w/archives/*.warc.gz"))]
    records = [fields for f in archives for fields, _ in warc.parse_records(f)]
    ids = [r["warc-record-id"] for r in records]
    assert len(set(ids)) == len(ids) and {r["warc-refers-to"] for r in records if r["warc-type"] == "revisit"} <= set(ids)
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == ["archives", "manifest"]
    warc.write_archives(pages.where("false"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_archives(pages.where("page_id is not null"), f"file://{tmp_path}/long", least=100)
    assert {r.payload_bytes for r in warc.read_archives(spark, f"file://{tmp_path}/long").where("record_type = 'revisit'").collect()} == set()


def test_hot_payloads_over_many_files(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", "hot" if i % 3 else f"own {i}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    warc.write_archives(pages, f"file://{tmp_path}/h")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/h").collect()}
    assert got == {i: ("revisit", 2999) if i % 3 and i != 2999 else ("response", None) for i in range(3000)}


def test_archives_are_read_in_linear_time():
    def seconds(n):
        rng = np.random.default_rng(0)
        made = [warc.make_record("response", warc.new_id(), "d", warc._http(3000) + rng.bytes(3000), warc._page(i, "u", "x")) for i in range(n)]
        data, best = b"".join(made), 1e9
        for _ in range(3):
            began = time.process_time()
            assert sum(1 for _ in warc.parse_records(io.BytesIO(data))) == n
            best = min(best, time.process_time() - began)
        return best

    assert seconds(6000) < 2.5 * seconds(3000)


def test_damaged_archives_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"text {i % 5}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/d")
    path = next(tmp_path.glob("d/archives/*.warc.gz"))
    whole = path.read_bytes()
    records = list(warc.parse_records(io.BytesIO(whole)))
    kept = [r for r in records if r[0]["warc-type"] != "response"]
    path.write_bytes(b"".join(warc.make_record(f["warc-type"], f["warc-record-id"], "d", b, [(k, v) for k, v in f.items() if k not in ("warc-type", "warc-record-id", "warc-date", "content-length")]) for f, b in kept))
    with pytest.raises(Exception, match="without its response"):
        warc.read_archives(spark, f"file://{tmp_path}/d").collect()
    path.write_bytes(whole[:-20])
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, f"file://{tmp_path}/d").collect()


def targets(sizes, weights, most=3):
    """Shares of all words by weight; what is above its limit is cut, the excess shared again, until none is above."""
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        share = {i: left * weights[i % len(weights)] / sum(weights[j % len(weights)] for j in free) for i in free}
        over = [i for i in free if share[i] > most * sizes[i]]
        for i in over or free:
            out[i] = float(most * sizes[i]) if over else share[i]
        left, free = left - sum(out[i] for i in over), [i for i in free if over and i not in over]
    return out


@pytest.mark.parametrize("sizes", [[10, 1000, 10], [100, 100, 100], [0, 5], [], [1, 1, 1, 1, 400], [7, 0, 3, 900, 2, 55, 1, 1, 20]])
def test_targets_are_capped_and_reshared(spark, tmp_path, sizes):
    rows = [(None if i == len(sizes) - 1 else f"s{i}", n, 1) for i, n in enumerate(sizes)]
    plan, n = cube._source_plan(spark.createDataFrame(rows, "source string, size long, n long"), cube.WEIGHTS, 3, str(tmp_path))
    got = sorted(plan.collect(), key=lambda r: r.source_id)
    assert n == len(sizes) and [r.name for r in got] == [r[0] for r in rows]
    assert [r.target for r in got] == pytest.approx(targets(sizes, cube.WEIGHTS))


def test_flight_keeps_totals():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 50, 400):
        for x in (rng.integers(0, 500, n), np.full(n, 7), np.append(np.full(max(n - 1, 0), 3), [900] * (n > 0)), (rng.pareto(1, n) * 50).astype(int)):
            x, p = x.astype(float).tolist(), rng.random(n).tolist()
            q = cube.flight(x, p, np.random.default_rng(n))
            assert sum(0 < v < 1 for v in q) <= 2
            assert n == 0 or sum(q) == pytest.approx(sum(p), abs=1e-5) and np.dot(x, q) == pytest.approx(np.dot(x, p), abs=1e-2)


@pytest.mark.parametrize("x", [[3, 8, 1, 7, 9, 2, 5, 4], [1000, 1010, 3, 8, 1, 7, 2, 5], [4, 4, 4, 4, 4, 4, 4, 4], [5000, 2, 2, 2, 2, 2, 2, 2]])
def test_draws_keep_their_probabilities_through_the_landing(x):
    p = [0.2, 0.5, 0.7, 0.4, 0.6, 0.3, 0.5, 0.8]
    drawn = []
    for s in range(4000):
        rng = np.random.default_rng(s)
        drawn.append(cube.land(x, cube.flight(x, p, rng), rng))
    assert set(np.unique(drawn)) == {0.0, 1.0} and np.abs(np.mean(drawn, axis=0) - p).max() < 0.04
    assert np.abs(np.sum(drawn, axis=1) - sum(p)).max() < 2


def test_landing_is_small_beside_a_large_document():
    rng = np.random.default_rng(1)
    x = [20000.0, *rng.integers(50, 900, 300).astype(float).tolist()]
    p, off = [0.4] * len(x), []
    for s in range(60):
        own = np.random.default_rng(s)
        taken = cube.land(x, cube.flight(x, p, own), own)
        off.append(abs(np.dot(x, taken) - np.dot(x, p)))
    assert max(off) < 1800 and np.mean(off) < 600


def test_mix(spark, docs, no_docs):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a = cube.mix_documents(rows)
    by_source = a.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target and r.over <= 0 for r in by_source)
    assert a.count() == rows.count() and sorted(map(str, a.collect())) == sorted(map(str, cube.mix_documents(rows.repartition(3)).collect()))
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in rows.collect()}
    assert {r.doc_id: r["size"] for r in a.collect()} == sizes
    small = cube.mix_documents(docs)
    assert small.count() == docs.count() and small.where("source is null").first().source_size == sum(len((r.text or "").encode().split()) for r in docs.collect() if r.source is None)
    assert cube.mix_documents(no_docs).count() == 0
    mixed, copies = cube.mixed_rows(docs), small.agg(F.sum("copies")).first()[0]
    assert mixed.columns == docs.columns and mixed.count() == copies


def test_mix_of_a_hot_row(spark, monkeypatch):
    hot = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source"))
    some = spark.createDataFrame([(i, "a b c " * (i % 50 + 1), "s" if i % 2 else "t") for i in range(400)], "doc_id long, text string, source string")
    same = spark.range(9000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("six words are in this text").alias("text"), F.lit("t").alias("source"))
    docs = hot.union(some).union(same)
    real = cube.flight

    def spy(x, p, rng):
        if len(x) > 2 * cube.GROUP:
            raise ValueError("a large group")
        return real(x, p, rng)

    monkeypatch.setattr(cube, "flight", spy)
    a = cube.mix_documents(docs)
    by_source = a.groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert {r.source: r.n for r in by_source} == {"s": 50_200, "t": 9200} and all(abs(r.taken - r.target) < 0.02 * r.target for r in by_source)
    mixed = cube.mixed_rows(docs)
    assert mixed.count() == a.agg(F.sum("copies")).first()[0]


def test_many_sources_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(cube, "FEW_SOURCES", 3)
    docs = spark.createDataFrame([(i, "w " * (i % 30), f"s{i % 97}") for i in range(2000)], "doc_id long, text string, source string")
    want = targets([sum(len(r.text.split()) for r in docs.where(F.col("source") == s).collect()) for s in sorted({f"s{i}" for i in range(97)})][:3], [5, 2, 1])
    a = cube.mix_documents(docs)
    assert a.count() == 2000 and want and abs(a.agg(F.sum("taken")).first()[0] / a.agg(F.sum("size")).first()[0] - 1) < 0.1
