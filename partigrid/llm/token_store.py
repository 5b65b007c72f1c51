"""Content-addressed store of token ids (operator 1).

A rolling hash over the ids of each document cuts its id stream into chunks, so equal passages give equal chunks wherever
they stand. Every task writes the chunks that it meets first into spool files; the digests alone (not the ids) are then
shuffled to choose one place for each distinct chunk, and each spool file is rewritten as a pack that holds only the chunks
it was chosen for. Recipes (a document's chunk digests, in ascending document order) and packs carry Merkle roots, tables
beside them list the files, the manifest holds the root over all files, and reading back verifies every digest and every
root. The spool and what was staged are removed in the end, so a chunk is on disk once.

A store is a folder: ``packs``, ``recipes`` (binary files), ``pack-index``, ``recipe-index`` (Parquet tables of the files and
their roots) and ``manifest.json``. Files are bounded (PACK_BYTES, RECIPE_BYTES), and so is what a task holds; the driver
gets a row for each partition of recipes and for each ROOTS files.

Reading gives a document's ids, or its CRC-32. For the checksum the chunks don't travel: each is read, verified and summed
once, and a document's CRC-32 is combined from those of its chunks in the recipe's order, which is exact.

Defined cases: a null text is empty; an empty text has the end id only (no chunk at all without an end id); a null document
id sorts first; repeated rows are documents of their own, those of one id in order of their number of ids and a hash of their
chunks; other columns of the input are never touched; an empty table gives a store without packs and recipes, and no rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partigrid.llm.common import new_file, read_file, remove_dir, slices, small_batches, stage, tokenizer, work_dir, write_file

PACK, RECIPE = b"PGPK0001", b"PGRC0001"
WINDOW, LEAST, MOST, MASK = 16, 128, 2048, (1 << 9) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _gear(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def chunk_ends(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream: where a hash of the last WINDOW ids has nine zero bits, LEAST to MOST ids apart."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    with np.errstate(over="ignore"):
        g = _gear(ids)
        h = g.copy()  # Σ g[i-j]·3^j, built by doubling the window
        width, power = 1, np.uint64(3)
        while width < WINDOW:
            h[width:] = h[width:] + h[:-width] * power
            power = power * power
            width *= 2
    cuts = (np.flatnonzero(((h >> np.uint64(40)) & np.uint64(MASK)) == 0) + 1).tolist()
    out, last = [], 0
    for c in cuts:
        while c - last > MOST:
            last += MOST
            out.append(last)
        if c - last >= LEAST:
            out.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        out.append(last)
    if n > last:
        out.append(n)
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a lone last node moves up unchanged; no leaves: the hash of nothing."""
    level = leaves
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.blake2b(b"", digest_size=16).digest()


def _digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


class _Writer:
    """A file of records: a mark, the records, their number and the Merkle root over them."""

    def __init__(self, path: str, mark: bytes):
        self.path, self.out, self.leaves, self.n_ids = path, new_file(path), [], 0
        self.out.write(mark)

    def add(self, leaf: bytes, n_ids: int, record: bytes) -> None:
        self.out.write(record)
        self.leaves.append(leaf)
        self.n_ids += n_ids

    def chunk(self, digest: bytes, n: int, packed: bytes) -> None:
        self.add(digest, n, digest + struct.pack("<II", n, len(packed)) + packed)

    def size(self) -> int:
        return self.out.tell()

    def close(self) -> tuple[str, int, int, str]:
        """(file, records, ids, root)"""
        root = merkle(self.leaves)
        self.out.write(struct.pack("<I", len(self.leaves)) + root)
        self.out.close()
        return self.path.rsplit("/", 1)[1], len(self.leaves), self.n_ids, root.hex()


def _pack_records(path: str, want: str | None = None) -> Iterator[tuple[bytes, int, bytes]]:
    """(digest, number of ids, compressed ids) of a pack; checks its root, and that it is ``want``."""
    data = read_file(path)
    if data[:8] != PACK:
        raise ValueError(f"{path} is no pack")
    count, root = struct.unpack("<I", data[-20:-16])[0], data[-16:]
    at, seen = 8, []
    for _ in range(count):
        digest = data[at : at + 16]
        n, size = struct.unpack_from("<II", data, at + 16)
        seen.append(digest)
        yield digest, n, data[at + 24 : at + 24 + size]
        at += 24 + size
    if merkle(seen) != root or want and root.hex() != want:
        raise ValueError(f"{path}: its Merkle root does not fit")


_STAGED = "kind int, doc_id long, n_ids long, digests binary, lens binary, file string, ord int, digest binary, n int"
_INDEX = "file string, n int, n_ids long, root string"
PACK_BYTES, RECIPE_BYTES, RECIPES, ROOTS = 32_000_000, 16_000_000, 100_000, 4096


def _chunker(tokens: str, end_id: int | None, spool: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tok, pack, writer, seen = tokenizer(tokens), zstandard.ZstdCompressor(level=3).compress, None, set()
        for b in slices(batches, "text"):
            out: list[tuple] = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), tok.encode([t or "" for t in b.column("text").to_pylist()]), strict=True):
                if end_id is not None:
                    ids = np.append(ids, np.uint16(end_id))
                digests, lens, last = [], [], 0
                for end in chunk_ends(ids):
                    payload = ids[last:end].astype("<u2").tobytes()
                    d = _digest(payload)
                    if d not in seen:
                        if writer is None:
                            name = f"{uuid.uuid4().hex}.pack"
                            writer = _Writer(f"{spool}/{name}", PACK)
                        seen.add(d)
                        out.append((1, None, None, None, None, name, len(writer.leaves), d, end - last))
                        writer.chunk(d, end - last, pack(payload))
                    digests.append(d)
                    lens.append(end - last)
                    last = end
                out.append((0, doc_id, len(ids), b"".join(digests), np.array(lens, "<u4").tobytes(), None, None, None, None))
            yield _batch(out, _STAGED)
            if writer is not None and writer.size() > PACK_BYTES:
                writer.close()
                writer, seen = None, set()
        if writer is not None:
            writer.close()

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _rewrite(store: str):
    """Spool file and the ordinals that it was chosen for, to a pack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, keep in zip(b.column("file").to_pylist(), b.column("ords").to_pylist(), strict=True):
                chosen, writer = set(keep), _Writer(f"{store}/packs/{uuid.uuid4().hex}.pack", PACK)
                for i, (digest, n, packed) in enumerate(_pack_records(f"{store}/spool/{file}")):
                    if i in chosen:
                        writer.chunk(digest, n, packed)
                yield _batch([writer.close()], _INDEX)

    return run


def _write_recipes(store: str):
    """Recipes of a sorted partition to files, numbered within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, writer = TaskContext.get().partitionId(), 0, None
        for b in batches:
            for doc_id, n, digests, lens in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_ids", "digests", "lens")), strict=True):
                writer = writer or _Writer(f"{store}/recipes/{part:08d}-{seq:06d}-{uuid.uuid4().hex[:8]}.recipe", RECIPE)
                root = merkle([digests[i : i + 16] for i in range(0, len(digests), 16)])
                writer.add(root, n, struct.pack("<?qQI", doc_id is None, doc_id or 0, n, len(digests) // 16) + root + digests + lens)
                if writer.size() > RECIPE_BYTES:
                    yield _batch([(part, seq, *writer.close())], f"part int, seq int, {_INDEX}")
                    seq, writer = seq + 1, None
        if writer:
            yield _batch([(part, seq, *writer.close())], f"part int, seq int, {_INDEX}")

    return run


def recipe_records(path: str, want: str | None = None) -> Iterator[tuple[int | None, int, list[bytes], np.ndarray]]:
    """(document id, number of ids, chunk digests, chunk lengths) of a recipe file; checks all its roots."""
    data = read_file(path)
    if data[:8] != RECIPE:
        raise ValueError(f"{path} is no recipe file")
    count, top = struct.unpack("<I", data[-20:-16])[0], data[-16:]
    at, roots = 8, []
    for _ in range(count):
        null, doc_id, n, k = struct.unpack_from("<?qQI", data, at)
        at += struct.calcsize("<?qQI")
        root, at = data[at : at + 16], at + 16
        digests = [data[at + 16 * i : at + 16 * i + 16] for i in range(k)]
        lens = np.frombuffer(data, "<u4", k, at + 16 * k).astype(np.int64)
        at += 20 * k
        if merkle(digests) != root or lens.sum() != n:
            raise ValueError(f"{path}: the recipe of document {doc_id} does not fit its root")
        roots.append(root)
        yield None if null else doc_id, n, digests, lens
    if merkle(roots) != top or want and top.hex() != want:
        raise ValueError(f"{path}: its Merkle root does not fit")


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _group_root(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("file")
    root = merkle([bytes.fromhex(r) for r in table.column("root").to_pylist()])
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([root.hex()])], names=["g", "root"])


def _root(index: DataFrame, groups: int) -> bytes:
    """Merkle root over all files of an index, made of those of its groups."""
    dealt = index.select("file", "root", F.pmod(F.xxhash64("file"), F.lit(groups)).cast("int").alias("g"))
    found = dealt.groupBy("g").applyInArrow(_group_root, "g int, root string").collect()
    return merkle([bytes.fromhex(r.root) for r in sorted(found, key=lambda r: r.g)])


def write_store(docs: DataFrame, store: str, tokens: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the documents' ids to the folder ``store``; returns the manifest, which is also written there as manifest.json."""
    spark = docs.sparkSession
    n = _partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    staged = stage(rows, f"{store}/staged", _chunker(tokens, end_id, f"{store}/spool"), _STAGED)
    chosen = staged.where("kind = 1").groupBy("digest").agg(F.min(F.struct("file", "ord")).alias("at"))
    chosen = chosen.groupBy(F.col("at.file").alias("file")).agg(F.collect_list("at.ord").alias("ords"))  # chunks of one spool file
    packs = stage(chosen.repartition(n, "file"), f"{store}/pack-index", _rewrite(store), _INDEX)
    own = staged.where("kind = 0").select("doc_id", "n_ids", "digests", "lens", F.xxhash64("digests").alias("tie"), F.spark_partition_id().alias("at"))
    parts = max(n, -(-own.count() // RECIPES))
    order = ["doc_id", "n_ids", "tie", "at"]  # equal rows of several input partitions may go to several ranges
    recipes = own.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_ids", "digests", "lens")
    recipes = stage(recipes, f"{store}/recipe-index", _write_recipes(store), f"part int, seq int, {_INDEX}")
    manifest = {"tokens": tokens, "end_id": end_id}
    for name, index in (("packs", packs), ("recipes", recipes)):
        files, ids = index.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
        manifest[name] = {"files": files, "n_ids": ids, "groups": max(1, -(-files // ROOTS))}
    manifest["root"] = merkle([_root(index, manifest[name]["groups"]) for name, index in (("packs", packs), ("recipes", recipes))]).hex()
    write_file(f"{store}/manifest.json", json.dumps(manifest).encode())
    for done in ("spool", "staged"):
        remove_dir(f"{store}/{done}")
    return manifest


_CHUNKS = "digest binary, n int, crc long, payload binary"
_USES = "file_no long, pos long, doc_id long, start long, n_ids long, seq int, digest binary"


def _read_packs(store: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for file, want in zip(b.column("file").to_pylist(), b.column("root").to_pylist(), strict=True):
                rows: list[tuple] = []
                for digest, n, packed in _pack_records(f"{store}/packs/{file}", want):
                    payload = unzip.decompress(packed, max_output_size=2 * n)
                    if _digest(payload) != digest or len(payload) != 2 * n:
                        raise ValueError(f"{file}: a chunk does not fit its digest")
                    crc = zlib.crc32(np.frombuffer(payload, "<u2").astype("<u4").tobytes())
                    rows.append((digest, n, crc, payload if with_ids else None))
                    if len(rows) == 4096:
                        yield _batch(rows, _CHUNKS)
                        rows = []
                yield _batch(rows, _CHUNKS)

    return run


def _read_recipes(store: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, file, want, start in zip(*(b.column(c).to_pylist() for c in ("file_no", "file", "root", "base")), strict=True):
                rows: list[tuple] = []
                for pos, (doc_id, n, digests, _) in enumerate(recipe_records(f"{store}/recipes/{file}", want)):
                    rows += [(number, pos, doc_id, start, n, i, d) for i, d in enumerate(digests or [None])]
                    start += n
                    if len(rows) > 8192:
                        yield _batch(rows, _USES)
                        rows = []
                yield _batch(rows, _USES)

    return run


def _gf_mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo the CRC-32 polynomial, bits reflected."""
    out = np.zeros_like(a)
    b = b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(bit)) & np.uint32(1) == 1, b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1) == 1, np.uint32(0xEDB88320), np.uint32(0))
    return out


def _gf_powers() -> list[np.uint32]:
    """x to the powers 32·2^k: what one shift by 2^k ids of four bytes multiplies a CRC with."""
    out = [np.array([1 << 30], np.uint32)]  # x
    for _ in range(5):
        out.append(_gf_mul(out[-1], out[-1]))
    out = out[5:]
    for _ in range(47):
        out.append(_gf_mul(out[-1], out[-1]))
    return [x[0] for x in out]


_POWERS = _gf_powers()


def combine_crcs(crcs: np.ndarray, lens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """CRC-32 of each group's concatenated ids, from the CRC-32 and the number of ids of its parts (group: 0.., ascending)."""
    n_groups = int(group[-1]) + 1 if len(group) else 0
    total = np.bincount(group, lens, n_groups).astype(np.int64)
    ends = np.cumsum(lens) - np.concatenate(([0], np.cumsum(total)))[group]
    after, value = total[group] - ends, crcs.astype(np.uint32)
    bit = 0
    while len(after) and int(after.max()) >> bit:
        at = np.flatnonzero((after >> bit) & 1)
        value[at] = _gf_mul(value[at], np.full(len(at), _POWERS[bit], np.uint32))
        bit += 1
    out = np.zeros(n_groups, np.uint32)
    np.bitwise_xor.at(out, group, value)
    return out


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = b.column("parts")
        group = np.repeat(np.arange(b.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        flat = parts.flatten()
        lens, crcs = (flat.field(c) for c in ("n", "crc"))
        if crcs.null_count or lens.null_count:
            raise ValueError("a recipe names a chunk that no pack holds")
        lens = lens.to_numpy(zero_copy_only=False).astype(np.int64)
        crc = combine_crcs(crcs.to_numpy(zero_copy_only=False), lens, group)
        crc = np.concatenate((crc, np.zeros(b.num_rows - len(crc), np.uint32)))
        n_ids = b.column("n_ids").to_numpy(zero_copy_only=False)
        if (np.bincount(group, lens, b.num_rows).astype(np.int64) != n_ids).any():
            raise ValueError("a document's chunks do not add up to its ids")
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("start"), b.column("n_ids"), pa.array(crc.astype(np.int64)), pc.list_value_length(parts)],
            names=["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"],
        )


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = [np.frombuffer(b"".join(x["payload"] for x in p), "<u2").astype(np.int32) for p in b.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_ids"), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])


def read_documents(spark: SparkSession, store: str, with_ids: bool = False) -> DataFrame:
    """Every document of a store, from its files alone: doc_id, start, n_tokens and ids_crc32, n_chunks, or its ids.

    Each pack is read and verified once. For the checksum only digests, lengths and checksums of chunks are joined to the
    recipes, and a document's CRC-32 is combined from those of its chunks; for the ids themselves the chunks travel.
    """
    manifest, n = json.loads(read_file(f"{store}/manifest.json")), _partitions(spark)
    packs = spark.read.schema(_INDEX).parquet(f"{store}/pack-index")
    recipes = spark.read.schema(f"part int, seq int, {_INDEX}").parquet(f"{store}/recipe-index")
    if merkle([_root(packs, manifest["packs"]["groups"]), _root(recipes, manifest["recipes"]["groups"])]).hex() != manifest["root"]:
        raise ValueError("the manifest does not fit its Merkle root")
    offsets, start = [], 0
    for r in sorted(recipes.groupBy("part").agg(F.sum("n_ids").alias("ids")).collect()):  # a row for each partition of recipes
        offsets.append((r.part, start))
        start += r.ids
    known = spark.createDataFrame(offsets, "part int, ids_before long")
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = recipes.withColumn("before", before).join(known.hint("merge"), "part")
    files = files.select((F.shiftleft(F.col("part").cast("long"), 24) + F.col("seq")).alias("file_no"), "file", "root", (F.col("before") + F.col("ids_before")).alias("base"))
    index = packs.select("file", "root").repartition(n, "file").mapInArrow(_read_packs(store, with_ids), _CHUNKS)
    uses = files.repartition(n, "file").mapInArrow(_read_recipes(store), _USES)
    value = F.struct("seq", "n", "crc", *(["payload"] if with_ids else []))
    value = F.when(F.col("digest").isNotNull(), value)
    whole = uses.join(index.hint("merge"), "digest", "left").groupBy("file_no", "pos", "doc_id", "start", "n_ids").agg(F.sort_array(F.collect_list(value)).alias("parts"))
    if with_ids:
        return whole.mapInArrow(_join_ids, "doc_id long, start long, n_tokens long, ids array<int>")
    return whole.mapInArrow(_combine, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written to a content-addressed store and read back: doc_id, start, n_tokens, ids_crc32 (combined from
    its chunks', as read and verified), n_chunks."""
    store = work_dir(spark, "token-store")
    write_store(small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet"), store, "byte_bpe_50k.json", end_id=0)
    return read_documents(spark, store)
