"""Shared helpers of the training-data operators: the shared work folder, file access, batch slicing, tokenising."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES, BATCH_BYTES = 2_000_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf)
        return conf.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="partigrid-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _to_file(folder: str, make: Callable | None):
    """Rows of a partition (or what ``make`` makes of them) to one Parquet file; its name is handed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        out = writer = None
        name = f"{uuid.uuid4().hex}.parquet"
        for b in make(batches) if make else batches:
            if not b.num_rows:
                continue
            if writer is None:
                out = new_file(f"{folder}/{name}")
                writer = pq.ParquetWriter(out, b.schema, compression="zstd")
            writer.write_batch(b)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return run


def stage(df: DataFrame, path: str, make: Callable | None = None, schema: str | None = None, any_columns: bool = False) -> DataFrame:
    """Write ``df``, or what ``make`` (as for mapInArrow, with its ``schema``) makes of it, as Parquet and read it back, so
    that a lost executor costs no recomputation of what lies before.

    Spark writes to a store. In a mounted folder (file:) its writer starts processes from the executor's JVM for each file
    and folder it makes (chmod), which costs more than small tables do, so there the tasks' Python workers write the files;
    a file that no finished task has named is removed before the rest is read. Tables of ``any_columns`` are left to Spark.
    """
    spark = df.sparkSession
    if any_columns or not path.startswith("file:"):
        made = df.mapInArrow(make, schema) if make else df
        made.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(made.schema).parquet(path)
    named = {r.name for r in df.mapInArrow(_to_file(path, make), "name string").collect()}  # a row for each partition
    if not named:
        spark.createDataFrame([], schema or df.schema).write.parquet(path)
    fs, p = open_fs(path)
    for f in fs.get_file_info(pafs.FileSelector(p)) if named else []:
        if f.base_name not in named:
            fs.delete_file(f.path)
    return spark.read.schema(schema or df.schema).parquet(path)


def small_batches(spark: SparkSession) -> SparkSession:
    """From now on the session hands rows to Python in batches of BATCH_BYTES at most, whatever the rows' number: a task's
    memory then doesn't follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; Spark's names of S3 are known too."""
    for name in ("s3a://", "s3n://"):
        if path.startswith(name):
            path = f"s3://{path[len(name):]}"
    return pafs.FileSystem.from_uri(path)


def new_file(path: str) -> pa.NativeFile:
    """A stream to a file that isn't there yet. Tasks write under names of their own and hand those on, so what a lost
    attempt has left is never read and no store needs an atomic move."""
    fs, p = open_fs(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(p, compression=None)


def write_file(path: str, data: bytes) -> None:
    with new_file(path) as f:
        f.write(data)


def read_file(path: str) -> bytes:
    fs, p = open_fs(path)
    with fs.open_input_stream(p, compression=None) as f:
        return f.read()


def remove_dir(path: str) -> None:
    fs, p = open_fs(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores in front until no column is called that (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def one_row_each(rows: DataFrame, table: DataFrame, keys: list[str], times: str) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``, one row of each key that the table holds; its column ``times`` says how
    many rows there are. Where there are several they are dealt out over salts, so no task gets all of a key's rows."""
    if table.where(F.col(times) > 1).isEmpty():
        return rows.join(table.hint("merge"), keys)
    once = rows.join(table.where(F.col(times) == 1).hint("merge"), keys)
    many = rows.join(table.where(F.col(times) > 1).hint("merge"), keys)
    salt, row = fresh("salt", many.columns), fresh("row", many.columns)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = many.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(64))).repartition(parts, *keys, salt)
    some = dealt.groupBy(*keys, salt).agg(F.first(F.struct(*many.columns)).alias(row))
    return once.unionByName(some.groupBy(*keys).agg(F.first(row).alias(row)).select(f"{row}.*"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(column)
        sizes = pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = np.cumsum(sizes) // limit
        edges = np.flatnonzero(np.diff(cut)) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            yield b.slice(s, e - s)


class Repeats:
    """Numbers equal keys in the order in which they are met: how often each was met before.

    Whatever the order of a task's rows, the same numbers come out for the same rows, so a task that is run again deals
    equal rows out as before. Keys are held in sorted arrays, sixteen bytes a distinct one.
    """

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        own, first, label, n = np.unique(keys[order], return_index=True, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == own[inside]
        before = np.zeros(len(own), np.int64)
        before[known] = self.counts[at[known]]
        out = np.empty(len(keys), np.int64)
        out[order] = np.arange(len(keys)) - first[label] + before[label]
        self.counts[at[known]] += n[known]
        self.keys, self.counts = np.insert(self.keys, at[~known], own[~known]), np.insert(self.counts, at[~known], n[~known])
        return out


def crc_ids(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


class WordTable:
    """Words of a buffer to entry numbers, all words of a slice at once: a hash table in numpy arrays.

    A word's key is its first and last eight bytes and a 64-bit hash of its length and all of it. The key settles words of up
    to sixteen bytes (the hash is one to one for those that share their ends); the bytes of longer ones are kept and compared.
    """

    def __init__(self, bits: int = 21):
        self.bits, self.n = bits, 0
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros((3, 1 << 16), np.uint64)
        self.sizes, self.at = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.text, self.used = np.zeros(1 << 16, np.uint8), 0

    @staticmethod
    def _eights(buffer) -> np.ndarray:
        """The eight bytes from each place on, as integers."""
        return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))

    @classmethod
    def key(cls, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Keys (hash, first, last) of the words buffer[starts:ends]; eight bytes must stand before and behind them."""
        at = cls._eights(buffer)
        size = ends - starts
        short = np.minimum(size, 8).astype(np.uint64) * np.uint64(8)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        first = at[starts] & np.where(short == 64, full, (np.uint64(1) << (short & np.uint64(63))) - np.uint64(1))
        last = np.where(size > 8, at[ends - 8], np.uint64(0))
        mul = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
        with np.errstate(over="ignore"):
            h = (size.astype(np.uint64) * mul[1] ^ first) * mul[0]
            h ^= h >> np.uint64(29)
            h = (h ^ last) * mul[1]
            h ^= h >> np.uint64(32)
            more, k = np.flatnonzero(size > 16), 8
            while len(more):
                x = (h[more] ^ at[starts[more] + k]) * mul[0]
                h[more] = x ^ (x >> np.uint64(31))
                k += 8
                more = more[size[more] > k + 8]
            h *= mul[0]
        return np.stack((h, first, last))

    @classmethod
    def same(cls, a, starts: np.ndarray, b, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether words of ``sizes`` (over 16) at ``starts`` of a equal those at ``others`` of b, but for their ends."""
        x, y, out, k = cls._eights(a), cls._eights(b), np.ones(len(sizes), bool), 8
        more = np.arange(len(sizes))
        while len(more):
            out[more] &= x[starts[more] + k] == y[others[more] + k]
            k += 8
            more = more[sizes[more] > k + 8]
        return out

    def find(self, keys: np.ndarray, buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each word, -1 for none."""
        out = np.full(keys.shape[1], -1, np.int64)
        todo, mask = np.arange(keys.shape[1]), (1 << self.bits) - 1
        slot = (keys[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            entry = self.slots[slot]
            there = entry >= 0
            todo, slot, entry = todo[there], slot[there], entry[there]
            same = self.keys[0][entry] == keys[0][todo]
            same &= (self.keys[1][entry] == keys[1][todo]) & (self.keys[2][entry] == keys[2][todo])
            long = np.flatnonzero(same & (ends[todo] - starts[todo] > 16))
            if len(long):
                e, w = entry[long], todo[long]
                size = ends[w] - starts[w]
                same[long] = size == self.sizes[e]
                long, e, w, size = (v[same[long]] for v in (long, e, w, size))
                same[long] = self.same(buffer, starts[w], self.text, self.at[e], size)
            out[todo[same]] = entry[same]
            todo, slot = todo[~same], (slot[~same] + 1) & mask
        return out

    def add(self, keys: np.ndarray, words: list[bytes]) -> None:
        """New entries for words that are distinct and not in the table."""
        n, mask = keys.shape[1], (1 << self.bits) - 1
        while self.n + n > self.keys.shape[1]:
            self.keys = np.concatenate((self.keys, np.zeros_like(self.keys)), axis=1)
            self.sizes, self.at = (np.concatenate((x, np.zeros_like(x))) for x in (self.sizes, self.at))
        self.keys[:, self.n : self.n + n] = keys
        size = np.fromiter(map(len, words), np.int64, n)
        kept = np.where(size > 16, size, 0)
        data = np.frombuffer(b"".join(w for w in words if len(w) > 16), np.uint8)
        while self.used + len(data) + 8 > len(self.text):
            self.text = np.concatenate((self.text, np.zeros_like(self.text)))
        self.text[self.used : self.used + len(data)] = data
        self.sizes[self.n : self.n + n], self.at[self.n : self.n + n] = size, self.used + np.cumsum(kept) - kept
        self.used += len(data)
        todo = np.arange(self.n, self.n + n)
        slot = (keys[0] >> np.uint64(64 - self.bits)).astype(np.int64)
        self.n += n
        while len(todo):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            placed = free[one]
            self.slots[slot[placed]] = todo[placed]
            rest = np.ones(len(todo), bool)
            rest[placed] = False
            todo, slot = todo[rest], (slot[rest] + 1) & mask

    def only(self, entries: np.ndarray) -> "WordTable":
        """A table of these entries alone, numbered from 0."""
        out = WordTable(self.bits)
        words = [self.text[a : a + s].tobytes() if s > 16 else b"" for a, s in zip(self.at[entries].tolist(), self.sizes[entries].tolist(), strict=True)]
        out.add(self.keys[:, entries], words)
        out.sizes[: len(entries)] = self.sizes[entries]
        return out


class CachedTokenizer:
    """Exact ids of a public tokenizer, frequent words encoded once.

    Both vocabularies cut a text before every space or line feed that stands between two other characters, so the ids of a
    text are the ids of its words one after another. Texts for which that cut isn't certain (runs of white space, white
    space other than a space or a line feed, control characters, words of over 512 bytes, what looks like a special token)
    are encoded whole. New words are encoded JOINED at a time: where a word starts is told from its first id, which begins
    with the space or line feed, or by a separator's id if the vocabulary drops white space. Once ``max_words`` words are
    kept, those met only once since the last time go.
    """

    JOINED, LONG = 64, 512

    def __init__(self, path: str, max_words: int = 700_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.drops_space = self._ids([" a"]) == self._ids(["a"])
        names = self.tok.get_vocab()
        self.starts_word = np.zeros(1 << 16, bool)
        if not self.drops_space:
            space, feed = (self.tok.pre_tokenizer.pre_tokenize_str(x)[0][0] for x in (" ", "\n"))
            self.starts_word[[i for n, i in names.items() if n[0] in (space, feed)]] = True
        self.separator = self._ids(["\x01"])[0] if self.drops_space else []
        self.max_words = max_words
        self.table = WordTable()
        self.flat, self.used = np.empty(1 << 16, np.uint16), 0
        self.starts, self.lens, self.met = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _unsure(self, text: str) -> bool:
        line = text.replace("\n", " ")
        return not line.isprintable() or "<|" in line or not self.drops_space and ("  " in line or line[:1] == " " or line[-1:] == " ")

    def _split(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has; a word stands behind a space, or begins with a line feed."""
        groups = [words[i : i + self.JOINED] for i in range(0, len(words), self.JOINED)]
        if self.drops_space:
            got = self._ids([" \x01 ".join(g) + " \x01" for g in groups]) if len(self.separator) == 1 else []
            ids = np.fromiter(chain.from_iterable(got), np.uint16)
            ends = np.flatnonzero(ids == self.separator[0])
            lens = np.diff(np.concatenate(([-1], ends))) - 1
            flat = ids[ids != self.separator[0]]
        else:
            got = self._ids([f" {' '.join(g)}".replace(" \n", "\n") for g in groups])
            flat = np.fromiter(chain.from_iterable(got), np.uint16)
            begins = np.flatnonzero(self.starts_word[flat])
            lens = np.diff(np.append(begins, len(flat)))
        if len(lens) != len(words):  # should a word hold what marks a start: one by one
            return self._alone([w if self.drops_space or w[:1] == "\n" else f" {w}" for w in words])
        return flat, lens.astype(np.int32)

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one = self._ids(texts)
        return np.fromiter(chain.from_iterable(one), np.uint16), np.fromiter(map(len, one), np.int32, len(one))

    def _learn(self, words: list[bytes], keys: np.ndarray) -> None:
        """New entries; a word that begins with \\x02 is a text's first, which nothing stands before."""
        first = np.fromiter((w[:1] == b"\x02" for w in words), bool, len(words))
        order = np.concatenate((np.flatnonzero(~first), np.flatnonzero(first)))
        a, n = self._split([w.decode() for w, f in zip(words, first, strict=True) if not f])
        b, m = self._alone([w[1:].decode() for w, f in zip(words, first, strict=True) if f])
        flat, lens, at = np.concatenate((a, b)), np.concatenate((n, m)), self.table.n
        self.table.add(keys[:, order], [words[i] for i in order.tolist()])
        while self.table.n > len(self.starts):
            self.starts, self.lens, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lens, self.met))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(flat)] = flat
        self.lens[at : self.table.n] = lens
        self.starts[at : self.table.n] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)

    def _drop_rare(self) -> None:
        n, least = self.table.n, 2
        while (keep := np.flatnonzero(self.met[:n] >= least)).size > self.max_words * 2 // 3:
            least *= 2
        flat, lens = self._gather(keep)
        self.flat, self.used = np.concatenate((flat, np.empty(1 << 16, np.uint16))), len(flat)
        self.starts[: len(keep)], self.lens[: len(keep)] = np.cumsum(lens) - lens, lens
        self.met[: len(keep)] = self.met[keep] // 2
        self.met[len(keep) :] = 0
        self.table = self.table.only(keep)

    def _gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of entries one after another, and how many each has."""
        lens = self.lens[entries]
        ends = np.cumsum(lens, dtype=np.int64)
        pos = np.repeat(self.starts[entries] - (ends - lens), lens)
        pos += np.arange(len(pos))
        return self.flat[pos], lens

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 16-bit integers (both vocabularies are below 65,536)."""
        out: list[np.ndarray | None] = [None] * len(texts)
        sure = [i for i, t in enumerate(texts) if not self._unsure(t)]
        data = [(texts[i].replace("\n", " ") if self.drops_space else "\x02" + texts[i].replace("\n", " \n")).encode() for i in sure]
        buffer = b"        " + b" ".join(data) + b"         "
        spaces = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 32)
        spaces = spaces[7:-8]  # the one before the first word, to the one behind the last
        starts, ends = spaces[:-1] + 1, spaces[1:]
        behind = np.searchsorted(spaces, 7 + np.cumsum([len(d) + 1 for d in data]))  # words up to the end of each text
        wide = np.flatnonzero(ends - starts > self.LONG)
        if len(wide):
            for j in np.unique(np.searchsorted(behind, wide, side="right")).tolist():
                out[sure[j]] = np.array(self._ids([texts[sure[j]]])[0], np.uint16)
        for i in set(range(len(texts))).difference(sure):
            out[i] = np.array(self._ids([texts[i]])[0], np.uint16)
        held = np.flatnonzero((ends > starts) & (ends - starts <= self.LONG))
        starts, ends, behind = starts[held], ends[held], np.searchsorted(held, behind)
        if self.table.n > self.max_words:
            self._drop_rare()
        keys = WordTable.key(buffer, starts, ends)
        entry = self.table.find(keys, buffer, starts, ends)
        new = np.flatnonzero(entry < 0)
        if len(new):
            _, one, label = np.unique(keys[0][new], return_index=True, return_inverse=True)
            own, of = keys[:, new[one]], new[one][label]
            size, long = ends[new] - starts[new], np.flatnonzero(ends[new] - starts[new] > 16)
            apart = (own[:, label] != keys[:, new]).any() or (size != ends[of] - starts[of]).any()
            if apart or not WordTable.same(buffer, starts[new[long]], buffer, starts[of[long]], size[long]).all():
                return [np.array(x, np.uint16) for x in self._ids(texts)]  # two words with one hash: nothing of this slice is kept
            at, words = self.table.n, [buffer[s:e] for s, e in zip(starts[new[one]].tolist(), ends[new[one]].tolist(), strict=True)]
            self._learn(words, own)
            first = np.fromiter((w[:1] == b"\x02" for w in words), bool, len(words))
            place = np.empty(len(words), np.int64)
            place[np.concatenate((np.flatnonzero(~first), np.flatnonzero(first)))] = np.arange(at, self.table.n)
            entry[new] = place[label]
        self.met[: self.table.n] += np.bincount(entry, minlength=self.table.n)
        ids, lens = self._gather(entry)
        upto = np.concatenate(([0], np.cumsum(lens, dtype=np.int64)))[np.concatenate(([0], behind))]
        for j, i in enumerate(sure):
            if out[i] is None:
                out[i] = ids[upto[j] : upto[j + 1]]
        return out


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where that can be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def let_go(spark: SparkSession) -> None:
    """What the driver no longer refers to goes now, not when its heap happens to be full: executors drop the broadcasts and
    shuffles of finished steps."""
    give_back()
    spark.sparkContext._jvm.System.gc()


_KEPT: dict = {}


def kept(kind: str, key, make: Callable):
    """What ``make`` makes, once in a worker process; a worker keeps the things of one kind (an operator's) at a time, and
    gives back the memory of what it kept before."""
    if _KEPT.get("kind") != kind:
        _KEPT.clear()
        _KEPT["kind"] = kind
        give_back()
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def tokenizer(name_or_path: str) -> CachedTokenizer:
    """The tokenizer of a file, or of a name that public_tokenizers knows; one per worker process."""

    def load() -> CachedTokenizer:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = name_or_path
        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        return CachedTokenizer(path)

    return kept("tokenizer", name_or_path, load)
