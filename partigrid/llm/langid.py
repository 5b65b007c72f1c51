"""Language identification by cross-parsing entropy (operator 6).

For each language a suffix automaton is built over a sample of its labelled texts. A text is parsed against it: from the
current place the longest match that occurs anywhere in the sample is one phrase (a letter that the sample lacks is a phrase
of its own), then the parse goes on behind it. The phrases times the binary logarithm of the sample's length, over the length
of the text, estimate the text's entropy in bits a character under that language; the language that needs fewest wins. Texts
are normalised to lower-case letters with one separator for what stands between them. Every language has an alphabet of its
own: all the letters of its sample.

A text is parsed from its first character to its last, without a cut. All texts of a slice go a character a step at once;
when few are left, those are parsed to their ends one by one.

Only fitting uses a sample. A language's labelled documents stand in order of their ids' hash, one text an id, those over an
eighth of the limit behind the others; whole texts are taken as long as they fit into ``fit_chars`` characters (only a first
one that is longer than that is cut), at most ``fit_docs``. With many languages these limits are divided so that TOTAL_CHARS
and TOTAL_DOCS hold in all; no language is left out. As many characters again, of the texts behind those, calibrate what a
text of a learned language costs at most (``accepts``). Parsing reads every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled text all rows are ``und``;
with one language its score is 1; equal costs go to the language first in code point order; rows with a null ``lang`` are
predicted, not learned from; a null id is held out from nothing and never learned from; an id that is repeated gives one text
(that of the least hash) to each of its languages; more than TOTAL_DOCS languages are an error; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partigrid.llm.common import fresh, kept, slices, small_batches

FIT_CHARS, FIT_DOCS, TOTAL_CHARS, TOTAL_DOCS = 60_000, 200, 2_000_000, 20_000
#: Transitions of an automaton that are held as a table; texts below which the others go on one by one; characters of a slice;
#: parts of a language that are sampled apart.
DENSE, FEW, SLICE, SALTS = 8_000_000, 160, 3_000_000, 64
#: Characters from which a text is long enough to be rejected for its cost, and how many times what the dearest of the
#: calibrating texts costs it must cost: other scripts and noise do, texts of rare words and of two languages do not.
JUDGED, MARGIN = 100, 2.5
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the automaton that accepts all substrings of ``codes``; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Language:
    """The automaton of one language over its own alphabet. Behind a letter that it lacks comes a state without transitions,
    which is also where a text starts, so each step without a transition begins a phrase."""

    def __init__(self, codes: np.ndarray, classes: int):
        own = np.unique(codes)
        self.local = np.full(classes, len(own), np.int32)
        self.local[own] = np.arange(len(own))
        self.bits = float(np.log2(max(len(codes), 2)))
        nxt = suffix_automaton(self.local[codes].tolist())
        self.dead, self.width = len(nxt), len(own) + 1
        nxt.append({})
        self.to: np.ndarray | None = None
        self.nxt: list[dict[int, int]] = []
        if len(nxt) * self.width <= DENSE:
            to = np.full((len(nxt), self.width), -1, np.int32)
            for s, row in enumerate(nxt):
                for c, t in row.items():
                    to[s, c] = t * self.width
            self.to, self.dead = to.ravel(), self.dead * self.width
            self.root = np.where(to[0] < 0, self.dead, to[0]).astype(np.int32)
        else:
            self.nxt, self.root = nxt, np.array([nxt[0].get(c, self.dead) for c in range(self.width)], np.int32)

    def finish(self, codes: np.ndarray, state: int) -> int:
        """Phrases that begin in ``codes``, parsed from ``state``."""
        n, root = 0, self.root.tolist()
        if self.to is not None:
            to = memoryview(self.to)
            for c in codes.tolist():
                state = to[state + c]
                if state < 0:
                    n += 1
                    state = root[c]
            return n
        nxt = self.nxt
        for c in codes.tolist():
            t = nxt[state].get(c)
            if t is None:
                n += 1
                t = root[c]
            state = t
        return n


class Parser:
    """The languages of ``samples``, and what texts cost in them."""

    def __init__(self, samples: dict[str, list[str]], held: dict[str, list[str]] | None = None):
        self.langs = sorted(samples)
        alphabet = sorted({c for texts in samples.values() for t in texts for c in set(t.lower()) if c.isalpha()})
        self.classes = len(alphabet) + 2
        self.code = np.where(letters(), self.classes - 1, 0).astype(np.int32)
        self.code[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        self.languages = [Language(self.codes("\n".join(samples[x])), self.classes) for x in self.langs]
        costs = [self.costs(texts) for _, texts in sorted((held or {}).items()) if texts]
        judged = [c.min(axis=1)[n >= JUDGED] for c, n in costs if c.size]
        self.limit = MARGIN * float(np.concatenate(judged).max()) if sum(map(len, judged)) else np.inf

    def codes(self, text: str) -> np.ndarray:
        c = self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        return c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))] if len(c) else c

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text for each language, the normalised text's length, and whether it has a letter."""
        codes = [self.codes(t) for t in texts]
        has, size = np.array([bool(c.any()) for c in codes], bool), np.array([len(c) for c in codes], np.int64)
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        order = np.argsort(-size, kind="stable")
        lens = size[order]
        steps = int(lens[FEW]) if len(lens) > FEW else 0  # as long as more than FEW texts are left
        active = len(lens) - np.searchsorted(lens[::-1], np.arange(steps), side="right")
        flat, starts = np.concatenate([np.empty(0, np.int32), *codes]), (np.cumsum(size) - size)[order]
        ends = np.cumsum(active)
        by_step = np.empty(int(ends[-1]) if steps else 0, np.int32)
        for t, (n, e) in enumerate(zip(active.tolist(), ends.tolist(), strict=True)):
            by_step[e - n : e] = flat[starts[:n] + t]
        tails = [codes[i][steps:] for i in order[: np.searchsorted(-lens, -steps)].tolist()]
        for k, lang in enumerate(self.languages):
            count = np.zeros(len(lens), np.int64)
            if lang.to is None:
                out[order, k] = [lang.finish(lang.local[codes[i]], lang.dead) for i in order.tolist()]
                continue
            state, own = np.full(len(lens), lang.dead, np.int32), lang.local[by_step]
            to, root = lang.to, lang.root
            for n, e in zip(active.tolist(), ends.tolist(), strict=True):
                c = own[e - n : e]
                f = to[state[:n] + c]
                miss = np.flatnonzero(f < 0)
                f[miss] = root[c[miss]]
                count[miss] += 1
                state[:n] = f
            for i, c in enumerate(tails):
                count[i] += lang.finish(lang.local[c], int(state[i]))
            out[order, k] = count
        return out, size, has

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character of each text in each language, and the normalised text's length."""
        n, size, _ = self.phrases(texts)
        return n * np.array([x.bits for x in self.languages]) / np.maximum(size, 1)[:, None], size

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits a character, and whether the text costs what the learned languages' texts do; the score is
        the share by which the next language costs more. A text without a letter is never accepted; texts of less than JUDGED
        characters, and all others where nothing was learned, are accepted at any cost."""
        n, size, has = self.phrases(texts)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), has
        cost = n * np.array([x.bits for x in self.languages]) / np.maximum(size, 1)[:, None]
        best = cost.argmin(axis=1)
        low = cost[np.arange(len(texts)), best]
        score = np.ones(len(texts))
        if len(self.langs) > 1:
            second = np.partition(cost, 1, axis=1)[:, 1]
            score = 1 - np.divide(low, second, out=np.ones(len(texts)), where=second > 0)
        accepts = has & ((size < JUDGED) | (low <= self.limit))
        return [self.langs[b] if h else "und" for b, h in zip(best.tolist(), has, strict=True)], np.where(has, score, 0.0), low, accepts


def _predictor(shared, carried: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, samples, held = shared.value
        parser = kept(f"parser {key}", key, lambda: Parser(samples, held))
        for b in slices(batches, "text", SLICE):
            lang, score, cost, accepts = parser.predict([t or "" for t in b.column("text").to_pylist()])
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cost, pa.float64()), pa.array(accepts, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *new], names=[*carried, *names])

    return run


def sample_languages(docs: DataFrame, may_learn: F.Column, fit_chars: int = FIT_CHARS, fit_docs: int = FIT_DOCS) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Texts for each language to learn from, and others to calibrate with; at most twice TOTAL_CHARS characters in all."""
    own = docs.where("lang is not null and doc_id is not null").where(may_learn).select("doc_id", F.col("lang").cast("string").alias("label"))
    n = own.select("label").distinct().limit(TOTAL_DOCS + 1).count()
    if n > TOTAL_DOCS:
        raise ValueError(f"more than {TOTAL_DOCS} languages")
    fit_chars, fit_docs = min(fit_chars, TOTAL_CHARS // max(n, 1)), min(fit_docs, TOTAL_DOCS // max(n, 1))
    first = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS))  # a frequent language is first thinned out by many tasks
    some = own.distinct().withColumn("salt", salt).withColumn("place", F.row_number().over(first.partitionBy("label", "salt"))).where(F.col("place") <= fit_docs)
    ids = some.select("label", "doc_id").withColumn("place", F.row_number().over(first)).where(F.col("place") <= fit_docs)  # TOTAL_DOCS rows at most
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("label"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), ["label", "doc_id"])
    one = rows.groupBy("label", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text")).where("text <> ''")
    by_place = Window.partitionBy("label").orderBy(F.length("text") > fit_chars // 8, "place")
    one = one.withColumn("upto", F.sum(F.length("text")).over(by_place.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.row_number().over(by_place))
    got = one.where((F.col("upto") <= 2 * fit_chars) | (F.col("at") == 1)).select("label", "at", "upto", F.substring("text", 1, fit_chars).alias("text")).collect()
    samples: dict[str, list[str]] = {}
    held: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r.label, r.at)):
        (samples if r.upto <= fit_chars or r.at == 1 else held).setdefault(r.label, []).append(r.text)
    return samples, held


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


NAMES = ("lang_pred", "score", "bits", "accepted")


def identify_languages(docs: DataFrame, samples: dict[str, list[str]], held: dict[str, list[str]] | None = None, names: tuple[str, str, str, str] = NAMES, carried: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``carried``, None: all) with their language, its score, the bits a character, and whether those are what texts of the
    learned languages cost, in four new columns; a name that is taken gets underscores in front."""
    carried = docs.columns if carried is None else carried
    taken: list[str] = list(docs.columns)
    for n in names:
        taken.append(fresh(n, taken))
    new = taken[len(docs.columns) :]
    key = repr(hash((tuple((k, *v) for k, v in sorted(samples.items())), tuple((k, *v) for k, v in sorted((held or {}).items())))))
    shared = docs.sparkSession.sparkContext.broadcast((key, samples, held))
    fields = [T.StructField(c, t) for c, t in zip(new, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)]
    return docs.mapInArrow(_predictor(shared, carried, new), T.StructType([*[docs.schema[c] for c in carried], *fields]))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, bits."""
    docs = small_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    found = identify_languages(docs.select("doc_id", "text"), *sample_languages(docs, ~held_out()), carried=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits")
