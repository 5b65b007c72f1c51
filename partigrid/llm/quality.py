"""Quality classifier (operator 4): random-indexing word vectors, a two-layer network, calibrated probabilities.

Every word kind (a frequent form, else the word's shape) has a sparse random index vector; its word vector adds the index
vectors of the kinds that stand near it in the fitting sample. A word that comes again (behind itself, as a rare word, at
all, in a line that does) counts as a kind for that too. A document is the mean of its words' vectors and nothing else. A
network with one hidden layer maps that to a logit, and one temperature, fitted on a part of the sample that trained nothing
else, turns logits into probabilities.

Only fitting uses a sample: at most ``fit_rows`` labelled ids, those of smallest hash, one text each (the one of the least
hash where an id is repeated), and whole texts of at most ``fit_bytes`` bytes in all, those of over an eighth of that last.
These bounds don't depend on the input and hold before anything is collected. Scoring reads every whole text.

Defined cases: a null text scores as an empty one, an empty text as a document without words; rows of labels with nulls or
without a document are not learned from; an id with several labels counts as their majority (a tie: 1); without labels of
both kinds every score is the share of ones (0.5 without labels); a null id is not held out; empty tables give no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from partigrid.llm.common import fresh, give_back, kept, slices, small_batches

FIT_ROWS, FIT_BYTES, FORMS, SHAPES, DIM, HIDDEN, THRESHOLD = 4000, 16_000_000, 1500, 400, 128, 64, 0.7
_RUN = re.compile(r"(.)\1+")
_MIXED = re.compile(r"[^\W\d_]+")
REPEATS = ("#again", "#rare again", "#met again", "#line again")


def shape(word: str) -> str:
    """The word with each run of letters written as its case pattern, digits as 0, and runs of a character as two of it."""
    word = _MIXED.sub(lambda m: "a" if m[0].islower() else "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "aA", word)
    return "#" + _RUN.sub(r"\1\1", re.sub(r"\d+", "0", word))[:12]


class Kinds(dict):
    """Word to kind; up to ``keep`` words are remembered."""

    def __init__(self, vocabulary: dict[str, int], n_forms: int, keep: int = 300_000):
        super().__init__()
        self.vocabulary, self.n_forms, self.keep = vocabulary, n_forms, keep

    def __missing__(self, word: str) -> int:
        k = self.vocabulary.get(word)
        if k is None:
            k = self.vocabulary.get(shape(word), len(self.vocabulary))
        if len(self) < self.keep:
            self[word] = k
        return k


def _index_vectors(names: list[str]) -> np.ndarray:
    """Sparse ternary vectors, eight entries each, seeded by the kind's name."""
    out = np.zeros((len(names), DIM), np.float32)
    for i, name in enumerate(names):
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        out[i, rng.choice(DIM, 8, replace=False)] = rng.choice((-1.0, 1.0), 8)
    return out


def kind_counts(text: str, kinds: Kinds) -> tuple[np.ndarray, int]:
    """How often each kind stands in a text, and its number of words. Beside its own kind a word may count as REPEATS kinds:
    it is the word before it again, a rare word that was met before, any word that was, or in a line that was."""
    words = text.split()
    n, size = len(words), len(kinds.vocabulary) + 1
    k = np.fromiter(map(kinds.__getitem__, words), np.int64, n)
    ids = np.fromiter(map(hash, words), np.int64, n)
    rare = ids[k >= kinds.n_forms]
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if line in seen:
            again += len(line.split())
        seen.add(line)
    repeats = [np.count_nonzero(ids[1:] == ids[:-1]), len(rare) - len(np.unique(rare)), n - len(np.unique(ids)), again]
    return np.append(np.bincount(k, minlength=size), repeats), n


@dataclass
class Model:
    """What scoring needs; ``constant`` replaces the network where there was nothing to learn."""

    vocabulary: dict[str, int]
    n_forms: int
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    constant: float | None = None

    def features(self, texts: list[str], kinds: Kinds) -> np.ndarray:
        """The mean of the vectors of a text's kinds, for each text."""
        out = np.zeros((len(texts), DIM))
        for i, text in enumerate(texts):
            counts, n = kind_counts(text, kinds)
            out[i] = counts @ self.vectors / max(n, 1)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: list[str], kinds: Kinds) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        p = 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts, kinds)) / self.temperature, -30, 30)))
        return np.round(p, 9)  # a product's last digits depend on the texts beside


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 60) -> list[np.ndarray]:
    """Weights of the two layers by Adam on mini-batches."""
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 64):
            at = order[s : s + 64]
            h = np.tanh(x[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[at]) / len(at)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[at].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for a, g, mi, vi in zip(p, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                a -= 0.01 * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.999**t)) + 1e-8)
    return p


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Model:
    """Word vectors, network and temperature from labelled texts."""
    y = np.array(labels, float)
    none = Model({}, 0, np.zeros((1, DIM)), np.zeros(1), np.ones(1), np.zeros((1, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        none.constant = float(y.mean()) if len(y) else 0.5
        return none
    forms: Counter = Counter()
    for t in texts:
        forms.update(t.split())
    shapes: Counter = Counter()
    for w, n in forms.items():
        shapes[shape(w)] += n
    top = lambda c, n: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:n]]
    chosen = [w for w in top(forms, FORMS) if forms[w] > 4]
    names = chosen + [s for s in top(shapes, SHAPES) if s not in set(chosen)]
    vocabulary = {w: i for i, w in enumerate(names)}
    kinds, size = Kinds(vocabulary, len(chosen)), len(names) + 1
    index = _index_vectors([*names, "#other", *REPEATS])
    near = np.zeros(size * size, np.int64)
    for t in texts:
        words = t.split()
        k = np.fromiter(map(kinds.__getitem__, words), np.int64, len(words))
        for d in (1, 2):
            np.add.at(near, k[:-d] * size + k[d:], 1)
    near = near.reshape(size, size)
    context = np.zeros_like(index)
    context[:size] = (near + near.T) @ index[:size]
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = index + 2 * np.divide(context, length, out=np.zeros_like(context), where=length > 0)
    rng = np.random.default_rng(seed)
    model = replace(none, vocabulary=vocabulary, n_forms=len(chosen), vectors=vectors)
    x = model.features(texts, kinds)
    part = rng.random(len(x)) < 0.8
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part[:] = True
    model.mean, model.scale = x[part].mean(0), x[part].std(0) + 1e-3
    model.w1, model.b1, model.w2, b2 = _train((x[part] - model.mean) / model.scale, y[part], rng)
    model.b2 = float(b2[0])
    z, target = model.logits(x[~part] if not part.all() else x), y[~part] if not part.all() else y
    loss = lambda t: np.mean(np.logaddexp(0, -np.where(target > 0.5, 1, -1) * z / t))
    model.temperature = float(min(np.geomspace(0.5, 8, 60), key=loss))
    return model


def _scorer(shared, key: str, carried: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        kinds = kept(f"quality {key}", key, lambda: Kinds(model.vocabulary, model.n_forms))
        for b in slices(batches, "text"):
            s = model.scores([t or "" for t in b.column("text").to_pylist()], kinds)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], pa.array(s, pa.float64())], names=[*carried, name])

    return run


def sample_labelled(docs: DataFrame, labels: DataFrame, may_learn: F.Column, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``fit_rows`` labelled ids and ``fit_bytes`` bytes; ids are chosen before texts are read."""
    own = labels.where("doc_id is not null and quality is not null").where(may_learn)
    ids = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    size = F.octet_length("text")
    first = Window.orderBy(size > fit_bytes // 8, F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # fit_rows rows
    rows = one.withColumn("upto", F.sum(size).over(first)).where(F.col("upto") <= fit_bytes).select("doc_id", "y", "text").collect()
    rows.sort(key=lambda r: r.doc_id)
    return [r.text for r in rows], [r.y for r in rows]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, name: str = "score", carried: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (their columns ``carried``, None: all) with their score in a new column ``name``, with underscores
    in front if that is taken."""
    name, carried = fresh(name, docs.columns), docs.columns if carried is None else carried
    shared = docs.sparkSession.sparkContext.broadcast(fit(*sample_labelled(docs, labels, ~held_out())))
    give_back()
    fields = [*[docs.schema[c] for c in carried], T.StructField(name, T.DoubleType())]
    return docs.mapInArrow(_scorer(shared, uuid.uuid4().hex, carried, name), T.StructType(fields))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document: doc_id, held_out, score, predicted."""
    docs, labels = (small_batches(spark).read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_quality(docs.select("doc_id", "text"), labels, carried=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
