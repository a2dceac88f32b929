"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered thresholds part the line of
scores. P(grade >= k) is the logistic function of the score less threshold k. The sum of these
probabilities is the expected grade; the one at the wanted grade is the tail probability by which
documents are chosen.

Features are the distinct words of the whole text, their beginnings, and tokens that say how much of it is signs,
capitals, repeats and so on, in steps of a power of two. The fit takes a bounded sample: at most
``max_docs`` rated documents, chosen by a hash; the driver gets their feature numbers and keeps
the features that part the grades best and makes steps with per-feature rates and an L1 shrinkage,
so that a long text does not gather noise.
"""

from __future__ import annotations

import math
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import add_fields, appended, col, fresh, map_rows, words_of

DIMS = 1 << 18
MAX_DOCS = 12_000
EPOCHS = 40
#: Beginnings of words, in bytes, that are features as well.
STEMS = (5, 6, 7)
#: A feature counts if so many rated documents of the sample have it.
LEAST_DOCS = 4
#: So many features are kept for the fit, those that part the grades best.
KEPT_FEATURES = 2048
SHRINK = 1e-2
RATE = 0.7
KEEP = 0.8

_SIGNS = b"#*$%&|<>!?@=~^_{}[]\\/"
_LOWER = bytes(range(97, 123))
_UPPER = bytes(range(65, 91))


class Model(NamedTuple):
    weights: np.ndarray | None
    thresholds: np.ndarray


def _step(share: float) -> int:
    """A share of 0 to 1 in steps of a power of two, from 0 (none) to 9 (most)."""
    return 0 if share <= 0 else max(1, 9 + math.ceil(math.log2(min(1.0, share))))


def features(text: bytes) -> np.ndarray:
    """The numbers of a text's distinct features."""
    raw, words = text.split(), words_of(text)
    tokens = set(words)
    n = max(1, len(raw))
    out = [b"\0n%d" % min(20, len(words).bit_length())]
    for sign in _SIGNS:
        if count := text.count(sign):
            out.append(b"\0s%d:%d" % (sign, _step(count / n)))
    letters = len(text.translate(None, _LOWER)) - len(text.translate(None, _LOWER + _UPPER))
    out.append(b"\0u%d" % _step(letters / max(1, len(text))))
    out.append(b"\0d%d" % _step(len(tokens) / max(1, len(words))))
    out.append(b"\0a%d" % _step(sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / n))
    lines = [line for line in text.split(b"\n") if line.strip()]
    out.append(b"\0l%d" % _step(1 - len(set(lines)) / max(1, len(lines))))
    for n in STEMS:
        out += {b"\0p" + t[:n] for t in tokens if len(t) > n}
    return (np.fromiter(map(crc32, [*tokens, *out]), np.int64) & (DIMS - 1)).astype(np.int32)


def _chances(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. grades - 1, a column each."""
    return 1 / (1 + np.exp(-np.clip(scores[:, None] - thresholds, -35, 35)))


def _telling(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Marks the features that part the grades best: the ``KEPT_FEATURES`` of highest G statistic,
    over the ways to part the grades in two."""
    which, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    have = np.bincount(which, minlength=DIMS).astype(float)
    best = np.zeros(DIMS)
    for k in range(1, n_grades):
        high = grades >= k
        if 0 < high.sum() < len(high):
            with_high = np.bincount(which, np.repeat(high, sizes).astype(float), DIMS)
            cells = ((with_high, high.mean()), (have - with_high, 1 - high.mean()))
            best = np.maximum(best, 2 * sum(np.where(c > 0, c * np.log(np.maximum(c, 1) / np.maximum(have * s, 1e-9)), 0) for c, s in cells))
    best[have < min(LEAST_DOCS, max(1, len(rows) // 4))] = 0
    chosen = np.zeros(DIMS, bool)
    chosen[np.argsort(-best, kind="stable")[:KEPT_FEATURES]] = True
    return chosen & (best > 0)


def train(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> Model:
    """Fit weights and thresholds to feature rows and their grades (0 .. n_grades - 1)."""
    usable = _telling(rows, grades, n_grades)
    rows = [r[usable[r]] for r in rows]
    shares = np.array([max(1, (grades >= k).sum()) / (len(grades) + 1) for k in range(1, n_grades)])
    thresholds = np.sort(-np.log(shares / (1 - shares)))
    weights, speed = np.zeros(DIMS), np.full(DIMS, 1e-3)
    t_speed = np.full(n_grades - 1, 1e-3)
    rng = np.random.default_rng(5)
    mean, t_mean, n_mean = np.zeros(DIMS), np.zeros(n_grades - 1), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), 256):
            take = order[begin : begin + 256]
            sizes = np.array([len(rows[i]) for i in take])
            which = np.concatenate([rows[i] for i in take])
            owner = np.repeat(np.arange(len(take)), sizes)
            scores = np.bincount(owner, weights[which], len(take))
            above = _chances(scores, thresholds)
            full = np.concatenate((np.ones((len(take), 1)), above, np.zeros((len(take), 1))), axis=1)
            y, at = grades[take], np.arange(len(take))
            a, b = full[at, y], full[at, y + 1]
            likely = np.maximum(a - b, 1e-9)
            slope = (a + b - 1) / len(take)
            pull = np.zeros((len(take), n_grades + 1))
            pull[at, y] += a * (1 - a) / likely
            pull[at, y + 1] -= b * (1 - b) / likely
            t_slope = pull[:, 1:n_grades].mean(0)
            seen, place = np.unique(which, return_inverse=True)
            grad = np.bincount(place, slope[owner], len(seen))
            speed[seen] += grad * grad
            rate = RATE / np.sqrt(speed[seen])
            new = weights[seen] - rate * grad
            weights[seen] = np.sign(new) * np.maximum(np.abs(new) - rate * SHRINK * 256 / len(rows), 0)
            t_speed += t_slope * t_slope
            thresholds = np.maximum.accumulate(thresholds - 0.1 * t_slope / np.sqrt(t_speed) + np.arange(n_grades - 1) * 1e-9)
            if 2 * epoch >= EPOCHS:
                mean += weights
                t_mean += thresholds
                n_mean += 1
    return Model((mean / n_mean).astype(np.float32), t_mean / n_mean)


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, doc_id: str = "doc_id",
        text: str = "text", max_docs: int = MAX_DOCS) -> Model:
    """A model from the rated documents; ``grade`` is a column of ``ratings``, 0 to ``n_grades - 1``.

    Ratings with a null id or grade and null texts teach nothing. Without any, the model is empty.
    """
    rated = (ratings.select(col(doc_id).alias("i"), grade.cast("int").alias("g"))
             .where(f"i is not null and g between 0 and {n_grades - 1}")
             .orderBy(F.xxhash64("i"), "i", "g").limit(max_docs))
    rows = (docs.select(col(doc_id).alias("i"), col(text).alias("t")).where("t is not null")
            .join(F.broadcast(rated), "i")  # at most max_docs rows of two numbers
            .orderBy(F.xxhash64("i", "t"), "i", "g").limit(max_docs).select("g", "t"))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(v.as_py()).tobytes() for v in batch.column(1).cast(pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["g", "f"])

    schema = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("f", T.BinaryType())])
    got = sorted((r.g, bytes(r.f)) for r in map_rows(rows.repartition(8), schema, fn).collect())
    if not got:
        return Model(None, np.zeros(n_grades - 1))
    return train([np.frombuffer(f, np.int32) for _, f in got], np.array([g for g, _ in got]), n_grades)


def score(docs: DataFrame, model: Model, text: str = "text", tail: int | None = None, keep: float = KEEP,
          only_kept: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``expected_grade``, ``tail_prob`` (of grade ``tail`` or more, by default the
    best) and ``kept`` (``tail_prob >= keep``); and the names they got, as some may be taken.

    With ``only_kept`` the rejected rows go and no column is added. A null text counts as empty,
    whose length is a feature like others. Equal texts score alike. An empty model gives nulls and
    keeps all.
    """
    names = dict(zip(("expected_grade", "tail_prob", "kept"), fresh(docs.columns, "expected_grade", "tail_prob", "kept"), strict=True))
    tail = len(model.thresholds) if tail is None else tail
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights
    at = docs.columns.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        if own.weights is None:
            nothing = pa.nulls(batch.num_rows, pa.float64())
            grade, top, kept = nothing, nothing, pa.array([True] * batch.num_rows)
        else:
            scores = np.array([own.weights[features(v.as_py() or b"")].sum(dtype=np.float64)
                               for v in batch.column(at).cast(pa.binary())])
            above = _chances(scores, own.thresholds)
            grade, top = pa.array(above.sum(1)), pa.array(above[:, tail - 1])
            kept = pa.array(above[:, tail - 1] >= keep)
        if only_kept:
            return batch.filter(kept)
        return appended(batch, (names["expected_grade"], grade), (names["tail_prob"], top), (names["kept"], kept))

    types = (T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = docs.schema if only_kept else add_fields(docs.schema, *zip(names.values(), types, strict=True))
    return map_rows(docs, schema, fn), names


def quality_grade() -> Column:
    """The grade of a row of ``labels``: 0 poor, 1 well written but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2)


N_GRADES = 3
