"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit one binary logistic classifier over hashed byte n-grams
tells which half of the languages a text belongs to. Decoding is loss-weighted: a codeword's
distance is the sum of the classifiers' losses against its bits, weighted by how well each
classifier does on that language; the nearest codeword wins, and a close runner-up flags the text as
ambiguous. More bits than needed make single wrong classifiers harmless.

The classifiers are fitted on a bounded sample: ``max_docs`` documents in all, the same number of
each language, chosen by a hash. The driver gets their feature vectors, ``max_docs`` x ``DIMS`` half
floats. Everything else runs on all rows.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import add_fields, appended, col, fresh, map_rows

DIMS = 1 << 13
ORDERS = (1, 2, 3, 4)
MAX_DOCS = 2048
ROUNDS = 120
AMBIGUOUS = 0.2

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_CHUNK = 1 << 20


class Model(NamedTuple):
    labels: list[str]
    codes: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # languages x bits, of the decoding
    coef: np.ndarray  # DIMS x bits
    bias: np.ndarray


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, over the letters of the whole text."""
    total = np.zeros(DIMS, np.int64)
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "
    longest = max(ORDERS)
    for begin in range(0, len(raw), _CHUNK):
        part = np.frombuffer(raw[begin : begin + _CHUNK + longest - 1], np.uint8).astype(np.uint32)
        own = min(_CHUNK, len(raw) - begin)
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            if n > len(part):
                break
            gram = gram[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            if n in ORDERS:
                mixed = gram[:own] * _FACTORS[n - 1]
                total += np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(19), minlength=DIMS)
    return np.sqrt(total / max(1, total.sum())).astype(np.float32)


def codebook(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of ``n`` languages: all useful splits for few, else the widest of random books."""
    if n < 2:
        return np.zeros((n, 0), np.int8)
    if n <= 6:
        rows = [bits for bits in product((-1, 1), repeat=n) if bits[0] == 1 and -1 in bits]
        return np.array(rows, np.int8).T
    rng = np.random.default_rng(seed)
    width = int(10 * np.ceil(np.log2(n)))
    best, widest = None, -1
    for _ in range(50):
        book = rng.choice(np.array([-1, 1], np.int8), (n, width))
        book = book[:, np.abs(book.sum(0, dtype=np.int64)) < n]
        wide = min((book[a] != book[a + 1 :]).sum(1).min() for a in range(n - 1))
        if wide > widest:
            best, widest = book, wide
    return best


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regressions for all columns of ``y`` (-1 or 1) by accelerated gradient steps."""
    coef = np.zeros((x.shape[1], y.shape[1]), np.float32)
    bias = np.zeros(y.shape[1], np.float32)
    ahead, ahead_bias, t = coef.copy(), bias.copy(), 1.0
    rate = 4.0 / 2  # rows have length one, and the bias is a feature of one more
    for _ in range(rounds):
        slope = -y / (1 + np.exp(np.clip(y * (x @ ahead + ahead_bias), -30, 30))) / len(x)
        new = ahead - rate * (x.T @ slope + decay * ahead)
        new_bias = ahead_bias - rate * slope.sum(0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + np.float32((t - 1) / t_new) * (new - coef)
        ahead_bias = new_bias + np.float32((t - 1) / t_new) * (new_bias - bias)
        coef, bias, t = new, new_bias, t_new
    return coef, bias


def _sample(docs: DataFrame, text: str, lang: str, order: Column, learn: Column, max_docs: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Labels, feature rows and label numbers of the bounded sample."""
    (place,) = fresh(docs.columns, "place")
    rows = docs.where(learn & col(lang).isNotNull() & col(text).isNotNull())
    counts = rows.groupBy(col(lang).alias("l")).count().orderBy("l").collect()
    if not counts:
        return [], np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64)
    quota = max(8, max_docs // len(counts))
    chance = F.element_at(F.create_map(*(x for r in counts for x in (F.lit(r.l), F.lit(min(1.0, 1.5 * quota / r["count"]))))), col(lang))
    picked = (rows.withColumn(place, order).where(F.pmod(col(place), F.lit(1 << 30)) < chance * (1 << 30))
              .orderBy(place).limit(2 * max(max_docs, 8 * len(counts))).select(col(lang).alias("l"), col(place).alias("h"), col(text).alias("t")))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = [features(v.as_py()).astype(np.float16).tobytes() for v in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["l", "h", "v"])

    schema = T.StructType([T.StructField("l", T.StringType()), T.StructField("h", picked.schema["h"].dataType), T.StructField("v", T.BinaryType())])
    got, taken = [], dict.fromkeys((r.l for r in counts), 0)
    for r in map_rows(picked.repartition(8), schema, fn).collect():
        got.append((r.l, r.h, r.v))
    got.sort()  # of each language the least hashes stay
    keep = []
    for label, _, vector in got:
        taken[label] += 1
        if taken[label] <= quota:
            keep.append((label, vector))
    labels = sorted({label for label, _ in keep})
    x = np.stack([np.frombuffer(v, np.float16) for _, v in keep]).astype(np.float32)
    return labels, x, np.array([labels.index(label) for label, _ in keep])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", learn: Column | None = None,
        order: Column | None = None, max_docs: int = MAX_DOCS) -> Model:
    """A model of the languages in ``lang``, from the rows where ``learn`` holds.

    Rows with null text or language teach nothing. Without any row the model knows no language.
    """
    learn = F.lit(True) if learn is None else learn
    order = F.xxhash64(col(text)) if order is None else order
    labels, x, y = _sample(docs, text, lang, order, learn, max_docs)
    codes = codebook(len(labels))
    if not codes.size:
        return Model(labels, codes, codes.astype(float), np.zeros((DIMS, 0), np.float32), np.zeros(0, np.float32))
    bits = codes[y].astype(np.float32)
    held = np.arange(len(y)) % 5 == 0
    coef, bias = _logistic(x[~held], bits[~held], ROUNDS // 2)
    right = ((x[held] @ coef + bias) * bits[held] > 0).astype(float)
    sums = np.zeros(codes.shape)
    np.add.at(sums, y[held], right)
    seen = np.bincount(y[held], minlength=len(labels))[:, None]
    weights = (sums + 1) / (seen + 2)
    weights = weights / weights.sum(1, keepdims=True)
    coef, bias = _logistic(x, bits, ROUNDS)
    return Model(labels, codes, weights, coef, bias)


def decode(model: Model, margins: np.ndarray) -> tuple[str, float, bool]:
    """The nearest codeword to the classifiers' margins, its share, and whether it is ambiguous."""
    if not model.labels:
        return "und", 0.0, False
    losses = np.logaddexp(0, -model.codes * margins)
    near = -(model.weights * losses).sum(1) * max(1, model.codes.shape[1])
    share = np.exp(near - near.max())
    share /= share.sum()
    best = int(share.argmax())
    second = float(np.delete(share, best).max()) if len(share) > 1 else 0.0
    return model.labels[best], float(share[best]), float(share[best]) - second < AMBIGUOUS


def predict(docs: DataFrame, model: Model, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; and the names they got.

    A null text, or one without a letter, is ``und`` with score 0. The whole text counts. The text
    alone decides, so repeated texts get the same answer. A name ``docs`` has already gets a ``_``.
    """
    names = dict(zip(("lang_pred", "score", "ambiguous"), fresh(docs.columns, "lang_pred", "score", "ambiguous"), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x bits and the codebook
    at = docs.columns.index(text)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, out = shared.value, []
        for value in batch.column(at):
            words = value.as_py()
            if not words or not any(map(str.isalpha, words)):
                out.append(("und", 0.0, False))
            else:
                out.append(decode(own, features(words) @ own.coef + own.bias))
        return appended(batch, *((n, pa.array(list(v), k)) for n, v, k in
                                 zip(names.values(), zip(*out, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)))

    types = (T.StringType(), T.DoubleType(), T.BooleanType())
    return map_rows(docs, add_fields(docs.schema, *zip(names.values(), types, strict=True)), fn), names
