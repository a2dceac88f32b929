"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed statistics: word length, signs, repeated lines,
repeated words and length. For each (language, source) a minimum-covariance-determinant estimate
gives centre and scatter of the half of its documents that lie closest together; a document is
rejected if its Mahalanobis distance from there is beyond a chi-square quantile.

The estimate runs on all rows. A C-step needs the sums over the ``h`` rows of least distance; they
come from one aggregate of counts, sums and products by (group, bin of distance), folded on the map
side, so a group of any size is a few hundred rows when its new centre is worked out. Several
deterministic starts run side by side. The text is read once; the vectors are written to the shared
folder and every step starts from them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saleslens.llm.common import add_fields, appended, col, map_rows, staged
from saleslens.session import ship

FEATURES = ("word_length", "signs", "dup_lines", "repeats", "length")
#: Scatter below this in a statistic counts as this, about its measurement error in one document: a
#: statistic that is the same for most documents of a group has no scatter of its own.
FLOORS = (0.03, 0.15, 0.10, 0.12, 0.10)
#: Scatter below this (as a variance) is none: such directions do not count in the consistency factor.
NO_SCATTER = 1e-6
#: Lines added to a document's own where the share of repeated ones is taken: one of three is chance.
LINE_PAD = 10
#: A group with fewer documents joins the others like it of its language, and those the rest.
LEAST_ROWS = 40
SUPPORT = 0.5
STEPS = 6
QUANTILE = 0.999
BINS_PER_OCTAVE = 16
#: A group's rows meet its model in so many parts.
PARTS = 32

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i, _P)]


# ---------------------------------------------------------------------------------------------
# statistics of a text


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    size = len(numbers)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 21:  # three numbers in one would not fit 63 bits
        _, pairs = np.unique(pairs, return_inverse=True)
    windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    ordered = windows[order]
    same = ordered[1:] == ordered[:-1]
    again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, int]:
    """Words, code points in words, signs, repeated lines, repeated words, lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (len(words), chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words), len(lines))


def plain_repeat_words(text: str) -> int:
    """``repeat_words`` by counting, for tests."""
    words = text.encode().split()
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i in range(len(words) - 2) if counts[tuple(words[i : i + 3])] > 1 for k in range(3)})


# ---------------------------------------------------------------------------------------------
# small numerics


def chi2_cdf(x: float, df: int) -> float:
    """The chi-square distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = df / 2, x / 2
    if half > a + 60:
        return 1.0
    term = total = 1 / a
    for k in range(1, 2000):
        term *= half / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(share: float, df: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, df) < share else (low, middle)
    return (low + high) / 2


def _scatter(n: float, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance."""
    centre = sums / n
    cov = np.zeros((_P, _P))
    for (i, j), total in zip(_PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = total / n - centre[i] * centre[j]
    return centre, cov


def _guarded(cov: np.ndarray) -> np.ndarray:
    """A covariance with no variance below the square of its floor; larger ones stay as they are."""
    return cov + np.diag(np.maximum(0.0, np.square(FLOORS) - np.diag(cov)))


def _whiten(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The matrix that whitens deviations under the guarded ``cov``, and its log determinant."""
    values, vectors = np.linalg.eigh(_guarded(cov))
    values = np.maximum(values, min(FLOORS) ** 2)
    return (vectors / np.sqrt(values)).T, float(np.log(values).sum())


def _row(group: str, start: int, centre: np.ndarray, cov: np.ndarray) -> dict:
    """A group's centre, covariance, and the matrix that whitens deviations from the centre."""
    white, logdet = _whiten(cov)
    return {"g": group, "s": start, "c": centre.tolist(), "w": white.ravel().tolist(), "logdet": logdet, "cov": cov.ravel().tolist()}


_MODEL = T.StructType([
    T.StructField("g", T.StringType()), T.StructField("s", T.IntegerType()), T.StructField("c", T.ArrayType(T.DoubleType())),
    T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("logdet", T.DoubleType()), T.StructField("cov", T.ArrayType(T.DoubleType())),
])
_ARROW = pa.schema([("g", pa.string()), ("s", pa.int32()), ("c", pa.list_(pa.float64())), ("w", pa.list_(pa.float64())),
                    ("logdet", pa.float64()), ("cov", pa.list_(pa.float64()))])


# ---------------------------------------------------------------------------------------------
# the estimate


def _moments(values: list) -> list:
    return [*(F.sum(v).alias(f"m{i}") for i, v in enumerate(values)),
            *(F.sum(values[i] * values[j]).alias(f"q{i}_{j}") for i, j in _PAIRS)]


def _sums(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return (np.column_stack([table[f"m{i}"].to_numpy() for i in range(_P)]),
            np.column_stack([table[f"q{i}_{j}"].to_numpy() for i, j in _PAIRS]))


def _distance(rows: DataFrame):
    """The squared Mahalanobis distance of ``x`` from ``c`` under ``w``."""
    off = [F.element_at("x", i + 1) - F.element_at("c", i + 1) for i in range(_P)]
    parts = [sum(F.element_at("w", k * _P + i + 1) * off[i] for i in range(_P)) for k in range(_P)]
    return sum(p * p for p in parts)


def _parted(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with the part of their group that they are in."""
    return rows.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int"))


def _with(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Rows joined with their group's row of ``model``, which comes once for each part: a large
    group is spread over the tasks, also where the model is too large to be broadcast."""
    parts = model.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.join(parts, ["g", "part"]).drop("part")


def _bin(distance):
    return F.greatest(F.lit(-320), F.least(F.lit(960), F.floor(F.log2(distance + 1e-30) * BINS_PER_OCTAVE))).cast("int")


def _starts(rows: DataFrame) -> DataFrame:
    """Three first scatters of each group: of tanh scores, of spatial signs, and the plain scales."""
    x = [F.element_at("x", i + 1) for i in range(_P)]
    middle = rows.groupBy("g").agg(*(F.percentile(F.round(v, 3), F.lit(0.5)).alias(f"a{i}") for i, v in enumerate(x)))
    middle = staged(middle, "outliers-middle")
    spread = (_with(rows, middle).groupBy("g").agg(
        *(F.first(f"a{i}").alias(f"a{i}") for i in range(_P)),
        *(F.percentile(F.round(F.abs(v - F.col(f"a{i}")), 3), F.lit(0.5)).alias(f"d{i}") for i, v in enumerate(x))))
    spread = staged(spread, "outliers-spread")
    score = [(v - F.col(f"a{i}")) / F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOORS[i])) for i, v in enumerate(x)]
    scored = _with(rows, spread).select("g", F.array(*score).alias("z"), *(f"{k}{i}" for k in "ad" for i in range(_P)))
    z = [F.element_at("z", i + 1) for i in range(_P)]
    norm = F.sqrt(sum(v * v for v in z) + 1e-12)
    keep = [F.first(f"{k}{i}").alias(f"{k}{i}") for k in "ad" for i in range(_P)]
    tanh = scored.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *keep, *_moments([F.tanh(v) for v in z])).withColumn("s", F.lit(0))
    sign = scored.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *keep, *_moments([v / norm for v in z])).withColumn("s", F.lit(1))
    both = tanh.unionByName(sign)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = pa.Table.from_batches([batch])
        sums, products = _sums(table)
        out = []
        for k, (group, start, n) in enumerate(zip(table["g"].to_pylist(), table["s"].to_pylist(), table["n"].to_pylist(), strict=True)):
            centre = np.array([table[f"a{i}"][k].as_py() for i in range(_P)])
            scale = np.maximum(np.array([table[f"d{i}"][k].as_py() for i in range(_P)]) * 1.4826, FLOORS)
            mean = sums[k] / n
            cov = np.zeros((_P, _P))
            for (i, j), total in zip(_PAIRS, products[k], strict=True):
                cov[i, j] = cov[j, i] = total / n - mean[i] * mean[j]
            size = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            out.append(_row(group, start, centre, cov / np.outer(size, size) * np.outer(scale, scale) + 1e-6 * np.diag(scale**2)))
            if start == 0:
                out.append(_row(group, 2, centre, np.diag(scale**2)))
        return pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return map_rows(both, _MODEL, fn)


def _step(rows: DataFrame, model: DataFrame, support: float) -> DataFrame:
    """A C-step of all groups and starts: centre and scatter of the nearest ``support`` of rows."""
    x = [F.element_at("x", i + 1) for i in range(_P)]
    binned = _with(rows, model).withColumn("b", _bin(_distance(rows)))
    sums = binned.groupBy("g", "s", "b").agg(F.count(F.lit(1)).alias("n"), *_moments(x))

    def fn(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        counts = table["n"].to_numpy()
        last = int(np.searchsorted(np.cumsum(counts), math.ceil(support * counts.sum())))
        part = slice(0, last + 1)
        sums, products = _sums(table)
        centre, cov = _scatter(counts[part].sum(), sums[part].sum(0), products[part].sum(0))
        return pa.Table.from_pylist([_row(table["g"][0].as_py(), table["s"][0].as_py(), centre, cov)], schema=_ARROW)

    ship(rows.sparkSession)
    return sums.groupBy("g", "s").applyInArrow(fn, _MODEL)


def _best(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Of each group the start of least determinant, its covariance made consistent: the middle
    distance becomes that of a chi-square variable. It is taken over the directions in which the
    nearest half has scatter, with as many degrees of freedom, and before the floors, so that
    neither a group without scatter nor a floor moves the factor."""
    best = model.groupBy("g").agg(F.min(F.struct("logdet", "s", "c", "cov")).alias("m")).select("g", "m.c", "m.cov")

    def bare(batch: pa.RecordBatch) -> pa.RecordBatch:
        whites, sizes = [], []
        for cov in batch.column(2).to_pylist():
            values, vectors = np.linalg.eigh(np.reshape(cov, (_P, _P)))
            has = values > NO_SCATTER
            whites.append((vectors * np.where(has, 1 / np.sqrt(np.maximum(values, NO_SCATTER)), 0.0)).T.ravel().tolist())
            sizes.append(int(has.sum()))
        return appended(batch, ("w", pa.array(whites, pa.list_(pa.float64()))), ("df", pa.array(sizes, pa.int32())))

    many = T.ArrayType(T.DoubleType())
    best = staged(map_rows(best, add_fields(best.schema, ("w", many), ("df", T.IntegerType())), bare), "outliers-best")
    bins = _with(rows, best.select("g", "c", "w")).groupBy("g", _bin(_distance(rows)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    targets = [1.0, *(chi2_quantile(SUPPORT, df) for df in range(1, _P + 1))]

    def middle(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        counts = table["n"].to_numpy()
        at = int(np.searchsorted(np.cumsum(counts), math.ceil(SUPPORT * counts.sum())))
        return pa.table({"g": [table["g"][0].as_py()], "middle": [2.0 ** ((table["b"][at].as_py() + 0.5) / BINS_PER_OCTAVE)]})

    schema = T.StructType([T.StructField("g", T.StringType()), T.StructField("middle", T.DoubleType())])
    found = best.join(bins.groupBy("g").applyInArrow(middle, schema), "g").select("g", "c", "cov", "df", "middle")

    def consistent(batch: pa.RecordBatch) -> pa.RecordBatch:
        whites = []
        for cov, df, middle in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            factor = middle / targets[df] if df else 1.0
            whites.append(_whiten(factor * np.reshape(cov, (_P, _P)))[0].ravel().tolist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whites, pa.list_(pa.float64()))], names=["g", "c", "w"])

    return map_rows(found, T.StructType([T.StructField("g", T.StringType()), T.StructField("c", many), T.StructField("w", many)]), consistent)


def estimate(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Centre ``c`` and whitening ``w`` of each group ``g`` of vectors ``x``."""
    model = staged(_starts(rows), "outliers-starts")
    for k in range(steps):
        model = staged(_step(rows, model, support), f"outliers-step{k}")
    return staged(_best(rows, model), "outliers-model")


def _grouped(rows: DataFrame, least: int) -> DataFrame:
    """``rows`` with their group ``g``: language and source, or what small groups join; null where
    even all small ones together are too few."""
    whole = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    rows = rows.withColumn("l", whole(F.col("lang"))).withColumn("o", whole(F.col("source")))
    counts = staged(rows.groupBy("l", "o").agg(F.count(F.lit(1)).alias("n")), "outliers-groups")
    small = counts.where(F.col("n") < least)
    pools = small.groupBy("l").agg(F.sum("n").alias("pool"))
    rest = pools.where(F.col("pool") < least).agg(F.coalesce(F.sum("pool"), F.lit(0))).first()[0]
    named = counts.join(pools, "l", "left").select("l", "o", F.when(F.col("n") >= least, F.concat_ws("\0", F.lit("own"), "l", "o")).when(
        F.col("pool") >= least, F.concat_ws("\0", F.lit("language"), "l")).when(F.lit(rest >= least), F.lit("rest")).alias("g"))
    return rows.join(named, ["l", "o"]).drop("l", "o")


def outliers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
             least: int = LEAST_ROWS, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: its counts, ``base_failed``, ``kept`` and the ``distance``.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows. Only
    other documents are judged by distance (``distance`` is null for the rest) and only they make
    the estimates. A null or empty text has no words and fails. Null languages and sources are
    values of their own. Documents of a group too small for an estimate join those of their
    language, else of all small groups; where even these are under ``least``, they are kept.
    Repeated rows each get a row; ties in distance share their fate. Other columns are not read.
    """
    source_rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), col(lang).cast("string").alias("lang"), col(source).cast("string").alias("source"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    keep = [f for f in source_rows.schema.fields if f.name != "text"]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(v.as_py()) for v in batch.column(1)]
        own = [batch.column(0), batch.column(2), batch.column(3)]
        return pa.RecordBatch.from_arrays([*own, *(pa.array(list(v), pa.int64()) for v in zip(*found, strict=True))],
                                          names=[*(f.name for f in keep), *names])

    counted = map_rows(source_rows, T.StructType([*keep, *(T.StructField(n, T.LongType()) for n in names)]), fn)
    counted = counted.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    counted = staged(counted, "outliers-counts")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    x = F.when(~F.col("base_failed"), F.array(
        F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.5))),
        F.log1p(100 * share("n_symbols", "word_chars")) / 2,
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + LINE_PAD)),
        F.asin(F.sqrt(share("n_repeat_words", "n_words"))),
        F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")) / 2,
    ))
    judged = counted.where("not base_failed").withColumn("x", x)
    grouped = staged(_grouped(judged, least), "outliers-vectors")
    grouped = _parted(grouped, "doc_id", "n_words", "word_chars")
    model = estimate(grouped.where("g is not null").select("g", "x", "part"))
    cutoff = chi2_quantile(quantile, _P)
    parts = model.select("g", "c", "w", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    far = grouped.join(parts, ["g", "part"], "left").withColumn("distance", F.sqrt(_distance(grouped)))
    out = ["doc_id", *names[:-1], "base_failed"]
    near = far.select(*out, F.coalesce(F.col("distance") <= math.sqrt(cutoff), F.lit(True)).alias("kept"), "distance")
    failed = counted.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return near.unionByName(failed)
