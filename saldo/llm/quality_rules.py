"""Quality rules by robust multivariate outliers.

Each text gives a vector of transformed statistics: the logarithm of its mean word length, and the arcsine of the root
of its shares of symbols, of repeated lines and of words in repeated windows. For every pair of language and source, for
every language, and for all rows together, the minimum covariance determinant is estimated over all rows that pass the
base rules: from deterministic starts, concentration steps take the SHARE of rows with the smallest distances and
estimate anew from those, until the determinant no longer falls. A row is rejected if its squared Mahalanobis distance is
beyond the chi-squared quantile of 1 - TAIL, under the finest estimate with at least ENOUGH rows.

Most statistics of clean text are exactly zero, so the scatter would be singular; FLOOR is added to its diagonal: the
spread, in transformed units, that the statistics of sound short texts have by chance.

All estimates are sums and quantile sketches over all rows, combined before each shuffle; what passes from step to step
is one small table per estimate, in the shared folder.

Defined cases: a null or empty text has no words and fails the base rules; null languages and sources form groups of
their own; a group with fewer than ENOUGH rows uses its language's estimate, then that of all rows; without any row
that passes the base rules nothing is estimated and nothing more rejected. Equal rows get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from saldo.llm.shingles import shingles
from saldo.session import new_folder

SHARE = 0.75
ENOUGH = 100
TAIL = 1e-5
FLOOR = (0.06, 0.05, 0.15, 0.2)
STEPS = 8
WORD_LEAST = 50
REPEATED_MOST = 50
SIZE = len(FLOOR)

_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
STATISTICS = StructType([StructField(name, LongType()) for name in _NAMES])
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SPACES = " \t\n\x0b\x0c\r"
_NO_SPACES = str.maketrans("", "", _SPACES)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def repeated_words(words: np.ndarray) -> int:
    """How many words lie in windows of three words that occur more than once."""
    if len(words) < 4:
        return 0
    windows = words[:-2] * _MIX[0] + words[1:-1] * _MIX[1] + words[2:] * _MIX[2]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(len(words), dtype=bool)
    for i in range(3):
        again[order[1:][same] + i] = True
        again[order[:-1][same] + i] = True
    return int(again.sum())


def text_statistics(texts: pa.Array) -> pa.StructArray:
    """The statistics of every text of an Arrow string column."""
    rows = []
    for text, words in zip(texts.to_pylist(), shingles(texts, size=1), strict=True):
        text = text or ""
        bare = text.translate(_NO_SPACES)
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        rows.append(
            (
                len(words),
                len(bare),
                len(bare) - len(bare.translate(_SYMBOLS)),
                len(lines) - len(set(lines)),
                repeated_words(words),
                len(lines),
            )
        )
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], _NAMES)


@F.arrow_udf(STATISTICS)
def statistics(texts: pa.Array) -> pa.Array:
    return text_statistics(texts)


def base_failed() -> Column:
    return F.expr(f"n_words < {WORD_LEAST} OR 100 * n_repeat_words > {REPEATED_MOST} * n_words")


def vector() -> Column:
    """The transformed statistics of a row; null without words."""
    share = lambda a, b: F.asin(F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))))
    return F.when(
        F.col("n_words") > 0,
        F.array(
            F.log(F.col("word_chars") / F.col("n_words")),
            share("n_symbols", "word_chars"),
            share("n_dup_lines", "n_lines"),
            share("n_repeat_words", "n_words"),
        ),
    )


def chi_squared_quantile(share: float, freedom: int) -> float:
    """By bisection on the series of the incomplete gamma function."""

    def below(x: float) -> float:
        a, x = freedom / 2, x / 2
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0

    low, high = 0.0, 500.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < share else (low, middle)
    return low


def _consistency(share: float) -> float:
    """What the scatter of the innermost share of normal data must be multiplied by."""
    cut = chi_squared_quantile(share, SIZE)
    # The part of a chi-squared variable with two more degrees of freedom below the cut.
    low, high = 1e-9, 1 - 1e-12
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared_quantile(middle, SIZE + 2) < cut else (low, middle)
    return share / low


KEY = ["level", "lang", "source"]
MODEL = "level int, lang string, source string, start int, n long, centre array<double>, inverse array<double>, size double"


def _levels(rows: DataFrame) -> DataFrame:
    """Every row once for its language and source, once for its language and once for all."""
    none = F.lit(None).cast("string")
    keys = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), none.alias("source")),
        F.struct(F.lit(2).alias("level"), none.alias("lang"), none.alias("source")),
    )
    return rows.select("v", F.explode(keys).alias("key")).select("key.*", "v")


def _same(left: str, right: str, keys: list[str]) -> Column:
    match = F.lit(True)
    for key in keys:
        match = match & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return match


def distance() -> Column:
    """Squared Mahalanobis distance of v from centre under inverse."""
    parts = []
    for i in range(SIZE):
        for j in range(i, SIZE):
            twice = 1 if i == j else 2
            parts.append(
                f"{twice} * inverse[{SIZE * i + j}] * (v[{i}] - centre[{i}]) * (v[{j}] - centre[{j}])"
            )
    return F.expr(" + ".join(parts))


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, inverse and log determinant of the floored scatter, from sums."""
    floor, factor = np.diag(np.square(FLOOR)), _consistency(SHARE)
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            centre = np.array([getattr(row, f"s{i}") for i in range(SIZE)]) / row.n
            scatter = np.zeros((SIZE, SIZE))
            for i in range(SIZE):
                for j in range(i, SIZE):
                    scatter[i, j] = scatter[j, i] = getattr(row, f"s{i}_{j}") / row.n - centre[i] * centre[j]
            scatter = factor * scatter + floor
            rows.append(
                (row.level, row.lang, row.source, row.start, row.n, centre.tolist(), np.linalg.inv(scatter).ravel().tolist(),
                 float(np.linalg.slogdet(scatter)[1]))
            )
        yield pd.DataFrame(rows, columns=["level", "lang", "source", "start", "n", "centre", "inverse", "size"])


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and its size is then known."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fit(rows: DataFrame) -> DataFrame:
    """Estimates (MODEL, and `whole`: rows of the group) from rows (lang, source, v); every row counts."""
    rows = _levels(rows.where("v IS NOT NULL"))
    middle = [F.percentile_approx(F.col("v")[i], F.lit([0.25, 0.5, 0.75]), F.lit(2000)).alias(f"q{i}") for i in range(SIZE)]
    first = rows.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), *middle)
    centre = F.array(*[F.col(f"q{i}")[1] for i in range(SIZE)])

    def diagonal(spread) -> Column:
        return F.array(
            *[F.lit(1.0) / spread(i) if i == j else F.lit(0.0) for i in range(SIZE) for j in range(SIZE)]
        )

    # Two starts: distances in units of the quartiles' spread, and in units of the floor alone.
    spread = diagonal(lambda i: F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + FLOOR[i] ** 2)
    plain = diagonal(lambda i: F.lit(FLOOR[i] ** 2))
    starts = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), x.alias("inverse")) for k, x in enumerate((spread, plain))]))
    first = first.select(*KEY, "n", centre.alias("centre"), starts.alias("s"))
    model = _kept(
        first.select(*KEY, "s.start", "n", "centre", "s.inverse", F.lit(math.inf).alias("size")), "mcd"
    )
    whole = model.where("start = 0").select(*KEY, F.col("n").alias("whole"))
    sums = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(SIZE)]
    sums += [F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"s{i}_{j}") for i in range(SIZE) for j in range(i, SIZE)]
    for _ in range(STEPS):
        near = lambda m: rows.alias("r").join(m.alias("m"), _same("r", "m", KEY)).select("m.*", "r.v")
        group = [*KEY, "start"]
        cut = _kept(
            near(model)
            .groupBy(*group, "centre", "inverse")
            .agg(F.percentile_approx(distance(), F.lit(SHARE), F.lit(2000)).alias("cut")),
            "mcd-cut",
        )
        chosen = near(cut).where(distance() <= F.col("cut")).groupBy(group).agg(F.count(F.lit(1)).alias("n"), *sums)
        new = _kept(chosen.mapInPandas(_estimates, MODEL), "mcd")
        # One number: the largest change of any determinant.
        change = (
            new.alias("a")
            .join(model.alias("b"), _same("a", "b", group))
            .agg(F.max(F.abs(F.col("a.size") - F.col("b.size"))))
            .first()[0]
        )
        model = new
        if change is None or change < 1e-3:
            break
    best = model.groupBy(KEY).agg(F.min_by(F.struct("centre", "inverse"), F.struct("size", "start")).alias("e"))
    best = best.alias("a").join(whole.alias("b"), _same("a", "b", KEY)).select("a.*", "b.whole")
    return _kept(best.select(*KEY, "e.centre", "e.inverse", "whole"), "mcd-best")


def verdict(rows: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """rows (with lang, source, v and the statistics) with base_failed, distance and kept."""
    limit = chi_squared_quantile(1 - tail, SIZE)
    out = rows.alias("r")
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        one = model.where((F.col("level") == level) & ((F.col("whole") >= ENOUGH) | (F.col("level") == 2)))
        one = one.select(
            F.col("lang").alias("_l"), F.col("source").alias("_s"), F.struct("centre", "inverse").alias(f"_e{level}")
        )
        match = F.lit(True)
        for key, name in (("lang", "_l"), ("source", "_s")):
            if key in keys:
                match = match & F.col(key).eqNullSafe(F.col(name))
        # The last level is one row, or none without any row that passes the base rules.
        out = out.join(one if keys else F.broadcast(one), match, "left").drop("_l", "_s")
    out = out.withColumn("_e", F.coalesce("_e0", "_e1", "_e2")).drop("_e0", "_e1", "_e2")
    out = out.withColumns({"centre": F.col("_e.centre"), "inverse": F.col("_e.inverse")}).drop("_e")
    out = out.withColumns({"base_failed": base_failed(), "distance": distance()}).drop("centre", "inverse")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def judged(docs: DataFrame) -> DataFrame:
    """Statistics and verdict of every document."""
    found = docs.select("doc_id", "lang", "source", statistics("text").alias("s"))
    rows = _kept(found.select("doc_id", "lang", "source", "s.*").withColumn("v", vector()), "quality")
    model = fit(rows.where(~base_failed()))
    return verdict(rows, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("distance"),
    )


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    # The statistics stand behind a generator of one row: filters are not pushed below it, and they are computed once.
    once = F.explode(F.array(statistics("text"))).alias("s")
    found = docs.select("lang", "source", once).select("lang", "source", "s.*")
    rows = _kept(found.withColumn("v", vector()).where(~base_failed()).select("lang", "source", "v"), "quality")
    model = fit(rows)
    whole = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", once)
    whole = whole.select("row", "lang", "source", "s.*").withColumn("v", vector())
    return verdict(whole, model).where("kept").select("row.*")
