"""Quality rules: fixed floors on words and repeats, and robust multivariate outliers.

Each text gets a vector of transformed statistics. For each language and source a minimum covariance
determinant estimate is fitted over all its texts: from several deterministic starts, concentration
steps keep the `SUPPORT` nearest share and refit, and the start with the least determinant wins. The same is
done for each language and for all texts, and a group's estimate is drawn towards its language's, and that
towards the one of all: the wider one weighs as `PRIOR` texts, the own one as the texts kept beyond the number
of dimensions, so that a few texts say little and many say all. A text whose Mahalanobis distance from its group's estimate passes `CUTOFF`
is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import discard, documents, own_name, ship, text_udf, written
from folioflow.llm.text import code_points, combine, is_space, mix, prefix_hash, run_hashes, segment_sums, words

#: Share of a group that a concentration step keeps, and the number of steps.
SUPPORT, STEPS = 0.7, 4
#: Texts that the estimate of the wider group counts for.
PRIOR = 100
#: Rejected beyond this Mahalanobis distance.
CUTOFF = 9.0
#: A statistic's standard deviation counts as at least this; a repeated line or passage alone isn't far out.
LEAST_SPREAD = {"f_length": 0.04, "f_symbols": 0.03, "f_repeat": 0.1, "f_lines": 0.12, "f_upper": 0.03, "f_marks": 0.03}

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
STATS = T.StructType([*BASE, *(T.StructField(n, T.LongType()) for n in ("n_lines", "n_upper", "n_letters", "n_marks"))])
VECTOR = ["f_length", "f_symbols", "f_repeat", "f_lines", "f_upper", "f_marks"]
PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i, len(VECTOR))]

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), np.arange(97, 123))
_MARK = np.isin(np.arange(256), list(b"!?{}[]\\^~=_@"))


def statistics(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns of STATS for some whole texts."""
    n = len(offsets) - 1
    starts, ends, first = words(buf, offsets)
    prefix = prefix_hash(buf)
    n_words = np.diff(first)
    space = is_space(buf)
    word_chars = code_points(buf, offsets) - segment_sums(space, offsets)

    # lines with a word: the lines in which words start
    breaks = np.union1d(offsets[:-1], np.flatnonzero(buf == 10) + 1)
    line_of = np.searchsorted(breaks, starts, side="right") - 1
    lines = np.unique(line_of)
    begin = breaks[lines]
    stop = np.append(breaks, len(buf))[lines + 1]
    stop = stop - ((stop > begin) & (stop <= len(buf)) & (buf[np.maximum(stop - 1, 0)] == 10) if len(buf) else 0)
    doc = np.searchsorted(offsets, begin, side="right") - 1
    key = mix(run_hashes(buf, prefix, begin, stop) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    n_lines = np.bincount(doc, minlength=n)
    _, at = np.unique(key, return_index=True)
    n_dup = n_lines - np.bincount(doc[at], minlength=n)

    # words covered by a three-word window that its text has twice or more
    repeat = np.zeros(n, np.int64)
    grams = combine(run_hashes(buf, prefix, starts, ends), 3)
    if len(grams):
        owner = np.repeat(np.arange(n), n_words)
        inside = owner[: len(grams)] == owner[2:]
        where = np.flatnonzero(inside)
        key = mix(grams[where] + owner[where].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = where[order[twice]]
        covered = np.zeros(len(starts), bool)
        for k in range(3):
            covered[hit + k] = True
        repeat = np.bincount(owner[covered], minlength=n)
    return [n_words, word_chars, segment_sums(_SYMBOL[buf], offsets), n_dup, repeat, n_lines, segment_sums(_UPPER[buf], offsets), segment_sums(_LETTER[buf], offsets), segment_sums(_MARK[buf], offsets)]


def vector(s: Column) -> list[Column]:
    """Transformed statistics: log mean word length; square roots of shares, which evens out their variance."""
    share = lambda a, b: F.sqrt(F.least(F.lit(1.0), s[a] / F.greatest(s[b], F.lit(1))))
    return [
        F.log1p(s["word_chars"] / F.greatest(s["n_words"], F.lit(1))).alias("f_length"),
        share("n_symbols", "word_chars").alias("f_symbols"),
        share("n_repeat_words", "n_words").alias("f_repeat"),
        share("n_dup_lines", "n_lines").alias("f_lines"),
        share("n_upper", "n_letters").alias("f_upper"),
        share("n_marks", "word_chars").alias("f_marks"),
    ]


def failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (s["n_repeat_words"] * 100 > s["n_words"] * MAX_REPEAT_PERCENT)


def tags(df: DataFrame) -> DataFrame:
    """`df` with __lang and __source, which tell null from any value."""
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    return df.withColumn("__lang", tag("lang")).withColumn("__source", tag("source"))


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the vector's columns under a row's estimate."""
    diff = [F.col(v) - F.col(mean)[i] for i, v in enumerate(VECTOR)]
    total = F.lit(0.0)
    for n, (i, j) in enumerate(PAIRS):
        total = total + diff[i] * diff[j] * F.col(inverse)[n] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


#: Columns of an estimate's whitening: the upper triangle of U and then U * mean, where U'U is the inverse.
WHITE = [f"w{n}" for n in range(len(PAIRS) + len(VECTOR))]


def whitened_distance() -> Column:
    """`distance` as the squared length of U * vector - U * mean: each column is named few times, so that what Spark compiles of it stays small and fast."""
    parts = [-F.col(w) for w in WHITE[len(PAIRS) :]]
    for n, (i, j) in enumerate(PAIRS):
        parts[i] = parts[i] + F.col(WHITE[n]) * F.col(VECTOR[j])
    total = F.pow(parts[0], F.lit(2.0))
    for p in parts[1:]:
        total = total + F.pow(p, F.lit(2.0))
    return total


_D = T.ArrayType(T.DoubleType())
_DRAWN = T.StructType([T.StructField("grp", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("mean", _D), T.StructField("inverse", _D), T.StructField("cov", _D)])
_FIT = T.StructType([*_DRAWN, T.StructField("start", T.IntegerType()), T.StructField("logdet", T.DoubleType()), T.StructField("white", _D)])


def _square(upper: list[float]) -> np.ndarray:
    out = np.zeros((len(VECTOR),) * 2)
    for (i, j), x in zip(PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _upper(a: np.ndarray) -> list[float]:
    return [float(a[i, j]) for i, j in PAIRS]


def _invertible(cov: np.ndarray) -> np.ndarray:
    low = np.linalg.eigvalsh(cov)[0]
    return cov + np.eye(len(cov)) * (1e-8 - low) if low < 1e-8 else cov


def _refit(batches):
    """Means, sums of products and counts to estimates; one row for each group and start."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            n, mean = max(r.n, 1.0), np.array(r.sums) / max(r.n, 1.0)
            # the kept share of a normal cloud is narrower than the whole; 1.4 brings six dimensions at 0.7 about back
            cov = (_square(np.array(r.products) / n) - np.outer(mean, mean)) * 1.4 + np.diag([LEAST_SPREAD[v] ** 2 for v in VECTOR])
            cov = _invertible(cov)
            inverse = np.linalg.inv(cov)
            u = np.linalg.cholesky((inverse + inverse.T) / 2).T
            out.append((r.grp, n, mean.tolist(), _upper(inverse), _upper(cov), r.start, float(np.linalg.slogdet(cov)[1]), _upper(u) + (u @ mean).tolist()))
        yield pd.DataFrame(out, columns=[f.name for f in _FIT])


def _draw(batches):
    """A group's estimate and the wider group's, weighed by the group's degrees of freedom and PRIOR."""
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            mean, wide = np.array(r.mean), np.array(r.wide_mean)
            # as many texts as dimensions only span them; those beyond tell of the spread
            n = max(r.n - len(mean), 0.0)
            cov = _invertible((n * _square(r.cov) + PRIOR * _square(r.wide_cov)) / (n + PRIOR))
            out.append((r.grp, r.n, ((n * mean + PRIOR * wide) / (n + PRIOR)).tolist(), _upper(np.linalg.inv(cov)), _upper(cov)))
        yield pd.DataFrame(out, columns=[f.name for f in _DRAWN])


def _moments(df: DataFrame) -> DataFrame:
    v = [F.col(c) for c in VECTOR]
    return df.groupBy("grp", "start").agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(x) for x in v]).alias("sums"), F.array(*[F.sum(v[i] * v[j]) for i, j in PAIRS]).alias("products"))


#: Between the names of a language and of a source.
_SEP = "\x1f"
ALL = "all"


def _small(df: DataFrame, name: str) -> DataFrame:
    """A table of a row or two for each group, in one file, so that its size, small unless the groups are very many, lets Spark send it to the rows instead of dealing the rows out by group."""
    return written(df.repartition(1), name)


def concentrated(rows: DataFrame) -> DataFrame:
    """grp -> n, mean, inverse, cov: each group's minimum-covariance-determinant estimate over all of its rows (grp, *VECTOR).

    Rows meet estimates and cuts in tables of one row a group, so no group gathers in a task. Ties in
    distance are kept together; starts of equal determinant go to the first.
    """
    # starts: 0 medians and absolute deviations, 1 means and variances
    med = _small(rows.groupBy("grp").agg(*[F.percentile_approx(v, 0.5).alias(f"m_{v}") for v in VECTOR]), "mcd-medians")
    mad = rows.join(med, "grp").groupBy("grp").agg(*[F.first(f"m_{v}").alias(f"m_{v}") for v in VECTOR], *[F.percentile_approx(F.abs(F.col(v) - F.col(f"m_{v}")), 0.5).alias(f"d_{v}") for v in VECTOR])
    spread = [F.pow(F.greatest(F.lit(1.4826) * F.col(f"d_{v}"), F.lit(LEAST_SPREAD[v])), F.lit(-2.0)) for v in VECTOR]
    robust = mad.select("grp", F.lit(0).alias("start"), F.lit(0.0).alias("n"), F.array(*[F.col(f"m_{v}") for v in VECTOR]).alias("mean"), F.array(*[spread[i] if i == j else F.lit(0.0) for i, j in PAIRS]).alias("inverse"), F.array(*[F.lit(0.0)] * len(PAIRS)).alias("cov"), F.lit(0.0).alias("logdet"), F.array(*[F.sqrt(spread[i]) if i == j else F.lit(0.0) for i, j in PAIRS], *[F.sqrt(x) * F.col(f"m_{v}") for x, v in zip(spread, VECTOR, strict=True)]).alias("white"))
    plain = _moments(rows.withColumn("start", F.lit(1))).mapInPandas(_refit, _FIT)
    fit = _small(robust.unionByName(plain), "mcd-start")
    discard(med)
    for step in range(STEPS):
        white = fit.select("grp", "start", *[F.col("white")[n].alias(w) for n, w in enumerate(WHITE)])
        far = rows.join(white, "grp").select("grp", "start", whitened_distance().alias("d"))
        # d is read twice, so that Spark computes it in compiled code below the aggregate, which would evaluate it node by node
        cut = far.groupBy("grp", "start").agg(F.percentile_approx("d", SUPPORT, 10_000).alias("cut"), F.count("d").alias("n")).filter("n > 0").drop("n")
        cuts = _small(cut.join(white, ["grp", "start"]), f"mcd-cut{step}")
        kept = rows.join(cuts, "grp").filter(whitened_distance() <= F.col("cut"))
        new = _small(_moments(kept).mapInPandas(_refit, _FIT), f"mcd-{step}")
        discard(fit, cuts)
        fit = new
    best = fit.groupBy("grp").agg(F.min_by(F.struct("n", "mean", "inverse", "cov"), F.struct("logdet", "start")).alias("best"))
    return best.select("grp", "best.*")


def drawn(own: DataFrame, wide: DataFrame, to: Column) -> DataFrame:
    """grp -> n, mean, inverse, cov: `own` drawn towards the estimate of the wider group that `to` names."""
    pairs = own.withColumn("to", to).join(wide.select(F.col("grp").alias("to"), F.col("mean").alias("wide_mean"), F.col("cov").alias("wide_cov")), "to")
    return pairs.mapInPandas(_draw, _DRAWN)


def estimates(stats: DataFrame) -> DataFrame:
    """__lang, __source -> mean, inverse: estimates over all rows of `stats`, each drawn towards those of wider groups.

    A text without words takes no part; a language and source of such texts alone has no estimate.
    """
    lang, pair = F.col("__lang"), F.concat_ws(_SEP, "__lang", "__source")
    rows = stats.filter("n_words > 0").select(F.explode(F.array(pair, lang, F.lit(ALL))).alias("grp"), *VECTOR)
    fit = written(concentrated(rows), "mcd-groups")
    all_ = fit.filter(F.col("grp") == ALL)
    langs = written(drawn(fit.filter(~F.col("grp").contains(_SEP) & (F.col("grp") != ALL)), all_, F.lit(ALL)), "mcd-languages")
    own = drawn(fit.filter(F.col("grp").contains(_SEP)), langs, F.substring_index("grp", _SEP, 1))
    return written(own.select(F.substring_index("grp", _SEP, 1).alias("__lang"), F.expr(f"substring(grp, locate('{_SEP}', grp) + 1)").alias("__source"), "mean", "inverse"), "mcd")


_stats_udf = text_udf(statistics, STATS)


def judge(rows: DataFrame, s: Column, best: DataFrame) -> DataFrame:
    """`rows` with __failed and __kept; `s` is their struct of statistics."""
    keys = best.select("__lang", "__source", F.col("mean").alias("__mean"), F.col("inverse").alias("__inverse"))
    j = tags(rows).select("*", failed(s).alias("__failed"), *vector(s)).join(keys, ["__lang", "__source"], "left")
    far = F.coalesce(distance("__mean", "__inverse") > CUTOFF**2, F.lit(False))
    return j.withColumn("__kept", ~F.col("__failed") & ~far)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with its columns.

    Null or empty text has no words and fails. Null lang or source is a value of its own. Repeated rows are
    judged alike, and texts of any length whole. Extra columns pass through. An empty table gives an empty table.
    The text is read twice: once for the estimates, once for the verdicts.
    """
    ship(docs.sparkSession)
    s = own_name(docs, "stats")
    stats = docs.select("lang", "source", _stats_udf("text").alias(s))
    thin = written(tags(stats).select("__lang", "__source", f"{s}.n_words", *vector(F.col(s))), "quality")
    given = docs.select(F.struct("*").alias("__row"), "lang", "source", _stats_udf("text").alias(s))
    return judge(given, F.col(s), estimates(thin)).filter("__kept").select("__row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = written(docs.select("doc_id", "lang", "source", _stats_udf("text").alias("s")), "quality")
    fitted = estimates(tags(rows).select("__lang", "__source", "s.n_words", *vector(F.col("s"))))
    return judge(rows, F.col("s"), fitted).select("doc_id", *[f"s.{f.name}" for f in BASE], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))
