"""Correlation, trend, anomaly and multivariate statistics over series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid import KEYS
from airgrid.core import attach, average_rank, exact_quantiles, ratio, row_position, value_position
from airgrid.functions.special import log_normal_cdf, normal_pvalue, t_pvalue, t_quantile
from airgrid.operators.aggregates import iqr_fences, merge_on, pivot_wide
from airgrid.operators.ordering import concordance, tied_pairs

DATASET = ("dataset_id",)


def _with_t_pvalue(rows: DataFrame, t: Column, dof: Column) -> DataFrame:
    """Adds ``p_value``, two-sided."""
    rows = rows.withColumns({"_t": t, "_dof": dof.cast("double")})
    return rows.withColumn("p_value", F.expr(t_pvalue("_t", "_dof"))).drop("_t", "_dof")


# ------------------------------------------------------------------ intervals and normality


def mean_ci(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", level: float = 0.95, least: int = 30) -> DataFrame:
    """t interval of the mean for groups of at least ``least`` values."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem")
    ).where(F.col("n") >= least)
    stats = stats.withColumn("_dof", (F.col("n") - 1).cast("double"))
    stats = stats.withColumn("_half", F.col("sem") * F.expr(t_quantile((1 + level) / 2, "_dof")))
    return stats.withColumns({"ci_low": F.col("mean") - F.col("_half"), "ci_high": F.col("mean") + F.col("_half")}).drop("_dof", "_half")


# fixed values: critical values of the Anderson-Darling normality test at 15, 10, 5, 2.5 and 1 percent
ANDERSON_CRITICAL = {"15": 0.576, "10": 0.656, "5": 0.787, "2_5": 0.918, "1": 1.092}


def anderson_darling(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value", tiebreak: Sequence[str] = ()) -> DataFrame:
    """A-squared against the normal with sample mean and deviation, and its critical values."""
    moments = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_samp(value).alias("_sd"))
    rows = attach(value_position(df.select(*keys, value, *tiebreak), keys, value, tiebreak), moments, keys)
    z, i, n = (F.col(value) - F.col("_mu")) / F.col("_sd"), F.col("_pos") + 1, F.col("_n")
    rows = rows.where(F.col("_sd") > 0).withColumn("_z", z)
    term = (2 * i - 1) * F.expr(log_normal_cdf("_z")) + (2 * (n - i) + 1) * F.expr(log_normal_cdf("(-_z)"))
    out = rows.withColumn("_term", term).groupBy(*keys).agg(
        F.max("_n").alias("n"), (-F.max("_n") - F.sum("_term") / F.max("_n")).alias("statistic")
    )
    shrink = 1 + 4 / F.col("n") - 25 / F.col("n") / F.col("n")
    return out.withColumns({f"critical_{k}": F.round(v / shrink, 3) for k, v in ANDERSON_CRITICAL.items()})


# ------------------------------------------------------------------ correlation


def _pairs(variables: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations(variables, 2))


def _pair_rows(df: DataFrame, keys: Sequence[str], fields: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Columns ``a|b|field`` to one row per pair."""
    structs = [
        F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), *[F.col(f"{a}|{b}|{f}").alias(f) for f in fields])
        for a, b in pairs
    ]
    return df.select(*keys, F.explode(F.array(*structs)).alias("_p")).select(*keys, "_p.*")


def correlation_pairs(
    wide: DataFrame, variables: Sequence[str], method: str = "pearson", keys: Sequence[str] = DATASET, time: str = "time"
) -> DataFrame:
    """One row per unordered pair with ``r`` and ``n``, over rows without nulls (see ``align_inner``)."""
    pairs = _pairs(variables)
    if method == "kendall":
        return _kendall(wide, variables, keys)
    rows = wide
    if method == "spearman":
        tall = wide.select(*keys, time, *variables).unpivot([*keys, time], list(variables), "variable", "_v")
        ranked = average_rank(tall, [*keys, "variable"], "_v", "_rank")
        rows = pivot_wide(ranked, variables, keys, time, "_rank")
    elif method != "pearson":
        raise ValueError(f"unknown correlation method: {method}")
    n = F.count(F.lit(1))
    stats = rows.groupBy(*keys).agg(
        *[F.corr(a, b).alias(f"{a}|{b}|r") for a, b in pairs], *[n.alias(f"{a}|{b}|n") for a, b in pairs]
    )
    return _pair_rows(stats, keys, ["r", "n"], pairs)


def _kendall(wide: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """tau-b from concordance counts and tie counts, all pairs of variables in one go."""
    sides = [
        F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b"))
        for a, b in _pairs(variables)
    ]
    tall = wide.select(*keys, F.explode(F.array(*sides)).alias("_p")).select(*keys, "_p.*")
    group = [*keys, "variable_a", "variable_b"]
    part = concordance(tall, group, "_a", "_b")
    for side in ("_a", "_b"):
        part = merge_on(part, tied_pairs(tall, group, side, f"_t{side}"), group)
    total = F.col("n") * (F.col("n") - 1) / 2
    tau = ratio(F.col("s"), F.sqrt((total - F.col("_t_a")) * (total - F.col("_t_b"))))
    return part.select(*group, tau.alias("r"), "n")


def _mirrored(half: DataFrame, keys: Sequence[str]) -> DataFrame:
    a, b = F.col("variable_a"), F.col("variable_b")
    return half.select(*keys, b.alias("variable_a"), a.alias("variable_b"), "r", "n")


def correlation(
    wide: DataFrame, variables: Sequence[str], method: str = "pearson", keys: Sequence[str] = DATASET
) -> DataFrame:
    """Full symmetric matrix in long form, diagonal included."""
    half = correlation_pairs(wide, variables, method, keys)
    mirrored = _mirrored(half, keys)
    sizes = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    same = sizes.select(*keys, F.explode(F.array(*[F.lit(v) for v in variables])).alias("variable_a"), "n")
    same = same.withColumns({"variable_b": F.col("variable_a"), "r": F.lit(1.0)})
    return half.unionByName(mirrored).unionByName(same)


def correlation_significance(
    wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET, alpha: float = 0.05
) -> DataFrame:
    """Pearson matrix with p-values and a significance flag."""
    r, dof = F.col("r"), (F.col("n") - 2).cast("double")
    # 1 on the diagonal gives an infinite t, whose p-value is zero
    t = F.when(F.abs(r) >= 1, F.lit(float("inf"))).otherwise(r * F.sqrt(dof / F.nullif(1 - r * r, F.lit(0.0))))
    rows = _with_t_pvalue(correlation(wide, variables, "pearson", keys).withColumn("t", t), F.col("t"), dof)
    return rows.withColumn("significant", F.col("p_value") < alpha)


def scatter_corr(wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET) -> DataFrame:
    """Lower triangle of the Pearson matrix."""
    return _mirrored(correlation_pairs(wide, variables, "pearson", keys), keys)


def _products(wide: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Means and the upper triangle of the covariance matrix: one pass, one row per key."""
    upper = [(i, j) for i in range(len(variables)) for j in range(i, len(variables))]
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(v) for v in variables]).alias("_means"),
        F.array(*[F.covar_pop(variables[i], variables[j]) for i, j in upper]).alias("_cov"),
    )


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    m = np.zeros((p, p))
    m[np.triu_indices(p)] = flat
    return m + np.triu(m, 1).T


def partial_correlation(wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET) -> DataFrame:
    """Correlation of each pair given all other variables, from the inverse covariance matrix."""
    p, pairs = len(variables), _pairs(variables)
    if p < 3:
        raise ValueError("partial correlation needs at least three variables")
    index = {v: i for i, v in enumerate(variables)}

    @F.pandas_udf("array<double>")
    def invert(cov: pd.Series) -> pd.Series:
        def one(flat):
            prec = np.linalg.pinv(_square(flat, p))
            return [-prec[index[a], index[b]] / np.sqrt(prec[index[a], index[a]] * prec[index[b], index[b]]) for a, b in pairs]

        return cov.map(one)

    stats = _products(wide, variables, keys).withColumn("_r", invert("_cov"))
    named = [F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), F.col("_r")[i].alias("partial_r")) for i, (a, b) in enumerate(pairs)]
    return stats.select(*keys, "n", F.explode(F.array(*named)).alias("_p")).select(*keys, "n", "_p.*")


def simple_regressions(
    wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET, least: int = 10
) -> DataFrame:
    """Every ordered pair: target on predictor, from one aggregation."""
    pairs = [(a, b) for a in variables for b in variables if a != b]
    aggs = []
    for x, y in pairs:
        slope = F.regr_slope(y, x)
        aggs += [
            slope.alias(f"{x}|{y}|coefficient"),
            F.regr_intercept(y, x).alias(f"{x}|{y}|intercept"),
            F.regr_r2(y, x).alias(f"{x}|{y}|r2"),
            F.regr_count(y, x).alias(f"{x}|{y}|n"),
            (F.var_pop(y) * (1 - F.regr_r2(y, x))).alias(f"{x}|{y}|mse"),
            F.var_pop(x).alias(f"{x}|{y}|_vx"),
        ]
    fields = ["coefficient", "intercept", "r2", "n", "mse", "_vx"]
    rows = _pair_rows(wide.groupBy(*keys).agg(*aggs), keys, fields, pairs)
    rows = rows.withColumnsRenamed({"variable_a": "predictor", "variable_b": "target"}).where(F.col("n") >= least)
    dof = F.col("n") - 2
    se = F.sqrt(F.col("mse") / (dof * F.col("_vx")))
    rows = rows.withColumns({"rmse": F.sqrt(F.greatest("mse", F.lit(0.0))), "std_error": se}).drop("_vx")
    return _with_t_pvalue(rows, ratio(F.col("coefficient"), F.col("std_error")), dof)


def fold_of(pos: Column, n: Column, folds: int) -> Column:
    """Contiguous folds whose sizes differ by at most one, larger ones first."""
    size, extra = F.floor(n / folds), n % folds
    edge = extra * (size + 1)
    late = extra + F.floor((pos - edge) / F.nullif(size, F.lit(0)))
    return F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(late)


def multiple_regression(
    wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET, time: str = "time", folds: int = 5
) -> DataFrame:
    """Each variable on all others with cross-validated r2 over contiguous folds.

    One pass sums the cross products per fold; the fits, whole and leave-one-fold-out, are solved from
    those sums, so that rows are neither collected nor read once per fold.
    """
    p = len(variables)
    if p < 3:
        raise ValueError("multiple regression needs at least three variables")
    columns = ["_one", *variables]
    upper = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    # products are taken around the key's mean: this keeps the sums well conditioned
    centre = wide.groupBy(*keys).agg(*[F.avg(v).alias(f"_m_{v}") for v in variables])
    rows = attach(row_position(wide.select(*keys, time, *variables), keys, time, "_pos", "_n"), centre, keys)
    rows = rows.withColumn("_fold", fold_of(F.col("_pos"), F.col("_n"), folds)).withColumns(
        {"_one": F.lit(1.0), **{v: F.col(v) - F.col(f"_m_{v}") for v in variables}}
    )
    sums = rows.groupBy(*keys, "_fold").agg(
        F.array(*[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in upper]).alias("_g"),
        *[F.max(f"_m_{v}").alias(f"_m_{v}") for v in variables],
    )
    per_key = sums.groupBy(*keys).agg(
        F.collect_list("_g").alias("_grams"), F.array(*[F.max(f"_m_{v}") for v in variables]).alias("_means")
    )
    schema = "array<struct<target string, intercept double, coefficients array<double>, r2 double, mse double, cv_r2_mean double, cv_r2_std double, n bigint>>"

    def solve(gram: np.ndarray, t: int):
        x = [c for c in range(p + 1) if c != t]
        return x, np.linalg.lstsq(gram[np.ix_(x, x)], gram[x, t], rcond=None)[0]

    def score(gram: np.ndarray, t: int, x, beta):
        sse = gram[t, t] - 2 * beta @ gram[x, t] + beta @ gram[np.ix_(x, x)] @ beta
        sst = gram[t, t] - gram[0, t] ** 2 / gram[0, 0]
        return sse, 1 - sse / sst if sst > 0 else float("nan")

    @F.pandas_udf(schema)
    def fit(grams: pd.Series, means: pd.Series) -> pd.Series:
        def one(parts, centre):
            parts = [_square(np.asarray(g), p + 1) for g in parts]
            total, out = sum(parts), []
            for t in range(1, p + 1):
                x, beta = solve(total, t)
                sse, r2 = score(total, t, x, beta)
                held = [score(g, t, *solve(total - g, t))[1] for g in parts]
                others = np.array([centre[c - 1] for c in x[1:]])
                out.append(
                    {
                        "target": variables[t - 1],
                        "intercept": float(beta[0] + centre[t - 1] - beta[1:] @ others),
                        "coefficients": [float(b) for b in beta[1:]],
                        "r2": float(r2),
                        "mse": float(sse / total[0, 0]),
                        "cv_r2_mean": float(np.mean(held)),
                        "cv_r2_std": float(np.std(held)),
                        "n": int(total[0, 0]),
                    }
                )
            return out

        return pd.Series([one(g, m) for g, m in zip(grams, means, strict=True)])

    rows = per_key.select(*keys, F.explode(fit("_grams", "_means")).alias("_f")).select(*keys, "_f.*")
    return rows.where(F.col("n") >= 2 * p).withColumn("rmse", F.sqrt("mse"))


def pca(wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET) -> DataFrame:
    """Principal components of the standardised variables: one row per component.

    Covariances are aggregated by Spark; only the variables-by-variables matrix of a key is decomposed.
    The sign is chosen so that the largest loading is positive.
    """
    p = len(variables)

    @F.pandas_udf("array<struct<component int, explained_variance double, explained_ratio double, cumulative_ratio double, loadings array<double>>>")
    def decompose(cov: pd.Series, n: pd.Series) -> pd.Series:
        def one(flat, rows):
            c = _square(flat, p)
            d = np.sqrt(np.diag(c))
            d[d == 0] = 1.0
            values, vectors = np.linalg.eigh(c / np.outer(d, d))
            order = np.argsort(values)[::-1]
            values, vectors = np.clip(values[order], 0, None), vectors[:, order]
            share = values / values.sum() if values.sum() > 0 else values
            out = []
            for i in range(p):
                v = vectors[:, i] * (1 if vectors[np.abs(vectors[:, i]).argmax(), i] >= 0 else -1)
                out.append(
                    {
                        "component": i + 1,
                        "explained_variance": float(values[i] * rows / max(rows - 1, 1)),
                        "explained_ratio": float(share[i]),
                        "cumulative_ratio": float(share[: i + 1].sum()),
                        "loadings": [float(x) for x in v],
                    }
                )
            return out

        return pd.Series([one(c, r) for c, r in zip(cov, n, strict=True)])

    stats = _products(wide, variables, keys).where(F.col("n") >= 2)
    return stats.select(*keys, F.explode(decompose("_cov", "n")).alias("_c")).select(*keys, "_c.*")


# ------------------------------------------------------------------ clustering tendency


def mean_pair_distance(df: DataFrame, columns: Sequence[str], keys: Sequence[str], identity: Sequence[str], chunk: int = 1024) -> DataFrame:
    """Exact mean Euclidean distance over all row pairs of a key.

    Rows are packed into chunks by a hash of their identity.  Pairs of chunks are the places of a triangular
    grid: a chunk is sent to every place of its row and of its column, and the place is part of the join key,
    so that one key's pairs spread over all tasks and nothing larger than two chunks meets in one place.
    Each place is one vectorised distance sum.  The work is quadratic by definition; for n rows of a
    key, n / chunk copies of each row are sent.
    """
    keys = list(keys)
    sized = attach(df, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), keys)
    chunks = F.ceil(F.col("_n") / chunk).cast("long")
    packed = (
        sized.withColumn("_chunk", F.pmod(F.xxhash64(*identity), chunks))
        .groupBy(*keys, "_n", "_chunk")
        .agg(F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).alias("_rows"))
    )

    @F.arrow_udf("double")
    def distances(left: pa.Array, right: pa.Array, same: pa.Array) -> pa.Array:
        def chunks(rows: pa.Array) -> Iterator[np.ndarray]:
            # views of the batch's numbers, no object for each row
            flat = rows.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns))
            at = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            return (flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True))

        def one(a, b, s):
            squares = np.zeros((len(a), len(b)))
            for c in range(a.shape[1]):
                squares += (a[:, c][:, None] - b[:, c][None, :]) ** 2
            return float(np.sqrt(squares).sum()) / (2.0 if s else 1.0)

        found = [one(a, b, s) for a, b, s in zip(chunks(left), chunks(right), same.to_pylist(), strict=True)]
        return pa.array(found, pa.float64(), from_pandas=True)

    last = F.ceil(F.col("_n") / chunk).cast("long") - 1
    left = packed.select(*keys, "_n", F.col("_chunk").alias("_ca"), F.explode(F.sequence("_chunk", last)).alias("_cb"), F.col("_rows").alias("_ra"))
    other = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    column = F.explode(F.sequence(F.lit(0).cast("long"), "_chunk"))
    right = packed.select(*other, column.alias("_pa"), F.col("_chunk").alias("_pb"), F.col("_rows").alias("_rb"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = left.join(right, [*same, F.col("_ca") == F.col("_pa"), F.col("_cb") == F.col("_pb")])
    parts = joined.select(*keys, "_n", distances("_ra", "_rb", F.col("_ca") == F.col("_cb")).alias("_d"))
    pairs = F.max("_n") * (F.max("_n") - 1) / 2
    return parts.groupBy(*keys).agg(F.max("_n").alias("n"), (F.sum("_d") / F.nullif(pairs, F.lit(0.0))).alias("mean_distance"))


def hopkins(wide: DataFrame, variables: Sequence[str], keys: Sequence[str] = DATASET, time: str = "time", seed: int = 42) -> DataFrame:
    """Simplified Hopkins statistic: mean pair distance of uniform points against that of the data."""
    spans = wide.groupBy(*keys).agg(
        F.least(*[F.min(v) for v in variables]).alias("_lo"), F.greatest(*[F.max(v) for v in variables]).alias("_hi")
    )
    # uniform points come from the digest of the row's identity: the same on every recomputation and in any engine
    own = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (*keys, time)])
    digits = lambda i: F.substring(F.md5(F.concat(F.lit(f"{seed + i}|"), own)), 1, 7)
    unit = lambda i: F.conv(digits(i), 16, 10).cast("double") / float(1 << 28)
    rows = attach(wide.select(*keys, time, *variables), spans, keys)
    uniform = rows.withColumns({v: F.col("_lo") + unit(i) * (F.col("_hi") - F.col("_lo")) for i, v in enumerate(variables)})
    identity = [*keys, time]
    real = mean_pair_distance(wide.select(*keys, time, *variables), variables, keys, identity)
    random = mean_pair_distance(uniform, variables, keys, identity).select(*keys, F.col("mean_distance").alias("_random"))
    both = merge_on(real, random, keys)
    h = ratio(F.col("_random"), F.col("mean_distance") + F.col("_random"))
    enough = (F.col("n") >= 10) & F.lit(len(variables) >= 2)
    label = (
        F.when(~enough | F.col("hopkins").isNull(), "insufficient_data")
        .when(F.col("hopkins") > 0.75, "high")
        .when(F.col("hopkins") > 0.5, "moderate")
        .otherwise("low")
    )
    return both.withColumn("hopkins", F.when(enough, h)).withColumn("tendency", label).drop("_random")


# ------------------------------------------------------------------ trend


def mann_kendall(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value") -> DataFrame:
    """S, its variance without tie correction, Z with continuity correction, p-value and label."""
    timed = series.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    out = concordance(timed, keys, "_t", value)
    n, s = F.col("n").cast("double"), F.col("s")
    z = (
        F.when(s > 0, (s - 1) / F.sqrt("var_s")).when(s < 0, (s + 1) / F.sqrt("var_s")).otherwise(0.0)
    )
    out = out.withColumn("var_s", n * (n - 1) * (2 * n + 5) / 18).withColumn("z", F.when(F.col("var_s") > 0, z).otherwise(0.0))
    label = F.when(F.col("z") > 1.96, "increasing").when(F.col("z") < -1.96, "decreasing").otherwise("no trend")
    return out.withColumns({"trend": label, "p_value": F.expr(normal_pvalue("z"))})


def _regression_on_position(series: DataFrame, keys, time, value, least):
    rows = row_position(series.where(F.col(value).isNotNull()), keys, time, "_pos", "n")
    rows = rows.where(F.col("n") >= least)
    stats = rows.groupBy(*keys).agg(
        F.regr_slope(value, "_pos").alias("slope"),
        F.regr_intercept(value, "_pos").alias("intercept"),
        F.regr_r2(value, "_pos").alias("r2"),
        F.max("n").alias("n"),
    )
    return rows.drop("n"), stats


def linear_trend(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", least: int = 10) -> DataFrame:
    """Regression of the valid values on their position: slope, intercept, r2, p-value, direction."""
    _, stats = _regression_on_position(series, keys, time, value, least)
    dof = F.col("n") - 2
    t = F.when(F.col("r2") < 1, F.sqrt(F.col("r2") * dof / (1 - F.col("r2")))).otherwise(F.lit(float("inf")))
    direction = F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable")
    return _with_t_pvalue(stats.withColumn("direction", direction), t, dof)


def trend_line(series: DataFrame, keys: Sequence[str] = KEYS, time: str = "time", value: str = "value", least: int = 10) -> DataFrame:
    """Adds the fitted line and the detrended value."""
    rows, stats = _regression_on_position(series, keys, time, value, least)
    out = attach(rows, stats, keys)
    line = F.col("intercept") + F.col("slope") * F.col("_pos")
    return out.select(*series.columns, line.alias("trend_line"), (F.col(value) - line).alias("detrended"))


# ------------------------------------------------------------------ anomalies


def anomalies_zscore(series: DataFrame, threshold: float = 3.0, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Adds ``zscore`` and ``is_anomaly``."""
    stats = series.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    z = F.abs(ratio(F.col(value) - F.col("_mu"), F.col("_sd")))
    rows = attach(series, stats, keys).withColumn("zscore", z).drop("_mu", "_sd")
    return rows.withColumn("is_anomaly", F.coalesce(F.col("zscore") > threshold, F.lit(False)))


def anomalies_iqr(series: DataFrame, multiplier: float = 1.5, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    rows = attach(series, iqr_fences(series, keys, value, multiplier), keys, "left")
    out = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    return rows.withColumn("is_anomaly", F.coalesce(out, F.lit(False))).drop("_low", "_high")


def anomaly_summary(flagged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return flagged.groupBy(*keys).agg(
        F.count_if("is_anomaly").alias("anomalies"), (F.count_if("is_anomaly") * 100.0 / F.count(F.lit(1))).alias("anomaly_pct")
    )


def remove_outliers(
    cube: DataFrame, method: str = "zscore", threshold: float = 3.0, keys: Sequence[str] = KEYS, value: str = "value"
) -> DataFrame:
    """Null the outliers of the whole variable; for ``iqr`` the threshold is the fence multiplier."""
    if method == "zscore":
        flagged = anomalies_zscore(cube, threshold, keys, value).drop("zscore")
    elif method == "iqr":
        flagged = anomalies_iqr(cube, threshold, keys, value)
    elif method == "isolation_forest":
        from airgrid.operators.isolation import anomalies_isolation

        flagged = anomalies_isolation(cube, keys=keys, value=value).drop("score")
    else:
        raise ValueError(f"unknown outlier method: {method}")
    return flagged.withColumn(value, F.when(~F.col("is_anomaly"), F.col(value))).drop("is_anomaly")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("exact_quantiles",)]
