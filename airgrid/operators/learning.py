"""Feature preparation, scaling, selection, model training and evaluation on MLlib.

Model fits are actions by nature (``train``, ``rfe``, ``run_training``); everything else stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    GBTRegressionModel, GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from airgrid.core import attach, ensure_checkpoint_dir, exact_quantiles, lookup, materialize, same_keys
from airgrid.functions.scaling import adjusted_skew, log1p_if_skewed
from airgrid.operators.aggregates import metric_columns, pivot_wide, prediction_band, residual_columns, spatial_mean
from airgrid.operators.forest import ForestModel, RandomForest, eliminate
from airgrid.operators.ranking import best_model, top_features
from airgrid.operators.slicing import drop_any_null, drop_missing_target, replace_infinite
from airgrid.operators.windows import (
    FeatureBlocks, FeaturePlan, base_columns, chrono_split, engineer_features, feature_matrix, own_places, wide_arrays,
)

FEATURES, TARGET, PREDICTION = "features", "label", "prediction"
DEFAULT_MODELS = ("linear", "ridge", "random_forest")
#: names of boosted-tree engines that are served by MLlib's model; results carry the name of the model that ran
ALIASES = {"xgboost": "gradient_boosting", "lightgbm": "gradient_boosting"}
#: "unlimited" means this, MLlib's deepest tree
DEEPEST = 30
#: rows of a partition that models are fitted on; with fewer, the hundreds of jobs of a fit mostly start tasks
FIT_ROWS = 32_768
#: sums of a feature x and the label y that scores are made of
MOMENTS = ("n", "x", "xx", "xy", "y", "yy")
SUMS = "place int, " + ", ".join(f"{c} double" for c in MOMENTS)
MODELS = {m.__name__: m for m in (LinearRegressionModel, RandomForestRegressionModel, GBTRegressionModel, ForestModel)}


def prepare(
    cube: DataFrame, target: str, variables: Sequence[str], keys: Sequence[str] = ("dataset_id",), time: str = "time", **features
) -> DataFrame:
    """Cube to ML-ready table: spatial means, one column per variable, engineered features, complete rows."""
    series = spatial_mean(cube, [*keys, "variable"], time)
    wide = drop_missing_target(pivot_wide(series, variables, keys, time), target)
    engineered = engineer_features(wide, target, variables, keys, time, **features)
    return drop_any_null(replace_infinite(engineered))


def prepare_matrix(
    cube: DataFrame, plan: FeaturePlan, keys: Sequence[str] = ("dataset_id",), time: str = "time", value: str = "value", drop_nulls: bool = True
) -> DataFrame:
    """``prepare`` at full width: ``keys, time, features`` with all features of ``plan`` as one array per row."""
    wide = pivot_wide(spatial_mean(cube, [*keys, "variable"], time), plan.variables, keys, time, value)
    return feature_matrix(drop_missing_target(wide, plan.target), plan, keys, time, drop_nulls)


@dataclass(frozen=True)
class MatrixTable:
    """Rows of a feature matrix with their split and label; ``features`` leaves the target itself out."""

    rows: DataFrame
    names: tuple[str, ...]

    def part(self, split: str) -> DataFrame:
        """The rows of one split."""
        return self.rows.where(F.col("split") == split)

    def columns(self, chosen: Sequence[str], keep: Sequence[str], target: str) -> DataFrame:
        """The chosen features as columns."""
        return self.rows.select(*keep, F.col(TARGET).alias(target), *expanded(self.names, chosen))

    def train_scores(self) -> DataFrame:
        """``matrix_scores`` of the training rows."""
        return matrix_scores(self.part("train"), self.names)


def expanded(names: Sequence[str], chosen: Sequence[str]) -> list[Column]:
    place = {n: i for i, n in enumerate(names)}
    return [F.get(FEATURES, F.lit(place[c])).alias(c) for c in chosen]


def matrix_table(matrix: DataFrame, plan: FeaturePlan, keys: Sequence[str] = ("dataset_id",), time: str = "time") -> MatrixTable:
    """Splits a feature matrix in time.

    Only keys and times are sorted for that; the wide rows learn the first times of their key's last two
    splits from a table with one row per key.
    """
    matrix, at = materialize(matrix), plan.names.index(plan.target)
    label = F.get(FEATURES, F.lit(at))
    others = F.concat(F.slice(FEATURES, 1, at), F.slice(FEATURES, at + 2, len(plan.names)))
    rows = in_splits(matrix, matrix, keys, time).select(*keys, time, "split", label.alias(TARGET), others.alias(FEATURES))
    return MatrixTable(rows, tuple(n for n in plan.names if n != plan.target))


def in_splits(rows: DataFrame, counted: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Adds the ``split`` that ``chrono_split`` gives the ``counted`` rows."""
    first = lambda name: F.min(F.when(F.col("split") == name, F.col(time)))
    starts = chrono_split(counted.select(*keys, time), keys, time).groupBy(*keys).agg(first("val").alias("_val"), first("test").alias("_test"))
    split = F.when(F.col(time) >= F.col("_test"), "test").when(F.col(time) >= F.col("_val"), "val").otherwise("train")
    return lookup(rows, starts, keys, "left").withColumn("split", split).drop("_val", "_test")


@dataclass(frozen=True)
class BlockTable(MatrixTable):
    """A matrix table that keeps its blocks, not the wide rows: a task works out what is asked of a block and hands on only that.

    ``rows`` works out the whole matrix each time it is read.
    """

    blocks: FeatureBlocks

    def part(self, split: str) -> DataFrame:
        return wide_rows(self.blocks, split)

    def columns(self, chosen: Sequence[str], keep: Sequence[str], target: str) -> DataFrame:
        plan, keep, chosen = self.blocks.plan, list(keep), list(chosen)

        def work(table: pa.Table) -> pa.Table:
            table = table.sort_by("_pos")
            own = np.asarray(table["_kept"])
            found = worked_out(plan, table, own, [plan.target, *chosen])
            out = table.select(keep).filter(pa.array(own))
            for name, values in zip([target, *chosen], found.T, strict=True):
                out = out.append_column(name, pa.array(values))
            return out

        double = lambda name: F.lit(None).cast("double").alias(name)
        return self.blocks.apply(work, self.blocks.rows.select(*keep, double(target), *map(double, chosen)).schema)

    def train_scores(self) -> DataFrame:
        rows, plan, names = self.blocks.rows, self.blocks.plan, self.names
        sample = rows.where(F.col("_kept") & (F.col("split") == "train")).select(*self.blocks.keys, "_block").limit(1)
        found = wide_rows(replace(self.blocks, rows=same_keys(rows, F.broadcast(sample), [*self.blocks.keys, "_block"])), "train").select(FEATURES, TARGET).first()
        if found is None:
            return no_scores(rows.sparkSession)
        shift, origin = np.array(found[FEATURES]), found[TARGET]

        def work(table: pa.Table) -> pa.Table:
            table = table.sort_by("_pos")
            own = np.asarray(table["_kept"]) & (np.asarray(table["split"]) == "train")
            label, features = label_and_features(plan, worked_out(plan, table, own))
            return pa.Table.from_batches([sums_batch(moment_sums(features, label, shift, origin))])

        return scores_from_sums(self.blocks.apply(work, SUMS), names)


def worked_out(plan: FeaturePlan, table: pa.Table, wanted: np.ndarray, names: Sequence[str] | None = None) -> np.ndarray:
    """The matrix of the wanted rows of a block, from the stretch that they look at."""
    places = np.flatnonzero(wanted)
    if not len(places):
        return np.empty((0, len(plan.names if names is None else names)))
    first, end = max(places[0] - plan.reach, 0), places[-1] + 1
    return plan.rows(base_columns(plan, table.slice(first, end - first)), names)[wanted[first:end]]


def label_and_features(plan: FeaturePlan, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = plan.names.index(plan.target)
    return matrix[:, at], np.delete(matrix, at, axis=1)


def wide_rows(blocks: FeatureBlocks, split: str | None = None) -> DataFrame:
    """Rows of a ``MatrixTable`` from marked blocks, all or those of one split."""
    plan, head = blocks.plan, [*blocks.keys, blocks.time, "split"]

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        own = np.asarray(table["_kept"])
        if split is not None:
            own = own & (np.asarray(table["split"]) == split)
        label, features = label_and_features(plan, worked_out(plan, table, own))
        return table.select(head).filter(pa.array(own)).append_column(TARGET, pa.array(label)).append_column(FEATURES, wide_arrays(features))

    kinds = [F.lit(None).cast("double").alias(TARGET), F.lit(None).cast("array<double>").alias(FEATURES)]
    return blocks.apply(work, blocks.rows.select(*head, *kinds).schema)


def block_table(blocks: FeatureBlocks) -> BlockTable:
    """``matrix_table`` of features that are not stored: two thousand numbers a row stay inside the tasks.

    The blocks' narrow rows are stored, marked by whether their features are all known, and split in time.
    """
    plan, block, drop_nulls, keys = blocks.plan, blocks.block, blocks.drop_nulls, list(blocks.keys)

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        keep = own_places(table, block)
        return table.append_column("_kept", pa.array(keep & plan.known(base_columns(plan, table)) if drop_nulls else keep))

    marked = materialize(blocks.apply(mark, blocks.rows.withColumn("_kept", F.lit(None).cast("boolean")).schema))
    ready = replace(blocks, rows=in_splits(marked, marked.where("_kept"), keys, blocks.time))
    return BlockTable(wide_rows(ready), tuple(n for n in plan.names if n != plan.target), ready)


def matrix_scores(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """``feature, place, score, r2``: the F score of every feature of a matrix, columns never being spread out.

    Each task adds up its rows' sums of squares and products, relative to one row of the table so that
    large values with small spread keep their digits; one row per task and feature is shuffled.
    """
    found = train.select(FEATURES, TARGET).first()
    if found is None:
        return no_scores(train.sparkSession)
    shift, origin = np.array(found[FEATURES]), found[TARGET]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(shift)))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                total += moment_sums(np.asarray(part.column(0).flatten()).reshape(part.num_rows, -1), np.asarray(part.column(1)), shift, origin)
        yield sums_batch(total)

    return scores_from_sums(train.select(FEATURES, TARGET).mapInArrow(sums, SUMS), names)


def no_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "feature string, place int, score double, r2 double")


def moment_sums(x: np.ndarray, y: np.ndarray, shift: np.ndarray, origin: float) -> np.ndarray:
    """Number, sums, squares and products of each column with the label, relative to one row."""
    x, y = x - shift, (y - origin)[:, None]
    return np.stack([np.full(len(shift), float(len(x))), x.sum(0), (x * x).sum(0), (x * y).sum(0), *(np.full(len(shift), v) for v in (y.sum(), (y * y).sum()))])


def sums_batch(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1], dtype=np.int32)), *map(pa.array, total)], names=["place", *MOMENTS])


def scores_from_sums(tall: DataFrame, names: Sequence[str]) -> DataFrame:
    c = {name: F.sum(name) for name in MOMENTS}
    moment = lambda both, one, other: c[both] - c[one] * c[other] / c["n"]
    stats = tall.groupBy("place").agg(
        c["n"].alias("n"), moment("xx", "x", "x").alias("sx"), moment("yy", "y", "y").alias("sy"), moment("xy", "x", "y").alias("sxy"), c["xx"].alias("xx")
    )
    flat = (F.col("sx") <= 1e-12 * F.col("xx")) | (F.col("sy") <= 0)  # a constant feature has no score
    r2 = F.when(flat, 0.0).otherwise(F.least(F.col("sxy") * F.col("sxy") / F.nullif(F.col("sx") * F.col("sy"), F.lit(0.0)), F.lit(1.0)))
    score = F.when(F.col("r2") >= 1, F.lit(float("inf"))).otherwise(F.col("r2") * (F.col("n") - 2) / (1 - F.col("r2")))
    listed = F.array(*[F.lit(n) for n in names])
    return stats.withColumn("r2", F.coalesce(r2, F.lit(0.0))).select(F.get(listed, F.col("place")).alias("feature"), "place", score.alias("score"), "r2")


def select_from_matrix(table: MatrixTable, k: int = 20) -> list[str]:
    """The ``k`` features with the highest F score on the training rows, in the matrix's order."""
    best = table.train_scores().orderBy(F.round("r2", 9).desc(), "place").limit(k).collect()  # k rows
    return [r.feature for r in sorted(best, key=lambda r: r.place)]


def is_cyclic(name: str) -> bool:
    return "_sin" in name or "_cos" in name


def scale_stats(train: DataFrame, columns: Sequence[str], method: str, keys: Sequence[str] = ()) -> DataFrame:
    """Centre and width per column, fitted on the training rows: one wide row per key."""
    if method == "minmax":
        aggs = [c for n in columns for c in (F.min(n).alias(f"_c_{n}"), (F.max(n) - F.min(n)).alias(f"_w_{n}"))]
        return train.groupBy(*keys).agg(*aggs)
    if method == "robust":
        tall = train.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "_column", "_v")
        q = exact_quantiles(tall, [*keys, "_column"], "_v", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
        at = lambda n, e: F.max(F.when(F.col("_column") == n, e))
        width = F.col("_q3") - F.col("_q1")
        return q.groupBy(*keys).agg(*[c for n in columns for c in (at(n, F.col("_q2")).alias(f"_c_{n}"), at(n, width).alias(f"_w_{n}"))])
    aggs = [c for n in columns for c in (F.avg(n).alias(f"_c_{n}"), F.stddev_pop(n).alias(f"_w_{n}"))]
    return train.groupBy(*keys).agg(*aggs)


def scale(
    df: DataFrame, columns: Sequence[str], method: str = "standard", keys: Sequence[str] = (), split: str = "split", log: bool = True
) -> DataFrame:
    """Scale all splits by statistics of the training rows; cyclical columns stay as they are.

    ``standard`` uses the population deviation, ``robust`` median and interquartile range.  Constant
    columns are only centred.  Skewed positive columns are log-transformed first.
    """
    chosen = [c for c in columns if not is_cyclic(c)]
    rows = log1p_if_skewed(df, chosen, keys, split) if log else df
    stats = scale_stats(rows.where(F.col(split) == "train"), chosen, method, keys)
    out = attach(rows, stats, keys, "left")

    def scaled(c: str) -> Column:
        width = F.when(F.col(f"_w_{c}") == 0, 1.0).otherwise(F.col(f"_w_{c}"))
        return (F.col(c) - F.col(f"_c_{c}")) / width

    return out.withColumns({c: scaled(c) for c in chosen}).drop(*[f"_{t}_{c}" for c in chosen for t in "cw"])


@dataclass(frozen=True)
class Scaler:
    """What ``scale`` learnt from the training rows of all keys together, as numbers: fits any table, streams too."""

    method: str
    centre: dict[str, float]
    width: dict[str, float]
    log: tuple[str, ...] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        def scaled(c: str) -> Column:
            value = F.log1p(c) if c in self.log else F.col(c)
            return (value - self.centre[c]) / (self.width[c] or 1.0)

        return df.withColumns({c: scaled(c) for c in self.centre})

    def rows(self) -> list[tuple[str, float, float, bool]]:
        return [(c, self.centre[c], self.width[c], c in self.log) for c in self.centre]


def fit_scaler(train: DataFrame, columns: Sequence[str], method: str = "standard", log: bool = True) -> Scaler:
    """The numbers that ``scale`` would use; two rows come back."""
    chosen = [c for c in columns if not is_cyclic(c)]
    skewed = train.agg(*[((adjusted_skew(c) > 1.0) & (F.min(c) > 0)).alias(c) for c in chosen]).first() if log and chosen else None
    logged = tuple(c for c in chosen if skewed is not None and skewed[c])
    found = scale_stats(train.withColumns({c: F.log1p(c) for c in logged}), chosen, method).first() if chosen else None
    return Scaler(method, {c: found[f"_c_{c}"] for c in chosen}, {c: found[f"_w_{c}"] for c in chosen}, logged)


def assemble(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    rows = df.withColumn(TARGET, F.col(target).cast("double"))
    return VectorAssembler(inputCols=list(columns), outputCol=FEATURES, handleInvalid="skip").transform(rows)


def rfe(train: DataFrame, columns: Sequence[str], target: str, k: int = 10, step: int = 1, trees: int = 50, depth: int = DEEPEST, seed: int = 42) -> list[str]:
    """Drop the ``step`` weakest features of a forest until ``k`` are left."""
    rows = assemble(train, columns, target).select(vector_to_array(FEATURES).alias("x"), F.col(TARGET).alias("y"))
    return rfe_rows(rows, columns, k, step, trees, depth, seed)


def rfe_matrix(table: MatrixTable, k: int = 10, step: int = 1, trees: int = 50, depth: int = DEEPEST, seed: int = 42) -> list[str]:
    """``rfe`` of all features of a matrix."""
    rows = materialize(table.part("train").select(F.col(FEATURES).alias("x"), F.col(TARGET).alias("y")))
    return rfe_rows(rows, table.names, k, step, trees, depth, seed)


def rfe_rows(rows: DataFrame, names: Sequence[str], k: int, step: int, trees: int, depth: int, seed: int) -> list[str]:
    """``rfe`` of rows with an array ``x`` and a label ``y``; a table that no task can hold takes a whole forest each step."""
    if len(names) <= k:
        return list(names)
    places = eliminate(rows, k, step, trees, depth, seed)
    if places is not None:
        return [names[i] for i in places]
    left = list(range(len(names)))
    while len(left) > k:
        chosen = F.array(*[F.get("x", F.lit(i)) for i in left])
        model = RandomForest(trees, depth, seed).fit(rows.select(array_to_vector(chosen).alias(FEATURES), F.col("y").alias(TARGET)))
        weight = dict(zip(left, model.featureImportances.toArray(), strict=True))
        drop = set(sorted(left, key=lambda i: weight[i])[: min(step, len(left) - k)])
        left = [i for i in left if i not in drop]
    return [names[i] for i in left]


def select_features(train: DataFrame, columns: Sequence[str], target: str, method: str = "univariate", k: int = 10) -> list[str]:
    """Names of the chosen features, in the order given."""
    if method == "rfe":
        return rfe(train, columns, target, k)
    if method != "univariate":
        return list(columns)
    # at most k names come back
    chosen = {row["feature"] for row in top_features(train, target, columns, k).collect()}
    return [c for c in columns if c in chosen]


def _estimator(name: str, train: DataFrame, seed: int, depth: int):
    common = {"featuresCol": FEATURES, "labelCol": TARGET, "predictionCol": PREDICTION}
    if name == "linear":
        return LinearRegression(**common, solver="normal")
    if name == "ridge":
        # MLlib scales the label inside: this makes the penalty that of the plain sum of squares
        n, sd = train.agg(F.count(F.lit(1)), F.stddev_samp(TARGET)).first()
        penalty = 1.0 * (sd or 0.0) / max(n, 1)
        return LinearRegression(
            **common, regParam=penalty, elasticNetParam=0.0, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-10
        )
    if name == "lasso":
        return LinearRegression(
            **common, regParam=1.0, elasticNetParam=1.0, standardization=False, solver="l-bfgs", maxIter=500, tol=1e-10
        )
    if name == "random_forest":
        return RandomForest(100, depth, seed)
    if name == "gradient_boosting":
        return GBTRegressor(**common, maxIter=100, maxDepth=3, stepSize=0.1, seed=seed, checkpointInterval=10)
    raise ValueError(f"unknown model: {name}")


@dataclass
class Trained:
    """A fitted model with its features and importances."""

    name: str
    model: Model
    columns: list[str]
    importance: dict[str, float] = field(default_factory=dict)


def train(
    df: DataFrame, columns: Sequence[str], target: str, models: Sequence[str] = DEFAULT_MODELS, split: str = "split", seed: int = 42, depth: int = DEEPEST
) -> dict[str, Trained]:
    """Fit each model on the training rows, all at the same time: most fits are many small jobs that leave cores idle."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    chosen = df.where(F.col(split) == "train")
    parts = chosen.count() // FIT_ROWS + 1
    rows = assemble(chosen, columns, target).select(FEATURES, TARGET).coalesce(parts).persist()

    def fit(name: str) -> Trained:
        model = _estimator(name, rows, seed, depth).fit(rows)
        weights = model.featureImportances.toArray() if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
        return Trained(name, model, list(columns), dict(zip(columns, map(float, weights), strict=True)))

    names = list(dict.fromkeys(ALIASES.get(m, m) for m in models))
    out = dict(zip(names, at_once(spark, fit, names), strict=True))
    rows.unpersist()
    return out


def at_once(spark: SparkSession, work: Callable, names: Iterable[str]) -> list:
    """``work(name)`` for all names, in threads that share the session; an error of one is raised."""
    names = list(names)
    with ThreadPool(max(len(names), 1)) as pool:
        started = [pool.apply_async(inheritable_thread_target(spark)(partial(work, name))) for name in names]
        return [s.get() for s in started]


def predict(trained: Trained, df: DataFrame, target: str, keep: Sequence[str]) -> DataFrame:
    """Index columns, actual value and prediction."""
    out = trained.model.transform(assemble(df, trained.columns, target))
    return out.select(*keep, F.col(TARGET).alias("actual"), PREDICTION)


def evaluate(trained: Trained, df: DataFrame, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """Regression metrics and residual statistics of one model."""
    rows = predict(trained, df, target, keys)
    found = rows.groupBy(*keys).agg(*metric_columns("actual", PREDICTION), *residual_columns("actual", PREDICTION))
    return found.withColumn("model", F.lit(trained.name))


def evaluate_all(trained: Mapping[str, Trained], df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """One metrics row per model and split."""
    parts = [evaluate(t, df, target, [split]) for t in trained.values()]
    return reduce(DataFrame.unionByName, parts)


def predict_with_band(trained: Trained, df: DataFrame, target: str, keep: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return prediction_band(predict(trained, df, target, keep), "actual", PREDICTION, keys)


def importance_table(spark, trained: Mapping[str, Trained]) -> DataFrame:
    rows = [(t.name, c, w) for t in trained.values() for c, w in t.importance.items()]
    return spark.createDataFrame(rows, "model string, feature string, importance double")


def save_models(trained: Mapping[str, Trained], metrics: DataFrame, target: str, base: str) -> None:
    """Models, importances and metrics below ``base``."""
    spark = metrics.sparkSession
    for t in trained.values():
        t.model.write().overwrite().save(f"{base}/{target}_{t.name}_model")
    importance_table(spark, trained).withColumn("target", F.lit(target)).write.mode("overwrite").parquet(f"{base}/{target}_importance")
    metrics.withColumn("target", F.lit(target)).write.mode("overwrite").parquet(f"{base}/{target}_metrics")


@dataclass
class Scorer:
    """All that it takes to score rows of a feature matrix: which features, how they are scaled, the model."""

    names: tuple[str, ...]
    columns: list[str]
    scaler: Scaler
    model: Model

    def score(self, matrix: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` and the prediction for rows with a ``features`` array in the order of ``names``; may be a stream."""
        rows = matrix.select(*keep, *expanded(self.names, self.columns))
        vectors = VectorAssembler(inputCols=self.columns, outputCol=FEATURES, handleInvalid="skip").transform(self.scaler.apply(rows))
        return self.model.transform(vectors).select(*keep, PREDICTION)

    def save(self, spark: SparkSession, base: str) -> None:
        self.model.write().overwrite().save(f"{base}/model")
        spark.createDataFrame(list(enumerate(self.names)), "place int, feature string").write.mode("overwrite").parquet(f"{base}/names")
        spark.createDataFrame(list(enumerate(self.columns)), "place int, feature string").write.mode("overwrite").parquet(f"{base}/columns")
        kind = "feature string, centre double, width double, log boolean"
        scaler = spark.createDataFrame(self.scaler.rows(), kind).withColumn("method", F.lit(self.scaler.method))
        scaler.write.mode("overwrite").parquet(f"{base}/scaler")

    @staticmethod
    def load(spark: SparkSession, base: str) -> Scorer:
        names, columns = ([r.feature for r in spark.read.parquet(f"{base}/{part}").orderBy("place").collect()] for part in ("names", "columns"))
        kept = spark.read.parquet(f"{base}/scaler").collect()  # one row per chosen feature
        by_name = {r.feature: r for r in kept}
        order = [c for c in columns if c in by_name]
        scaler = Scaler(
            kept[0].method if kept else "none", {c: by_name[c].centre for c in order}, {c: by_name[c].width for c in order},
            tuple(c for c in order if by_name[c].log),
        )
        kind = spark.read.text(f"{base}/model/metadata").select(F.get_json_object("value", "$.class")).first()[0].rsplit(".", 1)[1]
        return Scorer(tuple(names), columns, scaler, MODELS[kind].load(f"{base}/model"))


@dataclass
class TrainingRun:
    trained: dict[str, Trained]
    columns: list[str]
    metrics: DataFrame
    best: str
    predictions: DataFrame
    rows: DataFrame
    scorers: dict[str, Scorer] = field(default_factory=dict)
    table: MatrixTable | None = None


def run_training(
    table: DataFrame, target: str, columns: Sequence[str], models: Sequence[str] = DEFAULT_MODELS, k: int = 20, selection: str | None = "univariate",
    scaling: str = "standard", keys: Sequence[str] = ("dataset_id",), time: str = "time", metric: str = "r2", save_to: str | None = None,
) -> TrainingRun:
    """Split in time, select, scale, train, pick the best on validation, evaluate and predict the test rows."""
    # the engineered table feeds the selection, the scaling statistics and the fits
    rows = materialize(chrono_split(table.select(*keys, time, target, *[c for c in columns if c != target]), keys, time))
    chosen = select_features(rows.where(F.col("split") == "train"), columns, target, selection, k) if selection else list(columns)
    scaled = materialize(
        scale(rows.select(*keys, time, "split", target, *[c for c in chosen if c != target]), chosen, scaling)
    )
    trained = train(scaled, chosen, target, models)
    metrics = materialize(evaluate_all(trained, scaled, target))  # a row per model and split, read by several queries
    # one row comes back
    best = best_model(metrics.where(F.col("split") == "val"), metric).first()["model"]
    if save_to:
        save_models(trained, metrics, target, save_to)
    test = scaled.where(F.col("split") == "test")
    predictions = predict_with_band(trained[best], test, target, [*keys, time], keys)
    return TrainingRun(trained, chosen, metrics, best, predictions, scaled)


def run_matrix_training(
    table: MatrixTable, target: str, models: Sequence[str] = DEFAULT_MODELS, k: int = 20, scaling: str = "standard",
    keys: Sequence[str] = ("dataset_id",), time: str = "time", metric: str = "r2",
) -> TrainingRun:
    """``run_training`` on a matrix: all features compete, the ``k`` chosen ones become columns.

    The scorers of the result take rows of the whole matrix.
    """
    chosen = select_from_matrix(table, k)
    rows = materialize(table.columns(chosen, [*keys, time, "split"], target))
    run = run_training(rows.drop("split"), target, chosen, models, selection=None, scaling=scaling, keys=keys, time=time, metric=metric)
    scaler = fit_scaler(rows.where(F.col("split") == "train"), chosen, scaling)
    run.scorers = {name: Scorer(table.names, chosen, scaler, t.model) for name, t in run.trained.items()}
    run.table = table
    return run
