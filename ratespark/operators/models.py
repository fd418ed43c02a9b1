"""Claim-frequency and claim-severity models as Spark ML pipelines."""

from __future__ import annotations

import importlib
import json
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer,
    ImputerModel,
    OneHotEncoder,
    OneHotEncoderModel,
    StandardScaler,
    StandardScalerModel,
    StringIndexer,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.regression import (
    GBTRegressor,
    GeneralizedLinearRegression,
    GeneralizedLinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    EXPOSURE,
    EXPOSURE_FLOOR,
    MODEL_CATEGORICAL,
    MODEL_NUMERIC,
    PREDICTION_FLOOR,
    RANDOM_SEED,
    ModelConfig,
    RoleConfig,
)
from ..functions.cleaning import clip
from .boosting import BoostedTrees, fit_boosted
from .glm import as_model, fit_log_link
from .metrics import frequency_metrics, severity_metrics
from .stats import numeric_medians

FREQUENCY_MODELS = ("poisson", "random_forest", "xgboost", "boosted", "gbt")
SEVERITY_MODELS = ("gamma", "random_forest", "xgboost", "boosted", "gbt")
GLM_TOLERANCE = 1e-10
_TARGET, _WEIGHT, _FEATURES, _ROWS = "__target", "__weight", "__features", "__rows"


def preprocessing_stages(
    training: DataFrame, numeric: list[str] = MODEL_NUMERIC, categorical: list[str] = MODEL_CATEGORICAL,
    drop_reference: bool = False, count: str | None = None,
) -> list:
    """Median impute + standardise numbers, one-hot categories; unknown categories are all zero.

    Indexers keep a spare slot for unseen values and the encoder drops just that slot, so every
    known level has its own column. ``drop_reference`` drops the last known level instead, which
    an unpenalised model needs. ``count`` names how many rows a training row stands for.
    """
    stages: list = []
    blocks: list[str] = []
    if numeric:
        filled = [f"__num_{c}" for c in numeric]
        imputer = _median_imputer(training, numeric, filled, count)
        assembler = VectorAssembler(inputCols=filled, outputCol="__numbers")
        stages += [imputer, assembler, _scaler(assembler, imputer.transform(training), filled, count)]
        blocks.append("__scaled")
    if categorical:
        indexed = [f"__idx_{c}" for c in categorical]
        encoded = [f"__hot_{c}" for c in categorical]
        unseen = "error" if drop_reference else "keep"
        stages += [
            StringIndexer(
                inputCols=categorical, outputCols=indexed, handleInvalid=unseen, stringOrderType="alphabetAsc"
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
        ]
        blocks += encoded
    return [*stages, VectorAssembler(inputCols=blocks, outputCol=_FEATURES)]


def _scaler(assembler: VectorAssembler, filled: DataFrame, columns: list[str], count: str | None) -> StandardScalerModel:
    """A scaler with means and sample deviations from one aggregate: it is fitted on two rows that have both."""
    copies = (F.col(count) if count else F.lit(1)).cast("double")
    n = F.sum(copies).alias("n")
    means = filled.agg(n, *[(F.sum(copies * F.col(c)) / F.sum(copies)).alias(c) for c in columns]).first()
    squares = filled.agg(*[F.sum(copies * (F.col(c) - F.lit(means[c])) * (F.col(c) - F.lit(means[c]))).alias(c) for c in columns]).first()
    half = [(max(squares[c], 0.0) / max(means.n - 1, 1) / 2) ** 0.5 for c in columns]
    rows = [tuple(means[c] + sign * h for c, h in zip(columns, half)) for sign in (-1, 1)]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    two = assembler.transform(filled.sparkSession.createDataFrame(rows, schema))
    return StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True, withStd=True).fit(two)


def _median_imputer(training: DataFrame, columns: list[str], outputs: list[str], count: str | None) -> ImputerModel:
    """An imputer with the exact medians: it is fitted on the one row that holds them."""
    found = {r.feature: r.value for r in numeric_medians(training, columns, count=count).collect()}  # one row per column
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    row = training.sparkSession.createDataFrame([tuple(float(found.get(c, 0.0)) for c in columns)], schema)
    return Imputer(inputCols=columns, outputCols=outputs, strategy="median").fit(row)


@dataclass(frozen=True)
class Role:
    """What differs between the two model roles."""

    name: str
    output: str
    glm: str
    allowed: tuple[str, ...]


FREQUENCY = Role("frequency", "predicted_annual_frequency", "poisson", FREQUENCY_MODELS)
SEVERITY = Role("severity", "predicted_claim_severity", "gamma", SEVERITY_MODELS)


def model_name(role: Role, requested: str | None, config: ModelConfig) -> str:
    configured = config.frequency_model if role is FREQUENCY else config.severity_model
    name = str(requested if requested is not None else configured).strip().lower()
    if name not in role.allowed:
        raise ValueError(
            f"Unsupported {role.name}_model '{name}': choose one of {', '.join(role.allowed)}."
        )
    return name


class FittedModel:
    """A fitted pipeline of one role; ``transform`` adds the role's floored prediction.

    A generalised linear model is scored by a plain column expression, which stays inside
    whole-stage code generation; every other model goes through its pipeline.
    """

    def __init__(self, role: Role, name: str, pipeline: PipelineModel):
        self.role, self.name, self.pipeline = role, name, pipeline

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        name = output or self.role.output
        kept = [F.col(f"`{c}`") for c in df.columns if c != name]
        formula = glm_formula(self.pipeline)
        if formula is not None:
            return df.select(*kept, clip(formula, PREDICTION_FLOOR).alias(name))
        floored = clip(F.col("prediction"), PREDICTION_FLOOR).alias(name)
        return self.pipeline.transform(df).select(*kept, floored)

    def evaluate(self, df: DataFrame, basis: str = "count") -> DataFrame:
        scored = self.transform(df)
        return frequency_metrics(scored, basis=basis) if self.role is FREQUENCY else severity_metrics(scored)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)


class BoostedModel(FittedModel):
    """Boosted trees of one role, scored by a column expression like a generalised linear model."""

    def __init__(self, role: Role, trees: BoostedTrees):
        super().__init__(role, "boosted", PipelineModel([]))
        self.trees = trees

    def transform(self, df: DataFrame, output: str | None = None) -> DataFrame:
        name = output or self.role.output
        kept = [F.col(f"`{c}`") for c in df.columns if c != name]
        return df.select(*kept, clip(self.trees.mean(), PREDICTION_FLOOR).alias(name))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        spark.createDataFrame([(json.dumps(self.trees.to_dict()),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, role: Role, path: str) -> "BoostedModel":
        return cls(role, BoostedTrees.from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0])))


def load_model(spark: SparkSession, role: Role, name: str, path: str) -> FittedModel:
    """A model written by ``save``."""
    if name == "boosted":
        return BoostedModel.load(spark, role, path)
    return FittedModel(role, name, PipelineModel.load(path))


def scaled_numbers(encoder: list) -> list[Column | None]:
    """The numbers as the encoder's stages fill and scale them, as expressions; None for a number that does not vary."""
    by_kind = {type(stage): stage for stage in encoder}
    if ImputerModel not in by_kind:
        return []
    imputer, scaler = by_kind[ImputerModel], by_kind[StandardScalerModel]
    stand_ins = imputer.surrogateDF.first().asDict()
    out: list[Column | None] = []
    for name, mean, deviation in zip(imputer.getInputCols(), scaler.mean.toArray(), scaler.std.toArray()):
        value = F.coalesce(F.nanvl(F.col(name), F.lit(None)), F.lit(stand_ins[name]))
        out.append((value - F.lit(float(mean))) / F.lit(float(deviation)) if deviation > 0 else None)
    return out


def glm_formula(pipeline: PipelineModel) -> Column | None:
    """exp(intercept + sum of effects) of a fitted log-link model, or None for other models."""
    *encoder, fitted = pipeline.stages
    if not isinstance(fitted, GeneralizedLinearRegressionModel):
        return None
    weights = iter(fitted.coefficients.toArray())
    by_kind = {type(stage): stage for stage in encoder}
    terms: list[Column] = []
    for scaled in scaled_numbers(encoder):
        weight = float(next(weights))
        if scaled is not None:
            terms.append(scaled * F.lit(weight))
    if StringIndexerModel in by_kind:
        indexer = by_kind[StringIndexerModel]
        strict = indexer.getHandleInvalid() != "keep"  # then the last level is the reference, and no other may appear
        for name, levels in zip(indexer.getInputCols(), indexer.labelsArray):
            effects = [0.0 if strict and level == levels[-1] else float(next(weights)) for level in levels]
            pairs = [F.lit(part) for pair in zip(levels, effects) for part in pair]
            unseen = F.raise_error(F.lit(f"A level of {name} was not seen in training.")).cast("double") if strict else F.lit(0.0)
            terms.append(F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(name)), unseen))
    total = F.lit(float(fitted.intercept))
    for term in terms:
        total = total + term
    return F.exp(total)


def frequency_training_frame(df: DataFrame) -> DataFrame:
    """Target claims per year, weight exposure."""
    exposure = clip(F.col(EXPOSURE), EXPOSURE_FLOOR)
    return df.withColumns({_WEIGHT: exposure, _TARGET: F.col("ClaimNb") / exposure})


def severity_training_frame(df: DataFrame) -> DataFrame:
    positive = df.where(F.col("ClaimAmount") > 0)
    return positive.withColumns({_WEIGHT: F.lit(1.0), _TARGET: F.col("ClaimAmount")})


def fold_equal_rows(training: DataFrame, factors: list[str]) -> DataFrame:
    """Rows with equal factors as one: summed weight, weighted mean target and number of rows.

    With a log link, the score equations of Poisson and Gamma models depend on such rows only through these, so coefficients
    stay as they are while every iteration reads one row per cell.
    """
    return training.groupBy(*factors).agg(
        (F.sum(F.col(_WEIGHT) * F.col(_TARGET)) / F.sum(_WEIGHT)).alias(_TARGET), F.sum(_WEIGHT).alias(_WEIGHT),
        F.count(F.lit(1)).alias(_ROWS),
    )


def train_model(
    df: DataFrame,
    role: Role,
    name: str | None = None,
    config: ModelConfig | None = None,
    alpha: float | None = None,
    max_iter: int | None = None,
    numeric: list[str] = MODEL_NUMERIC,
    categorical: list[str] = MODEL_CATEGORICAL,
    drop_reference: bool = False,
) -> FittedModel:
    """Fit one model. Explicit arguments win over ``config``."""
    settings = config or ModelConfig()
    chosen = model_name(role, name, settings)
    role_settings = settings.frequency if role is FREQUENCY else settings.severity
    training = frequency_training_frame(df) if role is FREQUENCY else severity_training_frame(df)
    # A generalised linear model is fitted on cells of equal rows. All others see rows placed by content over a configured
    # number of partitions: forests draw their bags by partition, so the fitted model is the same on any cluster.
    columns = [*numeric, *categorical, _TARGET, _WEIGHT]
    if chosen == role.glm:
        training_cache = fold_equal_rows(training, [*numeric, *categorical]).persist()
    else:
        training_cache = training.select(*columns).repartition(settings.fit_partitions, *columns).persist()
    counted = _ROWS if chosen == role.glm else None
    try:
        if training_cache.count() == 0:  # also fills the cache, which every later pass reads
            raise ValueError(f"{role.name.title()} training data is empty after filtering.")
        if chosen == "boosted":
            medians = {r.feature: r.value for r in numeric_medians(training_cache, numeric).collect()} if numeric else {}
            trees = fit_boosted(training_cache, role.glm, role_settings.boost, _TARGET, _WEIGHT, numeric, categorical, medians)
            return BoostedModel(role, trees)
        regressor = _regressor(training_cache, role, chosen, role_settings, alpha, max_iter)
        stages = preprocessing_stages(training_cache, numeric, categorical, drop_reference, counted)
        encoder = Pipeline(stages=stages).fit(training_cache)
        if chosen == role.glm:
            penalty = role_settings.alpha if alpha is None else alpha
            return FittedModel(role, chosen, PipelineModel([*encoder.stages, _fit_glm(encoder, training_cache, regressor, numeric, categorical, penalty)]))
        # The regressor reads its input once per iteration: keep the encoded rows, not the recipe.
        encoded = encoder.transform(training_cache).select(_FEATURES, _TARGET, _WEIGHT).persist()
        try:
            fitted = regressor.fit(encoded)
        finally:
            encoded.unpersist()
    finally:
        training_cache.unpersist()
    return FittedModel(role, chosen, PipelineModel([*encoder.stages, fitted]))


def train_frequency_model(df: DataFrame, name: str | None = None, **options: Any) -> FittedModel:
    return train_model(df, FREQUENCY, name, **options)


def train_severity_model(df: DataFrame, name: str | None = None, **options: Any) -> FittedModel:
    return train_model(df, SEVERITY, name, **options)


def _fit_glm(
    encoder: PipelineModel, training: DataFrame, settings: GeneralizedLinearRegression, numeric: list[str], categorical: list[str], penalty: float
) -> GeneralizedLinearRegressionModel:
    """Newton's method on scaled numbers and level numbers: a row is a few values, not its encoded vector."""
    numbers, levels = [f"__x{i}" for i in range(len(numeric))], [f"__idx_{c}" for c in categorical]
    scaled = [(F.lit(0.0) if x is None else x).alias(name) for x, name in zip(scaled_numbers(encoder.stages), numbers)]
    rows = encoder.transform(training).select(*scaled, *levels, _TARGET, _WEIGHT)
    widths = [size - 1 for stage in encoder.stages if isinstance(stage, OneHotEncoderModel) for size in stage.categorySizes]
    beta = fit_log_link(rows, settings.getFamily(), _TARGET, _WEIGHT, numbers, levels, widths, penalty, settings.getMaxIter(), GLM_TOLERANCE)
    return as_model(training.sparkSession, beta, settings)


def _regressor(
    training: DataFrame, role: Role, name: str, settings: RoleConfig, alpha: float | None, max_iter: int | None
):
    shared = {"featuresCol": _FEATURES, "labelCol": _TARGET, "weightCol": _WEIGHT}
    if name == role.glm:
        if role is FREQUENCY and (settings.alpha if alpha is None else alpha) and not training.agg(F.sum(F.col(_TARGET) * F.col(_WEIGHT))).first()[0]:
            raise ValueError("Frequency training data has no claims.")
        return GeneralizedLinearRegression(
            family=role.glm, link="log", maxIter=settings.max_iter if max_iter is None else max_iter, tol=GLM_TOLERANCE, **shared,
        )
    if name == "random_forest":
        forest = settings.forest
        return RandomForestRegressor(
            numTrees=forest.trees, maxDepth=forest.max_depth, minInstancesPerNode=forest.min_leaf,
            seed=RANDOM_SEED, cacheNodeIds=True, bootstrap=forest.bootstrap, **shared,
        )
    if name == "gbt":
        boost = settings.boost
        return GBTRegressor(
            maxIter=boost.trees, maxDepth=boost.max_depth, stepSize=boost.learning_rate,
            subsamplingRate=boost.subsample, seed=RANDOM_SEED, **shared,
        )
    return _xgboost_regressor(settings)


def _glm_penalty(training: DataFrame, role: Role, alpha: float) -> float:
    """The ridge weight that gives the solution of mean half-deviance + alpha/2 |w|^2.

    The fit weighs the penalty against the sum of *working* weights: with a log link these are
    the case weights for Gamma and weight x mean for Poisson, hence the weighted mean target.
    """
    if role is SEVERITY or alpha == 0.0:
        return alpha
    weighted_mean = training.agg(F.sum(F.col(_TARGET) * F.col(_WEIGHT)) / F.sum(_WEIGHT)).first()[0]
    if not weighted_mean:
        raise ValueError("Frequency training data has no claims.")
    return alpha / weighted_mean


def xgboost_available() -> bool:
    try:
        importlib.import_module("xgboost.spark")
    except ImportError:
        return False
    return True


def _xgboost_regressor(settings: RoleConfig):
    try:
        library = importlib.import_module("xgboost.spark")
    except ImportError as missing:
        raise ImportError("Model 'xgboost' needs the package 'xgboost', which is not installed.") from missing
    boost = settings.boost
    return library.SparkXGBRegressor(
        features_col=_FEATURES, label_col=_TARGET, weight_col=_WEIGHT, objective=boost.objective,
        n_estimators=boost.trees, learning_rate=boost.learning_rate, max_depth=boost.max_depth,
        subsample=boost.subsample, colsample_bytree=boost.colsample_bytree, reg_lambda=boost.reg_lambda,
        random_state=RANDOM_SEED,
    )


def predict_claim_count(scored: DataFrame, alias: str = "predicted_claim_count") -> DataFrame:
    return scored.withColumn(alias, F.col(FREQUENCY.output) * F.col(EXPOSURE))


_IMPORTANCE_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())
])


def feature_names(model: FittedModel) -> list[str]:
    """Names of the encoded vector: numeric columns, then column=level per category."""
    names: list[str] = []
    for stage in model.pipeline.stages:
        if isinstance(stage, ImputerModel):
            names += list(stage.getInputCols())
        elif isinstance(stage, StringIndexerModel):
            names += [f"{c}={level}" for c, levels in zip(stage.getInputCols(), stage.labelsArray) for level in levels]
    return names


def feature_importance(model: FittedModel, spark: SparkSession, top_n: int | None = None) -> DataFrame | None:
    """(feature, importance), largest first; None for a model without importances."""
    if isinstance(model, BoostedModel):
        rows = list(model.trees.importances().items())  # at most one per split
        frame = spark.createDataFrame(rows, _IMPORTANCE_SCHEMA).orderBy(F.desc("importance"), "feature")
        return frame if top_n is None else frame.limit(top_n)
    values = getattr(model.pipeline.stages[-1], "featureImportances", None)
    if values is None:
        return None
    names = feature_names(model)
    if len(names) != values.size:
        raise ValueError("Feature importances do not align with the encoded feature names.")
    # One row per encoded feature: bounded by the number of category levels.
    rows = [(name, float(value)) for name, value in zip(names, values.toArray())]
    frame = spark.createDataFrame(rows, _IMPORTANCE_SCHEMA).orderBy(F.desc("importance"), "feature")
    return frame if top_n is None else frame.limit(top_n)


def glm_relativities(model: FittedModel, spark: SparkSession) -> DataFrame | None:
    """(feature, coefficient, relativity): multiplicative effects of a log-link model."""
    fitted = model.pipeline.stages[-1] if model.pipeline.stages else None
    if not hasattr(fitted, "coefficients"):
        return None
    names, values = feature_names(model), fitted.coefficients.toArray()
    if len(names) != len(values):
        raise ValueError("Coefficients do not align with the encoded feature names.")
    rows = [("(Intercept)", float(fitted.intercept)), *zip(names, map(float, values))]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("coefficient", T.DoubleType())])
    return spark.createDataFrame(rows, schema).withColumn("relativity", F.exp("coefficient"))

