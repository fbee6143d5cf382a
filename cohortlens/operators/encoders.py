"""Preprocessing as ``pyspark.ml`` estimators: learnt on training rows, reused everywhere.

Outputs go to columns with the prefix ``f__``; raw columns stay, so the scored table still
has its group keys. State that is bounded (medians, levels above 1 %) lives in a JSON
parameter; the target encoding, which grows with its categories, lives in a Parquet table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
    MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import hash32, safe_div
from cohortlens.operators.ordering import exact_quantiles
from cohortlens.session import stage

PREFIX = "f__"
INFREQUENT = "infrequent"
MISSING_LABEL = "__missing__"


def clean_name(name: str) -> str:
    return name.replace(".", "_").replace("`", "_")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "input columns", TypeConverters.toListString)

    def get_columns(self) -> list[str]:
        return self.getOrDefault(self.columns)


class _JsonState(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted stage whose bounded state is one JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted values", lambda v: v)

    def __init__(self, state: dict | None = None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    @property
    def fitted(self) -> dict:
        return self.getOrDefault(self.state)


# --- numeric branch ------------------------------------------------------------------------

class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Median of the training rows, plus a 0/1 indicator for columns that had gaps in them.

    Medians are exact. ``exact=False`` uses a sketch instead: one pass, rank error 1e-4.
    """

    exact = Param(Params._dummy(), "exact", "exact medians", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, exact: bool = True):
        super().__init__()
        self._setDefault(exact=True)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        cols = self.get_columns()
        if not cols:
            return MedianImputerModel({"medians": {}, "indicators": []})
        typed = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
        if self.getOrDefault(self.exact):
            counts: dict[str, int] = {}
            medians = {c: v[0] for c, v in exact_quantiles(typed, cols, [0.5], counts=counts).items()}
            total = counts[""]
        else:
            row = typed.agg(F.count(F.lit(1)).alias("n"), *[x for i, c in enumerate(cols) for x in (
                F.count(c).alias(f"n{i}"), F.percentile_approx(c, 0.5, 10_000).alias(f"m{i}"))]).first()
            medians = {c: row[f"m{i}"] for i, c in enumerate(cols)}
            counts, total = {c: row[f"n{i}"] for i, c in enumerate(cols)}, row["n"]
        return MedianImputerModel({
            "medians": medians, "indicators": [c for c in cols if counts[c] < total]})


class MedianImputerModel(_JsonState):
    def _transform(self, df: DataFrame) -> DataFrame:
        # A column without a single training value has no median and no information: 0.
        filled = {PREFIX + c: F.coalesce(F.col(c).cast("double"), F.lit(0.0 if m is None else m))
                  for c, m in self.fitted["medians"].items()}
        marks = {f"{PREFIX}missingindicator_{c}": F.col(c).isNull().cast("double")
                 for c in self.fitted["indicators"]}
        return df.withColumns({**filled, **marks}) if filled else df


class StandardScale(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Zero mean and unit population variance for every feature column present so far."""

    def _fit(self, df: DataFrame) -> StandardScaleModel:
        cols = feature_columns(df)
        if not cols:
            return StandardScaleModel({"scale": {}})
        row = df.agg(*[x for i, c in enumerate(cols) for x in (
            F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]).first()
        return StandardScaleModel({"scale": {
            c: [row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0] for i, c in enumerate(cols)}})


class StandardScaleModel(_JsonState):
    def _transform(self, df: DataFrame) -> DataFrame:
        scale = self.fitted["scale"]
        return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scale.items()}) if scale else df


# --- low-cardinality branch -----------------------------------------------------------------

def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, level), all columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(
        F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    return df.select(pairs.alias("s")).groupBy(
        F.col("s.c").alias("column"), F.col("s.v").alias("level")).agg(F.count(F.lit(1)).alias("n"))


class ModeImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Most frequent level; ties go to the smallest one."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ModeImputerModel:
        cols = self.get_columns()
        if not cols:
            return ModeImputerModel({"modes": {}})
        counts = level_counts(df, cols).where(F.col("level").isNotNull())
        best = counts.groupBy("column").agg(
            F.min_by("level", F.struct(-F.col("n"), F.col("level"))).alias("mode"))
        modes = {r["column"]: r["mode"] for r in best.collect()}
        return ModeImputerModel({"modes": {c: modes.get(c) for c in cols}})


class ModeImputerModel(_JsonState):
    def _transform(self, df: DataFrame) -> DataFrame:
        modes = self.fitted["modes"]
        return df.withColumns({f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(m))
                               for c, m in modes.items()}) if modes else df


class ConstantImputer(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A constant label in place of missing values."""

    label = Param(Params._dummy(), "label", "label for missing values", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, label: str = MISSING_LABEL):
        super().__init__()
        self._setDefault(label=MISSING_LABEL)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, label = self.get_columns(), self.getOrDefault(self.label)
        return df.withColumns({f"_c_{c}": F.coalesce(F.col(c).cast("string"), F.lit(label))
                               for c in cols}) if cols else df


class InfrequentOneHot(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """0/1 columns for the levels with at least ``min_freq`` of the rows.

    Rarer levels share one bucket, which also takes unknown levels; without rare levels in
    training there is no bucket and an unknown level is all zeros. At most 1 / min_freq
    levels are kept, which bounds the state.
    """

    min_freq = Param(Params._dummy(), "min_freq", "smallest share", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, min_freq: float = 0.01):
        super().__init__()
        self._setDefault(min_freq=0.01)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> InfrequentOneHotModel:
        cols = self.get_columns()
        if not cols:
            return InfrequentOneHotModel({"kept": {}, "bucket": {}})
        inputs = [f"_c_{c}" if f"_c_{c}" in df.columns else c for c in cols]
        counts = level_counts(df, inputs)
        floor = (counts.groupBy("column").agg(F.sum("n").alias("total"))
                 .withColumn("floor", F.col("total") * self.getOrDefault(self.min_freq)))
        frequent = F.col("n") >= F.col("floor")
        # One row per column with at most 1 / min_freq levels reaches the driver.
        found = {r["column"]: r for r in (
            counts.where(F.col("level").isNotNull()).join(F.broadcast(floor), "column").groupBy("column")
            .agg(F.array_sort(F.collect_list(F.when(frequent, F.col("level")))).alias("kept"),
                 F.max((~frequent).cast("int")).alias("rare"))).collect()}
        return InfrequentOneHotModel({
            "kept": {c: [i, list(found[i]["kept"]) if i in found else []] for c, i in zip(cols, inputs)},
            "bucket": {c: bool(i in found and found[i]["rare"]) for c, i in zip(cols, inputs)}})


class InfrequentOneHotModel(_JsonState):
    def _transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, (source, levels) in self.fitted["kept"].items():
            for level in levels:
                new[f"{PREFIX}{c}_{clean_name(level)}"] = F.coalesce(
                    (F.col(source) == level).cast("double"), F.lit(0.0))
            if self.fitted["bucket"][c]:
                known = F.coalesce(F.col(source).isin(levels), F.lit(False))
                new[f"{PREFIX}{c}_{INFREQUENT}"] = (~known).cast("double")
        return df.withColumns(new) if new else df


# --- high-cardinality branch ----------------------------------------------------------------

FULL = -1


def encode_expression(n, pos, total_n, total_pos):
    """Empirical-Bayes mean of a category from its counts and the totals around it."""
    mean, overall = safe_div(pos, n), safe_div(total_pos, total_n)
    within, around = mean * (1 - mean), overall * (1 - overall)
    weight = safe_div(around * n, around * n + within)
    return F.when((around == 0) | mean.isNull(), overall).otherwise(
        F.coalesce(weight * mean + (1 - weight) * overall, overall))


def crossfit_table(df: DataFrame, columns: dict[str, str], target: str, fold, folds: int) -> DataFrame:
    """Encoding per (column, level, fold): fold -1 uses all rows, fold f all rows but its own.

    One pass gives each level its rows and positives per fold; everything out of fold is the
    sum over folds minus the own one. The totals have one row per encoded column, which the
    schema bounds. Rows with NULL level carry the global mean.
    """
    pairs = F.explode(F.array(*[F.struct(
        F.lit(name).alias("c"), F.col(source).cast("string").alias("v"))
        for name, source in columns.items()]))
    each = range(folds)
    known = df.where(F.col(target).isNotNull())
    levels = (known.select(pairs.alias("s"), fold.alias("f"), F.col(target).cast("int").alias("_y"))
              .where(F.col("s.v").isNotNull())
              .groupBy(F.col("s.c").alias("column"), F.col("s.v").alias("level"))
              .agg(*[F.count_if(F.col("f") == k).alias(f"n{k}") for k in each],
                   *[F.sum(F.when(F.col("f") == k, F.col("_y")).otherwise(0)).alias(f"p{k}") for k in each]))
    totals = levels.groupBy("column").agg(*[
        F.sum(f"{c}{k}").alias(f"t{c}{k}") for c in ("n", "p") for k in each])

    def without(prefix: str, k: int):
        return sum((F.col(f"{prefix}{j}") for j in each if j != k), F.lit(0))

    def per_fold(*prefixes):
        """One row per fold with what lies outside of it; formulas on these rows are written, and compiled, once."""
        return F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("fold"), *[without(p, k).alias(p) for p in prefixes])
                                   for k in [FULL, *each]])).alias("e")

    encoded = levels.join(F.broadcast(totals), "column").select("column", "level", per_fold("n", "p", "tn", "tp")).select(
        "column", "level", "e.fold", encode_expression(*[F.col(f"e.{p}") for p in ("n", "p", "tn", "tp")]).alias("encoding"))
    overall = totals.select("column", F.lit(None).cast("string").alias("level"), per_fold("tn", "tp")).select(
        "column", "level", "e.fold", safe_div("e.tp", "e.tn").alias("encoding"))
    return encoded.unionByName(overall)


class CrossFitTargetEncoder(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Target encoding in which a training row never sees its own fold.

    New rows get the encoding from all training rows; unseen levels get the global mean.
    Folds come from a hash of the row key.
    """

    target = Param(Params._dummy(), "target", "binary target", TypeConverters.toString)
    row_key = Param(Params._dummy(), "row_key", "unique row key", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "fold seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, target: str = "y",
                 row_key: str = "row_id", folds: int = 5, seed: int = 42):
        super().__init__()
        self._setDefault(target="y", row_key="row_id", folds=5, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def fold_expr(self):
        return F.pmod(hash32(self.getOrDefault(self.seed), self.getOrDefault(self.row_key)),
                      F.lit(self.getOrDefault(self.folds))).cast("int")

    def _fit(self, df: DataFrame) -> CrossFitTargetEncoderModel:
        cols = self.get_columns()
        source = {c: f"_c_{c}" if f"_c_{c}" in df.columns else c for c in cols}
        model = CrossFitTargetEncoderModel()
        model._set(columns=cols, row_key=self.getOrDefault(self.row_key),
                   folds=self.getOrDefault(self.folds), seed=self.getOrDefault(self.seed))
        model.table = stage(crossfit_table(df, source, self.getOrDefault(self.target),
                                           self.fold_expr(), self.getOrDefault(self.folds)),
                            "target-encoding") if cols else None
        return model


class CrossFitTargetEncoderModel(Model, _Columns, MLReadable, MLWritable):
    row_key = Param(Params._dummy(), "row_key", "unique row key", TypeConverters.toString)
    folds = Param(Params._dummy(), "folds", "number of folds", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "fold seed", TypeConverters.toInt)

    def __init__(self):
        super().__init__()
        self.table: DataFrame | None = None

    def _apply(self, df: DataFrame, fold) -> DataFrame:
        cols = self.get_columns()
        if not cols:
            return df
        out = df.withColumn("_fold", fold)
        means = {(r["column"], r["fold"]): r["encoding"] for r in
                 self.table.where(F.col("level").isNull()).collect()}  # one row per column and fold
        for c in cols:
            source = f"_c_{c}" if f"_c_{c}" in df.columns else c
            lookup = (self.table.where((F.col("column") == c) & F.col("level").isNotNull())
                      .select(F.col("level").alias("_l"), F.col("fold").alias("_f"),
                              F.col("encoding").alias("_e")))
            default = F.create_map(*[F.lit(x) for (col, f), m in sorted(means.items()) if col == c
                                     for x in (int(f), float(m))])
            out = (out.join(lookup, (F.col(source) == F.col("_l")) & (F.col("_fold") == F.col("_f")), "left")
                   .withColumn(PREFIX + c, F.coalesce("_e", default[F.col("_fold")], default[F.lit(FULL)]))
                   .drop("_l", "_f", "_e"))
        return out.drop("_fold")

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._apply(df, F.lit(FULL))

    def transform_training(self, df: DataFrame) -> DataFrame:
        """Encoding for the very rows the model was fitted on: each row out of its own fold."""
        fold = F.pmod(hash32(self.getOrDefault(self.seed), self.getOrDefault(self.row_key)),
                      F.lit(self.getOrDefault(self.folds))).cast("int")
        return self._apply(df, fold)

    def copy(self, extra=None):
        that = super().copy(extra)
        that.table = self.table
        return that

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)


class _EncoderWriter(MLWriter):
    def __init__(self, instance: CrossFitTargetEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        if self.instance.table is not None:
            self.instance.table.write.parquet(f"{path}/table")


class _EncoderReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> CrossFitTargetEncoderModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        if model.get_columns():
            model.table = spark.read.parquet(f"{path}/table")
        return model


# --- assembly ---------------------------------------------------------------------------------

class AssembleFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Collect the feature columns into one vector; their names stay in its metadata."""

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = feature_columns(df)
        scratch = [c for c in df.columns if c.startswith("_c_")]
        return (VectorAssembler(inputCols=cols, outputCol="features").transform(df)
                .drop(*cols, *scratch))


def feature_names(df: DataFrame) -> list[str]:
    """Names behind the feature vector, in order."""
    attrs = df.schema["features"].metadata["ml_attr"]["attrs"]
    flat = sorted((a["idx"], a["name"]) for group in attrs.values() for a in group)
    return [name.removeprefix(PREFIX) for _, name in flat]


class LeakSafePipeline(Pipeline):
    """A pipeline that, while fitting, passes training rows on in their out-of-fold encoding.

    A plain ``Pipeline`` would transform the training rows with statistics that contain
    their own label.
    """

    def _fit(self, df: DataFrame) -> PipelineModel:
        fitted, current = [], df
        stages = self.getStages()
        for i, s in enumerate(stages):
            model = s.fit(current) if isinstance(s, Estimator) else s
            fitted.append(model)
            if i < len(stages) - 1:
                current = (model.transform_training(current) if hasattr(model, "transform_training")
                           else model.transform(current))
        return PipelineModel(fitted)


def build_preprocessor(df: DataFrame, features: Sequence[str], target: str = "y",
                       row_key: str = "row_id", scale: bool = False, seed: int = 42,
                       exact_medians: bool = True, kinds: dict | None = None) -> list:
    """Stages of the three branches, chosen by column class; other columns are left out."""
    from cohortlens.operators.roles import classify_columns

    kinds = kinds or classify_columns(df, features)
    stages: list = []
    if kinds["numeric"]:
        stages.append(MedianImputer(columns=kinds["numeric"], exact=exact_medians))
        if scale:
            stages.append(StandardScale())
    if kinds["low"]:
        stages += [ModeImputer(columns=kinds["low"]), InfrequentOneHot(columns=kinds["low"])]
    if kinds["high"]:
        stages += [ConstantImputer(columns=kinds["high"]),
                   CrossFitTargetEncoder(columns=kinds["high"], target=target, row_key=row_key,
                                         seed=seed)]
    return [*stages, AssembleFeatures()]


def build_model(df: DataFrame, features: Sequence[str], estimator: Estimator, target: str = "y",
                row_key: str = "row_id", scale: bool = False, seed: int = 42,
                exact_medians: bool = True, kinds: dict | None = None) -> LeakSafePipeline:
    """Preprocessing and estimator as one object to fit, validate, store and apply."""
    stages = build_preprocessor(df, features, target, row_key, scale, seed, exact_medians, kinds)
    return LeakSafePipeline(stages=[*stages, estimator])
