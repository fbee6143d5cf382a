"""Candidate models, training, scoring and hyper-parameter search with ``pyspark.ml``."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions import hash32
from cohortlens.operators.boosting import HistBooster, HistBoosterModel, Settings, bin_rows, boost
from cohortlens.operators.encoders import INFREQUENT, InfrequentOneHotModel, build_preprocessor, clean_name, feature_names
from cohortlens.operators.metrics import metric_panel, roc_auc
from cohortlens.operators.splits import grouped_stratified_folds
from cohortlens.session import shared_dir, stage


class PriorBaseline(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Predicts the base rate of the training rows for everybody."""

    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, labelCol: str = "y"):
        super().__init__()
        self._setDefault(labelCol="y")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PriorBaselineModel:
        y = F.col(self.getOrDefault(self.labelCol)).cast("double")
        return PriorBaselineModel(df.agg(F.avg(y)).first()[0])


class PriorBaselineModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    prior = Param(Params._dummy(), "prior", "base rate", TypeConverters.toFloat)

    def __init__(self, prior: float | None = None):
        super().__init__()
        if prior is not None:
            self._set(prior=prior)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.getOrDefault(self.prior)
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0 - p), F.lit(p))))


@dataclass(frozen=True)
class Candidate:
    """How to make an estimator for ``n`` training rows, and whether it needs scaled inputs."""

    make: Callable[..., Estimator]
    needs_scaling: bool
    description: str
    validation: float = 0.0


def _baseline(n: int, **kw) -> Estimator:
    return PriorBaseline(labelCol="y")


def _logistic(n: int, C: float = 1.0, **kw) -> Estimator:
    # The summed loss with penalty 1/(2C) equals the mean loss with penalty 1/(2Cn).
    args = dict(maxIter=300, tol=1e-3, regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                standardization=False, featuresCol="features", labelCol="y")
    return LogisticRegression(**{**args, **kw})


def _boosted(settings: Settings) -> Callable[..., Estimator]:
    def make(n: int, row_key: str = "row_id", held: str = "", **kw) -> Estimator:
        return HistBooster(settings=replace(settings, **kw), keyCol=row_key, heldCol=held)
    return make


# Settings of the candidate models.
CANDIDATES: dict[str, Candidate] = {
    "baseline": Candidate(_baseline, False, "Base rate for everybody; the floor of the comparison."),
    "logistic": Candidate(_logistic, True, "Linear and readable; shows what complexity is worth."),
    "hist_boost": Candidate(
        _boosted(Settings(rounds=400, rate=0.06, leaves=63, least_rows=200, l2=1.0, patience=30)),
        False, "Leaf-wise boosting that stops when held-out rows gain nothing for 30 rounds.", validation=0.1),
    "leaf_boost": Candidate(
        _boosted(Settings(rounds=800, rate=0.05, leaves=63, least_rows=200, l2=1.0, row_share=0.8, column_share=0.8)),
        False, "Leaf-wise, with row and column subsampling and large leaves."),
    "depth_boost": Candidate(
        _boosted(Settings(rounds=800, rate=0.05, leaves=0, depth=7, least_rows=1, least_hessian=50.0, l2=1.0, row_share=0.8, column_share=0.8)),
        False, "Level-wise to a fixed depth, leaves limited by their hessian."),
}


def candidate(name: str) -> Candidate:
    if name not in CANDIDATES:
        raise KeyError(f"unknown candidate: {name}; available: {', '.join(sorted(CANDIDATES))}")
    return CANDIDATES[name]


def labelled(df: DataFrame, target: str) -> DataFrame:
    """Rows with a known label, as an integer column ``y``."""
    return df.where(F.col(target).isNotNull()).withColumn("y", F.col(target).cast("int"))


#: Fits that run at the same time; each is a chain of Spark jobs of its own.
PARALLEL_FITS = 4


@dataclass
class Prepared:
    """Training and other rows as feature vectors, written once for each scaling variant.

    Training rows carry their out-of-fold encoding; estimators and masks share the written tables.
    """

    pipeline: PipelineModel
    train: DataFrame  # row key, y, features
    other: DataFrame | None  # the same and the columns kept
    names: list[str]
    n: int
    row_key: str
    seconds: float

    def fit(self, name: str, params: Mapping | None = None, seed: int = 42) -> PipelineModel:
        """A candidate on the written vectors, behind the shared preprocessing."""
        model = fit_vectors(name, self.train, self.n, self.row_key, params, seed)
        return PipelineModel([*self.pipeline.stages, model])

    def slots(self, drop: Sequence[str]) -> list[int]:
        """Positions of the vector that come from other raw columns than those dropped."""
        gone = {k for places in slots_by_source(self.pipeline, self.names, drop).values() for k in places}
        return [k for k in range(len(self.names)) if k not in gone]


def slots_by_source(prep: PipelineModel, names: Sequence[str], columns: Sequence[str]) -> dict[str, list[int]]:
    """Positions of the vector that stem from each raw column: 0/1 columns of its levels, or those named after it."""
    hot = {f"{c}_{clean_name(level)}": c for s in prep.stages if isinstance(s, InfrequentOneHotModel)
           for c, (_, levels) in s.fitted["kept"].items() for level in [*levels, INFREQUENT]}
    out: dict[str, list[int]] = {c: [] for c in columns}
    for k, name in enumerate(names):
        source = hot.get(name, name.removeprefix("missingindicator_"))
        if source in out:
            out[source].append(k)
    return out


def prepare_vectors(train: DataFrame, other: DataFrame | None, features: Sequence[str], scale: bool, row_key: str = "row_id",
                    keep: Sequence[str] = (), seed: int = 42, kinds: dict | None = None, exact_medians: bool = True) -> Prepared:
    """Learn preprocessing on training rows that carry ``y`` and write both sides as vectors."""
    start = time.perf_counter()
    stages = build_preprocessor(train, features, "y", row_key, scale, seed, exact_medians, kinds)
    fitted, rows = [], train
    for s in stages:
        model = s.fit(rows) if isinstance(s, Estimator) else s
        fitted.append(model)
        rows = model.transform_training(rows) if hasattr(model, "transform_training") else model.transform(rows)
    pipeline = PipelineModel(fitted)
    names = feature_names(rows)
    written = stage(rows.select(row_key, "y", "features"), "train-vectors")
    wanted = list(dict.fromkeys([row_key, "y", *keep, "features"]))
    others = stage(pipeline.transform(other).select(*wanted), "other-vectors") if other is not None else None
    return Prepared(pipeline, written, others, names, written.count(), row_key, time.perf_counter() - start)


def fit_vectors(name: str, rows: DataFrame, n: int, row_key: str = "row_id", params: Mapping | None = None, seed: int = 42) -> Model:
    """A candidate's estimator on rows (row key, y, features)."""
    spec = candidate(name)
    args = dict(params or {})
    if name not in ("baseline", "logistic"):
        args.setdefault("row_key", row_key)
    if spec.validation:
        held = hash32(f"{seed}-stop", row_key) < int(spec.validation * (1 << 32))
        rows = rows.withColumn("_held_out", held)
        args.setdefault("held", "_held_out")
    model = spec.make(n, **args).fit(rows)
    return _portable(model, rows.sparkSession) if isinstance(model, LogisticRegressionModel) else model


def _portable(model: LogisticRegressionModel, spark: SparkSession) -> LogisticRegressionModel:
    """The model as read back from storage, without its training summary.

    The summary holds the session, which travels with the model into every scoring task. Once the session has
    observed a metric (verified writes do), it can no longer be serialised and scoring fails.
    """
    path = f"{shared_dir(spark).rstrip('/')}/stage/logistic-{uuid.uuid4().hex[:12]}"
    model.save(path)
    return LogisticRegressionModel.load(path)


def fit_candidate(name: str, train: DataFrame, features: Sequence[str], row_key: str = "row_id",
                  n_rows: int | None = None, params: Mapping | None = None, seed: int = 42,
                  kinds: dict | None = None, exact_medians: bool = True) -> PipelineModel:
    """Fit preprocessing and model on rows that carry ``y``."""
    spec = candidate(name)
    ready = prepare_vectors(train, None, features, spec.needs_scaling, row_key, (), seed, kinds, exact_medians)
    return ready.fit(name, params, seed)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str], name: str | None = None) -> DataFrame:
    """Probability of the positive class next to the columns to keep."""
    out = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    cols = list(keep) + ["p"]
    return out.select(F.lit(name).alias("model"), *cols) if name else out.select(*cols)


def train_and_score(train: DataFrame, test: DataFrame, features: Sequence[str],
                    names: Sequence[str], row_key: str = "row_id", keep: Sequence[str] = (),
                    params: Mapping[str, Mapping] | None = None, seed: int = 42,
                    exact_medians: bool = True, kinds: dict | None = None):
    """Fit every candidate and score the test rows.

    Returns the panel (with fit seconds), the long score table and the fitted pipelines.
    Preprocessing is learnt once for each scaling variant; candidates share the written vectors
    and are fitted at the same time. Scores are keyed by row id; nothing is aligned by position.
    They are written once, so metrics do not run the models again.
    """
    from cohortlens.operators.roles import classify_columns

    kinds = kinds or classify_columns(train, features)
    needs = dict.fromkeys(candidate(n).needs_scaling for n in names)
    ready = {scale: prepare_vectors(train, test, features, scale, row_key, keep, seed, kinds, exact_medians) for scale in needs}

    def fit(name: str):
        start, mine = time.perf_counter(), ready[candidate(name).needs_scaling]
        model = mine.fit(name, (params or {}).get(name), seed)
        return model, round(mine.seconds + time.perf_counter() - start, 1)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        fitted = dict(zip(names, pool.map(fit, names)))
    parts = [score(PipelineModel([fitted[n][0].stages[-1]]), ready[candidate(n).needs_scaling].other,
                   list(dict.fromkeys([row_key, "y", *keep])), n) for n in names]
    scores = stage(reduce(DataFrame.unionByName, parts), "scores")
    times = test.sparkSession.createDataFrame([(n, t) for n, (_, t) in fitted.items()], "model string, fit_seconds double")
    panel = metric_panel(scores).join(F.broadcast(times), "model").orderBy(
        F.desc_nulls_last("roc_auc"), "model")
    return panel, scores, {n: m for n, (m, _) in fitted.items()}


def masked_scores(ready: Prepared, name: str, masks: Mapping[str, Sequence[int]], params: Mapping | None = None, seed: int = 42) -> DataFrame:
    """(model, y, p) of the other rows for one fit of a candidate on each subset of vector slots.

    Columns are prepared independently of each other, so a masked vector equals the vector that
    preprocessing without the masked columns would give. Nothing is prepared or read per mask but
    the written vectors.
    """
    def fit(item):
        label, slots = item
        cut = VectorSlicer(inputCol="features", outputCol="_kept", indices=list(slots))

        def masked(df: DataFrame) -> DataFrame:
            return cut.transform(df).drop("features").withColumnRenamed("_kept", "features")

        model = fit_vectors(name, masked(ready.train), ready.n, ready.row_key, params, seed)
        return score(PipelineModel([model]), masked(ready.other), ["y"], label)

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return stage(reduce(DataFrame.unionByName, pool.map(fit, masks.items())), "masked-scores")


# --- search -----------------------------------------------------------------------------------

# Search ranges (low, high, scale). Rounds are read from the curve of each fit, up to the most allowed.
SEARCH_SPACE = {
    "rate": (0.01, 0.15, "log"),
    "leaves": (15, 127, "log_int"),
    "least_rows": (50, 2000, "log_int"),
    "row_share": (0.6, 1.0, "linear"),
    "column_share": (0.4, 1.0, "linear"),
    "l1": (1e-3, 10.0, "log"),
    "l2": (1e-3, 10.0, "log"),
    "depth": (3, 12, "int"),
}
MOST_ROUNDS = 1200
SEARCH_PATIENCE = 30
#: Fits and folds of a search that are worked on at the same time.
SEARCH_FITS = 8


class DensityRatioSampler:
    """Draws configurations where good trials were dense and poor ones were not.

    The first ``warm`` draws are random. Later ones: finished trials are split at the best ``share``; for each
    parameter, a mixture of normal bells over either side (and one wide bell over the whole range) is fitted on the
    range's own scale; of ``tries`` values drawn from the good side, the one with the largest ratio of densities wins.
    """

    def __init__(self, space: Mapping[str, tuple] = SEARCH_SPACE, seed: int = 42, warm: int = 5, share: float = 0.25, tries: int = 24):
        self.space, self.rng, self.warm, self.share, self.tries = space, np.random.default_rng(seed), warm, share, tries
        self.seen: list[tuple[float, dict]] = []

    @property
    def blind(self) -> int:
        """Draws, at least one, that look at no trial yet to be told."""
        return max(1, self.warm - len(self.seen))

    def tell(self, params: Mapping, value: float) -> None:
        self.seen.append((value, dict(params)))

    def _place(self, name: str, value: float) -> float:
        lo, hi, scale = self.space[name]
        return (math.log(value / lo) / math.log(hi / lo)) if scale.startswith("log") else (value - lo) / (hi - lo)

    def _value(self, name: str, at: float):
        lo, hi, scale = self.space[name]
        v = lo * (hi / lo) ** at if scale.startswith("log") else lo + (hi - lo) * at
        return int(min(max(round(v), lo), hi)) if scale.endswith("int") else float(v)

    def _bells(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = np.sort(np.r_[at, 0.5])
        gaps = np.diff(np.r_[0.0, centre, 1.0])
        width = np.clip(np.maximum(gaps[:-1], gaps[1:]), 1 / min(100, len(centre) + 1), 1.0)
        width[np.searchsorted(centre, 0.5)] = 1.0
        return centre, width

    @staticmethod
    def _log_density(x: np.ndarray, bells: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        centre, width = bells
        z = -0.5 * ((x[:, None] - centre) / width) ** 2 - np.log(width)
        return np.logaddexp.reduce(z, 1) - math.log(len(centre))

    def ask(self) -> dict:
        if len(self.seen) < self.warm:
            return {n: self._value(n, self.rng.random()) for n in self.space}
        ranked = sorted(self.seen, key=lambda t: -t[0])
        cut = max(1, math.ceil(self.share * len(ranked)))
        out = {}
        for name in self.space:
            good, poor = (self._bells(np.array([self._place(name, p[name]) for _, p in part])) for part in (ranked[:cut], ranked[cut:]))
            k = self.rng.integers(len(good[0]), size=self.tries)
            x = np.clip(self.rng.normal(good[0][k], good[1][k]), 0, 1)
            out[name] = self._value(name, float(x[np.argmax(self._log_density(x, good) - self._log_density(x, poor))]))
        return out


@dataclass
class Search:
    """Trials in the order they ran, and the best one's settings with the rounds its folds kept."""

    history: DataFrame
    best: dict
    roc_auc: float
    roc_auc_std: float

    def to_json(self, **more) -> str:
        return json.dumps({**more, "roc_auc_cv": self.roc_auc, "std_cv": self.roc_auc_std, "params": self.best})


def _folds(train: DataFrame, features: Sequence[str], group: str, folds: int, row_key: str, seed: int, exact_medians: bool,
           kinds: dict | None) -> list[DataFrame]:
    """Vectors of all rows for each fold: preprocessing is learnt on the other folds, whose rows are not held. Folds are prepared at the same time."""
    rows = stage(grouped_stratified_folds(train, group, "y", folds, seed, "_fold").select(
        *dict.fromkeys([row_key, "y", "_fold", *features])), "tuning-folds")

    def make(k: int) -> DataFrame:
        ready = prepare_vectors(rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k), features, False, row_key, (), seed, kinds, exact_medians)
        return stage(ready.train.withColumn("_held", F.lit(False)).unionByName(ready.other.withColumn("_held", F.lit(True))), f"fold-{k}")

    with ThreadPoolExecutor(SEARCH_FITS) as pool:
        return list(pool.map(make, range(folds)))


def tune(train: DataFrame, features: Sequence[str], group: str, trials: int = 10, folds: int = 3,
         row_key: str = "row_id", seed: int = 42, space: Mapping[str, tuple] = SEARCH_SPACE, exact_medians: bool = True,
         kinds: dict | None = None, most_rounds: int = MOST_ROUNDS) -> Search:
    """Search for booster settings under group-whole folds; the test rows take no part.

    Folds are prepared and binned once, at the same time, and shared by all trials. A fit runs until its held fold gains nothing,
    so the number of rounds is read from its curve. A trial whose first fold has a larger loss than the median of the first folds
    so far counts by that fold alone (``folds_run`` 1). All fits of a trial, and of trials drawn without knowledge of each other,
    run at the same time: a fit is one task, so waiting for a first fold would leave the other cores idle. ``history`` has a row
    for each trial, best first, cut trials last.
    """
    from cohortlens.operators.roles import classify_columns

    kinds = kinds or classify_columns(train, features)
    prepared = _folds(train, features, group, folds, row_key, seed, exact_medians, kinds)
    sampler = DensityRatioSampler(space, seed)

    def fit(job):
        k, params = job
        return boost(ready[k][1], Settings(rounds=most_rounds, patience=SEARCH_PATIENCE, seed=seed, **params))

    def judge(fits: Mapping[tuple[int, int], tuple]) -> dict[tuple[int, int], float]:
        """ROC AUC of the held rows of each (trial, fold), all in one panel; scores are written once, as the panel reads them several times."""
        parts = [score(PipelineModel([HistBoosterModel.of(*f)]), ready[k][0].where("_held"), ["y"], f"{t} {k}") for (t, k), f in fits.items()]
        found = {r["model"]: r["roc_auc"] for r in roc_auc(stage(reduce(DataFrame.unionByName, parts), "tuning-scores")).collect()}
        return {(t, k): found[f"{t} {k}"] for t, k in fits}

    rows, first_folds = [], []
    with ThreadPoolExecutor(SEARCH_FITS) as pool:
        ready = list(zip(prepared, pool.map(lambda fold: bin_rows(fold, key=row_key, held="_held"), prepared)))
        while len(rows) < trials:
            drawn = {len(rows) + 1 + j: sampler.ask() for j in range(min(sampler.blind, trials - len(rows)))}
            jobs = [(t, k) for k in range(folds) for t in drawn]
            fits = dict(zip(jobs, pool.map(fit, [(k, drawn[t]) for t, k in jobs])))
            kept = {}
            for t in drawn:
                loss = min(fits[t, 0][1])
                cut = len(first_folds) >= 3 and loss > float(np.median(first_folds))
                first_folds.append(loss)
                kept |= {(t, k): fits[t, k] for k in range(1 if cut else folds)}
            found = judge(kept)
            for t, params in drawn.items():
                mine = [at for at in kept if at[0] == t]
                aucs = [found[at] for at in mine]
                rounds = max(1, round(float(np.mean([len(kept[at][0]) for at in mine]))))
                sampler.tell(params, float(np.mean(aucs)))
                rows.append((t, float(np.mean(aucs)), float(np.std(aucs)), len(aucs), rounds, {k: str(v) for k, v in params.items()}, params))
    whole = [r for r in rows if r[3] == folds]
    best = max(whole, key=lambda r: (r[1], -r[0]))
    history = train.sparkSession.createDataFrame(
        [r[:6] for r in rows], "trial int, roc_auc double, roc_auc_std double, folds_run int, rounds int, params map<string,string>"
    ).orderBy(F.desc("folds_run"), F.desc("roc_auc"), "trial")
    return Search(history, {**best[6], "rounds": best[4]}, best[1], best[2])
