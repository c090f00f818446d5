"""Learning on Spark ML: estimators, encoders, calibration, fusion, search and explanations."""

from __future__ import annotations

import math
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    PCA, CountVectorizer, ElementwiseProduct, Imputer, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
    StandardScaler, StopWordsRemover, VectorAssembler,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.constants import SEED
from tidemark.functions.numeric import sigmoid
from tidemark.operators.encode import target_encode, train_popularity
from tidemark.operators.joins import with_one_row
from tidemark.operators.metrics import metrics
from tidemark.operators.scan import hash_rank, hash_unit, id_hash
from tidemark.session import cut, in_parallel, plan_bytes

SEARCH_BYTES = 16 << 20  # of the table that one task of a searched fit holds
VARIANT_ROWS = 20_000  # (row, repeat) pairs of one task of permutation importance; each is scored once per feature
FAMILIES = ("logit", "gbt", "mlp", "forest", "gaussian_nb", "linear_svc", "balanced_logit")


def make_estimator(
    name: str, features: Sequence[str], label: str, weight: str | None = None, seed: int = SEED, gaps: Sequence[str] | None = None, **params
) -> Pipeline:
    """Model by name as one pipeline: median imputation, assembling, scaling where needed, classifier.

    ``gaps`` names the features that some row lacks (see :func:`with_gaps`); the others need no median. Without it all are imputed.
    """
    open_ = {c: i for i, c in enumerate(features) if gaps is None or c in gaps}
    raw, filled = [f"_f{i}" for i in open_.values()], [f"_i{i}" for i in open_.values()]
    steps = [
        VectorAssembler(inputCols=[f"_i{open_[c]}" if c in open_ else c for c in features], outputCol="_vec"),
        StandardScaler(inputCol="_vec", outputCol="_scaled", withMean=True),
    ]
    if open_:
        doubles = [f"CAST({c} AS DOUBLE) AS _f{i}" for c, i in open_.items()]
        steps = [
            SQLTransformer(statement=f"SELECT *, {', '.join(doubles)} FROM __THIS__"),
            Imputer(strategy="median", inputCols=raw, outputCols=filled),
            *steps,
            SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(raw + filled)}) FROM __THIS__"),
        ]
    common = {"featuresCol": "_scaled", "labelCol": label}
    if weight:
        common["weightCol"] = weight
    if name in ("logit", "balanced_logit"):
        model = LogisticRegression(**common, **({"maxIter": 100, "regParam": 1e-4, "tol": 1e-5} | params))
    elif name == "gbt":
        model = GBTClassifier(**common, seed=seed, **({"maxDepth": 4, "stepSize": 0.05, "maxIter": 400} | params))
    elif name == "mlp":
        if weight:
            raise ValueError("the perceptron takes no row weights")
        layers = [len(features), 128, 64, 2]
        model = MultilayerPerceptronClassifier(**common, seed=seed, **({"layers": layers, "maxIter": 200} | params))
    elif name == "forest":
        model = RandomForestClassifier(**common, seed=seed, **({"numTrees": 100, "maxDepth": 8} | params))
    elif name == "gaussian_nb":
        model = NaiveBayes(**common, modelType="gaussian", **params)
    elif name == "linear_svc":
        model = LinearSVC(**common, **({"maxIter": 50, "regParam": 1e-3} | params))
    else:
        raise ValueError(f"unknown model {name!r}")
    return Pipeline(stages=[*steps, model])


def balance_weights(train: DataFrame, label: str, out: str = "_w") -> DataFrame:
    """Weights that give both classes the same mass."""
    share = train.agg(F.avg(F.col(label).cast("double")).alias("_s"))
    w = F.when(F.col(label) == 1, 0.5 / F.col("_s")).otherwise(0.5 / (1 - F.col("_s")))
    return with_one_row(train, share).withColumn(out, w).drop("_s")


def with_gaps(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that are null or NaN in some row, or no numbers, from one aggregate over the rows."""
    plain = [c for c in dict.fromkeys(features) if isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType)]
    lacking = [F.max(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"_g{i}") for i, c in enumerate(plain)]
    found = df.agg(F.count(F.lit(1)).alias("_rows"), *lacking).first()
    full = {c for i, c in enumerate(plain) if found[f"_g{i}"] is False}
    return [c for c in features if c not in full]


def fit(train: DataFrame, name: str, features: Sequence[str], label: str, weight: str | None = None, **params) -> PipelineModel:
    if name == "balanced_logit":
        train, weight = balance_weights(train, label), "_w"
    return make_estimator(name, features, label, weight, **params).fit(train)


def predict(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Add the probability of the positive class; margin models go through a sigmoid."""
    return _probability(model.transform(df), out)


def predict_cells(model: PipelineModel, df: DataFrame, cells: str, out: str = "p") -> DataFrame:
    """:func:`predict` where the features are the numbers of one array column, in the order of the fit.

    No feature is a column, so a plan over many variants of a row stays as narrow as the row.
    """
    _, imputer, _, scaler, _, classifier = model.stages
    middle = F.array(*[F.lit(float(m)) for m in imputer.surrogateDF.first()])
    filled = F.zip_with(cells, middle, lambda v, m: F.when(v.isNull() | F.isnan(v), m).otherwise(v))
    return _probability(classifier.transform(scaler.transform(df.withColumn("_vec", array_to_vector(filled)))), out)


def _probability(scored: DataFrame, out: str) -> DataFrame:
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:
        p = sigmoid(vector_to_array("rawPrediction")[1])
    drop = ["_vec", "_scaled", "rawPrediction", "probability", "prediction"]
    return scored.withColumn(out, p).drop(*drop)


# ---- text and vector encoders


_ONE_SVD = threading.Lock()  # the eigensolver behind computeSVD keeps static state


GRAM_TERMS = 2048  # the products of so many terms are 32 MB


def _gram_directions(unit: DataFrame, k: int) -> np.ndarray:
    """The first right singular vectors (terms x k) from the products of all pairs of terms, one pass over the rows."""
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(unit, "_n")).computeGramianMatrix().toArray()
    squares, v = np.linalg.eigh(gram)
    size = np.sqrt(np.maximum(squares[::-1][:k], 0.0))
    return v[:, ::-1][:, :k][:, size >= 1e-9 * size[0]]  # the limit of computeSVD


def _iterated_directions(unit: DataFrame, k: int) -> np.ndarray:
    """The same by an iterative solver that never holds a square of terms."""
    # it passes over the rows many times, so they are written once and kept
    rows = cut(MLUtils.convertVectorColumnsFromML(unit, "_n")).persist()
    with _ONE_SVD:
        v = RowMatrix(rows).computeSVD(k).V.toArray()
    rows.unpersist()
    return v


class TextEncoder:
    """TF-IDF followed by a truncated SVD, fitted on train text and applied to any text column.

    The vocabulary is bounded by ``terms``, so the projection matrix (terms x k) is a bounded
    broadcast. ``bigrams`` adds two-word terms. Vectors always have ``k`` numbers: a vocabulary
    that is too small for so many components leaves the last ones 0.
    """

    def __init__(self, terms: int = 8000, min_df: float = 5, k: int = 60, bigrams: bool = False):
        self.terms, self.min_df, self.k, self.bigrams = terms, min_df, k, bigrams

    def _tokens(self, df: DataFrame, text: str) -> DataFrame:
        clean = df.withColumn("_txt", F.coalesce(F.col(text), F.lit("")))
        words = RegexTokenizer(inputCol="_txt", outputCol="_w", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2).transform(clean)
        kept = StopWordsRemover(
            inputCol="_w", outputCol="_t", stopWords=StopWordsRemover.loadDefaultStopWords("english")
        ).transform(words)
        if self.bigrams:
            kept = NGram(n=2, inputCol="_t", outputCol="_b").transform(kept).withColumn("_t", F.concat("_t", "_b"))
        return kept.drop("_txt", "_w", "_b")

    def fit(self, train: DataFrame, text: str) -> TextEncoder:
        tokens = cut(self._tokens(train, text).select("_t"))
        counter = CountVectorizer(inputCol="_t", outputCol="_c", vocabSize=self.terms, minDF=self.min_df).fit(tokens)
        counts = counter.transform(tokens).select("_c")
        idf = IDF(inputCol="_c", outputCol="_x").fit(counts).idf.toArray() + 1.0
        weights = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_c", outputCol="_x")
        self.stages = [counter, weights, Normalizer(inputCol="_x", outputCol="_n")]
        unit = self._unit(tokens).select("_n")
        k = max(1, min(self.k, len(counter.vocabulary) - 1))
        v = _gram_directions(unit, k) if len(counter.vocabulary) <= GRAM_TERMS else _iterated_directions(unit, k)
        flip = np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
        self.basis = np.zeros((v.shape[0], self.k))
        self.basis[:, : v.shape[1]] = v * flip
        return self

    def _unit(self, tokens: DataFrame) -> DataFrame:
        """Unit TF-IDF vectors ``_n`` of the tokens."""
        for stage in self.stages:
            tokens = stage.transform(tokens)
        return tokens.drop("_t", "_c", "_x")

    def transform(self, df: DataFrame, text: str, out: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.basis)

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for sparse in batches:
                yield pd.Series(list(_project(sparse["indices"], sparse["values"], shared.value)))

        unit = self._unit(self._tokens(df, text))
        return unit.withColumn(out, project(F.unwrap_udt("_n"))).drop("_n")


TERMS_AT_ONCE = 200_000  # terms whose basis rows are held together


def _project(ids: pd.Series, values: pd.Series, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense basis, some hundred thousand terms at a time."""
    sizes = np.array([len(i) for i in ids], dtype=np.int64)
    out = np.zeros((len(sizes), basis.shape[1]))
    chunk = np.cumsum(sizes) // TERMS_AT_ONCE
    for c in np.unique(chunk):
        rows = np.flatnonzero((chunk == c) & (sizes > 0))
        if len(rows):
            terms, weight = np.concatenate(ids.to_numpy()[rows]), np.concatenate(values.to_numpy()[rows])
            starts = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            out[rows] = np.add.reduceat(basis[terms] * weight[:, None], starts, axis=0)
    return out


def tfidf_svd(df: DataFrame, text: str, train: Column, out: str = "sv", k: int = 60, **kw) -> DataFrame:
    """Dense text vectors, fitted on train rows only."""
    return TextEncoder(k=k, **kw).fit(df.filter(train), text).transform(df, text, out)


def spread_vector(df: DataFrame, vec: str, prefix: str, dim: int) -> tuple[DataFrame, list[str]]:
    """A vector column as named feature columns."""
    names = [f"{prefix}{i}" for i in range(dim)]
    return df.withColumns({n: F.col(vec)[i] for i, n in enumerate(names)}), names


def encode_text(
    df: DataFrame, text: str, encode: Callable[[list[str]], np.ndarray], dim: int, out: str, batch: int = 256
) -> DataFrame:
    """A vector per text from an encoder of the caller: ``encode`` takes up to ``batch`` texts and returns texts x ``dim``.

    The function travels to the workers, so it loads what it needs there. Null is the empty text.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for at in range(0, given.num_rows, batch):
                part = given.slice(at, batch)
                got = np.asarray(encode([t or "" for t in part.column(text).to_pylist()]), np.float64)
                if got.shape != (part.num_rows, dim):
                    raise ValueError(f"the encoder returned {got.shape} for {part.num_rows} texts of {dim} dimensions")
                flat = pa.array(got.ravel())
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, dim), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], names=[*part.schema.names, out])

    return df.mapInArrow(run, schema)


def pca(df: DataFrame, vec: str, train: Column, out: str, k: int = 64) -> DataFrame:
    """Principal components fitted on train rows."""
    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v.filter(train))
    return model.transform(v).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def cluster_prior(df: DataFrame, vec: str, label: str, train: Column, k: int = 50, seed: int = SEED) -> DataFrame:
    """k-means on train vectors, then the train success rate and log size of every row's cluster."""
    v = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v.filter(train))
    placed = model.transform(v).drop("_v")
    rated = target_encode(placed, "cluster", label, train, "cluster_rate")
    return train_popularity(rated, "cluster", train, "cluster_size_log")


# ---- calibration


def calibrate(valid: DataFrame, score: str, y: str, method: str = "isotonic"):
    """Fit a map from score to probability on held-out rows; apply it with :func:`apply_calibration`."""
    rows = valid.select(F.col(score).cast("double").alias("_s"), F.col(y).cast("double").alias("_y"))
    assembled = VectorAssembler(inputCols=["_s"], outputCol="_v").transform(rows)
    if method == "isotonic":
        return IsotonicRegression(featuresCol="_v", labelCol="_y").fit(assembled)
    return LogisticRegression(featuresCol="_v", labelCol="_y").fit(assembled)


def apply_calibration(df: DataFrame, score: str, model, out: str = "p_cal") -> DataFrame:
    """Calibrated probability; scores outside the fitted range are clipped to its ends, an unknown score gives null."""
    known = F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))
    filled = df.withColumn("_score", F.when(known, F.col(score).cast("double")).otherwise(0.0))
    scored = model.transform(VectorAssembler(inputCols=["_score"], outputCol="_v").transform(filled))
    p = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.withColumn(out, F.when(known, p)).drop("_v", "_score", "prediction", "probability", "rawPrediction")


# ---- out-of-fold prediction and fusion


def out_of_fold(
    df: DataFrame, name: str, features: Sequence[str], label: str, key: str, fold: str = "fold", folds: int = 4,
    encode=None, out: str = "p", **params,
) -> DataFrame:
    """Each fold scored by a model that never saw it; ``encode(df, train)`` refits encoders per fold, whose rows are written once."""
    full = None if encode else with_gaps(df, features)

    def one(k: int) -> DataFrame:
        train = F.col(fold) != k
        ready = cut(encode(df, train).select(key, label, fold, *features)) if encode else df
        model = fit(ready.filter(train), name, features, label, gaps=with_gaps(ready, features) if encode else full, **params)
        return predict(model, ready.filter(F.col(fold) == k), out).select(key, label, fold, out)

    return reduce(DataFrame.unionByName, in_parallel(df.sparkSession, [partial(one, k) for k in range(folds)]))


def stack_oof(tables: Mapping[str, DataFrame], key: str, label: str, fold: str = "fold", folds: int = 4) -> DataFrame:
    """Nested stacking: a logistic model over the out-of-fold scores of several models."""
    wide = None
    for name, t in tables.items():
        one = t.select(key, label, fold, F.col("p").alias(f"p_{name}"))
        wide = one if wide is None else wide.join(one.select(key, f"p_{name}"), key)
    wide = cut(wide)  # every step of every fold's fit reads it
    return out_of_fold(wide, "logit", [f"p_{n}" for n in tables], label, key, fold, folds, out="p_stack")


def mean_ensemble(df: DataFrame, scores: Sequence[str], out: str = "p_mean") -> DataFrame:
    """Mean of the known scores of a row."""
    known = F.filter(F.array(*scores), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn(out, F.when(F.size(known) > 0, total / F.size(known)))


def early_fusion(df: DataFrame, vectors: Sequence[str], out: str) -> DataFrame:
    """Modality vectors joined end to end."""
    return df.withColumn(out, F.concat(*[F.col(v).cast("array<double>") for v in vectors]))


def select_by_brier(candidates: Mapping[str, DataFrame], y: str, p: str = "p") -> DataFrame:
    """Brier score per candidate and which one is best."""
    rows = reduce(
        DataFrame.unionByName,
        [t.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier")).select(F.lit(n).alias("model"), "brier")
         for n, t in candidates.items()],
    )
    best = rows.agg(F.min_by("model", "brier").alias("_best"))
    return with_one_row(rows, best).select("model", "brier", (F.col("model") == F.col("_best")).cast("int").alias("chosen"))


def random_grid(space: Mapping[str, Sequence], trials: int, seed: int = SEED) -> list[dict]:
    """Distinct seeded draws from a parameter grid."""
    keys = list(space)
    size = math.prod(len(space[k]) for k in keys)
    picks = np.random.default_rng(seed).permutation(size)[:trials]
    out = []
    for n in picks:
        one, rest = {}, int(n)
        for k in keys:
            rest, i = divmod(rest, len(space[k]))
            one[k] = space[k][i]
        out.append(one)
    return out


def search(
    df: DataFrame, name: str, features: Sequence[str], label: str, key: str, space: Mapping[str, Sequence], trials: int = 30,
    fold: str = "fold", folds: int = 4, seed: int = SEED,
) -> DataFrame:
    """Seeded random search by mean fold AUC: one row per trial, the best flagged."""
    parts = []
    for i, params in enumerate(random_grid(space, trials, seed)):
        oof = out_of_fold(df, name, features, label, key, fold, folds, **params)
        auc = metrics(oof, label, "p", by=[fold]).agg(F.avg("roc_auc").alias("mean_auc"))
        parts.append(auc.select(F.lit(i).alias("trial"), F.lit(str(params)).alias("params"), "mean_auc"))
    rows = reduce(DataFrame.unionByName, parts)
    best = rows.agg(F.max_by("trial", "mean_auc").alias("_best"))
    return with_one_row(rows, best).select(
        "trial", "params", "mean_auc", (F.col("trial") == F.col("_best")).cast("int").alias("chosen")
    )


def halving_search(
    df: DataFrame, name: str, features: Sequence[str], label: str, key: str, space: Mapping[str, Sequence], trials: int = 30,
    fold: str = "fold", folds: int = 4, rungs: int = 3, eta: int = 3, seed: int = SEED, width: int = 8,
) -> DataFrame:
    """Random search by successive halving: one row per trial and rung that it reached, the best of the last rung flagged.

    Rung r of R scores its trials on a hashed share eta ** (r - R + 1) of the rows in all folds, and the best 1 / eta
    of them go on; the last rung uses all rows. A fold's features are filled and scaled once, from its own
    train rows, and written once per rung, so a rung reads its own share only; trials then fit side by side and differ in
    nothing but the classifier. Only features that some row lacks are filled.
    """
    unit = hash_unit(id_hash(key, f"rung{seed}"))
    shares = [float(eta) ** (rung - rungs + 1) for rung in range(rungs)]

    def prepared(k: int) -> list[DataFrame]:
        train = F.col(fold) != k
        steps = Pipeline(stages=make_estimator(name, features, label, gaps=gaps).getStages()[:-1]).fit(df.filter(train))
        ready = steps.transform(df).select(label, F.lit(k).alias("_fold"), train.alias("_train"), unit.alias("_u"), "_scaled")
        whole = cut(ready.coalesce(parts))
        return [cut(whole.filter(F.col("_u") < share).coalesce(parts)) if share < 1 else whole.filter(F.col("_u") < share) for share in shares]

    spark = df.sparkSession
    parts = max(1, min(-(-plan_bytes(df) // SEARCH_BYTES), 2**31 - 1))  # every iteration of a fit is a job over them; an unknown size is no limit
    gaps = with_gaps(df, features)
    ready = in_parallel(spark, [partial(prepared, k) for k in range(folds)])

    def mean_auc(params: dict, rung: int) -> float:
        scored = []
        for by_rung in ready:
            some = by_rung[rung]
            model = make_estimator(name, features, label, gaps=gaps, **params).getStages()[-1].fit(some.filter("_train"))
            scored.append(predict(model, some.filter("NOT _train")).select(label, "_fold", "p"))
        by_fold = metrics(reduce(DataFrame.unionByName, scored), label, "p", by=["_fold"])
        return by_fold.agg(F.avg("roc_auc")).first()[0]

    alive = list(enumerate(random_grid(space, trials, seed)))
    table = []
    for rung in range(rungs):
        scores = in_parallel(spark, [partial(mean_auc, params, rung) for _, params in alive], width)
        # A share too small for both classes has no AUC; such a trial is not dropped for it.
        order = sorted(zip(alive, scores, strict=True), key=lambda x: (x[1] is not None, -(x[1] or 0.0), x[0][0]))
        table += [(i, rung, shares[rung], str(params), auc) for (i, params), auc in order]
        alive = [trial for trial, _ in order][: max(1, math.ceil(len(order) / eta))] if any(s is not None for s in scores) else alive
    best = min((r for r in table if r[1] == rungs - 1), key=lambda r: (-(r[4] or 0.0), r[0]))[0]
    rows = [(*r, int(r[0] == best and r[1] == rungs - 1)) for r in table]
    return spark.createDataFrame(rows, "trial int, rung int, share double, params string, mean_auc double, chosen int")


# ---- explanations


def permute_column(df: DataFrame, key: str, col: str, seed: int | str) -> DataFrame:
    """The column dealt to other rows: values in one hashed order meet rows in another."""
    rows = hash_rank(df.withColumn("_h", id_hash(key, f"rows{seed}")), [], "_h", "_rk").drop("_h")
    values = df.select(F.col(col).alias("_new"), id_hash(key, f"values{seed}").alias("_h"))
    dealt = hash_rank(values, [], "_h", "_rk").drop("_h")
    return rows.join(dealt, "_rk").withColumn(col, F.col("_new")).drop("_rk", "_new")


def permutation_importance(
    model: PipelineModel, held_out: DataFrame, features: Sequence[str], label: str, key: str, repeats: int = 5
) -> DataFrame:
    """Mean AUC lost when one column is shuffled, per feature.

    A repeat deals whole rows of features to other rows once; every feature then takes its column from that deal,
    and all (feature, repeat) variants are scored in one batch. The held-out rows are read once.
    """
    cells = F.array(*[F.col(f).cast("double") for f in features])
    held = held_out.select(key, label, cells.alias("_cells")).withColumn("_h", id_hash(key, "rows"))
    held = cut(hash_rank(held, [], "_h", "_rk").drop("_h"))
    # A row becomes many variants, so rows are dealt by number: one task per repeat, or as many as their bytes ask for, are too few.
    parts = max(2 * held.sparkSession.sparkContext.defaultParallelism, math.ceil(held.count() * repeats / VARIANT_ROWS))
    deals = held.select(key, "_cells", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_repeat"))
    deals = deals.withColumn("_h", id_hash(F.concat_ws(":", F.col(key).cast("string"), F.col("_repeat").cast("string")), "values"))
    deals = hash_rank(deals, ["_repeat"], "_h", "_rk").select("_rk", "_repeat", F.col("_cells").alias("_new"))
    both = held.repartition(parts, "_rk").join(deals.repartition(parts, "_rk"), "_rk")
    variants = both.withColumn("_feature", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    swapped = variants.withColumns({f: F.when(F.col("_feature") == i, F.col("_new")[i]).otherwise(F.col("_cells")[i]) for i, f in enumerate(features)})
    shuffled = metrics(predict(model, swapped), label, "p", by=["_feature", "_repeat"])
    plain = held.withColumns({f: F.col("_cells")[i] for i, f in enumerate(features)})
    base = metrics(predict(model, plain), label, "p").select(F.col("roc_auc").alias("_base"))
    lost = with_one_row(shuffled, base).withColumn("_d", F.col("_base") - F.col("roc_auc"))
    names = F.array(*[F.lit(f) for f in features])
    return lost.groupBy(names[F.col("_feature")].alias("feature")).agg(F.avg("_d").alias("importance"), F.stddev_pop("_d").alias("spread"))


def linear_table(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """A fitted logistic pipeline as rows: feature, median, mean, std, coef, intercept."""
    imputer, scaler, clf = model.stages[1], model.stages[3], model.stages[5]
    medians = imputer.surrogateDF.first()
    std = np.where(scaler.std.toArray() == 0, 1.0, scaler.std.toArray())
    rows = [
        (f, float(medians[i]), float(scaler.mean[i]), float(std[i]), float(clf.coefficients[i]), float(clf.intercept))
        for i, f in enumerate(features)
    ]
    return spark.createDataFrame(rows, "feature string, median double, mean double, std double, coef double, intercept double")


def _contributed(df: DataFrame, features: Sequence[str], table: DataFrame) -> DataFrame:
    """``df`` with ``_c``, the array of (feature, value, contribution) in the order of ``features``, and the intercept.

    ``table`` has one row per feature; it becomes one row of arrays, so rows are scored where they lie.
    A feature that the table lacks contributes nothing.
    """
    cell = F.struct("feature", F.struct("median", "mean", "std", "coef"))
    held = table.agg(F.map_from_entries(F.collect_list(cell)).alias("_map"), F.first("intercept").alias("_intercept"))
    names = F.array(*[F.lit(f) for f in features])
    one = held.select(
        F.transform(names, lambda f: F.struct(f.alias("feature"), F.try_element_at("_map", f).alias("m"))).alias("_model"), "_intercept"
    )
    values = F.array(*[F.col(f).cast("double") for f in features])

    def term(m: Column, v: Column) -> Column:
        z = (F.coalesce(v, m["m"]["median"]) - m["m"]["mean"]) / m["m"]["std"]
        return F.struct(m["feature"].alias("feature"), v.alias("value"), (m["m"]["coef"] * z).alias("contribution"), m["m"].isNotNull().alias("known"))

    terms = F.filter(F.zip_with("_model", values, term), lambda t: t["known"])
    return with_one_row(df, one).withColumn("_c", terms).drop("_model")


def linear_contributions(df: DataFrame, key: str, features: Sequence[str], table: DataFrame) -> DataFrame:
    """Signed contribution coef * z per row and feature; ``table`` has one row per feature."""
    tall = _contributed(df, features, table).select(key, F.explode("_c").alias("_e"), F.col("_intercept").alias("intercept"))
    return tall.select(key, "_e.feature", "_e.value", "_e.contribution", "intercept")


def linear_score(df: DataFrame, features: Sequence[str], table: DataFrame, out: str = "p") -> DataFrame:
    """Add the probability of a linear model given as rows; no row moves."""
    total = F.aggregate("_c", F.col("_intercept"), lambda s, t: s + t["contribution"])
    return _contributed(df, features, table).withColumn(out, sigmoid(total)).drop("_c", "_intercept")


def top_factors(
    df: DataFrame, key: str, features: Sequence[str], table: DataFrame, n: int = 6, bucket: Mapping[str, str] | None = None
) -> DataFrame:
    """The ``n`` largest contributions per row by size; features with a bucket's prefix are summed first."""
    def label(feature: str) -> str:
        return next((group for prefix, group in reversed(list((bucket or {}).items())) if feature.startswith(prefix)), feature)

    groups: dict[str, list[str]] = {}
    for f in features:
        groups.setdefault(label(f), []).append(f)
    by_name = F.map_from_entries(F.transform("_c", lambda t: F.struct(t["feature"], t["contribution"])))
    sums = [
        F.struct(F.lit(g).alias("factor"), reduce(lambda a, b: a + b, [F.coalesce(F.col("_by")[f], F.lit(0.0)) for f in fs]).alias("contribution"))
        for g, fs in groups.items()
    ]
    ordered = F.array_sort(F.transform(F.array(*sums), lambda t: F.struct((-F.abs(t["contribution"])).alias("o"), t["factor"], t["contribution"])))
    rows = _contributed(df, features, table).select(key, by_name.alias("_by")).select(key, F.posexplode(F.slice(ordered, 1, n)).alias("_p", "_f"))
    return rows.select(
        key, (F.col("_p") + 1).alias("rank"), F.col("_f.factor").alias("factor"), F.col("_f.contribution").alias("contribution")
    )


def median_sensitivity(
    model: PipelineModel, df: DataFrame, key: str, features: Sequence[str], medians: Mapping[str, float]
) -> DataFrame:
    """Change of the probability when one feature is set to its median, scored in one batch."""
    cells = df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_cells"))
    variants = cells.withColumn("_reset", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    middle = F.array(*[F.lit(float(medians[f])) for f in features])
    reset = F.transform("_cells", lambda v, i: F.when(i == F.col("_reset"), F.get(middle, i)).otherwise(v))
    scored = predict_cells(model, variants.select(key, "_reset", reset.alias("_cells")), "_cells")
    own = F.max(F.when(F.col("_reset") == -1, F.col("p")))
    deltas = [(own - F.max(F.when(F.col("_reset") == i, F.col("p")))).alias(f"_d{i}") for i in range(len(features))]
    wide = scored.groupBy(key).agg(*deltas)
    cells = ", ".join(f"'{f}', _d{i}" for i, f in enumerate(features))
    return wide.selectExpr(key, f"stack({len(features)}, {cells}) AS (feature, delta)")


# ---- transfer


def transfer_head(source: DataFrame, target: DataFrame, vec: str, outcome: str, out: str) -> DataFrame:
    """A regression head fitted on one table's vectors and applied to another's."""
    def assembled(df: DataFrame) -> DataFrame:
        return df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))

    train = assembled(source).select("_v", F.col(outcome).cast("double").alias("_y"))
    model = LinearRegression(featuresCol="_v", labelCol="_y", regParam=1e-3).fit(train)
    return model.transform(assembled(target)).withColumnRenamed("prediction", out).drop("_v")
