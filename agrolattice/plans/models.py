"""Models for dataset viability and crop yield.

Parts and folds are exact: order statistics of an md5 of the key (``operators/stratify.py``).  The
learners (``operators/trees.py``) train on a table of bytes, broadcast once, and the trees
of all folds, refits and learners grow in parallel tasks:

- viability (a classifier) is fitted on all labelled rows, a byte for each feature;
- yield is fitted on all rows, summed by the bins of their features: equal bins have equal predictions,
  so the sums train the booster as the rows would.  The bins do not depend on how many cells there are.

Metrics and predictions always cover all rows.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import FEATURE_NAMES, catalog_features
from ..operators.stratify import rank_cuts, row_hash, stratified
from ..operators.tfidf import TOKEN, vocabulary
from ..operators.trees import Cells, Model, boost, fit_units, grow, models_of, predict_bins, scored, table_cuts, tree_table, with_bins
from ..params import TFIDF_SIZES
from ..session import materialize


def binary_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """M7: accuracy, precision, recall, F1 (zero division -> 0) in one aggregate."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    g = pred.agg(F.count(F.lit(1)).alias("n"), F.sum((y == p).cast("int")).alias("ok"),
                 F.sum(((y == 1) & (p == 1)).cast("int")).alias("tp"),
                 F.sum(((y == 0) & (p == 1)).cast("int")).alias("fp"),
                 F.sum(((y == 1) & (p == 0)).cast("int")).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return g.select(F.col("n").alias("n_test"), (F.col("ok") / F.col("n")).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"),
                    F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0).alias("f1"))


# ---------------------------------------------------------------- viability
class TfidfVectors(Estimator):
    """M1 as a pipeline stage: the ``k`` most frequent terms with their smooth idf
    (``operators/tfidf.py``), fitted into stages that save and load with their pipeline; rows
    of unit length."""

    def __init__(self, text: str, name: str, k: int):
        super().__init__()
        self.text, self.name, self.k = text, name, k

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        found = vocabulary(dataset, self.text, self.k).first()["vocab"] or []
        terms, idf = [v["term"] for v in found] or ["\x00"], [v["idf"] for v in found] or [1.0]
        tokens, counts, weights = (f"_{x}_{self.name}" for x in ("tok", "tf", "idf"))
        return PipelineModel([
            RegexTokenizer(inputCol=self.text, outputCol=tokens, pattern=TOKEN, gaps=False, toLowercase=True),
            CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol=counts),
            ElementwiseProduct(inputCol=counts, outputCol=weights, scalingVec=Vectors.dense(idf)),
            Normalizer(inputCol=weights, outputCol=f"_vec_{self.name}", p=2.0)])


def viability_featurizer() -> Pipeline:
    """M1 + M2 + M3: smooth TF-IDF (sizes 50/50/25) + the 32 catalog features, scaled."""
    names = {"Titulo": "title", "Descripción": "desc", "ds_justificacion": "just"}
    stages = [TfidfVectors(f"_txt_{names[col]}", names[col], k) for col, k in TFIDF_SIZES.items()]
    return Pipeline(stages=stages + [
        VectorAssembler(inputCols=FEATURE_NAMES + [f"_vec_{names[col]}" for col in TFIDF_SIZES], outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)])


def prepare_catalog(cat: DataFrame) -> DataFrame:
    df = catalog_features(cat)
    return df.withColumns({
        "_txt_title": F.coalesce(F.col("Titulo"), F.lit("")),
        "_txt_desc": F.coalesce(F.col("`Descripción`"), F.lit("")),
        "_txt_just": F.coalesce(F.col("ds_justificacion"), F.lit("")) if "ds_justificacion" in df.columns else F.lit(""),
        "label": F.col("es_viable").cast("double"),
    })


#: The forests' depth and the booster's, and how many rows start early stopping.
_FOREST_DEPTH, _BOOST_DEPTH, _EARLY = 15, 5, 10_000
_LEARNERS = ("rf", "et", "gbt")


def _units(subsets: dict, trees: int, rounds: int, seed: int, chunk: int = 25) -> list[dict]:
    """A unit of work for every 25 trees of a forest and for each booster, of each subset of rows."""
    out = []
    for name, (stack, fold) in subsets.items():
        for learner in _LEARNERS:
            n = trees if learner != "gbt" else rounds
            for lo in range(0, n, chunk if learner != "gbt" else n):
                out.append({"subset": name, "stack": stack, "fold": fold, "learner": learner, "lo": lo, "n": min(chunk, n - lo) if learner != "gbt" else n, "seed": seed})
    return out


def _viability_unit(train: np.ndarray, folds: np.ndarray):
    def fit(cells: Cells, u: dict):
        keep = (train | (u["stack"] == "all")) & (folds[0 if u["stack"] == "train" else 1] != u["fold"])
        rng = np.random.default_rng([u["seed"], u["lo"], _LEARNERS.index(u["learner"])])
        mine = cells.part(keep)
        if u["learner"] == "gbt":
            held = rng.random(keep.sum()) < 0.1 if keep.sum() > _EARLY else None
            if held is None:
                return boost(mine, u["n"], _BOOST_DEPTH, logistic=True)
            return boost(mine.part(~held), u["n"], _BOOST_DEPTH, logistic=True, held=mine.part(held))
        tried, trees = max(1, int(np.sqrt(cells.bins.shape[1]))), []
        for _ in range(u["n"]):
            # the forest draws its rows with replacement, the extremely randomised trees see all
            w = np.bincount(rng.integers(0, len(mine.weight), len(mine.weight)), minlength=len(mine.weight)) if u["learner"] == "rf" else mine.weight
            trees.append(grow(mine, w, w * mine.label_sum, _FOREST_DEPTH, tried, rng, random_cut=u["learner"] == "et"))
        return 0.0, trees

    def run(cells: Cells, u: dict):
        start, trees = fit(cells, u)
        if u["fold"] < 0:
            return start, trees
        # of a fold's models only what they say of its rows is wanted: the sums over these trees
        held = cells.part(folds[0 if u["stack"] == "train" else 1] == u["fold"])
        total = np.full(len(held.weight), start)
        for t in trees:
            total += predict_bins(t, held)
        return start, [], total
    return run


def _out_of_fold(done: list[dict], stack: str, mine: np.ndarray, folds: int, trees: int) -> np.ndarray:
    """Each row's probability by each learner of its own fold's models (rows x learners)."""
    oof = np.zeros((len(mine), len(_LEARNERS)))
    for f in range(folds):
        for i, name in enumerate(_LEARNERS):
            total = sum(u["scores"] for u in sorted(done, key=lambda u: u["lo"]) if u["subset"] == (stack, f) and u["learner"] == name)
            oof[mine == f, i] = 1 / (1 + np.exp(-total)) if name == "gbt" else total / max(1, trees)
    return oof


def _models(done: list[dict], logistic: bool) -> dict[str, Model]:
    out = {}
    for u in sorted(done, key=lambda u: u["lo"]):
        m = out.setdefault(u["learner"], Model([], u["start"], u["learner"] == "gbt", logistic and u["learner"] == "gbt"))
        m.trees += u["trees"]
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first, unpenalised) of the logistic model with an L2 ``penalty`` on the sum
    of losses (C = 1), by Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = np.diag([1e-9] + [penalty] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def split_catalog(cat: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    """M4, M6: UID, es_viable, part (20 % of each class, exactly, is the test part), fold (of the
    training part) and fold_all (of all rows), dealt evenly within each class."""
    # the cuts are found in many passes: they read two written columns, not the catalog's own plan
    rows = materialize(cat.select("UID", "es_viable"), "labels")
    every = stratified(rows, "UID", "es_viable", 0.0, folds, seed + 1).select("UID", F.col("fold").alias("fold_all"))
    return stratified(rows, "UID", "es_viable", 0.2, folds, seed).join(every, "UID")


def train_viability(cat: DataFrame, n_trees: int = 100, gbt_iter: int = 300, folds: int = 5, seed: int = 42,
                    refit: bool = True):
    """M4-M8: featurise, split 80/20 within each class, fit the stack (random forest, extremely
    randomised trees, histogram booster) with out-of-fold base probabilities and a logistic
    meta-model, evaluate on the whole test part, refit on all rows (``refit=False`` keeps the
    hold-out models).  The learners see all rows, in the order of the md5 of the UID.
    Returns (featurizer model, base models, meta weights, metrics DataFrame)."""
    data = prepare_catalog(cat).select("UID", "es_viable", "_txt_title", "_txt_desc", "_txt_just", *FEATURE_NAMES, "label")
    data = materialize(data, "viability-input")
    feat = viability_featurizer().fit(data)
    split = split_catalog(data, folds, seed).select("UID", "part", "fold", "fold_all")
    x = materialize(feat.transform(data).select("UID", "label", vector_to_array("features").alias("x")).join(split, "UID"), "viability-features")
    cuts = table_cuts(x, "x", x.count())
    rows = with_bins(x, "x", cuts).orderBy(row_hash("UID", f"fit{seed}"), "UID").select(
        F.col("label").cast("float").alias("label"), (F.col("part") == "train").alias("train"), F.col("fold").cast("byte").alias("fold"),
        F.col("fold_all").cast("byte").alias("fold_all"), "bins").toPandas()
    y = rows["label"].to_numpy(float)
    bins = np.frombuffer(b"".join(rows.pop("bins")), np.uint8).reshape(len(y), len(cuts))
    cells = Cells(bins, np.ones(len(y)), y, cuts)
    train = rows["train"].to_numpy(bool)
    where = np.stack([np.where(train, rows["fold"].to_numpy(np.int8), -2), rows["fold_all"].to_numpy(np.int8)]).astype(np.int8)
    stacks = ("train", "all") if refit else ("train",)
    subsets = {(s, f): (s, f) for s in stacks for f in (*range(folds), -1)}
    done = fit_units(cat.sparkSession, cells, _units(subsets, n_trees, gbt_iter, seed), _viability_unit(train, where))
    fitted = {}
    for stack in stacks:
        mine = where[0 if stack == "train" else 1]
        oof = _out_of_fold(done, stack, mine, folds, n_trees)
        fitted[stack] = (_models([u for u in done if u["subset"] == (stack, -1)], True), logistic_fit(oof[mine >= 0], y[mine >= 0]))
    bases, meta = fitted["train"]
    tested = apply_stack(x.where("part = 'test'"), bases, meta)
    metrics = materialize(binary_metrics(tested.withColumn("prediction", (F.col("p1") >= 0.5).cast("double"))), "viability-metrics")
    bases, meta = fitted[stacks[-1]]
    return feat, bases, meta, metrics


def apply_stack(x: DataFrame, bases: dict[str, Model], meta: np.ndarray, features: str = "x") -> DataFrame:
    """``x`` with ``p1``, the stack's probability of label 1 for the array ``features``."""
    out = scored(x, F.col(features), bases)
    z = sum((F.lit(float(w)) * F.col(f"_scores.{name}") for w, name in zip(meta[1:], bases)), F.lit(float(meta[0])))
    return out.withColumn("p1", 1 / (1 + F.exp(-z))).drop("_scores")


def score_viability(requests: DataFrame, catalog: DataFrame, feat: PipelineModel, bases, meta) -> DataFrame:
    """M9 + J10: known datasets take their catalog label; the rest are scored by the stack."""
    from .documents import known_probability
    withk = known_probability(requests, catalog)
    # only the unknown ones go through the featurizer and the forests
    known = withk.where("known_prob is not null").select("UID", "Titulo", F.col("known_prob").alias("_p"), F.lit(True).alias("from_catalog"))
    x = feat.transform(prepare_catalog(withk.where("known_prob is null")).withColumn("label", F.lit(0.0)))
    scores = apply_stack(x.select("UID", "Titulo", vector_to_array("features").alias("x")), bases, meta)
    p1 = F.col("_p")
    return known.unionByName(scores.select("UID", "Titulo", F.col("p1").alias("_p"), F.lit(False).alias("from_catalog"))).select(
        "UID", "Titulo", (p1 >= 0.5).cast("int").alias("prediction"), (1 - p1).alias("prob_0"), p1.alias("prob_1"), "from_catalog")


def feature_importances(spark, feat: PipelineModel, bases: dict[str, Model], top: int = 8) -> DataFrame:
    """Mean importance over the two forests (the boosted base exposes none in the original
    stack), top ``top`` named features."""
    names = list(FEATURE_NAMES)
    for stage in feat.stages:
        for inner in getattr(stage, "stages", []):
            if isinstance(inner, CountVectorizerModel):
                names += [f"tfidf:{t}" for t in inner.vocabulary]
    rows = [(name, names[i], float(v)) for name in ("rf", "et") for i, v in enumerate(bases[name].importances(len(names)))]
    df = spark.createDataFrame(rows, "model string, feature string, importance double")
    g = df.groupBy("feature").agg(F.avg("importance").alias("importance"))
    return g.orderBy(F.col("importance").desc(), "feature").limit(top)


# ---------------------------------------------------------------- yield
YIELD_NUMERIC = ["ph_suelo", "altitud_m", "pendiente_pct", "materia_organica_pct", "temp_media_c",
                 "precipitacion_anual_mm"]


def prepare_yield(master: DataFrame) -> DataFrame:
    from ..operators.impute import global_mean_impute
    from ..schemas import ensure_columns
    # Absent feature columns take "Franco" (texture) or 0.0
    df = ensure_columns(master, {"textura": "Franco", "cultivo": "Otro", **{c: 0.0 for c in YIELD_NUMERIC}})
    df = df.withColumn("label", F.col("rendimiento_ton_ha").cast("double"))
    df = global_mean_impute(df, "label")  # C10
    df = df.fillna({c: 0.0 for c in YIELD_NUMERIC}).fillna({"textura": "Franco", "cultivo": "Otro"})
    return df


class YieldModel:
    """The levels of crop and texture and the trees of both learners."""

    def __init__(self, levels: dict[str, list[str]], models: dict[str, Model]):
        self.levels, self.models = levels, models

    def features(self):
        """One column for each level (an unseen level has none set) and the numeric ones."""
        coded = [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in self.levels.items() for v in vs]
        return F.array(*coded, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in YIELD_NUMERIC])

    def save(self, spark, path: str) -> None:
        tree_table(spark, self.models).write.mode("overwrite").parquet(os.path.join(path, "trees"))
        spark.createDataFrame([(c, i, v) for c, vs in self.levels.items() for i, v in enumerate(vs)] or [("", -1, "")],
                              "column string, number int, level string").write.mode("overwrite").parquet(os.path.join(path, "levels"))

    @classmethod
    def load(cls, spark, path: str) -> "YieldModel":
        levels: dict[str, list[str]] = {"cultivo": [], "textura": []}
        for r in spark.read.parquet(os.path.join(path, "levels")).where("number >= 0").orderBy("column", "number").collect():
            levels[r["column"]].append(r["level"])
        return cls(levels, models_of(spark.read.parquet(os.path.join(path, "trees"))))


def yield_cells(data: DataFrame, flags: list[str], drop_first: bool = False, most_cells: int | None = None, bins: int = 255):
    """(levels, the cuts of each feature, a frame of cells): the rows summed by ``flags`` and the bins of
    their features, with ``n`` and ``s`` (sum of labels).  One aggregate finds the quantiles, one sums.

    The models get all cells of ``bins`` bins; only a caller that names ``most_cells`` has coarser ones."""
    levels = {c: sorted(r[c] for r in data.select(c).distinct().collect())[int(drop_first):] for c in ("cultivo", "textura")}
    while True:
        found = data.agg(*[F.percentile_approx(c, [i / bins for i in range(bins + 1)], 10_000).alias(c) for c in YIELD_NUMERIC]).first()
        # a row is above a cut if its value is larger; the largest value is no cut
        cuts = [np.unique(np.array(found[c] or [0.0]))[:-1] for c in YIELD_NUMERIC]
        out, kept = data, []
        for c, cut in zip(YIELD_NUMERIC, cuts):
            if len(cut):
                edges = [-float("inf"), *np.nextafter(cut, np.inf).tolist(), float("inf")]
                out = Bucketizer(splits=edges, inputCol=c, outputCol=f"_b_{c}").transform(out)
            else:
                out = out.withColumn(f"_b_{c}", F.lit(0.0))
            kept.append(f"_b_{c}")
        cells = materialize(out.groupBy(*flags, "cultivo", "textura", *kept).agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("s")), "yield-cells")
        if most_cells is None or cells.count() <= most_cells or bins <= 2:
            break
        bins //= 2
    frame = cells.toPandas()
    coded = [(frame[c] == v).to_numpy(np.uint8) for c, vs in levels.items() for v in vs]
    table = np.stack([*coded, *[frame[k].to_numpy().astype(np.uint8) for k in kept]], 1)
    return levels, [np.array([0.5])] * len(coded) + cuts, frame, table


def _yield_unit(keeps: dict, boosted: dict, forest_depth: int):
    def run(cells: Cells, u: dict):
        fit, held = keeps[u["subset"]]
        if u["learner"] == "gbt":
            return boost(cells.part(fit & ~held), u["n"], held=cells.part(fit & held) if (fit & held).any() else None, **boosted)
        mine, trees = cells.part(fit), []
        for i in range(u["n"]):
            rng = np.random.default_rng([u["seed"], u["lo"] + i])
            # rows drawn with replacement: about Poisson(n) of a cell's n
            w = rng.poisson(mine.weight).astype(float)
            trees.append(grow(mine, w, w * mine.label_sum / mine.weight, forest_depth, cells.bins.shape[1], rng))
        return 0.0, trees
    return run


def _fit_yield(data: DataFrame, key: str, trees: int, rounds: int, seed: int, forest_depth: int, boosted: dict, refit: bool, drop_first: bool = False):
    """{'train': YieldModel, 'all': YieldModel}, and the test part: the round(n / 5) rows of smallest hash."""
    hashed = data.withColumn("_h", row_hash(key, f"split{seed}")).withColumn("_all", F.lit(0))
    n = hashed.count()
    cut = rank_cuts(hashed, "_all", "_h", {0: [int(0.2 * n + 0.5)]}).get((0, int(0.2 * n + 0.5)), "")
    # a tenth of the rows stops the booster early, if there are enough
    early = F.substring(row_hash(key, f"early{seed}"), 1, 4) < F.lit("1999") if n > _EARLY else F.lit(False)
    hashed = hashed.withColumn("_test", F.col("_h") <= cut).withColumn("_early", early)
    levels, cuts, frame, table = yield_cells(hashed, ["_test", "_early"], drop_first)
    cells = Cells(table, frame["n"].to_numpy(float), frame["s"].to_numpy(float), cuts)
    held, tested = frame["_early"].to_numpy(bool), frame["_test"].to_numpy(bool)
    keeps = {"train": (~tested, held)} | ({"all": (np.ones(len(held), bool), held)} if refit else {})
    units = [u for u in _units({s: (s, -1) for s in keeps}, trees, rounds, seed) if u["learner"] != "et"]
    done = fit_units(data.sparkSession, cells, units, _yield_unit(keeps, boosted, forest_depth))
    return {s: YieldModel(levels, _models([u for u in done if u["subset"] == s], False)) for s in keeps}, hashed.where("_test").drop("_h", "_all", "_test", "_early")


def train_yield(master: DataFrame, key: str = "row_key", n_trees: int = 300, gbt_iter: int = 300, seed: int = 42):
    """Forest (depth 12) and histogram booster (depth 8, 31 leaves) fitted on 80 %, RMSE / R2
    of their mean on the rest, refit on all rows."""
    data = materialize(prepare_yield(master).select(key, "cultivo", "textura", *YIELD_NUMERIC, "label"), "yield-input")
    models, test = _fit_yield(data, key, n_trees, gbt_iter, seed, 12, {"depth": 8}, True)
    metrics = materialize(regression_metrics(predict_yield(models["train"], test)), "yield-metrics")
    return models["all"], metrics


#: A task keeps the scores of so many cells of rows; those of further cells are computed anew.
MOST_CELLS = 200_000


def predict_yield(model: YieldModel, df: DataFrame) -> DataFrame:
    out = scored(df, model.features(), model.models, cells=MOST_CELLS)
    return out.withColumn("prediction", (F.col("_scores.rf") + F.col("_scores.gbt")) / 2).drop("_scores")


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """RMSE and R2 in one aggregate (mean first, then residual sums)."""
    mean = pred.agg(F.avg(label).alias("_m")).withColumn("_one", F.lit(1))
    j = pred.withColumn("_one", F.lit(1)).join(F.broadcast(mean), "_one")
    g = j.agg(F.count(F.lit(1)).alias("n_test"), F.sum((F.col(label) - F.col(prediction)) ** 2).alias("_sse"),
              F.sum((F.col(label) - F.col("_m")) ** 2).alias("_sst"))
    return g.select("n_test", F.sqrt(F.col("_sse") / F.col("n_test")).alias("rmse"),
                    F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"))


def hybrid_models(master: DataFrame, key: str = "row_key", rf_trees: int = 100, gbt_iter: int = 100, seed: int = 42):
    """Dummy coding with the alphabetically first level dropped, fitted on all rows before
    the split (as ``get_dummies(drop_first=True)`` on the whole table); RF (depth 10) vs boosted
    trees (depth 6, step 0.1); hold-out RMSE of both.  Returns (the models, metrics)."""
    data = materialize(prepare_yield(master).select(key, "cultivo", "textura", *YIELD_NUMERIC, "label"), "hybrid-input")
    models, test = _fit_yield(data, key, rf_trees, gbt_iter, seed, 10, {"depth": 6, "leaves": 64, "least_rows": 1, "ridge": 1.0}, False, drop_first=True)
    tested = scored(test, models["train"].features(), models["train"].models, cells=MOST_CELLS)
    r1 = regression_metrics(tested.withColumn("prediction", F.col("_scores.rf"))).select(F.lit("random_forest").alias("model"), "n_test", "rmse", "r2")
    r2 = regression_metrics(tested.withColumn("prediction", F.col("_scores.gbt"))).select(F.lit("boosted_trees").alias("model"), "n_test", "rmse", "r2")
    return models["train"], materialize(r1.unionByName(r2), "hybrid-metrics")


# ---------------------------------------------------------------- M8 / S6: publish the viability bundle
def save_viability_bundle(path: str, feat: PipelineModel, bases: dict[str, Model], meta: np.ndarray, metrics: DataFrame) -> None:
    """Write featurizer, base models, meta weights and the metrics row under ``path`` (overwrite)."""
    spark = metrics.sparkSession
    feat.write().overwrite().save(os.path.join(path, "featurizer"))
    tree_table(spark, bases).write.mode("overwrite").parquet(os.path.join(path, "base"))
    spark.createDataFrame([([float(w) for w in meta],)], "weights array<double>").write.mode("overwrite").parquet(os.path.join(path, "meta"))
    metrics.write.mode("overwrite").parquet(os.path.join(path, "metrics"))


def load_viability_bundle(spark, path: str):
    """Inverse of ``save_viability_bundle``: (featurizer, base models, meta weights, metrics)."""
    feat = PipelineModel.load(os.path.join(path, "featurizer"))
    found = models_of(spark.read.parquet(os.path.join(path, "base")))
    meta = np.array(spark.read.parquet(os.path.join(path, "meta")).first()["weights"])
    return feat, {name: found[name] for name in _LEARNERS}, meta, spark.read.parquet(os.path.join(path, "metrics"))
