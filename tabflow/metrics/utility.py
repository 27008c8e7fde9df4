"""Utility of synthetic data: train on real / fake / both, test on real
(G11-G17).

Learners are ``pyspark.ml`` estimators (distributed fits) plus the package's
own histogram booster:

* ``lin``: multinomial logistic regression without penalty (500 iterations) /
  least squares;
* ``linboost``: AdaBoost -- SAMME on decision stumps / AdaBoost.R2 on depth-3
  trees; each round is one weighted tree fit, sample weights live in a column;
* ``tree``: random forest;
* ``treeboost``: gradient-boosted trees (``tabflow.learners.hist_boost``).

Scores: macro F1 (classification) or R2 (regression), computed by the
aggregations of ``metrics.scores``.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import encode
from ..session import KEPT, materialize
from . import scores

LEARNERS = ("lin", "linboost", "tree", "treeboost")


@dataclass
class UtilityParams:
    max_iter: int = 500
    ada_rounds: int = 50
    forest_trees: int = 100
    forest_depth: int = 28
    boost_rounds: int = 100
    boost_depth: int = 7
    seed: int = 0
    seeds: int = 5


def design(train: DataFrame, tests: list[DataFrame], features: list[str], categorical: list[str],
           target: str, classification: bool):
    """Dummy-code categorical inputs (C6, dictionary over all parts), assemble
    ``features`` vector, label column ``label`` (class code or value)."""
    parts = [train, *tests]
    union = parts[0].select(*categorical, *([target] if classification else []))
    for p in parts[1:]:
        union = union.unionByName(p.select(*categorical, *([target] if classification else [])))
    dicts = {c: encode.category_values(union, c) for c in categorical}
    classes = encode.category_values(union, target) if classification else None
    num = [f for f in features if f not in categorical]
    dummy_cols = [encode.dummy_name(c, v) for c in categorical for v in dicts[c]]
    asm = VectorAssembler(inputCols=num + dummy_cols, outputCol="features", handleInvalid="keep")

    def prep(d):
        d = encode.onehot(d.select(*num, *categorical, target), dicts, drop_first=False)
        if classification:
            m = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])
            lab = F.element_at(m, F.col(target))
        else:
            lab = F.col(target).cast("double")
        d = d.withColumn("label", lab).withColumn("row_no", F.monotonically_increasing_id())
        for c in num:
            d = d.withColumn(c, F.col(c).cast("double"))
        return asm.transform(d).select("row_no", "features", "label", *num, *dummy_cols)
    return prep(train), [prep(t) for t in tests], classes, num + dummy_cols


class _Rounds:
    """Weighted training rows of a boosting loop: each round's weights are stored once and the previous
    round's are released (every tenth goes to the checkpoint folder, which bounds recomputation)."""

    def __init__(self, train: DataFrame):
        n = train.count()
        self.now = train.withColumn("w", F.lit(1.0 / max(n, 1))).persist(KEPT)
        self.m = 0

    def update(self, weighted: DataFrame) -> None:
        """``weighted``: the same rows with new, not yet normalised weights ``w``."""
        total = weighted.agg(F.sum("w")).first()[0]
        new = weighted.select("row_no", "features", "label", (F.col("w") / F.lit(total)).alias("w"))
        self.m += 1
        new = materialize(new) if self.m % 10 == 0 else new.persist(KEPT)
        new.count()
        self.now.unpersist()
        self.now = new

    def release(self) -> None:
        self.now.unpersist()


def _adaboost_samme(train, tests, n_classes, rounds, seed):
    state, models = _Rounds(train), []
    for m in range(rounds):
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", seed=seed + m).fit(state.now)
        miss = (F.col("prediction") != F.col("label")).cast("double")
        pr = tree.transform(state.now).withColumn("miss", miss)
        err = pr.agg((F.sum(F.col("w") * F.col("miss")) / F.sum("w")).alias("e")).first()["e"] or 0.0
        if err <= 0:
            models.append((tree, 1.0))
            break
        if err >= 1.0 - 1.0 / n_classes:
            break
        alpha = math.log((1 - err) / err) + math.log(n_classes - 1)
        models.append((tree, alpha))
        state.update(pr.withColumn("w", F.col("w") * F.exp(F.lit(alpha) * F.col("miss"))))
    state.release()
    outs = []
    for t in tests:
        votes = t
        for i, (tree, alpha) in enumerate(models):
            votes = tree.setPredictionCol(f"p{i}").setProbabilityCol(f"pp{i}").setRawPredictionCol(f"rp{i}") \
                .transform(votes).drop(f"pp{i}", f"rp{i}")
        score = [sum((F.when(F.col(f"p{i}") == F.lit(float(k)), F.lit(a)).otherwise(F.lit(0.0))
                      for i, (_, a) in enumerate(models)), F.lit(0.0)) for k in range(n_classes)]
        arr = F.array(*score)
        pred = (F.array_position(arr, F.array_max(arr)) - 1).cast("double")
        outs.append(votes.select("row_no", "label", pred.alias("prediction")))
    return outs


def _adaboost_r2(train, tests, rounds, seed):
    state, models = _Rounds(train), []
    for m in range(rounds):
        tree = DecisionTreeRegressor(maxDepth=3, weightCol="w", seed=seed + m).fit(state.now)
        pr = tree.transform(state.now).withColumn("ae", F.abs(F.col("prediction") - F.col("label")))
        r = pr.agg(F.max("ae").alias("mx"), (F.sum(F.col("w") * F.col("ae")) / F.sum("w")).alias("mean")).first()
        if not r["mx"]:
            models.append((tree, 1.0))
            break
        err = r["mean"] / r["mx"]
        if err >= 0.5:
            if not models:
                models.append((tree, 1.0))
            break
        beta = max(err / (1 - err), 1e-12)
        models.append((tree, math.log(1 / beta)))
        keep = F.lit(1.0) - F.col("ae") / F.lit(r["mx"])
        state.update(pr.withColumn("w", F.col("w") * F.pow(F.lit(beta), keep)))
    state.release()
    outs = []
    for t in tests:
        x = t
        for i, (tree, _) in enumerate(models):
            x = tree.setPredictionCol(f"p{i}").transform(x)
        med = weighted_median([F.col(f"p{i}") for i in range(len(models))], [a for _, a in models])
        outs.append(x.select("row_no", "label", med.alias("prediction")))
    return outs


def weighted_median(values, weights) -> Column:
    """Smallest value at which the running weight (values ascending) reaches half of all weight."""
    pairs = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(float(w)).alias("w"))
                                   for v, w in zip(values, weights)]))
    half = F.lit(0.5 * float(sum(weights)))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m"))

    def step(acc, x):
        c = acc["c"] + x["w"]
        return F.struct(c.alias("c"), F.coalesce(acc["m"], F.when(c >= half, x["v"])).alias("m"))
    return F.aggregate(pairs, start, step, lambda acc: acc["m"])


def _boosted(train, tests, cols, classification, n_classes, p: UtilityParams):
    from ..learners.flows import bin_expr, quantile_edges, thresholds_from_edges
    from ..learners.hist_boost import BoostParams, fit_boosted, predict_margin
    nb = 64
    edges = quantile_edges(train, cols, nb, {})
    bins = F.array(*[bin_expr(F.col(c), edges[c]) for c in cols])
    rows = train.select(F.lit(0).alias("model"), F.col("row_no").alias("rid"), bins.alias("bins"),
                        F.lit(len(cols)).alias("nin"), F.col("label").alias("y"))
    bp = BoostParams(n_rounds=p.boost_rounds, depth=p.boost_depth, eta=0.3, lam=0.0,
                     objective="softmax" if classification else "squared")
    forest = fit_boosted(rows, bp, n_class={0: n_classes} if classification else None,
                         n_inputs=len(cols), n_bins=nb)
    thr = np.stack([thresholds_from_edges(edges[c], nb) for c in cols])
    spark = train.sparkSession
    bc = spark.sparkContext.broadcast((forest, thr))

    def run(batches, _bc=bc):
        import pandas as pd
        fr, th = _bc.value
        for pdf in batches:
            X = pdf[cols].to_numpy(dtype=np.float64)
            if classification:
                marg = np.stack([predict_margin(fr, (0, k), X, th) for k in range(n_classes)], axis=1)
                pred = marg.argmax(axis=1).astype(np.float64)
            else:
                pred = predict_margin(fr, (0, 0), X, th)
            yield pd.DataFrame({"row_no": pdf["row_no"], "label": pdf["label"].to_numpy(dtype=np.float64),
                                "prediction": pred})
    return [t.select("row_no", "label", *cols).mapInPandas(run, "row_no long, label double, prediction double")
            for t in tests]


def predictions(learner: str, train, tests, cols, classification, n_classes, p: UtilityParams):
    """Predictions of one learner on each test part."""
    if learner == "lin":
        est = (LogisticRegression(maxIter=p.max_iter, regParam=0.0, family="multinomial") if classification
               else LinearRegression(regParam=0.0, solver="normal"))
        m = est.fit(train)
        return [m.transform(t).select("row_no", "label", "prediction") for t in tests]
    if learner == "linboost":
        return (_adaboost_samme(train, tests, n_classes, p.ada_rounds, p.seed) if classification
                else _adaboost_r2(train, tests, p.ada_rounds, p.seed))
    if learner == "tree":
        est = (RandomForestClassifier(numTrees=p.forest_trees, maxDepth=min(p.forest_depth, 30), seed=p.seed)
               if classification else
               RandomForestRegressor(numTrees=p.forest_trees, maxDepth=min(p.forest_depth, 30), seed=p.seed))
        m = est.fit(train)
        return [m.transform(t).select("row_no", "label", "prediction") for t in tests]
    if learner == "treeboost":
        return _boosted(train, tests, cols, classification, n_classes, p)
    raise KeyError(learner)


def together(work, items) -> list:
    """``work`` of every item, side by side: their jobs are many and small, and none needs another's result."""
    items = list(items)
    with ThreadPoolExecutor(max(len(items), 1)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(work), i) for i in items]]


def score(pred: DataFrame, classification: bool) -> float:
    if classification:
        return float(scores.f1_macro(pred, "label", "prediction").first()["f1"] or 0.0)
    return float(scores.r2(pred, "label", "prediction").first()["r2"] or 0.0)


def prepare_parts(train: DataFrame, test: DataFrame, features, categorical, target, classification):
    """Design matrices of both sides, kept while the learners run.  With no other column the target itself
    is the only input (a one-column table)."""
    features = [f for f in features if f != target] or [target]
    if features == [target]:
        train, test = (d.withColumn("__x", F.col(target)) for d in (train, test))
        features, categorical = ["__x"], (["__x"] if target in categorical or classification else [])
    tr, (te,), classes, cols = design(train, [test], features, [c for c in categorical if c in features], target,
                                      classification)
    return tr.persist(KEPT), te.persist(KEPT), classes, cols


def score_four_models(train: DataFrame, test: DataFrame, features, categorical, target, classification,
                      p: UtilityParams | None = None, learners=LEARNERS) -> dict:
    """Score of each learner plus their mean, averaged over ``p.seeds`` seeds; classes of the test side
    missing from the training side zero every score (G10).  Only the forest draws at random; the others give
    the same result for every seed and run once."""
    p = p or UtilityParams()
    if classification:
        guard = scores.missing_classes(train, test, target).first()["guard"]
        if guard:
            return {**{m: 0.0 for m in learners}, "mean": 0.0}
    tr, te, classes, cols = prepare_parts(train, test, features, categorical, target, classification)
    n_classes = len(classes) if classes else 0
    tr.count(), te.count()      # learners that begin together would each make the rows

    def one(m):
        runs = []
        for s in range(p.seeds if m == "tree" else 1):
            (pr,) = predictions(m, tr, [te], cols, classification, n_classes, replace(p, seed=p.seed + s))
            runs.append(score(pr, classification))
        return float(np.mean(runs))
    out = dict(zip(learners, together(one, learners)))
    tr.unpersist(), te.unpersist()
    out["mean"] = float(np.mean([out[m] for m in learners]))
    return out


def utility_real_fake_both(real_train, fake, real_test, features, categorical, target, classification,
                           p: UtilityParams | None = None, learners=LEARNERS) -> dict:
    """Train on real, on fake and on their union; always test on real."""
    both = real_train.select(*features, target).unionByName(fake.select(*features, target))
    return dict(zip(("real", "fake", "comb"), together(
        lambda tr: score_four_models(tr, real_test, features, categorical, target, classification, p, learners),
        (real_train, fake, both))))
