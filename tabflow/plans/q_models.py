"""Queries that involve trained models (E, F4-F11, G11-G17): rows-only checks.

Small settings (few levels, copies, trees) keep each query within tens of
seconds; every query trains on the whole table it names.  A fitted model is
kept per (application, data folder, configuration) so queries that share a
model do not refit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.noise import hash_uniform
from ..learners import flows
from ..learners.hist_boost import BoostParams
from ..learners.mllib import RandomForestSampler
from ..metrics import experiment, scores, utility
from ..sampling import draws
from ..session import KEPT
from ..sources.registry import load_dataset
from ..spec import ColumnSpec, TableSpec
from .q_basic import customer_blanked
from .registry import query

SMALL = dict(n_t=5, K=2, n_bins=32)
REG = BoostParams(n_rounds=4, depth=3, eta=0.3, lam=0.0)
CLF = BoostParams(n_rounds=6, depth=3, eta=0.1, lam=0.0, objective="softmax")
_CACHE: dict = {}


def _cached(spark, sf, name, build):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def _orders(spark, sf):
    return load_dataset(spark, sf, "orders")


def fitted_seq(spark, sf, model_type="HS3F", **kw):
    def build():
        df, spec = _orders(spark, sf)
        fl = flows.SequentialFlow(model_type=model_type, reg=kw.get("reg", REG), clf=kw.get("clf", CLF),
                                  n_batch=kw.get("n_batch", 0), **SMALL)
        return fl.fit(df, spec)
    return _cached(spark, sf, f"seq-{model_type}-{sorted((k, repr(v)) for k, v in kw.items())}", build)


def fitted_joint(spark, sf):
    def build():
        df, spec = _orders(spark, sf)
        return flows.JointFlow(reg=REG, **SMALL).fit(df, spec)
    return _cached(spark, sf, "joint", build)


def _n_rows(spark, sf):
    return _cached(spark, sf, "n-orders", lambda: _orders(spark, sf)[0].count())


# ---- E: fitting ------------------------------------------------------------------

@query("fit_velocity")
def q_fit_velocity(spark, sf):
    return flows.sequential_model_table(fitted_seq(spark, sf)).where(F.col("kind") == "velocity")


@query("fit_category")
def q_fit_category(spark, sf):
    """E2 at the reference settings: 100 + 15 trees of depth 7, rate 0.1, K = 100 copies, 64 bins (the levels of time do
    not enter a classifier)."""
    def build():
        return flows.SequentialFlow(model_type="HS3F").fit(*_orders(spark, sf), kinds=("category",))
    return flows.sequential_model_table(_cached(spark, sf, "category", build)).where(F.col("kind") == "category")


@query("fit_joint_velocity")
def q_fit_joint_velocity(spark, sf):
    return flows.joint_model_table(fitted_joint(spark, sf), spark)


@query("fit_joint_velocity_missing")
def q_fit_joint_velocity_missing(spark, sf):
    def build():
        cb = customer_blanked(spark, sf).withColumnRenamed("c_custkey", "row_id")
        spec = TableSpec.of(ColumnSpec("c_acctbal", "continuous"), ColumnSpec("c_nationkey", "integer"),
                            ColumnSpec("c_mktsegment", "categorical", "label"))
        cb = cb.where(F.col("c_mktsegment").isNotNull())  # the label may not be missing (B4)
        return flows.JointFlow(reg=REG, **SMALL).fit(cb, spec)
    return flows.joint_model_table(_cached(spark, sf, "joint-missing", build), spark)


def fitted_rf(spark, sf):
    def build():
        df, spec = _orders(spark, sf)
        return RandomForestSampler(n_t=5, K=2, num_trees=10, max_depth=5).fit(df, spec)
    return _cached(spark, sf, "rf", build)


@query("fit_random_forest")
def q_fit_random_forest(spark, sf):
    return fitted_rf(spark, sf).summary(spark)


@query("random_forest_generate")
def q_random_forest_generate(spark, sf):
    return fitted_rf(spark, sf).sample(_n_rows(spark, sf), seed=1)


@query("fit_minibatch")
def q_fit_minibatch(spark, sf):
    clf = BoostParams(n_rounds=4, depth=3, eta=0.1, lam=0.0, objective="softmax")
    return flows.sequential_model_table(fitted_seq(spark, sf, n_batch=2, clf=clf))


@query("label_conditional_fit")
def q_label_conditional_fit(spark, sf):
    t = flows.sequential_model_table(fitted_seq(spark, sf))
    return t.groupBy("kind", "feature", "label").agg(F.count(F.lit(1)).cast("long").alias("n_trees"))


@query("extra_learner_params")
def q_extra_learner_params(spark, sf):
    reg = BoostParams(n_rounds=3, depth=2, eta=0.2, lam=1.0, min_child_weight=2.0)
    return flows.sequential_model_table(fitted_seq(spark, sf, reg=reg))


# ---- F: generation ----------------------------------------------------------------

@query("velocity_eval")
def q_velocity_eval(spark, sf):
    return flows.velocity_frame(fitted_seq(spark, sf), 0, 2)


@query("euler_integrate")
def q_euler_integrate(spark, sf):
    return fitted_seq(spark, sf).raw_sample(_n_rows(spark, sf), seed=1, solver="euler")


@query("rk4_integrate")
def q_rk4_integrate(spark, sf):
    return fitted_seq(spark, sf).raw_sample(_n_rows(spark, sf), seed=1, solver="rk4")


@query("joint_euler_integrate")
def q_joint_euler_integrate(spark, sf):
    return fitted_joint(spark, sf).raw_sample(_n_rows(spark, sf), seed=1)


@query("sequential_generate", headline=True)
def q_sequential_generate(spark, sf):
    return fitted_seq(spark, sf).sample(_n_rows(spark, sf), seed=1, solver="euler")


@query("sequential_generate_rk4")
def q_sequential_generate_rk4(spark, sf):
    return fitted_seq(spark, sf).sample(_n_rows(spark, sf), seed=1, solver="rk4")


@query("sequential_generate_cs3f")
def q_sequential_generate_cs3f(spark, sf):
    return fitted_seq(spark, sf, "CS3F").sample(_n_rows(spark, sf), seed=1, solver="euler")


@query("sequential_generate_cs3f_rk4")
def q_sequential_generate_cs3f_rk4(spark, sf):
    return fitted_seq(spark, sf, "CS3F").sample(_n_rows(spark, sf), seed=1, solver="rk4")


@query("joint_generate")
def q_joint_generate(spark, sf):
    return fitted_joint(spark, sf).sample(_n_rows(spark, sf), seed=1)


@query("flow_impute_step")
def q_flow_impute_step(spark, sf):
    df, _ = _orders(spark, sf)
    blank = df.withColumn("o_totalprice", F.when(hash_uniform("impute", F.col("row_id")) < 0.1, F.lit(None))
                          .otherwise(F.col("o_totalprice")))
    return fitted_joint(spark, sf).impute(blank, seed=3)


# ---- G: utility and experiments ----------------------------------------------------

FEATS = ["o_totalprice", "o_orderpriority", "o_orderdate_days"]
CATS = ["o_orderpriority"]
TARGET = "o_orderstatus"
UP = utility.UtilityParams(max_iter=100, ada_rounds=5, forest_trees=20, forest_depth=8, boost_rounds=5,
                           boost_depth=3, seeds=1)
EXP_REG = BoostParams(n_rounds=3, depth=3, eta=0.3, lam=0.0)
EXP_CLF = BoostParams(n_rounds=4, depth=3, eta=0.1, lam=0.0, objective="softmax")
EXP = utility.UtilityParams(max_iter=100, ada_rounds=5, forest_trees=10, forest_depth=5, boost_rounds=3,
                            boost_depth=3, seeds=1)


def _split(spark, sf):
    """Real training and test rows; the split is made once, as every learner reads both sides many times."""
    def build():
        df, _ = _orders(spark, sf)
        return draws.train_test_split(df, "row_id", 0, 0.2, stratify=TARGET).persist(KEPT)
    s = _cached(spark, sf, "split", build)
    return s.where(F.col("is_test") == 0).drop("is_test"), s.where(F.col("is_test") == 1).drop("is_test")


def _four_scores(spark, sf):
    """G15 on the real split, computed once per application and data folder."""
    def build():
        tr, te = _split(spark, sf)
        return utility.score_four_models(tr, te, FEATS, CATS, TARGET, True, UP)
    return _cached(spark, sf, "four-scores", build)


def _predict_query(learner):
    """Predictions of one learner on the held-out rows, as (truth, prediction, n) of class codes."""
    def fn(spark, sf):
        tr, te = _split(spark, sf)
        tr, te, classes, cols = utility.prepare_parts(tr, te, FEATS, CATS, TARGET, True)
        (p,) = utility.predictions(learner, tr, [te], cols, True, len(classes), UP)
        return scores.confusion_counts(p, "label", "prediction")
    return fn


for _name, _learner in (("predict_linear", "lin"), ("predict_adaboost", "linboost"),
                        ("predict_forest", "tree"), ("predict_boosted", "treeboost")):
    query(_name)(_predict_query(_learner))


@query("score_four_models")
def q_score_four_models(spark, sf):
    s = _four_scores(spark, sf)
    return spark.createDataFrame([(k, float(v)) for k, v in s.items()], "learner string, f1 double")


def _fake(spark, sf, train):
    def build():
        _, spec = _orders(spark, sf)
        fit = flows.SequentialFlow(model_type="HS3F", reg=REG, clf=CLF, **SMALL).fit(train, spec)
        return fit, fit.sample(train.count(), seed=5)
    return _cached(spark, sf, "fake-train", build)


def _utility(spark, sf):
    """G16 once per application and data folder (the real side reuses G15)."""
    def build():
        tr, te = _split(spark, sf)
        tr.count()

        def generated():
            _, fake = _fake(spark, sf, tr)
            fake_c = fake.cache()
            fake_c.count()
            both = tr.select(*FEATS, TARGET).unionByName(fake_c.select(*FEATS, TARGET))
            return utility.together(lambda t: utility.score_four_models(t, te, FEATS, CATS, TARGET, True, UP), (fake_c, both))
        real, (fake, comb) = utility.together(lambda f: f(), (lambda: _four_scores(spark, sf), generated))
        return {"real": real, "fake": fake, "comb": comb}
    return _cached(spark, sf, "utility", build)


@query("utility_real_fake_both")
def q_utility_real_fake_both(spark, sf):
    res = _utility(spark, sf)
    rows = [(side, k, float(v)) for side, d in res.items() for k, v in d.items()]
    return spark.createDataFrame(rows, "side string, learner string, f1 double")


@query("run_experiment")
def q_run_experiment(spark, sf):
    """All five methods, three splits, five generated sets of each, four learners on real, generated and
    both; the models keep the small settings of this module."""
    df, spec = _orders(spark, sf)
    e = experiment.Experiment(nexp=3, ngen=5, flow={**SMALL, "reg": EXP_REG}, clf=EXP_CLF, scoring=EXP)
    return experiment.summarize(experiment.run(df, spec, "orders", e=e))
