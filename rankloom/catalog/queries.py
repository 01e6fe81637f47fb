"""One registered query per operator: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import smoothing as sm
from ..functions.ordering import sequential_ids
from ..operators import encoding, evaluation, lexical, ranker, splits
from ..operators import negatives as neg
from ..operators import relations as rel
from ..operators.retrieval import TfIdf, retrieve, score_pairs
from ..plans import grids
from ..plans.fitting import Fit, fit_history, fit_on_plan
from ..plans.training import history, plan_targets, training_plan
from ..session import Workspace
from ..sources import tables
from ..sources.pairs import conversation_pairs, drop_incomplete, read_tsv_pairs, write_tsv_pairs
from .study import BATCH, EPOCHS, EPS, K, SEED, Study

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

VOCABULARY = 8000
MAX_LEN = 256


def query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain(build(Study(spark, sf_dir)))

    REGISTRY[build.__name__] = run
    return build


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines return the same types."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def r6(value: Column | str, name: str | None = None) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col, 6).alias(name or value)


# -- sources and sinks ------------------------------------------------------------------------------------------


@query
def src_tsv_pairs(s: Study) -> DataFrame:
    path = s.ws.new_path("pairs-tsv")
    write_tsv_pairs(conversation_pairs(s.spark, s.sf_dir).select("context", "response"), path)
    complete, _ = drop_incomplete(read_tsv_pairs(s.spark, {"all": path}))
    return complete


@query
def split_pairs(s: Study) -> DataFrame:
    return conversation_pairs(s.spark, s.sf_dir, by_split=True)


def _stored_table(s: Study) -> str:
    path = s.ws.new_path("training")
    both = [s.table(m).withColumn("method", F.lit(m)) for m in grids.METHODS]
    tables.write_training_table(both[0].unionByName(both[1]), path)
    return path


@query
def src_training_table(s: Study) -> DataFrame:
    return tables.read_training_table(s.spark, _stored_table(s)).filter("split = 'all' AND method = 'BM25'")


@query
def snk_training_table(s: Study) -> DataFrame:
    stored = tables.read_training_table(s.spark, _stored_table(s))
    return stored.groupBy("split", "method").agg(
        F.count("*").alias("n_rows"), F.sum("label").alias("n_relevant"), r6(F.sum("score"), "sum_score")
    )


@query
def snk_memoised_stage(s: Study) -> DataFrame:
    """The second request loads what the first has built; another ``k`` is built anew."""

    def lengths(minimum: int) -> DataFrame:
        sized = lexical.document_lengths(lexical.corpus_vectors(s.rel.corpus))
        return sized.filter(F.col("dl") >= minimum)

    found = []
    for minimum in (1, 1, 50):
        mark = {"source": s.source, "minimum": minimum}
        found.append(s.ws.build_or_load("document-lengths", mark, lambda m=minimum: lengths(m)))
    parts = [
        df.groupBy("split").agg(F.lit(i).alias("request"), F.count("*").alias("n"), F.sum("dl").alias("n_tokens"))
        for i, df in enumerate(found)
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def snk_results_ledger(s: Study) -> DataFrame:
    path = s.ws.new_path("ledger")
    for method in grids.METHODS:
        r10 = evaluation.r10_at_1(s.scored(method))
        tables.append_results(
            r10.select(
                F.lit("conversations").alias("dataset"),
                F.lit("none").alias("train_method"),
                F.lit(method).alias("test_method"),
                F.lit("baseline").alias("mode"),
                F.lit("step").alias("decay"),
                F.lit(1.0).alias("alpha"),
                F.lit(1.0).alias("beta"),
                F.lit(0.0).alias("eps"),
                F.lit(0).alias("seed"),
                F.round("r10_at_1", 4).alias("r10_at_1"),
            ),
            path,
            run=method,
        )
    return tables.read_results(s.spark, path)


@query
def snk_history(s: Study) -> DataFrame:
    path = s.ws.new_path("history")
    settings = {
        "dataset": "conversations", "train_method": "BM25", "mode": "twsls", "decay": "step",
        "alpha": 1.0, "beta": 1.0, "eps": EPS, "seed": SEED,
    }
    tables.write_history(_history(s).withColumns({k: F.lit(v) for k, v in settings.items()}), path)
    return tables.read_history(s.spark, path)


# -- relations --------------------------------------------------------------------------------------------------


@query
def pairs_to_relations(s: Study) -> DataFrame:
    return s.identified


@query
def row_ids(s: Study) -> DataFrame:
    numbered = sequential_ids(s.ws, s.pairs.select("split", "conv_id", "turn"), ["split", "conv_id", "turn"])
    number = F.col("row_no").cast("string")
    return numbered.select(
        "split", "conv_id", "turn", F.concat(F.lit("q"), number).alias("qid"), F.concat(F.lit("d"), number).alias("docno")
    )


@query
def rel_queries(s: Study) -> DataFrame:
    return s.rel.queries


@query
def rel_corpus(s: Study) -> DataFrame:
    return s.rel.corpus


@query
def rel_qrels(s: Study) -> DataFrame:
    return s.rel.qrels


@query
def clean_query(s: Study) -> DataFrame:
    return rel.clean_queries(s.rel.queries)


@query
def ground_truth(s: Study) -> DataFrame:
    return rel.ground_truth(s.rel.queries, s.rel.qrels)


@query
def qrels_violations(s: Study) -> DataFrame:
    return rel.qrels_violations(s.rel.queries, s.rel.qrels)


# -- index and retrieval ----------------------------------------------------------------------------------------


@query
def tokens(s: Study) -> DataFrame:
    return lexical.corpus_tokens(s.rel.corpus)


@query
def idx_postings(s: Study) -> DataFrame:
    return lexical.postings(lexical.corpus_vectors(s.rel.corpus))


@query
def idx_doc_len(s: Study) -> DataFrame:
    return lexical.document_lengths(lexical.corpus_vectors(s.rel.corpus))


@query
def idx_term_stats(s: Study) -> DataFrame:
    return lexical.term_statistics(lexical.corpus_vectors(s.rel.corpus))


@query
def idx_corpus_stats(s: Study) -> DataFrame:
    return lexical.corpus_statistics(lexical.corpus_vectors(s.rel.corpus)).withColumn("avgdl", r6("avgdl"))


@query
def library_term_stats(s: Study) -> DataFrame:
    return lexical.term_statistics(lexical.corpus_vectors(s.library.corpus))


@query
def library_topk(s: Study) -> DataFrame:
    return retrieve(s.ws, s.library_index, s.library.queries, k=K + 1)


@query
def bm25_topk(s: Study) -> DataFrame:
    return retrieve(s.ws, s.index, s.rel.queries, k=K)


@query
def bm25_topk_pruned(s: Study) -> DataFrame:
    """The same hits with one more retrieved and cut again: a longer list begins with the shorter one."""
    return retrieve(s.ws, s.index, s.rel.queries, k=K + 1).filter(F.col("rank") <= K)


@query
def bm25_scores(s: Study) -> DataFrame:
    """Raw scores of the pairs that any later step looks at: the groups' negatives and relevant documents."""
    pairs = s.groups("BM25").unionByName(s.groups("random")).select("split", "qid", "docno").distinct()
    return score_pairs(s.ws, s.index, s.rel.queries, pairs).select("split", "qid", "docno", "score")


@query
def tfidf_scores(s: Study) -> DataFrame:
    return retrieve(s.ws, s.index, s.rel.queries, TfIdf(), k=K)


@query
def minmax_scores(s: Study) -> DataFrame:
    return neg.min_max(retrieve(s.ws, s.index, s.rel.queries, k=K)).select("split", "qid", "docno", "score")


# -- negatives, groups, splits ----------------------------------------------------------------------------------


@query
def neg_bm25(s: Study) -> DataFrame:
    negatives = neg.lexical_negatives(s.ws, s.index, s.rel.queries, s.rel.qrels, K)
    return negatives.join(s.rel.corpus, ["split", "docno"], "left")


@query
def neg_bm25_exact_k(s: Study) -> DataFrame:
    return neg.lexical_negatives(s.ws, s.index, s.rel.queries, s.rel.qrels, K, refill=True)


@query
def neg_random(s: Study) -> DataFrame:
    return neg.random_negatives(s.rel.queries, s.rel.qrels, s.rel.corpus, K, SEED, positions=s.positions)


@query
def neg_random_sentinel(s: Study) -> DataFrame:
    queries, corpus, qrels = s.rel
    return neg.random_negatives(queries, qrels, corpus, K, SEED, random_score=sm.NO_SCORE, positions=s.positions)


@query
def training_bm25(s: Study) -> DataFrame:
    return s.table("BM25")


@query
def training_random(s: Study) -> DataFrame:
    return s.table("random")


@query
def split_by_query(s: Study) -> DataFrame:
    return splits.split_by_query(s.groups("BM25"), 0.9, SEED).select("split", "qid", "docno", "side")


@query
def split_by_query_hash(s: Study) -> DataFrame:
    return splits.split_by_query_hash(s.groups("BM25"), 0.9, SEED).select("split", "qid", "docno", "side")


@query
def split_summary(s: Study) -> DataFrame:
    return splits.split_summary(splits.split_by_query(s.groups("BM25"), 0.9, SEED))


@query
def training_by_split(s: Study) -> DataFrame:
    """Train, valid and test to the stored table in one job, each with its own corpus."""
    return s.table_by_split().drop("method")


@query
def snk_sides(s: Study) -> DataFrame:
    """The training tables of both sides of the split by query, each read from its own path."""
    paths = s.side_tables("BM25")
    parts = [tables.read_training_table(s.spark, path).withColumn("side", F.lit(side)) for side, path in paths.items()]
    return reduce(DataFrame.unionByName, parts)


# -- smoothing, schedules, plan ---------------------------------------------------------------------------------


@query
def smooth_classic(s: Study) -> DataFrame:
    smoothed = sm.smooth_classic(F.col("label"), 0.4)
    return s.groups("BM25").select("split", "qid", "docno", "score", r6(smoothed, "label"))


@query
def smooth_weak(s: Study) -> DataFrame:
    """Weak smoothing of both kinds of groups; random negatives carry the no-score mark here."""
    marked = s.groups("random").withColumn(
        "score", F.when(F.col("label") == 1, F.col("score")).otherwise(sm.NO_SCORE)
    )
    both = s.groups("BM25").withColumn("method", F.lit("BM25")).unionByName(marked.withColumn("method", F.lit("random")))
    smoothed = sm.smooth_weak(F.col("label"), F.col("score"), 0.4)
    return both.select("split", "method", "qid", "docno", "score", r6(smoothed, "label"))


@query
def preview_smoothed(s: Study) -> DataFrame:
    smoothed = sm.smooth_weak(F.col("label"), F.col("score"), 0.4)
    return s.groups("BM25").orderBy("qid", "pos").limit(10).select("qid", "pos", "score", r6(smoothed, "label"))


@query
def smoothing_profile(s: Study) -> DataFrame:
    rows = s.groups("BM25").select(
        F.col("label").alias("label0"),
        sm.smooth_classic(F.col("label"), 0.4).alias("classic"),
        sm.smooth_weak(F.col("label"), F.col("score"), 0.4).alias("weak"),
    )
    return rows.groupBy("label0").agg(
        F.count("*").alias("n"),
        r6(F.avg("classic"), "avg_classic"),
        r6(F.min("weak"), "min_weak"),
        r6(F.max("weak"), "max_weak"),
        r6(F.avg("weak"), "avg_weak"),
    )


@query
def training_plan_rows(s: Study) -> DataFrame:
    return s.plan().select("split", "epoch", "batch", "seen", "total", "qid", "docno")


def _batches(s: Study) -> DataFrame:
    return s.plan().groupBy("split", "seen", "total").agg(F.count("*").alias("n_rows"))


def progress() -> Column:
    return F.col("seen") / F.col("total")


@query
def eps_by_mode(s: Study) -> DataFrame:
    modes = ("baseline", "ls", "classic", "twsls")
    return _batches(s).select(
        "split", "seen", "n_rows", *[r6(sm.epsilon(m, EPS, progress(), "linear"), f"eps_{m}") for m in modes]
    )


@query
def eps_schedules(s: Study) -> DataFrame:
    names = ("step", "linear", "exp", "cosine")
    return _batches(s).select("split", "seen", *[r6(sm.decayed(n, EPS, progress()), f"eps_{n}") for n in names])


@query
def eps_step_integer(s: Study) -> DataFrame:
    return _batches(s).select(
        "split", "seen", "total", r6(sm.step_by_instances(EPS, F.col("seen"), F.col("total")), "eps")
    )


@query
def eps_beta_integer(s: Study) -> DataFrame:
    profiles = ((1, 1), (5, 1), (1, 5), (3, 3))
    return _batches(s).select(
        "split", "seen", *[r6(sm.decayed("beta", EPS, progress(), a, b), f"eps_{a}_{b}") for a, b in profiles]
    )


@query
def eps_beta_general(s: Study) -> DataFrame:
    return _batches(s).select(
        "split",
        "seen",
        r6(sm.decayed("beta", EPS, progress(), 2.5, 1.5), "eps_a"),
        r6(sm.decayed("beta", EPS, progress(), 0.5, 0.5), "eps_b"),
    )


def _targets(s: Study) -> DataFrame:
    return plan_targets(s.plan(), "twsls", EPS, "step")


def _scored_targets(s: Study, mode: str, eps: float) -> DataFrame:
    return plan_targets(s.scored_plan(), mode, eps, "step")


@query
def plan_targets_rows(s: Study) -> DataFrame:
    return _targets(s).select("split", "epoch", "seen", "qid", "docno", r6("eps"), r6("target"))


@query
def batch_bce(s: Study) -> DataFrame:
    losses = history(_scored_targets(s, "baseline", 0.0))
    return losses.select("split", F.col("instances_vues").alias("seen"), r6("loss"))


def _history(s: Study) -> DataFrame:
    return history(_scored_targets(s, "twsls", EPS)).select("split", "instances_vues", r6("loss"), r6("epsilon"))


@query
def history_per_batch(s: Study) -> DataFrame:
    return _history(s)


# -- evaluation -------------------------------------------------------------------------------------------------


@query
def r10_at_1(s: Study) -> DataFrame:
    both = s.scored("BM25").withColumn("method", F.lit("BM25")).unionByName(
        s.scored("random").withColumn("method", F.lit("random"))
    )
    return evaluation.r10_at_1(both, ["split", "method"])


@query
def r10_batched(s: Study) -> DataFrame:
    """Queries in the order of their rows: conversation, then turn."""
    order = s.pairs.select("split", F.concat(F.lit("q"), F.concat_ws("_", "conv_id", "turn")).alias("qid"), "conv_id", "turn")
    return evaluation.r10_batched(s.ws, s.scored("BM25").join(order, ["split", "qid"]), order=("conv_id", "turn"))


@query
def group_size_audit(s: Study) -> DataFrame:
    return evaluation.group_sizes(s.groups("BM25"))


# -- grids ------------------------------------------------------------------------------------------------------


def _grid_sizes(s: Study, runs: list[grids.Run]) -> DataFrame:
    """Every run with the size of the training and test table it uses."""
    sizes = reduce(
        DataFrame.unionByName,
        [
            s.groups(m).agg(F.count("*").alias("n_rows"), F.countDistinct("split", "qid").alias("n_queries")).select(
                F.lit(m).alias("method"), "n_rows", "n_queries"
            )
            for m in grids.METHODS
        ],
    )
    train = sizes.select(F.col("method").alias("train_method"), F.col("n_rows").alias("n_train_rows"))
    test = sizes.select(F.col("method").alias("test_method"), F.col("n_queries").alias("n_test_queries"))
    # Both sides hold one row per method.
    return grids.attach_grid(train.withColumnRenamed("train_method", "_method"), runs).filter(
        "_method = train_method"
    ).drop("_method").join(F.broadcast(test), "test_method")


@query
def grid_runs(s: Study) -> DataFrame:
    return _grid_sizes(s, grids.main_grid())


@query
def grid_ablation(s: Study) -> DataFrame:
    return _grid_sizes(s, grids.ablation_grid())


def _both_methods(s: Study) -> DataFrame:
    return reduce(DataFrame.unionByName, [s.groups(m).withColumn("method", F.lit(m)) for m in grids.METHODS])


def _mean_targets(plans: DataFrame, runs: list[grids.Run]) -> DataFrame:
    """Mean target per run and label. A target is linear in label and score, so counts and score sums suffice.

    The data shrink to a row per batch, seed and label before the runs are joined.
    """
    marked = F.col("score") == sm.NO_SCORE
    sums = plans.groupBy("method", "plan_seed", "label", "seen", "total", marked.alias("marked")).agg(
        F.count("*").alias("n"), F.sum("score").alias("sum_score")
    )
    cells = sums.join(
        grids.grid_frame(plans.sparkSession, runs),
        (F.col("method") == F.col("train_method")) & (F.col("plan_seed") == F.col("seed")),
    )
    p = F.col("seen") / F.col("total")
    scheduled = [
        ((F.col("decay") == decay) & (F.col("alpha") == alpha) & (F.col("beta") == beta), sm.decayed(decay, F.col("eps"), p, alpha, beta))
        for decay, alpha, beta in grids.DECAY_PROFILES
    ]
    value = reduce(lambda acc, x: acc.when(*x), scheduled[1:], F.when(*scheduled[0]))
    eps = F.when(F.col("mode") == "baseline", 0.0).when(F.col("mode") == "ls", F.col("eps")).otherwise(value)
    kept = F.col("label") * F.col("n")
    total = F.when(F.col("marked"), kept.cast("double")).otherwise((1.0 - eps) * kept + eps * F.col("sum_score"))
    return cells.groupBy("train_method", "test_method", "mode", "decay", "alpha", "beta", "eps", "seed", "label").agg(
        F.sum("n").alias("n"), r6(F.sum(total) / F.sum("n"), "avg_target")
    )


@query
def grid_smoothing(s: Study) -> DataFrame:
    """The mean target over every run of the main grid, per original label."""
    both = _both_methods(s)
    seeded = both.withColumn("plan_seed", F.explode(F.array(*[F.lit(seed) for seed in grids.SEEDS])))
    plans = training_plan(
        seeded, BATCH, F.col("plan_seed").cast("string"), epochs=EPOCHS, group=["split", "method", "plan_seed"]
    )
    return _mean_targets(plans, grids.main_grid()).drop("decay", "alpha", "beta")


@query
def grid_ablation_smoothing(s: Study) -> DataFrame:
    """The same over the ablation grid with its beta profiles."""
    seeded = s.groups("BM25").withColumn("method", F.lit("BM25")).withColumn(
        "plan_seed", F.explode(F.array(*[F.lit(seed) for seed in grids.SEEDS]))
    )
    plans = training_plan(
        seeded, BATCH, F.col("plan_seed").cast("string"), epochs=EPOCHS, group=["split", "method", "plan_seed"]
    )
    return _mean_targets(plans, grids.ablation_grid())


# -- encoding and ranker ----------------------------------------------------------------------------------------


@query
def vocab(s: Study) -> DataFrame:
    return encoding.vocabulary(s.rel.queries, s.rel.corpus, VOCABULARY)


def _encoded(s: Study) -> DataFrame:
    known = s.ws.build_or_load(
        "vocabulary",
        {"source": s.source, "size": VOCABULARY},
        lambda: encoding.vocabulary(s.rel.queries, s.rel.corpus, VOCABULARY),
    )
    rows = s.groups("BM25").select("split", "qid", "docno", "label", "score")
    return encoding.encode_pairs(rows, s.rel.queries, s.rel.corpus, known, MAX_LEN)


@query
def pair_encoding(s: Study) -> DataFrame:
    return _encoded(s).select(
        "split",
        "qid",
        "docno",
        F.col("label").cast("double").alias("label"),
        "score",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"),
    )


@query
def truncation_profile(s: Study) -> DataFrame:
    return encoding.truncation_profile(_encoded(s))


def _featured(s: Study, method: str) -> DataFrame:
    mark = {"source": s.source, "method": method, "k": K, "seed": SEED, "features": ranker.FEATURES}
    return s.ws.build_or_load(
        "features", mark, lambda: ranker.pair_features(s.ws, s.index, s.rel.queries, s.groups(method))
    )


def _fitted(s: Study, method: str):
    """Fit on the train side, each row with the mean target it has over a scheduled run."""
    side = splits.split_by_query_hash(_featured(s, method), 0.8, SEED).filter("side = 'train'").drop("side")
    plan = training_plan(side, BATCH, SEED, epochs=EPOCHS)
    means = plan_targets(plan, "twsls", EPS, "step").groupBy("split", "qid", "docno", *ranker.FEATURES).agg(
        F.avg("target").alias("target")
    )
    return ranker.fit_ranker(s.ws, means)


def _held_out(s: Study, method: str) -> DataFrame:
    return splits.split_by_query_hash(_featured(s, method), 0.8, SEED).filter("side = 'test'").drop("side")


@query
def ranker_fit(s: Study) -> DataFrame:
    fitted = ranker.coefficients(_fitted(s, "BM25"), s.spark)
    return fitted.select("feature", r6("coefficient"))


@query
def ranker_scores(s: Study) -> DataFrame:
    scored = ranker.apply_ranker(_fitted(s, "random"), _held_out(s, "random"))
    return scored.select("split", "qid", "docno", "label", r6("logit"))


@query
def ranker_scores_given(s: Study) -> DataFrame:
    """Scores of held-out rows under given coefficients."""
    scored = ranker.apply_coefficients(ranker.GIVEN, _held_out(s, "random"))
    return scored.select("split", "qid", "docno", "label", r6("logit"))


@query
def method_eval_given(s: Study) -> DataFrame:
    """R_10@1 of the ranker with given coefficients on either method's held-out negatives."""
    parts = [
        ranker.apply_coefficients(ranker.GIVEN, _held_out(s, m)).withColumn("logit", r6("logit")).withColumn("method", F.lit(m))
        for m in grids.METHODS
    ]
    return evaluation.r10_at_1(reduce(DataFrame.unionByName, parts), ["split", "method"])


@query
def cross_method_eval(s: Study) -> DataFrame:
    """R_10@1 of the ranker fitted on one method's negatives and tested on another's."""
    models = {m: _fitted(s, m) for m in grids.METHODS}
    cells = [
        evaluation.r10_at_1(ranker.apply_ranker(models[train], _held_out(s, test))).select(
            F.lit(train).alias("train_method"), F.lit(test).alias("test_method"), "n_queries", "n_correct", "r10_at_1"
        )
        for train in grids.METHODS
        for test in grids.METHODS
    ]
    return reduce(DataFrame.unionByName, cells)


FIT_MODES = ("baseline", "ls", "twsls")
FIT_STEPS = 16


def _side_features(s: Study, method: str, side: str) -> DataFrame:
    """The stored table of one side with its pairs' features."""
    rows = tables.read_training_table(s.spark, s.side_tables(method)[side]).drop("query", "text")
    return rows.join(_featured(s, method).select("split", "qid", "docno", *ranker.FEATURES), ["split", "qid", "docno"])


def _fit_along_plan(s: Study, methods: tuple[str, ...], modes: tuple[str, ...]) -> Fit:
    """One pass trains every method and mode on the train side, batch order and schedule included."""
    rows = reduce(DataFrame.unionByName, [_side_features(s, m, "train") for m in methods])
    plan = s.ws.stage(training_plan(rows, BATCH, SEED, epochs=EPOCHS, group=["split", "method"]), "side-plan")
    runs = [plan_targets(plan, mode, EPS, "step").withColumn("mode", F.lit(mode)) for mode in modes]
    return fit_on_plan(s.ws, reduce(DataFrame.unionByName, runs), ranker.FEATURES, ["method", "mode"], FIT_STEPS)


@query
def ranker_fit_plan(s: Study) -> DataFrame:
    """Coefficients after a run of each mode: the schedule changes them."""
    fit = _fit_along_plan(s, ("BM25",), FIT_MODES)
    rows = [(*run, name, value) for run in fit.weights for name, value in fit.coefficients(run).items()]
    found = s.spark.createDataFrame(rows, "method string, mode string, feature string, coefficient double")
    return found.withColumn("coefficient", r6("coefficient"))


@query
def history_fitted(s: Study) -> DataFrame:
    """Per batch the loss of the model in training."""
    losses = fit_history(_fit_along_plan(s, ("BM25",), FIT_MODES))
    return losses.select("method", "mode", "instances_vues", r6("loss"), r6("epsilon"))


@query
def cross_table_eval(s: Study) -> DataFrame:
    """R_10@1 of models trained on one method's train table, on either method's test table."""
    fit = _fit_along_plan(s, grids.METHODS, ("twsls",))
    test = {m: _side_features(s, m, "test") for m in grids.METHODS}
    cells = [
        evaluation.r10_at_1(
            ranker.apply_coefficients(fit.coefficients((train, "twsls")), test[m]).withColumn("logit", r6("logit"))
        ).select(F.lit(train).alias("train_method"), F.lit(m).alias("test_method"), "n_queries", "n_correct", "r10_at_1")
        for train in grids.METHODS
        for m in grids.METHODS
    ]
    return reduce(DataFrame.unionByName, cells)


# The names used in the inventory.
for _name, _as in (
    ("training_plan_rows", "training_plan"),
    ("plan_targets_rows", "plan_targets"),
    ("history_per_batch", "history"),
):
    REGISTRY[_as] = REGISTRY.pop(_name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns to the labelled training table with lexical negatives."""
    Workspace.of(spark)
    return REGISTRY["training_bm25"](spark, sf_dir)
