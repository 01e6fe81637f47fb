"""Readers, writers, the build-or-load stage, and plan shapes."""

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rankloom.catalog.queries import REGISTRY
from rankloom.catalog.study import Study
from rankloom.operators.retrieval import top_k
from rankloom.schemas import HISTORY_CONFIG
from rankloom.session import Workspace, path_status, publish, published, shared_folder
from rankloom.sources import tables
from rankloom.sources.pairs import (
    drop_incomplete,
    ingest_tsv_pairs,
    read_ingested_pairs,
    read_tsv_pairs,
    write_tsv_pairs,
)

SF = "/root/testdata/sf0.001"


def test_tsv(spark, tmp_path):
    path = tmp_path / "train.tsv"
    path.write_text('context\tresponse\n"he said ""hi""\nthere"\tNA\nplain\t\nx\ty\n')
    pairs = read_tsv_pairs(spark, {"train": f"file:{path}"})
    complete, dropped = drop_incomplete(pairs)
    assert {tuple(r) for r in complete.collect()} == {("train", 'he said "hi"\nthere', "NA"), ("train", "x", "y")}
    assert [tuple(r) for r in dropped.collect()] == [("train", 1)]


def test_tsv_round_trip(spark, tmp_path):
    rows = [('a\t"b"', "c\nd"), ("é", "NA"), ("", "x")]
    df = spark.createDataFrame(rows, "context string, response string")
    write_tsv_pairs(df, f"file:{tmp_path}/out")
    got = read_tsv_pairs(spark, {"s": f"file:{tmp_path}/out"}).select("context", "response")
    assert {tuple(r) for r in got.collect() if r.context} == {r for r in rows if r[0]}


def test_missing_inputs(spark, tmp_path):
    with pytest.raises(ValueError, match="not found"):
        read_tsv_pairs(spark, {"train": f"file:{tmp_path}/none.tsv"})
    (tmp_path / "bad.tsv").write_text("context\treply\na\tb\n")
    with pytest.raises(ValueError, match="response"):
        read_tsv_pairs(spark, {"train": f"file:{tmp_path}/bad.tsv"})
    with pytest.raises(ValueError, match="not found"):
        tables.read_training_table(spark, f"file:{tmp_path}/none")


def test_build_or_load(spark, tmp_path):
    ws = Workspace(spark, f"file:{tmp_path}/ws")
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert [ws.build_or_load("t", {"n": n}, lambda n=n: build(n)).count() for n in (3, 3, 5)] == [3, 3, 5]
    assert built == [3, 5]
    assert Workspace(spark, f"file:{tmp_path}/ws").build_or_load("t", {"n": 5}, lambda: build(5)).count() == 5
    assert built == [3, 5]


def test_two_builders_read_one_whole_table(spark, tmp_path):
    ready = threading.Barrier(4)

    def build(i):
        def rows():
            ready.wait(60)  # nobody has published when the last one begins to write
            return spark.range(1000).withColumn("builder", F.lit(i))

        return Workspace(spark, f"file:{tmp_path}/ws").build_or_load("t", {"n": 1}, rows).groupBy("builder").count().collect()

    with ThreadPoolExecutor(4) as pool:
        seen = {tuple(map(tuple, rows)) for rows in pool.map(build, range(4))}
    assert len(seen) == 1 and next(iter(seen))[0][1] == 1000
    assert len(list(tmp_path.glob("ws/t-*/attempt=*"))) == 1


def test_half_written_table_is_not_read(spark, tmp_path):
    def dies(out):
        spark.range(5).write.parquet(out)
        raise RuntimeError("killed")

    path = f"file:{tmp_path}/t"
    with pytest.raises(RuntimeError):
        publish(spark, path, dies)
    assert published(spark, path) is None
    kept = publish(spark, path, lambda out: spark.range(3).write.parquet(out))
    assert published(spark, path) == kept and spark.read.parquet(kept).count() == 3


def test_source_changes_are_noticed(spark, tmp_path):
    path = f"file:{tmp_path}/data"
    spark.range(3).write.parquet(path)
    before = path_status(spark, path)
    spark.range(9).write.mode("append").parquet(path)
    assert path_status(spark, path) != before
    assert path_status(spark, f"file:{tmp_path}/none") is None


def test_shared_folder_follows_the_cluster(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    else:
        assert shared_folder(spark).startswith("file:")


def test_ledger_appends(spark, tmp_path):
    path = f"file:{tmp_path}/ledger"
    row = [("d", "BM25", "BM25", "ls", "step", 1.0, 1.0, 0.2, 0, 0.5)]
    for seed in (0, 1):
        df = spark.createDataFrame(row, tables.LEDGER).withColumn("seed", F.lit(seed))
        tables.append_results(df, path)
    got = tables.read_results(spark, path).orderBy("seed").collect()
    assert [(r.seed, r.r10_at_1) for r in got] == [(0, 0.5), (1, 0.5)]


def test_a_run_is_added_once_and_whole(spark, tmp_path, monkeypatch):
    path = f"file:{tmp_path}/ledger"
    row = spark.createDataFrame([("d", "BM25", "BM25", "ls", "step", 1.0, 1.0, 0.2, 0, 0.5)], tables.LEDGER)
    assert tables.read_results(spark, path).count() == 0
    for run in ("a", "a", "b", "a"):
        tables.append_results(row, path, run)
    assert tables.read_results(spark, path).count() == 2

    def killed(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr("rankloom.session._put_if_absent", killed)
        with pytest.raises(RuntimeError):
            tables.append_results(row, path, "c")
    assert tables.read_results(spark, path).count() == 2
    tables.append_results(row, path, "c")
    assert tables.read_results(spark, path).count() == 3


def test_one_split_is_rebuilt_alone(spark, tmp_path):
    names = [*tables.TRAINING_COLUMNS, "method"]
    rows = spark.createDataFrame(
        [(s, f"q{i}", "a", f"d{i}", "b", 0.5, 1, 10, "BM25") for s in ("train", "valid") for i in range(3)], names
    )
    tables.write_training_table(rows, f"file:{tmp_path}/t")
    before = sorted(tmp_path.glob("t/split=train/*/*.parquet"))
    tables.replace_training_parts(rows.filter("split = 'valid' AND qid <> 'q0'"), f"file:{tmp_path}/t")
    assert sorted(tmp_path.glob("t/split=train/*/*.parquet")) == before
    got = tables.read_training_table(spark, f"file:{tmp_path}/t").groupBy("split").count().collect()
    assert {tuple(r) for r in got} == {("train", 3), ("valid", 2)}


def test_training_table_prunes_folders(spark, ws):
    stored = REGISTRY["src_training_table"](spark, SF)
    plan = stored._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "method" in plan.split("PartitionFilters: [")[1].split("]")[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("docno"), F.rand(1).alias("score"))
    plan = plan_of(top_k(df, ["g"], 2))
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize(
    "name",
    ["neg_random", "split_by_query", "training_plan", "smooth_weak", "grid_runs", "r10_at_1", "idx_term_stats", "eps_beta_general", "bm25_topk"],
)
def test_plans_stay_on_the_jvm_without_cross_joins(spark, ws, name):
    plan = plan_of(REGISTRY[name](spark, SF))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_entry(spark, ws):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["split", "qid", "query", "docno", "text", "score", "label", "pos"]
    assert df.filter("label = 1").count() == 34


def test_ingest_keeps_complete_rows_by_split(spark, tmp_path):
    for name in ("train", "test"):
        (tmp_path / f"{name}.tsv").write_text(f"context\tresponse\n{name} a\tb\nplain\t\n")
    paths = {n: f"file:{tmp_path}/{n}.tsv" for n in ("train", "test")}
    got = ingest_tsv_pairs(spark, paths, f"file:{tmp_path}/pairs")
    assert {tuple(r) for r in got.collect()} == {("train", "train a", "b"), ("test", "test a", "b")}
    assert got.columns == ["split", "context", "response"]
    with pytest.raises(ValueError):
        read_ingested_pairs(spark, f"file:{tmp_path}/none")


def test_history_is_found_by_its_configuration(spark, tmp_path):
    path = f"file:{tmp_path}/history"
    for eps in (0.2, 0.4):
        rows = [(0, eps, eps, "train", "c", "BM25", "ls", "step", 1.0, 1.0, eps, 3)]
        names = ["instances_vues", "loss", "epsilon", *HISTORY_CONFIG.fieldNames()]
        tables.write_history(spark.createDataFrame(rows, names), path)
    got = tables.read_history(spark, path).filter("eps = 0.4 AND train_method = 'BM25' AND split = 'train'").collect()
    assert [(r.loss, r.seed) for r in got] == [(0.4, 3)]
    with pytest.raises(ValueError):
        tables.write_history(spark.createDataFrame([(0, 0.1, 0.1)], names[:3]), path)


def test_closed_workspace_drops_what_it_staged(spark, tmp_path):
    with Workspace(spark, f"file:{tmp_path}/ws") as own:
        own.stage(spark.range(3), "rows")
        kept = own.build_or_load("kept", {"a": 1}, lambda: spark.range(2))
        assert path_status(spark, f"file:{tmp_path}/ws")["files"] > 2
    assert kept.count() == 2 and not any(p.name.startswith("rows") for p in (tmp_path / "ws").iterdir())


def test_pairs_are_read_once(spark, tmp_path):
    Workspace.use(spark, f"file:{tmp_path}/pairs-once")
    s = Study(spark, SF)
    first = s.pairs._jdf.queryExecution().executedPlan().toString()
    assert "conversations" not in first and "pairs-" in first
    negatives = REGISTRY["neg_random"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "conversations.parquet" not in negatives
