"""Train and test tables of a method: written once, in one pass, with every row of the method's table."""

import hashlib
import random
from pathlib import Path

from pyspark.sql import functions as F

from rankloom.catalog.study import Study
from rankloom.functions.ordering import shuffled_positions
from rankloom.session import Workspace
from rankloom.sources.tables import read_training_table


def test_sides_are_written_once(spark, tmp_path):
    rng = random.Random(4)
    says = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    turns = [(c, t, "assistant" if t % 2 else "user", says(200 if t % 2 else 8)) for c in range(60) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    with Workspace.use(spark) as ws:
        study = Study(spark, str(tmp_path))
        paths = study.side_tables("random")
        staged = len(ws._staged)
        assert study.side_tables("random") == paths and len(ws._staged) == staged
        assert not any("text" in spark.read.parquet(path).columns for path in ws._staged)
        sides = {side: read_training_table(spark, path) for side, path in paths.items()}
        assert {s: d.select("qid").distinct().count() for s, d in sides.items()} == {"train": 108, "test": 12}
        columns = ["split", "qid", "query", "docno", "text", "score", "label", "pos"]
        both = sides["train"].unionByName(sides["test"])
        assert both.columns == [c for c in columns if c != "split"] + ["split", "method"]
        key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
        assert key(both) == key(study.table("random")) and both.filter("method = 'random'").count() == 1200
        # Ten groups hold a document's text; on storage it takes the room of few.
        texts = study.rel.corpus.agg(F.sum(F.length("text"))).first()[0]
        assert sum(Path(f.removeprefix("file:")).stat().st_size for f in both.inputFiles()) < 5 * texts


def test_positions_follow_the_digits_and_shuffle_bytes(spark):
    keys = [f"k{i}" for i in range(300)]
    df = spark.createDataFrame([("g", k) for k in keys] + [("h", k) for k in keys[:7]], "g string, k string")
    for prefix in (1, 3, 4):
        numbered = shuffled_positions(df, ["k"], [5], ["g"], prefix=prefix)
        for group, members in (("g", keys), ("h", keys[:7])):
            want = sorted(members, key=lambda k: hashlib.md5(f"5-{k}".encode()).hexdigest())
            assert [r.k for r in sorted(numbered.filter(F.col("g") == group).collect(), key=lambda r: r.position)] == want
    plan = numbered._jdf.queryExecution().analyzed()
    types = {a.name(): a.dataType().sql() for a in [plan.inputSet().toSeq().apply(i) for i in range(plan.inputSet().size())]}
    assert types["_digest"] == "BINARY" and types["_slice"] == "BIGINT"
