"""Every registered query that has a SQL twin returns the twin's rows."""

import pytest
from compare import duck, mismatch

from rankloom.catalog.oracle import ORACLE
from rankloom.catalog.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_twin(spark, ws, con, name):
    assert mismatch(REGISTRY[name](spark, SF).toPandas(), con.execute(ORACLE[name]).df()) is None


def test_only_model_queries_lack_a_twin():
    assert set(REGISTRY) - set(ORACLE) == {"ranker_fit", "ranker_scores", "cross_method_eval"}
    assert set(ORACLE) <= set(REGISTRY)


def test_model_queries(spark, ws):
    fitted = {r.feature: r.coefficient for r in REGISTRY["ranker_fit"](spark, SF).collect()}
    assert set(fitted) == {"intercept", "bm25", "tf_idf", "overlap", "length_ratio"}
    cells = REGISTRY["cross_method_eval"](spark, SF).collect()
    assert len(cells) == 4
    assert all(0 <= c.n_correct <= c.n_queries and c.r10_at_1 == round(c.n_correct / c.n_queries, 6) for c in cells)
