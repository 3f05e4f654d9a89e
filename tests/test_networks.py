import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from annograph.functions import numerics
from annograph.operators import neighbourhood as nb
from annograph.operators import statistics as st
from annograph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["edges_nation", "vec_out_in", "vec_policy_null", "spec_div", "top_m_partners", "nhood_overlap", "dendro_stats", "bh_adjusted", "factorised"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in TABLES:
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


def _rows(df):
    cols = sorted(df.columns)
    df = df[cols].astype(object)
    return sorted(repr(tuple(None if v is None or v != v else v for v in r)) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    assert _rows(catalog.QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(catalog.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partners_by_hand(spark):
    e = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("x", "b", 3.0), ("x", "c", 4.0)], "pre string, post string, weight double")
    got = [(r.id, r.total_weight) for r in nb.top_partners(e, 3).where("ego = 'x'").orderBy("rn").collect()]
    assert got == [("b", 5.0), ("c", 4.0), ("a", 1.0)]
    assert {r.id for r in nb.top_partners(e, 3, legacy_left=True).where("ego = 'x'").collect()} == {"b", "c"}


def test_planted_isomorphism():
    rng = np.random.default_rng(0)
    b = (rng.random((20, 20)) < 0.3) * rng.integers(1, 9, (20, 20)).astype(float)
    p = rng.permutation(20)
    assert numerics.graph_distance(b[np.ix_(p, p)], b, numerics.match_graphs(b[np.ix_(p, p)], b))["fnorm"] == 0


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for _ in range(20):
        c = rng.random((5, 5))
        assert np.isclose(c[np.arange(5), numerics.assign(c)].sum(), min(c[np.arange(5), list(p)].sum() for p in permutations(range(5))))


def test_ward_heights():
    x = np.array([[0.0], [1.0], [5.0], [6.0]])
    z = numerics.linkage(x)
    assert np.allclose(z[:, 2], [1, 1, np.sqrt(50)])
    assert numerics.flat_clusters(z, 2.0).tolist() in ([0, 0, 1, 1], [1, 1, 0, 0])


def test_louvain_and_statistics():
    w = np.zeros((6, 6))
    for a, b in ((0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)):
        w[a, b] = w[b, a] = 1
    own = numerics.louvain(w)
    assert len(set(own[:3])) == 1 and len(set(own[3:])) == 1 and own[0] != own[5]
    assert numerics.betweenness([[1], [0, 2], [1]]).tolist() == [0, 1, 0]
    assert abs(numerics.correlation_pvalue(0.5, 10) - 0.1411) < 1e-3
    u, p = numerics.rank_sum_less(np.array([1.0, 2, 3]), np.array([4.0, 5, 6]))
    assert u == 0 and p < 0.06


def test_path_betweenness_of_current():
    path = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], float)
    assert np.allclose(numerics.current_flow_betweenness(path), [0, 1, 0])


def test_all_embeddings(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert n > 200
    assert catalog.QUERIES["ward_linkage"](spark, SF).count() == n - 1
    assert catalog.QUERIES["average_linkage"](spark, SF).count() == n - 1
    assert catalog.QUERIES["fcluster_cut"](spark, SF).count() == n


def test_ward_of_centroids():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 6)), rng.normal(3, 1, (50, 6))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    assert np.allclose(numerics.linkage(x), numerics.linkage(d, "ward", condensed=True))
    assert np.allclose(numerics.linkage(np.ones((9, 2)))[:, 2], 0)


def test_shuffled_silhouette(spark):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(300, 3)), np.array([0, *[1] * 99, *[2] * 200])
    rows = spark.createDataFrame([(k, int(label[k]), x[k].tolist()) for k in range(300)], "id long, label int, x array<double>")
    got = {r.seed: r.s for r in st.shuffled_silhouette(rows, 5, block=64, chunk=2).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for seed in range(5):
        own, s = np.random.default_rng(seed).permutation(label), []
        for i in range(300):
            m = {k: d[i, (own == k) & (np.arange(300) != i)] for k in range(3)}
            a, b = m[own[i]], min(m[k].mean() for k in range(3) if k != own[i])
            s.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0)
        assert np.isclose(got[seed], np.mean(s))


def test_all_pairs_of_graphs_match(spark):
    n = catalog.QUERIES["ego_graphs"](spark, SF).count()
    assert n > 10
    for name in ("graph_match", "ego_match"):
        assert catalog.QUERIES[name](spark, SF).select("id_1", "id_2").distinct().count() == n * (n - 1) // 2
