"""Findings of the second round, each against a small case that failed before."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from annograph.functions import numerics
from annograph.operators import dendrogram as dg
from annograph.operators import dynamics as dy
from annograph.operators import statistics as st
from annograph.plans import catalog
from annograph.sources import text as tx


@pytest.fixture(scope="module")
def even(spark, tmp_path_factory):
    """Every pair of nations with the same weight: no edge is above the mean, so the sparse network is empty."""
    at = str(tmp_path_factory.mktemp("even"))
    pairs = spark.range(625)
    tables = {
        "customer": spark.range(25).selectExpr("id c_custkey", "int(id) c_nationkey"), "supplier": spark.range(25).selectExpr("id s_suppkey", "int(id) s_nationkey"),
        "orders": pairs.selectExpr("id o_orderkey", "id % 25 o_custkey"), "lineitem": pairs.selectExpr("id l_orderkey", "id div 25 l_suppkey", "1.0D l_quantity"),
    }
    for name, rows in tables.items():
        rows.write.parquet(f"{at}/{name}.parquet")
    return at


@pytest.mark.parametrize("name", ["pagerank_fixed", "centrality_columns", "centrality_table", "rank_embedding_clusters"])
def test_network_without_edges(spark, even, name):
    assert catalog.QUERIES[name](spark, even).count() == 0


@pytest.mark.parametrize("name", ["domain_split", "domain_split_best"])
def test_splits_of_a_large_brand(spark, tmp_path, name):
    """One brand of 3,000 parts: its 9 million cells are counted, not held."""
    size = np.random.default_rng(3).integers(1, 51, 3000)
    spark.createDataFrame(pd.DataFrame({"p_partkey": np.arange(3000) * 2, "p_brand": "b", "p_size": size.astype("int32")})).write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
    if name == "domain_split_best":
        assert len(got) == 1
        got = got.assign(cut=got["at"] - 1)
    else:
        assert sorted(got["cut"]) == list(range(1, 2999))
        got = got[got["cut"].isin([1, 1700])]
    v = np.abs(size[:, None] - size).astype(float)
    for r in got.itertuples():
        first, last = slice(None, r.cut), slice(r.cut + 1, None)
        within = np.concatenate([x[~np.eye(len(x), dtype=bool)] for x in (v[first, first], v[last, last])])
        u, p = numerics.rank_sum_less(within, np.tile(v[first, last].ravel(), 2))
        assert r.p == pytest.approx(p, rel=1e-9) and getattr(r, "u", u) == u


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["assembled_layers", "similarity_transforms", "length_similarity", "binarised"])
def test_pairs_spread_from_lists(spark, name):
    """Lists of ids are dealt and spread last, so no pair's row is moved, joined or worked out."""
    plan = _plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert plan.index("Generate") < plan.index("Repartition") and plan.count("Join ") == 2


def test_transforms_of_equal_sizes(spark, tmp_path):
    """Differences that are all 0 over a largest one of 0: not a number, as in SQL; a single part has no pair."""
    spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 5), (4, "c", 1), (5, "c", 3)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.i, r.j): (r.inv, r.ex) for r in catalog.QUERIES["similarity_transforms"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 2), (2, 1), (4, 5), (5, 4)} and got[4, 5] == (0.333333, 0.367879)
    assert got[1, 2][0] == 1 and np.isnan(got[1, 2][1])


@pytest.mark.parametrize("name", ["pairwise_distances", "square_distances"])
def test_distances_by_blocks(spark, name):
    """Vectors meet in blocks, once for both directions; no vector is joined with each other one."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_distances_by_hand(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 5))
    x[40] = x[3]
    rows = spark.createDataFrame([(k % 2, f"v{k}", x[k].tolist()) for k in range(90)], "label int, id string, x array<double>")
    for group in (None, "label"):
        got = {(r.id_1, r.id_2): r.d for r in st.distances(rows, group=group, block=16).collect()}
        own = {(f"v{i}", f"v{j}"): np.linalg.norm(x[i] - x[j]) for i in range(90) for j in range(90) if f"v{i}" < f"v{j}" and (group is None or i % 2 == j % 2)}
        assert got.keys() == own.keys() and all(abs(got[k] - own[k]) < 1e-12 for k in own)
        assert group or got["v3", "v40"] == 0


def test_ragged_lines_are_split_once(spark):
    """What stands above the generator runs once an id: no line is split there."""
    lines = spark.createDataFrame([("k a  b ",), ("k a",), ("@ x",), ("only",), ("",), (" z",)], "line string")
    got = tx.ragged(lines, "line", " ")
    assert sorted(tuple(r) for r in got.collect()) == [("", "z"), ("k", "a"), ("k", "a"), ("k", "b")]
    plan = _plan(got)
    assert "split" not in plan[:plan.index("Generate")]


def test_draws_are_cut_at_a_hash(spark):
    """Each draw takes the rows of least hash, as many as the smallest label has, with rows times seeds in no window."""
    r = spark.range(700).selectExpr("id r_id", "if(id % 3 = 0, 'a', 'b') label")
    hashed = r.crossJoin(spark.range(5).withColumnRenamed("id", "seed")).selectExpr("*", "xxhash64(seed, r_id) h").toPandas()
    hashed["h"] = hashed.h.to_numpy().astype("uint64")
    own = {(x.label, x.seed, x.r_id) for _, g in hashed.groupby(["label", "seed"]) for x in g.sort_values("h").head(234).itertuples()}
    for buckets in (4, 4096):
        got = dy._drawn(r, 5, buckets)
        assert {(x.label, x.seed, x.r_id) for x in got.collect()} == own and got.select("least").distinct().collect()[0][0] == 234
        assert "Window" not in _plan(got)


@pytest.mark.parametrize("copies", [0, 300])
def test_ward_of_vectors_is_that_of_distances(copies):
    """The same merges as by updating a matrix of distances."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8)) + rng.integers(0, 4, 1500)[:, None]
    x[:copies] = x[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got, want = numerics.linkage(x), numerics.linkage(d, "ward", condensed=True)
    assert np.allclose(got[:, 2], want[:, 2], atol=1e-9)
    assert copies or (got[:, [0, 1, 3]] == want[:, [0, 1, 3]]).all()


@pytest.mark.parametrize("name", ["centrality_columns", "centrality_table"])
def test_ranks_are_written_each_round(spark, name):
    """A round reads the ranks before twice; unwritten rounds double the plan, which the driver has to hold."""
    assert len(_plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines()) < 40


@pytest.mark.parametrize("method", ["ward", "average"])
def test_merges_without_a_matrix(method):
    """4,000 vectors hold far less than a matrix of their distances (128 MB), and merge as by that matrix."""
    x = np.random.default_rng(9).normal(size=(4000, 8))
    x[7] = x[5]
    tracemalloc.start()
    merges = numerics._ward_merges(x) if method == "ward" else numerics._average_merges(x, most=1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got, want = numerics._dendrogram(merges, len(x), method), numerics.linkage(d, method, condensed=True)
    assert peak < 64e6
    assert np.allclose(got[:, 2], want[:, 2], atol=1e-9) and (got[:, [0, 1, 3]] == want[:, [0, 1, 3]]).all()


@pytest.mark.parametrize("copies", [0, 900])
def test_average_of_vectors_is_that_of_distances(copies):
    """As for Ward; a cluster may have more vectors than a block."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(700, 5)) * 0.01, rng.normal(size=(900, 5)) + 3])
    x[:copies] = x[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got, want = numerics._dendrogram(numerics._average_merges(x, most=50), len(x), "average"), numerics.linkage(d, "average", condensed=True)
    assert np.allclose(got[:, 2], want[:, 2], atol=1e-7)
    assert copies or (got[:, [0, 1, 3]] == want[:, [0, 1, 3]]).all()


def test_shuffles_share_distances(spark):
    """Tasks have vectors and not seeds, so each distance is worked out once for all seeds; means as one by one."""
    rng = np.random.default_rng(12)
    x, label = rng.normal(size=(150, 3)), np.append(rng.integers(0, 3, 149), 3)
    got = st.shuffled_silhouette(spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(150)], "id long, label int, x array<double>"), 3)
    assert "Aggregate [seed" in _plan(got)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for r in got.collect():
        own = np.random.default_rng(r.seed).permutation(np.unique([str(v) for v in label], return_inverse=True)[1])
        s = []
        for i in range(150):
            m = {k: d[i, (own == k) & (np.arange(150) != i)] for k in range(4)}
            a, b = m[own[i]], min(v.mean() for k, v in m.items() if k != own[i])
            s.append((b - a.mean()) / max(a.mean(), b) if len(a) else 0)
        assert r.s == pytest.approx(np.mean(s), abs=1e-12)
    assert [r.s for r in st.shuffled_silhouette(spark.createDataFrame([], "id long, label int, x array<double>"), 2).collect()] == [0, 0]


def test_linkage_from_lines(spark):
    """Distances reach the linkage in lines of a matrix, no row a pair; the merges are those of the pairs' rows."""
    rng = np.random.default_rng(13)
    label = [*[0] * 70, *[1] * 40, 2, *[None] * 3]
    rows = spark.createDataFrame([(label[k], int(k * 37 % 114), rng.normal(size=4).tolist()) for k in range(114)], "group int, id long, x array<double>")
    pairs = st.distances(rows, group="group").select(F.col("_g").alias("group"), "id_1", "id_2", "d")
    lines = st.distance_lines(rows, "group", block=16)
    assert lines.count() == sum(min(16, n - low) * -(-(n - low) // 16) for n in (70, 40, 1) for low in range(0, n, 16))
    for method in ("ward", "average"):
        got = [sorted(map(tuple, df.collect())) for df in (dg.build_from_lines(lines, method), dg.build_from_distances(pairs, method))]
        assert len(got[0]) == 69 + 39 and got[0] == got[1]
    assert "id_1" not in _plan(catalog.QUERIES["linkage_from_distances"](spark, "/root/testdata/sf0.001"))


def test_counts_of_many_sizes():
    """1,500 different sizes have 2.25 million differences, of which the 4,000 distinct ones are held."""
    x = np.random.default_rng(14).permutation(4000)[:1500].astype(float)
    tracemalloc.start()
    total, blocks = numerics.difference_counts(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    values, counts = np.unique(np.abs(x[:, None] - x)[~np.eye(1500, dtype=bool)], return_counts=True)
    assert peak < 25e6 and total.sum() == 1500 * 1499 and (total[total > 0] == counts).all()
    low, high = next(blocks)
    assert low[0].sum() == 0 and high[0].sum() == 2 * 1499 and low[3].sum() == 6


def test_both_ways_share_their_rounds(spark, monkeypatch):
    """Ranks and steps against the edges come in the rounds of those along them, not in as many again."""
    written, cut = [], dy.cut_lineage
    monkeypatch.setattr(dy, "cut_lineage", lambda df: written.append(0) or cut(df))
    edges = spark.createDataFrame([(1, 2, 3.0), (2, 3, 1.0), (4, 2, 2.0)], "pre int, post int, weight double")
    got = {r.id: r for r in dy.centralities(edges, rounds=6).collect()}
    assert len(written) < 26
    for way, e in (("in", edges), ("out", dy.reversed_edges(edges))):
        h, k = (dict(map(tuple, df.collect())) for df in (dy.harmonic(e), dy.pagerank(e, rounds=6)))
        assert all((r[f"{way}_harmonic"], r[f"{way}_pagerank"]) == pytest.approx((h[i], k[i]), abs=1e-12) for i, r in got.items()) and got.keys() == k.keys()


def test_ranks_of_many_columns_are_one_plan(spark):
    """A column was two windows, one of them without partitions; ties and nulls share their average rank."""
    names = [f"c{k}" for k in range(12)]
    values = np.random.default_rng(5).integers(0, 4, (9, 12)).astype(float)
    rows = [(i, *(None if v == 0 else float(v) for v in r)) for i, r in enumerate(values)]
    x = dy.rank_embedding(spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in names)))
    assert _plan(x).count("Window [") <= 2
    got = {r.id: r.x for r in x.collect()}
    for i in range(9):  # nulls, here 0, come last
        want = [np.log((values[:, k] > values[i, k]).sum() + ((values[:, k] == values[i, k]).sum() + 1) / 2) for k in range(12)]
        assert got[i] == pytest.approx(want, rel=1e-15)


def test_distances_move_blocks_only(spark):
    """Blocks were joined with the pairs of blocks, so each of them was moved once for every other one of 512 vectors."""
    for name in ("pairwise_distances", "square_distances"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan
    rng = np.random.default_rng(15)
    x = rng.normal(size=(700, 3)).round(1)
    rows = spark.createDataFrame([(k % 3 or None, f"v{k}", x[k].tolist()) for k in range(700)] + [(1, None, [0.0] * 3)], "label int, id string, x array<float>")
    for group, block in ((None, 300), ("label", 64), (None, 8192)):
        got = [(r.id_1, r.id_2, r.d) for r in st.distances(rows, group=group, block=block, places=4, both=True).collect()]
        y = x.astype("float32").astype(float)
        own = {(f"v{i}", f"v{j}"): np.sqrt(((y[i] - y[j]) ** 2).sum()) for i in range(700) for j in range(700) if i != j and (group is None or i % 3 == j % 3 > 0)}
        assert len(got) == len(own) and all(abs(d - own[i, j]) <= 5.1e-5 for i, j, d in got) and {(i, j) for i, j, _ in got} == own.keys()


def test_pairs_are_dealt_by_their_number(spark):
    """Tasks grow with the pairs, not only with the input's rows: before, as many as shuffle partitions made all rows, and pairs of a null id were lost."""
    from annograph.operators import multilayer as ml

    p = spark.createDataFrame([(None if k == 299 else k, "ab"[k % 2] if k < 290 else None, None if k == 7 else k % 5) for k in range(300)], "id long, type string, x int")
    got = ml.element_pairs(p, p, "type", lambda x, y: [F.abs(x - y).alias("v")], size=16, rows=100)
    rows = got.collect()
    own = {(i, j, "ab"[i % 2], None if 7 in (i, j) else abs(i % 5 - j % 5)) for i in range(290) for j in range(290) if i % 2 == j % 2}
    assert len(rows) == len(own) and {(r.id_1, r.id_2, r.type, r.v) for r in rows} == own
    assert got.rdd.getNumPartitions() == -(-2 * 145**2 // 100)
    tail = spark.createDataFrame([(1, "a", 2), (None, "a", 5)], "id long, type string, x int")
    assert sorted((str(r.id_1), str(r.id_2)) for r in ml.element_pairs(tail, tail, "type", lambda x, y: [F.abs(x - y).alias("v")]).collect()) == [("1", "1"), ("1", "None"), ("None", "1"), ("None", "None")]


def test_average_linkage_is_dealt_out(spark, monkeypatch):
    """A large group's rounds run in many tasks, not in the one task that builds its tree, and merge as there."""
    rng = np.random.default_rng(16)
    x = rng.normal(size=(260, 4))
    x[9] = x[3]
    rows = spark.createDataFrame([(k % 20 // 19, f"v{k:03}", x[k].tolist()) for k in range(260)], "group int, id string, x array<double>")
    want = sorted(map(tuple, dg._built(rows, "average", "group", "euclidean").collect()))
    dealt = dg._average_rounds
    monkeypatch.setattr(dg, "LARGE", 100)
    monkeypatch.setattr(dg, "_average_rounds", lambda v, own, group: dealt(v, own, group, most=40, tasks=5))
    df = dg.build(rows, "average")
    got = sorted(map(tuple, df.collect()))
    assert len(got) == 258 and [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want], atol=1e-9) and df.dtypes == dg._built(rows, "average", "group", "euclidean").dtypes
