"""Operators that SQL can't check, against hand-made cases and plain versions."""

import datetime
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from annograph.functions import numerics
from annograph.functions.columns import log_factorial
from annograph.operators import dendrogram as dg
from annograph.operators import dynamics as dy
from annograph.operators import matching as gm
from annograph.operators import multilayer as ml
from annograph.operators import statistics as st
from annograph.plans import catalog
from annograph.sources import files
from annograph.sources import text as tx
from annograph.streaming.edges import windowed_edges

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(4)
    a = (rng.random((9, 9)) < 0.35) * rng.integers(1, 9, (9, 9))
    np.fill_diagonal(a, 0)
    pairs = [(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return a.astype(float), spark.createDataFrame(pairs, "pre long, post long, weight double")


def test_each_seed_stops_by_itself(spark):
    """A seed that stands still for ``patience`` steps stops; others go on."""
    sure = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "pre long, post long, weight double")
    start = spark.createDataFrame([(0,)], "id long")
    got = {(r.seed, r.id): r.layer for r in dy.realised_layers(sure, start, 3, patience=2).collect()}
    assert got == {(s, k): k for s in range(3) for k in range(5)}
    never = sure.withColumn("weight", dy.F.lit(-1.0))
    assert dy.realised_layers(never, start, 3, patience=2).count() == 3
    half = dy.realised_layers(sure.withColumn("weight", dy.F.lit(0.5)), start, 40, patience=1, most=30).toPandas()
    plain = []
    for seed in range(40):  # with patience 1 a seed ends at the first step that visits nothing
        layers = half[half.seed == seed].sort_values("layer")
        assert layers.layer.tolist() == list(range(len(layers)))
        plain.append(len(layers))
    assert len(set(plain)) > 2


def test_domain_split_by_hand(spark):
    rng = np.random.default_rng(1)
    n = 9
    v = rng.random((n, n))
    v[:4, :4] *= 0.1
    v[5:, 5:] *= 0.1
    df = spark.createDataFrame([("g", i, j, float(v[i, j])) for i in range(n) for j in range(n)], "graph string, i int, j int, v double")
    got = {r.cut: (r.u, r.p) for r in ml.domain_split(df).collect()}
    assert sorted(got) == list(range(1, n - 1))
    for c in got:
        off = ~np.eye(n, dtype=bool)
        low, high = np.arange(n) < c, np.arange(n) > c
        inside = np.concatenate([v[np.ix_(low, low)][off[np.ix_(low, low)]], v[np.ix_(high, high)][off[np.ix_(high, high)]]])
        between = np.concatenate([v[np.ix_(low, high)].ravel(), v[np.ix_(high, low)].ravel()])
        assert got[c][0] == sum((x > y) + 0.5 * (x == y) for x in inside for y in between)
    assert ml.best_split(ml.domain_split(df)).first()["at"] == 5


def test_resample_draws_with_replacement(spark):
    rows = [(k, 100 + k, 200 + k, 300 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "row long, a long, b long, c long")
    got = dy.resampled(df, "row", ["a", "b", "c"], 4).toPandas()
    assert len(got) == 200 and (got.a == 100 + got.row).all()
    assert got.b.between(200, 249).all() and got.c.between(300, 349).all()
    for _, g in got.groupby("seed"):
        assert 20 < g.b.nunique() < 45  # a permutation would have all 50
        assert (g.b - 200 != g.c - 300).any()
    again = dy.resampled(df, "row", ["a", "b", "c"], 4).toPandas()
    key = ["seed", "row"]
    pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), again.sort_values(key, ignore_index=True))


def _paths(a):
    """Distances and numbers of shortest paths, by counting walks."""
    n = len(a)
    b = (a > 0).astype(float)
    d, s = np.full((n, n), np.inf), np.zeros((n, n))
    walk = np.eye(n)
    for k in range(n):
        new = (walk > 0) & np.isinf(d)
        d[new], s[new] = k, walk[new]
        walk = walk @ b
    return d, s


def test_percolation_counts_paths(spark, graph):
    a, edges = graph
    d, s = _paths(a)
    x = np.arange(1, 10) / 10
    n = len(a)
    want = []
    for v in range(n):
        flow = sum(x[p] * s[p, v] * s[v, q] / s[p, q] for p, q in itertools.permutations(range(n), 2) if v not in (p, q) and np.isfinite(d[p, q]) and d[p, v] + d[v, q] == d[p, q])
        want.append(flow / ((n - 2) * (x.sum() - x[v])))
    states = spark.createDataFrame([(k, float(x[k])) for k in range(n)], "id long, state double")
    got = dy.percolation(edges, states).toPandas().set_index("id").value
    assert np.allclose([got[k] for k in range(n)], want)


def test_betweenness_counts_paths(spark, graph):
    a, edges = graph
    for measure, m in (("betweenness", a), ("shell_betweenness", a + a.T)):
        d, s = _paths(m)
        n = len(m)
        want = np.array([sum(s[p, v] * s[v, q] / s[p, q] for p, q in itertools.permutations(range(n), 2) if v not in (p, q) and np.isfinite(d[p, q]) and d[p, v] + d[v, q] == d[p, q]) for v in range(n)])
        got = dy.per_network(edges, measure).toPandas().set_index("id").value
        got = np.array([got[k] for k in range(n)])
        scale = want.max() / got.max()
        assert np.allclose(got * scale, want) and any(np.isclose(scale, k) for k in (1, (n - 1) * (n - 2), 2, (n - 1) * (n - 2) / 2))


def test_eigenvector_and_laplacian(spark, graph):
    a, edges = graph
    got = dy.eigenvector(edges, rounds=60).toPandas().set_index("id").value
    values, vectors = np.linalg.eig(a.T)
    top = np.abs(np.real(vectors[:, np.argmax(values.real)]))
    assert np.allclose([got[k] for k in range(9)], top, atol=1e-4)
    energy = lambda w: (np.linalg.eigvalsh(np.diag(w.sum(1)) - w) ** 2).sum()
    w = a + a.T
    drop = dy.laplacian(edges).toPandas().set_index("id").value
    for k in range(9):
        rest = np.delete(np.delete(w, k, 0), k, 1)
        assert np.isclose(drop[k], energy(w) - energy(rest))


def test_weighted_distances(spark, graph):
    a, edges = graph
    d = np.where(a > 0, 1 / np.where(a > 0, a, 1), np.inf)
    np.fill_diagonal(d, 0)
    for k in range(9):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    got = {(r.source, r.id): r.d for r in dy.weighted_distances(edges, dy.node_ids(edges)).collect()}
    assert got.keys() == {(i, j) for i in range(9) for j in range(9) if np.isfinite(d[i, j])}
    assert all(np.isclose(v, d[k]) for k, v in got.items())


def test_members_of_a_chain(spark):
    n = 40
    z = spark.createDataFrame([(n + k, 0 if k == 0 else n + k - 1, k + 1, float(k + 1), k + 2) for k in range(n - 1)], "merge int, left int, right int, dist double, size int")
    got = {(r.merge, r.leaf) for r in dg.members(z).collect()}
    assert got == {(n + k, leaf) for k in range(n - 1) for leaf in range(k + 2)}


def test_linkage_of_cosines_and_of_distances(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4))
    df = spark.createDataFrame([("g", k, x[k].tolist()) for k in range(12)], "group string, id int, x array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    got = dg.build(df, "average", metric="cosine").toPandas().sort_values("merge")
    sets = {k: {k} for k in range(12)}
    for r in got.itertuples():
        mean = d[np.ix_(sorted(sets[r.left]), sorted(sets[r.right]))].mean()
        least = min(d[np.ix_(sorted(p), sorted(q))].mean() for p, q in itertools.combinations(sets.values(), 2))
        assert np.isclose(r.dist, mean) and np.isclose(mean, least)  # average linkage joins the nearest two
        sets[r.merge] = sets.pop(r.left) | sets.pop(r.right)
    e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = spark.createDataFrame([("g", i, j, float(e[i, j])) for i, j in itertools.combinations(range(12), 2)], "group string, id_1 int, id_2 int, d double")
    a, b = dg.build(df).toPandas().sort_values("merge"), dg.build_from_distances(pairs).toPandas().sort_values("merge")
    assert np.allclose(a.dist, b.dist) and (a["size"].to_numpy() == b["size"].to_numpy()).all()


def test_text_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text(",pre,post\n0,x,y\n1,y,z\n")
    assert [tuple(r) for r in tx.indexed_csv(spark, str(tmp_path / "a.csv"), "pre string, post string").collect()] == [("x", "y"), ("y", "z")]
    (tmp_path / "b.tsv").write_text("x\t1\ny\t2\n")
    assert [tuple(r) for r in tx.headerless(spark, str(tmp_path / "b.tsv"), ["name", "n"]).collect()] == [("x", "1"), ("y", "2")]
    lines = spark.createDataFrame([(k, s) for k, s in enumerate(["# a", "# b", "k\tv", "x   y  z \r\n", "@ no", "k\ta\tb\t"])], "n int, line string")
    assert [r.n for r in tx.without_head(lines, 2, "n").orderBy("n").collect()] == [2, 3, 4, 5]
    assert lines.where("n = 3").select(tx.fields(dy.F.col("line")).alias("f")).first()["f"] == ["x", "y", "z"]
    assert [(r.key, r.id) for r in tx.ragged(lines.where("n >= 4"), "line").collect()] == [("k", "a"), ("k", "b")]


def test_files(spark, tmp_path):
    one, two = spark.range(3).withColumn("a", dy.F.lit("x")), spark.range(3, 5)
    files.write(one, f"{tmp_path}/p-1")
    files.write(two, f"{tmp_path}/p-2")
    assert sorted((r.id, r.a) for r in files.union_of(spark, f"{tmp_path}/p-*").collect()) == [(0, "x"), (1, "x"), (2, "x"), (3, None), (4, None)]
    import pyarrow as pa
    import pyarrow.feather as feather

    feather.write_feather(pa.table({"id": [1, 2], "s": ["a", None]}), f"{tmp_path}/t.feather")
    assert sorted(map(tuple, files.read_feather(spark, f"{tmp_path}/t.feather", "id long, s string").collect())) == [(1, "a"), (2, None)]
    calls = []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    for n in (3, 3, 4, 3):
        assert files.computed(spark, str(tmp_path), "r", {"n": n}, lambda n=n: compute(n)).count() == n
    assert calls == [3, 4]


def test_stream_of_edges(spark, tmp_path):
    rows = [(k, f"u{k % 2}", "view", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)) for k in range(30)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, event_type string, ts timestamp")
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_edges(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("stream_edges").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(60)
    got = sorted((r.pre, r.weight) for r in spark.table("stream_edges").collect())
    assert got == sorted((r.pre, r.weight) for r in windowed_edges(events).collect()) and sum(w for _, w in got) == 30


def test_kolmogorov_smirnov_pvalue():
    """The tail of the limit law, by its series."""
    for d, n, m in ((0.3, 40, 60), (0.12, 300, 200), (0.5, 30, 30)):
        x = d * np.sqrt(n * m / (n + m))
        tail = 2 * sum((-1) ** (k - 1) * np.exp(-2 * k * k * x * x) for k in range(1, 101))
        assert abs(numerics.ks_pvalue(d, n, m) - tail) < 0.05


def test_discriminants_separate_classes():
    rng = np.random.default_rng(2)
    y = np.repeat([0, 1], 60)
    x = rng.normal(size=(120, 3))
    x[:, 1] += 6 * y
    w, share = numerics.discriminants(x, y)
    assert np.abs(w[1, 0]) == np.abs(w[:, 0]).max() and np.isclose(share.sum(), 1)
    z = x @ w[:, 0]
    assert abs(z[y == 0].mean() - z[y == 1].mean()) > 3 * z[y == 0].std()


@pytest.mark.parametrize("name", ["null_type_shuffle", "null_recipe_shuffle", "null_item_shuffle"])
def test_shuffles_keep_what_they_should(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert got.seed.nunique() > 1 and len(got) > 0
    if name == "null_type_shuffle":
        assert got.groupby("seed").n.sum().nunique() >= 1 and got.mean_p.between(0, 1).all()
    else:
        assert np.allclose(got.groupby(["seed", "category"]).v.sum(), 1)


def test_disjoint_cover_is_disjoint(spark):
    from annograph.sources import networks as net

    z = net.dyadic_merges(spark)
    m = dg.members(z)
    cover = dg.disjoint_cover(m, dy.F.pmod(dy.F.xxhash64("merge"), dy.F.lit(1000))).toPandas()
    leaves = m.toPandas().groupby("merge").leaf.apply(set)
    chosen = [leaves[k] for k in cover["merge"].unique()]
    assert sum(map(len, chosen)) == len(set().union(*chosen))


def test_match_scores_and_stability(spark):
    p = catalog.QUERIES["match_pvalue"](spark, SF).toPandas()
    assert len(p) == 300 and p.select_dtypes("number").notna().all().all()
    assert len(catalog.QUERIES["ego_match"](spark, SF).take(3)) == 3


def test_shuffled_score_is_the_share_of_permutations(spark):
    one, two = ["a", "a", "b", "c"], ["a", "b", "b", "c"]
    m = spark.createDataFrame([(1, 2, k, f"x{k}", f"y{k}") for k in range(4)] + [(1, 3, 0, "x0", "y0")], "id_1 int, id_2 int, place int, node_1 string, node_2 string")
    meta = spark.createDataFrame([(f"x{k}", v) for k, v in enumerate(one)] + [(f"y{k}", v) for k, v in enumerate(two)], "id string, type string")
    got = {r.id_2: r for r in gm.shuffled_score(m, meta, 20_000, cells=999).collect()}
    every = np.array([sum(x == y for x, y in zip(one, q, strict=True)) for q in itertools.permutations(two)])
    assert got[2].obs == 3 and abs(got[2].p - max((every > 3).mean(), 1 / 20_000)) < 0.01
    assert abs(got[2]["mean"] - every.mean()) < 0.03 and abs(got[2]["std"] - every.std()) < 0.03
    assert (got[3].obs, got[3].p, got[3]["mean"], got[3]["std"]) == (1, 1 / 20_000, 1, 0)


def test_stability_leaves_the_identity_but_for_the_own_nodes(spark):
    ring = [float(v) for v in (0, 9, 0, 0, 0, 9, 9, 0, 0)]
    graphs = spark.createDataFrame([("a", ["a", "b", "c"], ring), ("b", ["b", "c", "a"], ring)], "graph string, ids array<string>, adj array<double>")
    p = spark.createDataFrame([("a", "b", 3, 3)], "id_1 string, id_2 string, n_1 int, n_2 int")
    meta = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "u")], "id string, type string")
    got = {r.delta: r for r in gm.stability(graphs, meta, p, spark.createDataFrame([(0,), (10**6,)], "delta long")).collect()}
    assert got[0].perm == [0, 1, 2] and got[0].euclidean_distance == 0 and got[0].matches == 0
    assert got[10**6].perm == [0, 2, 1] and got[10**6].matches == 1


def test_hash_numbers_count_every_row(spark):
    rows = spark.createDataFrame([(g, k) for g in (1, 2) for k in range(500 * g)] + [(3, 7)], "g int, k int")
    got = dy.hash_numbers(rows, "r", ["g"], ["g"], ["k"], buckets=16).toPandas()
    for g, n in ((1, 500), (2, 1000), (3, 1)):
        own = got[got.g == g].sort_values("r")
        assert own.r.tolist() == list(range(1, n + 1)) and sorted(own.k) == (list(range(n)) if g < 3 else [7])
        assert n == 1 or own.k.tolist() != list(range(n))


def test_subsampled_diversity(spark):
    """The smallest label is drawn whole each time; the other one two of three."""
    recipes = spark.createDataFrame([(1, "s"), (2, "s"), (3, "l"), (4, "l"), (5, "l"), (6, "l")], "r_id int, label string")
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "r_id int, item string")
    got = {r.label: r for r in dy.subsampled_diversity(recipes, items, 30).collect()}
    h = -(0.75 * np.log(0.75) + 0.25 * np.log(0.25))
    assert np.allclose([got["s"].entropy, got["s"].diversity, got["s"]["items"], got["s"].ln_items], [h, np.exp(h), 1.5, np.log(2) / 2])
    assert np.allclose([got["s"].sem_entropy, got["s"].sem_items], 0) and np.isclose(got["l"].diversity, 2)


def test_silhouette_by_blocks(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(120, 3)), np.array([0, *[1] * 39, *[2] * 80])
    rows = spark.createDataFrame([(k, int(label[k]), x[k].tolist()) for k in range(120)], "id long, label int, x array<double>")
    got = {r.id: r.s for r in st.silhouette(rows, block=50).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(120):
        m = {k: d[i, (label == k) & (np.arange(120) != i)] for k in range(3)}
        a, b = m[label[i]], min(m[k].mean() for k in range(3) if k != label[i])
        assert np.isclose(got[i], (b - a.mean()) / max(a.mean(), b) if len(a) else 0)
    assert st.silhouette(rows.limit(0)).count() == 0
    assert {r.s for r in st.silhouette(rows.where("label = 1")).collect()} == {0.0}


@pytest.mark.parametrize("leaves", [1, 2, 5, 16, 25])
def test_dyadic_tree_of_any_size(spark, leaves):
    from annograph.sources import networks as net

    z = net.dyadic_merges(spark, leaves).toPandas()
    assert len(z) == leaves - 1 and sorted([*z.left, *z.right]) == list(range(max(0, 2 * leaves - 2)))
    assert leaves == 1 or z["size"].iloc[-1] == leaves


def test_log_factorial(spark):
    got = spark.range(0, 3000).select("id", log_factorial(dy.F.col("id")).alias("x")).toPandas()
    assert np.allclose(got.x, [math.lgamma(k + 1) for k in got.id], rtol=1e-14, atol=1e-12)


def test_running_sums(spark):
    rng = np.random.default_rng(3)
    v = np.unique(rng.normal(size=700))
    n = rng.integers(1, 9, len(v))
    rows = spark.createDataFrame(list(zip(v.tolist(), n.tolist(), strict=True)) + [(None, 5)], "v double, n long")
    got = st.running(rows, "v", {"before": "n"}, parts=16).toPandas().sort_values("v", na_position="first")
    assert got.before.tolist() == [0, 5, *(5 + np.cumsum(n)[:-1])]
    assert st.running(rows.limit(0), "v", {"before": "n"}).count() == 0


def test_rank_statistics_by_hand(spark):
    rng = np.random.default_rng(6)
    x, own = rng.integers(0, 40, 300), rng.random(300) < 0.4
    df = spark.createDataFrame(list(zip(x.tolist(), own.tolist(), strict=True)), "x int, own boolean")
    u = sum((a > b) + 0.5 * (a == b) for a in x[own] for b in x[~own])
    assert st.rank_sum(df, "x", dy.F.col("own")).first().u == u
    d = max(abs((x[own] <= k).mean() - (x[~own] <= k).mean()) for k in range(40))
    assert np.isclose(st.ks_statistic(df, "x", dy.F.col("own")).first().d, d)
