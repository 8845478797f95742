import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import boxes, cluster, density
from tallyframe.operators.boxes import with_boxes as boxes_of
from tallyframe.operators.components import connected_components


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core, label, k = near.sum(1) >= least, -np.ones(len(x), int), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], k
            while stack:
                for j in np.where(near[stack.pop()])[0]:
                    if label[j] < 0:
                        label[j] = k
                        if core[j]:
                            stack.append(j)
            k += 1
    return label


def blobs(d, n, seed):
    rng = np.random.default_rng(seed)
    third = n // 3
    x = np.concatenate([rng.normal(0, 0.3, (third, d)), rng.normal(2, 0.25, (third, d)), rng.uniform(-2, 4, (n - 2 * third, d))])
    x[5] = x[6] = x[7]  # copies
    return x


def frame(spark, x):
    columns = ", ".join(f"f{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], f"id bigint, {columns}")


@pytest.mark.parametrize("d,n,direct", [(2, 260, 4096), (2, 260, 2), (3, 200, 4096)])
def test_dbscan_equals_brute_force(spark, monkeypatch, d, n, direct):
    monkeypatch.setattr(density, "DIRECT_PAIRS", direct)
    x = blobs(d, n, d + direct)
    got = dict(map(tuple, density.dbscan(frame(spark, x), "id", [f"f{i}" for i in range(d)], 0.5, 5).collect()))
    want = brute_dbscan(x, 0.5, 5)
    assert [got[i] for i in range(n)] == list(want)
    assert want.max() >= 1 and (want < 0).any()


@pytest.mark.parametrize("sites", [1, 8])
def test_dbscan_splits_boxes_of_crowded_cells(spark, monkeypatch, sites):
    monkeypatch.setattr(density, "DIRECT_SITES", sites)
    for d, n in ((2, 260), (3, 200)):
        x = blobs(d, n, d)
        got = dict(map(tuple, density.dbscan(frame(spark, x), "id", [f"f{i}" for i in range(d)], 0.5, 5).collect()))
        assert [got[i] for i in range(n)] == list(brute_dbscan(x, 0.5, 5))


def test_dbscan_compares_few_pairs_around_a_crowded_cell(spark, monkeypatch):
    rng = np.random.default_rng(8)
    side = 0.5 / 2**0.5
    crowd = np.floor(9 / side) * side + rng.uniform(0.02, 0.98, (700, 2)) * side  # a third of all rows in one cell
    ring = [[crowd[:, 0].mean() + r * np.cos(a), crowd[:, 1].mean() + r * np.sin(a)] for r in (0.4, 0.55, 0.68) for a in np.linspace(0, 6.2, 20)]
    x = np.concatenate([crowd, ring, rng.uniform(20, 60, (1340, 2))])
    seen, plain = [], density._compared
    monkeypatch.setattr(density, "_compared", lambda pairs, tagged: seen.append(plain(pairs, tagged).count()) or plain(pairs, tagged))
    got = dict(map(tuple, density.dbscan(frame(spark, x), "id", ["f0", "f1"], 0.5, 5).collect()))
    assert [got[i] for i in range(len(x))] == list(brute_dbscan(x, 0.5, 5))
    assert sum(seen) < 60 * 700 / 4


def test_dbscan_all_noise_and_hot_point(spark):
    apart = np.array([[float(10 * i), 0.0] for i in range(6)])
    assert {r["cluster"] for r in density.dbscan(frame(spark, apart), "id", ["f0", "f1"], 0.5, 2).collect()} == {-1}
    copies = np.array([[1.0, 1.0]] * 7 + [[9.0, 9.0]])
    got = dict(map(tuple, density.dbscan(frame(spark, copies), "id", ["f0", "f1"], 0.5, 5).collect()))
    assert got == {**{i: 0 for i in range(7)}, 7: -1}


def test_components_on_chain_and_islands(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(3, 7), (7, 5)]
    edges = spark.createDataFrame(chain, "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(100, 141), 3, 5, 7, 99]], "node bigint")
    got = dict(map(tuple, connected_components(edges, nodes).collect()))
    assert {got[i] for i in range(100, 141)} == {100} and {got[3], got[5], got[7]} == {3} and got[99] == 99


def test_robust_scale(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "a double, b double")
    got = cluster.robust_scale(df, ["a", "b"]).toPandas()
    assert list(got["a_scaled"]) == pytest.approx([(v - 2.5) / 3.0 for v in (1, 2, 3, 10)])
    assert set(got["b_scaled"]) == {0.0}


def plain_kmedoids(x, k):
    """Alternating k-medoids from the k most central rows, over the whole distance matrix."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    medoids = list(np.argsort(d.sum(1).round(9), kind="stable")[:k])
    while True:
        label, moved = d[medoids].argmin(0), list(medoids)
        for c in range(k):
            members = np.flatnonzero(label == c)
            sums = d[np.ix_(members, members)].sum(1).round(9)
            if len(members) and sums.min() < round(d[medoids[c], members].sum(), 9):
                moved[c] = members[sums.argmin()]
        if moved == medoids:
            return medoids, label
        medoids = moved


@pytest.mark.parametrize("seed,k,boxes", [(1, 3, 1024), (2, 4, 4), (3, 2, 30), (4, 5, 1024)])
def test_kmedoids_equal_an_exhaustive_search(spark, monkeypatch, seed, k, boxes):
    from tallyframe.operators import medoids

    monkeypatch.setattr(medoids, "BATCH", 5)
    monkeypatch.setattr(cluster, "with_boxes", lambda df, names, rows: boxes_of(df, names, rows, boxes))
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (50, 2)) for c, s in ((0, 0.5), (3, 1.0), (9, 0.2))] + [rng.uniform(-20, 20, (30, 2))])
    x[10] = x[11]
    got = cluster.kmedoids(frame(spark, x), "id", ["f0", "f1"], k).toPandas().sort_values("id", ignore_index=True)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    want, label = plain_kmedoids((x - q[1]) / (q[2] - q[0]), k)
    assert sorted(got.index[got["is_medoid"]]) == sorted(want)
    assert list(got["cluster"]) == [f"Cluster {c}" for c in label]


@pytest.mark.parametrize("fine", [False, True])
def test_loose_boxes_need_few_passes(spark, monkeypatch, fine):
    from tallyframe.operators import medoids

    x = np.random.default_rng(8).normal(0, 1, (4_000, 2))
    x[100] = x[7] = x[11]
    points = boxes_of(frame(spark, x).withColumnRenamed("id", "__id"), ["f0", "f1"], len(x), 4)
    points = boxes_of(points, ["f0", "f1"], len(x), 250, "__fine") if fine else points
    asked, exact = [], medoids._exact_sums

    def counted(assigned, names, batch):
        asked.append(len(batch))
        return exact(assigned, names, batch)

    monkeypatch.setattr(medoids, "_exact_sums", counted)
    found = medoids.central_members(points.withColumn("__c", F.lit(0)), ["f0", "f1"], wanted=3)[0]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)).sum(1)
    assert [m[1] for m in found] == np.argsort(d, kind="stable")[:3].tolist()
    assert len(asked) <= (2 if fine else 9) and sum(asked) <= (200 if fine else 4_000)


def test_box_summaries_enclose_the_sums():
    rng = np.random.default_rng(5)
    members = [rng.normal(c, 0.3, (40, 3)) for c in range(6)]
    means = np.array([m.mean(0) for m in members])
    spreads = np.array([((m - m.mean(0)) ** 2).sum(1).mean() for m in members])
    summary = boxes.Summary(np.full(6, 40.0), means, spreads)
    x = np.concatenate([*members, rng.normal(0, 9, (20, 3))])
    low, high = summary.bounds(x)
    true = np.sqrt(((x[:, None] - np.concatenate(members)) ** 2).sum(-1)).sum(1)
    assert (low <= true).all() and (true <= high).all() and (high - low < 0.15 * true).all()
    values, slopes = summary.planes()
    assert ((values + ((x[:, None] - means) * slopes).sum(-1)).max(1) <= true).all()


def test_kmedoids_invariants(spark):
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.2, (40, 2)) for c in (0, 5, 10)])
    options = {"distance": "squared", "start": "spread"}
    got = cluster.kmedoids(frame(spark, x), "id", ["f0", "f1"], 3, **options).toPandas().sort_values("id", ignore_index=True)
    assert got["is_medoid"].sum() == 3 and got["cluster"].nunique() == 3
    # every blob is one cluster, and each medoid is the member nearest its cluster mean
    assert all(got["cluster"][i : i + 40].nunique() == 1 for i in (0, 40, 80))
    for _, part in got.groupby("cluster"):
        gap = (part[["f0", "f1"]] - part[["f0", "f1"]].mean()).pow(2).sum(axis=1)
        assert part.loc[gap.idxmin(), "is_medoid"]
    for more in ({}, options):
        with pytest.raises(ValueError):
            cluster.kmedoids(frame(spark, x[:2]), "id", ["f0", "f1"], 3, **more)


def test_model_clusters_and_labels(spark):
    x = np.concatenate([np.random.default_rng(4).normal(c, 0.2, (30, 2)) for c in (0, 5, 10)])
    df = frame(spark, x)
    named = cluster.kmeans(df, ["f0", "f1"], 3, labels={0: "zero"}).toPandas()
    assert set(named["cluster"]) == {"zero", "Cluster 1", "Cluster 2"} and len(named) == 90
    assert cluster.bisecting(df, ["f0", "f1"], 3).select("cluster").distinct().count() == 3
    curve = {r["k"]: r for r in cluster.elbow(df, ["f0", "f1"], [2, 3]).collect()}
    assert curve[3]["inertia"] < curve[2]["inertia"] and curve[3]["silhouette"] > curve[2]["silhouette"]
    with pytest.raises(ValueError, match="two features"):
        cluster.kmeans(df, ["f0"], 3)


def test_noise_label(spark):
    df = spark.createDataFrame([(-1,), (0,)], "c int")
    assert [r[0] for r in df.select(cluster.label_clusters(F.col("c"), noise="Outlier")).collect()] == ["Outlier", "Cluster 0"]
    assert [r[0] for r in df.select(cluster.label_clusters(F.col("c"))).collect()] == ["Cluster -1", "Cluster 0"]


def test_missing_features_are_refused(spark):
    rows = [(i, float(i % 3), float(i)) for i in range(9)]
    for hole in (None, float("nan")):
        df = spark.createDataFrame([*rows, (9, 1.0, hole)], "id bigint, f0 double, f1 double")
        for call in (
            lambda d: cluster.kmeans(d, ["f0", "f1"], 2),
            lambda d: cluster.kmedoids(d, "id", ["f0", "f1"], 2),
            lambda d: density.dbscan_scaled(d, "id", ["f0", "f1"]),
        ):
            with pytest.raises(ValueError, match="f1|x1"):
                call(df)


def test_unsettled_clusterings_raise(spark):
    x = np.random.default_rng(2).uniform(0, 1, (200, 2))
    with pytest.raises(RuntimeError, match="settle"):
        cluster.kmeans(frame(spark, x), ["f0", "f1"], 4, max_iter=1)
    with pytest.raises(RuntimeError, match="still move"):
        cluster.kmedoids(frame(spark, x), "id", ["f0", "f1"], 4, max_rounds=1)


def test_profile_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, x double")
    got = {r["g"]: (r["mean"], r["median"]) for r in cluster.group_profile(df, "g", ["x"]).collect()}
    assert got == {None: (2.0, 2.0), "a": (5.0, 5.0)}
