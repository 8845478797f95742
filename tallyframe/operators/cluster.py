"""Scaling, clustering and cluster profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.boxes import BOXES, FINE_BOXES, SAMPLE_PER_BOX, with_boxes
from tallyframe.operators.medoids import central_start, settle
from tallyframe.operators.profile import _stack
from tallyframe.operators.quantiles import percentile_table
from tallyframe.session import materialise

NOISE = -1
MAX_ITER = 300  # rounds of k-means and k-medoids before they are said not to settle


def _need_two(features: Sequence[str]) -> None:
    if len(features) < 2:
        raise ValueError("clustering needs at least two features")


def require_values(df: DataFrame, features: Sequence[str]) -> None:
    """Raise ``ValueError`` naming the features with NULL or NaN: no distance to such a row means anything."""
    missing = [F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f) for f in features]
    found = [f for f, n in df.agg(*missing).first().asDict().items() if n]
    if found:
        raise ValueError(f"features with NULL or NaN: {', '.join(found)}")


def _stored(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows written once, as every clustering reads them many times, and checked for missing values."""
    _need_two(features)
    stored = materialise(df)
    require_values(stored, features)
    return stored


def robust_scale(df: DataFrame, features: Sequence[str], suffix: str = "_scaled", **options) -> DataFrame:
    """(x - median) / interquartile range with exact quartiles; a zero range divides by 1."""
    table = percentile_table(df, features, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **options)
    rows = {r["column"]: r for r in table.collect()}  # one row per feature
    scaled = {}
    for f in features:
        r = rows[f]
        if r["median"] is None:
            raise ValueError(f"{f} has no values")
        scaled[f + suffix] = (F.col(f) - F.lit(r["median"])) / F.lit((r["q3"] - r["q1"]) or 1.0)
    return df.withColumns(scaled)


def label_clusters(cluster: Column, labels: Mapping[int, str] | None = None, noise: str | None = None) -> Column:
    """Mapped name, or ``Cluster i``; noise gets its own label when no mapping is given."""
    default = F.concat(F.lit("Cluster "), cluster.cast("string"))
    if labels:
        names = F.create_map(*[F.lit(x) for item in labels.items() for x in item])
        return F.coalesce(F.try_element_at(names, cluster.cast("int")), default)
    return F.when(cluster == NOISE, noise).otherwise(default) if noise is not None else default


def _vectors(df: DataFrame, features: Sequence[str], **options) -> DataFrame:
    scaled = robust_scale(_stored(df, features), features, "__s", **options)
    inputs = [f + "__s" for f in features]
    return VectorAssembler(inputCols=inputs, outputCol="__features").transform(scaled).drop(*inputs)


def _settled(model, max_iter: int):
    """The model, unless it used up its rounds without settling."""
    if model.summary.numIter >= max_iter:
        raise RuntimeError(f"k-means did not settle in {max_iter} rounds")
    return model


def _labelled(model, vectors: DataFrame, labels) -> DataFrame:
    found = model.transform(vectors)
    return found.withColumn("cluster", label_clusters(F.col("__cluster"), labels)).drop("__features", "__cluster")


def kmeans(
    df: DataFrame,
    features: Sequence[str],
    k: int = 3,
    labels: Mapping[int, str] | None = None,
    seed: int = 42,
    max_iter: int = MAX_ITER,
    **options,
) -> DataFrame:
    """K-means on robust-scaled features, run until it settles; adds ``cluster``.

    Raises ``RuntimeError`` if ``max_iter`` rounds do not suffice and ``ValueError``
    for NULL or NaN features.
    """
    vectors = _vectors(df, features, **options)
    estimator = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__features", predictionCol="__cluster")
    return _labelled(_settled(estimator.fit(vectors), max_iter), vectors, labels)


def bisecting(
    df: DataFrame,
    features: Sequence[str],
    k: int = 3,
    labels: Mapping[int, str] | None = None,
    seed: int = 42,
    max_iter: int = MAX_ITER,
    **options,
) -> DataFrame:
    """Hierarchical clustering into k groups, top-down by bisecting k-means.

    Bottom-up linkage needs all pairwise distances; this is its scalable stand-in
    and its groups can differ. Each split takes up to ``max_iter`` rounds.
    """
    vectors = _vectors(df, features, **options)
    estimator = BisectingKMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__features", predictionCol="__cluster")
    return _labelled(estimator.fit(vectors), vectors, labels)


def kmedoids(
    df: DataFrame,
    row_id: str,
    features: Sequence[str],
    k: int = 3,
    labels: Mapping[int, str] | None = None,
    seed: int = 42,
    max_rounds: int = MAX_ITER,
    distance: str = "plain",
    start: str = "central",
    **options,
) -> DataFrame:
    """K-medoids on robust-scaled features; adds ``cluster`` and ``is_medoid``.

    Rows go to the nearest medoid, then each cluster takes the member with the least sum
    of ``distance`` ("plain" or "squared") to its members, until none moves. Under plain
    distance that member is found by bounds (see ``medoids``); under squared distance it
    is the member nearest the mean. ``start`` takes the k rows with the least sums of
    distances to all rows ("central"), or rows drawn one by one, a row's chance growing
    with its distance from those drawn ("spread", by ``seed``). Raises ``RuntimeError``
    if the medoids still move after ``max_rounds`` and ``ValueError`` for NULL or NaN
    features, or fewer than k rows.
    """
    if distance not in ("plain", "squared") or start not in ("central", "spread"):
        raise ValueError("distance is plain or squared, start is central or spread")
    scaled = robust_scale(_stored(df, features), features, "__s", **options)
    names = [f + "__s" for f in features]
    points = materialise(scaled.select(F.col(row_id).alias("__id"), *names))
    if distance == "plain" or start == "central":
        n = points.count()
        points = with_boxes(points, names, n)
        if n > BOXES * SAMPLE_PER_BOX * 4:  # with fewer rows a fine box holds only a few
            points = with_boxes(points, names, n, FINE_BOXES, "__fine")
        points = materialise(points)
    points = points.persist()  # read many times: kept in memory on top of the written copy
    first = central_start(points, names, k) if start == "central" else _spread_start(points, names, k, seed)
    if distance == "plain":
        medoids = settle(points, names, first, lambda places: _nearest(names, places), max_rounds)
    else:
        medoids = _settled_squared(points, names, first, max_rounds)
    points.unpersist()
    cluster = _nearest(names, [m[1] for m in medoids])
    out = scaled.withColumns(
        {"cluster": label_clusters(cluster, labels), "is_medoid": F.col(row_id).isin([m[0] for m in medoids])}
    )
    return out.drop(*names)


def _settled_squared(points: DataFrame, names: Sequence[str], medoids: list[tuple], max_rounds: int) -> list[tuple]:
    """Medoids under squared distance: two linear aggregations a round, and k rows to the driver."""
    for _ in range(max_rounds):
        assigned = points.withColumn("__c", _nearest(names, [m[1] for m in medoids]))
        means = {
            r["__c"]: [r[n] for n in names]
            for r in assigned.groupBy("__c").agg(*[F.avg(n).alias(n) for n in names]).collect()
        }
        # one pass: per cluster the member nearest its mean, ties to the smallest id
        nearest = [
            F.min(
                F.when(
                    F.col("__c") == c,
                    F.struct(_distance2(names, mean).alias("__gap"), "__id", *names),
                )
            ).alias(f"c{c}")
            for c, mean in means.items()
        ]
        winners = assigned.agg(*nearest).first()
        moved = list(medoids)
        for c in means:
            moved[c] = (winners[f"c{c}"]["__id"], [winners[f"c{c}"][n] for n in names])
        if moved == medoids:
            return medoids
        medoids = moved
    raise RuntimeError(f"medoids still move after {max_rounds} rounds")


def _spread_start(points: DataFrame, names: Sequence[str], k: int, seed: int) -> list[tuple]:
    """k different rows as (id, place), each drawn with chances by squared distance from the nearest one before.

    One pass a row: the smallest exponential draw, made from md5 of seed, step and id
    so that a repeated task draws the same, divided by the row's weight.
    """
    chosen: list[tuple] = []
    for step in range(k):
        digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit(step), F.col("__id").cast("string")))
        uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32
        weight = F.array_min(F.array(*[_distance2(names, place) for _, place in chosen])) if chosen else F.lit(1.0)
        draw = F.when(weight > 0, -F.log(uniform) / weight).otherwise(float("inf"))
        taken = F.coalesce(F.col("__id").isin([c for c, _ in chosen]), F.lit(False))
        row = points.where(~taken).agg(F.min(F.struct(draw.alias("__draw"), "__id", *names)).alias("row")).first()["row"]
        if row is None:
            raise ValueError(f"fewer than {k} rows")
        chosen.append((row["__id"], [row[n] for n in names]))
    return chosen


def _distance2(names: Sequence[str], centre: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for n, c in zip(names, centre):
        total = total + (F.col(n) - F.lit(c)) * (F.col(n) - F.lit(c))
    return total


def _nearest(names: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    options = [F.struct(_distance2(names, c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]
    return F.array_min(F.array(*options))["i"]


def elbow(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, 10), seed: int = 42, max_iter: int = MAX_ITER, **options) -> DataFrame:
    """Inertia and silhouette (squared Euclidean) of settled k-means for each k."""
    vectors = _vectors(df, features, **options).select("__features").persist()
    try:
        rows = []
        for k in ks:
            estimator = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="__features", predictionCol="__cluster")
            model = _settled(estimator.fit(vectors), max_iter)
            score = ClusteringEvaluator(featuresCol="__features", predictionCol="__cluster").evaluate(model.transform(vectors))
            rows.append((k, float(model.summary.trainingCost), float(score)))
    finally:
        vectors.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def group_profile(df: DataFrame, by: str, columns: Sequence[str], digits: int = 3, **options) -> DataFrame:
    """Mean, median and standard deviation of each column per group, rounded."""
    aggregates = []
    for c in columns:
        aggregates += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std")]
    moments = _stack(df.groupBy(by).agg(*aggregates), columns, ["mean", "std"], keep=[by])
    medians = percentile_table(df, columns, {"median": 0.5}, [by], **options)
    medians = medians.select(F.col(by).alias("__by"), F.col("column").alias("__column"), "median")
    same = F.col(by).eqNullSafe(F.col("__by")) & (F.col("column") == F.col("__column"))
    joined = moments.join(medians, same, "left")
    return joined.select(by, "column", *[F.round(m, digits).alias(m) for m in ("mean", "median", "std")])


def group_sizes(df: DataFrame, by: str, count_as: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(count_as)).orderBy(F.desc(count_as), by)
