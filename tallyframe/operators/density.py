"""Density clustering (DBSCAN) without comparing all pairs of a crowded area.

The plane is cut into cells so small that two points of one cell are always
neighbours. A cell with ``min_samples`` points is therefore dense: all its points
are core points of one cluster and none of its pairs is ever formed. Point
comparisons remain only around sparse cells, which hold fewer than
``min_samples`` points each. There, and where two cells with core points may touch,
bounding boxes decide; they are split further only while the answer is open, and
points are compared only in boxes that hold few.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.cluster import NOISE, label_clusters, require_values, robust_scale
from tallyframe.operators.components import connected_components
from tallyframe.operators.quantiles import global_rank
from tallyframe.session import materialise

MAX_OFFSETS = 1_000  # neighbour cells listed per cell; further dimensions are checked by box distance
DIRECT_PAIRS = 4_096  # two boxes are compared point by point below this product of sizes
DIRECT_SITES = 64  # a site is compared with the points of a box up to this size


def dbscan_scaled(
    df: DataFrame, row_id: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 5, **options
) -> DataFrame:
    """``dbscan`` on robust-scaled features, labelled ``Cluster i`` or ``Outlier``."""
    if len(features) < 2:
        raise ValueError("clustering needs at least two features")
    df = materialise(df)
    scaled = robust_scale(df, features, "__s", **options)
    found = dbscan(scaled, row_id, [f + "__s" for f in features], eps, min_samples)
    named = found.withColumn("cluster", label_clusters(F.col("cluster"), noise="Outlier"))
    return df.join(named, row_id)


def dbscan(df: DataFrame, row_id: str, features: Sequence[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """(row_id, cluster) with clusters from 0 in order of their smallest core id, -1 for noise.

    ``row_id`` is a unique bigint. A point counts itself as neighbour; a border
    point joins the smallest cluster number in reach. NULL or NaN features raise
    ``ValueError``.
    """
    d = len(features)
    xs = [f"x{i}" for i in range(d)]
    side = eps / math.sqrt(d) * (1 - 1e-9)  # the margin keeps rounding from breaking "one cell = neighbours"
    points = materialise(df.select(F.col(row_id).alias("id"), *[F.col(f).cast("double").alias(x) for f, x in zip(features, xs)]))
    require_values(points, xs)
    place = {f"c{i}": F.floor(F.col(x) / F.lit(side)) for i, x in enumerate(xs)}
    # equal points share their fate, so copies become one site with a weight
    placed = materialise(
        points.groupBy(*xs).agg(F.count("*").alias("copies"), F.min("id").alias("site")).withColumns(place)
    )
    # a cell is named by its smallest site, so that later joins compare one number
    cells = materialise(
        placed.groupBy(*place).agg(F.min("site").alias("cell"), F.sum("copies").alias("n"), F.count("*").alias("sites"), *_box(xs))
    )
    near = materialise(_near_cells(cells, list(place), xs, eps))

    sites = materialise(placed.join(cells.select(*place, "cell", F.col("n").alias("own")), list(place)).drop(*place))
    sized, sites = sites, sites.drop("own")
    sparse = sized.where(F.col("own") < min_samples)
    reach = _reached(sparse, near, sites, xs, eps, side, "copies", F.sum, min_samples - F.col("own"))
    is_core = F.col("own") + F.coalesce("reach", F.lit(0)) >= min_samples
    judged = materialise(sized.join(reach, "site", "left").select("site", "cell", *xs, is_core.alias("core")))
    core = judged.where("core")

    core_cells = materialise(core.groupBy("cell").agg(F.min("site").alias("node"), F.count("*").alias("n"), *_box(xs)))
    links = _linked_cells(core, core_cells, near, xs, eps, side)
    nodes = core_cells.select("cell", "node")
    edges = links.join(nodes.select(F.col("cell").alias("a_cell"), F.col("node").alias("a")), "a_cell").join(
        nodes.select(F.col("cell").alias("b_cell"), F.col("node").alias("b")), "b_cell"
    )
    rooted = materialise(connected_components(edges.select("a", "b"), nodes.select("node")))
    roots = rooted.where("node = root").select("root")
    numbers = global_rank(roots, [F.col("root")], "number")
    labels = nodes.join(rooted, "node").join(numbers, "root").select("cell", (F.col("number") - 1).cast("int").alias("cluster"))

    # border points: sparse, not core, with a core point in reach
    rest = judged.where("NOT core")
    own = rest.join(labels, "cell").select("site", "cluster")
    core_named = core.drop("core").join(labels, "cell")
    core_near = near.select("a_cell", "b_cell").join(
        core_cells.join(labels, "cell").select(
            F.col("cell").alias("b_cell"), F.col("cluster").alias("b_n"), F.col("n").alias("b_sites"), *[F.col(c).alias(f"b_{c}") for c in _names(xs)]
        ),
        "b_cell",
    )
    others = _reached(rest, core_near, core_named, xs, eps, side, "cluster", F.min)
    border = own.unionByName(others.select("site", F.col("reach").alias("cluster"))).groupBy("site").agg(
        F.min("cluster").alias("cluster")
    )
    named = core_named.select("site", "cluster").unionByName(border)
    placed = sites.join(named, "site", "left").select(*[F.col(x).alias(f"s_{x}") for x in xs], "cluster")
    same = reduce(lambda a, b: a & b, [F.col(x) == F.col(f"s_{x}") for x in xs])
    return points.join(placed, same, "left").select(
        F.col("id").alias(row_id), F.coalesce("cluster", F.lit(NOISE)).alias("cluster")
    )


def _names(xs: Sequence[str]) -> list[str]:
    return [f"lo_{x}" for x in xs] + [f"hi_{x}" for x in xs]


def _named(side: str, xs: Sequence[str]) -> list[str]:
    return [f"{side}_{c}" for c in _names(xs)]


def _box(xs: Sequence[str]) -> list[Column]:
    return [F.min(x).alias(f"lo_{x}") for x in xs] + [F.max(x).alias(f"hi_{x}") for x in xs]


def _square_sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [t * t for t in terms])


def _gap2(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Squared distance between two boxes given as lists of columns."""
    zero = F.lit(0.0)
    return _square_sum([F.greatest(zero, lb - ha, la - hb) for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b)])


def _span2(lo_a, hi_a, lo_b, hi_b) -> Column:
    """Largest squared distance between points of two boxes."""
    return _square_sum([F.greatest(F.abs(hb - la), F.abs(ha - lb)) for la, ha, lb, hb in zip(lo_a, hi_a, lo_b, hi_b)])


def _sides(prefix: str, xs: Sequence[str]) -> tuple[list[Column], list[Column]]:
    return [F.col(f"{prefix}_lo_{x}") for x in xs], [F.col(f"{prefix}_hi_{x}") for x in xs]


def _near_cells(cells: DataFrame, place: Sequence[str], xs: Sequence[str], eps: float) -> DataFrame:
    """Ordered pairs of different cells whose boxes are within eps, with the second cell's size and box."""
    reach = math.ceil(math.sqrt(len(xs)))
    listed = len(xs)
    while listed > 1 and (2 * reach + 1) ** listed > MAX_OFFSETS:
        listed -= 1
    a = cells.select(
        F.col("cell").alias("a_cell"), *[F.col(c).alias(f"a_{c}") for c in _names(xs)], *place[:listed]
    )
    for c in place[:listed]:  # one row per neighbouring coordinate
        a = a.withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(c, F.col(c) + F.col("step"))
    b = cells.select(
        F.col("cell").alias("b_cell"),
        F.col("n").alias("b_n"),
        F.col("sites").alias("b_sites"),
        *[F.col(c).alias(f"b_{c}") for c in _names(xs)],
        *place[:listed],
    )
    close = _gap2(*_sides("a", xs), *_sides("b", xs)) <= eps * eps
    pairs = a.join(b, place[:listed]).where((F.col("a_cell") != F.col("b_cell")) & close)
    return pairs.select("a_cell", "b_cell", "b_n", "b_sites", *_named("b", xs))


def _reached(sites, near, targets, xs, eps, side, value: str, merge, enough: Column | None = None) -> DataFrame:
    """(site, reach): ``merge`` of the targets' ``value`` over the targets within eps in other cells.

    A box of targets wholly in reach counts as a whole and one out of reach not at all.
    The others are compared point by point if they hold at most ``DIRECT_SITES``
    targets, and split otherwise. A site that has ``enough`` (over its columns) looks no
    further, so its reach may be less than the whole, but not less than enough.
    """
    here = [F.col(x) for x in xs]
    b, split, level_side = _sides("b", xs), 4 if len(xs) <= 2 else 2, side
    need = (F.lit(None).cast("bigint") if enough is None else enough).alias("need")
    kept = ["site", *xs, "need"]
    tagged = targets.select("cell", F.array("cell").alias("sub"), F.col(value).alias("value"), *[F.col(x).alias(f"t_{x}") for x in xs])
    pairs = sites.select("site", "cell", *xs, need).join(near, F.col("cell") == F.col("a_cell")).select(
        *kept, "b_cell", F.array("b_cell").alias("b_sub"), F.col("b_n").alias("b_value"), "b_sites", *_named("b", xs)
    )
    parts = []
    while True:
        pairs = materialise(
            pairs.where(_gap2(here, here, *b) <= eps * eps)
            .withColumn("covered", _span2(here, here, *b) <= eps * eps)
            .select(*kept, "b_cell", "b_sub", "b_value", "b_sites", "covered")
        )
        parts.append(pairs.where("covered").groupBy("site").agg(merge("b_value").alias("part")))
        undecided, few = pairs.where("NOT covered"), F.col("b_sites") <= DIRECT_SITES
        apart = _square_sum([F.col(x) - F.col(f"t_{x}") for x in xs])
        compared = _compared(undecided.where(few), tagged).where(apart <= eps * eps)
        parts.append(compared.groupBy("site").agg(merge("value").alias("part")))
        large = undecided.where(~few)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, parts).groupBy("site").agg(merge("part").alias("reach"))
        parts = [materialise(reduce(DataFrame.unionByName, parts).groupBy("site").agg(merge("part").alias("part")))]
        if enough is not None:
            large = large.join(parts[0], "site", "left").where(F.coalesce("part", F.lit(0)) < F.col("need")).drop("part")
        large = materialise(large)
        open_subs = large.select(F.col("b_cell").alias("cell"), F.col("b_sub").alias("sub")).distinct()
        level_side = level_side / split
        part = F.array(*[F.floor(F.col(f"t_{x}") / F.lit(level_side)) for x in xs])
        tagged = materialise(
            tagged.join(open_subs, ["cell", "sub"], "left_semi").withColumn("parent", F.col("sub")).withColumn("sub", part)
        )
        boxes = tagged.groupBy(F.col("cell").alias("b_cell"), F.col("parent").alias("b_parent"), F.col("sub").alias("b_sub")).agg(
            merge("value").alias("b_value"),
            F.count("*").alias("b_sites"),
            *[F.min(f"t_{x}").alias(f"b_lo_{x}") for x in xs],
            *[F.max(f"t_{x}").alias(f"b_hi_{x}") for x in xs],
        )
        tagged = tagged.drop("parent")
        pairs = large.select(*kept, "b_cell", F.col("b_sub").alias("b_parent")).join(boxes, ["b_cell", "b_parent"]).drop("b_parent")


def _compared(pairs: DataFrame, tagged: DataFrame) -> DataFrame:
    """Each site beside every target of its open boxes."""
    targets = tagged.withColumnsRenamed({"cell": "b_cell", "sub": "b_sub"})
    return pairs.join(targets, ["b_cell", "b_sub"])


def _linked_cells(core, core_cells, near, xs, eps, side) -> DataFrame:
    """Pairs (a_cell, b_cell) of cells that hold core points within eps of each other."""
    split = 4 if len(xs) <= 2 else 2
    e2 = eps * eps
    whole = F.array("cell")  # the first box of a cell is the cell itself
    boxes = core_cells.select("cell", whole.alias("sub"), "n", *_names(xs))
    first = near.where(F.col("a_cell") < F.col("b_cell")).select("a_cell", "b_cell")
    pairs = _with_boxes(
        first.withColumns({"a_sub": F.array("a_cell"), "b_sub": F.array("b_cell")}), boxes, xs
    )
    tagged = core.withColumn("sub", whole)
    linked = None
    level_side = side
    while True:
        a, b = _sides("a", xs), _sides("b", xs)
        pairs = materialise(
            pairs.where(_gap2(*a, *b) <= e2)
            .withColumn("sure", _span2(*a, *b) <= e2)
            .select("a_cell", "b_cell", "a_sub", "b_sub", "a_n", "b_n", "sure")
        )
        found = pairs.where("sure").select("a_cell", "b_cell").distinct()
        undecided = pairs.join(found, ["a_cell", "b_cell"], "left_anti").drop("sure")
        many = F.col("a_n") * F.col("b_n") > DIRECT_PAIRS
        linked_now = found.unionByName(_compare(undecided.where(~many), tagged, xs, e2)).distinct()
        last = undecided.where(many).isEmpty()
        if not last:
            linked_now = materialise(linked_now)
        linked = linked_now if linked is None else linked.unionByName(linked_now)
        if last:
            return linked.distinct()
        large = materialise(undecided.where(many).join(linked_now, ["a_cell", "b_cell"], "left_anti"))
        if large.isEmpty():
            return linked.distinct()
        # split the boxes of the open pairs and look at their parts
        open_subs = large.select(F.col("a_cell").alias("cell"), F.col("a_sub").alias("sub")).union(
            large.select("b_cell", "b_sub")
        ).distinct()
        level_side = level_side / split
        part = F.array(*[F.floor(F.col(x) / F.lit(level_side)) for x in xs])
        tagged = materialise(
            tagged.join(open_subs, ["cell", "sub"], "left_semi").withColumn("parent", F.col("sub")).withColumn("sub", part)
        )
        parts = tagged.groupBy("cell", "parent", "sub").agg(F.count("*").alias("n"), *_box(xs))
        child_pairs = large.select("a_cell", "b_cell", F.col("a_sub").alias("a_parent"), F.col("b_sub").alias("b_parent"))
        pairs = _with_boxes(child_pairs, parts, xs, parent=True)


def _with_boxes(pairs, boxes, xs, parent: bool = False) -> DataFrame:
    """Attach size and box of both sides; with ``parent`` every part of a parent box is paired."""
    for s in ("a", "b"):
        key = [f"{s}_cell", f"{s}_parent"] if parent else [f"{s}_cell", f"{s}_sub"]
        renamed = boxes.select(
            F.col("cell").alias(f"{s}_cell"),
            *([F.col("parent").alias(f"{s}_parent")] if parent else []),
            F.col("sub").alias(f"{s}_sub"),
            F.col("n").alias(f"{s}_n"),
            *[F.col(c).alias(f"{s}_{c}") for c in _names(xs)],
        )
        pairs = pairs.join(renamed, key)
    return pairs


def _compare(pairs, tagged, xs, e2) -> DataFrame:
    """Cell pairs with two core points in reach, comparing the points of small boxes."""
    for s in ("a", "b"):
        pairs = pairs.join(
            tagged.select(
                F.col("cell").alias(f"{s}_cell"), F.col("sub").alias(f"{s}_sub"), *[F.col(x).alias(f"{s}_{x}") for x in xs]
            ),
            [f"{s}_cell", f"{s}_sub"],
        )
    apart = _square_sum([F.col(f"a_{x}") - F.col(f"b_{x}") for x in xs])
    return pairs.where(apart <= e2).select("a_cell", "b_cell").distinct()
