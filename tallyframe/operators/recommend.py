"""Nutrient targets and nearest-match suggestions for many profiles at once.

Matching is exact but does not score every profile against every row. The rows of a
slot are cut into boxes of similar nutrients by a k-d tree of medians over all weighted
nutrients, until every box fits a task. For each request the boxes that look nearest and
farthest are searched first; what they hold bounds the distance of the last top match from
above and that of the farthest row from below. Then only boxes whose own bounds beat
these are searched. A task holds one box at a time and goes down to its cells
(``box_search``); it hands on the best suggestions of a box only. Bounds of requests and
boxes, scored rows and the rows of each label and diet key are never written.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators.box_search import SLACK, answers
from tallyframe.operators.boxes import Cuts
from tallyframe.operators.ranking import top_per_group
from tallyframe.session import materialise

# Nutrients in report order with their weight in the distance.
WEIGHTS = {
    "calories": 3.0,
    "protein": 2.5,
    "carbohydrates": 1.5,
    "fat": 1.5,
    "fiber": 1.0,
    "sugar": 1.0,
    "sodium": 1.0,
}
# Share of the daily targets per meal slot.
SLOT_SHARES = {"Breakfast": 0.25, "Lunch": 0.35, "Snacks": 0.10, "Dinner": 0.30}
# Energy multiplier per activity level, and the one for unknown levels.
ACTIVITY_FACTORS = {
    "Sedentary": 1.2,
    "Lightly Active": 1.375,
    "Moderately Active": 1.55,
    "Very Active": 1.725,
    "Extremely Active": 1.9,
}
DEFAULT_ACTIVITY_FACTOR = 1.55
# Energy formula coefficients (constant, per kg, per cm, per year of age).
ENERGY_MALE = (88.362, 13.397, 4.799, -5.677)
ENERGY_OTHER = (447.593, 9.247, 3.098, -4.330)
# Target factor per condition and nutrient.
CONDITION_FACTORS = {
    "Diabetes": {"sugar": 0.5, "carbohydrates": 0.75, "fiber": 1.3},
    "Hypertension": {"sodium": 0.6, "fat": 0.85},
    "Heart Disease": {"fat": 0.8, "sodium": 0.65, "fiber": 1.2},
    "Kidney Disease": {"protein": 0.7, "sodium": 0.6, "carbohydrates": 1.1},
    "Acne": {"sugar": 0.7, "fat": 0.85},
    "Weight Gain": {"calories": 1.15, "protein": 1.2},
    "Weight Loss": {"calories": 0.8, "fat": 0.8, "sugar": 0.75},
}
NUTRIENTS = tuple(WEIGHTS)
ANY_DIET = "Any"

ROWS_PER_BOX = 16_384
LARGE = 4  # times as many rows and a box is cut again
SAMPLE_PER_BOX = 16  # rows of a box that place the cuts
MAX_BOXES = 4_096  # boxes that one round makes, which bounds its sample and its trees
HELD_ROWS = 1 << 16  # rows of a box that a task holds: boxes of equal rows are dealt by suggestion
HELD_REQUESTS = 1 << 14  # requests that meet one copy of a box
EVERY = "*"


def _lookup(pairs: Mapping[str, float], key: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for item in pairs.items() for x in item])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def daily_targets(profiles: DataFrame) -> DataFrame:
    """Profiles with one ``t_<nutrient>`` column each.

    Needs profile_id, age, weight_kg, height_cm, gender, activity_level and
    conditions (array of strings); every listed condition scales its nutrients.
    """
    male = F.col("gender") == "Male"

    def energy(c):
        return F.lit(c[0]) + c[1] * F.col("weight_kg") + c[2] * F.col("height_cm") + c[3] * F.col("age")

    base = F.when(male, energy(ENERGY_MALE)).otherwise(energy(ENERGY_OTHER))
    total = base * _lookup(ACTIVITY_FACTORS, F.col("activity_level"), DEFAULT_ACTIVITY_FACTOR)
    plain = {
        "calories": total,
        "protein": total * 0.30 / 4,
        "carbohydrates": total * 0.40 / 4,
        "fat": total * 0.30 / 9,
        "fiber": F.when(F.col("gender") == "Female", 25.0).otherwise(38.0),
        "sugar": F.lit(50.0),
        "sodium": F.lit(2300.0),
    }
    conditions = F.coalesce("conditions", F.array().cast("array<string>"))

    def scaled(nutrient):
        factors = {c: f[nutrient] for c, f in CONDITION_FACTORS.items() if nutrient in f}
        return F.aggregate(conditions, F.lit(1.0), lambda acc, c: acc * _lookup(factors, c, 1.0))

    return profiles.withColumns({f"t_{n}": plain[n] * scaled(n) for n in NUTRIENTS})


def slot_targets(targets: DataFrame) -> DataFrame:
    """One row per profile and meal slot with that slot's share of every target."""
    shares = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(v).alias("share")) for s, v in SLOT_SHARES.items()])
    wanted = [f"t_{n}" for n in NUTRIENTS]
    others = [c for c in targets.columns if c not in wanted]
    return targets.select(*others, *wanted, F.inline(shares)).select(
        *others, "slot", *[(F.col(w) * F.col("share")).alias(w) for w in wanted]
    )


def _entries(catalogue: DataFrame, suggestions: Mapping[str, str], labels: str, diet: str, nutrients: Sequence[str], exact_cell: bool) -> DataFrame:
    """Distinct (slot, suggestion, label keys, diet keys, nutrients) of the catalogue."""
    absent = [c for c in (*suggestions.values(), labels, diet) if c not in catalogue.columns]
    if absent:
        raise ValueError(f"catalogue lacks columns {absent}")
    listed = F.array(F.col(labels)) if exact_cell else text.split_labels(F.col(labels))
    known = F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull())
    keys = F.array_sort(F.array_distinct(F.transform(known, lambda x: F.concat(F.lit("="), x))))
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(c).alias("suggestion")) for s, c in suggestions.items()])
    rows = catalogue.select(
        F.array_append(keys, F.lit(EVERY)).alias("label_keys"),
        F.array_compact(F.array(F.lit(EVERY), F.concat(F.lit("="), F.lower(F.col(diet))))).alias("diet_keys"),
        *[F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(n) for n in nutrients],
        F.inline(slots),
    )
    present = rows.where(text.is_present(F.col("suggestion")))
    return present.repartition("slot", "suggestion", *nutrients).distinct()  # dealt once: few rows are equal, so counting before the shuffle saves nothing


def _cut(rows: DataFrame, trees: Mapping[tuple, Cuts], nutrients: Sequence[str], width: Mapping[str, float]) -> Column:
    """The box of a row, continued by its leaf where the box has a tree."""
    weights = np.array([width[n] for n in nutrients])
    given = rows.sparkSession.sparkContext.broadcast(dict(trees))

    @F.arrow_udf("string")
    def cut(slot: pa.Array, box: pa.Array, *columns: pa.Array) -> pa.Array:
        values = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1) * weights
        slots, boxes = slot.dictionary_encode(), box.dictionary_encode()
        slot_names, names = slots.dictionary.to_pylist(), boxes.dictionary.to_pylist()
        known = len(names)
        number = slots.indices.to_numpy().astype(np.int64) * known + boxes.indices.to_numpy()
        out = boxes.indices.to_numpy().astype(np.int64)
        for i in np.unique(number).tolist():
            key = slot_names[i // known], names[i % known]
            tree = given.value.get(key)
            if tree is not None:
                some = np.flatnonzero(number == i)
                leaves, leaf = np.unique(tree.leaf(values[some]), return_inverse=True)
                out[some] = len(names) + leaf
                names += [f"{key[1]}.{x}" for x in leaves.tolist()]
        return pa.array(names, pa.string()).take(pa.array(out))

    return cut("slot", "box", *nutrients)


def _boxed(entries: DataFrame, wanted: DataFrame, nutrients: Sequence[str], rows_per_box: int) -> DataFrame:
    """``entries`` spread over their label and diet keys, with the ``box`` of each row.

    A sample of bounded size places the cuts of a round; boxes that come out too large
    are sampled and cut again, unless all their rows are equal. So boxes hold at most
    ``LARGE * rows_per_box`` rows however large or skewed the table is. Boxes follow from
    the cuts alone; nothing is written unless several rounds are needed.
    """
    typical = wanted.agg(*[F.avg(F.abs(f"t_{n}")).alias(n) for n in nutrients]).first()
    width = {n: WEIGHTS[n] ** 0.5 / (typical[n] or 1.0) for n in nutrients}
    current, rounds = entries.withColumn("box", F.lit("")), 0
    while True:
        limits = [F.array(*[e(n) for n in nutrients]).alias(name) for e, name in ((F.min, "low"), (F.max, "high"))]
        facts = current.groupBy("slot", "box").agg(F.count("*").alias("n"), *limits)
        most = LARGE * rows_per_box if rounds else rows_per_box
        large = facts.where((F.col("n") > most) & (F.col("low") != F.col("high"))).orderBy(F.desc("n"), "slot", "box").limit(MAX_BOXES).collect()
        if not large:
            break
        total = sum(r["n"] for r in large)
        share = min(1.0, MAX_BOXES * rows_per_box / total)  # of the wanted leaves, if they are too many for one round
        leaves = {(r["slot"], r["box"]): max(2, int(share * r["n"] / rows_per_box)) for r in large}
        asked = [(*key, SAMPLE_PER_BOX * n / r["n"]) for r, (key, n) in zip(large, leaves.items(), strict=True)]
        chances = F.broadcast(entries.sparkSession.createDataFrame(asked, "slot string, box string, chance double"))
        sample = current.join(chances, ["slot", "box"]).where(F.rand(0) < F.col("chance")).select("slot", "box", *nutrients).toPandas()
        scale = np.array([width[n] for n in nutrients])
        sampled = {key: rows[list(nutrients)].to_numpy() * scale for key, rows in sample.groupby(["slot", "box"], sort=False)}
        trees = {}
        for r in large:
            key = r["slot"], r["box"]
            none = np.zeros((0, len(nutrients)))
            trees[key] = Cuts(sampled.get(key, none), leaves[key], np.array(r["low"]) * scale, np.array(r["high"]) * scale)
        current, rounds = current.withColumn("box", _cut(entries, trees, nutrients, width)), rounds + 1
        if rounds > 1:
            current = materialise(current)
    return current.select("*", F.explode("label_keys").alias("label_key")).select("*", F.explode("diet_keys").alias("diet_key"))


def _effective_blocks(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """(profile_id, slot, label_key, diet_key) to search per request.

    Conditions are kept only if one of them occurs in the slot, then the diet only
    if it occurs among the rows left; otherwise that filter is dropped.
    """
    request = ["profile_id", "slot"]
    have = blocks.select("slot", "label_key", "diet_key").distinct()
    wishes = requests.select(*request, F.explode(F.array_distinct("conditions")).alias("c")).select(
        *request, F.concat(F.lit("="), "c").alias("label_key")
    )
    some = have.where(F.col("diet_key") == EVERY).select("slot", "label_key")
    hits = wishes.join(some, ["slot", "label_key"], "left_semi").select(*request, "label_key")
    missed = requests.select(*request).join(hits.select(*request).distinct(), request, "left_anti")
    labels = hits.unionByName(missed.withColumn("label_key", F.lit(EVERY)))
    diets = requests.where(~F.lower("diet").isin(ANY_DIET.lower(), "")).select(
        *request, F.concat(F.lit("="), F.lower("diet")).alias("diet_key")
    )
    diet_hits = labels.join(diets, request).join(have, ["slot", "label_key", "diet_key"], "left_semi")
    open_diet = labels.join(diet_hits.select(*request).distinct(), request, "left_anti")
    return diet_hits.select(*request, "label_key", "diet_key").unionByName(
        open_diet.select(*request, "label_key", F.lit(EVERY).alias("diet_key"))
    )


def match_top(
    requests: DataFrame,
    catalogue: DataFrame,
    suggestions: Mapping[str, str],
    top_n: int = 5,
    labels: str = "disease",
    diet: str = "diet",
    exact_cell: bool = False,
    rows_per_box: int = ROWS_PER_BOX,
) -> DataFrame:
    """The ``top_n`` best suggestions per profile and slot.

    ``requests`` is ``slot_targets`` output with profile_id, slot, diet,
    conditions and the targets. The score is (1 - distance / largest distance of
    the searched rows) in percent with one decimal; a suggestion counts once with
    its best row. Ties go to the smaller suggestion text. ``exact_cell`` compares
    the whole label cell instead of its labels. ``rows_per_box`` never changes the
    result. NULL and NaN nutrients count as 0.
    """
    nutrients = [n for n in NUTRIENTS if n in catalogue.columns]
    if not nutrients:
        raise ValueError("catalogue has no nutrient columns")
    request = ["profile_id", "slot"]
    wanted = materialise(requests.select(*request, "diet", "conditions", *[f"t_{n}" for n in nutrients]))
    distinct = materialise(_entries(catalogue, suggestions, labels, diet, nutrients, exact_cell))
    entries = _boxed(distinct, wanted, nutrients, rows_per_box)
    kept = materialise(_boxes_to_scan(entries, wanted, nutrients, top_n))
    found = materialise(_searched(kept, entries, nutrients, top_n))
    # of equally near rows of a suggestion the one with the smallest nutrients
    best = found.where("suggestion IS NOT NULL").groupBy(*request, "suggestion").agg(F.min(F.struct("distance", *nutrients)).alias("row"))
    ranked = top_per_group(best.select(*request, "suggestion", "row.*"), request, [F.col("distance"), F.col("suggestion")], top_n, "rank")
    largest = found.groupBy(*request).agg(F.max("far").alias("largest"))
    relative = F.col("distance") / F.when(F.col("largest") > 0, F.col("largest")).otherwise(1.0)
    return ranked.join(largest, request).select(
        *request, "rank", "suggestion", F.round((1 - relative) * 100, 1).alias("match_score"), "distance", *nutrients
    )


def _pairs(kept: DataFrame, entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every request beside the rows of its kept boxes that carry the asked labels and diet: what boxes leave to be searched."""
    found = kept.select("profile_id", "slot", "label_key", "diet_key", "box", "is_near", "is_far")
    return found.join(wanted.drop("diet", "conditions"), ["profile_id", "slot"]).join(entries, ["slot", "label_key", "diet_key", "box"])


def _searched(asked: DataFrame, entries: DataFrame, nutrients: Sequence[str], top_n: int) -> DataFrame:
    """(profile_id, slot, suggestion, distance, nutrients, far): the answers of the ``asked`` boxes.

    Per request and box the nearest suggestions with their best rows where ``is_near``,
    and the largest distance where ``is_far``. A place is a box, or a part of its
    suggestions where it is too large for a task, beside a share of its requests; only
    boxes that are asked for are sent to a place.
    """
    counted = asked.groupBy("slot", "box").agg(F.count("*").alias("n"), F.max("box_rows").alias("rows"))
    sized = counted.select(
        "slot", "box", F.ceil(F.col("rows") / HELD_ROWS).cast("int").alias("parts"), F.ceil(F.col("n") / HELD_REQUESTS).cast("int").alias("deals")
    )
    dealt = sized.select("*", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    dealt = dealt.select("*", F.explode(F.expr("sequence(0, deals - 1)")).alias("deal"))
    places = materialise(dealt.withColumn("place", F.monotonically_increasing_id()))
    targets = [f"t_{n}" for n in nutrients]
    asks = asked.join(places, ["slot", "box"]).where(F.pmod(F.xxhash64("profile_id", *targets), "deals") == F.col("deal")).select(
        "place", F.lit(1).alias("kind"), "profile_id", "slot", "label_key", "diet_key", *[F.col(t).alias(n) for t, n in zip(targets, nutrients, strict=True)],
        "is_near", "is_far", "last", "reached",
    )
    whole = entries.where((F.col("label_key") == EVERY) & (F.col("diet_key") == EVERY)).drop("label_key", "diet_key")
    rows = whole.join(places, ["slot", "box"]).where(F.pmod(F.xxhash64("suggestion"), "parts") == F.col("part")).select(
        "place", F.lit(0).alias("kind"), "suggestion", "label_keys", "diet_keys", *nutrients
    )
    order = ["place", "kind", "label_key", "diet_key", "suggestion", *nutrients]
    sorted_rows = rows.unionByName(asks, allowMissingColumns=True).repartition("place").sortWithinPartitions(*order)
    weights = np.array([WEIGHTS[n] for n in nutrients])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answers(batches, nutrients, weights, top_n)

    kind = asked.schema["profile_id"].dataType.simpleString()
    numbers = ", ".join(f"{n} double" for n in nutrients)
    return sorted_rows.mapInArrow(search, f"profile_id {kind}, slot string, suggestion string, distance double, {numbers}, far double")


def _boxes_to_scan(entries: DataFrame, wanted: DataFrame, nutrients: Sequence[str], top_n: int) -> DataFrame:
    """Per request the boxes that can hold a top match (is_near) or the farthest row (is_far).

    With them go the targets, the rows of the box, and what is known of the request:
    ``last``, which no top match is farther than, and ``reached``, the largest distance so far.
    """
    request, block = ["profile_id", "slot"], ["slot", "label_key", "diet_key"]
    limits = [e(n).alias(f"{name}_{n}") for e, name in ((F.min, "lo"), (F.max, "hi")) for n in nutrients]
    held = entries.groupBy(*block, "box").agg(F.count("*").alias("n"), *limits)
    whole = F.max(F.when((F.col("label_key") == EVERY) & (F.col("diet_key") == EVERY), F.col("n"))).over(Window.partitionBy("slot", "box"))
    boxes = materialise(held.withColumn("box_rows", whole).drop("n"))
    # one factor per request and nutrient: weight over the squared target
    factors = [(F.lit(WEIGHTS[n]) / F.when(F.col(f"t_{n}") == 0, 1.0).otherwise(F.col(f"t_{n}") * F.col(f"t_{n}"))).alias(f"w_{n}") for n in nutrients]
    targets = [f"t_{n}" for n in nutrients]
    known = wanted.select(*request, *targets).where(reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in targets])).distinct()
    # few rows that each meet many boxes: all cores take a share
    cores = entries.sparkSession.sparkContext.defaultParallelism
    searches = materialise(_effective_blocks(wanted, boxes).distinct().join(known, request).select("*", *factors)).repartition(cores)

    def bound(pick) -> Column:
        gaps = [pick(F.col(f"lo_{n}") - F.col(f"t_{n}"), F.col(f"hi_{n}") - F.col(f"t_{n}")) for n in nutrients]
        return reduce(lambda a, b: a + b, [g * g * F.col(f"w_{n}") for g, n in zip(gaps, nutrients, strict=True)])

    nearest = bound(lambda low, high: F.greatest(F.lit(0.0), low, -high)) * (1 - SLACK)
    farthest = bound(lambda low, high: F.greatest(-low, high)) * (1 + SLACK)  # the farther corner: never negative, as low is at most high

    def chosen(asked: DataFrame, near: Column, far: Column) -> DataFrame:
        """The boxes that pass; what is known of a request stands beside it before it meets the boxes, so only these leave the join.

        Near and far boxes are found one after the other, which keeps the code of a row short enough to be compiled.
        """
        columns = [*request, "label_key", "diet_key", "box", "box_rows", *targets, "last", "reached"]
        met = asked.join(boxes, block)
        parts = [met.where(c).select(*columns, F.lit(i == 0).alias("is_near"), F.lit(i == 1).alias("is_far")) for i, c in enumerate((near, far))]
        return parts[0].unionByName(parts[1])

    met = searches.join(boxes, block)
    ends = met.groupBy(*request).agg(F.min(nearest).alias("least")).join(met.groupBy(*request).agg(F.max(farthest).alias("most")), request)
    unknown = [F.lit(None).cast("double").alias(c) for c in ("last", "reached")]
    first = materialise(chosen(searches.join(ends, request).select("*", *unknown), nearest <= F.col("least"), farthest >= F.col("most")))
    found = materialise(_searched(first, entries, nutrients, top_n))
    apart = found.where("suggestion IS NOT NULL").groupBy(*request, "suggestion").agg(F.min("distance").alias("distance"))
    last = top_per_group(apart, request, [F.col("distance"), F.col("suggestion")], top_n)
    # with fewer suggestions than asked for there is no bound on the last one yet
    bounds = (
        found.groupBy(*request).agg(F.max("far").alias("reached"))
        .join(last.groupBy(*request).agg(F.count("*").alias("n"), F.max("distance").alias("last")), request, "left")
        .select(*request, "reached", F.when(F.col("n") >= top_n, F.col("last")).alias("last"))
    )
    within = F.col("last").isNull() | (nearest <= F.col("last") * F.col("last"))
    return chosen(searches.join(bounds, request), within, farthest >= F.col("reached") * F.col("reached"))


def day_summary(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Top pick of every slot summed per nutrient against the daily target."""
    nutrients = [n for n in NUTRIENTS if n in matches.columns]
    sums = matches.where(F.col("rank") == 1).groupBy("profile_id").agg(*[F.sum(n).alias(n) for n in nutrients])
    joined = targets.select("profile_id", *[f"t_{n}" for n in nutrients]).join(sums, "profile_id")
    entries = ", ".join(f"'{n}', round(t_{n}, 1), round({n}, 1)" for n in nutrients)
    long = joined.selectExpr(
        "profile_id", f"stack({len(nutrients)}, {entries}) as (nutrient, daily_target, picked)"
    )
    base = F.when(F.col("daily_target") == 0, 1.0).otherwise(F.col("daily_target"))
    return long.withColumn("difference_pct", F.round((F.col("picked") - F.col("daily_target")) / base * 100, 1))


def plan_rows(matches: DataFrame) -> DataFrame:
    """The tagged plan for export: slot first, then the suggestions in rank order."""
    nutrients = [n for n in NUTRIENTS if n in matches.columns]
    return matches.select(
        "profile_id", F.col("slot").alias("meal_slot"), "rank", "match_score", F.col("suggestion").alias("suggested_meal"), *nutrients
    )
