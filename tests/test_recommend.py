import numpy as np
import pandas as pd
import pytest

from tallyframe.operators import recommend as R

SLOTS = {"Breakfast": "b", "Lunch": "l", "Snacks": "s", "Dinner": "d"}
DISEASES = ["Acne", "Diabetes", "Hypertension", "Weight Loss"]
DIETS = ["Vegan", "Omnivore", "Pescatarian"]


def people():
    return [
        (1, 30, 70.0, 170.0, "Male", "Sedentary", "Any", []),
        (2, 45, 60.0, 160.0, "Female", "Who knows", "vegan", ["Diabetes"]),
        (3, 25, 80.0, 180.0, "Other", "Very Active", "Keto", ["Diabetes", "Hypertension"]),
        (4, 60, 90.0, 175.0, "Male", "Lightly Active", "Omnivore", ["Made up"]),
    ]


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(
        people(),
        "profile_id int, age int, weight_kg double, height_cm double, gender string, activity_level string, diet string, conditions array<string>",
    )


@pytest.fixture(scope="module")
def catalogue(spark):
    rng = np.random.default_rng(6)
    n = 250
    pdf = pd.DataFrame(
        {
            "disease": [", ".join(rng.choice(DISEASES, rng.integers(1, 3), replace=False)) for _ in range(n)],
            "diet": rng.choice(DIETS, n),
            "b": [f"meal {i}" for i in rng.integers(0, 60, n)],
            "l": [f"lunch {i}" for i in rng.integers(0, 60, n)],
            "s": [f"snack {i}" for i in rng.integers(0, 3, n)],
            "d": rng.choice(["", "   ", "dinner 1", "dinner 2", "dinner 3"], n),
            **{c: rng.uniform(0, hi, n) for c, hi in zip(R.NUTRIENTS, (900, 60, 120, 50, 20, 40, 1500))},
        }
    )
    pdf.loc[::9, "fat"] = np.nan
    pdf.loc[0, "b"] = None
    schema = "disease string, diet string, b string, l string, s string, d string, " + ", ".join(f"{c} double" for c in R.NUTRIENTS)
    # missing nutrients are NULL in some rows and NaN in others
    rows = [
        tuple(None if isinstance(v, float) and np.isnan(v) and i % 2 else v for v in r)
        for i, r in enumerate(pdf.itertuples(index=False))
    ]
    return pdf, spark.createDataFrame(rows, schema)


def test_targets(profiles):
    got = {r["profile_id"]: r for r in R.daily_targets(profiles).collect()}
    energy = (88.362 + 13.397 * 70 + 4.799 * 170 - 5.677 * 30) * 1.2
    assert got[1]["t_calories"] == pytest.approx(energy) and got[1]["t_fat"] == pytest.approx(energy * 0.3 / 9)
    assert got[1]["t_fiber"] == 38.0
    assert got[2]["t_fiber"] == pytest.approx(25 * 1.3) and got[2]["t_sugar"] == 25.0
    assert got[2]["t_calories"] == pytest.approx((447.593 + 9.247 * 60 + 3.098 * 160 - 4.330 * 45) * 1.55)
    assert got[3]["t_sodium"] == pytest.approx(2300 * 0.6)
    slots = R.slot_targets(R.daily_targets(profiles)).where("profile_id = 1").collect()
    assert sum(r["t_calories"] for r in slots) == pytest.approx(energy) and len(slots) == 4


def brute(pdf, targets, diet, conditions, column, top_n):
    """One request against every row, row by row."""
    rows = [r for r in pdf.to_dict("records") if isinstance(r[column], str) and r[column].strip()]
    for holds in (
        lambda r: bool(set(r["disease"].split(", ")) & set(conditions)),
        lambda r: r["diet"].lower() == diet.lower(),
    ):
        rows = [r for r in rows if holds(r)] or rows  # a wish that nothing meets is dropped
    nearest, largest = {}, 0.0
    for r in rows:
        gaps = [((0.0 if np.isnan(r[n]) else r[n]) - targets[n]) / targets[n] for n in R.NUTRIENTS]
        distance = sum(R.WEIGHTS[n] * g * g for n, g in zip(R.NUTRIENTS, gaps)) ** 0.5
        largest = max(largest, distance)
        nearest[r[column]] = min(distance, nearest.get(r[column], distance))
    best = sorted(nearest.items(), key=lambda item: (item[1], item[0]))[:top_n]
    return [(text, round((1 - distance / largest) * 100, 1)) for text, distance in best]



@pytest.mark.parametrize("rows_per_box", [1, 5, 40, 10_000])
def test_matches_equal_brute_force_for_every_box_size(profiles, catalogue, rows_per_box):
    pdf, df = catalogue
    requests = R.slot_targets(R.daily_targets(profiles))
    found = R.match_top(requests, df, SLOTS, 4, rows_per_box=rows_per_box).collect()
    for r in requests.collect():
        targets = pd.Series({n: r[f"t_{n}"] for n in R.NUTRIENTS})
        want = brute(pdf, targets, r["diet"], r["conditions"], SLOTS[r["slot"]], 4)
        got = sorted((m for m in found if (m["profile_id"], m["slot"]) == (r["profile_id"], r["slot"])), key=lambda m: m["rank"])
        assert [m["suggestion"] for m in got] == [w[0] for w in want]
        assert [m["match_score"] for m in got] == pytest.approx([w[1] for w in want], abs=0.11)


@pytest.fixture(scope="module")
def many_meals(spark):
    rng = np.random.default_rng(0)
    rows = [("Acne", "Vegan", f"m{i}", *map(float, rng.uniform(100, 2000, 7))) for i in range(3000)]
    rows += [("Acne", "Vegan", f"same{i}", *[500.0] * 7) for i in range(400)]  # equal rows cannot be parted
    return spark.createDataFrame(rows, "disease string, diet string, b string, " + ", ".join(f"{c} double" for c in R.NUTRIENTS))


def test_boxes_are_small_and_few_pairs_are_scored(profiles, many_meals):
    requests = R.slot_targets(R.daily_targets(profiles)).where("slot = 'Breakfast'")
    entries = R._boxed(R._entries(many_meals, {"Breakfast": "b"}, "disease", "diet", R.NUTRIENTS, False), requests, R.NUTRIENTS, 20)
    whole = entries.where("label_key = '*' AND diet_key = '*'")
    sizes = {r["box"]: r["count"] for r in whole.groupBy("box").count().collect()}
    assert sum(sizes.values()) == 3400 and sorted(sizes.values())[-2] <= R.LARGE * 20 and max(sizes.values()) >= 400
    kept = R._boxes_to_scan(entries, requests, R.NUTRIENTS, 3)
    scored = R._pairs(kept, entries, requests).count()
    assert 0 < scored < 0.1 * requests.count() * 3400


def test_exact_cell_mode_compares_whole_cells(profiles, catalogue):
    pdf, df = catalogue
    requests = R.slot_targets(R.daily_targets(profiles)).where("profile_id = 2 AND slot = 'Lunch'")
    found = R.match_top(requests, df, SLOTS, 3, exact_cell=True).collect()
    only = pdf[(pdf["disease"] == "Diabetes") & (pdf["diet"] == "Vegan")]
    assert len(found) == 3 and {m["suggestion"] for m in found} <= set(only["l"])


def test_day_summary(profiles, catalogue):
    _, df = catalogue
    targets = R.daily_targets(profiles)
    found = R.match_top(R.slot_targets(targets), df, SLOTS, 1)
    picked = found.toPandas()
    got = {(r["profile_id"], r["nutrient"]): r for r in R.day_summary(found, targets).collect()}
    assert len(got) == 4 * 7
    total = round(picked[picked["profile_id"] == 2]["protein"].sum(), 1)
    assert got[2, "protein"]["picked"] == pytest.approx(total, abs=0.051)
    row = got[2, "protein"]
    assert row["difference_pct"] == pytest.approx((row["picked"] - row["daily_target"]) / row["daily_target"] * 100, abs=0.051)


def test_missing_columns_raise(profiles, catalogue):
    _, df = catalogue
    requests = R.slot_targets(R.daily_targets(profiles))
    with pytest.raises(ValueError, match="lacks"):
        R.match_top(requests, df.drop("b"), SLOTS)
    with pytest.raises(ValueError, match="nutrient"):
        R.match_top(requests, df.drop(*R.NUTRIENTS), SLOTS)


def test_only_the_best_of_a_box_is_written(spark, profiles, many_meals, monkeypatch):
    """Neither bounds of all requests and boxes, nor scored rows, nor rows per label and diet key are written."""
    written = []

    def watched(df):
        out = materialise(df)
        written.append(out.count())
        return out

    materialise = R.materialise
    monkeypatch.setattr(R, "materialise", watched)
    requests = R.slot_targets(R.daily_targets(profiles)).where("slot = 'Breakfast'")
    found = R.match_top(requests, many_meals, {"Breakfast": "b"}, 3, rows_per_box=20).count()
    # the rows of the catalogue, and their boxes after a second round of cuts; not under each of two label and two diet keys
    assert found == 4 * 3 and max(written) == 3400 and sorted(written)[-3] < 3400


def test_large_boxes_and_many_requests_are_dealt(profiles, catalogue, monkeypatch):
    """Boxes too large for a task are searched in parts, and requests that reach one box in shares, with the same result."""
    monkeypatch.setattr(R, "HELD_ROWS", 50)
    monkeypatch.setattr(R, "HELD_REQUESTS", 1)
    test_matches_equal_brute_force_for_every_box_size(profiles, catalogue, 10_000)


def test_equally_near_rows_go_by_suggestion_then_nutrients(spark, profiles):
    """Rows on both sides of the target are equally far, in different boxes."""
    requests = R.slot_targets(R.daily_targets(profiles)).where("profile_id = 1 AND slot = 'Breakfast'")
    target = requests.first()["t_fiber"]
    rows = [("Acne", "Vegan", name, fiber) for name, fiber in [("b", target + 1), ("b", target - 1), ("a", target + 1), ("c", target - 1), *[(f"far{i}", 100.0 + i) for i in range(90)]]]
    meals = spark.createDataFrame(rows, "disease string, diet string, b string, fiber double")
    found = R.match_top(requests, meals, {"Breakfast": "b"}, 3, rows_per_box=1).orderBy("rank").collect()
    assert [(r["suggestion"], r["fiber"]) for r in found] == [("a", target + 1), ("b", target - 1), ("c", target - 1)]


def test_requests_without_a_target_get_nothing(profiles, catalogue):
    _, df = catalogue
    requests = R.slot_targets(R.daily_targets(profiles)).withColumn("t_fat", R.F.when(R.F.col("profile_id") != 2, R.F.col("t_fat")))
    assert {r["profile_id"] for r in R.match_top(requests, df, SLOTS, 2).collect()} == {1, 3, 4}
