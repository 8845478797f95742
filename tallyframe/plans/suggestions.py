"""Recommendation queries.

The searches are the customers whose key is divisible by 50, a stated set that grows
with the data; the catalogue is every part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import recommend
from tallyframe.plans.registry import Tables, plan
from tallyframe.plans.sales import rounded
from tallyframe.session import materialise, scratch_path
from tallyframe.sources import files

# Diet names of the matching vocabulary.
CONDITIONS = sorted(recommend.CONDITION_FACTORS)
DIETS = ["Vegetarian", "Vegan", "Omnivore", "Pescatarian"]
ACTIVITIES = [*recommend.ACTIVITY_FACTORS, "Unknown"]
SUGGESTIONS = {"Breakfast": "breakfast", "Lunch": "lunch", "Snacks": "snack", "Dinner": "dinner"}
NUTRIENTS = list(recommend.NUTRIENTS)


def _pick(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def profiles(t: Tables):
    k = F.col("c_custkey")
    first, second = _pick(CONDITIONS, k % 7), _pick(CONDITIONS, (k * 3 + 1) % 7)
    conditions = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(first)).otherwise(F.array(first, second))
    return t.customer.where(k % 50 == 0).select(
        k.alias("profile_id"),
        (20 + k % 60).alias("age"),
        (50 + F.col("c_nationkey") * 2).cast("double").alias("weight_kg"),
        (150 + k % 47).cast("double").alias("height_cm"),
        F.when(k % 2 == 0, "Male").otherwise("Female").alias("gender"),
        _pick(ACTIVITIES, k % 6).alias("activity_level"),
        _pick([*DIETS, "Any"], F.expr("c_custkey div 50") % 5).alias("diet"),
        conditions.alias("conditions"),
    )


def catalogue(t: Tables):
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    return t.part.select(
        F.concat(_pick(CONDITIONS, size % 6), F.lit(", "), _pick(CONDITIONS, (size * 5 + 3) % 6)).alias("disease"),
        _pick(DIETS, k % 4).alias("diet"),
        F.when(size % 10 == 0, "  ").otherwise(F.col("p_name")).alias("breakfast"),
        F.concat_ws(" ", "p_type", "p_name").alias("lunch"),
        F.concat_ws(" ", "p_brand", "p_name").alias("snack"),
        F.when(size % 7 != 0, F.concat_ws(" ", "p_brand", "p_type")).alias("dinner"),
        (price * 0.75).alias("calories"),
        (size * 1.5).alias("protein"),
        (k * 7 % 113).cast("double").alias("carbohydrates"),
        (k * 3 % 41).cast("double").alias("fat"),
        (size % 13).cast("double").alias("fiber"),
        (k * 11 % 59).cast("double").alias("sugar"),
        (price * size / 50).alias("sodium"),
    )


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _factor(nutrient: str) -> str:
    cases = " ".join(
        f"WHEN '{c}' THEN {f[nutrient]}::DOUBLE" for c, f in recommend.CONDITION_FACTORS.items() if nutrient in f
    )
    at = lambda i: f"(CASE conditions[{i}] {cases} ELSE 1.0::DOUBLE END)"
    return f"(CASE WHEN len(conditions) > 0 THEN {at(1)} ELSE 1.0::DOUBLE END * CASE WHEN len(conditions) > 1 THEN {at(2)} ELSE 1.0::DOUBLE END)"


def _energy(c) -> str:
    return f"{c[0]}::DOUBLE + {c[1]}::DOUBLE * weight_kg + {c[2]}::DOUBLE * height_cm + {c[3]}::DOUBLE * age"


PROFILES_SQL = f"""
WITH u AS (SELECT c_custkey AS profile_id, 20 + c_custkey % 60 AS age, (50 + c_nationkey * 2)::DOUBLE AS weight_kg, (150 + c_custkey % 47)::DOUBLE AS height_cm,
  CASE WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender, {_list(ACTIVITIES)}[c_custkey % 6 + 1] AS activity_level,
  {_list([*DIETS, 'Any'])}[c_custkey // 50 % 5 + 1] AS diet,
  CASE c_custkey % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN [{_list(CONDITIONS)}[c_custkey % 7 + 1]]
    ELSE [{_list(CONDITIONS)}[c_custkey % 7 + 1], {_list(CONDITIONS)}[(c_custkey * 3 + 1) % 7 + 1]] END AS conditions
  FROM customer WHERE c_custkey % 50 = 0),
energy AS (SELECT *, CASE WHEN gender = 'Male' THEN {_energy(recommend.ENERGY_MALE)} ELSE {_energy(recommend.ENERGY_OTHER)} END
  * CASE activity_level {' '.join(f"WHEN '{a}' THEN {f}::DOUBLE" for a, f in recommend.ACTIVITY_FACTORS.items())}
    ELSE {recommend.DEFAULT_ACTIVITY_FACTOR}::DOUBLE END AS total FROM u),
targets AS (SELECT profile_id, diet, conditions, total * {_factor('calories')} AS t_calories, total * 0.30::DOUBLE / 4 * {_factor('protein')} AS t_protein,
  total * 0.40::DOUBLE / 4 * {_factor('carbohydrates')} AS t_carbohydrates, total * 0.30::DOUBLE / 9 * {_factor('fat')} AS t_fat,
  CASE WHEN gender = 'Female' THEN 25::DOUBLE ELSE 38::DOUBLE END * {_factor('fiber')} AS t_fiber,
  50::DOUBLE * {_factor('sugar')} AS t_sugar, 2300::DOUBLE * {_factor('sodium')} AS t_sodium FROM energy)
"""
SLOTS_SQL = PROFILES_SQL + f""",
slots AS (SELECT profile_id, diet, conditions, slot, {', '.join(f't_{n} * share AS t_{n}' for n in NUTRIENTS)} FROM targets,
  (VALUES ('Breakfast', 0.25::DOUBLE), ('Lunch', 0.35::DOUBLE), ('Snacks', 0.1::DOUBLE), ('Dinner', 0.3::DOUBLE)) v(slot, share))
"""
MATCH_SQL = SLOTS_SQL + f""",
c AS (SELECT [{_list(CONDITIONS)}[p_size % 6 + 1], {_list(CONDITIONS)}[(p_size * 5 + 3) % 6 + 1]] AS labels, lower({_list(DIETS)}[p_partkey % 4 + 1]) AS food,
  CASE WHEN p_size % 10 = 0 THEN '  ' ELSE p_name END AS breakfast, p_type || ' ' || p_name AS lunch, p_brand || ' ' || p_name AS snack,
  CASE WHEN p_size % 7 <> 0 THEN p_brand || ' ' || p_type END AS dinner, p_retailprice * 0.75::DOUBLE AS calories, p_size * 1.5::DOUBLE AS protein,
  (p_partkey * 7 % 113)::DOUBLE AS carbohydrates, (p_partkey * 3 % 41)::DOUBLE AS fat, (p_size % 13)::DOUBLE AS fiber, (p_partkey * 11 % 59)::DOUBLE AS sugar,
  p_retailprice * p_size / 50 AS sodium FROM part),
long AS (SELECT 'Breakfast' AS slot, breakfast AS suggestion, * FROM c UNION ALL SELECT 'Lunch', lunch, * FROM c
  UNION ALL SELECT 'Snacks', snack, * FROM c UNION ALL SELECT 'Dinner', dinner, * FROM c),
pairs AS (SELECT *, list_has_any(labels, conditions) AS fits FROM slots JOIN long USING (slot) WHERE suggestion IS NOT NULL AND trim(suggestion) <> ''),
p1 AS (SELECT *, bool_or(fits) OVER (PARTITION BY profile_id, slot) AS some_fit FROM pairs),
p2 AS (SELECT *, food = lower(diet) AS same_diet FROM p1 WHERE fits OR NOT some_fit),
p3 AS (SELECT *, bool_or(same_diet) OVER (PARTITION BY profile_id, slot) AS some_diet FROM p2),
scored AS (SELECT *, sqrt(0::DOUBLE + {' + '.join(f'(({n} - t_{n}) / t_{n}) * (({n} - t_{n}) / t_{n}) * {w}::DOUBLE' for n, w in recommend.WEIGHTS.items())}) AS distance
  FROM p3 WHERE diet = 'Any' OR same_diet OR NOT some_diet),
m AS (SELECT *, max(distance) OVER (PARTITION BY profile_id, slot) AS largest FROM scored),
best AS (SELECT *, row_number() OVER (PARTITION BY profile_id, slot, suggestion ORDER BY distance, {', '.join(NUTRIENTS)}) AS rn FROM m),
top AS (SELECT *, row_number() OVER (PARTITION BY profile_id, slot ORDER BY distance, suggestion) AS rank FROM best WHERE rn = 1)
"""
TARGETS = [f"t_{n}" for n in NUTRIENTS]


@plan("profile_targets", "RC1", PROFILES_SQL + f"""
SELECT profile_id, {', '.join(f't_{n}' for n in NUTRIENTS)} FROM targets""")
def profile_targets(t: Tables):
    return recommend.daily_targets(profiles(t)).select("profile_id", *TARGETS)


@plan("slot_targets", "RC2", SLOTS_SQL + f"""
SELECT profile_id, slot, {', '.join(f't_{n}' for n in NUTRIENTS)} FROM slots""")
def slot_targets(t: Tables):
    split = recommend.slot_targets(recommend.daily_targets(profiles(t)))
    return split.select("profile_id", "slot", *TARGETS)


def matches(t: Tables, top_n: int = 5):
    requests = recommend.slot_targets(recommend.daily_targets(profiles(t)))
    return recommend.match_top(requests, catalogue(t), SUGGESTIONS, top_n)


@plan("match_topn", "RC3 RC4 PF12 PF13 W4 W5 M10", MATCH_SQL + """
SELECT profile_id, slot, CAST(rank AS INTEGER) AS rank, suggestion, round((1 - distance / largest) * 100, 1) AS match_score,
       round(distance, 6) AS distance, """ + ", ".join(f"round({n}, 4) AS {n}" for n in NUTRIENTS) + """ FROM top WHERE rank <= 5""")
def match_topn(t: Tables):
    return rounded(matches(t), distance=6, **dict.fromkeys(NUTRIENTS, 4))


@plan("day_summary", "RC5", MATCH_SQL + f""",
d AS (SELECT profile_id, {', '.join(f'sum({n}) AS {n}' for n in NUTRIENTS)} FROM top WHERE rank = 1 GROUP BY profile_id)
""" + " UNION ALL ".join(
    f"""SELECT profile_id, '{n}' AS nutrient, round(t_{n}, 1) AS daily_target, round({n}, 1) AS picked,
 round((round({n}, 1) - round(t_{n}, 1)) / round(t_{n}, 1) * 100, 1) AS difference_pct FROM targets JOIN d USING (profile_id)""" for n in NUTRIENTS))
def day_summary(t: Tables):
    targets = recommend.daily_targets(profiles(t))
    found = recommend.match_top(recommend.slot_targets(targets), catalogue(t), SUGGESTIONS, 1)
    return recommend.day_summary(found, targets)


@plan("plan_export", "RC6 U3 IO3", MATCH_SQL + """
SELECT profile_id, slot AS meal_slot, CAST(rank AS INTEGER) AS rank, round((1 - distance / largest) * 100, 1) AS match_score,
       suggestion AS suggested_meal, """ + ", ".join(f"round({n}, 4) AS {n}" for n in NUTRIENTS) + """ FROM top WHERE rank <= 3""")
def plan_export(t: Tables):
    path = scratch_path(t.spark, "plan")
    rows = rounded(recommend.plan_rows(matches(t, 3)), **dict.fromkeys(NUTRIENTS, 4))
    files.write_csv(rows, path)
    return files.read_csv(t.spark, path, rows.schema)
