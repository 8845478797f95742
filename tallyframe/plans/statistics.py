"""Profiling, distribution and association queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text
from tallyframe.operators import association, profile, ranking
from tallyframe.plans.registry import Tables, plan
from tallyframe.plans.sales import rounded

NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@plan("describe_long", "AN1", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
 round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max FROM lineitem"""
    for c in NUMERIC))
def describe_long(t: Tables):
    return rounded(profile.describe(t.lineitem, NUMERIC), mean=4, std=4, q25=4, q50=4, q75=4)


PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
            "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@plan("column_profile", "AN2 A2", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{d}' AS dtype, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null,
 CAST(count({c}) AS BIGINT) AS non_null, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct FROM orders""" for c, d in PROFILED.items()))
def column_profile(t: Tables):
    return profile.column_profile(t.orders)


@plan("table_shape", "AN2", "SELECT CAST(count(*) AS BIGINT) AS n_rows, 11::INTEGER AS n_columns FROM lineitem")
def table_shape(t: Tables):
    return profile.shape(t.lineitem)


@plan("iqr_cap", "AN3 M9", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3,
                  quantile_cont(user_id, 0.25)::DOUBLE AS u1, quantile_cont(user_id, 0.75)::DOUBLE AS u3 FROM events)
SELECT event_id, round(least(greatest(value, v1 - 1.5 * (v3 - v1)), v3 + 1.5 * (v3 - v1)), 6) AS value,
       least(greatest(user_id::DOUBLE, u1 - 1.5 * (u3 - u1)), u3 + 1.5 * (u3 - u1)) AS user_id FROM events, q""")
def iqr_cap(t: Tables):
    return rounded(profile.cap_outliers(t.events.select("event_id", "value", "user_id"), ["value", "user_id"]), value=6)


@plan("feature_prep", "AN4 AR1 AR2 AN3 M8", """
WITH x AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, p_size::DOUBLE AS p_size, pow(p_retailprice - 899, 3) AS price FROM part),
q AS (SELECT quantile_cont(p_size, 0.25) AS s1, quantile_cont(p_size, 0.75) AS s3, quantile_cont(price, 0.25) AS v1, quantile_cont(price, 0.75) AS v3 FROM x)
SELECT p_partkey, word, (word = 'blue')::INTEGER AS blue, (word = 'ring')::INTEGER AS ring,
       least(greatest(p_size, s1 - 1.5 * (s3 - s1)), s3 + 1.5 * (s3 - s1)) AS p_size,
       round(ln(1 + least(greatest(price, v1 - 1.5 * (v3 - v1)), v3 + 1.5 * (v3 - v1))), 6) AS price FROM x, q""")
def feature_prep(t: Tables):
    source = t.part.select(
        "p_partkey",
        F.replace("p_name", F.lit(" "), F.lit(", ")).alias("word"),
        F.col("p_size").cast("double").alias("p_size"),
        F.pow(F.col("p_retailprice") - 899, F.lit(3)).alias("price"),
    )
    ready = profile.prepare_features(source, "word", ["p_size", "price"], ["price"], ["blue", "ring"])
    return rounded(ready, price=6)


@plan("histogram", "AN5", """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
h AS (SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 40), 39) AS BIGINT) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, round(lo + g.bin * ((hi - lo) / 40), 6) AS left_edge, round(lo + (g.bin + 1) * ((hi - lo) / 40), 6) AS right_edge,
       CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, 39)) AS bin) g CROSS JOIN b LEFT JOIN h ON g.bin = h.bin""")
def histogram(t: Tables):
    return rounded(profile.histogram(t.orders, "o_totalprice", 40), left_edge=6, right_edge=6)


@plan("histogram_auto", "AN5", """
WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n,
  2 * (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / pow(count(*), 1.0 / 3) AS width FROM orders),
k AS (SELECT *, CAST(greatest(ceil(log2(n) + 1), ceil((hi - lo) / width)) AS BIGINT) AS bins FROM b),
h AS (SELECT least(floor((o_totalprice - lo) / (hi - lo) * bins), bins - 1)::BIGINT AS bin, count(*) AS n FROM orders, k GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, round(lo + g.bin * ((hi - lo) / bins), 6) AS left_edge, round(lo + (g.bin + 1) * ((hi - lo) / bins), 6) AS right_edge,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, bins - 1)) AS bin FROM k) g CROSS JOIN k LEFT JOIN h ON g.bin = h.bin""")
def histogram_auto(t: Tables):
    return rounded(profile.histogram(t.orders, "o_totalprice"), left_edge=6, right_edge=6)


@plan("histogram_markers", "AN5", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.25), 4) AS q1,
 round(quantile_cont({c}, 0.75), 4) AS q3 FROM lineitem""" for c in NUMERIC))
def histogram_markers(t: Tables):
    return rounded(profile.markers(t.lineitem, NUMERIC), mean=4, median=4, q1=4, q3=4)


@plan("describe_with_nulls", "AN1", """
WITH d AS (SELECT o.o_totalprice, c.c_acctbal AS gone FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey < 0) c ON o.o_custkey = c.c_custkey)
""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
 min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
 max({c}) AS max FROM d""" for c in ("o_totalprice", "gone")))
def describe_with_nulls(t: Tables):
    none = t.customer.where("c_custkey < 0").select("c_custkey", F.col("c_acctbal").alias("gone"))
    joined = t.orders.select("o_custkey", "o_totalprice").join(none, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rounded(profile.describe(joined, ["o_totalprice", "gone"]), mean=4, std=4, q25=4, q50=4, q75=4)


@plan("density_curve", "AN6", """
WITH s AS (SELECT count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS w, min(value) AS lo, max(value) AS hi FROM events),
g AS (SELECT point, lo + point * ((hi - lo) / 199) AS x, n, w FROM s, (SELECT unnest(generate_series(0, 199)) AS point))
SELECT CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - value) / w, 2))) / (any_value(n) * any_value(w) * sqrt(2 * pi())), 8) AS density
FROM g, events GROUP BY point, x""")
def density_curve(t: Tables):
    return rounded(profile.density_curve(t.events, "value"), x=6, density=8)


@plan("box_stats", "AN7", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, 'value' AS "column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
       CAST(count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers,
       CAST(count(*) AS BIGINT) AS n FROM events JOIN q USING (event_type) GROUP BY ALL""")
def box_stats(t: Tables):
    return rounded(profile.box_stats(t.events, ["value"], ["event_type"]), q1=6, median=6, q3=6)


@plan("box_stats_overall", "AN7", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
       CAST(count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3 FROM lineitem)
GROUP BY q1, median, q3""" for c in NUMERIC))
def box_stats_overall(t: Tables):
    return rounded(profile.box_stats(t.lineitem, NUMERIC), q1=6, median=6, q3=6)


@plan("category_hue_counts", "AN8 S5", """
SELECT CAST(p.position AS INTEGER) AS position, p.lang, quality, CAST(n AS BIGINT) AS n
FROM (VALUES (1, 'en'), (2, 'de'), (3, 'es'), (4, 'fr'), (5, 'xx')) p(position, lang)
LEFT JOIN (SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL) c ON c.lang = p.lang""")
def category_hue_counts(t: Tables):
    labelled = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    counts = profile.category_counts(labelled, "lang", "quality")
    return ranking.in_label_order(counts, "lang", ["en", "de", "es", "fr", "xx"]).select("position", "lang", "quality", "n")


def _matrix_sql(source: str, columns) -> str:
    def r(a, b):
        return f"corr({a}, {b})" if a != b else f"CASE WHEN count({a}) > 0 THEN 1.0::DOUBLE END"

    return f"WITH d AS ({source}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({r(a, b)}, 6) AS r FROM d" for a in columns for b in columns
    )


@plan("corr_matrix", "AN9", _matrix_sql("SELECT * FROM lineitem", NUMERIC))
def corr_matrix(t: Tables):
    return rounded(association.correlation_matrix(t.lineitem, NUMERIC), r=6)


@plan("corr_matrix_flags", "AN9 AN10", _matrix_sql(
    "SELECT *, (l_returnflag = 'R')::INTEGER AS returned, (l_linestatus = 'O')::INTEGER AS open FROM lineitem", NUMERIC + ("returned", "open")))
def corr_matrix_flags(t: Tables):
    return rounded(association.correlation_matrix(flagged_lines(t), NUMERIC + ("returned", "open")), r=6)


def flagged_lines(t: Tables):
    return t.lineitem.select(
        *NUMERIC,
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_linestatus") == "O").cast("int").alias("open"),
    )


def labelled_documents(t: Tables):
    body = F.col("text")
    return t.documents.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.when(F.length(body) > 600, "long").otherwise("short").alias("extent"),
        text.char_occurrences(body, "e").alias("n_e"),
    ).join(t.labels, "doc_id")


LABELLED = """
WITH d AS (SELECT doc_id, lang, source, n_chars, CASE WHEN length(text) > 600 THEN 'long' ELSE 'short' END AS extent,
  length(text) - length(replace(lower(text), 'e', '')) AS n_e, quality, toxic FROM documents JOIN labels USING (doc_id))
"""
# two-sided Student tail by Simpson's rule over 40 units
STUDENT = """
, t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS v FROM c),
p AS (SELECT binary_column, numeric_column, r, 2 * sum(weight * exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(v * pi())
        - (v + 1) / 2 * ln(1 + pow(t + i * 0.01, 2) / v))) * 0.01 / 3 AS p_value
      FROM t, (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM (SELECT unnest(generate_series(0, 4000)) AS i))
      GROUP BY ALL)
SELECT binary_column, numeric_column, round(r, 6) AS correlation, round(p_value, 8) AS p_value, printf('%.4e', p_value) AS p_text FROM p
"""


@plan("point_biserial", "AN11", LABELLED + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS binary_column, '{n}' AS numeric_column, corr({b}, {n}) AS r, count(*) AS n FROM d"
    for b in ("quality", "toxic") for n in ("n_chars", "n_e")) + ")" + STUDENT)
def point_biserial(t: Tables):
    tested = association.point_biserial(labelled_documents(t), ["quality", "toxic"], ["n_chars", "n_e"], significant_only=False)
    return rounded(tested, correlation=6, p_value=8)


@plan("point_biserial_significant", "AN11 ST17 S2", "WITH d AS (SELECT *, (o_orderstatus = 'F')::INTEGER AS done, (o_orderpriority = '1-URGENT')::INTEGER AS urgent, "
      "CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END + o_totalprice / 100000 AS effort FROM orders), c AS (" + " UNION ALL ".join(
    f"SELECT '{b}' AS binary_column, '{n}' AS numeric_column, corr({b}, {n}) AS r, count(*) AS n FROM d"
    for b in ("done", "urgent") for n in ("o_totalprice", "effort", "o_custkey")) + ")" + STUDENT + " WHERE p_value < 0.05")
def point_biserial_significant(t: Tables):
    orders = t.orders.select(
        (F.col("o_orderstatus") == "F").cast("int").alias("done"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"),
        (F.when(F.col("o_orderstatus") == "F", 10).otherwise(0) + F.col("o_totalprice") / 100000).alias("effort"),
        "o_totalprice",
        "o_custkey",
    )
    tested = association.point_biserial(orders, ["done", "urgent"], ["o_totalprice", "effort", "o_custkey"])
    return rounded(tested, correlation=6, p_value=8)


# chi-square tail by Simpson's rule in u = sqrt(x)
CHI_TAIL = """
p AS (SELECT categorical_column, binary_column, dof, chi_square, sum(weight * 2 * exp((dof - 1) * ln(sqrt(chi_square) + i * 0.005 + 1e-300)
        - pow(sqrt(chi_square) + i * 0.005, 2) / 2 - dof / 2 * ln(2) - lgamma(dof / 2))) * 0.005 / 3 AS p_value
      FROM s, (SELECT i, CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight FROM (SELECT unnest(generate_series(0, 8000)) AS i))
      GROUP BY ALL)
SELECT categorical_column, binary_column, CAST(dof AS BIGINT) AS dof, round(chi_square, 6) AS chi_square, round(p_value, 8) AS p_value, printf('%.4e', p_value) AS p_text FROM p
"""
CELLS = LABELLED + ", k AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS categorical_column, '{b}' AS binary_column, {c} AS level, {b} AS flag, count(*) AS n FROM d GROUP BY ALL"
    for c in ("lang", "source", "extent") for b in ("quality", "toxic")) + """),
m AS (SELECT DISTINCT a.categorical_column, a.binary_column, a.level, b.flag FROM k a JOIN k b USING (categorical_column, binary_column)),
o AS (SELECT m.*, coalesce(k.n, 0) AS n FROM m LEFT JOIN k USING (categorical_column, binary_column, level, flag)),
x AS (SELECT *, sum(n) OVER (PARTITION BY categorical_column, binary_column, level) * sum(n) OVER (PARTITION BY categorical_column, binary_column, flag)
        / sum(n) OVER (PARTITION BY categorical_column, binary_column) AS e,
      (SELECT (count(DISTINCT level) - 1) * (count(DISTINCT flag) - 1) FROM k WHERE k.categorical_column = o.categorical_column AND k.binary_column = o.binary_column)::DOUBLE AS dof FROM o),
s AS (SELECT categorical_column, binary_column, dof, sum(CASE WHEN dof = 1 THEN pow(abs(n - e) - least(0.5, abs(n - e)), 2) ELSE pow(n - e, 2) END / e) AS chi_square
      FROM x GROUP BY ALL),
"""


@plan("chi2_grid", "AN12 A22", CELLS + CHI_TAIL)
def chi2_grid(t: Tables):
    tested = association.chi_square(labelled_documents(t), ["lang", "source", "extent"], ["quality", "toxic"], significant_only=False)
    return rounded(tested, chi_square=6, p_value=8)


@plan("chi2_significant", "AN12 S1", CELLS + CHI_TAIL + " WHERE p_value < 0.05")
def chi2_significant(t: Tables):
    tested = association.chi_square(labelled_documents(t), ["lang", "source", "extent"], ["quality", "toxic"])
    return rounded(tested, chi_square=6, p_value=8)


@plan("flag_share", "AN13 A21 S5", LABELLED + ", f AS (" + " UNION ALL ".join(
    f"SELECT lang, '{b}' AS flag, count(*) AS n, sum({b}) AS n_set FROM d GROUP BY lang" for b in ("quality", "toxic")) + """)
SELECT CAST(p.position AS INTEGER) AS position, p.lang, flag, CAST(n AS BIGINT) AS n, CAST(n_set AS BIGINT) AS n_set, round(n_set / n, 6) AS share
FROM (VALUES (1, 'de'), (2, 'en'), (3, 'es'), (4, 'fr')) p(position, lang) LEFT JOIN f ON f.lang = p.lang""")
def flag_share(t: Tables):
    shares = association.flag_shares(labelled_documents(t), "lang", ["quality", "toxic"])
    ordered = ranking.in_label_order(shares, "lang", ["de", "en", "es", "fr"])
    return rounded(ordered, share=6).select("position", "lang", "flag", "n", "n_set", "share")
