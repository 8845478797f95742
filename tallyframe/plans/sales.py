"""Sales, returns and buyer segmentation queries.

A line flagged R is a return: its quantity is negative and its refund is the
negative line price. Totals are summed on the line's own keys before any join.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import dates
from tallyframe.operators import orders as ops
from tallyframe.operators import ranking, segments
from tallyframe.operators.profile import describe, histogram
from tallyframe.plans.registry import Tables, plan
from tallyframe.session import materialise

LINES = """
WITH lines AS (SELECT *, l_returnflag = 'R' AS back, l_extendedprice * (1 - l_discount) AS paid FROM lineitem)
"""
SUMS = """
 CAST(count(*) FILTER (NOT back) AS BIGINT) AS n_sales, CAST(count(*) FILTER (back) AS BIGINT) AS n_returns,
 sum(paid) FILTER (NOT back) AS gross, sum(l_extendedprice) FILTER (back) AS refunds,
 sum(l_quantity) FILTER (NOT back) AS units, sum(l_quantity) FILTER (back) AS returned_units
"""


def order_lines(t: Tables):
    back = F.col("l_returnflag") == "R"
    return t.lineitem.select(
        "l_orderkey",
        "l_partkey",
        F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(back, 0.0).otherwise(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.when(back, -F.col("l_extendedprice")).otherwise(0.0).alias("refunds"),
        F.when(back, 0.0).otherwise(F.col("l_quantity")).alias("units_sold"),
        F.when(back, -F.col("l_quantity")).otherwise(0.0).alias("units_returned"),
    )


def totals_by_date_part(t: Tables, part, name: str):
    """Totals per date part: summed per order, then re-summed after the join."""
    per_order = ops.order_totals(order_lines(t), ["l_orderkey"])
    dated = per_order.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return ops.combine_totals(dated, [part(F.col("o_orderdate")).alias(name)])


def totals_by_item(t: Tables, key: str):
    """Totals per part attribute: summed per part, then re-summed after the join."""
    per_part = ops.order_totals(order_lines(t), ["l_partkey"])
    return ops.combine_totals(per_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")), [key])


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@plan("financial_summary", "AN22 PF11", LINES + f"""
SELECT n_sales, n_returns, round(gross, 4) AS gross, round(refunds, 2) AS refunds, round(gross - refunds, 4) AS net,
       round(100.0 * n_returns / n_sales, 6) AS return_ratio_pct FROM (SELECT {SUMS} FROM lines)""")
def financial_summary(t: Tables):
    summary = ops.financial_summary(ops.order_totals(order_lines(t)))
    return rounded(summary, gross=4, refunds=2, net=4, return_ratio_pct=6)


MONTHLY = LINES + f""", m AS (SELECT strftime(o_orderdate, '%Y-%m') AS year_month, {SUMS}
FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
"""


@plan("monthly_net", "AN23 A15", MONTHLY + """
SELECT year_month, round(gross, 4) AS gross, round(refunds, 2) AS refunds, round(gross - refunds, 4) AS net,
       units, returned_units, units - returned_units AS net_units FROM m""")
def monthly_net(t: Tables):
    monthly = ops.period_net(totals_by_date_part(t, dates.year_month, "year_month"), "year_month")
    return rounded(monthly, gross=4, refunds=2, net=4)


@plan("mom_change", "W1", MONTHLY + """
SELECT year_month, round(gross, 4) AS gross,
       round((gross - lag(gross) OVER (ORDER BY year_month)) / lag(gross) OVER (ORDER BY year_month) * 100, 6) AS change_pct
FROM m""")
def mom_change(t: Tables):
    monthly = totals_by_date_part(t, dates.year_month, "year_month").select("year_month", "gross")
    return rounded(ranking.period_change(monthly, "year_month", "gross"), gross=4, change_pct=6)


@plan("weekday_rank", "AN24 S5 A19", LINES + f""", w AS (SELECT dayname(o_orderdate) AS weekday, {SUMS}
FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CAST(p.position AS INTEGER) AS position, p.weekday, round(gross, 4) AS gross, units,
       CASE WHEN gross = (SELECT max(gross) FROM w) THEN 'peak' WHEN gross = (SELECT min(gross) FROM w) THEN 'slowest' END AS mark
FROM (VALUES (1, 'Monday'), (2, 'Tuesday'), (3, 'Wednesday'), (4, 'Thursday'), (5, 'Friday'), (6, 'Saturday'), (7, 'Sunday')) p(position, weekday)
LEFT JOIN w ON p.weekday = w.weekday""")
def weekday_rank(t: Tables):
    totals = rounded(totals_by_date_part(t, dates.weekday_name, "weekday"), gross=4)
    return ops.weekday_totals(totals, "weekday").select("position", "weekday", "gross", "units", "mark")


@plan("revenue_by_category", "AN25 A20", LINES + """
SELECT p_type, round(sum(paid), 4) AS gross, round(100 * sum(paid) / (SELECT sum(paid) FROM lines WHERE NOT back), 6) AS share_pct
FROM lines JOIN part ON l_partkey = p_partkey WHERE NOT back GROUP BY p_type ORDER BY gross DESC, p_type LIMIT 12""")
def revenue_by_category(t: Tables):
    return rounded(ops.top_totals(totals_by_item(t, "p_type"), "p_type", "gross", 12), gross=4, share_pct=6)


@plan("units_by_item", "AN25 S4", LINES + """
SELECT p_name, sum(l_quantity) AS units, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lines WHERE NOT back), 6) AS share_pct
FROM lines JOIN part ON l_partkey = p_partkey WHERE NOT back GROUP BY p_name ORDER BY units DESC, p_name LIMIT 15""")
def units_by_item(t: Tables):
    return rounded(ops.top_totals(totals_by_item(t, "p_name"), "p_name", "units", 15), share_pct=6)


@plan("units_by_version", "AN25 S4", LINES + """
SELECT p_brand, sum(l_quantity) AS units, round(100 * sum(l_quantity) / (SELECT sum(l_quantity) FROM lines WHERE NOT back), 6) AS share_pct
FROM lines JOIN part ON l_partkey = p_partkey WHERE NOT back GROUP BY p_brand ORDER BY units DESC, p_brand LIMIT 15""")
def units_by_version(t: Tables):
    return rounded(ops.top_totals(totals_by_item(t, "p_brand"), "p_brand", "units", 15), share_pct=6)


def _rates(key: str) -> str:
    return LINES + f""", r AS (SELECT {key}, {SUMS} FROM lines JOIN part ON l_partkey = p_partkey GROUP BY {key}),
rates AS (SELECT *, returned_units / units * 100 AS return_rate FROM r WHERE n_sales > 0 AND n_returns > 0)
"""


@plan("return_rate", "AN26 A15", _rates("p_name") + """
SELECT p_name, units, returned_units, round(refunds, 2) AS refunds, round(return_rate, 6) AS return_rate FROM rates""")
def return_rate(t: Tables):
    rates = ops.return_rates(totals_by_item(t, "p_name"))
    return rounded(rates.select("p_name", "units", "returned_units", "refunds", "return_rate"), refunds=2, return_rate=6)


@plan("return_rate_summary", "AN26 A19", _rates("p_type") + """
SELECT round(avg(return_rate), 6) AS mean_rate, (SELECT p_type FROM rates ORDER BY return_rate DESC, p_type LIMIT 1) AS highest_key,
       round(max(return_rate), 6) AS highest_rate, (SELECT p_type FROM rates ORDER BY return_rate, p_type LIMIT 1) AS lowest_key,
       round(min(return_rate), 6) AS lowest_rate FROM rates""")
def return_rate_summary(t: Tables):
    summary = ops.rate_summary(ops.return_rates(totals_by_item(t, "p_type")), "p_type")
    return rounded(summary, mean_rate=6, highest_rate=6, lowest_rate=6)


@plan("riskiest_items", "AN26 S4", _rates("p_name") + """
SELECT p_name, round(return_rate, 6) AS return_rate FROM rates ORDER BY return_rate DESC, p_name LIMIT 10""")
def riskiest_items(t: Tables):
    rates = ops.return_rates(totals_by_item(t, "p_name")).select("p_name", F.round("return_rate", 6).alias("return_rate"))
    return rates.orderBy(F.desc("return_rate"), "p_name").limit(10)


@plan("rate_vs_volume", "AN27 AN10 J25", _rates("p_name") + """
SELECT round(corr(units, return_rate), 6) AS units_vs_rate, round(corr(gross, return_rate), 6) AS revenue_vs_rate FROM rates""")
def rate_vs_volume(t: Tables):
    found = ops.rate_correlations(ops.return_rates(totals_by_item(t, "p_name")))
    return rounded(found, units_vs_rate=6, revenue_vs_rate=6)


def buyer_table(t: Tables):
    """Recency, frequency and monetary per buyer; lines are summed per order before the join."""
    per_order = ops.order_totals(order_lines(t), ["l_orderkey"])
    dated = per_order.join(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    return segments.rfm_table(dated, "o_custkey", "o_orderdate", "n_sales", "gross")


RFM = LINES + """, rfm AS (SELECT o_custkey AS buyer,
  CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), (SELECT max(CAST(o_orderdate AS DATE)) FROM lines JOIN orders ON l_orderkey = o_orderkey)) + 1 AS INTEGER) AS recency,
  CAST(count(*) AS BIGINT) AS frequency, sum(paid) AS monetary
  FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE NOT back GROUP BY o_custkey)
"""


@plan("rfm_table", "AN28", RFM + "SELECT buyer, recency, frequency, round(monetary, 4) AS monetary FROM rfm")
def rfm_table(t: Tables):
    return rounded(buyer_table(t), monetary=4)


SCORES = RFM + """, e AS (SELECT quantile_cont(recency, 0.25) AS r1, quantile_cont(recency, 0.5) AS r2, quantile_cont(recency, 0.75) AS r3,
  quantile_cont(monetary, 0.25) AS m1, quantile_cont(monetary, 0.5) AS m2, quantile_cont(monetary, 0.75) AS m3, count(*) AS n FROM rfm),
ranked AS (SELECT *, row_number() OVER (ORDER BY frequency, buyer) AS frequency_rank FROM rfm),
s AS (SELECT ranked.*, CASE WHEN recency <= r1 THEN 4 WHEN recency <= r2 THEN 3 WHEN recency <= r3 THEN 2 ELSE 1 END AS r_score,
  CAST(greatest(1, ceil((frequency_rank - 1) * 4 / (n - 1))) AS INTEGER) AS f_score,
  CASE WHEN monetary <= m1 THEN 1 WHEN monetary <= m2 THEN 2 WHEN monetary <= m3 THEN 3 ELSE 4 END AS m_score FROM ranked, e),
scored AS (SELECT *, (r_score + f_score + m_score) / 3 AS mean_score, CASE WHEN r_score + f_score + m_score <= 4.5 THEN 'At Risk'
  WHEN r_score + f_score + m_score <= 7.5 THEN 'Needs Attention' WHEN r_score + f_score + m_score <= 10.5 THEN 'Loyal' ELSE 'Champions' END AS segment FROM s)
"""


@plan("rfm_scores", "AN29 W2 W3 M13", SCORES + """
SELECT buyer, CAST(frequency_rank AS BIGINT) AS frequency_rank, r_score, f_score, m_score, round(mean_score, 6) AS mean_score, segment FROM scored""")
def rfm_scores(t: Tables):
    scored = segments.rfm_scores(buyer_table(t))
    return scored.select(
        "buyer", "frequency_rank", "r_score", "f_score", "m_score", F.round("mean_score", 6).alias("mean_score"), "segment"
    )


@plan("rfm_segments", "AN30 S5", SCORES + """
SELECT segment, CAST(count(*) AS BIGINT) AS n_buyers, round(avg(recency), 4) AS mean_recency, round(avg(frequency), 4) AS mean_frequency,
       round(avg(monetary), 4) AS mean_monetary, round(count(*) * avg(monetary), 2) AS revenue,
       CAST(CASE segment WHEN 'Champions' THEN 1 WHEN 'Loyal' THEN 2 WHEN 'Needs Attention' THEN 3 ELSE 4 END AS INTEGER) AS position
FROM scored GROUP BY segment""")
def rfm_segments(t: Tables):
    summary = segments.segment_summary(segments.rfm_scores(buyer_table(t)))
    ordered = ranking.in_label_order(summary, "segment", segments.SEGMENT_ORDER)
    return rounded(ordered, mean_recency=4, mean_frequency=4, mean_monetary=4, revenue=2)


DIGITS = {"recency": 4, "frequency": 4, "monetary": 2}


@plan("rfm_describe", "AN1 AN30", RFM + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS BIGINT) AS count, round(avg({c}), {d}) AS mean, round(stddev_samp({c}), {d}) AS std,
 round(CAST(min({c}) AS DOUBLE), {d}) AS min, round(quantile_cont({c}, 0.25)::DOUBLE, {d}) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, {d}) AS q50,
 round(quantile_cont({c}, 0.75)::DOUBLE, {d}) AS q75, round(quantile_cont({c}, 0.9)::DOUBLE, {d}) AS q90, round(CAST(max({c}) AS DOUBLE), {d}) AS max FROM rfm"""
    for c, d in DIGITS.items()))
def rfm_describe(t: Tables):
    asked = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
    described = describe(materialise(buyer_table(t)), list(DIGITS), asked)
    for name in ("mean", "std", "min", *asked, "max"):
        coarse, fine = F.round(name, DIGITS["monetary"]), F.round(name, DIGITS["recency"])
        described = described.withColumn(name, F.when(F.col("column") == "monetary", coarse).otherwise(fine))
    return described


def _histogram_sql(column: str, bins: int, digits: int) -> str:
    return RFM + f""", b AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM rfm),
h AS (SELECT CAST(least(floor(({column} - lo) / (hi - lo) * {bins}), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM rfm, b GROUP BY 1)
SELECT CAST(g.bin AS BIGINT) AS bin, round(lo + g.bin * ((hi - lo) / {bins}), {digits}) AS left_edge, round(lo + (g.bin + 1) * ((hi - lo) / {bins}), {digits}) AS right_edge,
       CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(generate_series(0, {bins - 1})) AS bin) g CROSS JOIN b LEFT JOIN h ON g.bin = h.bin"""


@plan("recency_histogram", "AN5 AN28", _histogram_sql("recency", 40, 6))
def recency_histogram(t: Tables):
    return rounded(histogram(materialise(buyer_table(t)), "recency", 40), left_edge=6, right_edge=6)


@plan("frequency_histogram", "AN5 AN28", _histogram_sql("frequency", 30, 6))
def frequency_histogram(t: Tables):
    return rounded(histogram(materialise(buyer_table(t)), "frequency", 30), left_edge=6, right_edge=6)


@plan("monetary_histogram", "AN5 AN28", _histogram_sql("monetary", 40, 2))
def monetary_histogram(t: Tables):
    return rounded(histogram(materialise(buyer_table(t)), "monetary", 40), left_edge=2, right_edge=2)
