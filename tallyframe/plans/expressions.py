"""String, number, date, array and map function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import collections as coll
from tallyframe.functions import dates, numbers, text
from tallyframe.operators.profile import explode_labels
from tallyframe.plans.registry import Tables, plan


def as_text(values):
    """Array elements joined with commas, so that results compare as plain text."""
    return F.array_join(values.cast("array<string>"), ",")


@plan("pad_and_slice", "ST1 ST2 ST3 ST4 ST9 ST18", """
SELECT p_partkey, lpad(rpad(p_name, 20, '*'), 25, '*') AS padded, rpad(p_name, 6, '*') AS cut_pad,
       substr(p_name, 3, 9) AS middle, substr(p_name, 4) AS rest, concat(p_brand, '@', p_type) AS joined,
       reverse(p_name) AS reversed, left(p_name, 2) AS head2, right(p_name, 3) AS tail3,
       reverse(substr(p_name, 1, 4)) AS reversed_slice, substr(p_name, -4, 2) AS from_end FROM part""")
def pad_and_slice(t: Tables):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        text.centre_pad(name, 20, 25, "*").alias("padded"),
        F.rpad(name, 6, "*").alias("cut_pad"),
        F.substring(name, 3, 9).alias("middle"),
        F.substring(name, F.lit(4), F.length(name)).alias("rest"),
        F.concat("p_brand", F.lit("@"), "p_type").alias("joined"),
        F.reverse(name).alias("reversed"),
        F.left(name, F.lit(2)).alias("head2"),
        F.right(name, F.lit(3)).alias("tail3"),
        F.reverse(F.substring(name, 1, 4)).alias("reversed_slice"),
        F.substring(name, -4, 2).alias("from_end"),
    )


@plan("byte_length", "ST5 ST8 ST10", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes,
       md5(upper(lang) || replace(source, 's', 'x')) AS tag FROM documents WHERE length(text) > 20""")
def byte_length(t: Tables):
    body = F.col("text")
    return t.documents.where(F.length(body) > 20).select(
        "doc_id",
        F.length(body).cast("bigint").alias("n_chars"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.md5(F.concat(F.upper("lang"), F.replace("source", F.lit("s"), F.lit("x")))).alias("tag"),
    )


@plan("email_domain", "ST6 ST7 ST3", """
WITH e AS (SELECT c_custkey, lower(c_mktsegment) || '@mail.' || replace(lower(c_name), '#', '-') || '.org' AS email FROM customer)
SELECT c_custkey, substr(email, instr(email, '@') + 1) AS domain, split_part(email, '.', -1) AS top_level,
       split_part(email, '@', 1) AS mailbox FROM e""")
def email_domain(t: Tables):
    email = F.concat(
        F.lower("c_mktsegment"), F.lit("@mail."), F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit(".org")
    )
    return t.customer.select("c_custkey", email.alias("email")).select(
        "c_custkey",
        text.domain_of(F.col("email")).alias("domain"),
        text.top_level_domain(F.col("email")).alias("top_level"),
        F.substring_index("email", "@", 1).alias("mailbox"),
    )


@plan("letter_bucket", "ST11 J19", """
SELECT p_partkey, p_name, CASE WHEN left(p_name, 1) BETWEEN 'a' AND 'm' THEN 'Group A-M'
       WHEN left(p_name, 1) BETWEEN 'n' AND 'z' THEN 'Group N-Z' ELSE 'other' END AS group_label FROM part
WHERE left(p_name, 1) > 'c'""")
def letter_bucket(t: Tables):
    named = t.part.select("p_partkey", "p_name", text.letter_group(F.col("p_name")).alias("group_label"))
    return named.where(F.left("p_name", F.lit(1)) > "c")


@plan("word_counts", "ST12 ST14 AR1", """
SELECT word, CAST(count(*) AS BIGINT) AS n, CAST(min(strpos(p_name, 'o') - 1) AS BIGINT) AS first_o,
       CAST(sum(length(p_name) - length(replace(p_name, 'l', ''))) AS BIGINT) AS n_l
FROM (SELECT p_name, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word""")
def word_counts(t: Tables):
    name = F.col("p_name")
    words = t.part.select(name, F.explode(text.split_labels(name, " ")).alias("word"))
    return words.groupBy("word").agg(
        F.count("*").alias("n"),
        F.min(text.find_first(name, "o")).cast("bigint").alias("first_o"),
        F.sum(text.substring_occurrences(name, "l")).cast("bigint").alias("n_l"),
    )


@plan("char_classes", "ST15 ST16", r"""
WITH w AS (SELECT conv_id, turn, role AS value FROM conversations
           UNION ALL SELECT doc_id, -1, source FROM documents UNION ALL SELECT p_partkey, -2, p_type FROM part)
SELECT conv_id, turn, regexp_matches(value, '^[A-Za-z0-9]+$') AS alnum, regexp_matches(value, '^[A-Za-z]+$') AS alpha,
       value = lower(value) AS lower_case, value = upper(value) AS upper_case, regexp_matches(value, '^[A-Z][a-z0-9]*$') AS title_case,
       regexp_matches(value, '^\s+$') AS blank, value = reverse(value) AS palindrome FROM w""")
def char_classes(t: Tables):
    values = (
        t.conversations.select("conv_id", "turn", F.col("role").alias("value"))
        .unionByName(t.documents.select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), F.col("source").alias("value")))
        .unionByName(t.part.select(F.col("p_partkey").alias("conv_id"), F.lit(-2).cast("bigint").alias("turn"), F.col("p_type").alias("value")))
    )
    v = F.col("value")
    return values.select(
        "conv_id",
        "turn",
        text.is_alnum(v).alias("alnum"),
        text.is_alpha(v).alias("alpha"),
        text.is_lower(v).alias("lower_case"),
        text.is_upper(v).alias("upper_case"),
        text.is_title(v).alias("title_case"),
        text.is_space(v).alias("blank"),
        text.is_palindrome(v).alias("palindrome"),
    )


@plan("formatted", "ST17", """
SELECT p_partkey, printf('%s costs %.2f (size %d)', p_name, p_retailprice, p_size) AS line FROM part""")
def formatted(t: Tables):
    return t.part.select("p_partkey", F.format_string("%s costs %.2f (size %d)", "p_name", "p_retailprice", "p_size").alias("line"))


@plan("arithmetic", "M1 M2 M3 M4 M7 M11", """
SELECT p_partkey, pow(p_size, 2)::DOUBLE AS squared, p_size % 60 AS over_hour, CAST(floor(p_retailprice) AS BIGINT) AS low,
       CAST(ceil(p_retailprice) AS BIGINT) AS high, round(p_retailprice / p_size, 1) AS ratio,
       CAST(p_size // 7 AS BIGINT) AS sevens, abs(p_size - 25) AS off FROM part""")
def arithmetic(t: Tables):
    size, price = F.col("p_size"), F.col("p_retailprice")
    return t.part.select(
        "p_partkey",
        F.pow(size, F.lit(2)).alias("squared"),
        (size % 60).alias("over_hour"),
        F.floor(price).alias("low"),
        F.ceil(price).alias("high"),
        F.round(price / size, 1).alias("ratio"),
        F.expr("p_size div 7").alias("sevens"),
        F.abs(size - 25).alias("off"),
    )


@plan("xor_rate", "M5", """
SELECT p_partkey, xor(CAST(round(p_retailprice) AS BIGINT), 3::BIGINT) AS toggled FROM part""")
def xor_rate(t: Tables):
    return t.part.select("p_partkey", numbers.xor_int(F.col("p_retailprice"), 3).alias("toggled"))


@plan("random_scores", "M6")
def random_scores(t: Tables):
    draw = F.rand(42) * 100
    return t.customer.select("c_custkey", draw.alias("draw")).withColumn("random_score", F.floor("draw"))


@plan("random_scores_audit", "M6", """
SELECT CAST(count(*) AS BIGINT) AS n, TRUE AS in_range, TRUE AS spread FROM customer""")
def random_scores_audit(t: Tables):
    """Every draw lies in [0, 100), and the draws differ."""
    drawn = random_scores(t)
    inside = F.every((F.col("draw") >= 0) & (F.col("draw") < 100) & (F.col("random_score") == F.floor("draw")))
    return drawn.agg(F.count("*").alias("n"), inside.alias("in_range"), (F.countDistinct("draw") > F.count("*") / 2).alias("spread"))


@plan("log_clip_bins", "M8 M9 M10 M13", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, least(greatest(o_totalprice, 50000.0), 400000.0) AS clipped,
       round(sqrt(o_totalprice), 6) AS root,
       CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'low' WHEN o_totalprice > 100000 AND o_totalprice <= 300000 THEN 'mid'
            WHEN o_totalprice > 300000 AND o_totalprice <= 1000000 THEN 'high' END AS bin FROM orders""")
def log_clip_bins(t: Tables):
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.round(F.log1p(price), 6).alias("log_price"),
        numbers.clip(price, F.lit(50000.0), F.lit(400000.0)).alias("clipped"),
        F.round(F.sqrt(price), 6).alias("root"),
        numbers.bin_right_closed(price, [0, 100000, 300000, 1000000], ["low", "mid", "high"]).alias("bin"),
    )


@plan("leap_years", "M12", """
SELECT year(o_orderdate)::INTEGER AS year, CAST(count(*) AS BIGINT) AS n_orders,
       CASE WHEN year(o_orderdate) % 400 = 0 OR (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0)
            THEN 'Leap Year' ELSE 'Not a Leap Year' END AS status FROM orders GROUP BY ALL""")
def leap_years(t: Tables):
    years = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n_orders"))
    return years.withColumn("status", numbers.leap_label(F.col("year")))


@plan("days_between", "D1 PF8", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days_open
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate IS NOT NULL""")
def days_between(t: Tables):
    shipped = t.lineitem.where(F.col("l_shipdate").isNotNull())
    joined = shipped.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate").cast("bigint")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", days.alias("days_open"))


@plan("period_payments", "D2 D5 D7 A5", """
SELECT o_custkey, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, monthname(o_orderdate) AS month_name,
       strftime(o_orderdate, '%Y-%m') AS year_month, round(sum(o_totalprice), 2) AS total_amount
FROM orders GROUP BY ALL""")
def period_payments(t: Tables):
    day = F.col("o_orderdate")
    return t.orders.groupBy(
        "o_custkey",
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.date_format(day, "MMMM").alias("month_name"),
        dates.year_month(day).alias("year_month"),
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("total_amount"))


@plan("quarter_label", "D2", """
SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS quarter FROM orders""")
def quarter_label(t: Tables):
    return t.orders.select("o_orderkey", dates.quarter_label(F.col("o_orderdate")).alias("quarter"))


SUNDAY_WEEK = "CAST(strftime({d}, '%U') AS INTEGER)"


@plan("week_mode0", "D3 D4 D8 D5", f"""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_orders FROM orders GROUP BY 1),
     w AS (SELECT *, {SUNDAY_WEEK.format(d='day')} AS week,
                  {SUNDAY_WEEK.format(d="make_date(year(day) - 1, 12, 31)")} AS last_week FROM d)
SELECT CAST(day AS VARCHAR) AS day, n_orders, week, CAST(CASE WHEN week > 0 THEN year(day) * 100 + week ELSE (year(day) - 1) * 100 + last_week END AS INTEGER)
       AS year_week, week(day)::INTEGER AS iso_week, dayname(day) AS weekday FROM w""")
def week_mode0(t: Tables):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    day = F.col("day")
    return daily.select(
        day.cast("string").alias("day"),
        "n_orders",
        dates.sunday_week(day).alias("week"),
        dates.sunday_year_week(day).alias("year_week"),
        F.weekofyear(day).alias("iso_week"),
        dates.weekday_name(day).alias("weekday"),
    )


@plan("weekly_payments", "D3 A5", f"""
SELECT o_custkey, year(o_orderdate)::INTEGER AS year, {SUNDAY_WEEK.format(d='o_orderdate')} AS week,
       round(sum(o_totalprice), 2) AS total_amount FROM orders GROUP BY ALL""")
def weekly_payments(t: Tables):
    day = F.col("o_orderdate")
    return t.orders.groupBy("o_custkey", F.year(day).alias("year"), dates.sunday_week(day).alias("week")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total_amount")
    )


@plan("days_left", "D9", """
SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), make_date(year(o_orderdate), 12, 31)) AS INTEGER) AS days_remaining
FROM orders""")
def days_left(t: Tables):
    return t.orders.select("o_orderkey", dates.days_left_in_year(F.to_date("o_orderdate")).alias("days_remaining"))


@plan("age_parts", "D10 D11", """
WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS born, DATE '2026-12-01' AS today FROM orders),
     m AS (SELECT *, (year(today) - year(born)) * 12 + month(today) - month(born)
                     - CASE WHEN day(today) < day(born) THEN 1 ELSE 0 END AS months FROM a)
SELECT o_orderkey, (months // 12) || ' years, ' || (months % 12) || ' months, ' ||
       date_diff('day', CAST(born + to_months(CAST(months AS INTEGER)) AS DATE), today) || ' days' AS age FROM m""")
def age_parts(t: Tables):
    as_of = F.lit("2026-12-01").cast("date")
    return t.orders.select("o_orderkey", dates.age_text(F.to_date("o_orderdate"), as_of).alias("age"))


@plan("shifted_dates", "D11 D6", """
SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) - INTERVAL 9 DAY AS DATE) AS VARCHAR) AS nine_before,
       CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS month_after FROM orders""")
def shifted_dates(t: Tables):
    day = F.to_date("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_sub(day, 9).cast("string").alias("nine_before"),
        F.add_months(day, 1).cast("string").alias("month_after"),
    )


@plan("parse_day_first", "D12 D13", """
SELECT CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day,
       CAST(count(*) AS BIGINT) AS n_parsed, CAST(0 AS BIGINT) AS n_wrong,
       CAST(count(*) AS BIGINT) AS n_rejected FROM orders""")
def parse_day_first(t: Tables):
    as_text = t.orders.select("o_orderdate", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"), F.concat(
        F.lit("99/99/"), F.year("o_orderdate").cast("string")).alias("broken"))
    parsed = F.to_date(dates.parse_day_first(F.col("written")))
    return as_text.agg(
        F.min(parsed).cast("string").alias("first_day"),
        F.max(parsed).cast("string").alias("last_day"),
        F.count(parsed).alias("n_parsed"),
        F.count_if(parsed != F.to_date("o_orderdate")).alias("n_wrong"),
        F.count_if(dates.parse_day_first(F.col("broken")).isNull()).alias("n_rejected"),
    )


@plan("explode_labels", "AR1", """
SELECT p_partkey, unnest(string_split(p_name, ' ')) AS p_name FROM part""")
def explode_label_rows(t: Tables):
    return explode_labels(t.part.select("p_partkey", "p_name"), "p_name", " ")


@plan("indicators", "AR2", """
SELECT p_partkey, word, (word = 'blue')::INTEGER AS blue, (word = 'red')::INTEGER AS red,
       (position('blue' IN p_name) > 0)::INTEGER AS any_blue
FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS word FROM part)""")
def indicators(t: Tables):
    from tallyframe.operators.profile import add_indicators

    words = t.part.select("p_partkey", "p_name", F.explode(text.split_labels(F.col("p_name"), " ")).alias("word"))
    single = add_indicators(words, "word", ["blue", "red"])
    whole = add_indicators(single.withColumnsRenamed({"blue": "one_blue"}), "p_name", ["blue"], multi_hot=True, separator=" ")
    return whole.select("p_partkey", "word", F.col("one_blue").alias("blue"), "red", F.col("blue").alias("any_blue"))


@plan("array_hof", "AR3 AR4 AR5 AR6 AR7", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, l_linenumber::DOUBLE, l_suppkey::DOUBLE, l_quantity] AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, list_sum(list_transform(x, lambda v: v * 2)) AS doubled_total,
       CAST(len(list_filter(x, lambda v: v > 25)) AS BIGINT) AS n_large, list_max(x) AS largest,
       CAST(len(list_distinct(x)) AS BIGINT) AS n_distinct, list_sort(x)[2] AS second_smallest FROM a""")
def array_hof(t: Tables):
    values = F.array(
        "l_quantity", F.col("l_linenumber").cast("double"), F.col("l_suppkey").cast("double"), "l_quantity"
    )
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.select(*keys, values.alias("x")).select(
        *keys,
        coll.array_total(F.transform("x", lambda v: v * 2)).alias("doubled_total"),
        F.size(F.filter("x", lambda v: v > 25)).cast("bigint").alias("n_large"),
        F.element_at(F.reverse(F.array_sort("x")), 1).alias("largest"),
        F.size(F.array_distinct("x")).cast("bigint").alias("n_distinct"),
        F.element_at(F.array_sort("x"), 2).alias("second_smallest"),
    )


@plan("array_edits", "AR6 AR7 AR11", """
SELECT p_partkey, array_to_string([p_size, p_size % 5, 7, 99], ',') AS appended,
       array_to_string(list_filter([p_size, p_size % 5, 7], lambda x: x <> 7), ',') AS removed, array_to_string([7, p_size % 5, p_size], ',') AS reversed, array_to_string([p_size % 5, 7], ',') AS sliced,
       CAST(list_position([p_size, p_size % 5, 7], 7) AS BIGINT) AS position_of_7,
       array_to_string(list_sort(list_distinct([p_size, p_size % 5, 7, 3])), ',') AS merged_set,
       p_size % 5 AS nested_item, array_to_string([p_size, p_size % 5, 7, 1, 2], ',') AS flat FROM part""")
def array_edits(t: Tables):
    base = F.array(F.col("p_size"), F.col("p_size") % 5, F.lit(7))
    nested = F.array(base, F.array(F.lit(1), F.lit(2)))
    return t.part.select("p_partkey", base.alias("b"), nested.alias("nested")).select(
        "p_partkey",
        as_text(F.array_append("b", 99)).alias("appended"),
        as_text(F.array_remove("b", 7)).alias("removed"),
        as_text(F.reverse("b")).alias("reversed"),
        as_text(F.slice("b", 2, 2)).alias("sliced"),
        F.array_position("b", 7).cast("bigint").alias("position_of_7"),
        as_text(F.array_sort(F.array_union("b", F.array(F.lit(3))))).alias("merged_set"),
        coll.nested_at(F.col("nested"), 1, 2).alias("nested_item"),
        as_text(F.flatten("nested")).alias("flat"),
    )


@plan("map_ops", "AR8", """
SELECT p_partkey, p_brand AS got, 'none' AS missing, 3::BIGINT AS n_after_put, p_size + 1 || '' AS put_value,
       1::BIGINT AS n_after_remove, 'brand,size' AS keys_found, p_brand || '|' || p_size AS values_joined FROM part""")
def map_ops(t: Tables):
    base = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    put = coll.map_put(F.col("m"), F.lit("size"), (F.col("p_size") + 1).cast("string"))
    more = coll.map_put(put, F.lit("type"), F.col("p_type"))
    return t.part.select("*", base.alias("m")).select(
        "p_partkey",
        F.try_element_at("m", F.lit("brand")).alias("got"),
        F.coalesce(F.try_element_at("m", F.lit("weight")), F.lit("none")).alias("missing"),
        F.size(more).cast("bigint").alias("n_after_put"),
        F.element_at(more, "size").alias("put_value"),
        F.size(coll.map_remove(F.col("m"), F.lit("size"))).cast("bigint").alias("n_after_remove"),
        as_text(F.array_sort(F.map_keys("m"))).alias("keys_found"),
        F.array_join(F.transform(F.map_entries("m"), lambda e: e["value"]), "|").alias("values_joined"),
    )


@plan("move_zeros", "AR9", """
SELECT p_partkey, array_to_string(list_concat(list_filter([p_size % 3, p_size % 2, p_size, p_size % 5], lambda x: x <> 0),
       list_filter([p_size % 3, p_size % 2, p_size, p_size % 5], lambda x: x = 0)), ',') AS zeros_last FROM part""")
def move_zeros(t: Tables):
    size = F.col("p_size")
    return t.part.select("p_partkey", as_text(coll.zeros_last(F.array(size % 3, size % 2, size, size % 5))).alias("zeros_last"))


@plan("square_series", "AR10 AR5", """
SELECT p_partkey, array_to_string(list_transform(generate_series(1, p_size), lambda x: x * x), ',') AS squares,
       CAST(list_sum(list_transform(generate_series(1, p_size), lambda x: x * x)) AS DOUBLE) AS total FROM part""")
def square_series(t: Tables):
    squares = coll.squares(F.col("p_size"))
    return t.part.select("p_partkey", squares.alias("s")).select(
        "p_partkey",
        as_text(F.col("s")).alias("squares"),
        coll.array_total(F.transform("s", lambda x: x.cast("double"))).alias("total"),
    )
