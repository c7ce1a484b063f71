"""The relational rows of the feature models, one by one, on the full star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from tributary.operators import windows
from tributary.plans import MONEY, flag, mean
from tributary.queries import inputs as I
from tributary.queries.registry import plain, query


@query(
    "j9_left_join_chain",
    """SELECT o_orderkey, c_custkey, n_nationkey, r_regionkey, p_partkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON o_orderkey = p_partkey""",
)
def left_join_chain(spark, sf):
    t = lambda name: I.table(spark, sf, name)
    return (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(t("part"), F.col("o_orderkey") == F.col("p_partkey"), "left")
        .select("o_orderkey", "c_custkey", "n_nationkey", "r_regionkey", "p_partkey")
    )


@query("j10_inner_join", "SELECT l_orderkey, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def inner_join(spark, sf):
    orders = I.table(spark, sf, "orders")
    return I.table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", "o_custkey")


@query(
    "j11_full_join",
    """SELECT coalesce(c, k) AS customer_id, orders, events FROM (SELECT o_custkey AS c, count(*) AS orders FROM orders GROUP BY 1)
      FULL JOIN (SELECT user_id AS k, count(*) AS events FROM events GROUP BY 1) ON c = k""",
)
def full_join(spark, sf):
    orders = I.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("customer_id")).agg(F.count(F.lit(1)).alias("orders"))
    events = I.table(spark, sf, "events").groupBy(F.col("user_id").alias("customer_id")).agg(F.count(F.lit(1)).alias("events"))
    return orders.join(events, "customer_id", "full_outer")


@query(
    "a8_basic_aggregates",
    """SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1""",
)
def basic_aggregates(spark, sf):
    price = F.col("l_extendedprice").cast(MONEY)
    return plain(
        I.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
            F.count(F.lit(1)).alias("n"), F.sum(price).alias("total"), mean(price).alias("mean"),
            F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
        )
    )


@query(
    "a9_conditional_aggregates",
    """SELECT o_custkey, count(*) FILTER (o_orderdate >= DATE '2001-07-25') AS n_7, count(*) FILTER (o_orderdate >= DATE '2001-05-03') AS n_90,
      CAST(sum(CASE WHEN o_orderdate >= DATE '2001-05-03' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS total_90 FROM orders GROUP BY 1""",
)
def conditional_aggregates(spark, sf):
    since = lambda days: F.col("o_orderdate") >= F.date_sub(F.lit("2001-08-01").cast("date"), days)
    price = F.col("o_totalprice").cast(MONEY)
    return plain(
        I.table(spark, sf, "orders").groupBy("o_custkey").agg(
            F.count_if(since(7)).alias("n_7"), F.count_if(since(90)).alias("n_90"),
            F.sum(F.when(since(90), price).otherwise(F.lit(0).cast(MONEY))).alias("total_90"),
        )
    )


@query(
    "a10_distinct_counts",
    """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) FILTER (l_quantity > 25) AS large_parts FROM lineitem GROUP BY 1""",
)
def distinct_counts(spark, sf):
    return I.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.when(F.col("l_quantity") > 25, F.col("l_partkey"))).alias("large_parts")
    )


@query("a11_multi_key_aggregates", "SELECT l_partkey, l_suppkey, l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def multi_key_aggregates(spark, sf):
    return I.table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderdate, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders"


def _orders(spark, sf):
    return I.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.col("o_totalprice").cast(MONEY).alias("price"))


@query(
    "w1_running_sum",
    f"SELECT o_orderkey, CAST(sum(price) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM ({_ORDERS})",
)
def running_sum(spark, sf):
    rows = windows.with_positions(
        _orders(spark, sf), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), "o_orderkey"], sums={"running": F.col("price")}
    )
    return plain(rows.select("o_orderkey", "running"))


@query(
    "w2_rolling_frame",
    f"""SELECT o_orderkey, CAST(sum(price) OVER w AS DOUBLE) / count(*) OVER w AS mean, CAST(min(price) OVER w AS DOUBLE) AS least, CAST(max(price) OVER w AS DOUBLE) AS most
      FROM ({_ORDERS}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
)
def rolling_frame(spark, sf):
    placed = windows.with_positions(_orders(spark, sf), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    price = F.col("price")
    rows = windows.rolling(
        placed, ["o_custkey"], 30, {"total": F.sum(price), "n": F.count(price), "least": F.min(price), "most": F.max(price)}
    )
    return plain(rows.select("o_orderkey", (F.col("total").cast("double") / F.col("n")).alias("mean"), "least", "most"))


@query(
    "w3_latest_row",
    f"SELECT o_custkey, o_orderkey FROM ({_ORDERS}) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1",
)
def latest_row(spark, sf):
    newest = [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()]
    return windows.latest(_orders(spark, sf), ["o_custkey"], newest).select("o_custkey", "o_orderkey")


@query(
    "x1_casts",
    """SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
      CAST(left(o_orderpriority, 1) AS BIGINT) AS rank, CAST(o_custkey AS VARCHAR) AS customer FROM orders""",
)
def casts(spark, sf):
    return plain(
        I.table(spark, sf, "orders").select(
            "o_orderkey", F.col("o_totalprice").cast(MONEY).alias("price"), F.col("o_orderdate").cast("date").alias("day"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_custkey").cast("string").alias("customer"),
        )
    )


@query("x2_strings", "SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS low, upper(c_mktsegment) AS up, concat_ws(' ', c_name, NULL, c_mktsegment) AS both FROM customer")
def strings(spark, sf):
    padded = F.concat(F.lit("  "), "c_name", F.lit(" "))
    return I.table(spark, sf, "customer").select(
        "c_custkey", F.lower(F.trim(padded)).alias("low"), F.upper("c_mktsegment").alias("up"),
        F.concat_ws(" ", "c_name", F.lit(None).cast("string"), "c_mktsegment").alias("both"),
    )


@query(
    "x3_null_handling",
    """SELECT l_orderkey, l_linenumber::BIGINT AS line, coalesce(nullif(l_tax, 0), nullif(l_discount, 0), -1) AS rate, nullif(l_returnflag, 'N') IS NOT NULL AS flagged FROM lineitem""",
)
def null_handling(spark, sf):
    return I.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("line"),
        F.coalesce(F.nullif("l_tax", F.lit(0.0)), F.nullif("l_discount", F.lit(0.0)), F.lit(-1.0)).alias("rate"),
        F.nullif("l_returnflag", F.lit("N")).isNotNull().alias("flagged"),
    )


@query("x4_math", "SELECT c_custkey, abs(c_acctbal) AS size, least(c_acctbal, 100.0) AS low, greatest(c_acctbal, NULL, 0.0) AS high, round(c_acctbal * 2 - 1, 0) AS near FROM customer")
def math(spark, sf):
    balance = F.col("c_acctbal")
    return I.table(spark, sf, "customer").select(
        "c_custkey", F.abs(balance).alias("size"), F.least(balance, F.lit(100.0)).alias("low"),
        F.greatest(balance, F.lit(None).cast("double"), F.lit(0.0)).alias("high"), F.round(balance * 2 - 1, 0).alias("near"),
    )


@query(
    "x5_conditionals",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'high' WHEN o_totalprice >= 100000 THEN 'medium' ELSE 'low' END AS band,
      CAST(o_orderstatus IN ('F', 'O') OR o_orderpriority = '1-URGENT' AS BIGINT) AS flagged FROM orders""",
)
def conditionals(spark, sf):
    price = F.col("o_totalprice")
    return plain(
        I.table(spark, sf, "orders").select(
            "o_orderkey", F.when(price >= 400000, "high").when(price >= 100000, "medium").otherwise("low").alias("band"),
            flag(F.col("o_orderstatus").isin("F", "O") | (F.col("o_orderpriority") == "1-URGENT")).alias("flagged"),
        )
    )


@query(
    "x6_dates",
    """SELECT o_orderkey, CAST(DATE '2001-08-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS days, CAST(o_orderdate AS DATE) >= DATE '2001-08-01' - 30 AS recent,
      CAST(date_part('year', age(DATE '2001-08-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS years FROM orders""",
)
def dates(spark, sf):
    from tributary.plans.banking import completed_years

    as_of = F.lit("2001-08-01").cast("date")
    orders = I.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return plain(
        orders.select(
            "o_orderkey", F.datediff(as_of, "day").alias("days"), (F.col("day") >= F.date_sub(as_of, 30)).alias("recent"),
            completed_years(as_of, F.col("day")).alias("years"),
        )
    )
