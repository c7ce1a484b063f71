"""Feature models on banking, retail and lending tables derived from the star schema."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tributary.plans import banking as B
from tributary.plans import lending as L
from tributary.plans import retail as R
from tributary.queries import inputs as I
from tributary.queries.registry import plain, query

AS_OF = dt.date(2024, 2, 3)
STAMP = dt.datetime(2024, 2, 3, 6, 0)


def _pick(key, *values):
    out = None
    for n, value in enumerate(values):
        arm = key == n
        out = F.when(arm, value) if out is None else out.when(arm, value)
    return out


def raw_customers(spark, sf):
    c = I.table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("customer_id"),
        F.concat(F.lit("  "), F.substring_index("c_name", "#", 1), F.lit(" ")).alias("first_name"),
        F.substring_index("c_name", "#", -1).alias("last_name"),
        F.date_add(F.lit("1950-01-01").cast("date"), (k % 15000).cast("int")).alias("date_of_birth"),
        F.date_add(F.lit("2015-01-01").cast("date"), (k % 3000).cast("int")).alias("onboarding_date"),
        _pick(k % 4, " Active", "INACTIVE ", "blocked", "Closed").alias("customer_status"),
        F.format_string(" c%d", "c_nationkey").alias("country_code"), F.lower("c_mktsegment").alias("segment_code"),
        F.format_string(" User%d@Example.COM", k).alias("email"), F.format_string("+49 %d", k).alias("phone_number"),
        F.lit("2024-01-01 00:00:00").alias("updated_at"),
    )


def raw_accounts(spark, sf):
    k = F.col("c_custkey")
    return I.table(spark, sf, "customer").select(
        k.alias("account_id"), k.alias("customer_id"),
        _pick(F.col("c_nationkey") % 4, "Checking", "savings ", " CREDIT", "investment").alias("account_type"),
        _pick(k % 3, "Active ", "closed", "Dormant").alias("account_status"), F.lit("eur").alias("currency_code"),
        F.col("c_acctbal").alias("current_balance"), F.col("c_acctbal").alias("available_balance"),
        (F.col("c_nationkey") * 1000).alias("credit_limit"),
        F.lit("2015-01-01 10:00:00").alias("opened_at"), F.lit(None).cast("string").alias("closed_at"),
        F.lit("2024-01-01 00:00:00").alias("updated_at"),
    )


def raw_transactions(spark, sf):
    e = I.table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select(
        F.col("event_id").alias("transaction_id"), F.col("user_id").alias("account_id"), F.col("user_id").alias("customer_id"),
        F.when(F.col("value") <= 480, F.col("ts")).alias("transaction_timestamp"),
        F.when(kind == "click", " Card_Payment").when(kind == "error", "FEE").when(kind == "purchase", "outgoing_transfer")
        .when(kind == "signup", "incoming_transfer").otherwise("salary").alias("transaction_type"),
        F.when(kind.isin("signup", "view"), "Credit ").otherwise("debit").alias("debit_credit_indicator"),
        F.when(kind == "error", -F.col("value")).otherwise(F.col("value")).alias("amount"),
        F.format_string("Cat%d", F.col("event_id") % 12).alias("merchant_category"),
        _pick(F.col("event_id") % 3, "Mobile", "web", "branch").alias("channel"), kind.alias("description"),
    )


def raw_loans(spark, sf):
    o = I.table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("loan_id"), F.col("o_custkey").alias("customer_id"), F.col("o_custkey").alias("account_id"),
        F.when(status == "F", "Closed").when(status == "O", " active").otherwise("OVERDUE").alias("loan_status"),
        F.col("o_orderpriority").alias("loan_type"), F.col("o_totalprice").alias("principal_amount"),
        F.when(status == "F", 0.0).otherwise(F.col("o_totalprice")).alias("outstanding_amount"),
        (F.col("o_orderkey") % 500 / 100).alias("interest_rate"), F.col("o_totalprice").alias("installment_amount"),
        F.col("o_orderdate").alias("loan_open_date"), F.date_add(F.col("o_orderdate").cast("date"), 365).alias("due_date"),
        F.when(status == "F", F.col("o_orderdate")).alias("closed_date"),
    )


def stg(spark, sf):
    """The four staging tables: customers, accounts, transactions, loans."""
    return (
        B.stg_customers(raw_customers(spark, sf)), B.stg_accounts(raw_accounts(spark, sf)),
        B.stg_transactions(raw_transactions(spark, sf)), B.stg_loans(raw_loans(spark, sf)),
    )


BANK_SQL = """
WITH cu AS (SELECT c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
    DATE '1950-01-01' + CAST(c_custkey % 15000 AS INT) AS date_of_birth, DATE '2015-01-01' + CAST(c_custkey % 3000 AS INT) AS onboarding_date,
    (['active', 'inactive', 'blocked', 'closed'])[c_custkey % 4 + 1] AS customer_status, 'C' || c_nationkey AS country_code, c_mktsegment AS segment_code,
    'user' || c_custkey || '@example.com' AS email, '+49 ' || c_custkey AS phone_number, split_part(c_name, '#', 1) || ' ' || split_part(c_name, '#', 2) AS customer_full_name
  FROM customer),
ac AS (SELECT c_custkey AS account_id, c_custkey AS customer_id, (['checking', 'savings', 'credit', 'investment'])[c_nationkey % 4 + 1] AS account_type,
    (['active', 'closed', 'dormant'])[c_custkey % 3 + 1] AS account_status, CAST(c_acctbal AS DECIMAL(18,2)) AS current_balance,
    CAST(c_nationkey * 1000 AS DECIMAL(18,2)) AS credit_limit FROM customer),
tx AS (SELECT event_id AS transaction_id, user_id AS account_id, user_id AS customer_id, ts AS transaction_timestamp, CAST(ts AS DATE) AS d,
    CASE event_type WHEN 'click' THEN 'card_payment' WHEN 'error' THEN 'fee' WHEN 'purchase' THEN 'outgoing_transfer' WHEN 'signup' THEN 'incoming_transfer' ELSE 'salary' END AS kind,
    CASE WHEN event_type IN ('signup', 'view') THEN 'credit' ELSE 'debit' END AS indicator,
    CAST(value AS DECIMAL(18,2)) AS size, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS sign,
    'cat' || (event_id % 12) AS category, (['mobile', 'web', 'branch'])[event_id % 3 + 1] AS channel, event_type AS description,
    DATE '2024-02-03' AS today
  FROM events WHERE value <= 480),
lo AS (SELECT o_orderkey AS loan_id, o_custkey AS customer_id, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'active' ELSE 'overdue' END AS loan_status,
    lower(o_orderpriority) AS loan_type, CAST(o_totalprice AS DECIMAL(18,2)) AS principal, CAST(CASE o_orderstatus WHEN 'F' THEN 0 ELSE o_totalprice END AS DECIMAL(18,2)) AS owed,
    CAST(o_orderkey % 500 / 100 AS DECIMAL(10,4)) AS rate, CAST(o_orderdate AS DATE) AS opened, CAST(o_orderdate AS DATE) + 365 AS due FROM orders),
held AS (SELECT customer_id, count(*) AS accounts, count(*) FILTER (account_status = 'active') AS open_accounts, count(*) FILTER (account_status = 'closed') AS shut_accounts,
    sum(current_balance) AS balance, sum(credit_limit) AS limits, sum(CASE WHEN account_type = 'credit' THEN greatest(current_balance, 0) ELSE 0 END) AS revolving FROM ac GROUP BY 1),
activity AS (SELECT cu.customer_id, onboarding_date, customer_status, coalesce(accounts, 0) AS account_count, coalesce(open_accounts, 0) AS active_account_count,
    coalesce(shut_accounts, 0) AS closed_account_count, count(transaction_id) AS lifetime_transaction_count, count(DISTINCT d) AS active_transaction_days,
    max(d) AS last_transaction_date, count(DISTINCT d) FILTER (channel IN ('mobile', 'web') AND d >= DATE '2024-01-04') AS digital_active_days_30d
  FROM cu LEFT JOIN held USING (customer_id) LEFT JOIN tx USING (customer_id) GROUP BY ALL),
act AS (SELECT *, CAST(DATE '2024-02-03' - onboarding_date AS BIGINT) AS customer_tenure_days,
    CASE WHEN customer_status = 'active' THEN least(100, digital_active_days_30d * 4 + active_transaction_days) ELSE 0 END AS digital_activity_score FROM activity),
spend AS (SELECT customer_id,
    sum(CASE WHEN kind IN ('card_payment', 'fee', 'outgoing_transfer') AND d >= DATE '2024-01-27' THEN size ELSE 0 END) AS total_spend_7d,
    sum(CASE WHEN kind IN ('card_payment', 'fee', 'outgoing_transfer') AND d >= DATE '2024-01-04' THEN size ELSE 0 END) AS total_spend_30d,
    sum(CASE WHEN kind IN ('card_payment', 'fee', 'outgoing_transfer') AND d >= DATE '2023-11-05' THEN size ELSE 0 END) AS total_spend_90d,
    count(*) FILTER (d >= DATE '2024-01-27') AS transaction_count_7d, count(*) FILTER (d >= DATE '2024-01-04') AS transaction_count_30d, count(*) FILTER (d >= DATE '2023-11-05') AS transaction_count_90d,
    CAST(sum(size) AS DOUBLE) / count(*) AS avg_transaction_amount, max(size) AS max_transaction_amount, max(d) AS last_transaction_date,
    CAST(DATE '2024-02-03' - max(d) AS BIGINT) AS days_since_last_transaction,
    sum(CASE WHEN kind = 'incoming_transfer' AND d >= DATE '2024-01-04' THEN size ELSE 0 END) AS incoming_transfer_amount_30d,
    sum(CASE WHEN kind = 'outgoing_transfer' AND d >= DATE '2024-01-04' THEN size ELSE 0 END) AS outgoing_transfer_amount_30d,
    count(DISTINCT kind) FILTER (d >= DATE '2023-11-05') AS distinct_transaction_type_count_90d FROM tx GROUP BY 1),
owing AS (SELECT customer_id, count(*) AS loan_count, count(*) FILTER (loan_status <> 'closed') AS active_loan_count, count(*) FILTER (loan_status = 'overdue') AS overdue_loan_count,
    sum(owed) AS owed, CAST(sum(nullif(rate, 0)) AS DOUBLE) / nullif(count(nullif(rate, 0)), 0) AS avg_loan_interest_rate, min(opened) AS first_loan_open_date, max(due) AS latest_loan_due_date FROM lo GROUP BY 1),
credit AS (SELECT coalesce(l.customer_id, h.customer_id) AS customer_id, coalesce(limits, 0) AS credit_limit, coalesce(revolving, 0) AS revolving_balance, coalesce(owed, 0) AS outstanding_loan_amount,
    coalesce(loan_count, 0) AS loan_count, coalesce(active_loan_count, 0) AS active_loan_count, coalesce(overdue_loan_count, 0) AS overdue_loan_count,
    avg_loan_interest_rate, first_loan_open_date, latest_loan_due_date, coalesce(CAST(revolving AS DOUBLE) / nullif(CAST(limits AS DOUBLE), 0), 0) AS credit_utilization_ratio
  FROM owing l FULL JOIN held h ON l.customer_id = h.customer_id),
per_day AS (SELECT customer_id, account_id, d, sum(CASE indicator WHEN 'credit' THEN size ELSE -size END) AS net FROM tx GROUP BY ALL),
daily AS (SELECT p.customer_id, p.account_id, d, account_status, credit_limit,
    current_balance - sum(net) OVER (PARTITION BY p.account_id ORDER BY d DESC ROWS UNBOUNDED PRECEDING) AS eod FROM per_day p JOIN ac ON p.account_id = ac.account_id),
bal AS (SELECT *, CAST(sum(eod) OVER w AS DOUBLE) / count(*) OVER w AS avg_30d_balance, min(eod) OVER w AS min_30d_balance, max(eod) OVER w AS max_30d_balance,
    row_number() OVER (PARTITION BY customer_id ORDER BY d DESC, account_id) AS customer_balance_rank
  FROM daily WINDOW w AS (PARTITION BY customer_id ORDER BY d, account_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
j AS (SELECT cu.customer_id, CAST(date_part('year', age(DATE '2024-02-03', date_of_birth)) AS BIGINT) AS customer_age, a.customer_tenure_days, a.account_count, a.active_account_count, a.closed_account_count,
    coalesce(b.eod, h.balance, 0) AS total_current_balance, b.eod AS own_balance, b.avg_30d_balance, b.min_30d_balance, b.max_30d_balance, s.* EXCLUDE (customer_id, last_transaction_date),
    coalesce(c.credit_limit, h.limits, 0) AS credit_limit, c.outstanding_loan_amount, c.loan_count, c.active_loan_count, c.overdue_loan_count, coalesce(c.credit_utilization_ratio, 0) AS used,
    coalesce(CAST(c.outstanding_loan_amount AS DOUBLE) / nullif(CAST(b.eod AS DOUBLE), 0), 0) AS debt, a.digital_activity_score, coalesce(days_since_last_transaction, 9999) AS idle
  FROM cu LEFT JOIN act a USING (customer_id) LEFT JOIN spend s USING (customer_id) LEFT JOIN credit c USING (customer_id)
    LEFT JOIN (SELECT * FROM bal WHERE customer_balance_rank = 1) b USING (customer_id) LEFT JOIN held h USING (customer_id)),
feat AS (SELECT customer_id, customer_age, customer_tenure_days, account_count, active_account_count, closed_account_count, CAST(total_current_balance AS DOUBLE) AS total_current_balance,
    CAST(coalesce(avg_30d_balance, 0) AS DOUBLE) AS avg_30d_balance, CAST(coalesce(min_30d_balance, 0) AS DOUBLE) AS min_30d_balance, CAST(coalesce(max_30d_balance, 0) AS DOUBLE) AS max_30d_balance,
    CAST(coalesce(total_spend_7d, 0) AS DOUBLE) AS total_spend_7d, CAST(coalesce(total_spend_30d, 0) AS DOUBLE) AS total_spend_30d, CAST(coalesce(total_spend_90d, 0) AS DOUBLE) AS total_spend_90d,
    coalesce(transaction_count_7d, 0) AS transaction_count_7d, coalesce(transaction_count_30d, 0) AS transaction_count_30d, coalesce(transaction_count_90d, 0) AS transaction_count_90d,
    CAST(coalesce(avg_transaction_amount, 0) AS DOUBLE) AS avg_transaction_amount, CAST(coalesce(max_transaction_amount, 0) AS DOUBLE) AS max_transaction_amount, idle AS days_since_last_transaction,
    CAST(coalesce(incoming_transfer_amount_30d, 0) AS DOUBLE) AS incoming_transfer_amount_30d, CAST(coalesce(outgoing_transfer_amount_30d, 0) AS DOUBLE) AS outgoing_transfer_amount_30d,
    CAST(credit_limit AS DOUBLE) AS credit_limit, CAST(coalesce(outstanding_loan_amount, 0) AS DOUBLE) AS outstanding_loan_amount, coalesce(loan_count, 0) AS loan_count,
    coalesce(active_loan_count, 0) AS active_loan_count, coalesce(overdue_loan_count, 0) AS overdue_loan_count, CAST(used AS DOUBLE) AS credit_utilization_ratio, CAST(debt AS DOUBLE) AS debt_to_balance_ratio,
    digital_activity_score, CAST(total_current_balance >= 50000 OR coalesce(total_spend_90d, 0) >= 25000 OR credit_limit >= 20000 AS BIGINT) AS high_value_customer_flag,
    CAST(idle > 90 OR coalesce(active_account_count, 0) = 0 AS BIGINT) AS inactive_customer_flag, CAST(coalesce(overdue_loan_count, 0) > 0 OR used >= 0.9 AS BIGINT) AS delinquency_flag,
    CASE WHEN coalesce(overdue_loan_count, 0) > 0 OR used >= 0.9 OR debt > 2 THEN 'high' WHEN used >= 0.6 OR idle > 45 THEN 'medium' ELSE 'low' END AS risk_segment FROM j)
"""


@query(
    "m1_stg_customers",
    BANK_SQL + "SELECT customer_id, first_name, last_name, CAST(date_of_birth AS VARCHAR) AS date_of_birth, CAST(onboarding_date AS VARCHAR) AS onboarding_date, customer_status, country_code, segment_code, email, phone_number, '2024-01-01 00:00:00' AS updated_at, customer_full_name, CAST(customer_status = 'active' AS BIGINT) AS is_active_customer FROM cu",
)
def stg_customers(spark, sf):
    return plain(stg(spark, sf)[0])


@query(
    "m1_stg_accounts",
    BANK_SQL + "SELECT account_id, customer_id, account_type, account_status, 'EUR' AS currency_code, CAST(current_balance AS DOUBLE) AS current_balance, CAST(current_balance AS DOUBLE) AS available_balance, CAST(credit_limit AS DOUBLE) AS credit_limit, '2015-01-01 10:00:00' AS opened_at, CAST(NULL AS VARCHAR) AS closed_at, '2024-01-01 00:00:00' AS updated_at, CAST(account_status = 'active' AS BIGINT) AS is_active_account, CAST(account_status = 'closed' AS BIGINT) AS is_closed_account FROM ac",
)
def stg_accounts(spark, sf):
    return plain(stg(spark, sf)[1])


@query(
    "m1_stg_loans",
    BANK_SQL + "SELECT loan_id, customer_id, customer_id AS account_id, loan_status, loan_type, CAST(principal AS DOUBLE) AS principal_amount, CAST(owed AS DOUBLE) AS outstanding_amount, CAST(rate AS DOUBLE) AS interest_rate, CAST(principal AS DOUBLE) AS installment_amount, CAST(opened AS VARCHAR) AS loan_open_date, CAST(due AS VARCHAR) AS due_date, CASE loan_status WHEN 'closed' THEN CAST(opened AS VARCHAR) END AS closed_date, CAST(loan_status <> 'closed' AS BIGINT) AS is_active_loan, CAST(loan_status = 'overdue' AS BIGINT) AS is_overdue_loan FROM lo",
)
def stg_loans(spark, sf):
    return plain(stg(spark, sf)[3])


@query(
    "m2_stg_transactions",
    BANK_SQL + """SELECT transaction_id, account_id, customer_id, strftime(transaction_timestamp, '%Y-%m-%d %H:%M:%S.%f') AS transaction_timestamp, CAST(d AS VARCHAR) AS transaction_date, kind AS transaction_type, indicator AS debit_credit_indicator,
      CAST(size * sign AS DOUBLE) AS amount, category AS merchant_category, channel, description, CAST(CASE indicator WHEN 'debit' THEN size ELSE 0 END AS DOUBLE) AS debit_amount,
      CAST(CASE indicator WHEN 'credit' THEN size ELSE 0 END AS DOUBLE) AS credit_amount, CAST(CASE WHEN kind IN ('card_payment', 'fee', 'outgoing_transfer') THEN size ELSE 0 END AS DOUBLE) AS spend_amount,
      CAST(CASE kind WHEN 'incoming_transfer' THEN size ELSE 0 END AS DOUBLE) AS incoming_transfer_amount, CAST(CASE kind WHEN 'outgoing_transfer' THEN size ELSE 0 END AS DOUBLE) AS outgoing_transfer_amount FROM tx""",
)
def stg_transactions(spark, sf):
    tx = stg(spark, sf)[2]
    return plain(tx.withColumn("transaction_timestamp", F.date_format("transaction_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


@query("m3_customer_activity", BANK_SQL + "SELECT * REPLACE (CAST(onboarding_date AS VARCHAR) AS onboarding_date, CAST(last_transaction_date AS VARCHAR) AS last_transaction_date) FROM act")
def customer_activity(spark, sf):
    cu, ac, tx, _ = stg(spark, sf)
    return plain(B.int_customer_activity(cu, ac, tx, AS_OF))


@query(
    "m4_credit_profile",
    BANK_SQL + "SELECT * REPLACE (CAST(credit_limit AS DOUBLE) AS credit_limit, CAST(revolving_balance AS DOUBLE) AS revolving_balance, CAST(outstanding_loan_amount AS DOUBLE) AS outstanding_loan_amount, CAST(credit_utilization_ratio AS DOUBLE) AS credit_utilization_ratio, CAST(first_loan_open_date AS VARCHAR) AS first_loan_open_date, CAST(latest_loan_due_date AS VARCHAR) AS latest_loan_due_date) FROM credit",
)
def credit_profile(spark, sf):
    _, ac, _, lo = stg(spark, sf)
    return plain(B.int_customer_credit_profile(lo, ac))


@query(
    "m5_daily_balance",
    BANK_SQL + "SELECT customer_id, account_id, CAST(d AS VARCHAR) AS balance_date, account_status, CAST(credit_limit AS DOUBLE) AS credit_limit, CAST(eod AS DOUBLE) AS estimated_end_of_day_balance, avg_30d_balance, CAST(min_30d_balance AS DOUBLE) AS min_30d_balance, CAST(max_30d_balance AS DOUBLE) AS max_30d_balance, customer_balance_rank FROM bal",
)
def daily_balance(spark, sf):
    _, ac, tx, _ = stg(spark, sf)
    return plain(B.int_customer_daily_balance(ac, tx))


@query(
    "m6_spend_metrics",
    BANK_SQL + "SELECT * REPLACE (CAST(total_spend_7d AS DOUBLE) AS total_spend_7d, CAST(total_spend_30d AS DOUBLE) AS total_spend_30d, CAST(total_spend_90d AS DOUBLE) AS total_spend_90d, CAST(max_transaction_amount AS DOUBLE) AS max_transaction_amount, CAST(incoming_transfer_amount_30d AS DOUBLE) AS incoming_transfer_amount_30d, CAST(outgoing_transfer_amount_30d AS DOUBLE) AS outgoing_transfer_amount_30d, CAST(last_transaction_date AS VARCHAR) AS last_transaction_date) FROM spend",
)
def spend_metrics(spark, sf):
    return plain(B.int_customer_spend_metrics(stg(spark, sf)[2], AS_OF))


def _features(spark, sf):
    cu, ac, tx, lo = stg(spark, sf)
    credit = B.int_customer_credit_profile(lo, ac)
    features = B.mart_customer_features(
        cu, ac, lo, tx, B.int_customer_activity(cu, ac, tx, AS_OF), B.int_customer_spend_metrics(tx, AS_OF), credit,
        B.int_customer_daily_balance(ac, tx), AS_OF,
    )
    return cu, credit, features


@query("m7_customer_features", BANK_SQL + "SELECT * FROM feat")
def customer_features(spark, sf):
    return plain(_features(spark, sf)[2])


@query(
    "m7_recent_transaction_profile",
    BANK_SQL + """SELECT customer_id, count(DISTINCT account_id) FILTER (d >= DATE '2024-01-04') AS active_accounts_with_transactions_30d,
      count(DISTINCT category) FILTER (d >= DATE '2023-11-05') AS merchant_category_count_90d,
      CAST(sum(size) FILTER (d >= DATE '2024-01-04') AS DOUBLE) / nullif(count(*) FILTER (d >= DATE '2024-01-04'), 0) AS avg_30d_transaction_amount FROM tx GROUP BY 1""",
)
def recent_transaction_profile(spark, sf):
    return plain(B.recent_transaction_profile(stg(spark, sf)[2], AS_OF))


@query(
    "m8_customer_360",
    BANK_SQL + "SELECT customer_id, customer_full_name, email, phone_number, country_code, segment_code, customer_age, customer_tenure_days, account_count, total_current_balance, total_spend_30d, active_loan_count, risk_segment, digital_activity_score FROM cu JOIN feat USING (customer_id)",
)
def customer_360(spark, sf):
    cu, _, features = _features(spark, sf)
    return plain(B.mart_customer_360(cu, features))


@query(
    "m8_risk_features",
    BANK_SQL + "SELECT customer_id, f.credit_utilization_ratio, debt_to_balance_ratio, f.overdue_loan_count, avg_loan_interest_rate, CAST(latest_loan_due_date AS VARCHAR) AS latest_loan_due_date, inactive_customer_flag, risk_segment, CAST(CASE risk_segment WHEN 'high' THEN 100 WHEN 'medium' THEN 60 ELSE 20 END AS BIGINT) AS risk_score FROM feat f LEFT JOIN credit c USING (customer_id)",
)
def risk_features(spark, sf):
    _, credit, features = _features(spark, sf)
    return plain(B.mart_risk_features(features, credit))


@query(
    "m8_feature_export",
    BANK_SQL + "SELECT * EXCLUDE (closed_account_count, min_30d_balance, max_30d_balance, total_spend_7d, transaction_count_7d, transaction_count_90d, max_transaction_amount), '2024-02-03 06:00:00' AS exported_at FROM feat",
)
def feature_export(spark, sf):
    return plain(B.mart_feature_store_export(_features(spark, sf)[2], STAMP))


def _shop(spark, sf):
    orders = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("order_date"),
        F.when(F.col("o_orderstatus") == "F", " Completed").otherwise("PENDING ").alias("order_status"),
    )
    products = I.table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.concat(F.lit(" "), "p_name").alias("product_name"), F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
    )
    return R.stg_orders(orders), R.stg_products(products)


SHOP_SQL = """
WITH so AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'pending' END AS order_status FROM orders),
sp AS (SELECT p_partkey AS product_id, trim(p_name) AS product_name, lower(p_type) AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part),
items AS (SELECT so.*, sp.* FROM so LEFT JOIN sp ON order_id = product_id),
summary AS (SELECT customer_id, count(DISTINCT order_id) AS order_count, CAST(sum(price) AS DOUBLE) AS lifetime_spend, count(*) FILTER (order_status = 'completed') AS completed_order_count FROM items GROUP BY 1)
"""


@query("m9_stg_orders", SHOP_SQL + "SELECT * FROM so")
def shop_orders(spark, sf):
    return plain(_shop(spark, sf)[0])


@query("m9_stg_products", SHOP_SQL + "SELECT product_id, product_name, category, CAST(price AS DOUBLE) AS unit_price FROM sp")
def shop_products(spark, sf):
    return plain(_shop(spark, sf)[1])


@query("m10_order_items", SHOP_SQL + "SELECT * EXCLUDE (price), CAST(price AS DOUBLE) AS unit_price FROM items")
def order_items(spark, sf):
    return plain(R.int_order_items(*_shop(spark, sf)))


@query("m10_customer_order_summary", SHOP_SQL + "SELECT * FROM summary")
def order_summary(spark, sf):
    return plain(R.int_customer_order_summary(R.int_order_items(*_shop(spark, sf))))


@query(
    "m11_retail_sales",
    SHOP_SQL + "SELECT *, CAST((200 * completed_order_count + order_count) // (2 * order_count) AS DOUBLE) / 100 AS completion_rate FROM summary",
)
def retail_sales(spark, sf):
    return plain(R.mart_retail_sales(R.int_customer_order_summary(R.int_order_items(*_shop(spark, sf)))))


@query("m11_top_products", SHOP_SQL + "SELECT product_id, product_name, category, count(*) AS times_ordered, CAST(sum(price) AS DOUBLE) AS total_revenue FROM items GROUP BY ALL")
def top_products(spark, sf):
    return plain(R.mart_top_products(R.int_order_items(*_shop(spark, sf))))


def _lending(spark, sf):
    borrowers = I.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("borrower_id"), (F.lit(300) + F.col("c_custkey") % 551).alias("credit_score"), F.col("c_acctbal").alias("annual_income")
    )
    applications = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("application_id"), F.col("o_custkey").alias("borrower_id"), F.col("o_totalprice").alias("requested_amount"),
        F.concat(F.lit(" "), "o_orderstatus").alias("application_status"),
    )
    return L.stg_loan_applications(applications), L.stg_borrowers(borrowers)


LEND_SQL = """
WITH bo AS (SELECT c_custkey AS borrower_id, 300 + c_custkey % 551 AS credit_score, CAST(c_acctbal AS DECIMAL(18,2)) AS annual_income FROM customer),
ap AS (SELECT o_orderkey AS application_id, o_custkey AS borrower_id, CAST(o_totalprice AS DECIMAL(18,2)) AS requested_amount, lower(o_orderstatus) AS application_status FROM orders),
uw AS (SELECT ap.*, credit_score, annual_income FROM ap LEFT JOIN bo USING (borrower_id)),
risk AS (SELECT borrower_id, credit_score, annual_income, requested_amount, CASE WHEN credit_score >= 720 THEN 'low' WHEN credit_score >= 620 THEN 'medium' ELSE 'high' END AS risk_band FROM uw)
"""


@query("m12_stg_borrowers", LEND_SQL + "SELECT * REPLACE (CAST(annual_income AS DOUBLE) AS annual_income) FROM bo")
def stg_borrowers(spark, sf):
    return plain(_lending(spark, sf)[1])


@query("m12_stg_loan_applications", LEND_SQL + "SELECT * REPLACE (CAST(requested_amount AS DOUBLE) AS requested_amount) FROM ap")
def stg_loan_applications(spark, sf):
    return plain(_lending(spark, sf)[0])


@query("m12_loan_underwriting", LEND_SQL + "SELECT * REPLACE (CAST(requested_amount AS DOUBLE) AS requested_amount, CAST(annual_income AS DOUBLE) AS annual_income) FROM uw")
def loan_underwriting(spark, sf):
    return plain(L.int_loan_underwriting(*_lending(spark, sf)))


@query("m12_borrower_risk", LEND_SQL + "SELECT * REPLACE (CAST(requested_amount AS DOUBLE) AS requested_amount, CAST(annual_income AS DOUBLE) AS annual_income) FROM risk")
def borrower_risk(spark, sf):
    return plain(L.int_borrower_risk(L.int_loan_underwriting(*_lending(spark, sf))))


@query(
    "m13_loan_portfolio",
    LEND_SQL + "SELECT application_id, borrower_id, CAST(u.requested_amount AS DOUBLE) AS requested_amount, application_status, risk_band, count(*) AS copies FROM uw u LEFT JOIN risk r USING (borrower_id) GROUP BY ALL",
)
def loan_portfolio(spark, sf):
    underwriting = L.int_loan_underwriting(*_lending(spark, sf))
    return plain(L.mart_loan_portfolio(underwriting, L.int_borrower_risk(underwriting)))


@query("m13_default_risk", LEND_SQL + "SELECT risk_band, count(*) AS borrower_count, CAST(sum(requested_amount) AS DOUBLE) AS total_requested_amount, CAST(sum(requested_amount) AS DOUBLE) / count(*) AS avg_requested_amount FROM risk GROUP BY 1")
def default_risk(spark, sf):
    return plain(L.mart_default_risk(L.int_borrower_risk(L.int_loan_underwriting(*_lending(spark, sf)))))
