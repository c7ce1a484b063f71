"""Windows, contracts and feature models on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tributary.operators import contracts, windows
from tributary.plans import banking as B
from tributary.plans import lending as L
from tributary.plans import retail as R


def test_positions_and_rolling_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(100)) for i in range(400)] + [(f"g{i % 7}", i, i) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(6)
    placed = windows.with_positions(df, ["g"], ["t"], sums={"run": F.col("v")})
    rolled = windows.rolling(placed, ["g"], 30, {"s": F.sum("v"), "n": F.count("v"), "lo": F.min("v")}, block=32)
    groups = {}
    for g, t, v in sorted(rows):
        groups.setdefault(g, []).append((t, v))
    expected = set()
    for g, items in groups.items():
        values = [v for _, v in items]
        for i, (t, v) in enumerate(items):
            frame = values[max(0, i - 29): i + 1]
            expected.add((g, t, i + 1, sum(values[: i + 1]), sum(frame), len(frame), min(frame)))
    got = [(r.g, r.t, r.position, r.run, r.s, r.n, r.lo) for r in rolled.collect()]
    assert len(got) == len(rows) and set(got) == expected


def test_running_totals_skip_nulls(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 2)], "g string, t int, v int").repartition(3)
    rows = windows.with_positions(df, ["g"], [F.col("t").desc()], sums={"run": F.col("v")}).orderBy("position").collect()
    assert [(r.t, r.run) for r in rows] == [(4, 2), (3, 2), (2, 7), (1, 7)]


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 9), ("a", 2, 1), ("a", 2, 0), ("b", 1, 1)], "g string, t int, k int")
    rows = windows.latest(df, ["g"], [F.desc("t"), F.asc("k")]).collect()
    assert sorted((r.g, r.t, r.k) for r in rows) == [("a", 2, 0), ("b", 1, 1)]


def balances(spark, block):
    accounts = spark.createDataFrame(
        [(i, 1 if i < 5 else 2, "checking", "active", "eur", 100.0 + i, 0.0, 10.0, None, None, None) for i in range(8)],
        "account_id long, customer_id long, account_type string, account_status string, currency_code string, current_balance double, "
        "available_balance double, credit_limit double, opened_at string, closed_at string, updated_at string",
    )
    rng = random.Random(9)
    tx = [
        (n, n % 8, 1 if n % 8 < 5 else 2, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(25)), "fee", rng.choice(["debit", "credit"]), rng.randrange(1, 50) / 4, "c", "web", None)
        for n in range(200)
    ]
    transactions = spark.createDataFrame(
        tx, "transaction_id long, account_id long, customer_id long, transaction_timestamp timestamp_ntz, transaction_type string, "
        "debit_credit_indicator string, amount double, merchant_category string, channel string, description string",
    )
    return B.int_customer_daily_balance(B.stg_accounts(accounts), B.stg_transactions(transactions), block=block)


def test_daily_balance_is_the_same_for_any_block_size(spark):
    key = lambda r: tuple(r)
    whole = sorted(map(key, balances(spark, 100_000).collect()))
    cut = sorted(map(key, balances(spark, 30).collect()))
    assert whole == cut
    by_customer = {}
    for r in balances(spark, 30).collect():
        by_customer.setdefault(r.customer_id, []).append(r)
    for rows in by_customer.values():
        newest = sorted(rows, key=lambda r: (-r.balance_date.toordinal(), r.account_id))
        assert [r.customer_balance_rank for r in newest] == list(range(1, len(rows) + 1))
        oldest = sorted(rows, key=lambda r: (r.balance_date, r.account_id))
        for i, r in enumerate(oldest):
            frame = [x.estimated_end_of_day_balance for x in oldest[max(0, i - 29): i + 1]]
            assert r.min_30d_balance == min(frame) and r.max_30d_balance == max(frame)
            assert abs(r.avg_30d_balance - float(sum(frame)) / len(frame)) < 1e-9


def test_completed_years(spark):
    cases = [("2000-02-29", "2024-02-28", 23), ("2000-02-29", "2024-02-29", 24), ("1990-06-15", "2024-06-14", 33), ("1990-06-15", "2024-06-15", 34)]
    for born, today, years in cases:
        row = spark.range(1).select(B.completed_years(F.lit(today).cast("date"), F.lit(born).cast("date")).alias("y")).first()
        assert row.y == years


def test_staging_drops_only_missing_timestamps(spark):
    raw = spark.createDataFrame(
        [(1, 1, 1, "2024-01-05 10:00:00", " Fee ", "DEBIT", -3.25, " Food ", "Web", "x"), (2, 1, 1, None, "fee", "debit", 1.0, "f", "web", "y")],
        "transaction_id int, account_id int, customer_id int, transaction_timestamp string, transaction_type string, debit_credit_indicator string, "
        "amount double, merchant_category string, channel string, description string",
    )
    row, = B.stg_transactions(raw).collect()
    assert (row.transaction_type, row.debit_amount, row.credit_amount, row.spend_amount) == ("fee", row.spend_amount, 0, row.debit_amount)
    assert float(row.amount) == -3.25 and float(row.spend_amount) == 3.25 and row.transaction_date == dt.date(2024, 1, 5)


def test_credit_profile_keeps_both_sides_and_zero_limits(spark):
    loans = spark.createDataFrame(
        [(1, 1, 1, "active", "x", 10.0, 5.0, 0.0, 1.0, "2020-01-01", "2021-01-01", None)],
        "loan_id int, customer_id int, account_id int, loan_status string, loan_type string, principal_amount double, outstanding_amount double, "
        "interest_rate double, installment_amount double, loan_open_date string, due_date string, closed_date string",
    )
    accounts = spark.createDataFrame(
        [(1, 2, "credit", "active", "e", -5.0, 0.0, 0.0, None, None, None), (2, 2, "credit", "active", "e", 7.0, 0.0, None, None, None, None)],
        "account_id int, customer_id int, account_type string, account_status string, currency_code string, current_balance double, "
        "available_balance double, credit_limit double, opened_at string, closed_at string, updated_at string",
    )
    rows = {r.customer_id: r for r in B.int_customer_credit_profile(B.stg_loans(loans), B.stg_accounts(accounts)).collect()}
    assert rows[1].avg_loan_interest_rate is None and float(rows[1].credit_limit) == 0 and rows[1].active_loan_count == 1
    assert float(rows[2].revolving_balance) == 7 and rows[2].credit_utilization_ratio == 0 and rows[2].loan_count == 0


def test_portfolio_copies_equal_the_plain_join(spark):
    applications = spark.createDataFrame([(i, i % 3 if i else None, 10.0 * i, " Open") for i in range(10)], "application_id int, borrower_id int, requested_amount double, application_status string")
    borrowers = spark.createDataFrame([(0, 700, 1.0), (1, 800, 1.0)], "borrower_id int, credit_score int, annual_income double")
    uw = L.int_loan_underwriting(L.stg_loan_applications(applications), L.stg_borrowers(borrowers))
    risk = L.int_borrower_risk(uw)
    direct = uw.join(risk.select("borrower_id", "risk_band"), "borrower_id", "left").select(
        "application_id", "borrower_id", "requested_amount", "application_status", "risk_band"
    )
    repeated = L.repeat_copies(L.mart_loan_portfolio(uw, risk))
    assert sorted(map(str, repeated.collect())) == sorted(map(str, direct.collect()))


def test_completion_rate_rounds_half_up(spark):
    items = spark.createDataFrame([(1, n, "completed" if n < 1 else "open", 1.0) for n in range(8)], "customer_id int, order_id int, order_status string, unit_price double")
    row = R.mart_retail_sales(R.int_customer_order_summary(items)).first()
    assert float(row.completion_rate) == 0.13 and row.order_count == 8


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (None, "z"), (None, "a")], "k int, v string")
    assert contracts.not_null(df, "v").count() == 1
    assert [tuple(r) for r in contracts.unique(df, "k").collect()] == [(1, 2)]
    assert [tuple(r) for r in contracts.accepted_values(df, "v", ["a"]).collect()] == [("z", 1)]
    parent = spark.createDataFrame([(2,)], "id int")
    assert contracts.relationships(df, "k", parent, "id").count() == 2
    times = spark.createDataFrame([(dt.datetime(2024, 1, 1, 12),)], "ts timestamp_ntz")
    state = lambda *at: contracts.freshness(times, "ts", dt.datetime(*at)).first().status
    assert state(2024, 1, 2, 12) == "pass" and state(2024, 1, 2, 13) == "warn" and state(2024, 1, 3, 13) == "error"
    assert contracts.freshness(times.limit(0), "ts", dt.datetime(2024, 1, 1)).first().status == "error"
    report = contracts.report([("holds", contracts.not_null(parent, "id")), ("fails", contracts.not_null(df, "k"))])
    assert {tuple(r) for r in report.collect()} == {("holds", 0), ("fails", 2)}
