"""Retail banking: customers, accounts, transactions and loans up to feature marts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.operators.windows import rolling, with_positions
from tributary.plans import MONEY, RATE, flag, mean, or_zero, shout, tidy
from tributary.scratch import Scratch

# Codes and thresholds of the feature definitions.
SPEND_TYPES = ("card_payment", "cash_withdrawal", "fee", "outgoing_transfer", "loan_payment")
DIGITAL_CHANNELS = ("mobile", "web")
OPEN_LOANS = ("active", "overdue")
NEVER_ACTIVE_DAYS = 9999
RISK_SCORES = {"high": 100, "medium": 60, "low": 20}


def _since(as_of: dt.date, days: int, column: str = "transaction_date") -> Column:
    return F.col(column) >= F.date_sub(F.lit(as_of), days)


def completed_years(as_of: Column, born: Column) -> Column:
    """Whole years between two dates; a birthday counts from its calendar day on."""
    ahead = F.date_format(as_of, "MMdd") < F.date_format(born, "MMdd")
    return F.year(as_of) - F.year(born) - ahead.cast("int")


def stg_accounts(accounts: DataFrame) -> DataFrame:
    status = tidy("account_status")
    return accounts.select(
        F.col("account_id").cast("bigint"), F.col("customer_id").cast("bigint"),
        tidy("account_type").alias("account_type"), status.alias("account_status"),
        shout("currency_code").alias("currency_code"),
        *[F.col(c).cast(MONEY) for c in ("current_balance", "available_balance", "credit_limit")],
        *[F.col(c).cast("timestamp_ntz") for c in ("opened_at", "closed_at", "updated_at")],
        flag(status == "active").alias("is_active_account"),
        flag(status == "closed").alias("is_closed_account"),
    )


def stg_customers(customers: DataFrame) -> DataFrame:
    status = tidy("customer_status")
    return customers.select(
        F.col("customer_id").cast("bigint"),
        F.trim("first_name").alias("first_name"), F.trim("last_name").alias("last_name"),
        F.col("date_of_birth").cast("date"), F.col("onboarding_date").cast("date"),
        status.alias("customer_status"),
        shout("country_code").alias("country_code"), shout("segment_code").alias("segment_code"),
        tidy("email").alias("email"), "phone_number", F.col("updated_at").cast("timestamp_ntz"),
        F.concat_ws(" ", F.trim("first_name"), F.trim("last_name")).alias("customer_full_name"),
        flag(status == "active").alias("is_active_customer"),
    )


def stg_loans(loans: DataFrame) -> DataFrame:
    status = tidy("loan_status")
    return loans.select(
        *[F.col(c).cast("bigint") for c in ("loan_id", "customer_id", "account_id")],
        status.alias("loan_status"), tidy("loan_type").alias("loan_type"),
        F.col("principal_amount").cast(MONEY), F.col("outstanding_amount").cast(MONEY),
        F.col("interest_rate").cast(RATE), F.col("installment_amount").cast(MONEY),
        *[F.col(c).cast("date") for c in ("loan_open_date", "due_date", "closed_date")],
        flag(status.isin(*OPEN_LOANS)).alias("is_active_loan"),
        flag(status == "overdue").alias("is_overdue_loan"),
    )


def stg_transactions(transactions: DataFrame) -> DataFrame:
    typed = transactions.where("transaction_timestamp is not null").select(
        *[F.col(c).cast("bigint") for c in ("transaction_id", "account_id", "customer_id")],
        F.col("transaction_timestamp").cast("timestamp_ntz"),
        F.col("transaction_timestamp").cast("date").alias("transaction_date"),
        tidy("transaction_type").alias("transaction_type"),
        tidy("debit_credit_indicator").alias("debit_credit_indicator"),
        F.col("amount").cast(MONEY),
        tidy("merchant_category").alias("merchant_category"), tidy("channel").alias("channel"), "description",
    )
    nothing = F.lit(0).cast(MONEY)
    size_if = lambda condition: F.when(condition, F.abs("amount")).otherwise(nothing)
    kind = F.col("transaction_type")
    return typed.select(
        "*",
        size_if(F.col("debit_credit_indicator") == "debit").alias("debit_amount"),
        size_if(F.col("debit_credit_indicator") == "credit").alias("credit_amount"),
        size_if(kind.isin(*SPEND_TYPES)).alias("spend_amount"),
        size_if(kind == "incoming_transfer").alias("incoming_transfer_amount"),
        size_if(kind == "outgoing_transfer").alias("outgoing_transfer_amount"),
    )


def int_customer_activity(
    customers: DataFrame, accounts: DataFrame, transactions: DataFrame, as_of: dt.date
) -> DataFrame:
    """Tenure, account counts and digital activity per customer."""
    held = accounts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("account_count"),
        F.sum("is_active_account").alias("active_account_count"),
        F.sum("is_closed_account").alias("closed_account_count"),
    )
    digital = F.col("channel").isin(*DIGITAL_CHANNELS) & _since(as_of, 30)
    # One row per customer and day first: the distinct day counts then need no Expand.
    daily = transactions.groupBy("customer_id", "transaction_date").agg(
        F.count(F.lit(1)).alias("n"), F.max(digital).alias("digital")
    )
    moved = daily.groupBy("customer_id").agg(
        F.sum("n").alias("lifetime_transaction_count"),
        F.count("transaction_date").alias("active_transaction_days"),
        F.max("transaction_date").alias("last_transaction_date"),
        F.count_if("digital").alias("digital_active_days_30d"),
    )
    counts = (
        "account_count active_account_count closed_account_count lifetime_transaction_count active_transaction_days"
    ).split()
    points = F.col("digital_active_days_30d") * 4 + F.col("active_transaction_days")
    return (
        customers.select("customer_id", "onboarding_date", "customer_status")
        .join(held, "customer_id", "left")
        .join(moved, "customer_id", "left")
        .na.fill(0, [*counts, "digital_active_days_30d"])
        .select(
            "customer_id", "onboarding_date", "customer_status", *counts, "last_transaction_date", "digital_active_days_30d",
            F.datediff(F.lit(as_of), "onboarding_date").alias("customer_tenure_days"),
            F.when(F.col("customer_status") == "active", F.least(F.lit(100), points)).otherwise(0).alias("digital_activity_score"),
        )
    )


def int_customer_credit_profile(loans: DataFrame, accounts: DataFrame) -> DataFrame:
    """Loans and revolving credit per customer, also for customers with only one of them."""
    borrowed = loans.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("loan_count"),
        F.sum(flag(F.col("is_active_loan") == 1)).alias("active_loan_count"),
        F.sum(flag(F.col("is_overdue_loan") == 1)).alias("overdue_loan_count"),
        F.sum(or_zero("outstanding_amount")).alias("outstanding_loan_amount"),
        mean(F.nullif("interest_rate", F.lit(0))).alias("avg_loan_interest_rate"),
        F.min("loan_open_date").alias("first_loan_open_date"),
        F.max("due_date").alias("latest_loan_due_date"),
    )
    owed = F.greatest(or_zero("current_balance"), F.lit(0).cast(MONEY))
    revolving = accounts.groupBy("customer_id").agg(
        F.sum(or_zero("credit_limit")).alias("credit_limit"),
        F.sum(F.when(F.col("account_type") == "credit", owed).otherwise(0)).alias("revolving_balance"),
    )
    used = F.col("revolving_balance").cast("double") / F.nullif(F.col("credit_limit").cast("double"), F.lit(0.0))
    return borrowed.join(revolving, "customer_id", "full_outer").select(
        "customer_id",
        *[
            or_zero(c).alias(c)
            for c in ("credit_limit", "revolving_balance", "outstanding_loan_amount", "loan_count", "active_loan_count", "overdue_loan_count")
        ],
        "avg_loan_interest_rate", "first_loan_open_date", "latest_loan_due_date",
        F.coalesce(used, F.lit(0.0)).alias("credit_utilization_ratio"),
    )


def int_customer_daily_balance(accounts: DataFrame, transactions: DataFrame, block: int = 100_000) -> DataFrame:
    """Back-calculated end-of-day balances, rolling over 30 rows, ranked newest first.

    The running sum works on one row per account and day, so its window is bounded by the calendar.
    The rolling frame covers all accounts of a customer and is therefore cut into blocks.
    """
    signed = F.when(F.col("debit_credit_indicator") == "credit", F.abs("amount")).otherwise(-F.abs("amount"))
    per_day = transactions.groupBy("customer_id", "account_id", F.col("transaction_date").alias("balance_date")).agg(
        F.sum(signed).alias("net")
    )
    newest_first = (
        Window.partitionBy("account_id")
        .orderBy(F.col("balance_date").desc_nulls_last(), "customer_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    owned = accounts.select("account_id", "account_status", "credit_limit", "current_balance")
    daily = (
        per_day.withColumn("net_after", F.sum("net").over(newest_first))
        .join(owned, "account_id")
        .select(
            "customer_id", "account_id", "balance_date", "account_status", "credit_limit",
            (F.col("current_balance") - F.col("net_after")).alias("estimated_end_of_day_balance"),
        )
    )
    placed = with_positions(daily, ["customer_id"], ["balance_date", "account_id"])
    placed = Scratch(daily.sparkSession, "daily-balance").save(placed, "placed")
    days = placed.groupBy("customer_id", "balance_date").agg(F.count(F.lit(1)).alias("n"))
    by_date = Window.partitionBy("customer_id").orderBy("balance_date")
    days = days.select(
        "customer_id", "balance_date",
        F.sum("n").over(by_date).alias("through"),
        (F.sum("n").over(by_date) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("customer_id")).alias("total"),
    )
    balance = F.col("estimated_end_of_day_balance")
    rolled = rolling(
        placed, ["customer_id"], 30,
        {"sum_": F.sum(balance), "n_": F.count(balance), "min_30d_balance": F.min(balance), "max_30d_balance": F.max(balance)},
        block=block,
    )
    return rolled.join(days, ["customer_id", "balance_date"]).select(
        "customer_id", "account_id", "balance_date", "account_status", "credit_limit", "estimated_end_of_day_balance",
        (F.col("sum_").cast("double") / F.nullif("n_", F.lit(0)).cast("double")).alias("avg_30d_balance"),
        "min_30d_balance", "max_30d_balance",
        (F.col("total") - F.col("through") + F.col("position") - F.col("before")).alias("customer_balance_rank"),
    )


def int_customer_spend_metrics(transactions: DataFrame, as_of: dt.date) -> DataFrame:
    """Spend and activity over 7, 30 and 90 days in one pass."""
    nothing = F.lit(0).cast(MONEY)

    def spent(column: str, days: int) -> Column:
        return F.sum(F.when(_since(as_of, days), F.col(column)).otherwise(nothing))

    size = F.abs("amount")
    return transactions.groupBy("customer_id").agg(
        *[spent("spend_amount", d).alias(f"total_spend_{d}d") for d in (7, 30, 90)],
        *[F.count(F.when(_since(as_of, d), F.col("transaction_id"))).alias(f"transaction_count_{d}d") for d in (7, 30, 90)],
        mean(size).alias("avg_transaction_amount"),
        F.max(size).alias("max_transaction_amount"),
        F.max("transaction_date").alias("last_transaction_date"),
        F.datediff(F.lit(as_of), F.max("transaction_date")).alias("days_since_last_transaction"),
        spent("incoming_transfer_amount", 30).alias("incoming_transfer_amount_30d"),
        spent("outgoing_transfer_amount", 30).alias("outgoing_transfer_amount_30d"),
        F.count_distinct(F.when(_since(as_of, 90), F.col("transaction_type"))).alias("distinct_transaction_type_count_90d"),
    )


def recent_transaction_profile(transactions: DataFrame, as_of: dt.date) -> DataFrame:
    """Recently used accounts and categories per customer, and the recent mean amount."""
    return transactions.groupBy("customer_id").agg(
        F.count_distinct(F.when(_since(as_of, 30), F.col("account_id"))).alias("active_accounts_with_transactions_30d"),
        F.count_distinct(F.when(_since(as_of, 90), F.col("merchant_category"))).alias("merchant_category_count_90d"),
        mean(F.when(_since(as_of, 30), F.abs("amount"))).alias("avg_30d_transaction_amount"),
    )


def mart_customer_features(
    customers: DataFrame,
    accounts: DataFrame,
    loans: DataFrame,
    transactions: DataFrame,
    activity: DataFrame,
    spend: DataFrame,
    credit: DataFrame,
    daily_balance: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """The central feature table: one row per customer.

    All seven inputs are reduced to one row per customer before the joins, so the joins share one
    partitioning on the key and none of them multiplies rows.
    """
    latest_balance = daily_balance.where("customer_balance_rank = 1").groupBy("customer_id").agg(
        F.sum("estimated_end_of_day_balance").alias("total_current_balance"),
        F.avg("avg_30d_balance").alias("avg_30d_balance"),
        F.min("min_30d_balance").alias("min_30d_balance"),
        F.max("max_30d_balance").alias("max_30d_balance"),
    )
    account_rollup = accounts.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("raw_account_count"),
        F.sum(flag(F.col("account_status") == "active")).alias("raw_active_account_count"),
        F.sum(flag(F.col("account_status") == "closed")).alias("raw_closed_account_count"),
        F.sum(or_zero("current_balance")).alias("source_total_current_balance"),
        F.sum(or_zero("credit_limit")).alias("source_credit_limit"),
    )
    loan_rollup = loans.groupBy("customer_id").agg(
        F.sum(flag(F.col("loan_status") == "overdue")).alias("raw_overdue_loan_count"),
        F.sum(flag(F.col("loan_status").isin(*OPEN_LOANS))).alias("raw_active_loan_count"),
    )
    joined = customers.select("customer_id", "date_of_birth")
    for side in (
        activity.drop("onboarding_date", "customer_status"),
        spend.drop("last_transaction_date"),
        credit.drop("first_loan_open_date", "latest_loan_due_date"),
        latest_balance,
        account_rollup,
        loan_rollup,
    ):
        joined = joined.join(side, "customer_id", "left")

    known_balance = or_zero("total_current_balance", "source_total_current_balance")
    known_limit = or_zero("credit_limit", "source_credit_limit")
    idle = F.coalesce("days_since_last_transaction", F.lit(NEVER_ACTIVE_DAYS))
    overdue = or_zero("overdue_loan_count")
    used = F.coalesce("credit_utilization_ratio", F.lit(0.0))
    own_balance = F.nullif(F.col("total_current_balance").cast("double"), F.lit(0.0))
    debt = F.coalesce(F.col("outstanding_loan_amount").cast("double") / own_balance, F.lit(0.0))
    stressed = (overdue > 0) | (used >= 0.9)
    plain = (
        "avg_30d_balance min_30d_balance max_30d_balance total_spend_7d total_spend_30d total_spend_90d "
        "transaction_count_7d transaction_count_30d transaction_count_90d avg_transaction_amount max_transaction_amount"
    ).split()
    return joined.select(
        "customer_id",
        completed_years(F.lit(as_of), F.col("date_of_birth")).alias("customer_age"),
        "customer_tenure_days",
        or_zero("account_count", "raw_account_count").alias("account_count"),
        or_zero("active_account_count", "raw_active_account_count").alias("active_account_count"),
        or_zero("closed_account_count", "raw_closed_account_count").alias("closed_account_count"),
        known_balance.alias("total_current_balance"),
        *[or_zero(c).alias(c) for c in plain],
        idle.alias("days_since_last_transaction"),
        or_zero("incoming_transfer_amount_30d").alias("incoming_transfer_amount_30d"),
        or_zero("outgoing_transfer_amount_30d").alias("outgoing_transfer_amount_30d"),
        known_limit.alias("credit_limit"),
        or_zero("outstanding_loan_amount").alias("outstanding_loan_amount"),
        or_zero("loan_count").alias("loan_count"),
        or_zero("active_loan_count", "raw_active_loan_count").alias("active_loan_count"),
        or_zero("overdue_loan_count", "raw_overdue_loan_count").alias("overdue_loan_count"),
        used.alias("credit_utilization_ratio"),
        debt.alias("debt_to_balance_ratio"),
        or_zero("digital_activity_score").alias("digital_activity_score"),
        flag((known_balance >= 50000) | (or_zero("total_spend_90d") >= 25000) | (known_limit >= 20000)).alias("high_value_customer_flag"),
        flag((idle > 90) | (or_zero("active_account_count") == 0)).alias("inactive_customer_flag"),
        flag(stressed).alias("delinquency_flag"),
        F.when(stressed | (debt > 2), "high").when((used >= 0.6) | (idle > 45), "medium").otherwise("low").alias("risk_segment"),
    )


def mart_customer_360(customers: DataFrame, features: DataFrame) -> DataFrame:
    """Profile next to headline features."""
    profile = customers.select("customer_id", "customer_full_name", "email", "phone_number", "country_code", "segment_code")
    headline = features.select(
        "customer_id", "customer_age", "customer_tenure_days", "account_count", "total_current_balance",
        "total_spend_30d", "active_loan_count", "risk_segment", "digital_activity_score",
    )
    return profile.join(headline, "customer_id")


def mart_risk_features(features: DataFrame, credit: DataFrame) -> DataFrame:
    """Risk view with a numeric score."""
    score = F.when(F.col("risk_segment") == "high", RISK_SCORES["high"]).when(
        F.col("risk_segment") == "medium", RISK_SCORES["medium"]
    )
    cost = credit.select("customer_id", "avg_loan_interest_rate", "latest_loan_due_date")
    return features.join(cost, "customer_id", "left").select(
        "customer_id", "credit_utilization_ratio", "debt_to_balance_ratio", "overdue_loan_count",
        "avg_loan_interest_rate", "latest_loan_due_date", "inactive_customer_flag", "risk_segment",
        score.otherwise(RISK_SCORES["low"]).alias("risk_score"),
    )


def mart_feature_store_export(features: DataFrame, exported_at: dt.datetime) -> DataFrame:
    """The delivered feature columns, stamped."""
    left_out = (
        "closed_account_count min_30d_balance max_30d_balance total_spend_7d transaction_count_7d "
        "transaction_count_90d max_transaction_amount"
    ).split()
    return features.drop(*left_out).withColumn("exported_at", F.lit(exported_at.isoformat(sep=" ")).cast("timestamp_ntz"))
