"""Lending: applications and borrowers up to portfolio marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.plans import MONEY, mean, tidy

# Lower score bounds of the risk bands.
LOW_RISK_SCORE = 720
MEDIUM_RISK_SCORE = 620


def stg_borrowers(borrowers: DataFrame) -> DataFrame:
    return borrowers.select(
        F.col("borrower_id").cast("bigint"), F.col("credit_score").cast("int"), F.col("annual_income").cast(MONEY)
    )


def stg_loan_applications(applications: DataFrame) -> DataFrame:
    return applications.select(
        F.col("application_id").cast("bigint"), F.col("borrower_id").cast("bigint"),
        F.col("requested_amount").cast(MONEY), tidy("application_status").alias("application_status"),
    )


def int_loan_underwriting(applications: DataFrame, borrowers: DataFrame) -> DataFrame:
    return applications.join(borrowers, "borrower_id", "left").select(
        "application_id", "borrower_id", "requested_amount", "application_status", "credit_score", "annual_income"
    )


def int_borrower_risk(underwriting: DataFrame) -> DataFrame:
    """Risk band per underwritten application."""
    score = F.col("credit_score")
    band = F.when(score >= LOW_RISK_SCORE, "low").when(score >= MEDIUM_RISK_SCORE, "medium").otherwise("high")
    return underwriting.select("borrower_id", "credit_score", "annual_income", "requested_amount", band.alias("risk_band"))


def mart_loan_portfolio(underwriting: DataFrame, risk: DataFrame) -> DataFrame:
    """Applications with the borrower's risk band; ``copies`` says how often the row occurs.

    Both sides have one row per application, so the plain join repeats each application once per
    application of its borrower: the square of a busy borrower's rows. Equal rows are counted
    instead of repeated; :func:`repeat_copies` writes them out.
    """
    bands = risk.groupBy("borrower_id", "risk_band").agg(F.count(F.lit(1)).alias("copies"))
    return underwriting.join(bands, "borrower_id", "left").select(
        "application_id", "borrower_id", "requested_amount", "application_status", "risk_band",
        F.coalesce("copies", F.lit(1)).alias("copies"),
    )


_RUN = 10_000


def repeat_copies(portfolio: DataFrame) -> DataFrame:
    """One row per copy; lists of at most ``_RUN`` copies are dealt out again before they grow."""
    runs = F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(_RUN).cast("bigint"))
    parts = portfolio.withColumn("start_", F.explode(runs)).repartition("application_id", "start_")
    own = F.sequence(F.lit(1).cast("bigint"), F.least(F.col("copies") - F.col("start_"), F.lit(_RUN)))
    return parts.withColumn("copy_", F.explode(own)).drop("start_", "copy_", "copies")


def mart_default_risk(risk: DataFrame) -> DataFrame:
    """Volume per risk band."""
    return risk.groupBy("risk_band").agg(
        F.count(F.lit(1)).alias("borrower_count"),
        F.sum("requested_amount").alias("total_requested_amount"),
        mean(F.col("requested_amount")).alias("avg_requested_amount"),
    )
