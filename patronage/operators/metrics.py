"""RFM scores and customer metrics, computed from the transaction summary alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions import fixed_values as fx
from patronage.functions import rules
from patronage.operators.ntile import By, ntile_global
from patronage.params import RunParams

TILES = 5
SCORES = ("RecencyScore", "FrequencyScore", "MonetaryScore")
METRIC_COLUMNS = (
    "CustomerID",
    "CustomerLifetimeValue",
    *SCORES,
    "RFMScore",
    "ChurnProbability",
    "NextPurchasePropensity",
    "LoyaltyIndex",
    "CustomerHealth",
)


def with_rfm(summary: DataFrame, p: RunParams) -> DataFrame:
    """Adds the three scores and their sum. ``summary`` is read twice; store it first."""
    rankings = {
        "RecencyScore": F.coalesce("DaysSinceLastPurchase", F.lit(fx.UNKNOWN_RECENCY_DAYS)),
        "FrequencyScore": By(F.coalesce("TotalOrders", F.lit(0)), descending=True),
        "MonetaryScore": By(F.coalesce("TotalSpent", F.lit(0)), descending=True),
    }
    scored = ntile_global(summary, rankings, TILES, "CustomerID")
    if p.score_orientation == "five_is_best":
        scored = scored.withColumns({name: F.lit(TILES + 1) - F.col(name) for name in SCORES})
    return scored.withColumn("RFMScore", sum((F.col(name) for name in SCORES[1:]), F.col(SCORES[0])))


def rfm_scores(summary: DataFrame, p: RunParams) -> DataFrame:
    return with_rfm(summary, p).select("CustomerID", *SCORES, "RFMScore")


def with_metrics(scored: DataFrame, p: RunParams) -> DataFrame:
    """Adds churn, propensity, loyalty, lifetime value and health. Health tests the unrounded loyalty."""
    churn, loyalty = F.col("ChurnProbability"), F.col("LoyaltyExact")
    return (
        scored.withColumns(
            {
                "ChurnProbability": rules.churn_probability(p),
                "NextPurchasePropensity": rules.purchase_propensity(p),
                "LoyaltyExact": rules.loyalty_exact(p),
            }
        )
        .withColumns(
            {
                "CustomerLifetimeValue": rules.lifetime_value(churn, p),
                "LoyaltyIndex": loyalty.cast(p.rate_type),
                "CustomerHealth": rules.customer_health(churn, loyalty),
            }
        )
        .drop("LoyaltyExact")
    )


def customer_metrics(summary: DataFrame, p: RunParams) -> DataFrame:
    return with_metrics(with_rfm(summary, p), p).select(*METRIC_COLUMNS)
