"""Every branch and boundary of the rules, against the rules written out in plain Python."""

from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from patronage.functions import rules
from patronage.operators.metrics import with_metrics
from patronage.operators.segments import with_segments
from patronage.params import RunParams

P = RunParams()
D = Decimal
CENT = D("0.01")
DAYS = (-1, 0, 29, 30, 31, 59, 60, 61, 89, 90, 91, 180, 181, 1000)
ORDERS = (1, 2, 3, 4, 5, 6, 40)
RATES = ("0.00", "9.99", "10.00", "20.00", "20.01", "150.00")
SPENT = ("0.01", "1300.00", "2500.00", "2777.78", "4999.99", "5000.00", "100000.05")


def rounded(value):
    return value.quantize(CENT, rounding=ROUND_HALF_UP)


def churn(days):
    for limit, value in ((180, "0.8"), (90, "0.5"), (60, "0.3"), (30, "0.1")):
        if days > limit:
            return D(value)
    return D("0.05")


def propensity(days, orders):
    if days < 30 and orders > 3:
        return D("0.8")
    if days < 60 and orders > 2:
        return D("0.6")
    return D("0.4") if days < 90 else D("0.2")


def loyalty(orders, rate):
    points = orders * D("0.4")
    if orders >= 5 and rate < 10:
        points = orders * D("0.6") + (100 - rate) * D("0.4")
    return points / 10


def health(chance, exact):
    if chance > D("0.7"):
        return "At Risk"
    for limit, name in (("0.8", "Excellent"), ("0.6", "Good"), ("0.4", "Average")):
        if exact > D(limit):
            return name
    return "Needs Attention"


def value(clv):
    return "High Value" if clv >= 5000 else "Medium Value" if clv >= 2500 else "Low Value"


def lifecycle(days, orders, chance):
    if orders == 1 and days <= 30:
        return "New Customer"
    if chance >= D("0.7"):
        return "Churned"
    if chance >= D("0.3"):
        return "At Risk"
    return "Active" if orders > 1 else "Inactive"


def group(days, orders, rate, chance, likely, clv):
    if clv >= 5000 and chance < D("0.3"):
        return "VIP"
    if clv >= 2500 and chance >= D("0.3"):
        return "Retention Priority"
    if orders == 1 and days <= 30:
        return "Nurture New"
    if likely > D("0.6"):
        return "Growth Opportunity"
    return "Service Improvement" if rate > 20 else "Standard"


def behavior(r, f, m):
    if r + f + m >= 13:
        return "Champions"
    if r >= 4:
        return "Loyal Customers" if f >= 3 else "Potential Loyalists"
    if r <= 2 and f >= 3 and m >= 3:
        return "At Risk"
    if r <= 2 and f <= 2 and m <= 2:
        return "Hibernating"
    return "Lost" if r == 1 else "Others"


@pytest.fixture(scope="module")
def grid(spark):
    rows = [
        (i, days, orders, D(rate), D(spent), None if i % 2 else "LARGE")
        for i, (days, orders, rate, spent) in enumerate(product(DAYS, ORDERS, RATES, SPENT))
    ]
    schema = (
        "CustomerID long, DaysSinceLastPurchase int, TotalOrders long, ReturnRate decimal(18,2), "
        "TotalSpent decimal(24,2), TopCategory string"
    )
    scores = {"RecencyScore": F.lit(3), "FrequencyScore": F.lit(3), "MonetaryScore": F.lit(3), "RFMScore": F.lit(9)}
    df = spark.createDataFrame(rows, schema).withColumns(scores)
    return with_segments(with_metrics(df, P), P).collect()


def test_metrics_and_segments(grid):
    for row in grid:
        days, orders = row["DaysSinceLastPurchase"], row["TotalOrders"]
        rate, spent = row["ReturnRate"], row["TotalSpent"]
        chance, likely, exact = churn(days), propensity(days, orders), loyalty(orders, rate)
        clv = rounded(spent * (1 + (1 - chance)))
        assert row["ChurnProbability"] == chance
        assert row["NextPurchasePropensity"] == likely
        assert row["LoyaltyIndex"] == rounded(exact)
        assert row["CustomerLifetimeValue"] == clv
        assert row["CustomerHealth"] == health(chance, exact)
        assert row["ValueSegment"] == value(clv)
        assert row["LifecycleSegment"] == lifecycle(days, orders, chance)
        assert row["TargetGroup"] == group(days, orders, rate, chance, likely, clv)


def test_recommendations(grid):
    starts = {
        "VIP": "Exclusive offers",
        "Retention Priority": "Re-engagement campaign",
        "Nurture New": "Welcome series",
        "Growth Opportunity": "Cross-sell/upsell",
        "Service Improvement": "Satisfaction survey",
        "Standard": "Standard seasonal promotions",
    }
    seen = set()
    for row in grid:
        words = row["MarketingRecommendation"]
        seen.add(row["TargetGroup"])
        assert words.startswith(starts[row["TargetGroup"]])
        if row["TargetGroup"] == "Growth Opportunity":
            assert f"based on {row['TopCategory'] or 'preferred category'}, Category" in words
        if row["TargetGroup"] == "Standard":
            months = int(row["DaysSinceLastPurchase"] / 30)
            assert words.endswith(f"Reactivation after {months} months")
    assert seen == starts.keys()


def test_health_uses_unrounded_loyalty(spark):
    """0.804 stores as 0.80 yet is above 0.8."""
    rows = [(20, D("0.00")), (21, D("0.00")), (15, D("0.00")), (10, D("10.00"))]
    df = spark.createDataFrame(rows, "TotalOrders long, ReturnRate decimal(18,2)")
    exact = rules.loyalty_exact(replace(P, loyalty_threshold=1000))
    levels = [r[0] for r in df.select(rules.customer_health(F.lit(D("0.10")), exact + D("0.004"))).collect()]
    assert levels == ["Excellent", "Excellent", "Good", "Average"]


def test_behavior_of_all_scores(spark):
    rows = [(r, f, m, r + f + m) for r, f, m in product(range(1, 6), repeat=3)]
    schema = "RecencyScore int, FrequencyScore int, MonetaryScore int, RFMScore int"
    for row in spark.createDataFrame(rows, schema).withColumn("s", rules.behavior_segment()).collect():
        assert row["s"] == behavior(*row[:3]), row


def test_parameters_move_the_limits(spark):
    p = RunParams(high_value_threshold=D("10"), churn_days_low=5, churn_days_medium=6, loyalty_threshold=2)
    df = spark.createDataFrame(
        [(6, 2, D("0.00"), D("9.99"))],
        "DaysSinceLastPurchase int, TotalOrders int, ReturnRate decimal(18,2), TotalSpent decimal(24,2)",
    )
    row = df.select(
        rules.churn_probability(p).alias("c"),
        rules.loyalty_exact(p).alias("l"),
        rules.purchase_propensity(p).alias("n"),
    ).first()
    assert (row["c"], row["l"], row["n"]) == (D("0.10"), D("4.12"), D("0.40"))


def test_wrong_parameters():
    for wrong in ({"process_type": "SOME"}, {"score_orientation": "up"}, {"on_duplicate_address": "x"}):
        with pytest.raises(ValueError):
            RunParams(**wrong)
