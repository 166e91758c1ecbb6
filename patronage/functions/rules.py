"""Business rules as column expressions over one customer row.

Each rule lists its cases in order and the first that holds wins. All arithmetic is decimal, so a
recomputed partition always gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions import fixed_values as fx
from patronage.functions.columns import dec, first_match
from patronage.params import RunParams

PERCENT = "decimal(5,2)"


def churn_probability(p: RunParams) -> Column:
    days = F.col("DaysSinceLastPurchase")
    limits = (p.churn_days_very_high, p.churn_days_high, p.churn_days_medium, p.churn_days_low)
    *tiers, lowest = [dec(x).cast(PERCENT) for x in fx.CHURN_PROBABILITIES]
    return first_match([(days > limit, tier) for limit, tier in zip(limits, tiers)], lowest)


def purchase_propensity(p: RunParams) -> Column:
    days, orders = F.col("DaysSinceLastPurchase"), F.col("TotalOrders")
    likely, probable, possible, unlikely = [dec(x).cast(PERCENT) for x in fx.PURCHASE_PROPENSITIES]
    return first_match(
        [
            ((days < p.churn_days_low) & (orders > 3), likely),
            ((days < p.churn_days_medium) & (orders > 2), probable),
            (days < p.churn_days_high, possible),
        ],
        unlikely,
    )


def loyalty_exact(p: RunParams) -> Column:
    """Unrounded loyalty; the division covers both branches."""
    orders, rate = F.col("TotalOrders").cast("decimal(12,0)"), F.col("ReturnRate")
    loyal = (F.col("TotalOrders") >= p.loyalty_threshold) & (rate < fx.LOYALTY_MAX_RETURN_RATE)
    kept = (F.lit(100) - rate) * dec(fx.LOYALTY_KEPT_WEIGHT)
    weighted = F.when(loyal, orders * dec(fx.LOYALTY_ORDER_WEIGHT) + kept).otherwise(
        orders * dec(fx.LOYALTY_PLAIN_WEIGHT)
    )
    return weighted / F.lit(fx.LOYALTY_SCALE)


def lifetime_value(churn: Column, p: RunParams) -> Column:
    return (F.col("TotalSpent") * (F.lit(2) - churn)).cast(p.money_type)


def customer_health(churn: Column, loyalty: Column) -> Column:
    levels = [(loyalty > dec(limit), F.lit(name)) for limit, name in fx.HEALTH_LEVELS]
    return first_match(
        [(churn > dec(fx.HEALTH_CHURN_LIMIT), F.lit(fx.HEALTH_AT_RISK)), *levels], fx.HEALTH_REST
    )


def value_segment(p: RunParams) -> Column:
    high, medium, low = fx.VALUE_SEGMENTS
    clv = F.col("CustomerLifetimeValue")
    return first_match([(clv >= _top(p), F.lit(high)), (clv >= _half(p), F.lit(medium))], low)


def behavior_segment() -> Column:
    r, f, m = (F.col(c) for c in ("RecencyScore", "FrequencyScore", "MonetaryScore"))
    *names, rest = fx.BEHAVIOR_SEGMENTS
    conditions = (
        F.col("RFMScore") >= fx.CHAMPION_SCORE,
        (r >= 4) & (f >= 3),
        (r >= 4) & (f <= 2),
        (r <= 2) & (f >= 3) & (m >= 3),
        F.greatest(r, f, m) <= 2,
        r <= 1,
    )
    return first_match([(c, F.lit(n)) for c, n in zip(conditions, names)], rest)


def lifecycle_segment() -> Column:
    churn, orders = F.col("ChurnProbability"), F.col("TotalOrders")
    low, high = dec(fx.CHURN_LOW_LIMIT), dec(fx.CHURN_HIGH_LIMIT)
    *names, rest = fx.LIFECYCLE_SEGMENTS
    conditions = (_is_new(), (orders > 1) & (churn < low), (churn >= low) & (churn < high), churn >= high)
    return first_match([(c, F.lit(n)) for c, n in zip(conditions, names)], rest)


def target_group(p: RunParams) -> Column:
    *names, rest = fx.TARGET_GROUPS
    return first_match([(c, F.lit(n)) for c, n in zip(_target_conditions(p), names)], rest)


def recommendation(p: RunParams) -> Column:
    before, unknown, after = fx.RECOMMEND_GROWTH
    growth = F.concat(F.lit(before), F.coalesce(F.col("TopCategory"), F.lit(unknown)), F.lit(after))
    lead, unit = fx.RECOMMEND_STANDARD
    months = F.expr(f"cast(coalesce(DaysSinceLastPurchase, 0) div {fx.DAYS_PER_MONTH} as string)")
    texts = (
        F.lit(fx.RECOMMEND_VIP),
        F.lit(fx.RECOMMEND_RETENTION),
        F.lit(fx.RECOMMEND_NEW),
        growth,
        F.lit(fx.RECOMMEND_SERVICE),
    )
    return first_match(zip(_target_conditions(p), texts), F.concat(F.lit(lead), months, F.lit(unit)))


def _target_conditions(p: RunParams) -> tuple[Column, ...]:
    clv, churn = F.col("CustomerLifetimeValue"), F.col("ChurnProbability")
    low = dec(fx.CHURN_LOW_LIMIT)
    return (
        (clv >= _top(p)) & (churn < low),
        (clv >= _half(p)) & (churn >= low),
        _is_new(),
        F.col("NextPurchasePropensity") > dec(fx.GROWTH_PROPENSITY),
        F.col("ReturnRate") > fx.SERVICE_RETURN_RATE,
    )


def _is_new() -> Column:
    return (F.col("TotalOrders") == 1) & (F.col("DaysSinceLastPurchase") <= fx.NEW_CUSTOMER_DAYS)


def _top(p: RunParams) -> Column:
    return F.lit(p.high_value_threshold)


def _half(p: RunParams) -> Column:
    return F.lit(p.high_value_threshold / 2)
