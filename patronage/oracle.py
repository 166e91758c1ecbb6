"""The same results as plain SQL over the same tables, written for DuckDB.

Rates and money are decimals throughout and become doubles in the last select only. Averages and
percentages are rounded half up in whole numbers, since the division of decimals is inexact there.
"""

from __future__ import annotations

from collections.abc import Iterable

from patronage.functions import fixed_values as fx
from patronage.operators.customers import BASE_COLUMNS
from patronage.operators.metrics import METRIC_COLUMNS, SCORES
from patronage.operators.segments import ANALYTICS_COLUMNS, SEGMENT_COLUMNS
from patronage.operators.transactions import SUMMARY_COLUMNS
from patronage.queries import (
    CHANGED_SINCE,
    DATA_DATE,
    EARLIER_DATE,
    EARLIEST_DATE,
    FALLBACKS,
    HIGH_VALUE,
    LOOKUP_ID,
    PAGE_AFTER,
    PAGE_SIZE,
    ROLE_STAGES,
    SAMPLE_SIZE,
)
from patronage.sources.star_schema import ORDER_STATUS

MONEY = {"TotalSpent", "AvgOrderValue", "CustomerLifetimeValue", "CategorySpend", "TotalQuantity"}
RATES = {"ReturnRate", "ChurnProbability", "NextPurchasePropensity", "LoyaltyIndex"}
DATES = {
    "CreatedDate",
    "ModifiedDate",
    "LastContactDate",
    "FirstPurchaseDate",
    "LastPurchaseDate",
    "ProcessDate",
    "OrderDate",
}


def out(columns: Iterable[str], prefix: str = "") -> str:
    """A select list in portable types."""
    items = []
    for c in columns:
        source = f"{prefix}{c}"
        if c in MONEY or c in RATES:
            items.append(f"CAST(CAST({source} AS DECIMAL(18,4)) AS DOUBLE) AS {c}")
        elif c in DATES:
            items.append(f"strftime({source}, '%Y-%m-%d') AS {c}")
        elif c in ("AccountManager", "IsActive"):
            items.append(f"CAST({source} AS BIGINT) AS {c}")
        else:
            items.append(f"{source} AS {c}")
    return ", ".join(items)


def half_up(numerator: str, denominator: str) -> str:
    """numerator / denominator in hundredths, rounded half up, for whole non-negative numbers."""
    return (
        f"CAST((2 * 100 * CAST({numerator} AS HUGEINT) + ({denominator})) // (2 * ({denominator})) "
        f"AS DECIMAL(24,0)) * CAST(0.01 AS DECIMAL(3,2))"
    )


ORDERS = "o AS (SELECT o_orderkey AS OrderID, o_custkey AS CustomerID, CAST(o_orderdate AS DATE) AS OrderDate, " + (
    "CASE o_orderstatus "
    + " ".join(f"WHEN '{code}' THEN '{word}'" for code, word in ORDER_STATUS.items())
    + " END AS Status, CAST(o_totalprice AS DECIMAL(15,2)) AS OrderTotal FROM orders)"
)
DETAILS = """d AS (
    SELECT l_orderkey AS OrderID, l_partkey AS ProductID, CAST(l_quantity AS DECIMAL(15,2)) AS Quantity,
           CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS NetAmount
    FROM lineitem)"""
RETURNS = """r AS (
    SELECT DISTINCT l_orderkey AS ReturnID, CustomerID
    FROM lineitem JOIN o ON l_orderkey = OrderID
    WHERE l_returnflag = 'R' AND l_linenumber = 1 AND Status = 'Completed')"""
CUSTOMERS = """c AS (
    SELECT c_custkey AS CustomerID, split_part(c_name, '#', 1) AS FirstName, split_part(c_name, '#', 2) AS LastName,
           c_mktsegment AS CustomerType, c_nationkey AS AccountManager, c_nationkey,
           (SELECT min(OrderDate) FROM o WHERE o.CustomerID = c_custkey) AS CreatedDate,
           (SELECT max(OrderDate) FROM o WHERE o.CustomerID = c_custkey) AS ModifiedDate,
           CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END AS IsActive
    FROM customer)"""
CONTACTS = """i AS (SELECT user_id AS CustomerID, max(CAST(ts AS DATE)) AS LastContactDate FROM events GROUP BY 1)"""


def base_cte(name: str, keep: str = "true") -> str:
    return f"""{name} AS (
    SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName, CAST(NULL AS VARCHAR) AS Email,
           CAST(NULL AS VARCHAR) AS Phone, CAST(NULL AS VARCHAR) AS Address, CAST(NULL AS VARCHAR) AS PostalCode,
           CAST(NULL AS VARCHAR) AS City, place.State, place.Country, c.CustomerType, c.AccountManager,
           c.CreatedDate, c.ModifiedDate, c.IsActive, i.LastContactDate
    FROM c LEFT JOIN i USING (CustomerID)
    LEFT JOIN (SELECT n_nationkey, n_name AS Country, r_name AS State
               FROM nation JOIN region ON n_regionkey = r_regionkey) place
      ON place.n_nationkey = c.c_nationkey AND c.CustomerID % 10 <> 0
    WHERE {keep})"""


def summary_ctes(name: str, base: str, day: object, orders: str = "true") -> str:
    """``name`` and its helpers: the transaction summary on a day, of the orders that match."""
    return f"""{name}_lines AS (
    SELECT o.CustomerID, o.OrderID, o.OrderDate, p_type AS Category, p_name AS ProductName, Quantity, NetAmount
    FROM o JOIN d USING (OrderID) JOIN part ON p_partkey = ProductID
    WHERE Status = 'Completed' AND {orders}),
{name}_top_category AS (
    SELECT CustomerID, Category AS TopCategory FROM {name}_lines GROUP BY CustomerID, Category
    QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY sum(NetAmount) DESC, Category ASC NULLS FIRST) = 1),
{name}_top_product AS (
    SELECT CustomerID, ProductName AS TopProduct FROM {name}_lines GROUP BY CustomerID, ProductName
    QUALIFY row_number() OVER (PARTITION BY CustomerID ORDER BY sum(Quantity) DESC, ProductName ASC NULLS FIRST) = 1),
{name}_totals AS (
    SELECT CustomerID, count(DISTINCT OrderID) AS TotalOrders, sum(NetAmount) AS Exact,
           min(OrderDate) AS FirstPurchaseDate, max(OrderDate) AS LastPurchaseDate
    FROM {name}_lines GROUP BY CustomerID),
{name}_returns AS (SELECT CustomerID, count(DISTINCT ReturnID) AS TotalReturns FROM r GROUP BY CustomerID),
{name} AS (
    SELECT t.CustomerID, TotalOrders, CAST(Exact AS DECIMAL(24,2)) AS TotalSpent,
           {half_up("Exact * 10000", "TotalOrders * 10000")} AS AvgOrderValue,
           FirstPurchaseDate, LastPurchaseDate,
           datediff('day', LastPurchaseDate, DATE '{day}') AS DaysSinceLastPurchase, TopCategory, TopProduct,
           {half_up("coalesce(TotalReturns, 0) * 100", "TotalOrders")} AS ReturnRate
    FROM {name}_totals t LEFT JOIN {name}_top_category USING (CustomerID)
    LEFT JOIN {name}_top_product USING (CustomerID) LEFT JOIN {name}_returns USING (CustomerID)
    WHERE t.CustomerID IN (SELECT CustomerID FROM {base}))"""


def scores(days: str, orders: str, spent: str) -> str:
    ordering = (f"{days} ASC", f"{orders} DESC", f"{spent} DESC")
    return ", ".join(f"ntile(5) OVER (ORDER BY {o}, CustomerID) AS {name}" for o, name in zip(ordering, SCORES))


def cases(pairs: Iterable[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}" for condition, value in pairs) + f" ELSE {default} END"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def dec(value: object) -> str:
    return f"CAST('{value}' AS DECIMAL(24,2))"


def _metrics() -> str:
    churn = cases(
        [
            ("DaysSinceLastPurchase > 180", dec("0.8")),
            ("DaysSinceLastPurchase > 90", dec("0.5")),
            ("DaysSinceLastPurchase > 60", dec("0.3")),
            ("DaysSinceLastPurchase > 30", dec("0.1")),
        ],
        dec("0.05"),
    )
    propensity = cases(
        [
            ("DaysSinceLastPurchase < 30 AND TotalOrders > 3", dec("0.8")),
            ("DaysSinceLastPurchase < 60 AND TotalOrders > 2", dec("0.6")),
            ("DaysSinceLastPurchase < 90", dec("0.4")),
        ],
        dec("0.2"),
    )
    # Weights 0.6 and 0.4 over a scale of 10, one tenth of each weight taken here so that no division is needed.
    loyalty = (
        "CASE WHEN TotalOrders >= 5 AND ReturnRate < 10 "
        f"THEN CAST(TotalOrders AS DECIMAL(12,0)) * {dec('0.06')} + (100 - ReturnRate) * {dec('0.04')} "
        f"ELSE CAST(TotalOrders AS DECIMAL(12,0)) * {dec('0.04')} END"
    )
    health = cases(
        [
            (f"ChurnProbability > {dec('0.7')}", "'At Risk'"),
            (f"Loyalty > {dec('0.8')}", "'Excellent'"),
            (f"Loyalty > {dec('0.6')}", "'Good'"),
            (f"Loyalty > {dec('0.4')}", "'Average'"),
        ],
        "'Needs Attention'",
    )
    return f"""s AS (
    SELECT *, {scores("DaysSinceLastPurchase", "TotalOrders", "TotalSpent")}, {churn} AS ChurnProbability,
           {propensity} AS NextPurchasePropensity, {loyalty} AS Loyalty
    FROM ts),
m AS (
    SELECT *, {" + ".join(SCORES)} AS RFMScore, CAST(Loyalty AS DECIMAL(24,2)) AS LoyaltyIndex,
           {health} AS CustomerHealth,
           CAST(CAST(TotalSpent AS DECIMAL(18,2)) * CAST(2 - ChurnProbability AS DECIMAL(3,2)) AS DECIMAL(24,2))
               AS CustomerLifetimeValue
    FROM s)"""


def _segments() -> str:
    top, half = dec(HIGH_VALUE), dec(HIGH_VALUE / 2)
    new = "(TotalOrders = 1 AND DaysSinceLastPurchase <= 30)"
    value = cases(
        [(f"CustomerLifetimeValue >= {top}", "'High Value'"), (f"CustomerLifetimeValue >= {half}", "'Medium Value'")],
        "'Low Value'",
    )
    behavior = cases(
        [
            ("RFMScore >= 13", "'Champions'"),
            ("RecencyScore >= 4 AND FrequencyScore >= 3", "'Loyal Customers'"),
            ("RecencyScore >= 4", "'Potential Loyalists'"),
            ("RecencyScore <= 2 AND FrequencyScore >= 3 AND MonetaryScore >= 3", "'At Risk'"),
            ("RecencyScore <= 2 AND FrequencyScore <= 2 AND MonetaryScore <= 2", "'Hibernating'"),
            ("RecencyScore = 1", "'Lost'"),
        ],
        "'Others'",
    )
    lifecycle = cases(
        [
            (new, "'New Customer'"),
            (f"TotalOrders > 1 AND ChurnProbability < {dec('0.3')}", "'Active'"),
            (f"ChurnProbability >= {dec('0.3')} AND ChurnProbability < {dec('0.7')}", "'At Risk'"),
            (f"ChurnProbability >= {dec('0.7')}", "'Churned'"),
        ],
        "'Inactive'",
    )
    target = cases(
        [
            (f"CustomerLifetimeValue >= {top} AND ChurnProbability < {dec('0.3')}", "'VIP'"),
            (f"CustomerLifetimeValue >= {half} AND ChurnProbability >= {dec('0.3')}", "'Retention Priority'"),
            (new, "'Nurture New'"),
            (f"NextPurchasePropensity > {dec('0.6')}", "'Growth Opportunity'"),
            ("ReturnRate > 20", "'Service Improvement'"),
        ],
        "'Standard'",
    )
    advice = """CASE TargetGroup
        WHEN 'VIP' THEN 'Exclusive offers, VIP events, Personal shopping assistance, Early access to new products'
        WHEN 'Retention Priority'
            THEN 'Re-engagement campaign, Loyalty rewards, Personalized recommendations based on past purchases'
        WHEN 'Nurture New' THEN 'Welcome series, Educational content, First purchase follow-up, Category exploration'
        WHEN 'Growth Opportunity' THEN 'Cross-sell/upsell, Bundle offers based on '
            || coalesce(TopCategory, 'preferred category') || ', Category expansion'
        WHEN 'Service Improvement'
            THEN 'Satisfaction survey, Improved product information, Size/fit guides, Service recovery'
        ELSE 'Standard seasonal promotions, Category newsletters, Reactivation after '
            || CAST(CAST(trunc(DaysSinceLastPurchase / 30.0) AS INT) AS VARCHAR) || ' months' END"""
    return f"""g AS (
    SELECT *, {value} AS ValueSegment, {behavior} AS BehaviorSegment, {lifecycle} AS LifecycleSegment,
           {target} AS TargetGroup
    FROM m),
seg AS (SELECT *, {advice} AS MarketingRecommendation FROM g)"""


PRELUDE = ",\n".join([ORDERS, DETAILS, RETURNS, CUSTOMERS, CONTACTS])
BASE = ",\n".join([PRELUDE, base_cte("b")])
SUMMARY = ",\n".join([BASE, summary_ctes("ts", "b", DATA_DATE)])
METRICS = ",\n".join([SUMMARY, _metrics()])
SEGMENTS = ",\n".join([METRICS, _segments()])
CHANGED = f"c.ModifiedDate >= DATE '{CHANGED_SINCE}' OR i.LastContactDate >= DATE '{CHANGED_SINCE}'"
FACTS = f"{PRELUDE},\nf AS (SELECT * FROM o JOIN d USING (OrderID) WHERE Status = 'Completed')"
LINES = f"{PRELUDE},\nf AS (SELECT * FROM o JOIN d USING (OrderID))"
HISTORY = f"""{ORDERS}, h AS (
    SELECT OrderID, CustomerID, CASE Status WHEN 'Completed' THEN DATE '{EARLIEST_DATE}'
           WHEN 'Open' THEN DATE '{EARLIER_DATE}' ELSE DATE '{DATA_DATE}' END AS ProcessDate FROM o)"""
PROFILE_COLUMNS = [c for c in BASE_COLUMNS if c != "ModifiedDate"]
FIGURES = [c for c in SUMMARY_COLUMNS if c not in ("TopCategory", "TopProduct", "ReturnRate")]


def _from(prelude: str, select: str) -> str:
    return f"WITH {prelude}\n{select}"


def _ranked(prelude: str, label: str, amount: str, total: str) -> str:
    return _from(
        prelude,
        f"""SELECT CustomerID, {label}, CAST(CAST({total} AS DECIMAL(24,4)) AS DOUBLE) AS {total} FROM (
            SELECT CustomerID, {label}, sum({amount}) AS {total},
                   row_number() OVER (PARTITION BY CustomerID ORDER BY sum({amount}) DESC, {label} NULLS FIRST) AS k
            FROM f JOIN (SELECT p_partkey AS ProductID, p_type AS Category, p_name AS ProductName FROM part)
                 USING (ProductID)
            GROUP BY CustomerID, {label}) WHERE k = 1""",
    )


def _grouped(label: str, amount: str, total: str) -> str:
    return _ranked(FACTS, label, amount, total).replace("WHERE k = 1", "WHERE k >= 1")


def _line_summary(average: str) -> str:
    return _from(
        LINES,
        f"""SELECT CustomerID, TotalOrders, CAST(CAST(Exact AS DECIMAL(24,4)) AS DOUBLE) AS TotalSpent,
            CAST({average} AS DOUBLE) AS AvgOrderValue, strftime(a, '%Y-%m-%d') AS FirstPurchaseDate,
            strftime(z, '%Y-%m-%d') AS LastPurchaseDate, datediff('day', z, DATE '{DATA_DATE}') AS DaysSinceLastPurchase
            FROM (SELECT CustomerID, count(*) AS TotalOrders, sum(NetAmount) AS Exact, min(OrderDate) AS a,
                         max(OrderDate) AS z FROM f GROUP BY CustomerID)""",
    )


def _simple(lifecycle: list[tuple[str, str]]) -> str:
    value = cases([("TotalSpent >= 5000", "'High Value'"), ("TotalSpent >= 2500", "'Medium Value'")], "'Low Value'")
    behavior = cases([("TotalOrders >= 10", "'Champions'"), ("TotalOrders >= 5", "'Loyal Customers'")], "'Others'")
    return _from(
        SUMMARY,
        f"SELECT CustomerID, {value} AS ValueSegment, {behavior} AS BehaviorSegment, "
        f"{cases(lifecycle, text('Inactive'))} AS LifecycleSegment FROM ts",
    )


def _profile_merge() -> str:
    value_columns = [c for c in [*PROFILE_COLUMNS, *SUMMARY_COLUMNS[1:]] if c not in ("CustomerID", "CreatedDate")]
    picked = ", ".join(f"CASE WHEN n.CustomerID IS NULL THEN e.{c} ELSE n.{c} END AS {c}" for c in value_columns)
    ctes = ",\n".join(
        [
            BASE,
            base_cte("changed", CHANGED),
            summary_ctes("before", "b", EARLIER_DATE, f"OrderDate < DATE '{EARLIER_DATE}'"),
            summary_ctes("after", "changed", CHANGED_SINCE),
            f"""e AS (SELECT * FROM b LEFT JOIN before USING (CustomerID) WHERE CreatedDate < DATE '{EARLIEST_DATE}')""",
            "n AS (SELECT * FROM changed LEFT JOIN after USING (CustomerID))",
            f"""merged AS (
    SELECT coalesce(e.CustomerID, n.CustomerID) AS CustomerID, coalesce(e.CreatedDate, n.CreatedDate) AS CreatedDate,
           {picked},
           CASE WHEN n.CustomerID IS NULL THEN DATE '{EARLIER_DATE}' ELSE DATE '{DATA_DATE}' END AS ModifiedDate
    FROM e FULL JOIN n ON e.CustomerID = n.CustomerID)""",
        ]
    )
    columns = [*PROFILE_COLUMNS, *SUMMARY_COLUMNS[1:], "ModifiedDate"]
    return _from(ctes, f"SELECT {out(columns)} FROM merged")


def _fallback(order: tuple[str, ...]) -> str:
    tried = ", ".join(f"nullif(arg_max(text, turn) FILTER (WHERE role = '{role}'), '')" for role in order)
    return f"coalesce({tried}, '')"


NAME = r"([a-zA-Z0-9_\.]+)"
TABLES = (
    f"list_concat(regexp_extract_all(text, '(?i)FROM\\s+{NAME}', 1), regexp_extract_all(text, '(?i)JOIN\\s+{NAME}', 1))"
)
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def oracle_sql() -> dict[str, str]:
    base = out(BASE_COLUMNS)
    lookups = {
        "q_last_contact": _from(CONTACTS, f"SELECT {out(['CustomerID', 'LastContactDate'])} FROM i"),
        "q_customer_base": _from(BASE, f"SELECT {base} FROM b"),
        "q_customer_base_incremental": _from(
            ",\n".join([PRELUDE, base_cte("b", CHANGED)]), f"SELECT {base} FROM b"
        ),
        "q_customer_lookup": _from(BASE, f"SELECT {base} FROM b WHERE CustomerID = {LOOKUP_ID}"),
        "q_customer_order_stats": _from(
            PRELUDE,
            """SELECT c.CustomerID, c.FirstName || ' ' || c.LastName AS CustomerName, count(o.OrderID) AS OrderCount,
               CAST(sum(o.OrderTotal) AS DOUBLE) AS TotalSpend
               FROM c LEFT JOIN o USING (CustomerID) GROUP BY ALL""",
        ),
        "q_keyset_page": _from(
            BASE, f"SELECT {base} FROM b WHERE CustomerID > {PAGE_AFTER} ORDER BY CustomerID LIMIT {PAGE_SIZE}"
        ),
    }
    page = "CAST((row_number() OVER (ORDER BY CustomerID) - 1) // %d AS BIGINT) AS page"
    lookups["q_keyset_batches"] = _from(BASE, f"SELECT {base}, {page % PAGE_SIZE} FROM b")
    lookups["q_keyset_written"] = _from(BASE, f"SELECT CustomerID, {page % PAGE_SIZE} FROM b")
    lookups["q_page_markers"] = (
        f"SELECT page, max(CustomerID) AS last_key FROM (SELECT c_custkey AS CustomerID, {page % (10 * PAGE_SIZE)} "
        "FROM (SELECT *, c_custkey AS CustomerID FROM customer)) GROUP BY page"
    )
    lookups["q_bucketed_join"] = _from(
        BASE,
        """SELECT CustomerID, CustomerName, State, Status, count(*) AS Orders, strftime(max(OrderDate), '%Y-%m-%d') AS OrderDate
        FROM b JOIN o USING (CustomerID) GROUP BY CustomerID, CustomerName, State, Status""",
    )
    lookups["q_last_contact_window"] = lookups["q_last_contact"]
    lookups["q_customer_base_sql"] = lookups["q_customer_base"]

    transactions = {
        "q_order_summary": _from(
            FACTS,
            """SELECT CustomerID, count(DISTINCT OrderID) AS TotalOrders,
               CAST(CAST(sum(NetAmount) AS DECIMAL(24,4)) AS DOUBLE) AS TotalSpent,
               strftime(min(OrderDate), '%Y-%m-%d') AS FirstPurchaseDate,
               strftime(max(OrderDate), '%Y-%m-%d') AS LastPurchaseDate FROM f GROUP BY CustomerID""",
        ),
        "q_category_spend": _grouped("Category", "NetAmount", "CategorySpend"),
        "q_product_quantity": _grouped("ProductName", "Quantity", "TotalQuantity"),
        "q_top_category": _ranked(FACTS, "Category", "NetAmount", "CategorySpend"),
        "q_top_product": _ranked(FACTS, "ProductName", "Quantity", "TotalQuantity"),
        "q_return_rate": _from(
            FACTS,
            f"""SELECT CustomerID, TotalReturns, TotalOrders,
                CAST({half_up("TotalReturns * 100", "TotalOrders")} AS DOUBLE) AS ReturnRate
                FROM (SELECT CustomerID, count(DISTINCT ReturnID) AS TotalReturns FROM r GROUP BY 1)
                JOIN (SELECT CustomerID, count(DISTINCT OrderID) AS TotalOrders FROM f GROUP BY 1) USING (CustomerID)""",
        ),
        "q_transaction_summary": _from(SUMMARY, f"SELECT {out(SUMMARY_COLUMNS)} FROM ts"),
        "q_summary_from_state": _from(SUMMARY, f"SELECT {out(SUMMARY_COLUMNS)} FROM ts"),
        "q_purchase_state": _from(
            f"{ORDERS}, {DETAILS}, {RETURNS}, l AS (SELECT * FROM o JOIN d USING (OrderID) WHERE Status = 'Completed')",
            """SELECT CustomerID, Kind, ProductID, Count, CAST(Net AS DOUBLE) AS Net, CAST(Quantity AS DOUBLE) AS Quantity,
                strftime(First, '%Y-%m-%d') AS First, strftime(Last, '%Y-%m-%d') AS Last FROM (
                SELECT CustomerID, 'orders' AS Kind, NULL AS ProductID, count(DISTINCT OrderID) AS Count, sum(NetAmount) AS Net,
                  sum(Quantity) AS Quantity, min(OrderDate) AS First, max(OrderDate) AS Last FROM l GROUP BY CustomerID
                UNION ALL SELECT CustomerID, 'product', ProductID, count(*), sum(NetAmount), sum(Quantity),
                  min(OrderDate), max(OrderDate) FROM l GROUP BY CustomerID, ProductID
                UNION ALL SELECT CustomerID, 'returns', NULL, count(DISTINCT ReturnID), NULL, NULL, NULL, NULL FROM r GROUP BY CustomerID)""",
        ),
        "q_transaction_summary_incremental": _from(
            ",\n".join([PRELUDE, base_cte("b", CHANGED), summary_ctes("ts", "b", CHANGED_SINCE)]),
            f"SELECT {out(SUMMARY_COLUMNS)} FROM ts",
        ),
    }

    def metric(*columns: str) -> str:
        return _from(METRICS, f"SELECT {out(['CustomerID', *columns])} FROM m")

    figures = {
        "q_churn": metric("ChurnProbability"),
        "q_propensity": metric("NextPurchasePropensity"),
        "q_loyalty": metric("LoyaltyIndex"),
        "q_clv": metric("CustomerLifetimeValue"),
        "q_rfm_scores": metric(*SCORES, "RFMScore"),
        "q_rfm_five_is_best": _from(
            METRICS,
            "SELECT CustomerID, "
            + ", ".join(f"6 - {s} AS {s}" for s in SCORES)
            + ", 18 - RFMScore AS RFMScore FROM m",
        ),
        "q_customer_metrics": metric(*METRIC_COLUMNS[1:]),
        "q_rfm_wide": metric(*FIGURES[1:], *SCORES, "RFMScore"),
        "q_customer_wide": _from(
            METRICS,
            f"""SELECT b.CustomerID, CustomerName, Email, {out(["TotalOrders", "TotalSpent", "RFMScore"])}
                FROM b LEFT JOIN m USING (CustomerID)""",
        ),
        "q_customer_profile": _from(
            SUMMARY,
            f"SELECT {out(PROFILE_COLUMNS)}, {out(SUMMARY_COLUMNS[1:])} FROM b LEFT JOIN ts USING (CustomerID)",
        ),
    }

    def segment(*columns: str) -> str:
        return _from(SEGMENTS, f"SELECT {out(columns)} FROM seg")

    groups = {
        "q_value_segment": segment("CustomerID", "CustomerLifetimeValue", "ValueSegment"),
        "q_behavior_segment": segment("CustomerID", *SCORES, "RFMScore", "BehaviorSegment"),
        "q_lifecycle_segment": segment("CustomerID", "LifecycleSegment"),
        "q_target_group": segment("CustomerID", "TargetGroup"),
        "q_recommendation": segment("CustomerID", "MarketingRecommendation"),
        "q_customer_segments": segment(*SEGMENT_COLUMNS),
        "q_customer_analytics": _from(
            SEGMENTS, f"SELECT '{DATA_DATE}' AS ProcessDate, {out(ANALYTICS_COLUMNS[1:])} FROM seg"
        ),
        "q_analytics_summary": _from(
            SEGMENTS,
            f"""SELECT '{DATA_DATE}' AS ProcessDate, 'FULL' AS ProcessType, count(DISTINCT CustomerID) AS TotalCustomers,
                count(*) FILTER (WHERE LifecycleSegment = 'Active') AS ActiveCustomers,
                count(*) FILTER (WHERE LifecycleSegment = 'New Customer') AS NewCustomers,
                count(*) FILTER (WHERE LifecycleSegment IN ('At Risk', 'Churned')) AS ChurningCustomers,
                count(*) FILTER (WHERE ValueSegment = 'High Value') AS HighValueCustomers,
                CAST((2 * CAST(sum(CustomerLifetimeValue) * 1000000 AS HUGEINT) + count(*)) // (2 * count(*)) AS DOUBLE)
                    / 1000000 AS AverageLifetimeValue
                FROM seg""",
        ),
        "q_segments_simple_a": _simple(
            [("DaysSinceLastPurchase <= 30", "'New Customer'"), ("DaysSinceLastPurchase <= 90", "'Active'")]
        ),
        "q_segments_simple_b": _simple(
            [("TotalOrders = 1", "'New Customer'"), ("DaysSinceLastPurchase <= 30", "'Active'")]
        ),
        "q_segments_simple_c": _from(
            METRICS,
            """SELECT CustomerID, if(TotalSpent >= 5000, 'High Value', 'Low Value') AS ValueSegment,
               if(RFMScore >= 13, 'Champions', 'Others') AS BehaviorSegment FROM m""",
        ),
    }

    groups["q_customer_analytics_joined"] = groups["q_customer_analytics"]
    groups["q_analytics_summary_joined"] = groups["q_analytics_summary"]

    per_customer = "(SELECT CustomerID, count(*) AS n, sum(NetAmount) AS x, max(OrderDate) AS z FROM f GROUP BY 1)"
    from_orders = "(SELECT CustomerID, count(*) AS n, sum(OrderTotal) AS x, max(OrderDate) AS z FROM o GROUP BY 1)"
    line_average = half_up("Exact * 10000", "TotalOrders * 10000")
    other_grains = {
        "q_line_grain_summary": _line_summary(line_average),
        "q_line_avg_summary": _line_summary(line_average),
        "q_rfm_line_grain": _from(
            LINES,
            f"SELECT *, {' + '.join(SCORES)} AS RFMScore FROM (SELECT CustomerID, "
            f"{scores(f'datediff({text("day")}, z, DATE {text(str(DATA_DATE))})', 'n', 'x')} FROM {per_customer})",
        ),
        "q_rfm_from_orders": _from(
            ORDERS,
            f"""SELECT CustomerID, n AS Frequency, CAST(CAST(x AS DECIMAL(18,2)) AS DOUBLE) AS Monetary,
                datediff('day', z, DATE '{DATA_DATE}') AS Recency,
                {scores(f"datediff('day', z, DATE '{DATA_DATE}')", "n", "x")} FROM {from_orders}""",
        ),
    }

    order_columns = out(["OrderID", "CustomerID", "OrderDate", "Status"])
    history = out(["OrderID", "CustomerID", "ProcessDate"])
    maintenance = {
        "q_bronze_orders": _from(ORDERS, f"SELECT {order_columns}, '{DATA_DATE}' AS _ingestion_date FROM o"),
        "q_bronze_slice": _from(
            ORDERS, f"SELECT {order_columns} FROM o WHERE OrderDate >= DATE '{EARLIER_DATE}'"
        ),
        "q_bronze_evolved": _from(
            ORDERS,
            f"""SELECT {order_columns}, CAST(CASE WHEN early THEN floor(OrderTotal) ELSE OrderTotal END AS DOUBLE) AS OrderTotal,
                CASE WHEN early THEN 'T' || (OrderID % 7) END AS Tag, CASE WHEN NOT early THEN OrderID % 5 END AS Level,
                CASE WHEN early THEN '{EARLIER_DATE}' ELSE '{DATA_DATE}' END AS _ingestion_date
                FROM (SELECT *, OrderDate < DATE '{EARLIER_DATE}' AS early FROM o)""",
        ),
        "q_profile_merge": _profile_merge(),
        "q_profile_lookup": _from(
            SUMMARY,
            f"SELECT {out(PROFILE_COLUMNS)}, {out(SUMMARY_COLUMNS[1:])} FROM b LEFT JOIN ts USING (CustomerID) WHERE CustomerID = {LOOKUP_ID}",
        ),
        "q_replace_by_date": _from(
            HISTORY,
            f"""SELECT CASE WHEN ProcessDate = DATE '{DATA_DATE}' THEN -OrderID ELSE OrderID END AS OrderID, CustomerID,
                strftime(ProcessDate, '%Y-%m-%d') AS ProcessDate FROM h""",
        ),
        "q_retention": _from(HISTORY, f"SELECT {history} FROM h WHERE ProcessDate >= DATE '{DATA_DATE}' - 365"),
        "q_retention_plan": _from(HISTORY, f"SELECT {history} FROM h WHERE NOT ProcessDate < DATE '{EARLIER_DATE}'"),
    }

    counted = {
        "Customers": "customer", "CustomerAddresses": "customer", "CustomerInteractions": "events", "Orders": "orders",
        "OrderDetails": "lineitem", "Products": "part",
        "Returns": "(SELECT 1 FROM lineitem JOIN o ON l_orderkey = OrderID "
        "WHERE l_returnflag = 'R' AND l_linenumber = 1 AND Status = 'Completed') returned",
    }
    domains = {
        "ValueSegment": "'High Value', 'Medium Value', 'Low Value'",
        "BehaviorSegment": "'Champions', 'Loyal Customers', 'Potential Loyalists', 'At Risk', 'Hibernating', 'Lost', 'Others'",
        "LifecycleSegment": "'New Customer', 'Active', 'At Risk', 'Churned', 'Inactive'",
        "TargetGroup": "'VIP', 'Retention Priority', 'Nurture New', 'Growth Opportunity', 'Service Improvement', 'Standard'",
    }
    checks = {
        "q_dq_row_counts": _from(
            ORDERS,
            " UNION ALL ".join(
                f"SELECT '{name}' AS table_name, count(*) AS source_rows, count(*) AS stored_rows, true AS passed FROM {table}"
                for name, table in counted.items()
            ),
        ),
        "q_dq_schema": """SELECT 'Orders' AS table_name, x.*, (SELECT count(*) FROM orders) AS source_rows FROM (VALUES
            ('OrderDate', 'date', 'timestamp'), ('Status', 'string', NULL), ('State', NULL, 'string'))
            x(column_name, expected_type, actual_type)""",
        "q_dq_segment_domain": _from(
            SEGMENTS,
            " UNION ALL ".join(
                f"SELECT '{column}' AS column_name, count(*) FILTER (WHERE {column} IS NULL OR {column} NOT IN ({allowed})) "
                f"AS invalid_rows, count(*) FILTER (WHERE {column} IS NULL OR {column} NOT IN ({allowed})) = 0 AS passed "
                "FROM seg"
                for column, allowed in domains.items()
            ),
        ),
        "q_dq_retention": _from(
            HISTORY,
            f"SELECT count(*) FILTER (WHERE ProcessDate < DATE '{EARLIER_DATE}') AS expired_rows, "
            f"count(*) FILTER (WHERE ProcessDate < DATE '{EARLIER_DATE}') = 0 AS passed FROM h",
        ),
        "q_dq_no_orders": _from(
            SUMMARY,
            "SELECT count(*) AS customers_without_orders FROM b "
            "WHERE NOT EXISTS (SELECT 1 FROM ts WHERE ts.CustomerID = b.CustomerID)",
        ),
        "q_dq_expected_values": _from(
            LINES,
            """SELECT CustomerID, fin.CustomerID IS NOT NULL AS present, column_name, expected, actual FROM (
               SELECT total.CustomerID, fin.CustomerID AS there, x.column_name, x.expected, x.actual,
               FROM (SELECT CustomerID, count(DISTINCT OrderID) AS n, sum(NetAmount) AS v FROM f GROUP BY 1) total
               LEFT JOIN (SELECT CustomerID, count(DISTINCT OrderID) AS n, sum(NetAmount) AS v FROM f
                          WHERE Status = 'Completed' GROUP BY 1) fin USING (CustomerID),
               LATERAL (VALUES ('TotalOrders', CAST(total.n AS DECIMAL(38,4)), CAST(fin.n AS DECIMAL(38,4))),
                               ('TotalSpent', CAST(total.v AS DECIMAL(38,4)), CAST(fin.v AS DECIMAL(38,4))))
                       x(column_name, expected, actual)
               WHERE x.expected IS DISTINCT FROM x.actual)""",
        ).replace("fin.CustomerID IS NOT NULL AS present, column_name, expected, actual FROM (",
                  "there IS NOT NULL AS present, column_name, CAST(expected AS DOUBLE) AS expected, "
                  "CAST(actual AS DOUBLE) AS actual FROM ("),
        "q_dq_reconcile_by_key": _from(
            ORDERS,
            f"""SELECT {order_columns}, 'left' AS only_in FROM o WHERE OrderID % 101 = 0 OR OrderID % 97 = 0
            UNION ALL SELECT {out(["OrderID", "CustomerID", "OrderDate"])}, 'Changed' AS Status, 'right' FROM o WHERE OrderID % 101 <> 0 AND OrderID % 97 = 0""",
        ),
        "q_dq_sample": _from(
            SEGMENTS,
            f"""SELECT CustomerID, BehaviorSegment, CAST((n IS DISTINCT FROM fin.m) AS BIGINT) + CAST(latest IS DISTINCT FROM newest AS BIGINT) AS differences,
                CASE WHEN n IS DISTINCT FROM fin.m THEN CAST(n AS VARCHAR) ELSE '' END AS orders
            FROM (SELECT CustomerID, BehaviorSegment FROM seg
                  QUALIFY row_number() OVER (PARTITION BY BehaviorSegment ORDER BY md5(CAST(CustomerID AS VARCHAR)), CustomerID) <= {SAMPLE_SIZE})
            JOIN (SELECT CustomerID, count(DISTINCT OrderID) AS n, max(OrderDate) AS latest FROM o JOIN d USING (OrderID) GROUP BY 1) total USING (CustomerID)
            JOIN (SELECT CustomerID, count(DISTINCT OrderID) AS m, max(OrderDate) AS newest FROM o JOIN d USING (OrderID) WHERE Status = 'Completed'
                  GROUP BY 1) fin USING (CustomerID)""",
        ),
        "q_dq_reconcile": _from(
            ORDERS, f"SELECT {order_columns}, 'right' AS only_in FROM o WHERE OrderDate >= DATE '{EARLIER_DATE}'"
        ),
    }

    changed = ",\n".join(
        [PRELUDE, base_cte("b", CHANGED), summary_ctes("ts", "b", CHANGED_SINCE), _metrics(), _segments()]
    )

    def run_summary(prelude: str, day: object, kind: str) -> str:
        return _from(
            prelude,
            f"""SELECT '{day}' AS ProcessDate, '{kind}' AS ProcessType, count(*) AS TotalCustomers,
            count(*) FILTER (WHERE LifecycleSegment = 'Active') AS ActiveCustomers,
            count(*) FILTER (WHERE LifecycleSegment = 'New Customer') AS NewCustomers,
            count(*) FILTER (WHERE LifecycleSegment IN ('At Risk', 'Churned')) AS ChurningCustomers,
            count(*) FILTER (WHERE ValueSegment = 'High Value') AS HighValueCustomers,
            CAST((2 * CAST(sum(CustomerLifetimeValue) * 1000000 AS HUGEINT) + count(*)) // (2 * count(*)) AS DOUBLE)
                / 1000000 AS AverageLifetimeValue, 'Success' AS ProcessingStatus, CAST(NULL AS VARCHAR) AS ErrorMessage
            FROM seg""",
        )

    steps = [
        ("Initialize", "0", f"Starting Customer Analytics processing for date: {DATA_DATE} - Type: FULL"),
        ("Bronze Ingestion", " + ".join(f"(SELECT count(*) FROM {t})" for t in counted.values()), "Ingested source tables"),
        ("Extract Customer Base", "(SELECT count(*) FROM b)", "Extracted base customer data"),
        ("Process Transaction Summary", "(SELECT count(*) FROM ts)", "Calculated transaction summary metrics"),
        ("Calculate Customer Metrics", "(SELECT count(*) FROM ts)", "Calculated advanced customer metrics"),
        ("Customer Segmentation", "(SELECT count(*) FROM ts)", "Completed customer segmentation"),
        ("Data Persistence", "(SELECT count(*) FROM ts)", "Data persistence completed"),
        ("Generate Summary", "1", "Summary statistics generated"),
    ]
    # One product is listed twice: bronze has a row more, and the step that reads the products fails.
    repeated = "'ProductID ' || (SELECT min(p_partkey) FROM part) || ' occurs more than once"
    no_counts = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in (
        ("ActiveCustomers", "BIGINT"), ("NewCustomers", "BIGINT"), ("ChurningCustomers", "BIGINT"), ("HighValueCustomers", "BIGINT"), ("AverageLifetimeValue", "DOUBLE"),
    ))
    stored = {
        "bronze": "Customers CustomerAddresses CustomerInteractions Orders OrderDetails Products Returns",
        "silver": "CustomerBase TransactionSummary",
        "gold": "CustomerMetrics CustomerSegments CustomerAnalytics CustomerAnalyticsSummary",
    }
    unknown = "(SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS k FROM events)"
    null_lines = DETAILS.replace(
        "(1 - CAST(l_discount AS DECIMAL(4,2)))", "(1 - CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_discount AS DECIMAL(4,2)) END)"
    )
    runs = {
        "q_run_analytics": groups["q_customer_analytics"],
        "q_run_analytics_incremental": _from(
            changed, f"SELECT '{CHANGED_SINCE}' AS ProcessDate, {out(ANALYTICS_COLUMNS[1:])} FROM seg"
        ),
        "q_run_summary": f"SELECT * FROM ({run_summary(SEGMENTS, DATA_DATE, 'FULL')}) UNION ALL "
        f"SELECT * FROM ({run_summary(changed, CHANGED_SINCE, 'INCREMENTAL')})",
        "q_run_failed": f"""SELECT 'nightly' AS RunID, '{DATA_DATE}' AS ProcessDate, 'FULL' AS ProcessType, 0 AS TotalCustomers, {no_counts},
            'Failed' AS ProcessingStatus, {repeated} at step Process Transaction Summary' AS ErrorMessage, 4 AS LogID,
            'Process Transaction Summary' AS StepName, -1 AS RowCount, 'ERROR: ' || {repeated}' AS Message""",
        "q_run_retried": f"SELECT 'nightly' AS RunID, *, 8 AS steps, 0 AS least_rows FROM ({run_summary(SEGMENTS, DATA_DATE, 'FULL')})",
        "q_run_times": " UNION ALL ".join(
            f"SELECT {k} AS LogID, {k} AS place, '{name}' AS StepName, true AS ends_after_start, true AS summary_agrees"
            for k, (name, _, _) in enumerate(steps, start=1)
        ),
        "q_saved_table": _from(SEGMENTS, "SELECT CustomerID, BehaviorSegment, TargetGroup FROM seg"),
        "q_run_report": " UNION ALL ".join(
            f"SELECT '{DATA_DATE}' AS process_date, 'FULL' AS process_type, 'Success' AS run_status, '{layer}' AS layer, "
            f"'Success' AS layer_status, '{','.join(sorted(names.split()))}' AS tables, '' AS error"
            for layer, names in stored.items()
        ),
        "q_run_log": _from(
            SUMMARY,
            " UNION ALL ".join(
                f"SELECT {k} AS LogID, '{name}' AS StepName, CAST({count} AS BIGINT) AS RowCount, '{message}' AS Message"
                for k, (name, count, message) in enumerate(steps, start=1)
            ),
        ),
        "q_ntile_null_keys": f"""SELECT event_id, ntile(5) OVER (ORDER BY k ASC NULLS FIRST, event_id) AS up,
            ntile(5) OVER (ORDER BY k DESC NULLS LAST, event_id) AS down FROM {unknown}""",
        "q_null_favourites": _from(
            f"{ORDERS}, {null_lines}, l AS (SELECT * FROM o JOIN d USING (OrderID) WHERE Status = 'Completed'), "
            "p AS (SELECT l.*, p_type AS Category, p_name AS ProductName FROM l JOIN part ON p_partkey = ProductID)",
            """SELECT CustomerID, TotalOrders, CAST(CAST(x AS DECIMAL(24,4)) AS DOUBLE) AS TotalSpent, TopCategory, TopProduct
            FROM (SELECT CustomerID, count(DISTINCT OrderID) AS TotalOrders, sum(NetAmount) AS x FROM l GROUP BY 1)
            LEFT JOIN (SELECT CustomerID, Category AS TopCategory FROM p GROUP BY CustomerID, Category QUALIFY row_number()
                OVER (PARTITION BY CustomerID ORDER BY sum(NetAmount) DESC NULLS LAST, Category) = 1) USING (CustomerID)
            LEFT JOIN (SELECT CustomerID, ProductName AS TopProduct FROM p GROUP BY CustomerID, ProductName QUALIFY row_number()
                OVER (PARTITION BY CustomerID ORDER BY sum(Quantity) DESC NULLS LAST, ProductName) = 1) USING (CustomerID)""",
        ),
    }

    line_list = """CASE {0} % 4 WHEN 0 THEN [text] WHEN 1 THEN ['', text] WHEN 2 THEN CAST([] AS VARCHAR[])
        ELSE string_split(text, chr(10)) END"""
    said = "coalesce(arg_max(text, turn) FILTER (WHERE role = '{}'), '')"
    latest = "arg_max(text, turn) FILTER (WHERE role = '{0}')"
    # One block; an empty one before it; none, as the fence stays open; a block for each line.
    blocks = (
        f"coalesce(CASE conv_id % 4 WHEN 0 THEN {latest} WHEN 1 THEN chr(10) || chr(10) || {latest} WHEN 2 THEN '' "
        f"ELSE replace({latest}, chr(10), chr(10) || chr(10)) END, '')"
    )
    stages = " ".join(f"WHEN '{role}' THEN '{stage}'" for role, stage in ROLE_STAGES.items())
    markers = " ".join(
        f"WHEN '{role}' THEN '{dict(fx.STAGE_MARKERS)[stage]}'" for role, stage in ROLE_STAGES.items()
    )
    words = {
        "q_last_response": f"SELECT conv_id, {said.format('assistant')} AS response FROM conversations GROUP BY conv_id",
        "q_response_fallback": "SELECT conv_id, "
        + ", ".join(f"{_fallback(order)} AS {name}" for name, order in FALLBACKS.items())
        + " FROM conversations GROUP BY conv_id",
        "q_message_stats": "SELECT role, count(*) AS messages, CAST(sum(length(text)) AS BIGINT) AS total_chars "
        "FROM conversations GROUP BY role",
        "q_text_snippet": "SELECT conv_id, turn, CASE WHEN length(text) > 300 THEN substring(text, 1, 300) || '...' "
        "ELSE text END AS snippet FROM conversations",
        "q_conversation_export": "SELECT conv_id, turn, CAST(json_object('name', role, 'content', text) AS VARCHAR) "
        "AS message FROM conversations",
        "q_from_references": f"SELECT doc_id, unnest(list_distinct({TABLES})) AS table_name FROM documents",
        "q_sql_references_scanned": """SELECT doc_id, 'Raw FROM x.t' || (doc_id % 7) || ',dbo.Orders ' || (doc_id % 5) || ',schema' || (doc_id % 3)
            || '.customers' AS scanned_tables, 'first_' || (doc_id % 4) || ',second' AS scanned_ctes FROM documents""",
        "q_sql_references_in_prose": "SELECT 0 AS ctes, count(*) AS documents FROM documents",
        "q_scripts_read": """SELECT doc_id // 100 AS part, CAST(length(string_agg(text || chr(10), '' ORDER BY doc_id)) AS BIGINT) AS chars,
            sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1""",
        "q_sql_inventory": f"""SELECT doc_id, array_to_string(list_sort(list_distinct({TABLES})), ',') AS referenced_tables,
            array_to_string(regexp_extract_all(text, '(?i)WITH\\s+([a-zA-Z0-9_]+)\\s+AS', 1), ',') AS ctes,
            contains(upper(text), 'GROUP BY') AS has_group_by, contains(upper(text), 'ORDER BY') AS has_order_by,
            contains(upper(text), 'OVER (') AS has_window_function,
            contains(string_split(upper(text), 'FROM')[1], 'SELECT') AS select_before_from FROM documents""",
        "q_code_blocks": f"""SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS position, unnest(l) AS block
            FROM (SELECT doc_id, {line_list.format("doc_id")} AS l FROM documents)""",
        "q_code_text": f"""SELECT doc_id, trim(CASE WHEN lang <> 'en' THEN text WHEN doc_id % 4 = 2
            THEN 'never closed' || chr(10) || '```python' || chr(10) || text
            ELSE array_to_string(list_transform({line_list.format("doc_id")},
                lambda line: ltrim(CASE WHEN doc_id % 4 = 1 AND line = '' THEN '' ELSE line || chr(10) END, {BLANKS})
                    || CASE WHEN trim(line, {BLANKS}) = '' AND NOT (doc_id % 4 = 1) THEN chr(10) ELSE '' END),
                chr(10) || chr(10)) END, {BLANKS}) AS code FROM documents""",
        "q_stage_blocks": f"""SELECT conv_id, CASE role {stages} END AS stage,
            CASE role {markers} END || chr(10) || arg_max(text, turn) AS block
            FROM conversations GROUP BY conv_id, role""",
        "q_artifacts": f"""SELECT conv_id, {blocks.format("assistant")} AS code_blocks,
            {blocks.format("user")} AS test_blocks,
            coalesce(CASE conv_id % 4
                WHEN 0 THEN 'intro' || chr(10) || '```python' || chr(10) || {latest.format("system")}
                    || chr(10) || '```' || chr(10) || 'end'
                WHEN 1 THEN '```python' || chr(10) || '```' || chr(10) || 'after' || chr(10) || '```pyspark' || chr(10)
                    || {latest.format("system")} || chr(10) || '```'
                WHEN 2 THEN 'never closed' || chr(10) || '```python' || chr(10) || {latest.format("system")}
                ELSE 'first' || chr(10) || '```python' || chr(10) || replace({latest.format("system")}, chr(10),
                    chr(10) || '```' || chr(10) || 'then' || chr(10) || ' ```python ' || chr(10))
                    || chr(10) || '```' || chr(10) || 'end' END, '') AS plan
            FROM conversations GROUP BY conv_id""",
    }
    return {**lookups, **transactions, **figures, **groups, **other_grains, **maintenance, **checks, **runs, **words}
