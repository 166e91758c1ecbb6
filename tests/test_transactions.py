import random
from collections import defaultdict
from dataclasses import replace
from decimal import ROUND_HALF_UP, Decimal

import pytest
from frames import DAY, customer, days_ago, line, sources
from pyspark.sql import functions as F

from patronage.operators import transactions as txn
from patronage.params import INCREMENTAL, RunParams

P = RunParams(data_date=DAY)
CENT = Decimal("0.01")


def summary(tables, p=P, members=None):
    rest = [tables[n] for n in ("Orders", "OrderDetails", "Products", "Returns")]
    return txn.transaction_summary(members or tables["Customers"], *rest, p)


@pytest.fixture(scope="module")
def tables(spark):
    """Customer 1: ties, a repeated line, an unlisted product. 2: only an open order. 3: not a member."""
    return sources(
        spark,
        customers=[customer(1), customer(2), customer(4)],
        orders=[
            (10, 1, days_ago(40), "Completed"),
            (11, 1, days_ago(3), "Completed"),
            (12, 1, days_ago(1), "Completed"),
            (20, 2, days_ago(2), "Open"),
            (30, 3, days_ago(2), "Completed"),
            (40, 4, days_ago(31), "Completed"),
            (41, 4, DAY, "Cancelled"),
        ],
        lines=[
            line(10, 100, "2", "10.00", "0.10"),
            line(10, 100, "2", "10.00", "0.10"),
            line(10, 101, "4", "9.00"),
            line(11, 999, "50", "1.01", "0.05"),
            line(30, 100, "1", "1.00"),
            line(20, 100, "1", "1.00"),
            line(40, 102, "1", "0.05", "0.50"),
        ],
        products=[(100, "B", "bolt"), (101, "A", "axle"), (102, None, None)],
        returns=[(1, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 3)],
    )


def test_summary_by_hand(tables):
    rows = {r["CustomerID"]: r for r in summary(tables).collect()}
    assert rows.keys() == {1, 4}
    one = rows[1]
    assert one["TotalOrders"] == 2  # order 12 has no lines
    assert one["TotalSpent"] == Decimal("119.98")  # 36 + 36 + 47.975
    assert one["AvgOrderValue"] == Decimal("59.99")  # 119.975 / 2 = 59.9875
    assert (one["FirstPurchaseDate"], one["LastPurchaseDate"]) == (days_ago(40), days_ago(3))
    assert one["DaysSinceLastPurchase"] == 3
    assert (one["TopCategory"], one["TopProduct"]) == ("A", "axle")  # ties at 36 and at 4
    assert one["ReturnRate"] == Decimal("150.00")
    four = rows[4]
    assert (four["TopCategory"], four["TopProduct"], four["ReturnRate"]) == (None, None, Decimal("0.00"))
    assert four["TotalSpent"] == Decimal("0.03") and four["AvgOrderValue"] == Decimal("0.03")  # 0.025


def test_incremental_rows_are_full_rows(tables):
    members = tables["Customers"].where("CustomerID <> 1")
    got = summary(tables, replace(P, process_type=INCREMENTAL), members)
    assert [r["CustomerID"] for r in got.collect()] == [4]
    assert got.exceptAll(summary(tables)).isEmpty()


def test_strict_types(tables):
    strict = dict(summary(tables, replace(P, strict_types=True)).dtypes)
    assert strict["TotalSpent"] == "decimal(15,2)" and strict["ReturnRate"] == "decimal(5,2)"


def test_repeated_members_do_not_repeat_rows(tables):
    twice = tables["Customers"].unionAll(tables["Customers"])
    assert summary(tables, members=twice).count() == 2


def test_one_customer_holds_most_lines(spark):
    """Random lines with a heavy customer, order and product, against loops over the same rows."""
    chance = random.Random(11)
    heavy = lambda low, high: low if chance.random() < 0.4 else chance.randrange(low, high)
    orders = [(o, heavy(1, 30), days_ago(chance.randrange(300)), chance.choice(("Completed", "Open"))) for o in range(200)]
    orders[0] = (0, 1, days_ago(10), "Completed")
    lines = [
        line(heavy(0, 220), heavy(0, 25), str(chance.randrange(1, 9)), f"{chance.randrange(1, 99999) / 100:.2f}", f"0.{chance.randrange(30):02d}")
        for _ in range(3000)
    ]
    products = [(i, f"c{i % 4}", f"n{i % 9}") for i in range(20)]
    returns = [(chance.randrange(40), chance.randrange(1, 35)) for _ in range(100)]
    tables = sources(
        spark, customers=[customer(i) for i in range(1, 28)], orders=orders, lines=lines, products=products, returns=returns
    )
    done = {o: (c, d) for o, c, d, s in orders if s == "Completed"}
    names = {i: (c, n) for i, c, n in products}
    net, dates, seen = defaultdict(Decimal), defaultdict(set), defaultdict(set)
    spend, count = defaultdict(Decimal), defaultdict(Decimal)
    for o, product, quantity, price, discount, _ in lines:
        if o not in done:
            continue
        who, day = done[o]
        amount = quantity * price * (1 - discount)
        net[who] += amount
        dates[who].add(day)
        seen[who].add(o)
        if product in names:
            spend[who, names[product][0]] += amount
            count[who, names[product][1]] += quantity
    back = defaultdict(set)
    for number, who in returns:
        back[who].add(number)

    def top(totals, who):
        return min(((-v, k[1]) for k, v in totals.items() if k[0] == who), default=(0, None))[1]

    def two(x):
        return x.quantize(CENT, rounding=ROUND_HALF_UP)

    want = {
        who: (
            who,
            len(seen[who]),
            two(net[who]),
            two(net[who] / len(seen[who])),
            min(dates[who]),
            max(dates[who]),
            (DAY - max(dates[who])).days,
            top(spend, who),
            top(count, who),
            two(Decimal(100 * len(back[who])) / len(seen[who])),
        )
        for who in net
        if who < 28
    }
    assert {r["CustomerID"]: tuple(r) for r in summary(tables).collect()} == want


def test_single_pass_equals_separate_operators(tables):
    facts = txn.line_facts(tables["Orders"], tables["OrderDetails"])
    joined = (
        txn.order_summary(tables["Orders"], tables["OrderDetails"])
        .join(txn.top_category(facts, tables["Products"]).selectExpr("CustomerID", "Category AS TopCategory"), "CustomerID", "left")
        .join(txn.top_product(facts, tables["Products"]).selectExpr("CustomerID", "ProductName AS TopProduct"), "CustomerID", "left")
    )
    single = txn.purchase_totals(facts, tables["Products"]).select(*joined.columns)
    assert single.exceptAll(joined).isEmpty() and joined.exceptAll(single).isEmpty()


def test_gross_amount_replaces_price(spark):
    details = spark.createDataFrame([(1, Decimal("3.00"), Decimal("0.50"))], "OrderID long, GrossAmount decimal(15,2), Discount decimal(4,2)")
    assert details.select(txn.net_amount(details)).first()[0] == Decimal("1.50")


def test_return_rate_needs_orders(tables):
    totals = txn.order_summary(tables["Orders"], tables["OrderDetails"])
    rows = {r["CustomerID"]: (r["TotalReturns"], r["ReturnRate"]) for r in txn.return_rate(tables["Returns"], totals, P).collect()}
    assert rows == {1: (3, Decimal("150.00")), 3: (1, Decimal("100.00"))}
    assert totals.where(F.col("CustomerID") == 2).isEmpty()
