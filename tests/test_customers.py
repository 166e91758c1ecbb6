from dataclasses import replace

import pytest
from frames import DAY, address, customer, days_ago, sources
from pyspark.errors import PySparkException

from patronage.operators import customers as cust
from patronage.params import INCREMENTAL, RunParams

P = RunParams(data_date=DAY)


def base(tables, p=P):
    return cust.customer_base(
        tables["Customers"], tables["CustomerAddresses"], tables["CustomerInteractions"], p
    )


@pytest.fixture(scope="module")
def tables(spark):
    return sources(
        spark,
        customers=[
            customer(1),
            customer(2, first=None),
            customer(3, last=None, status=None),
            customer(4, status="Closed", changed=DAY),
            customer(5, changed=None),
        ],
        addresses=[
            address(1),
            address(1),
            address(2, kind="Billing"),
            address(4, "1 Road"),
            address(4, "2 Road"),
            address(9),
        ],
        contacts=[(1, days_ago(5)), (1, days_ago(50)), (2, DAY), (2, days_ago(1)), (5, days_ago(-1)), (5, None)],
    )


def test_names_flags_and_outer_rows(tables):
    rows = {(r["CustomerID"], r["Address"]): r for r in base(tables).collect()}
    assert sorted(k[0] for k in rows) == [1, 2, 3, 4, 4, 5]
    assert rows[1, "1 Road"]["CustomerName"] == "Ann Lee" and rows[2, None]["CustomerName"] is None
    assert [rows[k]["IsActive"] for k in ((1, "1 Road"), (3, None), (4, "1 Road"))] == [1, 0, 0]
    assert rows[1, "1 Road"]["LastContactDate"] == days_ago(5) and rows[3, None]["LastContactDate"] is None


def test_null_safe_name(tables):
    rows = base(tables, replace(P, null_safe_name=True)).collect()
    assert {r["CustomerID"]: r["CustomerName"] for r in rows}[2] == "Lee"


def test_incremental_takes_changed_or_contacted(tables):
    p = replace(P, process_type=INCREMENTAL)
    got = base(tables, p)
    assert sorted({r["CustomerID"] for r in got.collect()}) == [2, 4, 5]
    assert got.exceptAll(base(tables)).isEmpty()


def test_duplicate_addresses(tables):
    first = base(tables, replace(P, on_duplicate_address="first")).collect()
    assert [r["Address"] for r in first if r["CustomerID"] == 4] == ["1 Road"]
    with pytest.raises(PySparkException, match="several primary addresses for customer 4"):
        base(tables, replace(P, on_duplicate_address="error")).collect()
    single = {**tables, "CustomerAddresses": tables["CustomerAddresses"].where("CustomerID = 1")}
    assert base(single, replace(P, on_duplicate_address="error")).count() == 5


@pytest.mark.parametrize("p", [P, replace(P, process_type=INCREMENTAL), replace(P, null_safe_name=True)])
def test_sql_form_gives_the_same_rows(tables, p):
    plain = base(tables, p)
    sql = cust.customer_base_sql(
        tables["Customers"], tables["CustomerAddresses"], tables["CustomerInteractions"], p
    )
    assert sql.columns == plain.columns
    assert sql.exceptAll(plain).isEmpty() and plain.exceptAll(sql).isEmpty()


def test_contact_forms_agree(tables):
    contacts = tables["CustomerInteractions"]
    left, right = cust.last_contact(contacts), cust.last_contact_by_window(contacts)
    assert sorted(left.collect()) == sorted(right.collect())
