"""Small source tables written out by hand."""

from datetime import date
from decimal import Decimal

from patronage.contracts import SOURCES

DAY = date(2024, 6, 30)


def days_ago(n):
    return date.fromordinal(DAY.toordinal() - n)


def frame(spark, name, rows):
    schema = SOURCES[name].schema
    fields = [f for f in schema.names if f not in ("GrossAmount",)]
    return spark.createDataFrame(rows, schema).select(*fields) if rows is not None else None


def customer(number, first="Ann", last="Lee", changed=days_ago(400), status="Active"):
    return (number, first, last, f"{number}@x.org", "1", "Retail", 7, days_ago(900), changed, status)


def address(number, street="1 Road", kind="Primary"):
    return (number, kind, street, "1000", "Town", "State", "Land")


def line(order, product, quantity, price, discount="0"):
    return (order, product, Decimal(quantity), Decimal(price), Decimal(discount), None)


def sources(spark, customers=(), addresses=(), contacts=(), orders=(), lines=(), products=(), returns=()):
    rows = dict(zip(SOURCES, (customers, addresses, contacts, orders, lines, products, returns)))
    return {name: frame(spark, name, list(values)) for name, values in rows.items()}
