"""The seven source tables: columns, types and keys, and checks against them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, TEXT, DAY = T.LongType(), T.StringType(), T.DateType()
MONEY, FRACTION = T.DecimalType(15, 2), T.DecimalType(4, 2)


@dataclass(frozen=True)
class Contract:
    """``key`` identifies a row where ``unique`` holds; it is also the column JDBC reads split on."""

    name: str
    schema: T.StructType
    key: str
    unique: bool
    optional: tuple[str, ...] = ()


def _contract(name: str, key: str, unique: bool, optional: tuple[str, ...] = (), **columns) -> Contract:
    schema = T.StructType([T.StructField(column, kind) for column, kind in columns.items()])
    return Contract(name, schema, key, unique, optional)


SOURCES: dict[str, Contract] = {
    c.name: c
    for c in (
        _contract(
            "Customers",
            key="CustomerID",
            unique=True,
            CustomerID=LONG,
            FirstName=TEXT,
            LastName=TEXT,
            Email=TEXT,
            Phone=TEXT,
            CustomerType=TEXT,
            AccountManagerID=T.IntegerType(),
            CreatedDate=DAY,
            ModifiedDate=DAY,
            Status=TEXT,
        ),
        _contract(
            "CustomerAddresses",
            key="CustomerID",
            unique=False,
            CustomerID=LONG,
            AddressType=TEXT,
            StreetAddress=TEXT,
            PostalCode=TEXT,
            City=TEXT,
            State=TEXT,
            Country=TEXT,
        ),
        _contract("CustomerInteractions", key="CustomerID", unique=False, CustomerID=LONG, ContactDate=DAY),
        _contract(
            "Orders", key="OrderID", unique=True, OrderID=LONG, CustomerID=LONG, OrderDate=DAY, Status=TEXT
        ),
        # GrossAmount replaces Quantity * UnitPrice where the source already holds the line total.
        _contract(
            "OrderDetails",
            key="OrderID",
            unique=False,
            optional=("UnitPrice", "GrossAmount"),
            OrderID=LONG,
            ProductID=LONG,
            Quantity=MONEY,
            UnitPrice=MONEY,
            Discount=FRACTION,
            GrossAmount=MONEY,
        ),
        _contract(
            "Products", key="ProductID", unique=True, ProductID=LONG, Category=TEXT, ProductName=TEXT
        ),
        _contract("Returns", key="ReturnID", unique=True, ReturnID=LONG, CustomerID=LONG),
    )
}


def _exact(df: DataFrame, field: T.StructField, name: str) -> Column:
    """The column in the contract's type, or an error where that would change a value.

    Decimals keep the source's own digits, and whole numbers become decimals; binary fractions have no exact
    decimal form, so a source has to say itself how many digits they mean.
    """
    column, given, wanted = F.col(field.name), df.schema[field.name].dataType, field.dataType
    if given == wanted:
        return column
    if isinstance(wanted, T.DecimalType):
        if isinstance(given, T.DecimalType):
            return column
        if isinstance(given, T.IntegralType):
            return column.cast(T.DecimalType(20, 0))
        if isinstance(given, T.FractionalType):
            raise ValueError(f"{name}.{field.name} is {given.simpleString()}; cast it to a decimal in the source")
        return column.cast(wanted)
    if isinstance(wanted, T.IntegralType) and isinstance(given, (T.FractionalType, T.DecimalType)):
        whole = column.cast(wanted)
        message = F.concat(F.lit(f"{name}.{field.name} is no whole number: "), column.cast("string"))
        return F.when(column.isNull() | (whole == column), whole).otherwise(F.raise_error(message).cast(wanted))
    return column.cast(wanted)


def conform(df: DataFrame, name: str, others: bool = False) -> DataFrame:
    """The contract's columns in its types; no value loses digits. Other columns never reach the job, unless
    ``others`` carries them along behind."""
    contract = SOURCES[name]
    present = set(df.columns)
    missing = [f for f in contract.schema.names if f not in present and f not in contract.optional]
    if name == "OrderDetails" and not present & set(contract.optional):
        missing.append("UnitPrice")
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    own = [_exact(df, f, name).alias(f.name) for f in contract.schema if f.name in present]
    known = set(contract.schema.names)
    return df.select(*own, *[F.col(f"`{c}`") for c in df.columns if others and c not in known])


def require(frames: Mapping[str, DataFrame | None], *names: str) -> list[DataFrame]:
    """The named frames in order, or an error that lists every missing one."""
    missing = [name for name in names if frames.get(name) is None]
    if missing:
        raise ValueError(f"Missing required inputs: {', '.join(missing)}")
    return [frames[name] for name in names]
