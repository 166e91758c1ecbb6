"""Schemas that change over time: columns are united by name and types only ever widen.

A stored table has one current schema. Partitions written before it came about keep the one they were written with
(``Older``) and are read as the current one: columns they lack are null, narrower types are widened. Nothing is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())
WHOLE_DIGITS = (3, 5, 10, 19)
MOST_DIGITS = 38


def wider(a: T.DataType, b: T.DataType, column: str) -> T.DataType:
    """The narrowest type that holds all values of both."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return united(a, b, f"{column}.")
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType, f"{column}[]"), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, wider(a.valueType, b.valueType, f"{column}{{}}"), True)
    if a in WHOLE and b in WHOLE:
        return WHOLE[max(WHOLE.index(a), WHOLE.index(b))]
    numbers = [_digits(t) for t in (a, b)]
    if all(numbers):
        before, after = (max(n[k] for n in numbers) for k in (0, 1))
        if before + after <= MOST_DIGITS:
            return T.DecimalType(before + after, after)
    fractions = (T.FloatType(), T.DoubleType())
    if all(t in fractions or t in WHOLE[:3] for t in (a, b)):  # a double holds whole numbers of 32 bits exactly
        return T.DoubleType()
    if {a, b} == {T.DateType(), T.TimestampNTZType()}:
        return T.TimestampNTZType()
    raise ValueError(f"columns differ from the stored table: {column} is {b.simpleString()}, was {a.simpleString()}")


def _digits(kind: T.DataType) -> tuple[int, int] | None:
    """Digits before and after the point of a decimal or whole number."""
    if isinstance(kind, T.DecimalType):
        return kind.precision - kind.scale, kind.scale
    return (WHOLE_DIGITS[WHOLE.index(kind)], 0) if kind in WHOLE else None


def united(stored: T.StructType, given: T.StructType, within: str = "") -> T.StructType:
    """The stored columns in their order, widened where need be, then those that are new. All may be null."""
    new = {f.name: f.dataType for f in given}
    fields = [
        T.StructField(f.name, wider(f.dataType, new[f.name], within + f.name) if f.name in new else f.dataType, True) for f in stored
    ]
    known = set(stored.names)
    return T.StructType([*fields, *(T.StructField(f.name, f.dataType, True) for f in given if f.name not in known)])


def same(a: T.StructType, b: T.StructType) -> bool:
    """Whether the columns agree in names and types, whatever may be null."""
    return {f.name: f.dataType for f in a} == {f.name: f.dataType for f in b}


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the schema's columns, in its types; null where it lacks one."""
    return df.select(*[_fit(F.col(f"`{f.name}`"), df.schema[f.name].dataType, f.dataType).alias(f.name) if f.name in df.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def _fit(value: Column, given: T.DataType, wanted: T.DataType) -> Column:
    if given == wanted:
        return value
    if isinstance(wanted, T.StructType):
        inner = {f.name: f.dataType for f in given}
        fields = [
            (_fit(value.getField(f.name), inner[f.name], f.dataType) if f.name in inner else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in wanted
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(wanted, T.ArrayType):
        return F.transform(value, lambda x: _fit(x, given.elementType, wanted.elementType))
    if isinstance(wanted, T.MapType):
        return F.transform_values(value, lambda k, v: _fit(v, given.valueType, wanted.valueType))
    return value.cast(wanted)


@dataclass
class Older:
    """Schemas that were current once, with the partitions that still have them."""

    held: list[tuple[T.StructType, set[str]]] = field(default_factory=list)

    @classmethod
    def from_json(cls, value: dict | None) -> Older:
        return cls([(T.StructType.fromJson(e["schema"]), set(e["partitions"])) for e in (value or {"older": []})["older"]])

    def json(self) -> dict:
        return {"older": [{"schema": s.jsonValue(), "partitions": sorted(p)} for s, p in self.held if p]}

    def all(self) -> set[str]:
        return set().union(*(p for _, p in self.held))

    def add(self, schema: T.StructType, partitions: Iterable[str]) -> None:
        """These partitions, unless an earlier schema holds them, have this one."""
        self.held.append((schema, set(partitions) - self.all()))

    def drop(self, partitions: Iterable[str]) -> bool:
        gone = set(partitions)
        found = bool(gone & self.all())
        self.held = [(s, p - gone) for s, p in self.held]
        return found

    def of(self, partition: str) -> T.StructType | None:
        return next((s for s, p in self.held if partition in p), None)
