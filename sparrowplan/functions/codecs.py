"""Codecs between stored values and the numbers that plans compute with."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
EPOCH = "1992-01-01"
SCALE = 1_000_000


def relative_days(date: Column, epoch: str = EPOCH) -> Column:
    return F.datediff(date.cast("date"), F.lit(epoch).cast("date"))


def date_of_days(days: Column, epoch: str = EPOCH) -> Column:
    return F.date_add(F.lit(epoch).cast("date"), days.cast("int"))


def epoch_seconds(date: Column) -> Column:
    return F.unix_date(date.cast("date")).cast("long") * 86400


def fixed_point(value: Column, scale: int = SCALE) -> Column:
    """The value times the scale, rounded to a whole number: sums of it are exact and don't depend on order."""
    return F.round(value.cast("double") * scale).cast("long")


def from_fixed_point(value: Column, scale: int = SCALE) -> Column:
    return value.cast("double") / scale


def digits(value: Column, base: int, count: int) -> Column:
    """Digits to the base, least significant first, of a whole number; negative numbers have none and are an error."""
    whole = F.when(value < 0, F.raise_error(F.lit("a negative number has no digits")).cast("long")).otherwise(value.cast("long"))
    powers = [base**i for i in range(count)]
    return F.array(*[(F.call_function("div", whole, F.lit(p).cast("long")) % base).cast("int") if p < 1 << 63 else F.lit(0) for p in powers])


def undigits(value: Column, base: int) -> Column:
    return F.aggregate(F.reverse(value), F.lit(0).cast("long"), lambda acc, d: acc * base + d)


def enum_dictionary(df: DataFrame, column: str) -> list[str]:
    """The trimmed values of an enumerated column in a fixed order; enumerations are small by definition (10,000 at most here)."""
    values = [r[0] for r in df.select(F.trim(column).alias("v")).where("v is not null").distinct().orderBy("v").limit(10_001).collect()]
    if len(values) > 10_000:
        raise ValueError(f"{column} is no enumeration")
    return values


def enum_id(value: Column, dictionary: list[str]) -> Column:
    """The id of a value; an unknown value raises an error."""
    ids = F.create_map(*[x for i, v in enumerate(dictionary) for x in (F.lit(v), F.lit(i))])
    found = F.try_element_at(ids, F.trim(value))
    return F.when(found.isNull() & value.isNotNull(), F.raise_error(F.concat(F.lit("unknown enumeration value "), value))).otherwise(found)


def enum_value(number: Column, dictionary: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, dictionary)), number)


def padded(value: Column, width: int) -> Column:
    """CHAR(n): padded with spaces, cut to the width."""
    return F.rpad(value, width, " ")


def approx_eq(a: Column, b: Column, tolerance: float = 1e-5) -> Column:
    return F.abs(a - b) <= F.abs(a) * tolerance


ZEROS: Mapping[str, object] = {"boolean": False, "int": 0, "bigint": 0, "smallint": 0, "tinyint": 0, "float": 0.0, "double": 0.0, "string": ""}


def zero_of(kind: str) -> Column:
    """The value that stands for nothing in a column of this type."""
    if kind == "date":
        return F.lit("1970-01-01").cast("date")
    if kind.startswith("timestamp"):
        return F.lit("1970-01-01 00:00:00").cast(kind)
    if kind.startswith("decimal"):
        return F.lit(0).cast(kind)
    return F.lit(ZEROS[kind]).cast(kind)
