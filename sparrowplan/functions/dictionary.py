"""Dictionaries of columns: how dates, enumerations and decimals become whole numbers, and back."""

from __future__ import annotations

import datetime
import json
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowplan.functions import codecs

KINDS = {"date", "integer", "decimal", "enum"}


class Dictionary:
    """The codecs of columns by name, from JSON with `tables`, each with its columns: type, mapping, params, strategy."""

    def __init__(self, source: str | dict) -> None:
        tables = (json.loads(source) if isinstance(source, str) else source)["tables"]
        self.columns = {name: spec for columns in tables.values() for name, spec in columns.items()}
        unknown = {spec["type"] for spec in self.columns.values()} - KINDS
        if unknown:
            raise ValueError(f"unknown types {unknown}")

    def __contains__(self, column: str) -> bool:
        return column in self.columns

    def _param(self, column: str, name: str, default: object) -> object:
        return (self.columns[column].get("params") or {}).get(name, default)

    def _epoch(self, column: str) -> str:
        return str(self._param(column, "epoch_start", codecs.EPOCH))

    def strategy(self, column: str) -> tuple[int, int]:
        """Base and number of the digits of the column's codes."""
        found = self.columns[column]["strategy"]
        return found["radixBase"], found["numDigits"]

    def code(self, column: str, value: object) -> int:
        """The code of a constant."""
        spec = self.columns[column]
        if spec["type"] == "enum":
            if str(value).strip() not in spec["mapping"]:
                raise ValueError(f"{value} is no value of {column}")
            return spec["mapping"][str(value).strip()]
        if spec["type"] == "date":
            return (datetime.date.fromisoformat(str(value)) - datetime.date.fromisoformat(self._epoch(column))).days
        scale = self._param(column, "scale_factor", 1)
        return int((Decimal(str(value)) * scale).to_integral_value(ROUND_HALF_UP))

    def encoded(self, column: str, value: Column) -> Column:
        """The codes of a column's values; an unknown value of an enumeration is an error."""
        spec = self.columns[column]
        if spec["type"] == "enum":
            ids = F.create_map(*[F.lit(x) for pair in spec["mapping"].items() for x in pair])
            found = F.try_element_at(ids, F.trim(value))
            return F.when(found.isNull() & value.isNotNull(), F.raise_error(F.concat(F.lit("unknown enumeration value "), value))).otherwise(found)
        if spec["type"] == "date":
            return codecs.relative_days(value, self._epoch(column))
        return codecs.fixed_point(value, self._param(column, "scale_factor", 1))

    def decoded(self, column: str, code: Column) -> Column:
        spec = self.columns[column]
        if spec["type"] == "enum":
            return F.try_element_at(F.create_map(*[F.lit(x) for name, i in spec["mapping"].items() for x in (i, name)]), code.cast("int"))
        if spec["type"] == "date":
            return codecs.date_of_days(code, self._epoch(column))
        scale = self._param(column, "scale_factor", 1)
        return code.cast("long") if spec["type"] == "integer" else codecs.from_fixed_point(code, scale)

    def encoded_table(self, df: DataFrame) -> DataFrame:
        """`df` with codes in place of the values of all columns it knows."""
        return df.select(*[self.encoded(c, F.col(c)).alias(c) if c in self else F.col(c) for c in df.columns])

    def decoded_table(self, df: DataFrame) -> DataFrame:
        return df.select(*[self.decoded(c, F.col(c)).alias(c) if c in self else F.col(c) for c in df.columns])
