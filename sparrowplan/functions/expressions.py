"""Expression trees in JSON, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CASTS = {"INTEGER": "int", "INT": "int", "LONG": "bigint", "BIGINT": "bigint", "FLOAT": "double", "DECIMAL": "double", "BOOLEAN": "boolean", "BOOL": "boolean", "DATE": "date", "CHAR": "string", "VARCHAR": "string"}


def whole_division(a: Column, b: Column) -> Column:
    """Division of whole numbers that drops the rest, exact up to 64 bits; by zero it gives 0."""
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a.cast("long"), safe.cast("long")))


BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "PLUS": lambda a, b: a + b,
    "MINUS": lambda a, b: a - b,
    "TIMES": lambda a, b: a * b,
    "DIVIDE": lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, F.lit(1)).otherwise(b)),
    "DIV": whole_division,
    "MODULUS": lambda a, b: a % b,
    "EQUALS": lambda a, b: a == b,
    "NOT_EQUALS": lambda a, b: a != b,
    "LESS_THAN": lambda a, b: a < b,
    "GREATER_THAN": lambda a, b: a > b,
    "LESS_THAN_OR_EQUAL": lambda a, b: a <= b,
    "GREATER_THAN_OR_EQUAL": lambda a, b: a >= b,
    "XOR": lambda a, b: a.bitwiseXOR(b),
    "LIKE": F.like,
}
WHOLE = {"tinyint", "smallint", "int", "bigint"}
FUNCTIONS: dict[str, Callable[..., Column]] = {}


def register_function(name: str, function: Callable[..., Column]) -> None:
    """A function of columns, to be used in expressions under its name."""
    if name.upper() in BINARY or name.upper() in OTHERS:
        raise ValueError(f"{name} is an operator")
    FUNCTIONS[name.upper()] = function


OTHERS = {"NO-OP", "AND", "OR", "NOT", "CAST", "CASE"}


def column_of(node: dict, inputs: list[Column], kind_of: Callable[[Column], str] | None = None) -> Column:
    """The column that an expression stands for; inputs are addressed by place.

    `kind_of` tells a column's type: with it DIVIDE of two whole numbers is whole division, as the data model has it.
    """
    if "input" in node:
        return inputs[node["input"]]
    if "literal" in node:
        kind = node.get("type", {}).get("type", "").upper()
        if kind and kind not in CASTS:
            raise ValueError(f"unknown literal type {kind}")
        value = F.lit(node["literal"])
        if kind in ("CHAR", "VARCHAR") and "precision" in node["type"]:
            return F.rpad(value, node["type"]["precision"], " ") if kind == "CHAR" else value
        return value.cast(CASTS[kind]) if kind else value
    kind = node["op"]["kind"].upper()
    args = [column_of(x, inputs, kind_of) for x in node.get("operands", [])]
    if kind == "DIVIDE" and kind_of and len(args) == 2 and all(kind_of(a) in WHOLE for a in args):
        return whole_division(*args)
    if kind in FUNCTIONS:
        return FUNCTIONS[kind](*args)
    if kind == "NO-OP":
        return F.lit(True)
    if kind in ("AND", "OR"):
        out = args[0]
        for a in args[1:]:
            out = out & a if kind == "AND" else out | a
        return out
    if kind == "NOT":
        return ~args[0]
    if kind == "CAST":
        return args[0].cast(CASTS[node["type"]["type"].upper()])
    if kind == "CASE":
        if len(args) != 3:
            raise ValueError("CASE takes a condition and two values")
        return F.when(args[0], args[1]).otherwise(args[2])
    if kind not in BINARY or len(args) != 2:
        raise ValueError(f"unknown operator {kind} of {len(args)}")
    return BINARY[kind](*args)


def equi_keys(node: dict, left: int) -> list[tuple[int, int]]:
    """Pairs of places (left, right side) that a conjunction of equalities names; `left` is the left side's width."""
    kind = node.get("op", {}).get("kind", "").upper()
    if kind == "AND":
        return [k for x in node["operands"] for k in equi_keys(x, left)]
    if kind == "EQUALS" and all("input" in x for x in node["operands"]):
        a, b = sorted(x["input"] for x in node["operands"])
        if a < left <= b:
            return [(a, b - left)]
    return []
