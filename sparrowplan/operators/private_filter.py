"""Filters whose constants are bound apart from the plan: conjunctions, IN lists, and a common part AND (group OR group ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowplan.functions.dictionary import Dictionary

#: `radixBase` and `numDigits` say how constants are split where they are compared in secret; they change no answer.
KEYS = {"type", "column", "value", "threshold", "thresholds", "wireKey", "radixBase", "numDigits"}
OPS = {
    "less_equal": lambda c, v: c <= v,
    "less_than": lambda c, v: c < v,
    "greater_equal": lambda c, v: c >= v,
    "greater_than": lambda c, v: c > v,
    "equal": lambda c, v: c == v,
}


def bound(predicate: dict, constants: dict, place: int = 0) -> object:
    """The constant of a predicate: its own value or threshold, else looked up as wireKey, column, column_type, column_in_i.

    A list of empty thresholds is looked up as a whole, then one by one.
    """
    for own in ("value", "threshold"):
        if predicate.get(own, "") != "":
            return predicate[own]
    several = predicate.get("thresholds", [])
    if several and "" not in several:
        return several
    column, wire = predicate["column"], predicate.get("wireKey")
    for key in (wire, column, f"{column}_{predicate['type']}", *([] if several else [f"{column}_in_{place}"])):
        if key is not None and key in constants:
            return constants[key]
    if several:
        found = [v if v != "" else constants.get(f"{wire or column}_in_{i}") for i, v in enumerate(several)]
        if None not in found:
            return found
    raise KeyError(f"no constant for {column}")


def _one(predicate: dict, constants: dict, place: int, dictionary: Dictionary | None) -> Column:
    unknown = set(predicate) - KEYS
    if unknown:
        raise ValueError(f"unknown keys of a predicate: {sorted(unknown)}")
    c = F.col(predicate["column"])
    value = bound(predicate, constants, place)
    if dictionary is not None and predicate["column"] in dictionary:
        code = lambda v: dictionary.code(predicate["column"], v)
        c, value = dictionary.encoded(predicate["column"], c), [code(v) for v in value] if predicate["type"] == "in" else code(value)
    if predicate["type"] == "in":
        return c.isin(list(value))
    if predicate["type"] not in OPS:
        raise ValueError(f"unknown predicate {predicate['type']}")
    return OPS[predicate["type"]](c, F.lit(value))


def condition(predicates: list[dict], groups: list[list[dict] | dict] | None = None, constants: dict | None = None, dictionary: Dictionary | None = None) -> Column:
    """All `predicates`, and any of the groups if there are some. A row that fits several groups counts once.

    With a dictionary, columns it knows are compared by their codes.
    """
    constants = constants or {}
    listed = lambda ps: ps["predicates"] if isinstance(ps, dict) else ps
    both = lambda ps: reduce(lambda a, b: a & b, [_one(p, constants, i, dictionary) for i, p in enumerate(listed(ps))], F.lit(True))
    out = both(predicates)
    return out & reduce(lambda a, b: a | b, [both(g) for g in groups]) if groups else out
