"""Relational operators: DataFrame in, DataFrame out.

In oblivious mode a boolean column DUMMY marks rows that don't count (true: a dummy), and filters mark rows instead of
removing them; `reveal` removes them. In fast mode there is no such column. Both give the same answers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowplan.functions.codecs import zero_of
from sparrowplan.storage import stored

DUMMY = "_dummy"
#: Join hints by the algorithm that a plan names; without one, statistics decide.
HINTS = {"keyed-sort-merge-join": "merge", "cost-keyed-sort-merge-join": "merge", "sort-merge-join": "merge", "hash-join": "shuffle_hash", "nested-loop-join": None, "block-nested-loop-join": None, "auto": None, "": None}
AGGREGATES = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}


def oblivious(df: DataFrame) -> DataFrame:
    return df.withColumn(DUMMY, F.lit(False))


def live(df: DataFrame) -> Column:
    return ~F.col(DUMMY) if DUMMY in df.columns else F.lit(True)


def reveal(df: DataFrame) -> DataFrame:
    return df.where(~F.col(DUMMY)).drop(DUMMY) if DUMMY in df.columns else df


def strict(df: DataFrame) -> DataFrame:
    """`df`, with an error at run time for any null."""
    return df.select(*[F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null in {c}"))).otherwise(F.col(c)).alias(c) for c in df.columns])


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.withColumn(DUMMY, F.col(DUMMY) | ~predicate) if DUMMY in df.columns else df.where(predicate)


def project(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    keep = [F.col(DUMMY)] if DUMMY in df.columns else []
    return df.select(*[c.alias(n) for n, c in columns.items()], *keep)


def hinted(df: DataFrame, algorithm: str) -> DataFrame:
    if algorithm not in HINTS:
        raise ValueError(f"unknown join algorithm {algorithm}")
    return df.hint(HINTS[algorithm]) if HINTS[algorithm] else df


def basic_join(left: DataFrame, right: DataFrame, predicate: Column | None) -> DataFrame:
    """Any predicate; none gives the Cartesian product."""
    return left.crossJoin(right) if predicate is None else left.join(right, predicate)


def keyed_join(fk: DataFrame, pk: DataFrame, keys: list[tuple[str, str]], algorithm: str = "", check: bool = False, drop_key: bool = False) -> DataFrame:
    """A foreign-key side joined with its primary-key side; `check` refuses repeated primary keys."""
    if check:
        assert_unique(pk, [p for _, p in keys])
    on = reduce(lambda a, b: a & b, [fk[f] == pk[p] for f, p in keys])
    out = fk.join(hinted(pk, algorithm), on)
    return out.drop(*[pk[p] for _, p in keys]) if drop_key else out


def left_zero_join(fk: DataFrame, pk: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Left join in which columns without a partner hold the zero of their type."""
    on = reduce(lambda a, b: a & b, [fk[f] == pk[p] for f, p in keys])
    joined = fk.join(pk, on, "left")
    return joined.select(*[fk[c] for c in fk.columns], *[F.coalesce(pk[c], zero_of(t)).alias(c) for c, t in pk.dtypes])


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"{keys} is no primary key")


def positional(df: DataFrame, order: list[Column], name: str = "_place", parts: int = 0) -> DataFrame:
    """Rows numbered from 1 in a total order. Without that order positions have no meaning, so it must be given.

    The order is a range-partitioned sort; counts of the parts before shift the numbers, so no task sees all rows. The bounds of the
    parts come from a sample, which another run may draw differently, so the sorted rows are stored before they are counted.
    """
    if not order:
        raise ValueError("positional operators need an order")
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged, "places")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return ranged.join(F.broadcast(shift.drop("_n")), "_part").withColumn(name, F.col("_id") - F.col("_first") + F.col("_before") + 1).drop("_part", "_id", "_first", "_before")


def merge_join(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], predicate: Column) -> DataFrame:
    """Rows of equal place side by side, kept where the predicate holds; places that only one side has go."""
    return positional(left, left_order).join(positional(right, right_order), "_place").where(predicate).drop("_place")


def _side_by_side(a: DataFrame, b: DataFrame, a_order: list[Column], b_order: list[Column]) -> DataFrame:
    """All places of two inputs, of which either may be empty; inputs of different lengths are an error at run time."""
    joined = positional(a, a_order, "_pa").join(positional(b, b_order, "_pb"), F.col("_pa") == F.col("_pb"), "full")
    if not a.limit(1).count() or not b.limit(1).count():
        return joined
    uneven = F.col("_pa").isNull() | F.col("_pb").isNull()
    return joined.where(F.when(uneven, F.raise_error(F.lit("inputs of different lengths")).cast("boolean")).otherwise(True))


def merge_join_tagged(left: DataFrame, right: DataFrame, left_order: list[Column], right_order: list[Column], predicate: Column, left_dummy: str, right_dummy: str, either: bool = False) -> DataFrame:
    """Rows of equal place side by side; DUMMY marks those that fail the predicate, or whose sides are both (`either`: not both real) dummies.

    If one side is empty, the other's rows pass with their marks, zeros in place of the missing columns.
    """
    joined = _side_by_side(left, right, left_order, right_order)
    a, b = F.col(left_dummy), F.col(right_dummy)
    missing = F.col("_pa").isNull() | F.col("_pb").isNull()
    tag = F.when(missing, F.coalesce(a, b)).otherwise(~predicate | (a | b if either else a & b))
    columns = [F.coalesce(F.col(n), zero_of(t)).alias(n) for n, t in left.dtypes + right.dtypes if n not in (left_dummy, right_dummy)]
    return joined.select(*columns, tag.alias(DUMMY))


def merge_by_place(a: DataFrame, b: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Two versions of one table in one order, place by place: b's row if it is real, else a's. Both carry DUMMY."""
    ordered = lambda tag: [F.col(f"{tag}{n}").asc() if up else F.col(f"{tag}{n}").desc() for n, up in order]
    x, y = (d.select(*[F.col(n).alias(f"{tag}{n}") for n in a.columns]) for d, tag in ((a, "a_"), (b, "b_")))
    takes_b = F.col("_pb").isNotNull() & (F.col("_pa").isNull() | ~F.col(f"b_{DUMMY}"))
    return _side_by_side(x, y, ordered("a_"), ordered("b_")).select(*[F.when(takes_b, F.col(f"b_{n}")).otherwise(F.col(f"a_{n}")).alias(n) for n in a.columns])


def merge_input(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two versions of one table row by row: where both have a row, b's is taken."""
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full").select(*[F.when(F.col(f"y.{key}").isNotNull(), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")).alias(c) for c in a.columns])


def aggregate(df: DataFrame, keys: list[str], functions: dict[str, tuple[str, Column | None]], bound: int = 0) -> DataFrame:
    """Groups with COUNT, SUM, AVG, MIN, MAX or COUNT_DISTINCT; rows marked as dummies don't count, groups without rows go.

    With no keys there is always one row, zeros over an empty input. `bound` raises an error if there are more groups.
    """
    ok = live(df)
    columns = []
    for name, (function, value) in functions.items():
        v = F.lit(1) if value is None else value
        v = F.when(ok, v) if DUMMY in df.columns else v
        columns.append((F.count_distinct(v) if function == "COUNT_DISTINCT" else AGGREGATES[function](v)).alias(name))
    if not keys:
        out = df.agg(*columns)
        return out.select(*[F.coalesce(F.col(n), zero_of(t)).alias(n) for n, t in out.dtypes])
    rows = F.count(F.when(ok, F.lit(1))).alias("_rows")
    out = df.groupBy(*keys).agg(*columns, rows).where("_rows > 0").drop("_rows")
    if bound and out.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} groups")
    return out


def sort_limit(df: DataFrame, order: list[tuple[str, str]], limit: int | None = None) -> DataFrame:
    """Sorted by (column, ASCENDING or DESCENDING); dummies go before a limit is taken."""
    unknown = {d for _, d in order} - {"ASCENDING", "DESCENDING"}
    if unknown:
        raise ValueError(f"unknown direction {unknown}")
    df = reveal(df) if limit is not None else df
    out = df.orderBy(*[F.col(c).asc() if d == "ASCENDING" else F.col(c).desc() for c, d in order]) if order else df
    return out if limit is None else out.limit(limit)


def shrinkwrap(df: DataFrame, bound: int) -> DataFrame:
    """Real rows only, `bound` at most; more raise an error rather than get lost."""
    out = reveal(df)
    if out.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} rows")
    return out


def resize(df: DataFrame, rows: int) -> DataFrame:
    """Padded with dummies to so many rows, which hide how many are real; more real rows than that are an error."""
    real = reveal(df)
    n = real.limit(rows + 1).count()
    if n > rows:
        raise ValueError(f"more than {rows} rows")
    zeros = df.sparkSession.range(rows - n).select(*[zero_of(t).alias(c) for c, t in real.dtypes], F.lit(True).alias(DUMMY))
    return oblivious(real).union(zeros)


def union_bag(*tables: DataFrame) -> DataFrame:
    first = [t for _, t in tables[0].dtypes]
    if any([t for _, t in x.dtypes] != first for x in tables):
        raise ValueError("tables of different types")
    return reduce(DataFrame.union, tables)


def multiple_union(a: DataFrame, b: DataFrame, by: str, ids: list, key: str) -> DataFrame:
    """For each id: a's and b's rows of it joined on the key; all results together, in one join."""
    return a.where(F.col(by).isin(ids)).join(b.where(F.col(by).isin(ids)), [by, key])
