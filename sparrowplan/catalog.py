"""The registered queries of the relational engine, and their SQL.

Money is summed as whole numbers (value x 10^6), which is exact and doesn't depend on order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowplan.functions import codecs
from sparrowplan.functions.codecs import fixed_point as fx
from sparrowplan.functions.dictionary import Dictionary
from sparrowplan.functions.expressions import column_of, equi_keys, register_function
from sparrowplan.operators import relational as R
from sparrowplan.operators.private_filter import condition
from sparrowplan.plans import planner
from sparrowplan.sources import tables
from sparrowplan.sources.tables import table
from sparrowplan.storage import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- expressions and operators of plans, in short ---


def _op(kind: str, *operands: dict) -> dict:
    return {"op": {"kind": kind}, "operands": list(operands)}


def _in(i: int) -> dict:
    return {"input": i}


def _lit(value: object, kind: str) -> dict:
    return {"literal": value, "type": {"type": kind}}


def _scan(i: str, name: str, columns: list[str], **options: object) -> dict:
    return {"id": i, "relOp": "StoredTableScan", "table": name, "columns": columns, **options}


def _plan(spark: SparkSession, d: str, *rels: dict, **options: object) -> DataFrame:
    return planner.run(spark, d, {"rels": list(rels)}, **options)


def _projected(spark: SparkSession, d: str, scan: dict, fields: dict[str, dict]) -> DataFrame:
    return _plan(spark, d, scan, {"id": "1", "relOp": "LogicalProject", "fields": list(fields), "exprs": list(fields.values())})


def money(e: str) -> str:
    return f"CAST(round(({e}) * 1000000) AS BIGINT)"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def total(value: Column) -> Column:
    return F.sum(fx(value))


def price() -> Column:
    return c("l_extendedprice") * (1 - c("l_discount"))


PRICE_SQL = "l_extendedprice * (1 - l_discount)"
CHARGE_SQL = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


# --- plans in JSON ---

Q1_PLAN = {
    "rels": [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT l_returnflag, l_linestatus, l_shipdate, {money('l_quantity')} AS qty, {money('l_extendedprice')} AS price, {money('l_discount')} AS disc, {money(PRICE_SQL)} AS disc_price, {money(CHARGE_SQL)} AS charge FROM lineitem"},
        {"id": "1", "relOp": "FheFilter", "predicates": [{"column": "l_shipdate", "type": "less_equal", "wireKey": "ship"}]},
        {"id": "2", "relOp": "FheAggregate", "group": ["l_returnflag", "l_linestatus"], "aggs": [{"agg": "SUM", "operands": [x], "name": n} for x, n in (("qty", "sum_qty"), ("price", "sum_base_price"), ("disc_price", "sum_disc_price"), ("charge", "sum_charge"), ("disc", "sum_disc"))] + [{"agg": "COUNT", "name": "count_order"}]},
        {"id": "3", "relOp": "LogicalSort", "collation": [{"field": 0, "direction": "ASCENDING"}, {"field": 1, "direction": "ASCENDING"}]},
    ]
}
Q1_SHIP = "1998-08-03"


def _q1(spark: SparkSession, d: str, oblivious: bool) -> DataFrame:
    out = planner.run(spark, d, Q1_PLAN, {"ship": Q1_SHIP}, oblivious)
    n = c("count_order").cast("double")
    return out.select("l_returnflag", "l_linestatus", "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", (c("sum_qty") / 1e6 / n).alias("avg_qty"), (c("sum_base_price") / 1e6 / n).alias("avg_price"), (c("sum_disc") / 1e6 / n).alias("avg_disc"), "count_order")


Q1_SQL = f"""
SELECT l_returnflag, l_linestatus, {big(f"sum({money('l_quantity')})")} AS sum_qty, {big(f"sum({money('l_extendedprice')})")} AS sum_base_price,
       {big(f"sum({money(PRICE_SQL)})")} AS sum_disc_price, {big(f"sum({money(CHARGE_SQL)})")} AS sum_charge,
       CAST(sum({money('l_quantity')}) AS DOUBLE) / 1e6 / count(*) AS avg_qty, CAST(sum({money('l_extendedprice')}) AS DOUBLE) / 1e6 / count(*) AS avg_price,
       CAST(sum({money('l_discount')}) AS DOUBLE) / 1e6 / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '{Q1_SHIP}' GROUP BY 1, 2"""


@query(Q1_SQL)
def q1_pricing(spark: SparkSession, d: str) -> DataFrame:
    return _q1(spark, d, False)


@query(Q1_SQL)
def oblivious_q1(spark: SparkSession, d: str) -> DataFrame:
    return _q1(spark, d, True)


@query(f"SELECT l_returnflag, l_linestatus, {big(f'''sum({money('l_quantity')})''')} AS sum_qty FROM lineitem WHERE l_shipdate <= DATE '{Q1_SHIP}' GROUP BY 1, 2")
def q1_one_sum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").where(c("l_shipdate") <= lit(Q1_SHIP)).groupBy("l_returnflag", "l_linestatus").agg(total(c("l_quantity")).alias("sum_qty"))


Q6_PLAN = {
    "rels": [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT l_shipdate, l_discount, l_quantity, {money('l_extendedprice * l_discount')} AS revenue FROM lineitem"},
        {"id": "1", "relOp": "FheFilter", "predicates": [{"column": "l_shipdate", "type": "greater_equal", "wireKey": "from"}, {"column": "l_shipdate", "type": "less_than", "wireKey": "to"}, {"column": "l_discount", "type": "greater_equal", "wireKey": "low"}, {"column": "l_discount", "type": "less_equal", "wireKey": "high"}, {"column": "l_quantity", "type": "less_than", "wireKey": "quantity"}]},
        {"id": "2", "relOp": "FheAggregate", "aggs": [{"agg": "SUM", "operands": ["revenue"], "name": "revenue"}]},
    ]
}
Q6_CONSTANTS = {"from": "1997-01-01", "to": "1998-01-01", "low": 0.02, "high": 0.04, "quantity": 24.0}
Q6_SQL = f"SELECT {big(f'''coalesce(sum({money('l_extendedprice * l_discount')}), 0)''')} AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount >= 0.02::DOUBLE AND l_discount <= 0.04::DOUBLE AND l_quantity < 24"


@query(Q6_SQL)
def q6_forecast(spark: SparkSession, d: str) -> DataFrame:
    return planner.run(spark, d, Q6_PLAN, Q6_CONSTANTS)


@query(Q6_SQL)
def oblivious_q6(spark: SparkSession, d: str) -> DataFrame:
    return planner.run(spark, d, Q6_PLAN, Q6_CONSTANTS, oblivious=True)


# --- queries of the TPC-H shape ---


@query(f"""SELECT l_orderkey, {big(f'sum({money(PRICE_SQL)})')} AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'HOUSEHOLD' AND o_orderdate < DATE '1995-03-25' AND l_shipdate > DATE '1995-03-25' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q3_top10(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer").where(c("c_mktsegment") == "HOUSEHOLD")
    orders = table(spark, d, "orders").where(c("o_orderdate") < lit("1995-03-25"))
    lines = table(spark, d, "lineitem").where(c("l_shipdate") > lit("1995-03-25"))
    joined = R.keyed_join(R.keyed_join(lines, orders, [("l_orderkey", "o_orderkey")]), customer, [("o_custkey", "c_custkey")])
    return joined.groupBy("l_orderkey", "o_orderdate").agg(total(price()).alias("revenue")).orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("SELECT o_orderpriority, count(*) AS order_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND l_shipdate > o_orderdate GROUP BY 1")
def q4_priority(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where((c("o_orderdate") >= lit("1996-07-01")) & (c("o_orderdate") < lit("1996-10-01")))
    return R.keyed_join(table(spark, d, "lineitem"), orders, [("l_orderkey", "o_orderkey")]).where("l_shipdate > o_orderdate").groupBy("o_orderpriority").agg(F.count("*").alias("order_count"))


@query(f"""SELECT n_name, {big(f'sum({money(PRICE_SQL)})')} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""")
def q5_local_revenue(spark: SparkSession, d: str) -> DataFrame:
    nation = R.keyed_join(table(spark, d, "nation"), table(spark, d, "region").where("r_name = 'EUROPE'"), [("n_regionkey", "r_regionkey")])
    supplier = R.keyed_join(table(spark, d, "supplier"), nation, [("s_nationkey", "n_nationkey")])
    orders = table(spark, d, "orders").where((c("o_orderdate") >= lit("1996-01-01")) & (c("o_orderdate") < lit("1997-01-01")))
    lines = R.keyed_join(R.keyed_join(table(spark, d, "lineitem"), orders, [("l_orderkey", "o_orderkey")]), supplier, [("l_suppkey", "s_suppkey")])
    return R.keyed_join(lines, table(spark, d, "customer"), [("o_custkey", "c_custkey"), ("s_nationkey", "c_nationkey")]).groupBy("n_name").agg(total(price()).alias("revenue")).orderBy(F.desc("revenue"))


def _nations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    supplier = table(spark, d, "supplier").join(n.select(c("n_nationkey").alias("s_nationkey"), c("n_name").alias("supp_nation")), "s_nationkey")
    customer = table(spark, d, "customer").join(n.select(c("n_nationkey").alias("c_nationkey"), c("n_name").alias("cust_nation"), "n_regionkey"), "c_nationkey")
    lines = R.keyed_join(table(spark, d, "lineitem"), supplier, [("l_suppkey", "s_suppkey")])
    return R.keyed_join(R.keyed_join(lines, table(spark, d, "orders"), [("l_orderkey", "o_orderkey")]), customer, [("o_custkey", "c_custkey")])


_NATIONS = "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey"


@query(f"SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, {big(f'sum({money(PRICE_SQL)})')} AS revenue FROM {_NATIONS} WHERE n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_4' AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1, 2, 3")
def q7_nation_pair(spark: SparkSession, d: str) -> DataFrame:
    rows = _nations(spark, d).where("supp_nation = 'NATION_1' and cust_nation = 'NATION_4'").where(c("l_shipdate").between(lit("1996-01-01"), lit("1997-12-31")))
    return rows.groupBy("supp_nation", "cust_nation", F.year("l_shipdate").alias("l_year")).agg(total(price()).alias("revenue"))


_Q8 = f"FROM {_NATIONS} JOIN part ON l_partkey = p_partkey JOIN region ON n2.n_regionkey = r_regionkey WHERE r_name = 'AFRICA' AND p_type = 'LARGE' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"


def _q8(spark: SparkSession, d: str) -> DataFrame:
    """The filtered parts and the customers of the region come first, so that few lines meet orders and suppliers."""
    n = table(spark, d, "nation")
    lines = R.keyed_join(table(spark, d, "lineitem"), table(spark, d, "part").where("p_type = 'LARGE'"), [("l_partkey", "p_partkey")])
    orders = table(spark, d, "orders").where(c("o_orderdate").between(lit("1996-01-01"), lit("1997-12-31")))
    here = R.keyed_join(n, table(spark, d, "region").where("r_name = 'AFRICA'"), [("n_regionkey", "r_regionkey")]).select(c("n_nationkey").alias("here"))
    customer = R.keyed_join(table(spark, d, "customer"), here, [("c_nationkey", "here")])
    supplier = R.keyed_join(table(spark, d, "supplier"), n.select("n_nationkey", c("n_name").alias("supp_nation")), [("s_nationkey", "n_nationkey")])
    rows = R.keyed_join(lines, R.keyed_join(orders, customer, [("o_custkey", "c_custkey")]), [("l_orderkey", "o_orderkey")])
    rows = R.keyed_join(rows, supplier, [("l_suppkey", "s_suppkey")])
    return rows.withColumns({"o_year": F.year("o_orderdate"), "volume": fx(price())})


@query(f"SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, {big(f'sum({money(PRICE_SQL)})')} AS volume {_Q8} GROUP BY 1")
def q8_volume(spark: SparkSession, d: str) -> DataFrame:
    return _q8(spark, d).groupBy("o_year").agg(F.sum("volume").alias("volume"))


@query(f"SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, CAST(sum(CASE WHEN n1.n_name = 'NATION_1' THEN {money(PRICE_SQL)} ELSE 0 END) AS DOUBLE) / CAST(sum({money(PRICE_SQL)}) AS DOUBLE) AS mkt_share {_Q8} GROUP BY 1")
def q8_mkt_share(spark: SparkSession, d: str) -> DataFrame:
    own = F.sum(F.when(c("supp_nation") == "NATION_1", c("volume")).otherwise(0)).cast("double")
    return _q8(spark, d).groupBy("o_year").agg((own / F.sum("volume").cast("double")).alias("mkt_share"))


@query(f"""SELECT c_custkey, c_name, {big(f'sum({money(PRICE_SQL)})')} AS revenue, {money('c_acctbal')} AS acctbal, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '1996-03-01' AND o_orderdate < DATE '1996-06-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
def q10_returns(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where((c("o_orderdate") >= lit("1996-03-01")) & (c("o_orderdate") < lit("1996-06-01")))
    rows = R.keyed_join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), orders, [("l_orderkey", "o_orderkey")])
    rows = R.keyed_join(R.keyed_join(rows, table(spark, d, "customer"), [("o_custkey", "c_custkey")]), table(spark, d, "nation"), [("c_nationkey", "n_nationkey")])
    return rows.groupBy("c_custkey", "c_name", fx(c("c_acctbal")).alias("acctbal"), "n_name").agg(total(price()).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(20)


@query("""SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1""")
def q12_modes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where(condition([{"column": "l_returnflag", "type": "in"}, {"column": "l_shipdate", "type": "greater_equal", "value": "1996-01-01"}, {"column": "l_shipdate", "type": "less_than", "value": "1997-01-01"}], constants={"l_returnflag": ["A", "R"]}))
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return R.keyed_join(rows, table(spark, d, "orders"), [("l_orderkey", "o_orderkey")]).groupBy("l_returnflag").agg(F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(high, 0).otherwise(1)).alias("low_line_count"))


@query("SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) GROUP BY 1")
def q13_custdist(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("c_count"))
    return table(spark, d, "customer").join(counts, c("c_custkey") == c("o_custkey"), "left").groupBy(F.coalesce("c_count", lit(0)).alias("c_count")).agg(F.count("*").alias("custdist"))


@query(f"SELECT {big(f'''sum(CASE WHEN p_type LIKE 'PROMO%' THEN {money(PRICE_SQL)} ELSE 0 END)''')} AS promo, {big(f'sum({money(PRICE_SQL)})')} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-08-01' AND l_shipdate < DATE '1996-09-01'")
def q14_promo(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").where((c("l_shipdate") >= lit("1996-08-01")) & (c("l_shipdate") < lit("1996-09-01")))
    return R.keyed_join(rows, table(spark, d, "part"), [("l_partkey", "p_partkey")]).agg(F.sum(F.when(c("p_type").like("PROMO%"), fx(price())).otherwise(0)).alias("promo"), total(price()).alias("revenue"))


@query(f"WITH r AS (SELECT l_suppkey, {big(f'sum({money(PRICE_SQL)})')} AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1996-05-01' AND l_shipdate < DATE '1996-08-01' GROUP BY 1) SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM r)")
def q15_top_supplier(spark: SparkSession, d: str) -> DataFrame:
    revenue = table(spark, d, "lineitem").where((c("l_shipdate") >= lit("1996-05-01")) & (c("l_shipdate") < lit("1996-08-01"))).groupBy("l_suppkey").agg(total(price()).alias("total_revenue"))
    best = revenue.where(c("total_revenue") == revenue.agg(F.max("total_revenue")).scalar())
    return table(spark, d, "supplier").join(best, c("s_suppkey") == c("l_suppkey")).select("s_suppkey", "s_name", "total_revenue")


@query(f"SELECT o_orderkey, c_custkey, {money('o_totalprice')} AS totalprice, {big(f'''sum({money('l_quantity')})''')} AS quantity FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250) GROUP BY o_orderkey, c_custkey, o_totalprice")
def q18_large_orders(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "lineitem").groupBy("l_orderkey").agg(total(c("l_quantity")).alias("quantity")).where(c("quantity") > 250 * codecs.SCALE)
    orders = R.keyed_join(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey")])
    return orders.join(large, c("o_orderkey") == c("l_orderkey")).select("o_orderkey", "c_custkey", fx(c("o_totalprice")).alias("totalprice"), "quantity")


_GROUPS = [("Brand#11", ["SMALL", "MEDIUM"], 2.0, 12.0, 15), ("Brand#13", ["LARGE", "PROMO"], 14.0, 24.0, 30), ("Brand#25", ["ECONOMY", "STANDARD"], 23.0, 33.0, 45)]
_Q19 = " OR ".join(f"(p_brand = '{b}' AND p_type IN ({', '.join(repr(t) for t in ts)}) AND l_quantity >= {lo} AND l_quantity <= {hi} AND p_size <= {s})" for b, ts, lo, hi, s in _GROUPS)


@query(f"SELECT {big(f'coalesce(sum({money(PRICE_SQL)}), 0)')} AS revenue, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F') AND p_size >= 1 AND ({_Q19})")
def q19_dnf(spark: SparkSession, d: str) -> DataFrame:
    groups = [[{"column": "p_brand", "type": "equal", "value": b}, {"column": "p_type", "type": "in", "value": ts}, {"column": "l_quantity", "type": "greater_equal", "value": lo}, {"column": "l_quantity", "type": "less_equal", "value": hi}, {"column": "p_size", "type": "less_equal", "value": s}] for b, ts, lo, hi, s in _GROUPS]
    common = [{"column": "l_returnflag", "type": "equal", "value": "R"}, {"column": "l_linestatus", "type": "in", "value": ["O", "F"]}, {"column": "p_size", "type": "greater_equal", "value": 1}]
    rows = R.keyed_join(table(spark, d, "lineitem"), table(spark, d, "part"), [("l_partkey", "p_partkey")]).where(condition(common, groups))
    return R.aggregate(rows.withColumn("r", fx(price())), [], {"revenue": ("SUM", c("r")), "n": ("COUNT", None)})


@query(f"""SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, {big(f'sum({money(PRICE_SQL)} - {money("l_quantity * p_retailprice / 100")})')} AS profit FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey JOIN orders ON l_orderkey = o_orderkey WHERE p_type LIKE '%ARD%' GROUP BY 1, 2""")
def q9_profit(spark: SparkSession, d: str) -> DataFrame:
    """A hundredth of the retail price stands in for the supply cost."""
    lines = R.keyed_join(table(spark, d, "lineitem"), table(spark, d, "part").where(c("p_type").like("%ARD%")), [("l_partkey", "p_partkey")])
    supplier = R.keyed_join(table(spark, d, "supplier"), table(spark, d, "nation"), [("s_nationkey", "n_nationkey")])
    rows = R.keyed_join(R.keyed_join(lines, supplier, [("l_suppkey", "s_suppkey")]), table(spark, d, "orders"), [("l_orderkey", "o_orderkey")])
    return rows.groupBy("n_name", F.year("o_orderdate").alias("o_year")).agg(F.sum(fx(price()) - fx(c("l_quantity") * c("p_retailprice") / 100)).alias("profit"))


@query("SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#11' AND p_size IN (3, 9, 14, 23, 36, 45, 49) GROUP BY 1, 2, 3")
def q16_suppliers(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").where((c("p_brand") != "Brand#11") & c("p_size").isin(3, 9, 14, 23, 36, 45, 49))
    return R.aggregate(R.keyed_join(table(spark, d, "lineitem"), part, [("l_partkey", "p_partkey")]), ["p_brand", "p_type", "p_size"], {"suppliers": ("COUNT_DISTINCT", c("l_suppkey"))})


@query(f"""WITH t AS (SELECT l_partkey AS k, sum({money('l_quantity')}) AS q, count(*) AS n FROM lineitem GROUP BY 1)
SELECT {big(f"coalesce(sum({money('l_extendedprice')}), 0)")} AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN t ON k = l_partkey WHERE p_brand = 'Brand#13' AND {money('l_quantity')} * 5 * n < q""")
def q17_small_orders(spark: SparkSession, d: str) -> DataFrame:
    """The average of a part's quantities is kept as a sum and a count, so that the comparison is exact."""
    part = table(spark, d, "part").where("p_brand = 'Brand#13'").select("p_partkey")
    lines = R.keyed_join(table(spark, d, "lineitem"), part, [("l_partkey", "p_partkey")]).select("l_partkey", fx(c("l_quantity")).alias("q"), fx(c("l_extendedprice")).alias("p"))
    mean = lines.groupBy("l_partkey").agg(F.sum("q").alias("s"), F.count("*").alias("n"))
    return R.aggregate(lines.join(mean, "l_partkey").where(c("q") * 5 * c("n") < c("s")), [], {"price": ("SUM", c("p"))})


# --- scans ---


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def scan_limit(spark: SparkSession, d: str) -> DataFrame:
    leaf = {"id": "0", "relOp": "LogicalValues", "sql": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey", "input-limit": 25}
    return _plan(spark, d, leaf)


@query("SELECT p_partkey, p_brand FROM part")
def scan_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", ["p_partkey", "p_brand"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_sql_leaf(spark: SparkSession, d: str) -> DataFrame:
    return tables.sql_leaf(spark, d, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


@query("SELECT o_orderkey, o_custkey FROM orders")
def shares_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return tables.recombined(*tables.xor_shares(table(spark, d, "orders", ["o_orderkey", "o_custkey"]), ["o_orderkey", "o_custkey"]), ["o_orderkey", "o_custkey"])


_DRAW = lambda i: f"(((id + {3 * 7919 + i * 104_729 + 1}) % 2147483647) * 48271 % 2147483647) * 69621 % 2147483647 * 16807 % 2147483647"


@query(f"SELECT id, CAST(18 + ({_DRAW(1)}) % 73 AS BIGINT) AS age, CASE ({_DRAW(2)}) % 2 WHEN 0 THEN 'F' ELSE 'M' END AS sex FROM (SELECT CAST(range AS BIGINT) AS id FROM range(1000))")
def synthetic_table(spark: SparkSession, d: str) -> DataFrame:
    return tables.synthetic(spark, {"rows": 1000, "seed": 3, "fields": {"id": "key", "age": {"range": [18, 90]}, "sex": {"values": ["F", "M"]}}})


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    tables.write_csv(table(spark, d, "supplier", ["s_suppkey", "s_name", "s_acctbal"]), path)
    return tables.read_csv(spark, path, tables.parse_schema("(supplier.s_suppkey:long, s_name:varchar(25), s_acctbal:float)"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def csv_dates(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "csv")
    tables.write_csv(table(spark, d, "orders", ["o_orderkey", "o_orderdate"]), path)
    return tables.read_csv(spark, path, tables.parse_schema("(o_orderkey:int64, o_orderdate:date)"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def saved_table(spark: SparkSession, d: str) -> DataFrame:
    """A table saved with its schema, rows added to it, read back."""
    path = _folder(spark, "saved")
    tables.save_table(table(spark, d, "nation", ["n_nationkey", "n_name"]), path)
    tables.insert_table(table(spark, d, "nation").where("n_regionkey = 1").select((c("n_nationkey") + 100).alias("n_nationkey"), "n_name"), path)
    return tables.load_table(spark, path)


@query("SELECT s_suppkey, s_nationkey FROM supplier")
def jdbc_scan(spark: SparkSession, d: str) -> DataFrame:
    """A database read in parts; the embedded one of the Java library stands in for a server."""
    supplier = table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    url = tables.embedded_database(supplier, "SUPPLIER", _folder(spark, "jdbc"))
    low, high = supplier.agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    split = None if low is None else ("K", low, high + 1, 4)
    out = tables.jdbc(spark, url, 'SELECT "s_suppkey" AS k, "s_nationkey" AS n FROM SUPPLIER', split, **tables.EMBEDDED)
    return out.select(c("K").alias("s_suppkey"), c("N").alias("s_nationkey"))


@query("SELECT p_size, p_partkey FROM part")
def scan_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, {"id": "0", "relOp": "VaultDBTableScan", "table": "part", "columns": [4, 0]})


_PARTIES = "SELECT n_regionkey, count(*) AS n FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) GROUP BY 1"


@query(f"SELECT r.n_regionkey, r.n, p.n AS own FROM ({_PARTIES}) r JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) p USING (n_regionkey)")
def plan_parties(spark: SparkSession, d: str) -> DataFrame:
    """A leaf without a party reads all parties' tables, one with a party only its own."""
    sql = "SELECT n_regionkey, n_name FROM nation"
    count = lambda i, of: {"id": i, "relOp": "LogicalAggregate", "inputs": [of], "group": [0], "aggs": [{"agg": {"kind": "COUNT"}, "operands": [], "name": "n"}]}
    join = {"id": "4", "relOp": "LogicalJoin", "inputs": ["2", "3"], "condition": _op("EQUALS", _in(0), _in(2)), "fields": ["n_regionkey", "n", "again", "own"]}
    leaves = [{"id": "0", "relOp": "LogicalValues", "sql": sql}, {"id": "1", "relOp": "LogicalValues", "sql": sql, "party": 2}]
    return _plan(spark, d, *leaves, count("2", "0"), count("3", "1"), join, parties={1: d, 2: d}).drop("again")


@query("SELECT CAST(i AS INTEGER) AS i, CASE WHEN i < 5 THEN FALSE ELSE TRUE END AS dummy FROM range(12) t(i)")
def dummy_padding(spark: SparkSession, d: str) -> DataFrame:
    out = R.resize(R.filter_rows(R.oblivious(table(spark, d, "nation")), c("n_nationkey") < 5), 12)
    return out.select((F.row_number().over(Window.orderBy(R.DUMMY, "n_nationkey")) - 1).alias("i"), c(R.DUMMY).alias("dummy"))


# --- filters and scalar expressions ---


def _expression_query(name: str, kind: str, sign: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = {"op": {"kind": kind}, "operands": [{"input": 1}, {"literal": 25.0, "type": {"type": "FLOAT"}}]}
        df = table(spark, d, "lineitem", ["l_orderkey", "l_quantity"])
        return R.filter_rows(df, column_of(e, [c(x) for x in df.columns])).groupBy(lit(1).alias("g")).agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))

    QUERIES[name] = run
    SQL[name] = f"SELECT CAST(1 AS INTEGER) AS g, count(*) AS n, {big('sum(l_orderkey)')} AS keys FROM lineitem WHERE l_quantity {sign} 25.0"


for _n, _k, _s in (("eq", "EQUALS", "="), ("ne", "NOT_EQUALS", "<>"), ("lt", "LESS_THAN", "<"), ("le", "LESS_THAN_OR_EQUAL", "<="), ("gt", "GREATER_THAN", ">"), ("ge", "GREATER_THAN_OR_EQUAL", ">=")):
    _expression_query(f"filter_cmp_{_n}", _k, _s)


@query("SELECT p_partkey FROM part WHERE (p_size > 10 AND p_brand = 'Brand#11') OR NOT p_size < 45")
def filter_and_or_not(spark: SparkSession, d: str) -> DataFrame:
    both = _op("AND", _op("GREATER_THAN", _in(1), _lit(10, "INTEGER")), _op("EQUALS", _in(2), _lit("Brand#11", "VARCHAR")))
    condition = _op("OR", both, _op("NOT", _op("LESS_THAN", _in(1), _lit(45, "INTEGER"))))
    return _plan(spark, d, _scan("0", "part", ["p_partkey", "p_size", "p_brand"]), {"id": "1", "relOp": "LogicalFilter", "condition": condition}, {"id": "2", "relOp": "FheProject", "ordinals": [0]})


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%AR%'")
def filter_like(spark: SparkSession, d: str) -> DataFrame:
    scan = _scan("0", "part", ["p_partkey", "p_type"])
    return _plan(spark, d, scan, {"id": "1", "relOp": "LogicalFilter", "condition": _op("LIKE", _in(1), _lit("%AR%", "VARCHAR"))}, {"id": "2", "relOp": "FheProject", "fields": ["p_partkey"]})


@query("SELECT n_nationkey FROM nation")
def filter_no_op(spark: SparkSession, d: str) -> DataFrame:
    return _plan(spark, d, _scan("0", "nation", ["n_nationkey"]), {"id": "1", "relOp": "LogicalFilter", "condition": _op("NO-OP")})


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#7') AND p_size <= 20")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", ["p_partkey", "p_brand", "p_size"]).where(condition([{"column": "p_brand", "type": "in", "value": ["Brand#1", "Brand#7"]}, {"column": "p_size", "type": "less_equal", "value": 20}])).select("p_partkey", "p_brand")


@query(f"SELECT l_orderkey, l_linenumber, {money('l_extendedprice + l_tax')} AS plus, {money('l_extendedprice - l_tax')} AS minus, {money('l_quantity * l_tax')} AS times FROM lineitem")
def project_math(spark: SparkSession, d: str) -> DataFrame:
    scan = _scan("0", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_quantity"])
    out = _projected(spark, d, scan, {"l_orderkey": _in(0), "l_linenumber": _in(1), "plus": _op("PLUS", _in(2), _in(3)), "minus": _op("MINUS", _in(2), _in(3)), "times": _op("TIMES", _in(4), _in(3))})
    return out.select("l_orderkey", "l_linenumber", *[fx(c(x)).alias(x) for x in ("plus", "minus", "times")])


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size FROM part")
def project_case(spark: SparkSession, d: str) -> DataFrame:
    case = _op("CASE", _op("GREATER_THAN", _in(1), _lit(25, "INTEGER")), _lit("big", "VARCHAR"), _lit("small", "VARCHAR"))
    return _projected(spark, d, _scan("0", "part", ["p_partkey", "p_size"]), {"p_partkey": _in(0), "size": case})


@query("SELECT p_partkey, CAST(p_partkey AS INTEGER) AS i, CAST(p_size AS BIGINT) AS l, CAST(p_size AS DOUBLE) AS f FROM part")
def project_cast(spark: SparkSession, d: str) -> DataFrame:
    cast = lambda i, kind: {**_op("CAST", _in(i)), "type": {"type": kind}}
    return _projected(spark, d, _scan("0", "part", ["p_partkey", "p_size"]), {"p_partkey": _in(0), "i": cast(0, "INTEGER"), "l": cast(1, "LONG"), "f": cast(1, "FLOAT")})


_BIG = 9007199254740993  # beyond what a double holds


@query(f"""SELECT p_partkey, CASE WHEN p_size = 10 THEN 0 ELSE CAST(p_partkey // (p_size - 10) AS BIGINT) END AS q, CASE WHEN p_size = 10 THEN 0.0::DOUBLE ELSE CAST(p_partkey AS DOUBLE) / (p_size - 10) END AS f,
CASE WHEN p_size = 10 THEN 0 ELSE CAST((p_partkey + {_BIG}) // (p_size - 10) AS BIGINT) END AS big, CAST(p_partkey // 2 AS BIGINT) AS whole FROM part""")
def project_div_zero(spark: SparkSession, d: str) -> DataFrame:
    """DIV, DIVIDE of a fraction, DIV beyond 53 bits, and DIVIDE of whole numbers, which is whole."""
    size, big_key = _op("MINUS", _in(1), _lit(10, "INTEGER")), _op("PLUS", _in(0), _lit(_BIG, "LONG"))
    fields = {"p_partkey": _in(0), "q": _op("DIV", _in(0), size), "f": _op("DIVIDE", {**_op("CAST", _in(0)), "type": {"type": "FLOAT"}}, size), "big": _op("DIV", big_key, size), "whole": _op("DIVIDE", _in(0), _lit(2, "LONG"))}
    return _projected(spark, d, _scan("0", "part", ["p_partkey", "p_size"]), fields)


@query("SELECT p_partkey, CAST(p_partkey % 7 AS BIGINT) AS m FROM part")
def project_mod(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, _scan("0", "part", ["p_partkey"]), {"p_partkey": _in(0), "m": _op("MODULUS", _in(0), _lit(7, "LONG"))})


@query("SELECT p_partkey, xor(p_partkey, 12345) AS x FROM part")
def project_xor(spark: SparkSession, d: str) -> DataFrame:
    return _projected(spark, d, _scan("0", "part", ["p_partkey"]), {"p_partkey": _in(0), "x": _op("XOR", _in(0), _lit(12345, "LONG"))})


@query("SELECT p_partkey, upper(p_name) AS name, CAST(abs(p_size - 25) AS INTEGER) AS off FROM part")
def project_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions registered by name."""
    register_function("UPPER_CASE", F.upper)
    register_function("DISTANCE", lambda a, b: F.abs(a - b))
    return _projected(spark, d, _scan("0", "part", ["p_partkey", "p_name", "p_size"]), {"p_partkey": _in(0), "name": _op("UPPER_CASE", _in(1)), "off": _op("DISTANCE", _in(2), _lit(25, "INTEGER"))})


# --- joins ---


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
def join_basic_theta(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    a, b = n.select(c("n_nationkey").alias("a"), c("n_regionkey").alias("ra")), n.select(c("n_nationkey").alias("b"), c("n_regionkey").alias("rb"))
    return R.basic_join(a, b, (c("a") < c("b")) & (c("ra") == c("rb"))).select("a", "b")


@query("SELECT r_name, n_name FROM region, nation")
def join_cartesian(spark: SparkSession, d: str) -> DataFrame:
    return R.basic_join(table(spark, d, "region"), table(spark, d, "nation"), None).select("r_name", "n_name")


_KEYED = "SELECT l_orderkey, l_linenumber, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("l_orderkey", "l_linenumber", "o_custkey").agg(F.count("*").alias("n"))


@query(_KEYED)
def join_keyed_fk_left(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(R.keyed_join(table(spark, d, "lineitem"), table(spark, d, "orders"), [("l_orderkey", "o_orderkey")], check=True))


@query(_KEYED)
def join_keyed_fk_right(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(_orders_and_lines(spark, d, "hash-join", **{"foreign-key": 1}))


def _orders_and_lines(spark: SparkSession, d: str, algorithm: str, **options: object) -> DataFrame:
    scans = [_scan("0", "orders", ["o_orderkey", "o_custkey"]), _scan("1", "lineitem", ["l_orderkey", "l_linenumber"])]
    return _plan(spark, d, *scans, {"id": "2", "relOp": "LogicalJoin", "inputs": ["0", "1"], "condition": _op("EQUALS", _in(0), _in(2)), "operator-algorithm": algorithm, **options}, check="foreign-key" in options)


@query(_KEYED)
def join_cost_smj(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(_orders_and_lines(spark, d, "cost-keyed-sort-merge-join"))


@query(_KEYED)
def join_block_nested_loop(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(_orders_and_lines(spark, d, "block-nested-loop-join"))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def join_many_to_many(spark: SparkSession, d: str) -> DataFrame:
    scans = [_scan("0", "customer", ["c_custkey", "c_nationkey"]), _scan("1", "supplier", ["s_suppkey", "s_nationkey"])]
    join = {"id": "2", "relOp": "LogicalJoin", "inputs": ["0", "1"], "condition": _op("EQUALS", _in(1), _in(3)), "operator-algorithm": "sort-merge-join"}
    return _plan(spark, d, *scans, join, {"id": "3", "relOp": "FheProject", "fields": [{"ordinal": 0}, {"ordinal": 2}]})


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_acctbal < c_acctbal")
def join_equi_keys(spark: SparkSession, d: str) -> DataFrame:
    """The keys that a condition names are found in it; the rest is a filter on the joined rows."""
    a, b = table(spark, d, "customer", ["c_custkey", "c_nationkey", "c_acctbal"]), table(spark, d, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    on = _op("AND", _op("EQUALS", _in(1), _in(4)), _op("LESS_THAN", _in(5), _in(2)))
    joined = R.keyed_join(a, b, [(a.columns[x], b.columns[y]) for x, y in equi_keys(on, 3)])
    return R.filter_rows(joined, column_of(on, [c(x) for x in joined.columns])).select("c_custkey", "s_suppkey")


@query(_KEYED)
def join_smj_hint(spark: SparkSession, d: str) -> DataFrame:
    return _keyed(R.keyed_join(table(spark, d, "lineitem"), table(spark, d, "orders"), [("l_orderkey", "o_orderkey")], "keyed-sort-merge-join"))


@query("SELECT o_orderkey, coalesce(l_linenumber, 0) AS l_linenumber, coalesce(l_returnflag, '') AS l_returnflag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_left_zero(spark: SparkSession, d: str) -> DataFrame:
    return R.left_zero_join(table(spark, d, "orders"), table(spark, d, "lineitem"), [("o_orderkey", "l_orderkey")]).select("o_orderkey", "l_linenumber", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber, CAST(year(o_orderdate) AS INTEGER) AS o_orderyear FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def join_column_keyed(spark: SparkSession, d: str) -> DataFrame:
    pk = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("o_orderyear"))
    return R.keyed_join(table(spark, d, "lineitem", ["l_orderkey", "l_linenumber"]), pk, [("l_orderkey", "o_orderkey")], drop_key=True)


@query("WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS p FROM orders) SELECT c_custkey, o_orderkey FROM a JOIN b USING (p) WHERE c_custkey < o_orderkey + 1000")
def join_merge_positional(spark: SparkSession, d: str) -> DataFrame:
    return R.merge_join(table(spark, d, "customer", ["c_custkey"]), table(spark, d, "orders", ["o_orderkey"]), [c("c_custkey")], [c("o_orderkey")], c("c_custkey") < c("o_orderkey") + 1000)


# --- aggregates ---


@query(f"SELECT count(*) AS n, {big(f'''sum({money('l_quantity')})''')} AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_quantity) AS a FROM lineitem")
def agg_scalar(spark: SparkSession, d: str) -> DataFrame:
    q = c("l_quantity")
    return R.aggregate(table(spark, d, "lineitem"), [], {"n": ("COUNT", None), "s": ("SUM", fx(q)), "lo": ("MIN", q), "hi": ("MAX", q), "a": ("AVG", q)})


@query(f"SELECT l_returnflag, count(*) AS n, {big(f'''sum({money('l_tax')})''')} AS s, min(l_shipdate)::DATE AS lo, max(l_quantity) AS hi, CAST(sum({money('l_tax')}) AS DOUBLE) / count(*) AS a FROM lineitem GROUP BY 1")
def agg_group_all(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], {"n": ("COUNT", None), "s": ("SUM", fx(c("l_tax"))), "lo": ("MIN", c("l_shipdate")), "hi": ("MAX", c("l_quantity")), "a": ("AVG", fx(c("l_tax")))})


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], {"suppliers": ("COUNT_DISTINCT", c("l_suppkey"))})


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def agg_bound(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(table(spark, d, "customer"), ["c_mktsegment"], {"n": ("COUNT", None)}, bound=10)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_quantity < 3 AND l_returnflag = 'A' GROUP BY 1, 2")
def agg_empty_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = R.filter_rows(R.oblivious(table(spark, d, "lineitem")), (c("l_quantity") < 3) & (c("l_returnflag") == "A"))
    return R.aggregate(rows, ["l_returnflag", "l_linestatus"], {"n": ("COUNT", None)})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(spark: SparkSession, d: str) -> DataFrame:
    rels = [_scan("0", "orders", ["o_custkey"]), {"id": "1", "relOp": "LogicalAggregate", "group": [0], "aggs": [{"agg": {"kind": "COUNT"}, "distinct": False, "operands": [], "name": "n"}]}]
    return _plan(spark, d, *rels, {"id": "2", "relOp": "LogicalFilter", "condition": _op("GREATER_THAN", _in(1), _lit(12, "LONG"))})


@query("SELECT l_returnflag, CAST(sum(9223372036854775807::HUGEINT - l_orderkey) AS VARCHAR) AS s FROM lineitem GROUP BY 1")
def agg_large_sums(spark: SparkSession, d: str) -> DataFrame:
    """Sums beyond 64 bits, in decimals."""
    value = (lit((1 << 63) - 1) - c("l_orderkey")).cast("decimal(38,0)")
    out = R.aggregate(table(spark, d, "lineitem"), ["l_returnflag"], {"s": ("SUM", value)})
    return out.select("l_returnflag", c("s").cast("string").alias("s"))


@query("SELECT c_mktsegment, CAST(sum(c_nationkey) // count(*) AS BIGINT) AS a FROM customer GROUP BY 1")
def agg_typed_avg(spark: SparkSession, d: str) -> DataFrame:
    """The average of whole numbers is whole: a sum divided by a count."""
    aggregate = {"id": "1", "relOp": "FheAggregate", "groupBy": [0], "aggregates": [{"type": "SUM", "ordinal": 1, "alias": "s"}, {"type": "COUNT", "alias": "n"}]}
    rels = [_scan("0", "customer", ["c_mktsegment", "c_nationkey"]), aggregate, {"id": "2", "relOp": "LogicalProject", "fields": ["c_mktsegment", "a"], "exprs": [_in(0), _op("DIVIDE", _in(1), _in(2))]}]
    return _plan(spark, d, *rels)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def plan_card_bound(spark: SparkSession, d: str) -> DataFrame:
    aggregate = {"id": "1", "relOp": "LogicalAggregate", "operator-algorithm": "nested-loop-aggregate", "cardBound": 10, "group": [0], "aggs": [{"agg": {"kind": "COUNT"}, "operands": [], "name": "n"}]}
    return _plan(spark, d, _scan("0", "customer", ["c_mktsegment"]), aggregate)


# --- sorts, sets, codecs ---


@query("SELECT s_suppkey, s_nationkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey DESC) AS place FROM supplier")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return R.positional(table(spark, d, "supplier", ["s_suppkey", "s_nationkey"]), [c("s_nationkey").asc(), c("s_suppkey").desc()], "place")


@query(f"SELECT o_orderkey, {money('o_totalprice')} AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return R.sort_limit(table(spark, d, "orders"), [("o_totalprice", "DESCENDING"), ("o_orderkey", "ASCENDING")], 15).select("o_orderkey", fx(c("o_totalprice")).alias("price"))


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def shrinkwrap(spark: SparkSession, d: str) -> DataFrame:
    return R.shrinkwrap(R.filter_rows(R.oblivious(table(spark, d, "nation")), c("n_regionkey") == 2), 10).select("n_nationkey")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bag(spark: SparkSession, d: str) -> DataFrame:
    return R.union_bag(table(spark, d, "customer").select(c("c_nationkey").alias("k")), table(spark, d, "supplier").select(c("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS nk, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10 WHERE c_nationkey IN (1, 4, 7)")
def multi_union(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(c("c_nationkey").alias("nk"), (c("c_custkey") % 10).alias("k"), "c_custkey")
    b = table(spark, d, "supplier").select(c("s_nationkey").alias("nk"), (c("s_suppkey") % 10).alias("k"), "s_suppkey")
    return R.multiple_union(a, b, "nk", [1, 4, 7], "k").drop("k")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def merge_input(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", ["s_suppkey", "s_nationkey"])
    return R.merge_input(s, s.where("s_suppkey % 3 = 0").select("s_suppkey", lit(-1).alias("s_nationkey")), "s_suppkey")


@query("SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, CAST(o_orderdate AS DATE) AS back, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400 AS seconds FROM orders")
def codec_days(spark: SparkSession, d: str) -> DataFrame:
    days = codecs.relative_days(c("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", days.alias("days"), codecs.date_of_days(days).alias("back"), codecs.epoch_seconds(c("o_orderdate")).alias("seconds"))


@query("WITH e AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT trim(c_mktsegment) AS v FROM customer)) SELECT c_custkey, id, v AS back FROM customer JOIN e ON trim(c_mktsegment) = v")
def codec_enum(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    values = codecs.enum_dictionary(customer, "c_mktsegment")
    number = codecs.enum_id(c("c_mktsegment"), values)
    return customer.select("c_custkey", number.alias("id"), codecs.enum_value(number, values).alias("back"))


@query(f"SELECT c_custkey, {money('c_acctbal')} AS fixed FROM customer")
def codec_fixed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fx(c("c_acctbal")).alias("fixed"))


@query(f"SELECT o_orderkey, {', '.join(f'CAST((o_custkey + {1 << 60}) // {8**i} % 8 AS INTEGER) AS d{i}' for i in (0, 1, 2, 3, 20))} FROM orders")
def codec_digits(spark: SparkSession, d: str) -> DataFrame:
    """Digits of numbers beyond 60 bits."""
    x = codecs.digits(c("o_custkey") + lit(1 << 60), 8, 21)
    return table(spark, d, "orders").select("o_orderkey", *[F.get(x, lit(i)).alias(f"d{i}") for i in (0, 1, 2, 3, 20)])


#: A dictionary in the plan format's form, for the columns of the queries below.
DICTIONARY = {
    "version": "1.0",
    "tables": {
        "lineitem": {
            "l_shipdate": {"type": "date", "strategy": {"radixBase": 4, "numDigits": 6}, "params": {"epoch_start": "1992-01-01"}},
            "l_quantity": {"type": "integer", "strategy": {"radixBase": 4, "numDigits": 3}, "mapping": None},
            "l_discount": {"type": "decimal", "strategy": {"radixBase": 4, "numDigits": 2}, "params": {"scale_factor": 100}},
            "l_returnflag": {"type": "enum", "strategy": {"radixBase": 3, "numDigits": 1}, "mapping": {"R": 0, "A": 1, "N": 2}},
            "l_linestatus": {"type": "enum", "strategy": {"radixBase": 2, "numDigits": 1}, "mapping": {"O": 0, "F": 1}},
        },
        "orders": {"o_orderdate": {"type": "date", "strategy": {"radixBase": 4, "numDigits": 6}, "params": {"epoch_start": "1992-01-01"}}},
    },
}


@query("""SELECT l_orderkey, l_linenumber, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS l_shipdate, CAST(round(l_quantity) AS BIGINT) AS l_quantity, CAST(round(l_discount * 100) AS BIGINT) AS l_discount,
CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS l_returnflag, CASE l_linestatus WHEN 'O' THEN 0 ELSE 1 END AS l_linestatus FROM lineitem""")
def dictionary_scan(spark: SparkSession, d: str) -> DataFrame:
    return Dictionary(DICTIONARY).encoded_table(table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]))


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate, l_discount, l_returnflag FROM lineitem")
def dictionary_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    known = Dictionary(DICTIONARY)
    return known.decoded_table(known.encoded_table(table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_discount", "l_returnflag"])))


@query("SELECT l_orderkey, l_linenumber, CAST(k % 4 AS INTEGER) AS d0, CAST(k // 4 % 4 AS INTEGER) AS d1, CAST(k // 1024 % 4 AS INTEGER) AS d5 FROM (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS k FROM lineitem)")
def dictionary_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Codes in the digits that the dictionary's strategy asks for."""
    known = Dictionary(DICTIONARY)
    x = codecs.digits(known.encoded("l_shipdate", c("l_shipdate")), *known.strategy("l_shipdate"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.get(x, lit(i)).alias(f"d{i}") for i in (0, 1, 5)])


# --- plans in the form of plan files: predicates with thresholds, aggregates by place, a switch of context, projections ---

_ORDER = lambda *fields: [{"field": i, "direction": "ASCENDING"} for i in fields]
_PREDICATE = lambda kind, column, base=4, n=6, **more: {"type": kind, "column": column, "threshold": "", "radixBase": base, "numDigits": n, **more}
_SWITCH = lambda i, of: {"id": i, "relOp": "SecureContextSwitch", "inputs": [of], "mpc_port": 8777, "charlie_host": "127.0.0.1"}


@query(f"""SELECT l_returnflag, l_linestatus, {big(f"sum({money('l_quantity')})")} AS sum_qty, {big(f"sum({money(PRICE_SQL)})")} AS sum_disc_price, {big(f"sum({money('l_quantity')}) // count(*)")} AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-08-03' GROUP BY 1, 2""")
def q1_fx(spark: SparkSession, d: str) -> DataFrame:
    """In fixed point, with a dictionary: filter on codes, aggregate by place, switch, averages as whole numbers."""
    aggregates = [{"type": "SUM", "ordinal": 2, "alias": "sum_qty"}, {"type": "SUM", "ordinal": 4, "alias": "sum_disc_price"}, {"type": "COUNT", "alias": "count_order"}]
    rels = [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT l_returnflag, l_linestatus, {money('l_quantity')} AS qty, l_shipdate, {money(PRICE_SQL)} AS disc_price FROM lineitem", "groupByOrdinals": [0, 1], "collation": _ORDER(0, 1)},
        {"id": "1", "relOp": "FheFilter", "predicate": _PREDICATE("less_equal", "l_shipdate"), "inputs": ["0"]},
        {"id": "2", "relOp": "FheAggregate", "groupBy": [0, 1], "aggregates": aggregates, "inputs": ["1"]},
        _SWITCH("3", "2"),
        {"id": "4", "relOp": "LogicalProject", "fields": ["l_returnflag", "l_linestatus", "sum_qty", "sum_disc_price", "avg_qty", "count_order"], "exprs": [*map(_in, range(4)), _op("DIVIDE", _in(2), _in(4)), _in(4)], "inputs": ["3"]},
    ]
    return _plan(spark, d, *rels, constants={"l_shipdate": "1998-08-03"}, dictionary=Dictionary(DICTIONARY))


@query("SELECT o_orderpriority, count(*) AS order_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' AND l_shipdate > o_orderdate GROUP BY 1")
def form_q4(spark: SparkSession, d: str) -> DataFrame:
    rels = [
        {"id": "0", "relOp": "FheTableScan", "sql": "SELECT o_orderpriority, o_orderdate FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate", "groupByOrdinals": [0], "collation": _ORDER(0)},
        {"id": "1", "relOp": "FheFilter", "predicates": [_PREDICATE("greater_equal", "o_orderdate"), _PREDICATE("less_than", "o_orderdate")], "inputs": ["0"]},
        {"id": "2", "relOp": "FheAggregate", "groupBy": [0], "aggregates": [{"type": "COUNT", "alias": "order_count"}], "inputs": ["1"]},
    ]
    return _plan(spark, d, *rels, constants={"o_orderdate_greater_equal": "1996-07-01", "o_orderdate_less_than": "1996-10-01"}, dictionary=Dictionary(DICTIONARY))


@query(f"""SELECT n_name, {big(f'sum({money(PRICE_SQL)})')} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""")
def form_q5(spark: SparkSession, d: str) -> DataFrame:
    joins = "c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey"
    rels = [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT n_name, r_name, o_orderdate, {money(PRICE_SQL)} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE {joins}", "groupByOrdinals": [0], "collation": _ORDER(0)},
        {"id": "1", "relOp": "FheFilter", "predicates": [_PREDICATE("equal", "r_name", 5, 1), _PREDICATE("greater_equal", "o_orderdate"), _PREDICATE("less_than", "o_orderdate")], "inputs": ["0"]},
        {"id": "2", "relOp": "FheAggregate", "groupBy": [0], "aggregates": [{"type": "SUM", "ordinal": 3, "alias": "revenue"}], "inputs": ["1"]},
        _SWITCH("3", "2"),
        {"id": "4", "relOp": "LogicalSort", "collation": [{"field": 1, "direction": "DESCENDING"}], "inputs": ["3"]},
    ]
    return _plan(spark, d, *rels, constants={"r_name": "EUROPE", "o_orderdate_greater_equal": "1996-01-01", "o_orderdate_less_than": "1997-01-01"})


@query("SELECT CAST(sum(round(l_extendedprice * l_discount * 1000000)) AS BIGINT) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND round(l_discount * 100) BETWEEN 2 AND 4 AND round(l_quantity) < 24")
def form_q6(spark: SparkSession, d: str) -> DataFrame:
    predicates = [_PREDICATE("greater_equal", "l_shipdate"), _PREDICATE("less_than", "l_shipdate"), _PREDICATE("greater_equal", "l_discount", 4, 2), _PREDICATE("less_equal", "l_discount", 4, 2), _PREDICATE("less_than", "l_quantity", 4, 3)]
    rels = [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT 1 AS g, l_shipdate, l_discount, l_quantity, l_extendedprice, {money('l_extendedprice * l_discount')} AS revenue FROM lineitem", "groupByOrdinals": [0], "collation": _ORDER(0)},
        {"id": "1", "relOp": "FheFilter", "predicates": predicates, "inputs": ["0"]},
        {"id": "2", "relOp": "FheAggregate", "groupBy": [0], "aggregates": [{"type": "SUM", "ordinal": 5, "alias": "revenue"}], "inputs": ["1"]},
        {"id": "3", "relOp": "FheProject", "ordinals": [1], "inputs": ["2"]},
    ]
    constants = {"l_shipdate_greater_equal": "1997-01-01", "l_shipdate_less_than": "1998-01-01", "l_discount_greater_equal": 0.02, "l_discount_less_equal": 0.04, "l_quantity": 24}
    return _plan(spark, d, *rels, constants=constants, dictionary=Dictionary(DICTIONARY))


@query("""SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1""")
def form_q12(spark: SparkSession, d: str) -> DataFrame:
    high = "CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN {} ELSE {} END"
    some = {"type": "in", "column": "l_returnflag", "thresholds": ["", ""], "radixBase": 4, "numDigits": 2}
    rels = [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT l_returnflag, l_shipdate, {high.format(1, 0)} AS high, {high.format(0, 1)} AS low FROM orders, lineitem WHERE o_orderkey = l_orderkey", "groupByOrdinals": [0], "collation": _ORDER(0)},
        {"id": "1", "relOp": "FheFilter", "predicates": [some, _PREDICATE("greater_equal", "l_shipdate"), _PREDICATE("less_than", "l_shipdate")], "inputs": ["0"]},
        {"id": "2", "relOp": "FheAggregate", "groupBy": [0], "aggregates": [{"type": "SUM", "ordinal": 2, "alias": "high_line_count"}, {"type": "SUM", "ordinal": 3, "alias": "low_line_count"}], "inputs": ["1"]},
    ]
    constants = {"l_returnflag_in_0": "A", "l_returnflag_in_1": "R", "l_shipdate_greater_equal": "1996-01-01", "l_shipdate_less_than": "1997-01-01"}
    return _plan(spark, d, *rels, constants=constants, dictionary=Dictionary(DICTIONARY))


@query(f"SELECT {big(f'coalesce(sum({money(PRICE_SQL)}), 0)')} AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_linestatus IN ('O', 'F') AND p_size >= 1 AND ({_Q19})")
def form_q19(spark: SparkSession, d: str) -> DataFrame:
    constants: dict = {"l_returnflag": "R", "l_linestatus": ["O", "F"], "p_size": 1}
    groups = []
    for i, (brand, kinds, low, high, size) in enumerate(_GROUPS):
        constants |= {f"brand_{i}": brand, f"kind_{i}": kinds, f"low_{i}": low, f"high_{i}": high, f"size_{i}": size}
        some = {"type": "in", "column": "p_type", "thresholds": ["", ""], "wireKey": f"kind_{i}", "radixBase": 4, "numDigits": 2}
        groups.append({"predicates": [_PREDICATE("equal", "p_brand", wireKey=f"brand_{i}"), some, _PREDICATE("greater_equal", "l_quantity", wireKey=f"low_{i}"), _PREDICATE("less_equal", "l_quantity", wireKey=f"high_{i}"), _PREDICATE("less_equal", "p_size", wireKey=f"size_{i}")]})
    common = [_PREDICATE("equal", "l_returnflag"), {"type": "in", "column": "l_linestatus", "thresholds": ["", ""]}, _PREDICATE("greater_equal", "p_size")]
    rels = [
        {"id": "0", "relOp": "FheTableScan", "sql": f"SELECT 1 AS g, {money(PRICE_SQL)} AS revenue, p_brand, p_type, l_quantity, p_size, l_returnflag, l_linestatus FROM lineitem, part WHERE l_partkey = p_partkey", "groupByOrdinals": [0], "collation": _ORDER(0)},
        {"id": "1", "relOp": "FheFilter", "predicates": common, "orPredicateGroups": groups, "inputs": ["0"]},
        {"id": "2", "relOp": "FheAggregate", "groupBy": [0], "aggregates": [{"type": "SUM", "ordinal": 1, "alias": "revenue"}], "inputs": ["1"]},
        {"id": "3", "relOp": "FheProject", "ordinals": [1], "inputs": ["2"]},
    ]
    return _plan(spark, d, *rels, constants=constants)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 30")
def form_sort(spark: SparkSession, d: str) -> DataFrame:
    order = [{"field": 2, "direction": "DESCENDING"}, *_ORDER(0, 1)]
    rels = [{"id": "0", "relOp": "FheTableScan", "sql": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem", "groupByOrdinals": [0]}, _SWITCH("1", "0"), {"id": "2", "relOp": "LogicalSort", "collation": order, "inputs": ["1"], "fetch": {"literal": 30, "type": {"type": "INTEGER", "nullable": False}}}]
    return _plan(spark, d, *rels, {"id": "3", "relOp": "LogicalProject", "fields": ["l_orderkey", "l_linenumber"], "exprs": [_in(0), _in(1)], "inputs": ["2"]})


@query("SELECT * FROM (VALUES (0, 'LogicalSort #2, 5 rows at most'), (1, '  FheFilter #1, 40 rows at most'), (2, '    StoredTableScan #0, 40 rows at most')) t(line, text)")
def plan_explain(spark: SparkSession, d: str) -> DataFrame:
    rels = [_scan("0", "nation", ["n_nationkey"], limit=40), {"id": "1", "relOp": "FheFilter", "predicates": []}, {"id": "2", "relOp": "LogicalSort", "collation": _ORDER(0), "fetch": {"literal": 5}}]
    lines = planner.explain(planner.parse({"rels": rels}), {"0": 1000}).splitlines()
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


# --- plans that use files of SQL, row positions and table bounds ---

_EQ = lambda a, b: {"op": {"kind": "EQUALS"}, "operands": [{"input": a}, {"input": b}]}


@query(f"""SELECT c_mktsegment, count(*) AS n, {big(f"sum({money('o_totalprice')})")} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 1""")
def plan_sql_file(spark: SparkSession, d: str) -> DataFrame:
    leaves = f"-- 0, collation: (0 ASC)\nSELECT o_custkey, {money('o_totalprice')} AS price\nFROM orders ORDER BY 1;\n-- 1, party: 2\nSELECT c_custkey, c_mktsegment FROM customer\n"
    rest = {
        "rels": [
            {"id": "2", "relOp": "LogicalJoin", "inputs": ["0", "1"], "condition": _EQ(0, 2), "foreign-key": 0, "operator-algorithm": "auto"},
            {"id": "3", "relOp": "LogicalAggregate", "group": [3], "aggs": [{"agg": "COUNT", "name": "n"}, {"agg": "SUM", "operands": [1], "name": "total"}]},
        ]
    }
    return planner.run(spark, d, planner.with_sql_file(leaves, rest), check=True)


@query("""SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier) a
JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey DESC) AS p FROM supplier) b USING (p) WHERE a.s_suppkey < b.s_suppkey AND a.s_suppkey > 5""")
def plan_merge_join(spark: SparkSession, d: str) -> DataFrame:
    leaf = lambda i, way: {"id": i, "relOp": "LogicalValues", "sql": "SELECT s_suppkey FROM supplier", "collation": [{"field": 0, "direction": way}]}
    less = {"op": {"kind": "LESS_THAN"}, "operands": [{"input": 0}, {"input": 1}]}
    plan = [
        leaf("0", "ASCENDING"),
        {"id": "1", "relOp": "FheFilter", "predicates": [{"column": "s_suppkey", "type": "greater_than", "value": 5}]},
        leaf("2", "DESCENDING"),
        {"id": "3", "relOp": "LogicalJoin", "inputs": ["1", "2"], "condition": less, "operator-algorithm": "merge-join", "dummy-handling": "OR", "fields": ["low", "high"]},
    ]
    return planner.run(spark, d, {"rels": plan})


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN -s_nationkey ELSE s_nationkey END AS nation FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def plan_merge_input(spark: SparkSession, d: str) -> DataFrame:
    sql = lambda value, by: f"SELECT s_suppkey, {value} AS nation, s_suppkey % {by} <> 0 AS dummy_tag FROM supplier"
    return planner.run(spark, d, {"rels": [{"id": "0", "relOp": "LogicalValues", "operator-algorithm": "merge-input", "sql": sql("s_nationkey", 2), "merge-sql": sql("-s_nationkey", 3), "collation": [{"field": 0, "direction": "ASCENDING"}]}]})


@query("SELECT c_nationkey AS nation, c_custkey AS customer, s_nationkey AS same, s_suppkey AS supplier FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_nationkey IN (1, 4, 7)")
def plan_multiple_union(spark: SparkSession, d: str) -> DataFrame:
    leaf = {"id": "0", "relOp": "MultipleUnion", "sql1": "SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey = ", "sql2": "SELECT s_nationkey, s_suppkey FROM supplier WHERE s_nationkey = ", "filter": [1, 4, 7]}
    return planner.run(spark, d, {"rels": [{**leaf, "fields": ["nation", "customer", "same", "supplier"]}]})


@query("SELECT p_partkey, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT (SELECT count(*) FROM nation)")
def plan_table_bound(spark: SparkSession, d: str) -> DataFrame:
    order = [{"field": 1, "direction": "DESCENDING"}, {"field": 0, "direction": "ASCENDING"}]
    return planner.run(spark, d, {"rels": [{"id": "0", "relOp": "StoredTableScan", "table": "part", "columns": ["p_partkey", "p_size"]}, {"id": "1", "relOp": "LogicalSort", "collation": order, "fetch": {"literal": "nation"}}]})


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def unioned_parties(spark: SparkSession, d: str) -> DataFrame:
    return tables.unioned_results(spark, [d, d], "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
