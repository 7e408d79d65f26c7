"""JSON operator plans as DataFrames: parse, print back, explain, run."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowplan.functions.dictionary import Dictionary
from sparrowplan.functions.expressions import column_of, equi_keys
from sparrowplan.operators import relational as R
from sparrowplan.operators.private_filter import condition
from sparrowplan.sources import tables


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    inputs: tuple[str, ...]
    options: dict = field(default_factory=dict, hash=False)


KINDS = {"LogicalValues", "JdbcTableScan", "VaultDBTableScan", "StoredTableScan", "FheTableScan", "FheFilter", "FheAggregate", "FheProject", "SecureContextSwitch", "LogicalFilter", "LogicalProject", "LogicalJoin", "LogicalAggregate", "LogicalSort", "LogicalUnion", "MultipleUnion", "ShrinkWrap"}
#: What each operator may say; anything else is refused. Ports, hosts, and notes about types and names change no answer.
_SCAN = {"sql", "table", "columns", "limit", "input-limit", "collation", "party", "groupByOrdinals", "operator-algorithm", "merge-sql", "type", "tuples", "outputFields", "database"}
_AGGREGATE = {"group", "groupBy", "aggs", "aggregates", "cardBound", "cardinality-bound", "operator-algorithm", "effective-collation", "checkSort", "collation"}
KEYS = {
    **dict.fromkeys(("LogicalValues", "JdbcTableScan", "VaultDBTableScan", "StoredTableScan", "FheTableScan"), _SCAN),
    **dict.fromkeys(("LogicalAggregate", "FheAggregate"), _AGGREGATE),
    **dict.fromkeys(("LogicalProject", "FheProject"), {"fields", "exprs", "columns", "ordinals", "collation"}),
    "MultipleUnion": {"sql1", "sql2", "filter", "fields", "collation", "party"},
    "FheFilter": {"predicate", "predicates", "orPredicateGroups", "collation"},
    "LogicalFilter": {"condition", "collation"},
    "LogicalJoin": {"condition", "joinType", "foreign-key", "foreignKey", "operator-algorithm", "fields", "dummy-handling", "collation"},
    "LogicalSort": {"collation", "fetch"},
    "LogicalUnion": {"all", "collation"},
    "ShrinkWrap": {"output-cardinality", "collation"},
    "SecureContextSwitch": {"mpc_port", "charlie_host", "decryption_in_mpc", "mpc_in_circuit_port", "sort_limit", "collation"},
}
LEAVES = {"LogicalValues", "JdbcTableScan", "VaultDBTableScan", "StoredTableScan", "FheTableScan", "MultipleUnion"}
#: Operators that leave the order of their input's rows as it is.
KEEP_ORDER = {"LogicalFilter", "FheFilter", "SecureContextSwitch"}
DIRECTIONS = {"ASC": "ASCENDING", "DESC": "DESCENDING"}


def parse(text: str | dict) -> list[Node]:
    """The operators in order; one without `inputs` takes the one before it. The last is the root."""
    rels = (json.loads(text) if isinstance(text, str) else text)["rels"]
    nodes: list[Node] = []
    for r in rels:
        if r["relOp"] not in KINDS:
            raise ValueError(f"unknown operator {r['relOp']}")
        if "inputs" in r:
            inputs = tuple(map(str, r["inputs"]))
        else:
            inputs = () if r["relOp"] in LEAVES else (nodes[-1].id,)
        if missing := set(inputs) - {n.id for n in nodes}:
            raise ValueError(f"unknown inputs {missing}")
        if unknown := set(r) - KEYS[r["relOp"]] - {"id", "relOp", "inputs"}:
            raise ValueError(f"unknown keys of {r['relOp']}: {sorted(unknown)}")
        nodes.append(Node(str(r["id"]), r["relOp"], inputs, {k: v for k, v in r.items() if k not in ("id", "relOp", "inputs")}))
    return nodes


def parse_sql_file(text: str) -> list[dict]:
    """Leaves of a plan as SQL, each under a line such as `-- 0, collation: (0 ASC, 1 DESC), party: 1`."""
    leaves: list[dict] = []
    for line in text.splitlines():
        head = re.match(r"--\s*(\d+)\s*(?:,|$)(.*)", line)
        if head:
            leaf = {"id": head[1], "relOp": "LogicalValues", "sql": ""}
            if order := re.search(r"collation:\s*\(([^)]*)\)", head[2]):
                pairs = [x.split() for x in order[1].split(",")]
                if any(len(x) != 2 or x[1] not in DIRECTIONS for x in pairs):
                    raise ValueError(f"collation {order[1]}")
                leaf["collation"] = [{"field": int(n), "direction": DIRECTIONS[d]} for n, d in pairs]
            if party := re.search(r"party:\s*(\d+)", head[2]):
                leaf["party"] = int(party[1])
            leaves.append(leaf)
        elif leaves and not line.startswith("--"):
            leaves[-1]["sql"] = f"{leaves[-1]['sql']} {line}".strip()
        elif line.strip() and not line.startswith("--"):
            raise ValueError("SQL without a header")
    return [{**leaf, "sql": leaf["sql"].rstrip("; ")} for leaf in leaves]


def with_sql_file(sql: str, plan: str | dict) -> dict:
    """A plan whose leaves are in a SQL file and whose other operators are in JSON."""
    return {"rels": parse_sql_file(sql) + (json.loads(plan) if isinstance(plan, str) else plan)["rels"]}


def deparse(nodes: list[Node]) -> dict:
    return {"rels": [{"id": n.id, "relOp": n.kind, "inputs": list(n.inputs), **n.options} for n in nodes]}


def bounds(nodes: list[Node], leaf_rows: dict[str, int]) -> dict[str, int]:
    """The most rows each operator can give, from the rows of the leaves; in oblivious mode that many are carried.

    A join that names its foreign key gives that side's rows, any other join the product; no keys in an aggregate give one row.
    """
    out: dict[str, int] = {}
    for n in nodes:
        o, rows = n.options, [out[i] for i in n.inputs]
        if n.kind in LEAVES:
            most = leaf_rows[n.id]
            limit = o.get("input-limit", o.get("limit"))
        elif n.kind == "LogicalJoin":
            foreign = o.get("foreign-key", o.get("foreignKey"))
            if o.get("operator-algorithm") == "merge-join":
                most = max(rows)
            elif foreign is None:
                most = rows[0] if o.get("joinType") == "left" else rows[0] * rows[1]
            else:
                most = rows[int(foreign)]
            limit = None
        elif n.kind in ("LogicalAggregate", "FheAggregate"):
            most = rows[0] if o.get("group") or o.get("groupBy") else 1
            limit = o.get("cardinality-bound") or o.get("cardBound") or None
        elif n.kind == "LogicalUnion":
            most, limit = sum(rows), None
        else:
            most = rows[0]
            literal = o.get("fetch", {}).get("literal")
            limit = int(literal) if str(literal).isdigit() else o.get("output-cardinality")
        out[n.id] = most if limit is None else min(most, int(limit))
    return out


def explain(nodes: list[Node], leaf_rows: dict[str, int] | None = None) -> str:
    """The tree of operators; with the rows of the leaves, also the bound of each."""
    by_id = {n.id: n for n in nodes}
    most = bounds(nodes, leaf_rows) if leaf_rows is not None else {}

    def show(n: Node, depth: int) -> list[str]:
        told = f", {most[n.id]} rows at most" if most else ""
        return [f"{'  ' * depth}{n.kind} #{n.id}{told}"] + [x for i in n.inputs for x in show(by_id[i], depth + 1)]

    return "\n".join(show(nodes[-1], 0))


def run(spark: SparkSession, sf_dir: str, plan: str | dict, constants: dict | None = None, oblivious: bool = False, check: bool = False, dictionary: Dictionary | None = None, parties: dict[int, str] | None = None) -> DataFrame:
    """The answer of a plan. `check` refuses repeated keys on the primary-key side of joins that name a foreign key.

    `dictionary`: filters of the Fhe kind compare codes of the columns it knows. `parties`: each party's folder of tables; a leaf that names a party
    reads its tables, any other leaf those of all of them, together.

    Positional operators count rows that filters have marked, so plans with one always run in oblivious mode.
    """
    done: dict[str, DataFrame] = {}
    orders: dict[str, list[tuple[str, str]]] = {}
    nodes = parse(plan)
    oblivious = oblivious or any(n.options.get("operator-algorithm") in ("merge-join", "merge-input") for n in nodes)
    for n in nodes:
        if n.options.get("operator-algorithm") == "merge-join":
            done[n.id] = _merge_join(*[done[i] for i in n.inputs], *[orders.get(i) for i in n.inputs], n.options)
        else:
            done[n.id] = _operator(spark, _folders(sf_dir, n, parties), n, [done[i] for i in n.inputs], constants or {}, oblivious, check, dictionary)
        if n.options.get("collation"):
            orders[n.id] = _collation(done[n.id], n.options)
        elif n.kind in KEEP_ORDER and n.inputs[0] in orders:
            orders[n.id] = orders[n.inputs[0]]
    return R.reveal(done[nodes[-1].id])


def _folders(sf_dir: str, n: Node, parties: dict[int, str] | None) -> list[str]:
    if not parties:
        return [sf_dir]
    return [parties[int(n.options["party"])]] if "party" in n.options else [parties[p] for p in sorted(parties)]


def _collation(df: DataFrame, o: dict) -> list[tuple[str, str]]:
    visible = [c for c in df.columns if c != R.DUMMY]
    return [(visible[c["field"]] if isinstance(c["field"], int) else c["field"], c["direction"]) for c in o.get("collation", [])]


def _columns(df: DataFrame, columns: list[str | int] | None, limit: int | None) -> DataFrame:
    """Columns by name or place, in their order."""
    df = df if columns is None else df.select(*[df.columns[c] if isinstance(c, int) else c for c in columns])
    return df if limit is None else df.limit(limit)


def _leaf(spark: SparkSession, sf_dir: str, n: Node, oblivious: bool) -> DataFrame:
    """Stored tables or SQL. A column `dummy_tag` of the SQL becomes the mark; true means a dummy, but a valid row in scans of the Fhe kind."""
    o = n.options
    limit = o.get("input-limit", o.get("limit"))

    def tagged(df: DataFrame) -> DataFrame:
        if "dummy_tag" not in df.columns:
            return R.oblivious(df) if oblivious else df
        mark = F.col("dummy_tag").cast("boolean")
        df = df.withColumn(R.DUMMY, ~mark if n.kind == "FheTableScan" else mark).drop("dummy_tag")
        return df if oblivious else R.reveal(df)

    if n.kind == "MultipleUnion":
        sides = [reduce(DataFrame.union, [tables.sql_leaf(spark, sf_dir, f"{o[sql]}{i}").withColumn("_of", F.lit(i)) for i in o["filter"]]) for sql in ("sql1", "sql2")]
        left, right = (x.toDF(*[f"{tag}{c}" for c in range(len(x.columns) - 1)], "_of") for x, tag in zip(sides, "lr"))
        out = left.join(right, (left["_of"] == right["_of"]) & (left["l0"] == right["r0"])).drop("_of")
        names = [c for x in sides for c in x.columns[:-1]]
        return tagged(out.toDF(*(o.get("fields") or [c if names.count(c) == 1 else f"{c}_{i}" for i, c in enumerate(names)])))
    df = tables.sql_leaf(spark, sf_dir, o["sql"], limit) if "sql" in o else _columns(tables.table(spark, sf_dir, o["table"]), o.get("columns"), limit)
    if o.get("operator-algorithm") != "merge-input":
        return tagged(df)
    a, b = tagged(df), tagged(tables.sql_leaf(spark, sf_dir, o["merge-sql"], limit))
    order = _collation(a, o)
    if not order:
        raise ValueError("a merged input needs a collation")
    return R.merge_by_place(a, b, [(c, d == "ASCENDING") for c, d in order])


def _operator(spark: SparkSession, folders: list[str], n: Node, inputs: list[DataFrame], constants: dict, oblivious: bool, check: bool = False, dictionary: Dictionary | None = None) -> DataFrame:
    o = n.options
    if n.kind in LEAVES:
        return R.union_bag(*[_leaf(spark, folder, n, oblivious) for folder in folders])
    sf_dir = folders[0]
    df = inputs[0]
    visible = [c for c in df.columns if c != R.DUMMY]
    columns = [F.col(c) for c in visible]
    kind_of = lambda c: df.select(c).dtypes[0][1]
    if n.kind == "FheFilter":
        if not {"predicate", "predicates", "orPredicateGroups"} & set(o):
            raise ValueError("a filter without predicates")
        predicates = o["predicates"] if "predicates" in o else [o["predicate"]] if "predicate" in o else []
        return R.filter_rows(df, condition(predicates, o.get("orPredicateGroups"), constants, dictionary))
    if n.kind == "LogicalFilter":
        return R.filter_rows(df, column_of(o["condition"], columns, kind_of))
    if n.kind in ("LogicalProject", "FheProject"):
        if "exprs" in o:
            return R.project(df, dict(zip(o["fields"], [column_of(e, columns, kind_of) for e in o["exprs"]], strict=True)))
        if "ordinals" in o:
            return R.project(df, {visible[i]: columns[i] for i in o["ordinals"]})
        if "fields" in o:
            named = [f if isinstance(f, dict) else {"ordinal": visible.index(f)} for f in o["fields"]]
            return R.project(df, {f.get("name") or visible[f["ordinal"]]: columns[f["ordinal"]] for f in named})
        return R.project(df, {c.get("alias", c["column"]): F.col(c["column"]) for c in o["columns"]})
    if n.kind in ("LogicalAggregate", "FheAggregate"):
        at = lambda x: visible[x] if isinstance(x, int) else x
        keys = [at(x) for x in o.get("group", o.get("groupBy", []))]
        functions = {}
        for a in [*o.get("aggs", []), *o.get("aggregates", [])]:
            name = a.get("type") if "alias" in a else a["agg"]
            name = (name["kind"] if isinstance(name, dict) else name).upper()
            operands = [a["ordinal"]] if "ordinal" in a and name != "COUNT" else a.get("operands")
            if a.get("distinct"):
                if name != "COUNT":
                    raise ValueError(f"DISTINCT {name} isn't supported")
                name = "COUNT_DISTINCT"
            if name not in R.AGGREGATES and name != "COUNT_DISTINCT":
                raise ValueError(f"unknown aggregate {name}")
            functions[a.get("alias") or a["name"]] = (name, F.col(at(operands[0])) if operands else None)
        return R.aggregate(df, keys, functions, o.get("cardinality-bound", o.get("cardBound", 0)))
    if n.kind == "LogicalSort":
        most = o.get("fetch", {}).get("literal")
        if isinstance(most, str):  # the size of a table, or a number as text
            most = int(most) if most.isdigit() else tables.table(spark, sf_dir, most).count()
        return R.sort_limit(df, _collation(df, o), most)
    if n.kind == "LogicalUnion":
        return R.union_bag(*inputs)
    if n.kind == "ShrinkWrap":
        return R.shrinkwrap(df, o["output-cardinality"])
    if n.kind == "SecureContextSwitch":  # moves data between protections that this engine doesn't have
        return R.sort_limit(df, _collation(df, o), o["sort_limit"]) if o.get("sort_limit") else df
    return _join(inputs[0], inputs[1], o, check)


def _apart(left: DataFrame, right: DataFrame, o: dict) -> tuple[DataFrame, DataFrame, list[list[str]], list[str]]:
    """Both sides with column names of their own (c0, c1, ...; marks _dl, _dr), as they may share some; the names shown; the output's names."""
    shown = [[c for c in x.columns if c != R.DUMMY] for x in (left, right)]
    width = len(shown[0])
    l = left.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(shown[0])], *([F.col(R.DUMMY).alias("_dl")] if R.DUMMY in left.columns else []))  # noqa: E741
    r = right.select(*[F.col(c).alias(f"c{width + i}") for i, c in enumerate(shown[1])], *([F.col(R.DUMMY).alias("_dr")] if R.DUMMY in right.columns else []))
    return l, r, shown, o.get("fields") or [c if shown[0].count(c) + shown[1].count(c) == 1 else f"{c}_{i}" for i, c in enumerate(shown[0] + shown[1])]


def _merge_join(left: DataFrame, right: DataFrame, left_order: list | None, right_order: list | None, o: dict) -> DataFrame:
    if not left_order or not right_order:
        raise ValueError("a merge join needs sorted inputs")
    l, r, shown, fields = _apart(left, right, o)  # noqa: E741
    width = len(shown[0])
    names = [f"c{i}" for i in range(len(fields))]
    by = lambda order, columns, at: [F.col(f"c{at + columns.index(n)}").asc() if d == "ASCENDING" else F.col(f"c{at + columns.index(n)}").desc() for n, d in order]
    out = R.merge_join_tagged(l, r, by(left_order, shown[0], 0), by(right_order, shown[1], width), column_of(o["condition"], [F.col(c) for c in names]), "_dl", "_dr", o.get("dummy-handling") == "OR")
    return out.select(*[F.col(c).alias(f) for c, f in zip(names, fields)], R.DUMMY)


def _join(left: DataFrame, right: DataFrame, o: dict, check: bool = False) -> DataFrame:
    tags = [R.DUMMY in x.columns for x in (left, right)]
    l, r, shown, fields = _apart(left, right, o)  # noqa: E741
    width = len(shown[0])
    names = [f"c{i}" for i in range(len(fields))]
    foreign = o.get("foreign-key", o.get("foreignKey"))
    if check and foreign is not None:
        side = 1 - int(foreign)
        R.assert_unique(R.reveal((left, right)[side]), [shown[side][k[side]] for k in equi_keys(o["condition"], width)])
    kind = o.get("joinType", "inner")
    predicate = column_of(o["condition"], [F.col(c) for c in names]) if "condition" in o else None
    algorithm = o.get("operator-algorithm", "")
    if kind == "cartesian":
        out = l.crossJoin(r)
    elif kind == "left":
        keys = equi_keys(o["condition"], width)
        out = R.left_zero_join(l, r.where(~F.col("_dr")).drop("_dr") if tags[1] else r, [(f"c{a}", f"c{width + b}") for a, b in keys])
    elif kind == "inner":
        out = l.join(R.hinted(r, algorithm), predicate)
    else:
        raise ValueError(f"unknown join {kind}")
    dummies = [F.col(c) for c in ("_dl", "_dr") if c in out.columns]
    tag = [reduce(lambda a, b: a | b, dummies).alias(R.DUMMY)] if dummies else []
    return out.select(*[F.col(c).alias(f) for c, f in zip(names, fields)], *tag)
