"""Sources and sinks: Parquet tables, SQL leaves, CSV, exclusive-or shares, synthetic tables."""

from __future__ import annotations

import zipfile
from functools import reduce
from pathlib import Path
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowplan.storage import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TYPES = {"int32": "int", "int": "int", "integer": "int", "int64": "bigint", "long": "bigint", "bigint": "bigint", "float": "double", "bool": "boolean", "boolean": "boolean", "date": "date", "string": "string"}


#: Modulus of the draws of synthetic tables.
PRIME = (1 << 31) - 1


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A stored table; times without a zone become dates once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name != "events":
        df = df.withColumns({c: F.col(c).cast("date") for c, t in df.dtypes if t.startswith("timestamp")})
    df = df.select(*columns) if columns else df
    return df if limit is None else df.limit(limit)


def sql_leaf(spark: SparkSession, sf_dir: str, sql: str, limit: int | None = None) -> DataFrame:
    """A leaf given as SQL over the stored tables."""
    for name in TABLES:
        if name in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit)


def unioned_results(spark: SparkSession, folders: list[str], sql: str) -> DataFrame:
    """The rows that a query gives on each party's tables, together."""
    return reduce(DataFrame.union, [sql_leaf(spark, d, sql) for d in folders])


def jdbc(spark: SparkSession, url: str, sql: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query answered by a database. `split` (whole-number column, low, high, parts) reads it in parts, one task each.

    Column choices and filters put on the result are sent to the database.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({sql}) t").options(**options)
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


#: Options of the embedded database of the Java library.
EMBEDDED = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def embedded_database(df: DataFrame, name: str, folder: str) -> str:
    """The address of an embedded database with one table, whole-number columns only; `folder` is new, and shared by driver and executors under one path.

    Only one process may open such a database for writing, and one in memory is known to one process alone. So tasks write text files, the
    driver loads them, and the database is packed into an archive, which any number of processes may open for reading.
    """
    kinds = {"tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT"}
    if any(t not in kinds for _, t in df.dtypes):
        raise ValueError(f"whole numbers only: {df.dtypes}")
    if urlparse(folder).scheme not in ("", "file"):
        raise ValueError(f"an embedded database needs a folder of the file system: {folder}")
    df.select("*", F.lit(0)).write.csv(f"{folder}/rows")  # a line of nothing but a null would count as no row
    path = Path(unquote(urlparse(folder).path))
    jvm, url = df.sparkSession._jvm, f"jdbc:derby:{path}/db"
    jvm.java.lang.Class.forName(EMBEDDED["driver"])
    connection = jvm.java.sql.DriverManager.getConnection(f"{url};create=true")
    try:
        statement = connection.createStatement()
        columns = ", ".join(f'"{c}" {kinds[t]}' for c, t in df.dtypes)
        statement.execute(f'CREATE TABLE "{name}" ({columns})')
        for part in sorted((path / "rows").glob("part-*")):
            load = connection.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(NULL, ?, NULL, ?, ?, NULL, NULL, 'UTF-8', 0)")
            for i, value in enumerate([name, ",".join(str(n + 1) for n in range(len(df.columns))), str(part)]):
                load.setString(i + 1, value)
            load.execute()
    finally:
        connection.close()
    try:
        jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # the state that tells of an orderly end
            raise
    with zipfile.ZipFile(path / "db.jar", "w") as archive:  # not compressed, so that pages are found by their place
        for file in sorted((path / "db").rglob("*")):
            if file.is_file() and file.suffix != ".lck":
                archive.write(file, file.relative_to(path))
    return f"jdbc:derby:jar:({path}/db.jar)db"


def save_table(df: DataFrame, path: str) -> None:
    """A table with its schema, to be read by `load_table`."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def insert_table(df: DataFrame, path: str) -> None:
    """Rows added to a saved table; other column names or types are refused."""
    if df.dtypes != load_table(df.sparkSession, path).dtypes:
        raise ValueError("rows of another schema")
    df.write.mode("append").parquet(path)


def parse_schema(text: str) -> T.StructType:
    """`(table.field:TYPE, name:varchar(25))` as a schema."""
    fields = []
    for part in text.strip().strip("()").replace("varchar(", "varchar[").replace("char(", "char[").split(","):
        name, kind = part.strip().rsplit(":", 1)
        kind = kind.strip().lower()
        spark_type = "string" if kind.startswith(("varchar", "char")) else TYPES[kind]
        fields.append(T.StructField(name.strip().split(".")[-1], T._parse_datatype_string(spark_type)))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("quote", '"').option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quote", '"').option("escape", '"').csv(path)


def xor_shares(df: DataFrame, columns: list[str], seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables whose whole-number columns give the original by exclusive or. Not a protection: the pad is a hash of the row's columns and the seed."""
    pad = {c: F.xxhash64(F.lit(seed), F.lit(c), *columns) for c in columns}
    rest = [c for c in df.columns if c not in columns]
    ided = stored(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # both shares must see the same numbers
    return ided.select("_row", *rest, *[pad[c].alias(c) for c in columns]), ided.select("_row", *rest, *[pad[c].bitwiseXOR(F.col(c).cast("long")).alias(c) for c in columns])


def recombined(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    rest = [c for c in a.columns if c not in columns and c != "_row"]
    joined = a.alias("a").join(b.alias("b"), F.col("a._row") == F.col("b._row"))
    return joined.select(*[F.col(f"a.{c}") for c in rest], *[F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")).alias(c) for c in columns])


def synthetic(spark: SparkSession, spec: dict) -> DataFrame:
    """A table described by rows, seed and fields: a key, a range [low, high], or a list of values."""
    df = spark.range(spec["rows"])
    columns = []
    for i, (name, f) in enumerate(spec["fields"].items()):
        draw = (F.col("id") + (spec.get("seed", 0) * 7919 + i * 104_729 + 1)) % PRIME
        for factor in (48_271, 69_621, 16_807):  # products stay under 2^48
            draw = draw * factor % PRIME
        if f == "key":
            columns.append(F.col("id").alias(name))
        elif "range" in f:
            low, high = f["range"]
            columns.append((F.lit(low) + draw % (high - low + 1)).alias(name))
        else:
            columns.append(F.get(F.array(*map(F.lit, f["values"])), (draw % len(f["values"])).cast("int")).alias(name))
    return df.select(*columns)
