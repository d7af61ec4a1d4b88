"""Inputs of the operators, derived from the tables; ``SQL`` has the same as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrelspark.operators.ordering import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events but errors as one interleaving: (idx, tid, var, kind)."""
    e = table(spark, sf_dir, "events").where("event_type != 'error'")
    kind = F.when(F.col("event_type").isin("view", "click"), "load").otherwise("store")
    return numbered(e.select("ts", "event_id", (F.col("user_id") % 8).cast("int").alias("tid"), (_k() % 16).cast("string").alias("var"), kind.alias("kind")), ["ts", "event_id"]).drop("ts", "event_id")


def access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as accesses: an order is a state, its parts are locations, returned items are writes."""
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr("l_orderkey as state", "cast(l_partkey % 64 as string) as location", "l_suppkey as thread", "l_returnflag = 'R' as write", "l_linenumber as block", "concat(l_partkey, ':', l_suppkey) as span", "case when l_returnflag = 'R' then 'UnsafeWrite' else 'UnsafeRead' end as op", "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as bigint) as ord")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls between 997 functions."""
    return table(spark, sf_dir, "orders").selectExpr("cast(o_custkey % 997 as int) as caller", "cast((o_orderkey * 31 + o_custkey) % 997 as int) as callee", "case o_orderpriority when '1-URGENT' then 'spawn' when '2-HIGH' then 'scope_spawn' else 'direct' end as site_kind", "cast(o_orderkey as string) as location", "cast(o_orderkey % 3 as int) as dest_local")


def lock_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order links a customer's guard with another: urgent orders in progress share one for each two orders, any other has its own."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey as a", "case when o_orderstatus = 'P' and o_orderpriority = '1-URGENT' then 10000000000 + o_orderkey div 2 else 20000000000 + o_orderkey end as b")


def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a pointer constraint over 211 variables: finished ones take an address, all others copy."""
    return table(spark, sf_dir, "orders").selectExpr("'f' as func", "if(o_orderstatus = 'F', concat('a', o_orderkey % 211), concat('v', o_custkey % 211)) as src", "concat('v', if(o_orderstatus = 'F', o_custkey % 211, o_orderkey % 211)) as dst", "if(o_orderstatus = 'F', 'Address', 'Copy') as kind")


def all_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a pointer constraint over 211 variables; the status gives the kind, and for orders in progress the parity of the key."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "'f' as func", "if(o_orderstatus = 'F', concat('a', o_orderkey % 211), concat('v', o_custkey % 211)) as src", "concat('v', if(o_orderstatus = 'F', o_custkey % 211, o_orderkey % 211)) as dst",
        "case o_orderstatus when 'F' then 'Address' when 'O' then 'Copy' when 'P' then if(o_orderkey % 2 = 0, 'Load', 'Store') end as kind",
    )


def alias_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pair of variables for each customer."""
    return table(spark, sf_dir, "customer").selectExpr("'f' as func", "concat('v', c_custkey % 211) as a", "concat('v', c_nationkey) as b").distinct()


def memory_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events but errors as atomic operations: a user is a state."""
    names = "element_at(array('Relaxed', 'Release', 'Acquire', 'AcqRel', 'SeqCst'), cast(event_id % 5 as int) + 1)"
    return table(spark, sf_dir, "events").where("event_type != 'error'").select(F.col("user_id").alias("state"), (_k() % 16).alias("var"), F.when(F.col("event_type").isin("view", "click"), "load").otherwise("store").alias("kind"), F.expr(names).alias("ordering"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("span"))


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as channel endpoints, declared at a (user, k)."""
    return table(spark, sf_dir, "events").select((F.col("user_id") * 1000 + _k()).alias("site"), F.col("event_id").alias("endpoint"), F.when(F.col("event_type").isin("view", "click"), "sender").otherwise("receiver").alias("role"))


def spread(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(key, name): every order with one of the names, in turn by its key; so inputs that are texts or programs grow with the table."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("o_orderkey") % len(names) + 1).cast("int")).alias("name"))


def spread_sql(names: list[str]) -> str:
    return "spread AS (SELECT CAST(o_orderkey AS VARCHAR) AS key, ([" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + "])[CAST(o_orderkey % " + str(len(names)) + " + 1 AS INTEGER)] AS name FROM orders)"


def renamed(rows: DataFrame, given: DataFrame, column: str = "net_id") -> DataFrame:
    """The rows of what has the name in ``column``, once for each key that has it; the key takes the name's place."""
    keys = given.withColumnsRenamed({"key": "given_key", "name": "given_name"})
    return keys.join(F.broadcast(rows), F.col("given_name") == F.col(column)).select(*[F.col("given_key").alias(c) if c == column else F.col(c) for c in rows.columns])


def function_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a pointer constraint in its customer's function, of all four kinds, over five variables."""
    kind = "case o_orderstatus when 'F' then 'Address' when 'O' then 'Copy' else if(o_orderkey % 2 = 0, 'Load', 'Store') end as kind"
    return table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) as func", "concat('v', o_orderkey % 5) as src", "concat('v', (o_orderkey div 5) % 5) as dst", kind)


def field_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as a pointer constraint in its order's function, between places with up to two fields."""
    place = lambda a, b: f"concat('_', {a} % 3, case l_linenumber % 3 when 0 then '' when 1 then concat('.', {b} % 2) else concat('.', {b} % 2, '.', {a} % 2) end)"
    kind = "case l_returnflag when 'A' then 'Address' when 'N' then 'Copy' else if(l_linestatus = 'O', 'Load', 'Store') end as kind"
    return table(spark, sf_dir, "lineitem").selectExpr("concat('o', l_orderkey) as func", f"{place('l_partkey', 'l_suppkey')} as src", f"{place('l_suppkey', 'l_partkey')} as dst", kind)


def flows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """copies, calls and parameters: customers are functions of two parameters; their orders copy, or call another customer's function."""
    n = max(1, table(spark, sf_dir, "customer").count())
    o = table(spark, sf_dir, "orders").selectExpr("concat('c', o_custkey) as func", "o_orderstatus", f"concat('c', (o_orderkey * 31 + o_custkey) % {n}) as callee", "concat('_', o_orderkey % 4) as src", "concat('_', (o_orderkey div 4) % 4) as dst", "concat('_', (o_orderkey div 16) % 4) as dest")
    calls = o.where("o_orderstatus = 'P'").select("func", "callee", F.array("src", "dst").alias("args"), "dest")
    functions = o.select("func").union(o.select("callee")).distinct()
    return o.where("o_orderstatus != 'P'").select("func", "src", "dst"), calls, functions.select("func", F.explode(F.array(F.lit("_1"), F.lit("_2"))).alias("local"))


def customer_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a call from its customer to another one: (src, dst)."""
    n = max(1, table(spark, sf_dir, "customer").count())
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + F.col("o_custkey")) % n).alias("dst"))


K = "CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS INTEGER)"
SQL = {
    "trace": f"trace AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS idx, CAST(user_id % 8 AS INTEGER) AS tid, CAST({K} % 16 AS VARCHAR) AS var, CASE WHEN event_type IN ('view', 'click') THEN 'load' ELSE 'store' END AS kind FROM events WHERE event_type <> 'error')",
    "access": "access AS (SELECT l_orderkey AS state, CAST(l_partkey % 64 AS VARCHAR) AS location, l_suppkey AS thread, l_returnflag = 'R' AS write, l_linenumber AS block, concat(l_partkey, ':', l_suppkey) AS span, CASE WHEN l_returnflag = 'R' THEN 'UnsafeWrite' ELSE 'UnsafeRead' END AS op, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem)",
    "calls": "calls AS (SELECT CAST(o_custkey % 997 AS INTEGER) AS caller, CAST((o_orderkey * 31 + o_custkey) % 997 AS INTEGER) AS callee, CASE o_orderpriority WHEN '1-URGENT' THEN 'spawn' WHEN '2-HIGH' THEN 'scope_spawn' ELSE 'direct' END AS site_kind, CAST(o_orderkey AS VARCHAR) AS location, CAST(o_orderkey % 3 AS INTEGER) AS dest_local FROM orders)",
    "lock_links": "lock_links AS (SELECT o_custkey AS a, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 10000000000 + o_orderkey // 2 ELSE 20000000000 + o_orderkey END AS b FROM orders)",
    "constraints": "cons AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'Address' ELSE 'Copy' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'a' || (o_orderkey % 211) ELSE 'v' || (o_custkey % 211) END AS src, CASE o_orderstatus WHEN 'F' THEN 'v' || (o_custkey % 211) ELSE 'v' || (o_orderkey % 211) END AS dst FROM orders)",
    "function_constraints": "cons AS (SELECT 'c' || o_custkey AS func, 'v' || (o_orderkey % 5) AS src, 'v' || ((o_orderkey // 5) % 5) AS dst, CASE o_orderstatus WHEN 'F' THEN 'Address' WHEN 'O' THEN 'Copy' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Load' ELSE 'Store' END END AS kind FROM orders)",
    "field_constraints": "cons AS (SELECT DISTINCT 'o' || l_orderkey AS func, '_' || (l_partkey % 3) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || (l_suppkey % 2) ELSE '.' || (l_suppkey % 2) || '.' || (l_partkey % 2) END AS src, '_' || (l_suppkey % 3) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '.' || (l_partkey % 2) ELSE '.' || (l_partkey % 2) || '.' || (l_suppkey % 2) END AS dst, CASE l_returnflag WHEN 'A' THEN 'Address' WHEN 'N' THEN 'Copy' ELSE CASE WHEN l_linestatus = 'O' THEN 'Load' ELSE 'Store' END END AS kind FROM lineitem)",
    "flows": "o AS (SELECT 'c' || o_custkey AS func, o_orderstatus AS status, 'c' || ((o_orderkey * 31 + o_custkey) % greatest((SELECT count(*) FROM customer), 1)) AS callee, '_' || (o_orderkey % 4) AS src, '_' || ((o_orderkey // 4) % 4) AS dst, '_' || ((o_orderkey // 16) % 4) AS dest FROM orders), calls AS (SELECT DISTINCT func, callee, src, dst, dest FROM o WHERE status = 'P'), copies AS (SELECT DISTINCT func, src, dst FROM o WHERE status <> 'P' AND src <> dst), functions AS (SELECT func FROM o UNION SELECT callee FROM o)",
    "customer_calls": "edges AS (SELECT DISTINCT o_custkey AS src, (o_orderkey * 31 + o_custkey) % greatest((SELECT count(*) FROM customer), 1) AS dst FROM orders)",
    "memory_ops": f"memory_ops AS (SELECT user_id AS state, {K} % 16 AS var, CASE WHEN event_type IN ('view', 'click') THEN 'load' ELSE 'store' END AS kind, (['Relaxed', 'Release', 'Acquire', 'AcqRel', 'SeqCst'])[CAST(event_id % 5 AS INTEGER) + 1] AS ordering, lpad(CAST(event_id AS VARCHAR), 12, '0') AS span FROM events WHERE event_type <> 'error')",
    "endpoints": f"endpoints AS (SELECT user_id * 1000 + {K} AS site, event_id AS endpoint, CASE WHEN event_type IN ('view', 'click') THEN 'sender' ELSE 'receiver' END AS role FROM events)",
}
