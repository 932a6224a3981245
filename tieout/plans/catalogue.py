"""Named queries over the test tables, each with the SQL that its result is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning
from ..model import Table, table_of
from ..operators import checks, discovery, impact, pack, reconcile, requirements, review, revisions
from ..operators.recipe import run_recipe
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str, *keys: str) -> Table:
    return table_of(frame(spark, sf_dir, "lineitem"), "lineitem", list(keys))


def orders(spark: SparkSession, sf_dir: str, *keys: str) -> Table:
    return table_of(frame(spark, sf_dir, "orders"), "orders", list(keys), F.col("o_orderkey"))


def customers(spark: SparkSession, sf_dir: str, *keys: str) -> Table:
    return table_of(frame(spark, sf_dir, "customer"), "customer", list(keys), F.col("c_custkey"))


def parts(spark: SparkSession, sf_dir: str, *keys: str) -> Table:
    return table_of(frame(spark, sf_dir, "part"), "part", list(keys), F.col("p_partkey"))


def one(table: Table, *steps: dict, checks: list | None = None, more: list[Table] | None = None):
    """The recipe of steps after each other."""
    chain = [{"id": f"s{i}", "input": table.table_id if i == 0 else f"s{i - 1}"} | s for i, s in enumerate(steps)]
    return run_recipe([table, *(more or [])], {"version": 1, "steps": chain, "output": chain[-1]["id"] if chain else table.table_id, "checks": checks or []})


COL = lambda k: {"column": k}
LIT = lambda v: {"literal": v}
OP = lambda op, *args, **more: {"op": op, "args": list(args), **more}
M = "CAST({} AS DECIMAL(18,2))".format
NET = OP("multiply", COL("l_extendedprice"), OP("subtract", LIT("1"), COL("l_discount")))


@query(f"""SELECT l_returnflag, CAST(sum({M("l_extendedprice")} * (1 - {M("l_discount")})) AS VARCHAR) AS net, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY l_returnflag""")
def derive_net_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir, "l_returnflag", "l_extendedprice", "l_discount")
    return one(t, {"op": "derive", "columns": {"net": NET}}, {"op": "aggregate", "by": ["l_returnflag"], "metrics": {"net": {"op": "sum", "column": "net"}, "n": {"op": "count"}}}).rows()


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST({M("o_totalprice")} AS VARCHAR) AS o_totalprice, o_orderstatus FROM orders
WHERE {M("o_totalprice")} >= 100000 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '%URGENT%') AND NOT (o_orderstatus = 'P')""")
def filter_all_any_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = {"all": [{"column": "o_totalprice", "operator": "gte", "value": "100000", "type": "decimal"}, {"any": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}, {"column": "o_orderpriority", "operator": "contains", "value": "URGENT"}]}, {"not": {"column": "o_orderstatus", "operator": "eq", "value": "P"}}]}
    t = orders(spark, sf_dir, "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return one(t, {"op": "filter", "where": where}, {"op": "select", "columns": ["o_orderkey", "o_totalprice", "o_orderstatus"]}).rows()


@query("""SELECT o_orderstatus AS status, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def select_rename_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders(spark, sf_dir, "o_orderkey", "o_totalprice", "o_orderstatus")
    return one(t, {"op": "filter", "where": {"column": "o_orderstatus", "operator": "in", "value": ["F", "P"]}}, {"op": "select", "columns": ["o_orderstatus", "o_orderkey"]}, {"op": "rename", "columns": {"o_orderkey": "id", "o_orderstatus": "status"}}).rows()


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum({M("l_quantity")}) AS VARCHAR) AS qty, CAST(min({M("l_extendedprice")}) AS VARCHAR) AS low, CAST(max({M("l_extendedprice")}) AS VARCHAR) AS high, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY ALL""")
def aggregate_sum_count_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir, "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice")
    metrics = {"qty": {"op": "sum", "column": "l_quantity"}, "low": {"op": "min", "column": "l_extendedprice"}, "high": {"op": "max", "column": "l_extendedprice"}, "n": {"op": "count"}}
    return one(t, {"op": "aggregate", "by": ["l_returnflag", "l_linestatus"], "metrics": metrics}).rows()


@query(f"""SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, CASE WHEN count(*) = count(CASE WHEN l_tax > 0.005 THEN 1 END) THEN CAST(sum({M("l_quantity")}) AS VARCHAR) END AS qty FROM lineitem GROUP BY l_suppkey""")
def aggregate_poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line without tax has no ratio, so its supplier has no sum of what is derived from it."""
    t = lines(spark, sf_dir, "l_suppkey", "l_quantity", "l_tax")
    kept = OP("subtract", OP("add", COL("l_quantity"), OP("divide", LIT("0"), COL("l_tax"), scale=2)), LIT("0"))
    return one(t, {"op": "derive", "columns": {"x": kept}}, {"op": "aggregate", "by": ["l_suppkey"], "metrics": {"qty": {"op": "sum", "column": "x"}}}).rows()


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, c_name AS customer, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def lookup_many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = {"op": "lookup", "right": "customer", "on": [{"left": "o_custkey", "right": "c_custkey"}], "columns": {"c_name": "customer", "c_mktsegment": "segment"}}
    return one(orders(spark, sf_dir, "o_orderkey", "o_custkey"), step, {"op": "select", "columns": ["o_orderkey", "customer", "segment"]}, more=[customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment")]).rows()


@query("""WITH r AS (SELECT p_name, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY p_name)
SELECT CASE WHEN n IS NULL THEN 'unmatched_join' ELSE 'ambiguous_join' END AS code, count(*) AS n_rows FROM part LEFT JOIN r USING (p_name) WHERE n IS NULL OR n > 1 GROUP BY 1""")
def lookup_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = frame(spark, sf_dir, "part").where("p_size <= 25")
    right = table_of(small, "small", ["p_name", "p_brand"], F.col("p_partkey"))
    step = {"op": "lookup", "right": "small", "on": [{"left": "p_name", "right": "p_name"}], "columns": {"p_brand": "brand"}}
    r = one(parts(spark, sf_dir, "p_partkey", "p_name"), step, more=[right])
    return r.issues.where("severity = 'error'").groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(l_partkey AS VARCHAR) AS part FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def join_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = {"op": "join", "cardinality": "one_to_many", "right": "lineitem", "on": [{"left": "o_orderkey", "right": "l_orderkey"}], "columns": {"l_partkey": "part"}}
    return one(orders(spark, sf_dir, "o_orderkey"), step, more=[lines(spark, sf_dir, "l_orderkey", "l_partkey")]).rows()


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN {M("c_acctbal")} < 0 THEN 'owing' WHEN {M("c_acctbal")} >= 5000 AND c_mktsegment <> 'BUILDING' THEN 'large' WHEN {M("c_acctbal")} >= 5000 THEN NULL ELSE 'usual' END AS band FROM customer""")
def classify_balance_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    cmp = lambda op, v: {"column": "c_acctbal", "operator": op, "value": v, "type": "decimal"}
    rules = [{"when": cmp("lt", "0"), "value": "owing"}, {"when": cmp("gte", "5000"), "value": "large"}, {"when": {"all": [cmp("gte", "5000"), {"column": "c_mktsegment", "operator": "eq", "value": "BUILDING"}]}, "value": "builder"}]
    return one(customers(spark, sf_dir, "c_custkey", "c_acctbal", "c_mktsegment"), {"op": "classify", "column": "band", "rules": rules, "default": "usual"}, {"op": "select", "columns": ["c_custkey", "band"]}).rows()


@query(f"""SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(any_value({M("o_totalprice")}) AS VARCHAR) AS total, count(*) AS n_lines, count(*) AS within_a_cent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey""")
def allocate_order_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's total over its lines by quantity; what is allocated comes to the total again."""
    t = lines(spark, sf_dir, "l_orderkey", "l_quantity")
    join = {"op": "join", "how": "inner", "right": "orders", "on": [{"left": "l_orderkey", "right": "o_orderkey"}], "columns": {"o_totalprice": "total"}}
    r = one(t, join, {"op": "allocate", "by": ["l_orderkey"], "weight": "l_quantity", "total": COL("total"), "column": "share", "scale": 2}, more=[orders(spark, sf_dir, "o_orderkey", "o_totalprice")])
    exact = F.col("total").cast("double") * F.col("l_quantity").cast("double") / F.sum(F.col("l_quantity").cast("double")).over(Window.partitionBy("l_orderkey"))
    rows = r.output.df.withColumn("near", F.abs(F.col("share").cast("double") - exact) < 0.010001)
    return rows.groupBy("l_orderkey").agg(F.sum(F.col("share").cast("decimal(18,2)")).cast("decimal(18,2)").cast("string").alias("total"), F.count(F.lit(1)).alias("n_lines"), F.count_if("near").alias("within_a_cent"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, 'p_brand' AS field, p_brand AS text FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'p_size', CAST(p_size AS VARCHAR) FROM part""")
def melt_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one(parts(spark, sf_dir, "p_partkey", "p_brand", "p_size"), {"op": "reshape", "mode": "melt", "id_columns": ["p_partkey"], "value_columns": ["p_brand", "p_size"], "variable_column": "field", "value_column": "text"}).rows()


@query(f"""SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 1 THEN CAST(max({M("o_totalprice")}) FILTER (o_orderstatus = 'F') AS VARCHAR) END AS filled,
 CASE WHEN count(*) FILTER (o_orderstatus = 'O') = 1 THEN CAST(max({M("o_totalprice")}) FILTER (o_orderstatus = 'O') AS VARCHAR) END AS open FROM orders GROUP BY o_custkey""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders(spark, sf_dir, "o_custkey", "o_orderstatus", "o_totalprice")
    return one(t, {"op": "reshape", "mode": "pivot", "id_columns": ["o_custkey"], "variable_column": "o_orderstatus", "value_column": "o_totalprice", "columns": {"F": "filled", "O": "open"}}).rows()


@query(f"""SELECT s_name, CAST({M("s_acctbal")} AS VARCHAR) AS s_acctbal, row_number() OVER (ORDER BY s_nationkey, {M("s_acctbal")} DESC, s_suppkey) AS place FROM supplier""")
def sort_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(frame(spark, sf_dir, "supplier"), "supplier", ["s_name", "s_nationkey", "s_acctbal"], F.col("s_suppkey"))
    r = one(t, {"op": "sort", "by": [{"column": "s_nationkey", "type": "decimal"}, {"column": "s_acctbal", "type": "decimal", "direction": "desc"}]})
    nation = Window.partitionBy("s_nationkey").orderBy("_pos")
    before = r.output.df.groupBy(F.col("s_nationkey").cast("int").alias("n")).count().select("n", (F.sum("count").over(Window.orderBy("n")) - F.col("count")).alias("before"))
    ranked = r.output.df.withColumn("i", F.row_number().over(nation)).withColumn("n", F.col("s_nationkey").cast("int"))
    return ranked.join(F.broadcast(before), "n").select("s_name", "s_acctbal", (F.col("before") + F.col("i")).alias("place"))


@query(f"""SELECT l_returnflag, CAST(sum(round_even({M("l_extendedprice")} * {M("l_discount")}, 2)) AS VARCHAR) AS rounded FROM lineitem GROUP BY l_returnflag""")
def round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir, "l_returnflag", "l_extendedprice", "l_discount")
    return one(t, {"op": "derive", "columns": {"r": OP("round", OP("multiply", COL("l_extendedprice"), COL("l_discount")), scale=2)}}, {"op": "aggregate", "by": ["l_returnflag"], "metrics": {"rounded": {"op": "sum", "column": "r"}}}).rows()


@query("""WITH x AS (SELECT l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS HUGEINT) * 10000 AS a, CAST(CAST(l_quantity AS DECIMAL(18,2)) * 100 AS HUGEINT) AS b FROM lineitem),
q AS (SELECT l_suppkey, a // b AS w, a % b AS r, b FROM x)
SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(CAST(sum(CASE WHEN 2 * r > b OR (2 * r = b AND w % 2 = 1) THEN w + 1 ELSE w END) AS DECIMAL(38,0)) / 10000 AS DECIMAL(18,4))::VARCHAR AS unit FROM q GROUP BY l_suppkey""")
def divide_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir, "l_suppkey", "l_extendedprice", "l_quantity")
    return one(t, {"op": "derive", "columns": {"u": OP("divide", COL("l_extendedprice"), COL("l_quantity"), scale=4)}}, {"op": "aggregate", "by": ["l_suppkey"], "metrics": {"unit": {"op": "sum", "column": "u"}}}).rows()


@query("""SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, upper(p_brand) || ' / ' || lower(trim(p_type)) AS label, coalesce(p_name, '') AS name FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = OP("concat", OP("upper", COL("p_brand")), LIT(" / "), OP("lower", OP("trim", COL("p_type"))))
    return one(parts(spark, sf_dir, "p_partkey", "p_brand", "p_type", "p_name"), {"op": "derive", "columns": {"label": label, "name": OP("coalesce", COL("p_name"), LIT(""))}}, {"op": "select", "columns": ["p_partkey", "label", "name"]}).rows()


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def date_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("written"))
    t = table_of(df, "orders", ["o_orderkey", "written"], F.col("o_orderkey"))
    return one(t, {"op": "derive", "columns": {"day": OP("date", COL("written"), format="%d/%m/%Y")}}, {"op": "select", "columns": ["o_orderkey", "day"]}).rows()


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS amount FROM orders""")
def decimal_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written with a comma and grouped by points, read back."""
    written = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2), ",.", ".,")
    t = table_of(frame(spark, sf_dir, "orders").select("o_orderkey", written.alias("w")), "orders", ["o_orderkey", "w"], F.col("o_orderkey"))
    return one(t, {"op": "derive", "columns": {"amount": OP("decimal", COL("w"), decimal_separator=",", thousands_separator=".")}}, {"op": "select", "columns": ["o_orderkey", "amount"]}).rows()


@query("""SELECT 'required_value' AS code, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL
UNION ALL SELECT 'duplicate_key', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")
def check_required_and_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "documents").select("doc_id").join(frame(spark, sf_dir, "labels"), "doc_id", "left")
    a = one(table_of(docs, "documents", ["doc_id", "quality"], F.col("doc_id")), checks=[{"type": "required", "columns": ["quality"]}]).issues
    b = one(lines(spark, sf_dir, "l_orderkey", "l_linenumber"), checks=[{"type": "unique", "columns": ["l_orderkey", "l_linenumber"]}]).issues
    return a.unionByName(b).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH s AS (SELECT sum({M("l_quantity")}) AS q, sum({M("l_extendedprice")}) AS p, sum(CASE WHEN l_linenumber = 1 THEN {M("l_quantity")} ELSE 0 END) AS f, sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE {M("l_quantity")} END) AS r FROM lineitem)
SELECT 'near' AS id, 'total' AS type, 'lineitem' AS table_id, abs(q - 1530000) <= 20000 AS passed FROM s UNION ALL SELECT 'exactly', 'total', 'lineitem', q = 1530000 FROM s
UNION ALL SELECT 'sides', 'balance', 'lineitem', q = p FROM s UNION ALL SELECT 'firsts', 'balance', 'lineitem', abs(f - r) <= 900000 FROM s UNION ALL SELECT 'same', 'balance', 'lineitem', q = f + r FROM s""")
def check_total_and_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals against a figure and against each other, some of which fit."""
    l, first = frame(spark, sf_dir, "lineitem"), F.col("l_linenumber") == 1
    q = F.col("l_quantity").cast("decimal(18,2)")
    t = table_of(l.select("l_quantity", "l_extendedprice", F.when(first, q).otherwise(0).alias("first"), F.when(first, 0).otherwise(q).alias("rest"), q.alias("again")), "lineitem", ["l_quantity", "l_extendedprice", "first", "rest", "again"])
    total = {"type": "total", "column": "l_quantity", "expected": "1530000"}
    balance = lambda i, debit, credit, tolerance="0": {"id": i, "type": "balance", "debit": debit, "credit": credit, "tolerance": tolerance}
    asked = [{"id": "near", "tolerance": "20000", **total}, {"id": "exactly", **total}, balance("sides", "l_quantity", "l_extendedprice"), balance("firsts", "first", "rest", "900000"), balance("same", "l_quantity", "again")]
    return one(t, checks=asked).checks


@query("""SELECT 'difference' AS status, CAST(o_custkey AS VARCHAR) AS k0, count(*) AS n_rows FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment <> 'BUILDING') GROUP BY o_custkey""")
def check_reference_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = table_of(frame(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'"), "customer", ["c_custkey"], F.col("c_custkey"))
    return _findings([orders(spark, sf_dir, "o_custkey"), right], {"kind": "reference", "left": side("orders", "o_custkey"), "right": side("customer", "c_custkey")})


def side(dataset: str, *columns: str, **more) -> dict:
    return {"dataset_id": dataset, "columns": list(columns), "header_row_id": None, **more}


def _findings(tables: list[Table], check: dict) -> DataFrame:
    found = review.run_review([review.Source(t) for t in tables], {"checks": [{"id": "c", "confirmed": True, **check}]}).findings
    return found.where("check_id = 'c'").select("status", F.col("key")[0].alias("k0"), "n_rows")


@query("""SELECT 'difference' AS status, p_name AS k0, count(*) AS n_rows FROM part GROUP BY p_name HAVING count(*) > 1""")
def check_unique_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings([parts(spark, sf_dir, "p_name")], {"kind": "unique", "left": side("part", "p_name")})


@query(f"""WITH l AS (SELECT o_orderkey AS k, sum({M("o_totalprice")}) AS a FROM orders GROUP BY 1), r AS (SELECT l_orderkey AS k, sum({M("l_extendedprice")}) AS b FROM lineitem GROUP BY 1)
SELECT CASE WHEN a IS NULL OR b IS NULL OR abs(a - b) > 1000 THEN 'difference' ELSE 'passed' END AS status, CAST(k AS VARCHAR) AS k0, CAST(a AS VARCHAR) AS left_total, CAST(b AS VARCHAR) AS right_total FROM l FULL JOIN r USING (k)""")
def check_totals_order_vs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = {"id": "c", "confirmed": True, "kind": "totals", "tolerance": "1000", "left": side("orders", "o_totalprice", group_by=["o_orderkey"]), "right": side("lineitem", "l_extendedprice", group_by=["l_orderkey"])}
    tables = [review.Source(orders(spark, sf_dir, "o_orderkey", "o_totalprice")), review.Source(lines(spark, sf_dir, "l_orderkey", "l_extendedprice"))]
    found = review.run_review(tables, {"checks": [check]}).findings.where("check_id = 'c'")
    return found.select("status", F.col("key")[0].alias("k0"), F.col("observed").alias("left_total"), F.col("expected").alias("right_total"))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides made from orders: the journal lacks every 7th, has every 11th by a cent less, and every 13th twice."""
    o = frame(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("x"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    base = o.select(F.col("o_orderkey").cast("string").alias("reference"), (F.col("o_custkey") % 10).cast("string").alias("account"), F.lit("usd").alias("currency"), F.col("d").alias("date"), F.col("x").cast("string").alias("amount"), F.col("o_orderkey").alias("p"))
    less = F.when(F.col("p") % 11 == 0, (F.col("amount").cast("decimal(18,2)") - F.lit("0.01").cast("decimal(18,2)")).cast("string")).otherwise(F.col("amount"))
    journal = base.where("p % 7 <> 0").withColumn("amount", less).withColumn("i", F.explode(F.sequence(F.lit(1), F.when(F.col("p") % 13 == 0, 2).otherwise(1))))
    cols = {r: r for r in ("reference", "account", "currency", "date", "amount")}
    a = reconcile.records(table_of(base, "bank", list(cols), F.col("p")), "statement", cols)
    b = reconcile.records(table_of(journal, "book", list(cols), F.col("p") * 2 + F.col("i")), "journal", cols)
    return a.unionByName(b)


LEDGER = f"""WITH s AS (SELECT o_orderkey AS p, CAST(o_custkey % 10 AS VARCHAR) AS account, strftime(o_orderdate, '%Y-%m-%d') AS d, {M("o_totalprice")} AS x FROM orders),
j AS (SELECT p, account, d, CASE WHEN p % 11 = 0 THEN x - 0.01 ELSE x END AS x, i FROM s, (VALUES (1), (2)) AS v(i) WHERE p % 7 <> 0 AND (i = 1 OR p % 13 = 0))"""


@query(f"""{LEDGER} SELECT CASE WHEN n > 1 THEN 'needs_input' WHEN n = 0 THEN 'missing' WHEN abs(dx) <= 0.005 THEN 'matched' ELSE 'difference' END AS status, count(*) AS items, CAST(sum(CASE WHEN n = 1 THEN dx ELSE 0 END) AS DECIMAL(18,2))::VARCHAR AS difference
FROM (SELECT s.p, count(j.p) AS n, max(s.x - j.x) AS dx FROM s LEFT JOIN j ON s.p = j.p GROUP BY s.p) GROUP BY 1""")
def recon_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = reconcile.matched(_ledger(spark, sf_dir), "0.005")
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("difference"), F.lit(0)).cast("decimal(18,2)").cast("string").alias("difference"))


@query(f"""{LEDGER}, c AS (SELECT s.p AS sp, j.p AS jp, j.i AS ji FROM s JOIN j ON s.account = j.account AND s.d = j.d AND abs(s.x - j.x) <= 0.02),
m AS (SELECT sp, jp, ji FROM (SELECT *, count(*) OVER (PARTITION BY sp) AS a, count(*) OVER (PARTITION BY jp, ji) AS b FROM c) WHERE a = 1 AND b = 1),
rs AS (SELECT s.account, s.d, 1 AS st, EXISTS (SELECT 1 FROM c WHERE c.sp = s.p) AS near FROM s WHERE p NOT IN (SELECT sp FROM m)),
rj AS (SELECT j.account, j.d, 0 AS st, EXISTS (SELECT 1 FROM c WHERE c.jp = j.p AND c.ji = j.i) AS near FROM j WHERE (p, i) NOT IN (SELECT (jp, ji) FROM m)),
r AS (SELECT * FROM rs UNION ALL SELECT * FROM rj)
SELECT status, count(*) AS items, CAST(sum(ns) AS BIGINT) AS n_statement, CAST(sum(nj) AS BIGINT) AS n_journal FROM (SELECT 'matched' AS status, 1 AS ns, 1 AS nj FROM m UNION ALL SELECT 'missing', st, 1 - st FROM r WHERE NOT near
UNION ALL SELECT 'needs_input', sum(st), sum(1 - st) FROM r WHERE near GROUP BY account, d) GROUP BY status""")
def recon_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = reconcile.matched(_ledger(spark, sf_dir), "0.02", mode="composite", composite_confirmed=True)
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.sum("n_statement").alias("n_statement"), F.sum("n_journal").alias("n_journal"))


@query(f"""SELECT CASE WHEN count(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) > 1 THEN 'needs_input' ELSE 'batch' END AS kind, count(*) AS n_lines, CAST(CASE WHEN count(DISTINCT strftime(l_shipdate, '%Y-%m-%d')) = 1 THEN sum({M("l_extendedprice")}) END AS DECIMAL(18,2))::VARCHAR AS amount, CAST(l_orderkey AS VARCHAR) AS batch FROM lineitem GROUP BY l_orderkey""")
def recon_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frame(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("batch"), F.lit("1").alias("account"), F.lit("EUR").alias("currency"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("amount"))
    cols = {r: r for r in ("batch", "account", "currency", "date", "amount")}
    got = reconcile.batched(reconcile.records(table_of(df, "book", list(cols)), "journal", cols))
    return got.select(F.when(F.col("issue").isNotNull(), "needs_input").otherwise("batch").alias("kind"), F.col("n_rows").alias("n_lines"), F.when(F.col("issue").isNull(), F.col("amount").cast("decimal(18,2)").cast("string")).alias("amount"), "batch")


def _revised(spark: SparkSession, sf_dir: str) -> tuple[Table, Table]:
    """Customers, and a later revision: every 10th moved to another segment, every 17th gone, one in 19 one place on."""
    c = frame(spark, sf_dir, "customer")
    later = c.where("c_custkey % 17 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.lit("MOVED")).otherwise(F.col("c_mktsegment")))
    keys = ["c_custkey", "c_name", "c_mktsegment"]
    return table_of(c, "before", keys, F.col("c_custkey")), table_of(later, "after", keys, F.col("c_custkey") + F.when(F.col("c_custkey") % 19 == 0, 1_000_000).otherwise(0))


@query("""SELECT change, column_key, count(*) AS n FROM (
SELECT 'cell_changed' AS change, 'c_mktsegment' AS column_key FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 17 <> 0 AND c_mktsegment <> 'MOVED'
UNION ALL SELECT 'cell_removed', k FROM customer, (VALUES ('c_name'), ('c_mktsegment')) AS v(k) WHERE c_custkey % 17 = 0
UNION ALL SELECT 'row_moved', NULL FROM customer WHERE c_custkey % 19 = 0 AND c_custkey % 17 <> 0) GROUP BY ALL""")
def diff_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes, _ = revisions.keyed_diff(*_revised(spark, sf_dir), ["c_custkey"])
    return changes.groupBy("change", "column_key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT change, column_key, count(*) AS n FROM (
SELECT 'cell_changed' AS change, 'c_mktsegment' AS column_key FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0
UNION ALL SELECT 'cell_removed', k FROM customer, (VALUES ('c_custkey'), ('c_name'), ('c_mktsegment')) AS v(k) WHERE c_custkey % 17 = 0 OR c_custkey % 19 = 0
UNION ALL SELECT 'cell_added', k FROM customer, (VALUES ('c_custkey'), ('c_name'), ('c_mktsegment')) AS v(k) WHERE c_custkey % 19 = 0 AND c_custkey % 17 <> 0) GROUP BY ALL""")
def diff_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.positional_diff(*_revised(spark, sf_dir)).groupBy("change", "column_key").agg(F.count(F.lit(1)).alias("n"))


EDGES = """SELECT 'r' || r_regionkey AS source, 'n' || n_nationkey AS target FROM region JOIN nation ON r_regionkey = n_regionkey
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"""


@query(f"""WITH RECURSIVE e AS ({EDGES}), t(start, node, depth) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT start, e.target, depth + 1 FROM t JOIN e ON t.node = e.source)
SELECT start, CAST(depth AS INTEGER) AS depth, count(*) AS nodes FROM t WHERE depth > 0 GROUP BY ALL""")
def impact_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda n: frame(spark, sf_dir, n)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"))
    edges = edge(f("nation"), "r", "n_regionkey", "n", "n_nationkey").unionByName(edge(f("customer"), "n", "c_nationkey", "c", "c_custkey")).unionByName(edge(f("orders"), "c", "o_custkey", "o", "o_orderkey"))
    start = f("region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("start"))
    return impact.reached(edges, start).groupBy("start", "depth").agg(F.count(F.lit(1)).alias("nodes"))


@query("""WITH v AS (SELECT 'orders' AS t, 'o_custkey' AS c, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT 'lineitem', 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem
UNION ALL SELECT 'customer', 'c_custkey', CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'part', 'p_partkey', CAST(p_partkey AS VARCHAR) FROM part),
d AS (SELECT t, c, v, count(*) AS n FROM v GROUP BY ALL), s AS (SELECT t, c, count(*) AS size, max(n) AS most FROM d GROUP BY ALL)
SELECT l.t AS left_table, l.c AS left_column, r.t AS right_table, r.c AS right_column, count(*) AS shared, any_value(sl.size) AS left_values, any_value(sr.size) AS right_values FROM d l JOIN d r ON l.v = r.v AND l.t <> r.t JOIN s sl ON sl.t = l.t AND sl.c = l.c JOIN s sr ON sr.t = r.t AND sr.c = r.c AND sr.most = 1
GROUP BY l.t, l.c, r.t, r.c HAVING count(*) >= 0.2 * any_value(sl.size)""")
def suggest_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [discovery.distinct_values(frame(spark, sf_dir, t), t, [c]) for t, c in (("orders", "o_custkey"), ("lineitem", "l_partkey"), ("customer", "c_custkey"), ("part", "p_partkey"))]
    return discovery.suggested_references(v[0].unionByName(v[1]).unionByName(v[2]).unionByName(v[3]))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS task_id, CASE e WHEN 1 THEN 'overdue' ELSE 'escalated' END AS event, CAST(max(o_orderkey) AS BIGINT) AS last_order FROM orders, (VALUES (1), (2)) AS v(e)
WHERE o_orderstatus <> 'F' AND TIMESTAMP '1998-01-01' > o_orderdate + CASE e WHEN 1 THEN INTERVAL 0 DAY ELSE INTERVAL 30 DAY END GROUP BY ALL""")
def overdue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frame(spark, sf_dir, "orders")
    tasks = o.select(F.col("o_custkey").cast("string").alias("task_id"), F.col("o_orderkey").alias("cycle"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), F.col("o_orderdate").alias("due_at"), F.lit(30).alias("escalate_after"))
    return requirements.deadlines(tasks, F.lit("1998-01-01").cast("timestamp")).groupBy("task_id", "event").agg(F.max("cycle").alias("last_order"))


@query(f"""SELECT CASE WHEN o_orderstatus = 'P' THEN 'BLOCKED' WHEN o_orderpriority LIKE '1%' THEN 'NEEDS_REVIEW' ELSE 'READY' END AS route, CASE WHEN {M("o_totalprice")} >= 200000 OR o_custkey % 10 >= 8 THEN 'HIGH' ELSE 'STANDARD' END AS priority, count(*) AS n FROM orders GROUP BY ALL""")
def route_and_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frame(spark, sf_dir, "orders")
    packs = o.select(F.col("o_orderkey").alias("pack_id"), F.lit(True).alias("native"), F.lit(False).alias("unverifiable"), F.lit(True).alias("evidence_complete"), F.lit(True).alias("context_complete"), F.col("o_orderpriority").startswith("1").alias("unresolved"), F.lit("AGREE").alias("agreement"), F.lit(None).cast("string").alias("confidence"))
    status = F.when(F.col("o_orderstatus") == "P", "FAIL").otherwise("PASS")
    made = o.select(F.col("o_orderkey").alias("pack_id"), F.lit("fee").alias("id"), F.lit(True).alias("required"), status.alias("status"), F.lit(True).alias("applicable"), F.lit("").alias("justification"))
    routed = pack.routes(packs, made, ["fee"]).join(o, F.col("pack_id") == F.col("o_orderkey"))
    return routed.select("route", impact.priority(F.col("o_totalprice").cast("decimal(18,2)"), "200000", F.col("o_custkey") % 10, 8).alias("priority")).groupBy("route", "priority").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT CAST(doc_id AS BIGINT) AS doc_id, trim(regexp_replace(lower(regexp_replace(source || 'Ref' || lang, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS words,
 md5(CASE WHEN regexp_matches(text, '^[ \t\n\x0B\f\r]*[=+@-]|^[\t\r\n]') THEN chr(39) || text ELSE text END) AS safe
FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 9 = 0 THEN ' =' || text WHEN doc_id % 9 = 1 THEN chr(9) || text ELSE text END AS text FROM documents)""")
def label_words_and_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as cells, some of them made to look like formulas."""
    d = frame(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit(" ="), "text")).when(F.col("doc_id") % 9 == 1, F.concat(F.lit("\t"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", cleaning.label_words(F.concat("source", F.lit("Ref"), "lang")).alias("words"), F.md5(cleaning.formula_safe(text)).alias("safe"))


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, CAST(count(*) AS BIGINT) AS shown, CAST(max(event_id) AS BIGINT) AS last_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 12 GROUP BY user_id""")
def first_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(frame(spark, sf_dir, "events"), "events", ["user_id", "event_id"], F.col("event_id"))
    rows = checks.evidence(t.df, ["user_id"])
    return rows.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count(F.lit(1)).alias("shown"), F.max(F.col("event_id").cast("long")).alias("last_id"))


@query("""SELECT CASE WHEN a AND NOT coalesce(b, false) AND here THEN 'fixed' WHEN a AND NOT here THEN 'withdrawn' WHEN a AND b THEN 'outstanding' ELSE 'new' END AS change, count(*) AS n FROM (
SELECT o_orderkey, o_orderkey % 3 = 0 AS a, o_orderkey % 5 <> 0 AS here, o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 AS b FROM orders) WHERE a OR b GROUP BY 1""")
def finding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_key"))
    status = lambda m: F.when(F.col("match_key") % m == 0, "difference").otherwise("passed").alias("status")
    return checks.changes(o.select("match_key", status(3)), o.where("match_key % 5 <> 0").select("match_key", status(4))).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM events GROUP BY ALL""")
def ext_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the batch form of the hourly windows."""
    return windows.tumbling(frame(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the batch form of user sessions."""
    return windows.sessions(frame(spark, sf_dir, "events"))
