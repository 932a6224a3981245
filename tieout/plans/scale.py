"""Queries over files read by splits, components of graphs, sums of any length, large groups and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_path
from ..operators import reconcile
from ..operators.strong import strong_components
from ..sources import drafts
from ..model import table_of
from .catalogue import frame, one, query


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus || chr(10) || 'says "' || o_orderpriority || '", twice' || chr(13) || chr(10) || CAST(o_custkey AS VARCHAR) AS note,
CAST(o_custkey AS VARCHAR) AS customer, 3 AS n_cells FROM orders""")
def csv_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as delimited text with line ends and quotes inside of cells, and read back cell by cell."""
    o = frame(spark, sf_dir, "orders")
    note = F.concat("o_orderstatus", F.lit('\nsays ""'), "o_orderpriority", F.lit('"", twice\r\n'), F.col("o_custkey").cast("string"))
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), note, F.lit('",'), F.col("o_custkey").cast("string"))
    path = shared_path(spark, "orders-csv")
    o.select(line.alias("value")).write.option("lineSep", "\n").text(path)
    cells = drafts.read_drafts(spark, path).where("kind = 'cell'")
    pick = lambda i: F.max(F.when(F.col("column") == i, F.col("value")))
    return cells.groupBy("path", "row").agg(pick(1).alias("k"), pick(2).alias("note"), pick(3).alias("customer"), F.count(F.lit(1)).cast("int").alias("n_cells")).drop("path", "row")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS s, (c_custkey * c_custkey + 7) % (SELECT max(c_custkey) + 1 FROM customer) AS t FROM customer),
r(s, t) AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON r.t = e.s), n AS (SELECT s AS node FROM e UNION SELECT t FROM e)
SELECT CAST(node AS BIGINT) AS node, CAST(coalesce(min(b.s), node) AS BIGINT) AS component, count(b.s) > 0 AS cyclic FROM n LEFT JOIN r a ON a.s = node LEFT JOIN r b ON b.s = a.t AND b.t = node GROUP BY node""")
def strong_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer leads to another one by a rule; those that a path leads back to are cyclic."""
    c = frame(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    n = c.agg((F.max("k") + 1).alias("n"))
    edges = c.crossJoin(F.broadcast(n)).select(F.col("k").alias("source"), ((F.col("k") * F.col("k") + 7) % F.col("n")).alias("target"))
    return strong_components(edges)


@query("""SELECT o_orderstatus, CAST(sum(o_orderkey) AS VARCHAR) || lpad(CAST(sum(o_custkey) AS VARCHAR), 59, '0') AS whole,
CAST(sum(o_orderkey) AS VARCHAR) || lpad(CAST(sum(o_custkey) AS VARCHAR), 59, '0') || '.' || lpad(CAST(sum(o_custkey) AS VARCHAR), 140, '0') AS long FROM orders GROUP BY 1""")
def long_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of numbers of sixty and of two hundred digits."""
    whole = F.concat(F.col("o_orderkey").cast("string"), F.lpad(F.col("o_custkey").cast("string"), 59, "0"))
    long = F.concat(whole, F.lit("."), F.lpad(F.col("o_custkey").cast("string"), 140, "0"))
    t = table_of(frame(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", whole.alias("whole"), long.alias("long")), "orders", ["o_orderstatus", "whole", "long"], F.col("o_orderkey"))
    return one(t, {"op": "aggregate", "by": ["o_orderstatus"], "metrics": {"whole": {"op": "sum", "column": "whole"}, "long": {"op": "sum", "column": "long"}}}).rows()


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'most' ELSE CAST(l_suppkey % 20 AS VARCHAR) END AS g, CAST(l_partkey AS HUGEINT) AS p FROM lineitem),
s AS (SELECT *, 100000007 * p AS up, CAST(sum(p) OVER (PARTITION BY g) AS HUGEINT) AS total FROM w),
r AS (SELECT *, up // total AS share, row_number() OVER (PARTITION BY g ORDER BY up % total DESC, 'lines:' || CAST(CAST(l_orderkey AS BIGINT) * 10 + l_linenumber AS VARCHAR)) AS rank FROM s),
t AS (SELECT *, share + CASE WHEN rank <= 100000007 - sum(share) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS got FROM r)
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(CAST(got AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))::VARCHAR AS share,
CAST(got AS VARCHAR) AS long_share FROM t""")
def allocate_large_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group holds a third of all lines; the second split has weights of thirty digits and more."""
    g = F.when(F.col("l_orderkey") % 3 == 0, "most").otherwise((F.col("l_suppkey") % 20).cast("string"))
    far = F.concat(F.col("l_partkey").cast("string"), F.lit("0" * 30))
    lines = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", g.alias("g"), F.col("l_partkey").alias("p"), far.alias("far"))
    t = table_of(lines, "lines", ["l_orderkey", "l_linenumber", "g", "p", "far"], F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber"))
    split = lambda w, total, to, scale: {"op": "allocate", "by": ["g"], "weight": w, "total": {"literal": total}, "column": to, "scale": scale}
    return one(t, split("p", "1000000.07", "share", 2), split("far", "100000007", "long_share", 0), {"op": "select", "columns": ["l_orderkey", "l_linenumber", "share", "long_share"]}).rows()


@query("""WITH x AS (SELECT 'statement' AS side, o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders
UNION ALL SELECT 'journal', o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) + CAST((o_orderkey % 3 - 1) * 0.01 AS DECIMAL(18,2)) FROM orders WHERE o_orderkey % 4 <> 0),
c AS (SELECT *, count(*) FILTER (side = 'journal') OVER w AS nj, count(*) FILTER (side = 'statement') OVER w AS ns, max(CASE WHEN side = 'journal' THEN id END) OVER w AS cj FROM x WINDOW w AS (ORDER BY a RANGE BETWEEN 0.01 PRECEDING AND 0.01 FOLLOWING)),
p AS (SELECT l.id AS l, r.id AS r FROM c l JOIN c r ON l.side = 'statement' AND r.side = 'journal' AND l.nj = 1 AND r.ns = 1 AND l.cj = r.id),
f AS (SELECT * FROM c WHERE NOT (side = 'statement' AND id IN (SELECT l FROM p)) AND NOT (side = 'journal' AND id IN (SELECT r FROM p))),
i AS (SELECT 'matched' AS status, 1 AS s, 1 AS j FROM p UNION ALL SELECT 'missing', 1, 0 FROM f WHERE side = 'statement' AND nj = 0 UNION ALL SELECT 'missing', 0, 1 FROM f WHERE side = 'journal' AND ns = 0
UNION ALL SELECT 'needs_input', count(*) FILTER (side = 'statement'), count(*) FILTER (side = 'journal') FROM f WHERE (side = 'statement' AND nj > 0) OR (side = 'journal' AND ns > 0) HAVING count(*) > 0)
SELECT status, count(*) AS items, CAST(sum(s) AS BIGINT) AS n_statement, CAST(sum(j) AS BIGINT) AS n_journal FROM i GROUP BY 1""")
def recon_one_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records share one account, currency and date: amounts alone tell them apart."""
    o = frame(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("x"))
    shared = {"account": F.lit("1"), "currency": F.lit("EUR"), "date": F.lit("2025-01-01"), "reference": F.lit(""), "batch": F.lit(""), "issue": F.lit(None).cast("string")}
    side = lambda df, name, amount: df.select(F.concat(F.lit(name), F.col("o_orderkey").cast("string")).alias("id"), F.lit(name).alias("side"), amount.cast("decimal(38,12)").alias("amount"), *[c.alias(n) for n, c in shared.items()])
    rows = side(o, "statement", F.col("x")).unionByName(side(o.where("o_orderkey % 4 <> 0"), "journal", F.col("x") + ((F.col("o_orderkey") % 3 - 1) * F.lit("0.01").cast("decimal(3,2)"))))
    items = reconcile.matched(rows, "0.01", mode="composite", composite_confirmed=True)
    return items.groupBy("status").agg(F.count(F.lit(1)).alias("items"), F.sum("n_statement").alias("n_statement"), F.sum("n_journal").alias("n_journal"))
