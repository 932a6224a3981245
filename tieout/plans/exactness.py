"""Queries over exact arithmetic, allocation, positions and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import POS, ROW, table_of
from ..operators import edits
from ..sources import reports
from .catalogue import COL, LIT, NET, OP, M, customers, frame, lines, one, orders, query

#: DuckDB: the quotient of whole numbers a and b in units, rounded half to even.
HALF_EVEN = "CASE WHEN 2 * ({a} % {b}) > {b} OR (2 * ({a} % {b}) = {b} AND ({a} // {b}) % 2 = 1) THEN {a} // {b} + 1 ELSE {a} // {b} END".format


def cents(c: str) -> str:
    return f"CAST({M(c)} * 100 AS HUGEINT)"


@query(f"""WITH x AS (SELECT l_returnflag, {cents("l_extendedprice")} * 1000000000000 AS a, {cents("l_quantity")} AS b FROM lineitem),
q AS (SELECT l_returnflag, {HALF_EVEN(a="a", b="b")} AS u FROM x),
r AS (SELECT l_returnflag, {HALF_EVEN(a="u", b="10000000000")} AS v FROM q)
SELECT l_returnflag, CAST(CAST(sum(v) AS DECIMAL(38,0)) / 100 AS DECIMAL(24,2))::VARCHAR AS unit FROM r GROUP BY l_returnflag""")
def round_of_quotient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quotient to twelve digits, rounded again to two."""
    t = lines(spark, sf_dir, "l_returnflag", "l_extendedprice", "l_quantity")
    return one(t, {"op": "derive", "columns": {"u": OP("round", OP("divide", COL("l_extendedprice"), COL("l_quantity")))}}, {"op": "aggregate", "by": ["l_returnflag"], "metrics": {"unit": {"op": "sum", "column": "u"}}}).rows()


@query(f"""WITH x AS (SELECT l_suppkey, CAST({cents("l_extendedprice")} * 100000000 AS BIGINT) AS a, CAST({cents("l_quantity")} AS BIGINT) AS b FROM lineitem),
y AS (SELECT l_suppkey, (a // b) * 10000 + (a % b * 10000) // b AS w, a % b * 10000 % b AS r, b FROM x),
q AS (SELECT l_suppkey, sum(CASE WHEN 2 * r > b OR (2 * r = b AND w % 2 = 1) THEN w + 1 ELSE w END)::HUGEINT AS u FROM y GROUP BY 1)
SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, left(u::VARCHAR, -12) || '.' || right(u::VARCHAR, 12) AS unit FROM q""")
def sum_of_quotients(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lines(spark, sf_dir, "l_suppkey", "l_extendedprice", "l_quantity")
    return one(t, {"op": "derive", "columns": {"u": OP("divide", COL("l_extendedprice"), COL("l_quantity"))}}, {"op": "aggregate", "by": ["l_suppkey"], "metrics": {"unit": {"op": "sum", "column": "u"}}}).rows()


@query(f"""WITH x AS (SELECT o_orderkey, {cents("o_totalprice")} AS p FROM orders), q AS (SELECT o_orderkey, p, {HALF_EVEN(a="p * 1000000", b="300")} AS t FROM x)
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, ((t * 3 + p * 10000) // 1000000)::VARCHAR || '.' || lpad(((t * 3 + p * 10000) % 1000000)::VARCHAR, 6, '0') AS back FROM q""")
def composed_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of a price, three times, beside the price."""
    t = orders(spark, sf_dir, "o_orderkey", "o_totalprice")
    third = OP("divide", COL("o_totalprice"), LIT("3"), scale=6)
    return one(t, {"op": "derive", "columns": {"back": OP("add", OP("multiply", third, LIT("3")), COL("o_totalprice"))}}, {"op": "select", "columns": ["o_orderkey", "back"]}).rows()


@query("""SELECT o_orderstatus, sum(CAST(CAST(o_orderkey AS VARCHAR) || '000000000000000000' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS HUGEINT))::VARCHAR AS total,
max(CAST(CAST(o_orderkey AS VARCHAR) || '000000000000000000' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS HUGEINT))::VARCHAR AS most FROM orders GROUP BY 1""")
def wide_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of thirty digits and more."""
    wide = F.concat(F.col("o_orderkey").cast("string"), F.lit("0" * 18), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    t = table_of(frame(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", wide.alias("w")), "orders", ["o_orderstatus", "w"], F.col("o_orderkey"))
    return one(t, {"op": "aggregate", "by": ["o_orderstatus"], "metrics": {"total": {"op": "sum", "column": "w"}, "most": {"op": "max", "column": "w"}}}).rows()


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, '0.' || lpad((CAST(o_orderkey AS HUGEINT) % 10000000 * (o_orderkey % 10000000))::VARCHAR, 14, '0') AS square,
'1' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '.5' AS far FROM orders""")
def long_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of seven digits after the point each, and sums of twenty-one digits before it."""
    part = F.concat(F.lit("0."), F.lpad((F.col("o_orderkey") % 10_000_000).cast("string"), 7, "0"))
    t = table_of(frame(spark, sf_dir, "orders").select("o_orderkey", part.alias("x")), "orders", ["o_orderkey", "x"], F.col("o_orderkey"))
    far = OP("add", COL("o_orderkey"), LIT("100000000000000000000.5"))
    return one(t, {"op": "derive", "columns": {"square": OP("multiply", COL("x"), COL("x")), "far": far}}, {"op": "select", "columns": ["o_orderkey", "square", "far"]}).rows()


@query(f"""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders WHERE {M("o_totalprice")} > 150000.005 AND CAST(CAST(o_orderkey AS VARCHAR) || '000000000000000000000000' AS DECIMAL(38,0)) <= 7000000000000000000000000000""")
def filter_wide_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.concat(F.col("o_orderkey").cast("string"), F.lit("0" * 24))
    t = table_of(frame(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", wide.alias("w")), "orders", ["o_orderkey", "o_totalprice", "w"], F.col("o_orderkey"))
    cmp = lambda k, op, v: {"column": k, "operator": op, "value": v, "type": "decimal"}
    return one(t, {"op": "filter", "where": {"all": [cmp("o_totalprice", "gt", "150000.005"), cmp("w", "lte", "7" + "0" * 27)]}}, {"op": "select", "columns": ["o_orderkey"]}).rows()


@query("""WITH w AS (SELECT c_nationkey, c_custkey, CAST(100000001 * c_custkey AS HUGEINT) AS up, CAST(sum(c_custkey) OVER (PARTITION BY c_nationkey) AS HUGEINT) AS s FROM customer),
r AS (SELECT *, up // s AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY up % s DESC, 'customer:' || c_custkey) AS rank FROM w),
t AS (SELECT *, share + CASE WHEN rank <= 100000001 - sum(share) OVER (PARTITION BY c_nationkey) THEN 1 ELSE 0 END AS got FROM r)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(-CAST(got AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2))::VARCHAR AS share FROM t""")
def allocate_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A debt dealt out among the customers of each nation, row by row."""
    t = customers(spark, sf_dir, "c_custkey", "c_nationkey")
    return one(t, {"op": "allocate", "by": ["c_nationkey"], "weight": "c_custkey", "total": LIT("-1000000.01"), "column": "share"}, {"op": "select", "columns": ["c_custkey", "share"]}).rows()


@query("""WITH w AS (SELECT c_custkey, CAST(c_custkey AS HUGEINT) * 7 AS up, CAST(sum(c_custkey) OVER () AS HUGEINT) AS s FROM customer),
r AS (SELECT *, up // s AS share, row_number() OVER (ORDER BY up % s DESC, 'customer:' || c_custkey) AS rank FROM w)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(share + CASE WHEN rank <= 7 - sum(share) OVER () THEN 1 ELSE 0 END AS VARCHAR) AS share FROM r""")
def allocate_without_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven units for all customers: ranks are worked out over ranges of rows."""
    return one(customers(spark, sf_dir, "c_custkey"), {"op": "allocate", "weight": "c_custkey", "total": LIT("7"), "column": "share", "scale": 0}).rows()


@query(f"""SELECT CAST(c_custkey AS BIGINT) AS c_custkey, row_number() OVER (ORDER BY {M("c_acctbal")} DESC, c_custkey) - 1 AS place FROM customer""")
def sort_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = one(customers(spark, sf_dir, "c_custkey", "c_acctbal"), {"op": "sort", "by": [{"column": "c_acctbal", "type": "decimal", "direction": "desc"}]})
    return r.output.df.select(F.col("c_custkey").cast("long").alias("c_custkey"), F.col(POS).alias("place"))


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS place, c_custkey FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(place AS BIGINT) AS place FROM r WHERE place BETWEEN 50 AND 99""")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of fifty."""
    r = one(customers(spark, sf_dir, "c_custkey", "c_mktsegment"), {"op": "sort", "by": [{"column": "c_mktsegment"}]})
    return r.output.df.where(F.col(POS).between(50, 99)).select("c_custkey", F.col(POS).alias("place"))


@query("""SELECT l_returnflag, c AS source_column, count(*) AS n FROM lineitem, (VALUES ('l_extendedprice'), ('l_discount')) AS v(c) GROUP BY ALL""")
def lineage_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source cells of each group's sum of derived values."""
    t = lines(spark, sf_dir, "l_returnflag", "l_extendedprice", "l_discount")
    r = one(t, {"op": "derive", "columns": {"net": NET}}, {"op": "aggregate", "by": ["l_returnflag"], "metrics": {"net": {"op": "sum", "column": "net"}}})
    refs = r.lineage(["net"]).groupBy("row_id", "source_column").agg(F.count(F.lit(1)).alias("n"))  # counted before they meet the few groups
    groups = r.output.df.select(F.col(ROW).alias("row_id"), "l_returnflag")
    return refs.join(groups, "row_id").groupBy("l_returnflag", "source_column").agg(F.sum("n").alias("n"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, 'customer:' || o_custkey AS source_row, 'c_name' AS source_column FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'orders:' || o_orderkey, 'o_orderstatus' FROM orders WHERE o_orderstatus = 'F'""")
def lineage_of_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus")
    steps = [{"op": "filter", "where": {"column": "o_orderstatus", "operator": "eq", "value": "F"}}, {"op": "lookup", "right": "customer", "on": [{"left": "o_custkey", "right": "c_custkey"}], "columns": {"c_name": "name"}}]
    label = {"op": "derive", "columns": {"label": OP("concat", COL("name"), COL("o_orderstatus"))}}
    r = one(t, *steps, label, more=[customers(spark, sf_dir, "c_custkey", "c_name")])
    refs = r.lineage(["label"]).join(r.output.df.select(F.col(ROW).alias("row_id"), "o_orderkey"), "row_id")
    return refs.select("o_orderkey", "source_row", "source_column")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n_filled, count(*) FILTER (o_orderstatus = 'O') AS n_open FROM orders GROUP BY 1""")
def lineage_of_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = orders(spark, sf_dir, "o_custkey", "o_orderstatus", "o_totalprice")
    r = one(t, {"op": "reshape", "mode": "pivot", "id_columns": ["o_custkey"], "variable_column": "o_orderstatus", "value_column": "o_totalprice", "columns": {"F": "filled", "O": "open"}})
    refs = r.output.df.select(F.col(ROW).alias("row_id"), "o_custkey").join(r.lineage(["filled", "open"]), "row_id", "left")
    return refs.groupBy("o_custkey").agg(F.count_if(F.col("column_key") == "filled").alias("n_filled"), F.count_if(F.col("column_key") == "open").alias("n_open"))


@query("""SELECT c_mktsegment, count(*) AS n_sources FROM customer GROUP BY 1""")
def manifest_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many source cells the manifest lists for each segment's number of customers."""
    r = one(customers(spark, sf_dir, "c_mktsegment", "c_custkey"), {"op": "aggregate", "by": ["c_mktsegment"], "metrics": {"n": {"op": "count"}}})
    m = reports.source_manifest(r.output, ["n"]).join(r.output.df.select(F.col(ROW).alias("row_id"), "c_mktsegment"), "row_id")
    return m.select("c_mktsegment", F.size("sources").cast("long").alias("n_sources"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment AS original, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE 'SECOND' END AS effective, 'ann' AS corrected_by FROM customer WHERE c_custkey % 7 = 0""")
def cell_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh segment was corrected twice; the second correction counts, a null too."""
    t = customers(spark, sf_dir, "c_custkey", "c_mktsegment")
    base = t.df.where(F.col("c_custkey") % 7 == 0)
    made = base.select(F.col(ROW).alias("row_id"), F.lit("c_mktsegment").alias("column_key"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"), "c_custkey")
    value = F.when(F.col("seq") == 1, "FIRST").when(F.col("c_custkey") % 14 != 0, "SECOND")
    corrections = made.select("row_id", "column_key", value.alias("value"), "seq", F.lit("ann").alias("actor_id"), F.lit("typo").alias("reason"))
    return edits.provenance(t, corrections).join(t.df.select(F.col(ROW).alias("row_id"), "c_custkey"), "row_id").select("c_custkey", "original", "effective", "corrected_by")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 14 <> 0 THEN 'SECOND' WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0""")
def edited_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections laid over a table, and rows left out for a reason; those without a reason stay."""
    t = customers(spark, sf_dir, "c_custkey", "c_mktsegment")
    made = t.df.where(F.col("c_custkey") % 7 == 0).select(F.col(ROW).alias("row_id"), F.lit("c_mktsegment").alias("column_key"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"), "c_custkey")
    value = F.when(F.col("seq") == 1, "FIRST").when(F.col("c_custkey") % 14 != 0, "SECOND")
    t = edits.set_cells(t, made.select("row_id", "column_key", value.alias("value"), "seq"))
    out = t.df.select(F.col(ROW).alias("row_id"), F.when(F.col("c_custkey") % 11 == 0, "closed").otherwise("").alias("reason"))
    return edits.exclude_rows(t, out).df.select("c_custkey", "c_mktsegment")


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(max(CASE WHEN event_id % 5 = 0 THEN event_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS parent FROM events""")
def narrative_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row goes with the last record before it: here every fifth event is one."""
    t = table_of(frame(spark, sf_dir, "events"), "e", ["event_id"], F.col("event_id"))
    got = edits.narrative_parents(t, F.col("event_id") % 5 == 0)
    return got.select(F.substring_index(ROW, ":", -1).alias("event_id"), F.substring_index("parent", ":", -1).alias("parent"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS issue_id, o_orderkey % 6 IN (0, 3) OR o_orderkey % 6 = 5 AS resolved FROM orders""")
def repaired_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An issue of two cells is closed when both were corrected: every third is; one of another kind keeps its state."""
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("issue_id"), (F.col("o_orderkey") % 6).alias("m"))
    issues = o.select("issue_id", F.when(F.col("m") == 5, "other").otherwise("spreadsheet_error").alias("code"), F.lit(2).alias("n_cells"), (F.col("m").isin(2, 5)).alias("resolved"))
    scope = o.select("issue_id", F.col("issue_id").alias("row_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("column_key"), "m")
    done = scope.where("m % 3 = 0 or (m = 1 and column_key = 'a')").select("row_id", "column_key", F.lit("ann").alias("actor_id"))
    return edits.repaired(issues, scope.drop("m"), done).select("issue_id", "resolved")
