"""Queries over new revisions: what configurations carry over, what rules mean, what outputs depend on, and whose cells are whose."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import POS, ROW, table_of
from ..operators import browse, edits, rebinding, requirements, review, snapshots
from ..sources import readings
from .catalogue import M, customers, frame, orders, query, side

#: A table for each customer: its document is a nation, its title a segment and a number. Every 7th has a column more in the new revision, every 11th is gone, every 5th has another header.
REVISIONS = """WITH o AS (SELECT c_custkey AS k, c_nationkey AS d, c_mktsegment || (c_custkey % 4) AS t, c_name AS h FROM customer),
n AS (SELECT * FROM o WHERE k % 11 <> 0 AND k % 7 <> 0), c AS (SELECT o.k, o.h, count(n.k) AS n, min(n.k) AS m FROM o LEFT JOIN n ON o.d = n.d AND o.t = n.t GROUP BY ALL),
r AS (SELECT c.*, CASE WHEN n = 0 THEN 'withdrawn' WHEN n > 1 THEN 'ambiguous' WHEN k % 13 = 0 THEN 'headerless' WHEN m = k AND k % 5 <> 0 THEN 'kept' ELSE 'changed' END AS status FROM c)"""


def _revisions(spark: SparkSession, sf_dir: str):
    c = frame(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    title = F.concat("c_mktsegment", (k % 4).cast("string"))
    columns = F.array(F.lit("c1"), F.lit("c2"))
    old = c.select(F.concat(F.lit("old"), k.cast("string")).alias("table_id"), F.col("c_nationkey").cast("string").alias("document_id"), title.alias("title"), columns.alias("columns"))
    new = c.where(k % 11 != 0).select(F.concat(F.lit("new"), k.cast("string")).alias("table_id"), F.col("c_nationkey").cast("string").alias("document_id"), title.alias("title"), F.when(k % 7 == 0, F.array_append(columns, F.lit("c3"))).otherwise(columns).alias("columns"))
    row = lambda i, *cells: F.struct(F.lit(i).alias("i"), F.array(*[x.cast("string") for x in cells]).alias("values"))
    head = row(1, F.lit("Name"), F.col("c_name"))
    again = row(1, F.lit("Name"), F.when(k % 5 == 0, F.lit("other")).otherwise(F.col("c_name")))
    rows = lambda name, *parts: c.select(F.concat(F.lit(name), k.cast("string")).alias("table_id"), F.explode(F.array(*parts)).alias("r")).select("table_id", F.concat("table_id", F.lit(":"), F.col("r.i").cast("string")).alias("row_id"), F.col("r.i").alias("pos"), "r.values")
    old_rows = rows("old", head, row(2, F.lit("x"), F.col("c_acctbal")))
    new_rows = rows("new", row(0, F.lit("as of"), F.lit("today")), again, row(2, F.lit("x"), F.col("c_acctbal")))
    # rules name the header of every third table, and say of every thirteenth that it has none
    asked = c.where((k % 3 == 0) | (k % 13 == 0)).select(F.concat(F.lit("old"), k.cast("string")).alias("table_id"), F.when(k % 13 != 0, F.concat(F.lit("old"), k.cast("string"), F.lit(":1"))).alias("header_row_id"), F.lit(True).alias("confirmed"))
    return old, new, old_rows, new_rows, asked


@query(f"""{REVISIONS} SELECT 'old' || k AS table_id, status, CASE WHEN status = 'kept' THEN 'new' || m END AS new_table_id, n AS n_candidates, CASE WHEN status = 'kept' THEN 'new' || m || ':1' END AS new_header FROM r""")
def rebound_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which table of a new revision carries on which: kept, changed, ambiguous, withdrawn or without a header."""
    tables, headers = rebinding.rebound(*_revisions(spark, sf_dir))
    return tables.join(headers.select("table_id", F.col("new_header_row_id").alias("new_header")), "table_id", "left")


@query(f"""{REVISIONS} SELECT CASE WHEN status = 'kept' THEN 'new' || m ELSE 'old' || k END AS table_id, CASE WHEN k % 13 = 0 THEN NULL WHEN status = 'kept' THEN 'new' || m || ':1' ELSE 'old' || k || ':1' END AS header_row_id, status = 'kept' AS rebound
FROM r WHERE k % 3 = 0 OR k % 13 = 0""")
def rebound_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables and headers that rules name, after the new revision."""
    old, new, old_rows, new_rows, asked = _revisions(spark, sf_dir)
    return rebinding.carried(asked, *rebinding.rebound(old, new, old_rows, new_rows, asked)).select("table_id", "header_row_id", "rebound")


@query(f"""{REVISIONS} SELECT 'old' || k AS rule_id, status = 'kept' AS same FROM r""")
def rule_signatures_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on each old table, and the same rule where its table went: signatures are equal exactly where the table was kept."""
    old, new, old_rows, new_rows, _ = _revisions(spark, sf_dir)
    k = F.regexp_extract("table_id", "[0-9]+", 0).cast("long")
    asked = old.select("table_id", F.when(k % 13 != 0, F.concat("table_id", F.lit(":1"))).alias("header_row_id"), F.lit(True).alias("confirmed"))
    moved = rebinding.carried(asked.withColumn("rule_id", F.col("table_id")), *rebinding.rebound(old, new, old_rows, new_rows, asked))
    rules = lambda df: df.select("rule_id", F.lit("left").alias("part"), "table_id", "header_row_id", "confirmed", F.lit('{"kind":"required"}').alias("settings"))
    before = rebinding.rule_signatures(rules(asked.withColumn("rule_id", F.col("table_id"))), old, old_rows).withColumnRenamed("signature", "was")
    # a rule whose table is gone names one that the new revision doesn't have
    now = rebinding.rule_signatures(rules(moved), new, new_rows)
    return before.join(now, "rule_id").select("rule_id", (F.col("was") == F.col("signature")).alias("same"))


DIGEST = """sha256(concat_ws(':', count(*)::VARCHAR, sum(CAST('0x' || h[1:16] AS UBIGINT)::HUGEINT)::VARCHAR, sum(CAST('0x' || h[17:32] AS UBIGINT)::HUGEINT)::VARCHAR, sum(CAST('0x' || h[33:48] AS UBIGINT)::HUGEINT)::VARCHAR, sum(CAST('0x' || h[49:64] AS UBIGINT)::HUGEINT)::VARCHAR))"""


@query(f"""WITH h AS (SELECT l_returnflag || l_linestatus AS table_id, sha256('["' || l_orderkey || '","' || l_linenumber || '","' || l_suppkey || '"]') AS h FROM lineitem) SELECT table_id, count(*) AS n_rows, {DIGEST} AS sha256 FROM h GROUP BY 1""")
def table_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each group of lines, whatever their order."""
    l = frame(spark, sf_dir, "lineitem").withColumn("t", F.concat("l_returnflag", "l_linestatus"))
    return snapshots.table_digests(l, "t", ["l_orderkey", "l_linenumber", "l_suppkey"])


@query(f"""WITH t AS (SELECT 'c' || (o_custkey % 40) AS table_id, sha256('["' || o_orderkey || '","' || o_orderstatus || '"]') AS h FROM orders), d AS (SELECT table_id, {DIGEST} AS s FROM t GROUP BY 1),
e AS (SELECT 'out' || (CAST(substr(table_id, 2) AS INT) % 7) AS output_id, table_id, s FROM d), x AS (SELECT output_id, sha256('["' || table_id || '","' || s || '"]') AS h FROM e)
SELECT output_id, count(*) AS n_inputs, true AS known, {DIGEST} AS sha256 FROM x GROUP BY 1 UNION ALL SELECT 'lost', 2, false, NULL""")
def output_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each output depends on, through steps and checks: forty tables go into seven outputs by chains of two steps; one output names a table that isn't there."""
    o = frame(spark, sf_dir, "orders").withColumn("t", F.concat(F.lit("c"), (F.col("o_custkey") % 40).cast("string")))
    digests = snapshots.table_digests(o, "t", ["o_orderkey", "o_orderstatus"])
    t = digests.select("table_id", F.substring("table_id", 2, 9).cast("int").alias("k"))
    step = lambda i: F.concat(F.lit(f"step{i}:"), "table_id")
    out = F.concat(F.lit("out"), (F.col("k") % 7).cast("string"))
    edge = lambda a, b: t.select(a.alias("source"), b.alias("target"))
    edges = edge(F.col("table_id"), step(1)).unionByName(edge(step(1), step(2))).unionByName(edge(step(2), out)).unionByName(edge(F.col("table_id"), step(2)))
    lost = spark.sql("select 'gone' source, 'lost' target union all select 'c1', 'lost'")
    outputs = t.select(out.alias("output_id")).distinct().unionByName(lost.select(F.col("target").alias("output_id")).distinct())
    return snapshots.output_digests(edges.unionByName(lost), outputs, digests)


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders),
r AS (SELECT k, CASE k % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' ELSE 'same' END AS kind, s, CASE WHEN k % 3 = 0 THEN 'early' END AS early, CASE WHEN k % 5 = 0 THEN 'late' END AS late FROM o)
SELECT CAST(k AS VARCHAR) AS k, kind, CASE WHEN kind = 'same' THEN s END AS original, coalesce(late, CASE WHEN kind = 'same' THEN early END, CASE WHEN kind = 'same' THEN s ELSE 'early' END) AS effective,
CASE WHEN late IS NOT NULL THEN 'bob' WHEN kind = 'same' AND early IS NOT NULL THEN 'ann' END AS corrected_by, kind = 'same' AS original_available FROM r""")
def provenance_after_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells corrected before and after rows were split or merged: what came before is history, even where the value is the same."""
    base = table_of(frame(spark, sf_dir, "orders"), "orders", ["o_orderstatus"], F.col("o_orderkey"))
    k = F.col(POS)
    kind = F.when(k % 4 == 0, "split").when(k % 4 == 1, "merge").otherwise("same")
    fix = lambda where, value, seq, who: base.df.where(where).select(F.col(ROW).alias("row_id"), F.lit("o_orderstatus").alias("column_key"), F.lit(value).alias("value"), F.lit(seq).alias("seq"), F.lit(who).alias("actor_id"), F.lit("typo").alias("reason"))
    corrections = fix(k % 3 == 0, "early", 1, "ann").unionByName(fix(k % 5 == 0, "late", 3, "bob"))
    made = base.df.where(kind != "same").select(F.col(ROW).alias("row_id"), F.lit(2).alias("seq"))
    now = F.when(k % 5 == 0, "late").when(kind != "same", "early").when(k % 3 == 0, "early").otherwise(F.col("o_orderstatus"))
    effective = base.with_df(base.df.withColumn("o_orderstatus", now))
    got = edits.provenance(base, corrections, made, effective)
    of = base.df.select(F.col(ROW).alias("row_id"), k.cast("string").alias("k"), kind.alias("kind"))
    return got.join(of, "row_id").select("k", "kind", "original", "effective", "corrected_by", "original_available")


@query(f"""WITH s AS (SELECT c_custkey AS c, CAST(c_custkey AS VARCHAR) AS k, sum({M("o_totalprice")}) AS x FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY 1),
f AS (SELECT k, CASE WHEN x IS NULL THEN 'group_missing' ELSE 'totals_differ' END AS code FROM s), r AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS place FROM f WHERE code = 'totals_differ')
SELECT 'sums' AS check_id, k, code, CAST(place AS BIGINT) AS place, (SELECT count(*) FROM r) AS total FROM r WHERE place BETWEEN 20 AND 59""")
def finding_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page and more of the findings that say that a customer's totals differ, in order of the customers' keys."""
    r = review.run_review([review.Source(orders(spark, sf_dir, "o_custkey", "o_totalprice")), review.Source(customers(spark, sf_dir, "c_custkey", "c_acctbal"))], {"checks": [{"id": "sums", "confirmed": True, "kind": "totals", "left": side("orders", "o_totalprice", group_by=["o_custkey"]), "right": side("customer", "c_acctbal", group_by=["c_custkey"])}]})
    found, total = browse.results(r.findings, ["sums"], text="Totals_Differ", status="difference", offset=20, limit=40)
    return found.select("check_id", F.col("key")[0].alias("k"), "code", "place", F.lit(total).cast("long").alias("total"))


@query("""WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer), a AS (SELECT place // 50 * 50 AS first FROM r WHERE k = '777')
SELECT k, CAST(place AS BIGINT) AS place, CAST(first AS BIGINT) AS first, (SELECT count(*) FROM r) AS total FROM r, a WHERE place BETWEEN first AND first + 49""")
def page_of_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of fifty rows that one row is on."""
    found, first, total = browse.page(customers(spark, sf_dir, "c_custkey"), 50, row="customer:777")
    return found.select(F.col("c_custkey").alias("k"), "place", F.lit(first).cast("long").alias("first"), F.lit(total).cast("long").alias("total"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS dataset_id, c_name AS title FROM customer WHERE c_custkey = 7 UNION ALL SELECT CAST(min(c_custkey) AS VARCHAR), min(c_name) FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) = 1""")
def selected_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector that names one dataset finds it; one that names several finds none."""
    d = frame(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("dataset_id"), F.col("c_mktsegment").alias("document_id"), F.col("c_name").alias("title"))
    return requirements.chosen_dataset(d, dataset_id="7").unionByName(requirements.chosen_dataset(d, document_id="BUILDING")).select("dataset_id", "title")


#: Each document's captured response: every 11th has its result elsewhere, every 13th no id, every 17th isn't JSON; a second block has no place in every 5th, and a number for its text in every 7th.
CAPTURED = """WITH d AS (SELECT doc_id AS k, lang, source FROM documents), r AS (SELECT k, CASE WHEN k % 17 = 0 THEN 'malformed_response' WHEN k % 13 = 0 THEN 'malformed_response' WHEN k % 11 = 0 THEN 'result_elsewhere' END AS code FROM d)"""


def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), "lang", "source")
    k = F.col("k")
    block = lambda i, text, width, score: F.concat(F.lit('{"type":"Text","content":'), text, F.lit(f',"granular_confidence":{{"parse_confidence":{score}}},"bbox":{{"left":0.1,"top":0.{i},"width":'), width, F.lit(',"height":0.25,"page":1,"original_page":2}}'))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("none")), F.lit('"'))
    first, second = block(1, quoted(F.col("lang")), F.lit("0.5"), "0.9"), block(4, F.when(k % 7 == 0, "12").otherwise(quoted(F.col("source"))), F.when(k % 5 == 0, "0.95").otherwise("0.5"), '"high"')
    job = F.when(k % 13 == 0, '""').otherwise(F.concat(F.lit('"job'), k.cast("string"), F.lit('"')))
    body = F.concat(F.lit('{"job_id":'), job, F.lit(',"result":{"type":"'), F.when(k % 11 == 0, "url").otherwise("full"), F.lit('","chunks":[{"blocks":['), first, F.lit("]},{\"blocks\":["), second, F.when(k % 17 == 0, "").otherwise("]}]}}"))
    return d.select(F.concat(F.lit("v"), k.cast("string")).alias("document_version_id"), F.sha2(k.cast("string"), 256).alias("source_sha256"), body.alias("response"))


@query(f"""{CAPTURED} SELECT 'v' || k AS document_version_id, CASE WHEN code IS NULL AND k % 5 <> 0 AND k % 7 <> 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status, code, CASE WHEN code IS NULL THEN 2 ELSE 0 END AS n_blocks,
CASE WHEN code IS NULL AND (k % 5 = 0 OR k % 7 = 0) THEN 1 ELSE 0 END AS n_malformed FROM r""")
def response_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which captured responses are whole; one with a malformed block isn't available, though its other blocks are kept."""
    of = readings.responses(_captured(spark, sf_dir))
    return readings.availability(of, readings.observations(of)).select("document_version_id", "status", "code", "n_blocks", "n_malformed")


@query(f"""{CAPTURED}, b AS (SELECT r.k, i, CASE WHEN i = 0 THEN lang ELSE source END AS text, i = 1 AND (r.k % 5 = 0 OR r.k % 7 = 0) AS bad, i = 1 AND r.k % 7 = 0 AS number FROM r JOIN d ON r.k = d.k, (VALUES (0), (1)) AS v(i) WHERE code IS NULL)
SELECT 'v' || k AS document_version_id, CAST(i AS INT) AS block, CASE WHEN NOT number THEN coalesce(text, 'none') END AS raw_value, CASE WHEN bad THEN 'malformed_block' END AS code, CASE WHEN NOT bad THEN 2 END AS original_page, CASE WHEN NOT bad THEN (CASE i WHEN 0 THEN 0.35 ELSE 0.65 END)::DOUBLE END AS bottom,
CASE i WHEN 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS confidence_status, NOT bad AS has_ids FROM b""")
def response_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each block of each whole response says, and where."""
    seen = readings.observations(readings.responses(_captured(spark, sf_dir)))
    has = F.col("occurrence_id").isNotNull() & F.col("observation_id").isNotNull()
    return seen.select("document_version_id", "block", "raw_value", "code", "original_page", F.round(F.get("bbox", F.lit(3)), 9).alias("bottom"), "confidence_status", has.alias("has_ids"))


@query("""SELECT status, agreement, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'NOT_RUN' WHEN doc_id % 4 = 0 THEN 'UNAVAILABLE' ELSE 'COMPLETED' END AS status,
CASE WHEN doc_id % 3 <> 0 AND doc_id % 4 <> 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'UNKNOWN' WHEN doc_id % 7 = 0 THEN 'DISAGREE' ELSE 'AGREE' END END AS agreement FROM documents) GROUP BY ALL""")
def second_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one number of each document by two parsers: not wanted, not there, twice (which tells nothing), different or the same."""
    d = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("document_version_id"), F.col("n_chars").cast("string").alias("x"))
    reading = lambda value: F.struct(F.lit("s").alias("scope"), F.lit("length").alias("metric"), F.lit("E").alias("entity_id"), F.lit("2024").alias("period"), F.lit("EUR").alias("currency"), F.lit("units").alias("raw_scale"), value.alias("value_decimal"))
    rows = lambda df, value: df.select("document_version_id", F.concat(F.lit("o"), F.col("k").cast("string")).alias("occurrence_id"), reading(value).alias("reading"))
    there = d.where("k % 4 <> 0")
    second = rows(there, F.when(F.col("k") % 7 == 0, F.concat("x", F.lit("1"))).otherwise(F.concat("x", F.lit(".0")))).unionByName(rows(there.where("k % 5 = 0"), F.col("x")))
    asked = d.select("document_version_id", (F.col("k") % 3 != 0).alias("requested"), F.lit(True).alias("answered"))
    runs, pairs = readings.second_pass(rows(d, F.col("x")), second, asked)
    return runs.join(pairs, "document_version_id", "left").groupBy("status", "agreement").agg(F.count(F.lit(1)).alias("n"))
