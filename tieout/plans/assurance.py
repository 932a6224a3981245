"""Queries over reviews, reconciliation of mapped tables, requirements, packs, tasks and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning
from ..model import ROW, table_of
from ..operators import pack, proposals, reconcile, requirements, review, tasks
from ..operators.steps import together
from ..sources import blocks, reports
from .catalogue import M, customers, frame, lines, orders, query, side

def _checked(sources: list[review.Source], *checks: dict, **config) -> review.Review:
    return review.run_review(sources, {"checks": [{"confirmed": True, **c} for c in checks], **config})


@query("""SELECT CAST('names' AS VARCHAR) AS check_id, 'difference' AS status, 'not_listed' AS code, CAST(o_custkey AS VARCHAR) AS k, count(*) AS n_records, least(count(*), 12) AS n_shown
FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey""")
def review_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected row stands behind a finding; its evidence are the first twelve."""
    right = table_of(frame(spark, sf_dir, "customer").where("c_custkey % 3 <> 0"), "customer", ["c_custkey"], F.col("c_custkey"))
    r = _checked([review.Source(orders(spark, sf_dir, "o_orderkey", "o_custkey")), review.Source(right)], {"id": "names", "kind": "reference", "left": side("orders", "o_custkey"), "right": side("customer", "c_custkey")})
    found = r.findings.where("check_id = 'names'").select("check_id", "status", "code", F.col("key")[0].alias("k"), "match_key")
    n = r.records.groupBy("match_key").agg(F.count(F.lit(1)).alias("n_records"))
    shown = r.evidence().groupBy("match_key").agg(F.count(F.lit(1)).alias("n_shown"))
    return found.join(n, "match_key").join(shown, "match_key").drop("match_key")


@query("""SELECT 'blank' AS check_id, 'needs_input' AS status, 'blank_reference' AS code WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey % 10 = 0)
UNION ALL SELECT 'errors', 'needs_input', 'error_cell' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 5 = 0)
UNION ALL SELECT 'excluded', 'needs_input', 'exclusion_without_reason' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 7 = 0)
UNION ALL SELECT 'formulas', 'needs_input', 'formula_unverified' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 4 = 0)
UNION ALL SELECT 'group', 'needs_input', 'blank_group' WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey % 10 = 0)
UNION ALL SELECT 'incomplete', 'needs_input', 'coverage_incomplete' UNION ALL SELECT 'no_column', 'needs_input', 'columns_missing'
UNION ALL SELECT 'page', 'needs_input', 'extraction_unconfirmed' UNION ALL SELECT 'repeated', 'needs_input', 'repeated_reference' WHERE (SELECT count(*) - count(DISTINCT c_nationkey) FROM customer) > 0
UNION ALL SELECT 'unconfirmed', 'needs_input', 'unconfirmed' UNION ALL SELECT 'unlike', 'needs_input', 'scopes_differ'
UNION ALL SELECT 'fine', 'passed', 'passed' WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey IS NULL)""")
def review_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be judged needs input, by cause, and never passes."""
    o, c = frame(spark, sf_dir, "orders"), frame(spark, sf_dir, "customer")
    named = lambda name: table_of(o, name, ["o_orderkey", "o_custkey", "o_totalprice"], F.col("o_orderkey"))
    holed = table_of(c.select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_custkey")).alias("k"), "c_nationkey", "c_acctbal"), "holed", ["k", "c_nationkey", "c_acctbal"], F.col("c_custkey"))
    cells = lambda name, m, formula, error: named(name).df.where(F.col("o_orderkey") % m == 0).select(F.col(ROW).alias("row_id"), F.lit("o_custkey").alias("column_key"), F.lit(formula).cast("string").alias("formula"), F.lit(False).alias("verified"), F.lit(error).alias("error"))
    out = named("excluded").df.where(F.col("o_orderkey") % 7 == 0).select(F.col(ROW).alias("row_id"), F.lit(" ").alias("reason"))
    sources = [
        review.Source(named("fine")), review.Source(holed), review.Source(named("incomplete"), complete=False), review.Source(named("page"), media_type="application/pdf"), review.Source(named("excluded"), excluded=out),
        review.Source(named("formulas"), cells=cells("formulas", 4, "A1+1", False)), review.Source(named("errors"), cells=cells("errors", 5, None, True)),
    ]
    need = lambda name, **more: {"id": name, "kind": "required", "left": side(name if name in ("incomplete", "page", "excluded", "formulas", "errors", "fine") else "fine", "o_custkey"), **more}
    listed = lambda name, right, **more: {"id": name, "kind": "reference", "left": side("fine", "o_custkey"), "right": side("holed", right), **more}
    totals = {"id": "group", "kind": "totals", "left": side("fine", "o_totalprice", group_by=["o_custkey"]), "right": side("holed", "c_acctbal", group_by=["k"])}
    r = _checked(
        sources, need("fine"), need("incomplete"), need("page"), need("excluded"), need("formulas"), need("errors"), need("unconfirmed", confirmed=False), {"id": "no_column", "kind": "required", "left": side("fine", "nothing")},
        listed("blank", "k"), listed("repeated", "c_nationkey"), listed("unlike", "k", left=side("fine", "o_custkey", group_by=["o_orderkey"])), totals,
    )
    return r.findings.where("kind not in ('coverage', 'formula_scope')").select("check_id", "status", "code")


@query(f"""WITH l AS (SELECT o_custkey AS k, sum({M("o_totalprice")} / 8) AS a, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT o_custkey AS k, sum({M("o_totalprice")} / 8 + CASE WHEN o_orderkey % 100 = 0 THEN 0.5 ELSE 0 END) AS b FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1)
SELECT CAST(k AS VARCHAR) AS k, CASE WHEN b IS NULL THEN 'group_missing' WHEN a = b THEN 'totals_agree' ELSE 'totals_differ' END AS code, CAST(CASE WHEN a = b THEN 0 ELSE n + CASE WHEN b IS NULL THEN 0 ELSE n END END AS BIGINT) AS n_rows,
 CAST(CAST(a AS DECIMAL(24,5)) AS VARCHAR) AS observed, CAST(CAST(b AS DECIMAL(24,5)) AS VARCHAR) AS expected FROM l LEFT JOIN r USING (k)""")
def review_totals_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with all their digits, equal only where they are."""
    eighth = (F.col("o_totalprice").cast("decimal(18,2)") / 8).cast("decimal(18,5)")
    o = frame(spark, sf_dir, "orders").withColumn("x", eighth)
    left = table_of(o.select("o_orderkey", "o_custkey", F.col("x").cast("string").alias("x")), "left", ["o_custkey", "x"], F.col("o_orderkey"))
    more = F.when(F.col("o_orderkey") % 100 == 0, F.lit("0.5").cast("decimal(2,1)")).otherwise(F.lit("0.0").cast("decimal(2,1)"))
    right = table_of(o.where("o_custkey % 5 <> 0").select("o_orderkey", "o_custkey", (F.col("x") + more).cast("decimal(18,5)").cast("string").alias("x")), "right", ["o_custkey", "x"], F.col("o_orderkey"))
    r = _checked([review.Source(left), review.Source(right)], {"id": "t", "kind": "totals", "left": side("left", "x", group_by=["o_custkey"]), "right": side("right", "x", group_by=["o_custkey"])})
    return r.findings.where("check_id = 't'").select(F.col("key")[0].alias("k"), "code", "n_rows", "observed", "expected")


@query("""SELECT 'invoices' AS left_table, 'investor_id' AS left_column, 'Investor listing' AS right_table, count(*) AS shared, (SELECT count(DISTINCT o_custkey) FROM orders) AS left_values
FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)""")
def review_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list that a column seems to refer to: same concept, values once each, a title that says so, and enough values in common."""
    o = frame(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("investor_id"), F.col("o_totalprice").alias("amount"))
    c = frame(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("investor_id"), F.col("c_name").alias("investor_name"))
    small = c.where("investor_id % 4 = 1").select("investor_id")
    made = [table_of(o, "invoices", ["investor_id", "amount"], F.col("o_orderkey"))]
    for df, name in ((c, "Investor listing"), (small, "Investor mapping")):
        made.append(table_of(df, name, df.columns, F.col("investor_id")))
    r = review.run_review([review.Source(t, source_id=t.table_id) for t in made], {"table_headers": [{"dataset_id": t.table_id, "header_row_id": None} for t in made]})
    rows = [(s["left"]["dataset_id"], s["left"]["column"], s["right"]["dataset_id"], s["shared"], s["left_values"]) for s in r.suggestions if s["left"]["dataset_id"] == "invoices"]
    return spark.createDataFrame(rows, "left_table string, left_column string, right_table string, shared long, left_values long")


@query("""WITH o AS (SELECT count(*) AS n, min(o_orderkey) AS k, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS f, count(*) FILTER (WHERE o_orderkey % 18 = 0) AS v FROM orders),
h AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
SELECT 'ledger' AS dataset_id, 'ready' AS status, CAST(NULL AS VARCHAR) AS header, '' AS issues, n AS n_rows, n AS n_data, f AS n_formulas, f - v AS n_unverified FROM o
UNION ALL SELECT 'unclear', 'needs_input', NULL, 'no_header,coverage_incomplete', n, n, 0, 0 FROM o
UNION ALL SELECT 'headed', 'suggested', 'headed:' || h.k, '', n, n - 4, 0, 0 FROM o, h WHERE i = 4
UNION ALL SELECT 'chosen', 'ready', 'chosen:' || h.k, '', n, n - 2, 0, 0 FROM o, h WHERE i = 2
UNION ALL SELECT 'twice', 'needs_input', NULL, 'several_headers', n, n, 0, 0 FROM o""")
def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that name concepts, a row that does, two rows that do, a row that a person chose, and nothing that does."""
    base = frame(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.col("o_totalprice").cast("string").alias("b"))
    first = [r.o_orderkey for r in base.orderBy("o_orderkey").limit(5).collect()]
    names = lambda keys: base.select("o_orderkey", F.when(F.col("o_orderkey").isin(*keys), "Account id").otherwise(F.col("a")).alias("a"), F.when(F.col("o_orderkey").isin(*keys), "Amount").otherwise(F.col("b")).alias("b"))
    made = lambda df, name, keys=("a", "b"): table_of(df, name, list(keys), F.col("o_orderkey"))
    ledger = made(base.withColumnsRenamed({"a": "account_id", "b": "amount"}), "ledger", ("account_id", "amount"))
    cells = ledger.df.where(F.col("_pos") % 9 == 0).select(F.col(ROW).alias("row_id"), F.lit("amount").alias("column_key"), F.lit("A1").alias("formula"), (F.col("_pos") % 18 == 0).alias("verified"), F.lit(False).alias("error"))
    sources = [review.Source(ledger, cells=cells), review.Source(made(base, "unclear"), complete=False), review.Source(made(names(first[3:4]), "headed")), review.Source(made(names(first[3:4]), "chosen")), review.Source(made(names(first[1:3]), "twice"))]
    got = [(s.table.table_id, review.profile(s, {"chosen": f"chosen:{first[1]}"})) for s in sources]
    rows = [(n, p.status, p.header, ",".join(p.issues), p.n_rows, p.n_data, p.n_formulas, p.n_unverified) for n, p in got]
    return spark.createDataFrame(rows, "dataset_id string, status string, header string, issues string, n_rows long, n_data long, n_formulas long, n_unverified long")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[reconcile.Ledger, reconcile.Ledger]:
    """A bank's statement with debits and credits, and a journal of cash and fees whose accounts are looked up.

    Every 9th journal row is a fee, every 8th reference is missing from the list, every 13th row is blank.
    """
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("p"), F.col("o_orderkey").cast("string").alias("reference"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("x"), (F.col("o_custkey") % 8).cast("string").alias("place"))
    out = F.col("p") % 2 == 0
    bank = o.select("p", "reference", "date", F.when(~out, F.col("x")).alias("money_in"), F.when(out, F.concat(F.lit("-"), "x")).alias("money_out"), F.concat(F.lit("A"), "place").alias("account"))
    amount = F.when(out, F.concat(F.lit("("), "x", F.lit(")"))).otherwise(F.col("x"))
    blank = F.col("p") % 13 == 0
    book = o.select("p", *[F.when(~blank, c).alias(n) for n, c in (("reference", F.col("reference")), ("date", F.col("date")), ("amount", amount), ("place", F.col("place")), ("leg", F.when(F.col("p") % 9 == 0, "fee").otherwise("cash")))])
    places = spark.range(8).where("id <> 0").select(F.col("id").alias("p"), F.col("id").cast("string").alias("place"), F.concat(F.lit("A"), F.col("id").cast("string")).alias("account"))
    listed = table_of(places, "places", ["place", "account"], F.col("p"))
    left = reconcile.Ledger(table_of(bank, "bank", ["reference", "date", "money_in", "money_out", "account"], F.col("p")), "statement", {"reference": "reference", "date": "date", "credit": "money_in", "debit": "money_out", "account": "account"}, currency="eur", date_format="day_first")
    look = {"target": "account", "table": listed, "key_column": "place", "value_column": "account", "source_column": "place"}
    right = reconcile.Ledger(table_of(book, "book", ["reference", "date", "amount", "place", "leg"], F.col("p")), "journal", {"reference": "reference", "date": "date", "amount": "amount"}, currency="EUR", date_format="day_first", cash_leg={"column": "leg", "values": ["cash"]}, cash_leg_confirmed=True, lookups=(look,))
    return left, right


SIDES = f"""WITH s AS (SELECT o_orderkey AS p, 'A' || (o_custkey % 8) AS account, o_custkey % 8 AS place, {M("o_totalprice")} * CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END AS x FROM orders),
j AS (SELECT * FROM s WHERE p % 13 <> 0 AND p % 9 <> 0)"""


@query(f"""{SIDES} SELECT status, reason, count(*) AS items, CAST(sum(st) AS DECIMAL(18,2))::VARCHAR AS statement FROM (
SELECT CASE WHEN j.p IS NOT NULL AND j.place <> 0 THEN 'matched' ELSE 'needs_input' END AS status, CASE WHEN j.p IS NOT NULL AND j.place <> 0 THEN 'amounts_agree' ELSE 'no_counterpart' END AS reason, s.x AS st FROM s LEFT JOIN j ON s.p = j.p
UNION ALL SELECT 'needs_input', 'account_missing', 0 FROM j WHERE place = 0) GROUP BY ALL""")
def recon_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of debits, parentheses, a cash leg and looked-up accounts; records that can't be compared leave nothing missing."""
    left, right = _sides(spark, sf_dir)
    items = reconcile.matched(reconcile.ledger_records(left).unionByName(reconcile.ledger_records(right)), "0")
    return items.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("statement"), F.lit(0)).cast("decimal(18,2)").cast("string").alias("statement"))


@query("""SELECT 'bank' AS dataset_id, 'transaction' AS disposition, count(*) AS n FROM orders
UNION ALL SELECT 'book', CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 9 = 0 THEN 'excluded' ELSE 'transaction' END, count(*) FROM orders GROUP BY 2""")
def recon_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    return reconcile.coverage(left).unionByName(reconcile.coverage(right))


@query(f"""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'direction_unknown' END AS issue, CAST(sum(CASE WHEN o_orderkey % 4 <> 0 THEN {M("o_totalprice")} * 1000 * CASE WHEN o_orderkey % 4 = 1 THEN -1 ELSE 1 END END) AS DECIMAL(24,2))::VARCHAR AS total, count(*) AS n FROM orders GROUP BY 1""")
def recon_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in thousands, with their direction in a column of its own."""
    o = frame(spark, sf_dir, "orders")
    way = F.element_at(F.array(F.lit("?"), F.lit("D"), F.lit("C"), F.lit("C")), (F.col("o_orderkey") % 4).cast("int") + 1)
    t = table_of(o.withColumn("way", way), "book", ["o_orderkey", "o_totalprice", "way"], F.col("o_orderkey"))
    ledger = reconcile.Ledger(t, "journal", {"reference": "o_orderkey", "amount": "o_totalprice"}, account="A", currency="EUR", direction={"column": "way", "signs": {"D": -1, "C": 1}}, multiplier="1000")
    rows = reconcile.ledger_records(ledger)
    missing = F.when(F.col("issue").isNotNull(), F.lit("direction_unknown"))
    return rows.groupBy(missing.alias("issue")).agg(F.sum("amount").cast("decimal(24,2)").cast("string").alias("total"), F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT min(o_orderkey) AS k FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT count(DISTINCT c_mktsegment) AS n, min(c_mktsegment) AS v FROM customer WHERE c_custkey <= 3)
SELECT 'bank' AS dataset_id, 'transactions' AS kind, CAST(NULL AS VARCHAR) AS header, 5 AS n_columns, CAST(NULL AS VARCHAR) AS account, 'several_tables' AS issues FROM f
UNION ALL SELECT 'more', 'transactions', NULL, 5, NULL, 'several_tables' FROM f UNION ALL SELECT 'journal', 'transactions', NULL, 5, NULL, 'cash_leg_unconfirmed' FROM f
UNION ALL SELECT 'codes', CASE WHEN min(n_nationkey) = 0 THEN 'supporting' ELSE 'unclassified' END, NULL, 0, NULL, '' FROM nation
UNION ALL SELECT 'notes', 'unclassified', NULL, 0, NULL, 'no_transactions_chosen,amount_not_chosen,account_not_known,currency_not_known' FROM nation HAVING count(*) > 0
UNION ALL SELECT 'page', 'transactions', 'page:' || k, 3, CASE WHEN n = 1 THEN v END, CASE WHEN n = 1 THEN 'currency_not_known' ELSE 'account_not_known,currency_not_known' END FROM f, c
UNION ALL SELECT 'facts', 'supporting', NULL, 0, CASE WHEN n = 1 THEN v END, '' FROM c UNION ALL SELECT 'other', 'transactions', 'other:' || k, 3, NULL, 'account_not_known,currency_not_known' FROM f""")
def recon_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each table seems to be. The account of a page of transactions is on another page of its document, if that names one."""
    all_orders = frame(spark, sf_dir, "orders")
    o = all_orders.select("o_orderkey", F.col("o_orderkey").alias("transaction id"), F.col("o_orderdate").alias("value date"), F.col("o_totalprice").alias("amount"), F.lit("A1").alias("account"), F.lit("EUR").alias("currency"))
    keys = ["transaction id", "value date", "amount", "account", "currency"]
    bank = lambda name: table_of(o, name, keys, F.col("o_orderkey"))
    names = frame(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("p"), F.when(F.col("n_nationkey") == 0, "Legal Entity").otherwise(F.col("n_name")).alias("c1"))
    notes = names.select("p", F.concat(F.lit("note "), "c1").alias("c1"))
    # pages: the first row of one names its columns, the other has an account for each of three customers
    even = all_orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderdate").cast("string").alias("b"), F.col("o_totalprice").cast("string").alias("c"))
    least = F.broadcast(even.agg(F.min("o_orderkey").alias("least")))
    head = F.col("o_orderkey") == F.col("least")
    lines = even.join(least, head | F.lit(True)).select("o_orderkey", *[F.when(head, F.lit(n)).otherwise(F.col(k)).alias(k) for k, n in (("a", "Reference"), ("b", "Booking date"), ("c", "Amount"))])
    facts = frame(spark, sf_dir, "customer").where("c_custkey <= 3").select("c_custkey", F.lit("Account number").alias("k"), F.col("c_mktsegment").alias("v"))
    page = lambda name: table_of(lines, name, ["a", "b", "c"], F.col("o_orderkey"))
    made = [
        (review.Source(bank("bank"), source_id="s1"), "statement"), (review.Source(bank("more"), source_id="s1"), "statement"), (review.Source(bank("journal"), source_id="s2"), "journal"),
        (review.Source(table_of(names, "codes", ["c1"], F.col("p")), source_id="s3"), "statement"), (review.Source(table_of(notes.where("p > 0"), "notes", ["c1"], F.col("p")), source_id="s4"), "statement"),
        (review.Source(page("page"), source_id="s5", media_type=proposals.PDF), "statement"), (review.Source(table_of(facts, "facts", ["k", "v"], F.col("c_custkey")), source_id="s5", media_type=proposals.PDF), "statement"),
        (review.Source(page("other"), source_id="s6", media_type=proposals.PDF), "statement"),
    ]
    got = proposals.propose(made)
    return got.select("dataset_id", "kind", F.col("header_row_id").alias("header"), F.size("columns").alias("n_columns"), F.try_element_at("context", F.lit("account")).alias("account"), F.array_join("issues", ",").alias("issues"))


def _statement(spark: SparkSession, sf_dir: str, flag: str, name: str):
    """Lines of one return flag as a statement: odd lines are credits, even ones debits; R has both in every 1000th, A neither in every 1000th."""
    x = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    even, odd_one = F.col("l_linenumber") % 2 == 0, F.col("l_partkey") % 100 == 0
    credit = F.when(F.lit(name == "neither") & odd_one, None).when(~even | (F.lit(name == "both") & odd_one), x)
    debit = F.when(F.lit(name == "neither") & odd_one, None).when(even | (F.lit(name == "both") & odd_one), x)
    sign = F.when(F.lit(name == "signs") & odd_one, F.concat(F.lit("-"), debit)).otherwise(debit)
    base = frame(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return table_of(base.select("l_orderkey", credit.alias("credit"), sign.alias("debit"), F.lit("EUR").alias("currency")), name, ["credit", "debit", "currency"])


NET_SQL = f"sum(CASE WHEN l_linenumber % 2 = 1 THEN {M('l_extendedprice')} ELSE -{M('l_extendedprice')} END)"


@query(f"""WITH t AS (SELECT l_returnflag AS f, {NET_SQL} AS net, bool_or(l_partkey % 100 = 0) AS odd, bool_or(l_partkey % 100 = 0 AND l_linenumber % 2 = 0) AS even FROM lineitem GROUP BY 1)
SELECT 'plain' AS name, CASE WHEN 100 + net = 100 + net THEN 'PASS' END AS status FROM t WHERE f = 'N' UNION ALL SELECT 'off', 'FAIL' FROM t WHERE f = 'N'
UNION ALL SELECT 'both', CASE WHEN odd THEN 'NEEDS_REVIEW' ELSE 'PASS' END FROM t WHERE f = 'R' UNION ALL SELECT 'neither', CASE WHEN odd THEN 'MISSING_EVIDENCE' ELSE 'PASS' END FROM t WHERE f = 'A'
UNION ALL SELECT 'signs', CASE WHEN even THEN 'NEEDS_REVIEW' ELSE 'PASS' END FROM t WHERE f = 'N' UNION ALL SELECT 'currency', 'NEEDS_REVIEW' UNION ALL SELECT 'empty', 'MISSING_EVIDENCE'""")
def bank_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ways that a bank balance can come out; the closing balance of each is the one that its lines give."""
    d = F.col("l_extendedprice").cast("decimal(18,2)")
    nets = {r[0]: r[1] for r in frame(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(F.when(F.col("l_linenumber") % 2 == 1, d).otherwise(-d))).collect()}
    out = []
    for name, flag, more, context in (("plain", "N", "0", {}), ("off", "N", "0.01", {}), ("both", "R", "0", {}), ("neither", "A", "0", {}), ("signs", "N", "0", {}), ("currency", "N", "0", {"currency": ("currency", "USD")}), ("empty", "?", "0", {})):
        closing = str(nets.get(flag, 0) + 100 + (1 if more != "0" else 0))
        got = requirements.bank_balance(_statement(spark, sf_dir, flag, name), "100", closing, "credit", "debit", "positive", more, context)
        out.append(got.select(F.lit(name).alias("name"), "status"))
    return together(out)


@query(f"""WITH s AS (SELECT sum({M("l_extendedprice")}) AS b, sum({M("l_tax")}) AS t, sum({M("l_quantity")}) AS q FROM lineitem), f AS (SELECT round_even(CAST(b AS DECIMAL(20,2)) * 0.0175, 2) AS due, t, q FROM s)
SELECT 'fee' AS kind, CASE WHEN due = t THEN 'PASS' ELSE 'FAIL' END AS status, CAST(CAST(due AS DECIMAL(20,2)) AS VARCHAR) AS expected, CAST(t AS VARCHAR) AS actual FROM f UNION ALL SELECT 'fee_unapproved', 'NEEDS_REVIEW', NULL, NULL
UNION ALL SELECT 'total', 'PASS', CAST(q AS VARCHAR), CAST(q AS VARCHAR) FROM f UNION ALL SELECT 'total_off', 'FAIL', '1', CAST(q AS VARCHAR) FROM f UNION ALL SELECT 'total_missing', 'MISSING_EVIDENCE', NULL, NULL UNION ALL SELECT 'total_error', 'ERROR', NULL, NULL
UNION ALL SELECT 'required', 'FAIL', '0', CAST(count(*) AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT 'unique', CASE WHEN count(*) = count(DISTINCT o_custkey) THEN 'PASS' ELSE 'FAIL' END, '0', CAST(count(*) - count(DISTINCT o_custkey) AS VARCHAR) FROM orders""")
def requirement_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of each kind, judged on what the rows hold."""
    t = lines(spark, sf_dir, "l_extendedprice", "l_tax", "l_quantity")
    o = frame(spark, sf_dir, "orders")
    holed = table_of(o.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 10 != 0, "1").alias("one"), F.when(F.col("o_orderkey") % 10 != 0, "1").otherwise("x").alias("bad")), "o", ["o_custkey", "one", "bad"], F.col("o_orderkey"))
    quantity = str(frame(spark, sf_dir, "lineitem").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)"))).first()[0])
    rule = {"rule_id": "r", "rule_version": "1", "rule_approved_by": "ann"}
    kinds = {
        "fee": requirements.fee(t, "l_extendedprice", "l_tax", "0.0175", rule=rule, managers=["ann"]), "fee_unapproved": requirements.fee(t, "l_extendedprice", "l_tax", "0.0175", rule=rule, managers=["bob"]),
        "total": requirements.total(t, "l_quantity", quantity), "total_off": requirements.total(t, "l_quantity", "1"), "total_missing": requirements.total(holed, "one", "1"), "total_error": requirements.total(holed, "bad", "1"),
        "required": requirements.required_fields(holed, ["one"]), "unique": requirements.unique_rows(holed, ["o_custkey"]),
    }
    return together([df.select(F.lit(k).alias("kind"), "status", "expected", "actual") for k, df in kinds.items()])


@query("""SELECT CAST(o_custkey AS BIGINT) AS requirement_id, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'ERROR' WHEN bool_or(o_orderkey % 7 = 0 OR (o_orderkey % 7 <> 0 AND o_orderstatus <> 'P' AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 2000)) THEN 'MISSING_EVIDENCE'
 WHEN bool_or(o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) > DATE '1998-08-02') THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS status FROM orders GROUP BY 1""")
def requirement_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each customer: every 7th has no revision, P failed, those over 2000 days are stale, those of days to come and every 5th's table need review."""
    o = frame(spark, sf_dir, "orders").select(F.col("o_custkey").alias("r"), F.col("o_orderkey").alias("k"), "o_orderstatus", F.to_date("o_orderdate").alias("day"))
    asked = o.select(F.col("r").alias("requirement_id"), F.col("k").cast("string").alias("document_id"), F.lit(None).cast("string").alias("period"), F.lit(2000).alias("freshness_days"), F.lit(1).alias("minimum"))
    state = F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("EXTRACTED")
    here = o.where("k % 7 <> 0 or o_orderstatus = 'P'")
    made = here.select(F.col("k").cast("string").alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), F.col("k").cast("string").alias("source_id"), F.lit("h").alias("content_hash"), F.lit("2024").alias("period"), F.when(F.col("o_orderstatus") != "P", F.col("day")).otherwise(F.lit("1998-08-01").cast("date")).alias("as_of"), state.alias("state"), F.lit("text/csv").alias("media_type"), F.lit(True).alias("complete"), F.lit(None).cast("string").alias("verified_hash"))
    sets = here.select(F.col("k").cast("string").alias("source_id"), F.lit("d").alias("data_hash"), F.when(F.col("k") % 5 == 0, "old").otherwise("d").alias("accepted_hash"), F.lit(True).alias("accepted"))
    none = spark.createDataFrame([], "source_id string, severity string, resolved boolean")
    got = requirements.inputs(asked, made, sets, none, F.lit("1998-08-02").cast("date"))
    return got.select(F.col("requirement_id").cast("long").alias("requirement_id"), "status")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS row_id, 'o:' || first AS duplicate_of FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first FROM orders) WHERE o_orderkey <> first""")
def duplicate_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table_of(frame(spark, sf_dir, "orders"), "o", ["o_custkey"], F.col("o_orderkey"))
    return requirements.duplicates(t, ["o_custkey"]).select(F.substring_index("row_id", ":", -1).alias("row_id"), "duplicate_of")


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each order: capital, rate, fee and the statement's fee, one cent off in every 10th, and without a rate in every 17th."""
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("c"))
    fee = (F.col("c") * F.lit("0.02").cast("decimal(4,2)")).cast("decimal(20,4)")
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("string").alias("value_decimal")) for m, v in (("capital", F.col("c")), ("fee_rate", F.lit("0.02")), ("fee", fee), ("statement_fee", F.when(F.col("pack_id") % 10 == 0, fee + F.lit("0.01").cast("decimal(3,2)")).otherwise(fee)))])
    rows = o.select("pack_id", F.inline(cells)).where("not (pack_id % 17 = 0 and metric = 'fee_rate')")
    return rows.select("pack_id", "metric", F.lit("E").alias("entity_id"), F.lit("2024").alias("period"), F.lit("EUR").alias("currency"), "value_decimal", F.lit("RESOLVED").alias("status"), F.concat_ws(":", "pack_id", "metric").alias("observation_id"), F.lit("units").alias("raw_scale"))


@query("""SELECT id, status, count(*) AS n FROM (SELECT 'fee' AS id, CASE WHEN o_orderkey % 17 = 0 THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM orders
UNION ALL SELECT 'source_to_pack', CASE WHEN o_orderkey % 10 = 0 THEN 'FAIL' ELSE 'PASS' END FROM orders UNION ALL SELECT 'balance_sheet', 'NOT_APPLICABLE' FROM orders) GROUP BY ALL""")
def pack_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = {"approved": True, "approval_id": "a", "version": "1", "tolerance_version": "1", "tolerance": "0.001", "entity_id": "E", "period": "2024", "currency": "EUR"}
    return pack.relations(_facts(spark, sf_dir), rule).groupBy("id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 17 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 6 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) AS n FROM orders GROUP BY 1""")
def pack_source_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capital as its source had it, in thousands for every other pack; every 6th source says otherwise."""
    facts = _facts(spark, sf_dir)
    seen = facts.withColumn("raw_value", F.when((F.col("metric") == "capital") & (F.col("pack_id") % 6 == 0), "7").otherwise(F.col("value_decimal")))
    return pack.source_inputs(facts, seen).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'value' ELSE 'period' END AS column_key, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 GROUP BY 1 UNION ALL SELECT 'period', count(*) FROM orders WHERE o_orderkey % 35 = 0 AND false GROUP BY 1""")
def pack_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the declared layout: every 5th value has a comma, every 7th period a month too many."""
    o = frame(spark, sf_dir, "orders")
    odd = F.col("o_orderkey") % 5 == 0
    rows = o.select(F.col("o_orderkey").alias("position"), F.lit("E 1").alias("entity_id"), F.when((F.col("o_orderkey") % 7 == 0) & ~odd, "2024-13").otherwise("2024-12").alias("period"), F.lit("EUR").alias("currency"), F.lit("fee").alias("metric"), F.when(odd, "1,0").otherwise("10").alias("value"), F.lit("units").alias("scale"))
    return pack.schema_violations(rows).groupBy("column_key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'source_coverage' AS id, 'FAIL' AS status, count(*) AS n_expected, count(*) FILTER (o_orderkey % 50 <> 0) AS n_observed FROM orders""")
def pack_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("occurrence_id"))
    return pack.source_coverage(o, o.where("occurrence_id % 50 <> 0").withColumn("disposition", F.lit("ACCEPTED")))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE (o_orderkey * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END)::VARCHAR END AS value, o_orderkey % 4 = 3 AS open FROM orders""")
def pack_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw numbers in units, thousands and millions; every fourth has a scale that is none."""
    o = frame(spark, sf_dir, "orders")
    scale = F.element_at(F.array(*[F.lit(s) for s in ("units", "thousands", "millions", "dozens")]), (F.col("o_orderkey") % 4).cast("int") + 1)
    seen = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("occurrence_id"), F.lit("Total fee").alias("metric"), F.lit("E").alias("entity_id"), F.lit("2024-Q1").alias("period"), F.lit("EUR").alias("currency"), F.regexp_replace(F.format_number("o_orderkey", 0), ".0$", "$0").alias("raw_value"), scale.alias("raw_scale"), F.lit(None).cast("string").alias("formula"))
    got = pack.facts(seen, {"approved": True, "approval_id": "a", "version": "1", "entity_id": "E", "period": "2024-Q1", "mapping": {"Total fee": "fee"}})
    return got.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("value_decimal").alias("value"), (F.col("status") == "UNRESOLVED").alias("open"))


@query("""WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y') AS y FROM orders), t AS (SELECT k, CASE k % 4 WHEN 0 THEN y WHEN 1 THEN y || '-Q' || (k % 7) WHEN 2 THEN y || '-' || lpad(CAST(k % 15 AS VARCHAR), 2, '0')
  ELSE y || '-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(k % 33 AS VARCHAR), 2, '0') END AS text FROM o)
SELECT text, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN k % 7 BETWEEN 1 AND 4 WHEN 2 THEN k % 15 BETWEEN 1 AND 12 ELSE try_cast(text AS DATE) IS NOT NULL END AS valid, count(*) AS n FROM t GROUP BY ALL""")
def period_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, quarters, months and days made of each order's date and key, many of which are none."""
    k, y = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(k % 4 == 0, y).when(k % 4 == 1, F.concat(y, F.lit("-Q"), (k % 7).cast("string"))).when(k % 4 == 2, F.concat(y, F.lit("-"), two(k % 15))).otherwise(F.concat(y, F.lit("-"), two(k % 12 + 1), F.lit("-"), two(k % 33)))
    rows = frame(spark, sf_dir, "orders").select(text.alias("text"))
    return rows.groupBy("text", cleaning.valid_period(F.col("text")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'UNAVAILABLE' WHEN o_orderkey % 3 = 0 THEN 'DISAGREE' WHEN o_orderkey % 4 = 0 THEN 'UNKNOWN' ELSE 'AGREE' END AS agreement, count(*) AS n FROM orders GROUP BY 1""")
def reading_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of each price: paired by occurrence, the second without digits that don't matter, in another period, or without a number."""
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("x"))
    reading = lambda value, period: F.struct(F.lit("s").alias("scope"), F.lit("fee").alias("metric"), F.lit("E").alias("entity_id"), period.alias("period"), F.lit("EUR").alias("currency"), F.lit("units").alias("raw_scale"), value.alias("value_decimal"))
    first = o.select(F.col("k").alias("occurrence_id"), reading(F.col("x"), F.lit("2024")).alias("reading"))
    third, fourth = F.col("k") % 3 == 0, F.col("k") % 4 == 0
    second = o.where("k % 5 <> 0").select(F.col("k").alias("occurrence_id"), reading(F.when(fourth & ~third, "about").otherwise(F.concat(F.lit("0"), "x", F.lit("0"))), F.when(third, "2023").otherwise("2024")).alias("reading"))
    pairs = pack.paired_observations(first, second).withColumn("availability", F.lit("UNAVAILABLE"))
    return pack.agreement(pairs).groupBy("agreement").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'not_supported' WHEN o_orderkey % 4 = 1 THEN 'superseded' WHEN o_orderkey % 4 = 2 THEN 'wrong_number' ELSE 'new' END AS code, count(*) AS n FROM orders GROUP BY 1""")
def pack_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction of each fact: one in four has no evidence, one is of an old version, one is no number."""
    o = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    scope = [F.lit("E").alias("entity_id"), F.lit("2024").alias("period"), F.lit("EUR").alias("currency")]
    facts = o.select(F.col("k").alias("fact_id"), F.lit(1).alias("version"), F.lit("10").alias("value_decimal"), *scope, F.lit("RESOLVED").alias("status"))
    made = o.select(F.col("k").alias("fact_id"), F.when(F.col("k") % 4 == 1, 0).otherwise(1).alias("version"), F.when(F.col("k") % 4 == 2, "1e4").otherwise("11.5").alias("value_decimal"), *scope, F.lit("s").alias("source_id"))
    seen = o.select(F.lit("s").alias("source_id"), F.col("k").alias("fact_id"), F.lit("E").alias("entity_id"), F.when(F.col("k") % 4 == 0, "2023").otherwise("2024").alias("period"), F.lit("EUR").alias("currency"))
    now, refused = pack.corrected(facts, made, seen)
    return refused.select("code").unionByName(now.where("version = 2").select(F.lit("new").alias("code"))).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT status, CAST(cycle AS INTEGER) AS cycle, count(*) AS n FROM (SELECT CASE o_custkey % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'acknowledged' WHEN 2 THEN 'open' ELSE 'verification_pending' END AS status, CASE WHEN o_custkey % 4 = 2 THEN 2 ELSE 1 END AS cycle FROM (SELECT DISTINCT o_custkey FROM orders)) GROUP BY ALL""")
def task_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks after their events: some pass, some pass and fail again, some are answered; refused events change nothing."""
    o = frame(spark, sf_dir, "orders").select("o_custkey").distinct()
    courses = [["evaluated:FAIL", "acknowledge", "evaluated:PASS"], ["evaluated:FAIL", "resolve", "acknowledge"], ["evaluated:FAIL", "evaluated:PASS", "evaluated:FAIL"], ["evaluated:NEEDS_REVIEW", "request_verification", "evidence_received", "request_verification"]]
    course = F.element_at(F.array(*[F.array(*[F.lit(a) for a in c]) for c in courses]), (F.col("o_custkey") % 4).cast("int") + 1)
    events = o.select(F.col("o_custkey").cast("string").alias("task_id"), F.lit("requirement").alias("kind"), F.lit("accountant").alias("party"), F.posexplode(course).alias("seq", "action"), F.lit("f").alias("fingerprint"))
    return tasks.task_states(events).groupBy("status", "cycle").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'ann' ELSE 'own' END AS recipient, count(*) AS n FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0 GROUP BY 1""")
def task_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third request is an investor's and not released, so a manager hears of it; nobody hears of their own action; repeats count once."""
    o = frame(spark, sf_dir, "orders")
    mine = F.col("o_orderkey") % 3 == 0
    events = o.select(F.col("o_orderkey").cast("string").alias("task_id"), F.lit(1).alias("cycle"), F.explode(F.array(F.lit("overdue"), F.lit("overdue"))).alias("event"), F.lit("own").alias("owner"), F.when(mine, "investor").otherwise("accountant").alias("party"), F.lit(False).alias("released"), F.when(F.col("o_orderkey") % 5 == 0, "own").alias("actor"))
    members = spark.createDataFrame([("ann", "account_manager"), ("own", "accountant")], "actor_id string, party string")
    return tasks.notices(events, members).groupBy("recipient").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, CAST(date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) AS BIGINT) AS seconds FROM events GROUP BY 1""")
def work_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.work_metrics(frame(spark, sf_dir, "events")).select("event_type", "n", "seconds")


@query("""SELECT (SELECT count(*) FROM nation) AS n_sources, (SELECT count(*) FROM supplier) AS n_datasets, CAST((SELECT sum(s_suppkey) FROM supplier) AS BIGINT) AS n_rows, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS n_accepted, (SELECT count(*) FROM part WHERE p_size < 25) AS n_open""")
def collection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = frame(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("n_rows"), (F.col("s_acctbal") > 0).alias("accepted"))
    return tasks.collection_summary(frame(spark, sf_dir, "nation"), sets, frame(spark, sf_dir, "part").select((F.col("p_size") >= 25).alias("resolved")))


@query("""SELECT CAST(c_custkey AS BIGINT) AS block, v.r AS row, CAST(v.c AS INTEGER) AS "column", CASE WHEN v.r = 1 THEN CASE v.c WHEN 1 THEN 'name' ELSE 'segment' END WHEN v.c = 1 THEN c_name ELSE c_mktsegment || '|' END AS value
FROM customer, (VALUES (1, 1), (1, 2), (2, 1), (2, 2)) AS v(r, c) WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, v.r, v.c, CASE WHEN v.r = 1 THEN 'both' WHEN v.c = 1 THEN c_name ELSE c_mktsegment END FROM customer, (VALUES (1, 1), (2, 1), (2, 2)) AS v(r, c) WHERE c_custkey % 2 = 1""")
def block_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured responses of one block each: Markdown tables with escaped bars, and HTML tables with a cell over two columns."""
    c = frame(spark, sf_dir, "customer")
    mark = F.concat(F.lit("| name | segment |\n|---|:---:|\n| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit("\\| |"))
    page = F.concat(F.lit("<table><tr><th colspan=2>both</th></tr><tr><td>"), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit("</td></tr></table>"))
    content = F.when(F.col("c_custkey") % 2 == 0, mark).otherwise(page)
    bbox = F.struct(F.lit(0.1).alias("left"), F.lit(0.1).alias("top"), F.lit(0.5).alias("width"), F.lit(0.2).alias("height"), F.lit(1).alias("page"), F.lit(1).alias("original_page"))
    block = F.struct(F.lit("Table").alias("type"), content.alias("content"), bbox.alias("bbox"))
    body = F.to_json(F.struct(F.struct(F.lit("full").alias("type"), F.array(F.struct(F.array(block).alias("blocks"))).alias("chunks")).alias("result")))
    got = blocks.draft_blocks(c.select(F.col("c_custkey").alias("source"), body.alias("response")))
    return got.where("code is null").select(F.col("source").cast("long").alias("block"), F.col("row").cast("int").alias("row"), "column", "value")


@query("""SELECT p_brand AS check_key, count(*) AS n_rows, count(*) FILTER (p_partkey % 3 = 0) AS n_corrected FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) > 1) GROUP BY 1""")
def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows behind findings of repeated brands, with what people corrected in them."""
    t = table_of(frame(spark, sf_dir, "part"), "part", ["p_brand"], F.col("p_partkey"))
    r = _checked([review.Source(t)], {"id": "u", "kind": "unique", "left": side("part", "p_brand")})
    made = t.df.where(F.substring_index(ROW, ":", -1).cast("long") % 3 == 0).select(F.col(ROW).alias("row_id"), F.lit("p_brand").alias("column_key"), F.col("p_brand").alias("value"), F.lit("?").alias("original"), F.lit(1).alias("seq"), F.lit("ann").alias("actor_id"), F.lit("typo").alias("reason"))
    rows = reports.finding_records(r.findings.where("check_id = 'u'"), r.records, [t], made)
    return rows.groupBy(F.col("effective").alias("check_key")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("corrected_by").alias("n_corrected"))
