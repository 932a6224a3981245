"""Evidence requirements: whether documents are there and fit, six kinds of tests of their tables, and deadlines."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decimals
from ..functions.grammar import SCALES
from ..functions.sums import grouped_sums
from ..model import Table
from .checks import cell, later_rows, stripped

#: From the worst to the best; of several causes the first counts.
STATUS = ("ERROR", "FAIL", "MISSING_EVIDENCE", "NEEDS_REVIEW", "PASS")
#: Fixed value: a number of a requirement, which may have an exponent.
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def _read(table: Table, **keys: str) -> DataFrame:
    """The table's rows with, for each name, its key's plain number, and name_missing and name_wrong."""
    from ..functions.cleaning import plain_number

    df = table.df.withColumns({f"{name}_missing": F.coalesce(cell(k), F.lit("")) == "" for name, k in keys.items()})
    df = df.withColumns({name: F.when(~F.col(f"{name}_missing"), plain_number(cell(k))) for name, k in keys.items()})
    return df.withColumns({f"{name}_wrong": ~F.col(f"{name}_missing") & F.col(name).isNull() for name in keys})


VERDICT = "status string, expected string, actual string, difference string"


def _judged(table: Table, status: str | None, expected: Decimal | None, actual: Decimal | None, tolerance: str) -> DataFrame:
    """A row of VERDICT: the status that keeps sums from being compared, or what comparing them gives."""
    if status is None and (expected is None or actual is None):
        status = "ERROR"
    if status is None:
        apart = decimals.EXACT.subtract(actual, expected)
        row = ("PASS" if apart.copy_abs() <= Decimal(tolerance) else "FAIL", *(format(x, "f") for x in (expected, actual, apart)))
    else:
        row = (status, None, None, None)
    return table.df.sparkSession.createDataFrame([row], VERDICT)


def _first(*causes: tuple[bool, str]) -> str | None:
    """The status of the first cause that is there."""
    return next((status for there, status in causes if there), None)


def required_fields(table: Table, columns: list[str]) -> DataFrame:
    bad = reduce(Column.__add__, [F.count_if(stripped(cell(k)) == "") for k in columns])
    return _counted(table.df.agg(bad.alias("bad"), F.count(F.lit(1)).alias("n")))


def unique_rows(table: Table, columns: list[str]) -> DataFrame:
    bad = later_rows(table, columns).agg(F.count(F.lit(1)).alias("bad")).withColumn("_one", F.lit(1))
    return _counted(table.df.agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1)).join(bad, "_one"))


def duplicates(table: Table, columns: list[str]) -> DataFrame:
    """(row_id, duplicate_of): rows whose key came before, with the first row of the key."""
    from ..model import ROW

    return later_rows(table, columns).select(F.col(ROW).alias("row_id"), "duplicate_of")


def _counted(rows: DataFrame) -> DataFrame:
    bad = F.col("bad").cast("string")
    status = F.when(F.col("n") == 0, "MISSING_EVIDENCE").when(F.col("bad") > 0, "FAIL").otherwise("PASS")
    return rows.select(status.alias("status"), F.lit("0").alias("expected"), bad.alias("actual"), bad.alias("difference"))


def context_fails(table: Table, context: dict[str, tuple[str, str]]) -> Column:
    """An aggregate: whether a row has another value than the one that a column (currency or entity) must have throughout."""
    tests = [~cell(column).eqNullSafe(F.lit(value)) for column, value in context.values()]
    return F.coalesce(F.bool_or(reduce(Column.__or__, tests)), F.lit(False)) if tests else F.bool_or(F.lit(False))


def _totals(df: DataFrame, cells: dict[str, Column], others: dict[str, Column]) -> dict:
    """The one row of sums, as Decimals, and of others; counts of no rows are 0."""
    r = grouped_sums(df, {}, cells, others).first().asDict()
    return {k: Decimal(v) if k in cells and v is not None else 0 if v is None and k in ("n", "missing", "wrong") else v for k, v in r.items()}


def total(table: Table, column: str, expected: str, tolerance: str = "0", context: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The sum of a column against what it must be. Of the sums one row comes to the driver."""
    tolerance, expected = decimals.canonical_text(tolerance, negative=False), decimals.canonical_text(expected)
    df = _read(table, _x=column)
    others = {"n": F.count(F.lit(1)), "missing": F.count_if("_x_missing"), "wrong": F.count_if("_x_wrong"), "other": context_fails(table, context or {})}
    r = _totals(df, {"s": F.col("_x")}, others)
    status = _first((not r["n"], "MISSING_EVIDENCE"), (r["other"], "NEEDS_REVIEW"), (r["missing"] > 0, "MISSING_EVIDENCE"), (r["wrong"] > 0, "ERROR"))
    return _judged(table, status, Decimal(expected), r["s"], tolerance)


def bank_balance(table: Table, opening: str, closing: str, credit: str, debit: str, debit_sign: str, tolerance: str = "0", context: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Opening plus credits less debits is the closing balance.

    debits are all positive or all negative, as declared; a row has one of the two. A row with neither is
    missing evidence; wrong signs, and rows with both, need review; of several the first row counts.
    """
    if debit_sign not in ("positive", "negative") or credit == debit:
        raise ValueError("debit_sign is positive or negative, and debit and credit are two columns")
    tolerance, opening, closing = decimals.canonical_text(tolerance, negative=False), decimals.canonical_text(opening), decimals.canonical_text(closing)
    sign = lambda x: F.when(x.isNull() | ~x.rlike("[1-9]"), 0).when(x.startswith("-"), -1).otherwise(1)
    df = _read(table, _c=credit, _d=debit).withColumns({"_cs": sign(F.col("_c")), "_ds": sign(F.col("_d"))})
    against = (F.col("_cs") < 0) | (F.col("_ds") == (-1 if debit_sign == "positive" else 1))
    cause = F.when(F.col("_c_missing") & F.col("_d_missing"), "MISSING_EVIDENCE").when(F.col("_c_wrong") | F.col("_d_wrong"), "ERROR").when(against | ((F.col("_cs") != 0) & (F.col("_ds") != 0)), "NEEDS_REVIEW")
    df = df.withColumn("_cause", cause)
    place = F.when(F.col("_cause").isNotNull(), F.struct("_pos", "_row_id"))
    r = _totals(df, {"c": F.col("_c"), "d": F.col("_d")}, {"n": F.count(F.lit(1)), "other": context_fails(table, context or {}), "cause": F.min_by("_cause", place)})
    status = _first((not r["n"], "MISSING_EVIDENCE"), (r["other"], "NEEDS_REVIEW"), (r["cause"] is not None, r["cause"]))
    credits, debits = r["c"], r["d"]
    actual = None
    if credits is not None and debits is not None:
        move = decimals.EXACT.add(credits, debits) if debit_sign == "negative" else decimals.EXACT.subtract(credits, debits)
        actual = decimals.EXACT.add(Decimal(opening), move)
    return _judged(table, status, Decimal(closing), actual, tolerance)


def fee(table: Table, base: str, actual: str, rate: str, scale: int = 2, tolerance: str = "0", rule: dict | None = None, managers: list[str] | None = None, context: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The sum of base times rate, rounded once, half to even, against the sum of the actual fees.

    rule has rule_id, rule_version and rule_approved_by, one of managers; without that the fee needs review.
    """
    if type(scale) is not int or scale not in SCALES:
        raise ValueError("scale is 0 to 12")
    tolerance, rate = decimals.canonical_text(tolerance, negative=False), decimals.canonical_text(rate, negative=False)
    approved = bool(rule) and all(str(rule.get(k) or "").strip() for k in ("rule_id", "rule_version", "rule_approved_by")) and rule["rule_approved_by"] in (managers or ())
    df = _read(table, _b=base, _a=actual)
    others = {"n": F.count(F.lit(1)), "missing": F.count_if(F.col("_b_missing") | F.col("_a_missing")), "wrong": F.count_if(F.col("_b_wrong") | F.col("_a_wrong")), "other": context_fails(table, context or {})}
    r = _totals(df, {"b": F.col("_b"), "a": F.col("_a")}, others)
    status = _first((not r["n"], "MISSING_EVIDENCE"), (r["other"] or not approved, "NEEDS_REVIEW"), (r["missing"] > 0, "MISSING_EVIDENCE"), (r["wrong"] > 0, "ERROR"))
    total_base = r["b"]
    due = None if total_base is None else decimals.EXACT.multiply(total_base, Decimal(rate)).quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_EVEN, context=decimals.EXACT)
    return _judged(table, status, due, r["a"], tolerance)


def freshness(as_of: Column, now: Column, days: int) -> Column:
    """Whether a source is at most so many days old; null where its date is missing or in the future."""
    age = F.datediff(now, as_of)
    return F.when(age >= 0, age <= days)


def heads(revisions: DataFrame) -> DataFrame:
    """The last revision (document_id, seq, ...) of each document, whole."""
    return revisions.withColumn("_n", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("seq").desc()))).where("_n = 1").drop("_n")


#: What keeps an input from being judged, with the status that it gives.
INPUT_FAULTS = {
    "no_revision": "MISSING_EVIDENCE", "no_hash": "MISSING_EVIDENCE", "other_period": "NEEDS_REVIEW", "no_date": "NEEDS_REVIEW", "future_date": "NEEDS_REVIEW", "stale": "MISSING_EVIDENCE", "failed": "ERROR",
    "not_extracted": "NEEDS_REVIEW", "no_dataset": "MISSING_EVIDENCE", "not_accepted": "NEEDS_REVIEW", "pdf_unverified": "NEEDS_REVIEW", "coverage_incomplete": "MISSING_EVIDENCE", "open_issues": "NEEDS_REVIEW", "too_few": "MISSING_EVIDENCE",
}


def inputs(asked: DataFrame, revisions: DataFrame, datasets: DataFrame, issues: DataFrame, now: Column) -> DataFrame:
    """(requirement_id, status, faults): whether the documents of each requirement are fit to be judged, the worst fault first.

    asked(requirement_id, document_id, period, freshness_days, minimum); revisions(document_id, seq, source_id,
    content_hash, period, as_of, state, media_type, complete, verified_hash); datasets(source_id, data_hash,
    accepted_hash, accepted); issues(source_id, severity, resolved).
    """
    sets = datasets.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_sets"), F.count_if(~F.coalesce(F.col("accepted") & (F.col("data_hash") == F.col("accepted_hash")), F.lit(False))).alias("n_open"))
    bad = issues.where("severity = 'error' and not coalesce(resolved, false)").groupBy("source_id").agg(F.count(F.lit(1)).alias("n_issues"))
    head = heads(revisions).withColumnRenamed("period", "has_period").drop("seq")
    rows = asked.join(head, "document_id", "left").join(sets, "source_id", "left").join(bad, "source_id", "left")
    here, age = F.col("source_id").isNotNull(), F.datediff(now, F.col("as_of"))
    dated = F.col("freshness_days").isNotNull()
    pdf = F.col("media_type") == "application/pdf"
    tests = {
        "no_revision": ~here, "no_hash": here & F.col("content_hash").isNull(), "other_period": here & F.col("period").isNotNull() & ~F.col("period").eqNullSafe(F.col("has_period")), "no_date": here & dated & F.col("as_of").isNull(),
        "future_date": here & dated & (age < 0), "stale": here & dated & (age > F.col("freshness_days")), "failed": here & F.col("state").isin("FAILED", "ERROR"), "not_extracted": here & ~F.coalesce(F.col("state").isin("EXTRACTED", "FAILED", "ERROR"), F.lit(False)),
        "no_dataset": here & F.col("n_sets").isNull(), "not_accepted": here & (F.col("n_open") > 0), "pdf_unverified": here & pdf & ~F.coalesce(F.col("verified_hash") == F.col("content_hash"), F.lit(False)),
        "coverage_incomplete": here & ~F.coalesce(pdf, F.lit(False)) & ~F.coalesce("complete", F.lit(False)), "open_issues": here & (F.col("n_issues") > 0),
    }
    rank = {s: i for i, s in enumerate(("ERROR", "MISSING_EVIDENCE", "NEEDS_REVIEW"))}
    fault = lambda name: F.struct(F.lit(rank[INPUT_FAULTS[name]]).alias("rank"), F.lit(name).alias("fault"))
    each = rows.select("requirement_id", "document_id", "minimum", F.array_compact(F.array(*[F.when(t, fault(name)) for name, t in tests.items()])).alias("found"))
    whole = each.groupBy("requirement_id").agg(F.flatten(F.collect_list("found")).alias("found"), F.count("document_id").alias("n"), F.max("minimum").alias("minimum"))
    found = F.array_sort(F.when(F.col("n") < F.col("minimum"), F.array(fault("too_few"))).otherwise(F.array_distinct("found")))
    status = F.when(F.size("found") == 0, "PASS").otherwise(F.element_at(F.array(*[F.lit(s) for s in rank]), F.get("found", F.lit(0))["rank"] + 1))
    return whole.withColumn("found", found).select("requirement_id", status.alias("status"), F.col("found.fault").alias("faults"))


def chosen_dataset(datasets: DataFrame, document_id: str | None = None, title: str | None = None, dataset_id: str | None = None) -> DataFrame:
    """The one dataset (dataset_id, document_id, title, ...) that a selector names; no row where it names none or several."""
    asked = {"document_id": document_id, "title": title, "dataset_id": dataset_id}
    if not any(asked.values()):
        raise ValueError("a dataset is named by document, title or id")
    found = datasets.where(reduce(Column.__and__, [F.col(k) == v for k, v in asked.items() if v]))
    one = found.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("*")).alias("_row"))  # of many a row for each task meets
    return one.where("_n = 1").select("_row.*")


def deadlines(tasks: DataFrame, now: Column) -> DataFrame:
    """Notices (task_id, cycle, event): overdue after due_at, escalated escalate_after days later, once a task's cycle."""
    late = now > F.col("due_at")
    later = now > F.col("due_at") + F.make_dt_interval(F.col("escalate_after"))
    events = F.array_compact(F.array(F.when(late, F.lit("overdue")), F.when(later, F.lit("escalated"))))
    return tasks.where("status <> 'resolved'").select("task_id", "cycle", F.explode(events).alias("event")).dropDuplicates(["task_id", "cycle", "event"])
