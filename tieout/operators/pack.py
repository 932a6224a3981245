"""Reporting packs: facts out of observations under an approved mapping, checks of facts, and how a pack is routed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, decimals
from ..functions.exact import exact
from .ranks import spread

#: The six columns of a pack's rows and what each must look like.
LAYOUT = {
    "entity_id": r"^\S(?:.*\S)?$",
    "period": cleaning.PERIOD,
    "currency": "^(?:" + "|".join(cleaning.CURRENCIES) + ")$",
    "metric": r"^[a-z][a-z0-9_]*$",
    "value": r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$",
    "scale": "^(?:" + "|".join(cleaning.SCALES) + ")$",
}
SCOPE = ("entity_id", "period", "currency")
#: The checks that a pack must have.
REQUIRED_CHECKS = ("data_schema", "source_coverage", "source_inputs", "context", "fee", "source_to_pack", "balance_sheet")


def schema_violations(rows: DataFrame) -> DataFrame:
    """(position, column_key, value): cells of a pack's rows that don't look as they must. rows has position and the columns of LAYOUT."""
    cells = F.array(*[F.struct(F.lit(k).alias("column_key"), F.col(k).alias("value"), F.coalesce(F.col(k).rlike(p), F.lit(False)).alias("fine")) for k, p in LAYOUT.items()])
    return rows.select("position", F.inline(cells)).where("not fine").drop("fine")


def data_schema(rows: DataFrame) -> DataFrame:
    """(id, status, n): PASS where there are rows and all cells look as they must."""
    bad = reduce(Column.__or__, [~F.coalesce(F.col(k).rlike(p), F.lit(False)) for k, p in LAYOUT.items()])
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad")).select(F.lit("data_schema").alias("id"), F.when((F.col("n") > 0) & (F.col("bad") == 0), "PASS").otherwise("FAIL").alias("status"), "n")


def source_coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(id, status, n_expected, n_observed): every expected occurrence observed, each once, all accepted. observed(occurrence_id, disposition)."""
    a = expected.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("e"))
    b = observed.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("o"), F.count_if(~F.coalesce(F.col("disposition") == "ACCEPTED", F.lit(False))).alias("open"))
    both = a.join(b, "occurrence_id", "full_outer")
    fine = (F.col("e") == 1) & (F.col("o") == 1) & (F.col("open") == 0)
    sums = both.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("o"), F.lit(0)).alias("n_observed"), F.count_if(~F.coalesce(fine, F.lit(False))).alias("bad"))
    return sums.select(F.lit("source_coverage").alias("id"), F.when((F.col("n_expected") > 0) & (F.col("bad") == 0), "PASS").otherwise("FAIL").alias("status"), "n_expected", "n_observed")


def facts(observations: DataFrame, mapping: dict) -> DataFrame:
    """observations with value_decimal, metric as mapped, status (RESOLVED or UNRESOLVED) and reasons.

    observations(occurrence_id, metric, entity_id, period, currency, raw_value, raw_scale, formula); mapping has
    approved, approval_id, version, entity_id, period and mapping (raw metric -> metric), and is read by whoever calls.
    """
    allowed = mapping.get("approved") is True and all(str(mapping.get(k) or "").strip() for k in ("approval_id", "version"))
    names = {k: v for k, v in (mapping.get("mapping") or {}).items() if v}
    metric = F.coalesce(*[F.when(F.col("metric") == k, v) for k, v in names.items()], F.lit(None).cast("string"))
    number = cleaning.pack_number(F.col("raw_value"))
    units = cleaning.in_units(F.when(number != "invalid", number), F.col("raw_scale"))
    known_scale = F.coalesce(F.col("raw_scale").isin(*cleaning.SCALES), F.lit(False))
    tests = {
        "invalid_entity": ~cleaning.valid_entity(F.col("entity_id")), "invalid_currency": ~cleaning.valid_currency(F.col("currency")), "invalid_period": ~cleaning.valid_period(F.col("period")),
        "no_occurrence": F.coalesce("occurrence_id", F.lit("")) == "", "formula": F.col("formula").isNotNull(), "mapping_not_approved": F.lit(not allowed),
        "mapping_of_other_scope": ~(F.col("entity_id").eqNullSafe(F.lit(mapping.get("entity_id"))) & F.col("period").eqNullSafe(F.lit(mapping.get("period")))),
        "metric_not_mapped": ~F.coalesce(metric.rlike(LAYOUT["metric"]), F.lit(False)), "scale_unknown": ~known_scale, "value_missing": number.isNull(), "value_invalid": F.coalesce(number == "invalid", F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    rows = observations.withColumn("reasons", reasons)
    fine = F.size("reasons") == 0
    return rows.withColumns({"value_decimal": F.when(fine, units), "status": F.when(fine, "RESOLVED").otherwise("UNRESOLVED"), "metric": F.when(fine, metric).otherwise(F.col("metric"))})


#: Relationships of a pack, as the metric that is checked and the expression that it must equal.
RELATIONS = {
    "fee": ("fee", ("multiply", {}, (("cell", "capital"), ("cell", "fee_rate")))),
    "source_to_pack": ("statement_fee", ("cell", "fee")),
    "balance_sheet": ("assets", ("add", {}, (("cell", "liabilities"), ("cell", "equity")))),
}
METRICS = ("capital", "fee_rate", "fee", "statement_fee", "assets", "liabilities", "equity")
OPTIONAL = ("assets", "liabilities", "equity")


def relations(of: DataFrame, rule: dict) -> DataFrame:
    """(pack_id, id, status, expected, actual, delta): the relations of each pack's facts(pack_id, metric, entity_id, period, currency, value_decimal, status).

    UNKNOWN where an operand is missing, repeated, unresolved or of another scope than the approved rule's;
    the balance sheet is NOT_APPLICABLE where a pack has none of it.
    """
    scoped = reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(rule.get(k))) for k in SCOPE])
    usable = scoped & F.col("status").isin("RESOLVED", "CORRECTED") & F.col("value_decimal").isNotNull()
    at = lambda m: F.col("metric") == m
    wide = of.groupBy("pack_id").agg(*[F.count_if(at(m)).alias(f"n_{m}") for m in METRICS], *[F.max(F.when(at(m) & usable, F.col("value_decimal"))).alias(m) for m in METRICS])
    wide = wide.select("pack_id", *[f"n_{m}" for m in METRICS], *[F.when(F.col(f"n_{m}") == 1, F.col(m)).alias(m) for m in METRICS])
    approved = rule.get("approved") is True and all(rule.get(k) for k in ("approval_id", "version", "tolerance_version"))
    try:
        tolerance = decimals.canonical_text(rule.get("tolerance"), negative=False)
    except ValueError:
        tolerance, approved = "0", False
    out = None
    for name, (metric, tree) in RELATIONS.items():
        rows = wide.withColumns({"expected": exact(tree, list(METRICS), F.lit(True))["value"], "actual": F.col(metric)})
        rows = rows.withColumn("delta", decimals.difference(F.col("actual"), F.col("expected")))
        none = reduce(Column.__and__, [F.col(f"n_{m}") == 0 for m in OPTIONAL]) if name == "balance_sheet" else F.lit(False)
        status = F.when(none, "NOT_APPLICABLE").when(F.lit(not approved) | F.col("delta").isNull(), "UNKNOWN").when(decimals.within(F.col("delta"), F.lit(tolerance)), "PASS").otherwise("FAIL")
        part = rows.select("pack_id", F.lit(name).alias("id"), status.alias("status"), "expected", "actual", "delta")
        out = part if out is None else out.unionByName(part)
    return out


def source_inputs(of: DataFrame, observations: DataFrame) -> DataFrame:
    """(pack_id, id, status): the governing facts (capital, fee_rate) equal what was observed in their source.

    facts(pack_id, metric, observation_id, entity_id, period, currency, raw_scale, value_decimal); observations
    the same by observation_id with raw_value. UNKNOWN where either can't be told.
    """
    number = cleaning.pack_number(F.col("raw_value"))
    units = cleaning.in_units(F.when(number != "invalid", number), F.col("raw_scale"))
    seen = observations.select("observation_id", *[F.col(k).alias(f"o_{k}") for k in ("metric", *SCOPE, "raw_scale")], units.alias("o_value"))
    rows = of.where(F.col("metric").isin("capital", "fee_rate")).join(seen, "observation_id", "left")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in ("metric", *SCOPE, "raw_scale")])
    apart = decimals.difference(F.col("value_decimal"), F.col("o_value"))
    state = F.when(F.col("o_metric").isNull() | apart.isNull(), 2).when(~same | ~decimals.within(apart, F.lit("0")), 1).otherwise(0)
    got = rows.withColumn("state", state).groupBy("pack_id").agg(F.max("state").alias("worst"), F.count_if(F.col("metric") == "capital").alias("c"), F.count_if(F.col("metric") == "fee_rate").alias("r"))
    status = F.when((F.col("worst") == 2) | (F.col("c") != 1) | (F.col("r") != 1), "UNKNOWN").when(F.col("worst") == 1, "FAIL").otherwise("PASS")
    return of.select("pack_id").distinct().join(got, "pack_id", "left").select("pack_id", F.lit("source_inputs").alias("id"), F.coalesce(status, F.lit("UNKNOWN")).alias("status"))


def satisfied(status: Column, applicable: Column, justification: Column) -> Column:
    """PASS, or not applicable for a reason that is given."""
    return F.coalesce((status == "PASS") | ((status == "NOT_APPLICABLE") & ~applicable & (F.trim(justification) != "")), F.lit(False))


def routes(packs: DataFrame, checks: DataFrame, required: list[str] = REQUIRED_CHECKS) -> DataFrame:
    """(pack_id, route, reasons, n_satisfied, n_required) of packs(pack_id, native, unverifiable, evidence_complete, context_complete, unresolved, agreement, confidence).

    checks(pack_id, id, required, status, applicable, justification). BLOCKED where a required check is
    missing, repeated or not satisfied, or evidence or context is incomplete; READY only where nothing is
    left to look at. Confidence is passed on and never decides.
    """
    c = checks.withColumn("ok", satisfied(F.col("status"), F.col("applicable"), F.col("justification")) & F.coalesce("required", F.lit(False)))
    named = F.collect_set(F.when(F.coalesce("required", F.lit(False)) & ~F.col("ok"), F.concat(F.lit("check:"), F.col("id"))))
    sums = c.groupBy("pack_id").agg(
        named.alias("failed"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("kinds"), F.count_if(F.col("id").isNull() | F.col("required").isNull()).alias("odd"), F.count_if("required").alias("n_own"),
        *[F.count_if((F.col("id") == r) & F.col("required")).alias(f"has_{i}") for i, r in enumerate(required)], F.count_if("ok").alias("n_satisfied"),
    )
    rows = packs.join(sums, "pack_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    hard = {
        "odd_check": F.col("odd") > 0, "repeated_check": F.col("n") != F.col("kinds"), "no_required_check": F.coalesce("n_own", F.lit(0)) == 0, "unverifiable": F.coalesce("unverifiable", F.lit(True)),
        "evidence_incomplete": ~flag("evidence_complete"), "context_incomplete": ~flag("context_complete"), **{f"missing:{r}": F.coalesce(f"has_{i}", F.lit(0)) == 0 for i, r in enumerate(required)},
    }
    soft = {"not_native": ~flag("native"), "unresolved": F.coalesce("unresolved", F.lit(True)), "disagreement": ~F.coalesce(F.col("agreement").isin("NOT_RUN", "NOT_APPLICABLE", "AGREE"), F.lit(False))}
    listed = lambda tests: F.array_compact(F.array(*[F.when(t, name) for name, t in tests.items()]))
    rows = rows.withColumns({"_hard": F.array_sort(F.concat(F.coalesce("failed", F.array().cast("array<string>")), listed(hard))), "_soft": listed(soft)})
    route = F.when(F.size("_hard") > 0, "BLOCKED").when(F.size("_soft") > 0, "NEEDS_REVIEW").otherwise("READY")
    return rows.select("pack_id", route.alias("route"), F.when(F.size("_hard") > 0, F.col("_hard")).otherwise(F.col("_soft")).alias("reasons"), F.coalesce("n_satisfied", F.lit(0)).alias("n_satisfied"), F.greatest(F.coalesce("n_own", F.lit(0)), F.lit(len(required))).alias("n_required"), "confidence")


def agreement(pairs: DataFrame) -> DataFrame:
    """pairs(.., a, b: struct<scope, metric, entity_id, period, currency, raw_scale, value_decimal>, availability) with agreement.

    Readings agree where number and context are the same; a context that is missing, or a value that is no
    number, leaves it unknown; without a second reading its availability says why.
    """
    keys = ("metric", *SCOPE, "raw_scale")
    blank = reduce(Column.__or__, [F.coalesce(F.trim(F.col(f"{s}.{k}")), F.lit("")) == "" for s in "ab" for k in keys])
    numbers = [cleaning.plain_number(F.col(f"{s}.value_decimal")) for s in "ab"]
    same = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]) & (decimals.order_key(numbers[0]) == decimals.order_key(numbers[1]))
    absent = F.when(F.col("availability").isin("NOT_RUN", "UNAVAILABLE", "NOT_APPLICABLE"), F.col("availability")).otherwise("UNKNOWN")
    answer = (
        F.when(F.col("b").isNull(), absent).when(F.col("a").isNull(), "UNKNOWN").when(~F.col("a.scope").eqNullSafe(F.col("b.scope")), "DISAGREE")
        .when(blank | numbers[0].isNull() | numbers[1].isNull(), "UNKNOWN").when(same, "AGREE").otherwise("DISAGREE")
    )
    return pairs.withColumn("agreement", answer)


def paired_observations(first: DataFrame, second: DataFrame) -> DataFrame:
    """first and second(occurrence_id, reading) as (occurrence_id, a, b): b only where one second reading has the occurrence."""
    one = second.groupBy("occurrence_id").agg(F.count(F.lit(1)).alias("_n"), F.first("reading").alias("b")).where("_n = 1").drop("_n")
    return first.select("occurrence_id", F.col("reading").alias("a")).join(one, "occurrence_id", "left")


def corrected(of: DataFrame, corrections: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with the accepted corrections as new versions, refused corrections with why).

    facts(fact_id, version, ...); corrections(fact_id, version, value_decimal, entity_id, period, currency, source_id);
    evidence(source_id, fact_id, entity_id, period, currency) says which source supports which fact. A value has 28 digits and 12 decimals at most.
    """
    support = evidence.select(F.col("source_id").alias("_s"), F.col("fact_id").alias("_f"), *[F.col(k).alias(f"_{k}") for k in SCOPE])
    holds = reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in SCOPE])
    # many small parts by fact: the joins and groups below keep them, so that no task holds many facts
    of, corrections, support = spread(of, "fact_id"), spread(corrections, "fact_id"), spread(support, "_f").distinct()
    c = corrections.join(support, (F.col("source_id") == F.col("_s")) & (F.col("fact_id") == F.col("_f")), "left").withColumn("_ok", F.coalesce(holds, F.lit(False)))
    c = c.groupBy(*corrections.columns).agg(F.max("_ok").alias("_ok"))
    c = c.join(of.select("fact_id", F.col("version").alias("_now")), "fact_id", "left")
    number = F.coalesce(F.col("value_decimal").rlike(r"^-?(?=(?:[0-9]\.?){1,28}$)[0-9]+(?:\.[0-9]{1,12})?$"), F.lit(False))
    why = F.when(F.col("_now").isNull(), "no_fact").when(F.col("version") != F.col("_now"), "superseded").when(~number, "wrong_number").when(~F.col("_ok"), "not_supported")
    c = c.withColumn("code", why)
    new = c.where("code is null").select("fact_id", F.col("value_decimal").alias("_new"))
    changed = of.join(new, "fact_id", "inner").withColumns({"value_decimal": F.col("_new"), "version": F.col("version") + 1, "status": F.lit("CORRECTED")}).drop("_new")
    return of.unionByName(changed), c.where("code is not null").select(*corrections.columns, "code")
