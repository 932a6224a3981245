from pyspark.sql import functions as F

from tests.test_recipe import table
from tieout.functions import cleaning
from tieout.operators import impact, reconcile, requirements, revisions

ROLES = ["reference", "account", "currency", "date", "amount"]


def sides(spark, bank, book):
    cols = {r: r for r in ROLES}
    return reconcile.records(table(spark, bank, ROLES, "bank"), "statement", cols).unionByName(reconcile.records(table(spark, book, ROLES, "book"), "journal", cols))


def statuses(items):
    return sorted((r.status, r.n_statement, r.n_journal) for r in items.collect())


def test_reference_matching(spark):
    row = lambda ref, x: (ref, "1", "usd", "2025-01-01", x)
    rows = sides(spark, [row("a", "1.00"), row("b", "2"), row("c", "3"), row("d", "4")], [row("a", "1"), row("b", "2.50"), row("c", "3"), row("c", "3")])
    assert statuses(reconcile.matched(rows)) == [("difference", 1, 1), ("matched", 1, 1), ("missing", 1, 0), ("needs_input", 1, 2)]
    assert ("needs_input", 1, 0) in statuses(reconcile.matched(rows, complete=False))
    broken = rows.unionByName(sides(spark, [row("z", "?")], []))
    assert ("missing", 1, 0) not in statuses(reconcile.matched(broken))


def test_composite_matching_takes_only_mutual_candidates(spark):
    row = lambda x: ("", "1", "USD", "2025-01-01", x)
    bank, book = [row("10.00"), row("20.00"), row("20.02"), row("99")], [row("10.01"), row("20.01")]
    items = reconcile.matched(sides(spark, bank, book), "0.01", composite_confirmed=True)
    assert statuses(items) == [("matched", 1, 1), ("missing", 1, 0), ("needs_input", 2, 1)]
    assert statuses(reconcile.matched(sides(spark, bank[::-1], book[::-1]), "0.01", composite_confirmed=True)) == statuses(items)
    assert {s for s, _, _ in statuses(reconcile.matched(sides(spark, bank, book), "0.01"))} == {"needs_input"}


def test_amounts_and_dates_as_sources_write_them(spark):
    df = spark.createDataFrame([("(1,234.50)", "3 Feb 2025", "45000"), ("1,5", "2025-02-30", "x"), (" 7 ", "", None)], "a string, d string, e string")
    got = df.select(cleaning.amount_text(F.col("a")), cleaning.date_text(F.col("d")), cleaning.date_text(F.col("e"), "excel_1900")).collect()
    assert [tuple(r) for r in got] == [("-1234.50", "2025-02-03", "2023-03-15"), (None, None, None), ("7", "", "")]


def test_revisions(spark):
    a, b = table(spark, [("1", "x"), ("2", "y"), ("3", "z")], ["id", "v"]), table(spark, [("2", "y"), ("1", "q"), ("4", "w")], ["id", "v"])
    changes, wrong = revisions.keyed_diff(a, b, ["id"])
    assert sorted((r.key_id, r.change) for r in changes.collect()) == [("1", "cell_changed"), ("1", "row_moved"), ("2", "row_moved"), ("3", "cell_removed"), ("4", "cell_added")]
    assert not wrong.take(1)
    _, wrong = revisions.keyed_diff(a, table(spark, [("1", "x"), ("1", "y"), (None, "z")], ["id", "v"]), ["id"])
    assert sorted(r.code for r in wrong.collect()) == ["duplicate_business_key", "missing_business_key"]


def test_impact_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], "source string, target string")
    start = spark.createDataFrame([("a",)], "start string")
    assert sorted((r.node, r.depth) for r in impact.reached(edges, start).collect()) == [("b", 1), ("c", 2), ("d", 3)]
    assert sorted(r.node for r in impact.cyclic(edges).collect()) == ["b", "c"]


def test_requirements(spark):
    t = table(spark, [("100", "", "2.00"), ("", "30.5", "0.61")], ["credit", "debit", "fee"])
    verdict = lambda df: df.first().status
    balance = lambda rows, closing="79.5", sign="positive": verdict(requirements.bank_balance(table(spark, rows, ["credit", "debit"]), "10", closing, "credit", "debit", sign))
    fine = [("100", ""), ("", "30.5")]
    assert balance(fine) == "PASS" and balance(fine, "80") == "FAIL"
    assert balance([*fine, ("", "")]) == "MISSING_EVIDENCE" and balance([*fine, ("1", "1")]) == "NEEDS_REVIEW" and balance([*fine, ("x", "")]) == "ERROR"
    assert balance([("-1", "")]) == "NEEDS_REVIEW" and balance([("", "-1")]) == "NEEDS_REVIEW" and balance([("", "-1")], "9", "negative") == "PASS" and balance([]) == "MISSING_EVIDENCE"
    assert verdict(requirements.total(t, "fee", "2.61")) == "PASS"
    assert verdict(requirements.total(table(spark, [("1e3",), ("0.5",)], ["x"]), "x", "1000.5")) == "PASS"
    assert verdict(requirements.total(table(spark, [("1", "EUR"), ("2", "USD")], ["x", "c"]), "x", "3", context={"currency": ("c", "EUR")})) == "NEEDS_REVIEW"
    tasks = spark.sql("select 't' task_id, 1 cycle, 'open' status, timestamp'2025-01-01' due_at, 5 escalate_after union all select 't', 1, 'open', timestamp'2025-01-01', 5")
    assert sorted(r.event for r in requirements.deadlines(tasks, F.lit("2025-01-10").cast("timestamp")).collect()) == ["escalated", "overdue"]


def test_tolerance_must_be_a_number(spark):
    import pytest

    rows = sides(spark, [("a", "1", "USD", "2025-01-01", "1")], [])
    for wrong in ("-1", "0); drop", "1e2", ""):
        with pytest.raises(ValueError):
            reconcile.matched(rows, wrong, composite_confirmed=True)


def test_composite_matching_against_all_pairs(spark):
    import random
    from decimal import Decimal

    rng = random.Random(7)
    made = lambda n: [("", rng.choice("12"), "USD", rng.choice(["2025-01-01", "2025-01-02"]), f"{rng.randrange(-300, 300) / 100:.2f}") for _ in range(n)]
    bank, book = made(120), made(110)
    for tolerance in ("0", "0.01", "0.05"):
        near = lambda a, b: a[1:4] == b[1:4] and abs(Decimal(a[4]) - Decimal(b[4])) <= Decimal(tolerance)  # noqa: B023, E731
        left = [[j for j, b in enumerate(book) if near(a, b)] for a in bank]
        right = [[i for i, a in enumerate(bank) if near(a, b)] for b in book]
        pairs = sorted((a[1], a[3], Decimal(a[4]), Decimal(book[c[0]][4])) for a, c in zip(bank, left) if len(c) == 1 and len(right[c[0]]) == 1)
        items = reconcile.matched(sides(spark, bank, book), tolerance, composite_confirmed=True)
        got = items.collect()
        assert sorted((r.account, r.key, r.statement, r.journal) for r in got if r.status == "matched") == pairs
        assert sum(r.n_statement for r in got) == len(bank) and sum(r.n_journal for r in got) == len(book)
        assert sum(r.status == "missing" for r in got) == sum(not c for c in left) + sum(not c for c in right)


def test_composite_matching_of_one_key(spark):
    """Two hundred thousand records share an account, a currency and a date: amounts alone tell them apart, and half of them are the same."""
    n = 100_000
    rows = spark.range(n).selectExpr("'1' account", "'USD' currency", "'2025-01-01' date", "'' reference", "'' batch", "cast(case when id % 2 = 0 then 5 else id * 10 end as decimal(38,12)) amount", "cast(null as string) issue", "id")
    both = [rows.selectExpr("*", f"'{s}' side").withColumn("id", F.concat("side", F.col("id").cast("string"))) for s in ("statement", "journal")]
    got = reconcile.matched(both[0].unionByName(both[1]), "1", mode="composite", composite_confirmed=True).groupBy("status", "n_statement", "n_journal").count().collect()
    assert sorted(map(tuple, got)) == [("matched", 1, 1, n // 2), ("needs_input", n // 2, n // 2, 1)]
