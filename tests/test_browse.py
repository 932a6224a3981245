"""Pages of rows and of findings."""

import pytest
from pyspark.sql import functions as F

from tests.test_recipe import table
from tieout.operators import browse


def test_pages(spark):
    t = table(spark, [(str(i),) for i in range(23)], ["k"])
    rows = lambda p: sorted((r.place, r.k) for r in p[0].collect())
    got = browse.page(t, 10, row="t:17")
    assert rows(got) == [(i, str(i)) for i in range(10, 20)] and got[1:] == (10, 23)
    assert rows(browse.page(t, 10, 20)) == [(20, "20"), (21, "21"), (22, "22")] and rows(browse.page(t, 10, 40)) == []
    with pytest.raises(LookupError):
        browse.page(t, 10, row="t:99")
    with pytest.raises(ValueError):
        browse.page(t, 0)
    assert browse.page(table(spark, [("a",)], ["k"]).with_df(t.df.limit(0)), 5)[2] == 0


def test_findings_are_searched_and_in_order(spark):
    schema = "check_id string, kind string, match_key string, status string, code string, key array<string>, blocking boolean"
    rows = [("b", "totals", f"m{i}", "difference" if i % 2 else "passed", "totals_differ", [f"Ä{i:02}"], i % 3 == 0 or None) for i in range(12)] + [("a", "unique", "m", "passed", "passed", ["x"], False), (None, "unique", "n", "passed", "passed", None, False)]
    f = spark.createDataFrame(rows[::-1], schema)
    found, total = browse.results(f, ["b", "a"], limit=100)
    assert [r.match_key for r in sorted(found.collect(), key=lambda r: r.place)] == [*[f"m{i}" for i in range(12)], "m", "n"] and total == 14
    found, total = browse.results(f, ["b", "a"], text="ä0", status="difference", offset=1, limit=2)
    assert [r.match_key for r in sorted(found.collect(), key=lambda r: r.place)] == ["m3", "m5"] and total == 5
    assert browse.results(f, [], blocking=False)[1] == 2 and browse.results(f.where(F.lit(False)), ["b"])[1] == 0
