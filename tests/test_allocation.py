"""Allocation against exact arithmetic row by row, with weights and totals of any length and one group of most rows."""

import random
from decimal import Decimal, getcontext, localcontext

from tests.test_recipe import codes, run, table


def brute(rows, scale):
    """rows: (group, total, weight) by row; -> shares, null where a group can't be split."""
    out, unit = {}, Decimal(1).scaleb(-scale)
    groups = {}
    for i, (g, total, weight) in enumerate(rows):
        groups.setdefault(g, []).append((f"t:{i}", total, weight))
    with localcontext() as c:
        c.prec = 600
        for members in groups.values():
            try:
                totals = [Decimal(t) for _, t, _ in members]
                weights = [Decimal(w) for _, _, w in members]
                fine = len(set(totals)) == 1 and min(weights) >= 0 and sum(weights) > 0 and totals[0] == totals[0].quantize(unit)
            except (TypeError, ArithmeticError):
                fine = False
            if not fine:
                out |= {r: None for r, _, _ in members}
                continue
            units, whole = int(abs(totals[0]) / unit), sum(weights)
            up = [units * w for w in weights]
            share = [int(x // whole) for x in up]
            rest = [x - s * whole for x, s in zip(up, share)]
            order = sorted(range(len(members)), key=lambda k: (-rest[k], members[k][0]))
            for k in order[: units - sum(share)]:
                share[k] += 1
            for (r, _, _), s in zip(members, share):
                out[r] = (-s if totals[0] < 0 else s) * unit
    return out


def test_shares_of_any_length(spark):
    rng = random.Random(4)
    assert getcontext().prec == 28
    rows = [("most", "100000.07", str(rng.randrange(1000))) for _ in range(700)]
    for g in range(12):
        size = rng.choice([1, 5, 18, 25, 40, 90])
        total = rng.choice(["0", "-0.01", "10", "99999999999999999999999999999999.99", "-7.5", "1.005"])
        rows += [(f"g{g}", total, str(rng.randrange(10**size)) + rng.choice(["", ".5", "." + "1" * 30])) for _ in range(rng.randint(1, 9))]
    rows += [("zero", "5", "0"), ("zero", "5", "0"), ("minus", "5", "-1"), ("minus", "5", "9"), ("two", "5", "1"), ("two", "6", "1"), (None, "3", "1"), (None, "3", "1"), ("none", None, "1"), ("gap", "3", None), ("text", "3", "x")]
    t = table(spark, rows, ["g", "total", "w"])
    r = run(t, {"op": "allocate", "by": ["g"], "weight": "w", "total": {"column": "total"}, "column": "share", "scale": 2})
    want = brute(rows, 2)
    got = {x._row_id: x.share for x in r.output.df.collect()}
    assert got.keys() == want.keys()
    for k, share in want.items():
        assert (got[k] is None) == (share is None), (k, got[k], share)
        assert share is None or (Decimal(got[k]) == share and len(got[k].partition(".")[2]) == 2), k
    bad = {g for i, (g, _, _) in enumerate(rows) if want[f"t:{i}"] is None}
    assert codes(r) == [("invalid_allocation", "share")] * len(bad)
