"""Scores at their thresholds."""

from repograph.plans import insights

FUNCTIONS = "job_id string, id string, lines int, cyclomatic int, param_count int, nesting_depth int, call_count int"


def test_a_score_that_equals_a_threshold_reaches_it(spark):
    """Every combination of figures is judged as whole numbers over 2100 have it, though the doubles may fall short of 0.55 or 0.35."""
    rows = [("j", f"{n}", *x) for n, x in enumerate((a, c, p, d, k) for a in (60, 84, 90, 100, 120) for c in (0, 11, 15, 17, 19, 20) for p in (7, 9, 12, 14) for d in (3, 4, 5, 6) for k in (8, 11, 14, 18))]

    def exact(lines, cyc, params, nest, calls):
        """2100 times the composite: the parts' weights are 0.2 / 60, 0.3 / 10, 0.2 / 7, 0.15 / 3 and 0.15 / 10."""
        cut = lambda x, most: max(0, min(most, x))
        rest = cut(params - 7, 7) * 60 + cut(nest - 3, 3) * 105 + cut(calls - 8, 10) * 31.5
        return rest + (cut(lines - 60, 60) * 7 + cut(cyc - 10, 10) * 63 if cyc > 0 else cut(lines - 60, 60) * 17.5)

    got = {r.id: (r.is_god, r.outlier) for r in insights.judged_functions(spark.createDataFrame(rows, FUNCTIONS)).collect()}
    at = [r for r in rows if exact(*r[2:]) == 1155]
    assert at and all(got[r[1]][0] for r in at)
    assert not any(got[r[1]][0] for r in rows if exact(*r[2:]) < 1155 and not got[r[1]][1])
