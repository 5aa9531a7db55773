"""Hand-computed values stated by the reference (FIXTURES.md section 5)."""

import math

from pyspark.sql import functions as F

from turnstile.functions.cost import attrition_cost, attrition_cost_value
from turnstile.operators import evaluate as ev
from turnstile.operators import policy as pol


def test_cost_of_one_leaver():
    assert math.isclose(attrition_cost_value(), 78483.3333333, rel_tol=1e-9)


def test_cost_of_200_leavers(spark):
    v = spark.range(1).select(attrition_cost(n=200)).first()[0]
    assert round(v, 2) == 15696666.67


def test_direct_costs_must_be_scalars(spark):
    import pytest
    with pytest.raises(TypeError):
        attrition_cost(separation_cost=F.col("x"))


def _confusion_frame(spark, tp, fp, fn, tn):
    rows = ([("Yes", 0.9)] * tp + [("No", 0.9)] * fp + [("Yes", 0.1)] * fn + [("No", 0.1)] * tn)
    return spark.createDataFrame(rows, "Attrition string, Yes double")


def test_precision_recall_f1(spark):
    df = _confusion_frame(spark, 24, 11, 12, 173)
    r = ev.metrics_at(df, 0.5).first()
    assert round(r["precision"], 4) == 0.6857
    assert round(r["recall"], 4) == 0.6667
    assert round(r["f1"], 3) == 0.676


def test_confusion_matrix_error_rate(spark):
    df = _confusion_frame(spark, 24, 11, 12, 173)
    rows = {r["actual"]: r for r in ev.confusion_matrix(df, 0.5).collect()}
    assert rows["Totals"]["rate"] == "23/220"
    assert round(rows["Totals"]["error"], 4) == 0.1045


def test_decile_lift(spark):
    # 220 employees, 36 leavers, 17 of them among the 22 highest scores
    rows = []
    for i in range(220):
        top = i < 22
        leaver = (i < 17) if top else (22 <= i < 22 + 19)
        rows.append((i, 1.0 - i / 1000.0, "Yes" if leaver else "No"))
    df = spark.createDataFrame(rows, "EmployeeNumber long, Yes double, Attrition string")
    g = {r["group"]: r for r in ev.gain_lift_deciles(df).collect()}
    assert g[1]["responses"] == 17 and g[1]["cases"] == 22
    assert round(g[1]["lift"], 2) == 4.72
    assert math.isclose(g[10]["gain"], 1.0) and math.isclose(g[10]["lift"], 1.0)


def test_do_nothing_saves_nothing(spark):
    df = spark.createDataFrame([(i, "Yes" if i % 2 else "No", 5000.0 + i, 0.3, 0.2) for i in range(50)],
                               "EmployeeNumber long, OverTime string, MonthlyIncome double, Yes double, "
                               "Yes_no_ot double")
    t = pol.savings_for_policies(df, [pol.Policy("do_nothing", 1.0, tnr=1, fpr=0, fnr=1, tpr=0)]).first()
    assert abs(t["savings"]) < 1e-6


def test_sensitivity_grid_has_30_cells(spark):
    from turnstile.plans.q_relational import OVERTIME_PCTS, REVENUES
    df = spark.createDataFrame([(i, "Yes" if i % 2 else "No", 5000.0 + i, 0.3, 0.2) for i in range(50)],
                               "EmployeeNumber long, OverTime string, MonthlyIncome double, Yes double, "
                               "Yes_no_ot double")
    g = pol.sensitivity_grid(df, pol.Policy("p", 0.25), OVERTIME_PCTS, REVENUES)
    assert g.count() == 30
