"""Plan shape: broadcast lookups, no row-at-a-time Python UDFs, pruned scans."""

from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan_prunes_and_has_no_python_udf(spark, catalog):
    df = catalog["d04_attrition_workflow"].build(spark, SF_SMALL)
    p = _plan(df)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    # only the needed order columns are read
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in p


def test_readable_decode_uses_broadcast_joins(spark, catalog):
    p = _plan(catalog["j02_fold_left_joins"].build(spark, SF_SMALL))
    assert "BroadcastHashJoin" in p
    assert "BatchEvalPython" not in p


def test_no_row_udfs_in_policy_and_rules(spark, catalog):
    for name in ["v04_savings_no_overtime", "v12_sensitivity_grid", "g03_work_environment",
                 "e04_logloss", "j06_cross_params"]:
        p = _plan(catalog[name].build(spark, SF_SMALL))
        assert "BatchEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
