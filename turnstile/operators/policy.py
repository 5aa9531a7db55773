"""Expected cost of attrition under an overtime policy, savings by
threshold, threshold optimisation and the sensitivity grid.

The model is applied twice in total: ``y0`` = P(leave) as-is and ``y1`` =
P(leave) with OverTime set to "No".  A threshold only decides which of the
two a row uses (rows with ``y0 >= t`` get the policy), so savings for any
number of thresholds need no re-scoring.  Per row, with attrition cost AC,
policy share ``pct`` and ``ot`` = 1 when OverTime was "Yes":

    c0 = y0 * AC                          (expected cost without the policy)
    c1 = y1 * AC * (1 + pct * ot)         (leave part once targeted)
    c2 = (1 - y1) * pct * ot * AC         (stay part once targeted)

    total_0    = sum(c0)
    total_1(t) = a * (sum(c0) - F0(t)) + a * F1(t) + b * F2(t)

where F*(t) sums c* over targeted rows, a = tpr + fnr and b = tnr + fpr
(the cost/benefit weights with cb_tp = cb_fn, cb_tn = cb_fp).

* a few thresholds (named policies, the sampled optimisation grid): one
  aggregate with conditional sums per threshold -- one pass, no join;
* every distinct threshold: running sums over scores in descending order
  (``running_sum``), joined to the metrics table on the threshold;
* the sensitivity grid: AC is affine in revenue, so ten sums from one pass
  give every (pct, revenue) cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cost import DEFAULT_COST_PARAMS, attrition_cost
from .ordered import running_sum

DEFAULT_PCT = 0.10
DEFAULT_REVENUE = 250000


@dataclass(frozen=True)
class Policy:
    """A threshold with the rates used as cost/benefit weights."""
    name: str
    threshold: float
    tnr: float = 0.0
    fpr: float = 1.0
    fnr: float = 0.0
    tpr: float = 1.0


def policy_rows(scored: DataFrame, revenue=DEFAULT_REVENUE, pct=DEFAULT_PCT, keep: Sequence[str] = ()) -> DataFrame:
    """Per-employee inputs: y0, y1, AC (salary = 12 x monthly income), ot, c0-c2, and the columns ``keep``."""
    ac = attrition_cost(salary=F.col("MonthlyIncome") * 12, net_revenue_per_employee=revenue)
    ot = F.when(F.col("OverTime") == "Yes", 1.0).otherwise(0.0)
    rows = scored.select("EmployeeNumber", "OverTime", *keep, F.col("Yes").alias("y0"),
                         F.col("Yes_no_ot").alias("y1"), ac.alias("ac"), ot.alias("ot"))
    return rows.withColumns({
        "c0": F.col("y0") * F.col("ac"),
        "c1": F.col("y1") * F.col("ac") * (1 + F.lit(pct) * F.col("ot")),
        "c2": (1 - F.col("y1")) * F.lit(pct) * F.col("ot") * F.col("ac")})


def baseline_costs(scored: DataFrame, revenue=DEFAULT_REVENUE) -> DataFrame:
    """V1: per-employee expected cost with no policy (policy cost 0)."""
    r = policy_rows(scored, revenue)
    return r.select("EmployeeNumber", F.col("ac").alias("attrition_cost"),
                    F.lit(0.0).alias("cost_of_policy_change"), F.col("c0").alias("expected_attrition_cost"))


def counterfactual(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """V2/V5: OverTime before/after targeting rows with ``Yes >= threshold``
    and the score each row ends up with."""
    hit = F.col("Yes") >= F.lit(threshold)
    return scored.select("EmployeeNumber", F.col("OverTime").alias("OverTime_0"),
                         F.when(hit, F.lit("No")).otherwise(F.col("OverTime")).alias("OverTime_1"),
                         F.col("Yes").alias("Yes_0"),
                         F.when(hit, F.col("Yes_no_ot")).otherwise(F.col("Yes")).alias("Yes_1"))


def policy_costs(scored: DataFrame, threshold: float = 0.0, revenue=DEFAULT_REVENUE,
                 pct=DEFAULT_PCT) -> DataFrame:
    """V3: cost of the policy change = pct x AC where OverTime went Yes -> No."""
    cf = counterfactual(scored, threshold).join(scored.select("EmployeeNumber", "MonthlyIncome"),
                                                "EmployeeNumber")
    ac = attrition_cost(salary=F.col("MonthlyIncome") * 12, net_revenue_per_employee=revenue)
    flip = (F.col("OverTime_0") == "Yes") & (F.col("OverTime_1") == "No")
    return cf.select("EmployeeNumber", "OverTime_0", "OverTime_1", ac.alias("attrition_cost"),
                     F.when(flip, ac * F.lit(pct)).otherwise(F.lit(0.0)).alias("cost_of_policy_change"))


def expected_costs_with_rates(scored: DataFrame, policy: Policy, revenue=DEFAULT_REVENUE,
                              pct=DEFAULT_PCT) -> DataFrame:
    """V6: Yes*(tpr*cb_tp + fnr*cb_fn) + No*(tnr*cb_tn + fpr*cb_fp) per employee."""
    r = policy_rows(scored, revenue, pct)
    hit = F.col("y0") >= F.lit(policy.threshold)
    yes1 = F.when(hit, F.col("y1")).otherwise(F.col("y0"))
    pc = F.when(hit & (F.col("ot") == 1.0), F.col("ac") * F.lit(pct)).otherwise(F.lit(0.0))
    cb_pos = F.col("ac") + pc
    cost = yes1 * (F.lit(policy.tpr) * cb_pos + F.lit(policy.fnr) * cb_pos) + \
        (1 - yes1) * (F.lit(policy.tnr) * pc + F.lit(policy.fpr) * pc)
    return r.select("EmployeeNumber", cost.alias("expected_attrition_cost"))


def _savings_cols(total0: Column, f0: Column, f1: Column, f2: Column, a: Column, b: Column) -> list[Column]:
    total1 = a * (total0 - f0) + a * f1 + b * f2
    return [total0.alias("total_expected_attrition_cost_0"), total1.alias("total_expected_attrition_cost_1"),
            (total0 - total1).alias("savings"), F.try_divide(total0 - total1, total0).alias("pct_savings")]


def savings_for_policies(scored: DataFrame, policies: Sequence[Policy], revenue=DEFAULT_REVENUE,
                         pct=DEFAULT_PCT) -> DataFrame:
    """V4/V7/V8/V9: savings for a short list of policies in ONE aggregate pass
    (conditional sums per threshold), one output row per policy."""
    r = policy_rows(scored, revenue, pct)
    aggs = [F.sum("c0").alias("s0")]
    for i, p in enumerate(policies):
        hit = F.col("y0") >= F.lit(p.threshold)
        for k in ("c0", "c1", "c2"):
            aggs.append(F.sum(F.when(hit, F.col(k)).otherwise(F.lit(0.0))).alias(f"p{i}_{k}"))
    row = r.agg(*aggs)
    structs = []
    for i, p in enumerate(policies):
        a, b = F.lit(p.tpr + p.fnr), F.lit(p.tnr + p.fpr)
        structs.append(F.struct(
            F.lit(p.name).alias("policy"), F.lit(float(p.threshold)).alias("threshold"),
            F.lit(float(p.tnr)).alias("tnr"), F.lit(float(p.fnr)).alias("fnr"),
            F.lit(float(p.fpr)).alias("fpr"), F.lit(float(p.tpr)).alias("tpr"),
            *_savings_cols(F.col("s0"), F.col(f"p{i}_c0"), F.col(f"p{i}_c1"), F.col(f"p{i}_c2"), a, b)))
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def savings_all_thresholds(scored: DataFrame, label: str = "Attrition", positive: str = "Yes", revenue=DEFAULT_REVENUE,
                           pct=DEFAULT_PCT) -> DataFrame:
    """V7 for every distinct score, from one table with a row per score.

    One aggregate gives each score its positives, negatives and cost sums; one
    ordered scan in descending order turns them into the confusion counts and
    the savings at that threshold, and its last row holds the totals.
    """
    r = policy_rows(scored, revenue, pct, [label])
    per = r.groupBy(F.col("y0").alias("threshold")).agg(
        F.count_if(F.col(label) == positive).alias("_pos"), F.count_if(F.col(label) != positive).alias("_neg"),
        F.sum("c0").alias("_c0"), F.sum("c1").alias("_c1"), F.sum("c2").alias("_c2"))
    cum = running_sum(per, [F.col("threshold").desc()], {"tp": "_pos", "fp": "_neg", "f0": "_c0", "f1": "_c1", "f2": "_c2"})
    total = cum.agg(F.max("tp").alias("p"), F.max("fp").alias("n"), F.min_by("f0", "threshold").alias("c0")).first()  # one row
    p, n = F.lit(total["p"]), F.lit(total["n"])
    rates = cum.withColumns({"tnr": F.try_divide(n - F.col("fp"), n), "fnr": F.try_divide(p - F.col("tp"), p),
                             "fpr": F.try_divide(F.col("fp"), n), "tpr": F.try_divide(F.col("tp"), p)})
    a = F.col("tpr") + F.col("fnr")
    b = F.col("tnr") + F.col("fpr")
    return rates.select("threshold", "tnr", "fnr", "fpr", "tpr",
                        *_savings_cols(F.lit(total["c0"]), F.col("f0"), F.col("f1"), F.col("f2"), a, b))


def sensitivity_grid(scored: DataFrame, policy: Policy, pcts: Sequence[float],
                     revenues: Sequence[float]) -> DataFrame:
    """Savings for every (pct, revenue) cell at one policy, one pass.

    AC = A0 + R * k with A0 = direct - salary share and k the productivity
    days per workday-year, so each sum splits into an A0 part and a y part.
    """
    p = DEFAULT_COST_PARAMS
    direct = float(p["separation_cost"] + p["vacancy_cost"] + p["acquisition_cost"] + p["placement_cost"])
    k = (p["workdays_position_open"] + p["workdays_onboarding"] * p["onboarding_efficiency"]) \
        / p["workdays_per_year"]
    a0 = F.lit(direct) - F.col("MonthlyIncome") * 12 / F.lit(float(p["workdays_per_year"])) \
        * F.lit(float(p["workdays_position_open"]))
    y0, y1 = F.col("Yes"), F.col("Yes_no_ot")
    ot = F.when(F.col("OverTime") == "Yes", 1.0).otherwise(0.0)
    hit = y0 >= F.lit(policy.threshold)

    def fs(x):
        return F.sum(F.when(hit, x).otherwise(F.lit(0.0)))

    sums = scored.agg(
        F.sum(y0 * a0).alias("s_y0a"), F.sum(y0).alias("s_y0"),
        fs(y0 * a0).alias("f_y0a"), fs(y0).alias("f_y0"),
        fs(y1 * a0).alias("f_y1a"), fs(y1).alias("f_y1"),
        fs(y1 * ot * a0).alias("f_y1oa"), fs(y1 * ot).alias("f_y1o"),
        fs((1 - y1) * ot * a0).alias("f_noa"), fs((1 - y1) * ot).alias("f_no"))
    grid = F.array(*[F.struct(F.lit(float(pc)).alias("avg_overtime_pct"),
                              F.lit(float(rv)).alias("net_revenue_per_employee"))
                     for pc in pcts for rv in revenues])
    g = sums.select("*", F.explode(grid).alias("g")).select("*", "g.*").drop("g")
    R, pc = F.col("net_revenue_per_employee") * F.lit(k), F.col("avg_overtime_pct")
    total0 = F.col("s_y0a") + R * F.col("s_y0")
    f0 = F.col("f_y0a") + R * F.col("f_y0")
    f1 = F.col("f_y1a") + R * F.col("f_y1") + pc * (F.col("f_y1oa") + R * F.col("f_y1o"))
    f2 = pc * (F.col("f_noa") + R * F.col("f_no"))
    a, b = F.lit(policy.tpr + policy.fnr), F.lit(policy.tnr + policy.fpr)
    return g.select("avg_overtime_pct", "net_revenue_per_employee", *_savings_cols(total0, f0, f1, f2, a, b))


def best_row(table: DataFrame, value: str = "savings") -> DataFrame:
    """W8/V9 pick: the row with the largest value (ties -> highest threshold)."""
    b = table.agg(F.max_by(F.struct(*table.columns), F.struct(F.col(value), F.col("threshold"))).alias("b"))
    return b.select("b.*")


def savings_binned(scored: DataFrame, metrics: DataFrame, thresholds, revenue=DEFAULT_REVENUE,
                   pct=DEFAULT_PCT) -> DataFrame:
    """V7 with a bounded threshold table: savings at the given thresholds.

    Rows are bucketed by score with a JVM binary search (MLlib
    ``Bucketizer``), the three cost components are summed per bucket, and the
    running sums run over at most len(thresholds) + 1 buckets; ``metrics``
    (from ``metrics_binned`` on the same thresholds) supplies the rates."""
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window
    ts = sorted(set(float(t) for t in thresholds))
    r = policy_rows(scored, revenue, pct)
    b = Bucketizer(splits=[float("-inf")] + ts + [float("inf")], inputCol="y0", outputCol="_b",
                   handleInvalid="keep")
    per = b.transform(r).groupBy("_b").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"),
                                          F.sum("c2").alias("c2"))
    spark = scored.sparkSession
    idx = spark.createDataFrame([(float(i),) for i in range(len(ts) + 1)], "_b double")
    full = idx.join(per, "_b", "left").fillna(0.0, ["c0", "c1", "c2"])
    w = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, 0)  # <= k + 1 rows
    cum = full.select("_b", F.sum("c0").over(w).alias("f0"), F.sum("c1").over(w).alias("f1"),
                      F.sum("c2").over(w).alias("f2"), F.sum("c0").over(Window.partitionBy()).alias("s0"))
    tt = spark.createDataFrame([(float(i + 1), t) for i, t in enumerate(ts)], "_b double, threshold double")
    j = tt.join(cum, "_b").join(metrics.select("threshold", "tnr", "fnr", "fpr", "tpr"), "threshold")
    a = F.col("tpr") + F.col("fnr")
    bb = F.col("tnr") + F.col("fpr")
    return j.select("threshold", "tnr", "fnr", "fpr", "tpr",
                    *_savings_cols(F.col("s0"), F.col("f0"), F.col("f1"), F.col("f2"), a, bb))
