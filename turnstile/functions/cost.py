"""D3: cost of one employee leaving, as a Column expression.

Every argument may be a number or a Column, so the same formula prices a
whole table in one projection (salary and revenue per row) or a scalar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default cost parameters of the turnover cost model.
DEFAULT_COST_PARAMS = dict(
    salary=80000,
    separation_cost=500,
    vacancy_cost=10000,
    acquisition_cost=4900,
    placement_cost=3500,
    net_revenue_per_employee=250000,
    workdays_per_year=240,
    workdays_position_open=40,
    workdays_onboarding=60,
    onboarding_efficiency=0.50,
)

_DIRECT = ("separation_cost", "vacancy_cost", "acquisition_cost", "placement_cost")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def attrition_cost(n=1, **overrides) -> Column:
    """n * (direct + lost productivity - salary saved while the seat is empty).

    The four direct costs must be scalars: the source formula sums them into
    one number, so a per-row column there would change the meaning.
    """
    p = {**DEFAULT_COST_PARAMS, **overrides}
    for k in _DIRECT:
        if isinstance(p[k], Column):
            raise TypeError(f"{k} must be a scalar, not a column")
    direct = float(sum(p[k] for k in _DIRECT))
    days = _c(p["workdays_per_year"])
    productivity = (_c(p["net_revenue_per_employee"]) / days
                    * (_c(p["workdays_position_open"])
                       + _c(p["workdays_onboarding"]) * _c(p["onboarding_efficiency"])))
    salary_saved = _c(p["salary"]) / days * _c(p["workdays_position_open"])
    return _c(n) * (F.lit(direct) + productivity - salary_saved)


def attrition_cost_value(n: float = 1, **overrides) -> float:
    """Plain-Python twin of :func:`attrition_cost` (for literals and tests)."""
    p = {**DEFAULT_COST_PARAMS, **overrides}
    direct = sum(p[k] for k in _DIRECT)
    productivity = (p["net_revenue_per_employee"] / p["workdays_per_year"]
                    * (p["workdays_position_open"] + p["workdays_onboarding"] * p["onboarding_efficiency"]))
    salary_saved = p["salary"] / p["workdays_per_year"] * p["workdays_position_open"]
    return n * (direct + productivity - salary_saved)
