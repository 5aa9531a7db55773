"""Rule tables G1-G3 row by row (first matching rule wins), on literal rows."""

import pytest

from turnstile.operators import recommend as rec

COLS = ["EmployeeNumber", "PerformanceRating", "JobSatisfaction", "JobInvolvement", "YearsAtCompany",
        "TotalWorkingYears", "YearsInCurrentRole", "JobLevel", "OverTime", "WorkLifeBalance",
        "BusinessTravel", "DistanceFromHome", "EnvironmentSatisfaction"]
BASE = dict(PerformanceRating=3, JobSatisfaction=3, JobInvolvement=3, YearsAtCompany=4, TotalWorkingYears=8,
            YearsInCurrentRole=1, JobLevel=5, OverTime=1, WorkLifeBalance=3, BusinessTravel=1,
            DistanceFromHome=5, EnvironmentSatisfaction=3)

CASES = [
    # (changes, personal, professional, work environment)
    (dict(PerformanceRating=1), rec.CREATE_PDP, rec.RETAIN, rec.RETAIN),
    (dict(JobInvolvement=2), rec.CREATE_PDP, rec.RETAIN, rec.PROMOTE_ENGAGEMENT),
    (dict(YearsAtCompany=2), rec.PROMOTE_TRAINING, rec.RETAIN, rec.RETAIN),
    (dict(YearsAtCompany=5, JobSatisfaction=4), rec.SEEK_MENTORSHIP, rec.RETAIN, rec.RETAIN),
    (dict(), rec.SEEK_LEADERSHIP, rec.RETAIN, rec.RETAIN),
    (dict(YearsInCurrentRole=2, JobSatisfaction=2), rec.RETAIN, rec.READY_ROTATION, rec.RETAIN),
    (dict(JobLevel=1, YearsInCurrentRole=2), rec.SEEK_LEADERSHIP, rec.READY_PROMOTION, rec.RETAIN),
    (dict(JobLevel=3, YearsInCurrentRole=3, JobInvolvement=4), rec.SEEK_LEADERSHIP, rec.READY_PROMOTION,
     rec.RETAIN),
    (dict(YearsInCurrentRole=4, JobSatisfaction=4), rec.SEEK_MENTORSHIP, rec.INCENTIVIZE_SPEC, rec.RETAIN),
    (dict(OverTime=2), rec.SEEK_LEADERSHIP, rec.RETAIN, rec.IMPROVE_WLB),
    (dict(WorkLifeBalance=2, BusinessTravel=3), rec.SEEK_LEADERSHIP, rec.RETAIN, rec.MONITOR_TRAVEL),
    (dict(WorkLifeBalance=2, DistanceFromHome=10), rec.SEEK_LEADERSHIP, rec.RETAIN, rec.MONITOR_TRAVEL),
    (dict(EnvironmentSatisfaction=1, YearsInCurrentRole=2), rec.SEEK_LEADERSHIP, rec.RETAIN,
     rec.REVIEW_ASSIGNMENT),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule_tables(spark, i):
    changes, personal, professional, work = CASES[i]
    row = {**BASE, **changes, "EmployeeNumber": i}
    df = spark.createDataFrame([tuple(row[c] for c in COLS)], ", ".join(f"{c} long" for c in COLS))
    r = rec.strategies_from_codes(df).first()
    assert r["personal_development_strategy"] == personal
    assert r["professional_development_strategy"] == professional
    assert r["work_environment_strategy"] == work
