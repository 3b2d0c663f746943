import datetime as dt
import random

from tidemark.operators import features


def test_gaps_by_brute_force_from_one_shuffle(spark):
    rng = random.Random(3)
    start = dt.date(2020, 1, 1)
    rows = [(rng.randrange(4), rng.choice(["a", "b", None]), start + dt.timedelta(rng.choice([rng.randrange(900), 31, 60]))) for _ in range(200)]
    events = spark.createDataFrame(rows, "person_id int, feature string, event_date date")
    first, last = dt.date(2020, 3, 1), dt.date(2022, 6, 1)
    gaps = features.smallest_gaps(events, first, last, 365)
    dates = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(2, 30)]
    expected = {}
    for person, feature, event in rows:
        for date in dates:
            gap = (date - event).days
            if 1 <= gap <= 365:
                key = (person, date, feature)
                expected[key] = min(gap, expected.get(key, gap))
    got = gaps.collect()
    assert len(got) == len(expected)
    assert {(r["person_id"], r["end_date"], r["feature"]): r["gap"] for r in got} == expected
    # the dates of an event are multiplied last: no grouping of theirs follows
    plan = gaps._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and plan.index("Generate") < plan.index("Aggregate")
