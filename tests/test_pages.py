"""Pages by place: ranges of a total order instead of one sorted task."""

import random

from pyspark.sql import functions as F

from foliomatch.operators import inventory as iv
from foliomatch.operators import tables as tb


def test_pages_are_those_of_one_sort(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, *range(9)]), r.choice("abc")) for i in range(237)]
    df = spark.createDataFrame(rows, "id long, score int, tab string")
    for down in (True, False):
        order = [F.col("score").desc_nulls_last() if down else F.col("score").asc_nulls_last(), F.col("id")]
        index = tb.ranked(df, order)
        want = sorted(rows, key=lambda x: (x[1] is None, (-x[1] if down else x[1]) if x[1] is not None else 0, x[0]))
        for number in (0, 3, 11, 12):
            got = [x.id for x in tb.page_at(index, number, 20).collect()]
            assert got == [x[0] for x in want[number * 20 : number * 20 + 20]]
        assert [x.place for x in index.orderBy("place").collect()] == list(range(237))
    assert "PushedFilters: [IsNotNull(place), GreaterThanOrEqual(place,40), LessThan(place,60)]" in tb.page_at(index, 2, 20)._jdf.queryExecution().executedPlan().toString()


def test_tabs(spark):
    rows = [(i, i % 3 if i % 7 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, tab int")
    got = {(x.id): (x.place, x.pages_end) for x in tb.ranked_tabs(df, [F.desc("id")]).collect()}
    for i, t in rows:
        mine = sorted((j for j, u in rows if u == t), reverse=True)
        assert got[i] == (mine.index(i), len(mine))
    assert tb.ranked_tabs(df.limit(0), [F.desc("id")]).collect() == []


def test_size_collisions(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 6), (4, None), (5, None)], "archive_id long, file_size long")
    assert sorted((x.archive_id, x.n) for x in iv.size_collisions(df).collect()) == [(1, 2), (2, 2)]
