"""Group labels on names with known answers."""

import pytest
from pyspark.sql import functions as F

from foliomatch.functions.labels import UNKNOWN, work_label, work_labels

U = UNKNOWN
CASES = [
    (None, f"[{U}({U})] {U} ({U})"),
    ([None, "unknown.zip"], f"[{U}({U})] {U} ({U})"),
    (["shelf/[Blue Moon (Ada Vale)] Night Train (scan) [v2].zip"], "[Blue Moon(Ada Vale)] Night Train (scan / v2)"),
    (["[Ada Vale] Night Train.zip", "[Blue Moon(Ada Vale)] night train (Color).cbz", "[ADA VALE] NIGHT TRAIN (color).rar"], "[Blue Moon(Ada Vale)] Night Train (Color)"),
    (["[scan] [Ada Vale] Night  Train.zip"], f"[{U}(Ada Vale)] Night Train (scan)"),
    (["Night Train [Ada Vale].zip"], f"[{U}({U})] Night Train (Ada Vale)"),
    (["［Blue（Ada）］ Night （a (b) c）.zip"], "[Blue(Ada)] Night (a (b) c)"),
    (["[?(Ada)] Night (Unknown).zip", "[Ben] Day.zip"], f"[{U}(Ada / Ben)] Night / Day ({U})"),
    (["[Ada] [Ben] Night.zip"], f"[{U}(Ada)] Night (Ben)"),
    (["[Re\u0301mi] Nuit.zip", "[R\u00e9mi] Nuit.zip"], f"[{U}(R\u00e9mi)] Nuit ({U})"),
]


@pytest.mark.parametrize("paths,label", CASES)
def test_label(spark, paths, label):
    df = spark.createDataFrame([(paths,)], "p array<string>")
    assert df.select(work_label(F.col("p")).alias("l")).first().l == label


def test_labels_by_aggregation(spark):
    """The same labels as of whole arrays, from rows in any order."""
    rows = [(c, i, path) for c, (paths, _) in enumerate(CASES) for i, path in enumerate(paths or [None])]
    df = spark.createDataFrame(rows[::-1], "component int, at int, path string")
    assert dict(work_labels(df).collect()) == {c: label for c, (_, label) in enumerate(CASES)}


def test_labels_of_a_large_group(spark):
    """A label of 60,000 titles, which a comparison of each with all could not finish."""
    n = 60_000
    df = spark.range(n).selectExpr("1 component", "id at", "concat('[Ada] Title ', id, ' (scan).zip') path")
    titles = " / ".join(f"Title {i}" for i in range(n))
    assert [tuple(r) for r in work_labels(df).collect()] == [(1, f"[{UNKNOWN}(Ada)] {titles} (scan)")]
