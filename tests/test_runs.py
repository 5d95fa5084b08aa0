"""A run that is stopped after any stage ends as if it had not been, without doing finished stages again."""

import pytest
from pyspark.sql import functions as F

from foliomatch.plans.runs import Run, input_fingerprint


def stages(run, docs, calls, fail=None):
    def build(name, rows):
        def call():
            calls.append(name)
            if name == fail:
                return rows.withColumn("x", F.raise_error(F.lit("stopped")))
            return rows

        return call

    one = run.stage("one", build("one", docs.withColumn("a", F.col("id") * 2)))
    two = run.stage("two", build("two", one.where("a > 4")), least=4)
    return run.stage("three", build("three", two.groupBy().agg(F.sum("a").alias("s"))))


@pytest.mark.parametrize("stop,left", [("one", ["one", "two", "three"]), ("two", ["two", "three"]), ("three", ["three"])])
def test_resumed_after_any_stage(spark, tmp_path, stop, left):
    spark.range(6).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    key = input_fingerprint(docs)
    with pytest.raises(Exception, match="stopped"):
        stages(Run(spark, f"{tmp_path}/runs", key), docs, [], stop)
    calls, again = [], Run(spark, f"{tmp_path}/runs", key)
    assert stages(again, docs, calls).collect()[0].s == 6 + 8 + 10
    assert calls == left == again.ran and again.found == [n for n in ("one", "two", "three") if n not in left]


def test_another_input_or_parameter_is_another_run(spark, tmp_path):
    spark.range(6).write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    first = input_fingerprint(docs)
    stages(Run(spark, f"{tmp_path}/runs", first, version=1), docs, [])
    assert stages(Run(spark, f"{tmp_path}/runs", first, version=1), docs, calls := []).collect() and calls == []
    stages(Run(spark, f"{tmp_path}/runs", first, version=2), docs, calls := [])
    assert calls == ["one", "two", "three"]
    spark.range(7).write.mode("append").parquet(f"{tmp_path}/in")
    more = spark.read.parquet(f"{tmp_path}/in")
    assert input_fingerprint(more) != first
    assert stages(Run(spark, f"{tmp_path}/runs", input_fingerprint(more), version=1), more, calls := []).collect()[0].s == 24 + 24 + 12
    assert len(calls) == 3
    with pytest.raises(ValueError):
        input_fingerprint(spark.range(3))
