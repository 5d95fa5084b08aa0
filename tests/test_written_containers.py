"""Containers that one task writes: what it tells of them, and what they hold."""

import os
import zipfile

import pandas as pd

from foliomatch.sources import archives as ar


def test_a_task_tells_of_many_small_containers_at_once(spark, tmp_path, monkeypatch):
    kept = []
    one = spark.createDataFrame([("a", "b", b"")], "container string, member string, payload binary")
    monkeypatch.setattr(type(one), "mapInPandas", lambda self, fn, schema: kept.append(fn))
    ar.write_containers(one, str(tmp_path / "root"))
    monkeypatch.setattr(ar, "WRITTEN", 100)
    names = sorted(f"f{i % 7}/deep/c{i:04d}" for i in range(250))
    rows = pd.DataFrame([(c, m, f"{c} {m}".encode()) for c in names for m in ("1.txt", "2.txt")], columns=["container", "member", "payload"])
    frames = list(kept[0](iter([rows[:101], rows[101:], rows[:0]])))
    assert [len(x) for x in frames] == [100, 100, 50]
    assert list(map(tuple, pd.concat(frames).itertuples(index=False))) == [(c, 2) for c in names]
    found = sorted(os.path.relpath(os.path.join(d, f), tmp_path / "root") for d, _, files in os.walk(tmp_path / "root") for f in files)
    assert found == [f"{c}.zip" for c in names]
    for c in names[::50]:
        with zipfile.ZipFile(tmp_path / "root" / f"{c}.zip") as z:
            assert {m: z.read(m) for m in z.namelist()} == {m: f"{c} {m}".encode() for m in ("1.txt", "2.txt")}
    assert list(kept[0](iter([]))) == []
