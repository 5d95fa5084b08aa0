"""Tables in generations: several are replaced together, and a reader stays with the generation that it opened.

A generation is one small manifest that names the folders of all its tables. Data is written first, under names that nobody
knows; the manifest is then moved into its numbered place in one rename. So a reader sees all tables of one generation or
all of another, and a writer that dies leaves nothing but folders that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from foliomatch.operators.graph import regrouped

#: The part of a table that is replaced as a whole.
WHOLE = ""


class Conflict(RuntimeError):
    """Another writer has published a generation since the one that this one started from."""


@dataclass(frozen=True)
class Generation:
    """One state of all tables: ``folders[table][part]``; number 0 is the empty state before the first."""

    spark: SparkSession
    root: str
    number: int
    folders: dict[str, dict[str, str]] = field(default_factory=dict)

    def has(self, table: str, part: str | None = None) -> bool:
        return table in self.folders and (part is None or part in self.folders[table])

    def table(self, name: str, part: str | None = None) -> DataFrame:
        """A table, or one part of it; what is published later does not change it."""
        parts = self.folders[name]
        wanted = sorted(parts.values()) if part is None else [parts[part]]
        return self.spark.read.parquet(*[f"{self.root}/data/{folder}" for folder in wanted])


class Generations:
    """The generations under one folder of any file system whose renames are atomic."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        top = self._path(f"{self.root}/generations")
        if not self._fs.exists(top):
            return []
        return sorted(int(n) for n in (s.getPath().getName() for s in self._fs.listStatus(top)) if n.isdigit())

    def _manifest(self, folder: str) -> dict:
        stream = self._fs.open(self._path(f"{folder}/manifest.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> int:
        return max(self._numbers(), default=0)

    def open(self, number: int | None = None) -> Generation:
        """The latest generation, or one by number; a number that is not there, or was expired, is an error."""
        number = self.latest() if number is None else number
        if number == 0:
            return Generation(self.spark, self.root, 0)
        return Generation(self.spark, self.root, number, self._manifest(f"{self.root}/generations/{number:010d}")["folders"])

    def commit(self, tables: dict[str | tuple[str, str], DataFrame], after: int | None = None) -> int:
        """Publish a generation in which ``tables``, by name or by (name, part), are replaced and all else is as before.

        ``after`` is the generation that the rows were worked out from, else the latest. If any other was published since,
        nothing is and ``Conflict`` is raised; the caller works its rows out again.
        """
        base = self.open(after)
        folders = {name: dict(parts) for name, parts in base.folders.items()}
        for key, rows in tables.items():
            name, part = (key, WHOLE) if isinstance(key, str) else key
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.write.option("compression", "zstd").parquet(f"{self.root}/data/{folder}")
            folders.setdefault(name, {})[part] = folder
        return self._publish(base.number + 1, folders)

    def _publish(self, number: int, folders: dict) -> int:
        mine = uuid.uuid4().hex
        waiting, place = f"{self.root}/waiting/{mine}", f"{self.root}/generations/{number:010d}"
        out = self._fs.create(self._path(f"{waiting}/manifest.json"))
        out.write(bytearray(json.dumps({"number": number, "writer": mine, "folders": folders}).encode()))
        out.close()
        self._fs.mkdirs(self._path(f"{self.root}/generations"))
        if not self._fs.exists(self._path(place)):
            # a folder that is there already is never replaced: the rename fails or ends inside it
            self._fs.rename(self._path(waiting), self._path(place))
        if self._manifest(place)["writer"] != mine:
            for left in (waiting, f"{place}/{mine}"):
                self._fs.delete(self._path(left), True)
            raise Conflict(f"generation {number} was published by another writer")
        return number

    def expire(self, keep: int = 2) -> list[str]:
        """Forget all but the last ``keep`` generations, with the folders that no remaining one names; gives their names.

        A reader of a forgotten generation fails. Folders of a writer that has not published yet would go too, so this is
        for times without one.
        """
        numbers = self._numbers()
        named = {f for n in numbers[-keep:] for parts in self.open(n).folders.values() for f in parts.values()}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.root}/generations/{n:010d}"), True)
        data = self._path(f"{self.root}/data")
        found = [s.getPath().getName() for s in self._fs.listStatus(data)] if self._fs.exists(data) else []
        gone = sorted(set(found) - named)
        for folder in gone:
            self._fs.delete(self._path(f"{self.root}/data/{folder}"), True)
        return gone


def replace_relations(store: Generations, part: str, relations: DataFrame, usable: Column) -> int:
    """Publish ``relations(a, b, ...)`` as the graph of one part, a root and analyzer version, with its groups.

    The ``usable`` edges make the groups. Only groups that lose or gain an edge are worked out again; they and the edges
    come in one generation, so nobody sees new edges with old members. Pairs of a container with itself, or without one, are
    refused; the ledger of reviews is another table and stays.
    """
    if relations.where("a IS NULL OR b IS NULL OR a = b").limit(1).count():
        raise ValueError("a relation needs two containers")
    now = store.open()
    if now.has("relations", part):
        before, groups = now.table("relations", part).where(usable), now.table("groups", part)
    else:
        before, groups = relations.limit(0), relations.select(relations["a"].alias("archive_id"), relations["a"].alias("component")).limit(0)
    found = regrouped(groups, before, relations.where(usable))
    return store.commit({("relations", part): relations, ("groups", part): found}, after=now.number)
