"""Folders of container files as tables: discovery, listings, members and digests.

Files are read by ranges: a listing needs a container's tail and directory, a member its own bytes, a digest one chunk at a
time. So no container is ever a value, however large it is.
"""

from __future__ import annotations

import errno
import functools
import hashlib
import os
import re
import struct
import unicodedata
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomatch.functions.fingerprints import listing_signature
from foliomatch.functions.text import archive_format, entry_key, entry_kind, natural_key, path_key
from foliomatch.plans.stages import materialize, shuffle_partitions

# Most members of a container, most bytes of its listing, most bytes of a member, bytes of a chunk.
MAX_MEMBERS, MAX_LISTING, MAX_MEMBER, CHUNK = 50_000, 32 << 20, 128 << 20, 8 << 20
MEMBERS = "path string, member string, size long, packed long, crc string, encrypted boolean, error string"
#: Tasks that the members of one container are dealt to, and bytes of payloads that a task hands on at once.
DEALT, BATCH_BYTES = 16, 8 << 20
#: Written containers that a task tells of at once.
WRITTEN = 1000


def discover(spark: SparkSession, root: str) -> DataFrame:
    """``(path, path_key, file_size, mtime_ns, format)`` of all container files under ``root``; others are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rows = files.select("path", F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), archive_format(F.col("path")).alias("format"))
    return rows.where("format IS NOT NULL").withColumn("path_key", path_key(F.col("path")))


FOUND = "path string, folder boolean, file_size long, mtime_ns long, code string"


def _code(error: OSError) -> str:
    """What an error of the file system is called."""
    if error.errno in (errno.ENOENT, errno.ENOTDIR):
        return "FILE_NOT_FOUND"
    if error.errno in (errno.EACCES, errno.EPERM):
        return "ACCESS_DENIED"
    return "PATH_TOO_LONG" if error.errno == errno.ENAMETOOLONG else "DISCOVERY_ERROR"


def _entries(folder: str) -> Iterator[tuple]:
    """``FOUND`` rows of one folder: its folders, its files, and what could not be looked at. Links are passed over."""
    from pyarrow import fs

    place, path = _place(folder)
    try:
        if not isinstance(place, fs.LocalFileSystem):
            scheme = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
            for info in place.get_file_info(fs.FileSelector(path)):
                yield scheme + info.path, info.type == fs.FileType.Directory, info.size, info.mtime_ns, None
            return
        if os.path.islink(path):
            return
        with os.scandir(path) as entries:
            for entry in entries:
                try:
                    if entry.is_symlink():
                        continue
                    status = entry.stat(follow_symlinks=False)
                    yield entry.path, entry.is_dir(follow_symlinks=False), status.st_size, status.st_mtime_ns, None
                except OSError as error:
                    yield entry.path, False, None, None, _code(error)
    except OSError as error:
        yield folder, False, None, None, _code(error)


def discover_folders(spark: SparkSession, root: str) -> DataFrame:
    """``(path, path_key, file_size, mtime_ns, format, code)``: container files under ``root``, and why a path could not be read.

    The folders of one depth are listed by as many tasks as there are, and those that they hold make the next round; so no
    task walks a tree, and the driver sees no path but ``root``. Links, to files or folders, are passed over. A folder whose
    comparison key was met before is not listed again. A path that failed has a code (FILE_NOT_FOUND, ACCESS_DENIED,
    PATH_TOO_LONG or DISCOVERY_ERROR) and no size; the others are looked at all the same. A root that is not there is such
    a row, a root that is a link gives none.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder in pdf.path:
                rows = list(_entries(folder))
                yield pd.DataFrame(rows, columns=["path", "folder", "file_size", "mtime_ns", "code"]).astype({"folder": "boolean", "file_size": "Int64", "mtime_ns": "Int64"})

    keyed = lambda df: df.select("path", path_key(F.col("path")).alias("key"))
    ahead = materialize(keyed(spark.createDataFrame([(root,)], "path string")), "folders")
    met, rounds = ahead.select("key"), []
    while not ahead.isEmpty():
        # a folder is a task of its own as far as there are tasks
        found = materialize(ahead.repartition(shuffle_partitions(spark), "path").select("path").mapInPandas(look, FOUND), "entries")
        rounds.append(found.where("NOT folder"))
        new = keyed(found.where("folder")).groupBy("key").agg(F.min("path").alias("path"))
        ahead = materialize(new.join(met, "key", "left_anti").select("path", "key"), "folders")
        met = met.unionByName(ahead.select("key"))
    every = functools.reduce(DataFrame.unionByName, rounds)
    wanted = every.withColumn("format", archive_format(F.col("path"))).where("code IS NOT NULL OR format IS NOT NULL")
    return wanted.select("path", path_key(F.col("path")).alias("path_key"), "file_size", "mtime_ns", F.when(F.col("code").isNull(), F.col("format")).alias("format"), "code")


class Failure(Exception):
    """Why a file or a member cannot be read; the code is its only argument."""


def _place(path: str):
    """The file system and the path in it: local paths as Spark writes them, and whatever Arrow has a file system for."""
    from pyarrow import fs

    local = re.match(r"file:/*(/.*)", path)
    if local or "://" not in path:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(path)


class Snapshot:
    """A file with the size and time (to the millisecond) that it had when it was found; None holds for any.

    On leaving, it must still have both, or what was read counts for nothing.
    """

    def __init__(self, path: str, file_size: int | None = None, mtime_ns: int | None = None):
        self.fs, self.path = _place(path)
        self.file_size, self.mtime_ns = file_size, mtime_ns

    def _check(self) -> int:
        info = self.fs.get_file_info(self.path)
        if not info.is_file:
            raise Failure("FILE_NOT_FOUND")
        old, now = self.mtime_ns, info.mtime_ns
        if self.file_size not in (None, info.size) or (old is not None and now is not None and old // 10**6 != now // 10**6):
            raise Failure("SNAPSHOT_CHANGED")
        self.file_size, self.mtime_ns = info.size, now
        return info.size

    def __enter__(self) -> Snapshot:
        self.size = self._check()
        try:
            self.stream = self.fs.open_input_file(self.path)
        except FileNotFoundError as error:
            raise Failure("FILE_NOT_FOUND") from error
        except PermissionError as error:
            raise Failure("ACCESS_DENIED") from error
        return self

    def __exit__(self, kind, *_) -> None:
        self.stream.close()
        if kind is None:
            self._check()


def _announced(stream, size: int) -> tuple[int, int]:
    """Members and bytes of the directory that the file's last record names, before any of it is parsed."""
    stream.seek(max(0, size - 65_557 - 20))
    tail = stream.read(65_557 + 20)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or at > len(tail) - 22:
        raise Failure("DAMAGED")
    n, length, offset = struct.unpack_from("<HII", tail, at + 10)
    if (n == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF) and at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        stream.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        record = stream.read(56)
        if record[:4] == b"PK\6\6" and len(record) == 56:
            n, length = struct.unpack_from("<QQ", record, 32)
    return n, length


def _infos(stream, size: int) -> tuple[zipfile.ZipFile, list[zipfile.ZipInfo]]:
    """An opened ZIP with its members, directories left out."""
    n, length = _announced(stream, size)
    if n > MAX_MEMBERS:
        raise Failure("TOO_MANY_MEMBERS")
    if length > MAX_LISTING:
        raise Failure("LISTING_TOO_LARGE")
    try:
        z = zipfile.ZipFile(stream)
    except (zipfile.BadZipFile, ValueError, EOFError, OverflowError) as error:
        raise Failure("DAMAGED") from error
    if len(z.infolist()) > MAX_MEMBERS:
        raise Failure("TOO_MANY_MEMBERS")
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Failure("ENCRYPTED")
    return z, [i for i in z.infolist() if not i.filename.endswith(("/", "\\"))]


def _natural(name: str) -> list[tuple]:
    """The order of ``natural_key`` and then of names."""
    out = []
    for p in re.findall("[0-9]+|[^0-9]+", unicodedata.normalize("NFC", name.replace("\\", "/")).casefold()):
        if p[0] not in "0123456789":
            out.append((1, 0, p))
        elif len(p.lstrip("0")) <= 38:
            out.append((0, int(p), ""))
        else:
            out.append((0, 10**38 - 1, f"{len(p):06d}{p}"))
    return [*out, (-1, 0, name)]


def _listing(path: str, file_size: int | None, mtime_ns: int | None) -> list[tuple]:
    try:
        with Snapshot(path, file_size, mtime_ns) as snapshot:
            _, infos = _infos(snapshot.stream, snapshot.size)
            rows = [(path, i.filename, i.file_size, i.compress_size, f"{i.CRC:08x}", False, None) for i in infos]
        if not rows:
            raise Failure("EMPTY")
        return rows
    except Failure as failure:
        return [(path, None, None, None, None, None, str(failure))]


def _with_snapshot(files: DataFrame) -> DataFrame:
    """``(path, file_size, mtime_ns)``; a column that ``files`` lacks is null."""
    return files.select("path", *[(F.col(c) if c in files.columns else F.lit(None)).cast("long").alias(c) for c in ("file_size", "mtime_ns")])


def _given(value) -> int | None:
    return None if value is None or value is pd.NA or value != value else int(value)


def list_members(files: DataFrame) -> DataFrame:
    """Members of ZIP and CBZ files ``(path[, file_size, mtime_ns])``: one row each, or one with an error code.

    Directories are dropped; ``pos`` numbers members in natural order of their names, ``kind`` tells images and nested
    containers from the rest. Other formats give UNSUPPORTED_FORMAT; a file that is gone, may not be read or is not as it
    was found gives FILE_NOT_FOUND, ACCESS_DENIED or SNAPSHOT_CHANGED, one without an end record DAMAGED. A task holds one
    directory at a time.
    """
    zips = archive_format(F.col("path")).isin("zip", "cbz")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rows = _listing(row.path, _given(row.file_size), _given(row.mtime_ns))
                yield pd.DataFrame(rows, columns=["path", "member", "size", "packed", "crc", "encrypted", "error"]).astype({"size": "Int64", "packed": "Int64", "encrypted": "boolean"})

    found = _with_snapshot(files.where(zips)).mapInPandas(read, MEMBERS)
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("member", "string"), ("size", "long"), ("packed", "long"), ("crc", "string"), ("encrypted", "boolean"))]
    other = files.where(~F.coalesce(zips, F.lit(False))).select("path", *nothing, F.lit("UNSUPPORTED_FORMAT").alias("error"))
    order = Window.partitionBy("path").orderBy(natural_key(F.col("member")), "member")
    pos = F.when(F.col("member").isNotNull(), F.row_number().over(order) - 1)
    return found.unionByName(other).withColumn("pos", pos).withColumn("kind", F.when(F.col("member").isNotNull(), entry_kind(F.col("member"))))


def inventory(members: DataFrame) -> DataFrame:
    """``(path, n_members, n_images, n_nested, signature, error)`` of each listed container."""
    entry = F.struct("pos", F.col("_key").alias("path"), "size", "packed", "crc", "kind")
    return members.withColumn("_key", entry_key(F.col("member"))).groupBy("path").agg(
        F.count("member").alias("n_members"), F.count_if(F.col("kind") == "IMAGE").alias("n_images"), F.count_if(F.col("kind") == "NESTED_ARCHIVE").alias("n_nested"),
        F.when(F.count("member") > 0, listing_signature(F.collect_list(F.when(F.col("member").isNotNull(), entry)))).alias("signature"), F.max("error").alias("error"),
    )


def read_members(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(path, member, payload, error)`` of ``wanted(path, member, size, crc[, pos])`` in ``files(path[, file_size, mtime_ns])``.

    With ``pos`` a member is sought at its place in natural order and must have its name, else ENTRY_CHANGED; without, by
    name. A payload whose size or CRC is not the listed one, or above ``MAX_MEMBER``, gives an error and no payload; so does
    a container that is gone, changed or damaged. The members of one container are dealt to ``DEALT`` tasks, each of which
    reads its directory once and the bytes of its members alone.
    """
    asked = wanted.select("path", "member", "size", "crc", (F.col("pos") if "pos" in wanted.columns else F.lit(None)).cast("int").alias("pos"))
    rows = asked.join(_with_snapshot(files), "path")
    dealt = rows.repartition("path", F.pmod(F.xxhash64("member"), F.lit(DEALT))).sortWithinPartitions("path", "pos", "member")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, items in pdf.groupby("path", sort=False):
                out, n = [], 0
                for row in _payloads(path, items):
                    out.append(row)
                    n += len(row[2] or b"")
                    if n >= BATCH_BYTES:
                        yield pd.DataFrame(out, columns=["path", "member", "payload", "error"])
                        out, n = [], 0
                yield pd.DataFrame(out, columns=["path", "member", "payload", "error"])

    return dealt.mapInPandas(read, "path string, member string, payload binary, error string")


def _payloads(path: str, items: pd.DataFrame) -> Iterator[tuple]:
    """Payloads of one container; each counts only if the container has not changed by the time that it was read."""
    first = items.iloc[0]
    try:
        with Snapshot(path, _given(first.file_size), _given(first.mtime_ns)) as snapshot:
            z, infos = _infos(snapshot.stream, snapshot.size)
            infos.sort(key=lambda i: _natural(i.filename))
            names = {i.filename: i for i in infos}
            for item in items.itertuples(index=False):
                pos = _given(item.pos)
                info = names.get(item.member) if pos is None else infos[pos] if pos < len(infos) else None
                row = (path, item.member, *_payload(z, info, item))
                snapshot._check()
                yield row
    except Failure as failure:
        for member in items.member:
            yield path, member, None, str(failure)


def _payload(z: zipfile.ZipFile, info: zipfile.ZipInfo | None, item) -> tuple[bytes | None, str | None]:
    if info is None or info.filename != item.member:
        return None, "ENTRY_CHANGED"
    if info.file_size > MAX_MEMBER:
        return None, "MEMBER_TOO_LARGE"
    try:
        with z.open(info) as stream:
            data = stream.read(MAX_MEMBER + 1)
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
        return None, "MEMBER_UNREADABLE"
    if len(data) > MAX_MEMBER:
        return None, "MEMBER_TOO_LARGE"
    if (size := _given(item.size)) is not None and len(data) != size:
        return None, "SIZE_MISMATCH"
    if item.crc and f"{zlib.crc32(data):08x}" != re.sub("^0x", "", item.crc.lower()).zfill(8):
        return None, "CRC_MISMATCH"
    return data, None


def file_digests(files: DataFrame) -> DataFrame:
    """``(path, sha256, error)`` of ``files(path[, file_size, mtime_ns])`` of any kind, in chunks of ``CHUNK`` bytes.

    A file that is gone, may not be read, or is not as it was found, before or after, has an error code and no digest.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(row.path, *_digest(row.path, _given(row.file_size), _given(row.mtime_ns))) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["path", "sha256", "error"])

    return _with_snapshot(files).mapInPandas(read, "path string, sha256 string, error string")


def _digest(path: str, file_size: int | None, mtime_ns: int | None) -> tuple[str | None, str | None]:
    digest = hashlib.sha256()
    try:
        with Snapshot(path, file_size, mtime_ns) as snapshot:
            while chunk := snapshot.stream.read(CHUNK):
                digest.update(chunk)
        return digest.hexdigest(), None
    except Failure as failure:
        return None, str(failure)


def write_containers(rows: DataFrame, root: str) -> DataFrame:
    """Write ``rows(container, member, payload)`` as ``root/<container>.zip``; gives ``(container, members)`` when it runs.

    All members of a container pass through one task, one at a time, in natural order; so a container must fit a disk and
    not a memory. A file is written beside its place and then moved there, and equal rows make equal files, so a task that
    runs twice does no harm. Null payloads are empty; a name with slashes is a file in folders.
    """
    slim = rows.select("container", "member", F.coalesce("payload", F.lit(b"")).alias("payload"))
    dealt = slim.repartition("container").sortWithinPartitions(F.col("container"), natural_key(F.col("member")), F.col("member"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, top = _place(root)
        fs.create_dir(top)
        name, n, z, stream, waiting = None, 0, None, None, None
        folders, done = {top}, []

        def close() -> None:
            z.close()
            stream.close()
            if (folder := os.path.dirname(f"{top}/{name}")) not in folders:
                fs.create_dir(folder)
                folders.add(folder)
            fs.move(waiting, f"{top}/{name}.zip")
            done.append((name, n))

        def told() -> pd.DataFrame:
            out = pd.DataFrame(done, columns=["container", "members"])
            done.clear()
            return out

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.container != name:
                    if z is not None:
                        close()
                        if len(done) >= WRITTEN:
                            yield told()
                    name, n, waiting = row.container, 0, f"{top}/.{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(waiting)
                    z = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(row.member)
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, row.payload)
                n += 1
        if z is not None:
            close()
            yield told()

    return dealt.mapInPandas(write, "container string, members long")


def parse_listing(lines: DataFrame) -> DataFrame:
    """Members from technical listings ``(path, text)`` of blocks of "Key = value" lines separated by blank ones."""
    block = F.explode(F.split(F.regexp_replace("text", "\r\n", "\n"), r"\n\s*\n"))
    pairs = F.map_from_entries(F.transform(F.filter(F.split("block", "\n"), lambda x: x.contains(" = ")), lambda x: F.struct(F.trim(F.substring_index(x, " = ", 1)).alias("k"), F.regexp_extract(x, r" = (.*)$", 1).alias("v"))))
    rows = lines.select("path", block.alias("block")).select("path", pairs.alias("m"))
    size = F.try_element_at("m", F.lit("Size"))
    folder = F.coalesce(F.try_element_at("m", F.lit("Folder")), F.lit("-"))
    out = rows.where(F.try_element_at("m", F.lit("Path")).isNotNull() & size.isNotNull() & (folder != "+"))
    return out.select("path", F.try_element_at("m", F.lit("Path")).alias("member"), F.expr("try_cast(m['Size'] AS bigint)").alias("size"), F.lower(F.try_element_at("m", F.lit("CRC"))).alias("crc"), (F.try_element_at("m", F.lit("Encrypted")) == "+").alias("encrypted"))
