"""Nested archive expansion in one pass.

Each archive row (by name) is unpacked by one ``mapInArrow`` stage, the standard library's
``zipfile`` / ``tarfile`` working on the bytes in memory, without local folders, and archives found
inside are unpacked in turn (``extracted_from`` = SHA-256 of the archive, ``depth`` + 1, path relative
to that archive). Members leave as they are read, in frames bounded by bytes, and are then spread
over the cluster by archive and path, so one large archive is scanned by many tasks. Nothing is
checkpointed: a lost executor unpacks its archives again. A worker holds one batch of archives, the
archive it reads and one frame, however many archives its task has.

Every archive has a status, one of ``ok / too_many / too_big / escape / corrupt / unsupported /
too_deep``, which comes from its listing and, for damage, from one reading without keeping.

Refusals keep the reference's rules, as parameters (``Limits``): an archive is refused whole, and
visibly, when it declares more than 10,000 entries or more than 500 MiB, when a zip member escapes
the destination, or when a tar member fails the standard ``data`` extraction filter; a tar that fails
midway yields no children at all; archives at depth 10 are ``too_deep``. Zip members that are symlinks
become regular files holding the link text; tar symlinks are extracted but not walked (no row);
duplicate names keep the last member.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..session import bound_batches, release, ship_package, written
from ..sources.files import archive_extension

MEMBER = "bundle_id string, path string, content binary, extracted_from string, depth int, parent_path string"
STATUS = "bundle_id string, path string, depth int, status string"
UNPACKED = MEMBER + ", status string"
TOP = "bundle_id string, archive_path string, path string, content binary, is_dir boolean"

_FAKE_DEST = "/__bundlescan_dest__"
_FRAME_BYTES, _FRAME_ROWS = 4 << 20, 20_000


@dataclass(frozen=True)
class Limits:
    """What an archive may declare before it is refused; None: anything."""

    entries: int | None = rules.MAX_ARCHIVE_ENTRIES
    total_bytes: int | None = rules.MAX_ARCHIVE_BYTES
    depth: int = rules.MAX_ARCHIVE_DEPTH

    def refuses(self, entries: int, total_bytes: int) -> str | None:
        if self.entries is not None and entries > self.entries:
            return "too_many"
        return "too_big" if self.total_bytes is not None and total_bytes > self.total_bytes else None


#: A listing: status, member name -> reader of its bytes, folder names.
Listing = tuple[str, dict[str, Callable[[], bytes]], set[str]]


def _longest_ext(name: str) -> str:
    low = name.lower()
    for e in sorted(rules.ARCHIVE_EXTENSIONS, key=len, reverse=True):
        if low.endswith(e):
            return e
    return ""


def _drain(stream) -> None:
    while stream.read(1 << 20):
        pass


def _zip_listing(data: bytes, limits: Limits) -> Listing:
    zf = zipfile.ZipFile(io.BytesIO(data))
    infos = zf.infolist()
    refused = limits.refuses(len(infos), sum(i.file_size for i in infos))
    if refused:
        return refused, {}, set()
    members, folders = {}, set()
    for i in infos:
        target = posixpath.normpath(posixpath.join(_FAKE_DEST, i.filename))
        if not (target.startswith(_FAKE_DEST + "/") or target == _FAKE_DEST):
            return "escape", {}, set()
        # zipfile drops empty, '.' and '..' parts when it writes the member
        parts = [p for p in i.filename.split("/") if p not in ("", ".", "..")]
        if parts and i.is_dir():
            folders.add("/".join(parts))
        elif parts:
            members["/".join(parts)] = i
    for i in members.values():
        with zf.open(i) as stream:
            _drain(stream)  # damage shows before the first member leaves
    return _checked({n: (lambda i=i: zf.read(i)) for n, i in members.items()}, folders)


def _tar_listing(data: bytes, limits: Limits) -> Listing:
    tf = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
    infos = tf.getmembers()
    refused = limits.refuses(len(infos), sum(m.size for m in infos if m.isfile()))
    if refused:
        return refused, {}, set()
    members, folders = {}, set()
    for m in infos:
        try:
            m = tarfile.data_filter(m, _FAKE_DEST)
        except tarfile.FilterError:
            return "escape", {}, set()
        name = posixpath.normpath(m.name)
        if m.isfile():
            stream = tf.extractfile(m)
            if stream is not None:
                _drain(stream)
            members[name] = m
        elif m.islnk():
            src = posixpath.normpath(m.linkname)
            if src not in members:
                return "corrupt", {}, set()
            members[name] = members[src]
        elif m.issym():
            members.pop(name, None)  # extracted as a link, never walked
        elif m.isdir() and name != ".":
            folders.add(name)

    def read(m) -> bytes:
        stream = tf.extractfile(m)
        return stream.read() if stream is not None else b""

    return _checked({n: (lambda m=m: read(m)) for n, m in members.items()}, folders)


def _checked(members: dict[str, Callable[[], bytes]], folders: set[str]) -> Listing:
    """A path that is a file and also a parent folder cannot be written to disk: the
    reference's extraction would fail, so the archive yields nothing."""
    parents = set(folders)
    for path in members:
        while path := posixpath.dirname(path):
            parents.add(path)
    return ("corrupt", {}, set()) if parents & set(members) else ("ok", members, parents)


def listing(name: str, data: bytes, limits: Limits) -> Listing:
    ext = _longest_ext(name)
    if ext not in (".zip", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar"):
        return "unsupported", {}, set()
    try:
        return (_zip_listing if ext == ".zip" else _tar_listing)(data, limits)
    except Exception:  # noqa: BLE001 - a broken archive is a warning, never a job failure
        return "corrupt", {}, set()


def _walk(bundle: str, path: str, data: bytes, depth: int, limits: Limits, emit: str) -> Iterator[tuple]:
    """Rows of an archive and the archives in it: its members, its statuses or both; for ``top``, the
    members and folders of the archive alone."""
    deep = depth + 1 > limits.depth
    status, members, folders = ("too_deep", {}, set()) if deep else listing(path.rsplit("/", 1)[-1], data, limits)
    if emit == "status":
        yield bundle, path, depth, status
    elif emit == "all":
        yield bundle, path, None, None, depth, None, status
    elif emit == "top":
        yield from ((bundle, path, f, None, True) for f in sorted(folders))
        yield from ((bundle, path, name, members[name](), False) for name in sorted(members))
        return
    own = hashlib.sha256(data).hexdigest()
    for name in sorted(members):
        nested = _longest_ext(name.rsplit("/", 1)[-1]) != ""
        if emit in ("member", "all") or nested:
            content = members[name]()
            if emit in ("member", "all"):
                yield (bundle, name, content, own, depth + 1, path, None)[:None if emit == "all" else -1]
            if nested:
                yield from _walk(bundle, name, content, depth + 1, limits, emit)


_ARROW = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows of batches, one at a time: only a row's own values become Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [column[i].as_py() for column in batch.columns]


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, bounded by bytes and rows; at the end freed memory is given back."""
    fields = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in schema.split(", "))])
    held, size = [], 0

    def frame() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= _FRAME_BYTES or len(held) >= _FRAME_ROWS:
            yield frame()
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield frame()
    release()


def _unpacked(files: DataFrame, limits: Limits, emit: str, schema: str) -> DataFrame:
    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)
    archives = files.where(archive_extension(F.col("path")) != "").select("bundle_id", "path", "content")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frames((out for bundle, path, content in _rows(batches) for out in _walk(bundle, path, bytes(content), 0, limits, emit)), schema)

    return archives.mapInArrow(stage, schema)


def unpack(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Members and statuses of all archives from one pass: a row a member, with its content, and a row
    an archive met, with its status. Write it once where both are wanted (session.written)."""
    return _unpacked(files, limits, "all", UNPACKED)


def statuses(unpacked: DataFrame) -> DataFrame:
    return unpacked.where(F.col("status").isNotNull()).select("bundle_id", "path", "depth", "status")


def with_members(files: DataFrame, unpacked: DataFrame) -> DataFrame:
    """files with the members that unpack() found, dealt by archive and path."""
    members = unpacked.where(F.col("status").isNull()).drop("status")
    return _own(files).unionByName(members.repartition("extracted_from", "path"))


def _own(files: DataFrame) -> DataFrame:
    return files.select("bundle_id", "path", "content", F.lit(None).cast("string").alias("extracted_from"),
                        F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_path"))


def archive_status(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(bundle_id, path, depth, status) of every archive met; members' bytes are read only where an
    archive is nested."""
    return _unpacked(files, limits, "status", STATUS)


def expand_archives(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """files(bundle_id, path, content) with the extracted members: ``extracted_from``, ``depth`` and
    ``parent_path``, the path of the archive a member came from."""
    return _own(files).unionByName(_unpacked(files, limits, "member", MEMBER).repartition("extracted_from", "path"))


def root_normalize(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Uploaded-zip root rule, per top-level zip: when it has exactly one top-level folder (an empty
    one counts) and no top-level SKILL.md, that folder becomes the root (prefix stripped) and loose
    top-level files are dropped; otherwise members stay as they are. Zips are read once: their members
    and folders are written to the shared folder, where the rule and the contents are read.
    -> bundle_id, archive_path, path, content: the bundles that zips stand for."""
    zips = files.where(F.lower("path").endswith(".zip"))
    found = written(_unpacked(zips, limits, "top", TOP), "zip-members")
    top = F.col("is_dir") & ~F.col("path").contains("/")
    skill = ~F.col("is_dir") & (F.col("path") == "SKILL.md")
    rule = found.where(top | skill).groupBy("bundle_id", "archive_path").agg(
        F.count_if(top).alias("_dirs"), F.max(F.when(top, F.col("path"))).alias("_dir"), F.bool_or(skill).alias("_skill"))
    single = rule.where((F.col("_dirs") == 1) & ~F.col("_skill")).select("bundle_id", "archive_path", "_dir")
    j = found.where(~F.col("is_dir")).join(single, ["bundle_id", "archive_path"], "left")
    return j.where(F.col("_dir").isNull() | F.col("path").startswith(F.concat("_dir", F.lit("/")))).select(
        "bundle_id", "archive_path", F.when(F.col("_dir").isNotNull(), F.expr("substring(path, length(_dir) + 2)")).otherwise(F.col("path")).alias("path"),
        "content")


def zip_targets(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """files(bundle_id, path, content) of zips that are scan targets themselves: each top-level zip is
    a bundle of its own, ``<bundle>/<zip path>``, with the normalised root as its files."""
    return root_normalize(files, limits).select(F.concat_ws("/", "bundle_id", "archive_path").alias("bundle_id"), "path", "content")


# ------------------------------------------------------------------ listings

LISTED = ("bundle_id string, path string, depth int, member string, size_bytes bigint, is_dir boolean, escapes boolean, "
          "broken boolean, supported boolean, archive_no bigint")


def _listed(bundle: str, path: str, data: bytes, depth: int, number: int, limits: Limits) -> Iterator[tuple]:
    """A row for each member that an archive's directory or headers name, and one for the archive
    itself; nested archives are followed. Members' bytes are read only where an archive is nested."""
    ext = _longest_ext(path.rsplit("/", 1)[-1])
    supported = ext in (".zip", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar")
    rows, nested, broken = [], [], False
    try:
        if supported and depth < limits.depth:
            if ext == ".zip":
                zf = zipfile.ZipFile(io.BytesIO(data))
                for i in zf.infolist():
                    target = posixpath.normpath(posixpath.join(_FAKE_DEST, i.filename))
                    rows.append((i.filename, i.file_size, i.is_dir(), not (target + "/").startswith(_FAKE_DEST + "/")))
                    if _longest_ext(i.filename.rsplit("/", 1)[-1]) and not i.is_dir():
                        nested.append((i.filename, lambda i=i: zf.read(i)))
            else:
                tf = tarfile.open(fileobj=io.BytesIO(data), mode="r:*")
                for m in tf:
                    rows.append((m.name, m.size if m.isfile() else 0, m.isdir(), _tar_escapes(m)))
                    if m.isfile() and _longest_ext(m.name.rsplit("/", 1)[-1]):
                        nested.append((m.name, lambda m=m: tf.extractfile(m).read()))
    except Exception:  # noqa: BLE001 - a broken archive is a status, never a job failure
        rows, nested, broken = [], [], True
    head = bundle, path, depth
    yield (*head, None, None, None, None, broken, supported, number)
    yield from ((*head, *r, None, None, number) for r in rows)
    whole = not any(r[3] for r in rows) and limits.refuses(len(rows), sum(r[1] for r in rows)) is None
    for k, (name, read) in enumerate(nested if whole else []):
        try:
            inner = read()
        except Exception:  # noqa: BLE001
            continue
        yield from _listed(bundle, name, inner, depth + 1, _number(f"{number}/{k}"), limits)


def _number(name: str) -> int:
    """Tells archives of one bundle, path and depth apart."""
    return int.from_bytes(hashlib.sha256(name.encode("utf-8", "surrogatepass")).digest()[:7], "big")


def _tar_escapes(m: tarfile.TarInfo) -> bool:
    try:
        tarfile.data_filter(m, _FAKE_DEST)
    except tarfile.FilterError:
        return True
    return False


def archive_listing(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(bundle_id, path, depth, member, size_bytes, is_dir, escapes, broken, supported, archive_no): what
    central directories and headers declare, a row a member, so that archives are judged before
    anything is unpacked. A row without a member stands for the archive itself."""
    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frames((out for bundle, path, content in _rows(batches)
                        for out in _listed(bundle, path, bytes(content), 0, _number(f"{bundle}\0{path}"), limits)), LISTED)

    archives = files.where(archive_extension(F.col("path")) != "").select("bundle_id", "path", "content")
    return archives.mapInArrow(stage, LISTED)


def listing_status(listed: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(bundle_id, path, depth, status, n_members, declared_bytes) of each archive from its listing alone:
    one aggregate, combined in the tasks first. Damage that only unpacking shows is not seen here."""
    every = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    sums = listed.groupBy("bundle_id", "path", "depth", "archive_no").agg(
        F.count("member").alias("n_members"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("declared_bytes"),
        every(F.col("escapes")).alias("escapes"), every(F.col("broken")).alias("broken"), every(F.col("supported")).alias("supported"))
    over = lambda c, most: F.lit(False) if most is None else F.col(c) > most
    status = (F.when(F.col("depth") + 1 > limits.depth, "too_deep").when(~F.col("supported"), "unsupported").when(F.col("broken"), "corrupt")
              .when(over("n_members", limits.entries), "too_many").when(over("declared_bytes", limits.total_bytes), "too_big")
              .when(F.col("escapes"), "escape").otherwise("ok"))
    return sums.select("bundle_id", "path", "depth", status.alias("status"), "n_members", "declared_bytes")


# ------------------------------------------------------------------ archives on a file system

INDEX = "bundle_id string, path string, file string, status string, member string, at bigint, stored bigint, size_bytes bigint, archive_sha256 string"


def _index(bundle: str, path: str, file: str, limits: Limits) -> Iterator[tuple]:
    """A row an archive, with its status, and a row a member, with where its bytes lie: read from the
    central directory of a zip or by seeking from header to header of a plain tar."""
    head = bundle, path, file
    try:
        with open(file, "rb") as data:
            own = hashlib.file_digest(data, "sha256").hexdigest()
            data.seek(0)
            members: dict[str, tuple[int, int, int]] = {}
            if _longest_ext(path.rsplit("/", 1)[-1]) == ".zip":
                with zipfile.ZipFile(data) as zf:
                    infos = zf.infolist()
                    names = [(i.filename, i.header_offset, i.compress_size, i.file_size, i.is_dir()) for i in infos]
                    escapes = any(not (posixpath.normpath(posixpath.join(_FAKE_DEST, n[0])) + "/").startswith(_FAKE_DEST + "/") for n in names)
                    names = [("/".join(p for p in n[0].split("/") if p not in ("", ".", "..")), *n[1:]) for n in names]
            else:
                with tarfile.open(fileobj=data, mode="r:") as tf:
                    infos = tf.getmembers()
                    escapes = any(_tar_escapes(m) for m in infos)
                    if any(m.islnk() for m in infos):
                        raise ValueError("links are left to expand_archives")
                    names = [(posixpath.normpath(m.name), m.offset_data, m.size, m.size, not m.isfile()) for m in infos]
            refused = limits.refuses(len(names), sum(n[3] for n in names if not n[4]))
            status = refused or ("escape" if escapes else "ok")
            folders = {n[0] for n in names if n[4]}
            for name, at, stored, size, other in names:
                if name and not other:
                    members[name] = (at, stored, size)
                    parent = name
                    while parent := posixpath.dirname(parent):
                        folders.add(parent)
            if status == "ok" and folders & set(members):
                status = "corrupt"
    except Exception:  # noqa: BLE001 - a broken archive is a status, never a job failure
        yield (*head, "corrupt", None, None, None, None, None)
        return
    yield (*head, status, None, None, None, None, own)
    if status == "ok":
        yield from ((*head, None, name, at, stored, size, own) for name, (at, stored, size) in sorted(members.items()))


def member_index(paths: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """paths(bundle_id, path, file): zips and plain tars on a file system that all executors see ->
    a row an archive, with its status, and a row a member, with its place in the file."""
    ship_package(paths.sparkSession)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frames((out for row in _rows(batches) for out in _index(*row, limits)), INDEX)

    return paths.select("bundle_id", "path", "file").mapInArrow(stage, INDEX)


def read_members(index: DataFrame, tasks: int) -> DataFrame:
    """files(bundle_id, path, content, extracted_from, depth, parent_path) of the members of an index. The
    members of all archives are dealt over the tasks by their place, so one archive that holds nearly
    all of them is read by many tasks, each of which seeks to its own members."""
    members = index.where(F.col("member").isNotNull())
    dealt = members.repartitionByRange(tasks, "file", "at").sortWithinPartitions("file", "at")

    def read(rows: Iterator[list]) -> Iterator[tuple]:
        opened, data, zf, places = None, None, None, {}
        for bundle, path, file, member, at, stored, sha256 in rows:
            if file != opened:
                opened, data = file, open(file, "rb")  # noqa: SIM115 - kept for the next members
                zf = zipfile.ZipFile(data) if _longest_ext(path.rsplit("/", 1)[-1]) == ".zip" else None
                places = {i.header_offset: i for i in zf.infolist()} if zf else {}
            if zf:
                content = zf.read(places[at])
            else:
                data.seek(at)
                content = data.read(stored)
            yield bundle, member, content, sha256, 1, path

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _frames(read(_rows(batches)), MEMBER)

    return dealt.select("bundle_id", "path", "file", "member", "at", "stored", "archive_sha256").mapInArrow(stage, MEMBER)


def archive_lineage(expanded: DataFrame) -> DataFrame:
    """(bundle_id, path, depth, parent_path): each member with the archive it came from; a member of
    two equal archives has a row for either."""
    return expanded.where(F.col("extracted_from").isNotNull()).select(
        "bundle_id", "path", F.col("depth").cast("long").alias("depth"), "parent_path")
