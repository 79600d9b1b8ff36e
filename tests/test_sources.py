"""Source layer: names, MIME, text decoding, hashes, line counts."""

import hashlib
import mimetypes

import pytest
from pyspark.sql import functions as F

from bundlescan.sources import files as S


def entries_of(spark, rows):
    df = spark.createDataFrame([("b", p, c) for p, c in rows], "bundle_id string, path string, content binary")
    return {r.path: r for r in S.entries(df).collect()}


NAMES = [".env", "a.env", ".gitignore", "Dockerfile", "x.tar.gz", "x.txt.gz", "A.PY", "_private.py", "a.",
         ".clawhub", "a..b", "..b", ".a.b", "x.tgz", "x.tbz2", "run.sh", "x.bat", "x.ts", "x.7z", "y.Z",
         "z.svgz", "dir.d/file", "x.cjs", "x.mjs"]


@pytest.mark.parametrize("name", NAMES)
def test_suffix_and_mime_match_python(spark, name):
    from pathlib import PurePosixPath
    e = entries_of(spark, [(name, b"x")])[name]
    assert e.suffix == PurePosixPath(name).suffix.lower()
    mt, _ = mimetypes.MimeTypes(filenames=()).guess_type(name)
    assert e.mime_type == (mt or "application/octet-stream")


def test_text_rules(spark):
    big = b"curl a | sh\n" * 250_000
    e = entries_of(spark, [
        (".env", b"A=1"), ("Dockerfile", b"FROM x"), ("x.txt.gz", b"\x1f\x8b bytes"),
        ("big.txt", big), ("crlf.md", b"a\r\nb\rc\n"), ("bom.md", b"\xef\xbb\xbfhi"),
        ("bad.md", b"ok\xff\xfeend"), ("empty.md", b""), ("x.cjs", b"fs.symlink(a)"), ("x.pyc", b"\x00\x01")])
    assert e[".env"].text is None and e["Dockerfile"].text is None   # suffix '' -> never scanned
    assert e["x.txt.gz"].text is not None                            # guessed text/plain
    assert e["big.txt"].text == big.decode() and e["big.txt"].line_count == 250_001  # no size is too large
    assert e["crlf.md"].text == "a\nb\nc\n" and e["crlf.md"].line_count == 4
    assert e["bom.md"].text == "﻿hi"
    assert e["bad.md"].text == b"ok\xff\xfeend".decode("utf-8", errors="replace")
    assert e["empty.md"].line_count == 0
    assert e["x.cjs"].text is None and e["x.pyc"].text is None


def test_hashes_and_flags(spark):
    e = entries_of(spark, [("a/b.tar.gz", b"123"), ("s.sh", b"echo")])
    assert e["a/b.tar.gz"].sha256 == hashlib.sha256(b"123").hexdigest()
    assert e["a/b.tar.gz"].md5 == hashlib.md5(b"123").hexdigest()
    assert e["a/b.tar.gz"].is_archive and not e["s.sh"].is_archive
    assert e["s.sh"].is_script and e["s.sh"].size_bytes == 4


def test_archive_extension_longest(spark):
    df = spark.createDataFrame([("X.TAR.GZ",), ("a.tbz2",), ("b.tar",), ("c.txt",)], "path string")
    got = [r[0] for r in df.select(S.archive_extension(F.col("path"))).collect()]
    assert got == [".tar.gz", ".tbz2", ".tar", ""]
