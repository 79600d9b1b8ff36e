"""Driver contract: entry() runs, every query has a builder, oracles compare on a sample."""

import os
import sys

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["bundle_id", "category", "pattern_name", "n_hits", "n_files"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_sample_oracles_match(spark):
    con = duckdb.connect()
    for t in ["documents", "pages", "conversations", "embeddings"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sqls = E.oracle_sql()
    for name in ["security_patterns", "urls", "sensitive_env_vars", "bundle_fingerprint", "install_hooks",
                 "token_chunks", "archive_guard", "bundle_report", "expand_archives",
                 "expanded_findings", "write_artifact", "render_report", "frontmatter"]:
        df = E.queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
        res = con.sql(sqls[name])
        want = sorted((tuple(dict(zip(res.columns, r))[c] for c in cols) for r in res.fetchall()), key=repr)
        assert got == want, name
