"""Cache lookup against earlier reports and Markdown rendering of a report row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: report text
TITLE = "# Skill Scan: "
METADATA_NOTICE = ("**Metadata-only scan.** For a better result, ask the agent to submit the skill archive "
                   "for deep analysis.")
CLEAN_TEXT = "No security findings detected."
EMPTY_TEXT = "No findings returned by the server."


def cache_lookup(bundles: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): hits carry the stored report; misses are the bundles still to
    scan. Both are joins on ``fingerprint``; Spark picks broadcast vs. shuffle from the
    measured sizes (AQE), nothing is forced."""
    r = reports.drop("bundle_id") if "bundle_id" in reports.columns else reports
    hits = bundles.join(r, "fingerprint", "inner")
    misses = bundles.join(r.select("fingerprint"), "fingerprint", "left_anti")
    return hits, misses


def _nz(c: Column) -> Column:
    return F.when(c != "", c)


def render_markdown(local_name: Column, skill_name: Column, adjusted: Column, risk: Column, scan_date: Column,
                    summary: Column, findings: Column, source: Column) -> Column:
    """Markdown of one report: title prefers the local front-matter name; severity is the
    adjusted level, else the level, else UNKNOWN; findings are numbered from 1."""
    title = F.coalesce(_nz(local_name), _nz(skill_name), F.lit("Unknown"))
    severity = F.coalesce(_nz(adjusted), risk, F.lit("UNKNOWN"))
    items = F.transform(findings, lambda f, i: F.concat(
        (i + 1).cast("string"), F.lit(". **"), F.coalesce(f["description"], F.lit("No description")),
        F.lit("** — `"), F.coalesce(f["file"], F.lit("?")), F.lit("`")))
    has_findings = F.coalesce(F.size(findings), F.lit(0)) > 0
    body = (F.when(has_findings, F.concat_ws("\n", F.concat(F.lit("## Findings ("), F.size(findings).cast("string"),
                                                           F.lit(")")), F.lit(""), F.array_join(items, "\n")))
            .when(severity == "CLEAN", F.lit(CLEAN_TEXT)).otherwise(F.lit(EMPTY_TEXT)))
    summary_block = F.when(F.coalesce(summary, F.lit("")) != "",
                           F.concat_ws("\n", F.lit("## Summary"), F.lit(""), summary, F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit(TITLE), title), F.lit(""),
        F.concat(F.lit("- **Severity:** "), severity),
        F.when(scan_date.isNotNull(), F.concat(F.lit("- **Scan Date:** "), scan_date)),
        F.lit(""),
        summary_block,
        body,
        F.lit(""),
        F.when(source == "metadata", F.concat(F.lit(METADATA_NOTICE), F.lit("\n"))),
    )
