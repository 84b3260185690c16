"""The change-tracked manifest: upserts, results, scheduling.

An entry list keeps its order in ``entry_pos``; where several entries share a URL, the first one is
the one that lookups meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.neighbours import running_total, with_previous


def first_by_url(entries: DataFrame) -> DataFrame:
    """Position of the entry that a lookup of each URL meets."""
    return entries.where("url IS NOT NULL").groupBy("url").agg(F.min("entry_pos").alias("entry_pos"))


def scan_changes(entries: DataFrame, scan: DataFrame) -> DataFrame:
    """``scan`` with ``changed`` (content differs from what the manifest held just before) and ``needs_scan``.

    ``scan`` has unique ``scan_pos``, ``url``, ``md5`` (null equals null). Files of one URL follow each
    other: a file is compared with the file before it, the first one with the entry. ``needs_scan``
    holds from the first change on, and always if the entry had not been analysed.
    """
    target = entries.join(first_by_url(entries).select("entry_pos"), "entry_pos", "left_semi").select("url", F.col("md5").alias("old_md5"), F.col("status").alias("old_status"), F.lit(True).alias("known"))
    content = F.struct(F.col("md5"))
    chained = with_previous(scan.where("url IS NOT NULL").withColumn("_content", content), "url", "scan_pos", "_content", "_before", block=1_000_000).drop("_content")
    met = chained.join(target, "url", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    before = F.when(F.col("_before").isNotNull(), F.col("_before.md5")).otherwise(F.col("old_md5"))
    new = F.col("_before").isNull() & ~F.col("known")
    changed = met.withColumn("changed", new | ~F.col("md5").eqNullSafe(before)).drop("_before", "old_md5")
    starts = changed.where("changed").groupBy("url").agg(F.min("scan_pos").alias("_from"))
    needs = F.coalesce(F.col("scan_pos") >= F.col("_from"), F.lit(False)) | ~F.col("old_status").eqNullSafe("analysed")
    return changed.join(starts, "url", "left").withColumn("needs_scan", needs).drop("_from", "old_status")


def upsert(entries: DataFrame, scan: DataFrame, top: int | None = None) -> DataFrame:
    """``entries`` after a scan: new URLs appended as pending, changed contents reset to pending.

    A changed entry takes content hash and crawl time of the last change and loses report and
    errors, but keeps its filename and site; a new entry keeps those of its first file. Unchanged
    entries, errors among them, stay as they are, except that a non-empty note replaces theirs.
    Files without URL are ignored. New entries are numbered by position after the old ones, or after ``top`` where ``entries``
    are only a part of the manifest.
    """
    seen = scan_changes(entries, scan)
    note = F.nullif(F.col("notes"), F.lit(""))
    per_url = seen.groupBy("url", "known").agg(
        F.max("changed").alias("changed"),
        F.max_by(F.struct("md5", "crawled_at"), F.when(F.col("changed"), F.col("scan_pos"))).alias("last"),
        F.min_by(F.struct("filename", "site"), "scan_pos").alias("first"),
        F.max_by(note, F.when(note.isNotNull(), F.col("scan_pos"))).alias("note"),
        F.min("scan_pos").alias("first_pos"),
    )
    hits = per_url.where("known").join(first_by_url(entries), "url").select("entry_pos", "changed", "last", "note")
    kept = entries.join(hits, "entry_pos", "left")
    changed = F.coalesce("changed", F.lit(False))
    reset = lambda new, old: F.when(changed, new).otherwise(F.col(old)).alias(old)
    none = F.array().cast("array<string>")
    updated = kept.select(
        "entry_pos", "url", reset(F.col("last.md5"), "md5"), "filename", "site", reset(F.col("last.crawled_at"), "crawled_at"),
        reset(F.lit("pending"), "status"), reset(F.lit(None).cast(entries.schema["report"].dataType), "report"), reset(none, "errors"), F.coalesce("note", "notes").alias("notes"),
    )
    above = entries.agg(F.coalesce(F.max("entry_pos"), F.lit(0))).scalar() if top is None else F.lit(top)
    added = per_url.where("NOT known").select(
        (above + 1 + F.col("first_pos")).cast("bigint").alias("entry_pos"), "url", F.col("last.md5").alias("md5"), F.col("first.filename").alias("filename"), F.col("first.site").alias("site"),
        F.col("last.crawled_at").alias("crawled_at"), F.lit("pending").alias("status"), F.lit(None).cast(entries.schema["report"].dataType).alias("report"), none.alias("errors"), F.col("note").alias("notes"),
    )
    return updated.unionByName(added)


def mark(entries: DataFrame, results: DataFrame) -> DataFrame:
    """Store analysis results ``(url, ok, errors)`` in the first entry of each URL; unknown URLs are ignored.

    Of several results for a URL the one with the greatest ``result_pos`` stands.
    """
    last = results.groupBy("url").agg(F.max_by(F.struct("ok", F.col("errors").alias("found")), "result_pos").alias("r"))
    hits = last.join(first_by_url(entries), "url").select("entry_pos", "r")
    return entries.join(hits, "entry_pos", "left").withColumn("status", F.when(F.col("r").isNull(), F.col("status")).when(F.col("r.ok"), "analysed").otherwise("error")).withColumn("errors", F.when(F.col("r").isNull(), F.col("errors")).otherwise(F.col("r.found"))).drop("r")


def schedule(pending: DataFrame, exists: Column, stale: Column, size_mb: Column, max_mb: float, max_files: int) -> DataFrame:
    """Outcome of each pending entry when taken in order: the first guard that stops it, or analysis.

    ``outcome``: missing, stale, not_pdf, oversize, analyse or waiting. Entries stopped by a guard do not
    use up the ``max_files`` budget; from the first file beyond the budget on, everything waits.
    """
    ext = F.lower(F.regexp_extract("filename", r"[^/.][^/]*?(\.[^./]+)$", 1))
    guarded = pending.withColumn(
        "guard",
        F.when(~exists & stale, "stale").when(~exists, "missing").when(F.coalesce(ext, F.lit("")) != ".pdf", "not_pdf").when(size_mb > max_mb, "oversize").otherwise("analyse"),
    )
    counted = running_total(guarded, "entry_pos", F.when(F.col("guard") == "analyse", 1).otherwise(0), "consumed")
    return counted.withColumn("outcome", F.when(F.col("consumed") > max_files, "waiting").otherwise(F.col("guard"))).drop("guard")


def guard_errors(outcomes: DataFrame, folder: str, age: Column, max_mb: float, max_age_days: float | None) -> DataFrame:
    """``(entry_pos, url, error)`` of the entries that a guard stopped; ``age`` is the age text of a crawl time, null if unreadable.

    Fixed values: the texts. ``outcomes`` has site, filename, crawled_at, and size_mb of the file.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    at, name = text("crawled_at"), F.concat_ws("/", F.lit(folder), text("site"), text("filename"))
    aged = F.when(age.isNotNull(), F.concat(F.lit(" (crawled "), age, F.lit(" day(s) ago at "), at, F.lit(")"))).when(at != "", F.concat(F.lit(" (crawled_at: '"), at, F.lit("')"))).otherwise("")
    missing = F.concat(F.lit("File not found: "), name, aged, F.lit(". Possible causes: failed download, incomplete artifact transfer, or stale manifest entry from a previous run."))
    stale = F.concat(F.lit(f"Stale manifest entry: file not found after {max_age_days:g}+ days (crawled_at: " if max_age_days is not None else ""), at, F.lit("). The file was probably downloaded in a previous run whose crawled_files directory is no longer available."))
    ext = F.regexp_extract(text("filename"), r"[^/.][^/]*?(\.[^./]+)$", 1)
    other = F.concat(F.lit("Not a PDF file: "), F.coalesce(F.nullif(ext, F.lit("")), F.lit("(no extension)")))
    large = F.concat(F.lit("File too large to analyse: "), F.format_string("%.1f", "size_mb"), F.lit(f" MB (limit: {max_mb:.0f} MB)"))
    o = F.col("outcome")
    return outcomes.where(o.isin("missing", "stale", "not_pdf", "oversize")).select("entry_pos", "url", F.when(o == "missing", missing).when(o == "stale", stale).when(o == "not_pdf", other).otherwise(large).alias("error"))


def run_outcomes(scheduled: DataFrame, reports: DataFrame) -> DataFrame:
    """``(outcome, n)`` of a run: what became of the entries taken, waiting ones aside.

    ``reports``: entry_pos, BrokenFile, Accessible of the entries analysed; one chosen for analysis without a report failed.
    """
    met = scheduled.where("outcome <> 'waiting'").select("entry_pos", "outcome").join(reports.select("entry_pos", "BrokenFile", "Accessible", F.lit(True).alias("judged")), "entry_pos", "left")
    of = F.col("outcome")
    named = (
        F.when(of == "missing", "not found").when(of == "stale", "stale").when(of != "analyse", "skipped").when(F.col("judged").isNull(), "errors")
        .when(F.coalesce("BrokenFile", F.lit(False)), "broken").when(F.coalesce("Accessible", F.lit(False)), "accessible").otherwise("issues")
    )
    return met.groupBy(named.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def needs_analysis(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that are pending or whose file ``(url, md5)`` is there with other content."""
    found = files.where("url IS NOT NULL").groupBy("url").agg(F.min("md5").alias("_md5"))
    return entries.join(found, "url", "left").where((F.col("status") == "pending") | (F.col("_md5").isNotNull() & ~F.col("_md5").eqNullSafe(F.col("md5")))).drop("_md5")
