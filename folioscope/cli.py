"""Command line: ``crawl`` (merge a finished crawl), ``analyse`` and ``report`` over a YAML manifest."""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.times import age_days, age_text, iso_instant
from folioscope.operators import analysis, manifest, reports
from folioscope.operators.neighbours import numbered
from folioscope.runtime import exists, remove, written
from folioscope.sources import files, sinks
from folioscope.sources.pdf_facts import pdf_facts
from folioscope.sources.yaml_manifest import read_manifest, write_manifest


#: Files for each core that are begun before a time budget is looked at again.
FILES_PER_CORE = 16


def session() -> SparkSession:
    return SparkSession.builder.appName("folioscope").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def languages(spark: SparkSession) -> list[str]:
    """Primary language subtags of two letters, as the Java runtime knows them."""
    return [str(x) for x in spark._jvm.java.util.Locale.getISOLanguages()]


def merge_crawl(spark: SparkSession, a: argparse.Namespace, now: str) -> int:
    """Upsert the downloads of a site and write the link inventory; returns the number of crawled pages."""
    site = urls_site(spark, a.url)
    folder = f"{a.output_dir}/{site}"
    names = files.name_map(spark, f"{folder}/_url_map.json", "url")
    held = written(read_manifest(spark, a.manifest), "held")
    pages = files.crawled_pages(spark, f"{folder}/_crawled_pages.json").where(F.col("seq") < a.max_pages)
    if exists(spark, folder):
        got = numbered(files.with_urls(files.downloads(spark, folder, site), names), "path", "scan_pos")
        scan = got.select("scan_pos", "url", "md5", "filename", "site", F.lit(now).alias("crawled_at"), F.lit(a.notes).alias("notes"))
        held = manifest.upsert(held, scan)
        inventory = files.link_inventory(pages, names, files.name_map(spark, f"{folder}/_referer_map.json", "referer"))
        for target in (folder, a.report_dir):
            sinks.write_csv(inventory.na.fill(""), f"{target}/crawled_urls.csv", ["url", "type", "referer"], ["part", "at", "seq"], crlf=True)
    write_manifest(written(held, "manifest"), a.manifest)  # the export replaces the file these rows were read from
    return pages.count()


def urls_site(spark: SparkSession, url: str) -> str:
    found = spark.range(1).select(urls.normalized(F.lit(url)).alias("u")).select(urls.site_key(urls.authority(F.col("u"))), urls.is_pdf_url(F.col("u"))).first()
    if found[0] is None or found[1]:
        raise SystemExit(f"not a page to crawl: {url}")
    return found[0]


def analyse(spark: SparkSession, a: argparse.Namespace, now: str) -> DataFrame:
    """Judge the pending files that are there, in order and within the limits; returns the outcomes."""
    held = written(read_manifest(spark, a.manifest), "held")
    pending = held.where(F.col("status") == "pending")
    if a.site:
        pending = pending.where(F.col("site") == a.site)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(a.crawled_dir) if exists(spark, a.crawled_dir) else None
    layout = "path string, length bigint, filename string, site string"
    there = listed.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("filename"), F.element_at(F.split("path", "/"), -2).alias("site")) if listed is not None else spark.createDataFrame([], layout)
    met = pending.join(there, ["site", "filename"], "left")
    stale = F.coalesce(age_days(iso_instant(F.col("crawled_at")), F.to_timestamp(F.lit(now))) > a.max_age_days, F.lit(False)) if a.max_age_days is not None else F.lit(False)
    outcome = manifest.schedule(met, F.col("path").isNotNull(), stale, F.col("length") / 1048576.0, a.max_file_size, a.max_files if a.max_files is not None else 2**62)
    outcome = written(outcome, "outcome")
    done, reached, began = held, outcome.agg(F.max("consumed")).first()[0] or 0, time.monotonic()
    late = spark.createDataFrame([], "url string, result_pos bigint, ok boolean, errors array<string>")
    if listed is not None:
        last, reached = min(reached, a.max_files if a.max_files is not None else reached), 0
        step = spark.sparkContext.defaultParallelism * FILES_PER_CORE if a.total_timeout is not None else max(last, 1)
        while reached < last and (a.total_timeout is None or time.monotonic() - began < a.total_timeout):
            chosen = outcome.where((F.col("outcome") == "analyse") & (F.col("consumed") > reached) & (F.col("consumed") <= reached + step)).select("path", "url", "entry_pos")
            facts = written(pdf_facts(listed, a.max_file_size, a.per_file_timeout).join(chosen, "path"), "facts")
            timed_out = F.coalesce(F.col("error_kind") == "timeout", F.lit(False))
            done = written(analysis.stored(done, analysis.reports_of(facts.where(~timed_out), languages(spark))), "done")
            late = late.unionByName(facts.where(timed_out).select("url", F.col("entry_pos").alias("result_pos"), F.lit(False).alias("ok"), F.array("open_error").alias("errors")))
            reached = min(reached + step, last)
        if reached < last:  # out of time: the entries behind stay as they are
            outcome = outcome.withColumn("outcome", F.when(F.col("consumed") > reached, "waiting").otherwise(F.col("outcome")))
    at, at_now = iso_instant(F.col("crawled_at")), F.to_timestamp(F.lit(now))
    age = F.when(at.isNotNull(), age_text(at, at_now, F.lit(None).cast("string")))
    errors = manifest.guard_errors(outcome.withColumn("size_mb", F.col("length") / 1048576.0), a.crawled_dir, age, a.max_file_size, a.max_age_days)
    failed = errors.select("url", F.col("entry_pos").alias("result_pos"), F.lit(False).alias("ok"), F.array("error").alias("errors"))
    write_manifest(written(manifest.mark(done, failed.unionByName(late)), "manifest"), a.manifest)
    if a.purge:
        for r in outcome.where("path IS NOT NULL AND outcome IN ('analyse', 'not_pdf', 'oversize')").select("path").toLocalIterator():
            remove(spark, r["path"])
    return outcome.groupBy("outcome").count()


def write_reports(spark: SparkSession, a: argparse.Namespace, now: str) -> None:
    """Reports of all sites; page, history entry and comment are about one site if one is named."""
    held = written(read_manifest(spark, a.manifest), "held")
    own = held.where(F.col("site") == a.site) if a.site else held
    pages = 0
    if a.crawled_dir and a.site:
        pages = files.crawled_pages(spark, f"{a.crawled_dir}/{a.site}/_crawled_pages.json").count()
        sinks.copy_text(spark, f"{a.crawled_dir}/{a.site}/crawled_urls.csv", f"{a.report_dir}/crawled_urls.csv")
    sinks.write_markdown(held, pages, f"{a.report_dir}/report.md", now)
    sinks.write_report_json(held, f"{a.report_dir}/report.json", pages, now)
    sinks.write_csv(reports.csv_rows(held), f"{a.report_dir}/report.csv", reports.CSV_COLUMNS, ["entry_pos"])
    if a.html_dir:
        sinks.write_html(held, "Report", f"{a.html_dir}/report.html", pages, now)
    name = None
    if a.html_dir and a.archive_dir:
        name = sinks.archive(spark, own, a.site, now, a.archive_dir)
        done = reports.summary(own).first()
        scan = {"date": now, "site": a.site or "all", "crawl_url": a.crawl_url, "run_url": a.run_url, "issue_url": a.issue_url, "archive_file": name, "total": done["total_files"], "analysed": done["analysed"], "accessible": done["accessible"]}
        sinks.add_to_history(spark, scan, f"{a.archive_dir}/index.json")
        there, here = (d.removeprefix("file://") for d in (a.archive_dir, a.html_dir))
        sinks.write_reports_page(spark, f"{a.html_dir}/reports.html", Path(os.path.relpath(there, here)).as_posix())
        for source, target in ((f"{a.report_dir}/report.json", "report.json"), (f"{a.report_dir}/report.csv", "report.csv"), (a.manifest, "manifest.yaml")):
            sinks.copy_text(spark, source, f"{a.archive_dir}/{target}")
    if a.issue_comment_file:
        sinks.write_lines(spark, a.issue_comment_file, [sinks.issue_comment(own, a.crawl_url, a.pages_base, a.run_url, pages, name)])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="folioscope")
    commands = parser.add_subparsers(dest="command", required=True)
    crawl = commands.add_parser("crawl", help="merge the files of a finished crawl into the manifest")
    crawl.add_argument("--url", required=True)
    crawl.add_argument("--output-dir", default="crawled_files")
    crawl.add_argument("--notes", default="")
    crawl.add_argument("--max-pages", type=int, default=2500, help="pages of the crawl that are taken, in order of visit")
    crawl.add_argument("--skip-crawl", action="store_true", help="accepted for scripts; this command never fetches, it merges a finished crawl")
    crawl.add_argument("--report-dir", default="reports")
    check = commands.add_parser("analyse", help="judge pending files")
    check.add_argument("--crawled-dir", default="crawled_files")
    check.add_argument("--site")
    check.add_argument("--max-file-size", type=float, default=200)
    check.add_argument("--max-age-days", type=float)
    check.add_argument("--max-files", type=int)
    check.add_argument("--per-file-timeout", type=float, default=120, help="seconds for one file")
    check.add_argument("--total-timeout", type=float, help="seconds after which no more files are begun; the rest waits for the next run")
    check.add_argument("--purge", action="store_true", help="delete the files that were dealt with; they are kept otherwise")
    check.add_argument("--keep-files", action="store_true", help="accepted for scripts; files are kept unless --purge is given")
    report = commands.add_parser("report", help="write the reports")
    report.add_argument("--report-dir", default="reports")
    report.add_argument("--site")
    report.add_argument("--issue-comment-file")
    report.add_argument("--html-dir", help="write pages there")
    report.add_argument("--archive-dir", help="keep the page of this scan and the history there; needs --html-dir")
    report.add_argument("--crawled-dir", help="state of the site's crawl, for the number of pages")
    for link in ("--crawl-url", "--run-url", "--issue-url", "--pages-base"):
        report.add_argument(link, default="")
    for p in (crawl, check, report):
        p.add_argument("--manifest", default="reports/manifest.yaml")
    a = parser.parse_args(argv)
    spark, now = session(), datetime.now(UTC).isoformat()
    if a.command == "crawl":
        print(f"{merge_crawl(spark, a, now)} pages")
    elif a.command == "analyse":
        analyse(spark, a, now).show()
    else:
        write_reports(spark, a, now)
    return 0


if __name__ == "__main__":
    sys.exit(main())
