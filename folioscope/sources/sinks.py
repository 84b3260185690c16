"""Report files, on any file system Spark can reach. Rows are made and sorted in parallel; what is one file by its format streams through the driver."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import texts
from folioscope.operators import reports
from folioscope.runtime import read_text, write_lines


def _rows(df: DataFrame, *order: str) -> Iterator:
    return df.orderBy(*order).toLocalIterator(prefetchPartitions=True)


def write_csv(rows: DataFrame, path: str, columns: list[str], order: list[str], crlf: bool = False) -> None:
    """One CSV file of the text ``columns``, sorted by ``order``, with a header; line feeds or CRLF at line ends."""
    end = "\r\n" if crlf else "\n"
    lines = rows.select(*order, reports.csv_line(columns).alias("line"))
    write_lines(rows.sparkSession, path, _chain([",".join(columns) + end], (r["line"] + end for r in _rows(lines, *order))))


def _chain(*parts: Iterable[str]) -> Iterator[str]:
    for p in parts:
        yield from p


def totals(entries: DataFrame, pages: int, now: str) -> dict:
    """The summary of a JSON report; ``sites`` is one number per site."""
    s = reports.summary(entries).drop("issues").first().asDict()
    return {"generated_at": now, **s, "sites": {r["site"]: r["n"] for r in _rows(reports.files_per_site(entries), "site")}, "pages_crawled": pages}


def json_lines(entries: DataFrame, pages: int, now: str) -> Iterator[str]:
    """``{"summary": ..., "files": [...]}``, entries in order, one a line."""
    yield '{\n  "summary": ' + json.dumps(totals(entries, pages, now), ensure_ascii=False) + ',\n  "files": ['
    between = "\n"
    for r in _rows(reports.report_json(entries), "entry_pos"):
        yield f"{between}    {r['json']}"
        between = ",\n"
    yield "\n  ]\n}\n"


def write_report_json(entries: DataFrame, path: str, pages: int, now: str) -> None:
    write_lines(entries.sparkSession, path, json_lines(entries, pages, now))


def markdown_lines(entries: DataFrame, pages: int, now: str) -> Iterator[str]:
    """The report as Markdown, line by line: summary, files per site, file table, errors.

    Fixed values: headings and table heads.
    """
    yield from ("# PDF Accessibility Scan Report", "", f"Generated: {now}", "", "## Summary", "", "| Metric | Count |", "|--------|-------|")
    for r in _rows(reports.summary_rows(entries, pages), "ord"):
        yield f"| {r['metric']} | {r['value']} |"
    headed = False
    for r in _rows(reports.files_per_site(entries), "site"):
        if not headed:
            yield from ("", "## Files per Site", "", "| Site | Files |", "|------|-------|")
            headed = True
        yield f"| {r['site']} | {r['n']} |"
    found = False
    for r in _rows(reports.markdown_rows(entries), "entry_pos"):
        if not found:
            yield from ("## File Details", "", reports.FILE_HEAD, reports.FILE_RULE)
            found = True
        yield r["line"]
    if not found:
        yield "_No analysed files yet._"
    yield ""
    headed = False
    for r in _rows(reports.error_lines(entries), "entry_pos", "nth"):
        if not headed:
            yield from ("## Files with Errors or Notes", "")
        elif r["nth"] == 0:
            yield ""
        headed = True
        yield r["line"]


def write_markdown(entries: DataFrame, pages: int, path: str, now: str) -> None:
    write_lines(entries.sparkSession, path, (f"{line}\n" for line in markdown_lines(entries, pages, now)))


def report_links(pages_base: str, run_url: str, archive_name: str | None) -> list[str]:
    """Links of an issue comment: to the archived page of the scan where there is one, else to the page of all.

    Fixed values: link texts and paths.
    """
    own = f"- [Site-specific HTML report]({pages_base}/reports/{archive_name})" if archive_name and pages_base else f"- [HTML report]({pages_base}/report.html)"
    shared = [("Reports history", "reports.html"), ("Markdown report", "reports/report.md"), ("JSON report", "reports/report.json"), ("CSV report", "reports/report.csv"), ("Crawled URLs CSV", "reports/crawled_urls.csv"), ("YAML manifest", "reports/manifest.yaml")]
    return [own, *[f"- [{text}]({pages_base}/{path})" for text, path in shared], f"- [View workflow run]({run_url})"]


def issue_comment(entries: DataFrame, crawl_url: str = "", pages_base: str = "", run_url: str = "", pages: int = 0, archive_name: str | None = None, limit: int = 30) -> str:
    """Short Markdown about the entries of a scan: totals, why nothing was found, the first files, links.

    Fixed values: headings and phrases.
    """
    lines = [f"📊 **Accessibility analysis complete** for `{crawl_url}`.", "", "## Summary", "", "| Metric | Count |", "|--------|-------|"]
    counts = {r["metric"]: r["value"] for r in reports.issue_rows(entries, pages).orderBy("ord").collect()}
    lines += [*[f"| {k} | {v} |" for k, v in counts.items()], ""]
    n = lambda v: F.lit(v).cast("bigint")
    note = entries.sparkSession.range(1).select(reports.zero_result_note(n(counts["Total PDFs found"]), n(pages), F.lit(run_url), F.lit(pages_base))).first()[0]
    if note:
        lines += [*note.split("\n"), ""]
    if counts["Analysed"]:
        rows = [r["line"] for r in reports.first_issues(entries, limit).orderBy("entry_pos").collect()]
        lines += ["## PDFs Scanned", "", reports.ISSUE_HEAD, reports.ISSUE_RULE, *rows]
        if counts["Analysed"] > len(rows):
            lines += ["", f"_… and {counts['Analysed'] - len(rows)} more PDFs. See the full report for details._"]
        lines.append("")
    return "\n".join([*lines, "## Full Reports", "", *report_links(pages_base, run_url, archive_name)])


#: Fills the table of a report page from the data embedded in it.
_TABLE = """const d = JSON.parse(document.getElementById('data').textContent), t = document.getElementById('files');
for (const f of d.files || []) { const r = t.insertRow(), v = f.report || {}; for (const x of [f.filename, f.url, f.site, f.status, v.Accessible, v.Pages, (f.errors || []).join('; '), f.notes]) r.insertCell().textContent = x ?? ''; }"""
#: Fills the page of all reports from the history index beside it.
_LIST = """fetch('reports/index.json').then(r => r.json()).then(all => { const t = document.getElementById('reports'), base = JSON.parse(document.getElementById('data').textContent);
for (const e of all) { const r = t.insertRow(), a = document.createElement('a'); a.href = base + '/' + encodeURIComponent(e.archive_file); a.textContent = e.date ?? ''; r.insertCell().append(a); for (const x of [e.site, e.crawl_url, e.issue_url, e.total, e.analysed, e.accessible]) r.insertCell().textContent = x ?? ''; } });"""
HISTORY = "date string, site string, crawl_url string, run_url string, issue_url string, archive_file string, total bigint, analysed bigint, accessible bigint"


def _in_script(data: str) -> str:
    return data.replace("<", "\\u003c")


def _page(title: str, table: str, code: str) -> tuple[str, str]:
    """What comes before and after the JSON embedded in a page."""
    head = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table id="{table}"></table><script type="application/json" id="data">'
    return head, f"</script>\n<script>{code}</script></body></html>\n"


def html_page(title: str, data: str) -> str:
    """A page with embedded JSON; ``<`` is escaped so that data cannot end the script element."""
    head, tail = _page(title, "files", _TABLE)
    return head + _in_script(data) + tail


def write_html(entries: DataFrame, title: str, path: str, pages: int, now: str) -> None:
    """A page over ``{"summary": …, "files": […]}``; the entries stream through the driver in order, a partition at a time."""
    head, tail = _page(title, "files", _TABLE)
    write_lines(entries.sparkSession, path, _chain([head], map(_in_script, json_lines(entries, pages, now)), [tail]))


def archive(spark: SparkSession, entries: DataFrame, site: str | None, at: str, folder: str) -> str:
    """Write the page of one site's scan, or of all sites', under its archive name, which is returned. Pages crawled are not known here."""
    own = entries.where(F.col("site") == site) if site else entries
    name = spark.range(1).select(texts.archive_name(F.to_timestamp(F.lit(at)), F.lit(site or "all"))).first()[0]
    write_html(own, site or "all", f"{folder}/{name}", 0, at)
    return name


def add_to_history(spark: SparkSession, scan: dict, path: str) -> None:
    """Put a scan before those of the history index, a JSON list, newest first, unless its archive file is listed there."""
    try:
        held = json.loads(read_text(spark, path) or "[]")
    except ValueError:
        held = []
    held = [e for e in held if isinstance(e, dict)] if isinstance(held, list) else []
    fields = [f.split()[0] for f in HISTORY.split(", ")]
    index, new = (spark.createDataFrame([tuple(e.get(f) for f in fields) for e in rows], HISTORY) for rows in (held, [scan]))
    fresh = [r.asDict() for r in reports.appended(index.limit(0), new).join(index.select("archive_file"), "archive_file", "left_anti").select(*fields).collect()]
    write_lines(spark, path, [json.dumps([*fresh, *held], indent=2, ensure_ascii=False)])


def write_reports_page(spark: SparkSession, path: str, archives: str) -> None:
    """The page that lists the archived reports; ``archives``: their folder as seen from it."""
    head, tail = _page("Reports", "reports", _LIST)
    write_lines(spark, path, [head + _in_script(json.dumps(archives)) + tail])


def crawl_state(files: DataFrame) -> DataFrame:
    """``(folder, url_map, referer_map)``: JSON objects of file name to URL and to referer, per folder.

    ``files``: folder, filename, url, referer. One folder is one site's crawl, limited by its page cap.
    """
    packed = lambda v: F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("filename", v)))))
    once = files.groupBy("folder", "filename").agg(F.max("url").alias("url"), F.max("referer").alias("referer"))
    return once.groupBy("folder").agg(packed("url").alias("url_map"), packed("referer").alias("referer_map"))


def write_crawl_state(files: DataFrame, pages: DataFrame, folder: str) -> None:
    """The state files of each folder under ``folder``: URL map, referer map, and the pages in order of visit, also where no file was saved.

    ``files``: folder, filename, url, referer; ``pages``: folder, seq, url. Folders are named by site; each is one crawl.
    """
    spark = files.sparkSession
    seen = pages.groupBy("folder").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("seq", "url"))), lambda p: p["url"])).alias("pages"))
    for r in crawl_state(files).join(seen, "folder", "full_outer").toLocalIterator():
        for name, text in (("_url_map.json", r["url_map"]), ("_referer_map.json", r["referer_map"]), ("_crawled_pages.json", r["pages"])):
            if text is not None:
                write_lines(spark, f"{folder}/{r['folder']}/{name}", [text])


def copy_text(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a report file; False if there is none."""
    text = read_text(spark, source)
    if text is not None:
        write_lines(spark, target, [text])
    return text is not None


def write_count(spark: SparkSession, path: str, n: int) -> None:
    """A count for later steps; a failure to write it is no failure of the run."""
    try:
        write_lines(spark, path, [f"{n}\n"])
    except Exception:  # noqa: BLE001 - any file system may refuse in its own way
        pass
