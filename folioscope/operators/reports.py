"""Report tables: summaries, per-file rows, issue lists, scan history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import texts, urls


def _count(condition: Column, name: str) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("bigint").alias(name)


def summary(entries: DataFrame) -> DataFrame:
    """One row of totals; verdicts count for analysed entries only, and ``issues`` are those not accessible."""
    done = F.col("status") == "analysed"
    of = lambda f: done & F.coalesce(F.col(f"report.{f}"), F.lit(False))
    totals = entries.agg(
        F.count(F.lit(1)).alias("total_files"), _count(done, "analysed"), _count(F.col("status") == "pending", "pending"), _count(F.col("status") == "error", "errored"),
        _count(of("Accessible"), "accessible"), _count(of("TotallyInaccessible"), "totally_inaccessible"), _count(of("BrokenFile"), "broken"), _count(of("Exempt"), "exempt"),
    )
    return totals.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in totals.columns]).withColumn("issues", F.col("analysed") - F.col("accessible"))


def files_per_site(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("site", F.lit("unknown")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


#: Labels of the summary tables, and the totals they show.
SUMMARY_LABELS = [
    ("URLs crawled", "pages"), ("Total files tracked", "total_files"), ("Analysed", "analysed"), ("Pending analysis", "pending"), ("Errors during analysis", "errored"),
    ("Accessible", "accessible"), ("Totally inaccessible", "totally_inaccessible"), ("Broken / unreadable", "broken"), ("Exempt (pre-2018)", "exempt"),
]
ISSUE_LABELS = [
    ("🌐 URLs crawled", "pages"), ("Total PDFs found", "total_files"), ("Analysed", "analysed"), ("✅ Accessible", "accessible"), ("❌ Issues found", "issues"), ("⏳ Pending analysis", "pending"), ("⚠️ Errors", "errored"),
]


def _labelled(entries: DataFrame, pages: int, labels: list[tuple[str, str]], if_any: list[str]) -> DataFrame:
    s = summary(entries).withColumn("pages", F.lit(pages).cast("bigint"))
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(text).alias("metric"), F.col(c).alias("value"), F.lit(c in if_any).alias("if_any")) for i, (text, c) in enumerate(labels)])
    return s.select(F.explode(rows).alias("r")).select("r.*").where(~F.col("if_any") | (F.col("value") > 0)).drop("if_any")


def summary_rows(entries: DataFrame, pages: int) -> DataFrame:
    """The summary as labelled rows; the number of crawled pages comes first and only if there are any."""
    return _labelled(entries, pages, SUMMARY_LABELS, ["pages"])


def issue_rows(entries: DataFrame, pages: int) -> DataFrame:
    """The summary of an issue comment; pages, pending files and errors only where there are any."""
    return _labelled(entries, pages, ISSUE_LABELS, ["pages", "pending", "errored"])


#: Columns of the CSV report after the entry's own, and the report fields they show.
CSV_FIELDS = {
    "published_date": "Date", "accessible": "Accessible", "totally_inaccessible": "TotallyInaccessible", "broken": "BrokenFile", "tagged": "TaggedTest", "empty_text": "EmptyTextTest", "protected": "ProtectedTest",
    "title": "TitleTest", "language": "LanguageTest", "bookmarks": "BookmarksTest", "exempt": "Exempt", "pages": "Pages", "words": "Words", "images": "Images",
}
CSV_COLUMNS = ["url", "filename", "site", "external_domain", "status", "crawled_at", *CSV_FIELDS, "errors"]


def csv_rows(entries: DataFrame) -> DataFrame:
    """All entries as text columns: capitalised truth values, blanks for null; ``entry_pos`` keeps their order."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def field(name: str, source: str) -> Column:
        c = F.col(f"report.{source}")
        is_truth = entries.select(c).schema[0].dataType.simpleString() == "boolean"
        return F.coalesce(F.initcap(c.cast("string")) if is_truth else c.cast("string"), F.lit("")).alias(name)

    outside = urls.external_domain(F.col("url"), F.col("site")).alias("external_domain")
    return entries.select("entry_pos", plain("url"), plain("filename"), plain("site"), outside, plain("status"), plain("crawled_at"), *[field(n, c) for n, c in CSV_FIELDS.items()], texts.joined_errors(F.col("errors")).alias("errors"))


def csv_line(columns: list[str]) -> Column:
    """The text ``columns`` as a line of CSV; only texts with a separator, quote or line end are quoted."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    return F.concat_ws(",", *[quoted(c) for c in columns])


def _table_line(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _field(name: str) -> Column:
    return F.col(f"report.{name}")


def _number(name: str) -> Column:
    return F.coalesce(_field(name).cast("string"), F.lit(texts.NONE))


def _pages() -> Column:
    """A report without page count says ``None``; only an entry without report has a dash."""
    return F.when(F.col("report").isNull(), texts.NONE).otherwise(F.coalesce(_field("Pages").cast("string"), F.lit("None")))


def _outside(text: Column) -> Column:
    """``text`` with the domain of a file from elsewhere."""
    outside = urls.external_domain(F.col("url"), F.col("site"))
    return F.concat(text, F.when(outside != "", F.concat(F.lit(" *(ext: "), outside, F.lit(")*"))).otherwise(""))


def _link(name: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit("]("), F.coalesce("url", F.lit("")), F.lit(")"))


#: Head of the file table, and the line under it.
FILE_RULE = "|------|------|----------------|------------|--------|-----------|---------|-------|----------|-----------|--------|-------|-------|--------|"
FILE_HEAD = "| File | Site | Published Date | Accessible | Tagged | EmptyText | Protected | Title | Language | Bookmarks | Exempt | Pages | Words | Images |"


def markdown_rows(entries: DataFrame) -> DataFrame:
    """One table line per analysed file, with the cells of ``FILE_HEAD``."""
    date = F.coalesce(F.nullif(F.substring(_field("Date"), 1, 10), F.lit("")), F.lit(texts.NONE))
    verdicts = [texts.verdict(_field(n)) for n in ("Accessible", "TaggedTest", "EmptyTextTest", "ProtectedTest", "TitleTest", "LanguageTest", "BookmarksTest", "Exempt")]
    cells = [_link(F.coalesce("filename", "url", F.lit(""))), _outside(F.coalesce("site", F.lit(""))), date, *verdicts, _pages(), _number("Words"), _number("Images")]
    return entries.where("status = 'analysed'").select("entry_pos", _table_line(cells).alias("line"))


#: Head of the table in an issue comment, and the line under it.
ISSUE_RULE = "|-----|-----------|--------|-------|----------|-----------|-------|-------|--------|"
ISSUE_HEAD = "| PDF | Accessible | Tagged | Title | Language | Bookmarks | Pages | Words | Images |"


def first_issues(entries: DataFrame, limit: int) -> DataFrame:
    """Table lines of the first ``limit`` analysed entries in order, with the cells of ``ISSUE_HEAD``; the limit is the feature."""
    last = F.element_at(F.split(F.coalesce("url", F.lit("")), "/"), -1)
    marks = [texts.icon(_field(n)) for n in ("Accessible", "TaggedTest", "TitleTest", "LanguageTest", "BookmarksTest")]
    cells = [_outside(_link(F.coalesce("filename", last))), *marks, _pages(), _number("Words"), _number("Images")]
    return entries.where("status = 'analysed'").orderBy("entry_pos").limit(limit).select("entry_pos", _table_line(cells).alias("line"))


def error_lines(entries: DataFrame) -> DataFrame:
    """Lines about every entry with errors, whatever its status: its name, URL and status, and its non-empty errors."""
    name = F.coalesce("filename", "url", F.lit(""))
    head = [F.concat(F.lit("### "), name), F.lit(""), F.concat(F.lit("- **URL**: "), F.coalesce("url", F.lit(""))), F.concat(F.lit("- **Status**: "), F.coalesce("status", F.lit("")))]
    found = F.transform(F.filter("errors", lambda e: e.isNotNull() & (e != "")), lambda e: F.concat(F.lit("- "), e))
    lines = F.concat(F.array(*head), found)
    return entries.where(F.size("errors") > 0).select("entry_pos", F.posexplode(lines).alias("nth", "line"))


def sort_key(column: Column, kind: str) -> Column:
    """Key of the interactive table: text in lower case, verdicts as 1, 0 and -1, missing numbers as -1."""
    if kind == "text":
        return F.lower(F.coalesce(column.cast("string"), F.lit("")))
    if kind == "verdict":
        s = column.cast("string")
        return F.when(s.isin("true", "Pass"), 1).when(s.isin("false", "Fail"), 0).otherwise(-1)
    return F.coalesce(column, F.lit(-1))


#: What an issue comment says where a scan found no file.
BLOCKED_NOTE = """> ⚠️ **No PDFs were found and no pages could be visited.**
> The site may be blocking automated requests, or the starting URL may be unreachable.
> Check the [workflow run]({run}) logs for crawl errors.
> You may also try submitting a more specific starting URL (e.g. a `/documents` sub-page)."""
EMPTY_NOTE = """> ⚠️ **No PDFs were found** after visiting {pages} {word}.
> Common reasons include:
>
> - **JavaScript navigation** – PDFs linked only via JavaScript menus or dynamic content cannot be followed by the crawler.
> - **Robots.txt restrictions** – the site may restrict crawler access to sections that contain PDFs.
> - **External hosting** – PDFs served without a `.pdf` extension on a different domain may not be discovered. PDFs with a `.pdf` file extension on any domain are always followed.
> - **Deeper pages** – try submitting a more specific starting URL (e.g. a `/documents` or `/resources` sub-page).
>
> Review the [Crawled URLs]({base}/reports/crawled_urls.csv) to see which pages were visited,
> and the [workflow run]({run}) logs for any crawl warnings."""


def zero_result_note(files: Column, pages: Column, run_url: Column, pages_base: Column) -> Column:
    """Why a scan found no file, as Markdown; null if it found one."""
    def filled(note: str, **values: Column) -> Column:
        text = F.lit(note)
        for name, value in values.items():
            text = F.replace(text, F.lit(f"{{{name}}}"), value)
        return text

    blocked = filled(BLOCKED_NOTE, run=run_url)
    empty = filled(EMPTY_NOTE, pages=pages.cast("string"), word=texts.plural(pages, "page", "pages"), base=pages_base, run=run_url)
    return F.when((files == 0) & (pages == 0), blocked).when(files == 0, empty)


def report_json(entries: DataFrame) -> DataFrame:
    """One JSON object per entry, for the report's file list; ``notes`` only where there are any."""
    fields = ["url", "md5", "filename", "site", "crawled_at", "status", "report", "errors"]
    given = lambda *names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return entries.select("entry_pos", F.when(F.coalesce("notes", F.lit("")) == "", given(*fields)).otherwise(given(*fields, "notes")).alias("json"))


def latest_per_issue(history: DataFrame, order: list[str]) -> DataFrame:
    """The newest scan of each issue, or of each site where a scan has no issue.

    ``order``: columns that sort newest last, together unique. A greatest-row aggregate with
    map-side combining, so an issue with very many scans is no burden.
    """
    key = F.when(texts.issue_number(F.col("issue_url")) != "", F.concat(F.lit("#"), texts.issue_number(F.col("issue_url")))).otherwise(F.coalesce("site", F.lit("")))
    keyed = history.withColumn("scan_key", key)
    return keyed.groupBy("scan_key").agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("r")).select("scan_key", "r.*")


def accessible_percent(accessible: Column, analysed: Column) -> Column:
    """Whole percent, half up; null without an analysed file."""
    return F.when(analysed > 0, F.floor(F.lit(100.0) * accessible / analysed + 0.5).cast("int"))


def band(percent: Column) -> Column:
    return F.when(percent >= 75, "high").when(percent >= 40, "medium").when(percent.isNotNull(), "low")


def matching(history: DataFrame, query: str) -> DataFrame:
    """Scans whose site or start page contains ``query``, case aside; all for a blank one."""
    q = F.lit(query.strip().lower())
    return history.where((q == "") | F.lower(F.coalesce("site", F.lit(""))).contains(q) | F.lower(F.coalesce("crawl_url", F.lit(""))).contains(q))


def appended(index: DataFrame, new: DataFrame) -> DataFrame:
    """``index`` with the scans of ``new`` whose archive file it does not list yet."""
    return new.join(index.select("archive_file"), "archive_file", "left_anti").select(*index.columns).unionByName(index)
