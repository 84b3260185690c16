"""Queries of the audit operators over the test tables, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import texts, times, urls
from folioscope.operators import manifest, naming, reports, verdicts
from folioscope.runtime import table
from folioscope.sources import files, sinks

SITE = "moss-planning.example"
NOW = "2025-09-01 00:00:00"
MAX_MB, MAX_FILES, MAX_AGE_DAYS, TOP, MAX_PAGES = 200, 100, 400, 30, 2500
#: Offsets of dates as scanners write them, broken ones among them.
OFFSETS = ("+01'00'", "Z", "", "+01", "+1'0'", "-05'30'", "+0230", "+'x'")
#: Primary language subtags of the test tables' languages and their neighbours.
LANGUAGES = "da de en es fi fr it ja ko nl no pl pt ru sv zh".split()


def entries(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as an ordered list: repeated rows once, position by entry id."""
    return table(spark, d, "manifest").withColumnRenamed("entry_id", "entry_pos").dropDuplicates(["entry_pos"])


_E = "e AS (SELECT DISTINCT ON (entry_id) entry_id AS entry_pos, * EXCLUDE (entry_id) FROM manifest)"


def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawled_urls").select("link_id", "url", "type", "referer")


def _sql_part(column: str, i: int) -> str:
    return rf"regexp_extract(regexp_replace({column}, '[\t\r\n]', '', 'g'), '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?', {i})"


def _sql_path(column: str) -> str:
    return f"regexp_replace({_sql_part(column, 3)}, ';[^/]*$', '')"


def _sql_ext(p: str) -> str:
    return rf"regexp_extract({p}, '[^/.][^/]*?(\.[^./]*)$', 1)"


def _sql_key(host: str) -> str:
    return f"regexp_replace(lower({host}), '^www[.]', '')"


def _sql_inside(host: str, domain: str) -> str:
    return f"({host} = '' OR {host} = {domain} OR ends_with({host}, '.' || {domain}))"


_DOWNLOAD = _sql_ext("lower(regexp_replace(" + _sql_path("url") + ", '/+$', ''))") + " = '.pdf'"


# --- URLs ------------------------------------------------------------------------------------------


def url_parts(spark, d):
    u = F.col("url")
    return links(spark, d).select("link_id", urls.scheme(u).alias("scheme"), urls.authority(u).alias("authority"), urls.path(u).alias("path"), urls.extension(urls.path(u)).alias("ext"), urls.suffix(urls.path(u)).alias("suffix"))


def url_flags(spark, d):
    u = F.col("url")
    return links(spark, d).select("link_id", urls.is_pdf_url(u).alias("is_pdf"), urls.is_download(u).alias("is_download"), urls.is_submittable(u).alias("is_submittable"), urls.is_bare_domain(F.regexp_replace(u, "^https?://", "")).alias("is_bare"))


def links_per_site(spark, d):
    return links(spark, d).groupBy(urls.site_key(urls.authority(F.col("url"))).alias("site"), "type").agg(F.count(F.lit(1)).alias("n"))


def normalized_seeds(spark, d):
    """Half of the URLs without their scheme; of the bare ones a third answer with ``http://www.`` and a third with ``https://www.``."""
    src = links(spark, d).withColumn("seed_text", F.when(F.col("link_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url")))
    bare = F.regexp_replace("seed_text", "^/+", "")
    reachable = F.when(F.col("link_id") % 3 == 0, F.array(F.concat(F.lit("http://www."), bare))).when(F.col("link_id") % 3 == 1, F.array(F.concat(F.lit("http://"), bare), F.concat(F.lit("https://www."), bare))).otherwise(F.array().cast("array<string>"))
    return src.select("link_id", urls.normalized(F.col("seed_text"), reachable).alias("seed"))


def save_names(spark, d):
    return links(spark, d).select("link_id", urls.save_name(F.col("url")).alias("name"))


def unique_names(spark, d):
    """Names made unique in order of arrival, per folder; one that is already taken is passed over."""
    named = links(spark, d).where("type = 'pdf'").select("link_id", urls.save_name(F.col("url")).alias("name"), urls.site_key(urls.authority(F.col("url"))).alias("folder"))
    return naming.unique_names(named, "folder", "link_id", "name")


_HREF = "CASE link_id % 8 WHEN 0 THEN '../a/./b.pdf' WHEN 1 THEN '/x/y.PDF?v=1' WHEN 2 THEN '//cdn.other.example/View' WHEN 3 THEN 'c.html#top' WHEN 4 THEN '/search?q=1' WHEN 5 THEN 'mailto:x@y.example' WHEN 6 THEN '?page=2' ELSE 'https://far.example/doc.' END"


def _edges(pages):
    return pages.select("link_id", F.col("url").alias("page"), F.expr(_HREF).alias("href"))


def resolved_links(spark, d):
    return _edges(links(spark, d)).select("link_id", urls.resolve(F.col("page"), F.col("href")).alias("target"))


def link_actions(spark, d):
    e = _edges(links(spark, d)).select("link_id", urls.site_key(urls.authority(F.col("page"))).alias("domain"), urls.resolve(F.col("page"), F.col("href")).alias("target"))
    return e.select("link_id", urls.link_action(F.col("target"), F.col("domain")).alias("action"))


def page_anchors(spark, d):
    """Anchors of pages that are made of each link: its own URL and three others, in double, single and no quotes."""
    page = F.concat(F.lit('<p><a class="x" href="'), "url", F.lit("\">a</a>\n<A HREF='/b?x=1'>b</A> <a id=k href=c.html>c</a><a name=n>d</a><a href=\" #e \">e</a>"))
    return files.anchors(links(spark, d).where("url IS NOT NULL AND NOT contains(url, '\"')").select("url", page.alias("html")), "html", "url").groupBy("href").agg(F.count(F.lit(1)).alias("n"))


def _state(spark, d):
    """URL map and referer map of the crawl of each site, as the link inventory has them: the first link of a name stands."""
    got = links(spark, d).where("type = 'pdf'").select(urls.site_key(urls.authority(F.col("url"))).alias("folder"), urls.save_name(F.col("url")).alias("filename"), "link_id", "url", "referer")
    first = got.groupBy("folder", "filename").agg(F.min("link_id").alias("link_id")).join(got, ["folder", "filename", "link_id"])
    return first.select("folder", "filename", "url"), first.where("trim(referer) <> ''").select("folder", "filename", "referer")


def link_inventory(spark, d):
    """Pages in order of visit, then files by name with the page that the referer map has for them."""
    pages = links(spark, d).where("type = 'page'").select(urls.site_key(urls.authority(F.col("url"))).alias("folder"), F.col("link_id").alias("seq"), "url")
    return files.link_inventory(pages, *_state(spark, d))


def crawl_state(spark, d):
    names, referers = _state(spark, d)
    return sinks.crawl_state(names.join(referers, ["folder", "filename"], "left"))


def file_urls(spark, d):
    """URLs of the manifest's files by the URL map; where that has none, from site and name."""
    names, _ = _state(spark, d)
    got = entries(spark, d).where("filename IS NOT NULL AND site IS NOT NULL").select("entry_pos", "site", "filename")
    return files.with_urls(got, names.where("contains(folder, '.')").select("filename", "url").groupBy("filename").agg(F.min("url").alias("url"))).select("entry_pos", "url")


def _responses(spark, d):
    kind = F.when(F.col("type") == "page", "text/HTML; charset=utf-8").when(F.col("link_id") % 2 == 0, "Application/PDF").otherwise(None)
    return links(spark, d).select(F.col("link_id").alias("seq"), "url", kind.alias("content_type"), (F.col("link_id") % 7 == 0).alias("no_follow"))


def visited_pages(spark, d):
    """The first pages of a crawl; responses fetched only to see what they are do not count."""
    return files.visited(_responses(spark, d), MAX_PAGES).select("seq", "url")


def pdf_responses(spark, d):
    return _responses(spark, d).where(files.is_pdf_response(F.col("content_type"))).select("seq")


def external_domains(spark, d):
    return entries(spark, d).select("entry_pos", urls.external_domain(F.col("url"), F.col("site")).alias("external"))


# --- texts, dates ----------------------------------------------------------------------------------


def content_md5(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5"))


def duplicate_content(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("md5")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.word_count(F.col("text")).cast("bigint").alias("words"))


def escaped_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.html_escaped(F.col("title")).alias("title"), texts.percent_encoded(F.coalesce("source", F.lit(""))).alias("source"))


def language_tags(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(texts.is_language_tag(F.col("lang"), LANGUAGES), F.lit(False)).alias("valid"))


def crawl_ages(spark, d):
    at = times.iso_instant(F.col("crawled_at"))
    return entries(spark, d).select("entry_pos", F.coalesce(F.floor(times.age_days(at, F.to_timestamp(F.lit(NOW)))), F.lit(-1)).alias("days"), F.coalesce(F.substring("report.Date", 1, 10), F.lit(texts.NONE)).alias("published"))


def pdf_dates(spark, d):
    """Dates with offsets in several spellings, broken ones among them."""
    tails = F.array(*[F.lit(t) for t in OFFSETS])
    raw = F.concat(F.lit("D:"), F.date_format("ts", "yyyyMMddHHmmss"), F.element_at(tails, (F.col("event_id") % len(OFFSETS) + 1).cast("int")))
    return table(spark, d, "events").select("event_id", times.pdf_date(raw).alias("at"), times.at_offset(times.pdf_date(raw), times.offset_minutes(raw)).alias("text"))


def crawl_age_texts(spark, d):
    at = times.iso_instant(F.col("crawled_at"))
    last = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    return entries(spark, d).select("entry_pos", times.age_text(at, last, F.col("crawled_at")).alias("age"))


def scan_requests(spark, d):
    return links(spark, d).select("link_id", texts.scan_request(F.col("url"), F.when(F.col("link_id") % 2 == 0, "it's (new)!"), F.col("link_id") % 5 - 1, "Thank you.").alias("request"))


def exempt_orders(spark, d):
    at = F.to_timestamp(F.col("o_orderdate")) + F.expr("INTERVAL 23 YEARS")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(times.is_exempt(at, F.col("o_orderkey") % 5 == 0), F.lit(False)).alias("exempt"))


def permission_bits(spark, d):
    k = F.col("o_orderkey")
    p = (k * 37 % 65536 - 32768).cast("int")
    return table(spark, d, "orders").select("o_orderkey", verdicts.permission_test(k % 3 != 0, F.when(k % 11 != 0, p), k % 2 == 0).alias("test"))


def archive_names(spark, d):
    return table(spark, d, "events").select("event_id", texts.archive_name(F.col("ts"), F.concat(F.lit(".a/b.."), F.col("event_type"))).alias("name"))


# --- manifest --------------------------------------------------------------------------------------


def pending_for_site(spark, d):
    return entries(spark, d).where((F.col("status") == "pending") & (F.col("site") == SITE)).select("entry_pos", "url")


def status_counts(spark, d):
    return entries(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def with_errors(spark, d):
    return entries(spark, d).where(F.size(F.coalesce("errors", F.array())) > 0).select("entry_pos", "status", texts.joined_errors(F.col("errors")).alias("errors"))


def manual_review(spark, d):
    return entries(spark, d).where(F.coalesce("report.Form", F.lit(False)) | F.coalesce("report.xfa", F.lit(False))).select("entry_pos")


def _scan(spark, d):
    once = table(spark, d, "manifest_batches").dropDuplicates(["entry_id"])
    return once.select(F.col("entry_id").alias("scan_pos"), "url", "md5", "filename", "site", "crawled_at", F.when(F.col("entry_id") % 10 == 0, "seen again").otherwise("").alias("notes"))


def upsert_manifest(spark, d):
    return manifest.upsert(entries(spark, d), _scan(spark, d)).select("entry_pos", "url", "md5", "filename", "site", "status", F.size("errors").alias("n_errors"), F.col("report").isNotNull().alias("has_report"), "notes")


def upsert_counts(spark, d):
    return manifest.scan_changes(entries(spark, d), _scan(spark, d)).groupBy("needs_scan").agg(F.count(F.lit(1)).alias("n"))


def mark_results(spark, d):
    results = _scan(spark, d).select("url", F.col("scan_pos").alias("result_pos"), (F.col("scan_pos") % 3 != 0).alias("ok"), F.array(F.lit("late")).alias("errors"))
    return manifest.mark(entries(spark, d), results).select("entry_pos", "status")


def _scheduled(spark, d):
    """Pending entries beside the files that are there: one in seven is missing, sizes vary."""
    pending = entries(spark, d).where("status = 'pending'")
    listed = entries(spark, d).where("entry_pos % 7 <> 0").select("entry_pos", (F.col("entry_pos") * 37 % 260).cast("double").alias("size_mb"))
    at = times.iso_instant(F.col("crawled_at"))
    stale = F.coalesce(times.age_days(at, F.to_timestamp(F.lit(NOW))) > MAX_AGE_DAYS, F.lit(False))
    return manifest.schedule(pending.join(listed, "entry_pos", "left"), F.col("size_mb").isNotNull(), stale, F.col("size_mb"), MAX_MB, MAX_FILES)


def analysis_schedule(spark, d):
    return _scheduled(spark, d).select("entry_pos", "outcome", "consumed")


def guard_errors(spark, d):
    at = times.iso_instant(F.col("crawled_at"))
    age = F.when(at.isNotNull(), F.floor(times.age_days(at, F.to_timestamp(F.lit(NOW)))).cast("string"))
    return manifest.guard_errors(_scheduled(spark, d), "files", age, MAX_MB, MAX_AGE_DAYS).select("entry_pos", "error")


def needs_analysis(spark, d):
    """Pending entries, and those whose file came with other content in the batches."""
    return manifest.needs_analysis(entries(spark, d), _scan(spark, d).select("url", "md5")).select("entry_pos")


# --- verdicts --------------------------------------------------------------------------------------

#: Facts made from the documents by arithmetic; the same text is read by both engines.
FACTS = """SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN 'cannot be opened' END AS open_error, CASE doc_id % 3 WHEN 0 THEN 'password' WHEN 1 THEN 'pdf' ELSE 'value' END AS error_kind, CAST(doc_id % 4 AS INT) AS revision, doc_id % 13 <> 0 AS has_xmp,
 CASE WHEN doc_id % 17 <> 0 THEN reviewed_at END AS doc_date, title, doc_id % 3 <> 0 AS has_viewer_prefs, doc_id % 5 <> 0 AS display_doc_title,
 doc_id % 2 = 0 AS has_struct_tree, doc_id % 7 <> 0 AS has_mark_info, doc_id % 11 <> 0 AS marked, doc_id % 4 = 0 AS encrypted,
 CAST((doc_id * 37) % 65536 - 32768 AS INT) AS p, doc_id % 9 <> 0 AS allow_accessibility, lang, lang IN ('en', 'de', 'fr', 'es') AS lang_valid,
 CAST(doc_id % 6 AS INT) AS n_fields, doc_id % 19 = 0 AS xfa_required, CAST(doc_id % 2 AS INT) AS n_outline_roots, CAST(1 + floor(n_chars / 40) AS INT) AS n_pages,
 CASE WHEN doc_id % 8 = 0 THEN 0 ELSE doc_id % 50 END AS num_tf FROM documents"""


def _judged(spark, d):
    facts = spark.sql(FACTS.replace("FROM documents", "FROM {docs}"), docs=table(spark, d, "documents"))
    return verdicts.judged(facts.withColumn("font_names", F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Helvetica")))))


def verdict_tests(spark, d):
    return _judged(spark, d).select("doc_id", *[F.coalesce(t, F.lit("-")).alias(t) for t in ("TitleTest", "TaggedTest", "ProtectedTest", "LanguageTest", "BookmarksTest", "EmptyTextTest")])


def verdict_overall(spark, d):
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c)
    return _judged(spark, d).select("doc_id", *[t(c) for c in ("Accessible", "TotallyInaccessible", "BrokenFile", "Exempt")], "log")


def run_outcomes(spark, d):
    """Outcomes of a run whose verdicts are those of the document with the entry's number; an entry without one failed."""
    return manifest.run_outcomes(_scheduled(spark, d), _judged(spark, d).withColumnRenamed("doc_id", "entry_pos"))


# --- reports ---------------------------------------------------------------------------------------


def summary_stats(spark, d):
    return reports.summary(entries(spark, d))


def files_per_site(spark, d):
    return reports.files_per_site(entries(spark, d))


def summary_rows(spark, d):
    return reports.summary_rows(entries(spark, d), 64)


def issue_rows(spark, d):
    return reports.issue_rows(entries(spark, d), 0)


def csv_report(spark, d):
    return reports.csv_rows(entries(spark, d))


def markdown_rows(spark, d):
    return reports.markdown_rows(entries(spark, d))


def first_issues(spark, d):
    return reports.first_issues(entries(spark, d), TOP)


def error_lines(spark, d):
    return reports.error_lines(entries(spark, d))


def sorted_table(spark, d):
    done = entries(spark, d).where("status = 'analysed'")
    keyed = done.select("entry_pos", reports.sort_key(F.col("filename"), "text").alias("by_name"), reports.sort_key(F.col("report.Accessible"), "verdict").alias("by_verdict"), reports.sort_key(F.col("report.Pages"), "number").alias("by_pages"))
    return keyed.orderBy(F.col("by_verdict").desc(), F.col("by_name"), F.col("entry_pos"))


def optional_columns(spark, d):
    shown = lambda n: F.bool_or(F.col(f"report.{n}").isNotNull())
    return entries(spark, d).where("status = 'analysed'").agg(shown("Words").alias("words"), shown("Images").alias("images"), shown("veraPDF").alias("validator"))


def failed_rules(spark, d):
    return entries(spark, d).select(F.explode("report.veraPDF.failed_rules").alias("rule")).where("rule <> ''").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def validator_summaries(spark, d):
    """The stored validation results, written as XML and read again; every seventh report is an exception, every eleventh no report."""
    v = lambda n: F.col(f"report.veraPDF.{n}")
    one = lambda r: F.concat(F.lit('<rule specification="x" clause="'), F.substring_index(r, "-", 1), F.lit('" '), F.when(F.instr(r, "-") > 0, F.concat(F.lit('testNumber="'), F.substring_index(r, "-", -1), F.lit('" '))).otherwise(""), F.lit('status="FAILED"/><rule clause="9.9" testNumber="9" status="PASSED"/>'))
    rules = F.array_join(F.transform(F.coalesce(v("failed_rules"), F.array().cast("array<string>")), one), "")
    attribute = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))).otherwise("")
    report = F.concat(F.lit('<?xml version="1.0"?>\n<r:report xmlns:r="urn:r" xmlns="urn:v"><jobs><job><validationReport'), attribute("profileName", v("profile")), attribute("isCompliant", v("compliant")), F.lit("><details"), attribute("passedChecks", v("passed_checks")), attribute("failedChecks", v("failed_checks")), F.lit(' failedRules="1">'), rules, F.lit("</details></validationReport></job></jobs></r:report>"))
    k = F.col("entry_pos")
    xml = F.when(k % 7 == 0, "<report><exceptionMessage>cannot parse</exceptionMessage></report>").when(k % 11 == 0, "<report/>").otherwise(report)
    got = files.validator_summary(entries(spark, d).where("report.veraPDF IS NOT NULL").select("entry_pos", xml.alias("xml")))
    return got.select("entry_pos", F.coalesce(F.col("validator.compliant").cast("string"), F.lit("-")).alias("compliant"), "validator.profile", *[F.coalesce(f"validator.{c}", F.lit(-1)).alias(c) for c in ("failed_checks", "passed_checks")], F.array_join("validator.failed_rules", ";").alias("rules"), "validator.error")


def producers_union(spark, d):
    """Content statistics merged per site: words summed, producer names united."""
    return entries(spark, d).groupBy("site").agg(F.coalesce(F.sum("report.Words"), F.lit(0)).cast("bigint").alias("words"), F.array_join(F.array_sort(F.collect_set("report.Producer")), ";").alias("producers"))


def zero_result_notes(spark, d):
    per_site = links(spark, d).groupBy(urls.site_key(urls.authority(F.col("url"))).alias("site")).agg(F.count_if(F.col("type") == "pdf").alias("files"), F.count_if(F.col("type") == "page").alias("pages"))
    return per_site.select("site", F.coalesce(reports.zero_result_note(F.col("files"), F.col("pages"), F.lit("https://r.example/1"), F.lit("https://p.example")), F.lit("")).alias("note"))


# --- history ---------------------------------------------------------------------------------------

HISTORY = """SELECT event_id, ts AS date, event_type AS site, 'https://' || event_type || '.example/' AS crawl_url,
 CASE WHEN event_id % 5 <> 0 THEN 'https://h.example/o/r/issues/' || CAST(user_id AS STRING) END AS issue_url, 'f' || CAST(event_id AS STRING) AS archive_file,
 1 + event_id % 40 AS analysed, (event_id * 7) % (1 + event_id % 40) AS accessible FROM events"""
_H = f"h AS ({HISTORY}), k AS (SELECT *, CASE WHEN regexp_extract(coalesce(issue_url, ''), '/issues/([0-9]+)', 1) <> '' THEN '#' || regexp_extract(issue_url, '/issues/([0-9]+)', 1) ELSE coalesce(site, '') END AS scan_key FROM h), l AS (SELECT DISTINCT ON (scan_key) * FROM k ORDER BY scan_key, date DESC, event_id DESC)"


def _latest(spark, d):
    history = spark.sql(HISTORY.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))
    return reports.latest_per_issue(history, ["date", "event_id"])


def latest_scans(spark, d):
    percent = reports.accessible_percent(F.col("accessible"), F.col("analysed"))
    return _latest(spark, d).select("scan_key", "event_id", percent.alias("percent"), reports.band(percent).alias("band"), F.greatest(F.lit(0).cast("bigint"), F.col("analysed") - F.col("accessible")).alias("issues"))


def history_summary(spark, d):
    return _latest(spark, d).agg(F.count(F.lit(1)).alias("scans"), F.countDistinct(F.nullif(F.col("site"), F.lit(""))).alias("sites"))


def history_filter(spark, d):
    return reports.matching(_latest(spark, d), "  CLI ").select("scan_key", "event_id")


def _index(spark, d):
    return spark.sql(HISTORY.replace("FROM events", "FROM {events}"), events=table(spark, d, "events")).select("event_id", "archive_file")


def index_append(spark, d):
    """Every event as a new scan, two thirds of them listed before."""
    h = _index(spark, d)
    return reports.appended(h.where("event_id % 3 <> 0"), h)


QUERIES = {
    f.__name__: f
    for f in (
        url_parts, url_flags, links_per_site, normalized_seeds, save_names, unique_names, resolved_links, link_actions, page_anchors, link_inventory, crawl_state, file_urls, visited_pages, pdf_responses, external_domains,
        content_md5, duplicate_content, word_counts, escaped_titles, language_tags, crawl_ages, crawl_age_texts, scan_requests, pdf_dates, exempt_orders, permission_bits, archive_names,
        pending_for_site, status_counts, with_errors, manual_review, upsert_manifest, upsert_counts, mark_results, analysis_schedule, guard_errors, needs_analysis, verdict_tests, verdict_overall, run_outcomes,
        summary_stats, files_per_site, summary_rows, issue_rows, csv_report, markdown_rows, first_issues, error_lines, sorted_table, optional_columns, failed_rules, validator_summaries, producers_union, zero_result_notes,
        latest_scans, history_summary, history_filter, index_append,
    )
}

_P, _HOST = _sql_path("url"), _sql_key(_sql_part("url", 2))
_NAME = f"CASE WHEN {_sql_ext('n')} = '' THEN n || '.pdf' ELSE n END"
_NAMED = f"named AS (SELECT link_id, type, url, {_NAME} AS name FROM (SELECT *, coalesce(list_filter(string_split({_P}, '/'), lambda s: s <> '')[-1], 'doc-' || substr(md5(url), 1, 8)) AS n FROM crawled_urls))"
_TRIMMED = r"regexp_replace(regexp_replace(url, '[\t\r\n]', '', 'g'), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_EDGES = f"""b AS (SELECT link_id, url AS page, {_TRIMMED} AS b, {_HREF} AS href FROM crawled_urls),
 e AS (SELECT link_id, page, href, regexp_extract(b, '^([^:/?#]+:)', 1) AS s, regexp_extract(b, '^(?:[^:/?#]+:)?(//[^/?#]*)', 1) AS h, {_sql_part('b', 3)} AS p FROM b),
 f AS (SELECT *, CASE WHEN h <> '' AND p = '' THEN '/' ELSE regexp_extract(p, '(?s)^(.*/)', 1) END || CASE link_id % 8 WHEN 0 THEN href ELSE 'c.html' END AS joined FROM e),
 g AS (SELECT *, list_reduce(list_transform(string_split(joined, '/'), lambda x: [x]), lambda a, x: CASE WHEN x = ['..'] THEN CASE WHEN len(a) > 1 THEN a[:-2] WHEN len(a) = 1 THEN [''] ELSE a END WHEN x = ['.'] THEN a ELSE a || x END, CAST([] AS VARCHAR[])) AS kept FROM f),
 t AS (SELECT link_id, page, CASE WHEN page IS NULL THEN NULL ELSE CASE link_id % 8 WHEN 0 THEN s || h || array_to_string(kept, '/') WHEN 2 THEN s || href WHEN 3 THEN s || h || array_to_string(kept, '/') || '#top' WHEN 5 THEN href WHEN 6 THEN s || h || p || href WHEN 7 THEN href ELSE s || h || href END END AS target FROM g)"""
_TPATH = f"lower({_sql_path('target')})"
_THOST = _sql_key(_sql_part("target", 2))
_TDOMAIN = _sql_key(_sql_part("page", 2))
_STATE = f"got AS (SELECT {_HOST} AS folder, name AS filename, link_id, url FROM named WHERE type = 'pdf'), st AS (SELECT got.*, c.referer FROM got JOIN crawled_urls c USING (link_id) QUALIFY row_number() OVER (PARTITION BY folder, filename ORDER BY link_id) = 1)"
_DONE = "status = 'analysed'"
_OUT = f"CASE WHEN coalesce(url, '') <> '' AND coalesce(site, '') <> '' AND {_HOST} <> '' AND {_HOST} <> {_sql_key('site')} AND NOT ends_with({_HOST}, '.' || {_sql_key('site')}) THEN {_HOST} ELSE '' END"
_INSTANT = "try_cast(CASE WHEN regexp_matches(trim(crawled_at), '[T ][0-9]{2}:[0-9]{2}.*(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN trim(crawled_at) ELSE trim(crawled_at) || 'Z' END AS TIMESTAMPTZ)"
_SCAN = "s AS (SELECT DISTINCT ON (entry_id) entry_id AS scan_pos, url, md5, filename, site, crawled_at, CASE WHEN entry_id % 10 = 0 THEN 'seen again' ELSE '' END AS notes FROM manifest_batches), t AS (SELECT DISTINCT ON (url) * FROM e WHERE url IS NOT NULL ORDER BY url, entry_pos)"
_FOLD = f"WITH {_E}, {_SCAN}, f AS (SELECT s.*, t.entry_pos, t.status AS old_status, CASE WHEN row_number() OVER w = 1 THEN t.entry_pos IS NULL OR s.md5 IS DISTINCT FROM t.md5 ELSE s.md5 IS DISTINCT FROM lag(s.md5) OVER w END AS changed FROM s LEFT JOIN t USING (url) WHERE s.url IS NOT NULL WINDOW w AS (PARTITION BY s.url ORDER BY scan_pos)), c AS (SELECT *, bool_or(changed) OVER (PARTITION BY url ORDER BY scan_pos) OR old_status IS DISTINCT FROM 'analysed' AS needs_scan FROM f)"
_MARK = lambda c: f"CASE coalesce(CAST({c} AS VARCHAR), '-') WHEN 'true' THEN '✅ Pass' WHEN 'Pass' THEN '✅ Pass' WHEN 'false' THEN '❌ Fail' WHEN 'Fail' THEN '❌ Fail' WHEN '-' THEN '—' ELSE CAST({c} AS VARCHAR) END"
_ICON = lambda n: f"CASE CAST(report.{n} AS VARCHAR) WHEN 'true' THEN '✅' WHEN 'Pass' THEN '✅' WHEN 'false' THEN '❌' WHEN 'Fail' THEN '❌' ELSE '—' END"
_CSV = ", ".join([f"coalesce(CAST({c} AS VARCHAR), '') AS {c}" for c in ("url", "filename", "site", "status", "crawled_at")] + [f"coalesce(CASE CAST(report.{c} AS VARCHAR) WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' ELSE CAST(report.{c} AS VARCHAR) END, '') AS {n}" for n, c in {"published_date": "Date", "accessible": "Accessible", "totally_inaccessible": "TotallyInaccessible", "broken": "BrokenFile", "tagged": "TaggedTest", "empty_text": "EmptyTextTest", "protected": "ProtectedTest", "title": "TitleTest", "language": "LanguageTest", "bookmarks": "BookmarksTest", "exempt": "Exempt", "pages": "Pages", "words": "Words", "images": "Images"}.items()])
_ERRORS = "array_to_string(list_filter(coalesce(errors, []), lambda x: x <> ''), '; ')"
_EXT = f"CASE WHEN {_OUT} <> '' THEN ' *(ext: ' || {_OUT} || ')*' ELSE '' END"
_CELL = lambda n: f"coalesce(CAST(report.{n} AS VARCHAR), '—')"
_PAGES = "CASE WHEN report IS NULL THEN '—' ELSE coalesce(CAST(report.Pages AS VARCHAR), 'None') END"
_LINE = f"'| [' || coalesce(filename, url, '') || '](' || coalesce(url, '') || ') | ' || coalesce(site, '') || {_EXT} || ' | ' || coalesce(nullif(substr(report.Date, 1, 10), ''), '—') || ' | ' || " + " || ' | ' || ".join([*[_MARK(f"report.{n}") for n in ("Accessible", "TaggedTest", "EmptyTextTest", "ProtectedTest", "TitleTest", "LanguageTest", "BookmarksTest", "Exempt")], _PAGES, _CELL("Words"), _CELL("Images")]) + " || ' |'"
_ISSUE = f"'| [' || coalesce(filename, string_split(coalesce(url, ''), '/')[-1]) || '](' || coalesce(url, '') || ')' || {_EXT} || ' | ' || " + " || ' | ' || ".join([*[_ICON(n) for n in ("Accessible", "TaggedTest", "TitleTest", "LanguageTest", "BookmarksTest")], _PAGES, _CELL("Words"), _CELL("Images")]) + " || ' |'"
_METRICS = lambda rows: " UNION ALL ".join(f"SELECT {i} AS ord, '{text}' AS metric, {count} AS value FROM c" for i, text, count in rows)
_COUNTS = f"c AS (SELECT count(*) AS total, count(*) FILTER ({_DONE}) AS analysed, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'error') AS errored, count(*) FILTER ({_DONE} AND report.Accessible) AS accessible, count(*) FILTER ({_DONE} AND report.TotallyInaccessible) AS shut, count(*) FILTER ({_DONE} AND report.BrokenFile) AS broken, count(*) FILTER ({_DONE} AND report.Exempt) AS exempt FROM e)"
_GUARDED = rf"""gd AS (SELECT *, CASE WHEN entry_pos % 7 = 0 AND coalesce((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us({_INSTANT})) / 86400000000.0 > {MAX_AGE_DAYS}, false) THEN 'stale' WHEN entry_pos % 7 = 0 THEN 'missing'
      WHEN coalesce(lower(regexp_extract(filename, '[^/.][^/]*?(\.[^./]+)$', 1)), '') <> '.pdf' THEN 'not_pdf' WHEN entry_pos * 37 % 260 > {MAX_MB} THEN 'oversize' ELSE 'analyse' END AS guard FROM e WHERE status = 'pending'),
      cd AS (SELECT *, CAST(sum(CASE WHEN guard = 'analyse' THEN 1 ELSE 0 END) OVER (ORDER BY entry_pos) AS BIGINT) AS consumed FROM gd),
      q AS (SELECT *, CASE WHEN consumed > {MAX_FILES} THEN 'waiting' ELSE guard END AS outcome FROM cd)"""
_JUDGED = f"""f AS ({FACTS.replace(" AS STRING", " AS VARCHAR")}), g AS (SELECT *, coalesce(title, '') <> '' AND has_viewer_prefs AND display_doc_title AS title_ok, has_struct_tree AND has_mark_info AND marked AS tagged_ok,
 coalesce(lang, '') <> '' AND coalesce(lang_valid, false) AS lang_ok, n_outline_roots > 0 OR n_pages <= 20 AS marks_ok, doc_id % 10 <> 0 AND num_tf > 0 AS fonts_ok, encrypted AND (p & 512) = 0 AND (p & 16) <> 0 AS bits FROM f),
 j AS (SELECT *, CASE WHEN has_xmp THEN CASE WHEN title_ok THEN 'Pass' ELSE 'Fail' END ELSE '-' END AS "TitleTest", CASE WHEN tagged_ok THEN 'Pass' ELSE 'Fail' END AS "TaggedTest", CASE WHEN NOT encrypted OR bits OR allow_accessibility THEN 'Pass' ELSE 'Fail' END AS "ProtectedTest",
 CASE WHEN lang IS NULL AND open_error IS NOT NULL THEN '-' WHEN lang_ok THEN 'Pass' ELSE 'Fail' END AS "LanguageTest", CASE WHEN marks_ok THEN 'Pass' ELSE 'Fail' END AS "BookmarksTest", CASE WHEN fonts_ok THEN 'Pass' ELSE 'Fail' END AS "EmptyTextTest",
 (CASE WHEN has_xmp THEN '' ELSE 'xmp ' END) || (CASE WHEN has_xmp AND doc_date IS NULL THEN 'no date found, ' ELSE '' END) || (CASE WHEN has_xmp AND NOT title_ok THEN 'title, ' ELSE '' END) || (CASE WHEN tagged_ok THEN '' ELSE 'tagged, ' END) || (CASE WHEN bits THEN 'P[10]=False P[5]=True R=' || revision || ', ' ELSE '' END) || (CASE WHEN coalesce(lang, '') = '' AND open_error IS NULL THEN 'lang, ' WHEN coalesce(lang, '') <> '' AND NOT lang_ok THEN 'Default language is not valid: ' || lang || ', ' ELSE '' END)
 || (CASE WHEN xfa_required THEN 'xfa, ' ELSE '' END) || (CASE WHEN marks_ok THEN '' ELSE 'no bookmarks and more than 20 pages, ' END) || coalesce(CASE error_kind WHEN 'password' THEN 'Password protected: ' WHEN 'pdf' THEN 'PdfError: ' ELSE 'ValueError: ' END || open_error, '') AS log FROM g),
 o AS (SELECT *, CASE WHEN open_error IS NOT NULL THEN '-' WHEN has_xmp AND title_ok AND tagged_ok AND "ProtectedTest" = 'Pass' AND lang_ok AND marks_ok THEN 'true' ELSE 'false' END AS "Accessible", CASE WHEN (NOT tagged_ok AND NOT fonts_ok) OR "ProtectedTest" = 'Fail' THEN 'true' ELSE 'false' END AS "TotallyInaccessible",
 CASE WHEN open_error IS NOT NULL THEN 'true' ELSE 'false' END AS "BrokenFile", CASE WHEN n_fields > 0 THEN 'false' WHEN has_xmp AND doc_date < TIMESTAMPTZ '2018-09-22 22:00:00+00' THEN 'true' ELSE '-' END AS "Exempt" FROM j)"""
_PERCENT = "CASE WHEN analysed > 0 THEN CAST(floor(100.0 * accessible / analysed + 0.5) AS INT) END"
_ENCODED = lambda c: f"replace(replace(replace(replace(replace(url_encode({c}), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')"
_WORDS = texts.WORD.replace("\\x0B", "\\x{0B}")

SQL = {
    "url_parts": f"SELECT link_id, lower({_sql_part('url', 1)}) AS scheme, {_sql_part('url', 2)} AS authority, {_P} AS path, {_sql_ext(_P)} AS ext, CASE WHEN {_sql_ext(_P)} = '.' THEN '' ELSE {_sql_ext(_P)} END AS suffix FROM crawled_urls",
    "url_flags": f"SELECT link_id, ends_with(lower({_P}), '.pdf') AS is_pdf, {_DOWNLOAD} AS is_download, lower({_sql_part('url', 1)}) IN ('http', 'https') AND {_sql_part('url', 2)} <> '' AND NOT ends_with(lower({_P}), '.pdf') AS is_submittable, regexp_matches(regexp_replace(regexp_replace(url, '^https?://', ''), '^/+', ''), '^[a-zA-Z0-9][a-zA-Z0-9.\\-_/]*\\.[a-zA-Z]{{2,}}') AND NOT contains(regexp_replace(regexp_replace(url, '^https?://', ''), '^/+', ''), '..') AS is_bare FROM crawled_urls",
    "links_per_site": f"SELECT {_HOST} AS site, type, count(*) AS n FROM crawled_urls GROUP BY 1, 2",
    "normalized_seeds": r"""WITH r AS (SELECT link_id, CASE WHEN link_id % 2 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END AS t FROM crawled_urls), b AS (SELECT *, regexp_replace(t, '^/+', '') AS b FROM r)
      SELECT link_id, CASE WHEN regexp_matches(t, '^https?://') THEN regexp_extract(t, '^(https?://)', 1) || lower(regexp_extract(t, '^https?://([^/?#]*)', 1)) || regexp_extract(t, '(?s)^https?://[^/?#]*(.*)\z', 1)
      WHEN NOT (regexp_matches(b, '^[a-zA-Z0-9][a-zA-Z0-9.\-_/]*\.[a-zA-Z]{2,}') AND NOT contains(b, '..')) THEN 'https://' || b
      WHEN link_id % 3 = 0 THEN 'http://www.' || b WHEN link_id % 3 = 1 THEN 'https://www.' || b ELSE 'https://' || b END AS seed FROM b""",
    "save_names": f"WITH {_NAMED} SELECT link_id, name FROM named",
    "unique_names": f"WITH {_NAMED}, r AS (SELECT link_id, {_HOST} AS folder, name, {_sql_ext('name')} AS x FROM named WHERE type = 'pdf'), n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY link_id) AS k FROM r) SELECT link_id, folder, CASE WHEN k = 1 THEN name ELSE left(name, length(name) - length(x)) || '-' || (k - 2) || x END AS name FROM n",
    "resolved_links": f"WITH {_EDGES} SELECT link_id, target FROM t",
    "link_actions": rf"""WITH {_EDGES} SELECT link_id, CASE WHEN lower({_sql_part('target', 1)}) NOT IN ('', 'http', 'https') THEN 'drop' WHEN {_sql_ext(f"regexp_replace({_TPATH}, '/+$', '')")} = '.pdf' THEN 'download' WHEN contains({_TPATH}, 'recherche') OR contains({_TPATH}, 'search') THEN 'skip_search'
      WHEN {_sql_inside(_THOST, _TDOMAIN)} THEN 'follow' WHEN {_sql_ext(f"regexp_replace({_TPATH}, '/+$', '')")} = '' THEN 'probe' ELSE 'skip_offsite' END AS action FROM t WHERE page IS NOT NULL
      UNION ALL SELECT link_id, 'follow' FROM t WHERE page IS NULL""",
    "link_inventory": f"WITH {_NAMED}, {_STATE} SELECT 0 AS part, link_id AS at, '' AS seq, url, type, '' AS referer FROM crawled_urls WHERE type = 'page' UNION ALL SELECT 1, 0, filename, url, coalesce(nullif(regexp_replace(CASE WHEN {_sql_ext('lower(filename)')} = '.' THEN '' ELSE {_sql_ext('lower(filename)')} END, '^[.]', ''), ''), 'file'), CASE WHEN trim(referer) <> '' THEN referer ELSE '' END FROM st",
    "external_domains": f"WITH {_E} SELECT entry_pos, {_OUT} AS external FROM e",
    "content_md5": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "duplicate_content": "SELECT md5(text) AS md5, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "word_counts": f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS words FROM documents",
    "escaped_titles": f"SELECT doc_id, replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS title, {_ENCODED("coalesce(source, '')")} AS source FROM documents",
    "language_tags": f"SELECT doc_id, coalesce(regexp_matches(lang, '(?i)^[a-z]{{2,3}}(-[a-z]{{4}})?(-([a-z]{{2}}|[0-9]{{3}}))?(-([a-z0-9]{{5,8}}|[0-9][a-z0-9]{{3}}))*(-[a-wyz](-[a-z0-9]{{2,8}})+)*(-x(-[a-z0-9]{{1,8}})+)?$') AND lower(split_part(lang, '-', 1)) IN ({', '.join(repr(x) for x in LANGUAGES)}), false) AS valid FROM documents",
    "crawl_ages": f"WITH {_E} SELECT entry_pos, coalesce(CAST(floor((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us({_INSTANT})) / 86400000000.0) AS BIGINT), -1) AS days, coalesce(substr(report.Date, 1, 10), '—') AS published FROM e",
    "pdf_dates": """WITH r AS (SELECT event_id, event_id % 8 AS k, CAST(date_trunc('second', ts) AS TIMESTAMP) AS t FROM events), o AS (SELECT *, CASE k WHEN 0 THEN 60 WHEN 3 THEN 60 WHEN 4 THEN 60 WHEN 5 THEN -330 WHEN 6 THEN 150 ELSE 0 END AS m FROM r)
      SELECT event_id, CASE WHEN k <> 7 THEN t - m * INTERVAL 1 MINUTE END AS at, CASE WHEN k <> 7 THEN strftime(t, '%Y-%m-%d %H:%M:%S') || CASE k WHEN 0 THEN '+01:00' WHEN 3 THEN '+01:00' WHEN 4 THEN '+01:00' WHEN 5 THEN '-05:30' WHEN 6 THEN '+02:30' ELSE '+00:00' END END AS text FROM o""",
    "exempt_orders": "SELECT o_orderkey, o_orderkey % 5 <> 0 AND CAST(o_orderdate AS TIMESTAMP) + INTERVAL 23 YEARS < TIMESTAMP '2018-09-22 22:00:00' AS exempt FROM orders",
    "permission_bits": "WITH p AS (SELECT o_orderkey AS k, CAST(o_orderkey * 37 % 65536 - 32768 AS INT) AS p FROM orders) SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN 'Pass' WHEN k % 11 = 0 THEN 'Fail' WHEN (p & 512) = 0 AND (p & 16) <> 0 THEN 'Pass' WHEN k % 2 = 0 THEN 'Pass' ELSE 'Fail' END AS test FROM p",
    "archive_names": "SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d_%H-%M-%S-%g') || '_' || trim(replace(regexp_replace('.a/b..' || event_type, '[^a-zA-Z0-9._-]', '_', 'g'), '..', '_'), '.') || '.html' AS name FROM events",
    "pending_for_site": f"WITH {_E} SELECT entry_pos, url FROM e WHERE status = 'pending' AND site = '{SITE}'",
    "status_counts": f"WITH {_E} SELECT status, count(*) AS n FROM e GROUP BY status",
    "with_errors": f"WITH {_E} SELECT entry_pos, status, {_ERRORS} AS errors FROM e WHERE len(coalesce(errors, [])) > 0",
    "manual_review": f"WITH {_E} SELECT entry_pos FROM e WHERE coalesce(report.Form, false) OR coalesce(report.xfa, false)",
    "upsert_manifest": f"""{_FOLD}, u AS (SELECT url, any_value(entry_pos) AS entry_pos, bool_or(changed) AS changed, max_by({{'m': md5}}, scan_pos) FILTER (changed) AS last, min_by({{'f': filename, 's': site}}, scan_pos) AS first, min(scan_pos) AS first_pos, max_by(notes, scan_pos) FILTER (notes <> '') AS note FROM c GROUP BY url)
      SELECT e.entry_pos, e.url, CASE WHEN coalesce(u.changed, false) THEN u.last.m ELSE e.md5 END AS md5, e.filename, e.site, CASE WHEN coalesce(u.changed, false) THEN 'pending' ELSE e.status END AS status, CASE WHEN coalesce(u.changed, false) THEN 0 ELSE CAST(len(e.errors) AS INT) END AS n_errors, e.report IS NOT NULL AND NOT coalesce(u.changed, false) AS has_report, coalesce(u.note, e.notes) AS notes FROM e LEFT JOIN u USING (entry_pos)
      UNION ALL SELECT (SELECT max(entry_pos) FROM e) + 1 + first_pos, url, last.m, first.f, first.s, 'pending', 0, false, note FROM u WHERE entry_pos IS NULL""",
    "upsert_counts": f"{_FOLD} SELECT needs_scan, count(*) AS n FROM c GROUP BY needs_scan",
    "mark_results": f"WITH {_E}, {_SCAN}, r AS (SELECT url, max_by(scan_pos % 3 <> 0, scan_pos) AS ok FROM s GROUP BY url) SELECT e.entry_pos, CASE WHEN t.entry_pos IS NULL OR r.ok IS NULL THEN e.status WHEN r.ok THEN 'analysed' ELSE 'error' END AS status FROM e LEFT JOIN t ON t.entry_pos = e.entry_pos LEFT JOIN r ON r.url = t.url",
    "analysis_schedule": f"WITH {_E}, {_GUARDED} SELECT entry_pos, outcome, consumed FROM q",
    "verdict_tests": f'WITH {_JUDGED} SELECT doc_id, "TitleTest", "TaggedTest", "ProtectedTest", "LanguageTest", "BookmarksTest", "EmptyTextTest" FROM o',
    "verdict_overall": f'WITH {_JUDGED} SELECT doc_id, "Accessible", "TotallyInaccessible", "BrokenFile", "Exempt", log FROM o',
    "run_outcomes": f'''WITH {_E}, {_GUARDED}, {_JUDGED} SELECT CASE WHEN outcome = 'missing' THEN 'not found' WHEN outcome = 'stale' THEN 'stale' WHEN outcome <> 'analyse' THEN 'skipped' WHEN o.doc_id IS NULL THEN 'errors' WHEN "BrokenFile" = 'true' THEN 'broken' WHEN "Accessible" = 'true' THEN 'accessible' ELSE 'issues' END AS outcome, count(*) AS n FROM q LEFT JOIN o ON o.doc_id = q.entry_pos WHERE outcome <> 'waiting' GROUP BY 1''',
    "summary_stats": f"WITH {_E}, {_COUNTS} SELECT total AS total_files, analysed, pending, errored, accessible, shut AS totally_inaccessible, broken, exempt, analysed - accessible AS issues FROM c",
    "files_per_site": f"WITH {_E} SELECT coalesce(site, 'unknown') AS site, count(*) AS n FROM e GROUP BY 1",
    "summary_rows": f"WITH {_E}, {_COUNTS} " + _METRICS([(0, "URLs crawled", "CAST(64 AS BIGINT)"), (1, "Total files tracked", "total"), (2, "Analysed", "analysed"), (3, "Pending analysis", "pending"), (4, "Errors during analysis", "errored"), (5, "Accessible", "accessible"), (6, "Totally inaccessible", "shut"), (7, "Broken / unreadable", "broken"), (8, "Exempt (pre-2018)", "exempt")]),
    "csv_report": f"WITH {_E} SELECT entry_pos, {_CSV}, {_OUT} AS external_domain, {_ERRORS} AS errors FROM e",
    "markdown_rows": f"WITH {_E} SELECT entry_pos, {_LINE} AS line FROM e WHERE {_DONE}",
    "first_issues": f"WITH {_E} SELECT entry_pos, {_ISSUE} AS line FROM e WHERE {_DONE} ORDER BY entry_pos LIMIT {TOP}",
    "error_lines": f"WITH {_E}, x AS (SELECT entry_pos, ['### ' || coalesce(filename, url, ''), '', '- **URL**: ' || coalesce(url, ''), '- **Status**: ' || coalesce(status, '')] || list_transform(list_filter(errors, lambda x: x <> ''), lambda x: '- ' || x) AS ls FROM e WHERE len(errors) > 0) SELECT entry_pos, CAST(unnest(range(len(ls))) AS INT) AS nth, unnest(ls) AS line FROM x",
    "sorted_table": f"WITH {_E} SELECT entry_pos, lower(coalesce(filename, '')) AS by_name, CASE report.Accessible WHEN true THEN 1 WHEN false THEN 0 ELSE -1 END AS by_verdict, coalesce(report.Pages, -1) AS by_pages FROM e WHERE {_DONE}",
    "optional_columns": f"WITH {_E} SELECT bool_or(report.Words IS NOT NULL) AS words, bool_or(report.Images IS NOT NULL) AS images, bool_or(report.veraPDF IS NOT NULL) AS validator FROM e WHERE {_DONE}",
    "failed_rules": f"WITH {_E}, x AS (SELECT unnest(report.veraPDF.failed_rules) AS rule FROM e) SELECT rule, count(*) AS n FROM x WHERE rule <> '' GROUP BY rule",
    "producers_union": f"WITH {_E} SELECT site, CAST(coalesce(sum(report.Words), 0) AS BIGINT) AS words, coalesce(array_to_string(list_sort(list(DISTINCT report.Producer) FILTER (report.Producer IS NOT NULL)), ';'), '') AS producers FROM e GROUP BY site",
    "zero_result_notes": f"""WITH s AS (SELECT {_HOST} AS site, count(*) FILTER (type = 'pdf') AS f, count(*) FILTER (type = 'page') AS p FROM crawled_urls GROUP BY 1) SELECT site, CASE WHEN f = 0 AND p = 0 THEN '{reports.BLOCKED_NOTE.format(run="https://r.example/1")}' WHEN f = 0 THEN replace(replace('{reports.EMPTY_NOTE.format(run="https://r.example/1", base="https://p.example", pages="<p>", word="<w>")}', '<p>', CAST(p AS VARCHAR)), '<w>', CASE WHEN p = 1 THEN 'page' ELSE 'pages' END) ELSE '' END AS note FROM s""",
    "latest_scans": f"WITH {_H}, q AS (SELECT *, {_PERCENT} AS percent FROM l) SELECT scan_key, event_id, percent, CASE WHEN percent >= 75 THEN 'high' WHEN percent >= 40 THEN 'medium' ELSE 'low' END AS band, greatest(0, analysed - accessible) AS issues FROM q",
    "history_summary": f"WITH {_H} SELECT count(*) AS scans, count(DISTINCT nullif(site, '')) AS sites FROM l",
    "history_filter": f"WITH {_H} SELECT scan_key, event_id FROM l WHERE contains(lower(site), 'cli') OR contains(lower(crawl_url), 'cli')",
    "index_append": "SELECT event_id, 'f' || event_id AS archive_file FROM events",
    "page_anchors": """WITH u AS (SELECT regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS href FROM crawled_urls WHERE url IS NOT NULL AND NOT contains(url, '"')) SELECT href, count(*) AS n FROM (SELECT href FROM u UNION ALL SELECT unnest(['/b?x=1', 'c.html', '#e']) FROM u) GROUP BY href""",
    "crawl_state": f"WITH {_NAMED}, {_STATE}, r AS (SELECT folder, filename, url, CASE WHEN trim(referer) <> '' THEN referer END AS referer FROM st) SELECT folder, CAST(to_json(map(list(filename ORDER BY filename), list(url ORDER BY filename))) AS VARCHAR) AS url_map, CAST(to_json(map(list(filename ORDER BY filename), list(referer ORDER BY filename))) AS VARCHAR) AS referer_map FROM r GROUP BY folder",
    "file_urls": f"WITH {_E}, {_NAMED}, {_STATE}, m AS (SELECT filename, min(url) AS u FROM st WHERE contains(folder, '.') GROUP BY filename) SELECT entry_pos, coalesce(nullif(u, ''), 'https://' || site || '/' || e.filename) AS url FROM e LEFT JOIN m USING (filename) WHERE filename IS NOT NULL AND site IS NOT NULL",
    "visited_pages": f"SELECT link_id AS seq, url FROM crawled_urls WHERE type = 'page' AND link_id % 7 <> 0 ORDER BY link_id LIMIT {MAX_PAGES}",
    "pdf_responses": "SELECT link_id AS seq FROM crawled_urls WHERE type <> 'page' AND link_id % 2 = 0",
    "crawl_age_texts": f"WITH {_E}, a AS (SELECT entry_pos, crawled_at, (epoch_us(TIMESTAMPTZ '2024-02-01 00:00:00+00') - epoch_us({_INSTANT})) / CAST(86400000000.0 AS DOUBLE) AS days FROM e) SELECT entry_pos, CASE WHEN days IS NULL THEN crawled_at WHEN days < 1 THEN printf('%.1f', round_even(days, 1)) ELSE CAST(CAST(floor(days) AS BIGINT) AS VARCHAR) END AS age FROM a",
    "scan_requests": f"""WITH r AS (SELECT link_id, 'SCAN: ' || url AS t, '## Scan Request' || chr(10) || chr(10) || '**URL:** ' || url || chr(10) || chr(10) || CASE WHEN link_id % 2 = 0 THEN '**Notes:** it' || chr(39) || 's (new)!' || chr(10) || chr(10) ELSE '' END || CASE WHEN link_id % 5 - 1 > 0 THEN 'Number: ' || (link_id % 5 - 1) || chr(10) || chr(10) ELSE '' END || 'Thank you.' AS b FROM crawled_urls)
      SELECT link_id, '?title=' || {_ENCODED('t')} || '&body=' || {_ENCODED('b')} AS request FROM r""",
    "guard_errors": rf"""WITH {_E}, {_GUARDED}, d AS (SELECT *, CAST(CAST(floor((epoch_us(TIMESTAMPTZ '{NOW}+00') - epoch_us({_INSTANT})) / 86400000000.0) AS BIGINT) AS VARCHAR) AS days FROM q) SELECT entry_pos, CASE outcome
      WHEN 'missing' THEN 'File not found: files/' || coalesce(site, '') || '/' || coalesce(filename, '') || CASE WHEN days IS NOT NULL THEN ' (crawled ' || days || ' day(s) ago at ' || crawled_at || ')' WHEN coalesce(crawled_at, '') <> '' THEN ' (crawled_at: ' || chr(39) || crawled_at || chr(39) || ')' ELSE '' END || '. Possible causes: failed download, incomplete artifact transfer, or stale manifest entry from a previous run.'
      WHEN 'stale' THEN 'Stale manifest entry: file not found after {MAX_AGE_DAYS}+ days (crawled_at: ' || crawled_at || '). The file was probably downloaded in a previous run whose crawled_files directory is no longer available.'
      WHEN 'not_pdf' THEN 'Not a PDF file: ' || coalesce(nullif(regexp_extract(filename, '[^/.][^/]*?(\.[^./]+)$', 1), ''), '(no extension)') ELSE 'File too large to analyse: ' || printf('%.1f', CAST(entry_pos * 37 % 260 AS DOUBLE)) || ' MB (limit: {MAX_MB} MB)' END AS error FROM d WHERE outcome NOT IN ('waiting', 'analyse')""",
    "needs_analysis": f"WITH {_E}, {_SCAN}, m AS (SELECT url, min(md5) AS m FROM s WHERE url IS NOT NULL GROUP BY url) SELECT entry_pos FROM e LEFT JOIN m USING (url) WHERE status = 'pending' OR (m IS NOT NULL AND m IS DISTINCT FROM md5)",
    "issue_rows": f"WITH {_E}, {_COUNTS}, m AS (" + _METRICS([(1, "Total PDFs found", "total"), (2, "Analysed", "analysed"), (3, "✅ Accessible", "accessible"), (4, "❌ Issues found", "analysed - accessible"), (5, "⏳ Pending analysis", "pending"), (6, "⚠️ Errors", "errored")]) + ") SELECT * FROM m WHERE ord < 5 OR value > 0",
    "validator_summaries": f"""WITH {_E}, v AS (SELECT entry_pos, report.veraPDF AS v FROM e WHERE report.veraPDF IS NOT NULL) SELECT entry_pos, coalesce(CASE WHEN entry_pos % 7 <> 0 AND entry_pos % 11 <> 0 THEN CAST(v.compliant AS VARCHAR) END, '-') AS compliant, CASE WHEN entry_pos % 7 <> 0 AND entry_pos % 11 <> 0 THEN v.profile END AS profile, coalesce(CASE WHEN entry_pos % 7 <> 0 AND entry_pos % 11 <> 0 THEN v.failed_checks END, -1) AS failed_checks, coalesce(CASE WHEN entry_pos % 7 <> 0 AND entry_pos % 11 <> 0 THEN v.passed_checks END, -1) AS passed_checks,
      CASE WHEN entry_pos % 7 <> 0 AND entry_pos % 11 <> 0 THEN coalesce(array_to_string(list_filter(v.failed_rules, lambda x: x <> ''), ';'), '') ELSE '' END AS rules, CASE WHEN entry_pos % 7 = 0 THEN 'cannot parse' WHEN entry_pos % 11 = 0 THEN 'No validationReport element in veraPDF output' END AS error FROM v""",
}
