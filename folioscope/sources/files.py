"""Files of a crawl as DataFrames. Missing or unreadable state reads as empty, as a crawl may have left none."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import urls
from folioscope.runtime import named_files, read_in_task
from folioscope.schema import HISTORY, VALIDATOR

_MAP = T.MapType(T.StringType(), T.StringType())
_LIST = T.ArrayType(T.StringType())


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """``(value, folder)``: text of each file at ``path`` (a file or pattern); no rows if there is none.

    The state files of a crawl begin with an underscore, which Spark's readers skip. So the driver lists
    their paths, and the tasks open them.
    """
    found = [(p,) for p in named_files(spark, path)]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p in f["path"]:
                yield pd.DataFrame({"value": [read_in_task(p).decode("utf-8", "replace")], "folder": [p.rpartition("/")[0]]})

    paths = spark.createDataFrame(found, "path string")
    return paths.repartition(min(len(found), 1000), "path").mapInPandas(read, "value string, folder string") if found else spark.createDataFrame([], "value string, folder string")


def name_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``(folder, filename, <value>)`` of JSON objects that map file names to texts."""
    parsed = F.coalesce(F.from_json("value", _MAP), F.create_map().cast(_MAP))
    return _whole(spark, path).select("folder", F.explode(parsed).alias("filename", value))


def crawled_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, seq, url)`` of JSON arrays of URLs in order of visit; repeats stay."""
    parsed = F.coalesce(F.from_json("value", _LIST), F.array().cast(_LIST))
    return _whole(spark, path).select("folder", F.posexplode(parsed).alias("seq", "url"))


def link_inventory(pages: DataFrame, names: DataFrame, referers: DataFrame) -> DataFrame:
    """``(part, at, seq, url, type, referer)``: pages as visited (``at``), then downloads by file name (``seq``)."""
    seen = pages.select(F.lit(0).alias("part"), F.col("seq").cast("bigint").alias("at"), F.lit("").alias("seq"), "url", F.lit("page").alias("type"), F.lit("").alias("referer"))
    files = names.join(referers, ["folder", "filename"], "left")
    kind = F.regexp_replace(urls.suffix(F.lower("filename")), "^[.]", "")
    got = files.select(F.lit(1).alias("part"), F.lit(0).cast("bigint").alias("at"), F.col("filename").alias("seq"), "url", F.when(kind == "", "file").otherwise(kind).alias("type"), F.coalesce("referer", F.lit("")).alias("referer"))
    return seen.unionByName(got)


def downloads(spark: SparkSession, folder: str, site: str) -> DataFrame:
    """``(path, filename, site, md5, size_mb, modified)`` of the PDF files right inside ``folder``.

    Names are compared without letter case; the crawl's own state files and subfolders are left out.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return listed.select("path", name.alias("filename"), F.lit(site).alias("site"), F.md5("content").alias("md5"), (F.col("length") / 1048576.0).alias("size_mb"), F.col("modificationTime").alias("modified"))


def with_urls(files: DataFrame, names: DataFrame) -> DataFrame:
    """Each download with its URL, or ``https://<site>/<filename>`` where the map has none or a blank one."""
    met = files.join(names.groupBy("filename").agg(F.first("url").alias("url")), "filename", "left")
    return met.withColumn("url", F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit("https://"), "site", F.lit("/"), "filename")))


def anchors(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``(url, nth, href, target)`` of every anchor of a table of pages."""
    found = pages.select(F.col(url).alias("url"), F.posexplode(urls.hrefs(F.col(html))).alias("nth", "href"))
    return found.withColumn("target", urls.resolve(F.col("url"), F.col("href")))


def visited(responses: DataFrame, cap: int | None = None) -> DataFrame:
    """Pages of a crawl in order of visit: HTML responses that were not fetched only to see what they are, at most ``cap`` of them.

    ``responses``: seq, url, content_type, no_follow (null means no). The cap is the crawl's own limit.
    """
    is_html = F.coalesce(F.lower("content_type"), F.lit("")).contains("html")
    pages = responses.where(is_html & ~F.coalesce("no_follow", F.lit(False))).orderBy("seq")
    return pages if cap is None else pages.limit(cap)


def is_pdf_response(content_type: Column) -> Column:
    return F.coalesce(F.lower(content_type).contains("application/pdf"), F.lit(False))


def log_tail(spark: SparkSession, path: str, lines: int = 50) -> DataFrame:
    """``(nth, line)``: the last errors of a log, or its last lines if it has none. One file, read in order."""
    numbered = _whole(spark, path).select(F.posexplode(F.split("value", "\r?\n")).alias("nth", "line")).where("line <> ''")
    bad = F.col("line").contains(" ERROR ") | F.col("line").contains(" CRITICAL ")
    marked = numbered.withColumn("bad", bad)
    worst = marked.agg(F.coalesce(F.max("bad"), F.lit(False))).scalar()
    return marked.where(~worst | F.col("bad")).orderBy(F.col("nth").desc()).limit(lines).orderBy("nth").select("nth", "line")


def history_index(spark: SparkSession, path: str) -> DataFrame:
    """Scans listed in a JSON array, in order; anything else reads as none."""
    parsed = F.from_json("value", T.ArrayType(HISTORY))
    return _whole(spark, path).select(F.posexplode(parsed).alias("pos", "scan")).where(F.col("scan").isNotNull()).select("pos", "scan.*")


def _validated(text: str) -> dict:
    """Summary of one machine-readable validation report; fixed values: its element and attribute names, and the error texts."""
    out: dict = {"compliant": None, "profile": None, "failed_checks": None, "passed_checks": None, "failed_rules": [], "error": None}
    if not text.strip():
        return out | {"error": "veraPDF produced no output"}
    try:
        elements = list(ElementTree.fromstring(text.strip().encode("utf-8", "replace")).iter())
    except ElementTree.ParseError as error:
        return out | {"error": f"veraPDF XML parse error: {error}"}
    named = lambda among, name: [e for e in among if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]
    report = next(iter(named(elements, "validationReport")), None)
    if report is None:
        failed = named(elements, "exceptionMessage")
        return out | {"error": (failed[0].text or "veraPDF exception (no message)") if failed else "No validationReport element in veraPDF output"}
    out |= {"profile": report.get("profileName"), "compliant": {"true": True, "false": False}.get((report.get("isCompliant") or "").lower())}
    for details in named(report.iter(), "details")[:1]:
        for key, attribute in (("failed_checks", "failedChecks"), ("passed_checks", "passedChecks")):
            if re.fullmatch(r"\s*[+-]?\d+\s*", details.get(attribute) or ""):
                out[key] = int(details.get(attribute))
        rules = (r for r in named(details.iter(), "rule") if r.get("status") == "FAILED")
        out["failed_rules"] = [x for r in rules if (x := "-".join(filter(None, (r.get("clause"), r.get("testNumber")))))]
    return out


@F.pandas_udf(VALIDATOR)
def _summaries(texts: pd.Series) -> pd.DataFrame:
    found = [dict.fromkeys(VALIDATOR.fieldNames()) if t is None else _validated(t) for t in texts]
    columns = {n: [f[n] for f in found] for n in VALIDATOR.fieldNames()}
    return pd.DataFrame({n: pd.array(c, dtype="Int32") if n.endswith("_checks") else pd.Series(c, dtype=object) for n, c in columns.items()})


def validator_summary(reports: DataFrame, xml: str = "xml") -> DataFrame:
    """Add the ``validator`` struct of each machine-readable validation report; null where there is no report at all.

    Failed rules come as ``clause-test``, or as the one of both that is given, in document order. Output that is blank, no
    XML, or an exception of the tool gives a struct with ``error``.
    """
    return reports.withColumn("validator", F.when(F.col(xml).isNotNull(), _summaries(F.col(xml))))
