"""From the facts of PDF files to stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.texts import is_language_tag, word_count
from folioscope.functions.times import any_date, at_offset, offset_minutes, pdf_date
from folioscope.operators.manifest import first_by_url
from folioscope.operators.verdicts import judged
from folioscope.schema import REPORT


def document_date(facts: DataFrame) -> DataFrame:
    """Add ``doc_date``, the first readable date, and ``doc_offset``, its minutes from UTC.

    Modification comes before creation, and metadata before the document's own entries.
    """
    dates = [("xmp_modify", any_date), ("dc_modified", any_date), ("doc_mod", pdf_date), ("xmp_create", any_date), ("doc_creation", pdf_date)]
    found = F.coalesce(*[F.when(read(F.col(c)).isNotNull(), F.struct(read(F.col(c)).alias("at"), offset_minutes(F.col(c)).alias("offset"))) for c, read in dates])
    return facts.withColumn("_date", found).withColumn("doc_date", F.col("_date.at")).withColumn("doc_offset", F.col("_date.offset")).drop("_date")


def reports_of(facts: DataFrame, languages: list[str]) -> DataFrame:
    """``url``, ``report`` of the fixed layout and ``errors`` (the log, if any) for each row of facts.

    ``facts`` hold the text in ``text``, or its number of words in ``n_words``.
    """
    text = word_count(F.col("text")).cast("int") if "text" in facts.columns else F.col("n_words")
    dated = document_date(facts).withColumn("lang_valid", is_language_tag(F.col("lang"), languages)).withColumn("words", text)
    j = judged(dated)
    true_or_null = lambda c: F.when(F.coalesce(c, F.lit(False)), True)
    readable = ~F.col("BrokenFile")
    has_title = F.coalesce("title", F.lit("")) != ""
    given = {
        "Date": F.when(F.col("has_xmp"), at_offset(F.col("doc_date"), F.col("doc_offset"))), "hasTitle": F.when(F.col("has_xmp"), has_title), "hasDisplayDocTitle": F.when(F.col("has_xmp") & has_title, F.coalesce(F.col("has_viewer_prefs") & F.col("display_doc_title"), F.lit(False))),
        "hasLang": F.when(readable, F.coalesce("lang", F.lit("")) != ""), "InvalidLang": true_or_null((F.col("lang") != "") & ~F.coalesce("lang_valid", F.lit(False))), "Form": true_or_null(F.col("Form")), "xfa": true_or_null(F.col("xfa_required")),
        "hasBookmarks": F.when(readable, F.col("n_outline_roots") > 0), "hasXmp": F.col("has_xmp"), "PDFVersion": F.col("pdf_version"), "Creator": F.when(F.col("has_xmp"), F.col("creator")), "Producer": F.when(F.col("has_xmp"), F.col("producer")), "Pages": F.col("n_pages"), "Words": F.col("words"), "Images": F.col("n_images"), "veraPDF": F.lit(None),
    }
    fields = [given.get(f.name, F.col(f.name) if f.name in j.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in REPORT.fields]
    errors = F.when(F.col("log") != "", F.array("log")).otherwise(F.array().cast("array<string>"))
    return j.select("url", F.struct(*fields).alias("report"), errors.alias("errors"))


def stored(entries: DataFrame, reports: DataFrame) -> DataFrame:
    """``entries`` with each report in the first entry of its URL, which becomes ``analysed``."""
    once = reports.groupBy("url").agg(F.first(F.struct(F.col("report").alias("r"), F.col("errors").alias("e"))).alias("new"))
    hits = once.join(first_by_url(entries), "url").select("entry_pos", "new")
    hit = F.col("new").isNotNull()
    return (
        entries.join(hits, "entry_pos", "left")
        .withColumn("status", F.when(hit, "analysed").otherwise(F.col("status")))
        .withColumn("report", F.when(hit, F.col("new.r")).otherwise(F.col("report")))
        .withColumn("errors", F.when(hit, F.col("new.e")).otherwise(F.col("errors")))
        .drop("new")
    )
