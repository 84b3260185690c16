"""Accessibility verdicts as expressions over a document's facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.times import is_exempt


def _pass(test: Column) -> Column:
    return F.when(test, "Pass").otherwise("Fail")


def permission_test(encrypted: Column, p: Column, allow: Column) -> Column:
    """Whether assistive technology may extract text, from the permission bits 10 and 5 and the reader's own verdict."""
    bit10, bit5 = p.bitwiseAND(512) != 0, p.bitwiseAND(16) != 0
    return F.when(~encrypted, "Pass").when(p.isNull() | allow.isNull(), "Fail").when(~bit10 & bit5, "Pass").otherwise(_pass(allow))


#: How the log names what kept a file from being read, by kind of error.
ERRORS = {"password": "Password protected: ", "pdf": "PdfError: ", "value": "ValueError: "}


def judged(facts: DataFrame) -> DataFrame:
    """``facts`` with the six tests, the overall verdicts and the log of reasons.

    A fact that is null counts as absent. Documents that could not be read are broken: they have no verdict of
    accessibility, and of the tests only those whose facts were found before the error. Without XMP metadata neither
    date nor title are tested. The title counts as it stands, blanks included.

    Fixed values: the phrases of the log.
    """
    c = F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    broken = c("open_error").isNotNull()
    found = lambda name: ~broken | c(name).isNotNull()
    unless = lambda known, ok, text: F.when(known & ~ok, text).otherwise("")
    has_title = F.coalesce("title", F.lit("")) != ""
    title_ok = has_title & yes("has_viewer_prefs") & yes("display_doc_title")
    title_tested = yes("has_xmp") & found("has_viewer_prefs")
    tagged_ok = yes("has_struct_tree") & yes("has_mark_info") & yes("marked")
    has_lang = F.coalesce(c("lang"), F.lit("")) != ""
    bits = yes("encrypted") & c("p").isNotNull() & c("allow_accessibility").isNotNull() & (c("p").bitwiseAND(512) == 0) & (c("p").bitwiseAND(16) != 0)
    has_fields = F.coalesce(c("n_fields"), F.lit(0)) > 0
    bookmarks_ok = ~((F.coalesce(c("n_outline_roots"), F.lit(0)) == 0) & (F.coalesce(c("n_pages"), F.lit(0)) > 20))
    fonts_ok = (F.size(F.coalesce("font_names", F.array().cast("array<string>"))) > 0) & (F.coalesce(c("num_tf"), F.lit(0)) > 0)
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ERRORS.items() for x in kv]), c("error_kind")), F.lit(""))
    tests = facts.select(
        "*",
        F.when(title_tested, _pass(title_ok)).alias("TitleTest"),
        F.when(found("has_struct_tree"), _pass(tagged_ok)).alias("TaggedTest"),
        F.when(found("encrypted"), permission_test(yes("encrypted"), c("p"), c("allow_accessibility"))).alias("ProtectedTest"),
        F.when(found("lang"), _pass(has_lang & yes("lang_valid"))).alias("LanguageTest"),
        F.when(found("n_outline_roots"), _pass(bookmarks_ok)).alias("BookmarksTest"),
        F.when(found("num_tf"), _pass(fonts_ok)).alias("EmptyTextTest"),
        has_fields.alias("Form"),
        F.when(yes("has_xmp") | has_fields, is_exempt(c("doc_date"), has_fields)).alias("Exempt"),
        broken.alias("BrokenFile"),
        F.concat(
            unless(found("has_xmp"), yes("has_xmp"), "xmp "),
            unless(yes("has_xmp"), c("doc_date").isNotNull(), "no date found, "),
            unless(title_tested, title_ok, "title, "),
            unless(found("has_struct_tree"), tagged_ok, "tagged, "),
            F.when(bits, F.concat(F.lit("P[10]=False P[5]=True R="), F.coalesce(c("revision").cast("string"), F.lit("None")), F.lit(", "))).otherwise(""),
            F.when(has_lang & ~yes("lang_valid"), F.concat(F.lit("Default language is not valid: "), c("lang"), F.lit(", "))).when(found("lang") & ~has_lang, "lang, ").otherwise(""),
            F.when(yes("xfa_required"), "xfa, ").otherwise(""),
            unless(found("n_outline_roots"), bookmarks_ok, "no bookmarks and more than 20 pages, "),
            F.when(broken, F.concat(kind, c("open_error"))).otherwise(""),
        ).alias("log"),
    )
    fails = lambda t: F.coalesce(c(t) == "Fail", F.lit(False))
    failing = ~yes("has_xmp") | fails("TitleTest") | fails("TaggedTest") | fails("ProtectedTest") | fails("LanguageTest") | fails("BookmarksTest")
    shut = (fails("TaggedTest") & fails("EmptyTextTest")) | fails("ProtectedTest")
    return tests.withColumn("Accessible", F.when(c("BrokenFile"), F.lit(None)).otherwise(~failing)).withColumn("TotallyInaccessible", shut)
