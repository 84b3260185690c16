"""Text expressions for reports: counts, escapes, verdict marks, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run without Unicode white space, spelled out because engines differ on ``\S``.
WORD = r"[^ \t\n\x0B\f\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
NONE = "—"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for an empty one, null for null."""
    return F.regexp_count(text, F.lit(WORD))


def verdict(value: Column) -> Column:
    """A stored verdict as text: pass, fail, a dash for null, anything else as it is."""
    s = value.cast("string")
    return F.when(s.isNull(), NONE).when(s.isin("true", "Pass"), "✅ Pass").when(s.isin("false", "Fail"), "❌ Fail").otherwise(s)


def icon(value: Column) -> Column:
    s = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(s.isin("true", "Pass"), "✅").when(s.isin("false", "Fail"), "❌").otherwise(NONE)


def joined_errors(errors: Column) -> Column:
    """Non-empty errors joined by ``; ``."""
    return F.array_join(F.filter(F.coalesce(errors, F.array().cast("array<string>")), lambda e: e != ""), "; ")


def html_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).otherwise(many)


def safe_name(text: Column) -> Column:
    """Part of a file name: other characters become ``_``, no double dots, no dot at either end."""
    return F.regexp_replace(F.replace(F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "_"), F.lit(".."), F.lit("_")), r"^\.+|\.+$", "")


def archive_name(at: Column, site: Column) -> Column:
    """``<UTC time>-<milliseconds>_<site>.html``; the session time zone must be UTC."""
    return F.concat(F.date_format(at, "yyyy-MM-dd_HH-mm-ss-SSS"), F.lit("_"), safe_name(site), F.lit(".html"))


def issue_number(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"/issues/(\d+)", 1)


def percent_encoded(text: Column) -> Column:
    """Percent-encoded as browsers encode a component: letters, digits and ``-_.!~*'()`` stay."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def is_language_tag(tag: Column, languages: list[str]) -> Column:
    """Well-formed BCP 47 tag whose primary language is one of ``languages``."""
    shape = r"(?i)^[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?(-([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(-[a-wyz](-[a-z0-9]{2,8})+)*(-x(-[a-z0-9]{1,8})+)?$"
    return tag.rlike(shape) & F.lower(F.substring_index(tag, "-", 1)).isin(*languages)


def scan_request(url: Column, notes: Column, max_pages: Column, closing: str) -> Column:
    """Query part of a scan request: percent-encoded title and body, with notes only if there are any and the page cap only if it is positive.

    Fixed values: the phrases before ``closing``.
    """
    noted = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("**Notes:** "), notes, F.lit("\n\n"))).otherwise("")
    capped = F.when(max_pages > 0, F.concat(F.lit("Number: "), max_pages.cast("string"), F.lit("\n\n"))).otherwise("")
    body = F.concat(F.lit("## Scan Request\n\n**URL:** "), url, F.lit("\n\n"), noted, capped, F.lit(closing))
    return F.concat(F.lit("?title="), percent_encoded(F.concat(F.lit("SCAN: "), url)), F.lit("&body="), percent_encoded(body))
