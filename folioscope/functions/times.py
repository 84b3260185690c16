"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_instant(text: Column) -> Column:
    """Instant of an ISO-8601 text; without an offset it is UTC, unreadable text is null."""
    trimmed = F.trim(text)
    has_offset = trimmed.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    whole_day = trimmed.rlike(r"^\d{4}-\d{2}-\d{2}$")
    full = F.when(has_offset, trimmed).when(whole_day, F.concat(trimmed, F.lit("T00:00:00Z"))).otherwise(F.concat(trimmed, F.lit("Z")))
    return F.try_to_timestamp(full)


#: Fixed value: from here on a document is not exempt, midnight of 23 September 2018 at +02:00.
DEADLINE = "2018-09-22T22:00:00Z"
#: Parts of a PDF date, its offset in plain or quoted form.
_PDF_DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?\s*(?:([Z+-])(\d{2})?'?(\d{2})?'?)?$"


def _repaired(text: Column) -> Column:
    """A PDF date with its offset to the east in plain form: ``+1'0'`` becomes ``+0100``, ``+01`` too, one that cannot be read ``+0000``."""
    t = F.trim(text)
    tail = F.regexp_extract(t, r"(\+[\d':\s]+)$", 1)
    quoted = r"\+\s?(\d+)'\s?(\d+)'?"
    two = lambda i: F.lpad(F.regexp_extract(tail, quoted, i), 2, "0")
    offset = F.when(tail.contains("'"), F.when(tail.rlike(quoted), F.concat(F.lit("+"), two(1), two(2))).otherwise("+0000")).when(F.length(tail) == 3, F.concat(tail, F.lit("00"))).otherwise(tail)
    return F.when(tail == "", t).otherwise(F.concat(t.substr(F.lit(1), F.length(t) - F.length(tail)), offset))


def pdf_date(text: Column) -> Column:
    """Instant of a PDF date ``D:YYYYMMDDHHmmSS`` with offset ``Z``, ``+hh``, ``+hhmm`` or ``+hh'mm'``.

    Missing parts are the first of their kind, a missing or unreadable offset is UTC; an empty text
    and a placeholder that begins with ``CPY Document`` are null; ISO-8601 and the forms of :func:`any_date` are read as well.
    """
    t = _repaired(text)
    part = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(t, _PDF_DATE, i), F.lit("")), F.lit(default))
    sign = F.when(F.regexp_extract(t, _PDF_DATE, 7) == "-", "-").otherwise("+")
    iso = F.concat(part(1, "0"), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit("T"), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), sign, part(8, "00"), F.lit(":"), part(9, "00"))
    return F.when(t.isNull() | (t == "") | t.startswith("CPY Document"), F.lit(None).cast("timestamp")).when(t.rlike(_PDF_DATE), F.try_to_timestamp(iso)).otherwise(any_date(text))


#: Other spellings of dates that are read, after ISO-8601; without an offset they are UTC.
OTHER_FORMS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d HH:mm:ss yyyy", "M/d/yyyy h:mm:ss a", "M/d/yyyy", "yyyy/M/d", "d.M.yyyy")


def any_date(text: Column) -> Column:
    """Instant of a date in ISO-8601 or one of ``OTHER_FORMS``, with or without a weekday before it; null for anything else. Free text is not understood."""
    t = F.trim(text)
    undated = F.regexp_replace(t, r"^(?i)(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    return F.coalesce(iso_instant(t), *[F.try_to_timestamp(undated, F.lit(f)) for f in OTHER_FORMS])


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC that a date's text names; 0 if none."""
    t = _repaired(text)
    shape = r"(?:\d{2}:\d{2}\S*?|\d{8,14})\s*([+-])(\d{2})'?:?(\d{2})?'?$"
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, shape, i), F.lit("")), F.lit("0")).cast("int")
    minutes = number(2) * 60 + number(3)
    return F.when(F.regexp_extract(t, shape, 1) == "-", -minutes).otherwise(minutes)


def at_offset(at: Column, minutes: Column) -> Column:
    """An instant as ``yyyy-mm-dd hh:mm:ss+hh:mm`` at an offset from UTC, its own local time."""
    local = F.timestamp_micros(F.unix_micros(at) + minutes.cast("bigint") * 60_000_000)
    size = F.abs(minutes)
    return F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((size % 60).cast("string"), 2, "0"))


def age_days(at: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(86_400_000_000)


def age_text(at: Column, now: Column, raw: Column) -> Column:
    """Whole days, tenths of the first day (half to even), or the raw text if unreadable."""
    days = age_days(at, now)
    return F.when(at.isNull(), raw).when(days < 1, F.format_string("%.1f", F.bround(days.cast("decimal(20,6)"), 1).cast("double"))).otherwise(F.floor(days).cast("string"))


def is_exempt(at: Column, has_fields: Column) -> Column:
    """Dated before the deadline and without form fields; null when neither is known."""
    return F.when(F.coalesce(has_fields, F.lit(False)), False).when(at < F.to_timestamp(F.lit(DEADLINE)), True)
