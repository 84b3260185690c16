"""Records that differ only in formatting: one canonical form, a 128-bit key, counts.

Canonical form of a link: percent-encoded whitespace, whitespace and punctuation go, letters become
lower case, query parameters are put in order; letters (with their marks) and digits stay. Null,
blank and merely punctuated texts are all the empty text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import written

#: Percent-encoded UTF-8 of the white space characters.
ESCAPED_SPACE = "(?i)%(?:20|09|0[a-d]|C2%A0|C2%85|E1%9A%80|E2%80%8[0-9a-f]|E2%80%A[89f]|E2%81%9F|E3%80%80)"
NO_LETTER_OR_DIGIT = r"[^\p{L}\p{M}\p{N}]+"

#: Groups with at least so many copies are matched by broadcast, the largest of them first, up to so many groups. Any other
#: group has fewer copies, or no more than one row in ``HOT_GROUPS`` of the table.
HOT, HOT_GROUPS = 100_000, 100_000


def bare(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, ESCAPED_SPACE, ""), NO_LETTER_OR_DIGIT, ""))


def canonical_link(url: Column) -> Column:
    """Letters and digits of ``url`` in lower case, with the query parameters in order.

    A ``#`` is punctuation like any other: behind the ``?`` it ends a parameter, as ``&`` does, whether or not parameters follow it.
    """
    text = F.coalesce(url, F.lit(""))
    base = F.substring_index(text, "?", 1)
    params = F.array_sort(F.transform(F.split(F.substr(text, F.length(base) + 2), "[&#]"), bare))
    return F.concat(bare(base), F.array_join(params, ""))


def _keyed(df: DataFrame, ident: str, exact: Sequence[str], links: Sequence[str]) -> DataFrame:
    record = F.to_json(F.struct(*[F.col(c).alias(f"e{i}") for i, c in enumerate(exact)], *[canonical_link(F.col(c)).alias(f"l{i}") for i, c in enumerate(links)]))
    return df.select(F.col(ident).alias("id"), record.alias("record")).select("id", F.unhex(F.md5("record")).alias("h"), F.xxhash64("record").alias("check"))


def _resolved(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``(h, first, n)`` and the keyed rows they belong to, free of hash collisions."""
    groups = written(keyed.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi")), "records")
    if groups.where("lo <> hi").isEmpty():
        return groups, keyed
    # Two different records share a key: a longer key, of both hashes, parts them.
    longer = keyed.withColumn("h", F.concat("h", F.unhex(F.hex("check"))))
    return written(longer.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "records"), longer


def distinct_records(df: DataFrame, ident: str, exact: Sequence[str], links: Sequence[str]) -> DataFrame:
    """One row per record: ``first`` (smallest id) and ``n`` (how many rows wrote it).

    Rows are one record if the ``exact`` columns are equal (null equals null) and the ``links`` have
    the same canonical form. Counts are combined before the shuffle, so a record with a third of
    all rows is no burden. Every group also compares a second, independent hash of its rows; if two
    records ever share the 128-bit key, the groups are rebuilt on both hashes. Rows with a null id count
    as copies; a record with no id at all has ``first`` null. An empty table gives no rows.
    """
    return _resolved(_keyed(df, ident, exact, links))[0].select("first", "n")


def copies(df: DataFrame, ident: str, exact: Sequence[str], links: Sequence[str]) -> DataFrame:
    """``(first, copy)``: every row that writes a record again, with the smallest id of the record.

    Rows get their record in one shuffle. Records with ``HOT`` copies or more come by broadcast
    instead, ``HOT_GROUPS`` at most (4 MB), and their rows are spread over all tasks; a group beyond that number is no
    larger than a hundred-thousandth of the rows and takes the shuffle. Rows with a null id cannot be named and
    are left out here.
    """
    keyed = written(_keyed(df, ident, exact, links), "keyed-rows")
    groups, keyed = _resolved(keyed)
    repeated = groups.where("n > 1").select("h", "first", "n")
    hot = written(repeated.where(F.col("n") >= HOT).orderBy(F.col("n").desc(), "h").limit(HOT_GROUPS).select("h", F.col("first").alias("hot_first")), "hot-records")
    rest = repeated.join(F.broadcast(hot.select("h")), "h", "left_anti").select(F.col("h").alias("at"), "first")
    spread = keyed.join(F.broadcast(hot), "h", "left").withColumn("at", F.when(F.col("hot_first").isNull(), F.col("h")).otherwise(F.unhex(F.md5(F.col("id").cast("string")))))
    found = spread.join(rest, "at", "left").select(F.coalesce("hot_first", "first").alias("first"), F.col("id").alias("copy"))
    return found.where(F.col("first") != F.col("copy"))
