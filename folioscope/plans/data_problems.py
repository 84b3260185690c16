"""Queries p1, p3 and p4 over the test tables, with their reference SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.times import iso_instant
from folioscope.operators import drift, profile, snapshots
from folioscope.runtime import table, written
from folioscope.schema import REPORT

#: Share of all rows, in percent, from which a site is heavy.
HEAVY_PERCENT = 4
STATUSES = ("pending", "analysed", "error")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.field_changes(table(spark, d, "report_records"))


def p1_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_versions(table(spark, d, "report_records"))


def p1_reports(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_reports(table(spark, d, "report_records"), REPORT)


def p1_steps(spark: SparkSession, d: str) -> DataFrame:
    """The migration rules of every file."""
    return drift.migrations(table(spark, d, "report_records"), REPORT)


def site_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of all sites, written once: one row per site, read again for the total."""
    made = profile.keyed_profile(
        table(spark, d, "manifest"),
        "site",
        rows="n_rows",
        distinct={"n_urls": F.col("url"), "n_contents": F.lower(F.trim("md5"))},
        labelled=(F.col("entry_id"), F.col("status"), STATUSES),
        latest=iso_instant(F.col("crawled_at")),
    )
    return written(made, "site-profile")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.heavy_keys(site_profile(spark, d), "n_rows", HEAVY_PERCENT).where("site IS NOT NULL").select("site")


def p3_sites(spark: SparkSession, d: str) -> DataFrame:
    p = site_profile(spark, d)
    total = p.agg(F.sum("n_rows")).scalar()
    return p.withColumnRenamed("latest", "latest_crawl").withColumn("is_heavy", F.col("n_rows") * 100 >= total * HEAVY_PERCENT)


def p3_pages(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "manifest").select("site", F.col("report.Pages").alias("pages"))
    q = profile.weighted_quantiles(entries, "site", "pages", [0.5, 0.9])
    return q.select("site", "n", *[F.col(c).cast("bigint").alias(a) for c, a in (("mode", "mode_pages"), ("q_50", "median_pages"), ("q_90", "p90_pages"))])


def _compared() -> dict:
    return {"md5": F.lower("md5"), "site": F.col("site")}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "manifest_snapshots"), "snapshot_id", "url", _compared())


def p4_intervals(spark: SparkSession, d: str) -> DataFrame:
    spans = snapshots.validity_intervals(table(spark, d, "manifest_snapshots"), "snapshot_id", "url", _compared())
    return spans.select("url", "md5", "site", "first_snapshot", F.coalesce("following_snapshot", F.lit(-1)).alias("gone_in"), (F.col("last_ord") - F.col("first_ord") + 1).alias("n_snapshots"))


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p1_reports, p1_steps, p3_found, p3_sites, p3_pages, p4_found, p4_intervals)}

_ONCE = """once AS (
  SELECT snapshot_id, dense_rank() OVER (ORDER BY snapshot_id) AS ord, url, min({'m': coalesce(lower(md5), '-'), 's': coalesce(site, '-')}) AS v
  FROM manifest_snapshots WHERE url IS NOT NULL AND snapshot_id IS NOT NULL GROUP BY snapshot_id, url),
ids AS (SELECT DISTINCT snapshot_id, ord, (SELECT max(ord) FROM once) AS last_ord FROM once)"""

_PAGES = """WITH p AS (SELECT site, report.Pages AS v FROM manifest WHERE report.Pages IS NOT NULL)
SELECT site, count(*) AS n, CAST((SELECT v FROM p q WHERE q.site IS NOT DISTINCT FROM p.site GROUP BY v ORDER BY count(*) DESC, v LIMIT 1) AS BIGINT) AS mode_pages,
  CAST(quantile_disc(v, 0.5) AS BIGINT) AS median_pages, CAST(quantile_disc(v, 0.9) AS BIGINT) AS p90_pages FROM p GROUP BY site"""

_LEAVES = """r AS (SELECT DISTINCT scanner, seq_no, file_id, url, md5, report_json AS j FROM report_records WHERE scanner IS NOT NULL AND seq_no IS NOT NULL AND file_id IS NOT NULL),
  files AS (SELECT DISTINCT scanner, seq_no, file_id FROM r),
  ok AS (SELECT * FROM r WHERE json_valid(j) AND json_type(j) = 'OBJECT'),
  leaves AS (SELECT ok.*, substr(t.fullkey, 3) AS path, CASE t.type WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'decimal' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'list' ELSE 'integer' END AS kind,
    CASE t.type WHEN 'VARCHAR' THEN t.value ->> '$' ELSE CAST(t.value AS VARCHAR) END AS value FROM ok, json_tree(ok.j) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND NOT contains(t.fullkey, '[')),
  kinds AS (SELECT file_id, path, list_sort(list(DISTINCT kind)) AS ks FROM leaves GROUP BY file_id, path),
  steps AS (SELECT *, lag(file_id) OVER (PARTITION BY scanner ORDER BY seq_no) AS previous FROM files),
  here AS (SELECT s.file_id, k.path, k.ks, previous FROM steps s JOIN kinds k USING (file_id) WHERE previous IS NOT NULL),
  there AS (SELECT s.file_id, k.path, k.ks, previous FROM steps s JOIN kinds k ON k.file_id = s.previous),
  added AS (SELECT file_id, path FROM here ANTI JOIN there USING (file_id, path)), removed AS (SELECT file_id, path FROM there ANTI JOIN here USING (file_id, path)),
  retyped AS (SELECT h.file_id, h.path FROM here h JOIN there t USING (file_id, path) WHERE len(list_filter(h.ks, lambda x: NOT list_contains(t.ks, x))) > 0)"""
_LAST = lambda c: f"string_split({c}, '.')[-1]"
_BARE = lambda c: f"lower(regexp_replace({_LAST(c)}, '[^A-Za-z0-9]', '', 'g'))"
_WORDS = lambda c: rf"list_sort(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace({_LAST(c)}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' '))"
_P1_FOUND = f"""WITH {_LEAVES},
  olds AS (SELECT s.file_id, l.url, l.md5, l.path, min(l.value) AS value FROM steps s JOIN leaves l ON l.file_id = s.previous JOIN removed d ON d.file_id = s.file_id AND d.path = l.path WHERE l.url IS NOT NULL GROUP BY ALL),
  news AS (SELECT l.file_id, l.url, l.md5, l.path, min(l.value) AS value FROM leaves l JOIN added a USING (file_id, path) WHERE l.url IS NOT NULL GROUP BY ALL),
  met AS (SELECT o.file_id, o.path AS was, n.path AS now, count(*) FILTER (o.value = n.value) AS same, count(*) FILTER (o.value <> n.value) AS other FROM olds o JOIN news n ON o.file_id = n.file_id AND o.url = n.url AND o.md5 IS NOT DISTINCT FROM n.md5 GROUP BY ALL),
  pairs AS (SELECT d.file_id, d.path AS was, a.path AS now, coalesce(same, 0) AS same, coalesce(other, 0) AS other, {_BARE('d.path')} AS b1, {_BARE('a.path')} AS b2, {_WORDS('d.path')} = {_WORDS('a.path')} OR {_BARE('d.path')} = {_BARE('a.path')} AS alike
    FROM removed d JOIN added a USING (file_id) LEFT JOIN met m ON m.file_id = d.file_id AND m.was = d.path AND m.now = a.path),
  backed AS (SELECT *, same + CASE WHEN alike THEN 1000 WHEN contains(b1, b2) OR contains(b2, b1) THEN 2 ELSE 0 END AS support, levenshtein(b1, b2) AS far FROM pairs WHERE other * 20 <= same AND (same >= 3 OR alike OR (same >= 1 AND (contains(b1, b2) OR contains(b2, b1))))),
  best AS (SELECT *, row_number() OVER (PARTITION BY file_id, was ORDER BY support DESC, far, was, now) AS i, row_number() OVER (PARTITION BY file_id, now ORDER BY support DESC, far, was, now) AS k FROM backed),
  renamed AS (SELECT file_id, was, now FROM best WHERE i = 1 AND k = 1)
SELECT file_id, 'renamed' AS change_kind, was AS old_field, now AS new_field FROM renamed
UNION ALL SELECT file_id, 'added', '', path FROM added ANTI JOIN renamed r ON added.file_id = r.file_id AND added.path = r.now
UNION ALL SELECT file_id, 'removed', path, '' FROM removed ANTI JOIN renamed r ON removed.file_id = r.file_id AND removed.path = r.was
UNION ALL SELECT file_id, 'retyped', path, path FROM retyped"""
_P1_VERSIONS = f"""WITH {_LEAVES}, prints AS (SELECT file_id, md5('[' || string_agg('{{"path":"' || path || '","kinds":["' || array_to_string(ks, '","') || '"]}}', ',' ORDER BY path) || ']') AS p FROM kinds GROUP BY file_id),
  v AS (SELECT s.*, coalesce(p, md5('[]')) AS fingerprint FROM steps s LEFT JOIN prints USING (file_id)), w AS (SELECT *, CASE WHEN previous IS NULL OR fingerprint <> lag(fingerprint) OVER (PARTITION BY scanner ORDER BY seq_no) THEN 1 ELSE 0 END AS starts FROM v),
  n AS (SELECT file_id, sum(a) AS a, sum(d) AS d, sum(t) AS t FROM (SELECT file_id, 1 AS a, 0 AS d, 0 AS t FROM added UNION ALL SELECT file_id, 0, 1, 0 FROM removed UNION ALL SELECT file_id, 0, 0, 1 FROM retyped) GROUP BY file_id)
SELECT scanner, seq_no, file_id, fingerprint, CAST(sum(starts) OVER (PARTITION BY scanner ORDER BY seq_no) AS BIGINT) AS version, CAST(coalesce(a, 0) AS INT) AS n_added, CAST(coalesce(d, 0) AS INT) AS n_removed, CAST(coalesce(t, 0) AS INT) AS n_retyped FROM w LEFT JOIN n USING (file_id)"""

SQL = {
    "p1_found": _P1_FOUND,
    "p1_versions": _P1_VERSIONS,
    "p3_found": "SELECT site FROM manifest WHERE site IS NOT NULL GROUP BY site HAVING count(*) * 100 >= 4 * (SELECT count(*) FROM manifest)",
    "p3_sites": """SELECT site, count(*) AS n_rows, count(DISTINCT url) AS n_urls, count(DISTINCT lower(trim(md5))) AS n_contents,
      count(DISTINCT entry_id) FILTER (status = 'pending') AS n_pending, count(DISTINCT entry_id) FILTER (status = 'analysed') AS n_analysed,
      count(DISTINCT entry_id) FILTER (status = 'error') AS n_error,
      count(DISTINCT entry_id) FILTER (status IS NULL OR status NOT IN ('pending', 'analysed', 'error')) AS n_other,
      max(CAST(CASE WHEN regexp_matches(crawled_at, '(Z|[+-][0-9:]{4,})$') AND length(crawled_at) > 19 THEN crawled_at ELSE crawled_at || '+00:00' END AS TIMESTAMPTZ)) AT TIME ZONE 'UTC' AS latest_crawl,
      count(*) * 100 >= 4 * (SELECT count(*) FROM manifest) AS is_heavy FROM manifest GROUP BY site""",
    "p3_pages": _PAGES,
    "p4_found": f"""WITH {_ONCE}, n AS (SELECT *, lag(ord) OVER w AS po, lag(v) OVER w AS pv, lead(ord) OVER w AS no FROM once WINDOW w AS (PARTITION BY url ORDER BY ord))
      SELECT snapshot_id, url, 'added' AS change_kind FROM n WHERE ord > 1 AND (po IS NULL OR po < ord - 1)
      UNION ALL SELECT snapshot_id, url, 'changed' FROM n WHERE po = ord - 1 AND pv <> v
      UNION ALL SELECT ids.snapshot_id, url, 'removed' FROM n JOIN ids ON ids.ord = n.ord + 1 WHERE n.no IS NULL OR n.no > n.ord + 1""",
    "p4_intervals": f"""WITH {_ONCE}, n AS (SELECT *, CASE WHEN lag(ord) OVER w = ord - 1 AND lag(v) OVER w = v THEN 0 ELSE 1 END AS st FROM once WINDOW w AS (PARTITION BY url ORDER BY ord)),
      i AS (SELECT *, sum(st) OVER (PARTITION BY url ORDER BY ord) AS island FROM n),
      g AS (SELECT url, island, first(v) AS v, min(snapshot_id) AS first_snapshot, max(ord) AS o, count(*) AS n_snapshots FROM i GROUP BY url, island)
      SELECT url, nullif(v.m, '-') AS md5, nullif(v.s, '-') AS site, first_snapshot, coalesce(ids.snapshot_id, -1) AS gone_in, CAST(n_snapshots AS INT) AS n_snapshots FROM g LEFT JOIN ids ON ids.ord = g.o + 1""",
}
