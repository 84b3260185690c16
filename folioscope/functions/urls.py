"""URL, path and file name expressions. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 3986 appendix B: scheme, authority, path, query, fragment.
SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Fixed value: start of a bare domain with an optional path, as accepted for scan requests.
BARE_DOMAIN = r"^[a-zA-Z0-9][a-zA-Z0-9.\-_/]*\.[a-zA-Z]{2,}"
#: Fixed value: hosts that name the machine itself or a private network.
PRIVATE_HOST = r"^(localhost|::1|\[::1\]|127\.0\.0\.1|10\..*|172\.(1[6-9]|2[0-9]|3[01])\..*|192\.168\..*|169\.254\..*)$"
DOWNLOADS = (".pdf",)


def _clean(url: Column) -> Column:
    return F.regexp_replace(url, r"[\t\r\n]", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(_clean(url), SPLIT, 1))


def authority(url: Column) -> Column:
    """Host with any user and port, as written."""
    return F.regexp_extract(_clean(url), SPLIT, 2)


def path(url: Column) -> Column:
    """Path without query, fragment and the parameters of its last segment."""
    return F.regexp_replace(F.regexp_extract(_clean(url), SPLIT, 3), ";[^/]*$", "")


def extension(p: Column) -> Column:
    """Last dot of the final segment and what follows; leading dots make no extension."""
    return F.regexp_extract(p, r"[^/.][^/]*?(\.[^./]*)$", 1)


def suffix(name: Column) -> Column:
    """Like :func:`extension`, but a final dot is none."""
    e = extension(name)
    return F.when(e == ".", "").otherwise(e)


def site_key(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www[.]", "")


def is_pdf_url(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_download(url: Column) -> Column:
    """The path, without final slashes, has a download extension."""
    return extension(F.lower(F.regexp_replace(path(url), "/+$", ""))).isin(*DOWNLOADS)


def in_domain(host: Column, domain: Column) -> Column:
    """``host`` is ``domain`` or one of its subdomains; an empty host is relative and belongs to it."""
    h = F.lower(host)
    return (h == "") | (h == domain) | h.endswith(F.concat(F.lit("."), domain))


def link_action(url: Column, domain: Column) -> Column:
    """What a crawler does with a link: drop, download, skip_search, probe, skip_offsite or follow; the first rule that fits."""
    p = F.lower(path(url))
    outside = ~in_domain(site_key(authority(url)), domain)
    bare = extension(F.regexp_replace(p, "/+$", "")) == ""
    return (
        F.when(~scheme(url).isin("", "http", "https"), "drop")
        .when(is_download(url), "download")
        .when(p.contains("recherche") | p.contains("search"), "skip_search")
        .when(outside & bare, "probe")
        .when(outside, "skip_offsite")
        .otherwise("follow")
    )


def _without_dots(p: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved (RFC 3986, section 5.2.4), relative paths included."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)
    root = F.array(F.lit(""))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).when(F.size(acc) == 1, root).otherwise(acc)).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    return F.when(last.isin(".", "..") & (F.size(kept) > 0), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column, link: Column) -> Column:
    """``link`` as seen from the page ``base`` (RFC 3986, section 5.2), both without outer blanks.

    Parts that are absent stay absent: a base without scheme or host gives a target without.
    """
    b, r = (F.regexp_replace(_clean(u), r"^[\x00-\x20]+|[\x00-\x20]+$", "") for u in (base, link))
    scheme_of = lambda u: F.regexp_extract(u, "^([^:/?#]+:)", 1)
    host_of = lambda u: F.regexp_extract(u, "^(?:[^:/?#]+:)?(//[^/?#]*)", 1)
    path_of = lambda u: F.regexp_extract(u, SPLIT, 3)
    query_of = lambda u: F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    absolute, hosted, p = scheme_of(r) != "", host_of(r) != "", path_of(r)
    folder = F.when((host_of(b) != "") & (path_of(b) == ""), "/").otherwise(F.regexp_extract(path_of(b), "(?s)^(.*/)", 1))
    own = absolute | hosted
    same = ~own & (p == "")
    return F.concat(
        F.when(absolute, scheme_of(r)).otherwise(scheme_of(b)),
        F.when(own, host_of(r)).otherwise(host_of(b)),
        F.when(same, path_of(b)).otherwise(_without_dots(F.when(own | p.startswith("/"), p).otherwise(F.concat(folder, p)))),
        F.when(same & (query_of(r) == ""), query_of(b)).otherwise(query_of(r)),
        F.regexp_extract(r, "(?s)^[^#]*(#.*)", 1),
    )


def save_name(url: Column) -> Column:
    """File name a download is kept under: last segment, else a name from the URL's hash; ``.pdf`` if it has no extension."""
    last = F.try_element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), F.lit(-1))
    name = F.coalesce(last, F.concat(F.lit("doc-"), F.substring(F.md5(url), 1, 8)))
    return F.when(extension(name) == "", F.concat(name, F.lit(".pdf"))).otherwise(name)


def external_domain(url: Column, site: Column) -> Column:
    """Host of a file that lies outside its site, else empty."""
    host, own = site_key(authority(url)), site_key(site)
    outside = (F.coalesce(url, F.lit("")) != "") & (F.coalesce(site, F.lit("")) != "") & (host != "") & (host != own) & ~host.endswith(F.concat(F.lit("."), own))
    return F.when(outside, host).otherwise("")


def is_bare_domain(text: Column) -> Column:
    t = F.regexp_replace(text, "^/+", "")
    return t.rlike(BARE_DOMAIN) & ~t.contains("..") & ~t.startswith(".")


#: Beginnings that are tried for a bare domain, in order.
PREFIXES = ("https://", "https://www.", "http://", "http://www.")


def normalized(text: Column, reachable: Column | None = None) -> Column:
    """Seed URL: with a scheme, the host in lower case; else the first of ``PREFIXES`` with which a domain is ``reachable``.

    ``reachable``: the URLs known to answer, an array. Where none does, or the text has not the shape of a domain, it is
    ``https://`` and the text without its leading slashes.
    """
    with_scheme = F.concat(F.regexp_extract(text, "^(https?://)", 1), F.lower(F.regexp_extract(text, "^https?://([^/?#]*)", 1)), F.regexp_extract(text, r"(?s)^https?://[^/?#]*(.*)\z", 1))
    bare = F.regexp_replace(text, "^/+", "")
    fallback = F.concat(F.lit("https://"), bare)
    if reachable is not None:
        candidates = F.array(*[F.concat(F.lit(p), bare) for p in PREFIXES])
        found = F.try_element_at(F.filter(candidates, lambda c: F.array_contains(reachable, c)), F.lit(1))
        fallback = F.when(is_bare_domain(text), F.coalesce(found, fallback)).otherwise(fallback)
    return F.when(text.rlike("^https?://"), with_scheme).otherwise(fallback)


def is_submittable(url: Column) -> Column:
    """A public http(s) page: no local or private host, and no PDF itself."""
    host = F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))
    return F.coalesce(scheme(url).isin("http", "https") & (host != "") & ~host.rlike(PRIVATE_HOST) & ~is_pdf_url(url), F.lit(False))


def hrefs(html: Column) -> Column:
    """Targets of the anchors of a page, in order; double, single and unquoted attributes."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"), F.lit(1))
    return F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(t, "^[\"']|[\"']$", ""), r"^\s+|\s+$", ""))
