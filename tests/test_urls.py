import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from folioscope.functions import urls
from folioscope.functions.url_identity import file_identity
from folioscope.plans import audit
from tests.conftest import DATA


def values(spark, rows, *columns):
    n = len(rows[0])
    df = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(n)))
    return [tuple(r) for r in df.select(*[c.alias(f"r{i}") for i, c in enumerate(columns)]).collect()]


def test_parts_equal_the_standard_library(spark):
    texts = ["https://a.example/x/y.pdf;p=1?q#f", "HTTP://U@A.example:8080/", "//h/p", "mailto:x@y", "/a/b;c/d", "", "a.pdf?x", "https://h/a b/é.pdf", "x:?q"]
    c = F.col("c0")
    for text, got in zip(texts, values(spark, [(t,) for t in texts], urls.scheme(c), urls.authority(c), urls.path(c)), strict=True):
        p = urlparse(text)
        if p.scheme in ("", "http", "https"):
            assert got == (p.scheme, p.netloc, p.path), text


def test_extension_and_suffix(spark):
    rows = [(".pdf",), ("a.",), ("/a.b/c",), ("/x/y.PDF",), ("a.tar.gz",), ("..a.b",)]
    assert values(spark, rows, urls.extension(F.col("c0")), urls.suffix(F.col("c0"))) == [("", ""), (".", ""), ("", ""), (".PDF", ".PDF"), (".gz", ".gz"), (".b", ".b")]


def test_resolution_equals_the_standard_library(spark):
    base = "https://h.example/a/b/c.html?k=v"
    links = ["d.html", "./d", "../d", "../../d", "../../../d", "/r/s", "//o.example/z", "?x=1", "#top", "", "mailto:a@b", "https://z.example/", "d?x#y", ".", "..", "a/./b/../c", "g#s?x"]
    got = [r[0] for r in values(spark, [(base, link) for link in links], urls.resolve(F.col("c0"), F.col("c1")))]
    assert got == [urljoin(base, link) if link != "" else base for link in links]


def without_dots(p):
    """RFC 3986, section 5.2.4, step by step."""
    out = ""
    while p:
        if p.startswith(("../", "./")):
            p = p[p.index("/") + 1 :]
        elif p.startswith("/./") or p == "/.":
            p = "/" + p[3:]
        elif p.startswith("/../") or p == "/..":
            p, out = "/" + p[4:], out[: max(out.rfind("/"), 0)]
        elif p in (".", ".."):
            p = ""
        else:
            end = p.find("/", 1) if "/" in p[1:] else len(p)
            out, p = out + p[:end], p[end:]
    return out


def resolved(base, link):
    """RFC 3986, sections 5.2.2 and 5.3, absent parts being None."""
    split = lambda u: re.match(r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?", re.sub(r"[\t\r\n]", "", u).strip("".join(map(chr, range(33)))), re.S).group(2, 4, 5, 7, 9)
    (bs, ba, bp, bq, _), (s, a, p, q, f) = split(base), split(link)
    if s is not None or a is not None:
        s, p = bs if s is None else s, without_dots(p)
    elif p == "":
        s, a, p, q = bs, ba, bp, bq if q is None else q
    else:
        merged = "/" + p if ba is not None and bp == "" else bp[: bp.rfind("/") + 1] + p
        s, a, p = bs, ba, without_dots(p if p.startswith("/") else merged)
    return "".join(("" if s is None else s + ":", "" if a is None else "//" + a, p, "" if q is None else "?" + q, "" if f is None else "#" + f))


UNTIDY = [
    "https//h.example/a/b.pdf", " https://h.example/a/b.html\r\n", "HTTPS://WWW.H.EXAMPLE/A/.//B/", '"https://h.example/a/b/"', "https://h.example/a//b/../c/./d?x=1&y#z", "https://h.example", "https://h.example?q",
    "https://u@h.example:8080/a/b;p=1?", "https://h.example//index.html?page=x#", "//h.example/a/b", "/a/b/c", "a", "a/b", "", "mailto:a@b", "https://h.example/%2e/é b/", "https://h.example/a\u2028b/c",
]
LINKS = ["../a/./b.pdf", "/x/y.PDF?v=1", "//cdn.other.example/a/../View", "c.html#top", "?page=2", "?", "#", "", "mailto:x@y", "https://far.example/./doc.", "..", ".", "./", "../../../..//d/.", "/..", "a/b/../../../c", " d.html ", "#a?b#c"]


def test_resolution_on_untidy_pages_equals_the_rfc(spark):
    pairs = [(b, link) for b in UNTIDY for link in LINKS]
    got = [r[0] for r in values(spark, pairs, urls.resolve(F.col("c0"), F.col("c1")))]
    assert [(p, g) for p, g in zip(pairs, got, strict=True) if g != resolved(*p)] == []


def test_every_crawled_url_gets_a_target_and_an_action(spark):
    rows = audit.links(spark, DATA).select("link_id", "url", F.expr(audit._HREF).alias("href")).collect()
    got = {r["link_id"]: r["target"] for r in audit.QUERIES["resolved_links"](spark, DATA).collect()}
    assert len(got) == len(rows) and all(got[r["link_id"]] == resolved(r["url"], r["href"]) for r in rows)
    actions = audit.QUERIES["link_actions"](spark, DATA)
    assert actions.where("action IS NOT NULL").count() == len(rows)


def test_link_actions_in_order(spark):
    rows = [("ftp://x/y.pdf",), ("https://far.example/y.PDF",), ("https://s.example/doc.pdf/",), ("https://s.example/search/a",), ("https://far.example/page",), ("https://far.example/p.html",), ("https://www.s.example/p",), ("/rel",), ("https://cdn.s.example/x",)]
    got = [r[0] for r in values(spark, rows, urls.link_action(F.col("c0"), F.lit("s.example")))]
    assert got == ["drop", "download", "download", "skip_search", "probe", "skip_offsite", "follow", "follow", "follow"]


def test_names_and_domains(spark):
    rows = [("https://h/a/b.pdf?x",), ("https://h/a/b",), ("https://h/",)]
    got = [r[0] for r in values(spark, rows, urls.save_name(F.col("c0")))]
    assert got[:2] == ["b.pdf", "b.pdf"] and got[2].startswith("doc-") and len(got[2]) == 16
    rows = [("https://cdn.s.example/x", "s.example"), ("https://o.example/x", "www.s.example"), ("https://www.s.example/x", "s.example"), ("", "s"), (None, None)]
    assert [r[0] for r in values(spark, rows, urls.external_domain(F.col("c0"), F.col("c1")))] == ["", "o.example", "", "", ""]


def test_seeds(spark):
    rows = [("https://WWW.A.example/Path",), ("//a.example/x",), ("a..b",), ("just words",), ("https://10.0.0.1/",)]
    got = values(spark, rows, urls.normalized(F.col("c0")), urls.is_submittable(F.col("c0")))
    assert got == [("https://www.a.example/Path", True), ("https://a.example/x", False), ("https://a..b", False), ("https://just words", False), ("https://10.0.0.1/", False)]
    answers = F.array(F.lit("http://www.a.example/x"), F.lit("http://a.example/x"), F.lit("https://just words"))
    assert [r[0] for r in values(spark, rows, urls.normalized(F.col("c0"), answers))] == ["https://www.a.example/Path", "http://a.example/x", "https://a..b", "https://just words", "https://10.0.0.1/"]


def test_anchors(spark):
    page = """<A class=x href="/a">1</a><a href='b.pdf'>2</a> <a name=n>3</a><a href=c>4</a><abbr href="no">"""
    assert values(spark, [(page,)], urls.hrefs(F.col("c0")))[0][0] == ["/a", "b.pdf", "c"]


SAME = [
    "https://www.h.example/files/a%20b.pdf?v=1&file=x",
    "http://h.example:80/files//a b.pdf?file=x&v=1#top",
    " HTTPS://H.EXAMPLE:443/old/../%66iles/./a%20b.pdf;jsessionid=AB12?utm_source=m&v=1&file=x&fbclid=1\n",
    "//h.example./files/a%20b.pdf?v=1&&file=x&PHPSESSID=1",
]
OTHER = ["https://h.example/files/a%20b.pdf?v=2&file=x", "https://h.example/Files/a%20b.pdf?v=1&file=x", "https://h.example:8080/files/a%20b.pdf?v=1&file=x", "https://cdn.h.example/files/a%20b.pdf?v=1&file=x", "https://h.example/files%2Fa%20b.pdf?v=1&file=x", "https://h.example/files/a%20b.pdf?v=1&file=x&attachment=2"]


def test_file_identity():
    assert len({file_identity(u) for u in SAME}) == 1
    assert len({file_identity(u) for u in [SAME[0], *OTHER]}) == 1 + len(OTHER)
    assert file_identity(None) is None and file_identity(" \n") is None
    assert file_identity("%zz%4") == file_identity("%25zz%254")
    assert file_identity("x" * 100_000) is not None


@pytest.mark.parametrize("odd", ["https://", "://", "?", "#", "h.example:443", "https://[::1]/a", "é/\udcff", "https://h/%", "a:b:c"])
def test_odd_urls_do_not_fail(odd):
    file_identity(odd)


def test_dates(spark):
    from folioscope.functions import times

    rows = [(t,) for t in ("D:20200102030405+1'0'", "D:20200102030405+01", "D:20200102030405+01'30'", "D:20200102030405+'x'", "D:20200102030405-05'00'", "D:2020", "CPY Document 1", "", "2020-01-02T03:04:05+0130", "Thu, 2 Jan 2020 03:04:05 +0100", "Jan 2, 2020", "soon", None)]
    at = times.pdf_date(F.col("c0"))
    got = values(spark, rows, times.at_offset(at, times.offset_minutes(F.col("c0"))))
    assert [r[0] for r in got] == ["2020-01-02 03:04:05+01:00", "2020-01-02 03:04:05+01:00", "2020-01-02 03:04:05+01:30", None, "2020-01-02 03:04:05-05:00", "2020-01-01 00:00:00+00:00", None, None, "2020-01-02 03:04:05+01:30", "2020-01-02 03:04:05+01:00", "2020-01-02 00:00:00+00:00", None, None]
    ages = values(spark, [("2024-01-31T18:00:00Z",), ("2024-01-30T00:00:00",), ("never",)], times.age_text(times.iso_instant(F.col("c0")), F.to_timestamp(F.lit("2024-02-01 00:00:00")), F.col("c0")))
    assert [r[0] for r in ages] == ["0.2", "2", "never"]
