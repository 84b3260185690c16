import json
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.operators import manifest
from folioscope.sources import files, sinks
from folioscope.sources.pdf_facts import pdf_facts, read_facts
from folioscope.sources.yaml_manifest import read_manifest, write_manifest


def test_crawl_state(spark, tmp_path):
    (tmp_path / "_url_map.json").write_text(json.dumps({"b.pdf": "https://h/b.pdf", "a": "https://h/a"}))
    (tmp_path / "_referer_map.json").write_text(json.dumps({"b.pdf": "https://h/"}))
    (tmp_path / "_crawled_pages.json").write_text(json.dumps(["https://h/", "https://h/x", "https://h/"]))
    (tmp_path / "bad.json").write_text("{nope")
    names = files.name_map(spark, f"{tmp_path}/_url_map.json", "url")
    inventory = files.link_inventory(files.crawled_pages(spark, f"{tmp_path}/_crawled_pages.json"), names, files.name_map(spark, f"{tmp_path}/_referer_map.json", "referer"))
    assert [tuple(r)[3:] for r in inventory.orderBy("part", "at", "seq").collect()] == [("https://h/", "page", ""), ("https://h/x", "page", ""), ("https://h/", "page", ""), ("https://h/a", "file", ""), ("https://h/b.pdf", "pdf", "https://h/")]
    assert files.name_map(spark, f"{tmp_path}/bad.json", "url").count() == 0
    assert files.name_map(spark, f"{tmp_path}/missing.json", "url").count() == 0
    state = sinks.crawl_state(names.withColumn("referer", F.lit(None).cast("string"))).first()
    assert json.loads(state["url_map"]) == {"a": "https://h/a", "b.pdf": "https://h/b.pdf"}


def test_downloads(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", "c.txt"):
        (tmp_path / name).write_bytes(b"%PDF-1.4 " + name.encode())
    got = files.with_urls(files.downloads(spark, str(tmp_path), "h.example"), spark.createDataFrame([("a.pdf", "https://h.example/x/a.pdf"), ("B.PDF", "")], "filename string, url string"))
    assert {(r["filename"], r["url"]) for r in got.collect()} == {("a.pdf", "https://h.example/x/a.pdf"), ("B.PDF", "https://h.example/B.PDF")}


def test_log_tail(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(f"line {i}" for i in range(80)))
    assert [r["line"] for r in files.log_tail(spark, f"{tmp_path}/log", 3).collect()] == ["line 77", "line 78", "line 79"]
    (tmp_path / "bad").write_text("x\ny ERROR 1\nz\nw CRITICAL 2\n")
    assert [r["line"] for r in files.log_tail(spark, f"{tmp_path}/bad").collect()] == ["y ERROR 1", "w CRITICAL 2"]


def test_history_and_validator(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps([{"date": "d", "site": "s", "total": 3}]))
    (tmp_path / "no.json").write_text('{"a": 1}')
    assert files.history_index(spark, f"{tmp_path}/index.json").first()["total"] == 3
    assert files.history_index(spark, f"{tmp_path}/no.json").count() <= 1
    rule = lambda **a: "<rule " + " ".join(f'{k}="{v}"' for k, v in a.items()) + "/>"
    rules = rule(clause="7.1", status="FAILED") + rule(clause="7.2", testNumber="4", status="FAILED") + rule(clause="9", testNumber="1", status="failed") + rule(clause="8", testNumber="1", status="PASSED") + rule(testNumber="6", status="FAILED") + rule(status="FAILED")
    xml = f'<?xml version="1.0"?><report xmlns="u"><jobs><job><validationReport profileName="PDF/UA-1" isCompliant="false"><details passedRules="5" failedRules="2" passedChecks="900" failedChecks="17">{rules}</details></validationReport></job></jobs></report>'
    texts = {1: xml, 2: "nothing", 3: None, 4: "<r><exceptionMessage>broken xref</exceptionMessage></r>", 5: " ", 6: "<r/>", 7: '<r><validationReport isCompliant="maybe"/></r>'}
    df = spark.createDataFrame(list(texts.items()), "i int, xml string")
    got = {r["i"]: r["validator"] for r in files.validator_summary(df).collect()}
    assert (got[1]["compliant"], got[1]["profile"], got[1]["failed_checks"], got[1]["passed_checks"], got[1]["failed_rules"], got[1]["error"]) == (False, "PDF/UA-1", 17, 900, ["7.1", "7.2-4", "6"], None)
    assert got[3] is None and got[4]["error"] == "broken xref" and "parse error" in got[2]["error"] and "no output" in got[5]["error"] and "No validationReport" in got[6]["error"]
    assert tuple(got[7]) == (None, None, None, None, [], None)


def test_yaml_round_trip(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("- url: https://h/é.pdf\n  md5: aa\n  status: analysed\n  errors: []\n  report: {Pages: 3, Accessible: true}\n- url: u2\n  crawled_at: 2024-01-01\n  unknown: 1\n", "utf-8")
    first = read_manifest(spark, str(tmp_path / "m.yaml"))
    assert [(r["entry_pos"], r["url"]) for r in first.orderBy("entry_pos").collect()] == [(0, "https://h/é.pdf"), (1, "u2")]
    write_manifest(first, str(tmp_path / "deep/n.yaml"))
    again = read_manifest(spark, str(tmp_path / "deep/n.yaml"))
    assert again.orderBy("entry_pos").collect() == first.orderBy("entry_pos").collect()
    (tmp_path / "odd.yaml").write_text("a: 1\n")
    assert read_manifest(spark, str(tmp_path / "odd.yaml")).count() == 0
    assert read_manifest(spark, str(tmp_path / "none.yaml")).count() == 0


def test_rendered_reports(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "m.yaml").write_text("- {url: 'https://h/a.pdf', filename: a.pdf, site: h, status: analysed, errors: ['', boom], report: {Accessible: false, TitleTest: Fail, Pages: 2}}\n- {url: u2, site: h, status: pending}\n")
    entries = read_manifest(spark, str(tmp_path / "m.yaml"))
    lines = list(sinks.markdown_lines(entries, 0, "now"))
    text = "\n".join(lines)
    assert "| Total files tracked | 2 |" in text and "URLs crawled" not in text and "- boom" in lines and "### a.pdf" in lines
    row = next(x for x in lines if x.startswith("| [a.pdf]"))
    assert row == "| [a.pdf](https://h/a.pdf) | h | — | ❌ Fail | — | — | — | ❌ Fail | — | — | — | 2 | — | — |" and row.count("|") == sinks.reports.FILE_HEAD.count("|") == 15
    comment = sinks.issue_comment(entries, "https://h/", "https://p", "https://run", 3, "x.html")
    for part in ("for `https://h/`.", "| 🌐 URLs crawled | 3 |", "| Total PDFs found | 2 |", "| ❌ Issues found | 1 |", "| ⏳ Pending analysis | 1 |", "| [a.pdf](https://h/a.pdf) | ❌ | — | ❌ | — | — | 2 | — | — |", "- [Site-specific HTML report](https://p/reports/x.html)", "- [View workflow run](https://run)"):
        assert part in comment, part
    assert "Errors" not in comment and "more PDFs" not in comment and "No PDFs" not in comment
    none = entries.limit(0)
    assert "no pages could be visited" in sinks.issue_comment(none, run_url="https://run") and "after visiting 1 page." in sinks.issue_comment(none, pages=1) and "visiting 2 pages." in sinks.issue_comment(none, pages=2)
    assert "- [HTML report](/report.html)" in sinks.issue_comment(none) and "_No analysed files yet._" in list(sinks.markdown_lines(none, 0, "now"))
    name = sinks.archive(spark, entries, "h", "2024-01-02 03:04:05.678", str(tmp_path / "arc"))
    assert name == "2024-01-02_03-04-05-678_h.html" and (tmp_path / "arc" / name).exists()
    assert "</script><" not in sinks.html_page("t", '{"a":"</script><b>"}').replace("</script></body>", "")
    sinks.write_report_json(entries, str(tmp_path / "r.json"), 7, "now")
    report = json.loads((tmp_path / "r.json").read_text("utf-8"))
    assert report["summary"]["total_files"] == 2 and report["summary"]["pages_crawled"] == 7 and report["summary"]["sites"] == {"h": 2}
    assert [f["url"] for f in report["files"]] == ["https://h/a.pdf", "u2"] and "notes" not in report["files"][0] and report["files"][0]["report"]["Pages"] == 2
    rows = sinks.reports.csv_rows(entries.withColumn("filename", F.lit('a,"b"\nc')))
    sinks.write_csv(rows, str(tmp_path / "r.csv"), sinks.reports.CSV_COLUMNS, ["entry_pos"])
    import csv

    with (tmp_path / "r.csv").open(encoding="utf-8", newline="") as f:
        back = list(csv.DictReader(f))
    assert len(back[0]) == 21 and list(back[0]) == sinks.reports.CSV_COLUMNS and back[0]["filename"] == 'a,"b"\nc'
    assert (back[0]["accessible"], back[0]["pages"], back[0]["errors"], back[1]["accessible"], back[1]["status"]) == ("False", "2", "boom", "", "pending")


def test_state_files_are_written_and_read_again(spark, tmp_path):
    made = spark.createDataFrame([("s", "b.pdf", "https://s/b.pdf", None), ("s", "a", "https://s/a", "https://s/")], "folder string, filename string, url string, referer string")
    pages = spark.createDataFrame([("s", 1, "https://s/x"), ("s", 0, "https://s/"), ("t", 0, "https://t/")], "folder string, seq int, url string")
    sinks.write_crawl_state(made, pages, str(tmp_path))
    assert json.loads((tmp_path / "s/_url_map.json").read_text()) == {"a": "https://s/a", "b.pdf": "https://s/b.pdf"}
    assert json.loads((tmp_path / "s/_crawled_pages.json").read_text()) == ["https://s/", "https://s/x"]
    assert json.loads((tmp_path / "t/_crawled_pages.json").read_text()) == ["https://t/"] and not (tmp_path / "t/_url_map.json").exists()
    assert files.name_map(spark, f"{tmp_path}/*/_url_map.json", "url").count() == 2


def pdf(*objects, trailer=b""):
    body = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objects))
    return body + b"trailer << /Root 1 0 R " + trailer + b">>\nstartxref\n0\n%%EOF"


def test_pdf_facts(spark, tmp_path):
    content = zlib.compress(b"BT /F1 12 Tf (x) Tj ET BT /F1 9 Tf ET")
    good = pdf(
        b"<< /Type /Catalog /Lang (de-DE) /MarkInfo << /Marked true >> /StructTreeRoot 9 0 R /ViewerPreferences << /DisplayDocTitle true >> /Metadata 4 0 R /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Contents 5 0 R /Resources << /Font << /F1 6 0 R >> >> >>",
        b"<< /Type /Metadata >> stream\n<x xmp:ModifyDate=\"2020-01-02T03:04:05Z\"/><pdf:Producer>P &amp; q</pdf:Producer><dc:title><rdf:Alt><rdf:li>T</rdf:li></rdf:Alt></dc:title>\nendstream",
        b"<< /Filter /FlateDecode >> stream\n" + content + b"\nendstream", b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Producer (other) /ModDate (D:20200102) >>", b"<< /P -44 /R 3 >>", b"<< >>",
        trailer=b"/Info 7 0 R /Encrypt 8 0 R ",
    )
    f = read_facts(good)
    assert (f["n_pages"], f["lang"], f["title"], f["marked"], f["display_doc_title"], f["has_xmp"], f["num_tf"], f["font_names"]) == (1, "de-DE", "T", True, True, True, 2, ["Helvetica"])
    assert (f["encrypted"], f["p"], f["revision"], f["producer"], f["xmp_modify"], f["doc_mod"]) == (True, -44, 3, "P & q", "2020-01-02T03:04:05Z", "D:20200102")
    (tmp_path / "good.pdf").write_bytes(good)
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    (tmp_path / "empty.pdf").write_bytes(b"%PDF-1.4\n")
    got = {r["path"].rpartition("/")[2]: r for r in pdf_facts(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got["good.pdf"]["n_pages"] == 1 and got["bad.pdf"]["open_error"] == "not a PDF" and got["empty.pdf"]["open_error"] == "no catalog"


def test_pdf_objects_are_read_whole(monkeypatch):
    index = b"/Index [" + b"0 1 " * 300 + b"]"
    f = read_facts(pdf(
        b"<< /Type /Catalog >>", b"<< /Producer (P) >>", b"<< /P -44 /R 3 >>", b"<< " + index + b" /Type /XRef /Root 1 0 R /Info 2 0 R /Encrypt 3 0 R >> stream\nx\nendstream",
        b"<< " + b" " * 400 + b"/Type /ObjStm /N 1 /First 5 >> stream\n9 0  << /BaseFont /Odd >>\nendstream",
    ).partition(b"trailer")[0])
    assert (f["encrypted"], f["p"], f["font_names"]) == (True, -44, ["Odd"])
    monkeypatch.setattr("folioscope.sources.pdf_facts.MAX_INFLATED", 1000)
    for n, error in ((1000, None), (1001, "TooLarge")):
        f = read_facts(pdf(b"<< /Type /Catalog >>", b"<< /Filter /FlateDecode >> stream\n" + zlib.compress(b" " * n) + b"\nendstream"))
        assert f["open_error"] == error


def test_images_count_by_page_and_form():
    image, page = b"<< /Subtype /Image >> stream\nx\nendstream", b"<< /Type /Page /Parent 2 0 R >>"
    form = b"<< /Subtype /Form /Resources << /XObject << /I 4 0 R /Self 5 0 R >> >> >> stream\nx\nendstream"
    pages = b"<< /Type /Pages /Resources << /XObject << /I 4 0 R /F 5 0 R >> >> >>"
    unused = image
    own = b"<< /Type /Page /Parent 2 0 R /Resources << /XObject << /I 4 0 R >> >> >>"
    assert read_facts(pdf(b"<< /Type /Catalog /Pages 2 0 R >>", pages, page, image, form, page, own, unused))["n_images"] == 5


def test_streaming_upkeep(spark, tmp_path):
    from folioscope.streaming.arrivals import ManifestTable, links_per_window, maintain

    layout = "entry_pos bigint, url string, md5 string, filename string, site string, crawled_at string, status string, report string, errors array<string>, notes string"
    start = [(0, "u1", "a", "f", "s", "t", "analysed", "r", ["e"], None)] + [(i, f"other{i}", "a", "f", "s", "t", "analysed", "r", [], None) for i in range(1, 30)]
    ManifestTable.create(spark.createDataFrame(start, layout), f"{tmp_path}/m", buckets=8)
    scan = "scan_pos bigint, url string, md5 string, filename string, site string, crawled_at string, notes string"
    spark.createDataFrame([(1, "u1", "b", "g", "s2", "t2", ""), (2, "u2", "c", "h", "s", "t2", "n")], scan).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = maintain(spark, spark.readStream.schema(scan).parquet(f"{tmp_path}/in"), f"{tmp_path}/m", f"{tmp_path}/cp")
    query.awaitTermination(120)
    kept = ManifestTable(spark, f"{tmp_path}/m")
    rows = {r["url"]: r for r in kept.entries().collect()}
    assert len(rows) == 31 and rows["u2"]["entry_pos"] > 29 and sum(n == "batch-0" for n in kept.state["held"].values()) <= 2
    kept.upsert(spark.createDataFrame([(1, "u1", "zz", "g", "s2", "t2", "")], scan), 0)  # a batch that is run again
    assert ManifestTable(spark, f"{tmp_path}/m").entries().where("md5 = 'zz'").isEmpty()
    assert (rows["u1"]["md5"], rows["u1"]["status"], rows["u1"]["filename"], rows["u1"]["errors"]) == ("b", "pending", "f", [])
    assert rows["u2"]["status"] == "pending" and rows["u2"]["notes"] == "n"
    links = spark.readStream.schema("link_id bigint, url string, type string, referer string, seen_at timestamp").parquet("/root/testdata/sf0.001/crawled_urls.parquet*")
    stream = links_per_window(links).writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    stream.awaitTermination(120)
    total = spark.read.parquet("/root/testdata/sf0.001/crawled_urls.parquet").where("seen_at IS NOT NULL").count()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == total


def test_upsert_of_repeated_urls(spark):
    layout = "entry_pos bigint, url string, md5 string, filename string, site string, crawled_at string, status string, report string, errors array<string>, notes string"
    entries = spark.createDataFrame([(0, "u", "a", "f", "s", "t", "error", None, ["e"], "old"), (1, "u", "z", "f", "s", "t", "analysed", None, [], None)], layout)
    scan = spark.createDataFrame([(1, "u", "a", "g", "s", "t1", ""), (2, "u", "b", "g", "s", "t2", "new"), (3, "u", "b", "g", "s", "t3", ""), (4, None, "q", "g", "s", "t3", "")], "scan_pos bigint, url string, md5 string, filename string, site string, crawled_at string, notes string")
    rows = manifest.upsert(entries, scan).orderBy("entry_pos").collect()
    assert [(r["md5"], r["status"], r["crawled_at"], r["notes"]) for r in rows] == [("b", "pending", "t2", "new"), ("z", "analysed", "t", None)]
    flags = {r["scan_pos"]: (r["changed"], r["needs_scan"]) for r in manifest.scan_changes(entries, scan).collect()}
    assert flags == {1: (False, True), 2: (True, True), 3: (False, True)}
    assert manifest.upsert(entries.where("false"), scan).count() == 1 and manifest.upsert(entries, scan.where("false")).count() == 2


def test_text_of_pages_and_forms(spark, tmp_path):
    content = zlib.compress(b"BT /F1 12 Tf (Hello w\\157rld) Tj 0 -14 Td [(Sec) -20 (ond) -400 (line)] TJ ET /X Do")
    cmap = b"2 beginbfchar <01> <0041> <02> <00E9> endbfchar 1 beginbfrange <10> <12> <0061> endbfrange"
    good = pdf(
        b"<< /Type /Catalog /Pages 2 0 R /Metadata 8 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 6 0 R >> /XObject << /X 10 0 R >> >> >>", b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", b"<< >>",
        b"<< /Filter /FlateDecode >> stream\n" + content + b"\nendstream", b"<< /Type /Font /BaseFont /Helvetica >>", b"<< /Type /Font /BaseFont /X /FontDescriptor 11 0 R /ToUnicode 9 0 R >>",
        b"<< /Type /Metadata >> stream\n<x><xmp:CreatorTool>Writer</xmp:CreatorTool><dc:Modified>2016-05-06T07:08:09+02:00</dc:Modified></x>\nendstream", b"<< >> stream\n" + cmap + b"\nendstream",
        b"<< /Type /XObject /Subtype /Form /Resources << /Font << /F2 7 0 R >> >> >> stream\nBT /F2 9 Tf <0102> Tj <101112> Tj ET\nendstream", b"<< /Type /FontDescriptor /FontName /Real >>",
    )
    f = read_facts(good)
    assert (f["n_words"], f["font_names"], f["creator"], f["dc_modified"]) == (5, ["Helvetica", "Real"], "Writer", "2016-05-06T07:08:09+02:00")
    (tmp_path / "a.pdf").write_bytes(good)
    (tmp_path / "b.pdf").write_bytes(b"junk")
    from folioscope.operators.analysis import reports_of

    facts = pdf_facts(spark.read.format("binaryFile").load(str(tmp_path))).withColumn("url", F.col("path"))
    got = {r["url"][-5:]: r for r in reports_of(facts, ["en"]).collect()}
    report = got["a.pdf"]["report"]
    assert (report["Words"], report["Date"], report["Exempt"], report["Creator"], report["LanguageTest"], report["hasDisplayDocTitle"]) == (5, "2016-05-06 07:08:09+02:00", True, "Writer", "Fail", None)
    assert got["a.pdf"]["errors"] == ["title, tagged, lang, "]
    broken = got["b.pdf"]["report"]
    assert broken["BrokenFile"] and broken["Accessible"] is None and broken["TaggedTest"] is None and got["b.pdf"]["errors"] == ["PdfError: not a PDF"]
