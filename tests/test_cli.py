import json

import pytest

from folioscope import cli
from tests.test_sources import pdf

pytest.importorskip("yaml")


def test_crawl_analyse_report(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    site = tmp_path / "files" / "h.example"
    site.mkdir(parents=True)
    (site / "a.pdf").write_bytes(pdf(b"<< /Type /Catalog /Lang (en) /Pages 2 0 R >>", b"<< /Type /Pages >>", b"<< /Type /Page >>"))
    (site / "b.pdf").write_bytes(b"broken")
    (site / "_url_map.json").write_text(json.dumps({"a.pdf": "https://h.example/x/a.pdf"}))
    (site / "_crawled_pages.json").write_text(json.dumps(["https://h.example/"]))
    m = str(tmp_path / "m.yaml")
    assert cli.main(["crawl", "--url", "https://www.h.example/", "--output-dir", str(tmp_path / "files"), "--report-dir", str(tmp_path / "out"), "--manifest", m]) == 0
    held = {r["url"]: r for r in cli.read_manifest(spark, m).collect()}
    assert set(held) == {"https://h.example/x/a.pdf", "https://h.example/b.pdf"} and all(r["status"] == "pending" for r in held.values())
    assert cli.main(["analyse", "--crawled-dir", str(tmp_path / "files"), "--manifest", m]) == 0
    held = {r["url"]: r for r in cli.read_manifest(spark, m).collect()}
    good, bad = held["https://h.example/x/a.pdf"], held["https://h.example/b.pdf"]
    assert good["status"] == bad["status"] == "analysed"
    assert good["report"]["Accessible"] is False and good["report"]["LanguageTest"] == "Pass" and good["report"]["Pages"] == 1 and "tagged, " in good["errors"][0]
    assert bad["report"]["BrokenFile"] is True and bad["report"]["Accessible"] is None
    (site / "a.pdf").unlink()
    assert cli.main(["crawl", "--url", "h.example", "--output-dir", str(tmp_path / "files"), "--report-dir", str(tmp_path / "out"), "--manifest", m, "--notes", "again"]) == 0
    assert cli.main(["report", "--report-dir", str(tmp_path / "out"), "--site", "h.example", "--issue-comment-file", str(tmp_path / "c.md"), "--archive-dir", str(tmp_path / "arc"), "--html-dir", str(tmp_path / "html"), "--crawled-dir", str(tmp_path / "files"), "--manifest", m]) == 0
    assert "| Total files tracked | 2 |" in (tmp_path / "out" / "report.md").read_text() and "| URLs crawled | 1 |" in (tmp_path / "out" / "report.md").read_text()
    assert {p.name for p in (tmp_path / "arc").iterdir() if not p.name.endswith((".crc", ".html"))} == {"index.json", "report.json", "report.csv", "manifest.yaml"}
    assert (tmp_path / "out" / "crawled_urls.csv").read_bytes().startswith(b"url,type,referer\r\nhttps://h.example/,page,\r\n") and "🌐 URLs crawled | 1" in (tmp_path / "c.md").read_text()
    with pytest.raises(SystemExit):
        cli.main(["crawl", "--url", "https://h.example/a.pdf", "--manifest", m])


def embedded(page):
    return json.loads(page.read_text("utf-8").partition('id="data">')[2].partition("</script>")[0])


def test_pages_hold_every_row_and_the_history_every_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    m, out, arc = tmp_path / "m.yaml", tmp_path / "out", tmp_path / "arc"
    m.write_text("".join(f'- {{url: "u{i}</script>", filename: f{i}.pdf, site: s{i % 2}, status: pending, errors: []}}\n' for i in range(5)))
    args = ["report", "--report-dir", str(out), "--html-dir", str(out), "--archive-dir", str(arc), "--manifest", str(m)]
    assert cli.main([*args, "--site", "s1", "--crawl-url", "https://s1/"]) == 0 and cli.main(args) == 0
    whole = embedded(out / "report.html")
    assert [f["url"] for f in whole["files"]] == [f"u{i}</script>" for i in range(5)] and whole["summary"]["total_files"] == 5
    history = json.loads((arc / "index.json").read_text("utf-8"))
    assert [(e["site"], e["crawl_url"], e["total"]) for e in history] == [("all", "", 5), ("s1", "https://s1/", 2)]
    assert [len(embedded(arc / e["archive_file"])["files"]) for e in history] == [5, 2]
    assert embedded(out / "reports.html") == "../arc" and "index.json" in (out / "reports.html").read_text("utf-8")
    cli.sinks.add_to_history(spark, history[1], str(arc / "index.json"))
    assert json.loads((arc / "index.json").read_text("utf-8")) == history


def test_missing_file_is_an_error(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    m = tmp_path / "m.yaml"
    m.write_text("- {url: u, filename: f.pdf, site: s, status: pending, errors: []}\n")
    assert cli.main(["analyse", "--crawled-dir", str(tmp_path / "none"), "--manifest", str(m)]) == 0
    row = cli.read_manifest(spark, str(m)).first()
    assert row["status"] == "error" and row["errors"][0].startswith("File not found: ") and "none/s/f.pdf. Possible causes" in row["errors"][0]


def test_time_budgets_and_purge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    site = tmp_path / "files" / "s"
    site.mkdir(parents=True)
    good = pdf(b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages >>", b"<< /Type /Page >>")
    for name in ("a.pdf", "b.txt"):
        (site / name).write_bytes(good)
    m = tmp_path / "m.yaml"
    start = "".join(f"- {{url: {n}, filename: {n}, site: s, status: pending, errors: []}}\n" for n in ("a.pdf", "b.txt"))
    m.write_text(start)
    args = ["analyse", "--crawled-dir", str(tmp_path / "files"), "--manifest", str(m)]
    assert cli.main([*args, "--total-timeout", "0"]) == 0
    assert {r["url"]: r["status"] for r in cli.read_manifest(spark, str(m)).collect()} == {"a.pdf": "pending", "b.txt": "pending"}
    assert cli.main([*args, "--purge"]) == 0
    held = {r["url"]: r for r in cli.read_manifest(spark, str(m)).collect()}
    assert held["a.pdf"]["status"] == "analysed" and held["b.txt"]["errors"] == ["Not a PDF file: .txt"] and not [p for p in site.iterdir() if p.suffix in (".pdf", ".txt")]


def test_a_slow_file_is_given_up(spark, tmp_path, monkeypatch):
    from folioscope.sources import pdf_facts

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7")

    def endless(data):
        while True:
            pass

    monkeypatch.setattr(pdf_facts, "read_facts", endless)
    row = pdf_facts.pdf_facts(spark.read.format("binaryFile").load(str(tmp_path)), seconds=0.5).first()
    assert row["error_kind"] == "timeout" and row["n_pages"] is None
