"""Scans of directories: listing, health, extraction, reports, command line, service."""

from __future__ import annotations

import csv
import io
import json
import os
import xml.etree.ElementTree as ET
import zipfile
import zlib

import pytest

from gleanery import cli, sidecar
from gleanery.config import ScanConfig, from_flat
from gleanery.operators import health
from gleanery.plans.scan import Cancelled, scan_directory, scan_table
from gleanery.report import formatting, render
from gleanery.sources import files as file_source
from gleanery.sources import walker

PNG = b"\x89PNG\r\n\x1a\n" + b"\0" * 60 + b"IEND\xaeB`\x82"


def make_pdf(*pages: str, end: bytes = b"%%EOF", title: str = "T") -> bytes:
    out = b"%PDF-1.4\n1 0 obj << /Title (" + title.encode() + b") /Author (A) >> endobj\n"
    for p in pages:
        data = zlib.compress(b"BT (" + p.encode("latin-1") + b") Tj ET" if p else b"q Q")
        out += b"2 0 obj << /Type /Page >> endobj\n3 0 obj << /Filter /FlateDecode /Length " + str(len(data)).encode() + b" >> stream\n" + data + b"\nendstream endobj\n"
    return out + end


def zipped(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_XML", ".xml"), text)
    return out.getvalue()


def make_docx(*paragraphs: str, types: bool = True) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    table = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    core = '<c:coreProperties xmlns:c="x" xmlns:dc="y"><dc:title>Doc title</dc:title><dc:creator>Someone</dc:creator></c:coreProperties>'
    parts = {"word/document.xml": f"<w:document {w}><w:body>{table}{body}</w:body></w:document>", "docProps/core.xml": core}
    if types:
        parts["[Content_Types].xml"] = "<Types/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    long = "The quick text of a document that is long enough to be analysed for language and more. " * 6
    contents = {
        "doc.txt": long.encode(), "copy.txt": long.encode(), "nested/deep/near.txt": (long + "One more sentence.").encode(), "empty.txt": b"", ".hidden.txt": b"hidden file with enough characters in it to be no near-empty file",
        "_under.csv": b"a,b\n" * 30, "tiny.dat": b"0123456789", "image.png": PNG, "fake.pdf": PNG, "good.pdf": make_pdf("Hello PDF text " * 10, "Second page"), "scan.pdf": make_pdf("", ""),
        "cut.pdf": make_pdf("Hello " * 20, end=b""), "locked.pdf": make_pdf("x" * 60) + b" /Encrypt %%EOF", "a.docx": make_docx("First paragraph", "Second"), "bad.docx": make_docx("x" * 60, types=False),
        "contacts.md": b"", "people.txt": b"mail someone@example.com or call 555-123-4567\nSSN: 123-45-6789\n" + long.encode(), "latin.txt": ("Größe und Maß für alle Straßen, schöne Grüße. " * 9).encode("latin-1"),
        "broken.txt": ("Le résumé est prêt à être envoyé. " * 5).encode().decode("latin-1").encode(), "node_modules/x.js": b"ignored", "mail.eml": b"Subject: Hi\nFrom: a@b.org\nTo: c@d.org\nContent-Type: text/plain\n\nbody text\n" + b"x" * 60,
    }
    for name, raw in contents.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    (root / "hollow").mkdir()
    os.symlink(root / "doc.txt", root / "link.txt")
    os.symlink(root, root / "nested" / "back")
    return root


@pytest.fixture(scope="module")
def report(spark, tree):
    out = scan_directory(spark, str(tree), ScanConfig(show_pii_samples=False))
    yield out
    out.close()


def test_walk(spark, tree):
    listed = {r["relative_path"]: r for r in walker.list_files(spark, str(tree), ("node_modules",)).collect()}
    assert {"empty.txt", ".hidden.txt", "_under.csv", "nested/deep/near.txt", "link.txt"} <= set(listed) and not any("node_modules" in p for p in listed)
    assert listed["link.txt"]["is_symlink"] and listed["empty.txt"]["size"] == 0
    w = walker.walk(str(tree), ("node_modules", "*.md"))
    assert w.issues == [(str(tree / "nested/back"), "symlink_loop")] and w.excluded == 2 and w.empty_dirs == 2
    assert sorted(f[1] for f in w.files) == sorted(p for p in listed if p != "contacts.md")
    with pytest.raises(FileNotFoundError):
        walker.walk(str(tree / "nowhere"))
    with pytest.raises(NotADirectoryError):
        walker.walk(str(tree / "doc.txt"))


def test_walk_in_parts(spark, tmp_path, monkeypatch):
    """Files, loops and counts are the same however the tree is dealt out; a directory whose name begins like another's is no ancestor."""
    for name in ("a/b/one.txt", "a/bc/two.txt", "d/e/f/g/three.txt", "d/x.bin", "z/four.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / "hollow").mkdir()
    for link, target in (("a/bc/near", "a/b"), ("a/b/later", "a/bc"), ("d/e/up", "d"), ("z/back", "a"), ("a/b/z", "z"), ("d/out", "/usr")):
        os.symlink(tmp_path / target, tmp_path / link)
    os.symlink(tmp_path / "a/b", tmp_path / "a/bc/deep")
    want = walker.walk(str(tmp_path), ("*.bin",))
    loops = {os.path.relpath(p, tmp_path) for p, kind in want.issues}
    assert loops == {"a/bc/near", "a/bc/deep", "d/e/up", "z/back"} and want.excluded == 1
    for parts in (1, 5, 64):
        monkeypatch.setattr(walker, "PARTS", parts)
        files, issues, stats = walker.walk_parts(walker.walk_all(spark, str(tmp_path), ("*.bin",)))
        assert sorted(r["relative_path"] for r in files.collect()) == sorted(f[1] for f in want.files)
        assert sorted(tuple(r) for r in issues.collect()) == sorted(want.issues)
        assert tuple(stats.first()) == (want.total_dirs, want.empty_dirs, 1, len(want.files), len(want.files))


def test_health_of_files(report):
    got = {r["id"]: r["status"] for r in report["health"].collect()}
    want = {
        "doc.txt": "ok", "empty.txt": "empty", "tiny.dat": "near_empty", "image.png": "ok", "fake.pdf": "ok", "good.pdf": "ok", "cut.pdf": "truncated", "locked.pdf": "encrypted_pdf",
        "a.docx": "ok", "bad.docx": "corrupt",
    }
    assert {k: got[k] for k in want} == want
    tally = report["health_tally"].first()
    assert tally["n_empty"] == 2 and tally["n_encrypted"] == 1 and tally["n_truncated"] == 1


def test_containers():
    locked = bytearray(zipped(a="x" * 80))
    at = locked.index(b"PK\x01\x02")
    locked[at + 8] |= 1
    assert file_source.container_facts(bytes(locked), ".zip", "application/zip")[0]
    ole = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 40 + "EncryptedPackage".encode("utf-16-le")
    assert file_source.container_facts(ole, ".docx", "x")[1] and not file_source.container_facts(ole, ".bin", "x")[1]
    assert file_source.container_facts(make_docx("a")[:-30], ".docx", file_source.OFFICE[0])[2]


def test_extraction():
    one = file_source.extract_one
    assert one(make_docx("First", "Second"), file_source.OFFICE[0])["text"] == "First\nSecond\ncell"
    assert one(make_docx("x"), file_source.OFFICE[0])["title"] == "Doc title"
    pdf = one(make_pdf("Hello", "two"), "application/pdf")
    assert pdf["text"] == "Hello\ntwo" and pdf["page_count"] == 2 and pdf["title"] == "T" and pdf["native_pages"] == 2
    sheet = zipped(**{"xl__sharedStrings_XML": "<s><si><t>a</t></si></s>", "xl__worksheets__sheet1_XML": '<w><row><c t="s"><v>0</v></c><c><v>2</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>z</t></is></c></row></w>'})
    assert one(sheet, file_source.OFFICE[1])["text"] == "a\t2\nz"
    slides = zipped(**{"ppt__slides__slide1_XML": "<s><p><t>one</t></p></s>", "ppt__slides__slide2_XML": "<s><p><t>two</t></p></s>"})
    got = one(slides, file_source.OFFICE[2])
    assert got["text"] == "one\ntwo" and got["page_count"] == 2
    assert one(zipped(**{"a.xhtml": "<p> x </p><script>y</script>", "b.html": "<b>z</b>"}), "application/epub+zip")["text"] == "x\ny\nz"
    mail = one(b"Subject: S\nFrom: f@x.org\nDate: today\n\nbody\n", "message/rfc822")
    assert mail["text"].startswith("Subject: S\nFrom: f@x.org") and "body" in mail["text"] and mail["author"] == "f@x.org"
    assert "Unsupported" in one(b"x", "text/markdown")["error"] and one(b"junk", file_source.OFFICE[0])["error"] and one(None, "text/plain")["error"]


def test_facts(report):
    facts = {r["path"]: r for r in report["text_facts"].collect()}
    assert facts["scan.pdf"]["is_scanned"] and facts["scan.pdf"]["classification"] == "image_heavy" and not facts["good.pdf"]["is_scanned"]
    assert facts["latin.txt"]["encoding"] != "utf-8" and facts["doc.txt"]["encoding"] == "utf-8" and facts["locked.pdf"]["error"]
    row = report["extraction"].first()
    assert row["n_scanned"] == 1 and row["n_errors"] >= 1 and row["n_title"] >= 2


def test_sections(report):
    members = {r["id"] for r in report["duplicate_members"].collect()}
    assert {"doc.txt", "copy.txt", "link.txt"} <= members
    found = {r["id"]: r["pii_types"] for r in report["pii_files"].collect()}
    assert found["people.txt"] == "email,phone,ssn"
    assert {r["id"] for r in report["mojibake"].where("is_damaged").collect()} == {"broken.txt"}
    rules = {(r["id"], r["rule_id"]) for r in report["findings"].collect()}
    assert {("bad.docx", "FC001"), ("cut.pdf", "FC002"), ("locked.pdf", "FC003"), ("empty.txt", "FC004"), ("people.txt", "FC005"), ("doc.txt", "FC006"), ("broken.txt", "FC007")} <= rules
    assert ("copy.txt", "FC006") not in rules
    assert {r["metric"]: r["breached"] for r in report["gate"].collect()} == {"duplicate": True, "corrupt": True, "pii": True}


def test_rendered_reports(report, tmp_path):
    for fmt in render.FORMATS:
        path = tmp_path / f"out.{fmt}"
        render.generate(report, fmt, str(path))
        body = path.read_text(encoding="utf-8")
        assert body and "123-45-6789" not in body and "someone@example.com" not in body
        if fmt == "json":
            parsed = json.loads(body)
            assert set(parsed) == {"version", "scan_path", "scan_date", "duration_seconds", "summary", "files"}
            assert next(f for f in parsed["files"] if f["id"] == "doc.txt")["is_duplicate"]
        elif fmt == "csv":
            rows = list(csv.DictReader(io.StringIO(body.lstrip("﻿"))))
            assert next(r for r in rows if r["id"] == "people.txt")["pii_types"] == "email;phone;ssn"
        elif fmt == "junit":
            root = ET.fromstring(body)
            assert int(root.get("errors")) == len(root.findall(".//error")) >= 2
        elif fmt == "sarif":
            assert len(json.loads(body)["runs"][0]["tool"]["driver"]["rules"]) == 7
        elif fmt == "terminal":
            assert "Exact duplicates" in body and "Other" not in body.split("Sizes")[0] or body
    with pytest.raises(ValueError, match="unknown format"):
        render.generate(report, "xlsx")


def test_cli(spark, tree, tmp_path, capsys, monkeypatch):
    assert cli.main(["scan", str(tmp_path / "none")], spark) == 2
    assert cli.main(["scan", str(tmp_path), "--format", "json", "-o", str(tmp_path / "no" / "x.json")], spark) == 2
    (tmp_path / "clean").mkdir()
    assert cli.main(["scan", str(tmp_path / "clean")], spark) == 0
    (tmp_path / "clean" / "a.txt").write_text("A clean file with enough words in it to be called fine by all rules.")
    assert cli.main(["scan", str(tmp_path / "clean"), "--format", "sarif", "-o", str(tmp_path / "r.json"), "--sampling-rate", "7"], spark) == 0
    assert "set to 1.0" in capsys.readouterr().err and json.loads((tmp_path / "r.json").read_text())["version"] == "2.1.0"


def test_service(spark, tmp_path):
    (tmp_path / "a.txt").write_text("A clean file with enough words in it to be called fine by all rules.")
    out = io.StringIO()
    lines = ["junk\n", '{"cmd": "what"}\n', json.dumps({"cmd": "scan", "path": str(tmp_path)}) + "\n"]
    assert sidecar.serve(iter(lines), out, spark) == 0
    events = [json.loads(x) for x in out.getvalue().splitlines()]
    kinds = [e["event"] for e in events]
    assert kinds[:3] == ["ready", "error", "error"] and kinds.count("phase") == 12 and kinds[-1] == "complete"
    assert events[-1]["report"]["files"][0]["id"] == "a.txt"


def test_service_settings(spark, tmp_path):
    """Flat keys take effect, numbers are clamped, and values of the wrong kind are errors."""
    c = from_flat({"sampling_rate": 3, "exclude": ["*.bin"], "show_pii_samples": True, "pii_min_confidence": -1, "simhash_threshold": 500, "simhash_bits": 128})
    assert (c.sampling_rate, c.sampling_rate_auto, c.exclude[-1], c.show_pii_samples, c.pii_min_confidence, c.simhash_bits, c.simhash_threshold) == (1.0, False, "*.bin", True, 0.0, 128, 128)
    assert from_flat({"simhash_bits": 32, "simhash_threshold": 90}).simhash_threshold == 64
    assert from_flat({}) == ScanConfig() and from_flat({"sampling": {"rate": 0.5}}).sampling_rate == 0.5
    for bad in ({"sampling_rate": "much"}, {"sampling_rate": float("nan")}, {"simhash_bits": None}, ["x"]):
        with pytest.raises(ValueError):
            from_flat(bad)
    (tmp_path / "a.txt").write_text("mail someone@example.com " * 5)
    (tmp_path / "b.bin").write_bytes(b"left out")

    def last(command):
        out = io.StringIO()
        sidecar.serve(iter([json.dumps(command) + "\n"]), out, spark)
        return json.loads(out.getvalue().splitlines()[-1])

    done = last({"cmd": "scan", "path": str(tmp_path), "config": {"exclude": ["*.bin"], "show_pii_samples": True}})
    assert done["event"] == "complete" and [f["id"] for f in done["report"]["files"]] == ["a.txt"]
    assert last({"cmd": "scan", "path": str(tmp_path), "config": {"sampling_rate": "much"}})["event"] == "error"
    assert last({"cmd": "scan", "path": str(tmp_path / "nowhere")})["event"] == "error"


def test_phases_are_told_as_they_run(spark, tree):
    """What a phase makes is there when the next is told."""
    made = []
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("phases", "phases")
    out = scan_directory(spark, str(tree), on_phase=lambda name, k, of: made.append((name, len(status.getJobIdsForGroup("phases")))))
    out.close()
    counts = [n for _, n in made]
    assert len(made) == 12 and all(a < b for a, b in zip(counts[2:], counts[3:], strict=False)), str(counts)


def test_intervals_and_cluster_members(spark):
    """A sample's shares have intervals, in JSON and for people; near-duplicate clusters name their members, with 128 bits too."""
    words = [f"term{k}" for k in range(120)]
    texts = [(f"d{k:02d}", " ".join(words[:-1] + [f"last{k // 4}"]) if k < 8 else " ".join(f"w{k}x{j}" for j in range(80)) + (" a@b.org" if k % 2 else "")) for k in range(24)]
    frame = spark.createDataFrame(texts, "id string, text string").selectExpr("id", "cast(length(text) AS long) AS size", "'text/plain' AS mime", "'.' AS cluster", "text")
    for bits in (64, 128):
        own = scan_table(frame, ScanConfig(simhash_bits=bits, simhash_threshold=5))
        assert ("fp_lo" in own["fingerprints"].columns) == (bits == 128)
        own.sections["population"] = spark.createDataFrame([(240, 24)], "population long, n_analyzed long")
        body = json.loads(render.to_json(own))["summary"]
        mail = next(r for r in body["pii_types"] if r["pattern"] == "email")
        assert mail["n_files"] == 8 and mail["pct"] == round(100 * 8 / 24, 4) and 0 < mail["lo_pct"] < mail["pct"] < mail["hi_pct"]
        assert body["population"] == {"population": 240, "n_analyzed": 24}
        found = {tuple(c["members"]): c["similarity"] for c in body["near_duplicates"]["clusters"]}
        near = body["near_duplicates"]
        assert near["bits"] == bits and near["n_files"] == 8 and sorted(x for m in found for x in m) == [f"d{k:02d}" for k in range(8)]
        assert all(0.8 < v <= 1 for v in found.values())
        assert "(CI: " in render.to_text(own) and "<svg" in render.to_html(own)
        own.close()


def test_near_duplicates_by_minhash(spark):
    words = [f"term{k}" for k in range(120)]
    texts = [(f"d{k}", " ".join([*words[:60], f"x{k}", *words[61:]])) for k in range(3)] + [(f"e{k}", " ".join(f"w{k}x{j}" for j in range(80))) for k in range(3)]
    frame = spark.createDataFrame(texts, "id string, text string").selectExpr("id", "cast(length(text) AS long) AS size", "'text/plain' AS mime", "'.' AS cluster", "text")
    config = from_flat({"near_duplicates": {"method": "minhash"}})
    own = scan_table(frame, config)
    near = json.loads(render.to_json(own))["summary"]["near_duplicates"]
    own.close()
    assert config.near_method == near["method"] == "minhash" and [c["members"] for c in near["clusters"]] == [["d0", "d1", "d2"]] and 0.8 < near["clusters"][0]["similarity"] < 1


def test_cancel(spark, tree):
    def stop(name, k, of):
        if k == 2:
            raise Cancelled

    with pytest.raises(Cancelled):
        scan_directory(spark, str(tree), on_phase=stop)


def test_phases_of_an_empty_corpus(spark, tmp_path):
    seen = []
    out = scan_directory(spark, str(tmp_path), on_phase=lambda name, k, of: seen.append((name, k, of)))
    assert out.empty and seen == [("walk", 0, 12)] and render.exit_code(out) == (0, [])


def test_formatting():
    assert [formatting.format_size(x) for x in (0, 1023, 1536, 5 * 1024**2, 3 * 1024**4)] == ["0 B", "1023 B", "1.5 KB", "5.0 MB", "3.0 TB"]
    assert [formatting.format_duration(x) for x in (1.23, 61, 3700)] == ["1.2s", "1m 1s", "1h 1m"]
    assert formatting.bar(0.5) == "#" * 10
    assert formatting.format_ci(0.5, 0.452, 0.548, 100, 1000) == "50.0% (CI: 45.2% -- 54.8%, n=100)"
    assert formatting.format_ci(0.3, 0.3, 0.3, 100, 100) == "30.0% (exact, N=100)"


def test_statuses_are_known():
    assert set(health.STATUSES) >= {"ok", "corrupt", "unreadable"}


def test_reports_list_every_file(spark):
    from pyspark.sql import functions as F

    from gleanery.plans.scan import CorpusReport

    n = 10_050
    ids = spark.range(n).select(F.format_string("f%06d", "id").alias("id"))
    found = ids.select("id", F.lit("FC004").alias("rule_id"), F.lit("warning").alias("level"), F.lit("empty").alias("message"))
    own = CorpusReport(ScanConfig(), {"files": ids, "findings": found, "cases": ids})
    want = [f"f{k:06d}" for k in range(n)]
    assert [r["id"] for r in json.loads(render.to_json(own))["files"]] == want
    results = json.loads(render.to_sarif(own))["runs"][0]["results"]
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results] == want
    junit = render.to_junit(own)
    assert f'tests="{n}"' in junit and f'failures="{n}"' in junit and junit.count("<testcase ") == junit.count("<failure ") == n
