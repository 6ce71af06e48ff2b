import io
import struct
import zipfile
import zlib
from datetime import datetime
from xml.etree import ElementTree as ET

import numpy as np
from pyspark.sql import functions as F

from pageframe.operators.pixels_numpy import png
from pageframe.sources import exports, files
from pageframe.streaming import progress


def test_docx(spark):
    for sections in ([], [[("heading", "Title"), ("body", "a <b> & c\x00")], [("bullet", "x")]]):
        with zipfile.ZipFile(io.BytesIO(exports.docx(sections))) as z:
            body = z.read("word/document.xml").decode()
    assert "a &lt;b&gt; &amp; c<" in body and body.count("nextPage") == 1
    blocks = spark.createDataFrame([("j", 2, 1, "body", "second"), ("j", 1, 1, None, None), ("k", 1, 1, "body", "x")], "job_id string, page_number int, block_no int, kind string, text string")
    made = {r["job_id"]: r["docx"] for r in exports.documents(blocks).collect()}
    assert set(made) == {"j", "k"} and zipfile.is_zipfile(io.BytesIO(made["j"]))
    assert exports.documents(blocks.limit(0)).count() == 0


def test_pdf_round_trip(spark, tmp_path):
    pages = [(600, 800, [("Invoice #4821 (copy)", 40, 760, 12), ("Total $199.00 due today", 40, 720, 12)]), (600, 800, [])]
    (tmp_path / "a.pdf").write_bytes(exports.pdf(pages))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    rows = files.pdf_pages(spark, f"{tmp_path}/*.pdf").orderBy("page_number").collect()
    assert [(r["page_number"], r["source_kind"]) for r in rows] == [(1, "pdf-text"), (2, "scanned")]
    assert [(i["text"], i["x"], i["y"], i["size"]) for i in rows[0]["items"]] == [(t, float(x), float(y), float(s)) for t, x, y, s in pages[0][2]]


def test_routes(spark):
    df = spark.createDataFrame([("a.PDF", None), ("b", "application/pdf"), ("c.txt", "text/plain"), (None, None)], "path string, mime string")
    assert [r[0] for r in df.select(files.route(F.col("path"), F.col("mime"))).collect()] == ["pdf", "pdf", "image", "image"]


def test_reports(spark, tmp_path):
    for name in ("benchmark-a.json", "benchmark-b.json", "benchmark-results.json", "other.json"):
        (tmp_path / name).write_text('[{"engine": "x"}]')
    assert files.reports(spark, str(tmp_path), "engine string").count() == 2
    df = spark.createDataFrame([("x", 1)], "engine string, n int")
    assert exports.json_lines(df).first()["value"] == '{"engine":"x","n":1}'
    assert df.select(exports.markdown_rows(F.col("engine"), F.col("n"))).first()[0] == "| x | 1 |"


def test_streams(spark, tmp_path):
    source = f"{tmp_path}/in"
    df = spark.createDataFrame([("j", 1, 1, "2026-01-01 00:00:00"), ("j", 1, 2, "2026-01-01 00:01:00"), ("j", 2, 1, "2026-01-01 00:02:00"), ("j", 2, 1, "2026-01-01 00:02:00")], "job string, page int, attempt int, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    latest = progress.latest_results(stream, ["job", "page"], "attempt").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    latest.awaitTermination(60)
    assert sorted((r["page"], r["attempt"]) for r in spark.table("latest").collect()) == [(1, 2), (2, 1)]
    seen = []
    once = progress.on_pages(progress.first_deliveries(stream, "t", "1 hour", ["job", "page", "attempt"]), lambda b, _: seen.extend((r["page"], r["attempt"]) for r in b.collect()), f"{tmp_path}/state")
    once.awaitTermination(60)
    assert sorted(seen) == [(1, 1), (1, 2), (2, 1)]


def test_quality_report():
    rows = [{"engine": f"engine-{k}", "char_accuracy": k / 40, "word_accuracy": None} for k in range(40)]
    pages = files.pdf_items(exports.quality_report(rows, "Recognition quality"))
    shown = [t for _, _, _, items in pages for t, *_ in items]
    assert len(pages) == 3 and all(f"engine-{k}" in shown for k in range(40)) and "char accuracy 97.50%" in shown and "word accuracy 0.00%" in shown
    assert [t for t, *_ in files.pdf_items(exports.quality_report([], "Empty"))[0][3]][:2] == ["Empty", "No results."]


def test_report_tables_and_samples():
    head, body = ["Engine", "Fixture", "Rate"], [[f"engine-{k}", "a very long name of a fixture " * 4, f"{k}.00%"] for k in range(70)]
    text = "First paragraph of the recognised text, " * 9 + "\n\nlast line"
    pages = files.pdf_items(exports.quality_report([], "Report", table=(head, body), samples=[("sample one", text)]))
    shown = [i for _, _, _, items in pages for i in items]
    words = [i.text for i in shown]
    assert len(pages) == 3 and "Engine" in words and "engine-69" in words and "sample one" in words and "last line" in words and words[-1] == "Page 3"
    assert max(i.x + i.width for i in shown) <= 595 - 48 + 1e-6  # scaled to the page
    lines = exports.filled_lines(text, 200, 8)
    assert all(exports.text_width(x, 8) <= 200 for x in lines) and " ".join(" ".join(lines).split()) == " ".join(text.split()) and lines[-2:] == ["", "last line"]
    assert exports.filled_lines("x" * 500, 50, 8) == ["x" * 500] and exports.filled_lines("", 50, 8) == [""]


def test_docx_blocks():
    cell = lambda t, h=20.0: {"text": t, "h": h}
    blocks = [
        {"kind": "heading", "text": "Big", "height": 50.0, "cells": [cell("Big", 50.0)], "median": 20.0}, {"kind": "heading", "text": "Less", "height": 30.0, "median": 20.0},
        {"kind": "bullet", "text": "• One", "height": 20.0}, {"kind": "numbered", "text": "12) Two", "height": 20.0},
        {"kind": "table-row", "text": "a b c", "height": 20.0, "cells": [cell("a"), cell("b"), cell("c")], "width": 1200.0}, {"kind": "table-row", "text": "d", "height": 20.0, "cells": [cell("d")]},
        {"kind": "body", "text": "x y", "height": 20.0, "cells": [cell("x", 8.0), cell("y", 24.0)]}, {"kind": "table-row", "text": "z", "height": None, "cells": None},
    ]
    with zipfile.ZipFile(io.BytesIO(exports.docx([blocks]))) as z:
        assert {"word/numbering.xml", "word/styles.xml", "word/_rels/document.xml.rels"} <= set(z.namelist())
        root = ET.fromstring(z.read("word/document.xml"))
        for name in z.namelist():
            ET.fromstring(z.read(name))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = root.find(f"{w}body")
    assert [s.get(f"{w}val") for s in root.iter(f"{w}pStyle")] == ["Heading1", "Heading2"]
    assert [n.get(f"{w}val") for n in root.iter(f"{w}numId")] == ["1", "2"]
    texts = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.findall(f"{w}p")]
    assert texts == ["Big ", "Less", "One", "Two", "x y ", ""]
    tables = body.findall(f"{w}tbl")
    assert [[["".join(t.text or "" for t in c.iter(f"{w}t")) for c in r.findall(f"{w}tc")] for r in t.findall(f"{w}tr")] for t in tables] == [[["a", "b", "c"], ["d", "", ""]], [["z"]]]
    assert tables[0].find(f".//{w}tcW").get(f"{w}w") == "6000"
    runs = [s.get(f"{w}val") for s in body.findall(f"{w}p")[4].iter(f"{w}sz")]
    assert runs == ["16", "36"]


def test_volumes(spark, monkeypatch):
    monkeypatch.setattr(exports, "VOLUME", 2)
    blocks = spark.createDataFrame([("j", n, 1, "body", f"page {n}") for n in range(1, 6)], "job_id string, page_number int, block_no int, kind string, text string")
    made = exports.documents(blocks).orderBy("volume").collect()
    assert [r["volume"] for r in made] == [0, 1, 2] and all(zipfile.is_zipfile(io.BytesIO(r["docx"])) for r in made)


def test_searchable_pdf(spark):
    image = png(np.arange(100, dtype=np.uint8).reshape(10, 10))
    box = "array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>"
    nan = float("nan")
    regions = [("right", 600.0, 10.0, 80.0, 20.0, None), ("left two", 20.0, 50.0, 100.0, 20.0, None), ("left one", 20.0, 10.0, 100.0, 20.0, None), ("right two", 600.0, 50.0, 80.0, 20.0, None), ("bad", 5.0, 5.0, nan, 5.0, None), ("flat", 5.0, 5.0, 9.0, 0.0, None), (" ", 1.0, 1.0, 9.0, 9.0, None)]
    rows = [("j", 1, 1000, 400, bytearray(image), regions), ("j", 2, 1000, 400, bytearray(b"no image"), None), ("j", 3, None, None, None, None), ("k", 1, 100, 100, None, [])]
    made = {r["job_id"]: r["pdf"] for r in exports.searchable(spark.createDataFrame(rows, f"job_id string, page_number int, width int, height int, image binary, regions {box}")).collect()}
    pages = files.pdf_items(made["j"])
    assert [(n, w, h) for n, w, h, _ in pages] == [(1, 1000.0, 400.0), (2, 1000.0, 400.0)] and made["j"].count(b"/Subtype /Image") == 1 and b"/Predictor 15" in made["j"]
    assert [i.text for i in pages[0][3]] == ["left one", "left two", "right", "right two"] and pages[1][3] == []
    first = pages[0][3][0]
    assert (first.x, first.y, first.size) == (20.0, 400 - 10 - 20 + 17 * 0.2, 17.0) and abs(first.width - 100) < 0.1  # spread over its box
    assert files.pdf_items(made["k"])[0][3] == []
    assert exports.searchable(spark.createDataFrame([], f"job_id string, page_number int, width int, height int, image binary, regions {box}")).count() == 0


def test_fit_and_spacing():
    assert exports.fitted("", 10, 100) == 48 and exports.fitted("a", 1000, 2) == 4 and exports.fitted("wide text " * 20, 10, 40) == 4
    size = exports.fitted("Invoice 4821", 60, 40)
    assert exports.text_width("Invoice 4821", size) <= 60 < exports.text_width("Invoice 4821", size + 0.5)
    assert exports.text_width("é", 10) == exports.text_width("e", 10) == 5.56
    assert exports.spaced("a b c", 10, 100)[1] == 0 and exports.spaced("abc", 10, 100)[0] == 0 and exports.spaced("a", 10, 100) == (0.0, 0.0) and exports.spaced("abc", 10, 1) == (0.0, 0.0)


def test_images_of_pdf():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x05\x00\x07\x01\x01\x11\x00\xff\xd9"
    assert "/Width 7 /Height 5 /ColorSpace /DeviceGray" in exports._image(jpeg)[0]
    for bad in (None, b"", b"GIF89a", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n" + b"\0" * 30, b"\xff\xd8\xff\xc0"):
        assert exports._image(bad) is None


def test_transparent_png_is_laid_on_white():
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    pixels = b"\x00" + bytes([10, 20, 30, 255, 10, 20, 30, 0])
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    head, stream = exports._image(data)
    assert "/DeviceRGB" in head and zlib.decompress(stream) == bytes([10, 20, 30, 255, 255, 255])


def made_pdf() -> bytes:
    """A file whose fonts and pages lie in an object stream, with content arrays, arrays of strings, hex strings and a Unicode map."""
    inner = {5: b"<< /Type /Page /Parent 6 0 R /Contents [7 0 R 8 0 R] >>", 6: b"<< /Type /Pages /Kids [5 0 R] /Count 1 /MediaBox [0 0 300 400] /Resources << /Font << /F1 9 0 R /F2 10 0 R >> >> >>", 9: b"<< /Type /Font /Subtype /Type1 /FirstChar 65 /Widths [1000 500] >>", 10: b"<< /Type /Font /Subtype /Type0 /ToUnicode 11 0 R /DescendantFonts [<< /DW 1000 /W [1 [250 750]] >>] >>"}
    offsets, data = [], b""
    for n, value in inner.items():
        offsets.append(f"{n} {len(data)}")
        data += value + b" "
    head = " ".join(offsets).encode() + b" "
    packed = zlib.compress(head + data)
    cmap = b"beginbfchar <0001> <00e9> endbfchar 1 beginbfrange <0002> <0003> <0078> endbfrange"
    one = b"BT /F1 10 Tf 20 300 Td [(AB) -300 <4142>] TJ 0 -20 TD (a\\(b\\)\\101) Tj T* ET q 2 0 0 2 0 0 cm"
    two = b"BT /F2 10 Tf 1 0 0 1 10 50 Tm <000100020003> Tj ET Q"
    out = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 6 0 R >> endobj\n"
    out += b"4 0 obj << /Type /ObjStm /N 4 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    for n, s in ((7, one), (8, two), (11, cmap)):
        out += b"%d 0 obj << /Length 12 0 R >>\nstream\n%s\nendstream endobj\n" % (n, s)
    return out + b"%%EOF"


def test_pdf_reader():
    ((n, w, h, items),) = files.pdf_items(made_pdf())
    assert (n, w, h) == (1, 300.0, 400.0)
    assert [(i.text, i.x, i.y, i.size) for i in items] == [("AB AB", 20.0, 300.0, 10.0), ("a(b)A", 20.0, 280.0, 10.0), ("éxy", 20.0, 100.0, 20.0)]
    assert abs(items[0].width - (1.5 * 2 + 0.3) * 10) < 1e-9 and abs(items[2].width - (0.25 + 0.75 + 1.0) * 10 * 2) < 1e-9
    for bad in (b"", b"%PDF-1.4", b"%PDF-1.4 1 0 obj << /Type /Catalog /Pages 1 0 R >> endobj", b"%PDF-1.4 1 0 obj << /Type /Page /Contents 2 0 R >> endobj 2 0 obj << /Length 4 /Filter /FlateDecode >> stream\nabcd\nendstream endobj"):
        assert all(not i for *_, i in files.pdf_items(bad))


def test_native_text_is_judged_by_clean_regions(spark, tmp_path):
    """Long text whose boxes lie off the page is no native text."""
    off = [("a long line of native text", 900, 900, 12), ("another long line of text", 900, 880, 12)]
    on = [("a long line of native text", 40, 700, 12), ("another  long line of text", 40, 680, 12)]
    (tmp_path / "a.pdf").write_bytes(exports.pdf([(600, 800, off), (600, 800, on), (600, 800, on[:1])]))
    rows = files.pdf_pages(spark, f"{tmp_path}/*.pdf").orderBy("page_number").collect()
    assert [r["source_kind"] for r in rows] == ["scanned", "pdf-text", "scanned"] and rows[0]["regions"] is None
    assert rows[1]["text"] == "a long line of native text another long line of text"
    assert rows[1]["regions"][0]["x"] == 120.0 and rows[1]["regions"][0]["h"] == 36.0 and rows[1]["regions"][0]["y"] == (800 - 700 - 12) * 3


def test_stream_of_jobs_is_retained(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/kept"
    ddl = "id string, updated_at timestamp, expires_at timestamp"
    at = lambda d: datetime(2026, 1, d)
    batches = [[("a", at(1), at(31)), ("b", at(2), at(3)), ("c", at(3), None)], [("a", at(5), at(31)), ("d", at(4), at(31)), ("e", at(1), at(31))]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ddl).parquet(source)
        progress.retention(stream, path, f"{tmp_path}/state", 3, lambda: F.lit(at(10))).awaitTermination(60)
        got = sorted((r["id"], r["updated_at"].day) for r in progress.kept_jobs(spark, path, stream.schema).collect())
        assert got == ([("a", 1), ("c", 3)], [("a", 5), ("c", 3), ("d", 4)])[n]
    assert progress.kept_jobs(spark, f"{tmp_path}/none", stream.schema) is None
