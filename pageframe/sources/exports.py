"""Files made of pages: DOCX, searchable PDF, and JSON and Markdown reports."""

from __future__ import annotations

import io
import math
import re
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageframe.functions import geometry as geo
from pageframe.functions.text import BULLET, NUMBERED
from pageframe.operators import layout
from pageframe.operators.pixels_numpy import unfiltered

_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
)
_RELATIONS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


_RELATIONS_OF_TEXT = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="n1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="numbering.xml"/><Relationship Id="s1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>'


def _numbering() -> str:
    """Two lists: marks (1) and numbers (2)."""
    kinds = (("bullet", "•"), ("decimal", "%1."))
    levels = "".join(f'<w:abstractNum w:abstractNumId="{k}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl></w:abstractNum>' for k, (f, t) in enumerate(kinds))
    uses = "".join(f'<w:num w:numId="{k + 1}"><w:abstractNumId w:val="{k}"/></w:num>' for k in range(len(kinds)))
    return f'<w:numbering xmlns:w="{_WORD}">{levels}{uses}</w:numbering>'


def _styles() -> str:
    """Two levels of headings."""
    one = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/></w:rPr></w:style>' for k in (1, 2))
    return f'<w:styles xmlns:w="{_WORD}">{one}</w:styles>'


def half_points(height: float | None) -> int:
    """F21 of one box."""
    return max(16, math.floor((height or 0.0) * 1.5 + 0.5))


def _run(text: str, size: int | None = None, bold: bool = False) -> str:
    clean = "".join(c for c in text if (c >= " " or c in "\t\n") and not "\ud800" <= c <= "\udfff" and c not in "\ufffe\uffff")
    look = ("<w:b/>" if bold else "") + (f'<w:sz w:val="{size}"/>' if size else "")
    return f'<w:r>{f"<w:rPr>{look}</w:rPr>" if look else ""}<w:t xml:space="preserve">{escape(clean)}</w:t></w:r>'


def _paragraph(block: dict, median: float) -> str:
    """F20 of a block that is no table row."""
    kind, text, height = block["kind"], block["text"] or "", block.get("height")
    size = half_points(height) if height is not None else None
    if kind in ("bullet", "numbered"):
        mark = BULLET if kind == "bullet" else NUMBERED
        place = f'<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="{1 if kind == "bullet" else 2}"/></w:numPr><w:spacing w:after="80"/></w:pPr>'
        return f"<w:p>{place}{_run(re.sub(_python_pattern(mark), '', text, count=1), size)}</w:p>"
    heading = kind == "heading"
    cells = block.get("cells")
    runs = [_run(f"{c['text'] or ''} ", half_points(c["h"]), heading) for c in cells] if cells else [_run(text, size, heading)]
    level = 1 if heading and (height or 0.0) > 2 * median else 2
    look = f'<w:pStyle w:val="Heading{level}"/><w:spacing w:after="160"/>' if heading else '<w:spacing w:after="120"/>'
    return f"<w:p><w:pPr>{look}</w:pPr>{''.join(runs)}</w:p>"


def _table(rows: list[dict], width: float) -> str:
    """A run of table rows, each padded to as many cells as the widest has."""
    most = max((len(r.get("cells") or [r]) for r in rows), default=1)
    share = math.floor(width / most * 0.75 * 20 + 0.5)
    edges = "".join(f'<w:{e} w:val="single" w:sz="1" w:color="CCCCCC"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    out = []
    for r in rows:
        texts = [c["text"] or "" for c in r["cells"]] if r.get("cells") else [r["text"] or ""]
        size = half_points(r.get("height"))
        cells = [f'<w:tc><w:tcPr><w:tcW w:w="{share}" w:type="dxa"/></w:tcPr><w:p>{_run(t, size)}</w:p></w:tc>' for t in [*texts, *[""] * (most - len(texts))]]
        out.append(f"<w:tr>{''.join(cells)}</w:tr>")
    return f'<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/><w:tblBorders>{edges}</w:tblBorders></w:tblPr><w:tblGrid>{f"<w:gridCol w:w={chr(34)}{share}{chr(34)}/>" * most}</w:tblGrid>{"".join(out)}</w:tbl>'


def _python_pattern(pattern: str) -> str:
    """A pattern of the JVM in Python's spelling."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m.group(1).rjust(4, "0"), pattern)


def docx(sections: list[list[tuple | dict]], median: float = 20.0, width: float = 1000.0) -> bytes:
    """A document of one section a page.

    A block is (kind, text) or a mapping with ``kind``, ``text`` and, if they are
    known, ``height``, ``cells`` (text and h of its regions), ``median`` and
    ``width`` of its page. A heading of over twice the median's height is of the
    first level, others of the second; items lose their marks and become lists;
    table rows that follow each other are one table. No pages give a document
    with one empty section.
    """
    body = []
    for k, blocks in enumerate(sections or [[]]):
        known = [b if isinstance(b, dict) else {"kind": b[0], "text": b[1]} for b in blocks]
        parts = []
        for table, some in groupby(known, key=lambda b: b["kind"] == "table-row"):
            rows = list(some)
            if table:
                parts.append(_table(rows, rows[0].get("width") or width))
            else:
                parts += [_paragraph(b, b.get("median") or median) for b in rows]
        # a section must end in a paragraph
        if not parts or parts[-1].startswith("<w:tbl>"):
            parts.append("<w:p/>")
        body += parts
        if k < len(sections) - 1:
            body.append('<w:p><w:pPr><w:sectPr><w:type w:val="nextPage"/></w:sectPr></w:pPr></w:p>')
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    files = {
        "[Content_Types].xml": _TYPES, "_rels/.rels": _RELATIONS, "word/_rels/document.xml.rels": _RELATIONS_OF_TEXT, "word/numbering.xml": head + _numbering(), "word/styles.xml": head + _styles(),
        "word/document.xml": f'{head}<w:document xmlns:w="{_WORD}"><w:body>{"".join(body)}<w:sectPr/></w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


# The widths of the printable ASCII characters in Helvetica, from the space on.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)


@lru_cache(maxsize=65_536)
def _character_width(c: str) -> int:
    base = unicodedata.normalize("NFD", c)[0]
    return HELVETICA[ord(base) - 32] if " " <= base <= "~" else 556


def text_width(text: str, size: float) -> float:
    """The width of a text in Helvetica, without kerning; a letter with an accent is as wide as without, what isn't known as a figure."""
    return sum(map(_character_width, text)) * size / 1000


def fitted(text: str, width: float, height: float) -> float:
    """the font size by the box' height, from 4 to 48, less by halves while the text is wider than the box."""
    size = max(4.0, min(48.0, height * 0.85))
    if not text.strip():
        return size
    width = max(width, 1.0)
    natural = text_width(text, 1.0)
    if natural * size > width:
        size -= 0.5 * math.ceil((natural * size - width) / natural / 0.5 - 1e-9)
    return max(4.0, min(48.0, size))


def spaced(text: str, size: float, width: float) -> tuple[float, float]:
    """what spaces, else characters, are set apart so that the text is as wide as its box."""
    extra = width - text_width(text, size)
    if extra <= 0:
        return 0.0, 0.0
    spaces = text.count(" ")
    return (extra / spaces, 0.0) if spaces else (0.0, extra / (len(text) - 1) if len(text) > 1 else 0.0)


def drawn(regions: list[dict], width: float, height: float) -> list[tuple[str, float, float, float, float, float]]:
    """Text, x, baseline, size and spacings of the regions of a page; impossible boxes and blank texts are left out."""
    out = []
    for r in regions:
        box = [r[k] for k in "xywh"]
        text = (r["text"] or "").strip()
        if not text or any(v is None or not math.isfinite(v) for v in box) or box[2] <= 0 or box[3] <= 0:
            continue
        x, y = max(0.0, min(width, box[0])), max(0.0, min(height, box[1]))
        w, h = min(width - x, box[2]), min(height - y, box[3])
        if w <= 0 or h <= 0:
            continue
        size = fitted(text, w, h)
        out.append((text, x, max(0.0, min(height, height - y - h + size * 0.2)), size, *spaced(text, size, w)))
    return out


def _image(data: bytes | None) -> tuple[str, bytes] | None:
    """Dictionary and stream of an image object, of a PNG, else of a JPEG file; None for what is neither."""
    if not data:
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png_object(data)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            size = int.from_bytes(data[at + 2 : at + 4])
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w, n = int.from_bytes(data[at + 5 : at + 7]), int.from_bytes(data[at + 7 : at + 9]), data[at + 9]
                space = {1: "/DeviceGray", 3: "/DeviceRGB", 4: "/DeviceCMYK"}.get(n)
                return (f"/Width {w} /Height {h} /ColorSpace {space} /BitsPerComponent 8 /Filter /DCTDecode", data) if space and w and h else None
            at += 2 + size
    return None


def _png_object(data: bytes) -> tuple[str, bytes] | None:
    """Gray, colour and palette images keep their deflated rows, those with transparency are laid on white; interlaced ones are no case."""
    at, rows, palette = 8, b"", b""
    head = None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            return None
        head = body if kind == b"IHDR" and size == 13 else head
        palette = body if kind == b"PLTE" else palette
        rows += body if kind == b"IDAT" else b""
        at += size + 12
    if head is None or not rows or head[12]:
        return None
    w, h, bits, kind = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), head[8], head[9]
    if kind in (4, 6) and bits == 8 and w and h:
        n = 2 if kind == 4 else 4
        try:
            a = np.frombuffer(unfiltered(zlib.decompress(rows), w * n, n), np.uint8)[: w * h * n].reshape(-1, n).astype(int)
        except (zlib.error, ValueError, IndexError):
            return None
        flat = (a[:, :-1] * a[:, -1:] + 255 * (255 - a[:, -1:]) + 127) // 255
        return f"/Width {w} /Height {h} /ColorSpace {'/DeviceGray' if kind == 4 else '/DeviceRGB'} /BitsPerComponent 8 /Filter /FlateDecode", zlib.compress(flat.astype(np.uint8).tobytes())
    space = {0: "/DeviceGray", 2: "/DeviceRGB", 3: f"[/Indexed /DeviceRGB {len(palette) // 3 - 1} <{palette.hex()}>]" if palette else None}.get(kind)
    colors = 3 if kind == 2 else 1
    return (f"/Width {w} /Height {h} /ColorSpace {space} /BitsPerComponent {bits} /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors {colors} /BitsPerComponent {bits} /Columns {w} >>", rows) if space and w and h else None


def pdf(pages: list[tuple], visible: bool = False) -> bytes:
    """Pages of (width, height, texts) with invisible text over an image.

    A text is (text, x, baseline, size), perhaps with word and character spacing.
    ``visible`` shows it. A fourth element of a page lists filled boxes as
    (x, y, width, height, gray); a fifth is the page's image, a PNG or JPEG file,
    without which, or with another, the page stays blank. Characters outside of
    the standard font's encoding become question marks.
    """
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    objects[2] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 32 /Widths [%s] >>" % " ".join(map(str, HELVETICA)).encode()
    kids = []
    for width, height, texts, *more in pages:
        boxes, image = (more[0] if more else ()), _image(more[1]) if len(more) > 1 else None
        lines = []
        if image:
            objects.append(b"<< /Type /XObject /Subtype /Image %s /Length %d >>\nstream\n%s\nendstream" % (image[0].encode(), len(image[1]), image[1]))
            lines.append(f"q {width:g} 0 0 {height:g} 0 0 cm /I1 Do Q")
        drawing = f" /XObject << /I1 {len(objects)} 0 R >>" if image else ""
        lines += [f"{gray:.2f} g {x:.2f} {y:.2f} {w:.2f} {h:.2f} re f" for x, y, w, h, gray in boxes]
        lines += ["0 g", f"BT {0 if visible else 3} Tr"]
        for text, x, y, size, *spacing in texts:
            raw = text.encode("cp1252", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").replace("\r", r"\r").replace("\n", r"\n")
            words, letters = spacing or (0.0, 0.0)
            apart = f"{words:.4f} Tw {letters:.4f} Tc " if spacing else ""
            lines.append(f"{apart}/F1 {size:.2f} Tf 1 0 0 1 {x:.2f} {y:.2f} Tm ({raw}) Tj")
        stream = zlib.compress("\n".join([*lines, "ET"]).encode("latin-1"))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream))
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width:g} {height:g}] /Resources << /Font << /F1 3 0 R >>{drawing} >> /Contents {len(objects)} 0 R >>".encode())
        kids.append(f"{len(objects)} 0 R")
    objects[1] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode()
    out, at = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


#: Pages in one written file; a job with more has several, so that no task holds all pages of any job.
VOLUME = 2000


def _files(pages: DataFrame, job: str, name: str, make: Callable[[list[dict]], bytes]) -> DataFrame:
    """One file a job and ``volume`` (from 0) of rows with ``page_number``; rows are sorted by their fields after it."""
    rest = [c for c in pages.columns if c not in (job, "page_number")]
    volume = F.floor(F.greatest(F.col("page_number") - 1, F.lit(0)) / VOLUME).cast("int").alias("volume")
    gathered = pages.groupBy(job, volume).agg(F.collect_list(F.struct("page_number", *rest)).alias("_rows"))
    kind = gathered.schema[job].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(rows) for rows in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=[job, "volume", name])

    return gathered.mapInArrow(run, f"{job} {kind}, volume int, {name} binary")


def documents(blocks: DataFrame, job: str = "job_id") -> DataFrame:
    """K02 over a table of (job, page_number, block_no, kind, text), perhaps with ``height``, ``cells``, ``median`` and ``width``: job, ``volume``, ``docx``.

    Jobs without blocks have no row.
    """

    def make(rows: list[dict]) -> bytes:
        sections: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["page_number"], r["block_no"])):
            sections.setdefault(r["page_number"], []).append(r | {"kind": r["kind"] or "body"})
        return docx(list(sections.values()))

    return _files(blocks, job, "docx", make)


def searchable(pages: DataFrame, job: str = "job_id") -> DataFrame:
    """K03, J02 over a table of (job, page_number, width, height, image, regions): job, ``volume``, ``pdf``.

    A page is its image with its regions' text, unseen, over it, column by column
    and line by line; without regions it is the image only, and without an image
    that can be embedded blank below the text. Pages without a size have none.
    """
    box = "array<struct<text:string,x:double,y:double,w:double,h:double>>"
    plain = pages.where("width > 0 and height > 0").withColumns({c: F.col(c).cast("double") for c in ("width", "height")})
    fit = F.filter(F.coalesce("regions", F.array()), lambda r: geo.finite(r["x"]) & geo.finite(r["y"]) & geo.finite(r["w"]) & geo.finite(r["h"]))
    named = plain.withColumn("regions", F.transform(fit, lambda r: F.struct(*(r[k].alias(k) for k in ("text", "x", "y", "w", "h")))).cast(box))
    # the order is worked out on a narrow table, so that images are shuffled once, to their file
    keys = [job, "page_number"]
    placed = layout.order_by_columns(named.select(*keys, "regions", "width"), "regions", "width").groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "region"))), lambda r: r["region"]).alias("ordered"))
    ready = named.drop("regions").join(placed, keys, "left").select(*keys, "width", "height", "image", "ordered")

    def make(rows: list[dict]) -> bytes:
        out = []
        for r in sorted(rows, key=lambda r: r["page_number"]):
            lines = layout.lines_in_given_order(r["ordered"] or [])
            out.append((r["width"], r["height"], drawn([x for line in lines for x in line], r["width"], r["height"]), (), r["image"]))
        return pdf(out)

    return _files(ready, job, "pdf", make)


def json_lines(df: DataFrame) -> DataFrame:
    """A row of text a row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def markdown_rows(*columns: Column) -> Column:
    """A row of a table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(c.cast("string") for c in columns)), F.lit(" |"))


def write_by_engine(df: DataFrame, path: str, engine: str = "engine") -> None:
    """Results in one folder an engine."""
    df.write.mode("overwrite").partitionBy(engine).json(path)


def filled_lines(text: str, width: float, size: float) -> list[str]:
    """F25 by measured width: words filled into lines; blank paragraphs stay, a word that is wider has its own line."""
    out = []
    for paragraph in text.split("\n"):
        line = ""
        for word in paragraph.split():
            if line and text_width(f"{line} {word}", size) > width:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        out.append(line)
    return out


def quality_report(rows: list[dict], title: str, label: str = "engine", rates: tuple[str, str] = ("char_accuracy", "word_accuracy"), table: tuple[list[str], list[list[str]]] | None = None, samples: list[tuple[str, str]] | None = None) -> bytes:
    """A PDF of a benchmark: bars, a table, and recognised texts, as many pages as it takes.

    ``rows`` are those of a summary, an engine each, with two bars each; null
    accuracies count as 0. ``table`` is a head and rows of cells, whose columns
    are as wide as their widest cell, scaled to the page where that is more.
    ``samples`` are names and texts, which stand in gray blocks. Without rows one
    page says so.
    """
    width, height, margin, step, track = 595.0, 842.0, 48.0, 46.0, 260.0
    content = width - 2 * margin
    per_page = int((height - 3 * margin) // step)
    pages: list[tuple[list, list]] = []
    for start in range(0, max(1, len(rows)), per_page):
        texts: list[tuple[str, float, float, float]] = [(title, margin, height - margin, 16)]
        boxes: list[tuple[float, float, float, float, float]] = []
        if not rows:
            texts.append(("No results.", margin, height - 2 * margin, 10))
        for k, r in enumerate(rows[start : start + per_page]):
            y = height - 2 * margin - k * step
            texts.append((str(r[label]), margin, y, 11))
            for n, name in enumerate(rates):
                share = min(1.0, max(0.0, float(r[name] or 0.0)))
                at = y - 13 - 12 * n
                texts.append((f"{name.replace('_', ' ')} {share * 100:.2f}%", margin, at, 8))
                boxes += [(margin + 150, at - 1, track, 8, 0.9), (margin + 150, at - 1, track * share, 8, 0.4)]
        pages.append((texts, boxes))
    # what follows is a sequence of lines: (cells with their places, size, gray behind)
    lines: list[tuple[list[tuple[str, float]], float, float | None]] = []
    if table:
        head, body = table
        every = [head, *body]
        wide = [max((text_width(str(r[c]) if c < len(r) else "", 8) for r in every), default=0.0) + 10 for c in range(max(map(len, every), default=0))]
        scale = min(1.0, content / sum(wide)) if wide else 1.0
        places = [margin + sum(wide[:c]) * scale for c in range(len(wide))]
        lines += [([(str(x), places[c]) for c, x in enumerate(r)], 8 * scale if scale < 1 else 8.0, 0.85 if n == 0 else None) for n, r in enumerate(every)]
        lines.append(([], 8.0, None))
    for name, text in samples or ():
        lines.append(([(name, margin)], 11.0, None))
        lines += [([(x, margin + 6)], 8.0, 0.95) for x in filled_lines(text, content - 12, 8.0)] + [([], 8.0, None)]
    room = int((height - 2.5 * margin) // 13)
    for start in range(0, len(lines), room):
        texts, boxes = [], []
        for k, (cells, size, gray) in enumerate(lines[start : start + room]):
            y = height - 1.5 * margin - 13 * k
            texts += [(x, at, y, size) for x, at in cells if x]
            boxes += [(margin, y - 3, content, 13, gray)] if gray is not None else []
        pages.append((texts, boxes))
    return pdf([(width, height, [*texts, (f"Page {k}", width - 2 * margin, margin / 2, 8)], boxes) for k, (texts, boxes) in enumerate(pages, 1)], visible=True)
