"""Parsers of document formats with the standard library: bytes -> blocks and tier-0 candidates.

A block is (text, locator dict); a candidate is (subject, predicate, object, evidence).
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from typing import NamedTuple
from xml.etree import ElementTree


class Parsed(NamedTuple):
    blocks: list[tuple[str, dict]]
    candidates: list[tuple[str, str, str, str]] = []


def _text(data: bytes) -> str:
    return data.decode("utf-8", errors="replace")


def plain(data: bytes) -> Parsed:
    return Parsed([(_text(data), {"kind": "text"})])


class _Blocks(HTMLParser):
    """Text by block elements; what is inside skipped elements is lost."""

    #: Elements that are blocks of text, and elements that are passed over.
    BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "pre"}
    SKIPPED = {"script", "style", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.rest: list[str] = []
        self.open: list[tuple[str, list[str]]] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in self.BLOCKS:
            self.open.append((tag, []))

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS and any(t == tag for t, _ in self.open):
            while self.open:
                name, parts = self.open.pop()
                self._close(name, parts)
                if name == tag:
                    break

    def _close(self, tag, parts):
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text:
            self.found.append((tag, text))

    def handle_data(self, data):
        if not self.skip:
            self.rest.append(data)
            for _, parts in self.open:
                parts.append(data)

    def close(self):
        super().close()
        while self.open:
            self._close(*self.open.pop())


def html(data: bytes) -> Parsed:
    parser = _Blocks()
    parser.feed(_text(data))
    parser.close()
    if parser.found:
        return Parsed([(text, {"kind": "html", "element_index": i, "tag": tag}) for i, (tag, text) in enumerate(parser.found)])
    return Parsed([(re.sub(r"\s+", " ", " ".join(parser.rest)).strip(), {"kind": "html"})])


def pdf(data: bytes) -> Parsed:
    """Needs a PDF library, which is optional: the first of these that can be imported reads the pages."""
    for name in ("pypdf", "PyPDF2"):
        try:
            module = __import__(name)
        except ImportError:
            continue
        pages = [page.extract_text() or "" for page in module.PdfReader(io.BytesIO(data)).pages]
        return Parsed([(t, {"kind": "pdf", "page_index": i}) for i, t in enumerate(pages) if t.strip()])
    raise RuntimeError("reading PDF needs pypdf or PyPDF2, and neither is installed")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(root: ElementTree.Element, name: str) -> str:
    return "".join(e.text or "" for e in root.iter() if _local(e.tag) == name)


def docx(data: bytes) -> Parsed:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = [_texts(p, "t") for p in root.iter() if _local(p.tag) == "p"]
    return Parsed([(t, {"kind": "docx", "paragraph_index": i}) for i, t in enumerate(paragraphs) if t.strip()])


def pptx(data: bytes) -> Parsed:
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        texts = ["\n".join(_texts(p, "t") for p in ElementTree.fromstring(z.read(n)).iter() if _local(p.tag) == "p") for n in slides]
    return Parsed([(t, {"kind": "pptx", "slide_index": i}) for i, t in enumerate(texts) if t.strip()])


def lift(rows: list[list[str]]) -> list[tuple[str, str, str, str]]:
    """Cells under headers become claims about the row's first cell (or ``record_<n>``)."""
    if not rows:
        return []
    header, out = rows[0], []
    for n, row in enumerate(rows[1:]):
        if any(c.strip() for c in row):
            subject = row[0].strip() or f"record_{n}"
            out += [(subject, header[i], c.strip(), f"{header[i]}: {c.strip()}") for i, c in enumerate(row) if 0 < i < len(header) and c.strip()]
    return out


def xlsx(data: bytes) -> Parsed:
    column = lambda ref: sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(re.match(r"[A-Z]+", ref)[0]))) - 1
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_texts(s, "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"] if "xl/workbook.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
        blocks, candidates = [], []
        for k, name in enumerate(sheets):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter():
                if _local(row.tag) != "row":
                    continue
                cells: dict[int, str] = {}
                for at, c in enumerate(e for e in row if _local(e.tag) == "c"):
                    value = _texts(c, "v") or _texts(c, "t")
                    cells[column(c.get("r")) if c.get("r") else at] = shared[int(value)] if c.get("t") == "s" and value else value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            text = "\n".join("\t".join(r) for r in rows if any(x.strip() for x in r))
            if text:
                blocks.append((text, {"kind": "xlsx", "sheet_name": titles[k] if k < len(titles) else f"sheet{k + 1}"}))
            candidates += lift(rows)
    return Parsed(blocks, candidates)


def _table(delimiter: str) -> Callable[[bytes], Parsed]:
    def parse(data: bytes) -> Parsed:
        text = _text(data)
        return Parsed([(text, {"kind": "csv"})], lift(list(csv.reader(io.StringIO(text), delimiter=delimiter))))

    return parse


def json_text(data: bytes) -> Parsed:
    text = _text(data)
    try:
        text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        pass
    return Parsed([(text, {"kind": "json"})])


def xml(data: bytes) -> Parsed:
    return Parsed([(re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", _text(data))).strip(), {"kind": "xml"})])


def xbrl(data: bytes) -> Parsed:
    """Facts are elements with a context; the reporting entity is the subject."""
    root = ElementTree.fromstring(data)
    subject = next((e.text.strip()[:80] for e in root.iter() if _local(e.tag) in ("EntityRegistrantName", "identifier") and (e.text or "").strip()), "entity")
    out = []
    for e in root.iter():
        name = _local(e.tag)
        if e.get("contextRef") is None or name.lower() in ("context", "unit", "schemaref", "identifier", "period") or not (e.text or "").strip():
            continue
        predicate = re.sub(r"([a-z])([A-Z])", r"\1_\2", name).lower()
        value = e.text.strip() + (" USD" if "usd" in (e.get("unitRef") or "").lower() else "")
        out.append((subject, predicate, value, f"{name}: {value}"))
    return Parsed([("\n".join(c[3] for c in out), {"kind": "xbrl"})], out)


def ical(data: bytes) -> Parsed:
    text = re.sub(r"\r?\n[ \t]", "", _text(data))
    out, blocks = [], []
    for i, event in enumerate(re.findall(r"BEGIN:VEVENT(.*?)END:VEVENT", text, re.DOTALL)):
        fields = {}
        for line in event.splitlines():
            name, colon, value = line.partition(":")
            if colon:
                fields.setdefault(name.split(";")[0].upper(), value.strip())
        summary = fields.get("SUMMARY", "event")
        blocks.append((event.strip(), {"kind": "ical", "element_index": i}))
        for key, predicate in (("DTSTART", "scheduled_at"), ("LOCATION", "located_at")):
            if fields.get(key):
                out.append((summary, predicate, fields[key], f"{summary}: {fields[key]}"))
    return Parsed(blocks, out)


def rss(data: bytes) -> Parsed:
    """RSS items and Atom entries, published at their date, else their link."""
    out, blocks = [], []
    items = [e for e in ElementTree.fromstring(data).iter() if _local(e.tag) in ("item", "entry")]
    for i, item in enumerate(items):
        found = {_local(e.tag): (e.text or "").strip() or e.get("href", "") for e in item}
        title = found.get("title") or "item"
        text = found.get("description") or found.get("summary") or ""
        blocks.append((f"{title}\n{text[:200]}".strip(), {"kind": "rss", "element_index": i}))
        when = found.get("pubDate") or found.get("published") or found.get("updated") or found.get("link")
        if when:
            out.append((title, "published_at", when, f"{title}: {when}"))
    return Parsed(blocks, out)


#: Parser by file name extension.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    **dict.fromkeys((".txt", ".text", ".md", ".markdown", ".rst", ".log"), plain),
    **dict.fromkeys((".html", ".htm"), html),
    ".pdf": pdf,
    ".docx": docx,
    ".xlsx": xlsx,
    ".pptx": pptx,
    ".csv": _table(","),
    ".tsv": _table("\t"),
    ".json": json_text,
    ".xml": xml,
    ".xbrl": xbrl,
    ".ics": ical,
    **dict.fromkeys((".rss", ".atom"), rss),
}


def parse(name: str, data: bytes) -> Parsed:
    extension = "." + name.rpartition(".")[2].lower()
    if extension not in PARSERS:
        raise ValueError(f"{extension} is not supported")
    return PARSERS[extension](data)
