"""Format decoders: bytes to text, media type, extractor name and metadata.

``extract`` is plain Python, applied per row inside ``mapInArrow``; formats that need other programs call them
with bounded time and output, and only if they are installed.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import shutil
import signal
import subprocess
import tempfile
from dataclasses import dataclass, field
from html.parser import HTMLParser

from .inputs import InputError

# Converters by extension, media types by extension, and the first bytes of formats that are refused.
CONVERTERS = {"docx": "pandoc", "odt": "pandoc", "epub": "pandoc"} | dict.fromkeys("png jpg jpeg tif tiff bmp webp".split(), "tesseract")
MEDIA = {"html": "text/html", "htm": "text/html", "xhtml": "text/html", "md": "text/markdown", "markdown": "text/markdown", "json": "application/json", "xml": "application/xml", "ipynb": "application/x-ipynb+json"}
REFUSED = (b"PK\x03\x04", b"\x7fELF", b"\x1f\x8b", b"SQLite format 3\x00")
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


@dataclass
class Extracted:
    text: str
    media_type: str
    extractor: str
    metadata: dict = field(default_factory=dict)


def decode(data: bytes) -> str:
    """Text by byte-order mark, else UTF-8, else Latin-1 (Windows); NULs and more than 1 % control characters are binary."""
    for mark, name in BOMS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    if b"\0" in data[:8192]:
        raise InputError("binary_input")
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    odd = sum(1 for c in text if (ord(c) < 32 or 127 <= ord(c) < 160) and c not in "\n\r\t\f")
    if odd * 100 > len(text):
        raise InputError("binary_input")
    return text


class _Tree(HTMLParser):
    """Text nodes with the elements they are in; roots are articles and main elements."""

    SKIP = frozenset("script style noscript template head nav footer".split())
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, tuple[int, ...]]] = []
        self.nodes: list[tuple[str, bool, tuple[int, ...]]] = []
        self.roots = 0
        self.title: str | None = None
        self._in_title = False

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        a = dict(attrs)
        skip, roots = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, ())
        if tag in ("article", "main") or (a.get("role") or "").lower() == "main":
            self.roots += 1
            roots = (*roots, self.roots)
        self.stack.append((tag, skip or tag in self.SKIP or "hidden" in a or a.get("aria-hidden") == "true", roots))
        self._in_title = tag == "title" and self.title is None

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass
        self._in_title = False

    def handle_data(self, data):
        if self._in_title:
            self.title = ((self.title or "") + data).strip()
        skip, roots = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (False, ())
        self.nodes.append((data, skip, roots))


def html_text(source: str) -> tuple[str, str | None]:
    """The text of the longest main region by raw bytes (the whole page if there is none), a line per text node, and the title."""
    tree = _Tree()
    tree.feed(source)
    tree.close()
    size = [0] * (tree.roots + 1)
    for text, _, roots in tree.nodes:
        for r in roots:
            size[r] += len(text.encode())
    root = max(range(1, tree.roots + 1), key=lambda r: (size[r], -r)) if tree.roots else 0
    lines = [t.strip() for t, skip, roots in tree.nodes if not skip and t.strip() and (not root or root in roots)]
    return "".join(f"{x}\n" for x in lines), tree.title or None


def notebook_text(source: str) -> tuple[str, dict]:
    """Code, markdown and raw cells, two line breaks after each; ranges in bytes leave those out, outputs are not read."""
    parts, cells, at = [], [], 0
    for number, cell in enumerate(json.loads(source).get("cells", [])):
        if cell.get("cell_type") not in ("code", "markdown", "raw"):
            continue
        body = cell.get("source", "")
        body = "".join(body) if isinstance(body, list) else body
        size = len(body.encode())
        cells.append({"cell": number, "byte_start": at, "byte_end": at + size})
        parts.append(body + "\n\n")
        at += size + 2
    return "".join(parts), {"cells": cells}


def run_bounded(argv: list[str], stdin: bytes | None = None, timeout: float = 60, most: int = 64 << 20) -> bytes:
    """A program's output: no shell, its process group ends with the time, output above the bound is an error."""
    with tempfile.TemporaryFile() as out:
        p = subprocess.Popen(argv, stdin=subprocess.PIPE if stdin is not None else subprocess.DEVNULL, stdout=out, stderr=subprocess.DEVNULL, start_new_session=True)
        try:
            p.communicate(stdin, timeout)
        except subprocess.TimeoutExpired:
            os.killpg(p.pid, signal.SIGKILL)
            p.wait()
            raise InputError(f"extractor_timeout: {argv[0]}") from None
        if p.returncode:
            raise InputError(f"input_failed: {argv[0]} ended with {p.returncode}")
        if out.tell() > most or os.fstat(out.fileno()).st_size > most:
            raise InputError("size_limit: output")
        out.seek(0)
        return out.read()


def page_count(info: str) -> int:
    """The number after ``Pages:`` in a document's description."""
    m = re.search(r"^Pages:\s*([0-9]+)\s*$", info, re.M)
    if not m or int(m[1]) < 1:
        raise InputError("unsupported: no page count")
    return int(m[1])


def pdf_pages(text: str, pages: int, ocr) -> tuple[str, dict]:
    """Pages that a form feed ends, blank ones through ``ocr(number)``; ranges in bytes leave the form feeds out."""
    parts = text.split("\f")[:-1] if text.endswith("\f") else text.split("\f")
    if len(parts) != pages:
        raise InputError(f"unsupported: {len(parts)} of {pages} pages")
    out, ranges, at = [], [], 0
    for number, body in enumerate(parts, 1):
        blank = not body.strip()
        body = ocr(number) if blank and ocr else body
        size = len(body.encode())
        ranges.append({"page": number, "byte_start": at, "byte_end": at + size, "ocr": blank and bool(body.strip())})
        out.append(body + "\f")
        at += size + 1
    if not any(b.strip() for b in out):
        raise InputError("unsupported: no text on any page")
    return "".join(out), {"pages": ranges}


def _pdf(data: bytes, timeout: float) -> Extracted:
    if not shutil.which("pdftotext") or not shutil.which("pdfinfo"):
        raise InputError("missing_extractor: pdftotext")
    with tempfile.NamedTemporaryFile(suffix=".pdf") as f:
        f.write(data)
        f.flush()
        pages = page_count(run_bounded(["pdfinfo", f.name], timeout=timeout).decode("utf-8", "replace"))
        text = run_bounded(["pdftotext", "-enc", "UTF-8", f.name, "-"], timeout=timeout).decode("utf-8", "replace")

        def ocr(number: int) -> str:
            with tempfile.TemporaryDirectory() as d:
                run_bounded(["pdftoppm", "-r", "200", "-f", str(number), "-l", str(number), "-png", f.name, f"{d}/p"], timeout=timeout)
                return "".join(run_bounded(["tesseract", f"{d}/{x}", "-"], timeout=timeout).decode("utf-8", "replace") for x in sorted(os.listdir(d)))

        text, meta = pdf_pages(text, pages, ocr if shutil.which("tesseract") and shutil.which("pdftoppm") else None)
    return Extracted(text, "application/pdf", "pdf", meta)


def external(data: bytes, extension: str, argv: list[str], timeout: float = 60) -> str:
    """A configured program on a copy of the bytes; ``{path}`` in its arguments is that copy."""
    if not shutil.which(argv[0]):
        raise InputError(f"missing_extractor: {argv[0]}")
    if not re.fullmatch(r"[A-Za-z0-9]{0,16}", extension):
        raise InputError("unsupported: extension")
    with tempfile.TemporaryDirectory() as d:
        path = os.path.join(d, f"input.{extension or 'bin'}")
        with open(path, "wb") as f:
            f.write(data)
        return run_bounded([a.replace("{path}", path) for a in argv], timeout=timeout).decode("utf-8", "replace")


def extract(data: bytes, extension: str, custom: dict[str, list[str]] | None = None, timeout: float = 60) -> Extracted:
    """Custom extractors first, then PDF by its first bytes or name, converters by extension, refused formats, then text."""
    extension = extension.lower()
    if custom and extension in custom:
        return Extracted(external(data, extension, custom[extension], timeout), "application/octet-stream", f"external:{custom[extension][0]}")
    if data.startswith(b"%PDF-") or extension == "pdf":
        return _pdf(data, timeout)
    if extension in CONVERTERS:
        program = CONVERTERS[extension]
        argv = ["pandoc", "--to=plain", "{path}"] if program == "pandoc" else ["tesseract", "{path}", "-"]
        return Extracted(external(data, extension, argv, timeout), "application/octet-stream", program)
    if data.startswith(REFUSED):
        raise InputError("unsupported: format")
    text = decode(data)
    media = MEDIA.get(extension, "text/plain")
    if media == "text/html":
        body, title = html_text(text)
        return Extracted(body, media, "html", {"title": title} if title else {})
    if extension == "ipynb":
        body, meta = notebook_text(text)
        return Extracted(body, media, "notebook", meta)
    return Extracted(text, media, "text")


SCHEMA = "source_root_id string, uri string, extension string, modified_ns string, content_hash string, size_bytes long, text string, media_type string, extractor string, metadata string, error string"


def extracted(items, most: int = 64 << 20, custom: dict[str, list[str]] | None = None):
    """Items (see ``inputs.items``) read and extracted; a failure is a message in ``error``, and the row stays.

    A column ``known`` (content_hash, media_type, extractor, metadata) may tell what was extracted before: bytes with that hash, and
    items whose own metadata is as it was, are not extracted again, and have no text.
    """
    import hashlib

    import pyarrow as pa

    from .inputs import read_stable

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                row = {k: r.get(k) for k in ("source_root_id", "uri", "extension", "modified_ns")} | dict.fromkeys(names[4:10]) | {"error": None}
                try:
                    data = r["content"] if r["content"] is not None else read_stable(r["path"], most)
                    if len(data) > most:
                        raise InputError("size_limit")
                    row |= {"content_hash": hashlib.sha256(data).hexdigest(), "size_bytes": len(data)}
                    own, before = json.loads(r["metadata"] or "{}"), r.get("known") or {}
                    if before.get("content_hash") == row["content_hash"] and own.items() <= json.loads(before["metadata"] or "{}").items():
                        rows.append(row | {k: before[k] for k in ("media_type", "extractor", "metadata")})
                        continue
                    x = extract(data, r["extension"] or "", custom)
                    meta = x.metadata | own
                    row |= {"text": x.text, "media_type": x.media_type, "extractor": x.extractor, "metadata": json.dumps(meta, sort_keys=True)}
                except Exception as e:  # noqa: BLE001  any failure belongs to its row
                    row["error"] = str(e) or type(e).__name__
                rows.append(row)
            out = pa.Table.from_pylist(rows, schema=pa.schema([(n, pa.int64() if n == "size_bytes" else pa.string()) for n in names]))
            yield from out.to_batches()

    return items.mapInArrow(run, SCHEMA)
