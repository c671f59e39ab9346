"""Text of simple PDF files, page by page, with the standard library alone.

Reads classic and compressed objects, page trees, Flate streams, literal and hex strings, and fonts' ToUnicode maps.
Encrypted files and other filters aren't read; a file without a text layer has no text, and nothing recognises
characters in images.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift between strings of more than this (in thousandths of the font size) is read as a blank.
GAP = 180


class PdfError(ValueError):
    pass


def _literal(raw: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        v = m.group(1)
        if v[:1].isdigit():
            return bytes([int(v, 8) & 255])
        return _ESCAPES.get(v, b"" if v in (b"\n", b"\r\n", b"\r") else v)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, raw[1:-1], flags=re.S)


def _hex(raw: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", raw[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class _File:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise PdfError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("the file is encrypted")
        self.objects: dict[int, bytes] = {int(n): body for n, _, body in _OBJECT.findall(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm", body):
                inner = self.stream(body)
                first = int(re.search(rb"/First\s+(\d+)", body)[1])
                heads = list(map(int, inner[:first].split()))
                places = list(zip(heads[::2], heads[1::2], strict=False))
                for i, (number, at) in enumerate(places):
                    end = places[i + 1][1] if i + 1 < len(places) else len(inner) - first
                    self.objects.setdefault(number, inner[first + at : first + end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        head = body[: m.start()]
        if b"/FlateDecode" in head:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error as e:
                raise PdfError("a stream is broken") from e
        return b"" if b"/Filter" in head else m[1]

    def entry(self, body: bytes, key: bytes) -> bytes:
        """What stands after a key of a dictionary; a reference is followed."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        ref = _REF.match(rest)
        return self.objects.get(int(ref[1]), b"") if ref else rest

    def refs(self, body: bytes, key: bytes) -> list[int]:
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(n) for n in _REF.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        """Page dictionaries in reading order."""
        catalog = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []
        stack, seen = self.refs(catalog, b"Pages"), set()
        while stack:
            n = stack.pop()
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            if re.search(rb"/Type\s*/Pages", body):
                stack += reversed(self.refs(body, b"Kids"))
            elif body:
                out.append(body)
        return out

    def maps(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """ToUnicode maps of the page's fonts, by name: bytes of a code, and its texts."""
        found = {}
        fonts = self.entry(self.entry(page, b"Resources") or page, b"Font")
        for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts.split(b">>")[0]):
            ref = self.refs(self.objects.get(int(n), b""), b"ToUnicode")
            if ref:
                found[b"/" + name] = _cmap(self.stream(self.objects.get(ref[0], b"")))
        return found


def _cmap(text: bytes) -> tuple[int, dict[int, str]]:
    table: dict[int, str] = {}
    width = 1
    decode = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(a) // 2
            table[int(a, 16)] = decode(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
        for a, z, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(a) // 2
            for i in range(int(a, 16), min(int(z, 16), int(a, 16) + 65535) + 1):
                table[i] = decode(b"%0*x" % (len(b), int(b, 16) + i - int(a, 16)))
    return width, table


def _shown(raw: bytes, cmap: tuple[int, dict[int, str]] | None) -> str:
    if cmap is None:
        return raw.decode("cp1252", "replace")
    width, table = cmap
    return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def _page_text(content: bytes, maps: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    font = None
    for t in _TOKEN.findall(content):
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            stack.append(t)
            continue
        if t == b"Tf" and len(stack) >= 2:
            font = maps.get(stack[-2])
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            if t in (b"'", b'"'):
                out.append("\n")
            for s in stack:
                if s[:1] == b"(":
                    out.append(_shown(_literal(s), font))
                elif s[:1] == b"<":
                    out.append(_shown(_hex(s), font))
                elif t == b"TJ" and s not in (b"[", b"]") and s[:1] != b"/" and float(s) < -GAP:
                    out.append(" ")
        elif t in (b"Td", b"TD", b"T*", b"Tm", b"ET") and out and out[-1] != "\n":
            flat = t in (b"Td", b"TD") and len(stack) >= 1 and re.fullmatch(rb"[-+]?0*\.?0*", stack[-1])
            out.append(" " if flat else "\n")
        stack.clear()
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def pdf_pages(data: bytes) -> list[dict]:
    """Sections of a PDF file: one for each page with text, with its number from 1."""
    f = _File(data)
    out = []
    for number, page in enumerate(f.pages(), 1):
        content = b"\n".join(f.stream(f.objects.get(n, b"")) for n in f.refs(page, b"Contents"))
        text = _page_text(content, f.maps(page))
        if text:
            out.append({"content": text, "heading": None, "page_number": number})
    return out
