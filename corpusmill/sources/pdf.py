"""A text-layer reader of PDF files: objects, page tree, character maps, lines of text with places.

Reads plain and deflated streams and object streams of files that aren't encrypted.  Fonts without a
character map read as Latin-1, unless a map is given for them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>{}%]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise ValueError("no PDF")
        if re.search(rb"/Encrypt\b", content):
            raise ValueError("encrypted")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._expand(body)

    def stream(self, body: bytes) -> bytes:
        """The decoded stream of an object; empty where there is none or its filter isn't read."""
        m = re.search(rb"stream\r?\n(.*?)\r?\nendstream", body, re.S) or re.search(rb"stream\r?\n(.*)endstream", body, re.S)
        if not m:
            return b""
        head = body[: m.start()]
        if b"FlateDecode" in head:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return b"" if b"/Filter" in head else m[1]

    def _expand(self, body: bytes) -> None:
        data = self.stream(body)
        n, first = self.number(body, b"N"), self.number(body, b"First")
        places = list(map(int, data[:first].split()))[: 2 * n]
        cuts = [*places[1::2], len(data) - first]
        for k, number in enumerate(places[::2]):
            self.objects.setdefault(number, data[first + cuts[k] : first + cuts[k + 1]])

    def number(self, body: bytes, key: bytes) -> int:
        m = re.search(rb"/" + key + rb"\s+(\d+)", body)
        return int(m[1]) if m else 0

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Objects that a key refers to, one or a list."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def pages(self) -> list[int]:
        """Page objects in reading order; a node that comes again ends its branch."""
        roots = [k for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b) for k in self.refs(b, b"Pages")]
        out, seen = [], set()

        def walk(k: int) -> None:
            if k in seen or k not in self.objects:
                return
            seen.add(k)
            body = self.objects[k]
            if re.search(rb"/Type\s*/Page\b(?!s)", body):
                out.append(k)
            for kid in self.refs(body, b"Kids"):
                walk(kid)

        for r in roots:
            walk(r)
        return out

    def info(self) -> dict[str, str]:
        """Title, author and the like of the document, from plain, hexadecimal or UTF-16 strings."""
        found = {}
        for body in self.objects.values():
            for m in re.finditer(rb"/(Title|Author|Subject|Keywords|Creator|Producer|CreationDate)\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", body, re.S):
                raw = text_bytes(m[2])
                found[m[1].decode()] = raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
        return found

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """Character map of each font name of a page."""
        where = page + b"".join(self.objects.get(k, b"") for k in self.refs(page, b"Resources"))
        where += b"".join(self.objects.get(k, b"") for k in self.refs(where, b"Font"))
        out = {}
        for name, k in re.findall(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R", where):
            font = self.objects.get(int(k), b"")
            if re.search(rb"/Type\s*/Font\b", font):
                maps = self.refs(font, b"ToUnicode")
                out[name] = character_map(self.stream(self.objects.get(maps[0], b""))) if maps else None
        return out


def text_bytes(token: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def turn(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x.isdigit() else b"" if x in b"\r\n" else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", turn, token[1:-1], flags=re.S)


def character_map(data: bytes) -> dict[int, str]:
    """Codes to text from ``bfchar`` and ``bfrange`` sections; two-byte codes are marked by key -1."""
    out: dict[int, str] = {}
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "surrogatepass")  # noqa: E731  # halves of a pair meet in shown()
    hexes = lambda s: re.findall(rb"<([0-9A-Fa-f]+)>", s)
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        h = hexes(part)
        for a, b in zip(h[::2], h[1::2], strict=False):
            out[int(a, 16)] = text(b)
            if len(a) > 2:
                out[-1] = ""
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f]+>|\[[^\]]*\])", part):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF)
            if c[:1] == b"[":
                out.update(zip(range(low, high + 1), map(text, hexes(c)), strict=False))
            else:
                start = text(c[1:-1])
                out.update({k: start[:-1] + chr(ord(start[-1]) + k - low) for k in range(low, high + 1) if start})
            if len(a) > 2:
                out[-1] = ""
    return out


def shown(raw: bytes, codes: dict[int, str] | None) -> str:
    if not codes:
        return raw.decode("latin-1")
    step = 2 if -1 in codes else 1
    text = "".join(codes.get(int.from_bytes(raw[k : k + step], "big"), "") for k in range(0, len(raw), step))
    return text.encode("utf-16-be", "surrogatepass").decode("utf-16-be", "replace")


def lines(data: bytes, fonts: dict[bytes, dict[int, str] | None]) -> list[tuple[float, float, float, str]]:
    """``x, y, size, text`` of each run of a content stream; runs on one height are one line."""
    stack, runs, listed = [], [], None
    x = y = lead = 0.0
    size, codes = 1.0, None
    for token in _TOKEN.findall(data):
        first = token[:1]
        if first == b"[":
            listed = []
        elif first == b"]":
            stack.append(listed or [])
            listed = None
        elif first in b"(<":
            (stack if listed is None else listed).append(text_bytes(token))
        elif first == b"/":
            stack.append(token[1:])
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            (stack if listed is None else listed).append(float(token))
        else:
            try:
                if token == b"Tf":
                    codes, size = fonts.get(stack[-2]), stack[-1]
                elif token in (b"Td", b"TD"):
                    x, y = x + stack[-2], y + stack[-1]
                    lead = -stack[-1] if token == b"TD" else lead
                elif token == b"Tm":
                    x, y = stack[-2], stack[-1]
                elif token == b"BT":
                    x = y = 0.0
                elif token == b"TL":
                    lead = stack[-1]
                elif token in (b"T*", b"'", b'"'):
                    y -= lead
                if token in (b"Tj", b"'", b'"'):
                    runs.append((x, y, size, shown(stack[-1], codes)))
                elif token == b"TJ":
                    said = "".join(shown(p, codes) if isinstance(p, bytes) else " " if p < -200 else "" for p in stack[-1])
                    runs.append((x, y, size, said))
            except (IndexError, TypeError):
                pass
            stack.clear()
    out: list[tuple[float, float, float, str]] = []
    for r in runs:
        if out and abs(out[-1][1] - r[1]) < 0.5:
            out[-1] = (*out[-1][:3], out[-1][3] + r[3])
        elif r[3].strip():
            out.append(r)
    return out


PAGES = "page long, lines array<struct<x:double,y:double,size:double,text:string>>, text string"


def pages(content: bytes) -> Iterator[tuple]:
    """Number, lines and text of each page; for :func:`files.by_file`."""
    pdf = Pdf(content)
    for k, number in enumerate(pdf.pages()):
        body = pdf.objects[number]
        data = b"\n".join(pdf.stream(pdf.objects.get(c, b"")) for c in pdf.refs(body, b"Contents"))
        found = lines(data, pdf.fonts(body))
        yield k, [{"x": a, "y": b, "size": c, "text": t} for a, b, c, t in found], "\n".join(t for *_, t in found)


METADATA = "field string, value string"


def metadata(content: bytes) -> Iterator[tuple]:
    """Fields of the document's description and their values; for :func:`files.by_file`."""
    yield from Pdf(content).info().items()
