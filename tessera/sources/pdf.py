"""Text of PDF files: the objects of a file, the content streams of its first pages, and their text operators.

Read are classic and object streams, with Flate or no compression, simple fonts, and composite fonts with a table to Unicode. A file
that is encrypted or broken, or whose pages are images only, gives what can be read, at worst nothing.
"""

from __future__ import annotations

import re
import zlib
from itertools import zip_longest

PAGES = 20

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(
    rb"\((?:[^()\\]|\\.)*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]*|\(",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflated(body: bytes, raw: bytes) -> bytes:
    """A stream's bytes; what a broken one gives up to where it breaks."""
    if b"/FlateDecode" not in body and b"/Fl " not in body:
        return raw
    try:
        return zlib.decompressobj().decompress(raw)
    except zlib.error:
        return b""


class _File:
    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}  # number: dictionary or value, stream
        marks = list(_OBJECT.finditer(data))
        for m, after in zip_longest(marks, marks[1:]):
            chunk = data[m.end() : after.start() if after else len(data)]
            head, found, rest = chunk.partition(b"stream")
            stream = None
            if found and b"endstream" in rest and b"endobj" not in head:
                raw = rest[: rest.rindex(b"endstream")]
                raw = raw[2:] if raw.startswith(b"\r\n") else raw[1:] if raw[:1] in (b"\n", b"\r") else raw
                stream = _inflated(head, raw)
            self.objects[int(m[1])] = (head.partition(b"endobj")[0], stream)
        for body, stream in list(self.objects.values()):
            if stream and b"/ObjStm" in body:
                self._unpack(body, stream)

    def _unpack(self, body: bytes, stream: bytes) -> None:
        first, n = re.search(rb"/First\s+(\d+)", body), re.search(rb"/N\s+(\d+)", body)
        if not first or not n:
            return
        numbers = [int(x) for x in stream[: int(first[1])].split()[: 2 * int(n[1])]]
        at = [*numbers[1::2], len(stream) - int(first[1])]
        for number, a, b in zip(numbers[::2], at, at[1:], strict=False):
            self.objects.setdefault(number, (stream[int(first[1]) + a : int(first[1]) + b], None))

    def get(self, number: int) -> tuple[bytes, bytes | None]:
        return self.objects.get(number, (b"", None))

    def value(self, body: bytes, key: bytes) -> bytes:
        """What a dictionary has under a key: the referred object's body, or what stands there."""
        m = re.search(re.escape(key) + rb"(?![A-Za-z])\s*(?:(\d+)\s+\d+\s+R|(<<.*|\[[^\]]*\]))", body, re.S)
        return b"" if not m else self.get(int(m[1]))[0] if m[1] else m[2]

    def pages(self) -> list[bytes]:
        """Bodies of the first pages in reading order, by the page tree where there is one."""
        root = next((b for b, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        tree = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
        out: list[bytes] = []
        todo, seen = [int(tree[1])] if tree else [], set()
        while todo and len(out) < PAGES:
            number = todo.pop()
            if number in seen:
                continue
            seen.add(number)
            body = self.get(number)[0]
            kids = re.search(rb"/Kids\s*\[([^\]]*)\]", body)
            if kids:
                todo += [int(k) for k in reversed(_REF.findall(kids[1]))]
            elif body:
                out.append(body)
        return out or [b for b, _ in self.objects.values() if re.search(rb"/Type\s*/Page(?!s)", b)][:PAGES]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        streams = [self.get(int(n)) for n in _REF.findall(m[1])] if m else []
        inner = [self.get(int(n)) for body, s in streams if s is None for n in _REF.findall(body)]  # an array of its own
        return b"\n".join(s for _, s in [*streams, *inner] if s)

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str]]:
        """Tables to Unicode of a page's fonts that have one, by name."""
        resources = self.value(page, b"/Resources") or page
        listed = self.value(resources, b"/Font") or resources
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
            m = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", self.get(int(number))[0])
            if m and (stream := self.get(int(m[1]))[1]):
                out[name] = _to_unicode(stream)
        return out


def _chars(code: bytes) -> str:
    return bytes.fromhex((code + b"0" * (-len(code) % 4)).decode()).decode("utf-16-be", "replace")


def _to_unicode(stream: bytes) -> dict[int, str]:
    table: dict[int, str] = {-1: "1"}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            table[int(a, 16)] = _chars(b)
            table[-1] = str(max(int(table[-1]), len(a) // 2))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            for i in range(min(int(b, 16) - int(a, 16) + 1, 1 << 16)):
                table[int(a, 16) + i] = _chars(b"%0*x" % (len(c), int(c, 16) + i))
            table[-1] = str(max(int(table[-1]), len(a) // 2))
    return table


def _string(token: bytes, font: dict[int, str] | None) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\(\r\n|[0-7]{1,3}|.)", lambda m: b"" if m[1][:1] in b"\r\n" else bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    if font:
        width = int(font[-1])
        return "".join(font.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))
    return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """Lines of a page: text shown between moves to another line; wide gaps inside an array are spaces."""
    out: list[str] = []
    stack: list[bytes] = []
    font, height = None, None

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[/-+.0123456789" and t not in (b"<<",) or t in (b"]", b"<<", b">>"):
            stack.append(t)
            continue
        if t == b"Tf":
            font = fonts.get(next((x[1:] for x in reversed(stack) if x[:1] == b"/"), b""))
        elif t in (b"Td", b"TD") and stack and float(stack[-1] if re.fullmatch(rb"[-+]?\d*\.?\d+", stack[-1]) else b"1"):
            line()
        elif t == b"Tm":
            now = stack[-1] if stack else None
            if now != height:
                line()
            height = now
        elif t in (b"T*", b"BT"):
            line()
        elif t in (b"Tj", b"'", b'"', b"TJ"):
            if t in (b"'", b'"'):
                line()
            for x in stack:
                if x[:1] in b"(<" and x not in (b"<<",):
                    out.append(_string(x, font))
                elif t == b"TJ" and re.fullmatch(rb"-\d*\.?\d+", x) and float(x) < -200:
                    out.append(" ")
        stack = []
    return "".join(out).strip()


def text_of(data: bytes) -> str | None:
    """Text of the first PAGES pages; null if this is no PDF file or an encrypted one."""
    if b"%PDF-" not in data[:1024] or re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        return None
    file = _File(data)
    texts = [_page_text(file.content(p), file.fonts(p)) for p in file.pages()]
    return "\n".join(t for t in texts if t)
