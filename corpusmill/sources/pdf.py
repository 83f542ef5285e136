"""A reader of PDF files in plain Python: positioned text and ruled tables, without a library.

It reads objects by scanning the file, so a broken cross-reference table does no harm; object streams, Flate and hexadecimal filters;
simple fonts (Latin text or a ToUnicode map) and two-byte fonts with such a map. Encrypted files and files without pages are errors.
Images, annotations and other filters give nothing.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

_SPACE, _DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
_NUMBER = re.compile(rb"[+-]?(\d+\.?\d*|\.\d+)")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])")
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Lines and table rules this close, in points, are one.
SNAP = 3.0


class Name(str):
    """A name object, without its slash."""


class Word(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Tokens:
    """Reads objects from bytes, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 0x25:  # a comment
                while self.at < len(d) and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next object or operator; None at the end."""
        self._skip()
        d, a = self.data, self.at
        if a >= len(d):
            return None
        c = d[a : a + 1]
        if c == b"/":
            self.at += 1
            return Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), self._run().decode("latin-1")))
        if c == b"(":
            return self._literal()
        if d[a : a + 2] == b"<<":
            self.at += 2
            items = self._until(b">>")
            return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        if c == b"<":
            end = d.find(b">", a)
            end = end if end >= 0 else len(d)
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[a:end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c in b"]>){}":
            self.at += 1
            return Word(c.decode())
        if m := _REFERENCE.match(d, a):
            self.at = m.end()
            return Ref(int(m[1]))
        if m := _NUMBER.match(d, a):
            self.at = m.end()
            return float(m[0]) if b"." in m[0] else int(m[0])
        word = self._run()
        if not word:
            self.at += 1
        return {b"true": True, b"false": False, b"null": None}.get(word, Word(word.decode("latin-1")))

    def _run(self) -> bytes:
        a = self.at
        while self.at < len(self.data) and self.data[self.at] not in _SPACE and self.data[self.at] not in _DELIMITERS:
            self.at += 1
        return self.data[a : self.at]

    def _until(self, close: bytes) -> list:
        out = []
        while True:
            self._skip()
            if self.data.startswith(close, self.at) or self.at >= len(self.data):
                self.at += len(close)
                return out
            out.append(self.next())

    def _literal(self) -> bytes:
        d, out, depth = self.data, bytearray(), 1
        a = self.at + 1
        while a < len(d):
            c = d[a : a + 1]
            a += 1
            if c == b"\\":
                e = d[a : a + 1]
                if m := re.compile(rb"[0-7]{1,3}").match(d, a):
                    out.append(int(m[0], 8) & 255)
                    a = m.end()
                    continue
                a += 2 if d[a : a + 2] == b"\r\n" else 1
                out += b"" if e in b"\r\n" else _ESCAPES.get(e, e)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        self.at = a
        return bytes(out)


class File:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        at = 0
        while m := _OBJECT.search(data, at):
            reader = Tokens(data, m.end())
            value, at = reader.next(), reader.at
            tail = re.compile(rb"\s*stream(\r\n|\n|\r)").match(data, at)
            if tail and isinstance(value, dict):
                size = value.get("Length")
                end = tail.end() + size if isinstance(size, int) and data[tail.end() + size : tail.end() + size + 12].lstrip().startswith(b"endstream") else data.find(b"endstream", tail.end())
                end = end if end >= 0 else len(data)
                value, at = Stream(value, data[tail.end() : end]), end
            self.objects[int(m[1])] = value
        heads = [Tokens(data, m.end()).next() for m in re.finditer(rb"\btrailer\b", data)] + [o.head for o in self.objects.values() if isinstance(o, Stream) and o.head.get("Type") == "XRef"]
        if any(isinstance(h, dict) and "Encrypt" in h for h in heads):
            raise ValueError("encrypted")
        for s in [o for o in self.objects.values() if isinstance(o, Stream) and o.head.get("Type") == "ObjStm"]:
            self._packed(s)
        self.root = next((self.get(h["Root"]) for h in reversed(heads) if isinstance(h, dict) and "Root" in h), None) or next((o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), None)
        if not isinstance(self.root, dict):
            raise ValueError("no catalogue of pages")

    def _packed(self, s: Stream) -> None:
        body, reader = self.content(s), None
        reader = Tokens(body)
        numbers = [reader.next() for _ in range(2 * int(self.get(s.head.get("N", 0))))]
        for number, at in zip(numbers[::2], numbers[1::2], strict=True):
            self.objects.setdefault(number, Tokens(body, int(self.get(s.head["First"])) + at).next())

    def get(self, value):
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value.number)
        return None

    def content(self, s) -> bytes:
        s = self.get(s)
        if not isinstance(s, Stream):
            return b""
        names, body = self.get(s.head.get("Filter")) or [], s.raw
        for name in names if isinstance(names, list) else [names]:
            if self.get(name) in ("FlateDecode", "Fl"):
                body = zlib.decompressobj().decompress(body)
            elif self.get(name) in ("ASCIIHexDecode", "AHx"):
                body = Tokens(b"<" + body).next()
            else:
                return b""
        return body

    def pages(self) -> list[dict]:
        """Page objects in order, with what they inherit."""
        out, seen = [], set()

        def walk(node, above: dict) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or id(node) in seen:
                return
            seen.add(id(node))
            own = above | {k: node[k] for k in ("MediaBox", "Resources") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own)
            else:
                out.append(own | node)

        walk(self.root.get("Pages"), {})
        return out


@dataclass
class Font:
    bold: bool = False
    wide: bool = False  # two bytes a character
    unicode: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)

    def read(self, data: bytes) -> tuple[str, float]:
        """Text, and its width for a type size of one."""
        codes = [int.from_bytes(data[k : k + 2], "big") for k in range(0, len(data) - 1, 2)] if self.wide else list(data)
        text = "".join(self.unicode.get(c, "" if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes)
        return text, sum(self.widths.get(c, 0.5) for c in codes)


def _font(file: File, spec) -> Font:
    spec = file.get(spec)
    if not isinstance(spec, dict):
        return Font()
    font = Font("bold" in str(file.get(spec.get("BaseFont", ""))).lower(), file.get(spec.get("Subtype")) == "Type0")
    first, widths = file.get(spec.get("FirstChar", 0)), file.get(spec.get("Widths"))
    if isinstance(widths, list) and isinstance(first, int):
        font.widths = {first + k: w / 1000 for k, w in enumerate(map(file.get, widths)) if isinstance(w, (int, float))}
    reader, held = Tokens(file.content(spec.get("ToUnicode"))), []
    number = lambda b: int.from_bytes(b, "big")
    while (token := reader.next()) is not None:
        if token in ("beginbfchar", "beginbfrange"):
            held = []
        elif token == "endbfchar":
            font.unicode |= {number(a): b.decode("utf-16-be", "replace") for a, b in zip(held[::2], held[1::2], strict=False)}
        elif token == "endbfrange":
            for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                for k in range(min(number(high) - number(low) + 1, 1 << 16)):
                    font.unicode[number(low) + k] = to[k].decode("utf-16-be", "replace") if isinstance(to, list) else (number(to) + k).to_bytes(len(to), "big").decode("utf-16-be", "replace")
        else:
            held.append(token)
    return font


@dataclass
class Run:
    """Text shown at once: left, base line and right from the page's lower left corner, type size, whether bold."""

    x: float
    y: float
    right: float
    size: float
    bold: bool
    text: str


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def read_page(file: File, page: dict) -> tuple[list[Run], list[tuple[float, float, float, float]]]:
    """The text runs of a page, and its straight rules as (x0, y0, x1, y1)."""
    resources = file.get(page.get("Resources")) or {}
    fonts = {k: _font(file, v) for k, v in (file.get(resources.get("Font")) or {}).items()}
    parts = file.get(page.get("Contents"))
    body = b"\n".join(file.content(p) for p in (parts if isinstance(parts, list) else [parts]))
    one = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    runs: list[Run] = []
    rules: list[tuple[float, float, float, float]] = []
    ctm, text, line, saved = one, one, one, []
    font, size, leading, spaced, stacked, path, at = Font(), 1.0, 0.0, (0.0, 0.0), [], [], (0.0, 0.0)
    reader = Tokens(body)

    def show(data: bytes) -> None:
        nonlocal text
        shown, width = font.read(data)
        width = width * size + spaced[0] * len(shown) + spaced[1] * shown.count(" ")
        m = _times(text, ctm)
        end = _times((1, 0, 0, 1, width, 0), m)
        if shown.strip():
            runs.append(Run(m[4], m[5], end[4], abs(size) * (m[2] ** 2 + m[3] ** 2) ** 0.5, font.bold, shown))
        text = _times((1, 0, 0, 1, width, 0), text)

    def move(x: float, y: float) -> None:
        nonlocal text, line
        line = text = _times((1, 0, 0, 1, x, y), line)

    def point(x: float, y: float) -> tuple[float, float]:
        return _times((1, 0, 0, 1, x, y), ctm)[4:]

    while (token := reader.next()) is not None:
        if not isinstance(token, Word):
            stacked.append(token)
            continue
        args, stacked = stacked, []
        n = [a for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
        if token == "q":
            saved.append((ctm, font, size))
        elif token == "Q" and saved:
            ctm, font, size = saved.pop()
        elif token == "cm" and len(n) == 6:
            ctm = _times(tuple(n), ctm)
        elif token == "BT":
            text = line = one
        elif token == "Tf" and n and args:
            font, size = fonts.get(args[0], Font()), float(n[-1])
        elif token == "TL" and n:
            leading = n[0]
        elif token == "Tc" and n:
            spaced = (n[0], spaced[1])
        elif token == "Tw" and n:
            spaced = (spaced[0], n[0])
        elif token == "Tm" and len(n) == 6:
            text = line = tuple(n)
        elif token in ("Td", "TD") and len(n) == 2:
            leading = -n[1] if token == "TD" else leading
            move(*n)
        elif token == "T*":
            move(0, -leading)
        elif token in ("'", '"') and args:
            move(0, -leading)
            show(args[-1] if isinstance(args[-1], bytes) else b"")
        elif token == "Tj" and args and isinstance(args[-1], bytes):
            show(args[-1])
        elif token == "TJ" and args and isinstance(args[-1], list):
            for item in args[-1]:
                if isinstance(item, bytes):
                    show(item)
                elif isinstance(item, (int, float)):
                    if item < -200 and runs and runs[-1].text[-1:] != " ":  # a gap as wide as a blank
                        runs[-1].text += " "
                    text = _times((1, 0, 0, 1, -item / 1000 * size, 0), text)
        elif token == "m" and len(n) == 2:
            at = point(*n)
        elif token == "l" and len(n) == 2:
            to = point(*n)
            path.append((*at, *to))
            at = to
        elif token == "re" and len(n) == 4:
            (x0, y0), (x1, y1) = point(n[0], n[1]), point(n[0] + n[2], n[1] + n[3])
            path += [(x0, y0, x1, y0), (x0, y1, x1, y1), (x0, y0, x0, y1), (x1, y0, x1, y1)]
        elif token in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*"):
            rules += path
            path = []
        elif token == "n":
            path = []
        elif token == "ID":  # an inline image
            end = re.compile(rb"\sEI(?=\s)").search(reader.data, reader.at)
            reader.at = end.end() if end else len(reader.data)
    return runs, rules


def _lines(runs: list[Run]) -> list[list[Run]]:
    """Runs on one base line, each beginning near where the one before it ends, in the order they are shown."""
    out: list[list[Run]] = []
    for r in runs:
        last = out[-1][-1] if out else None
        if last and abs(last.y - r.y) < 0.3 * r.size and -0.5 * r.size <= r.x - last.right <= 2 * r.size:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def _joined(line: list[Run]) -> str:
    text = ""
    for k, r in enumerate(line):
        apart = k and r.x - line[k - 1].right > 0.15 * r.size and not text.endswith(" ") and not r.text.startswith(" ")
        text += " " * bool(apart) + r.text
    return text.strip()


def page_size(file: File, page: dict) -> tuple[float, float, float, float]:
    """Left, bottom, width and height of a page."""
    box = [file.get(x) for x in file.get(page.get("MediaBox")) or (0, 0, 612, 792)]
    return min(box[0], box[2]), min(box[1], box[3]), abs(box[2] - box[0]), abs(box[3] - box[1])


def text_blocks(content: bytes) -> list[dict]:
    """Blocks (schemas.BLOCK without doc_id) of a file: lines of one type size, one below the other. A page without text gives none."""
    file = File(content)
    pages, out = file.pages(), []
    if not pages:
        raise ValueError("no pages")
    for number, page in enumerate(pages, 1):
        left, bottom, width, height = page_size(file, page)
        blocks: list[list[list[Run]]] = []
        for line in _lines(read_page(file, page)[0]):
            above = blocks[-1][-1] if blocks else None
            size = line[0].size
            if above and abs(above[0].size - size) < 0.5 and 0 < above[0].y - line[0].y <= 1.6 * size and abs(above[0].x - line[0].x) <= 3 * size:
                blocks[-1].append(line)
            else:
                blocks.append([line])
        for block in blocks:
            every = [r for line in block for r in line]
            out.append({"page_number": number, "page_width": float(width), "page_height": float(height), "x0": min(r.x for r in every) - left, "y0": height - max(r.y + 0.8 * r.size for r in every) + bottom, "x1": max(r.right for r in every) - left, "y1": height - min(r.y - 0.2 * r.size for r in every) + bottom, "text": "\n".join(map(_joined, block)), "font_sizes": [round(r.size, 3) for r in every], "has_bold_span": any(r.bold for r in every)})
    return out


def _clusters(values: list[float]) -> list[float]:
    """Values in ascending order, those within SNAP of the one before as one."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v - out[-1] > SNAP:
            out.append(v)
    return out


def ruled_tables(content: bytes) -> list[tuple[int, list[list[str | None]]]]:
    """(page number, grid) of the tables drawn with rules: rules that touch form a table, and a cell holds the text whose middle lies in it."""
    file, out = File(content), []
    for number, page in enumerate(file.pages(), 1):
        runs, rules = read_page(file, page)
        straight = [(min(a, c), min(b, d), max(a, c), max(b, d)) for a, b, c, d in rules if abs(a - c) <= SNAP or abs(b - d) <= SNAP]
        groups: list[list[tuple]] = []
        for r in straight:
            touching = [g for g in groups if any(r[0] <= s[2] + SNAP and s[0] <= r[2] + SNAP and r[1] <= s[3] + SNAP and s[1] <= r[3] + SNAP for s in g)]
            groups = [g for g in groups if g not in touching] + [[r, *(s for g in touching for s in g)]]
        found = []
        for g in groups:
            xs, ys = _clusters([r[0] for r in g if r[2] - r[0] <= SNAP < r[3] - r[1]]), _clusters([r[1] for r in g if r[3] - r[1] <= SNAP < r[2] - r[0]])
            if len(xs) < 2 or len(ys) < 2:
                continue
            cells: dict[tuple[int, int], list[list[Run]]] = {}
            for line in _lines(runs):
                x, y = (line[0].x + line[-1].right) / 2, line[0].y + 0.3 * line[0].size
                if xs[0] <= x <= xs[-1] and ys[0] <= y <= ys[-1]:
                    cells.setdefault((sum(v <= y for v in ys[1:-1]), sum(v <= x for v in xs[1:-1])), []).append(line)
            grid = [["\n".join(map(_joined, cells[row, col])) if (row, col) in cells else None for col in range(len(xs) - 1)] for row in range(len(ys) - 2, -1, -1)]
            found.append((-ys[-1], xs[0], grid))
        out += [(number, grid) for _, _, grid in sorted(found, key=lambda t: t[:2])]
    return out
