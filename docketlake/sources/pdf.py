"""Text and outline of PDF files, for ``outline.read_pdf``.

A reader of what books of text consist of: plain and compressed objects, page
trees, fonts with a map to Unicode or a simple encoding, text in content order,
and outlines with direct or named destinations. Files are read by scanning for
their objects, the last one of a number counts, so a damaged cross-reference
table doesn't matter. Encrypted files are an error. Streams in other encodings
than deflate are taken as empty, and so are characters of fonts that say
nothing about Unicode.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: White space and delimiters of the format, and the escapes of its strings (fixed values).
SPACE, DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Characters by the names that encodings give them, beside letters (fixed values).
NAMES = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",",
    "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";",
    "question": "?", "section": "§", "endash": "–", "emdash": "—", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "bullet": "•", "fi": "fi", "fl": "fl", "ff": "ff",
    "germandbls": "ß", "adieresis": "ä", "odieresis": "ö", "udieresis": "ü", "Adieresis": "Ä", "Odieresis": "Ö", "Udieresis": "Ü", "eacute": "é", "egrave": "è", "agrave": "à", "ccedilla": "ç",
}
TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\r\n\x00\t\x0c ]*)*")
REGULAR = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
REFERENCE = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])")
OBJECT = re.compile(rb"(?<!\d)(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")


class Name(str):
    """A name, as /Name."""


class Ref(int):
    """A reference to an object, by its number."""


class Operator(bytes):
    """A word of a content stream, or a keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    out, depth = [], 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            following = data[at + 1 : at + 2]
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(bytes([int(octal[0], 8) & 255]))
                at = octal.end()
                continue
            if following not in b"\r\n":
                out.append(ESCAPES.get(following, following))
            at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out.append(c)
    return b"".join(out), at


def value(data: bytes, at: int):
    """The value at a place, and the place behind it; the end of the data is an operator without letters."""
    at = TOKEN.match(data, at).end()
    c = data[at : at + 1]
    if not c:
        return Operator(b""), at
    if c == b"/":
        m = REGULAR.match(data, at + 1)
        raw = m[0] if m else b""
        return Name(re.sub(rb"#([0-9a-fA-F]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1")), m.end() if m else at + 1
    if c == b"(":
        return _string(data, at + 1)
    if data.startswith(b"<<", at):
        out, at = {}, at + 2
        while True:
            key, at = value(data, at)
            if key in (b">>", b"") and isinstance(key, Operator):
                return out, at
            out[key], at = value(data, at)
    if c == b"<":
        end = data.find(b">", at)
        digits = re.sub(rb"[^0-9a-fA-F]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if c == b"[":
        out, at = [], at + 1
        while True:
            item, at = value(data, at)
            if item in (b"]", b"") and isinstance(item, Operator):
                return out, at
            out.append(item)
    if data.startswith(b">>", at):
        return Operator(b">>"), at + 2
    m = REGULAR.match(data, at)
    if not m:
        return Operator(c), at + 1
    if m[0].isdigit():
        ref = REFERENCE.match(data, at)
        if ref:
            return Ref(ref[1]), ref.end()
    if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", m[0]):
        return float(m[0]) if b"." in m[0] else int(m[0]), m.end()
    known = {b"true": True, b"false": False, b"null": None}
    return known.get(m[0], Operator(m[0])), m.end()


class Document:
    """The objects of a file."""

    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        self.trailer: dict = {}
        at = 0
        while m := OBJECT.search(data, at):
            number = int(m[1])
            found, at = value(data, m.end())
            body = re.compile(rb"[\x00\t\n\x0c\r ]*stream(?:\r\n|\n|\r)").match(data, at)
            self.objects[number] = found
            if body and isinstance(found, dict):
                length = found.get("Length")
                end = body.end() + length if isinstance(length, int) and not isinstance(length, Ref) else -1
                if end < 0 or not re.compile(rb"[\r\n ]*endstream").match(data, end):
                    end = data.find(b"endstream", body.end())
                    end = len(data) if end < 0 else end
                self.streams[number] = data[body.end() : end]
                at = end
                kind = found.get("Type")
                if kind == "XRef":
                    self.trailer.update(found)
                elif kind == "ObjStm":
                    self._unpack(number)
        for m in re.finditer(rb"trailer", data):
            found, _ = value(data, m.end())
            if isinstance(found, dict):
                self.trailer.update(found)
        if "Encrypt" in self.trailer:
            raise ValueError("the file is encrypted")

    def _unpack(self, number: int) -> None:
        inside, stream = self.objects[number], self.stream(number)
        at, places = 0, []
        for _ in range(int(self.get(inside.get("N")) or 0)):
            n, at = value(stream, at)
            offset, at = value(stream, at)
            places.append((n, offset))
        for n, offset in places:
            self.objects[int(n)], _ = value(stream, int(self.get(inside["First"])) + int(offset))
            self.streams.pop(int(n), None)

    def get(self, x):
        """What a value stands for: itself, or the object that it refers to."""
        for _ in range(32):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def dictionary(self, x) -> dict:
        found = self.get(x)
        return found if isinstance(found, dict) else {}

    def stream(self, number: int) -> bytes:
        """A stream's content; empty if its encoding isn't known."""
        about, data = self.dictionary(Ref(number)), self.streams.get(number, b"")
        filters = self.get(about.get("Filter")) or []
        settings = self.get(about.get("DecodeParms")) or []
        filters = filters if isinstance(filters, list) else [filters]
        settings = settings if isinstance(settings, list) else [settings]
        for i, f in enumerate(filters):
            if self.get(f) not in ("FlateDecode", "Fl"):
                return b""
            data = zlib.decompressobj().decompress(data)
            data = self._unpredicted(data, self.dictionary(settings[i]) if i < len(settings) else {})
        return data

    def _unpredicted(self, data: bytes, settings: dict) -> bytes:
        if int(self.get(settings.get("Predictor")) or 1) < 10:
            return data
        width = (int(self.get(settings.get("Columns")) or 1) * int(self.get(settings.get("Colors")) or 1) * int(self.get(settings.get("BitsPerComponent")) or 8) + 7) // 8
        step, rows, last = max(1, int(self.get(settings.get("Colors")) or 1)), [], bytearray(width)
        for lo in range(0, len(data), width + 1):
            kind, row = data[lo], bytearray(data[lo + 1 : lo + 1 + width].ljust(width, b"\0"))
            for i in range(width):
                a, b, c = (row[i - step] if i >= step else 0), last[i], (last[i - step] if i >= step else 0)
                near = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))
                row[i] = (row[i] + (0, a, b, (a + b) // 2, near)[kind if kind < 5 else 0]) & 255
            rows.append(bytes(row))
            last = row
        return b"".join(rows)

    def pages(self) -> list[tuple[int, dict, dict]]:
        """(number of the object, page, resources) in order."""
        out: list[tuple[int, dict, dict]] = []
        seen: set[int] = set()
        stack = [(self.dictionary(self.trailer.get("Root")).get("Pages"), {})]
        if not self.dictionary(stack[0][0]):
            roots = [o for o in self.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"]
            stack = [(r.get("Pages"), {}) for r in roots[-1:]]
        while stack:
            ref, held = stack.pop()
            node = self.dictionary(ref)
            if not isinstance(ref, Ref) or int(ref) in seen or not node:
                continue
            seen.add(int(ref))
            held = self.dictionary(node.get("Resources")) or held
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                stack.extend((k, held) for k in reversed(kids))
            else:
                out.append((int(ref), node, held))
        return out


def _units(raw: bytes) -> str:
    return raw.decode("utf-16-be", "ignore")


def text_string(raw: bytes) -> str:
    """A text outside of pages, such as a title."""
    return _units(raw[2:]) if raw.startswith(b"\xfe\xff") else raw.decode("cp1252", "replace")


def unicode_map(stream: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code, and the text of each code."""
    width, out, at, held = 1, {}, 0, []
    while True:
        item, at = value(stream, at)
        if not isinstance(item, Operator):
            held.append(item)
            continue
        if item == b"":
            return width, out
        if item == b"endcodespacerange" and held and isinstance(held[-1], bytes):
            width = len(held[-1])
        elif item == b"endbfchar":
            out |= {int.from_bytes(a): _units(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif item == b"endbfrange":
            for lo, hi, to in zip(held[::3], held[1::3], held[2::3]):
                codes = range(int.from_bytes(lo), int.from_bytes(hi) + 1)
                if isinstance(to, list):
                    out |= {c: _units(t) for c, t in zip(codes, to)}
                else:
                    out |= {c: _units(to[:-2]) + chr(int.from_bytes(to[-2:]) + i) for i, c in enumerate(codes)}
        held = []


def _font(document: Document, font: dict):
    """Turns a string of a font into text."""
    to_unicode = font.get("ToUnicode")
    if isinstance(to_unicode, Ref):
        width, table = unicode_map(document.stream(int(to_unicode)))
        return lambda raw: "".join(table.get(int.from_bytes(raw[i : i + width]), "") for i in range(0, len(raw), width))
    if font.get("Subtype") == "Type0":
        return lambda raw: ""
    table, code = {}, 0
    for x in document.get(document.dictionary(font.get("Encoding")).get("Differences")) or []:
        if isinstance(x, int):
            code = x
        else:
            known = x if len(x) == 1 else chr(int(x[3:7], 16)) if re.fullmatch("uni[0-9A-F]{4}", x) else NAMES.get(x, "")
            table[code], code = known, code + 1
    return lambda raw: "".join(table[b] if b in table else bytes([b]).decode("cp1252", "replace") for b in raw)


def _operations(stream: bytes) -> Iterator[tuple[bytes, list]]:
    at, held = 0, []
    while True:
        item, at = value(stream, at)
        if not isinstance(item, Operator):
            held.append(item)
            continue
        if item == b"":
            return
        if item == b"ID":  # the data of an image inside the stream
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(stream, at)
            at = end.end() if end else len(stream)
        yield bytes(item), held
        held = []


def page_text(document: Document, page: dict, resources: dict) -> str:
    """A page's text in content order; a new line wherever the text moves up or down."""
    contents = page.get("Contents")
    found = document.get(contents)
    refs = [contents] if isinstance(contents, Ref) and not isinstance(found, list) else (found or [])
    stream = b"\n".join(document.stream(int(r)) for r in refs if isinstance(r, Ref))
    fonts = document.dictionary(resources.get("Font"))
    decoders: dict[str, object] = {}
    out: list[str] = []
    decode, leading, line, wrote_on = _font(document, {}), 0.0, 0.0, None

    def write(text: str) -> None:
        nonlocal wrote_on
        if text:
            if wrote_on is not None and abs(line - wrote_on) > 0.5:
                out.append("\n")
            out.append(text)
            wrote_on = line

    for operator, x in _operations(stream):
        numbers = [n for n in x if isinstance(n, (int, float))]
        if operator == b"Tf" and x and isinstance(x[0], Name):
            if x[0] not in decoders:
                decoders[x[0]] = _font(document, document.dictionary(fonts.get(x[0])))
            decode = decoders[x[0]]
        elif operator == b"TL" and numbers:
            leading = float(numbers[0])
        elif operator in (b"Td", b"TD") and len(numbers) == 2:
            if operator == b"TD":
                leading = -float(numbers[1])
            line += numbers[1]
            if not numbers[1] and numbers[0] > 0 and out and not out[-1][-1:].isspace():
                out.append(" ")
        elif operator == b"Tm" and len(numbers) == 6:
            if wrote_on is not None and abs(numbers[5] - line) <= 0.5 and not out[-1][-1:].isspace():
                out.append(" ")
            line = float(numbers[5])
        elif operator == b"T*":
            line -= leading or 1
        elif operator in (b"Tj", b"'", b'"') and x and isinstance(x[-1], bytes):
            if operator != b"Tj":
                line -= leading or 1
            write(decode(x[-1]))
        elif operator == b"TJ" and x and isinstance(x[0], list):
            write("".join(decode(i) if isinstance(i, bytes) else " " if isinstance(i, (int, float)) and i < -200 else "" for i in x[0]))
    return "".join(out)


def _destinations(document: Document, tree) -> Iterator[tuple[bytes, object]]:
    """The entries of a name tree."""
    stack, seen = [tree], set()
    while stack:
        ref = stack.pop()
        if isinstance(ref, Ref):
            if int(ref) in seen:
                continue
            seen.add(int(ref))
        node = document.dictionary(ref)
        names = document.get(node.get("Names")) or []
        yield from zip(names[::2], names[1::2])
        stack.extend(document.get(node.get("Kids")) or [])


def outline(document: Document, numbers: dict[int, int]) -> list[tuple]:
    """(node_id, parent_id, ord, title, page) of a file's outline in its order; page 0 where the destination isn't a page."""
    root = document.dictionary(document.trailer.get("Root")) or next((o for o in document.objects.values() if isinstance(o, dict) and o.get("Type") == "Catalog"), {})
    named = {k: v for k, v in document.dictionary(root.get("Dests")).items()}
    named |= {text_string(k): v for k, v in _destinations(document, document.dictionary(root.get("Names")).get("Dests")) if isinstance(k, bytes)}

    def page_of(target) -> int:
        for _ in range(8):
            target = document.get(target)
            if isinstance(target, dict):
                target = target.get("D")
            elif isinstance(target, (bytes, Name)):
                target = named.get(text_string(target) if isinstance(target, bytes) else target)
            else:
                break
        first = target[0] if isinstance(target, list) and target else None
        return numbers.get(int(first), 0) if isinstance(first, Ref) else first + 1 if isinstance(first, int) else 0

    out: list[tuple] = []
    seen: set[int] = set()

    stack = [(document.dictionary(root.get("Outlines")).get("First"), None)]
    while stack:
        ref, parent = stack.pop()
        node = document.dictionary(ref)
        if not isinstance(ref, Ref) or int(ref) in seen or not node:
            continue
        seen.add(int(ref))
        number, title = len(out) + 1, document.get(node.get("Title"))
        action = document.dictionary(node.get("A"))
        out.append((number, parent, number, text_string(title) if isinstance(title, bytes) else "", page_of(node["Dest"] if "Dest" in node else action.get("D"))))
        stack.append((node.get("Next"), parent))
        stack.append((node.get("First"), number))
    return out


def extract(content: bytes) -> tuple[list[str], list[tuple]]:
    """The texts of a file's pages, and its outline's nodes."""
    document = Document(content)
    pages = document.pages()
    return [page_text(document, page, resources) for _, page, resources in pages], outline(document, {number: i + 1 for i, (number, _, _) in enumerate(pages)})
