"""The PDF reader on files made here: plain objects, packed ones, maps to Unicode, named destinations."""

import zlib

import pytest

from docketlake.sources import outline
from docketlake.sources.pdf import extract

LONG = "This paragraph speaks of Rule 57a and of other matters at length."


def plain_object(n, body):
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def stream(n, data, more=b"", packed=True):
    data = zlib.compress(data) if packed else data
    return plain_object(n, b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if packed else b"", more, data))


def book(packed: bool) -> bytes:
    """Two pages, and an outline of a part with two sections."""
    cmap = b"/CIDInit begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0041> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0029> <0061> <0030> <0031> [<0020> <00E9>] endbfrange endcmap"
    one = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (1.1 Scope) Tj 0 -14 Td [(This para) -20 (graph) -300 (speaks \\(of\\) exam-)] TJ T* (ple \\101\\\n of rules) Tj ET"
    two = b"BT /F2 12 Tf 14 TL 72 700 Td <00010010> Tj <00300002> ' 60 0 Td <0031> Tj ET q BI /W 1 ID \x00( EI Q BT /F3 9 Tf 0 600 Td (1.2 \x01end\x02) Tj ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 20 0 R /Names << /Dests 30 0 R >> >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font 9 0 R >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [5 0 R] >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>", 9: b"<< /F1 << /Subtype /Type1 >> /F2 << /Subtype /Type0 /ToUnicode 10 0 R >> /F3 11 0 R >>",
        11: b"<< /Subtype /TrueType /Encoding << /Differences [1 /quotedblleft /uni201D] >> >>", 20: b"<< /First 21 0 R /Last 21 0 R >>", 21: b"<< /Title (Part A Formalities) /First 22 0 R /Dest [3 0 R /Fit] >>",
        22: b"<< /Title (1.1 Scope) /Parent 21 0 R /Next 23 0 R /A << /S /GoTo /D (first) >> >>", 23: b"<< /Title <FEFF0031002E003200200045006E00E9> /Parent 21 0 R /Dest [4 0 R /XYZ 0 0 0] >>",
        30: b"<< /Kids [31 0 R] >>", 31: b"<< /Names [(first) << /D [3 0 R /Fit] >>] >>",
    }
    out = b"%PDF-1.7\n% a comment (\n" + stream(5, one, packed=packed) + stream(6, two, packed=packed) + stream(10, cmap, packed=packed)
    if not packed:
        return out + b"".join(plain_object(n, b) for n, b in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"
    places, inside = [], b""
    for n, b in objects.items():
        places.append(b"%d %d" % (n, len(inside)))
        inside += b + b" "
    head = b" ".join(places) + b" "
    out += stream(50, head + inside, b"/Type /ObjStm /N %d /First %d" % (len(objects), len(head)))
    return out + stream(51, b"\x00" * 8, b"/Type /XRef /Root 1 0 R /W [1 2 1]") + b"startxref\n0\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pages_and_outline(packed):
    pages, nodes = extract(book(packed))
    assert pages == ["1.1 Scope\nThis paragraph speaks (of) exam-\nple A of rules", "Aa\n fi é\n1.2 “end”"]
    assert nodes == [(1, None, 1, "Part A Formalities", 1), (2, 1, 2, "1.1 Scope", 1), (3, 1, 3, "1.2 Ené", 2)]


def test_damaged_and_encrypted_files():
    assert extract(b"") == ([], []) and extract(b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R") == ([], [])
    broken = book(False).replace(b"/Kids [3 0 R 4 0 R]", b"/Kids [3 0 R 4 0 R 2 0 R 99 0 R]")
    assert len(extract(broken)[0]) == 2
    with pytest.raises(ValueError):
        extract(b"trailer << /Encrypt 5 0 R >>")


def test_sections_of_a_file(spark, tmp_path):
    one = b"BT 0 0 Td (1.1 Scope) Tj " + f"0 -1 Td ({LONG}) Tj 0 -1 Td (1.2 General) Tj 0 -1 Td ({LONG} {LONG}) Tj ET".encode()
    nodes = b"<< /First 5 0 R >>", b"<< /Title (Part B Search) /First 6 0 R >>", b"<< /Title (1.1 Scope) /Next 7 0 R /Dest [3 0 R] >>", b"<< /Title (1.2 General) /Dest [3 0 R] >>"
    data = b"%PDF\n" + plain_object(1, b"<< /Type /Catalog /Pages 2 0 R /Outlines 4 0 R >>") + plain_object(2, b"<< /Kids [3 0 R] >>") + plain_object(3, b"<< /Contents 8 0 R >>")
    (tmp_path / "a.pdf").write_bytes(data + b"".join(plain_object(4 + i, b) for i, b in enumerate(nodes)) + stream(8, one) + b"trailer << /Root 1 0 R >>")
    made = outline.sections(*outline.read_pdf(spark, str(tmp_path / "a.pdf"), "gl", extract)).orderBy("id").collect()
    assert [(r.section_id, r.body) for r in made] == [("B, 1.1", f"1.1 Scope\n{LONG}"), ("B, 1.2", f"1.2 General\n{LONG} {LONG}")]
