"""The built-in reader on files made here: two pages with a repeated header and footer, a heading, a broken word and a ruled table."""

import zlib

import pytest

from corpusmill.sources import pdf


def page_content(number):
    text = [f"BT /F2 10 Tf 72 760 Td (Quarterly figures) Tj ET BT /F1 8 Tf 280 30 Td (Page {number} of 2) Tj ET"]
    text.append(f"BT /F2 18 Tf 1 0 0 1 72 700 Tm ({['First', 'Second'][number - 1]} part) Tj ET")
    text.append("BT /F1 11 Tf 13 TL 72 670 Td (Sales rose in all regions; they are joined words and cut at a hy-) Tj T* [(phen ) -20 (words \\(see below\\).)] TJ ET")
    if number == 1:
        xs, ys = (72, 172, 232, 292), (500, 520, 540)
        text += [f"{x} {ys[0]} m {x} {ys[-1]} l S" for x in xs] + [f"{xs[0]} {y} m {xs[-1]} {y} l S" for y in ys]
        for row, cells in enumerate((("Item", "2023", "2022"), ("Sales", "10", "9"))):
            text += [f"BT /F1 9 Tf {x + 4} {ys[-1] - 14 - 20 * row} Td ({c}) Tj ET" for x, c in zip(xs, cells, strict=False)]
    return "\n".join(text).encode()


def sample(trailer=b"", packed=True):
    """A file; packed: contents by Flate."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>", 5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold >>"}
    for k in (1, 2):
        body = zlib.compress(page_content(k)) if packed else page_content(k)
        objects[2 + k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (6 + k)
        objects[6 + k] = b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" * packed, body)
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k, v) for k, v in objects.items()) + b"\ntrailer << /Root 1 0 R " + trailer + b" >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_blocks(packed):
    blocks = pdf.text_blocks(sample(packed=packed))
    first = [b for b in blocks if b["page_number"] == 1]
    assert {b["page_number"] for b in blocks} == {1, 2} and (first[0]["page_width"], first[0]["page_height"]) == (612.0, 792.0)
    head = next(b for b in first if b["text"] == "First part")
    assert head["font_sizes"] == [18.0] and head["has_bold_span"] and 72 <= head["x0"] < 73 and head["y0"] < 792 - 700 < head["y1"]
    body = next(b for b in first if b["text"].startswith("Sales rose"))
    assert body["text"] == "Sales rose in all regions; they are joined words and cut at a hy-\nphen words (see below)." and not body["has_bold_span"]
    assert first[0]["y1"] <= 79.2 and any(b["text"] == "Page 1 of 2" and b["y1"] >= 712.8 for b in first)


def test_ruled_tables():
    assert pdf.ruled_tables(sample()) == [(1, [["Item", "2023", "2022"], ["Sales", "10", "9"]])]


@pytest.mark.parametrize(("content", "why"), [(b"", "not a PDF"), (b"hello", "not a PDF"), (sample(b"/Encrypt 9 0 R"), "encrypted"), (b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", "no pages"), (b"%PDF-1.4\n%%EOF", "no catalogue")])
def test_files_that_cannot_be_read(content, why):
    with pytest.raises(ValueError, match=why):
        pdf.text_blocks(content)


def test_objects():
    t = pdf.Tokens(b"<< /A#20b [1 -2.5 true null (a\\(b\\)\\101(c)) <48 69> 7 0 R] /C << >> >> % note\nBT")
    assert t.next() == {"A b": [1, -2.5, True, None, b"a(b)A(c)", b"Hi", pdf.Ref(7)], "C": {}} and t.next() == "BT" and t.next() is None


def test_object_streams_and_unicode_maps():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] >>", b"<< /Type /Page /MediaBox [0 0 100 200] /Resources << /Font << /F 4 0 R >> >> /Contents 5 0 R >>", b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"]
    at, heads, body = 0, [], b""
    for k, o in enumerate(inner, 1):
        heads.append(b"%d %d" % (k, len(body)))
        body += o + b" "
    head = b" ".join(heads) + b" "
    packed = zlib.compress(head + body)
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00480069> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
    show = b"BT /F 10 Tf 10 100 Td <000100100012> Tj ET"
    data = b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 4 /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    data += b"5 0 obj << /Length %d >> stream\n%s\nendstream endobj\n6 0 obj << /Length %d >> stream\n%s\nendstream endobj" % (len(show), show, len(cmap), cmap)
    (block,) = pdf.text_blocks(data)
    assert block["text"] == "Hiac" and block["page_height"] == 200.0 and at == 0
