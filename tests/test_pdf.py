import zlib

from lodestone.sources.parsers import parse_document


def pdf(objects, trailer=b""):
    out = b"%PDF-1.5\n"
    for k, body in objects.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    return out + b"trailer\n<< /Root 1 0 R %s >>\n%%%%EOF" % trailer


def stream(head, body):
    return b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(body), body)


CMAP = b"1 beginbfchar <0001> <6F22> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"


def sample(packed=False):
    page1 = b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again)] TJ ET"
    page2 = b"BT /F2 9 Tf <000100020003> Tj ET"
    return pdf({
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R 4 0 R 10 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>",
        4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R] >>",
        5: b"<< /Type /Font /Subtype /Type1 >>",
        6: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
        7: stream(b"/Filter /FlateDecode", zlib.compress(page1)) if packed else stream(b"", page1),
        8: stream(b"", page2),
        9: stream(b"/Filter /FlateDecode", zlib.compress(CMAP)),
        10: b"<< /Type /Page /Parent 2 0 R >>",
    })


def test_pages():
    for packed in (False, True):
        status, code, _, blocks = parse_document("a.pdf", sample(packed))
        assert (status, code) == ("indexed", None)
        assert [(b.content, b.location_kind, b.location_value) for b in blocks] == [("Hello (PDF)\nWorld again", "page", "第 1 頁"), ("漢ab", "page", "第 2 頁")]


def test_codes():
    assert parse_document("a.pdf", b"nothing")[:2] == ("error", "PDF_CORRUPT")
    assert parse_document("a.pdf", pdf({1: b"<< /Type /Catalog >>"}))[:2] == ("error", "PDF_CORRUPT")
    assert parse_document("a.pdf", pdf({1: b"<< /Type /Catalog >>", 2: b"<< >>"}, b"/Encrypt 2 0 R"))[:2] == ("encrypted", "PDF_ENCRYPTED")
    assert parse_document("a.pdf", pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] >>", 3: b"<< /Type /Page >>"}))[0] == "no_text"


def test_object_streams():
    inner = b"<< /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] >> << /Type /Page /Contents 7 0 R >>"
    parts = [inner.index(b"<< /Type /Catalog"), inner.index(b"<< /Type /Pages /K"), inner.index(b"<< /Type /Page /C")]
    head = b" ".join(b"%d %d" % (k, at) for k, at in zip((1, 2, 3), parts)) + b" "
    body = zlib.compress(head + inner)
    data = pdf({7: stream(b"", b"BT (packed) Tj ET"), 8: stream(b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(head), body)})
    assert [b.content for b in parse_document("a.pdf", data)[3]] == ["packed"]
