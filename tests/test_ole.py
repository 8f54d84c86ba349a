"""Compound files are built here: a writer of the plainest kind."""

import struct

from lodestone.sources.parsers import parse_document

END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


def compound(streams):
    """streams: path -> bytes; folders are one level deep. All streams lie in large sectors, padded to 4096 bytes."""
    sectors, fat = [], []

    def add(raw):
        raw += bytes(-len(raw) % 512)
        first = len(sectors)
        for k in range(0, len(raw), 512):
            sectors.append(raw[k : k + 512])
            fat.append(len(sectors))
        fat[-1] = END
        return first

    entries = [["Root Entry", 5, END, FREE, 0]]
    folders = {}

    def link(parent, child):
        """Siblings form a chain to the right."""
        if entries[parent][3] == FREE:
            entries[parent][3] = child
            return
        k = entries[parent][3]
        while entries[k][5] != FREE:
            k = entries[k][5]
        entries[k][5] = child

    entries[0].append(FREE)
    for path, body in streams.items():
        folder, _, name = path.rpartition("/")
        parent = 0
        if folder:
            if folder not in folders:
                folders[folder] = len(entries)
                entries.append([folder, 1, 0, FREE, 0, FREE])
                link(0, folders[folder])
            parent = folders[folder]
        body = body + bytes(max(0, 4096 - len(body)))
        entries.append([name, 2, add(body), FREE, len(body), FREE])
        link(parent, len(entries) - 1)
    raw = b""
    for name, kind, first, child, size, right in entries:
        text = name.encode("utf-16-le") + b"\0\0"
        raw += text + bytes(64 - len(text)) + struct.pack("<HBB", len(text), kind, 1) + struct.pack("<III", FREE, right, child) + bytes(36) + struct.pack("<IQ", first, size)
    directory = add(raw)
    table = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack("<128I", *(fat + [FREE] * (128 - len(fat)))))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIIII", 1, directory, 0, 4096, END, 0, END, 0, table)
    return head + struct.pack("<I", FREE) * ((512 - len(head)) // 4) + b"".join(sectors)


def test_msg():
    text = lambda s: s.encode("utf-16-le")
    data = compound({"__substg1.0_0037001F": text("Sub"), "__substg1.0_0C1A001F": text("Ann"), "__substg1.0_5D01001F": text("a@x"), "__recip_version1.0_#0/__substg1.0_3001001F": text("Bob"), "__substg1.0_1000001F": text("one\r\n\r\ntwo")})
    blocks = parse_document("m.msg", data)[3]
    assert [(b.heading, b.content, b.location_value) for b in blocks] == [("Sub", "Sub", "郵件主旨"), (None, "Ann\na@x", "郵件寄件者"), (None, "Bob", "郵件收件者（類別未知） 1"), (None, "one", "郵件正文（純文字）／段落 1"), (None, "two", "郵件正文（純文字）／段落 2")]
    assert parse_document("m.msg", b"x")[1] == "MSG_FORMAT_ERROR"
    assert parse_document("m.msg", compound({"__substg1.0_001A001F": text("IPM.Contact")}))[1] == "MSG_ITEM_UNSUPPORTED"


def test_doc():
    body = "Café one\rx \x13 HYPERLINK \"http://l/\" \x14shown\x15 y\r".encode("cp1252")
    main = bytearray(0x600 + len(body))
    struct.pack_into("<H", main, 0, 0xA5EC)
    main[0x600:] = body
    pieces = struct.pack("<II", 0, len(body)) + struct.pack("<HIH", 0, 0x40000000 | 0x600 * 2, 0)
    clx = b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    data = compound({"WordDocument": bytes(main), "0Table": clx})
    assert [b.content for b in parse_document("d.doc", data)[3]] == ["Café one", "x shown http://l/ y"]
    struct.pack_into("<H", main, 10, 0x0100)
    assert parse_document("d.doc", compound({"WordDocument": bytes(main), "0Table": clx}))[:2] == ("encrypted", "DOC_ENCRYPTED")


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_xls():
    shared = struct.pack("<II", 2, 2) + struct.pack("<HB", 3, 0) + b"abc" + struct.pack("<HB", 4, 1) + "漢".encode("utf-16-le")
    more = b"\x01" + "字xy".encode("utf-16-le")  # the second string goes on here
    head = record(0x809, bytes(16))
    tail = record(0xFC, shared) + record(0x3C, more) + record(0x0A, b"")
    bound = lambda at: record(0x85, struct.pack("<IHBB", at, 0, 2, 0) + b"S1")
    at = len(head) + len(bound(0)) + len(tail)
    cell = lambda r, c: struct.pack("<HHH", r, c, 0)
    sheet = record(0x809, bytes(16)) + record(0xFD, cell(1, 0) + struct.pack("<I", 1)) + record(0xFD, cell(0, 1) + struct.pack("<I", 0)) + record(0x203, cell(0, 0) + struct.pack("<d", 2.5)) + record(0x27E, cell(2, 27) + struct.pack("<I", 7 << 2 | 2)) + record(0x205, cell(2, 0) + b"\x01\x00") + record(0x0A, b"")
    data = compound({"Workbook": head + bound(at) + tail + sheet})
    assert [(b.heading, b.content, b.location_value) for b in parse_document("x.xls", data)[3]] == [("S1", "2.5", "工作表「S1」!A1"), ("S1", "abc", "工作表「S1」!B1"), ("S1", "漢字xy", "工作表「S1」!A2"), ("S1", "TRUE", "工作表「S1」!A3"), ("S1", "7", "工作表「S1」!AB3")]
    assert parse_document("x.xls", compound({"Workbook": head + record(0x2F, b"") + tail}))[:2] == ("encrypted", "XLS_ENCRYPTED")
