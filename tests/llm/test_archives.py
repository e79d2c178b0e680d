import base64
import glob
import gzip
import hashlib

from claimloom.llm import warc

ROWS = [
    (1, "http://a/1", "<p>x</p>", 0), (5, "http://a/5", "<p>x</p>", 0), (2, None, None, 0), (3, "http://a b\n", "", 0), (4, "http://c", "é😀" * 9000, 0),
    (None, "http://n", "<p>x</p>", 0), (7, "http://w", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", 0),
]
SCHEMA = "page_id long, url string, html string, payload int"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def found(df):
    return sorted(((warc.page_of(r.record_id), r.record_type, warc.page_of(r.refers_to), r.payload_bytes, r.payload_digest) for r in df.collect()), key=str)


WANT = sorted(
    [
        (i, *(("revisit", g) if g is not None else ("response", None)), len((t or "").encode()), digest(t))
        for (i, _, t, _), g in zip(ROWS, [5, None, 3, None, None, 5, None])
    ],
    key=str,
)


def test_round_trip_and_salvage(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame(ROWS, SCHEMA).coalesce(1), path)
    assert found(warc.read(spark, path)) == WANT
    payloads = {warc.page_of(r.record_id): bytes(r.payload) for r in warc.read(spark, path).collect() if r.record_type == "response"}
    assert payloads[4] == ROWS[4][2].encode() and payloads[3] == b""
    # damage: a byte inside the second member, junk before the third
    whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(path + "/part-*")))
    assert gzip.decompress(whole).count(b"WARC-Record-ID") == len(ROWS)
    spans = [(a, b) for a, b, h, _ in warc.salvage(whole) if h]
    (a, b), (c, _) = spans[1], spans[2]
    hurt = whole[: a + 20] + bytes([whole[a + 20] ^ 255]) + whole[a + 21 : c] + b"\x1f\x8b\x08junkWARC/1.1\r\n" + whole[c:] + whole[:30]
    parts = list(warc.salvage(hurt))
    gaps = [(x, y) for x, y, h, _ in parts if h is None]
    assert gaps == [(a, c + 17), (len(hurt) - 30, len(hurt))]
    assert sum(h is not None for _, _, h, _ in parts) == len(ROWS) - 1


def test_plain_records_and_checks():
    good = warc.build_record(9, "http://x", b"body", None, True, "2024-01-01T00:00:00Z") + b"\r\n\r\n"
    assert [h is not None for _, _, h, _ in warc.salvage(good * 3)] == [True] * 3
    hurt = good.replace(b"body", b"bady")
    assert [(a, b, h is not None) for a, b, h, _ in warc.salvage(good + hurt + good)] == [
        (0, len(good), True), (len(good), 2 * len(good), False), (2 * len(good), 3 * len(good), True),
    ]
    assert [h for _, _, h, _ in warc.salvage(good[:-9])] == [None] and list(warc.salvage(b"")) == []


def test_salvage_inside_members():
    """Members of several records with a bad record, a bad checksum, a cut end and a damaged place."""
    good = [warc.build_record(k, f"http://x/{k}", f"body {k} ".encode() * 40, None, True, "2024-01-01T00:00:00Z") + b"\r\n\r\n" for k in range(9)]
    bad = good[4].replace(b"body 4 body", b"body 4 bodx")

    def ids(data):
        return [warc.page_of(h["warc-record-id"]) if h else "gap" for _, _, h, _ in warc.salvage(data)]

    one, after = gzip.compress(b"".join([*good[:4], bad, *good[5:]]), mtime=0), warc.member(good[0][:-4])
    assert ids(one + after) == [0, 1, 2, 3, "gap", 5, 6, 7, 8, 0]
    assert [(a, b, len(x)) for a, b, h, x in warc.salvage(one) if h is None] == [(0, len(one), len(bad))]
    assert ids(gzip.compress(b"".join(good[:3]) + b"rest", mtime=0) + after) == [0, 1, 2, "gap", 0]
    for level in (0, 6):  # stored bytes show the version lines in the file, too
        whole = gzip.compress(b"".join(good), level, mtime=0)
        assert ids(whole + after) == [*range(9), 0]
        hurt = whole[:-8] + bytes([whole[-8] ^ 255]) + whole[-7:]
        assert ids(hurt + after) == [*range(9), "gap", 0]
        assert ids(whole[:-3]) == [*range(9), "gap"]
        most = ids(whole[: len(whole) * 9 // 10])
        assert most[-1] == "gap" and most[:-1] == list(range(len(most) - 1)) and len(most) > 3


def test_long_member_ends_in_a_zero_byte():
    packed = warc.member(b"x" * (1 << 24))
    assert packed[-1] == 0 and gzip.decompress(packed) == b"x" * (1 << 24) + b"\r\n\r\n"


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).collect() == []
