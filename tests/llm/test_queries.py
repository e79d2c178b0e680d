"""The registered queries over a small whole table, beside plain versions (SQL where there is some)."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from claimloom.llm import fingerprints, packing, pieces, tokens
from claimloom.llm.html_text import visible_text
from claimloom.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.fixtures import frame, texts

PAIRS = sorted(texts(n=40))
PAGES = [(k, f"http://h/{k}", f"<p>page {k % 7}<ul><li>a</ul>" if k % 5 else None) for k in range(20)]


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, PAIRS).write.parquet(path + "/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(path + "/pages.parquet")
    return path


def got(spark, home, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in QUERIES[name](spark, home).collect()), key=str)


def ids(text):
    return tokens.encode(text or "", tokens.default_files())


def test_op1(spark, home):
    want = [(i, len(visible_text(h)), visible_text(h)) for i, _, h in PAGES]
    assert got(spark, home, "op1_html_extraction", "page_id", "n_chars", "text") == sorted(want, key=str)


def test_op2(spark, home):
    want = brute.components(PAIRS, 3, 90, 100)
    assert got(spark, home, "op2_jaccard_join", "doc_id", "n_shingles", "component_id") == sorted(want, key=str)


def test_op3(spark, home):
    want = []
    for (i, t), (_, after) in zip(PAIRS, PAIRS[1:] + PAIRS[:1]):
        new = fingerprints.edited(t or "", after or "")
        a, b, c = map(fingerprints.fingerprint, (t or "", new, after or ""))
        want.append((i, len(t or ""), brute.sha(new), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert got(spark, home, "op3_fingerprints", *columns) == sorted(want, key=str)


def test_op4(spark, home):
    want = []
    for i, t in PAIRS:
        own = np.append(ids(t), packing.END_ID).astype("<u4")
        want += [(i, p, s, n, zlib.crc32(own[s : s + n])) for p, (s, n) in enumerate(packing.cut(len(own), 1024))]
    assert got(spark, home, "op4_packing", "doc_id", "piece", "start", "length", "ids_crc32") == sorted(want, key=str)


def test_op5(spark, home):
    want = [(i, n, gone, brute.sha(kept)) for i, n, gone, kept in brute.stripped(PAIRS, 20)]
    assert got(spark, home, "op5_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)


def test_op6(spark, home):
    assert got(spark, home, "op6_token_counts", "doc_id", "n_tokens") == sorted(((i, len(ids(t))) for i, t in PAIRS), key=str)


def test_op7(spark, home):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{home}/documents.parquet/*.parquet'")
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op7_exact_dedup']})").fetchall()
    assert got(spark, home, "op7_exact_dedup", *columns) == sorted(want, key=str)


def test_op8(spark, home):
    model = pieces.model(pieces.default_file())
    want = []
    for i, t in PAIRS:
        words = model.words(t or "")
        own = [x for w, n in zip(words, pieces.occurrences(i, len(words)).tolist()) for x in model.segment(w, n, pieces.SEED, pieces.DROPOUT)]
        want.append((i, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), brute.sha(t or ""), True))
    columns = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "lossless"]
    assert got(spark, home, "op8_piece_encoding", *columns) == sorted(want, key=str)


def test_op9(spark, home):
    rows = got(spark, home, "op9_language_id", "doc_id", "held_out", "lang_pred")
    assert [(i, h) for i, h, _ in rows] == sorted(((i, zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in PAIRS), key=str)
    plain = dict(PAIRS)
    assert all((x == "und") == (not any(c.isalpha() for c in plain[i] or "")) for i, _, x in rows)


def test_op10(spark, home):
    last = {h or "": i for i, _, h in PAGES}
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        new = last[h or ""] == i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if new else "revisit", None if new else last[h or ""]))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert got(spark, home, "op10_warc", *columns) == sorted(want, key=str)
