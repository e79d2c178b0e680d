import unicodedata
import zlib

import numpy as np
import pytest

from claimloom.llm import fingerprints, language, packing, pieces, token_counts, tokens
from claimloom.llm.html_text import extracted, visible_text
from tests.llm import brute
from tests.llm.fixtures import frame, texts

PAIRS = texts(n=30) + [(3, "a row that repeats an id"), (None, "no id")]


def test_rank_file_and_tokenizer_agree():
    """Every character that takes the fast way, in several surroundings, and random mixtures."""
    files = tokens.default_files()
    slow = tokens._tokenizer(files[0])
    plain = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC]]
    made = [f"a{c}b {c} {c}{c}1{c}'s  {c}\n" for c in plain]
    pick = np.random.default_rng(1)
    made += ["".join(pick.choice(plain, 40)) for _ in range(2000)]
    for text, want in zip(made, slow.encode_batch(made, add_special_tokens=False)):
        assert tokens._PLAIN.fullmatch(text) and tokens.encode(text, files).tolist() == want.ids
    for text in ("日本語 テスト", "<|endoftext|> x", ""):
        assert tokens.encode(text, files).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_packing(spark):
    got = packing.packed(frame(spark, PAIRS), capacity=64).toPandas()
    files = tokens.default_files()
    want = []
    for i, t in PAIRS:
        n = len(tokens.encode(t or "", files)) + 1
        want += [(i, p, start, length) for p, (start, length) in enumerate(packing.cut(n, 64))]
    listed = [(None if np.isnan(d) else int(d), int(p), int(s), int(n)) for d, p, s, n in zip(got.doc_id, got.piece, got.start, got.length)]
    assert sorted(listed, key=str) == sorted(want, key=str)
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1].tolist()] and rows.length.sum() <= 64
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 64) + 1


def test_packing_takes_the_ids_of_the_tokenizer_file(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.default_files()[0])
    pairs = [*enumerate(["a <|endoftext|> b", "<|endoftext|>" * 70, "no such string", "日本 <|endoftext|>", "<|endoftext |>"]), (9, None)]
    want = []
    for i, t in pairs:
        own = np.array([*plain.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        want += [(i, p, s, n, zlib.crc32(own[s : s + n])) for p, (s, n) in enumerate(packing.cut(len(own), 64))]
    assert plain.encode(pairs[0][1], add_special_tokens=False).ids == [64, 220, 50256, 275]
    got = packing.packed(frame(spark, pairs), capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_packing_rounds_match_best_fit_decreasing():
    import bisect
    from collections import Counter

    pick = np.random.default_rng(4)
    for high, n in ((1024, 3000), (200, 3000), (12, 3000), (400, 500)):
        sizes = pick.integers(1, high + 1, n).tolist()
        gaps, bins = [], 0
        for s in sorted(sizes, reverse=True):
            at = bisect.bisect_left(gaps, s)
            gap = gaps.pop(at) if at < len(gaps) else 1024
            bins += gap == 1024
            bisect.insort(gaps, gap - s)
        opened = [p for kind, plan, _ in packing.rounds(dict(Counter(sizes)), 1024) if kind == "open" for p in plan]
        used = sum(-(-(p[2] - p[1]) // p[3]) for p in opened)
        assert used <= 1.01 * bins + 1


def test_fingerprints(spark):
    for pairs in (texts(n=30), texts(n=2)[:1], []):
        got = {r.doc_id: r for r in fingerprints.with_next(frame(spark, pairs)).collect()}
        order = sorted(pairs)
        assert len(got) == len(pairs)
        for k, (i, t) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            new = fingerprints.edited(t, after)
            assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint) == (len(t), brute.sha(new), fingerprints.fingerprint(t))
            assert got[i].near_edited == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(new))
            assert got[i].near_next == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(after))


def test_fingerprint_with_null_and_repeated_ids(spark):
    assert fingerprints.with_next(frame(spark, PAIRS)).count() == len(PAIRS)
    assert fingerprints.difference(fingerprints.fingerprint(""), fingerprints.fingerprint("x" * 9999)) <= 6 * 256 + 255


def test_fingerprint_steps(monkeypatch):
    text = "".join(t or "" for _, t in texts())
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "_STEP", 100)
    assert fingerprints.fingerprint(text) == whole


def test_token_counts(spark):
    files = tokens.default_files()
    want = sorted(((i, len(tokens.encode(t or "", files))) for i, t in PAIRS), key=str)
    for how in ({}, {"block_bytes": 64}, {"block_bytes": 2}):
        got = token_counts.counts(frame(spark, PAIRS).coalesce(2), **how)
        assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    assert token_counts.counts(frame(spark, PAIRS).limit(0)).collect() == []


def test_flat_files_on_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    pick = np.random.default_rng(6)
    want = []
    for name in ("a", "b", "c"):
        ids = pick.integers(0, 5, 200 * (name != "c")).astype("<u4")
        (tmp_path / name).write_bytes(ids.tobytes())
        ends = np.flatnonzero(ids == 0)
        sizes = np.diff(np.append(-1, ends)) - 1
        want += [(name, i, int(n), False) for i, n in enumerate(sizes)]
        rest = len(ids) - (ends[-1] + 1 if len(ends) else 0)
        want += [(name, len(ends), int(rest), True)] * int(rest > 0)
    got = token_counts.lengths(token_counts.blocks_of(spark, str(tmp_path), 16), end_id=0, width=4)
    assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.open) for r in got.collect()) == sorted(want)


def test_large_flat_files_are_read_in_ranges(spark, tmp_path, monkeypatch):
    """A sparse file over 2 GiB, which no one value can hold, and ranges of a few blocks."""
    with open(tmp_path / "a large", "wb") as file:
        file.truncate((1 << 31) + 6)
        file.seek((1 << 31) + 2)
        file.write(b"\x07\x00")
    blocks = token_counts.blocks_of(spark, str(tmp_path), 1 << 24)
    assert blocks.rdd.getNumPartitions() == 33
    assert [tuple(r) for r in token_counts.lengths(blocks, end_id=7).select("ordinal", "n_tokens", "open").orderBy("ordinal").collect()] == [(0, (1 << 30) + 1, False), (1, 1, True)]
    monkeypatch.setattr(token_counts, "RANGE_BYTES", 40)
    small = tmp_path / "small"
    small.mkdir()
    (small / "f").write_bytes(np.arange(100, dtype="<u2").tobytes() + b"x")
    got = sorted((r.block, bytes(r.bytes)) for r in token_counts.blocks_of(spark, str(small), 16).collect())
    assert [b for b, _ in got] == list(range(13)) and b"".join(x for _, x in got) == (small / "f").read_bytes()


def test_blocks_of_odd_bytes_are_an_error(spark):
    rows = [("f", 0, b"\x01\x00\x02"), ("f", 1, b"\x00\x03\x00")]
    blocks = spark.createDataFrame(rows, "file string, block long, bytes binary")
    with pytest.raises(ValueError, match="block 0 of f"):
        token_counts.lengths(blocks, end_id=3)
    with pytest.raises(ValueError, match="3 bytes"):
        token_counts.blocks_of(spark, "/", 3)


def test_pieces(spark):
    made = pieces.model(pieces.default_file())
    every = [t or "" for _, t in PAIRS] + ["  two  spaces ", "▁mark ▁", "tab\tnew\nline", "\x00", "日本 語"]
    for text in every:
        if "▁" not in text:
            assert [i for w in made.words(text) for i in made.segment(w)] == made.reader.encode(text)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(every)] + [(None, None, 2)], "doc_id long, text string, ids int")
    once = pieces.encoded(docs, dropout=0.3, seed=5).toPandas().sort_values("doc_id")
    again = pieces.encoded(docs.repartition(3), dropout=0.3, seed=5).toPandas().sort_values("doc_id")
    other = pieces.encoded(docs, dropout=0.3, seed=6).toPandas().sort_values("doc_id")
    assert once.lossless.all() and once.ids_crc32.tolist() == again.ids_crc32.tolist() != other.ids_crc32.tolist()
    back = pieces.decoded(pieces.encoded(docs, dropout=0.3), ids_col="ids").collect()
    assert {r.doc_id: r.text for r in back} == {**dict(enumerate(every)), None: ""}
    assert len({tuple(made.segment("▁unbelievable", v, 1, 0.5)) for v in range(4)}) > 1


def test_pieces_vary_with_each_occurrence(spark):
    made = pieces.model(pieces.default_file())
    every = ["the understanding of nothing " * 40 + "x" * 60 + " ▁▁ 日本語 " + str(k) for k in range(25)]
    docs = spark.createDataFrame([*enumerate(every), (None, None)], "doc_id long, text string").coalesce(1)
    for dropout in (0.0, 0.1, 0.5):
        got, kinds = pieces.encoded(docs, dropout=dropout, seed=3).collect(), set()
        for r in got:
            words = made.words(every[r.doc_id] if r.doc_id is not None else "")
            cuts = [made.segment(w, int(n), 3, dropout) for w, n in zip(words, pieces.occurrences(r.doc_id, len(words)))]
            want = np.array([i for c in cuts for i in c], "<u4").tobytes()
            assert (bytes(r.ids), r.n_ids, r.ids_crc32, r.lossless) == (want, len(want) // 4, zlib.crc32(want), True)
            kinds |= {tuple(c) for w, c in zip(words, cuts) if w == "▁understanding"}
        plain = tuple(made.segment("▁understanding"))
        assert kinds == {plain} if dropout == 0 else len(kinds) > 10
    # draws fall under the rate as often as it says, each on its own
    merges = made.many(["▁understanding"])[2]  # in which nothing is skipped
    keys = pieces.keys_of(pieces.occurrences(7, 4000), 3)
    none = [(pieces._draws(k, merges) >= int(0.1 * 2**32)).all() for k in keys]
    assert len(merges) > 5 and abs(np.mean(none) - 0.9 ** len(merges)) < 0.03


def test_language(spark):
    english, french = "the quick brown fox jumps over the lazy dog and runs", "le renard brun saute par dessus le chien paresseux été"
    rows = [(i, f"{english if i % 2 else french} {i}", "en" if i % 2 else "fr", i, 0.0) for i in range(80)]
    rows += [(90, None, "en", 0, 0.0), (91, "123 !!", "fr", 0, 0.0), (92, "", None, 0, 0.0), (93, english, None, 0, 0.0), (None, french * 3, None, 0, 0.0), (5, rows[5][1], "en", 5, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int, score double")
    got = language.trained_on_the_rest(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (90, 91, 92):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == ("en" if r.doc_id is not None and r.doc_id % 2 else "fr") and 0.5 < r.score <= 1
    none = language.classify(docs, language.learn(docs.limit(0)))
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    assert language.trained_on_the_rest(docs.limit(0)).collect() == []


def test_language_of_long_texts_is_that_of_their_pieces(monkeypatch):
    data = np.frombuffer(("é" * 50 + " ab " * 30).encode(), np.uint8)
    monkeypatch.setattr(language, "SLICE_BYTES", 7)
    cuts, owner = language.pieces(data, np.array([0, 30, 30, len(data)]))
    assert b"".join(data[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])) == data.tobytes()
    assert all(data[a:b].tobytes().decode() or True for a, b in zip(cuts[:-1], cuts[1:])) and sorted(set(owner)) == [0, 1, 2]
    assert (language._letters()[[ord("É"), ord("1"), ord("語")]] == [ord("é"), 32, ord("語")]).all() and unicodedata.category("語") == "Lo"


def test_html_layout(spark):
    page = (
        "<html><head><title>no</title><style>.ad, #x{display:none}</style><body><h1>Top &amp; more</h1><p>one<p>two<br>three"
        "<ul><li>a<li>b<ol start=9><li>x<li>y</ol><li>c</ul><div class='big ad'>no</div><p id=x>no</p><span hidden>no</span>"
        "<p style='visibility:hidden'>no<b style='visibility:visible'>yes</b></p><script>if(a<b)no()</script>"
        "<table><tr><th>n<th>value<tr><td>alpha<td>1<tr><td colspan=2>wide<tr><td rowspan=2>r<td>2<tr><td>3</table><pre> p\n  q</pre>z"
    )
    want = (
        "Top & more\n\none\n\ntwo\nthree\n\n- a\n- b\n   9. x\n  10. y\n- c\n\nyes\n\n"
        "n      value\nalpha  1\nwide\nr      2\n       3\n\n p\n  q\n\nz"
    ).replace("   9. x\n  10. y", "  9. x\n  10. y")
    assert visible_text(page) == want
    assert visible_text("<div>" * 3000 + "deep") == "deep" and visible_text("a < b") == "a < b" and visible_text("<!-- x") == ""
    assert visible_text("<head><meta><p>shown") == "shown" and visible_text(None) == ""
    rows = [(1, page, "t"), (1, page, "t"), (None, None, None), (2, " ", "x")]
    got = extracted(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(r.text for r in got) == ["", "", want, want] and got[0].asDict().keys() == {"page_id", "text"}


def test_html_table_foot():
    page = "<table><tfoot><td>Total 5</td></tfoot><tr><td>a<td>5</table>"
    assert visible_text(page) == "a        5\nTotal 5"
    assert visible_text("<table><tfoot>astray<form>inside</form><tr><td>foot</tfoot><tbody><tr><td>body</table>") == "astray\ninside\nbody\nfoot"


def test_html_visibility():
    assert visible_text("a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b") == "a x=2 b"
    drawn = "<svg><title>no</title><defs><text>no</text></defs><text>Jan<tspan>uary</tspan></text><text>May</text><text display='none'>no</text></svg>"
    assert visible_text(f"c {drawn} d") == "c January May d" and visible_text("<defs>shown</defs>") == "shown"
    style = "<style>.h{visibility:hidden} b{visibility:visible} #s{visibility:visible}</style>"
    assert visible_text(f"{style}<p class=h>no<b>yes</b><i id=s>and</i><p id=s class=h>too") == "yesand\n\ntoo"
    hide, show = "style='visibility:hidden'", "style='visibility:visible'"
    assert visible_text(f"<table><tr><td {hide}>x<td>y<tr {hide}><td>no<td {show}>z</table>") == "y\nz"
    assert visible_text(f"<table {hide}><tr><td>no<td {show}>seen<tbody {show}><tr><td>both</table>") == "      seen\nboth"
    assert visible_text(f"{style}<table><thead class=h><tr><td>no</thead><tr><td class=h>no<td>v</table>") == "v"


def test_html_depth():
    deep = "<div>" * 1000
    assert visible_text(f"<div hidden>{deep}no{'</div>' * 1000}no</div>yes") == "yes"
    assert visible_text(f"{deep}a<span hidden>no</span><ul><li>b</ul><pre>c  d</pre><table><tr><td>e<td>f</table>") == "a\n\n- b\n\nc  d\n\ne  f"
    assert visible_text("<b>" * 100_000 + "x" + "</i>" * 100_000 + "<p>y" * 1000) == "x\n\n" + "\n\n".join("y" * 1000)
    nested = "<table><tr><td>" * 400 + "x" + "</table>" * 400
    assert visible_text(nested) == "x"


def test_short_and_long_agendas_agree():
    made = pieces.model(pieces.default_file())
    pick = np.random.default_rng(2)
    for n in range(600):
        word = "▁" * int(pick.integers(0, 3)) + "".join(pick.choice(list("etaoinhsrthéü日 ")).replace(" ", "") for _ in range(int(pick.integers(1, 40))))
        for dropout in (0.0, 0.1, 0.5):
            limit = int(dropout * (1 << 32))
            assert made._short(word, n, limit) == made._long(word, n, limit)
