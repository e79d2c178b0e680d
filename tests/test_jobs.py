"""Joins under skew, retrieval paths, near-duplicates, sources and streams."""

import itertools
import json
import random

from pyspark.sql import functions as F

from claimloom.functions import media as MF
from claimloom.functions import text as X
from claimloom.functions import web as U
from claimloom.operators import claims as C
from claimloom.operators import corpus as K
from claimloom.operators import declared as D
from claimloom.operators import evidence as E
from claimloom.operators import media as M
from claimloom.operators import report as P
from claimloom.operators import retrieve as R
from claimloom.operators.skew import salted_join
from claimloom.plans.verify import WHOLE, judge, verify
from claimloom.sources import files, registry
from claimloom.streaming import incremental, standing
from claimloom.streaming import logs as L


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_salted_join_equals_plain_join(spark):
    many = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).otherwise(7).alias("k"), F.col("id").alias("x"))
    other = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    for how in ("inner", "left"):
        assert rows(salted_join(many, other, "k", ["x"], how, hot_rows=20)) == rows(many.join(other, "k", how))


CLAIMS = ["The central bank raised interest rates to 9 percent in Chittagong", "Floods displaced 25000 residents of Sylhet district this week", "Nothing here matches"]
DOCS = [
    "Chittagong: central bank raised interest rates to 9 percent, officials said on Monday after a meeting.",
    "Floods in Sylhet district displaced 40000 residents, the relief agency reported this week in a statement.",
    "Rumour: the claim that the central bank raised interest rates in Chittagong is false and was denied by officials.",
    "Football results from the league", "", "Floods displaced 25000 residents of Sylhet district this week, an agency confirmed in its bulletin.",
]


def _claims(spark):
    texts = spark.createDataFrame([(i, 0, "USER_TEXT", t) for i, t in enumerate(CLAIMS)], "submission_id int, origin_no int, origin string, text string")
    return C.claim_queries(C.extract_claims(texts))


def _docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(DOCS)], "doc_id int, body string")


def test_both_retrieval_paths_agree(spark):
    c, d = _claims(spark), X.with_tokens(_docs(spark), "body", "tokens")
    a, b = R.relevance(c, d), R.relevance(c, d, broadcast_claims=0)
    assert rows(a.select("claim_id", "doc_id", F.round("score", 9))) == rows(b.select("claim_id", "doc_id", F.round("score", 9)))
    assert {(r["claim_id"], r["doc_id"]) for r in a.collect()} >= {("0#0", 0), ("1#0", 1), ("0#0", 2), ("1#0", 5)}


def test_labels(spark):
    c, d = _claims(spark), _docs(spark)
    chosen = R.documents_to_read(R.relevance(c, X.with_tokens(d, "body", "tokens")).withColumn("provider_no", F.lit(0)))
    for limit in (1000, 0):
        ev = E.evidence_for_claims(c, chosen, d, broadcast_pairs=limit)
        got = {(r["claim_id"], r["doc_id"]): (r["relationship"], r["rationale"]) for r in ev.collect()}
        assert got[("0#0", 0)] == ("SUPPORTS", "Passage reports the same figure (9) for the same subject.")
        assert got[("1#0", 1)] == ("CONTRADICTS", "Numeric disagreement: claim states 25000, source states 40000")
        assert got[("0#0", 2)][0] == "CONTRADICTS"
        assert got[("1#0", 5)][0] == "SUPPORTS"


def test_passages_are_bounded(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(60)) + "\n\nshort\n" + "x" * 900
    got = spark.createDataFrame([(text,)], "t string").select(E.split_passages(F.col("t"))).first()[0]
    assert all(60 <= len(p) <= 600 for p in got) and got[-1] == "x" * 600


def test_markers_are_whole_words(spark):
    df = spark.createDataFrame([("মুনাফা বেড়েছে",), ("এটি সত্য না।",), ("north notes",), ("it was denied, no evidence found",)], "t string")
    from claimloom import vocab as V

    both = V.NEGATION_EN + V.NEGATION_BN
    got = [r[0] for r in df.select(E.count_markers(F.lower("t"), E.marker_words(F.lower("t")), both)).collect()]
    assert got == [0, 1, 0, 2]


def test_label_replies(spark):
    ok = '```json\n{"relationship": "SUPPORTS", "directness": 0.9, "reason": "same"}\n```'
    bad = ['{"relationship": "MAYBE", "reason": "x"}', '{"relationship": "SUPPORTS"}', '{"relationship":"NEUTRAL","reason":"r","confidence":2}', "no json", None]
    df = spark.createDataFrame([(ok,)] + [(b,) for b in bad], "raw string")
    got = [r[0] for r in df.select(E.parse_labels(F.col("raw"))).collect()]
    assert (got[0]["relationship"], got[0]["directness"], got[0]["confidence"]) == ("SUPPORTS", 0.9, 0.5)
    assert got[1:] == [None] * 5


def test_override_keeps_lexical_label_unless_valid(spark):
    ev = spark.createDataFrame([("a", "NEUTRAL", 0.2, "r", 0.4, "lexical"), ("b", "NEUTRAL", 0.2, "r", 0.4, "lexical")], "evidence_id string, relationship string, directness double, rationale string, label_confidence double, classifier string")
    lab = spark.createDataFrame([("a", json.dumps({"relationship": "CONTRADICTS", "reason": "no"})), ("b", "oops")], "evidence_id string, raw string")
    got = {r["evidence_id"]: (r["relationship"], r["classifier"]) for r in E.override_labels(ev, lab).collect()}
    assert got == {"a": ("CONTRADICTS", "llm"), "b": ("NEUTRAL", "lexical")}


def test_article_fallback_to_summary(spark):
    cand = spark.createDataFrame([(1, "u1", None, "t", "sum", None), (2, "u2", None, "t", "", None), (3, "u3", None, "t", "s3", None)], "doc_id int, url string, canonical_url string, title string, summary string, published_at timestamp")
    art = spark.createDataFrame([("u1", "body", "T", "c", None)], "url string, body string, title string, canonical_url string, published_at timestamp")
    got = {r["doc_id"]: (r["body"], r["title"], r["canonical_url"]) for r in E.with_article(cand, art).collect()}
    assert got == {1: ("body", "T", "c"), 3: ("s3", "t", None)}


def test_urls(spark):
    bad = {
        "http://127.0.0.1/": "blocked_ip_literal", "http://127.1/": "blocked_ip_literal", "http://2130706433/": "blocked_ip_literal", "http://0x7f000001/": "blocked_ip_literal",
        "http://0177.0.0.1/": "blocked_ip_literal", "http://[::ffff:127.0.0.1]/": "blocked_ip_literal", "http://[fe80::1]/": "blocked_ip_literal", "http://a@b.example/": "credentials_in_url",
        "file:///etc/passwd": "bad_scheme", "http://x.example:22/": "blocked_port", "http://metadata.google.internal/": "blocked_hostname", "http://db.svc.cluster.local/": "blocked_hostname_suffix",
        "http://example.com%00.evil.example/": "invalid_hostname_chars", "http://intranet/": "bare_hostname", "http://a\\b.example/": "backslash", "": "empty_url", "http://x.example/\x01": "control_characters",
    }
    good = ["https://example.org/a?b=c", "http://8.8.8.8/", "https://sub.example.co.uk:443/", "http://bücher.example/"]
    df = spark.createDataFrame([(u,) for u in list(bad) + good], "url string")
    got = {r["url"]: (r["reject_reason"], r["host"]) for r in U.url_audit(df).collect()}
    assert {u: got[u][0] for u in bad} == bad
    assert [got[u][0] for u in good] == [None] * 4
    assert got["http://bücher.example/"][1] == "xn--bcher-kva.example"


def test_uploads(spark):
    jpeg = bytes.fromhex("FFD8FFE000104A464946000101") + b"0" * 20
    cases = [
        (jpeg, "image/jpeg", "IMAGE", "image/jpeg", None), (jpeg, "image/png", "IMAGE", "image/jpeg", "type_mismatch"), (jpeg + b"<script>", None, "IMAGE", "image/jpeg", "polyglot"),
        (b"RIFF0000WAVEfmt ", None, "IMAGE", None, "unsupported_type"), (b"", None, "IMAGE", None, "empty"), (bytes.fromhex("00000018") + b"ftypmp42aaaa", None, "VIDEO", "video/mp4", None),
        (jpeg, None, "VIDEO", "image/jpeg", "unsupported_type"), (b"\xff\xd8\xff", None, "IMAGE", None, "unsupported_type"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1], c[2]) for i, c in enumerate(cases)], "media_id int, content binary, declared_type string, kind string")
    got = {r["media_id"]: (r["detected_type"], r["refusal"]) for r in M.media_signature(df).collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(cases)}


def test_near_hashes_equal_brute_force(spark):
    base = [0, 1, 3, 7, 15, 1 << 59, (1 << 59) | 1, 12345678901234, 12345678901235, 0, 0]
    got = D.near_hashes(spark.createDataFrame(list(enumerate(base)), "i int, h long"), "i", "h")
    first = {h: base.index(h) for h in base}
    want = {(first[a], first[b], bin(a ^ b).count("1")) for a, b in itertools.combinations(sorted(first), 2) if bin(a ^ b).count("1") <= 3}
    assert {(r["rep_a"], r["rep_b"], r["distance"]) for r in got.collect()} == want


def test_similar_titles_equal_brute_force(spark):
    titles = ["central bank raises rates", "central bank raised rates", "bank rates", "floods in sylhet", "flood in sylhet", "unrelated", ""]
    df = spark.createDataFrame(list(enumerate(titles)), "id int, title string")

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {
        (i, j) for i, a in enumerate(titles) for j, b in enumerate(titles)
        if grams(a) and grams(b) and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.5
    }
    got = D.similar_titles(df, df, 0.5)
    assert {(r["left_id"], r["right_id"]) for r in got.collect()} == want


def test_similar_titles_meet_without_a_shuffle(spark):
    rng = random.Random(5)
    words = ["bank", "banks", "rate", "rates", "flood", "floods", "central", "centre", "ñandú", "ción", "42", "of", "the"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(160)] + ["", None, "\t.\n", "bank " * 300]
    rows = [(i % 150 if i % 20 else None, t) for i, t in enumerate(titles)]
    left = spark.createDataFrame([(i, t) for i, t in rows if i is None or i < 60], "id int, title string")
    right = spark.createDataFrame(rows, "id int, title string")

    def grams(t):
        return {("  " + w + " ")[i : i + 3] for w in (t or "").split() if w != "." for i in range(len(w) + 1)}

    def alike(a, b, least):
        return bool(a and b) and len(a & b) / len(a | b) >= least

    for least in (0.3, 0.5, 0.8, 1.0):
        want = sorted((i, j) for i, a in rows if i is not None and i < 60 for j, b in rows if j is not None and alike(grams(a), grams(b), least))
        got = D.similar_titles(left, right, least)
        assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == want
        assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    unique = right.where("id > 10").dropDuplicates(["id"])
    shuffled = D.similar_titles(unique, unique, broadcast_titles=0)
    assert "hashpartitioning" in shuffled._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, D.similar_titles(unique, unique).collect()))
    assert D.similar_titles(left.limit(0), right).collect() == []


def test_phrases_of_few_claims_go_to_every_task(spark):
    claims = spark.createDataFrame([("a", ["x", "y", "x", "y", "z"]), ("b", ["y", "z"]), ("b", ["y", "z"]), (None, ["p", "q"]), ("c", None)], "claim_id string, tokens array<string>")
    texts = spark.createDataFrame([(1, ["x", "y", "z"]), (1, ["p", "q"]), (2, ["y", "x", "y"]), (3, ["z"]), (None, ["y", "z"]), (4, None)], "text_id int, tokens array<string>")
    want = {("a", 1, 3), ("b", 1, 2), (None, 1, 1), ("a", 2, 3), ("a", None, 1), ("b", None, 2)}
    few, many = R.phrase_bonus(claims, texts), R.phrase_bonus(claims, texts, broadcast_phrases=0)
    for got in (few, many):
        assert {(r["claim_id"], r["text_id"], r["matches"]) for r in got.collect()} == want
    # pairs of tokens of texts are not shuffled
    assert few._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(pair") == 0
    assert many._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 0


def test_primary_suffixes(spark):
    df = spark.createDataFrame([("usgs.gov",), ("quake.usgs.gov",), ("notusgs.gov",), ("www.who.int",)], "domain string")
    got = {r["domain"]: r["is_primary"] for r in K.primary_flags(df, registry.primary_sources(spark)).collect()}
    assert got == {"usgs.gov": True, "quake.usgs.gov": True, "notusgs.gov": False, "www.who.int": True}


def test_feed_files_and_registry(spark, tmp_path):
    (tmp_path / "reg.json").write_text(json.dumps({
        "feeds": [{"name": "N", "url": "https://n.example/rss", "domain": "n.example", "source_type": "NEWS_AGENCY"}, {"name": "broken"}],
        "primary_sources": {"health": [{"domain": "who.int"}]},
    }))
    feeds, primary = registry.load_registry(spark, str(tmp_path / "reg.json"))
    assert [(r["name"], r["language"], r["enabled"]) for r in feeds.collect()] == [("N", "en", True)]
    assert [(r["domain"], r["name"]) for r in primary.collect()] == [("who.int", "who.int")]
    items = "".join(f"<item><title>T{i} &amp; more</title><link>https://n.example/{i}</link><description>&lt;p&gt;Body {i}&lt;/p&gt;</description><pubDate>Mon, 15 Jan 2024 10:00:00 GMT</pubDate></item>" for i in range(70))
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "n.example.xml").write_text(f"<rss><channel><item><title>no link</title></item>{items}</channel></rss>")
    got = files.read_feeds(spark, str(tmp_path / "xml"), feeds).orderBy("entry_no").collect()
    assert len(got) == 59
    assert (got[0]["title"], got[0]["text"], str(got[0]["published_at"]), got[0]["source_type"]) == ("T0 & more", "Body 0", "2024-01-15 10:00:00", "NEWS_AGENCY")


def test_media_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "m1.jpg").write_bytes(bytes.fromhex("FFD8FFE000104A464946000101"))
    got = files.media_layout(files.read_media(spark, str(tmp_path)), "2024-02-03").first()
    assert got["storage_key"] == "media/2024/02/03/m1.jpg"


def _events(spark, path):
    data = [(f"2024-01-01 0{h}:{m:02d}:00", op, who, f"{who}-{m % 3}") for h in range(4) for m in range(0, 60, 7) for op in ("SEARCH", "VIDEO_SUBMISSION") for who in ("a", "b")]
    df = spark.createDataFrame(data, "t string, operation string, fingerprint string, job_id string").select(F.col("t").cast("timestamp").alias("ts"), "operation", "fingerprint", "job_id")
    df.write.parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(df.schema).parquet(path)


def test_stream_windows_equal_batch(spark, tmp_path):
    batch, stream = _events(spark, str(tmp_path / "e"))
    want = L.usage_windows(batch)
    assert rows(L.run_available(L.usage_windows(stream))) == rows(want)
    assert {r["allowed"] for r in want.where("operation = 'VIDEO_SUBMISSION'").collect()} == {False}


def test_stream_dedup_and_routing(spark, tmp_path):
    batch, stream = _events(spark, str(tmp_path / "e"))
    got = L.run_available(L.first_deliveries(stream, 900, "operation"), "append")
    want = L.first_deliveries(batch, 900, "operation")
    assert rows(got.select(*want.columns)) == rows(want)
    # every job comes back after more than the time to live, and close repeats are dropped
    assert batch.select("job_id").distinct().count() < want.count() < batch.count()
    fails = spark.createDataFrame([("a", 1, True), ("b", 3, True), ("c", 1, False)], "job_id string, attempt int, retryable boolean")
    fails.write.parquet(str(tmp_path / "f"))
    source = spark.readStream.schema(fails.schema).parquet(str(tmp_path / "f"))
    L.route_stream(source, str(tmp_path / "retry"), str(tmp_path / "dead"), str(tmp_path / "ck")).awaitTermination()
    assert [(r["job_id"], r["next_attempt"]) for r in spark.read.parquet(str(tmp_path / "retry")).collect()] == [("a", 2)]
    assert {r["job_id"] for r in spark.read.parquet(str(tmp_path / "dead")).collect()} == {"b", "c"}


def test_submissions_are_verified_as_they_arrive(spark, tmp_path):
    sub = spark.createDataFrame([("s1", CLAIMS[0] + "."), ("s2", "short")], "submission_id string, text string")
    sub.write.parquet(str(tmp_path / "in"))
    docs = _docs(spark).select(
        "doc_id", "body", F.lit("src").alias("source"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("u"), "doc_id").alias("url"),
        F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    src = spark.createDataFrame([("src", "Src", "NEWS_AGENCY", False)], "source string, source_name string, source_type string, is_primary boolean")
    stream = spark.readStream.schema(sub.schema).parquet(str(tmp_path / "in"))
    incremental.verify_stream(stream, docs, src, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r["verification_id"] for r in spark.read.parquet(str(tmp_path / "out/overall")).collect()] == ["s1"]
    assert [r["reject_reason"] for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == ["text_length"]
    verdicts = spark.read.parquet(str(tmp_path / "out/claim_scores")).collect()
    assert [v["verdict"] for v in verdicts] == ["PARTLY_TRUE"]


def test_no_cap_without_an_argument_that_lifts_it(spark):
    long = "word " * 200 + "end."
    got = spark.createDataFrame([(long + "\nshort one.",)], "t string").select(
        E.split_passages(F.col("t")).alias("a"), E.split_passages(F.col("t"), None, None).alias("b")
    ).first()
    assert [len(x) for x in got["a"]] == [600] and got["b"] == [long, "short one."]
    paragraphs = F.array(*[F.lit("p" * 9000)] * 3)
    sizes = spark.range(1).select(F.length(U.article_text(paragraphs)), F.length(U.article_text(paragraphs, None))).first()
    assert tuple(sizes) == (12_000, 27_004)
    text = " ".join(f"Sentence number {i} says something here." for i in range(40))
    spoken = spark.createDataFrame([(1, 0, "USER_TEXT", text)], "submission_id int, origin_no int, origin string, text string")
    assert C.extract_claims(spoken, parse=False).count() == 25 and C.extract_claims(spoken, None, parse=False).count() == 40
    head = F.lit("x" * 3000 + "<script").cast("binary")
    assert tuple(spark.range(1).select(MF.has_markup(head), MF.has_markup(head, None)).first()) == (False, True)
    # a whole run: no fewer documents, passages or claims than the usual one
    docs = _docs(spark).select(
        "doc_id", "body", F.lit("src").alias("source"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("u"), "doc_id").alias("url"),
        F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    src = spark.createDataFrame([("src", "Src", "NEWS_AGENCY", False)], "source string, source_name string, source_type string, is_primary boolean")
    sub = spark.createDataFrame([("s1", CLAIMS[0] + ". " + "Filler words of no use at all. " * 30 + CLAIMS[1] + ".")], "submission_id string, text string")
    usual, whole = verify(sub, docs, src), verify(sub, docs, src, limits=WHOLE)
    assert usual.claims.count() == 25 and whole.claims.count() == 32
    assert {(r["claim_text"], r["doc_id"]) for r in usual.evidence.select("claim_text", "doc_id").collect()} < {(r["claim_text"], r["doc_id"]) for r in whole.evidence.select("claim_text", "doc_id").collect()}


def test_standing_claims_end_as_one_run_over_all(spark, tmp_path):
    docs = _docs(spark).select(
        F.col("doc_id").cast("long").alias("doc_id"), "body", F.lit("src").alias("source"), F.lit(None).cast("string").alias("title"),
        F.concat(F.lit("u"), "doc_id").alias("url"), F.lit(None).cast("string").alias("canonical_url"),
        F.lit(None).cast("timestamp").alias("published_at"), F.lit(None).cast("timestamp").alias("created_at"),
    )
    src = spark.createDataFrame([("src", "Src", "NEWS_AGENCY", False)], "source string, source_name string, source_type string, is_primary boolean")
    claims = _claims(spark)
    waiting = standing.StandingClaims(spark, str(tmp_path / "claims"), src)
    waiting.register(claims, docs)
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    waiting.start(arriving, str(tmp_path / "ck")).awaitTermination()
    tokened = X.with_tokens(docs.select("doc_id", "body"), "body", "tokens").drop("body")
    best = R.documents_to_read(R.relevance(claims, tokened, 0.12).withColumn("provider_no", F.lit(0))).drop("provider_no")
    want = judge(claims, best, docs, src)[1]
    assert rows(waiting.latest().select(want.columns)) == rows(want)
    # a claim that no document touches keeps its first revision, and its shelf row is not asked for
    revisions = {r["claim_id"]: r["n"] for r in waiting.revisions().groupBy("claim_id").agg(F.max("revision").alias("n")).collect()}
    assert revisions["2#0"] == 1 and revisions["0#0"] > 1
    one = tokened.where("doc_id = 5")
    assert {r["claim_id"] for r in waiting.touched(one).collect()} == {"1#0"}
    # a batch that is run again leaves one copy
    before = rows(waiting.revisions())
    last = max(r["epoch"] for r in waiting.revisions().select("epoch").distinct().collect())
    again = spark.read.parquet(str(tmp_path / "claims/documents")).where(F.col("epoch") == last).select(docs.columns)
    waiting.meet(again, last)
    assert rows(waiting.revisions()) == before


def test_vector_topk_is_exact_in_any_width(spark):
    import numpy as np

    pick = np.random.default_rng(1)
    v = pick.normal(size=(300, 384)).astype("float32")
    v[7] = v[8] = v[0] * 2  # ties go to the smaller id
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 384), (902, [1.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(5)] + [(99, None)], "query_id long, embedding array<float>")
    got = D.vector_topk(queries, vectors.repartition(4), 10, block_bytes=2 * 384 * 8)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    sims = np.round(unit[:5] @ unit.T, 9)
    want = {(q, int(d), r + 1) for q in range(5) for r, d in enumerate(np.lexsort((np.arange(300), -sims[q]))[:10])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in got.collect()} == want


def test_run_state_until_all_stages_end(spark):
    from claimloom import vocab as V

    stages = [s for s in V.STAGE_SEQUENCE if s != "ANALYZING_MEDIA"]
    rows = [("open", stages[0], "RUNNING"), ("fatal", V.FATAL_STAGES[0], "FAILED")]
    rows += [("done", s, "COMPLETED") for s in stages]
    soft = next(s for s in stages if s not in V.FATAL_STAGES)
    rows += [("soft", s, "FAILED" if s == soft else "SKIPPED") for s in stages]
    log = spark.createDataFrame([(a, b, c, i) for i, (a, b, c) in enumerate(rows)], "verification_id string, stage string, status string, event_id int")
    log = log.withColumn("ts", F.timestamp_seconds("event_id"))
    runs = spark.createDataFrame([(n, n == "media") for n in ("open", "fatal", "done", "soft", "media")], "verification_id string, has_media boolean")
    got = {r["verification_id"]: (r["status"], r["verdict_is_null"], r["degraded"]) for r in P.stage_state(runs, log).collect()}
    assert got == {
        "open": ("RUNNING", True, False), "fatal": ("FAILED", True, False), "done": ("COMPLETED", False, False),
        "soft": ("COMPLETED", False, True), "media": ("QUEUED", True, False),
    }


def test_texts_are_cut_down_to_what_claims_hold(spark):
    """Scoring searches a text for the terms and pairs of claims only, however long it is."""
    from claimloom.operators import retrieve as R

    words = [f"word{n}xyz" for n in range(500)]
    docs = spark.createDataFrame([(1, ["it's", "budget", "deficit", "2024", *words]), (2, words), (3, None)], "doc_id long, tokens array<string>")
    tokens = ["budget", "deficit", "it's", "a\\b"]
    claims = spark.createDataFrame([("c", [([*tokens],)])], "claim_id string, queries array<struct<tokens:array<string>>>")
    profiles = R.query_profiles(claims)
    cut = {r["doc_id"]: r for r in R.known_only(R.text_profiles(docs, ["doc_id"]), profiles).collect()}
    assert cut[1]["terms"] == ["it's", "budget", "deficit"] and cut[1]["pairs"] == ["budget deficit"] and cut[1]["probes"] == ["budget", "deficit"]
    assert cut[2]["terms"] == cut[2]["pairs"] == cut[2]["probes"] == []
    whole = {r["doc_id"]: r for r in R.known_only(R.text_profiles(docs, ["doc_id"]), profiles, most=2).collect()}
    assert len(whole[1]["terms"]) == 504
    for most in (0, 20_000):  # by both paths
        assert [tuple(r)[:2] for r in R.relevance(claims, docs, broadcast_claims=most).collect()] == [("c", 1)]
