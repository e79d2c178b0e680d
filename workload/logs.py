"""Event-log queries (events), listings and reports (orders), URL and media audits (pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom import vocab as V
from claimloom.functions import text as X
from claimloom.functions import web as U
from claimloom.operators import corpus as K
from claimloom.operators import dates
from claimloom.operators import declared as D
from claimloom.operators import media as M
from claimloom.operators import report as P
from claimloom.operators import scores as SC
from claimloom.session import cut_lineage, run_folder
from claimloom.streaming import logs as L
from claimloom.streaming import machines
from workload import scoring as W
from workload.base import quoted, table
from workload.corpus import CLAIMS, SOURCES, claims as benchmark_claims, documents, sources, tokened

# ---- event log -----------------------------------------------------------------------

# Which operation, stage event or queue event an event type stands for.
_OPERATION = {"click": "STATUS_POLL", "view": "SEARCH", "purchase": "IMAGE_SUBMISSION", "signup": "URL_SUBMISSION", "error": "VIDEO_SUBMISSION"}
_STATUS = {"click": "COMPLETED", "view": "SKIPPED", "purchase": "DEGRADED", "signup": "RUNNING", "error": "FAILED"}
_QUEUE = {"click": "reserve", "view": "complete", "purchase": "reserve", "signup": "complete", "error": "fail"}


def _mapped(column: str, names: dict):
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def _sql_mapped(names: dict) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


_SQL_K = "regexp_extract(props, '(\\d+)', 1)::INT"


def _usage(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"), _mapped("event_type", _OPERATION).alias("operation"),
        X.fingerprint((F.col("user_id") % 5).cast("string"), "change-me-in-production").alias("fingerprint"),
    )


def _stamp(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.date_format(n, "yyyy-MM-dd HH:mm:ss"))
    return df


def usage_windows(spark, sf):
    return _stamp(L.usage_windows(_usage(table(spark, sf, "events"))), "window_start")


def usage_windows_daily(spark, sf):
    return _stamp(L.usage_windows(_usage(table(spark, sf, "events")), "1 day"), "window_start")


def usage_windows_stream(spark, sf):
    """The hourly windows computed by a stream over the same file."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return _stamp(L.run_available(L.usage_windows(_usage(stream))), "window_start")


def fingerprint(spark, sf):
    return table(spark, sf, "events").select("event_id", X.fingerprint(F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")), "salt").alias("fingerprint"))


def _jobs(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id"), _k()).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type"
    )


def _redelivered(spark, sf) -> DataFrame:
    """Every delivery again after 5 and after 20 minutes."""
    jobs = _jobs(spark, sf)
    again = [
        jobs.withColumns({"ts": F.timestamp_seconds(F.unix_micros("ts") / 1e6 + s), "event_id": F.col("event_id") + n * 1_000_000_000})
        for n, s in ((1, 300), (2, 1200))
    ]
    return jobs.unionByName(again[0]).unionByName(again[1])


def job_dedup(spark, sf):
    return L.first_deliveries(_redelivered(spark, sf)).select("job_id", "event_id", "event_type")


def _streamed(rows: DataFrame, key: str, machine) -> DataFrame:
    """What a state machine emits for rows(ts, event_id, ...) that land in three parts whose times overlap, each of a
    file per core at most, and one row far in the future that lets the watermark pass all others."""
    spark, home = rows.sparkSession, run_folder(rows.sparkSession, "landed")
    rows = cut_lineage(rows)
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    files = spark.sparkContext.defaultParallelism
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).coalesce(files).write.mode("append").parquet(home)
    clock = rows.limit(1).withColumns({key: F.lit("clock"), "ts": F.lit(last).cast("timestamp") + F.expr("INTERVAL 90 DAYS")})
    clock.coalesce(1).write.mode("append").parquet(home)
    late = f"{int((last - first).total_seconds()) + 3600} seconds"  # a file may hold any time of all
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2 * files).parquet(home)
    return L.run_available(machine(stream, late=late), "append").drop("epoch").where(F.col(key) != "clock")


def job_dedup_stream(spark, sf):
    """First deliveries by the state machine, over a stream of the same deliveries."""
    return _streamed(_redelivered(spark, sf), "job_id", machines.deliveries).select("job_id", "event_id", "event_type")


def lease_expiries_stream(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id"), _k()).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        _mapped("event_type", _QUEUE).alias("event"), (_k() % 3 + 1).cast("int").alias("attempt"), F.lit(V.JOB_TTL_SECONDS).alias("lease_seconds"),
    )
    return _stamp(_streamed(log, "job_id", machines.lease_expiries), "reserved_at", "lease_expires_at")


def stage_state_stream(spark, sf):
    """The last change of each run."""
    log = _stage_log(spark, sf).join(_stage_runs(spark, sf), "verification_id").drop("user_id")

    def changes(stream, late):
        return machines.stage_changes(stream, late=late, idle_seconds=400 * 86_400)

    last = _streamed(log, "verification_id", changes).groupBy("verification_id").agg(
        F.max_by(F.struct("status", "degradation_reasons", "degraded"), "change").alias("s")
    )
    return last.select("verification_id", "s.*", (F.col("s.status") != "COMPLETED").alias("verdict_is_null"))


def _failures(spark, sf) -> DataFrame:
    e = table(spark, sf, "events").where(F.col("event_type") == "error")
    return e.select("event_id", F.col("user_id").alias("job_id"), (_k() % 4 + 1).alias("attempt"), (F.col("user_id") % 4 != 0).alias("retryable"))


def retry_routing(spark, sf):
    return L.route_failures(_failures(spark, sf))


def queue_depths(spark, sf):
    return L.queue_depths(L.route_failures(_failures(spark, sf)))


def expired_leases(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id"), _k()).alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
        _mapped("event_type", _QUEUE).alias("event"), (_k() % 3 + 1).alias("attempt"), F.lit(V.JOB_TTL_SECONDS).alias("lease_seconds"),
    )
    out = L.expired_leases(log, F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return _stamp(out, "reserved_at", "lease_expires_at")


def _stage_log(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id"), _k() % 3).alias("verification_id"),
        F.element_at(F.array(*[F.lit(s) for s in V.STAGE_SEQUENCE]), (F.col("event_id") % 12 + 1).cast("int")).alias("stage"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id", _mapped("event_type", _STATUS).alias("status"), "user_id",
    )


def _stage_runs(spark, sf) -> DataFrame:
    log = _stage_log(spark, sf)
    return log.groupBy("verification_id").agg((F.min("user_id") % 2 == 0).alias("has_media"))


def latest_stages(spark, sf):
    return P.latest_stages(_stage_log(spark, sf)).drop("ts")


def stage_state(spark, sf):
    return P.stage_state(_stage_runs(spark, sf), _stage_log(spark, sf))


def stage_progress(spark, sf):
    return P.stage_progress(_stage_runs(spark, sf), _stage_log(spark, sf))


def pending_stages(spark, sf):
    return P.pending_stages(_stage_runs(spark, sf), _stage_log(spark, sf))


def applicable_stages(spark, sf):
    return P.applicable_stages(_stage_runs(spark, sf))


def degradation_set(spark, sf):
    reasons = _stage_log(spark, sf).where(F.col("status") == "FAILED").select(
        "verification_id", F.col("event_id").alias("sequence"), F.concat(F.lower("stage"), F.lit("_failed")).alias("reason")
    )
    out = P.degradation_set(reasons)
    return out.withColumn("reasons", F.array_join("reasons", ","))


def stage_durations(spark, sf):
    e = table(spark, sf, "events")
    started = F.col("ts").cast("timestamp")
    rows = e.select(
        F.col("user_id").alias("verification_id"), F.col("event_id").alias("sequence"), started.alias("started_at"),
        F.when(F.col("event_type") != "signup", F.timestamp_micros(F.unix_micros(started) + _k().cast("long") * 1_000_000)).alias("finished_at"),
    )
    return P.stage_durations(rows).select("verification_id", "sequence", "duration_ms", "idle_ms")


def fresh_snapshot(spark, sf):
    fetches = table(spark, sf, "events").select(F.col("user_id").alias("feed"), F.col("ts").cast("timestamp").alias("fetched_at"), "event_id")
    out = K.fresh_snapshots(fetches, F.lit("2024-01-30 23:00:00").cast("timestamp"))
    return _stamp(out, "fetched_at")


def existing_jobs(spark, sf):
    jobs = table(spark, sf, "events").select("event_id", F.col("user_id").alias("verification_id"))
    return P.existing_jobs(jobs, table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("verification_id")))


# ---- listings ------------------------------------------------------------------------

_BY_STATUS = {"O": "RUNNING", "F": "COMPLETED", "P": "FAILED"}


def _verifications(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    verdict = F.element_at(F.array(*[F.lit(v) for v in V.VERDICTS]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("verification_id"), F.col("o_custkey").alias("submission_id"),
        _mapped("o_orderstatus", _BY_STATUS).alias("status"), F.when(F.col("o_orderstatus") == "F", verdict).alias("overall_verdict"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def _listed(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("submission_id"), F.lit("TEXT").alias("content_type"), F.col("c_mktsegment").alias("title"),
        F.when(F.col("c_custkey") % 3 == 0, F.repeat("c_name", 30)).alias("text"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_name")).alias("caption"),
        F.lit("https://x.example.org/").alias("url"),
    )


def recent(spark, sf):
    return _stamp(P.recent(_verifications(spark, sf), _listed(spark, sf), 20), "created_at")


def recent_filtered(spark, sf):
    return _stamp(P.recent(_verifications(spark, sf), _listed(spark, sf), 50, verdict="FALSE", status="COMPLETED"), "created_at")


def verification_total(spark, sf):
    return _verifications(spark, sf).agg(F.count("verification_id").alias("total"))


def keyset_page(spark, sf):
    import datetime

    return _stamp(P.keyset_page(_verifications(spark, sf), (datetime.datetime(1998, 1, 1), 5000), 20), "created_at")


def revision_numbers(spark, sf):
    v = _verifications(spark, sf)
    outcomes = v.where(F.col("status") == "COMPLETED").select(
        F.col("submission_id").alias("verification_id"), F.col("verification_id").alias("outcome_id"), F.col("created_at").alias("completed_at"), F.col("overall_verdict").alias("verdict")
    )
    return P.revision_numbers(outcomes).drop("completed_at")




def verdict_changes(spark, sf):
    return revision_numbers(spark, sf).where("changed")


def label_distribution(spark, sf):
    return P.label_distribution(W.evidence(spark, sf), ["source_type"])


def report_counters(spark, sf):
    scores = W._scores(spark, sf)
    return P.report_counters(scores, W.evidence(spark, sf))


def evidence_listing(spark, sf):
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("document_title"))
    return P.evidence_listing(W.evidence(spark, sf), W.claims(spark, sf), docs, "CONTRADICTS").select(
        "verification_id", "claim_id", "evidence_id", "relationship", "document_title", "position", F.round("relevance", 6).alias("relevance")
    )


def unresolved_claims(spark, sf):
    s = W._scores(spark, sf)
    return s.where(P.unresolved(F.col("verdict"))).select("claim_id", P.shown_verdict(F.col("verdict")).alias("verdict"))


def top_publishers(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"))
    ev = W._verified_evidence(spark, sf).join(names, "source_id", "left")
    return P.top_publishers(ev).withColumn("publishers", F.array_join("publishers", ","))


def public_id_check(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id") % 5
    value = F.when(k == 0, F.concat(F.lit("vfy_"), F.lpad(F.col("event_id").cast("string"), 16, "7"))).when(k == 1, F.concat(F.lit("sub_"), F.lpad(F.col("event_id").cast("string"), 8, "Q"))).when(
        k == 2, F.concat(F.lit("v_"), F.lpad(F.col("event_id").cast("string"), 16, "7"))).when(k == 3, F.concat(F.lit("vfy_"), F.lpad(F.col("event_id").cast("string"), 16, "O"))).otherwise(F.concat(F.lit("vfy"), F.col("event_id").cast("string")))
    rows = e.select("event_id", value.alias("value"))
    return rows.select("event_id", X.is_public_id(F.col("value")).alias("valid"), X.is_public_id(F.col("value"), "vfy").alias("valid_vfy"))


# ---- audits --------------------------------------------------------------------------

_URLS = [
    "{u}", "ftp://{h}/x", "http://user:pw@{h}/", "http://127.0.0.1/{p}", "http://2130706433/", "http://0x7f000001/", "http://0177.0.0.1/",
    "http://10.1.2/", "http://{h}:8080/", "http://{h}:99999/", "http://localhost/", "http://svc{p}.internal/", "http://intranet/", "http://exa mple.org/",
    "http://8.8.8.8/{p}", "https://169.254.169.254/latest", "http://{h}%00.evil.example/", "not a url", "", "http:///nohost", "http://{h}./", "http://192.168.0.{p}/",
    "http://[::1]/", "http://[2606:4700:4700::1111]/", "http://back\\\\slash.example/", "http://100.64.0.1/", "http://1.2.3.4.5/", "https://{h}:443/ok", "http://224.0.0.1/",
]


def _audited(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    form = F.element_at(F.array(*[F.lit(u.replace("\\\\", "\\")) for u in _URLS]), (F.col("page_id") % len(_URLS) + 1).cast("int"))
    url = F.replace(F.replace(F.replace(form, F.lit("{u}"), F.col("url")), F.lit("{h}"), U.host(F.col("url"))), F.lit("{p}"), (F.col("page_id") % 250).cast("string"))
    return U.url_audit(p.select("page_id", url.alias("url")))


def url_audit(spark, sf):
    return _audited(spark, sf).select("page_id", "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("host")).alias("host"), F.when(F.col("reject_reason").isNull(), F.col("port")).alias("port"))


def url_audit_summary(spark, sf):
    return _audited(spark, sf).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


_HEADS = ["FFD8FFE000104A464946000101", "89504E470D0A1A0A0000000D49", "474946383961000000000000", "524946460000000057454250", "524946460000000057415645", "00000018667479706D703432", "1A45DFA3000000000000000000", "000000146674797071742020", "DEADBEEFDEADBEEFDEADBEEF"]
_DECLARED = ["image/jpeg", "image/png; charset=x", "", "application/octet-stream"]


def _files(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages")
    n = F.col("page_id")
    head = F.unhex(F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (n % len(_HEADS) + 1).cast("int")))
    tail = F.when(n % 2 == 0, F.encode(F.col("html"), "UTF-8")).when(n % 7 == 0, F.encode(F.lit("..JUMB..c2pa.."), "UTF-8")).otherwise(F.encode(F.col("url"), "UTF-8"))
    return p.select(
        n.alias("media_id"), F.concat(head, tail).alias("content"),
        F.element_at(F.array(*[F.lit(d) for d in _DECLARED]), (n % 4 + 1).cast("int")).alias("declared_type"),
        F.when(n % len(_HEADS) >= 5, "VIDEO").otherwise("IMAGE").alias("kind"),
    )


def media_signature(spark, sf):
    return M.media_signature(_files(spark, sf))


_META = ["Made with Stable Diffusion XL", "plain", "DALL-E 3 by OpenAI", "midjourney v6", None]


def media_signals(spark, sf):
    n = F.col("page_id")
    meta = table(spark, sf, "pages").select(
        n.alias("media_id"), F.element_at(F.array(*[F.lit(m) for m in _META]), (n % 5 + 1).cast("int")).alias("metadata_text"),
        F.when(n % 3 == 0, "Canon ").alias("make"), F.when(n % 3 == 0, " EOS 5D").alias("model"), (n % 3 == 0).alias("has_exif"),
        F.when(n % 4 == 0, "Adobe Photoshop 25").when(n % 4 == 1, "scanner").alias("software"),
        F.when(n % 7 == 0, F.concat(F.lit("2023:0"), (n % 9 + 1).cast("string"), F.lit(":15 10:20:30"))).when(n % 7 == 1, "not a date").alias("captured_raw"),
    )
    out = M.media_signals(_files(spark, sf), meta)
    return out.select(
        "media_id", "generator", "has_c2pa", "assessment", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured_at"),
        F.array_join(F.transform("signals", lambda s: F.concat(s["key"], F.lit("="), s["finding"])), "; ").alias("findings"),
        F.array_join(F.transform("signals", lambda s: s["strength"]), ",").alias("strengths"),
    )


# ---- declared capabilities -----------------------------------------------------------


def _texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _items(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def keyword_leg(spark, sf):
    return D.keyword_leg(_items(spark, sf), _texts(spark, sf)).withColumn("score", F.round("score", 4))


def _centroids(spark, sf) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    e = table(spark, sf, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy("label", "i").agg((F.sum(F.col("x").cast("decimal(20,12)")) / F.count(F.lit(1))).cast("double").alias("m"))
    vectors = mean.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("v"))
    return vectors.select(F.col("label").alias("query_id"), F.transform("v", lambda s: s["m"]).alias("embedding"))


def vector_topk(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    return D.vector_topk(_centroids(spark, sf), vectors).withColumn("similarity", F.round("similarity", 6))


def rrf_merge(spark, sf):
    """Keyword leg with vector leg: an item's vector is the one of its number, a document's likewise."""
    words = D.keyword_leg(_items(spark, sf), _texts(spark, sf)).select("query_id", "doc_id", "rank")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = _items(spark, sf).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    near = D.vector_topk(asked, vectors).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return D.rrf_merge([words, near]).withColumn("rrf_score", F.round("rrf_score", 8))


def simhash_neardup(spark, sf):
    docs = _texts(spark, sf).select("doc_id", D.plain_tokens(F.col("text")).alias("tokens"))
    hashed = docs.select("doc_id", D.simhash(F.col("tokens")).alias("h"))
    return D.near_hashes(hashed, "doc_id", "h")


def phash_near(spark, sf):
    """Perceptual hashes as supplied with media: one per host, a bit flipped per page."""
    base = F.conv(F.substring(F.md5(U.host(F.col("url"))), 1, 15), 16, 10).cast("long")
    rows = table(spark, sf, "pages").select("page_id", base.bitwiseXOR(F.pow(F.lit(2.0), F.col("page_id") % 3).cast("long")).alias("h"))
    return D.near_hashes(rows, "page_id", "h", 2)


def trigram_titles(spark, sf):
    first = F.regexp_extract("text", "^[^.!?\n]*", 0)
    left = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), first.alias("title"))
    right = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), first.alias("title"))
    return D.similar_titles(left, right).withColumn("similarity", F.round("similarity", 6))


def stale_media(spark, sf):
    media = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("media_id"), F.col("l_shipdate").alias("captured_at"))
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderdate").alias("event_at"))
    out = D.stale_media(media, claims)
    return out.select("claim_id", "media_id", "predates_claimed_event", "penalty_type", F.round(D.temporal_factor(F.col("captured_at"), F.col("event_at")), 6).alias("temporal_factor"))


def penalty_producer(spark, sf):
    claimed = table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_totalprice").alias("value"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(F.sum(F.col("l_extendedprice").cast("decimal(20,4)")).cast("double").alias("value"))
    out = None
    for kind in ("count", "money", "measure", "magnitude"):
        rows = D.numeric_penalties(claimed, lines, kind).select("claim_id", F.lit(kind).alias("kind"), F.round("true_value", 4).alias("true_value"), "penalty_type")
        out = rows if out is None else out.unionByName(rows)
    return out


def _claimed_days(spark, sf) -> DataFrame:
    """An order as a claim about an event: from its date for as many days as its key says."""
    days = (F.col("o_orderkey") % 120).cast("int")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_orderdate").cast("date").alias("first_day"), F.date_add(F.col("o_orderdate").cast("date"), days).alias("last_day")
    )


def _established_days(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_shipdate").cast("date").alias("first_day"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int")).alias("last_day")
    )


def date_penalties(spark, sf):
    return dates.date_penalties(_claimed_days(spark, sf), _established_days(spark, sf))


def window_overlaps(spark, sf):
    """Claimed windows of all orders with the days on which each nation's customers ordered at first and at last, shifted
    by nation: few windows of years meet many of days."""
    wide = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.date_add(F.min("o_orderdate").cast("date"), F.col("nation") * 40).alias("first_day"), F.date_sub(F.max("o_orderdate").cast("date"), F.col("nation") * 50).alias("last_day")
    )
    found = dates.overlapping(wide, _claimed_days(spark, sf), "nation", "claim_id")
    return found.groupBy("nation").agg(F.count(F.lit(1)).alias("claims"), F.sum("days").alias("days"))


def date_penalty_values(spark, sf):
    """Claims by the penalty that scoring takes for their dates."""
    penalties = date_penalties(spark, sf)
    return SC.max_penalties(penalties).groupBy(F.round("applied_penalty", 6).alias("applied_penalty")).agg(F.count(F.lit(1)).alias("claims"))


def sources_checked(spark, sf):
    from claimloom.operators import retrieve as R

    c = benchmark_claims(spark, sf)
    found = R.relevance(c, tokened(spark, sf), min_score=V.CANDIDATE_MIN_SCORE)
    named = found.join(c.select("claim_id", F.col("submission_id").alias("verification_id")), "claim_id").join(documents(spark, sf).select("doc_id", "source"), "doc_id")
    dom = sources(spark, sf).select("source", "domain")
    return P.sources_checked(named.join(dom, "source")).withColumn("best_score", F.round("best_score", 6))


def calibration_matrix(spark, sf):
    v = table(spark, sf, "documents").select("doc_id", F.element_at(F.array(*[F.lit(x) for x in V.VERDICTS]), (F.col("n_chars") % 9 + 1).cast("int")).alias("verdict"))
    return P.calibration(v, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))).withColumn("accuracy", F.round("accuracy", 6))


def token_search(spark, sf):
    return D.search(_texts(spark, sf), ["THE", "and"]).select("doc_id")


QUERIES = {f.__name__: f for f in (
    usage_windows, usage_windows_daily, usage_windows_stream, fingerprint, job_dedup, retry_routing, queue_depths,
    expired_leases, latest_stages, stage_state, stage_progress, pending_stages, applicable_stages, degradation_set,
    stage_durations, fresh_snapshot, existing_jobs, recent, recent_filtered, verification_total, keyset_page,
    revision_numbers, verdict_changes, label_distribution, report_counters, evidence_listing, unresolved_claims,
    top_publishers, public_id_check, url_audit, url_audit_summary, media_signature, media_signals, keyword_leg,
    vector_topk, rrf_merge, simhash_neardup, phash_near, trigram_titles, stale_media, penalty_producer,
    sources_checked, calibration_matrix, token_search, job_dedup_stream, lease_expiries_stream, stage_state_stream,
    date_penalties, window_overlaps, date_penalty_values,
)}

_FP = "substr(sha256('{salt}:'||{who}), 1, 32)"
_LIMITS = "CASE operation " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in V.OPERATION_LIMITS.items()) + " END"


def _sql_usage(step: str) -> str:
    return f"""WITH u AS (SELECT time_bucket(INTERVAL {step}, ts) AS w, {_sql_mapped(_OPERATION)} AS operation,
        {_FP.format(salt='change-me-in-production', who='(user_id % 5)')} AS fingerprint FROM events),
      c AS (SELECT w, operation, fingerprint, count(*) AS requests, {_LIMITS} AS usage_limit FROM u GROUP BY ALL)
      SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, operation, fingerprint, requests, usage_limit, requests <= usage_limit AS allowed,
        greatest(0, usage_limit - requests) AS remaining FROM c"""


_STAGES = f"""slog AS (SELECT user_id||'-'||({_SQL_K} % 3) AS verification_id, ([{quoted(V.STAGE_SEQUENCE)}])[event_id % 12 + 1] AS stage, ts, event_id,
  {_sql_mapped(_STATUS)} AS status, user_id FROM events),
lat AS (SELECT verification_id, stage, status FROM slog QUALIFY row_number() OVER (PARTITION BY verification_id, stage ORDER BY ts DESC, event_id DESC) = 1),
sruns AS (SELECT verification_id, min(user_id) % 2 = 0 AS has_media FROM slog GROUP BY 1),
seq AS (SELECT unnest([{quoted(V.STAGE_SEQUENCE)}]) AS stage, unnest(range(12)) AS pos, unnest([{quoted(V.STAGE_LABELS[s] for s in V.STAGE_SEQUENCE)}]) AS label),
app AS (SELECT verification_id, row_number() OVER (PARTITION BY verification_id ORDER BY pos) AS sequence, stage, label FROM sruns, seq WHERE stage <> 'ANALYZING_MEDIA' OR has_media)"""
_FATAL = quoted(V.FATAL_STAGES)
_VER = f"""ver AS (SELECT o_orderkey AS verification_id, o_custkey AS submission_id, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' END AS status,
  CASE WHEN o_orderstatus = 'F' THEN ([{quoted(V.VERDICTS)}])[o_orderkey % 9 + 1] END AS overall_verdict, o_orderdate AS created_at FROM orders),
subs AS (SELECT c_custkey AS submission_id, 'TEXT' AS content_type, c_mktsegment AS title,
  substr(CASE c_custkey % 3 WHEN 0 THEN repeat(c_name, 30) WHEN 1 THEN c_name ELSE 'https://x.example.org/' END, 1, 280) AS excerpt FROM customer)"""
_REV = _VER + """, rev AS (SELECT submission_id AS verification_id, verification_id AS outcome_id, overall_verdict AS verdict,
  row_number() OVER w AS revision_number, lag(overall_verdict) OVER w AS previous_verdict,
  coalesce(lag(overall_verdict) OVER w <> overall_verdict, FALSE) AS changed FROM ver WHERE status = 'COMPLETED' WINDOW w AS (PARTITION BY submission_id ORDER BY created_at, verification_id))"""
_SQL_RECENT = "SELECT submission_id, content_type, title, excerpt, verification_id, status, overall_verdict, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT * FROM ver {where} ORDER BY created_at DESC, verification_id DESC LIMIT {n}) JOIN subs USING (submission_id)"

_H = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\\.', '')"
# What each form of URL above must be judged as.
_EXPECTED = [
    None, "bad_scheme", "credentials_in_url", "blocked_ip_literal", "blocked_ip_literal", "blocked_ip_literal", "blocked_ip_literal",
    "blocked_ip_literal", "blocked_port", "bad_port", "blocked_hostname", "blocked_hostname_suffix", "bare_hostname", "invalid_hostname_chars",
    None, "blocked_ip_literal", "invalid_hostname_chars", "bad_scheme", "empty_url", "no_host", None, "blocked_ip_literal",
    "blocked_ip_literal", None, "backslash", "blocked_ip_literal", None, None, "blocked_ip_literal",
]
_EXP_SQL = "[" + ", ".join("NULL" if e is None else f"'{e}'" for e in _EXPECTED) + "]"
_N_URLS = len(_URLS)
_HOSTS_SQL = f"CASE page_id % {_N_URLS} WHEN 14 THEN '8.8.8.8' WHEN 23 THEN '2606:4700:4700::1111' WHEN 26 THEN '1.2.3.4.5' WHEN 0 THEN lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) ELSE {_H} END"
_AUDIT = f"""aud AS (SELECT page_id, ({_EXP_SQL})[page_id % {_N_URLS} + 1] AS reject_reason, {_HOSTS_SQL} AS h,
   CASE WHEN page_id % {_N_URLS} = 27 OR (page_id % {_N_URLS} = 0 AND starts_with(url, 'https')) THEN 443 ELSE 80 END AS p FROM pages)"""
_FILES_SQL = f"""files AS (SELECT page_id AS media_id, ([{quoted(_HEADS)}])[page_id % {len(_HEADS)} + 1]||CASE WHEN page_id % 2 = 0 THEN hex(encode(html)) WHEN page_id % 7 = 0 THEN hex(encode('..JUMB..c2pa..')) ELSE hex(encode(url)) END AS x,
  ([{quoted(_DECLARED)}])[page_id % 4 + 1] AS declared_type, CASE WHEN page_id % {len(_HEADS)} >= 5 THEN 'VIDEO' ELSE 'IMAGE' END AS kind, page_id % {len(_HEADS)} AS t FROM pages)"""
_MARK_SQL = " OR ".join(f"contains(substr(x, 1, 4096), hex(encode('{m}')))" for m in V.MARKUP_MARKERS + ("<!DOCTYPE html",))
_TOK = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_\\x{{0980}}-\\x{{09ff}}]+')"


def _sql_keyword(name: str, items: str) -> str:
    return f"""{name}_q AS (SELECT query_id, unnest(list_distinct({_TOK.format(t='text')})) AS term FROM {items}),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, sum(floor(tf * idf * 1e6 + 0.5)::BIGINT)::DOUBLE / 1e6 AS score FROM {name}_q JOIN tf USING (term) JOIN idf USING (term) GROUP BY ALL) QUALIFY rank <= 10)"""


_TF = f"""tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(t='text')}) AS term FROM documents) GROUP BY ALL),
idf AS (SELECT term, ln((SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM tf GROUP BY term),
items AS (SELECT item_id AS query_id, text FROM benchmark)"""
_TITLE = "regexp_extract(text, '^[^.!?\\n]*')"
_WORDS = f"list_filter(string_split(regexp_replace(lower({_TITLE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_GRAMS = f"list_distinct(flatten(list_transform({_WORDS}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  '||w||' ', i, 3)))))"


ORACLES = {
    "usage_windows": _sql_usage("1 HOUR"),
    "usage_windows_daily": _sql_usage("1 DAY"),
    "usage_windows_stream": _sql_usage("1 HOUR"),
    "fingerprint": f"SELECT event_id, {_FP.format(salt='salt', who='''CASE WHEN user_id % 3 <> 0 THEN user_id::VARCHAR ELSE 'unknown' END''')} AS fingerprint FROM events",
    "job_dedup": f"""WITH RECURSIVE e AS (SELECT user_id||'-'||{_SQL_K} AS job_id, ts, event_id, event_type FROM events),
      j AS (SELECT * FROM e UNION ALL SELECT job_id, ts + INTERVAL 300 SECOND, event_id + 1000000000, event_type FROM e UNION ALL SELECT job_id, ts + INTERVAL 1200 SECOND, event_id + 2000000000, event_type FROM e),
      held AS (SELECT job_id, arg_min({{'ts': ts, 'event_id': event_id, 'event_type': event_type}}, (ts, event_id)) AS d FROM j GROUP BY 1
        UNION ALL SELECT j.job_id, arg_min({{'ts': ts, 'event_id': event_id, 'event_type': event_type}}, (ts, event_id)) FROM held JOIN j ON j.job_id = held.job_id AND j.ts > held.d.ts + INTERVAL 900 SECOND GROUP BY j.job_id)
      SELECT job_id, d.event_id, d.event_type FROM held""",
    "retry_routing": f"""WITH f AS (SELECT event_id, user_id AS job_id, {_SQL_K} % 4 + 1 AS attempt, user_id % 4 <> 0 AS retryable FROM events WHERE event_type = 'error')
      SELECT *, CASE WHEN NOT retryable OR attempt >= 3 THEN 'dead_letter' ELSE 'retry' END AS route, CASE WHEN retryable AND attempt < 3 THEN attempt + 1 END AS next_attempt FROM f""",
    "queue_depths": f"SELECT CASE WHEN user_id % 4 = 0 OR {_SQL_K} % 4 + 1 >= 3 THEN 'dead_letter' ELSE 'retry' END AS route, count(*) AS depth FROM events WHERE event_type = 'error' GROUP BY 1",
    "expired_leases": f"""WITH l AS (SELECT user_id||'-'||{_SQL_K} AS job_id, ts, {_sql_mapped(_QUEUE)} AS ev, {_SQL_K} % 3 + 1 AS attempt FROM events),
      j AS (SELECT job_id, max(ts) FILTER (ev = 'reserve') AS r, arg_max(attempt, ts) FILTER (ev = 'reserve') AS a, max(ts) FILTER (ev <> 'reserve') AS e FROM l GROUP BY 1)
      SELECT job_id, strftime(r, '%Y-%m-%d %H:%M:%S') AS reserved_at, strftime(r + INTERVAL 900 SECOND, '%Y-%m-%d %H:%M:%S') AS lease_expires_at, a + 1 AS next_attempt
      FROM j WHERE r IS NOT NULL AND (e IS NULL OR e < r) AND r + INTERVAL 900 SECOND < TIMESTAMP '2024-01-20 00:00:00'""",
    "latest_stages": f"WITH {_STAGES} SELECT * FROM lat",
    "stage_state": f"""WITH {_STAGES}, r AS (SELECT a.verification_id, a.stage, coalesce(l.status, '') AS status FROM app a LEFT JOIN lat l ON l.verification_id = a.verification_id AND l.stage = a.stage),
      g AS (SELECT verification_id, CASE WHEN count(*) FILTER (status = 'FAILED' AND stage IN ({_FATAL})) > 0 THEN 'FAILED' WHEN count(*) FILTER (status IN ('', 'RUNNING')) = 0 THEN 'COMPLETED' WHEN count(*) FILTER (status <> '') > 0 THEN 'RUNNING' ELSE 'QUEUED' END AS status,
        coalesce(array_to_string(list_sort(list(lower(stage)||'_failed') FILTER (status = 'FAILED' AND stage NOT IN ({_FATAL}))), ','), '') AS degradation_reasons,
        bool_or(status = 'FAILED' AND stage NOT IN ({_FATAL})) AS degraded FROM r GROUP BY 1)
      SELECT *, status <> 'COMPLETED' AS verdict_is_null FROM g""",
    "stage_progress": f"WITH {_STAGES} SELECT verification_id, 11 + has_media::INT AS stage_count, (SELECT count(*) FROM lat l WHERE l.verification_id = r.verification_id AND status IN ('COMPLETED', 'SKIPPED', 'DEGRADED')) AS stage_index FROM sruns r",
    "pending_stages": f"WITH {_STAGES} SELECT * FROM app a WHERE NOT EXISTS (SELECT 1 FROM lat l WHERE l.verification_id = a.verification_id AND l.stage = a.stage AND status IN ('COMPLETED', 'SKIPPED', 'DEGRADED'))",
    "applicable_stages": f"WITH {_STAGES} SELECT * FROM app",
    "degradation_set": f"""WITH {_STAGES}, f AS (SELECT verification_id, lower(stage)||'_failed' AS reason, min(event_id) AS s FROM slog WHERE status = 'FAILED' GROUP BY ALL)
      SELECT verification_id, string_agg(reason, ',' ORDER BY s, reason) AS reasons, TRUE AS degraded FROM f GROUP BY 1""",
    "stage_durations": f"""WITH r AS (SELECT user_id AS verification_id, event_id AS sequence, ts AS s, CASE WHEN event_type <> 'signup' THEN ts + INTERVAL 1 SECOND * {_SQL_K} END AS f FROM events)
      SELECT verification_id, sequence, trunc((epoch_us(f) - epoch_us(s)) / 1000.0)::BIGINT AS duration_ms,
        trunc((epoch_us(s) - epoch_us(lag(f) OVER (PARTITION BY verification_id ORDER BY sequence))) / 1000.0)::BIGINT AS idle_ms FROM r""",
    "fresh_snapshot": """WITH l AS (SELECT user_id AS feed, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
      SELECT feed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fetched_at, event_id, epoch(TIMESTAMP '2024-01-30 23:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS age_seconds,
        epoch(TIMESTAMP '2024-01-30 23:00:00')::BIGINT - floor(epoch(ts))::BIGINT < 600 AS is_fresh FROM l""",
    "existing_jobs": "SELECT event_id, user_id AS verification_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    "recent": f"WITH {_VER} " + _SQL_RECENT.format(where="", n=20),
    "recent_filtered": f"WITH {_VER} " + _SQL_RECENT.format(where="WHERE overall_verdict = 'FALSE' AND status = 'COMPLETED'", n=50),
    "verification_total": "SELECT count(o_orderkey) AS total FROM orders",
    "keyset_page": f"WITH {_VER} SELECT verification_id, submission_id, status, overall_verdict, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM ver WHERE created_at < TIMESTAMP '1998-01-01' OR (created_at = TIMESTAMP '1998-01-01' AND verification_id < 5000) ORDER BY ver.created_at DESC, verification_id DESC LIMIT 20",
    "revision_numbers": f"WITH {_REV} SELECT * FROM rev",
    "verdict_changes": f"WITH {_REV} SELECT * FROM rev WHERE changed",
    "label_distribution": W._W + "SELECT source_type, relationship, count(*) AS n FROM ev GROUP BY ALL",
    "report_counters": W._W + """, pc AS (SELECT claim_id, count(*) AS n, count(*) FILTER (relationship = 'SUPPORTS') AS sup, count(*) FILTER (relationship = 'CONTRADICTS') AS con,
        count(DISTINCT cluster_id) + count(DISTINCT CASE WHEN cluster_id IS NULL THEN document_id END) AS o FROM ev GROUP BY 1)
      SELECT verification_id, count(*) AS claims, coalesce(sum(pc.n), 0)::BIGINT AS total_evidence, coalesce(sum(sup), 0)::BIGINT AS supporting_evidence, coalesce(sum(con), 0)::BIGINT AS contradicting_evidence,
        coalesce(sum(o), 0)::BIGINT AS independent_origins, count(*) FILTER (verdict = 'UNVERIFIED') AS unresolved_claims FROM claim_scores LEFT JOIN pc USING (claim_id) GROUP BY 1""",
    "evidence_listing": W._W + "SELECT verification_id, claim_id, evidence_id, relationship, p_name AS document_title, row_number() OVER (PARTITION BY claim_id ORDER BY relevance DESC, evidence_id) AS position, round(relevance, 6) AS relevance FROM ev JOIN claims USING (claim_id) LEFT JOIN part ON p_partkey = document_id WHERE relationship = 'CONTRADICTS'",
    "unresolved_claims": W._W + "SELECT claim_id, verdict FROM claim_scores WHERE verdict = 'UNVERIFIED'",
    "top_publishers": W._W + """SELECT verification_id, array_to_string(list_sort(list_distinct(list(s_name)))[1:6], ',') AS publishers
      FROM ev JOIN claims USING (claim_id) JOIN supplier ON s_suppkey = source_id GROUP BY 1""",
    "public_id_check": """SELECT event_id, k = 0 OR k = 1 AS valid, k = 0 AS valid_vfy FROM (SELECT event_id, event_id % 5 AS k FROM events)""",
    "url_audit": f"WITH {_AUDIT} SELECT page_id, reject_reason, CASE WHEN reject_reason IS NULL THEN h END AS host, CASE WHEN reject_reason IS NULL THEN p END AS port FROM aud",
    "url_audit_summary": f"WITH {_AUDIT} SELECT coalesce(reject_reason, 'accepted') AS outcome, count(*) AS n FROM aud GROUP BY 1",
    "media_signature": f"""WITH {_FILES_SQL}, d AS (SELECT *, ['image/jpeg', 'image/png', 'image/gif', 'image/webp', NULL, 'video/mp4', 'video/webm', 'video/quicktime', NULL][t + 1] AS detected_type FROM files)
      SELECT media_id, kind, declared_type, detected_type, length(x) // 2 AS byte_size, sha256(unhex(x)) AS sha256,
        CASE WHEN detected_type IS NULL THEN 'unsupported_type'
          WHEN kind = 'IMAGE' AND declared_type <> '' AND trim(split_part(declared_type, ';', 1)) NOT IN (detected_type, 'application/octet-stream') THEN 'type_mismatch'
          WHEN {_MARK_SQL} THEN 'polyglot' END AS refusal FROM d""",
    "media_signals": f"""WITH {_FILES_SQL}, m AS (SELECT page_id AS media_id, ['Stable Diffusion', NULL, 'DALL-E', 'Midjourney', NULL][page_id % 5 + 1] AS generator, page_id % 3 = 0 AS cam,
        CASE page_id % 4 WHEN 0 THEN 'Adobe Photoshop 25' WHEN 1 THEN 'scanner' END AS software, CASE WHEN page_id % 7 = 0 THEN ('2023-0'||(page_id % 9 + 1)||'-15 10:20:30')::TIMESTAMP END AS cap FROM pages),
      f AS (SELECT media_id, media_id % 2 = 1 AND media_id % 7 = 0 AS has_c2pa, generator, coalesce(cam, FALSE) AS cam, software, cap FROM files LEFT JOIN m USING (media_id))
      SELECT media_id, generator, has_c2pa, CASE WHEN generator IS NOT NULL THEN 'declared_generator' WHEN has_c2pa THEN 'provenance_present' ELSE 'undetermined' END AS assessment,
        strftime(cap, '%Y-%m-%d %H:%M:%S') AS captured_at,
        concat_ws('; ', 'generator_metadata=The file''s metadata names '||generator||'.', CASE WHEN has_c2pa THEN 'c2pa_present=The file carries a Content Credentials (C2PA) provenance manifest.' END,
          CASE WHEN cam THEN 'camera_metadata=The file carries camera metadata (Canon EOS 5D).' ELSE 'no_metadata=The file carries no EXIF metadata.' END,
          CASE WHEN software LIKE '%Photoshop%' THEN 'editing_software=The file was saved by '||software||'.' END, 'capture_date=Metadata records a capture date of '||strftime(cap, '%d %b %Y')||'.') AS findings,
        concat_ws(',', CASE WHEN generator IS NOT NULL THEN 'strong' END, CASE WHEN has_c2pa THEN 'moderate' END, CASE WHEN cam THEN 'moderate' ELSE 'weak' END,
          CASE WHEN software LIKE '%Photoshop%' THEN 'weak' END, CASE WHEN cap IS NOT NULL THEN 'moderate' END) AS strengths FROM f""",
    "keyword_leg": f"WITH {_TF}, {_sql_keyword('kw', 'items')} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM kw",
    "rrf_merge": f"""WITH {_TF}, {_sql_keyword('kw', 'items')},
      v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      kv AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
        SELECT item_id AS query_id, v.vec_id, round(list_cosine_similarity(v.v, q.v), 9) AS similarity FROM benchmark JOIN v q ON q.vec_id = item_id, v) QUALIFY rank <= 10)
      SELECT query_id, doc_id, round(sum((1.0::DOUBLE / (60 + rank))::DECIMAL(20,12))::DOUBLE, 8) AS rrf_score FROM (SELECT query_id, doc_id, rank FROM kw UNION ALL SELECT query_id, doc_id, rank FROM kv) GROUP BY ALL""",
    "vector_topk": f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
      x AS (SELECT label, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e),
      c AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM (SELECT label, i, sum(x::DECIMAL(20,12))::DOUBLE / count(*) AS m FROM x GROUP BY ALL) GROUP BY 1),
      s AS (SELECT query_id, vec_id, round(list_cosine_similarity(v, q), 9) AS similarity FROM e, c),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
      SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10""",
    "simhash_neardup": f"""WITH t AS (SELECT doc_id, unnest({_TOK.format(t='text')}) AS w FROM documents), n AS (SELECT doc_id, ('0x'||substr(md5(w), 1, 15))::BIGINT AS h FROM t),
      b AS (SELECT doc_id, count(*) AS c, {", ".join(f"count(*) FILTER ((h >> {i}) & 1 = 1) AS b{i}" for i in range(60))} FROM n GROUP BY 1),
      d AS (SELECT doc_id, {" + ".join(f"(CASE WHEN 2 * b{i} > c THEN 1::BIGINT << {i} ELSE 0 END)" for i in range(60))} AS h FROM b
            UNION ALL SELECT doc_id, 0 FROM documents WHERE len({_TOK.format(t='text')}) = 0),
      v AS (SELECT h, min(doc_id) AS rep, count(*) AS copies FROM d GROUP BY 1)
      SELECT a.rep AS rep_a, z.rep AS rep_b, a.copies AS copies_a, z.copies AS copies_b, bit_count(xor(a.h, z.h))::INT AS distance FROM v a JOIN v z ON a.h < z.h AND bit_count(xor(a.h, z.h)) <= 3""",
    "phash_near": f"""WITH d AS (SELECT page_id, xor(('0x'||substr(md5({_H}), 1, 15))::BIGINT, 1::BIGINT << (page_id % 3)::INT) AS h FROM pages), v AS (SELECT h, min(page_id) AS rep, count(*) AS copies FROM d GROUP BY 1)
      SELECT a.rep AS rep_a, z.rep AS rep_b, a.copies AS copies_a, z.copies AS copies_b, bit_count(xor(a.h, z.h))::INT AS distance FROM v a JOIN v z ON a.h < z.h AND bit_count(xor(a.h, z.h)) <= 2""",
    "trigram_titles": f"""WITH a AS (SELECT item_id AS left_id, {_GRAMS} AS ga FROM benchmark), b AS (SELECT doc_id AS right_id, {_GRAMS} AS gb FROM documents),
      s AS (SELECT left_id, right_id, len(list_intersect(ga, gb)) AS i, len(ga) AS na, len(gb) AS nb FROM a, b)
      SELECT left_id, right_id, round(i::DOUBLE / (na + nb - i), 6) AS similarity FROM s WHERE i > 0 AND i::DOUBLE / (na + nb - i) >= 0.5""",
    "stale_media": """WITH j AS (SELECT l_orderkey AS claim_id, l_partkey||'-'||l_suppkey||'-'||l_linenumber AS media_id, l_shipdate AS c, o_orderdate AS e, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
      SELECT claim_id, media_id, c < e - INTERVAL 1 DAY AS predates_claimed_event, CASE WHEN c < e - INTERVAL 1 DAY THEN 'STALE_MEDIA' END AS penalty_type,
        round(CASE WHEN d < 0 THEN 0.4::DOUBLE WHEN d <= 7 THEN 1.0::DOUBLE ELSE greatest(0.4::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * ceil((d - 7) / 30.0::DOUBLE)) END, 6) AS temporal_factor FROM j""",
    "penalty_producer": """WITH t AS (SELECT l_orderkey AS claim_id, sum(l_extendedprice::DECIMAL(20,4))::DOUBLE AS v FROM lineitem GROUP BY 1)
      SELECT claim_id, kind, round(v, 4) AS true_value, CASE WHEN CASE kind WHEN 'count' THEN abs(o_totalprice - v) > 0 WHEN 'money' THEN abs(o_totalprice - v) >= 0.005::DOUBLE
        WHEN 'measure' THEN abs(o_totalprice - v) > 0.05::DOUBLE * abs(v) ELSE abs(o_totalprice - v) > 0.1::DOUBLE END THEN 'NUMERIC_MISMATCH' END AS penalty_type
      FROM t JOIN orders ON o_orderkey = claim_id, unnest(['count', 'money', 'measure', 'magnitude']) AS k(kind)""",
    "calibration_matrix": f"""SELECT ([{quoted(V.VERDICTS)}])[n_chars % 9 + 1] AS verdict, count(*) AS n, sum(quality)::BIGINT AS positives, round(sum(quality)::DOUBLE / count(*), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "token_search": f"SELECT doc_id FROM documents WHERE list_contains({_TOK.format(t='text')}, 'the') AND list_contains({_TOK.format(t='text')}, 'and')",
}


def _sources_checked_sql() -> str:
    from workload.corpus import _REL

    return _REL + f""", {SOURCES} SELECT submission_id AS verification_id, domain, count(DISTINCT doc_id) AS documents, round(max(score), 6) AS best_score
      FROM rel JOIN claims USING (claim_id) JOIN documents d USING (doc_id) JOIN sources s ON s.source = d.source WHERE score >= 0.12 GROUP BY ALL"""


ORACLES["sources_checked"] = _sources_checked_sql()
ORACLES["job_dedup_stream"] = ORACLES["job_dedup"]
ORACLES["stage_state_stream"] = ORACLES["stage_state"]
ORACLES["lease_expiries_stream"] = f"""WITH l AS (SELECT user_id||'-'||{_SQL_K} AS job_id, ts, event_id, {_sql_mapped(_QUEUE)} AS ev, {_SQL_K} % 3 + 1 AS attempt FROM events),
  n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next_ts FROM l WHERE ev IN ('reserve', 'complete', 'fail'))
  SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS reserved_at, strftime(ts + INTERVAL 900 SECOND, '%Y-%m-%d %H:%M:%S') AS lease_expires_at, (attempt + 1)::INT AS next_attempt
  FROM n WHERE ev = 'reserve' AND (next_ts IS NULL OR next_ts > ts + INTERVAL 900 SECOND)"""

_DATED = """c AS (SELECT o_orderkey AS claim_id, o_orderdate::DATE AS f, o_orderdate::DATE + (o_orderkey % 120)::INT AS l, o_custkey FROM orders),
  e AS (SELECT l_orderkey AS claim_id, min(l_shipdate::DATE) AS f, max(l_shipdate::DATE + l_linenumber::INT) AS l,
    bool_or(l_shipdate::DATE <= c.l + 1 AND l_shipdate::DATE + l_linenumber::INT >= c.f - 1) AS met FROM lineitem JOIN c ON c.claim_id = l_orderkey GROUP BY 1),
  p AS (SELECT claim_id, CASE WHEN NOT met THEN 'DATE_MISMATCH' WHEN e.f >= c.f AND e.l <= c.l AND (c.l - c.f + 1) > 2.0 * (e.l - e.f + 1) THEN 'EXAGGERATION' END AS penalty_type FROM e JOIN c USING (claim_id))"""
ORACLES["date_penalties"] = f"WITH {_DATED} SELECT * FROM p WHERE penalty_type IS NOT NULL"
ORACLES["date_penalty_values"] = f"""WITH {_DATED} SELECT CASE penalty_type WHEN 'DATE_MISMATCH' THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END AS applied_penalty, count(*) AS claims FROM p WHERE penalty_type IS NOT NULL GROUP BY 1"""
ORACLES["window_overlaps"] = f"""WITH {_DATED}, w AS (SELECT c_nationkey AS nation, min(o_orderdate::DATE) + c_nationkey * 40 AS f, max(o_orderdate::DATE) - c_nationkey * 50 AS l FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey)
  SELECT nation, count(*) AS claims, sum((least(c.l, w.l) - greatest(c.f, w.f) + 1)::BIGINT)::BIGINT AS days FROM w JOIN c ON c.f <= w.l AND c.l >= w.f AND w.f <= w.l GROUP BY 1"""
