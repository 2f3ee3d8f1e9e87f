"""One query per operator, run over the whole tables.

and lists as text, counts as bigint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from contactlake import model, vocab
from contactlake.functions import dates, emails, names, phones, values
from contactlake.functions.layers import apply_layers
from contactlake.functions.similarity import similarity
from contactlake.operators import drift, entities, inference, mappings as M, memory, records
from contactlake.operators.positions import (
    AT, form_batches, landed_position, number_sorted, numbered_runs, slice_records,
)
from contactlake.operators.profiling import profile_source
from contactlake.operators.projection import (
    canonicalize, check_contract, split_valid, with_occurrence,
)
from contactlake.operators.upsert import upsert
from contactlake.plans import healing, reports
from contactlake.session import Scratch, configure
from contactlake.sources import feeds
from contactlake.sources.tables import LeadsTable, MappingLog, RunTable
from contactlake.streaming import replay
from workload import feed as f

#: batch size of the batch queries
BATCH = 500
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_STORED: dict[tuple, DataFrame] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table, written once per session and scale and then read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = Scratch(spark, "stored").put(name, make())
    return _STORED[key]


def raw(spark: SparkSession, sf_dir: str, drifted: bool = False) -> DataFrame:
    return stored(spark, sf_dir, f"raw-{drifted}", lambda: f.feed(spark, sf_dir, drifted))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drifting feed in batches; its lines are dealt out before they are parsed."""
    return stored(
        spark, sf_dir, "batches", lambda: f.parse_feed(form_batches(f.feed_lines(spark, sf_dir, drift=True), BATCH))
    )


def cleaned(rows: DataFrame) -> DataFrame:
    return canonicalize(rows, vocab.KNOWN_MAPPINGS, f.ingest_ts(), keep=("seq",))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(raw(spark, sf_dir))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid leads; the feed is read as it is rendered, not from a copy of it."""
    return stored(spark, sf_dir, "leads", lambda: split_valid(cleaned(f.feed(spark, sf_dir)))[0])


def text_of(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias(ts)


def joined(items: str) -> Column:
    return F.array_join(items, ",").alias(items)


def _in_file(spark: SparkSession, sf_dir: str, source: str, suffix: str, header: str | None = None) -> str:
    """Write one source's raw lines as text files; returns the folder."""
    path = Scratch(spark, "files").path(f"{source}.{suffix}")
    lines = f.feed_lines(spark, sf_dir).filter(F.col("source") == source).select("raw_line")
    if header is None:
        lines.write.text(path)
    else:
        # every CSV part file starts with the header
        columns = f.CSV_HEADERS[source]
        parsed = lines.select(records.csv_record(F.col("raw_line"), columns).alias("rec"))
        named = parsed.select(*[F.col("rec")[c].alias(c) for c in columns])
        as_it_is = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        named.write.options(header=True, escape='"', **as_it_is).csv(path)
    return path


# -- sources, sinks, batching ------------------------------------------------


@query
def s1_scan_json_lines(spark, sf_dir):
    path = _in_file(spark, sf_dir, "landing_page", "jsonl")
    rec = F.col("rec")
    return feeds.read_leads(spark, path, "landing_page", "jsonl").select(
        rec["lead_id"].cast("bigint").alias("seq"),
        rec["fname"].alias("fname"),
        rec["email_addr"].alias("email_addr"),
        rec["mobile"].alias("mobile"),
        rec["opt_in"].alias("opt_in"),
        F.size(F.map_keys("rec")).cast("bigint").alias("n_keys"),
    )


@query
def s2_scan_csv(spark, sf_dir):
    path = _in_file(spark, sf_dir, "google_form", "csv", "header")
    rec = F.col("rec")
    found = feeds.read_leads(spark, path, "google_form", "csv")
    cells = [
        F.nullif(rec[name], F.lit("")).alias(f"c{i}")
        for i, name in enumerate(f.CSV_HEADERS["google_form"])
    ]
    return found.select(*cells).groupBy("c0", "c1", "c2", "c3", "c4", "c5").agg(
        F.count(F.lit(1)).alias("n")
    )


def _webhook_fields(rec: Column) -> list[Column]:
    return [
        rec[key].alias(key)
        for key in ("campaign_id", "created_time", "full_name", "email", "phone_number")
    ]


@query
def s3_flatten_webhook(spark, sf_dir):
    found = records.with_record(
        f.raw_columns(spark, sf_dir)
        .filter(F.col("source") == "facebook")
        .select("seq", f.webhook_line().alias("value")),
        "value",
    )
    return found.select(
        "seq", *_webhook_fields(F.col("rec")), F.size("rec").cast("bigint").alias("n_keys")
    )


@query
def s3b_flatten_all_changes(spark, sf_dir):
    lines = (
        f.raw_columns(spark, sf_dir)
        .filter(F.col("source") == "facebook")
        .select("seq", f.webhook_line_of_three().alias("value"))
    )
    return records.flatten_all_changes(lines).select(
        "seq",
        F.col("entry_no").cast("bigint").alias("entry_no"),
        F.col("change_no").cast("bigint").alias("change_no"),
        *_webhook_fields(F.col("rec")),
    )


@query
def s4_union_sources(spark, sf_dir):
    every = raw(spark, sf_dir)
    parts = {s: every.filter(F.col("source") == s).drop("source") for s in vocab.SOURCES}
    return records.union_sources(parts, ("instagram", "landing_page")).select("source", "seq")


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed, numbered where its rows were read."""
    return stored(
        spark, sf_dir, "landed", lambda: numbered_runs(raw(spark, sf_dir).sortWithinPartitions("source", "seq"))
    )


@query
def s5_slice_records(spark, sf_dir):
    rows = landed(spark, sf_dir).select("source", "seq", AT)
    return slice_records(rows, skip=100, limit=1000, place=landed_position).select("source", "seq", "pos")


@query
def s5_slice_unlanded(spark, sf_dir):
    """The same by ranges of the order column, for a frame that was not landed."""
    return slice_records(raw(spark, sf_dir).select("source", "seq"), skip=100, limit=1000).select(
        "source", "seq", "pos"
    )


@query
def s6_form_batches(spark, sf_dir):
    rows = landed(spark, sf_dir).select("source", "seq", AT)
    return form_batches(rows, BATCH, place=landed_position).drop(AT)


@query
def s6_batches_unlanded(spark, sf_dir):
    return form_batches(raw(spark, sf_dir).select("source", "seq"), BATCH)


@query
def s7_repeated_lines(spark, sf_dir):
    """Every line delivered twice, and the second delivery handled once more: each copy keeps one id of its own."""
    scratch = Scratch(spark, "repeats")
    tables = []
    for source in ("facebook", "landing_page"):
        inbox, root = scratch.path(f"inbox-{source}"), scratch.path(f"lake-{source}")
        own = f.feed_lines(spark, sf_dir).filter(F.col("source") == source).select("raw_line")
        handler = replay.heal_handler(spark, root, f.ingest_ts(), known=vocab.KNOWN_MAPPINGS)
        last = []

        def handle(batch, batch_id, handler=handler, last=last):
            handler(batch, batch_id)
            last[:] = [scratch.put(f"delivery-{batch_id}", batch), batch_id]

        for _ in range(2):
            own.write.mode("append").text(inbox)  # under new names
            stream = replay.line_stream(spark, inbox, source, files_per_batch=1000)
            replay.run_stream(stream, scratch.path(f"checkpoint-{source}"), handle)
        leads_ = RunTable(spark, f"{root}/leads", model.LEADS)
        before = scratch.put(f"before-{source}", leads_.read().select("lead_id"))
        handler(*last)
        tables.append(leads_.read().join(before.withColumn("kept", F.lit(1)), "lead_id", "left"))
    return tables[0].unionByName(tables[1]).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("lead_id").alias("ids"), F.count("kept").alias("kept")
    )


@query
def p15_ids_survive(spark, sf_dir):
    """The feed's files read, a file added in front, and all read again: the ids of the first reading are still there."""
    scratch = Scratch(spark, "survive")
    folder = scratch.path("landing.jsonl")
    lines = f.feed_lines(spark, sf_dir).filter(F.col("source") == "landing_page").select("seq", "raw_line")

    def ids(name: str) -> DataFrame:
        landed_ = feeds.land(feeds.read_leads(spark, folder, "landing_page"), scratch.path(f"landed-{name}"))
        rows = feeds.with_places(landed_, scratch)
        checked_ = canonicalize(rows, vocab.KNOWN_MAPPINGS, f.ingest_ts(), identity=feeds.IDENTITY)
        seq = F.get_json_object("raw_payload", "$.lead_id").cast("bigint").alias("seq")
        return scratch.put(f"ids-{name}", checked_.select("lead_id", seq))

    lines.filter(F.col("seq") % 2 == 0).select("raw_line").write.mode("append").text(folder)
    first = ids("first")
    lines.filter(F.col("seq") % 2 == 1).select("raw_line").write.mode("append").text(folder)
    second = ids("second")
    kept = second.join(first.withColumn("kept", F.lit(True)), ["lead_id", "seq"], "left")
    return kept.select("seq", F.coalesce("kept", F.lit(False)).alias("kept"))


@query
def s7_stream_replay(spark, sf_dir):
    scratch = Scratch(spark, "stream")
    lines = f.feed_lines(spark, sf_dir, drift=True).filter(F.col("source") == "facebook")
    total = f.table(spark, sf_dir, "orders").count()
    quarter = F.floor(F.col("seq") * 4 / total).cast("int")
    inbox, root = scratch.path("inbox"), scratch.path("lake")
    arrived = scratch.put("arrived", lines.withColumn("quarter", quarter), ("quarter",))
    handler = replay.heal_handler(
        spark, root, f.ingest_ts(), known=vocab.KNOWN_MAPPINGS, batch_size=10**9
    )
    # four deliveries; after each the stream takes up what is new
    for q in range(4):
        arrived.filter(F.col("quarter") == q).select("raw_line").write.mode("append").text(inbox)
        stream = replay.line_stream(spark, inbox, "facebook", files_per_batch=1000)
        replay.run_stream(stream, scratch.path("checkpoint"), handler)
    table = RunTable(spark, f"{root}/leads", model.LEADS).read()
    return table.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def k1_upsert_leads(spark, sf_dir):
    old = leads(spark, sf_dir).select(*model.LEAD_COLUMNS, "seq")
    later = F.lit("2026-08-02 00:00:00").cast("timestamp")
    changed = old.filter(F.col("seq") % 3 == 0)
    first = changed.withColumns({"campaign_id": F.lit("first"), "ingested_at": later})
    last = changed.filter(F.col("seq") % 2 == 0).withColumns(
        {"campaign_id": F.lit("last"), "ingested_at": later + F.expr("interval 1 hour")}
    )
    table = upsert(old, first.unionByName(last))
    return table.select("seq", "lead_id", "campaign_id", text_of("ingested_at"))


@query
def k1_leads_table(spark, sf_dir):
    """The same inserts into the stored table, of which only some pieces are written again."""
    old = leads(spark, sf_dir).select(*model.LEAD_COLUMNS, "seq")
    later = F.lit("2026-08-02 00:00:00").cast("timestamp")
    changed = old.filter(F.col("seq") % 3 == 0)
    first = changed.withColumns({"campaign_id": F.lit("first"), "ingested_at": later})
    last = changed.filter(F.col("seq") % 2 == 0).withColumns(
        {"campaign_id": F.lit("last"), "ingested_at": later + F.expr("interval 1 hour")}
    )
    table = LeadsTable(spark, Scratch(spark, "k1").path("leads"), buckets=16)
    table.insert(old)
    table.insert(first)
    stored_ = table.insert(last)
    return stored_.join(old.select("lead_id", "seq"), "lead_id").select(
        "seq", "lead_id", "campaign_id", text_of("ingested_at")
    )


@query
def k2_heal_events(spark, sf_dir):
    docs = f.table(spark, sf_dir, "documents").select(
        "source", F.lit("human_review").alias("event"), F.col("text").alias("detail"),
    )
    table = RunTable(spark, Scratch(spark, "k2").path("events"), model.HEAL_EVENTS)
    table.write(model.heal_events(docs, f.ingest_ts()), "1")
    return table.read().select(
        "source", "event", F.col("attempt").cast("bigint").alias("attempt"),
        F.char_length("detail").cast("bigint").alias("width"), F.md5("detail").alias("digest"),
        text_of("ts"),
    )


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed with some landing-page lines cut short and one date too late."""
    lines = f.feed_lines(spark, sf_dir)
    landing = F.col("source") == "landing_page"
    cut = F.when(
        landing & (F.col("seq") % 97 < 10),
        F.expr("substring(raw_line, 1, length(raw_line) - 5)"),
    ).when(
        landing & (F.col("seq") % 89 < 6),
        F.regexp_replace("raw_line", '"submitted_at":"[^"]*"', '"submitted_at":"253402300800"'),
    )
    return f.parse_feed(lines.withColumn("raw_line", F.coalesce(cut, F.col("raw_line"))))


@query
def k3_review_queue(spark, sf_dir):
    _, failed = split_valid(
        canonicalize(_broken(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts(), keep=("seq",))
    )
    queue = failed.select(
        "source",
        F.array_join("violations", ", ").alias("reason"),
        F.to_json(F.struct("seq")).alias("raw_payload"),
    )
    table = RunTable(spark, Scratch(spark, "k3").path("review"), model.REVIEW_QUEUE)
    table.write(model.review_rows(queue, f.ingest_ts()), "1")
    return table.read().select(
        "source", "reason", F.get_json_object("raw_payload", "$.seq").cast("bigint").alias("seq")
    )


def mapping_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with one version per order: a source per customer; some versions
    only invalidate."""
    orders = f.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    versions = orders.select(
        F.concat(F.lit("form-"), F.col("o_custkey").cast("string")).alias("source"),
        key.alias("version"),
        F.when(key % 7 == 0, F.lit(M.INVALIDATED)).otherwise(F.lit(M.APPROVED)).alias("state"),
    )
    field = F.array(
        F.struct(F.lit(1).alias("ordinal"), F.lit("name").alias("field"), F.lit("split_full_name").alias("transform")),
        F.struct(
            F.lit(2).alias("ordinal"),
            F.concat(F.lit("contact"), (F.col("version") % 5).cast("string")).alias("field"),
            F.when(F.col("version") % 2 == 0, F.lit("email")).otherwise(F.lit("phone")).alias("transform"),
        ),
        F.struct(F.lit(3).alias("ordinal"), F.lit("note").alias("field"), F.lit("ignore").alias("transform")),
    )
    nothing = F.array(
        F.struct(
            F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("string").alias("field"),
            F.lit(None).cast("string").alias("transform"),
        )
    )
    rows = F.explode(F.when(F.col("state") == M.APPROVED, field).otherwise(nothing))
    return versions.withColumn("_row", rows).select("source", "version", "state", "_row.*")


@query
def k4_mapping_store(spark, sf_dir):
    log = MappingLog(spark, Scratch(spark, "k4").path("mappings"))
    rows = mapping_log(spark, sf_dir)
    log.write(rows.filter(F.col("version") % 2 == 0), "1")
    log.write(rows.filter(F.col("version") % 2 == 1), "2")
    return log.read().groupBy("source", "state").agg(
        F.countDistinct("version").alias("versions"), F.count("field").alias("fields")
    )


@query
def k5_table_contract(spark, sf_dir):
    partial = leads(spark, sf_dir).select("lead_id", "source", "quality_score")
    rows = model.conform(partial, model.LEADS, {"ingested_at": f.ingest_ts(), "consent": F.lit(False)})
    return rows.select(
        "lead_id", "source", "email", "consent", F.col("quality_score").cast("bigint").alias("quality_score"),
        text_of("ingested_at"),
    )


@query
def k6_rename_fields(spark, sf_dir):
    lines = (
        f.raw_columns(spark, sf_dir)
        .filter(F.col("source") == "facebook")
        .select("seq", f.webhook_line().alias("value"))
    )
    start = f.table(spark, sf_dir, "orders").count() // 2
    line = F.when(
        F.col("seq") >= start, records.rename_webhook_fields(F.col("value"), vocab.DRIFT_RENAMES)
    ).otherwise(F.col("value"))
    renamed = records.with_record(lines.withColumn("value", line), "value")
    rec = F.col("rec")
    return renamed.select(
        "seq",
        rec["full_name"].alias("full_name"),
        rec["applicant_name"].alias("applicant_name"),
        rec["phone_number"].alias("phone_number"),
        rec["contact_phone"].alias("contact_phone"),
    )


# -- projection, cleaning, flags, score --------------------------------------


@query
def p1_apply_mapping(spark, sf_dir):
    return checked(spark, sf_dir).select(
        "seq", "source", "first_name", "last_name", "email", "phone_e164", "campaign_id", "consent",
        text_of("created_at"),
    )


@query
def p1_last_field_wins(spark, sf_dir):
    """Two fields for one target: the later one's value, both ones' flags."""
    rows = raw(spark, sf_dir).filter(F.col("source") == "facebook")
    mapping = {
        "full_name": "split_full_name",
        "phone_number": "phone",
        "email": "email",
        "backup_email": "email",
        "campaign_id": "campaign_id",
        "created_time": "created_at",
    }
    out = canonicalize(rows, {"facebook": mapping}, f.ingest_ts(), keep=("seq",))
    return out.select("seq", "email", "phone_e164", joined("flags"))


@query
def p2_raw_payload(spark, sf_dir):
    rec = records.parse_object(F.col("raw_payload"))
    rows = checked(spark, sf_dir).select("seq", rec.alias("rec"))

    def item(key: str) -> Column:
        return F.col("rec")[key]

    return rows.select(
        "seq",
        F.coalesce(item("email"), item("E-mail"), item("Your email address"), item("email_addr")).alias("email"),
        F.coalesce(item("full_name"), item("Full Name"), item("What's your name?"), item("fname")).alias("name"),
        F.size("rec").cast("bigint").alias("keys"),
    )


@query
def p3_clean_name(spark, sf_dir):
    rows = f.raw_columns(spark, sf_dir).select("seq", "name_raw")
    return apply_layers(rows, names.name_recipe(F.col("name_raw"), "name")).select("seq", "name")


@query
def p4_split_full_name(spark, sf_dir):
    rows = f.raw_columns(spark, sf_dir).select("seq", "name_raw")
    cleaned = apply_layers(rows, names.name_recipe(F.col("name_raw"), "name"))
    spaced = cleaned.withColumn("name", names.spaced(F.col("name")))
    return spaced.select(
        "seq",
        names.first_word(F.col("name")).alias("first_name"),
        names.other_words(F.col("name")).alias("last_name"),
    )


def _cleaned_emails(spark, sf_dir):
    rows = f.raw_columns(spark, sf_dir).select("seq", "email_raw")
    return apply_layers(rows, emails.email_recipe(F.col("email_raw"), "email"))


@query
def p5_clean_email(spark, sf_dir):
    return _cleaned_emails(spark, sf_dir).select("seq", "email", "email_flag")


@query
def p5_emails_in_documents(spark, sf_dir):
    """Address candidates in free text, cleaned."""
    words = f.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", r"\s+")).alias("word")
    )
    candidates = words.filter(F.contains("word", F.lit("@")))
    cleaned = apply_layers(candidates, emails.email_recipe(F.col("word"), "email"))
    return cleaned.groupBy("doc_id", "email", "email_flag").agg(F.count(F.lit(1)).alias("n"))


@query
def p6_typo_domain(spark, sf_dir):
    return _cleaned_emails(spark, sf_dir).filter("email_typo is not null").select(
        "seq", "email", "email_typo"
    )


@query
def p7_junk_email(spark, sf_dir):
    return (
        _cleaned_emails(spark, sf_dir)
        .filter(F.col("email_flag") == emails.JUNK)
        .groupBy("email")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def p8_clean_phone(spark, sf_dir):
    rows = f.raw_columns(spark, sf_dir).select("seq", "phone_raw")
    return apply_layers(rows, phones.phone_recipe(F.col("phone_raw"), "phone")).select(
        "seq", "phone", "phone_flag"
    )


@query
def p9_clean_date(spark, sf_dir):
    rows = f.raw_columns(spark, sf_dir).select("seq", "date_raw")
    return apply_layers(rows, dates.date_recipe(F.col("date_raw"), "created_at")).select(
        "seq", text_of("created_at")
    )


@query
def p9_dates_of_every_style(spark, sf_dir):
    """Each order date written in many ways; all must give the same instant."""
    at = F.col("o_orderdate").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    orders = f.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), at.alias("at"))
    styles = {
        "iso": F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "offset": F.date_format("at", "yyyy-MM-dd HH:mm:ss+00:00"),
        "epoch": F.unix_timestamp("at").cast("string"),
        "month_first": F.date_format("at", "M/d/yyyy H:mm:ss"),
        "half_day": F.date_format("at", "MM/dd/yyyy hh:mm:ss a"),
        "day_name": F.date_format("at", "dd-MMM-yyyy HH:mm:ss"),
        "name_day": F.date_format("at", "MMMM d, yyyy HH:mm:ss"),
        "compact": F.date_format("at", "yyyyMMdd'T'HHmmss"),
    }
    written = orders.select(
        "seq", F.explode(F.create_map(*[x for k, v in styles.items() for x in (F.lit(k), v)])).alias("style", "text")
    )
    return apply_layers(written, dates.date_recipe(F.col("text"), "created_at")).select(
        "seq", "style", text_of("created_at")
    )


@query
def p10_consent(spark, sf_dir):
    return f.raw_columns(spark, sf_dir).select(
        "seq", values.consent(F.col("consent_raw")).alias("consent")
    )


@query
def p11_campaign(spark, sf_dir):
    emptied = F.when(F.col("seq") % 10 == 0, F.lit("")).otherwise(F.col("campaign_raw"))
    return f.raw_columns(spark, sf_dir).select("seq", values.campaign(emptied).alias("campaign_id"))


@query
def p12_defaults(spark, sf_dir):
    """Rows without a date and without a name."""
    late = records.rename_fields(F.col("rec"), {"created_time": "unmapped_time", "submitted_at": "later"})
    rows = raw(spark, sf_dir).withColumn("rec", F.when(F.col("seq") % 5 == 0, late).otherwise(F.col("rec")))
    out = canonicalize(rows, vocab.KNOWN_MAPPINGS, f.ingest_ts(), keep=("seq",))
    return out.select("seq", text_of("created_at"), joined("flags"), "status")


@query
def p13_flags(spark, sf_dir):
    return checked(spark, sf_dir).select("seq", joined("flags"))


@query
def p14_status(spark, sf_dir):
    return checked(spark, sf_dir).select("seq", "status")


@query
def p15_lead_id(spark, sf_dir):
    return checked(spark, sf_dir).select("seq", "lead_id")


@query
def p15_occurrence(spark, sf_dir):
    """Equal lines of a source numbered, for content-based ids."""
    lines = f.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("seq"), F.col("props").alias("raw_line")
    )
    return with_occurrence(lines).select("seq", F.col("occurrence_no").cast("bigint").alias("occurrence_no"))


@query
def p16_quality_score(spark, sf_dir):
    return checked(spark, sf_dir).select("seq", F.col("quality_score").cast("bigint").alias("quality_score"))


@query
def p17_contract(spark, sf_dir):
    """A stored table with damaged rows against the contract."""
    seq = F.col("seq")
    damaged = leads(spark, sf_dir).withColumns(
        {
            "source": F.when(seq % 11 == 0, F.lit("fax")).otherwise(F.col("source")),
            "phone_e164": F.when(seq % 13 == 0, F.lit("5551234")).otherwise(F.col("phone_e164")),
            "quality_score": F.when(seq % 17 == 0, F.lit(101)).otherwise(F.col("quality_score")),
            "status": F.when(seq % 19 == 0, F.lit("open")).otherwise(F.col("status")),
            "raw_payload": F.when(seq % 23 == 0, F.lit("{oops")).otherwise(F.col("raw_payload")),
            "created_at": F.when(seq % 29 != 0, F.col("created_at")),
        }
    )
    return check_contract(damaged).select("seq", joined("violations"))


@query
def p18_split_valid(spark, sf_dir):
    rows = canonicalize(_broken(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts(), keep=("seq",))
    ok, failed = split_valid(rows)
    return ok.select("seq", F.lit("").alias("violations")).unionByName(
        failed.select("seq", joined("violations"))
    )


# -- profiling, drift, mappings, healing --------------------------------------


@query
def m1_profile(spark, sf_dir):
    table = profile_source(raw(spark, sf_dir))
    return table.select(
        "source", "field", "n", "present",
        F.array_join("samples", "|").alias("samples"),
    )


@query
def m1_profile_everything(spark, sf_dir):
    """Without the row limit, over another feed: event properties by type."""
    rows = f.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source"), F.col("event_id").alias("seq"),
        records.parse_object(F.col("props")).alias("rec"),
    )
    table = profile_source(rows, max_rows=None)
    return table.select("source", "field", "n", "present", F.array_join("samples", "|").alias("samples"))


def _health(spark, sf_dir):
    return drift.batch_health(batches(spark, sf_dir), vocab.KNOWN_MAPPINGS)


@query
def m2_missing_counts(spark, sf_dir):
    return drift.missing_counts(_health(spark, sf_dir))


@query
def m3_unmapped_fields(spark, sf_dir):
    return drift.unmapped_fields(batches(spark, sf_dir), vocab.KNOWN_MAPPINGS)


@query
def m4_drift_decision(spark, sf_dir):
    return _health(spark, sf_dir).select(
        "source", "batch_id", "n", "failed", F.array_join(F.sort_array("dead_fields"), ",").alias("dead_fields"),
        "drifted",
    )


@query
def m5_drift_report(spark, sf_dir):
    report = drift.drift_report(batches(spark, sf_dir), vocab.KNOWN_MAPPINGS)
    return report.select(
        "source", "batch_id", "n", "failed",
        F.array_join(F.sort_array("dead_fields"), ",").alias("dead_fields"),
        joined("unmapped"), joined("errors"), joined("first_keys"),
    )


def _proposals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A profile and a proposed mapping per customer, some of them faulty."""
    customers = f.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    source = F.concat(F.lit("form-"), F.col("k").cast("string")).alias("source")
    real = F.array(F.lit("name"), F.lit("mail"), F.lit("tel"), F.lit("note"))
    profile = customers.select(source, F.posexplode(real).alias("place", "field")).select(
        "source", (F.col("place") + 1).alias("ordinal"), "field"
    )
    k = F.col("k")
    wanted = F.array(
        F.struct(
            F.when(k % 5 == 1, F.lit("nom")).otherwise(F.lit("name")).alias("field"),
            F.when(k % 7 == 2, F.lit("ignore")).otherwise(F.lit("split_full_name")).alias("transform"),
        ),
        F.struct(
            F.lit("mail").alias("field"),
            F.when(k % 3 == 0, F.lit("mailbox")).otherwise(F.lit("email")).alias("transform"),
        ),
        F.struct(
            F.lit("tel").alias("field"),
            F.when(k % 4 == 0, F.lit("fax")).otherwise(F.lit("phone")).alias("transform"),
        ),
    )
    proposal = (
        customers.filter(k % 11 != 0)
        .select(source, F.posexplode(wanted).alias("place", "w"))
        .select("source", (F.col("place") + 1).cast("int").alias("ordinal"), "w.field", "w.transform")
    )
    return profile, proposal


@query
def m6_validate_mapping(spark, sf_dir):
    profile, proposal = _proposals(spark, sf_dir)
    verdicts, _ = M.validate_mappings(proposal, profile)
    return verdicts


@query
def m6_completed_mapping(spark, sf_dir):
    profile, proposal = _proposals(spark, sf_dir)
    _, table = M.validate_mappings(proposal, profile)
    return table.select("source", F.col("ordinal").cast("bigint").alias("ordinal"), "field", "transform")


@query
def m7_infer_mapping(spark, sf_dir):
    table = inference.infer_mapping(profile_source(raw(spark, sf_dir)))
    return table.select("source", "field", "transform")


@query
def m7_infer_renamed(spark, sf_dir):
    """The webhook feed after the renames."""
    half = f.table(spark, sf_dir, "orders").count() // 2
    rows = raw(spark, sf_dir, True).filter((F.col("source") == "facebook") & (F.col("seq") >= half))
    return inference.infer_mapping(profile_source(rows)).select("source", "field", "transform")


def _halves(spark, sf_dir) -> DataFrame:
    """The drifting feed of all sources, its halves told apart."""
    half = f.table(spark, sf_dir, "orders").count() // 2
    return raw(spark, sf_dir, True).withColumn("late", F.col("seq") >= half)


@query
def m7_infer_every_half(spark, sf_dir):
    """Every source, before and after the renames."""
    keys = ("source", "late")
    return inference.infer_mapping(profile_source(_halves(spark, sf_dir), keys), keys=keys).select(*keys, "field", "transform")


def _unnamed(spark, sf_dir) -> DataFrame:
    """Contact cards of customers, suppliers and users under names that tell nothing."""

    def card(name: str, key: str, source: str, **fields: Column) -> DataFrame:
        pairs = [x for field, value in fields.items() for x in (F.lit(field), value.cast("string"))]
        return f.table(spark, sf_dir, name).select(F.lit(source).alias("source"), F.col(key).alias("seq"), F.create_map(*pairs).alias("rec"))

    def number(key: str) -> Column:
        return F.lpad((F.col(key) % 10000).cast("string"), 4, "0")

    customers = card(
        "customer", "c_custkey", "kunden", kontakt=F.concat(F.lit("k"), "c_custkey", F.lit("@harborline.org")),
        nummer=F.concat(F.lit("212555"), number("c_custkey")), segment=F.col("c_mktsegment"), saldo=F.col("c_acctbal"),
    )
    suppliers = card(
        "supplier", "s_suppkey", "fornitori", tlf=F.concat(F.lit("+1 303 555 "), number("s_suppkey")),
        posta=F.concat(F.lit("s"), "s_suppkey", F.lit("@tidewater.io")), firma=F.col("s_name"),
    )
    users = card(
        "events", "event_id", "brukere", art=F.col("event_type"), dato=F.date_format("ts", "dd MMM yyyy HH:mm"),
        avsender=F.concat(F.lit("u"), "user_id", F.lit("@vexcorp.net")),
    )
    return customers.unionByName(suppliers).unionByName(users)


@query
def m7_infer_unnamed(spark, sf_dir):
    """Fields that only their values tell, assigned one to one."""
    return inference.infer_mapping(profile_source(_unnamed(spark, sf_dir)), attempt=3).select("source", "field", "transform")


@query
def m8_current_mappings(spark, sf_dir):
    return M.current_mappings(mapping_log(spark, sf_dir)).select(
        "source", "version", F.col("ordinal").cast("bigint").alias("ordinal"), "field", "transform"
    )


def _memory(spark, sf_dir) -> DataFrame:
    log = mapping_log(spark, sf_dir).filter(F.col("state") == M.APPROVED)
    samples = f.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("form-"), F.col("c_custkey").cast("string")).alias("source"),
        F.lit("name").alias("field"),
        F.array("c_name", "c_mktsegment").alias("samples"),
    )
    return memory.remember_fields(log, samples, F.col("version"))


@query
def m9_remember_fields(spark, sf_dir):
    rows = _memory(spark, sf_dir)
    early = rows.filter(F.col("version") % 2 == 0)
    late = rows.filter(F.col("version") % 2 == 1)
    return memory.upsert_memory(early, late).select("id", "transform", "doc", "version")


@query
def m10_nearest_vectors(spark, sf_dir):
    """The six vectors nearest to the first one, over the whole table."""
    table = f.table(spark, sf_dir, "embeddings")
    query_vector = table.orderBy("vec_id").select("embedding").first().embedding
    near = memory.top_k(table, query_vector, k=vocab.RETRIEVAL_K, tie_break="vec_id")
    return near.select("vec_id", F.round("distance", 5).alias("distance"))


@query
def m10_nearest_by_cosine(spark, sf_dir):
    table = f.table(spark, sf_dir, "embeddings")
    query_vector = table.orderBy("vec_id").select("embedding").first().embedding
    near = memory.top_k(table, query_vector, k=vocab.RETRIEVAL_K, tie_break="vec_id", metric="cosine")
    return near.select("vec_id", F.round("distance", 5).alias("distance"))


def _remembered(spark, sf_dir) -> DataFrame:
    known = M.to_table(spark, vocab.KNOWN_MAPPINGS)
    return memory.remember_fields(known, profile_source(raw(spark, sf_dir)), F.lit(1).cast("bigint"))


@query
def m10_similar_fields(spark, sf_dir):
    """Approved fields similar to those of every source, before and after the renames."""
    keys = ("source", "late")
    found = memory.similar_to_profile(_remembered(spark, sf_dir), profile_source(_halves(spark, sf_dir), keys), keys=keys, exact=True)
    return found.select(
        F.col("for_source").alias("source"), F.col("for_late").alias("late"), F.col("rank").cast("bigint").alias("rank"),
        "id", "transform",
    )


@query
def m10_similar_by_field(spark, sf_dir):
    """For every field of every source, before and after the renames, the approved fields most like it."""
    keys = ("source", "late")
    profile = profile_source(_halves(spark, sf_dir), keys)
    found = memory.similar_fields(_remembered(spark, sf_dir), profile, keys=keys, exact=True)
    return found.select(
        F.col("for_source").alias("source"), F.col("for_late").alias("late"), F.col("for_field").alias("field"),
        F.col("rank").cast("bigint").alias("rank"), "id", "transform", F.round("similarity", 9).alias("similarity"),
    )


@query
def m10_index_recall(spark, sf_dir):
    """How many of the most similar fields the index finds, against the exact search over the same memory."""
    keys = ("source", "late")
    profile = profile_source(_halves(spark, sf_dir), keys)
    remembered = Scratch(spark, "recall").put("memory", _remembered(spark, sf_dir))
    pair = ["for_source", "for_late", "for_field", "id"]
    exact = memory.similar_fields(remembered, profile, keys=keys, exact=True).select(*pair)
    found = memory.similar_fields(remembered, profile, keys=keys).select(*pair, F.lit(1).alias("hit"))
    return exact.join(found, pair, "left").groupBy(F.col("for_source").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), (F.count("hit") / F.count(F.lit(1)) >= 0.9).alias("enough")
    )


def _no_mapper(profile, memory, attempt, feedback, keys):
    """A mapper that never finds anything."""
    return profile.select(*keys, "ordinal", "field", F.lit("ignore").alias("transform"))


_no_mapper.repeats = True


@query
def m11_heal_leads(spark, sf_dir):
    healed = healing.heal(batches(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts())
    return healed.leads.groupBy("source", "batch_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query
def m11_heal_events(spark, sf_dir):
    healed = healing.heal(batches(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts())
    placed = number_sorted(healed.events, ["source", "batch_id", "step"], Scratch(spark, "m11"), "place")
    return placed.select(
        F.col("place").cast("bigint").alias("step"), "source", "batch_id", "event", F.col("attempt").cast("bigint").alias("attempt")
    )


@query
def m12_give_up(spark, sf_dir):
    """Nothing can be inferred: drifted batches go to review whole."""
    healed = healing.heal(
        batches(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts(), mapper=_no_mapper
    )
    key = F.coalesce(
        F.get_json_object("raw_payload", "$.created_time"), F.lit("")
    )
    return healed.review.select("source", key.alias("created_time")).groupBy("source", "created_time").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def m13_record_keys(spark, sf_dir):
    return (
        batches(spark, sf_dir)
        .select("source", F.explode(F.map_keys("rec")).alias("field"))
        .groupBy("source", "field")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# -- entity resolution ---------------------------------------------------------


def resolution(spark: SparkSession, sf_dir: str) -> entities.Resolution:
    key = (spark.sparkContext.applicationId, sf_dir, "resolution")
    if key not in _STORED:
        _STORED[key] = entities.resolve_entities(leads(spark, sf_dir))
    return _STORED[key]


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leads after duplicate marking; each query reads the columns it needs."""
    return resolution(spark, sf_dir).leads


@query
def d1_candidates(spark, sf_dir):
    return entities.candidates(leads(spark, sf_dir)).select(
        "lead_id", "name", "phone_e164", "email", "source",
        F.col("quality_score").cast("bigint").alias("quality_score"),
    )


def _pairs(spark, sf_dir) -> DataFrame:
    cands = entities.candidates(leads(spark, sf_dir))
    return entities.block_pairs(cands, cands.count())


@query
def d2_block_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("block", "first_id", "lead_id")


@query
def d2_hot_blocks(spark, sf_dir):
    """The same pairs where every block counts as a hot one."""
    cands = entities.candidates(leads(spark, sf_dir))
    return entities.block_pairs(cands, cands.count(), heavy_floor=1).select("block", "first_id", "lead_id")


@query
def d3_name_similarity(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).filter("first_name <> '' and name <> ''")
    distinct = pairs.select(F.col("first_name").alias("a"), F.col("name").alias("b")).distinct()
    return distinct.select("a", "b", F.round(similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


@query
def d4_matched_pairs(spark, sf_dir):
    return entities.match_pairs(_pairs(spark, sf_dir)).select("block", "first_id", "lead_id")


@query
def d5_components(spark, sf_dir):
    return resolution(spark, sf_dir).components.select("node", "component")


@query
def d5_hot_components(spark, sf_dir):
    """The same components where every node with several neighbours counts as a hot one."""
    cands = entities.candidates(leads(spark, sf_dir))
    edges = entities.matched_edges(cands, cands.count())
    return entities.connected_components(edges, Scratch(spark, "d5"), heavy_floor=1).select("node", "component")


@query
def d6_survivors(spark, sf_dir):
    return resolution(spark, sf_dir).groups.select("component", "survivor_id", "members")


@query
def d7_summary(spark, sf_dir):
    return resolution(spark, sf_dir).summary()


@query
def d8_marked_leads(spark, sf_dir):
    return resolved(spark, sf_dir).select("lead_id", "status")


@query
def d8_leads_table(spark, sf_dir):
    """Duplicates marked in the stored table, where they are."""
    table = LeadsTable(spark, Scratch(spark, "d8").path("leads"), buckets=16)
    table.insert(leads(spark, sf_dir))
    return table.mark(resolution(spark, sf_dir).losers).select("lead_id", "status")


# -- reports ---------------------------------------------------------------------


@query
def a1_totals(spark, sf_dir):
    return reports.totals(resolved(spark, sf_dir))


@query
def a2_status_by_source(spark, sf_dir):
    return reports.status_by_source(resolved(spark, sf_dir))


@query
def a3_score_histogram(spark, sf_dir):
    return reports.score_histogram(resolved(spark, sf_dir))


@query
def a3_score_exact(spark, sf_dir):
    return reports.score_histogram(resolved(spark, sf_dir), width=None)


@query
def a4_latest_events(spark, sf_dir):
    """The latest heal events, over the event table as an event log."""
    log = f.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"),
        F.lit("retry").alias("event"), (F.col("event_id") % 3).cast("int").alias("attempt"),
        F.col("props").alias("detail"),
    )
    return reports.latest_events(log).select(
        text_of("ts"), "source", "event", F.col("attempt").cast("bigint").alias("attempt"), "detail"
    )


@query
def a5_latest_leads(spark, sf_dir):
    """Every tenth lead was ingested later than the others."""
    ts = F.col("ingested_at") + F.expr("make_dt_interval(0, 0, 0, seq % 10)")
    rows = leads(spark, sf_dir).withColumn("ingested_at", ts)
    return reports.latest_leads(rows).select(
        "first_name", "last_name", "email", "phone_e164", "source", "campaign_id", "consent",
        text_of("created_at"), F.col("quality_score").cast("bigint").alias("quality_score"), "status",
        joined("flags"),
    )


@query
def a6_latest_reviews(spark, sf_dir):
    rows = f.table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("source"),
        F.lit("row validation failed").alias("reason"), F.col("props").alias("raw_payload"),
    )
    return reports.latest_reviews(rows).select(text_of("ts"), "source", "reason", "raw_payload")


@query
def a7_run_report(spark, sf_dir):
    return reports.run_report(
        canonicalize(_broken(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts())
    )


@query
def a8_run_totals(spark, sf_dir):
    rows = canonicalize(_broken(spark, sf_dir), vocab.KNOWN_MAPPINGS, f.ingest_ts())
    return reports.run_totals(rows, resolved(spark, sf_dir), 1.0).select("rows", "table_rows", "table_clean")


@query
def a9_clean_rate(spark, sf_dir):
    return reports.clean_rate(resolved(spark, sf_dir)).select(F.round("clean_rate", 6).alias("clean_rate"))
