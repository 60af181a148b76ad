"""Event envelopes: schemas, validation, scans, sinks and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.storage import fresh

# Which event types a source may send.
EVENT_TYPES = {
    "card_payments": ("purchase", "refund", "decline"),
    "instant_payments": ("inbound_transfer", "outbound_transfer"),
    "ach_wire": ("inbound_transfer", "outbound_transfer"),
    "core_banking_ledger": ("deposit", "withdrawal", "standing_instruction", "fee", "interest_credit"),
    "trading_brokerage": ("buy", "sell", "dividend", "deposit_to_brokerage"),
    "loan_kyc": ("loan_application", "loan_disbursed", "kyc_update", "address_change", "marital_status_change", "dependents_change"),
    "web_app_events": ("login", "search_query", "feature_used", "session_duration"),
    "support_logs": ("ticket_created", "ticket_resolved", "call_transcript"),
    "social_signal_consented": ("life_event_mention",),
}
SOURCES = tuple(EVENT_TYPES)
TRANSACTIONS = ("card_payments", "instant_payments", "ach_wire", "core_banking_ledger")
CATEGORIES = ("complaint", "question", "dispute", "fee_issue")
#: Which agents read a source.
AGENTS = {"transaction": TRANSACTIONS, "usage": ("web_app_events",), "support": ("support_logs",), "kyc": ("loan_kyc",)}

PAYLOAD = T.StructType([T.StructField(n, t) for n, t in (
    ("merchant_name", T.StringType()), ("mcc_category", T.StringType()), ("amount", T.DoubleType()), ("currency", T.StringType()), ("is_international", T.BooleanType()),
    ("card_present", T.BooleanType()), ("decline_reason", T.StringType()), ("direction", T.StringType()), ("counterparty_name", T.StringType()), ("counterparty_country", T.StringType()),
    ("transfer_type", T.StringType()), ("status", T.StringType()), ("balance_after", T.DoubleType()), ("transaction_type", T.StringType()), ("instrument_type", T.StringType()),
    ("risk_category", T.StringType()), ("portfolio_value_after", T.DoubleType()), ("event_subtype", T.StringType()), ("old_value", T.StringType()), ("new_value", T.StringType()),
    ("feature_or_page", T.StringType()), ("search_text", T.StringType()), ("device_type", T.StringType()), ("session_length_sec", T.LongType()), ("channel", T.StringType()),
    ("category", T.StringType()), ("raw_text", T.StringType()), ("resolution_status", T.StringType()), ("platform", T.StringType()), ("consent_flag", T.BooleanType()),
)])
ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_time", T.TimestampType()), T.StructField("ingestion_time", T.TimestampType()), T.StructField("customer_id", T.StringType()),
    T.StructField("account_id", T.StringType()), T.StructField("source_system", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("schema_version", T.StringType()), T.StructField("payload", PAYLOAD),
])
FIELDS = tuple(f.name for f in ENVELOPE)


def reject_reason(payload: bool = True, keys: Column | None = None) -> Column:
    """The first rule that an envelope breaks, null if it is valid; ``keys`` are the raw object's names."""
    allowed = F.create_map(*[x for s, ts in EVENT_TYPES.items() for x in (F.lit(s), F.array(*map(F.lit, ts)))])
    types = F.try_element_at(allowed, F.col("source_system"))
    rules = [
        (F.coalesce(F.length("event_id"), F.lit(0)) == 0, "event_id"),
        (F.col("event_time").isNull(), "event_time"),
        (F.coalesce(F.length("customer_id"), F.lit(0)) == 0, "customer_id"),
        (types.isNull(), "source_system"),
        (~F.coalesce(F.array_contains(types, F.col("event_type")), F.lit(False)), "event_type"),
    ]
    if keys is not None:
        rules.insert(0, (F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "extra_field"))
    if payload:
        amount, source = F.col("payload.amount"), F.col("source_system")
        rules += [
            (source.isin("card_payments", "instant_payments", "ach_wire") & (amount.isNull() | (amount < 0)), "amount"),
            (source.isin("instant_payments", "ach_wire") & F.col("payload.direction").isNull(), "direction"),
            ((source == "core_banking_ledger") & amount.isNull(), "amount"),
            ((source == "social_signal_consented") & F.col("payload.consent_flag").isNull(), "consent_flag"),
            (F.coalesce(F.col("payload.session_length_sec") < 0, F.lit(False)), "session_length_sec"),
        ]
    out = F.lit(None).cast("string")
    for broken, name in reversed(rules):
        out = F.when(broken, name).otherwise(out)
    return out


def parse_events(raw: DataFrame, col: str = "value", validate: str = "full") -> DataFrame:
    """JSON strings or bytes to envelopes with ``reject_reason``; ``validate`` is ``envelope`` or ``full``."""
    text = F.col(col).cast("string")
    parsed = raw.withColumn("__e", F.from_json(text, ENVELOPE)).withColumn("__k", F.json_object_keys(text))
    flat = parsed.select(*[c for c in raw.columns], *[F.col(f"__e.{f}").alias(f) for f in FIELDS], "__k")
    flat = flat.withColumn("schema_version", F.coalesce("schema_version", F.lit("1.0")))
    return flat.withColumn("reject_reason", reject_reason(validate == "full", F.col("__k"))).drop("__k")


def serialise_event() -> Column:
    """Canonical JSON: keys in order, nulls left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(FIELDS)]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})


def is_late() -> Column:
    return F.coalesce(F.col("ingestion_time") > F.col("event_time"), F.lit(False))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of every line of a path's text files, lines counted from 1 in each file.

    A large file is read in blocks. A line's number is its place in the block,
    which the scan's running id gives, after the lines of the blocks before it:
    one row a block.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    blocks = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_lines(spark: SparkSession, path: str, validate: str = "full") -> DataFrame:
    """Event lines of a path as envelopes with ``file``, ``line`` and ``reject_reason``; blank lines are skipped.

    A line that is no JSON object is rejected as ``json``, others by the field that is wrong.
    """
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = parse_events(rows, "value", validate)
    broken = F.json_object_keys("value").isNull()
    return parsed.withColumn("reject_reason", F.when(broken, "json").otherwise(F.col("reject_reason")))


def rejects(lines: DataFrame) -> DataFrame:
    """``place`` (``path:line``), ``reason`` and ``value`` of the lines of ``read_lines`` that are no valid event."""
    bad = lines.where("reject_reason is not null")
    return bad.select(F.concat_ws(":", "file", F.col("line").cast("string")).alias("place"), F.col("reject_reason").alias("reason"), "value")


def read_jsonl(spark: SparkSession, path: str, validate: str = "envelope") -> DataFrame:
    """The events of a path's lines; blank lines are skipped, and the first invalid line is named in the error (``path:line``)."""
    lines = read_lines(spark, path, validate)
    first = rejects(lines).orderBy(F.length("place"), "place").first()
    if first:
        raise ValueError(f"{first['place']}: invalid event: {first['reason']}")
    return lines.select(*FIELDS)


#: Folders below a dataset's root that hold scenarios: given ones first, generated ones after.
BASES = ("dataset", "scenarios")


def _folders(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """``(name, path)`` of the scenario folders below a root, through Hadoop's file systems."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    bases = [b for b in (f"{root}/{x}" for x in BASES) if files.exists(hadoop.Path(b))] or [root]
    found = []
    for base in bases:
        names = sorted(f.getPath().getName() for f in files.listStatus(hadoop.Path(base)) if f.isDirectory())
        found += [(n, f"{base}/{n}") for n in names]
    return found


def available_scenarios(spark: SparkSession, root: str) -> list[str]:
    """Names of the scenario folders of ``root``: those of ``dataset`` and then of ``scenarios``, or, without these, its own."""
    return [name for name, _ in _folders(spark, root)]


def load_scenario(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame | str | None]:
    """One scenario: ``history``, ``live``, ``entities`` and ``replay_config`` as tables, ``ground_truth`` (a table) and ``instructions`` (a text) or None.

    Tables carry ``scenario_id``, the entities' own or the folder's name. An
    unknown name raises a ``LookupError``, an invalid event line a ``ValueError``
    that names it.
    """
    at = dict(reversed(_folders(spark, root))).get(name)
    if at is None:
        raise LookupError(f"scenario {name!r} not found under {root}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda f: files.exists(hadoop.Path(f"{at}/{f}"))
    entities = spark.read.option("multiLine", True).json(f"{at}/entities.json")
    scenario = entities.select("scenario_id").first()[0] if "scenario_id" in entities.columns else None
    tag = lambda df: df.withColumn("scenario_id", F.lit(scenario or name))
    read = lambda f: tag(spark.read.option("multiLine", True).json(f"{at}/{f}.json"))
    return {
        "history": tag(read_jsonl(spark, f"{at}/history_seed.jsonl")),
        "live": tag(read_jsonl(spark, f"{at}/live_stream.jsonl")),
        "entities": tag(entities),
        "replay_config": read("replay_config") if there("replay_config.json") else None,
        "ground_truth": read("ground_truth") if there("ground_truth.json") else None,
        "instructions": spark.read.text(f"{at}/instructions.md", wholetext=True).first()[0] if there("instructions.md") else None,
    }


def in_order(events: DataFrame) -> DataFrame:
    """A live stream by event time, ties in order of arrival."""
    return events.orderBy("t", "arrival_seq")


def memory_sink(events: DataFrame, name: str) -> DataFrame:
    """A stream drained into a table that this session knows by name, or a batch registered under it.

    The rows stand in the shared folder and are written by the tasks that have
    them: Spark's own memory sink gathers every row in the driver.
    """
    if not events.isStreaming:
        events.createOrReplaceTempView(name)
        return events.sparkSession.table(name)
    spark = events.sparkSession
    at = fresh(spark, "sink")
    query = events.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    spark.read.schema(events.schema).parquet(f"{at}/out").createOrReplaceTempView(name)
    return spark.table(name)


def paced(spark: SparkSession, path: str, schema: T.StructType, files: int = 1) -> DataFrame:
    """A stream of the event files of a folder, so many a trigger: the trigger's interval is the pace."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def write_checkpoints(df: DataFrame, path: str) -> None:
    """The final checkpoints (a few rows a scenario) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def kafka_rows(events: DataFrame) -> DataFrame:
    """Key and value of the Kafka sink: keyed by customer, canonical JSON."""
    return events.select(F.col("customer_id").cast("binary").alias("key"), serialise_event().cast("binary").alias("value"))


def write_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """Needs Spark's Kafka connector on the class path."""
    (kafka_rows(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.retries", "3").save())


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Streaming envelopes of a topic."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_events(raw.select("key", "value"), "value", "envelope")


def with_trace(events: DataFrame, trace: Column) -> DataFrame:
    """Messages that carry a trace beside the envelope."""
    return events.select(F.struct(*FIELDS).alias("envelope"), trace.alias("trace"))


def generate_scenario(spark: SparkSession, archetype: str, n: int, start: str = "2026-05-01 09:00:00") -> DataFrame:
    """``n`` hourly events with distinct ids of one of four archetypes."""
    plan = {
        "fraud_like": (("card_payments", "decline"), ("ach_wire", "outbound_transfer"), ("loan_kyc", "address_change")),
        "ambiguous": (("web_app_events", "login"), ("core_banking_ledger", "withdrawal")),
        "conflicting_signals": (("core_banking_ledger", "withdrawal"), ("web_app_events", "search_query"), ("support_logs", "ticket_created")),
        "no_action_stable": (("core_banking_ledger", "deposit"), ("web_app_events", "login")),
    }[archetype]
    kinds = F.array(*[F.struct(F.lit(s).alias("source_system"), F.lit(t).alias("event_type")) for s, t in plan])
    rows = spark.range(n).withColumn("k", F.get(kinds, (F.col("id") % len(plan)).cast("int")))
    at = F.expr(f"timestamp '{start}'") + F.make_dt_interval(hours=F.col("id").cast("int"))
    return rows.select(F.format_string(f"{archetype}_%06d", "id").alias("event_id"), at.alias("event_time"), F.lit("CUST_90001").alias("customer_id"), "k.source_system", "k.event_type", (F.lit(100.0) + F.col("id") % 7 * 50).alias("amount"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's event table as envelopes; ``t`` and ``it`` are event and ingestion time in microseconds UTC.

    Every 11th event happened 20 minutes before its row says and every 97th two
    days before, so arrivals are out of order; sources and types rotate.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    back = F.when(n % 97 == 0, 2 * 86_400_000_000).when(n % 11 == 0, 1_200_000_000).otherwise(0)
    types = F.lit(None).cast("string")
    for k, names in enumerate(EVENT_TYPES.values()):
        types = F.when(n % 9 == k, F.get(F.array(*map(F.lit, names)), (F.floor(n / 9) % len(names)).cast("int"))).otherwise(types)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        n.alias("arrival_seq"), F.concat(F.lit("EVT_"), n.cast("string")).alias("event_id"), (at - back).alias("t"), at.alias("it"),
        F.concat(F.lit("CUST_"), F.col("user_id").cast("string")).alias("customer_id"), F.get(F.array(*map(F.lit, SOURCES)), (n % 9).cast("int")).alias("source_system"),
        types.alias("event_type"), F.floor(F.col("value") * 100).cast("double").alias("amount"), F.get(F.array(*map(F.lit, CATEGORIES)), (F.floor(n / 27) % 4).cast("int")).alias("category"),
    )
