"""Clickstream inputs derived from the given ``events`` table.

The table has no visitors, duplicates, contracts and so on; fixed rules add them.
``oracle.py`` states the same rules in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.times import plus_seconds
from eventloom.operators.validate import IDENTIFY
from eventloom.sources.contracts import parse_contracts
from eventloom.workspace import prepare_session

# User agents, by source id modulo 8; the eighth is missing.
USER_AGENTS = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0 Safari/537.36 Edg/120.0",
    "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 Version/17.0 Safari/605.1.15",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 Chrome/120.0 Mobile Safari/537.36",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 Mobile/15E148 Safari/604.1",
    "Opera/9.80 (Android tablet) Presto/2.12 Version/12.16",
)

CONTRACTS = (
    (
        "app0",
        '{"appId":"app0","version":2,"extra":1,"events":{"purchase":{"fields":['
        '{"name":"orderId","type":"string","required":true},'
        '{"name":"amount","type":"number","required":true},'
        '{"name":"coupon","type":"string","required":false}]},'
        '"page_view":{"fields":[]},"click":{"fields":[]},"scroll":{}}}',
    ),
    ("app0", '{"appId":"app0","version":1,"events":{}}'),
    ("app1", "{not json"),
    (
        "app2",
        '{"appId":"app2","version":1,"events":{"purchase":{"fields":['
        '{"name":"amount","type":"Integer","required":true},'
        '{"name":"email","type":"string","required":true},'
        '{"name":"tags","type":"array","required":false}]},'
        '"scroll":{"fields":[{"name":"phone","type":"number","required":false},'
        '{"name":"vip","type":"boolean","required":true}]},'
        '"page_view":{"fields":[]},"click":{"fields":[]},"exposure":{"fields":null}}}',
    ),
    (" ", '{"appId":"blank"}'),
)


def contracts(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(app).alias("app_code"), F.lit(text).alias("contract_json")) for app, text in CONTRACTS]
    return parse_contracts(spark.range(1).select(F.inline(F.array(*rows))))


def _user_agent(src: Column) -> Column:
    agents = F.array(*[F.lit(agent) for agent in USER_AGENTS], F.lit(None).cast("string"))
    return F.element_at(agents, (src % 8 + 1).cast("int"))


def _custom(k: Column, value: Column, uid: Column) -> Column:
    order = F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit('"orderId":"O'), k, F.lit('",')))
    amount = F.when(k % 10 == 1, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value.cast("string"))
    phone = F.concat(F.lit("1380000"), F.lpad((uid % 10_000).cast("string"), 4, "0"))
    return F.concat(
        F.lit("{"),
        order,
        F.lit('"amount":'),
        amount,
        F.lit(',"email":"u'),
        uid,
        F.lit('@example.com","phone":"'),
        phone,
        F.lit('","vip":'),
        F.when(k % 4 == 0, F.lit("null")).otherwise((k % 2 == 0).cast("string")),
        F.lit("}"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Flat events, batch or streaming. Some views and clicks are sent twice, 60 or
    400 seconds apart; one scan makes both copies."""
    src, uid, value = F.col("src"), F.col("uid"), F.col("value")
    base = source.select(
        F.col("event_id").alias("src"),
        F.col("event_type").alias("src_type"),
        F.col("user_id").alias("uid"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.date_trunc("millisecond", F.col("ts").cast("timestamp")).alias("ts0"),
    )
    resent = (src % 10 == 0) & F.col("src_type").isin("view", "click")
    copies = base.withColumn("copy", F.explode(F.when(resent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    k, first = F.col("k"), F.col("copy") == 0
    event_type = (
        F.when(F.col("src_type") == "view", "page_view")
        .when(F.col("src_type") == "click", "click")
        .when(F.col("src_type") == "signup", IDENTIFY)
        .when(F.col("src_type") == "purchase", "purchase")
        .when(src % 2 == 0, "exposure")
        .otherwise("scroll")
    )
    delay = F.when(first, 0).when(src % 20 == 0, 400).otherwise(60)
    return copies.select(
        F.concat(F.lit("evt_"), src).alias("event_id"),
        event_type.alias("event_type"),
        F.when(~(first & (F.col("src_type") != "signup") & (src % 3 == 0)), F.concat(F.lit("u"), uid)).alias("user_id"),
        F.concat(F.lit("a"), uid).alias("anonymous_id"),
        F.concat(F.lit("app"), uid % 3).alias("app_code"),
        plus_seconds(F.col("ts0"), delay).alias("timestamp"),
        (~first | (src % 7 != 0)).alias("consent"),
        F.concat(F.lit("/p/"), k % 10).alias("page_url"),
        F.when(first & (F.col("src_type") == "error") & (src % 2 == 1), k).alias("scroll_depth"),
        F.when(first & (F.col("src_type") == "view"), F.floor(value * 1000)).cast("long").alias("stay_duration"),
        (src + F.col("copy") * 1_000_000_000).alias("seq"),
        F.when(k % 3 == 0, "google").when(k % 3 == 1, "mail").alias("utm_source"),
        F.when(k % 3 == 0, "cpc").alias("utm_medium"),
        _user_agent(src).alias("user_agent"),
        _custom(k, value, uid).alias("custom"),
        src.alias("src"),
        k.alias("k"),
        F.col("copy"),
    )


def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events. A table that is less than one split per core is dealt out, or
    all that is derived from it would be the work of a single task; a larger one is read
    as it lies."""
    events = prepare_session(spark).read.parquet(f"{sf_dir}/events.parquet")
    cores = spark.sparkContext.defaultParallelism
    return events.repartition(cores) if events.rdd.getNumPartitions() < cores else events


def stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a stream of files."""
    schema = prepare_session(spark).read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(source_events(spark, sf_dir))


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without identify events, which are control messages."""
    return all_events(spark, sf_dir).where(F.col("event_type") != IDENTIFY)


def shared_device(events: DataFrame) -> DataFrame:
    """Two users take turns on each visitor id."""
    second = F.when(F.col("k") >= 50, F.concat("user_id", F.lit("b"))).otherwise(F.col("user_id"))
    return events.withColumn("user_id", second)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested events as clients send them, some of them incomplete."""
    flat = all_events(spark, sf_dir)
    src, first = F.col("src"), F.col("copy") == 0
    null = F.lit(None).cast("string")
    blank_user = (F.col("event_type") == IDENTIFY) & (src % 5 == 0)
    return flat.select(
        F.when(~(first & (src % 97 == 0)), F.col("event_id")).alias("eventId"),
        F.when(first & (src % 101 == 0), F.lit("")).otherwise(F.col("event_type")).alias("eventType"),
        F.when(blank_user, F.lit("  ")).otherwise(F.col("user_id")).alias("userId"),
        F.col("anonymous_id").alias("anonymousId"),
        F.when(~(first & (src % 103 == 0)), F.unix_millis("timestamp")).alias("timestamp"),
        F.when(src % 2 == 0, F.unix_millis("timestamp") - 250).alias("clientTime"),
        F.lit("web").alias("platform"),
        null.alias("appVersion"),
        F.lit("1.2.0").alias("sdkVersion"),
        "consent",
        F.when(F.col("k") < 90, F.struct(F.col("page_url").alias("url"), null.alias("title"), null.alias("referrer"))).alias("page"),
        F.struct(null.alias("sessionId"), F.lit(None).cast("long").alias("startTime")).alias("session"),
        F.when(
            F.col("k") % 7 != 0,
            F.struct(
                F.col("user_agent").alias("userAgent"),
                F.when(F.col("k") % 2 == 0, F.lit(1920)).alias("screenWidth"),
                F.when(F.col("k") % 2 == 0, F.lit(1080)).alias("screenHeight"),
                F.lit("en").alias("language"),
            ),
        ).alias("device"),
        F.struct(
            F.col("utm_source").alias("utmSource"),
            F.col("utm_medium").alias("utmMedium"),
            null.alias("utmCampaign"),
            null.alias("utmTerm"),
            null.alias("utmContent"),
        ).alias("context"),
        F.struct(
            F.col("scroll_depth").alias("scrollDepth"),
            F.col("stay_duration").alias("stayDuration"),
            null.alias("elementId"),
            null.alias("elementType"),
            null.alias("elementText"),
            F.when(F.col("event_type") == "click", F.col("k")).alias("clickX"),
            F.lit(None).cast("int").alias("clickY"),
            F.lit(None).cast("long").alias("exposureDuration"),
            F.lit(None).cast("double").alias("exposureRatio"),
            F.when(F.col("k") % 25 != 24, F.col("custom")).alias("custom"),
        ).alias("data"),
        "app_code",
        "seq",
    )


def dead_letter_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dead-letter table: every behaviour event failed once, resent ones twice."""
    events = behaviour(spark, sf_dir)
    k = F.col("k")
    retry = F.when(F.col("copy") == 0, k % 12).otherwise(F.lit(0))
    payload = ("event_id", "event_type", "user_id", "anonymous_id", "app_code", "timestamp", "page_url")
    text = F.to_json(F.struct(*payload, F.col("custom").alias("properties")))
    failed = F.col("timestamp")
    back_off = plus_seconds(failed, F.pow(F.lit(2.0), F.least(retry, F.lit(10))).cast("long"))
    return events.select(
        "event_id",
        "event_type",
        "user_id",
        F.when(k % 17 == 0, F.lit("{broken")).when(k % 19 == 0, F.lit(None)).otherwise(text).alias("event_json"),
        F.when(k % 3 == 0, "validation_failed").when(k % 3 == 1, "schema_violation").otherwise("collection_failed").alias("reason"),
        failed.alias("failed_at"),
        retry.cast("int").alias("retry_count"),
        F.when(k % 13 != 0, back_off).alias("next_retry_at"),
        failed.alias("updated_at"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of an hour at the same instant, to make bursts."""
    return behaviour(spark, sf_dir).select(
        "app_code",
        F.date_trunc("hour", "timestamp").alias("timestamp"),
        F.lpad(F.col("seq").cast("string"), 12, "0").alias("event_id"),
        "seq",
    )


ENFORCE = EngineConfig(contract_mode="enforce")
