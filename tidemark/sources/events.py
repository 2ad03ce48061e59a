"""Event envelopes: schema, check, deterministic ids, topics and ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType()),
    T.StructField("schema_version", T.IntegerType()), T.StructField("occurred_at", T.StringType()),
    T.StructField("partition_key", T.StringType()), T.StructField("producer", T.StringType()),
    T.StructField("payload", T.MapType(T.StringType(), T.StringType())),
    T.StructField("trace_id", T.StringType()), T.StructField("correlation_id", T.StringType()),
    T.StructField("causation_id", T.StringType()),
])
REQUIRED = ("event_id", "event_type", "occurred_at", "partition_key", "producer")

# Event types, and the name space of URL UUIDs (RFC 4122).
BAR_CLOSED, COMMAND, EVALUATE, INTENT, FILL = (
    "market.bar.closed.v1", "strategy.command.v1", "strategy.evaluation.batch.v1", "order.intent.v1", "order.fill.v1")
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Topic:
    name: str
    partitions: int
    retention_ms: int


def topics(market: int = 6, strategy: int = 12, order: int = 12, dead: int = 3) -> dict[str, Topic]:
    """Topic of each event type; unknown and broken events go to ``dead``."""
    return {
        BAR_CLOSED: Topic("market.bar.closed", market, 3 * DAY_MS),
        COMMAND: Topic("strategy.lifecycle", strategy, 7 * DAY_MS),
        EVALUATE: Topic("strategy.evaluate", strategy, 3 * DAY_MS),
        INTENT: Topic("order.intent", order, 30 * DAY_MS),
        FILL: Topic("order.event", order, 30 * DAY_MS),
        "dead": Topic("runtime.dead", dead, 30 * DAY_MS),
    }


def decode(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse envelopes and add ``fault`` (null when the envelope is good)."""
    df = df.withColumn("e", F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"}))
    e = lambda n: F.col(f"e.{n}")
    empty = F.coalesce(*[F.when(F.coalesce(F.trim(e(n)), F.lit("")) == "", n) for n in REQUIRED])
    fault = (
        F.when(F.col("e").isNull() | F.try_parse_json(value).isNull(), "json")
        .when(empty.isNotNull(), F.concat(F.lit("missing "), empty))
        .when(F.coalesce(e("schema_version"), F.lit(0)) <= 0, "schema_version")
        .when(F.try_to_timestamp(e("occurred_at")).isNull(), "occurred_at")
        .when(F.col("e.payload").isNull(), "payload"))
    return df.withColumn("fault", fault)


def part(c: Column) -> Column:
    return F.lower(F.trim(c))


def bar_key(venue, market, market_type, instrument, timeframe) -> Column:
    return F.concat_ws(":", F.lit("bar"), *[part(x) for x in (venue, market, market_type, instrument, timeframe)])


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """Name-based UUID (version 5): SHA-1 of the name space and the name."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
                       F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def bar_event_id(key: Column, token: Column) -> Column:
    return uuid5(F.concat(key, F.lit(":"), token.cast("string")))


def envelope_json(**fields: Column) -> Column:
    """Canonical text: fields in alphabetical order."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def route(df: DataFrame, kinds: dict[str, Topic] | None = None) -> DataFrame:
    """Kafka sink rows (key, value, topic); faulty events go to the dead letter topic."""
    kinds = kinds or topics()
    topic = F.lit(kinds["dead"].name)
    for kind, t in kinds.items():
        if kind != "dead":
            topic = F.when(F.col("fault").isNull() & (F.col("e.event_type") == kind), t.name).otherwise(topic)
    return df.select(F.col("e.partition_key").alias("key"), "value", topic.alias("topic"), "fault")


def kafka_stream(spark: SparkSession, servers: str, names, **options) -> DataFrame:
    """Raw stream of topics; needs the Kafka connector on the class path."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(names)).options(**options).load()
            .select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp"))


def kafka_sink(df: DataFrame, servers: str, checkpoint: str, **options):
    return (df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("checkpointLocation", checkpoint).options(**options))


def ledger(spark: SparkSession, *, url: str | None = None, path: str | None = None, table: str,
           column: str | None = None, low=None, high=None, parts: int = 32, **options) -> DataFrame:
    """A ledger table: parquet under ``path``, or JDBC read in ``parts`` ranges of ``column``."""
    if path is not None:
        return spark.read.parquet(f"{path}/{table}.parquet")
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if column:
        r = (r.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high)
             .option("numPartitions", parts))
    return r.load()


def parse_results(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """JSON results to typed columns; rows that are not JSON objects are dropped."""
    ok = F.try_parse_json(raw).isNotNull() & F.col(raw).rlike(r"^\s*\{")
    return df.where(ok).withColumn("r", F.from_json(raw, schema)).where("r IS NOT NULL")
