"""Order events: publish as JSON, read a topic or a folder, decode, clean, append exactly once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

TOPIC = "orders"
COMPRESSION = 60 * 24 * 30  # one real minute stands for thirty days of history
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
BAD = "_bad"


def to_events(df: DataFrame, key: str) -> DataFrame:
    """Rows as messages: key and a JSON value holding every column."""
    payload = F.to_json(F.struct(*df.columns), {"timestampFormat": TIME_FORMAT, "ignoreNullFields": "false"})
    return df.select(F.col(key).cast("string").alias("key"), payload.alias("value"))


def replayed(df: DataFrame, when: str, start: datetime, ratio: int = COMPRESSION) -> DataFrame:
    """df plus event_timestamp: the history compressed by `ratio`, counted from `start`."""
    first = df.agg(F.min(F.unix_micros(when)).alias("__first"))
    offset = F.expr(f"(unix_micros({when}) - __first) div {ratio}")
    return (
        df.crossJoin(F.broadcast(first))  # one row
        .withColumn("event_timestamp", F.timestamp_micros(F.unix_micros(F.lit(start)) + offset))
        .drop("__first")
    )


def topic(spark: SparkSession, servers: str, name: str = TOPIC) -> DataFrame:
    """Messages of a topic from the earliest offset on. Needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("subscribe", name)
        .option("startingOffsets", "earliest")
        .load().select(F.col("value").cast("string").alias("value"))
    )


def publish(events: DataFrame, servers: str, name: str = TOPIC) -> None:
    """Send key/value rows to a topic. Needs the Kafka connector on the class path."""
    events.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", name).save()


def text_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The same messages from files, one JSON text per line."""
    return spark.readStream.schema("value string").text(folder)


def _without_nan(name: str, dtype: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value).alias(name)
    if isinstance(dtype, T.StringType):
        return F.when(value != '"NaN"', value).alias(name)  # a bare token arrives in quotes, a text without
    return value.alias(name)


def decode(messages: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema with NaN as NULL, and `_bad`: the text of a message that is no such JSON."""
    with_bad = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "timestampFormat": TIME_FORMAT}
    text = messages.select(F.col("value").alias("__text"))
    parsed = text.select("__text", F.from_json("__text", with_bad, options).alias("m")).select("__text", "m.*")
    return parsed.select(
        *[_without_nan(f.name, f.dataType) for f in schema.fields],
        F.coalesce(BAD, F.when(F.col("__text").isNull(), "")).alias(BAD),
    )


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(BAD).isNull()).drop(BAD)


def rejected(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(BAD).isNotNull()).select(F.col(BAD).alias("value"))


def append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once. With available_now it stops when it has caught up."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)


def load(messages: DataFrame, schema: T.StructType, target: str, dead_letters: str, checkpoint: str) -> None:
    """Catch up once: good events to `target`, unreadable messages to `dead_letters`."""
    decoded = decode(messages, schema)
    running = [
        append(accepted(decoded), target, f"{checkpoint}/events"),
        append(rejected(decoded), dead_letters, f"{checkpoint}/rejected"),
    ]
    for query in running:
        query.awaitTermination()
