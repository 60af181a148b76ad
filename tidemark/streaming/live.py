"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import DAY
from tidemark.operators.features import SPECS, of_kind
from tidemark.plans.storage import fresh
from tidemark.streaming.batch import LATENESS, OUT_OF_ORDER, baseline_writeback, classify, late_recompute


def dedup_stream(events: DataFrame, within: str | None = None) -> DataFrame:
    """First arrivals by customer and event; ``within`` bounds the state by a watermark on ``event_time``."""
    if within is None:
        return events.dropDuplicates(["customer_id", "event_id"])
    return events.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["customer_id", "event_id"])


def daily_counts(events: DataFrame, lateness: str = "900 seconds") -> DataFrame:
    """Counts of each default feature's events a day and customer, closed by the watermark."""
    timed = events.withWatermark("event_time", lateness)
    return timed.groupBy(F.window("event_time", "1 day"), "customer_id").agg(*[F.count_if(of_kind(s)).alias(s.name) for s in SPECS])


EVENT = "event_id string, customer_id string, source_system string, event_type string, amount double, t long, arrival_seq long"


class LateTables:
    """Lateness, recomputed features and their writeback over a stream, below one folder.

    Each micro-batch is classified as a batch, in runs of arrivals, from the
    sources' maxima before it: a row a source, which the batch before left.
    Accepted events are kept by the day of their time. Features of late rows are
    then recomputed over the customer's accepted events up to their arrival, as
    of the latest event accepted by the end of the micro-batch; only days that a
    window can reach and customers with late rows are read again. A batch writes
    into folders named by its number, so one that is run again after a stop
    replaces what it had written. Arrivals must not go back in order from one
    micro-batch to the next.
    """

    def __init__(self, spark: SparkSession, path: str, lateness: int = LATENESS, slack: int = OUT_OF_ORDER, specs=SPECS) -> None:
        self.spark, self.path, self.lateness, self.slack, self.specs = spark, path, lateness, slack, specs

    def _step(self, batch: DataFrame, number: int) -> None:
        spark, at = self.spark, self.path
        names = [c.split()[0] for c in EVENT.split(", ")]
        marks = spark.createDataFrame([], "source_system string, top long")
        if number:
            marks = spark.read.schema(marks.schema).parquet(f"{at}/marks/{number - 1}")
        rows = classify(batch.select(*names), self.lateness, self.slack, marks)
        rows.select(*names, "outcome").write.mode("overwrite").parquet(f"{at}/rows/{number}")
        rows = spark.read.schema(f"{EVENT}, outcome string").parquet(f"{at}/rows/{number}")
        taken = rows.where("outcome <> 'too_late_dropped'")
        taken.select(*names, F.floor(F.col("t") / DAY).alias("day")).write.mode("overwrite").partitionBy("day").parquet(f"{at}/accepted/{number}")
        tops = rows.select("source_system", F.col("t").alias("top")).union(marks).groupBy("source_system").agg(F.max("top").alias("top"))
        tops.coalesce(1).write.mode("overwrite").parquet(f"{at}/marks/{number}")  # a row a source
        horizon = spark.read.schema("source_system string, top long").parquet(f"{at}/marks/{number}").agg(F.max("top")).first()[0]
        late = taken.where("outcome = 'late_recomputed'")
        if horizon is None:
            return
        first = (horizon - int(max(s.days for s in self.specs) * DAY)) // DAY
        known = [self._accepted(k).where(F.col("day") >= first) for k in range(number)]
        mine = late.select("customer_id").distinct()
        before = [k.drop("day").withColumn("outcome", F.lit("emitted")).join(mine, "customer_id", "left_semi").select(*names, "outcome") for k in known]
        history = reduce(DataFrame.union, before, taken.join(mine, "customer_id", "left_semi").select(*names, "outcome"))
        out = late_recompute(history, self.specs, F.lit(horizon))
        out = out.join(late.select(F.col("event_id").alias("late_id"), F.col("arrival_seq").alias("seq")), "late_id")
        out.write.mode("overwrite").parquet(f"{at}/features/{number}")

    def _accepted(self, number: int) -> DataFrame:
        return self.spark.read.schema(f"{EVENT}, day long").parquet(f"{self.path}/accepted/{number}")

    def start(self, events: DataFrame) -> StreamingQuery:
        """Starts a drained query over a stream of ``EVENT`` rows."""
        return events.writeStream.foreachBatch(self._step).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start()

    def outcomes(self) -> DataFrame:
        return self.spark.read.schema(f"{EVENT}, outcome string").parquet(f"{self.path}/rows/*")

    def features(self) -> DataFrame:
        """``customer_id, late_id, seq`` and the features of every late row."""
        schema = "customer_id string, late_id string, seq long, " + ", ".join(f"{s.name} double" for s in self.specs)
        return self.spark.read.schema(schema).parquet(f"{self.path}/features/*")

    def writeback(self) -> DataFrame:
        """What the late rows write to the state, a later one over an earlier."""
        return baseline_writeback(self.features(), self.specs)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append", once: bool = False) -> DataFrame:
    """Drains a stream into Parquet in the shared folder and reads it back.

    One with timers of processing time never runs dry; ``once`` takes what is there as one micro-batch.
    """
    at = fresh(spark, name)
    when = {"once": True} if once else {"availableNow": True}
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").outputMode(mode).trigger(**when).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
