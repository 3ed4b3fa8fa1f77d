"""Request logs and pacing as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docketry.functions.records import non_green
from docketry.operators.pacing import next_slot, paced

SLOTS = "service string, seq long, slot_us long"


def log_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New files of JSON lines under ``path``."""
    return spark.readStream.schema(schema).json(path)


def usage_by_window(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and warnings by window and kind; a line later than the watermark is left out."""
    timed = log.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(non_green(F.col("throttling"))).alias("non_green")).select("window.start", "kind", "n", "non_green")


class _Pacer(StatefulProcessor):
    """Keeps each service's last slot; rows of a batch are taken by sequence number."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "slot_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq")
        state = self.last.get() if self.last.exists() else None
        last, out = (state[0] if state else None), []
        for seq, at, ready, step in zip(batch["seq"], batch["at_us"], batch["ready_us"], batch["step_us"], strict=True):
            last = next_slot(last, int(at), int(ready), int(step))
            out.append((key[0], int(seq), last))
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["service", "seq", "slot_us"])

    def close(self) -> None:
        pass


def pacing_stream(arrivals: DataFrame) -> DataFrame:
    """Slots of ``service, seq, at_us, interval_us`` and the optional columns of ``paced``, one after another for each service."""
    return paced(arrivals).groupBy("service").transformWithStateInPandas(statefulProcessor=_Pacer(), outputStructType=SLOTS, outputMode="Append", timeMode="None")
