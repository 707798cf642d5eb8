"""Live baskets: the fold of the event log as stream state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import baskets as batch

MOST = 99
LINE = StructType([StructField("quantity", LongType()), StructField("unit_price", LongType()), StructField("added_seq", LongType())])
HEAD = StructType([StructField("last_seq", LongType()), StructField("closed_seq", LongType()), StructField("late", LongType())])
OUT = "basket_id string, variant_id string, quantity long, unit_price long, added_seq long, status string, late long"


class Baskets(StatefulProcessor):
    """One basket's lines as a map, and a header with its last event, its closing and how many events came too late.

    Rows of a key come in several chunks without order, so a batch's are gathered and
    sorted by seq first. An event that isn't newer than the last one applied is
    dropped and counted.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", HEAD)
        self.lines = handle.getMapState("lines", StructType([StructField("variant_id", StringType())]), LINE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        last, closed, late = self.head.get() if self.head.exists() else (-1, None, 0)
        for e in events.itertuples(index=False):
            if e.seq <= last:
                late += 1
                continue
            last = e.seq
            if closed is not None:
                continue
            self._apply(e)
            if e.op == "checkout" and e.mark and any(True for _ in self.lines.keys()):
                closed = e.seq
        self.head.update((int(last), None if closed is None else int(closed), int(late)))
        status = "active" if closed is None else "checked_out"
        now = [(key[0], v[0], x[0], x[1], x[2], status, late) for v, x in self.lines.iterator()]
        yield pd.DataFrame(now or [(key[0], None, 0, 0, 0, status, late)], columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        """Takes over a basket from a batch fold, as handover() gives it: its lines, last event and closing."""
        for r in initialState.itertuples(index=False):
            if r.variant_id is not None:
                self.lines.updateValue((r.variant_id,), (int(r.quantity), int(r.unit_price), int(r.added_seq)))
            self.head.update((int(r.last_seq), None if pd.isna(r.closed_seq) else int(r.closed_seq), 0))

    def _apply(self, e: Any) -> None:
        name = (e.variant_id,)
        quantity = None if pd.isna(e.quantity) else int(e.quantity)
        if e.op == "add":
            if quantity is not None and quantity <= 0:
                return
            more = min(MOST, max(1, 1 if quantity is None else quantity))
            old = self.lines.getValue(name) if self.lines.containsKey(name) else (0, 0, int(e.seq))
            self.lines.updateValue(name, (int(old[0]) + more, int(e.unit_price), int(old[2])))
        elif e.op == "clear":
            for v in [k[0] for k in self.lines.keys()]:
                self.lines.removeKey((v,))
        elif e.op in ("set", "remove") and self.lines.containsKey(name):
            if e.op == "remove" or quantity is None or quantity <= 0:
                self.lines.removeKey(name)
            else:
                old = self.lines.getValue(name)
                self.lines.updateValue(name, (min(MOST, quantity), int(old[1]), int(old[2])))

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors keep their maps in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def handover(events: DataFrame) -> DataFrame:
    """(basket_id, variant_id, quantity, unit_price, added_seq, last_seq, closed_seq): the batch fold of a log so far, from which a stream can go on; a basket without lines is one row."""
    heads = events.groupBy("basket_id").agg(F.max("seq").alias("last_seq")).join(batch.closings(events), "basket_id", "left")
    lines = batch.fold_baskets(events).select("basket_id", "variant_id", *[F.col(c).cast("long").alias(c) for c in ("quantity", "unit_price", "added_seq")])
    return heads.join(lines, "basket_id", "left").select("basket_id", "variant_id", "quantity", "unit_price", "added_seq", F.col("last_seq").cast("long").alias("last_seq"), F.col("closed_seq").cast("long").alias("closed_seq"))


def stream_baskets(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """The lines of each basket that a micro-batch has touched (basket_id, seq, op, variant_id, quantity, unit_price, mark in); an empty basket gives one row without a variant.

    initial: handover() of the log before the stream. Its baskets are taken over in the
    first batch; events that it has seen are late.
    """
    rows = events.select("basket_id", "seq", "op", "variant_id", F.col("quantity").cast("long").alias("quantity"), "unit_price", F.coalesce("mark", F.lit(False)).alias("mark"))
    state = None if initial is None else initial.groupBy("basket_id")
    return rows.groupBy("basket_id").transformWithStateInPandas(statefulProcessor=Baskets(), outputStructType=OUT, outputMode="Update", timeMode="None", initialState=state)
