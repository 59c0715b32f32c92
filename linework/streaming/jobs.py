"""Structured Streaming forms of the polling jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.quotes import QUOTE

CHANGE_SCHEMA = "game_id long, market_type string, player_id string, side string, line double, book string, price int, prev_price int, observed_at timestamp, seq long"


class _Changes(StatefulProcessor):
    """The last price of a quote key; a row for each that differs, in the order of observation."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["observed_at", "seq"])
        known = self.last.get()[0] if self.last.exists() else None
        out = []
        for price, at, seq in batch[["price", "observed_at", "seq"]].itertuples(index=False):
            if price != known:
                out.append((*key, int(price), known, at, int(seq)))
                known = int(price)
        if known is not None:
            self.last.update((known,))
        frame = pd.DataFrame(out, columns=[*QUOTE, "price", "prev_price", "observed_at", "seq"])
        yield frame.astype({"prev_price": "Int32"})

    def close(self) -> None:
        pass


def quote_changes_stream(observed: DataFrame) -> DataFrame:
    """The change log of an observation stream; state is one price for each quote key.

    The session must use the RocksDB state store.
    """
    keyed = observed.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return keyed.groupBy(*QUOTE).transformWithStateInPandas(_Changes(), outputStructType=CHANGE_SCHEMA, outputMode="append", timeMode="none")


def append_once(source: DataFrame, key: str, event_time: str = "knowledge_time", delay: str = "2 days") -> DataFrame:
    """Each (key, knowledge time) once, within the watermark."""
    return source.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key, event_time])


class _Alerts(StatefulProcessor):
    """Whether an alert is firing; a row when that flips."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.firing = handle.getValueState("firing", "firing boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        was = self.firing.get()[0] if self.firing.exists() else False
        out = []
        for at, seq, firing in pd.concat(list(rows)).sort_values(["at", "seq"])[["at", "seq", "firing"]].itertuples(index=False):
            if bool(firing) != was:
                was = bool(firing)
                out.append((key[0], at, int(seq), "broke" if was else "recovered"))
        self.firing.update((was,))
        yield pd.DataFrame(out, columns=["alert_key", "at", "seq", "event"])

    def close(self) -> None:
        pass


def alert_stream(states: DataFrame) -> DataFrame:
    return states.groupBy("alert_key").transformWithStateInPandas(_Alerts(), outputStructType="alert_key string, at timestamp, seq long, event string", outputMode="append", timeMode="none")


def touched_writer(root: str, price: Callable[[DataFrame], DataFrame], current: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that prices again only the games that a batch touches."""

    def write(batch: DataFrame, version: int) -> None:
        touched = current().join(batch.select("game_id").distinct(), "game_id", "left_semi")
        price(touched).write.mode("overwrite").parquet(f"{root}/batch={version}")

    return write


CLOSING_SCHEMA = "game_id long, market_type string, player_id string, side string, line double, book string, price int, at long, seq long, kickoff long"


class _Closing(StatefulProcessor):
    """The last quote of a key up to kickoff, as ``current_quotes`` orders them; a timer at kickoff hands it out once and forgets it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price int, at long, seq long, kickoff long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        best, kickoff = held[:3] if held else None, held[3] if held else None
        for batch in rows:
            for price, at, seq, start in batch[["price", "at", "seq", "kickoff"]].itertuples(index=False):
                if at <= start and (best is None or (at, seq, price) > (*best[1:], best[0])):
                    best, kickoff = (int(price), int(at), int(seq)), int(start)
        if best is not None and (held is None or kickoff != held[3]):
            if held is not None:  # the game was put off
                self.handle.deleteTimer(_millis(held[3]))
            self.handle.registerTimer(_millis(kickoff))
        if best is not None:
            self.last.update((*best, kickoff))
        yield pd.DataFrame([], columns=[*QUOTE, "price", "at", "seq", "kickoff"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield pd.DataFrame([(*key, *self.last.get())], columns=[*QUOTE, "price", "at", "seq", "kickoff"])
            self.last.clear()

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first whole millisecond that is not before."""
    return -(-micros // 1000)


def closing_stream(observed: DataFrame, games: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The closing quote of every key, once, when the watermark passes its game's kickoff.

    Quotes may arrive in any order within ``delay``; what was observed after kickoff never counts, and
    what arrives later than the watermark allows is dropped. ``games`` is read anew by each batch, so a
    kickoff that moves before it is reached moves the timer with the next quote. State is one
    quote for each key of a game that has not begun. The session must use the RocksDB state store.
    """
    kickoffs = games.filter("kickoff_utc is not null").select("game_id", F.unix_micros(F.col("kickoff_utc").cast("timestamp")).alias("kickoff"))
    timed = observed.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", delay).join(kickoffs, "game_id")
    keyed = timed.filter(F.unix_micros("observed_at") <= F.col("kickoff")).withColumn("at", F.unix_micros("observed_at"))
    out = keyed.select(*QUOTE, "price", "at", "seq", "kickoff", "observed_at").groupBy(*QUOTE).transformWithStateInPandas(_Closing(), outputStructType=CLOSING_SCHEMA, outputMode="append", timeMode="eventTime")
    return out.select(*QUOTE, "price", F.timestamp_micros("at").alias("observed_at"), "seq", F.timestamp_micros("kickoff").alias("kickoff_utc"))


def windowed_changes(changes: DataFrame, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Changes of each market in tumbling windows of event time; late ones count within the watermark."""
    return changes.withWatermark("observed_at", delay).groupBy(F.window("observed_at", width), "market_type").agg(F.count(F.lit(1)).alias("n_changes"))
