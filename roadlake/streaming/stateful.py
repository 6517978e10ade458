"""Keyed state: consecutive-event rules, flow spikes and suppression, in event-time order.

Rows of a micro-batch come unordered and later batches may bring earlier rows
within the watermark's delay: a processor buffers rows and works through a key's
rows in order once the watermark has passed them. A key has one timer at most,
at its earliest buffered time, or else at the time when its state has no more
use and is removed. So a key's buffer is read and written once a batch. The
folds are those of the batch twins.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import spike_step

_EPOCH = dt.datetime(1970, 1, 1)
#: Digits of a time in microseconds, and how JSON carries one without cutting it.
_DIGITS = 19
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _ms(value) -> int:
    return int((pd.Timestamp(value).to_pydatetime().replace(tzinfo=None) - _EPOCH).total_seconds() * 1000)


def _time(ms: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(milliseconds=ms)


class _Ordered(StatefulProcessor):
    """Buffers (time in ms, value) and hands them over in order; `idle_ms` after its last row a key's state goes."""

    value_type = "double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", f"at bigint, v {self.value_type}")
        self.timer = handle.getValueState("timer", "at bigint")
        self.setup(handle)

    def _set_timer(self, at: int | None) -> None:
        old = self.timer.get()[0] if self.timer.exists() else None
        if old == at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = [(_ms(at), v) for at, v in zip(pdf["at"], pdf["v"])]
            if new:
                self.buffer.appendList(new)
                least = min(at for at, _ in new)
                first = least if first is None else min(first, least)
        if first is not None:
            old = self.timer.get()[0] if self.timer.exists() else None
            self._set_timer(first if old is None else min(first, old))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        self.timer.clear()  # the one that fired
        rows = sorted((r[0], r[1]) for r in self.buffer.get()) if self.buffer.exists() else []
        due = [r for r in rows if r[0] <= limit]
        rest = rows[len(due) :]
        if due:
            self.buffer.clear()
            if rest:
                self.buffer.appendList(rest)
        if rest:
            self._set_timer(rest[0][0])
        elif due and due[-1][0] + self.idle_ms > limit:
            self._set_timer(due[-1][0] + self.idle_ms)
        out = self.fold(key[0], due) if due else None
        if not rest and (not due or due[-1][0] + self.idle_ms <= limit):
            self.forget()
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


class RuleProcessor(_Ordered):
    """n rows in a row whose rule holds, less than `within` seconds apart; rules: (name, n, within)."""

    value_type = "bigint"  # bit i: rule i holds

    def __init__(self, rules: list[tuple[str, int, int]]):
        self.rules = rules
        self.idle_ms = 1000 * max(within for _, _, within in rules)

    def setup(self, handle) -> None:
        self.last = handle.getListState("last", "at bigint, v bigint")

    def forget(self) -> None:
        self.last.clear()

    def fold(self, key, due) -> pd.DataFrame:
        held = [(r[0], r[1]) for r in self.last.get()] if self.last.exists() else []
        longest, out = max(n for _, n, _ in self.rules), []
        for row in due:
            held = [*held, row][-longest:]
            for i, (name, n, within) in enumerate(self.rules):
                run = held[-n:]
                if len(run) == n and all(v >> i & 1 for _, v in run) and run[-1][0] - run[0][0] < within * 1000:
                    out.append((key, name, _time(run[0][0]), _time(run[-1][0])))
        self.last.clear()
        self.last.appendList(held)
        return pd.DataFrame(out, columns=["key", "rule", "first_ts", "last_ts"])


def sequence_stream(df: DataFrame, key: str, ts: str, rules: dict[str, tuple[object, int, int]], delay: str = "30 seconds") -> DataFrame:
    """rules: name -> (condition column, n, within seconds). Output key, rule, first_ts, last_ts."""
    bits = sum((F.coalesce(cond, F.lit(False)).cast("long") * (1 << i) for i, (cond, _, _) in enumerate(rules.values())), F.lit(0).cast("long"))
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("at"), bits.alias("v"))
    rows = rows.filter("key is not null and at is not null").withWatermark("at", delay)
    processor = RuleProcessor([(name, n, within) for name, (_, n, within) in rules.items()])
    return rows.groupBy("key").transformWithStateInPandas(
        processor, "key string, rule string, first_ts timestamp, last_ts timestamp", "append", "eventTime", eventTimeColumnName="last_ts")


class SpikeProcessor(_Ordered):
    def __init__(self, alpha: float, factor: float, warmup: int, ttl_ms: int):
        self.alpha, self.factor, self.warmup, self.idle_ms = alpha, factor, warmup, ttl_ms

    def setup(self, handle) -> None:
        self.average = handle.getValueState("average", "m double, n bigint, at bigint")

    def forget(self) -> None:
        self.average.clear()

    def fold(self, key, due) -> pd.DataFrame:
        got, out = self.average.get() if self.average.exists() else None, []
        state, last = ((got[0], got[1]), got[2]) if got else (None, None)
        for at, flow in due:
            if last is not None and at - last > self.idle_ms:  # expired since its last write
                state = None
            state, hit = spike_step(state, flow, self.alpha, self.factor, self.warmup)
            last = at
            if hit is not None:
                out.append((key, _time(at), flow, hit, flow / hit if hit else None))
        self.average.update((float(state[0]), int(state[1]), int(last)))
        return pd.DataFrame(out, columns=["key", "ts", "flow", "history_avg", "ratio"])


def flow_spike_stream(df: DataFrame, key: str, ts: str, flow: str, alpha: float = 0.2, factor: float = 2, warmup: int = 5,
    delay: str = "30 seconds", ttl_hours: float = 24) -> DataFrame:
    """The stream twin of series.flow_spike; a key's state counts for ttl_hours of event time after its last row and then goes."""
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("at"), F.col(flow).cast("double").alias("v"))
    rows = rows.filter("key is not null and at is not null and v is not null").withWatermark("at", delay)
    return rows.groupBy("key").transformWithStateInPandas(
        SpikeProcessor(alpha, factor, warmup, int(ttl_hours * 3_600_000)),
            "key string, ts timestamp, flow double, history_avg double, ratio double", "append", "eventTime")


class SilenceProcessor(_Ordered):
    """Passes an alert unless one of its key was passed less than `silence_us` microseconds before.

    A value is the row's time in microseconds, in _DIGITS digits, and its text.
    """

    value_type = "string"

    def __init__(self, silence_us: int):
        self.silence_us, self.idle_ms = silence_us, silence_us // 1000 + 1

    def setup(self, handle) -> None:
        self.sent = handle.getValueState("sent", "us bigint")

    def forget(self) -> None:
        self.sent.clear()

    def fold(self, key, due) -> pd.DataFrame:
        last, out = self.sent.get()[0] if self.sent.exists() else None, []
        for at, value in due:
            us, row = int(value[:_DIGITS]), value[_DIGITS:]
            if last is None or us - last >= self.silence_us:
                last = us
                out.append((key, _time(at), row))
        self.sent.update((last,))
        return pd.DataFrame(out, columns=["key", "at", "row"])


def suppress_stream(df: DataFrame, keys: list[str], ts: str, minutes: int = 30, delay: str | None = "30 seconds") -> DataFrame:
    """The alerts that alerts.suppress would send, with the columns of df, times to the microsecond; keys: what makes two alerts the same.

    delay: None where `ts` has a watermark already. Of several alerts of a key at one time the first by its text is sent.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false", **_EXACT})
    value = F.concat(F.lpad(F.unix_micros(F.col(ts).cast("timestamp")).cast("string"), _DIGITS, "0"), F.to_json(F.struct(*df.columns), _EXACT))
    rows = df.select(key.alias("key"), F.col(ts).alias("at"), value.alias("v")).filter("at is not null")
    rows = rows if delay is None else rows.withWatermark("at", delay)
    out = rows.groupBy("key").transformWithStateInPandas(SilenceProcessor(minutes * 60_000_000), "key string, at timestamp, row string", "append",
        "eventTime")
    return out.select(F.from_json("row", df.schema, _EXACT).alias("r")).select("r.*")


class ArrivalSpikeProcessor(StatefulProcessor):
    """Spikes against a moving average that is forgotten `ttl_ms` of processing time after it was last written."""

    def __init__(self, alpha: float, factor: float, warmup: int, ttl_ms: int):
        self.alpha, self.factor, self.warmup, self.ttl_ms = alpha, factor, warmup, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.average = handle.getValueState("average", "m double, n bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.average.get()) if self.average.exists() else None
        new = sorted((row for pdf in rows for row in zip(pdf["at"], pdf["v"])))
        out = []
        for at, flow in new:
            state, hit = spike_step(state, flow, self.alpha, self.factor, self.warmup)
            if hit is not None:
                out.append((key[0], at, flow, hit, flow / hit if hit else None))
        self.average.update((float(state[0]), int(state[1])))
        yield pd.DataFrame(out, columns=["key", "ts", "flow", "history_avg", "ratio"])

    def close(self) -> None:
        pass


def flow_spike_arrivals(df: DataFrame, key: str, ts: str, flow: str, alpha: float = 0.2, factor: float = 2, warmup: int = 5, ttl_ms: int = 24 * 3_600_000) -> DataFrame:
    """flow_spike_stream in order of arrival: rows are taken as batches bring them (within one by `ts`), without waiting for a watermark.

    The store removes a key's state once ttl_ms of processing time have gone by since its last row, whether or not events go on.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("at"), F.col(flow).cast("double").alias("v"))
    rows = rows.filter("key is not null and at is not null and v is not null")
    return rows.groupBy("key").transformWithStateInPandas(
        ArrivalSpikeProcessor(alpha, factor, warmup, ttl_ms), "key string, ts timestamp, flow double, history_avg double, ratio double", "append", "processingTime")
