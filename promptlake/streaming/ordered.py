"""Keyed streaming operators that must see each key's rows in time order.

Rows wait in keyed state until the watermark passes them and are then replayed in order, so
that stream and batch agree. Waiting rows lie in a map by time bucket: a batch adds parts to the
buckets of its own rows without reading them, and a timer reads only the buckets that the watermark
has reached. Besides those, state holds one small value per key; timers free it when it can no
longer matter.
"""

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from promptlake.operators.truncate import MARK

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Keyed processors need the RocksDB state store."""
    if spark.conf.get(_PROVIDER) != _ROCKSDB:
        spark.conf.set(_PROVIDER, _ROCKSDB)


class InOrder(StatefulProcessor):
    """Replays rows in (time, id) order. Subclasses give the state's schema, its lifetime and
    what one row does."""

    state_schema = ""
    row_schema = ""  # starts with us, rid
    bucket_us = 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = [f.split() for f in self.row_schema.split(", ")]  # no session here to parse it
        self.columns = [name for name, _ in fields]
        lists = ", ".join(f"{name} array<{kind}>" for name, kind in fields)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "bucket bigint, part bigint", lists)
        self.value = handle.getValueState("value", self.state_schema)
        # the set timer, and the open buckets in order with their numbers of parts
        self.clock = handle.getValueState("clock", "alarm bigint, buckets array<bigint>, parts array<bigint>")

    def step(self, value, row):
        """(new value, output row)"""
        raise NotImplementedError

    def keep_until_ms(self, value) -> int:
        raise NotImplementedError

    def output(self, key, found) -> pd.DataFrame:
        raise NotImplementedError

    def _read_clock(self) -> tuple[int | None, dict[int, int]]:
        if not self.clock.exists():
            return None, {}
        alarm, buckets, parts = self.clock.get()
        return alarm, dict(zip(buckets, parts))

    def _write_clock(self, alarm: int | None, parts: dict[int, int]) -> None:
        if alarm is None:
            self.clock.clear()
        else:
            order = sorted(parts)
            self.clock.update((alarm, order, [parts[b] for b in order]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alarm, parts = self._read_clock()
        first = alarm
        for pdf in rows:
            if not len(pdf):
                continue
            # a timer is due when the watermark, in whole milliseconds, has reached the row
            low = -(-int(pdf["us"].min()) // 1000)
            first = low if first is None else min(first, low)
            for bucket, part in pdf.groupby(pdf["us"] // self.bucket_us):
                n = parts.get(bucket := int(bucket), 0)
                self.waiting.updateValue((bucket, n), tuple(_plain(part[c]) for c in self.columns))
                parts[bucket] = n + 1
        if first != alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            self.handle.registerTimer(first)
        self._write_clock(first, parts)
        return iter([])

    def _take(self, bucket: int, n_parts: int) -> list[tuple]:
        """The rows of a bucket in order; the bucket is gone then."""
        rows: list[tuple] = []
        for i in range(n_parts):
            rows += zip(*self.waiting.getValue((bucket, i)))
            self.waiting.removeKey((bucket, i))
        return sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        _, parts = self._read_clock()
        value = tuple(self.value.get()) if self.value.exists() else None
        alarm = None
        for bucket in sorted(parts):
            if bucket * self.bucket_us > mark * 1000:
                alarm = -(-bucket * self.bucket_us // 1000)
                break
            rows = self._take(bucket, parts.pop(bucket))
            n = bisect_right(rows, mark * 1000, key=lambda r: r[0])
            found = []
            for r in rows[:n]:
                value, out = self.step(value, r)
                found.append(out)
            if found:
                yield self.output(key, found)
            if n < len(rows):
                self.waiting.updateValue((bucket, 0), tuple(list(c) for c in zip(*rows[n:])))
                parts[bucket] = 1
                alarm = -(-rows[n][0] // 1000)
                break
        if value is not None:
            end = self.keep_until_ms(value)
            if alarm is None and end <= mark:
                self.value.clear()
            else:
                self.value.update(value)
                alarm = end if alarm is None else alarm
        # always later than the watermark, so it is never the timer that is being handled
        if alarm is not None:
            self.handle.registerTimer(alarm)
        self._write_clock(alarm, parts)


def _plain(column: pd.Series) -> list:
    """Python values, missing ones as None."""
    return [None if x is None or x != x else x for x in column.tolist()]


class ExactTier(InOrder):
    state_schema = "anchor bigint"
    row_schema = "us bigint, rid string"

    def __init__(self, ttl_s: int):
        self.ttl_us = ttl_s * 1_000_000

    def step(self, value, row):
        us, rid = row
        if value is not None and us < value[0] + self.ttl_us:
            return value, (rid, True, value[0])
        return (us,), (rid, False, us)

    def keep_until_ms(self, value):
        return (value[0] + self.ttl_us) // 1000 + 1

    def output(self, key, found):
        return pd.DataFrame(found, columns=["request_id", "l1_hit", "anchor_us"]).assign(cache_key=key[0])


def stream_l1(requests: DataFrame, ttl_s: int = 86400, delay: str = "1 hour") -> DataFrame:
    """Streaming :func:`l1_attribute`: (cache_key, request_id, l1_hit, anchor_us)."""
    use_rocksdb(requests.sparkSession)
    d = requests.withWatermark("ts", delay).select(
        "cache_key", "ts", F.unix_micros("ts").alias("us"), F.col("request_id").alias("rid"))
    return d.groupBy("cache_key").transformWithStateInPandas(
        ExactTier(ttl_s), "request_id string, l1_hit boolean, anchor_us bigint, cache_key string",
        "append", "EventTime")


class MonthlyQuota(InOrder):
    state_schema = "used bigint, end_ms bigint"
    row_schema = "us bigint, rid string, tokens bigint, end_ms bigint"

    def __init__(self, quota: int):
        self.quota = quota

    def step(self, value, row):
        _, rid, tokens, end_ms = row
        used = value[0] if value is not None else 0
        admitted = used < self.quota
        status = "EXCEEDED" if used / self.quota >= 1.0 else "WARNING" if used / self.quota >= 0.8 else "OK"
        return (used + (tokens if admitted else 0), end_ms), (rid, admitted, used, status)

    def keep_until_ms(self, value):
        return value[1]

    def output(self, key, found):
        return pd.DataFrame(found, columns=["request_id", "admitted", "used_before", "status"]).assign(
            user_id=key[0], month=key[1])


def stream_quota(misses: DataFrame, quota: int = 100_000, delay: str = "1 hour") -> DataFrame:
    """Streaming :func:`quota_gate`; a user's counter is freed when its month has ended."""
    use_rocksdb(misses.sparkSession)
    end = (F.unix_timestamp(F.last_day("ts").cast("timestamp")) + 86400) * 1000
    d = misses.withWatermark("ts", delay).select(
        "user_id", F.date_format("ts", "yyyyMM").alias("month"), "ts", F.unix_micros("ts").alias("us"),
        F.col("request_id").alias("rid"), F.col("tokens").cast("bigint").alias("tokens"), end.alias("end_ms"))
    return d.groupBy("user_id", "month").transformWithStateInPandas(
        MonthlyQuota(quota),
        "request_id string, admitted boolean, used_before bigint, status string, user_id string, month string",
        "append", "EventTime")


class RecentMeans(InOrder):
    """The last samples of a pod; an idle pod is forgotten."""

    state_schema = "depths array<bigint>, us bigint"
    row_schema = "us bigint, rid string, depth bigint"

    def __init__(self, short: int, long: int, idle_ms: int):
        self.short, self.long, self.idle_ms = short, long, idle_ms

    def step(self, value, row):
        us, _, depth = row
        depths = ([*value[0], depth] if value is not None else [depth])[-self.long:]
        recent = depths[-self.short:]
        return (depths, us), (us, depth, sum(recent) / len(recent), sum(depths) / len(depths))

    def keep_until_ms(self, value):
        return value[1] // 1000 + self.idle_ms

    def output(self, key, found):
        out = pd.DataFrame(found, columns=["us", "depth", "avg_1m", "avg_5m"]).assign(pod=key[0])
        return out.assign(ts=pd.to_datetime(out.pop("us"), unit="us"))


def stream_queue_avg(samples: DataFrame, short: int = 12, long: int = 60, delay: str = "1 minute",
                     idle_ms: int = 86_400_000) -> DataFrame:
    """Streaming :func:`moving_avg` over (pod, ts, depth): (pod, ts, depth, avg_1m, avg_5m).

    A sample enters one list of bounded length, where overlapping windows would each take a copy.
    """
    use_rocksdb(samples.sparkSession)
    d = samples.withWatermark("ts", delay).select(
        "pod", "ts", F.unix_micros("ts").alias("us"), F.lit("").alias("rid"), F.col("depth").cast("bigint").alias("depth"))
    return d.groupBy("pod").transformWithStateInPandas(
        RecentMeans(short, long, idle_ms),
        "depth bigint, avg_1m double, avg_5m double, pod string, ts timestamp", "append", "EventTime")


class Truncation(StatefulProcessor):
    """Bytes so far per response. Chunks are numbered from 0; one that comes before its predecessors,
    also in an earlier batch, waits for them in state. A response that stays idle on the event clock
    is closed: what still waits is given out in order over the gaps, and the response is forgotten.

    A key holds a bucket of responses, as every call for state costs far more than a response's share
    of a list: the bucket's open responses are one value, and the chunks that a batch leaves waiting
    are one part of a map, which is read when one of them is due."""

    def __init__(self, factor: float, idle_ms: int):
        self.factor, self.idle_ms = factor, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one item per open response; held and part: numbers of its waiting chunks, and where they lie
        self.open = handle.getValueState("open", (
            "alarm bigint, parts bigint, ids array<string>, next array<bigint>, bytes array<bigint>, cut array<boolean>, "
            "until array<bigint>, held array<array<bigint>>, part array<array<bigint>>"))
        self.waiting = handle.getMapState("waiting", "part bigint", (
            "ids array<string>, seqs array<bigint>, deltas array<string>, most array<bigint>"))

    def _read(self) -> tuple[int | None, int, dict]:
        """The set timer, the number of the next part, and id: [next, bytes, cut, until, {seq: part}]."""
        alarm, parts, ids, *rows, held, part = self.open.get() or (None, 0, *[()] * 7)
        return alarm, parts, {rid: [*row, dict(zip(h, p))] for rid, *row, h, p in zip(ids, *rows, held, part)}

    def _write(self, alarm, parts, responses) -> None:
        if not responses:
            self.open.clear()
            return
        rows = [(rid, *row, list(held), list(held.values())) for rid, (*row, held) in responses.items()]
        self.open.update((alarm, parts, *map(list, zip(*rows))))

    def _chunk(self, state, rid, seq, delta, most, found):
        """State after one more chunk in order; what it gives goes to ``found``."""
        total, cut = state
        if cut or not delta:
            return state
        total += len(delta.encode("utf-8"))
        tokens = max(1, total // 4)
        cut = most is not None and tokens > most
        found.append((seq, delta + MARK if cut else delta, tokens, cut, rid))
        return total, cut

    def _frame(self, found):
        return pd.DataFrame(found, columns=["seq", "delta", "tokens_so_far", "truncated", "response_id"])

    def _take(self, rid, seq, part, stored):
        """A waiting chunk; ``stored`` has the parts that were read: their chunks, and if any was taken."""
        if part not in stored:
            stored[part] = {(r, s): chunk for r, s, *chunk in zip(*self.waiting.getValue((part,)))}
        return stored[part].pop((rid, seq))

    def _put(self, part, chunks) -> None:
        if chunks:
            rows = [(rid, seq, *chunk) for (rid, seq), chunk in chunks.items()]
            self.waiting.updateValue((part,), tuple(map(list, zip(*rows))))
        else:
            self.waiting.removeKey((part,))

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        first, parts, responses = self._read()
        stored, late = {}, {}
        for pdf in rows:
            new: dict = {}
            for rid, seq, delta, most, us in zip(*(_plain(pdf[c]) for c in ("rid", "seq", "delta", "predicted_max", "us"))):
                chunks, newest = new.get(rid, ({}, None))
                chunks[int(seq)] = (delta, None if most is None else int(most * self.factor))
                new[rid] = (chunks, us if newest is None else newest if us is None else max(us, newest))
            found: list = []
            for rid, (chunks, newest) in new.items():
                due, total, cut, until, held = responses.get(rid, (0, 0, False, None, {}))
                state, now = (total, cut), {seq: chunk for seq, chunk in chunks.items() if seq >= due}
                while due in now or due in held:
                    part = held.pop(due, None)
                    waited = None if part is None else late.pop((rid, due)) if part == parts else self._take(rid, due, part, stored)
                    state = self._chunk(state, rid, due, *(now.pop(due) if due in now else waited), found)
                    due += 1
                if not state[1]:
                    for seq, chunk in now.items():
                        if held.get(seq, parts) != parts:  # sent again
                            self._take(rid, seq, held[seq], stored)
                        held[seq], late[rid, seq] = parts, chunk
                end = (mark if newest is None else int(newest) // 1000) + self.idle_ms
                responses[rid] = [due, *state, end if until is None else max(end, until), held]
            if found:
                yield self._frame(found)
        for part, chunks in stored.items():
            self._put(part, chunks)
        if late:
            self._put(parts, late)
        alarm = min((r[3] for r in responses.values()), default=None)
        if first is not None and (alarm is None or alarm >= first):
            alarm = first  # it comes early, and is then set anew
        elif alarm is not None:
            if first is not None:
                self.handle.deleteTimer(first)
            self.handle.registerTimer(alarm)
        self._write(alarm, parts + 1, responses)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        _, parts, responses = self._read()
        found, stored, left = [], {}, {}
        for rid, (due, total, cut, until, held) in responses.items():
            if until > mark:
                left[rid] = [due, total, cut, until, held]
                continue
            state = (total, cut)
            for seq in sorted(held):
                state = self._chunk(state, rid, seq, *self._take(rid, seq, held[seq], stored), found)
        for part, chunks in stored.items():
            self._put(part, chunks)
        alarm = min((r[3] for r in left.values()), default=None)
        # always later than the watermark, so it is never the timer that is being handled
        if alarm is not None:
            self.handle.registerTimer(alarm)
        self._write(alarm, parts, left)
        if found:
            yield self._frame(found)


def stream_truncate(chunks: DataFrame, factor: float = 1.5, idle_ms: int = 3_600_000,
                    delay: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """Streaming :func:`truncate_stream` over (response_id, seq, ts, delta, predicted_max), chunks
    numbered from 0 in each response. Ids are numbers or strings. State is kept for ``buckets`` of
    responses: a started stream keeps their number."""
    use_rocksdb(chunks.sparkSession)
    id_type = chunks.schema["response_id"].dataType
    d = chunks.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("response_id"), F.lit(buckets)).alias("bucket"), F.col("response_id").cast("string").alias("rid"),
        "seq", "ts", F.unix_micros("ts").alias("us"), "delta", "predicted_max")
    found = d.groupBy("bucket").transformWithStateInPandas(
        Truncation(factor, idle_ms),
        "seq int, delta string, tokens_so_far bigint, truncated boolean, response_id string", "append", "EventTime")
    return found.withColumn("response_id", F.col("response_id").cast(id_type))
