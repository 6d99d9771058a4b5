"""Consolidation as keyed state in a stream: facts of a topic meet the facts that the topic already holds.

State of a topic: its facts, and those of time slices that are not complete yet. A slice is complete when the watermark passes its
time, which a timer tells; then its facts are decided against what was known before the slice, never against each other.
Facts that a new one replaces go by value (all copies), and their evidence moves to the new one. What comes out is a log
of additions and removals; ``snapshots`` reads from it what held after each slice. State and timers are in the checkpoint, so a
restart goes on where the stream stopped. A fact whose time is not after the watermark (the epoch at first) comes too late and is dropped. State of a task is what its topics hold;
a slice goes through it once, block by block, keeping only the facts whose value may be replaced.
"""

from __future__ import annotations

import bisect
import datetime
import heapq
import itertools
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The provider that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
FACT = "triple_id long, s string, p string, o string, evidence array<string>"
LOG = f"topic string, ts timestamp, added boolean, {FACT}"
#: Facts of a packed row of state.
BLOCK = 2000
_NAMES = [x.split(" ")[0] for x in FACT.split(", ")]

Decide = Callable[[dict, list[dict]], tuple[dict, list[int]]]


def _value(fact: dict) -> tuple:
    return fact["s"], fact["p"], fact["o"]


def apply_slice(known: list[dict], new: list[dict], decide: Decide, top: int = 20) -> tuple[list[dict], list[dict], list[dict]]:
    """(facts after the slice, added, removed); decide: a new fact and at most top known ones -> the fact as it shall be, ids it replaces."""
    shown = sorted(known, key=lambda f: f["triple_id"])[:top]
    evidence = {_value(f): set() for f in shown}
    for f in known:
        if (v := _value(f)) in evidence:
            evidence[v].update(f["evidence"])
    added, gone, moved = [], set(), {}
    for fact in sorted(new, key=lambda f: f["triple_id"]):
        updated, ids = decide(fact, shown) if shown else (fact, [])
        if (at := tuple(ids)) not in moved:
            replaced = {_value(f) for f in shown if f["triple_id"] in set(ids)}
            gone |= replaced
            moved[at] = sorted(set().union(*[evidence[v] for v in replaced]))
        own = set(fact["evidence"])
        added.append({**fact, **{k: updated[k] for k in "spo"}, "evidence": [*fact["evidence"], *[e for e in moved[at] if e not in own]]})
    removed = [f for f in known if _value(f) in gone]
    return [f for f in known if _value(f) not in gone] + added, added, removed


class _Consolidate(StatefulProcessor):
    """A topic's facts, in the order in which they came, are packed blocks (each row of state has its price) and then the rows of known.

    They grow at their end: gone says up to which place the facts of a value no longer hold, and all are written again once most do not.
    """

    def __init__(self, decide: Decide, top: int):
        self.decide, self.top = decide, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getListState("packed", "facts string")  # JSON, BLOCK facts a row
        self.known = handle.getListState("known", FACT)
        self.gone = handle.getListState("gone", "s string, p string, o string, until long")
        self.size = handle.getListState("size", "facts long, rows long")  # one row: facts stored, and those that are rows of known
        self.shown = handle.getListState("shown", "s string, p string, o string")  # values of the top known facts
        self.waiting = handle.getListState("waiting", "at long, facts string")  # JSON, at most BLOCK facts a row

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Rows are facts, or blocks of facts as ``_blocks`` makes them."""
        held, size = [], 0
        for r in itertools.chain(rows, [None]):
            if r is not None:
                facts = r["facts"] if "facts" in r else json.dumps([tuple(r[n] for n in _NAMES)])
                held.append((int(r["ts"].timestamp() * 1000), facts))
                size += len(facts)
            if held and (r is None or size > 2**24):
                self.waiting.appendList(held)
                for at in {h[0] for h in held}:
                    self.handle.registerTimer(at)
                held, size = [], 0
        return iter(())

    def _facts(self) -> Iterator[tuple[int, tuple, tuple]]:
        """(place from 1, value, fact) of what holds."""
        until = {tuple(r[:3]): r[3] for r in self.gone.get()}
        stored = itertools.chain(itertools.chain.from_iterable(json.loads(facts) for (facts,) in self.packed.get()), self.known.get())
        for place, fact in enumerate(stored, 1):
            value = tuple(fact[1:4])
            if place > until.get(value, 0):
                yield place, value, tuple(fact)

    def _related(self, values: set[tuple]) -> tuple[list[tuple[int, dict]], list[tuple], int]:
        """Facts of these values with their places, the first others as (id, place, value), and how many facts hold."""
        near, others, holding = [], [], 0
        for place, value, fact in self._facts():
            holding += 1
            if value in values:
                near.append((place, dict(zip(_NAMES, fact, strict=True))))
            elif len(others) < self.top or fact[0] < others[-1][0]:
                bisect.insort(others, (fact[0], place, value), key=lambda x: x[:2])
                del others[self.top :]
        return near, others, holding

    def _pack(self, facts: list[tuple]) -> list[tuple]:
        """Adds full blocks of the rows of known and these facts; the facts that are left, known being empty."""
        facts = [*map(tuple, self.known.get()), *facts]
        full = len(facts) // BLOCK * BLOCK
        self.known.clear()
        self.packed.appendList([(json.dumps(facts[i : i + BLOCK]),) for i in range(0, full, BLOCK)])
        return facts[full:]

    def _rewrite(self) -> tuple[int, int]:
        """Stores only what holds; the numbers of its facts and of those that are rows."""
        facts, blocks, rest = (f for _, _, f in self._facts()), [], []
        while len(rest := list(itertools.islice(facts, BLOCK))) == BLOCK:
            blocks.append((json.dumps(rest),))
        for state, rows in ((self.packed, blocks), (self.known, rest), (self.gone, [])):
            state.clear()
            if rows:
                state.appendList(rows)
        return len(blocks) * BLOCK + len(rest), len(rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        held = [tuple(b) for b in self.waiting.get()]
        rest = [b for b in held if b[0] > at]
        self.waiting.clear()
        if rest:
            self.waiting.put(rest)
        ts = datetime.datetime.fromtimestamp(at / 1000)
        due = itertools.chain.from_iterable(json.loads(b[1]) for b in held if b[0] <= at)
        told = lambda facts, more: (Row(topic=key[0], ts=ts, added=more, **f) for f in facts)

        near, first, holding = self._related({tuple(r) for r in self.shown.get()})
        before, tail = next(((r[0], r[1]) for r in self.size.get()), (0, 0))
        rows, known, gone, fresh = before, [f for _, f in near], set(), []
        while new := [dict(zip(_NAMES, f, strict=True)) for f in itertools.islice(due, BLOCK)]:
            _, added, removed = apply_slice(known, new, self.decide, self.top)
            gone.update(map(_value, removed))
            places = ((f["triple_id"], k, _value(f)) for k, f in enumerate(added, rows + 1))
            first = heapq.nsmallest(self.top, itertools.chain(first, places), key=lambda x: x[:2])
            rows, holding = rows + len(added), holding + len(added)
            fresh += [tuple(f[n] for n in _NAMES) for f in added]
            if tail + len(fresh) >= BLOCK:
                fresh, tail = self._pack(fresh), 0
            yield from told(added, True)
        if fresh:
            self.known.appendList(fresh)
        removed = [f for f in known if _value(f) in gone]
        if gone:
            self.gone.appendList([(*v, before) for v in gone])
            yield from told(removed, False)
        tail += len(fresh)
        if 2 * (holding - len(removed)) < rows:
            rows, tail = self._rewrite()
        self.size.put([(rows, tail)])
        first += [(f["triple_id"], k, _value(f)) for k, f in near if _value(f) not in gone]
        self.shown.put(list({v: None for _, _, v in sorted(first, key=lambda x: x[:2])[: self.top]}))

    def close(self) -> None:
        pass


class _ConsolidateInBlocks(_Consolidate):
    """The same with the log in rows of at most BLOCK facts in JSON: a worker holds all rows that its timers give until they are through."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        log = super().handleExpiredTimer(key, timerValues, expiredTimerInfo)
        for added, rows in itertools.groupby(log, key=lambda r: r["added"]):
            while some := list(itertools.islice(rows, BLOCK)):
                yield Row(topic=key[0], ts=some[0]["ts"], added=added, facts=json.dumps([dict(zip(_NAMES, r[3:], strict=True)) for r in some]))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Facts of a topic and time as rows of at most BLOCK facts in JSON, so that few rows go to the topics."""
    for b in batches:
        held = {}
        columns = [b.column("topic"), b.column("ts").cast(pa.int64()), *[b.column(n) for n in _NAMES]]
        for topic, at, *fact in zip(*[c.to_pylist() for c in columns], strict=True):
            held.setdefault((topic, at), []).append(fact)
        rows = [(*k, json.dumps(facts[i : i + BLOCK])) for k, facts in held.items() for i in range(0, len(facts), BLOCK)]
        topics, times, facts = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(topics, pa.string()), pa.array(times, pa.int64()).cast(b.schema.field("ts").type), pa.array(facts, pa.string())], ["topic", "ts", "facts"])


def consolidated(facts: DataFrame, decide: Decide, top: int = 20, late: str = "0 seconds") -> DataFrame:
    """The log of a stream of facts (topic, ts, triple_id, s, p, o, evidence); the query needs STATE_STORE."""
    blocks = facts.select("topic", "ts", *_NAMES).mapInArrow(_blocks, "topic string, ts timestamp, facts string")
    keyed = blocks.withWatermark("ts", late).groupBy("topic")
    log = keyed.transformWithState(_ConsolidateInBlocks(decide, top), "topic string, ts timestamp, added boolean, facts string", "Append", "EventTime")
    return log.select("topic", "ts", "added", F.inline(F.from_json("facts", f"array<struct<{FACT}>>")))


def consolidate(facts: DataFrame, path: str, checkpoint: str, decide: Decide, top: int = 20) -> StreamingQuery:
    """Appends the log to Parquet under path, exactly once, and stops when all that has arrived is worked off."""
    spark, conf = facts.sparkSession, facts.sparkSession.conf
    partitions = min(int(conf.get(PARTITIONS)), 3 * spark.sparkContext.defaultParallelism)  # each has its price in every batch
    before = {k: conf.get(k) for k in (PROVIDER, PARTITIONS)}
    conf.set(PROVIDER, STATE_STORE)  # a query keeps the settings that it starts with
    conf.set(PARTITIONS, str(partitions))
    try:
        out = consolidated(facts, decide, top).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.set(k, v)


def snapshots(log: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, FACT) of what held after each of times (ts): facts added by then and not removed by then.

    A fact's span is closed by a join on its own id; times meet spans by a range condition over the few times of a broadcast, which are bounded by the number of slices.
    """
    key = ["topic", "triple_id", "s", "p", "o"]
    begun = log.filter("added").select(*key, "evidence", F.col("ts").alias("since"))
    ended = log.filter("NOT added").groupBy(*key).agg(F.min("ts").alias("until"))
    spans = begun.join(ended, key, "left")
    each = F.broadcast(times.select("ts").distinct())
    return spans.join(each, (F.col("since") <= F.col("ts")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))).select("ts", "triple_id", "s", "p", "o", "evidence")
