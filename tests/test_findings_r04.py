"""The round's finding: a topic with very many facts is consolidated in time, and its state is read and written in blocks."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import Row

from mnemospark.streaming import consolidate


class _State(list):
    def appendList(self, rows):
        self.extend(rows)

    def put(self, rows):
        self[:] = rows

    def clear(self):
        self[:] = []

    get = lambda self: iter(list(self))


class _Handle:
    def getListState(self, name, kind):
        return _State()

    def registerTimer(self, at):
        pass


def _fact(k, s="s", o="o", e=()):
    return {"triple_id": k, "s": s, "p": "p", "o": o, "evidence": list(e)}


def test_a_slice_costs_its_facts_and_what_is_known():
    """Each new fact went through all known ones: 30 000 against 30 000 took minutes."""
    known = [_fact(k, f"s{k}", e=[f"e{k}"]) for k in range(30_000)]
    began = time.time()
    after, added, removed = consolidate.apply_slice(known, [_fact(k, f"s{k}", e=[f"e{k}"]) for k in range(30_000, 60_000)], lambda new, shown: (new, [shown[0]["triple_id"]]))
    assert time.time() - began < 10
    assert removed == known[:1] and len(after) == 59_999 and all(f["evidence"] == [f"e{f['triple_id']}", "e0"] for f in added)


@pytest.mark.parametrize("block", [1, 7, 2000])
def test_blocks_of_state_give_the_plain_fold(monkeypatch, block):
    """Ids and values that repeat, slices without replacements, many removals: the log is that of slices held whole."""
    monkeypatch.setattr(consolidate, "BLOCK", block)
    rnd = random.Random(block)

    def decide(new, shown):
        return {**new, "o": f"{new['o']}!"}, [shown[k]["triple_id"] for k in range(new["triple_id"] % 4) if k < len(shown)]

    p = consolidate._Consolidate(decide, 3)
    p.init(_Handle())
    at = lambda k: datetime.datetime.fromtimestamp(k)
    slices = [[_fact(rnd.randrange(40) * (1 if k % 3 else 4), f"s{rnd.randrange(6)}", f"o{rnd.randrange(2)}", [f"e{rnd.randrange(30)}"]) for _ in range(rnd.randrange(1, 25))] for k in range(30)]
    known, stored = [], 0
    for k in range(0, 30, 2):  # two slices wait together
        p.handleInputRows(("t",), iter([Row(topic="t", ts=at(j + 1), **f) for j in (k + 1, k) for f in slices[j]]), None)
        for j in (k, k + 1):
            got = list(p.handleExpiredTimer(("t",), None, type("T", (), {"getExpiryTimeInMs": lambda self, j=j: (j + 1) * 1000})()))
            known, added, removed = consolidate.apply_slice(known, slices[j], decide, 3)
            plain = lambda more, facts: [(more, f["triple_id"], f["s"], f["p"], f["o"], tuple(f["evidence"])) for f in facts]
            assert sorted((r.added, r.triple_id, r.s, r.p, r.o, tuple(r.evidence)) for r in got) == sorted(plain(True, added) + plain(False, removed))
            assert sorted(map(str, (fact for _, _, fact in p._facts()))) == sorted(str(tuple(f.values())) for f in known)
            stored = max(stored, sum(1 for _ in p.known) + block * len(p.packed) - 2 * len(known))
        assert not p.waiting
    assert stored <= 0 and (block == 2000) == (not p.packed)


def test_a_worker_s_log_is_in_blocks(monkeypatch):
    """Each fact of all slices and topics of a task was a dict in its worker at once."""
    monkeypatch.setattr(consolidate, "BLOCK", 4)
    p = consolidate._ConsolidateInBlocks(lambda new, known: (new, [known[0]["triple_id"]]), 20)
    p.init(_Handle())
    day = datetime.datetime.fromtimestamp
    p.handleInputRows(("t",), iter([Row(topic="t", ts=day(1 + k % 2), **_fact(k, "\U0001f600\"\n\x00", f"{k}")) for k in range(20)]), None)
    for at, shape in ((1000, [(True, 4), (True, 4), (True, 2)]), (2000, [(True, 4), (True, 4), (True, 2), (False, 1)])):
        got = list(p.handleExpiredTimer(("t",), None, type("T", (), {"getExpiryTimeInMs": lambda self, at=at: at})()))
        assert [(r.added, len(json.loads(r.facts))) for r in got] == shape and {r.ts for r in got} == {day(at / 1000)}


def test_state_is_dealt_to_few_tasks(spark, tmp_path):
    """A batch paid for every shuffle partition, however few topics there were; the session's setting is as before."""
    from mnemospark.streaming import streams

    kind = "topic string, ts timestamp, " + consolidate.FACT
    rows = [(f"t{k % 3}", datetime.datetime(2024, 1, 1 + k % 2), k, f"s{k}\U0001f600\"\n\x00" if k else None, "p", "o", [f"e{k}", None][: 1 + k % 2]) for k in range(30)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    most, was = 3 * spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 * most))
    try:
        q = consolidate.consolidate(streams.folder(spark, str(tmp_path / "in"), kind), str(tmp_path / "out"), str(tmp_path / "mark"), lambda new, known: (new, [known[0]["triple_id"]]))
        q.awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(4 * most)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert q.lastProgress["stateOperators"][0]["numShufflePartitions"] == most
    log = spark.read.schema(consolidate.LOG).parquet(str(tmp_path / "out")).collect()
    assert {(r.triple_id, r.s) for r in log if r.added} == {(r[2], r[3]) for r in rows} and len(log) == 33 and sorted((r.triple_id, r.ts.day) for r in log if not r.added) == [(0, 2), (2, 2), (4, 2)]
