"""Ranged reads of JSON arrays and maps against whole parses."""

import io
import json
import random

import pytest

from mnemospark.sources import json_ranges as jr


def _nasty(rng, n):
    some = ["]", "[", "{", "}", ",", '"', "\\", "\\\\", '\\"', "é中😀", "\n", "a", " ", "\t", '",{"x":["']
    return [{"k": k, "t": "".join(rng.choice(some) for _ in range(rng.randrange(30))), "n": [{"x": [1, "]"]}] * rng.randrange(3)} for k in range(n)]


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_ranges_of_any_size_equal_the_parse(size):
    rng = random.Random(size)
    for rows in (_nasty(rng, 25), [], [1, "a,b", None, [], {}, -2.5e3, True], ["\\" * 9000]):
        for text in (json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False), "  " + json.dumps(rows) + "\n"):
            data = text.encode()
            if size == 1 and len(data) > 3000:
                continue
            f, state, got = io.BytesIO(data), (False, 0), []
            for start in range(0, len(data), size):
                got += [json.loads(e) for _, e in jr.elements(f, start, min(size, len(data) - start), *state)]
                parity, outside, inside = jr.range_map(f, start, min(size, len(data) - start))
                state = state[0] ^ bool(parity), state[1] + (inside if state[0] else outside)
            assert got == rows and state == (False, 0)


def test_arrays_and_maps_by_many_tasks(spark, tmp_path):
    rows = _nasty(random.Random(3), 800)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(rows, ensure_ascii=False))
    (tmp_path / "a" / "two.json").write_text(json.dumps(rows[:3], indent=1))
    (tmp_path / "a" / "none.json").write_text("[]")
    (tmp_path / "a" / "void.json").write_text("")
    path = str(tmp_path / "a")
    assert len(jr.plan_ranges(spark, path, 2000)) > 20
    df = jr.read_array(spark, path, "k long, t string", 2000)
    assert jr.json_elements(spark, path, 2000).rdd.getNumPartitions() > 20
    got = {(r.path.rsplit("/", 1)[1], r.pos): (r.k, r.t) for r in df.collect()}
    want = {("one.json", k): (k, r["t"]) for k, r in enumerate(rows)} | {("two.json", k): (k, r["t"]) for k, r in enumerate(rows[:3])}
    assert got == want
    whole = {f"chunk-{k}": [r["t"], "x"] for k, r in enumerate(rows)}
    (tmp_path / "m.json").write_text(json.dumps(whole))
    assert {r.key: r.value for r in jr.read_map(spark, str(tmp_path / "m.json"), "array<string>", 3000).collect()} == whole
    assert jr.json_elements(spark, str(tmp_path / "nowhere*.json")).collect() == []


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"k": 1}, {"k": 2')
    with pytest.raises(Exception, match="ends inside"):
        jr.json_elements(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text("[1]]]" + " " * 50)
    with pytest.raises(ValueError, match="closes more"):
        jr.plan_ranges(spark, str(tmp_path / "c.json"), 4)
