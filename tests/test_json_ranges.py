"""Byte-range reading of JSON arrays against the json module, with ranges so small
that strings, escapes, nested values and white space lie across many of them."""

import json
import random

import pytest

from curio.sources import io


def _stories(rng, n):
    bits = ['"', "\\", "\\\\", "[", "]", "{", "}", ",", " ", "\n", "é", "漢", "a", "story", '":', "\\\""]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_ranges_against_json(spark, tmp_path, step):
    rng = random.Random(step)
    exp = []
    for name, n, kw in (("a", 3 if step == 1 else 25, {}), ("b", 4 if step == 1 else 30, {"indent": 3}), ("c", 1, {"ensure_ascii": False}), ("d", 0, {})):
        stories = _stories(rng, n)
        objects = [{"other": [[1, {"k": [2, "]"]}], s], "story": s, "z": {"story": "no"}} if i % 2 else {"story": s} for i, s in enumerate(stories)]
        pad = " \n\t " * (3 if name == "b" else 0)
        (tmp_path / f"{name}.json").write_text(pad + json.dumps(objects, **kw) + pad, encoding="utf-8")
        exp += [(f"{name}.json", i, s) for i, s in enumerate(stories)]
    got = io.read_json_shards(spark, str(tmp_path), range_bytes=step).collect()
    assert sorted((r["shard"].rsplit("/", 1)[-1], r["pos"], r["story"]) for r in got) == exp


def test_one_long_story_over_many_ranges(spark, tmp_path):
    story = 'x"\\[{,' * 3000
    (tmp_path / "one.json").write_text(json.dumps([{"story": "first"}, {"story": story}, {"other": 1}]))
    got = io.read_json_shards(spark, str(tmp_path), range_bytes=100)
    assert sorted((r["pos"], r["story"]) for r in got.collect()) == [(0, "first"), (1, story), (2, None)]


BROKEN = ['[{"story": "a"}', '[{"story": "a]', '{"story": "a"}', '[{"story": "a"},]', '[,{"story": "a"}]', '[{"story": "a"}] x', 'x [{"story": "a"}]',
          '[{"story": "a"}]\n[{"story": "b"}]', '[{"story": "a"} {"story": "b"}]', '[{"story": "a"}]]', "  \n ", '[{"story": a}]', '[3]', '[{"story": "a"}}']


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_broken_shards_fail(spark, tmp_path, step):
    passed = []
    for i, text in enumerate(BROKEN):
        folder = tmp_path / str(i)
        folder.mkdir()
        (folder / "s.json").write_text(text)
        try:
            io.read_json_shards(spark, str(folder), range_bytes=step).collect()
            passed.append(text)
        except Exception:  # noqa: BLE001  the engine wraps what the task raises
            pass
    assert passed == []


def test_no_bytes_and_no_files_give_no_rows(spark, tmp_path):
    (tmp_path / "empty.json").write_text("")
    assert io.read_json_shards(spark, str(tmp_path)).collect() == []
    (tmp_path / "one.json").write_text("[ ]")
    assert io.read_json_shards(spark, str(tmp_path)).collect() == []
