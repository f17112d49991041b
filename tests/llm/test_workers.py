"""Python workers give memory back after a step."""

from __future__ import annotations

import pyarrow as pa

from gsx.llm import quality, workers


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_is_given_back():
    held = [bytes(1000) for _ in range(200_000)]
    kept = held[::2000]
    high = _resident()
    del held
    workers.give_back()
    assert _resident() < high - 100_000_000 and len(kept) == 100


def test_released_step_yields_the_same_and_gives_back_last(monkeypatch):
    calls = []
    monkeypatch.setattr(workers, "give_back", lambda: calls.append("back"))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two", None])], names=["text"])
    plain = [b.to_pydict() for b in quality._contexts(iter([batch]))]
    seen = [(b.to_pydict(), list(calls)) for b in workers.released(quality._contexts)(iter([batch]))]
    assert seen == [(p, []) for p in plain] and calls == ["back"]
