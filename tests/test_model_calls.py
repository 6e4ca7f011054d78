"""Model calls on distinct inputs: once each, paced, retried, and joined back."""

import uuid
from collections import Counter

import pytest

from quillmere.operators import model_calls as M


def logged(folder, fails=()):
    """A call that leaves a file for each time it is made, named by its input."""

    def call(text):
        open(f"{folder}/{text}~{uuid.uuid4().hex}", "w").close()
        if text in fails:
            raise RuntimeError(f"no {text}")
        return text.upper()

    return call


@pytest.mark.parametrize("broadcast", [0, M.BROADCAST])
def test_each_input_is_sent_once(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(M, "BROADCAST", broadcast)
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(i, f"t{i % 7}") for i in range(300)] + [(900, None), (901, "down")]
    df = spark.createDataFrame(rows, "id int, prompt string").repartition(5)
    out = M.replies(df, "prompt", logged(str(calls), {"down"}), str(tmp_path / "replies"), M.Limits(parallel=3, attempts=2, pause=0.01))
    found = {r.id: (r.reply, r.error) for r in out.collect()}
    assert out.count() == len(found) == 302  # reading again calls nothing
    assert all(found[i] == (f"T{i % 7}", None) for i in range(300))
    assert found[900] == (None, None) and found[901] == (None, "no down")
    assert Counter(p.name.split("~")[0] for p in calls.iterdir()) == {f"t{k}": 1 for k in range(7)} | {"down": 2}


def test_no_rows(spark, tmp_path):
    df = spark.createDataFrame([], "id int, prompt string")
    assert M.replies(df, "prompt", str.upper, str(tmp_path / "replies")).count() == 0


def test_pace_and_retries():
    now, naps = [0.0], []

    def sleep(t):
        naps.append(t)
        now[0] += t

    pace = M.Pace(0.5, lambda: now[0], sleep)
    for _ in range(4):
        pace.wait()
    assert naps == [0.5, 0.5, 0.5]
    left = [RuntimeError("a"), ValueError()]

    def call():
        if left:
            raise left.pop(0)
        return "fine"

    naps.clear()
    assert M.attempted(call, M.Limits(attempts=3, pause=1.0), M.Pace(0.0), naps.append) == ("fine", None)
    assert naps == [1.0, 2.0]
    left[:] = [ValueError()] * 2
    assert M.attempted(call, M.Limits(attempts=2), M.Pace(0.0), naps.append) == (None, "ValueError")
