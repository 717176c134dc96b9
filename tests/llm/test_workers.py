"""Workers give memory back around every task."""

import pandas as pd
import pytest

from cytolake.llm import workers


@pytest.mark.parametrize("made, batches", [
    (lambda seen: workers.tidy(lambda it: (seen.append("task") or b for b in it)), [1, 2]),
    (lambda seen: workers.tidy_series(lambda a, b: seen.append("task") or a + b), [(pd.Series([1]), pd.Series([2]))] * 2),
], ids=["arrow", "series"])
def test_memory_goes_back_before_and_after_a_task(monkeypatch, made, batches):
    seen = []
    monkeypatch.setattr(workers, "give_back", lambda: seen.append("give back"))
    assert len(list(made(seen)(iter(batches)))) == 2
    assert seen == ["give back", "task", "task", "give back"]


def test_series_of_rows_and_a_failing_task(monkeypatch):
    seen = []
    monkeypatch.setattr(workers, "give_back", lambda: seen.append("give back"))
    with pytest.raises(ValueError):
        list(workers.tidy_series(lambda a: pd.Series([int(x) for x in a]))(iter([(pd.Series(["x"]),)])))
    assert len(seen) == 2
