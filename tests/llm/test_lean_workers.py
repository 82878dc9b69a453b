"""Memory that a worker's part has freed goes back to the system when the part ends, however it ends."""

import pytest

from edgeloom.llm import shared


def test_parts_and_calls_end_with_a_trim(monkeypatch):
    done = []
    monkeypatch.setattr(shared, "trim", lambda: done.append(1))
    run = shared.lean(lambda batches: (2 * b for b in batches))
    part = run(iter([1, 2]))
    assert next(part) == 2 and not done
    assert list(part) == [4] and len(done) == 1
    with pytest.raises(ZeroDivisionError):
        list(shared.lean(lambda batches: (1 // b for b in batches))(iter([0])))
    assert shared.freed(lambda a, b: a + b, 1, 2) == 3 and len(done) == 3


def test_trim_can_be_called():
    shared.trim()
