"""Helpers of the corpus operators."""

from types import SimpleNamespace

import pytest

from trialgrid.llm import common


def test_tidied_gives_memory_back_when_a_task_ends(monkeypatch):
    freed = []
    pool = SimpleNamespace(release_unused=lambda: freed.append(True))
    monkeypatch.setattr(common, "pa", SimpleNamespace(default_memory_pool=lambda: pool))
    rows = common.tidied(lambda batches: (2 * b for b in batches))(iter([1, 2]))
    assert next(rows) == 2 and not freed
    assert list(rows) == [4] and freed == [True]

    def fails(batches):
        yield next(batches)
        raise ValueError("bad row")

    with pytest.raises(ValueError, match="bad row"):
        list(common.tidied(fails)(iter([1])))
    assert freed == [True, True]


def test_tidied_gives_the_heap_back(monkeypatch):
    trimmed = []
    library = SimpleNamespace(malloc_trim=trimmed.append)
    monkeypatch.setattr(common, "ctypes", SimpleNamespace(CDLL=lambda name: library), raising=False)
    assert list(common.tidied(lambda batches: batches)(iter([1]))) == [1] and trimmed == [0]
    del library.malloc_trim  # another C library
    assert list(common.tidied(lambda batches: batches)(iter([1]))) == [1]
