"""What a Python worker keeps between tasks."""

import time

import pytest

from postsift.llm import common


@pytest.fixture(autouse=True)
def short_wait(monkeypatch):
    monkeypatch.setattr(common, "IDLE_SECONDS", 0.3)
    yield
    time.sleep(0.5)  # the value of a test is gone before the next one


def built(log, key):
    def build():
        log.append(key)
        return [key]

    return build


def test_kept_from_task_to_task_and_one_value_in_all():
    log = []
    for key in ("a", "a", "b", "a"):
        with common.per_worker(key, built(log, key)) as value:
            assert value == [key]
    assert log == ["a", "b", "a"]


def test_idle_worker_lets_go():
    log = []
    for _ in range(2):
        with common.per_worker("a", built(log, "a")):
            pass
        time.sleep(0.6)
    assert log == ["a", "a"]


def test_a_long_task_keeps_its_value():
    log = []
    with common.per_worker("a", built(log, "a")):
        pass
    with common.per_worker("a", built(log, "a")) as value:
        time.sleep(0.6)
        assert value == ["a"]
    with common.per_worker("a", built(log, "a")):
        pass
    assert log == ["a"]


def test_a_task_that_fails_frees_its_value():
    log = []
    with pytest.raises(ValueError):
        with common.per_worker("a", built(log, "a")):
            raise ValueError
    time.sleep(0.6)
    with common.per_worker("a", built(log, "a")):
        pass
    assert log == ["a", "a"]
