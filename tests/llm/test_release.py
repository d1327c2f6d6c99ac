"""What a task and the one before it freed leaves the worker."""
from sward.llm import common as C


def test_before_the_first_row_and_behind_the_last(monkeypatch):
    seen = []
    monkeypatch.setattr(C, "release_memory", lambda: seen.append("free"))
    list(C.releasing(lambda it: (seen.append(x) for x in it), first=True)([1, 2]))
    assert seen == ["free", 1, 2, "free"]
    list(C.releasing(lambda it: (seen.append(x) for x in it))([3]))
    assert seen[4:] == [3, "free"]
