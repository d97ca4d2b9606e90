from pagesieve.llm import common


def test_memory_goes_back_at_the_end_of_a_task(monkeypatch):
    common.give_back()
    ends = []
    monkeypatch.setattr(common, "give_back", lambda: ends.append(1))
    assert list(common.tidied(lambda batches: (2 * x for x in batches))(iter([1, 2]))) == [2, 4] and ends == [1]
    early = common.tidied(lambda batches: batches)(iter([1, 2]))
    assert next(early) == 1
    early.close()
    assert ends == [1, 1]
