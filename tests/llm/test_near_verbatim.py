"""Benchmark items that stand in documents with single changes."""

import pytest

from cuadre.llm import templates
from tests.llm.test_filters import ITEM


@pytest.fixture(params=[templates.BROADCAST_WINDOWS, 0])
def found(spark, monkeypatch, request):
    monkeypatch.setattr(templates, "BROADCAST_WINDOWS", request.param)

    def run(docs, bench):
        frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string")
        got = templates.contaminated(frame(docs, "doc_id"), frame(bench, "item_id")).collect()
        return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"], r["n_changed"]) for r in got}

    return run


def test_one_inconsistent_slot_leaves_the_other_windows(found):
    torn = ITEM.replace("12 apples", "13 apples")
    got = found([ITEM, torn, torn.replace("named Alice", "named Dora"), "A farmer sold apples to no one, and that was all"], [ITEM])
    assert set(got) == {(0, 0), (1, 0), (2, 0)}
    assert got[0, 0][2] == 0 and got[1, 0][2] == 1 and got[2, 0][2] >= 1
    assert 0 < got[2, 0][0] <= got[1, 0][0] <= got[0, 0][0]


def test_a_window_with_two_values_for_one_is_no_match(found):
    item = "take 5 of the small red boxes and 5 of the large green ones"
    got = found([item.replace("5", "9"), item.replace("5", "9", 1).replace(" 5 ", " 8 ")], [item])
    assert got[0, 0][2] == 1 and got[1, 0][0] < got[0, 0][0]


def test_items_of_numbers_and_names_are_found_verbatim(found):
    numbers, names = "1 2 3 4 5 6 7 8 9", "seen there: Alice, Bob, Carol, Dora, Emil, Frank, Greta, Hans, Ida"
    got = found([f"the row {numbers} ends", f"we have {names} and others", numbers.replace("5", "6"), "none of them"], [numbers, names])
    assert set(got) == {(0, 0), (1, 1)} and got[0, 0][2] == got[1, 1][2] == 0


def test_names_after_other_white_space_quotes_and_in_other_case(found):
    docs = [ITEM.replace(" Alice", "\nAlice").replace(" Bob", "  Bob"), ITEM.replace(" Alice", ' "Alice').replace(" Bob", " “Bob"), ITEM.lower(), ITEM.upper(), ITEM.replace(" ", "\n")]
    docs.append(docs[0].replace("Alice", "Carol").replace("7", "8"))
    got = found(docs, [ITEM])
    assert set(got) == {(i, 0) for i in range(6)}
    assert len({got[i, 0][0] for i in range(5)}) == 1 and all(got[i, 0][2] == 0 for i in range(5)) and got[5, 0][2] == 2
