"""Decontamination: items without windows, and copies that are changed in one place."""

from gridloom.llm import decontam

FIFTEEN = "the old miller carried seven heavy sacks across a narrow bridge before dawn broke yesterday"
SIXTEEN = FIFTEEN + " again"
EQUAL = "Tom paid 5 dollars for the blue kite while nobody else in the whole village would pay more than 5 dollars for any kite that was sold there"
PLENTY = " ".join(f"{a}{b}" for a in "bcdf" for b in ("am", "em", "im", "om", "um"))


def found(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}


def test_items_without_a_window_are_compared_exactly(spark):
    bench = [(1, "What is 12 + 7 * 3?"), (2, "Who wrote Emma?"), (3, "北京是中国的首都吗？"), (4, "1 2 3 4 5 6 7 8 9 10 11 12"), (5, "?!"), (6, "")]
    docs = [
        (1, "He asked: what is 12 + 7 * 3? Nobody knew."),
        (2, "What is 12 * 7 + 3? And what is 12 + 8 * 3?"),
        (3, "One may ask who wrote Emma, and who wrote it first. " * 3),
        (4, "Who wrote Persuasion?"),
        (5, "问题：北京是中国的首都吗？答案是。"),
        (6, "北京不是中国的首都吗？"),
        (7, "So 0 1 2 3 4 5 6 7 8 9 10 11 12 13"),
        (8, "1 2 3 4 5 6 7 8 9 10 11"),
        (9, "?! ?!"),
    ]
    assert found(spark, docs, bench) == {(1, 1), (3, 2), (5, 3), (7, 4)}


def test_one_word_changed_put_in_or_left_out(spark):
    items = {15: FIFTEEN, 16: SIXTEEN, 20: PLENTY, 8: "grey geese flew over our frozen harbour today"}
    docs, want = [], set()
    for item, text in items.items():
        words = text.split()
        for at in range(len(words)):
            for n, put in enumerate((["quite"], ["quite", words[at]], [])):
                docs.append((item * 1000 + at * 10 + n, "So " + " ".join([*words[:at], *put, *words[at + 1 :]]) + " it was"))
                want.add((docs[-1][0], item))
    got = found(spark, docs, list(items.items()))
    # the items of 15 and 16 words hold each other
    missed = {x for x in want if x not in got}
    assert not missed, sorted(missed)
    assert {(d, i) for d, i in got if i != d // 1000} <= {(d, i) for d, i in got if {i, d // 1000} == {15, 16}}


def test_one_of_two_equal_values_altered(spark):
    docs = [(1, EQUAL.replace("5", "6", 1)), (2, EQUAL.replace("5", "6")), (3, "Tom paid 6 dollars for the blue kite and left")]
    assert found(spark, docs, [(1, EQUAL)]) == {(1, 1), (2, 1)}


def test_exact_windows_do_not_depend_on_the_place():
    import numpy as np

    e = np.array([x | 1 for x in range(3, 3000, 7)], np.uint64)
    for size in (1, 5, 40):
        w = decontam.exact_windows(e, size)
        assert len(set(w.tolist())) == len(w) == len(e) - size + 1
        assert all(w[i] == decontam.exact_windows(e[i : i + size], size)[0] for i in (0, 7, len(w) - 1))
