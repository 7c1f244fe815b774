"""Distances of many pairs at once, and the plan of the step that asks for them."""

import random

import pytest


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("alone, entries", [(18, 4_000_000), (0, 4_000_000), (0, 500), (10**9, 4_000_000)])
def test_distances_at_the_ends_of_words_of_bits(alone, entries, monkeypatch):
    from polyagree.functions import edits

    monkeypatch.setattr(edits, "ALONE", alone)
    monkeypatch.setattr(edits, "ENTRIES", entries)
    r = random.Random(1)
    text = lambda: "".join(r.choice("abcdé 𝒳ß") for _ in range(r.choice([0, 1, 2, 5, 20, 63, 64, 65, 127, 128, 129, 190])))
    lists = [[text() for _ in range(r.choice([0, 1, 2, 3, 4]))] for _ in range(60)] + [None, []]
    assert edits.greatest(lists).tolist() == [max((plain(a, b) for a in x or [] for b in x or []), default=0) for x in lists]


def test_features_take_one_shuffle_and_no_step_for_each_pair_of_characters(spark):
    from polyagree.operators.disagreement import features

    rows = spark.createDataFrame([(1, "src1", "of the", "no equivalent")], "item int, service string, term string, rationale string")
    plan = features(rows, ["item"], ["the"], "src1")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "levenshtein" not in plan.lower()
