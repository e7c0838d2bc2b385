"""The matching core: metrics, matches, ignored positions and errors, on literal sequences."""

import itertools
import random

import pytest

from textweft.api import InvalidSequences, analyze, analyze_lists, analyze_pair, table_of

ALPHABET = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def letters(text):
    return [ALPHABET[c] for c in text]


def naive(left, right, ignored_left=(), ignored_right=(), least=1):
    """All maximal runs on all diagonals, by walking them."""
    gone = [{i for a, b in r for i in range(a, b)} for r in (ignored_left, ignored_right)]
    runs = []
    for d in range(-len(left) + 1, len(right)):
        run = None
        for i in range(max(0, -d), min(len(left), len(right) - d) + 1):
            hit = i < len(left) and i + d < len(right) and left[i] == right[i + d] and i not in gone[0] and i + d not in gone[1]
            if hit:
                run = run or [i, i + d, 0]
                run[2] += 1
            elif run:
                runs.append(tuple(run))
                run = None
        if run:
            runs.append(tuple(run))
    runs = [r for r in runs if r[2] >= least]
    cover = [len({x for r in runs for x in range(r[s], r[s] + r[2])}) for s in (0, 1)]
    totals = [len(set(range(len(s))) - g) for s, g in zip((left, right), gone)]
    inside = lambda a, b: all(b[s] <= a[s] and a[s] + a[2] <= b[s] + b[2] for s in (0, 1)) and a[:2] != b[:2]
    kept = sorted(a for a in runs if not any(inside(a, b) for b in runs))
    metrics = {"similarity": sum(cover) / sum(totals) if sum(totals) else 0.0, "longest_fragment": max((r[2] for r in runs), default=0), "overlap_left": cover[0], "overlap_right": cover[1], "total_left": totals[0], "total_right": totals[1], "total_overlap": sum(cover)}
    return {"metrics": metrics, "matches": kept}


CASES = [
    ("ABCDE", "IIBCD", (), (), 1), ("ABC", "ABC", (), (), 1), ("ABC", "DEF", (), (), 1), ("ABCDEF", "XYZABC", (), (), 5), ("ABXCD", "QABXCD", [(2, 3)], [(3, 4)], 1),
    ("ABCD", "ABCD", [(2, 4)], [(2, 4)], 1), ("ABBC", "ABBC", [(0, 1), (3, 4)], [(0, 1), (3, 4)], 1), ("ABAB", "ABAB", (), (), 1), ("ABXBC", "ABXBC", [(2, 3)], [(2, 3)], 3),
    ("XX", "X", [(0, 2)], [(0, 1)], 1), ("ABCDE", "ABCDE", (), [(2, 3)], 1), ("", "", (), (), 1), ("", "A", (), (), 1), ("ABCD", "EF", [(0, 2), (1, 3)], (), 1), ("AB", "AB", [(1, 1)], (), 1),
]


@pytest.mark.parametrize("left, right, a, b, least", CASES)
def test_pairs_agree_with_walking_the_diagonals(spark, left, right, a, b, least):
    assert analyze_pair(spark, letters(left), letters(right), least, a, b) == naive(letters(left), letters(right), a, b, least)


def test_stated_numbers(spark):
    got = analyze_pair(spark, [1, 2, 3, 4, 5], [9, 9, 2, 3, 4])["metrics"]
    assert (got["similarity"], got["total_left"], got["overlap_right"], got["longest_fragment"]) == (0.6, 5, 3, 3)
    assert analyze_pair(spark, letters("ABXCD"), letters("QABXCD"), 1, [(2, 3)], [(3, 4)])["metrics"]["similarity"] == 8 / 9
    a = analyze_lists(spark, [[7, 1, 2, 3], [1, 2, 3]], keep_matches=True)
    assert a.matches(1, 0) == [(0, 1, 3)] and a.matches(0, 1) == [(1, 0, 3)] and a.metrics(1, 0)["total_left"] == 3


def test_many_sequences_in_one_run_agree_pair_by_pair(spark):
    rng = random.Random(42)
    sequences = [[rng.randrange(4) for _ in range(rng.randrange(0, 25))] for _ in range(9)]
    ignored = [[(i, i + rng.randrange(3)) for i in rng.sample(range(max(1, len(s) - 3)), min(2, len(s) // 4))] for s in sequences]
    ignored = [[(a, min(b, len(s))) for a, b in r] for r, s in zip(ignored, sequences)]
    for least in (1, 3):
        a = analyze_lists(spark, sequences, ignored, least, keep_matches=True)
        assert (a.n_sequences, a.n_pairs, a.has_matches) == (9, 36, True)
        rows = {(r.left_id, r.right_id): r.asDict() for r in a.pairs.collect()}
        found = {}
        for r in a.found.collect():
            found.setdefault((r.left_id, r.right_id), []).append((r.left_start, r.right_start, r.length))
        assert len(rows) == 36
        for i, j in itertools.combinations(range(9), 2):
            want = naive(sequences[i], sequences[j], ignored[i], ignored[j], least)
            assert {k: rows[i, j][k] for k in want["metrics"]} == want["metrics"]
            assert sorted(found.get((i, j), [])) == want["matches"]


def test_keeping_matches_changes_no_metric_and_sides_can_be_swapped(spark):
    x, y = letters("ABCABDABC"), letters("ABABCX")
    a, b = analyze_lists(spark, [x, y], keep_matches=True), analyze_lists(spark, [x, y])
    assert a.metrics(0, 1) == b.metrics(0, 1)
    with pytest.raises(ValueError):
        b.matches(0, 1)
    swapped = analyze_pair(spark, y, x)
    assert swapped["matches"] == sorted((r, l, n) for l, r, n in analyze_pair(spark, x, y)["matches"])
    for bad in ((0, 0), (0, 2)):
        with pytest.raises(IndexError):
            a.metrics(*bad)


def test_first_broken_rule_is_the_error(spark):
    with pytest.raises(InvalidSequences, match="two sequences"):
        analyze_lists(spark, [[1]], min_match_length=0)
    with pytest.raises(InvalidSequences, match="min_match_length"):
        analyze_lists(spark, [[1], [2**63 - 1]], min_match_length=0)
    with pytest.raises(InvalidSequences, match="reserved"):
        analyze_lists(spark, [[1], [2**63 - 1]])
    with pytest.raises(InvalidSequences, match="one list"):
        analyze_lists(spark, [[1], [2]], [[]])
    for r in ((1, 0), (0, 2)):
        with pytest.raises(InvalidSequences, match="range"):
            analyze_lists(spark, [[1], [2]], [[r], []])
    table, ids = table_of(spark, [[1], [2]])
    with pytest.raises(InvalidSequences, match="isn't there"):
        analyze(table, spark.createDataFrame([(9, 0, 1)], "file_id bigint, start int, end int"), ids=ids)
    with pytest.raises(InvalidSequences, match="reserved"):
        analyze(spark.createDataFrame([(0, 0, -1), (1, 0, 1)], "file_id bigint, idx int, h bigint"))
