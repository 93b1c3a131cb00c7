"""Every verdict, on small hand-made pairs; chunk borders included."""

import pytest

from rowdeck.operators import verify


def frame(spark, values, kind="bigint"):
    return spark.createDataFrame(list(enumerate(values)), f"pos bigint, value {kind}")


def audit(spark, a, b, kind="bigint"):
    return verify.shuffle_audit(frame(spark, a, kind), frame(spark, b, kind)).first()


@pytest.mark.parametrize(
    "before,after,verdict",
    [
        ([3, 1, 2], [2, 3], "length differs"),
        ([3, 1, 2], [3, 1, 4], "elements differ"),
        ([3, 1, 2], [3, 1, 2], "identical"),
        ([3, 1, 2], [1, 2, 3], "sorted"),
        ([3, 1, 2], [2, 3, 1], "passed"),
        ([1, 1, 2], [2, 1, 2], "passed"),  # the set check does not see counts
        ([], [], "identical"),
        ([1], [1], "identical"),
    ],
)
def test_verdicts(spark, before, after, verdict):
    assert audit(spark, before, after)["verdict"] == verdict


def test_counts_are_seen_by_the_multiset_check(spark):
    row = audit(spark, [1, 1, 2], [2, 1, 2])
    assert row["set_ok"] and not row["multiset_ok"]


def test_nulls_are_values(spark):
    row = audit(spark, [None, 1, 2], [1, None, 2])
    assert row["multiset_ok"] and row["pct_moved"] == pytest.approx(200 / 3)


def test_empty_percentage_is_null(spark):
    empty = frame(spark, [])
    assert verify.shuffle_percentage(empty, empty, "pos", "value").first()["pct_moved"] is None
    assert audit(spark, [], [])["pct_moved"] is None


def test_percentage_of_shorter_output(spark):
    """A position without a row does not hold its value."""
    row = verify.shuffle_percentage(frame(spark, [1, 2, 3, 4]), frame(spark, [2, 2]), "pos", "value").first()
    assert (row["n"], row["moved"], row["pct_moved"]) == (4, 3, 75.0)


@pytest.mark.parametrize("chunk", (1, 2, 3, 7, 1000))
def test_chunk_borders(spark, monkeypatch, chunk):
    monkeypatch.setattr(verify, "CHUNK_ROWS", chunk)
    before = [5, 3, 8, 8, 1, 9, 2, 7, 7, 6]
    after = [8, 5, 3, 8, 9, 1, 7, 2, 7, 6]
    report = verify.position_report(frame(spark, before), frame(spark, after), "pos", "value").first()
    assert report["pairs"] == 10
    assert report["moved"] == sum(a != b for a, b in zip(before, after))
    assert report["descents"] == sum(a > b for a, b in zip(after, after[1:]))
    assert verify.inversions(frame(spark, after), "pos", "value").first()[0] == report["descents"]
    longer = verify.position_report(frame(spark, before), frame(spark, after + [0, 4]), "pos", "value").first()
    assert (longer["pairs"], longer["descents"], longer["bad"]) == (10, report["descents"], 2)


@pytest.mark.parametrize("chunk", (1, 3, 1000))
def test_wrong_positions(spark, monkeypatch, chunk):
    monkeypatch.setattr(verify, "CHUNK_ROWS", chunk)
    before = frame(spark, list(range(20)))

    def verdict(rows):
        after = spark.createDataFrame(rows, "pos bigint, value bigint")
        row = verify.shuffle_audit(before, after).first()
        return row["bad_positions"], row["repeated"], row["verdict"]

    assert verdict([(19 - k, k) for k in range(20)]) == (0, 0, "passed")
    assert verdict([(k + 5, k) for k in range(20)]) == (5, 0, "positions wrong")
    assert verdict([(None if k % 2 else k, k) for k in range(20)]) == (10, 0, "positions wrong")
    assert verdict([(-1 if k == 4 else k, k) for k in range(20)]) == (1, 0, "positions wrong")
    assert verdict([(k // 2, k) for k in range(20)]) == (0, 10, "positions wrong")
    assert verdict([(7, k) for k in range(20)]) == (0, 19, "positions wrong")


def test_single_checks(spark):
    a, b = frame(spark, [9, 8, 7, 3, 4, 2, 1, 5, 5, 3]), frame(spark, [5, 8, 7, 3, 4, 2, 1, 9, 3, 3])
    assert verify.verify_set(a, b, "value").first()[0]
    assert not verify.verify_multiset(a, b, "value").first()[0]
    assert tuple(verify.verify_length(a, b, "value").first()) == (10, 10, True)
    row = verify.verify_elements(a, frame(spark, [9, 8, 7]), "value").first()
    assert tuple(row) == (7, False)
