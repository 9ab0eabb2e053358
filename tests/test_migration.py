"""The five-table move against plain Python, its order, and what a second run finds."""

import pytest

from folioscope.sources import tables as T

MOVES = [T.Move("pets", parents={"team_id": "teams", "event_id": "events"}), T.Move("events"),
         T.Move("teams", natural=("team_name",), generates=True, stripped=("team_name",))]


def tables(spark):
    source = {
        "teams": spark.createDataFrame([("1", " b ", '["x","y"]'), ("2", "a", "[]"), ("3", "b", '["z"]'), ("4", "c", None)],
                                       "id string, team_name string, members string"),
        "events": spark.createDataFrame([("7", "2024-01-02T03:04:05Z"), ("8", "bad")], "id string, at string"),
        "pets": spark.createDataFrame([("1", "1", "7"), ("2", "3", None), ("3", None, "8"), ("4", "9", "7"), ("5", "2", "99"),
                                       ("6", "4", "8")], "id string, team_id string, event_id string")}
    target = {
        "teams": spark.createDataFrame([(50, "c", ["old"])], "id long, team_name string, members array<string>"),
        "events": spark.createDataFrame([], "id long, at timestamp"),
        "pets": spark.createDataFrame([(6, 50, 8)], "id long, team_id long, event_id long")}
    return source, target


def test_cascade(spark, rows):
    source, target = tables(spark)
    moved = T.migrate_cascade(MOVES, source, target)
    assert list(moved) == ["events", "teams", "pets"] or list(moved) == ["teams", "events", "pets"]
    assert rows(moved["teams"].inserted) == [(51, "b", ["x", "y"]), (52, "a", [])]
    assert rows(moved["teams"].keys) == [(1, 51), (2, 52), (3, 51), (4, 50)]
    assert sorted(rows(moved["pets"].inserted, "id", "team_id", "event_id"), key=str) == [(1, 51, 7), (2, 51, None), (3, None, 8)]
    assert [r[0] for r in rows(moved["pets"].orphans)] == [4, 5]
    assert [(r.id, r["at"] is None) for r in moved["events"].inserted.orderBy("id").collect()] == [(7, False), (8, True)]
    after = {n: target[n].unionByName(m.inserted) for n, m in moved.items()}
    again = T.migrate_cascade(MOVES, source, after)
    assert all(m.inserted.count() == 0 for m in again.values())
    found = {r.table_name: r for r in T.reconcile_cascade(MOVES, source, target, moved).collect()}
    assert (found["pets"].source_count, found["pets"].target_count, found["pets"].orphan_count) == (6, 4, 2)
    assert found["events"].matches and found["events"].contents_match
    assert found["teams"].source_count == 4 and found["teams"].target_count == 3 and not found["teams"].contents_match


def test_checksums_find_a_changed_row_and_ignore_order_and_keys(spark):
    moves = [T.Move("teams", natural=("team_name",), generates=True)]
    source = {"teams": spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, team_name string, note string")}
    for note, same in ((None, True), ("", False)):
        target = {"teams": spark.createDataFrame([(9, "b", note), (8, "a", "x")], "id long, team_name string, note string")}
        row = T.reconcile_cascade(moves, source, target, T.migrate_cascade(moves, source, target)).first()
        assert row.matches and row.contents_match == same


def test_empty_tables_and_circles(spark):
    source, target = tables(spark)
    moved = T.migrate_cascade(MOVES, {n: d.limit(0) for n, d in source.items()}, target)
    assert all(m.inserted.count() + m.orphans.count() == 0 for m in moved.values())
    with pytest.raises(ValueError, match="refer"):
        T.in_parent_order([T.Move("a", parents={"x": "b"}), T.Move("b", parents={"y": "a"})])
