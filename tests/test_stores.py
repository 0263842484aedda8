"""Stored decks and incremental ingest: deletions, compaction, failures, restarts and replays."""

import os

import pytest

from corpusdeck.sources import sinks as W

DECK = "user_id string, deck_id string, title string, created_at int"


def titles(spark, path, user=None):
    return sorted((x.user_id, x.deck_id, x.title) for x in W.live_decks(spark, path, user).collect())


def test_saves_deletions_and_lists(spark, tmp_path):
    path = str(tmp_path / "decks")
    rows = [("u1", "d1", "old", 1), ("u1", "d2", "new", 2), ("u2", "d3", "other", 3), ("../x", "d4", "bad", 4), ("u1", "a/b", "bad", 5), ("007", "d1", "agent", 6), (None, "d9", "nobody", 7)]
    W.save_decks(spark.createDataFrame(rows, DECK), path)
    live = W.live_decks(spark, path)
    assert live.columns == ["user_id", "deck_id", "title", "created_at"] or set(live.columns) == {"user_id", "deck_id", "title", "created_at"}
    assert [r.title for r in W.list_decks(live, "u1").orderBy("rank").collect()] == ["new", "old"] and live.count() == 4
    assert W.get_deck(live, "u2", "d1").count() == 0 and W.list_decks(live, "nobody").count() == 0
    assert W.delete_deck(spark, path, "u1", "d1") and not W.delete_deck(spark, path, "u1", "d1")
    assert titles(spark, path) == [("007", "d1", "agent"), ("u1", "d2", "new"), ("u2", "d3", "other")]
    assert titles(spark, path, "007") == [("007", "d1", "agent")]


def test_versions_order_saves_and_deletions(spark, tmp_path):
    path = str(tmp_path / "decks")
    deck = lambda title: spark.createDataFrame([("u", "d", title, 1)], DECK)
    W.save_decks(deck("first"), path, 10)
    W.delete_decks(deck("x"), path, 20)
    assert titles(spark, path) == []
    W.save_decks(deck("late"), path, 15)  # a save that is older than the deletion
    assert titles(spark, path) == []
    W.save_decks(deck("again"), path, 30)
    W.save_decks(deck("again"), path, 30)  # the same job run twice
    W.delete_decks(deck("x"), path, 30)
    assert titles(spark, path) == [("u", "d", "again")]  # of one version the save stays


def test_compaction_loses_nothing_when_it_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "decks")
    W.save_decks(spark.createDataFrame([("u", f"d{i}", "t", i) for i in range(9)], DECK), path, 1)
    W.delete_decks(spark.createDataFrame([("u", "d1", "", 0)], DECK), path, 2)
    before = titles(spark, path)
    with monkeypatch.context() as m:
        m.setattr(W, "rename", lambda *a: (_ for _ in ()).throw(OSError("lost between write and swap")))
        with pytest.raises(OSError):
            W.compact(spark, path)
    drafts = [x for x in os.listdir(f"{path}/base") if x.startswith("draft-")]
    assert len(drafts) == 1 and titles(spark, path) == before
    assert W.compact(spark, path) == 2 and titles(spark, path) == before and W.compact(spark, path) == 2
    W.save_decks(spark.createDataFrame([("u", "d1", "back", 1), ("v", "new", "t", 1)], DECK), path, 3)
    after = titles(spark, path)
    assert len(after) == 10 and W.compact(spark, path) == 3 and titles(spark, path) == after
    assert W.vacuum(spark, path) == 2 and titles(spark, path) == after and os.listdir(f"{path}/base") == ["upto=3"]


def test_recent_versions_stay_in_the_log(spark, tmp_path):
    """A job that began before the compaction and commits after it is not lost."""
    path = str(tmp_path / "decks")
    W.save_decks(spark.createDataFrame([("u", "d1", "t", 1)], DECK), path, 1)
    W.save_decks(spark.createDataFrame([("u", "d2", "t", 1)], DECK), path)
    began = W._version(None) - 1000
    assert W.compact(spark, path) == 1
    W.save_decks(spark.createDataFrame([("u", "d3", "t", 1)], DECK), path, began)
    assert [x[1] for x in titles(spark, path)] == ["d1", "d2", "d3"]


def test_a_base_is_read_instead_of_the_log_before_it(spark, tmp_path):
    path = str(tmp_path / "decks")
    W.save_decks(spark.createDataFrame([("u", "d1", "t", 1), ("v", "d1", "t", 1)], DECK), path, 1)
    W.compact(spark, path)
    W.save_decks(spark.createDataFrame([("u", "d2", "t", 1)], DECK), path, 2)
    plan = W.live_decks(spark, path, "u")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(_version,1)" in plan and "PartitionFilters: [isnotnull(_shelf" in plan
