import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.functions.keys import micros
from codeloom.operators import orphans
from codeloom.operators.orphans import Parent, Reference, _search, find_orphans, orphan_report

T = dt.datetime
USERS = "id string, created_at bigint, updated_at bigint, h string, rng int"
REFS = "id string, repo_name string, user_id string, created_at bigint, salt int, key string, reason string"
LOG = "entity string, record_id string, deleted_at timestamp_ntz, k string"
MS = lambda day: int(T(2025, 1, day, tzinfo=dt.timezone.utc).timestamp() * 1000)


def run(spark, users, refs, log, folders=(), moved=()):
    ms = lambda c: F.col(c) * 1000
    folder_rows = spark.createDataFrame(list(folders), "repo_name string, id string, created_at timestamp_ntz, updated_at timestamp_ntz")
    moved_rows = spark.createDataFrame(list(moved), "repo_name string, doc_name string, folder_id string, moved_at timestamp_ntz")
    parents = [Parent("users", spark.createDataFrame(users, USERS), "id", ms("created_at"), ms("updated_at")), Parent("folders", folder_rows, "id", micros("created_at"), micros("updated_at"), "repo_name")]
    references = [Reference("chat_sessions", "users", spark.createDataFrame(refs, REFS), "user_id", "id", ms("created_at")), Reference("document_folders", "folders", moved_rows, "folder_id", "doc_name", micros("moved_at"))]
    return find_orphans(references, parents, spark.createDataFrame(list(log), LOG))


def ref(i, user, day=15):
    return (i, "r", user, None if day is None else MS(day), 1, "x", "y")


def test_reasons(spark, rows):
    users = [("U1", MS(1), MS(2), "a", 1), ("u1 ", MS(3), MS(20), "a", 1), ("u2", MS(1), MS(2), None, None), ("u3", MS(20), MS(21), None, None), (None, None, None, None, None)]
    refs = [ref("ok", "\tu1"), ref("deleted", "U2"), ref("late", "u3 "), ref("missing", "u9"), ref("gone", "u8"), ref("blank", "  "), ref("null", None), ref("timeless", "u3", None), ref("missing", "u9")]
    log = [("users", "u1", T(2025, 1, 10), None), (" Users", " U2 ", T(2025, 1, 10), None), ("users", "u8", T(2025, 1, 1), None), ("folders", "u1", T(2026, 1, 1), None), ("users", None, T(2025, 1, 1), None)]
    got = rows(run(spark, users, refs, log), "row_key", "reason", "period")
    assert got == [("deleted", "deleted", "2025-01"), ("gone", "deleted", "2025-01"), ("late", "late", "2025-01"), ("missing", "missing", "2025-01")]


def test_a_row_without_time_has_no_period(spark, rows):
    assert rows(run(spark, [], [ref("x", "u9", None)], []), "row_key", "reason", "period") == [("x", "missing", None)]


def test_folders_resolve_in_their_repository(spark, rows):
    folders = [("a", "F1", T(2025, 1, 1), T(2025, 1, 2))]
    moved = [("a", "d1", " f1", T(2025, 2, 1)), ("b", "d2", "f1", T(2025, 2, 1)), ("a", "d3", "f1", T(2024, 1, 1))]
    assert rows(run(spark, [], [], [], folders, moved), "row_key", "reason") == [("d2", "missing"), ("d3", "late")]


def test_empty_tables(spark):
    assert run(spark, [], [], []).collect() == []
    assert orphan_report(run(spark, [], [], [])).collect() == []


def test_hot_keys_are_split_and_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_ROWS", 7)
    refs = [ref(f"r{i}", "hot" if i % 3 else f"u{i}") for i in range(120)]
    users = [(f"u{i}", MS(1), MS(2), None, None) for i in range(0, 120, 2)]
    want = sorted((f"r{i}",) for i in range(120) if i % 3 or i % 2)
    assert sorted(rows(run(spark, users, refs, []), "row_key")) == want


@pytest.mark.parametrize("n", [0, 1, 50])
def test_search_verifies_equal_hashes(n):
    hashes = np.sort(np.random.default_rng(n).integers(0, 5, n))
    keys = np.array([f"k{i}" for i in range(n)], object)
    wanted = np.array([h for h in hashes] + [9, 0])
    names = np.array([*keys, "none", "other"], object)
    assert list(_search(hashes, keys, wanted, names)) == [*range(n), -1, -1]
