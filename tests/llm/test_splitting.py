import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm.splitting import oversized, penalties, pieces, split_lines, UNEVEN

TASK = "task_id bigint, qualified_name string, repo_name string, file_path string, start_line int, end_line int, created_at double, v int, code string, all int"
FILE = "file_id bigint, repo_name string, file_path string, code string, last_modified timestamp_ntz, lines int, qualified_name string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["", "x = 1", "    y()", "def f():", "}", "foo(", "  )"]), max_size=150), st.integers(5, 40), st.integers(0, 4))
def test_pieces_cover_and_overlap(lines, limit, overlap):
    got = split_lines(lines, limit, overlap)
    if not lines:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(lines)
    for k, (a, b) in enumerate(got):
        assert 0 < b - a <= limit
        assert not k or (a == got[k - 1][1] - overlap and b > got[k - 1][1])


def test_the_cheapest_cut_by_brute_force():
    rnd = random.Random(4)
    for _ in range(30):
        lines = [rnd.choice(["", "def f():", "    x = (", "    )", "    return 1", "y = 2"]) for _ in range(rnd.randrange(8, 14))]
        limit, overlap, n = 6, 2, len(lines)
        cost = [0, *penalties(lines), 0]
        count = 1 + -(-(n - limit) // (limit - overlap))
        even = (n + overlap * (count - 1)) / count

        def price(ends):
            total, last = 0.0, 0
            for e in ends:
                size = e - last + (overlap if last else 0)
                if size > limit or (not last and e <= overlap):
                    return float("inf")
                total += cost[e] + UNEVEN * ((size - even) / limit * 4) ** 2
                last = e
            return total

        best = min(price([*(i + 1 for i in range(n - 1) if mask >> i & 1), n]) for mask in range(1 << (n - 1)))
        assert price([b for _, b in split_lines(lines, limit, overlap)]) == pytest.approx(best)


def test_cuts_before_definitions():
    block = ["def f(a):", *["    a += 1"] * 17, "    return a", ""]
    got = split_lines(block * 4)
    assert [b for _, b in got][:-1] == [20, 40, 60] or all(b % 20 == 0 for _, b in got)


def task(i, qn, a, b, at=1.0, path="f"):
    return (i, qn, "r", path, a, b, at, 0, "c", 0)


def test_found(spark, rows):
    code = "\n".join(f"l{i}" for i in range(1, 101))
    files = spark.createDataFrame([(1, "r", "f", code + "\r\n", None, 0, "q"), (2, "r", "f", code + "\r\n", None, 0, "q"), (3, "r", "null", None, None, 0, "q"), (4, "r", "empty", "", None, 0, "q"), (None, None, None, None, None, None, None)], FILE)
    tasks = [
        task(1, "long", 1, 100), task(2, "beyond", 61, 999), task(3, "beyond2", 60, 999), task(4, "short", 1, 40), task(5, "reversed", 50, 1), task(6, "zero", 0, 90), task(7, "gone", 1, 90, path="nofile"), task(8, "null", 1, 90, path="null"), task(9, "empty", 1, 90, path="empty"),
        task(10, "again", 1, 90, 1.0), task(11, "again", 1, 5, 2.0), task(12, "tie", 1, 5, 1.0), task(13, "tie", 1, 90, 1.0), task(14, "timeless", 1, 90, None), task(15, "timeless", 1, 5, 0.0), task(16, None, 1, 90), task(17, "none", None, 90), task(18, "41", 10, 50), task(18, "41", 10, 50),
    ]
    found = pieces(oversized(spark.createDataFrame(tasks, TASK), files))
    assert rows(found.where("piece_no = 1"), "qualified_name") == [("41",), ("beyond2",), ("long",), ("tie",)]
    own = [r for r in sorted(found.where("qualified_name = 'long'").collect(), key=lambda r: r["piece_no"])]
    assert [r["piece_no"] for r in own] == list(range(1, len(own) + 1))
    assert own[1]["code"].split("\n")[:4] == own[0]["code"].split("\n")[-4:] and own[-1]["code"].endswith("l100")


def test_empty_tables(spark):
    assert pieces(oversized(spark.createDataFrame([], TASK), spark.createDataFrame([], FILE))).collect() == []
