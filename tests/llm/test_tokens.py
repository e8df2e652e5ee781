import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import tokenids
from codeloom.llm.packing import Bins, pack
from codeloom.llm.tokenids import cuts, encoding, joins, token_counts, token_ids

SCHEMA = "doc_id bigint, text string, h string, ids int, idx int, dh string, n int"
ENC = encoding()


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 1, "x", 1) for i, t in enumerate(texts)], SCHEMA)


def rebuilt(text, ends):
    out, last = [], 0
    for k, (head, tail, put) in enumerate(joins(text, ends, ENC)):
        out += put
        if k < len(ends):
            if head >= 0:
                ids = ENC.encode_ordinary(text[last : ends[k]])
                out += ids[head : len(ids) - tail]
            last = ends[k]
    return out


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab 1'sStT\n\t\u00a0\u00e9\u4e2d.-\u0300\U0001f44d"), min_size=1, max_size=60), st.lists(st.integers(1, 60), max_size=12))
def test_joins_repair_any_cut(text, places):
    ends = sorted({p for p in places if p < len(text)}) + [len(text)]
    assert rebuilt(text, ends) == ENC.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 40_000, " " * 40_000, "'s" * 9_000, "ab c" * 9_000, "\n" * 20_000, "<|endoftext|>" * 3000])
def test_long_runs(text):
    assert rebuilt(text, cuts([text])[0]) == ENC.encode_ordinary(text)


def test_cuts_cover_and_follow_content():
    rnd = random.Random(1)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    a, b = "x" * 777 + shared, "y" * 1301 + shared
    (ca, cb), single = cuts([a, b]), cuts([a])
    assert ca == single[0] and ca[-1] == len(a) and all(0 < y - x <= tokenids.MOST for x, y in zip([0, *ca], ca, strict=False))
    own = {a[x:y] for x, y in zip([0, *ca], ca, strict=False)}
    assert sum(b[x:y] in own for x, y in zip([0, *cb], cb, strict=False)) > 0.8 * len(cb)


def test_ids_and_counts(spark):
    rnd = random.Random(2)
    part = "".join(rnd.choice("abc d\n") for _ in range(9000))
    texts = [None, "", " ", "hello <|endoftext|>", part, "x" + part, part + "\u4e2d\u6587", "z" * 100_000, part]
    got = dict(token_ids(docs(spark, texts)).collect())
    assert got == {i: ENC.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_tokens"], r["copies"]) for r in token_counts(docs(spark, texts)).collect()} == {i: (len(ids), 1) for i, ids in got.items()}


def test_repeated_rows_and_empty_table(spark):
    twice = docs(spark, ["some text", None]).unionAll(docs(spark, ["some text", None]))
    assert sorted(token_ids(twice).collect()) == sorted(token_ids(docs(spark, ["some text", None])).collect())
    assert {(r["doc_id"], r["copies"]) for r in token_counts(twice).collect()} == {(0, 2), (1, 2)}
    assert token_ids(docs(spark, [])).collect() == [] and token_counts(docs(spark, [])).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200), st.integers(1, 8))
def test_bins_hold_what_fits(sizes, most_open):
    bins, load = Bins(50, most_open), {}
    for s in sizes:
        b = bins.place(s)
        load[b] = load.get(b, 0) + s
        assert load[b] <= 50 and bins.open <= most_open
    assert sorted(load) == list(range(bins.made))


def test_best_fit_takes_the_fullest_that_fits():
    bins = Bins(10)
    assert [bins.place(s) for s in (6, 7, 3, 4, 10, 1)] == [0, 1, 1, 0, 2, 3]


@pytest.mark.parametrize("per_task", [1000, 40])
def test_containers(spark, per_task):
    rnd = random.Random(3)
    sizes = {f"d{i}": rnd.choice([0, 1, 5, 60, 100, 101, 250, rnd.randrange(1, 100)]) for i in range(400)}
    rows = pack(spark.createDataFrame(list(sizes.items()), "item string, size bigint"), 100, most_open=8, per_task=per_task).collect()
    load, per_item = {}, {}
    for r in rows:
        per_item.setdefault(r["item"], []).append((r["piece_no"], r["start"], r["size"]))
        if r["container_id"] is None:
            assert r["size"] == 0
        else:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["size"]
    assert max(load.values()) <= 100 and set(per_item) == set(sizes)
    for item, pieces in per_item.items():
        assert [p[0] for p in sorted(pieces)] == list(range(len(pieces))) and sum(p[2] for p in pieces) == sizes[item]
        assert len(pieces) == max(1, -(-sizes[item] // 100))
    assert sum(sizes.values()) / (100 * len(load)) > 0.9


def test_no_items(spark):
    assert pack(spark.createDataFrame([], "item string, size bigint"), 100).collect() == []
