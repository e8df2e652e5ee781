import datetime as dt
import os
import random
import shutil

import pytest

from codeloom.llm.conversations import conversations, replay

MESSAGE = "id string, session_id string, role string, content string, metadata_json string, created_at bigint, received_at timestamp_ntz, session_key string, keys int, shard int"
SESSION = "id string, user_id string, session_key string"
T0 = 1_750_000_000_000


def msg(i, session, role, at, content="text", unit=1):
    return (i, session, role, content, None, None if at is None else (T0 + at * 1000) // unit, None if at is None else dt.datetime(2025, 6, 15) + dt.timedelta(seconds=at), "x", 1, 1)


SESSIONS = ("s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9")


def known(spark, sessions):
    return spark.createDataFrame([(s, "u", "k") for s in sessions], SESSION)


def written(spark, folder, batches, step=7200):
    """One file for each list of messages, landed so many seconds after one another."""
    folder.mkdir()
    for i, messages in enumerate(batches):
        spark.createDataFrame(messages, MESSAGE).coalesce(1).write.parquet(str(folder / f"b{i}"))
        part = next((folder / f"b{i}").glob("*.parquet"))
        part.rename(folder / f"f{i}.parquet")
        shutil.rmtree(folder / f"b{i}")
        for f in folder.glob(".*crc"):
            f.unlink()
        os.utime(folder / f"f{i}.parquet", (T0 // 1000 + i * step,) * 2)
    return str(folder)


def run(spark, tmp_path, messages, sessions=SESSIONS, files=2):
    spark.createDataFrame(messages, MESSAGE).repartition(files).write.parquet(str(tmp_path / "m.parquet"))
    return conversations(spark, str(tmp_path / "m.parquet"), known(spark, sessions))


def brute(messages, sessions):
    """Exchanges of the sound sessions, by walking over each."""
    held = {}
    roles = {"user": "u", "human": "u", "assistant": "a", "ai": "a", "bot": "a", "system": "s"}
    for i, session, role, content, _, t, *_ in messages:
        m = held.setdefault((session or "").strip().lower(), {}).setdefault(i, [None, None, False])
        m[0] = roles.get((role or "").strip().lower()) or m[0]
        m[1] = max(x for x in (t, m[1]) if x is not None) if t or m[1] else None
        m[2] = m[2] or bool((content or "").strip(" \u200b"))
    out = set()
    for name in sessions:
        turns = held.get(name.strip().lower(), {})
        if not turns or None in turns or not all(r and t and seen for r, t, seen in turns.values()):
            continue
        line = sorted((t, r != "u", i, r) for i, (r, t, _) in turns.items() if r != "s")
        if len(line) > 1 and len(line) % 2 == 0 and all(x[3] == "ua"[k % 2] for k, x in enumerate(line)):
            out |= {(name, line[k][2], line[k + 1][2]) for k in range(0, len(line), 2)}
    return out


def test_sound_and_broken(spark, tmp_path, rows):
    m = [
        msg("a1", "s1", "user", 1), msg("a2", " S1", "Assistant ", 2), msg("a3", "s1", "human", 3), msg("a4", "\ts1", "BOT", 4), msg("a0", "s1", "system", 0), msg("a2", "s1", "ai", 2, ""), msg("a2", "s1", "assistant", 2, None),
        msg("b1", "s2", "user", 5), msg("b2", "s2", "ai", 5), msg("c1", "s3", "user", 1), msg("d1", "s4", "assistant", 1), msg("d2", "s4", "user", 2), msg("e1", "s5", "user", 1), msg("e2", "s5", "assistant", 2, " \u200b "),
        msg("f1", "s6", "user", 1), msg("f2", "s6", "tool", 2), msg("f3", "s6", "assistant", 3), msg("g1", "s7", "user", 1), msg("g2", "s7", "assistant", None), msg("h1", "s8", "user", 1), msg("h2", "s8", "user", 2), msg("h3", "s8", "assistant", 3),
        msg("i1", "unknown", "user", 1), msg("i2", "unknown", "assistant", 2), msg("j1", None, "user", 1), msg(None, "s9", "user", 1), msg("k1", "s9", "user", 2), msg("k2", "s9", "ai", 3), msg("l1", "s10", "user", 1, unit=1000), msg("l2", "S10 ", "assistant", 2),
    ]
    got = run(spark, tmp_path, m, ["s1", "s2", "s3", "s4", "s5", "s6", "s7", "s8", "s9", "S10", "S10", None])
    assert rows(got) == [("S10", "l1", "l2"), ("s1", "a1", "a2"), ("s1", "a3", "a4"), ("s2", "b1", "b2")]


def random_messages(seed, sessions=25):
    rnd, messages = random.Random(seed), []
    for s in range(sessions):
        for i in range(rnd.choice([2, 4, 6, 40])):
            role = ("user", "assistant")[i % 2] if rnd.random() < 0.97 else "user"
            messages += [msg(f"m{s}-{i}", f"s{s}", role, i, rnd.choice(["text", "text", "text", "", None]) if c else "text") for c in range(rnd.choice([1, 1, 2]))]
    rnd.shuffle(messages)
    return messages, [f"s{i}" for i in range(sessions)]


def test_random_sessions_in_any_order(spark, tmp_path):
    messages, sessions = random_messages(1)
    got = {tuple(r) for r in run(spark, tmp_path, messages, sessions, 4).collect()}
    assert got == brute(messages, sessions) and got


@pytest.mark.parametrize(("batches", "step"), [(2, 7200), (3, 60), (5, 7200), (4, -7200)])
def test_the_number_and_order_of_micro_batches_change_nothing(spark, tmp_path, batches, step):
    messages, sessions = random_messages(batches)
    path = written(spark, tmp_path / "m", [messages[i::batches] for i in range(batches)], step)
    got = {tuple(r) for r in conversations(spark, path, known(spark, sessions), files=1).collect()}
    assert got == brute(messages, sessions) and got


def test_late_rows_revise_what_was_closed(spark, tmp_path, rows):
    first = [msg("a1", "s1", "user", 1_000_000), msg("a2", "s1", "ai", 1_000_001), msg("b1", "s2", "user", 1_000_000), msg("c1", "s3", "user", 5), msg("c2", "s3", "ai", 6)]
    second = [msg("z1", "s9", "user", 9_000_000), msg("z2", "s9", "ai", 9_000_001)]
    third = [msg("b2", "s2", "ai", 1_000_002), msg("d1", "s4", "user", 1), msg("d2", "s4", "ai", 2), msg("c3", "s3", "user", 3)]  # old, and one that makes s3 unsound
    path = written(spark, tmp_path / "m", [first, second, third])
    store = replay(spark, path, files=1)
    # what the first period's closing gave at its time, and what is right in the end
    early = store.read("exchanges", "session_key string, user_message_id string, reply_message_id string")
    assert ("s3", "c1", "c2") in rows(early, "session_key", "user_message_id", "reply_message_id") and early.select("batch").distinct().count() >= 3
    assert rows(conversations(spark, path, known(spark, SESSIONS), files=1)) == [("s1", "a1", "a2"), ("s2", "b1", "b2"), ("s4", "d1", "d2"), ("s9", "z1", "z2")]


def test_one_session_with_a_third_of_all_rows(spark, tmp_path):
    messages = [msg(f"h{i:05d}", "s1", ("user", "ai")[i % 2], i // 2) for i in range(3000)] + [msg(f"x{s}-{i}", f"t{s}", ("user", "ai")[i], i) for s in range(500) for i in range(2)]
    sessions = ["s1", *(f"t{s}" for s in range(500))]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "97")  # so that the session also runs over many batches of a task
    try:
        got = {tuple(r) for r in run(spark, tmp_path, messages, sessions).collect()}
    finally:
        spark.conf.unset(size)
    assert got == brute(messages, sessions) and len(got) == 2000


def test_no_messages(spark, tmp_path):
    assert run(spark, tmp_path, [], files=1).collect() == []
    spark.createDataFrame([msg("a", "s1", "user", 1)], MESSAGE).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    assert conversations(spark, str(tmp_path / "one.parquet"), spark.createDataFrame([], SESSION)).collect() == []
