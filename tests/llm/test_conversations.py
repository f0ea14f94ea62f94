import random
from datetime import datetime, timedelta

import pytest

from weftlake.llm import conversations as C

SCHEMA = "message_id long, session_id string, role string, content string, created_at timestamp, speaker string, part string"
T0 = datetime(2021, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def brute(rows):
    """Sessions and their defect, one message after another."""
    sessions = {}
    for m, s, role, content, at in sorted(set(rows), key=lambda r: (r[4] is None, r[4] or T0, r[0])):
        if s is None:
            continue
        sessions.setdefault(s, [])
        if (role or "").strip().lower() != "system":
            who = {"user": "u", "human": "u", "assistant": "a", "bot": "a", "model": "a", "ai": "a"}.get((role or "").strip().lower())
            sessions[s].append((who, bool(content and content.strip()), at))
    out = {}
    for s, ms in sessions.items():
        whos = [w for w, _, _ in ms]
        if not any(c for _, c, _ in ms):
            out[s] = "empty"
        elif None in whos or any(a is None for _, _, a in ms) or whos[0] != "u" or "aa" in "".join(whos):
            out[s] = "broken"
        elif any(w == "u" and not (i + 1 < len(ms) and ms[i + 1][:2] == ("a", True)) for i, w in enumerate(whos)):
            out[s] = "no_reply"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(120):
        t = T0 + timedelta(minutes=rng.randrange(20_000))
        for i in range(rng.choice([1, 2, 2, 4, 8])):
            t += timedelta(minutes=rng.choice([0, 1, 30, 600]))
            role = ("user" if i % 2 == 0 else "Assistant ") if rng.random() > 0.05 else rng.choice(["bot", "human", None, "?", "SYSTEM"])
            rows.append((len(rows), f"s{s}", role, rng.choice(["hi", "hi", "hi", "hi", " ", None, "　"]) if rng.random() < 0.4 else "text", t if rng.random() > 0.02 else None))
    rows += rng.sample(rows, 20) + [(9999, None, "user", "x", T0)]
    got = {r.session_id: r.defect for r in C.dropped_sessions(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_one_long_session_in_order(spark):
    rows = [(i, "s", "user" if i % 2 == 0 else "ai", str(i), T0 + timedelta(minutes=20 * i)) for i in range(400)]
    random.Random(1).shuffle(rows)
    got = C.conversations(frame(spark, rows), window_s=3600).orderBy("position").collect()
    assert [r.content for r in got] == [str(i) for i in range(400)] and [r.position for r in got] == list(range(1, 401))


def test_ties_in_time_go_by_message_id(spark):
    rows = [(2, "s", "assistant", "b", T0), (1, "s", "user", "a", T0)]
    assert C.dropped_sessions(frame(spark, rows)).collect() == []


def test_only_system_rows_make_an_empty_session(spark):
    rows = [(1, "s", " System", "rules", T0), (2, "t", "system", None, None), (3, "u", "system", "rules", T0), (4, "u", "user", "a", T0), (5, "u", "bot", "b", T0)]
    assert {tuple(r) for r in C.dropped_sessions(frame(spark, rows)).collect()} == {("s", "empty"), ("t", "empty")}
    assert [(r.session_id, r.position, r.content) for r in C.conversations(frame(spark, rows)).orderBy("position").collect()] == [("u", 1, "a"), ("u", 2, "b")]


def test_pointers_decide_what_is_broken(spark):
    """A lost segment takes along what follows it; its session is broken by the state that pointer jumping found."""
    rows = [(1, "s", "ai", "a", T0), (2, "s", "user", "b", T0 + timedelta(hours=3)), (3, "s", "ai", "c", T0 + timedelta(hours=6))]
    placed, sessions = C.judged(C.ordered_messages(frame(spark, rows)))
    assert {r.state for r in placed.collect()} == {"orphan"} and sessions.first().defect == "broken"


def test_empty_table(spark):
    assert C.dropped_sessions(frame(spark, [])).collect() == [] and C.conversations(frame(spark, [])).collect() == []


def test_resolve_parents(spark):
    nodes = [(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 5), (7, 8), (8, 7), (9, 9), (10, 7)] + [(100 + i, 99 + i if i else None) for i in range(200)]
    got = {r.id: r for r in C.resolve_parents(spark.createDataFrame(nodes, "id long, up long"), "id", "up").collect()}
    assert len(got) == len(nodes)
    assert [(got[i].root, got[i].offset, got[i].state) for i in (1, 4, 5, 6)] == [(1, 0, "root"), (1, 3, "child"), (5, 0, "orphan"), (5, 1, "orphan")]
    assert {got[i].state for i in (7, 8, 9, 10)} == {"cycle"} and got[7].root is None
    assert (got[299].root, got[299].offset) == (100, 199)
    assert C.resolve_parents(spark.createDataFrame([], "id long, up long"), "id", "up").collect() == []
