from __future__ import annotations

import datetime as dt
import random

from corpusmill.llm.conversations import dialogues, dropped_chats, sitting_gap, stretches, turns_of

MESSAGE = "id string, chat_id string, role string, content string, created_at timestamp, at string, digest string"
T0 = dt.datetime(2025, 1, 1)


def tables(spark, chats, rows):
    made = [(str(i), c, r, t, None if s is None else T0 + dt.timedelta(seconds=s), "x", "y") for i, (c, r, t, s) in enumerate(rows)]
    return spark.createDataFrame([(c,) for c in chats], "id string"), spark.createDataFrame(made, MESSAGE)


def dropped(spark, chats, rows):
    return sorted(r[0] for r in dropped_chats(*tables(spark, chats, rows)).collect())


GOOD = [("user", "q", 0), ("assistant", "a", 5)]


def chat(name, turns):
    return [(name, *t) for t in turns]


def test_every_reason_to_drop(spark):
    cases = {
        "good": GOOD,
        "two answers": [*GOOD, ("assistant", "b", 9)],
        "same time": [("assistant", "a", 0), ("user", "q", 0)],
        "roles": [(" USER ", "q", 0), ("Assistant", "a", 1)],
        "repeat": [("user", "q", 0), ("user", "q", 9), ("assistant", "a", 12)],
        "invisible": [*GOOD, ("system", " ​﻿\n", 7), ("user", None, 8)],
    }
    bad = {
        "no reply": [("user", "q", 0)],
        "unanswered": [("user", "q", 0), ("user", "r", 1), ("assistant", "a", 2)],
        "assistant first": [("assistant", "a", 0), *[(r, t, s + 1) for r, t, s in GOOD]],
        "no time": [*GOOD, ("assistant", "b", None)],
        "odd role": [*GOOD, ("system", "x", 7)],
        "null role": [*GOOD, (None, "x", 7)],
        "late repeat": [("user", "q", 0), ("user", "q", 11), ("assistant", "a", 12)],
        "blank": [("user", " ", 0)],
        "far apart": [("user", "q", 0), ("user", "r", 9_000), ("assistant", "a", 99_000)],
    }
    rows = [r for name, turns in (cases | bad).items() for r in chat(name, turns)] + chat("orphan", GOOD) + chat(None, GOOD)
    random.Random(1).shuffle(rows)
    chats = [*cases, *bad, "silent", "good", None]
    assert dropped(spark, chats, rows) == sorted([*bad, "orphan", "silent"])


def brute(chats, rows):
    """The rules of the problem, read literally and one chat at a time."""
    out = set()
    for name in {c for c in chats} | {r[0] for r in rows}:
        own = [(s, 0 if r == "user" else 1, r, t) for c, r, t, s in rows if c == name]
        if name not in chats or not own:
            out.add(name)
            continue
        kept, last = [], {}
        for s, o, r, t in sorted(own):
            if (r, t) not in last or s - last[r, t] > 10:
                kept.append(r)
            last[r, t] = s
        if kept[0] == "assistant" or any(r == "user" and (i + 1 == len(kept) or kept[i + 1] == "user") for i, r in enumerate(kept)):
            out.add(name)
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(5)
    chats = [f"c{i}" for i in range(60)]
    rows = []
    for c in [*chats[:55], "ghost"]:
        s = 0
        for k in range(rng.randint(1, 12)):
            s += rng.choice([0, 1, 5, 10, 11, 400, 700, 5000])
            rows.append((c, rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[k % 2], rng.choice("ab"), s))
    assert dropped(spark, chats, rows) == brute(chats, rows)


def test_dialogues_are_ordered_and_complete(spark):
    rows = chat("a", [("user", "q", 0), ("assistant", "r", 0), ("user", "s", 700), ("user", "s", 705), ("assistant", "t", 90_000)]) + chat("b", [("user", "q", 0)])
    found = sorted(tuple(r)[:5] for r in dialogues(*tables(spark, ["a", "b"], rows), gap_micros=3_600_000_000).collect())
    assert found == [("a", 1, 1, "user", "q"), ("a", 2, 1, "assistant", "r"), ("a", 3, 1, "user", "s"), ("a", 4, 2, "assistant", "t")]


def test_empty_tables(spark):
    assert dropped(spark, [], []) == []
    assert dialogues(*tables(spark, [], [])).count() == 0


def test_gaps_over_midnight_are_measured(spark):
    rows = []
    for k in range(40):
        rows += chat(f"c{k}", [("user", "q", 0), ("assistant", "a", 5), ("user", "r", 5 + 86_000 + 60 * k), ("assistant", "b", 5 + 86_010 + 60 * k)])
    _, messages = tables(spark, [], rows)
    gap = sitting_gap(stretches(turns_of(messages)), share=0.9) / 1e6
    # A third of all gaps is about a day long.
    assert 86_000 + 60 * 26 <= gap <= 86_000 + 60 * 40 + 3600
    assert sitting_gap(stretches(turns_of(messages)), share=0.5) == 1_800_000_000


def test_late_replies_by_chat_and_by_sitting(spark):
    rows = chat("a", [("user", "q", 0), ("assistant", "r", 90_000), ("user", "s", 90_010), ("assistant", "t", 90_020)])
    made = tables(spark, ["a"], rows)
    assert dialogues(*made, gap_micros=3_600_000_000).count() == 4
    assert dialogues(*made, gap_micros=3_600_000_000, by="sitting").count() == 0
    rows += chat("b", [("user", "q", 0), ("assistant", "r", 5), ("user", "lost", 90_000)])
    made = tables(spark, ["a", "b"], rows)
    assert sorted((r.chat_id, r.content) for r in dialogues(*made, gap_micros=3_600_000_000, by="sitting").collect()) == [("b", "q"), ("b", "r")]


def test_inferred_roles(spark):
    rows = chat("a", [("user", "q", 0), (None, "r", 5), ("system", "s", 9), ("assistant", "t", 12)]) + chat("b", [(None, "q", 0), ("assistant", "r", 4)])
    made = tables(spark, ["a", "b"], rows)
    assert sorted(r[0] for r in dropped_chats(*made).collect()) == ["a", "b"]
    assert dropped_chats(*made, infer_roles=True).count() == 0
    found = sorted((r.chat_id, r.turn_no, r.role) for r in dialogues(*made, infer_roles=True).collect())
    assert found == [("a", 1, "user"), ("a", 2, "assistant"), ("a", 3, "user"), ("a", 4, "assistant"), ("b", 1, "user"), ("b", 2, "assistant")]
