from __future__ import annotations

import random

import pytest

from scorelake.llm import truncation

SCHEMA = "doc_id long, text string, source string, kind string, cut string"


def cues(rng, count, newline="\n"):
    nouns = ["lamp", "river", "window", "garden", "letter", "bridge", "engine", "ticket"]
    out = []
    for i in range(1, count + 1):
        out.append(f"{i}{newline}00:{i // 60:02d}:{i % 60:02d},000 --> 00:{i // 60:02d}:{i % 60:02d},900{newline}I told you to follow the {rng.choice(nouns)} behind the {rng.choice(nouns)}{rng.choice('.!?')}")
    return (newline + newline).join(out) + newline


@pytest.mark.parametrize(
    ("tail", "kind"),
    [
        ("\n\n9\n00:00:0", "structure"), ("\n\n9", "structure"), ("\n\n9\n00:00:09,000 --> 00:00:10,000", "structure"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\nHe was go", "bare"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\n<i>He went", "open"),
        ("\n\n9\n00:00:09,000 --> 00:00:10,000\n[door sl", "open"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\n♪ over the", "open"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\nHe was gone…", "trail"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\nHe was gone—\n\n(archived 12)", "trail"),
        ("\n\n9\n00:00:09,000 --> 00:00:10,000\n-= wharf.example =-\n", "whole"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\nMARA: - ", "open"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\nHe was gone--", "trail"),
        ("\n\n9\n00:00:09,000 --> 00:00:10,000\nHe was go\n\n(archived 12)", "bare"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\nHe was go (more)", "bare"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\n♪ la la ♪", "whole"), ("\n\n9\n00:00:09,000 --> 00:00:10,000\n<i>Gone!</i>\n\n  ", "whole"),
    ],
)
def test_endings(tail, kind):
    text = cues(random.Random(1), 8).rstrip("\n") + tail
    assert truncation.ending(text)[0] == kind
    assert truncation.ending(text.replace("\n", "\r\n"))[0] == kind


def test_blank_and_header_only():
    for text in (None, "", " \n", "﻿", "WEBVTT\n", "no cues at all"):
        assert truncation.ending(text)[0] == "blank"


def corpus(rng):
    rows = []
    for i in range(500):
        text = cues(rng, rng.randint(3, 40))
        source, cut = rng.choice(["Box", " box", "box"]), False
        if len(text) > 1500:
            text, cut = text[:1500], True
        elif rng.random() < 0.05:
            text = text[: rng.randint(200, len(text) - 8)]
            cut = True
        elif rng.random() < 0.3:
            text = text.rstrip("\n") + "\n\n99\n00:59:00,000 --> 00:59:01,000\nSubtitles by the Wharf crew\n"
        elif rng.random() < 0.1:
            text = text.rstrip("\n.!?") + "…\n"
        whole = text.rstrip("\n")[-1:] in ".!?"
        rows.append((i, text, source, "k", "c", cut and not whole))
    return rows


def test_found_and_rates(spark):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame([r[:5] for r in rows] + [(1000, None, None, "", ""), (1001, "", "box", "", ""), (1002, rows[0][1], None, "", ""), (1003, cues(random.Random(1), 20000), "long", "", "")], SCHEMA)
    scored = {r.doc_id: r for r in truncation.score(df).collect()}
    assert len(scored) == len(rows) + 4 and not any(scored[i].cut for i in (1000, 1001, 1003))
    want, got = {r[0] for r in rows if r[5]}, {i for i, r in scored.items() if r.cut and i < 1000}
    assert len(want & got) >= 0.95 * len(want) and len(got - want) <= 2
    assert 1500 in {r.limit_at for r in scored.values()}
    rate = {r.source: r for r in truncation.source_rates(truncation.score(df)).collect()}
    assert rate["box"].texts == len(rows) + 1 and rate["box"].cut_texts >= 0.95 * len(want)


def test_empty(spark):
    assert truncation.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_copies_count_once(spark):
    rng = random.Random(5)
    base = [(i, cues(rng, rng.randint(3, 40)), "box", "k", "c") for i in range(300)]
    cut = cues(rng, 12) + "\n99\n00:59:00,000 --> 00:59:01,000\nMilune, did you a"
    trail = cues(rng, 15) + "\n99\n00:59:00,000 --> 00:59:01,000\nI told you to follow the river…\n"
    copies = [(1000 + i, cut + (f"\n\n(archived {i})" if i % 3 == 0 else ""), "box", "k", "c") for i in range(10)]
    whole = [(2000 + i, trail, "box", "k", "c") for i in range(50)]
    scored = {r.doc_id: r for r in truncation.score(spark.createDataFrame(base + copies + whole, SCHEMA)).collect()}
    assert len(scored) == 360
    assert all(scored[r[0]].cut for r in copies)
    assert not any(scored[r[0]].cut for r in whole)


def test_long_closing_lines(spark):
    credit, told = "subtitles" + "a" * 300, lambda i: i.to_bytes(4, "big")
    rows = [("bare", credit, told(i)) for i in range(4)] + [("bare", credit + f"x{i}", told(100 + i)) for i in range(3)] + [("bare", "b" * 250, told(7)), ("bare", "c" * 50, told(1)), ("bare", "c" * 50, told(2)), ("bare", "c" * 50, told(3)), *(("bare", "c" * 300 + str(i), told(200 + i)) for i in range(20))]
    found = truncation.closing_lines(spark.createDataFrame(rows, "kind string, skeleton string, told binary"))
    assert {tuple(r) for r in found.collect()} == {(credit, 4)}
