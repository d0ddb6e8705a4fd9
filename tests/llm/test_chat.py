"""Perspective rotation against a plain Python rendering."""

import pytest

from quaystack.llm import chat

TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello 🙂 there"),
    (1, 3, "bob", ""), (1, 4, "user", None),
    (2, 0, "user", "alone"), (2, 0, "user", "alone"), (2, 0, "ann", "tie"),
    (3, 0, "system", "only context"),
    (None, 0, None, "no id"), (None, 1, "user", "x" * 3000),
]


def render(turns):
    convs = {}
    for t in turns:
        convs.setdefault(t[0], []).append((t[1], t[2] or "unknown", t[3] or ""))
    out = {}
    for conv, rows in convs.items():
        rows.sort()
        for speaker in {r for _, r, _ in rows} - {"system"}:
            text, mask = "", []
            for _, role, body in rows:
                shown = "assistant" if role == speaker else role if role == "system" else f"user name={role}"
                text += f"<|im_start|>{shown}\n"
                if role == speaker:
                    mask.append((len(text), len(text) + len(body) + len(chat.END)))
                text += body + chat.END
            out[conv, speaker] = (text, mask)
    return out


def frame(spark, turns):
    return spark.createDataFrame([(*t, "clash", 3) for t in turns],
                                 "conv_id long, turn long, role string, text string, speaker string, part long")


@pytest.mark.parametrize("part_turns, block_parts", [(1, 2), (2, 1), (64, 4096)])
def test_parts_make_up_the_dialogue(spark, part_turns, block_parts):
    rows = chat.rotate(frame(spark, TURNS), part_turns=part_turns, block_parts=block_parts).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        text, mask = got.setdefault((r["conv_id"], r["speaker"]), ["", []])
        assert r["start"] == len(text) and r["n_turns"] <= part_turns
        mask += [(m["start"] + len(text), m["end"] + len(text)) for m in r["mask"]]
        got[r["conv_id"], r["speaker"]][0] += r["rendered"]
    assert {k: (v[0], v[1]) for k, v in got.items()} == render(TURNS)


def test_long_conversation_of_many_speakers(spark):
    turns = [(9, i, f"p{i % 3}", f"turn {i}") for i in range(500)]
    rows = chat.rotate(frame(spark, turns), block_parts=3).collect()
    assert len(rows) == 3 * 8
    for speaker in ("p0", "p1", "p2"):
        at = 0
        for r in sorted((r for r in rows if r["speaker"] == speaker), key=lambda r: r["part"]):
            assert r["start"] == at
            at += len(r["rendered"])
    text = "".join(r["rendered"] for r in sorted(rows, key=lambda r: r["part"]) if r["speaker"] == "p1")
    assert text == render(turns)[9, "p1"][0]


def test_no_window_carries_rendered_text(spark):
    plan = chat.rotate(frame(spark, TURNS))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("rendered" in line or "body" in line for line in windows)


def test_empty_table(spark):
    assert chat.rotate(frame(spark, [])).count() == 0
