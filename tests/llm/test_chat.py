import random

from auditweave.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, head string, piece string, block string"


def brute(rows):
    talks = {}
    for conv_id, turn, role, text in rows:
        talks.setdefault(conv_id, []).append((turn is not None, turn, role or "unknown", text or ""))
    out = []
    for conv_id, turns in talks.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        for assistant in {t[2] for t in turns} - {"system"}:
            at = 0
            for place, (_, turn, speaker, text) in enumerate(turns):
                name = "assistant" if speaker == assistant else speaker if speaker == "system" else f"user name={speaker}"
                head = f"<|{name}|>\n"
                piece = f"{head}{text}<|end|>\n"
                mask = len(text) + 8 if speaker == assistant else 0
                out.append((conv_id, assistant, place, turn, speaker, piece, at, len(piece), at + len(head), mask))
                at += len(piece)
    return sorted(out, key=str)


def sample():
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "anna", "system"]), f"text {c} {t} é") for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(99, t, rng.choice(["a", "b", "c"]), "x" * (t % 7)) for t in range(300)]
    rows += [(50, 0, None, None), (50, 0, "b", ""), (50, None, "a", "first"), (50, 0, "b", ""), (51, 0, "system", "alone"), (None, 1, "a", "no id"),
             (None, 0, "b", "none"), (52, 5, "a", "long " * 50_000), (52, -3, "b", "negative")]
    return rows


def test_equals_brute_force(spark):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in sample()], SCHEMA)
    for block_turns in (4, 1024):
        assert sorted(map(tuple, chat.perspectives(frame, block_turns).collect()), key=str) == brute(sample())


def test_plan_is_native(spark):
    frame = spark.createDataFrame([(1, 1, "a", "b", "", "", "")], SCHEMA)
    plan = chat.perspectives(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_table(spark):
    assert chat.perspectives(spark.createDataFrame([], SCHEMA)).count() == 0
