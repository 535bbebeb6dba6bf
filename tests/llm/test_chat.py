from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyloom.llm import chat

SCHEMA = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string, messages string"


def fold(spark, events):
    frame = spark.createDataFrame([(*e, "extra") for e in events], SCHEMA)
    return {
        row.conv_id: [(m.role, m.text) for m in row.messages] for row in chat.fold_events(frame).collect()
    }


def test_deltas_edits_regenerations_and_deletes(spark):
    events = [
        (1, 0, 0, "message", "user", "Hi"),
        (1, 1, 1, "message", "assistant", ""),
        (1, 2, 1, "delta", None, "Hel"),
        (1, 4, 1, "regenerate", None, None),
        (1, 3, 1, "delta", None, "lo"),
        (1, 5, 1, "delta", None, "Good "),
        (1, 6, 1, "delta", None, "day"),
        (1, 7, 0, "edit", None, "Hi there"),
        (1, 8, 0, "delta", None, "!"),
        (1, 9, 2, "message", "user", "bye"),
        (1, 10, 2, "delete", None, None),
        (2, 5, 0, "delta", None, "before any message"),
        (2, 6, 0, "unknown", None, "x"),
        (None, 0, 0, "message", None, None),
        (3, 0, 0, "message", "user", "twice"),
        (3, 0, 0, "message", "user", "twice"),
    ]
    random.Random(1).shuffle(events)
    assert fold(spark, events) == {
        1: [("user", "Hi there!"), ("assistant", "Good day")],
        2: [],
        None: [("", "")],
        3: [("user", "twice"), ("user", "twice")],
    }
    assert fold(spark, []) == {}


def test_fold_equals_one_by_one(spark):
    rnd = random.Random(4)
    events, wanted = [], {}
    for conv in range(20):
        state, opened = {}, []
        for seq in range(rnd.randint(1, 40)):
            message = rnd.randint(0, 3)
            kind = rnd.choice(["message", "delta", "delta", "delta", "edit", "regenerate"])
            if kind == "message" and message in state:
                kind = "delta"
            text = rnd.choice(["", "a", "<|", "é "])
            events.append((conv, seq, message, kind, "user", text))
            if kind == "message":
                state[message] = text
                opened.append(message)
            elif message in state:
                state[message] = {"delta": state[message] + text, "edit": text, "regenerate": ""}[kind]
        wanted[conv] = [("user", state[m]) for m in opened]
    rnd.shuffle(events)
    assert fold(spark, events) == wanted


def test_render_reads_back(spark):
    rnd = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "<", "|", "\n", "a", "é", "<\\|", "\\<|", ">", "assistant", "n"]
    for_role = [b for b in bits if b != "\n"]
    conversations = [
        [
            ("".join(rnd.choices(for_role, k=rnd.randint(0, 4))), "".join(rnd.choices(bits, k=rnd.randint(0, 9))))
            for _ in range(rnd.randint(0, 4))
        ]
        for _ in range(400)
    ]
    conversations.append([("two\nlines", ""), ("<\\n", "x"), ("\\n", "\n")])
    frame = spark.createDataFrame(
        [(i, m) for i, m in enumerate(conversations)], "id int, messages array<struct<role string, text string>>"
    )
    formatted = frame.select("id", "messages", chat.render(F.col("messages")).alias("formatted"))
    for row in formatted.withColumn("back", chat.read_back(F.col("formatted"))).collect():
        assert row.back == row.messages
        assert row.formatted.count("<|im_end|>") == row.formatted.count("<|im_start|>") == len(row.messages)


def masked(spark, conversations):
    schema = "conv_id bigint, messages array<struct<role string, text string>>, place int, span string"
    rows = [(i, m, 1, "clash") for i, m in conversations]
    return chat.render_masked(spark.createDataFrame(rows, schema))


def test_spans_hold_the_assistant_texts(spark):
    rnd = random.Random(6)
    bits = ["<|im_end|>\n", "<|im_start|>assistant\n", "\\", "<|", "\n", "a", "é", "🙂", ""]
    roles = ["user", "assistant", "assistant", "system", "tool|", ""]
    conversations = [
        (i, [(rnd.choice(roles), "".join(rnd.choices(bits, k=rnd.randint(0, 8)))) for _ in range(rnd.randint(0, 6))])
        for i in range(200)
    ]
    conversations += [(None, [("assistant", "null id")]), (900, [("assistant", "x") for _ in range(2_000)])]
    frame = masked(spark, conversations).checkpoint()
    said = {r.conv_id: r.loss_texts for r in chat.under_mask(frame).collect()}
    by_id = dict(conversations)
    assert set(said) == set(by_id)
    for row in frame.collect():
        messages = by_id[row.conv_id]
        wanted = [text for role, text in messages if role == "assistant"]
        assert said[row.conv_id] == wanted
        assert [span is not None for span in row.loss_spans] == [role == "assistant" for role, _ in messages]
        cut = [row.formatted[s.start : s.end] for s in row.loss_spans if s]
        assert cut == [t.replace("\\", "\\\\").replace("<|", "<\\|") for t in wanted]
        assert all(row.formatted[s.end :].startswith(chat.END) for s in row.loss_spans if s)


def test_a_shifted_mask_shows(spark):
    frame = masked(spark, [(1, [("user", "hello"), ("assistant", "fine, thanks")])])
    shifted = frame.withColumn(
        "loss_spans",
        F.transform("loss_spans", lambda s: F.when(s.isNotNull(), F.struct((s["start"] + 1).alias("start"), s["end"]))),
    )
    assert chat.under_mask(shifted).first().loss_texts == ["ine, thanks"]
    assert chat.under_mask(frame).first().loss_texts == ["fine, thanks"]
