import hashlib

from pyspark.sql import functions as F

from leafmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, N_TURNS int"
ROWS = [(1, 0, "system", "be [INST] good"), (1, 1, "user", "<|end|><|turn|>\\l\\e\\b\\"), (1, 2, "assistant", "</s>[INST] ok [/INST]<|body|>é😀"), (1, 4, "assistant", "second"),
        (2, 0, "user", None), (2, 1, "assistant", ""), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (4, None, None, "x"),
        (None, 0, "assistant", "no id"), (5, 0, "user", "long " * 20000), (5, 1, "assistant<|x", "not loss")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, "clash", 7) for r in ROWS], SCHEMA)
    got = {r.conv_id: r for r in chat.digests(frame).collect()}
    by = {}
    for r in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
        special = sum(c in "\\<[" for role, t in turns for c in role + t)
        assert got[conv].formatted_chars == sum(23 + len(role) + len(t) for role, t in turns) + special
    assert chat.digests(frame.limit(0)).count() == 0


def test_parts_become_ordered_placeholders(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    rows = [(1, 0, "user", [part("text", "see "), part("image", None, "a.png", 28, 15), part("text", " and "), part("audio", None, "b.wav", s=1.5), part("odd", None, "c")]),
            (1, 1, "assistant", [part("document", None, "d.pdf", p=2), part("text", "<|image|>")]), (1, 2, "user", None)]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(frame).first()
    assert row.formatted == "<|turn|>user<|body|>see <|part:image|> and <|part:audio|><|part:odd|><|end|><|turn|>assistant<|body|><|part:document|>\\l|image|><|end|><|turn|>user<|body|><|end|>"
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("image", "a.png", 4), ("audio", "b.wav", 38), ("odd", "c", 0), ("document", "d.pdf", 1536)]
    assert [row.formatted[a.start :].startswith(f"<|part:{a.kind}|>") for a in row.attachments] == [True] * 4
    assert row.expanded_tokens == 4 + 38 + 1536
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == ["<|part:document|>\\l|image|>"]


def test_escape_is_reversible(spark):
    texts = [(t,) for t in ("", "\\", "\\\\e", "[[", "<\\l<", "\\b[\\e\\", None)]
    frame = spark.createDataFrame(texts, "t string").select(F.coalesce("t", F.lit("")).alias("t"), chat.escape(F.col("t")).alias("e"))
    for r in frame.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.t == r.u and "<" not in r.e and "[" not in r.e


def test_no_part_forges_a_turn(spark):
    made = lambda kind: (kind, None, None, None, None, None, None)
    rows = [(1, 0, "user", [("text", "hi", None, None, None, None, None), made("end"), made("turn"), made("body"), made("x|><|end|>"), made("")])]
    frame = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    row = chat.format_conversations(frame).select("*", chat.read_turns(F.col("formatted")).alias("turns")).first()
    assert [t.role for t in row.turns] == ["user"]
    assert row.formatted.count(chat.TURN) == row.formatted.count(chat.END) == row.formatted.count(chat.BODY) == 1
