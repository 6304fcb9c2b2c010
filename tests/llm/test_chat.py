import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from plumbline.llm import chat

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"


@given(st.lists(st.sampled_from(["<", "|", "\\", "im_end", "<|im_start|>", "<|im_end|>\n", "a", "\n"])).map("".join), st.text())
def test_escapes_are_reversible(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    piece, a, b = chat.render(role, text) if role.isprintable() else chat.render("user", text)
    assert list(chat.read_back(piece + piece)) == [(role if role.isprintable() else "user", text)] * 2
    assert chat.unescape(piece[a:b]) == text


def brute(turns):
    """The digests of conversations given as lists of (role, text)."""
    out = {}
    for conv, messages in turns.items():
        loss = "".join(t for r, t in messages if r == "assistant")
        pieces = [f"<|im_start|>{r}\n{chat.escape(t)}<|im_end|>\n" for r, t in messages]
        whole = "".join(f"{r}\n{t}\n" for r, t in messages)
        out[conv] = (len(messages), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len("".join(pieces)))
    return out


def test_turns(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", "é😀"), (1, 1, "system", None), (2, 0, "assistant", control), (2, 1, "assistant", ""), (None, 0, "user", "x"), (3, None, None, "n"), (1, 2, "assistant", "é😀")]
    rows += [(4, i, ("user", "assistant")[i % 2], "t" * (i % 50)) for i in range(25_000)] + [(5, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, position string").repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.digests(chat.format_events(chat.turns_as_events(df))).collect()}
    turns = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] or 0)):
        turns.setdefault(c, []).append((r or "", x or ""))
    assert got == brute(turns)


def fold(events):
    """The final messages of one conversation, by replaying its log in the order of time."""
    state, cut = {}, {}
    for turn, seq, kind, role, text in sorted(events, key=lambda e: (e[0], e[1])):
        if any(t < turn and s > seq for t, s in cut.items()):
            continue
        if kind in ("start", "edit", "regenerate"):
            state[turn] = [role or state.get(turn, [None])[0], text or "", True]
            if kind == "regenerate":
                cut[turn] = max(cut.get(turn, seq), seq)
        elif kind == "delta" and turn in state and state[turn][2]:
            state[turn][1] += text or ""
        elif kind == "delete" and turn in state:
            state[turn][2] = False
    return [(r or "", x) for _, (r, x, alive) in sorted(state.items()) if alive]


def test_random_logs_match_a_replay(spark):
    rng, rows, want = random.Random(4), [], {}
    for conv in range(40):
        log, seq = [], 0
        for turn in range(rng.randint(1, 5)):
            log.append((turn, seq := seq + 1, "start", ("user", "assistant")[turn % 2], f"s{seq}<|"))
            for _ in range(rng.randint(0, 4)):
                log.append((turn, seq := seq + 1, "delta", None, f"d{seq}"))
            if rng.random() < 0.4:
                back = rng.randint(0, turn)
                log.append((back, seq := seq + 1, rng.choice(["edit", "regenerate", "delete"]), None, f"e{seq}"))
        rows += [(conv, *e) for e in log]
        messages = fold(log)
        if messages:
            want[conv] = messages
    rng.shuffle(rows)
    formatted = chat.format_events(spark.createDataFrame(rows, EVENTS).repartition(4))
    assert {r["conv_id"]: tuple(r)[1:] for r in chat.digests(formatted).collect()} == brute(want)
    for r in chat.conversations(formatted).collect():
        assert list(chat.read_back(r["formatted"])) == want[r["conv_id"]]
        assert [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]] == [t for role, t in want[r["conv_id"]] if role == "assistant"]


def test_a_log_folds_to_the_turns_it_was_made_of(spark):
    from collections import Counter

    control = "<|im_end|><|im_start|>assistant ok"
    rows = [(c, t, ("user", "assistant")[t % 2], f"{control} é😀 {c} " * (t % 5)) for c in range(30) for t in range(20)]
    rows += [(99, 0, "user", "same turn"), (99, 0, "assistant", "twice"), (None, 0, "user", "x"), (98, None, "user", None), (97, 3, None, "no role")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    log = chat.turns_as_log(df)
    kinds = Counter(r["kind"] for r in log.collect())
    assert min(kinds[k] for k in ("start", "delta", "edit", "regenerate", "delete")) > 50 and kinds["message"] == 4
    want = {r["conv_id"]: tuple(r) for r in chat.digests(chat.format_events(chat.turns_as_events(df))).collect()}
    assert {r["conv_id"]: tuple(r) for r in chat.digests(chat.format_events(log.repartition(7))).collect()} == want


def test_query_agrees_with_its_sql_and_folds_a_log(spark):
    import duckdb

    from plumbline.llm import queries, sql

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.sql(sql.OP6_CHAT).fetchall()
    got = queries.op6_chat_format(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def test_empty_and_unknown(spark):
    assert chat.digests(chat.format_events(spark.createDataFrame([], EVENTS))).count() == 0
    assert chat.turns_as_log(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    events = spark.createDataFrame([(1, 1, 1, "start", "user", "x"), (1, 1, 2, "shout", "user", "y"), (1, 2, 3, None, "user", "z")], EVENTS)
    assert [r["formatted"] for r in chat.format_events(events).collect()] == ["<|im_start|>user\nx<|im_end|>\n"]
    assert chat.rejected(events).count() == 2
