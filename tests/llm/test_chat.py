"""Chat formatting: folding of events, exact round trip."""

import hashlib

import pyarrow as pa

from contactlake.llm import chat_events as C

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|", "<|user|>\n</s>", "<", "<<SYS>><s></s", "|>|>", "<<|>", "a\nb", "", None, "[INST", "😀</s>\\</s>"]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_escape_is_exact_and_leaves_no_control_string():
    for text in filter(None, NASTY):
        assert C.unescape(C.escape(text)) == text
        assert not any(c in C.escape(text) for c in C.CONTROL)


def read(spark, rows):
    out = C.read_back(C.format_chats(C.turns_to_events(spark.createDataFrame(rows, SCHEMA))))
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_odd_turns(spark):
    roles = ["user", "assistant", "system", None, "tool|>", "<|", ""]
    rows = [(c, t, roles[(c + t) % 7], NASTY[(c * 5 + t) % len(NASTY)]) for c in range(5) for t in range(20)]
    rows += [(None, None, "assistant", "x"), (None, None, "assistant", "x"), (9, 1, "assistant", "y" * 100_000), (9, 1, "assistant", None)]
    found = read(spark, rows)
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t if t is not None else -1, role or "", text or ""))
    assert set(found) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        body = "".join(f"{r}\n{x}\n" for _, r, x in turns).encode()
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert (found[c].n_turns, found[c].turns_sha256) == (len(turns), hashlib.sha256(body).hexdigest())
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_fold(spark):
    log = [
        (1, 0, 1, 0, "start", "user", None), (1, 0, 1, 1, "delta", None, "a"), (1, 0, 1, 2, "delta", None, "b"),
        (1, 1, 1, 0, "start", "assistant", None), (1, 1, 1, 1, "delta", None, "draft"), (1, 1, 1, 2, "regenerate", None, None),
        (1, 1, 1, 3, "delta", None, "good"), (1, 1, 1, 4, "edit", None, "better"), (1, 1, 1, 5, "delta", None, "!"),
        (1, 2, 1, 0, "start", "user", None), (1, 2, 1, 1, "delete", None, None), (1, 3, 1, 0, "delta", None, "late"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, copy int, seq int, kind string, role string, text string")
    assert sorted((r.turn, r.role, r.text) for r in C.fold_messages(events).collect()) == [
        (0, "user", "ab"), (1, "assistant", "better!"), (3, "", "late")
    ]
    row = C.format_chats(events).collect()[0]
    assert row.formatted == "<|user|>\nab</s>\n<|assistant|>\nbetter!</s>\n<||>\nlate</s>\n" and row.turns == 3
    assert [row.formatted[s.start : s.stop] for s in row.loss] == ["better!"]
    assert C.read_back(C.format_chats(events.limit(0))).count() == 0


def test_long_conversations_are_bounded_parts(spark):
    log = [(t, ("user", "assistant", "<|" * 3)[t % 3], (NASTY[t % len(NASTY)] or "") * 9000) for t in range(40)]
    events = spark.createDataFrame(
        [(c, t, 1, 0, "delta", role, text) for c in (None, 1) for t, role, text in log],
        "conv_id long, turn long, copy int, seq int, kind string, role string, text string",
    )
    out = C.format_chats(events)
    for conv in (None, 1):
        parts = sorted((r for r in out.collect() if r.conv_id == conv), key=lambda r: r.part)
        assert [r.part for r in parts] == list(range(len(parts))) and len(parts) > 10
        assert max(len(r.formatted) for r in parts) <= C.PART + 1
        whole = "".join(f"<|{C.escape(role)}|>\n{C.escape(text)}</s>\n" for _, role, text in log)
        assert "".join(r.formatted for r in parts) == whole
        assert "".join(C.unescape(r.formatted[s.start : s.stop]) for r in parts for s in r.loss) == "".join(x for _, r, x in log if r == "assistant")
        assert sum(r.turns for r in parts) == len(log)
    turns = hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in log).encode()).hexdigest()
    learnt = "".join(x for _, r, x in log if r == "assistant")
    expected = (len(log), turns, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(whole))
    got = C.read_back(out.repartition(5, "part")).collect()
    assert {tuple(r) for r in got} == {(None, *expected), (1, *expected)}


def test_a_conversation_leaves_the_task_before_it_ends():
    text, read = "x" * (1 << 20), []

    def batches():
        for i in range(50):
            read.append(i)
            yield pa.RecordBatch.from_pydict({"conv_id": [1], "role": ["user"], "text": [text]})

    first = next(C._render(batches()))
    assert len(read) < 10 and set(first.column("conv_id").to_pylist()) == {1}
