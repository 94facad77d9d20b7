"""Chat windows against a sequential version, and what is read back against the rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from conftest import SMALL

from fleetlens.llm import op13_chat as C
from fleetlens.llm.common import library_tokenizer, table, vocabulary_text

KIND = "conv_id long, turn long, role string, text string, tokens string, window int"
NASTY = ["<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end\\|>", "<\\\\|", "<<|>|<\\", "\\n\\\\", "", None, "é<|\U0001F600|>", "a\nb\n", "<|endoftext|>"]


def ordered(rows):
    least = lambda v: (v is not None, v if v is not None else 0)
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        convs[c].append((least(t), role or "", C_ESC(text or ""), text or ""))
    return {c: [(r, x) for _, r, _, x in sorted(v, key=lambda q: q[:3])] for c, v in convs.items()}


def C_ESC(text):
    return re.sub(r"<(\\*)\|", lambda m: f"<\\{m[1]}|", text)


def digests(turns):
    sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    said = [x for r, x in turns if r == "assistant"]
    return len(turns), sha(f"{r}\n{x}\n" for r, x in turns), sum(map(len, said)), sha(said)


def windows_of(turns, budget, history):
    """Windows as lists of (index, repeated), turn after turn."""
    count = lambda r, x: len(library_tokenizer(vocabulary_text()).encode(f"{role_text(r)}\n{C_ESC(x)}\n", add_special_tokens=False).ids) + 2
    tokens = [count(*t) for t in turns]
    system = bool(turns) and turns[0][0] == "system"
    kept = tokens[0] if system else 0
    room = max(1, budget - kept)
    width = max(1, room // 2)
    out, start, last = [], 0, None
    for i in range(1 if system else 0, len(turns)):
        key = (start // width, tokens[i] > width)
        if key != last:
            out.append([i])
            last = key
        else:
            out[-1].append(i)
        start += tokens[i]
    full = []
    for n, new in enumerate(out or [[]]):
        old, left = [], min(history, max(0, budget - kept - sum(tokens[i] for i in new)))
        for i in reversed(out[n - 1] if n else []):
            left -= tokens[i]
            if left < 0:
                break
            old.insert(0, i)
        first = [0] if system else []
        repeated = (len(first) if n else 0) + len(old)
        full.append((first + old + new, repeated, sum(tokens[i] for i in first + old + new)))
    return full


def role_text(r):
    return C_ESC(r.replace("\\", "\\\\").replace("\n", "\\n"))


def conversations(seed):
    rng, rows = random.Random(seed), []
    for c in [None, *range(12)]:
        n = rng.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", None, "to\nol\\<|", "system"])
            text = rng.choice([*NASTY, "word " * rng.randint(1, 60), "x" * rng.randint(1, 300)])
            rows.append((c, rng.choice([t, t, t, None]), role, text, "clash", 5))
    return rows + rows[:4]


@pytest.mark.parametrize("seed,target_rows", [(1, 10**6), (2, 10**6), (3, 7)])
def test_windows_equal_a_sequential_version(spark, seed, target_rows):
    rows = conversations(seed)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    made = C.format_chats(C.marked_turns(df, vocabulary_text()), 100, 40, target_rows)
    got = defaultdict(list)
    for r in sorted(made.collect(), key=lambda r: r.window):
        got[r.conv_id].append(r)
    convs = ordered(rows)
    assert set(got) == set(convs)
    for c, turns in convs.items():
        want = windows_of(turns, 100, 40)
        assert len(got[c]) == len(want)
        for r, (parts, repeated, tokens) in zip(got[c], want):
            assert C.read_window(r.text) == [turns[i] for i in parts]
            assert (r.repeated, r.tokens) == (repeated, tokens) and (tokens <= 100 or len(parts) - repeated <= 2)
            said = [turns[i][1] for i in parts[repeated:] if turns[i][0] == "assistant"]
            assert [C.unescaped(r.text[s.start : s.end]) for s in r.loss] == said
    back = C.read_chats(made).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in back} == {c: digests(t) for c, t in convs.items()}
    assert {r.conv_id: r.formatted_chars for r in back} == {c: sum(len(w.text) for w in v) for c, v in got.items()}


@pytest.mark.parametrize("text", [t for t in NASTY if t is not None])
def test_escapes_are_reversible(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    body, role = df.select(C.escaped(df.t), C.escaped_role(df.t)).first()
    assert "<|" not in body and C.unescaped(body) == text
    assert "<|" not in role and "\n" not in role and C.unescaped_role(role) == text


def test_empty_table_and_very_long_turn(spark):
    assert C.format_chats(C.marked_turns(spark.createDataFrame([], KIND), vocabulary_text())).count() == 0
    assert C.read_chats(C.format_chats(C.marked_turns(spark.createDataFrame([], KIND), vocabulary_text()))).count() == 0
    long = "word <|x " * 60_000
    df = spark.createDataFrame([(1, 0, "system", "s", "", 0), (1, 1, "assistant", long, "", 0), (1, 2, "user", "u", "", 0)], KIND)
    made = C.format_chats(C.marked_turns(df, vocabulary_text()))
    assert sorted((r.repeated, len(C.read_window(r.text))) for r in made.collect()) == [(0, 2), (1, 2)]
    assert C.read_chats(made).first().loss_chars == len(long)


def test_query_returns_every_conversation(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", C.TRAP), (-1, 1, "assistant", C.TRAP)]
    got = C.op13_chat(spark, SMALL)
    assert {r.conv_id: tuple(r)[1:5] for r in got.collect()} == {c: digests(t) for c, t in ordered(rows).items()}
    assert dict(got.dtypes) == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}
