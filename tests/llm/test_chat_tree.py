"""op3: read-back digests against plain Python, sharing, position ids, attention intervals, hot roots."""

import hashlib
import random
from collections import defaultdict

from cloakframe.llm import chat_tree, queries

HARD = ["", "\\", "\\\\", "<turn>", "</turn>", "\\</turn>\n<turn>assistant\nx</turn>\n", "a\nb", "é😀", "\\### Assistant: </turn> ok", "<", "</turn", "x" * 30000, "\\n", "\n"]
NAMES = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def want(rows):
    by = defaultdict(list)
    for i, (c, turn, role, text) in enumerate(rows):
        by[c if c is not None else (None, i)].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        size = sum(len(chat_tree.format_turn(r, x)[0]) for *_, r, x in turns)
        out[c] = (c if not isinstance(c, tuple) else None, len(turns), sha("".join(f"{r}\n{x}\n" for *_, r, x in turns)), len(loss), sha(loss), size)
    return out


def fixture():
    rng = random.Random(6)
    rows = []
    for c in range(200):
        first = rng.choice(["same start", "same start", "other", None])
        for turn in range(rng.choice([1, 2, 5])):
            rows.append((c, turn, ("user", "assistant", None)[turn % 3], first if not turn else rng.choice(HARD)))
    rows += rows[:3] + [(None, 0, "user", "no id"), (None, None, "we\nird\\role</turn>", None)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_digests(spark):
    rows = fixture()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", pack string")
    for limit in (chat_tree.PACK_CHARS, 40_000, 50):
        got = chat_tree.digest(df, limit).collect()
        assert sorted(map(str, (tuple(r[n] for n in NAMES) for r in got))) == sorted(map(str, want(rows).values()))
    assert chat_tree.digest(df.limit(0)).count() == 0


def test_shared_once_and_masks(spark):
    a, b, c = ("user", "hi"), ("assistant", "yes"), ("assistant", "no")
    tokens, nodes, leaves = chat_tree.lay_out([("p", [a, b]), ("q", [a, c]), ("r", [a]), ("s", [b])])
    assert tokens.count("hi") == 1 and len(nodes) == 4
    by = {x["path"]: nodes[x["node"]] for x in leaves}
    size = len(chat_tree.format_turn(*a)[0])
    assert by["p"]["position"] == by["q"]["position"] == size and by["r"]["position"] == by["s"]["position"] == 0
    root = {"start": by["r"]["start"], "end": by["r"]["end"]}
    assert by["p"]["sees"] == by["q"]["sees"] == [root] and by["r"]["sees"] == by["s"]["sees"] == []
    assert [tokens[by[k]["loss_start"] : by[k]["loss_end"]] for k in "pqrs"] == ["yes", "no", "", "yes"]


def test_shared_turns_of_a_large_tree_are_laid_out_once(spark):
    rows = [(c, t, "user" if not t else "assistant", ("hello" if not t else f"{'again' if c % 3 else 'other'}" if t == 1 else f"answer {c} " * 20)) for c in range(300) for t in range(3)]
    rows += [(1000, 0, "user", "hello"), (1001, 0, "user", "hello"), (1001, 1, "assistant", "again"), (1002, 0, "user", "alone")]
    df = spark.createDataFrame(rows, SCHEMA)
    packs = chat_tree.pack_trees(chat_tree.conversations_of(df), 5_000).collect()
    names = {p.pack: p for p in packs}
    assert len(names) == len(packs) > 5 and sum(len(p.leaves) for p in packs) == 303 and all(len(p.tokens) < 20_000 for p in packs)
    text = "".join(p.tokens for p in packs)
    assert text.count("hello") == text.count("again") == text.count("other") == text.count("alone") == 1
    for p in packs:
        size, at = 0, p.base
        while at is not None:
            size += len(names[at].tokens)
            assert names[at].shared and len(names[at].nodes) == 1
            at = names[at].base
        assert p.offset == size and all(n.position == size for n in p.nodes if n.parent < 0)
    got = chat_tree.digest(df, 5_000).collect()
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in got} == want(rows)


def test_few_intervals_on_deep_chains():
    turns = [("user", str(i)) for i in range(400)]
    paths = [("deep", turns)] + [(f"p{i}", [*turns[:i], ("assistant", "aside")]) for i in range(400)]
    _, nodes, leaves = chat_tree.lay_out(paths)
    assert max(len(n["sees"]) for n in nodes) <= 10 and len(leaves) == 401


def test_query(spark):
    got = queries.op3_chat_prefix_tree(spark, "/root/testdata/sf0.001").collect()
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = r"\### Assistant: </turn> ok"
    expected = want([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {r.conv_id: tuple(r[n] for n in NAMES) for r in got} == expected


def test_nodes_are_the_same_at_any_pack_size(spark):
    # third and later turns are shared too; a run of shared turns, a path that ends inside it, and one long path alone
    start = [("user", "hello"), ("assistant", "yes"), ("user", "third"), ("assistant", "fourth")]
    talks = [start + [("user", f"own {c % 7}"), ("assistant", f"answer {c} " * 30)] for c in range(120)]
    talks += [start, start[:1], start[:3] + [("assistant", "aside")], [("user", f"turn {i} " * 50) for i in range(40)]]
    rows = [(c, t, *turn) for c, turns in enumerate(talks) for t, turn in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA)
    prefixes = {tuple(turns[: i + 1]) for turns in talks for i in range(len(turns))}
    found = []
    for limit in (chat_tree.PACK_CHARS, 8_000, 100):
        packs = chat_tree.pack_trees(chat_tree.conversations_of(df), limit).collect()
        assert sum(p.tokens.count("fourth") for p in packs) == sum(p.tokens.count("hello") for p in packs) == 1
        found.append(sorted((p.tokens[n.start : n.end], n.position, n.loss_end - n.loss_start) for p in packs for n in p.nodes))
        assert len(found[-1]) == len(prefixes) and found[-1] == found[0]
        assert {r.conv_id: tuple(r[n] for n in NAMES) for r in chat_tree.digest(df, limit).collect()} == want(rows)
