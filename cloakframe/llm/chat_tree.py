"""Chat formatting over prefix trees.

Every turn is written as ``<turn>role``, a line break, the text and ``</turn>`` with a line
break; a backslash before every backslash and marker inside keeps that reversible. Tokens are
the characters of this form. Conversations that begin with the same turns share a path from
the root: a pack lays the nodes of one tree out depth-first, every node once, and gives each
node its place, its parent, the position id of its first token (how many tokens its ancestors
hold), the intervals that its tokens may attend to (its ancestors, then itself up to the token),
and the interval of assistant text that bears loss.

Equal conversations are one path. Where paths of more than PACK_CHARS part, at whatever depth,
what follows is dealt over several packs by the next turn, so no pack grows with the corpus. The
turns up to there, from the last such place on, are laid out once, in a pack of their own that
the others name as their base: their nodes see all tokens of the base and of the packs above it
(``above``, from the root), and their position ids go on from there. So every node stands in one
pack and is the same at any size of the corpus or of a pack; only where packs begin differs.

Of a node's children the one with the largest subtree follows it directly, so the ancestors of
a node lie in few stretches, at most one more than the logarithm of the pack's nodes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cut

OPEN, CLOSE = "<turn>", "</turn>\n"
LOSS_ROLE = "assistant"
PACK_CHARS = 1_000_000
_MARKER = re.compile(r"\\|</?turn>")
_TURN = re.compile(r"<turn>((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _MARKER.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's tokens and the interval of its text among them."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that ``format_turn`` wrote one after the other."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


PACK = (
    "pack string, base string, shared boolean, offset int, tokens string, nodes array<struct<start: int, end: int, parent: int, position: int, loss_start: int, loss_end: int, "
    "sees: array<struct<start: int, end: int>>>>, leaves array<struct<path: string, node: int>>, above array<string>"
)
_INTERVAL = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("sees", pa.list_(_INTERVAL))]))
_LEAVES = pa.list_(pa.struct([("path", pa.string()), ("node", pa.int32())]))


def lay_out(paths: list[tuple[str | None, list[tuple[str, str]]]], offset: int = 0) -> tuple[str, list[dict], list[dict]]:
    """Tokens, nodes and leaves of the tree over (name, turns); of children the largest subtree first, then in the order of
    their turns. ``offset`` tokens stand before the roots in another pack; a path without a name has nodes but no leaf."""
    children: list[dict[tuple[str, str], int]] = [{}]  # by trie number, 0 above the roots
    parents, ends = [0], [[]]
    for name, turns in paths:
        at = 0
        for turn in turns:
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                parents.append(at)
                ends.append([])
            at = children[at][turn]
        if name is not None:
            ends[at].append(name)
    weight = [1] * len(children)
    for at in range(len(children) - 1, 0, -1):  # a child has a larger number than its parent
        weight[parents[at]] += weight[at]
    ordered = lambda at: sorted(children[at].items(), key=lambda c: (-weight[c[1]], c[0]), reverse=True)
    tokens, nodes, leaves, size = [], [], [], 0
    stack = [(turn, c, -1) for turn, c in ordered(0)]
    while stack:
        turn, at, parent = stack.pop()
        text, a, b = format_turn(*turn)
        own = {"start": size, "end": size + len(text)}
        if parent < 0:
            sees, position = [], offset
        else:
            p = nodes[parent]
            sees, position = list(p["sees"]), p["position"] + p["end"] - p["start"]
            if sees and sees[-1]["end"] == p["start"]:
                sees[-1] = {"start": sees[-1]["start"], "end": p["end"]}
            else:
                sees.append({"start": p["start"], "end": p["end"]})
        lossy = turn[0] == LOSS_ROLE
        nodes.append({**own, "parent": parent, "position": position, "loss_start": size + (a if lossy else 0), "loss_end": size + (b if lossy else 0), "sees": sees})
        leaves += [{"path": name, "node": len(nodes) - 1} for name in ends[at]]
        stack += [(t, c, len(nodes) - 1) for t, c in ordered(at)]
        tokens.append(text)
        size += len(text)
    return "".join(tokens), nodes, leaves


def _lay_out_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, base, shared, level, above, path, turns) sorted by pack -> one row for each pack; ``level`` turns stand above it."""
    now, paths = None, []

    def flush() -> pa.RecordBatch:
        pack, base, shared, level, above = now
        offset = sum(len(format_turn(*t)[0]) for t in paths[0][1][:level])
        tokens, nodes, leaves = lay_out([(name, turns[level:]) for name, turns in paths], offset)
        columns = [pa.array([pack]), pa.array([base], pa.string()), pa.array([shared]), pa.array([offset], pa.int32()), pa.array([tokens]), pa.array([nodes], _NODES), pa.array([leaves], _LEAVES), pa.array([above], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["pack", "base", "shared", "offset", "tokens", "nodes", "leaves", "above"])

    for batch in batches:
        for *key, path, turns in zip(*(batch.column(c).to_pylist() for c in ("pack", "base", "shared", "level", "above", "path", "turns")), strict=True):
            if now is not None and key[0] != now[0]:
                yield flush()
                paths = []
            now = key
            paths.append((path, [(t["role"], t["text"]) for t in turns]))
    if paths:
        yield flush()


def conversations_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turns, path`` from rows (conv_id, turn, role, text); ``path`` names equal turns alike.

    Turns go by turn, then role, then text, so repeated rows have a defined order; a null role
    or text is empty, and a null turn comes first. Every row without a conv_id is a conversation of its own: nothing says
    which of them belong together, and there may be any number.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", alone.alias("alone"), turn.alias("turn")).groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return grouped.select("conv_id", "alone", turns.alias("turns")).withColumn("path", F.sha2(F.to_json("turns"), 256))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, turns) -> the path, its size, and a name for its first turn, its first two and so on."""
    for batch in batches:
        names, sizes = [], []
        for turns in batch.column("turns").to_pylist():
            at, own = b"", []
            for t in turns:
                role, text = (t[k].encode("utf-8", "surrogatepass") for k in ("role", "text"))
                at = hashlib.blake2b(b"%b%d:%b%b" % (at, len(role), role, text), digest_size=16).digest()
                own.append(at.hex())
            names.append(own)
            sizes.append(sum(len(t["text"]) + 20 for t in turns))
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64()), pa.array(names, pa.list_(pa.string()))], ["path", "n", "names"])


def pack_trees(conversations: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """PACK rows of ``conversations`` (turns, path)."""
    paths = conversations.dropDuplicates(["path"]).select("path", "turns")
    light = cut(paths.select("path", "turns").mapInArrow(_prefixes, "path string, n long, names array<string>"))
    steps = light.select("path", "n", "names", F.posexplode("names").alias("at", "name"))
    steps = steps.select("path", "n", "name", (F.col("at") + 1).alias("depth"), F.get("names", F.col("at") + 1).alias("next"))
    # where paths part that are too much for one pack
    forks = steps.groupBy("name").agg(F.sum("n").alias("weight"), F.count("*").alias("paths"), F.count("next").alias("on"), F.min("next").alias("low"), F.max("next").alias("high"), F.min("path").alias("first"))
    forks = forks.where(F.col("weight") > pack_chars).where("paths > 1 AND (low < high OR on < paths)").select("name", "first", F.ceil(F.col("weight") / pack_chars).alias("parts"))
    over = steps.join(forks, "name").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "name", "parts", (F.col("first") == F.col("path")).alias("tells")))).alias("over"))
    named = light.join(over, "path", "left").join(paths, "path").withColumn("over", F.coalesce("over", F.array().cast("array<struct<depth: int, name: string, parts: bigint, tells: boolean>>")))
    k, m = F.size("names"), F.size("over")
    last = F.get("over", m - 1)
    whole = F.coalesce(last["depth"] == k, F.lit(False))  # all its turns stand in such packs
    child = F.get("names", last["depth"])
    dealt = F.format_string("%s-%d", last["name"], F.pmod(F.xxhash64(child), last["parts"]))
    pack = F.when(m == 0, F.get("names", F.lit(0))).when(whole, last["name"]).otherwise(dealt)
    own = named.select(pack.alias("pack"), whole.alias("shared"), F.slice("over", F.lit(1), m - F.when(whole, 1).otherwise(0)).alias("up"), "path", "turns")
    told = named.select("over", "turns", F.posexplode("over").alias("i", "x")).where("x.tells")
    told = told.select(F.col("x.name").alias("pack"), F.lit(True).alias("shared"), F.slice("over", F.lit(1), F.col("i")).alias("up"), F.lit(None).cast("string").alias("path"), F.slice("turns", F.lit(1), F.col("x.depth")).alias("turns"))
    above = F.transform("up", lambda x: x["name"])
    up = F.get("up", F.size("up") - 1)
    rows = own.unionByName(told).select("pack", up["name"].alias("base"), "shared", F.coalesce(up["depth"], F.lit(0)).alias("level"), above.alias("above"), "path", "turns")
    return rows.repartition("pack").sortWithinPartitions("pack", F.col("path").asc_nulls_first()).mapInArrow(_lay_out_packs, PACK)


READ = "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            tokens, nodes, leaves, offset, before = (batch.column(c)[i].as_py() for c in ("tokens", "nodes", "leaves", "offset", "before"))
            ahead = "".join(x["tokens"] for x in before or ())
            learned = [unescape(x["tokens"][y["a"] : y["b"]]) for x in before or () for y in x["loss"]]
            if len(ahead) != offset:
                raise ValueError("a pack and its base disagree")
            out = []
            for leaf in leaves:
                own = nodes[leaf["node"]]
                formatted = ahead + "".join(tokens[s["start"] : s["end"]] for s in [*own["sees"], own])
                if own["position"] + own["end"] - own["start"] != len(formatted):
                    raise ValueError("position ids and attention intervals disagree")
                turns = parse(formatted)
                loss, at = [], leaf["node"]
                while at >= 0:
                    loss.append(unescape(tokens[nodes[at]["loss_start"] : nodes[at]["loss_end"]]))
                    at = nodes[at]["parent"]
                under = "".join([*learned, *reversed(loss)])
                sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((leaf["path"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(under), sha(under), len(formatted)))
            names = [f.split()[0] for f in READ.split(", ")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], names)


def read_back(packs: DataFrame) -> DataFrame:
    """READ for every path, from the packs alone: its own tokens and what they attend to, there and in the packs above, parsed."""
    loss = F.transform("nodes", lambda x: F.struct(x["loss_start"].alias("a"), x["loss_end"].alias("b")))
    turns = packs.where("shared").select(F.col("pack").alias("name"), "tokens", loss.alias("loss"))
    read = packs.where(F.size("leaves") > 0)
    asked = read.select("pack", F.posexplode("above").alias("i", "name")).join(turns, "name")
    before = asked.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("i", "tokens", "loss"))).alias("before"))
    return read.join(before, "pack", "left").select("tokens", "nodes", "leaves", "offset", "before").mapInArrow(_read_packs, READ)


#: Keys over which conversations of one path are dealt.
SHARES = 16


def digest(rows: DataFrame, pack_chars: int = PACK_CHARS) -> DataFrame:
    """``conv_id`` and READ's figures for every conversation of ``rows``, read back from its packs.

    Conversations without turns don't occur; an empty table gives none. Columns other than conv_id, turn, role and text are
    ignored.
    """
    conversations = cut(conversations_of(rows))
    packs = cut(pack_trees(conversations, pack_chars))
    found = read_back(packs).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    dealt = conversations.select("conv_id", "path", F.pmod(F.xxhash64("conv_id", "alone"), F.lit(SHARES)).cast("int").alias("share"))
    return dealt.join(found, ["path", "share"]).drop("path", "share")
