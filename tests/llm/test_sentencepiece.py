"""op7: N-best against all segmentations, chunk-wise against whole texts, exact round trips."""

import random

import pytest

from cloakframe.llm import sentencepiece_nbest as sp


@pytest.fixture(scope="module")
def words():
    return sp.vocabulary(sp.MODEL_PATH)


def every(words, s):
    """Scores of all segmentations, best first."""
    out = []

    def walk(i, score):
        if i == len(s):
            out.append(score)
            return
        alone = False
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in words.pieces:
                alone |= j == i + 1
                walk(j, score + words.pieces[s[i:j]][0])
        if not alone:
            walk(i + 1, score + words.unknown)

    walk(0, 0.0)
    return sorted(out, reverse=True)


HARD = ["", " ", "  ", "\n", "\n\n a", "a", "▁", "a▁b", "<0x0A>", "😀é́", "Hello  world\n", "\x00\x01", "x" * 60, "   lead", "trail   ", "\t\r\n", "ünïcødé", "the theory"]


def test_nbest_is_exact(words):
    rng = random.Random(2)
    texts = [t for t in HARD if 0 < len(t) < 14] + ["".join(rng.choice("theanrs é😀") for _ in range(rng.randint(1, 11))) for _ in range(60)]
    encoder = sp.Encoder(words, 4)
    for t, (ids, score, others) in zip(texts, encoder.encode(texts), strict=True):
        want = every(words, " " + t)
        whole = words.nbest(" " + t, 4)
        assert [s for s, _ in whole] == want[:4], t
        assert len({i for _, i in whole}) == len(whole)
        assert [score, *(s for s, _ in others)] == want[:4], t
        assert words.decode(ids.tolist()) == t
        for _, changes in others:
            other, shift = ids.tolist(), 0
            for at, n, new in changes:
                other[at + shift : at + shift + n] = new
                shift += len(new) - n
            assert words.decode(other) == t


def test_round_trip(spark):
    rng = random.Random(4)
    texts = [None, *HARD, "word " * 40000, "y" * 5000] + ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(50)) for _ in range(50)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int").drop("ids")
    got = {r.doc_id: r for r in sp.decode_ids(sp.encode_texts(df)).collect()}
    for i, t in enumerate(texts):
        assert got[i].restored and got[i].decoded == (t or "") and got[i].n_pieces == len(got[i].ids)
    assert got[0].n_pieces == 0 and got[0].alternatives == []
    assert sp.encode_texts(df.limit(0)).count() == 0


def test_documents(spark):
    rows = sp.encode_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    assert all(r.restored and r.score >= r.alternatives[0].score >= r.alternatives[1].score for r in rows)


def test_clashing_columns_give_way(spark):
    names = ["score", "ids", "n_pieces", "alternatives", "restored", "_text", "row", "decoded", "a.b"]
    df = spark.createDataFrame([(1, "hello world", *"abcdefghi")], ", ".join(["doc_id long", "text string", *(f"`{n}` string" for n in names)]))
    got = sp.encode_texts(df)
    assert got.columns == ["doc_id", "_text", "row", "decoded", "a.b", "ids", "n_pieces", "score", "alternatives", "restored"]
    r = sp.decode_ids(got.drop("a.b")).first()
    assert r.restored and r.decoded == "hello world" and r._text == "f"


def test_chunks_at_the_border_of_the_widths():
    words = sp.vocabulary(sp.MODEL_PATH)
    rng = random.Random(8)
    for n in (sp.WIDE - 1, sp.WIDE, sp.WIDE + 1, sp.WIDE + 2):
        for _ in range(5):
            t = "".join(rng.choice("theanrsio") for _ in range(n - 1))
            (ids, score, others), = sp.Encoder(words, 3).encode([t])
            best = words.nbest(" " + t, 3)
            assert abs(score - best[0][0]) < 1e-9 and words.decode(ids.tolist()) == t
            assert [round(s, 9) for s, _ in others] == [round(s, 9) for s, _ in best[1:]]
