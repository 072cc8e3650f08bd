"""What must not grow faster than the tables: comparisons of terms, rows of joins, rows of one task, texts held at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from cloakframe.operators import chunks, dictionary, discover, patterns, resolve
from cloakframe.operators.graph import cut
from cloakframe.plans import queries

TERMS = [f"the.{i:02}@mail{k}.example.com" for i in range(100) for k in range(9)]


def test_terms_that_share_a_word_are_not_all_compared(monkeypatch):
    book, compared = dictionary.Dictionary(TERMS), []
    end = dictionary.Dictionary.end
    monkeypatch.setattr(dictionary.Dictionary, "end", lambda self, i, text, at: compared.append(i) or end(self, i, text, at))
    text = "The cat and the dog of the house wrote to THE.07@mail3.example.com. " * 5
    assert {(text[s:e], book.terms[i]) for s, e, i in book.find(text)} == {("THE.07@mail3.example.com", "the.07@mail3.example.com")}
    assert len(compared) == 5


def test_names_that_share_a_word_are_not_all_compared():
    names = ["the", "the cat", "the dog of", "ete", *(f"the x{i}" for i in range(1000))]
    text = "The cat, the\ndog of THE. CAT and the été"
    assert sorted((text[s:e], names[i]) for s, e, i in discover.Seeds(names).find(text)) == [
        ("THE", "the"), ("THE. CAT", "the cat"), ("The", "the"), ("The cat", "the cat"), ("the", "the"), ("the", "the"), ("été", "ete"),
    ]


def test_only_sequences_that_may_be_terms_are_joined(spark):
    terms = spark.createDataFrame([(t,) for t in [*TERMS, "Straße 7", "été"]], "t string")
    asked = dictionary.word_sequence(terms, "t", dictionary.words)
    texts = spark.createDataFrame([(i, "the cat and the dog of the house") for i in range(200)] + [(900, "THE.07@mail3.example.com, STRASSE 7, Straße 7, STRAẞE 7, ÉTÉ")], "k long, x string")
    rows = dictionary.sequence_rows(texts, ["k"], "x", dictionary.words, *dictionary.bitmap_of(asked)).collect()
    assert len(rows) < 20 and {"the 07 mail3 example com", "strasse 7", "été"} <= {r._w for r in rows if r.k == 900}


def test_edges_of_families_with_a_common_first_word(spark):
    long = "The One Two Three Four Five Six Seven Eight Nine"
    names = ["The Alpha", "The Alpha Group", "The Beta", "Beta", long, long + " Ten", "Group (The Alpha)", "Alphas"]
    rows = spark.createDataFrame([(i, n, "entity_names") for i, n in enumerate(names)], "ord long, main_text string, category string")
    edges = discover.family_edges(rows)
    assert {(names[r.a], names[r.b]) for r in edges.collect()} == {("The Alpha", "The Alpha Group"), ("The Alpha", "Group (The Alpha)"), ("Beta", "The Beta"), (long, long + " Ten")}
    many = spark.range(2000).select(F.col("id").alias("ord"), F.concat(F.lit("The N"), "id").alias("main_text"), F.lit("entity_names").alias("category"))
    joins = discover.family_edges(many)._jdf.queryExecution().analyzed().toString()
    assert discover.family_edges(many).count() == 0 and "array_join" in joins


def test_a_table_of_one_row_group_is_dealt(spark):
    rows = queries.source(spark, "/root/testdata/sf0.1", "SELECT c_custkey FROM customer")
    parts = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 15000 / 3
    assert "Repartition" not in queries.source(spark, "/root/testdata/sf0.1", "SELECT n_name FROM nation")._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_is_looked_at_in_pieces():
    batch = pa.RecordBatch.from_pydict({"k": list(range(100)), "x": ["é" * 500] * 60 + [None] * 40})
    parts = list(dictionary.slices(batch, "x", 10_000))
    assert [r for p in parts for r in p.column("k").to_pylist()] == list(range(100))
    assert len(parts) == 6 and all(p.num_rows <= 50 for p in parts)


def test_packing_joins_each_unit_once(monkeypatch):
    joined = []

    class Joiner(str):
        def join(self, parts):
            joined.append(len(parts))
            return str.join(self, parts)

    units = ["x"] * 5000
    packs = chunks.pack_units(units, "faster", joiner=Joiner("\n"))
    assert [u for _, _, t in packs for u in t.split("\n")] == units and sum(joined) == 5000
    assert all(len(t.encode()) <= 4000 for _, _, t in packs)


def test_spans_are_not_put_together_into_few_tasks(spark):
    rows = cut(patterns.finished(queries.source(spark, "/root/testdata/sf0.001", queries._CLAIMED)))
    unified = resolve.unify_ownership(rows)
    assert unified.rdd.getNumPartitions() >= 4
