"""The pipeline against the stages' brute-force versions, one after the other."""

import corpus_pipeline
from taketriage.llm import bpe, langid

from .conftest import EDGES, SCHEMA
from .test_operators import ITEMS, components, contaminated, low, plain_bits


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]


def test_run(spark, corpus, tmp_path):
    """Every row, null and repeated ids included, through the definitions."""
    docs = EDGES + [(900 + i, t, "en", "s", 0) for i, t in enumerate([ITEMS[0][1], "tiny item", "Ωμέγα ψξ ζθ " * 9])] + corpus
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    items = [x for x in ITEMS if x[0] != 11]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = [(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]

    samples = langid.sampled(spark.createDataFrame(docs, SCHEMA))
    assert "Ωμέγα" in "".join(samples["en"])
    near = lambda bits: bool(bits) and bits[min(sorted(bits), key=lambda k: bits[k][0])][1] <= langid.FAR_BITS
    kept = [(d[0], d[1]) for d in docs if near(plain_bits(samples, d[1] or ""))]
    assert {None, 1, 2, 3, 4}.isdisjoint(i for i, _ in kept) and len(kept) > len(docs) - 8
    strip = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, t in kept:
        for x in t.split("\n"):
            holders.setdefault(strip(x), set()).add(i)
    gone = lambda i, x: len(strip(x)) >= 20 and len(holders[strip(x)]) >= 3 and max(holders[strip(x)]) != i
    kept = [(i, "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t in kept]
    alone = {r[0] for r in components(kept) if r[3]}
    kept = [(i, t) for i, t in kept if i in alone]
    dirty = {r[0] for r in contaminated(kept, items) if r[5]}
    assert dirty
    enc = bpe.encoding()
    assert sorted(out) == sorted((i, tuple(enc.encode_ordinary(t))) for i, t in kept if i not in dirty)


def test_language_stage_judges_all_lengths_alike(spark, corpus):
    """Short texts in no learned language go, short ones in a learned one stay."""
    model = langid.fit(spark.createDataFrame(corpus, SCHEMA))
    docs = [(1, "the house", "en"), (2, "Ωμέγα ψ", "el"), (3, "Ωμέγα ψ " * 30, "el"), (4, "the house " * 30, "en"), (5, "qxzj wvkq", "xx"), (6, "a", "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.in_known_language(df, model).collect()) == [1, 4, 6]


def test_stages_keep_the_columns(spark, corpus_df, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, corpus_df, sf_dir).columns == corpus_df.columns, name


def test_empty_table(spark, tmp_path, sf_dir):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0, name
