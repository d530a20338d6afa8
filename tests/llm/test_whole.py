"""Inputs of which an operator once took only a part."""

import random

import numpy as np
import pyarrow.parquet as pq

from sluice.llm import packing, toxicity


def toxic_model():
    rng = random.Random(6)
    sample = []
    for k in range(400):
        words = [rng.choice(["stone", "river", "wind", "meadow", "cloud", "harbour"]) for _ in range(30)]
        if k % 3 == 0:
            words[rng.randrange(30)] = rng.choice(["wretch", "dimwit", "blockhead"])
        sample.append((" ".join(words), int(k % 3 == 0)))
    return toxicity.train(sample, epochs=30)


def test_toxicity_reads_long_runs_to_their_end():
    model = toxic_model()
    clean = ["stone", "river", "wind", "meadow", "cloud", "harbour"] * 4
    for joiner in ("-", "_", "/", ".", ",", ""):
        for at in (0, 12, len(clean)):
            run = joiner.join([*clean[:at], "dimwit", *clean[at:]])
            toxic, harmless = model.scores([run, joiner.join(clean)])
            assert toxic > harmless, (joiner, at)
            if joiner:
                assert toxic >= 0.5 > harmless, (joiner, at)


def test_toxicity_long_runs_differ_behind_their_start():
    runs = ["x" * 40 + c for c in "abcx"]
    assert len({tuple(toxicity.grams([r])[1]) for r in runs}) == 4
    assert len({tuple(toxicity.grams(toxicity.words_of(r))[1]) for r in runs}) == 4
    # every n-gram of a long run is in a piece of it
    run = "".join(chr(0x4E00 + k) for k in range(100))
    for size in range(41, 100):
        parts = toxicity.words_of(run[:size])
        assert all(any(run[k : k + 7] in p for p in parts) for k in range(size - 6))
    assert toxicity.words_of("a b " + "=" * 40) == ["a", "b", "=" * 40]


def test_packing_may_cut_at_every_sentence_end():
    at, cost = packing.places(np.array([1, 2, 3, 5, 6, 7, 80]), 81)
    assert at.tolist() == [1, 2, 3, 5, 6, 7, 71, 80, 81]
    assert cost.tolist() == [2, 2, 2, 2, 2, 2, 12, 2, 0]


def read_batches(df):
    """How many batches a frame that was run read from Parquet."""
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.metrics().contains("numInputBatches"):
            found += node.metrics().apply("numInputBatches").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_pipeline_holds_few_long_rows_at_a_time(spark, tmp_path):
    import corpus_pipeline
    from sluice.llm import common

    rows = [(k, f"word{k} " * 20_000, "en", "s", 0) for k in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = {k: spark.conf.get(k, None) for k in [*common.FEW_ROWS, "parquet.block.size"]}
    try:
        spark.conf.set("parquet.block.size", str(1 << 20))
        spark.conf.set("parquet.enable.dictionary", "false")
        spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
        packed = corpus_pipeline.packed(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).select("length")
        assert packed.collect()
        assert read_batches(packed) >= 64 / 8
        spark.read.parquet(f"{tmp_path}/documents.parquet").coalesce(1).write.parquet(f"{tmp_path}/stage")
        (part,) = tmp_path.glob("stage/*.parquet")
        assert pq.ParquetFile(part).metadata.num_row_groups >= 4  # about 9 MB of text in groups of about 1 MB
    finally:
        common.settings(spark, held | {"parquet.enable.dictionary": None, "spark.sql.parquet.compression.codec": None})


def test_pipeline_puts_settings_back(spark, tmp_path):
    import corpus_pipeline
    from sluice.llm import common

    before = {k: spark.conf.get(k, None) for k in common.FEW_ROWS}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert {k: spark.conf.get(k, None) for k in common.FEW_ROWS} == before
    common.release(spark)
