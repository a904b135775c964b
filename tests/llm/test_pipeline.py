"""Each stage of the pipeline on what the stage before it kept, against plain Python."""

import brute
import corpus_pipeline

from strandbook.llm import mixing, piece_codec

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    before, good = rows(docs), rows(stages["quality rules"](spark, docs, DIR))
    for i, r in before.items():
        n_words, _, _, _, repeated = brute.quality(r["text"])
        assert i not in good or n_words >= 50 and 100 * repeated <= 50 * n_words
    assert len(good) > 0 and all(good[i] == before[i] for i in good)

    table = spark.createDataFrame(list(good.values()), docs.schema)
    single = stages["n-gram Jaccard join"](spark, table, DIR)
    groups = brute.jaccard_components([(i, r["text"]) for i, r in good.items()], 5, 80, 100)
    assert single.columns == columns and set(rows(single)) == {component for _, component in groups.values()}

    clean = stages["PII"](spark, single, DIR)
    found = rows(clean)
    for i, r in rows(single).items():
        text = found[i]["text"]
        assert found[i]["n_chars"] == len(text) and (brute.pii(r["text"]) or "[OTHER]" in text or text == r["text"])
        assert not brute.pii(r["text"]) or text != r["text"]

    mixed = stages["mixing sources to target weights"](spark, clean, DIR).collect()
    sizes, taken, largest = {}, {}, {}
    for i, r in found.items():
        n = len(brute.WORD.findall(r["text"]))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        largest[r["source"]] = max(largest.get(r["source"], 0), n)
    for r in mixed:
        assert found[r["doc_id"]] == r
        taken[r["source"]] = taken.get(r["source"], 0) + len(brute.WORD.findall(r["text"]))
    targets = mixing.targets_for(list(sizes.items()))
    assert all(abs(taken.get(s, 0) - targets[s]) <= largest[s] for s in sizes)

    coded = stages["SentencePiece encoding and decoding"](spark, spark.createDataFrame(mixed, docs.schema), DIR).collect()
    assert len(coded) == len(mixed) and all(r["piece_ids"] == model.encode(found[r["doc_id"]]["text"]) for r in coded)
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages) and corpus_pipeline.ORACLE_SQL is None
