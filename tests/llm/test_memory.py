"""Workers stay small in the pipeline: what packing keeps is bounded, also within one long text, and the result is the same."""

import random
from types import SimpleNamespace

import pyarrow as pa

import corpus_pipeline
from textloom.llm import _tokenize, packing
from textloom.llm.queries import tokenizer


def test_the_pipelines_packing_keeps_few_chunks(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(90_000))] + [" ".join(word() for _ in range(3_000)) for _ in range(20)] + ["", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ran, sizes = [], []
    monkeypatch.setattr(packing, "map_arrow", lambda df, fn, schema: ran.append(fn))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    corpus_pipeline.sequence_packing(spark, docs, "")
    packing.pack(docs, path := tokenizer("word_bpe_49k.json"))
    _tokenize._ENCODERS.clear()

    def rows(run):
        out = []
        for b in run(pa.record_batch({"doc_id": [i], "text": pa.array([t], pa.string())}) for i, t in enumerate(texts)):
            out += b.to_pylist()
            sizes.append(len(_tokenize._ENCODERS[path].chunks))
        return out

    assert rows(ran[0]) and max(sizes) <= 60_000
    assert rows(ran[0]) == rows(ran[1])
    bpe = _tokenize.word_bpe(path)
    assert {x["doc_id"]: x["doc_tokens"] for x in rows(ran[0])} == {i: len(x) // 4 + 1 for i, x in enumerate(bpe.whole([t or "" for t in texts]))}
