"""The pipeline's stages against brute force on their own input, on the smallest tables."""

import numpy as np
from tokenizers import Tokenizer

from eventlens.llm import quality
from eventlens.llm.tokens import vocabulary_path
from tests.llm.test_text_operators import contamination_brute, jaccard_brute, lines_brute

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows(docs)
        docs = stage(spark, docs, SF).cache()
        if i == 4:
            library, pieces = Tokenizer.from_file(vocabulary_path()), {}
            for r in sorted(docs.collect(), key=lambda r: r.start):
                pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
            assert pieces == {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t in before}
            break
        assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
        after = rows(docs)
        kept.append((len(before), len(after)))
        if i == 0:
            marked = [(labels[d], d in dict(after)) for d, _ in before if d in labels]
            assert sum(q == k for q, k in marked) >= 0.95 * len(marked)
            whole = spark.read.parquet(f"{SF}/documents.parquet")
            model = quality.train_quality(whole, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = {d: float(model.score(quality.features([None if t is None else t.encode()]))[0]) for d, t in before}
            assert {d for d, _ in after} == {d for d, x in scores.items() if x >= 0.7}
        elif i == 1:
            assert sorted(after) == sorted((d, t) for d, _, _, t in lines_brute(before))
        elif i == 2:
            assert {d for d, _ in after} == {c for _, _, c in jaccard_brute(before, 5, 80)}
        elif i == 3:
            assert {d for d, _ in after} == {d for d, *_, bad in contamination_brute(before, items) if not bad}
    assert len(kept) == 4
