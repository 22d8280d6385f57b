"""run() of the pipeline against a brute-force pipeline on a small fixture."""

import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers

import corpus_pipeline
from chronoloom.llm import quality, secrets
from chronoloom.llm.common import read, shared_dir

from .test_operators import DIR, brute_links, brute_repeats


def test_run_against_brute_force(spark):
    """Models of quality and secrets are taken as fitted; links, repeats and packing are worked out anew."""
    from tokenizers import Tokenizer

    docs = read(spark, DIR, "documents")
    rows = [(r["doc_id"], r["text"]) for r in quality.filter_documents(docs, read(spark, DIR, "labels")).collect()]
    heads = {d for d, root, _ in brute_links(rows) if d == root}
    rows = [(d, b.decode("utf-8", "ignore")) for d, b, _ in brute_repeats([r for r in rows if r[0] in heads])]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in secrets.redact(left, secrets.fit(left)).collect()]
    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in rows}
    got, at = defaultdict(list), 0
    for r in sorted(corpus_pipeline.run(spark, DIR).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["sequence_id"] * 2048 + r["offset"] == at and r["length"] == len(ids) and r["start"] == len(got[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["doc_tokens"] == len(want[r["doc_id"]])
        got[r["doc_id"]] += ids
        at += len(ids)
    assert dict(got) == want


def test_run_keeps_one_table(spark, monkeypatch):
    """A stage's table goes once the next one is written; the last stays and can be read."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda spark, docs, sf_dir: docs) for i in range(4)])
    held = Path(shared_dir(spark)) / "chronoloom"
    before = set(held.glob("pipeline-*")) if held.exists() else set()
    out = corpus_pipeline.run(spark, DIR)
    assert [p.name.rsplit("-", 1)[0] for p in set(held.glob("pipeline-*")) - before] == ["pipeline-3"]
    assert out.count() == read(spark, DIR, "documents").count()
