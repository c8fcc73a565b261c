"""The pipeline's stages against plain Python, one after another."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import Row

import corpus_pipeline as P
from loomgraph.llm import langid, shared, tokens
from tests.llm import brute
from tests.llm.test_operators import packed

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = tuple(langid.train(docs))
    expected = {d: r for d, r in rows.items() if any(c.isalpha() for c in r["text"] or "") and not langid.predict_one(model, r["text"])[2]}
    stages = dict(P.STAGES)

    def check(name, frame, expected):
        out = shared.written(stages[name](spark, frame, DIR), "s")
        assert out.columns == docs.columns
        assert {r["doc_id"]: r.asDict() for r in out.collect()} == {d: r if isinstance(r, dict) else r.asDict() for d, r in expected.items()}, name
        return out

    out = check("language ID", docs, expected)
    groups = brute.near_duplicates([(d, r["text"]) for d, r in expected.items()], 5, 80)
    expected = {d: r for d, r in expected.items() if groups[d][1] == d}
    out = check("near duplicates", out, expected)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    expected = {d: r for d, r in expected.items() if not any(i in " ".join(r["text"].lower().split()) for i in items)}
    out = check("decontamination", out, expected)
    found = {r["doc_id"]: r["spans"] for r in __import__("loomgraph.llm.secrets", fromlist=["report"]).report(out).collect()}
    clean = {}
    for d, r in expected.items():
        text, spans, at, parts = r["text"], [tuple(map(int, s.split(":")[1:])) for s in found[d].split(",") if s], 0, []
        merged = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            parts += [text[at:a], "[SECRET]"]
            at = b
        text = "".join(parts) + text[at:]
        clean[d] = r.asDict() | {"text": text, "n_chars": len(text) if spans else r["n_chars"]}
    out = check("secret scan", out, clean)
    last = stages["best-fit packing"](spark, out, DIR).collect()
    enc = tokens.encoder(public_tokenizers.path(P.TOKENIZER)).tokenizer
    ids = {d: [*enc.encode(r["text"], add_special_tokens=False).ids, 0] for d, r in clean.items()}
    for r in last:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    total = sum(map(len, ids.values()))
    assert sum(r["length"] for r in last) == total and packed(last, 2048) <= -(-total // 2048) + 1


def test_odd_rows(spark):
    rows = [Row(doc_id=d, text=t, lang=x, source="s", n_chars=1) for d, t, x in [(1, "hello world this is a text", "en"), (1, "another text with the same id", "en"), (1, "hello world this is a text", "en"), (2, None, "en"), (3, "", None), (None, "a text without an id", "en"), (4, "12 34", "en"), (5, "password = secret99 is here", None)]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for table in (frame, frame.limit(0)):
        docs = table
        for _, stage in P.STAGES[:-1]:
            docs = shared.written(stage(spark, docs, DIR), "s")
        got = sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect())
        assert got == ([(0, "a text without an id"), (1, "another text with the same id"), (5, "[SECRET] is here")] if table is frame else [])
        P.STAGES[-1][1](spark, docs, DIR).collect()
