import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from keyloom.llm.packing import piece_lengths
from keyloom.llm.quality_classifier import fit, score
from tests.llm.helpers import SF
from tests.llm.test_dedup import brute_components, brute_spans


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        before, after = docs.collect(), out.collect()
        seen[name] = (before, after)
        docs = out
    before, after = seen["quality"]
    model = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    accepted = {r.doc_id for r in score(spark.read.parquet(f"{SF}/documents.parquet"), model).where("kept").collect()}
    assert 0 < len(after) < len(before) and sorted(after) == sorted(r for r in before if r.doc_id in accepted)
    before, after = seen["exact"]
    best = {}
    for r in before:
        t = (r.text or "").translate({c: c + 32 for c in range(65, 91)})
        best[t] = max(best.get(t, r), r, key=lambda x: x.doc_id)
    assert sorted(after) == sorted(best.values())
    before, after = seen["near"]
    stay = {c[0] for c in brute_components([(r.doc_id, r.text) for r in before]) if c[3]}
    assert sorted(after) == sorted(r for r in before if r.doc_id in stay)
    before, after = seen["passages"]
    whole = {r.doc_id: r.text for r in before}
    cut = {d: t if gone else whole[d] for d, t, _, gone in brute_spans([*whole.items()], 35)}
    assert {r.doc_id: r.text for r in after} == cut and {r.doc_id: (r.lang, r.source) for r in after} == {r.doc_id: (r.lang, r.source) for r in before}
    before, after = seen["packing"]
    library, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for r in before:
        ids, at = library.encode(r.text, add_special_tokens=False).ids + [1], 0
        for n in piece_lengths(len(ids), 2048):
            expected.add((r.doc_id, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in after} == expected
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces} == expected


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "the same text is here", "en", None, 3), (1, "the same text is here", "en", None, 3), (None, None, None, None, None), (None, "x", "de", "s", 1), (2, "The same TEXT is here", "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
            out.collect()


def test_near_keeps_one_of_rows_that_repeat_an_id(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, " ".join([*words[:-1], "x"])), (2, " ".join([*words[:-1], "y"])), (3, None), (4, ""), (None, "one two"), (5, "alone " * 3)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, row string, kept boolean"
    docs = spark.createDataFrame([(d, t, "en", None, 0, "r", False) for d, t in rows], kind)
    got = corpus_pipeline.near(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    assert got[0].asDict().keys() == set(corpus_pipeline.COLUMNS) and corpus_pipeline.near(spark, docs.limit(0), SF).count() == 0
