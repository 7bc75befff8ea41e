"""The corpus pipeline, stage by stage, and whole."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from pairloom.llm import packing
from pairloom.llm._shared import materialise

from .test_operators import BASE, PASSAGE, prose


def test_stages_and_run(spark, tmp_path):
    texts = [prose(120, 300 + k) for k in range(30)]
    texts += [texts[0], texts[1] + " tail", "too short", None, prose(60, 7) + " " + PASSAGE, prose(60, 8) + " " + PASSAGE, BASE[0]]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(37)) - {32, 33}  # the short one and the null
    assert kept[1] == kept[0] - {30, 31}  # the copy and the near copy
    assert kept[2] == kept[1] and kept[3] == kept[2]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == kept[3]
    assert whole.columns[-2:] == ["sequence_id", "offset"] and max(r.offset + r.length for r in whole.collect()) <= packing.CAPACITY


def test_repeated_passages_go(spark):
    rows = [(1, prose(60, 7) + " " + PASSAGE, "en", "s", 0), (2, prose(60, 8) + " " + PASSAGE, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert out[1].text == rows[0][1] and PASSAGE[:60] not in out[2].text and out[2].n_chars == len(out[2].text)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone_id int, Kept_ID string, n_bytes long, n_removed int, _range int, part string"


def test_stages_take_odd_tables(spark):
    """Empty tables, nulls in every column, repeated rows, empty and very long texts, clashing names."""
    more = (7, "k", 9, 3, 1, "p")
    long_text = prose(20_000, 4)
    rows = [(k, prose(90, 600 + k), "en", "s", 9, *more) for k in range(25)]
    rows += [rows[3], rows[3], (None, prose(90, 700), "en", "s", 9, *more), (None,) * 11, (30, None, None, None, None, *more), (31, "", "en", "s", 0, *more), (32, long_text, None, "s", 1, *more), (33, prose(90, 603), "en", None, None, *more)]
    odd, empty = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, "").count() == 0
        out = stage(spark, odd, "")
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        got = out.collect()
        assert all(tuple(r)[5:] in (more, (None,) * 6) for r in got)
        kept.append([r.doc_id for r in got])
    assert sorted(kept[0], key=str) == sorted([*range(25), 3, 3, None, 32, 33], key=str) or sorted(kept[0], key=str) == sorted([*range(25), 3, 3, None, None, 32, 33], key=str)
    assert 33 not in kept[1] and kept[1].count(3) == 3 and kept[1].count(None) == 2 and {30, 31, 32} <= set(kept[1])
    assert len(kept[2]) == len(rows)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, empty, "").count() == 0
    assert sorted({r.doc_id for r in last(spark, odd, "").collect() if r.doc_id is not None}) == [*range(25), 30, 31, 32, 33]
