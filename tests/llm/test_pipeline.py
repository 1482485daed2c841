"""The stages on the smallest tables, and the registry."""

import os

import pytest
from pyspark.sql import functions as F

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    from gramloom.llm._common import Store

    store, docs = Store(spark, "stages"), spark.read.parquet(f"{SF}/documents.parquet")
    columns, out = docs.columns, {"input": docs}
    for name, stage in pipeline.STAGES:
        docs = out[name] = store.keep(stage(spark, docs, SF), name)
    assert [*out] == ["input", "quality", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(out[n].columns == columns for n in ("quality", "near_duplicates", "secrets", "mixing"))
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in out["quality"].collect()}
    clean = [i for i, x in labels.items() if x == (1, 0)]
    assert sum(i in kept for i in clean) / len(clean) > 0.98
    passed = [(r.doc_id, r.text) for r in out["quality"].collect()]
    want = {i for i, (_, c) in brute.components(passed).items() if c == i}
    assert {r.doc_id for r in out["near_duplicates"].collect()} == want
    assert not [r for r in out["secrets"].collect() if brute.base_spans(r.text)]
    texts = {r.doc_id: r.text for r in out["near_duplicates"].collect()}
    assert all(r.text == texts[r.doc_id] for r in out["secrets"].collect() if "[secret]" not in r.text)
    before = sum(len(brute.words(r.text)) for r in out["secrets"].collect())
    assert sum(len(brute.words(r.text)) for r in out["mixing"].collect()) == pytest.approx(1.5 * before, rel=0.02)
    assert out["mixing"].filter(F.length("text") != F.col("n_chars")).count() == 0
    assert {r.doc_id for r in out["packing"].collect()} == {r.doc_id for r in out["mixing"].collect()}
    again = pipeline.run(spark, SF)
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert brute.counted(again.select(cols).collect()) == brute.counted(out["packing"].select(cols).collect())


def test_registry():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names, key=lambda n: int(n[2:].split("_")[0]) if n[2].isdigit() else 99) == ["op1_media", "op2_packing", "op3_secrets", "op4_main_text", "op5_near_duplicates", "op6_repeats", "op7_neighbours", "op8_warc", "op9_quality", "op10_mixing", "pipeline"]


def test_stages_on_odd_tables(spark):
    """Further columns with names of inner ones, nulls, repeated ids and rows, a text of over 1 MB, and no rows at all."""
    from gramloom.llm._common import Store

    own = {"spans": "mine", "base_spans": "own", "uid": 1, "h": "x", "parts": "p", "_flag": 2, "_size": 3, "_shard": 4, "_order": 5, "order": 6}
    texts = ["a b c d e f g", None, "", "secret=abcdefgh1 here", "x" * 1_100_000, "one two three " * 80_000, "a b c d e f g"]
    rows = [(None if i == 3 else i // 2, t, "en", [None, "s"][i % 2], None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({k: F.lit(v) for k, v in own.items()})
    for start in (docs, docs.limit(0)):
        store, now = Store(spark, "odd"), start
        for name, stage in pipeline.STAGES:
            now = store.keep(stage(spark, now, SF), name)
            if name != "packing":
                assert now.columns == docs.columns
                assert all(tuple(r[c] for c in own) == tuple(own.values()) for r in now.collect())
        assert bool(now.count()) == bool(start.count())
        store.close()
    left = pipeline.near_duplicates_stage(spark, docs, SF).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, (r.text or "")[:3]) for r in left) == [(False, 0, "sec"), (True, 0, ""), (True, 0, "a b"), (True, 1, ""), (True, 2, "one"), (True, 2, "xxx")]
    clean = pipeline.secrets_stage(spark, docs, SF).filter("text like '%[secret]%'").collect()
    assert [(r.text, r.n_chars, r.spans) for r in clean] == [("[secret] here", 13, "mine")]


def test_few_ratings_are_all_held_out_in_turn(spark):
    """With 87 ratings, nearly all clean documents pass the fitted cut-off, and no toxic or bad one does."""
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    from gramloom.llm import quality

    keep = {r.doc_id: r.keep for r in quality.op9_quality(spark, SF).collect()}
    clean = [keep[i] for i, x in labels.items() if x == (1, 0)]
    assert sum(clean) / len(clean) > 0.98 and not any(keep[i] for i, x in labels.items() if x != (1, 0))
