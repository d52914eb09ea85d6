"""Each operator on nulls, empty tables, repeats, long texts and columns with clashing names."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ionframe.llm import decontaminate, embeddings, html_text, langid, lines, minhash, packing, pii, quality, secrets

LONG = "word " * 40_000
ODD = [(1, None), (2, ""), (3, "   \t\n"), (None, "a b c d e f g"), (5, LONG), (6, "one two three four five six seven eight"), (6, "one two three four five six seven eight"), (7, "😀 ünïcode text é")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with further columns named as operators name theirs."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("doc_id", "text", F.lit("x").alias("lang"), *[F.lit(7).alias(c) for c in ("node", "bucket", "key", "score", "first", "component_id", "n_lines", "gone")])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_packing(odd, none):
    rows = packing.pack(odd).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sum(1 for r in rows if r.doc_id in (1, 2)) == 2 and all(r.length == 1 for r in rows if r.doc_id in (1, 2))
    assert sum(n for _, n in whole[5, rows[[r.doc_id for r in rows].index(5)].doc_tokens]) == next(r.doc_tokens for r in rows if r.doc_id == 5)
    assert packing.pack(none).count() == 0


def test_minhash(odd, none):
    got = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(odd).collect()}
    assert got[1, 0].component_id == 1 and got[2, 0].kept and got[3, 0].kept
    assert got[None, 3].component_id is None and got[None, 3].kept
    assert minhash.near_duplicates(odd).count() == len(ODD)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1 and kept.where("doc_id = 6").count() == 1


def test_lines(spark, odd, none):
    got = lines.dedup_lines(odd)
    assert got.count() == len(ODD) and got.where("doc_id = 1").head().text is None
    assert lines.dedup_lines(none).count() == 0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (6, 1), (6, 0)], "doc_id long, quality int")
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert quality.quality_scores(none, labels.where("false")).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_language(odd, none):
    rows = {r.doc_id: r for r in langid.languages(odd).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[7].lang_pred in ("x", "und")
    assert langid.languages(none).count() == 0


def test_decontamination(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four. five six seven eight."), (None, "x"), (2, None), (3, "word"), (1, "one two three four. five six seven eight.")], "item_id long, text string")
    rows = decontaminate.contaminated(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(6, 1)} and len(rows) == 2
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(odd, items.where("false")).count() == 0
    kept = decontaminate.keep_clean(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    many = decontaminate.contaminated(odd, items, block_bytes=10).collect()  # one block per few items
    assert {(r.doc_id, r.item_id) for r in many} == {(6, 1)}


def test_private_data_and_secrets(odd, none):
    model = ([0.0], {k: float("inf") for k in pii.KINDS})
    empty = hashlib.sha256(b"").hexdigest()
    for rows in (pii.find(odd, model=model).collect(), secrets.find(odd).collect()):
        assert len(rows) == len(ODD) and all(r.base_sha256 == empty and r.spans == "" for r in rows)
    assert pii.find(none, model=model).count() == 0 and secrets.find(none).count() == 0


def test_pages(spark):
    rows = [(1, None, "<p>no host</p>"), (2, "https://A.example/x", None), (3, "http://a.example:80/", ""), (4, "x", "<p>&amp;" + "<b>" * 3000), (None, "http://a.example/", "<article><p>One <i>two</i>.</p><p>&lt;x&gt;</article><p>after"), (6, "http://b.example", "<<>>< <a <p")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, winner int")
    got = {r.page_id: r for r in html_text.main_texts(df).collect()}
    assert got[None].text == "One two.\n\n<x>" and got[2].text == got[3].text == "" and got[1].text == "no host" and got[4].text == "&"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_texts(df.where("false")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.1], 1), (12, [1e300, 1e300], 1), (1, [1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert embeddings.near_vectors(df).count() == len(rows)
    assert got[1].n_links == 3 and got[2].component_id == got[11].component_id == 1 and not got[2].kept
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert got[None].component_id is None and got[None].n_links == 0
    assert embeddings.near_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("nth", range(5))
def test_pipeline_stages(spark, odd, none, nth, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None), (6, 1), (7, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "what is it that no text here holds at all nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = p.STAGES[nth]
    docs = odd.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("a.b", F.lit(1)).withColumn("_gone_id", F.lit(2)).withColumn("_kept", F.lit(2)).withColumn("_nth", F.lit(2))
    got = p.stored(stage(spark, docs, str(tmp_path)), "tested")
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    if name != "packing":
        assert got.columns == docs.columns and got.count() <= len(ODD)
    if name == "near_dedup":
        assert got.count() == len(ODD) - 1
    if name != "quality":
        assert ids == {1, 2, 3, 5, 6, 7, None}


def test_nothing_else_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).resolve().parents[2]
    for f in (root / "ionframe").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", f.read_text(), re.M), f
