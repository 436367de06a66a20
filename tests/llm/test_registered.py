"""Every registered query of the subpackage and the pipeline, run whole: against SQL, the library or held-out labels."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

from lumenfold.llm import bpe, queries, token_ids

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(table):
    return sorted((tuple(round(x, 4) if isinstance(x, float) else x for x in r) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, data, sql, name):
    got = queries.QUERIES[name](spark, data)
    want = sql.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    got, want = rows(got.select(*columns).collect()), rows(want.fetchall())
    if name != "language_model_base":
        assert got == want
    else:
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5] for r in got], [r[5] for r in want], atol=2e-4)


def test_token_ids_and_bpe_equal_the_library(spark, data, sql):
    from tokenizers import Tokenizer

    texts = sql.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    library, at, want = Tokenizer.from_file(token_ids.vocabulary()), 0, []
    for i, t in texts:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    out = queries.QUERIES["op2_token_ids"](spark, data)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and sorted(map(tuple, out.collect())) == want
    library, want = Tokenizer.from_file(bpe.vocabulary()), []
    library.no_truncation(), library.no_padding()
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    out = queries.QUERIES["op8_bpe"](spark, data)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, out.collect())) == want


def test_scores_of_held_out_documents(spark, data, sql):
    label = dict(sql.execute("SELECT doc_id, max(toxic) FROM labels GROUP BY doc_id").fetchall())
    out = queries.QUERIES["op3_toxicity"](spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in out)
    mean = lambda k: np.mean([r["score"] for r in out if label.get(r["doc_id"]) == k])
    assert mean(1) > mean(0) + 0.2  # a few toxic documents among a hundred
    quality = dict(sql.execute("SELECT doc_id, min(quality) FROM labels GROUP BY doc_id").fetchall())
    out = queries.QUERIES["op9_quality"](spark, data).collect()
    assert len(out) == sql.execute("SELECT count(*) FROM documents").fetchone()[0]
    ordered = sorted(out, key=lambda r: -r["gumbel_key"])
    assert [r["selected"] for r in ordered] == sorted((r["selected"] for r in out), reverse=True)
    known = [(quality[r["doc_id"]], int(r["selected"])) for r in out if r["doc_id"] in quality]
    assert np.mean([a == b for a, b in known]) >= 0.95


def test_pages_and_language_model(spark, data, sql):
    out = queries.QUERIES["op7_html"](spark, data)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == sql.execute("SELECT count(*) FROM pages").fetchone()[0]
    assert out.where("n_chars <> length(text)").count() == 0
    out = queries.QUERIES["op6_language_model"](spark, data)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and out.where("score >= 0 or score is null").count() == 0


def test_pipeline_run(spark, data):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, data)
    assert got.count() == got.select("doc_id").distinct().count() > 0
    assert got.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, empty tables and clashing names through all stages."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, tile long, codes string, bucket int, text_ string"
    clean = " ".join(f"word{k}" for k in range(300))
    odd = [(1, None), (1, None), (2, ""), (3, clean), (3, clean), (None, clean), (None, "short"), (4, "é" * 500), (5, "x " * 900), (6, clean + " tail")]
    for name, docs in (("some", [(i, t, None, "s", None if t is None else len(t), 1, "c", 2, "t") for i, t in odd]), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 1, 0)] if docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, None), (7, "a b c")] if docs else [], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if docs:
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "3", "4", "5", "None"]
            assert [r["n_tokens"] > 0 for r in got if r["doc_id"] == 3] == [True]
        else:
            assert got == []
