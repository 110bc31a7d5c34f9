"""The corpus pipeline against a plain Python version of its stages on small documents."""

import numpy as np

import corpus_pipeline
from tests.llm.test_llm import brute_components, check_packing, text


def test_stages_take_effect_in_order(spark, tmp_path):
    rng = np.random.default_rng(20)
    rows, labels = [], []
    for i in range(400):
        t = ". ".join(text(rng, 12) for _ in range(4))
        if i % 6 == 0:
            t += ". grobnik then"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    base = rows[1][1]
    rows += [(400, base.upper(), "en", "s0", 1), (401, base + " extra", "en", "s1", 1), (402, "mail password=hunter22 now", "en", "s2", 1), (403, None, None, None, None), (404, "", "en", "s0", 0), (405, rows[6][1] + " x", "en", "s0", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {i: t for i, t, *_ in rows if "grobnik" not in (t or "")}
    assert kept["toxicity"] == left
    low = {}
    for i, t in left.items():
        key = (t or "").lower()
        low[key] = max(low.get(key, -1), i)
    assert set(kept["exact dedup"]) == set(low.values())
    ids = sorted(low.values())
    comps = brute_components([left[i] for i in ids], 5, 80, 100)[1]
    assert set(kept["n-gram Jaccard join"]) == {ids[c] for c in set(comps)}
    assert kept["secret scans"][402] == "mail [secret] now"
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).withColumnRenamed("doc_id", "id").collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    check_packing(None, pieces, 4096, {i: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for i, t in kept["secret scans"].items()})
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in whole.select("doc_id").distinct().collect()) == sorted(kept["secret scans"])


def run_on(spark, folder, rows, labels, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_an_empty_table_gives_no_pieces(spark, tmp_path):
    assert run_on(spark, tmp_path, [], [], "doc_id long, text string, lang string, source string, n_chars long").count() == 0


def test_nulls_repeats_and_names_that_clash(spark, tmp_path):
    """Repeated and null ids, null columns, repeated rows, extra columns with the names that stages use."""
    long = "some words of one long text that goes on and on for a while " * 3
    rows = [(1, long, "en", "s", 9, 1, 2, 3), (1, long, "en", "s", 9, 1, 2, 3), (1, "other words", None, None, None, None, None, None), (None, long + "more", None, "s", None, 7, 8, 9), (None, None, None, None, None, None, None, None), (2, "x password=hunter22", "en", "t", 1, 4, 5, 6)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, k long, own long"
    out = run_on(spark, tmp_path, rows, [(1, 1, 0), (2, 1, 0), (None, 1, 1)], schema)
    pieces = out.collect()
    assert sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in pieces}) == [(False, 1), (False, 2), (True, 0)]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), schema)
        assert docs.columns == [c.split(" ")[0] for c in schema.split(", ")]
    kept = sorted((r["doc_id"] or 0, r["text"] or "", r["k"] or 0) for r in docs.collect())
    assert kept == [(0, "", 0), (1, "other words", 0), (1, long, 2), (2, "x [secret]", 5)]
