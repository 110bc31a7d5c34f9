"""Training-data operators: hot keys, ties, names that clash, markup without end, whole licences, held-out layouts."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plantwatch.llm import html_blocks, nearest, ngram_join
from plantwatch.llm.exact_dedup import drop_exact_copies
from plantwatch.llm.licenses import license_scan
from plantwatch.llm.secrets import redact_secrets
from tests.llm.test_llm import CASES, brute_components, corpus, documents, near_corpus, no_rows, page, text


def test_word_encoder_is_the_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from plantwatch.llm.word_bpe import WordEncoder

    path = P.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(8)
    letters = list("abcdefgÀÉéßñXYZ×÷.,!*9'")
    texts = [*CASES, "ΣΑΣ Σ, İstanbul. ǅ Éa. é. word.'s (a) a.b,", *(text(rng, 30) + "." for _ in range(20)), "Word, word. WORD! it's", None, "", "\x00", "a\x00 \x00\x00", "q" * 24, "q" * 25, "ab" * 12 + "." * 9]
    texts += [" ".join("".join(rng.choice(letters, int(n))) for n in rng.integers(1, 40, 30)) for _ in range(60)]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for slots in (1 << 6, 1 << 16):  # few slots: words take each other's place
        own = WordEncoder(path, slots)
        for _ in range(2):  # new words, then known ones
            flat, bounds = own.encode(pa.array(texts, pa.string()))
            for k, ids in enumerate(want):
                assert flat[bounds[k] : bounds[k + 1]].tolist() == ids, repr(texts[k])
    assert own.encode(pa.array([], pa.string()))[0].tolist() == []


# --- near copies ----------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [2_000_000, 30_000, 2_000])
def test_keys_that_most_of_a_slice_share(spark, tile):
    """Merged keys, stars and tiles: two large groups in one slice, and the rest apart."""
    rng = np.random.default_rng(31)
    texts = []
    for _ in range(2):
        base = text(rng, 80).split(" ")
        for i in range(90):
            w = list(base)
            for at in rng.integers(0, 80, 1 + i % 3):
                w[at] = f"e{rng.integers(0, 9999)}"
            texts.append(" ".join(w))
    texts += [text(rng, 80) for _ in range(25)]
    again = corpus(spark, texts[:5]).withColumn("doc_id", F.col("doc_id") + 1000)
    df = corpus(spark, texts).coalesce(1).union(again)
    got = {r["id"]: r["component_id"] for r in ngram_join.near_duplicates(df, tile_elements=tile).collect()}
    comps = brute_components(texts, 5, 80, 100)[1]
    assert [got[i] for i in range(len(texts))] == comps and [got[1000 + i] for i in range(5)] == comps[:5]


def test_sets_that_share_a_name_are_told_apart(spark):
    texts = near_corpus(np.random.default_rng(32))
    comps = brute_components(texts, 5, 80, 100)[1]
    got = {r["id"]: r["component_id"] for r in ngram_join.near_duplicates(corpus(spark, texts), name_bits=6).collect()}
    assert [got[i] for i in range(len(texts))] == comps


def test_the_dual_traversal_leaves_out_most_pairs(monkeypatch):
    rng = np.random.default_rng(33)
    sets = [np.unique(rng.integers(0, 2**63, int(n)).astype(np.uint64)) for n in np.repeat([40, 90, 200, 450], 60)]
    sets += [np.unique(np.concatenate([x[3:], rng.integers(0, 2**63, 2).astype(np.uint64)])) for x in sets[::4]]
    compared, plain = [0], np.searchsorted
    monkeypatch.setattr(ngram_join.np, "searchsorted", lambda *a, **k: compared.__setitem__(0, compared[0] + 1) or plain(*a, **k))
    links = ngram_join.link_sets(sets, 80, 100)
    assert len(links) == 60 and compared[0] < 0.05 * len(sets) * (len(sets) - 1) / 2


def test_one_row_of_each_group_of_near_copies_stays(spark):
    rows = [(7, "a b c d e f g", "en", "s", 1, "p", "q", 1), (3, "a b c d e f g", "en", "s", 1, "p", "q", 2), (3, "a b c d e f g", "en", "s", 1, "p", "q", 3), (None, "A b c d e f g", "en", "s", 1, "p", "q", 4), (3, "other words here", "en", "s", 1, "p", "q", 5), (9, None, "en", "s", 1, "p", "q", 6), (10, "", "en", "s", 1, "p", "q", 7)]
    df = documents(spark, rows)
    kept = ngram_join.drop_near_copies(df)
    out = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert out == [("10", ""), ("3", "a b c d e f g"), ("3", "other words here"), ("9", "")] and kept.columns == df.columns
    unique = documents(spark, [rows[0], rows[1], rows[5]])
    assert sorted(r["doc_id"] for r in ngram_join.drop_near_copies(unique).collect()) == [3, 9]
    assert ngram_join.drop_near_copies(no_rows(spark)).count() == 0


def test_columns_of_any_name_stay(spark):
    df = corpus(spark, ["a b c d e f g h", "A b c d e f g h", "x password=hunter22"])
    for name in ("_id", "_own", "_sha", "k", "_spans", "own", "sha", "kept", "spans"):
        df = df.withColumn(name, F.col("doc_id"))
    for kept in (drop_exact_copies(df), ngram_join.drop_near_copies(df), redact_secrets(df)):
        assert kept.columns == df.columns and all(r["_own"] == r["_id"] == r["_spans"] == r["doc_id"] for r in kept.collect())


# --- vectors --------------------------------------------------------------------------------------


def brute_nearest(ids, x, q, k):
    score = nearest.cosine(np.broadcast_to(x[q], x.shape), x)
    return [int(ids[i]) for i in np.lexsort((ids, -score)) if i != q][:k]


@pytest.mark.parametrize("shard", [10_000, 60])
def test_ties_beyond_k_go_to_the_smaller_ids(spark, shard):
    rng = np.random.default_rng(34)
    centres = rng.normal(0, 1, (6, 8))
    x = centres[rng.integers(0, 6, 300)] + rng.normal(0, 0.1, (300, 8))
    x[20:60] = np.round(x[20]) * 2.0 ** np.arange(40)[:, None]  # collinear: one cosine
    x[60:80] = x[60]
    x[100] = [0, 1, 0, 0, 0, 0, 0, 0]
    x[101] = [-0.0, 1, 0, 0, 0, 0, 0, 0]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, [1.0, 2.0]), (5001, [2.0, 4.0]), (5050, [3.0])], "vec_id long, embedding array<double>")
    got = nearest.nearest(df, df.where("vec_id % 10 = 0"), 5, 1.0, shard_rows=shard, block_queries=8).toPandas()
    for q in range(0, 300, 10):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == brute_nearest(np.arange(300), x, q, 5), q
    assert got[got.query_id == 5000].vec_id.tolist() == [5001] and not len(got[got.query_id == 5050])


def test_regions_leave_shards_out_where_vectors_cluster():
    rng = np.random.default_rng(35)
    x = nearest._unit(rng.normal(0, 1, (16, 12))[rng.integers(0, 16, 4000)] + rng.normal(0, 0.05, (4000, 12)))
    router = nearest.Router(x[:1000], 16)
    at, region = router.regions(x, np.full(4000, -1.0))
    assert sorted(at) == list(range(4000)) and len(np.unique(region)) == router.leaves > 8
    own = np.empty(4000, int)
    own[at] = region
    d = np.sqrt(((x[:200, None] - x[None]) ** 2).sum(axis=2))
    reach = np.sort(d, axis=1)[:, 5]
    who, asked = router.regions(x[:200], reach + 1e-9)
    assert all(set(own[np.argsort(d[i], kind="stable")[:6]]) <= set(asked[who == i]) for i in range(200)) and len(who) < 0.5 * 200 * router.leaves


def test_nearest_on_the_given_vectors_reaches_the_recall(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no given tables")
    df = spark.read.parquet(path)
    rows = df.toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = nearest.nearest(df, df.where("vec_id % 50 = 0"), 5, shard_rows=500).toPandas()
    hit = sum(len(set(got[got.query_id == ids[q]].vec_id) & set(brute_nearest(ids, x, q, 5))) for q in np.flatnonzero(ids % 50 == 0))
    assert hit >= 0.9 * 5 * (ids % 50 == 0).sum()


# --- licences -------------------------------------------------------------------------------------


def test_whole_licences_are_found(spark):
    from plantwatch.llm.licence_texts import TEMPLATES, WHOLE

    rng = np.random.default_rng(36)
    names = sorted(WHOLE)
    texts = [f"{text(rng, 200)}\n\n{WHOLE[n]}\n{text(rng, 100)}" for n in names]
    wrapped = " ".join(WHOLE["MIT-text"].split())
    texts += ["\n".join(wrapped[i : i + 70] for i in range(0, len(wrapped), 70)), wrapped.upper(), text(rng, 60_000), None]
    got = {r["id"]: r for r in license_scan(corpus(spark, texts)).collect()}
    for k, n in enumerate(names):
        assert got[k]["dice"] > 0.8 and (got[k]["license"] == n or TEMPLATES[got[k]["license"]].rstrip(".") in TEMPLATES[n].replace("\n", " ")), n
    assert got[len(names) + 1]["license"] == "MIT-text" and got[len(names) + 1]["n_matches"] >= 2 and got[len(names) + 2]["license"] is None and got[len(names) + 3]["n_matches"] == 0
    same = corpus(spark, ["Released under the MIT License.\nReleased under the MIT License."]).union(corpus(spark, ["Released under the MIT License."]))
    assert sorted((r["license"], r["unit"]) for r in license_scan(same).collect())[0][0] == "MIT" and license_scan(same).count() == 2
    repeated = license_scan(corpus(spark, [WHOLE["MIT-text"], "\n\n".join(f"{text(rng, 40)}\n{WHOLE['MIT-text']}" for _ in range(30))])).collect()
    assert [r["license"] for r in repeated] == ["MIT-text"] * 2 and {r["dice"] for r in repeated} == {1.0}


def test_spans_of_a_licence_against_all_spans(spark):
    from plantwatch.llm.licenses import python_bigrams

    rng = np.random.default_rng(71)
    templates = {"small": "a b c d a", "large": "a b c d a e b d", "twice": "a b c d a"}
    texts = [" ".join(rng.choice(list("abcdexyz"), rng.integers(2, 60), p=[0.2, 0.2, 0.15, 0.15, 0.1, 0.1, 0.05, 0.05])) for _ in range(60)]
    own = {k: set(python_bigrams(t)) for k, t in templates.items()}
    got = {r["id"]: r for r in license_scan(corpus(spark, texts), templates=templates, threshold=0.6).collect()}
    for k, t in enumerate(texts):
        w = t.split()
        g = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        dice = lambda x, o: 2.0 * len(set(x) & o) / (len(set(x)) + len(o))
        hits = [(-dice(g, o), -len(o), n, u) for n, o in own.items() for u in (0, 1) if dice(g, o) >= 0.6]
        for n, o in own.items():
            if not any(h[2] == n for h in hits):
                most = int(1.4 * len(o) / 0.6 + 1e-9)
                spans = [(-dice(g[a:b], o), -len(o), n, -a - 1) for a in range(len(g)) for b in range(a + 1, min(len(g), a + most) + 1) if g[a] in o]
                hits += [min(s for s in spans if -s[0] >= 0.6)] if any(-s[0] >= 0.6 for s in spans) else []
        want = min(hits, default=(None, 0, None, None))
        assert (got[k]["license"], got[k]["unit"], got[k]["n_matches"]) == (want[2], want[3], len(hits)), t
        assert got[k]["dice"] == (None if want[0] is None else -want[0])


# --- pages ----------------------------------------------------------------------------------------


def test_markup_that_is_never_closed_takes_linear_time():
    for unit, n in (("<a ", 60_000), ("<a '", 60_000), ('<a "x" ', 40_000), ("<", 200_000), ("<!--", 60_000), ("<div>a", 30_000), ("</x>y", 40_000), ("<p", 60_000), ("<![CDATA[", 40_000)):
        start = time.process_time()
        html_blocks.blocks(unit * n)
        html_blocks.blocks(unit * n + '">')
        assert time.process_time() - start < 4, unit
    deep = html_blocks.blocks("<div>" * 2000 + "x" + "</div>" * 2000 + "<p>y</p>")
    assert [t for _, t, _ in deep] == ["x", "y"] and deep[1][0] == ("<p>",)


def test_all_words_of_a_block_are_read():
    _, read, _ = html_blocks.features([(("<p>",), " ".join(f"w{i}" for i in range(3000)), 0), (("<p>",), "one", 0)])
    assert read.sizes.tolist() == [3000, 1] and len(read.buckets) == 3001


def test_scores_need_no_gradient_states():
    model = html_blocks.Labeller()
    long = html_blocks.features([(("<p>", f"c{i % 7}"), f"some words {i}", 0) for i in range(5000)])
    alone, together = model.scores([long])[0], model.scores([long, html_blocks.features([(("<p>",), "x", 0)])])[0]
    assert np.allclose(alone, together, atol=1e-4) and len(alone) == 5000
    x, mask, _ = model._inputs([long])
    assert np.allclose(model._lstm(x, mask, "f")[0], model._lstm(x, mask, "f", False)[0])


def test_main_text_of_skeletons_without_names(spark):
    rng = np.random.default_rng(16)
    rows, want = [], []
    for i in range(60):
        body = [text(rng, int(n)) for n in rng.integers(5, 60, 5)]
        rows.append((i, f"http://h/{i}", page(f"<header><h2>Site</h2></header><nav><ul><li><a href=/a>{text(rng, 2)}</a></li></ul></nav><article><h1>{body[0]}</h1>{''.join(f'<p>{x}</p>' for x in body[1:])}</article><aside><p>{text(rng, 9)}</p></aside><footer>{text(rng, 6)}</footer>")))
        want.append(" ".join(body))
    n = len(rows)
    skeletons = [
        lambda a: "".join(f"<p>{x}</p>" for x in a),  # nothing but paragraphs
        lambda a: f"<p>{' '.join(a)}</p>",
        lambda a: f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><h1>{a[0]}</h1>{''.join(f'<p>{x}</p>' for x in a[1:])}<footer>&copy; 2020 site</footer></body></html>",
        lambda a: f'<html><body><div class="x9"><ul class="menu"><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></div><div class="qz"><div class="kk"><h2>{a[0]}</h2>{"".join(f"<p>{x}</p>" for x in a[1:])}</div></div><div id="footer">All rights reserved</div></body></html>',
        lambda a: f"<body><div>{'<br><br>'.join(a)}</div></body>",
    ]
    for make in skeletons:
        for _ in range(12):
            body = [text(rng, int(k)) + "." for k in rng.integers(8, 60, 4)]
            rows.append((len(rows), "u", make(body)))
            want.append(" ".join(body))
    rows += [(900, "u", None), (901, "u", ""), (902, "u", "<p>"), (0, "again", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = html_blocks.train(df.where(f"page_id < {n} and url <> 'again'"))
    got = {(r["id"], r["url"]): r["text"] for r in html_blocks.main_text(df, model, keep=("url",)).collect()}
    assert sum(got[i, rows[i][1]] == w for i, w in enumerate(want[:n])) >= 55
    for k in range(len(skeletons)):
        assert sum(got[i, "u"] == want[i] for i in range(n + 12 * k, n + 12 * k + 12)) >= 10, k
    assert got[900, "u"] == got[901, "u"] == got[902, "u"] == "" and got[0, "again"] == got[0, "http://h/0"]


def test_a_set_gives_its_fullest_partitions_first():
    of, count = np.array([0, 0, 0, 0, 2, 2]), np.array([1, 3, 2, 3, 1, 1])
    kept = ngram_join._leading(of, count, np.array([4, 0, 2]), np.array([3, 1, 1]))
    assert kept.tolist() == [1, 2, 3, 4]
    assert ngram_join._leading(of[:0], count[:0], np.zeros(3, int), np.ones(3, int)).tolist() == []
