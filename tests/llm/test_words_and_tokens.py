"""Periodic runs, the rule cascade and token alignment against brute force, and on odd rows."""

import hashlib
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plantwatch.llm import html_blocks, nearest, periodic_runs, quality_cascade, token_alignment
from plantwatch.llm.queries import looped
from tests.llm.test_llm import CASES, WORDS, corpus, documents, no_rows, text


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def split(t):
    return [w.decode() for w in (t or "").encode().split()]


# --- periodic runs ---------------------------------------------------------------------------------


def brute_runs(w, least):
    """(start, length, period) of the maximal stretches of each period, without those of a smaller one."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q) and all(any(w[k] != w[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_brute_force(spark):
    rng = np.random.default_rng(41)
    texts = []
    for _ in range(400):
        n, k = int(rng.integers(0, 70)), int(rng.integers(1, 4))
        w = [str(x) for x in rng.integers(0, k, n)]
        if n and rng.random() < 0.5:
            a, p = int(rng.integers(0, n)), int(rng.integers(1, n + 1))
            w = [w[i] if i < a else w[a + (i - a) % min(p, n - a)] for i in range(n)]
        texts.append(" ".join(w))
    texts += ["a " * 11, "a " * 12, "x y " * 6 + "z", "p q r " * 4, " \t\n", "A a " * 9, "é é " * 13, "\x0ba\x0cb" * 8, None, ""]
    for least in (4, 5, 12, 13):
        got = {r["id"]: r for r in periodic_runs.periodic_runs(corpus(spark, texts), least=least).collect()}
        for i, t in enumerate(texts):
            w, runs = split(t), brute_runs(split(t), least)
            assert [tuple(r) for r in got[i]["runs"]] == runs, (least, t)
            gone = {k for s, n, q in runs for k in range(s + q, s + n)}
            assert got[i]["collapsed"] == " ".join(x for k, x in enumerate(w) if k not in gone) and got[i]["n_words"] == len(w)


def test_runs_of_long_texts_in_order_n_log_n():
    fib = ["a", "ab"]
    while len(fib[-1]) < 60_000:
        fib.append(fib[-1] + fib[-2])
    ids, _, _ = periodic_runs.word_ids([" ".join(fib[-1]).encode()])
    start, end, period = periodic_runs.find_runs(ids)
    assert len(start) > 5000 and set(period.tolist()) <= {1, *map(len, fib)}
    some = np.random.default_rng(1).choice(len(start), 300)
    for s, e, q in zip(start[some], end[some], period[some], strict=True):
        assert (ids[s : e - q] == ids[s + q : e]).all() and (s == 0 or ids[s - 1] != ids[s - 1 + q]) and (e == len(ids) or ids[e] != ids[e - q])
    ids, _, _ = periodic_runs.word_ids([b"a b c d e " * 40_000, b"a b c d e f " * 10])
    assert [x.tolist() for x in periodic_runs.find_runs(ids)] == [[0, 200_000], [200_000, 200_060], [5, 6]]


def test_runs_of_repeated_rows_and_nothing(spark):
    rows = corpus(spark, ["a b " * 9, "c"]).union(corpus(spark, ["a b " * 9]))
    got = sorted((r["id"], len(r["runs"])) for r in periodic_runs.periodic_runs(rows).collect())
    assert got == [(0, 1), (0, 1), (1, 0)] and periodic_runs.periodic_runs(no_rows(spark)).count() == 0
    with pytest.raises(ValueError, match="least"):
        periodic_runs.periodic_runs(rows, least=3)


def test_loops_of_one_text_in_ten(spark):
    rng = np.random.default_rng(42)
    texts = [" \n".join(f"w{k}" for k in range(int(rng.integers(0, 60)))) for _ in range(120)] + [None, "", " \t "] * 12
    got = {r["doc_id"]: r["text"] for r in looped(corpus(spark, texts)).collect()}
    hits = 0
    for i, t in enumerate(texts):
        h, w = zlib.crc32(str(i).encode()), split(t)
        g, n = h // 10, len(w)
        if h % 10 or not n:
            assert got[i] == t
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        hits += 1
        assert got[i] == " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))
    assert hits > 5


# --- quality rules ---------------------------------------------------------------------------------


def brute_statistics(t):
    t, w = t or "", split(t)
    lines = [x for x in t.split("\n") if split(x)]
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    held = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    letters = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_capitals": sum("A" <= c <= "Z" for c in t), "n_letter_words": letters, "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(held)}


def rule_texts():
    rng = np.random.default_rng(43)
    texts = [text(rng, 40), "a b c d e " * 4, "x | y | z | " * 9, "A B C " * 20, "one line here\n" * 9, "1 2 3 4 5 6 7 8 9 10 11 a", " ".join("q" * 40 + str(k) for k in range(12)), *CASES, None, "", " \n\x0b\n"]
    texts += [" ".join(rng.choice(["a", "b", "c|", "É", "\n", "\nx y\n"], int(rng.integers(0, 50)))) for _ in range(150)]
    return texts


def test_cascade_is_all_rules_in_any_order(spark):
    texts = rule_texts()
    names = tuple(quality_cascade.STATISTICS)
    rules = quality_cascade.RULES
    for order in (rules, rules[::-1], None):
        got = {r["id"]: r for r in quality_cascade.cascade(corpus(spark, texts), order, report=names if order else ()).collect()}
        for i, t in enumerate(texts):
            want = brute_statistics(t)
            failed = [r.name for r in (order or rules) if r.fails(*(np.array([want[n]]) for n in r.needs))[0]]
            assert got[i]["kept"] == (not failed)
            if order:
                assert {n: got[i][n] for n in names} == want
                at = [r.name for r in order]
                assert got[i]["rejected_by"] == (failed[0] if failed else None) and got[i]["n_looked"] == (at.index(failed[0]) + 1 if failed else len(at))
            else:
                assert got[i]["rejected_by"] in (failed or [None])
    assert {r.name for r in rules} <= {f for t in texts for f in [r.name for r in rules if r.fails(*(np.array([brute_statistics(t)[n]]) for n in r.needs))[0]]}


def test_rules_after_a_rejection_see_nothing_of_the_text():
    seen = []
    first = quality_cascade.Rule("short", ("n_words",), lambda n: n < 3)
    spy = quality_cascade.Rule("spy", ("n_lines",), lambda n: [seen.append(len(n)), n < 0][1])
    by, looked, _ = quality_cascade._judge([b"a", b"a b c", b"a b c d"], (first, spy), ())
    assert seen == [2] and by.tolist() == [0, -1, -1] and looked.tolist() == [1, 2, 2]


def test_order_is_by_rejection_per_cost(spark):
    rules = quality_cascade.RULES
    place = {r.name: k for k, r in enumerate(rules)}
    bit = lambda *names: sum(1 << place[n] for n in names)
    seconds = dict.fromkeys(quality_cascade.STATISTICS, 1.0) | {"n_repeat_words": 50.0}
    seen = quality_cascade.Profile(seconds, {0: 60, bit("repeated_windows"): 20, bit("symbols", "letterless_words"): 15, bit("letterless_words"): 1, bit("capitals"): 4})
    order = [r.name for r in quality_cascade.ordered(seen)]
    assert order[0] == "letterless_words" and order.index("capitals") < order.index("repeated_windows") < order.index("symbols")
    assert quality_cascade.ordered(seen, given=("n_repeat_words", "n_words"))[0].name == "repeated_windows"
    found = quality_cascade.profile(corpus(spark, rule_texts()), rows=10**6)
    assert sum(found.rows.values()) == len(rule_texts()) and set(found.seconds) == set(quality_cascade.STATISTICS)


def test_cascade_of_repeated_rows_nothing_and_equal_hashes(spark, monkeypatch):
    rows = corpus(spark, [text(np.random.default_rng(2), 30), "c"])
    got = sorted((r["id"], r["kept"]) for r in quality_cascade.cascade(rows.union(rows)).collect())
    assert got == [(0, True), (0, True), (1, False), (1, False)] and quality_cascade.cascade(no_rows(spark)).count() == 0
    ids = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9, 9])
    want = quality_cascade.repeated_windows(ids, 5).tolist()
    monkeypatch.setattr(quality_cascade, "mix64", lambda x: x * np.uint64(0))  # all windows have one hash
    assert quality_cascade.repeated_windows(ids, 5).tolist() == want and sum(want) == 2


# --- token alignment -------------------------------------------------------------------------------


def brute_alignment(texts):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    place = token_alignment._byte_of()
    rows, pairs = [], Counter()
    for t in texts:
        row = {"a": [], "b": [], "groups": [], "links": []}
        rows.append(row)
        if not t:
            continue
        a, b = plain.encode(" " + t, add_special_tokens=False).ids, model.encode(t)
        a_bytes = [bytes(place[c] for c in plain.id_to_token(i)) for i in a]
        pieces = [model.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for p in pieces]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
            continue
        ends = [np.cumsum([len(x) for x in side]) for side in (a_bytes, b_bytes)]
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        row["a"], row["b"], i, j = a, b, 0, 0
        for e in both:
            x, y = int(np.searchsorted(ends[0], e)) + 1, int(np.searchsorted(ends[1], e)) + 1
            row["groups"].append((a[i:x], b[j:y]))
            i, j = x, y
        starts = [e - [len(x) for x in side] for e, side in zip(ends, (a_bytes, b_bytes), strict=True)]
        j = 0
        for i in range(len(a)):
            while ends[1][j] <= starts[0][i]:
                j += 1
            k = j
            while k < len(b) and starts[1][k] < ends[0][i]:
                row["links"].append((a[i], b[k]))
                k += 1
        pairs.update(row["links"])
    top = Counter()
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    out = []
    for row in rows:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in row["groups"])
        out.append((len(row["a"]), len(row["b"]), len(row["groups"]), len(row["links"]), sum(pairs[p] == top[p[1]] for p in row["links"]), sum(pairs[p] for p in row["links"]), sha(said) if row["a"] else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_texts():
    rng = np.random.default_rng(44)
    texts = [*CASES, None, "", " ", "  a  b", "a\n b\t c \n\n d", "<s> </s> <|endoftext|> <0x41>", "▁ x", "a▁b c", "naïve café x", "日本語 \U0001f600 ok", "it's we'll  'tis 's", "a  b  c", "\x00 \x01", "é ́x", " lead", "trail ", "x" * 900]
    alphabet = [*"ab'sl1. \n\t", "é", "ß", "the ", " of", "  ", "日", " ", "!"]
    return texts + [text(rng, 50) for _ in range(15)] + ["".join(rng.choice(alphabet, int(rng.integers(1, 80)))) for _ in range(250)]


@pytest.mark.parametrize(("most", "size"), [(1_000_000, 8 << 20), (40, 3000), (0, 1 << 20)])
def test_alignment_is_that_of_brute_force(spark, most, size):
    """All pairs frequent, some, none; one slice and many."""
    P = pytest.importorskip("public_tokenizers")
    texts = token_texts()
    df = corpus(spark, texts).repartition(3)
    got = {r["id"]: tuple(r[k] for k in NAMES) for r in token_alignment.align(df, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), broadcast_pairs=most, slice_bytes=size).collect()}
    want = brute_alignment(texts)
    for i, t in enumerate(texts):
        assert got[i] == want[i], repr(t)
    assert sum(not w[0] for w in want) >= 4 and any(w[2] < w[3] for w in want)


def test_alignment_of_repeated_rows_and_nothing(spark):
    P = pytest.importorskip("public_tokenizers")
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    rows = corpus(spark, ["unbelievable things", "unbelievable things"]).union(corpus(spark, ["unbelievable things"]))
    got = token_alignment.align(rows, *paths).collect()
    want = brute_alignment(["unbelievable things"] * 3)[0]
    assert len(got) == 3 and all(tuple(r[k] for k in NAMES) == want for r in got)
    assert token_alignment.align(no_rows(spark), *paths).count() == 0
    assert token_alignment.align(corpus(spark, [None, ""]), *paths).agg(F.sum("n_links")).first()[0] == 0


def test_what_is_kept_between_passes_is_bounded_rows(spark, monkeypatch):
    """A row is a text, and a row group ends at a number of bytes, so that no task holds its whole share of the input; rows were slices before."""
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_alignment, "GROUP_BYTES", 1 << 16, raising=False)
    kept, stored = [], token_alignment.stored
    monkeypatch.setattr(token_alignment, "stored", lambda *a: kept.append(stored(*a)) or kept[-1])
    rng = np.random.default_rng(46)
    texts = ["".join(rng.choice([*"abcdefgh "], 900)) for _ in range(300)]
    got = {r["id"]: tuple(r[k] for k in NAMES) for r in token_alignment.align(corpus(spark, texts).coalesce(1), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), broadcast_pairs=100).collect()}
    assert list(got[i] for i in range(300)) == brute_alignment(texts)
    path = Path(kept[0][1].removeprefix("file:"))
    groups = [(g.num_rows, g.total_byte_size) for f in path.glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(rows for rows, _ in groups) == 300 and len(groups) > 4 and max(size for _, size in groups) < 1 << 18


def test_texts_pairs_and_their_look_up():
    """Pairs of each text from its chunks, repeated ones too, and sums by parts of a batch, against plain counting."""
    P = pytest.importorskip("public_tokenizers")
    encoders = token_alignment.encoders(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = [None, "unbelievable things unbelievable things", "", "things", "\u2581 x", "a b a b a", "unbelievable"] * 3
    got = token_alignment._align_slice(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), *encoders)
    pairs, times, ends = token_alignment._text_pairs(got)
    assert np.add.reduceat(np.append(times, 0), np.append(0, ends[:-1]))[ends > np.append(0, ends[:-1])].tolist() == [int(n) for n in got["n_links"] if n]
    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *lists], ["k", "pairs", "times"]).slice(1)
    parts = list(token_alignment._parts([batch, batch.slice(0, 0)], 3))
    assert len(parts) > 3 and [k for part, _ in parts for k in part.column("k").to_pylist()] == list(range(1, len(texts)))
    assert all(part.column("pairs").flatten().to_pylist() == pairs[np.append(0, ends)[k] : ends[k + len(sizes) - 1]].tolist() and sizes.sum() == len(part.column("pairs").flatten()) for part, sizes in parts for k in [part.column("k")[0].as_py()])
    assert token_alignment._text_pairs(token_alignment._align_slice(pa.RecordBatch.from_pydict({"text": pa.array([None, ""], pa.string())}), *encoders))[2].tolist() == [0, 0]


def test_a_whole_text_decides_where_a_chunk_differs():
    """Chunks of a text that holds U+2581 differ; of the other texts in the slice nothing is lost."""
    P = pytest.importorskip("public_tokenizers")
    a, b = token_alignment.encoders(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    batch = pa.RecordBatch.from_pydict({"text": ["one two ▁ three", "one two three", "▁"]})
    got = token_alignment._align_slice(batch, a, b)
    assert [int(x) for x in got["n_a"]] == [0, 3, 0] and got["groups_sha256"][0] == "" and len(got["link_ends"]) == 3


def test_long_texts_of_one_character():
    P = pytest.importorskip("public_tokenizers")
    a, b = token_alignment.encoders(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = [" " * 300_000, "x" + "\n" * 200_000 + "y", "a" * 100_000, "word " * 40_000]
    got = token_alignment._align_slice(pa.RecordBatch.from_pydict({"text": texts}), a, b)
    assert all(int(n) > 0 for n in got["n_a"]) and int(got["n_a"][3]) == 40_001 and len(got["link_ends"]) == 5


# --- markup ----------------------------------------------------------------------------------------


def test_raw_elements_and_stray_end_tags_cost_linear_time():
    def took(n):
        best = 9.0
        for shape in ("<svg>" * n + "</x>" * n, "<svg>" * n + "<li>" * n, "<svg>" * n + "</svg>" * n):
            at = time.process_time()
            html_blocks.blocks("<p>before</p>" + shape)
            best = max(best if best < 9.0 else 0.0, time.process_time() - at)
        return best

    took(500)
    assert took(16_000) < 25 * max(took(2000), 0.01)
    assert [t for _, t, _ in html_blocks.blocks("<ul><li>a<svg><li>x</svg>b<li>c</ul></x>d")] == ["a", "b", "c", "d"]


# --- vectors of odd sizes --------------------------------------------------------------------------


def test_scores_of_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(45)
    x = rng.normal(size=(30, 4))
    scale = np.array([1e-200, 1e200, 1.0])[np.arange(30) % 3]
    rows = spark.createDataFrame([(i, (x[i] * scale[i]).tolist()) for i in range(30)], "vec_id long, embedding array<double>")
    vector = "embedding"
    got = nearest.nearest(rows, rows.where("vec_id % 10 = 0"), k=5, factor=1.0, vector=vector).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for r in got:
        assert r["score"] == pytest.approx(float(unit[r["query_id"]] @ unit[r["vec_id"]]), abs=1e-12)
    assert len(got) == 15 and WORDS and documents
