"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantwatch.llm import byte_bpe, html_blocks, quality_cascade, toxicity
from plantwatch.llm.exact_dedup import exact_dedup
from plantwatch.llm.licenses import license_scan
from plantwatch.llm.line_dedup import line_dedup
from plantwatch.llm.nearest import nearest
from plantwatch.llm.ngram_join import near_duplicates
from plantwatch.llm.packing import pack
from plantwatch.llm.periodic_runs import periodic_runs
from plantwatch.llm.secrets import scan_secrets, span_digest
from plantwatch.llm.tables import read_table
from plantwatch.llm.token_alignment import align

#: Folder of the public vocabulary files on every machine; None: that of the installed package.
VOCABULARIES: str | None = None


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    if VOCABULARIES is not None:
        return f"{VOCABULARIES}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    found = html_blocks.main_text(pages, html_blocks.train(pages), keep=("url",))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(read_table(spark, sf_dir, "documents"), ranks, offsets=False)
    both = byte_bpe.decode(tokens, ranks)
    return both.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = exact_dedup(read_table(spark, sf_dir, "documents"))
    return verdict.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = near_duplicates(read_table(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return verdict.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", F.round("dice", 6).alias("dice"), F.col("unit").cast("long").alias("unit"), "n_matches")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


def op7_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, keep="none")
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"), into="s").select("doc_id", "s")
    base = F.filter("s", lambda x: x["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("s")).alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2).withColumnRenamed("id", "doc_id")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = quality_cascade.cascade(read_table(spark, sf_dir, "documents"), report=base)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(F.col("id").alias("doc_id"), *base, failed.alias("base_failed"), "kept")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def looped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of `docs`; where crc32 of the id is a multiple of ten, words from one on repeat a stretch of the text's own.

    With g that tenth and n words, a = g % n and p = 1 + (n - a) // (3 + g % 8),
    word i from a on becomes word a + (i - a) % p. Such a text is its words joined
    by one space; those without words stay.
    """
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != ""))
    rows = rows.withColumn("w", words).withColumn("n", F.size("w").cast("long")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))"), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(read_table(spark, sf_dir, "documents")), least=12)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.withColumn("r", longest)
    said = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"), F.expr("1000 * r.length div -r.period").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _license_sql() -> str:
    from plantwatch.llm.licenses import TEMPLATES, THRESHOLD, python_bigrams

    rows = ", ".join(f"('{name}', {python_bigrams(t)!r})" for name, t in TEMPLATES.items())
    return f"""
        with t(license, b) as (values {rows}),
        u as (select doc_id, coalesce(text, '') as x, 0 as unit from documents
            union all select doc_id, unnest(string_split(coalesce(text, ''), chr(10))), generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) from documents),
        w as (select doc_id, unit, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+(?:\\.[\\p{{N}}]+)*') as w from u),
        g as (select doc_id, unit, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as a from w where len(w) > 1),
        s as (select doc_id, unit, license, len(b) as size, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) as dice from g, t where 2.0 * least(len(a), len(b)) / (len(a) + len(b)) >= {THRESHOLD}),
        h as (select *, row_number() over (partition by doc_id order by dice desc, size desc, license, unit) as k, count(*) over (partition by doc_id) as n from s where dice >= {THRESHOLD})
        select d.doc_id, license, round(dice, 6) as dice, cast(unit as bigint) as unit, coalesce(n, 0) as n_matches from documents d left join h on h.doc_id = d.doc_id and k = 1
    """


QUERIES = {f.__name__: f for f in (op1_html_main_text, op2_byte_bpe, op3_exact_dedup, op4_ngram_join, op5_license_scan, op6_toxicity, op7_nearest_vectors, op8_line_dedup, op9_secret_scan, op10_packing, op11_quality_rules, op12_token_alignment, op13_periodic_runs)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op3_exact_dedup": f"""
        with t as (select doc_id, sha256({_LOWER}) as text_sha256 from documents),
        g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by all)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
    """,
    "op4_ngram_join": f"""
        with recursive w as (
            select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents
        ), s as (
            select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
                else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as sh from w
        ), e as materialized (select doc_id, len(sh) as n, unnest(sh) as x from s),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id <> b.doc_id
              and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
        l as materialized (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where 100 * c >= 85 * (len(x.sh) + len(y.sh) - c)),
        r as (select doc_id as node, doc_id as seen from documents union select l.b, r.seen from r join l on l.a = r.node)
        select s.doc_id, cast(len(sh) as bigint) as n_shingles, m.component_id
        from s join (select node, min(seen) as component_id from r group by node) m on m.node = s.doc_id
    """,
    "op8_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
        k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        f as (select key from k where key <> '' group by key having count(distinct doc_id) >= 10)
        select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where f.key is null), '')) as kept_sha256
        from k left join f using (key) group by doc_id
    """,
    "op9_secret_scan": r"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        p(kind, rank, whole, value, least) as (values
            ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
            ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24),
            ('c_hex', 3, '[0-9a-fA-F]{24,}', 0, 24), ('c_base64', 3, '[A-Za-z0-9+/_=-]{24,}', 0, 24)),
        a as (select doc_id, kind, rank, least, regexp_extract_all(t, whole) as m, case when value = 1 then regexp_extract_all(t, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) else regexp_extract_all(t, whole) end as v, string_split_regex(t, whole) as g from d, p),
        e as (select doc_id, kind, rank, least, unnest(m) as m, unnest(v) as v, unnest(g[1:len(m)]) as g, generate_subscripts(m, 1) as i from a where len(m) > 0),
        s as (select doc_id, kind, rank, m, length(v) >= least as ok, cast(sum(length(g) + length(m)) over (partition by doc_id, kind order by i) as bigint) as b from e),
        w as (select *, b - length(m) as a, string_split(m, '') as c from s where ok),
        n as (select doc_id, kind, rank, a, b, kind like 'c%' as cand, case kind
                when 'c_hex' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-fA-F]') and list_max(list_transform(range(1, len(c) - 22), lambda i: list_entropy(c[i:i + 23]))) >= 3.01
                when 'c_base64' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]') and list_max(list_transform(range(1, len(c) - 18), lambda i: list_entropy(c[i:i + 19]))) >= 3.71
                else true end and (kind not like 'c%' or not (regexp_matches(m, '(?i)example|sample|placeholder|change_?me|your[_-]|dummy|0123456789|abcdefgh')
                or len(list_filter(range(1, len(c) - 6), lambda i: len(list_distinct(list_transform(c[i:i + 7], lambda x: lower(x)))) = 1)) > 0)) as ok from w),
        r as (select distinct doc_id, case when cand then 'entropy' else kind end as kind, rank, a, b from n where ok)
        select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
            sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, rank, b) filter (where kind <> 'entropy'), '')) as base_sha256,
            coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, rank, b) filter (where kind is not null), '') as spans
        from d left join r using (doc_id) group by doc_id
    """,
    "op5_license_scan": _license_sql(),
    "op11_quality_rules": r"""
        with d as (select doc_id, coalesce(text, '') as t from documents),
        w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
        g as (select doc_id, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as g from w where len(w) > 4),
        r as (select doc_id, count(distinct k) as n from (select doc_id, unnest(range(i, i + 5)) as k from (select doc_id, i, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by doc_id),
        s as (select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
              cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words,
              len(l) as n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_letter_words
              from w left join r using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
            not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 15 * n_words
                 or 2 * n_letter_words < n_words or 2 * n_capitals > word_chars) as kept from s
    """,
}
