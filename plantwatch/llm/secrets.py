"""Secret scan with DataFrame functions only.

Patterns give the base spans. Besides, each candidate string is scanned by a
sliding window whose Shannon entropy, per character class, is kept up to date
from counts: a character enters, one leaves, and only their two terms change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, group that has the least length or 0, least length). hex and access hold their least length, as no match of a run can be longer later in it.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 0),
    "hex": (r"[0-9a-f]{24,}", 0, 0),
}
#: class -> (candidate pattern, alphabet, window, least entropy in bits, patterns that a candidate must match too)
CLASSES = {
    "hex": (r"[0-9a-fA-F]{24,}", "0123456789abcdefABCDEF", 24, 3.01, ("[0-9]", "[a-fA-F]")),
    "base64": (r"[A-Za-z0-9+/_=-]{24,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20, 3.71, ("[0-9]", "[A-Z]", "[a-z]")),
}
#: Candidates that match are no secrets: placeholders and runs of the alphabet.
ALLOWED = r"(?i)example|sample|placeholder|change_?me|your[_-]|dummy|0123456789|abcdefgh|(.)\1{7}"
KINDS = ("assign", "access", "hex", "entropy")


def _found(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, match) of the matches, leftmost and non-overlapping; positions in code points."""
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    pair = F.arrays_zip(gaps.alias("gap"), whole.alias("match"), value.alias("value"))
    empty = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,match:string,value:string>>) as found)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(one))).alias("found"))

    found = F.aggregate(pair, empty, step)["found"]
    kept = F.filter(found, lambda x: F.length(x["value"]) >= least) if least else found
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,match:string,value:string>>)")
    return F.when(text.rlike(pattern), kept).otherwise(nothing)


def window_entropy(word: Column, alphabet: str, window: int) -> Column:
    """Largest Shannon entropy in bits of any `window` characters in a row; 0 for a shorter word.

    The state is the count of each character and the sum of c * log2(c) over
    them: the entropy of a full window is log2(window) - sum / window.
    """
    term = F.array(*(F.lit(0.0) for _ in range(2)), *(F.log2(F.lit(float(c))) * c for c in range(2, window + 2)))
    place = lambda i: F.instr(F.lit(alphabet), F.substring(word, i, F.lit(1)))
    state = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(acc: Column, i: Column) -> Column:
        enters = place(i)
        leaves = F.when(i > window, place(i - window)).otherwise(F.lit(0))
        c_in = F.element_at(acc["counts"], enters)
        c_out = F.when(leaves > 0, F.element_at(acc["counts"], F.greatest(leaves, F.lit(1))))
        change = F.element_at(term, c_in + 2) - F.element_at(term, c_in + 1)
        change = change + F.coalesce(F.element_at(term, F.greatest(c_out, F.lit(1))) - F.element_at(term, F.greatest(c_out, F.lit(1)) + 1), F.lit(0.0))
        total = acc["sum"] + F.when(enters == leaves, F.lit(0.0)).otherwise(change)
        counts = F.transform(acc["counts"], lambda c, k: c + (k + 1 == enters).cast("int") - (k + 1 == leaves).cast("int"))
        bits = F.log2(F.lit(float(window))) - total / window
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(i >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    return F.when(F.length(word) < window, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.length(word)), state, step)["best"])


def secret_spans(text: Column) -> Column:
    """Array of (start, rank, end, kind) of all spans by start, then kind as in KINDS."""
    parts = []
    for kind, (pattern, group, least) in BASE.items():
        parts.append(_as_spans(_found(text, pattern, group, least), kind))
    parts += [_as_spans(_by_entropy(text, *rule), "entropy") for rule in CLASSES.values()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _by_entropy(text: Column, pattern: str, alphabet: str, window: int, bits: float, needs: tuple[str, ...]) -> Column:
    """Candidates of a class that have its kinds of characters, aren't allowed and reach its entropy."""
    found = F.filter(_found(text, pattern), lambda x: _all(x["match"], needs) & ~x["match"].rlike(ALLOWED))
    return F.filter(found, lambda x: window_entropy(x["match"], alphabet, window) >= bits)


def _all(word: Column, patterns: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for p in patterns:
        ok = ok & word.rlike(p)
    return ok


def _as_spans(found: Column, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), rank.alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """`docs` with one more column, an array of (start, rank, end, kind).

    Positions are code points, the end is exclusive. Kinds assign, access and
    hex come from patterns, entropy from window entropies; entropy spans add to
    the others. A null or empty text has no spans. Every row and every other
    column stays as it is; `into` must be a new name.
    """
    return docs.withColumn(into, secret_spans(F.coalesce(F.col(text), F.lit(""))))


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every span of its texts replaced by `mark`, spans that overlap as one; null texts stay null; columns may have any names."""
    whole = F.col(f"row.`{text}`")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))
        new = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    rows = docs.select(F.struct("*").alias("row"), secret_spans(F.coalesce(F.col(text), F.lit(""))).alias("spans"))
    folded = F.aggregate(F.col("spans"), state, step)
    clean = F.concat(folded["out"], F.substring(whole, folded["at"] + 1, F.length(whole)))
    changed = F.when(F.size("spans") > 0, clean).otherwise(whole)
    return rows.select(*(changed.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def span_digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
