"""License scan with DataFrame functions only: Dice coefficient over word bigrams.

Units are the whole text and each of its lines. A unit and a template with a
and b distinct bigrams share min(a, b) at most, so only sizes with
2 * min(a, b) / (a + b) >= threshold are compared. A unit needs one word more
than it has bigrams, so short units go before any bigram is made; long ones go
by the number of their distinct bigrams, as words may repeat.

What reaches the threshold with a template has a certain number of its
bigrams, and the whole text has them too. A text that hasn't so many of any
template goes before its lines are looked at.

A notice within a line or over several is found in the spans of bigrams of the
whole text. The best span starts and ends with a bigram of its template and
has as many as the threshold asks for, so only such starts are looked at, each
in one pass over the bigrams after it.
"""

from __future__ import annotations

import re
import zlib
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.licence_texts import TEMPLATES

#: Slots of the table that tells by a bigram's checksum which templates may hold it.
SLOTS = 1 << 15
THRESHOLD = 0.8


def _words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and points between them; marks at their ends dropped."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:\.[\p{N}]+)*)"), F.lit(1))


def _python_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:\.[0-9]+)*", text.lower())


def python_bigrams(text: str) -> list[str]:
    """Sorted distinct word bigrams of a template."""
    w = _python_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _all_bigrams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, F.expr("cast(array() as array<string>)")).otherwise(pairs)


def _bigrams(words: Column) -> Column:
    return F.array_distinct(_all_bigrams(words))


def _sizes(n: int, threshold: float) -> tuple[int, int]:
    """Least number of shared bigrams, and most bigrams, of what reaches the threshold with a template of n."""
    return max(1, ceil(threshold * n / (2 - threshold) - 1e-9)), floor((2 - threshold) * n / threshold + 1e-9)  # bounds that are whole numbers count


def _marks(pairs: Column, grams: dict[str, list[str]]) -> Column:
    """Of each bigram the bits of the templates that may hold it, by its checksum."""
    table = [0] * SLOTS
    for k, name in enumerate(sorted(grams)):
        for g in grams[name]:
            table[zlib.crc32(g.encode()) % SLOTS] |= 1 << k
    bits = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # one constant of the plan
    return F.transform(pairs, lambda x: F.element_at(bits, (F.crc32(x.cast("binary")) % SLOTS + 1).cast("int")))


def _enough(marks: Column, grams: dict[str, list[str]], threshold: float) -> Column:
    """Whether some template may have as many of its bigrams among those marked as the threshold asks for."""
    some = F.lit(False)
    for k, name in enumerate(sorted(grams)):
        bit = F.lit(1 << k)
        own = F.size(F.filter(marks, lambda b: b.bitwiseAND(bit) != 0))  # noqa: B023
        some = some | (own >= _sizes(len(grams[name]), threshold)[0])
    return some


def _before(pairs: Column) -> Column:
    """Of each bigram the place, from 1, where it stood last before; 0 for its first place."""
    placed = F.array_sort(F.transform(pairs, lambda x, i: F.struct(x.alias("pair"), (i + 1).alias("at"))))
    back = F.transform(F.array(placed), lambda all_: F.transform(all_, lambda x, i: F.struct(x["at"].alias("at"), F.when(F.get(all_, i - 1)["pair"] == x["pair"], F.get(all_, i - 1)["at"]).otherwise(F.lit(0)).alias("before"))))
    return F.transform(F.array_sort(F.flatten(back)), lambda x: x["before"])


def _span(pairs: Column, places: Column, bit: int, name: str, gram: list[str], threshold: float) -> Column:
    """The best span of `pairs` for a template that reaches the threshold, or null; of equal ones the last.

    From each start one pass counts the distinct bigrams and those of the
    template: a bigram is new to the span if it stood last before the start. So
    a start costs the longest span that may reach the threshold, whatever repeats.
    """
    least, most = _sizes(len(gram), threshold)
    own = F.array(*map(F.lit, gram))
    flags = F.transform(places, lambda x, i: F.struct(x["before"].alias("before"), ((x["bits"].bitwiseAND(F.lit(1 << bit)) != 0) & F.array_contains(own, F.get(pairs, i))).alias("own")))

    def spans(flags: Column) -> Column:
        at = F.filter(F.transform(flags, lambda x, i: F.when(x["own"], i + 1)), lambda p: p.isNotNull())
        return F.flatten(F.transform(F.array(at), lambda at: F.transform(F.filter(at, lambda p, k: F.get(at, k + (least - 1)) - p < most), lambda p: best(flags, p))))

    def best(flags: Column, p: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            new = (x["before"] < p).cast("int")
            shared = acc["shared"] + F.when(x["own"], new).otherwise(0)
            total = acc["total"] + new
            return F.struct(total.alias("total"), shared.alias("shared"), F.when(x["own"], F.greatest(acc["dice"], 2.0 * shared / (total + len(gram)))).otherwise(acc["dice"]).alias("dice"))

        start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"))
        d = F.aggregate(F.slice(flags, p, F.lit(most)), start, step, lambda acc: acc["dice"])
        return F.transform(F.array(d), lambda d: _hit(d, len(gram), name, (-p).cast("int")))

    each = F.flatten(F.flatten(F.transform(F.array(flags), spans)))
    return F.array_min(F.filter(each, lambda s: s["dice"] >= threshold))


def _hit(dice: Column, n: int, name: str, unit: Column) -> Column:
    """Sorts by Dice coefficient, the larger template, its name, the unit."""
    return F.struct((-dice).alias("less"), F.lit(-n).alias("fewer"), F.lit(name).alias("license"), unit.alias("unit"), dice.alias("dice"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, dice, unit, n_matches): one row for each row of `docs`.

    license is the template with the largest Dice coefficient among all units
    that reach the threshold, null without one; ties go to the template with
    more bigrams, then to the smaller name and unit. unit is the line number from 1, or 0 for the
    whole text; n_matches counts units and templates that reach the threshold.
    Of a template that neither the text nor a line matches, the best span of
    the text counts, with up to as many bigrams as the threshold leaves; its
    unit is -p, p the number from 1 of its first word. A text's cost grows with
    its bigrams of templates times the longest span of a template.
    Null and empty texts match nothing; rows that repeat an id give rows of
    their own; an empty table gives no rows. Templates need two words; there
    are 63 at most, as each is a literal of the plan.
    """
    templates = TEMPLATES if templates is None else templates
    if len(templates) > 63:
        raise ValueError("at most 63 templates")
    grams = {name: python_bigrams(t) for name, t in templates.items()}
    low = min(_sizes(len(g), threshold)[0] for g in grams.values())
    high = max(_sizes(len(g), threshold)[1] for g in grams.values())
    nothing = F.expr("cast(array() as array<string>)")
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("value"))
    rows = rows.select("id", "value", _words(F.col("value")).alias("words"))
    rows = rows.select("id", "value", "words", _all_bigrams(F.col("words")).alias("pairs"))
    rows = rows.select("id", "value", "words", "pairs", _marks(F.col("pairs"), grams).alias("bits"))
    rows = rows.select("id", "value", "words", "pairs", "bits", F.filter("bits", lambda b: b != 0).alias("some"))
    rows = rows.select("id", "value", "words", "pairs", "bits", _enough(F.col("some"), grams, threshold).alias("near"))
    places = F.zip_with("bits", _before(F.col("pairs")), lambda b, p: F.struct(b.alias("bits"), p.alias("before")))
    rows = rows.select("id", "value", "words", "pairs", "near", F.when(F.col("near"), places).alias("marks"))
    lines = F.transform(F.split("value", "\n", -1), lambda u, k: F.struct((k + 1).alias("unit"), F.when(F.length(u) < 2 * low + 1, nothing).otherwise(_words(u)).alias("words")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("unit"), F.col("words").alias("words"))), lines)
    no_units = F.expr("cast(array() as array<struct<unit:int,words:array<string>>>)")
    rows = rows.select("id", "near", "pairs", "marks", F.when(F.col("near"), F.filter(units, lambda x: F.size(x["words"]) > low)).otherwise(no_units).alias("units"))
    bigrams = F.transform("units", lambda x: F.struct(x["unit"].alias("unit"), _bigrams(x["words"]).alias("grams")))
    rows = rows.select("id", "near", "pairs", "marks", F.filter(bigrams, lambda x: F.size(x["grams"]).between(low, high)).alias("units"))
    per_unit = F.transform("units", lambda u: F.filter(F.array(*(_hit(d, len(grams[n]), n, u["unit"]) for n, d in _dice(u["grams"], grams, threshold))), lambda s: s["dice"] >= threshold))
    hits = rows.select("id", "near", "pairs", "marks", F.flatten(per_unit).alias("hits"))
    hits = hits.select("id", "near", "pairs", "marks", "hits", F.transform("hits", lambda s: s["license"]).alias("known"))
    spans = [F.when(F.col("near") & ~F.array_contains("known", n), _span(F.col("pairs"), F.col("marks"), k, n, grams[n], threshold)) for k, n in enumerate(sorted(grams))]
    hits = hits.select("id", F.array_sort(F.concat("hits", F.filter(F.array(*spans), lambda s: s.isNotNull()))).alias("hits"))
    top = F.get("hits", F.lit(0))
    return hits.select("id", top["license"].alias("license"), top["dice"].alias("dice"), top["unit"].alias("unit"), F.size("hits").cast("long").alias("n_matches"))


def _dice(units: Column, grams: dict[str, list[str]], threshold: float) -> list[tuple[str, Column]]:
    out = []
    a = F.size(units)
    for name in sorted(grams):
        b = len(grams[name])
        fits = 2.0 * F.least(a, F.lit(b)) / (a + b) >= threshold
        shared = F.size(F.array_intersect(units, F.array(*map(F.lit, grams[name]))))
        out.append((name, F.when(fits, 2.0 * shared / (a + b)).otherwise(F.lit(0.0))))
    return out
