"""Secrets in texts: three patterns, and runs of characters with high entropy.

Only SQL functions do the work. A pattern's places come from the texts between its
matches: their lengths and the lengths of the matches add up to each start.

The entropy scan looks at candidates, runs of at least ``SHORTEST`` letters, digits
and ``+/_=-`` that hold a letter and a digit. For each character class that fits the
whole candidate, a window slides over it: a step adds one character and takes one
away, and the sum of n * log2(n) over the window's counts follows from the counts of
these two. The time of a step depends on the window alone, so a run of any length is
scanned in proportion. A candidate shorter than the window is one window, with a bound
lower in proportion to the largest entropy it can have. The candidate is a secret when
some window reaches the class's bound, unless an entry of the allow list matches it or
one of the patterns already covers part of it.

Spans are counted in code points, the end is exclusive. Defined results: a null text
is an empty one and has no spans. Equal rows have equal results, row by row; null ids
stay null. An empty table gives an empty result. Names of other columns do not matter.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm import arrays

ASSIGN = (
    r"((?i:password|passwd|secret|token|api_?key))"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# The maximal runs that are long enough: the same matches as of any run, then filtered.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
SHORTEST_VALUE = 12

SHORTEST = 16
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Character class, its characters, window length, least entropy of a window in bits.
CLASSES = [
    ("hex", string.hexdigits, 16, 2.85),
    ("base64", string.ascii_letters + string.digits + "+/_=-", 20, 3.65),
]
# Candidates that are no secrets: ids in the common form, words joined by signs,
# placeholders, and names with a number.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[/_=+-]*([A-Za-z]+|[0-9]+)([/_=+-]+([A-Za-z]+|[0-9]+))*[/_=+-]*$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    r"^[A-Za-z]*[0-9]{1,4}[A-Za-z]*$",
]
KINDS = ["assign", "access", "hex", "entropy"]
MARK = "<secret>"

SPAN = "struct<start:int,rank:int,stop:int,kind:string>"
# Matches that are placed one after the other before their spans are joined.
BLOCK = 256


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _placed(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Spans of all matches with the matched text of a group, in order.

    Blocks of matches are placed from their own start and then moved, so the time
    stays in proportion to the matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    rank = KINDS.index(kind)
    found = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"
    state = f"struct<at:int,found:{found}>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(state)

    def span(begin: Column, stop: Column, value: Column) -> Column:
        return F.struct(
            begin.alias("start"),
            F.lit(rank).alias("rank"),
            stop.alias("stop"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
        )

    def step(held: Column, one: Column) -> Column:
        begin = held["at"] + F.length(one["gap"])
        stop = begin + F.length(one["whole"])
        own = F.array(span(begin, stop, one["value"]))
        return F.struct(stop.alias("at"), F.concat(held["found"], own).alias("found")).cast(state)

    def moved(held: Column, block: Column) -> Column:
        at = held["at"]
        own = F.transform(block["found"], lambda s: span(s["start"] + at, s["stop"] + at, s["value"]))
        both = F.concat(held["found"], own)
        return F.struct((at + block["at"]).alias("at"), both.alias("found")).cast(state)

    def placed(matches: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int")),
            lambda b: F.aggregate(F.slice(matches, b * BLOCK + 1, BLOCK), start, step),
        )
        return F.when(F.size(matches) > 0, F.aggregate(blocks, start, moved)["found"])

    def zipped(whole: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
        return F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))

    return F.coalesce(_bound(_bound(whole, zipped), placed), F.array().cast(found))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: s.dropFields("value")).cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, in no order. A text without a match costs one search."""
    assign = F.filter(
        _placed(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= SHORTEST_VALUE
    )
    return F.concat(
        F.when(text.rlike(ASSIGN), _bare(assign)).otherwise(_none()),
        F.when(text.contains("AKIA"), _bare(_placed(text, ACCESS, "access"))).otherwise(_none()),
        F.when(text.rlike(HEX), _bare(_placed(text, HEX, "hex"))).otherwise(_none()),
    )


def window_entropy(run: Column, window: int) -> Column:
    """Largest Shannon entropy in bits of a window of ``run``; a shorter run is one window."""
    mass = [n * math.log2(n) if n else 0.0 for n in range(window + 1)]
    gain = F.array(*[F.lit(b - a) for a, b in zip(mass, mass[1:], strict=False)])
    state = "struct<seen:array<string>,sum:double,least:double>"
    start = F.struct(
        F.array().alias("seen"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least")
    ).cast(state)

    def count(seen: Column, one: Column) -> Column:
        return F.size(F.filter(seen, lambda x: x == one))

    def step(width: Column):
        def walk(held: Column, new: Column) -> Column:
            # Full windows lose their first character before they take the next.
            seen = held["seen"]
            old = F.get(seen, F.lit(0))
            lost = F.when(F.size(seen) == width, F.get(gain, count(seen, old) - 1)).otherwise(0.0)
            kept = F.when(F.size(seen) == width, F.slice(seen, 2, window)).otherwise(seen)

            def taken(kept: Column) -> Column:
                total = held["sum"] - lost + F.get(gain, count(kept, new))

                def closed(total: Column) -> Column:
                    full = F.size(kept) == width - 1
                    least = F.when(full, F.least(held["least"], total)).otherwise(held["least"])
                    return F.struct(
                        F.concat(kept, F.array(new)).alias("seen"), total.alias("sum"), least.alias("least")
                    ).cast(state)

                return _bound(total, closed)

            return _bound(kept, taken)

        return walk

    def entropy(letters: Column) -> Column:
        def least(width: Column) -> Column:
            low = F.aggregate(letters, start, step(width))["least"]
            return F.log2(width) - low / width

        return _bound(F.least(F.size(letters), F.lit(window)), least)

    return _bound(F.split(run, ""), entropy)


def _suspicious(run: Column) -> Column:
    mixed = run.rlike("[0-9]") & run.rlike("[A-Za-z]")
    for pattern in ALLOWED:
        mixed = mixed & ~run.rlike(pattern)
    high = F.lit(False)
    for _, alphabet, window, least in CLASSES:
        outside = F.length(F.translate(run, alphabet, "")) > 0
        share = F.log2(F.least(F.length(run), F.lit(window))) / math.log2(window)
        high = high | (~outside & (window_entropy(run, window) >= least * share))
    return mixed & high


def _without_assigned(text: Column) -> Column:
    """The text with blanks in place of the spans of the first pattern, as long as before."""
    whole = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))

    def joined(gaps: Column) -> Column:
        own = F.zip_with(
            whole, value,
            lambda w, v: F.when(F.length(v) >= SHORTEST_VALUE, F.repeat(F.lit(" "), F.length(w))).otherwise(w),
        )
        # One gap more than matches.
        parts = F.zip_with(gaps, own, lambda gap, one: F.concat(gap, F.coalesce(one, F.lit(""))))
        return F.array_join(parts, "")

    return _bound(F.split(text, ASSIGN, -1), joined)


def entropy_spans(text: Column) -> Column:
    """Candidates with a window of high entropy that overlap no span of the patterns.

    Matches of the second and third pattern lie within a candidate. A candidate that
    overlaps one of the first is another one, or none, where these are blank.
    """
    def apart(text: Column) -> Column:
        runs = _placed(text, CANDIDATE, "entropy")
        return F.filter(runs, lambda s: ~s["value"].rlike(HEX) & ~s["value"].rlike(ACCESS))

    both = F.array_intersect(apart(text), apart(_without_assigned(text)))
    free = F.when(text.rlike(ASSIGN), both).otherwise(apart(text))
    found = _bare(F.filter(free, lambda s: _suspicious(s["value"])))
    return F.when(text.rlike(CANDIDATE), found).otherwise(_none())


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with a column of spans, sorted by start and kind: start, rank, stop, kind."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(
        spans, F.array_sort(F.concat(base_spans(whole), entropy_spans(whole)))
    )


def written(spans: Column) -> Column:
    """Spans as text: kind:start:stop, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by ``MARK``."""
    state = "struct<at:int,parts:array<string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("parts")).cast(state)

    def step(held: Column, s: Column) -> Column:
        before = F.substring(text, held["at"] + 1, s["start"] - held["at"])
        parts = F.concat(held["parts"], F.array(before, F.lit(MARK)))
        return F.struct(
            F.greatest(held["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= held["at"], parts).otherwise(held["parts"]).alias("parts"),
        ).cast(state)

    def finish(held: Column) -> Column:
        rest = F.substring(text, held["at"] + 1, F.length(text))
        return F.array_join(F.concat(held["parts"], F.array(rest)), "")

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def redacted(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """The documents with their secrets replaced, all columns kept.

    ``length`` names a column that holds the text's length and is brought up to date,
    where there is one.
    """
    spans = arrays.fresh("_spans", docs)
    found = scan(docs, text, spans)
    found = found.withColumn(text, masked(F.col(text), F.col(spans)))
    if length in docs.columns:
        now = F.length(text).cast(docs.schema[length].dataType)
        found = found.withColumn(length, F.when(F.size(spans) > 0, now).otherwise(F.col(length)))
    return found.select(docs.columns)
