"""Regex spans with code-point offsets, in DataFrame expressions alone.

Spark has no function that returns the positions of all matches. Here a replace
puts a mark on both sides of each match and the text is split at the marks:
every second part is a match, and running sums of the parts' lengths are the
positions. Parts are taken in chunks: an array that grows by one in each step
of a fold is copied in each step, so no fold runs over more than a chunk, and
time grows with the text. The mark is a control character; where a text holds
it, it is read as another control character of the same length, which no
pattern here matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

_MARK, _OTHER = "\x01", "\x02"
#: Matches whose positions one fold sums.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value made once: a lambda's body evaluates what stands
    in it for each element, but its variable is there already."""
    return F.transform(F.array(value), use)[0]


def _sums(numbers: Column, start: Column) -> Column:
    """start, and start with the first 1, 2, ... numbers added."""
    return F.aggregate(numbers, F.array(start), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def spans(text: Column, pattern: str, needs: str | None = None, keep: Callable[[Column], Column] | None = None, around: int = 0) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches,
    in order.

    needs: a literal that every match contains; texts without it are skipped.
    keep: over the match; false drops it.
    around: if above 0, the structs also have before and after: as many signs
    on both sides, out of the three parts there (gap, match, gap).
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _OTHER), F.lit(pattern), F.lit(f"{_MARK}$0{_MARK}"))
    size = lambda p: F.char_length(p)
    part = lambda parts, k: F.coalesce(F.get(parts, k), F.lit(""))

    def match(parts: Column, k: Column, at: Column) -> Column:
        """Match k of a text, whose gap before begins at `at`."""
        own, start = parts[2 * k + 1], at + size(parts[2 * k])
        fields = [start.alias("start"), (start + size(own)).alias("end"), own.alias("match")]
        if around:
            near = lambda *ks: F.concat(*[part(parts, k2) for k2 in ks])
            before, after = near(2 * k - 2, 2 * k - 1, 2 * k), near(2 * k + 2, 2 * k + 3, 2 * k + 4)
            fields += [F.right(before, F.lit(around)).alias("before"), F.left(after, F.lit(around)).alias("after")]
        return F.struct(*fields)

    def chunk(parts: Column, n: Column, c: Column, at: Column) -> Column:
        """The matches c * CHUNK on, CHUNK of them at most."""
        first = c * CHUNK
        own = F.sequence(first, F.least(n, first + CHUNK) - 1)
        ends = F.transform(own, lambda k: size(parts[2 * k]) + size(parts[2 * k + 1]))
        return let(_sums(ends, at), lambda sums: F.transform(own, lambda k: match(parts, k, sums[k - first])))

    def positions(parts: Column) -> Column:
        n = ((F.size(parts) - 1) / 2).cast("int")
        chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
        sums = F.transform(chunks, lambda c: F.aggregate(F.slice(parts, 2 * CHUNK * c + 1, 2 * CHUNK), F.lit(0), lambda a, p: a + size(p)))
        return let(_sums(sums, F.lit(0)), lambda at: F.flatten(F.transform(chunks, lambda c: chunk(parts, n, c, at[c]))))

    fields = "start:int,end:int,match:string" + (",before:string,after:string" if around else "")
    none = F.expr(f"cast(array() as array<struct<{fields}>>)")
    found = let(marked, lambda m: F.when(F.contains(m, F.lit(_MARK)), let(F.split(m, _MARK, -1), positions)).otherwise(none))
    if keep:
        found = F.filter(found, lambda s: keep(s["match"]))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(none) if needs else found


def meets_lower(lower: Column) -> Column:
    """Whether a span, a row with row, start and end, overlaps one of its row
    for which `lower` holds: of those, the furthest end among the ones that
    begin no later, and the nearest begin among the ones that begin no sooner."""
    # A frame to the end of the partition costs its square, so both frames end at the row.
    frame = lambda *order: Window.partitionBy("row").orderBy(*order).rangeBetween(Window.unboundedPreceding, 0)
    sooner = F.max(F.when(lower, F.col("end"))).over(frame("start"))
    later = F.min(F.when(lower, F.col("start"))).over(frame(F.desc("start")))
    return F.coalesce((sooner > F.col("start")) | (later < F.col("end")), F.lit(False))


def digits(p: Column) -> Column:
    return F.regexp_replace(p, "[^0-9]", "")


def luhn(p: Column) -> Column:
    """Whether the digits of p, at most some dozens, pass the Luhn check."""
    d = F.split(F.reverse(digits(p)), "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def tagged(found: Column, rank: int, kind: str, *more: str) -> Column:
    """Spans as array<struct<start, rank, end, kind, match>>, ready to sort."""
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["match"].alias("match"), *[s[c].alias(c) for c in more]))


def joined(sorted_spans: Column) -> Column:
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
