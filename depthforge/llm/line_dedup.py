"""Removal of repeated runs of lines, in DataFrame operations only.

Texts are cut into units: lines, and the sentences of a line. A unit of a third of ``LEAST_WORDS``
is a chunk of its own. Between such units, a rolling hash over the hashes of two units chooses
boundaries: the places where it is the least of three in a row, which depend on four units alone, so
they are the same wherever the units stand. The chunk at a boundary is its two units. So every run of
``LEAST_WORDS`` words or more holds a chunk that the run alone decides: it holds a long unit, or it
has four units or more, none of them long, and three rolling hashes in a row.

Chunks that occur more than once in the whole table are found by their hashes; texts that are equal as a
whole are found by their SHA-256 first and count as one. Any four units in a row of a repeated run hold
a repeated chunk, as does a run of fewer, so all its units are within ``NEAR`` of one. In the stretches of units near
repeated chunks, and only there, the runs are taken that have ``LEAST_WORDS`` words and would not have them without their
first or without their last unit. Runs are compared by the SHA-256 of their bytes, and the units
of all but the first place of each run are removed: together these runs are the whole repeated passage.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words of the shortest runs that are removed; 12 characters count as a word at least, for scripts without blanks.
LEAST_WORDS = 50
#: A sentence or line ends after each of these, so the units of a text put together are the text.
UNIT_ENDS = ("\n", ". ", "! ", "? ", "\u3002", "\uff01", "\uff1f")
#: Set after unit ends to split there; a text that holds it is split by a slower pattern.
MARK = "\x01"
#: Units of a text whose runs are taken together; bounds the memory of a row, whatever the text's length.
PIECE = 128
#: Each unit of a repeated run is this near to the first unit of a repeated chunk.
NEAR = 3
#: Units whose words are summed at once.
BLOCK = 16
_LEAST = -1 << 63


def with_text(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``row``, with ``clean`` as text and n_chars in line where ``changed``."""
    out = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        if c == "text":
            out.append(F.col("clean").alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("changed"), F.length("clean").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return joined.select(*out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def replaced(text: Column, ends: dict[str, str]) -> Column:
    """``text`` with each of ``ends`` replaced, those that it holds."""
    one = lambda t, end: let(t, lambda x: F.when(F.contains(x, F.lit(end)), F.replace(x, F.lit(end), F.lit(ends[end]))).otherwise(x))
    return reduce(one, ends, text)


def split_units(text: Column) -> Column:
    """Units of a text with what ends them."""
    marked = replaced(text, {end: end + MARK for end in UNIT_ENDS})
    slow = F.split(text, "|".join(f"(?<={re.escape(end)})" for end in UNIT_ENDS))
    # no text ends with a separator and an empty unit
    return F.when(F.contains(text, F.lit(MARK)), F.filter(slow, lambda u: u != "")).otherwise(F.split(F.rtrim(marked, F.lit(MARK)), MARK))


def bare_units(text: Column) -> Column:
    """The same units without their ends and without blanks around them."""
    lines = replaced(text, {end: end.rstrip(" ") + "\n" for end in UNIT_ENDS if end != "\n"})
    whole = lambda us: F.when((F.element_at(us, -1) == "") & (F.size(us) > 1), F.slice(us, F.lit(1), F.size(us) - 1)).otherwise(us)
    units = lambda t: let(F.split(t, "\n"), whole)
    # F.trim itself would be given the place of a unit as the characters to trim
    blank = lambda t: t.startswith(" ") | t.endswith(" ") | F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\n "))  # noqa: E731  at a unit's end
    return let(lines, lambda t: F.when(blank(t), F.transform(units(t), lambda u: F.trim(u))).otherwise(units(t)))


def words(unit: Column) -> Column:
    """Words of a trimmed unit, 1 at least."""
    blanks = F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit("")))
    return F.greatest(blanks + 1, (F.length(unit) / 12).cast("int"))


def is_long(unit: Column, least_words: int) -> Column:
    """Whether a trimmed unit has a third of ``least_words`` by ``words``, found with less work."""
    least = -(-least_words // 3)
    size = F.octet_length(unit)
    # the text before the last blank needed is the whole text where there are fewer
    return F.lit(least <= 1) | (size > F.octet_length(F.substring_index(unit, " ", max(least - 1, 1)))) | ((size >= 12 * least) & (F.length(unit) >= 12 * least))


def chunk_marks(text: Column, least_words: int = LEAST_WORDS) -> Column:
    """Array of (at, h) of a text's chunks: their first unit, from 0, and a hash."""

    def least(g: Column) -> Column:
        """Places where ``g`` is the least of three in a row that has no bound in it."""
        bounds = F.array(F.lit(_LEAST), F.lit(_LEAST))

        def mark(p: Column, x: Column, i: Column) -> Column:
            left, right = x <= F.get(p, i + 1), x <= F.get(p, i + 3)
            chosen = F.when(left, right | (x <= F.get(p, i))).otherwise(right & (x <= F.get(p, i + 4)))
            return F.when((x > _LEAST) & chosen, F.struct(i.alias("at"), x.alias("h")))

        return let(F.concat(bounds, g, bounds), lambda p: F.array_compact(F.transform(g, lambda x, i: mark(p, x, i))))

    def of(units: Column) -> Column:
        # hashes of the units that are not long, null for the others
        short = F.transform(units, lambda u: F.when(~is_long(u, least_words), F.xxhash64(u)))
        pair = lambda s, x, i: F.when(x.isNull() | F.get(s, i + 1).isNull(), F.lit(_LEAST)).otherwise(F.xxhash64(x, F.get(s, i + 1)))
        rolling = lambda s: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x, i: pair(s, x, i))
        long = lambda s: F.array_compact(F.transform(s, lambda x, i: F.when(x.isNull(), F.struct(i.alias("at"), F.xxhash64(F.get(units, i)).alias("h")))))
        return let(short, lambda s: F.concat(let(rolling(s), least), long(s)))

    return let(bare_units(text), of)


def stretches(marks: Column) -> Column:
    """Array of (first, last) of the stretches of units within NEAR of one of the sorted ``marks``; last may be beyond the text."""
    apart = 2 * NEAR + 1
    firsts = F.filter(marks, lambda x, i: (i == 0) | (x - F.get(marks, i - 1) > apart))
    lasts = F.filter(marks, lambda x, i: (i == F.size(marks) - 1) | (F.get(marks, i + 1) - x > apart))
    return let(lasts, lambda e: F.transform(firsts, lambda x, i: F.struct(F.greatest(x - NEAR, F.lit(0)).alias("first"), (F.get(e, i) + NEAR).alias("last"))))


def sums(n: Column) -> Column:
    """The sums of the longs before each of ``n``, and of all; each block is summed alone, as an array is copied for each number added to it."""
    upto = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda p, x: F.array_append(p, F.element_at(p, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.size(n) - 1, F.lit(BLOCK)), lambda b: upto(F.slice(n, b + 1, F.lit(BLOCK))))
    ends = lambda bs: upto(F.transform(bs, lambda b: F.element_at(b, -1)))
    # the last sum of a block is the first of the next
    inner = lambda bs, e: F.transform(bs, lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda x: x + F.get(e, k)))
    return let(blocks, lambda bs: let(ends(bs), lambda e: F.concat(F.flatten(inner(bs, e)), F.array(F.element_at(e, -1)))))


def runs_of(units: Column, least_words: int, starts: int, base: Column) -> Column:
    """Array of (first, n, body) of the runs of trimmed ``units`` with ``least_words`` words that lose them with their first or last unit.

    Only runs that begin in the first ``starts`` units; ``first`` counts from ``base``; ``body`` is the SHA-256 of the units with line ends between them.
    """
    # words in the low 32 bits, above them the bytes with a line end
    both = F.transform(units, lambda u: F.shiftleft((F.octet_length(u) + 1).cast("long"), 32) + F.least(words(u), F.lit(least_words)))
    low = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    high = lambda x: F.shiftright(x, 32).cast("int")

    def spans(n: Column, s: Column, o: Column) -> Column:
        onward = F.transform(n, lambda _, i: F.struct(i.alias("first"), F.get(o, low(F.get(s, i)) + least_words - 1).alias("last")))

        def back(j: Column) -> Column:
            first = F.get(o, low(F.get(s, j + 1)) - least_words)
            same = F.get(o, low(F.get(s, first)) + least_words - 1) == j  # the run from there on is this one
            return F.struct(first.alias("first"), F.when(~same, j).alias("last"))

        return F.filter(F.concat(onward, F.transform(n, lambda _, j: back(j))), lambda w: (w["first"] < starts) & w["last"].isNotNull())

    def named(s: Column, text: Column, w: Column) -> Column:
        start = high(F.get(s, w["first"]))
        body = F.substr(text, start + 1, high(F.get(s, w["last"] + 1)) - start - 1)
        return F.struct((base + w["first"]).alias("first"), (w["last"] - w["first"] + 1).alias("n"), F.unhex(F.sha2(body, 256)).alias("body"))

    owner = lambda n: F.flatten(F.transform(n, lambda x, i: F.array_repeat(i, low(x))))  # noqa: E731  the unit of each word
    joined = F.array_join(units, "\n").cast("binary")  # bytes, as places in a string are found by counting from its start
    return let(both, lambda n: let(sums(n), lambda s: let(joined, lambda t: F.transform(let(owner(n), lambda o: spans(n, s, o)), lambda w: named(s, t, w)))))


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Runs to remove, (key, first, n): all but the first place of each repeated one in stretches near repeated chunks.

    ``docs`` has key, text and ``near``, the array of those stretches. They are cut into pieces of PIECE units
    where runs begin, with the units in reach.
    """
    reach = PIECE + least_words  # a run has no more units than words
    piece = lambda u, b, s: F.struct(b.alias("base"), F.slice(u, b + 1, F.least(s["last"] - b + 1, F.lit(reach))).alias("units"))
    cut = lambda u, s: F.transform(F.sequence(s["first"], F.least(s["last"], F.size(u) - 1), F.lit(PIECE)), lambda b: piece(u, b, s))
    each = let(bare_units(F.col("text")), lambda u: F.flatten(F.transform("near", lambda s: cut(u, s))))
    rows = docs.select("key", F.explode(each).alias("p")).select("key", "p.base", "p.units")
    bodies = materialize(rows.select("key", F.explode(runs_of(F.col("units"), least_words, PIECE, F.col("base"))).alias("w")).select("key", "w.first", "w.n", "w.body"), "runs")
    # copies are counted before the shuffle; the small table is written, so that a join with it may split the many places of one run
    firsts = bodies.groupBy("body").agg(F.min(F.struct("key", "first")).alias("kept"), F.count("*").alias("places")).filter("places > 1").drop("places")
    firsts = materialize(firsts, "first-places")
    # in its own text, a run that overlaps its first place stays
    apart = ~F.col("key").eqNullSafe(F.col("kept.key")) | (F.col("first") >= F.col("kept.first") + F.col("n"))
    return bodies.join(firsts.hint("merge"), "body").filter(apart).select("key", "first", "n")


def copied_texts(docs: DataFrame) -> DataFrame:
    """Keys of the documents whose whole text an earlier document has, from ``docs`` (key, text)."""
    ids = materialize(docs.filter("text is not null").select("key", F.unhex(F.sha2("text", 256)).alias("body")), "texts")
    known = ids.groupBy("body").agg(F.min("key.doc_id").alias("least"), F.max("key.doc_id").alias("most"), F.count_if(F.col("key.doc_id").isNull()).alias("nulls"))
    known = known.filter("least < most or (nulls > 0 and least is not null)").select("body", F.when(F.col("nulls") == 0, F.col("least")).alias("least"))
    known = materialize(known, "copied-texts")
    return ids.join(known.hint("merge"), "body").filter(~F.col("key.doc_id").eqNullSafe(F.col("least"))).select("key").distinct()


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Remove every globally repeated run of whole lines or sentences of ``least_words`` words or more but its first place.

    The first place is that of the least doc_id, then of the least unit. Returns all rows and all columns of
    ``docs`` with ``text`` cleaned (and ``n_chars``, if there is one, brought in line). Only texts that lose a unit
    change, and each unit that goes is still there at an earlier place. Blanks and line ends between
    units do not count in the comparison; the last unit left loses its line end if units after it go.
    Shorter runs stay, as does a passage without that many words in whole units. Nulls and empty texts
    stay. Rows with the same doc_id and equal texts are one document: they get the same cleaned text.
    Null doc_ids come before others. Extra columns pass through untouched, whatever their names; an
    empty table gives no rows.
    """
    row = F.struct(*(docs[c] for c in docs.columns))
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h")).alias("key")
    chunks = docs.filter("text is not null").select(key, F.explode(chunk_marks(F.col("text"), least_words)).alias("c")).select("key", "c.at", "c.h")
    marks = materialize(chunks, "chunk-marks")
    # a chunk is repeated if it has two places, in two texts or in one; copies of a text are handled as a whole
    two = "least_text < most_text or least_at < most_at"
    often = marks.groupBy("h").agg(F.min("key.h").alias("least_text"), F.max("key.h").alias("most_text"), F.min("at").alias("least_at"), F.max("at").alias("most_at")).filter(two)
    often = materialize(often.select("h"), "repeated-chunks")
    # sort-merge joins below: lists of chunks grow with the corpus, so they are no side to broadcast
    places = marks.join(often.hint("merge"), "h", "left_semi")
    lists = places.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("marks"))  # no more than the units of a text
    lists = lists.select("key", stretches(F.col("marks")).alias("near"))
    packed = docs.select(key, row.alias("row"))
    copies = copied_texts(packed.select("key", "row.text")).withColumn("copy", F.lit(True))
    marked = packed.join(lists.hint("merge"), "key", "left").join(copies.hint("merge"), "key", "left")
    marked = materialize(marked.select("key", "row", "copy", F.when(F.col("copy").isNull(), F.col("near")).alias("near")), "marked")
    touched = marked.filter("near is not null").withColumn("text", F.col("row.text"))
    gone = repeated_runs(touched.select("key", "text", "near"), least_words)
    # a run as one number: its first unit, and in the low bits how many there are
    runs = gone.groupBy("key").agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 32) + F.col("n")).alias("gone"))
    first = lambda w: F.shiftright(w, 32).cast("int")
    without = F.flatten(F.transform("gone", lambda w: F.sequence(first(w), first(w) + w.bitwiseAND(F.lit((1 << 32) - 1)).cast("int") - 1)))

    def rest(units: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(units) - 1), without)
        # the last unit that is left loses its separator if units after it go
        unit = lambda k, i: F.when((i == F.element_at(k, -1)) & (i < F.size(units) - 1), F.rtrim(F.replace(F.get(units, i), F.lit("\n"), F.lit("")))).otherwise(F.get(units, i))
        return let(left, lambda k: F.array_join(F.transform(k, lambda i: unit(k, i)), ""))

    joined = touched.select("key", "row", "text").join(runs.hint("merge"), "key", "left")
    joined = joined.withColumn("clean", F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(split_units(F.col("text")), rest)))
    changed = joined.select("row", "clean", F.col("gone").isNotNull().alias("changed"))
    # all units of a copy of enough words are in runs that the first document has
    enough = F.aggregate(bare_units(F.col("row.text")), F.lit(0), lambda n, u: n + F.least(words(u), F.lit(least_words))) >= least_words
    whole = marked.filter("near is null").withColumn("changed", F.when(F.col("copy"), enough).otherwise(False))
    whole = whole.select("row", F.when(F.col("changed"), "").otherwise(F.col("row.text")).alias("clean"), "changed")
    return with_text(docs, whole.unionByName(changed))
