"""Benchmark decontamination by q-gram counting in diagonal bands.

Texts are compared as letters and digits in lower case with single blanks between words. If a
stretch of a document is within ``e`` edits of an item with ``m`` characters, the two share at
least ``m + 1 - q - q*e`` q-grams (the q-gram lemma), and all of these lie within ``e`` diagonals. So the
q-grams that a document shares with an item are counted in overlapping bands of diagonals, bands
below the bound are dropped, and the regions that are left are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import alphanumeric, code_points, lowered
from .common import bound_batches, materialize
from .tokenize import text_slices
from .workers import tidy

Q = 8
#: Edits allowed for each character of an item.
EDIT_RATE = 0.08
#: Characters of items in one index; a larger benchmark is handled in blocks of items, one pass each.
INDEX_CHARS = 4_000_000
#: Pairs of a text's and an item's q-gram that are held at once; bounds the memory of texts and items of few kinds of q-grams.
PAIRS = 1 << 20
#: Times a q-gram may occur in an item before only some of its places are kept.
OFTEN = 32
_BITS = 22
BASE = 0x9E3779B1
_SLOTS = 1 << 20


def normalized(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept code points of all texts, the place of each in its text, and the bounds of the texts among them.

    Letters and digits are kept in lower case, and of each run of others one blank, except at a text's start.
    """
    codes, starts = code_points(texts)
    word = alphanumeric(codes)
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first after a word: a blank
    at = np.flatnonzero(keep)
    out = np.where(word[at], lowered(codes[at]), 32).astype(np.uint32)
    bounds = np.searchsorted(at, starts)
    return out, at - starts[np.searchsorted(starts, at, side="right") - 1], bounds


def trimmed(text: str) -> np.ndarray:
    codes, _, _ = normalized([text])
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hashes of all q-grams, put together from those of 1, 2, 4, ... characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint32)
    power, size = codes.astype(np.uint32), 1
    out, done = np.zeros(len(codes), dtype=np.uint32), 0
    while True:
        if q & size:
            # what is done so far, then the next `size` characters
            more = len(codes) - done - size + 1
            out = out[:more] * np.uint32(pow(BASE, size, 1 << 32)) + power[done : done + more] if done else power
            done += size
        if size * 2 > q:
            break
        power = power[:-size] * np.uint32(pow(BASE, size, 1 << 32)) + power[size:]
        size *= 2
    out = out[:n].copy()
    out ^= out >> np.uint32(15)
    return out * np.uint32(0x2C1B3C6D)


def edit_budget(m: int, q: int, rate: float) -> int:
    """Edits allowed in an item of ``m`` characters: the rate, but no more than leave a shared q-gram certain."""
    return max(0, min(int(rate * m), (m - q) // q))


@dataclass
class ItemIndex:
    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray
    least: np.ndarray  # q-grams that must be shared
    grams: np.ndarray  # distinct hashes, sorted
    first: np.ndarray  # of each hash, its first entry in item and place
    item: np.ndarray
    place: np.ndarray
    slack: np.ndarray  # of each item, how far a kept place may be from one that is not
    member: np.ndarray
    short: list[int]  # items with fewer than q characters
    q: int

    @classmethod
    def build(cls, ids: list, texts: list[str], q: int, rate: float) -> ItemIndex:
        codes = [trimmed(t) for t in texts]
        budget = np.array([edit_budget(len(c), q, rate) for c in codes], dtype=np.int64)
        size = np.array([len(c) for c in codes], dtype=np.int64)
        hashes = [gram_hashes(c, q) for c in codes]
        item = np.repeat(np.arange(len(codes)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if codes else np.empty(0, dtype=np.int64)
        every = np.concatenate(hashes) if codes else np.empty(0, dtype=np.uint32)
        order = np.lexsort((place, item, every))
        every, item, place = every[order], item[order], place[order]
        slack = np.zeros(len(codes), dtype=np.int64)
        keep = np.ones(len(every), dtype=bool)
        new = np.flatnonzero((every[1:] != every[:-1]) | (item[1:] != item[:-1])) + 1
        edges = np.concatenate([[0], new, [len(every)]])
        for k in np.flatnonzero(np.diff(edges) > OFTEN):
            a, b = edges[k : k + 2]
            if far := int(budget[item[a]]):
                # a q-gram that an item is full of: each place left out has one within the item's budget before it
                slack[item[a]] = far
                at = place[a:b]
                kept, last = np.zeros(b - a, dtype=bool), 0
                while last < b - a:
                    kept[last] = True
                    last = int(np.searchsorted(at, at[last] + far, side="right"))
                keep[a:b] = kept
        every, item, place = every[keep], item[keep], place[keep]
        grams, first = np.unique(every, return_index=True)
        member = np.zeros(1 << _BITS, dtype=bool)
        member[(grams >> np.uint32(32 - _BITS)).astype(np.int64)] = True
        return cls(ids, codes, budget, size + 1 - q - q * budget, grams, np.append(first, len(every)), item, place, slack, member, [i for i, c in enumerate(codes) if 0 < len(c) < q], q)


def banded_distance(a: list[np.ndarray], b: list[np.ndarray], shift: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each whole ``a[k]`` and any stretch of ``b[k]``, and the stretch's end.

    The alignment of a[k][i] lies at b[k][i + shift[k] + d] for 0 <= d < width[k]; all pairs go on
    at once, a row of the table for each character of the longest ``a``.
    """
    n, band = len(a), int(width.max())
    rows = max(map(len, a))
    sizes = np.array([len(x) for x in a])
    pad = band + rows + 2
    left = np.zeros((n, rows), dtype=np.int64)
    right = np.full((n, max(map(len, b)) + 2 * pad), -1, dtype=np.int64)
    for k in range(n):
        left[k, : len(a[k])] = a[k]
        right[k, pad : pad + len(b[k])] = b[k]
    slot = np.arange(band)
    far = 1 << 20
    size_b = np.array([len(x) for x in b])
    inside = lambda i: (shift[:, None] + i + slot >= 0) & (shift[:, None] + i + slot <= size_b[:, None]) & (slot < width[:, None])
    now = np.where(inside(0), 0, far)  # cell d of row i: a[:i] against b up to shift + i + d
    best, end = np.where(sizes == 0, 0, far), np.zeros(n, dtype=np.int64)
    each = np.arange(n)[:, None]
    for i in range(1, rows + 1):
        columns = shift[:, None] + i + slot + pad - 1
        other = right[each, np.clip(columns, 0, right.shape[1] - 1)]
        step = np.minimum(now + (other != left[:, i - 1, None]), np.concatenate([now[:, 1:], np.full((n, 1), far)], axis=1) + 1)
        step = np.where(inside(i), step, far)
        now = np.minimum.accumulate(step - slot, axis=1) + slot
        now = np.where(inside(i), now, far)
        if len(done := np.flatnonzero(sizes == i)):
            d = now[done].argmin(axis=1)
            best[done], end[done] = now[done, d], shift[done] + i + d
    return best, end


def stretch_size(item: np.ndarray, text: np.ndarray, edits: int) -> int:
    """Length of the longest end of ``text`` that is ``edits`` edits from ``item``."""
    a, b = item[::-1], text[: len(text) - len(item) - edits - 1 : -1] if len(text) > len(item) + edits else text[::-1]
    slot = np.arange(len(b) + 1)
    now = slot
    for i, c in enumerate(a, 1):
        step = np.concatenate([[i], np.minimum(now[:-1] + (b != c), now[1:] + 1)])
        now = np.minimum.accumulate(step - slot) + slot
    return int(np.flatnonzero(now == edits)[-1])


def find_regions(index: ItemIndex, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, first diagonal, last diagonal) of the bands with enough shared q-grams."""
    empty = np.empty(0, dtype=np.int64)
    h = gram_hashes(codes, index.q)
    if not len(h) or not len(index.grams):
        return empty, empty, empty, empty
    at = np.flatnonzero(index.member[(h >> np.uint32(32 - _BITS)).astype(np.int64)])
    found = np.searchsorted(index.grams, h[at])
    real = index.grams[np.minimum(found, len(index.grams) - 1)] == h[at]
    at, found = at[real], found[real]
    # a band needs many hits in a stretch as long as an item: drop hits in stretches with too few of them
    longest = int(max(len(c) for c in index.codes) + index.budget.max() + index.slack.max())
    need = int(index.least.min())
    near = np.searchsorted(at, at + longest, side="right") - np.searchsorted(at, at - longest)
    keep = near >= need
    at, found = at[keep], found[keep]
    # a hit's document is that of its place: its diagonal may begin before the document, in another one
    doc = np.searchsorted(bounds, at, side="right") - 1
    keep = at + index.q <= bounds[doc + 1]
    at, found, doc = at[keep], found[keep], doc[keep]
    n = index.first[found + 1] - index.first[found]
    if not int(n.sum()):
        return empty, empty, empty, empty
    # bands of 2w diagonals that overlap by w, so that any e + 1 neighbours, each off by the slack at most, lie in one
    widths = index.budget + 2 * index.slack + 1
    # documents with hits are set so far apart that no band holds diagonals of two
    apart = at + longest + np.unique(doc, return_inverse=True)[1] * (longest + 2 * int(widths.max()))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1, [len(n)]])

    def pairs(a: int, b: int, half: int) -> tuple[np.ndarray, ...]:
        """Item, number of the hit, diagonal and band of the pairs of hits a to b."""
        m = n[a:b]
        entry = np.repeat(index.first[found[a:b]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        item, hit, place = index.item[entry], np.repeat(np.arange(a, b), m), index.place[entry]
        return item, hit, at[hit] - place, (apart[hit] - place + half * widths[item]) // (2 * widths[item])

    out = []
    for half in (0, 1):
        # a slot's count is no less than that of any band in it, so bands in slots below the bound are done with
        slots = np.zeros(_SLOTS, dtype=np.int64)
        held, found_in = None, []
        slot_of = lambda item, band: (item * 0x9E3779B1 + band * 0x85EBCA77) & (_SLOTS - 1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held = pairs(a, b, half)
            slots += np.bincount(slot_of(held[0], held[3]), minlength=_SLOTS)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            item, hit, diagonal, band = held if len(cuts) == 2 else pairs(a, b, half)
            some = np.flatnonzero(slots[slot_of(item, band)] >= index.least[item])
            if len(some):
                found_in.append(_by_kind(item[some] * (1 << 40) + band[some], np.ones(len(some), dtype=np.int64), diagonal[some], diagonal[some], doc[hit[some]]))
        if found_in:
            kinds, count, low, high, owner = _by_kind(*map(np.concatenate, zip(*found_in, strict=True)))
            item = kinds >> 40
            sure = np.flatnonzero(count >= index.least[item])
            out.append(np.stack([item[sure], low[sure] - index.slack[item[sure]], high[sure] + index.slack[item[sure]], owner[sure]]))
    if not out:
        return empty, empty, empty, empty
    item, low, high, doc = np.unique(np.concatenate(out, axis=1), axis=1)
    return doc, item, low, high


def _by_kind(kind: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each kind: its count, its ends and an owner."""
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    return kind[first], np.add.reduceat(count[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), owner[order][first]


def find_leaks(index: ItemIndex, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of the best region of each item in each text."""
    codes, origin, bounds = normalized(texts)
    doc, item, low, high = find_regions(index, codes, bounds)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    size = np.array([len(c) for c in index.codes])
    step = max(1, min(2000, PAIRS // int(size.max(initial=1))))
    for at in range(0, len(doc), step):
        # regions go by their diagonals, so of an item found without edits no later one is better
        part = np.array([k for k in range(at, min(at + step, len(doc))) if best.get((int(doc[k]), int(item[k])), (1,))[0]], dtype=np.int64)
        if not len(part):
            continue
        d, t, e = doc[part], item[part], index.budget[item[part]]
        lo = low[part] - e
        width = high[part] - low[part] + 2 * e + 1
        begin, stop = np.maximum(lo, bounds[d]), np.minimum(lo + width + size[t], bounds[d + 1])
        edits, end = banded_distance([index.codes[i] for i in t], [codes[b:s] for b, s in zip(begin, stop, strict=True)], lo - begin, width)
        for k in np.flatnonzero(edits <= e):
            key = (int(d[k]), int(t[k]))
            last = int(begin[k] + end[k])
            first = max(int(bounds[d[k]]), last - int(size[t[k]]))
            if key not in best or (int(edits[k]), first) < best[key][:2]:
                best[key] = (int(edits[k]), first, last)
    for (d, i), (e, _, last) in best.items():
        if e:
            best[d, i] = (e, last - stretch_size(index.codes[i], codes[bounds[d] : last], e), last)
    if index.short:
        for d in range(len(texts)):
            words = " " + "".join(map(chr, codes[bounds[d] : bounds[d + 1]])).strip() + " "
            for i in index.short:
                if (x := words.find(" " + "".join(map(chr, index.codes[i])) + " ")) >= 0:
                    best[d, i] = (0, int(bounds[d]) + x, int(bounds[d]) + x + len(index.codes[i]))
    return [(d, i, int(origin[f]), int(origin[min(last, bounds[d + 1]) - 1]) + 1, e) for (d, i), (e, f, last) in sorted(best.items())]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """Stretches of documents that are benchmark items up to a few edits.

    Returns (doc_id, item_id, start, end, edits): for each document and item the stretch with the fewest
    edits, in code points of the text, its end exclusive. Items of fewer than ``q`` letters, digits and blanks
    are looked for as whole words without edits; null items and items without a letter or digit
    match nothing. Null texts have no leaks. Rows with null or repeated doc_ids count by
    themselves. Other columns of both tables are ignored. Empty tables give no rows.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").filter("text is not null")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // index_chars))
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, start bigint, `end` bigint, edits bigint"
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for block in range(blocks):
        # a block has about index_chars characters, so what is broadcast is bounded
        rows = sorted((r["text"], r["item_id"]) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect())
        index = ItemIndex.build([r[1] for r in rows], [r[0] for r in rows], q, rate)
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for a, b in text_slices(batch.column("text"), 2_000_000):
                    part = batch.slice(a, b - a)
                    found = find_leaks(index, part.column("text").fill_null("").to_pylist())
                    if found:
                        d, i, start, end, edits = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array([index.ids[x] for x in i], type=item_type), pa.array(start), pa.array(end), pa.array(edits)], names=["doc_id", "item_id", "start", "end", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(tidy(scan), schema)
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of ``docs`` in whose own text no item of ``benchmark`` is found, with all columns as they are.

    A row goes for its text: other rows of its doc_id stay. Null texts stay; rows with a null doc_id go like others.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))  # a struct is never null, so null ids join
    leaks = benchmark_leaks(docs.select(key.alias("doc_id"), "text"), benchmark, q, rate, index_chars)
    gone = materialize(leaks.select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(gone, F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("h")) == gone["_gone"], "left_anti")
