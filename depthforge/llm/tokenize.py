"""Whole-text encoding with a fixed public tokenizer, one BPE run for each distinct word."""

from __future__ import annotations

import json
import os
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are encoded together; bounds the memory of a worker.
SLICE_CHARS = 4_000_000
#: Words that go to the tokenizer as one text, and what is put between them; a call for each word takes more than twice the time.
GROUP = 100
MARK = "\x7f"
#: The pattern of files whose texts may also be cut between a letter and a mark of punctuation.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _bytes_in(chars: str) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars.encode("latin-1"), dtype=np.uint8))


_BLANK, _LETTER, _PUNCTUATION = _bytes_in(" \n"), _bytes_in(string.ascii_letters), _bytes_in(string.punctuation)
#: Second bytes, after 0xC3, of the letters from U+00C0 to U+00FF.
_ACCENTED = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def _steps(rule: dict | None, key: str) -> list[dict]:
    return [] if rule is None else rule[key] if rule["type"] == "Sequence" else [rule]


def splits_at_blanks(path: str) -> bool:
    """Whether a tokenizer file drops white space before its merges, and no rule of it reads across white space.

    Known to be so are files that fold runs of white space or lower the case, split by a pattern without white space, drop the rest and have
    no special token with white space in it. Of any other file it is not known.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    if rules.get("truncation") or rules.get("padding"):
        return False
    steps = _steps(rules.get("normalizer"), "normalizers")
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in steps)
    splits = _steps(rules.get("pre_tokenizer"), "pretokenizers")
    dropped = bool(splits) and splits[0]["type"] == "Split" and splits[0]["behavior"] == "Removed" and splits[0]["invert"] and "[^\\s" in splits[0]["pattern"].get("Regex", "")
    return plain and dropped and not any(any(c.isspace() for c in t["content"]) for t in rules.get("added_tokens", []))


def special_bytes(path: str) -> list[bytes] | None:
    """Special tokens of a tokenizer file, in lower case, whose other texts may be cut after letters too; None if that is not known of the file.

    It is known of files for which ``splits_at_blanks`` holds, that lower the case, split by LETTERS_APART, then map bytes, and seek special tokens
    in texts as they are. No match of that pattern goes on from a letter to punctuation, and none looks beyond its end; as the
    character after the cut is ASCII, no composition reaches over it.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    splits, added = _steps(rules.get("pre_tokenizer"), "pretokenizers"), rules.get("added_tokens", [])
    known = (
        splits_at_blanks(path)
        and any(x["type"] == "Lowercase" for x in _steps(rules.get("normalizer"), "normalizers"))
        and [x["type"] for x in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": LETTERS_APART}
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and not any(t["normalized"] for t in added)
    )
    return [t["content"].encode().lower() for t in added] if known else None


def cut_after_letters(texts: pa.Array, special: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Units of all texts, the bounds of each text in them (one more than texts), and the texts that hold a special token in any case.

    A unit ends at blanks and line feeds, which belong to none, and between a letter (ASCII, or U+00C0 to U+00FF) and ASCII punctuation. ASCII capitals
    are lowered where an ASCII character follows; before any other, a mark might be composed with the capital or with the small letter alone.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = int(offsets[-1] - offsets[0])
    if not n:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, dtype=np.int64), np.empty(0, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    lower = _LOWER[data]
    raw, found = lower.tobytes(), []
    for token in special:
        at = raw.find(token)
        while at >= 0:
            found.append(at)
            at = raw.find(token, at + 1)
    whole = np.unique(np.searchsorted(edges, found, side="right") - 1).astype(np.int64)
    blank, end = _BLANK[data], _LETTER[data]
    end[1:] |= (data[:-1] == 0xC3) & _ACCENTED[data[1:]]
    begin = np.ones(n, dtype=bool)
    begin[1:] = blank[:-1] | end[:-1] & _PUNCTUATION[data[1:]]
    begin[edges[:-1][edges[:-1] < n]] = True
    begin &= ~blank
    lower[:-1] = np.where(data[1:] < 0x80, lower[:-1], data[:-1])
    kept = lower[~blank]
    starts = np.append(np.flatnonzero(begin[~blank]), len(kept))
    units = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return units, np.searchsorted(np.flatnonzero(begin), edges), whole


class WordEncoder:
    """Encodes texts as the tokenizers library does; by encoding each distinct word once, if its file allows that.

    Where ``splits_at_blanks`` holds, the ids of a text are the ids of its words, one after the other. Texts are
    cut at blanks and line feeds only, with files of which ``special_bytes`` knows it also after letters; any other white space stays inside a word and goes to
    the tokenizer as it is. With any other file whole texts are encoded, and so are texts with special tokens that are cut after letters. The cache of words is bounded by ``max_words`` and ``max_ids``;
    beyond that it starts anew, which changes the time and not the ids.
    """

    def __init__(self, path: str, max_words: int = 700_000, max_ids: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = splits_at_blanks(path)
        self.special = special_bytes(path)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.max_words, self.max_ids = max_words, max_ids
        self._reset()

    def _reset(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.uint32)
        self.bounds = np.zeros(1 << 14, dtype=np.int64)
        self.used = 0

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=int(sizes.sum())), sizes

    def _by_group(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words, GROUP at a time with a mark after each; a group with the mark's id in its words goes one by one."""
        if self.mark is None:
            return self._one_by_one(words)
        groups = [words[at : at + GROUP] for at in range(0, len(words), GROUP)]
        joined = [f" {MARK} ".join([*group, ""]) for group in groups]
        out = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint32)
            marks = ids == self.mark
            at = np.flatnonzero(marks)
            out.append((ids[~marks], np.diff(at, prepend=-1) - 1) if len(at) == len(group) else self._one_by_one(group))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _add(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids, sizes = self._by_group(part)
            total = len(ids)
            while self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            first = len(self.slots)
            while first + len(part) + 1 > len(self.bounds):
                self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.flat[self.used : self.used + total] = ids
            self.bounds[first + 1 : first + 1 + len(part)] = self.used + np.cumsum(sizes)
            self.used += total
            self.slots.update(zip(part, range(first, first + len(part)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text (one more than texts)."""
        if not self.words:
            ids, sizes = self._one_by_one(texts.to_pylist())
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        if self.special is None:
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            edges = lists.offsets.to_numpy().astype(np.int64)
            return self._by_words(lists.flatten(), edges - edges[0])
        units, edges, whole = cut_after_letters(texts, self.special)
        if not len(whole):
            return self._by_words(units, edges)
        parts = []  # stretches of texts cut, and between them whole ones
        for a, b in zip([0, *(whole + 1).tolist()], [*whole.tolist(), len(texts)], strict=True):
            ids, bounds = self._by_words(units.slice(edges[a], edges[b] - edges[a]), edges[a : b + 1] - edges[a])
            parts.append((ids, np.diff(bounds)))
            if b < len(texts):
                parts.append(self._one_by_one([texts[b].as_py()]))
        return np.concatenate([x for x, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])

    def _by_words(self, units: pa.Array, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units in a row, and the bounds in them of the texts that ``edges`` divides the units into."""
        if len(self.slots) > self.max_words or self.used > self.max_ids:
            self._reset()
        coded = units.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        slots = self.slots
        missing = [w for w in words if w not in slots]
        if missing:
            self._add(missing)
        slot = np.fromiter(map(slots.__getitem__, words), dtype=np.int64, count=len(words))
        start, size = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        code = coded.indices.to_numpy(zero_copy_only=False)
        sizes = size[code]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(start[code] - (ends - sizes), sizes)
        at += np.arange(total)
        return self.flat[at], np.concatenate([[0], ends])[edges]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process; Spark keeps workers, so its cache lives across tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """Forget the encoders and words of this worker process."""
    _encoders.clear()


def text_slices(texts: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``most`` bytes each; a longer text is a run of its own."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if held and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(size):
        yield at, len(size)


def default_tokenizer() -> str:
    """Path of the public tokenizer file; every operator takes another one as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
