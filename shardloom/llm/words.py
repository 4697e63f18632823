"""Ids of texts by a tokenizer of the tokenizers library that drops white space, each word encoded once.

Texts are cut at ASCII white space. Chunks of plain characters (ASCII but the apostrophe and control characters, and
the letters from U+00C0 to U+00FF) are put in lower case and cut on, where the pre-tokenizer cuts, into runs of
letters, single digits and runs of marks, of which the tokenizer gets many at a time, joined by spaces. All other chunks are words as they are
and go through the whole tokenizer. The normalizer lower-cases, composes and turns white space into one space, which
changes nothing in plain lower-case words, and the pre-tokenizer drops white space, so the ids are those of the whole
text.

Plain words of up to 16 bytes, nearly all, are found in an open-addressing table of numpy arrays, whose keys are the
words' bytes themselves; longer and other words in a dictionary. At most KNOWN words, and those of one PIECE of text,
are kept in a process; then the table starts again.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

KNOWN = 900_000
TABLE_BITS = 22
#: Bytes of text that are cut into words at once; one text at least.
PIECE = 2 << 20
_JOINED = 64

_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _class(x: int) -> int:
    if x in b" \t\n\x0b\x0c\r":
        return _SPACE
    if x >= 128 or chr(x).isalpha():
        return _LETTER
    if chr(x).isdigit():
        return _DIGIT
    return _MARK if 32 < x < 127 and x != 39 else _OTHER


_CLASS = bytes(_class(x) for x in range(256))
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_M0, _M1 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words:
    """The words met so far by a worker process. end_id is appended to each text's ids."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        levels = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "ByteLevel"]
        ending = spec["model"]["end_of_word_suffix"]
        if len(levels) != 1 or not ending:
            raise ValueError("the tokenizer must be byte-level BPE with word ends")
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        #: The same model for words that are normal and cut already, joined by spaces.
        cut = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        self.plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [cut, *levels]}}))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        top = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.bits = max(16, (top - 1).bit_length())
        #: Ids that end a word. Every word has just one, its last.
        self.ends = np.zeros(top, bool)
        self.ends[[i for token, i in spec["model"]["vocab"].items() if token.endswith(ending)]] = True
        self.kind = np.dtype("<u2" if self.bits == 16 else "<u4")
        self.clear()

    def clear(self) -> None:
        self.low, self.high = np.zeros(1 << TABLE_BITS, np.uint64), np.zeros(1 << TABLE_BITS, np.uint64)
        self.slot = np.zeros(1 << TABLE_BITS, np.int32)
        self.others: dict[bytes, int] = {}
        # Word 0 is the end of a text.
        self.count, self.used = 1, 1
        self.flat = np.full(1 << 16, self.end_id, self.kind)
        self.begin, self.size = np.zeros(1 << 16, np.int32), np.ones(1 << 16, np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        ids, sizes = self.encode_arrow(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, joined, and each text's number of them with its end id. Null is an empty text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = memoryview(texts.buffers()[2] or b"")
        ids, sizes = [], []
        k = 0
        while k < len(texts):
            last = max(k + 1, int(np.searchsorted(edges, edges[k] + PIECE, "right")) - 1)
            some, n = self._piece(bytes(whole[edges[k] : edges[last]]), edges[k : last + 1] - edges[k])
            ids.append(some)
            sizes.append(n)
            k = last
        return np.concatenate(ids), np.concatenate(sizes)

    def _piece(self, raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.count > KNOWN:
            self.clear()
        text, kind = _plain(raw, edges)
        first, after = _cut(kind, edges)
        at = self._find(text, first, after - first, kind)
        # An end after the words of each text.
        place = np.searchsorted(first, edges[1:], "left")
        at = np.insert(at, place, 0)
        size = self.size[at]
        total = np.cumsum(size, dtype=np.int64)
        ids = self.flat[np.repeat(self.begin[at] - (total - size), size) + np.arange(total[-1])]
        return ids, np.diff(total[place + np.arange(len(place))], prepend=0)

    def _find(self, text: np.ndarray, first: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The numbers of words; new ones are learned."""
        at = np.zeros(len(first), np.int32)
        if not len(first):
            return at
        padded = np.zeros(len(text) + 16, np.uint8)
        padded[: len(text)] = text
        words = np.ndarray((len(text) + 9,), "<u8", padded, strides=(1,))
        short = (size <= 16) & (kind[first] != _OTHER)
        some = np.arange(len(first)) if short.all() else np.flatnonzero(short)
        start, n = first[some], size[some]
        low, high = words[start] & _KEEP[np.minimum(n, 8)], np.zeros(len(some), np.uint64)
        wide = np.flatnonzero(n > 8)
        high[wide] = words[start[wide] + 8] & _KEEP[n[wide] - 8]
        found = self._look(low, high)
        missing = np.flatnonzero(found == 0)
        if len(missing):
            order = missing[np.lexsort((high[missing], low[missing]))]
            new = np.ones(len(order), bool)
            new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            one = order[new]
            numbers = self._learn([padded[s : s + k].tobytes() for s, k in zip(start[one].tolist(), n[one].tolist())], True)
            self._enter(low[one], high[one], numbers)
            found[order] = numbers[np.cumsum(new) - 1]
        at[some] = found
        rest = np.flatnonzero(~short)
        if len(rest):
            # A chunk with other characters may be spelled like no plain word, so one dictionary holds both.
            spelled = [padded[s : s + k].tobytes() for s, k in zip(first[rest].tolist(), size[rest].tolist())]
            plain = dict(zip(spelled, (kind[first[rest]] != _OTHER).tolist()))
            for is_plain in (True, False):
                unknown = [w for w, p in plain.items() if p == is_plain and w not in self.others]
                self.others.update(zip(unknown, self._learn(unknown, is_plain).tolist()))
            at[rest] = [self.others[w] for w in spelled]
        return at

    def _look(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = _slots(low, high)
        got = self.slot[slot]
        left = np.flatnonzero((got != 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << TABLE_BITS) - 1)
            s = slot[left]
            got[left] = self.slot[s]
            left = left[(got[left] != 0) & ((self.low[s] != low[left]) | (self.high[s] != high[left]))]
        return got

    def _enter(self, low: np.ndarray, high: np.ndarray, numbers: np.ndarray) -> None:
        slot, left = _slots(low, high), np.arange(len(low))
        while len(left):
            free = left[self.slot[slot[left]] == 0]
            self.slot[slot[free]] = numbers[free]  # of two at one place, one stays
            won = free[self.slot[slot[free]] == numbers[free]]
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            left = left[self.slot[slot[left]] != numbers[left]]
            slot[left] = (slot[left] + 1) & ((1 << TABLE_BITS) - 1)

    def _learn(self, words: list[bytes], plain: bool) -> np.ndarray:
        """Encodes new words; plain ones _JOINED at a time."""
        text = [w.decode("utf-8") for w in words]
        if plain:
            done = self.plain.encode_batch_fast([" ".join(text[k : k + _JOINED]) for k in range(0, len(text), _JOINED)], add_special_tokens=False)
            ids = np.concatenate([np.zeros(0, np.int64), *(np.array(e.ids, np.int64) for e in done)])
            size = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(size) != len(words):
                raise ValueError("the vocabulary doesn't mark the end of every word")
        else:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(text, add_special_tokens=False)]
            ids, size = np.array([i for x in got for i in x], np.int64), np.array([len(x) for x in got], np.int64)
        n, used = self.count + len(words), self.used + len(ids)
        self.begin, self.size, self.flat = _room(self.begin, n), _room(self.size, n), _room(self.flat, used)
        self.begin[self.count : n], self.size[self.count : n] = self.used + np.cumsum(size) - size, size
        self.flat[self.used : used] = ids
        numbers = np.arange(self.count, n, dtype=np.int32)
        self.count, self.used = n, used
        return numbers


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n - len(x), len(x)), x.dtype)])


def _slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    mixed = low * _M0
    mixed ^= high * _M1
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _M1) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _plain(raw: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, with plain chunks in lower case; class of each byte, _OTHER throughout other chunks)."""
    text = np.frombuffer(bytearray(raw.translate(_LOWER)), np.uint8)
    kind = np.frombuffer(bytearray(raw.translate(_CLASS)), np.uint8)
    odd = kind == _OTHER
    lead = trail = np.zeros(0, np.int64)
    if not raw.isascii():
        far = np.flatnonzero(text >= 128)
        lead = far[text[far] == 0xC3]  # U+00C0 to U+00FF
        trail = text[lead + 1]
        plain = (trail != 0x97) & (trail != 0xB7)
        lead, trail = lead[plain], trail[plain]
        rest = np.ones(len(text), bool)
        rest[lead], rest[lead + 1] = False, False
        odd[far] = rest[far]
    if odd.any():
        space = np.flatnonzero(kind == _SPACE)
        cuts = np.union1d(np.concatenate([space, space + 1]), edges)
        where = np.unique(np.searchsorted(cuts, np.flatnonzero(odd), "right"))
        step = np.zeros(len(text) + 1, np.int32)
        np.add.at(step, cuts[where - 1], 1)
        np.add.at(step, np.append(cuts, len(text))[where], -1)
        inside = np.cumsum(step[:-1]) > 0
        kind[inside] = _OTHER
        text[inside] = np.frombuffer(raw, np.uint8)[inside]
    upper = lead[(trail <= 0x9E) & (kind[lead] != _OTHER)] + 1
    text[upper] += 0x20
    return text, kind


def _cut(kind: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.empty(len(kind), bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    starts |= kind == _DIGIT
    starts[edges[:-1][edges[:-1] < len(kind)]] = True
    first = np.flatnonzero(starts)
    after = np.append(first[1:], len(kind))
    keep = kind[first] != _SPACE
    return first[keep], after[keep]
