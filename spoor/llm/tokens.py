"""Token ids of whole texts with a public tokenizer and a bounded table of words.

The default tokenizer drops white space and never joins characters across it, and parts
words into runs of letters, single digits and runs of other signs.  These pieces are found,
hashed and looked up in arrays, a block of text at a time; each piece that is not known yet
is encoded once and kept while there is room.  New pieces of ASCII signs and Latin letters
are merged many at a time in numpy; words with an apostrophe or any other character, and all
texts of a tokenizer of another build, go to the ``tokenizers`` library.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from spoor.llm.words import blocks, hashes

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Most pieces and ids that are kept; slots of the table; longest piece that is merged here.
_PIECES, _IDS, _SLOTS, _LONG = 800_000, 8_000_000, 1 << 21, 48
#: Kinds of bytes: white space, letters, digits, signs, and whatever makes a whole word go to the library.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The build of the tokenizer that this way of splitting is right for.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairRanks:
    """Ranks of pairs of 16-bit symbols in a few hash tables, each for the pairs that found their slot taken before."""

    NONE = 1 << 24
    _BITS, _MULTIPLIERS = 18, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        keys, ranks = self._key(left, right), np.arange(len(left), dtype=np.int32)
        self.tables = []
        for multiplier in map(np.uint32, self._MULTIPLIERS):
            if not len(keys):
                break
            slots = (keys * multiplier) >> np.uint32(32 - self._BITS)
            _, first = np.unique(slots, return_index=True)
            key, rank = np.full(1 << self._BITS, 0xFFFFFFFF, np.uint32), np.full(1 << self._BITS, self.NONE, np.int32)
            key[slots[first]], rank[slots[first]] = keys[first], ranks[first]
            self.tables.append((multiplier, key, rank))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, ranks = keys[rest], ranks[rest]
        if len(keys):
            raise ValueError("pairs do not fit their tables")

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint32) << np.uint32(16)) | (right.astype(np.uint32) & np.uint32(0xFFFF))

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = self._key(left, right)
        out = np.full(wanted.shape, self.NONE, np.int32)
        for multiplier, key, rank in self.tables:
            slot = (wanted * multiplier) >> np.uint32(32 - self._BITS)
            hit = key[slot] == wanted
            out[hit] = rank[slot[hit]]
        return out


class Merger:
    """Byte-pair merges of many short pieces at once: always the pair of least rank, leftmost first."""

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        signs = _byte_symbols()
        self.inner = np.array([vocab[s] for s in signs], np.int32)
        self.last = np.array([vocab[s + end] for s in signs], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = PairRanks(np.array([vocab[a] for a, _ in pairs]), np.array([vocab[b] for _, b in pairs]))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def ids(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in the rows of ``raw`` (of ``size`` bytes each), one after another, and how many each has.

        Places stand in rows and pieces in columns; the places of a piece are linked lists, so a
        merge touches its neighbours alone.  A rank and its place are one number, whose least is
        the next merge.
        """
        n, width = raw.shape
        every = np.arange(n)
        symbol = np.full((width + 2, n), -1, np.int32)  # a place before the first and one behind the last
        symbol[1:-1] = np.where(np.arange(width)[:, None] < size, self.inner[raw.T], -1)
        symbol[size, every] = self.last[raw[every, size - 1]]
        place = np.arange(width + 2, dtype=np.int32)[:, None]
        best = np.full((width + 2, n), PairRanks.NONE << 6, np.int32)
        best[1:-1] = (self.ranks(symbol[1:-1], symbol[2:]) << 6) | place[1:-1]
        after, before = np.repeat(place + 1, n, 1).ravel(), np.repeat(place - 1, n, 1).ravel()
        flat, best_flat = symbol.ravel(), best.ravel()
        while True:
            least = best.min(0)
            at = np.flatnonzero(least < PairRanks.NONE << 6)
            if not len(at):
                break
            here, made = least[at] & 63, self.made[least[at] >> 6]
            i = here * n + at
            gone = after[i] * n + at
            right = after[gone]
            left = before[i]
            j, k = right * n + at, left * n + at
            flat[i], flat[gone] = made, -1
            after[i], before[j] = right, here
            best_flat[gone] = PairRanks.NONE << 6
            new = self.ranks(np.concatenate([made, flat[k]]), np.concatenate([flat[j], made])) << 6
            best_flat[i] = new[: len(at)] | here
            best_flat[k] = new[len(at) :] | left
        kept = symbol[1:-1].T
        alive = kept >= 0
        return kept[alive], alive.sum(1)


class Encoder:
    """Ids of text columns and texts."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            build = json.load(f)
        self.merger = Merger(build["model"]) if self._by_words(build) else None
        self._forget()

    @staticmethod
    def _by_words(build: dict) -> bool:
        try:
            split = build["pre_tokenizer"]["pretokenizers"][0]
            steps = [n["type"] for n in build["normalizer"]["normalizers"]]
            model = build["model"]
            return (
                model["end_of_word_suffix"] == "</w>" and len(model["vocab"]) < 1 << 16 and split["pattern"]["Regex"] == _SPLIT
                and split["behavior"] == "Removed" and steps == ["NFC", "Replace", "Lowercase"]
            )
        except (KeyError, IndexError, TypeError):
            return False

    def _forget(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.entries = np.zeros(_SLOTS, np.int32)
        self.known = self.used = 0
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int32)
        self.store = np.zeros(1 << 14, np.uint32)
        self._put(np.array([END_ID], np.uint32), np.ones(1, np.int32))  # entry 0 is the end id

    def _put(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Append entries, whose ids stand one after another."""
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while self.known + len(counts) > len(self.count):
            self.first, self.count = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.count))
        self.store[self.used : self.used + len(ids)] = ids
        self.count[self.known : self.known + len(counts)] = counts
        self.first[self.known : self.known + len(counts)] = self.used + np.cumsum(counts) - counts
        self.known, self.used = self.known + len(counts), self.used + len(ids)

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 for those not known."""
        shift, last = np.uint64(64 - (_SLOTS.bit_length() - 1)), np.uint64(_SLOTS - 1)
        slot = wanted >> shift
        held = self.keys[slot]
        out = np.where(held == wanted, self.entries[slot], -1)
        todo = np.flatnonzero((held != wanted) & (held != 0))
        while len(todo):  # their slots hold other pieces: look on
            slot[todo] = (slot[todo] + np.uint64(1)) & last
            held = self.keys[slot[todo]]
            found = held == wanted[todo]
            out[todo[found]] = self.entries[slot[todo[found]]]
            todo = todo[~found & (held != 0)]
        return out

    def _enter(self, new: np.ndarray, entries: np.ndarray) -> None:
        """Note the entries of distinct hashes that are not known."""
        slot = new >> np.uint64(64 - (_SLOTS.bit_length() - 1))
        while len(new):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = new[free]
            mine = free & (self.keys[slot] == new)
            self.entries[slot[mine]] = entries[mine]
            new, entries, slot = new[~mine], entries[~mine], (slot[~mine] + np.uint64(1)) & np.uint64(_SLOTS - 1)

    # ids ------------------------------------------------------------------------------
    def _library(self, items: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(items, add_special_tokens=False)]

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]

    def batch(self, items: list[str | None]) -> list[np.ndarray]:
        out = []
        for _, _, ids, offsets in self.column(pa.array(items, pa.string()), end=False):
            out += [ids[p:q] for p, q in zip(offsets[:-1], offsets[1:])]
        return out

    def column(self, column: pa.Array, end: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, offsets) of runs of rows; with ``end`` each row's ids are followed by the end id."""
        for a, b, data, offsets in blocks(column):
            if self.merger is None:
                found = self._library([data[p:q].tobytes().decode("utf-8", "replace") for p, q in zip(offsets[:-1], offsets[1:])])
                found = [np.append(x, np.uint32(END_ID)) for x in found] if end else found
                yield a, b, np.concatenate(found), np.cumsum([0, *map(len, found)])
            else:
                yield a, b, *self._block(data, offsets, end)

    def _block(self, data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
        low, kind = self._kinds(data, offsets)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        change = kind[1:] != kind[:-1]
        change |= kind[1:] == _DIGIT
        cut[1:-1] |= change
        solid = kind != _SPACE
        starts, ends = np.flatnonzero(solid & cut[:-1]), np.flatnonzero(solid & cut[1:]) + 1
        hashed = hashes(low, starts, ends)
        hashed[hashed == 0] = 1
        entries = self._find(hashed)
        if (entries < 0).any():
            if self.known > _PIECES or self.used > _IDS:
                self._forget()
                entries[:] = -1
            todo = np.flatnonzero(entries < 0)
            new, first = np.unique(hashed[todo], return_index=True)
            self._enter(new, self._learn(low, kind, starts[todo[first]], ends[todo[first]]))
            entries[todo] = self._find(hashed[todo])
        rows = np.searchsorted(starts, offsets)
        if end:
            entries = np.insert(entries, rows[1:], 0)
            rows = rows + np.arange(len(rows))
        counts = self.count[entries]
        stops = np.concatenate(([0], np.cumsum(counts)))
        ids = self.store[np.repeat(self.first[entries] - stops[:-1], counts) + np.arange(stops[-1])]
        return ids, stops[rows]

    @staticmethod
    def _kinds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes with Latin letters in lower case, and their kinds; a word with a byte of the last kind is all of it, and unchanged."""
        low, kind = _LOWER[data], _KIND[data]
        at = np.flatnonzero(data[:-1] == 0xC3)
        tail = data[at + 1]
        letter = (tail != 0x97) & (tail != 0xB7) & (tail >= 0x80) & (tail <= 0xBF)
        at, tail = at[letter], tail[letter]
        kind[at] = kind[at + 1] = _LETTER
        low[at[tail <= 0x9E] + 1] += 0x20
        odd = kind == _OTHER
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may begin the name of a special token
        if odd.any():
            solid = kind != _SPACE
            begin, end = solid.copy(), solid.copy()
            begin[1:] &= ~solid[:-1]
            end[:-1] &= ~solid[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            begin[inner] |= solid[inner]
            end[inner - 1] |= solid[inner - 1]
            starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
            word = np.unique(np.searchsorted(starts, np.flatnonzero(odd), "right") - 1)
            steps = np.zeros(len(data) + 1, np.int8)
            steps[starts[word]] += 1
            steps[ends[word]] -= 1
            odd = np.cumsum(steps[:-1], dtype=np.int8) > 0
            kind[odd] = _OTHER
            low[odd] = data[odd]
        return low, kind

    def _learn(self, low: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode distinct pieces and give their entries."""
        size = ends - starts
        out = np.empty(len(starts), np.int32)
        whole = (kind[starts] == _OTHER) | (size > _LONG)
        if whole.any():
            todo = np.flatnonzero(whole)
            found = self._library([low[p:q].tobytes().decode("utf-8", "replace") for p, q in zip(starts[todo], ends[todo])])
            out[todo] = self.known + np.arange(len(todo))
            self._put(np.concatenate(found), np.array([len(x) for x in found], np.int32))
        todo = np.flatnonzero(~whole)
        todo = todo[np.argsort(size[todo], kind="stable")]  # pieces of one length together: little padding
        for i in range(0, len(todo), 4096):
            some = todo[i : i + 4096]
            reach = starts[some][:, None] + np.arange(size[some[-1]])
            ids, counts = self.merger.ids(low[np.minimum(reach, len(low) - 1)], size[some])
            out[some] = self.known + np.arange(len(some))
            self._put(ids, counts)
        return out


@functools.lru_cache(maxsize=1)
def shared_encoder(path: str | None = None) -> Encoder:
    """The encoder of this process: tasks of one Python worker share its tables and words."""
    return Encoder(path)
