"""Numbers of the words of texts, looked up for whole batches of texts in numpy.

A word is what stands between ASCII white space. Words of at most sixteen bytes are two
eight-byte numbers and found by open addressing, which compares them whole; longer ones, and
those that hold a zero byte, are found in a dict.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first k bytes
_PADDING = bytes(16)
SHORT = 16


class Numbered(NamedTuple):
    numbers: np.ndarray  # of the words of all texts, one behind the other
    counts: np.ndarray  # words of each text
    kept: np.ndarray | None  # if words were forgotten, the old numbers of those that now come first
    first: int  # the number of the first new word
    new: list[bytes]
    data: bytes  # a line break before each text, and one behind the last
    starts: np.ndarray  # of the words, there
    ends: np.ndarray


class WordNumbers:
    """Consecutive numbers for words.

    Once more than ``limit`` would be known, those are forgotten that were not met again
    since they were numbered or last kept; if the others are too many still, all of them.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.size = 0
        self.long: dict[bytes, int] = {}
        self.keys = np.zeros((0, 2), np.uint64)  # of the short words
        self.key_numbers = np.zeros(0, np.int32)
        self.met_again = np.zeros(0, bool)
        self._lay_out(12)

    def _forget(self, room: int) -> np.ndarray:
        """The old numbers of what is kept, in the order of their new ones."""
        kept = np.flatnonzero(self.met_again)
        if len(kept) + room > self.limit:
            kept = kept[:0]
        place = np.full(self.size, -1, np.int32)
        place[kept] = np.arange(len(kept))
        self.size = len(kept)
        self.long = {word: int(place[k]) for word, k in self.long.items() if place[k] >= 0}
        moved = place[self.key_numbers]
        self.keys, self.key_numbers = self.keys[moved >= 0], moved[moved >= 0]
        self.met_again = np.zeros(self.size, bool)
        self._lay_out(max(12, (3 * len(self.keys)).bit_length()))
        return kept

    def _lay_out(self, bits: int) -> None:
        self.bits = bits
        self.slot_keys = np.zeros((1 << bits, 2), np.uint64)
        self.slot_numbers = np.full(1 << bits, -1, np.int32)
        self._place(self.keys, self.key_numbers)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x165667B19E3779F9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Put different keys that are not there into free slots."""
        slots, waiting = self._slots(keys), np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = np.flatnonzero(self.slot_numbers[at] < 0)
            placed = free[np.unique(at[free], return_index=True)[1]]
            self.slot_keys[at[placed]] = keys[waiting[placed]]
            self.slot_numbers[at[placed]] = numbers[waiting[placed]]
            waiting = np.delete(waiting, placed)
            slots[waiting] = (slots[waiting] + 1) & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of short words, -1 for those that are not known."""
        slots = self._slots(keys)
        out = self.slot_numbers[slots]
        there = self.slot_keys[slots]
        other = (there[:, 0] != keys[:, 0]) | (there[:, 1] != keys[:, 1])
        open_ = np.flatnonzero(other & (out >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at, wanted = slots[open_], keys[open_]
            out[open_] = numbers = self.slot_numbers[at]
            there = self.slot_keys[at]
            other = (there[:, 0] != wanted[:, 0]) | (there[:, 1] != wanted[:, 1])
            open_ = open_[other & (numbers >= 0)]
        return out

    def _add(self, new: list[bytes]) -> None:
        """Numbers for different words, those of ``SHORT`` bytes to the slots."""
        short = [k for k, word in enumerate(new) if _is_short(word)]
        self.long.update(
            (word, self.size + k) for k, word in enumerate(new) if not _is_short(word)
        )
        data = b"".join(new[k].ljust(SHORT, b"\0") for k in short)
        keys = np.frombuffer(data, "<u8").astype(np.uint64).reshape(-1, 2)
        numbers = (np.array(short, np.int64) + self.size).astype(np.int32)
        self.size += len(new)
        self.met_again = np.concatenate((self.met_again, np.zeros(len(new), bool)))
        self.keys = np.concatenate((self.keys, keys))
        self.key_numbers = np.concatenate((self.key_numbers, numbers))
        bits = max(self.bits, (3 * len(self.keys)).bit_length())
        if bits > self.bits:
            self._lay_out(bits)
        else:
            self._place(keys, numbers)

    def of(self, texts: list[bytes], originals: list[bytes] | None = None) -> Numbered:
        """The words of the texts.

        ``originals``: texts of the same lengths; words that are not ASCII alone are taken
        from these.
        """
        data = b"\n".join([b"", *texts, _PADDING])
        size = len(data) - len(_PADDING)  # white space at both ends
        codes = np.frombuffer(data, np.uint8)[:size]
        space = (codes == 32) | (codes - np.uint8(9) < 5)
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        keys = _keys(data, starts, ends)
        other = np.zeros(0, np.int64)  # words taken from the originals
        if originals is not None and (codes >= 128).any():
            source = b"\n".join([b"", *originals, _PADDING])
            high = np.flatnonzero(codes >= 128)
            other = np.unique(np.searchsorted(starts, high, "right") - 1)
            keys[other] = _keys(source, starts[other], ends[other])
        long = ends - starts > SHORT
        if data.find(0, 0, size) >= 0:
            long[np.searchsorted(starts, np.flatnonzero(codes == 0), "right") - 1] = True

        from_source = np.zeros(len(starts), bool)
        from_source[other] = True

        def words(at: np.ndarray) -> list[bytes]:
            spans = zip(starts[at].tolist(), ends[at].tolist(), from_source[at].tolist(), strict=True)
            return [(source if other else data)[start:end] for start, end, other in spans]

        def look_up(at: np.ndarray) -> np.ndarray:
            numbers = self._find(keys[at]).astype(np.int64)
            some = np.flatnonzero(long[at])
            numbers[some] = [self.long.get(word, -1) for word in words(at[some])]
            return numbers

        numbers = look_up(np.arange(len(starts)))
        missing = np.flatnonzero(numbers < 0)
        new, kept = list(dict.fromkeys(words(missing))), None
        self.met_again[numbers[numbers >= 0]] = True
        if new and self.size + len(new) > self.limit:
            kept = self._forget(len(new))
            if not len(kept):  # also those of these texts
                missing = np.arange(len(starts))
                new = list(dict.fromkeys(words(missing)))
            else:
                place = np.full(int(numbers.max()) + 1, -1, np.int64)
                place[kept[kept < len(place)]] = np.flatnonzero(kept < len(place))
                numbers[numbers >= 0] = place[numbers[numbers >= 0]]
        first = self.size
        if new:
            self._add(new)
            numbers[missing] = look_up(missing)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        before = np.searchsorted(starts, text_ends)
        counts = np.diff(before, prepend=0)
        return Numbered(numbers, counts, kept, first, new, data[:size], starts, ends)


def _is_short(word: bytes) -> bool:
    return len(word) <= SHORT and 0 not in word


def _keys(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first sixteen bytes of words as two numbers, zero past their ends."""
    numbers = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))  # at every byte
    lengths = np.minimum(ends - starts, SHORT)
    out = np.empty((len(starts), 2), np.uint64)
    out[:, 0] = numbers[starts] & _MASKS[np.minimum(lengths, 8)]
    out[:, 1] = numbers[np.minimum(starts + 8, len(numbers) - 1)] & _MASKS[np.maximum(lengths - 8, 0)]
    return out


def behind_one_another(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` of these starts and lengths."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]
