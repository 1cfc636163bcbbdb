"""Weighted acyclic automata that hold the counts of all phrases of up to three words.

A path from the root spells a phrase and the weight of its last arc is the phrase's count, so the arcs
on the way are the counts of the phrase's beginnings. Phrases come in sorted, hence the states of one
depth are complete in order, and states with the same arcs (words, weights, targets) are kept once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

SHIFT = np.int64(32)
LOW = np.int64((1 << 32) - 1)


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, … (sizes[i] of them) of all groups one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, sorted, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


@dataclass
class Phrases:
    """Counts of phrases over a sorted word list, depth by depth.

    ``one`` holds word numbers, ``two`` pairs (word << 32 | word), ``three`` (place in ``two`` << 32 |
    word); each is sorted and without repeats. A pair may lack its word in ``one``; a triple has its pair.
    """

    words: pa.BinaryArray
    one: np.ndarray
    one_n: np.ndarray
    two: np.ndarray
    two_n: np.ndarray
    three: np.ndarray
    three_n: np.ndarray

    def __len__(self) -> int:
        return len(self.one) + len(self.two) + len(self.three)

    def at_least(self, least: int) -> Phrases:
        """Phrases with that count; a phrase's beginnings have no smaller one."""
        keep1, keep2, keep3 = (n >= least for n in (self.one_n, self.two_n, self.three_n))
        moved = np.cumsum(keep2) - 1
        three = self.three[keep3]
        return Phrases(
            self.words, self.one[keep1], self.one_n[keep1], self.two[keep2], self.two_n[keep2],
            moved[three >> SHIFT] << SHIFT | three & LOW, self.three_n[keep3],
        )

    def part(self, low: tuple[int, int], high: tuple[int, int]) -> Phrases:
        """Phrases whose first two words lie in [low, high) as numbers; a single word has the second −1."""
        a, b = (np.searchsorted(self.one, w + (second >= 0)) for w, second in (low, high))
        c, d = (np.searchsorted(self.two, (np.int64(w) << SHIFT) + max(second, 0)) for w, second in (low, high))
        e, f = (np.searchsorted(self.three, np.int64(place) << SHIFT) for place in (c, d))
        one, two, three = self.one[a:b], self.two[c:d], self.three[e:f]
        used = np.unique(np.concatenate([one, two >> SHIFT, two & LOW, three & LOW]))
        number = lambda ids: np.searchsorted(used, ids)
        return Phrases(
            self.words.take(pa.array(used)), number(one), self.one_n[a:b],
            number(two >> SHIFT) << SHIFT | number(two & LOW), self.two_n[c:d],
            (three >> SHIFT) - c << SHIFT | number(three & LOW), self.three_n[e:f],
        )


def union(parts: list[Phrases]) -> Phrases:
    """All phrases of the parts, weights of equal ones added."""
    if len(parts) == 1:
        return parts[0]
    every = pa.concat_arrays([p.words for p in parts]).dictionary_encode()
    order = pc.array_sort_indices(every.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    numbers = rank[every.indices.to_numpy()] if len(every) else rank
    ends = np.cumsum([len(p.words) for p in parts])
    of_part = [numbers[e - len(p.words) : e] for e, p in zip(ends, parts)]
    one, one_n = summed(
        np.concatenate([w[p.one] for w, p in zip(of_part, parts)]), np.concatenate([p.one_n for p in parts])
    )
    pairs = [w[p.two >> SHIFT] << SHIFT | w[p.two & LOW] for w, p in zip(of_part, parts)]
    two, two_n = summed(np.concatenate(pairs), np.concatenate([p.two_n for p in parts]))
    three, three_n = summed(
        np.concatenate([
            np.searchsorted(two, pair)[p.three >> SHIFT] << SHIFT | w[p.three & LOW]
            for w, p, pair in zip(of_part, parts, pairs)
        ]),
        np.concatenate([p.three_n for p in parts]),
    )
    return Phrases(every.dictionary.take(pa.array(order)), one, one_n, two, two_n, three, three_n)


def _register(sizes: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(state of each group, groups that stand for a state): groups of equal arcs become one state.

    Group i has the next ``sizes[i]`` rows of the columns. Hashes bring equal groups together; a group
    joins the one before it only if all its rows are the same.
    """
    count = len(sizes)
    if not count:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    mixed = (np.arange(len(columns[0])) - np.repeat(starts, sizes)).astype(np.uint64)
    for column in columns:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    before = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
    digest = before[starts + sizes] - before[starts]
    order = np.lexsort((digest, sizes))
    same = np.zeros(count, dtype=bool)
    same[1:] = (sizes[order][1:] == sizes[order][:-1]) & (digest[order][1:] == digest[order][:-1])
    places = gathered(starts[order], sizes[order])
    earlier = gathered(np.where(same, np.concatenate([[0], starts[order][:-1]]), starts[order]), sizes[order])
    differs = np.zeros(len(places), dtype=bool)
    for column in columns:
        differs |= column[places] != column[earlier]
    wrong = np.concatenate([[0], np.cumsum(differs)])
    ends = np.cumsum(sizes[order])
    same &= wrong[ends] == wrong[ends - sizes[order]]
    stands = np.flatnonzero(~same)
    state = np.empty(count, dtype=np.int64)
    state[order] = np.cumsum(~same) - 1
    return state, order[stands]


@dataclass
class Transducer:
    """The automaton: arcs of the root, of the states behind one word, and of those behind two."""

    words: pa.BinaryArray
    root: tuple[np.ndarray, np.ndarray, np.ndarray]  # word, weight, target
    first2: np.ndarray
    arcs2: tuple[np.ndarray, np.ndarray, np.ndarray]
    first3: np.ndarray
    arcs3: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(found: Phrases) -> Transducer:
        """Built from sorted phrases, the deepest states first."""
        sizes3 = np.bincount(found.three >> SHIFT, minlength=len(found.two)).astype(np.int64)
        label3 = found.three & LOW
        state3, stands3 = _register(sizes3, [label3, found.three_n])
        kept = gathered((np.cumsum(sizes3) - sizes3)[stands3], sizes3[stands3])
        label1 = np.union1d(found.one, found.two >> SHIFT)
        weight1 = np.zeros(len(label1), dtype=np.int64)
        weight1[np.searchsorted(label1, found.one)] = found.one_n
        sizes2 = np.bincount(np.searchsorted(label1, found.two >> SHIFT), minlength=len(label1)).astype(np.int64)
        label2 = found.two & LOW
        state2, stands2 = _register(sizes2, [label2, found.two_n, state3])
        arcs = gathered((np.cumsum(sizes2) - sizes2)[stands2], sizes2[stands2])
        ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)])
        return Transducer(
            found.words, (label1, weight1, state2),
            ends(sizes2[stands2]), (label2[arcs], found.two_n[arcs], state3[arcs]),
            ends(sizes3[stands3]), (label3[kept], found.three_n[kept]),
        )

    def phrases(self) -> Phrases:
        """All paths from the root, sorted."""
        label1, weight1, target1 = self.root
        sizes2 = np.diff(self.first2)[target1] if len(target1) else np.zeros(0, dtype=np.int64)
        arcs = gathered(self.first2[target1], sizes2) if len(target1) else np.zeros(0, dtype=np.int64)
        label2, weight2, target2 = (column[arcs] for column in self.arcs2)
        two = np.repeat(label1, sizes2) << SHIFT | label2
        sizes3 = np.diff(self.first3)[target2] if len(target2) else np.zeros(0, dtype=np.int64)
        arcs = gathered(self.first3[target2], sizes3) if len(target2) else np.zeros(0, dtype=np.int64)
        label3, weight3 = (column[arcs] for column in self.arcs3)
        three = np.repeat(np.arange(len(two)), sizes3) << SHIFT | label3
        here = weight1 > 0
        return Phrases(self.words, label1[here], weight1[here], two, weight2, three, weight3)

    def _steps(self):
        """For each word number its root arc, and for each (state, word) its arc, by search."""
        label1, _, target1 = self.root
        keys2 = np.repeat(np.arange(len(self.first2) - 1), np.diff(self.first2)) << SHIFT | self.arcs2[0]
        return label1, target1, keys2

    def weights(self, first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
        """Composition with a list of phrases of one or two words: their counts, 0 where none."""
        label1, target1, keys2 = self._steps()
        if not len(label1):
            return np.zeros(len(first), dtype=np.int64)
        at = np.minimum(np.searchsorted(label1, first), len(label1) - 1)
        hit = label1[at] == first
        if second is None:
            return np.where(hit, self.root[1][at], 0)
        if not len(keys2):
            return np.zeros(len(first), dtype=np.int64)
        wanted = target1[at] << SHIFT | second
        arc = np.minimum(np.searchsorted(keys2, wanted), len(keys2) - 1)
        return np.where(hit & (keys2[arc] == wanted), self.arcs2[1][arc], 0)

    def heaviest(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The largest weight of an arc that goes on behind the two words, 0 where none does."""
        label1, target1, keys2 = self._steps()
        most = np.zeros(len(self.first3) - 1, dtype=np.int64)
        filled = np.flatnonzero(np.diff(self.first3))
        if len(filled):
            most[filled] = np.maximum.reduceat(self.arcs3[1], self.first3[filled])
        wanted = target1[np.searchsorted(label1, first)] << SHIFT | second
        return most[self.arcs2[2][np.searchsorted(keys2, wanted)]]

    def to_bytes(self) -> bytes:
        names = pa.BinaryArray.from_pandas(self.words) if not isinstance(self.words, pa.BinaryArray) else self.words
        lengths = pc.binary_length(names).to_numpy(zero_copy_only=False).astype("<u4")
        columns = [lengths, *self.root, self.first2, *self.arcs2, self.first3, *self.arcs3]
        head = struct.pack(f"<{len(columns)}Q", *map(len, columns))
        wide = [2, 6, 10]  # weights need eight bytes
        body = [np.ascontiguousarray(c, dtype="<u8" if k in wide else "<u4").tobytes() for k, c in enumerate(columns)]
        text = b"".join(names.to_pylist())
        return zstandard.ZstdCompressor(level=1).compress(head + b"".join(body) + text)

    @staticmethod
    def from_bytes(data: bytes) -> Transducer:
        raw = zstandard.ZstdDecompressor().decompress(data)
        sizes = struct.unpack_from("<11Q", raw)
        at, columns = 88, []
        for k, size in enumerate(sizes):
            kind = "<u8" if k in (2, 6, 10) else "<u4"
            columns.append(np.frombuffer(raw, kind, size, at).astype(np.int64))
            at += size * (8 if k in (2, 6, 10) else 4)
        offsets = np.concatenate([[0], np.cumsum(columns[0])]).astype(np.int32)
        words = pa.BinaryArray.from_buffers(
            pa.binary(), len(columns[0]), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at:])]
        )
        label1, weight1, target1, first2, label2, weight2, target2, first3, label3, weight3 = columns[1:]
        return Transducer(words, (label1, weight1, target1), first2, (label2, weight2, target2), first3, (label3, weight3))
