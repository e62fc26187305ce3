"""Keys that texts within a few insertions and deletions share, as numpy over Arrow batches.

A text of length n that differs from a longer one by at most M insertions and deletions is cut
into M // 2 + 1 parts, so that one part differs by at most one change. Where the part is unchanged
the longer text holds it; where it gained a character, the longer text holds it with one more;
where it lost one, the part less a character stands in the longer text. The places to look at
follow from the changes left: the first part is a prefix of both texts, the last a suffix, and
a middle part counts only if neither of them does, which leaves it few places.

Where texts are cut decides how many others share a key, never what is found: every cut is right.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# More changes need more parts, and each more places to look at; longer texts more keys of a part less a character.
MOST_CHANGES = 7
MOST_CHARS = 512
# Characters of texts whose keys are made at once.
BATCH_CHARS = 1 << 19
# What a key is of: a part as it is, or less a character.
WHOLE, LESS = 0, 1
SCHEMA = "node long, n int, m long, key long"

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Matching:
    """Similarity above, or from, a threshold, and where texts are cut: starts of all parts but the last, and its width, by their number."""

    threshold: float
    strict: bool
    cuts: dict = field(default_factory=dict, hash=False, compare=False)

    def changes(self, a: int, b: int) -> int:
        """Most insertions plus deletions between matches of lengths a and b >= a; below b - a if there are none."""
        most = floor((1 - self.threshold / 100) * (a + b) + 1e-9)
        if self.strict and a + b:
            most = min(most, ceil((a + b) * (100 - Fraction(self.threshold)) / 100) - 1)
        return most - (most - (b - a)) % 2

    def longest(self) -> int:
        """Longest text that is cut: no match of it, or of a shorter one, has more than MOST_CHANGES."""
        share = self.threshold / 100
        n = MOST_CHARS
        while floor(n * (2 - 2 * share) / share + 1e-9) > MOST_CHANGES:
            n -= 1
        return n

    def ends(self, parts: int, n: int) -> list[int]:
        """Where the parts of a text of length n begin, and n."""
        if parts in self.cuts:
            starts, last = self.cuts[parts]
            ends = [*starts, n - last, n] if parts > 1 else [0, n]
            if all(x < y for x, y in zip(ends, ends[1:])):
                return ends
        return [j * n // parts for j in range(parts)] + [n]

    def index_places(self, n: int) -> list[tuple]:
        """(parts, part, start, end, whether it may lose a character) of a text as the shorter one, or as long."""
        found, b = {}, n
        while (most := self.changes(n, b)) >= b - n:
            parts = most // 2 + 1
            ends = self.ends(parts, n)
            for j, _, gained in _shifts(most, b - n, parts):
                at = parts, j, ends[j], ends[j + 1]
                found[at] = found.get(at, False) or gained < 0
            b += 1
        return [(*at, less) for at, less in sorted(found.items())]

    def probe_places(self, n: int, longest: int) -> list[tuple]:
        """(parts, part, start, end, characters gained) in a text as the longer one, or as long."""
        found, a = set(), n
        while a >= 0 and (most := self.changes(a, n)) >= n - a:
            if a <= longest:
                parts = most // 2 + 1
                ends = self.ends(parts, a)
                for j, shift, gained in _shifts(most, n - a, parts):
                    start, end = ends[j] + shift, ends[j + 1] + shift + gained
                    if 0 <= start <= end <= n:
                        found.add((parts, j, start, end, gained))
            a -= 1
        return sorted(found)


def _shifts(most: int, longer: int, parts: int) -> tuple:
    """(part, shift, characters gained) of a part with at most one change, if earlier parts and the last one have two or more."""
    least = lambda n, at_least: max(abs(n), at_least) + (max(abs(n), at_least) - n) % 2
    found = []
    for j in range(parts):
        first, last = j == 0, j == parts - 1
        for shift in [0] if first else range(-most, most + 1):
            for gained in (-1, 0, 1):
                rest = longer - shift - gained
                if last and rest:
                    continue
                before = 0 if first else least(shift, 2 if last else 2 * j)
                after = 0 if last else least(rest, 0 if first else 2)
                if before + abs(gained) + after <= most:
                    found.append((j, shift, gained))
    return tuple(found)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    if n:
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(_BACK)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray, seed: np.ndarray, tag: tuple) -> np.ndarray:
    parts, j, what, width = tag
    z = h + seed + np.uint64(((((parts << 8 | j) << 1 | what) << 16 | width) + 1) * _BASE & (1 << 64) - 1)
    for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z ^= z >> np.uint64(by)
        z *= np.uint64(factor)
    z ^= z >> np.uint64(31)
    return z


def _sums(texts: np.ndarray) -> np.ndarray:
    """Sums of the first characters of each text, of which hashes of its substrings are differences."""
    n = texts.shape[1]
    sums = np.zeros((len(texts), n + 1), np.uint64)
    np.cumsum((texts + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * _powers(n)[0][:n], axis=1, out=sums[:, 1:])
    return sums


def _whole(sums: np.ndarray, start: int, end: int) -> np.ndarray:
    return (sums[:, end] - sums[:, start]) * _powers(start)[1][start]


def _less(texts: np.ndarray, sums: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of a part of each text less each of its characters, one for those of a run of equal ones."""
    some = sums[:, start:end] - sums[:, start, None] + (sums[:, end, None] - sums[:, start + 1:end + 1]) * np.uint64(_BACK)
    own = np.ones(some.shape, bool)
    own[:, :-1] = texts[:, start:end - 1] != texts[:, start + 1:end]
    row, at = np.nonzero(own)
    return row, some[row, at] * _powers(start)[1][start]


def _of_length(texts: np.ndarray, groups: np.ndarray, places: list[tuple], kind: str):
    """(row, key, whether it is to be held against a bitmap) for each place in texts of one length."""
    sums = _sums(texts)
    rows = np.arange(len(texts))
    for parts, j, start, end, how in places:
        width = end - start
        if kind in ("index", "some"):
            yield rows, _mixed(_whole(sums, start, end), groups, (parts, j, WHOLE, width)), kind == "some"
            if how and width:
                row, h = _less(texts, sums, start, end)
                yield row, _mixed(h, groups[row], (parts, j, LESS, width - 1)), True
        elif how < 0:
            yield rows, _mixed(_whole(sums, start, end), groups, (parts, j, LESS, width)), kind == "probe"
        elif kind == "probe" and how == 0:
            yield rows, _mixed(_whole(sums, start, end), groups, (parts, j, WHOLE, width)), True
        elif kind == "probe":
            row, h = _less(texts, sums, start, end)
            yield row, _mixed(h, groups[row], (parts, j, WHOLE, width - 1)), True


def key_maker(matching: Matching, longest: int, kind: str, held=None):
    """Function for ``mapInArrow`` from (node, g, txt, n, m) to SCHEMA, g being the hash of the group.

    ``kind`` is probe, ends (the keys of a probe that parts less a character are looked up by), index, or some.
    With a bitmap, a broadcast array of words, keys go unless their bit is set; whole parts of an index stay all.
    """
    def run(batches):
        words = None if held is None else held.value
        plans: dict[int, list] = {}
        for batch in batches:
            n, groups = batch.column("n").to_numpy(), batch.column("g").to_numpy().view(np.uint64)
            column = batch.column("txt")
            for length in np.unique(n):
                length = int(length)
                if length not in plans:
                    plans[length] = matching.index_places(length) if kind in ("index", "some") else matching.probe_places(length, longest)
                same = np.flatnonzero(n == length)
                step = max(1, BATCH_CHARS // max(length, 1))
                for i in range(0, len(same) if plans[length] else 0, step):
                    some = same[i:i + step]
                    raw = "".join(column.take(pa.array(some)).to_pylist()).encode("utf-32-le", "surrogatepass")
                    texts = np.frombuffer(raw, np.uint32).astype(np.uint64).reshape(len(some), length)
                    rows, keys = [], []
                    for row, key, asked in _of_length(texts, groups[some], plans[length], kind):
                        if asked and words is not None:
                            bit = key & np.uint64(64 * len(words) - 1)
                            hit = (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)
                            row, key = row[hit], key[hit]
                        rows.append(row)
                        keys.append(key)
                    if not rows:
                        continue
                    row = pa.array(some[np.concatenate(rows)])
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(row) for c in ("node", "n", "m")], pa.array(np.concatenate(keys).view(np.int64))],
                        names=["node", "n", "m", "key"])
    return run


def choose_cuts(texts: list[str], matching: Matching) -> dict[int, tuple]:
    """Cuts with few pairs of the given texts that share a part, found by moving one cut at a time."""
    by_parts: dict[int, dict[int, list[str]]] = {}
    for t in texts:
        for parts in {p for p, *_ in matching.index_places(len(t))}:
            by_parts.setdefault(parts, {}).setdefault(len(t), []).append(t)
    cuts = {}
    for parts, found in by_parts.items():
        if parts == 1:
            continue
        sums = {n: _sums(np.frombuffer("".join(ts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(ts), n))
                for n, ts in found.items()}
        shortest = min(sums)
        known: dict = {}

        def shared(j: int, cut: tuple) -> int:
            starts, last = cut
            at = (starts[j] if j < parts - 1 else -last, starts[j + 1] if j < parts - 2 else -last if j == parts - 2 else 0)
            if at not in known:
                keys = np.concatenate([_whole(s, at[0] % n if at[0] < 0 else at[0], n + at[1] if at[1] <= 0 else at[1]) + np.uint64(n if at[0] >= 0 >= at[1] else 0)
                                       for n, s in sums.items()])
                keys.sort()
                times = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))).astype(float)
                known[at] = float((times * (times - 1)).sum())
            return known[at]

        def cost(cut: tuple) -> float:
            return sum(shared(j, cut) for j in range(parts))

        even = [j * shortest // parts for j in range(parts)] + [shortest]
        best = (tuple(even[:-2]), even[-1] - even[-2])
        moved = True
        while moved:
            moved = False
            for j in range(1, parts):
                starts, last = best
                ends = [*starts, shortest - last, shortest]
                for at in range(ends[j - 1] + 1, ends[j + 1]):
                    new = (starts, shortest - at) if j == parts - 1 else ((*starts[:j], at, *starts[j + 1:]), last)
                    if cost(new) < cost(best):
                        best, moved = new, True
        cuts[parts] = best
    return cuts
