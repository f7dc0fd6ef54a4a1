"""Nearest words by forms that words of one distance share, with no list of pairs.

Two words lie within two edits if they share a form: with letters left out or replaced by a gap on either side, or
neighbours swapped on one. All that share a form are within a bound of each other, so only its most frequent
words can be among anyone's nearest: the first ``most`` others of a form are looked at, whatever its size. A task
holds the packed words of a few lengths and goes through hashed forms in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Hashes of forms that a task holds at once; slices that one task takes, one after the other; words that are merged at once.
HELD, TURNS, MERGED = 3_000_000, 4, 150_000

#: Numbers in a block of words, and words packed at once.
_BLOCK, _PIECE = 1 << 18, 500_000

_BASE = 0x9E3779B97F4A7C17
_BACK = pow(_BASE, -1, 1 << 64)
_SALT = 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_MASK = (1 << 64) - 1
_U = np.uint64

#: Which role gets which, within how many edits. E: the word; D, DD: one or two letters left out; X, XX, XD: a swap, two, and one with a letter left out.
_E, _D, _DD, _X, _XX, _XD = range(6)
_PLAIN = ((_D, _E, 1), (_E, _D, 1), (_X, _E, 1), (_DD, _E, 2), (_E, _DD, 2), (_D, _D, 2), (_XX, _E, 2), (_XD, _E, 2), (_E, _XD, 2))
#: S: a gap; SD: a gap and a letter left out; SX: a gap and a swap.
_S, _SD, _SX = range(3)
_GAP = ((_S, _S, 1), (_SD, _S, 2), (_S, _SD, 2), (_SX, _S, 2))


def planes(*arrays: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays)
    return pa.compress(raw, codec="zstd", asbytes=True)


def unplaned(packed: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(packed, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _salts(which: int, positions: np.ndarray) -> np.ndarray:
    return (positions.astype(np.uint64) + _U(1)) * _U(_SALT[which])


class _Words:
    """Hashes of words of one length: sums of letters' hashes times powers, so that a letter's loss or a swap is a few sums."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        n, self.length = codes.shape
        letters = _mixed(codes.astype(np.uint64) + _U(1))
        powers = np.array([pow(_BASE, k, 1 << 64) for k in range(self.length + 1)], np.uint64)
        self.ids = ids
        self.before = np.zeros((n, self.length + 1), np.uint64)
        np.cumsum(letters * powers[:-1], axis=1, out=self.before[:, 1:])
        self.whole = self.before[:, -1]
        self.swap = (letters[:, 1:] - letters[:, :-1]) * (powers[:-2] - powers[1:-1])
        self.swaps = codes[:, 1:] != codes[:, :-1]

    def without(self, i: int) -> np.ndarray:
        return self.before[:, i] + (self.whole - self.before[:, i + 1]) * _U(_BACK)

    def without_two(self, i: int) -> np.ndarray:
        """A column for each later letter that goes too."""
        middle = self.before[:, i + 1 : -1] - self.before[:, i + 1 : i + 2]
        return self.before[:, i : i + 1] + middle * _U(_BACK) + (self.whole[:, None] - self.before[:, i + 2 :]) * _U(_BACK * _BACK & _MASK)


def _blocks(words: tuple[np.ndarray, np.ndarray]) -> Iterator[_Words]:
    codes, ids = words
    step = max(1, _BLOCK // max(1, codes.shape[1]))
    for k in range(0, len(ids), step):
        yield _Words(codes[k : k + step], ids[k : k + step])


class _Entries:
    """Hashes of forms of a slice, with word and role; of those that could only meet others, the ones that may."""

    def __init__(self, turn: int, slices: int):
        self.turn, self.slices = turn, slices
        self.keys: list[np.ndarray] = []
        self.words: list[np.ndarray] = []
        self.roles: list[np.ndarray] = []
        self.table: np.ndarray | None = None
        self.n = 0

    def add(self, role: int, forms: np.ndarray, ids: np.ndarray, use: np.ndarray | None = None, only_met: bool = False) -> None:
        """``forms``: a row for each id, unmixed."""
        key = _mixed(forms)
        if self.slices > 1:
            own = (((key >> _U(32)) * _U(self.slices)) >> _U(32)) == _U(self.turn)
            use = own if use is None else own & use
        if use is None:
            key, ids = key.ravel(), np.repeat(ids, forms.size // max(1, len(ids)))
        else:
            at = np.nonzero(use)
            key, ids = key[at], ids[at[0]]
        if only_met:
            met = self.table[key & _U(len(self.table) - 1)]
            key, ids = key[met], ids[met]
        if len(key):
            self.keys.append(key)
            self.words.append(ids)
            self.roles.append(np.full(len(key), role, np.uint8))
            self.n += len(key)

    def close(self, role: int) -> None:
        """From now on forms may be kept by whether one of ``role`` is alike."""
        size = 1 << min(26, max(16, (8 * self.n).bit_length()))
        self.table = np.zeros(size, bool)
        for key, roles in zip(self.keys, self.roles, strict=True):
            if roles[0] == role:
                self.table[key & _U(size - 1)] = True

    def links(self, rules, reach: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Word, other and bound in one number each."""
        if not self.n:
            return
        key, word, role = np.concatenate(self.keys), np.concatenate(self.words), np.concatenate(self.roles)
        self.keys = self.words = self.roles = []
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        shared = ~new
        shared[:-1] |= ~new[1:]
        group = (np.cumsum(new) - 1)[shared].astype(np.uint64)
        order = order[shared]
        del key, new
        if not len(order):
            return
        group = np.cumsum(np.diff(group, prepend=group[:1]) > 0).astype(np.uint64)
        rows = np.unique(group << _U(34) | role[order].astype(np.uint64) << _U(31) | word[order].astype(np.uint64))
        del order, word, role
        part = rows >> _U(31)
        start = np.flatnonzero(np.diff(part, prepend=_U(_MASK)) != 0)
        size = np.diff(start, append=len(rows))
        of_role, of_group = part[start] & _U(7), (part[start] >> _U(3)).astype(np.int64)
        ids = (rows & _U((1 << 31) - 1)).astype(np.int64)
        n_groups = int(of_group[-1]) + 1
        segments = {}
        for r in {x for rule in rules for x in rule[:2]}:
            at = of_role == _U(r)
            segments[r] = of_group[at], start[at], size[at]
        for asks, gives, bound in rules:
            groups, first, n = segments[gives]
            if not len(groups) or not len(segments[asks][0]):
                continue
            of, count = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
            of[groups], count[groups] = first, np.minimum(n, most + 1)
            groups, first, n = segments[asks]
            use = count[groups] > (asks == gives)
            groups, first, n = groups[use], first[use], n[use]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            group, asking = np.repeat(groups, n), ids[at]
            use = reach[asking] >= bound
            group, asking = group[use], asking[use]
            for k in range(most + 1):
                use = count[group] > k
                group, asking = group[use], asking[use]
                if not len(asking):
                    break
                other = ids[of[group] + k]
                apart = other != asking
                yield asking[apart].astype(np.uint64) << _U(33) | other[apart].astype(np.uint64) << _U(2) | _U(bound)


def nearest(links: np.ndarray, most: int) -> np.ndarray:
    """Of numbers ``word << 33 | other << 2 | distance``, each word's nearest, least others first, with the least distance to each; in this order."""
    links = np.sort(links)
    if not len(links):
        return links
    new = np.ones(len(links), bool)
    new[1:] = (links[1:] >> _U(2)) != (links[:-1] >> _U(2))
    links = links[new]
    low = _U((1 << 31) - 1)
    links = np.sort((links >> _U(33)) << _U(33) | (links & _U(3)) << _U(31) | ((links >> _U(2)) & low))
    word = links >> _U(33)
    start = np.flatnonzero(np.diff(word, prepend=_U(_MASK)) != 0)
    place = np.arange(len(links)) - np.repeat(start, np.diff(start, append=len(links)))
    links = links[place < most]
    return (links >> _U(33)) << _U(33) | (links & low) << _U(2) | ((links >> _U(31)) & _U(3))


def _gapped_twice(words, turn: int, slices: int, reach: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Links of words of one length by forms with two gaps."""
    found = _Entries(turn, slices)
    for b in _blocks(words):
        for i in range(b.length - 1):
            found.add(_S, b.without_two(i) + _salts(1, np.array([i])) + _salts(2, np.arange(i + 1, b.length)), b.ids)
    yield from found.links(((_S, _S, 2),), reach, most)


def _others(of: dict, m: int, turn: int, slices: int, reach: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Links by all other forms of ``m`` letters."""
    plain, gap = _Entries(turn, slices), _Entries(turn, slices)
    same, longer, longest = (of.get(k) for k in (m, m + 1, m + 2))
    for b in _blocks(same) if same else ():
        plain.add(_E, b.whole[:, None], b.ids)
    plain.close(_E)
    for b in _blocks(longer) if longer else ():
        for i in range(m + 1):
            form = b.without(i)[:, None]
            plain.add(_D, form, b.ids)
            gap.add(_S, form + _salts(0, np.array([i])), b.ids)
    gap.close(_S)
    for b in _blocks(same) if same else ():
        plain.add(_X, b.whole[:, None] + b.swap, b.ids, b.swaps, True)
        for i in range(m - 3):
            plain.add(_XX, b.whole[:, None] + b.swap[:, i : i + 1] + b.swap[:, i + 2 :], b.ids, b.swaps[:, i : i + 1] & b.swaps[:, i + 2 :], True)
    for b in _blocks(longer) if longer else ():
        for i in range(m + 1):
            at = np.array([k for k in range(m) if k not in (i, i - 1)], int)
            if len(at):
                form = b.without(i)[:, None] + b.swap[:, at] * np.where(at > i, _U(_BACK), _U(1))
                plain.add(_XD, form, b.ids, b.swaps[:, at], True)
                gap.add(_SX, form + _salts(0, np.array([i])), b.ids, b.swaps[:, at], True)
    for b in _blocks(longest) if longest else ():
        for i in range(m + 1):
            form = b.without_two(i)
            plain.add(_DD, form, b.ids, None, True)
            gap.add(_SD, form + _salts(0, np.array([i])), b.ids, None, True)
            gap.add(_SD, form + _salts(0, np.arange(i, m + 1)), b.ids, None, True)
    yield from plain.links(_PLAIN, reach, most)
    yield from gap.links(_GAP, reach, most)


def plan(sizes: dict[int, int]) -> list[tuple[bool, int, int, int, int]]:
    """Tasks for so many words of each length: whether by two gaps, letters (of the words then, else of the forms), first and last slice, slices."""
    out = []
    for length in sorted({k - d for k in sizes for d in (0, 1, 2) if k >= d}):
        n, n1, n2 = (sizes.get(length + k, 0) for k in range(3))
        if n + n1 + n2 > 1:
            out.append((False, length, n + 3 * n1 * (length + 1) + n2 * (length + 2)))
        if n > 1 and length > 3:
            out.append((True, length, n * length * (length - 1) // 2))
    tasks = []
    for twice, length, held in out:
        slices = max(1, -(-held // HELD))
        tasks += [(twice, length, k, min(slices, k + TURNS), slices) for k in range(0, slices, TURNS)]
    return tasks


def packer(tasks):
    """Words and their ranks to the tasks that need them, by length."""
    wanted: dict[int, list[int]] = {}
    for k, (twice, length, *_) in enumerate(tasks):
        for x in (length,) if twice else (length, length + 1, length + 2):
            wanted.setdefault(x, []).append(k)

    def pack(words: list[str], ids: np.ndarray):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = []
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            if length in wanted:
                blob = pa.compress("".join([words[k] for k in at]).encode("utf-32-le"), codec="zstd", asbytes=True)
                rows += [(k, length, len(at), blob, planes(ids[at])) for k in wanted[length]]
        return pa.RecordBatch.from_pylist([dict(zip(("task", "length", "n", "words", "ids"), r, strict=True)) for r in rows], pa.schema([("task", pa.int64()), ("length", pa.int64()), ("n", pa.int64()), ("words", pa.binary()), ("ids", pa.binary())]))

    def run(batches):
        words, ids = [], []
        for batch in batches:
            words += batch.column(0).to_pylist()
            ids.append(batch.column(1).to_numpy().astype("<i8"))
            if len(words) >= _PIECE:
                yield pack(words, np.concatenate(ids))
                words, ids = [], []
        if words:
            yield pack(words, np.concatenate(ids))

    return run


def linker(tasks, most: int, buckets: int):
    """One task's links, as ranks, for each bucket of words."""

    def run(key, table):
        twice, length, first, last, slices = tasks[key[0].as_py()]
        parts: dict[int, list] = {}
        for row in table.to_pylist():
            codes = np.frombuffer(pa.decompress(row["words"], 4 * row["n"] * row["length"], codec="zstd", asbytes=True), "<u4")
            codes = codes.astype("<u2") if codes.max(initial=0) < 1 << 16 else codes
            parts.setdefault(row["length"], []).append((codes.reshape(row["n"], row["length"]), unplaned(row["ids"], row["n"], "<i8")[0]))
        ranks = np.sort(np.concatenate([i for of in parts.values() for _, i in of]))
        reach = np.ones(len(ranks), np.int8)
        words = {}
        for k, of in parts.items():
            ids = np.searchsorted(ranks, np.concatenate([i for _, i in of]))
            words[k] = np.concatenate([c for c, _ in of]), ids
            if k > 3:
                reach[ids] = 2
        del parts
        best, held, n = np.zeros(0, np.uint64), [], 0
        for turn in range(first, last):
            for found in _gapped_twice(words[length], turn, slices, reach, most) if twice else _others(words, length, turn, slices, reach, most):
                held.append(found)
                n += len(found)
                if n > HELD:
                    best, held, n = nearest(np.concatenate([best, *held]), most), [], 0
        best = nearest(np.concatenate([best, *held]), most)
        word, other, distance = ranks[(best >> _U(33)).astype(np.int64)], ranks[((best >> _U(2)) & _U((1 << 31) - 1)).astype(np.int64)], (best & _U(3)).astype(np.uint8)
        bucket = word % buckets
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = [(b, int(ends[b + 1] - ends[b]), order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b + 1] > ends[b]]
        return pa.table({
            "bucket": pa.array([b for b, _, _ in rows], pa.int64()), "n": pa.array([n for _, n, _ in rows], pa.int64()),
            "links": pa.array([planes(word[at].astype("<i8"), other[at].astype("<i8"), distance[at]) for _, _, at in rows], pa.binary()),
        })

    return run


def merger(most: int, buckets: int):
    """The nearest of a bucket's words from all tasks' links."""

    def run(table):
        held = []
        for row in table.to_pylist():
            word, other, distance = unplaned(row["links"], row["n"], "<i8", "<i8", "u1")
            held.append((word // buckets).astype(np.uint64) << _U(33) | other.astype(np.uint64) << _U(2) | distance.astype(np.uint64))
        best = nearest(np.concatenate(held), most)
        word = (best >> _U(33)).astype(np.int64)
        start = np.flatnonzero(np.diff(word, prepend=-1) != 0)
        place = np.arange(len(best)) - np.repeat(start, np.diff(start, append=len(best)))
        return pa.table({
            "w": pa.array(word * buckets + table["bucket"][0].as_py()), "o": pa.array(((best >> _U(2)) & _U((1 << 31) - 1)).astype(np.int64)),
            "distance": pa.array((best & _U(3)).astype(np.int32)), "pick": pa.array((place + 1).astype(np.int32)),
        })

    return run
