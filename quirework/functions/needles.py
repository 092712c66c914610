"""Many needles of one length: windows of the text are looked up by hash, whole batches of texts at once.

The cost of a text does not go with the number of needles, as it does not with an automaton, but a table of a million needles
takes about 20 MB instead of a gigabyte, and no character is a step of Python.
"""

import numpy as np
import pyarrow as pa

from .folding import fold_map

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HALF = np.uint64(32)
# Folded characters that are looked up at once.
BATCH_CHARS = 1 << 21


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _window_hashes(codes, length, factor):
    """Hash of the ``length`` characters from each position on (as far as they fit), by doubling windows."""
    part, power, size = codes.astype(np.uint64), factor, 1
    out, done = None, 0
    while True:
        if length & size:
            if out is None:
                out = part
            else:
                n = len(codes) - done - size + 1
                out = out[:n] * np.uint64(power) + part[done:done + n]
            done += size
        size *= 2
        if size > length:
            break
        n = len(part) - size // 2
        part = part[:n] * np.uint64(power) + part[size // 2:size // 2 + n]
        power = power * power % (1 << 64)
    out = out ^ (out >> _HALF)
    out = out * _MIX
    return out ^ (out >> _HALF)


class NeedleTable:
    """Distinct folded needles of one length, in the order of their hashes."""

    def __init__(self, needles: list[str], length: int):
        codes = codes_of("".join(needles)).reshape(-1, length)
        factor = 0x9E3779B97F4A7C15
        while True:  # two needles of one hash: another factor
            hashes = _window_hashes(codes.ravel(), length, factor)[::length]
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            if len(hashes) < 2 or (hashes[1:] != hashes[:-1]).all():
                break
            factor = (factor * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1
        self.length, self.factor, self.hashes = length, factor, hashes
        codes = codes[order]
        top = int(codes.max())
        self.codes = codes.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)
        # One bit or more of sixteen says that a hash may be there.
        bits = max(16, int(16 * len(hashes)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << (bits - 3), np.uint8)
        place = hashes >> self.shift
        np.bitwise_or.at(self.maybe, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        self.bordered = np.full(len(hashes), length > 64)  # may overlap itself
        for k in range(1, length if length <= 64 else 1):
            self.bordered |= (codes[:, :k] == codes[:, length - k:]).all(1)
        self.needles = pa.array(needles, pa.string()).take(pa.array(order))

    def lookup(self, codes, ends):
        """(position, number of the needle) of all places of needles; ``ends`` is the end of the text of each position."""
        if len(codes) < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = _window_hashes(codes, self.length, self.factor)
        place = found >> self.shift
        maybe = self.maybe[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)
        at = np.flatnonzero(maybe)
        at = at[at + self.length <= ends[at]]
        found, which = np.unique(found[at], return_inverse=True)
        number = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        known = self.hashes[number] == found
        keep = known[which]
        at, number = at[keep], number[which[keep]]
        same = np.ones(len(at), bool)
        for k in range(self.length):
            same &= codes[at + k] == self.codes[number, k]
        return at[same], number[same]


def _apart(at, row, number, length, bordered, limit):
    """Hits kept of those in the order of positions: per text and needle without overlaps, the first ``limit`` ones."""
    checked = np.flatnonzero(bordered[number]) if limit is None else np.arange(len(at))
    keep = np.ones(len(at), bool)
    by = checked[np.lexsort((at[checked], number[checked], row[checked]))]
    end = count = 0
    last = None
    for i, key, start in zip(by.tolist(), zip(row[by].tolist(), number[by].tolist()), at[by].tolist()):
        if key != last:
            last, end, count = key, 0, 0
        if start < end or limit is not None and count >= limit:
            keep[i] = False
        else:
            end, count = start + length, count + 1
    return keep


def find_in_texts(tables: list[NeedleTable], texts, limit=None):
    """Hits of ``texts`` (text or None) as ``folding.find_all`` tells them: yields (table, text, needle, start, length) as arrays."""

    def flush(rows, folded, origins):
        sizes = np.array([len(f) for f in folded])
        codes = codes_of("".join(folded))
        row = np.repeat(np.arange(len(folded)), sizes)
        starts = np.cumsum(sizes) - sizes
        ends = np.repeat(starts + sizes, sizes)
        origin = whole = None
        if any(o is not None for o in origins):
            origin = np.concatenate([np.arange(n) if o is None else o for o, n in zip(origins, sizes)])
            whole = np.ones(len(codes) + 1, bool)  # a character of the text begins here
            whole[1:-1] = (origin[1:] != origin[:-1]) | (row[1:] != row[:-1])
        rows = np.array(rows)
        for table in tables:
            at, number = table.lookup(codes, ends)
            if whole is not None:
                keep = whole[at] & whole[at + table.length]
                at, number = at[keep], number[keep]
            keep = _apart(at, row[at], number, table.length, table.bordered, limit)
            at, number = at[keep], number[keep]
            if not len(at):
                continue
            if origin is None:
                first, size = at - starts[row[at]], np.full(len(at), table.length)
            else:
                first = origin[at]
                size = origin[at + table.length - 1] + 1 - first
            yield table, rows[row[at]], number, first, size

    rows, folded, origins, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        f, origin = fold_map(text)
        rows.append(i)
        folded.append(f)
        origins.append(origin)
        size += len(f)
        if size >= BATCH_CHARS:
            yield from flush(rows, folded, origins)
            rows, folded, origins, size = [], [], [], 0
    if rows:
        yield from flush(rows, folded, origins)
