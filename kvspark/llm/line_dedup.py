"""Fuzzy line dedup: MinHash bands, SimHash and length bounds, edit similarity, connected groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .tables import CANDIDATES, PACKED, Candidates, Packer, drop, joined, known, known_bytes, lean, link, only_ids, partitions, save, ship, spread, unpack

#: MinHashes of a line's words, as many keys as these, each of three of them, WORD_STEPS apart: no two
#: keys have more than one in common. Long words, which lines rarely share by chance, are chosen more
#: often: a word weighs its length, up to LONGEST, squared.
MINS, WORD_STEPS, LONGEST = 16, (0, 1, 4), 6
#: Lines of up to SHORT characters have further keys, each of three MinHashes of their runs of GRAM bytes.
SHORT, GRAM_MINS, GRAM_STEPS, GRAM = 60, 7, (0, 1, 3), 4
#: Candidates differ in at most so many of 56 SimHash bits, the first if the shorter has up to SHORT
#: characters (lines with an edit similarity of 0.75 or more: 7 on average, of 1,266 such pairs of more than
#: SHORT characters none over 20; others 22 to 28).
SHORT_BITS, MOST_BITS = 24, 20
#: Before their texts are compared, so many of their MinHashes of words or of byte runs must be equal
#: (of those 1,266 pairs none had under 7 of 20).
LEAST_WORDS, LEAST_GRAMS = 7, 4
#: Lines of fewer words, parted by white space, always stay: blank ones.
MIN_WORDS = 1
#: Lines with fewer words of letters and digits have no near copies, only exact ones.
FUZZY_WORDS = 3

_OTHER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 32 for b in range(256))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def normalise(line: bytes) -> bytes:
    """A line with its symbols, A-Z folded, white space as single blanks between words."""
    return b" ".join(line.translate(_FOLD).split())


def simhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row's distinct words: per bit the majority among them."""
    n = len(first) - 1
    if not len(hashes):
        return np.zeros(n, np.uint64)
    row = np.repeat(np.arange(n), np.diff(first))
    # row and hash in one number: a word of a row meets itself, as no two agree in all upper bits
    low = np.uint64(n.bit_length())
    order = np.argsort(row.astype(np.uint64) << (np.uint64(64) - low) | hashes >> low)
    row, hashes = row[order], hashes[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]
    row, hashes = row[new], hashes[new]
    some = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[some, len(row)])
    # eight counters of one byte in a 64-bit sum, over parts of at most PART words
    parts = -(-size // PART)
    head = np.cumsum(parts) - parts
    begin = np.repeat(some, parts) + PART * (np.arange(parts.sum()) - np.repeat(head, parts))
    out = np.zeros((n, 64), bool)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(_LANES[octets[:, k]], begin).view(np.uint8).reshape(-1, 8)
        out[row[some], 8 * k : 8 * k + 8] = 2 * np.add.reduceat(sums.astype(np.int32), head, axis=0) > size[:, None]
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64).ravel()


PART = 200
#: The bits of a byte, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance in characters, or any number over ``most`` if it is larger: a column of the
    matrix is one integer (Hyyro, 2003)."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most or not a:
        return len(b) if not a else most + 1
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, last, score, left = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a), len(b)
    up, down = mask, 0
    for c in b:
        x = where.get(c, 0)
        diagonal = ((((x & up) + up) ^ up) | x | down) & mask
        more, less = down | (~(diagonal | up) & mask), diagonal & up
        left -= 1
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        if score - left > most:
            return most + 1
        more, less = (more << 1 | 1) & mask, (less << 1) & mask
        up, down = less | (~(diagonal | more) & mask), more & diagonal
    return score


#: Words that :func:`aligned` looks ahead for the next one in common.
AHEAD = 4


def aligned(x: list[str], y: list[str], most: int) -> int:
    """A bound from above on the edit distance of two lines by their words, or a number over ``most``:
    from left to right, what stands between words in common is replaced."""
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for p, q in _STEPS:
            if i + p < len(x) and j + q < len(y) and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q) - (p == q == 1)
        if cost > most:
            return cost
        i, j = i + p, j + q
    return cost + sum(map(len, x[i:])) + len(x) - i + sum(map(len, y[j:])) + len(y) - j


_STEPS = sorted(((p, q) for p in range(AHEAD + 1) for q in range(AHEAD + 1) if p + q), key=lambda s: (sum(s), abs(s[0] - s[1])))


def alike(a: str, b: str, threshold: float) -> bool:
    """Whether 1 - edit distance / longer length is at least ``threshold``."""
    return bool(all_alike([a], [b], threshold)[0])


#: Lines with more characters than this are compared one pair at a time, and so are fewer pairs than FEW.
TOGETHER, FEW = 2048, 48
#: Of a tile, so many pairs are compared first.
TOGETHER_PAIRS = 512
#: 64-bit numbers in the table of where characters stand, and pairs, that are compared at once.
MOST_WHERE, MOST_PAIRS = 1 << 21, 2048
#: Pairs of lines of more characters are compared word by word first.
BY_WORDS = 160


def all_alike(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """:func:`alike` of many pairs."""
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    size = np.maximum(la, lb)
    most = (size * (1 - threshold) + 1e-9).astype(np.int64)
    out = np.zeros(len(a), bool)
    fit = np.abs(la - lb) <= most
    for i in np.flatnonzero(fit & (size > BY_WORDS)).tolist():
        out[i] = aligned(a[i].split(" "), b[i].split(" "), int(most[i])) <= most[i]
    fit &= ~out
    together = np.flatnonzero(fit & (size <= TOGETHER) & (np.minimum(la, lb) > 0))
    together = together[np.argsort(size[together], kind="stable")]
    alone = [np.flatnonzero(fit & (size > TOGETHER) | fit & (np.minimum(la, lb) == 0))]
    codes = len(set().union(*(a[i] for i in together.tolist()))) + 1 if len(together) >= FEW else 1
    while len(together):
        blocks = int(size[together[-1]] + 63) // 64
        # of not too unlike lengths, as the longest pair says which blocks are looked at
        n = len(together) - int(np.searchsorted(size[together], 0.7 * size[together[-1]]))
        together, own = np.split(together, [-min(MOST_PAIRS, max(4 * FEW, min(n, MOST_WHERE // (codes * blocks))), len(together))])
        if len(own) < FEW:  # too few to pay for numpy's calls
            alone.append(own)
            continue
        x, y = zip(*(sorted((a[i], b[i]), key=len) for i in own.tolist()))
        out[own] = edit_distances(x, y, most=most[own]) <= most[own]
    for i in np.concatenate(alone).tolist():
        out[i] = _one_alike(a[i], b[i], int(most[i]))
    return out


def _one_alike(x: str, y: str, most: int) -> bool:
    """Word by word first, then by edit distance without what they begin and end with alike."""
    if aligned(x.split(" "), y.split(" "), most) <= most:
        return True
    low, high = 0, 0
    short = min(len(x), len(y))
    while low < short and x[low] == y[low]:
        low += 1
    while high < short - low and x[-1 - high] == y[-1 - high]:
        high += 1
    return edit_distance(x[low : len(x) - high], y[low : len(y) - high], most) <= most


def _codes(lines: tuple[str, ...]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)


#: Pairs are looked at after so many characters, and those that can no longer be near enough are left.
LOOK = 16


def edit_distances(a: tuple[str, ...], b: tuple[str, ...], blocks: int = 0, most: np.ndarray | None = None) -> np.ndarray:
    """Edit distances of many pairs at once, no line empty. A column of a pair's matrix is some 64-bit integers of
    differences (Myers, 1999); numpy steps through all pairs, each block of 64 rows one column behind the block before,
    so that a step is the same few calls for all blocks. Pairs end together, those of shorter ``b`` begin later.
    ``most``, with no line of ``a`` longer than its partner: a distance over it may be returned as any larger
    number, and only the blocks that paths of at most that many edits can touch are looked at."""
    n, one, top = len(a), np.uint64(1), np.uint64(63)
    m, length = (np.array([len(x) for x in t]) for t in (a, b))
    steps, blocks = int(length.max()), max(blocks, -(-int(m.max()) // 64))
    chars, text = _codes(a), _codes(b)
    code = np.zeros(int(max(chars.max(), text.max())) + 1, np.int64)
    code[chars] = 1
    code = np.where(code, np.cumsum(code) + 1, 1)  # 1: in no line of a
    # a line of a fills the upper bits; below, all differences are 0, and code 0, before a pair begins, changes nothing
    off = 64 * blocks - m
    rows = np.clip(64 * (np.arange(blocks)[:, None] + 1) - off, 0, 64)  # of each block that are in the line
    up = np.where(rows > 0, ~np.uint64(0) << (64 - np.maximum(rows, 1)).astype(np.uint64), np.uint64(0))
    down = np.zeros((blocks, n), np.uint64)
    row = np.repeat(np.arange(n), m)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(m) - m - off, m)
    where = np.zeros((int(code.max()) + 1) * blocks * n, np.uint64)
    where[: blocks * n] = ~up.ravel()
    np.bitwise_or.at(where, (code[chars] * blocks + pos // 64) * n + row, one << (pos % 64).astype(np.uint64))
    row = np.repeat(np.arange(n), length)
    at = np.tile(np.arange(n), (steps, 1))
    at[np.arange(len(row)) - np.repeat(np.cumsum(length) - steps, length), row] += code[text] * (blocks * n)
    begin, ids, out = steps - length, np.arange(n), np.full(n, 1 << 40)
    above = below = 64 * blocks + steps
    if most is not None:
        above, below = int((most - length + m).max()) // 2 + 2, int((most + length - m).max()) // 2 + 2
    # the first and the last column that each block is looked at in
    middle = 64 * blocks - steps + np.arange(steps)
    first = np.searchsorted(np.clip((middle + below) // 64, 0, blocks - 1), np.arange(blocks))
    last = np.searchsorted(np.clip((middle - above) // 64, 0, blocks - 1), np.arange(blocks), side="right") - 1
    more, less = (np.zeros((blocks + 1, n), np.uint64) for _ in range(2))  # what each block gets from the one before
    shift = n * np.arange(blocks)[:, None]
    low, high, score = 0, -1, np.zeros(n, np.int64)
    for t in range(steps + blocks - 1):
        before = low
        while last[low] + low < t:
            low += 1
        if most is not None and t % LOOK == 0 and t > blocks and high >= 0:
            dead = _least(up[before : high + 1], down[before : high + 1], more[before + 1 : high + 1], less[before + 1 : high + 1], score, 64 * blocks - 1 - steps + t - 65 * np.arange(before, high + 1)) > most
            dead &= begin <= t - high - 1  # others have not begun everywhere
            if 4 * dead.sum() > len(ids):
                keep = np.flatnonzero(~dead)
                if not len(keep):
                    return out
                ids, begin, score, most = ids[keep], begin[keep], score[keep], most[keep]
                up, down, more, less, rows, at = (x[:, keep] for x in (up, down, more, less, rows, at))
        while high + 1 < blocks and first[high + 1] + high + 1 <= t:
            high += 1
            score = score + rows[high] - (more[high].astype(np.int64) - less[high].astype(np.int64) if high else 0)
        if low == before or t == 0:
            more[low], less[low] = begin <= t - low, 0
        own = slice(low, high + 1)
        eq = where.take(at[t - high : t - low + 1][::-1] + shift[own])
        p, q, plus_in, minus_in = up[own], down[own], more[own], less[own]
        vertical = eq | q
        eq |= minus_in
        diagonal = eq & p
        diagonal += p
        diagonal ^= p
        diagonal |= eq
        minus = p & diagonal
        diagonal |= p
        plus = np.invert(diagonal, out=diagonal)
        plus |= q
        out_more, out_less = plus >> top, minus >> top
        plus <<= one
        plus |= plus_in
        minus <<= one
        minus |= minus_in
        np.bitwise_and(plus, vertical, out=q)
        vertical |= plus
        np.invert(vertical, out=vertical)
        np.bitwise_or(minus, vertical, out=p)
        more[low + 1 : high + 2], less[low + 1 : high + 2] = out_more, out_less
        score += out_more[-1].view(np.int64)
        score -= out_less[-1].view(np.int64)
    out[ids] = score
    return out


def _least(up: np.ndarray, down: np.ndarray, more: np.ndarray, less: np.ndarray, score: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A bound from below on the distances that pairs end with: the least, over the blocks' last columns, of a value
    and the edits that are left at least. Every eighth row is looked at; a row more changes either by one, and a path
    can pass where a block is a column behind. ``left``: by block, for the row before it, how many rows more than columns are left."""
    k, n = up.shape
    rise = [np.bitwise_count(np.ascontiguousarray(x).view(np.uint8).reshape(k, n, 8)).astype(np.int32) for x in (up, down)]
    value = np.zeros((k, 9, n), np.int64)
    value[:, 1:] = (rise[0] - rise[1]).transpose(0, 2, 1)
    value[1:, 0] = less.astype(np.int64) - more.astype(np.int64)
    value = np.cumsum(value.reshape(9 * k, n), axis=0)
    value += score - value[-1]
    rest = np.abs(left[:, None] + 1 - 8 * np.arange(9)).ravel()
    return (value + rest[:, None]).min(axis=0) - 10


#: Pairs with about so many characters are compared at a time.
TOGETHER_CHARS = 12 << 20


def _alike(threshold: float):
    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            x = pa.Table.from_batches(held)
            held.clear()
            keep = all_alike(x.column("ta").to_pylist(), x.column("tb").to_pylist(), threshold)
            yield from x.select(["a", "b"]).filter(pa.array(keep)).to_batches()

        for b in batches:
            held.append(b)
            size += b.get_total_buffer_size()
            if size > TOGETHER_CHARS:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


_SEEDS = K.mix(np.arange(1, 1 + MINS + GRAM_MINS, dtype=np.uint64)) | np.uint64(1)
_RARE = 1.0 / np.clip(np.arange(LONGEST + 1), 1, None) ** 2.0


def _short(mins: list[np.ndarray]) -> np.ndarray:
    """16 bits of each MinHash: three make a key."""
    return np.stack([(K.mix(x) >> np.uint64(48)).astype(np.uint16) for x in mins], axis=1)


def word_mins(w: K.Words) -> np.ndarray:
    """MINS MinHashes of each line that has words."""
    first = w.first[:-1][np.diff(w.first) > 0]
    if not len(first):
        return np.zeros((0, MINS), np.uint16)
    rare = _RARE[np.minimum(w.ends - w.starts, LONGEST)]
    return _short([np.minimum.reduceat((K.mix(w.hashes * m) >> np.uint64(11)) * rare, first).view(np.uint64) for m in _SEEDS[:MINS]])


def gram_mins(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """GRAM_MINS MinHashes of each of some lines of GRAM bytes or more."""
    n = end - begin - GRAM + 1
    if not len(n):
        return np.zeros((0, GRAM_MINS), np.uint16)
    first = np.cumsum(n) - n
    at = np.repeat(begin - first, n) + np.arange(n.sum())
    folded = np.frombuffer(_OTHER, np.uint8)[buf]
    x = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        x = x << np.uint64(8) | folded[at + k]
    x = K.mix(x)
    return _short([np.minimum.reduceat(K.mix(x * m), first) for m in _SEEDS[MINS:]])


def band_keys(mins: np.ndarray, steps: tuple[int, ...], salt: int, which: int = 0, passes: int = 1) -> np.ndarray:
    """As many keys of each row as it has MinHashes; no two are made of more than one in common. Of all, those
    numbered from ``salt`` that leave ``which`` when divided by ``passes``."""
    own = np.arange((which - salt) % passes, mins.shape[1], passes)
    key = np.zeros((len(mins), len(own)), np.uint64)
    for k in steps:
        key = K.mix(key + mins[:, (own + k) % mins.shape[1]].astype(np.uint64))
    return K.mix(key + (own.astype(np.uint64) + np.uint64(salt) << np.uint64(48)))


def _length_code(chars: np.ndarray) -> np.ndarray:
    """Sixteenths of the binary logarithm, in a byte."""
    return np.minimum(16 * np.log2(np.maximum(chars, 1)), 255).astype(np.uint64)


_LOW = np.uint64(255)


def sketch(w: K.Words, full: K.Words) -> np.ndarray:
    """SimHash of each line with the code of its normalised length in place of its low byte."""
    chars = np.zeros(len(w.buf) + 1, np.int64)
    np.cumsum((w.buf & 0xC0) != 0x80, out=chars[1:])
    sums = np.r_[0, np.cumsum(chars[full.ends] - chars[full.starts] + 1)]
    return simhash(w.hashes, w.first) & ~_LOW | _length_code(sums[full.first[1:]] - sums[full.first[:-1]] - 1)


def may_link(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether lines with these sketches can be so alike: the length bound drops no such pair."""
    p, q = (x & _LOW).astype(np.int64), (y & _LOW).astype(np.int64)
    short = np.minimum(p, q) <= int(_length_code(np.array([SHORT]))[0])
    return (np.abs(p - q) <= int(-16 * np.log2(threshold)) + 1) & (np.bitwise_count((x ^ y) & ~_LOW) <= np.where(short, SHORT_BITS, MOST_BITS))


def line_bounds(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of some rows begin, and each row's first line. Every row has one line
    more than line feeds."""
    feeds = np.flatnonzero(buf[bounds[0] : bounds[-1]] == 0x0A) + bounds[0]
    rows = len(bounds) - 1
    row = np.concatenate([np.arange(rows), np.searchsorted(bounds, feeds, side="right") - 1])
    starts = np.concatenate([bounds[:-1], feeds + 1])
    order = np.lexsort((starts, row))
    return starts[order], np.searchsorted(row[order], np.arange(rows + 1))


def _lines(batch: pa.RecordBatch):
    """First row, each row's first line, the lines' bounds, and their words without and with symbols, of each slice."""
    buf, bounds = K.text_buffers(batch.column("text"))
    for i, j in K.slices(bounds):
        starts, first = line_bounds(buf, bounds[i : j + 1])
        cuts = np.append(starts, bounds[j])
        w = K.words(buf, cuts, K.alphabet("alnum", True))
        yield i, first, cuts - cuts[0], w, K.words(buf, cuts, K.alphabet("space", True), w.sums)


def _hashes(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each line's word sequence."""
    n = len(w.first) - 1
    size = np.diff(w.first)
    row = np.repeat(np.arange(n), size)
    pos = np.arange(len(row)) - w.first[row]
    up, _ = K.powers(int(size.max(initial=0)) + 1)
    out = []
    for seed in (1, 2):
        x = K.mix(w.hashes + np.uint64(seed * 0x51ED270B)) * up[pos]
        c = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x, out=c[1:])
        out.append(K.mix(c[w.first[1:]] - c[w.first[:-1]] + size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _measure(batches):
    for b in batches:
        ids, digest = b.column("doc").to_numpy(), b.column("digest").to_numpy()
        for i, first, cuts, w, full in _lines(b):
            keep = np.flatnonzero(np.diff(full.first) >= MIN_WORDS)
            h1, h2 = _hashes(full)
            sim = sketch(w, full)
            row = np.searchsorted(first, keep, side="right") - 1
            line = (keep - first[row]).astype(np.int32)
            mins = _pack_mins(w, cuts, sim, keep)
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids[i + row], digest[i + row], line, h1[keep], h2[keep], sim[keep].view(np.int64))), mins], ["doc", "digest", "line", "h1", "h2", "sim", "mins"])


def _pack_mins(w: K.Words, cuts: np.ndarray, sim: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The MinHashes of the lines ``keep``, two bytes each, one after the other; none for lines of
    fewer than FUZZY_WORDS words."""
    own = np.flatnonzero(np.diff(w.first)[keep] >= FUZZY_WORDS)
    some = keep[own]
    words = word_mins(w)[np.searchsorted(np.flatnonzero(np.diff(w.first) > 0), some)]
    # a little beyond SHORT, so that a line just below meets those just above
    top = int(_length_code(np.array([SHORT * 4 / 3]))[0]) + 1
    short = np.flatnonzero(((sim[some] & _LOW) <= top) & (cuts[some + 1] - cuts[some] >= GRAM))
    n = np.zeros(len(keep), np.int64)
    n[own] = MINS
    n[own[short]] += GRAM_MINS
    ends = np.cumsum(n)
    out = np.empty(int(n.sum()), np.uint16)
    out[(ends - n)[own][:, None] + np.arange(MINS)] = words
    out[ends[own[short]][:, None] + np.arange(-GRAM_MINS, 0)] = gram_mins(w.buf, cuts[some[short]], cuts[some[short] + 1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.r_[0, 2 * ends].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def _mins(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All MinHashes of some rows of :func:`_pack_mins` and the n + 1 bounds of the rows."""
    packed = packed.cast(pa.large_binary())
    ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 2
    return np.frombuffer(packed.buffers()[2], np.uint16, ends[-1]) if ends[-1] else np.zeros(0, np.uint16), ends


def keys_of(packed: pa.Array, which: int = 0, passes: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a pass, or all, of the rows of :func:`_pack_mins`, and the row of each."""
    raw, ends = _mins(packed)
    some = np.flatnonzero(np.diff(ends))
    words = band_keys(raw[ends[some][:, None] + np.arange(MINS)], WORD_STEPS, 0, which, passes)
    more = np.flatnonzero(np.diff(ends) > MINS)
    grams = band_keys(raw[ends[more + 1][:, None] + np.arange(-GRAM_MINS, 0)], GRAM_STEPS, MINS, which, passes)
    return np.r_[words.ravel(), grams.ravel()], np.r_[np.repeat(some, words.shape[1]), np.repeat(more, grams.shape[1])]


def agree(x: tuple[np.ndarray, np.ndarray], i: np.ndarray, y: tuple[np.ndarray, np.ndarray], j: np.ndarray) -> np.ndarray:
    """Whether rows i of x and j of y, which all have MinHashes, have enough in common."""
    (rx, ex), (ry, ey) = x, y
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 100_000):
        a, b = i[k : k + 100_000], j[k : k + 100_000]
        enough = (rx[ex[a][:, None] + np.arange(MINS)] == ry[ey[b][:, None] + np.arange(MINS)]).sum(axis=1) >= LEAST_WORDS
        both = np.flatnonzero((ex[a + 1] - ex[a] > MINS) & (ey[b + 1] - ey[b] > MINS) & ~enough)
        last = np.arange(-GRAM_MINS, 0)
        enough[both] = (rx[ex[a[both] + 1][:, None] + last] == ry[ey[b[both] + 1][:, None] + last]).sum(axis=1) >= LEAST_GRAMS
        out[k : k + 100_000] = enough
    return out


_NIBBLES, _GRAM_NIBBLES = np.uint64(0x1111111111111111), np.uint32(0x1111111)
assert MINS == 16 and GRAM_MINS == 7


def short_mins(packed: pa.Array) -> np.ndarray:
    """Four bits of each MinHash of some rows of :func:`_pack_mins`, in three 32-bit numbers: 16 of words,
    7 of byte runs, whose last four bits tell whether there are any."""
    raw, ends = _mins(packed)
    out = np.zeros((len(packed), 3), np.uint32)
    some, more = np.flatnonzero(np.diff(ends)), np.flatnonzero(np.diff(ends) > MINS)
    bits = np.uint64(4) * np.arange(MINS, dtype=np.uint64)
    words = (raw[ends[some][:, None] + np.arange(MINS)].astype(np.uint64) & np.uint64(15)) << bits
    out[some, :2] = np.bitwise_or.reduce(words, axis=1).view(np.uint32).reshape(-1, 2)
    grams = (raw[ends[more + 1][:, None] + np.arange(-GRAM_MINS, 0)].astype(np.uint64) & np.uint64(15)) << bits[:GRAM_MINS]
    out[more, 2] = np.bitwise_or.reduce(grams, axis=1).astype(np.uint32) | np.uint32(1 << 28)
    return out


def may_agree(words: np.ndarray, grams: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j of :func:`short_mins` can :func:`agree`: equal MinHashes have equal bits."""
    x = words[i] ^ words[j]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    out = MINS - np.bitwise_count(x & _NIBBLES).astype(np.int64) >= LEAST_WORDS
    both = np.flatnonzero(~out & (grams[i] >> np.uint32(28) & grams[j] >> np.uint32(28)).astype(bool))
    x = grams[i[both]] ^ grams[j[both]]
    x |= x >> np.uint32(1)
    x |= x >> np.uint32(2)
    out[both] = GRAM_MINS - np.bitwise_count(x & _GRAM_NIBBLES).astype(np.int64) >= LEAST_GRAMS
    return out


def _screen(batches):
    """Pairs with enough MinHashes in common."""
    for b in batches:
        at = np.arange(b.num_rows)
        ok = agree(_mins(b.column("ma")), at, _mins(b.column("mb")), at)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok))


#: Keys are shuffled in so many passes, one after the other: the disk holds the shuffles of one. Pairs, which
#: take less, are screened and verified in PAIR_PASSES.
PASSES, PAIR_PASSES = 3, 1
#: So are the documents whose lines are compared.
TEXT_PASSES = 2


def _emit(labels: list[int], which: int):
    def run(batches):
        packer = Packer(labels)
        for b in batches:
            for at in range(0, b.num_rows, 20_000):
                part = b.slice(at, 20_000)
                node, sim = part.column("node").to_numpy(), np.ascontiguousarray(part.column("sim").to_numpy())
                keys, index = keys_of(part.column("mins"), which, PASSES)
                extra = np.concatenate([sim.view(np.uint32).reshape(-1, 2), short_mins(part.column("mins"))], axis=1)
                yield from packer.add(node, keys, index, extra[index])
        yield from packer.flush()

    return run


def _pair_up(small: int, threshold: float):
    def run(batches):
        parts = unpack(batches)
        while parts:
            _, (key, node, extra) = parts.popitem()
            order = np.lexsort((node, key))
            key, node, extra = key[order], node[order], extra[order]
            sim, words = (np.ascontiguousarray(extra[:, k : k + 2]).view(np.uint64).ravel() for k in (0, 2))
            grams = np.ascontiguousarray(extra[:, 4])
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)

            def near(i, j, sim=sim, words=words, grams=grams):
                ok = may_link(sim[i], sim[j], threshold)
                at = np.flatnonzero(ok)
                ok[at] = may_agree(words, grams, i[at], j[at])
                return ok

            yield from Candidates(small, shatter=True).emit(node, start, np.diff(np.r_[start, len(key)]), near)

    return run


def _near_in_run(threshold: float):
    """Which pairs of some lines may link."""

    def near(infos):
        sim, mins = infos.field("sim").to_numpy().view(np.uint64), _mins(infos.field("mins"))

        def close(i, j):
            ok = may_link(sim[i], sim[j], threshold)
            ok[ok] = agree(mins, i[ok], mins, j[ok])
            return ok

        return close

    return near


def _alike_in_run(threshold: float):
    """Which pairs of some lines link."""

    def match(infos):
        norm = infos.field("norm").to_pylist()
        return lambda i, j: all_alike([norm[k] for k in i.tolist()], [norm[k] for k in j.tolist()], threshold)

    return match


def _texts(batches):
    """Normalised text of the wanted lines of each document."""
    schema = pa.schema([("node", pa.int64()), ("norm", pa.string()), ("chars", pa.int32())])
    for b in batches:
        wanted = b.column("lines").to_pylist()
        buf, bounds = K.text_buffers(b.column("text"))
        out: list[dict] = []
        for r in range(b.num_rows):
            lines = buf[bounds[r] : bounds[r + 1]].tobytes().split(b"\n")
            for x in wanted[r]:
                if x["line"] < len(lines):
                    norm = normalise(lines[x["line"]]).decode(errors="replace")
                    out.append({"node": x["node"], "norm": norm, "chars": len(norm)})
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)


def _cut(batches):
    for b in batches:
        row = b.column("row")
        text = row.field(row.type.get_field_index("text")).cast(pa.string())
        n_lines = pc.fill_null(pc.add(pc.count_substring(text, "\n").cast(pa.int64()), 1), 0)
        n_gone = np.zeros(b.num_rows, np.int64)
        some = pc.and_(pc.is_valid(text), pc.greater(pc.fill_null(pc.list_value_length(b.column("gone")), 0), 0))
        cut = []
        for i, t, gone in zip(np.flatnonzero(some).tolist(), text.filter(some).to_pylist(), b.column("gone").filter(some).to_pylist()):
            drop = set(gone)
            n_gone[i] = len(drop)
            cut.append("\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop))
        kept = pc.replace_with_mask(text, some, pa.array(cut, pa.string()))
        yield pa.RecordBatch.from_arrays([row, kept, n_lines, pa.array(n_gone)], ["row", "kept", "n_lines", "n_removed"])


#: Up to so many groups of repeated lines are broadcast to their lines; beyond, both are shuffled.
MAX_BROADCAST_GROUPS = 400_000


def dedup_lines(docs: DataFrame, threshold: float = 0.75, small: int = 16) -> DataFrame:
    """Per row of ``docs``: ``row`` (the whole row), kept (the text without removed lines),
    n_lines and n_removed.

    Lines are what stands between line feeds. Normalised (see :func:`normalise`) they link when
    they are equal, or when 1 - edit distance / longer length, in characters, is at least
    ``threshold``. Of each
    connected group only the occurrence with the smallest (doc_id, line) stays. Lines of fewer
    than FUZZY_WORDS words of letters and digits, such as rows of symbols, link only when equal;
    blank lines always stay.

    Equal lines are one node. Compared are nodes that share a key of three MinHashes of words or,
    up to SHORT characters, of runs of GRAM bytes (see the README for the share of links that
    this finds), less those too far apart in length or, beyond SHORT, in SimHash.

    Null text stays null, with 0 lines; empty text has one empty line. Null doc_ids come after all
    others. Rows with equal doc_id and text keep the same lines each; with equal doc_id and other
    text the smaller digest comes first. Other columns stay inside ``row``."""
    spark = ship(docs.sparkSession)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    named = docs.select(doc.alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    texts = docs.select(doc.alias("doc"), F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text")).where("text is not null")
    lines = save(texts.mapInArrow(lean(_measure), "doc long, digest long, line int, h1 long, h2 long, sim long, mins binary"), "lines")

    place = F.struct("doc", "digest", "line")
    classes = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.min("sim").alias("sim"), F.min("mins").alias("mins"), F.count("*").alias("n"))
    classes = save(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "sim", "mins", "n", "first"), "classes")
    parts = partitions(spark, classes.count() * 36 * (MINS + GRAM_MINS // 2) / PASSES)
    labels, found = spread(spark, parts), []
    for which in range(PASSES):
        packed = classes.select("node", "sim", "mins").mapInArrow(lean(_emit(labels, which)), PACKED)
        found.append(save(packed.repartition(parts, "part").mapInArrow(lean(_pair_up(small, threshold)), CANDIDATES), "candidates", small=True))
    found = joined(found)

    ids = save(found.select(F.explode(F.coalesce("members", F.array("a", "b"))).alias("node")).distinct(), "ids", small=True)
    wanted = save(only_ids(classes, ids, "node").select("node", "sim", "mins", "first.*"), "wanted")
    drop(ids)
    sketches = known_bytes(wanted.select("node", "sim", "mins"), "mins")

    def fetch(ids: DataFrame) -> DataFrame:
        by_doc = wanted.join(known(ids), "node", "left_semi").groupBy("doc", "digest").agg(F.collect_list(F.struct("line", "node")).alias("lines"))
        by_doc, norms = save(by_doc, "asked", small=True), []
        for p in range(TEXT_PASSES):  # whole texts are shuffled
            own = by_doc.where(F.pmod(F.xxhash64("doc"), F.lit(TEXT_PASSES)) == p)
            some = only_ids(texts, own.select("doc").distinct(), "doc").dropDuplicates(["doc", "digest"]).join(own, ["doc", "digest"])
            norms.append(save(some.select("text", "lines").mapInArrow(lean(_texts), "node long, norm string, chars int"), "norms"))
        drop(by_doc)
        return joined(norms)

    def screen(pairs: DataFrame) -> DataFrame:
        for x in "ab":
            pairs = pairs.join(sketches.select(F.col("node").alias(x), F.col("mins").alias("m" + x)), x)
        return pairs.mapInArrow(lean(_screen), "a long, b long")

    def verify(pairs: DataFrame, norms: DataFrame) -> DataFrame:
        norms = known_bytes(norms, "norm")
        a, b = (norms.select(F.col("node").alias(x), F.col("norm").alias("t" + x), F.col("chars").alias("n" + x)) for x in "ab")
        both = pairs.join(a, "a").join(b, "b").withColumn("most", F.floor(F.greatest("na", "nb") * F.lit(1 - threshold) + 1e-9).cast("int"))
        both = both.where(F.abs(F.col("na") - F.col("nb")) <= F.col("most"))
        return both.select("a", "b", "ta", "tb").mapInArrow(lean(_alike(threshold)), "a long, b long")

    def info(norms: DataFrame) -> DataFrame:
        return sketches.join(known_bytes(norms, "norm"), "node").select("node", F.struct("sim", "mins", "norm").alias("info"))

    comps = link(found, screen, fetch, verify, info, _near_in_run(threshold), _alike_in_run(threshold), PAIR_PASSES, TOGETHER_PAIRS)
    drop(wanted)
    grouped = classes.join(known(comps), "node", "left").select("h1", "h2", "n", "first", F.coalesce("comp", "node").alias("comp"), F.col("comp").isNotNull().alias("linked")).where("n > 1 or linked")
    keep = grouped.groupBy("comp").agg(F.min("first").alias("keep"))
    groups = save(grouped.join(keep, "comp").select("h1", "h2", "keep"), "groups")
    drop(classes)
    small_enough = groups.count() <= MAX_BROADCAST_GROUPS
    gone = lines.select("h1", "h2", "doc", "digest", "line").join(F.broadcast(groups) if small_enough else groups, ["h1", "h2"])
    gone = gone.where(place != F.col("keep")).groupBy("doc", "digest").agg(F.collect_list("line").alias("gone"))
    gone = save(gone, "gone", small=True)
    drop(lines, groups)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    ids = gone.select("doc").distinct()
    changed = only_ids(named, ids, "doc").join(gone, ["doc", "digest"], "left").select("row", "gone")
    same = only_ids(named, ids, "doc", "left_anti").select("row", F.lit(None).cast("array<int>").alias("gone"))
    return changed.union(same).mapInArrow(lean(_cut), schema)
