"""Fuzzy line deduplication: similarity sketches, blocks, edit similarity, one occurrence per connected group.

A line is normalised (ASCII lower case, digits to 0, ASCII punctuation and runs of white space to one space). Equal
lines collapse first, whatever their number. Each distinct line of `min_fuzzy` words or more gets min-hashes over its
pieces of GRAM bytes (the line padded with GRAM - 1 blanks at both ends), and a block is the tuple of some of them:
lines with the same tuple meet. Lines of a block whose sketches (five bits of each of SKETCHED min-hashes, and a class
of the length) agree in LEAST_SAME places or more form candidate clusters; a cluster's lines meet once, in units, where
pairs are verified by edit similarity (1 - distance / longer length, in bytes of the normalised lines) and a spanning
forest of the links is returned. Clusters of more than UNIT lines meet by blocks instead where that means fewer rows;
of a block or cluster of more than UNIT, all lines meet the first, and what isn't linked with that meets all of it.
The first occurrence of each connected group stays, by document id, then line number.

Block tuples stand in for the runs of SimHash bits: two lines that share a part J of their pieces have one in common
with about 1 - (1 - J^width)^tables, while SimHash bits differ so often at an edit similarity of 0.85 that runs long
enough to be selective are rarely equal. width grows with the logarithm of the lines that are meant, so that blocks do not fill with
unrelated lines, and tables with it, so that recall stays the same: both follow from `n_lines`, a parameter. The search is not exact: tests/llm measures its
recall against edit similarity alone, by length and kind of change.

Defined results: null and empty texts have no lines to judge; lines of fewer than `min_words` words stay; a document
whose every judged line goes, and that has no other words, becomes empty; rows with a null id stay as they are; rows
that share an id are one document, each of whose rows keeps the same line numbers; an empty table gives an empty
result; other columns stay, whatever their names, but for _judged and _removed, which the result has itself. Equal
lines are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, Scratch, _BYTE, _powers, bounded_arrow, components, fresh, local_roots, mix, text_slices, tidy

#: Bytes of a piece; places of a sketch, of five bits each, and how many of them agree at least.
GRAM, SKETCHED, LEAST_SAME = 6, 24, 11
#: A similarity of pieces at which RECALL of the pairs share a block.
SIMILAR, RECALL = 0.6, 0.94
#: Distinct lines up to which three min-hashes make a block; each SPREAD times as many take one more.
NARROW, SPREAD = 1 << 22, 32
#: Distinct lines that blocks are made for, whatever the input: which lines meet doesn't depend on how many others there are.
MANY = NARROW * SPREAD
#: Lines of a unit of a block or cluster.
UNIT = 256
#: Rows of blocks for a task, and those it holds before it looks for large blocks.
PART_ROWS, HELD = 500_000, 2_000_000
#: Pairs of lines that are looked at together, and those that are verified at once.
PAIRS, SLICE = 1_000_000, 20_000
#: Rows of blocks that are compared at once, and the bytes of a line beyond which pairs are compared one by one.
AT_ONCE, LONG = 1 << 16, 8192
#: Bytes of a row of a block that move: 4 of its bucket, 8 of its key, 16 of its sketch.
ROW = 28
#: Columns of a long pair between which its rows move.
COLUMNS = 128
PAD = np.full(GRAM - 1, 32, np.uint8)
MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 32, 512, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def settings(n_lines: float) -> tuple[int, int, int]:
    """width and number of blocks, and number of min-hashes, for about so many distinct lines."""
    width = 3 + max(0, math.ceil(math.log(max(n_lines, 1) / NARROW, SPREAD)))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - SIMILAR**width))
    return width, tables, min(max(SKETCHED, 8 * width), len(MULTIPLIERS))


def members(width: int, tables: int, hashes: int) -> np.ndarray:
    """(tables, width) min-hashes of each block: runs of random orders, so that all are used alike."""
    rng, out = np.random.default_rng(11), []
    while len(out) < tables:
        order = rng.permutation(hashes)
        out += [order[k : k + width] for k in range(0, hashes - width + 1, width)]
    return np.array(out[:tables])


#: Bytes to their normal form: lower case, digits to 0, punctuation to space; line ends stay.
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[65:91] += 32
NORMAL[48:58] = 48
NORMAL[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
#: Bytes of words.
WORD = ~IS_SPACE[NORMAL]


class Lines:
    """The lines of a slice of texts: number of words, key (hash of the normalised line), owner, number in the text, place."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int, keys: bool = True):
        ends = np.flatnonzero(data == 10)
        # a line ends at a line end, or with its text
        owner_of_end = np.searchsorted(offsets, ends, "right") - 1
        starts = np.concatenate([offsets[:-1], ends + 1])
        owner = np.concatenate([np.arange(n), owner_of_end])
        order = np.lexsort((starts, owner))
        self.start, self.owner = starts[order], owner[order]
        self.end = np.concatenate([self.start[1:] - 1, [0]])
        last = np.concatenate([self.owner[1:] != self.owner[:-1], [True]]) if len(self.owner) else np.zeros(0, bool)
        self.end[last] = offsets[self.owner[last] + 1]
        first = np.searchsorted(self.owner, np.arange(n))
        self.number = np.arange(len(self.owner)) - first[self.owner]
        # words: where bytes that are none follow, or a text begins
        inside = WORD[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        begins[edges] = inside[edges]
        at = np.flatnonzero(begins)
        line_ends = np.searchsorted(at, self.end)
        self.first_word = np.searchsorted(at, self.start)
        self.words = line_ends - self.first_word
        if not keys:
            return
        # bytes with one space for a run, and the place of each line in them
        stays = inside.copy()
        stays[1:] |= inside[:-1]
        place = np.cumsum(stays, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
        self.letters = NORMAL[data[stays]]
        self.letters[IS_SPACE[self.letters]] = 32
        self.begin, self.length = np.zeros(len(self.start), np.int64), np.zeros(len(self.start), np.int64)
        full = np.flatnonzero(self.words)
        self.begin[full] = place[at[self.first_word[full]]] - 1
        until = self.end[full] - 1
        self.length[full] = place[until] - self.begin[full] - (~inside[until]).astype(np.int64)  # without the blank after the last word
        powers, inverses = _powers(len(self.letters) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(self.letters) + 1, np.uint64)
            np.cumsum(_BYTE[self.letters] * powers[: len(self.letters)], out=run[1:])
            self.key = mix((run[self.begin + self.length] - run[self.begin]) * inverses[self.begin] + self.length.astype(np.uint64)).view(np.int64)

    def min_hashes(self, lines: np.ndarray, count: int) -> np.ndarray:
        """(lines, count) bytes: of each given line, the top bytes of least hashes of its pieces."""
        least = np.full((len(lines), count), 0xFFFFFFFF, np.uint32)
        for some in np.split(np.arange(len(lines)), np.flatnonzero(np.diff(np.cumsum(self.length[lines]) >> 18)) + 1):
            if len(some) == 1:  # a long line goes by parts
                at, end = self.begin[lines[some[0]]], self.begin[lines[some[0]]] + self.length[lines[some[0]]]
                text = np.concatenate([PAD, self.letters[at:end], PAD])
                for k in range(0, len(text) - GRAM + 1, 1 << 18):
                    np.minimum(least[some], _least(text[k : k + (1 << 18) + GRAM - 1], np.zeros(1, np.int64), count), out=(low := np.empty((1, count), np.uint32)))
                    least[some] = low
            elif len(some):
                sizes = self.length[lines[some]] + 2 * len(PAD)
                begins = np.cumsum(sizes) - sizes
                place = np.arange(sizes.sum()) - np.repeat(begins + len(PAD), sizes)
                inside = (place >= 0) & (place < np.repeat(self.length[lines[some]], sizes))
                text = np.full(len(place), 32, np.uint8)
                text[inside] = self.letters[(place + np.repeat(self.begin[lines[some]], sizes))[inside]]
                # the last pieces of a line would reach into the next one
                least[some] = _least(text, begins, count, place[: len(place) - GRAM + 1] < np.repeat(self.length[lines[some]], sizes)[: len(place) - GRAM + 1])
        return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _least(text: np.ndarray, begins: np.ndarray, count: int, stays: np.ndarray | None = None) -> np.ndarray:
    """(lines, count) least hashes of the pieces of lines that begin at the given bytes; only those pieces that stay."""
    piece = np.zeros(len(text) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        piece = (piece << np.uint64(8)) | text[k : k + len(piece)]
    if stays is not None:
        piece, begins = piece[stays], begins - np.arange(len(begins)) * (GRAM - 1)
    piece = (mix(piece) >> np.uint64(32)).astype(np.uint32)
    out, room = np.empty((len(begins), count), np.uint32), np.empty_like(piece)
    for k in range(count):
        np.multiply(piece, MULTIPLIERS[k], out=room)
        out[:, k] = np.minimum.reduceat(room, begins)
    return out


def length_class(length: np.ndarray) -> np.ndarray:
    """Lengths in steps of half of the 15 % by which similar lines may differ."""
    return (np.log(np.maximum(length, 1)) * (2 / -math.log(0.85))).astype(np.uint64)


#: The lowest bit of each place of a sketch's two longs, which hold half of the places each.
HALF = SKETCHED // 2
LOWEST = sum(1 << 5 * k for k in range(HALF))


def sketch(hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(lines, 2) longs: five bits of each of the first SKETCHED min-hashes; above them, half of the length's class in each."""
    classes = length_class(length)
    out = np.stack([classes >> np.uint64(4), classes & np.uint64(15)], 1) << np.uint64(5 * HALF)
    for k in range(SKETCHED):
        out[:, k // HALF] |= (hashes[:, k].astype(np.uint64) & np.uint64(31)) << np.uint64(5 * (k % HALF))
    return out.view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in which sketches differ."""
    out = 0
    for k in (0, 1):
        x = (a[:, k] ^ b[:, k]).view(np.uint64)
        two = x | x >> np.uint64(1)
        out = out + np.bitwise_count((two | two >> np.uint64(2) | x >> np.uint64(4)) & np.uint64(LOWEST))
    return out


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches agree in LEAST_SAME places or more, and their lengths are similar."""
    top = np.uint64(5 * HALF)
    one, two = ((x[:, 0].view(np.uint64) >> top << np.uint64(4) | x[:, 1].view(np.uint64) >> top).astype(np.int16) for x in (a, b))
    return (differing(a, b) <= SKETCHED - LEAST_SAME) & (np.abs(one - two) <= 3)


def _scan(min_words: int, min_fuzzy: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, most=1 << 18):
                x = Lines(data, offsets, part.num_rows)
                judged = np.flatnonzero(x.words >= min_words)
                fuzzy = np.flatnonzero(x.words[judged] >= min_fuzzy)
                hashes = np.zeros((len(judged), count), np.uint8)
                hashes[fuzzy] = x.min_hashes(judged[fuzzy], count)
                flat = pa.Array.from_buffers(pa.binary(count), len(judged), [None, pa.py_buffer(hashes.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(x.owner[judged])), pa.array(x.number[judged].astype(np.int32)), pa.array(x.key[judged]), pa.array(x.words[judged] >= min_fuzzy), flat, pa.array(x.length[judged].astype(np.int32))],
                    ["id", "line", "key", "fuzzy", "hashes", "length"],
                )

    return run


def _bytes(column: pa.Array, count: int) -> np.ndarray:
    """(rows, count) bytes of a binary column whose values all have that length."""
    offsets, data = column.buffers()[1:]
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = int(np.frombuffer(offsets, wide)[column.offset]) if len(column) else 0
    return np.frombuffer(data, np.uint8, len(column) * count, at).reshape(-1, count)


def _explode_blocks(chosen: np.ndarray, count: int, parts: int):
    """(key, hashes, length) to a row of bytes for each part of the blocks: part, and rows of bucket, key, sketch as ROW bytes each.

    So the rows of the blocks, by far the most numerous, move as a few large values. Of a bucket's 64 bits, those that
    tell its part aren't moved with each row: 32 others are, and tell the few thousand blocks of a part apart. Where two
    blocks of a part have the same bits, their lines meet as if in one, and are compared as all are.
    """
    tables = len(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, length = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            hashes = _bytes(batch.column(1), count)
            part = np.empty((len(key), tables), np.int32)
            rows = np.empty((len(key), tables, ROW // 4), np.uint32)
            with np.errstate(over="ignore"):
                for t in range(tables):
                    value = np.full(len(key), t + 1, np.uint64)
                    for k in chosen[t]:
                        value = (value << np.uint64(8) | hashes[:, k]) if chosen.shape[1] < 7 else mix(value) + hashes[:, k]
                    value = mix(value)
                    part[:, t] = value % np.uint64(parts)
                    rows[:, t, 0] = value >> np.uint64(32)
            rows[:, :, 1:] = np.concatenate([key[:, None], sketch(hashes, length)], 1).view(np.uint32)[:, None, :]
            rows, part = rows.reshape(-1, ROW // 4), part.ravel()
            order = np.argsort(part, kind="stable")
            numbers, ends = np.unique(part[order], return_index=True)
            ends = np.append(ends, len(part)).astype(np.int32) * ROW
            data = pa.Array.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows[order]))])
            yield pa.RecordBatch.from_arrays([pa.array(numbers), data], ["part", "data"])

    return run


def _block_rows(part: int, data: pa.Buffer) -> np.ndarray:
    """(rows, 4) longs: bucket, key and sketch of a part's rows."""
    rows = np.frombuffer(data, np.uint32).reshape(-1, ROW // 4)
    out = np.empty((len(rows), 4), np.int64)
    out[:, 0] = rows[:, 0] + np.int64(part << 32)
    out[:, 1:] = rows[:, 1:].copy().view(np.int64)
    return out


def alike_steps(group: np.ndarray, sketches: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of each run of equal groups whose sketches are alike, by their distance in the run.

    A line of side 0 only pairs with those of side 1; of side -1 with all.
    """
    at, step = np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        ok = alike(sketches[at], sketches[at + step])
        if side is not None:
            ok &= (side[at] < 0) | (side[at] != side[at + step])
        if ok.any():
            yield at[ok], at[ok] + step
        step += 1


def alike_forest(key: np.ndarray, group: np.ndarray, sketches: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the alike pairs (node, root). What is held shrinks to a forest whenever it has grown a lot."""
    ones, twos, size = [], [], 0
    for i, j in alike_steps(group, sketches, side):
        ones.append(key[i])
        twos.append(key[j])
        size += len(i)
        if size > 4 * len(key) + 1000:
            a, b = local_roots(np.concatenate(ones), np.concatenate(twos))
            ones, twos, size = [a], [b], 0
    return local_roots(np.concatenate(ones), np.concatenate(twos)) if ones else (key[:0], key[:0])


def alike_column(a: str, b: str) -> Column:
    """alike() of two lines, by the columns of their sketches: a1, a2 and b1, b2."""
    differ, classes = F.lit(0), F.lit(0)
    for k, weight in (("1", 16), ("2", 1)):
        x = F.col(a + k).bitwiseXOR(F.col(b + k))
        two = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(two.bitwiseOR(F.shiftrightunsigned(two, 2)).bitwiseOR(F.shiftrightunsigned(x, 4)).bitwiseAND(F.lit(LOWEST)))
        classes = classes + weight * (F.shiftrightunsigned(F.col(a + k), 5 * HALF) - F.shiftrightunsigned(F.col(b + k), 5 * HALF))
    return (differ <= SKETCHED - LEAST_SAME) & (F.abs(classes) <= 3)


def _sketches(rows: pa.Table | pa.RecordBatch, name: str = "s") -> np.ndarray:
    return np.stack([rows.column(rows.schema.get_field_index(name + k)).to_numpy() for k in "12"], 1)


def _close_in_blocks(batches: Iterator[pa.RecordBatch], lines: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (part, data) to a forest of the alike lines of each block: (a, b, 0, null bucket).

    With `lines`, those lines themselves, (key, s1, s2, bucket). So are returned all lines of blocks of more than UNIT,
    to be dealt out. Whenever there are many rows, those of such blocks are passed on, and so are all that still come
    for them: what is held is the rows of small blocks, whose number the number of parts bounds.
    """
    held: list[np.ndarray] = []
    passed = np.zeros(0, np.int64)
    n, most = 0, HELD

    def out(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, k].copy()) for k in (1, 2, 3, 0)], ["a", "b", "c", "bucket"])

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64)), pa.nulls(len(a), pa.int64())], ["a", "b", "c", "bucket"])

    def sorted_rows() -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate(held)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        starts = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
        return rows, np.repeat(np.diff(np.append(starts, len(rows))), np.diff(np.append(starts, len(rows))))

    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = _block_rows(part, data.as_buffer())
            if len(passed):
                known = np.isin(rows[:, 0], passed)
                if known.any():
                    yield out(rows[known])
                    rows = rows[~known]
            held.append(rows)
            n += len(rows)
            if n > most:
                rows, size = sorted_rows()
                if (size > UNIT).any():
                    yield out(rows[size > UNIT])
                    passed = np.union1d(passed, rows[size > UNIT, 0])
                held = [rows[size <= UNIT]]
                n = len(held[0])
                most = max(HELD, 2 * n)
    if not n:
        return
    rows, size = sorted_rows()
    if (size > UNIT).any():
        yield out(rows[size > UNIT])
    rows = rows[(size > 1) & (size <= UNIT)]
    at = 0
    while at < len(rows):
        stop = min(at + AT_ONCE, len(rows))
        while stop < len(rows) and rows[stop, 0] == rows[stop - 1, 0]:
            stop += 1
        some, at = rows[at:stop], stop
        if lines:
            met = np.zeros(len(some), bool)
            for i, j in alike_steps(some[:, 0], some[:, 2:]):
                met[i] = met[j] = True
            yield out(some[met])
        else:
            yield edges(*alike_forest(some[:, 1].copy(), some[:, 0], some[:, 2:]))


def _close_in_units(group: pa.Table) -> pa.Table:
    """Lines of two parts of a large block: a forest of those that are alike, each of one side with each of the other."""
    key, sketches, side = group["key"].to_numpy(), _sketches(group), group["side"].to_numpy()
    ones, twos = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    edges = []
    for at in range(0, len(ones), 64):
        i, j = np.repeat(ones[at : at + 64], len(twos)), np.tile(twos, len(ones[at : at + 64]))
        ok = alike(sketches[i], sketches[j])
        edges.append(np.stack(local_roots(key[i[ok]], key[j[ok]])) if ok.any() else np.zeros((2, 0), np.int64))
    a, b = np.concatenate(edges, 1) if edges else (key[:0], key[:0])
    a, b = local_roots(a, b) if len(a) else (a, b)
    return pa.table({"a": a, "b": b})


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """Levenshtein distance by bit-parallel columns (one big integer per column); most + 1 or more if it exceeds most."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    a, b = _trimmed(a, b)
    n, delta = len(a), len(b) - len(a)
    if not n:
        return len(b)
    where: dict[int, int] = {}
    for c in set(a):
        where[c] = int.from_bytes(np.packbits(np.frombuffer(a, np.uint8) == c, bitorder="little").tobytes(), "little")
    # some columns at a time, with the rows through which a path of at most `most` edits can lead there
    above, below = (most + delta) // 2, (most - delta) // 2
    lo = hi = pv = mv = score = 0
    for at in range(0, len(b), COLUMNS):
        some = b[at : at + COLUMNS]
        shift, more = max(0, at - above) - lo, min(n, at + len(some) + below) - hi
        pv, mv, score = (pv | ((1 << more) - 1) << (hi - lo)) >> shift, mv >> shift, score + more
        lo, hi = lo + shift, hi + more
        mask, top = (1 << (hi - lo)) - 1, 1 << (hi - lo - 1)
        here = {c: where.get(c, 0) >> lo & mask for c in set(some)}
        for c in some:
            eq = here[c]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph = ((ph << 1) | 1) & mask
            mh = (mh << 1) & mask
            pv = mh | (~(xv | ph) & mask)
            mv = ph & xv
        if hi == n and score - (len(b) - at - len(some)) > most:
            return most + 1
    return score


def _trimmed(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Two lines without what both begin and end with, the shorter first."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid :] == b[len(b) - mid :] else (lo, mid - 1)
    a, b = a[: len(a) - lo], b[: len(b) - lo]
    return (a, b) if len(a) <= len(b) else (b, a)


def distances(ones: list[bytes], twos: list[bytes], n_words: int, most: int | np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs, all at once: bit-parallel columns in words of 64 rows. ones: 1 to 64 * n_words bytes.

    Distances up to `most` are exact, others are over it: only words of rows are computed through which a path of so many
    edits can lead. It leaves the diagonal by half of the edits that the difference of lengths doesn't take.
    """
    n, n_rows = len(ones), np.array([len(x) for x in ones])
    columns = np.array([len(x) for x in twos])
    longer = columns - n_rows
    above, below = (int(np.maximum((most + x) // 2, x).max(initial=0)) for x in (longer, -longer))
    a, b = np.zeros((64 * n_words, n), np.intp), np.zeros((columns.max(initial=0), n), np.intp)
    for k, (x, y) in enumerate(zip(ones, twos, strict=True)):
        a[: len(x), k] = np.frombuffer(x, np.uint8)
        b[: len(y), k] = np.frombuffer(y, np.uint8)
    each, letters = np.arange(n), np.zeros(256, np.intp)
    for x in (a, b):
        letters[x.ravel()] = 1
    letters, n_letters = np.cumsum(letters) - 1, int(letters.sum())
    a, b = letters[a] * n + each, letters[b] * n + each
    where = np.zeros((n_words, n_letters * n), np.uint64)  # rows at which each byte stands; rows past a line's end don't matter
    for i in range(n_rows.max(initial=0)):
        where[i >> 6, a[i]] |= np.uint64(1 << (i & 63))
    up, down = np.full((n_words, n), ~np.uint64(0)), np.zeros((n_words, n), np.uint64)
    # the value at the last row of each word, for the last of the band and those in which a line ends
    score = np.repeat(64 * np.arange(1, n_words + 1)[:, None], n, 1)
    one, zero, top, first = np.uint64(1), np.zeros(n, np.uint64), np.uint64(63), np.ones(n, np.uint64)
    own, last = (n_rows - 1) >> 6, ((n_rows - 1) & 63).astype(np.uint64)
    least = own.min(initial=n_words)
    past = ~((one << last << one) - one)  # rows of the last word that aren't the line's
    ends = np.argsort(columns, kind="stable")
    upto = np.searchsorted(columns[ends], np.arange(len(b) + 2))
    out, bottom = np.zeros(n, np.int64), min(n_words - 1, (below + 1) >> 6)
    eq, xv, xh, ph, mh = (np.empty(n, np.uint64) for _ in range(5))
    carries = [(np.empty(n, np.uint64), np.empty(n, np.uint64)) for _ in range(2)]
    for j in range(len(b)):
        enters = min(n_words - 1, (j + below + 1) >> 6)
        if enters > bottom:
            score[enters], bottom = score[enters - 1] + 64, enters
        plus, minus = first, zero
        for w in range(max(0, (j - above - 1) >> 6), bottom + 1):
            pv, mv, (out_plus, out_minus) = up[w], down[w], carries[w & 1]
            np.take(where[w], b[j], out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            np.bitwise_or(eq, minus, out=eq)
            np.bitwise_and(eq, pv, out=xh)  # xh = (((eq & pv) + pv) ^ pv) | eq
            np.add(xh, pv, out=xh)
            np.bitwise_xor(xh, pv, out=xh)
            np.bitwise_or(xh, eq, out=xh)
            np.bitwise_and(pv, xh, out=mh)
            np.bitwise_or(xh, pv, out=xh)  # ph = mv | ~(xh | pv)
            np.invert(xh, out=xh)
            np.bitwise_or(mv, xh, out=ph)
            np.right_shift(ph, top, out=out_plus)
            np.right_shift(mh, top, out=out_minus)
            if w >= least or w == bottom:
                score[w] += out_plus.view(np.int64)
                score[w] -= out_minus.view(np.int64)
            np.left_shift(ph, one, out=ph)
            np.bitwise_or(ph, plus, out=ph)
            np.left_shift(mh, one, out=mh)
            np.bitwise_or(mh, minus, out=mh)
            np.bitwise_or(xv, ph, out=xh)
            np.invert(xh, out=xh)
            np.bitwise_or(mh, xh, out=pv)
            np.bitwise_and(ph, xv, out=mv)
            plus, minus = out_plus, out_minus
        if upto[j + 2] > upto[j + 1]:  # pairs of j + 1 columns
            p = ends[upto[j + 1] : upto[j + 2]]
            out[p] = score[own[p], p] - np.bitwise_count(up[own[p], p] & past[p]).astype(np.int64) + np.bitwise_count(down[own[p], p] & past[p])
    return out


def within_many(ones: list[bytes], twos: list[bytes], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most its `most`."""
    out, todo = np.zeros(len(ones), bool), []
    for k, (x, y, m) in enumerate(zip(ones, twos, most.tolist(), strict=True)):
        if abs(len(x) - len(y)) > m:
            continue
        x, y = _trimmed(x, y)
        if len(y) <= m:
            out[k] = True
        elif len(one := x.split(b" ")) == len(two := y.split(b" ")) and sum(max(len(v), len(w)) for v, w in zip(one, two, strict=True) if v != w) <= m:
            out[k] = True  # word by word
        elif len(x) > LONG:
            out[k] = edit_distance(x, y, m) <= m
        elif x:
            todo.append((-(-len(x) // 64), len(y), k, x, y))
    todo.sort(key=lambda t: t[:3])
    at = 0
    while at < len(todo):  # pairs of about the same length go together, where they are many
        size = todo[at][0]
        stop = at + 1
        while stop < len(todo) and todo[stop][0] <= size + size // 3 and stop - at < max(256, 65536 // size):
            stop += 1
        some, at = todo[at:stop], stop
        which = np.array([t[2] for t in some])
        size, band = some[-1][0], int(most[which].max())
        if len(some) > 10 * min(size, band // 32 + 2):
            out[which] = distances([t[3] for t in some], [t[4] for t in some], size, most[which]) <= most[which]
        else:
            out[which] = [edit_distance(x, y, m) <= m for (_, _, _, x, y), m in zip(some, most[which].tolist(), strict=True)]
    return out


def place_hash(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def _set_bits(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(id, line) to the words of a bit table that their places set in this partition."""
    table = np.zeros(1 << (bits - 6), np.uint64)
    for batch in batches:
        h = place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()) >> np.uint64(64 - bits)
        np.bitwise_or.at(table, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["w", "b"])


def _lines_at(table: np.ndarray):
    """(id, text) to the lines whose place may be in the table: id, line, text."""
    shift = np.uint64(64 - (len(table) * 64).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                ends = np.flatnonzero(data == 10)
                owner = np.concatenate([np.arange(part.num_rows), np.searchsorted(offsets, ends, "right") - 1])
                starts = np.concatenate([offsets[:-1], ends + 1])
                order = np.lexsort((starts, owner))
                starts, owner = starts[order], owner[order]
                first = np.searchsorted(owner, np.arange(part.num_rows))
                number = np.arange(len(owner)) - first[owner]
                last = np.concatenate([owner[1:] != owner[:-1], [True]])
                stops = np.where(last, offsets[owner + 1], np.append(starts[1:], 0) - 1)
                h = place_hash(part.column(0).to_numpy()[owner], number) >> shift
                hit = np.flatnonzero(table[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1))
                raw = data.tobytes()
                text = [raw[starts[k] : stops[k]] for k in hit]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[hit])), pa.array(number[hit].astype(np.int32)), pa.array(text, pa.binary())], ["id", "line", "text"])

    return run


def lines_at(docs: DataFrame, places: DataFrame, n_places: int) -> DataFrame:
    """id, line, text (bytes) of the given places (id, line), of whole texts; some others may be among them.

    A bit table of 16 bits a place (2 MB to 16 MB) drops the other lines where the texts are read.
    """
    bits = min(max(24, (16 * max(n_places, 1)).bit_length()), 27)
    words = places.select("id", "line").mapInArrow(tidy(partial(_set_bits, bits=bits)), "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for batch in words.toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return docs.select("id", "text").mapInArrow(tidy(_lines_at(table)), "id long, line int, text binary")


def normalise(line: str | bytes) -> bytes:
    data = NORMAL[np.frombuffer(line.encode() if isinstance(line, str) else line, np.uint8)]
    return b" ".join(data.tobytes().split())


def _most(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The edits that a similarity of percent allows, by the lengths of two lines."""
    return np.maximum(a, b) * (100 - percent) // 100


def linked(text: list[bytes], ones: np.ndarray, twos: np.ndarray, percent: int) -> np.ndarray:
    """The least line that each is linked with, through any of the pairs, which come closest first.

    A few times a forest of the pairs that still matter is verified, then all of them, in slices.
    """
    length = np.array([len(t) for t in text])
    most = _most(length[ones], length[twos], percent)
    keep = np.abs(length[ones] - length[twos]) <= most
    ones, twos, most = ones[keep], twos[keep], most[keep]
    top = np.arange(len(text))

    def forest() -> np.ndarray:
        """Those of the pairs, in their order, that join parts which no earlier one of them joined."""
        root, out = top.tolist(), []
        for k, i, j in zip(range(len(ones)), top[ones].tolist(), top[twos].tolist(), strict=True):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            if i != j:
                root[max(i, j)] = min(i, j)
                out.append(k)
        return np.array(out, np.int64)

    tries = 0
    while len(ones):
        chosen = forest() if tries < 3 else np.arange(min(len(ones), SLICE))
        tries += 1
        ok = chosen[within_many([text[i] for i in ones[chosen].tolist()], [text[j] for j in twos[chosen].tolist()], most[chosen])]
        if len(ok):
            node, root = local_roots(top[ones[ok]], top[twos[ok]])
            new = np.arange(len(text))
            new[node] = root
            top = new[top]
        open_ = np.ones(len(ones), bool)
        open_[chosen] = False
        open_ &= top[ones] != top[twos]
        ones, twos, most = ones[open_], twos[open_], most[open_]
    return top


def _verify(percent: int):
    """Rows (unit, bi, bj, side, key, s1, s2, text), those of a unit together, to a forest of its links: node, root."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        group = np.stack([t[c].to_numpy() for c in ("unit", "bi", "bj")]).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], (group[:, 1:] != group[:, :-1]).any(0))))
        sizes = np.diff(np.append(starts, t.num_rows))
        # units together as long as they have no more than so many pairs
        for some in np.split(np.arange(len(starts)), np.flatnonzero(np.diff(np.cumsum(sizes * sizes) // (2 * PAIRS))) + 1):
            part = t.slice(int(starts[some[0]]), int(sizes[some].sum())).combine_chunks()
            number = np.repeat(np.arange(len(some)), sizes[some])
            key, sketches = part["key"].to_numpy(), _sketches(part)
            pairs = list(alike_steps(number, sketches, part["side"].to_numpy()))
            if pairs:
                ones, twos = (np.concatenate(x) for x in zip(*pairs, strict=True))
                order = np.argsort(differing(sketches[ones], sketches[twos]), kind="stable")
                tops = linked([normalise(x) for x in part["text"].to_pylist()], ones[order], twos[order], percent)
                moved = tops != np.arange(len(tops))
                yield pa.RecordBatch.from_arrays([pa.array(key[moved]), pa.array(key[tops[moved]])], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 32_768 or sum(x.nbytes for x in held) > 16 << 20:
                t = pa.Table.from_batches(held).combine_chunks()
                last = [t[c][t.num_rows - 1].as_py() for c in ("unit", "bi", "bj")]
                same = np.logical_and.reduce([t[c].to_numpy() == v for c, v in zip(("unit", "bi", "bj"), last, strict=True)])
                stop = int(np.argmax(same))  # the last unit may go on
                if stop:
                    yield from solve(t.slice(0, stop))
                held = t.slice(stop).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return run


def _against_first(percent: int):
    """Adds to rows (key, unit, s1, s2, text, first, f1, f2, first_text) whether the line links with the first of its unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            ok = np.flatnonzero(alike(_sketches(batch), _sketches(batch, "f")))
            one, two = ([normalise(x) for x in b[c].take(pa.array(ok)).to_pylist()] for c in ("text", "first_text"))
            found = np.zeros(batch.num_rows, bool)
            found[ok] = within_many(one, two, _most(np.array([len(x) for x in one], np.int64), np.array([len(x) for x in two], np.int64), percent))
            yield pa.RecordBatch.from_arrays([b["key"], b["unit"], b["first"], pa.array(found)], ["key", "unit", "first", "linked"])

    return run


def _deal_rest(rows: DataFrame, unit: str) -> DataFrame:
    """Rows with `linked` (to the first line of their unit), so that each line that isn't meets all others of the unit once.

    Both sides come in parts of about UNIT; units whose lines are all linked with the first are done.
    """
    sizes = rows.groupBy(unit).agg(F.count("*").alias("_size"), F.sum((~F.col("linked")).cast("long")).alias("_rest")).where("_rest > 0")
    rows = rows.join(sizes, unit).withColumns({"_parts": F.ceil(F.col("_size") / UNIT).cast("int"), "_few": F.ceil(F.col("_rest") / UNIT).cast("int")})

    def part(of: str) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(3)), F.col(of)).cast("int")

    every = rows.withColumns({"bj": part("_parts"), "side": F.lit(0), "bi": F.explode(F.sequence(F.lit(0), F.col("_few") - 1))})
    rest = rows.where("NOT linked").withColumns({"bi": part("_few"), "side": F.lit(1), "bj": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    return every.unionByName(rest).drop("_size", "_rest", "_parts", "_few", "linked")


def find_groups(docs: DataFrame, scratch: Scratch, *, min_words: int = 4, min_fuzzy: int = 4, percent: int = 85, n_lines: int = MANY) -> DataFrame:
    """keepers: id, line of the occurrence that stays of each connected group of judged lines. docs: id, text."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    docs = docs.where("id IS NOT NULL")
    width, tables, count = settings(n_lines)
    found = docs.mapInArrow(tidy(_scan(min_words, min_fuzzy, count)), "id long, line int, key long, fuzzy boolean, hashes binary, length int")
    first = F.min(F.struct("id", "line")).alias("first")
    distinct = scratch.write(found.groupBy("key").agg(first, F.first("fuzzy").alias("fuzzy"), F.first("hashes").alias("hashes"), F.first("length").alias("length")), "distinct")

    # candidate clusters; only blocks of more than UNIT lines, which are few, are dealt again
    chosen = members(width, tables, count)

    def blocks(rows: DataFrame, n: int) -> DataFrame:
        tasks = min(max(-(-n * tables // PART_ROWS), 1), 100_000)
        parts = rows.select("key", "hashes", "length").mapInArrow(tidy(_explode_blocks(chosen, count, 4 * tasks)), "part int, data binary")
        return parts.repartition(tasks, "part")

    near = scratch.write(blocks(distinct.where("fuzzy"), distinct.count()).mapInArrow(tidy(_close_in_blocks), "a long, b long, c long, bucket long"), "near")
    large = near.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("key"), F.col("b").alias("s1"), F.col("c").alias("s2"))
    first = large.groupBy("bucket").agg(F.min(F.struct("key", "s1", "s2")).alias("first"))
    large = large.join(first, "bucket").select("bucket", "key", "s1", "s2", F.col("first.key").alias("first"), F.col("first.s1").alias("f1"), F.col("first.s2").alias("f2"))
    large = scratch.write(large.select("bucket", "key", "s1", "s2", "first", alike_column("s", "f").alias("linked")), "large")
    rest = _deal_rest(large.drop("first"), "bucket").groupBy("bucket", "bi", "bj").applyInArrow(_close_in_units, "a long, b long")
    near = near.where("bucket IS NULL").select("a", "b").unionByName(large.where("linked AND key <> first").select(F.col("key").alias("a"), F.col("first").alias("b"))).unionByName(rest)
    roots = scratch.write(components(scratch, near, "clusters"), "roots")
    held = roots.select(F.col("node").alias("key"), "root").unionByName(roots.select(F.col("root").alias("key"), "root").distinct())
    held = held.join(roots.groupBy("root").agg((F.count("*") + 1).alias("size")), "root")
    held = scratch.write(held.join(distinct.select("key", F.col("first.id").alias("id"), F.col("first.line").alias("line"), "hashes", "length"), "key"), "members")

    # units: clusters, or the blocks of a large one
    by_block = blocks(held.where(F.col("size") > UNIT), held.where(F.col("size") > UNIT).count()).mapInArrow(tidy(partial(_close_in_blocks, lines=True)), "key long, s1 long, s2 long, unit long").select("key", "unit")
    by_block = scratch.write(by_block.join(held.select("key", "root"), "key"), "by-block")
    by_block = by_block.join(by_block.groupBy("unit").agg(F.count("*").alias("size")), "unit")
    dealt = F.ceil(F.col("size") / UNIT)
    cost = by_block.groupBy("root").agg(F.sum(dealt).alias("cost"))
    apart = held.where(F.col("size") > UNIT).select("root", "size").distinct().join(cost, "root").where(F.col("size") * dealt > F.col("cost")).select("root")
    apart = scratch.write(apart, "apart")
    units = held.join(apart, "root", "left_anti").select("key", F.col("root").alias("unit"), "size").unionByName(by_block.join(apart, "root", "left_semi").select("key", "unit", "size"))
    units = scratch.write(units, "units")
    n_held, n_rows = held.count(), units.agg(F.sum(dealt)).first()[0] or 0

    # their lines, each from its first occurrence
    texts = lines_at(docs, held, n_held).dropDuplicates(["id", "line"])
    lines = scratch.write(held.join(texts, ["id", "line"]).mapInArrow(tidy(_with_sketch(count)), "key long, s1 long, s2 long, text binary"), "texts")
    small = units.where(F.col("size") <= UNIT).drop("size").join(lines, "key").withColumns({"bi": F.lit(0), "bj": F.lit(0), "side": F.lit(-1)})
    # a large unit meets its first line, and then what isn't linked with that meets all of it
    big = units.where(F.col("size") > UNIT).drop("size")
    firsts = big.groupBy("unit").agg(F.min("key").alias("first"))
    firsts = firsts.join(lines, firsts["first"] == lines["key"]).select("unit", "first", F.col("s1").alias("f1"), F.col("s2").alias("f2"), F.col("text").alias("first_text"))
    met = big.join(lines, "key").join(firsts, "unit").select("key", "unit", "s1", "s2", "text", "first", "f1", "f2", "first_text")
    met = scratch.write(met.mapInArrow(tidy(_against_first(percent)), "key long, unit long, first long, linked boolean"), "met")
    rest = _deal_rest(met.drop("first"), "unit").join(lines, "key")
    rows = small.unionByName(rest).select("unit", "bi", "bj", "side", "key", "s1", "s2", "text")
    # few bytes, but much to compute
    rows = rows.repartition(min(max(int(n_rows // 32_000), 1), 100_000), "unit", "bi", "bj").sortWithinPartitions("unit", "bi", "bj")
    links = rows.mapInArrow(tidy(_verify(percent)), "node long, root long")
    links = scratch.write(links.unionByName(met.where("linked AND key <> first").select(F.col("key").alias("node"), F.col("first").alias("root"))), "line-links")

    # the first occurrence of each group: only lines that are linked are grouped, all others keep their own
    joined = scratch.write(components(scratch, links, "lines"), "joined")
    firsts = distinct.select("key", "first")
    low = joined.join(firsts, joined["node"] == firsts["key"]).groupBy("root").agg(F.min("first").alias("low"))
    keep = firsts.join(joined.select(F.col("node").alias("key")), "key", "left_anti").join(low, F.col("key") == F.col("root"), "left")
    keep = keep.select(F.least("first", "low").alias("first"))
    return scratch.write(keep.select(F.col("first.id").alias("id"), F.col("first.line").alias("line")), "keepers")


def _with_sketch(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            both = sketch(_bytes(b["hashes"], count), b["length"].to_numpy())
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), b["text"]], ["key", "s1", "s2", "text"])

    return run


def _apply(text_at: int, names: list[str], min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch, names[text_at], most=1 << 20):
                x = Lines(data, offsets, part.num_rows, keys=False)
                judged = x.words >= min_words
                kept_lists = part.column(len(names))
                has_id = part.column(len(names) + 1).to_numpy(zero_copy_only=False)
                counts = pa.compute.fill_null(pa.compute.list_value_length(kept_lists), 0).to_numpy(zero_copy_only=False)
                flat = pa.compute.list_flatten(kept_lists).to_numpy(zero_copy_only=False).astype(np.int64)
                stays = np.zeros(len(x.start), bool)
                first = np.searchsorted(x.owner, np.arange(part.num_rows))
                size = np.bincount(x.owner, minlength=part.num_rows)
                owner = np.repeat(np.arange(part.num_rows), counts)
                inside = flat < size[owner]
                stays[first[owner[inside]] + flat[inside]] = True
                stays |= ~judged | ~has_id[x.owner].astype(bool)
                gone = np.bincount(x.owner[~stays], minlength=part.num_rows)
                cols = [*part.columns[: len(names)]]
                if gone.any():
                    raw, held = data.tobytes(), cols[text_at].is_valid().to_numpy(zero_copy_only=False)
                    texts = [raw[a:b] if ok else None for a, b, ok in zip(offsets[:-1].tolist(), offsets[1:].tolist(), held.tolist(), strict=True)]
                    for i in np.flatnonzero(gone):
                        rows = range(first[i], first[i] + size[i])
                        texts[i] = b"\n".join(raw[x.start[k] : x.end[k]] for k in rows if stays[k])
                    cols[text_at] = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.bincount(x.owner[judged], minlength=part.num_rows)), pa.array(gone)], [*names, "_judged", "_removed"])

    return run


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 4, min_fuzzy: int = 4, percent: int = 85, n_lines: int = MANY) -> DataFrame:
    """docs with the lines of all but one occurrence per group removed from text, and _judged, _removed (long): numbers of lines.

    n_lines: about how many distinct lines blocks are made for. More are compared as well, in fuller blocks.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("_judged", "_removed").withColumn(text_col, F.col(text_col).cast("string"))
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keepers = find_groups(narrow, scratch, min_words=min_words, min_fuzzy=min_fuzzy, percent=percent, n_lines=n_lines)
    names = docs.columns
    key, lines, has = fresh(docs, "key"), fresh(docs, "lines"), fresh(docs, "has")
    kept = keepers.groupBy(F.col("id").alias(key)).agg(F.collect_list("line").alias(lines))
    both = docs.join(kept, docs[id_col].cast("long") == kept[key], "left").select(*(docs[c] for c in names), lines, docs[id_col].isNotNull().alias(has))
    schema = T.StructType([*docs.schema.fields, T.StructField("_judged", T.LongType()), T.StructField("_removed", T.LongType())])
    return both.mapInArrow(tidy(_apply(names.index(text_col), names, min_words)), schema)
