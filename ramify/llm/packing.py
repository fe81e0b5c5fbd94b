"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack.

A document is its token ids and an end id; only documents longer than a sequence are cut, into full pieces and a rest.
The planner works on the histogram of piece lengths (at most `seq_len` numbers, however large the corpus): it takes
the longest length left, finds by bitset subset-sum dynamic programming the fullest feasible combination with it, and
removes that combination as often as the counts allow. A pattern uses up at least one length (but for a remainder),
so there are few patterns for any number of documents. Each piece then finds its sequence from its rank among the
pieces of its length, which salted windows and a table of (length, salt) counts give; a length has as many salts as
its pieces need.

Defined results: a null or empty text is the end id alone; repeated rows are packed each; a null id is kept; an empty
table gives an empty result; columns beyond id and text are ignored. Sequence numbers run from 0 without gaps.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, bounded_arrow, tidy

#: Pre-tokens that a worker's cache holds before it starts anew.
CACHE_TOKENS = 300_000

#: Texts of these characters alone need no normalisation but lower case, and their pre-tokens are plain to find:
#: ASCII but for control characters other than white space, and the accented letters of Latin-1.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The pre-tokens of the tokenizer file, for lower-case text of PLAIN's characters.
PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")


def _byte_names() -> list[str]:
    """The characters by which byte-level vocabularies name bytes: printable Latin-1 stays, the rest follow from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: The normaliser and the pre-tokens of tokenizer files for which PLAIN and PRE_TOKEN are right.
KNOWN = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class TokenCache(dict):
    """Pre-token to its ids as little-endian uint32 bytes; ids() gives those of a whole text.

    Files with another normaliser or other pre-tokens than KNOWN go through the whole tokenizer.

    Plain texts are cut by PRE_TOKEN and only new pre-tokens go to the vocabulary's merges. Other texts are cut at
    ASCII white space, which no pre-token crosses, and words that aren't plain go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # each part by itself, as the whole file with its vocabulary takes much memory
        normalizer, pre_tokenizer = (json.loads(x.__getstate__()) if x else {} for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        parts = {"normalizer": normalizer.get("normalizers"), "pre_tokenizer": pre_tokenizer.get("pretokenizers")}
        self.known = parts == KNOWN
        self.names = _byte_names()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, token: str) -> bytes:
        name = token if token.isascii() else "".join(self.names[b] for b in token.encode())
        if len(self) > CACHE_TOKENS:
            self.clear()
        ids = self[token] = array("I", [t.id for t in self.model.tokenize(name)]).tobytes()
        return ids

    def ids(self, text: str) -> bytes:
        if self.known and not any(s in text for s in self.special):
            if PLAIN.fullmatch(text):
                return b"".join(map(self.__getitem__, PRE_TOKEN.findall(text.lower())))
            if not text.isascii():
                return b"".join(self.ids(w) if PLAIN.fullmatch(w) else self._encode(w) for w in ASCII_SPACE.split(text) if w)
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


ASCII_SPACE = re.compile(r"[ \t-\r]+")


def _cache(path: str) -> TokenCache:
    """One cache for a worker process, which serves many tasks."""
    held = sys.__dict__.setdefault("_ramify_tokens", {})
    if path not in held:
        held[path] = TokenCache(path)
    return held[path]


def _pieces(path: str, seq_len: int, end_id: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(path)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                whole = cache.ids(text.as_py() or "") + end
                for k in range(0, len(whole), 4 * seq_len):
                    part = whole[k : k + 4 * seq_len]
                    at.append(i), piece.append(k // (4 * seq_len)), start.append(k // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            out = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names)

    return run


def tokenize(docs: DataFrame, tokenizer: str, *, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces: id long, piece int, start, length, ids_crc32 long, and with_ids: ids binary (little-endian uint32)."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_pieces(tokenizer, seq_len, end_id, with_ids)), "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


# ---------------------------------------------------------------- planning


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of a combination whose sum comes closest to room from below: bitset subset-sum, longest first.

    Bit s of a set says that s can be reached; it stops once room itself can.
    """
    reach, steps = 1, []
    mask, want = (1 << (room + 1)) - 1, 1 << room
    for length in order:
        if length > room:
            continue
        left = min(counts[length], room // length)
        take = 1
        while left:  # copies in powers of two, as items of one piece each
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | (reach << (length * take))) & mask
            left -= take
            take *= 2
            if reach & want:
                break
        if reach & want:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return list(used.items())


def plan(histogram: dict[int, int], seq_len: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (repeats, [(length, copies)]) that use up the histogram. No pattern exceeds seq_len."""
    counts = {k: v for k, v in histogram.items() if v}
    order = sorted(counts, reverse=True)
    out = []
    while order:
        longest = order[0]
        counts[longest] -= 1
        pattern = dict(fullest(counts, order, seq_len - longest))
        counts[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        repeats = min(counts[k] // n for k, n in pattern.items())
        out.append((repeats, sorted(pattern.items(), reverse=True)))
        for k, n in pattern.items():
            counts[k] -= repeats * n
        if any(counts[k] == 0 for k in pattern):
            order = [k for k in order if counts[k]]
    return out


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in a sequence, first offset), sorted by length and rank."""
    cursor: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, pattern in patterns:
        offset = 0
        for length, n in pattern:
            rows.append((length, cursor.get(length, 0), sequence, n, offset))
            cursor[length] = cursor.get(length, 0) + repeats * n
            offset += length * n
        sequence += repeats
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assign(places: np.ndarray, base: dict[tuple[int, int], int]):
    lengths = np.unique(places[:, 0])
    lo, hi = np.searchsorted(places[:, 0], lengths), np.searchsorted(places[:, 0], lengths, "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, row = (batch.column(k).to_numpy() for k in ("length", "salt", "row"))
            first = np.array([base[k] for k in zip(length.tolist(), salt.tolist(), strict=True)], np.int64)
            rank = first + row - 1
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    k = np.searchsorted(lengths, length[part[0]])
                    p = places[lo[k] : hi[k]]
                    p = p[np.searchsorted(p[:, 1], rank[part], "right") - 1]
                    past = rank[part] - p[:, 1]
                    sequence[part] = p[:, 2] + past // p[:, 3]
                    offset[part] = p[:, 4] + past % p[:, 3] * p[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.select(["id", "piece", "start", "length", "ids_crc32"]).columns, pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, *, seq_len: int = 2048, rows_per_salt: int = 200_000) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset, both long.

    Pieces of a length are numbered in as many parts (salts) as their number needs, so no window holds much more than
    rows_per_salt. What comes to the driver: a count for each length and part. Pieces themselves move once, to be
    numbered.
    """
    spark = pieces.sparkSession
    parts = {r["length"]: -(-r["count"] // rows_per_salt) for r in pieces.groupBy("length").count().collect()}
    several = {k: n for k, n in parts.items() if n > 1}
    salts = F.lit(1)
    if several:  # at most seq_len entries
        salts = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x).cast("long") for kv in sorted(several.items()) for x in kv)), F.col("length")), F.lit(1))
    rows = pieces.select("id", "piece", "start", "length", "ids_crc32", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), salts).cast("int").alias("salt"))
    counts = sorted(tuple(r) for r in rows.groupBy("length", "salt").count().collect())
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for length, salt, n in counts:
        base[length, salt] = histogram.get(length, 0)
        histogram[length] = base[length, salt] + n
    places = _places(plan(histogram, seq_len))
    numbered = rows.withColumn("row", F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")).cast("long"))
    bounded_arrow(spark)
    return numbered.mapInArrow(tidy(_assign(places, base)), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, *, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """tokenize() and pack(): id_col, piece, start, length, ids_crc32, sequence_id, offset. Pieces are written once in between."""
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(tokenize(docs, tokenizer, seq_len=seq_len, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return pack(pieces, seq_len=seq_len).withColumnRenamed("id", id_col)


def sequences(placed: DataFrame, pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids binary (little-endian uint32) of whole sequences, from placed pieces and tokenize(with_ids=True).

    A sequence holds seq_len ids at most, so its group is bounded.
    """
    both = placed.join(pieces.select(F.col("id").alias(id_col), "piece", "ids_crc32", "ids").dropDuplicates([id_col, "piece", "ids_crc32"]), [id_col, "piece", "ids_crc32"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    return both.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
