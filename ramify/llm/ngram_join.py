"""N-gram Jaccard self-join of texts by adaptive multi-match prefixes.

A document's set is its distinct word shingles. Shingles have one global order: rare ones first, by counts from a
fixed-size sketch over all documents (any order is exact; a good one is fast), then by hash. Of two documents that
link, the first |x| - o + l shingles of each share at least l, where o is the overlap that the threshold asks of |x|.
Each document takes the l of 1 to LEVELS that is cheapest by the lengths of its prefix's posting lists: a longer
prefix costs more list entries, but l shared shingles leave fewer candidates to verify. Steps:

1. sketch the shingle counts; 2. sets, their digests and prefixes; equal sets collapse to one representative;
3. posting lists of prefix shingles; each document's l from the lists' lengths; 4. short lists give candidate pairs,
which need l shared shingles; long lists link each entry with the list's first; 5. candidates form families, which
are dealt in blocks; a task counts shared prefix shingles of its two blocks, verifies the pairs that reach l on the
whole sets, and returns a spanning forest of the links, so no group is expanded into pairs; 6. components.
A family whose lists (or pairs) come to fewer rows than its blocks is dealt by those instead.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text of fewer words than the
shingle width has one shingle, its whole sequence; rows with a null id get a null component and link with nothing;
rows that share an id are one node, which has the links of each; an empty table gives an empty result; columns beyond
id and text are ignored. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, bounded_arrow, by_bits, components, id_bits, local_roots, mix, shingles_of, text_slices, texts_of, tidy, words_of

LEVELS = 4
#: Counters of the sketch, summed in blocks of 2^BLOCK_BITS. The lowest quarter of the hashes, from which nearly all
#: prefixes come, has 2^FINE_BITS of them and the rest 2^COARSE_BITS.
FINE_BITS, COARSE_BITS, BLOCK_BITS = 22, 20, 14
N_COUNTERS = (1 << FINE_BITS) + (1 << COARSE_BITS)
#: Posting lists up to this length give pairs; longer ones give a link to their first entry.
SHORT_LIST = 32
#: Documents of a block in a family.
BLOCK = 192


def overlap(n, percent: int):
    """Least intersection that a set of n shares with any set it links with."""
    return -(-percent * n // 100)


# ---------------------------------------------------------------- order by counts


def counter_of(value: np.ndarray) -> np.ndarray:
    fine = (value >> np.uint64(62 - FINE_BITS)).astype(np.int64)
    return np.where(fine < 1 << FINE_BITS, fine, (1 << FINE_BITS) + (value >> np.uint64(64 - COARSE_BITS)).astype(np.int64))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(N_COUNTERS, np.uint32)
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                h, doc, _, _ = words_of(data, offsets)
                value, _ = shingles_of(h, doc, part.num_rows, width)
                at, n = np.unique(counter_of(value), return_counts=True)
                counts[at] += n.astype(np.uint32)
        if counts.any():
            blocks = counts.reshape(-1, 1 << BLOCK_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks))), pa.array([zlib.compress(b.tobytes(), 1) for b in blocks], pa.binary())], ["block", "counts"])

    return run


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums a partition's blocks as they come; returns counters far above the mean of their block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
            sums[block] = sums[block] + got if block in sums else got
    for block, counts in sums.items():
        mean = counts.mean()
        at = np.flatnonzero(counts > mean + 8 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array((block << BLOCK_BITS) + at), pa.array(counts[at])], ["counter", "n"])


def heavy_counters(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters far above the mean, and their class (eighths of a power of two). At most N_COUNTERS, however large the input."""
    rows = docs.select("text").mapInArrow(tidy(_sketch(width)), "block long, counts binary").repartition("block").mapInArrow(tidy(_heavy), "counter long, n long").toPandas()
    rows = rows.sort_values("counter")
    return rows["counter"].to_numpy(np.int64), (8 * np.log2(np.maximum(rows["n"].to_numpy(np.float64), 2))).astype(np.int16)


# ---------------------------------------------------------------- sets and prefixes


class Sets:
    """Sets of a slice of texts, ordered globally: value and owner sorted by owner, then rank of the shingle."""

    def __init__(self, data, offsets, n: int, width: int, heavy: tuple[np.ndarray, np.ndarray]):
        h, doc, _, _ = words_of(data, offsets)
        value, owner = shingles_of(h, doc, n, width)
        counters, classes = heavy
        kind = np.zeros(len(value), np.int16)
        if len(counters):
            c = counter_of(value)
            at = np.minimum(np.searchsorted(counters, c), len(counters) - 1)
            kind = np.where(counters[at] == c, classes[at], 0).astype(np.int16)
        order = np.lexsort((value, kind, owner))  # within a counter by the whole hash
        self.value, self.owner = value[order], owner[order]
        self.size = np.bincount(owner, minlength=n)
        self.first = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.rank = np.arange(len(value)) - self.first[self.owner]


def _signatures(width: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_slices(batch):
                s = Sets(data, offsets, part.num_rows, width, heavy)
                with np.errstate(over="ignore"):
                    sums = [np.zeros(len(s.value) + 1, np.uint64) for _ in range(2)]
                    np.cumsum(mix(s.value + np.uint64(1)), out=sums[0][1:])
                    np.cumsum(mix(s.value ^ np.uint64(0x5DEECE66D1234567)), out=sums[1][1:])
                    h1, h2 = (x[s.first + s.size] - x[s.first] for x in sums)
                keep = s.rank < np.minimum(s.size, s.size - overlap(s.size, percent) + LEVELS)[s.owner]
                lengths = np.bincount(s.owner[keep], minlength=part.num_rows)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(s.value[keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.size.astype(np.int64)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), tokens], ["id", "n", "h1", "h2", "tokens"])

    return run


# ---------------------------------------------------------------- blocks of families


def _counts(token: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Common tokens of each two of n documents, by products of 0/1 matrices over slices of the shared tokens."""
    out = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    label = np.cumsum(new) - 1
    shared = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
    doc, label = doc[shared], label[shared]
    if not len(doc):
        return out
    _, label = np.unique(label, return_inverse=True)
    step = 2048
    for at in range(0, int(label[-1]) + 1, step):
        lo, hi = np.searchsorted(label, [at, at + step])
        m = np.zeros((n, step), np.float32)
        m[doc[lo:hi], label[lo:hi] - at] = 1
        out += m @ m.T
    return out


def _verify(width: int, percent: int, heavy):
    def run(group: pa.Table) -> pa.Table:
        ids, level, side = group["id"].to_numpy(), group["level"].to_numpy(), group["side"].to_numpy()
        value, owner, rank, size = [], [], [], []
        for batch in group.select(["text"]).combine_chunks().to_batches():
            for part, data, offsets in text_slices(batch):
                s = Sets(data, offsets, part.num_rows, width, heavy)
                value.append(s.value), owner.append(s.owner + sum(map(len, size))), rank.append(s.rank), size.append(s.size)
        value, owner, rank, size = (np.concatenate(x) for x in (value, owner, rank, size))
        n = len(ids)
        depth = rank - (size - overlap(size, percent))[owner]  # below 1: in the prefix for l = 1
        bigger = np.where(size[:, None] >= size[None, :], level[:, None], level[None, :])
        bigger = np.where(size[:, None] == size[None, :], np.minimum(level[:, None], level[None, :]), bigger)
        need = np.zeros((n, n), bool)
        for k in np.unique(level):
            in_prefix = depth < k
            need |= (bigger == k) & (_counts(value[in_prefix], owner[in_prefix], n) >= k)
        need &= np.triu(np.ones((n, n), bool), 1) & ((side[:, None] != side[None, :]) | (side.min() == side.max()))
        a, b = np.nonzero(need)
        if len(a):
            common = _counts(value, owner, n)[a, b].astype(np.int64)
            linked = (100 + percent) * common >= percent * (size[a] + size[b])
            a, b = local_roots(ids[a[linked]], ids[b[linked]])
        return pa.table({"node": pa.array(a if len(a) else [], pa.int64()), "root": pa.array(b if len(a) else [], pa.int64())})

    return run


def _families(scratch: Scratch, edges: DataFrame, keys: DataFrame, tag: str, kind: int = 0) -> tuple[DataFrame, DataFrame]:
    """Components of candidate edges as units (id, unit, size), but for those that cost more rows than their keys do.

    keys: (key, cost, id), the other way to deal a component, with an id in it, a key once. Returns the units, and the
    keys that stay, with their cost.
    """
    roots = scratch.write(components(scratch, edges, tag), f"{tag}-roots")
    members = roots.select(F.col("node").alias("id"), "root").unionByName(roots.select(F.col("root").alias("id"), "root").distinct())
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("size"))
    keyed = keys.join(members, "id").groupBy("root").agg(F.sum("cost").alias("cost"))
    choice = sizes.join(keyed, "root").select("root", "size", (F.col("size") * F.ceil(F.col("size") / BLOCK) <= F.col("cost")).alias("whole"))
    choice = scratch.write(choice, f"{tag}-choice")
    units = members.join(choice.where("whole"), "root").select("id", F.struct(F.lit(kind).alias("kind"), F.col("root").alias("key")).alias("unit"), "size")
    apart = members.join(choice.where("NOT whole"), "root").select("id")
    return units, keys.join(apart, "id").select("key", "cost")


def link_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles long, component_id long (least id reachable by links, itself included)."""
    spark = docs.sparkSession
    bounded_arrow(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    heavy = heavy_counters(docs, width)

    sig = scratch.write(docs.mapInArrow(tidy(_signatures(width, percent, heavy)), "id long, n long, h1 long, h2 long, tokens array<long>"), "sig")
    narrow = scratch.write(sig.select("id", "n", "h1", "h2"), "narrow")
    full = narrow.where("n > 0 AND id IS NOT NULL")
    sets = scratch.write(full.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "sets")

    # posting lists of the representatives' prefixes, without those of one entry; only ids that may be no
    # representative are joined, so most prefixes move once
    p1 = F.expr(f"n - (({percent} * n + 99) div 100) + 1")
    wide = sig.where("n > 0 AND id IS NOT NULL").select("id", "n", "tokens")
    reps = sets.select(F.col("rep").alias("id")).distinct()
    bits = id_bits(full.select("id").distinct().join(reps, "id", "left_anti"))
    own = by_bits(wide, bits, False).unionByName(by_bits(wide, bits, True).join(reps, "id", "left_semi"))
    post = own.select("id", "n", F.posexplode("tokens").alias("pos", "token"))
    post = post.select("id", "n", "token", F.greatest(F.lit(1), F.col("pos") - p1 + 2).cast("int").alias("level"))
    lists = post.withColumn("df", F.count("*").over(W.partitionBy("token"))).where("df > 1")
    lists = scratch.write(lists, "lists")
    scratch.drop("sig")

    # l of each document: entries to read, and candidates (at most entries / l) to verify
    cost = lists.groupBy("id", "n").agg(*(F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)).alias(f"s{k}") for k in range(1, LEVELS + 1)))
    by_level = [F.struct((F.col(f"s{k}") * (1 + (20 + F.col("n") / 4) / k)).alias("cost"), F.lit(k).alias("l")) for k in range(1, LEVELS + 1)]
    room = F.expr(f"({percent} * n + 99) div 100")
    level = F.array_min(F.filter(F.array(*by_level), lambda x: x["l"] <= F.greatest(F.lit(1), room)))["l"]
    levels = scratch.write(cost.select("id", level.alias("l")), "levels")

    entries = scratch.write(lists.join(levels, "id").where(f"level <= {LEVELS}"), "entries")

    scratch.drop("lists")

    # short lists: pairs that share l shingles of them; what also shares one of a long list is met there
    short = entries.where(F.col("df") <= SHORT_LIST).select("token", "id", "n", "level", "l")
    y = short.select(*(F.col(c).alias(f"y_{c}") for c in short.columns))
    near = (F.col("token") == F.col("y_token")) & (F.struct("n", "id") > F.struct("y_n", "y_id")) & (100 * F.col("y_n") >= percent * F.col("n"))
    # of equal sizes either may be the probe: the smaller l holds
    probe = F.when(F.col("n") == F.col("y_n"), F.least("l", "y_l")).otherwise(F.col("l"))
    pairs = short.join(y, near).withColumn("need", probe).where("level <= need AND y_level <= need")
    pairs = pairs.groupBy("id", "y_id").agg(F.count("*").alias("m"), F.first("need").alias("need")).where("m >= need")
    pairs = scratch.write(pairs.select(F.col("id").alias("a"), F.col("y_id").alias("b")), "pairs")
    blocks = F.ceil(F.col("size") / BLOCK)
    families, fallback = _families(scratch, pairs, pairs.groupBy("b").agg((F.count("*") + 1).alias("cost")).select(F.col("b").alias("key"), "cost", F.col("b").alias("id")), "short")
    stars_of = pairs.select(F.col("a").alias("id"), F.col("b").alias("key")).unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("key")).distinct())
    # a star's cost is its number of documents
    units = [families, stars_of.join(fallback, "key").select("id", F.struct(F.lit(1).alias("kind"), "key").alias("unit"), F.col("cost").alias("size"))]

    # long lists: the families that they form, or the lists themselves, whichever means fewer rows
    long = entries.where(F.col("df") > SHORT_LIST)
    first = long.groupBy("token").agg(F.min("id").alias("b"), F.count("*").alias("size"))
    stars = long.select("token", F.col("id").alias("a")).join(first, "token").where("a <> b").select("a", "b").distinct()
    families, fallback = _families(scratch, stars, first.select(F.col("token").alias("key"), (F.col("size") * blocks).alias("cost"), F.col("b").alias("id")), "long", kind=2)
    units += [families, long.select("id", F.col("token").alias("key"), F.col("df").alias("size")).join(fallback, "key", "left_semi").select("id", F.struct(F.lit(3).alias("kind"), "key").alias("unit"), "size")]

    # blocks of at most BLOCK documents or so; each two blocks of a unit meet in one task
    units = units[0].unionByName(units[1]).unionByName(units[2]).unionByName(units[3])
    units = units.join(levels, "id", "left").select("id", F.coalesce("l", F.lit(1)).alias("level"), "unit", blocks.cast("int").alias("blocks"))
    units = units.withColumn("block", F.expr("cast(pmod(xxhash64(id, 7), blocks) AS int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = units.select("id", "level", "unit", "block", other)
    dealt = dealt.select("id", "level", "unit", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), (F.col("block") > F.col("other")).cast("int").alias("side"))
    dealt = scratch.write(dealt, "dealt")

    grouped = texts_of(docs.where("id IS NOT NULL"), dealt).groupBy("unit", "bi", "bj")
    links = scratch.write(grouped.applyInArrow(_verify(width, percent, heavy), "node long, root long"), "links")

    # equal sets link with their representative
    same = full.select("id", "h1", "h2", "n").join(sets, ["h1", "h2", "n"]).where("id <> rep").select(F.col("id").alias("node"), F.col("rep").alias("root"))
    found = components(scratch, links.unionByName(same), "links")
    return (
        narrow.select("id", "n").join(found.withColumnRenamed("node", "id"), "id", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    )
