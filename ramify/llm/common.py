"""What several operators share: scratch tables, bounded Arrow batches, hashed words, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import drop_path, scratch_path



def keep_memory(most: int = 32 << 20) -> None:
    """With glibc, this process keeps up to `most` bytes it frees: arrays of a slice take them again, not new pages."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    mallopt(-1, most)  # M_TRIM_THRESHOLD
    mallopt(-3, most)  # M_MMAP_THRESHOLD


keep_memory()  # in each Python worker, as its functions come from here


def release_memory() -> None:
    """Gives free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow after which a worker holds no free memory: workers wait for further tasks beside those that work."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return tidied

#: Bytes of the 256 that separate words: space and \t to \r.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, *range(9, 14)]] = True
#: Word separators as a (Java and Python) character class.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name in df.columns:
        name += "_"
    return name


# ---------------------------------------------------------------- scratch tables


#: Whether the shuffle files of a query go when it ends (Spark 4.1), not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Intermediate tables of one operator call, written as Parquet where all executors can read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """Writes df and returns a reader of it: lineage ends here, lost executors lose nothing, and shuffle files go at once."""
        path = scratch_path(self.spark, tag)
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)
        self.paths[tag] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            drop_path(self.spark, self.paths.pop(tag))


def bounded_arrow(spark: SparkSession) -> None:
    """Arrow batches end by bytes too, so that very long texts cannot fill a Python worker; a smaller setting stays.

    The buffers of a batch of 2 MB come from the JVM's pool of 4 MB chunks; larger ones are allocated one by one, and the
    freed ones stay with each thread's share of the C heap.
    """
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)):
        now = spark.conf.get(key, None) or ""  # nothing where the session sets none, though Spark itself then takes 64 MB
        value = int(now.rstrip("bB")) if now.rstrip("bB").lstrip("-").isdigit() else 0
        if value <= 0 or value > most:
            spark.conf.set(key, str(most))


# ---------------------------------------------------------------- words of Arrow text


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with their UTF-8 bytes and offsets. A slice holds up to `most` bytes, or one text. Null: empty."""
    k = batch.schema.get_field_index(column)
    col = batch.column(k).fill_null("")
    if not len(col):
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, where, data = col.buffers()
    offsets = np.frombuffer(where, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop


_RNG = np.random.default_rng(20240517)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
#: Powers that a process keeps (16 MB with their inverses); longer texts have their own.
POWERS_KEPT = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            p, q = np.full(size, _P), np.full(size, _P_INV)
            p[0] = q[0] = 1
            np.multiply.accumulate(p, out=p), np.multiply.accumulate(q, out=q)
        if size > POWERS_KEPT:
            return p, q
        _POWERS, _INVERSES = p, q
    return _POWERS, _INVERSES


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts: 64-bit hashes, text index, start and end bytes. A word never crosses texts.

    A hash is a polynomial over random 64-bit values of the bytes, by one running sum for all words.
    """
    n = len(data)
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    inside = ~IS_SPACE[data]
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    powers, inverses = _powers(n + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[:n], out=run[1:])
        hashes = mix((run[ends] - run[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def shingles_of(hashes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (hash, text index), sorted by text, then hash. A text of fewer words: all of it as one."""
    counts = np.bincount(doc, minlength=n_docs)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    with np.errstate(over="ignore"):
        full = np.maximum(len(hashes) - width + 1, 0)
        value = np.zeros(full, np.uint64)
        for k in range(width):
            value = value * _P + hashes[k : k + full]
        same = doc[:full] == doc[width - 1 : width - 1 + full] if full else np.zeros(0, bool)
        value, owner = mix(value[same]), doc[:full][same]
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            extra = []
            for d in short:
                v = np.uint64(counts[d])
                for h in hashes[firsts[d] : firsts[d] + counts[d]]:
                    v = v * _P + h
                extra.append(v)
            value, owner = np.concatenate([value, mix(np.array(extra, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[keep], owner[keep]


# ---------------------------------------------------------------- texts of some ids


def id_bits(ids: DataFrame, n_bits: int = 1 << 24) -> np.ndarray:
    """A bit table of fixed size (2 MB) over the hashes of ids (column id): who isn't in it isn't among them."""
    h = F.xxhash64("id").bitwiseAND(F.lit(n_bits - 1))
    words = ids.select(h.alias("h")).groupBy(F.expr("shiftright(h, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS int)))").alias("b"))
    table = np.zeros(n_bits >> 6, np.int64)
    got = words.toArrow()  # in one job: 16 bytes for a word of the table at most; an iterator runs a job for each partition
    table[got["w"].to_numpy()] = got["b"].to_numpy()
    return table.view(np.uint64)


def by_bits(df: DataFrame, table: np.ndarray, inside: bool) -> DataFrame:
    """Rows of df whose id may be in the table, or those whose id surely isn't."""
    mask = len(table) * 64 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(batch.num_columns - 1).to_numpy() & mask
            hit = (table[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.filter(pa.array(hit == inside)).select(list(range(batch.num_columns - 1)))

    return df.withColumn("_h", F.xxhash64("id")).mapInArrow(tidy(run), df.schema)


def texts_of(docs: DataFrame, units: DataFrame) -> DataFrame:
    """docs (id, text) joined with units on id. A bit table drops most other texts before the shuffle."""
    return by_bits(docs.select("id", "text"), id_bits(units), True).join(units, "id")


# ---------------------------------------------------------------- connected components


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list that are not the least of their component, and that least node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[ia], label[ib])
        new = label.copy()
        np.minimum.at(new, label[ia], low)
        np.minimum.at(new, label[ib], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


#: Copies of a root that moves, over which the nodes below it are spread.
SALTS = 16
#: Links that a task contracts (4 MB). As many or fewer are one task's, so that their rounds end.
LINKS_A_TASK = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size > 1_000_000:  # what is held shrinks to a forest before more comes
            a, b = local_roots(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held, size = [], 0
    if held:
        a, b = local_roots(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
    for at in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["node", "root"])


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges (two long columns, no nulls): node, root for every node but the roots themselves.

    Links are contracted to forests where they are, so that a hub has one link a partition at most, and dealt by
    their larger end. Each round contracts every partition again and replaces each root by its own root; only roots
    that move are joined, spread over SALTS copies, as many rows may share one. It ends when a round changes nothing, or
    when one task can contract what is left. The links are counted, so tasks that contract follow their number, not
    the number of shuffle partitions.
    """
    one, two = edges.columns
    links = edges.select(F.greatest(one, two).alias("node"), F.least(one, two).alias("root")).where("node <> root").mapInArrow(tidy(_contract), "node long, root long")
    links = scratch.write(links, f"{tag}-links")
    last, n, before = f"{tag}-links", links.count(), None
    for i in range(60):
        parts = -(-n // LINKS_A_TASK)
        if parts > 1:
            parts = max(parts, links.sparkSession.sparkContext.defaultParallelism)
        forest = (links if parts <= 1 else links.repartition("node")).coalesce(max(1, parts)).mapInArrow(tidy(_contract), "node long, root long")
        forest = scratch.write(forest, f"{tag}-forest{i}")
        scratch.drop(last)
        if parts <= 1:
            return forest
        up = forest.groupBy(F.col("node").alias("up")).agg(F.min("root").alias("top"))
        roots = forest.select("root").distinct()
        moves = roots.join(up, roots["root"] == up["up"]).select("up", "top", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = forest.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        links = salted.join(moves, (salted["root"] == moves["up"]) & (salted["_salt"] == moves["salt"]), "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved"))
        last = f"{tag}-links{i}"
        links = scratch.write(links, last)
        scratch.drop(f"{tag}-forest{i}")
        now = tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)), F.bit_xor(F.xxhash64("node", "root"))).first())
        if now[1] == 0 and (now[0] == 0 or (before is not None and before[0] == now[0] and before[2] == now[2])):
            break
        if now[1] == 0 and links.groupBy("node").count().where("count > 1").isEmpty():
            break
        before, n = now, now[0]
        links = links.select("node", "root")
    else:
        raise RuntimeError("components did not converge")
    return links.select("node", "root").distinct()


def with_component(ids: DataFrame, scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """ids (one long column id) with component: the least id reachable by edges, the id itself included."""
    roots = components(scratch, edges, tag)
    return ids.join(roots, ids["id"] == roots["node"], "left").select("id", F.coalesce("root", "id").alias("component"))
