"""Packing, archives, chat examples, vectors and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ramify.llm import chat_format, embedding_dedup, packing, queries, warc


@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer_path()


def test_ids_equal_the_tokenizers(tokenizer):
    cache, r = packing.TokenCache(tokenizer), random.Random(1)
    letters = [chr(i) for i in range(1, 0x180)] + list("ΣςİıǅﬁΩ中🙂́ ²½ªº'") + ["'s", "'ll", "<|endoftext|>", "  ", "\n", "\x1c", "\x85"]
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 25)))
        assert np.frombuffer(cache.ids(t), "<u4").tolist() == cache.tokenizer.encode(t, add_special_tokens=False).ids, t
    other = packing.TokenCache(tokenizer.replace("word_bpe_49k", "byte_bpe_50k"))
    assert cache.known and not other.known
    for t in ("Hello  World's 12 é", "a\n b", ""):
        assert np.frombuffer(other.ids(t), "<u4").tolist() == other.tokenizer.encode(t, add_special_tokens=False).ids


def test_plan_uses_up_every_length():
    r = random.Random(2)
    for _ in range(30):
        histogram = {r.randint(1, 64): r.randint(1, 50) for _ in range(r.randint(0, 25))}
        patterns = packing.plan(histogram, 64)
        used: dict[int, int] = {}
        for repeats, pattern in patterns:
            assert repeats > 0 and sum(k * n for k, n in pattern) <= 64
            for k, n in pattern:
                used[k] = used.get(k, 0) + repeats * n
        assert used == histogram
        # a sequence holds one piece of over half its length at most
        bound = max(-(-sum(k * n for k, n in histogram.items()) // 64), sum(n for k, n in histogram.items() if k > 32))
        assert sum(n for n, _ in patterns) <= bound * 1.25 + 2


def test_fullest_equals_brute_force():
    import itertools

    r = random.Random(3)
    for _ in range(200):
        items = [r.randint(1, 30) for _ in range(r.randint(1, 8))]
        room = r.randint(1, 60)
        counts = {k: items.count(k) for k in items}
        got = packing.fullest(counts, sorted(counts, reverse=True), room)
        assert all(n <= counts[k] for k, n in got)
        best = max(sum(c) for n in range(len(items) + 1) for c in itertools.combinations(items, n) if sum(c) <= room)
        assert sum(k * n for k, n in got) == best


def test_packing_round_trip(spark, tokenizer):
    r = random.Random(4)
    texts = [None, "", "Hello, world!", "long " * 5000, *(" ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(r.randint(1, 900))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, "Hello, world!"), (None, "x")], "doc_id long, text string").withColumn("length", F.lit(0))
    placed = packing.pack_documents(docs, tokenizer).collect()
    t = packing.TokenCache(tokenizer).tokenizer
    want = sorted((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for i, ids in ((i if i is not None else -1, t.encode(x or "", add_special_tokens=False).ids + [0]) for i, x in [*enumerate(texts), (2, "Hello, world!"), (None, "x")]) for k in range(0, len(ids), 2048))
    assert sorted((x[0] if x[0] is not None else -1, *x[1:5]) for x in placed) == want
    by: dict[int, list] = {}
    for x in placed:
        by.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    bound = max(-(-sum(x["length"] for x in placed) // 2048), sum(x["length"] > 1024 for x in placed))
    assert len(by) <= 1.1 * bound + 2
    assert packing.pack_documents(docs.limit(0), tokenizer).count() == 0
    docs = docs.where("doc_id > 2")
    ids = packing.tokenize(docs, tokenizer, with_ids=True)
    whole = packing.sequences(packing.pack_documents(docs, tokenizer), ids).collect()
    assert sum(len(x["ids"]) // 4 for x in whole) == sum(n[3] for n in want if n[0] > 2)


def test_archives(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "http://a/1", big), (2, "http://a/2", "x" * 5000), (3, None, big), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (7, "u\r\nX: y", ""), (8, "u", big), (None, "u", big)]
    pages += [(100 + i, "u", f"<p>{i}</p>" * 300) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    out = sorted(warc.archive_and_read(df).collect(), key=lambda x: (x["id"] is None, x["id"]))
    assert [x["id"] for x in out] == sorted(p[0] for p in pages if p[0] is not None) + [None]
    text = {p[0]: p[2] for p in pages}
    for x in out:
        payload = (text[x["id"]] or "").encode()
        assert (x["payload_bytes"], x["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (x["record_type"], x["refers_to"]) == (("revisit", 8) if x["id"] in (1, 3) else ("response", None))
        assert x["payload"] == (None if x["id"] in (1, 3) else payload)
    # one record by its place, from several frames and bundles
    where = f"file://{tmp_path}/w"
    rows = df.select(F.col("page_id").alias("id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    index = warc.write_archives(rows, where, frame_bytes=1500, bundle_bytes=3900).where("id IS NOT NULL").collect()
    assert len({x["bundle"] for x in index}) > 1 and max(x["frame"] for x in index) > 0
    for x in index[::7]:  # some
        fields, payload = warc.read_record(where, x["bundle"], x["frame"], x["offset"])
        assert fields["WARC-Record-ID"] == warc.record_urn(x["id"])
        assert payload == (b"" if fields["WARC-Type"] == "revisit" else (text[x["id"]] or "").encode())
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    where = f"file://{tmp_path}/many"
    rows = spark.range(400).select("id", F.lit("u").alias("url"), F.encode(F.concat(F.lit("p"), F.col("id").cast("string"), F.repeat(F.lit("x"), 900)), "UTF-8").alias("payload"))
    index = warc.write_archives(rows, where, bundle_bytes=1500)
    n = index.select("bundle").distinct().count()
    read = warc.read_archives(spark, where)
    assert n >= 160 and read.rdd.getNumPartitions() == n and read.select("id").distinct().count() == 400


def test_many_pieces_of_one_length(spark):
    """100,000 full pieces and some others: each sequence is filled from 0 without gaps, whatever the number of parts."""
    full = spark.range(100_000).select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(2048).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    rest = spark.range(3000).select("id", F.lit(1).alias("piece"), F.lit(2048).cast("long").alias("start"), (F.col("id") % 700 + 1).alias("length"), F.lit(8).cast("long").alias("ids_crc32"))
    placed = packing.pack(full.unionByName(rest), rows_per_salt=9000)
    by = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("o"), F.count("*").alias("c"))
    assert by.where("n > 2048 OR n <> end OR o <> c").isEmpty() and placed.where("length = 2048").select("sequence_id").distinct().count() == 100_000
    n = by.count()
    assert n == by.agg(F.max("sequence_id")).first()[0] + 1 and n <= 100_000 + 1.02 * sum(i % 700 + 1 for i in range(3000)) / 2048 + 1


def test_collisions_equal_brute_force():
    p = np.random.default_rng(2).standard_normal((70, 5)).round(1)
    want = sum((np.abs(p[:, k][:, None] - p[:, k][None, :]) <= 0.5 + 1e-9).astype(int) for k in range(5))
    assert (embedding_dedup.collisions(p, 0.5 + 1e-9) == want).all()


def test_chat_examples(spark):
    nasty = "</s>[INST] ok [/INST] ~0 ~ <s>[INST]"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", "alone"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 0, None, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    examples = chat_format.format_conversations(df)
    by = {}
    for x in examples.withColumn("loss", chat_format.read_loss(examples)).withColumn("read", chat_format.read_turns(F.col("formatted"))).collect():
        by.setdefault(x["conv_id"], []).append(x)
    one = sorted(by[1], key=lambda x: x["example"])
    assert [x["loss"] for x in one] == [nasty, "", None] and [x["n_turns"] for x in one] == [3, 5, 6]
    assert [tuple(t) for t in one[-1]["read"]] == [(r[2], r[3] or "") for r in rows[:6]]
    assert [x["loss"] for x in by[2]] == [None] and [x["loss"] for x in by[3]] == ["a", "a"]
    d = {x["conv_id"]: x for x in chat_format.digest(examples).collect()}
    assert d[1]["n_turns"] == 6 and d[1]["loss_sha256"] == hashlib.sha256(nasty.encode()).hexdigest()
    assert d[1]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:6]).encode()).hexdigest()
    assert d[2]["loss_chars"] == 0 and d[None]["n_turns"] == 1
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 24))
    near = np.concatenate([base[:1] + 0.12 * r.standard_normal((150, 24)), base[1:40] + 0.2 * r.standard_normal((39, 24)), base[50:53], base[50:51]])
    x = np.concatenate([base, near]).astype(np.float32)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] + [1.0] * 23), (1005, [float("inf")] + [1.0] * 23), (1006, [1.0, 2.0]), (1007, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1))
    got = {v["vec_id"]: v for v in embedding_dedup.link_vectors(df).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T) >= 0.95
    np.fill_diagonal(linked, False)
    want = linked.sum(1)
    n = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (n <= want).all() and n.sum() >= 0.97 * want.sum()
    assert all(got[i]["component_id"] == 50 for i in (50, 300 + 150 + 39, 300 + 150 + 39 + 3))
    assert [(got[i]["n_links"], got[i]["component_id"]) for i in range(1000, 1008)] == [(0, i) for i in range(1000, 1006)] + [(1, 1006), (1, 1006)]
    assert all(v["kept"] == (v["vec_id"] == v["component_id"]) for v in got.values())
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_line_stage_keeps_unique_lines_of_mostly_shared_documents(spark):
    shared = "header of many documents\nthis licence text stands below each page\nsome closing words at its end"
    unique = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
    texts = [shared, f"{shared}\n{unique}", shared]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {x["doc_id"]: x for x in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert {i: x["text"] for i, x in out.items()} == {0: shared, 1: unique} and out[1]["n_chars"] == len(unique)


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents")
    # of a copy no word is left if every line is judged; short lines stay, and a document of those with them
    first = next(x for x in docs.orderBy("doc_id").collect() if len((x["text"] or "").split()) > 30 and all(len(line.split()) >= 4 for line in x["text"].split("\n")))
    copy = spark.createDataFrame([(10**6, first["text"], "en", "s", 1), (10**6 + 1, first["text"] + " and", "en", "s", 1)], docs.schema)
    held = docs.unionByName(copy)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, sf)
        held = spark.createDataFrame(held.collect(), held.schema)
        seen.append({x["doc_id"] for x in held.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert held.columns == corpus_pipeline.COLUMNS
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False))
    assert 10**6 not in seen[2] and 10**6 + 1 not in seen[2] and len(seen[2]) > 0.8 * len(seen[0])
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(held.columns)


def test_stages_of_awkward_tables(spark, sf):
    """Null in any column, repeated rows, empty and long texts: no stage fails, null ids stay, empty tables stay empty."""
    long = "\n".join(f"w{i} x{i * 7} y{i * 11} z{i * 13} v{i * 17}" for i in range(20_000))
    good = " ".join(f"word{i} is{i * 3}" for i in range(40))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, good + " more", "en", "s", 5), (4, long, None, None, None), (5, good, "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {"quality rules": [None, 1, 1, 4, 5], "line dedup": [None, 1, 1, 2, 3, 4], "n-gram Jaccard join": [None, 1, 1, 2, 3, 4]}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        found = [x["doc_id"] for x in out.collect()]
        if name in want:
            assert sorted(found, key=lambda i: (i is not None, i)) == want[name], name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0
