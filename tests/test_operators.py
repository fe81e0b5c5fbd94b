"""Operators against cases computed by hand, and their invariants."""

import math
import time

import pytest
from pyspark.sql import functions as F

from ramify.core import assert_schema, at_most, dedupe_first, EngineError, total_rank, with_ordinal
from ramify.functions import text
from ramify.operators import channels, enrichment, hierarchy, joins, setops, stats

EDGES = [("b", "a"), ("c", "b"), ("d", "b"), ("d", "c"), ("e", "d")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(c, p, "is_a") for c, p in EDGES], "child string, parent string, relation string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_closure(spark, edges):
    want = {("b", "a"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c"), ("e", "a"), ("e", "b"), ("e", "c"), ("e", "d")}
    assert pairs(hierarchy.closure(edges).select("term", "ancestor")) == want
    cycle = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert pairs(hierarchy.closure(cycle).select("term", "ancestor")) == {(x, y) for x in "ab" for y in "ab"}
    assert pairs(hierarchy.ancestors(edges, "d")) == {("a",), ("b",), ("c",), ("d",)}
    assert pairs(hierarchy.descendants(edges, "c")) == {("c",), ("d",), ("e",)}
    assert hierarchy.closure(edges.limit(0)).count() == 0


def test_closure_of_a_diamond_does_not_enumerate_paths(spark):
    rows = [(f"{i + 1}{x}", f"{i}{y}") for i in range(20) for x in "lr" for y in "lr"]
    assert hierarchy.closure(spark.createDataFrame(rows, "child string, parent string")).count() == sum(4 * k for k in range(1, 21))


def test_propagate_and_multifunctionality(spark, edges):
    facts = spark.createDataFrame([("g1", "d"), ("g2", "c"), ("g3", "b")], "entity string, term string")
    up = hierarchy.propagate(facts, hierarchy.closure(edges), entity="entity", term="term")
    ranked = {r["entity"]: r for r in enrichment.mf_rank(enrichment.mf_score(up, entity="entity", term="term"), entity="entity").collect()}
    assert [ranked[g]["n_annotations"] for g in ("g1", "g2", "g3")] == [4, 3, 2]
    assert [round(ranked[g]["mf_score"], 12) for g in ("g1", "g2", "g3")] == [1.0, 0.5, 0.0]
    assert [ranked[g]["mf_rank"] for g in ("g1", "g2", "g3")] == [1, 2, 3]
    assert [ranked[g]["mf_percentile"] for g in ("g1", "g2", "g3")] == pytest.approx([1, 2 / 3, 1 / 3])
    with pytest.raises(EngineError):
        enrichment.mf_rank(spark.createDataFrame([("g", 1.0)], "entity string, mf_score double"), entity="entity")


def test_neighbours_and_search(spark, edges):
    nodes = spark.createDataFrame([(x, f"Term {x}", '"A def." [ref]', ['"Other" EXACT []'] if x == "c" else []) for x in "abcde"], "id string, name string, def string, synonyms array<string>")
    assert {r["id"] for r in hierarchy.parents(edges, nodes, "d").collect()} == {"b", "c"}
    assert {r["id"] for r in hierarchy.children(edges, nodes, "b").collect()} == {"c", "d"}
    with pytest.raises(EngineError):
        hierarchy.parents(edges, nodes, "zz")
    assert tuple(hierarchy.definition(nodes, "c").first()) == ("c", "Term c", "A def.", ["Other"])
    found = [(r["term_id"], r["score"]) for r in hierarchy.term_search(nodes, "OTHER").collect()]
    assert found == [("c", 0.5)] and hierarchy.term_search(nodes, "term", limit=2).count() == 2


def test_annotations(spark, edges):
    facts = spark.createDataFrame([("g", "c", "IDA", "q"), ("g", "b", "IDA", "q")], "gene_id string, term_id string, evidence_code string, qualifier string")
    rows = hierarchy.annotations_of(facts, hierarchy.closure(edges), entity_filter=F.col("gene_id") == "g").collect()
    assert {(r["term_id"], r["propagated"], r["propagated_from"]) for r in rows} == {("c", False, None), ("b", False, None), ("a", True, "b")}
    below = hierarchy.facts_with(facts, edges, "b").collect()
    assert {(r["term_id"], r["propagated"]) for r in below} == {("b", False), ("c", True)}
    assert hierarchy.facts_with(facts, edges, "b", direct_only=True).count() == 1


def test_hypergeometric(spark):
    cases = [(10, 4, 5, 3), (10, 4, 5, 0), (50, 0, 5, 1), (200, 60, 40, 20), (10, 9, 8, 7), (10, 9, 8, 8), (20000, 800, 300, 40)]
    df = spark.createDataFrame(cases, "a long, b long, c long, d long")
    got = [r["p"] for r in df.select(enrichment.hypergeom_sf(*(F.col(x) for x in "abcd")).alias("p")).collect()]
    for (N, K, n, k), p in zip(cases, got, strict=True):
        want = 1.0 if min(k, K, n) <= 0 else sum(math.comb(K, x) * math.comb(N - K, n - x) for x in range(k, min(K, n) + 1)) / math.comb(N, n)
        assert p == pytest.approx(want, rel=1e-9)
    assert got[0] == pytest.approx(66 / 252)


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.04, 0.5, 0.01])], "i int, pvalue double")
    q = [r["qvalue"] for r in enrichment.bh_qvalues(df).orderBy("i").collect()]
    assert q == pytest.approx([0.03, 0.048, 0.048, 0.048, 0.5, 0.03])
    values = [(i * 7919 % 1013) / 1013 for i in range(3000)]
    ranked = sorted(range(3000), key=lambda i: values[i])
    want, least = {}, 1.0
    for rank in range(3000, 0, -1):
        least = min(least, values[ranked[rank - 1]] * 3000 / rank)
        want[ranked[rank - 1]] = least
    df = spark.createDataFrame([*enumerate(values), (3000, None)], "i int, pvalue double")
    for few in (False, True):
        found = {r["i"]: r["qvalue"] for r in enrichment.bh_qvalues(df, few=few).collect()}
        assert found.pop(3000) is None and found == pytest.approx(want)


def test_null_draws_are_uniform_sets():
    """Every set of two of five ranks comes equally often, so the mean average precision is that over all sets."""
    draws = enrichment._null_draws(5, 2, 0, 0, 40_000)
    every = [(1 / a + 2 / b) / 2 for a in range(1, 6) for b in range(a + 1, 6)]
    assert {round(x, 9) for x in draws} == {round(x, 9) for x in every} and draws.mean() == pytest.approx(sum(every) / 10, abs=0.005)
    counts = [sum(abs(draws - x) < 1e-9) for x in every]
    assert min(counts) > 3600 and max(counts) < 4400
    assert enrichment._null_draws(4, 4, 0, 0, 3).tolist() == [1.0, 1.0, 1.0]


def test_hexagons_equal_brute_force(spark):
    """Each point belongs to the nearest of all centres."""
    points = [((i * 7919 % 1009) / 10, (i * 104729 % 997) / 7) for i in range(500)]
    df = spark.createDataFrame(points, "x double, y double")
    got = {(r["hx"], r["hy"]): r["count"] for r in stats.hexbin(df, "x", "y", 12).collect()}
    (x0, x1), (y0, y1) = ((min(c), max(c)) for c in zip(*points, strict=True))
    rows = max(1, int(12 / math.sqrt(3)))
    centres = [(a, b) for a in range(14) for b in range(rows + 2)] + [(a + 0.5, b + 0.5) for a in range(-1, 14) for b in range(-1, rows + 2)]
    want = {}
    for x, y in points:
        u, v = (x - x0) / (x1 - x0) * 12, (y - y0) / (y1 - y0) * rows
        best = min(centres, key=lambda c: ((u - c[0]) ** 2 + 3 * (v - c[1]) ** 2, c[0] == int(c[0]), -c[0], -c[1]))
        want[best] = want.get(best, 0) + 1
    assert got == want and sum(got.values()) == 500


def test_average_precision_and_nulls(spark):
    ranks = spark.createDataFrame([(f"m{i}", i) for i in range(1, 7)], "member string, rank int")
    sets = spark.createDataFrame([("s", m) for m in ("m1", "m3", "m4", "zz")], "set_id string, member string")
    assert enrichment.average_precision(ranks, sets).first()["pr_auc"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 3)
    obs = spark.createDataFrame([("s", 3, 0.8)], "set_id string, size int, v double")
    null = spark.createDataFrame([(3, [0.9, 0.8, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])], "size int, null array<double>")
    assert enrichment.empirical_p(obs, null, value="v", size="size", name="p", permutations=9).first()["p"] == pytest.approx(0.3)
    sizes = spark.createDataFrame([(3,), (3,), (5,)], "size int")
    a, b = (sorted(map(tuple, ((r["size"], r["chunk"], tuple(r["null"])) for r in enrichment.permutation_null(sizes, 50, permutations=70, chunk=30).collect()))) for _ in range(2))
    assert a == b and sum(len(x[2]) for x in a) == 140 and len({x[0] for x in a}) == 2


def test_ora_and_pr_invariants(spark):
    sets = spark.createDataFrame([(f"s{i % 4}", f"m{i}") for i in range(80)] + [("empty", "zz")], "set_id string, member string")
    members = spark.createDataFrame([(f"m{i}", float(i)) for i in range(70)], "member string, score double")
    hits = members.where("score < 20")
    rows = enrichment.ora(sets, hits, members, mf=members.withColumn("mf_percentile", F.col("score") / 70)).collect()
    assert len(rows) == 4 and all(abs(r["expected_hits"] - r["set_size_after_filter"] * 20 / 70) < 1e-9 for r in rows)
    assert all(0 <= r["pvalue"] <= r["qvalue"] <= 1 for r in rows) and all(r["mf_baseline_n_hits_in_set"] <= 20 for r in rows)
    assert [r["pvalue"] for r in rows] == sorted(r["pvalue"] for r in rows)
    out = enrichment.pr_enrichment(members, sets, permutations=50, mf=members.withColumn("mf_percentile", F.col("score") / 70)).collect()
    assert len(out) == 4 and all(1 / 51 <= r["pvalue"] <= 1 and r["n_genes_in_input"] == 70 for r in out)


def test_compose(spark):
    a = spark.createDataFrame([(1, "a1"), (2, "a2"), (3, "a3"), (None, "n")], "key int, label string")
    b = spark.createDataFrame([(2, "b2"), (3, "b3"), (4, "b4")], "key int, label string")
    union = {r["key"]: (r["label"], r["sources"]) for r in setops.compose([("A", a), ("B", b)], "union", "key", ["label"]).collect()}
    assert union == {1: ("a1", ["A"]), 2: ("a2", ["A", "B"]), 3: ("a3", ["A", "B"]), 4: ("b4", ["B"])}
    both = setops.compose([("A", a), ("B", b), ("B", b)], "intersection", "key", ["label"])
    assert {r["key"] for r in both.collect()} == {2, 3}
    for bad in (lambda: setops.compose([], "union", "key"), lambda: setops.compose([("A", a)], "xor", "key"), lambda: setops.compose([("A", a), ("B", b)], "union", "key", uniform=["label"])):
        with pytest.raises(EngineError):
            bad()
    assert setops.is_subset(b.where("key < 4"), a, "key") and not setops.is_subset(b, a, "key")


def test_band_join(spark):
    g = spark.createDataFrame([("p", "+", 1000), ("n1", "-", 900), ("n2", "-", 1500), ("n3", "-", 2001)], "id string, strand string, tss long").withColumn("chr", F.lit("1"))
    out = joins.band_join(g, by=["chr"], pos="tss", side=F.col("strand") == "+", distance=1000, keys=["id"]).collect()
    assert len(out) == 4 and {(r["left_id"], r["right_id"], r["gap"]) for r in out if r["left_id"] == "p"} == {("p", "n1", 100), ("p", "n2", 500)}
    assert joins.band_join(g, by=["chr"], pos="tss", side=F.col("strand") == "+", distance=1000, keys=["id"], divergent_only=True).count() == 2
    assert joins.band_join(g, by=["chr"], pos="tss", side=F.col("strand") == "+", distance=0, keys=["id"]).count() == 0


def test_statistics(spark):
    df = spark.createDataFrame([(8, 10), (0, 0)], "k int, n int")
    lo, hi = stats.wilson_interval(F.col("k"), F.col("n"))
    a, b = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (a["lo"], a["hi"]) == pytest.approx((0.309843, 0.143319), abs=1e-5) and tuple(b) == (0, 0)
    s = spark.createDataFrame([(0, 10, 4, 6), (0, 10, 4, 12), (0, 10, 10, 12), (0, 10, 4, -1)], "a int, b int, d int, t int")
    assert [r[0] for r in s.select(stats.schedule_variance(*(F.col(c) for c in "abdt"))).collect()] == ["behind", "overdue", "complete", "not_started"]
    v = spark.createDataFrame([("g", float(x)) for x in (0, 1, 2, 3, 100)], "g string, v double")
    assert tuple(stats.box_stats(v, "g", "v").first()) == ("g", 5, 1.0, 2.0, 3.0, 0.0, 3.0)
    assert sum(r["count"] for r in stats.histogram(v, "g", "v").collect()) == 5
    d = stats.kde(v.where("v < 4"), "g", "v", points=400).orderBy("x").collect()
    assert sum((y["x"] - x["x"]) * (x["density"] + y["density"]) / 2 for x, y in zip(d, d[1:], strict=False)) == pytest.approx(1, abs=0.02)
    bounded = stats.kde(v.where("v < 4").withColumn("v", F.col("v") / 3), "g", "v", points=400, lower=0.0, upper=1.0).orderBy("x").collect()
    assert sum((y["x"] - x["x"]) * (x["density"] + y["density"]) / 2 for x, y in zip(bounded, bounded[1:], strict=False)) == pytest.approx(1, abs=0.1)
    assert stats.zscore_clip(v, "g", "v", limit=1.5).agg(F.max("z")).first()[0] == 1.5
    assert stats.suggest_log(v, "v").first()[0] is False


def test_order_and_channels(spark):
    df = spark.createDataFrame([(i, i % 3, f"x{i}") for i in range(30)], "i int, g int, x string")
    assert {(r["g"], r["i"]) for r in dedupe_first(df, ["g"], [F.desc("i")]).collect()} == {(0, 27), (1, 28), (2, 29)}
    assert sorted((r["i"], r["rank"]) for r in total_rank(df, [F.desc("i")]).collect()) == [(i, 30 - i) for i in range(30)]
    assert [r["i"] for r in sorted(with_ordinal(df).collect(), key=lambda r: r["ordinal"])] == list(range(30))
    many = spark.range(0, 3000, 1, 7).select("id", (F.col("id") * 7919 % 1009).alias("v"))
    want = {r: k for k, r in enumerate(sorted(range(3000), key=lambda i: (-(i * 7919 % 1009), i)), 1)}
    assert {r["id"]: r["rank"] for r in total_rank(many, [F.desc("v"), F.asc("id")]).collect()} == want
    assert total_rank(many.limit(0), [F.asc("id")]).count() == 0
    with pytest.raises(EngineError):
        assert_schema(df, ["nope"], "test")
    grouped = channels.group_tuple(df, "g", ["i"])
    assert grouped.where("g = 1").first()["x"] == [f"x{i}" for i in range(1, 30, 3)]
    assert pairs(channels.transpose(grouped, ["i", "x"]).select("i", "g", "x")) == pairs(df)
    assert channels.if_empty(df.limit(0), df.limit(2)).count() == 2 and channels.if_empty(df, df.limit(2)).count() == 30
    assert channels.branch(df, "b", low=F.col("i") < 10, high=F.col("i") > 25).groupBy("b").count().count() == 2
    assert channels.combine(df.limit(3), df.limit(4).select(F.col("i").alias("j"))).count() == 12
    assert [r["part"] for r in channels.concat(df.limit(1), df.limit(1)).orderBy("part").collect()] == [0, 1]


def test_small_summaries_and_bounds(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, None)], "ordinal int, g string")
    assert {(r["g"], r["position"]) for r in stats.group_order(df, "g").collect()} == {("b", 0), ("a", 1)}
    assert {(r["g"], r["position"], r["found"]) for r in stats.group_order(df, "g", ["a", "zz"]).collect()} == {("a", 0, True), ("zz", 1, False)}
    top = spark.createDataFrame([("d", "t2", 1), ("d", "t1", 1), ("e", "x", 9)], "database string, term string, rank int")
    assert {tuple(r) for r in stats.top_terms(top).collect()} == {("d", 2, "t1"), ("e", 1, "x")}
    assert at_most(df, 4, "x") is df
    with pytest.raises(EngineError):
        at_most(df, 3, "x")


def test_years_in_addresses_are_passed_over(spark):
    rows = [("see http://a.example.com/en/1950?page=2 in 1960", 1960), ("(https://a.example.com/2010/)(2001)", 2001), ("HTTPS://a.example.com/1999", None), ("n (1850), 2120 and (2003)", 2003), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want int")
    assert all(r["year"] == r["want"] for r in df.withColumn("year", text.extract_year(F.col("t"))).collect())


def test_rectangles_equal_brute_force(spark):
    """Boxes over many tiles, on their edges and turned round, and equal rows; pairs are not made distinct, and a small table is dealt too."""
    boxes = [(f"b{i % 2}", i, (i * 37 % 50) / 2, (i * 53 % 41) / 2, (i * 37 % 50) / 2 + i * 7 % 13 - 1, (i * 53 % 41) / 2 + i * 5 % 11 - 1) for i in range(120)]
    box = "x0 double, y0 double, x1 double, y1 double"
    left, right = spark.createDataFrame([*boxes[:60], *boxes[:9]], f"g string, a int, {box}"), spark.createDataFrame([*boxes[60:], *boxes[60:70]], f"g string, b int, {box}")
    out = joins.rect_overlap_join(left, right, by=["g"], grow=1.0, tile=2.0)
    want = sorted((a[1], b[1]) for a in boxes[:60] for b in boxes[60:] if a[0] == b[0] and a[2] - 1 <= b[4] and a[4] + 1 >= b[2] and a[3] - 1 <= b[5] and a[5] + 1 >= b[3])
    assert want and sorted((r["a"], r["right_b"]) for r in out.collect()) == want
    assert out.columns == ["g", "a", "x0", "y0", "x1", "y1", "right_b", "right_x0", "right_y0", "right_x1", "right_y1"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate") and "Broadcast" not in plan


def test_null_draws_of_large_sets_and_their_tasks(spark):
    """48,000 of 1.2 million ranks take no step for each member; chunks are dealt over tasks, however narrow their rows."""
    began = time.process_time()
    draws = enrichment._null_draws(1_200_000, 48_000, 0, 0, 40)
    assert len(draws) == 40 and time.process_time() - began < 3 and draws.mean() == pytest.approx(0.04, abs=0.001) and len(set(draws)) == 40
    one = enrichment._null_draws(1000, 1, 0, 0, 50_000)
    assert one.mean() == pytest.approx(sum(1 / i for i in range(1, 1001)) / 1000, abs=0.001)
    null = enrichment.permutation_null(spark.createDataFrame([(3,), (5,)], "size int"), 50, permutations=800, chunk=10)
    assert null.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 4
