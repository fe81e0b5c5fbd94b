"""Queries over the test tables, one per operator, and the SQL that says the same.

Entities and sets are mapped onto the tables: brands are sets of parts, suppliers have facts about part sizes, and the
sizes form a graph in which k has the parents k div 2 and k div 3.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .core import dedupe_first, scratch_path, total_rank
from .functions import text as X
from .operators import channels, enrichment, hierarchy, joins, setops, stats
from .sources import annotation, files, references, sinks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- the mapping


def _brands(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("member"))


def _sold(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("member")).distinct()


def _hits(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_partkey").alias("member")).distinct()


def _edges(spark):
    half = spark.range(2, 51).select(F.col("id").cast("int").alias("child"), F.expr("cast(id div 2 AS int)").alias("parent"), F.lit("is_a").alias("relation"))
    third = spark.range(3, 51).select(F.col("id").cast("int").alias("child"), F.expr("cast(id div 3 AS int)").alias("parent"), F.lit("part_of").alias("relation"))
    return half.unionByName(third).where("parent >= 1")


def _facts(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber = 1 AND l_quantity > 45").select("l_partkey", "l_suppkey")
    return li.join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("entity"), F.col("p_size").alias("term")).distinct()


def _scores(spark, d):
    facts = hierarchy.propagate(_facts(spark, d), hierarchy.closure(_edges(spark)), entity="entity", term="term")
    return enrichment.mf_score(facts, entity="entity", term="term")


EDGES_SQL = "SELECT k AS child, k // 2 AS parent FROM range(2, 51) t(k) UNION SELECT k, k // 3 FROM range(3, 51) t(k) WHERE k // 3 >= 1"
FACTS_SQL = "SELECT DISTINCT l_suppkey AS entity, p_size AS term FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND l_quantity > 45"
CLOSURE_SQL = f"e AS ({EDGES_SQL}), c(term, ancestor) AS (SELECT child, parent FROM e UNION SELECT c.term, e.parent FROM c JOIN e ON c.ancestor = e.child)"
PROPAGATED_SQL = f"{CLOSURE_SQL}, f AS ({FACTS_SQL}), p AS (SELECT entity, term FROM f UNION SELECT entity, ancestor FROM f JOIN c USING (term))"
MF_SQL = f"""{PROPAGATED_SQL}, t AS (SELECT term, count(*) AS n FROM p GROUP BY term), tot AS (SELECT count(DISTINCT entity) AS total FROM p),
    w AS (SELECT term, CASE WHEN n < total THEN 1.0::DOUBLE / (n * (total - n)) ELSE 0 END AS w FROM t, tot),
    mf AS (SELECT entity, count(*) AS n_annotations, sum(w) AS mf_score FROM p JOIN w USING (term) GROUP BY entity)"""


def _hyper_sql(N: str, K: str, n: str, k: str) -> str:
    choose = lambda a, b: f"(lgamma(({a}) + 1) - lgamma(({b}) + 1) - lgamma(({a}) - ({b}) + 1))"
    term = f"exp({choose(K, 'x')} + {choose(f'{N} - {K}', f'{n} - x')} - {choose(N, n)})"
    return f"CASE WHEN {k} <= 0 OR {K} <= 0 OR {n} <= 0 THEN 1.0 ELSE least(1.0, list_sum([{term} for x in range(greatest({k}, {n} - ({N} - {K}))::BIGINT, least({K}, {n})::BIGINT + 1)])) END"


def _bh_sql(src: str, p: str, q: str) -> str:
    return f"""SELECT * EXCLUDE (_r, _m), least(1.0, min({p} * _m / _r) OVER (ORDER BY _r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {q}
    FROM (SELECT *, row_number() OVER (ORDER BY {p}) AS _r, count(*) OVER () AS _m FROM {src})"""


ORA_SQL = f"""bg AS (SELECT DISTINCT l_partkey AS m FROM lineitem), h AS (SELECT DISTINCT l_partkey AS m FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49),
    s AS (SELECT p_brand AS set_id, p_partkey AS m FROM part),
    x AS (SELECT set_id, count(*) AS set_size, count(bg.m) AS k_all, count(h.m) AS k FROM s LEFT JOIN bg USING (m) LEFT JOIN h USING (m) GROUP BY set_id),
    tot AS (SELECT (SELECT count(*) FROM bg)::DOUBLE AS big_n, (SELECT count(*) FROM h)::DOUBLE AS n),
    pv AS (SELECT set_id, set_size, k_all, k, k_all * n / big_n AS expected, {_hyper_sql('big_n', 'k_all', 'n', 'k')} AS p FROM x, tot WHERE k_all BETWEEN 5 AND 1000000)"""


# ---------------------------------------------------------------- queries


def ora(spark, d):
    out = enrichment.ora(_brands(spark, d), _hits(spark, d), _sold(spark, d), max_size=1_000_000)
    return out.select("set_id", "set_size", "set_size_after_filter", "n_hits_in_set", F.round("expected_hits", 9).alias("expected_hits"), F.round("fold_enrichment", 9).alias("fold_enrichment"), F.round("pvalue", 9).alias("pvalue"), F.round("qvalue", 9).alias("qvalue"))


def _part_mf(spark, d):
    facts = table(spark, d, "lineitem").select(F.col("l_partkey").alias("member"), (F.col("l_suppkey") % 10).alias("term"))
    return enrichment.mf_rank(enrichment.mf_score(facts, entity="member", term="term"), entity="member")


def ora_mf_baseline(spark, d):
    out = enrichment.ora(_brands(spark, d), _hits(spark, d), _sold(spark, d), max_size=1_000_000, mf=_part_mf(spark, d))
    return out.select("set_id", "n_hits_in_set", "mf_baseline_n_hits_in_set", F.round("mf_baseline_pvalue", 8).alias("mf_baseline_pvalue"), F.round("mf_baseline_qvalue", 8).alias("mf_baseline_qvalue"))


def closure(spark, d):
    return hierarchy.closure(_edges(spark))


def ancestors(spark, d):
    return hierarchy.ancestors(_edges(spark), 42)


def descendants(spark, d):
    return hierarchy.descendants(_edges(spark), 5)


def propagate(spark, d):
    return hierarchy.propagate(_facts(spark, d), hierarchy.closure(_edges(spark)), entity="entity", term="term")


def mf_score(spark, d):
    return _scores(spark, d).withColumn("mf_score", F.round("mf_score", 12))


def mf_rank(spark, d):
    return enrichment.mf_rank(_scores(spark, d), entity="entity", places=10).select("entity", "mf_rank", F.round("mf_percentile", 12).alias("mf_percentile"))


def mf_baseline_hits(spark, d):
    return enrichment.mf_baseline_hits(enrichment.mf_rank(_scores(spark, d), entity="entity", places=10), table(spark, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("entity")), 10, member="entity")


def parents(spark, d):
    nodes = spark.range(1, 51).select(F.col("id").cast("int").alias("id"))
    return hierarchy.parents(_edges(spark), nodes, 36, relations=None)


def children(spark, d):
    nodes = spark.range(1, 51).select(F.col("id").cast("int").alias("id"))
    return hierarchy.children(_edges(spark), nodes, 7)


def term_search(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_type").alias("synonyms"))
    return hierarchy.term_search(nodes, "RE")


def facts_with(spark, d):
    return hierarchy.facts_with(_facts(spark, d), _edges(spark), 5, term="term")


def annotations_of(spark, d):
    rows = _facts(spark, d).withColumns({"evidence": F.when(F.col("term") % 2 == 0, "A").otherwise("B")})
    return hierarchy.annotations_of(rows, hierarchy.closure(_edges(spark)), entity_filter=F.lit(True), key=("entity", "term", "evidence"), term="term")


def ortholog_map(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    homology = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("target"), F.when(F.col("o_orderstatus") == "F", "ortholog_one2one").otherwise("ortholog_one2many").alias("homology_type"))
    return hierarchy.ortholog_map(ids, homology)


def average_precision(spark, d):
    revenue = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.sum((F.col("l_quantity")).cast("long")).alias("score"))
    ranks = enrichment.rank_entities(revenue, entity="member", score="score")
    return enrichment.average_precision(ranks, _brands(spark, d)).withColumn("pr_auc", F.round("pr_auc", 10))


def pr_enrichment(spark, d):
    revenue = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))
    return enrichment.pr_enrichment(revenue, _brands(spark, d), max_size=1_000_000, mf=_part_mf(spark, d))


def bh_qvalues(spark, d):
    p = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 10007) / 10007).alias("pvalue"))
    return enrichment.bh_qvalues(p).select("o_orderkey", F.round("qvalue", 10).alias("qvalue"))


def _customer_sets(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("label"))
    by = lambda cond, label: o.where(cond).select(F.col("o_custkey").alias("key"), F.lit(label).alias("label")).distinct()
    return [("urgent", by("o_orderpriority = '1-URGENT'", "urgent")), ("open", by("o_orderstatus = 'O'", "open")), ("building", c.where("label = 'BUILDING'"))]


def compose_union(spark, d):
    return setops.compose(_customer_sets(spark, d), "union", "key", ["label"]).withColumn("sources", F.array_join("sources", ";"))


def compose_intersection(spark, d):
    return setops.compose(_customer_sets(spark, d), "intersection", "key", ["label"]).withColumn("sources", F.array_join("sources", ";"))


def terms_diff(spark, d):
    s = _customer_sets(spark, d)
    return setops.terms_diff(s[0][1], s[2][1], "key")


def set_minus(spark, d):
    s = _customer_sets(spark, d)
    return setops.set_minus(s[0][1], s[2][1], "key")


def set_and(spark, d):
    s = _customer_sets(spark, d)
    return setops.set_and(s[0][1], s[2][1], "key")


def cross_union(spark, d):
    return setops.cross_union([df.select("key", "label") for _, df in _customer_sets(spark, d)], "key")


def band_join(spark, d):
    e = table(spark, d, "events").where("event_type IN ('click', 'error')").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return joins.band_join(e, by=["user_id"], pos="us", side=F.col("event_type") == "click", distance=3_600_000_000, keys=["event_id"]).select("user_id", "left_event_id", "right_event_id", "gap")


def semi_join(spark, d):
    return joins.semi_join(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def anti_join(spark, d):
    return joins.anti_join(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def left_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    return joins.left_lookup(o, c, "c_custkey", {"c_mktsegment": ""})


def symbol_resolve(spark, d):
    names = table(spark, d, "nation").select(F.lower("n_name").alias("name"))
    return joins.symbol_resolve(names, table(spark, d, "nation").select("n_name", "n_nationkey"), "name", "n_name")


def rect_overlap(spark, d):
    p = table(spark, d, "part")
    box = [F.col("p_size").cast("double").alias("x0"), (F.col("p_retailprice") % 50).alias("y0"), (F.col("p_size") + 1.5).alias("x1"), (F.col("p_retailprice") % 50 + 2).alias("y1")]
    a = p.where("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("word"), *box)
    b = p.where("p_partkey % 2 = 1").select("p_brand", F.col("p_partkey").alias("mark"), *box)
    return joins.rect_overlap_join(a, b, by=["p_brand"], grow=1.0, tile=10.0).select("p_brand", "word", "right_mark")


def dedupe_first_(spark, d):
    return dedupe_first(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


def topk(spark, d):
    return stats.topk(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 25)


def topk_by(spark, d):
    return stats.topk(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, by=["o_custkey"])


def top_terms(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("database"), F.col("p_name").alias("term"), F.col("p_retailprice").alias("rank"))
    return stats.top_terms(p)


def group_order(spark, d):
    return stats.group_order(table(spark, d, "part"), "p_type", by="p_partkey").select("p_type", "position")


def collect_values(spark, d):
    return channels.collect(table(spark, d, "nation"), "n_name", ["n_regionkey", "n_name"]).select(F.array_join("n_name", ";").alias("names"))


def total_rank_(spark, d):
    return total_rank(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")])


def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text("text").alias("plain"))


def extract_year(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("n (1850), "), F.coalesce("url", F.lit("")), F.lit(" in "), (1890 + F.col("page_id") % 230).cast("string"), F.lit(" and (2001)")).alias("t"))
    return p.select("page_id", X.extract_year(F.col("t")).alias("year"))


def extract_doi(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("see https://doi.org/10.1186/"), F.when(F.col("page_id") % 3 == 0, "science").otherwise("s13059-014-"), (F.col("page_id") % 7 * F.when(F.col("page_id") % 3 == 0, 0).otherwise(1)).cast("string"), F.lit("). x")).alias("t"))
    return p.select("page_id", X.extract_doi(F.col("t")).alias("doi"), X.clean_doi(X.extract_doi(F.col("t")), least=8).alias("clean"))


def first_author(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.first_author(F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, ", A. B.").otherwise(" Last"), F.lit(" and Other, C."))).alias("author"))


def term_uris(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "GO:").otherwise("EFO:"), F.col("p_size").cast("string")).alias("term"))
    return t.select("p_partkey", X.to_uri(F.col("term")).alias("uri"), X.to_compact(X.to_uri(F.col("term"))).alias("compact"), X.infer_ontology(F.col("term")).alias("ontology"))


def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat_ws(" - ", "p_name", "p_type")).alias("slug"), X.banner(F.col("p_name")).alias("banner"), X.col_letter(F.col("p_partkey") % 18000 + 1).alias("letter"))


def sha256(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"))


def title_similarity(spark, d):
    # whole texts that share a word of six letters or more
    words = F.explode(F.array_distinct(F.filter(F.split(X.normalize_text("text"), " "), lambda x: F.length(x) >= 6))).alias("word")
    b = table(spark, d, "benchmark")
    block = b.select("item_id", words)
    pairs = block.alias("a").join(block.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.item_id") < F.col("b.item_id"))).select(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("other_id")).distinct()
    pairs = pairs.join(b.select("item_id", F.col("text").alias("one")), "item_id").join(b.select(F.col("item_id").alias("other_id"), F.col("text").alias("two")), "other_id")
    return pairs.select("item_id", "other_id", F.round(X.title_similarity(F.col("one"), F.col("two")), 6).alias("similarity"))


def classify_citation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 101) / 100).alias("ts"), (F.col("o_orderkey") % 2 == 0).alias("doi"), (F.col("o_orderkey") % 5 != 0).alias("title"), (F.col("o_orderkey") % 7 != 0).alias("found"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 3 == 1).alias("ym"))
    v = X.classify_citation(F.col("found"), F.col("doi"), F.col("title"), F.col("ts"), F.col("ym"))
    return o.select("o_orderkey", v["status"].alias("status"), F.round(v["confidence"], 2).alias("confidence"))


def status_counts(spark, d):
    return stats.status_counts(classify_citation(spark, d))


def validate_citations(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.regexp_extract("text", r"^([^.]*)", 1).alias("title"))
    works = b.select(F.concat(F.lit("10.1000/work"), F.col("item_id").cast("string")).alias("doi"), "title", (2000 + F.col("item_id") % 20).cast("int").alias("year"), F.lit("Author").alias("first_author"), F.lit(None).cast("string").alias("journal"), F.lit("crossref").alias("source"))
    stated = b.select(F.col("item_id").cast("string").alias("key"), F.lit("article").alias("entry_type"), "title", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("10.1000/work"), (F.col("item_id") + F.when(F.col("item_id") % 8 == 0, 2).otherwise(0)).cast("string"))).alias("doi"), (2000 + F.col("item_id") % 20).cast("int").alias("year"), F.lit("Author").alias("first_author"), F.lit(None).cast("string").alias("journal"))
    return references.validate(stated, works)


def _family():
    return F.concat(F.lit("Q"), F.translate(F.col("p_partkey").cast("string"), "0123456789", "abcdefghij"))


def parse_references(spark, d):
    title = F.concat(F.lit("A study of every "), "p_name", F.lit(" in use"))
    year = (F.lit(1950) + F.col("p_partkey") % 70).cast("string")
    p = table(spark, d, "part").select("p_partkey", _family().alias("family"), title.alias("title"), year.alias("year"), F.concat(F.lit("10.1186/s13059-"), F.col("p_partkey").cast("string")).alias("doi"))
    before = F.concat(F.lit("1. "), "family", F.lit(" JA, van der Doe B ("), "year", F.lit("). "), "title", F.lit(". J Things, 12(3):4-9. doi:"), "doi", F.lit("."))
    after = F.concat(F.lit("[7] "), "family", F.lit(", J. A., and Doe, B. "), "title", F.lit("? J Things "), "year", F.lit(";12:4-9. https://doi.org/"), "doi", F.lit("\n\nDownloaded from https://x.y/z\n"))
    return references.parse_references(p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, before).otherwise(after).alias("value")), "text", id_col="p_partkey")


def parse_latex(spark, d):
    item = F.concat(F.lit("\\bibitem[x]{k"), F.col("p_partkey").cast("string"), F.lit("}\n"), _family(), F.lit(", J.~A. and \\\"Ost, B. ("), (F.lit(1950) + F.col("p_partkey") % 70).cast("string"), F.lit(").\n\\newblock A \\textbf{study} of every "), "p_name", F.lit(" in use.\n\\newblock \\emph{J Things}, 1:1--5."))
    texts = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("x"))))["x"], "\n").alias("items"))
    texts = texts.select("p_brand", F.concat(F.lit("text \\begin{thebibliography}{9}"), "items", F.lit("\\end{thebibliography} \\bibitem{no} more")).alias("value"))
    return references.parse_references(texts, "latex", id_col="p_brand").select("doc", "key", "entry_type", "title", "year", "first_author")


def parse_bibtex(spark, d):
    entry = F.concat(F.lit("@article{k"), F.col("p_partkey").cast("string"), F.lit(",\n  title = {A {"), F.col("p_name"), F.lit("} \\emph{study}},\n  author = {"), _family(), F.lit(", Jo and Doe, J},\n  year = "), (F.lit(1950) + F.col("p_partkey") % 70).cast("string"), F.lit(",\n  journal = \"J \\& T\",\n  url = {https://doi.org/10.1186/s13059-"), F.col("p_partkey").cast("string"), F.lit("}\n}\n"))
    texts = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("value"))
    return references.parse_bibtex(texts).select("key", "entry_type", "title", "doi", "year", "first_author", "journal")


def _file(spark, lines: DataFrame, tag: str) -> str:
    """A text file of the column value of lines, in the shared scratch folder."""
    path = scratch_path(spark, tag)
    lines.select("value").write.text(path)
    return path


def read_gaf(spark, d):
    p = table(spark, d, "part")
    fields = ["DB", F.col("p_partkey"), F.col("p_name"), F.when(F.col("p_size") % 5 == 0, "NOT|part_of").otherwise("part_of"), F.concat(F.lit("GO:"), F.lpad(F.col("p_size").cast("string"), 7, "0")), "R:1", F.when(F.col("p_size") % 2 == 0, "IDA").otherwise("IEA"), "", "P", "", F.col("p_type"), "protein", "taxon:9606", "20240101", "X"]
    line = F.concat_ws("\t", *(F.lit(f) if isinstance(f, str) else f.cast("string") for f in fields))
    head = spark.createDataFrame([("!gaf-version: 2.2",), ("too\tshort",)], "value string")
    return annotation.read_gaf(spark, _file(spark, head.unionByName(p.select(line.alias("value"))), "gaf"), exclude_not=True).withColumn("db_id", F.col("db_id").cast("long"))


def read_obo(spark, d):
    k = F.col("p_partkey")
    of = lambda x: F.concat(F.lit("P:"), x.cast("string"))
    parents = F.when(k >= 2, F.concat(F.lit("\nis_a: "), of(F.floor(k / 2)), F.lit(" ! half"), F.lit("\nrelationship: part_of "), of(F.floor(k / 3)))).otherwise("")
    gone = F.when(k % 10 == 7, "\nis_obsolete: true").otherwise("")
    stanza = F.concat(F.lit("[Term]\nid: "), of(k), F.lit("\nname: "), "p_name", F.lit("\nnamespace: n"), parents, gone, F.lit("\n"))
    nodes, edges = annotation.read_obo(spark, _file(spark, table(spark, d, "part").select(stanza.alias("value")), "obo"))
    return edges.join(nodes.select(F.col("id").alias("child"), "name"), "child")


def read_gmt(spark, d):
    sets = table(spark, d, "part").groupBy("p_brand").agg(F.concat_ws("\t", F.first("p_brand"), F.lit("a set"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("m"), F.col("p_partkey").cast("string")))), "\t")).alias("value"))
    return annotation.read_gmt(spark, _file(spark, sets, "gmt"))


def read_gtf(spark, d):
    k = F.col("c_custkey").cast("string")
    attr = F.concat(F.lit('gene_id "E'), k, F.lit('.3"; gene_type "'), F.lower("c_mktsegment"), F.lit('"; gene_name "'), "c_name", F.lit('";'))
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("x"), F.when(F.col("c_nationkey") % 2 == 0, "gene").otherwise("exon"), k, k, F.lit("."), F.lit("+"), F.lit("."), attr)
    return annotation.read_gtf_genes(spark, _file(spark, table(spark, d, "customer").select(line.alias("value")), "gtf"), gene_types=["building", "machinery"]).select("ensembl_id", "symbol", "gene_type")


def read_hgnc(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("H:"), F.col("p_partkey").cast("string")).alias("hgnc_id"), F.col("p_name").alias("symbol"), F.col("p_partkey").cast("string").alias("entrez_id"), F.when(F.col("p_size") > 5, F.concat(F.lit("E"), F.col("p_partkey").cast("string"))).alias("ensembl_gene_id"), F.when(F.col("p_size") % 2 == 0, "gene with protein product").otherwise("pseudogene").alias("locus_type"))
    path = scratch_path(spark, "hgnc")
    p.write.option("header", True).option("sep", "\t").csv(path)
    return annotation.read_hgnc(spark, path).select("ensembl_id", "symbol", "entrez_id", "hgnc_id")


def read_fasta(spark, d):
    record = F.concat(F.lit(">p"), F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit("\n"), F.repeat(F.lit("ACGT"), F.col("p_size")), F.lit("\nTT"))
    return files.read_fasta(spark, _file(spark, table(spark, d, "part").select(record.alias("value")), "fasta"))


def wilson_interval(spark, d):
    rate = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = stats.wilson_interval(F.col("k"), F.col("n"))
    return rate.select("lang", "k", "n", F.round(lo, 10).alias("lower"), F.round(hi, 10).alias("upper"))


def grand_stats(spark, d):
    return stats.grand_stats(table(spark, d, "lineitem"), "l_quantity").select(F.round("mean", 9).alias("mean"), F.round("median", 9).alias("median"))


def box_stats(spark, d):
    out = stats.box_stats(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    return out.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("q1", "median", "q3", "low", "high")))


def histogram(spark, d):
    return stats.histogram(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", 7).select("l_returnflag", "bin", F.round("left", 9).alias("left"), "count", F.round("density", 9).alias("density"))


def kde(spark, d):
    return stats.kde(table(spark, d, "lineitem"), "l_returnflag", "l_discount", points=64).select("l_returnflag", F.round("x", 9).alias("x"), F.round("density", 6).alias("density"))


def hexbin(spark, d):
    return stats.hexbin(table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_discount").cast("double").alias("y")), "x", "y")


def zscore_clip(spark, d):
    m = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return stats.zscore_clip(m, "o_custkey", "v", limit=1.2).select("o_custkey", "o_orderpriority", F.round("z", 7).alias("z"))


def log_transform(spark, d):
    return stats.log_transform(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", name="v").select("o_orderkey", F.round("v", 9).alias("v"))


def suggest_log(spark, d):
    return stats.suggest_log(table(spark, d, "orders"), "o_totalprice")


def clip_small_negative(spark, d):
    return stats.clip_small_negative(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - 0.05).alias("v")), "v").withColumn("v", F.round("v", 9))


def mask_diagonal(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.col("n_nationkey").cast("double").alias("v"))
    return stats.mask_diagonal(n, "n_nationkey", "n_regionkey", "v")


def schedule_variance(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date"))
    s = li.select("l_orderkey", "l_linenumber", day("o_orderdate").alias("start"), (day("o_orderdate") + 90).alias("end"), day("l_shipdate").alias("done"))
    return s.select("l_orderkey", "l_linenumber", stats.schedule_variance(F.col("start"), F.col("end"), F.col("done"), F.lit(1200), 5).alias("status"))


def status_change(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "O").otherwise("P").alias("later"))
    return stats.status_change(o.select("k", F.col("o_orderstatus").alias("s")), o.select("k", F.col("later").alias("s")), "k", "s", ["O", "P", "F"])


def group_collect(spark, d):
    return stats.group_collect(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "priorities", ";")


def group_tuple(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return channels.group_tuple(c, "conv_id", ["turn"]).select("conv_id", F.array_join("role", ";").alias("roles"), F.array_join(F.transform("turn", lambda t: t.cast("string")), ";").alias("turns"))


def transpose(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return channels.transpose(channels.group_tuple(c, "conv_id", ["turn"]), ["turn", "role"])


def channel_join_remainder(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"))
    b = table(spark, d, "customer").where("c_custkey % 2 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("b"))
    return channels.join(a, b, "k", remainder=True)


def branch(spark, d):
    return channels.branch(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "branch", small=F.col("o_totalprice") < 50_000, large=F.col("o_totalprice") > 200_000)


def json_count(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def row_block_hash(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return sinks.row_block_hash(n, ["n_nationkey"])


def nunique(spark, d):
    return band_join(spark, d).agg(F.count_distinct("left_event_id").alias("n_events"))


def finite(spark, d):
    v = F.when(F.col("l_linenumber") == 3, float("nan")).when(F.col("l_linenumber") == 4, float("inf")).when(F.col("l_linenumber") != 5, F.col("l_quantity"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return li.where(stats.finite("v")).groupBy("l_linenumber").agg(F.count("*").alias("n"))


def page_sets(spark, d):
    spec = F.concat(F.lit("1,3,"), (F.col("page_id") % 5 + 2).cast("string"), F.lit("-"), (F.col("page_id") % 5 + 4).cast("string"))
    return table(spark, d, "pages").select("page_id", F.array_join(F.transform(X.page_set(spec, F.lit(7)), lambda x: x.cast("string")), ",").alias("pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.rstrip("_"): f
    for f in (
        ora, ora_mf_baseline, closure, ancestors, descendants, propagate, mf_score, mf_rank, mf_baseline_hits, parents, children, term_search, facts_with, annotations_of, ortholog_map, average_precision,
        pr_enrichment, bh_qvalues, compose_union, compose_intersection, terms_diff, set_minus, set_and, cross_union, band_join, semi_join, anti_join, left_lookup, symbol_resolve, rect_overlap, dedupe_first_, topk,
        topk_by, top_terms, group_order, collect_values, total_rank_, normalize_text, extract_year, extract_doi, first_author, term_uris, slugs, sha256, title_similarity, classify_citation, status_counts, validate_citations, parse_references, parse_latex, parse_bibtex, read_gaf, read_obo, read_gmt, read_gtf, read_hgnc, read_fasta,
        wilson_interval, grand_stats, box_stats, histogram, kde, hexbin, zscore_clip, log_transform, suggest_log, clip_small_negative, mask_diagonal, schedule_variance, status_change, group_collect, group_tuple,
        transpose, channel_join_remainder, branch, json_count, row_block_hash, nunique, finite, page_sets,
    )
}

CUSTOMER_SETS_SQL = """u AS (SELECT DISTINCT o_custkey AS key, 'urgent' AS label, 'urgent' AS s, 0 AS o FROM orders WHERE o_orderpriority = '1-URGENT'),
    op AS (SELECT DISTINCT o_custkey AS key, 'open' AS label, 'open' AS s, 1 AS o FROM orders WHERE o_orderstatus = 'O'),
    b AS (SELECT c_custkey AS key, c_mktsegment AS label, 'building' AS s, 2 AS o FROM customer WHERE c_mktsegment = 'BUILDING'),
    a AS (SELECT * FROM u UNION ALL SELECT * FROM op UNION ALL SELECT * FROM b)"""
BAND_SQL = """e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us FROM events),
    j AS (SELECT x.user_id, x.event_id AS left_event_id, y.event_id AS right_event_id, abs(x.us - y.us) AS gap FROM e x JOIN e y ON x.user_id = y.user_id AND abs(x.us - y.us) <= 3600000000
          WHERE (x.event_type = 'click' AND y.event_type = 'error') OR (x.event_type = 'error' AND y.event_type = 'click'))"""
CLASSIFY_SQL = """SELECT o_orderkey, CASE WHEN NOT found THEN CASE WHEN doi THEN 'PHANTOM' ELSE 'NOT_FOUND' END
        WHEN doi THEN CASE WHEN NOT title THEN 'VERIFIED' WHEN ts >= 0.85 AND ok THEN 'VERIFIED' WHEN ts >= 0.65 AND ok THEN 'SUSPICIOUS' WHEN ts >= 0.5 THEN 'CORRUPTED' ELSE 'CHIMERA' END
        ELSE CASE WHEN ts >= 0.85 AND ok THEN 'VERIFIED_NO_DOI' WHEN ts >= 0.65 THEN 'SUSPICIOUS' ELSE 'NOT_FOUND' END END AS status,
        round(CASE WHEN NOT found THEN CASE WHEN doi THEN 0.95 ELSE 0.5 END
        WHEN doi THEN CASE WHEN NOT title THEN 0.75 WHEN ts >= 0.85 AND ok THEN round(0.85::DOUBLE + 0.15::DOUBLE * ts, 2) WHEN ts >= 0.65 AND ok THEN 0.55 WHEN ts >= 0.5 THEN 0.8 ELSE 0.9 END
        ELSE CASE WHEN ts >= 0.85 AND ok THEN 0.8 WHEN ts >= 0.65 THEN 0.45 ELSE 0.55 END END::DOUBLE, 2) AS confidence
    FROM (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS ts, o_orderkey % 2 = 0 AS doi, o_orderkey % 5 <> 0 AS title, o_orderkey % 7 <> 0 AS found, o_orderkey % 3 <> 2 AS ok FROM orders)"""

ORACLE_SQL: dict[str, str] = {
    "ora": f"""WITH {ORA_SQL} SELECT set_id, set_size, k_all AS set_size_after_filter, k AS n_hits_in_set, round(expected, 9) AS expected_hits, round(k / nullif(expected, 0), 9) AS fold_enrichment,
        round(p, 9) AS pvalue, round(q, 9) AS qvalue FROM ({_bh_sql('pv', 'p', 'q')})""",
    "ora_mf_baseline": f"""WITH {ORA_SQL}, pf AS (SELECT DISTINCT l_partkey AS m, l_suppkey % 10 AS term FROM lineitem),
        pt AS (SELECT term, count(*) AS c FROM pf GROUP BY term), pn AS (SELECT count(DISTINCT m) AS t FROM pf),
        pm AS (SELECT m, sum(CASE WHEN c < t THEN 1.0::DOUBLE / (c * (t - c)) ELSE 0 END) AS mf FROM pf JOIN pt USING (term), pn GROUP BY m),
        top AS (SELECT m FROM pm WHERE m IN (SELECT m FROM bg) ORDER BY round(mf, 12) DESC, m LIMIT (SELECT n::BIGINT FROM tot)),
        tx AS (SELECT set_id, count(top.m) AS kt FROM s LEFT JOIN top USING (m) GROUP BY set_id),
        tp AS (SELECT pv.set_id, k, kt, {_hyper_sql('big_n', 'k_all', 'nt', 'kt')} AS p FROM pv JOIN tx USING (set_id), tot, (SELECT count(*)::DOUBLE AS nt FROM top))
        SELECT set_id, k AS n_hits_in_set, kt AS mf_baseline_n_hits_in_set, round(p, 8) AS mf_baseline_pvalue, round(q, 8) AS mf_baseline_qvalue FROM ({_bh_sql('tp', 'p', 'q')})""",
    "closure": f"WITH RECURSIVE {CLOSURE_SQL} SELECT term::INT AS term, ancestor::INT AS ancestor FROM c",
    "ancestors": f"WITH RECURSIVE {CLOSURE_SQL} SELECT ancestor::INT AS term FROM c WHERE term = 42 UNION SELECT 42",
    "descendants": f"WITH RECURSIVE {CLOSURE_SQL} SELECT term::INT AS term FROM c WHERE ancestor = 5 UNION SELECT 5",
    "propagate": f"WITH RECURSIVE {PROPAGATED_SQL} SELECT entity, term::INT AS term FROM p",
    "mf_score": f"WITH RECURSIVE {MF_SQL} SELECT entity, n_annotations, round(mf_score, 12) AS mf_score FROM mf",
    "mf_rank": f"""WITH RECURSIVE {MF_SQL}, r AS (SELECT entity, row_number() OVER (ORDER BY round(mf_score, 10) DESC, entity) AS mf_rank, count(*) OVER () AS n FROM mf)
        SELECT entity, mf_rank, round((n - mf_rank + 1)::DOUBLE / n, 12) AS mf_percentile FROM r""",
    "mf_baseline_hits": f"WITH RECURSIVE {MF_SQL} SELECT entity FROM mf WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12) ORDER BY round(mf_score, 10) DESC, entity LIMIT 10",
    "parents": "SELECT 18::INT AS id UNION SELECT 12::INT",
    "children": "SELECT k::INT AS id FROM range(2, 51) t(k) WHERE k // 2 = 7",
    "term_search": "SELECT p_partkey AS term_id, p_name AS term_label, CASE WHEN contains(lower(p_name), 're') THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're') ORDER BY score DESC, term_label, term_id LIMIT 25",
    "facts_with": f"WITH RECURSIVE {CLOSURE_SQL}, f AS ({FACTS_SQL}) SELECT entity, term, term <> 5 AS propagated FROM f WHERE term = 5 OR term IN (SELECT term FROM c WHERE ancestor = 5)",
    "annotations_of": f"""WITH RECURSIVE {CLOSURE_SQL}, f AS (SELECT *, CASE WHEN term % 2 = 0 THEN 'A' ELSE 'B' END AS evidence FROM ({FACTS_SQL})),
        up AS (SELECT entity, ancestor::INT AS term, evidence, min(term) AS propagated_from FROM f JOIN c USING (term) GROUP BY ALL)
        SELECT entity, term, evidence, FALSE AS propagated, NULL::INT AS propagated_from FROM f
        UNION ALL SELECT entity, term, evidence, TRUE, propagated_from FROM up WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.entity = up.entity AND f.term = up.term AND f.evidence = up.evidence)""",
    "ortholog_map": """SELECT o_orderkey AS id, c_custkey AS from_id, CASE WHEN o_orderstatus = 'F' THEN 'ortholog_one2one' ELSE 'ortholog_one2many' END AS homology_type
        FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) = 1""",
    "average_precision": """WITH r AS (SELECT l_partkey AS m, row_number() OVER (ORDER BY sum(l_quantity::BIGINT) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey),
        x AS (SELECT p_brand AS set_id, row_number() OVER (PARTITION BY p_brand ORDER BY rank) / rank::DOUBLE AS v FROM part JOIN r ON m = p_partkey)
        SELECT set_id, count(*) AS n_members, round(avg(v), 10) AS pr_auc FROM x GROUP BY set_id""",
    "bh_qvalues": f"WITH p AS (SELECT o_orderkey, (o_orderkey * 7919 % 10007) / 10007.0::DOUBLE AS v FROM orders) SELECT o_orderkey, round(q, 10) AS qvalue FROM ({_bh_sql('p', 'v', 'q')})",
    "compose_union": f"WITH {CUSTOMER_SETS_SQL} SELECT key, arg_min(label, o) AS label, string_agg(DISTINCT s, ';' ORDER BY s) AS sources FROM a GROUP BY key",
    "compose_intersection": f"WITH {CUSTOMER_SETS_SQL} SELECT key, arg_min(label, o) AS label, string_agg(DISTINCT s, ';' ORDER BY s) AS sources FROM a GROUP BY key HAVING count(DISTINCT s) = 3",
    "terms_diff": f"WITH {CUSTOMER_SETS_SQL} SELECT coalesce(u.key, b.key) AS key, CASE WHEN u.key IS NULL THEN 'b_only' WHEN b.key IS NULL THEN 'a_only' ELSE 'shared' END AS status FROM u FULL JOIN b ON u.key = b.key",
    "set_minus": f"WITH {CUSTOMER_SETS_SQL} SELECT key FROM u EXCEPT SELECT key FROM b",
    "set_and": f"WITH {CUSTOMER_SETS_SQL} SELECT key FROM u INTERSECT SELECT key FROM b",
    "cross_union": f"WITH {CUSTOMER_SETS_SQL} SELECT key, arg_min(label, o) AS label FROM a GROUP BY key",
    "band_join": f"WITH {BAND_SQL} SELECT * FROM j",
    "nunique": f"WITH {BAND_SQL} SELECT count(DISTINCT left_event_id) AS n_events FROM j",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "left_lookup": "SELECT o_custkey AS c_custkey, o_orderkey, coalesce(c_mktsegment, '') AS c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey",
    "symbol_resolve": "SELECT lower(n_name) AS name, n_name, n_nationkey FROM nation",
    "rect_overlap": """WITH p AS (SELECT *, p_size::DOUBLE AS x0, p_retailprice % 50 AS y0, p_size + 1.5::DOUBLE AS x1, p_retailprice % 50 + 2 AS y1 FROM part)
        SELECT a.p_brand, a.p_partkey AS word, b.p_partkey AS right_mark FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1
        AND a.x0 - 1 <= b.x1 AND a.x1 + 1 >= b.x0 AND a.y0 - 1 <= b.y1 AND a.y1 + 1 >= b.y0""",
    "dedupe_first": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1",
    "topk": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topk_by": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "top_terms": "SELECT p_brand AS database, count(*) AS total_terms, first(p_name ORDER BY p_retailprice, p_name) AS top_term FROM part GROUP BY p_brand",
    "group_order": "SELECT p_type, row_number() OVER (ORDER BY first, p_type) - 1 AS position FROM (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY p_type)",
    "collect_values": "SELECT string_agg(n_name, ';' ORDER BY n_regionkey, n_name) AS names FROM nation",
    "total_rank": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders",
    "normalize_text": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(regexp_replace(coalesce(text, ''), '\\[A-Za-z]+\{', '{', 'g'))), '[^\x00-\x7f]', '', 'g'), '[{}]', '', 'g'),
        '[^0-9a-z_]', ' ', 'g'), ' +', ' ', 'g')) AS plain FROM documents""",
    "parse_references": """SELECT p_partkey::VARCHAR AS doc, '1' AS key, 'unknown' AS entry_type, 'A study of every ' || p_name || ' in use' AS title, '10.1186/s13059-' || p_partkey AS doi, (1950 + p_partkey % 70)::INT AS year,
        'Q' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS first_author, NULL::VARCHAR AS journal FROM part""",
    "parse_latex": """SELECT p_brand AS doc, 'k' || p_partkey AS key, 'latex_bibitem' AS entry_type, 'A study of every ' || p_name || ' in use' AS title, (1950 + p_partkey % 70)::INT AS year,
        'Q' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS first_author FROM part""",
    "parse_bibtex": """SELECT 'k' || p_partkey AS key, 'article' AS entry_type, 'A ' || p_name || ' study' AS title, '10.1186/s13059-' || p_partkey AS doi, (1950 + p_partkey % 70)::INT AS year,
        'Q' || translate(p_partkey::VARCHAR, '0123456789', 'abcdefghij') AS first_author, 'J & T' AS journal FROM part""",
    "read_gaf": """SELECT 'DB' AS db, p_partkey AS db_id, p_name AS symbol, 'part_of' AS qualifier, 'GO:' || lpad(p_size::VARCHAR, 7, '0') AS term_id, CASE WHEN p_size % 2 = 0 THEN 'IDA' ELSE 'IEA' END AS evidence_code,
        'P' AS aspect, p_type AS synonyms, 'taxon:9606' AS taxon FROM part WHERE p_size % 5 <> 0""",
    "read_obo": """WITH t AS (SELECT p_partkey AS k, p_name FROM part WHERE p_partkey % 10 <> 7 AND p_partkey >= 2)
        SELECT 'P:' || k AS child, 'P:' || (k // 2) AS parent, 'is_a' AS relation, p_name AS name FROM t UNION ALL SELECT 'P:' || k, 'P:' || (k // 3), 'part_of', p_name FROM t""",
    "read_gmt": "SELECT p_brand AS set_id, 'a set' AS set_name, 'M' || p_partkey AS member FROM part",
    "read_gtf": """SELECT 'E' || c_custkey AS ensembl_id, c_name AS symbol, lower(c_mktsegment) AS gene_type FROM customer WHERE c_nationkey % 2 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
    "read_hgnc": "SELECT 'E' || p_partkey AS ensembl_id, p_name AS symbol, p_partkey::VARCHAR AS entrez_id, 'H:' || p_partkey AS hgnc_id FROM part WHERE p_size > 5 AND p_size % 2 = 0",
    "read_fasta": "SELECT 'p' || p_partkey || ' ' || p_name AS header, repeat('ACGT', p_size) || 'TT' AS sequence, (4 * p_size + 2)::INT AS length FROM part",
    "hexbin": """WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem),
        p AS (SELECT (l_quantity - x0) / greatest(x1 - x0, 1e-12) * 40 AS u, (l_discount - y0) / greatest(y1 - y0, 1e-12) * 23 AS v FROM lineitem, e),
        q AS (SELECT *, pow(u - round(u), 2) + 3 * pow(v - round(v), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS even FROM p)
        SELECT CASE WHEN even THEN round(u) ELSE floor(u) + 0.5 END AS hx, CASE WHEN even THEN round(v) ELSE floor(v) + 0.5 END AS hy, count(*) AS count FROM q GROUP BY ALL""",
    "extract_year": "SELECT page_id, CASE WHEN 1890 + page_id % 230 BETWEEN 1900 AND 2099 THEN 1890 + page_id % 230 ELSE 2001 END::INT AS year FROM pages",
    "extract_doi": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '10.1186/science0' ELSE '10.1186/s13059-014-' || (page_id % 7)::VARCHAR END AS doi,
        CASE WHEN page_id % 3 = 0 THEN '10.1186/science0' ELSE '10.1186/s13059-014-' || (page_id % 7)::VARCHAR END AS clean FROM pages""",
    "first_author": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'Last' END AS author FROM customer",
    "term_uris": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'http://purl.obolibrary.org/obo/GO_' || p_size ELSE 'http://www.ebi.ac.uk/efo/EFO_' || lpad(p_size::VARCHAR, 7, '0') END AS uri,
        CASE WHEN p_partkey % 2 = 0 THEN 'GO:' || p_size ELSE 'EFO:' || lpad(p_size::VARCHAR, 7, '0') END AS compact, CASE WHEN p_partkey % 2 = 0 THEN 'go' ELSE 'efo' END AS ontology FROM part""",
    "slugs": """SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name || ' - ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) AS slug,
        array_to_string([upper(w[1]) || w[2:] for w in string_split(regexp_replace(p_name, '[_\\s-]+', ' ', 'g'), ' ')], ' ') AS banner,
        CASE WHEN i < 26 THEN chr(65 + (i % 26)::INT) WHEN i < 702 THEN chr(65 + ((i - 26) // 26 % 26)::INT) || chr(65 + (i % 26)::INT)
        ELSE chr(65 + ((i - 702) // 676 % 26)::INT) || chr(65 + ((i - 26) // 26 % 26)::INT) || chr(65 + (i % 26)::INT) END AS letter FROM (SELECT *, p_partkey % 18000 AS i FROM part)""",
    "sha256": "SELECT page_id, sha256(coalesce(html, '')) AS sha FROM pages",
    "classify_citation": CLASSIFY_SQL,
    "status_counts": f"SELECT status, count(*) AS count FROM ({CLASSIFY_SQL}) GROUP BY status",
    "wilson_interval": """SELECT lang, k, n, round(p - (mid - half), 10) AS lower, round(mid + half - p, 10) AS upper FROM (
        SELECT *, k / n::DOUBLE AS p, (k / n::DOUBLE + 1.96 * 1.96::DOUBLE / (2 * n)) / (1 + 1.96 * 1.96::DOUBLE / n) AS mid,
               1.96::DOUBLE / (1 + 1.96 * 1.96::DOUBLE / n) * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 1.96 * 1.96::DOUBLE / (4 * n * n)) AS half
        FROM (SELECT lang, sum(quality)::BIGINT AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang))""",
    "grand_stats": "SELECT round(avg(l_quantity), 9) AS mean, round(median(l_quantity), 9) AS median FROM lineitem",
    "box_stats": """WITH q AS (SELECT l_returnflag AS g, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
        SELECT g AS l_returnflag, n, round(q1, 6) AS q1, round(m, 6) AS median, round(q3, 6) AS q3,
               round(min(l_extendedprice) FILTER (WHERE l_extendedprice >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(l_extendedprice) FILTER (WHERE l_extendedprice <= q3 + 1.5 * (q3 - q1)), 6) AS high
        FROM q JOIN lineitem ON g = l_returnflag GROUP BY g, n, q1, m, q3""",
    "histogram": """WITH e AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 7 AS w FROM lineitem),
        b AS (SELECT l_returnflag, least(floor((l_quantity - lo) / w), 6)::INT AS bin, lo, w, count(*) AS c FROM lineitem, e GROUP BY ALL)
        SELECT l_returnflag, bin, round(lo + bin * w, 9) AS left, c AS count, round(c / (sum(c) OVER (PARTITION BY l_returnflag) * w), 9) AS density FROM b""",
    "kde": """WITH s AS (SELECT l_returnflag AS g, count(*) AS n, stddev_samp(l_discount) AS sd, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1),
        v AS (SELECT l_returnflag AS g, l_discount AS x, count(*) AS c FROM lineitem GROUP BY 1, 2),
        p AS (SELECT g, n, sd * pow(n, -0.2) AS h, lo - 3 * sd + k * (hi - lo + 6 * sd) / 63 AS x FROM s, range(64) t(k))
        SELECT p.g AS l_returnflag, round(p.x, 9) AS x, round(sum(c * exp(-0.5 * pow((p.x - v.x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM p JOIN v ON p.g = v.g GROUP BY p.g, p.x""",
    "zscore_clip": """WITH m AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS v FROM orders GROUP BY 1, 2)
        SELECT o_custkey, o_orderpriority, CASE WHEN stddev_samp(v) OVER w > 0 THEN round(greatest(-1.2, least(1.2, (v - avg(v) OVER w) / stddev_samp(v) OVER w))::DOUBLE, 7) END AS z FROM m WINDOW w AS (PARTITION BY o_custkey)""",
    "log_transform": "SELECT o_orderkey, round(CASE WHEN (SELECT max(o_totalprice) FROM orders) > 1000 THEN log10(o_totalprice + 1) ELSE o_totalprice END, 9) AS v FROM orders",
    "suggest_log": "SELECT max(o_totalprice) / min(o_totalprice) > 100 AS suggest_log FROM orders WHERE o_totalprice > 0",
    "clip_small_negative": "SELECT l_orderkey, l_linenumber, round(CASE WHEN m >= -0.1 AND v < 0 THEN 0 ELSE v END, 9)::DOUBLE AS v FROM (SELECT l_orderkey, l_linenumber, l_discount - 0.05::DOUBLE AS v, min(l_discount - 0.05::DOUBLE) OVER () AS m FROM lineitem)",
    "mask_diagonal": "SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey <> n_regionkey THEN n_nationkey::DOUBLE END AS v FROM nation",
    "schedule_variance": """SELECT l_orderkey, l_linenumber, CASE WHEN done >= e THEN 'complete' WHEN 1200 < s THEN 'not_started' WHEN 1200 > e THEN 'overdue' WHEN done < 1195 THEN 'behind' WHEN done > 1205 THEN 'ahead' ELSE 'on_track' END AS status
        FROM (SELECT l_orderkey, l_linenumber, o_orderdate::DATE - DATE '1992-01-01' AS s, o_orderdate::DATE - DATE '1992-01-01' + 90 AS e, l_shipdate::DATE - DATE '1992-01-01' AS done FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "status_change": """SELECT k, CASE WHEN b > a THEN 'promotion' WHEN b < a THEN 'regression' ELSE 'unchanged' END AS change
        FROM (SELECT o_orderkey AS k, list_position(['O', 'P', 'F'], o_orderstatus) AS a, list_position(['O', 'P', 'F'], CASE o_orderkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END) AS b FROM orders)""",
    "group_collect": "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, count(DISTINCT o_orderpriority)::INT AS n FROM orders GROUP BY o_custkey",
    "group_tuple": "SELECT conv_id, string_agg(role, ';' ORDER BY turn) AS roles, string_agg(turn::VARCHAR, ';' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id",
    "transpose": "SELECT conv_id, turn, role FROM conversations",
    "channel_join_remainder": "SELECT coalesce(a.c_custkey, b.c_custkey) AS k, a.c_name AS a, b.c_mktsegment AS b FROM (SELECT * FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 2 <> 0) b ON a.c_custkey = b.c_custkey",
    "branch": "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 50000 THEN 'small' ELSE 'large' END AS branch FROM orders WHERE o_totalprice < 50000 OR o_totalprice > 200000",
    "json_count": "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type",
    "row_block_hash": "SELECT sha256('n_nationkey,n_name,n_regionkey' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) || chr(10)) AS sha256 FROM nation",
    "finite": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (3, 4, 5) GROUP BY l_linenumber",
    "page_sets": "SELECT page_id, array_to_string(list_sort(list_distinct([x for x in [1, 3] || range(page_id % 5 + 2, page_id % 5 + 5) if x <= 7])), ',') AS pages FROM pages",
}
