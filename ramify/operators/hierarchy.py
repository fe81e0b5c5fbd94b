"""Directed graphs of terms: neighbours, closure, propagation of facts, annotation queries.

An edge runs from child to parent and may carry a relation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import EngineError, cut_lineage, dedupe_first


def _edges(edges: DataFrame, child: str, parent: str, relation: str, relations: Sequence[str] | None) -> DataFrame:
    if relations is not None:
        edges = edges.where(F.col(relation).isin(list(relations)))
    return edges.select(F.col(child).alias("child"), F.col(parent).alias("parent")).where("child IS NOT NULL AND parent IS NOT NULL").distinct()


def neighbours(edges: DataFrame, nodes: DataFrame, term: object, direction: str, *, child: str = "child", parent: str = "parent", relation: str = "relation", relations: Sequence[str] | None = ("is_a",), id_col: str = "id") -> DataFrame:
    """Immediate parents or children of a term as rows of nodes. An unknown term is an error."""
    if nodes.where(F.col(id_col) == F.lit(term)).isEmpty():
        raise EngineError("neighbours", f"unknown term: {term}")
    e = _edges(edges, child, parent, relation, relations)
    mine, other = ("child", "parent") if direction == "parents" else ("parent", "child")
    return nodes.join(e.where(F.col(mine) == F.lit(term)).select(F.col(other).alias(id_col)), id_col, "left_semi")


def parents(edges: DataFrame, nodes: DataFrame, term: object, **kw) -> DataFrame:
    return neighbours(edges, nodes, term, "parents", **kw)


def children(edges: DataFrame, nodes: DataFrame, term: object, **kw) -> DataFrame:
    return neighbours(edges, nodes, term, "children", **kw)


def definition(nodes: DataFrame, term: object, *, id_col: str = "id", name: str = "name", text: str = "def", synonyms: str = "synonyms") -> DataFrame:
    """Label, definition without quotes and trailing references, and plain synonyms of a term."""
    bare = lambda c: F.when(c.startswith('"'), F.regexp_extract(c, r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(c)
    return nodes.where(F.col(id_col) == F.lit(term)).select(F.col(id_col).alias("term_id"), F.col(name).alias("term_label"), bare(F.col(text)).alias("definition"), F.transform(synonyms, bare).alias("synonyms"))


def term_search(nodes: DataFrame, query: str, *, id_col: str = "id", name: str = "name", synonyms: Column | str = "synonyms", limit: int = 25) -> DataFrame:
    """Terms whose label (score 1) or a synonym (0.5) contains the query, whatever the case; best first, then by label and id."""
    q = query.lower()
    syn = F.col(synonyms) if isinstance(synonyms, str) else synonyms
    label = F.lower(name).contains(q)
    score = F.when(label, 1.0).when(F.exists(syn, lambda s: F.lower(s).contains(q)), 0.5)
    found = nodes.select(F.col(id_col).alias("term_id"), F.col(name).alias("term_label"), score.alias("score")).where("score IS NOT NULL")
    return found.orderBy(F.desc("score"), "term_label", "term_id").limit(limit)


def closure(edges: DataFrame, *, child: str = "child", parent: str = "parent", relation: str = "relation", relations: Sequence[str] | None = None, seeds: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """All pairs (term, ancestor) of one or more steps, by path doubling: each round joins the pairs with themselves.

    Pairs are distinct, so cycles end too (a term on one is its own ancestor) and no path is enumerated. With `seeds`
    (one column) only their ancestors are sought: new pairs are joined with the edges, and nothing else is closed.
    A round is checkpointed; it ends when no pair is new.
    """
    e = cut_lineage(_edges(edges, child, parent, relation, relations))
    if seeds is None:
        pairs = e.select(F.col("child").alias("term"), F.col("parent").alias("ancestor"))
        n = pairs.count()
        for _ in range(max_rounds):
            step = pairs.alias("a").join(pairs.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("far")), "ancestor").select("term", F.col("far").alias("ancestor"))
            pairs = cut_lineage(pairs.unionByName(step).distinct())
            if (m := pairs.count()) == n:
                return pairs
            n = m
        raise EngineError("closure", f"not closed after {max_rounds} rounds")
    start = seeds.select(F.col(seeds.columns[0]).alias("term")).distinct()
    new = cut_lineage(start.join(e, start["term"] == e["child"]).select("term", F.col("parent").alias("ancestor")))
    pairs = new
    while not new.isEmpty():
        step = new.join(e, new["ancestor"] == e["child"]).select("term", F.col("parent").alias("ancestor")).distinct()
        new = cut_lineage(step.join(pairs, ["term", "ancestor"], "left_anti"))
        pairs = cut_lineage(pairs.unionByName(new))
    return pairs


def _reach(edges: DataFrame, term: object, up: bool, child: str, parent: str, **kw) -> DataFrame:
    seed = edges.sparkSession.range(1).select(F.lit(term).alias("term"))
    c, p = (child, parent) if up else (parent, child)
    found = closure(edges, child=c, parent=p, seeds=seed, **kw)
    return found.select(F.col("ancestor").alias("term")).unionByName(seed).distinct()


def ancestors(edges: DataFrame, term: object, *, child: str = "child", parent: str = "parent", **kw) -> DataFrame:
    """The term and all above it."""
    return _reach(edges, term, True, child, parent, **kw)


def descendants(edges: DataFrame, term: object, *, child: str = "child", parent: str = "parent", **kw) -> DataFrame:
    """The term and all below it."""
    return _reach(edges, term, False, child, parent, **kw)


def restrict_to_namespace(pairs: DataFrame, nodes: DataFrame, namespace: str, *, id_col: str = "id", ns_col: str = "namespace") -> DataFrame:
    """Pairs (term, ancestor), with each known term's own pair added, whose ancestor is in the namespace. Unknown terms have none."""
    own = nodes.select(F.col(id_col).alias("term"), F.col(id_col).alias("ancestor"))
    inside = nodes.where(F.col(ns_col) == namespace).select(F.col(id_col).alias("ancestor"))
    return pairs.join(nodes.select(F.col(id_col).alias("term")), "term", "left_semi").unionByName(own).distinct().join(inside, "ancestor", "left_semi").select("term", "ancestor")


def propagate(facts: DataFrame, pairs: DataFrame, *, entity: str, term: str, include_self: bool = True) -> DataFrame:
    """Distinct (entity, term): each fact, and the fact for every ancestor of its term."""
    direct = facts.select(F.col(entity).alias("entity"), F.col(term).alias("term")).distinct()
    up = direct.join(pairs, "term").select("entity", F.col("ancestor").alias("term"))
    out = direct.unionByName(up) if include_self else up
    return out.distinct().select(F.col("entity").alias(entity), F.col("term").alias(term))


def annotations_of(facts: DataFrame, pairs: DataFrame, *, entity_filter: Column, key: Sequence[str] = ("gene_id", "term_id", "evidence_code", "qualifier"), term: str = "term_id", direct_only: bool = False) -> DataFrame:
    """Direct rows of the entities (all of them), and propagated ones: one per key that no direct row has, from the first term.

    Adds propagated (boolean) and propagated_from (the direct term; null for direct rows). Other columns of a
    propagated row are those of its source row.
    """
    rows = facts.where(entity_filter)
    direct = rows.withColumn("propagated", F.lit(False)).withColumn("propagated_from", F.lit(None).cast(facts.schema[term].dataType))
    if direct_only:
        return direct
    up = rows.join(pairs.select(F.col("term").alias("_t"), "ancestor"), F.col(term) == F.col("_t"))
    up = up.withColumn("propagated_from", F.col(term)).withColumn(term, F.col("ancestor")).withColumn("propagated", F.lit(True)).drop("_t", "ancestor")
    up = up.join(rows.select(*key), list(key), "left_anti")
    up = dedupe_first(up, key, ["propagated_from", *(c for c in rows.columns if c not in key)])
    return direct.unionByName(up.select(direct.columns))


def facts_with(facts: DataFrame, edges: DataFrame, term_value: object, *, term: str = "term_id", direct_only: bool = False, **kw) -> DataFrame:
    """Facts whose term is the given one or lies below it, with propagated: the term isn't the given one."""
    if direct_only:
        return facts.where(F.col(term) == F.lit(term_value)).withColumn("propagated", F.lit(False))
    below = descendants(edges, term_value, **kw).select(F.col("term").alias(term))
    return facts.join(below, term, "left_semi").withColumn("propagated", F.col(term) != F.lit(term_value))


def ontology_first(nodes: DataFrame, edges: DataFrame, facts: DataFrame, query: str, entity: str, *, term: str = "term_id", **kw) -> DataFrame:
    """Entities with a fact at or below the best hit of a term search: entity, term."""
    hits = term_search(nodes, query, limit=1).collect()
    if not hits:
        return facts.limit(0).select(entity, term)
    return facts_with(facts, edges, hits[0]["term_id"], term=term, **kw).select(entity, term).distinct()


def ortholog_map(ids: DataFrame, homology: DataFrame, *, best_match: bool = True) -> DataFrame:
    """ids (id) to homologous ids: homology has id, target, homology_type. One row per target; ids without homology vanish.

    best_match: one target per id, one-to-one before others, then the smallest.
    """
    found = ids.select("id").distinct().join(homology, "id")
    if best_match:
        found = dedupe_first(found, ["id"], [F.when(F.col("homology_type") == "ortholog_one2one", 0).otherwise(1), "target"])
    return dedupe_first(found, ["target"], ["id"]).select(F.col("target").alias("id"), F.col("id").alias("from_id"), "homology_type")
