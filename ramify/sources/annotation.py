"""Readers of annotation, ontology and set files. Remote services are read as local files of the same records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import EngineError, assert_schema, dedupe_first, with_ordinal

#: The columns of an annotation file that are used, by position.
GAF_COLUMNS = {"db": 0, "db_id": 1, "symbol": 2, "qualifier": 3, "term_id": 4, "evidence_code": 6, "aspect": 8, "synonyms": 10, "taxon": 12}
SET_COLUMNS = ["ensembl_id", "symbol", "entrez_id", "species", "source"]


def _empty_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def as_set(df: DataFrame, *, ensembl_id: Column, symbol: Column, entrez_id: Column, species: str, source: str, **extras: Column) -> DataFrame:
    """The standard columns of a set, then extras; empty values are null."""
    return df.select(
        _empty_to_null(ensembl_id.cast("string")).alias("ensembl_id"), _empty_to_null(symbol.cast("string")).alias("symbol"), _empty_to_null(entrez_id.cast("string")).alias("entrez_id"),
        F.lit(species).alias("species"), F.lit(source).alias("source"), *(c.alias(k) for k, c in extras.items()),
    )


def read_gaf(spark: SparkSession, path: str, *, exclude_not: bool = False) -> DataFrame:
    """Annotation facts: lines starting with ! and lines of fewer than 15 fields are skipped; trailing empty fields count."""
    lines = spark.read.text(path).where(~F.col("value").startswith("!"))
    parts = lines.select(F.split("value", "\t", -1).alias("p")).where(F.size("p") >= 15)
    out = parts.select(*(F.get("p", F.lit(i)).alias(c) for c, i in GAF_COLUMNS.items()))
    return out.where(~F.col("qualifier").rlike(r"(^|\|)NOT(\||$)")) if exclude_not else out


def gaf_date(spark: SparkSession, path: str) -> DataFrame:
    """One row: the date-generated of the header, or null."""
    head = spark.read.text(path).where(F.col("value").startswith("!date-generated:"))
    return head.agg(F.min(F.trim(F.regexp_extract("value", r"^!date-generated:\s*(.*)$", 1))).alias("date_generated"))


def read_obo(spark: SparkSession, path: str, *, obsolete: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, namespace, def, synonyms) and edges (child, parent, relation) of the [Term] stanzas."""
    stanza = spark.read.option("lineSep", "\n\n").text(path).select(F.regexp_replace("value", r"\r", "").alias("v"))
    terms = stanza.where(F.col("v").rlike(r"(?m)^\[Term\]$"))
    if not obsolete:
        terms = terms.where(~F.col("v").rlike(r"(?m)^is_obsolete:\s*true"))
    one = lambda tag: _empty_to_null(F.regexp_extract("v", rf"(?m)^{tag}:\s*(.*)$", 1))
    every = lambda tag: F.regexp_extract_all("v", F.lit(rf"(?m)^{tag}:\s*(.*)$"), F.lit(1))
    t = terms.select(one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), one("def").alias("def"), every("synonym").alias("synonyms"), every("is_a").alias("is_a"), every("relationship").alias("rel"))
    t = t.where("id IS NOT NULL")
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+!.*$", ""), r"\s*\{[^}]*\}\s*$", ""))
    is_a = t.select(F.col("id").alias("child"), F.explode("is_a").alias("x")).select("child", bare(F.col("x")).alias("parent"), F.lit("is_a").alias("relation"))
    rel = t.select(F.col("id").alias("child"), F.explode("rel").alias("x")).select("child", F.get(F.split(bare(F.col("x")), r"\s+"), F.lit(1)).alias("parent"), F.get(F.split(F.col("x"), r"\s+"), F.lit(0)).alias("relation"))
    return t.drop("is_a", "rel"), is_a.unionByName(rel)


def obo_version(spark: SparkSession, path: str, *, required: bool = True) -> str | None:
    """The date of data-version, or the whole of it; a missing header is an error if required."""
    row = spark.read.text(path).where(F.col("value").startswith("data-version:")).agg(F.min(F.trim(F.regexp_extract("value", r"^data-version:\s*(.*)$", 1))).alias("v")).first()
    if row["v"] is None:
        if required:
            raise EngineError("obo_version", f"no data-version in {path}")
        return None
    return row["v"].rstrip("/").split("/")[-1]


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """set_id, set_name, member (upper case, distinct, not empty); of a repeated set the last line counts; lines of fewer than 3 fields are skipped."""
    lines = with_ordinal(spark.read.text(path)).select("ordinal", F.split("value", "\t", -1).alias("p")).where(F.size("p") >= 3)
    sets = lines.select(F.get("p", F.lit(0)).alias("set_id"), F.get("p", F.lit(1)).alias("set_name"), "ordinal", F.slice("p", 3, 1_000_000).alias("m"))
    last = dedupe_first(sets, ["set_id"], [F.desc("ordinal")])
    return last.select("set_id", "set_name", F.explode("m").alias("member")).select("set_id", "set_name", F.upper(F.trim("member")).alias("member")).where("member <> ''").distinct()


def read_gtf_genes(spark: SparkSession, path: str, *, gene_types: Sequence[str] | None = None, species: str = "", source: str = "gtf") -> DataFrame:
    """Genes of a GTF as a set with gene_type; versions are stripped from ids."""
    rows = spark.read.option("comment", "#").csv(path, sep="\t", quote="\u0000", schema="seq string, src string, feature string, start long, end long, score string, strand string, frame string, attr string")
    attr = lambda k: F.regexp_extract("attr", rf'(?:^|;\s*){k} "([^"]*)"', 1)
    genes = rows.where("feature = 'gene'").withColumn("_type", attr("gene_type"))
    if gene_types is not None:
        genes = genes.where(F.col("_type").isin(list(gene_types)))
    return as_set(genes, ensembl_id=F.substring_index(attr("gene_id"), ".", 1), symbol=attr("gene_name"), entrez_id=F.lit(None), species=species, source=source, gene_type=F.col("_type"))


def read_table(spark: SparkSession, path: str, sep: str = "\t", comment: str | None = None) -> DataFrame:
    """A delimited file with a header; every column is a string."""
    reader = spark.read.option("header", True).option("sep", sep)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def read_hgnc(spark: SparkSession, path: str, *, locus_types: Sequence[str] = ("gene with protein product",)) -> DataFrame:
    rows = assert_schema(read_table(spark, path), ["symbol", "entrez_id", "ensembl_gene_id", "locus_type"], "read_hgnc")
    rows = with_ordinal(rows.where(F.col("locus_type").isin(list(locus_types)) & _empty_to_null(F.col("ensembl_gene_id")).isNotNull()))
    rows = dedupe_first(rows, ["ensembl_gene_id"], ["ordinal"])
    hgnc = F.col("hgnc_id") if "hgnc_id" in rows.columns else F.lit(None).cast("string")
    return as_set(rows, ensembl_id=F.col("ensembl_gene_id"), symbol=F.col("symbol"), entrez_id=F.col("entrez_id"), species="human", source="hgnc", hgnc_id=hgnc, locus_type=F.col("locus_type"))


def plain_header(name: str) -> str:
    """'1. Marker Accession ID' as marker_accession_id."""
    import re

    return re.sub(r"[^a-z0-9]+", "_", re.sub(r"^\s*\d+\.\s*", "", name).lower()).strip("_")


def _report(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    rows = read_table(spark, path)
    names = [plain_header(c) for c in rows.columns]
    keep = [(old, new) for old, new in zip(rows.columns, names, strict=True) if new and not new.startswith("_c")]
    return assert_schema(rows.select(*(F.col(f"`{old}`").alias(new) for old, new in keep)), required, "read_mgi")


def read_mgi(spark: SparkSession, markers: str, coordinates: str, *, feature_types: Sequence[str] = ("protein coding gene",)) -> DataFrame:
    """Two reports joined on the accession id; rows without an Ensembl id go."""
    m = _report(spark, markers, ["mgi_accession_id", "marker_symbol", "feature_type"]).where(F.col("feature_type").isin(list(feature_types))).select("mgi_accession_id", "marker_symbol", "feature_type")
    c = _report(spark, coordinates, ["mgi_accession_id", "ensembl_gene_id", "entrez_gene_id"]).select("mgi_accession_id", "ensembl_gene_id", "entrez_gene_id")
    rows = m.join(c, "mgi_accession_id").where(_empty_to_null(F.col("ensembl_gene_id")).isNotNull())
    rows = dedupe_first(rows, ["ensembl_gene_id"], ["mgi_accession_id"])
    return as_set(rows, ensembl_id=F.col("ensembl_gene_id"), symbol=F.col("marker_symbol"), entrez_id=F.col("entrez_gene_id"), species="mouse", source="mgi", mgi_id=F.col("mgi_accession_id"), feature_type=F.col("feature_type"))


def read_tf_census(spark: SparkSession, path: str) -> DataFrame:
    """A census of transcription factors: rows marked yes with an id of the species; repeated rows stay."""
    rows = assert_schema(read_table(spark, path, sep=","), ["Ensembl ID", "HGNC symbol", "Is TF?", "DBD"], "read_tf_census")
    rows = rows.where((F.lower(F.trim(F.col("`Is TF?`"))) == "yes") & F.trim(F.col("`Ensembl ID`")).startswith("ENSG"))
    return as_set(rows, ensembl_id=F.col("`Ensembl ID`"), symbol=F.col("`HGNC symbol`"), entrez_id=F.lit(None), species="human", source="tf_census", dbd_family=F.col("DBD"))


def read_animal_tfdb(spark: SparkSession, path: str, species: str) -> DataFrame:
    """Rows without id and symbol go; of rows with an id the first stays; rows with a symbol only all stay."""
    rows = assert_schema(read_table(spark, path), ["Symbol", "Ensembl", "Family", "Entrez_ID"], "read_animal_tfdb")
    clean = lambda c: _empty_to_null(F.when(~F.col(c).isin("NA", "-"), F.col(c)))
    rows = with_ordinal(rows.select(clean("Symbol").alias("symbol"), clean("Ensembl").alias("id"), F.col("Family").alias("family"), clean("Entrez_ID").alias("entrez")))
    rows = rows.where("symbol IS NOT NULL OR id IS NOT NULL")
    rows = dedupe_first(rows.where("id IS NOT NULL"), ["id"], ["ordinal"]).unionByName(rows.where("id IS NULL"))
    return as_set(rows, ensembl_id=F.col("id"), symbol=F.col("symbol"), entrez_id=F.col("entrez"), species=species, source="animal_tfdb", family=F.col("family"))


def rename_by_hint(df: DataFrame, hints: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns renamed to the first hint name of which all substrings occur in the header, whatever the case. A hint without a column is an error."""
    taken: dict[str, str] = {}
    for name, parts in hints.items():
        hit = [c for c in df.columns if all(p.lower() in c.lower() for p in parts) and c not in taken]
        if not hit:
            raise EngineError("rename_by_hint", f"no column for {name}; there are {', '.join(df.columns)}")
        taken[hit[0]] = name
    return df.withColumnsRenamed(taken)


def read_biomart(spark: SparkSession, path: str, species: str, biotype: str = "protein_coding") -> DataFrame:
    """An export of genes; the filter that the service was given must hold in every row."""
    rows = rename_by_hint(read_table(spark, path), {"id": ["gene", "stable"], "symbol": ["gene name"], "entrez": ["ncbi"], "biotype": ["type"]})
    if not rows.where(F.col("biotype") != biotype).isEmpty():
        raise EngineError("read_biomart", f"rows that aren't {biotype}")
    rows = dedupe_first(with_ordinal(rows), ["id"], ["ordinal"])
    return as_set(rows, ensembl_id=F.col("id"), symbol=F.col("symbol"), entrez_id=F.col("entrez"), species=species, source="biomart", biotype=F.col("biotype"))


def read_gene_coords(spark: SparkSession, path: str) -> DataFrame:
    """id, symbol, chromosome, strand, tss: the start on strand 1, the end on -1."""
    rows = rename_by_hint(read_table(spark, path), {"id": ["stable"], "symbol": ["gene name"], "chromosome": ["chromosome"], "strand": ["strand"], "start": ["start"], "end": ["end"]})
    strand = F.col("strand").cast("int")
    return rows.select("id", "symbol", "chromosome", strand.alias("strand"), F.when(strand == 1, F.col("start").cast("long")).otherwise(F.col("end").cast("long")).alias("tss"))


def motif_genes(motifs: DataFrame, symbols: DataFrame, species: str) -> DataFrame:
    """motifs (matrix_id, name) to genes by symbols (symbol, id): names A::B count for each part; names and matrices are joined by ;."""
    parts = motifs.select("matrix_id", "name", F.explode(F.split("name", "::")).alias("part"))
    hit = parts.join(symbols.select(F.upper("symbol").alias("_u"), F.col("symbol").alias("gene_symbol"), F.col("id").alias("gene_id")), F.upper(F.trim("part")) == F.col("_u"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    g = hit.groupBy("gene_id").agg(F.min("gene_symbol").alias("gene_symbol"), joined("name").alias("names"), joined("matrix_id").alias("ids"), F.count_distinct("matrix_id").alias("n"))
    return as_set(g, ensembl_id=F.col("gene_id"), symbol=F.col("gene_symbol"), entrez_id=F.lit(None), species=species, source="motifs", jaspar_names=F.col("names"), jaspar_matrix_ids=F.col("ids"), n_jaspar_motifs=F.col("n"))


def disease_targets(rows: DataFrame, *, min_score: float = 0.0, most: int = 3000) -> DataFrame:
    """rows (disease_id, disease_name, ensembl_id, symbol, score) of score >= min_score, the best `most` first, one per gene."""
    kept = dedupe_first(rows.where(F.col("score") >= min_score), ["disease_id", "ensembl_id"], [F.desc("score"), "symbol"])
    kept = kept.orderBy(F.desc("score"), "ensembl_id").limit(most)
    return as_set(kept, ensembl_id=F.col("ensembl_id"), symbol=F.col("symbol"), entrez_id=F.lit(None), species="human", source="disease_targets", disease_id=F.col("disease_id"), disease_name=F.col("disease_name"), association_score=F.round("score", 6))


def association_genes(associations: DataFrame) -> DataFrame:
    """associations with loci array<struct<authorReportedGenes array<struct<geneName>>, genes array<string>>> to symbol, n_associations.

    Names are trimmed; '' and intergenic are none. An association counts once for a symbol, by the untrimmed name.
    """
    rows = associations.withColumn("_a", F.monotonically_increasing_id()).select("_a", F.explode("loci").alias("l"))
    names = F.concat(F.coalesce(F.transform("l.authorReportedGenes", lambda g: g["geneName"]), F.array().cast("array<string>")), F.coalesce(F.col("l.genes"), F.array().cast("array<string>")))
    raw = rows.select("_a", F.explode(names).alias("raw")).withColumn("symbol", F.trim("raw")).where("symbol <> '' AND lower(symbol) <> 'intergenic'")
    return raw.groupBy("symbol").agg(F.count_distinct(F.when(F.col("raw") == F.col("symbol"), F.col("_a"))).alias("n_associations"))


def omim_genes(entries: DataFrame) -> DataFrame:
    """entries with mim_number and geneMap (geneSymbols, geneIDs; comma lists): the first symbol and first id; one row per symbol."""
    firsts = entries.select("mim_number", F.trim(F.substring_index("geneMap.geneSymbols", ",", 1)).alias("symbol"), F.trim(F.substring_index(F.col("geneMap.geneIDs").cast("string"), ",", 1)).alias("entrez")).where("symbol <> ''")
    rows = dedupe_first(firsts, ["symbol"], ["mim_number"])
    return as_set(rows, ensembl_id=F.lit(None), symbol=F.col("symbol"), entrez_id=F.col("entrez"), species="human", source="omim", omim_mim_number=F.col("mim_number"))


def read_json_pages(spark: SparkSession, path: str, results: str = "results") -> DataFrame:
    """Saved pages of a service, a JSON object each, to one row per result."""
    return spark.read.option("multiLine", True).json(path).select(F.explode(results).alias("_r")).select("_r.*")


def symbols_to_accession(names: DataFrame, table: DataFrame) -> DataFrame:
    """names (symbol, species) to the first accession of table (symbol, species, accession, reviewed): reviewed ones first, then by accession."""
    t = table.select(F.upper("symbol").alias("_u"), F.col("species").alias("_s"), "accession", "reviewed")
    hit = names.join(t, (F.upper("symbol") == F.col("_u")) & (F.col("species") == F.col("_s")), "left")
    return dedupe_first(hit, ["symbol", "species"], [F.desc_nulls_last("reviewed"), "accession"]).select("symbol", "species", "accession")
