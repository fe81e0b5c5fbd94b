"""Readers, writers and scalars on small files."""

import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from ramify.core import EngineError
from ramify.functions import plaintext
from ramify.functions import text as X
from ramify.plans.registry import Catalog
from ramify.sources import annotation, files, references, reftext, sinks

GAF = "!gaf-version: 2.2\n!date-generated: 2024-01-02\n" + "\t".join(["DB", "P1", "abc", "", "GO:1", "R", "IDA", "", "P", "", "s1|s2", "protein", "taxon:9606", "20240101", "X", "", ""]) + "\n" + "\t".join(["DB", "P2", "def", "NOT|involved_in", "GO:2", "R", "IEA", "", "F", "", "", "protein", "taxon:9606", "20240101", "X"]) + "\nshort\trow\n"
OBO = """format-version: 1.2
data-version: releases/2024-01-17

[Term]
id: GO:1
name: root
namespace: ns
def: "The root." [x]

[Term]
id: GO:2
name: leaf
namespace: ns
synonym: "blad" EXACT []
is_a: GO:1 {x="y"} ! root
relationship: part_of GO:3 ! other

[Term]
id: GO:9
name: gone
is_obsolete: true

[Typedef]
id: part_of
"""
BIB = """@article{one,
  title = {{GSK3}: a {R}ole},
  author = {Smith, Jane and Doe, A.},
  year = 2014,
  doi = {https://doi.org/10.1186/s13059-014-0550-8.},
}

@book{two,
  title = "No identifier here",
  author = "Ann van Other",
  year = {2001a},
  url = {https://doi.org/10.1000/abc.123}
}
"""


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    if str(path).endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    return str(path)


def test_annotation_files(spark, tmp_path):
    p = put(tmp_path / "a.gaf.gz", GAF)
    rows = annotation.read_gaf(spark, p).orderBy("symbol").collect()
    assert [(r["symbol"], r["term_id"], r["evidence_code"], r["taxon"]) for r in rows] == [("abc", "GO:1", "IDA", "taxon:9606"), ("def", "GO:2", "IEA", "taxon:9606")]
    assert annotation.read_gaf(spark, p, exclude_not=True).count() == 1 and annotation.gaf_date(spark, p).first()[0] == "2024-01-02"
    o = put(tmp_path / "a.obo", OBO)
    nodes, edges = annotation.read_obo(spark, o)
    assert {r["id"] for r in nodes.collect()} == {"GO:1", "GO:2"}
    assert {tuple(r) for r in edges.select("child", "parent", "relation").collect()} == {("GO:2", "GO:1", "is_a"), ("GO:2", "GO:3", "part_of")}
    assert annotation.obo_version(spark, o) == "2024-01-17"
    with pytest.raises(EngineError):
        annotation.obo_version(spark, put(tmp_path / "b.obo", "x: 1\n"))
    g = put(tmp_path / "a.gmt", "s1\tone\ta\tb\t\ns2\ttwo\tC\ns1\tlast\tz\tz\nbad\tx\n")
    assert {tuple(r) for r in annotation.read_gmt(spark, g).collect()} == {("s1", "last", "Z"), ("s2", "two", "C")}
    t = put(tmp_path / "a.gtf", '#c\n1\tx\tgene\t1\t9\t.\t+\t.\tgene_id "ENSG1.5"; gene_type "protein_coding"; gene_name "AB";\n1\tx\texon\t1\t9\t.\t+\t.\tgene_id "ENSG1.5";\n')
    assert [tuple(r)[:2] for r in annotation.read_gtf_genes(spark, t, gene_types=["protein_coding"]).collect()] == [("ENSG1", "AB")]


def test_tables_of_sets(spark, tmp_path):
    h = put(tmp_path / "h.tsv", "hgnc_id\tsymbol\tentrez_id\tensembl_gene_id\tlocus_type\nH1\tA\t1\tE1\tgene with protein product\nH2\tB\t2\tE1\tgene with protein product\nH3\tC\t3\t\tgene with protein product\nH4\tD\t4\tE4\tpseudogene\n")
    assert [(r["ensembl_id"], r["symbol"]) for r in annotation.read_hgnc(spark, h).collect()] == [("E1", "A")]
    m = put(tmp_path / "m.rpt", "1. MGI Accession ID\t2. Marker Symbol\t3. Feature Type\nMGI:1\tAa\tprotein coding gene\t\nMGI:2\tBb\tpseudogene\t\n")
    c = put(tmp_path / "c.rpt", "1. MGI Accession ID\t2. Ensembl Gene ID\t3. Entrez Gene ID\nMGI:1\tENSMUSG1\t11\t\nMGI:2\tENSMUSG2\t12\t\n")
    assert [(r["ensembl_id"], r["mgi_id"], r["entrez_id"]) for r in annotation.read_mgi(spark, m, c).collect()] == [("ENSMUSG1", "MGI:1", "11")]
    tf = put(tmp_path / "t.csv", "Ensembl ID,HGNC symbol,Is TF?,DBD\nENSG1,A, yes ,Homeo\nENSG2,B,No,Homeo\nbad,C,Yes,x\n")
    assert [r["dbd_family"] for r in annotation.read_tf_census(spark, tf).collect()] == ["Homeo"]
    an = put(tmp_path / "an.tsv", "Species\tSymbol\tEnsembl\tFamily\tProtein\tEntrez_ID\nx\tA\tE1\tf\tp\t1\nx\tA2\tE1\tf\tp\t1\nx\tB\tNA\tf\tp\tNA\nx\tB\tNA\tf\tp\tNA\nx\tNA\tNA\tf\tp\t1\n")
    assert annotation.read_animal_tfdb(spark, an, "x").count() == 3
    bm = put(tmp_path / "b.tsv", "Gene stable ID\tGene name\tNCBI gene ID\tGene type\tChromosome/scaffold name\tStrand\tGene start (bp)\tGene end (bp)\nE1\tA\t1\tprotein_coding\t1\t-1\t10\t90\n")
    assert annotation.read_biomart(spark, bm, "human").first()["symbol"] == "A" and annotation.read_gene_coords(spark, bm).first()["tss"] == 90
    motifs = spark.createDataFrame([("M1", "a::b"), ("M2", "A")], "matrix_id string, name string")
    genes = spark.createDataFrame([("A", "E1"), ("B", "E2")], "symbol string, id string")
    assert {(r["ensembl_id"], r["jaspar_matrix_ids"], r["n_jaspar_motifs"]) for r in annotation.motif_genes(motifs, genes, "human").collect()} == {("E1", "M1;M2", 2), ("E2", "M1", 1)}
    hits = spark.createDataFrame([("d", "n", "E1", "A", 0.9), ("d", "n", "E1", "A", 0.5), ("d", "n", "E2", "B", 0.1)], "disease_id string, disease_name string, ensembl_id string, symbol string, score double")
    assert [r["association_score"] for r in annotation.disease_targets(hits, min_score=0.2).collect()] == [0.9]
    loci = spark.createDataFrame([([([(" A",), ("A",)], ["B", "intergenic"])],), ([([("A",)], None)],)], "loci array<struct<authorReportedGenes: array<struct<geneName: string>>, genes: array<string>>>")
    assert {tuple(r) for r in annotation.association_genes(loci).collect()} == {("A", 2), ("B", 1)}


def test_files(spark, tmp_path):
    f = put(tmp_path / "s.fa", ">one x\nACG\nT\n>two\nGG\n")
    assert [(r["header"], r["sequence"], r["length"]) for r in files.read_fasta(spark, f).orderBy("header").collect()] == [("one x", "ACGT", 4), ("two", "GG", 2)]
    assert [r[0] for r in files.read_gene_list(spark, put(tmp_path / "l.txt", "A # c\n\nB\nA\n")).collect()] == ["A", "B"]
    assert [r[0] for r in files.read_gene_list(spark, put(tmp_path / "l.tsv", "gene\ts\nA\t1\n")).collect()] == ["A"]
    top = tmp_path / "proj"
    put(top / "requirements.txt", "numpy==1.2\n# x\nrequests>=2\n"), put(top / "environment.yaml", "dependencies:\n  - python=3.11\n  - conda-forge::scipy=1.1\n"), put(top / "Snakefile", "rule\n")
    put(top / "renv.lock", json.dumps({"Packages": {"dplyr": {"Package": "dplyr", "Version": "1.0"}}})), put(top / "out.tsv.meta.json", json.dumps({"artifact": "out.tsv", "output_sha256": "ab", "params": {"k": "v"}}))
    put(top / ".hidden" / "x.meta.json", "{}")
    scan = files.scan_project(spark, str(top))
    assert {(r["package"], r["version"]) for r in scan["tools"].collect()} == {("numpy", "1.2"), ("python", "3.11"), ("scipy", "1.1"), ("dplyr", "1.0")}
    assert [r["kind"] for r in scan["workflows"].collect()] == ["snakemake"]
    assert [(r["artifact"], r["sha256"], r["params"]) for r in scan["artifacts"].collect()] == [("out.tsv", "ab", {"k": "v"})]


def test_references(spark, tmp_path):
    bib = {r["key"]: r for r in references.read_references(spark, put(tmp_path / "r.bib", BIB)).collect()}
    assert bib["one"]["title"] == "GSK3: a Role" and bib["one"]["doi"] == "10.1186/s13059-014-0550-8" and bib["one"]["first_author"] == "Smith" and bib["one"]["year"] == 2014
    assert bib["two"]["doi"] == "10.1000/abc.123" and bib["two"]["first_author"] == "Other" and bib["two"]["year"] == 2001
    plain = "1. Smith J, Doe A (2020). A study of many interesting things. Nature, 12(3):4-9. doi:10.1038/nature12345.\n\n2. Roe B. Another long title without any identifier. Cell. 1999;3:1.\n\nDownloaded from https://x.y/z on a day\n"
    rows = references.parse_references(spark.createDataFrame([(plain,)], "value string"), "text").collect()
    assert [(r["key"], r["doi"], r["year"], r["first_author"]) for r in rows] == [("1", "10.1038/nature12345", 2020, "Smith"), ("2", None, 1999, "Roe")]
    assert rows[0]["title"] == "A study of many interesting things" and rows[1]["title"] == "Another long title without any identifier"
    # a text UDF that has run holds JVM handles: what executors are sent afterwards must not reach it
    assert spark.createDataFrame([("A{b}",)], "t string").select(X.normalize_text("t")).first()[0] == "ab"
    tex = r"\begin{thebibliography}{9}\bibitem[S]{short}x\bibitem{smith}Smith J. \emph{A title that is r\'egulated} (2011). See \url{https://doi.org/10.1000/xyz.99}.\end{thebibliography}"
    rows = references.parse_references(spark.createDataFrame([(tex,)], "value string"), "latex").collect()
    assert [(r["key"], r["entry_type"], r["title"], r["doi"], r["year"]) for r in rows] == [("smith", "latex_bibitem", "A title that is régulated", "10.1000/xyz.99", 2011)]
    assert reftext.after_heading("a\nReferences\nb\n2. References:\nc").strip() == "c" and reftext.after_heading("a\nb") == "a\nb"


@pytest.mark.parametrize("line, title, family, year", [
    ('1. Gillis J, Pavlidis P (2011). The Impact of "Guilt by Association" Analysis. PLoS ONE, 6(2):e17258.', 'The Impact of "Guilt by Association" Analysis', "Gillis", 2011),
    ("[2] van der Berg J, O'Neil-Smith KL, et al.: Vitamin D in mice and E. coli? Nature 2001, 3:1-9.", "Vitamin D in mice and E. coli", "van der Berg", 2001),
    ("World Health Organization (2019). Global report on this vs. that. Geneva.", "Global report on this vs. that", "World", 2019),
    ("Love, M. I., Huber, W., and Anders, S. (2014). Moderated estimation of fold change. Genome Biology, 15(12):550.", "Moderated estimation of fold change", "Love", 2014),
    ("John Smith and Jane Doe. A long description of the methods of things. In: Proceedings. 1998.", "A long description of the methods of things", "John", 1998),
    ('Smith AB and Doe C. "A quoted title of this one." J Foo. 2010.', "A quoted title of this one", "Smith", 2010),
])
def test_fields_of_references(line, title, family, year):
    found = reftext.parse_block(line)
    assert (found["title"], found["first_author"], found["year"], found["doi"]) == (title, family, year, None)


def test_latex_and_bibtex_scanners():
    cases = {r"\textbf{\textit{Hello}} world": "Hello world", r"\"Ostlund and Caf\'e, \v{S}koda \c c, Stra\ss e, \L{}ukasz": "Östlund and Café, Škoda ç, Straße, Łukasz", r"\href{https://x.y/z}{doi:10.1/x} \url{https://doi.org/10.5/y}": "doi:10.1/x https://doi.org/10.5/y", "pp.~10--20, vol.~3---4": "pp. 10-20, vol. 3-4", "50\\% of a % gone\nb": "50% of a b", "{unclosed \\emph{x": "unclosed x", "": ""}
    assert {k: plaintext.plain_latex(k) for k in cases} == cases
    bib = '@comment{x}@string{j = "J"}\n@Article{k1,\n title = {{Deep} {G{S}K}: 50% more}, author = {{Ahlmann-Eltze}, C and Geuter, J{\\"u}rgen}, year = 2025, journal = "A " # "B \\& C"}\n@misc{k2, title = {No end'
    one, two = reftext.entries_of_bibtex(bib)
    assert (one["entry_type"], one["key"], one["title"], one["author"], one["year"], one["journal"]) == ("article", "k1", "Deep GSK: 50% more", "Ahlmann-Eltze, C and Geuter, Jürgen", "2025", "A B & C")
    assert two["key"] == "k2" and two["doi"] is None


def test_docx(spark, tmp_path):
    paragraphs = ["Body text that is no reference.", "References", "1. Love MI, Huber W (2014). Moderated estimation of fold change. Genome Biology 15(12):550. doi:10.1186/s13059-014-0550-8", "2. Brown K (2019). Title without a DOI. Journal of Hard Cases 1(1):1-5."]
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = f'<w:document xmlns:w="{ns}"><w:body>' + "".join(f"<w:p><w:r><w:t>{x[:9]}</w:t></w:r><w:r><w:t>{x[9:]}</w:t></w:r></w:p>" for x in paragraphs) + "</w:body></w:document>"
    path = str(tmp_path / "a.docx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", xml)
    rows = references.read_references(spark, path).collect()
    assert [(r["key"], r["title"], r["doi"], r["first_author"]) for r in rows] == [("1", "Moderated estimation of fold change", "10.1186/s13059-014-0550-8", "Love"), ("2", "Title without a DOI", None, "Brown")]


def test_validation(spark):
    works = spark.createDataFrame([("10.1/aaaaa1", "The impact of multifunctional genes", 2012, "Gillis", None, "crossref"), ("10.1/bbbbb2", "Quite another title of a work", 2000, "Roe", None, "pubmed")], references.RECORD.replace("key string, entry_type string, title string, doi string", "doi string, title string") + ", source string")
    works = works.union(spark.createDataFrame([("10.1/ccccc3", "The Art of War", 1910, "Müller", None, "crossref"), ("10.48550/arxiv.1", "On arXiv", 2020, "Doe", None, "arxiv"), *((f"10.1/d{i}", f"Impact multifunctional {i}", 2000, "X", None, "crossref") for i in range(40))], works.schema))
    c = [("a", "x", "The impact of multifunctional genes", "10.1/aaaaa1", 2012, "Gillis", None), ("b", "x", "The impact of multifunctional genes", "10.1/bbbbb2", 2012, "Gillis", None), ("c", "x", "Lost", "10.1/zzzzz9", None, None, None), ("d", "x", "the {IMPACT} of multifunctional genes", None, 2013, None, None), ("e", "x", "nothing alike", None, None, None, None)]
    c += [("f", "x", "the art of war", None, 1910, "Muller", None), ("g", "x", "Any", "10.48550/arXiv.1", None, None, None), ("h", "x", "Any", "10.48550/arXiv.2", None, None, None)]
    out = {r["key"]: r for r in references.validate(spark.createDataFrame(c, references.RECORD), works).collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a": "VERIFIED", "b": "CHIMERA", "c": "PHANTOM", "d": "VERIFIED_NO_DOI", "e": "NOT_FOUND", "f": "VERIFIED_NO_DOI", "g": "VERIFIED", "h": "PHANTOM"}
    assert out["f"]["author_match"] and out["f"]["db_title"] == "The Art of War" and (out["g"]["flags"], out["g"]["confidence"], out["g"]["title_similarity"]) == ("ARXIV_DOI", 0.85, None)
    assert out["b"]["flags"] == "TITLE_MISMATCH,YEAR_MISMATCH,AUTHOR_MISMATCH" and list(out["a"].asDict()) == references.REPORT


def test_scalars(spark):
    def one(f, *values):
        df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int'}" for i, v in enumerate(values)))
        return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first()["x"]

    assert one(X.normalize_text, r"{GSK3}: \emph{Régulation}, Actions") == "gsk3 regulation actions"
    full = "The Impact of Multifunctional Genes on Guilt by Association Analysis"
    assert one(X.title_similarity, "The {Impact} of Multifunctional Genes on ``Guilt by Association'' Analysis", full) == 1.0
    assert one(X.title_similarity, "Impact of Multifunctional Genes on Analysis", full) == pytest.approx(0.775, abs=1e-3)
    assert one(X.title_similarity, "A Completely Wrong Title That Does Not Match The Real Paper At All", full) == pytest.approx(0.209, abs=1e-3)
    assert one(X.clean_doi, "https://doi.org/10.1186/s13059-014-0550-8.") == "10.1186/s13059-014-0550-8" and one(X.clean_doi, "10.1126/science") is None
    assert one(X.first_valid_doi, "10.1126/science then 10.1126/science.aaa1934).") == "10.1126/science.aaa1934"
    assert one(X.to_uri, "GO:0006915") == "http://purl.obolibrary.org/obo/GO_0006915" and one(X.to_uri, "EFO:4530") == "http://www.ebi.ac.uk/efo/EFO_0004530"
    assert one(X.normalize_go_term, "go:6915") == "GO:0006915" and one(X.classify_gene_input, "UniProtKB:P04637") == "uniprot" and one(X.classify_gene_input, "TP53") == "symbol"
    assert one(X.parse_pdf_date, "D:20240117120000") == "2024-01-17" and one(lambda c: X.page_set(c, F.lit(6)), "1,3,5-7") == [1, 3, 5, 6]
    assert one(X.author_ok, "Müller", "Muller") and one(X.author_ok, "", "Muller") is None and not one(X.author_ok, "Roe", "Doe")
    assert one(X.clean_latex, r"M\"uller \& \textbf{S{\o}n} --- \emph{x}") == "Müller & Søn - x"
    assert [one(X.col_letter, i) for i in (1, 26, 27, 702, 703)] == ["A", "Z", "AA", "ZZ", "AAA"]
    cases = [((True, True, True, 1.0, True), ("VERIFIED", 1.0)), ((True, True, True, 0.775, True), ("SUSPICIOUS", 0.55)), ((True, True, True, 0.9, False), ("CORRUPTED", 0.8)), ((True, True, True, 0.209, True), ("CHIMERA", 0.9)), ((False, True, True, 0.0, True), ("PHANTOM", 0.95))]
    for args, want in cases:
        assert tuple(one(X.classify_citation, *args)) == want


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("A", 1, ["x", "y"]), (None, 2, [])], "gene string, n int, s array<string>")
    path = str(tmp_path / "out.tsv")
    side = sinks.write_artifact(df, path, ["gene", "n"], params={"k": 1}, single_file=True)
    assert sinks.is_fresh(spark, path) and sinks.read_sidecar(spark, path)["params"] == {"k": "1"}
    assert side["sha256"] == sinks.table_hash(sinks.read_artifact(spark, path).repartition(3))
    spark.createDataFrame([("B",)], "gene string").write.mode("append").csv(path, sep="\t", header=True)
    assert not sinks.is_fresh(spark, path)
    with pytest.raises(EngineError):
        sinks.write_artifact(df, path, ["nope"])
    with pytest.raises(EngineError):
        sinks.write_artifact(df.limit(0), str(tmp_path / "none.tsv"), ["gene"])
    f = put(tmp_path / "raw.txt", "content")
    sinks.stamp(spark, f, params={"a": 1}, doi="10.1/x")
    assert sinks.verify(spark, f).first()["ok"] and hashlib.sha256(b"content").hexdigest() in sinks.show(spark, f)
    put(tmp_path / "raw.txt", "other")
    assert not sinks.verify(spark, f).first()["ok"]
    assert sinks.write_commented(df.select("gene", "n"), str(tmp_path / "t.csv"), {"doi": "x", "none": ""}, order=["n"]) == sinks.write_commented(df.select("gene", "n"), str(tmp_path / "t.tsv"), {}, sep="\t", order=["n"])
    text = (tmp_path / "t.csv").read_text()
    assert text.startswith("# doi: x\n# sha256: ") and "none" not in text and text.endswith("gene,n\nA,1\n,2\n")
    assert "xl/worksheets/sheet2.xml" in zipfile.ZipFile(io.BytesIO(sinks.workbook({"S": [{"a": 1, "b": "<x>"}]}, {"k": "v"}))).namelist()
    assert sinks.cache_key(a=1, b="x") != sinks.cache_key(a=1, b="y") and len(sinks.cache_key(a="z" * 500)) <= 120
    tree = sinks.provenance_tree(spark.createDataFrame([("a", "b"), ("b", "c")], "artifact string, member string"))
    assert {tuple(r) for r in tree.select("artifact", "source").collect()} == {("a", "b"), ("a", "c"), ("b", "c")}


def test_catalog(spark):
    def reader(spark, ids, species="human", input=None):
        rows = [(f"E{i}", f"S{i}", None, species, "t") for i in ids]
        return spark.createDataFrame(rows, "ensembl_id string, symbol string, entrez_id string, species string, source string")

    c = Catalog(spark)
    c.register_reader("ids", reader)
    c.register("a", source="ids", params={"ids": [1, 2, 3]})
    c.register("b", source="ids", params={"ids": [2, 3, 4]})
    c.register("m", source="ids", params={"ids": [1], "species": "mouse"}, input="a")
    c.register("both", op="intersection", members=["a", "b"], uniform=["species"])
    c.register("all", op="union", members=["both", "b"])
    c.register("mixed", op="union", members=["a", "m"], uniform=["species"])
    c.register("loop", op="union", members=["loop"])
    assert {r["ensembl_id"] for r in c.resolve("all").collect()} == {"E2", "E3", "E4"} and c.lineage().count() == 8
    for bad in ("mixed", "loop", "nope"):
        with pytest.raises(EngineError):
            c.resolve(bad)
