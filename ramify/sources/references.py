"""Bibliographies: BibTeX, plain text and LaTeX to citation records; validation against a table of works."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.joins import candidate_match
from .reftext import BIB_FIELDS, PARSERS, entries_of_bibtex

RECORD = "key string, entry_type string, title string, doi string, year int, first_author string, journal string"
#: The namespace of a .docx file's text: a fixed value of the format.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REPORT = ["key", "status", "flags", "confidence", "stated_title", "stated_doi", "stated_year", "stated_first_author", "db_title", "db_doi", "db_year", "db_first_author", "source", "title_similarity", "year_match", "author_match", "notes"]


def _rows(texts: DataFrame, parse: Callable[[str], list[dict]], names: list[str], schema: str, column: str, id_col: str | None) -> DataFrame:
    """A row for each record that parse finds in a document; doc is its id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"doc": d, **r} for d, t in zip(b["doc"], b["t"], strict=True) for r in parse(t or "")]
            out = pd.DataFrame(rows, columns=["doc", *names])
            yield out.astype({"year": "Int32"}) if "year int" in schema else out

    docs = texts.select((F.col(id_col).cast("string") if id_col else F.lit("")).alias("doc"), F.col(column).cast("string").alias("t"))
    return docs.mapInPandas(run, "doc string, " + schema)


def parse_bibtex(texts: DataFrame, column: str = "value", id_col: str | None = None) -> DataFrame:
    """Citation records of BibTeX texts, a file a row: values in braces of any depth, quotes or bare."""
    names = ["entry_type", "key", *BIB_FIELDS]
    e = _rows(texts, entries_of_bibtex, names, ", ".join(f"{n} string" for n in names), column, id_col)
    doi = F.coalesce(X.clean_doi(F.col("doi")), X.clean_doi(X.extract_doi(F.col("url"))))
    found = e.select(
        "doc", "key", "entry_type", "title", doi.alias("doi"), F.regexp_extract(F.coalesce("year", "date"), "([0-9]{4})", 1).try_cast("int").alias("year"),
        X.first_author(F.col("author")).alias("first_author"), F.coalesce("journal", "journaltitle", "booktitle").alias("journal"),
    )
    return found if id_col else found.drop("doc")


def parse_references(texts: DataFrame, kind: str, column: str = "value", id_col: str | None = None) -> DataFrame:
    """Citation records of whole texts (text, latex, or document: after the last reference heading), a document a row."""
    found = _rows(texts, PARSERS[kind], [x.split()[0] for x in RECORD.split(", ")], RECORD, column, id_col)
    return found if id_col else found.drop("doc")


def _paragraphs(data: bytes) -> str:
    """The paragraphs of a .docx file (a zip of XML), with blank lines between."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    found = ("".join((x.text or "") if x.tag == WORD + "t" else " " for x in p.iter() if x.tag in (WORD + "t", WORD + "tab", WORD + "br")) for p in root.iter(WORD + "p"))
    return "\n\n".join(x.strip() for x in found if x.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """The text of .docx files: path, value (paragraphs between blank lines). A file that is no .docx raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "value": [_paragraphs(bytes(x)) for x in b["content"]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, value string")


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """Citation records of a file, by its suffix: .bib, .tex or .bbl, .docx (after its last reference heading), else plain text."""
    if path.endswith(".docx"):
        return parse_references(read_docx(spark, path), "document")
    texts = spark.read.text(path, wholetext=True)
    if path.endswith(".bib"):
        return parse_bibtex(texts)
    return parse_references(texts, "latex" if path.endswith((".tex", ".bbl")) else "text")


# ---------------------------------------------------------------- validation


def validate(citations: DataFrame, works: DataFrame, sources: Sequence[str] = ("crossref", "openalex", "pubmed"), accept: float = 0.35) -> DataFrame:
    """The report of citations (RECORD) against works (doi, title, year, first_author, journal, source).

    A stated DOI is looked up, in the sources' order; an arXiv DOI among the works of source arxiv. Without a DOI, works
    that share a word of five letters or more with the title are candidates (any word, for a title without such a
    word), and the most similar title of the first source that has one of at least `accept` is found.
    """
    works = works.select("doi", "title", "year", "first_author", "source").withColumn("doi", F.lower("doi"))
    order = F.array(*(F.lit(s) for s in sources))
    work = F.struct("title", "doi", "year", "first_author", "source").alias("w")
    c = citations.select("key", "title", F.lower("doi").alias("doi"), "year", "first_author")
    place = F.coalesce(F.nullif(F.array_position(order, F.col("source")), F.lit(0)), F.lit(len(sources) + 1).cast("long"))
    by_doi = works.where("doi IS NOT NULL").groupBy("doi").agg(F.min_by(work, F.struct(place, F.col("title"))).alias("w"))
    with_doi = c.where("doi IS NOT NULL").join(by_doi, "doi", "left").select(*c.columns, "w")
    rest = c.where("doi IS NULL")
    words = F.array_distinct(F.filter(F.split("_plain", " "), lambda x: x != ""))
    stated = rest.where("title IS NOT NULL").withColumn("_plain", X.normalize_text("title")).withColumns({"_words": words, "_letters": F.length("_plain")})
    long = F.filter("_words", lambda x: F.length(x) >= 5)
    stated = stated.withColumn("word", F.explode(F.when(F.size(long) > 0, long).otherwise(F.col("_words")))).drop("_plain", "_words")
    cand = works.where("title IS NOT NULL").withColumn("_plain", X.normalize_text("title")).withColumns({"word": F.explode(words), "_length": F.length("_plain")})
    cand = cand.select(*(F.col(x).alias(f"w_{x}") for x in works.columns), F.col("_length").alias("w_length"), "word")
    # the ratio is at most twice the shorter title over both
    may = 2 * F.least("_letters", "cand.w_length") >= accept * (F.col("_letters") + F.col("cand.w_length"))
    best = candidate_match(stated, cand, block="word", key="key", similarity=X.title_similarity(F.col("title"), F.col("cand.w_title")), source="w_source", sources=sources, accept=accept, may=may)
    best = best.select("key", F.when(F.col("cand").isNotNull(), F.struct(*(F.col(f"cand.w_{x}").alias(x) for x in ("title", "doi", "year", "first_author", "source")))).alias("w"))
    both = with_doi.unionByName(rest.join(best, "key", "left").select(*c.columns, "w"))
    both = both.withColumn("ts", F.when(F.col("w").isNotNull(), X.title_similarity(F.col("title"), F.col("w.title")))).withColumns({"ym": X.year_ok(F.col("year"), F.col("w.year")), "am": X.author_ok(F.col("first_author"), F.col("w.first_author"))})
    found = F.col("w").isNotNull()
    v = X.classify_citation(found, F.col("doi").isNotNull(), F.col("title").isNotNull(), F.col("ts"), F.col("ym"))
    flags = X.citation_flags(found, F.col("doi").isNotNull(), F.col("ts"), F.col("ym"), F.col("am"))
    arxiv = X.is_arxiv(F.col("doi"))
    known = F.coalesce(F.col("w.source") == "arxiv", F.lit(False))  # an arXiv DOI is only looked up, not compared

    def unless_arxiv(c: F.Column) -> F.Column:
        return F.when(~arxiv, c)

    return both.withColumn("v", v).select(
        "key", F.when(arxiv, F.when(known, "VERIFIED").otherwise("PHANTOM")).otherwise(F.col("v.status")).alias("status"), F.when(arxiv, F.when(known, "ARXIV_DOI").otherwise("")).otherwise(F.array_join(flags, ",")).alias("flags"),
        F.when(arxiv, F.when(known, 0.85).otherwise(0.5)).otherwise(F.col("v.confidence")).alias("confidence"), F.col("title").alias("stated_title"), F.col("doi").alias("stated_doi"),
        F.col("year").alias("stated_year"), F.col("first_author").alias("stated_first_author"), unless_arxiv(F.col("w.title")).alias("db_title"), F.when(~arxiv | known, F.col("w.doi")).alias("db_doi"), unless_arxiv(F.col("w.year")).alias("db_year"),
        unless_arxiv(F.col("w.first_author")).alias("db_first_author"), F.when(~arxiv | known, F.col("w.source")).alias("source"), unless_arxiv(F.round("ts", 4)).alias("title_similarity"), unless_arxiv(F.col("ym")).alias("year_match"), unless_arxiv(F.col("am")).alias("author_match"),
        F.when(arxiv & known, "verified by arXiv records").when(arxiv, "arXiv DOI; not in the records").otherwise("").alias("notes"),
    )
