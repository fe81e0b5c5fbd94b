"""Scalar functions on identifiers, titles and dates. Built-in expressions; Arrow UDFs only where Spark has none."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plaintext import plain, plain_latex, similarity

#: Prefixes whose terms have PURLs of the same shape, and the one that has its own.
OBO_PREFIXES = "GO MONDO MP HP CL UBERON DOID CHEBI PR OBI PATO EMAPA MA ZFA FBBT WBBT NBO SYMP SO OBA NCBITAXON RO BFO IAO OGMS".split()
PURL, EFO = "http://purl.obolibrary.org/obo/", "http://www.ebi.ac.uk/efo/EFO_"


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


# ---------------------------------------------------------------- titles


@F.pandas_udf(T.StringType())
def normalize_text(s: pd.Series) -> pd.Series:
    return s.map(lambda x: plain(x) if isinstance(x, str) else "")


@F.pandas_udf(T.DoubleType())
def title_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b, strict=True)], dtype="float64")


# ---------------------------------------------------------------- DOIs, years, authors


def clean_doi(raw: Column, *, least: int = 5, strip: str = ".,;)") -> Column:
    """A DOI without URL or doi: prefix and trailing punctuation; null unless it starts 10. and its suffix has `least` characters and a digit."""
    d = F.regexp_replace(F.trim(raw), r"(?i)^https?://(dx\.)?doi\.org/", "")
    d = F.regexp_replace(F.regexp_replace(d, r"(?i)^doi:\s*", ""), "[" + re.escape(strip) + "]+$", "")
    suffix = F.regexp_extract(d, r"(?s)^[^/]*/(.*)$", 1)
    return F.when(d.startswith("10.") & (F.length(suffix) >= least) & suffix.rlike("[0-9]"), d)


def extract_doi(text: Column) -> Column:
    """The first 10.xxxx/... of a text without trailing punctuation."""
    return _nonempty(F.regexp_replace(F.regexp_extract(text, r"\b(10\.[0-9]{4,}/\S+)", 1), r"""[.,;)>"\]}']+$""", ""))


def first_valid_doi(text: Column) -> Column:
    """The first DOI of a document's text that is valid (suffix of 4 or more): other candidates are passed over."""
    found = F.regexp_extract_all(text, F.lit(r"\b(10\.[0-9]{4,}/\S+)"), F.lit(1))
    return F.get(F.filter(F.transform(found, lambda x: clean_doi(x, least=4, strip=".,;:)>\"]}'")), lambda x: x.isNotNull()), F.lit(0))


def first_author(authors: Column) -> Column:
    """Family name of the first of authors joined by and: what stands before a comma, else the last word."""
    one = F.trim(F.get(F.split(authors, r"(?i)\s+and\s+"), F.lit(0)))
    return _nonempty(F.when(one.contains(","), F.trim(F.substring_index(one, ",", 1))).otherwise(F.regexp_extract(one, r"(\S+)$", 1)))


def extract_year(text: Column) -> Column:
    """The first year of 1900 to 2099, bare or in brackets. Numbers within an http(s) address are no years: it is passed over whole."""
    found = F.regexp_extract_all(text, F.lit(r"(?i:\bhttps?://[^\s()<>\"]+)|\(([0-9]{4})\)|\b(?:19|20)[0-9]{2}\b"), F.lit(0))
    years = F.transform(found, lambda x: F.regexp_replace(x, "[()]", "").try_cast("int"))
    return F.get(F.filter(years, lambda y: y.between(1900, 2099)), F.lit(0))


def year_ok(stated: Column, found: Column) -> Column:
    """At most a year apart; null if either is missing."""
    return F.abs(stated - found) <= 1


def author_ok(stated: Column, found: Column) -> Column:
    """Of folded names (lower case, no accents): one contains the other, or both begin with the same four letters.

    Null if either is missing or has no letters.
    """
    a, b = _nonempty(normalize_text(stated)), _nonempty(normalize_text(found))
    return a.contains(b) | b.contains(a) | ((F.length(a) >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4)))


def is_arxiv(doi: Column) -> Column:
    return F.coalesce(doi.rlike(r"(?i)^10\.48550/arXiv\."), F.lit(False))


def classify_citation(found: Column, has_doi: Column, has_title: Column, ts: Column, ym: Column) -> Column:
    """Status and confidence of a citation as a struct. The first rule that holds decides; a null ym doesn't contradict."""
    ok = F.coalesce(ym, F.lit(True))

    def verdict(status: str, confidence: Column | float) -> Column:
        c = confidence if isinstance(confidence, Column) else F.lit(confidence)
        return F.struct(F.lit(status).alias("status"), c.cast("double").alias("confidence"))

    with_doi = (
        F.when(~has_title, verdict("VERIFIED", 0.75))
        .when((ts >= 0.85) & ok, verdict("VERIFIED", F.round(0.85 + 0.15 * ts, 2)))
        .when((ts >= 0.65) & ok, verdict("SUSPICIOUS", 0.55))
        .when(ts >= 0.5, verdict("CORRUPTED", 0.80))
        .otherwise(verdict("CHIMERA", 0.90))
    )
    without = F.when((ts >= 0.85) & ok, verdict("VERIFIED_NO_DOI", 0.80)).when(ts >= 0.65, verdict("SUSPICIOUS", 0.45)).otherwise(verdict("NOT_FOUND", 0.55))
    missing = F.when(has_doi, verdict("PHANTOM", 0.95)).otherwise(verdict("NOT_FOUND", 0.50))
    return F.when(found.isNull(), verdict("UNVERIFIABLE", 0.0)).when(~found, missing).when(has_doi, with_doi).otherwise(without)


def citation_flags(found: Column, has_doi: Column, ts: Column, ym: Column, am: Column) -> Column:
    """Flags beside the status, which don't depend on it."""
    flag = lambda name, on: F.when(F.coalesce(on, F.lit(False)), F.lit(name))
    known = F.coalesce(found, F.lit(False))
    all_flags = F.array(
        flag("API_ERROR", found.isNull()),
        flag("DOI_NOT_FOUND", ~known & found.isNotNull() & has_doi),
        flag("NO_MATCH_FOUND", ~known & found.isNotNull() & ~has_doi),
        flag("TITLE_MISMATCH", known & (ts < 0.65)),
        flag("YEAR_MISMATCH", known & ~ym),
        flag("AUTHOR_MISMATCH", known & ~am),
    )
    return F.array_compact(all_flags)


# ---------------------------------------------------------------- terms and genes


def to_uri(term: Column) -> Column:
    """PREFIX:digits as a URI; EFO has its own, with seven digits. URIs stay; anything else is null."""
    prefix, num = F.regexp_extract(term, r"^([A-Za-z]+):([0-9]+)$", 1), F.regexp_extract(term, r"^([A-Za-z]+):([0-9]+)$", 2)
    seven = F.when(F.length(num) < 7, F.lpad(num, 7, "0")).otherwise(num)
    return F.when(term.rlike("^https?://"), term).when(F.upper(prefix) == "EFO", F.concat(F.lit(EFO), seven)).when(prefix != "", F.concat(F.lit(PURL), prefix, F.lit("_"), num))


def to_compact(term: Column) -> Column:
    """A term's URI as PREFIX:digits; compact terms stay; anything else is null."""
    p = r"^https?://(?:purl\.obolibrary\.org/obo/([A-Za-z]+)_|www\.ebi\.ac\.uk/efo/(EFO)_)([0-9]+)$"
    prefix = F.coalesce(_nonempty(F.regexp_extract(term, p, 1)), _nonempty(F.regexp_extract(term, p, 2)))
    return F.when(term.rlike(r"^[A-Za-z]+:[0-9]+$"), term).when(prefix.isNotNull(), F.concat(prefix, F.lit(":"), F.regexp_extract(term, p, 3)))


def infer_ontology(term: Column) -> Column:
    """The ontology's name: the lower-case prefix, known or not."""
    return F.lower(F.substring_index(to_compact(term), ":", 1))


def is_known_prefix(term: Column) -> Column:
    return F.upper(F.substring_index(to_compact(term), ":", 1)).isin([*OBO_PREFIXES, "EFO"])


def normalize_go_term(term: Column) -> Column:
    """GO terms in compact form with seven digits; null for others."""
    digits = F.regexp_extract(F.trim(term), r"(?i)^(?:GO[:_]|https?://purl\.obolibrary\.org/obo/GO_)?([0-9]{1,7})$", 1)
    return F.when(digits != "", F.concat(F.lit("GO:"), F.lpad(digits, 7, "0")))


def classify_gene_input(s: Column) -> Column:
    """Kind of a gene identifier by its shape: prefixed ids are of a database, the rest are symbols."""
    t = F.trim(s)
    return (
        F.when(t.rlike(r"^UniProtKB:"), "uniprot").when(t.rlike(r"^MGI:[0-9]+$"), "mgi").when(t.rlike(r"^RGD:[0-9]+$"), "rgd")
        .when(t.rlike(r"^ENS[A-Z]*G[0-9]{11}"), "ensembl").when(t.rlike(r"^(?:NCBIGene:)?[0-9]+$"), "entrez").when(t.contains(":"), "curie").when(t != "", "symbol")
    )


def strip_version(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def sanitize(s: Column, most: int = 120) -> Column:
    return F.substring(F.regexp_replace(s, r"[^A-Za-z0-9._-]+", "_"), 1, most)


def slug(s: Column, most: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^a-z0-9]+", "_"), r"^_+|_+$", ""), 1, most)


def banner(s: Column) -> Column:
    """figure_2_panel as Figure 2 Panel: the first letter of each word is raised, the rest stays."""
    words = F.split(F.regexp_replace(s, r"[_\s-]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def col_letter(n: Column) -> Column:
    """Spreadsheet letters of a column number from 1 (up to three letters)."""
    a = lambda x: F.char(F.lit(65) + x)
    i = n.cast("long") - 1
    one, two, three = a(i % 26), a(F.floor((i - 26) / 26) % 26), a(F.floor((i - 702) / 676) % 26)
    return F.when(i < 26, one).when(i < 702, F.concat(two, one)).otherwise(F.concat(three, two, one))


def parse_pdf_date(s: Column) -> Column:
    """D:YYYYMMDD... as YYYY-MM-DD; null otherwise."""
    d = F.regexp_extract(s, r"^(?:D:)?([0-9]{8})", 1)
    return F.when(d != "", F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def page_set(spec: str | Column, total: Column) -> Column:
    """Pages of 1,3,5-7 as a sorted array of distinct numbers from 1 to total."""
    c = F.lit(spec) if isinstance(spec, str) else spec

    def pages(p: Column) -> Column:
        lo = F.regexp_extract(p, r"^\s*([0-9]+)", 1).cast("int")
        hi = F.coalesce(F.when(p.contains("-"), F.try_to_number(F.regexp_extract(p, r"-\s*([0-9]+)", 1), F.lit("9999999")).cast("int")), lo)
        return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    parts = F.filter(F.split(c, ","), lambda p: p.rlike("[0-9]"))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(parts, pages)), lambda x: x.between(1, total))))


# ---------------------------------------------------------------- LaTeX


@F.pandas_udf(T.StringType())
def clean_latex(s: pd.Series) -> pd.Series:
    return s.map(lambda x: plain_latex(x) if isinstance(x, str) else "")
