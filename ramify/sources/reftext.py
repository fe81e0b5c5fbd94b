"""References written as text, read field by field: authors, year, title, locator, links.

A reference is scanned from the left. Names are taken while they look like a family name with initials; a year in
brackets may follow; the title is the next sentence. Where no names are found, the title is the first sentence
after the first that reads as prose. No Spark objects here, so executors can be sent any of it.
"""

from __future__ import annotations

import re

from ..functions.plaintext import bibliography_items, plain_latex

#: What page furniture begins with, abbreviations that end no sentence, particles of family names.
FURNITURE = ("downloaded from http", "biorxiv preprint", "figure ", "fig. ", "table ", "plos ")
ABBREVIATIONS = frozenset("vs pp al ed eds vol fig cf ca approx suppl no nr dr mr mrs prof jr sr dept univ st sp spp".split())
PARTICLES = frozenset("van von de der den del della di da dos du la le ter ten zu zur af bin ibn".split())
JOINERS = frozenset(["and", "&", "et", "al", "al."])
HEADINGS = frozenset(["references", "bibliography", "literature cited", "works cited"])
LINK = re.compile(r"https?://\S+|\b10\.\d{4,}/\S+")
DOI = re.compile(r"\b10\.\d{4,}/\S+")
NUMBER = re.compile(r"[0-9]+")
LEAST_BLOCK, LEAST_TEXT, LEAST_TITLE = 20, 15, 10


# ---------------------------------------------------------------- blocks


def entry_number(line: str) -> int:
    """Characters of a leading [1], (1) or 1. that numbers an entry; 0 if there is none."""
    at = len(line) - len(line.lstrip())
    start = at
    if line[at : at + 1] in ("[", "("):
        at += 1
    digits = NUMBER.match(line, at)
    if not digits:
        return 0
    at = digits.end()
    if line[at : at + 1] not in ("]", ")", ".") or (line[start] in "[(" and line[at] == "."):
        return 0
    return at + 1 if line[at + 1 : at + 2].isspace() else 0


def blocks(text: str) -> list[str]:
    """Entries: what stands between blank lines, and from each numbered line on."""
    out: list[list[str]] = [[]]
    for line in text.strip().split("\n"):
        if not line.strip():
            if out[-1]:
                out.append([])
            continue
        if out[-1] and entry_number(line):
            out.append([])
        out[-1].append(line)
    return ["\n".join(x) for x in out if x]


def is_furniture(line: str) -> bool:
    return line.strip().lower().startswith(FURNITURE)


def after_heading(text: str) -> str:
    """What follows the last heading of references, or all."""
    lines = text.split("\n")
    for k in range(len(lines) - 1, -1, -1):
        if lines[k].strip().lstrip("0123456789. ").rstrip(": ").lower() in HEADINGS:
            return "\n".join(lines[k + 1 :])
    return text


# ---------------------------------------------------------------- fields


def doi_of(text: str) -> str | None:
    found = DOI.search(text)
    doi = found[0].rstrip(".,;)>\"]}'") if found else ""
    suffix = doi.partition("/")[2]
    return doi if len(suffix) >= 5 and any(c.isdigit() for c in suffix) else None


def year_of(text: str) -> int | None:
    """The first number of four digits from 1900 to 2099 that stands alone."""
    for m in NUMBER.finditer(text):
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if len(m[0]) == 4 and 1900 <= int(m[0]) <= 2099 and not before.isalpha() and not after.isalpha():
            return int(m[0])
    return None


def _is_initials(word: str) -> bool:
    letters = word.replace(".", "").replace("-", "")
    return 0 < len(letters) <= 3 and letters.isalpha() and letters.isupper()


def _is_family(word: str) -> bool:
    return len(word) > 1 and word[0].isupper() and any(c.islower() for c in word) and all(c.isalpha() or c in "-'’" for c in word)


def take_authors(text: str) -> tuple[str | None, int]:
    """Family name of the first author, and where the list of authors ends (0: there is none).

    An author is a family name of up to three words, with particles, then initials; a comma may stand between.
    """
    words = [(m[0], m.end()) for m in re.finditer(r"\S+", text)]
    first, at, end = None, 0, 0
    while at < len(words):
        if first and words[at][0].strip(",.;:") in JOINERS:
            at += 1
            if words[at - 1][0].startswith("al"):  # et al. ends the list
                end = words[at - 1][1]
                break
            continue
        k, family = at, []
        while k < len(words) and len(family) < 5:
            word = words[k][0].rstrip(",;")
            if not (_is_family(word) or word.lower() in PARTICLES):
                break
            family.append(word)
            k += 1
            if words[k - 1][0] != word:  # a comma ends the family name
                break
        initials = k
        while k < len(words) and _is_initials(words[k][0].rstrip(",;:.")):
            if k > initials and "." not in words[k][0]:  # J. A title: initials in the style of the first
                break
            k += 1
            if words[k - 1][0][-1] != ".":
                break
        if not family or not _is_family(family[-1]) or k == initials:
            break
        first = first or " ".join(family)
        at, end = k, words[k - 1][1]
        if words[k - 1][0][-1] == ":":
            break
    return first, end


def sentence_end(text: str, start: int = 0) -> int:
    """Where the sentence ends that begins at start: at . ? or ! before a blank and a new beginning, not in quotes or brackets."""
    quoted, depth = False, 0
    for k in range(start, len(text)):
        c = text[k]
        if c == '"':
            quoted = not quoted
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c in ".?!" and not depth:
            rest = text[k + 1 :].lstrip()
            if text[k + 1 : k + 2] == '"' and quoted:
                return k
            if not rest:
                return k
            if quoted or not text[k + 1].isspace() or rest[0].islower():
                continue
            word = text[start:k].split()[-1:] or [""]
            if c == "." and word[0].strip("([").lower() in ABBREVIATIONS:
                continue
            return k
    return len(text)


def _is_prose(sentence: str) -> bool:
    """A sentence that may be a title where nothing else tells: long enough, of words, neither a list of names nor a locator."""
    words = sentence.split()
    lower = sum(w[0].islower() for w in words)
    return len(sentence) >= LEAST_BLOCK and sentence[0].isupper() and lower >= 2 and sentence.count(",") < 2 and sum(c.isdigit() for c in sentence) * 4 < len(sentence)


def _skip(text: str, at: int) -> int:
    """Past blanks, punctuation and one year (in brackets, with a letter, or bare)."""
    year = re.compile(r"[\s.,:;]*(?:\(\s*[0-9]{4}[a-z]?\s*\)|[0-9]{4}[a-z]?(?=[.,:;]))?[\s.,:;]*")
    return year.match(text, at).end()


def title_of(line: str) -> str | None:
    """The title of a reference, without its number and links."""
    _, at = take_authors(line)
    if not at:  # names in full, or an organisation: they end at a year in brackets
        found = re.search(r"\([0-9]{4}[a-z]?\)", line)
        at = found.start() if found and sentence_end(line) >= found.start() else 0
    title = ""
    if at:
        start = _skip(line, at)
        title = line[start : sentence_end(line, start)]
    else:
        at = sentence_end(line) + 1
        while at < len(line) and not title:
            end = sentence_end(line, at)
            if _is_prose(line[at:end].strip()):
                title = line[at:end]
            at = end + 1
    title = title.strip().strip('"“”').rstrip(".,; ")
    tail = re.search(r"[.,]?\s+(?:[Ii]n: |[Pp]resented at ).*$|\s*\([0-9]{4}[a-z]?\)$", title)
    title = title[: tail.start()] if tail else title
    return title if len(title) >= LEAST_TITLE and any(c.isalpha() for c in title) else None


def parse_block(block: str, entry_type: str = "unknown") -> dict | None:
    """One reference, or None for page furniture and blocks with too little text."""
    lines = [x for x in block.split("\n") if x.strip()]
    if not lines or is_furniture(lines[0]):
        return None
    line = " ".join(x.strip() for x in lines if not is_furniture(x))
    line = line[entry_number(line + " ") :].strip()
    words = " ".join(LINK.sub(" ", line).split())
    if len(line) < LEAST_BLOCK or len(words) < LEAST_TEXT:
        return None
    family, _ = take_authors(words)
    if not family:
        family = next((w for w in (x.strip(",.;:()[]\"") for x in words.split()[:1]) if _is_family(w)), None)
    return {"entry_type": entry_type, "title": title_of(words), "doi": doi_of(line), "year": year_of(words), "first_author": family, "journal": None}


def references_of_text(text: str) -> list[dict]:
    """Keys are the numbers of the blocks from 1, those that give no reference included."""
    found = ((str(i), parse_block(b)) for i, b in enumerate(blocks(text), 1))
    return [{"key": k, **r} for k, r in found if r]


def references_of_latex(text: str) -> list[dict]:
    r"""Items of a bibliography: each \bibitem keeps its own key through the parse."""
    found = ((key, parse_block(plain_latex(source), "latex_bibitem")) for key, source in bibliography_items(text))
    return [{"key": k, **r} for k, r in found if r]


PARSERS = {"text": references_of_text, "latex": references_of_latex, "document": lambda text: references_of_text(after_heading(text))}


# ---------------------------------------------------------------- BibTeX

BIB_FIELDS = ("title", "doi", "url", "year", "date", "author", "journal", "journaltitle", "booktitle")
NO_ENTRIES = ("comment", "string", "preamble")


class BibScanner:
    """Entries of a BibTeX file, from left to right: values in balanced braces, quotes, or bare, joined by #."""

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def entries(self) -> list[dict]:
        out = []
        while (at := self.s.find("@", self.i)) >= 0:
            self.i = at + 1
            kind = self._word().lower()
            self._blanks()
            if self.s[self.i : self.i + 1] not in ("{", "("):
                continue
            self.i += 1
            if kind in NO_ENTRIES:
                self._balanced("}" if self.s[self.i - 1] == "{" else ")")
                continue
            self._blanks()
            key = self._upto(",}").strip()
            fields: dict[str, str] = {}
            while self.s[self.i : self.i + 1] == ",":
                self.i += 1
                self._blanks()
                name = self._upto("=,}").strip().lower()
                if self.s[self.i : self.i + 1] == "=":
                    self.i += 1
                    fields.setdefault(name, self._value())
            self.i += 1
            if key:
                out.append({"entry_type": kind, "key": key} | {k: plain_latex(fields.get(k, ""), comments=False) or None for k in BIB_FIELDS})
        return out

    def _blanks(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def _word(self) -> str:
        start = self.i
        while self.i < len(self.s) and (self.s[self.i].isalnum() or self.s[self.i] == "_"):
            self.i += 1
        return self.s[start : self.i]

    def _upto(self, stops: str) -> str:
        start = self.i
        while self.i < len(self.s) and self.s[self.i] not in stops:
            self.i += 1
        return self.s[start : self.i]

    def _balanced(self, closing: str) -> str:
        """What comes up to a closing sign outside inner braces, which is passed over."""
        start, depth = self.i, 0
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == "\\":
                self.i += 1
            elif c == closing and not depth:
                return self.s[start : self.i - 1]
            elif c in "{}":
                depth += 1 if c == "{" else -1
        return self.s[start:]

    def _value(self) -> str:
        parts = []
        while True:
            self._blanks()
            c = self.s[self.i : self.i + 1]
            if c in ("{", '"'):
                self.i += 1
                parts.append(self._balanced("}" if c == "{" else '"'))
            else:
                parts.append(self._upto(",}#").strip())
            self._blanks()
            if self.s[self.i : self.i + 1] != "#":
                return "".join(parts)
            self.i += 1


def entries_of_bibtex(text: str) -> list[dict]:
    return BibScanner(text).entries()
