"""Plain Python on single strings: folded titles, LaTeX to text. No Spark objects, so executors can be sent any of it."""

from __future__ import annotations

import difflib
import re
import unicodedata

#: ASCII to folded text: letters in lower case, punctuation (but _) to spaces, braces to nothing.
FOLD = {c: chr(c).lower() if chr(c).isalnum() or c == 95 else " " for c in range(128)} | {ord("{"): None, ord("}"): None}
#: A command in front of its argument.
COMMAND = re.compile(r"\\[A-Za-z]+(?=\{)")


def plain(s: str | None) -> str:
    """Lower-case ASCII words: commands reduced to their argument, accents folded, punctuation to spaces, other signs dropped."""
    if not s:
        return ""
    ascii_only = unicodedata.normalize("NFKD", COMMAND.sub("", s)).encode("ascii", "ignore").decode()
    return " ".join(ascii_only.translate(FOLD).split())


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff/Obershelp ratio of plain titles; 0 if both are empty. The order of arguments matters in rare cases."""
    x, y = plain(a), plain(b)
    return difflib.SequenceMatcher(None, x, y).ratio() if x or y else 0.0


# ---------------------------------------------------------------- LaTeX
# Fixed values of LaTeX: accent commands with their combining marks, letters that have commands, commands whose text
# is their second argument, characters that are escaped.

ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "k": "\u0328", "r": "\u030a", "d": "\u0323"}
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ"}
SECOND_ARGUMENT = ("href", "bibinfo", "bibfield", "textcolor")
ESCAPED = "&%#$_{}"


class LatexScanner:
    """One pass over LaTeX source, from left to right; text() is what a reader would see."""

    def __init__(self, source: str, comments: bool = True):
        self.s, self.i, self.comments = source, 0, comments

    def text(self) -> str:
        return " ".join(self._until(None).split())

    def _until(self, closing: str | None) -> str:
        """The text up to a closing bracket at this level (which is passed over), or to the end."""
        out = []
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == closing:
                break
            if c == "\\":
                out.append(self._command())
            elif c == "{":
                out.append(self._until("}"))
            elif c == "%" and self.comments:
                end = self.s.find("\n", self.i)
                self.i = len(self.s) if end < 0 else end + 1
            elif c == "-":
                while self.i < len(self.s) and self.s[self.i] == "-":
                    self.i += 1
                out.append("-")
            elif c != "}":
                out.append(" " if c == "~" else c)
        return "".join(out)

    def _blanks(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def _group(self, opening: str = "{", closing: str = "}") -> str | None:
        """The text of a group, if one comes next."""
        at = self.i
        self._blanks()
        if self.i < len(self.s) and self.s[self.i] == opening:
            self.i += 1
            return self._until(closing)
        self.i = at
        return None

    def _letter(self) -> str:
        """What an accent goes on: a group, a command or one character."""
        found = self._group()
        if found is None and self.i < len(self.s):
            self._blanks()
            found = self.s[self.i : self.i + 1]
            self.i += 1
            if found == "\\":
                found = self._command()
        return found or ""

    def _accented(self, mark: str) -> str:
        base = self._letter().strip().replace("ı", "i").replace("ȷ", "j")
        return unicodedata.normalize("NFC", base[:1] + mark + base[1:]) if base else ""

    def _command(self) -> str:
        """The text of the command whose backslash has just been passed."""
        start = self.i
        while self.i < len(self.s) and self.s[self.i].isascii() and self.s[self.i].isalpha():
            self.i += 1
        name = self.s[start : self.i]
        if not name:
            sign = self.s[self.i : self.i + 1]
            self.i += 1
            if sign in ACCENTS:
                return self._accented(ACCENTS[sign])
            return sign if sign and sign in ESCAPED else "" if sign in ("-", "/") else " "
        if name in LETTERS:
            self._group()  # an empty group or a blank only ends the name
            if self.s[self.i : self.i + 1].isspace():
                self.i += 1
            return LETTERS[name]
        if name in ACCENTS and (self.s[self.i : self.i + 1].isspace() or self.s[self.i : self.i + 1] == "{"):
            return self._accented(ACCENTS[name])
        if self.s[self.i : self.i + 1] == "*":
            self.i += 1
        self._group("[", "]")
        first = self._group()
        if first is None:
            return " "
        if name in SECOND_ARGUMENT and (second := self._group()) is not None:
            return second
        return first


def plain_latex(s: str | None, comments: bool = True) -> str:
    """LaTeX as plain text: accents composed, commands replaced by their arguments, escapes, dashes and braces resolved."""
    return LatexScanner(s, comments).text() if s else ""


def bibliography_items(text: str) -> list[tuple[str, str]]:
    r"""(key, source) of each \bibitem, within the thebibliography environment where there is one."""
    begin = text.find(r"\begin{thebibliography}")
    if begin >= 0:
        text = text[begin:]
    end = text.find(r"\end{thebibliography}")
    parts = (text if end < 0 else text[:end]).split(r"\bibitem")[1:]
    out = []
    for part in parts:
        scanner = LatexScanner(part)
        scanner._group("[", "]")
        key = scanner._group()
        if key is not None:
            out.append((key.strip(), part[scanner.i :]))
    return out
