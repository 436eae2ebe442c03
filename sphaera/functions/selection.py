"""A small language to select atoms, compiled to a boolean Column.

    chain A B and (resname ALA "G*" or resid 1 to 20 -3:4) and not backbone

``not`` binds tighter than ``and``, which binds tighter than ``or``. Patterns have ``*``, ``?``, ``[abc]``
and ``[a-z]`` and tell upper from lower case; keywords do not. Keywords can be used as names in quotes.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The residues and atoms behind the keywords.
PROTEIN = (
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL",
    "HIE", "HID", "HIP", "CYX", "ASH", "GLH", "LYN",
)
NUCLEIC = ("DA", "DT", "DG", "DC", "DU", "A", "U", "G", "C", "RA", "RU", "RG", "RC")
BACKBONE = ("C", "CA", "N", "O")
HYDROPHOBIC = ("ALA", "VAL", "ILE", "LEU", "MET", "PHE", "TRP", "PRO", "GLY")
AROMATIC = ("PHE", "TYR", "TRP", "HIS", "HIE", "HID", "HIP")
ACIDIC = ("ASP", "GLU", "ASH", "GLH")
BASIC = ("ARG", "LYS", "HIS", "HIE", "HID", "HIP", "LYN")
POLAR = ("SER", "THR", "ASN", "GLN", "CYS", "CYX", "TYR")

_ALIASES = {
    "segid": "chain", "resn": "resname", "resi": "resid", "resseq": "resid", "resnum": "resid", "atomname": "name", "nucleicacid": "nucleic",
    "hetero": "hetatm", "everything": "all", "nothing": "none",
}
_FIELDS = {"chain": "chain_id", "resname": "res_name", "name": "name"}


def _classes() -> dict[str, Column]:
    res, name = F.col("res_name"), F.col("name")
    return {
        "protein": res.isin(*PROTEIN), "backbone": res.isin(*PROTEIN) & name.isin(*BACKBONE), "sidechain": res.isin(*PROTEIN) & ~name.isin(*BACKBONE),
        "nucleic": res.isin(*NUCLEIC), "hetatm": F.col("record_name") == "HETATM", "hydrophobic": res.isin(*HYDROPHOBIC), "aromatic": res.isin(*AROMATIC),
        "acidic": res.isin(*ACIDIC), "basic": res.isin(*BASIC), "polar": res.isin(*POLAR), "charged": res.isin(*ACIDIC, *BASIC), "all": F.lit(True), "none": F.lit(False),
    }


_KEYWORDS = {"chain", "resname", "name", "resid", "and", "or", "not", "to"} | {
    "protein", "backbone", "sidechain", "nucleic", "hetatm", "hydrophobic", "aromatic", "acidic", "basic", "polar", "charged", "all", "none",
}
_TOKEN = re.compile(
    r"""\s*(?:(?P<mark>[():])|(?P<quote>["'])(?P<quoted>.*?)(?:(?P=quote)|\Z)|(?P<number>-?[0-9]+)|(?P<word>(?:\[[^\]]*(?:\]|\Z)|[A-Za-z0-9_*?'\]-])+))""", re.S
)


class SelectionError(ValueError):
    """A selection that cannot be read; position counts characters from 0."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.message, self.position = message, position


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        start = at + len(text[at:]) - len(text[at:].lstrip())
        if not m or m["word"] and m["word"][0] in "]-":
            raise SelectionError(f"unexpected character {text[start]!r}", start)
        at = m.end()
        if m["mark"]:
            out.append((m["mark"], m["mark"], start))
        elif m["quote"]:
            out.append(("ident", m["quoted"], start + 1))
        elif m["number"]:
            if not -(2**31) <= int(m["number"]) < 2**31:
                raise SelectionError(f"invalid number {m['number']}", start)
            out.append(("number", m["number"], start))
        else:
            word = m["word"].lower()
            word = _ALIASES.get(word, word)
            out.append((word, m["word"], start) if word in _KEYWORDS else ("ident", m["word"], start))
    return out


def glob_regex(pattern: str) -> str | None:
    """The anchored regular expression of a pattern; None if a bracket is not closed, which matches nothing."""
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[":
            end = pattern.find("]", i + 1)
            if end < 0:
                return None
            inner = re.sub(r"([\\\[\]^&~])", r"\\\1", pattern[i + 1 : end])
            out, i = out + (f"[{inner}]" if inner else "(?!)"), end
        else:
            out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c) or re.escape(c)
        i += 1
    return out + "\\z"


def glob(column: Column, pattern: str) -> Column:
    """Whether a string column matches a pattern; null never does."""
    if not set(pattern) & set("*?["):
        hit = column == pattern
    else:
        regex = glob_regex(pattern)
        hit = column.rlike(regex) if regex else F.lit(False)
    return F.coalesce(hit, F.lit(False))


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at, self.end = _tokens(text), 0, len(text)

    def kind(self) -> str | None:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else None

    def where(self) -> int:
        return self.tokens[self.at][2] if self.at < len(self.tokens) else self.end

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def read(self) -> Column:
        if not self.tokens:
            raise SelectionError("empty selection", 0)
        out = self.any_of()
        if self.kind() is not None:
            raise SelectionError(f"unexpected {self.tokens[self.at][1]!r}", self.where())
        return out

    def any_of(self) -> Column:
        out = self.all_of()
        while self.kind() == "or":
            self.take()
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while self.kind() == "and":
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        kind, where = self.kind(), self.where()
        if kind == "not":
            self.take()
            return ~self.one()
        if kind == "(":
            self.take()
            out = self.any_of()
            if self.kind() != ")":
                raise SelectionError("missing closing parenthesis", self.where())
            self.take()
            return out
        if kind in _FIELDS:
            self.take()
            patterns = []
            while self.kind() == "ident":
                patterns.append(self.take())
            if not patterns:
                raise SelectionError(f"{kind} requires at least one argument", where)
            return reduce(lambda a, b: a | b, (glob(F.col(_FIELDS[kind]), p) for p in patterns))
        if kind == "resid":
            self.take()
            ranges = self.ranges()
            if not ranges:
                raise SelectionError("resid requires at least one argument", where)
            return F.coalesce(reduce(lambda a, b: a | b, (F.col("res_seq").between(a, b) for a, b in ranges)), F.lit(False))
        if kind in (classes := _classes()):
            self.take()
            return F.coalesce(classes[kind], F.lit(False))
        raise SelectionError("expected a selection" if kind is None else f"unexpected {self.tokens[self.at][1]!r}", where)

    def ranges(self) -> list[tuple[int, int]]:
        out = []
        while True:
            if self.kind() == "number":
                low = high = int(self.take())
                if self.kind() in ("to", ":"):
                    mark = self.take()
                    if self.kind() != "number":
                        raise SelectionError(f"expected a number after {mark!r}", self.where())
                    high = int(self.take())
                out.append((low, high))
            elif self.kind() == "ident" and (m := re.fullmatch(r"([+-]?\d+)(?::([+-]?\d+))?", self.tokens[self.at][1])):
                self.take()
                out.append((int(m[1]), int(m[2] or m[1])))
            else:
                return out


def parse_selection(text: str) -> Column:
    """A selection as a boolean Column over chain_id, res_name, res_seq, name and record_name."""
    return _Reader(text).read()


def parse_selections(texts: list[str]) -> list[Column]:
    """At least two selections; an error's position is then the number of the selection."""
    if len(texts) < 2:
        raise SelectionError("at least two selections required", 0)
    out = []
    for i, t in enumerate(texts):
        try:
            out.append(parse_selection(t.strip()))
        except SelectionError as e:
            raise SelectionError(e.message, i) from None
    return out
