"""Secret scan: every rule in one deterministic automaton, one pass over the bytes of a text.

The rules' expressions are compiled together by subset construction and minimisation (``automaton``).  One pass over the
bytes, backwards, gives all places where a match of any rule starts; ends follow by running ahead from them, through one
automaton of all rules too.  A rule may set a least length for the whole match or for what follows its separator; matches
that fail it are dropped after they have taken their place, as leftmost non-overlapping matching has it.

Edge cases: a null text scans as empty; texts of any length are scanned whole; offsets are code points, end
exclusive; overlapping spans of different kinds are all reported; repeated rows each give a row; a null id stays
null and leaves the others as they are; an empty table gives an empty result; only id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_portions, named_texts, with_results
from .automaton import Scan, parse


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1
    fold: bool = False
    value: str = ""  #: characters of the part that ends the match and has to be ``least`` long; empty: the whole match

    def holds(self, match: bytes) -> bool:
        if not self.value:
            return len(match) >= self.least
        return len(re.search(f"[:=] *[\"']?([{self.value}]+)$".encode(), match)[1]) >= self.least if match else False


# The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, fold=True, value="A-Za-z0-9+/_.=-"),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
)
#: Rules that this operator adds, by public token formats.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
)
RULES = BASE + ADDED
SCHEMA = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.all = Scan([parse(r.pattern, r.fold) for r in rules])

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start and then by rule."""
        data = text.encode("utf-8", "surrogatepass")
        found = [(s, k, e) for s, k, e in self.all.find(data) if self.rules[k].holds(data[s:e])]
        if found and len(data) != len(text):
            count = lambda b: len(data[:b].decode("utf-8", "surrogatepass"))
            found = [(count(s), k, count(e)) for s, k, e in found]
        return sorted(found)


def _joined(rules: tuple[Rule, ...], found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in found)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document with counts and digest of the base rules' spans, and all spans."""
    compiled = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    base = {k: r.kind for k, r in enumerate(rules) if r in BASE}

    def scanned(texts: list[str | None]) -> dict[str, Sequence]:
        found = [compiled.value.scan(t or "") for t in texts]
        own = [[x for x in f if x[1] in base] for f in found]
        counts = {f"n_{kind}": [sum(base[x[1]] == kind for x in f) for f in own] for kind in ("assign", "access", "hex")}
        return counts | {"base_sha256": [hashlib.sha256(_joined(rules, f).encode()).hexdigest() for f in own], "spans": [_joined(rules, f) for f in found]}

    return with_results(named_texts(docs, id_column, text_column), SCHEMA, scanned)


def redact(text: str, found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    """The text with every maximal run of overlapping spans replaced by a mark that names the kind."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{rules[k].kind}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_column: str = "text") -> DataFrame:
    """The same rows and columns, with secrets in the text replaced; a null text stays null, other columns pass as they are."""
    compiled = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = compiled.value
        for b in in_portions(batches, text_column):
            at = b.schema.get_field_index(text_column)
            texts = [None if t is None else redact(t, s.scan(t), rules) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
