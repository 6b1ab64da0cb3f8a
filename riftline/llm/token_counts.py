"""Token counts with a shortcut for pre-tokens that are one token.

Before any text is read, every word-final vocabulary string is merged on its own; those that come out as
exactly one token are *proven*.  A pre-token in the proven table counts 1 by a lookup; only the others are
merged (once per worker) and their counts remembered.

Edge cases: a null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole; repeated rows each give
a row; a null id stays null and leaves the others as they are; an empty table gives an empty result; only the id and text
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .common import named_texts, with_results
from .wordbpe import REMEMBERED, merger

SCHEMA = "n_bytes bigint, n_tokens bigint, over_limit boolean"


def prove_whole_tokens(path: str) -> list[str]:
    """Pre-tokens whose merge is a single token, found by merging each word-final vocabulary string alone."""
    m = merger(path)
    back = {shown: b for b, shown in m.alphabet.items()}
    suffix = m.model.end_of_word_suffix or ""
    proven = []
    for token, token_id in m.tokenizer.get_vocab(with_added_tokens=False).items():
        body = token.removesuffix(suffix)
        if not body or body == token or any(c not in back for c in body):
            continue
        try:
            piece = bytes(back[c] for c in body).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if [t.id for t in m.model.tokenize(body)] == [token_id]:
            proven.append(piece)
    return sorted(proven)


class Counts(dict):
    """Token counts by pre-token; starts from the proven ones, merges and remembers the rest."""

    def __init__(self, path: str, proven: list[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.merger, self.proven, self.room = merger(path), proven, len(proven) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        n = len(self.merger.model.tokenize(self.merger.shown(piece)))
        if len(self) >= self.room:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        self[piece] = n
        return n

    def of(self, text: str) -> int:
        if not self.merger.plain(text):
            return len(self.merger.whole(text))
        return sum(map(self.__getitem__, self.merger.pieces(text)))


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: UTF-8 bytes, tokens without specials, and whether they exceed ``limit``."""
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(vocabulary))
    kept: dict[str, Counts] = {}  # filled in each worker

    def counted(texts: list[str | None]) -> dict[str, Sequence]:
        if not kept:
            kept["counts"] = Counts(vocabulary, proven.value)
        n = [kept["counts"].of(t or "") for t in texts]
        return {"n_bytes": [len((t or "").encode("utf-8")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return with_results(named_texts(docs, id_column, text_column), SCHEMA, counted)
