"""Token counts by a linear longest-match automaton.

The trie of a vocabulary's pieces gets failure links and, for each node, the number of tokens popped when its link is taken:
the tokens that greedy longest match is sure to have put out by then. A word then costs one pass over its characters, and no piece is built. Pieces
that begin a word start with the mark U+2581, the others continue one. A character that no piece is costs its UTF-8 bytes, as
byte fallback does.

Null texts count as empty: no words, no tokens. Words are maximal runs of anything but ASCII white space, of any length; a very long text or word costs time in
proportion. Null ids are passed on, repeated rows are counted each, an empty table gives no rows. Columns other than those named are not read, so their
names can't clash.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "\u2581"
WORD = re.compile(r"[^ \t-\r]+")
MEMO = 300_000


class Automaton:
    def __init__(self, pieces: list[str]):
        cost = {c: len(c.encode("utf-8", "surrogatepass")) for p in pieces for c in p} | dict.fromkeys(pieces, 1)
        self.next: list[dict[str, int]] = [{}]
        ends, depth = {}, [0]
        for piece in cost:
            at = 0
            for c in piece:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    depth.append(depth[at] + 1)
                at = self.next[at][c]
            ends[at] = cost[piece]
        self.link, self.popped = [0] * len(self.next), [0] * len(self.next)
        queue = [0]
        for node in queue:  # by depth, so links of shorter strings are known
            for c, child in self.next[node].items():
                queue.append(child)
                if child in ends:
                    self.link[child], self.popped[child] = 0, ends[child]
                    continue
                to, popped = self.link[node], self.popped[node]
                while c not in self.next[to]:  # ends at the root at the latest: each character is a string of the trie
                    popped += self.popped[to]
                    to = self.link[to]
                self.link[child], self.popped[child] = self.next[to][c], popped

    def count(self, text: str) -> int:
        """Tokens of greedy longest match over the text."""
        follow, link, popped, at, total = self.next, self.link, self.popped, 0, 0
        for c in text:
            while c not in follow[at]:
                if not at:
                    total += len(c.encode("utf-8", "surrogatepass"))
                    break
                total += popped[at]
                at = link[at]
            else:
                at = follow[at][c]
        while at:
            total += popped[at]
            at = link[at]
        return total


class WordCosts(dict):
    """Tokens of words seen before, emptied when full."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = self.automaton.count(MARK + word)
        return out


def pieces_of(path: str) -> list[str]:
    """The pieces without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


@lru_cache(1)
def word_costs(path: str) -> WordCosts:
    return WordCosts(Automaton(pieces_of(path)))


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens, and the columns in extra (Column expressions with names)."""
    path = path or tokenizer_path(VOCABULARY)
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("doc_id"), *extra)

    def run(batches):
        costs = word_costs(path)
        for batch in batches:
            words = [WORD.findall(t or "") for t in batch.column(0).to_pylist()]
            n = [sum(map(costs.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([len(w) for w in words], pa.int64()), pa.array(n, pa.int64())], names=[*batch.schema.names[1:], "n_words", "n_tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{kinds}, n_words long, n_tokens long")
