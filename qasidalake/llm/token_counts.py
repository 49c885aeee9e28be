"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces are counted, not built.  The vocabulary's pieces
form a trie with two roots, one for pieces that begin a word and one for those
that continue it.  Each node has a failure link, to the node that stands for what
is left once the longest pieces before it are taken off, and the number of pieces
so taken.  A word is read once, byte by byte: where no edge goes on, the node's
count is added and its link followed.  Time is linear in the word's length.

A word that no pieces cover counts as one token, the unknown one.  Words are runs
of bytes other than space and 0x09 to 0x0D.  Null and empty texts have no words.
Rows are handled one by one; repeated rows and ids are all kept, texts of any length
are read whole.  Pieces do not tie: of one place the longest is taken.  An empty table
gives an empty one; an id column named like a new column gets a longer name, other
columns are not kept.
"""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, parts_of
from .pieces import Remembered


class LongestMatch:
    """The automaton over ``starts`` (pieces that begin a word) and ``rests`` (that continue it)."""

    def __init__(self, starts, rests):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
        ends = set()
        for root, pieces in ((0, starts), (1, rests)):
            for piece in pieces:
                node = root
                for byte in piece:
                    step = self.edges[node].get(byte)
                    if step is None:
                        step = self.edges[node][byte] = len(self.edges)
                        self.edges.append({})
                    node = step
                if node > 1:
                    ends.add(node)
        self.link, self.popped = [-1] * len(self.edges), [0] * len(self.edges)
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for byte, node in self.edges[parent].items():
                    below.append(node)
                    if node in ends:
                        self.link[node], self.popped[node] = 1, 1
                        continue
                    at, count = self.link[parent], self.popped[parent]
                    while at >= 0 and byte not in self.edges[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at >= 0:
                        self.link[node], self.popped[node] = self.edges[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        edges, link, popped = self.edges, self.link, self.popped
        node = total = 0
        for byte in word:
            while (step := edges[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = step
        while node != 1:
            if link[node] < 0:
                return 1 if word else 0
            total += popped[node]
            node = link[node]
        return total


@functools.cache
def _counter(path: str) -> Remembered:
    """Counts of words under a rank file: pieces led by a space begin a word, the others continue it."""
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines]
    automaton = LongestMatch([t for t in tokens if t[:1] == b" "], [t for t in tokens if t[:1] != b" "])
    return Remembered(lambda word: automaton.count(b" " + word))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens) of each text."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        counter = _counter(path)
        for batch in parts_of(batches, 1):
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                parts = text.split() if text else []  # bytes: splits at 0x20 and 0x09 to 0x0D
                words.append(len(parts))
                tokens.append(sum(counter.all(parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_words", "n_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", free_name(["n_words", "n_tokens"], id_col))
