"""Operator 1: token counts by a linear longest-match automaton.

The vocabulary becomes a trie. Each node has a failure link and the number of
pieces that greedy longest-match-first tokenization pops when the link is
followed, so one pass over a word's bytes gives the number of its pieces and no
piece is built. Words are split on space and \\x09-\\x0D; a word's first piece comes
from the initial vocabulary, later ones from the continuation vocabulary.
"""

from __future__ import annotations

import base64
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import MEMO_WORDS, short_batches

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A vocabulary is broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20
START, REST, NONE = 0, 1, -1


@dataclass
class Vocabulary:
    """initial: pieces that start a word, without their marker; bare_marker: the marker alone is a piece."""

    initial: set[bytes]
    rest: set[bytes]
    bare_marker: bool = False


def read_ranks(path: str, marker: bytes = b" ") -> Vocabulary:
    """A file of base64 pieces and ranks; pieces that start with `marker` start words."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    pieces = {base64.b64decode(line.split()[0]) for line in data.splitlines() if line.strip()}
    started = {p[len(marker) :] for p in pieces if p.startswith(marker)}
    return Vocabulary(started - {b""}, {p for p in pieces if not p.startswith(marker)}, b"" in started)


def word_pieces(pieces: Iterable[str], prefix: str = "##") -> Vocabulary:
    """A word-piece list, whose continuation pieces carry a prefix."""
    rest = {p[len(prefix) :].encode() for p in pieces if p.startswith(prefix)} - {b""}
    return Vocabulary({p.encode() for p in pieces if p and not p.startswith(prefix)}, rest)


class Automaton:
    """edges: state * 256 + byte -> state; fail: link or NONE; pops: pieces popped on following it."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, fail: np.ndarray, pops: np.ndarray):
        self.arrays = keys, targets, fail, pops
        self.edges = dict(zip(keys.tolist(), targets.tolist(), strict=True))
        self.fail, self.pops = fail.tolist(), pops.tolist()

    @classmethod
    def build(cls, v: Vocabulary) -> Automaton:
        edges: dict[int, int] = {}
        children: list[list[tuple[int, int]]] = [[], []]
        whole = [False, False]
        for root, pieces in ((START, v.initial), (REST, v.rest)):
            for piece in pieces:
                u = root
                for b in piece:
                    nxt = edges.get(u << 8 | b)
                    if nxt is None:
                        nxt = edges[u << 8 | b] = len(whole)
                        children[u].append((b, nxt))
                        children.append([])
                        whole.append(False)
                    u = nxt
                whole[u] = True
        fail, pops = [NONE] * len(whole), [0] * len(whole)
        if v.bare_marker:
            fail[START], pops[START] = REST, 1
        queue = deque([REST, START])
        while queue:
            u = queue.popleft()
            for b, child in children[u]:
                queue.append(child)
                if whole[child]:
                    fail[child], pops[child] = REST, 1
                    continue
                z, n = fail[u], pops[u]
                while z != NONE and (z << 8 | b) not in edges:
                    n += pops[z]
                    z = fail[z]
                if z != NONE:
                    fail[child], pops[child] = edges[z << 8 | b], n
        return cls(
            np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges)),
            np.array(fail, np.int32), np.array(pops, np.int32),
        )

    def count(self, word: bytes) -> int:
        """Number of pieces of a word, or NONE if the vocabulary cannot spell it."""
        edges, fail, pops = self.edges, self.fail, self.pops
        u, n = START, 0
        for b in word:
            nxt = edges.get(u << 8 | b)
            while nxt is None:
                if fail[u] == NONE:
                    return NONE
                n += pops[u]
                u = fail[u]
                nxt = edges.get(u << 8 | b)
            u = nxt
        while u != REST:
            if fail[u] == NONE:
                return NONE
            n += pops[u]
            u = fail[u]
        return n


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_bytes, n_tokens, n_unknown (long).

    A word the vocabulary cannot spell is one token and counts in n_unknown. A null
    or empty text has zeros; a text of any length is read whole; repeated ids and rows are counted
    row by row, so ties do not arise; other columns are ignored. There is no shuffle. The automaton goes to the executors as
    a broadcast whose size the vocabulary's size bounds.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton.build(vocabulary).arrays)
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*shared.value)
        memo: dict[bytes, int] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = (text or b"").split()
                n_tokens = unknown = 0
                for word, times in Counter(words).items():
                    n = memo.get(word)
                    if n is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        n = memo[word] = automaton.count(word)
                    if n == NONE:
                        unknown += times
                        n = 1
                    n_tokens += n * times
                rows.append((len(words), len(text or b""), n_tokens, unknown))
            columns = np.array(rows, np.int64).reshape(len(rows), 4).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns)], names=[id_col, "n_words", "n_bytes", "n_tokens", "n_unknown"]
            )

    schema = f"`{id_col}` {id_type.simpleString()}, n_words long, n_bytes long, n_tokens long, n_unknown long"
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(run, schema)
