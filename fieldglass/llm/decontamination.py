"""Operator 9: benchmark decontamination by greedy string tiling.

Runs of five shared tokens are the seeds that join documents and benchmark items. For each
joined pair the longest common runs are marked, longest first, as tiles that do not
overlap; they are found by running Karp-Rabin hashes with a shrinking search length. A
document is contaminated if its tiles cover enough of an item, in whatever order.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldglass.llm.common import WordHashes, short_batches, stage, windows

SEED_TOKENS, MIN_COVERAGE = 5, 0.5
#: Items of fewer tokens are matched as a whole only: half of them is too little to tell a leak from chance.
WHOLE_ITEM_TOKENS = 8
#: A benchmark of at most so many bytes of text is broadcast; a larger one is joined. Results are the same.
MAX_BROADCAST_BYTES = 8 << 20
# Blocks of scripts that are written without spaces; each of their characters is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
TOKEN = re.compile(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def tokens(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits, and of single characters of unspaced scripts."""
    return hashes.of([w.encode() for w in TOKEN.findall((text or "").lower())])


def seeds(found: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SEED_TOKENS tokens; of a shorter text the whole is its one seed."""
    n = min(SEED_TOKENS, len(found))
    return windows(found, n, 9 + SEED_TOKENS - n) if n else np.empty(0, np.uint64)


def karp_rabin(x: list[int], n: int, marked: list[bool]) -> Iterator[tuple[int, int]]:
    """Position and running hash of each run of n unmarked tokens."""
    top = pow(BASE, n - 1, MODULUS)
    h = since = 0
    for i, v in enumerate(x):
        if marked[i]:
            h = since = 0
            continue
        if since == n:
            h = (h - x[i - n] * top) % MODULUS
            since -= 1
        h = (h * BASE + v) % MODULUS
        since += 1
        if since == n:
            yield i - n + 1, h


def free_runs(p: int, t: int, k: int, in_item: list[bool], in_text: list[bool]) -> Iterator[tuple[int, int, int]]:
    """The unmarked parts of a match."""
    start = None
    for j in range(k + 1):
        if j < k and not in_item[p + j] and not in_text[t + j]:
            start = j if start is None else start
        elif start is not None:
            yield p + start, t + start, j - start
            start = None


def tile(item: list[int], text: list[int], least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length) of greedy string tiling.

    Always the longest match left is marked, of equal ones the first in the item, then in the
    text. A pass finds all matches of the search length and more; what a longer tile leaves of
    a match goes back among them.
    """
    in_item, in_text = [False] * len(item), [False] * len(text)
    tiles: list[tuple[int, int, int]] = []
    n = max(least, len(item))
    while True:
        at = defaultdict(list)
        for i, h in karp_rabin(text, n, in_text):
            at[h].append(i)
        found = []
        for p, h in karp_rabin(item, n, in_item):
            for t in at.get(h, ()):
                if p and t and item[p - 1] == text[t - 1] and not in_item[p - 1] and not in_text[t - 1]:
                    continue  # inside a match that starts earlier
                k = 0
                while p + k < len(item) and t + k < len(text) and item[p + k] == text[t + k] and not in_item[p + k] and not in_text[t + k]:
                    k += 1
                if k >= n:
                    found.append((-k, p, t))
        heapq.heapify(found)
        while found:
            k, p, t = heapq.heappop(found)
            if any(in_item[p : p - k]) or any(in_text[t : t - k]):
                for q, u, rest in free_runs(p, t, -k, in_item, in_text):
                    if rest >= n:
                        heapq.heappush(found, (-rest, q, u))
            else:
                in_item[p : p - k] = in_text[t : t - k] = [True] * -k
                tiles.append((p, t, -k))
        if n == least:
            return tiles
        n = max(least, n // 2)


def coverage(item: np.ndarray, text: np.ndarray, hits: np.ndarray) -> float:
    """Share of the item's tokens in tiles; hits: the seeds of the text that the item has.

    Every tile consists of seeds, so only the stretches of the text that seeds cover are tiled.
    """
    least = min(SEED_TOKENS, len(item))
    near = np.zeros(len(text) + 1, np.int32)
    np.add.at(near, hits, 1)
    np.add.at(near, hits + least, -1)
    inside = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    gaps = np.flatnonzero(np.diff(inside) > 1) + 1
    stretch = np.insert(text[inside].astype(object), gaps, [-1 - i for i in range(len(gaps))])
    return sum(k for *_, k in tile([int(x) for x in item], [int(x) for x in stretch], least)) / len(item)


class Index:
    """Items by the hashes of their seeds."""

    def __init__(self, items: list[tuple[object, str | None]]):
        hashes = WordHashes()
        each = [(i, tokens(t, hashes)) for i, t in items]
        self.items = [(i, t) for i, t in each if len(t)]
        of = [seeds(t) for _, t in self.items]
        owner = np.repeat(np.arange(len(of)), [len(s) for s in of]) if of else np.empty(0, np.int64)
        flat = np.concatenate(of) if of else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]

    def best(self, text: str | None, hashes: WordHashes) -> tuple[object, float]:
        """The item covered most, the first of equals, and its coverage; an item of few tokens counts if it is covered whole."""
        words = tokens(text, hashes)
        own = seeds(words)
        low = np.searchsorted(self.seeds, own)
        hit = np.flatnonzero(np.searchsorted(self.seeds, own, side="right") > low)
        by_item: dict[int, list[int]] = defaultdict(list)
        for at in hit.tolist():
            k = int(low[at])
            while k < len(self.seeds) and self.seeds[k] == own[at]:
                by_item[int(self.owner[k])].append(at)
                k += 1
        best: tuple[object, float] = (None, 0.0)
        for k in sorted(by_item):
            share = coverage(self.items[k][1], words, np.unique(by_item[k]))
            if share > best[1] and (share == 1.0 or len(self.items[k][1]) >= WHOLE_ITEM_TOKENS):
                best = self.items[k][0], share
        return best


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """`row` (a struct of the columns `keep`), best_item, coverage and contaminated."""
    short_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.octet_length("text") + F.lit(32))).first()[0] or 0
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text_"))
    found = by_broadcast(rows, items) if size <= max_broadcast_bytes else by_join(docs, rows, items)
    return found.withColumn("contaminated", F.col("coverage") >= MIN_COVERAGE)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """keep (doc_id by default), best_item, coverage and contaminated for each row of `docs` (doc_id, text).

    benchmark: item_id, text; items without a token are not tested. An item of fewer than
    WHOLE_ITEM_TOKENS tokens counts only if it is there as a whole, in one run; one of fewer than
    SEED_TOKENS only if it is the whole text. best_item is the item covered most, of equals the
    smallest id (null first), and null where no item counts. Null and empty texts are clean, and
    so is everything when the benchmark is empty. Rows are judged one by one, whatever repeats;
    a text of any length is read whole, in one task. `contaminated` carries columns of any name.
    A benchmark beyond the broadcast bound is joined by its seeds.
    """
    return contaminated(docs, benchmark, keep or ["doc_id"], max_broadcast_bytes).select("row.*", "best_item", "coverage", "contaminated")


def by_broadcast(rows: DataFrame, items: DataFrame) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.orderBy("item_id", "text").collect()])
    kind = items.schema["item_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = Index(shared.value), WordHashes()
        for batch in batches:
            found = [index.best(t, hashes) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], arrow), pa.array([f[1] for f in found], pa.float64())], names=["row", "best_item", "coverage"]
            )

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, best_item {kind.simpleString()}, coverage double")


def seed_rows(df: DataFrame, key: Column) -> DataFrame:
    """key and seed for each distinct seed of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [np.unique(seeds(tokens(t, hashes))).view(np.int64) for t in batch.column(1).to_pylist()]
            take = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.concatenate(found) if found else [], pa.int64())], names=["key", "seed"])

    return df.select(key.alias("key"), "text").mapInArrow(run, "key string, seed long")


def by_join(docs: DataFrame, rows: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct texts and items that share a seed, tiled pair by pair; the best item comes back by a digest of the text."""
    texts = docs.select(F.sha2("text", 256).alias("digest"), "text").where("text is not null").dropDuplicates(["digest"])
    items = items.where("text is not null").select("item_id", "text", F.sha2("text", 256).alias("item_digest"))
    several = items.dropDuplicates(["item_digest"])
    pairs = seed_rows(texts, F.col("digest")).withColumnRenamed("key", "digest").join(seed_rows(several, F.col("item_digest")).withColumnRenamed("key", "item_digest"), "seed")
    pairs = pairs.select("digest", "item_digest").distinct()
    pairs = pairs.join(several.select("item_digest", F.col("text").alias("item")), "item_digest").join(texts, "digest").select("digest", "item_digest", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            share = [Index([(0, i)]).best(t, hashes)[1] for i, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(share, pa.float64())], names=["digest", "item_digest", "coverage"])

    scored = pairs.mapInArrow(run, "digest string, item_digest string, coverage double").where("coverage > 0")
    # Items of one text cover alike; the smallest id, null first, stands for them.
    first = items.groupBy("item_digest").agg(F.min(F.struct(F.col("item_id").isNotNull().alias("known"), "item_id")).alias("i"))
    scored = scored.join(first, "item_digest")
    order = F.struct(-F.col("coverage"), F.col("i"))
    best = scored.groupBy("digest").agg(F.max("coverage").alias("best_share"), F.min_by("i", order)["item_id"].alias("best_item"))
    best = stage(best, "tiled")
    out = rows.withColumn("digest", F.sha2("text_", 256)).join(best, "digest", "left")
    return out.select("row", "best_item", F.coalesce("best_share", F.lit(0.0)).alias("coverage"))
