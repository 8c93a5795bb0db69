"""Operator 8: MinHash near-duplicates by a signature-coordinate inverted join.

A document's set is its distinct shingles of five lower-cased words. Documents of equal sets
form a class. Each class is posted under every (coordinate, value) of its signature. Two
sets at the threshold share MIN_MATCHES of COORDINATES coordinates all but surely, so each
class keeps only the prefix of its COORDINATES - MIN_MATCHES + 1 rarest postings: pairs with
enough matches meet in it, and very common postings are skipped. Postings whose members are
known to be connected are skipped too. Of a posting with very many members only those meet
that share a second posting as well, which any such pair does within a prefix longer by one;
so one value that many unlike documents share pairs none of them. Pairs that meet go on if
they collide in MIN_MATCHES coordinates. A second pass over the classes that have postings left counts, behind a
count-min sketch, the shingles of each that no other of them has: those bound its similarity
to anything from above. A parity bitmap of each set bounds the symmetric difference of two
from below. What the bounds admit is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm import sketch
from fieldglass.llm.common import join_hot, mix, multipliers, short_batches, stage, unstage, windows, word_hashes
from fieldglass.llm.components import joined_labels

SHINGLE_WORDS, MIN_PERCENT = 5, 75
#: With 24 coordinates a pair of similarity 0.75 has fewer than 7 matches with probability 3.9e-7, once in about 2.6 million; such a pair is never tried.
COORDINATES, MIN_MATCHES = 24, 7
#: Rounds against one member of each posting before all pairs across components are tried,
#: earlier if there are no more such pairs than this many per class, or if a round found a link for one class in so many only.
STAR_ROUNDS, PAIRS_PER_CLASS, CLASSES_PER_LINK = 6, 2, 100
#: Members of a posting beyond which its pairs must share one more posting to meet, up to so many postings.
MAX_MEMBERS, MAX_SHARED = 1 << 15, 2
#: Pairs whose bitmaps are compared at once.
PAIRS_PIECE = 1 << 16
#: Shingles that are signed at once.
SIGN_PIECE = 1 << 12
#: Shingles to expect of a byte of text.
SHINGLES_PER_BYTE = 1 / 6
#: 64-bit words of a parity bitmap.
PARITY_WORDS = 16


def shingles(text: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, an empty one none."""
    words = word_hashes((text or b"").lower())
    n = min(width, len(words))
    return np.unique(windows(words, n, n)) if n else np.empty(0, np.uint64)


def signature(found: np.ndarray) -> list[int]:
    """The least hash of the set in each coordinate, 63 bits of it."""
    factors, shifts = multipliers(COORDINATES, 8)[:, None], multipliers(COORDINATES, 9)[:, None]
    least = [mix(found[i : i + SIGN_PIECE] * factors + shifts).min(axis=1) for i in range(0, len(found), SIGN_PIECE)]
    return (np.min(least, axis=0) >> np.uint64(1)).tolist()


def signatures(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (digest of the set, null if empty) and signature for each row."""
    short_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signs = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingles(text, width)
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                signs.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "signature"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, node binary, signature array<long>")


def postings(classes: DataFrame) -> DataFrame:
    """token, node, k, level: for each class its rarest postings, without those that no other class has.

    k: their order, from the rarest. level: pairs of enough matches share one posting of level
    1, two of levels 1 and 2, and so on; of those that they share, the i-th rarest is of level
    i at most for both.
    """
    tokens = classes.select("node", F.posexplode("signature").alias("i", "v")).select("node", F.xxhash64("i", "v").alias("token"))
    often = stage(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    shared = join_hot(tokens, often, ["token"], "n")
    order = Window.partitionBy("node").orderBy("n", "token")
    ranked = shared.withColumn("k", F.row_number().over(order)).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("node")))
    level = F.greatest(F.col("k") - F.col("of") + MIN_MATCHES, F.lit(1))
    return ranked.where(level <= MAX_SHARED).select("token", "node", "k", level.alias("level"))


def shared_shingles(texts: DataFrame, width: int) -> tuple[DataFrame, Broadcast]:
    """node, n, common, parity, and the bits to free once these are read: the size of the set and how many of its shingles other nodes may have.

    The sketch counts from above, so a shingle it has seen once is alone for certain, and
    common is never too small. Each shingle flips one bit of the parity bitmap, so two sets
    differ in at least as many shingles as their bitmaps do in bits.
    """

    counters = sketch.width_for(int((texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * SHINGLES_PER_BYTE))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch.partial((shingles(t, width) for b in batches for t in b.column(0).to_pylist()), counters)

    # A full sketch only bounds less; the parity bitmaps still do.
    bits = texts.sparkSession.sparkContext.broadcast(sketch.repeated_bits(texts.select("text").mapInArrow(partial, sketch.SCHEMA), counters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            found = [shingles(t, width) for t in batch.column(1).to_pylist()]
            common = [int(sketch.maybe_repeated(f, maybe, counters).sum()) for f in found]
            flips = (np.bincount((mix(f) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1 for f in found)
            parity = pa.array([np.packbits(x).view(np.int64).tolist() for x in flips], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(common, pa.int64()), parity], names=["node", "n", "common", "parity"]
            )

    return texts.select("node", "text").mapInArrow(run, "node binary, n long, common long, parity array<long>"), bits


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if y != last[0]:
                    last = y, shingles(y, width)
                one, two = shingles(x, width), last[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def classified(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = MIN_PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_shingles, component (a digest; null without words), component_id."""
    found = stage(signatures(docs, width), "signatures")
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = found.where("node is not null").groupBy("node").agg(
        first.alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"), F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("times")
    )
    classes = stage(classes, "classes")
    posted = stage(postings(classes.select("node", "signature")), "postings")
    involved = posted.where("level = 1").select("node").distinct().join(classes.select("node", "rep"), "node")
    involved = involved.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"))
    whole = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    texts = whole.join(involved, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
    texts = stage(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    shared, bits = shared_shingles(texts, width)
    sizes = stage(shared.where(100 * F.col("common") >= percent * F.col("n")).join(classes.select("node", "signature"), "node"), "sizes")
    bits.destroy()
    labels = connect(posted, sizes, texts, width, percent)

    least = labels.join(classes.select("node", "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = classes.select("node", "least_id", "times").join(labels, "node", "left").join(least, "component", "left")
    alone = F.col("component").isNull()
    of_class = of_class.select("node", "times", F.coalesce("component", "node").alias("component"), F.when(alone, F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"))
    of_class = stage(of_class, "components")
    base = ["doc_id", "text_hash", "n_shingles"]
    linked = join_hot(found.where("node is not null").select(*base, "node"), of_class, ["node"], "times").select(*base, "component", "component_id")
    return linked.unionByName(found.where("node is null").select(*base, F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = MIN_PERCENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of similarity percent/100 or
    more. Null and empty texts, and texts without words, are linked with nothing. Rows that
    repeat a doc_id are documents of their own; a row without an id takes part, but a component
    of such rows alone has none and keeps nothing. A text of any length is read whole, in one
    task. Columns of other names are ignored.
    """
    out = classified(docs, width, percent)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


MEMBER = ("token", "node", "n", "common", "signature", "parity")


def may_link(other: str, percent: int) -> Column:
    """Whether two classes collide often enough and no bound rules the similarity out."""
    both, sizes_of_both = F.least("common", f"{other}common"), F.col("n") + F.col(f"{other}n")
    collisions = sum((F.col("signature")[i] == F.col(f"{other}signature")[i]).cast("int") for i in range(COORDINATES))
    differ = sum(F.bit_count(F.col("parity")[i].bitwiseXOR(F.col(f"{other}parity")[i])) for i in range(PARITY_WORDS))
    # similarity = (sizes - difference) / (sizes + difference)
    return (100 * both >= percent * (sizes_of_both - both)) & (collisions >= MIN_MATCHES) & ((100 + percent) * differ <= (100 - percent) * sizes_of_both)


def linkable(n: np.ndarray, common: np.ndarray, signature: np.ndarray, parity: np.ndarray, component: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """may_link between all members of a group at once: the places (i < j) of the pairs of different components that pass."""
    size, rows = len(n), max(1, PAIRS_PIECE // len(n))
    parity = parity.view(np.uint64)  # of negative numbers, the bits of the absolute value would be counted
    found = []
    for at in range(0, size, rows):
        head = slice(at, at + rows)
        differ = np.bitwise_count(parity[head, None] ^ parity[None, at:]).sum(axis=2, dtype=np.int64)
        sizes_of_both = n[head, None] + n[None, at:]
        i, j = np.nonzero(((100 + percent) * differ <= (100 - percent) * sizes_of_both) & (component[head, None] != component[None, at:]))
        i, j = i[i < j] + at, j[i < j] + at
        both = np.minimum(common[i], common[j])
        i, j = (x[100 * both >= percent * (n[i] + n[j] - both)] for x in (i, j))
        enough = (signature[i] == signature[j]).sum(axis=1) >= MIN_MATCHES
        found.append((i[enough], j[enough]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def across(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """a, b: the pairs of members of different components that share the keys and may be linked; members: keys, MEMBER, component."""

    def pairs(batch: pa.Table, starts: list[int]) -> pa.RecordBatch:
        batch = batch.combine_chunks()
        node = batch.column("node").to_pylist()
        n, common = (batch.column(c).to_numpy() for c in ("n", "common"))
        signature, parity = (np.stack(batch.column(c).to_numpy()) for c in ("signature", "parity"))
        component = batch.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        a, b = [], []
        for lo, hi in zip(starts, [*starts[1:], len(node)], strict=True):
            if hi - lo > 1:
                own = slice(lo, hi)
                for i, j in zip(*(x.tolist() for x in linkable(n[own], common[own], signature[own], parity[own], component[own], percent)), strict=True):
                    x, y = sorted((node[lo + i], node[lo + j]))
                    a.append(x)
                    b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The group that may go on in the next batch waits for it.
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            starts = (np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()
            if last is None or (key[0] != last).any():
                starts = [0, *starts]
            last = key[-1]
            if not starts:
                waiting.append(batch)
                continue
            if starts[0]:
                waiting.append(batch.slice(0, starts[0]))
            if waiting:
                yield pairs(pa.Table.from_batches(waiting), [0])
            if len(starts) > 1:
                yield pairs(pa.Table.from_batches([batch.slice(starts[0], starts[-1] - starts[0])]), [x - starts[0] for x in starts[:-1]])
            waiting = [batch.slice(starts[-1])]
        if waiting:
            yield pairs(pa.Table.from_batches(waiting), [0])

    dealt = members.select(*keys, *MEMBER[1:], "component").repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a binary, b binary")


def met(members: DataFrame, posted: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of members (token, k, node, component) of different components that may be linked.

    A pair of enough matches meets under the rarest posting that it shares. If that one has
    too many members, it meets under the two rarest, and so on; under the last, all of them meet.
    """
    keys, found = ["token"], []
    for level in range(1, MAX_SHARED + 1):
        group = members.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
        group = stage(group.where("low <> high").drop("low", "high"), "groups")
        members = stage(join_hot(members, group, keys, "members"), "grouped")
        crowded = F.col("members") > MAX_MEMBERS if level < MAX_SHARED else F.lit(False)
        found.append(across(members.where(~crowded).join(sizes, "node"), keys, percent))
        crowd = members.where(crowded)
        if level == MAX_SHARED or crowd.isEmpty():
            break
        more = posted.where(F.col("level") <= level + 1).select("node", F.col("token").alias(f"token_{level}"), F.col("k").alias("next"))
        members = crowd.drop("members").join(more, "node").where("next > k").drop("k").withColumnRenamed("next", "k")
        keys = [*keys, f"token_{level}"]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.distinct()


def starred(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, b, count: the members (node, component) that may be linked with a centre (c: node, component) of another component, and how many postings they share with it.

    Each pair gets its signatures and bitmaps once, however many postings it meets in.
    """
    pairs = members.where(F.col("component") != F.col("c.component")).groupBy(F.col("node").alias("a"), F.col("c.node").alias("b")).count()
    rest = sizes.columns[1:]
    pairs = pairs.join(sizes.withColumnRenamed("node", "a"), "a").join(sizes.select(F.col("node").alias("b"), F.struct(*rest).alias("c")), "b")
    return pairs.where(may_link("c.", percent)).select("a", "b", "count")


def connect(posted: DataFrame, sizes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node, component for all nodes with a link.

    Star rounds pair each member of a posting with one member of another component. When few
    pairs across components are left, or a round found few links, or after STAR_ROUNDS, all
    of them are tried: no pair that shares enough postings stays untried unless it is
    connected already. A posting whose
    members are all connected takes no part in later rounds. The rows of a round hold no
    signatures.
    """
    spark = posted.sparkSession
    labels = spark.createDataFrame([], "node binary, component binary")
    tested = spark.createDataFrame([], "a binary, b binary")
    total = sizes.count()
    own = sizes.select("node", (F.col("n") - F.col("common")).alias("own"))
    members = stage(posted.where("level = 1").join(own, "node").select("token", "node", "k", "own"), "members")
    few = False
    for turn in range(STAR_ROUNDS + 1):
        now = stage(members.select("token", "node", "k", "own").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "now")
        unstage(members)
        sizes_in = now.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"))
        sizes_in = sizes_in.groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        pairs_left = sizes_in.agg(F.sum((F.col("c").cast("double") * F.col("c") - F.col("cc")) / 2)).first()[0]
        if not pairs_left:
            return labels
        last = few or (turn > 0 and pairs_left <= PAIRS_PER_CLASS * total) or turn == STAR_ROUNDS
        if last:
            pairs = met(now.select("token", "k", "node", "component"), posted, sizes, percent)
        else:
            by_token = now.groupBy("token").agg(
                # A member with few shingles of its own is like most others.
                F.min_by(F.struct("node", "component"), F.xxhash64("node", F.lit(turn)) if turn > 1 else F.struct("own", "node")).alias("c"),
                F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"),
            ).where("low <> high").drop("low", "high")
            by_token = stage(by_token, "centres")
            members = stage(join_hot(now, by_token, ["token"], "members"), "members")
            unstage(now, by_token)
            pairs = starred(members, sizes, percent)
            if not turn:  # the centre it collides with most often
                pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stage(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        new = stage(confirmed(pairs, texts, width, percent), "links")
        links = new.count()
        if links:
            labels = joined_labels(labels, new)
        if last:
            return labels
        few = CLASSES_PER_LINK * links <= total
        tested = tested.unionByName(pairs)
    raise AssertionError("unreachable")
