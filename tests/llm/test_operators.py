"""The training-data operators against brute force on small tables with awkward rows."""

import base64
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fieldglass.llm import decontamination, language_id, line_dedup, minhash_dedup, mixing, quality_rules, substring_dedup, suffix_dedup, token_counts, warc
from fieldglass.llm.common import multipliers
from fieldglass.llm.suffix_array import repeated_starts, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = "\n".join(sentence(12) for _ in range(20))
SHARED = sentence(90)
ROWS = [
    (1, BASE, "en", "a", 1, "x"), (2, BASE, "en", "a", 1, "x"), (3, BASE.replace("w1 ", "q "), "de", None, 1, "x"), (4, None, None, "b", None, None), (5, "", "en", "b", 0, None),
    (6, " \n\t", "en", "c", 3, None), (7, "one two", "en", "a", 7, None), (8, sentence(30) + " " + SHARED, "en", "b", 1, None), (9, SHARED + "\n" + sentence(25), "fr", "c", 1, None),
    (None, sentence(60), None, None, None, None), (10, "a" * 3000, "en", "a", 1, None), (11, sentence(6000), "en", "a", 1, None), (12, sentence(10), "en", "a", 1, None), (12, sentence(10), "en", "a", 1, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_token_counts(docs, none):
    v = token_counts.read_ranks(token_counts.DEFAULT_VOCABULARY)
    pieces = v.rest

    def greedy(w):
        n = i = 0
        while i < len(w):
            table = v.initial if i == 0 else pieces
            k = next((k for k in range(len(w) - i, 0, -1) if w[i : i + k] in table), 0)
            if not k:  # the bare marker, then continuations
                n += 1
                k = next(k for k in range(len(w) - i, 0, -1) if w[i : i + k] in pieces)
            n, i = n + 1, i + k
        return n

    got = Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.count_tokens(docs, v).collect())
    assert got == Counter((r[0], len(words(r[1])), sum(map(greedy, words(r[1]))), 0) for r in ROWS)
    assert token_counts.count_tokens(none, v).count() == 0


def test_word_pieces_and_unknown():
    a = token_counts.Automaton.build(token_counts.word_pieces(["un", "a", "##aff", "##able", "##a", "##b"]))
    assert [a.count(w) for w in (b"unaffable", b"un", b"aab", b"zzz", b"unz", b"unaffabl")] == [3, 1, 3, -1, -1, -1]


def pairs_gone(rows):
    """By plain Python: for each (id, text) in order, the numbers of the lines that repeat an earlier pair of lines with words."""
    seen, out = set(), []
    for _, t in rows:
        lines, gone = (t or "").split("\n"), set()
        at = [k for k, x in enumerate(lines) if x.encode().split()]
        for a, b in zip(at, at[1:]):
            pair = tuple(lines[a : b + 1])
            gone |= set(range(a, b + 1)) if pair in seen else set()
            seen.add(pair)
        out.append(gone)
    return out


@pytest.mark.parametrize("capacity", [10**9, 40])
def test_line_dedup(docs, none, capacity):
    rows = sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    for (i, t), gone in zip(rows, pairs_gone(rows)):
        lines = (t or "").split("\n")
        want[i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines) if t is not None else 0, len(gone)] += 1
    got = line_dedup.remove_repeated_chunks(docs, capacity=capacity).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed_lines) for r in got) == want
    copy = next(r for r in got if r.doc_id == 2)
    assert copy.n_removed_lines == 20 and copy.n_removed_chunks == copy.n_chunks > 1
    assert line_dedup.remove_repeated_chunks(none).count() == 0


def test_line_dedup_finds_passages_inside_other_texts(spark):
    passages = [[sentence(8) for _ in range(n)] for n in (2, 3, 3, 5, 9)]
    passages[2].insert(1, " ")
    texts = ["\n".join([sentence(6) for _ in range(k % 3)] + passages[k % 5] + [sentence(7) for _ in range(k % 4)]) for k in range(40)]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        worded = [k for k, x in enumerate(lines) if x.strip()]
        for a, b in zip(worded, worded[1:]):
            pair = tuple(lines[a : b + 1])
            gone |= set(range(a, b + 1)) if pair in seen else set()
            seen.add(pair)
        want[i] = (len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
        assert i < 5 or gone == set(range(i % 3, i % 3 + len(passages[i % 5])))
    got = line_dedup.remove_repeated_chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_removed_lines, r.text) for r in got} == want


def test_chunks_resist_shifts_and_hold_every_pair_once():
    lines = [sentence(5).encode() for _ in range(200)]
    a, b = ({tuple(x[s : e + 1]) for s, e in line_dedup.chunks(x, list(range(len(x))))} for x in (lines, [b"new", *lines]))
    assert len(a & b) >= len(a) - 2 and len(a) > 20
    for n in (0, 1, 2, 3, 50):
        at = sorted(RNG.sample(range(200), n))
        cuts = line_dedup.chunks(lines, at)
        assert [j for s, e in cuts for j in range(s, e)] == list(range(max(0, n - 1)))
        # Where a chunk ends depends on the three lines up to there alone, which plain integers confirm.
        def roll(three):
            h, m = 3, int(multipliers(1, 3)[0])
            for j, x in enumerate(three):
                h = (h * m if j else h) + xxhash.xxh3_64_intdigest(x)
            return xmix(h % 2**64)
        assert [e for _, e in cuts[:-1]] == [k for k in range(2, n - 1) if roll([lines[i] for i in at[k - 2 : k + 1]]) % 4 == 0]


def xmix(x):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * m % 2**64
    return x ^ x >> 33


def test_quality_rules(docs, none):
    def counts(text):
        t = text or ""
        w = [x.decode() for x in words(t)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed

    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect())
    assert got == Counter((r[0], *counts(r[1])) for r in ROWS)
    assert not any(r.kept and r.base_failed for r in quality_rules.judge(docs).collect()) and quality_rules.judge(none).count() == 0


def test_quality_rules_judge_short_texts_by_words(spark):
    common, rng = quality_rules.COMMON_WORDS[0].split(), random.Random(1)
    rare = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice((2, 3, 4)))) + "x" for _ in range(900)]
    mixed = lambda n: " ".join(common[(2 * (i // 5) + i % 5) % len(common)] if i % 5 < 2 else rng.choice(rare) for i in range(n))
    plain = [(i, mixed(n), "en") for i, n in enumerate((60, 80, 120, 180, 400) * 8)]
    odd = [(100 + n, " ".join(rng.sample(rare, n)), "en") for n in (60, 120, 199, 300)]
    got = quality_rules.judge(spark.createDataFrame(plain + odd, "doc_id long, text string, lang string")).collect()
    assert not any(r.base_failed for r in got)
    assert sorted(r.doc_id for r in got if r.kept) == [i for i, *_ in plain]


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nb", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70000), (None, "u", "x"), (6, "u", "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i or 0, largest.get(h or "", 0))
    want = set()
    for i, _, h in rows:
        data, top = (h or "").encode(), largest[h or ""]
        want.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    assert got == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    path = f"file://{tmp_path}/w"
    warc.archive_pages(pages, path)
    df = spark.read.format("warc").option("path", path).load()
    assert {bytes(r.payload) for r in df.where("record_type = 'response' and target_uri = 'u'").select("payload").collect()} == {b"", ("é" * 70000).encode(), b"solo"}


def test_suffix_arrays_and_shards():
    import numpy as np

    for _ in range(60):
        x = np.array([RNG.randint(1, RNG.choice([1, 2, 4])) for _ in range(RNG.randint(1, 50))] + [0])
        assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
        strings = [bytes(RNG.choice(b"ab") for _ in range(RNG.randint(0, 25))) for _ in range(4)]
        n = Counter(s[i : i + 4] for s in strings for i in range(len(s) - 3))
        assert [r.tolist() for r in repeated_starts(strings, 4)] == [[i for i in range(len(s) - 3) if n[s[i : i + 4]] > 1] for s in strings]


@pytest.mark.parametrize("most, capacity", [(1024, 10**9), (1, 10**9), (2, 50)])
def test_suffix_dedup(docs, none, most, capacity, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MAX_STRETCHES", most)
    data = [(r[0], (r[1] or "").encode()) for r in ROWS]
    n = Counter(b[i : i + 400] for _, b in data for i in range(len(b) - 399))
    want = Counter()
    for i, b in data:
        gone = {j for k in range(len(b) - 399) if n[b[k : k + 400]] > 1 for j in range(k, k + 400)}
        want[i, len(b), len(gone), sum(1 for j in gone if j - 1 not in gone), bytes(c for j, c in enumerate(b) if j not in gone)] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeated_bytes(docs, capacity).collect())
    assert got == want
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((r[0], len(words(r[1]))) for r in ROWS)
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert all(t <= 2 * s + 1e-6 for s, t in targets) and sum(t for _, t in targets) == pytest.approx(1.5 * total)
    assert all(r.taken <= 2 * r.size or r.size == 0 for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect())) and mixing.mix(none).count() == 0


def test_language_id(spark, none):
    texts = {"en": "the cat and the dog went to the house with this man ", "de": "der hund und die katze gehen nicht in das haus mit dem mann "}
    rows = [(i, " ".join(RNG.sample(texts[k].split(), 8)) * 5, k) for i in range(60) for k in ("en", "de")] + [(900, None, "en"), (901, "12 34 !", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = language_id.fit(docs, F.col("doc_id") % 2 == 0)
    got = language_id.predict(docs, model, keep=[F.col("doc_id"), F.col("lang")]).collect()
    assert all(r.lang_pred == r.lang for r in got if r.doc_id < 900) and {r.lang_pred for r in got if r.doc_id >= 900} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language_id.predict(none, {}).count() == 0


def test_near_duplicates(spark, none):
    base = sentence(120).split()

    def edited(k):
        out = list(base)
        for i in RNG.sample(range(len(out)), k):
            out[i] = f"z{RNG.random()}"
        return " ".join(out)

    rows = [(i, edited(k % 8)) for i, k in enumerate(range(60), 1)] + [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (104, " ")]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    of = {i: i for i in sets}
    for _ in range(len(sets)):
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    of[a] = of[b] = min(of[a], of[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in got} == {i: (of[i], len(sets[i])) for i in sets}
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_decontamination(spark, docs, none):
    item = sentence(30)
    first, second = " ".join(item.split()[:15]), " ".join(item.split()[15:])
    bench = spark.createDataFrame([(1, item), (2, "too short"), (3, None)], "item_id long, text string")
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(50, f"{sentence(20)} {second.upper()}. {sentence(9)} {first}!"), (51, first[:40])], "doc_id long, text string"))
    for bound in (10**6, 0):
        got = decontamination.contamination(rows, bench, max_broadcast_bytes=bound).collect()
        assert [(r.doc_id, r.best_item, r.coverage) for r in got if r.contaminated] == [(50, 1, 1.0)]
    assert decontamination.contamination(none, bench).count() == 0 and not any(r.contaminated for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_tiles_fill_what_an_overlapped_match_leaves():
    item = list(range(20))
    text = [*item[:8], 90, *item[5:14], 91]
    assert sorted(decontamination.tile(item, text, 5)) == [(0, 0, 5), (5, 9, 9)]


@pytest.mark.parametrize("capacity", [10**9, 60])
def test_substring_dedup(docs, none, capacity):
    # Rows of one id are ordered by a hash of their text; here neither has a window.
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, want = set(), Counter()
    for i, t, *_ in ordered:
        w = words(t)
        gone = set()
        for k in range(len(w) - 19):
            if (q := tuple(w[k : k + 20])) in seen:
                gone |= set(range(k, k + 20))
            seen.add(q)
        want[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()] += 1
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs, capacity).collect())
    assert got == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        after = corpus_pipeline.stage(step(spark, docs, d), name)
        assert 0 < after.count() <= docs.count()
        assert name == "mixing" or after.columns == docs.columns
        docs = after


def test_word_hashes_follow_the_words(monkeypatch):
    from fieldglass.llm import common

    text = b"  a bb\ta\x0bbb a\r\nccc " + b"x" * 700 + b" y " + b"x" * 700 + b" z" * 300
    of = {}
    for piece in (1 << 20, 64):
        monkeypatch.setattr(common, "TEXT_PIECE", piece)
        for t in (text, text.strip(), b"", b" \n", b"a"):
            got = common.word_hashes(t).tolist()
            assert len(got) == len(t.split())
            for w, h in zip(t.split(), got):
                assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_parity_bitmaps_bound_the_difference(spark):
    texts = [sentence(n) for n in (1, 7, 150, 150, 3000)]
    texts += [texts[2].replace("w1", "q"), texts[4].replace("w12 ", "q "), texts[4] + " " + sentence(20)]
    rows = minhash_dedup.shared_shingles(spark.createDataFrame([(bytes([i]), t.encode()) for i, t in enumerate(texts)], "node binary, text binary"), 5)[0].collect()
    bits = {r.node[0]: [x % 2**64 for x in r.parity] for r in rows}
    sets = [set(minhash_dedup.shingles(t.encode()).tolist()) for t in texts]
    for r in rows:
        assert r.n == len(sets[r.node[0]])
    for a, x in bits.items():
        for b, y in bits.items():
            differ = sum((p ^ q).bit_count() for p, q in zip(x, y, strict=True))
            assert differ <= len(sets[a] ^ sets[b]) and (differ - len(sets[a] ^ sets[b])) % 2 == 0


def unlike_family():
    """Texts of which few reach the similarity though all collide often, and the component of each."""
    base = [f"b{i}" for i in range(200)]
    texts = []
    for k in range(48):
        out = list(base)
        for i in RNG.sample(range(len(out)), 2 if k % 12 == 0 else 8):
            out[i] = f"z{RNG.random()}"
        texts.append(out)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    of = list(range(len(sets)))
    for _ in sets:
        for a, b in itertools.combinations(range(len(sets)), 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                of[a] = of[b] = min(of[a], of[b])
    return [" ".join(t) for t in texts], of


@pytest.mark.parametrize("crowded", [minhash_dedup.MAX_MEMBERS, 8])
def test_near_duplicates_of_large_unlike_families(spark, monkeypatch, crowded):
    texts, of = unlike_family()
    rounds = []
    monkeypatch.setattr(minhash_dedup, "MAX_MEMBERS", crowded)
    monkeypatch.setattr(minhash_dedup, "stage", lambda df, name, f=minhash_dedup.stage: (rounds.append(name), f(df, name))[1])
    got = minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(of))
    # Rounds against one member each that find next to nothing are not repeated.
    assert rounds.count("centres") < minhash_dedup.STAR_ROUNDS


def test_pipeline_near_duplicates_end_fruitless_rounds(spark, monkeypatch):
    import corpus_pipeline

    texts, of = unlike_family()
    rounds = []
    monkeypatch.setattr(minhash_dedup, "stage", lambda df, name, f=minhash_dedup.stage: (rounds.append(name), f(df, name))[1])
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert {(r.doc_id, r.text) for r in got} == {(i, texts[i]) for i in set(of)} and len(got) == len(set(of))
    assert rounds.count("centres") < minhash_dedup.STAR_ROUNDS


def test_pipeline_near_duplicates_carry_light_rows_and_read_texts_once(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    texts, of = unlike_family()
    rows = list(enumerate(texts)) + [(900, ""), (901, None), (None, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/once")
    spark.createDataFrame([*rows, *rows], "doc_id long, text string").write.parquet(f"{tmp_path}/twice")
    carried = []
    monkeypatch.setattr(minhash_dedup, "stage", lambda df, name, f=minhash_dedup.stage: (carried.append((name, df.schema.simpleString())), f(df, name))[1])
    docs = spark.read.parquet(f"{tmp_path}/once")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    want = Counter({(i, texts[i]): 1 for i in set(of)}) + Counter(rows[len(texts) :])
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    rounds = [columns for name, columns in carried if name in ("members", "now", "centres")]
    assert rounds and not any("signature" in columns or "parity" in columns for columns in rounds)
    # Scans of the texts in the plan of the result: one, if no row that stays is repeated.
    assert len(re.findall(r"Relation \[doc_id#\d+L,text#\d+\]", out._jdf.queryExecution().optimizedPlan().toString())) == 1
    # Repeated rows are copies; those without words all stay.
    twice = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/twice"), "")
    assert Counter((r.doc_id, r.text) for r in twice.collect()) == want + Counter(rows[len(texts) :])


def test_blocks_of_a_sketch_are_merged_at_once(spark, monkeypatch):
    from fieldglass.llm import sketch

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        values = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 5000, dtype=np.uint64)

        def partials(batches):
            for _ in batches:
                yield from sketch.partial([values, values[:1000]], 22)

        spark.sparkContext.setJobGroup("blocks", "")
        bits = np.frombuffer(sketch.repeated_bits(spark.range(1).mapInArrow(partials, sketch.SCHEMA), 22), np.uint8)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("blocks"))
        assert sketch.maybe_repeated(values[:1000], bits, 22).all() and sketch.maybe_repeated(values[1000:], bits, 22).mean() < 0.05
        assert 0 < jobs < 24
    finally:
        spark.sparkContext._jsc.clearJobGroup()
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_of_a_posting_at_once(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    size = 600
    family = rng.integers(-(2**63), 2**63, (4, minhash_dedup.PARITY_WORDS))
    parity = family[np.arange(size) % 4] ^ (np.int64(1) << rng.integers(0, 64, (size, minhash_dedup.PARITY_WORDS)))
    signature = rng.integers(0, 3, (size, minhash_dedup.COORDINATES))
    n = rng.integers(80, 160, size)
    common = n - rng.integers(0, 15, size)
    component = np.array([f"c{x}" for x in rng.integers(0, 200, size)])
    group = rng.choice([1, 2, 2, 3, 3, 3, 3, 3, 3, 3], size)
    expected = set()
    for i, j in itertools.combinations(range(size), 2):
        both, sizes = min(common[i], common[j]), n[i] + n[j]
        differ = sum((int(x) % 2**64 ^ int(y) % 2**64).bit_count() for x, y in zip(parity[i], parity[j], strict=True))
        if group[i] == group[j] and component[i] != component[j] and 100 * both >= 75 * (sizes - both) and (signature[i] == signature[j]).sum() >= minhash_dedup.MIN_MATCHES and 175 * differ <= 25 * sizes:
            expected.add((i, j))
    rows = [(int(group[i]), 7, i.to_bytes(2, "big"), int(n[i]), int(common[i]), signature[i].tolist(), parity[i].tolist(), component[i].encode()) for i in range(size)]
    members = spark.createDataFrame(rows, "token long, second long, node binary, n long, common long, signature array<long>, parity array<long>, component binary")
    common_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("1", "50", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for keys in (["token"], ["token", "second"]):
                got = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in minhash_dedup.across(members, keys, 75).collect()]
                assert len(got) == len(expected) > 100 and set(got) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", common_batches)
