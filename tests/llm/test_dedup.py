"""Deduplication and decontamination against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fabula.llm.decontaminate import contaminations, decontaminate, simhash, weighted_jaccard
from fabula.llm.minhash import near_duplicates
from fabula.llm.substring_dedup import substring_dedup
from fabula.llm.suffix_dedup import merge_runs, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, extra int"


def corpus(seed: int = 0) -> list[tuple]:
    """Random texts that share passages; copies, near copies, ties, nulls, empty, short, one long text, equal ids."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(300)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randint(5, 60))] for _ in range(6)]
    texts = []
    for _ in range(60):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 80))]
        for _ in range(rnd.randint(0, 2)):
            at = rnd.randint(0, len(w))
            w[at:at] = rnd.choice(passages)[: rnd.randint(5, 60)]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(w))
    for t in texts[:10]:
        w = t.split()
        if w:
            w[rnd.randrange(len(w))] = "changed"
        texts += [t, " ".join(w), t.upper()]
    texts += [None, "", " \n\t", "one", "two words", "two words", "\u00a0\u2003x", " ".join(rnd.choice(vocabulary) for _ in range(20_000)), "same " * 400, "same " * 300]
    rows = [(i, t, "en", i % 3) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize(("n", "hot_chunks"), [(13, 64), (13, 1), (50, 64), (50, 1), (60, 2)])
def test_substring_dedup(spark, n, hot_chunks):
    rows = corpus()
    first: dict = {}
    for i, t, *_ in sorted(rows):
        w = words(t)
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), i)
    want = {}
    for i, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < i:
                gone[s : s + n] = [True] * n
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), min_words=n, chunk_bytes=4000, hot_chunks=hot_chunks, carry=["lang", "extra"]).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert len(got) == len(rows) and all(r["extra"] == r["doc_id"] % 3 for r in got)
    assert all(sum(s["len"] for s in r["spans"]) == r["n_removed"] for r in got)
    laid = substring_dedup(spark.createDataFrame(rows, SCHEMA), min_words=n, keep_layout=True).collect()
    text = {i: t for i, t, *_ in rows}
    assert all(words(r["kept_text"]) == words(want[r["doc_id"]][2]) for r in laid)
    assert all(r["kept_text"] == text[r["doc_id"]] for r in laid if r["n_removed"] == 0)


@pytest.mark.parametrize("hot_chunks", [64, 1])
def test_suffix_dedup(spark, hot_chunks):
    rows, n = corpus(), 50
    raw = {i: (t or "").encode() for i, t, *_ in rows}
    first: dict = {}
    for i in sorted(raw):
        for s in range(len(raw[i]) - n + 1):
            first.setdefault(raw[i][s : s + n], i)
    want = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for s in range(len(b) - n + 1):
            if first[b[s : s + n]] < i:
                gone[s : s + n] = b"\1" * n
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), chunk_bytes=4000, hot_chunks=hot_chunks).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got} == want


def test_merge_runs():
    rnd = random.Random(1)
    runs = [sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 30))) for _ in range(7)]

    def prefix(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    shared = [[prefix(r[i - 1], r[i]) if i else 0 for i in range(len(r))] for r in runs]
    every = [s for r in runs for s in r]
    order, lcp = merge_runs(runs, shared)
    assert [every[i] for i in order] == sorted(every)
    assert lcp[1:] == [prefix(every[a], every[b]) for a, b in zip(order, order[1:], strict=False)]


def test_null_and_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, "en", 0), (None, text, "en", 0), (5, text, "en", 0), (5, text, "en", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup(df).collect()) == [(0, 30), (0, 30), (5, 0), (5, 0)]
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup(df).collect()) == [(0, len(text))] * 2 + [(5, 0)] * 2
    near = near_duplicates(df).collect()
    assert len(near) == 4 and all(r["kept"] for r in near) and {r["component_id"] for r in near} == {None, 5}


@pytest.mark.parametrize(("block_docs", "block_shingles"), [(1500, 2_000_000), (4, 2_000_000), (1500, 300)])
@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, block_docs, block_shingles, k, num):
    rows = corpus(1)
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[i] = {tuple(w[s : s + k]) for s in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA), shingle_words=k, similarity=(num, 100), block_docs=block_docs, block_shingles=block_shingles).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("broadcast_shingles", [1_000_000, 0])
def test_contaminations(spark, broadcast_shingles):
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rnd.choice(vocabulary) for _ in range(n)] for n in (14, 20, 40, 75, 4, 30)]
    docs = []
    for i in range(80):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if i % 2:
            passage = list(rnd.choice(items))
            for _ in range(rnd.randint(0, 2)):
                at = rnd.randrange(len(passage))
                passage[at : at + rnd.randint(0, 1)] = [rnd.choice(vocabulary)][: rnd.randint(0, 1)]
            at = rnd.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, rnd.choice([", ", " ", "\n"]).join(w), "en", 0))
    long = [rnd.choice(vocabulary) for _ in range(9000)]
    long[2040:2040], long[4090:4090], long[6200:6200] = items[3], items[2], items[3]  # about the borders of pieces
    docs += [(103, " ".join(long), "en", 0), (104, " ".join(items[2]), "en", 0), (104, " ".join(items[2]), "en", 0), (104, " ".join(items[5]), "en", 0)]
    docs += [(100, None, "en", 0), (101, "", "en", 0), (None, " ".join(items[0]), "en", 0), (102, " ".join(items[1]).upper(), "en", 0)]

    def shingles(w):
        return [tuple(w[s : s + 5]) for s in range(len(w) - 4)]

    want = set()
    for i, t, *_ in docs:
        h = shingles(re.findall(r"\w+", (t or "").lower()))
        for n, item in enumerate(items):
            own = Counter(shingles(item))
            size = sum(own.values())
            for s in range(max(1, len(h) - size + 1)) if size else ():
                window = Counter(h[s : s + size])
                both = sum((window & own).values())
                if both and both >= 0.8 * (sum(window.values()) + size - both):
                    want.add((i, n))
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    assert sorted([(r["doc_id"], r["item_id"]) for r in contaminations(df, bench, broadcast_shingles=broadcast_shingles).collect()], key=repr) == sorted(want, key=repr) and want
    assert {r["doc_id"] for r in decontaminate(df, bench).collect()} == {i for i, *_ in docs if i is None or i not in {a for a, _ in want}}


@pytest.mark.parametrize(("n", "cut"), [(59, 8), (59, 20), (59, 29), (59, 50), (200, 100)])
def test_contaminations_with_parts_swapped(spark, n, cut):
    item = [f"i{j}" for j in range(n)]
    text = [f"a{j}" for j in range(100)] + item[cut:] + item[:cut] + [f"b{j}" for j in range(100)]
    own = {tuple(item[s : s + 5]) for s in range(n - 4)}
    h = [tuple(text[s : s + 5]) for s in range(len(text) - 4)]
    both = [len(own & {*h[s : s + len(own)]}) for s in range(len(h) - len(own) + 1)]
    best = max(both)
    df = spark.createDataFrame([(1, " ".join(text), "en", 0)], SCHEMA)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in contaminations(df, bench).collect()] == [(1, 7, best / (2 * len(own) - best), both.index(best))]


def test_recall_of_the_radius(spark):
    """Of windows at 0.8 exactly, and up to 0.85, the radius holds all."""
    rnd = random.Random(5)
    rows = []
    for i in range(4000):
        n = rnd.choice([27, 36, 54, 90])
        same = n * rnd.choice([8, 8, 8, 17]) // 9 if n % 9 == 0 and rnd.random() < 0.9 else n - 1
        same = min(same, n)
        h = [rnd.getrandbits(63) for _ in range(2 * n - same)]
        rows.append((i, h[:n], h[n - same :]))
    df = spark.createDataFrame(rows, "i int, left array<bigint>, right array<bigint>")
    found = df.select(weighted_jaccard("left", "right").alias("s"), simhash("left").alias("f"), simhash("right").alias("g")).where("s >= 0.8").selectExpr("count(*) n", "sum(cast(bit_count(f ^ g) <= 23 as int)) near").first()
    assert found["n"] > 3000 and found["near"] == found["n"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    for found in (substring_dedup(none), suffix_dedup(none), near_duplicates(none), contaminations(none, bench)):
        assert found.count() == 0
    assert contaminations(spark.createDataFrame(corpus(), SCHEMA), bench).count() == 0

def test_join_with_hot_keys(spark):
    from fabula.llm._exchange import join_sized

    rnd = random.Random(6)
    rows = [(rnd.choice([7, 7, 7, *range(40)]), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "a long, b long")
    right = left.where("a <> 5").groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m"))
    for largest in (10, 100, 10_000):
        got = join_sized(left, right, ["a"], "n", largest)
        assert sorted(map(tuple, got.select("a", "b", "n", "m").collect())) == sorted(map(tuple, left.join(right, "a").select("a", "b", "n", "m").collect()))
