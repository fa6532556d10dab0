"""The pipeline's stages against brute force, with odd rows and clashing names."""

import os
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as p
from fabula.llm import quality
from fabula.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
CLASHING = "score quality_score _later _hit n_removed n_words kept_text spans c0 id node chunk component_id kept kept_column_0 n_tokens token_ids lang source".split()
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Folder of tables: good and bad texts, copies, near copies, shared passages, benchmark items, nulls, repeated rows."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(600)]
    some = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(some(rnd.randint(80, 200))).capitalize() + "." for _ in range(60)]
    junk = ["|| ## !! $$ 1234 %% " * rnd.randint(5, 30) for _ in range(20)]
    passage, items = some(70), [some(n) for n in (20, 40, 60)]
    texts += [" ".join(some(60) + passage + some(60)) for _ in range(6)]
    texts += [" ".join(some(50) + items[i % 3] + some(30)) for i in range(6)]
    texts += [texts[0], texts[1], " ".join(texts[2].split()[:-1])]  # copies, a near copy
    rows = [(i, t) for i, t in enumerate(texts + junk)] + [(500, None), (501, ""), (502, "two words"), (503, " ".join(some(30_000))), (504, texts[5]), (504, texts[5]), (None, " ".join(some(90)))]
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.createDataFrame([(i, t, len(t or ""), *[f"{i}"] * len(CLASHING)) for i, t in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 75)) for i in range(95)] + [(500, None), (None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(8, None), (9, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, items


def listed(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_by_brute_force(spark, corpus):
    folder, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    found = {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, folder).cache()
        assert out.columns == columns and out.schema == docs.schema
        assert all(r[c] == str(r["doc_id"]) for r in out.collect() for c in CLASHING)
        found[name] = listed(docs), listed(out)
        docs = out
    before, after = found["quality classifier"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    scores = quality.score(whole.select("doc_id", "text"), quality.fit(whole, labels.where(~quality.held_out())), carry=["doc_id", "text"]).collect()
    assert after == sorted(((r["doc_id"], r["text"]) for r in scores if r["score"] >= 0.5), key=repr)
    assert {i for i, _ in after} >= {*range(75), 500, 501} and not {i for i, _ in after} & {*range(75, 95)}

    before, after = found["MinHash near-dedup"]
    sets = {i: {*shingles([x.lower() for x in words(t)])} or ({tuple(words(t))} if words(t) else set()) for i, t in before if i is not None}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert after == [(i, t) for i, t in before if i is None or find(i) == i] and len(after) < len(before)

    before, after = found["substring dedup"]
    n, first = p.REPEAT_WORDS, {}
    order = lambda i: 2**63 - 1 if i is None else i
    for i, t in sorted(before, key=lambda r: order(r[0])):
        w = words(t)
        for s in range(len(w) - n + 1):
            first.setdefault(tuple(w[s : s + n]), order(i))
    want = []
    for i, t in before:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            if first[tuple(w[s : s + n])] < order(i):
                gone[s : s + n] = [True] * n
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        if not any(gone) or left:
            want.append((i, t if not any(gone) else " ".join(left)))
    assert [(i, t if t is None or t in {x for j, x in want if j == i} else " ".join(words(t))) for i, t in after] == want

    before, after = found["benchmark decontamination"]
    dirty = set()
    for i, t in before:
        h = shingles(re.findall(r"\w+", (t or "").lower()))
        for item in items:
            own = Counter(shingles(item))
            size = sum(own.values())
            for s in range(max(1, len(h) - size + 1)):
                both = sum((Counter(h[s : s + size]) & own).values())
                if both and both >= 0.8 * (len(h[s : s + size]) + size - both):
                    dirty.add(i)
    assert dirty and after == [(i, t) for i, t in before if i not in dirty]


def test_run(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    got = p.run(spark, folder)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    assert sorted(((r["doc_id"], r["token_ids"]) for r in got.collect()), key=repr) == sorted(((r["doc_id"], library.encode(r["text"] or "")) for r in docs.collect()), key=repr)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from fabula.llm import _exchange

    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError):
        _exchange.shared_folder(Session())
