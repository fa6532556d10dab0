"""Golden cases of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.functions import text as X
from fabula.functions.tokens import Cleaner, shortened
from fabula.operators import annotate, clustering, counting, density, embeddings, entities, graph, manifold, srl, statements, svo, verbs
from fabula.operators.model import NarrativeModel
from fabula.plans import queries
from fabula.sources import files, reports
from fabula.streaming import statements as streaming
from golden import EN, FR, SRL, parsed

HOUSE, NICE = "This is a house", "It is a nice house"


@pytest.mark.parametrize(("chars", "words", "want"), [(15, None, [HOUSE]), (14, None, [""]), (None, 4, [HOUSE]), (None, 3, [""]), (18, 5, [HOUSE, NICE]), (None, 4, [HOUSE, ""]), (17, None, [HOUSE, ""]), (None, 0, ["", ""]), (0, None, ["", ""])])
def test_limits(spark, chars, words, want):
    df = spark.createDataFrame([(t,) for t in [HOUSE, NICE][: len(want)]], "s string")
    assert [r[0] for r in df.select(X.limited(F.col("s"), chars, words)).collect()] == want


def test_limits_must_not_be_negative():
    with pytest.raises(ValueError):
        X.limited("s", -1)


@pytest.mark.parametrize(("texts", "chars", "size", "want"), [([HOUSE] * 2, 15, None, [0, 1]), ([HOUSE] * 2, 29, None, [0, 1]), ([HOUSE] * 2, 30, None, [0, 0]), ([HOUSE] * 2, None, None, [0, 0]), ([HOUSE, HOUSE, ""], 15, None, [0, 1, 1]), ([HOUSE] * 3, 30, None, [0, 0, 1]), ([HOUSE] * 3, None, 2, [0, 0, 1])])
def test_batches(spark, texts, chars, size, want):
    assert spark.createDataFrame([(texts,)], "t array<string>").select(X.batch_numbers(F.col("t"), chars, size)).first()[0] == want


def test_batches_take_one_option():
    with pytest.raises(ValueError):
        X.batch_numbers("t", 1, 1)


def test_subset_and_pretty(spark):
    df = spark.createDataFrame([(["united", "states", "of"], ["of", "the", "united", "states"], True), (["europe"], ["the"], False), ([], ["x"], True)], "a array<string>, b array<string>, want boolean")
    assert all(r[0] == r[1] for r in df.select(X.is_subset(F.col("a"), F.col("b")), "want").collect())
    s = spark.createDataFrame([("taxes", "kill", True, None, "jobs", None), ("they", "give", None, "may", "time", "us")], "arg0 string, verb string, neg boolean, mod string, arg1 string, arg2 string")
    assert [r[0] for r in s.select(X.pretty()).collect()] == ["taxes ! kill jobs", "they may give time us"]


def test_counts(spark):
    df = spark.createDataFrame([("increase",), ("decrease",), ("decrease",)], "verb string")
    assert {tuple(r) for r in counting.count_values(df, ["verb"]).collect()} == {("increase", 1), ("decrease", 2)}
    assert counting.count_values(df).count() == 0
    s = spark.createDataFrame([("this is a nice world",), ("hello world",), ("hello everybody",)], "sentence string")
    w = {r["token"]: r["weight"] for r in counting.sif_weights(s).collect()}
    assert w["world"] == pytest.approx(0.001 / 2.001) and w["nice"] == pytest.approx(0.001 / 1.001)


def test_sif_vector_and_missing_vectors(spark):
    table = spark.createDataFrame([("no", [1.0, 0.0]), ("world", [0.0, 1.0])], "token string, vec array<double>")
    s = spark.createDataFrame([("hello world",), ("a world",)], "sentence string")
    backend = embeddings.embeddings("Word2Vec", table, sentences=s)
    got = {r["phrase"]: r["vec"] for r in backend.vectors(spark.createDataFrame([("no world",), ("",), ("unknown",)], "phrase string")).collect()}
    want = np.array([1.0, 0.001 / 2.001])
    assert got["no world"] == pytest.approx(list(want / np.linalg.norm(want)))
    assert got[""] is None and got["unknown"] is None
    with pytest.raises(ValueError):
        embeddings.embeddings("other", table)


def test_words_that_share_vectors(spark, monkeypatch):
    """The same vectors as by a table of words: repeated words, codes without a vector or with two, SIF weights, pieces."""
    codes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("lost", 9), ("none", None), ("twice", 3), ("zero", 4)], "token string, code long")
    shared = spark.createDataFrame([(1, [1.0, 0.0, 2.0]), (2, [0.0, 3.0, 1.0]), (3, [1.0, 1.0, 0.0]), (3, [5.0, 0.0, 0.0]), (4, [0.0, 0.0, 0.0])], "code long, vec array<double>")
    phrases = spark.createDataFrame([("a a b",), ("b c twice",), ("c lost none x",), ("lost",), ("none",), ("zero",), ("",), (None,), ("twice a",)], "phrase string")
    weights = spark.createDataFrame([("a", 0.25), ("c", 0.5)], "token string, weight double")
    monkeypatch.setattr(embeddings, "_SUMMED", 3)
    for normalize in (True, False):
        for w in (None, weights):
            backend = embeddings.WordVectors(codes, normalize, w, shared)
            got, want = ({r["phrase"]: r["vec"] for r in b.vectors(phrases).collect()} for b in (backend, embeddings.WordVectors(backend.flat(), normalize, w)))
            assert set(got) == set(want) and len(got) == 9
            assert {p for p in got if got[p] is None} == {p for p in want if want[p] is None} == {"lost", "none", "zero", "", None}
            assert all(got[p] == pytest.approx(want[p]) for p in got if got[p])


def test_words_do_not_carry_vectors_and_phrases(spark):
    """Rows for each word and dimension with the whole phrase took more than 0.76 GB of disk over 0.12 GB."""
    plan = queries.QUERIES["phrases_with_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(vec" not in plan


def test_predictions_do_not_carry_vectors(spark):
    """Rows of words had 64 dimensions each."""
    made = queries.QUERIES["predict_by_centres"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode(vec" not in plan


TOKENS = [("The", "the", "the", False, False), ("Taxes", "taxes", "tax", False, False), ("$", "$", "$", False, False), ("42", "42", "42", False, True), (",", ",", ",", True, False), ("cut-off", "cut-off", "cut-off", False, False)]


@pytest.mark.parametrize(("options", "want"), [({"stop_words": ["the"]}, "tax cut off"), ({"stop_words": ["the"], "compat": True}, "tax  cut off"), ({"stop_words": ["the"], "lemmatize": False}, "taxes cut off"), ({"stop_words": ["The"], "lemmatize": False, "lowercase": False}, "Taxes cut off")])
def test_cleaning(spark, options, want):
    df = spark.createDataFrame([(TOKENS,)], "t array<struct<text: string, lower: string, lemma: string, is_punct: boolean, is_digit: boolean>>")
    got = df.select(Cleaner(remove_chars=["$", "-"], **options).clean(F.col("t")).alias("p"))
    assert got.first()[0] == want
    assert got.select(shortened(F.col("p"), 5)).first()[0] == ""


def svos(spark, french=False, **options):
    got = svo.extract_svos(parsed(spark, french), ["s"], **options).select("s", "arg0", "neg", "verb", "arg1")
    return sorted(map(tuple, got.collect()), key=repr)


def test_golden_svos(spark):
    assert svos(spark) == sorted(EN, key=repr)
    assert svos(spark, only_triplets=False) == sorted([*EN, ("F1", None, None, "hinder", "innovation")], key=repr)
    assert svos(spark, language=svo.ENGLISH_COMPAT) == sorted([(s, a, None, v, b) for s, a, _, v, b in EN], key=repr)
    assert svos(spark, True, language="french") == sorted(FR, key=repr)


def test_golden_roles(spark):
    rows = [(s, (w.split(), [(t.split(),) for t in tags])) for s, w, tags in SRL]
    parses = spark.createDataFrame(rows, "s string, parse struct<words: array<string>, verbs: array<struct<tags: array<string>>>>")
    got = {r["s"]: (r["arg0"], r["verb"], r["mod"], r["arg1"], r["arg2"], r["neg"]) for r in srl.extract_roles(parses, ["s"]).collect()}
    assert got == {
        "R-1": ("Taxes", "kill", None, "jobs", None, True), "R-2": (None, "kill", None, "jobs", None, None), "R-3": ("They", "give", "may", "time", "us", None), "R-4": ("he", "said", None, "Reform failed", None, None),
    }
    assert {r["s"] for r in srl.extract_roles(parses, ["s"], only_triplets=True).collect()} == {"R-1", "R-3", "R-4"}


def test_custom_svo_and_unknown_language(spark):
    got = svo.extract_svos(parsed(spark), ["s"], language="german", custom=lambda tokens: [(tokens[0]["text"], False, "do", "")]).where("s = 'F1'").collect()
    assert [(r["arg0"], r["neg"], r["verb"], r["arg1"]) for r in got] == [("Taxes", None, "do", None)]
    with pytest.raises(ValueError):
        svo.extract_svos(parsed(spark), ["s"], language="german")


def test_srl_keeps_other_batches(spark):
    def model(texts):
        if "bad" in texts:
            raise RuntimeError
        return [{"words": t.split(), "verbs": [{"tags": ["B-ARG0", "B-V", "B-ARG1"]}]} for t in texts]

    s = spark.createDataFrame([(1, "a b c"), (2, "bad"), (3, "d e f")], "k int, sentence string").coalesce(1)
    roles = srl.extract_roles(srl.annotate(s, model, ["k"], batch_size=1), ["k"], only_triplets=True)
    assert sorted((r["k"], r["verb"]) for r in roles.collect()) == [(1, "b"), (3, "e")]


def test_labeller_with_limits_of_its_own(spark):
    model = srl.RoleLabeller(lambda texts: [{"words": t.split(), "verbs": []} for t in texts], max_words=2)
    s = spark.createDataFrame([(1, "a b c"), (2, "a b")], "k int, sentence string")
    size = lambda df: sorted((r["k"], len(r["parse"]["words"])) for r in df.collect())
    assert size(model(s, ["k"])) == [(1, 0), (2, 2)] and size(model(s, ["k"], max_words=3)) == [(1, 3), (2, 2)]


def test_annotated_tokens(spark):
    def model(texts):
        if "fail" in texts:
            raise RuntimeError
        known = {"Taxes kill jobs !": [{"text": "Taxes", "pos": "NOUN", "dep": "nsubj", "head": 1, "lemma": "tax"}, {"text": "kill", "pos": "VERB", "dep": "ROOT", "head": 1}, {"text": "jobs", "pos": "NOUN", "dep": "dobj", "head": 1, "chunk": "the jobs"}, {"text": "!"}]}
        return [known.get(t, []) for t in texts]

    s = spark.createDataFrame([(1, "Taxes kill jobs !"), (2, "fail"), (3, ""), (4, None)], "k int, sentence string").coalesce(1)
    tokens = annotate.annotate_tokens(s, model, ["k"], batch_size=1).cache()
    assert [tuple(r) for r in svo.extract_svos(tokens, ["k"]).collect()] == [(1, 0, "Taxes", "kill", None, "the jobs")]
    assert {r["k"]: len(r["tokens"]) for r in tokens.collect()} == {1: 4, 2: 0, 3: 0, 4: 0}
    assert tokens.where("k = 1").select(Cleaner().clean(F.col("tokens"))).first()[0] == "tax kill jobs"
    assert tokens.where("k = 1").first()["tokens"][0]["anc"] == [0, 1]


def test_verbs(spark):
    s = spark.createDataFrame([("kill", None), ("increase", True), ("vote", True), (None, None)], "verb string, neg boolean")
    counts = spark.createDataFrame([("kill", 3), ("destroy", 3), ("decrease", 2), ("increase", 1)], "value string, cnt long")
    got = verbs.clean_verbs(s, counts, verbs.lexicon(spark, {"kill": ["destroy", "end"]}), verbs.lexicon(spark, {"increase": ["decrease", "fall"]}))
    assert {(r["verb_lowdim"], r["neg_lowdim"]) for r in got.collect()} == {("destroy", None), ("decrease", None), ("vote", True), (None, None)}


def test_entities(spark):
    table = entities.entity_table(spark, ["tax", "job market", ""])
    phrases = spark.createDataFrame([("income tax",), ("market for the job",), ("tax on job market",), ("taxes",)], "phrase string")
    assert {tuple(r) for r in entities.character_matching(phrases, table).collect()} == {("income tax", "tax"), ("market for the job", "job market"), ("tax on job market", "tax|job market")}


def test_nearest(spark):
    centres = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, vec array<double>")
    points = spark.createDataFrame([([0.6, 0.8],), (None,)], "vec array<double>")
    got = embeddings.nearest(points, centres).collect()
    assert (got[0]["nearest_id"], round(got[0]["distance"], 6)) == (2, 0.632456) and got[1]["nearest_id"] is None
    assert embeddings.nearest(points, centres, threshold=0.6).count() == 0


@pytest.mark.parametrize(("n", "want"), [(150, [2, 2, 2, 2, 2]), (1000, [2, 2, 4, 6, 10]), (5000, [4, 12, 24, 36, 50]), (200_000, [99, 249, 499, 749, 1000])])
def test_kmeans_grid(n, want):
    assert clustering.kmeans_grid(n) == want


@pytest.mark.parametrize(("n", "want"), [(100, [2, 4, 6, 10]), (900, [7, 14, 21, 30]), (10_000, [24, 49, 74, 100])])
def test_hdbscan_grid(n, want):
    assert [p["min_cluster_size"] for p in clustering.hdbscan_grid(n)][::3] == want


def test_knee_and_density():
    assert clustering.knee([1, 2, 3, 4, 5, 6, 7, 8], [100, 50, 20, 10, 8, 7, 6, 5]) in (3.0, 4.0)
    assert clustering.knee([1, 2, 3], [1, 1, 1]) is None
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (30, 2)) for c in (0, 5, 10)])
    fitted = density.fit(x, 10, 5)
    assert len(set(fitted.labels[fitted.labels >= 0])) == 3
    assert density.validity(x, fitted.labels) > 0.5
    assert list(fitted.predict(np.array([[0.0, 0.0], [5, 5]]))) == [fitted.labels[0], fitted.labels[30]]


def test_density_has_one_tree_at_every_size(spark, monkeypatch):
    """Three groups, copies of one point and scattered points: the tree of the executors weighs what the driver's does, and labels are alike."""
    rng = np.random.default_rng(5)
    x = np.concatenate([*(rng.normal(c, 0.3, (150, 4)) for c in (0, 4, 9)), np.repeat(rng.normal(20, 1, (1, 4)), 60, axis=0), rng.uniform(-5, 25, (40, 4))])
    want = density.fit(x, 10, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 5]
    weights = density.spanning_tree(np.maximum(np.maximum(d, core[None]), core[:, None]))[:, 2]
    monkeypatch.setattr(density, "MOST_POINTS", 20)
    for name, value in (("_LISTED", 6), ("_BLOCK", 37), ("_OTHERS", 101)):
        monkeypatch.setattr(density, name, value, raising=False)
    got = density.fit(x, 10, 5, spark)
    assert got.core == pytest.approx(core)
    assert np.sort(density._spread_tree(spark, x, 5)[1][:, 2]) == pytest.approx(np.sort(weights), abs=1e-9)
    pairs = set(zip(want.labels.tolist(), got.labels.tolist(), strict=True))
    assert len(pairs) == len(set(want.labels)) == len(set(got.labels)) and (-1, -1) in pairs
    with pytest.raises(ValueError):
        density.fit(x, 10, 5)


@pytest.mark.parametrize("labels", [3, 40])
def test_silhouette_has_one_value_at_every_size(spark, monkeypatch, labels):
    rng = np.random.default_rng(3)
    c = np.append(rng.integers(0, labels, 399), labels)
    x = rng.normal(0, 1, (400, 5)) + c[:, None] + 1000
    x[:50], c[:50] = x[0], c[0]
    d, size = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), np.bincount(c)
    want = []
    for i in range(400):
        mean = {k: d[i, c == k].sum() / (size[k] - (k == c[i])) for k in set(c) if size[k] - (k == c[i])}
        a, b = mean.pop(c[i], None), min(mean[k] for k in mean if k != c[i])
        want.append(0 if a is None else (b - a) / max(a, b))
    points = spark.createDataFrame([(v.tolist(), f"c{k}") for v, k in zip(x, c, strict=True)], "vec array<double>, cluster string").repartition(3)
    assert clustering.silhouette(points) == pytest.approx(np.mean(want), abs=1e-9)
    monkeypatch.setattr(clustering, "DRIVER_POINTS", 20, raising=False)
    monkeypatch.setattr(clustering, "EXACT_POINTS", 20, raising=False)
    for name in ("_BLOCK_POINTS", "_OWN_BLOCKS", "_OTHER_BLOCKS"):
        monkeypatch.setattr(clustering, name, 7, raising=False)
    assert clustering.silhouette(points.select("vec", F.substring("cluster", 2, 9).cast("int").alias("cluster"))) == pytest.approx(np.mean(want), abs=1e-9)


@pytest.mark.parametrize("most_cells", [2, 4096])
def test_silhouettes_of_several_clusterings(spark, monkeypatch, most_cells):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (90, 4))
    x[60:] = x[rng.integers(0, 9, 30)]  # copies, in the cluster of the first
    own = {f"c{k}": np.array([int(abs(v[0] * 7 + v[1])) % k for v in x]) for k in (1, 2, 5)}
    d, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for c in own.values():
        total = np.array([[d[i, c == k].sum() for k in set(c)] for i in range(90)])
        want.append(clustering._widths(total, c, np.bincount(c)).mean())
    points = spark.createDataFrame([(v.tolist(), *map(int, c)) for v, *c in zip(x, *own.values(), strict=True)], "vec array<double>, " + ", ".join(f"{c} int" for c in own)).repartition(3)
    assert clustering.silhouettes(points, "vec", list(own)) == pytest.approx(want, abs=1e-9)
    for name, value in {"DRIVER_POINTS": 20, "_BLOCK_POINTS": 7, "_AT_ONCE": 3, "_BLOCK_PARTS": 4, "_HELD": 50, "_MOST_CELLS": most_cells}.items():
        monkeypatch.setattr(clustering, name, value)
    assert clustering.silhouettes(points, "vec", list(own)) == pytest.approx(want, abs=1e-9)


def test_vectors_are_found_once(spark):
    table = spark.createDataFrame([("a", 0), ("b", 1), ("z", 2)], "token string, code long")
    backend = embeddings.WordVectors(table, shared=spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "code long, vec array<double>"))
    found = backend.vectors(spark.createDataFrame([("a",), ("b",), ("a b",), ("z",), ("none",)], "phrase string"))
    assert {r["phrase"]: r["vec"] and [round(v, 6) for v in r["vec"]] for r in found.collect()} == {"a": [0.6, 0.8], "b": [0, 1], "a b": [0.447214, 0.894427], "z": None, "none": None}
    used = backend.keyed(found).where("vec is not null").select("vec", F.size("vec"))
    assert used._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_graph(spark):
    rows = [("x", "v", True, "z"), ("x", "v", None, "z"), ("x", "v", None, "z"), (None, "v", None, "z"), ("b", "v", None, "z"), ("a", "v", None, "z")]
    s = spark.createDataFrame(rows, "arg0 string, verb string, neg boolean, arg1 string")
    assert [tuple(r) for r in graph.edges(s, 10).collect()] == [("x", "z", "v", 2), ("a", "z", "v", 1), ("b", "z", "v", 1), ("x", "z", "not v", 1)]
    assert graph.build_graph(s).nodes == {"z": 4, "x": 2, "a": 1, "b": 1}
    pair = spark.createDataFrame([("p", "v", None, "q"), ("r", "v", None, "s")], s.schema)
    assert set(graph.build_graph(pair).nodes) == {"p", "q"}
    assert graph.build_graph(s.limit(0)).nodes == {}


def test_model(spark, tmp_path):
    table = spark.createDataFrame([(w, [float(i), float(j)]) for w, i, j in (("tariff", 1, 0), ("duty", 1, 0.1), ("worker", 0, 1), ("labourer", 0.1, 1))], "token string, vec array<double>")
    rows = [("tariff", "hurt", "worker"), ("duty", "hurt", "labourer"), ("duty", "hurt", "worker"), ("income tax", "hurt", "unknown")]
    s = spark.createDataFrame(rows, "arg0 string, verb string, arg1 string")
    model = NarrativeModel(pca=False, roles_considered=["arg0", "verb", "arg1"], roles_with_known_entities=["arg0"], roles_with_unknown_entities=["arg0", "arg1"], known_entities=["tax"], backend=embeddings.WordVectors(table))
    model.fit(s, cluster_args=[{"n_clusters": 2}])
    assert sorted((r["arg0"], r["verb"], r["arg1"] or "") for r in model.predict(s).collect()) == sorted([("duty", "hurt", "worker")] * 3 + [("tax", "hurt", "")])
    assert model.predict(s, model=0).count() == 4
    assert {r["phrase"] for r in model.inspect_cluster("duty").collect()} == {"duty", "tariff"}
    with pytest.raises(IndexError):
        model.inspect_cluster("none")
    reports.clusters_to_txt(model.vocabularies[0], str(tmp_path / "c.txt"))
    assert "duty (2), tariff (1)" in (tmp_path / "c.txt").read_text()
    reports.save_model(model, str(tmp_path / "m"), spark)
    again = reports.load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.predict(s).collect()), key=repr) == sorted(map(tuple, model.predict(s).collect()), key=repr)
    assert again.selection_metric(spark).count() == 2 and {r["phrase"] for r in again.inspect_cluster("duty").collect()} == {"duty", "tariff"}
    assert model.selection_metric(spark).count() == 2


def blobs(spark, dims=12, each=40):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (each, dims)) for c in (0, 3, 6)])
    return x, spark.createDataFrame([(f"w{i}", v.tolist()) for i, v in enumerate(x)], "token string, vec array<double>")


@pytest.mark.parametrize("options", [{"clustering": "hdbscan", "pca": False}, {"clustering": "hdbscan", "umap": True}, {"clustering": "kmeans", "umap": True, "pca": False}])
def test_saved_models_predict(spark, tmp_path, options):
    """Density clusters and UMAP on three groups of words: fit, predict phrases known and new, save, load, predict the same."""
    _, table = blobs(spark)
    s = spark.createDataFrame([(f"w{i}", "do", f"w{(i * 7) % 110}") for i in range(110)], "arg0 string, verb string, arg1 string")
    args = [{"min_cluster_size": 15, "min_samples": 5}] if options["clustering"] == "hdbscan" else [{"n_clusters": 3, "random_state": 1}]
    model = NarrativeModel(roles_considered=["arg0", "verb", "arg1"], roles_with_known_entities=[], roles_with_unknown_entities=["arg0", "arg1"], backend=embeddings.WordVectors(table, normalize=False), **options)
    model.fit(s, pca_args={"n_components": 5}, cluster_args=args, umap_args={"n_epochs": 150})
    new = spark.createDataFrame([(f"w{i}", "do", None) for i in range(120)], s.schema)
    named = {r["phrase"]: r["label"] for r in model._unknown(new.selectExpr("arg0 as phrase"), None).collect()}
    groups = [{named.get(f"w{i}") for i in range(a, a + 40)} - {None} for a in (0, 40, 80)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and len(named) > 100
    model.save(str(tmp_path / "m"), spark)
    again = NarrativeModel.load(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, again.predict(new).collect()), key=repr) == sorted(map(tuple, model.predict(new).collect()), key=repr)


def test_umap():
    a, b = manifold.curve(0.1)
    assert (a, b) == pytest.approx((1.577, 0.895), abs=0.01)  # as published for a least distance of 0.1
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.3, (60, 12)) for c in (0, 3, 6)])
    fitted = manifold.fit(x, n_epochs=200)
    label = np.repeat([0, 1, 2], 60)
    at, _ = manifold.nearest(fitted.places, fitted.places, 6)
    assert (label[at[:, 1:]] == label[:, None]).mean() > 0.98
    assert np.allclose(fitted.transform(x), fitted.places)
    at, _ = manifold.nearest(fitted.transform(x + 0.05), fitted.places, 1)
    assert (label[at[:, 0]] == label).mean() > 0.98
    assert np.allclose(manifold.fit(x, n_epochs=20).places, manifold.fit(x, n_epochs=20).places)
    assert manifold.fit(np.ones((40, 3)), n_epochs=5).places.shape == (40, 2) and manifold.fit(x[:1]).places.shape == (1, 2)
    with pytest.raises(ValueError):
        manifold.fit(np.zeros((manifold.MOST_POINTS + 1, 1)))


def test_pca(spark):
    x, table = blobs(spark)
    _, reduce = clustering.pca(table, 3)
    got = {r["token"]: r["vec"] for r in reduce(table).collect()}
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = x @ v[:3].T
    have = np.array([got[f"w{i}"] for i in range(len(x))])
    assert np.allclose(np.abs(have), np.abs(want), atol=1e-6)


def test_graph_of_all_edges_is_bounded(spark, monkeypatch):
    s = spark.createDataFrame([(f"a{i}", "v", f"b{i}") for i in range(4)], "arg0 string, verb string, arg1 string")
    assert len(graph.build_graph(s, None, prune_network=False).edges) == 4
    monkeypatch.setattr(graph, "MOST_EDGES", 3)
    with pytest.raises(ValueError):
        graph.build_graph(s, None)


def test_batches_of_long_documents(spark):
    texts = ["x" * (i * 7 % 23) for i in range(5000)]
    want, run, batch = [], 0, 0
    for t in texts:
        if run + len(t) > 40:
            run, batch = 0, batch + 1
        run += len(t)
        want.append(batch)
    assert spark.createDataFrame([(texts,)], "t array<string>").select(X.batch_numbers(F.col("t"), 40)).first()[0] == want


def test_lexicon_files(spark, tmp_path):
    spark.createDataFrame([("kill", 0, "destroy")], "verb string, pos int, candidate string").write.csv(str(tmp_path / "l"), header=True)
    assert [tuple(r) for r in verbs.lexicon_file(spark, str(tmp_path / "l")).collect()] == [("kill", 0, "destroy")]
    data = ["00000100 30 v 02 rise 0 go_up 0 002 ! 00000200 v 0101 @ 00000300 v 0000 01 + 02 00 | become higher", "00000200 30 v 01 fall 0 001 ! 00000100 v 0101 01 + 02 00 | become lower", "00000300 30 v 01 move 0 000 00 | move"]
    index = ["go_up v 1 0 1 0 00000100", "rise v 2 2 ! @ 2 1 00000100 00000300", "fall v 1 1 ! 1 0 00000200", "move v 1 0 1 0 00000300"]
    (tmp_path / "data.verb").write_text("  1 licence\n" + "\n".join(data) + "\n")
    (tmp_path / "index.verb").write_text("  1 licence\n" + "\n".join(index) + "\n")
    same, other = verbs.wordnet_lexicons(spark, str(tmp_path))
    assert sorted(map(tuple, same.where("verb in ('rise', 'go up')").collect())) == [("go up", 0, "rise"), ("go up", 1, "go up"), ("rise", 0, "rise"), ("rise", 1, "go up"), ("rise", 2, "move")]
    assert sorted(map(tuple, other.collect())) == [("fall", 0, "rise"), ("rise", 0, "fall")]


def test_vector_files_and_kinds(spark, tmp_path):
    (tmp_path / "v.txt").write_text("2 3\nno 1 0 0.5\nworld 0 1 -1e-1\n")
    table = embeddings.read_vectors(spark, str(tmp_path / "v.txt"))
    assert {r["token"]: r["vec"] for r in table.collect()} == {"no": [1.0, 0.0, 0.5], "world": [0.0, 1.0, -0.1]}
    got = embeddings.embeddings("GensimPretrained", table, normalize=False).vectors(spark.createDataFrame([("no world",)], "phrase string")).first()["vec"]
    assert got == pytest.approx([0.5, 0.5, 0.2])
    with pytest.raises(ValueError):
        embeddings.embeddings("GensimPretrained", table, sentences=table)


def test_other_files(spark, tmp_path):
    sents = spark.createDataFrame([(1, 0, 'Say "no", now.'), (1, 1, "Go")], "doc_id long, sent_id int, sentence string")
    for fmt in ("parquet", "csv"):
        files.save_sentences(sents, str(tmp_path / fmt), fmt)
    assert sorted(r["sentence"] for r in spark.read.parquet(str(tmp_path / "parquet")).collect()) == sorted(r[0] for r in sents.select("sentence").collect())
    assert sorted(r["sentence"] for r in spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()) == ["Go", 'Say "no", now.']
    counts = spark.createDataFrame([("Paris", 3)], "value string, cnt long")
    files.save_entities(counts, str(tmp_path / "e"))
    assert [tuple(r) for r in files.load_entities(spark, str(tmp_path / "e")).collect()] == [("Paris", 3)]
    (tmp_path / "s.json").write_text('["One here.", "Two"]')
    assert [tuple(r) for r in files.load_data(spark, str(tmp_path / "s.json"), "sentences").collect()] == [(0, "One here."), (1, "Two")]
    (tmp_path / "p.json").write_text('[{"words": ["a", "b"], "verbs": [{"tags": ["B-ARG0", "B-V"]}]}, {"words": [], "verbs": []}]')
    parses = files.load_data(spark, str(tmp_path / "p.json"), "srl_res")
    files.save_parses(parses, str(tmp_path / "q"))
    assert parses.count() == 2 and spark.read.schema(parses.schema).json(str(tmp_path / "q")).where("size(words) = 2").first()["verbs"][0]["tags"] == ["B-ARG0", "B-V"]
    with pytest.raises(ValueError):
        files.load_data(spark, "x", "other")


def test_labelled_entities_and_points(spark):
    s = spark.createDataFrame([([("Paris", "GPE"), ("Monday", "DATE"), ("Paris", "GPE")],)], "ents array<struct<text: string, label: string>>")
    assert [tuple(r) for r in counting.mine_entities(s, F.col("ents")).collect()] == [("Paris", 2)]


@pytest.mark.parametrize("options", [{"clustering": "dynamic"}, {"roles_with_known_entities": ["verb"]}, {"assignment_to_known_entities": "x"}, {"roles_considered": ["arg0"]}])
def test_model_refuses(options):
    with pytest.raises(ValueError):
        NarrativeModel(**options)


def test_files_and_reports(spark, tmp_path):
    s = spark.createDataFrame([("a", "v", True, None, "b", None), (None,) * 6], "arg0 string, verb string, neg boolean, mod string, arg1 string, arg2 string")
    files.save_roles(s, str(tmp_path / "roles"))
    assert sorted(map(tuple, files.load_roles(spark, str(tmp_path / "roles")).collect()), key=repr) == sorted(map(tuple, s.collect()), key=repr)
    (tmp_path / "raw.csv").write_text('id,doc\n1,"two\nlines, ""quoted"""\n')
    assert files.load_data(spark, str(tmp_path / "raw.csv")).first()["doc"] == 'two\nlines, "quoted"'
    assert files.list_data(spark).count() == 2
    page = reports.draw_graph(graph.Graph([("a", "b", "v", 1)], {"a": 1, "b": 1}), str(tmp_path / "g.html"))
    assert '"a"' in open(page).read() and "range" not in open(page).read()
    for options, controls in (({"show_buttons": True}, 2), ({"show_buttons": True, "only_physics_buttons": True}, 1)):
        assert open(reports.draw_graph(graph.Graph([], {}), str(tmp_path / "g.html"), **options)).read().count('type="range"') == controls
    log = reports.FileLogger(str(tmp_path / "l.txt"))
    with pytest.raises(RuntimeError):
        reports.FileLogger(str(tmp_path / "m.txt"))
    log.close()
    reports.FileLogger(str(tmp_path / "m.txt")).close()


def test_stream_equals_table(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Taxes are bad. Jobs are not good.", "en", "s", 30), (2, "Rien.", "fr", "s", 5)], streaming.DOCUMENTS)
    docs.write.parquet(str(tmp_path / "in"))
    q = streaming.statement_stream(streaming.read_documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("stream_test").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(r["text"] for r in spark.sql("select text from stream_test").collect())
    assert got == ["jobs ! are not good", "taxes are bad"]
    assert statements.lexicon_statements(docs).count() == 2


def test_character_matching_by_brute_force(spark):
    names = ["the bank", "bank", "of the of", "a b", "a", None, " ", "interest rate policy", "rate"]
    said = ["the bank of a rate", "interest on policy rate", "b a", "", "of", "of the", "banks", "  a  bank ", "a", None]
    found = entities.character_matching(spark.createDataFrame([(p,) for p in said + said], "phrase string"), entities.entity_table(spark, names))
    want = {p: "|".join(e for e in names if e and e.split() and set(e.split()) <= set(p.split())) for p in said if p}
    assert sorted(map(tuple, found.collect())) == sorted((p, label) for p, label in want.items() if label)
    assert entities.character_matching(spark.createDataFrame([("a",)], "phrase string"), entities.entity_table(spark, None)).count() == 0
