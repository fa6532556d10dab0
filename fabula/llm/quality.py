"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

Terms are words (A-Z folded, hashed to WORDS places), pairs of neighbouring character classes (letters by
case, digits, white space, every ASCII punctuation mark, other bytes), words repeated at once and lines
repeated in the text; so the score looks at what a text says and at its form, in any language.  Term counts are weighted (log tf x idf) and projected on
the leading singular vectors of a bounded labelled sample.  The labelled vectors are broadcast, each
document's cosine with all of them is computed exactly in blocks, and the nearest ones vote for their
label with their similarity, weighted by the share of their class among all labels.

Bounds: at most `per_class` labelled rows a class are fitted, whatever the size of the corpus, so the
broadcast model has about 2 x per_class x (dims + 2) + terms x dims floats (under 2 MB by default).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fabula.llm import _exchange as X
from fabula.llm import _grams as G

_PUNCTUATION = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS = np.zeros(256, np.int64)
for _first, _last, _kind in ((0x00, 0x20, 6), (0x20, 0x21, 4), (0x30, 0x3A, 3), (0x41, 0x5B, 2), (0x61, 0x7B, 1), (0x7F, 0x80, 6), (0x80, 0xC0, 7), (0xC0, 0x100, 8)):
    _CLASS[_first:_last] = _kind
_CLASS[0x0A] = 5
_CLASS[_PUNCTUATION] = 9 + np.arange(len(_PUNCTUATION))
_KINDS = 9 + len(_PUNCTUATION)
PAIRS = _KINDS * _KINDS
#: Places of hashed words.
WORDS = 512
#: Pairs of classes, repeated words, repeated lines, words.
FORM = PAIRS + 2
TERMS = FORM + WORDS
#: Repetition is one term each among hundreds; it counts as so many.
_REPEAT_WEIGHT = 3.0
#: A word counts as so much of a pair of classes, of which a text has many more.
_WORD_WEIGHT = 0.25
_SLICE = 1 << 20
_BLOCK = 1024


def term_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """documents x TERMS, float32."""
    n = len(off) - 1
    out = np.zeros((n, TERMS), np.float32)
    if len(buf) == 0:
        return out
    kind = _CLASS[buf]
    doc = np.repeat(np.arange(n), np.diff(off))
    same = doc[1:] == doc[:-1]
    pair = (doc[:-1] * PAIRS + kind[:-1] * _KINDS + kind[1:])[same]
    at, count = np.unique(pair, return_counts=True) if n > 64 else (None, np.bincount(pair, minlength=n * PAIRS))
    if at is None:
        out[:, :PAIRS] = count.reshape(n, PAIRS)
    else:
        out[at // PAIRS, at % PAIRS] = count
    starts, ends, of = G.words(buf, off)
    w = G.word_hashes(G.FOLD[buf], starts, ends)
    np.add.at(out, (of, FORM + (w % np.uint64(WORDS)).astype(np.int64)), 1)
    again = (w[1:] == w[:-1]) & (of[1:] == of[:-1])
    out[:, PAIRS] = np.bincount(of[1:][again], minlength=n)
    raw = buf.tobytes()
    for d, (i, j) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        lines = [x for x in raw[i:j].split(b"\n") if x]
        out[d, PAIRS + 1] = len(lines) - len(set(lines))
    return out


def _blocks(off: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of documents, bounded in bytes and in number, as their counts are dense."""
    return [(i, min(b, i + _BLOCK)) for a, b in G.slices(off, _SLICE) for i in range(a, b, _BLOCK)]


@dataclass(frozen=True)
class Model:
    """idf by term, projection (terms x dims), labelled vectors (unit rows), labels, class weights, share of label 1."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    neighbours: int

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(self.weigh(counts) @ self.projection)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the weighted vote of the nearest; the prior where nothing is similar.

        Of equally near rows at the edge any may vote (which, may depend on the block's rounding)."""
        out = np.full(len(counts), self.prior)
        k = min(self.neighbours, len(self.labels))
        for i in range(0, len(counts) if k else 0, _BLOCK):
            cosine = self.embed(counts[i : i + _BLOCK]) @ self.vectors.T
            nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            vote = np.maximum(np.take_along_axis(cosine, nearest, 1), 0) * self.weights[nearest]
            total = vote.sum(1)
            some = total > 1e-9
            out[i : i + _BLOCK][some] = ((vote * self.labels[nearest]).sum(1)[some] / total[some]).clip(0, 1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_vectors(y: np.ndarray, dims: int, rounds: int = 10) -> np.ndarray:
    """The leading right singular vectors (terms x dims) by subspace iteration, which needs no terms x terms matrix."""
    basis = np.random.default_rng(7).standard_normal((y.shape[1], min(y.shape[1], dims + 32))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(y.T @ (y @ basis))
    _, _, v = np.linalg.svd(y @ basis, full_matrices=False)
    return basis @ v[:dims].T


def fit_model(counts: np.ndarray, labels: np.ndarray, shares: dict[int, float], dims: int, neighbours: int) -> Model:
    if len(labels) == 0:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, dims), np.float32), np.empty((0, dims), np.float32), labels, np.empty(0), 0.5, neighbours)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    idf[PAIRS:FORM] *= _REPEAT_WEIGHT
    idf[FORM:] *= _WORD_WEIGHT
    y = np.log1p(counts)
    y *= idf
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    projection = leading_vectors(y, dims)
    weights = np.array([shares[int(c)] / max(1, int((labels == c).sum())) for c in labels]) * len(labels)
    return Model(idf, projection, _unit(y @ projection), labels.astype(np.float64), weights, shares.get(1, 0.0), neighbours)


def _counted(batches):
    for batch in batches:
        buf, off = G.text_buffer(batch["text"])
        for a, b in _blocks(off):
            rows = term_counts(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            packed = [np.flatnonzero(r).astype("<u2").tobytes() + r[r != 0].tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch["id"].slice(a, b - a), batch["label"].slice(a, b - a), pa.array(packed, pa.binary())], ["id", "label", "counts"])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, per_class: int = 1500, dims: int = 64, neighbours: int = 25) -> Model:
    """Fits on at most per_class labelled documents of each label (those whose ids hash lowest).

    Labels are 0 and 1; other and null labels, null ids and labels without a document are left out;
    an id that is labelled or written twice counts once (its smallest label, its first text in order)."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(shares.values())
    picked = [known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    sample = picked[0].union(picked[1])
    texts = documents.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = documents.schema[id_col].dataType.simpleString()
    X.bounded_batches(documents)
    least = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = least.mapInArrow(_counted, f"id {kind}, label int, counts binary")
    found = sorted(((r["id"], r["label"], bytes(r["counts"])) for r in rows.collect()), key=lambda r: r[0])
    counts = np.zeros((len(found), TERMS), np.float32)
    for row, (_, _, c) in zip(counts, found, strict=True):
        n = len(c) // 6
        row[np.frombuffer(c, "<u2", n)] = np.frombuffer(c, "<f4", n, 2 * n)
    return fit_model(counts, np.array([x for _, x, _ in found], np.int64), {c: n / total for c, n in shares.items()}, dims, neighbours)


def _scored(model, text: str, columns: int):
    def scored(batches):
        for batch in batches:
            buf, off = G.text_buffer(batch[text])
            scores = [model.value.score(term_counts(buf[off[a] : off[b]], off[a : b + 1] - off[a])) for a, b in _blocks(off)]
            score = pa.array(np.concatenate([np.empty(0), *scores]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], score], [*batch.schema.names[:columns], "score"])

    return lambda batches: X.tidy(scored(batches))


def score(documents: DataFrame, model: Model, text_col: str = "text", *, carry: list[str] = ("doc_id",), score_col: str = "score") -> DataFrame:
    """The carried columns and score (0 to 1) of each document; a null or empty text gets the share of label 1.

    A carried column named like the score is left out; `score_col` gives the score another name."""
    X.bounded_batches(documents)
    carry = X.result_first(carry, [score_col])
    names = [f"c{i}" for i in range(len(carry))]
    rows = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)])
    text = names[list(carry).index(text_col)] if text_col in carry else "text"
    if text == "text":  # else it is carried already
        rows = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(f"`{text_col}`").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"{n} {documents.schema[c].dataType.simpleString()}" for n, c in zip(names, carry, strict=True)), "score double"])
    out = rows.mapInArrow(_scored(shared, text, len(names)), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], F.col("score").alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Rows that are kept from fitting."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
