"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled to three machines.  The normaliser rewrites the longest match of the
model's character map (if it has one), then white space: a dummy prefix, runs to one if the model
says so.  The lexicon spells pieces, and its final states carry the piece and its weight.  Byte
fallback spells a character that is no piece as its UTF-8 bytes.  An input is composed with them, to a
lattice of (place, last piece) that is built as far as the search goes, and the path of least weight in
the tropical semiring is the encoding.  Inside the machines a blank stands for U+2581.

Weights.  In a unigram model an arc weighs minus the piece's log probability, and the search is over
all places in order.  In a BPE model piece scores are merge ranks, and the path of least summed score
is not what merging gives; there an arc weighs 0 if the piece may follow the last one, else infinity.
It may if merging the two pieces' characters gives back just the two; these arcs are compiled when first
asked for.  A sequence in which every piece may follow the one before is the merge result, and the only
such sequence, of each prefix as well.  So a path of weight 0 exists and is unique, a place has one last
piece, and the search takes longer arcs first and goes back from places without a way on.

Pieces never span certain borders (before a run of blanks, around characters that are in no longer
piece), which is checked when compiling.  The lattice falls apart there, and the paths of its parts,
with the bytes that they spell, are cached in a bounded cache of two generations.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabula.llm import _exchange as X
from fabula.llm import _grams as G

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts of the lattice kept in each generation of a worker's cache.
CACHE_PARTS = 300_000
#: Arcs between pieces kept.
CACHE_ARCS = 2_000_000
#: What a character that no piece spells costs beyond the worst piece, in a unigram model.
RARE = 10.0
_START = -1  # before the first piece; a character without a piece is -2 - its code point


@dataclass(frozen=True)
class Spec:
    pieces: tuple[tuple[str, float, int], ...]
    kind: int
    dummy_prefix: bool
    squeeze: bool
    byte_fallback: bool
    char_map: bytes = b""


def _fields(b: bytes):
    """(number, value) of a protocol buffer message: integers, or bytes."""
    i = 0

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            c = b[i]
            out |= (c & 127) << shift
            i, shift = i + 1, shift + 7
            if c < 128:
                return out, i

    while i < len(b):
        tag, i = varint(i)
        wire = tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            n, i = varint(i)
            value, i = b[i : i + n], i + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, i = b[i : i + n], i + n
        else:
            raise ValueError("not a model file")
        yield tag >> 3, value


def read_model(data: bytes) -> Spec:
    """Pieces and options of a model file."""
    pieces, trainer, normaliser = [], {}, {}
    for number, value in _fields(data):
        if number == 1:
            p = dict(_fields(value))
            pieces.append((p[1].decode(), float(np.frombuffer(p.get(2, b"\0\0\0\0"), "<f4")[0]), p.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    kind = trainer.get(3, UNIGRAM)
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if not normaliser.get(5, 1) or any(t == USER for _, _, t in pieces):
        raise ValueError("models with unescaped white space or user-defined pieces are not supported")
    return Spec(tuple(pieces), kind, bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(trainer.get(35, 0)), bytes(normaliser.get(2, b"")))


class Normaliser:
    """Rewrites text by the longest match of the character map, then blanks by the model's options."""

    def __init__(self, spec: Spec) -> None:
        self.spec, self.rules, self.longest = spec, {}, 0
        if spec.char_map:
            self.rules = read_char_map(spec.char_map)
            self.longest = max(map(len, self.rules), default=0)
            self.first = {c[0] for c in self.rules}

    def __call__(self, text: str) -> str:
        if self.rules:
            text = self._mapped(text)
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.spec.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return " " + text if self.spec.dummy_prefix and text else text

    def _mapped(self, text: str) -> str:
        out, i, n = [], 0, len(text)
        while i < n:
            if text[i] in self.first:
                for j in range(min(n, i + self.longest), i, -1):
                    to = self.rules.get(text[i:j])
                    if to is not None:
                        out.append(to)
                        i = j
                        break
                else:
                    out.append(text[i])
                    i += 1
            else:
                out.append(text[i])
                i += 1
        return "".join(out)


def read_char_map(data: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie of 32-bit units, then its strings, each ended by a zero byte."""
    size = int.from_bytes(data[:4], "little")
    unit, strings = np.frombuffer(data, "<u4", size // 4, 4).tolist(), data[4 + size :]

    def below(at: int) -> int:
        return at ^ (unit[at] >> 10 << ((unit[at] & 512) >> 6))

    steps: dict[int, list[tuple[int, int]]] = {}
    for at, u in enumerate(unit):
        if u >> 31 == 0 and u & 255:
            steps.setdefault(at ^ u & 255, []).append((u & 255, at))
    rules: dict[str, str] = {}
    todo = [(0, b"")]
    while todo:
        at, key = todo.pop()
        base = below(at)
        if at and unit[at] >> 8 & 1:
            begin = unit[base] & 0x7FFFFFFF
            rules[key.decode("utf-8", "replace")] = strings[begin : strings.index(b"\0", begin)].decode("utf-8", "replace")
        todo += [(child, key + bytes([byte])) for byte, child in steps.get(base, ())]
    return rules


class Transducer:
    """Compiled model: encode texts to ids, decode ids to texts."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        self.normalise = Normaliser(spec)
        self.score = [s for _, s, _ in spec.pieces]
        self.text = [p.replace(SPACE, " ") for p, _, _ in spec.pieces]
        self.id = {self.text[i]: i for i, (_, _, t) in enumerate(spec.pieces) if t in (NORMAL, USER, UNUSED)}
        self.rare = RARE - min((self.score[i] for i in self.id.values()), default=0.0)
        self.unknown = next(i for i, (_, _, t) in enumerate(spec.pieces) if t == UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(spec.pieces) if t == BYTE} if spec.byte_fallback else {}
        self.out = [b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() for p, _, t in spec.pieces]
        self.trie = _trie(self.id)
        self.size = [len(t) for t in self.text]
        self.shorter = [next((self.id[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.id), None) for t in self.text]
        self.bytes = np.frombuffer(b"".join(self.out), np.uint8)
        self.widths = np.array([len(x) for x in self.out])
        self.begins = np.cumsum(self.widths) - self.widths
        self.arcs: dict[int, dict[int, bool]] = {}
        self.known = 0
        self.new, self.old = _Cache(self), _Cache(self)
        self.parts = self._borders()

    def _borders(self) -> re.Pattern | None:
        """Splits normalised text where no piece can span, None if pieces span everywhere."""
        longer = [p for p in self.id if len(p) > 1]
        if any(re.search("[^ ] ", p) for p in longer):
            return None
        inside = set("".join(longer))
        alone = "".join(c for c in "\n\t\r" if c not in inside)
        return re.compile(f"[{alone}]| *[^ {alone}]+| +" if alone else " *[^ ]+| +")

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids of the best path (int32), and the normalised text."""
        s = self.normalise(text)
        parts = self.parts.findall(s) if self.parts else [s] if s else []
        ids = b"".join(map(self.new.__getitem__, parts))
        if len(self.new) > CACHE_PARTS:
            self.old, self.new = self.new, _Cache(self)
        return (ids if self.byte else self._one_unknown(ids)), s

    def _one_unknown(self, ids: bytes) -> bytes:
        """A run of unknown characters is one unknown piece."""
        a = np.frombuffer(ids, np.int32)
        return a[np.r_[True, (a[1:] != self.unknown) | (a[:-1] != self.unknown)]].tobytes() if len(a) else ids

    def rest(self) -> None:
        """Between tasks: keeps the compiled machine and the parts met first, which are the common ones."""
        self.old, self.new = dict(itertools.islice(self.new.items(), CACHE_PARTS // 5)), _Cache(self)

    def spells(self, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> np.ndarray:
        """Whether each sequence of ids (up to its end) spells its normalised text."""
        spelled = self.bytes[G.expand(self.begins[ids], self.widths[ids])]
        at = np.r_[0, np.cumsum(self.widths[ids])][np.r_[0, ends]]
        raw = [t.encode() for t in texts]
        same = np.diff(at) == np.fromiter(map(len, raw), np.int64, len(raw))
        if same.all():
            wrong = np.flatnonzero(spelled != np.frombuffer(b"".join(raw), np.uint8))
            same[np.searchsorted(at, wrong, side="right") - 1] = False
            return same
        return np.array([spelled[a:b].tobytes() == r for a, b, r in zip(at[:-1], at[1:], raw, strict=True)], bool)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.out.__getitem__, ids))
        return (raw[1:] if self.spec.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def path(self, s: str) -> list[int]:
        """Ids on the path of least weight through the lattice of a part."""
        out: list[int] = []
        for x in self._free(s) if self.spec.kind == BPE else self._lightest(s):
            if x >= 0:
                out.append(x)
            else:
                out += self.fallback(chr(-2 - x))
        return out

    def _free(self, s: str) -> list[int]:
        """The path of weight 0: longer arcs first, back from places without a way on."""
        n, trie, arcs, size, shorter = len(s), self.trie, self.arcs, self.size, self.shorter
        places, path, dead = [], [_START], set()
        i, piece = 0, None
        while i < n:
            if piece is None:  # the longest arc from i
                node, piece = trie, -2 - ord(s[i])
                for c in s[i:]:
                    step = node.get(c)
                    if step is None:
                        break
                    found, node = step
                    if found is not None:
                        piece = found
            before = path[-1]
            row = arcs.get(before)
            if row is None:
                row = arcs[before] = {}
            while piece is not None:
                free = row.get(piece)
                if free is None:
                    free = row[piece] = self._fits(before, piece)
                    self.known += 1
                j = i + (size[piece] if piece >= 0 else 1)
                if free and j not in dead:
                    break
                piece = self._next(piece, s[i])
            if piece is not None:
                places.append(i)
                path.append(piece)
                i, piece = j, None
            elif places:  # no way on from i
                dead.add(i)
                i = places.pop()
                piece = self._next(path.pop(), s[i])
                while piece is None and places:
                    dead.add(i)
                    i = places.pop()
                    piece = self._next(path.pop(), s[i])
            else:
                raise RuntimeError("the lattice has no path")
        if self.known > CACHE_ARCS:
            arcs.clear()
            self.known = 0
        return path[1:]

    def _next(self, piece: int, c: str) -> int | None:
        """The next shorter arc where c begins: a piece, or c alone if it is no piece."""
        if piece < 0:
            return None
        found = self.shorter[piece]
        return -2 - ord(c) if found is None and self.size[piece] > 1 else found

    def _lightest(self, s: str) -> list[int]:
        """Path of least weight; on equal weights the first found."""
        n, score = len(s), self.score
        weight = [float("inf")] * (n + 1)
        last, back = [_START] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for i in range(n):
            node, j, alone = self.trie, i, False
            while j < n:
                step = node.get(s[j])
                if step is None:
                    break
                j += 1
                piece, node = step
                if piece is not None:
                    alone = alone or j == i + 1
                    if weight[i] - score[piece] < weight[j]:
                        weight[j], last[j], back[j] = weight[i] - score[piece], piece, i
            if not alone and weight[i] + self.rare < weight[i + 1]:
                weight[i + 1], last[i + 1], back[i + 1] = weight[i] + self.rare, -2 - ord(s[i]), i
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _fits(self, before: int, piece: int) -> bool:
        b = self.text[piece] if piece >= 0 else chr(-2 - piece)
        if before == _START:
            return self.merge(b) == [b]
        a = self.text[before] if before >= 0 else chr(-2 - before)
        return self.merge(a + b) == [a, b]

    def merge(self, s: str) -> list[str]:
        """Merges the neighbours whose joint piece has the highest score, the leftmost of equals, until none has one."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.id.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts


def _trie(pieces: dict[str, int]) -> dict:
    """Steps by character: the piece that ends there (or None), and the steps on."""
    root: dict = {}
    for text in sorted(pieces):  # a prefix before what it begins
        node = root
        for c in text[:-1]:
            node = node.setdefault(c, (None, {}))[1]
        node[text[-1]] = (pieces[text], node.get(text[-1], (None, {}))[1])
    return root


class _Cache(dict):
    """Ids of parts seen lately."""

    def __init__(self, machine: Transducer) -> None:
        self.machine = machine

    def __missing__(self, part: str) -> bytes:
        ids = self.machine.old.get(part)
        if ids is None:
            ids = array("i", self.machine.path(part)).tobytes()
        if len(part) <= 64:
            self[part] = ids
        return ids


_COMPILED: dict[bytes, Transducer] = {}


def compiled(model: bytes) -> Transducer:
    """The transducer of a model file's bytes, one for each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(read_model(model))
    return _COMPILED[key]


def _encoded(model, check: bool, columns: list[str]):
    def encoded(batches):
        machine = compiled(model.value)
        for batch in batches:
            _, off = G.text_buffer(batch["text"])
            for a, b in G.slices(off, 1 << 20):
                part = batch.slice(a, b - a)
                found = [machine.encode(text or "") for text in part["text"].to_pylist()]
                raw = b"".join([ids for ids, _ in found])
                sizes = np.array([len(ids) for ids, _ in found], np.int64) // 4
                ends = np.cumsum(sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.Array.from_buffers(pa.int32(), len(raw) // 4, [None, pa.py_buffer(raw)]))
                out = [part[c] for c in columns] + [pa.array(sizes), lists]
                if check:
                    out.append(pa.array(machine.spells(np.frombuffer(raw, np.int32), ends, [text for _, text in found])))
                yield pa.RecordBatch.from_arrays(out, [*columns, "n_tokens", "token_ids", *["lossless"] * check])
        machine.rest()

    return lambda batches: X.tidy(encoded(batches))


def encode(df: DataFrame, model_path: str, text_col: str = "text", *, carry: list[str] = ("doc_id",), check: bool = False) -> DataFrame:
    """The carried columns, n_tokens and token_ids of each text; with check also lossless: decoding gives the normalised text back.

    The model file is read by the driver and broadcast (its size is the vocabulary's, not the data's).
    Defined cases: a null or empty text has no tokens; a text of any length is encoded whole; U+2581
    in a text decodes to a space, as the format has it.  A carried column with the name of a result
    column is left out.
    """
    X.bounded_batches(df)
    carry = X.result_first(carry, ["n_tokens", "token_ids", "lossless"])
    with open(model_path, "rb") as file:
        data = file.read()
    read_model(data)  # refuses on the driver what the workers can't do
    model = df.sparkSession.sparkContext.broadcast(data)
    names = [f"c{i}" for i in range(len(carry))]
    schema = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in zip(names, carry, strict=True)] + [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType()))] + [T.StructField("lossless", T.BooleanType())] * check)
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.mapInArrow(_encoded(model, check, names), schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carry, strict=True)], "n_tokens", "token_ids", *["lossless"] * check)


def decode(df: DataFrame, model_path: str, ids_col: str = "token_ids", text_col: str = "text") -> DataFrame:
    """Adds (or replaces) text_col: the text that the ids spell; null ids give null."""
    with open(model_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf("string")
    def spelled(column: pd.Series) -> pd.Series:
        machine = compiled(model.value)
        return column.map(lambda ids: None if ids is None else machine.decode(list(ids)))

    return df.withColumn(text_col, spelled(F.col(ids_col)))
