"""The other corpus operators, with odd rows; queries against SQL; the pipeline."""

import hashlib
import os
import random
import struct
import time
import zlib

import duckdb
import numpy as np
import pytest

from fabula.llm import html_text, media, quality
from fabula.llm.queries import TOKENIZER, queries, oracle_sql
from fabula.llm.sentencepiece_wfst import Transducer, _fields, decode, encode, read_char_map, read_model
from fabula.llm.sharding import kd_shards
from fabula.llm.url_filters import Rule, split_url, url_filter

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"


def odd(n: int = 50) -> list[tuple]:
    rows = [(i, f"text {i} " * (i % 7 + 1), "en", "hot" if i % 3 else f"s{i}", i, 1, "x") for i in range(n)]
    return rows + [(1000, None, None, None, None, None, None), (None, "x", "en", "hot", 1, 1, "x"), (1001, "", "", "", 0, 0, ""), (1001, "", "", "", 0, 0, ""), (1002, "long " * 50_000, "en", "hot", 9, 1, "x")]


def test_sharding(spark):
    got = kd_shards(spark.createDataFrame(odd(600), SCHEMA), shards=8).toPandas()
    assert len(got) == 605
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    rest = kd_shards(spark.createDataFrame(odd(600)[:-1], SCHEMA), shards=8).toPandas().groupby("shard")["size"].sum()
    assert len(rest) == 8 and rest.max() - rest.min() < 300
    again = kd_shards(spark.createDataFrame(odd(600), SCHEMA), target_bytes=int(got["size"].sum()) // 8 + 1).toPandas()
    assert again.fillna(-1).sort_values(["shard", "slot"]).values.tolist() == got.fillna(-1).sort_values(["shard", "slot"]).values.tolist()
    one = got[got.doc_id == 3].iloc[0]
    assert one["size"] == len("text 3 " * 4) + 16 and one["text_crc32"] == zlib.crc32(("text 3 " * 4).encode())
    assert kd_shards(spark.createDataFrame([], SCHEMA), shards=8).count() == 0


def test_sharding_of_repeated_rows(spark):
    rows = [(i, f"text {i}", "en", "s", i, 1, "x") for i in range(400)] + [(7000, "again and again", "en", "hot", 5, 1, "x")] * 400 + [(None, None, None, None, None, None, None)] * 100
    got = kd_shards(spark.createDataFrame(rows, SCHEMA), shards=8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and len(sums) == 8 and sums.max() - sums.min() <= 8 * 33
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])


@pytest.mark.parametrize("query_shards", [40])
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_sharding_laws(spark, query_shards):
    """Sizes, checksums, slots and near-equal sums against the table itself."""
    got = queries()["op2_sharding"](spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id")
    raw = docs["text"].map(lambda t: (t or "").encode())
    assert got.index.is_unique and set(got.index) == set(docs.index)
    assert (got["size"].sort_index() == raw.map(len).sort_index() + 16).all() and (got["text_crc32"].sort_index() == raw.map(zlib.crc32).sort_index()).all()
    assert set(got["shard"]) <= set(range(query_shards)) and all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 6 * got["size"].max() / 2 + 6  # half a row for each of six levels


@pytest.mark.parametrize(("url", "want"), [(None, ("", "")), ("x.org/a", ("", "")), ("http://A.Org/B?c#d", ("a.org", "/B")), ("http://a.org#d/e", ("a.org", "")), ("http://a.org?x://y", ("a.org", ""))])
def test_split_url(url, want):
    assert split_url(url) == want


def test_url_filter(spark):
    rules = [Rule("allow", "org", "/"), Rule("block", "a.org", "/x")]
    urls = ["http://b.a.org/xy", "http://ba.org/xy", "http://a.org/", "http://casino.net/", "http://mycasino.net/", "http://free-win.net/", "http://free.net/free", None, "", "casino"]
    got = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=rules).orderBy("page_id").collect()
    assert [r["verdict"] for r in got] == ["block", "allow", "allow", "block", "allow", "block", "allow", "allow", "allow", "block"]
    assert [r["rule"] for r in got][:4] == ["a.org/x", "org/", "org/", None]


def test_quality(spark):
    rows = [(i, ("Good words stand here. " if i % 2 else "BAD!! WORDS!! ") * (i % 5 + 1), 0) for i in range(200)] + [(900, None, 0), (901, "", 0), (None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5000, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels.where(~quality.held_out()))
    got = quality.score(docs, model).toPandas()
    known = got[got.doc_id < 200]
    assert ((known.score >= 0.5) == (known.doc_id % 2 == 1)).all() and got.score.between(0, 1).all() and len(got) == 203
    empty = quality.fit(docs.limit(0), labels.limit(0))
    assert set(quality.score(docs, empty).toPandas().score) == {0.5}


def test_media(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "é" * 400, "abc\n" * 90_000, "\x00\x01"])]
    stored = media.texts_to_media(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in stored.collect():
        raw = (rows[r["doc_id"]][1] or "").encode()
        payload = b"".join(t.tobytes() for t in media.read_jpeg(r["media"]))
        assert payload[: len(raw)] == raw and set(payload[len(raw) :]) <= {255} and len(payload) % 576 == 0 and payload
    read = media.media_features(stored).toPandas()
    assert read.error.isna().all() and (read.payload_bytes >= read.n_bytes).all()
    broken = spark.createDataFrame([(1, 1, bytearray(b"no")), (2, 1, None)], "doc_id long, n_bytes long, media binary")
    assert media.media_features(broken).where("error is not null").count() == 1


def test_jpeg_with_other_tables():
    """The general decoder gives what the one for equal blocks gives, and several frames are read."""
    p = np.random.default_rng(0).integers(0, 256, 1152).astype(np.uint8)
    found, media._lookup = media._lookup, lambda *a: None
    media._LOOKUP.clear()
    try:
        assert media.read_jpeg(media.to_jpeg(p) * 2)[1].tobytes() == p.tobytes()
    finally:
        media._lookup = found
        media._LOOKUP.clear()


def ids_of(machine: Transducer, text: str) -> list[int]:
    return np.frombuffer(machine.encode(text)[0], np.int32).tolist()


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer")
def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    with open(TOKENIZER, "rb") as f:
        machine = Transducer(read_model(f.read()))
    rng = np.random.default_rng(0)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["", " ", "  a  b", "Hello\nworld\t x", "ﬁ①é 漢😀", "a" * 3000, "▁x ▁ y"] + ["".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(3000)]
    for t in texts:
        ids = ids_of(machine, t)
        assert ids == library.encode(t), t
        assert machine.decode(ids) == library.decode(ids), t
    rows = [(i, t, 1) for i, t in enumerate([*texts[:7], None, "long text " * 60_000, "same", "same"])] + [(10, "same", 1), (None, "x", 1)]
    done = encode(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), TOKENIZER, check=True)
    assert done.where("not lossless").count() == 0 and done.count() == 13
    assert sorted(((r["doc_id"], r["text"]) for r in decode(done, TOKENIZER).collect()), key=repr) == sorted(((i, (t or "").replace("▁", " ")) for i, t, _ in rows), key=repr)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER, check=True).count() == 0


def message(*fields: tuple) -> bytes:
    """A protocol buffer message of (number, int, float or bytes)."""
    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
            continue
        out += varint(number << 3 | 2 * isinstance(value, bytes))
        out += varint(len(value)) + value if isinstance(value, bytes) else varint(value)
    return out


def varint(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def model_of(pieces: dict[str, float], kind: int, fallback: bool, squeeze: bool, char_map: bytes = b"", prefix: bool = True) -> bytes:
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback] + [(p, s, 1) for p, s in pieces.items()]
    listed = [(1, message((1, p.encode()), (2, s), (3, t))) for p, s, t in rows]
    return message(*listed, (2, message((3, kind), (4, len(rows)), (35, int(fallback)))), (3, message((1, b"own"), (2, char_map), (3, int(prefix)), (4, int(squeeze)), (5, 1))))


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("rules", ["identity", "nmt_nfkc_cf"])
def test_sentencepiece_machines(kind, fallback, squeeze, rules):
    """Models written by hand, unigram and merges, against the library: character map, white space, fallback, paths."""
    import sentencepiece

    rnd = random.Random(kind)
    char_map = b""
    if rules != "identity":
        whole = dict(_fields(sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()))
        char_map = bytes(dict(_fields(whole[3]))[2])
        assert len(read_char_map(char_map)) > 1000
    letters = "abcé▁"
    names = dict.fromkeys([*letters, "\n"][: 6 if squeeze else 5])
    while len(names) < 80:
        names["".join(rnd.choice(letters[:4]) for _ in range(rnd.randint(2, 5)))] = None
    names |= dict.fromkeys("▁" + n for n in [*names][6:40] if not n.startswith("▁"))
    # Ranks for merges; eighths, which sums keep exactly, for weights.
    pieces = {p: float(-i) if kind == 2 else -rnd.randint(8, 80) / 8 for i, p in enumerate(names)}
    data = model_of(pieces, kind, fallback, squeeze, char_map)
    library, machine = sentencepiece.SentencePieceProcessor(model_proto=data), Transducer(read_model(data))
    odd = ["", " ", "  a  b ", "\n\n", "xyz xy", "ＡＢＣ ﬁ①", "É\u0301e\u0301", "a\u3000b", "漢漢 漢", "😀", "a" * 300]
    for t in odd + ["".join(rnd.choice("abcé  x\n") for _ in range(rnd.randint(1, 40))) for _ in range(600)]:
        ids = ids_of(machine, t)
        if kind == 2:
            assert ids == library.encode(t), t
        else:  # paths of equal weight are equally good
            weigh = lambda found: sum(machine.score[i] for i in found)
            assert ids == library.encode(t) or weigh(ids) == weigh(library.encode(t)) and machine.decode(ids) == machine.decode(library.encode(t)), t
        if fallback:
            assert machine.decode(ids) == library.decode(ids), t


def encoded_scan(image, parts, dc_table, ac_table, restart):
    """Bytes of an interleaved scan of random coefficients, and the DC values of each component by block row and column."""
    rnd, bits, out, last = random.Random(8), [], b"", {}
    columns, rows = image
    dc = {c: np.zeros((rows * v, columns * h), int) for c, h, v in parts}

    def flush():
        nonlocal bits, out
        bits += [1] * (-len(bits) % 8)
        out += bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = []

    def put(value, n):
        bits.extend(value >> i & 1 for i in range(n - 1, -1, -1))

    def number(x, size):
        put(x if x >= 0 else x + (1 << size) - 1, size)

    for mcu in range(columns * rows):
        if restart and mcu and mcu % restart == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (mcu // restart - 1) % 8])
            last = {}
        for c, h, v in parts:
            for y in range(v):
                for x in range(h):
                    value = rnd.randint(-100, 100)
                    d = value - last.get(c, 0)
                    last[c] = value
                    size = abs(d).bit_length()
                    put(*dc_table[size])
                    number(d, size)
                    k = 1
                    while k < 64 and rnd.random() < 0.6:
                        run = rnd.choice([0, 1, 15])
                        if k + run > 63:
                            break
                        if run == 15 and rnd.random() < 0.5:
                            put(*ac_table[0xF0])
                            k += 16
                            continue
                        put(*ac_table[run << 4 | 2])
                        number(rnd.choice([-3, -2, 2, 3]), 2)
                        k += run + 1
                    if k < 64:
                        put(*ac_table[0])
                    dc[c][mcu // columns * v + y, mcu % columns * h + x] = value
    flush()
    return out, dc


def codes_of(counts, symbols):
    return {s: (code, n) for (n, code), s in media._codes(bytes(counts), bytes(symbols)).items()}


@pytest.mark.parametrize("restart", [0, 3])
@pytest.mark.parametrize("sampling", [[(1, 1, 1)], [(1, 2, 2), (2, 1, 1), (3, 1, 1)], [(1, 2, 1), (2, 1, 1), (3, 1, 1)], [(1, 1, 1), (2, 1, 1), (3, 1, 1)]])
def test_foreign_jpeg(sampling, restart):
    """Frames as other encoders write them: colour, subsampling, restarts, AC coefficients, sides that are no multiple of a block."""
    columns, rows = 5, 4
    dc_counts, dc_symbols = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], range(12)
    ac_counts, ac_symbols = [0, 0, 3, 2] + [0] * 12, [0x00, 0x02, 0x12, 0xF2, 0xF0]
    scan, dc = encoded_scan((columns, rows), sampling, codes_of(dc_counts, dc_symbols), codes_of(ac_counts, ac_symbols), restart)
    most_h, most_v = max(h for _, h, _ in sampling), max(v for _, _, v in sampling)
    wide, high = columns * 8 * most_h - 3, rows * 8 * most_v - 9
    frame = struct.pack(">BHHB", 8, high, wide, len(sampling)) + b"".join(bytes([c, h << 4 | v, 0]) for c, h, v in sampling)
    data = b"\xff\xd8" + media._segment(0xFE, b"comment") + media._segment(0xDB, b"\0" + bytes([4] * 64)) + media._segment(0xC0, frame)
    data += media._segment(0xC4, b"\x00" + bytes(dc_counts) + bytes(dc_symbols) + b"\x10" + bytes(ac_counts) + bytes(ac_symbols))
    data += (media._segment(0xDD, struct.pack(">H", restart)) if restart else b"") + media._segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([c, 0]) for c, _, _ in sampling) + b"\0\x3f\0") + scan + b"\xff\xd9"
    (got,) = media.read_jpeg(data)
    h, v = (1, 1) if len(sampling) == 1 else sampling[0][1:]
    want = dc[1][: -(-high * v // (8 * most_v)), : -(-wide * h // (8 * most_h))]
    assert got.tolist() == np.clip((want * 4 + 4) // 8 + 128, 0, 255).tolist()
    with pytest.raises(ValueError):
        media.read_jpeg(data[: len(data) - len(scan) // 2] + b"\xff\xd9")


def test_bit_reader_is_linear():
    rng = np.random.default_rng(1)
    found, media._lookup = media._lookup, lambda *a: None
    media._LOOKUP.clear()
    try:
        took = []
        for n in (72, 288):
            p = rng.integers(0, 256, 576 * n).astype(np.uint8)
            data = media.to_jpeg(p)
            began = time.perf_counter()
            assert media.read_jpeg(data)[0].tobytes() == p.tobytes()
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0]
    finally:
        media._lookup = found
        media._LOOKUP.clear()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_media_query(spark):
    """Sizes, digests and checksums of the payloads against the texts; equal texts, equal values."""
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op6_media"](spark, SF).collect()
    assert len(got) == len(texts)
    same = {}
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.to_jpeg(np.frombuffer(payload, np.uint8))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert same.setdefault(raw, r["feature"]) == r["feature"]


def test_votes_by_brute_force():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5, (300, quality.TERMS)).astype(np.float32) * (rng.random((300, quality.TERMS)) < 0.05)
    labels = rng.integers(0, 2, 200)
    model = quality.fit_model(counts[:200], labels, {0: 0.3, 1: 0.7}, 16, 9)
    got = model.score(counts[200:])
    for row, x in zip(counts[200:], got, strict=True):
        v = np.log1p(row) * model.idf
        v = v / np.linalg.norm(v) @ model.projection.astype(float)
        cosine = (model.vectors @ (v / np.linalg.norm(v))).tolist()
        best = sorted(range(200), key=lambda i: -cosine[i])[:9]
        vote = [max(cosine[i], 0) * (0.3 / (labels == 0).sum() if labels[i] == 0 else 0.7 / (labels == 1).sum()) for i in best]
        assert abs(x - sum(w for w, i in zip(vote, best, strict=True) if labels[i]) / sum(vote)) < 1e-3


@pytest.mark.skipif(not os.path.isdir(SF01), reason="no test tables")
def test_quality_held_out(spark):
    """Whole table, the held-out rows by their rule, and accuracy on them well above the commoner label's share."""
    got = queries()["op5_quality"](spark, SF01).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in got["held_out"].items())
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    tried = got.join(labels, how="inner").query("held_out")
    assert (tried["predicted"] == tried["quality"]).mean() > 0.95 > tried["quality"].mean()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tokens_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries()["op7_sentencepiece"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["token_ids"], r["lossless"]) for r in got} == {i: (len(x := library.encode(t)), x, True) for i, t in texts.items()}


def test_carried_names_that_clash(spark):
    """A carried column with the name of a result column is left out; odd rows and empty tables pass every operator."""
    from fabula.llm.minhash import near_duplicates
    from fabula.llm.substring_dedup import substring_dedup
    from fabula.llm.suffix_dedup import suffix_dedup

    names = "n_words n_removed kept_text spans host path rule verdict score feature error n_tokens token_ids lossless html n_chars id n chunk keys node size shard slot _later _hit c0 label".split()
    schema = "doc_id long, page_id long, text string, url string, media binary, n_bytes long, " + ", ".join(f"{n} string" for n in names)
    long = "word " * 70_000
    rows = [(i, i, t, u, None, 1, *["x"] * len(names)) for i, t, u in ((1, "a b c", "http://x.org/" + "p" * 90_000), (1, "a b c", "http://x.org/"), (2, None, None), (None, "", ""), (3, long, "casino"))]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        n, columns = table.count(), table.columns
        labels = table.selectExpr("doc_id", "1 as quality")
        model = quality.fit(table, labels)
        found = [
            substring_dedup(table, carry=[c for c in columns if c not in ("doc_id",)]),
            suffix_dedup(table),
            url_filter(table, carry=columns),
            quality.score(table, model, carry=columns),
            encode(table, TOKENIZER, carry=columns, check=True),
            media.media_features(table, carry=columns),
            media.texts_to_media(table),
            html_text.extract(table, html_text.fit(table), carry=columns),
            near_duplicates(table),
            kd_shards(table, dims=["doc_id", "shard"], shards=3),
        ]
        for out in found:
            assert len({c.lower() for c in out.columns}) == len(out.columns) and out.count() == n


PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site, and so on and on.</div><article><h1>A  title</h1><p>First &amp; <b>bold</b>
words.<p>Second one.<div class="ad">Buy now, buy now</div><form>Name <input></form></article><div id="comments"><p>I like it very much indeed.</p></div><footer>&copy; all</footer>"""


def test_html(spark):
    weights = html_text.learn([PAGE] * 5)
    assert html_text.main_text(PAGE, weights) == "A title\n\nFirst & bold words.\n\nSecond one."
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p>only &lt;this"), (4, "u", "<p>cut <b"), (5, "u", "<script>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract(pages, html_text.fit(pages)).collect()
    assert sorted(r["text"] for r in got) == sorted(["A title\n\nFirst & bold words.\n\nSecond one.", "", "", "only <this", "cut", ""])
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "class='no-sidebar'", "class='single-post with-comments'", "id='search-results'", "class='social-science'", "class='search'", "id='sidebar'"])
@pytest.mark.parametrize("inner", ["article", "div"])
def test_html_wrappers(wrapper, inner):
    page = f"<html><body><nav>Home</nav><div {wrapper}><{inner}><p>{"First words here. " * 5}</p><p>{"More words. " * 9}</p><p class='site-footer'>{"All rights. " * 9}</p></{inner}></div><footer>Us</footer></body></html>"
    want = ("First words here. " * 5).strip() + "\n\n" + ("More words. " * 9).strip()
    if inner == "div" and wrapper in ("class='search'", "id='sidebar'"):
        want += "\n\n" + ("All rights. " * 9).strip()  # no word would remain by the names
    assert html_text.main_text(page, html_text.learn([PAGE] * 5)) == want


@pytest.mark.parametrize(
    ("middle", "kept"),
    [
        ("<aside><ul>" + "<li><a href='/x'>link</a></li>" * 40 + "</ul></aside>", ""),
        ("<div class='comments'>" + "<div><p>yes</p></div>" * 60 + "</div>", ""),
        ("<table>" + ("<tr>" + "<td>7</td>" * 4 + "</tr>") * 30 + "</table>", "7 " * 120),
    ],
)
def test_html_middle_of_article(middle, kept):
    page = f"<html><body><nav>Home</nav><article><p>{'one ' * 150}</p>{middle}<p>{'two ' * 120}</p></article></body></html>"
    for weights in (html_text.Weights(), html_text.learn([PAGE] * 5)):
        assert html_text.main_text(page, weights).split() == ("one " * 150 + kept + "two " * 120).split()


def test_best_region_by_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        scores = [rnd.choice([-3.0, -2.0, -0.5, 0.0, 1.0, 2.0, 5.0]) for _ in range(rnd.randint(0, 14))]
        ranges = [(sum(scores[a:b]), a - b, -a, (a, b)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max(ranges, default=(0, 0, 0, (0, 0)))
        got = html_text.best_region(scores)
        assert (sum(scores[slice(*got)]) if got != (0, 0) else 0) == max(best[0], 0)
        if best[0] > 0 and sum(r[0] == best[0] for r in ranges) == 1:
            assert got == best[3]


def test_region_decides():
    """Text beside the article is left out by the region alone: nothing names it."""
    side = "<table><tr><td>Ten more words stand here beside the text itself.</td></tr></table>"
    pages = [f"<html><body><div><span>{'Seven words that nobody needs at all. ' * (1 + i % 3)}</span></div>{side}<article><h1>Title {i}</h1><p>{'Main words. ' * (12 + i % 9)}</p></article><div>{side}</div></body></html>" for i in range(40)]
    weights = html_text.learn(pages[:30])
    for i, page in enumerate(pages[30:], 30):
        seq = html_text.tokens(page)
        whole = html_text.blocks(seq, html_text.shares(seq, weights), (0, len(seq)))
        want = [f"Title {i}", ("Main words. " * (12 + i % 9)).strip()]
        assert html_text.main_text(page, weights) == "\n\n".join(want) and len(whole) > 4


def test_learned_class():
    """A class that labelled pages have beside the article only is left out within one, too."""
    pages = [f"<html><body><div class='zz9'>Buy these things now.</div><article><p>{'Main words. ' * 20}</p></article></body></html>"] * 40
    inside = f"<html><body><article><p>{'Main words. ' * 20}</p><div class='zz9'>Buy these things now.</div><div class='zz8'>Stay here.</div><p>{'Last words. ' * 20}</p></article></body></html>"
    assert "Buy" in html_text.main_text(inside, html_text.Weights()) and "Stay" in html_text.main_text(inside, html_text.Weights())
    text = html_text.main_text(inside, html_text.learn(pages))
    assert "Buy" not in text and "Stay here." in text and "Last" in text


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_html_query(spark, monkeypatch):
    """The query gives the article of every page; so does the region alone, without a class list."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}

    def article(page):
        seq = html_text.tokens(page)
        return "\n\n".join(html_text.blocks(seq, [1.0] * len(seq), tuple(next(i for i, t in enumerate(seq) if t[:2] == (k, "article")) for k in ("open", "close"))))

    got = queries()["op8_html_text"](spark, SF).collect()
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got} == {i: (p["url"], article(p["html"]), len(article(p["html"]))) for i, p in pages.items()}
    monkeypatch.setattr(html_text, "LEAVE_NAMES", frozenset())
    weights = html_text.learn([p["html"] for p in pages.values()])
    for p in pages.values():
        seq = html_text.tokens(p["html"])
        region = html_text.best_region(weights.scores(seq, html_text.shares(seq, weights)))
        assert "\n\n".join(html_text.blocks(seq, [1.0] * len(seq), region)) == article(p["html"])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got = queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)
