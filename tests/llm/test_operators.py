"""Each operator against brute force, round trips and the cases that tables may hold."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paperlake.llm import bpe, common, decontaminate, fingerprint, langid, quality, sharding, simhash, tokenfile, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
#: nulls everywhere, empty and very long texts, repeated rows and ids
ODD = [(1, "alpha beta gamma delta epsilon", "en", "s", 1), (1, "alpha beta gamma delta epsilon", "en", "s", 1), (2, None, None, None, None), (None, "a text without id", "fr", None, 3), (3, "", "en", "s", 0), (4, LONG, "en", "s", 9), (5, " \n\t ", None, "s", 2), (1, "the same id with other words here", "de", "s", 4), (None, None, None, None, None), (6, "x" * 4000, "en", "s", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# SimHash


def brute(prints, distance=4):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and bin(a ^ b).count("1") <= distance:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("hot", [2048, 2])
def test_simhash_links_equal_brute_force(spark, hot):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(0, 7))) for b in base for _ in range(14)} | {0, 1, (1 << 63)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(signed)], "doc_id long, simhash long")
    found = {r["simhash"] & (2**64 - 1): r["component_id"] for r in simhash.with_components(df, 4, hot).collect()}
    ids = {p & (2**64 - 1): i for i, p in enumerate(signed)}
    roots = brute(sorted(prints))
    smallest = {}
    for p, r in roots.items():
        smallest[r] = min(smallest.get(r, 1 << 60), ids[p])
    assert found == {p: smallest[r] for p, r in roots.items()}


def test_simhash_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    zero = [r for r in rows if r["simhash"] == 0]
    assert {r["doc_id"] for r in zero} == {2, 3, 5, None} and {r["component_id"] for r in zero} == {2}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 1, 2, 4, 6]


def test_simhash_long_text_is_whole():
    text = ("one two three four five " * 40_000).encode()
    assert simhash.fingerprint(text) != simhash.fingerprint(text + b"and now for something else " * 40_000)
    assert simhash.fingerprint(b"A B c") == simhash.fingerprint(b"a  b\tC") and simhash.fingerprint(None) == 0


# sharding


def test_sharding_moves_rows_only_into_the_new_shard(spark, odd, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.assign(docs, [1.0] * 5, buckets=4).collect()
    for s in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own))) and 480 < len(own) < 720
    assert all(r["grown_shard"] in (r["shard"], 5) for r in rows)
    assert 400 < sum(r["grown_shard"] == 5 for r in rows) < 600
    odd_rows = sharding.assign(odd, [1.0, 3.0]).collect()
    assert len(odd_rows) == len(ODD) and all(len({r["shard"] for r in odd_rows if r["doc_id"] == i}) == 1 for i in (1, None))
    assert all(r["size"] == 8 and r["text_crc32"] == 0 for r in odd_rows if r["doc_id"] in (2, 3))
    assert sharding.assign(empty, [1.0]).count() == 0
    heavy = [r["shard"] for r in sharding.assign(docs, [1.0, 3.0]).collect()]
    assert 0.7 < sum(heavy) / len(heavy) < 0.8


# WARC


def test_warc_round_trip(spark):
    data = [(1, "http://a/x y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://b", None), (4, "http://c", ""), (None, "http://d", "<p>same</p>"), (5, "http://e\r\nX: 1", "é" * 200_000), (1, "http://a", "<p>same</p>"), (None, None, "only null ids"), (None, None, "only null ids")]
    pages = spark.createDataFrame([(*d, "x") for d in data], "page_id long, url string, html string, refers_to string")
    rows = warc.read(warc.write(pages, file_bytes=400), payloads=True).collect()
    assert len(rows) == len(data)
    for r in rows:
        match = [d[2] or "" for d in data if d[0] == r["page_id"] and hashlib.sha1((d[2] or "").encode()).hexdigest() == __import__("base64").b32decode(r["payload_digest"]).hex()]
        assert match and r["payload_bytes"] == len(match[0].encode())
        assert r["payload"] == (match[0].encode() if r["record_type"] == "response" else None)
    kinds = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"] or 0) for r in rows)
    assert kinds == [(0, "response", 0), (0, "response", 0), (0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "revisit", 1), (3, "response", 0), (4, "revisit", 3), (5, "response", 0)]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    few = warc.read(warc.write(pages.select("page_id", "url", "html"), least_bytes=12)).collect()
    assert all(r["record_type"] == "response" for r in few if r["payload_bytes"] < 12)


def test_warc_reader_refuses_damage():
    good = warc.record(1, "u", b"payload " * 50, None, "2024-01-01T00:00:00Z") + warc.record(2, "u", b"payload " * 50, 1, "2024-01-01T00:00:00Z")
    assert [r["record_type"] for r in warc.read_file(io.BytesIO(good))] == ["response", "revisit"]
    with pytest.raises((ValueError, EOFError, zlib.error)):
        list(warc.read_file(io.BytesIO(good[:-20])))
    plain = zlib.decompress(warc.record(1, "u", b"payload", None, "d"), 31).replace(b"payload", b"pAyload")
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.read_file(io.BytesIO(pack.compress(plain) + pack.flush())))


# token files


def test_token_files(spark, odd, empty):
    path = tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    marked = spark.createDataFrame([(7, "hello <|endoftext|> world", None, None, 1), (8, "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>", None, None, 1)], SCHEMA)
    manifest = tokenfile.write(odd.union(marked), path, files=3, frame_ids=50)
    rows = sorted(tokenfile.read(manifest).collect(), key=lambda r: r["start"])
    by_hash = lambda x: xxhash.xxh64_intdigest(x.encode(), 42) - (xxhash.xxh64_intdigest(x.encode(), 42) >> 63 << 64) if x is not None else 42
    want = sorted([*ODD, *map(tuple, marked.collect())], key=lambda d: (d[0] is not None, d[0] or 0, by_hash(d[1])))
    start = 0
    for r, d in zip(rows, want, strict=True):
        ids = np.array([*t.encode(d[1] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d[0], start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert 49407 in t.encode("hello <|endoftext|> world", add_special_tokens=False).ids
    one = tokenfile.read_documents(spark, manifest, spark.createDataFrame([(6,)], "doc_id long")).collect()
    assert one[0]["ids"][:-1] == t.encode("x" * 4000, add_special_tokens=False).ids
    assert tokenfile.read(tokenfile.write(empty, path)).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_word_encoder_equals_library(special_as_text):
    from tokenizers import Tokenizer

    e, t = tokenfile.WordEncoder(tokenizers.path("word_bpe_49k.json"), special_as_text), Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = special_as_text
    assert e.by_word
    rng, alphabet = random.Random(5), " \n\t'sabcZÀéß日12,.!¡\x1c\x85\xa0 İΣςtre²_^`]\\\r|̸"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["<|endoftext|> a", "가 ᆨ", "x<|endoftext|><|startoftext|>y's <|endoftext", "<|ENDOFTEXT|>\n<|endoftext|>."]
    ids, counts = e(pa.array(texts))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_manifest_lists_documents_in_rows(spark, monkeypatch):
    path = tokenizers.path("word_bpe_49k.json")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    whole = sorted(map(tuple, tokenfile.read(tokenfile.write(docs, path, files=2)).collect()))
    monkeypatch.setattr(tokenfile, "LISTED", 7)
    parts = tokenfile.write(docs, path, files=2)
    assert parts.agg(F.max("documents")).first()[0] <= 7 and sorted(map(tuple, tokenfile.read(parts).collect())) == whole
    assert [r["doc_id"] for r in tokenfile.read_documents(spark, parts, spark.createDataFrame([(41,)], "doc_id long")).collect()] == [41]


def test_token_file_checksums(tmp_path):
    out = io.BytesIO()
    w = tokenfile.Writer(out, 20)
    for i in range(30):
        w.add(np.arange(i, dtype="<u4"))
    w.close()
    path = tmp_path / "x"
    path.write_bytes(out.getvalue())
    with pa.OSFile(str(path)) as f:
        r = tokenfile.Reader(f)
        assert len(r) == 30 and all((x == np.arange(i)).all() for i, x in enumerate(r)) and r.document(29)[-1] == 28
    data = bytearray(out.getvalue())
    data[12] ^= 1
    path.write_bytes(bytes(data))
    with pa.OSFile(str(path)) as f, pytest.raises(Exception):
        list(tokenfile.Reader(f))


# byte-level BPE


def test_bpe_equals_tiktoken(odd, empty):
    import tiktoken

    path = tokenizers.path("byte_bpe_50k.tiktoken")
    c = bpe.codec(path, tokenizers.PATTERN)
    assert c.by_unit
    t = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng, alphabet = random.Random(7), " \n\t'sabcZÀéß日12,.!¡\x1c\x85\xa0 İtre²_^`]\\\r"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(3000)] + [None, "", "a" * 3000, "ab" * 900 + " " + "z" * 300, "   ", "x  ", LONG]
    ids, counts = c.encode(pa.array(texts, pa.string()))
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == t.encode_ordinary(text or ""), repr(text)
        assert c.decode(own) == (text or "").encode()
    rows = bpe.digests(odd, path, tokenizers.PATTERN).collect()
    assert sorted(r["decoded_sha256"] for r in rows) == sorted(hashlib.sha256((d[1] or "").encode()).hexdigest() for d in ODD)
    assert bpe.digests(empty, path).count() == 0
    other = bpe.Codec(c.ranks, r"\S+|\s+")
    assert other.decode(other.encode(pa.array(["a b  c\n"]))[0]) == b"a b  c\n"
    assert [len(r["ids"]) for r in bpe.encode(odd.where("doc_id = 3"), path).collect()] == [0]


# learned operators


def test_language_model_equals_a_recount(spark):
    rows = [("Ab c", "x"), ("a b", "x"), ("½ 12", "x"), ("zz z", "y"), (None, "y"), ("q", None)]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"), rows_per_language=None)
    want = np.full((3, langid.BINS, 2), 0.5)
    for text, lang in rows:
        if text and lang and any(c.isalpha() for c in text):
            chars = [c if c.isalpha() else " " for c in text.lower()]
            for order in (1, 2, 3):
                for i in range(len(chars) - order + 1):
                    h = 0
                    for c in chars[i : i + order]:
                        h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                    want[order - 1, ((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 18, "xy".index(lang)] += 1
    logs = np.log(want / want.sum(axis=1, keepdims=True)).reshape(-1, 2)
    assert model.languages == ["x", "y"] and np.allclose(model.weights[:-1], logs, atol=1e-5)
    assert model.score(["½", "²³", "Ⅷ ①", "12", "zzz"])[0] == ["und"] * 4 + ["y"]


def test_simhash_equals_a_plain_count():
    rng = random.Random(11)
    for n in (1, 3, 4, 5, 9, 200):
        words = [rng.choice(["Aa", "b", "ç", "dd", "É"]) for _ in range(n)]
        low = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
        hashes = [xxhash.xxh64_intdigest(" ".join(low[i : i + 4]).encode(), 42) for i in range(max(1, n - 3))]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint("\t".join(words).encode()) == want


def test_shards_equal_a_plain_draw(spark):
    rows = sharding.assign(spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), [1.0, 2.0, 1.0]).collect()
    for r in rows:
        def winner(weights):
            scores = []
            for shard, weight in enumerate(weights):
                seed = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), 42)
                u = ((xxhash.xxh64_intdigest(f"k{r['doc_id']}".encode(), seed) >> 11) + 0.5) / 2**53
                scores.append((-weight / math.log(u), shard))
            return max(scores)[1]

        assert r["shard"] == winner([1.0, 2.0, 1.0]) and r["grown_shard"] == winner([1.0, 2.0, 1.0, 1.0])


def test_columns_of_any_name_stay(spark, sf_dir, tmp_path):
    names = ["_q_x", "_Q_words", "_key", "_text_hash", "_toxic", "_lang_pred", "_lang_score", "_part", "_d", "node", "segs", "h", "bucket", "guest", "shard"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, (_, t, *_) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    own = sorted(map(tuple, docs.collect()), key=str)

    def same(found):
        assert found.columns[: len(docs.columns)] == docs.columns
        got = {r[0]: tuple(r)[: len(docs.columns)] for r in found.collect()}
        assert got and all(got[r[0]] == r for r in own if r[0] in got)
        return len(got)

    net = toxicity.Network()
    assert same(toxicity.score(docs, net)) == same(toxicity.keep_clean(docs, net)) == len(own)
    model = langid.fit(common.table(spark, sf_dir, "documents"))
    assert same(langid.predict(docs, model)) == len(own) and same(langid.keep_known(docs, model)) > 0
    rules = quality.train(np.array([[float(i % 7)] for i in range(60)]), np.array([int(i % 7 > 3) for i in range(60)]), ["chars"])
    assert same(quality.score(docs, rules)) == len(own)
    assert same(simhash.keep_one(docs)) < len(own)
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", "k")], "item_id long, text string, _d string")
    assert same(decontaminate.keep_uncontaminated(docs, items)) == len(own) - 2
    assert simhash.near_duplicates(docs).count() == fingerprint.compared(docs).count() == sharding.assign(docs, [1.0]).count() == len(own)
    assert tokenfile.read(tokenfile.write(docs, tokenizers.path("word_bpe_49k.json"), files=2)).count() == len(own)
    assert bpe.digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).count() == len(own)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *[F.col(f"`{c}`") for c in names])
    assert warc.read(warc.write(pages)).count() == len(own)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", [1.0, 1.0])
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == len(own)


def test_warc_takes_very_long_addresses(spark):
    pages = spark.createDataFrame([(1, "http://a/" + "x" * 3_000_000, "p")], "page_id long, url string, html string")
    row = warc.read(warc.write(pages)).first()
    assert len(row["url"]) == 3_000_009 and row["payload_bytes"] == 1


def test_language(spark, odd, empty, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(common.crc_of_id("doc_id") % 5 != 0))
    rows = langid.predict(docs, model).where(common.crc_of_id("doc_id") % 5 == 0).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.95 * len(rows)
    found = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert found[None] == found[""] == found[" \n\t "] == ("und", 0.0) and found[LONG][0] == "en"
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty)
    assert langid.keep_known(odd, none).count() == len(ODD)
    assert langid.keep_known(docs, model).count() > 0.98 * docs.count()


def test_toxicity_gradients_and_scores(spark, odd, empty):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 80))) for _ in range(500)]
    labels = [int(rng.random() < 0.4) for _ in texts]
    texts = [t + " nastyword " + t[:50] if y else t for t, y in zip(texts, labels)]
    net = toxicity.train(texts[:350], labels[:350], rounds=3, steps=60)
    scores = net.scores(pa.array(texts[350:]))
    assert np.mean((scores >= 0.7) == np.array(labels[350:])) > 0.9
    rows = toxicity.score(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(empty, net).count() == 0 and set(toxicity.Network().scores(pa.array(["a", None]))) == {0.0}


def test_quality(spark, odd, empty, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rules = quality.fit(docs, labels, common.crc_of_id("doc_id") % 4 != 2)
    rows = quality.score(docs, rules).join(labels, "doc_id").collect()
    assert sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) > 0.85 * len(rows)
    assert all(r["score"] is not None for r in quality.score(odd, rules).collect())
    assert quality.score(empty, rules).count() == 0
    nothing = quality.fit(docs, labels.limit(0), F.lit(True))
    assert all(r["score"] > 0.99 for r in quality.score(odd, nothing).collect())


def test_tree_rules_compile_to_what_they_say(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(int)
    rules = quality.train(x, y, ["a", "b", "c"], trees=20)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = np.array([r[0] for r in df.select(rules.column()).collect()])
    want = 1 / (1 + np.exp(-(rules.bias + sum(w * quality._holds(x, r) for r, w in rules.rules))))
    assert np.allclose(got, want) and np.mean((got > 0.5) == y) > 0.97


# decontamination


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon")], "item_id long, text string")
    filler = " ".join(f"w{i}" for i in range(5000))
    docs = [(10, f"{filler} ONE two, three four five six seven eight nine ten -- eleven twelve {filler}"), (11, "one two three four five six seven eight"), (12, "here is a short ITEM indeed"), (13, "item short"), (14, filler), (None, "alpha beta gamma delta epsilon"), (15, None), (16, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    rows = {(r["doc_id"], r["item_id"]): r["n_found"] for r in decontaminate.contained(df, items).collect()}
    assert rows == {(10, 1): 8, (12, 2): 1, (None, 5): 1}
    assert sorted(r["doc_id"] or 0 for r in decontaminate.keep_uncontaminated(df, items).collect()) == [11, 13, 14, 15, 16]
    assert decontaminate.contained(empty, items).count() == 0 and decontaminate.contained(odd, items.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.contained(odd, items).collect()} == {1}


@pytest.mark.parametrize("few", [0, 256])
def test_decontamination_equals_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(decontaminate, "FEW_HASHES", few)
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(500)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 5, 6, 8, 20, 70])))) for i in range(60)]
    docs = []
    for d in range(120):
        own = items[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = word()
        docs.append((d, " ".join([word() for _ in range(rng.randrange(30))] + own + [word() for _ in range(rng.randrange(300))])))
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = set()
    for i, t in items:
        w = t.split()
        own = runs(w, min(5, len(w)))
        for d, text in docs:
            found = len(own & runs(text.split(), min(5, len(w))))
            if found * 5 >= len(own) * 4:
                want.add((d, i, len(own), found))
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_found"]) for r in got} == want and len(want) > 20


def test_signatures_lose_nothing():
    rng = random.Random(2)
    for size in range(1, 70):
        part = size.bit_length() - 1
        u = 2 ** (part + 1) - 1
        m = u - -(-u * 4 // 5) + 1
        need = -(-size * 4 // 5)
        hashes = sorted(rng.getrandbits(63) for _ in range(size))
        assert set(hashes[:m]) & set(rng.sample(hashes, need))


# fingerprints


def test_fingerprints(spark, odd, empty):
    rows = fingerprint.compared(odd).collect()
    assert len(rows) == len(ODD) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    docs = [(i, f"line {i} a\nline {i} b c d\ncommon line") for i in range(7)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.compared(df).collect()}
    for i, text in docs:
        after, k = docs[(i - 1) % 7][1], len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
    assert fingerprint.compared(empty).count() == 0 and fingerprint.compared(df.limit(1)).count() == 1


def own_units(p, whole):
    """What pairs up in a paragraph: words, pieces of long ones, or pieces of a short text."""
    if len(whole) <= 96:
        size = 1 if len(whole) <= 32 else 2
        return [p[i : i + size] for i in range(0, len(p), size)]
    return [x for w in p.split(" ") if w for x in ([w[i : i + 2] for i in range(0, len(w), 2)] if len(w) > 16 else [w])]


def own_lanes(text):
    """The lanes of a text by a plain loop: hashes as Spark chains them."""
    number = lambda v, n, seed=42: xxhash.xxh64_intdigest(v.to_bytes(n, "little"), seed)
    exact, graded = [0] * 16, [0] * 128
    for p in text.split("\n"):
        if not p.strip(" "):
            continue
        words = own_units(p, text)
        digest = hashlib.sha512(p.encode()).hexdigest().encode()
        for j in range(8):
            h = xxhash.xxh64_intdigest(digest, number(j, 4))
            exact[2 * j] += h & 0xFFFFFFFF
            exact[2 * j + 1] += h >> 32
        units = Counter()
        for x, y in zip(words, [*words[1:], None]):
            one = xxhash.xxh64_intdigest(x.encode(), 42)
            units[one if y is None else xxhash.xxh64_intdigest(y.encode(), one)] += 1
        often = len(units) <= 64 and 2 * len(units) <= len(words)
        for one, n in units.items():
            n = round(math.sqrt(n)) if often else 1
            for k, h in enumerate((one, number(one, 8, number(1, 4)))):
                for i in range(64):
                    graded[64 * k + i] += n if h >> i & 1 else -n
    return [x % (1 << 32) for x in exact] + [x % (1 << 16) for x in graded]


def test_fingerprints_equal_a_plain_loop(spark):
    docs = [(9, "one two three four five six\nseven  eight\n\n nine"), (12, "a b " * 20 + "\n" + "long" * 9 + " c\nx y z\n" + "q r " * 9), (11, "漢字" * 60 + "\nend of it here"), (5, "ä ö 漢字 ü\nlast line here"), (5, "a b"), (4, None), (2, " \n "), (None, "without an id"), (7, "one two three four five six\nseven  eight")]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, bucket string, _h0 int")
    got = fingerprint.compared(df).collect()
    hexed = lambda lanes: "".join(f"{x:08x}" for x in lanes[:16]) + "".join(f"{x:04x}" for x in lanes[16:])
    by_hash = {r["edited_sha256"]: r for r in got}
    order = [docs[1], docs[2], docs[0], docs[8], *sorted(docs[3:5], key=lambda d: -np.array([xxhash.xxh64_intdigest(d[1].encode(), 42)], np.uint64).view(np.int64)[0]), docs[5], docs[6], docs[7]]
    assert len(got) == len(docs)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        row = by_hash[hashlib.sha256(edited.encode()).hexdigest()]
        if text:
            assert row["doc_id"] == i
            assert row["fingerprint"] == hexed(own_lanes(text)) and row["edited_fingerprint"] == hexed(own_lanes(edited))


def test_fingerprint_likeness_is_near_the_cosine(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(120, 400)))) for i in range(60)]

    def pairs(text):
        words = text.split(" ")
        return Counter(set(zip(words, [*words[1:], None])))

    def cosine(a, b):
        return sum(n * b[x] for x, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))

    got = {r["doc_id"]: r for r in fingerprint.compared(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    off_edited, off_next = [], []
    for i, text in docs:
        after = docs[(i - 1) % len(docs)][1]
        k = len(text) // 3
        off_edited.append(got[i]["near_edited"] - cosine(pairs(text), pairs(text[: len(text) - k] + after[:k])))
        off_next.append(got[i]["near_next"] - cosine(pairs(text), pairs(after)))
    assert max(map(abs, off_edited)) < 0.25 and np.std(off_edited) < 0.09 and max(map(abs, off_next)) < 0.4


def test_fingerprints_see_texts_without_blanks_and_short_ones(spark):
    rng = random.Random(9)
    docs = [(i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))) for i, n in enumerate([600, 300, 150] * 4)]
    docs += [(100 + i, " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 8))) for _ in range(n))) for i, n in enumerate([1, 2, 4, 6, 9, 14, 20, 40] * 6)]
    rows = fingerprint.compared(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    low = [r for r in rows if r["n_chars"] >= 30 and r["near_edited"] < 0.45]
    assert len(low) <= 1 and all(r["near_edited"] > 0.1 for r in rows if r["n_chars"] >= 6)
    assert np.mean([r["near_next"] for r in rows if r["n_chars"] > 32]) < 0.15


def test_ids_of_another_kind_are_refused(spark):
    texts = spark.createDataFrame([("d0", "a", "b")], "doc_id string, text string, html string")
    for run in (lambda: fingerprint.compared(texts), lambda: tokenfile.write(texts, tokenizers.path("word_bpe_49k.json")), lambda: warc.write(texts, page_id="doc_id", url="text")):
        with pytest.raises(TypeError, match="whole numbers"):
            run()


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(1, "text 0")] * 50 + [(i, None) for i in range(2, 90)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)] + [(1, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic", F.lit(True), (20, 30)).collect()
    assert sum(r["label"] == 0 for r in got) == 20 and sum(r["label"] == 1 for r in got) == 30


def test_network_gradients_and_windows_equal_plain_ones():
    """Gradients by finite differences; window scores by a loop over words."""
    rng = np.random.default_rng(3)
    net = toxicity.Network.new(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = pa.array([" ".join(rng.choice(["alpha", "be", "gamma1", "délta", "x"], n)) for n in (1, 7, 24, 25, 70)] + [""], pa.large_string())
    words, index, counts = toxicity.tokens(texts)
    start, size, doc = toxicity.windows(counts)
    ids, tri, own = toxicity.grams(words)
    ids, own = np.append(ids, 0), np.append(own, 0)
    words_in, padded = (ids, tri, own, np.cumsum(own) - own), np.append(index, len(words))
    steps = np.arange(toxicity.WINDOW)
    at = padded[np.where(steps < size[:, None], start[:, None] + steps, len(padded) - 1)]

    class Keep:
        def random(self, shape):
            return np.ones(shape)

    def one(w, p):
        """The logit of a window of words, step by step."""
        if not w:
            return float(p["b"][0])  # the pooled state is zero
        sig = lambda x: 1 / (1 + np.exp(-x))
        places = words.to_pylist()
        x = []
        for word in w:
            k = places.index(word)
            t = tri[np.cumsum(own)[k] - own[k] : np.cumsum(own)[k]]
            x.append(np.concatenate([p["word"][ids[k]], p["gram"][t].mean(axis=0)]))
        states = [[], []]
        h_size = toxicity.HIDDEN
        for n, d in enumerate("fb"):
            h = np.zeros(h_size)
            for v in x if d == "f" else x[::-1]:
                g, u = v @ p[f"in_{d}"] + p[f"bias_{d}"], p[f"at_{d}"]
                z, r = sig(g[:h_size] + h @ u[:, :h_size]), sig(g[h_size : 2 * h_size] + h @ u[:, h_size : 2 * h_size])
                new = np.tanh(g[2 * h_size :] + r * (h @ u[:, 2 * h_size :]))
                h = new + z * (h - new)
                states[n].append(h)
        s = np.hstack([np.array(states[0]), np.array(states[1][::-1])])
        e = np.exp(s @ p["v"] - (s @ p["v"]).max())
        return float((e / e.sum()) @ (s @ p["w"]) + p["b"][0])

    lists = [t.lower().split() for t in texts.to_pylist()]
    plain, base = [], np.concatenate([[0], np.cumsum(counts)])
    for a, n, d in zip(start.tolist(), size.tolist(), doc.tolist()):
        plain.append(one(lists[d][a - base[d] : a - base[d] + n], net.p))
    some = size > 0
    assert np.allclose(net.logits(words, index, start, size)[some], np.array(plain)[some], atol=2e-5)
    label, weight = (np.arange(len(at)) % 2).astype(float), np.ones(len(at))
    grads = net.gradients(words_in, at[some], size[some], label[some], weight[some], Keep())

    def loss(p):
        z = np.array([one(lists[d][a - base[d] : a - base[d] + n], p) for a, n, d in zip(start[some].tolist(), size[some].tolist(), doc[some].tolist())])
        return float(np.mean(np.log1p(np.exp(z)) - label[some] * z))

    for name in net.p:
        flat = np.flatnonzero(np.abs(grads[name]).ravel() > 1e-4)
        for i in rng.choice(flat, min(4, len(flat)), replace=False):
            moved = {k: v.copy() for k, v in net.p.items()}
            ends = []
            for step in (1e-4, -1e-4):
                moved[name].ravel()[i] = net.p[name].ravel()[i] + step
                ends.append(loss(moved))
            assert abs((ends[0] - ends[1]) / 2e-4 - grads[name].ravel()[i]) < 1e-3 * max(1.0, abs(grads[name].ravel()[i]) * 10), name


def test_fingerprints_of_one_repeated_id(spark):
    docs = [(7, f"text number {i}") for i in range(900)] + [(i, "other") for i in range(8, 40)]
    rows = fingerprint.compared(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs) and len({r["fingerprint"] for r in rows}) == 901


def test_fingerprints_add_up(spark):
    df = spark.createDataFrame([(1, "a b c\nd e\na b c"), (2, "d e\na b c\na b c"), (3, "a b c\nd e"), (4, "a b c")], "k long, text string")
    lanes = {r["k"]: r["lanes"] for r in fingerprint.of_texts(df, ["k"]).collect()}
    assert lanes[1] == lanes[2] != lanes[3]
    rows = spark.createDataFrame([(lanes[3], lanes[4], lanes[1])], "a array<bigint>, b array<bigint>, c array<bigint>")
    both = rows.select(fingerprint.combine(F.col("a"), F.col("b")).alias("s"), fingerprint.combine(F.col("c"), F.col("b"), -1).alias("d")).first()
    assert both["s"] == lanes[1] and both["d"] == lanes[3]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}
