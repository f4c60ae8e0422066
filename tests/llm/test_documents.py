"""Operators on documents against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinetra.llm import chunks, imatch, langid, minhash, mixing, piece_codec, sharding, shingles, token_counts, token_store, toxicity
from kinetra.llm.common import keyed_mod

PIECES, BYTES = str(public_tokenizers.path("piece_bpe_32k.model")), str(public_tokenizers.path("byte_bpe_50k.json"))
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"
WORDS = [f"w{i}" for i in range(400)]


def rows(n=60, seed=3):
    rng = np.random.default_rng(seed)
    base = [" ".join(rng.choice(WORDS, 40)) for _ in range(n)]
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 5}" if i % 7 else None, len(t), None, "x") for i, t in enumerate(base)]
    for k in range(10):  # exact and near copies, one with a far link
        words = base[k].split()
        out.append((100 + k, base[k], "en", "s1", 1, 0.5, None))
        words[-1] = "changed"
        out.append((200 + k, " ".join(words), "en", "s1", 1, None, None))
    odd = [None, "", "   ", "one", "one two three", "ONE two THREE", "é ü 漢字 🎉", "\n\n", "!!!", "a " * 5000, "x" * 20000]
    out += [(300 + i, t, None, "s2" if i % 2 else None, None, None, None) for i, t in enumerate(odd)]
    out += [(400, "same row again", "en", "s3", 1, None, None)] * 3 + [(None, "no id here at all ok", None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def word_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(sets, num=85, den=100):
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_minhash_equals_brute_force(docs):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    sets = {r[0]: word_set(r[1]) for r in rows() if r[0] is not None}
    want = components(sets)
    assert {i: got[i]["component_id"] for i in want} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in sets.items())
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert minhash.near_duplicates(docs).count() == len(rows())


def test_minhash_star_family_with_split_regions(spark):
    """Variants that are near the base only: the base must be found as hub, also in regions that are split."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    out = {7: base}
    for k in range(60):
        words = list(base)
        for at in rng.choice(24, 1 + k % 2, replace=False) * 5:
            words[at] = f"e{k}_{at}"
        out[100 - k if k % 2 else 100 + k] = words
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in out.items()], "doc_id long, text string")
    want = components({i: word_set(" ".join(w)) for i, w in out.items()})
    for most in (512, 4):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, region_rows=most).collect()}
        assert got == want


def test_minhash_pairs_away_from_hubs_in_split_regions(spark):
    """Families that share a passage fill regions of far more than 16 members; each family is one pair at
    about 0.86 and no hub is near it, so the pair must meet in a split region."""
    shared, out = [f"p{i}" for i in range(150)], {}
    for k in range(300):
        own = [f"k{k}w{i}" for i in range(36)]
        for half in (0, 1):
            words = shared + own
            words[154] = words[164] = words[182] = f"h{half}k{k}"
            out[2 * k + half] = " ".join(words)
    a, b = word_set(out[0]), word_set(out[1])
    assert 0.85 <= len(a & b) / len(a | b) < 0.87 and len(a & word_set(out[2])) / len(a | word_set(out[2])) < 0.8
    df = spark.createDataFrame(list(out.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df, trees=6, base=1, region_rows=16).collect()}
    assert got == {i: i - i % 2 for i in out}


def test_minhash_empty(none):
    assert minhash.near_duplicates(none).count() == 0


def test_shingles_of_blocks():
    text = " ".join(f"word{i % 977}" for i in range(120000))
    assert len(text.encode()) > 2 * shingles.BLOCK
    assert len(shingles.shingle_set(text)) == len(word_set(text))
    assert np.array_equal(shingles.shingle_sets([text, None, "a b"])[0], shingles.shingle_set(text))


def test_mixing(docs, none):
    told = mixing.mix(docs)
    got = told.toPandas()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows()}
    assert len(got) == len(rows()) and all(got["size"] == got["doc_id"].map(lambda i: size[None if i != i else i]))
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    by = defaultdict(int)
    for i, t, _, s, *_ in rows():
        by[s] += size[i]
    order = sorted(s for s in by if s is not None) + ([None] if None in by else [])
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    want, free, target = 1.5 * sum(by.values()), set(order), {}
    while True:
        level = (want - sum(2.0 * by[s] for s in by if s not in free)) / sum(weight[s] for s in free)
        full = {s for s in free if 2 * by[s] <= level * weight[s]}
        if not full:
            break
        free -= full
    target = {s: level * weight[s] if s in free else 2.0 * by[s] for s in by}
    assert sorted(set(got["target"].round(6))) == sorted({round(x, 6) for x in target.values()})
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert sorted(zip(got["doc_id"].fillna(-1), got["taken"])) == sorted(zip(again["doc_id"].fillna(-1), again["taken"]))
    assert abs(got["taken"].sum() - want) <= 0.1 * want
    assert mixing.mix(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard_equal_texts(docs).toPandas()
    n = got.groupby("shard").size()
    assert len(got) == len(rows()) and n.max() - n.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    plain = got[got["doc_id"].between(0, 399)].set_index("doc_id")
    for i, t, *_ in rows():
        if i is not None and i < 400:
            assert plain.loc[i, "size"] == len((t or "").encode()) + 1 and plain.loc[i, "text_crc32"] == zlib.crc32((t or "").encode())
    assert sum(plain.loc[k, "shard"] == plain.loc[100 + k, "shard"] for k in range(10)) >= 8
    assert sharding.shard_equal_texts(none).count() == 0


def test_sharding_group_larger_than_a_shard(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    n = sharding.shard_equal_texts(df).groupBy("shard").count().toPandas()["count"]
    assert n.max() - n.min() <= 1 and n.sum() == 300


def test_sharding_keeps_groups_in_few_shards(spark):
    """A group of half the rows fills four of the eight shards, one of 10 % lies in one, small ones too."""
    text = {i: "hot" if i % 3 else f"t{i}" if i % 10 else "warm" for i in range(3000)}
    text |= {3000 + i: f"pair{i // 2}" for i in range(600)} | {4000 + i: "tenth" for i in range(400)}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = sharding.shard_equal_texts(df).toPandas()
    got["text"] = got["doc_id"].map(text)
    n = got.groupby("shard").size()
    assert n.max() - n.min() <= 1 and len(got) == len(text)
    spread = got.groupby("text")["shard"].nunique()
    assert spread["hot"] == 4 and spread["tenth"] == spread["warm"] == 1 and spread.drop("hot").max() == 1


def test_propagation_lowers_the_cut_of_a_random_start(spark):
    """Half of the rows in groups of 2 to 40: every round keeps the law and cuts fewer links, the last none."""
    text, i = {}, 0
    for g in range(120):
        for _ in range(2 + g % 39):
            text[i] = f"group {g}"
            i += 1
    text |= {10_000 + k: f"alone {k}" for k in range(i)}
    df = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    found = []
    for rounds in (0, 1, 64):
        got = sharding.shard_equal_texts(df, rounds=rounds).join(df, "doc_id")
        n = got.groupBy("shard").count().toPandas()["count"]
        assert n.max() - n.min() <= 1 and n.sum() == len(text)
        found.append(sharding.cut_edges(got, "text"))
    assert found[0] > 10_000 and found[1] < found[0] / 5 and found[2] == 0


def test_propagation_when_every_row_is_linked(spark):
    """Pairs only: quotas bind in every shard, so some pairs are refused first and settle later."""
    df = spark.createDataFrame([(i, f"t{i // 2}") for i in range(1600)] + [(None, None)], "doc_id long, text string")
    got = sharding.shard_equal_texts(df)
    n = got.groupBy("shard").count().toPandas()["count"]
    assert n.max() - n.min() <= 1 and n.sum() == 1601
    assert sharding.cut_edges(got.join(df, "doc_id"), "text") <= 1


def test_token_store(spark, docs, none, tmp_path):
    def encoder():
        codec = chunks.byte_pair_codec(BYTES)
        return codec.encode, int(codec.width[-1])

    path = f"file://{tmp_path}/store"
    token_store.write(docs, path, encoder, "doc_id", block_ids=500)
    got = token_store.read(spark, path).collect()
    lib = Tokenizer.from_file(BYTES)
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 0]
    assert sorted((r["key"] or -1, bytes(r["ids"])) for r in got) == sorted((i or -1, np.array(ids(t), "<u4").tobytes()) for i, t, *_ in rows())
    keys = [r["key"] for r in sorted(got, key=lambda r: (r["start"], r["n_tokens"]))]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    asked = spark.createDataFrame([(0,), (205,), (400,), (999,), (None,)], "k long")
    found = {r["key"]: bytes(r["ids"]) for r in token_store.lookup(spark, path, asked, "k").collect()}
    text = {i: t for i, t, *_ in rows()}
    assert found == {k: np.array(ids(text[k]), "<u4").tobytes() for k in (0, 205, 400)}
    empty = f"file://{tmp_path}/empty"
    token_store.write(none, empty, encoder, "doc_id")
    assert token_store.read(spark, empty).count() == 0


@given(st.lists(st.integers(-(2**63), 2**63 - 1), unique=True, max_size=400))
@settings(max_examples=25, deadline=None)
def test_minimal_perfect_hash(keys):
    keys = np.array(keys, dtype=np.int64)
    seeds, prints, slots = token_store.build_index(keys)
    assert len(prints) == len(keys) and sorted(slots.tolist()) == list(range(len(keys)))
    assert token_store.find(keys, seeds, prints, slots).tolist() == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1000, 1400), keys)
    assert (token_store.find(others, seeds, prints, slots) >= 0).sum() <= 1


TEXTS = st.text(alphabet=st.sampled_from(list("ab cdé \n\t漢🎉'1. ▁<|>")), max_size=60)


@given(st.lists(TEXTS, max_size=8))
@settings(max_examples=60, deadline=None)
def test_chunk_tables_equal_the_libraries(texts):
    sp, lib = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
    texts = [*texts, "a<|endoftext|> b", "  x  ", None, ""]
    for t, (ids, text) in zip(texts, chunks.PieceCodec(PIECES, 50).encode_decode(texts)):
        want = [1, *sp.encode(t or ""), 2]
        assert ids == chunks.pack(want) and text == sp.decode(want)
    for t, ids in zip(texts, chunks.BytePairCodec(BYTES, 50).encode(texts)):
        assert ids == chunks.pack(lib.encode(t or "", add_special_tokens=False).ids, "<u2")


def test_encode_decode(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = piece_codec.encode_decode(docs, PIECES, ["doc_id", "size"]).collect()
    want = sorted((i or -1, np.array([1, *sp.encode(t or ""), 2], "<u4").tobytes(), t or "") for i, t, *_ in rows())
    assert sorted((r["doc_id"] or -1, bytes(r["ids"]), r["decoded"]) for r in got) == want
    assert piece_codec.encode_decode(none, PIECES, ["doc_id"]).count() == 0


@given(st.lists(st.sampled_from(["ab", " ", "  ", "é", "漢字", "x" * 50, "▁", "\n", "the", "🎉"]), min_size=30, max_size=200), st.integers(20, 80))
@settings(max_examples=40, deadline=None)
def test_resynchronised_counts(parts, chunk):
    text = "".join(parts)
    for path in (PIECES, BYTES):
        by = token_counts.counter(path)
        assert token_counts.count_long(text, by, chunk, 8) == by.counts([text])[0]


def test_token_counts(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.token_counts(docs, PIECES, ["doc_id"], chunk=64, overlap=16).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == sorted((i or -1, len(sp.encode(t or ""))) for i, t, *_ in rows())
    assert token_counts.token_counts(none, PIECES, ["doc_id"]).count() == 0


def _signed(x, bits):
    return x - (1 << bits) if x >> (bits - 1) else x


def _xx(value):
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return _signed(xxhash.xxh64(raw, seed=42).intdigest(), 64)


def _murmur(values):
    """The engine's 32-bit hash of an array of 64-bit integers: each one hashed with the last hash as seed."""
    full = 0xFFFFFFFF

    def turn(x, r):
        return ((x << r) | (x >> (32 - r))) & full

    h = 42
    for v in values:
        for half in struct.unpack("<II", struct.pack("<q", v)):
            k = turn(half * 0xCC9E2D51 & full, 15) * 0x1B873593 & full
            h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & full
        h ^= 8
        for mul, shift in ((0x85EBCA6B, 16), (0xC2B2AE35, 13)):
            h = (h ^ (h >> shift)) * mul & full
        h ^= h >> 16
    return _signed(h, 32)


def fingerprint_of(text, lexicon):
    held = {_xx(w) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w}
    out = []
    for band in (sorted(held & lexicon), sorted(_xx(t) for t in held)):
        for c in range(imatch.EACH):
            own = band
            for k in range(imatch.BITS):
                own = [t for t in own if not (t >> (c * imatch.BITS + k)) & 1]
                if k:
                    out.append(_murmur(own) % 0xFFFF + 1 if own else 0)
    return out


def likeness_of(a, b):
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def lexicon_of(texts, least, most):
    distinct = {t or "" for t in texts}
    df = Counter(w for t in distinct for w in {_xx(w) for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w})
    return {w for w, c in df.items() if max(2, least * len(distinct)) <= c <= max(2, most * len(distinct))}


@pytest.mark.parametrize("bound", [1_000_000, 10])
def test_fingerprints_equal_plain_python(docs, monkeypatch, bound):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", bound)
    got = imatch.edit_study(docs, least=0.01, most=0.3).toPandas()
    assert len(got) == len(rows())
    lexicon = lexicon_of([r[1] for r in rows()], 0.01, 0.3)
    assert lexicon == {r["term"] for r in imatch.lexicon(docs, "text", least=0.01, most=0.3).collect()} and len(lexicon) > 50
    order = sorted(rows(), key=lambda r: (r[0] is None, -(r[0] or 0)))  # the rows of id 400 are equal
    nexts = [*order[1:], order[0]]
    by = got.set_index("doc_id")
    for (i, text, *_), (_, after, *_) in zip(order, nexts):
        if i == 400:  # repeated rows differ in what follows them
            continue
        r = got[got["doc_id"].isna()].iloc[0] if i is None else by.loc[i]
        x, y = text or "", after or ""
        n = len(x) // 3
        new = x[: len(x) - n] + y[:n]
        own, edit, then = fingerprint_of(x, lexicon), fingerprint_of(new, lexicon), fingerprint_of(y, lexicon)
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{h:04x}" for h in own) and r["edited_fingerprint"] == "".join(f"{h:04x}" for h in edit)
        assert abs(r["near_edited"] - likeness_of(own, edit)) < 1e-9 and abs(r["near_next"] - likeness_of(own, then)) < 1e-9


def test_fingerprints_of_copies_and_nothing(spark, docs, none):
    """A group of copies of half the rows leaves its terms in the band, and its texts alike."""
    texts = {i: "hot " + " ".join(WORDS[:30]) if i % 2 else " ".join(WORDS[(i * 7) % 370 : (i * 7) % 370 + 30]) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    terms = {r["term"] for r in imatch.lexicon(df, "text", least=0.002, most=0.2).collect()}
    assert terms == lexicon_of(texts.values(), 0.002, 0.2) and _xx(WORDS[3]) in terms
    got = imatch.edit_study(df).toPandas().set_index("doc_id")
    assert got.loc[[i for i in texts if i % 2], "fingerprint"].nunique() == 1
    lex = imatch.lexicon(docs, "text", least=0.01, most=0.3)
    told = imatch.fingerprints(docs, lex, ["doc_id"], "text").collect()
    assert len(told) == len(rows()) and {r["fingerprint"] for r in told if r["doc_id"] in (300, 301, 302)} == {"0" * (4 * 2 * imatch.EACH * (imatch.BITS - 1))}
    assert imatch.edit_study(none).count() == 0 and imatch.fingerprints(none, lex, ["doc_id"], "text").count() == 0


def test_language(spark, small, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rest = keyed_mod(F.col("doc_id"), 4)
    told = langid.predict(docs, langid.fit(docs, rest != 2), ["doc_id", "lang"]).where(rest == 2).toPandas()
    assert (told["lang"] == told["lang_pred"]).mean() >= 0.95 and told["score"].between(0, 1).all()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !!"), (4, "the and of the")], "doc_id long, text string")
    model = langid.fit(docs, rest != 2)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in model.labels
    blank = langid.fit(none, F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(odd, blank, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(none, model, ["doc_id"]).count() == 0


def test_language_without_a_bound_on_labels(spark):
    """300 languages, the rarest with three documents to learn from, all of which can be predicted."""
    rng = np.random.default_rng(8)
    out = []
    for g in range(300):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4)) for _ in range(12)]
        out += [(1000 * g + k, " ".join(rng.choice(own, 40)), f"l{g:03}") for k in range(4 if g % 2 else 9)]
    out = [*out, *out[:3]]  # repeated rows
    df = spark.createDataFrame([(*r, "x", 0.5) for r in out], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(df, F.col("doc_id") % 4 != 3, most_rows=1200)
    assert len(model.labels) == 300
    told = langid.predict(df.select("doc_id", "text", "lang"), model, ["doc_id", "lang"]).toPandas()
    held = told[told["doc_id"] % 4 == 3]
    assert len(told) == len(out) and (held["lang"] == held["lang_pred"]).mean() > 0.95


def test_toxicity_features_of_long_words():
    """Runs of letters are read whole, as text without spaces has them."""
    run = "".join(chr(0x4E00 + i) for i in range(200))
    bad = "\u6bd2\u8a00\u75c5\u8bed\u6076"
    assert zlib.crc32(bad.encode(), 3) % toxicity.PLACES in toxicity.features(run + bad)
    assert toxicity.features(run + "a")[0:] != toxicity.features(run + "b")
    known = zlib.crc32(bad.encode(), 3) % toxicity.PLACES
    model = toxicity.ToxicityModel(np.array([known]), np.array([12.0]), -7.0)
    assert toxicity.sentence_scores(run + bad, model)[0][2] > 0.9 > toxicity.sentence_scores(run, model)[0][2]


def test_toxicity(spark, none):
    rng = np.random.default_rng(1)
    data, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        sentences = [" ".join(rng.choice(WORDS, 8)) for _ in range(6)]
        if bad:
            sentences[i % 6] += " " + ["vilestuff", "vilething", "awfulness"][i % 3]
        data.append((i, ". ".join(sentences)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*data, (900, None), (901, ""), (902, "!!!")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (950, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    rest = keyed_mod(F.col("doc_id"), 3)
    model = toxicity.fit(docs, labels, rest != 1)
    got = toxicity.score(docs, model, ["doc_id"]).toPandas().set_index("doc_id")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got.loc[i, "score"] >= toxicity.CUT) == (i % 4 == 0) for i in held]) >= 0.97
    assert (got.loc[[900, 901, 902], "score"] == 0).all()
    text = dict(data)
    for i in held:
        if i % 4 == 0 and got.loc[i, "score"] >= toxicity.CUT:
            assert re.search("vile|awful", text[i][int(got.loc[i, "top_start"]) : int(got.loc[i, "top_end"])])
            parts = toxicity.sentence_scores(text[i], model)
            assert abs(1 - np.prod([1 - p for *_, p in parts]) - got.loc[i, "score"]) < 1e-6
    blank = toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True))
    assert (toxicity.score(docs, blank, ["doc_id"]).toPandas()["score"] < 1e-6).all()
    assert toxicity.score(none, model, ["doc_id"]).count() == 0


def test_split_regions_keep_the_keys_of_their_first_orders(spark):
    """Regions against plain loops; signatures looked up for split regions are read for further orders only."""
    rng, base, depth, counts, most = np.random.default_rng(4), 1, 3, [2, 3, 5], 8
    sig = rng.integers(0, 3, (70, counts[-1] * depth)).astype(np.uint16)
    cells = lambda x: [(i, v.tobytes()) for i, v in enumerate(x)]
    reps = spark.createDataFrame(cells(sig[:, : counts[0] * depth]), "id long, sig binary")
    blank = sig.copy()
    blank[:, : counts[0] * depth] = 9
    asked = []

    def longer(ids):
        asked.append(ids)
        return spark.createDataFrame(cells(blank), "id long, sig binary").join(ids, "id", "left_semi").select("id", "sig")

    got = {(r["id"], r["tree"], bytes(r["key"]), r["size"]) for r in minhash._regions(reps, longer, counts, depth, base, most).collect()}
    want, rows = set(), {(i, t) for i in range(70) for t in range(counts[0])}
    for d in range(base, depth + 1):
        regions = {}
        for i, t in rows:
            regions.setdefault((t, *sig[i, t * depth : t * depth + d]), []).append(i)
        held = {k: v for k, v in regions.items() if len(v) > 1}
        large = {k: v for k, v in held.items() if len(v) > most and d < depth}
        want |= {(i, k[0], sig[i, k[0] * depth : (k[0] + 1) * depth].tobytes(), len(v)) for k, v in held.items() if k not in large for i in v}
        rows = {(i, k[0]) for k, v in large.items() for i in v}
        rows |= {(i, t) for i in {i for i, _ in rows} for t in range(counts[d - base], counts[min(d + 1, depth) - base])}
    assert got == want and len(asked) == 1
