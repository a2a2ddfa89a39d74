"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

import hashlib
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard

from causeway.llm import (
    bag_minhash, components, language_id, lattice_lm, line_quality, mixing, piece_sampling, quartile_digest, registry, repeats, sharding, token_frames,
)
from causeway.llm.piece_lattice import pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, id long"
PASSAGE = " ".join(f"passage{k}" for k in range(60))


def _rows():
    rng = np.random.default_rng(3)
    out = []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        stems = ["the", "ing", "tion", "er", "and"] if lang == "en" else ["der", "sch", "ung", "ein", "keit"]
        text = " ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(rng.integers(30, 120))) + "."
        if i % 7 == 0:
            text = f"{text}\n{PASSAGE}\nAll rights reserved."
        out.append((i, text, lang, f"src{i % 5}" if i % 3 else "src0", len(text), "x", i))
    base = out[1][1]
    words = base.split()
    out.append((60, base, "de", "src0", len(base), "x", 1))  # an exact copy
    words[len(words) // 2] = "changed"
    out.append((61, " ".join(words * 3), None, None, 0, None, None))
    words[0] = "other"
    out.append((62, " ".join(words * 3), "de", "src1", 0, "x", 2))  # a near copy of 61
    out += [(63, None, "en", "src2", None, "x", 3), (64, "", "en", "src2", 0, "x", 3), (65, " \n\t ", None, "src3", 4, "x", 3), (66, "1234 !!!", "en", "src3", 8, "x", 3)]
    out += [(67, "one", "en", "src0", 3, "x", 3), (68, "é漢字😀 ▁   x  y", "en", "src0", 9, "x", 3), (69, "long " * 30_000, "en", "src0", 150_000, "x", 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and null ids."""
    return spark.createDataFrame([*_rows()[:6], _rows()[2], _rows()[2], (None, _rows()[3][1], None, None, None, None, None), (None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


TEXTS = {r[0]: r[1] or "" for r in _rows()}


# ---- 1 -------------------------------------------------------------------------------------------


def _ways(vocabulary, logp, word):
    """Probability of a string by listing all segmentations."""
    ids = {vocabulary.raw[i].decode("utf-8", "ignore").replace(" ", "▁"): i for i in np.flatnonzero(vocabulary.normal)}

    def walk(at):
        if at == len(word):
            return 1.0
        total = 0.0
        for end in range(at + 1, len(word) + 1):
            i = ids.get(word[at:end])
            if i is not None:
                total += np.exp(logp[i]) * walk(end)
            elif end == at + 1:
                total += np.exp(sum(logp[vocabulary.byte_id[b]] for b in word[at:end].encode())) * walk(end)
        return total

    return walk(0)


def test_lattice_sums_all_segmentations():
    v = pieces(piece_sampling.model_path())
    logp = v.unigram(1e-4)
    strings = ["▁the", "▁tested", "▁é漢x", "▁a", "▁😀"]
    lattice = v.lattice(strings)
    alpha = lattice.forward(v.edge_weights(lattice.piece, logp))
    got = np.empty(len(strings))
    got[lattice.order] = alpha[lattice.final]
    assert np.allclose(got, [np.log(_ways(v, logp, s)) for s in strings])
    used = lattice.expected(v.edge_weights(lattice.piece, logp), alpha, np.ones(len(strings)))
    into_end = [used[lattice.dst == n].sum() for n in lattice.final]
    assert np.allclose(into_end, 1)


def test_lm_counts_and_base(docs):
    got = {r["doc_id"]: r for r in lattice_lm.score(docs, docs["doc_id"] % 4 != 1, label="lang").collect()}
    train = [t.encode().lower().split() for i, t in TEXTS.items() if i % 4 != 1]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()) + len(train), len(c) + 1
    for i, t in TEXTS.items():
        words = t.encode().lower().split()
        base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words) + np.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words) + 1, sum(c[w] > 0 for w in words) + 1, n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
        assert r["score"] < 0
    held = [i for i in range(60) if i % 4 == 1]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_document_scores_by_listing_segmentations(spark):
    """Without training the score is the lattice's; with it the lexicon's share and the lattice's are added word by word."""
    texts = {0: "The tested é", 1: "a the a", 2: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    v = pieces(piece_sampling.model_path())
    logp = v.unigram(lattice_lm.ALPHA)
    alone = {i: sum(np.log10(_ways(v, logp, "▁" + w.decode())) for w in lattice_lm.tokens(t)) for i, t in texts.items()}
    size = {i: len(lattice_lm.tokens(t)) for i, t in texts.items()}
    for r in lattice_lm.score(docs, docs["doc_id"] < 0).collect():
        i = r["doc_id"]
        assert abs(r["score"] - (alone[i] + np.log10(0.1))) < 1e-9
        assert abs(r["lattice_score"] - (alone[i] + size[i] * np.log10(0.9) + np.log10(0.1))) < 1e-9
    end = 3 / (sum(size.values()) + 3)
    for r in lattice_lm.score(docs, docs["doc_id"] >= 0).collect():
        i = r["doc_id"]
        assert abs(r["lattice_score"] - (alone[i] + size[i] * np.log10(1 - end) + np.log10(end))) < 1e-9
    words, counts, n, types = [b"the", b"unseen"], np.array([[3, 0], [0, 0]]), np.array([10, 0]), np.array([4, 0])
    got = lattice_lm.lexicon_and_lattice(v, np.stack([logp, logp]), words, counts, n, types)
    for k, w in enumerate(words):
        ways = _ways(v, logp, "▁" + w.decode())
        d = lattice_lm.DISCOUNT
        assert np.allclose(got[k], [np.log10(max(counts[k, 0] - d, 0) / 10 + d * 4 / 10 * ways), np.log10(ways), np.log10(ways)])


def test_word_batches_are_cut_by_bytes():
    import pandas as pd

    words = pd.Series([b"x" * n for n in (5, 300_000, 1, 150_000, 60_000, 7)])
    cuts = list(lattice_lm._batches(words))
    assert [k for s in cuts for k in range(s.start, s.stop)] == list(range(6))
    assert all(s.stop - s.start == 1 or words[s].str.len().sum() <= lattice_lm.BATCH_BYTES for s in cuts)


def test_lm_edges(odd, none):
    assert lattice_lm.score(odd, odd["doc_id"] >= 0).count() == odd.count()
    assert lattice_lm.score(odd, odd["doc_id"] < 0).where("score < 0").count() == odd.count()
    assert lattice_lm.score(none, none["doc_id"] >= 0).count() == 0


# ---- 2 -------------------------------------------------------------------------------------------


def test_token_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = token_frames.vocabulary_path()
    t = Tokenizer.from_file(path)
    folder = f"file://{tmp_path}/tokens"
    token_frames.write_tokens(docs, folder, path)
    want = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes() for i, x in TEXTS.items()}
    read = token_frames.read_tokens(spark, folder)
    rows = read.collect()
    assert {r["doc_id"]: bytes(r["ids_le"]) for r in rows} == want
    from pyspark.sql import functions as F

    starts = token_frames.with_starts(read.withColumn("n_tokens", (F.length("ids_le") / 4).cast("long"))).orderBy("doc_id").collect()
    at = 0
    for r in starts:
        assert r["start"] == at
        at += len(want[r["doc_id"]]) // 4
    for _ in range(2):  # the index is made once, then read
        some = token_frames.read_tokens(spark, folder, [3, 4, 999])
        assert {r["doc_id"]: bytes(r["ids_le"]) for r in some.collect()} == {k: want[k] for k in (3, 4)}
        assert len(some.inputFiles()) < len(read.inputFiles())
    assert token_frames.read_tokens(spark, folder, [999]).count() == 0
    # any zstandard reader gets the whole of a file, and a broken frame is told
    for f in (tmp_path / "tokens").glob("part-*"):
        content = f.read_bytes()
        parsed = token_frames.File(content)
        whole = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).readall()
        assert whole == b"".join(parsed.document(k) for k in range(len(parsed.ids)))
        assert struct.unpack("<I", content[-4:])[0] == 0x8F92EAB1
        bad = token_frames.File(content[:-13] + bytes([content[-13] ^ 1]) + content[-12:])
        with pytest.raises(ValueError):
            bad.document(len(bad.ids) - 1)


def test_broken_and_stale_indexes(spark, docs, tmp_path):
    """A write of the index that broke off, and one of another state of the folder, are not read."""
    folder, path = tmp_path / "tokens", token_frames.vocabulary_path()
    token_frames.write_tokens(docs, f"file://{folder}", path, partitions=2)
    assert token_frames.read_tokens(spark, f"file://{folder}", [3, 4]).count() == 2
    (index,) = folder.glob("_index-*")
    for done in index.glob("*/_SUCCESS"):
        done.unlink()
    (index / "broken" / "_temporary").mkdir(parents=True)
    (folder / "_index" / "_temporary").mkdir(parents=True)
    assert token_frames.read_tokens(spark, f"file://{folder}", [3, 4]).count() == 2
    more = tmp_path / "more"
    token_frames.write_tokens(docs.where("doc_id = 5").selectExpr("doc_id + 1000 as doc_id", "text"), f"file://{more}", path, partitions=1)
    for f in more.glob("part-*"):
        f.rename(folder / f"{f.name}-more")
    assert token_frames.read_tokens(spark, f"file://{folder}", [3, 1005]).count() == 2
    next(iter(folder.glob("*-more"))).unlink()
    assert token_frames.read_tokens(spark, f"file://{folder}", [3, 1005]).count() == 1


def test_encoder_equals_tokenizer():
    e = token_frames.Encoder(token_frames.vocabulary_path())
    odd = ["", "a", " a", "a  b", "a   b", "foo\n bar", "foo \nbar", "foo\n \nbar", " x ", "a\xa0 \xa0b", "it's don't\tx\r\n y", "<|endoftext|> x", "漢字 test😀 é", "a\x1cb \x1c c", "word. next!!  (x)\n\nY\n", "don't. x1. 12, a-b"]
    for t in [*odd, *odd, *TEXTS.values()]:
        assert list(np.frombuffer(e.encode(t), "<u4")) == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_query_digests(spark, docs, tmp_path):
    import zlib

    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    e = token_frames.encoder(token_frames.vocabulary_path())
    rows = sorted(token_frames.op2_token_frames(spark, f"file://{tmp_path}").collect(), key=lambda r: r["doc_id"])
    at = 0
    for r in rows:
        raw = e.encode(TEXTS[r["doc_id"]]) + struct.pack("<I", token_frames.END_ID)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4


def test_token_files_edges(spark, odd, none, tmp_path):
    for k, df in enumerate((odd, none)):
        token_frames.write_tokens(df, f"file://{tmp_path}/e{k}", token_frames.vocabulary_path())
    assert token_frames.read_tokens(spark, f"file://{tmp_path}/e0").count() == odd.count()


# ---- 3 -------------------------------------------------------------------------------------------


def test_language(docs, odd, none):
    model = language_id.fit(docs.where("doc_id % 3 != 1"))
    rows = language_id.identify(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r["doc_id"] < 60:
            assert r["lang_pred"] == ("en" if r["doc_id"] % 2 == 0 else "de") and not r["rejected"] and 0 < r["score"] <= 1
        if r["doc_id"] in (63, 64, 65, 66):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert language_id.identify(odd, model).count() == odd.count()
    assert language_id.identify(none, language_id.fit(none)).count() == 0
    assert language_id.identify(odd, language_id.fit(none)).where("lang_pred = 'und'").count() == odd.count()


def _plain_grams(text):
    """Hashed letter grams with plain integers."""
    m = 2**32
    points, gap = [0], True
    for c in text.lower():
        if c.isalpha():
            points.append(ord(c))
            gap = False
        elif not gap:
            points.append(0)
            gap = True
    if not gap:
        points.append(0)
    a = [p * 0x9E3779B1 % m for p in points]
    two = [((x ^ (y >> 7)) * 0x85EBCA6B + y) % m for x, y in zip(a, a[1:])]
    three = [((x ^ (y >> 5)) * 0xC2B2AE35 + y) % m for x, y in zip(two, a[2:])]
    h = [(x + 1) % m for x in a if x] + two + three
    return Counter((((x ^ (x >> 15)) * 0x2C1B3C6D % m) >> 19) for x in h)


def test_language_by_brute_force(docs):
    """Frequencies, vectors, centroids and the rejection floor, one number at a time."""
    train = {i: (t, r[2]) for i, t in TEXTS.items() if i % 3 != 1 for r in [_rows()[i]] if r[1] is not None and r[2] is not None}
    model = language_id.fit(docs.where("doc_id % 3 != 1"))
    seen = Counter(g for t, _ in train.values() for g in _plain_grams(t))
    idf = {d: np.log((1 + len(train)) / (1 + n)) + 1 for d, n in seen.items()}
    assert all(abs(model.idf[d] - x) < 1e-5 for d, x in idf.items())

    def vector(text):
        v = np.zeros(language_id.DIMENSIONS)
        for d, n in _plain_grams(text).items():
            v[d] = np.log1p(n) * model.idf[d]
        return v / (np.linalg.norm(v) or 1)

    for lang in ("en", "de"):
        rows = np.stack([vector(t) for t, own in train.values() if own == lang and _plain_grams(t)])
        centres = model.centres[[k for k, name in enumerate(model.langs) if name == lang]]
        near = np.argmax(rows @ centres.T, axis=1)
        for k in set(near):  # a centroid is the unit mean of the texts nearest to it
            mean = rows[near == k].sum(0)
            assert np.allclose(centres[k], mean / np.linalg.norm(mean), atol=1e-4)
        floor = language_id.REJECT_PART * np.quantile((rows @ centres.T).max(axis=1), 0.001)
        assert abs(model.floors[model.langs.index(lang)] - floor) < 1e-4
    for r in language_id.identify(docs, model).collect():
        t = TEXTS[r["doc_id"]]
        if not _plain_grams(t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        cos = model.centres @ vector(t)
        assert r["lang_pred"] == model.langs[int(np.argmax(cos))] and abs(r["score"] - cos.max()) < 1e-4
        assert r["rejected"] == (r["score"] < model.floors[int(np.argmax(cos))])


# ---- 4 -------------------------------------------------------------------------------------------


def _kept(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = texts[i].encode().split()
        gone = set()
        for k in range(len(w) - 19):
            g = b" ".join(w[k : k + 20])
            if g in seen:
                gone |= set(range(k, k + 20))
            seen.add(g)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_repeats(docs, odd, none):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in repeats.without_repeats(docs).collect()}
    assert got == _kept(TEXTS)
    assert got[69][1] > 29_000
    assert "rank" in repeats.without_repeats(docs).columns
    assert repeats.without_repeats(odd).count() == odd.count()
    assert repeats.without_repeats(none).count() == 0


def test_repeated_rows_keep_their_text(spark):
    long = {i: " ".join(f"w{i}_{k}" for k in range(30 + i)) for i in range(4)}
    rows = [*long.items(), (2, long[2]), (2, long[2]), (5, f"{long[1]} {long[2]} end")]
    for parts in (1, 4):
        got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert len(got) == len(rows)
        assert {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in got} == {(i, 0, t) for i, t in long.items()} | {(5, 63, "end")}


# ---- 5 -------------------------------------------------------------------------------------------


def test_sharding(docs, odd, none):
    table = sharding.fill_table(["a", "b", "c"], 101)
    assert sorted(Counter(table).values()) == [33, 34, 34]
    less = sharding.fill_table(["a", "b"], 101)
    moved = sum(x != y for x, y in zip(table, less, strict=True) if x != 2)
    assert moved < 35
    heavy = Counter(sharding.fill_table(["a", "b"], 101, {"a": 3}))
    assert 74 <= heavy[0] <= 77
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)
    # brute force: every slot goes to the shard whose turn takes it
    walks = []
    for name in "abc":
        d = hashlib.md5(name.encode()).digest()
        walks.append([(int.from_bytes(d[:8], "big") + j * (int.from_bytes(d[8:], "big") % 100 + 1)) % 101 for j in range(101)])
    brute, turn = {}, 0
    while len(brute) < 101:
        brute[next(s for s in walks[turn % 3] if s not in brute)] = turn % 3
        turn += 1
    assert [brute[s] for s in range(101)] == table
    placed = sharding.place(docs, "source", "doc_id", ["a", "b", "c"], 101).collect()
    assert len(placed) == docs.count() and all(r["shard"] == "abc"[table[r["slot"]]] for r in placed)
    assert len({r["part"] for r in placed if r["source"] == "src0"}) > 1
    assert sharding.place(odd, "source", "doc_id", ["a"], 101).count() == odd.count()
    assert sharding.place(none, "source", "doc_id", ["a"], 101).count() == 0


def test_loads_are_even(spark):
    """Few sources, one with a third of all rows."""
    from pyspark.sql import functions as F

    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 13)).alias("source"))
    loads = [r["count"] for r in sharding.place(docs, "source", "doc_id", sharding.SHARDS).groupBy("shard").count().collect()]
    assert len(loads) == 64 and max(loads) < 1.4 * 60_000 / 64
    rows = sharding.place(docs.where("doc_id < 300"), "source", "doc_id", ["a", "b"], 101, parts_per_shard=2).collect()
    number = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:12], 16)
    for r in rows:
        parts = -(-100 * 4 // 300) if r["source"] == "big" else 0
        assert r["part"] == (number(r["doc_id"]) % parts if parts else 0) and r["slot"] == number(r["source"], r["part"]) % 101


# ---- 6 -------------------------------------------------------------------------------------------


def _plain_digest(text):
    raw = text.encode()
    at = lambda k: raw[k] if k < len(raw) else 0
    count = [0] * 1024
    for k in range(len(raw)):
        h = (at(k) | at(k + 4) << 8 | at(k + 8) << 16) * 0x9E3779B1 % 2**32
        h = (h ^ (h >> 15)) * 0x85EBCA6B % 2**32
        count[h >> 22] += 1
    q = [sorted(count)[k] for k in (255, 511, 767)]
    code = [sum(c > x for x in q) for c in count]
    out = f"q1{min(255, round(8 * float(np.log2(1 + len(raw))))):02x}"
    return out + "".join(f"{code[k] | code[k + 1] << 2 | code[k + 2] << 4 | code[k + 3] << 6:02x}" for k in range(0, 1024, 4))


def test_digests_by_brute_force(docs):
    got = {r["doc_id"]: r["fingerprint"] for r in quartile_digest.fingerprints(docs).collect()}
    assert got == {i: _plain_digest(t) for i, t in TEXTS.items()}

    def likeness(a, b):
        codes = lambda d: [int(d[k : k + 2], 16) >> s & 3 for k in range(4, len(d), 2) for s in (0, 2, 4, 6)]
        steps = [abs(x - y) for x, y in zip(codes(a), codes(b))]
        total = sum(6 if x == 3 else x for x in steps) + 4 * max(0, abs(int(a[2:4], 16) - int(b[2:4], 16)) - 1)
        return 1 - min(total, 1536) / 1536

    for i, j in ((0, 2), (1, 60), (61, 62), (64, 5), (69, 3)):
        assert abs(quartile_digest.likeness(quartile_digest.parse(got[i]), quartile_digest.parse(got[j])) - likeness(got[i], got[j])) < 1e-12


def test_digests(docs, odd, none):
    got = {r["doc_id"]: r for r in quartile_digest.compare_with_next(docs, 4).collect()}
    ids = sorted(TEXTS, reverse=True)
    for k, i in enumerate(ids):
        t, nx = TEXTS[i], TEXTS[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 3] + nx[: len(t) // 3]
        r = got[i]
        code = lambda x: quartile_digest.codes(x)
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == quartile_digest.digest(*code(t)) and r["edited_fingerprint"] == quartile_digest.digest(*code(edited))
        assert r["near_edited"] == quartile_digest.likeness(code(t), code(edited)) and r["near_next"] == quartile_digest.likeness(code(t), code(nx))
    long = [r for i, r in got.items() if i < 60]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.2
    a = quartile_digest.codes("some text")
    assert quartile_digest.likeness(a, a) == 1 and (quartile_digest.parse(quartile_digest.digest(*a))[1] == a[1]).all()
    assert quartile_digest.compare_with_next(odd, 2).count() == odd.count()
    assert quartile_digest.compare_with_next(none, 2).count() == 0


# ---- 7 -------------------------------------------------------------------------------------------


def _jaccard(a, b):
    bag = lambda t: (lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter())(t.encode().split())
    x, y = bag(a), bag(b)
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def test_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(20):
        base = [f"w{i}" for i in rng.integers(0, 40, 200)]
        other = list(base)
        for _ in range(rng.integers(0, 10)):
            other[rng.integers(0, 200)] = "z"
        a, b = " ".join(base * 2).encode(), " ".join(other + base).encode()
        s = bag_minhash.signatures(2, *bag_minhash.bags([a, b]), slots=1000)
        gaps.append((s[0] == s[1]).mean() - _jaccard(a.decode(), b.decode()))
        assert abs(bag_minhash.likeness(a, b) - _jaccard(a.decode(), b.decode())) < 1e-12
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.04


def test_near_classes(docs, odd, none):
    got = {r["doc_id"]: r for r in bag_minhash.near_classes(docs).collect()}
    parent = {i: i for i in TEXTS}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(TEXTS)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if TEXTS[i] == TEXTS[j] or _jaccard(TEXTS[i], TEXTS[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in ids}
    assert got[60]["text_id"] == 1 and got[62]["class_id"] == 61
    assert bag_minhash.near_classes(odd).count() == odd.count()
    # ids 0 to 5 and the two null ids, of which one repeats the text of 3
    assert 6 <= bag_minhash.one_per_class(odd).count() <= 8
    assert bag_minhash.near_classes(none).count() == 0


def test_links_inside_a_template_family(spark, monkeypatch):
    """All pairs are at likeness of about 0.76, a few in the middle of the ids over 0.8."""
    rng = np.random.default_rng(1)
    base = [f"t{k}" for k in range(300)]
    texts = {}
    for i in range(60):
        words = list(base)
        for p in rng.choice(60, 4, replace=False):
            words[p * 5 + 2] = f"own{i}_{p}"
        texts[i] = words
    for i, j in ((20, 35), (27, 31), (35, 41)):
        p = next(p for p in range(2, 300, 5) if texts[i][p] != base[p] == texts[j][p])
        q = next(q for q in range(2, 300, 5) if texts[j][q] != base[q] == texts[i][q])
        texts[j][q], texts[j][p] = base[q], texts[i][p]
    texts = {i: " ".join(w) for i, w in texts.items()}
    links = [(i, j) for i in texts for j in texts if i < j and _jaccard(texts[i], texts[j]) >= 0.8]
    want = {i: i for i in texts}
    for _ in texts:
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    assert len(set(want.values())) > 20 and want[20] == want[35] == want[41] and want[27] == want[31]
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in bag_minhash.near_classes(docs).collect()} == want
    # several blocks, and products of matrices, give the same pairs
    raws, labels = [t.encode() for t in texts.values()], np.arange(60)
    assert set(zip(*map(list, bag_minhash._linked(raws, 0, labels)), strict=True)) == set(links)
    assert set(zip(*map(list, bag_minhash._linked(raws, 30, labels)), strict=True)) == {(i, j) for i, j in links if i < 30 <= j}
    monkeypatch.setattr(bag_minhash, "BLOCK_MEMBERS", 7)
    assert {r["doc_id"]: r["class_id"] for r in bag_minhash.near_classes(docs).collect()} == want


def test_recall_among_texts_of_one_template(spark):
    """1,000 texts share 400 words and have 52 of their own; 80 pairs are at a likeness of 0.84, others below 0.8."""
    rng = np.random.default_rng(9)
    shared = [f"s{k}" for k in range(400)]
    texts = {i: shared + [f"o{i}_{k}" for k in range(52)] for i in range(1000)}
    pairs = [(2 * k, 999 - 2 * k) for k in range(80)]
    for a, b in pairs:
        texts[b] = shared + texts[a][400:415] + texts[b][415:]
    assert all(0.8 <= _jaccard(" ".join(texts[a]), " ".join(texts[b])) < 0.85 for a, b in pairs)
    assert _jaccard(" ".join(texts[1]), " ".join(texts[3])) < 0.8
    docs = spark.createDataFrame([(int(i), " ".join(texts[i])) for i in rng.permutation(1000)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in bag_minhash.near_classes(docs).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * 80
    assert len(set(got.values())) >= 920


def test_hot_keys_are_looked_up_apart(spark):
    from pyspark.sql import functions as F

    from causeway.llm.common import hot_keys, looked_up

    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = spark.range(0, 9000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    assert [r["k"] for r in hot_keys(rows, ["k"]).collect()] == [0]
    got = looked_up(rows, table, ["k"], "left").collect()
    assert sorted((r["id"], r["v"]) for r in got) == sorted((i, (k := 0 if i % 3 == 0 else i) * 10 if (0 if i % 3 == 0 else i) % 2 == 0 else None) for i in range(9000))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["id"]: r["label"] for r in components.components(spark.createDataFrame(links, "lo long, hi long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert components.components(spark.createDataFrame([], "lo long, hi long")).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------


def test_budgets_fill_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 30), ("b", "y", 30)], "l0 string, l1 string, tokens long")
    got = {(r["l0"], r["l1"]): r["budget"] for r in mixing.split_budget(leaves, ["l0", "l1"], 200, {}, 1).collect()}
    # b can't take its 100, so 40 go to a; within a the shortage of x goes to y
    assert got == {("a", "x"): 10, ("a", "y"): 130, ("b", "x"): 30, ("b", "y"): 30}
    two = {(r["l0"], r["l1"]): r["budget"] for r in mixing.split_budget(leaves, ["l0", "l1"], 10_000, {}, 2).collect()}
    assert two == {k: 2 * v for k, v in {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 30, ("b", "y"): 30}.items()}


def test_mixture(docs, odd, none):
    out = mixing.mix(docs, mixing.by_domain(), mixing.DOMAINS | mixing.LANGS, share=0.4, max_epochs=2, seed=5).collect()
    taken = sum(len(TEXTS[r["doc_id"]].split()) * r["epochs"] for r in out)
    total = sum(len(t.split()) for t in TEXTS.values())
    assert len({r["doc_id"] for r in out}) == len(out) and 0 < taken <= 0.4 * total
    again = mixing.mix(docs.repartition(5), mixing.by_domain(), mixing.DOMAINS | mixing.LANGS, share=0.4, max_epochs=2, seed=5).collect()
    assert sorted((r["doc_id"], r["epochs"]) for r in out) == sorted((r["doc_id"], r["epochs"]) for r in again)
    everything = mixing.mix(odd, mixing.by_domain(), {}, share=1.0)
    assert everything.count() >= odd.where("length(trim(text)) > 0").count()
    assert mixing.mix(none, mixing.by_domain(), {}, share=0.5).count() == 0


def brute_mixture(rows, share, max_epochs, seed, weights):
    """{doc_id: epochs} of (doc_id, text, (levels)) by plain recursion and sorting; ids are distinct."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    leaves = {}
    for i, _, path in rows:
        leaves.setdefault(path, []).append(i)
    weight = lambda path: weights.get("/".join(path), weights.get(path[-1], 1))
    budget = {}

    def give(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            budget[prefix] = amount
            return
        below = sorted({p[: depth + 1] for p in leaves if p[:depth] == prefix})
        cap = {b: max_epochs * sum(size[i] for p, ids in leaves.items() if p[: depth + 1] == b for i in ids) for b in below}
        left, open_, full = amount, set(below), {}
        while True:
            total = sum(weight(b) for b in open_)
            done = [b for b in open_ if cap[b] * total <= left * weight(b)]
            if not done:
                break
            for b in done:
                full[b] = cap[b]
                open_.discard(b)
            left = amount - sum(full.values())
        for b in below:
            give(b, full[b] if b in full else left * weight(b) // sum(weight(x) for x in open_))

    give((), int(sum(size.values()) * share))
    out = {}
    for path, ids in leaves.items():
        tokens = sum(size[i] for i in ids)
        if not tokens:
            continue
        whole, rest = divmod(budget[path], tokens)
        upto = 0
        for i in sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{whole}|{i}".encode()).hexdigest()):
            upto += size[i]
            out[i] = whole + (upto <= rest)
    return {i: n for i, n in out.items() if n}


def levels_of(row):
    number = int(row[3][3:]) if row[3] else None
    return (f"d{number % 4 if number is not None else 0}", row[2] or "(null)", row[3] or "(null)")


def test_mixture_by_sorting(docs, monkeypatch):
    rows = [(r[0], r[1], levels_of(r)) for r in _rows()]
    for sorted_rows in (256, 1):
        monkeypatch.setattr(mixing, "SORTED_ROWS", sorted_rows)
        for share, epochs in ((0.4, 2), (0.8, 1), (1.7, 3)):
            got = mixing.mix(docs, mixing.by_domain(), mixing.DOMAINS | mixing.LANGS, share=share, max_epochs=epochs, seed=5).collect()
            assert {r["doc_id"]: r["epochs"] for r in got} == brute_mixture(rows, share, epochs, 5, mixing.DOMAINS | mixing.LANGS)


# ---- 9 -------------------------------------------------------------------------------------------


def test_lines(docs, odd, none):
    rows = {r["doc_id"]: r for r in line_quality.clean_lines(docs).collect()}
    assert "All rights reserved" not in rows[0]["cleaned_text"] and rows[0]["n_lines_failed"] >= 1
    for i, t in TEXTS.items():
        w = t.encode().split()
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
        r = rows[i]
        assert (r["n_words"], r["n_repeat_words"], r["n_symbols"]) == (len(w), len(covered), sum(t.count(c) for c in "#*$%&|<>"))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert line_quality.clean_lines(odd).count() == odd.count()
    assert line_quality.clean_lines(none).count() == 0


def test_notices_in_other_languages(spark):
    prose = "\n".join(" ".join(f"wort{k}{x}" for x in "abcdefgh") + f" eines Textes{k}." for k in range(12))
    lines = ["Alle Rechte vorbehalten.", "Tous droits réservés 2020.", "Todos los derechos reservados.", "Impressum und Kontakt.", "Inicio Noticias Deportes.", "Start » Themen » Autor » Archiv", "https://a.example/x www.b.example."]
    docs = spark.createDataFrame([(1, prose + "\n" + "\n".join(lines))], "doc_id long, text string")
    r = line_quality.clean_lines(docs).first()
    assert r["cleaned_text"] == prose and r["n_lines_failed"] == len(lines) and r["kept"]
    own = line_quality.clean_lines(docs, boilerplate={"x": "eines Textes"}).first()
    assert own["n_lines_failed"] >= 12 and not own["kept"]


# ---- 10 ------------------------------------------------------------------------------------------


def test_pieces_round_trip(docs, odd, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.model_path())
    coded = piece_sampling.encode(docs)
    rows = piece_sampling.decoded(coded).collect()
    for r in rows:
        assert r["decoded_text"] == r["text"]
        if r["text"]:
            assert sp.decode(list(r["piece_ids"])) == r["text"]
    again = {r["doc_id"]: r["piece_ids"] for r in piece_sampling.encode(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["piece_ids"] for r in rows}
    other = {r["doc_id"]: r["piece_ids"] for r in piece_sampling.encode(docs, seed=1).collect()}
    assert sum(other[i] != again[i] for i in range(60)) > 50
    assert piece_sampling.encode(odd).count() == odd.count() and piece_sampling.encode(none).count() == 0


def test_draws_follow_the_lattice():
    v = pieces(piece_sampling.model_path())
    draw = piece_sampling.Sampler(v, 1e-4)
    seen = Counter(tuple(x) for x in draw.sample(["tested"] * 20_000, np.arange(20_000).astype(np.uint64)))
    logp = v.unigram(1e-4)
    weight = {k: np.exp(logp[list(k)].sum()) for k in seen}
    total = _ways(v, logp, "▁tested")
    for k, n in seen.items():
        p = weight[k] / total
        assert abs(n / 20_000 - p) < 5 * np.sqrt(p * (1 - p) / 20_000) + 1e-4


# ---- queries and SQL -----------------------------------------------------------------------------


def test_queries_match_sql(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, f"file://{tmp_path}")
        cols = sorted(df.columns)
        mine = sorted(str([r[c] for c in cols]) for r in df.collect())
        want = con.sql(sql)
        at = [want.columns.index(c) for c in cols]
        assert mine == sorted(str([r[k] for k in at]) for r in want.fetchall()), name


# ---- columns with any name -----------------------------------------------------------------------


def test_clashing_names_stay(spark):
    names = ["key", "row", "trains", "told", "hot", "parts", "limit", "l0", "l1", "order", "cut", "check", "lines", "w", "ordered", "left", "full", "id", "given", "_row", "_id", "_l0", "_n"]
    rows = [(i, f"some words of text {i} " * (3 + i), "en", "s1", *[f"{n}{i}" for n in names]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    made = {
        "op1": lattice_lm.score(docs, docs["doc_id"] > 1, label="lang"), "op3": language_id.identify(docs, language_id.fit(docs)), "op4": repeats.without_repeats(docs),
        "op5": sharding.place(docs, "source", "doc_id", ["a", "b"], 101), "op6": quartile_digest.fingerprints(docs), "op7": bag_minhash.one_per_class(docs),
        "op8": mixing.mix(docs, mixing.by_domain(), {}, share=1.0), "op9": line_quality.clean_lines(docs), "op10": piece_sampling.encode(docs),
    }
    for name, df in made.items():
        got = df.collect()
        assert got and set(names) <= set(df.columns), name
        for r in got:
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names], name


def test_rows_with_one_id_and_two_texts(spark):
    """No crash, and the same result in any partitioning."""
    texts = [(1, " ".join(f"a{k}" for k in range(100))), (1, "short text of one line"), (2, " ".join(f"a{k}" for k in range(100))), (2, None)]
    seen = set()
    for parts in (1, 3):
        docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(parts)
        seen.add((
            tuple(sorted((r["doc_id"], r["n_words"]) for r in repeats.without_repeats(docs).collect())),
            tuple(sorted((r["doc_id"], r["text"] or "") for r in bag_minhash.one_per_class(docs).collect())),
            tuple(sorted(r["epochs"] for r in mixing.mix(docs, {"d": docs["doc_id"]}, {}, share=1.0).collect())),
        ))
    assert len(seen) == 1
