"""Byte-level BPE, quality ledger, toxicity, mixing, suffix and near-duplicate removal."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import bpe, mixing, quality, queries, repeats, simhash, suffix_dedup, toxicity
from tidemill.llm.common import written
from tidemill.llm.components import components

LONG = "lorem ipsum dolor " * 9000
ROWS = [
    (1, "The cat's  hat\n\tsat, 12½ é漢 <|endoftext|> \x1c", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, LONG, "de", "b"),
    (5, "one two three four five six seven", "en", "a"),
    (5, "one two three four five six seven", "en", "a"),
    (None, "no id here \x00 😀", "fr", "b"),
    (7, "   \n\t ", "en", "c"),
]
EMPTY = "doc_id long, text string, lang string, source string, n_words long, ids string, fp string, m string, text_ string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, 9, "x", "y", "z", "w") for r in ROWS]
    return spark.createDataFrame(rows, EMPTY)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], EMPTY)


def test_bpe_equals_tiktoken_and_round_trips(docs, none):
    import tiktoken

    ranks, pattern = bpe.read_ranks(queries.tokenizer_file()), queries.tokenizer_pattern()
    other = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode_decode(docs, queries.tokenizer_file(), pattern).collect()
    want = Counter((r[0], tuple(other.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in ROWS)
    assert Counter((r[0], struct.unpack(f"<{len(r[1]) // 4}I", r[1]), bytes(r[2])) for r in out) == want
    assert bpe.digests(bpe.encode_decode(none, queries.tokenizer_file(), pattern)).count() == 0
    codec, rng = bpe.Codec(bpe.serialise_model(ranks), pattern), random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice("ab '  \n\t\x1c\x1f\x85\xa0½Ⅷé漢'sre.,!?\x00😀_") for _ in range(rng.randint(0, 30)))
        got = codec.encode(s)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == other.encode_ordinary(s) and codec.decode(got) == s.encode()


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_ledger(spark, docs, none):
    rng = random.Random(2)
    texts = [r[1] for r in ROWS] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "a b c d e "]) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert [quality.measure(t or "")[:5] for t in texts] == [brute_measures(t) for t in texts]
    rows = quality.ledger(docs)
    assert rows.count() == len(ROWS) and quality.ledger(none).count() == 0
    few = {(r["doc_id"], r["failed_rules"] & 1) for r in rows.collect()}
    assert (4, 0) in few and (2, 1) in few and (5, 1) in few
    cut = {r["rule"]: (r["failed"], r["only_this"]) for r in quality.ablation(rows).collect()}
    assert cut["few_words"][0] == 7 and cut["repeated_windows"] == (1, 1)
    assert {r["failed"] for r in quality.ablation(quality.ledger(none)).collect()} == {0}
    kept = quality.keep(docs, "base")
    assert kept.columns == docs.columns and kept.schema == docs.schema and kept.count() == 0 and quality.keep(docs.where("doc_id = 1"), "base").count() == 0


def test_toxicity_held_out_misspellings(spark, docs, none):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ne", "to", "ri", "su"]) for _ in range(rng.randint(1, 3)))
    insult = lambda: rng.choice(["grunfkopf", "wexelzunt", "plorvak"]) + rng.choice(["", "e", "en", "er", "st"])
    rows = []
    for i in range(900):
        words = [word() for _ in range(rng.randint(8, 200))]
        toxic = int(i % 3 == 0)
        for _ in range(1 + len(words) // 40 if toxic else 0):
            words[rng.randrange(len(words))] = insult()
        rows.append((i, " ".join(words), toxic))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = frame.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int"))
    got = toxicity.score(frame, toxicity.train(frame, labels)).toPandas().set_index("doc_id")["score"]
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95
    flat = toxicity.train(none, labels.limit(0))
    assert {round(r["score"], 6) for r in toxicity.score(docs, flat).collect()} == {0.5} and toxicity.score(none, flat).count() == 0


def brute_score(m, text):
    """Slot by slot, n-gram by n-gram: the likeliest window's softmax."""
    words = re.findall(r"\w+", text.lower())

    def vector(word):
        grams = [f"<{word}>"[i : i + n] for n in toxicity.SIZES for i in range(len(word) + 3 - n)]
        return np.mean([m.vectors[bucket(g)] for g in grams], axis=0)

    def bucket(gram):
        h = len(gram)
        for c in gram:
            h = (h * 0x9E3779B97F4A7C15 % (1 << 64)) ^ ord(c)
            h ^= h >> 29
        return ((h * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 40) % toxicity.BUCKETS

    best = None
    for a, b in toxicity.windows_of(len(words)) or [(0, 0)]:
        total = np.zeros(toxicity.DIM)
        for i in range(a, b):
            if words[i] not in words[max(0, i - toxicity.WINDOW + 1) : i]:
                total += vector(words[i])
        z = total / toxicity.WINDOW @ m.weights + m.bias
        p = 1 / (1 + np.exp(z[0] - z[1]))
        best = p if best is None else max(best, p)
    return best


def test_toxicity_scores_equal_a_naive_scorer(spark):
    rng = np.random.default_rng(9)
    m = toxicity.Model(rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIM)), rng.normal(0, 1, (toxicity.DIM, 2)), np.array([0.1, -0.3]))
    words = ["Ab", "été", "x", "grunf", "grunfen", "_1", "wexel", "漢字"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 5, 31, 32, 33, 49, 200)] + ["", None, "!? ", "a " * 500, "a b", "a b"]
    frame = spark.createDataFrame([(i // 2, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in toxicity.score(frame, m).collect())
    assert got == Counter((i // 2, round(float(brute_score(m, t or "")), 9)) for i, t in enumerate(texts))


def test_bpe_with_a_pattern_that_does_not_cut_at_spaces(spark):
    import tiktoken

    ranks, pattern = bpe.read_ranks(queries.tokenizer_file()), r"[^\n]+|\n"
    other = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(bpe.serialise_model(ranks), pattern)
    text = "one two three\nfour  five"
    got = codec.encode(text)
    assert not codec.cuts and list(struct.unpack(f"<{len(got) // 4}I", got)) == other.encode_ordinary(text)


def test_share_out_prefers_siblings():
    assert mixing.share_out(100, [("a", 1, 10), ("b", 1, 1000), ("c", 2, 1000)]) == {"a": 10, "b": 30, "c": 60}
    assert mixing.share_out(100, [("a", 0, 10), ("b", 3, 20)]) == {"b": 20}
    leaves = {("web", "en", "x"): 10, ("web", "en", "y"): 500, ("web", "de", "z"): 500, ("ref", "en", "q"): 500}
    got = mixing.budgets(leaves, mixing.Mix(weights={"domain": {"web": 3, "ref": 1}}, budget_num=400, budget_den=1510))
    assert got == {("web", "en", "x"): 10, ("web", "en", "y"): 140, ("web", "de", "z"): 150, ("ref", "en", "q"): 100}
    assert mixing.budgets({}, mixing.Mix()) == {}


def test_mix_takes_prefixes_of_seeded_epochs(spark, none):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None])) for i in range(400)] + [(7, "w w", "en", "s1"), (None, "w", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = mixing.Mix(weights={"lang": {"en": 9}}, budget_num=3, budget_den=4, max_epochs=3, seed="t", bucket_hex=1)
    from pyspark.sql import functions as F

    leaf = mixing.leaf_columns(docs, F.lit("d"))
    counts = docs.select(*leaf, mixing.tokens(F.col("text")).alias("n_tokens"))
    got = Counter((r["doc_id"], r["text"], r["epoch"]) for r in mixing.select(docs, mixing.plan(counts, mix), mix, leaf[1:]).collect())
    supply = Counter()
    for i, t, la, so in rows:
        supply["d", la or "", so or ""] += len(t.split())
    want = Counter()
    for path, b in mixing.budgets(supply, mix).items():
        mine = [(i, t) for i, t, la, so in rows if ("d", la or "", so or "") == path]
        full, rest = divmod(b, supply[path]) if supply[path] else (0, 0)
        want.update((i, t, e) for e in range(full) for i, t in mine)
        key = lambda i, e=full: hashlib.md5(f"t:{e}:{'' if i is None else i}".encode()).hexdigest()
        before = 0
        for k in sorted({key(i) for i, _ in mine}):
            if before >= rest:
                break
            group = [(i, t) for i, t in mine if key(i) == k]
            want.update((i, t, full) for i, t in group)
            before += sum(len(t.split()) for _, t in group)
    assert got == want
    assert mixing.select(none, mixing.plan(none.selectExpr("doc_id", "'d' as domain", "lang", "source", "0L as n_tokens"), mix), mix, mixing.leaf_columns(none, F.lit("d"))[1:]).count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w " * (i % 9) + "x" * (100_000 if i == 3 else 1), "en", "s", i, "cut", 7) for i in range(50)], "doc_id long, text string, lang string, source string, full long, cut string, epoch long")
    mix = mixing.Mix(budget_num=3, budget_den=2, max_epochs=3)
    leaf = mixing.leaf_columns(docs, F.lit("d"))
    leaves = mixing.plan(docs.select(*leaf, mixing.tokens(F.col("text")).alias("n_tokens")), mix)
    got = mixing.select(docs, leaves, mix, leaf[1:])
    assert got.columns == [*docs.columns, "epoch_"] and got.where("epoch = 7 and cut = 'cut' and full = doc_id").count() == got.count() >= 50
    assert mixing.select(docs, leaves, mix, leaf[1:], with_epoch=False).columns == docs.columns


def test_two_stage_suffixes_and_prefixes():
    rng = random.Random(6)
    for _ in range(150):
        t = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 70))) * rng.randint(1, 2)
        x = np.frombuffer(t, np.uint8)
        order = repeats.two_stage_suffixes(x, 200)
        assert list(order) == sorted(range(len(t)), key=lambda i: t[i:])
        chain = repeats.common_prefix_at_least(x, order, 5)
        assert list(chain) == [t[a : a + 5] == t[b : b + 5] and max(a, b) + 5 <= len(t) for a, b in zip(order, order[1:])]


def brute_removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def test_suffix_dedup_against_brute_force(spark, none, monkeypatch):
    rng = random.Random(7)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(30, 200))) for _ in range(12)]
    texts = ["".join(rng.choice(parts)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 4))) for _ in range(60)] + ["ab" * 150, "x" * 300, "", None, parts[0], parts[0]]
    ids = [*range(len(texts) - 1), len(texts) - 2]  # the last two rows are one row twice
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in zip(ids, texts)], "doc_id long, text string, m string, n int")
    want = Counter((i, *x) for i, x in zip(ids, brute_removed([(t or "").encode() for t in texts], 50)))
    for part_bytes in (1 << 20, 300):  # the second deals anchors in salted parts
        monkeypatch.setattr(suffix_dedup, "PART_BYTES", part_bytes)
        got = suffix_dedup.remove_repeats(docs, length=50, gram=12, carry=("m", "n")).collect()
        assert Counter((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    out = suffix_dedup.without_repeats(docs.withColumnRenamed("n", "n_chars"), length=50)
    assert out.columns == ["doc_id", "text", "m", "n_chars"] and out.count() == len(texts)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_tells_rows_apart_by_their_texts(spark, monkeypatch):
    rng = random.Random(17)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(400)
    # null and equal ids, 1000 equal rows, parts of them elsewhere, clashing names
    texts = [shared[:360] + word(300), word(300) + shared[30:], *([word(260)] * 1000), shared]
    rows = [(None, t, "k", [1], "s") for t in texts[:2]] + [(None, t, "k", [1], "s") for t in texts[2:]] + [(5, word(250), "k", [1], "s"), (5, word(250), "k", [1], "s"), (5, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, spans array<long>, ta string")
    want = Counter((r[0], *x) for r, x in zip(rows, brute_removed([(r[1] or "").encode() for r in rows], 200)))
    got = suffix_dedup.remove_repeats(frame).collect()
    assert Counter((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    left = suffix_dedup.without_repeats(frame)
    assert left.columns == frame.columns and left.where("ta = 's' and kept = 'k'").count() == len(rows) - 1
    # equal 32-bit hashes under null ids: different texts stay different
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", 700)  # many flushes
    assert Counter((r["doc_id"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame).collect()) == want


def test_null_ids_of_equal_murmur_hash_keep_their_bytes(spark):
    from pyspark.sql import functions as F

    frame = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{i}"))) for i in range(8))).alias("text"))
    twins = frame.withColumn("h", F.hash("text")).withColumn("n", F.count("*").over(__import__("pyspark").sql.Window.partitionBy("h"))).where("n > 1").select("doc_id", "text")
    twins = spark.createDataFrame(twins.collect(), twins.schema)
    assert twins.count() >= 2 and suffix_dedup.remove_repeats(twins).where("n_removed > 0").count() == 0


def test_very_long_text_with_passages_over_slice_borders(spark):
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 123, 3 << 20).astype(np.uint8)
    raw[suffix_dedup.SLICE - 150 : suffix_dedup.SLICE + 150] = raw[2_500_000:2_500_300]
    raw[10:309] = raw[1_700_000:1_700_299]
    raw[40_000:40_199] = raw[50_000:50_199]  # too short by a byte: the bytes around differ
    raw[[39_999, 40_199, 49_999, 50_199]] = [97, 97, 98, 98]
    frame = spark.createDataFrame([(1, raw.tobytes().decode()), (2, raw[3_000_000:3_000_250].tobytes().decode())], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in suffix_dedup.remove_repeats(frame).collect()}
    s = suffix_dedup.SLICE
    assert got == {1: [[10, 309], [s - 150, s + 150], [1_700_000, 1_700_299], [2_500_000, 2_500_300], [3_000_000, 3_000_250]], 2: [[0, 250]]}


def brute_fingerprint(text, k):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_against_brute_force(spark, docs, none):
    rng = random.Random(8)
    base = [[str(rng.randint(0, 400)) for _ in range(rng.randint(5, 300))] for _ in range(40)]
    rows = [(r[0], r[1]) for r in ROWS]
    for i in range(300):
        w = list(rng.choice(base))
        if i % 2:
            w[rng.randrange(len(w))] = "Zz"
        rows.append((100 + i, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(frame, shingle=4, max_bits=4).collect()
    fp = [brute_fingerprint(t, 4) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter((rows[i][0], fp[i], least[group[i]]) for i in range(len(rows)))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 4), (False, 5), (True, 0)]


def test_large_groups_are_searched_completely(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate([np.int64(1) << rng.integers(0, 62, 200), rng.integers(0, 1 << 62, 200)]))
    for block in (1, 1 << 18):
        monkeypatch.setattr(simhash, "BLOCK", block)
        out = simhash._Links()
        n = len(fps)
        simhash._verify(np.zeros(2 * n, np.int64), np.concatenate([fps, fps]), np.arange(2 * n) >= n, 4, out)
        a, b = out.shrink()
        near = {int(x) for x in fps if (np.bitwise_count((fps ^ x).view(np.uint64)) <= 4).sum() > 1}
        assert set(a.tolist()) | set(b.tolist()) == near and len(a) < n


def test_hot_keys_are_dealt_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 30)
    fps = np.unique(np.concatenate([base, *(base ^ (np.int64(1) << rng.integers(0, 62, 30)) ^ (np.int64(1) << rng.integers(0, 62, 30)) for _ in range(20)), np.int64(7) << 40 | np.arange(200)]))
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= 4
    group = np.arange(len(fps))
    for _ in range(len(fps)):
        new = np.array([group[row].min() for row in near])
        if (new == group).all():
            break
        group = new
    for hot in (1 << 17, 5):
        monkeypatch.setattr(simhash, "HOT", hot)
        roots = {r["node"]: r["root"] for r in components(simhash.links(frame, 4)).collect()}
        assert [roots.get(int(f), int(f)) for f in fps] == [int(fps[g]) for g in group]
    with pytest.raises(ValueError, match="max_bits"):
        simhash.links(frame, 12)


def test_keep_one_tells_rows_apart_by_id_and_words(spark):
    rows = [(1, "a b c d e f g", 1, "p"), (1, "wholly other words in this one here", 2, "p"), (1, "A b  c d e f g", 3, "p"), (None, "not seen before", 4, "p"), (None, "x y z", 5, "p"), (None, "x y z", 5, "p"), (3, "x y z", 6, "p"), (3, "x y z", 7, "p")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, k long, node string")
    got = simhash.keep_one(frame)
    assert got.columns == frame.columns
    found = Counter((r["doc_id"], " ".join(r["text"].lower().split())) for r in got.collect())
    assert found == {(1, "a b c d e f g"): 1, (1, "wholly other words in this one here"): 1, (None, "not seen before"): 1, (3, "x y z"): 1}


def test_large_group_elects_leaders_in_parts(spark, monkeypatch):
    rng, texts = random.Random(15), {}
    monkeypatch.setattr(simhash, "GROUP", 20)
    monkeypatch.setattr(simhash, "LEADERS", 3)
    templates = [[f"t{t}w{i}" for i in range(120)] for t in range(3)]
    for i in range(240):
        w = list(templates[i % 3])
        w[rng.randrange(120)] = f"c{i}"
        texts[i] = " ".join(w)
    assert len(assert_kept(spark, texts)) == 3


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 130)] + [(129, 39), (500, 500), (None, 3), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 1 for n in [*range(2, 41), *range(100, 130)]} | {201: 200} or {k: v for k, v in got.items() if k != v} == {n: 1 for n in [*range(2, 41), *range(100, 130)]} | {201: 200}


def brute_similar(texts, shingle=5, least=0.8):
    """Pairs of ids whose shingles have a Jaccard similarity of at least `least`."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}


def assert_kept(spark, texts):
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")).collect()}
    near = brute_similar(texts)
    assert not [p for p in near if p[0] in got and p[1] in got]
    assert all(any(({a, b} - {x}) & got for a, b in near if x in (a, b)) for x in texts.keys() - got)
    return got


def test_components_of_hundreds_of_clusters_are_finished(spark):
    rng = random.Random(5)
    template, texts = [f"w{i}" for i in range(200)], {}
    for v in range(200):
        base = list(template)
        for i, at in enumerate(rng.sample(range(200), 4)):
            base[at] = f"v{v}x{i}"
        for copy in range(3):
            w = list(base)
            if copy:
                w[rng.randrange(200)] = f"c{v}x{copy}"
            texts[v + 200 * copy] = " ".join(w)
    assert len(assert_kept(spark, texts)) < 220


def test_who_went_for_one_that_goes_is_compared_again(spark, monkeypatch):
    def changed(words, at, name):
        return [f"{name}{i}" if i in at else w for i, w in enumerate(words)]

    c = [f"w{i}" for i in range(200)]
    a = changed(c, (10, 20, 30), "a")
    b = changed(a, (60, 70, 80), "b")
    f = changed(b, (120, 130, 140), "f")
    texts = {5: a, 1: b, 9: c, 10: changed(c, (190,), "d"), 11: changed(c, (195,), "e"), 20: f}
    near = brute_similar({i: " ".join(w) for i, w in texts.items()})
    assert (5, 9) in near and (1, 5) in near and (1, 20) in near and not near & {(1, 9), (5, 20), (9, 20)}
    went = {1: 5, 10: 9, 11: 9}

    def thinned(frame, *_):
        k = {r["id"]: r["k"] for r in frame.select("id", "k").collect()}
        return spark.createDataFrame([(k[x], k[y]) for x, y in went.items()], "k long, by long")

    monkeypatch.setattr(simhash, "thinned", thinned)
    assert assert_kept(spark, {i: " ".join(w) for i, w in texts.items()}) == {9, 20}
    del texts[20]
    assert assert_kept(spark, {i: " ".join(w) for i, w in texts.items()}) == {1, 9}


def test_pairs_far_apart_in_every_fingerprint_are_found(spark):
    rng, texts = random.Random(8), {}
    for v in range(60):
        w = [f"v{v}x{i}" for i in range(60 + v)]
        texts[2 * v] = " ".join(w)
        w[rng.randrange(5, 50)] = "new"
        texts[2 * v + 1] = " ".join(w)
    texts |= {1000: "", 1001: " ", 1002: "a b", 1003: "A  b"}
    near = brute_similar(texts)
    assert len(near) > 40
    assert len(assert_kept(spark, texts)) == len(texts) - len(near)


def test_lists_are_sent_as_bits_and_only_what_may_be_listed_is_shuffled(spark):
    rows = [(i if i % 7 else None, bytes([i % 251, i // 251]), "long text " * 9) for i in range(6000)]
    listed = rows[3::40] + [(9999, b"zz", "")]
    docs = spark.createDataFrame(rows + rows[:50], "id long, node binary, text string")
    off = written(spark.createDataFrame([r[:2] for r in listed], "id long, node binary"), "off")
    want = sorted((r for r in rows + rows[:50] if r not in listed), key=str)
    assert sorted(map(tuple, simhash.without_few(docs, off).collect()), key=str) == want
    assert sorted(map(tuple, simhash.without_few(docs, off.limit(0)).collect()), key=str) == sorted(rows + rows[:50], key=str)
    maybe = simhash.marked(docs, off, "id", "node").where("_maybe")
    assert len(listed) - 1 <= maybe.count() < len(listed) + 800  # the join before moved all 6050
