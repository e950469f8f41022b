"""BPE, exact and near duplicates, repeated passages, language ID: against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from chronolith.llm import bpe, exact_dedup, langid, queries, simhash, substring_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, 0), (2, "", None, None, 0), (3, " \t\n", "en", "a", 3), (4, "word", "en", "a", 4), (4, "word", "en", "a", 4), (None, "word  ", "en", "a", 6)]


def docs(spark, rows):
    """Documents with extra columns whose names could clash."""
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], DOCS + ", h string, kept double").repartition(3)


def prose(r, vocabulary, n):
    return " ".join(r.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    words = ["".join(r.choices("abcdefößé", k=r.randint(1, 7))) for _ in range(300)]
    texts = [prose(r, words, r.choice([1, 3, 10, 60, 200, 400])) for _ in range(120)]
    shared = prose(r, words, 90)
    for i in range(0, 40, 2):
        texts[i] = f"{texts[i]} {shared} {prose(r, words, 30)}"
    texts += [texts[0]] * 25 + [t.replace(" ", "\n  ", 3) for t in texts[5:15]] + ["la " * 200, "to be or not " * 30]
    near = texts[2].split()
    for i in range(12):
        near = near[: 20 * i] + ["zzz"] + near[20 * i :]
        texts.append(" ".join(near))
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + ODD[:3]


# BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(*queries.vocabulary_source())


def test_bpe_equals_the_library(vocabulary):
    import numpy as np
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=queries.vocabulary_source()[1], mergeable_ranks=vocabulary.ranks, special_tokens={})
    r = random.Random(1)
    parts = [" ", "\n", "\t", "a", "th", "e", "ing", "é", "ß", "字", "🙂", "12", "'s", "!", "\x1c", "\x85", "A", "́", "<|endoftext|>"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 200))) for _ in range(300)]
    texts += ["a" * 3000, "ab" * 999, " " * 700, "!" * 301, "=-" * 200, "字" * 500, "".join(r.choices("abcdefghij", k=5000)), ""]
    for text, ids in zip(texts, vocabulary.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(ids).decode() == text


def test_bpe_long_rows_merge_as_single_merges_would(vocabulary):
    import numpy as np

    r = random.Random(2)
    for alphabet in ("ab", "aab ", "thein", "xyz!"):
        raw = "".join(r.choices(alphabet, k=300)).encode()
        ids = [int(vocabulary.single[b]) for b in raw]
        while True:
            ranks = vocabulary.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
            at = int(ranks.argmin())
            if ranks[at] == bpe.NONE:
                break
            ids[at : at + 2] = [int(ranks[at])]
        assert vocabulary.merge_row(vocabulary.single[np.frombuffer(raw, np.uint8)]).tolist() == ids


def test_bpe_query_on_odd_rows(spark):
    rows = [*ODD, (9, "x" * 200_000 + " end", None, None, 0)]
    got = queries.bpe_digests(docs(spark, rows), *queries.vocabulary_source()).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert queries.bpe_digests(docs(spark, rows).where("false"), *queries.vocabulary_source()).count() == 0


# Exact duplicates


def test_directory_splits_and_doubles():
    d = exact_dedup.Directory(capacity=4, max_depth=5).fill({0: 3, 1: 3, 9: 4, 31: 9}, 5)
    assert len(d.slots) == 1 << d.depth and d.depth > 0
    counts, of_bucket = {0: 3, 1: 3, 9: 4, 31: 9}, defaultdict(int)
    for key, n in counts.items():
        of_bucket[d.slots[key >> (5 - d.depth)]] += n
    assert all(n <= 4 or d.local[b] == 5 for b, n in of_bucket.items())
    for b, local in d.local.items():
        assert d.slots.count(b) == 1 << (d.depth - local)


def test_exact_duplicates_equal_brute_force(spark, corpus):
    rows = [*corpus, *ODD[3:], (7000, "two  forms", "en", "s", 0), (7000, "two forms", "en", "s", 0), (7001, "twoforms", "en", "s", 0), (7002, "long " * 40_000, "en", "s", 0)]
    groups = defaultdict(list)
    plain = lambda t: "".join((t or "").split(" ")).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r")))
    for i, t, *_ in rows:
        groups[plain(t)].append((-len(t or ""), i is None, i))
    want = Counter()
    for i, t, *_ in rows:
        members = sorted(groups[plain(t)])
        size, _, keep = members[0]
        want[i, keep, len(members), i == keep and -len(t or "") == size, hashlib.sha256(plain(t).encode()).hexdigest()] += 1
    got = exact_dedup.exact_duplicates(docs(spark, rows), bucket_rows=8).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got if r.doc_id == 7000) == 1
    assert exact_dedup.exact_duplicates(docs(spark, rows).where("false")).count() == 0


def test_colliding_keys_are_chained():
    import pyarrow as pa

    schema = pa.schema([("bucket", pa.int32()), ("h", pa.int64()), ("norm", pa.binary()), ("n", pa.int64()), ("chars", pa.int64()), ("keep_id", pa.int64())])
    rows = [(0, 7, b"a", 1, 1, 5), (0, 7, b"b", 2, 1, 3), (0, 7, b"a", 4, 2, 9), (1, 8, b"a", 1, 1, 1)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    out = [r for b in exact_dedup._own([batch.slice(0, 2), batch.slice(2)]) for r in b.to_pylist()]
    assert [(r["h"], r["chain"], r["group_size"], r["keep_id"]) for r in out] == [(7, 0, 5, 9), (7, 1, 2, 3), (8, 0, 1, 1)]


# Near duplicates


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_equal_brute_force(spark, corpus):
    rows = [*corpus, ODD[3]]
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    comp = plain_components(fps)
    least = defaultdict(lambda: 1 << 62)
    for c, (i, *_) in zip(comp, rows):
        least[c] = min(least[c], i)
    want = Counter((i, format(f, "016x"), least[c]) for f, c, (i, *_) in zip(fps, comp, rows))
    for block_rows in (simhash.BLOCK_ROWS, 3):
        found = simhash.near_duplicates(docs(spark, rows), block_rows=block_rows)
        got = Counter((r.doc_id, r.f, r.component_id) for r in found.withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0"))).collect())
        assert got == want
    assert simhash.near_duplicates(docs(spark, rows).where("false")).count() == 0


def test_links_of_dense_groups(spark):
    """Fingerprints a few bits apart in long chains and dense balls."""
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(200)}
    centre = r.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}
    x = r.getrandbits(64)
    for _ in range(60):
        x ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) | (1 << r.randrange(64))
        fps.add(x)
    fps = sorted(fps)
    comp = plain_components(fps)
    want = len(set(comp))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, root long")
    from chronolith.llm.graph import components

    for most in (100_000, 5):
        links = simhash.near_links(df, block_rows=most)
        named = {n.node: n.component for n in components(links).collect()}
        assert len({named.get(i, i) for i in range(len(fps))}) == want
        assert all((named.get(i, i) == named.get(j, j)) == (comp[i] == comp[j]) for i in range(0, len(fps), 7) for j in range(len(fps)))


def test_masks_leave_no_close_pair_apart():
    r = random.Random(6)
    for parts in (4, 5, 7, 16):
        m = simhash.masks(parts)
        for _ in range(200):
            a = r.getrandbits(64)
            b = a
            for _ in range(3):
                b ^= 1 << r.randrange(64)
            assert any((a ^ b) & (x & ((1 << 64) - 1)) == 0 for x in m)


# Repeated passages


def plain_removal(rows, window):
    words = [(t or "").encode().split() for _, t, *_ in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        drop = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out.append((len(w), len(drop), b" ".join(x for i, x in enumerate(w) if i not in drop).decode()))
    return out


@pytest.mark.parametrize("window,phrase", [(35, 8), (12, 4), (3, 8)])
def test_repeats_equal_brute_force(spark, corpus, window, phrase):
    rows = [*corpus, *ODD]
    want = Counter((i, *x) for (i, *_), x in zip(rows, plain_removal(rows, window)))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs(spark, rows), window=window, phrase=phrase).collect())
    assert got == want


def test_repeats_of_nothing(spark):
    assert substring_dedup.remove_repeats(docs(spark, ODD).where("false")).count() == 0
    assert sorted(r.n_removed for r in substring_dedup.remove_repeats(docs(spark, ODD)).collect()) == [0] * 6


# Language


def test_suffix_automaton_accepts_substrings_only():
    r = random.Random(7)
    text = [r.randrange(3) for _ in range(60)]
    go = langid.suffix_automaton(text)

    def accepts(x):
        s = 0
        for c in x:
            if c not in go[s]:
                return False
            s = go[s][c]
        return True

    subs = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}
    assert all(accepts(x) for x in subs)
    assert all(accepts(x) == (x in subs) for x in (tuple(r.randrange(3) for _ in range(r.randint(1, 9))) for _ in range(500)))


def plain_phrases(sample, text):
    n = i = 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in sample:
            j += 1
        n, i = n + 1, j
    return n


def test_phrases_equal_brute_force():
    samples = (("de", "der die das und nicht ein haus im wald"), ("en", "the house in the wood and not a word of it"))
    model = langid.Model(samples)
    texts = [langid.clean(t) for t in ("the wood of the house", "das haus und der wald", "xyz", "a" * 700, "not a wald in the haus " * 30, "der die das und " * 200, "ein haus im wald der die das und nicht " * 70 + "?", "")]
    r = random.Random(4)
    texts += [langid.clean("".join(r.choices("adehinrstuw xq", k=n))) for n in (255, 256, 257, 511, 513, 3000)]
    _, found = model.phrases(texts)
    for t, row in zip(texts, found):
        for k, lang in enumerate(model.languages):
            assert row[k] == plain_phrases(langid.clean(dict(samples)[lang]), t), (t, lang)


def test_language_of_odd_rows(spark):
    samples = (("de", "der die das und nicht"), ("en", "the house and not"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs(spark, [*ODD, (8, "12 -- !!", None, None, 0), (9, "THE HOUSE", None, None, 0)]), samples).collect()}
    assert got[1] == got[2] == got[3] == got[8] == ("und", 0.0) and got[9][0] == "en" and 0 <= got[9][1] <= 1
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), ()).collect()} == {"und"}
    assert langid.learn(docs(spark, ODD).where("false")) == ()


def test_held_out_accuracy(spark, sf):
    found = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and right / n > 0.95


def test_languages_in_several_scripts_keep_their_letters(spark):
    r = random.Random(5)
    pools = {"el": range(0x3B1, 0x3C9), "en": range(ord("a"), ord("z") + 1), "ru": range(0x430, 0x450), "ja": range(0x4E00, 0x4E00 + 400), "zh": range(0x5E00, 0x5E00 + 400)}
    words = {lang: ["".join(chr(r.choice(pool)) for _ in range(r.randint(1, 4))) for _ in range(60)] for lang, pool in pools.items()}
    samples = tuple((lang, " ".join(r.choices(w, k=500))) for lang, w in sorted(words.items()))
    model = langid.Model(samples)
    texts = [(lang, " ".join(r.choices(w, k=30))) for lang, w in words.items() for _ in range(5)]
    assert [p[0] for p in model.predict([t for _, t in texts])] == [lang for lang, _ in texts]
    _, found = model.phrases([langid.clean(t) for _, t in texts])
    for row, (_, t) in zip(found, texts):
        for k, lang in enumerate(model.languages):
            assert row[k] == plain_phrases(langid.clean(dict(samples)[lang]), langid.clean(t))


def test_letters_keep_their_marks():
    assert langid.clean("नमस्ते दुनिया 12!") == "नमस्ते दुनिया "
    assert langid.clean("E\u0301te\u0301, ÉTÉ") == "e\u0301te\u0301 été"
    assert langid.clean("\u0301 \u0302 12").strip() == "" and langid.clean("²x_Ⅷ-y").split()[-1] == "y"


def test_every_labelled_language_is_learned(spark):
    rows = [(i, " ".join(chr(0x4E00 + 40 * i + j) * 2 for j in range(20)), f"l{i:03}", "s", 60) for i in range(120)]
    samples = langid.learn(docs(spark, rows))
    assert [lang for lang, _ in samples] == sorted(f"l{i:03}" for i in range(120))
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs(spark, rows), samples).collect()}
    assert got == {i: f"l{i:03}" for i in range(120)}
