"""The five stages on a whole small corpus, each against a plain version."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from chronolith.llm import bpe, chat, langid, mixing, queries, simhash, substring_dedup

from test_text_operators import plain_components, plain_fingerprint, plain_phrases, plain_removal

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row string, component_id long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with copies, near copies, odd rows, and columns that clash."""
    out = tmp_path_factory.mktemp("corpus")
    r = random.Random(12)
    en, de = (["".join(r.choices(a, k=r.randint(2, 6))) for _ in range(150)] for a in ("abcdefgh", "mnopqrst"))
    texts = [" ".join(r.choices((en, de)[i % 2], k=r.choice([2, 40, 90, 200]))) for i in range(150)]
    texts += [texts[2] + " \n", texts[3], texts[3], texts[4].replace(" ", "  ", 2)]
    for i in (5, 6, 7):
        words = texts[i].split()
        texts.append(" ".join([*words[:-1], "zz"]))
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [(900, None, None, None), (901, "", "en", "s0"), (902, " \t", "en", "s1"), (903, "12 -- 34", "de", "s0"), (904, "é", "en", "s0"), (905, "long words " * 9000, "en", "s1")]
    docs = spark.createDataFrame([(*x, len(x[1] or ""), "r", 5) for x in rows], SCHEMA).repartition(5)
    docs.write.parquet(str(out / "documents.parquet"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 150, 3)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(out / "labels.parquet"))
    return str(out)


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def through(spark, folder, until):
    """The input of a stage and what it makes of it."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}-{random.random()}"
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if name == until:
            return docs, out
        docs = out


def least(groups):
    """Of (id, text) rows in classes, one with the smallest id; no id is the largest."""
    return Counter(min(g, key=lambda x: (x[0] is None, x[0])) for g in groups)


def test_language_stage_keeps_every_text_with_a_letter(spark, folder):
    docs, out = through(spark, folder, "language_id")
    assert out.columns == docs.columns
    want = Counter({k: n for k, n in pairs(docs).items() if any(c.isalpha() for c in k[1] or "")})
    assert pairs(out) == want
    samples = langid.learn(docs, usable=~langid.held_out())
    for r in langid.identify(docs, samples).join(docs.select("doc_id", "text"), "doc_id").collect():
        text = langid.clean(r.text or "")
        if not text.strip():
            assert r.lang_pred == "und"
        elif len(text) < 3000:
            rate = {lang: plain_phrases(langid.clean(s), text) * math.log2(len(langid.clean(s))) / len(text) for lang, s in samples}
            assert r.lang_pred == min(rate, key=lambda x: (rate[x], x))


def test_exact_stage(spark, folder):
    docs, out = through(spark, folder, "exact_dedup")
    groups = defaultdict(list)
    for i, t in pairs(docs).elements():
        groups["".join((t or "").split(" ")).translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r")))].append((i, t))
    longest = [[x for x in g if len(x[1]) == max(len(y[1]) for y in g)] for g in groups.values()]
    assert out.columns == docs.columns and pairs(out) == least(longest)


def test_near_duplicate_stage(spark, folder):
    docs, out = through(spark, folder, "simhash_near_dedup")
    rows = list(pairs(docs).elements())
    groups = defaultdict(list)
    for c, x in zip(plain_components([plain_fingerprint(t) for _, t in rows]), rows):
        groups[c].append(x)
    assert out.columns == docs.columns and pairs(out) == least(groups.values()) and len(groups) < len(rows)


def test_mixing_stage(spark, folder):
    docs, out = through(spark, folder, "source_mixing")
    c = duckdb.connect()
    docs.write.mode("overwrite").parquet(f"{folder}/mixed-in")
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/mixed-in/*.parquet'")
    c.execute(f"CREATE VIEW labels AS SELECT * FROM '{folder}/labels.parquet/*.parquet'")
    want = Counter()
    text = dict(pairs(docs))
    for i, size, _, _, taken in c.execute(queries.ORACLE_SQL["op10_mixing"]).fetchall():
        if taken:
            want[i] = taken // size
    assert out.columns == docs.columns and Counter(i for i, _ in pairs(out).elements()) == want
    assert {t for _, t in pairs(out)} <= {t for _, t in text}


def test_bpe_stage(spark, folder):
    docs, out = through(spark, folder, "byte_bpe")
    ranks = bpe.vocabulary(*queries.vocabulary_source()).ranks
    library = tiktoken.Encoding("own", pat_str=queries.vocabulary_source()[1], mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (i, t), n in pairs(docs).items():
        ids = library.encode_ordinary(t)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        if name != "byte_bpe":
            assert out.columns == docs.columns


# Very long texts


def test_very_long_texts(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    long = " ".join(r.choices(words, k=60_000))
    rows = [(1, long), (2, f"{' '.join(r.choices(words, k=50))} {long}"), (3, "short one"), (4, None)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(2)
    found = {x.doc_id: x for x in simhash.near_duplicates(docs).collect()}
    for i, t in rows:
        assert found[i].fp % (1 << 64) == plain_fingerprint(t)
    got = Counter((x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring_dedup.remove_repeats(docs).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, plain_removal(rows, substring_dedup.WINDOW)))
    assert {x.doc_id: x.size for x in mixing.mix(docs).collect()} == {i: len((t or "").split()) for i, t in rows}
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    out = chat.render(chat.from_rows(turns))
    for x in out.select("conv_id", chat.masked_text(F.col("segments")).alias("loss"), chat.parse(chat.formatted(F.col("segments"))).alias("turns")).collect():
        assert x.loss == (dict(rows)[x.conv_id] or "") == x.turns[0].text
