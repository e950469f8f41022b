"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, exact_dedup, html_extract, langid, mixing, simhash, substring_dedup, url_filter
from ._common import LOWER, UPPER, table

RANKS = "byte_bpe_50k.tiktoken"


def vocabulary_source() -> tuple[str, str]:
    """Rank file, by name, and pattern of the public byte-level vocabulary."""
    import public_tokenizers

    return RANKS, public_tokenizers.PATTERN


def bpe_digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    out = bpe.decode(bpe.encode(docs, rank_file, pattern), rank_file, pattern)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Documents labelled good are twice as likely, bad ones half as likely."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), *vocabulary_source())


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def all_conversations(rows: DataFrame) -> DataFrame:
    """Turns of all conversations, which come as a row for each turn, and of
    conversation -7, whose texts look like marks and which comes as one record."""
    text = "\\### Assistant: </turn> ok"
    record = json.dumps({"messages": [{"role": r, "content": text} for r in ("user", "assistant")]})
    probe = chat.from_json(rows.sparkSession.createDataFrame([(-7, record)], "conv_id long, record string"), "record")
    return chat.canonical(rows, ("conv_id", "turn", "role", "text")).unionByName(probe.select("conv_id", "turns"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.render(all_conversations(table(spark, sf_dir, "conversations"))).select("conv_id", "segments", chat.formatted(F.col("segments")).alias("formatted"))
    out = out.select("conv_id", "formatted", chat.masked_text(F.col("segments")).alias("loss"), chat.parse(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), keep=("url",))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs, usable=~langid.held_out()))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


RULES = tuple(url_filter.Rule(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")))

def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's number in its path is its document's id, whose label is the page's."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    is_bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    bad = labels.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(is_bad).alias("_bad"))
    number = "try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)[^/?#]*/?(?:[?#]|$)', 1) AS bigint)"
    pages = pages.select("page_id", "url", F.expr(number).alias("_number"))
    pages = pages.join(bad, F.col("_number") == F.col("_doc"), "left")
    found = url_filter.judge(pages, RULES, F.col("_bad") == 1)
    return found.select("page_id", "host", "path", "rule", "verdict")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_bpe": op2_bpe,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat": op5_chat,
    "op6_html": op6_html,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}


def _url_filter_sql() -> str:
    """The template tree level by level; constants are the operator's own."""
    u = url_filter
    rules = sorted(RULES, key=lambda r: -len(r.text))
    fits = "WHEN (y.host = '{r.host}' OR ends_with(y.host, '.{r.host}')) AND starts_with(y.path, '{r.path}') THEN '{r.text}'"
    rule = " ".join(fits.format(r=r) for r in rules)
    verdict = " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules)
    variable = r"^(?:[0-9]+|[0-9a-fA-F]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|[0-9a-fA-F-]{32,36})(\.[A-Za-z0-9]{1,5})?$"
    steps = [
        "a AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS r FROM pages)",
        f"""b AS (SELECT page_id, url, coalesce(translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a)""",
        "lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id)",
        "num AS (SELECT *, try_cast(regexp_extract(url, '://[^?#]*/([0-9]+)[^/?#]*/?(?:[?#]|$)', 1) AS bigint) AS number FROM b)",
        "lst AS (SELECT num.*, lab.bad = 1 AS bad FROM num LEFT JOIN lab ON number = doc_id)",
        f"""seg AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''),
 lambda x: CASE WHEN regexp_matches(x, '{variable}') THEN '{u.WILDCARD}' || regexp_extract(x, '{variable}', 1) ELSE x END) AS parts FROM lst)""",
        f"""typ AS (SELECT *, CASE WHEN len(parts) > {u.LEVELS}
 THEN parts[1 : {u.LEVELS - 1}] || [array_to_string(parts[{u.LEVELS} :], '/')] ELSE parts END AS typed FROM seg)""",
        """t0 AS (SELECT host, typed, typed AS t, count(*) AS n, count(*) FILTER (WHERE bad IS NOT NULL) AS k,
 count(*) FILTER (WHERE bad) AS b FROM typ GROUP BY host, typed)""",
    ]
    now = "t0"
    for d in range(u.LEVELS):
        steps += [
            f"kid{d} AS (SELECT host, t[1 : {d}] AS h, t[{d + 1}] AS c, sum(n) AS n FROM {now} WHERE len(t) > {d} GROUP BY 1, 2, 3)",
            f"many{d} AS (SELECT host, h FROM kid{d} GROUP BY 1, 2 HAVING count(*) > {u.CHILDREN} AND sum(n) < {u.RECURS} * count(*))",
            f"""g{d} AS (SELECT x.host, typed, n, k, b, CASE WHEN m.host IS NOT NULL
 THEN t[1 : {d}] || ['{u.WILDCARD}'] || t[{d + 2} :] ELSE t END AS t
 FROM {now} x LEFT JOIN many{d} m ON x.host = m.host AND len(t) > {d} AND t[1 : {d}] = m.h)""",
        ]
        now = f"g{d}"
    for d in reversed(range(u.LEVELS)):
        steps += [
            f"""s{d} AS (SELECT host, t[1 : {d}] || [''] || t[{d + 2} :] AS o, t[{d + 1}] AS c, sum(k)::DOUBLE AS k, sum(b)::DOUBLE AS b
 FROM {now} WHERE len(t) > {d} GROUP BY 1, 2, 3)""",
            f"""r{d} AS (SELECT *, k + 1.0 AS k1, b + 0.5 AS b1, sum(k) OVER p AS ka, sum(k) OVER p - k + 1.0 AS k2,
 sum(b) OVER p - b + 0.5 AS b2, count(*) OVER p AS kids FROM s{d} WINDOW p AS (PARTITION BY host, o))""",
            f"""n{d} AS (SELECT host, o, c FROM r{d} WHERE kids > 1 AND NOT (k > 0 AND k < ka AND abs(b1 / k1 - b2 / k2)
 / sqrt((b1 + b2) / (k1 + k2) * (1 - (b1 + b2) / (k1 + k2)) * (1 / k1 + 1 / k2)) > {u.SAME_Z}))""",
            f"""m{d} AS (SELECT x.host, typed, n, k, b, CASE WHEN y.c IS NOT NULL THEN t[1 : {d}] || ['{u.ALIKE}'] || t[{d + 2} :] ELSE t END AS t
 FROM {now} x LEFT JOIN n{d} y ON x.host = y.host AND len(t) > {d} AND y.o = t[1 : {d}] || [''] || t[{d + 2} :] AND y.c = t[{d + 1}])""",
        ]
        now = f"m{d}"
    smooth, prior = f"{u.SMOOTHING}::DOUBLE", f"{u.SMOOTHING * u.PRIOR}::DOUBLE"
    steps += [
        f"tot AS (SELECT host, t, sum(k)::DOUBLE AS k, sum(b)::DOUBLE AS b FROM {now} GROUP BY 1, 2)",
        f"hst AS (SELECT host, (sum(b) + {prior}) / (sum(k) + {smooth}) AS p FROM tot GROUP BY 1)",
        f"jdg AS (SELECT tot.host, t, 1.0 - (b + {smooth} * p) / (k + {smooth}) AS purity FROM tot JOIN hst ON tot.host = hst.host)",
        f"""fin AS (SELECT y.page_id, y.host, y.path, purity, CASE {rule} END AS rule
 FROM typ y JOIN {now} x ON y.host = x.host AND y.typed = x.typed JOIN jdg ON x.host = jdg.host AND x.t = jdg.t)""",
    ]
    last = f"CASE WHEN purity <= 1.0 - {u.REJECTED}::DOUBLE THEN 'block' ELSE 'allow' END"
    return "WITH " + ",\n".join(steps) + f"\nSELECT page_id, host, path, rule, CASE rule {verdict} ELSE {last} END AS verdict FROM fin"


ORACLE_SQL: dict[str, str] = {
    "op8_url_filter": _url_filter_sql(),
    "op3_exact_dedup": r"""
WITH a AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
           FROM documents),
b AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM a)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b
""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
k AS (SELECT id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
h AS (SELECT id, i, md5(array_to_string(words[i : i + 34], ' ')) AS h FROM k),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT id, i + j AS p FROM h SEMI JOIN again USING (h), range(0, 35) r(j)),
g AS (SELECT id, list(p) AS ps FROM gone GROUP BY id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (id)
""",
    "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') AS r,
             replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS t FROM c),
g AS (SELECT conv_id, count(*) AS n_turns,
             string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             sum(6 + length(r) + 1 + length(t) + 8)::BIGINT AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
""",
    "op10_mixing": r"""
WITH q AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight
           FROM labels GROUP BY doc_id),
d AS (SELECT d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
               / coalesce(q.weight, 1.0) AS k
      FROM documents d LEFT JOIN q ON d.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM s),
r AS (SELECT *, most / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight FROM w),
l AS (SELECT *, (total - coalesce(sum(most) OVER o, 0.0::DOUBLE)) / (all_weight - coalesce(sum(weight) OVER o, 0.0::DOUBLE)) AS lev
      FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce(weight * (SELECT lev FROM share), most)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
m AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g AS (SELECT *, upto <= rest AS inside, rest - max(CASE WHEN upto <= rest THEN upto ELSE 0 END) OVER (PARTITION BY source) AS gap FROM m),
f AS (SELECT *, row_number() OVER (PARTITION BY source, inside OR size = 0 OR abs(gap - size) >= gap
                                   ORDER BY abs(gap - size), k, doc_id NULLS LAST, size) AS r FROM g)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN size * (epochs + CASE WHEN inside OR (r = 1 AND abs(gap - size) < gap) THEN 1 ELSE 0 END) ELSE 0 END::BIGINT AS taken
FROM f
""",
}
