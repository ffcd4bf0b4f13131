"""The thin queries over the operators, one opN_<name> each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm import chat, decontam, html_gbt, importance, line_rules, mixing, near_dup, piece_bpe, quality_qda, spelling, suffix_dedup, token_counts, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.clean_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken", "copies")


def op4_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages"))
    return warc.read(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_html_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_gbt.extract(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), token_counts.pieces_of(token_counts.VOCABULARY))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.format_turns(rows))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), every=31)


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    model = piece_bpe.read_model(path("piece_bpe_32k.model"))
    out = piece_bpe.decode(piece_bpe.encode(_table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), orders=(1,))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_qda": op1_quality_qda,
    "op2_line_rules": op2_line_rules,
    "op3_systematic_mix": op3_systematic_mix,
    "op4_latent_leaks": op4_latent_leaks,
    "op5_warc_index": op5_warc_index,
    "op6_html_gbt": op6_html_gbt,
    "op7_token_counts": op7_token_counts,
    "op8_chat_format": op8_chat_format,
    "op9_near_dup": op9_near_dup,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_spelling": op11_spelling,
    "op12_piece_bpe": op12_piece_bpe,
    "op13_importance": op13_importance,
}

_WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of a string's UTF-8 bytes: a table of the polynomial's remainders, then a step per byte.
_CRC_TABLE = "crc AS (SELECT list(list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) AS t(i))"
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, 2 * octet_length(encode({0})) + 1, 2), lambda i: ('0x' || substr(hex(encode({0})), i::int, 2))::bigint)),
            lambda c, b: xor(c >> 8, crc.steps[(xor(c, b) & 255)::int + 1])), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op2_line_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
g AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, run) AS times FROM p) WHERE times > 1),
c AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM g) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT doc_id, line, len(regexp_replace(line, '{_GAP}', '', 'g')) AS solid, len(regexp_extract_all(line, '{_WORD}')) AS n, len(line) - len(regexp_replace(line, '{line_rules.SYMBOLS}', '', 'g')) AS sym,
       len(line) - len(regexp_replace(line, '{line_rules.MARKS}', '', 'g')) AS mark, len(regexp_extract_all(line, '{line_rules.LINKS}')) AS links,
       len(line) - len(CASE WHEN contains(line, chr(171)) THEN regexp_replace(line, '{line_rules.BARS_AMONG_QUOTES}', '', 'g') ELSE regexp_replace(line, '{line_rules.BARS}', '', 'g') END) AS bar FROM l0),
l2 AS (SELECT *, solid > 0 AND (sym > 0.5 * n OR (mark > 0.5 * n AND n > 3) OR (bar >= 1 AND bar > 0.25 * n) OR (links >= 2 AND links >= 0.3 * n) OR (n <= 12 AND regexp_matches(line, '{line_rules.BROKEN_OFF}'))
       OR (n >= 30 AND NOT regexp_matches(line, '{line_rules.SENTENCE_MARKS}')) OR (n <= 25 AND regexp_matches(lower(line), '{"|".join(line_rules.BOILERPLATE).replace("'", "''")}'))) AS bad FROM l1),
s AS (SELECT doc_id, coalesce(sum(solid) FILTER (bad), 0) AS lost, count(*) FILTER (solid > 0) - count(DISTINCT line) FILTER (solid > 0) AS dup FROM l2 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::bigint AS n_words, len(regexp_replace(t, '{_GAP}', '', 'g'))::bigint AS word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::bigint AS n_symbols,
      s.dup::bigint AS n_dup_lines, coalesce(c.n, 0)::bigint AS n_repeat_words, s.lost FROM w JOIN s USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * word_chars AS kept FROM m""",
    "op3_systematic_mix": rf"""
WITH d0 AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint AS size FROM documents),
d AS (SELECT *, (len(bin(size + 4)) * 4 + (((size + 4) >> (len(bin(size + 4)) - 3)) & 3))::int AS cls FROM d0),
k AS (SELECT src, cls, count(*) AS n, ceil(sqrt(count(*)::double))::bigint AS blocks FROM d GROUP BY ALL),
s0 AS (SELECT src, sum(size)::bigint AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY src ASC NULLS LAST) - 1) % 3 + 1)::int]::double AS w, source_size * 2.0::double AS cap, sum(source_size) OVER () * 1.5::double AS budget FROM s0),
s2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, first(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lam FROM s2),
s AS (SELECT src, source_size, least(cap, coalesce(lam * w, cap)) AS target, CASE WHEN source_size > 0 THEN least(cap, coalesce(lam * w, cap)) / source_size ELSE 0.0 END AS rate,
      ('0x' || substr(md5('mix' || CASE WHEN src IS NULL THEN '-' ELSE '=' || src END), 1, 5))::int::double / 1048576.0::double AS start FROM s3),
e AS (SELECT d.*, s.source_size, s.target, s.rate, s.start, ((coalesce(doc_id, 0) % 1000003) * 7919 % 1000003) % k.blocks AS salt
      FROM d JOIN k ON d.cls = k.cls AND d.src IS NOT DISTINCT FROM k.src JOIN s ON d.src IS NOT DISTINCT FROM s.src),
f AS (SELECT *, row_number() OVER (PARTITION BY src, cls, salt ORDER BY size, doc_id) AS pos FROM e),
b AS (SELECT src, cls, salt, coalesce(sum(n) OVER (PARTITION BY src ORDER BY cls, salt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before FROM (SELECT src, cls, salt, count(*) AS n FROM e GROUP BY ALL)),
r AS (SELECT f.*, (floor((before + pos) * rate + start) - floor((before + pos - 1) * rate + start))::bigint AS copies FROM f JOIN b ON f.cls = b.cls AND f.salt = b.salt AND f.src IS NOT DISTINCT FROM b.src)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM r""",
    "op5_warc_index": """
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS n, sha256(coalesce(html, '')) AS g FROM pages),
m AS (SELECT g, min(page_id) AS f FROM d WHERE n >= 100 GROUP BY g)
SELECT page_id, n AS payload_bytes, g AS payload_digest, CASE WHEN n >= 100 AND f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND f < page_id THEN f END AS refers_to
FROM d LEFT JOIN m USING (g)""",
    "op8_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS nth, coalesce(lag(role) OVER w, '') AS was FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, t)),
x AS (SELECT *, len('### ') + len(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE '?' || url_encode(role) END) + len(': ')
             + len(regexp_replace(t, '(\\|###|</turn>)', '\\\1', 'g')) + len('</turn>') + 1 AS size,
             (was || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS fits FROM o)
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY nth)) AS turns_sha256, coalesce(sum(len(t)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::bigint AS formatted_chars, bool_and(fits) AS valid
FROM x GROUP BY conv_id""",
    "op11_spelling": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, {_LOWERED.format("w")} AS w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS w FROM documents) WHERE len(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, {_CRC.format("(coalesce(doc_id::varchar, '') || ':' || w)")} AS h FROM r, crc),
v AS (SELECT w, sum(n)::bigint AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % len(w))::int) || substr(w, (h % len(w))::int + 2) ELSE w END AS w, n FROM h) WHERE len(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
cut AS (SELECT w, n, k, left(w, k::int - 1) || substr(w, k::int + 1) AS c FROM (SELECT w, n, unnest(range(1, len(w) + 1)) AS k FROM v)),
near AS (SELECT a.w, b.w AS o, b.n FROM cut a JOIN cut b ON a.c = b.c AND a.k = b.k AND a.w <> b.w UNION SELECT a.w, b.w, b.n FROM cut a JOIN v b ON a.c = b.w UNION SELECT b.w, a.w, a.n FROM cut a JOIN v b ON a.c = b.w),
best AS (SELECT w, count(*) AS n_near, max(n) AS best_n, min(o) FILTER (n = m) AS best FROM (SELECT *, max(n) OVER (PARTITION BY w) AS m FROM near) GROUP BY w),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN best USING (w)),
way AS (SELECT w, form AS last FROM f WHERE form IS NOT NULL UNION ALL SELECT way.w, f.form FROM way JOIN f ON way.last = f.w WHERE f.form IS NOT NULL),
root AS (SELECT w, arg_max(last, n) AS root FROM (SELECT way.w, way.last, v.n FROM way JOIN v ON way.last = v.w) GROUP BY w)
SELECT f.w AS word, form, coalesce(root, f.w) AS root, n, n_near, form_n FROM f LEFT JOIN root USING (w)""",
    "op13_importance": rf"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY ALL),
h AS (SELECT w, ({_CRC.format("w")} % 10000)::int AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
s AS (SELECT b, sum(n)::double AS s FROM dw JOIN h USING (w) GROUP BY b),
t AS (SELECT b, sum(n)::double AS t FROM bw JOIN h USING (w) GROUP BY b),
g AS (SELECT b, floor(1000.0::double * ln((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))))::bigint AS gain FROM s LEFT JOIN t USING (b)),
x AS (SELECT doc_id, sum(n * gain)::bigint AS weight FROM dw JOIN h USING (w) JOIN g USING (b) GROUP BY doc_id),
y AS (SELECT doc_id, len(ws)::bigint AS n_features, coalesce(weight, 0) AS weight,
      (coalesce(weight, 0) + floor(-1000.0::double * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint)::bigint AS score FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM r""",
}
