"""The registered queries of the subpackage: each applies one operator to the
whole of its table and derives the columns of the contract from the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, chat, cuckoo, fim, line_dedup, packing, quality_classifier, quality_rules, secrets, simhash, warc, whitening
from quarry.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f
    return add


def _joined(spans):
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def _sql_spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Spans of one kind: the lengths of the matches and of what is between them
    add up to the places."""
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS k, '{kind}' AS kind, s AS start, s + length(m) AS stop FROM (
  SELECT doc_id, m, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER (
           PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m,
               unnest(regexp_split_to_array(t, '{pattern}')[1:len(regexp_extract_all(t, '{pattern}'))]) AS gap,
               unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}"""


_WITHOUT = secrets.RULES[0].pattern
_SQL_SECRETS = f"""
WITH spans AS (
{" UNION ALL ".join(_sql_spans(r.kind, k, r.pattern, (
    f"length(regexp_extract(m, '{r.pattern.replace(chr(39), chr(39) * 2)}', 2)) >= {r.min_tail}" if r.min_tail
    else f"length(m) >= {r.min_chars}")) for k, r in enumerate(secrets.RULES))}),
text AS (SELECT doc_id, k, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS s FROM spans),
joined AS (SELECT doc_id, string_agg(s, ',' ORDER BY start, k) AS every,
             string_agg(s, ',' ORDER BY start, k) FILTER (k < 3) AS base,
             count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h FROM text GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id"""


@_query("op1_secret_scan", _SQL_SECRETS)
def op1(spark, sf_dir):
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(_joined(of(*secrets.BASE)), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


@_query("op2_warc_shards", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS digest FROM p),
g AS (SELECT digest, n, max(page_id) AS top FROM k WHERE n >= {warc.REVISIT_FROM} GROUP BY digest, n)
SELECT k.page_id, CAST(k.n AS BIGINT) AS payload_bytes, k.digest AS payload_digest,
       CASE WHEN g.top <> k.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.top <> k.page_id THEN g.top END AS refers_to
FROM k LEFT JOIN g ON k.digest = g.digest AND k.n = g.n""")
def op2(spark, sf_dir):
    return warc.archive(read(spark, sf_dir, "pages")).drop("url")


@_query("op3_perplexity_rules")
def op3(spark, sf_dir):
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


@_query("op4_boosted_quality")
def op4(spark, sf_dir):
    return quality_classifier.classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query("op5_rank_queue_bpe")
def op5(spark, sf_dir):
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_texts(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


@_query("op6_simhash_groups")
def op6(spark, sf_dir):
    return simhash.simhash_groups(read(spark, sf_dir, "documents"))


@_query("op7_chat_format", f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
s AS (SELECT *, row_number() OVER w AS i, string_agg(coalesce('r' || role, '') || chr(31) || coalesce('t' || text, '') || chr(30), '') OVER w AS upto
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
e AS (SELECT conv_id, max(i) AS n FROM s GROUP BY conv_id),
whole AS (SELECT upto, min(s.conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns
          FROM s JOIN e ON s.conv_id = e.conv_id AND s.i = e.n GROUP BY upto),
kept AS (SELECT * FROM whole WHERE upto NOT IN (SELECT upto FROM s JOIN e ON s.conv_id = e.conv_id AND s.i < e.n))
SELECT k.conv_id, any_value(k.n_turns) AS n_turns, any_value(k.n_copies) AS n_copies,
       string_agg('{chat.OPEN}' || coalesce(role, 'unknown') || chr(10)
         || replace(replace(coalesce(text, ''), '<|', '<'), '|>', '>') || '{chat.CLOSE}' || chr(10), '' ORDER BY i) AS rendered
FROM kept k JOIN s ON s.conv_id = k.conv_id GROUP BY k.conv_id""")
def op7(spark, sf_dir):
    return chat.chat_formatted(read(spark, sf_dir, "conversations"))


@_query("op8_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.i, k.line, o.key IS NOT NULL AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op8(spark, sf_dir):
    kept = line_dedup.drop_shared_lines(read(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_query("op9_hilbert_neighbours")
def op9(spark, sf_dir):
    return ann.curve_neighbours(read(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


@_query("op10_best_fit_packing")
def op10(spark, sf_dir):
    return packing.best_fit_pack(read(spark, sf_dir, "documents"))


@_query("op11_cholesky_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@_query("op12_piece_table_fim", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{fim.SEED}:' || doc_id) AS d FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS tokens,
             [('0x' || d[8 * i + 1:8 * i + 8])::BIGINT for i in range(4)] AS h FROM t),
c AS (SELECT *, len(tokens)::BIGINT AS n,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= {fim.RATE} THEN 'plain'
                  WHEN h[4] % 100 < {fim.SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
             least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(tokens[1:a], '') AS pre, array_to_string(tokens[a + 1:b], '') AS mid, array_to_string(tokens[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""")
def op12(spark, sf_dir):
    return fim.fim_documents(read(spark, sf_dir, "documents"), with_output=False)


@_query("op13_cuckoo_dedup", """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""")
def op13(spark, sf_dir):
    return cuckoo.exact_dedup(read(spark, sf_dir, "documents"))
