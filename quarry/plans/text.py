"""Tokens, vocabularies, encoding, padding/masks, embedding lookups, the
bigram language model and byte-pair merges — over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.functions import vec as V
from quarry.functions.hashing import sql_hash_unit
from quarry.operators import text as T
from quarry.operators.ordering import with_global_index
from quarry.plans.common import SEED, tbl
from quarry.operators.small import local_frame
from quarry.plans.registry import register
from quarry.session import cut_lineage

R = 6
MLM_P = 0.15


@register("str_char_tokens", "SELECT t AS token, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS t FROM documents) GROUP BY t")
def q_str_char_tokens(spark, sf):
    """Characters as tokens over every document; token frequencies."""
    return T.token_counts(tbl(spark, sf, "documents"), TX.chars("text"))


@register("str_word_tokens", r"""SELECT t AS token, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM documents) GROUP BY t""")
def q_str_word_tokens(spark, sf):
    """Words by letters/digits, punctuation as single tokens, case kept."""
    return T.token_counts(tbl(spark, sf, "documents"), TX.words("text"))


@register("str_sentence_tokens", r"""SELECT doc_id, idx, sentence FROM (
  SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS idx FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(31) || '\2', 'g'), chr(31)) AS s
    FROM documents))""")
def q_str_sentence_tokens(spark, sf):
    """Sentences: split after . ! ? when whitespace and a capital follow."""
    d = tbl(spark, sf, "documents").select("doc_id", F.posexplode(TX.sentences("text")).alias("idx", "sentence"))
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), "sentence")


@register("str_special_tokens", """SELECT a.conv_id, a.turn, '[CLS] ' || a.text || ' [SEP] ' || b.text || ' [SEP]' AS framed
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def q_str_special_tokens(spark, sf):
    """[CLS] A [SEP] B [SEP] for every turn and its reply: an equi-join on
    (conversation, turn + 1), so a long conversation is no hot group."""
    c = tbl(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", TX.frame_pair("text", "reply").alias("framed"))


@register("str_special_eos", "SELECT conv_id, turn, text || ' [EOS]' AS framed FROM conversations")
def q_str_special_eos(spark, sf):
    """A [EOS] for every turn."""
    return tbl(spark, sf, "conversations").select("conv_id", "turn", TX.frame_single("text").alias("framed"))


SQL_VOCAB = """v AS (SELECT '<PAD>' AS token, 0 AS idx
      UNION ALL SELECT t, row_number() OVER (ORDER BY t) FROM (SELECT DISTINCT unnest(string_split(text, '')) AS t FROM conversations))"""


@register("str_vocab", f"WITH {SQL_VOCAB} SELECT token, idx FROM v")
def q_str_vocab(spark, sf):
    """Sorted character vocabulary of all sequences, <PAD> at index 0."""
    return T.vocabulary(tbl(spark, sf, "conversations"), TX.chars("text"))


def _encoded(spark, sf, with_labels: bool = True):
    c = tbl(spark, sf, "conversations").select("conv_id", "turn", "text")
    columns = {"ids": (TX.chars("text"), T.vocabulary(c, TX.chars("text")))}
    if with_labels:
        labels = TX.chars(TX.char_classes("text"))
        columns["labs"] = (labels, T.vocabulary(c, labels, pad=None))
    return T.encode_frames(c, columns).select("conv_id", "turn", *columns)


SQL_ENC = f"""WITH {SQL_VOCAB},
ch AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM conversations),
lb AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS li FROM (SELECT DISTINCT
         CASE WHEN regexp_matches(c, '^\\p{{L}}$') THEN 'L' WHEN regexp_matches(c, '^\\s$') THEN 'S' ELSE 'O' END AS l FROM ch)),
ce AS (SELECT conv_id, turn, pos, v.idx,
              CASE WHEN regexp_matches(c, '^\\p{{L}}$') THEN 'L' WHEN regexp_matches(c, '^\\s$') THEN 'S' ELSE 'O' END AS l
       FROM ch JOIN v ON v.token = ch.c),
enc0 AS (SELECT conv_id, turn, list(idx::INTEGER ORDER BY pos) AS ids, list(li::INTEGER ORDER BY pos) AS labs
         FROM ce JOIN lb USING (l) GROUP BY ALL),
enc AS (SELECT c.conv_id, c.turn, coalesce(ids, []::INTEGER[]) AS ids, coalesce(labs, []::INTEGER[]) AS labs
        FROM conversations c LEFT JOIN enc0 USING (conv_id, turn))"""


@register("join_vocab_encode", SQL_ENC + "\nSELECT conv_id, turn, ids FROM enc")
def q_join_vocab_encode(spark, sf):
    """Every character mapped to its vocabulary index (join by position)."""
    return _encoded(spark, sf, with_labels=False)


SQL_PAD = SQL_ENC + """,
b AS (SELECT *, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 4 AS batch FROM enc),
m AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch) AS mx FROM b),
pad AS (SELECT conv_id, turn, batch,
          list_concat(ids, list_transform(range(mx - n), lambda k: 0::INTEGER)) AS input_ids,
          list_concat(labs, list_transform(range(mx - n), lambda k: -100::INTEGER)) AS label_ids,
          list_concat(list_transform(range(n), lambda k: false), list_transform(range(mx - n), lambda k: true)) AS pad_mask FROM m)"""


def _padded(spark, sf):
    """Batches of 4 consecutive sequences in key order: the distributed index
    is built on the keys alone (a narrow table) and joined back."""
    e = _encoded(spark, sf)
    keys = with_global_index(tbl(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id", "turn"], "_i")
    e = e.join(keys.select("conv_id", "turn", F.expr("_i div 4").alias("batch")), ["conv_id", "turn"])
    return T.pad_batch(e, "ids", "labs", "batch")


@register("str_pad_mask", SQL_PAD + "\nSELECT conv_id, turn, batch, input_ids, label_ids, pad_mask FROM pad")
def q_str_pad_mask(spark, sf):
    """Batches of 4 sequences: ids padded with <PAD>=0, labels with -100,
    mask True on padding."""
    return _padded(spark, sf).select("conv_id", "turn", "batch", "input_ids", "label_ids", "pad_mask")


@register("prj_ignore_mask", SQL_PAD + """
SELECT conv_id, turn, pos, label FROM (
  SELECT conv_id, turn, unnest(label_ids) AS label, unnest(range(len(label_ids))) AS pos FROM pad) WHERE label <> -100""")
def q_prj_ignore_mask(spark, sf):
    """Drop the padded (-100) positions after exploding the label arrays."""
    p = _padded(spark, sf).select("conv_id", "turn", F.posexplode("label_ids").alias("pos", "label"))
    return p.filter(F.col("label") != TX.IGNORE_INDEX).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "label")


@register("str_mlm_mask", SQL_ENC + f""",
vs AS (SELECT count(*) AS vsize FROM v)
SELECT conv_id, turn,
  list_transform(range(len(ids)), lambda i: CASE WHEN {sql_hash_unit(SEED, 'conv_id', 'turn', 'i')} < {MLM_P} THEN vsize::INTEGER ELSE ids[i + 1] END) AS input_ids,
  list_transform(range(len(ids)), lambda i: CASE WHEN {sql_hash_unit(SEED, 'conv_id', 'turn', 'i')} < {MLM_P} THEN ids[i + 1] ELSE -100::INTEGER END) AS label_ids
FROM enc, vs""")
def q_str_mlm_mask(spark, sf):
    """Hide a seeded 15 % of positions: the input gets [MASK] (index = vocab
    size), the label keeps the hidden index, others are -100."""
    c = tbl(spark, sf, "conversations").select("conv_id", "turn", "text")
    vocab = T.vocabulary(c, TX.chars("text"))
    vsize = vocab.count()
    e = _encoded(spark, sf, with_labels=False)
    inp, lab = T.mlm_mask(F.col("ids"), ["conv_id", "turn"], MLM_P, vsize, SEED)
    return e.select("conv_id", "turn", inp.alias("input_ids"), lab.alias("label_ids"))


@register("str_embed_lookup", SQL_ENC + f""",
u AS (SELECT conv_id, turn, unnest(ids) AS idx FROM enc),
em AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
j AS (SELECT conv_id, turn, i, avg(v) AS m, count(*) AS n FROM u JOIN em ON em.vec_id = u.idx GROUP BY ALL),
g AS (SELECT conv_id, turn, max(n) AS n, list(round(m, {R}) + 0.0 ORDER BY i) AS pooled FROM j GROUP BY ALL)
SELECT enc.conv_id, enc.turn, coalesce(n, 0) AS n, pooled FROM enc LEFT JOIN g USING (conv_id, turn)""")
def q_str_embed_lookup(spark, sf):
    """Token index -> embedding row (row vec_id = index), mean-pooled per
    sequence; a sequence without a known token keeps its row (n = 0)."""
    from quarry.operators.lookup import pooled_lookup
    e = _encoded(spark, sf, with_labels=False)
    table = tbl(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("x"))
    width = table.select(F.size("x")).first()
    out = pooled_lookup(e, "ids", table, width[0] if width else 0)
    return out.select("conv_id", "turn", "n", V.round_array("pooled", R).alias("pooled"))


# -- embedding table keyed by sequence --------------------------------------------

SQL_SEQ_EMB = f"""WITH e AS (SELECT vec_id // 12 AS seq, vec_id % 12 AS pos, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
el AS (SELECT seq, count(*) AS emb_len FROM e GROUP BY seq),
s AS (SELECT seq, string_agg(CAST(label AS VARCHAR), '' ORDER BY pos) AS labels FROM e
      WHERE seq % 2 = 1 OR (pos >= 1 AND pos <= 10) GROUP BY seq),
a AS (SELECT s.seq, s.labels, length(s.labels) AS L, el.emb_len,
             CASE WHEN el.emb_len = length(s.labels) + 2 THEN 1 ELSE 0 END AS off FROM s JOIN el USING (seq))
SELECT a.seq, e.pos - a.off AS pos, substr(a.labels, (e.pos - a.off + 1)::INTEGER, 1) AS label_char,
       list_transform(e.x, lambda v: round(v, {R}) + 0.0) AS x
FROM a JOIN e USING (seq)
WHERE e.pos - a.off >= 0 AND e.pos - a.off < least(a.L, a.emb_len - 2 * a.off)"""


@register("join_embedding_lookup", SQL_SEQ_EMB)
def q_join_embedding_lookup(spark, sf):
    """Per-position vectors of a sequence joined to its label string; a
    vector table of length L+2 (begin/end rows) is stripped, otherwise both
    sides are cut to the shorter. Sequences: 12 consecutive vectors; even
    sequences carry labels for the inner 10 positions only."""
    from quarry.operators.sequence import align_embeddings
    e = tbl(spark, sf, "embeddings").select(
        F.expr("vec_id div 12").alias("seq"), (F.col("vec_id") % 12).cast("long").alias("pos"),
        F.col("embedding").cast("array<double>").alias("x"), "label")
    keep = (F.col("seq") % 2 == 1) | ((F.col("pos") >= 1) & (F.col("pos") <= 10))
    labels = (e.filter(keep).groupBy("seq")
              .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("label").cast("string").alias("l")))).alias("_s"))
              .select("seq", F.array_join(F.transform("_s", lambda t: t["l"]), "").alias("labels")))
    out = align_embeddings(labels, e.select("seq", "pos", "x"), "seq", "labels")
    return out.select("seq", "pos", "label_char", V.round_array("x", R).alias("x"))


# -- bigram language model ----------------------------------------------------------

SQL_BIGRAM = """WITH ch AS (SELECT doc_id, string_split(text, '') AS t FROM documents),
bg AS (SELECT doc_id, unnest(t[1:len(t) - 1]) AS a, unnest(t[2:len(t)]) AS b FROM ch WHERE len(t) >= 2),
vs AS (SELECT count(DISTINCT c) AS V FROM (SELECT unnest(t) AS c FROM ch)),
cnt AS (SELECT a, b, count(*) AS n FROM bg GROUP BY a, b),
na AS (SELECT a, sum(n) AS na FROM cnt GROUP BY a),
pm AS (SELECT cnt.a, cnt.b, cnt.n, (cnt.n + 1.0) / (na.na + vs.V) AS p FROM cnt JOIN na USING (a), vs)"""


@register("mdl_ngram_lm", SQL_BIGRAM + f"""
SELECT ch.doc_id, coalesce(n, 0) AS n_bigrams, loglik FROM ch LEFT JOIN (
  SELECT doc_id, count(*) AS n, round(sum(ln(p)), 4) AS loglik FROM bg JOIN pm USING (a, b) GROUP BY doc_id) USING (doc_id)""")
def q_mdl_ngram_lm(spark, sf):
    """Character bigram model with add-one smoothing over the seen
    vocabulary, and the log-likelihood of every document (null where it has
    no bigram)."""
    pairs = T.pair_counts(tbl(spark, sf, "documents"), "doc_id", TX.chars("text"))
    ll = T.bigram_loglik(pairs, "doc_id", T.bigram_model(pairs))
    return ll.select("doc_id", "n_bigrams", F.round("loglik", 4).alias("loglik"))


@register("mdl_ngram_lm_topk", SQL_BIGRAM + f"""
SELECT a, b, round(p, {R}) AS p, rk AS rank FROM (
  SELECT a, b, p, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rk FROM pm) WHERE rk <= 3""")
def q_mdl_ngram_lm_topk(spark, sf):
    """Greedy/top-3 next-character table from the same model."""
    from pyspark.sql import Window
    m = T.bigram_model(T.pair_counts(tbl(spark, sf, "documents"), "doc_id", TX.chars("text")))
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return (m.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
            .select("a", "b", F.round("p", R).alias("p"), F.col("rank").cast("long").alias("rank")))


N_MERGES = 30


def _sql_merges() -> str:
    """Words as chains of symbols, each between chr(30) and chr(31); a merge
    replaces two links by one, from the left."""
    link = lambda x: f"chr(30) || {x} || chr(31)"
    out = [r"""tok AS (SELECT t AS word, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM documents) GROUP BY t),
w0 AS MATERIALIZED (SELECT word, n, array_to_string(list_transform(string_split(word, ''), lambda c: """ + link("c") + """), '') AS s FROM tok)"""]
    for i in range(N_MERGES):
        out.append(f"""b{i} AS MATERIALIZED (SELECT a, b, sum(n)::BIGINT AS c FROM (
  SELECT unnest(l[1:len(l) - 1]) AS a, unnest(l[2:len(l)]) AS b, n FROM (
    SELECT string_split(substr(s, 2, length(s) - 2), chr(31) || chr(30)) AS l, n FROM w{i}) WHERE len(l) > 1)
  GROUP BY a, b ORDER BY c DESC, a, b LIMIT 1),
w{i + 1} AS MATERIALIZED (SELECT word, n, replace(s, {link("a")} || {link("b")}, {link("a || b")}) AS s FROM w{i}, b{i})""")
    return "WITH " + ",\n".join(out)


SQL_MERGES = _sql_merges()


@register("str_bpe", SQL_MERGES + "\n" + "\nUNION ALL ".join(
    f"""SELECT {i}::INTEGER AS rank, a AS "left", b AS "right", c AS count FROM b{i}""" for i in range(N_MERGES)))
def q_str_bpe(spark, sf):
    """30 byte-pair merges learned from the word counts of every document
    (rank, left, right, pair count)."""
    words = T.token_counts(tbl(spark, sf, "documents"), TX.words("text"))
    merges = T.bpe_learn(words.withColumnRenamed("token", "word"), N_MERGES)
    return local_frame(spark, [(i, a, b, c) for i, (a, b, c) in enumerate(merges)],
                                 "rank int, left string, right string, count long")


@register("str_bpe_apply", SQL_MERGES + f"""
SELECT word, n, string_split(substr(s, 2, length(s) - 2), chr(31) || chr(30)) AS pieces FROM w{N_MERGES}""")
def q_str_bpe_apply(spark, sf):
    """Every distinct word of the documents, cut by the 30 learned merges in
    the order of learning: (word, n, pieces)."""
    words = cut_lineage(T.token_counts(tbl(spark, sf, "documents"), TX.words("text")).withColumnRenamed("token", "word"))
    merges = T.bpe_learn(words, N_MERGES)
    return words.select("word", "n", T.bpe_apply(F.col("word"), merges).alias("pieces"))
