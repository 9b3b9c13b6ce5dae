"""The operators' queries with their production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import audit, bpe, chat, decontam, fm, jaccard, langid, maglev, pieces, pii, quality_rules, tokenstore, variants
from .util import read

CONTROL = "<|im_end|><|im_start|>assistant ok"
WORD_TOKENIZER, RANKS, PIECES = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
SHARDS = [f"shard-{i:03d}" for i in range(128)]
PII_KEY = "evenkeel/surrogates/1"


def tokenizers_home() -> str:
    import public_tokenizers

    return os.environ.get("EVENKEEL_TOKENIZERS", os.path.dirname(public_tokenizers.path("README.md")))


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def rest(n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_chat_formatting(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    back = chat.read_back(chat.format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op2_token_store(spark, sf_dir):
    path = tokenstore.write_store(read(spark, sf_dir, "documents"), f"{tokenizers_home()}/{WORD_TOKENIZER}", end_id=2)
    return tokenstore.read_store(spark, path)


def op3_sharding(spark, sf_dir):
    return maglev.assign(read(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), SHARDS)


def op4_pii_surrogates(spark, sf_dir):
    return pii.replace_entities(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op5_byte_bpe(spark, sf_dir):
    return bpe.encode_documents(read(spark, sf_dir, "documents"), f"{tokenizers_home()}/{RANKS}", pattern(), digests=True)


def op6_ngram_jaccard(spark, sf_dir):
    return jaccard.join(read(spark, sf_dir, "documents"), k=4, percent=85)


def op7_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~rest(3).eqNullSafe(F.lit(1))))
    return langid.label(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(rest(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark, sf_dir):
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_quality_rules(spark, sf_dir):
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_model(spark, sf_dir):
    return fm.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").where(~rest(4).eqNullSafe(F.lit(2))))


def op10_quality_classifier(spark, sf_dir):
    scored = fm.score(read(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(rest(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling_variants(spark, sf_dir):
    return variants.group(read(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return audit.audit(audit.cells(audit.fail_masks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))))


def op13_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(read(spark, sf_dir, "documents"), f"{tokenizers_home()}/{PIECES}", digests=True)


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = [op1_chat_formatting, op2_token_store, op3_sharding, op4_pii_surrogates, op5_byte_bpe, op6_ngram_jaccard, op7_language_id, op8_decontamination, op9_quality_rules, op10_quality_classifier, op11_spelling_variants, op12_filter_audit, op13_sentencepiece, pipeline]
    return {f.__name__: f for f in own}


_WORDS8 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": rf"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM rows_),
marked AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY place) IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM placed),
runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY place) AS run FROM marked),
turns AS (SELECT conv_id, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY place) AS text FROM runs GROUP BY conv_id, run),
heard AS (SELECT conv_id, coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS loss FROM placed GROUP BY conv_id),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY run) AS s,
    sum(length(role) + 12 + 1 + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) + 11) AS f
  FROM turns GROUP BY conv_id)
SELECT said.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(s) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars
FROM said JOIN heard ON said.conv_id IS NOT DISTINCT FROM heard.conv_id""",
        "op8_decontamination": rf"""
WITH bw AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
b AS (
  SELECT item_id, len(w) AS n, w[s:s + 9] AS win FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS m FROM b),
d AS (
  SELECT doc_id, s, m, w[s:s + m - 1] AS win FROM dw, sizes, unnest(range(1, greatest(len(w) - m + 2, 1))) AS t(s)
  WHERE len(w) >= m),
hits AS (SELECT d.doc_id, d.s, d.m, b.item_id FROM d JOIN b ON d.win = b.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(s, s + m)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
        "op9_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, s, w[s:s + 7] AS g FROM d, unnest(range(1, greatest(len(w) - 6, 1))) AS t(s) WHERE len(w) >= 8),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest(range(s, s + 8)) AS p FROM win JOIN rep ON win.doc_id = rep.doc_id AND win.g = rep.g) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN cov USING (doc_id)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base),
vals AS (
  SELECT doc_id, lang, source, base_failed, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS metric,
    unnest([10000 * n_symbols // greatest(word_chars, 1), 10000 * n_dup_lines // greatest(n_lines, 1),
      10000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1)]) AS v
  FROM failed),
bucketed AS (SELECT *, v - v % CAST(pow(2, greatest(length(bin(v)) - 6, 0)) AS BIGINT) AS bucket FROM vals WHERE NOT base_failed),
q0 AS (SELECT lang, source, metric, count(*) AS n, quantile_disc(bucket, 0.25) AS a, quantile_disc(bucket, 0.75) AS b FROM bucketed GROUP BY ALL),
q1 AS (SELECT lang, metric, count(*) AS n, quantile_disc(bucket, 0.25) AS a, quantile_disc(bucket, 0.75) AS b FROM bucketed GROUP BY ALL),
q2 AS (SELECT metric, quantile_disc(bucket, 0.25) AS a, quantile_disc(bucket, 0.75) AS b FROM bucketed GROUP BY ALL),
picked AS (
  SELECT q0.lang, q0.source, q0.metric, CASE WHEN q0.n >= 50 THEN q0.a WHEN q1.n >= 50 THEN q1.a ELSE q2.a END AS a,
    CASE WHEN q0.n >= 50 THEN q0.b WHEN q1.n >= 50 THEN q1.b ELSE q2.b END AS b
  FROM q0 JOIN q1 ON q0.lang IS NOT DISTINCT FROM q1.lang AND q0.metric = q1.metric JOIN q2 ON q0.metric = q2.metric),
lim AS (
  SELECT *, greatest(b + 3 * (b - a), CASE metric WHEN 'symbols' THEN 500 WHEN 'dup_lines' THEN 5000 WHEN 'repeats' THEN 2000 ELSE 1500 END) AS top FROM picked),
over_ AS (
  SELECT DISTINCT doc_id FROM vals JOIN lim ON vals.lang IS NOT DISTINCT FROM lim.lang AND vals.source IS NOT DISTINCT FROM lim.source
    AND vals.metric = lim.metric AND v > top)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND over_.doc_id IS NULL AS kept
FROM failed LEFT JOIN over_ USING (doc_id)""",
        "op11_spelling_variants": r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w
  FROM documents),
own AS (SELECT doc_id, w, count(*) AS k FROM runs GROUP BY doc_id, w),
hashed AS (
  SELECT doc_id, w, k, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM own, crc_table),
damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
keys AS (
  SELECT word, n, word AS key FROM words
  UNION SELECT word, n, substring(word, 1, i - 1) || substring(word, i + 1) FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word
  WHERE (length(a.word) <> length(b.word)
    OR list_sum(list_transform(range(1, length(a.word) + 1), lambda i: CASE WHEN substring(a.word, i, 1) <> substring(b.word, i, 1) THEN 1 ELSE 0 END)) = 1)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * words.n THEN other END AS form,
    CASE WHEN other_n >= 2 * words.n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND place = 1),
ways AS (
  SELECT word, word AS at, form AS next FROM forms
  UNION ALL SELECT ways.word, forms.word, forms.form FROM ways JOIN forms ON ways.next = forms.word)
SELECT forms.word, forms.form, ways.at AS root, forms.n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM forms JOIN ways ON forms.word = ways.word AND ways.next IS NULL""",
        "op12_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(text) AS c,
    text <> translate(text, '#$%&*|', '') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN marks USING (doc_id)),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(f) WHERE position(f IN o) = 0),
steps AS (SELECT o, i AS step, o[i] AS f FROM orders, unnest(range(1, 6)) AS t(i) WHERE length(o) = 5),
counted AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
      || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY ALL),
judged AS (
  SELECT part, o, step, f, fails, n, good, toxic, position(f IN fails) > 0 AS here,
    translate(o[1:step - 1], fails, '') <> o[1:step - 1] AS before
  FROM counted, steps),
summed AS (
  SELECT part, o, step, f, sum(n) FILTER (NOT here AND NOT before) AS kept, sum(n) FILTER (here AND NOT before) AS removed,
    sum(n) FILTER (here AND before) AS redundant, sum(n) FILTER (fails = f) AS unique_fails,
    sum(good) FILTER (here AND NOT before) AS good_lost, sum(toxic) FILTER (here AND NOT before) AS toxic_lost
  FROM judged GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley
FROM summed""",
    }
