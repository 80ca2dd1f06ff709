"""Registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starwright.llm import (byte_bpe, chat_format, conversation_trie, exact_dedup, fill_in_middle, lz_fingerprint,
                            ngram_join, packing, piece_fst, quality, suffix_dedup, token_files, toxicity)
from starwright.llm.common import Scratch, table
from starwright.llm.labels import remainder
from starwright.llm.tokens import tokenizer_path


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the removal of repeated 400-byte passages leaves of every text, and
    how much of it repeated passages of over 50 words cover."""
    return suffix_dedup.removal_digests(table(spark, sf_dir, "documents"), words=suffix_dedup.PASSAGE_WORDS)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of exact de-duplication for every document."""
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces and decoded again."""
    model = piece_fst.model_path()
    docs = table(spark, sf_dir, "documents")
    back = piece_fst.decode_ids(piece_fst.encode_texts(docs, model), model)
    return back.select("doc_id", "n_tokens", "ids_crc32",
                       F.length("text").cast("long").alias("decoded_chars"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def _judged(scores: DataFrame, held_out, threshold: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels not held out."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return _judged(toxicity.score(docs, model), held_out, toxicity.THRESHOLD)


def op5_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return lz_fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in the packed sequences."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of every document over links of 5-word shingles at 0.8."""
    return ngram_join.linked_groups(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to compressed files and read back."""
    path = f"{Scratch(spark, 'token-file-set').root}"
    token_files.write_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.read_digests(spark, path)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted
    and read back from the formatted text and its loss spans."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(tricky).alias("text"))
    out = chat_format.format_turns(chats.unionByName(extra))
    turn = chat_format.read_turn(F.col("formatted"))
    back = out.select(
        "conv_id", "seq", "step_valid", F.length("formatted").cast("long").alias("chars"),
        F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")).alias("line"),
        chat_format.read_turn_loss(F.col("formatted"), F.col("start"), F.col("loss_start"),
                                   F.col("loss_length")).alias("loss"))
    # The digests are of whole conversations: what is read back of one has to fit into a row.
    whole = back.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.coalesce(F.sum(F.length("loss").cast("long")), F.lit(0)).alias("loss_chars"),
        F.sum("chars").alias("formatted_chars"), F.bool_and("step_valid").alias("valid"),
        F.sort_array(F.collect_list(F.struct("seq", "line", "loss"))).alias("turns"))
    joined = lambda name: F.array_join(F.transform("turns", lambda x: x[name]), "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("line").cast("binary"), 256).alias("turns_sha256"), "loss_chars",
        F.sha2(joined("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "valid")


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) || '>' || role
              IN ('>system', '>user', 'system>user', 'assistant>user', 'user>assistant') AS fits,
         length('### ' || role || ': ' || replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')
                || '</turn>' || chr(10)) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(fits) AS valid
FROM t GROUP BY conv_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels not held out."""
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels")
    measured = quality.measure(docs, labels, ~held_out)
    model = quality.fit_measured(measured, labels, ~held_out)
    return _judged(quality.score_measured(measured, model), held_out, quality.THRESHOLD)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and put together anew, and put back again."""
    how = fill_in_middle.Infill()
    out = fill_in_middle.transform(table(spark, sf_dir, "documents"), how)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                      sha(fill_in_middle.restored(F.col("output"), F.col("form"), how)).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
             CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT doc_id, text, n, least(c1, c2) AS p, greatest(c1, c2) AS m,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
                  WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, left(text, p) AS prefix, substring(text, p + 1, m - p) AS middle, substring(text, m + 1) AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM o
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to byte-level tokens and decoded again."""
    path = byte_bpe.tokenizer_path()
    back = byte_bpe.decode_ids(byte_bpe.encode_texts(table(spark, sf_dir, "documents"), path), path)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
                       sha(F.col("text")).alias("decoded_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, rebuilt to share their
    first turns."""
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


# crc32 of the decimal id, bit by bit.
OP13_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n_own,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 6 AS h
  FROM own GROUP BY conv_id),
lent AS (SELECT c.*, least(c.h, coalesce(b.n_own, 0)) AS lent FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
t AS (
  SELECT l.conv_id, o.pos, o.role, o.text FROM lent l JOIN own o ON o.conv_id = l.base AND o.pos < l.lent
  UNION ALL
  SELECT l.conv_id, o.pos - l.h + l.lent, o.role, o.text FROM lent l JOIN own o USING (conv_id) WHERE o.pos >= l.h),
m AS (
  SELECT conv_id, pos + 1 AS depth, length(text) AS chars, list(md5(length(role) || ':' || role || text)) OVER (
           PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM t
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY depth, path),
kids AS (SELECT path[:-2] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (depth, path)),
below AS (
  SELECT m.depth, m.path, count(*) FILTER (u.n_children = 0) AS n_leaves,
         CAST(sum((u.n_convs - 1) * u.chars) AS BIGINT) AS saved_tokens
  FROM full_nodes u JOIN m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.depth, m.path),
last AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
ends AS (
  SELECT m.depth, m.path, sha256(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id)) AS ends_sha256
  FROM m JOIN last USING (conv_id, depth) GROUP BY m.depth, m.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves, b.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes n JOIN below b USING (depth, path) LEFT JOIN ends e USING (depth, path)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:-2]
"""


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_toxicity": op4_toxicity,
    "op5_lz_fingerprint": op5_lz_fingerprint,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_files": op8_token_files,
    "op9_chat_format": op9_chat_format,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL = {
    "op2_exact_dedup": OP2_SQL,
    "op9_chat_format": OP9_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op13_conversation_trie": OP13_SQL,
}
