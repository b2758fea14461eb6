"""The operators as queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import chat, exact_dedup, hamming, near_dup, packing, pieces, suffix_dedup, token_files, toxicity, warc
from cadenza.llm.chunks import added_tokens
from cadenza.llm.common import shared_dir, small_batches

PROBE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted, written and read back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = chat.with_probe(_table(spark, sf_dir, "conversations"), -7, PROBE)
    return chat.conversation_digests(chat.write_conversations(chat.format_conversations(rows, ranks, pattern)), ranks, pattern)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and the text decoded from them, as digests."""
    return pieces.encode_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["n_tokens", "ids_sha256", "decoded_sha256"])


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids from token files that hold all of them."""
    out = shared_dir(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, out, checksums=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its equals."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op5_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest other vectors, by the signs of their components, of every vector whose id 20 divides."""
    codes = hamming.sign_codes(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return hamming.top_k(codes, codes.where("id % 20 = 0"), k=10)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end_id=0, capacity=2048, added=added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read from archives that hold all of them."""
    out = shared_dir(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learnt outside the held-out fold."""
    documents = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(documents, toxicity.learn(documents, _table(spark, sf_dir, "labels")))


def op9_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without the 50-byte strings that a smaller document has."""
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_sentencepiece, op3_token_files, op4_exact_dedup, op5_hamming_top_k, op6_best_fit_packing, op7_warc, op8_toxicity, op9_prob_minhash, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": f"""
with c as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '{PROBE}' union all select -7, 1, 'assistant', '{PROBE}'),
e as (
  select *, case when role in ('system', 'user', 'assistant') then '' else coalesce(role, '') end as other,
    regexp_replace(text, '<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|<s>|</s>|\\[TURN\\]|\\[TEXT\\]|\\[/TURN\\]|\\\\', '\\0~', 'g') as marked from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(text) + (length(marked) - length(text))
    + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + length(other) end)::bigint as formatted_chars
from e group by conv_id""",
        "op5_hamming_top_k": """
with bits as (select vec_id, list_transform(embedding, lambda x: x > 0) as b from embeddings),
pairs as (
  select q.vec_id as query_id, x.vec_id as neighbor_id, len(list_filter(list_zip(q.b, x.b), lambda z: z[1] != z[2]))::int as distance
  from bits q, bits x where q.vec_id % 20 = 0 and q.vec_id != x.vec_id)
select query_id, rank::int as rank, neighbor_id, distance
from (select *, row_number() over (partition by query_id order by distance, neighbor_id) as rank from pairs) where rank <= 10""",
        "op4_exact_dedup": """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    }
