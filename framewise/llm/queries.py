"""The registered queries of the ten operators and, where SQL can say it, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprint, jaccard, lines, manifest, mixing, pii, repair, tokens, toxicity, twins, urls
from .common import Workspace, ascii_lower, table


def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op1"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.extract(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring(table(spark, sf_dir, "documents"), Workspace(spark, "op3"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.edited_neighbours(table(spark, sf_dir, "documents"), Workspace(spark, "op4"))
    return out.drop("fp", "edited_fp")


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urls.RULES, "verdict string, host string, path string")
    out = urls.judge(table(spark, sf_dir, "pages"), rules, Workspace(spark, "op5"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"), Workspace(spark, "op6"))
    out = toxicity.score(documents, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(table(spark, sf_dir, "documents"), Workspace(spark, "op7"))


def token_store(documents: DataFrame, work: Workspace) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return tokens.read_store(work, tokens.write_store(documents, work, path), tokens.wide_ids(path))


def op10_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.fit_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark, "op10"))
    return mix.rates.withColumn("unmet", F.to_json(F.create_map(*[F.lit(x) for d, v in sorted(mix.unmet.items()) for x in (d, v)])) if mix.unmet else F.lit("{}"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"), Workspace(spark, "op9")).drop("class_id")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(turns.unionByName(extra), Workspace(spark, "op8"))
    read = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), F.array_join(chat.loss_texts(F.col("formatted"), F.col("spans")), "").alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with the damage of the contract: by a hash of conversation and turn, some are dropped, emptied, robbed of
    their sentence ends, repeated or given to the user. Nulls, but for those in turn and conversation themselves, are a
    space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    text = F.when(lot == 1, "").when(lot == 2, F.translate(known("text"), ".!?", "")).otherwise(known("text"))
    role = F.when(lot == 4, "user").otherwise(known("role"))
    copies = F.when(lot == 0, 0).when(lot == 3, 2).otherwise(1)
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    told = repair.repaired(damaged(turns), Workspace(spark, "op11")).conversations
    ids = turns.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(told, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    leaves = documents.select("doc_id", "source", manifest.leaf(*values, F.col("text")).alias("digest"), manifest.leaf(*values, tampered).alias("shown"))
    made = manifest.manifest(leaves, "source", ["doc_id"], Workspace(spark, "op12")).proofs
    found = made.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", manifest.proof(F.col("path")).alias("proof_sha256"), manifest.folded(F.col("shown"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = codec.decode(codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_benchmark_leaks": op1_benchmark_leaks, "op2_personal_data": op2_personal_data, "op3_line_templates": op3_line_templates, "op4_order_minhash": op4_order_minhash, "op5_url_rules": op5_url_rules, "op6_toxicity": op6_toxicity, "op7_token_store": op7_token_store, "op8_chat_format": op8_chat_format, "op9_jaccard_join": op9_jaccard_join, "op10_soft_mix": op10_soft_mix, "op11_conversation_repair": op11_conversation_repair, "op12_merkle_manifest": op12_merkle_manifest, "op13_byte_bpe": op13_byte_bpe}
#: Words that DuckDB's patterns and Java's see alike: runs of letters and digits.
OP1 = r"""with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where doc_id is not null and text is not null),
b as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from benchmark where item_id is not null and text is not null),
q as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from b),
x as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from d),
n as (select item_id, count(*) as n_shingles from q group by 1),
m as (select doc_id, item_id, count(*) as n_shared from x join q using (s) group by 1, 2)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment from m join n using (item_id) where 10 * n_shared >= 8 * n_shingles"""

OP8 = r"""with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, regexp_matches(role || ': ' || text, '###[ \\]') or contains(role || ' ' || text, '</turn>') or contains(role, ': ') as coded from c),
n as (select *, case when coded then 15 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) else 14 + length(role) + length(text) end as chars from f)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256, cast(sum(chars) as bigint) as formatted_chars from n group by 1"""

OP9 = r"""with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where doc_id is not null),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
m as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from m join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r(doc_id, node) as (select doc_id, doc_id from w union select r.doc_id, e.b from r join e on r.node = e.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, min(r.node) as component_id from w left join n using (doc_id) join r using (doc_id) group by 1, 2"""

#: The other operators' results can't be said in SQL: tests/llm holds them against brute force, exact round trips and
#: held-out accuracy.
ORACLES = {"op1_benchmark_leaks": OP1, "op8_chat_format": OP8, "op9_jaccard_join": OP9, "op11_conversation_repair": twins.OP11, "op12_merkle_manifest": twins.OP12}
