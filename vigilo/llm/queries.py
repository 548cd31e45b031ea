"""The registered ``opN_`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import scratch_path, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.sharding import lpt_shards

    placed = lpt_shards(table(spark, sf_dir, "documents"), n_shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm import quality_cnn

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_cnn.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_cnn.score(docs, model)
    return scored.select(
        "doc_id",
        (quality_cnn.remainder() == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


#: Added to the conversations: texts that look like a template's control strings.
CONTROL_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _dealt(held: Column) -> Column:
    """A conversation as a JSON record, in one of the layouts that can hold it, by its id."""
    role, text = (lambda i: held[i].role), (lambda i: held[i].content)
    two = (F.size(held) == 2) & (role(0) == "user") & (role(1) == "assistant") & (text(0) != "")
    three = (F.size(held) == 3) & (role(0) == "system") & (role(1) == "user") & (role(2) == "assistant") & (text(0) != "") & (text(1) != "")
    cut = F.locate("\n\n", text(0))
    halves = two & (cut > 1) & (cut < F.length(text(0)) - 1)
    plain = ~F.exists(held, lambda t: t.role.isin("human", "gpt"))
    renamed = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    pair = lambda a, b: F.struct(text(0).alias(a), text(1).alias(b))
    made = {
        "messages": (F.lit(True), F.struct(F.transform(held, lambda t: F.struct(t.role.alias("role"), t.content.alias("content"))).alias("messages"))),
        "conversations": (plain, F.struct(F.transform(held, lambda t: F.struct(renamed(t.role).alias("from"), t.content.alias("value"))).alias("conversations"))),
        "prompt_response": (two, pair("prompt", "response")),
        "prompt_completion": (two, pair("prompt", "completion")),
        "instruction_only": (two, pair("instruction", "output")),
        "instruction": (
            halves,
            F.struct(F.substring(text(0), F.lit(1), cut - 1).alias("instruction"), F.substring(text(0), cut + 2, F.length(text(0))).alias("input"), text(1).alias("output")),
        ),
        "system_question": (three, F.struct(text(0).alias("system_prompt"), text(1).alias("question"), text(2).alias("response"))),
    }
    names = F.filter(F.array(*(F.when(can, F.lit(name)) for name, (can, _) in made.items())), lambda n: n.isNotNull())
    name = names[F.pmod(F.xxhash64("conv_id"), F.size(names)).cast("int")]
    record = F.lit(None).cast("string")
    for k, (_, fields) in made.items():
        record = F.when(name == k, F.to_json(fields)).otherwise(record)
    return record


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm import chat

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string"))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("held"))
    read = chat.read_back(chat.formatted(chat.canonical(held.select("conv_id", _dealt(F.col("held")).alias("record")))))
    lines = F.array_join(F.transform("read_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm import quality_rules

    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.spotsigs import fingerprint_with_edits

    return fingerprint_with_edits(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), width=3, max_bits=2)


def op8_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.orc_tokens import read_tokens, token_digest, write_tokens

    path = scratch_path(spark, "orc-tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_digest(read_tokens(spark, path))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.bpe import encode, read_blocks

    docs = read_blocks(spark, f"{sf_dir}/documents.parquet")
    return encode(docs, BYTE_RANKS, F.col("block"), digest=True)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.align import align

    return align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECES)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(toxicity.remainder() == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilo.llm.fim import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_license_scan": op3_license_scan,
    "op4_chat_format": op4_chat_format,
    "op5_quality_rules": op5_quality_rules,
    "op6_spotsigs": op6_spotsigs,
    "op7_simhash": op7_simhash,
    "op8_orc_tokens": op8_orc_tokens,
    "op9_packing": op9_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_fim": op13_fim,
}

def _control_marks(column: str) -> str:
    """SQL for the marks that escaping adds to a text: one for each backslash and for each control string."""
    from vigilo.llm.chat import CONTROL

    return " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in (*CONTROL, "\\"))


ORACLES: dict[str, str] = {
    "op4_chat_format": f"""
        with t as (
            select conv_id, turn, coalesce(role, '') as role, coalesce("text", '') as txt from conversations
            union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), c as (
            select conv_id, count(*) as n_turns,
                string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt) as lines,
                coalesce(string_agg(txt, '' order by turn, role, txt) filter (where role = 'assistant'), '') as loss,
                sum(23 + length(role) + length(txt) + {_control_marks("role")} + {_control_marks("txt")}) as formatted_chars
            from t group by conv_id
        )
        select cast(conv_id as bigint) as conv_id, n_turns, sha256(lines) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
            sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
        from c
    """,
    "op13_fim": """
        with d as (
            select doc_id, coalesce("text", '') as txt, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
        ), u as (
            select doc_id, txt, cast(length(txt) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
                cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4
            from d
        ), f as (
            select doc_id, txt, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
                case when txt = '' or contains(txt, '<P>') or contains(txt, '<S>') or contains(txt, '<M>') or h3 % 100 >= 90 then 'plain'
                    when h4 % 100 < 20 then 'spm' else 'psm' end as form
            from u
        ), p as (
            select *, substr(txt, 1, a) as pre, substr(txt, a + 1, b - a) as mid, substr(txt, b + 1) as suf from f
        )
        select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
            sha256(case form when 'plain' then txt when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
            sha256(txt) as restored_sha256
        from p
    """,
}
