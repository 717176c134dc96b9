"""The operators of this subpackage applied to the driver tables, with the columns the comparison reads."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import bpe, chat, embedding_join, exact_dedup, line_dedup, mixing, quality, repair, simhash, suffix_tree, token_files, warc, whitening
from cytolake.runtime import shared_dir

#: the tokenizer of the queries, as the public package of vocabulary files names it
TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query("op1_source_mix")
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(documents(spark, sf_dir))
    return plan.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


@query("op2_bpe_round_trip")
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(documents(spark, sf_dir), tokenizer_path(), with_decoded=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query(
    "op4_line_dedup",
    r"""
    with lines as (
      select doc_id, generate_subscripts(l, 1) - 1 as line_no, unnest(l) as line
      from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
    k as (
      select doc_id, line_no, words, array_to_string(words, ' ') as line, len(words) as n, doc_id * 1000000 + line_no as place
      from (select doc_id, line_no, list_filter(regexp_split_to_array(
                     translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
            from lines) where len(words) > 0),
    firsts as (select line, any_value(words) as words, any_value(n) as n, min(place) as first from k group by line),
    longs as (select * from firsts where n >= 10),
    without as (
      select line, first, n, i, array_to_string(list_concat(words[1:i - 1], words[i + 1:]), ' ') as rest
      from longs, unnest(range(1, n + 1)) as t(i)),
    pairs as (
      select line, first, min(first) over (partition by n, i, rest) as near from without
      union all select b.line, b.first, a.first from without b join longs a on a.line = b.rest
      union all select a.line, a.first, b.first from without b join longs a on a.line = b.rest),
    nears as (select line, min(near) as near from pairs where near < first group by line),
    judged as (
      select doc_id, line_no, near is null and place = first as kept, coalesce(near, case when place <> first then first end) as earlier
      from k join firsts using (line) left join nears using (line))
    select doc_id, cast(line_no as integer) as line_no, kept, earlier // 1000000 as earlier_doc_id,
           cast(earlier % 1000000 as integer) as earlier_line_no from judged""",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.line_decisions(documents(spark, sf_dir))
    return lines.select(
        "doc_id", "line_no", "kept", F.col("earlier.id").alias("earlier_doc_id"), F.col("earlier.line_no").alias("earlier_line_no")
    )


@query("op5_suffix_tree")
def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.model_scores(documents(spark, sf_dir))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), folder, tokenizer_path())
    return token_files.read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_chat_windows")
def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], told.schema)
    folder = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    chat.chat_windows(told.unionByName(probe)).write.parquet(folder)
    return chat.conversation_digests(spark.read.parquet(folder))


@query("op8_embedding_links")
def op8_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query(
    "op9_exact_dedup",
    """
    with n as (
      select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
      from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = max(doc_id) over w as kept, text_sha256
    from n window w as (partition by text_sha256)""",
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = exact_dedup.exact_copies(spark, f"{sf_dir}/documents.parquet")
    return copies.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults dealt by a hash of conversation and turn: rows go, are emptied, cut, repeated or change their role."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20).alias("dealt"),
    ).where("dealt <> 0")
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("dealt") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("again")).drop("again")


#: the search of the plain recursion, from the last row back: costs, audits and lines from each of the four states on
_CRC_STEPS = ",\n    ".join(
    f"t{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from t{k})" for k in range(8)
)


def _edit_sql(edit: str, cost: int | str, to: str, line: str = "''") -> str:
    """An edit put before what follows from a state: cost, audit and lines."""
    return f"{{'c': {to}.c + {cost}, 'a': '{edit}' || {to}.a, 't': {line} || {to}.t}}"


_USER = "chr(10) || 'user:'"
_ASSISTANT = "chr(10) || 'assistant:'"


def _row_sql(state: str, keeps: list[tuple[str, str]], nxt: str, role: str) -> str:
    """Cheapest edit of a row in a state, before insertions."""
    keep = " ".join(f"when '{k}' then {_edit_sql('K', 'more', to, 'chr(10) || role || chr(58) || text')}" for k, to in keeps)
    kept = f"case when fault in (1, 2) then null else case initial {keep} end end" if keeps else "null"
    return f"list_sort(list_filter([{_edit_sql('D', 4, state)}, {kept}, case when fault not in (1, 2) then {_edit_sql('R', '3 + more', nxt, role + ' || text')} end], lambda x: x is not null))[1]"


_REPAIR_SQL = f"""
    with recursive t0 as (select i, i as c from range(256) as r(i)),
    {_CRC_STEPS},
    crc as (select list(c order by i) as codes from t8),
    dealt as (
      select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_concat([4294967295],
               list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda c: cast(ord(c) as bigint))),
               lambda a, b: xor(a >> 8, codes[1 + (xor(a, b) & 255)])), 4294967295) % 20 as d
      from conversations, crc),
    damaged as (
      select conv_id, turn, case when d = 4 then 'user' else role end as role,
             case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
             unnest(range(case when d = 3 then 2 else 1 end)) as again
      from dealt where d <> 0),
    placed as (
      select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, count(*) over (partition by conv_id) as n,
             trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
      from damaged),
    faulted as (
      select conv_id, turn, i, n, role, text, substr(role, 1, 1) as initial,
             case when body = '' then 1 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
                  when right(body, 1) not in ('.', '!', '?') then 3 else 0 end as fault
      from placed),
    rows_ as (select *, case when fault = 3 then 3 else 0 end as more from faulted),
    walk as (
      select conv_id, n + 1 as i, {{'c': 0, 'a': '', 't': ''}} as s0, {{'c': 6, 'a': 'II', 't': {_USER} || {_ASSISTANT}}} as ss,
             {{'c': 3, 'a': 'I', 't': {_ASSISTANT}}} as su, {{'c': 0, 'a': '', 't': ''}} as sa
      from rows_ where i = 1
      union all
      select conv_id, i, list_sort([b0, {_edit_sql('I', 3, 'c_u', _USER)}])[1], list_sort([bs, {_edit_sql('I', 3, 'c_u', _USER)}])[1], c_u, c_a
      from (select conv_id, i, b0, bs, list_sort([bu, {_edit_sql('I', 3, 'ba', _ASSISTANT)}])[1] as c_u, list_sort([ba, {_edit_sql('I', 3, 'bu', _USER)}])[1] as c_a
            from (select f.conv_id, f.i,
                         {_row_sql('s0', [('s', 'ss'), ('u', 'su')], 'su', _USER)} as b0,
                         {_row_sql('ss', [('u', 'su')], 'su', _USER)} as bs,
                         {_row_sql('su', [('a', 'sa')], 'sa', _ASSISTANT)} as bu,
                         {_row_sql('sa', [('u', 'su')], 'su', _USER)} as ba
                  from walk w join rows_ f on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1))),
    pairs as (select *, lag(initial) over (partition by conv_id order by i) || initial as pair from rows_),
    counted as (
      select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 1) as blank,
             count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
             count(*) filter (i > 1 and pair not in ('su', 'ua', 'au')) as illegal
      from pairs group by conv_id)
    select c.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
           coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(s0.c, 0) as bigint) as cost, coalesce(s0.a, '') as audit,
           sha256(coalesce(substr(s0.t, 2), '')) as repaired_sha256
    from (select distinct conv_id from conversations) c
    left join counted k on k.conv_id is not distinct from c.conv_id
    left join (select * from walk where i = 1) w on w.conv_id is not distinct from c.conv_id"""


@query("op11_conversation_repair", _REPAIR_SQL)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = told.select(F.col("conv_id").alias("conv")).distinct()
    return repair.digests(repair.repair(damaged(told)), every).withColumnRenamed("conv", "conv_id")


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shares = F.array(*[F.lit(float(e / found.trace)) for e in found.variances]) if found.trace else F.array().cast("array<double>")
    each = rows.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), F.lit(found.n).cast("bigint").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(found.identity_error).alias("identity_error"),
    )


@query(
    "op13_warc",
    """
    with p as (
      select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h,
             max(page_id) over (partition by coalesce(html, '')) as first_id
      from pages)
    select page_id, cast(payload_bytes as bigint) as payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + ((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)), '') as payload_digest,
           case when page_id = first_id then 'response' else 'revisit' end as record_type,
           case when page_id <> first_id then first_id end as refers_to
    from p""",
)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read_archives(spark.read.parquet(f"{folder}/manifest")).where("record_type in ('response', 'revisit')")
    of_row = lambda c: F.regexp_extract(c, "^<urn:row:(-?[0-9]+):", 1)
    whole = F.assert_true(F.col("intact"), "a record of the archives is damaged")
    return found.select(
        of_row("record_id").try_cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        F.coalesce(whole.cast("string"), "record_type").alias("record_type"), of_row("refers_to").try_cast("bigint").alias("refers_to"),
    )
