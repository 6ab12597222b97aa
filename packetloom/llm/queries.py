"""The ``opN_<name>`` queries: each operator over its whole table, with the digests of its contract."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.llm import chat, egrid, jaccard, licenses, mixing, packing, periods, phrases, pii, quality, secrets, toxicity, trie
from packetloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

#: The tokenizer of the packing query; a parameter of the operator.
VOCABULARY = "word_bpe_49k.json"
SQL_WORD = r"[^\x20\x09-\x0D]+"

SQL_OP3 = rf"""
with sized as (
  select doc_id, case when source is null then '1' else '0' || source end as skey, md5(coalesce(doc_id::varchar, '')) as key,
         coalesce(len(regexp_extract_all(text, '{SQL_WORD}')), 0)::bigint as size from documents),
s as (select skey, sum(size)::bigint as source_size, row_number() over (order by skey) - 1 as k from sized group by skey),
w as (select *, (case k % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint as w, source_size * 2 as cap,
             1.5::double * sum(source_size) over ()::double as budget from s),
r as (select *, cap / w::double as ratio from w),
l as (select *, (budget - coalesce(sum(cap) over (order by ratio, skey rows between unbounded preceding and 1 preceding), 0)::double)
                / sum(w) over (order by ratio, skey rows between current row and unbounded following)::double as level from r),
t as (select skey, source_size, case when f.level is null or ratio <= f.level then cap::double else f.level * w end as target
      from l, (select arg_min(level, (ratio, skey)) filter (level < ratio) as level from l) f),
p as (select z.*, t.source_size, t.target, floor(t.target)::bigint as need,
             sum(size) over (partition by skey order by key, doc_id, size rows unbounded preceding)::bigint - size as start
      from sized z join t using (skey))
select doc_id, size, source_size, target,
       (greatest(least(start + size, need) - start, 0)
        + case when size > 0 then greatest(least(source_size + start + size, need) - source_size - start, 0) else 0 end)::bigint as taken
from p"""


@query("op3_mix_sources", SQL_OP3)
def op3(spark, sf_dir):
    return mixing.taken_words(table(spark, sf_dir, "documents"))


BAD_LINE = " or ".join(
    ["(not regexp_matches(line, '(" + SQL_WORD + r"[\x20\x09-\x0D]+){4}" + SQL_WORD + "') and not regexp_matches(line, '" + quality.ENDS.replace("'", "''") + "'))"]
    + [f"regexp_matches(line, '{rule}')" for rule in (quality.SYMBOL_ROW, quality.MENU_ROW, quality.SHOUTED, quality.BOILERPLATE)])

SQL_OP4 = rf"""
with d as (select row_number() over () as uid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}') as words from documents),
g as (select uid, i, array_to_string(words[i:i + 4], ' ') as gram from d, unnest(range(1, len(words) - 3)) as u(i) where len(words) >= 5),
dup as (select uid, i from (select *, count(*) over (partition by uid, gram) as n from g) where n > 1),
cover as (select uid, count(distinct i + k) as n_repeat_words from dup, range(5) as o(k) group by uid),
line as (select uid, line from (select uid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
judged as (select uid, count(*) - count(distinct line) as n_dup_lines,
                  sum(case when {BAD_LINE} then 0 else length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) end) as good from line group by uid),
a as (select uid, doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
             (length(text) - length(regexp_replace(text, '{quality.SYMBOL}', '', 'g')))::bigint as n_symbols from d),
b as (select a.*, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(good, 0) as good
      from a left join judged using (uid) left join cover using (uid)),
c as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and good >= 0.5 * word_chars as kept from c"""


@query("op4_quality_rules", SQL_OP4)
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_pack_best_fit")
def op10(spark, sf_dir):
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path(VOCABULARY)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op5_jaccard_join")
def op5(spark, sf_dir):
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op1_secret_scan")
def op1(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


@query("op6_pii_bootstrap")
def op6(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_context")


@query("op7_toxicity")
def op7(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_embedding_grid_join")
def op9(spark, sf_dir):
    return egrid.near_vectors(table(spark, sf_dir, "embeddings"))


SQL_OP2 = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) as v(k, r)),
e as (select *, length(text) + 3 * length(text) - length(replace(text, '<', '')) - length(replace(text, '[', '')) - length(replace(text, '\', '')) as shown,
             length(role) + 3 * length(role) - length(replace(role, '<', '')) - length(replace(role, '[', '')) - length(replace(role, '\', ''))
             + 3 * (length(role) - length(replace(role, chr(10), ''))) as shown_role from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       (3 + sum(8 + shown_role + 1 + shown + 4))::bigint as formatted_chars
from e group by conv_id"""


@query("op2_chat_format", SQL_OP2)
def op2(spark, sf_dir):
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_conversations(turns)).drop("n_unstable")


@query("op8_license_scan")
def op8(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    runs, best = F.col("runs"), F.col("best")
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size(runs) == 0, "").otherwise(F.concat(F.array_join(lines, "\n"), F.lit("\n")))
    found = periods.periodic_runs(periods.planted(docs)).withColumn("best", periods.strongest(runs))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


@query("op12_phrase_fingerprint")
def op12(spark, sf_dir):
    return phrases.edit_likeness(table(spark, sf_dir, "documents"))


SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)), 4294967295::bigint)"""

SQL_OP11 = f"""
with t as (select conv_id, turn, md5(concat(length(coalesce(role, ''))::varchar, ':', coalesce(role, ''), coalesce(text, ''))) as token,
                  strlen(coalesce(text, ''))::bigint as bytes from conversations where conv_id is not null),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, token) as pos from t),
c as (select conv_id, {SQL_CRC32} % 9 as h from (select distinct conv_id from t)),
r0 as (select c.conv_id, 0 as own, pos, token, bytes from c join o on o.conv_id = c.conv_id - c.conv_id % 5 and pos <= h
       union all select conv_id, 1, pos, token, bytes from o join c using (conv_id) where pos > h),
r as (select conv_id, row_number() over (partition by conv_id order by own, pos) as depth, token, bytes from r0),
p as (select conv_id, depth, bytes, md5(string_agg(token, '') over (partition by conv_id order by depth)) as name from r
      union all select conv_id, 0, 0, 'root' from c),
n as (select name, min(conv_id) as conv_id, max(depth)::bigint as depth, count(*) as n_convs, max(bytes) as bytes from p group by name),
e as (select name, string_agg(conv_id::varchar, ',' order by conv_id) as ids
      from p join (select conv_id, max(depth) as depth from p group by conv_id) using (conv_id, depth) group by name),
q as (select n.*, p.name as parent from n left join p on p.conv_id = n.conv_id and p.depth = n.depth - 1),
k as (select parent as name, count(*) as n_children from q where parent is not null group by parent),
w as (select q.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * bytes as saved from q left join k using (name)),
s as (select p.name, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
      from w join p on p.conv_id = w.conv_id and p.depth <= w.depth group by p.name)
select w.conv_id, w.depth, u.conv_id as parent_conv_id, w.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from w join s using (name) left join n u on u.name = w.parent left join e on e.name = w.name"""


@query("op11_prefix_trie", SQL_OP11)
def op11(spark, sf_dir):
    own = trie.turns(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.regrown(own, F.crc32(F.col("conv_id").cast("string")) % 9))
