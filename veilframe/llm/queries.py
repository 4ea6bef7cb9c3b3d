"""One query for each operator, on whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit_packing, chat_format, conversation_repair, embedding_dedup, exact_dedup, line_dedup, minhash_dedup, packing, pii, prefix_trie, sentencepiece_viterbi, tokens, toxicity


#: Key of the registered query alone, so that its result can be repeated; callers bring their own.
PII_KEY = "registered query"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_token_files(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return tokens.read_token_files(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    labels = _table(spark, sf_dir, "labels").where(~held).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_classes(_table(spark, sf_dir, "documents"), words=2)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = chat_format.format_threads(chat_format.as_threads(rows.unionByName(more)))
    turns = chat_format.read_turns(F.col("formatted"))
    loss = chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = done.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(_table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", "pii_count", F.array_join("pii_kinds", ",").alias("pii_kinds"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece_viterbi.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    back = sentencepiece_viterbi.decode(coded.drop("text"), tokenizer("piece_bpe_32k.model"))
    return back.select("doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bestfit_packing.pack_best_fit(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return done.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv")
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), F.crc32(conv.cast("string")) % 6, conv - conv % 100)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    report, turns = conversation_repair.repair(conversation_repair.damaged(rows))
    told = report.join(conversation_repair.repaired_text(turns), "key", "left")
    ids = rows.select("conv_id").distinct().withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(told, "key", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1,
    "op2_token_files": op2,
    "op3_toxicity": op3,
    "op4_line_dedup": op4,
    "op5_minhash_near_dedup": op5,
    "op6_chat_formatting": op6,
    "op7_pii_surrogates": op7,
    "op8_exact_dedup": op8,
    "op9_sentencepiece": op9,
    "op10_packing": op10,
    "op11_bestfit_packing": op11,
    "op12_prefix_trie": op12,
    "op13_conversation_repair": op13,
}

#: CRC-32 (reflected, polynomial 0xEDB88320) of the text ``{x}``, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length({x}) + 1), lambda i: unicode({x}[i])::ubigint)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::ubigint[]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"

_LINKED = "r(x, y) as (select id, id from n union select r.x, l.b from r join l on r.y = l.a)"

ORACLE = {
    "op1_embedding_near_dedup": f"""
with recursive n as (select vec_id id, label, embedding::double[] e from embeddings),
l as (select a.id a, b.id b from n a join n b on a.label = b.label and a.id <> b.id and list_cosine_similarity(a.e, b.e) >= 0.93),
{_LINKED}
select n.id vec_id, (select count(*) from l where a = n.id) n_links, min(y) component_id, n.id = min(y) kept from n join r on r.x = n.id group by n.id""",
    "op5_minhash_near_dedup": rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
s as (select doc_id id, list_distinct(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) sh from w),
e as (select id, unnest(sh) g from s), n as (select id, len(sh) n from s),
p as (select a.id a, b.id b, count(*) c from e a join e b on a.g = b.g and a.id < b.id group by 1, 2),
o as (select a, b from p join n x on x.id = a join n y on y.id = b where 100 * c >= 80 * (x.n + y.n - c)),
l as (select a, b from o union all select b, a from o),
{_LINKED}
select n.id doc_id, n.n n_shingles, min(y) component_id, n.id = min(y) kept from n join r on r.x = n.id group by 1, 2""",
    "op6_chat_formatting": r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, i, case i when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2) t(i)),
g as (select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) lines,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '') loss,
  sum(length(role) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 17) formatted_chars from c group by conv_id)
select conv_id, n_turns, sha256(lines) turns_sha256, length(loss) loss_chars, sha256(loss) loss_sha256, formatted_chars::bigint formatted_chars from g""",
    "op8_exact_dedup": """
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(coalesce(text, '')) text_sha256
from documents window w as (partition by coalesce(text, ''))""",
    "op12_prefix_trie": f"""
with o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first) i, coalesce(role, '') r, coalesce("text", '') x from conversations),
h as (select conv_id, conv_id - conv_id % 100 base, ({_CRC.format(x="(conv_id::varchar)")} % 6)::bigint h from (select distinct conv_id from conversations)),
taken as (select h.conv_id, i, r, x from h join o on o.conv_id = base where i <= h), held as (select conv_id, max(i) n from taken group by 1),
b as (from taken union all select o.conv_id, i - h + coalesce(n, 0), r, x from o join h using (conv_id) left join held using (conv_id) where i > h),
d as (select conv_id, i, length(x) chars, list(sha256(length(r) || ':' || r || x)) over (partition by conv_id order by i rows unbounded preceding) k from b union all select conv_id, 0, 0, [] from h),
n as (select k, min(conv_id) c, any_value(i) i, count(*) n_convs, any_value(chars) chars from d group by k),
e as (select c, i, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) ends from (select d.conv_id, n.c, n.i from d join n using (k) qualify row_number() over (partition by d.conv_id order by d.i desc) = 1) group by 1, 2),
t as (select n.*, p.c parent, (select count(*) from n m where len(m.k) = len(n.k) + 1 and m.k[: len(n.k)] = n.k) kids from n left join n p on len(n.k) > 0 and p.k = n.k[: -2]),
s as (select a.k, sum((t.kids = 0)::int) leaves, sum((t.n_convs - 1) * t.chars) saved from t join d a on a.conv_id = t.c and a.i <= t.i group by 1)
select t.c conv_id, t.i "depth", parent parent_conv_id, n_convs, kids n_children, leaves::bigint n_leaves, saved::bigint saved_tokens, coalesce(ends, sha256('')) ends_sha256
from t join s using (k) left join e on e.c = t.c and e.i = t.i""",
    "op13_conversation_repair": f"""
with recursive z as (select *, {_CRC.format(x="(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 hit from conversations),
dam as (select conv_id, turn, case hit when 4 then 'user' else coalesce(role, ' ') end r, case hit when 1 then '' when 2 then regexp_replace(coalesce("text", ' '), '[.!?]', '', 'g') else coalesce("text", ' ') end x
  from z, range(2) c(c) where hit <> 0 and (c = 0 or hit = 3)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, r, x) i, rtrim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) tail from dam),
f as (select *, case when tail = '' then 'blank' when row_number() over (partition by conv_id, r, x order by i) > 1 then 'duplicate' when tail[-1] not in ('.', '!', '?') then 'truncated' else 'none' end fault, lag(r[1]) over (partition by conv_id order by i) was from o),
y as (select *, case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(case when r[1] in ('s', 'u', 'a') then r[1] else 'o' end) when r[1] in ('s', 'u', 'a') then r[1] else 'o' end sym from f),
ins(p, q, c, a) as (values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (3, 2, 2, 'I'), (2, 3, 2, 'I'), (0, 3, 4, 'II'), (1, 3, 4, 'II')),
rd(ch, p, q) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ed as (select sym, p, p q, 3 c, 'D' a from (select distinct sym from y), range(4) t(p) union all select sym, p, q, 2 + (sym = upper(sym))::int, 'R' from (select distinct sym from y where sym <> 'x'), rd where ch <> 's'
  union all select sym, p, q, (sym = upper(sym))::int, 'K' from (select distinct sym from y) join rd on ch = lower(sym)),
st as (select sym, ed.p, ins.q, ed.c + ins.c c, ed.a || ins.a a from ed join ins on ins.p = ed.q),
dp(conv_id, i, q, c, a) as (
  select conv_id, 0::bigint, q, c, a from (select distinct coalesce(conv_id::varchar, ' ') conv_id from dam), ins where p = 0
  union all
  select conv_id, i, q, m.c, m.a from (select dp.conv_id, dp.i + 1 i, st.q, min({{'c': dp.c + st.c, 'a': dp.a || st.a}}) m from dp join y on coalesce(y.conv_id::varchar, ' ') = dp.conv_id and y.i = dp.i + 1 join st on st.sym = y.sym and st.p = dp.q group by 1, 2, 3)),
n as (select coalesce(conv_id::varchar, ' ') conv_id, count(*) n from y group by 1),
best as (select conv_id, min({{'c': c, 'a': a}}) m from dp join n using (conv_id) where i = n and q in (0, 3) group by 1),
au as (select conv_id, m.c, m.a, unnest(range(1, length(m.a) + 1)) j from best),
le as (select conv_id, j, a[j] e, length(replace(a[:j], 'I', '')) i, length(replace(a[:j], 'D', '')) o from au),
kept as (select le.*, y.r, coalesce(y.x, '') x, max((o = 1 and e = 'K' and y.r[1] = 's')::int) over (partition by le.conv_id) s from le left join y on e <> 'I' and coalesce(y.conv_id::varchar, ' ') = le.conv_id and y.i = le.i where e <> 'D'),
rep as (select conv_id, string_agg(case when e = 'K' then r when (o + s) % 2 = 1 then 'user' else 'assistant' end || ':' || x, chr(10) order by o) rep from kept group by 1),
w as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') dup, count(*) filter (fault = 'truncated') trunc, count(*) filter (was is not null and was || r[1] not in ('su', 'ua', 'au')) illegal from y group by 1)
select k.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(dup, 0) duplicate, coalesce(trunc, 0) truncated, coalesce(illegal, 0) illegal, coalesce(m.c, 0)::bigint "cost", coalesce(m.a, '') audit, sha256(coalesce(rep, '')) repaired_sha256
from (select distinct conv_id from conversations) k left join w on w.conv_id is not distinct from k.conv_id left join best on best.conv_id = coalesce(k.conv_id::varchar, ' ') left join rep on rep.conv_id = coalesce(k.conv_id::varchar, ' ')""",
}
