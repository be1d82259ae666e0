"""Registered queries of the training-data operators: thin layers over the operators' results."""

from __future__ import annotations

import importlib

from pyspark.sql import functions as F

from pairlab.llm.chat import digests, format_windows
from pairlab.llm.decontaminate import contamination
from pairlab.llm.html_text import extract_text
from pairlab.llm.lm import pseudo_likelihood
from pairlab.llm.near import near_duplicates
from pairlab.llm.negatives import hard_negatives
from pairlab.llm.packing import pack
from pairlab.llm.quality import judge_quality
from pairlab.llm.records import read_records, write_records
from pairlab.llm.substring import remove_repeated
from pairlab.llm.tables import PLANS, SQL, Staged, query, table  # noqa: F401
from pairlab.llm.toxicity import toxicity
from pairlab.llm.trie import numbered_turns, prefix_trie, with_borrowed_starts
from pairlab.llm.urls import judge
from pairlab.sources.staging import new_folder

#: Name of the module that knows where the public tokenizers' files are.
TOKENIZER_FILES = "public_tokenizers"


def tokenizer_path(name: str) -> str:
    return importlib.import_module(TOKENIZER_FILES).path(name)


@query("op1_chat_windows")
def op1_chat_windows(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], talk.schema)
    return digests(format_windows(talk.union(extra), tokenizer_path("word_bpe_49k.json")))


@query("op2_near_duplicates")
def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op3_repeated_passages", r"""
with d as (
  select doc_id, row_number() over () as rk,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents), win as (
  select rk, i, array_to_string(w[i + 1:i + 35], ' ') as s from d, unnest(range(0, greatest(len(w) - 34, 0))) t(i)), twice as (
  select s from win group by s having count(*) > 1), gone as (
  select rk, list(distinct p) as ps from (
    select rk, unnest(range(i, i + 35)) as p from win where s in (select s from twice)) group by rk)
select doc_id, len(w) as n_words, coalesce(len(ps), 0) as n_removed, sha256(coalesce(array_to_string(
         list_filter(w, lambda x, k: not list_contains(coalesce(ps, []), k - 1)), ' '), '')) as kept_sha256
from d left join gone using (rk)""")
def op3_repeated_passages(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated(documents).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op4_pseudo_likelihood")
def op4_pseudo_likelihood(spark, sf_dir):
    return pseudo_likelihood(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


# The url rules of the contract.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


@query("op6_url_rules", r"""
with rules(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
       ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')), p as (
  select page_id, row_number() over () as rk,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages), best as (
  select rk, arg_max(rhost || rpath, len(rhost || rpath)) as rule, arg_max(verdict, len(rhost || rpath)) as verdict
  from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by rk)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (rk)""")
def op6_url_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_benchmark_contamination", r"""
with d as (
  select doc_id, text, row_number() over () as rk, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents), b as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark), bw as (
  select distinct item_id, least(13, len(w)) as l, array_to_string(w[i + 1:i + least(13, len(w))], ' ') as s
  from b, unnest(range(0, len(w) - least(13, len(w)) + 1)) t(i) where len(w) > 0), dw as (
  select rk, i, l, array_to_string(w[i + 1:i + l], ' ') as s from d, (select distinct l from bw), unnest(range(0, greatest(len(w) - l + 1, 0))) t(i)), hits as (
  select rk, i, dw.l, item_id from dw join bw on dw.l = bw.l and dw.s = bw.s), hit as (
  select rk, count(distinct p) as n_hit from (select rk, unnest(range(i, i + l)) as p from hits) group by rk), items as (
  select rk, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as names
  from hits group by rk)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (rk) left join items using (rk)""")
def op7_benchmark_contamination(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(documents, table(spark, sf_dir, "benchmark"))


@query("op8_quality_rules", r"""
with d as (
  select doc_id, row_number() over () as rk, coalesce(lang, '') as stratum, coalesce(text, '') as text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents), win as (
  select rk, i, array_to_string(w[i + 1:i + 5], ' ') as s from d, unnest(range(0, greatest(len(w) - 4, 0))) t(i)), twice as (
  select rk, s from win group by rk, s having count(*) > 1), rep as (
  select rk, count(distinct p) as r from (select win.rk, unnest(range(i, i + 5)) as p from win join twice on win.rk = twice.rk and win.s = twice.s)
  group by rk), c as (
  select doc_id, rk, stratum, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) as n_lines,
         len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r, 0) as n_repeat_words from d left join rep using (rk)), f as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
         least(40, (10 * n_symbols) // greatest(n_words, 1)) as symbols, (40 * n_dup_lines) // greatest(n_lines, 1) as lines,
         (40 * n_repeat_words) // greatest(n_words, 1) as repeats, least(40, (4 * word_chars) // greatest(n_words, 1)) as long_words,
         40 - least(40, (4 * word_chars) // greatest(n_words, 1)) as short_words from c), good as (
  select f.* from f where not base_failed and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)), long as (
  select stratum, 'symbols' as rule, symbols as level from good union all select stratum, 'lines', lines from good
  union all select stratum, 'repeats', repeats from good union all select stratum, 'long_words', long_words from good
  union all select stratum, 'short_words', short_words from good), pairs as (
  select stratum, rule, count(*) as n from long group by all), trials as (
  select p.stratum, p.rule, p.n, cutoff, (select count(*) from long l where l.stratum = p.stratum and l.rule = p.rule and l.level >= cutoff) as k
  from pairs p, unnest(range(1, 42)) t(cutoff)), tested as (
  select stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99))) as p
  from trials, unnest(range(0, k + 1)) t(j) where k < n * 0.01 group by all), cuts as (
  select stratum, rule, min(cutoff) as cutoff from tested where p <= 0.05 / (select count(*) from pairs) group by all having min(cutoff) <= 40), wide as (
  select stratum, max(cutoff) filter (rule = 'symbols') as c1, max(cutoff) filter (rule = 'lines') as c2, max(cutoff) filter (rule = 'repeats') as c3,
         max(cutoff) filter (rule = 'long_words') as c4, max(cutoff) filter (rule = 'short_words') as c5 from cuts group by stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(symbols >= c1, false) and not coalesce(lines >= c2, false) and not coalesce(repeats >= c3, false)
       and not coalesce(long_words >= c4, false) and not coalesce(short_words >= c5, false) as kept
from f left join wide using (stratum)""")
def op8_quality_rules(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return judge_quality(documents, table(spark, sf_dir, "labels")).drop("rejected_by")


@query("op9_main_text")
def op9_main_text(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op10_packed_sequences")
def op10_packed_sequences(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(documents, tokenizer_path("word_bpe_49k.json"))


@query("op11_binary_records")
def op11_binary_records(spark, sf_dir):
    folder = new_folder(spark, "records")
    write_records(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), folder)
    return read_records(spark, folder, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op12_hard_negatives", r"""
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0), s as (
  select a.rid as anchor, a.vec_id as anchor_id, b.rid, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.e, b.e) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.rid <> b.rid), p as (
  select * from (select *, row_number() over (partition by anchor order by score desc, vec_id) as k from s where same) where k <= 5), n as (
  select p.anchor, p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor, p.k order by s.score desc, s.vec_id) as rank
  from p join s on s.anchor = p.anchor and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3""")
def op12_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


@query("op13_prefix_trie", r"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as place,
         coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null), c as (
  select conv_id, conv_id - conv_id % 20 as lender, xor(4294967295, list_reduce(
           list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda x: unicode(x)::bigint)),
           lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda r, k: xor(r >> 1, case when r & 1 = 1 then 3988292384::bigint else 0::bigint end)))) % 4 as h
  from (select distinct conv_id from t)), own as (
  select c.conv_id, s.place, s.role, s.text from c join t s on s.conv_id = c.lender and s.place <= c.h
  union all select c.conv_id, t.place + 4, t.role, t.text from c join t on t.conv_id = c.conv_id and t.place > c.h), path as (
  select c.conv_id, coalesce(list({'r': role, 't': text} order by place) filter (place is not null), []) as p from c left join own using (conv_id) group by c.conv_id), pre as (
  select conv_id, len(p) as n, d, p[1:d] as q from path, unnest(range(0, len(p) + 1)) r(d)), node as (
  select q, d, min(conv_id) as conv_id, count(*) as n_convs, count(*) filter (n = d) as n_ends, max(n) = d as leaf,
         sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d), '')) as ends_sha256,
         len(regexp_extract_all(case when d = 0 then '' else q[d].t end, '[^\x20\x09-\x0D]+')) as w from pre group by q, d), below as (
  select a.q, a.d, cast(count(*) filter (b.leaf) as bigint) as n_leaves, cast(sum((b.n_convs - 1) * b.w) as bigint) as saved_tokens,
         count(*) filter (b.d = a.d + 1) as n_children from node a join node b on b.d >= a.d and b.q[1:a.d] = a.q group by a.q, a.d)
select x.conv_id, x.d as depth, y.conv_id as parent_conv_id, x.n_convs, n_children, n_leaves, saved_tokens, x.ends_sha256
from node x join below on below.q = x.q and below.d = x.d left join node y on y.d = x.d - 1 and y.q = x.q[1:x.d - 1] and x.d > 0""")
def op13_prefix_trie(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = Staged(numbered_turns(talk), "turns").read()
    return prefix_trie(talk, with_borrowed_starts(talk, turns)).drop("node", "parent")
