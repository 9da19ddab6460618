"""The queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from gleanery.llm import chat, decontam, jaccard, langid, packing, permutation, suffixes, tokencount, toxicity, warc


def queries() -> dict:
    return {
        "op1_simhash_decontamination": decontam.op1_simhash_decontamination,
        "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
        "op3_best_fit_packing": packing.op3_best_fit_packing,
        "op4_recurrent_toxicity": toxicity.op4_recurrent_toxicity,
        "op5_permutation_index": permutation.op5_permutation_index,
        "op6_trie_token_counts": tokencount.op6_trie_token_counts,
        "op7_language_mixture": langid.op7_language_mixture,
        "op8_merkle_audit": warc.op8_merkle_audit,
        "op9_chat_round_trip": chat.op9_chat_round_trip,
        "op10_suffix_dedup": suffixes.op10_suffix_dedup,
        "pipeline": corpus_pipeline.run,
    }


_OP2 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
x as (select doc_id, unnest(sh) as h from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 75 * (na.n_shingles + nb.n_shingles - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as root from documents union select e.b, r.root from r join e on e.a = r.id)
select n.doc_id, n_shingles, min(root) as component_id from n join r on r.id = n.doc_id group by 1, 2
"""

_OP8 = """
select page_id, octet_length(encode(coalesce(html, '')))::bigint as n_bytes, sha256(coalesce(html, '')) as block_sha256, coalesce(page_id % 97 <> 0, true) as intact from pages
"""

_OP9 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t as (
  select *, case role when 'user' then 4 when 'assistant' then 9 when 'system' then 6 when 'tool' then 4 else length(to_json(role)) end
    + 15 + length(text) + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars
from t group by conv_id
"""

_OP10 = """
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, i, substr(h, 2 * i + 1, 100) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 49)) as i from b where length(h) >= 100)),
c as (select doc_id, i from s join (select k, min(doc_id) as first from s group by k) using (k) where first < doc_id),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from
  (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from c)),
r as (select doc_id, min(i) as a, max(i) + 50 as z from g group by doc_id, g),
q as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as was from r),
v as (select b.doc_id, length(h) // 2 as n_bytes, coalesce(sum(z - a), 0) as n_removed, count(a) as n_spans, coalesce(max(z), 0) as last,
  coalesce(string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' order by a), '') as front, any_value(h) as h from b left join q on q.doc_id = b.doc_id group by b.doc_id, h)
select doc_id, n_bytes::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(front || substr(h, 2 * last + 1))) as kept_sha256 from v
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say in reasonable time over whole tables; the others are tested against brute force."""
    return {"op2_ngram_jaccard_join": _OP2, "op8_merkle_audit": _OP8, "op9_chat_round_trip": _OP9, "op10_suffix_dedup": _OP10}
