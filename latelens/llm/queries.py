"""Queries of the text operators and the SQL that some can be written as."""

from __future__ import annotations

from .bpe import op7_bpe
from .chat import op9_chat_formatting
from .embed import op5_embedding_near_dedup
from .html import op8_html_extraction
from .jaccard import op4_ngram_jaccard
from .lm import op2_lm_scoring
from .mixing import op1_mixing
from .pii import op10_pii
from .quality import op6_quality_rules
from .quality import oracle as quality_sql
from .suffix import op3_suffix_dedup

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_html_extraction": op8_html_extraction,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_pii": op10_pii,
}

ORACLE_SQL = {
    # all pairs of sets with a common shingle, and of vectors: for small tables
    "op4_ngram_jaccard": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') as g from w, unnest(range(1, greatest(len(ws) - 2, 2))) as r(i) where len(ws) > 0
), n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 85 * (a.n + b.n - o)),
e as (select x, y from l union all select y, x from l),
r(doc_id, z) as (select doc_id, doc_id from documents union select r.doc_id, e.y from r join e on e.x = r.z)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from documents d left join n on n.doc_id = d.doc_id join (select doc_id, min(z) as component_id from r group by 1) c on c.doc_id = d.doc_id""",
    "op5_embedding_near_dedup": r"""
with recursive g as (
  select vec_id, embedding::double[] as v from embeddings where embedding is not null and len(embedding) > 0
), u as (
  select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as m from g where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0
), l as (
  select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id < b.vec_id and len(a.v) = len(b.v) where a.m > 0 and b.m > 0 and list_dot_product(a.v, b.v) / (a.m * b.m) >= 0.9
), e as (select x, y from l union all select y, x from l),
r(vec_id, z) as (select vec_id, vec_id from embeddings union select r.vec_id, e.y from r join e on e.x = r.z)
select c.vec_id, coalesce(k.n, 0)::bigint as n_links, c.component_id, c.vec_id = c.component_id as kept from (select vec_id, min(z) as component_id from r group by 1) c left join (select x, count(*) as n from e group by 1) k on k.x = c.vec_id""",
    "op6_quality_rules": quality_sql(),
    "op9_chat_formatting": """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as every,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(8 + 8 + 7 + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
      + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))) as formatted_chars
  from c group by conv_id
)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(every) as turns_sha256,
  cast(length(loss) as bigint) as loss_chars, sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from g""",
}
