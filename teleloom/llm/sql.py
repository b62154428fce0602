"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_BLANKS = r"[\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op5_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') as r,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') as t
  from turns)
select conv_id,
  count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length('<s>[INST] ' || r || ' [/INST] ' || t || '</s>')) as bigint) as formatted_chars
from escaped group by conv_id
"""

ORACLES["op7_exact_dedup"] = rf"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g')) as text_sha256 from documents)
select doc_id,
  min(doc_id) over (partition by text_sha256) as keep_id,
  count(*) over (partition by text_sha256) as group_size,
  doc_id = min(doc_id) over (partition by text_sha256) as kept,
  text_sha256
from t
"""

ORACLES["op8_source_mixing"] = """
with n as (select source, count(*) as n from documents group by source),
rates as (select source, 1.0::double / (select count(*) from n) * (select sum(n) from n)::double / n as rate from n),
steps as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 24) as bigint) + 1)) as k from rates),
law as (
  select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as c
  from steps),
cdf as (select source, list(c order by k) as cdf from law group by source),
drawn as (
  select d.*, len(list_filter(cdf,
    lambda c: c <= ('0x' || substr(sha256('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 13))::bigint / pow(2, 52))) as n
  from documents d join cdf on d.source is not distinct from cdf.source),
copies as (select * exclude (n), unnest(range(1, n + 1))::int as copy from drawn where n > 0)
select *, substr(sha256('mix:' || coalesce(cast(doc_id as varchar), '') || ':' || copy), 1, 16) as shuffle_key from copies
"""

ORACLES["op1_decontamination"] = rf"""
with dw as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') as w from documents),
iw as (
  select item_id, list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') as w from benchmark),
items as (select item_id, w, len(w) as n_words, least(5, len(w)) as width from iw where len(w) > 0),
ish as (
  select item_id, n_words, width, n_words - width + 1 as n, array_to_string(w[i:i + width - 1], ' ') as s, count(*) as c
  from (select *, unnest(range(1, n_words - width + 2)) as i from items) group by all),
dsh as (
  select doc_id, width, i - 1 as pos, len(w) as m, array_to_string(w[i:i + width - 1], ' ') as s
  from (select *, unnest(range(1, len(w) - width + 2)) as i from dw, (select distinct width from items))),
hits as (
  select doc_id, item_id, n, c, s, least(n_words, m) - width + 1 as n_win,
    unnest(range(greatest(0, pos - n + 1), least(pos, greatest(0, m - n_words)) + 1)) as start
  from dsh join ish using (width, s)),
shared as (
  select doc_id, item_id, start, n, n_win, sum(least(k, c)) as inter
  from (select doc_id, item_id, start, n, n_win, s, c, count(*) as k from hits group by all) group by all),
scored as (select *, inter::double / (n + n_win - inter)::double as similarity from shared)
select doc_id, item_id, max(similarity) as similarity, cast(arg_min(start, (-similarity, start)) as bigint) as first_word
from scored where similarity >= 0.8 group by doc_id, item_id
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op11_lexical_search"] = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERMS}') as t from documents),
totals as (select count(*) as docs, cast(sum(len(t)) as bigint) as terms from d where len(t) > 0),
wanted as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_TERMS}')) as term
  from benchmark where item_id is not null),
held as (
  select r, doc_id, n, term, count(*) as tf
  from (select r, doc_id, len(t) as n, unnest(t) as term from d) where term in (select term from wanted) group by all),
weights as (
  select term, cast(floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w
  from held, totals group by term, docs),
scored as (
  select item_id, r, doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // terms))))) as bigint) as score
  from held join weights using (term) join wanted using (term), totals group by item_id, r, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from scored where score > 0 and doc_id is not null qualify rank <= 50
"""

_VECTORS = """
select distinct vec_id, {columns} list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
where vec_id is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
"""

ORACLES["op12_vector_search"] = f"""
with v as ({_VECTORS.format(columns="")}),
asking as (select vec_id as query_id, x as q from v where vec_id % 50 = 0),
scored as (
  select query_id, vec_id, cast(list_dot_product(q, x) as bigint) as score
  from asking join v on vec_id <> query_id and len(q) = len(x))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from scored qualify rank <= 5
"""

ORACLES["op13_hard_negatives"] = f"""
with v as (
  {_VECTORS.format(columns="case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,")} and label is not null),
scored as (
  select a.vec_id as anchor_id, a.label = c.label as same, c.vec_id as other_id, cast(list_dot_product(a.x, c.x) as bigint) as score
  from v a join v c on len(a.x) = len(c.x) where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same and other_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id,
  cast(row_number() over (partition by anchor_id, positive_id order by score desc, other_id) as int) as rank,
  other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""
