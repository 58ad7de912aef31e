"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

ORACLE: dict[str, str] = {
    "op7_chat_perspectives": r"""
with people as (select distinct conv_id, role as perspective from conversations where role is not null and role <> 'system'),
both_sides as (
  select c.conv_id, p.perspective, c.turn, c.role as speaker, coalesce(c.text, '') as words,
         coalesce(c.role = p.perspective, false) as mine,
         case when c.role = 'system' then 'system' when c.role = p.perspective then 'assistant' else 'user' end as role
  from conversations c join people p on c.conv_id is not distinct from p.conv_id),
named as (select *, case when role = 'user' then coalesce(speaker, 'unknown') end as name from both_sides),
headed as (select *, '<|im_start|>' || role || case when name is not null then ' name=' || name else '' end || chr(10) as head from named)
select conv_id, perspective, turn, speaker, role, name, head || words || '<|im_end|>' || chr(10) as text,
       case when mine then length(head) else 0 end::bigint as loss_start,
       case when mine then length(head || words || '<|im_end|>') else 0 end::bigint as loss_end
from headed
""",
    "op13_reversed_search": r"""
with letters as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as upper_case, 'abcdefghijklmnopqrstuvwxyz' as lower_case),
words as (
  select doc_id, unnest(regexp_extract_all(translate(text, upper_case, lower_case), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from documents, letters where text is not null),
item_words as (
  select distinct item_id, term from (
    select item_id, unnest(regexp_extract_all(translate(text, upper_case, lower_case), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark, letters where text is not null)),
sizes as (select doc_id, count(*)::bigint as n from words group by doc_id),
corpus as (select count(*)::bigint as docs, sum(n)::bigint as terms from sizes),
counts as (select doc_id, term, count(*)::bigint as tf from words where term in (select term from item_words) group by doc_id, term),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint as w from counts, corpus group by term, docs),
lengths as (select doc_id, 100 - 90 + ((90 * n * docs) // terms) as m from sizes, corpus),
scores as (
  select i.item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
  from item_words i join counts c using (term) join weights using (term) join lengths l on l.doc_id = c.doc_id
  group by i.item_id, c.doc_id)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
""",
}
