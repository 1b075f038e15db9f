"""The reference queries in plain SQL, for comparison."""

from gristmill.functions.text import STOPWORDS
from gristmill.plans.problem_sql import _CLEAN, _ITEMS
from gristmill.plans.reference import CLASSES, LABELS

_QUESTIONS = """
questions_asked as (
  select 'Q' || n as query_id, min(question) as text from (select try_cast(regexp_extract(qid, '(\\d+)', 1) as bigint) as n, question from questions)
  where n % 3 = 0 group by n
)
"""
_TOKENS = r"regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9\-]+')"
_CODES = r"regexp_extract_all({0}, '\b[A-Z]{{2,4}}-\d{{2,9}}(?:-v\d+)?\b')"


def _bm25(name: str, queries: str, words: str) -> str:
    return f"""
{name}_docs as (select doc_id, {words} as words from documents),
{name}_size as (select count(*) as n, avg(len(words)) as mean from {name}_docs),
{name}_tf as (select doc_id, length, term, count(*) as tf from (select doc_id, len(words) as length, unnest(words) as term from {name}_docs) group by all),
{name}_df as (select term, count(*) as df from {name}_tf group by term),
{name}_asked as (select query_id, term, count(*) as times from (select query_id, unnest({_TOKENS.format('text')}) as term from {queries}) group by all),
{name}_scores as (
  select query_id, doc_id, sum(times * ln(1.0::double + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double)
    / (tf + 1.5::double * (0.25::double + 0.75::double * length / mean))) as score
  from {name}_asked join {name}_df using (term) join {name}_tf using (term), {name}_size group by all
)"""


def _top(name: str, k: int, key: str = "doc_id") -> str:
    return f"""select query_id, {key}, score, rank from (select query_id, {key}, round(score, 6) as score,
  cast(row_number() over (partition by query_id order by round(score, 6) desc, {key}) as int) as rank from {name}) where rank <= {k}"""


_TEXT_WORDS = f"coalesce({_TOKENS.format('text')}, [])"
_BM25 = f"with {_QUESTIONS}, {_bm25('b', 'questions_asked', _TEXT_WORDS)}"
_TITLES = "titles as (select doc_id as query_id, title as text from documents where doc_id % 100 = 0)"
_TITLE = _TOKENS.format("coalesce(title, '')")
_MENTIONS = f"mentions as (select doc_id, code, count(*) as n from (select doc_id, unnest({_CODES.format('text')}) as code from documents) group by all)"
_LABELLED = f"""
labels as (
  select distinct a.query_id, coalesce(q.answerable, true) as answerable, q.gold_doc_ids
  from questions_asked a join (select 'Q' || try_cast(regexp_extract(qid, '(\\d+)', 1) as bigint) as query_id, * from questions) q
    on a.query_id = q.query_id and a.text is not distinct from q.question
),
gold as (select distinct query_id, {_CLEAN.format('code')} as code from (select query_id, unnest(gold_doc_ids) as code from labels where answerable) where {_CLEAN.format('code')} <> '')"""
_HAS = "contains(' ' || replace(regexp_replace(lower({0}), '[^a-z0-9-]+', ' ', 'g'), '-', ' ') || ' ', ' ' || replace({1}, '-', ' ') || ' ')"
_PRESENT = "case when trim({0}) <> '' and upper(trim({0})) not in ('MISSING', 'N/A', '-') then trim({0}) end"
_VECTORS = """
vector_scores as (
  select q.vec_id as query_id, e.vec_id, list_dot_product(q.embedding::double[], e.embedding::double[]) as score from embeddings q, embeddings e where q.vec_id % 100 = 0
)"""
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_COUNTS = [f"len(regexp_extract_all(lower(text), '{p}'))" for _, p in CLASSES]
_LABEL = " ".join(f"when n = n{k} then '{name}'" for k, (name, _) in enumerate(CLASSES))
_GRAPH = """
edges as (
  select 'N:' || n_nationkey as src, 'R:' || n_regionkey as dst from nation union all select 'S:' || s_suppkey, 'N:' || s_nationkey from supplier
  union all select 'C:' || c_custkey, 'N:' || c_nationkey from customer
),
links as (select src, dst from edges union select dst, src from edges)
"""

# The header's name in Latin, full-width, Cyrillic and Greek letters, with invisible characters anywhere.
_SUBJECT = r"(\n\p{Cf}*" + r"\p{Cf}*".join(
    "[" + letters + "]" for letters in ("SsＳｓЅѕ", "UuＵｕ", "BbＢｂВΒ", "JjＪｊЈјϳ", "EeＥｅЕеΕ", "CcＣｃСсϹϲ", "TtＴｔТΤ")) + r"[\p{Cf}\p{Zs}]*[:：]) *([^\n]*)"

SQL = {
    "bm25_topk": f"with {_TITLES}, {_bm25('b', 'titles', _TEXT_WORDS)} {_top('b_scores', 10)}",
    "bm25_title_weighted": f"with {_TITLES}, {_bm25('b', 'titles', f'{_TITLE} || {_TITLE} || {_TITLE} || ' + _TEXT_WORDS)} {_top('b_scores', 10)}",
    "token_df_idf": f"""
with seen as (select distinct doc_id, unnest({_TOKENS.format('text')}) as term from documents), df as (select term, count(*) as df from seen group by term)
select term, df, round(ln(1.0::double + ((select count(*) from documents) - df + 0.5::double) / (df + 0.5::double)), 6) as idf from df""",
    "vector_topk": f"with {_VECTORS} {_top('vector_scores', 10, 'vec_id')}",
    "hybrid_rrf": f"""
with titles as (select doc_id as query_id, title as text from documents where doc_id % 100 = 0 and doc_id in (select vec_id from embeddings)),
{_bm25('b', 'titles', _TEXT_WORDS)}, {_VECTORS},
words as ({_top('b_scores', 30)}), near as ({_top('(select * from vector_scores where query_id in (select query_id from titles))', 30, 'vec_id')}),
lanes as (select query_id, doc_id, 'words' as lane, 1.0::double / (60 + rank) as share from words union all select query_id, vec_id, 'vectors', 1.0::double / (60 + rank) from near),
fused as (select query_id, doc_id, sum(share) as score, string_agg(distinct lane, ',' order by lane) as lanes from lanes group by all)
select query_id, doc_id, score, lanes, rank from (select query_id, doc_id, round(score, 6) as score, lanes,
  cast(row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as int) as rank from fused) where rank <= 10""",
    "weighted_rrf_lanes": f"""
{_BM25}, {_MENTIONS},
codes as (select query_id, unnest(list_distinct({_CODES.format('text')})) as code from questions_asked),
words as ({_top('b_scores', 20)}),
structured as ({_top('(select distinct query_id, doc_id, 1.0::double as score from codes join documents on upper(trim(doc_code)) = code)', 20)}),
linked as ({_top('(select distinct query_id, doc_id, 1.0::double as score from codes join mentions using (code))', 20)}),
lanes as (select query_id, doc_id, 'hybrid' as lane, 1.0::double / (60 + rank) as share from words
  union all select query_id, doc_id, 'structured', 3.0::double / (60 + rank) from structured
  union all select query_id, doc_id, 'graph', 2.0::double / (60 + rank) from linked),
fused as (select query_id, doc_id, sum(share) as score, string_agg(distinct lane, ',' order by lane) as lanes from lanes group by all)
select query_id, doc_id, score, lanes, rank from (select query_id, doc_id, round(score, 6) as score, lanes,
  cast(row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as int) as rank from fused) where rank <= 10""",
    "lexical_rerank": f"""
with {_TITLES}, {_bm25('b', 'titles', _TEXT_WORDS)}, found as ({_top('b_scores', 20)}),
scored as (
  select f.query_id, f.doc_id, len(list_intersect({_TOKENS.format('q.text')}, {_TOKENS.format('d.text')}))::double / len(list_distinct({_TOKENS.format('q.text')})) as score
  from found f join titles q using (query_id) join documents d using (doc_id)
) {_top('scored', 10)}""",
    "coverage_fraction": rf"""
{_BM25}, found as ({_top('b_scores', 5)}),
terms as (
  select query_id, term from (select distinct query_id, unnest({_TOKENS.format("regexp_replace(text, '[A-Z]{2,4}-[0-9]{2,9}', ' ', 'g')")}) as term from questions_asked)
  where length(term) >= 4 and not regexp_full_match(term, '[0-9-]+') and term not in ({_STOP})
),
seen as (select query_id, term, max({_HAS.format('text', 'term')}::int) as seen from terms join found using (query_id) join documents using (doc_id) group by all)
select query_id, count(*) as n_terms, cast(sum(seen) as bigint) as n_present, round(avg(seen), 6) as covered, round(avg(seen), 6) >= 0.34 as enough from seen group by query_id""",
    "retrieval_quality": f"""
{_BM25}, {_LABELLED}, ranked as ({_top('b_scores', 10)}),
found as (select query_id, {_CLEAN.format('doc_code')} as code, min(rank) as rank from ranked join documents using (doc_id) group by all),
per as (select query_id, count(*) as n_gold, min(rank) as first, count(*) filter (rank <= 1) as i1, count(*) filter (rank <= 3) as i3,
  count(*) filter (rank <= 5) as i5, count(*) filter (rank <= 10) as i10 from gold left join found using (query_id, code) group by query_id)
select count(*) as n_queries, round(avg((i1 = n_gold)::int), 6) as recall_at_1, round(avg((i3 = n_gold)::int), 6) as recall_at_3,
  round(avg((i5 = n_gold)::int), 6) as recall_at_5, round(avg((i10 = n_gold)::int), 6) as recall_at_10, round(avg(coalesce(1.0::double / first, 0)), 6) as mrr from per""",
    "abstention": f"""
{_BM25}, {_LABELLED}, best as (select query_id, max(round(score, 6)) as score from b_scores group by query_id),
asked as (select query_id, max(answerable) as answerable from labels group by query_id)
select answerable, count(*) as n_queries, count(*) filter (coalesce(score, 0) >= 20) as n_answered from asked left join best using (query_id) group by 1""",
    "fact_recovery": f"""
with facts as (select distinct source_file, maps_to_doc_ids, unnest(key_facts) as fact from ingestion_manifest),
wanted as (select source_file, fact, regexp_extract(fact, '=(\\d+)', 1) as number, unnest(case when len(maps_to_doc_ids) > 0 then maps_to_doc_ids else [null] end) as code from facts),
per as (
  select w.source_file, w.fact, max(coalesce({_HAS.format('d.text', 'w.number')}, false)::int) as hit
  from wanted w left join documents d on {_CLEAN.format('d.doc_code')} = {_CLEAN.format('w.code')} group by all
)
select source_file, count(*) as n_facts, count(*) filter (hit = 1) as n_recovered from per group by source_file""",
    "doc_classify": f"""
with c as (select doc_type, {', '.join(f'{x} as n{k}' for k, x in enumerate(_COUNTS))} from documents), m as (select *, greatest({', '.join(f'n{k}' for k in range(len(CLASSES)))}) as n from c)
select doc_type, case when n is null or n = 0 then 'uncategorized' {_LABEL} end as label, case when n >= 3 then 'high' when n >= 1 then 'medium' else 'low' end as confidence,
  count(*) as n_documents from m group by all""",
    "html_strip": r"""
with d as (select doc_id, text as t from documents where regexp_matches(text, '<[a-zA-Z]')),
a as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'),
  '(?is)<nav\b[^>]*>.*?</nav\s*>', '', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', '', 'g') as t from d),
b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?i)<li\b[^>]*>', chr(10) || '- ', 'g'),
  '(?i)</(?:p|div|h[1-6]|li|tr|ul|ol|section|table)\s*>|(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') as t from a),
c as (select doc_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as t from b),
e as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from c)
select doc_id, md5(t) as plain_md5, cast(length(t) as int) as n_plain from e""",
    "mail_parts": rf"""
with d as (select doc_id, text, case when contains(text, chr(10) || chr(10)) then substr(text, instr(text, chr(10) || chr(10)) + 2) else '' end as body,
  regexp_extract(chr(10) || split_part(text, chr(10) || chr(10), 1), '{_SUBJECT}', ['whole', 'subject']) as h from documents where doc_type = 'email'),
l as (select doc_id, string_split(body, chr(10)) as l from d),
k as (select doc_id, list_filter(case when list_position(list_transform(l, lambda x: rtrim(x, ' ') = '--'), true) > 0 then l[1:list_position(list_transform(l, lambda x: rtrim(x, ' ') = '--'), true) - 1] else l end,
  lambda x: not x like '>%') as l from l)
select doc_id, case when h.whole <> '' then h.subject end as subject, case when text is not null then md5(trim(regexp_replace(array_to_string(l, chr(10)), '\n+$', ''), ' ')) end as body_md5
from d join k using (doc_id)""",
    "slug_ids": """
with b as (select p_partkey, 'ING-' || substr(upper(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), 1, 48) as base from part),
n as (select *, row_number() over (partition by base order by p_partkey) as n from b)
select p_partkey, case when n = 1 then base else base || '-' || n end as slug from n""",
    "id_extract": f"with {_MENTIONS} select code, count(*) as n_documents, cast(sum(n) as bigint) as n_mentions from mentions group by code",
    "phrase_alias_join": r"""
with s as (select supplier_id as id, regexp_replace(trim(supplier_name), '\s+', ' ', 'g') as name from suppliers_master where supplier_name is not null),
aliases as (select id, lower(name) as alias from s union all select id, lower(array_to_string(string_split(name, ' ')[1:2], ' ')) from s),
sole as (select alias, min(id) as id, trim(regexp_replace(alias, '[^\pL\pN]+', ' ', 'g')) as run from aliases where length(alias) >= 4 group by alias having count(distinct id) = 1),
d as (select doc_id, ' ' || regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g') || ' ' as t from documents)
select id, count(distinct doc_id) as n_documents from sole join d on contains(t, ' ' || run || ' ')
where run <> '' group by id""",
    "alias_resolve_flag": """
with s as (select supplier_id as id, lower(trim(supplier_name)) as alias from suppliers_master),
po as (select lower(trim(supplier)) as alias from (select distinct * from purchase_orders))
select case when coalesce(alias, '') = '' then 'empty' when alias in (select lower(id) from s) then 'id' when alias in (select alias from s where alias <> '') then 'alias' else 'unresolved' end as kind,
  count(*) as n_orders, count(distinct alias) as n_texts from po group by 1""",
    "point_lookup": "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier where s_suppkey = 7",
    "predicate_query": "select p_partkey, p_name, p_size from part where p_brand = 'Brand#13' and p_size between 10 and 30",
    "full_count_with_keys": "select n_name, count(*) as n, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as keys from supplier join nation on s_nationkey = n_nationkey group by n_name",
    "absence_check": "select c_custkey as o_custkey from customer c where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and year(o_orderdate) = 1997)",
    "attribute_lookup": f"""
with r as (select trim(supplier_id) as id, {_PRESENT.format('lead_time')} as value, 1 as turn, loaded_at from suppliers_master
  union all select trim(supplier), {_PRESENT.format('lead_time')}, 2, loaded_at from purchase_orders where trim(supplier) like 'SUP-%')
select id, value as lead_time, turn from r where value is not null qualify row_number() over (partition by id order by turn, loaded_at desc, value) = 1""",
    "line_totals": r"""
with po as (select distinct * from purchase_orders),
v as (select loaded_at, try_cast(regexp_extract(replace(qty, ',', ''), '^\s*(\d+)\s*$', 1) as bigint)::double as q,
  try_cast(regexp_extract(replace(unit_price, ',', ''), '\d+(?:\.\d+)?') as double) as p from po)
select strftime(loaded_at, '%Y-%m') as month, count(*) as n_orders, count(case when q <> 0 and p <> 0 then 1 end) as n_totals,
  sum(case when q <> 0 and p <> 0 then round(q * p, 2)::decimal(20, 2) end)::double as total from v group by 1""",
    "calc_ops": """
select l_returnflag, count(*) as n, round(sum(l_quantity), 6) as total, round(avg(l_quantity), 6) as mean, max(l_quantity) as most, min(l_quantity) as least,
  round(max(l_quantity) - min(l_quantity), 6) as spread, round(product(1 + l_discount / 1e6), 6) as growth from lineitem group by l_returnflag""",
    "unit_convert": "select p_partkey, round(p_size::double * (1 / 25.4::double), 4) as size_in from part",
    "duration_parse": r"""
with r as (select distinct * from cmms_export), t as (select wo, trim(machine) as machine, lower(trim(downtime)) as d from r),
h as (select wo, machine, round(case when regexp_full_match(d, '\d+:\d{1,2}') then split_part(d, ':', 1)::double + split_part(d, ':', 2)::double / 60
  when regexp_full_match(d, '\d+\s*h\s*\d+\s*m(in)?') then regexp_extract(d, '^(\d+)', 1)::double + regexp_extract(d, 'h\s*(\d+)', 1)::double / 60
  when regexp_full_match(d, '\d+(\.\d+)?\s*h(rs?|ours?)?') then regexp_extract(d, '^[\d.]+')::double
  when regexp_full_match(d, '\d+(\.\d+)?\s*m(in(utes?|s)?)?') then regexp_extract(d, '^[\d.]+')::double / 60 end, 4) as hours from t)
select distinct wo, machine, hours, cast(round(hours * 60) as bigint) as minutes from h""",
    "date_norm": """
select coalesce(try_strptime(trim(wo_date), '%Y-%m-%d'), try_strptime(trim(wo_date), '%m/%d/%Y'))::date as day, count(*) as n_orders
from (select distinct * from cmms_export) group by 1""",
    "lead_time_days": r"""
with t as (select lower(trim(lead_time)) as l from (select distinct * from purchase_orders))
select cast(floor(case when regexp_full_match(l, '(approx\. |lt )?\d+(\.\d+)?\s*(weeks?|wks?|w|week\(s\))') then regexp_extract(l, '(\d+(?:\.\d+)?)', 1)::double * 7
  when regexp_full_match(l, '(approx\. |lt )?\d+(\.\d+)?\s*(days?|d)?') then regexp_extract(l, '(\d+(?:\.\d+)?)', 1)::double end) as bigint) as days, count(*) as n_orders from t group by 1""",
    "oee_rollup": """
with l as (select machine, metric, case when x > 1.5 then x / 100 else x end as x from (unpivot (select distinct * from oee_daily) on availability, performance, quality into name metric value x)),
m as (select machine, metric, (sum(cast(round(x * 1e6) as bigint)) // count(*))::double / 1e6 as x from l where x between 0 and 1 group by all),
p as (select machine, max(x) filter (metric = 'availability') as availability, max(x) filter (metric = 'performance') as performance, max(x) filter (metric = 'quality') as quality
  from m group by machine)
select *, floor(availability * performance * quality * 1000.0::double) / 10 as oee_pct from p""",
    "telemetry_mean": "select event_type, round(avg(value), 2) as mean_value, count(value) as n_samples from events group by event_type",
    "json_props": "select try_cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n_events from events group by 1",
    "supplier_collapse": f"""
with s as (select distinct trim(supplier_id) as supplier_id, {', '.join(f'{_PRESENT.format(c)} as {c}' for c in ('supplier_name', 'country', 'products', 'lead_time', 'contact_email'))}, loaded_at
  from (select distinct * from suppliers_master)),
o as (select *, row_number() over (partition by supplier_id order by loaded_at, coalesce(supplier_name, ''), coalesce(country, ''), coalesce(products, ''), coalesce(lead_time, ''), coalesce(contact_email, '')) as n from s)
select supplier_id, arg_min(supplier_name, n) filter (supplier_name is not null) as supplier_name, arg_min(country, n) filter (country is not null) as country,
  arg_max(lead_time, n) filter (lead_time is not null) as lead_time, arg_max(contact_email, n) filter (contact_email is not null) as contact_email,
  coalesce(string_agg(lead_time, '; ' order by n) filter (lead_time is not null), '') as lead_times from o group by supplier_id""",
    "version_current": """
select o_custkey, o_orderkey, cast(row_number() over w as int) as version, lead(o_orderdate) over w as valid_to, lead(1) over w is null as is_current
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "survivorship": f"""
with s as (select *, cast({' + '.join(f'({_PRESENT.format(c)} is not null)::int' for c in ('supplier_name', 'country', 'products', 'lead_time', 'contact_email'))} as int) as filled
  from (select distinct * from suppliers_master))
select supplier_id, supplier_name, filled, loaded_at from s qualify row_number() over (partition by supplier_id order by filled desc, loaded_at desc, supplier_name nulls first,
  country nulls first, products nulls first, lead_time nulls first, contact_email nulls first) = 1""",
    "conflict_flags": """
select l_orderkey, l_linenumber, count(distinct l_extendedprice) as n_values, min(l_extendedprice) as lowest, max(l_extendedprice) as highest
from lineitem group by all having count(distinct l_extendedprice) > 1""",
    "claim_verify": """
with s as (select l_orderkey, round(sum(l_extendedprice::decimal(18, 4)), 2)::double as value from lineitem group by 1)
select o_orderkey, abs(case when o_orderkey % 2 = 0 then value else o_totalprice end - value) <= 1e-4 as verified from orders join s on l_orderkey = o_orderkey""",
    "graph_bfs": f"""
with recursive {_GRAPH},
walk as (select 'R:' || r_regionkey as seed, 'R:' || r_regionkey as id, 0 as hops from region union select seed, dst, hops + 1 from walk join links on id = src where hops < 3),
near as (select seed, id, min(hops) as hops from walk group by all)
select seed, split_part(id, ':', 1) as kind, hops, count(*) as n_nodes from near group by all""",
    "graph_path": f"""
with recursive {_GRAPH},
walk as (select 'S:' || s_suppkey as src, 'S:' || s_suppkey as node, ['S:' || s_suppkey] as path from supplier where s_suppkey % 100 = 0 or s_suppkey = 1
  union all select w.src, l.dst, list_append(path, l.dst) from walk w join links l on w.node = l.src where len(path) <= 2 and not list_contains(path, l.dst))
select src, node as dst, cast(len(path) - 1 as int) as hops, array_to_string(path, '>') as path from walk where node like 'R:%'
qualify row_number() over (partition by src, node order by len(path), path) = 1""",
    "dangling_edges": f"""
with {_MENTIONS}
select split_part(code, '-', 1) as prefix, 'dst' as missing, count(*) as n_edges from mentions where code not in (select doc_code from documents) group by 1""",
    "edge_from_rows": f"""
with b as (select distinct part_id, description, used_on, supplier from bom_parts),
t as (select {_CLEAN.format('part_id')} as src, upper(rel) as rel, upper(regexp_replace(regexp_replace(t, '[\\x{{200b}}\\x{{2060}}\\x{{feff}}]', '', 'g'), '[\\p{{Pd}}−\\x{{00ad}}]', '-', 'g')) as t
  from (unpivot b on description, used_on, supplier into name rel value t)),
e as (select distinct src, rel, dst from (select src, rel, unnest({_CODES.format('t')}) as dst from t) where dst <> src)
select rel, count(*) as n_edges, count(distinct dst) as n_targets from e group by rel""",
    "set_diff": f"select {_CLEAN.format('part_id')} as part from bom_parts except select {_CLEAN.format('part')} from purchase_orders",
    "duplicate_ids": f"select {_CLEAN.format('supplier_id')} as supplier_id, count(*) as n_rows from (select distinct * from suppliers_master) group by 1 having count(*) > 1",
    "grouping_report": """
select category, difficulty, persona, count(*) as n, count(*) filter (answerable) as n_answerable from (select distinct * from questions)
group by grouping sets ((category), (difficulty), (persona), ())""",
    "dedup_text": """
with k as (select min(doc_id) as doc_id from documents group by lower(trim(text)))
select source, count(*) as n_kept, min(d.doc_id) as first_id from documents d join k using (doc_id) group by source""",
    "grounded_ratio": rf"""
with q as (select distinct qid, unnest(regexp_extract_all(reference_answer, '\d+(?:\.\d+)?')) as number, gold_doc_ids from (select distinct * from questions)),
e as (select qid, number, unnest(case when len(gold_doc_ids) > 0 then gold_doc_ids else [null] end) as code from q),
s as (select qid, number, max(coalesce({_HAS.format('d.text', 'e.number')}, false)::int) as seen from e left join documents d on {_CLEAN.format('d.doc_code')} = {_CLEAN.format('e.code')} group by all)
select seen = 1 as seen, count(*) as n_numbers from s group by 1""",
    "majority_vote": """
with v as (select part_id, trim(material) as m, count(*) as n from (select distinct * from bom_parts) where material is not null group by all)
select part_id, arg_min(m, (-n, m)) as winner, cast(sum(n) as bigint) as n_votes, count(*) = 1 as unanimous from v group by part_id""",
    "product_catalog": f"with {_ITEMS} select item, count(distinct row_key) as n_suppliers from items where src_table = 'suppliers_master' group by item",
}

_CHUNKS = r"""
with recursive raw as (select doc_id, unnest(string_split(text, chr(10) || chr(10))) as t, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) as k from documents),
trimmed as (select doc_id, k, regexp_replace(t, '^[\s\x{0085}\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+|[\s\x{0085}\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+$', '', 'g') as t from raw),
p as (select doc_id, row_number() over (partition by doc_id order by k) as i, t, length(t) as n from trimmed where t <> ''),
walk as (
  select doc_id, i, 1 as g, case when n > 1200 then 0 else n end as used, n > 1200 as big from p where i = 1
  union all
  select p.doc_id, p.i, case when n > 1200 or w.big or used + 2 + n > 1200 then g + 1 else g end,
    case when n > 1200 then 0 when w.big or used + 2 + n > 1200 then n else used + 2 + n end, n > 1200
  from walk w join p on p.doc_id = w.doc_id and p.i = w.i + 1
),
grouped as (select doc_id, g, any_value(big) as big, string_agg(t, chr(10) || chr(10) order by i) as t from walk join p using (doc_id, i) group by doc_id, g),
pieces as (
  select doc_id, g, 0 as start, t as chunk from grouped where not big
  union all select doc_id, g, start, substr(t, start + 1, 1200) from (select doc_id, g, t, unnest(range(0, greatest(1, length(t) - 150), 1050)) as start from grouped where big)
)
"""
SQL["chunk_documents"] = f"""{_CHUNKS}
select doc_id, cast(row_number() over (partition by doc_id order by g, start) as int) as ordinal, cast(length(chunk) as int) as n_chars, md5(chunk) as chunk_md5 from pieces"""
SQL["chunk_rollup"] = f"""{_CHUNKS}
select doc_type, count(*) as n_chunks, count(*) filter (length(chunk) > 1000) as n_long, count(distinct doc_id) as n_documents
from pieces join documents using (doc_id) group by doc_type"""

_PLANT = f"""
with {_ITEMS},
used as (select distinct {_CLEAN.format('row_key')} as part, {_CLEAN.format('item')} as machine from items where src_table = 'bom_parts' and regexp_full_match({_CLEAN.format('item')}, 'MCH-[0-9]+')),
runs as (select distinct {_CLEAN.format('machine_id')} as machine, program from machines where program is not null)
"""
_PRICE = r"try_cast(regexp_extract(replace(unit_price, ',', ''), '\d+(?:\.\d+)?') as double)"
_CONTENT = f"list_filter({_TOKENS.format(r"regexp_replace(question, '[A-Z]{2,4}-[0-9]{2,9}', ' ', 'g')")}, lambda t: length(t) >= 4 and not regexp_full_match(t, '[0-9-]+') and t not in ({_STOP}))"

SQL |= {
    "format_detect": """
with m as (select distinct source_file, file_format, lower(regexp_extract(source_file, '\\.([A-Za-z0-9]+)$', 1)) as e from ingestion_manifest)
select file_format, case when e in ('csv', 'json', 'jsonl', 'html', 'eml', 'xlsx', 'docx', 'pdf', 'md') then e when e = 'htm' then 'html' else 'txt' end as seen_format, count(*) as n_files from m group by all""",
    "plant_reach": f"""{_PLANT}
select 'PROGRAM:' || program as seed, 'MCH' as kind, 1 as hops, count(distinct machine) as n_nodes from runs group by program
union all select 'PROGRAM:' || program, 'PRT', 2, count(distinct part) from runs join used using (machine) group by program
union all select seed, 'PROGRAM:' || other, 2, count(*) from (select distinct 'PROGRAM:' || a.program as seed, b.program as other from runs a join runs b using (machine) where a.program <> b.program) group by all""",
    "multi_hop_lookup": f"""{_PLANT},
parts as (select distinct program, part from runs join used using (machine)),
priced as (select {_CLEAN.format('part')} as part, sum({_PRICE}::decimal(20, 4)) as s, count(*) as n from (select distinct * from purchase_orders) where {_PRICE} is not null group by 1)
select 'PROGRAM:' || program as program, count(*) as n_parts, cast(sum(n) as bigint) as n_orders, round(sum(s)::double / sum(n), 4) as mean_price from parts join priced using (part) group by program""",
    "ambiguous_aliases": f"""
with m as (select distinct * from machines), a as (select lower(trim(codename)) as alias, {_CLEAN.format('machine_id')} as id from m union select lower(trim(line_codename)), line from m)
select alias, count(*) as n_ids, min(id) as first_id from a where alias <> '' and id is not null group by alias having count(*) > 1""",
    "record_references": """
with ids as (select distinct trim(supplier_id) as ref from suppliers_master), po as (select distinct * from purchase_orders)
select ref, count(*) as n_rows, count(distinct part) as n_parts from ids join po on upper(trim(supplier)) = ref or upper(trim(part)) = ref or upper(trim(lead_time)) = ref group by ref""",
    "valid_as_of": """
with e as (select unnest([timestamp '2024-04-01', timestamp '2024-07-01', timestamp '2024-10-01', timestamp '2025-01-01']) as as_of)
select doc_type, as_of, count(*) as n_documents from documents join e on loaded_at < as_of and (deleted_at is null or deleted_at >= as_of) group by all""",
    "cheapest_order": f"""
with p as (select po, {_CLEAN.format('part')} as part, {_PRICE} as price from (select distinct * from purchase_orders))
select part, arg_min(po, (price, po)) as po, min(price) as lowest, max(price) as highest, count(*) as n_orders from p where regexp_full_match(part, 'PRT-[0-9]+') and price is not null group by part""",
    "conflict_resolution": rf"""
with s as (select {_CLEAN.format('part')} as part, try_cast(regexp_extract(replace(moq, ',', ''), '^\s*(\d+)\s*$', 1) as bigint) as moq, loaded_at, po from (select distinct * from purchase_orders))
select part, count(distinct moq) as n_values, min(moq) as lowest, max(moq) as highest, arg_max(moq, (loaded_at, po, moq)) as chosen from s
where part is not null and moq is not null group by part having count(distinct moq) > 1""",
    "question_decision": f"""
with q as (select distinct * from questions),
known as (select {_CLEAN.format('doc_code')} as code from documents union select {_CLEAN.format('part_id')} from bom_parts union select {_CLEAN.format('machine_id')} from machines
  union select {_CLEAN.format('supplier_id')} from suppliers_master)
select case when exists (select 1 from (select unnest({_CODES.format('question')}) as c) where c not in (select code from known)) then 'absent'
  when coalesce(len({_CODES.format('question')}), -1) = 0 and len({_CONTENT}) = 0 then 'clarify' else 'answerable' end as decision, answerable as labelled, count(*) as n_questions from q group by all""",
    "question_labels": f"""
with q as (select distinct * from questions where question is not null),
l as (select category, list_filter([{', '.join(f"case when regexp_matches(question, '{p}') then '{name}' end" for name, p in LABELS)}], lambda x: x is not null) as l from q)
select label, category, count(*) as n_questions from (select category, unnest(case when len(l) > 0 then l else ['semantic'] end) as label from l) group by all""",
    "event_windows": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n_events, round(sum(value), 4) as total from events group by all",
    "streaming_upsert": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
}
