"""The queries of the retrieval pipeline, graph walks, claims and table upkeep in plain SQL, by other means than the operators."""

from __future__ import annotations

from gristmill.plans.problem_sql import _REFS
from gristmill.plans.reference_sql import _CHUNKS

_CLEAN = r"upper(regexp_replace(regexp_replace({0}, '[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+', '', 'g'), '[\p{{Pd}}\x{{2212}}\x{{00ad}}]', '-', 'g'))"
_CODE = r"[A-Z]{2,4}-\d{2,9}(?:-v\d+)?"
_TOKEN = r"[a-z0-9][a-z0-9\-]+"
# Words without content.
_STOP = (
    "about above after again also and any are been before being below between both but can does doing down each from further has have "
    "having here how into its just more most much not now off only other our out over own same should some such than that the their "
    "them then there these they this those through under until very was were what when where which while who whom whose why will with would your"
).split()


def _codes(c: str) -> str:
    return rf"regexp_extract_all({c}, '\b{_CODE}\b')"


def _plain(c: str) -> str:
    return rf"upper(regexp_replace(regexp_replace({c}, '[\x{{200b}}\x{{2060}}\x{{feff}}]', '', 'g'), '[\p{{Pd}}\x{{2212}}\x{{00ad}}]', '-', 'g'))"


def _words(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '{_TOKEN}')"


def _content(c: str) -> str:
    bare = rf"regexp_replace({c}, '{_CODE}', ' ', 'g')"
    stop = ", ".join(f"'{w}'" for w in _STOP)
    return f"list_distinct(list_filter({_words(bare)}, lambda t: length(t) >= 4 and not regexp_full_match(t, '[0-9-]+') and t not in ({stop})))"


def _has(text: str, term: str) -> str:
    return f"contains(' ' || replace(regexp_replace(lower({text}), '[^a-z0-9-]+', ' ', 'g'), '-', ' ') || ' ', ' ' || replace({term}, '-', ' ') || ' ')"


_ASKED = r"""asked as (select 'Q' || n as query_id, min(question) as text from (select try_cast(regexp_extract(qid, '(\d+)', 1) as bigint) as n, question from questions)
  where n % 3 = 0 group by n)"""
_RANKED = "cast(row_number() over (partition by query_id order by {0}) as int)"
_MENTIONS = f"mentions as (select distinct doc_id, code from (select doc_id, unnest({_codes('text')}) as code from documents))"
_STRUCTURED = f"""
codes as (select distinct query_id, unnest({_codes('text')}) as code from asked),
structured as (select query_id, doc_id, max(score) as score from (
  select query_id, doc_id, 0.9::double as score from codes join documents on {_CLEAN.format('doc_code')} = code
  union all select query_id, doc_id, 0.8::double from codes join documents on {_CLEAN.format('subject_id')} = code) group by all)"""
_LANES = f"""
terms as (select query_id, t, count(*) as times from (select query_id, unnest({_words('text')}) as t from asked) group by all),
tf as (select doc_id, n, t, count(*) as tf from (select doc_id, len({_words('text')}) as n, unnest({_words('text')}) as t from documents) group by all),
df as (select t, count(*) as df from tf group by t),
size as (select count(*) as docs, avg(len(coalesce({_words('text')}, []))) as mean from documents),
bm as (select query_id, doc_id, round(sum(times * ln(1.0::double + (docs - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double)
  / (tf + 1.5::double * (0.25::double + 0.75::double * n / mean))), 6) as score from terms join df using (t) join tf using (t), size group by all),
words as (select * from (select query_id, doc_id, {_RANKED.format('score desc, doc_id')} as rank from bm where score > 0) where rank <= 20),
codes as (select distinct query_id, unnest({_codes('text')}) as code from asked),
keyed as (select * from (select query_id, doc_id, {_RANKED.format('doc_id')} as rank from (select distinct query_id, doc_id from codes join documents on upper(trim(doc_code)) = code)) where rank <= 20),
linked as (select * from (select query_id, doc_id, {_RANKED.format('doc_id')} as rank from (select distinct query_id, doc_id from codes join mentions using (code))) where rank <= 20),
shares as (select query_id, doc_id, 1.0::double / (60 + rank) as share from words union all select query_id, doc_id, 3.0::double / (60 + rank) from keyed
  union all select query_id, doc_id, 2.0::double / (60 + rank) from linked),
fused as (select query_id, doc_id from (select query_id, doc_id, {_RANKED.format('round(sum(share), 6) desc, doc_id')} as rank from shares group by query_id, doc_id) where rank <= 20)"""
_PLANT = f"""
{_REFS.split('refs as (')[0].rstrip().rstrip(',')},
used as (select distinct {_CLEAN.format('row_key')} as part, {_CLEAN.format('item')} as machine from items where src_table = 'bom_parts' and regexp_full_match({_CLEAN.format('item')}, 'MCH-[0-9]+')),
m as (select distinct {_CLEAN.format('machine_id')} as machine, line, program from machines)"""
_GRAPH = """
links as (
  select 'N:' || n_nationkey as a, 'R:' || n_regionkey as b from nation union all select 'R:' || n_regionkey, 'N:' || n_nationkey from nation
  union all select 'S:' || s_suppkey, 'N:' || s_nationkey from supplier union all select 'N:' || s_nationkey, 'S:' || s_suppkey from supplier
  union all select 'C:' || c_custkey, 'N:' || c_nationkey from customer union all select 'N:' || c_nationkey, 'C:' || c_custkey from customer
)"""
_FACT = f"list_distinct(list_concat(list_transform({_codes('fact')}, lambda x: lower(x)), regexp_extract_all(fact, '\\d+(?:\\.\\d+)?')))"


def _rows_edges(name: str, key: str, columns: str) -> str:
    return f"""select '{name}' as table_name, upper(rel) as rel, src, dst from (
  select src, rel, unnest({_codes('t')}) as dst from (select list_extract({_codes(_plain(key))}, 1) as src, rel, {_plain('t')} as t from (
    unpivot (select {key} as k_, {columns} from (select distinct * from {name})) on {columns} into name rel value t) x)) where src <> dst""".replace(_plain(key), _plain("k_"))


_EDGES = " union all ".join((
    _rows_edges("bom_parts", "part_id", "part_id, description, material, dim_length, dim_od, tolerance, supplier, used_on, program"),
    _rows_edges("machines", "machine_id", "machine_id, codename, machine_type, line, line_codename, program"),
    _rows_edges("cmms_export", "wo", "wo, asset, machine, wo_date, downtime, technician, notes"),
    _rows_edges("purchase_orders", "po", "po, supplier, part, qty, unit_price, moq, lead_time, po_date"),
    _rows_edges("suppliers_master", "supplier_id", "supplier_id, supplier_name, country, products, lead_time, contact_email"),
))

SQL = {
    "structured_lane": f"with {_ASKED}, {_STRUCTURED} select query_id, doc_id, score from structured",
    "retrieve_evidence": f"""
with {_ASKED}, {_MENTIONS}, {_LANES},
scored as (select query_id, f.doc_id, len(list_intersect({_words('a.text')}, {_words('d.text')}))::double / nullif(len(list_distinct({_words('a.text')})), 0) as score
  from fused f join asked a using (query_id) join documents d on d.doc_id = f.doc_id),
reranked as (select * from (select query_id, doc_id, {_RANKED.format('round(coalesce(score, 0), 6) desc, doc_id')} as rank from scored) where rank <= 10),
both_ as (select query_id, doc_id, 0 as turn, rank, 'floor' as lane from words where rank <= 3 union all select query_id, doc_id, 1, rank, 'reranked' from reranked),
once as (select query_id, doc_id, min((turn, rank)) as place, arg_min(lane, (turn, rank)) as lane from both_ group by all),
kept as (select * from (select query_id, doc_id, lane, {_RANKED.format('place, doc_id')} as rank from once) where rank <= 10),
terms_ as (select query_id, unnest({_content('text')}) as term from asked),
padded as materialized (select doc_id, ' ' || replace(regexp_replace(lower(text), '[^a-z0-9-]+', ' ', 'g'), '-', ' ') || ' ' as p from documents where doc_id in (select doc_id from kept)),
seen as (select t.query_id, t.term, max(contains(p, ' ' || replace(t.term, '-', ' ') || ' ')::int) as seen from terms_ t join kept using (query_id) join padded using (doc_id) group by all),
covered as (select query_id, round(avg(seen), 6) as covered from seen group by query_id)
select query_id, doc_id, rank, lane, covered from kept left join covered using (query_id)""",
    "query_aliases": rf"""
with {_ASKED},
names as (select lower(trim(codename)) as alias, {_CLEAN.format('machine_id')} as id from machines union select lower(trim(line_codename)), line from machines),
runs as (select distinct alias, id, trim(regexp_replace(alias, '[^\pL\pN]+', ' ', 'g')) as run from names where length(alias) >= 3 and id is not null),
t as (select query_id, text, ' ' || regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g') || ' ' as w from asked),
named as (select query_id, id, 2 as turn, -length(alias) as place, alias from runs join t on run <> '' and contains(w, ' ' || run || ' ')
  union all select query_id, l[i], 1, i - 1, '' from (select query_id, list_filter({_codes('text')}, lambda x: true) as l, unnest(generate_series(1, len({_codes('text')}))) as i from t)),
best as (select query_id, id, min((turn, place, alias)) as o from named group by all)
select query_id, id, o[1] as turn, cast(row_number() over (partition by query_id order by o, id) as int) as rank from best""".replace("o[1]", "struct_extract(o, 1)"),
    "graph_scores": f"""
with recursive {_GRAPH},
walk as (select 'R:' || r_regionkey as seed, 'R:' || r_regionkey as id, 0 as hops from region union select seed, b, hops + 1 from walk join links on id = a where hops < 3),
near as (select seed, id, min(hops) as hops from walk group by all),
s as (select id, max(case when hops = 0 then 1.0::double else 1.0::double / hops end) as score from near group by id)
select id[1] as kind, round(score, 6) as score, count(*) as n_nodes from s group by all""",
    "path_to_kind": f"""
with {_PLANT}, p as (select 'PROGRAM:' || program as src, machine, 'LINE:' || line as dst from m where program is not null and line is not null),
q as (select src, dst, src || '>' || machine || '>' || dst as path from p)
select src, dst, 2 as hops, path from q qualify row_number() over (partition by src order by [src, split_part(path, '>', 2), dst]) = 1""",
    "path_by_waypoint": """
select 'S:' || s_suppkey as src, 'N:' || n_nationkey as via, 'R:' || n_regionkey as dst, 2 as hops, 'S:' || s_suppkey || '>N:' || n_nationkey || '>R:' || n_regionkey as path
from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 100 = 0 or s_suppkey = 1""",
    "hop_check": f"""
with {_PLANT}, p as (select {_CLEAN.format('part')} as part, count(*) as n from (select distinct * from purchase_orders) group by 1 having regexp_full_match(part, 'PRT-[0-9]+')),
u as (select part, min(machine) as machine from used group by part), r as (select machine, min('PROGRAM:' || program) as program from m where program is not null group by machine),
c as (select p.n, u.machine is not null as first, r.program is not null as second from p left join u using (part) left join r on r.machine = u.machine)
select first, second, first and second as holds, cast(sum(n) as bigint) as n_orders from c group by all""",
    "waypoint_parts": f"""
with b as (select {_CLEAN.format('part_id')} as part, lower(description) as text from bom_parts where description is not null),
nouns as (select distinct regexp_extract(text, '([a-z]+)$', 1) as noun from b where regexp_matches(text, '[a-z]$'))
select noun, min(part) as part, count(distinct part) as n_parts from nouns join b on regexp_matches(' ' || text || ' ', '[^a-z]' || noun || '[^a-z]') group by noun""",
    "line_neighbours": f"with {_PLANT} select 'LINE:' || line as line, string_agg(distinct machine, ',' order by machine) as machines from m where line is not null group by line",
    "merged_machines": f"""
with a as (select {_CLEAN.format('machine_id')} as id, lower(trim(codename)) as c, program as p, line from machines)
select id, coalesce(string_agg(distinct c, ';' order by c), '') as aliases, coalesce(string_agg(distinct p, ';' order by p), '') as programs, nullif(count(distinct line), 0) as n_lines from a group by id""",
    "backfill_edges": f"select table_name, rel, count(*) as n_edges, count(distinct src) as n_subjects from (select distinct * from ({_EDGES})) group by all",
    "grounded_relations": """
with k as (select doc_type, coalesce((doc_code <> '' and contains(text, doc_code))::int, 0) as c, coalesce((subject_id <> '' and contains(text, subject_id))::int, 0) as s,
  coalesce((doc_code = subject_id)::int, 0) as same from documents)
select doc_type, cast(sum(case when same = 1 then greatest(c, s) else c + s end) as bigint) as n_entities, cast(sum(c * s * (1 - same)) as bigint) as n_relations from k group by doc_type""",
    "remove_documents": f"""
with {_MENTIONS}, gone as (select doc_id, doc_code from documents where deleted_at is not null)
select 'units' as kind, count(*) as n_left from mentions where doc_id not in (select doc_id from gone)
union all select 'edges', count(*) from (select distinct d.doc_code, code from mentions join documents d using (doc_id)
  where d.doc_id not in (select doc_id from gone) and code not in (select doc_code from gone))""",
    "load_gate": f"""
with {_MENTIONS}, v as (
  select 'coverage' as "check", count(*) filter (doc_id in (select vec_id from embeddings))::double / count(*) as value from documents
  union all select 'widths', count(distinct len(embedding))::double from embeddings
  union all select 'keys_twice', count(*)::double from (select doc_code from documents group by doc_code having count(*) > 1)
  union all select 'dangling', count(*)::double from mentions where code not in (select {_CLEAN.format('doc_code')} from documents))
select "check", round(value, 6) as value, case "check" when 'coverage' then value >= 1 when 'widths' then value = 1 else value = 0 end as passed from v""",
    "keys_across_tables": f"""
with {_ASKED}, codes as (select distinct unnest({_codes('text')}) as key from asked),
k as ({' union all '.join(f"select {_CLEAN.format(key)} as key, '{name}' as table_name from (select distinct * from {name})" for name, key in (('bom_parts', 'part_id'), ('machines', 'machine_id'), ('suppliers_master', 'supplier_id'), ('purchase_orders', 'po'), ('cmms_export', 'wo'), ('documents', 'doc_code')))})
select key, table_name, count(*) as n_rows from codes join k using (key) group by all""",
    "suppliers_us": f"select distinct {_CLEAN.format('supplier_id')} as supplier_id from suppliers_master where upper(trim(country)) in ('USA', 'U.S.A.', 'UNITED STATES', 'US')",
    "rows_naming_machines": f"""
with m as (select distinct {_CLEAN.format('machine_id')} as ref from machines),
t as (select 'cmms_export' as table_name, concat_ws(' ', wo, asset, machine, wo_date, downtime, mtbf_hours, technician, notes) as t from (select distinct * from cmms_export)
  union all select 'bom_parts', concat_ws(' ', part_id, description, material, dim_length, dim_od, tolerance, supplier, used_on, program) from (select distinct * from bom_parts)),
c as (select table_name, unnest(list_distinct({_codes(_plain('t'))})) as ref from t)
select table_name, ref, count(*) as n_rows from c join m using (ref) group by all""",
    "list_references": f"""
with d as (select {_CLEAN.format('doc_code')} as ref from documents),
l as (select unnest(list_distinct({_codes(_plain("array_to_string(gold_doc_ids, ' ')"))})) as ref from (select distinct * from questions)
  union all select unnest(list_distinct({_codes(_plain("array_to_string(maps_to_doc_ids, ' ')"))})) from (select distinct * from ingestion_manifest))
select ref, count(*) as n_rows from l semi join d using (ref) group by ref""",
    "spaced_durations": r"""
select regexp_replace(regexp_replace(trim(downtime), '(\d)([A-Za-z])', '\1 \2', 'g'), '(\d [A-Za-z]{1,4})(\d)', '\1 \2', 'g') as spaced, count(*) as n_rows
from (select distinct * from cmms_export) group by 1""",
    "document_names": r"""
with p as (select doc_id, unnest(list_distinct(regexp_extract_all(text[1:300], '\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,3}'))) as phrase from documents)
select phrase, count(*) as n_documents from p group by phrase""",
    "metric_means": f"select machine, {', '.join(f'round(avg(case when not isnan({c}) then {c}::decimal(18, 6) end), 4) as {c}' for c in ('availability', 'performance', 'quality'))} from (select distinct * from oee_daily) group by machine",
    "significant_facts": f"""
with f as (select distinct source_file, maps_to_doc_ids, unnest(key_facts) as fact from ingestion_manifest),
w as (select source_file, fact, case when len({_FACT}) > 0 then {_FACT} else {_content('fact')} end as terms, case when len({_FACT}) > 0 then 1.0 else 0.6 end as share,
  unnest(case when len(maps_to_doc_ids) > 0 then maps_to_doc_ids else [null] end) as code from f),
h as (select w.source_file, w.fact, max((len(terms) > 0 and len(list_filter(terms, lambda t: coalesce({_has('d.text', 't')}, false))) >= share * len(terms))::int) as hit
  from w left join documents d on {_CLEAN.format('d.doc_code')} = {_CLEAN.format('w.code')} group by all)
select source_file, count(*) as n_facts, count(*) filter (hit = 1) as n_recovered from h group by source_file""",
    "claim_kinds": rf"""
with {_MENTIONS}, q as (select distinct qid, question, gold_doc_ids, reference_answer from (select distinct * from questions)),
c as (select qid, reference_answer as a, {_CLEAN.format('g')} as code from (select qid, reference_answer, unnest(gold_doc_ids) as g from q) where {_CLEAN.format('g')} <> ''),
d as (select {_CLEAN.format('doc_code')} as code, text from documents),
v as (select qid, max(coalesce(contains(lower(text), lower(regexp_replace(trim(a), '[.\s]+$', ''))), false)::int) = 1 as verified from c left join d using (code) where trim(a) <> '' group by qid),
k as (select qid, min((code in (select code from d))::int) = 1 as verified from c group by qid),
n as (select qid, max((code in (select code from mentions))::int) = 0 as verified from (select distinct qid, unnest({_codes('question')}) as code from q) group by qid)
select 'verbatim' as kind, verified, count(*) as n_claims from v group by verified union all select 'complete', verified, count(*) from k group by verified
union all select 'absent', verified, count(*) from n group by verified""",
    "conflict_questions": rf"""
with o as (select {_CLEAN.format('part')} as code, count(distinct try_cast(regexp_extract(replace(moq, ',', ''), '^\s*(\d+)\s*$', 1) as bigint)) as n from (select distinct * from purchase_orders) where part is not null group by 1),
q as (select qid, category, question, unnest(list_distinct({_codes('upper(question)')})) as code from (select distinct * from questions) where question is not null)
select category, count(*) as n_named, count(*) filter (regexp_matches(lower(question), '\b(?:order|orders|quantity|moq|minimum|price|cost|lead)\b')) as n_topical
from q join o using (code) where n > 1 group by category""",
    "grounding_gate": f"""
with q as (select distinct qid, unnest(list_distinct(regexp_extract_all(reference_answer, '\\d+(?:\\.\\d+)?'))) as number, gold_doc_ids from (select distinct * from questions)),
e as (select qid, number, unnest(case when len(gold_doc_ids) > 0 then gold_doc_ids else [null] end) as code from q),
s as (select qid, number, max(coalesce({_has('d.text', 'e.number')}, false)::int) as seen from e left join documents d on {_CLEAN.format('d.doc_code')} = {_CLEAN.format('e.code')} group by all),
p as (select qid, count(*) as n, count(*) filter (seen = 0) as lost from s group by qid)
select n, lost, lost >= 3 and lost > 0.4 * n as withheld, count(*) as n_answers from p group by all""",
    "mixed_conversions": r"""
select 'mm' as from_unit, 'in' as to_unit, round(p_size::double * (1 / 25.4::double), 4) as result, count(*) as n from part group by 3
union all select 'wk', 'd', round(w * 7.0::double, 4), count(*) from (select try_cast(regexp_extract(lower(lead_time), '^(\d+)\s*weeks?$', 1) as double) as w from (select distinct * from purchase_orders)) where w is not null group by 3""",
    "csv_round_trip": """
with s as (select distinct trim(supplier_id) as supplier_id, trim(supplier_name) as n, trim(products) as p, loaded_at, country, lead_time, contact_email, supplier_id as a, supplier_name as b, products as c from suppliers_master)
select supplier_id, count(*) as n_rows, count(distinct (n, p)) as n_typings from s where n <> '' and p <> '' group by supplier_id""",
    "json_lines_round_trip": """
select file_format, count(*) as n_files, cast(sum(len(maps_to_doc_ids)) as bigint) as n_codes, count(notes) as n_notes from (select distinct * from ingestion_manifest) group by file_format""",
    "record_upsert": f"""
select part, po from (select {_CLEAN.format('part')} as part, po, loaded_at from purchase_orders) where regexp_full_match(part, 'PRT-[0-9]+')
qualify row_number() over (partition by part order by loaded_at desc, po desc) = 1""",
    "event_stream_windows": """
select date_trunc('day', ts)::timestamp as day, event_type, count(*) as n_events from events
where date_trunc('day', ts) + interval 1 day <= (select max(ts) from events) - interval 1 hour group by all""",
    "orphan_stream": f"""
with {_REFS}
select ref_table, strftime(ts, '%Y-%m') as ref_month, count(distinct (row_key, key)) as n_orphans from refs r
where not exists (select 1 from parents p where p.target = r.target and p.key = r.key and p.loaded_at <= r.ts and (p.deleted_at is null or p.deleted_at > r.ts)) group by all""",
}


def _live(chunks: str) -> str:
    return f"""{chunks},
c as (select doc_id, count(*) as n from pieces group by doc_id), {_MENTIONS}, u as (select doc_id, count(*) as n from mentions group by doc_id)
select doc_id, coalesce(c.n, 0) as n_chunks, coalesce(c.n, 0) + coalesce(u.n, 0) as n_units from documents left join c using (doc_id) left join u using (doc_id)
where deleted_at is null and coalesce(c.n, u.n) is not null"""


SQL["live_documents"] = _live(_CHUNKS)
