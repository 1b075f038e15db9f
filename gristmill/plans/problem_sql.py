"""The same results in plain SQL, by other means than the operators, for comparison."""

_CLEAN = r"upper(regexp_replace(regexp_replace({0}, '[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+', '', 'g'), '[\x{{2010}}-\x{{2015}}\x{{2212}}\x{{00ad}}\x{{fe58}}\x{{fe63}}\x{{ff0d}}]', '-', 'g'))"

_FIELD = r'("(?:[^"]|"")*"|[^",\n\r"][^",\n\r]*|)'
_AMOUNT = r"([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{2})?"
_CURRENCY = r"([$€£]|USD|EUR|GBP)"
_COUNT = r"[0-9]+|[0-9]{1,3}(,[0-9]{3})+"


def _values(n: int) -> str:
    names = ", ".join(f"'v{k}'" for k in range(1, n + 1))
    return f"regexp_extract(raw, '^{','.join([_FIELD] * n)}$', [{names}])"


def _v(k: int) -> str:
    return f"trim(case when s.v{k} like '\"%' then replace(substr(s.v{k}, 2, length(s.v{k}) - 2), '\"\"', '\"') else s.v{k} end, ' ' || chr(9) || chr(10) || chr(13))"


def _full(k: int, pattern: str) -> str:
    return f"regexp_full_match({_v(k)}, '{pattern}')"


def _dated(k: int) -> str:
    return (
        f"(({_full(k, '[0-9]{4}-[0-9]{2}-[0-9]{2}')} and try_strptime({_v(k)}, '%Y-%m-%d') is not null)"
        f" or ({_full(k, '[0-9]{2}/[0-9]{2}/[0-9]{4}')} and try_strptime({_v(k)}, '%m/%d/%Y') is not null))"
    )


def _positive(k: int) -> str:
    return f"regexp_matches({_v(k)}, '[1-9]')"


_SPLIT = f"""
select record_id, source_file, raw, case when source_file = 'erp/suppliers_master.csv' then {_values(6)}
  else null end as s6, case when source_file <> 'erp/suppliers_master.csv' then {_values(8)} else null end as s
from raw_records
"""
_SUPPLIER_OK = " and ".join([_full(1, "SUP-[0-9]+"), *(f"{_v(k)} <> ''" for k in (2, 4, 5)), _full(6, r"|[^@\s]+@[^@\s]+\.[^@\s]+")]).replace("s.v", "s6.v")
_ORDER_OK = " and ".join([
    _full(1, "PO-[0-9]+"), _full(4, _COUNT), _positive(4), _positive(5),
    _full(5, f"({_CURRENCY} ?)?{_AMOUNT}|{_AMOUNT} ?{_CURRENCY}"), f"({_v(6)} = '' or ({_full(6, _COUNT)} and {_positive(6)}))",
    f"{_v(7)} <> ''", _dated(8),
])
_WORK_OK = " and ".join([
    _full(1, "WO-[0-9]+"), _full(3, "MCH-[0-9]+"), _dated(4), _full(6, "[0-9]*"),
    _full(5, r"[0-9]+(\.[0-9]+)? ?h|[0-9]+ ?min|[0-9]+:[0-5][0-9]|[0-9]+h[0-5]?[0-9]m"),
])

_ITEMS = r"""
items as (
  select src_table, row_key, loaded_at, unnest(v) as item, generate_subscripts(v, 1) as pos from (
    select src_table, row_key, loaded_at, list_filter(list_transform(regexp_extract_all(t || ';', '\s*("(?:[^"]|"")*"|[^;,|\t\n\r]*?)\s*[;,|\t\n\r]', 1),
      lambda x: trim(case when x like '"%"' and length(x) > 1 then replace(substr(x, 2, length(x) - 2), '""', '"') else x end, ' ' || chr(9) || chr(10) || chr(13))),
      lambda x: x <> '') as v
    from (
      select distinct 'bom_parts' as src_table, part_id as row_key, loaded_at,
        regexp_replace(regexp_replace(used_on, '\sand\s', ' ; ', 'g'), '[/&]', ';', 'g') as t from bom_parts where used_on is not null
      union all
      select distinct 'suppliers_master', supplier_id, loaded_at, regexp_replace(products, '\s/\s', ' ; ', 'g') from suppliers_master where products is not null
    ) x
  ) y
)
"""

_REFS = f"""
{_ITEMS},
refs as (
  select distinct * from (
    select 'purchase_orders' as ref_table, po as row_key, 'part' as target, {_CLEAN.format('part')} as key, loaded_at as ts from purchase_orders
    union all select 'bom_parts', row_key, 'machine', {_CLEAN.format('item')}, loaded_at from items where src_table = 'bom_parts'
    union all select 'questions', qid, 'document', {_CLEAN.format('g')}, loaded_at from (select qid, loaded_at, unnest(gold_doc_ids) as g from questions)
    union all select 'ingestion_manifest', source_file, 'document', {_CLEAN.format('g')}, loaded_at from (select source_file, loaded_at, unnest(maps_to_doc_ids) as g from ingestion_manifest)
  ) where ts is not null and case target when 'part' then regexp_full_match(key, 'PRT-[0-9]+') when 'machine' then regexp_full_match(key, 'MCH-[0-9]+') else key <> '' end
),
parents as (
  select 'part' as target, {_CLEAN.format('part_id')} as key, loaded_at, deleted_at from bom_parts
  union select 'machine', {_CLEAN.format('machine_id')}, loaded_at, deleted_at from machines
  union select 'document', {_CLEAN.format('doc_code')}, loaded_at, deleted_at from documents
)
"""

_NUM = r"(\d+(?:\s+|-)\d+/\d+|\d+/\d+|\d[\d,]*(?:\.\d+)?|\.\d+)"
_UNIT = r"(\pL+\.?(?:\(\pL+\))?|[\"']*)"


def _num(c: str) -> str:
    plain = rf"regexp_replace(regexp_replace({c}, ',(\d\d\d)(\D|$)', '\1\2', 'g'), ',', '.', 'g')"
    return rf"""case when {c} like '%/%' then coalesce(try_cast(regexp_extract({c}, '^(\d+)(?:\s+|-)\d+/', 1) as double), 0)
      + try_cast(regexp_extract({c}, '(\d+)/(\d+)$', 1) as double) / try_cast(regexp_extract({c}, '(\d+)/(\d+)$', 2) as double)
      else try_cast({plain} as double) end"""


def _unit(c: str) -> str:
    u = rf"rtrim(regexp_replace(lower({c}), '\(\pL+\)$', ''), '.')"
    return f"""case when kind = 'time' then case
        when {u} in ('d', 'day', 'days', 'tag', 'tage', 'día', 'días', 'dia', 'dias', 'jour', 'jours') then 1.0
        when {u} in ('w', 'wk', 'wks', 'week', 'weeks', 'woche', 'wochen', 'semana', 'semanas', 'semaine', 'semaines') then 7.0
        when {u} in ('h', 'hr', 'hrs', 'hour', 'hours', 'stunde', 'stunden') then 1.0 / 24 end
      else case
        when {u} in ('um', 'µm', 'μm', 'micron', 'microns') then 1e3 when {u} in ('thou', 'mil', 'mils') then 25400.0
        when {u} in ('mm', 'millimetre', 'millimetres', 'millimeter', 'millimeters') then 1e6
        when {u} in ('cm', 'centimetre', 'centimetres', 'centimeter', 'centimeters') then 1e7
        when {u} in ('m', 'metre', 'metres', 'meter', 'meters') then 1e9
        when {u} in ('in', 'inch', 'inches', '"') then 25400000.0 when {u} in ('ft', 'foot', 'feet', '''') then 304800000.0 end end"""


SQL = {
    "p1_found": f"""
with split as ({_SPLIT})
select record_id from split
where not coalesce(case source_file when 'erp/suppliers_master.csv' then s6.v1 <> '' and {_SUPPLIER_OK}
  when 'erp/purchase_orders.csv' then s.v1 <> '' and {_ORDER_OK}
  when 'maintenance/cmms_export.csv' then s.v1 <> '' and {_WORK_OK} end, false)
""",
    "p2_found": """
with rows as (select distinct reading_id, machine, reading_date, availability, performance, quality from oee_daily),
long as (
  select reading_id, machine, reading_date, metric, x from (unpivot rows on availability, performance, quality into name metric value x)
),
scaled as (
  select *, case when median(x) over (partition by machine) > 1.5 then 100.0 else 1.0 end as full_scale,
    row_number() over (partition by machine, metric order by reading_date, reading_id)
      - row_number() over (partition by machine, metric, x order by reading_date, reading_id) as island
  from long
),
marked as (
  select *, x < 0 or x > full_scale as wrong, count(*) over (partition by machine, metric, x, island) >= 5 as stuck from scaled
),
sound as (
  select *, median(x) over (partition by machine, metric order by reading_date, reading_id rows between 9 preceding and 9 following) as level,
    median(x) over (partition by machine, metric order by reading_date, reading_id rows between 9 preceding and 1 preceding) as before,
    median(x) over (partition by machine, metric order by reading_date, reading_id rows between 1 following and 9 following) as after,
    count(x) over (partition by machine, metric order by reading_date, reading_id rows between 9 preceding and 1 preceding) as n_before,
    count(x) over (partition by machine, metric order by reading_date, reading_id rows between 1 following and 9 following) as n_after
  from marked where not wrong and not stuck
),
scattered as (
  select s.*, 1.5 * median(abs(x - level)) over (partition by machine, metric) as scatter from sound s
)
select reading_id, metric from marked where wrong or stuck
union
select reading_id, metric from scattered
where n_before + n_after >= 3 and abs(x - level) > 8 * scatter and (n_before < 3 or abs(x - before) > 8 * scatter) and (n_after < 3 or abs(x - after) > 8 * scatter)
""",
    "p3_found": f"with {_ITEMS} select distinct src_table, row_key, cast(pos as bigint) as pos, item from items",
    "p3_item_counts": f"""
with {_ITEMS}, places as (select distinct src_table, row_key, pos, item from items)
select src_table, lower(item) as item, count(*) as n_places, count(distinct row_key) as n_rows from places group by all
""",
    "p4_found": f"""
with {_REFS}
select distinct ref_table, row_key, key as missing_key, strftime(ts, '%Y-%m') as ref_month from refs r
where not exists (select 1 from parents p where p.target = r.target and p.key = r.key and p.loaded_at <= r.ts
  and (p.deleted_at is null or p.deleted_at > r.ts))
""",
    "p4_snapshots": f"""
with {_REFS},
months as (select distinct date_trunc('month', ts) as m from refs union select date_trunc('month', loaded_at) from parents
  union select date_trunc('month', deleted_at) from parents where deleted_at is not null),
keys as (select ref_table, target, key, date_trunc('month', ts) as m, count(*) as n from refs group by all),
state as (
  select k.ref_table, o.m, sum(k.n) as n from keys k join months o on k.m <= o.m
  where not exists (select 1 from parents p where p.target = k.target and p.key = k.key and date_trunc('month', p.loaded_at) <= o.m
    and (p.deleted_at is null or p.deleted_at > p.loaded_at) and (p.deleted_at is null or date_trunc('month', p.deleted_at) > o.m))
  group by all
),
named as (select distinct ref_table, target, key from keys),
touched as (
  select distinct ref_table, m from keys
  union select n.ref_table, date_trunc('month', p.loaded_at) from named n join parents p using (target, key)
  union select n.ref_table, date_trunc('month', p.deleted_at) from named n join parents p using (target, key) where p.deleted_at is not null
),
held as (select t.ref_table, t.m, coalesce(s.n, 0) as n from touched t left join state s on s.ref_table = t.ref_table and s.m = t.m)
select ref_table, strftime(m, '%Y-%m') as month, cast(n - coalesce(lag(n) over (partition by ref_table order by m), 0) as bigint) as opened_net,
  cast(n as bigint) as open_orphans
from held
""",
    "p6_found": rf"""
with texts as (
  select distinct * from (
    select 'bom_parts' as src_table, part_id as row_key, 'length' as kind, field_name, t,
      nullif(regexp_extract(lower(description), '\b(inch(?:es)?|centimet(?:re|er)s?|cm|millimet(?:re|er)s?|mm|feet|foot)\b', 1), '') as described
    from (unpivot (select part_id, description, dim_length, dim_od, tolerance from bom_parts) on dim_length, dim_od, tolerance into name field_name value t)
    union all select 'suppliers_master', supplier_id, 'time', 'lead_time', lead_time, null from suppliers_master
  ) where t is not null
),
words as (
  select *, list_reduce([['one', '1'], ['two', '2'], ['three', '3'], ['four', '4'], ['five', '5'], ['six', '6'], ['seven', '7'], ['eight', '8'],
      ['nine', '9'], ['ten', '10'], ['eleven', '11'], ['twelve', '12']], lambda a, w: [regexp_replace(a[1], '\b' || w[1] || '\b', w[2]), ''], [lower(trim(t)), ''])[1] as w
  from texts
),
bodies as (
  select *, trim(regexp_replace(regexp_replace(regexp_replace(w, '^(oal|length|l|od|dia\.?|outside|ø|lt|approx\.?)\s*=?\s*([\d.])', '\2'),
    '^\+([^/+-].*)/-.*$', '\1'), '^(±|\+/-|\+-|\+)\s*', '')) as b from words
),
parts as (
  select *, regexp_extract(b, '^{_NUM}\s*{_UNIT.replace("'", "''")}(?:\s*-?\s*{_NUM}\s*{_UNIT.replace("'", "''")})?$', ['n1', 'u1', 'n2', 'u2']) as g from bodies
),
valued as (
  select *, {_num('g.n1')} as a1, {_unit("coalesce(nullif(g.u1, ''), described, case kind when 'time' then 'd' else 'mm' end)")} as f1,
    {_num('g.n2')} as a2, {_unit('g.u2')} as f2
  from parts where g.n1 <> ''
)
select distinct src_table, row_key, field_name, cast(round(a1 * f1 + case when g.n2 <> '' then a2 * f2 else 0 end) as bigint) as quantity
from valued where a1 * f1 + case when g.n2 <> '' then a2 * f2 else 0 end is not null
""",
}


def _typed(file: str, ok: str, columns: dict[str, str], part: str = "s") -> str:
    """The valid records of a file, each column by its own expression over the trimmed value ``{v}``."""
    cols = []
    for k, (name, form) in enumerate(columns.items(), 1):
        v = _v(k).replace("s.v", f"{part}.v")
        cols.append(form.replace("{v}", f"nullif({v}, '')") + f" as {name}")
    return f"with split as ({_SPLIT}) select record_id, {', '.join(cols)} from split where source_file = '{file}' and {part}.v1 <> '' and {ok}"


_AS_COUNT = "cast(replace({v}, ',', '') as bigint)"
_AS_AMOUNT = "cast(regexp_replace({v}, '[^0-9.]', '', 'g') as decimal(18, 2))"
_AS_DATE = "cast(coalesce(try_strptime({v}, '%Y-%m-%d'), try_strptime({v}, '%m/%d/%Y')) as date)"

SQL["p1_purchase_orders"] = _typed("erp/purchase_orders.csv", _ORDER_OK, {
    "po": "{v}", "supplier": "{v}", "part": "{v}", "qty": _AS_COUNT, "unit_price": _AS_AMOUNT, "moq": _AS_COUNT, "lead_time": "{v}", "po_date": _AS_DATE})
SQL["p1_suppliers"] = _typed("erp/suppliers_master.csv", _SUPPLIER_OK, dict.fromkeys(
    ("supplier_id", "name", "country", "products", "lead_time", "contact_email"), "{v}"), "s6")
SQL["p1_work_orders"] = _typed("maintenance/cmms_export.csv", _WORK_OK, {
    "wo": "{v}", "asset": "{v}", "machine": "{v}", "wo_date": _AS_DATE, "downtime": "{v}", "mtbf_hours": _AS_COUNT, "technician": "{v}", "notes": "{v}"})
_P2 = SQL["p2_found"]
SQL["p2_verdicts"] = (
    _P2[: _P2.index("select reading_id, metric from marked where wrong")]
    + """select metric, verdict, count(*) as n_values from (
  select distinct reading_id, metric, case when wrong then 'impossible' else 'stuck' end as verdict from marked where wrong or stuck
  union select reading_id, metric, 'spike' from scattered"""
    + _P2[_P2.rindex("\nwhere n_before") :]
    + ") group by metric, verdict"
)
SQL["p1_recovered"] = " union all ".join(
    f"select source_file, count(*) as n_valid, cast(0 as bigint) as n_recovered from ({_SPLIT}) where source_file = '{file}' and {part}.v1 <> '' and {ok} group by 1"
    for file, part, ok in (("erp/suppliers_master.csv", "s6", _SUPPLIER_OK), ("erp/purchase_orders.csv", "s", _ORDER_OK), ("maintenance/cmms_export.csv", "s", _WORK_OK))
)
