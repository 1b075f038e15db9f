"""SQL that finds look-alike texts and leaks by plain character replacement, for comparison."""

from __future__ import annotations

import unicodedata

from gristmill.llm.lookalikes import CYRILLIC, GREEK


def _replacements() -> tuple[str, str]:
    """Characters and what each stands for, one for one."""
    pairs = {**CYRILLIC, **GREEK, "µ": "μ", "‐": "-", "‑": "-", "Ω": "Ω", "K": "K", "Å": "Å"}
    pairs |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {c: " " for c in "              　"}
    for cp in range(0x370, 0x530):  # accented letters on a look-alike
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) > 1 and (latin := CYRILLIC.get(parts[0]) or GREEK.get(parts[0])):
            whole = unicodedata.normalize("NFC", latin + parts[1:])
            if len(whole) == 1:
                pairs[chr(cp)] = whole
    return "".join(pairs), "".join(pairs.values())


def looks(text: str) -> str:
    old, new = _replacements()
    quoted = lambda s: s.replace("'", "''")
    ligatures = text
    for one, many in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        ligatures = f"replace({ligatures}, '{one}', '{many}')"
    seen = rf"regexp_replace({ligatures}, '[\x{{00ad}}\x{{200b}}-\x{{200f}}\x{{2060}}-\x{{2064}}\x{{feff}}]', '', 'g')"
    # once before and once after composing: an accent may join a look-alike
    return f"nfc_normalize(translate(nfc_normalize({seen}), '{quoted(old)}', '{quoted(new)}'))"


_GRAMS = r"""
select id, array_to_string(w[k:k + 12], ' ') as gram from (
  select id, w, unnest(range(1, len(w) - 11)) as k from (select id, regexp_extract_all(lower(t), '[\pL\pN]+') as w from {0}) where len(w) >= 13)
"""

SQL = {
    "p7_found": f"""
with d as (select doc_id as id, {looks('text')} as t from documents), i as (select item_id as id, {looks('item_text')} as t from eval_items),
dg as ({_GRAMS.format('d')}), ig as ({_GRAMS.format('i')})
select distinct dg.id as doc_id, ig.id as item_id from dg join ig using (gram)""",
    "p9_found": f"""
with d as (select doc_id, text, {looks('text')} as look from documents where text is not null)
select a.doc_id as doc_id_a, b.doc_id as doc_id_b from d a join d b on a.look = b.look and a.doc_id < b.doc_id and a.text <> b.text""",
}
SQL["p7_items"] = f"""
with found as ({SQL['p7_found']})
select item_id, count(doc_id) as n_documents from (select distinct item_id from eval_items) left join found using (item_id) group by item_id"""
SQL["p9_classes"] = f"""
with d as (select doc_id, text, {looks('text')} as look from documents where text is not null),
k as (select look, min(doc_id) as class_id, count(distinct text) as n_kinds, count(*) as n_documents from d group by look having count(distinct text) > 1)
select doc_id, class_id, n_kinds, n_documents from d join k using (look)"""
