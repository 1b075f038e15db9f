"""Text as Column functions, all inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

_PRINT = ("ndash", "mdash", "lsquo", "rsquo", "ldquo", "rdquo", "bull", "hellip", "euro", "trade", "minus", "le", "ge", "ne")
# The token and identifier patterns, and words that carry no content.
TOKEN = r"[a-z0-9][a-z0-9\-]+"
CODE = r"(?<!\w)[A-Z]{2,4}-\d{2,9}(?:-v\d+)?(?!\w)"
# The name Subject in Latin, full-width, Cyrillic and Greek letters, with invisible characters anywhere in it.
SUBJECT = r"\n\p{Cf}*" + r"\p{Cf}*".join(["[SsＳｓЅѕ]", "[UuＵｕ]", "[BbＢｂВΒ]", "[JjＪｊЈјϳ]", "[EeＥｅЕеΕ]", "[CcＣｃСсϹϲ]", "[TtＴｔТΤ]"]) + r"[\p{Cf}\p{Zs}]*[:：] *([^\n]*)"
STOPWORDS = (
    "about above after again also and any are been before being below between both but can does doing down each from further has have "
    "having here how into its just more most much not now off only other our out over own same should some such than that the their "
    "them then there these they this those through under until very was were what when where which while who whom whose why will with would your"
).split()


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def identifiers(c: Column, pattern: str = CODE) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))


def content_terms(c: Column) -> Column:
    """Tokens of four letters or more that are no identifiers, numbers or stop words, each once."""
    words = tokens(F.regexp_replace(c, CODE, " "))
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9-]+$") & ~F.array_contains(stop, w)))


def has_term(c: Column, term: Column) -> Column:
    """Whether the lower-cased text holds the term between word boundaries of ASCII letters and digits."""
    return holds(padded(c), term)


def padded(c: Column) -> Column:
    """The lower-cased text with one blank around each word, in which ``holds`` looks for any number of terms."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), "[^a-z0-9-]+", " "), F.lit(" "))
    return F.regexp_replace(spaced, "-", " ")


def holds(text: Column, term: Column) -> Column:
    return F.contains(text, F.concat(F.lit(" "), F.regexp_replace(term, "-", " "), F.lit(" ")))


def stem(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.greatest(F.lit(4), F.length(c) - 2))


def slug(c: Column, prefix: str = "ING-", most: int = 48) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.upper(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")), 1, most))


def resolve_entities(c: Column) -> Column:
    """Named (of Latin-1 and common print) and numeric entities as their characters, each once; a no-break space as a blank."""
    known = {name: " " if name == "nbsp" else chr(cp) for name, cp in name2codepoint.items() if cp < 256 or name in _PRINT} | {"apos": "'"}
    table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    parts = F.regexp_extract_all(c, F.lit(r"(?s)&#\d{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[A-Za-z][A-Za-z0-9]{1,7};|.[^&]*"), F.lit(0))

    def resolved(p: Column) -> Column:
        inner = F.regexp_replace(p, "^&#?[xX]?|;$", "")
        code = F.when(p.rlike(r"^&#\d"), inner.try_cast("bigint")).when(p.rlike("^&#[xX]"), F.conv(inner, 16, 10).try_cast("bigint"))
        char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.when(p.rlike("^&.*;$"), F.coalesce(F.when(code == 160, " "), char, F.try_element_at(table, inner), p)).otherwise(p)

    return F.array_join(F.transform(parts, resolved), "")


def strip_html(c: Column) -> Column:
    """Script, style, navigation and footer out, list items and block ends as lines, tags out, entities resolved."""
    for tag in ("script", "style", "nav", "footer"):
        c = F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    c = F.regexp_replace(c, r"(?i)<li\b[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|h[1-6]|li|tr|ul|ol|section|table)\s*>|<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.when(F.instr(c, "&") > 0, resolve_entities(c)).otherwise(c)
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def mail_subject(c: Column) -> Column:
    """What the header Subject says, the name written in any letters of the same shape; null where the head has no such line."""
    head = F.concat(F.lit("\n"), F.substring_index(c, "\n\n", 1))
    return F.when(head.rlike(SUBJECT), F.regexp_extract(head, SUBJECT, 1))


def mail_body(c: Column) -> Column:
    """What follows the first blank line, up to a signature mark and without quoted lines."""
    body = F.when(F.instr(c, "\n\n") > 0, F.regexp_replace(c, r"(?s)^.*?\n\n", "")).when(c.isNotNull(), "")
    body = F.regexp_replace(F.concat(body, F.lit("\n")), r"(?s)(^|\n)-- ?\n.*$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?m)^>.*(?:\n|$)", ""), r"\n+$", ""))


_READ_ID = r"\b[A-Z]{2,4}-(?=[0-9OolI]*\d)[0-9OolI]+\b"
_READ_DATE = r"\b(?=[0-9OolI-]*\d)[0-9OolI]{4}-[0-9OolI]{2}-[0-9OolI]{2}\b"


def mend_scanned(c: Column) -> Column:
    """Letters read for digits inside identifiers (``PRT-2O01l``) and dates (``2O25-0l-15``): O and o become 0, l and I become 1."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s){_READ_DATE}|{_READ_ID}|.[^A-Z0-9OolI]*"), F.lit(0))
    digits = lambda t: F.translate(t, "OolI", "0011")
    mended = F.transform(parts, lambda p: F.when(p.rlike(f"^{_READ_DATE}$"), digits(p)).when(
        p.rlike(f"^{_READ_ID}$"), F.concat(F.substring_index(p, "-", 1), F.lit("-"), digits(F.substring_index(p, "-", -1)))
    ).otherwise(p))
    return F.array_join(mended, "")


def space_units(c: Column) -> Column:
    """``1h30m`` as ``1 h 30 m``: a blank between a number and the unit after it, and between a unit and the number after it."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d)(?=[A-Za-z])", " "), r"(?<=\d [A-Za-z]{1,4})(?=\d)", " ")


NAME_HEAD = 300


def name_phrases(c: Column, head: int = NAME_HEAD) -> Column:
    """Phrases of two to four capitalised words among the first ``head`` characters, where documents name what they are about; each once."""
    return F.array_distinct(F.regexp_extract_all(F.substring(c, 1, head), F.lit(r"\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){1,3}"), F.lit(0)))


def title_of(c: Column, most: int = 90) -> Column:
    """The first line that is not blank."""
    return F.substring(F.trim(F.regexp_extract(c, r"(?m)^\s*(\S.*)$", 1)), 1, most)


def doc_prefix(c: Column) -> Column:
    return F.split_part(c, F.lit("-"), F.lit(1))


def without_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\[[A-Z]{2,4}-\d+\]", ""), r"\s+([.,;:])", "$1"))


def format_of(name: Column, head: Column) -> Column:
    """File format by its first bytes, else by its extension, else txt. ``head`` is the content."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    start = F.substring(head, 1, 4)
    return (
        F.when(start == F.lit(b"%PDF"), "pdf")
        .when((F.substring(head, 1, 2) == F.lit(b"PK")) & ext.isin("xlsx", "docx"), ext)
        .when(ext.isin("csv", "json", "jsonl", "html", "eml", "xlsx", "docx", "pdf", "md"), ext)
        .when(ext == "htm", "html").otherwise("txt")
    )


#: What the bytes 0x80 to 0x9F are in code page 1252, where it has a character for them.
_CP1252 = {chr(b): t for b in range(0x80, 0xA0) if (t := bytes([b]).decode("cp1252", "ignore"))}


def decode_text(content: Column) -> Column:
    """UTF-8 (with or without mark) or else code page 1252, with plain line breaks."""
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(_CP1252), "".join(_CP1252.values()))
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(western)
    return F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
