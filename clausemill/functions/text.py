"""Column expressions over clause text: all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of letters with inner hyphens or a number with inner dots.
TOKEN = r"[a-z]+(?:-[a-z]+)*|\d+(?:\.\d+)*"
#: The function words that are no tokens.
STOPWORDS = (
    "a an the of to in for on by or and is are be been was were with as at from that this these those it its such any all each "
    "other than then so if not no will would may might can could shall should must have has had do does did"
).split()
#: Fixed value: quoted capitalised terms before a defining phrase, and in a bracket after a lead word.
MEANS = r"[“\"']([A-Z][A-Za-z0-9 ,'\-/&]{2,60}?)[”\"']\s*(?:\([^)]{0,40}\)\s*)?(?:shall\s+mean|means|shall\s+have\s+the\s+meaning|has\s+the\s+meaning|refers\s+to)"
BRACKETED = r"(?i)\((?:\s*(?:the|hereinafter|collectively|each\s+a|individually)\b[\s,]*)+[“\"']([A-Z][A-Za-z0-9 ,'\-/&]{2,60}?)[”\"']\s*\)"
#: What a citation and a section named in a question look like.
CITATION = r"\[([A-Za-z0-9_\-]+)\s*§\s*([^\]\s]+)\]"
NAMED_SECTION = r"(?i)(?:(?:section|clause|article|§)\s*)?(\d+(?:\.\d+)+(?:\([A-Za-z0-9]{1,4}\))*)"
#: What counts towards the density of a filing.
COUNTED = {
    "refs": (r"(?i)\b(?:Section|Article|Clause)s?\s+\d|\b§", 3),
    "definitions": (r"[“\"'][A-Z][A-Za-z ]{2,40}[”\"']\s*(?:shall\s+mean|means)", 4),
    "headings": (r"(?im)^\s*(?:ARTICLE\s+[IVXLC0-9]|SECTION\s+\d|\d+\.\d+\s)", 1),
}
#: Fixed value: lines that are page furniture in filings.
FURNITURE = r"(?i)^\s*(?:page\s+\d+\s*(?:of\s*\d+)?|[-–—]\s*[ivxlcdm\d]{1,6}\s*[-–—]|\[?page\s*break\]?|_{3,}|source:\s*.{0,80}?\d{1,2}/\d{1,2}/\d{2,4}\s*)\s*$"


def tokens(text: Column) -> Column:
    """Lower-case tokens without function words and single characters; null gives an empty list."""
    every = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(every, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS))


def indexed_text() -> Column:
    """Section number, title and body in one text, empty ones left out."""
    return F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("section_id", "section_title", "text")])


def embedding_text() -> Column:
    """Breadcrumb and title above the body."""
    head = F.concat_ws(" ", F.nullif(F.col("path"), F.lit("")), F.nullif(F.col("section_title"), F.lit("")))
    body = F.coalesce("text", F.lit(""))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), body)).otherwise(body)


def content_hash(text: Column, model: str) -> Column:
    """First 32 hex digits of SHA-256 over model, NUL and text."""
    return F.substring(F.sha2(F.concat(F.lit(model), F.lit("\x00"), text), 256), 1, 32)


def on_one_line(text: Column) -> Column:
    """The text with blanks for line ends, as embedders that mind them want it."""
    return F.regexp_replace(text, "\n", " ")


def point_id(chunk: Column, namespace: str) -> Column:
    """The version 5 UUID of a chunk id in a namespace, for stores whose keys are UUIDs."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(chunk, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), (F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4) + 1).cast("int"))


def defined_terms(text: Column) -> Column:
    """The terms a text establishes: white space made plain, in order of pattern and place, each once, over two characters."""
    found = F.concat(F.regexp_extract_all(text, F.lit(MEANS), F.lit(1)), F.regexp_extract_all(text, F.lit(BRACKETED), F.lit(1)))
    plain = F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ ,]+|[ ,]+$", ""))
    return F.array_distinct(F.filter(plain, lambda t: F.length(t) > 2))


def named_sections(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(NAMED_SECTION), F.lit(1)))


def citations(answer: Column) -> Column:
    """Cited (doc_id, section_id) pairs, each once, in the order written."""
    docs, sections = (F.regexp_extract_all(answer, F.lit(CITATION), F.lit(k)) for k in (1, 2))
    return F.array_distinct(F.zip_with(docs, sections, lambda d, s: F.struct(d.alias("doc_id"), s.alias("section_id"))))


def sentences(answer: Column) -> Column:
    """Claims: lines first, without bullet and bold marks, then sentences inside a line."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.replace(F.regexp_replace(x, r"^\s*[-*•]\s+", ""), F.lit("**"), F.lit(""))))
    return F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"(?<=[.!?])\s+(?=[A-Z\"'“])"))), lambda s: F.trim(s) != "")


def chunk_id(doc_id: Column, section_id: Column) -> Column:
    return F.concat(doc_id, F.lit("__sec_"), section_id)


def label(chunk: Column) -> Column:
    """`doc §section` of a chunk id; an id without a section is its own label."""
    doc, section = F.substring_index(chunk, "__sec_", 1), F.regexp_extract(chunk, "__sec_(?s)(.*)$", 1)
    return F.when(section != "", F.concat(doc, F.lit(" §"), section)).otherwise(chunk)


def citation(doc_id: Column, section_id: Column) -> Column:
    return F.concat(F.lit("["), doc_id, F.lit(" §"), section_id, F.lit("]"))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def normal_lines(text: Column) -> Column:
    """Lines with one kind of line end, plain spaces, no page furniture, single blanks and no blanks at the end."""
    one = F.replace(F.regexp_replace(text, "\r\n|\r|\f", "\n"), F.lit(" "), F.lit(" "))
    kept = F.filter(F.split(one, "\n"), lambda x: ~x.rlike(FURNITURE))
    return F.transform(kept, lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s+$", ""))


def density() -> dict[str, Column]:
    """Counts of references, definitions and headings in `text`, and the weighted score."""
    counted = {name: F.regexp_count("text", F.lit(pattern)) for name, (pattern, _) in COUNTED.items()}
    return counted | {"score": sum((counted[name] * weight for name, (_, weight) in COUNTED.items()), F.lit(0))}


def ancestors(section: Column) -> Column:
    """A section label and its less and less specific forms: bracket groups go first, then dotted parts."""
    base = F.regexp_replace(section, r"(\([A-Za-z0-9]{1,4}\))+$", "")
    groups = F.regexp_extract_all(F.regexp_extract(section, r"((?:\([A-Za-z0-9]{1,4}\))*)$", 1), F.lit(r"\([^)]*\)"), F.lit(0))
    count = F.size(groups)
    inner = F.transform(F.sequence(count, F.lit(0), F.lit(-1)), lambda k: F.concat(base, F.array_join(F.slice(groups, 1, k), "")))
    parts = F.split(base, r"\.")
    outer = F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).otherwise(F.array().cast("array<string>"))
    return F.concat(inner, outer)
