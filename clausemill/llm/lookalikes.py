"""One stored form for text that looks the same: equivalence classes under a Unicode collation."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.operators.joins import salted_join
from clausemill.sources.tables import staged

#: Letters of other scripts, and rare Latin ones, and the Latin letters they look like, taken from what the Unicode consortium's public
#: table of confusable characters (UTS 39) has for Cyrillic, Greek, Latin, Armenian and Cherokee letters that are drawn alike in common fonts.
LOOKALIKE = "АВЕКМНОРСТУХЅІЈԌԚԜӀаеорсухѕіјԁԛԝһ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ" "ɡɑı" "ՕՏԼՍհոսօցքզ" "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏃᏔᏕᏙᏚᏞᏟᏢᏦᏴ"
PLAIN = "ABEKMHOPCTYXSIJGQWIaeopcyxsijdqwh" "ABEZHIKMNOPTYXoc" "gai" "OSLUhnuogpq" "DRTAJEWMHYZWSVSLCPKB"
#: What Java and RE2 both read: characters that make a word suspect. Composed letters, quotes, dashes and § are none.
FOREIGN = r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}\x{400}-\x{52F}\x{261}\x{251}\x{131}\x{531}-\x{58F}\x{13A0}-\x{13FF}"
SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}"


def _compatible(c: str) -> bool:
    """Whether a character is another form of ordinary ones by Unicode's own data: wide or narrow, or one whose plain form is letters, digits and ASCII
    signs; or one that is never stored as it is (like the Kelvin sign). Latin-1 signs, general punctuation, ™ and ℠ are ordinary."""
    kind = unicodedata.decomposition(c)
    if not kind or c <= "\xff" or "\u2000" <= c <= "\u206f" or c in "™℠\u3000":
        return False
    if not kind.startswith("<"):
        return unicodedata.normalize("NFC", c) != c and not unicodedata.combining(c)
    return kind.startswith(("<wide>", "<narrow>")) or all(x.isalnum() or "!" <= x <= "~" for x in unicodedata.normalize("NFKC", c))


def _ranges(points: list[int]) -> str:
    """A character class of code points."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


COMPAT = _ranges([p for p in range(0x100, 0x20000) if _compatible(chr(p))])
SUSPECT = rf"[{FOREIGN}{SPACES}{INVISIBLE}{COMPAT}\x{{300}}-\x{{36F}}]"


def _py(cls: str) -> str:
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), cls)


_MAP = str.maketrans(LOOKALIKE, PLAIN)
_INVISIBLE, _SPACES, _COMPAT = (re.compile(f"[{_py(x)}]") for x in (INVISIBLE, SPACES, COMPAT))
_RUN = regex.compile(r"[\p{L}\p{M}]+")
_ALIEN = regex.compile(rf"[\p{{L}}--\p{{Latin}}--[{LOOKALIKE}]]", regex.V1)
_TOKEN = re.compile(r"[^ \t\n\v\f\r]+")
#: Words end at the plain white space of ASCII only; the plain split of Python also ends them at these.
_OTHER_SPACE = re.compile(f"[{_py(SPACES)}\x85\x1c-\x1f]")
_SUSPECT = re.compile(f"[{_py(FOREIGN + SPACES + INVISIBLE + COMPAT)}\u0300-\u036f]")


def fold(value: str) -> str:
    """The plain form: no invisible characters, plain spaces, ordinary forms, composed accents, and Latin look-alikes for
    letters of a word all of whose foreign letters have one. A word truly in another script stays as it is."""
    s = _SPACES.sub(" ", _INVISIBLE.sub("", value))
    s = unicodedata.normalize("NFC", _COMPAT.sub(lambda m: unicodedata.normalize("NFKC", m[0]), s))
    return _RUN.sub(lambda m: m[0] if _ALIEN.search(m[0]) else m[0].translate(_MAP), s)


def _folded(values: pd.Series) -> pd.Series:
    return values.map(fold, na_action="ignore")


_SEEN = "chunk_id string, text_field string, token string, n long"


def _words(value: str) -> list[str]:
    return value.split() if value.isascii() or not _OTHER_SPACE.search(value) else _TOKEN.findall(value)


def seen(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_field, token, n): the suspect words of each text and term, and, without chunk_id, how often each word of the corpus stands in it.

    One pass over the texts; a task holds the counts of at most half a million words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=["chunk_id", "text_field", "token", "n"])

        counts: Counter = Counter()
        for batch in batches:
            found = []
            for chunk_id, text, terms in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for field, value in (("text", text), *(("defines_terms", t) for t in terms or ())):
                    if value:
                        words = _words(value)
                        counts.update(words)
                        if not value.isascii():
                            found += [(chunk_id, field, w, 1) for w in set(words) if not w.isascii() and _SUSPECT.search(w)]
            yield rows_of(found)
            if len(counts) > 500_000:
                yield rows_of([(None, None, w, n) for w, n in counts.items()])
                counts.clear()
        yield rows_of([(None, None, w, n) for w, n in counts.items()])

    return chunks.where("chunk_id is not null").select("chunk_id", "text", "defines_terms").mapInArrow(run, _SEEN)


def classes(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(token, canonical): every suspect word and the member that its class of visually equal words is stored as.

    found has the suspect words, corpus (token, n) how often each word of the corpus stands in it. A class is what the collation UNICODE_CI, which
    minds accents and not width, composition or invisible characters, holds equal after the look-alike letters are mapped, in one
    pattern of capitals (the collation itself does not mind case). Members are the suspect words, the words of the corpus
    that fall into their classes, and their plain forms, which count 0 where nobody wrote them. The canonical
    member is the most frequent one without suspect characters, then the smaller one by code point.
    """
    alien = rf"[\p{{L}}&&[^\p{{IsLatin}}{LOOKALIKE}]]"

    def keyed(words: DataFrame) -> DataFrame:
        mapped = F.when(F.col("member").rlike(alien), F.col("member")).otherwise(F.translate("member", LOOKALIKE, PLAIN))
        capitals = F.regexp_replace(F.regexp_replace("plain", r"\p{Lu}", "\u0001"), "[^\u0001]", "0")
        return words.select("member", "n", capitals.alias("capitals"), F.collate(mapped, "UNICODE_CI").alias("mapped"))

    met = staged(found.select("token").distinct().withColumn("plain", F.pandas_udf(_folded, "string")("token")), "p4_met")
    suspects = keyed(met.select(F.col("token").alias("member"), F.lit(0).cast("long").alias("n"), "plain"))
    groups = suspects.select("mapped", "capitals").distinct()
    written = keyed(corpus.join(met.select("token"), "token", "left_anti").select(F.col("token").alias("member"), "n", F.col("token").alias("plain"))).join(groups, ["mapped", "capitals"], "left_semi")
    forms = keyed(met.select(F.col("plain").alias("member"), F.lit(0).cast("long").alias("n"), "plain"))
    members = suspects.unionByName(written).unionByName(forms)
    best = F.min_by("member", F.struct(F.col("member").rlike(SUSPECT), -F.col("n"), F.col("member")))
    canonical = members.groupBy("mapped", "capitals").agg(best.alias("canonical"))
    joined = suspects.join(canonical, ["mapped", "capitals"])
    return joined.select(F.col("member").alias("token"), F.collate("canonical", "UTF8_BINARY").alias("canonical"))


def rewrites(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_field, token, canonical): the words of each field that are stored in another form than the canonical one.

    Null texts, lists and elements and rows without chunk_id give nothing; a repeated row counts once; empty tables give
    no rows; extra columns are ignored. A word that a third of all chunks hold is joined in salted parts.
    """
    every = staged(seen(chunks), "p4_seen")
    found = every.where("chunk_id is not null").select("chunk_id", "text_field", "token").distinct()
    corpus = every.where("chunk_id is null").groupBy("token").agg(F.sum("n").alias("n"))
    return salted_join(found, staged(classes(found, corpus), "p4_classes"), "token", "chunk_id").where("token <> canonical")


def found(chunks: DataFrame) -> DataFrame:
    return rewrites(chunks).select("chunk_id", "text_field").distinct()


def unified(chunks: DataFrame) -> DataFrame:
    """(chunk_id, text_field, value, form) of each text and term that changes: as stored, and in its consistent form."""
    text = chunks.select("chunk_id", F.lit("text").alias("text_field"), F.col("text").alias("value"))
    terms = chunks.select("chunk_id", F.lit("defines_terms").alias("text_field"), F.explode("defines_terms").alias("value"))
    suspect = text.unionByName(terms).where(F.octet_length("value") > F.char_length("value")).distinct()
    changes = rewrites(chunks).groupBy("chunk_id", "text_field").agg(F.collect_list(F.struct("token", "canonical")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            forms = []
            for value, pairs in zip(cols["value"], cols["pairs"]):
                to = {p["token"]: p["canonical"] for p in pairs}
                forms.append(_TOKEN.sub(lambda m, to=to: to.get(m[0], m[0]), value))
            yield pa.RecordBatch.from_arrays([batch.column("chunk_id"), batch.column("text_field"), batch.column("value"), pa.array(forms, pa.string())], names=["chunk_id", "text_field", "value", "form"])

    return suspect.join(changes, ["chunk_id", "text_field"]).mapInArrow(run, "chunk_id string, text_field string, value string, form string").where("value <> form")
