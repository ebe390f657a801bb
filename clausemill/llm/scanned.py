"""Noise of scanned pages in text: running headers, page numbers, words cut at line ends, misread characters."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausemill.operators.joins import salted_join
from clausemill.sources.tables import staged

#: A line counts as running furniture if a part of it repeats at so many places, so large a part of them in the middle of a sentence; a word as misread if the
#: word it is misread from is so many times as frequent; a word follows numbers if so large a part of its uses do.
REPEATS, BROKEN, TIMES, NUMBERED = 4, 0.4, 12, 0.2
#: So many of the most frequent sound words are sent to all workers, to leave them out early; the result does not depend on it.
FREQUENT = 20_000
#: Signs of the beginnings and ends by which lines are compared, and words of a line that is compared by their number and its last word.
ENDS, FEW = (5, 8, 12, 20), 4

_ROMAN = r"(?=[ivxlcIVXLC])[xX]{0,3}(?:[iI][xXvV]|[vV]?[iI]{0,3}|[lLcC][xXvViI]{0,6})"
_NUMBER = rf"(?:\d{{1,4}}|{_ROMAN}|[A-Z]-\d{{1,4}})"
_PAGE_WORD = r"(?:page|pg\.?|p\.|seite|pag\.?)"
_PAGE_LINE = re.compile(
    rf"^[\s\-–—*~\[(|·•]*(?:{_PAGE_WORD}\s*\|?\s*{_NUMBER}(?:\s*(?:of|/)\s*\d{{1,4}})?|(?:{_NUMBER})(?:\s*(?:of|/)\s*\d{{1,4}})?)[\s\-–—*~\])|·•]*$", re.IGNORECASE
)
_PAGE_TAIL = re.compile(rf"(?:[ \t ]{{2,}}|\t)(?:{_PAGE_WORD}[ \t ]*\|?[ \t ]*)?\d{{1,4}}(?:[ \t ]*(?:of|/)[ \t ]*\d{{1,4}})?[ \t]*$", re.IGNORECASE)
#: The look-alike letters and invisible characters that a repeated line may carry, mapped away before lines are compared.
_PLAIN = str.maketrans("АВЕКМНОРСТУХЅІЈаеорсухѕіјΑΒΕΖΗΙΚΜΝΟΡΤΥΧοɡ", "ABEKMHOPCTYXSIJaeopcyxsijABEZHIKMNOPTYXog", "­​‌‍⁠﻿")
_ODD = re.compile(f"[{''.join(map(chr, _PLAIN))}]")
_HEADING = re.compile(r"^\s*(?:(?:ARTICLE|SECTION|CLAUSE)\s+[\dIVXLC]+\b|\d+(?:\.\d+)*\.?\s+\S|\([a-zA-Z]{1,5}\)|\([ivx]+\))", re.IGNORECASE)
_TABLE = re.compile(r"\S(?: {2,}|\t)\S.*\S(?: {2,}|\t)\S")
_SPACED = re.compile(r"^(?:\S )+\S$")
_HEAD = re.compile(r"^[ \t]*([^\W\d_]+)")
#: A word, and the bars and exclamation marks at its ends, which may be misread letters of it.
_LETTERS = re.compile(r"([|!]{0,3})([^\W_]+(?:[|!][^\W_]+)*)([|!]{0,3})")
_LONG_WORD = re.compile(r"[^\W\d_]{4,}")
_BLANKS, _DIGITS_RUN = re.compile(r"[ \t\xa0]+"), re.compile(r"\d+")
_COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
#: A number in which letters stand for digits, with a digit beside them; a group of such letters in a sum of money.
_MIXED = re.compile(r"(?<![\w\-/.])(?:€|\$)?(?=[\dOIlS|,]*[OIlS|])(?=[\dOIlS|,]*\d)[\dOIlS|]+(?:,[\dOIlS|]{3})*(?![\w\-/|])")
_GROUP = re.compile(r"(?<=[€$])[OIlS|]+(?=,\d)|(?<=\d,)[OIlS|]{3}(?![\w])")
#: Only such letters, and the word after them; a number and the word after it.
_LETTERED = re.compile(r"(?<![\w\-/.§|])([OIlS|]{2,4})(?=[ \n]([a-z]+)\b)")
_COUNTED = re.compile(r"(?<![\w\-/.])\d[\d,]*\s+([a-z]+)\b")


def lines_of(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def line_key(line: str) -> str:
    """A line as it is compared with others: without page number, decoration, letter spacing, digits and case."""
    s = _plain(line)
    tail = _tail(s)
    s = (s[: tail.start()] if tail else s).strip(" \t\xa0|*~-–—[]")
    if "   " in s:
        words = re.split(r" {3,}", s)
        if all(_SPACED.match(w) or len(w) == 1 for w in words):
            s = " ".join(w.replace(" ", "") for w in words)
    return _DIGITS_RUN.sub("#", _BLANKS.sub(" ", s).lower() if "  " in s or "\t" in s or "\xa0" in s else s.lower())


def parts_of(key: str) -> list[str]:
    """By what a line repeats fuzzily: its beginnings and ends of a few lengths, and, if it is short, its number of words with the last one.

    Two lines of which one has another name, date, kind or misread letter still agree in one of them.
    """
    words = key.split(" ")
    out = [f"<{key[:n]}" for n in ENDS if len(key) >= n] + [f">{key[-n:]}" for n in ENDS if len(key) >= n]
    return out + [f"{len(words)} {words[-1]}"] if len(words) <= FEW else out


def _plain(line: str) -> str:
    return line.translate(_PLAIN) if not line.isascii() and _ODD.search(line) else line


def _tail(line: str) -> re.Match | None:
    """The page number at the end of a furniture line."""
    return _PAGE_TAIL.search(line) if line.rstrip()[-1:].isdigit() and ("  " in line or "\t" in line) else None


def _ended(line: str) -> bool:
    """Whether a line ends as a sentence or a part of a list does."""
    return line.rstrip().rstrip("”’\"')]")[-1:] in (".", ";", ":", ",")


def _cut(line: str) -> tuple[str, str, int] | None:
    """The first part of a word cut at the line's end, the mark, and where the mark stands."""
    at = len(line.rstrip(" \t")) - 1
    if at < 1 or line[at] not in "-¬‐":
        return None
    start = at
    while start and line[start - 1].isalpha():
        start -= 1
    return (line[start:at], line[at], at) if start < at else None


def width_of(lines: list[str]) -> int:
    """The width that lines are wrapped at: the longest, leaving out the few that stand far beyond three quarters of them."""
    full = sorted(len(x.rstrip()) for x in lines if x.strip())
    return next((n for n in reversed(full) if n <= full[len(full) * 3 // 4] + 10), 0) if full else 0


def page_edge(lines: list[str], k: int, width: int) -> bool:
    """Whether line k may be furniture: it ends short of the line width, so that the text did not wrap there, or has a page number, and is
    neither heading nor table nor text: most of its longer words begin with a capital."""
    line = lines[k]
    s = line.strip()
    if len(s) < 3 or s[0].islower() or s[-1] in ";:,":
        return False
    tail = _tail(line)
    if not tail:
        if " " not in s and not s.isupper() and "-" not in s:
            return False
        room = width - len(line.rstrip()) - 1
        if room < 1:
            return False
        after = next((x.lstrip() for x in lines[k + 1 : k + 6] if x.strip()), "")
        if len(after[: room + 1].split(None, 1)[0] if after else "") > room:
            return False
    if _HEADING.match(s):
        return False
    long = _LONG_WORD.findall(s)
    if 2 * sum(x[0].islower() for x in long) > len(long):
        return False
    if _TABLE.search(s[: tail.start()] if tail else s) and not re.search(r"\t|^\S(?: \S)+ {3,}", s):
        cells = re.split(r" {2,}", s)
        if sum(bool(re.search(r"\d", c)) for c in cells) >= 2:
            return False
    return True


def clues(text: str) -> tuple[list[tuple[str, int, int, str]], list[str], set[int], list[tuple[str, str, str]]]:
    """What a text shows by itself: furniture candidates (key, has page number, breaks a sentence, words around), lines, page-number lines, cut words (left, mark, right).

    A line breaks a sentence if the line before has not ended one; one that ends as a sentence itself, as names of companies do, also needs
    a small letter after it, since it may be the end of that sentence.
    """
    if "\n" not in text and "\r" not in text:
        return [], [text], set(), []
    lines = lines_of(text)
    width = width_of(lines)
    pages, heads, low = set(), [], []
    for k, line in enumerate(lines):
        if not line or line.isspace():
            continue
        if _PAGE_LINE.match(_plain(line).strip()):
            pages.add(k)
        elif page_edge(lines, k, width):
            before = next((lines[j].rstrip() for j in range(k - 1, -1, -1) if lines[j].strip() and j not in pages), None)
            after = next((x.lstrip() for x in lines[k + 1 :] if x.strip()), "")
            broken = before is not None and not _ended(before) and (not _ended(line) or after[:1].islower())
            around = f"{before.split()[-1] if before else ''} {after.split()[0] if after else ''}"
            heads.append((line_key(line), int(bool(_tail(line))), int(broken), around))
            low.append(k)
    skip, cuts = pages | set(low), []
    for k, line in enumerate(lines):
        m = _cut(line)
        if not m or k in pages:
            continue
        # The other part stands in the next line of text: over page numbers, empty lines and whatever may be furniture.
        for j in range(k + 1, len(lines)):
            if not lines[j].strip() or j in skip:
                continue
            if n := _HEAD.match(lines[j]):
                cuts.append((m[0], m[1], n[1]))
            break
    return heads, lines, pages, cuts


def body_of(lines: list[str], pages: set[int]) -> str:
    """The lines without page numbers and without the parts of words cut at line ends, which are no words."""
    kept, after_cut = [], False
    for k, line in enumerate(lines):
        if k in pages or not line.strip():
            continue
        body = _HEAD.sub("", line, count=1) if after_cut else line
        m = _cut(body)
        kept.append(body[: m[2] - len(m[0])] if m else body)
        after_cut = bool(m)
    return " ".join(kept)


def _forms(lead: str, core: str, trail: str) -> list[str]:
    """The word with each part of the signs at its ends, the bare word last."""
    return [lead[i:] + core + trail[:j] for i in range(len(lead) + 1) for j in range(len(trail), -1, -1)]


def words_in(unit: str) -> list[str]:
    return [w for m in _LETTERS.findall(unit) for w in (_forms(*m) if m[0] or m[2] else m[1:2])]


class _Tally:
    """Counts of a partition: runs of signs between spaces, taken apart into words only when the counts are given out."""

    def __init__(self):
        self.units: Counter = Counter()
        self.lines: Counter = Counter()
        self.parts: Counter = Counter()

    def add(self, text: str) -> None:
        heads, lines, pages, _ = clues(text)
        for key, _, broken, around in set(heads):
            self.lines["broken" if broken else "edge", f"={key}\t{around}"] += 1
            for part in parts_of(key):
                self.lines["broken" if broken else "edge", f"{part}\t{around}"] += 1
        if len(lines) > 1:
            self.parts.update([part for k, line in enumerate(lines) if line and k not in pages for part in parts_of(line_key(line))])
        for word in _COUNTED.findall(text):
            self.lines["numbered", word] += 1
        self.units.update((body_of(lines, pages) if pages or heads or len(lines) > 1 else text).split())

    def full(self) -> bool:
        return len(self.units) + len(self.lines) + len(self.parts) > 600_000

    def give(self) -> pa.RecordBatch:
        out = self.lines
        out.update({("all", part): n for part, n in self.parts.items()})
        for unit, n in self.units.items():
            if unit.isalpha():
                out["word", unit.lower()] += n
                continue
            for w in words_in(unit):
                if not w.isdigit():
                    out["word", w.lower()] += n
            if "-" in unit:
                for w in _COMPOUND.findall(unit):
                    out["compound", w.lower()] += n
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()), pa.array([x for _, x in out], pa.string()), pa.array(list(out.values()), pa.int64())], names=["kind", "key", "n"])


def statistics(chunks: DataFrame) -> DataFrame:
    """(kind, key, n) over the whole corpus: words, hyphenated compounds, words after numbers, how often each part of a line stands at all, and how
    often each furniture candidate and each part of it stands between the same words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.add(text)
                if tally.full():
                    yield tally.give()
        yield tally.give()

    return chunks.select("text").where("text is not null").mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def skeleton(word: Column) -> Column:
    """Words that a scanner may take for each other have the same skeleton: signs and groups of signs of like shape become one."""
    s = F.translate(F.lower(word), "|!", "ll")
    for many, one in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ci", "d"), ("c1", "d"), ("ii", "n"), ("li", "n"), ("l1", "n"), ("1i", "n")):
        s = F.replace(s, F.lit(many), F.lit(one))
    return F.translate(s, "0oa1il|!jyv5sec6bh9gqtfunzkx", "oooiiiiiivvssccnnngggttnnzkx")


def misread_words(stats: DataFrame) -> DataFrame:
    """(word, repaired): words that share their skeleton with one at least TIMES as frequent."""
    words = stats.where((F.col("kind") == "word") & F.col("key").rlike(r"\p{L}")).select(F.col("key").alias("word"), "n").withColumn("skeleton", skeleton(F.col("word")))
    sound = ~F.col("word").rlike(r"[0-9|!]")
    best = words.where(sound).groupBy("skeleton").agg(F.max(F.struct("n", "word")).alias("top"))
    return words.join(best, "skeleton").where((F.col("word") != F.col("top.word")) & (F.col("top.n") >= TIMES * F.col("n")) & (F.length("word") >= 2) & (F.length("top.word") >= 3)).select("word", F.col("top.word").alias("repaired"))


_CLUE = "chunk_id string, kind string, key string, other string, flag int, paged int"


def _clue_rows(chunks: DataFrame, frequent: list[str]) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(frozenset(frequent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            known, rows = shared.value, []
            for chunk_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                heads, lines, pages, cuts = clues(text)
                if pages:
                    rows.append((chunk_id, "page", "", "", 0, 1))
                rows += [(chunk_id, "line", key, "", 0, paged) for key, paged in {(key, paged) for key, paged, _, _ in heads}]
                rows += [(chunk_id, "cut", (a + b).lower(), f"{a}-{b}".lower(), int(mark == "-"), 0) for a, mark, b in set(cuts)]
                if any(c in text for c in "OIlS|"):
                    if _MIXED.search(text) or _GROUP.search(text):
                        rows.append((chunk_id, "number", "", "", 0, 0))
                    rows += [(chunk_id, "lettered", w, "", 0, 0) for w in {w for _, w in _LETTERED.findall(text)}]
                odd = set()
                body = body_of(lines, pages) if len(lines) > 1 else text
                for unit in set(body.split()):
                    got = memo.get(unit)
                    if got is None:
                        got = tuple(w for x in words_in(unit) if not x.isdigit() and (w := x.lower()) not in known)
                        if len(memo) > 300_000:
                            memo.clear()
                        memo[unit] = got
                    odd.update(got)
                odd.update(x for a, _, b in cuts if (x := (a + b).lower()) not in known)
                rows += [(chunk_id, "word", w, "", 0, 0) for w in odd]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), *(pa.array(c, pa.int32()) for c in cols[4:])], names=["chunk_id", "kind", "key", "other", "flag", "paged"])

    return chunks.select("chunk_id", "text").where("chunk_id is not null and text is not null").mapInArrow(run, _CLUE)


def furniture(stats: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(part): lines (`=` and the whole line), beginnings, ends and short shapes of lines that repeat at page edges all over the corpus.

    They stand at REPEATS different places at least, and BROKEN of all lines that have them stand at a page edge in the middle of a sentence;
    clause titles are left out.
    """
    titles = chunks.select(F.col("section_title").alias("t")).union(sections.select("title")).where("t is not null").groupBy(F.concat(F.lit("="), F.regexp_replace(F.lower(F.trim("t")), r"\d+", "#")).alias("part")).agg(F.lit(1).alias("one")).select("part")
    # Copies of one clause repeat its lines between the same words; only different places count.
    part, first = F.split_part("key", F.lit("\t"), F.lit(1)), F.col("kind") == "broken"
    seen = stats.where("kind in ('edge', 'broken')").groupBy(part.alias("part")).agg(F.count("*").alias("places"), F.sum("n").alias("n"), F.count(F.when(first, 1)).alias("broken_places"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("broken"))
    often = seen.where((F.col("places") >= REPEATS) & (F.col("broken_places") >= BROKEN * F.col("places")))
    every = stats.where("kind = 'all'").select(F.col("key").alias("part"), F.col("n").alias("n_all"))
    edges = often.join(every, "part", "left").where(F.col("broken") >= BROKEN * F.coalesce("n_all", "n"))
    return edges.join(titles, "part", "left_anti").select("part")


def headers(seen: DataFrame, parts: DataFrame) -> DataFrame:
    """(chunk_id, key, paged): running headers and footers: the candidates that repeat as a whole or in a part (see `parts_of`); a line
    cut short by the scan still has the beginning."""
    lines = seen.where("kind = 'line'").select("chunk_id", "key", "paged")
    keys = lines.select("key").distinct()
    split = F.udf(lambda key: ["=" + key, *parts_of(key)], "array<string>", useArrow=True)
    known = staged(keys.select("key", F.explode(split("key")).alias("part")).join(parts, "part", "left_semi").select("key").distinct(), "p2_header_keys")
    return salted_join(lines, known, "key", "chunk_id")


def lettered(seen: DataFrame, stats: DataFrame) -> DataFrame:
    """(chunk_id, word): letters that stand for digits before a word that the corpus writes after numbers."""
    after = stats.where("kind = 'numbered'").select(F.col("key").alias("word"), F.col("n").alias("numbered"))
    words = stats.where("kind = 'word'").select(F.col("key").alias("word"), "n")
    counted = after.join(words, "word").where(F.col("numbered") >= NUMBERED * F.col("n")).select("word")
    return salted_join(seen.where("kind = 'lettered'").select("chunk_id", F.col("key").alias("word")), counted, "word", "chunk_id")


def hyphens(seen: DataFrame, stats: DataFrame) -> DataFrame:
    """(chunk_id, joined): words cut at a line end: the joined word is more frequent in the corpus than the compound with the hyphen.

    A mark that is no hyphen always cuts. Where the corpus has neither form, a compound is taken to be one whose parts are both its words.
    """
    cuts = seen.where("kind = 'cut'").select("chunk_id", F.col("key").alias("joined"), F.col("other").alias("compound"), F.col("flag").alias("plain"))
    forms = cuts.select("joined", "compound", "plain").distinct()
    words = stats.where("kind = 'word'").select("key", "n")
    known = (
        forms.join(words.toDF("joined", "n_joined"), "joined", "left")
        .join(stats.where("kind = 'compound'").select(F.col("key").alias("compound"), F.col("n").alias("n_compound")), "compound", "left")
        .withColumn("left", F.split_part("compound", F.lit("-"), F.lit(1)))
        .withColumn("right", F.split_part("compound", F.lit("-"), F.lit(2)))
        .join(words.toDF("left", "n_left"), "left", "left")
        .join(words.toDF("right", "n_right"), "right", "left")
        .fillna(0)
    )
    cut = (F.col("plain") == 0) | (F.col("n_joined") > F.col("n_compound")) | ((F.col("n_joined") == 0) & (F.col("n_compound") == 0) & (F.least("n_left", "n_right") < TIMES))
    return salted_join(cuts, known.where(cut).select("joined", "compound", "plain").distinct().withColumnRenamed("compound", "c").withColumnRenamed("plain", "p"), "joined", "chunk_id").where("c = compound and p = plain").select("chunk_id", "joined").distinct()


def evidence(chunks: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(clues of each chunk, corpus statistics, repeated parts of lines, misread words), all over the whole corpus."""
    stats = staged(statistics(chunks), "p2_stats")
    misread = staged(misread_words(stats), "p2_misread")
    top = stats.where("kind = 'word'").join(misread, stats["key"] == misread["word"], "left_anti").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key")
    seen = staged(_clue_rows(chunks, [r["key"] for r in top.collect()]), "p2_clues")
    return seen, stats, staged(furniture(stats, chunks, sections), "p2_furniture"), misread


def found(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, noise): the kinds of scanning noise in each chunk's text, each once.

    Null texts and rows without chunk_id give none; one-line texts can only have misread characters; repeated rows count
    once; empty tables give no rows; extra columns are ignored. Words that many chunks hold are joined in salted parts.
    """
    seen, stats, repeated, misread = evidence(chunks, sections)
    heads = staged(headers(seen, repeated), "p2_heads")
    parts = {
        "header": heads.select("chunk_id"),
        "page_no": seen.where("kind = 'page'").select("chunk_id").union(heads.where("paged = 1").select("chunk_id")),
        "hyphen": hyphens(seen, stats),
        "chars": salted_join(seen.where("kind = 'word'").withColumnRenamed("key", "word"), misread, "word", "chunk_id").select("chunk_id").union(seen.where("kind = 'number'").select("chunk_id")).union(lettered(seen, stats).select("chunk_id")),
    }
    out = None
    for noise, rows in parts.items():
        rows = rows.select("chunk_id", F.lit(noise).alias("noise"))
        out = rows if out is None else out.union(rows)
    return out.distinct()


_DIGITS = str.maketrans("OIlS|", "01151")


def repair(text: str, furniture_keys: set[str], joined: set[str], repaired: dict[str, str], counted: set[str] = frozenset()) -> str:
    """The text without furniture and page numbers, with cut words joined, misread words and numbers set right and wrapped lines run together.

    A line goes on into the next only if it is full, that is if the next word would not have fitted; other line ends,
    empty lines, headings and list items stay.
    """
    heads, lines, pages, _ = clues(text)
    width = width_of(lines)
    kept: list[str] = []
    dropped = False
    for k, line in enumerate(lines):
        if k in pages or (heads and line.strip() and line_key(line) in furniture_keys and page_edge(lines, k, width)):
            dropped = True
            continue
        if dropped and not line.strip():
            continue  # the empty lines around a page break
        if dropped and kept and not kept[-1].strip() and not _ended(next((x for x in reversed(kept) if x.strip()), ".")):
            while kept and not kept[-1].strip():
                kept.pop()
        dropped = False
        kept.append(line.rstrip())
    out: list[str] = []
    for k, line in enumerate(kept):
        # A number or "Clause 4.2" at the beginning of a line heads it only if the line before has ended.
        if not out or not line.strip() or not out[-1].strip() or (_HEADING.match(line) and (_ended(out[-1]) or len(kept[k - 1]) + 1 + len(line.split(None, 1)[0]) <= width)):
            out.append(line)
            continue
        m, n = _cut(out[-1]), _HEAD.match(line)
        if m and n and (m[0] + n[1]).lower() in joined:
            out[-1] = out[-1][: m[2]] + line.lstrip()
        elif m and n:
            out[-1] = out[-1].rstrip() + line.lstrip()
        elif len(kept[k - 1]) + 1 + len(line.split(None, 1)[0]) > width and len(kept) > 1:
            out[-1] += " " + line.lstrip()
        else:
            out.append(line)

    def right(m: re.Match) -> str:
        for i in range(len(m[1]) + 1):
            for j in range(len(m[3]), -1, -1):
                word = m[1][i:] + m[2] + m[3][:j]
                if (to := repaired.get(word.lower())) is not None:
                    to = to.upper() if word.isupper() and len(m[2]) > 1 else to.capitalize() if word[0].isupper() else to
                    return m[1][:i] + to + m[3][j:]
        return m[0]

    body = "\n".join(out)
    if repaired:
        body = _LETTERS.sub(right, body)
    for numbers in (_MIXED, _GROUP):
        body = numbers.sub(lambda m: m[0].translate(_DIGITS), body)
    if counted:
        body = _LETTERED.sub(lambda m: m[1].translate(_DIGITS) if m[2] in counted else m[1], body)
    return body.strip("\n")


def repaired_texts(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, repaired) of every chunk whose text carries scanning noise, as continuous paragraphs; nulls and repeats as in `found`."""
    seen, stats, repeated, misread = evidence(chunks, sections)
    heads = headers(seen, repeated).select("chunk_id", F.lit("line").alias("kind"), "key", F.lit("").alias("to"))
    cuts = hyphens(seen, stats).select("chunk_id", F.lit("cut").alias("kind"), F.col("joined").alias("key"), F.lit("").alias("to"))
    words = salted_join(seen.where("kind = 'word'").withColumnRenamed("key", "word"), misread, "word", "chunk_id").select("chunk_id", F.lit("word").alias("kind"), F.col("word").alias("key"), F.col("repaired").alias("to"))
    rest = seen.where("kind in ('page', 'number')").select("chunk_id", "kind", "key", F.lit("").alias("to"))
    numbers = lettered(seen, stats).select("chunk_id", F.lit("lettered").alias("kind"), F.col("word").alias("key"), F.lit("").alias("to"))
    marks = heads.union(cuts).union(words).union(numbers).union(rest).distinct().groupBy("chunk_id").agg(F.collect_list(F.struct("kind", "key", "to")).alias("marks"))
    texts = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks_of in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                by: dict[str, dict[str, str]] = {"line": {}, "cut": {}, "word": {}, "page": {}, "number": {}, "lettered": {}}
                for m in marks_of:
                    by[m["kind"]][m["key"]] = m["to"]
                out.append(repair(text, set(by["line"]), set(by["cut"]), by["word"], set(by["lettered"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["chunk_id", "repaired"])

    return texts.join(marks, "chunk_id").groupBy("chunk_id").agg(F.min("text").alias("text"), F.first("marks").alias("marks")).mapInArrow(run, "chunk_id string, repaired string")
