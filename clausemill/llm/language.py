"""Language of documents and of paragraphs, by prediction by partial matching over bytes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = 4
#: Documents a language, characters of a document, that the models are fitted on at most.
FIT_DOCS, FIT_CHARS = 300, 8000
#: Units kept with their code lengths, and letters of a word that is kept so; longer ones are worked out each time.
MEMO, KEPT = 300_000, 60
#: A text of at least so many letters is in none of the languages if its code length a letter is so many times what 99 of 100 texts of its nearest language stay under.
LETTERS, UNLIKE = 30, 2.5
NONE = "und"
#: Other names of a language in labels (codes of three letters, native names), and labels that name none.
NAMES = {
    "eng": "en", "english": "en", "anglais": "en", "englisch": "en", "inglés": "en",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "spanisch": "es",
    "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl", "niederländisch": "nl", "flemish": "nl", "vlaams": "nl",
    "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt", "portugiesisch": "pt",
    "ita": "it", "italian": "it", "italiano": "it", "italienisch": "it",
    "swe": "sv", "swedish": "sv", "svenska": "sv", "schwedisch": "sv",
    "pol": "pl", "polish": "pl", "polski": "pl", "polnisch": "pl",
    "dan": "da", "danish": "da", "dansk": "da", "dänisch": "da",
}
NO_LABEL = ("", "und", "unknown", "unk", "undetermined", "undefined", "none", "null", "n/a", "na", "?", "??", "-", "--", "xx", "zxx", "mis", "mul", "other", "nan", "not known", "tbd")
_WORD = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\n[ \t\f\v]*(?:\n[ \t\f\v]*)+")


class ContextTree:
    """Frozen counts of the bytes that follow each context of up to ORDER bytes inside a word."""

    def __init__(self, words: dict[str, int]):
        nodes: dict[bytes, dict[int, int]] = {}
        for word, n in words.items():
            raw = b" " + word.encode() + b" "
            for i in range(1, len(raw)):
                for k in range(min(ORDER, i) + 1):
                    node = nodes.setdefault(raw[i - k : i], {})
                    node[raw[i]] = node.get(raw[i], 0) + n
        self.nodes = {c: (d, sum(d.values())) for c, d in nodes.items()}

    def bits(self, word: str) -> float:
        """Exact code length of a word and its end: escape method C, with exclusion of what longer contexts ruled out."""
        raw, total = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(raw)):
            out: set[int] = set()
            for k in range(min(ORDER, i), -1, -1):
                node = self.nodes.get(raw[i - k : i])
                if node is None:
                    continue
                counts, n = node
                if out:
                    left = {b: c for b, c in counts.items() if b not in out}
                    n = sum(left.values())
                else:
                    left = counts
                if not left:
                    continue
                seen = left.get(raw[i])
                if seen:
                    total -= log2(seen / (n + len(left)))
                    break
                total -= log2(len(left) / (n + len(left)))
                out.update(left)
            else:
                total += log2(256 - len(out))
        return total


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Models:
    """One context tree per language, and the bits a letter beyond which a text is in none; the code lengths of a word are worked out once."""

    def __init__(self, trees: dict[str, ContextTree], limits: dict[str, float] | None = None):
        self.langs, self.trees, self.limits = sorted(trees), trees, limits or {}
        self.limit = np.array([self.limits.get(x, np.inf) for x in self.langs])
        self.forget()

    def __getstate__(self):
        return {"trees": self.trees, "limits": self.limits}

    def __setstate__(self, state):
        self.__init__(state["trees"], state["limits"])

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1))
        self.by_word: dict[str, np.ndarray] = {}

    def word(self, w: str) -> np.ndarray:
        """Its code length under each language, and its letters."""
        got = self.by_word.get(w)
        if got is None:
            got = np.array([*(self.trees[x].bits(w) for x in self.langs), len(w)])
            if len(w) <= KEPT:
                self.by_word[w] = got
        return got

    def unit(self, unit: str) -> np.ndarray:
        return sum((self.word(w) for w in words_of(unit)), np.zeros(len(self.langs) + 1))

    def _new(self, unit: str) -> int:
        k = len(self.row)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.unit(unit)
        self.row[unit] = k
        return k

    def measured(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code length in bits of each text under each language, all 0 for a text without words; and its letters."""
        if len(self.row) > MEMO:
            self.forget()
        known, flat, sizes, long = self.row, [], [], []
        for i, t in enumerate(texts):
            units = t.split()
            if len(t) > KEPT and len(max(units, key=len, default="")) > KEPT:
                long.append((i, sum(self.unit(u) for u in units if len(u) > KEPT)))
                units = [u for u in units if len(u) <= KEPT]
            sizes.append(len(units))
            flat += [known[u] if u in known else self._new(u) for u in units]
        out = np.zeros((len(texts), len(self.langs) + 1))
        if flat:
            at = np.fromiter(flat, np.int64, len(flat))
            n = np.array(sizes)
            full = np.flatnonzero(n)
            starts = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            out[full] = np.add.reduceat(self.rows[at], starts)
        for i, row in long:
            out[i] += row
        return out[:, :-1], out[:, -1]

    def lengths(self, texts: list[str]) -> np.ndarray:
        return self.measured(texts)[0]

    def none(self, bits: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """By how much each text is beyond the limit of its nearest language: 0 if it is not, else up to 1."""
        if not len(bits):
            return np.zeros(0)
        rate = bits.min(axis=1) / np.maximum(letters, 1)
        limit = self.limit[bits.argmin(axis=1)]
        return np.where((letters >= LETTERS) & (rate > limit), 1 - limit / np.maximum(rate, 1e-9), 0.0)


def paragraphs(text: str) -> list[str]:
    """The paragraphs, set apart by empty lines; empty ones do not count."""
    return [p for x in _BLANK.split(text.replace("\r\n", "\n").replace("\r", "\n")) if (p := x.strip())]


def label_code(label: Column, languages: DataFrame) -> Column:
    """The code a label names: null if it names none, '?' if it names an unknown language; regions and scripts are dropped."""
    low = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"^\s+|\s+$", "")
    base = F.regexp_replace(low, r"[-_].*$", "")
    codes = {r["lang"]: r["lang"] for r in languages.select("lang").where("lang is not null").distinct().collect()}
    codes |= {v: v for v in NAMES.values()} | NAMES
    codes |= {r["name"].strip().lower(): r["lang"] for r in languages.where("name is not null and lang is not null").collect()}
    named = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.when(low.isin(*NO_LABEL), None).otherwise(F.coalesce(F.try_element_at(named, low), F.try_element_at(named, base), F.lit("?")))


def fit(documents: DataFrame, languages: DataFrame, docs: int = FIT_DOCS, chars: int = FIT_CHARS) -> Models:
    """Context trees from at most `docs` labelled documents a language, each of at most `chars` characters.

    Labels may be wrong: each half of the sample is judged by trees of the other half. A language stays if it is found in at
    least half of the paragraphs filed under it, and the last trees see only paragraphs that were found to be in it.
    """
    coded = documents.where(F.col("text").isNotNull() & F.length("text").between(12, chars)).select("doc_id", label_code(F.col("lang"), languages).alias("code"), "text")
    first = W.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = coded.where("code is not null and code <> '?'").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= docs).collect()
    sample = [(r["code"], r["rn"] % 2, p) for r in rows for p in paragraphs(r["text"]) if len(p) >= 12]
    halves = []
    for half in (0, 1):
        counts: dict[str, Counter] = {}
        for code, h, p in sample:
            if h == half:
                counts.setdefault(code, Counter()).update(words_of(p))
        halves.append(Models({c: ContextTree(w) for c, w in counts.items() if w}))
    kept: dict[str, list[str]] = {}
    rates: dict[str, list[float]] = {}
    filed: Counter = Counter()
    for half in (0, 1):
        own, other = [(c, p) for c, h, p in sample if h == half], halves[1 - half]
        bits, letters = other.measured([p for _, p in own]) if own and other.langs else ([], [])
        for (code, p), row, n in zip(own, bits, letters):
            filed[code] += 1
            if other.langs[row.argmin()] == code:
                kept.setdefault(code, []).append(p)
                if n >= LETTERS:
                    rates.setdefault(code, []).append(float(row.min() / n))
    trees = {c: ContextTree(Counter(w for p in ps for w in words_of(p))) for c, ps in kept.items() if len(ps) * 2 >= filed[c]}
    if not trees:  # too few labels to judge them
        trees = {c: t for m in halves for c, t in m.trees.items()}
    # A limit needs enough texts to stand on.
    return Models(trees, {c: UNLIKE * float(np.quantile(r, 0.99)) for c, r in rates.items() if len(r) >= 20})


_OUT = "doc_id long, filed string, para_no int, n_chars int, lang string, confidence double, is_main boolean"


def segments(documents: DataFrame, languages: DataFrame, models: Models | None = None) -> DataFrame:
    """Language and confidence of each document (para_no 0) and of each paragraph (from 1).

    The document's language is that of most characters of its paragraphs; is_main tells whether a paragraph is in it. A text that is
    far longer in code than the texts of its nearest language are is in none of them (`und`).
    confidence is the language's share of the probability that the code lengths give (for `und`, by how much the text is beyond the
    limit), for a document weighed by the part of its characters. Null, empty and wordless texts give no row; ties go to the first code; repeated rows give repeated rows.
    One pass, no shuffle; the models are bounded by their sample.
    """
    models = models or fit(documents, languages)
    if not models.langs:
        return documents.sparkSession.createDataFrame([], _OUT)
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = [*own.langs, NONE]
        for batch in batches:
            texts, cols = batch.column(2).to_pylist(), ([], [], [], [], [], [], [])
            split = [paragraphs(t) if t else [] for t in texts]
            bits, letters = own.measured([p for ps in split for p in ps])
            beyond = own.none(bits, letters)
            least = np.where(beyond > 0, len(own.langs), bits.argmin(axis=1)) if len(bits) else bits
            odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 60.0)) if len(bits) else bits
            sure = np.where(beyond > 0, beyond, 1.0 / odds.sum(axis=1)) if len(bits) else bits
            worded = bits.any(axis=1) if len(bits) else bits
            at = 0
            for doc_id, filed, ps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), split):
                here = [k for k in range(at, at + len(ps)) if worded[k]]
                if here:
                    weight = np.zeros(len(own.langs) + 1)
                    trust = np.zeros(len(own.langs) + 1)
                    for k in here:
                        weight[least[k]] += len(ps[k - at])
                        trust[least[k]] += len(ps[k - at]) * sure[k]
                    main = int(weight.argmax())
                    rows = [(0, int(weight.sum()), main, trust[main] / weight.sum())] + [(k - at + 1, len(ps[k - at]), int(least[k]), float(sure[k])) for k in here]
                    for no, n, x, c in rows:
                        for col, v in zip(cols, (doc_id, filed, no, n, names[x], c, x == main)):
                            col.append(v)
                at += len(ps)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "filed", "para_no", "n_chars", "lang", "confidence", "is_main"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def wrong_labels(documents: DataFrame, languages: DataFrame, min_chars: int = 40) -> DataFrame:
    """Documents whose label is missing or names another language (para_no 0), and paragraphs in another language. What is in none of the languages has no name to give."""
    code = label_code(F.col("filed"), languages)
    whole = (F.col("para_no") == 0) & ~F.coalesce(code == F.col("lang"), F.lit(False))
    part = (F.col("para_no") > 0) & ~F.col("is_main") & (F.col("n_chars") >= min_chars)
    return segments(documents, languages).where((whole | part) & (F.col("lang") != NONE)).select("doc_id", "para_no", "lang")
