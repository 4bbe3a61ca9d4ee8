"""Pages of repeated keywords, links or tags instead of sentences.

A first pass counts words by language over all documents: how often a word stands in
well-formed sentences, and how often anywhere. The most frequent words of a language's
sentences that are rarely seen outside them are its function words; there is no list.

A second pass reads each text once and cuts it into units (lines, sentences, cells). Per
document come out its words in links, its words by the rate of function words of their
unit, its words in price rows, the words of sentences without function words, and the
shares of its top word, its repeated word triples, its repeated units and its separators.
How rare function words must be for a unit to be no sentence is calibrated per language:
a fixed part of their rate in that language's well-formed sentences. So is from where on
each of the four shares is unusual: a high percentile of the language's pages of
sentences. On a page without sentences of which one share is unusual, every word outside
price rows counts as a keyword. A page is spam if more than half of its words stand in
links, are such keywords or are in units that are no sentences.

Quoted threads, repeated forum sentences and sentences on one subject repeat themselves
too, but have function words in well-formed sentences, or after ever other words.

A document's language is what ``lang`` names, unless its letters are not those in which
documents of that code are mostly written; then, and where ``lang`` is null, it is the
commonest language of its letters. A language with too few sentences to learn from gets
no function words: sentences are told by their form alone, keywords by the four shares.

Arrow batches go to Python because one scan of a text yields all features; all counts
are built-in expressions. What the driver gets is bounded: FUNCTION_WORDS words and five
numbers per language.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortament.operators.joins import broadcast_if_small
from sortament.operators.units import UNIT
from sortament.session import materialise, ship_package

#: So many words of a language's sentences, the most frequent, are its function words at most.
FUNCTION_WORDS = 150
#: So many of its frequent words that stand outside sentences are kept at most.
LISTED_WORDS = 1_000
#: A function word has at least this part of its occurrences in well-formed sentences.
IN_SENTENCES = 0.8
#: and makes up at least this part of all words of the language's sentences.
LEAST_FREQUENCY = 0.001
#: and is followed there by different words: so many of the 64 places that a hash gives them.
LEAST_CONTEXTS = 16
#: A word of lists has less than this part of its occurrences in well-formed sentences;
#: a function word before it says nothing.
OF_LISTS = 0.5
#: Words counted together in a Python worker, which bounds its memory.
WORDS_AT_ONCE = 2_000_000
#: Stands behind a sentence among the numbers of words, which begin at 0.
END = -1
#: Words in well-formed sentences from which a language's function words are learned.
LEAST_WORDS = 1_000
#: A unit is no sentence below this part of its language's rate of function words in sentences.
PART_OF_RATE = 0.25
#: Words in units that are no sentences, and in links, beyond which a page is spam.
MOST_SHARE = 0.5
#: Share of repeated triples from which sentences without function words count as keywords,
#: on pages whose well-formed sentences have as few of them as units that are no sentences.
REPEATED_TRIPLES = 0.4
#: A page's share is unusual above this percentile of its language's pages of sentences.
USUAL = 0.99
#: So often must a page's top word occur for its share to say anything.
TOP_COUNT = 3
BINS, STEP = 24, 0.025
MEASURES = ("top_word_share", "repeated_triples", "repeated_units", "separator_density")
# Codes of three letters for languages that also have one of two.
CODES = {
    "rus": "ru", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "pol": "pl", "ukr": "uk", "bel": "be",
    "kaz": "kk", "tur": "tr", "nld": "nl", "dut": "nl", "ces": "cs", "cze": "cs", "bul": "bg", "srp": "sr", "fin": "fi", "swe": "sv", "ron": "ro", "hun": "hu",
}
# Ranges of the letters of a script.
SCRIPTS = {"latin": "a-z\u00df-\u024f", "cyrillic": "\u0400-\u052f", "greek": "\u0370-\u03ff", "arabic": "\u0600-\u06ff", "hebrew": "\u0590-\u05ff"}

_LINK = re.compile(r"<a\s[^<>]*+>[^<]*+</a>|\[[^\[\]\n]*+\]\([^)\s\[]*+\)|https?://\S+|(?<![\w.-])(?:[\w-]++\.)++[a-z]{2,24}/[\w/.-]*", re.I)
#: Every link has one of these, which are found faster.
_MAY_LINK = re.compile(r"<[aA]\s|\]\(|://|\.[^\W\d_]{2,24}/")
_MARKS = (".", "!", "?", "…")


def _letters_and_digits() -> str:
    """What [^\\W_] stands for in the Basic Multilingual Plane, as ranges. Python looks up a
    set of signs in a table, where it asks for the properties of a class one by one."""
    is_one = np.array([chr(c).isalnum() for c in range(1 << 16)] + [False])
    edges = np.flatnonzero(np.diff(is_one, prepend=False)).reshape(-1, 2)
    return "".join(f"\\u{first:04x}-\\u{end - 1:04x}" for first, end in edges.tolist())


_BEYOND = re.compile("[\U00010000-\U0010ffff]")
#: Letters and digits of a text without signs beyond that plane, and of a text with some.
_ALNUM = (f"[{_letters_and_digits()}]", r"[^\W_]")
_WORDS = tuple(re.compile(f"{a}+").findall for a in _ALNUM)
_WORDS_AND_COMMAS = tuple(re.compile(f"{a}+|,").findall for a in _ALNUM)
#: Signs after which a unit ends.
_UNITS = re.compile(r"([.!?…»]+(?=\s+\D|\s*$)|\s[|•]\s)")
#: The same for texts without these two signs; patterns that begin with a set of signs skip to them.
_SENTENCES = re.compile(r"([.!?…»][.!?…»]*(?=\s+\D|\s*$))")
_SEPARATORS = ",;:#/()«»\"|•"
_DASHES = (" — ", " – ", " - ")
_DASH = re.compile(r"[—–-]\s.*\d")
_NUMBER = re.compile(r"\d(?<![\w.,]\d)\d*(?:[.,'\s]\d+)*(?!\w)")
_NUMBER_UNIT = re.compile(rf"\d\s*(?=[^\W\d_]|[₽$€])(?:{UNIT}|руб|₽|р\.|\$|€|usd|eur|rub)(?!\w)", re.I)
_UNIT_NUMBER = re.compile(rf"(?<!\w)(?=[^\W\d_])(?:{UNIT})\.?\s*[—–:)-]", re.I)
_NAMES = ("", *SCRIPTS)


def _script_table() -> np.ndarray:
    """The number of a script in _NAMES by UTF-16 unit; 0 for other signs."""
    table = np.zeros(1 << 16, np.uint8)
    for n, span in enumerate(SCRIPTS.values(), 1):
        for first, last in re.findall("(.)-(.)", span):
            table[ord(first) : ord(last) + 1] = n
    return table


_SCRIPT_OF = _script_table()



@dataclass(frozen=True)
class Lists:
    """What all documents say about words, by language: ``functions``, the function words,
    and ``listed``, frequent words that mostly stand outside sentences; ``common``, the
    commonest language of each script; ``scripts``, the script of each language."""

    functions: dict[str, frozenset[str]]
    listed: dict[str, frozenset[str]]
    common: dict[str, str]
    scripts: dict[str, str]
    cache: dict[str, tuple[frozenset[str], frozenset[str]]] = field(default_factory=dict, compare=False)

    def language(self, text: str, code: str | None) -> str:
        """The language of a text in lower case; see above."""
        counts = np.bincount(_SCRIPT_OF[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)], minlength=len(_NAMES))
        script = _NAMES[1 + int(counts[1:].argmax())]
        if code and self.scripts.get(code, script) == script:
            return code
        return self.common.get(script, code or script)

    def words(self, lang: str) -> tuple[frozenset[str], frozenset[str]]:
        """Function words and words of lists of a language and of the commonest ones of
        the other scripts, as a text may quote them. A comma counts as a word of lists."""
        if lang not in self.cache:
            self.cache[lang] = self._words(lang)
        return self.cache[lang]

    def _words(self, lang: str) -> tuple[frozenset[str], frozenset[str]]:
        used = [lang, *(c for s, c in self.common.items() if s != self.scripts.get(lang))]
        functions, listed = (frozenset().union(*[of.get(c, ()) for c in used]) for of in (self.functions, self.listed))
        return functions, listed | {","}


def page_features(text: str, code: str | None, lists: Lists) -> tuple:
    """(language, words, link words, words of units by bin of function words, words of
    units in price rows, words of sentences without function words, separators, top word's
    share, share of repeated triples, share of repeated units, function words and words of
    well-formed sentences, function words before ever other words, words of different
    units)."""
    links = 0
    beyond = _BEYOND.search(text) is not None
    words_in, tokens_in = _WORDS[beyond], _WORDS_AND_COMMAS[beyond]

    def cut(m: re.Match) -> str:
        nonlocal links
        links += len(words_in(m[0]))
        return "\n"

    rest = _LINK.sub(cut, text) if _MAY_LINK.search(text) else text
    lang = lists.language(rest.lower(), code)
    known, listed = lists.words(lang)
    split = _units_of(rest)
    signs = [sign for sign in (*_DASHES, *_SEPARATORS) if sign != "," and sign in rest]
    by_bin, rows, plain = [0] * BINS, 0, 0
    separators = good_hits = good_words = fresh = many = 0
    units: set[tuple] = set()
    all_words: list[str] = []
    varied: set[tuple] = set()  # function words with the word that follows
    for line in rest.split("\n"):
        # Rows of prices have their amounts after a dash.
        if ("—" in line or "–" in line or "- " in line) and _DASH.search(line) and len(_NUMBER.findall(line)) >= 3 and (_NUMBER_UNIT.search(line) or _UNIT_NUMBER.search(line)):
            found = words_in(line.lower())
            if sum(w in known for w in found) * 8 < len(found):
                rows += len(found)
                all_words += found
                continue
        pieces = split(line)
        pieces.append("")
        for at in range(0, len(pieces), 2):
            unit = pieces[at]
            low = unit.lower()
            for sign in signs:
                low = low.replace(sign, ",")
            tokens = tokens_in(low)
            words = [w for w in tokens if w != ","] if "," in low else tokens
            if not words:
                continue
            separators += len(tokens) - len(words)
            all_words += words
            many += 1
            if (key := tuple(words)) not in units:
                units.add(key)
                fresh += len(words)
            hits = 0
            if not known.isdisjoint(words):
                pairs = [(w, then) for w, then in zip(tokens, tokens[1:]) if w in known and then not in listed]
                hits = len(pairs)
                varied.update(pairs)
            n = len(words)
            formed = _formed(unit, n, pieces[at + 1])
            if formed:
                good_hits, good_words = good_hits + hits, good_words + n
            if formed and not hits:
                plain += n
            else:
                by_bin[min(BINS - 1, int(hits / n / STEP))] += n
    n = len(all_words) + links
    often = Counter(all_words)
    top = max(often.values()) / n if all_words else 0.0
    # A repeated triple has repeated words only.
    again = {w for w, c in often.items() if c > 1}
    triples = Counter([(a, b, c) for a, b, c in zip(all_words, all_words[1:], all_words[2:]) if a in again and b in again and c in again])
    total = max(0, len(all_words) - 2)
    repeated = sum(c for c in triples.values() if c > 1) / total if total else 0.0
    copies = (many - len(units)) / max(1, many)
    return lang, n, links, by_bin, rows, plain, separators, top, repeated, copies, good_hits, good_words, len(varied), fresh


def _code(lang: Column) -> Column:
    """A code as of two letters where there is one: in lower case, without region."""
    plain = F.regexp_extract(F.lower(F.trim(lang.cast("string"))), "^([a-z]{2,3})(?:[-_].*)?$", 1)
    codes = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    return F.when(plain != "", F.coalesce(F.try_element_at(codes, plain), plain))


def _units_of(text: str) -> Callable[[str], list[str]]:
    """What cuts the lines of a text into units: unit, the signs after it, unit ..."""
    return _UNITS.split if "|" in text or "•" in text else _SENTENCES.split


def _formed(unit: str, n: int, mark: str) -> bool:
    """A well-formed sentence: begins with a capital, ends with a mark, four words or more."""
    return n >= 4 and mark[:1] in _MARKS and unit.lstrip(" >*«\"'\t")[:1].isupper()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, word, inside, n, contexts) of some texts: a word's occurrences in well-formed
    sentences and in all, and as bits the places that a hash gives the words that follow it
    there. Texts are counted together until they have WORDS_AT_ONCE words."""
    names = ["code", "word", "inside", "n", "contexts"]

    def counted(ids: dict[str, int], inside: array, outside: array) -> list[pa.Array]:
        words, within = list(ids), np.array(inside, np.int32)
        inner = np.bincount(within[within > END], minlength=len(words))
        every = inner + np.bincount(np.array(outside, np.int32), minlength=len(words))
        place = np.array([1 << (crc32(w.encode("utf-8", "surrogatepass")) & 63) if n else 0 for w, n in zip(words, inner.tolist(), strict=True)], np.uint64)
        word, then = within[:-1], within[1:]
        both = (word > END) & (then > END)
        contexts = np.zeros(len(words), np.uint64)
        np.bitwise_or.at(contexts, word[both], place[then[both]])
        kept = np.array([w.isalpha() for w in words], bool)
        return [pa.array(words, pa.string()).filter(pa.array(kept)), *(pa.array(x[kept]) for x in (inner, every, contexts.view(np.int64)))]

    def flush(held: dict[str | None, tuple]) -> Iterator[pa.RecordBatch]:
        for code, of in held.items():
            words, *counts = counted(*of)
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(words), pa.string()), words, *counts], names)

    def nothing() -> tuple[dict[str, int], array, array]:
        """Numbers of words; those in sentences, each with END behind it; and the others."""
        return defaultdict(count().__next__), array("i"), array("i")

    for batch in batches:
        of, held = defaultdict(nothing), 0
        for code, text in zip(batch.column("code").to_pylist(), batch.column("text"), strict=True):
            (ids, inside, outside), text = of[code], text.as_py()
            number, split, words_in = ids.__getitem__, _units_of(text), _WORDS[_BEYOND.search(text) is not None]
            for line in text.split("\n"):
                pieces = split(line)
                pieces.append("")
                for at in range(0, len(pieces), 2):
                    words = words_in(pieces[at].lower())
                    if len(words) >= 4 and _formed(pieces[at], 4, pieces[at + 1]):
                        inside.extend(map(number, words))
                        inside.append(END)
                    else:
                        outside.extend(map(number, words))
                    held += len(words)
            if held > WORDS_AT_ONCE:
                yield from flush(of)
                of, held = defaultdict(nothing), 0
        yield from flush(of)


def learn_lists(docs: DataFrame) -> Lists:
    """The lists of ``docs`` (code, text), from all words of all documents. Words are
    counted per batch before they are shuffled; those with digits are left out, and only
    words with LEAST_FREQUENCY come to be ranked, so a language ranks 1,000 at most."""
    each = docs.select("code", "text").mapInArrow(_count_words, "code string, word string, inside bigint, n bigint, contexts bigint")
    counts = each.groupBy("code", "word").agg(F.sum("inside").alias("inside"), F.sum("n").alias("n"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    script = F.coalesce(*[F.when(F.col("word").rlike(f"^[{span}]"), F.lit(name)) for name, span in SCRIPTS.items()])
    counts = materialise(counts.withColumn("script", script).where("script is not null"))
    # One row per code and script.
    sums = [r for r in counts.groupBy("code", "script").agg(F.sum("inside").alias("n")).collect()]
    scripts: dict[str, str] = {}
    for r in sorted((r for r in sums if r.code), key=lambda r: (r.n, r.script)):
        scripts[r.code] = r.script  # the largest comes last
    common: dict[str, str] = {}
    for r in sorted((r for r in sums if r.code and scripts[r.code] == r.script), key=lambda r: (r.n, r.code)):
        common[r.script] = r.code
    totals = {r.code: r.n for r in sums if r.code and scripts[r.code] == r.script and r.n >= LEAST_WORDS}
    if not totals:
        return Lists({}, {}, common, scripts)
    wanted = docs.sparkSession.createDataFrame([(c, scripts[c], float(n)) for c, n in totals.items()], "code string, script string, total double")
    frequent = counts.join(F.broadcast(wanted), ["code", "script"])
    inside = (F.col("inside") >= F.col("total") * LEAST_FREQUENCY) & (F.col("inside") >= F.col("n") * IN_SENTENCES) & (F.col("contexts") >= LEAST_CONTEXTS)
    outside = (F.col("n") >= F.col("total") * LEAST_FREQUENCY) & (F.col("inside") < F.col("n") * OF_LISTS)
    kind = F.when(inside, "function").when(outside, "list")
    rank = F.row_number().over(Window.partitionBy("code", "kind").orderBy(F.col("n").desc(), "word"))  # a few thousand rows
    chosen = frequent.withColumn("kind", kind).where("kind is not null").withColumn("rank", rank).where((F.col("rank") <= FUNCTION_WORDS) | ((F.col("kind") == "list") & (F.col("rank") <= LISTED_WORDS)))
    found: dict[str, dict[str, set[str]]] = {"function": {}, "list": {}}
    for r in chosen.select("code", "kind", "word").collect():
        found[r.kind].setdefault(r.code, set()).add(r.word)
    functions, listed = ({c: frozenset(w) for c, w in found[k].items()} for k in ("function", "list"))
    return Lists(functions, listed, common, scripts)


_FEATURES = (
    "doc bigint, lang string, words bigint, link_words bigint, by_bin array<bigint>, row_words bigint, plain_words bigint, separators bigint, top_word_share double, "
    "repeated_triples double, repeated_units double, good_hits bigint, good_words bigint, varied_hits bigint, fresh_words bigint"
)
_SCHEMA = pa.schema(
    [("doc", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("link_words", pa.int64()), ("by_bin", pa.list_(pa.int64())), ("row_words", pa.int64()), ("plain_words", pa.int64())]
    + [("separators", pa.int64()), ("top_word_share", pa.float64()), ("repeated_triples", pa.float64()), ("repeated_units", pa.float64())]
    + [("good_hits", pa.int64()), ("good_words", pa.int64()), ("varied_hits", pa.int64()), ("fresh_words", pa.int64())]
)


def document_features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row of features per document with a text; ``has_list``: its language has
    function words. The column ``lang`` may be missing."""
    ship_package(docs.sparkSession)
    code = _code(F.col(lang)) if lang in docs.columns else F.lit(None).cast("string")
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc"), code.alias("code"), F.col(text).alias("text")).where("doc is not null and text is not null")
    lists = learn_lists(chosen)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes, texts = batch.column("doc").to_pylist(), batch.column("code").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 1000):
                rows = [(i, *page_features(t.as_py(), c, lists)) for i, c, t in zip(ids[at : at + 1000], codes[at : at + 1000], texts[at : at + 1000], strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)

    read = chosen.mapInArrow(scan, _FEATURES).withColumn("separator_density", F.col("separators") / F.greatest("words", F.lit(1)))
    return read.withColumn("has_list", F.col("lang").isin(*lists.functions) if lists.functions else F.lit(False))


def _lacks_sentences() -> Column:
    """Whether a page has too few function words before different words for the words of
    its different units; without a list, too few words in well-formed sentences. Quoted
    copies of a unit thus neither help nor harm. A page of price rows needs no sentences."""
    words = F.col("words") - F.col("row_words")
    least = F.coalesce("rate", F.lit(0.0)) * PART_OF_RATE * F.col("fresh_words")
    few = F.when(F.col("has_list"), F.col("varied_hits") < least).otherwise(F.col("good_words") < words * MOST_SHARE)
    return few & (F.col("row_words") <= F.col("words") * MOST_SHARE)


def calibrate(features: DataFrame) -> DataFrame:
    """(lang, rate, most_...): function words per word in all well-formed sentences of a
    language, and what its pages of sentences reach of each measure; null without any."""
    sums = features.groupBy("lang").agg(F.sum("good_hits").alias("hits"), F.sum("good_words").alias("of"))
    rates = materialise(sums.select("lang", (F.col("hits") / F.greatest(F.col("of"), F.lit(1))).alias("rate")))
    # Of shares rounded to hundredths an exact percentile keeps a hundred counts.
    own = features.join(broadcast_if_small(rates), "lang", "left").where((F.col("words") > 0) & (F.col("row_words") <= F.col("words") * MOST_SHARE) & ~_lacks_sentences())
    most = own.groupBy("lang").agg(*[F.percentile(F.round(m, 2), F.lit(USUAL)).alias(f"most_{m}") for m in MEASURES])
    return rates.join(broadcast_if_small(most), "lang", "left")


def _spam_share() -> Column:
    """Share of a document's words in links, in units that are no sentences and, without
    sentences on the page, in keywords."""
    limit = F.greatest(F.lit(1.0), F.round(F.coalesce("rate", F.lit(0.0)) * PART_OF_RATE / STEP)).cast("int")  # bins below it
    listed = F.aggregate(F.slice("by_bin", F.lit(1), F.least(limit, F.lit(BINS))), F.lit(0).cast("long"), lambda total, x: total + x)
    few = F.col("good_hits") < F.coalesce("rate", F.lit(0.0)) * PART_OF_RATE * F.col("good_words")
    keywords = F.when((F.col("repeated_triples") >= REPEATED_TRIPLES) & few, F.col("plain_words")).otherwise(0)
    by_units = F.when(F.col("has_list"), listed + keywords).otherwise(0)
    often = F.col("top_word_share") * F.col("words") >= TOP_COUNT - 0.5
    # Separators make lists only outside well-formed sentences.
    apart = F.col("good_words") <= F.col("words") * MOST_SHARE
    also = dict.fromkeys(MEASURES, F.lit(True)) | {"top_word_share": often, "separator_density": apart}
    unusual = reduce(Column.__or__, [F.coalesce((F.col(m) > F.col(f"most_{m}")) & also[m], F.lit(False)) for m in MEASURES])
    pages = F.when(unusual & _lacks_sentences(), F.col("words") - F.col("row_words")).otherwise(0)
    return F.greatest(F.col("link_words") + by_units, pages) / F.greatest("words", F.lit(1))


def score_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, spam_share, link_share, separator_density, top_word_share,
    repeated_triples, repeated_units): one row per document with a text.

    A null text or id gives no row; an empty text has share 0. Repeated rows are scored
    each. Whole texts are read. Other columns are not.
    """
    features = materialise(document_features(docs, doc_id, text, lang))
    scored = features.join(broadcast_if_small(calibrate(features)), "lang", "left")
    words = F.greatest("words", F.lit(1))
    return scored.select(
        F.col("doc").alias("doc_id"),
        "lang",
        F.round(_spam_share(), 6).alias("spam_share"),
        F.round(F.col("link_words") / words, 6).alias("link_share"),
        F.round("separator_density", 6).alias("separator_density"),
        F.round("top_word_share", 6).alias("top_word_share"),
        F.round("repeated_triples", 6).alias("repeated_triples"),
        F.round("repeated_units", 6).alias("repeated_units"),
    )


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id): documents of which more than half of the words belong to repeated
    keywords, lists of links or lists of tags."""
    return score_pages(docs, doc_id, text, lang).where(F.col("spam_share") > MOST_SHARE).select("doc_id").distinct()
