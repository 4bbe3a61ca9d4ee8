"""Test passages inside a training corpus, by a positional inverted index.

The index holds (document, position, term) for every occurrence of a term of the test
set in any document, with the term that follows it; other terms can't be part of a
match. Each window of consecutive test words is looked up by its rarest term, a pair of
neighbouring words, so what is followed up is as little as the window allows. An occurrence fixes where every other word of the passage would have to
stand in that document; those places are intersected with the index, and what is left
are exact runs of words.

What is broadcast has the size of the test set, which is the stated set of queries, and
is checked before. Postings of documents without a candidate are never shuffled. A
frequent term or a very long document doesn't gather on one task: joins with the index
are on document and position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortament.operators.joins import broadcast_if_small
from sortament.session import materialise

#: Consecutive words that make a leak.
RUN = 12
#: Of these, so many may be missing or wrong in a proximity match,
MISSING = 2
#: and the others stand up to so many words off their places.
SLACK = 2
#: Words of items and documents up to which they are broadcast; beyond, joins shuffle and
#: adaptive execution splits partitions that a frequent pair makes large.
MOST_WORDS, MOST_DOCUMENTS = 1_000_000, 500_000


def _positions(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(``name``, pos, term, next): words are runs of letters or digits, whatever the case."""
    kept = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    words = kept.select(F.col(key).alias(name), F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("term"), F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))).alias("next"))
    return words.select(name, F.posexplode(pairs).alias("pos", "pair")).select(name, "pos", "pair.*").toDF(name, "pos", "term", "next")


@dataclass(frozen=True)
class LeakIndex:
    """The test set's words by place, and the corpus's postings of its terms."""

    items: DataFrame  # item, pos, term, next
    postings: DataFrame  # doc, pos, term, next


def build_index(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str) -> LeakIndex:
    """Postings of every occurrence, in all documents, of every term of the test set."""
    placed = materialise(_positions(items, item_id, passage, "item").distinct())
    terms = broadcast_if_small(placed.select("term").distinct(), MOST_WORDS)
    return LeakIndex(placed, materialise(_positions(docs, doc_id, text, "doc").join(terms, "term", "left_semi").select("doc", "pos", "term", "next")))


def _anchors(index: LeakIndex, run: int, pairs: int = 1) -> DataFrame:
    """(item, at, term, next): the places of the ``pairs`` rarest pairs of each window of
    ``run`` words, as far as documents have them."""
    pair = ["term", "next"]
    wanted = broadcast_if_small(index.items.select(pair).where("next is not null").distinct(), MOST_WORDS)
    counts = index.postings.join(wanted, pair, "left_semi").groupBy(pair).agg(F.count(F.lit(1)).alias("n"))
    # A pair that no document has rules out a whole run, so it counts as rarest.
    rarity = index.items.join(broadcast_if_small(counts, MOST_WORDS), pair, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    window = Window.partitionBy("item").orderBy("pos").rowsBetween(0, run - 2)  # one test item
    best = F.slice(F.array_sort(F.collect_list(F.struct("n", "pos", *pair)).over(window)), 1, pairs)  # of one window
    full = F.count("next").over(window) == run - 1
    chosen = rarity.select("item", best.alias("best"), full.alias("full")).where("full")
    return chosen.select("item", F.explode("best").alias("best")).where("best.n > 0").select("item", F.col("best.pos").alias("at"), "best.term", "best.next").distinct()


def _hits(index: LeakIndex, run: int, pairs: int = 1, slack: int = 0) -> DataFrame:
    """(item, doc, shift, place, off): words of items that documents have where an anchor
    (``shift`` is its place in the document less that in the item) would put them, or up
    to ``slack`` words off, around the anchor."""
    anchors = broadcast_if_small(_anchors(index, run, pairs), MOST_WORDS)
    met = materialise(index.postings.join(anchors, ["term", "next"]).select("item", "doc", (F.col("pos") - F.col("at")).alias("shift"), "at"))
    near = broadcast_if_small(materialise(index.items.select("item", F.col("pos").alias("place"), "term")), MOST_WORDS)
    wanted = met.join(near, "item").where(F.abs(F.col("place") - F.col("at")) < run)
    wanted = wanted.select("item", "doc", "shift", "place", "term", F.explode(F.array(*[F.lit(o) for o in range(-slack, slack + 1)])).alias("off"))
    wanted = wanted.withColumn("pos", F.col("place") + F.col("shift") + F.col("off")).where("pos >= 0")
    some = broadcast_if_small(met.select("doc").distinct(), MOST_DOCUMENTS)
    there = index.postings.join(some, "doc", "left_semi")
    return wanted.join(there, ["doc", "pos", "term"]).groupBy("item", "doc", "shift", "place").agg(F.min(F.abs("off")).alias("off"))


def _stretches(hits: DataFrame) -> DataFrame:
    """(item, doc, shift, words): runs of places that follow each other."""
    # A run is a stretch of places that keep their distance to their rank.
    rank = F.row_number().over(Window.partitionBy("item", "doc", "shift").orderBy("place"))  # at most an item's words
    return hits.withColumn("stretch", F.col("place") - rank).groupBy("item", "doc", "shift", "stretch").agg(F.count(F.lit(1)).alias("words"))


def _runs(index: LeakIndex, run: int) -> DataFrame:
    """(item, doc, shift): placements with ``run`` or more consecutive words in common."""
    return _stretches(_hits(index, run)).where(F.col("words") >= run).select("item", "doc", "shift").distinct()


def leaked_items(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = RUN
) -> DataFrame:
    """(item_id, doc_id): every item and document with ``run`` or more consecutive words
    in common, whatever stands between words.

    ``run`` is 2 or more. Null ids and texts match nothing, nor do items of fewer words. Repeated rows change
    nothing; rows that share an id are one document and words at the same place count
    together. Whole texts are read. Empty input gives no rows.
    """
    index = build_index(docs, doc_id, text, items, item_id, passage)
    return _runs(index, run).select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id")).distinct()


def leak_matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    passage: str = "passage",
    run: int = RUN,
    missing: int = MISSING,
    slack: int = SLACK,
) -> DataFrame:
    """(item_id, doc_id, kind, words, longest_run, item_share): exact phrase and proximity
    matches.

    A document matches an item if it has ``run`` consecutive words of it but for at most
    ``missing``, each within ``slack`` words of its place after one of the pairs that they
    share: words may be replaced, left out or put in between. ``kind`` is EXACT if it has a
    whole run of them in place, else NEAR; ``words`` counts the item's words found in
    place or near it around such pairs, ``longest_run`` those of the longest phrase, and
    ``item_share`` is ``words`` as a part of the item.

    Complete: ``missing`` wrong words break twice as many pairs of neighbours at most, so
    of one pair more, the rarest of each window, one is whole; these are looked up. Nulls,
    repeats and empty tables are as for ``leaked_items``."""
    index = build_index(docs, doc_id, text, items, item_id, passage)
    hits = materialise(_hits(index, run, 2 * missing + 1, slack))
    phrases = _stretches(hits.where("off = 0")).groupBy("item", "doc").agg(F.max("words").alias("longest_run"))
    window = Window.partitionBy("item", "doc", "shift").orderBy("place").rangeBetween(0, run - 1)  # an item's words
    fit = hits.withColumn("in_window", F.count(F.lit(1)).over(window)).groupBy("item", "doc").agg(F.max("in_window").alias("in_window"), F.countDistinct("place").alias("words"))
    sizes = index.items.groupBy("item").agg(F.count(F.lit(1)).alias("size"))
    joined = fit.where(F.col("in_window") >= run - missing).join(phrases, ["item", "doc"], "left").join(broadcast_if_small(sizes, MOST_WORDS), "item")
    longest = F.coalesce("longest_run", F.lit(0).cast("long"))
    kind = F.when(longest >= run, "EXACT").otherwise("NEAR")
    share = F.round(F.col("words") / F.col("size"), 6)
    return joined.select(F.col("item").alias("item_id"), F.col("doc").alias("doc_id"), kind.alias("kind"), "words", longest.alias("longest_run"), share.alias("item_share"))
