"""Values typed freely to the entries of a reference list.

Values and names are folded (case, look-alike letters, punctuation, a leading material
word) to tokens: their words and, as spaces may stand anywhere, all their letters in one.
Each distinct token is repaired: it is joined with the vocabulary of the list's tokens on
their deletion neighbourhoods (two strings within two edits share a string that is left
when up to two letters are deleted from each), so no pair is compared that can't match,
and the edit distance decides. Corrected tokens lead to entries: a whole one to those
that have it, words by their prefix, the rarest that can't all be missed at the wanted
score. Soft TF-IDF of the corrected words ranks the entries.

The vocabulary is broadcast only while it is small; the distinct tokens are what is
shuffled, and values go back to the rows by a join that holds for hot values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortament.functions.text import compact_key, strip_material, twin_fold
from sortament.operators.joins import broadcast_if_small, hot_key_join
from sortament.session import materialise, shuffle_width

#: Greatest number of wrong, missing or extra characters.
MAX_EDITS = 2
UNMATCHED = "UNMATCHED"

# Fixed value: how sellers write that they don't know the grade.
UNKNOWN_GRADE = "предпол."


#: A token's edits are no more than this part of its length, rounded down.
PART_OF_LENGTH = 0.34
#: Soft TF-IDF from which words in any order, or with one too many, make an entry.
LEAST_SCORE = 0.75


def vocabulary(entries: DataFrame) -> DataFrame:
    """(token, entry_id, rank, words, weight) of a list of (entry_id, name, rank): each
    name's letters in one token, its words with their TF-IDF weights, and their sum."""
    named = entries.where(F.col("name").isNotNull()).select("entry_id", "rank", _words(F.col("name")).alias("words"), compact_key(strip_material(F.col("name"))).alias("token"))
    named = materialise(named.where("token <> ''"))
    total = named.select("entry_id").distinct().count()
    rarity = named.select("entry_id", F.explode("words").alias("word")).groupBy("word").agg(F.countDistinct("entry_id").alias("n"))
    weights = rarity.select("word", F.log1p(F.lit(float(total)) / F.col("n")).alias("weight"))
    weighed = named.withColumn("word", F.explode("words")).join(weights, "word").groupBy("token", "entry_id", "rank")
    known = weighed.agg(F.array_sort(F.collect_set(F.struct("word", "weight"))).alias("words"))  # words of one name
    return known.withColumn("weight", F.aggregate("words", F.lit(0.0), lambda a, w: a + w["weight"]))


def _words(name: Column) -> Column:
    """The distinct folded words of a name without a leading material word."""
    return F.array_distinct(F.filter(F.split(twin_fold(strip_material(name)), r"[^\p{L}\p{Nd}]+"), lambda w: w != ""))


def deletions(token: Column, most: int = MAX_EDITS) -> Column:
    """Hashes of a token with up to ``most`` characters deleted."""
    level = F.array(token)
    everything = level
    for _ in range(most):
        level = F.array_distinct(
            F.flatten(
                F.transform(
                    level,
                    lambda s: F.transform(
                        F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>")),
                        lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)),
                    ),
                )
            )
        )
        everything = F.concat(everything, level)
    return F.array_distinct(F.transform(everything, lambda s: F.xxhash64(s)))


def edit_bound(length: Column, max_edits: int, part_of_length: float | None) -> Column:
    """How many edits a token of ``length`` may have; ``max_edits`` whatever the length
    where ``part_of_length`` is None."""
    if part_of_length is None:
        return F.lit(max_edits)
    return F.least(F.lit(max_edits), F.floor(length * part_of_length).cast("int"))


def soft_tfidf(entry_words: Column, value_words: Column, bound) -> Column:
    """Sum of the weights of an entry's words, each times its best similarity (1 less
    edits over length) to a word of the value within ``bound`` of its length."""

    def best(word: Column) -> Column:
        def similarity(v: Column) -> Column:
            longer, edits = F.greatest(F.length(v), F.length(word)), F.levenshtein(v, word)
            return F.when(edits <= bound(longer), 1 - edits / longer).otherwise(0.0)

        return F.coalesce(F.array_max(F.transform(value_words, similarity)), F.lit(0.0))

    return F.aggregate(entry_words, F.lit(0.0), lambda total, w: total + best(w["word"]) * w["weight"])


def near_tokens(tokens: DataFrame, known: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(token, near, edits): every token of ``tokens`` (token) with every token of ``known``
    (near) within ``max_edits``, a written table. Tokens longer than any known one by more
    match none and aren't taken apart."""
    longest = known.agg(F.max(F.length("near"))).first()[0] or 0
    # Deleting letters makes a hundred rows of one, so tokens are spread before.
    spread = tokens.where((F.length("token") <= longest + max_edits) & (F.col("token") != "")).distinct().repartition(shuffle_width(tokens.sparkSession))
    left = spread.select("token", F.explode(deletions(F.col("token"), max_edits)).alias("hash"))
    right = known.where("near <> ''").distinct().select("near", F.explode(deletions(F.col("near"), max_edits)).alias("hash"))
    met = left.join(broadcast_if_small(right, 500_000), "hash").select("token", "near").distinct()
    return materialise(met.withColumn("edits", F.levenshtein("token", "near", max_edits)).where("edits >= 0"))


def _weighed_words(values: DataFrame, close: DataFrame, known: DataFrame, bound) -> DataFrame:
    """(value, nears, rest, heft): each word of a value with what it may be corrected to;
    ``heft`` is the weight of all of the value's words (of each the heaviest it may stand
    for, or that of the rarest known word), ``rest`` that of the word and the lighter ones.
    A written table."""
    words = known.select(F.explode("words").alias("w")).select(F.col("w.word").alias("near"), F.col("w.weight").alias("w")).distinct()
    top = known.agg(F.max(F.array_max(F.transform("words", lambda w: w["weight"])))).first()[0] or 0.0
    fits = F.col("edits") <= bound(F.greatest(F.length("token"), F.length("near")))
    corrected = materialise(close.where(fits).join(broadcast_if_small(words), "near").groupBy("token").agg(F.max("w").alias("w"), F.collect_list("near").alias("nears")))
    looked = hot_key_join(materialise(values.select("value", F.explode("words").alias("token"))), corrected, "token")
    looked = looked.select("value", "token", "nears", F.coalesce("w", F.lit(top)).alias("w"))
    whole = Window.partitionBy("value")  # the words of one value
    lighter = whole.orderBy(F.col("w").desc(), "token").rowsBetween(0, Window.unboundedFollowing)
    return materialise(looked.select("value", "nears", F.sum("w").over(lighter).alias("rest"), F.sum("w").over(whole).alias("heft")))


def _by_words(weighed: DataFrame, known: DataFrame, least_score: float) -> DataFrame:
    """(value, token): names (their whole token) that share a corrected word with a value
    among those words of the value that can't all be missed at ``least_score``. A value
    that outweighs every name by too much can't reach it and asks for none."""
    heaviest = known.agg(F.max("weight")).first()[0] or 0.0
    kept = weighed.where((F.col("rest") >= F.col("heft") * least_score - 1e-9) & (F.col("heft") * least_score <= heaviest + 1e-9))
    postings = known.select("token", F.explode("words.word").alias("near")).distinct()
    return kept.where("nears is not null").select("value", F.explode("nears").alias("near")).join(broadcast_if_small(postings), "near").select("value", "token").distinct()


def repair_values(values: DataFrame, known: DataFrame, *, max_edits: int, part_of_length: float | None, least_score: float | None, only_edits: bool = False) -> DataFrame:
    """(value, entry_id) for each distinct value of ``values`` (value, tokens: its letters
    in one, in each way to read them) that stands for an entry of ``known``; see
    ``match_values``."""

    def bound(length: Column) -> Column:
        return edit_bound(length, max_edits, part_of_length)

    def word_bound(length: Column) -> Column:  # short words would stand for any others
        return edit_bound(length, max_edits, PART_OF_LENGTH if part_of_length is None else part_of_length)

    values = materialise(values.select("value", "tokens", _words(F.col("value")).alias("said")))
    names, tokens = known.select(F.col("token").alias("near")), F.col("tokens")
    if least_score is not None:
        names, tokens = names.unionByName(known.select(F.explode("words.word").alias("near"))), F.array_union("tokens", "said")
    close = near_tokens(values.select(F.explode(tokens).alias("token")), materialise(names.distinct()), max_edits)
    fits = F.col("edits") <= bound(F.greatest(F.length("token"), F.length("near")))
    met = values.select("value", F.explode("tokens").alias("token")).join(close.where(fits), "token").select("value", F.col("near").alias("token"))
    heft = values.select("value", F.lit(0.0).alias("heft"))
    if least_score is not None:
        weighed = _weighed_words(values.select("value", F.col("said").alias("words")), close, known, word_bound)
        met = met.unionByName(_by_words(weighed, known, least_score)).distinct()
        heft = weighed.select("value", "heft").distinct()
    joined = met.join(broadcast_if_small(known), "token").join(values, "value").join(heft, "value", "left")
    edits = F.array_min(F.transform("tokens", lambda t: F.when(F.levenshtein(t, F.col("token")) <= bound(F.greatest(F.length(t), F.length("token"))), F.levenshtein(t, F.col("token")))))
    score = soft_tfidf(F.col("words"), F.col("said"), word_bound) / F.greatest("weight", F.coalesce("heft", F.lit(0.0)), F.lit(1e-9))
    scored = joined.withColumn("edits", edits).withColumn("score", F.round(score, 9))
    reached = F.col("edits").isNotNull() if least_score is None or only_edits else F.col("edits").isNotNull() | (F.col("score") >= least_score)
    order = F.struct(F.coalesce("edits", F.lit(max_edits + 1)), -F.col("score"), F.col("rank"), F.col("entry_id"))
    return scored.where(reached).groupBy("value").agg(F.min_by("entry_id", order).alias("entry_id"))


def match_values(
    rows: DataFrame, id_column: str, value_column: str, entries: DataFrame, *, max_edits: int = MAX_EDITS, part_of_length: float | None = PART_OF_LENGTH, least_score: float | None = LEAST_SCORE, only_edits: bool = False
) -> DataFrame:
    """(id, value, entry_id): one row per row whose value isn't null, blank or equal to a
    name of rank 0; ``entry_id`` is null where the value stands for no entry.

    A value stands for an entry if its letters are within ``max_edits`` of a name's (and
    within ``part_of_length`` of the longer, unless None), or if its corrected words reach
    ``least_score`` (unless None): their soft TF-IDF over the weight of the name or of the
    value, whichever weighs more. Entries by letters go first, fewer edits before more;
    then the higher score, names before aliases, the smaller id. With ``only_edits`` what
    words lead to must be within the edits too.

    ``entries``: (entry_id, name, rank), rank 0 for names and 1 for aliases. Repeated rows
    are matched each. Values of any length are taken whole; those too long for every entry
    come out unmatched without being compared. An empty list of entries leaves all
    unmatched. Other columns are not read.
    """
    known = materialise(vocabulary(entries))
    exact_names = entries.where("rank = 0 and name is not null").select(F.col("name").alias("value")).distinct()
    typed = rows.select(F.col(id_column).alias("id"), F.col(value_column).alias("value"))
    typed = typed.where(F.coalesce(F.col("value"), F.lit("")).rlike(r"(?U)[^\s]"))
    typed = typed.join(broadcast_if_small(exact_names), "value", "left_anti")
    small = broadcast_if_small(known.groupBy("token").agg(F.min_by("entry_id", F.struct("rank", "entry_id")).alias("entry_id")))
    folded = typed.withColumn("token", compact_key(strip_material(F.col("value"))))
    direct = materialise(folded.join(small, "token", "left"))
    done = direct.where("entry_id is not null").select("id", "value", "entry_id")
    open_rows = direct.where("entry_id is null").select("id", "value", "token")
    # Also with the leading word, which may belong to the name.
    distinct_values = open_rows.select("value", "token").distinct().select("value", F.array_distinct(F.array("token", compact_key(F.col("value")))).alias("tokens"))
    repaired = repair_values(distinct_values, known, max_edits=max_edits, part_of_length=part_of_length, least_score=least_score, only_edits=only_edits)
    rest = hot_key_join(open_rows.select("id", "value"), materialise(repaired), "value")
    return done.unionByName(rest.select("id", "value", "entry_id"))


def grade_entries(grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names and aliases of the canonical list, of every status."""
    names = grades.select(F.col("grade_id").alias("entry_id"), F.col("canonical").alias("name"), F.lit(0).alias("rank"))
    others = aliases.select(F.col("canonical_grade_id").alias("entry_id"), F.col("alias").alias("name"), F.lit(1).alias("rank"))
    return names.unionByName(others).where("entry_id is not null")


def match_grades(offers: DataFrame, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(offer_id, grade_id) of offers whose grade is typed otherwise than a canonical name.
    By the statement a grade may have MAX_EDITS wrong characters whatever its length, and
    no more, so words in another order don't count."""
    typed = offers.select("offer_id", "grade").where(F.trim("grade") != UNKNOWN_GRADE)
    matched = match_values(typed, "offer_id", "grade", grade_entries(grades, aliases), part_of_length=None, only_edits=True)
    return matched.select(F.col("id").alias("offer_id"), F.coalesce("entry_id", F.lit(UNMATCHED)).alias("grade_id"))
