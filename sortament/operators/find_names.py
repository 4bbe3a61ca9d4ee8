"""Names of a catalogue inside free text, whatever separates their parts.

Texts become runs of words, as many as can be written in the characters of the longest
name, whose folded form is looked up by an equi-join; nothing is compared with every name, so the catalogue may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sortament.functions.text import compact_key, twin_fold
from sortament.operators.joins import broadcast_if_small


def find_names(rows: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, pos, words, name_id): the places of ``names`` (name_id, name) in each text,
    in words from 1; of overlapping places the longest, then the first, of equal names the
    smallest id. Parts of a name may be joined or apart; a name doesn't match inside a
    word. Null texts give no rows, repeated keys are read together."""
    known = names.select("name_id", compact_key(F.col("name")).alias("folded")).where("folded <> ''").groupBy("folded").agg(F.min("name_id").alias("name_id"))
    # A name may be written in as many words as it has characters, and no run may be longer than it.
    longest = known.agg(F.max(F.length("folded"))).first()[0] or 0
    words = F.filter(F.split(twin_fold(F.col(text)), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    cut = rows.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), words.alias("w"))
    places = F.flatten(
        F.transform(
            "w",
            lambda _, i: F.transform(
                F.filter(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.size("w") - i)), lambda n: F.length(F.array_join(F.slice("w", i + 1, n), "")) <= longest),
                lambda n: F.struct((i + 1).alias("pos"), n.alias("words"), F.array_join(F.slice("w", i + 1, n), "").alias("folded")),
            ),
        )
    )
    runs = cut.select("key", F.inline(places))
    met = runs.join(broadcast_if_small(known), "folded").select("key", "pos", "words", "name_id").distinct()
    # A match stays if none that is longer, or as long and before it, covers part of it.
    near = Window.partitionBy("key").orderBy("pos").rangeBetween(-longest, longest)  # a few places
    around = met.withColumn("others", F.collect_list(F.struct("pos", "words")).over(near))
    beaten = F.exists("others", lambda o: (o["pos"] < F.col("pos") + F.col("words")) & (F.col("pos") < o["pos"] + o["words"]) & ((o["words"] > F.col("words")) | ((o["words"] == F.col("words")) & (o["pos"] < F.col("pos")))))
    return around.where(~beaten).select(F.col("key").alias(key), F.col("pos").cast("long").alias("pos"), F.col("words").cast("long").alias("words"), "name_id")
