"""Offers that describe the same product in different words.

Each offer becomes a small set of normalised tokens: its profile, its grade and its
sizes in micrometres. Words that don't tell products apart (selling phrases, standards,
conditions) have weight 0 and are left out; the others weigh the more the rarer they are.

Offers with equal sets contain each other and are one node; the similarity join is over
the distinct sets. A set that lacks an attribute is looked for in the larger ones by its
prefix, the rarest tokens that it can't all miss at the wanted containment; candidates
must pass the length filter (they may not weigh so much more that the lacking set would
cover too little of them) and the positional filter (what follows the first common token
must be enough on both sides), and containment by weight is then verified exactly. Star
clustering makes every set that lacks nothing a centre; a lacking set becomes a satellite
of the centre it covers most, or, where there is none, a centre of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.extract import MICROMETRES, read_product
from sortament.functions.text import compact_key, strip_material
from sortament.llm.canonical_values import MAX_EDITS, UNKNOWN_GRADE, grade_entries, repair_values, vocabulary
from sortament.operators.joins import broadcast_if_small, hot_key_join, measured
from sortament.operators.split_fields import CHUNK, split_texts
from sortament.session import materialise, ship_package

#: This part of a set's weight must be in the set that contains it: all of it, as one
#: other size or grade makes another product.
CONTAINMENT = 1.0
#: A satellite states at least this part of its centre's weight.
LEAST_COVER = 0.5
#: Different tokens whose frequencies are broadcast at most.
MOST_TOKENS = 500_000
#: Pairs of members of a star are formed in blocks of about so many members a side.
BLOCK = 1_000

# Fixed value: profiles that say there is none.
NO_PROFILE = ("НЕ УКАЗАН", "НЕ ОПРЕДЕЛЁН")

_PARSED = "id bigint, profile string, designation string, typed string, sizes array<bigint>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads each text once; what it doesn't state comes from the columns."""
    for whole in batches:
        size = pc.fill_null(pc.cast(pc.binary_length(whole.column("text")), pa.int64()), 0).to_numpy()
        part = np.cumsum(size) // CHUNK
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            batch = whole.slice(a, b - a)
            packed = set(split_texts(batch.column("text"))[0].to_pylist())
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "text", "profile", "typed", "sizes")), strict=True)
            out = []
            for i, (key, text, profile, typed, sizes) in enumerate(rows):
                if i not in packed:
                    own, designation, stated = read_product(text) if text else (None, None, [])
                    out.append((key, own or profile, designation, None if designation else typed, stated if len(stated) > 1 or len(stated) >= len(sizes or ()) else sizes))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
            columns = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["id", "profile", "designation", "typed", "sizes"])


def _column_sizes() -> Column:
    """Sizes in micrometres as the columns have them; the unit is that of the first."""
    unit = F.lower(F.trim("dim1_unit"))
    scale = F.lit(1000.0)
    for name, factor in MICROMETRES.items():
        scale = F.when(unit == name, factor).otherwise(scale)
    values = [F.col("dim1").cast("double") * scale, F.col("dim2").cast("double") * 1000, F.col("dim3").cast("double") * 1000]
    return F.filter(F.array(*[F.round(v).cast("long") for v in values]), lambda v: v.isNotNull())


def product_tokens(offers: DataFrame, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, tokens, complete): what each offer of one position says its product is, from
    its text and, where that is silent, its columns.

    Tokens are the profile, the grade (the id of the canonical entry, an alias being its
    grade, or the folded designation of a grade outside the list) and the sizes in order.
    An offer is complete with a profile, a grade and a size: products may be sold by one
    size, so fewer sizes make another product and are no missing attribute.
    """
    ship_package(offers.sparkSession)
    profile = F.upper(F.trim("profile"))
    given = offers.where(F.col("offer_id").isNotNull()).select(
        F.col("offer_id").cast("long").alias("id"),
        F.col("raw_description").alias("text"),
        F.when((profile != "") & ~profile.isin(*NO_PROFILE), profile).alias("profile"),
        F.when((F.trim("grade") != "") & (F.trim("grade") != UNKNOWN_GRADE), F.col("grade")).alias("typed"),
        _column_sizes().alias("sizes"),
    )
    read = given.mapInArrow(_parse, _PARSED)
    token = F.coalesce(compact_key(F.col("designation")), compact_key(strip_material(F.col("typed"))))
    known = materialise(vocabulary(grade_entries(grades, aliases)))
    by_token = known.groupBy("token").agg(F.min_by("entry_id", F.struct("rank", "entry_id")).alias("entry"))
    looked = materialise(read.withColumn("token", token).join(broadcast_if_small(by_token), "token", "left"))
    # A designation in a text is as it is; typed ones may have wrong characters.
    doubtful = F.col("entry").isNull() & F.col("typed").isNotNull()
    values = looked.where(doubtful).select("typed", "token").distinct().select(F.col("typed").alias("value"), F.array("token").alias("tokens"))
    repaired = materialise(repair_values(values, known, max_edits=MAX_EDITS, part_of_length=None, least_score=None).toDF("typed", "repaired"))
    mended = hot_key_join(looked.where(doubtful), repaired, "typed").withColumn("entry", F.col("repaired")).select(*looked.columns)
    whole = looked.where(~doubtful).unionByName(mended)
    grade = F.coalesce(F.concat(F.lit("g="), "entry"), F.concat(F.lit("n="), "token"))
    sizes = F.transform("sizes", lambda v, i: F.concat((i + 1).cast("string"), F.lit("="), v.cast("string")))
    tokens = F.concat(F.filter(F.array(F.concat(F.lit("p="), "profile"), grade), lambda t: t.isNotNull()), sizes)
    complete = F.col("profile").isNotNull() & grade.isNotNull() & (F.size("sizes") >= 1)
    return whole.select("id", tokens.alias("tokens"), F.coalesce(complete, F.lit(False)).alias("complete"))


def _node(tokens: Column) -> Column:
    """A set of tokens in one string, equal for equal sets."""
    return F.array_join(F.array_sort(F.array_distinct(tokens)), "\n")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(node, number, complete, first, members, tokens, weights, weight): the distinct
    token sets of ``rows`` (id, tokens, complete), each with a number of its own, its
    smallest id and the number of its rows. ``tokens`` begins with the rarest; ``weights``
    go with it and ``weight`` is their sum. A written table.

    A token's frequency counts the rows that have it, combined before they are shuffled.
    Rows are combined to sets by one shuffle; while the frequencies are small enough to be
    broadcast, they are looked up and put in order where the set is, without another."""
    stated = rows.where(F.size("tokens") > 0)
    counts = materialise(stated.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    total = stated.count()
    rarity = counts.select("token", "n", F.round(F.log1p(F.lit(float(total)) / F.col("n")), 6).alias("w"))
    sets = stated.select("id", "complete", _node(F.col("tokens")).alias("node")).groupBy("node").agg(F.max("complete").alias("complete"), F.min("id").alias("first"), F.count(F.lit(1)).alias("members"))
    each = sets.select("*", F.explode(F.split("node", "\n")).alias("token"))
    if measured(counts, MOST_TOKENS)[0] <= MOST_TOKENS:
        looked = each.join(F.broadcast(rarity), "token")
    else:
        looked = hot_key_join(materialise(each), rarity, "token")
    ranked = looked.groupBy("node", "complete", "first", "members").agg(F.array_sort(F.collect_list(F.struct("n", "token", "w"))).alias("r"))  # the tokens of one set
    weights = F.col("r.w")
    whole = F.round(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w), 6)
    return materialise(ranked.select("node", F.monotonically_increasing_id().alias("number"), "complete", "first", "members", F.col("r.token").alias("tokens"), weights.alias("weights"), whole.alias("weight")))


def containments(lacking: DataFrame, wholes: DataFrame, containment: float = CONTAINMENT, least_cover: float = LEAST_COVER) -> DataFrame:
    """(node, centre, contained, cover): every pair of a set of ``lacking`` and a set of
    ``wholes`` (as ``distinct_sets`` has them) of which the first has at least
    ``containment`` of its weight in the second and so covers at least ``least_cover`` of
    the second's weight. Exact: the filters only leave out what can't reach both."""

    def rest(weights: Column) -> Column:  # the weight from each place on
        return F.transform(weights, lambda w, i: F.aggregate(F.slice(weights, i + 1, F.size(weights)), F.lit(0.0), lambda a, x: a + x))

    slack = 1e-5
    probe = lacking.select(F.col("node"), F.col("tokens").alias("a_tokens"), F.col("weights").alias("a_weights"), F.col("weight").alias("a_weight"), F.posexplode(F.arrays_zip(F.col("tokens").alias("token"), rest(F.col("weights")).alias("rest"))).alias("i", "t"))
    # Without the tokens so far less than the wanted weight is left: one of them must be shared.
    probe = probe.where(F.col("t.rest") > (1 - containment) * F.col("a_weight") + (slack if containment < 1 else -slack))
    if containment >= 1:
        probe = probe.where("i = 0")  # all tokens must be shared, so the rarest alone is the prefix
    probe = probe.select("node", "a_tokens", "a_weights", "a_weight", F.col("t.token").alias("token"), F.col("t.rest").alias("a_rest"))
    index = wholes.select(F.col("node").alias("centre"), F.col("tokens").alias("b_tokens"), F.col("weight").alias("b_weight"), F.explode(F.arrays_zip(F.col("tokens").alias("token"), rest(F.col("weights")).alias("rest"))).alias("t"))
    index = index.select("centre", "b_tokens", "b_weight", F.col("t.token").alias("token"), F.col("t.rest").alias("b_rest"))
    wanted = F.col("a_weight") * containment - slack
    long_enough = (F.col("b_weight") >= wanted) & (F.col("a_weight") >= F.col("b_weight") * least_cover - slack)
    # Either the token is the first that both share, or another row of the pair has it.
    first = F.get(F.filter("a_tokens", lambda t: F.array_contains("b_tokens", t)), F.lit(0)) == F.col("token")
    placed = F.least("a_rest", "b_rest") >= wanted
    met = index.join(broadcast_if_small(probe), "token").where(long_enough & placed & first & (F.col("node") != F.col("centre")))
    shared = F.aggregate(F.arrays_zip("a_tokens", "a_weights"), F.lit(0.0), lambda a, x: a + F.when(F.array_contains("b_tokens", x["a_tokens"]), x["a_weights"]).otherwise(0.0))
    found = met.withColumn("shared", shared).where((F.col("shared") >= wanted) & (F.col("shared") >= F.col("b_weight") * least_cover - slack))
    ratio = [F.round(F.col("shared") / F.col(w), 6) for w in ("a_weight", "b_weight")]
    return found.select("node", "centre", ratio[0].alias("contained"), ratio[1].alias("cover"))


def star_clusters(sets: DataFrame, containment: float = CONTAINMENT, least_cover: float = LEAST_COVER) -> DataFrame:
    """(node, star, told, n): the star of each distinct set, by its centre's number, and
    how many rows the star has. Sets that lack nothing are centres; a lacking one goes to
    the centre of which it states most, of several equal ones the first by its tokens,
    else it is a centre itself. ``told``: whether the centre says which product it is."""
    lacking = materialise(sets.where("not complete"))
    if lacking.isEmpty():
        return sets.select("node", F.col("number").alias("star"), F.lit(True).alias("told"), F.col("members").alias("n"))
    met = containments(lacking, sets.where("complete"), containment, least_cover)
    best = met.groupBy("node").agg(F.min_by("centre", F.struct(-F.col("cover"), -F.col("contained"), F.col("centre"))).alias("centre"))
    numbered = best.join(sets.select(F.col("node").alias("centre"), F.col("number").alias("star")), "centre").select("node", "star")
    joined = materialise(sets.join(numbered, "node", "left").select("node", F.coalesce("star", "number").alias("star"), (F.col("star").isNotNull() | F.col("complete")).alias("told"), "members"))
    whole = joined.groupBy("star").agg(F.sum("members").alias("n"))
    return joined.join(whole, "star").select("node", "star", "told", "n")


def product_members(offers: DataFrame, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, star, n): the star of every offer of one position whose product can be told,
    and how many rows the star has at most."""
    rows = materialise(product_tokens(offers, grades, aliases).where(F.size("tokens") > 0))
    stars = star_clusters(distinct_sets(rows)).where("told").select("node", "star", "n")
    keyed = rows.select("id", _node(F.col("tokens")).alias("node"))
    return hot_key_join(keyed, stars, "node").where("star is not null").select("id", "star", "n")


def product_pairs(offers: DataFrame, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(offer_id_a, offer_id_b), smaller id first: every pair of offers of one star.

    Offers of several positions, without id, or whose product can't be told (no profile,
    grade or size, and no centre that contains what they state) belong to no pair. Text wins
    over columns where both state an attribute. Repeated rows of one id are one offer;
    different rows of one id may put it into several products. Null, empty and very long
    texts are read like any other; other columns are not read. The pairs of a large star
    are formed in blocks, so that no task gets all of them.
    """
    several = materialise(product_members(offers, grades, aliases).where("n > 1").distinct())
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    a = several.select(F.col("id").alias("offer_id_a"), "star", block.alias("block"))
    b = several.select(F.col("id").alias("offer_id_b"), "star", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return a.join(b, ["star", "block"]).where("offer_id_a < offer_id_b").select("offer_id_a", "offer_id_b").distinct()


def product_groups(offers: DataFrame, grades: DataFrame, aliases: DataFrame) -> DataFrame:
    """(offer_id, group_id, links): one row per offer with an id; ``group_id`` is the
    smallest offer of its star and ``links`` the number of other offers in it. Offers of
    several positions and those whose product can't be told are groups of their own, with
    no link. An offer whose rows differ is in the star with the smallest ``group_id``.
    Linear in the number of offers however large a group is."""
    members = materialise(product_members(offers, grades, aliases).select("id", "star").distinct())
    stars = materialise(members.groupBy("star").agg(F.min("id").alias("group_id"), (F.count(F.lit(1)) - 1).alias("links")))
    grouped = hot_key_join(members, stars, "star").groupBy("id").agg(F.min(F.struct("group_id", "links")).alias("g"))
    ids = offers.where(F.col("offer_id").isNotNull()).select(F.col("offer_id").cast("long").alias("id")).distinct()
    joined = ids.join(grouped, "id", "left")
    return joined.select(F.col("id").alias("offer_id"), F.coalesce("g.group_id", "id").alias("group_id"), F.coalesce("g.links", F.lit(0).cast("long")).alias("links"))
