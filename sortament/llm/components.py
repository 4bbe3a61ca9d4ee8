"""Groups of records that are linked directly or through others.

Every vertex takes the smallest label among itself and its neighbours, pointer jumping
makes each label a root, the edges are rewritten onto the roots, and this repeats until
no edge joins two roots. The edges left at least halve in vertices each round, so the
rounds are logarithmic in the number of records. Each round's labels and edges are
checkpointed to the shared folder, so lost executors only cost their own tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.operators.joins import hot_key_join
from sortament.session import discard, materialise


def _minimum_labels(edges: DataFrame) -> DataFrame:
    """(v, p): the smallest smaller neighbour of each vertex that has one. ``edges`` are
    (a, b) with a < b. Minima are combined before the shuffle, so a vertex with a third
    of all edges sends one row from each task."""
    return edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))


def _jump(labels: DataFrame) -> DataFrame:
    """Pointer jumping: v's label becomes its label's label, until all are roots."""
    while True:
        up = labels.select(F.col("v").alias("p"), F.col("p").alias("q"))
        stepped = materialise(hot_key_join(labels, up, "p").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            discard(stepped)
            return labels
        discard(labels)
        labels = stepped.drop("moved")
        labels._sortament_path = stepped._sortament_path


def _rewrite(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges between roots, each once, without loops."""
    at = edges
    for end in ("a", "b"):
        root = labels.select(F.col("v").alias(end), F.col("p").alias("root"))
        at = hot_key_join(at if end == "a" else materialise(at), root, end).withColumn(end, F.coalesce("root", end)).drop("root")
    return at.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, source: str, target: str, *, id_name: str = "id", group_name: str = "group_id") -> DataFrame:
    """(``id_name``, ``group_name``): every id with at least one link, and the smallest id
    it is linked with directly or indirectly, itself included.

    A link counts both ways. Links with a null end or two equal ends don't count;
    repeated and reversed links count once. Empty input gives no rows. Other columns of
    ``links`` are not read. Ids compare as their type does (strings by bytes).
    """
    a, b = F.col(source), F.col(target)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = materialise(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    rounds: list[DataFrame] = []
    left = edges
    while not left.isEmpty():
        labels = _jump(materialise(_minimum_labels(left)))
        rounds.append(labels)
        fewer = materialise(_rewrite(left, labels))
        if left is not edges:
            discard(left)
        left = fewer
    final = None
    for labels in reversed(rounds):  # a root of one round may hook in a later one
        if final is None:
            final = labels
            continue
        later = final.select(F.col("v").alias("p"), F.col("p").alias("q"))
        earlier = hot_key_join(labels, later, "p").select("v", F.coalesce("q", "p").alias("p"))
        final = materialise(earlier.unionByName(final))
    if final is None:
        return vertices.select(F.col("v").alias(id_name), F.col("v").alias(group_name))
    grouped = vertices.join(final, "v", "left")  # one row a key on both sides
    return grouped.select(F.col("v").alias(id_name), F.coalesce("p", "v").alias(group_name))


def counted_link(relation: Column, status: Column) -> Column:
    """Whether a statement links its ends: EQUIVALENT whatever the case and outer spaces,
    and not REJECTED. A null relation doesn't; a null status does."""
    return F.coalesce(F.upper(F.regexp_replace(relation, r"(?U)^\s+|\s+$", "")) == "EQUIVALENT", F.lit(False)) & F.coalesce(status != "REJECTED", F.lit(True))


def grade_groups(equivalences: DataFrame) -> DataFrame:
    """(grade_id, group_id) over the counted links of ``equivalences``."""
    counted = equivalences.where(counted_link(F.col("relation_type"), F.col("status")))
    return connected_components(counted, "source_grade_id", "target_grade_id", id_name="grade_id")
