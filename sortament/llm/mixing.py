"""Mixing sources to target shares of the total size in tokens.

Every document gets its size in tokens, the posterior of each domain from a classifier
trained on labelled documents, and a rate: how often it is expected to be used. Rates
minimise the squared distance between the domains' expected token totals and their
targets, with 0 <= rate <= the document's cap, by projected gradient steps. Documents of
one membership and cap move alike, so the steps run over those kinds with their tokens;
labelled documents make one kind a domain. A step is one sum per domain inside the JVM; a
kind's rate is folded from the few residuals so far, so nothing is written between steps.

With ``labels`` a labelled document belongs to its source for certain: its membership is
its label, and the classifier's posterior stands in where the source is null. The statement
wants shares by source, which posteriors of labelled documents blur; without ``labels`` all
memberships are posteriors.

Rates become whole copies by a threshold on a hash of the id, set per source from a
histogram of all documents, so that the total comes as near to the target as documents of
whole size allow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortament.operators.joins import broadcast_if_small
from sortament.session import materialise, ship_package

#: Vocabulary of a public tokenizer: lines of base64 token and rank.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how that tokenizer cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Labelled documents a source, in expectation, on which the classifier is fitted.
SAMPLE_PER_SOURCE = 300
#: Tokens are hashed to so many features.
FEATURES = 2048
MAX_STEPS = 50
#: Steps end when no domain's residual moves by more than this part of the total.
SETTLED = 1e-9
_STEPS_OF_HASH = 1 << 16

_encoders: dict[str, object] = {}


def _encoder(name: str):
    """This process's tokenizer, from the file Spark handed out."""
    if name not in _encoders:
        import tiktoken

        lines = Path(SparkFiles.get(name)).read_bytes().splitlines()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def _token_counts(ids: list[int]) -> np.ndarray:
    return np.bincount(np.asarray(ids, np.int64) % FEATURES, minlength=FEATURES)


def _inputs(counts: np.ndarray) -> np.ndarray:
    """Features of unit length; the last is constant."""
    x = np.sqrt(counts.astype(np.float32))
    x /= np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)
    return np.concatenate([x, np.ones((*x.shape[:-1], 1), np.float32)], axis=-1)


@dataclass(frozen=True)
class DomainClassifier:
    """Softmax regression on hashed tokens. ``weights``: (FEATURES + 1, domains)."""

    domains: tuple[str, ...]
    weights: np.ndarray

    def posteriors(self, counts: np.ndarray) -> np.ndarray:
        z = _inputs(counts) @ self.weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _fit(counts: np.ndarray, labels: np.ndarray, domains: tuple[str, ...], steps: int = 150, rate: float = 8.0, decay: float = 1e-4) -> DomainClassifier:
    x, n = _inputs(counts), len(labels)
    wanted = np.eye(len(domains), dtype=np.float32)[labels]
    weights = np.zeros((x.shape[1], len(domains)), np.float32)
    for _ in range(steps if n else 0):  # without a sample every domain is as likely
        z = x @ weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        weights -= rate * (x.T @ (p - wanted) / n + decay * weights)
    return DomainClassifier(domains, weights)


def _ship_vocabulary(docs: DataFrame, vocabulary: str) -> str:
    ship_package(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(vocabulary)
    return Path(vocabulary).name


def _sampled(labelled: DataFrame, per_source: int) -> Column:
    """Whether a document's hash puts it into the sample of its source."""
    sizes = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a domain
    part = F.lit(0.0)
    for source, n in sizes.items():
        part = F.when(F.col("source") == source, min(1.0, per_source / n)).otherwise(part)
    return F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_003)) < part * 1_000_003


def fit_domains(docs: DataFrame, domains: tuple[str, ...], *, per_source: int = SAMPLE_PER_SOURCE, vocabulary: str = VOCABULARY) -> DomainClassifier:
    """A classifier fitted on a sample of ``per_source`` labelled documents of each
    domain in expectation, chosen by a hash of the id; fewer where there are fewer. The
    driver gets the sample's hashed token counts, a bounded amount."""
    name = _ship_vocabulary(docs, vocabulary)
    labelled = docs.where(F.col("source").isin(*domains) & F.col("text").isNotNull())
    chosen = labelled.where(_sampled(labelled, per_source))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_token_counts(ids) for ids in _encoder(name).encode_ordinary_batch(batch.column("text").to_pylist(), num_threads=1)]
            nonzero = [np.flatnonzero(r) for r in rows]
            arrays = [batch.column("source"), pa.array(nonzero, pa.list_(pa.int64())), pa.array([r[k] for r, k in zip(rows, nonzero, strict=True)], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["source", "at", "n"])

    sample = chosen.select("source", "text").mapInArrow(count, "source string, at array<bigint>, n array<bigint>").collect()
    counts = np.zeros((len(sample), FEATURES), np.float32)
    for i, row in enumerate(sample):
        counts[i, row["at"]] = row["n"]
    return _fit(counts, np.array([domains.index(r["source"]) for r in sample], int), domains)


def measure(docs: DataFrame, classifier: DomainClassifier, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens, posterior): size and domain posteriors of every document,
    in the order of ``classifier.domains``; a null text has no tokens."""
    name = _ship_vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = _encoder(name).encode_ordinary_batch([t or "" for t in part.column("text").to_pylist()], num_threads=1)
                found = classifier.posteriors(np.stack([_token_counts(x) for x in ids])).astype(float)
                n, k = found.shape
                posterior = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(found.ravel()))
                arrays = [part.column("doc_id"), part.column("source"), pa.array([len(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, posterior], ["doc_id", "source", "tokens", "posterior"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    return chosen.mapInArrow(run, "doc_id bigint, source string, tokens bigint, posterior array<double>")


def held_out_accuracy(docs: DataFrame, domains: tuple[str, ...], *, per_source: int = SAMPLE_PER_SOURCE, vocabulary: str = VOCABULARY) -> tuple[float, int]:
    """(accuracy, documents): how often the likeliest domain is the source, over the
    labelled documents that the classifier wasn't fitted on."""
    classifier = fit_domains(docs, domains, per_source=per_source, vocabulary=vocabulary)
    labelled = docs.where(F.col("source").isin(*domains) & F.col("text").isNotNull())
    others = labelled.where(~_sampled(labelled, per_source))
    names = F.array(*[F.lit(d) for d in domains])
    likeliest = F.get(names, F.array_position("posterior", F.array_max("posterior")).cast("int") - 1)
    row = measure(others, classifier, vocabulary=vocabulary).agg(F.avg((likeliest == F.col("source")).cast("double")), F.count(F.lit(1))).first()
    return row[0] or 0.0, row[1]


def _rate(history: list[list[float]]) -> Column:
    """The rate of a (member, cap) after the steps of ``history``: each moves it against its
    domains' residuals (as a part of the domain's size) and projects it into [0, cap]."""

    def step(rate: Column, residual: Column) -> Column:
        slope = F.aggregate(F.zip_with("member", residual, lambda m, r: m * r), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), F.least("cap", rate - slope))

    start = F.least(F.lit(1.0), F.col("cap"))
    if not history:
        return start
    return F.aggregate(F.array(*[F.array(*[F.lit(float(x)) for x in h]) for h in history]), start, step)


@dataclass(frozen=True)
class Mixture:
    """``documents``: (doc_id, domain, tokens, cap, rate, copies), one row per document.
    ``domains``, ``targets``: the wanted shares. ``total``: tokens of the corpus."""

    documents: DataFrame
    domains: tuple[str, ...]
    targets: tuple[float, ...]
    total: int


def mix(docs: DataFrame, targets: DataFrame, *, vocabulary: str = VOCABULARY, classifier: DomainClassifier | None = None, labels: bool = True) -> Mixture:
    """The mixture of ``docs`` (doc_id, source, text) that takes ``targets`` (source,
    target_share, max_repeats) of the corpus's size in tokens.

    A source that can't reach its share at ``max_repeats`` is used that often and falls
    short. Documents of a source without target are not used; those without source are
    by their posteriors, capped by their likeliest domain. ``labels``: see above. Null texts and ids are not
    used. A repeated row is a document of its own. Empty documents or targets give no
    copies. Targets are a handful of rows and are collected.
    """
    wanted = sorted((r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.where("source is not null and target_share is not null").collect())
    domains, shares = tuple(w[0] for w in wanted), tuple(w[1] for w in wanted)
    spark = docs.sparkSession
    if not domains:
        return Mixture(spark.createDataFrame([], "doc_id bigint, domain string, tokens bigint, cap double, rate double, copies bigint"), (), (), 0)
    classifier = classifier or fit_domains(docs, domains, vocabulary=vocabulary)
    measured = materialise(measure(docs.where("doc_id is not null"), classifier, vocabulary=vocabulary))
    k = len(domains)
    names, caps = F.array(*[F.lit(d) for d in domains]), F.array(*[F.lit(float(w[2])) for w in wanted])
    own = F.array_position(names, F.col("source"))
    label = F.array(*[F.when(own == i + 1, 1.0).otherwise(0.0) for i in range(k)])
    member = F.when(F.col("source").isNull(), F.col("posterior")).otherwise(label) if labels else F.col("posterior")
    likeliest = F.array_position("member", F.array_max("member"))
    sized = measured.withColumn("member", member).withColumn("at", F.when(F.col("source").isNull(), likeliest).otherwise(own).cast("int"))
    sized = sized.select("doc_id", "tokens", "member", F.when(F.col("at") > 0, F.get(names, F.col("at") - 1)).alias("domain"), F.coalesce(F.get(caps, F.col("at") - 1), F.lit(0.0)).alias("cap"))
    sized = materialise(sized.withColumn("cap", F.when(F.col("tokens") > 0, F.col("cap")).otherwise(0.0)))

    kinds = materialise(sized.where("cap > 0").groupBy("member", "cap").agg(F.sum("tokens").alias("tokens")))

    def sums(rate: Column) -> np.ndarray:
        row = kinds.agg(*[F.sum(F.col("tokens") * rate * F.get("member", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
        return np.array([x or 0.0 for x in row])

    total = measured.agg(F.sum("tokens")).first()[0] or 0
    sizes = np.maximum(sums(F.lit(1.0)), 1.0)
    goal = np.array(shares) * total
    history: list[list[float]] = []
    before = None
    for _ in range(MAX_STEPS):
        reached = sums(_rate(history))
        if before is not None and np.abs(reached - before).max() <= SETTLED * max(total, 1):
            break
        before = reached
        history.append(((reached - goal) / sizes).tolist())
    return Mixture(_copies(sized.withColumn("rate", _rate(history)), goal, domains), domains, shares, total)


def _copies(rated: DataFrame, goal: np.ndarray, domains: tuple[str, ...]) -> DataFrame:
    """Whole copies: the whole part of the rate, and one more for the documents of each
    domain whose hash, as a part of the rest of the rate, is below the domain's threshold."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(_STEPS_OF_HASH)) + 0.5) / _STEPS_OF_HASH
    rest = F.round(F.col("rate") - F.floor("rate"), 9)
    rated = rated.withColumn("place", F.when(rest > 0, F.least(F.floor(u / rest * _STEPS_OF_HASH / 2), F.lit(2 * _STEPS_OF_HASH))))
    rated = rated.withColumn("base", F.floor("rate").cast("long"))
    grid = rated.where("domain is not null").groupBy("domain", "place").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("base")).alias("b"), F.sum(F.col("tokens") * F.col("rate")).alias("r"))
    sums = grid.groupBy("domain").agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
    order = Window.partitionBy("domain").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 * _STEPS_OF_HASH rows a domain
    cumulated = grid.where("place is not null").select("domain", "place", F.sum("t").over(order).alias("upto"))
    gap = cumulated.join(F.broadcast(sums), "domain").withColumn("off", F.abs(F.col("upto") + F.col("b") - F.col("r")))
    threshold = gap.groupBy("domain").agg(F.min_by("place", F.struct("off", "place")).alias("threshold"), F.min("off").alias("off"))
    # Taking none may be nearer than taking the first.
    none = sums.join(threshold, "domain", "left").select("domain", F.when(F.col("off") <= F.abs(F.col("b") - F.col("r")), F.col("threshold")).otherwise(-1).alias("threshold"))
    chosen = rated.join(F.broadcast(none), "domain", "left")  # one row a domain
    more = F.coalesce((F.col("place") <= F.col("threshold")).cast("long"), F.lit(0).cast("long"))
    copies = F.least(F.col("base") + more, F.col("cap").cast("long"))
    return chosen.select("doc_id", "domain", "tokens", "cap", "rate", copies.alias("copies"))


def mixture_report(mixture: Mixture) -> DataFrame:
    """(source, target_share, reached_share, expected_share, documents, used_documents,
    corpus_tokens, used_tokens, most_copies), one row a target; shares are of the corpus."""
    spark = mixture.documents.sparkSession
    wanted = spark.createDataFrame(list(zip(mixture.domains, mixture.targets, strict=True)), "source string, target_share double")
    got = mixture.documents.where("domain is not null").groupBy(F.col("domain").alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("copies") > 0).alias("used_documents"), F.sum("tokens").alias("corpus_tokens"),
        F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum(F.col("tokens") * F.col("rate")).alias("expected"), F.max("copies").alias("most_copies"),
    )
    total = F.lit(float(max(mixture.total, 1)))
    joined = wanted.join(broadcast_if_small(got), "source", "left")
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("documents", "used_documents", "corpus_tokens", "used_tokens", "most_copies")]
    return joined.select(
        "source", "target_share", F.round(F.coalesce("used_tokens", zero) / total, 9).alias("reached_share"), F.round(F.coalesce("expected", F.lit(0.0)) / total, 9).alias("expected_share"), *counts
    )


def mixture_copies(mixture: Mixture) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents used."""
    return mixture.documents.where("copies > 0").select("doc_id", F.col("domain").alias("source"), "tokens", "copies")
