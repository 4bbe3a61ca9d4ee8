"""Fields that hold several values: one row per value, with its place in the field.

The work is done on whole Arrow string buffers: every code point of a batch is one
element of an array, quote parity and delimiters are masks over it, the places where
values begin give child offsets, and the values become a list array that is flattened
with the ordinals of its parents. No Python code runs per row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sortament.functions.profiles import FORM_STEMS
from sortament.functions.text import CYRILLIC_TWINS, LATIN_TWINS
from sortament.session import ship_package

# Signs that may stand between two values.
DELIMITERS = "|/+;•,\t\n\r"
SPACES = " \u00a0\u202f\u2009"

#: Code points worked on at once; bounds the memory of a Python worker, whatever the length of a text.
CHUNK = 2_000_000


@dataclass(frozen=True)
class Format:
    """How fields are packed: the delimiters, and how a value begins."""

    delimiters: str = DELIMITERS
    starts: tuple[str, ...] = tuple(FORM_STEMS)


@lru_cache(maxsize=8)
def _tables(form: Format) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Lookup by code point: is a delimiter, is a space, folded letter; and folded starts."""
    fold = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        low = chr(i).lower()
        if len(low) == 1:
            fold[i] = ord(low)
    for a, b in zip(LATIN_TWINS.lower(), CYRILLIC_TWINS.lower(), strict=True):
        fold[ord(a)] = fold[ord(a.upper())] = ord(b)
    is_delimiter, is_space = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
    is_delimiter[[ord(c) for c in form.delimiters]] = True
    is_space[[ord(c) for c in SPACES]] = True
    starts = [fold[np.frombuffer(s.encode("utf-32-le"), np.uint32)] for s in form.starts]
    return is_delimiter, is_space, fold, starts


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (null as empty) in one array, and each text's begin and end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, begun[offsets - offsets[0]]


def _strings(points: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The inverse: string array of consecutive pieces."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width)])[bounds].astype(np.int64)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(byte_at.tobytes()), pa.py_buffer(data))


def _last_before(mask: np.ndarray) -> np.ndarray:
    """Index of the last true element before each element, else -1."""
    at = np.where(mask, np.arange(len(mask)), -1)
    return np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(mask) else at


def _next_after(mask: np.ndarray) -> np.ndarray:
    """Index of the first true element after each element, else the length."""
    n = len(mask)
    at = np.where(mask, np.arange(n), n)
    return np.concatenate([np.minimum.accumulate(at[::-1])[::-1][1:], [n]]) if n else at


def _inside_quotes(points, row, begin, end, is_delimiter, is_space) -> np.ndarray:
    """Mask of what stands inside an enclosing pair of ``"``.

    A quote opens where only a delimiter or the beginning is before it and closes where
    only a delimiter or the end follows; doubled quotes are text and an inch sign in the
    middle of a value is neither. A quote that never closes is text.
    """
    n = len(points)
    inside = np.zeros(n, bool)
    quote = points == ord('"')
    if not quote.any():
        return inside
    at = np.flatnonzero(quote)
    new_run = np.concatenate([[True], (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])])
    first, last = at[new_run], at[np.concatenate([np.flatnonzero(new_run)[1:] - 1, [len(at) - 1]])]
    odd = ((last - first + 1) % 2) == 1
    first, last = first[odd], last[odd]
    if not len(first):
        return inside
    filled = ~is_space
    before, after = _last_before(filled)[first], _next_after(filled)[last]
    opens = (before < begin[row[first]]) | is_delimiter[before]
    closes = (after >= end[row[last]]) | is_delimiter[np.minimum(after, n - 1)]
    rows = row[first]
    while True:
        state = _states(rows, opens, closes)
        final = np.concatenate([rows[1:] != rows[:-1], [True]])
        unclosed = np.isin(rows, rows[final & state])
        if not unclosed.any():
            break
        index = np.arange(len(rows))
        last_open = np.full(int(rows.max()) + 1, -1)
        turned_on = opens & state & unclosed
        last_open[rows[turned_on]] = index[turned_on]
        drop = last_open[np.unique(rows[unclosed])]
        opens[drop], closes[drop] = False, False
    change = np.zeros(n + 1, np.int64)
    previous = np.concatenate([[False], state[:-1]]) & np.concatenate([[False], rows[1:] == rows[:-1]])
    on, off = state & ~previous, ~state & previous
    change[first[on]] += 1
    change[last[off]] -= 1
    return np.cumsum(change[:n]) > 0


def _states(rows: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Whether each mark leaves its row inside quotes: opening marks set, closing marks
    reset, marks that may be either toggle, others change nothing; rows begin outside."""
    n = len(rows)
    index = np.arange(n)
    row_first = np.concatenate([[True], rows[1:] != rows[:-1]])
    sets, toggles = opens ^ closes, opens & closes
    anchor = np.maximum.accumulate(np.where(sets | row_first, index, 0))
    flips = np.cumsum(toggles)
    base = np.where(sets[anchor], opens[anchor], False)
    since = flips - np.where(toggles[anchor] & ~sets[anchor], flips[anchor] - 1, flips[anchor])
    return base ^ (since % 2 == 1)


def split_texts(texts: pa.Array, form: Format | None = None) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent ordinals, positions from 1, values) of the texts that hold two or more values."""
    form = form or Format()
    delimiter_of, space_of, fold, starts = _tables(form)
    points, bounds = _code_points(texts)
    n = len(points)
    nothing = pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.large_string())
    if not n:
        return nothing
    begin, end = bounds[:-1], bounds[1:]
    row = np.repeat(np.arange(len(begin)), end - begin)
    low = np.minimum(points, 0xFFFF)
    delimiter, space = delimiter_of[low], space_of[low]
    inside = _inside_quotes(points, row, begin, end, delimiter, space)
    cut = delimiter & ~inside
    gap = cut | (space & ~inside)
    # A piece begins at the first filled place after a delimiter or the beginning.
    filled_before, cut_before = _last_before(~gap), _last_before(cut)
    piece = np.flatnonzero(~gap & ((filled_before < begin[row]) | (cut_before > filled_before)))
    quoted = points[piece] == ord('"')
    word = np.where(quoted, _next_after(~space)[piece], piece)
    folded = fold[low]
    named = np.zeros(len(piece), bool)
    for s in starts:
        fits = word + len(s) <= end[row[piece]]
        where = np.flatnonzero(fits & ~named)
        same = np.ones(len(where), bool)
        for k, letter in enumerate(s):
            same &= folded[word[where] + k] == letter
        named[where[same]] = True
    first = piece[named]
    many = np.bincount(row[first], minlength=len(begin)) >= 2
    first = first[many[row[first]]]
    if not len(first):
        return nothing
    parent = row[first]
    last_of_row = np.concatenate([parent[1:] != parent[:-1], [True]])
    stop = np.where(last_of_row, end[parent], np.concatenate([first[1:], [0]]))
    stop = np.maximum.accumulate(np.where(~gap, np.arange(n), -1))[stop - 1] + 1  # without outer delimiters and spaces
    # Enclosing quotes: inside from the first place up to the last but one.
    outside = np.concatenate([[0], np.cumsum(~inside)])
    enclosed = (points[first] == ord('"')) & (points[stop - 1] == ord('"')) & (stop - first >= 2) & (outside[stop - 1] == outside[first])
    from_, to = first + enclosed, stop - enclosed
    filled = np.maximum.accumulate(np.where(~space, np.arange(n), -1))
    from_ = np.where(enclosed & space[np.minimum(from_, n - 1)], np.minimum(_next_after(~space)[np.minimum(from_, n - 1)], to), from_)
    to = np.maximum(np.where(enclosed, filled[np.maximum(to - 1, 0)] + 1, to), from_)
    # Gather the values; of doubled quotes in an enclosed value the second is left out.
    length = to - from_
    child = np.repeat(np.arange(len(from_)), length)
    source = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + from_[child]
    quote = points == ord('"')
    run_begin = _last_before(~quote)
    second = quote & ((np.arange(n) - run_begin) % 2 == 0)
    # The enclosing quote may touch a run of doubled ones.
    shift = enclosed & (run_begin[from_] + 1 < from_)
    extra = second[source] ^ (shift[child] & quote[source] & (run_begin[source] + 1 < from_[child]))
    keep = ~(enclosed[child] & quote[source] & extra)
    kept = np.concatenate([[0], np.cumsum(keep)])
    values = _strings(points[source[keep]], kept[np.concatenate([[0], np.cumsum(length)])])
    # Values as lists of their parents, flattened with the parents' ordinals.
    child_offsets = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=len(begin)))])
    lists = pa.LargeListArray.from_arrays(pa.array(child_offsets), values)
    ordinals = pc.list_parent_indices(lists)
    position = np.arange(len(first)) - child_offsets[ordinals.to_numpy()] + 1
    return ordinals, pa.array(position), pc.list_flatten(lists)


def _chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most CHUNK bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(size) // CHUNK
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def split_field(df: DataFrame, keys: list[str], text: str, form: Format | None = None, value: str = "item_text") -> DataFrame:
    """(keys..., pos long, ``value`` string): one row per value of each field that holds
    two or more.

    A value begins, after the beginning or a delimiter outside quotes, with one of
    ``form.starts`` (whatever the case, look-alike letters as one). Words before the
    first value belong to none. What stands in ``"..."`` around a whole value belongs to
    it; those quotes go and doubled ones inside become single. Null, empty and single
    values give no row; repeated rows are split each. Columns besides ``keys`` and
    ``text`` are not read, so their names can't clash. No shuffle.
    """
    form = form or Format()
    chosen = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(text).alias("text"))
    chosen = chosen.where(F.col("text").isNotNull())
    kinds = [chosen.schema[f"k{i}"].dataType.simpleString() for i in range(len(keys))]
    schema = ", ".join([*(f"k{i} {t}" for i, t in enumerate(kinds)), "pos bigint", "value string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, "text"):
                parent, position, values = split_texts(part.column("text"), form)
                if not len(parent):
                    continue
                columns = [part.column(f"k{i}").take(parent) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, position, values.cast(pa.string())], [*(f"k{i}" for i in range(len(keys))), "pos", "value"])

    ship_package(df.sparkSession)
    split = chosen.mapInArrow(run, schema)
    return split.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "pos", F.col("value").alias(value))


def split_positions(offers: DataFrame, raw_items: DataFrame, form: Format | None = None) -> DataFrame:
    """(src, row_id, pos, item_text) of the fields of both tables that hold several positions."""
    a = split_field(offers.select(F.col("offer_id").alias("row_id"), "raw_description"), ["row_id"], "raw_description", form)
    b = split_field(raw_items.select(F.col("item_id").alias("row_id"), "description"), ["row_id"], "description", form)
    named = [part.select(F.lit(src).alias("src"), "row_id", "pos", "item_text") for src, part in (("offers", a), ("raw_items", b))]
    return named[0].unionByName(named[1])
