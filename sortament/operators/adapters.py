"""Price lists of a known layout: which columns of which rows hold what.

A layout is data; one projection over the cells serves all of them. The layout of a file
is told by its name or by phrases in its first rows; files of no known layout are left to
header detection, and sheets where that finds none to the reading of bare rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.functions.profiles import is_service_line
from sortament.operators.cells import detect_headers, extract_rows

RAW_FIELDS = ("description", "availability", "price", "grade_hint")


@dataclass(frozen=True)
class Comment:
    """A column that goes into the comments under a label; ``skip_zero`` leaves out 0."""

    label: str
    column: int
    unit: str = ""
    skip_zero: bool = False


@dataclass(frozen=True)
class Layout:
    """``blocks``: name and column of each field of each block side by side. A row of a
    block counts if it has a description and a filled column of ``needs``, which must be
    numbers if ``numeric``. ``instead``: an availability to take, with its label, where
    that of the block is missing or 0."""

    name: str
    file_names: tuple[str, ...]
    phrases: tuple[str, ...]
    first_row: int
    blocks: tuple[tuple[str, dict[str, int]], ...]
    needs: tuple[str, ...] = ("availability", "price")
    numeric: bool = False
    unit: str | None = None
    instead: Comment | None = None
    comments: tuple[Comment, ...] = field(default=())


# The known layouts; columns count from 0 and rows from 1.
LAYOUTS = (
    Layout("BETA", ("supplier_beta",), ("остатки и резервы товаров", "свободный остаток"), 1, (("", {"description": 1, "availability": 4, "stock": 2, "reserved": 3}),), needs=("availability", "stock", "reserved"), numeric=True, unit="кг", comments=(Comment("Остаток", 2, " кг"), Comment("Зарезервировано", 3, " кг", True))),
    Layout("ALPHA", ("supplier_alpha",), ("астор", "наименование"), 6, (("левый блок", {"description": 0, "availability": 1, "price": 2}), ("правый блок", {"description": 4, "availability": 5, "price": 6}))),
    Layout("GAMMA", ("supplier_gamma",), ("supplier gamma", "сплав"), 9, (("", {"description": 2, "availability": 3, "grade_hint": 1, "production": 5}),), needs=("grade_hint", "availability", "production"), unit="кг", instead=Comment("В производстве", 5, " кг", True), comments=(Comment("Дополнительное количество", 4), Comment("Срок поставки", 6), Comment("Склад", 0))),
)
SAMPLE_ROWS = 10


def layouts_of(cells: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(file, layout): the first layout whose file name or phrases fit, else GENERIC."""
    sample = cells.where((F.col("sheet_ix") == 0) & (F.col("row_no") <= SAMPLE_ROWS))

    def has(phrase: str) -> Column:
        return F.coalesce(F.exists("cells", lambda c: F.coalesce(F.contains(F.lower(c["v"]), F.lit(phrase)), F.lit(False))), F.lit(False))

    found = {f"p{i}_{j}": F.max(has(w)) for i, x in enumerate(layouts) for j, w in enumerate(x.phrases)}
    seen = sample.groupBy("file").agg(*[c.alias(n) for n, c in found.items()]) if found else sample.select("file").distinct()
    files = cells.select("file").distinct().join(seen, "file", "left")
    kind = F.lit("GENERIC")
    for i, x in reversed(list(enumerate(layouts))):
        by_name = reduce(Column.__or__, [F.contains(F.lower("file"), F.lit(n)) for n in x.file_names], F.lit(False))
        by_phrase = reduce(Column.__and__, [F.coalesce(F.col(f"p{i}_{j}"), F.lit(False)) for j in range(len(x.phrases))], F.lit(bool(x.phrases)))
        kind = F.when(by_name | by_phrase, x.name).otherwise(kind)
    return files.select("file", kind.alias("layout"))


def _text(column: int) -> Column:
    value = F.trim(F.get(F.col("cells"), F.lit(column))["v"])
    return F.when(value != "", value)


def _is_number(column: int) -> Column:
    return F.coalesce(F.get(F.col("cells"), F.lit(column))["is_num"], F.lit(False))


def _comment(c: Comment) -> Column:
    zero = F.coalesce(_text(c.column).try_cast("double") == 0, F.lit(False))
    shown = _text(c.column).isNotNull() & (~zero if c.skip_zero else F.lit(True))
    return F.when(shown, F.concat(F.lit(f"{c.label}: "), _text(c.column), F.lit(c.unit)))


def read_layout(cells: DataFrame, layout: Layout) -> DataFrame:
    """(file, sheet, row_no, block, description, availability, price, grade_hint, unit,
    comments) of the first sheet's rows."""
    rows = cells.where((F.col("sheet_ix") == 0) & (F.col("row_no") >= layout.first_row))
    structs = []
    for name, columns in layout.blocks:
        needed = [columns[n] for n in layout.needs if n in columns]
        filled = reduce(Column.__or__, [_is_number(c) if layout.numeric else _text(c).isNotNull() for c in needed])
        availability = _text(columns["availability"])
        if layout.instead is not None:
            other = _comment(layout.instead)
            lacking = availability.isNull() | F.coalesce(availability.try_cast("double") == 0, F.lit(False))
            availability = F.when(lacking & other.isNotNull(), other).otherwise(availability)
        values = {f: _text(columns[f]) if f in columns else F.lit(None).cast("string") for f in RAW_FIELDS} | {"availability": availability}
        comments = F.array_compact(F.array(*[_comment(c) for c in layout.comments])) if layout.comments else F.array().cast("array<string>")
        structs.append(F.struct(F.lit(name).alias("block"), filled.alias("filled"), *[values[f].alias(f) for f in RAW_FIELDS], comments.alias("comments")))
    flat = rows.select("file", "sheet", "row_no", F.inline(F.array(*structs)))
    goods = flat.where(F.col("filled") & F.col("description").isNotNull() & ~is_service_line(F.col("description"), F.col("filled")) & ~F.upper("description").isin("ИТОГО", "ВСЕГО"))
    return goods.select("file", "sheet", "row_no", "block", *RAW_FIELDS, F.lit(layout.unit).alias("unit"), "comments")


def read_bare_rows(cells: DataFrame) -> DataFrame:
    """Rows of sheets without header: the longest text of four letters or more (the first
    of equal ones) is the description, the first number the availability, and the last of
    two or more the price."""
    texts = F.filter("cells", lambda c: ~c["is_num"] & (F.length(F.trim(c["v"])) >= 4) & ~c["v"].rlike(r"^\s*[\d\s.,]+\s*$"))
    numbers = F.filter("cells", lambda c: c["is_num"] | F.coalesce(c["v"].rlike(r"^\s*\d[\d\s.,]*(?:кг|т|шт|м|руб|₽)?\.?\s*$"), F.lit(False)))
    longest = F.array_max(F.transform(texts, lambda c, i: F.struct(F.length(F.trim(c["v"])).alias("n"), (-i).alias("i"), F.trim(c["v"]).alias("v"))))["v"]
    price = F.when(F.size(numbers) >= 2, F.get(numbers, F.size(numbers) - 1)["v"])
    found = cells.select("file", "sheet", "row_no", longest.alias("description"), F.get(numbers, F.lit(0))["v"].alias("availability"), price.alias("price"))
    return found.where(F.col("description").isNotNull() & ~is_service_line(F.col("description"), F.col("availability").isNotNull()))


def read_price_lists(cells: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(layout, file, sheet, row_no, description, availability, price, grade_hint) of all
    files, each by its layout, its headers, or as bare rows."""
    told = cells.join(layouts_of(cells, layouts), "file")
    parts = []
    columns = ["layout", "file", "sheet", "row_no", *RAW_FIELDS]
    for x in layouts:
        parts.append(read_layout(told.where(F.col("layout") == x.name), x).withColumn("layout", F.lit(x.name)).select(*columns))
    generic = told.where("layout = 'GENERIC'").drop("layout")
    parts.append(extract_rows(generic).withColumn("layout", F.lit("HEADER")).select(*columns))
    bare = generic.join(detect_headers(generic).select("file").distinct(), "file", "left_anti")
    parts.append(read_bare_rows(bare).withColumn("grade_hint", F.lit(None).cast("string")).withColumn("layout", F.lit("BARE")).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def file_counters(cells: DataFrame, items: DataFrame) -> DataFrame:
    """(file, rows, items, layouts) of every file: rows with a filled cell, items read from
    it by ``read_price_lists``, and by which layouts."""
    filled = F.exists("cells", lambda c: F.coalesce(F.trim(c["v"]) != "", F.lit(False)))
    seen = cells.groupBy("file").agg(F.count_if(filled).alias("rows"))
    read = items.groupBy("file").agg(F.count(F.lit(1)).alias("items"), F.array_sort(F.collect_set("layout")).alias("layouts"))  # a few layouts
    joined = seen.join(read, "file", "left")
    return joined.select("file", "rows", F.coalesce("items", F.lit(0).cast("long")).alias("items"), F.coalesce("layouts", F.array().cast("array<string>")).alias("layouts"))


def snapshot(cells: DataFrame) -> DataFrame:
    """``cells`` with ``by_header``: the row's values by the name of their column in the
    sheet's header; unnamed columns are COL_n, repeated names get their number."""
    heads = detect_headers(cells).select("file", "sheet_ix", F.col("row_no").alias("header_row"))
    names = cells.join(heads, ["file", "sheet_ix"]).where("row_no = header_row").select("file", "sheet_ix", "header_row", F.transform("cells", lambda c: F.trim(c["v"])).alias("names"))
    body = cells.join(names, ["file", "sheet_ix"]).where("row_no > header_row")
    plain = F.transform(F.slice("names", F.lit(1), F.size("cells")), lambda n, i: F.when(F.coalesce(n, F.lit("")) == "", F.concat(F.lit("COL_"), (i + 1).cast("string"))).otherwise(n))
    padded = F.concat(plain, F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("cells"), F.lit(1))), lambda i: i > F.size(plain)), lambda i: F.concat(F.lit("COL_"), i.cast("string"))))
    keyed = body.withColumn("_keys", padded)
    unique = F.transform("_keys", lambda n, i: F.when(F.size(F.filter(F.slice("_keys", F.lit(1), i), lambda m: m == n)) > 0, F.concat(n, F.lit(" ["), (F.size(F.filter(F.slice("_keys", F.lit(1), i), lambda m: m == n)) + 1).cast("string"), F.lit("]"))).otherwise(n))
    return keyed.withColumn("by_header", F.map_from_arrays(unique, F.transform("cells", lambda c: c["v"]))).drop("_keys", "names", "header_row")
