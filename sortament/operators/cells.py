"""Price lists as grids of cells: finding the header, filling down, extracting rows.

``cells`` are (file, sheet, sheet_ix, row_no, cells array<struct<v,is_num>>).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sortament.functions.profiles import is_service_line, plain_profile_word
from sortament.functions.size_text import looks_like_size, looks_like_size_expression
from sortament.functions.text import squeeze_space

# Words by which a column is recognised, in the order in which fields are tried.
HEADER_WORDS = {
    "description": ("наименование", "номенклатура", "товар", "продукция", "позиция", "названия"),
    "grade_hint": ("марка", "сплав", "материал"),
    "profile": ("вид проката", "профиль", "форма проката", "тип проката"),
    "dim_primary": ("диаметр", "диамер", "толщина", "толшина", "размер 1"),
    "dimensions": ("размеры мм", "размеры", "габарит", "длина", "раскрой", "размер"),
    "availability": ("наличие", "в наличии", "остаток", "вес", "количество", "кол-во", "свободный"),
    "price": ("цена", "стоимость", "руб/кг", "руб./кг"),
}
# How a price's heading says what it includes.
WITH_VAT = ("с ндс", "включая ндс", "ндс включ", "с учетом ндс", "с учётом ндс")
WITHOUT_VAT = ("без ндс",)
# What lines of conditions between goods say.
CONDITIONS = ("срок поставки", "минимальн", "по всем вопросам", "по все вапросам", "следующие марки", "обращайтес", "обрашайтес")
# Notes on which price was taken.
PRICE_NOTES = {"both": "Из двух цен выбрана цена с НДС", "with": "Цена указана с НДС", "unknown": "Статус НДС в заголовке цены не определён", "without": "Доступна только цена без НДС"}
SCANNED_ROWS = 500
LEAST_SCORE = 2


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _fields(value: Column) -> Column:
    """The fields that a heading may name, in the order in which they are tried. A price
    that says what it includes is a field of its own and no plain price."""
    low = F.lower(squeeze_space(value))
    price = _holds(low, HEADER_WORDS["price"])
    priced = F.when(price & _holds(low, WITHOUT_VAT), "price_no_vat").when(price & _holds(low, WITH_VAT), "price_vat")
    named = [F.when(_holds(low, words), F.lit(f)) for f, words in HEADER_WORDS.items() if f != "price"]
    return F.array_compact(F.array(priced, *named, F.when(price & priced.isNull(), "price")))


def header_mapping(cells: Column) -> Column:
    """map<field, column> of a row read as a header: from left to right each cell gets the
    first field it names that no cell before it has."""
    named = F.transform(cells, lambda c, i: F.struct(i.alias("column"), _fields(c["v"]).alias("fields")))
    entry = "array<struct<field:string,column:int>>"

    def take(taken: Column, cell: Column) -> Column:
        free = F.filter(cell["fields"], lambda f: ~F.exists(taken, lambda t: t["field"] == f))
        return F.when(F.size(free) > 0, F.concat(taken, F.array(F.struct(F.get(free, F.lit(0)).alias("field"), cell["column"].alias("column"))))).otherwise(taken)

    return F.map_from_entries(F.aggregate(F.filter(named, lambda c: F.size(c["fields"]) > 0), F.array().cast(entry), take))


def detect_headers(cells: DataFrame) -> DataFrame:
    """(file, sheet, sheet_ix, row_no, mapping map<field, column>): each sheet's header,
    the row among its first SCANNED_ROWS that names most fields (a description counts
    twice, the first of equal rows wins), if it names a description."""
    scanned = cells.where(F.col("row_no") <= SCANNED_ROWS).select("file", "sheet", "sheet_ix", "row_no", header_mapping(F.col("cells")).alias("mapping"))
    has_description = F.map_contains_key("mapping", F.lit("description"))
    scored = scanned.where(F.size("mapping") > 0).withColumn("score", F.size("mapping") + has_description.cast("int"))
    best = scored.groupBy("file", "sheet", "sheet_ix").agg(F.max_by(F.struct("row_no", "mapping", "score"), F.struct("score", -F.col("row_no"))).alias("h"))
    good = best.where((F.col("h.score") >= LEAST_SCORE) & F.map_contains_key("h.mapping", F.lit("description")))
    return good.select("file", "sheet", "sheet_ix", "h.row_no", "h.mapping")


def carry_mappings(sheets: DataFrame, headers: DataFrame) -> DataFrame:
    """``sheets`` (file, sheet, sheet_ix) with ``own``, the mapping of their header in
    ``header_row`` (null without), ``before``, the last one proved on an earlier sheet of
    the file, and ``mapping``, the first of both."""
    joined = sheets.join(headers.select("file", "sheet_ix", F.col("row_no").alias("header_row"), F.col("mapping").alias("own")), ["file", "sheet_ix"], "left")
    order = Window.partitionBy("file").orderBy("sheet_ix")  # the sheets of a file
    before = F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn("before", before).withColumn("mapping", F.coalesce("own", "before"))


def fill_down(rows: DataFrame, value: str, group: list[str], order: str) -> DataFrame:
    """``rows`` with blanks of ``value`` filled from the last row of the group that has one."""
    known = F.when(F.trim(F.col(value)) != "", F.col(value))
    return rows.withColumn(value, F.last(known, ignorenulls=True).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def _cell(field: str) -> Column:
    """The row's value of a mapped field, null where it is blank."""
    text = squeeze_space(F.get(F.col("cells"), F.try_element_at("mapping", F.lit(field)))["v"])
    return F.when(text != "", text)


def extract_rows(cells: DataFrame, supplier: Column | None = None) -> DataFrame:
    """Raw items of all sheets with a mapping: (supplier, description, availability, price,
    grade_hint, profile_hint, size_primary, size_secondary, availability_unit, comments,
    file, sheet, row_no).

    Rows below a sheet's header are read by it, rows above and sheets without by the last
    mapping of an earlier sheet. A price with VAT wins over one that doesn't say, and that
    over one without; a comment says which was taken. Where a size stands in the column of
    the profile, the columns are shifted: it becomes the first size, the profile is what
    the name says, and the first size's own value is kept as a condition. A blank name is
    filled down where the row has a profile, size, amount or price. Lines of conditions,
    totals and headings are left out. The description is profile, name and sizes together.
    """
    sheets = cells.select("file", "sheet", "sheet_ix").distinct()
    mapped = carry_mappings(sheets, detect_headers(cells)).where("mapping is not null")
    kg = F.lower(F.get(F.col("cells"), F.try_element_at("own", F.lit("availability")))["v"]).contains("кг")
    headings = cells.join(mapped.select("file", "sheet_ix", "own", F.col("header_row").alias("row_no")), ["file", "sheet_ix", "row_no"]).select("file", "sheet_ix", kg.alias("in_kg"))
    body = cells.join(mapped.drop("sheet", "mapping"), ["file", "sheet_ix"])
    above = F.col("header_row").isNotNull() & (F.col("row_no") < F.col("header_row"))
    body = body.where(F.col("header_row").isNull() | (F.col("row_no") != F.col("header_row"))).withColumn("mapping", F.when(above | F.col("header_row").isNull(), F.col("before")).otherwise(F.col("own")))
    body = body.where("mapping is not null").join(headings, ["file", "sheet_ix"], "left")

    vat, plain, net = _cell("price_vat"), _cell("price"), _cell("price_no_vat")
    taken = F.when(vat.isNotNull(), F.when(net.isNotNull(), PRICE_NOTES["both"]).otherwise(PRICE_NOTES["with"])).when(plain.isNotNull(), PRICE_NOTES["unknown"]).when(net.isNotNull(), PRICE_NOTES["without"])
    read = body.select(
        "file", "sheet", "sheet_ix", "row_no", "cells", _cell("description").alias("name"), _cell("profile").alias("profile"), _cell("dim_primary").alias("first"), _cell("dimensions").alias("second"),
        _cell("availability").alias("availability"), F.coalesce(vat, plain, net).alias("price"), taken.alias("price_note"), _cell("grade_hint").alias("grade_hint"),
        F.when(F.coalesce(~above & F.col("in_kg"), F.lit(False)), "кг").alias("availability_unit"),
    )
    shifted = F.coalesce(looks_like_size(F.col("profile")), F.lit(False))
    condition = F.when(shifted & F.col("first").isNotNull() & ~looks_like_size(F.col("first")), F.concat(F.lit("Обнаружено смещение колонок; значение «"), "first", F.lit("» сохранено как дополнительное условие")))
    fifth = squeeze_space(F.get("cells", F.lit(4))["v"])
    read = read.withColumn("shifted", shifted).withColumn("shift_note", condition)
    read = read.withColumn("first", F.when(F.col("shifted"), F.col("profile")).otherwise(F.col("first")))
    read = read.withColumn("profile", F.when(F.col("shifted"), plain_profile_word(F.col("name"))).otherwise(F.col("profile")))
    read = read.withColumn("availability", F.when(F.col("shifted") & F.col("availability").isNull() & (fifth != ""), fifth).otherwise(F.col("availability")))
    read = read.withColumn("second", F.when(F.col("shifted") & ~F.coalesce(looks_like_size_expression(F.col("second")), F.lit(False)), None).otherwise(F.col("second")))

    evidence = F.coalesce("profile", "first", "second", "availability", "price").isNotNull()
    filled = read.withColumn("last_name", F.last("name", ignorenulls=True).over(Window.partitionBy("file", "sheet_ix").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)))
    filled = filled.withColumn("name", F.coalesce("name", F.when(evidence, F.col("last_name")))).where("name is not null")
    bare = F.coalesce("first", "second", "availability", "price").isNull()
    conditions = bare & _holds(F.lower(F.concat_ws(" ", "name", "profile")), CONDITIONS)
    description = F.concat_ws(" ", "profile", "name", "first", "second")
    goods = filled.where(~conditions & ~is_service_line(description, ~bare))
    outer = F.regexp_extract("name", r"^\s*([A-Za-zА-Яа-яЁё]+\s*-?\s*\d+[A-Za-zА-Яа-яЁё0-9-]*)\s*\(", 1)
    comments = F.array_compact(
        F.array(
            F.col("price_note"), F.col("shift_note"), F.concat(F.lit("Исходный вид проката: "), "profile"),
            F.when(F.coalesce("first", "second").isNotNull(), "Размеры взяты из отдельных колонок поставщика"),
            F.when(outer != "", F.concat(F.lit("Исходное обозначение поставщика: "), squeeze_space(outer))),
        )
    )
    stem = F.regexp_replace(F.translate(F.regexp_extract("file", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1), "_", " "), r"\s+", " ")
    named = supplier if supplier is not None else F.when(F.trim(stem) == "", "Неизвестный поставщик").otherwise(F.trim(stem))
    return goods.select(
        named.alias("supplier"), description.alias("description"), "availability", "price", "grade_hint", F.col("profile").alias("profile_hint"),
        F.col("first").alias("size_primary"), F.col("second").alias("size_secondary"), "availability_unit", comments.alias("comments"), "file", "sheet", "row_no",
    )


def stack_blocks(rows: DataFrame, blocks: list[list[str]], names: list[str]) -> DataFrame:
    """Side-by-side blocks of columns under each other: one scan, no union."""
    structs = [F.struct(F.lit(i).alias("block"), *[F.col(c).alias(n) for c, n in zip(b, names, strict=True)]) for i, b in enumerate(blocks)]
    rest = [c for c in rows.columns if c not in {x for b in blocks for x in b}]
    return rows.select(*rest, F.inline(F.array(*structs)))
