"""Result tables as workbooks. Rows come to the driver one partition at a time."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sortament.sources.xlsx import write_workbook

# Headings of the result tables and the columns they show.
OFFER_COLUMNS = {
    "Поставщик": "supplier", "Профиль": "profile", "Марка/код": "grade", "Размер 1": "dim1", "Единица размера 1": "dim1_unit", "Размер 2": "dim2", "Размер 3": "dim3",
    "Наличие": "availability", "Количество": "quantity_value", "Единица количества": "quantity_unit", "Цена": "price_rub_kg", "Комментарий": "comment_text", "Источник (файл/строка)": "source",
}
SEARCH_COLUMNS = {"Тип совпадения": "match_type", "Отклонение": "size_delta"} | OFFER_COLUMNS


def source_text() -> Column:
    """File, sheet, row and block of a row, for people; without a part that is missing."""
    return F.concat_ws(" / ", "source_file", "source_sheet", F.concat(F.lit("строка "), F.col("source_row").cast("string")), "source_block")


def _shown(value: object, heading: str) -> object:
    if value is None and heading == "Цена":
        return "?"
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    return value


def _rows(df: DataFrame, columns: dict[str, str]) -> Iterator[list[object]]:
    yield list(columns)
    for row in df.select(*columns.values()).toLocalIterator(prefetchPartitions=True):
        yield [_shown(v, heading) for heading, v in zip(columns, row, strict=True)]


def _presented(offers: DataFrame) -> DataFrame:
    return offers.withColumn("source", source_text())


def export_offers(offers: DataFrame, path: str, *, search: DataFrame | None = None) -> None:
    """A workbook of all offers and, if given, a sheet of a search's hits. A missing price
    is shown as ``?``; prices and sizes are numbers, whole ones integers."""
    sheets = {"Предложения": _rows(_presented(offers), OFFER_COLUMNS)}
    if search is not None:
        sheets["Поиск"] = _rows(_presented(search), SEARCH_COLUMNS)
    write_workbook(path, sheets)
