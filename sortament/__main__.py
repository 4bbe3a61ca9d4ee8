"""python -m sortament COMMAND: the engine's operators from the command line.

query NAME FOLDER [OUT]   run a registered query; print its first rows or write Parquet
search TEXT FOLDER        free-text search over the offers of a folder
import FOLDER STORE       import a report bundle
cells FOLDER OUT          workbooks of a folder as raw rows, JSON lines
export FOLDER PATH        the offers of a folder as a workbook
"""

from __future__ import annotations

import sys

from sortament.operators.adapters import read_price_lists
from sortament.operators.bundles import import_bundle
from sortament.operators.search_mask import inventory_of, mask_search, ranked, read_mask
from sortament.plans import registry
from sortament.session import build_session
from sortament.sources.exports import export_offers
from sortament.sources.jsonl import write_jsonl
from sortament.sources.xlsx import read_cells
from sortament.tables import read_table


def main(args: list[str]) -> int:
    """0: done; 2: the call isn't one of the above."""
    match args:
        case ["query", name, folder, *out] if name in registry.queries() and len(out) <= 1:
            found = registry.queries()[name](build_session(), folder)
            found.write.parquet(out[0]) if out else found.show(50, truncate=False)
        case ["search", text, folder]:
            offers = read_table(build_session(), folder, "offers")
            hits = ranked(mask_search(offers, read_mask(text, inventory_of(offers))), "supplier", "offer_id")
            hits.select("match_type", "size_delta", "offer_id", "supplier", "profile", "grade", "dim1", "dim2", "dim3", "price_rub_kg").show(50, truncate=False)
        case ["import", folder, store]:
            print(import_bundle(build_session(), folder, store))
        case ["cells", folder, out]:
            write_jsonl(read_price_lists(read_cells(build_session(), folder)), out)
        case ["export", folder, path]:
            export_offers(read_table(build_session(), folder, "offers"), path)
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
