"""All queries of the shop-data operators and their SQL."""

from stitchyard.operators import access, board, catalog, cracks, documents, geometry, histogram, hues, images, inks, ledger, lettering, machine, palette, palettes, paper, pricing, prints, raster, regions, rules, runs, stitch, traces

FAMILIES = (board, catalog, histogram, hues, cracks, lettering, palettes, paper, runs, pricing, ledger, palette, raster, regions, stitch, geometry, rules, documents, machine, access, images, inks, prints, traces)


def queries() -> dict:
    return {f.__name__: f for m in FAMILIES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in FAMILIES for k, v in m.SQL.items()}
