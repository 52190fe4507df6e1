"""What leaves the engine as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def facet_json(counts: DataFrame, hit_count: int) -> str:
    """{hit_count, facet_counts} as indented JSON. counts: facet, value, n; its size is that of the vocabulary in use."""
    out: dict[str, dict[str, int]] = {}
    for r in counts.orderBy("facet", "value").collect():
        out.setdefault(r.facet, {})[r.value] = r.n
    return json.dumps({"hit_count": hit_count, "facet_counts": out}, indent=2)


def snippet(store: str, predicate: str) -> str:
    """Code that opens the last entry of a consolidated store that a predicate selects."""
    return "\n".join((
        "import pandas as pd",
        "import xarray as xr",
        f"listing = pd.read_csv({store!r})",
        f"found = listing.query({predicate!r})",
        "data = xr.open_zarr(found.zstore.values[-1], consolidated=True)",
    ))


def markdown(query: str, hit_count: int, lines: str, link: str, with_files: bool = False) -> str:
    parts = [f"Found for {query!r}: {hit_count} datasets.", lines, f"[Search with these facets]({link})"]
    if with_files and hit_count:
        parts.append("File links are in the table of links.")
    return "\n\n".join(parts)
