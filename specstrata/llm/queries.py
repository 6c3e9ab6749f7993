"""Queries of the text problems and their SQL."""

from __future__ import annotations

from specstrata.llm import lookalikes, mixing, packing

QUERIES = {
    "p7_containers": packing.p7_containers, "p7_fill": packing.p7_fill,
    "p8_mixture": mixing.p8_mixture, "p8_shares": mixing.p8_shares,
    "p9_found": lookalikes.p9_found, "p9_classes": lookalikes.p9_classes, "p9_forms": lookalikes.p9_forms,
}

ORACLE: dict[str, str] = {}
