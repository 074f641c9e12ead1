"""Queries of the training-text operators by name, and the SQL that checks them."""

from __future__ import annotations

from quire.llm import charset, formatting, language, leaks, lookalike, markup, names, oracles, packing


def queries() -> dict:
    return {
        "p1_found": charset.p1_found,
        "p1_restore": charset.p1_restore,
        "p4_found": lookalike.p4_found,
        "p4_unify": lookalike.p4_unify,
        "p4_shown": lookalike.p4_shown,
        "p5_found": markup.p5_found,
        "p5_kinds": markup.p5_kinds,
        "p5_clean": markup.p5_clean,
        "p6_found": names.p6_found,
        "p6_links": names.p6_links,
        "p7_found": formatting.p7_found,
        "p7_groups": formatting.p7_groups,
        "p8_pack": packing.p8_pack,
        "p8_fill": packing.p8_fill,
        "p9_found": leaks.p9_found,
        "p9_spans": leaks.p9_spans,
        "p9_clean": leaks.p9_clean,
        "p10_found": language.p10_found,
        "p10_languages": language.p10_languages,
        "p10_segments": language.p10_segments,
    }


def oracle_sql() -> dict:
    return dict(oracles.ORACLES)
