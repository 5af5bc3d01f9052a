"""The subpackage's queries and SQL for the driver contract."""

from __future__ import annotations

from ebbline.llm import additive_ann, bpe, hilbert_shards, html_extract, jaccard_join, language_id, packing, quality, topk_pivot, url_filter


def queries() -> dict:
    return {
        "op1_topk_pivot": topk_pivot.query,
        "op2_url_redirect_filter": url_filter.query,
        "op3_html_site_tree": html_extract.query,
        "op4_mixture_packing": packing.query,
        "op5_hilbert_shards": hilbert_shards.query,
        "op6_language_id": language_id.query,
        "op7_jaccard_join": jaccard_join.query,
        "op8_quality": quality.query,
        "op9_additive_ann": additive_ann.query,
        "op10_prefix_bpe": bpe.query,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result and is quick on whole tables."""
    return {"op1_topk_pivot": topk_pivot.SQL, "op2_url_redirect_filter": url_filter.SQL}
