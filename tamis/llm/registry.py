"""Queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from tamis.llm import centroids, curriculum, decontaminate, exact_dedup, html_extract, language_id, minhash, periodic_runs, pii, pipeline, substring_dedup, suffix_dedup, token_counts, url_filter


def queries() -> dict:
    return {
        "op1_html_extract": html_extract.query,
        "op2_url_filter": url_filter.query,
        "op3_pii": pii.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_language_id": language_id.query,
        "op8_minhash": minhash.query,
        "op9_decontaminate": decontaminate.query,
        "op10_curriculum_mix": curriculum.query,
        "op11_centroids": centroids.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_token_counts": token_counts.query,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op2_url_filter": url_filter.SQL, "op4_exact_dedup": exact_dedup.SQL, "op5_suffix_dedup": suffix_dedup.SQL, "op6_substring_dedup": substring_dedup.SQL, "op8_minhash": minhash.SQL, "op10_curriculum_mix": curriculum.SQL, "op11_centroids": centroids.SQL, "pipeline": pipeline.ORACLE_SQL}
    return {name: text for name, text in sql.items() if text}
