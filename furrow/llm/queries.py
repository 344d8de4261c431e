"""Imports every query module of the package, which registers its queries."""

from furrow.llm import (  # noqa: F401
    chat_query,
    decontaminate_query,
    drift_query,
    fill_query,
    jaccard_query,
    langid_query,
    packing_query,
    pii_query,
    quality_query,
    site_query,
    suffix_query,
    token_files_query,
    toxicity_query,
)
