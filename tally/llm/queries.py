"""All queries of this package, by name."""

import corpus_pipeline  # noqa: F401
from tally.llm import (  # noqa: F401
    decontaminate,
    hard_negatives,
    jaccard_join,
    line_dedup,
    mixing,
    personal_data,
    quality_classifier,
    quality_rules,
    source_divergence,
    substring_dedup,
    suffix_tree_lm,
    token_files,
    toxicity,
)
from tally.llm.registry import ORACLES, QUERIES  # noqa: F401
