"""Operations for preparing training data. Nothing outside this subpackage imports it."""

from themeloom.llm import (  # noqa: F401
    ann,
    collocations,
    conversation_trie,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    token_counts,
    topk,
    toxicity,
    url_filter,
    warc,
)
from themeloom.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
