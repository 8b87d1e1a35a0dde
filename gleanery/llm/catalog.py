"""The thin queries over the driver's tables, with their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from gleanery.llm import ann, decontaminate, jaccard, lang_id, language_model, licenses, line_dedup, packing, personal_data, prefix_trie, secrets, simhash, whitening

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
for _module in (secrets, licenses, line_dedup, decontaminate, ann, jaccard, language_model, packing, personal_data, lang_id, prefix_trie, simhash, whitening):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(getattr(_module, "ORACLES", {}))
