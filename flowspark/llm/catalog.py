"""Imports every operator module, which fills the registry."""

from flowspark.llm import (  # noqa: F401
    arrow_tokens, codes, decontaminate, forest, jaccard, langid, licences, lines, packing, pii, resample, sharding, substrings,
)
from flowspark.llm.registry import ORACLES, QUERIES  # noqa: F401
