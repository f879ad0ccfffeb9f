"""The corpus queries and their SQL, by name."""

from . import decontaminate, licenses, linededup, mainhtml, packing, quality, sharding, simhash, topk, toxicity

MODULES = [linededup, simhash, topk, toxicity, licenses, sharding, mainhtml, packing, quality, decontaminate]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLES.items()}
