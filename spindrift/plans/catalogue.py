"""All queries of the package, their groups and their SQL."""

from __future__ import annotations

from . import address_queries, dataset_queries, detail_queries, encode_queries, fidelity_queries, model_queries, sampling_queries, score_queries, stream_queries, traffic_queries
from .registry import Registry, Task

GROUPS = {"address": address_queries, "dataset": dataset_queries, "detail": detail_queries, "encode": encode_queries, "fidelity": fidelity_queries, "model": model_queries, "sampling": sampling_queries, "score": score_queries, "stream": stream_queries, "traffic": traffic_queries}


def registry() -> Registry:
    return Registry([Task(n, g, f, m.SQL.get(n)) for g, m in GROUPS.items() for n, f in m.QUERIES.items()])
