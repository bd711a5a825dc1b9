"""Annotated matrices on PySpark: tables of row and feature metadata, and aligned matrices.

The names are imported when first used, so that workers load only what they run.
"""

from __future__ import annotations

import importlib

_PLACES = {
    "AggregateTask": "operators.tasks",
    "AggregationRun": "operators.tasks",
    "Dataset": "sources.dataset",
    "ExecutionReport": "operators.tasks",
    "MaterializeTask": "operators.tasks",
    "Matrix": "sources.matrix",
    "MultiModalAggregationRun": "operators.workflows",
    "NameRegistry": "functions.names",
    "PipelineStateValidator": "functions.names",
    "SampleInputRun": "operators.workflows",
    "StateError": "functions.names",
    "Store": "sources.store",
    "Task": "operators.tasks",
    "TaskRun": "operators.tasks",
    "View": "operators.view",
    "aggregate_many": "plans.shared_scan",
    "aggregate_modalities": "operators.workflows",
    "execute_tasks": "operators.materialize",
    "from_frames": "sources.dataset",
    "leave_one_out_pseudobulk": "operators.workflows",
    "prepare_communication_inputs": "operators.workflows",
    "read_matrix_market": "sources.matrix",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_PLACES[name]}"), name)
