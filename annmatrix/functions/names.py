"""Canonical names of analysis results, and what must exist before an analysis runs."""

from __future__ import annotations

import re
from collections.abc import Iterator

# Result names by operation and integration.
PLAIN_NAMES = {
    "pca": "X_pca",
    "neighbors": "neighbors",
    "connectivities": "connectivities",
    "distances": "distances",
    "umap": "X_umap",
    "tsne": "X_tsne",
    "leiden": "leiden",
    "louvain": "louvain",
    "rank_genes_groups": "rank_genes_groups",
    "diffmap": "X_diffmap",
    "draw_graph": "X_draw_graph_fa",
}
INTEGRATIONS = {
    "pca": ("harmony", "scanorama", "bbknn", "scvi"),
    "neighbors": ("harmony", "scanorama"),
    "connectivities": ("harmony", "scanorama"),
    "distances": ("harmony", "scanorama"),
    "umap": ("harmony", "scanorama"),
    "leiden": ("harmony",),
    "louvain": ("harmony",),
}
# The slots that an operation needs, with the pattern that a key must match.
GRAPH = r"(connectivities|distances).*"
PRECONDITIONS = {
    "pca": {"X": True},
    "neighbors": {"obsm": [r"X_pca.*"]},
    "umap": {"obsp": [GRAPH]},
    "tsne": {"obsm": [r"X_pca.*"]},
    "leiden": {"obsp": [GRAPH]},
    "louvain": {"obsp": [GRAPH]},
    "rank_genes_groups": {"obs_columns": [r"(leiden.*|louvain.*)"]},
    "diffmap": {"obsp": [GRAPH]},
}


class NameRegistry:
    """(operation, integration) to result name, and back."""

    _names: dict[tuple[str, str | None], str] = {(o, None): n for o, n in PLAIN_NAMES.items()} | {(o, i): f"{PLAIN_NAMES[o]}_{i}" for o, kinds in INTEGRATIONS.items() for i in kinds}

    @classmethod
    def get(cls, operation: str, integration: str | None = None) -> str:
        key = operation.lower(), integration.lower() if integration else None
        if key not in cls._names:
            raise KeyError(f"no name for operation {operation!r} with integration {integration!r}")
        return cls._names[key]

    @classmethod
    def lookup(cls, key: str) -> tuple[str, str | None] | None:
        return next((k for k, n in cls._names.items() if n == key), None)

    @classmethod
    def register(cls, operation: str, key: str, integration: str | None = None) -> None:
        """Adds a name for the whole process."""
        cls._names[operation.lower(), integration.lower() if integration else None] = key

    @classmethod
    def list_all(cls) -> dict[tuple[str, str | None], str]:
        return dict(cls._names)

    @classmethod
    def is_canonical(cls, key: str) -> bool:
        return cls.lookup(key) is not None


class StateError(Exception):
    """An operation's precondition isn't met."""

    def __init__(self, operation: str, missing: str, available: list[str]):
        self.operation, self.missing, self.available = operation, missing, list(available)
        super().__init__(f"{operation!r} needs {missing}; there is: {self.available}")


class PipelineStateValidator:
    """Checks PRECONDITIONS against a state with X_exists, obsm_keys, obsp_keys and obs_columns."""

    @staticmethod
    def get_preconditions(operation: str) -> dict:
        return PRECONDITIONS.get(operation.lower(), {})

    @staticmethod
    def list_operations() -> list[str]:
        return list(PRECONDITIONS)

    @classmethod
    def unmet(cls, operation: str, state: dict, groupby: str | None = None) -> Iterator[tuple[str, list[str]]]:
        """(what is wanted, what is there) of each condition that the state doesn't meet."""
        needs = cls.get_preconditions(operation)
        if needs.get("X") and not state.get("X_exists"):
            yield "a matrix X", []
        slots = {"obsm": state.get("obsm_keys"), "obsp": state.get("obsp_keys"), "obs_columns": state.get("obs_columns")}
        for slot, there in slots.items():
            there = list(there or ())
            candidates = [*there, groupby] if slot == "obs_columns" and groupby else there
            for pattern in needs.get(slot, ()):
                if not list(filter(re.compile(pattern).match, candidates)):
                    yield f"an entry of {slot} like {pattern}", there

    @classmethod
    def validate(cls, operation: str, state: dict, groupby: str | None = None) -> None:
        """Raises StateError for the first unmet condition; operations without conditions pass."""
        for wanted, there in cls.unmet(operation, state, groupby):
            raise StateError(operation, wanted, there)
