"""Settings of an index and its search, in one validated place."""

from __future__ import annotations

from dataclasses import dataclass, fields

FAMILIES = ("angle", "pStable", "precalculated")
METHODS = ("default", "fromfile")
ORDERS = ("similarity", "id")


@dataclass(frozen=True)
class Config:
    """Names follow the documented settings; every value is checked when the object is made."""

    family: str = "angle"
    family_size: int = 10
    tables: int = 8
    dim: int = 64
    chain_length: int = 6
    mu: float = 0.0
    sigma: float = 1.0
    w: int = 3
    threshold: float = 0.0
    top_k: int = 10
    order: str = "similarity"
    method: str = "default"
    family_file: str | None = None
    by_pulling: bool = False
    normalize: bool = False
    rounding: str = "trunc"
    update_window: int = 1
    merge_threshold: int = 1000
    max_vectors: int = 10_000
    workers: int = 4
    batching_ms: int = 0
    shards: int = 4
    seed: int = 42

    def __post_init__(self):
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(self.family in FAMILIES, f"unknown family {self.family!r}; there are {FAMILIES}")
        need(self.method in METHODS, f"unknown method {self.method!r}; there are {METHODS}")
        need(self.order in ORDERS, f"unknown order {self.order!r}; there are {ORDERS}")
        need(self.rounding in ("trunc", "floor"), "rounding is trunc or floor")
        need(self.method != "fromfile" or bool(self.family_file), "fromfile needs family_file")
        for name in ("family_size", "tables", "dim", "chain_length", "w", "top_k", "update_window", "merge_threshold", "max_vectors", "workers", "shards"):
            need(getattr(self, name) > 0, f"{name} must be positive")
        need(self.family == "pStable" or self.chain_length <= 32, "a key has 32 bits")
        need(self.family != "precalculated" or self.chain_length % 2 == 0, "precalculated chains need an even length")

    @classmethod
    def from_mapping(cls, values: dict[str, str]) -> Config:
        """From text settings; unknown names are errors."""
        kinds = {f.name: f.type for f in fields(cls)}
        unknown = set(values) - set(kinds)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        cast = {"int": int, "float": float, "bool": lambda x: str(x).lower() == "true"}
        return cls(**{k: cast.get(kinds[k], lambda x: x)(v) for k, v in values.items()})
