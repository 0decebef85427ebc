"""Settings of a run: frozen, validated, and describable in one line."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    """Defaults of every threshold; ``from_environment`` overrides them from variables named LOOMERY_<FIELD>."""

    generator: str = ""
    verifier: str = ""
    judge: str = ""
    embedder: str = "hashing"
    strategy: str = "section"
    chunk_chars: int = 1600
    chunk_overlap: int = 200
    chunk_least: int = 80
    candidates: int = 20
    results: int = 5
    rank_constant: int = 60
    least_similarity: float = 0.60
    most_unsupported: float = 0.34
    latency_budget_s: float = 5.0

    @classmethod
    def from_environment(cls, environment: dict[str, str] | None = None) -> Config:
        held = os.environ if environment is None else environment
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[str(f.type)](held[f"LOOMERY_{f.name.upper()}"]) for f in fields(cls) if f"LOOMERY_{f.name.upper()}" in held})

    def problems(self) -> list[str]:
        """What is wrong with the settings; empty if nothing is."""
        out = []
        if self.chunk_overlap >= self.chunk_chars:
            out.append("chunk_overlap must be under chunk_chars")
        if not 0 <= self.least_similarity <= 1:
            out.append("least_similarity must lie between 0 and 1")
        if not 0 <= self.most_unsupported <= 1:
            out.append("most_unsupported must lie between 0 and 1")
        if self.results > self.candidates:
            out.append("results must not exceed candidates")
        if self.strategy not in ("section", "fixed"):
            out.append(f"no such strategy: {self.strategy}")
        return out

    def describe(self) -> str:
        independent = "independent" if self.judge and self.judge != self.generator else "same as generator"
        return f"{self.strategy} chunks, {self.embedder} vectors, {self.candidates}->{self.results}, similarity >= {self.least_similarity}, judge {independent}"
