"""Settings of the engine, as one frozen object."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from os import environ
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    chunk_strategy: str = "section"
    fixed_tokens: int = 320
    fixed_overlap: int = 64
    section_max: int = 380
    section_min: int = 40
    tokens_per_word: float = 1.3
    dense_k: int = 20
    sparse_k: int = 20
    rrf_k: int = 60
    fused_k: int = 20
    final_k: int = 5
    check_passages: int = 2
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_floor: float = 0.25
    multilingual_embedder: bool = True
    panel_rule: str = "unanimous"
    quote_threshold: float = 0.9
    quote_required: bool = False
    plan_rule: str = "flag"
    hypothesis_match: bool = True
    hypothesis_min_sim: float = 0.55
    hypothesis_margin: float = -0.02
    echo_rule: str = "flag"
    echo_min_sim: float = 0.90
    echo_min_overlap: float = 0.70
    zh_rule: str = "flag"
    context_order: str = "rank"
    refusal_marker: str = "查無直接支持此說法的段落"

    def with_(self, **changes) -> "Settings":
        return replace(self, **changes)

    @staticmethod
    def from_env(env_file: str | None = None, prefix: str = "CITEFORGE_") -> "Settings":
        """Environment variables, and KEY=VALUE lines of a file for those that are not set."""
        found = {}
        if env_file and Path(env_file).exists():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                key, eq, value = line.strip().partition("=")
                if eq and not key.startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
        found |= {k: v for k, v in environ.items() if k.startswith(prefix)}
        out = {}
        for f in fields(Settings):
            raw = found.get(prefix + f.name.upper())
            if raw is not None:
                kind = type(f.default)
                out[f.name] = raw.lower() in ("1", "true", "on", "yes") if kind is bool else kind(raw)
        return Settings(**out)


DEFAULTS = Settings()
