"""Configurations: read from JSON or YAML, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

SCHEMES = ("whole_review", "fixed_token", "sentence_window")


def load_config(path: str) -> dict[str, Any]:
    """A configuration file as a mapping; YAML needs a parser to be installed, JSON doesn't."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        found = json.loads(text)
    except ValueError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def section(config: dict[str, Any], name: str) -> dict[str, Any]:
    if name not in config:
        raise KeyError(f"the configuration has no {name!r}")
    return config[name]


def _made(kind: type, values: dict[str, Any]) -> Any:
    """``kind`` from those of ``values`` that it has; a missing one without a default is a KeyError."""
    try:
        return kind(**{f.name: values[f.name] for f in fields(kind) if f.name in values})
    except TypeError as error:
        raise KeyError(f"{kind.__name__}: {error}") from error


@dataclass(frozen=True)
class ChunkingConfig:
    scheme: str
    fixed_token_size: int = 256
    sentence_window_size: int = 3

    def __post_init__(self) -> None:
        if self.scheme not in SCHEMES:
            raise ValueError(f"scheme is {self.scheme!r}, not one of {SCHEMES}")
        if self.fixed_token_size < 1 or self.sentence_window_size < 1:
            raise ValueError("sizes of chunks must be positive")


@dataclass(frozen=True)
class DenseConfig:
    model_name: str
    batch_size: int = 64
    device: str | None = None

    def __post_init__(self) -> None:
        if not self.model_name or self.batch_size < 1 or self.device not in (None, "cpu", "cuda"):
            raise ValueError(f"not a usable encoder: {self}")


@dataclass(frozen=True)
class RetrievalEvalConfig:
    seed: int
    corpus_in: str
    questions_in: str
    chunking_config: str
    k_values: tuple[int, ...]
    build_report_out: str
    dense: DenseConfig

    def __post_init__(self) -> None:
        if not self.k_values or min(self.k_values) < 1:
            raise ValueError(f"every k must be positive: {self.k_values}")


@dataclass(frozen=True)
class Category:
    name: str
    description: str
    target_count: int
    negative_count: int
    keywords: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name or self.target_count < 0 or not 0 <= self.negative_count <= self.target_count:
            raise ValueError(f"not a usable category: {self}")


@dataclass(frozen=True)
class Taxonomy:
    categories: tuple[Category, ...]
    expected_total: int
    total_tolerance: int
    min_coverage_pct: float
    min_coverage_pct_hard_floor: float

    def __post_init__(self) -> None:
        names = [c.name for c in self.categories]
        if len(set(names)) < len(names):
            raise ValueError(f"a category occurs twice: {names}")
        if self.total_tolerance < 0 or self.min_coverage_pct_hard_floor > self.min_coverage_pct:
            raise ValueError("the tolerance can't be negative, nor the floor above the flag")

    @property
    def total_target(self) -> int:
        return sum(c.target_count for c in self.categories)

    @property
    def total_negative(self) -> int:
        return sum(c.negative_count for c in self.categories)

    @property
    def total_fits(self) -> bool:
        return abs(self.total_target - self.expected_total) <= self.total_tolerance


def load_chunking_config(path: str) -> ChunkingConfig:
    return _made(ChunkingConfig, section(load_config(path), "chunking"))


def load_retrieval_eval_config(path: str) -> RetrievalEvalConfig:
    raw = load_config(path)
    paths = section(raw, "paths")
    dense = _made(DenseConfig, section(section(raw, "retrievers"), "dense"))
    return _made(RetrievalEvalConfig, raw | paths | {"k_values": tuple(section(raw, "k_values")), "dense": dense})


def load_taxonomy(path: str) -> Taxonomy:
    raw = load_config(path)
    categories = tuple(_made(Category, c | {"description": c["description"].strip(), "keywords": tuple(c.get("keywords", ()))}) for c in section(raw, "categories"))
    return _made(Taxonomy, section(raw, "validation") | {"categories": categories})
