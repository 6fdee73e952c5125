"""Defaults of the engine and settings from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

CLASSIC = ("fixed", "structure", "sliding")
DENSE = ("semantic", "azure_semantic")


@dataclass(frozen=True)
class Defaults:
    fixed_size: int = 500
    fixed_overlap: int = 80
    window: int = 400
    stride: int = 200
    top_k: int = 6
    max_sentences: int = 4
    llm_passages: int = 5
    truth_size: int = 400
    truth_overlap: int = 50
    questions_per_doc: int = 10
    min_chars: int = 200
    max_chars: int = 800


DEFAULTS = Defaults()


@dataclass(frozen=True)
class CloudSettings:
    """Connection of a hosted model; all but the version must be given."""

    api_key: str = ""
    endpoint: str = ""
    deployment: str = ""
    embedding_deployment: str = ""
    api_version: str = ""

    @classmethod
    def from_env(cls, prefix: str = "PASSAGE_ENGINE_") -> CloudSettings:
        return cls(*(os.environ.get(prefix + f.name.upper(), "") for f in fields(cls)))

    def missing(self) -> list[str]:
        return [f.name for f in fields(self) if f.name != "api_version" and not getattr(self, f.name)]


def data_dir() -> str:
    return os.environ.get("PASSAGE_ENGINE_DATA", "data")
