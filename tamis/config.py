"""Settings; every one can come from the environment as TAMIS_<NAME>, malformed values fall back to the default."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Config:
    nlp_threshold: float = 0.12
    nlp_min_text_length: int = 5
    nlp_ngram_min: int = 3
    nlp_ngram_max: int = 5
    log_max_hits: int = 100
    log_dominance_min_hits: int = 1
    log_excerpt_max_chars: int = 240
    zip_max_members: int = 512
    zip_max_bytes: int = 512 * 1024 * 1024
    zip_max_ratio: int = 200
    report_width: int = 50
    api_max_content_length: int = 32 * 1024 * 1024
    api_host: str = "127.0.0.1"
    api_port: int = 8000

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        given = {}
        for f in fields(cls):
            if (text := env.get(f"TAMIS_{f.name.upper()}")) is not None:
                try:
                    given[f.name] = type(f.default)(text)
                except ValueError:
                    pass
        return cls(**given)


DEFAULT = Config()
