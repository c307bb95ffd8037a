"""Job parameters with typed defaults, overridable from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from typing import Mapping


@dataclass(frozen=True)
class Settings:
    # search
    TOP_K: int = 5
    SCORE_THRESHOLD: float = 0.65
    # encoders, tried in order
    PRIMARY_EMBED_MODEL: str = "jinaai/jina-embeddings-v2-base-code"
    FALLBACK_EMBED_MODEL: str = "microsoft/codebert-base"
    ENCODE_BATCH: int = 32
    # corpus selection
    LICENSE: str = "mit"
    STARS: int = 500
    MAX_REPOS: int = 30
    MAX_FILES_PER_REPO: int = 20
    MAX_DOWNLOAD_BYTES: int = 20_000
    # inventory
    REPO_HOST: str = "github.com"
    REPO_WORKSPACE_DIR: str = "workspace"
    MAX_FILE_SIZE_BYTES: int = 100_000
    # physical limits: what may be broadcast at a time
    BROADCAST_QUERY_BYTES: int = 8 << 20
    BROADCAST_HIT_ROWS: int = 100_000
    BROADCAST_REPO_ROWS: int = 100_000

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "Settings":
        """Defaults, with any field replaced by the like-named variable."""
        env = os.environ if env is None else env
        found = {
            f.name: type(f.default)(env[f.name]) for f in fields(cls) if f.name in env
        }
        return cls(**found)


DEFAULTS = Settings.from_env()
