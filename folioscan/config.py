"""Configuration from a TOML file; whatever it leaves out has a default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from folioscan.sources.shards import Feed

#: The environment variable that names a configuration file.
VARIABLE = "FOLIOSCAN_CONFIG"


@dataclass(frozen=True)
class Embeddings:
    model: str = "mixedbread-ai/mxbai-embed-large-v1"
    batch_size: int = 64
    target_dim: int | None = None


@dataclass(frozen=True)
class Reranker:
    enabled: bool = True
    model: str = "BAAI/bge-reranker-base"


@dataclass(frozen=True)
class Server:
    default_k: int = 10
    hybrid_rrf_k: int = 60


@dataclass(frozen=True)
class Refresh:
    enabled: bool = True
    interval_hours: float = 24.0
    full_rebuild: bool = True


@dataclass(frozen=True)
class Config:
    sources: tuple[Feed, ...] = (Feed("default", "local", "."),)
    embeddings: Embeddings = field(default_factory=Embeddings)
    reranker: Reranker = field(default_factory=Reranker)
    server: Server = field(default_factory=Server)
    refresh: Refresh = field(default_factory=Refresh)


def find(explicit: str | None = None) -> Path | None:
    """The file to read: the argument, the environment's, the user's, the working folder's; None if the first that is named does not exist or none is there."""
    for named in (explicit, os.environ.get(VARIABLE)):
        if named:
            path = Path(named).expanduser()
            return path if path.is_file() else None
    user = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "folioscan" / "folioscan.toml"
    return next((p for p in (user, Path("folioscan.toml")) if p.is_file()), None)


def load(explicit: str | None = None) -> Config:
    path = find(explicit)
    if path is None:
        return Config()
    with path.open("rb") as f:
        raw = tomllib.load(f)
    section = lambda cls, name: cls(**{k: v for k, v in raw.get(name, {}).items() if k in cls.__dataclass_fields__})
    feeds = tuple(Feed(**{k: v for k, v in s.items() if k in Feed.__dataclass_fields__}) for s in raw.get("sources", []))
    return Config(feeds or Config().sources, section(Embeddings, "embeddings"), section(Reranker, "reranker"), section(Server, "server"), section(Refresh, "refresh"))
