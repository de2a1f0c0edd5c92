"""Settings, read strictly from YAML: no unknown, missing or wrongly typed key, and no secrets."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, get_type_hints

ENVIRONMENT = "TESSERA_CONFIG"
DEFAULT_FILE = "tessera.yaml"
#: What a key or value must not look like.
SECRET_KEYS = re.compile(r"api[_-]?key|secret|password|credentials?|bearer|(^|[_-])token$", re.I)
SECRET_VALUES = re.compile(r"^(sk-|ghp_|xox[abp]-|AKIA|Bearer )")
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Graph:
    enabled: bool = True
    hop_limit: int = 1
    max_candidates: int = 24
    seed_sources: list[str] = field(default_factory=lambda: ["graph_seeds", "active_focus", "retrieval_terms"])
    edge_type_allowlist: list[str] = field(default_factory=lambda: ["note_links_note"])
    node_type_allowlist: list[str] = field(default_factory=lambda: ["note"])
    token_overlap: bool = True
    min_token_overlap: int = 2


@dataclass(frozen=True)
class Embeddings:
    """provider: probe, sentence_transformers, http or unavailable."""

    provider: str = "probe"
    model: str = "probe"
    base_url: str | None = None
    batch_size: int = 32
    normalize_embeddings: bool = True
    device: str | None = None
    request_timeout_seconds: int = 60


@dataclass(frozen=True)
class Compiler:
    """provider: http or none."""

    provider: str = "none"
    model: str | None = None
    base_url: str = ""
    request_timeout_seconds: int = 60


@dataclass(frozen=True)
class Answers:
    """provider: http or none; the key of a service comes from the environment only."""

    provider: str = "none"
    model: str = ""
    base_url: str = ""
    max_output_tokens: int = 6000
    request_timeout_seconds: int = 60


@dataclass(frozen=True)
class Storage:
    """Folders under the store: of threads, and of what ingestion writes."""

    threads: str = "threads"
    ingestion: str = "ingestion"


@dataclass(frozen=True)
class Config:
    store: str = ".tessera"
    max_retrieval_chunks: int = 18
    roots: list[str] = field(default_factory=list)
    vector_table: str = "chunk_vectors"
    graph_nodes_table: str = "graph_nodes"
    graph_edges_table: str = "graph_edges"
    graph: Graph = field(default_factory=Graph)
    embeddings: Embeddings = field(default_factory=Embeddings)
    compiler: Compiler = field(default_factory=Compiler)
    answers: Answers = field(default_factory=Answers)
    storage: Storage = field(default_factory=Storage)

    def place(self, folder: str, root: str | None = None) -> str:
        """A storage folder: as it is where it is absolute or a URI, else under the store (or `root`)."""
        return folder if folder.startswith("/") or "://" in folder else f"{(root or self.store).rstrip('/')}/{folder}"


def _no_secrets(value: Any, path: str = "") -> None:
    if isinstance(value, dict):
        for k, v in value.items():
            if SECRET_KEYS.search(str(k)):
                raise ConfigError(f"{path}{k}: secrets do not belong into the configuration")
            _no_secrets(v, f"{path}{k}.")
    elif isinstance(value, list):
        for v in value:
            _no_secrets(v, path)
    elif isinstance(value, str) and SECRET_VALUES.match(value):
        raise ConfigError(f"{path.rstrip('.')}: looks like a secret")


def _build(kind: type, given: Any, path: str) -> Any:
    if not isinstance(given, dict):
        raise ConfigError(f"{path or 'the file'}: a mapping is needed")
    hints, names = get_type_hints(kind), {f.name for f in fields(kind)}
    for problem, keys in (("unknown", set(given) - names), ("missing", names - set(given))):
        if keys:
            raise ConfigError(f"{path}: {problem} {', '.join(sorted(map(str, keys)))}")
    made = {}
    for name, value in given.items():
        hint = hints[name]
        if is_dataclass(hint):
            made[name] = _build(hint, value, f"{path}{name}.")
            continue
        wanted = list if hint == list[str] else hint
        if hint == str | None:
            wanted = str if value is not None else type(None)
        if type(value) is not wanted or wanted is list and not all(type(x) is str for x in value):
            raise ConfigError(f"{path}{name}: {hint} is needed")
        made[name] = value
    return kind(**made)


def load(path: str | None = None) -> Config:
    """From path, or the file that the environment names, or the default file; an unset default gives the defaults."""
    import yaml

    chosen = path or os.environ.get(ENVIRONMENT)
    if chosen is None and not os.path.exists(DEFAULT_FILE):
        return Config()
    with open(chosen or DEFAULT_FILE, encoding="utf-8") as source:
        given = yaml.safe_load(source)
    _no_secrets(given)
    made = _build(Config, given, "")
    for name in ("vector_table", "graph_nodes_table", "graph_edges_table"):
        if not IDENTIFIER.match(getattr(made, name)):
            raise ConfigError(f"{name}: an identifier is needed")
    return made
