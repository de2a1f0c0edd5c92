"""Retrieval analytics and corpus preparation expressed as Spark DataFrame operators."""

from tessera.config import Config, ConfigError, load
from tessera.operators.store import Store, ingest
from tessera.plans.retrieve import retrieve
from tessera.plans.turns import Threads, run_turns
from tessera.sources.vault import read_files, read_vault

__all__ = ["Config", "ConfigError", "Store", "Threads", "ingest", "load", "read_files", "read_vault", "retrieve", "run_turns"]
