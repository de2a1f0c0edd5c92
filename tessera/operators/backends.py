"""What turns text into vectors, messages into packets and packets into answers: protocols, and who implements them.

Embedding runs inside a query, batch by batch in Python workers with the model loaded once in each. Compilers and
answers are calls to other services, once for each request where there is a log of calls; without a service they say so.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tessera.config import Config
from tessera.operators.store import probe_embedding

Embedder = Callable[[DataFrame], DataFrame]
#: text list -> vectors; made once in each worker by a loader.
Encode = Callable[[list[str]], list[list[float]]]


#: Models of this worker process, by what they were loaded as; they live as long as the worker.
_MODELS: dict[tuple, Encode] = {}


def model_of(key: tuple | None, load: Callable[[], Encode]) -> Encode:
    """The worker's model of that key, loaded by the first task that asks for it; without a key it is loaded for each task."""
    if key is None:
        return load()
    if key not in _MODELS:
        _MODELS[key] = load()
    return _MODELS[key]


def embed_with(load: Callable[[], Encode], dimensions: int | None = None, key: tuple | None = None) -> Embedder:
    """An embedder (rows with `text` get `vector`) over a loader that a worker calls once for each key.

    Null text has a null vector; a number of vectors other than that of texts, or of values other than `dimensions`,
    is an error. Arrays of any kind and other sequences of numbers are taken.
    """

    def embed(rows: DataFrame) -> DataFrame:
        @F.pandas_udf(ArrayType(DoubleType()))
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            # By its module: what is pickled with the function would be a copy of the registry.
            from tessera.operators import backends

            encode = backends.model_of(key, load)
            for texts in batches:
                given = texts[texts.notna()]
                vectors = [[float(x) for x in v] for v in encode(list(given))] if len(given) else []
                if len(vectors) != len(given) or dimensions and any(len(v) != dimensions for v in vectors):
                    raise ValueError("the model gave other vectors than asked for")
                yield pd.Series(dict(zip(given.index, vectors)), dtype=object).reindex(texts.index).where(texts.notna(), None)

        return rows.withColumn("vector", encoded(F.col("text")))

    return embed


@dataclass(frozen=True)
class TwoEncoders:
    """An embedder for documents that has another for queries."""

    documents: Embedder
    queries: Embedder

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self.documents(rows)


def for_queries(embed: Embedder) -> Embedder:
    """The embedder for queries, where there is one of their own."""
    return getattr(embed, "queries", embed)


def _encode(model: Any, methods: tuple[str, ...], texts: list[str], **wanted: Any) -> list:
    """Vectors by the first of `methods` that the model has; arguments that it does not know are left out."""
    method = next(getattr(model, name) for name in methods if hasattr(model, name))
    try:
        return method(texts, **wanted)
    except TypeError:
        return method(texts)


def sentence_transformers(model: str, batch_size: int = 32, normalize: bool = True, device: str | None = None) -> Embedder:
    """Vectors of a sentence-transformers model; the package is needed on the workers.

    Queries and documents are encoded by methods of their own where the model has them, by one loaded model.
    """

    def loader(*methods: str) -> Callable[[], Encode]:
        def load() -> Encode:
            from tessera.operators import backends

            def whole() -> Any:
                from sentence_transformers import SentenceTransformer

                return SentenceTransformer(model, device=device)

            own = backends.model_of(("sentence_transformers", model, device), whole)
            return lambda texts: _encode(own, methods, texts, batch_size=batch_size, normalize_embeddings=normalize)

        return load

    return TwoEncoders(embed_with(loader("encode_document", "encode")), embed_with(loader("encode_query", "encode")))


def _post(url: str, body: dict, timeout: float, key: str | None = None) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def http_embeddings(model: str, base_url: str, timeout: float = 60) -> Embedder:
    """Vectors from an HTTP service that takes {model, prompt} at /api/embeddings; one call for each text."""

    def load() -> Encode:
        return lambda texts: [_post(f"{base_url}/api/embeddings", {"model": model, "prompt": t}, timeout)["embedding"] for t in texts]

    return embed_with(load)


def unavailable(rows: DataFrame) -> DataFrame:
    """No backend: null vectors, so the vector surface finds nothing."""
    return rows.withColumn("vector", F.lit(None).cast("array<double>"))


def embedder(provider: str, **settings: Any) -> Embedder:
    known: dict[str, Callable[..., Embedder]] = {
        "probe": lambda: probe_embedding,
        "unavailable": lambda: unavailable,
        "sentence_transformers": sentence_transformers,
        "http": http_embeddings,
    }
    if provider not in known:
        raise ValueError(f"unknown provider {provider!r}; known: {', '.join(sorted(known))}")
    return known[provider](**settings)


@dataclass(frozen=True)
class Compiled:
    """A compiler's answer: payload if it was an object, and what is known about the call."""

    payload: dict | None
    raw: str | None = None
    status: str = "unavailable"
    metadata: dict = field(default_factory=dict)


class Compiler(Protocol):
    def compile_turn(self, request: dict) -> Compiled: ...


class NoCompiler:
    def compile_turn(self, request: dict) -> Compiled:
        return Compiled(None)


@dataclass(frozen=True)
class HttpCompiler:
    """A chat service at /api/generate that answers with a JSON object; any failure is an unavailable answer."""

    model: str
    base_url: str
    timeout: float = 60
    #: Its answers are completed as packets.complete_by_backend does, with the focus of the thread.
    merges_focus = True

    def compile_turn(self, request: dict) -> Compiled:
        prompt = "Answer with one JSON object: the query packet for this request.\n" + json.dumps(request)
        try:
            raw = _post(f"{self.base_url}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "format": "json"}, self.timeout)["response"]
        except (OSError, KeyError, ValueError) as problem:
            return Compiled(None, status="unavailable", metadata={"problem": type(problem).__name__})
        try:
            payload = json.loads(raw)
        except ValueError:
            return Compiled(None, raw, "malformed")
        return Compiled(payload, raw, "parsed") if isinstance(payload, dict) else Compiled(None, raw, "malformed")


class Writer(Protocol):
    """Answers from a synthesis context, called in Python workers, and only for approved turns.

    An answer is a text, or a text and what is known of the call. An exception blocks the turn that it was for, no other.
    """

    available: bool

    def generate(self, context: dict) -> str | tuple[str, dict]: ...


@dataclass(frozen=True)
class NoWriter:
    reason: str = "no service for answers is configured"
    available = False

    def generate(self, context: dict) -> str:
        raise RuntimeError(self.reason)


@dataclass(frozen=True)
class HttpWriter:
    """A chat service at /api/generate; an empty answer says so."""

    model: str
    base_url: str
    max_output_tokens: int = 6000
    timeout: float = 60
    key: str | None = field(default=None, repr=False)
    available = True
    mode = "live"

    def generate(self, context: dict) -> tuple[str, dict]:
        prompt = "\n".join([*context.get("output_requirements", []), json.dumps(context)])
        body = {"model": self.model, "prompt": prompt, "stream": False, "options": {"num_predict": self.max_output_tokens}}
        answer = _post(f"{self.base_url}/api/generate", body, self.timeout, self.key)
        told = {"mode": self.mode, "provider": "http", "model": answer.get("model", self.model)} | {c: answer[c] for c in ("id", "usage") if c in answer}
        return answer["response"].strip() or "The model returned an empty response.", told


class ProbeCompiler:
    """The message itself as the packet's query: for smoke tests."""

    def compile_turn(self, request: dict) -> Compiled:
        query = request["raw_user_input"]
        return Compiled({"query": query, "intent": "probe"}, json.dumps({"query": query}), "parsed", {"backend_mode": "probe"})


@dataclass(frozen=True)
class ProbeWriter:
    """An answer that repeats the message: for smoke tests."""

    prefix: str = "Probe answer"
    available = True
    mode = "probe"

    def generate(self, context: dict) -> str:
        return f"{self.prefix}: {context['raw_user_input']}"


class CallLog:
    """Answers of services by the hash of their request, in a folder that all workers reach.

    An answer is stored before it is used, so a task that is tried again, or runs twice, finds it and does not call again.
    Failures are not stored. The folder is a path or a URI of a file system that pyarrow knows (file, s3, gs, hdfs).
    """

    def __init__(self, folder: str, name: str = "") -> None:
        self.folder, self.name = folder, name

    def once(self, request: str, call: Callable[[], str]) -> str:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        key = hashlib.sha256(f"{self.name}\n{request}".encode()).hexdigest()
        path = f"{base}/{key[:2]}/{key}"

        def stored() -> str | None:
            if system.get_file_info(path).type == fs.FileType.NotFound:
                return None
            with system.open_input_stream(path) as found:
                return found.read().decode()

        known = stored()
        if known is not None:
            return known
        answer = call()
        system.create_dir(f"{base}/{key[:2]}")
        own = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(answer.encode())
        # Whoever stored first is heard by all.
        earlier = stored()
        if earlier is not None:
            system.delete_file(own)
            return earlier
        system.move(own, path)
        return answer


class _Failed(Exception):
    def __init__(self, answer: Compiled) -> None:
        self.answer = answer


@dataclass(frozen=True)
class LoggedCompiler:
    """A compiler that is asked once for each request."""

    compiler: Compiler
    log: CallLog

    @property
    def merges_focus(self) -> bool:
        return getattr(self.compiler, "merges_focus", False)

    def compile_turn(self, request: dict) -> Compiled:
        def call() -> str:
            got = self.compiler.compile_turn(request)
            if got.status == "unavailable":
                raise _Failed(got)
            return json.dumps(asdict(got))

        try:
            return Compiled(**json.loads(self.log.once(json.dumps(request, sort_keys=True), call)))
        except _Failed as failed:
            return failed.answer


@dataclass(frozen=True)
class LoggedWriter:
    """A writer that is asked once for each context."""

    writer: Writer
    log: CallLog

    @property
    def available(self) -> bool:
        return self.writer.available

    @property
    def mode(self) -> str:
        return getattr(self.writer, "mode", "live")

    @property
    def reason(self) -> str:
        return getattr(self.writer, "reason", "no service for answers is configured")

    def generate(self, context: dict) -> tuple[str, dict]:
        def call() -> str:
            answer = self.writer.generate(context)
            return json.dumps(answer if isinstance(answer, tuple) else (answer, {}))

        text, told = json.loads(self.log.once(json.dumps(context, sort_keys=True), call))
        return text, told


#: The variable of the environment, or of .env.local, that holds the key of the service for answers.
ANSWERS_KEY = "TESSERA_ANSWERS_KEY"


def keyed_writer(config: Config, folder: str = ".", model: str | None = None) -> Writer:
    """A writer with a key from the environment, before that of .env.local in `folder`; without a key one that says so."""
    key = os.environ.get(ANSWERS_KEY) or load_env(f"{folder}/.env.local").get(ANSWERS_KEY)
    if not key:
        return NoWriter(f"{ANSWERS_KEY} is not set")
    own = config.answers
    return HttpWriter(model or own.model, own.base_url, own.max_output_tokens, own.request_timeout_seconds, key)


def backends_of(config: Config, folder: str = ".", model: str | None = None) -> tuple[Embedder, Compiler, Writer]:
    """The embedder, compiler and writer that the settings name; `model` goes before the settings' model for answers."""
    own = config.embeddings
    given: dict[str, Any] = {}
    if own.provider == "sentence_transformers":
        given = {"model": own.model, "batch_size": own.batch_size, "normalize": own.normalize_embeddings, "device": own.device}
    elif own.provider == "http":
        given = {"model": own.model, "base_url": own.base_url or "", "timeout": own.request_timeout_seconds}
    compilers: dict[str, Callable[[], Compiler]] = {
        "none": NoCompiler,
        "probe": ProbeCompiler,
        "http": lambda: HttpCompiler(config.compiler.model or "", config.compiler.base_url, config.compiler.request_timeout_seconds),
    }
    answers = config.answers
    writers: dict[str, Callable[[], Writer]] = {
        "none": NoWriter,
        "probe": ProbeWriter,
        "keyed": lambda: keyed_writer(config, folder, model),
        "http": lambda: HttpWriter(model or answers.model, answers.base_url, answers.max_output_tokens, answers.request_timeout_seconds),
    }
    for kind, known, name in (("compiler", compilers, config.compiler.provider), ("answers", writers, answers.provider)):
        if name not in known:
            raise ValueError(f"{kind}: unknown provider {name!r}; known: {', '.join(sorted(known))}")
    return embedder(own.provider, **given), compilers[config.compiler.provider](), writers[answers.provider]()


def load_env(path: str) -> dict[str, str]:
    """KEY=VALUE lines of a file, if it is there; # comments and blank lines are passed over, quotes around a value go."""
    found: dict[str, str] = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as lines:
            for line in lines:
                name, equals, value = line.strip().partition("=")
                if equals and name.strip() and not name.startswith("#"):
                    value = value.strip()
                    found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found
