"""Embedding backends and compilers without any service."""

import json
import os
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from pyspark.sql import functions as F

from tessera.config import Answers, Config
from tessera.operators import backends
from tessera.plans import turns


class Handler(BaseHTTPRequestHandler):
    keys: list = []

    def do_POST(self):
        self.keys.append(self.headers.get("Authorization"))
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        answer = {"embedding": [len(body["prompt"]), 1.0]} if self.path.endswith("embeddings") else {"response": '{"query": "q"}' if body["model"] == "good" else "[1"}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


@pytest.fixture()
def service():
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_embedders(spark, service):
    rows = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "i int, text string")
    got = {r.i: r.vector for r in backends.embedder("http", model="m", base_url=service)(rows).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [0.0, 1.0]}
    assert backends.embedder("unavailable")(rows).where("vector IS NOT NULL").count() == 0
    assert backends.embedder("probe")(rows).where("i = 1").first()["vector"] == [3.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        backends.embedder("other")
    with pytest.raises(Exception, match="other vectors"):
        backends.embed_with(lambda: lambda texts: [])(rows).collect()


def test_compilers(service):
    assert backends.HttpCompiler("good", service).compile_turn({}).payload == {"query": "q"}
    assert backends.HttpCompiler("bad", service).compile_turn({}).status == "malformed"
    assert backends.HttpCompiler("good", "http://127.0.0.1:9", 1).compile_turn({}).status == "unavailable"
    assert backends.NoCompiler().compile_turn({}).payload is None
    with pytest.raises(RuntimeError):
        backends.NoWriter().generate({})


def test_env_file(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# no\nA=1\n B = 'x y' \nbroken\n\n=z\n")
    assert backends.load_env(str(path)) == {"A": "1", "B": "x y"} and backends.load_env(str(tmp_path / "none")) == {}


def test_records(spark, tmp_path):
    from tessera.sources import records

    schema = "a int, b string"
    assert records.read_document(spark, str(tmp_path / "no.json"), schema) is None and records.read_ledger(spark, str(tmp_path / "no"), schema).count() == 0
    (tmp_path / "one.json").write_text('{\n "a": 1,\n "b": null\n}\n')
    assert records.read_document(spark, str(tmp_path / "one.json"), schema).first() == (1, None)
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n  \n{"a": 2}\n')
    assert sorted(tuple(r) for r in records.read_ledger(spark, str(tmp_path / "log.jsonl"), schema).collect()) == [(1, "x"), (2, None)]
    for i in range(2):
        records.append_ledger(spark.createDataFrame([(i, None)], schema), str(tmp_path / "ledger"))
    assert records.read_ledger(spark, str(tmp_path / "ledger"), schema).count() == 2
    rows = [(1, "[1, 2.5]"), (2, "[1, null]"), (3, "oops"), (4, '["1"]'), (5, None), (6, "{}"), (7, "[]")]
    got = {r.i: r.vector for r in records.vectors(spark.createDataFrame(rows, "i int, vector_json string")).collect()}
    assert got == {1: [1.0, 2.5], 7: []}


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_path):
    loads = str(tmp_path / "loads")

    def load():
        with open(loads, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda texts: [[float(len(t))] for t in texts]

    rows = spark.range(200, numPartitions=20).select(F.col("id").cast("string").alias("text"))
    embed = backends.embed_with(load, 1, key=("counted", str(tmp_path)))
    for _ in range(3):
        assert embed(rows).where("vector[0] = length(text)").count() == 200
    with open(loads) as found:
        workers = found.read().split()
    assert len(workers) == len(set(workers)) < 20


def test_encoders_of_a_model():
    class Model:
        def encode_query(self, texts, batch_size):
            return [["q", t] for t in texts]

        def encode(self, texts, batch_size, normalize_embeddings):
            return [["e", t, normalize_embeddings] for t in texts]

    own = Model()
    assert backends._encode(own, ("encode", "encode_query"), ["x"], batch_size=1, normalize_embeddings=True) == [["e", "x", True]]
    own.encode_query = lambda texts: [["bare", t] for t in texts]
    assert backends._encode(own, ("encode_query", "encode"), ["x"], batch_size=1, normalize_embeddings=True) == [["bare", "x"]]
    both = backends.sentence_transformers("m")
    assert backends.for_queries(both) is both.queries is not both.documents and backends.for_queries(backends.unavailable) is backends.unavailable


def counting(path):
    """A writer that counts its calls in a file and fails for some contexts."""

    class Counting:  # within a function, so that it is sent to the workers as it is
        available, mode = True, "live"

        def generate(self, context):
            with open(path, "a") as out:
                out.write("x")
            if context["n"] == 3:
                raise OSError("no line")
            return f"answer {context['n']}", {"model": "m"}

    return Counting()


def test_a_task_that_fails_after_its_call_does_not_call_again(spark, tmp_path):
    count, failed = str(tmp_path / "count"), str(tmp_path / "failed")
    writer = backends.LoggedWriter(counting(count), backends.CallLog(str(tmp_path / "calls"), "m"))

    @F.pandas_udf("string")
    def answer(numbers):
        out = [writer.generate({"n": int(n)})[0] for n in numbers]
        if not os.path.exists(failed):
            open(failed, "w").close()
            raise RuntimeError("the executor is lost")
        return turns.pd.Series(out)

    rows = spark.range(5, 7, numPartitions=1).select(answer("id").alias("a"))
    with pytest.raises(Exception, match="lost"):
        rows.collect()
    assert [r["a"] for r in rows.collect()] == ["answer 5", "answer 6"]
    with open(count) as found:
        assert found.read() == "xx"
    with pytest.raises(OSError):
        writer.generate({"n": 3})
    assert sum(len(files) for _, _, files in os.walk(tmp_path / "calls")) == 2


def test_a_logged_compiler_keeps_failures_out_of_the_log(service, tmp_path):
    log = backends.CallLog((tmp_path / "calls").as_uri(), "good")
    down = backends.LoggedCompiler(backends.HttpCompiler("good", "http://127.0.0.1:9", 1), log)
    assert down.compile_turn({"a": 1}).status == "unavailable" and down.merges_focus
    up = backends.LoggedCompiler(backends.HttpCompiler("good", service), log)
    assert up.compile_turn({"a": 1}).payload == {"query": "q"}
    assert down.compile_turn({"a": 1}) == up.compile_turn({"a": 1})
    assert not backends.LoggedCompiler(backends.NoCompiler(), log).merges_focus


def test_one_failing_call_blocks_one_turn(spark, tmp_path):
    rows = spark.createDataFrame([(n, "completed" if n < 5 else "blocked") for n in range(6)], "n int, outcome string")
    rows = rows.withColumn("reasons", F.array().cast("array<string>")).withColumn("synthesis_context_packet", F.struct("n"))
    got = {r["n"]: r for r in turns.answers(rows, counting(str(tmp_path / "count"))).collect()}
    assert [got[n]["response"] for n in range(6)] == ["answer 0", "answer 1", "answer 2", None, "answer 4", None]
    assert got[3]["outcome"] == "blocked" and got[3]["reasons"] == ["LLM backend failed: OSError: no line"]
    assert got[4]["outcome"] == "completed" and json.loads(got[4]["answer_metadata"]) == {"model": "m"} and got[5]["answer_metadata"] is None


def test_keys_and_models_for_answers(service, tmp_path, monkeypatch):
    monkeypatch.delenv(backends.ANSWERS_KEY, raising=False)
    config = Config(answers=Answers("keyed", "good", service))
    missing = backends.backends_of(config, str(tmp_path))[2]
    assert not missing.available and backends.ANSWERS_KEY in missing.reason
    (tmp_path / ".env.local").write_text(f"{backends.ANSWERS_KEY}='from file'\n")
    writer = backends.backends_of(config, str(tmp_path), "other")[2]
    assert writer.model == "other" and "from file" not in repr(writer)
    Handler.keys.clear()
    text, told = writer.generate({})
    assert text == "[1" and told["model"] == "other" and Handler.keys == ["Bearer from file"]
    monkeypatch.setenv(backends.ANSWERS_KEY, "from environment")
    assert backends.backends_of(config, str(tmp_path))[2].key == "from environment"
