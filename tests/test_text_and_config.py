"""Text expressions and settings."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import text


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, text.squeeze, "  a 　b\u001c\nc ") == "a b c"
    assert one(spark, text.plain, "It's  A–B_9!") == "it s a b 9"
    assert one(spark, text.terms, "The Café's tea, 123 tea and don't it") == ["caf", "tea", "don't"]
    assert one(spark, text.reference_key, " My_Note  X ") == "my note x"
    assert one(spark, text.without_md, "a.MD") == "a"
    assert one(spark, text.section_label, " Plan  B: ") == "Plan B"
    assert one(spark, text.unquoted, "'x\"") == "'x\"" and one(spark, text.unquoted, '"x"') == "x"
    assert one(spark, lambda c: text.snippet(c, 5), "abcdefgh") == "abcd…"
    assert one(spark, text.is_referential, "What about IT now") and not one(spark, text.is_referential, "what about it?")


def test_canonical_json(spark):
    got = one(spark, lambda c: text.canonical_json(F.struct(c.alias("z"), F.lit(None).cast("string").alias("a"))), "é")
    assert got == json.dumps({"z": "é", "a": None}, sort_keys=True, separators=(",", ":"))
    hashed = one(spark, lambda c: text.json_hash(F.struct(c.alias("z"))), "é")
    assert hashed == hashlib.sha256(b'{"z":"\\u00e9"}').hexdigest()


def test_config(tmp_path, monkeypatch):
    import yaml

    whole = {
        "store": "s", "max_retrieval_chunks": 3, "roots": ["a=b"], "vector_table": "v",
        "graph": {"enabled": True, "hop_limit": 2, "max_candidates": 5, "seed_sources": [], "edge_type_allowlist": [], "node_type_allowlist": [], "token_overlap": False, "min_token_overlap": 2},
        "graph_nodes_table": "graph_nodes", "graph_edges_table": "graph_edges", "storage": {"threads": "threads", "ingestion": "ingestion"},
        "embeddings": {"provider": "http", "model": "m", "base_url": None, "batch_size": 8, "normalize_embeddings": True, "device": None, "request_timeout_seconds": 5},
        "compiler": {"provider": "none", "model": None, "base_url": "", "request_timeout_seconds": 5},
        "answers": {"provider": "none", "model": "", "base_url": "", "max_output_tokens": 10, "request_timeout_seconds": 5},
    }
    path = tmp_path / "c.yaml"

    def load(changed):
        path.write_text(yaml.safe_dump(changed))
        return config.load(str(path))

    made = load(whole)
    assert made.graph.hop_limit == 2 and made.answers.max_output_tokens == 10 and made.compiler.model is None
    assert (made.place("threads"), made.place("/x"), made.place("hdfs://a/b")) == ("s/threads", "/x", "hdfs://a/b")
    for wrong in ({"more": 1}, {"max_retrieval_chunks": True}, {"roots": [1]}, {"store": "sk-abc"}, {"vector_table": "a b"}, {"graph_nodes_table": "1x"}, {"embeddings": {**whole["embeddings"], "device": 3}}, {"storage": {**whole["storage"], "refresh_token": "x"}}, {"store": "Bearer abc"}, {"compiler": {**whole["compiler"], "bearer_token": "x"}}, {"graph": {**whole["graph"], "api_key": "x"}}):
        with pytest.raises(config.ConfigError):
            load({**whole, **wrong})
    with pytest.raises(config.ConfigError):
        load({k: v for k, v in whole.items() if k != "store"})
    monkeypatch.setenv(config.ENVIRONMENT, str(path))
    path.write_text(yaml.safe_dump(whole))
    assert config.load().store == "s"


def test_canonical_json_by_expressions_equals_python(spark):
    rng = random.Random(1)
    pool = ["a", "Z", " ", '"', "\\\\", "/", "\n", "\r", "\t", "\b", "\f", "\x00", "\x1f", "\x7f", "~", "é", "ß", "\u2028", "日", "\ud7ff", "\ue000", "\uffff", "😀", "\U0010ffff", "<", "'"]
    word = lambda: rng.choice([None, "", "".join(rng.choices(pool, k=rng.randint(1, 12)))])
    schema = "z string, a struct<y:array<string>,b:struct<n:long,t:boolean>,Z:int>, m map<string,array<int>>, l array<struct<q:string,p:array<array<string>>>>, `o d.d` int"
    rows = []
    for _ in range(150):
        inner = rng.choice([None, (rng.choice([None, rng.getrandbits(63) - (1 << 62)]), rng.choice([None, True, False]))])
        nested = rng.choice([None, ([word() for _ in range(rng.randint(0, 3))], inner, -1)])
        keyed = rng.choice([None, {}, {w: rng.choice([None, [1, None]]) for w in (word(), word()) if w is not None}])
        listed = rng.choice([None, [], [None, (word(), [[word()], None, []])]])
        rows.append((word(), nested, keyed, listed, rng.choice([None, 7])))
    df = spark.createDataFrame(rows, schema)
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kind = df.schema
    for r in df.select(text.canonical_json(whole, kind).alias("new"), text.canonical_json(whole).alias("old"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("raw")).collect():
        assert r["new"] == r["old"] == json.dumps(json.loads(r["raw"]), sort_keys=True, separators=(",", ":"))
    assert df.select(text.canonical_json(F.col("a"), kind["a"].dataType).alias("x")).where("x IS NULL").count() == sum(r[1] is None for r in rows)
    doubles = spark.createDataFrame([(1e16, 0.1), (1e-7, None)], "d double, e double")
    assert [r[0] for r in doubles.select(text.canonical_json(F.struct("d", "e"), doubles.schema)).collect()] == ['{"d":1e+16,"e":0.1}', '{"d":1e-07,"e":null}']


def test_no_python_in_the_plan_of_edges(spark):
    from tessera.operators import graph

    edges = spark.range(3).select(graph.edge_id(F.lit("k"), F.col("id").cast("string"), F.lit("t"), F.lit("s")).alias("e"))
    assert "Python" not in edges._jdf.queryExecution().toString()
