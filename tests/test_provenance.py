"""Canonical JSON, hash chains, schema walks, seeded samples and mixed encodings against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import TINY
from tidemark.operators import provenance as P
from tidemark.plans.fixtures import view
from tidemark.sources import files


def dumps(x):
    return json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical_equals_pythons(spark):
    r = random.Random(5)
    keys = ["b", "a", "Z", "ä", "_", "a b", "10", "9", "\U0001f600", "\uffee", 'q"', "x.y"]

    def made(depth):
        kind = r.randrange(9 if depth else 6)
        if kind >= 6:
            return {k: made(depth - 1) for k in r.sample(keys, r.randrange(5))} if kind > 6 else [made(depth - 1) for _ in range(r.randrange(4))]
        return [None, True, r.randrange(-(10**6), 10**6), r.choice([0.1, 1.0, 1e300, -0.0, 2.50, 10**40, 1e-7]), r.choice(["", "ü", "a\nb", 'q"', "\\", "</", "\u2028"]), "plain"][kind]

    given = [json.dumps(made(4), ensure_ascii=bool(i % 2), indent=i % 3 or None) for i in range(400)]
    given += ['{"a":1,"a":2}', "{", "", None, "1.10", "[1, 2 ]", '{"b":{"d":1,"c":[{"z":0,"y":-5}]},"a":null}', "-0", "123456789012345678901234567890", "true", '"x"']
    df = spark.createDataFrame(list(enumerate(given)), "i int, j string").repartition(3)
    got = {x.i: (x.c, x.d) for x in df.select("i", P.canonical(F.col("j")).alias("c"), P.digest(F.col("j")).alias("d")).collect()}
    for i, j in enumerate(given):
        try:
            want = None if j is None else dumps(json.loads(j))
        except ValueError:
            want = None
        assert got[i] == (want, None if want is None else hashlib.sha256(want.encode()).hexdigest()), j


def test_canonical_of_given_props_and_nested_rows(spark):
    e = view(spark, TINY, "events")
    nested = F.to_json(F.struct(F.struct("event_type", "value", "user_id").alias("z"), F.array(F.struct("event_id", "props")).alias("a")))
    for r in e.select("props", P.canonical(F.col("props")).alias("c"), nested.alias("n"), P.canonical(nested).alias("m")).collect():
        assert r.c == dumps(json.loads(r.props)) and r.m == dumps(json.loads(r.n))


def test_changed_artifact_is_named(spark, tmp_path):
    paths = {}
    for name in ("config", "tasks", "results"):
        (tmp_path / name).mkdir()
        for k in range(3):
            (tmp_path / name / f"part-{k}").write_bytes(f"{name}{k}".encode())
        paths[name] = str(tmp_path / name)
    recorded = spark.createDataFrame(P.chain(P.artifact_digests(spark, paths)).collect(), "position int, artifact string, sha256 string, link string")
    links, last = [r for r in recorded.orderBy("position").collect()], ""
    for r in links:
        last = hashlib.sha256("\n".join([last, r.artifact, r.sha256]).encode()).hexdigest()
        assert r.link == last
    assert P.chain_violations(recorded, P.artifact_digests(spark, paths)).isEmpty()
    (tmp_path / "tasks" / "part-1").write_bytes(b"other")
    del paths["config"]
    got = sorted((r.check, r.key, r.detail) for r in P.chain_violations(recorded, P.artifact_digests(spark, paths)).collect())
    assert got == [("artifact", "config", "gone"), ("artifact", "tasks", "changed")]
    forged = recorded.withColumn("sha256", F.when(F.col("artifact") == "tasks", F.lit("0")).otherwise(F.col("sha256")))
    assert {r.key for r in P.chain_violations(forged, P.artifact_digests(spark, {**paths, "config": str(tmp_path / "config")})).filter("check = 'chain'").collect()} == {"tasks", "results"}


def walk(v, spec, path="$"):
    if "enum" in spec:
        return [] if any(v == x and type(v) is type(x) for x in spec["enum"]) else [f"{path}: not one of the values"]
    kind = spec.get("type")
    if kind == "object":
        if not isinstance(v, dict):
            return [f"{path}: not an object"]
        out = [f"{path}.{k}: missing" for k in spec.get("required", ()) if k not in v]
        if spec.get("additionalProperties") is False:
            out += [f"{path}.{k}: unknown" for k in v if k not in spec.get("properties", {})]
        return out + [x for k, s in spec.get("properties", {}).items() if k in v for x in walk(v[k], s, f"{path}.{k}")]
    if kind == "array":
        if not isinstance(v, list):
            return [f"{path}: not an array"]
        out = [f"{path}: more than {spec['maxItems']} items"] if len(v) > spec.get("maxItems", 10**9) else []
        return out + [x for i, y in enumerate(v) for x in walk(y, spec["items"], f"{path}[{i}]")] if "items" in spec else out
    if kind == "string":
        return [f"{path}: not a string"] if not isinstance(v, str) else [f"{path}: too short"] if len(v) < spec.get("minLength", 0) else []
    right = {"integer": isinstance(v, int) and not isinstance(v, bool), "boolean": isinstance(v, bool), "null": v is None}.get(kind, True)
    return [] if right else [f"{path}: not of type {kind}"]


def test_schema_walk_equals_brute_force(spark):
    r = random.Random(8)
    rating = {"type": "object", "additionalProperties": False, "required": ["rating", "evidence"], "properties": {"rating": {"enum": ["good", "bad", None, 1]}, "evidence": {"type": "array", "maxItems": 2, "items": {"type": "string", "minLength": 1}}}}
    specs = [
        {"type": "object", "additionalProperties": False, "required": ["a", "b"], "properties": {"a": rating, "b": rating, "n": {"type": "integer"}}},
        {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "boolean"}, "y": {"type": "array", "items": {"type": "null"}}}}},
        {"type": "object", "required": ["t"], "properties": {"t": {"type": "string", "minLength": 2}}},
    ]
    value = lambda: r.choice([None, True, 1, "good", "", "x", [], {}, ["a"], ["a", "b", ""], [1]])
    rated = lambda: r.choice([value(), {"rating": r.choice(["good", None, 1, 2, "no"]), "evidence": r.choice([[], ["a"], ["a", "b", "c"], ["", 1], "x"])}, {"rating": "bad"}, {"rating": "good", "evidence": [], "extra": 0}])
    docs = [{k: rated() for k in r.sample(["a", "b", "n", "z"], r.randrange(5))} for _ in range(60)] + [[{"x": value(), "y": value()} for _ in range(r.randrange(3))] for _ in range(40)] + [{"t": value()} for _ in range(30)] + [value() for _ in range(20)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{"), (-2, None)], "i int, j string").repartition(3)
    for spec in specs:
        got = sorted((int(x.key), x.detail) for x in P.schema_violations(df, ["i"], "j", spec).collect())
        assert got == sorted([(i, w) for i, d in enumerate(docs) for w in walk(d, spec)] + [(-1, "$: no JSON"), (-2, "$: no JSON")])


def test_aliases_that_do_not_tell_teams_apart(spark):
    df = spark.createDataFrame([("A", "FC A"), ("A", "fc a"), ("B", "Bee"), ("C", "BEE"), ("C", "See")], "team string, alias string")
    assert sorted((r.key, r.detail) for r in P.alias_violations(df).collect()) == [("bee", "B,C"), ("fc a", "A")]


@pytest.mark.parametrize("size", [1, 37, 500])
def test_sample_equals_pythons(spark, size):
    ids = [f"t{i * 7919 % 1000:03d}é{i}" for i in range(500)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "task_id string, i int").repartition(7)
    got = [r.task_id for r in P.seeded_sample(df, "task_id", 42, size).orderBy("ordinal").collect()]
    assert got == random.Random(42).sample(sorted(ids), size)
    assert [r.task_id for r in P.positions(df, "task_id").orderBy("position").collect()] == sorted(ids)
    with pytest.raises(ValueError):
        P.seeded_sample(df, "task_id", 42, 501)


def test_results_of_one_configuration(spark):
    context = ", ".join(f"{c} string" for c in P.CONTEXT)
    one = lambda i, **k: tuple({**{c: f"{c}{i}" for c in P.CONTEXT}, **k}[c] for c in P.CONTEXT)
    tasks = spark.createDataFrame([(f"t{i}", *one(i)) for i in range(5)], f"task_id string, {context}")
    rows = [("a0", "t0", "m", "d", "x", *one(0)), ("a1", "t1", "m", "d", "x", *one(1, side="other")), ("a1", "t2", "m", "e", "x", *one(2)), ("a3", "t9", "m", "d", "x", *one(9)), ("a4", "t0", "m", "d", "x", *one(0)), ("a5", "t3", "n", "d", "y", *one(3))]
    results = spark.createDataFrame(rows, f"annotation_id string, task_id string, model string, model_digest string, annotation_config_sha256 string, {context}")
    got = sorted((r.check, r.key, r.detail) for r in P.result_violations(P.selected(results, "x"), tasks).collect())
    assert got == [("annotation id", "a1", "2"), ("context", "t1", "side"), ("provenance", "model_digest", "2"), ("task", "t0", "2"), ("unknown task", "t9", "only left")]
    assert P.report_violations(results, {"model": "m", "annotation_config_sha256": "x"}, ["annotation_id"]).count() == 2
    answers = spark.createDataFrame([("t0", '{"i":{"rating":"good","evidence":["e"]}}', None, 1), ("t1", None, "bad", 1), ("t1", None, "worse", 2)], "task_id string, answer string, error string, attempt int")
    good, failed = P.annotation_rows(tasks, answers, {"annotation_config_sha256": "x", "model_digest": "d"}, ["i"])
    g = good.first()
    assert (g.task_id, g.i_rating, g.i_evidence, g.side) == ("t0", "good", ["e"], "side0") and g.annotation_id == hashlib.sha256(b'[1,"t0","x","d"]').hexdigest()
    assert sorted((r.task_id, r.error, r.failure_sequence) for r in failed.collect()) == [("t1", "bad", 1), ("t1", "worse", 2)]


def test_mixed_encodings(spark, tmp_path):
    every = bytes(b for b in range(1, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
    texts = {"a": every, "b": "\ufeffTor für Köln €".encode(), "c": "Tor für Köln €".encode("cp1252"), "d": b"plain", "e": b""}
    for n, b in texts.items():
        (tmp_path / n).write_bytes(b)
    got = {r.path[-1]: (r.encoding, r.text) for r in files.read_text(spark, str(tmp_path)).collect()}
    assert got == {"a": ("cp1252", every.decode("cp1252")), "b": ("utf-8", "Tor für Köln €"), "c": ("cp1252", "Tor für Köln €"), "d": ("utf-8", "plain")}
    (tmp_path / "f").write_bytes(b"\x81\xff")
    with pytest.raises(Exception, match="neither encoding"):
        files.read_text(spark, str(tmp_path)).collect()
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "one.csv").write_bytes("Date, Team\r\n01/08/2025,\"Köln, 1. FC\"\r\n,\r\n".encode("cp1252"))
    (folder / "two.csv").write_bytes("\ufeffDate, Team\n02/08/2025,Fürth\n".encode())
    assert sorted((r.Date, r.Team) for r in files.read_mixed_csv(spark, str(folder), ("Team",)).collect()) == [("01/08/2025", "Köln, 1. FC"), ("02/08/2025", "Fürth")]
    with pytest.raises(ValueError, match="missing"):
        files.read_mixed_csv(spark, str(folder), ("Away",))
    (folder / "three.csv").write_text("Other\n1\n")
    with pytest.raises(ValueError, match="different headers"):
        files.read_mixed_csv(spark, str(folder))
