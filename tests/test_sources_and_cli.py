import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.functions import integrity, stats, text
from evidentia.operators import census, gates, records
from evidentia.sources import records as sources
from evidentia.streaming import calls


def package(item, condition="text_only", question="What?", **more):
    evidence = {"text": "plain evidence"}
    if condition != "text_only":
        evidence["layout"] = {"nodes": ["a", "b"], "edges": [["a", "b"]]}
    return {"schema": "x.condition-package.v1", "item_id": item, "condition": condition, "question": question, "evidence": evidence} | more


@pytest.fixture
def run_dir(tmp_path):
    (tmp_path / "packages/deep").mkdir(parents=True)
    for k, (item, condition) in enumerate([("i1", "text_only"), ("i1", "text_layout"), ("i2", "text_only")]):
        (tmp_path / f"packages/{'deep/' if k else ''}{k}.json").write_text(json.dumps(package(item, condition)))
    (tmp_path / "config.json").write_text(json.dumps({"schema": "x.run-config.v1", "name": "n", "packages": "packages", "output": "out/summary.json", "mode": "offline", "conditions": ["text_only"]}))
    return tmp_path


def test_run_verify_export(spark, run_dir, capsys):
    assert cli.validate(spark, str(run_dir / "packages"), "x") == {"status": "PASS", "package_count": 3}
    assert cli.run(spark, str(run_dir / "config.json"))["record_count"] == 2
    out = str(run_dir / "out/summary.json")
    with pytest.raises(ValueError, match="missing|RUN"):
        (run_dir / "packages/new.json").write_text(json.dumps(package("i3")))
        cli.verify_run(spark, out, str(run_dir / "packages"))
    (run_dir / "packages/new.json").unlink()
    assert cli.verify_run(spark, out, str(run_dir / "packages"))["status"] == "PASS"
    done = cli.export_dataset(spark, out, str(run_dir / "data.jsonl"))
    raw = (run_dir / "data.jsonl").read_text()
    assert done["record_count"] == len(raw.splitlines()) == 2 and done["dataset_sha256"] == integrity.receipt(raw)
    tampered = json.loads((run_dir / "out/summary.json").read_text())
    tampered["records"][0]["answer"] = "other"
    (run_dir / "out/summary.json").write_text(json.dumps(tampered))
    with pytest.raises(ValueError, match="receipt"):
        cli.verify_run(spark, out)


@pytest.mark.parametrize("change, reason", [({"extra": 1}, "unknown"), ({"condition": "blind"}, "condition"), ({"question": " "}, "question"), ({"item_id": "i2"}, "duplicate identity"), ({"schema": "y.condition-package.v1"}, "schema"), ({"question": "see /home/x"}, "unsafe")])
def test_folder_fails_closed(spark, run_dir, change, reason):
    (run_dir / "packages/0.json").write_text(json.dumps(package("i1") | change))
    with pytest.raises(ValueError, match=reason):
        cli.validate(spark, str(run_dir / "packages"), "x")


def test_commands_exit_with_0_or_2(spark, run_dir, capsys):
    assert cli.main(["validate", str(run_dir / "packages")]) == 0 and json.loads(capsys.readouterr().out)["status"] == "PASS"
    (run_dir / "empty").mkdir()
    assert cli.main(["validate", str(run_dir / "empty")]) == 2 and json.loads(capsys.readouterr().out)["status"] == "FAIL"
    (run_dir / "r.txt").write_text(': c\nevent: x\ndata: {"a": 1}\n\ndata: [{"b": 2}]\n\ndata: [DONE]\n')
    assert cli.main(["parse", str(run_dir / "r.txt"), "--content-type", "text/event-stream"]) == 0
    assert json.loads(capsys.readouterr().out)["records"] == [{"a": 1}, {"b": 2}]
    (run_dir / "r.txt").write_text("nonsense")
    assert cli.main(["parse", str(run_dir / "r.txt"), "--content-type", "text/event-stream"]) == 2


@pytest.mark.parametrize("change", [{"more": 1}, {"mode": "x"}, {"conditions": []}, {"conditions": ["text_only", "text_only"]}, {"timeout_seconds": 0}, {"timeout_seconds": True}, {"mode": "openai-compatible"}, {"name": " "}])
def test_config_is_closed(run_dir, change):
    path = run_dir / "config.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | change))
    with pytest.raises(ValueError, match="CONFIG"):
        cli.load_config(str(path))


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,x\n1,a\n2,b\n".encode())
    df = sources.ratings(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "x"] and df.count() == 2
    (tmp_path / "rows.json").write_text(json.dumps({"rows": {"r1": {"n": 1}, "r2": {"n": 2}}}))
    from pyspark.sql import types as T

    assert {tuple(r) for r in sources.keyed_rows(spark, str(tmp_path / "rows.json"), T.StructType([T.StructField("n", T.LongType())])).collect()} == {("r1", 1), ("r2", 2)}
    (tmp_path / "l.jsonl").write_text('{"n": 1}\n{bad\n{"n": 3}\n')
    kind = T.StructType([T.StructField("n", T.LongType())])
    assert [r.n for r in sources.json_lines(spark, str(tmp_path / "l.jsonl"), kind, tolerant=True).collect()] == [1, 3]
    with pytest.raises(Exception):
        sources.json_lines(spark, str(tmp_path / "l.jsonl"), kind).collect()
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.bin").write_bytes(b"abc")
    got = sources.hashed_files(spark, str(tmp_path / "b")).first()
    assert (got.bytes, got.sha256) == (3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")


def test_streams(spark, tmp_path):
    rows = [("k1", "2024-01-01 00:10:00", "a"), ("k1", "2024-01-01 00:20:00", "a"), ("k2", "2024-01-01 01:10:00", "b")]
    spark.createDataFrame(rows, "key string, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("key string, ts timestamp, kind string").parquet(f"{tmp_path}/in")
    for name, df, mode in (("once", calls.distinct_terminals(stream(), "key", "ts"), "append"), ("windows", calls.calls_per_window(stream(), "ts", "kind"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("once").count() == 2 and {(r.kind, r.calls) for r in spark.table("windows").collect()} == {("a", 2), ("b", 1)}


def test_text_is_normalised(spark):
    one = spark.createDataFrame([("Straße éA_b ",), (None,)], "x string")
    got = one.select(text.nfc(F.col("x")).alias("n"), text.tokens(F.col("x")).alias("t"), text.word_run(F.col("x")).alias("w"), text.strip(F.col("x")).alias("s"), text.strip_marks(F.col("x")).alias("m")).collect()
    assert got[0].n == "Straße éA_b " and got[0].t == ["straße", "éa", "b"] and got[0].s.endswith("b") and "́" not in got[0].m
    assert got[0].w[0] == "strasse" and all(v is None for v in got[1])


def test_published_statistics(spark):
    p = spark.createDataFrame([(20, 2, 0.000121), (21, 3, 0.000277), (16, 2, 0.001312), (0, 0, 1.0)], "b long, c long, p double")
    assert all(r.p == r.q for r in p.select("p", F.round(stats.binomial_two_sided("b", "c"), 6).alias("q")).collect())
    f = spark.createDataFrame([(33, 24, 64, 104, 0.012908), (34, 23, 71, 97, 0.031059)], "a long, b long, c long, d long, p double")
    assert all(r.p == r.q for r in f.select("p", F.round(stats.fisher_two_sided("a", "b", "c", "d"), 6).alias("q")).collect())
    big = spark.createDataFrame([(200_000, 199_000, 60_000, 59_000)], "a long, b long, c long, d long").select(stats.fisher_two_sided("a", "b", "c", "d").alias("p"), stats.binomial_two_sided("a", "b").alias("q")).first()
    assert 0 < big.p <= 1 and 0 < big.q <= 1
    assert stats.clopper_pearson_interval(31, 437) == pytest.approx((0.048704858507320856, 0.0991823168362104), abs=1e-12)
    for k, n in ((1, 0), (-1, 3), (4, 3), (True, 3)):
        with pytest.raises(ValueError, match="BLOCKED"):
            stats.clopper_pearson_strict(k, n)
    assert [stats.least_discordance(a) for a in (0.05, 0.01)] == [6, 8]


def test_clustered_bootstrap_is_the_plain_one():
    import random

    r = random.Random(3)
    a, b = [r.random() for _ in range(30)], [r.random() for _ in range(30)]
    c = [f"c{r.randrange(6)}" for _ in range(30)]
    got = stats.clustered_bootstrap(a, b, c, seed=5, resamples=200)
    blocks: dict[str, list] = {}
    for x, y, z in zip(a, b, c):
        blocks.setdefault(z, []).append(x - y)
    own, rng, draws = list(blocks.values()), random.Random(5), []
    for _ in range(200):
        pooled = [v for i in [rng.randrange(len(own)) for _ in own] for v in own[i]]
        draws.append(sum(pooled) / len(pooled))
    assert got["mean"] == pytest.approx(np.mean(draws)) and got["low"] == pytest.approx(np.percentile(draws, 2.5))
    with pytest.raises(ValueError, match="clusters"):
        stats.clustered_bootstrap(a, b, ["one"] * 30, seed=1)


def test_shuffle_and_labels(spark):
    one = spark.createDataFrame([(4, 7)], "n int, seed long").select(gates.shuffled(F.col("n"), F.col("seed")).alias("a")).first().a
    x, order = 7, list(range(4))
    for i in (3, 2, 1):
        x = (1664525 * x + 1013904223) % 2**32
        order[i], order[x % (i + 1)] = order[x % (i + 1)], order[i]
    assert one == order
    labels = spark.createDataFrame([("  H₂O  007.50 ",), ("-0.0",), ("x′",)], "x string").select(gates.label_key(F.col("x")).alias("k")).collect()
    assert [r.k for r in labels] == ["H2O 7.5", "0", "x'"]


def test_sentence_spans_slice_the_source(spark):
    body = "First sentence is long enough here. Second sentence is long enough too!\nFirst sentence is long enough here."
    df = spark.createDataFrame([(body,)], "x string")
    for s in df.select(gates.spans(text.sentences(F.col("x")), F.col("x")).alias("s")).first().s:
        assert body[s.start : s.end].strip() == body[s.start : s.end] and len(body[s.start : s.end]) >= 25
    starts = [s.start for s in df.select(gates.spans(text.sentences(F.col("x")), F.col("x")).alias("s")).first().s]
    assert starts == sorted(set(starts)) and len(starts) == 3


def test_dig_takes_the_longest_key():
    assert census.dig({"a.b": {"c": 1}, "a": {"b": 2}}, "a.b.c") == 1
    with pytest.raises(KeyError):
        census.dig({"a": 1}, "a.b")


def test_null_records_have_reasons(spark):
    df = spark.createDataFrame([(None,), ("",), ("[]",), ("{}",), ('{"abstain": true, "answer_index": null, "confidence": 1}',)], "j string")
    got = [r.r for r in df.select(records.answer_reason(F.col("j")).alias("r")).collect()]
    assert got == ["not_object"] * 3 + ["keys", None]
