"""Command line over folders of records: each command prints a JSON status and exits with 0, or with 2 if something fails.

    python -m evidentia.cli validate FOLDER
    python -m evidentia.cli validate-items FOLDER
    python -m evidentia.cli parse FILE [--content-type TYPE]
    python -m evidentia.cli run CONFIG
    python -m evidentia.cli verify-run SUMMARY [--packages FOLDER]
    python -m evidentia.cli export-dataset SUMMARY OUTPUT
    python -m evidentia.cli generate DOCUMENT OUTPUT [--replace]
    python -m evidentia.cli validate-generated OUTPUT [--source DOCUMENT]
    python -m evidentia.cli validate-construction RECORD
    python -m evidentia.cli validate-real-inventory INVENTORY     (2 also if it is BLOCKED)
    python -m evidentia.cli adjudicated-statistics RESULTS OUTPUT --validation FILE --adjudication FILE [--methods A,B,C]

`run` has the offline mode alone: it gives a constant answer and calls nothing. --prefix is what stands
before the kind in the records' schemas.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import artifacts
from .functions import integrity
from .operators import contracts, records, runs
from .sources import records as sources

CONFIG = {"schema", "name", "packages", "output", "mode", "endpoint", "model", "api_key_env", "conditions", "timeout_seconds"}
SUMMARY = {"schema", "name", "mode", "config_sha256", "record_count", "records", "summary_sha256"}
OFFLINE = "[offline answer]"
MOST_RESPONSE = 10_000_000
MORE = [("generate", "document", "output"), ("validate-generated", "output"), ("validate-construction", "record"), ("validate-real-inventory", "inventory"), ("adjudicated-statistics", "results", "output")]


def session() -> SparkSession:
    spark = SparkSession.builder.appName("evidentia").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def folder(spark: SparkSession, path: str, kind: str, key: list[str], prefix: str | None) -> DataFrame:
    """path, text, the key's fields and the receipt of every record below a folder; the first fault in path order is an error."""
    if not Path(path).is_dir():
        raise ValueError(f"not a folder: {path}")
    files = sources.json_files(spark, Path(path).absolute().as_uri())
    rows = contracts.validate(files, kind, prefix=prefix)
    rows = rows.withColumn("path", F.replace("path", F.lit(Path(path).absolute().as_uri() + "/"), F.lit("")))
    rows = rows.select("path", "text", "reason", *[F.get_json_object("text", f"$.{k}").alias(k) for k in key], integrity.json_receipt("text").alias("sha256"))
    first = rows.filter("reason IS NOT NULL").orderBy("path").select("path", "reason").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].path}: {first[0].reason}")
    twice = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(*key).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate identity: {tuple(twice[0][:-1])}")
    if not rows.limit(1).count():
        raise ValueError("no JSON files")
    return rows


def validate(spark: SparkSession, path: str, prefix: str | None = None) -> dict:
    rows = folder(spark, path, "package", ["item_id", "condition"], prefix)
    return {"status": "PASS", "package_count": rows.count()}


def validate_items(spark: SparkSession, path: str, prefix: str | None = None) -> dict:
    rows = folder(spark, path, "constructed_item", ["item_id"], prefix)
    return {"status": "PASS", "item_count": rows.count()}


def parse_response(payload: str, content_type: str = "application/json") -> list[dict]:
    """Records of a bounded response: a JSON object or list of objects, or an event stream of such."""
    if not isinstance(payload, str) or len(payload) > MOST_RESPONSE:
        raise ValueError("RESPONSE:not bounded text")
    if "text/event-stream" in content_type.lower():
        bodies = [body for _, body in sources.events_of(payload)]
    else:
        bodies = [payload]
    out: list[dict] = []
    for body in bodies:
        value = json.loads(body)
        out += value if isinstance(value, list) else [value]
    if any(not isinstance(x, dict) for x in out):
        raise ValueError("RESPONSE:records must be objects")
    return out


def load_config(path: str) -> tuple[dict, Path]:
    """The run's configuration with its defaults, and the folder that its paths start from."""
    cfg = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(cfg, dict) or set(cfg) - CONFIG:
        raise ValueError("CONFIG:fields")
    for k in ("schema", "name", "packages", "output", "mode"):
        if not isinstance(cfg.get(k), str) or not cfg[k].strip():
            raise ValueError(f"CONFIG:{k}")
    if cfg["mode"] not in ("offline", "openai-compatible"):
        raise ValueError("CONFIG:mode")
    known = list(contracts.CONDITIONS)
    cfg["conditions"] = cfg.get("conditions", known)
    if not isinstance(cfg["conditions"], list) or not cfg["conditions"] or len(set(map(str, cfg["conditions"]))) != len(cfg["conditions"]) or any(c not in known for c in cfg["conditions"]):
        raise ValueError("CONFIG:conditions")
    cfg["timeout_seconds"] = cfg.get("timeout_seconds", 60)
    if type(cfg["timeout_seconds"]) is not int or not 1 <= cfg["timeout_seconds"] <= 600:
        raise ValueError("CONFIG:timeout_seconds")
    if cfg["mode"] == "openai-compatible" and any(not isinstance(cfg.get(k), str) or not cfg[k].strip() for k in ("endpoint", "model", "api_key_env")):
        raise ValueError("CONFIG:endpoint, model and api_key_env are needed")
    return cfg, Path(path).resolve().parent


def run(spark: SparkSession, config: str, prefix: str | None = None) -> dict:
    cfg, base = load_config(config)
    if cfg["mode"] != "offline":
        raise ValueError("RUN:only the offline mode is built")
    rows = folder(spark, str(base / cfg["packages"]), "package", ["item_id", "condition"], prefix).filter(F.col("condition").isin(*cfg["conditions"]))
    kind = cfg["schema"].rsplit(".", 2)[0]
    answers = [{"schema": f"{kind}.answer.v1", "item_id": r.item_id, "condition": r.condition, "package_sha256": r.sha256, "answer": OFFLINE, "source": "offline"} for r in rows.select("item_id", "condition", "sha256").orderBy("item_id", "condition").collect()]
    if not answers:
        raise ValueError("RUN:no package of the conditions")
    summary = {"schema": f"{kind}.run-summary.v1", "name": cfg["name"], "mode": cfg["mode"], "config_sha256": integrity.receipt(cfg), "record_count": len(answers), "records": answers}
    summary["summary_sha256"] = integrity.receipt(summary)
    artifacts.write_atomic(base / cfg["output"], integrity.canonical_bytes(summary) + b"\n")
    return summary


def _summary(path: str) -> dict:
    s = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(s, dict) or set(s) != SUMMARY:
        raise ValueError("SUMMARY:fields")
    if integrity.receipt({k: v for k, v in s.items() if k != "summary_sha256"}) != s["summary_sha256"]:
        raise ValueError("SUMMARY:receipt")
    if not isinstance(s["records"], list) or s["record_count"] != len(s["records"]):
        raise ValueError("SUMMARY:record_count")
    return s


def verify_run(spark: SparkSession, path: str, packages: str | None = None, prefix: str | None = None) -> dict:
    """Receipt, count, every record's contract, and, with the packages, that each answer is to one of them and none is missing."""
    s = _summary(path)
    lines = [(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(s["records"])]
    rows = spark.createDataFrame(lines, "i int, text string")
    kind = s["schema"].rsplit(".", 2)[0]
    bad = rows.select("i", records.answer_record_reason(F.col("text"), f"{kind}.answer.v1").alias("reason")).filter("reason IS NOT NULL").orderBy("i").limit(1).collect()
    if bad:
        raise ValueError(f"RECORD {bad[0].i}:{bad[0].reason}")
    fields = ["item_id", "condition", "package_sha256"]
    answers = rows.select(*[F.get_json_object("text", f"$.{k}").alias(k) for k in fields])
    known = folder(spark, packages, "package", ["item_id", "condition"], prefix).select("item_id", "condition", F.col("sha256").alias("package_sha256")) if packages else answers.dropDuplicates(["item_id", "condition"])
    v = runs.run_verdict(answers, known, sorted({r["condition"] for r in s["records"]})).first()
    if v.status != "PASS":
        raise ValueError(f"RUN:{v.first_reason or f'{v.missing} answers missing'}")
    return {"status": "PASS", "summary_sha256": s["summary_sha256"], "record_count": s["record_count"]}


def export_dataset(spark: SparkSession, path: str, output: str) -> dict:
    """The verified records as canonical JSON lines; the digest is the receipt of the whole text as a JSON string."""
    count = verify_run(spark, path)["record_count"]
    raw = b"".join(integrity.canonical_bytes(r) + b"\n" for r in _summary(path)["records"])
    artifacts.write_atomic(Path(output), raw)
    return {"status": "PASS", "record_count": count, "dataset_sha256": integrity.receipt(raw.decode()), "output": output}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="evidentia")
    top.add_argument("--prefix", help="what stands before the kind in the records' schemas")
    sub = top.add_subparsers(dest="command", required=True)
    for name, *args in (("validate", "folder"), ("validate-items", "folder"), ("parse", "file"), ("run", "config"), ("verify-run", "summary"), ("export-dataset", "summary", "output"), *MORE):
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        if name == "parse":
            p.add_argument("--content-type", default="application/json")
        if name == "verify-run":
            p.add_argument("--packages")
        if name == "generate":
            p.add_argument("--replace", action="store_true")
        if name == "validate-generated":
            p.add_argument("--source")
        if name == "adjudicated-statistics":
            p.add_argument("--validation", required=True)
            p.add_argument("--adjudication", required=True)
            p.add_argument("--methods", default=",".join(artifacts.METHODS))
    a = top.parse_args(argv)
    try:
        if a.command == "parse":
            out = {"status": "PASS", "records": parse_response(Path(a.file).read_text(encoding="utf-8"), a.content_type)}
        elif a.command == "validate-real-inventory":
            out = artifacts.validate_inventory(a.inventory)
        else:
            spark = session()
            out = {
                "validate": lambda: validate(spark, a.folder, a.prefix), "validate-items": lambda: validate_items(spark, a.folder, a.prefix), "run": lambda: run(spark, a.config, a.prefix),
                "verify-run": lambda: verify_run(spark, a.summary, a.packages, a.prefix), "export-dataset": lambda: export_dataset(spark, a.summary, a.output),
                "generate": lambda: artifacts.generate(spark, a.document, a.output, a.replace), "validate-generated": lambda: artifacts.validate_generated(spark, a.output, a.source), "validate-construction": lambda: artifacts.validate_construction(spark, a.record, a.prefix),
                "adjudicated-statistics": lambda: artifacts.adjudicated_statistics(spark, a.results, a.output, a.validation, a.adjudication, a.methods.split(",")),
            }[a.command]()
    except (ValueError, OSError, KeyError, TypeError, PySparkException) as e:
        print(json.dumps({"status": "FAIL", "error": str(e)}))
        return 2
    print(json.dumps(out, ensure_ascii=False, indent=2))
    return 2 if out.get("status") == "BLOCKED" else 0


if __name__ == "__main__":
    sys.exit(main())
