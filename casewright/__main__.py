"""Command line: python -m casewright COMMAND ... Every path is any that Spark can read or write."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import scoring
from casewright.operators import builders, layout, locks, probes
from casewright.plans import analysis
from casewright.sources import files

CORE = "struct<decision: string, risk_level: string, need_human: boolean, reason_codes: array<string>>"
ANSWERS = f"sample_id string, prompt_exposure string, position int, hard_tags array<string>, ablation_type string, mutation_type string, prediction string, gold {CORE}"
PANEL = f"skill string, case string, family string, condition string, endpoint string, completion string, gold {CORE}"
RECORDS = "case_id string, context_load string, checkpoint_id string, rule_family string, cosine map<string, map<string, double>>"


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="casewright")
    add = top.add_subparsers(dest="command", required=True).add_parser

    def command(name: str, *options: tuple, **defaults) -> None:
        sub = add(name)
        for flag, kind in options:
            if kind is list:
                sub.add_argument(flag, action="append", required=True)
            else:
                sub.add_argument(flag, type=kind, default=defaults.get(flag.strip("-").replace("-", "_")), required=flag.strip("-").replace("-", "_") not in defaults)

    seeded = dict(seed=42)
    command("generate", ("--output-dir", str), ("--sample-count", int), ("--seed", int), **seeded)
    command("mix", ("--method", str), ("--records", int), ("--seed", int), ("--output", str), **seeded)
    command("targeted", ("--records", int), ("--seed", int), ("--output", str), **seeded)
    command("ablation", ("--records", int), ("--seed", int), ("--output", str), **seeded)
    command("causal", ("--records", int), ("--seed", int), ("--output-dir", str), **seeded)
    command("replay", ("--records", int), ("--stage-size", int), ("--seed", int), ("--output", str), **seeded)
    command("bundle", ("--output-dir", str))
    command("export", ("--source", str), ("--output", str))
    command("evaluate", ("--predictions", str), ("--output", str))
    command("rewards", ("--model", list), ("--output", str))
    command("ablation-summary", ("--model", list), ("--output", str))
    command("analyze", ("--predictions", str), ("--output", str), ("--draws", int), draws=10_000)
    command("vectors", ("--records", str), ("--output", str))
    command("scan", ("--root", str))
    command("probe", ("--records", str), ("--cases", str), ("--most", int), ("--output", str), cases="", most=None)
    command("checkpoints", ("--root", str), ("--checkpoint", list), ("--exposures", int), ("--output", str), exposures=len(probes.EXPOSURES))
    command("lock", ("--cases", str), ("--output", str))
    command("smoke", ("--cases", str), ("--output", str))
    return top


def _answers(df: DataFrame) -> DataFrame:
    return scoring.score_answers(scoring.read_answers(df))


def run(spark: SparkSession, argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if getattr(a, "records", 1) in (0,) or (isinstance(getattr(a, "records", 1), int) and getattr(a, "records", 1) < 0):
        raise SystemExit("the number of records must be positive")
    samples = lambda n: builders.generate_samples(spark, n, a.seed)
    match a.command:
        case "generate":
            sets = builders.export_sets(samples(a.sample_count), a.seed)
            for name, df in sets.items():
                files.write_jsonl(df, f"{a.output_dir}/{name}", "position" if "position" in df.columns else None)
        case "mix":
            files.write_jsonl(builders.exposure_mix(samples(a.records), a.method, a.records, a.seed), a.output, "position")
        case "targeted":
            files.write_jsonl(builders.targeted_samples(spark, a.records, a.seed), a.output, "position")
        case "ablation":
            files.write_jsonl(builders.ablation_eval(samples(a.records)), a.output)
        case "causal":
            for name, df in builders.causal_variants(samples(a.records), a.records, a.seed).items():
                files.write_jsonl(df, f"{a.output_dir}/{name}", "position")
        case "replay":
            files.write_jsonl(builders.replay_stages(samples(a.records), a.stage_size, a.seed), a.output, "position")
        case "bundle":
            cases = None
            for skill in builders.CASES:
                part = builders.skill_cases(spark, skill)
                cases = part if cases is None else cases.unionByName(part)
            arms, requests = builders.training_arms(cases), builders.eval_requests(cases)
            for name, df in (("cases", cases), ("arms", arms), ("requests", requests), ("factorial", builders.factorial_requests(cases))):
                files.write_jsonl(df, f"{a.output_dir}/{name}")
            errors = builders.bundle_errors(cases, arms, requests).collect()
            files.write_json(spark, {"errors": [list(e) for e in errors]}, f"{a.output_dir}/report")
            return 2 if errors else 0
        case "export":
            rows = spark.read.json(a.source)
            files.write_jsonl(rows.select("messages"), a.output)
        case "evaluate":
            by = scoring.metrics(_answers(files.read_jsonl(spark, a.predictions, ANSWERS)), "prompt_exposure")
            files.write_text(spark, files.report("Evaluation", {"By exposure": by}), a.output)
        case "rewards" | "ablation-summary":
            rows = _answers(files.read_tagged(spark, dict(map(files.parse_tagged, a.model)), ANSWERS))
            if a.command == "rewards":
                keyed = rows.withColumn("sample_id", F.concat_ws("|", "model", "sample_id"))
                done = scoring.rewards(keyed).groupBy("model").agg(*(F.avg(c).alias(c) for c in [*scoring.WEIGHTS, "total_reward"])).orderBy(F.desc("total_reward"))
                files.write_text(spark, files.report("Rewards", {"Models": done}), a.output)
            else:
                groups = scoring.metrics(rows, "model", "ablation_type", "prompt_exposure", "mutation_type")
                files.write_text(spark, files.report("Ablations", {"Groups": groups}), a.output)
        case "analyze":
            path = files.reject_protected(a.predictions)
            panel = analysis.from_predictions(files.read_jsonl(spark, path, PANEL)).cache()
            tables = analysis.analyse(panel, a.draws)
            files.write_text(spark, files.report("Analysis", tables), a.output)
            return 2 if tables["decision"].first()["state"] == "DATA_INVALID" else 0
        case "vectors":
            tables = analysis.vector_summary(files.read_jsonl(spark, a.records, RECORDS))
            files.write_text(spark, files.report("Vectors", tables), a.output)
        case "probe":
            rows = spark.read.json(a.records)
            listed = spark.createDataFrame(list(enumerate(a.cases.split(","))), "place long, case_id string") if a.cases else None
            files.write_jsonl(probes.select_probe(rows, listed, a.most), a.output, "position")
        case "checkpoints":
            expected = {name: int(n) for name, _, n in (x.partition("=") for x in a.checkpoint)}
            rows = files.read_checkpoints(spark, a.root, expected, RECORDS, a.exposures, summaries=True)
            files.write_text(spark, files.report("Checkpoints", analysis.vector_summary(rows)), a.output)
        case "lock":
            cases = spark.read.json(a.cases).withColumn("slot", F.col("slot") + 1)
            files.write_jsonl(locks.split_manifest(cases, "fields"), a.output)
        case "smoke":
            cases = spark.read.json(files.reject_protected(a.cases)).where("split = 'validation'")
            first = layout.ranked(cases, [F.col("slot")], ["skill_id"], "_place").where("_place <= 2").drop("_place")
            files.write_jsonl(builders.smoke_requests(first), a.output)
        case "scan":
            found = files.scan_release(spark, a.root).collect()
            print(*(f"{r['path']}:{r['line']}: {r['finding']}" for r in found), sep="\n")
            return 1 if found else 0
    return 0


if __name__ == "__main__":
    session = SparkSession.builder.appName("casewright").getOrCreate()
    try:
        raise SystemExit(run(session))
    finally:
        session.stop()
