"""Commands over the engine: ``python -m plangrove.cli <command> ...``; every result is printed or written where ``--out`` says."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commands that are one registered query over a folder of tables.
QUERIES = {
    "status": "disposition_accounting", "inventory-report": "inventory_coverage", "duplicates": "keep_one_duplicates", "split": "split_bucket_80_10_10", "manifest": "release_manifest",
    "constraints": "adjacency_mining", "baseline": "cooccurrence_fit", "evaluate": "adjacency_l1", "generalization": "seen_unseen_split", "dwelling": "dwelling_macro", "sweep": "guarded_argmin",
    "experiments": "seed_aggregate", "gate-score": "gate_precision_recall", "legal": "legal_rules", "integrity": "integrity_rules",
}


def _shown(df: DataFrame, args) -> None:
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
        return
    for r in df.limit(args.limit).toJSON().toLocalIterator():
        print(r)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plangrove")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--out")
        p.add_argument("--limit", type=int, default=100)
        return p

    for name, query in QUERIES.items():
        add(name, f"the query {query}").add_argument("folder")
    run = add("run", "any registered query")
    run.add_argument("query")
    run.add_argument("folder")
    inventory = add("inventory", "entries of a folder of archives as rows")
    inventory.add_argument("root")
    release = add("release", "freezes a release from records and a recipe")
    release.add_argument("version")
    release.add_argument("--records", required=True)
    release.add_argument("--recipes")
    release.add_argument("--folder", required=True)
    add("doctor", "what the engine runs on")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    from . import registry
    from .operators import manifest
    from .session import local_session
    from .sources import archive, documents

    args = parser().parse_args(argv)
    spark = spark or local_session(cores=os.cpu_count() or 4)
    registry.load_all()
    if args.command in QUERIES or args.command == "run":
        _shown(registry.QUERIES[QUERIES.get(args.command) or args.query](spark, args.folder), args)
    elif args.command == "inventory":
        archive.register(spark)
        _shown(spark.read.format("zip_entries").load(f"{args.root.rstrip('/')}/*.zip"), args)
    elif args.command == "release":
        records = spark.read.parquet(args.records)
        rows, left_out = manifest.freeze(records, manifest.load_recipe(args.version, folder=args.recipes))
        documents.write_release(rows.withColumn("version", F.lit(args.version)), args.folder)
        _shown(manifest.release_counts(rows), args)
        for r in left_out.toLocalIterator():
            print(json.dumps(r.asDict()))
    else:
        print(json.dumps(manifest.environment(spark)))


if __name__ == "__main__":
    main()
