"""python -m millrace.cli validate CONFIG | sync CONFIG SOURCE | ask CONFIG QUESTION"""

from __future__ import annotations

import argparse
import sys

from millrace.sources import config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, extra in (("validate", ()), ("sync", ("source",)), ("ask", ("question",))):
        sub = commands.add_parser(name)
        sub.add_argument("config")
        for e in extra:
            sub.add_argument(e)
    args = parser.parse_args(argv)
    try:
        settings = config.load(args.config)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "validate":
        print(f"{len(settings.get('sources', []))} sources, {len(settings.get('extractors', []))} extractors: valid")
        return 0
    from pyspark.sql import SparkSession

    from millrace.api import Engine

    spark = SparkSession.builder.appName("millrace").getOrCreate()
    engine = Engine(spark, ((settings.get("core") or {}).get("storage") or {}).get("path", "millrace-data"), chunker=config.chunker(settings))
    if args.command == "sync":
        own = next((s for s in settings.get("sources", []) if s["id"] == args.source), None)
        if own is None:
            print(f"no source {args.source!r}", file=sys.stderr)
            return 2
        held = engine.sources().where(f"name = '{own['id']}'").first()
        id_ = held["source_id"] if held else engine.add_source(own["plugin"], own["id"], folder_path=(own.get("config") or {}).get("path"), file_patterns=(own.get("config") or {}).get("include"))
        engine.sync(id_).groupBy("operation").count().show()
    else:
        print(engine.rag_ask(args.question)["context"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
