"""Command line: ``config`` prints a configuration, ``extract`` runs one."""

from __future__ import annotations

import argparse
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framespark")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("config", help="print a configuration in YAML")
    c.add_argument("features")
    c.add_argument("--pitch", choices=["kaldi", "crepe"])
    for flag in ("cmvn", "delta", "vtln", "no-comments"):
        c.add_argument(f"--{flag}", action="store_true")
    e = sub.add_parser("extract", help="extract features of utterances")
    e.add_argument("config")
    e.add_argument("utterances", help="text file of utterances")
    e.add_argument("audio", help="folder of WAV files that the index names")
    e.add_argument("output")
    e.add_argument("--format", help="parquet, csv, npz or ark; by the extension of output if not given")
    return top


def main(argv: list[str] | None = None) -> int:
    from framespark.plans import pipeline

    args = parser().parse_args(argv)
    try:
        if args.command == "config":
            print(pipeline.to_yaml(pipeline.default_config(args.features, args.pitch or False, args.cmvn, args.delta, args.vtln), not args.no_comments), end="")
            return 0
        import os

        from pyspark.sql import functions as F

        from framespark.plans.cuts import cut
        from framespark.plans.session import local_session
        from framespark.sources import audio_files, collections, texts

        for path in (args.config, args.utterances, args.audio):
            if not os.path.exists(path):
                raise FileNotFoundError(f"{path} not found")
        if os.path.exists(args.output):
            raise FileExistsError(f"{args.output} already exists")
        spark = local_session()
        root = "file:" + os.path.abspath(args.audio).rstrip("/") + "/"
        signals = audio_files.load(spark, args.audio).withColumn("file", F.replace("file", F.lit(root), F.lit("")))
        out = cut(pipeline.extract_features(spark, args.config, texts.load_utterances(spark, args.utterances), signals), "extracted")
        collections.save(out, args.output, args.format, pipeline.properties_of(args.config, out))
        return 0
    except (ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
