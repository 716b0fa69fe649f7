"""Command line: ``python -m gleanery.cli scan PATH``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace

from gleanery import __version__
from gleanery.config import clamp, load_config


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanery", description="Health of a document corpus.")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan", help="scan the files below a directory")
    s.add_argument("path")
    s.add_argument("--config")
    s.add_argument("--exclude", action="append", default=[])
    s.add_argument("--format", choices=["terminal", "html", "json", "csv", "sarif", "junit"], default="terminal")
    s.add_argument("-o", "--output")
    s.add_argument("--sampling-rate", type=float)
    s.add_argument("--show-pii-samples", action="store_true")
    s.add_argument("--pii-min-confidence", type=float)
    s.add_argument("--seed", type=int)
    sub.add_parser("serve", help="read commands and write events as lines of JSON")
    return p


def configured(args: argparse.Namespace):
    """The file's settings, overruled by the command line's; rates out of range are clamped with a warning."""
    config = load_config(args.path, args.config).with_excludes(*args.exclude)
    for name, value in (("sampling_rate", args.sampling_rate), ("pii_min_confidence", args.pii_min_confidence)):
        if value is not None:
            if value != clamp(value):
                print(f"warning: {name} {value} is set to {clamp(value)}", file=sys.stderr)
            config = replace(config, **{name: clamp(value)})
    if args.sampling_rate is not None:
        config = replace(config, sampling_rate_auto=False)
    if args.seed is not None:
        config = replace(config, seed=args.seed)
    return replace(config, show_pii_samples=config.show_pii_samples or args.show_pii_samples)


def main(argv: list[str] | None = None, spark=None) -> int:
    """0: clean or empty; 1: a limit is reached; 2: bad path, bad output folder or interrupted."""
    args = parser().parse_args(argv)
    if args.command == "serve":
        from gleanery.sidecar import serve

        return serve(sys.stdin, sys.stdout)
    if not os.path.isdir(args.path):
        print(f"error: {args.path} is not a directory", file=sys.stderr)
        return 2
    if args.output and not os.path.isdir(os.path.dirname(os.path.abspath(args.output))):
        print(f"error: the folder of {args.output} is not there", file=sys.stderr)
        return 2
    from gleanery.plans.scan import scan_directory
    from gleanery.report import render
    from gleanery.session import local_session

    try:
        report = scan_directory(spark or local_session(), args.path, configured(args))
        if report.empty:
            print("No files found.")
            return 0
        text = render.generate(report, args.format, args.output)
        if text:
            print(text, end="")
        code, messages = render.exit_code(report)
        report.close()
    except KeyboardInterrupt:
        return 2
    for m in messages:
        print(f"limit reached: {m}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
