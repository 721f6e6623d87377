"""Command line: python -m tallyframe.cli [options]. Usage problems exit 2, others 1."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass, field

from . import __version__
from .operators.lexicon import compile_lexicon, load_overrides
from .operators.since import parse_since
from .sources.files import parse_harness

USAGE = """tallyframe: how much do you swear at your coding agents?

Usage: tallyframe [options]

Options:
  --no-open              Print the link only
  --harness <list>       Limit to claude, codex, cursor (comma-separated)
  --since <date|span>    Only count prompts since 2026-01-01 or 30d
  --json                 Print the report's JSON and exit; nothing is published
  --lexicon <path>       Use another lexicon file
  --store <path>         Report store to publish to
  --state <path>         Keep what was read here, and read only what has changed
  --help                 Show this help
  --version              Show the version"""

# Names of options.
_BARE = {"--json": "json", "--no-open": "no_open", "--help": "help", "--version": "version"}
_VALUED = {"--since": "since", "--lexicon": "lexicon", "--store": "store", "--state": "state"}


class UsageError(ValueError):
    pass


@dataclass
class Args:
    json: bool = False
    no_open: bool = False
    help: bool = False
    version: bool = False
    harness_tokens: list[str] = field(default_factory=list)
    since: str | None = None
    lexicon: str | None = None
    store: str | None = None
    state: str | None = None


def parse(argv: list[str]) -> Args:
    """`--flag`, `--option=value` or `--option value`; no positional arguments."""
    # The texts of usage errors, here and in resolve_harnesses().
    args, rest = Args(), iter(argv)
    for arg in rest:
        if arg == "--":
            continue
        if not arg.startswith("-"):
            raise UsageError(f"Unexpected argument '{arg}'. This command does not take positional arguments")
        name, given, value = arg.partition("=")
        if name in _BARE:
            if given:
                raise UsageError(f"Option '{name}' does not take an argument")
            setattr(args, _BARE[name], True)
        elif name in _VALUED or name == "--harness":
            if not given:
                value = next(rest, None)
                if value is None:
                    raise UsageError(f"Option '{name} <value>' argument missing")
            if name == "--harness":
                args.harness_tokens.extend(value.split(","))
            else:
                setattr(args, _VALUED[name], value)
        else:
            raise UsageError(f"Unknown option '{name}'")
    return args


def resolve_harnesses(tokens: list[str]) -> list[str]:
    for t in tokens:
        if parse_harness(t) is None:
            raise UsageError(f"unknown harness: {t.strip().lower()}")
    return [parse_harness(t) for t in tokens]


def run(argv: list[str], spark=None, home: str | None = None) -> str:
    """What the command prints. Arguments are checked before Spark starts."""
    args = parse(argv)
    if args.help:
        return USAGE
    if args.version:
        return f"tallyframe {__version__}"
    harnesses = resolve_harnesses(args.harness_tokens)
    cutoff = parse_since(args.since) if args.since is not None else None
    lexicon = compile_lexicon(load_overrides(args.lexicon))

    from pyspark.sql import SparkSession

    from .operators.report import release, to_json
    from .plans.incremental import incremental_report
    from .plans.scan import report_for
    from .sources import store

    spark = spark or SparkSession.builder.appName("tallyframe").getOrCreate()
    own = home or os.path.expanduser("~")

    def progress(done: int, files: int, size: int) -> None:
        """One line that is written over until all is read."""
        print(f"\rread {done} of {files} files, {size / 1e6:.1f} MB", end="\n" if done == files else "", file=sys.stderr, flush=True)

    asked = {"harnesses": harnesses or None, "cutoff_ms": cutoff, "lexicon": lexicon, "version": __version__, "user_home": own, "on_progress": None if args.json else progress}
    whole = incremental_report(spark, own, args.state, **asked) if args.state else report_for(spark, own, **asked)
    body = to_json(whole).first()[0]
    release(whole)
    if args.json:
        return body
    url = os.environ.get("TALLYFRAME_HOST")
    if url and not args.store:
        done = store.send(url, body.encode())
    else:
        done = store.publish(spark, args.store or f"{own}/.tallyframe/reports", body.encode())
    return f"{done['url']}\nAnyone with the link can read it. It expires in {done['expires_in_days']} days."


def main() -> int:
    try:
        print(run(sys.argv[1:]))
    except UsageError as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
