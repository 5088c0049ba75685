"""python -m twinfold find | dedupe | version: the runs of twinfold.plans.api from a shell, on a local session."""

from __future__ import annotations

import argparse
import itertools
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame

from twinfold import __version__
from twinfold import schema as S
from twinfold.plans import api
from twinfold.plans.interactive import choose
from twinfold.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="twinfold", description="Find and remove duplicate files.")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    find = commands.add_parser("find", help="report duplicates")
    dedupe = commands.add_parser("dedupe", help="replace or delete duplicates")
    mode = find.add_mutually_exclusive_group()
    mode.add_argument("-H", "--hardlink", action="store_true", help="leave out names of one file")
    mode.add_argument("-l", "--listlink", action="store_true", help="list hard links only")
    mode.add_argument("-c", "--cow", action="store_true", help="list groups of equal content and what they share")
    action = dedupe.add_mutually_exclusive_group(required=True)
    for short, name in (("-d", S.DELETE), ("-H", S.HARDLINK), ("-c", S.COW)):
        action.add_argument(short, f"--{name}", dest="action", action="store_const", const=name)
    dedupe.add_argument("-r", "--rdonly", action="store_true", help="act on read-only files too")
    dedupe.add_argument("-C", "--prefer-compressed", action="store_true", help="keep compressed files (with --cow)")
    dedupe.add_argument("-i", "--interactive", action="store_true", help="ask which file of a group to keep")
    for command in (find, dedupe):
        command.add_argument("patterns", nargs="+")
        command.add_argument("--ref", action="append", default=[], help="files that are never touched and are kept first")
        command.add_argument("-z", "--zero", action="store_true", help="include files of zero length")
        command.add_argument("-j", "--follow-symlinks", action="store_true")
        command.add_argument("-t", "--threads", type=int, default=0, help="cores of the local session; 0: all")
    return top


def ask(members: DataFrame) -> DataFrame:
    """Print each group and read answers from standard input."""
    rows = members.orderBy("sha256", "size", "rank").toLocalIterator()
    asked = []

    def groups() -> Iterator[tuple[tuple, list[str]]]:
        for key, own in itertools.groupby(rows, key=lambda r: (r["sha256"], r["size"])):
            paths = [r["path"] for r in own]
            asked.append(key)
            print(f"{len(paths)} files of {key[1]} bytes; [1-{len(paths)}] keep, [a] keep the first from here on, [s] skip, [q] stop:")
            for i, path in enumerate(paths, 1):
                print(f"  {i}: {path}", flush=True)
            yield key, paths

    kept = [(*key, path) for key, path in choose(groups(), sys.stdin)]
    return members.sparkSession.createDataFrame(kept, S.CHOICES)


def closing(run: api.Run) -> int:
    """Print the summary and the problems; the exit code."""
    print("\n".join(["", *run.text()]))
    for problem in run.problems:
        print(problem, file=sys.stderr)
    return int(bool(run.problems))


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "version":
        print(__version__)
        return 0
    if args.command == "dedupe" and args.prefer_compressed and args.action != S.COW:
        print("--prefer-compressed needs --cow", file=sys.stderr)
        return 1
    spark = local_session(args.threads or "*")
    spark.sparkContext.setLogLevel("ERROR")
    options = api.Options(args.patterns, args.ref, follow_symlinks=args.follow_symlinks, include_zero_length=args.zero)
    if args.command == "find" and (args.listlink or args.cow):
        columns = ("first_path", "path") if args.listlink else ("keeper", "path", "shared_bytes", "ratio")
        run = api.listlink(spark, options) if args.listlink else api.find_cow(spark, options)
        for row in run.outcomes.toLocalIterator():
            print("\t".join("-" if row[c] is None else str(row[c]) for c in columns))
        return closing(run)
    if args.command == "find":
        run = api.find(spark, api.Options(**{**vars(options), "skip_hardlinked": args.hardlink}))
    else:
        options = api.Options(**{**vars(options), "include_readonly": args.rdonly, "prefer_compressed": args.prefer_compressed})
        run = api.dedupe(spark, options, args.action, ask if args.interactive else None)
    for row in run.lines().toLocalIterator():
        print(row["line"])
    return closing(run)


if __name__ == "__main__":
    sys.exit(main())
