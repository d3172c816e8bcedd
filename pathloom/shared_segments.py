"""Command line: segments that pairs of haplotypes of a stored panel share.

    python -m pathloom.shared_segments PANEL MIN_LENGTH [--bidirectional] [--max-haps N] [--version V] [--output PATH] [--verbose]
"""

from __future__ import annotations

import argparse
import sys
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .operators import ibd
from .sources.panel import SEGMENT_COLUMNS, Panel, write_segments

#: The versions that can be asked for, by number, and the plan that each has here. All give the same segments.
VERSIONS = {2: "grams", 3: "events", 4: "events", 24: "events"}
BOTH_WAYS = (3, 4)


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(1, f"{message}\n")


def _count(least: int):
    def parse(text: str) -> int:
        if not text.isdecimal() or int(text) < least:
            raise argparse.ArgumentTypeError(f"'{text}' isn't a number of {least} at least")
        return int(text)

    return parse


def arguments(args: list[str]) -> argparse.Namespace:
    parser = _Parser(prog="shared_segments", allow_abbrev=False)
    parser.add_argument("panel", help="a panel as Panel.save() writes it")
    parser.add_argument("min_length", type=_count(1), help="nodes that a segment has at least")
    parser.add_argument("--bidirectional", action="store_true", help="the panel has each haplotype forward and reversed")
    parser.add_argument("--max-haps", type=_count(0), help="only haplotypes with smaller ids are the first of a pair")
    parser.add_argument("--version", type=int, choices=sorted(VERSIONS), default=4, help="3 and 4 ask for a bidirectional panel")
    parser.add_argument("--output", help="a folder for tab-separated files; else standard output")
    parser.add_argument("--verbose", action="store_true", help="says on standard error what is done, and when")
    return parser.parse_args(args)


def call(panel: Panel, min_length: int, max_haps: int | None = None, version: int = 4):
    """The segments, as ibd.segments(); errors are ValueErrors."""
    if version not in VERSIONS:
        raise ValueError(f"version {version} isn't one of {sorted(VERSIONS)}")
    if version in BOTH_WAYS and not panel.bidirectional:
        raise ValueError(f"version {version} needs a bidirectional panel")
    if panel.positions.isEmpty():
        raise ValueError("the panel has no haplotypes")
    return ibd.segments(panel, min_length, max_haps, VERSIONS[version])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = arguments(sys.argv[1:] if args is None else args)
    began = time.monotonic()
    say = (lambda x: print(f"{time.monotonic() - began:.1f} s: {x}", file=sys.stderr)) if given.verbose else (lambda x: None)
    spark = spark or SparkSession.builder.appName("shared_segments").getOrCreate()
    try:
        panel = Panel.load(spark, given.panel, given.bidirectional)
        say(f"panel: {given.panel}")
        if given.verbose:
            asked = ibd.forward(panel).positions.select("seq_id").distinct()
            asked = asked if given.max_haps is None else asked.filter(asked["seq_id"] < given.max_haps)
            say(f"{asked.count()} haplotypes to process")
        found = call(panel, given.min_length, given.max_haps, given.version)
        if given.output:
            write_segments(found, given.output)
        else:
            print("#" + "\t".join(SEGMENT_COLUMNS))
            for row in found.orderBy(*SEGMENT_COLUMNS).select(*SEGMENT_COLUMNS).toLocalIterator():
                print("\t".join(map(str, row)))
        if given.verbose:
            total = ibd.totals(found).first()
            say(f"{total.pairs} pairs, {total.segments} segments")
    except (ValueError, PySparkException, Py4JJavaError) as e:  # an output that cannot be made is a Java error
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
