"""Command line: ``python -m textweft.cli run FILES...``."""

from __future__ import annotations

import argparse
import functools
import http.server
import logging
import shutil
import sys
import webbrowser

from pyspark.sql import SparkSession

from textweft.api import Engine
from textweft.config import EngineConfig, FragmentOrder, PairOrder
from textweft.sources import sinks

FORMATS = ("terminal", "csv", "web")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textweft")
    run = top.add_subparsers(dest="command", required=True).add_parser("run", help="compare files")
    run.add_argument("files", nargs="+")
    run.add_argument("-n", "--name")
    run.add_argument("-k", "--kgram-length", type=int, default=23)
    run.add_argument("-w", "--kgrams-in-window", type=int, default=17)
    run.add_argument("-l", "--language")
    run.add_argument("-m", "--max-fingerprint-count", type=int)
    run.add_argument("-M", "--max-fingerprint-percentage", type=float)
    run.add_argument("-t", "--template", action="append", default=[])
    run.add_argument("-C", "--include-comments", action="store_true")
    run.add_argument("-c", "--compare", action="store_true")
    run.add_argument("-s", "--min-fragment-length", type=int, default=1)
    run.add_argument("--include-analysis-data", action="store_true")
    run.add_argument("--sort-by", choices=[o.value for o in PairOrder], default=PairOrder.SIMILARITY.value)
    run.add_argument("-b", "--fragment-sort-by", choices=[o.value for o in FragmentOrder], default=FragmentOrder.FILE_ORDER.value)
    run.add_argument("-f", "--output-format", choices=FORMATS, default="terminal")
    run.add_argument("-o", "--output-destination")
    run.add_argument("-p", "--port", type=int, default=3000)
    run.add_argument("-H", "--host", default="localhost")
    run.add_argument("--open-browser", action="store_true")
    run.add_argument("-q", "--quiet", action="count", default=0)
    return top


def config_of(args: argparse.Namespace) -> EngineConfig:
    return EngineConfig(
        args.name, args.kgram_length, args.kgrams_in_window, args.language, args.max_fingerprint_count, args.max_fingerprint_percentage, tuple(args.template),
        args.include_comments, args.min_fragment_length, PairOrder(args.sort_by), FragmentOrder(args.fragment_sort_by), args.compare, args.include_analysis_data,
    )


def serve(directory: str, host: str, port: int, open_browser: bool) -> None:
    """Serves a report's tables until stopped."""
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=directory)
    with http.server.ThreadingHTTPServer((host, port), handler) as server:
        print(f"http://{host}:{server.server_address[1]}/", flush=True)
        if open_browser:
            webbrowser.open(f"http://{host}:{server.server_address[1]}/")
        server.serve_forever()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    # -q leaves out steps, -qq warnings, -qqq errors
    logging.basicConfig(stream=sys.stderr, format="%(message)s", force=True)
    logging.getLogger("textweft").setLevel([logging.INFO, logging.WARNING, logging.ERROR, logging.CRITICAL][min(args.quiet, 3)])
    own = spark is None
    try:
        config = config_of(args)
        spark = spark or SparkSession.builder.appName("textweft").getOrCreate()
        report = Engine(spark, config).report(args.files)
        if args.output_format == "terminal":
            width = shutil.get_terminal_size((120, 24)).columns
            for row in sinks.summary(report).toLocalIterator():
                print(row["line"])
            if report.has_fragments:
                print(sinks.compare_text(report, width))
        else:
            where = sinks.write_csv(report, args.output_destination)
            print(where)
            if args.output_format == "web":
                serve(where, args.host, args.port, args.open_browser)
        return 0
    except (ValueError, OSError) as e:
        logging.getLogger("textweft").error("error: %s", e)
        return 1
    finally:
        if own and spark is not None:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
