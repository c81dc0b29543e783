"""Command line: filters a log and prints it, lists, exports and infers templates."""

from __future__ import annotations

import argparse
import sys

from .operators.infer import infer
from .operators.logframe import LogFrame
from .plans.builtins import all_builtins, builtin
from .plans.template import LogError, LogIOError, load
from .sources.lines import lines_from_iterable, read_lines, write_template
from .streaming.pipe import follow_stream


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sparklog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparklog", description=__doc__)
    p.add_argument("file", nargs="?", help="a log, or - for standard input")
    p.add_argument("-t", "--template", help="a built-in template")
    p.add_argument("-T", "--template-file", help="a template definition")
    p.add_argument("-f", "--filter", help="a filter expression")
    p.add_argument("-P", "--print", action="store_true", help="print the visible lines (the default)")
    p.add_argument("-l", "--list", action="store_true", help="list the built-in templates")
    p.add_argument("-e", "--export", metavar="NAME", help="print a built-in template's definition")
    p.add_argument("-w", "--wizard", metavar="NAME", help="print a definition inferred from the log")
    p.add_argument("-s", "--sample", type=int, default=1, metavar="N", help="infer from the N-th line that is not indented")
    p.add_argument("-o", "--output", metavar="FILE", help="write the inferred definition to a file")
    a = p.parse_args(argv)
    try:
        if a.list:
            for t in all_builtins().values():
                print(f"{t.name:<12} {t.description}")
            return 0
        if a.export:
            print(builtin(a.export).to_lxt(), end="")
            return 0
        if a.template and a.template_file:
            raise LogError("one template at a time")
        template = load(a.template_file) if a.template_file else builtin(a.template) if a.template else None
        name = a.file or ("-" if not sys.stdin.isatty() else None)
        if name is None or a.file == "-" and sys.stdin.isatty():
            raise LogError("a file is missing")
        spark = _session()
        if name == "-" and not a.wizard:
            for line in follow_stream(spark, sys.stdin, template, a.filter):
                print(line, flush=True)
            return 0
        lines = lines_from_iterable(spark, sys.stdin) if name == "-" else read_lines(spark, name)
        if a.wizard:
            made, report = infer(lines, a.wizard, line=a.sample - 1)
            if a.output:
                write_template(spark, made, a.output)
            else:
                print(made.to_lxt(), end="")
            print(f"# matches {report.matched} of {report.total} sampled lines", file=sys.stderr)
            return 0
        for line in LogFrame(lines, template, a.filter).print_lines():
            print(line)
        return 0
    except LogIOError as e:
        print(f"sparklog: {e}", file=sys.stderr)
        return e.exit_code
    except LogError as e:
        print(f"sparklog: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
