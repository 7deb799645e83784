"""Interactive prompt: ``python -m quernel.cli [--data DIR] [FILE ...]``."""

from __future__ import annotations

import argparse
import datetime
import sys
import time
from collections.abc import Iterable, Iterator
from itertools import islice
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, Row, SparkSession

from quernel.catalog import IndexEntry
from quernel.engine import Engine
from quernel.errors import SqlParseError
from quernel.functions.types import sql_type

#: Rows that are held and laid out at once. All are printed; a later block may be wider than those before it.
BLOCK_ROWS = 10_000


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, datetime.datetime):
        return value.isoformat(" ")
    return value.isoformat() if isinstance(value, datetime.date) else str(value)


def table_lines(names: list[str], rows: Iterable[Row]) -> Iterator[str]:
    """Left-aligned columns under a rule, in blocks of ``BLOCK_ROWS`` rows."""
    source, widths, first = iter(rows), [len(n) for n in names], True
    line = lambda values: " | ".join(v.ljust(w) for v, w in zip(values, widths, strict=True))
    while True:
        block = [[cell(v) for v in r] for r in islice(source, BLOCK_ROWS)]
        if block:
            widths = [max(w, *map(len, column)) for w, column in zip(widths, zip(*block, strict=True), strict=True)]
        if first:
            yield line(names)
            yield "-+-".join("-" * w for w in widths)
            first = False
        yield from map(line, block)
        if len(block) < BLOCK_ROWS:
            return


def format_table(names: list[str], rows: Iterable[Row]) -> str:
    return "\n".join(table_lines(names, rows))


class Repl:
    def __init__(self, engine: Engine, out: TextIO = sys.stdout):
        self.engine, self.out = engine, out

    def say(self, text: str) -> None:
        print(text, file=self.out, flush=True)

    def run(self, lines: Iterable[str], prompt: bool = True) -> None:
        source = iter(lines)
        while True:
            if prompt:
                print("sql> ", end="", file=self.out, flush=True)
            line = next(source, None)
            if line is None or not self.handle(line.strip()):
                return

    def handle(self, line: str) -> bool:
        """False to stop."""
        if not line:
            return True
        if line in (".exit", ".quit"):
            return False
        if line == ".tables":
            for name in self.engine.catalog.table_names:
                self.say(name)
            return True
        if line.lower().startswith(".schema"):
            self.schema(line[len(".schema") :].strip())
            return True
        try:
            self.statement(line)
        except SqlParseError as e:
            self.say(f"syntax error: {e}")
        except Exception as e:  # noqa: BLE001 - the prompt goes on after any error
            self.say(f"error: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        self.say("")
        return True

    def schema(self, name: str) -> None:
        table = self.engine.catalog.try_get_table(name)
        if table is None:
            self.say(f"unknown table {name!r}; try .tables")
            return
        for f in table.frame.schema.fields:
            self.say(f"{f.name} {sql_type(f.dataType).value}")

    def statement(self, line: str) -> None:
        start = time.perf_counter()
        result = self.engine.execute(line)
        took = lambda: round((time.perf_counter() - start) * 1000)
        if isinstance(result, str):
            self.say(result)
        elif isinstance(result, IndexEntry):
            kind = "BPlusTree" if result.kind == "BTREE" else "Hash"
            self.say(f"created {kind} index on {result.table}({result.column}) ({took()} ms)")
        else:
            self.print_rows(result, took)

    def print_rows(self, df: DataFrame, took) -> None:
        n = 0

        def counted() -> Iterator[Row]:
            nonlocal n
            for row in df.toLocalIterator(prefetchPartitions=True):
                n += 1
                yield row

        for line in table_lines(df.columns, counted()):
            self.say(line)
        self.say(f"({n:,} row{'' if n == 1 else 's'} in {took()} ms)")

    def load(self, path: Path) -> None:
        start = time.perf_counter()
        table = self.engine.load_csv(str(path))
        rows, columns = table.stats.row_count, len(table.frame.columns)
        self.say(f"loaded '{table.name}': {rows:,} rows, {columns} columns ({round((time.perf_counter() - start) * 1000)} ms)")


def files(arguments: list[str], data: str | None) -> list[Path]:
    """The CSV files to load: those named, and all of ``data`` in order of their names; the folder "data" if neither is given."""
    found = [Path(a) for a in arguments]
    for path in found:
        if not path.exists():
            raise FileNotFoundError(f"no such CSV file: {path}")
    if data is not None or not found:
        folder = Path(data if data is not None else "data")
        if not folder.is_dir():
            raise FileNotFoundError(f"no such data folder: {folder}" if data is not None else "nothing to load: name CSV files or give --data DIR")
        found += sorted(folder.glob("*.csv"))
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quernel", description=__doc__)
    parser.add_argument("files", nargs="*", help="CSV files; each becomes a table of its name")
    parser.add_argument("--data", help="a folder whose CSV files are loaded (default: data, if there)")
    options = parser.parse_args(argv)
    try:
        paths = files(options.files, options.data)
    except FileNotFoundError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("quernel").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    repl = Repl(Engine(spark))
    repl.say("quernel: SQL over CSV files")
    for path in paths:
        repl.load(path)
    repl.say("type a query, or .exit to leave\n")
    repl.run(sys.stdin)
    return 0


if __name__ == "__main__":
    sys.exit(main())
