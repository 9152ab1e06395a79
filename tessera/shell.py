"""Command line and interactive shell: PATH [QUERY]."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from .display import show
from .engine import Engine
from .errors import DialectError, WrongCommand
from .plans.parser import parse

class Shell:
    """style: box, ascii or list."""

    def __init__(self, engine: Engine, out: Callable[[str], None] = print, style: str = "box"):
        self.engine = engine
        self.out = out
        self.style = style

    def run(self, line: str) -> None:
        """One statement or command; errors are reported, not raised."""
        line = line.strip()
        if not line:
            return
        try:
            if line.startswith("."):
                self.command(line)
            else:
                show(self.engine.sql(line), self.style, self.out)
        except DialectError as e:
            self.out(e.report(line))

    def command(self, line: str) -> None:
        word, _, rest = line.partition(" ")
        catalog = self.engine.catalog
        if word == ".dbinfo":
            self.out(f"database page size: {catalog.page_size}")
            self.out(f"number of tables: {len(catalog.entries)}")
        elif word == ".tables":
            self.out(" ".join(n for n, e in catalog.entries.items() if not e.internal))
        elif word == ".schema":
            for entry in catalog.entries.values():
                if not entry.internal:
                    self.out(f"{entry.name}: {catalog.sql_of(entry)}")
        elif word == ".parse":
            try:
                self.out(repr(parse(rest)))
            except DialectError as e:
                self.out(e.report(rest))
            except RecursionError:
                raise WrongCommand("the syntax tree is too deep to be shown") from None
        elif word == ".test":
            for name in rest.split() or list(catalog.entries)[:1]:
                frame = catalog.frame(name)
                self.out(f"{name}: {frame.count()} rows, then {frame.count()} rows")
        else:
            raise WrongCommand(f"no command is called {word}")

    def loop(self, read: Callable[[str], str] = input) -> None:
        while True:
            try:
                line = read("> ")
            except (EOFError, KeyboardInterrupt):
                return
            if line.strip() in (".q", ".quit"):
                return
            self.run(line)


def main(arguments: list[str] | None = None) -> int:
    arguments = sys.argv[1:] if arguments is None else arguments
    if not 1 <= len(arguments) <= 2:
        print("usage: python -m tessera PATH [QUERY]")
        return 2
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    try:
        engine = Engine.open(spark, arguments[0])
    except DialectError as e:
        print(e.report())
        return 1
    shell = Shell(engine)
    if len(arguments) == 2:
        shell.run(arguments[1])
    else:
        try:
            import readline  # noqa: F401  line editing and history, where the platform has it
        except ImportError:
            pass
        shell.loop()
    return 0
