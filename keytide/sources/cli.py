"""The command language over a KVTable: ``python -m keytide.sources.cli``."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from keytide.functions.schema import KeyNotFound
from keytide.sources.table import Config, KVTable

HELP = """OPEN <path>          open or create a table
PUT <key> <value>    store a value (the rest of the line)
GET <key>            print the value or NOT FOUND
DELETE <key>         remove a key
SCAN <start> <end>   keys in [start, end)
SCAN -pre <prefix>   keys with a prefix
CLEAR | HELP | EXIT"""


class Shell:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config, self.table = spark, config, None

    def run(self, line: str) -> str | None:
        """The answer to one command; None ends the session."""
        verb, *args = line.split() or [""]
        verb = verb.upper()
        if verb == "":
            return ""
        if verb == "EXIT":
            if self.table:
                self.table.close()
            return None
        if verb in ("HELP", "CLEAR"):
            return HELP if verb == "HELP" else "\033[2J\033[H"
        if verb == "OPEN":
            return self._open(args)
        if verb not in ("PUT", "GET", "DELETE", "SCAN"):
            return f"ERROR unknown command {verb}"
        if self.table is None:
            return "ERROR no table is open"
        if verb == "PUT":
            rest = line.strip().split(None, 2)
            if len(rest) < 3:
                return "ERROR usage: PUT <key> <value>"
            self.table.put(rest[1], rest[2])
            return "OK"
        if not args:
            return f"ERROR {verb} needs an argument"
        if verb == "GET":
            try:
                return self.table.get(args[0])
            except KeyNotFound:
                return "NOT FOUND"
        if verb == "DELETE":
            self.table.delete(args[0])
            return "OK"
        return self._scan(args)

    def _open(self, args: list[str]) -> str:
        if not args:
            return "ERROR usage: OPEN <path>"
        if self.table is not None:
            return f"a table is open already: {self.table.path}"
        self.table = KVTable.open(self.spark, os.path.join(args[0], "data"), self.config)
        return "OK"

    def _scan(self, args: list[str]) -> str:
        if args[0].startswith("-"):
            if args[0] != "-pre" or len(args) != 2:
                return "ERROR usage: SCAN -pre <prefix>"
            found = self.table.scan_prefix(args[1])
        elif len(args) != 2:
            return "ERROR usage: SCAN <start> <end>"
        elif args[0] > args[1]:
            return "ERROR start is after end"
        else:
            found = self.table.scan_range(*args)
        return "\n".join([f"{r.key} {r.value}" for r in found.toLocalIterator()] + ["END"])


def main() -> None:
    shell = Shell(SparkSession.builder.appName("keytide").getOrCreate())
    for line in sys.stdin:
        answer = shell.run(line)
        if answer is None:
            break
        print(answer, flush=True)


if __name__ == "__main__":
    main()
