"""A line-by-line shell: queries, help, history, !N, import and export."""

from __future__ import annotations

import cmd

from tessella.errors import EngineError
from tessella.sources import files, results

GRAPH_VERBS = ("TRAVERSE", "MATCH", "SHORTEST_PATH", "CONNECTED")


class Shell(cmd.Cmd):
    prompt = "> "

    def __init__(self, session, stdin=None, stdout=None):
        super().__init__(stdin=stdin, stdout=stdout)
        self.use_rawinput = stdin is None
        self.session, self.lines = session, []

    def run(self, line: str):
        verb = (line.split() or [""])[0].upper()
        return self.session.graph(line) if verb in GRAPH_VERBS else self.session.sql(line)

    def show(self, line: str):
        try:
            self.stdout.write(results.to_csv(self.run(line)))
        except EngineError as e:
            self.stdout.write(f"{e.code}: {e}\n")

    def precmd(self, line):
        if line.startswith("!") and line[1:].isdigit() and 0 < int(line[1:]) <= len(self.lines):
            line = self.lines[int(line[1:]) - 1]
        if line.strip():
            self.lines.append(line)
        return line

    def default(self, line):
        self.show(line)

    def emptyline(self):
        pass

    def do_history(self, _):
        """history: the lines so far"""
        for n, line in enumerate(self.lines, 1):
            self.stdout.write(f"{n} {line}\n")

    def do_import(self, rest):
        """import TABLE FILE: pairs from lines, the first comma ends the id"""
        table, path = rest.split(None, 1)
        new = files.import_pairs(self.session.spark, path, table)
        self.session.pairs.load(new)
        self.stdout.write(f"{new.count()} imported\n")

    def do_export(self, rest):
        """export FOLDER QUERY: a query's result as CSV"""
        path, query = rest.split(None, 1)
        try:
            results.write_csv(self.run(query), path)
        except EngineError as e:
            self.stdout.write(f"{e.code}: {e}\n")

    def do_get(self, rest):
        """get TABLE KEY: one value"""
        try:
            self.stdout.write(self.session.pairs.get(*rest.split(None, 1)) + "\n")
        except EngineError as e:
            self.stdout.write(f"{e.code}: {e}\n")

    def do_exit(self, _):
        """exit: the end"""
        return True
