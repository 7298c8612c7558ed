"""Ignore files: lists of patterns that say which paths of a project are left out.

A list holds for the folder it lies in.  Each line becomes one regular expression over the
path below that folder, so a list is a sequence of (expression, folders only, keeps), of which
the last that matches decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PARTS = re.compile(r"(?P<deep>/\*\*(?=/|$)|^\*\*/)|(?P<many>\*+)|(?P<one>\?)|\[(?P<not>[!^])?(?P<set>\]?[^\]]*)\]|\\(?P<plain>.)|(?P<char>.)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    path: re.Pattern
    folders: bool
    keeps: bool


def _expression(glob: str) -> str:
    """The regular expression of a pattern: `*` and `?` stay within a name, `**` between slashes spans folders."""

    def one(m: re.Match) -> str:
        if m["deep"]:
            return "(?:[^/]+/)*" if m["deep"] == "**/" else ("/.+" if m.end() == len(glob) else "(?:/[^/]+)*")
        if m["many"]:
            return "[^/]*"
        if m["one"]:
            return "[^/]"
        if m["set"] is not None:
            return f"(?!/)[{'^' if m['not'] else ''}{re.sub(r'([\\\\\[^&~|])', r'\\\1', m['set']) if m['set'] != ']' else re.escape(']')}]"
        return re.escape(m["plain"] or m["char"])

    return _PARTS.sub(one, glob)


def read_rules(text: str) -> list[Rule]:
    """The rules of an ignore file; blank lines and comments have none, nor has a pattern that is no expression."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        keeps = line.startswith("!")
        glob = line[keeps:]
        if not glob.strip("/") or line.startswith("#"):
            continue
        folders, glob = glob.endswith("/"), glob.rstrip("/")
        anywhere = "/" not in glob
        try:
            out.append(Rule(re.compile(("(?:.*/)?" if anywhere else "") + _expression(glob.removeprefix("/"))), folders, keeps))
        except re.error:
            continue
    return out


class IgnoreTree:
    """The ignore files of a project by folder ('' is the top); a deeper one decides before a higher one."""

    def __init__(self) -> None:
        self.lists: dict[str, list[Rule]] = {}

    def add(self, folder: str, text: str) -> None:
        self.lists[folder] = read_rules(text)

    def ignores(self, path: str, is_folder: bool) -> bool:
        parts = path.split("/")
        for depth in range(len(parts) - 1, -1, -1):
            rules = self.lists.get("/".join(parts[:depth]), ())
            below = "/".join(parts[depth:])
            last = next((r for r in reversed(rules) if (is_folder or not r.folders) and r.path.fullmatch(below)), None)
            if last:
                return not last.keeps
        return False
