"""Path patterns: the search glob, the exclusion glob, and lists of exclusion rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Preset exclusion rules (fixed values).
PRESETS = {
    "caches": ["**/.cache/**", "**/cache/**", "**/__pycache__/**", "**/node_modules/**", "**/.npm/**", "**/.cargo/registry/**", "**/target/debug/**", "**/target/release/**"],
    "temp": ["**/*.tmp", "**/*.temp", "**/*.swp", "**/*.swo", "**/*~", "**/.*.swp", "/tmp/**", "/var/tmp/**"],
    "system": ["/proc/**", "/sys/**", "/dev/**", "/run/**", "/var/run/**", "/lost+found/**"],
    "vcs": ["**/.git/**", "**/.svn/**", "**/.hg/**", "**/.bzr/**"],
    "logs": ["**/*.log", "**/logs/**", "/var/log/**"],
}
PRESETS["defaults"] = PRESETS["caches"] + PRESETS["temp"] + PRESETS["system"]


def search_glob_regex(glob: str) -> str:
    """Whole-string regex of a search glob: ``*`` and ``?`` only, and both cross ``/``."""
    return r"(?s)\A" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + r"\z"


def exclusion_glob_regex(glob: str) -> str:
    """Whole-string regex of an exclusion glob: ``*``, ``?``, ``**``, ``[...]``, ``{a,b}`` and escapes.

    ``*`` and ``?`` cross ``/``. ``**`` between slashes, or at either end, stands for any number
    of components.
    """
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i) and (i == 0 or glob[i - 1] == "/") and (i + 2 == len(glob) or glob[i + 2] == "/"):
            if i + 2 == len(glob):
                out.append(".*" if i == 0 else ".+")
                i += 2
            else:
                out.append("(?:.*/)?")
                i += 3
            continue
        if c == "*":
            out.append(".*")
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            negated = inner[:1] in ("!", "^")
            out.append("[" + "^" * negated + re.sub(r"([\\\[\]^&~])", r"\\\1", inner[negated:]) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + ")" * depth + r"\z"


@dataclass(frozen=True)
class Rule:
    """An exclusion rule: a ``glob``, ``prefix`` or ``regex``, for directories only if so marked."""

    kind: str
    pattern: str
    directory_only: bool = False

    def condition(self, path: Column, is_directory: Column) -> Column:
        if self.kind == "prefix":
            root = self.pattern.rstrip("/")
            test = (path == root) | path.startswith(root + "/")
        else:
            test = path.rlike(self.pattern if self.kind == "regex" else exclusion_glob_regex(self.pattern))
        return test & is_directory if self.directory_only else test


def parse_rules(text: str) -> list[Rule]:
    """Rules of a pattern file: one per line, ``#`` comments, prefixes ``pp: re: fm: gl:``, else a glob."""
    kinds = {"pp:": "prefix", "re:": "regex", "fm:": "glob", "gl:": "glob"}
    rules = []
    for line in map(str.strip, text.splitlines()):
        if line and not line.startswith("#"):
            kind = kinds.get(line[:3])
            rules.append(Rule(kind, line[3:]) if kind else Rule("glob", line))
    return rules


def format_rules(rules: list[Rule]) -> str:
    """The pattern file of rules; reading it again gives the same rules."""
    return "".join({"prefix": "pp:", "regex": "re:", "glob": "gl:"}[r.kind] + r.pattern + "\n" for r in rules)


def preset(*names: str) -> list[Rule]:
    return [Rule("glob", g) for name in names for g in PRESETS[name]]


def excluded(rules: list[Rule], path: Column | str = "path", is_directory: Column | None = None) -> Column:
    """Whether any rule excludes the path: one expression, in which all globs are one regex."""
    path = F.col(path) if isinstance(path, str) else path
    directory = is_directory if is_directory is not None else F.lit(False)
    test = F.lit(False)
    for only in (False, True):
        globs = [exclusion_glob_regex(r.pattern).removeprefix(r"(?s)\A").removesuffix(r"\z") for r in rules if r.kind == "glob" and r.directory_only == only]
        if globs:
            hit = path.rlike(r"(?s)\A(?:" + "|".join(globs) + r")\z")
            test = test | (hit & directory if only else hit)
    for rule in rules:
        if rule.kind != "glob":
            test = test | rule.condition(path, directory)
    return test
