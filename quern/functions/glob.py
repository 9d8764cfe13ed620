"""Globs as regular expressions, and ignore files."""

from __future__ import annotations

import re


def glob_regex(glob: str, slashes: bool = True) -> str:
    """An anchored pattern for the glob. slashes: whether * and ? cross /; ** always does."""
    any_, out, i = "." if slashes else "[^/]", "", 0
    depth = 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += any_ + "*"
        elif c == "?":
            out += any_
        elif c == "[":
            end = glob.find("]", i + (3 if glob[i + 1 : i + 2] in ("!", "^") else 2))
            if end < 0:
                raise ValueError(f"unclosed class in {glob!r}")
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed {{ in {glob!r}")
    return f"(?s)\\A{out}\\z"


class Ignore:
    """The rules of one ignore file, for paths relative to its folder."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            if "/" not in line:
                line = "**/" + line
            try:
                self.rules.append((re.compile(glob_regex(line.lstrip("/"), False).replace("\\z", "\\Z")), keep, folder))
            except (re.error, ValueError):
                continue

    def verdict(self, path: str, folder: bool) -> bool | None:
        """True ignored, False kept, None nothing said; the last rule that fits counts."""
        for p, keep, only in reversed(self.rules):
            if (folder or not only) and p.match(path):
                return not keep
        return None
