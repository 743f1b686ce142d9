"""Ignore rules in the style of a ``.gitignore`` file."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepledger.functions.paths import ancestors

# Always ignored unless a later rule says otherwise.
DEFAULT_IGNORES = (".git", "node_modules", "__pycache__", ".DS_Store", "*.pyc", ".env")

_WILDCARD = re.compile(r"^\*\*/|/\*\*/|/\*\*$|(?<=/)\*(?=/|$)|\*+|\?|\[[^\]]+\]|\\.|.", re.DOTALL)


def _wildcard_regex(match: re.Match) -> str:
    token = match.group()
    if token == "**/":
        return "(?:.*/)?"
    if token == "/**/":
        return "/(?:.*/)?"
    if token == "/**":
        return "/.+"
    if token.startswith("*"):
        whole_segment = match.start() > 0 and match.string[match.start() - 1] == "/"
        return "[^/]+" if whole_segment and match.end() == len(match.string) else "[^/]*"
    if token == "?":
        return "[^/]"
    if token.startswith("[") and len(token) > 1:
        return "[^" + token[2:] if token.startswith("[!") else token
    return re.escape(token[-1])


class IgnoreRule(NamedTuple):
    """One rule; ``body`` is a regex for the ignored (or kept) name or path, without a trailing slash."""

    body: str
    anchored: bool
    folder_only: bool
    ignore: bool

    @property
    def regex(self) -> str:
        """For a whole path, which has a trailing slash if it is a folder."""
        start = "" if self.anchored else "(?:.*/)?"
        return f"(?i)^{start}{self.body}{'/' if self.folder_only else '/?'}\\z"


def ignore_rule(line: str) -> IgnoreRule | None:
    """The rule of one line; blank lines and comments give none."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    ignore = not line.startswith("!")
    pattern = line if ignore else line[1:]
    folder_only = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.removeprefix("/")
    if not pattern:
        return None
    return IgnoreRule(_WILDCARD.sub(_wildcard_regex, pattern), anchored, folder_only, ignore)


def _at_or_below(rules: list[IgnoreRule], ignore: bool) -> str | None:
    """One regex to find, in a path with a slash at its end, anything that the ignoring (or keeping) rules match."""
    rules = [rule for rule in rules if rule.ignore is ignore]
    starts = {"^": [r.body for r in rules if r.anchored], "(?:^|/)": [r.body for r in rules if not r.anchored]}
    return "(?i)" + "|".join(f"{s}(?:{'|'.join(b)})/" for s, b in starts.items() if b) if rules else None


def _verdict(path: Column, rules: list[IgnoreRule]) -> Column:
    """The last matching rule decides."""
    return reduce(
        lambda rest, rule: F.when(path.rlike(rule.regex), F.lit(rule.ignore)).otherwise(rest), rules, F.lit(False)
    )


def is_ignored(path: Column, patterns: Iterable[str] = ()) -> Column:
    """Whether a relative path is ignored by the defaults followed by ``patterns``.

    A path is tested as a file and as a folder. Nothing below an ignored folder can be kept again.
    """
    rules = [rule for rule in map(ignore_rule, (*DEFAULT_IGNORES, *patterns)) if rule]
    # Most paths are settled by one regex: no ignoring rule is met, or one is and no keeping rule is.
    # Only where both kinds are met does the order of the rules matter, folder by folder.
    as_folder = F.concat(path, F.lit("/"))
    met = as_folder.rlike(_at_or_below(rules, True))
    kept = _at_or_below(rules, False)
    if kept is None:
        return F.when(path == "", F.lit(False)).otherwise(met)
    folders = F.filter(ancestors(path), lambda folder: folder != "")
    below = F.exists(folders, lambda folder: _verdict(F.concat(folder, F.lit("/")), rules))
    itself = _verdict(path, rules) | _verdict(F.concat(path, F.lit("/")), rules)
    return (
        F.when((path == "") | ~met, F.lit(False)).when(~as_folder.rlike(kept), F.lit(True)).otherwise(below | itself)
    )


_TOKENS = r"(?s)(^\*\*/|/\*\*/|/\*\*\z|\*+|\?|\[[^\]]+\]|\\.|.)"


def _token_regex(tokens: Column, token: Column, at: Column) -> Column:
    """What one token of a pattern stands for; a star that is a whole last segment needs a character."""
    last_segment = (at > 0) & (at == F.size(tokens) - 1) & F.endswith(F.get(tokens, at - 1), F.lit("/"))
    char = F.substring(token, -1, 1)
    return (
        F.when(token == "**/", "(?:.*/)?")
        .when(token == "/**/", "/(?:.*/)?")
        .when(token == "/**", "/.+")
        .when(token.startswith("*"), F.when(last_segment, "[^/]+").otherwise("[^/]*"))
        .when(token == "?", "[^/]")
        .when(token.startswith("[!"), F.concat(F.lit("[^"), F.substring(token, F.lit(3), F.length(token))))
        .when(token.startswith("[") & (F.length(token) > 1), token)
        .when(char.rlike(r"[A-Za-z0-9_/]|[^\x00-\x7f]"), char)
        .otherwise(F.concat(F.lit("\\"), char))
    )


def rule_columns(line: Column) -> Column:
    """``struct<regex, ignore, anchored, part>`` of one line of a rule file, as ``ignore_rule`` reads it; null for blanks and comments.

    The regex is for a whole path, with a slash at its end if the path is a folder. ``part`` has no start and ends where a
    folder ends, see ``finding_regex``.
    """
    line = F.regexp_replace(line, r"(?<!\\)\s+\z", "")
    ignore = ~line.startswith("!")
    pattern = F.when(ignore, line).otherwise(F.substring(line, F.lit(2), F.length(line)))
    bare = F.regexp_replace(pattern, r"/+\z", "")
    tokens = F.regexp_extract_all(F.regexp_replace(bare, "^/", ""), F.lit(_TOKENS), 1)
    body = F.array_join(F.transform(tokens, lambda t, i: _token_regex(tokens, t, i)), "")
    anchored = bare.contains("/")
    start = F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?"))
    end = F.when(pattern.endswith("/"), F.lit("/")).otherwise(F.lit("/?"))
    whole = F.concat(F.lit("(?i)^"), start, body, end, F.lit("\\z"))
    # The pattern itself may have taken the slash.
    part = F.concat(body, F.when(pattern.endswith("/"), F.lit("/")).otherwise(F.lit("(?:/|(?<=/))")))
    rule = F.struct(whole.alias("regex"), ignore.alias("ignore"), anchored.alias("anchored"), part.alias("part"))
    nothing = (line == "") | line.startswith("#") | (F.regexp_replace(bare, "^/", "") == "")
    return F.when(~nothing, rule)


def ignoring_regex(rules: Column) -> Column:
    """One regex that is met by the whole paths that an ordered array of ``rule_columns`` ignores.

    The last matching rule decides: an ignoring rule adds an alternative, a keeping rule takes its own matches out of all before it.
    """
    return F.aggregate(
        rules,
        F.lit("(?!)"),
        lambda before, rule: F.when(rule["ignore"], F.concat(rule["regex"], F.lit("|"), before)).otherwise(
            F.concat(F.lit("(?!"), rule["regex"], F.lit(")(?:"), before, F.lit(")"))
        ),
    )


def finding_regex(rules: Column, ignore: bool) -> Column:
    """One regex to find, in a path with a slash at its end, whether an ignoring (or keeping) rule matches it or a folder above.

    Null without such rules. A path that starts with a slash may be found by that slash alone.
    """

    def of(anchored: bool, start: str) -> Column:
        own = F.filter(rules, lambda rule: (rule["ignore"] == F.lit(ignore)) & (rule["anchored"] == F.lit(anchored)))
        parts = F.array_join(F.transform(own, lambda rule: rule["part"]), "|")
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{start}(?:"), parts, F.lit(")")))

    kinds = F.array_compact(F.array(of(True, "^"), of(False, "^(?:.*/)?")))
    return F.when(F.size(kinds) > 0, F.concat(F.lit("(?i)"), F.array_join(kinds, "|")))
