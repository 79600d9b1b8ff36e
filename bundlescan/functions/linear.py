"""Search forms that take time in proportion to the text.

A pattern that begins with a run of some characters is tried by a backtracking engine at every
character of the run, and each try reads the run to its end. But what follows a run either is there
or not, so only one place in a run matters. These forms look at that place alone:

* ``run+ rest``, where rest begins with a character outside the run: at the run's first character, or
  where the last match ended, and possessively;
* a match that starts at the first word boundary in a run, or at the first anchor in it: what stands
  before it in the run is passed once, in a group of its own;
* a block from a head to the nearest tail: passes over what stands before the head are chained to the
  last match, so that a head without a tail ends the search.

Each gives the matches of the rule it stands for, on any text (tests compare them with Python's
``re``). Patterns are in Python syntax, as the rules are; ``\\G`` and possessive signs are Java's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from . import rules
from .dialect import to_java


@dataclass(frozen=True)
class Form:
    """A Java pattern; its group ``before``, if not 0, holds what stands before the match, and the
    group ``match`` the match."""

    java: str
    before: int = 0
    match: int = 0

    def replacement(self, label: str) -> str:
        return (f"${self.before}" if self.before else "") + f"[REDACTED:{label}]"


def _leading_run(pattern: str) -> str | None:
    """``[run]+rest`` as ``(?:(?<![run])|\\G)[run]++rest``, if rest begins with a character outside the run."""
    found = re.match(r"(\[[^\]]*\])\+(?![+?])(.)", pattern)
    if not found or re.match(found[1], found[2]) or found[2] in "\\[(|?*{":
        return None
    return f"(?:(?<!{found[1]})|\\G){found[1]}++{pattern[found.end(1) + 1:]}"


def _at_first(run: str, place: str, rest: str) -> str:
    """rest at the first place in a run: group 1 is what stands before it in the run, group 2 the match."""
    return f"(?<!{run})((?>{run}*?(?={place})))({rest})"


def _block(head: str, tail: str) -> str:
    """From a head to the nearest tail: group 1 is what stands before it since the last match."""
    return f"\\G((?>[\\s\\S]*?(?={head})))({head}[\\s\\S]*?{tail})"


def _forms() -> dict[str, Form]:
    out = {}
    run = rules.BASE64[2:rules.BASE64.index("{")]
    out[rules.BASE64] = Form(to_java(_at_first(run, r"\b", rules.BASE64[2:].replace("{20,}", "{20,}+").replace("{0,2}", "{0,2}+"))), 1, 2)
    for pattern, label, ignore_case in rules.SECRET_SHAPES:
        if label == "jwt":
            run = re.match(r"\\beyJ(\[[^\]]*\])", pattern)[1]
            parts = pattern[2:].replace(f"{run}{{10,}}\\.", f"{run}{{10,}}+\\.")  # a dot is outside the run
            out[pattern] = Form(to_java(_at_first(run, r"\beyJ", parts), ignore_case), 1, 2)
        elif label == "private-key":
            head, tail = pattern.split(r"[\s\S]*?")
            out[pattern] = Form(to_java(_block(head, tail), ignore_case), 1, 2)
    return out


FORMS = _forms()


def form(pattern: str, ignore_case: bool = False) -> Form:
    """The search form of a rule: a linear one where the plain pattern is not."""
    if pattern in FORMS:
        return FORMS[pattern]
    return Form(to_java(_leading_run(pattern) or pattern, ignore_case))
