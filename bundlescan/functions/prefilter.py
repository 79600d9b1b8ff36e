"""Required-literal prefilters: ``contains`` byte searches in front of regexes.

A regex can only match a text that contains one of its required literals
(``dialect.required_literals``). ``contains`` compares bytes where they lie, while each regex first
decodes the whole text into a Java string, so texts that lack the literals skip the regex
entirely. (``instr`` steps from character to character and costs several times as much.) Case-insensitive rules search a folded copy of the text
(``lower(translate(text, 'ſıİK', 'sIIk'))``): those four characters are the only ones whose
simple case mapping lands on an ASCII letter, so the folded search never misses a text
the Unicode case-insensitive regex would match.

A scan with all rules asks for some two hundred literals, and as many searches would read the text as
often. So it looks for all of them at once (``held``): one pass over the folded text takes out, at each
place, the longest literal of the catalogue that stands there, and each rule's literals are searched in
what was taken out, which is short.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .dialect import FOLD_FROM, FOLD_TO, required_literals


ENABLED = True  # switch for A/B measurements


def folded(text: Column) -> Column:
    beyond_ascii = F.octet_length(text) != F.length(text)  # none of the four is ASCII
    held = beyond_ascii & any_of(text, [c for c in FOLD_FROM if not c.isascii()])  # translating steps from character to character
    return F.when(held, F.lower(F.translate(text, FOLD_FROM, FOLD_TO))).otherwise(F.lower(text))


def lowered(text: Column, fold: Column) -> Column:
    """``lower(text)`` of a text whose folded form is there: they differ only where one of the four stands."""
    beyond_ascii = F.octet_length(text) != F.length(text)
    return F.when(beyond_ascii & any_of(text, list(FOLD_FROM)), F.lower(text)).otherwise(fold)


MIN_LITERAL = 3


def _distinctive(lit: str) -> bool:
    """Worth a byte search: long enough, or with a sign or digit in it, or made of punctuation that
    prose rarely holds (``@``, ``://``, ``$``) — not common separators."""
    if len(lit) >= MIN_LITERAL or len(lit) == 2 and not lit.isalpha():
        return True
    return not any(c.isalnum() for c in lit) and not set(lit) <= set(" .,;:-_'\"()")


#: Characters of prose, the most frequent first; any other is rarer than these.
_COMMON = " \netaoinsrhldcumfpgwybvk.,-xjqz"


def _rare_start(lit: str) -> str:
    """The end of a literal, of four characters or more, that begins with its rarest character: a byte
    search compares further only where the first byte is met."""
    rank = lambda c: _COMMON.index(c) if c in _COMMON else len(_COMMON)
    return lit[max(range(max(1, len(lit) - 3)), key=lambda i: rank(lit[i])):]


def _whole_lits(pattern: str) -> list[str] | None:
    """Literals worth a prefilter, all of them distinctive."""
    lits = required_literals(pattern)
    return lits if lits and all(_distinctive(x) for x in lits) else None


@lru_cache(maxsize=None)
def _lits(pattern: str, ignore_case: bool) -> tuple[str, ...] | None:
    """What each of those literals ends with."""
    lits = _whole_lits(pattern)
    return lits and tuple(sorted({_rare_start(x.lower() if ignore_case else x) for x in lits}))


def may_match(text: Column, fold: Column | None, pattern: str, ignore_case: bool = False, held: Column | None = None) -> Column:
    """True unless the text provably cannot match ``pattern`` (null text gives null). held: what held()
    took out of the text, to be searched instead."""
    if held is not None and ENABLED:
        return any_held(held, _asked(pattern)) if _asked(pattern) else F.lit(True)
    lits = _lits(pattern, ignore_case) if ENABLED else None
    if not lits:
        return F.lit(True)
    src = fold if ignore_case else text
    if src is None:
        src = folded(text)
    return any_of(src, lits)


def any_of(text: Column, literals) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in literals])


def gated(text: Column, gate: Column, found: Column, none: Column) -> Column:
    """found where the gate lets the text through, else none; null for a null text."""
    return F.when(text.isNull(), F.lit(None)).when(gate, found).otherwise(none)


# ------------------------------------------------------------------ all literals in one pass

#: Longer texts are searched for each literal: every place where one stands gives a string of its own.
HELD_BYTES = 1 << 18

#: Character classes of the rough patterns in a folded text.
_DIGIT, _BASE58 = r"[^\x00-/:-\x7f]", "[a-z1-9]"
#: What is taken out besides literals, and what asks for it: a match of ROUGH as it is when folded.
ROUGH_HELD = {rules.IPV4: rf"\.{_DIGIT}{{1,3}}\.{_DIGIT}{{1,3}}\.{_DIGIT}", rules.BTC_WALLET: f"[13]{_BASE58}{{25}}"}
ENV_ENDS = sorted({"_" + name.rsplit("_", 1)[1] for name in rules.SENSITIVE_ENV_NAMES})
BECH32 = "bc1"


def _word(pattern: str) -> str | None:
    """The short word that a rule without a distinctive literal begins with, between boundaries."""
    found = re.match(r"\\b([a-z]{2})(?:\\b|\\s)", pattern)
    return found[1] if found else None


@lru_cache(maxsize=None)
def _asked(pattern: str) -> tuple[str, ...]:
    """Literals, or a short word, one of which every match of a rule holds; () without any."""
    if pattern == rules.ENCODED_URL:
        return ("%",)
    word = _word(pattern)
    return tuple(_whole_lits(pattern) or ((word,) if word else ()))


@lru_cache(maxsize=None)
def _catalogue() -> tuple[frozenset[str], frozenset[str]]:
    """(literals, short words) that the rules ask for, folded."""
    asked = [d.pattern for d in rules.DETECTORS] + [p for p, _ in rules.SUSPICIOUS_IMPORTS] + [p for p, _ in rules.SHELL_COMMANDS]
    asked += [rules.URL, rules.DATA_URI, rules.JAVASCRIPT_URI, rules.ENCODED_URL, rules.EMAIL, rules.ENV_VAR, rules.PRIVATE_IP,
              rules.ETH_WALLET, rules.PASTE_SERVICE, rules.DNS_EXFIL]
    words = {w for p in asked if not _whole_lits(p) and (w := _word(p))}
    lits = {x for p in asked for x in _asked(p)} - words
    lits |= {*rules.SENSITIVE_PATHS, *rules.SENSITIVE_PATH_PARTS, *rules.SUSPICIOUS_WORDS, *ENV_ENDS, BECH32}
    return frozenset(_key(x) for x in lits), frozenset(words)


#: Per cent of the characters of prose; any other is taken for a third of one.
_SHARE = dict(zip(" etaoinsrhldcumfgpwybvkxjqz.", (18, 10, 7, 6.5, 6, 6, 5.5, 5, 5, 5, 3.5, 3.5, 2.5, 2.5, 2, 2, 2, 1.5, 1.5, 1.5, 1.2, 0.8, 0.6, 0.2, 0.2, 0.1, 0.1, 1)))


def _share(chars) -> float:
    return min(1.0, sum(_SHARE.get(c, 0.3) for c in chars) / 100)


def _key(lit: str) -> str:
    """What a folded literal ends with, of five characters or more, from its rarest pair on."""
    x = lit.lower()
    return x[min(range(max(1, len(x) - 4)), key=lambda i: _share(x[i]) * _share(x[i + 1:i + 2])):]


def _class(chars) -> str:
    return "[" + "".join(f"\\x{ord(c):02x}" for c in sorted(chars)) + "]"


def _pairs(seconds: dict[str, set[str]], most: int = 5) -> list[tuple[set[str], set[str]]]:
    """(first characters, second characters) that cover all first pairs of the literals, in so few
    parts that prose seldom holds another pair of a part."""
    parts = [({c}, set(s)) for c, s in sorted(seconds.items())]
    chance = lambda a, b: _share(a) * _share(b)
    while len(parts) > most:
        both = [(chance(a | c, b | d) - chance(a, b) - chance(c, d), i, j) for i, (a, b) in enumerate(parts) for j, (c, d) in enumerate(parts[:i])]
        _, i, j = min(both)
        (a, b), (c, d) = parts.pop(i), parts.pop(j)
        parts.append((a | c, b | d))
    return sorted(parts, key=lambda x: -chance(*x))


@lru_cache(maxsize=None)
def _held_pattern() -> str:
    """At each place, the longest literal there in group 1, or a rough match. Most places are passed by
    their pair of characters; the literal is then found by classes of first and second ones."""
    lits, words = _catalogue()
    ends: dict[str, list[str]] = defaultdict(list)
    for x in sorted(lits, key=lambda x: (-len(x), x)):
        ends[x[0]].append(re.escape(x[1:]))
    seconds = {c: {x[1] for x in lits if x[0] == c and len(x) > 1} for c in ends}
    alone = {x for x in lits if len(x) == 1}
    for w in sorted(words):  # "\u0130" lowers to an i and a mark, which is a boundary
        ends[w[0]].append(f"(?<![a-hj-z0-9_]{w[0]}){w[1]}(?![a-z0-9_])")
        seconds.setdefault(w[0], set()).add(w[1])
    branch = {c: re.escape(c) + ("" if c in alone else f"(?={_class(seconds[c])})") + f"(?:{'|'.join(e)})" for c, e in ends.items()}
    starts = [_class(a) + _class(b) for a, b in _pairs({c: s for c, s in seconds.items() if c not in alone})] + [_class(alone)]
    for rough in ROUGH_HELD.values():
        run = rough.index("[", 1)
        starts.append(rough[:run] + rough[run:rough.index("]", run) + 1])
        for c in rough[1] if rough[0] == "\\" else rough[1:rough.index("]")]:
            # before the literals: where both stand, the rough match is longer and holds the literal
            own = re.escape(c) + rough[run:]
            branch[c] = f"(?:{own}|{branch[c]})" if c in branch else own
    first = sorted(branch)
    groups = [first[i:i + 6] for i in range(0, len(first), 6)]
    return f"(?={'|'.join(starts)})(?=({'|'.join(f'(?={_class(g)})(?:' + '|'.join(branch[c] for c in g) + ')' for g in groups)}))"


def held(fold: Column) -> Column:
    """The literals of the catalogue that a folded text holds, a line each; a long text as it is."""
    found = F.array_join(F.array_distinct(F.regexp_extract_all(fold, F.lit(_held_pattern()), F.lit(1))), "\n")
    return F.when(F.octet_length(fold) <= HELD_BYTES, found).otherwise(fold)


def any_held(held: Column, literals) -> Column:
    """Whether a text may hold one of some literals of the catalogue."""
    lits, words = _catalogue()
    keys = sorted({x if x in words else _key(x) for x in literals})
    missing = [x for x in keys if x not in lits | words]
    if missing:
        raise ValueError(f"not in the catalogue: {missing}")
    return any_of(held, keys)
