"""Regex dialect bridge.

Rules are written once in Python ``re`` syntax (Unicode-aware ``\\w \\d \\s \\b``).
Spark evaluates regexes with ``java.util.regex``, which treats those classes as
ASCII, and the DuckDB oracle uses RE2, which has no lookaround at all. This module
rewrites a rule for each engine so that all three agree on what a word character,
a digit and a space are:

* Java: ``\\w`` -> ``[\\p{L}\\p{N}_]``, ``\\d`` -> ``\\p{Nd}``, ``\\s`` -> the Python
  whitespace set, ``\\b`` -> explicit lookarounds on that word class, and the
  ``(?d)`` flag so ``.``, ``^`` and ``$`` only know ``\\n`` (Python's line model).
  Case-insensitive rules get ``(?iu)`` (Unicode case folding, like Python).
* RE2: same classes; ``\\b`` stays (ASCII in RE2 — the oracle's only approximation);
  possessive quantifiers are dropped (RE2 never backtracks, so they are moot).
"""

from __future__ import annotations

_WORD = r"\p{L}\p{N}_"
_SPACE_JAVA = r"\t-\r\x1c-\x20\x85\p{Z}"
_SPACE_RE2 = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
_WORDCH = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _tokens(p: str):
    """Split a pattern into (token, in_class) pairs; escapes stay together."""
    i, n, in_class, out = 0, len(p), False, []
    while i < n:
        c = p[i]
        if c == "\\":
            if p[i + 1] == "u":
                out.append((p[i:i + 6], in_class))
                i += 6
                continue
            out.append((p[i:i + 2], in_class))
            i += 2
            continue
        if not in_class and c == "[":
            j = i + 1
            if j < n and p[j] == "^":
                j += 1
            out.append((p[i:j], False))
            in_class = True
            # a ']' right after '[' or '[^' is a literal in Python
            if j < n and p[j] == "]":
                out.append(("\\]", True))
                j += 1
            i = j
            continue
        if in_class and c == "]":
            out.append(("]", False))
            in_class = False
            i += 1
            continue
        out.append((c, in_class))
        i += 1
    return out


def _top_level_alternation(toks) -> bool:
    depth = 0
    for t, in_class in toks:
        if in_class:
            continue
        if t == "(":
            depth += 1
        elif t == ")":
            depth -= 1
        elif t == "|" and depth == 0:
            return True
    return False


def _literal_first(toks):
    """``\bword…`` -> ``word(?<!W word)…``: the same language, but the pattern now starts
    with a literal, which lets java.util.regex search with Boyer-Moore instead of trying
    the lookbehind at every position."""
    if len(toks) < 3 or toks[0][0] != r"\b" or _top_level_alternation(toks):
        return None
    k = 1
    while k < len(toks) and not toks[k][1] and toks[k][0] in _WORDCH:
        k += 1
    if k < len(toks) and toks[k][0] in ("?", "*", "+", "{"):
        k -= 1  # the last character is quantified: not part of the fixed literal
    lit = "".join(t for t, _ in toks[1:k])
    if len(lit) < 2:
        return None
    return lit, toks[k:]


def to_java(pattern: str, ignore_case: bool = False, multiline: bool = False) -> str:
    toks = _tokens(pattern)
    res = []
    lf = _literal_first(toks)
    if lf is not None:
        lit, rest = lf
        res.append(f"{lit}(?<![{_WORD}]{lit})")
        toks = [(lit[-1], False)] + rest  # keeps the "previous token" of a following \b right
        skip_first = True
    else:
        skip_first = False
    for k, (t, in_class) in enumerate(toks):
        if skip_first and k == 0:
            continue
        if in_class:
            if t == r"\w":
                res.append(_WORD)
            elif t == r"\W":
                res.append(f"[^{_WORD}]")
            elif t == r"\d":
                res.append(r"\p{Nd}")
            elif t == r"\D":
                res.append(r"\P{Nd}")
            elif t == r"\s":
                res.append(_SPACE_JAVA)
            elif t == r"\S":
                res.append(f"[^{_SPACE_JAVA}]")
            elif t in ("[", "&"):
                res.append("\\" + t)
            else:
                res.append(t)
            continue
        if t == r"\w":
            res.append(f"[{_WORD}]")
        elif t == r"\W":
            res.append(f"[^{_WORD}]")
        elif t == r"\d":
            res.append(r"\p{Nd}")
        elif t == r"\D":
            res.append(r"\P{Nd}")
        elif t == r"\s":
            res.append(f"[{_SPACE_JAVA}]")
        elif t == r"\S":
            res.append(f"[^{_SPACE_JAVA}]")
        elif t == r"\b":
            nxt = toks[k + 1][0] if k + 1 < len(toks) else ""
            prv = toks[k - 1][0] if k > 0 else ""
            if nxt in _WORDCH and not toks[k + 1][1]:
                res.append(f"(?<![{_WORD}])")
            elif prv in _WORDCH and not toks[k - 1][1]:
                res.append(f"(?![{_WORD}])")
            else:
                res.append(f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))")
        else:
            res.append(t)
    flags = "d" + ("m" if multiline else "") + ("iu" if ignore_case else "")
    return f"(?{flags})" + "".join(res)


def linear_forms(pattern: str) -> list[str]:
    """For rules that search ``A.*B`` on a line: one pattern for each top-level alternative, with two
    groups, what stands before the first match and the match. Empty for other rules.

    A plain search tries every A and looks for B to the line's end from each. But if the first A
    finds no B after it, no later A can. So the form is tied to the line's start, goes to the first
    A in an atomic group, and takes the match from there; in ``A.*B.*C`` the first B will do as well,
    because the match ends with the line's last C either way. Alternatives without ``.*`` keep their
    search, behind a lazy start."""
    forms = []
    for alternative in _split_top(_tokens(pattern)):
        parts: list[list[str]] = [[]]
        depth, k = 0, 0
        while k < len(alternative):
            t, in_class = alternative[k]
            if not in_class:
                depth += (t == "(") - (t == ")")
            if depth == 0 and not in_class and t == "." and k + 1 < len(alternative) and alternative[k + 1][0] == "*":
                lazy = k + 2 < len(alternative) and alternative[k + 2] == ("?", False)
                parts.append(["?" if lazy else ""])
                k += 3 if lazy else 2
                continue
            parts[-1].append(t)
            k += 1
        first, rest = "".join(parts[0]), parts[1:]
        if not rest:
            return []
        body = first
        for i, part in enumerate(rest):
            tail = "".join(part[1:])
            body += f".*{part[0]}{tail}" if i == len(rest) - 1 else f"(?>.*?{tail})"
        forms.append(f"^((?>.*?(?={first})))({body})")
    return forms


def to_re2(pattern: str, ignore_case: bool = False) -> str:
    toks = _tokens(pattern)
    res = []
    prev_quant = False
    for t, in_class in toks:
        if in_class:
            if t == r"\w":
                res.append(_WORD)
            elif t == r"\d":
                res.append(r"\p{Nd}")
            elif t == r"\s":
                res.append(_SPACE_RE2)
            elif t.startswith(r"\u"):
                res.append(r"\x{" + t[2:] + "}")
            elif t in (r"\W", r"\S", r"\D"):
                res.append(t)  # RE2's own (ASCII) form; only used as [\s\S] = any character
            else:
                res.append(t)
            prev_quant = False
            continue
        if t == "+" and prev_quant:
            prev_quant = False
            continue  # possessive marker
        if t == r"\w":
            res.append(f"[{_WORD}]")
        elif t == r"\W":
            res.append(f"[^{_WORD}]")
        elif t == r"\d":
            res.append(r"\p{Nd}")
        elif t == r"\D":
            res.append(r"\P{Nd}")
        elif t == r"\s":
            res.append(f"[{_SPACE_RE2}]")
        elif t == r"\S":
            res.append(f"[^{_SPACE_RE2}]")
        elif t.startswith(r"\u"):
            res.append(r"\x{" + t[2:] + "}")
        else:
            res.append(t)
        prev_quant = t in ("*", "+", "?", "}")
    return ("(?i)" if ignore_case else "") + "".join(res)


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (DuckDB / Spark SQL)."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------------------------ required literals

_SPECIAL = set(".^$*+?{}[]()|\\")
# characters outside ASCII whose simple case mapping lands on an ASCII letter; folding them
# first makes lower-cased substring tests a superset of Unicode case-insensitive matching
FOLD_FROM = "ſıİK"
FOLD_TO = "sIIk"


def _split_top(toks):
    alts, cur, depth = [], [], 0
    for t, in_class in toks:
        if not in_class and t == "(":
            depth += 1
        elif not in_class and t == ")":
            depth -= 1
        if not in_class and depth == 0 and t == "|":
            alts.append(cur)
            cur = []
        else:
            cur.append((t, in_class))
    alts.append(cur)
    return alts


def _literal_group(toks) -> list[str] | None:
    """What every match of a group holds one of: its branches, where they are plain literals (``\\b``
    ignored), else the best literal of each branch; None if some branch has none."""
    inner = toks[1:-1]
    if inner[:2] == [("?", False), (":", False)]:
        inner = inner[2:]
    elif inner and inner[0] == ("?", False):
        return None
    lits = _plain_branches(inner)
    return lits if lits is not None else _alternatives(inner)


def _plain_branches(inner) -> list[str] | None:
    lits = []
    for alt in _split_top(inner):
        chars = []
        for t, in_class in alt:
            if in_class or t == r"\b":
                if in_class:
                    return None
                continue
            if len(t) == 1 and t not in _SPECIAL:
                chars.append(t)
            elif len(t) == 2 and t[0] == "\\" and not t[1].isalnum():
                chars.append(t[1])
            else:
                return None
        if not chars:
            return None
        lits.append("".join(chars))
    return lits


def _best_run(toks) -> tuple[str, list[str] | None]:
    """(longest literal run, any-of literal group) at the top level of one alternative that
    every match must contain; quantified characters / groups and quantifier bounds end a run."""
    best, run, group, depth, i = "", "", None, 0, 0
    while i < len(toks):
        t, in_class = toks[i]
        if not in_class and t == "{" and depth == 0:
            while i < len(toks) and toks[i][0] != "}":
                i += 1
            best, run = max(best, run, key=len), ""
            i += 1
            continue
        if not in_class and t == "(" and depth == 0:
            j, d = i, 0
            while j < len(toks):
                if not toks[j][1] and toks[j][0] == "(":
                    d += 1
                elif not toks[j][1] and toks[j][0] == ")":
                    d -= 1
                    if d == 0:
                        break
                j += 1
            after = toks[j + 1][0] if j + 1 < len(toks) and not toks[j + 1][1] else ""
            if after not in ("?", "*", "{"):
                found = _literal_group(toks[i:j + 1])
                if found and (group is None or min(map(len, found)) > min(map(len, group))):
                    group = found  # the one whose shortest literal is longest
            best, run = max(best, run, key=len), ""
            i = j + 1
            continue
        nxt = toks[i + 1][0] if i + 1 < len(toks) and not toks[i + 1][1] else ""
        lit = None
        if not in_class:
            if len(t) == 1 and t not in _SPECIAL:
                lit = t
            elif len(t) == 2 and t[0] == "\\" and not t[1].isalnum():
                lit = t[1]
        if lit is not None and nxt not in ("?", "*", "{"):
            run += lit
            if nxt == "+":
                best, run = max(best, run, key=len), ""
        else:
            best, run = max(best, run, key=len), ""
        i += 1
    return max(best, run, key=len), group


def _alternatives(toks) -> list[str] | None:
    """For each top-level alternative, a literal (or those of a group) of which every match holds one."""
    out = []
    for alt in _split_top(toks):
        run, group = _best_run(alt)
        # prefer the run when it is long or made of punctuation (rare in prose, e.g. '$')
        score = len(run) + (2 if run and not any(c.isalnum() for c in run) else 0)
        if score >= 3 or (run and not group):
            out.append(run)
        elif group:
            out.extend(group)
        else:
            return None
    return out


def required_literals(pattern: str, max_alternatives: int = 20) -> list[str] | None:
    """Literals of which every match contains at least one (a run or a literal group per
    top-level alternative), or None when some alternative has none."""
    out = _alternatives(_tokens(pattern))
    out = out and sorted(set(out))
    return out if out and len(out) <= max_alternatives else None
