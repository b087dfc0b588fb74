"""Translate a Python ``re`` pattern into the Java dialect Spark evaluates.

The reference compiles patterns with Python's ``re``; Spark runs ``java.util.regex``. Rewrites:
named groups ``(?P<n>...)`` -> ``(?<n>...)``, back-references ``(?P=n)`` -> ``\\k<n>``, ``\\Z`` -> ``\\z``,
``{,n}`` -> ``{0,n}``, a literal ``{`` escaped, ``\\v`` -> ``\\x0B``, ``\\UXXXXXXXX`` -> ``\\x{...}``, spaces and ``#`` inside sets
escaped (verbose mode keeps them in Python, drops them in Java); ``\\w \\W \\s \\S \\b \\B`` become
explicit classes with Python's membership;
a leading ``(?dU)`` gives Python's line terminator (only ``\\n``) and Unicode digits and case
folding. An inline ``(?a)`` selects ASCII classes instead. Python-only constructs with no Java
form (conditionals ``(?(id)yes|no)``, ``(?L)``) raise ``ValueError``.
"""

from __future__ import annotations

import re


# Python's classes, which Java's differ from: \w is letters, numbers and "_" (Java's Unicode
# \w adds combining marks and connector punctuation); \s is str.isspace() (Java's lacks
# \x1C-\x1F). Derived from Python's own definitions: they equal these category sets.
_W = {True: r"\p{L}\p{Nd}\p{Nl}\p{No}_", False: r"a-zA-Z0-9_"}
_S = {
    True: r"\t\n\x0B\f\r\x1C-\x1F\x20\x{85}\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}"
          r"\x{205F}\x{3000}",
    False: r"\t\n\x0B\f\r\x20",
}


def _escape(nxt: str, in_class: bool, uni: bool) -> str | None:
    """Java text for the Python escape ``\\nxt``, or None to copy it unchanged."""
    w, sp = _W[uni], _S[uni]
    if in_class:
        return {"w": w, "W": f"[^{w}]", "s": sp, "S": f"[^{sp}]", "b": r"\x08", "v": r"\x0B"}.get(nxt)
    return {
        "w": f"[{w}]", "W": f"[^{w}]", "s": f"[{sp}]", "S": f"[^{sp}]", "Z": r"\z", "v": r"\x0B",
        "b": f"(?:(?<=[{w}])(?![{w}])|(?<![{w}])(?=[{w}]))",
        "B": f"(?:(?<=[{w}])(?=[{w}])|(?<![{w}])(?![{w}]))",
    }.get(nxt)


def to_java(pattern: str) -> str:
    uni = not re.match(r"\(\?[aiLmsux]*a[aiLmsux]*\)", pattern)  # leading global flags with "a": ASCII
    out: list[str] = []
    i, n = 0, len(pattern)
    in_class = False
    while i < n:
        ch = pattern[i]
        if ch == "\\" and i + 1 < n:
            nxt = pattern[i + 1]
            if nxt == "U" and re.match(r"[0-9a-fA-F]{8}", pattern[i + 2:i + 10]):
                out.append("\\x{" + pattern[i + 2:i + 10].lstrip("0").rjust(1, "0") + "}")  # Java has no \U
                i += 10
                continue
            rep = _escape(nxt, in_class, uni)
            out.append(rep if rep is not None else pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
                out.append(ch)
            elif ch in "[&":
                # literal in Python sets; nested class / intersection in Java
                out.append("\\" + ch)
            elif ch in " #":
                # literal in Python sets even in verbose mode; Java's comments mode would drop them
                out.append("\\x20" if ch == " " else "\\#")
            else:
                out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append(ch)
            i += 1
            # a ']' right after '[' or '[^' is a literal
            if i < n and pattern[i] == "^":
                out.append("^")
                i += 1
            if i < n and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        if pattern.startswith("(?P=", i):
            j = pattern.index(")", i)
            out.append("\\k<" + pattern[i + 4:j] + ">")
            i = j + 1
            continue
        if pattern.startswith("(?(", i):
            raise ValueError("Conditional groups '(?(id)yes|no)' are not supported by the Spark regex engine.")
        m = re.match(r"\(\?([aiLmsux]+)\)", pattern[i:])
        if m:
            flags = m.group(1)
            if "L" in flags:
                raise ValueError("The locale flag '(?L)' is not supported.")
            flags = flags.replace("a", "").replace("u", "")
            if flags:
                out.append(f"(?{flags})")
            i += len(m.group(0))
            continue
        m = re.match(r"\{,(\d+)\}", pattern[i:])
        if m:
            out.append("{0," + m.group(1) + "}")
            i += len(m.group(0))
            continue
        if ch == "{" and not re.match(r"\{\d*(,\d*)?\}", pattern[i:]) or ch == "{" and re.match(r"\{,?\}", pattern[i:]):
            out.append("\\{")  # literal in Python unless it is a repeat count; Java takes it for one
            i += 1
            continue
        out.append(ch)
        i += 1
    # (?d): only "\n" ends a line for ".", "^" and "$", as in Python; (?U): Unicode digits and case folding
    return ("(?dU)" if uni else "(?d)") + "".join(out)


def check_python(pattern: str | None) -> str:
    """The reference's eager checks: required, non-empty, compiles under Python ``re``."""
    if not pattern:
        raise ValueError("mask_regex needs a non-empty regex_pattern.")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"regex_pattern does not compile: {e}") from e
    return pattern
