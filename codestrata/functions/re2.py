"""RE2 patterns for Spark's Java regexes: translated, and checked when a query is defined.

RE2 and Java differ in what they accept and in what some constructs mean. ``to_java`` rewrites what differs
and raises ValueError for what RE2 has not (look-around, possessive and atomic groups, back-references) or
what Java can't say (single bytes, the ungreedy flag).
"""

from __future__ import annotations

import re

SPACE = r"\t\n\f\r "
CLASS_NAMES = frozenset("alnum alpha ascii blank cntrl digit graph lower print punct space upper word xdigit".split())
JAVA_CLASSES = {"word": r"\w", "ascii": r"\p{ASCII}", "xdigit": r"\p{XDigit}"}
PLAIN_ESCAPES = frozenset("aftnrdDwWbBAzQE")
REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
MOST_REPEATS = 1000


def _posix(name: str, negated: bool) -> str:
    if name not in CLASS_NAMES:
        raise ValueError(f"invalid character class name: {name}")
    java = JAVA_CLASSES.get(name, r"\p{%s}" % name.capitalize())
    if not negated:
        return java
    return java.upper() if name == "word" else r"\P" + java[2:]


class _Translator:
    def __init__(self, pattern: str) -> None:
        self.p, self.i, self.out = pattern, 0, []
        self.multiline = [False]
        self.names: dict[str, str] = {}

    def fail(self, why: str) -> ValueError:
        return ValueError(f"invalid regular expression {self.p!r}: {why}")

    def run(self) -> str:
        atom = False  # whether a repetition may follow, and whether one has just been seen
        repeated = False
        while self.i < len(self.p):
            c = self.p[self.i]
            if c in "*+?" or c == "{" and REPEAT.match(self.p, self.i):
                if not atom:
                    raise self.fail("missing argument to repetition operator")
                if repeated:
                    raise self.fail("invalid nested repetition operator")
                self.repetition()
                repeated = True
                continue
            repeated = False
            atom = True
            if c == "\\":
                self.out.append(self.escape(False))
            elif c == "[":
                self.char_class()
            elif c == "(":
                atom = self.open_group()
            elif c == ")":
                if len(self.multiline) == 1:
                    raise self.fail("unexpected )")
                self.multiline.pop()
                self.take(c)
            elif c == "|":
                atom = False
                self.take(c)
            elif c == "^":
                self.take(c)
            elif c == "$":
                self.i += 1
                self.out.append("$" if self.multiline[-1] else r"\z")
            elif c in "{}":
                self.i += 1
                self.out.append("\\" + c)
            else:
                self.take(c)
        if len(self.multiline) != 1:
            raise self.fail("missing )")
        return "(?d)" + "".join(self.out)

    def take(self, text: str) -> None:
        self.out.append(text)
        self.i += len(text)

    def repetition(self) -> None:
        found = REPEAT.match(self.p, self.i)
        text = found[0] if found else self.p[self.i]
        if found and (int(found[1]) > MOST_REPEATS or found[3] and (int(found[3]) > MOST_REPEATS or int(found[3]) < int(found[1]))):
            raise self.fail("invalid repeat count")
        self.take(text)
        if self.p[self.i : self.i + 1] == "?":
            self.take("?")

    def escape(self, in_class: bool) -> str:
        c = self.p[self.i + 1 : self.i + 2]
        self.i += 2
        if not c:
            raise self.fail("trailing backslash")
        if c == "s":
            return SPACE if in_class else f"[{SPACE}]"
        if c == "S":
            return f"[^{SPACE}]"
        if c == "v":
            return r"\x0B"
        if c in "bB" and not in_class:  # on ASCII words, whatever Java's release makes of it
            after, other = ("!", "=") if c == "b" else ("=", "!")
            return rf"(?:(?<=\w)(?{after}\w)|(?<!\w)(?{other}\w))"
        if c in "pP":
            return self.property(c)
        if c == "x":
            found = re.compile(r"\{[0-9a-fA-F]+\}|[0-9a-fA-F]{2}").match(self.p, self.i)
            if not found:
                raise self.fail("invalid escape sequence")
            self.i = found.end()
            return r"\x" + found[0]
        if c in "01234567":
            found = re.compile(r"[0-7]{0,2}").match(self.p, self.i)
            if c != "0" and not found[0]:
                raise self.fail("back-references are not supported")
            self.i = found.end()
            return r"\x{%x}" % int(c + found[0], 8)
        if c == "Q" and not in_class:
            end = self.p.find(r"\E", self.i)
            text = self.p[self.i : end if end >= 0 else len(self.p)]
            self.i = end + 2 if end >= 0 else len(self.p)
            return re.escape(text)
        if not c.isalnum():
            return "\\" + c
        if c in PLAIN_ESCAPES and not (in_class and c in "bBAzQE"):
            return "\\" + c
        raise self.fail("invalid escape sequence")

    def property(self, kind: str) -> str:
        if self.p[self.i : self.i + 1] != "{":
            name = self.p[self.i : self.i + 1]
            self.i += 1
        else:
            end = self.p.find("}", self.i)
            if end < 0:
                raise self.fail("invalid character class range")
            name = self.p[self.i + 1 : end]
            self.i = end + 1
        if name.startswith("^"):
            name, kind = name[1:], "P" if kind == "p" else "p"
        if not name:
            raise self.fail("invalid character class range")
        return r"\%s{%s}" % (kind, name if len(name) <= 2 else "Is" + name)

    def char_class(self) -> None:
        self.take("[")
        if self.p[self.i : self.i + 1] == "^":
            self.take("^")
        first = True
        while True:
            c = self.p[self.i : self.i + 1]
            if not c:
                raise self.fail("missing closing ]")
            if c == "]" and not first:
                self.take("]")
                return
            first = False
            if c == "[" and self.p.startswith("[:", self.i):
                end = self.p.find(":]", self.i)
                if end > 0:
                    name = self.p[self.i + 2 : end]
                    self.out.append(_posix(name.removeprefix("^"), name.startswith("^")))
                    self.i = end + 2
                    continue
            if c == "\\":
                self.out.append(self.escape(True))
            elif c in "[]&~^":
                self.i += 1
                self.out.append("\\" + c)
            else:
                self.take(c)

    def open_group(self) -> bool:
        """Whether a repetition may follow what was read: only after flags that stand alone it may not."""
        if not self.p.startswith("(?", self.i):
            self.take("(")
            self.multiline.append(self.multiline[-1])
            return False
        found = re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(self.p, self.i)
        if found:
            if found[1] in self.names:
                raise self.fail("duplicate capture group name")
            self.names[found[1]] = f"g{len(self.names)}"
            self.out.append(f"(?<{self.names[found[1]]}>")
            self.i = found.end()
            self.multiline.append(self.multiline[-1])
            return False
        found = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])").match(self.p, self.i)
        if not found or not (found[1] or found[2] or found[3] == ":"):
            raise self.fail("invalid or unsupported Perl syntax")
        if "U" in found[1] + (found[2] or ""):
            raise self.fail("the ungreedy flag is not supported")
        m = True if "m" in found[1] else False if "m" in (found[2] or "") else self.multiline[-1]
        self.i = found.end()  # RE2 folds the case of all letters, Java without u that of ASCII's
        self.out.append(f"(?{found[1].replace('i', 'iu', 1)}{'-' + found[2] if found[2] else ''}{found[3]}")
        if found[3] == ":":
            self.multiline.append(m)
        else:
            self.multiline[-1] = m
        return False


def to_java(pattern: str) -> str:
    """A Java pattern that finds what the RE2 pattern finds; ValueError if there is none."""
    if not isinstance(pattern, str):
        raise TypeError("a pattern is a string")
    java = _Translator(pattern).run()
    _compile(java, pattern)
    return java


def _compile(java: str, pattern: str) -> None:
    """Let Java's own compiler have the last word, where a session runs."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    jvm = getattr(session, "_jvm", None)
    if jvm is None:
        return
    from py4j.protocol import Py4JJavaError

    try:
        jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError as e:
        raise ValueError(f"invalid regular expression {pattern!r}: {e.java_exception.getDescription()}") from None
