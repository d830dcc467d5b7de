"""Functions, control statements and error handlers of one file in a language of braces, found in one pass.

Strings and comments are blanked first, at the same length. Then one loop over brackets and statement ends keeps a stack of
open brackets; what stands between the last statement end and a brace is its header, which says what the block is. It is no
parser: it knows headers, not expressions, and takes code as formatters write it."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple


class Function(NamedTuple):
    name: str
    owner: str
    start: int
    end: int
    params: int | None


class Statement(NamedTuple):
    start: int
    end: int
    depth: int


class Outline(NamedTuple):
    """functions; control statements with their depth of nesting; lines (first, last) of empty error handlers."""

    functions: list[Function]
    control: list[Statement]
    empty_handlers: list[tuple[int, int]]


ANONYMOUS = "<anonymous>"
_LINE, _BLOCK, _DOUBLE = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
#: Strings and comments by language
_BLANKED = {
    "go": [_LINE, _BLOCK, _DOUBLE, r"`[^`]*`", _SINGLE],
    "java": [_LINE, _BLOCK, r'"""(?:\\.|[^\\])*?"""', _DOUBLE, _SINGLE],
    "javascript": [_LINE, _BLOCK, _DOUBLE, _SINGLE, r"`(?:\\.|[^`\\])*`", r"(?:(?<=[(,=:\[!&|?{};])|(?<=return))[ \t]*/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"],
    "c": [_LINE, _BLOCK, r"(?m:^)[ \t]*\#(?:\\\n|[^\n])*", _DOUBLE, _SINGLE],
    "rust": [_LINE, _BLOCK, r'r(?P<h>\#*)".*?"(?P=h)', _DOUBLE, r"'(?:\\[^']*|[^'\\\n])'"],
}
_BLANKED["typescript"] = _BLANKED["javascript"]
_MASKS = {k: re.compile("|".join(v), re.DOTALL) for k, v in _BLANKED.items()}
#: Control statements that count for nesting, by language
_CONTROL = {k: re.compile(rf"(?<![\w.$])(?:{v})(?![\w$])") for k, v in {"go": "if|for|switch|select", "java": "if|for|while|switch", "javascript": "if|for|while|switch", "typescript": "if|for|while|switch", "c": "if|for|while|switch", "rust": "if|for|while|match|loop"}.items()}
_CLASSES = {
    "java": re.compile(r"(?<![\w.])(class|interface|enum|record|@interface)\s+(\w+)|\bnew\b[^;{}=]*\)\s*$"),
    "javascript": re.compile(r"(?<![\w.$])(class)\b\s*(?!extends\b)([\w$]*)"),
    "rust": re.compile(r"(?<!\w)(impl)\b\s*(?:<[^{}]*?>\s*)?(?:[^{}]*?\bfor\s+)?([^{}]*?)\s*(?:\bwhere\b[^{}]*)?$"),
}
_CLASSES["typescript"] = _CLASSES["javascript"]
_NAMED_OWNERS = {"java": {"class", "interface"}, "javascript": {"class"}, "typescript": {"class"}, "rust": {"impl"}}
_KEYWORDS = r"(?!(?:if|for|while|switch|catch|return|new|throw|do|else|try|synchronized|function|with|await|super|this|sizeof|defined)\b)"
_METHOD = re.compile(rf"(?:^|[\s*>\]])(?P<name>{_KEYWORDS}[\#\w$]+)\s*(?:<[^()]*>)?\s*$")
_TAIL = {"java": re.compile(r"\s*(?:throws\b[^;{]*)?$"), "javascript": re.compile(r"\s*$"), "typescript": re.compile(r"\s*(?::[^;]*)?$"), "c": re.compile(r"\s*$"), "rust": re.compile(r"(?s).*$"), "go": re.compile(r"(?s).*$")}
_GO_FUNC = re.compile(r"^\s*func\s*(\([^()]*\))?\s*(\w+)\s*(?:\[[^()]*\])?\s*\(")
_RUST_FUNC = re.compile(r"(?:\bpub\b(?:\s*\([^)]*\))?\s*)?(?:\b(?:async|const|unsafe|extern)\b[\s\"_]*)*\bfn\s+(\w+)")
_JS_FUNC = re.compile(r"(?<![\w$.=(,:?])\s*((?:async\s+)?function\s+([\w$]+)\s*(?:<[^()]*>)?)\s*$")
_ARROW = re.compile(r"(?:\)\s*(?::[^=;{}()]*)?|(?P<one>[\w$]+)\s*)=>")
_PIECES = re.compile(r"[(){}\[\];,\n]")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def blanked(source: str, lang: str) -> str:
    """The source with its strings and comments blanked, line ends and lengths kept; strings keep a quote."""

    def blank(m: re.Match) -> str:
        text = m[0]
        kept = re.sub(r"[^\n]", " ", text)
        return kept if text.lstrip().startswith(("//", "/*", "#")) else '"' + kept[1:-1] + '"' if len(text) > 1 and "\n" not in text else kept[:-1] + '"' if len(text) > 1 else text

    return _MASKS[lang].sub(blank, source)


class _Open(NamedTuple):
    bracket: str
    at: int
    kind: str  # of a brace: class, control, function, literal or block
    owner: str
    heads: tuple[tuple[int, int], ...]  # control statements that the block belongs to: their number and whether else may follow
    start: int


def outline(source: str, lang: str) -> Outline:
    """What one file holds. Unknown languages hold nothing; brackets that don't fit are passed over."""
    if lang not in _MASKS:
        return Outline([], [], [])
    return _Scan(source, lang).run()


class _Scan:
    def __init__(self, source: str, lang: str):
        self.source, self.lang, self.text = source, lang, blanked(source, lang)
        self.ends = [m.start() for m in re.finditer("\n", source)]
        self.stack: list[_Open] = []
        self.begin = [0]  # where the statement began, by depth of brackets
        self.pairs: dict[int, int] = {}  # closing bracket -> opening one
        self.functions: list[list] = []
        self.control: list[list] = []  # start, end, depth
        self.handlers: list[tuple[int, int]] = []
        self.depth = 0
        self.chain: dict[int, list[int]] = {}  # by depth of brackets: the if statements that an else may follow

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.ends, at) + 1

    def run(self) -> Outline:
        for m in _PIECES.finditer(self.text):
            c, at = m[0], m.start()
            if c in "([{":
                self.open(c, at)
            elif c in ")]}":
                self.close(c, at)
            elif c == ";":
                self.end_of_statement(at)
            elif c == ",":
                if self.stack and self.stack[-1].bracket != "{" or self.stack and self.stack[-1].kind == "literal":
                    self.begin[-1] = at + 1
            elif self.lang == "go" and not (self.stack and self.stack[-1].bracket != "{") and re.search(r"[\w)\]}\"]\s*$", self.text[max(self.begin[-1], at - 200) : at]):
                self.begin[-1] = at + 1
        while self.stack:
            self.close({"(": ")", "[": "]", "{": "}"}[self.stack[-1].bracket], len(self.text) - 1)
        if self.lang in ("javascript", "typescript"):
            self.arrows()
        functions = sorted((Function(n, o, self.line(a), self.line(b), p) for n, o, a, b, p in self.functions), key=lambda f: (f.start, -f.end))
        control = [Statement(self.line(a), self.line(b), d) for a, b, d in self.control]
        # a handler that is an if statement ends where its last else does
        return Outline(functions, control, [(self.line(a), self.line(self.control[-1 - b][1] if b < 0 else b)) for a, b in self.handlers])

    def head(self, at: int) -> tuple[int, str]:
        """Where the header of what stands at a place begins, and its text."""
        start = self.begin[-1]
        text = self.text[start:at]
        return start + len(text) - len(text.lstrip()), text.strip()

    def flat(self, start: int, head: str) -> str:
        """A header with everything in brackets blanked."""
        out, depth = [], 0
        for c in head:
            depth -= c in ")]"
            out.append(" " if depth > 0 else c)
            depth += c in "(["
        return "".join(out)

    def open(self, c: str, at: int) -> None:
        kind, owner, heads, start = "", "", (), at
        if c == "{":
            start, head = self.head(at)
            kind, owner, heads = self.classify(start, head, at)
        self.stack.append(_Open(c, at, kind, owner, heads, start))
        self.begin.append(at + 1)
        self.depth += len(heads)

    def classify(self, start: int, head: str, at: int) -> tuple[str, str, tuple]:
        lang, flat = self.lang, self.flat(start, head)
        if lang == "go" and at and not self.text[at - 1].isspace() and self.text[at - 1] != ")":
            return "literal", "", ()
        if re.search(r"[=(\[,:?]\s*$", flat) and not flat.endswith("=>") and not re.match(r"(case|default)\b", flat):
            return "literal", "", ()
        if lang == "go" and (m := _GO_FUNC.match(head)) and not self.stack:
            self.function(m[2], self.receiver(m[1] or ""), start, head, start + len(head[: m.end()]) - 1)
            return "function", "", ()
        if lang == "rust" and (m := _RUST_FUNC.search(head)):
            self.function(m[1], self.owner(), start + m.start(), head, self.text.find("(", start + m.end()))
            return "function", "", ()
        if (m := _CLASSES[lang].search(flat) if lang in _CLASSES else None) and not re.match(r"(else\s+)?(if|while|for|return)\b", flat):
            named = m[1] in _NAMED_OWNERS[lang]
            return "class", self.text[start + m.start(2) : start + m.end(2)] if named and m[2] is not None else "", ()
        heads = self.controls(start, flat)
        if heads:
            return "control", "", heads
        if re.match(r"else\b", flat):
            return "control", "", tuple((i, 1) for i in self.chain.get(len(self.stack), []))
        if re.search(r"\bcatch\b[\s(]*[^{}]*$", flat) and lang in ("java", "javascript", "typescript"):
            return "catch", "", ()
        if lang in ("javascript", "typescript", "java", "c") and self.method(start, head, flat, at):
            return "function", "", ()
        return "block", "", ()

    def controls(self, start: int, flat: str) -> tuple[tuple[int, int], ...]:
        """The control statements of a header, each nested in the one before, and those they follow as else if."""
        if self.lang in ("javascript", "typescript") and re.search(r"=>\s*$", flat):
            return ()
        found = list(_CONTROL[self.lang].finditer(flat))
        if self.lang == "rust":
            found = [m for m in found if not re.match(r"for\s*<", flat[m.start() :])]
        if self.lang == "go" and found and flat[: found[0].start()].strip() not in ("", "else") and not flat[: found[0].start()].rstrip().endswith(":"):
            return ()
        before = self.chain.get(len(self.stack), []) if found and re.match(r"else\b", flat) else []
        heads = [(i, 1) for i in before]
        for m in found:
            self.control.append([start + m.start(), 0, self.depth + len(heads) + 1])
            heads.append((len(self.control) - 1, int(m[0] == "if")))
        return tuple(heads) if found else ()

    def close(self, c: str, at: int) -> None:
        if not any(o.bracket == _CLOSES[c] for o in self.stack):
            return
        while self.stack[-1].bracket != _CLOSES[c]:
            self.pop(at)
        self.pop(at)

    def pop(self, at: int) -> None:
        o = self.stack.pop()
        self.begin.pop()
        self.pairs[at] = o.at
        self.depth -= len(o.heads)
        for i, _ in o.heads:
            self.control[i][1] = max(self.control[i][1], at)
        if o.bracket != "{":
            return
        self.chain[len(self.stack)] = [i for i, chained in o.heads if chained]
        empty = not self.source[o.at + 1 : at].strip()
        if o.kind == "function":
            next(f for f in reversed(self.functions) if f[3] is None)[3] = at
        elif o.kind == "catch" and empty:
            self.handlers.append((self.text.rfind("catch", 0, o.at), at))
        elif o.kind == "control" and empty and self.lang == "go" and o.heads and re.search(r"(^|;)\s*(else\s+)?(if\s+)?err != nil$", self.source[o.start : o.at].strip()):
            self.handlers.append((self.control[o.heads[-1][0]][0], -1 - o.heads[-1][0]))
        if o.kind != "literal":
            self.begin[-1] = at + 1

    def end_of_statement(self, at: int) -> None:
        if self.stack and self.stack[-1].bracket != "{":
            return
        start, head = self.head(at)
        flat = self.flat(start, head)
        if self.lang == "go" and re.match(r"(else\s+)?(if|for|switch)\b", flat):
            return
        if self.lang == "java" and self.stack and self.stack[-1].kind == "class" and "=" not in flat:
            if self.method(start, head, flat, at):
                self.functions[-1][3] = at
        elif self.lang not in ("go", "rust"):
            for i, _ in self.controls(start, flat):  # without braces
                self.control[i][1] = max(self.control[i][1], at)
        self.begin[-1] = at + 1

    def owner(self) -> str:
        return next((o.owner for o in reversed(self.stack) if o.owner), "")

    @staticmethod
    def receiver(text: str) -> str:
        return text.strip("() \t\n").split(" ")[-1].lstrip("*") if text else ""

    def function(self, name: str, owner: str, start: int, head: str, paren: int) -> None:
        self.functions.append([name, owner, start, None, self.params(paren)])

    def method(self, start: int, head: str, flat: str, at: int) -> bool:
        """A function whose header ends with its parameters."""
        lang = self.lang
        end = flat.rfind(")") if lang != "typescript" else self.text_rfind_params(flat)
        if end < 0 or not _TAIL[lang].match(flat[end + 1 :]) or start + end not in self.pairs:
            return False
        paren = self.pairs[start + end]
        before = flat[: paren - start]
        inside = self.stack[-1].kind if self.stack else ""
        if lang in ("javascript", "typescript"):
            if (m := _JS_FUNC.search("\n" + before)) and not re.search(r"[=(,:]\s*$", before[: max(0, m.start(1) - 1)]):
                self.function(m[2], self.owner(), start + m.start(1) - 1, flat, paren)
                return True
            if inside not in ("class", "literal") or re.search(r"\bfunction\b", before):
                return False
        elif lang == "java" and inside != "class" or lang == "c" and inside not in ("", "block"):
            return False
        m = _METHOD.search(before)
        if not m or lang == "c" and (not re.match(r"[\w*\s]+$", before[: m.start("name")]) or not before[: m.start("name")].strip()):
            return False
        name = ANONYMOUS if lang == "c" else m["name"]
        self.functions.append([name, "" if lang == "c" else self.owner(), start, None, None if lang == "c" else self.params(paren)])
        return True

    @staticmethod
    def text_rfind_params(flat: str) -> int:
        """The end of the parameters, before a type of the result."""
        m = re.search(r"\)\s*:[^)]*$", flat)
        return m.start() if m else flat.rfind(")")

    def params(self, paren: int) -> int:
        """How many parameters stand in the brackets that open at a place."""
        parts, depth, begin = [], 0, paren + 1
        for i in range(paren + 1, len(self.text)):
            c = self.text[i]
            if c in "([{<" and not (c == "<" and self.lang == "go"):
                depth += 1
            elif c in ")]}" or c == ">" and self.lang != "go" and self.text[i - 1] not in "=-":
                if depth == 0 and c == ")":
                    parts.append(self.text[begin:i].strip())
                    break
                depth -= 1
            elif c == "," and depth == 0:
                parts.append(self.text[begin:i].strip())
                begin = i + 1
        parts = [p for p in parts if p]
        if self.lang == "go":
            return sum("..." not in p for p in parts)
        if self.lang == "rust":
            return sum(not re.match(r"(&\s*('\w+\s+)?)?(mut\s+)?self\b", p) for p in parts)
        if self.lang == "javascript":
            return sum(p[0] not in "{[" or bool(re.search(r"[}\]]\s*=", p)) for p in parts)
        return len(parts)

    def arrows(self) -> None:
        opened = {a: b for b, a in self.pairs.items()}
        spans = sorted(((a, b) for b, a in self.pairs.items()), key=lambda x: x[0])
        for m in _ARROW.finditer(self.text):
            start = m.start("one") if m["one"] else self.pairs.get(m.start())
            if start is None:
                continue
            body = re.compile(r"\s*").match(self.text, m.end()).end()
            if self.text[body : body + 1] == "{":
                end = opened.get(body, len(self.text) - 1)
            else:
                around = min((b for a, b in spans if a < start < b), default=len(self.text))
                end, at = around - 1, body
                while at < around:
                    if at in opened:
                        at = opened[at]
                    elif self.text[at] in ",;":
                        end = at - 1
                        break
                    at += 1
                end = body + len(self.text[body : end + 1].rstrip()) - 1
            owner = next((f[1] for f in sorted(self.functions, key=lambda f: f[3] - f[2]) if f[2] <= start <= f[3]), "")
            self.functions.append([ANONYMOUS, owner, start, max(end, start), self.params(start) if not m["one"] else 1])
