"""YAML as outlines of tables of contents are written in: nested lists and mappings by indentation, plain, quoted, block and
flow values, comments. Values are texts (null, ~ and nothing are None). Anchors, tags and several documents are not read."""

from __future__ import annotations

import re

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#&*!|>'"%@`\[\]{},-][^#]*?|[-?:][^\s#][^#]*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([1-9]?)([+-]?)([1-9]?)\s*(#.*)?$")
_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", re.S)

# Escapes of double-quoted text.
ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}


class _Lines:
    """The lines of a document; the one at hand may have been read in part."""

    def __init__(self, text: str):
        self.raw, self.at, self.rest = text.splitlines(), 0, None

    def now(self) -> tuple[int, str] | None:
        """Column and text of the line at hand; lines without content are passed over."""
        while self.at < len(self.raw):
            if self.rest:
                return self.rest
            line = self.raw[self.at]
            text = line.strip(" ")
            if text.startswith("\t"):
                self.fail("a tab is no indentation")
            if text.strip() and not text.startswith("#"):
                return len(line) - len(line.lstrip(" ")), text.rstrip()
            self.at += 1
        return None

    def keep(self, column: int, text: str) -> None:
        """The line at hand goes on with this."""
        self.rest = column, text

    def next(self) -> None:
        self.at, self.rest = self.at + 1, None

    def fail(self, why: str):
        raise ValueError(f"line {self.at + 1}: {why}")


def read(text: str):
    """What a document holds: lists, dictionaries, texts and None. A ValueError says which line can't be read."""
    lines = _Lines(text.removeprefix("\ufeff"))
    if (now := lines.now()) and re.match(r"---(\s|$)", now[1]):
        rest = now[1][3:].strip()
        lines.keep(now[0] + 4, rest) if rest and not rest.startswith("#") else lines.next()
    value = _node(lines, -1)
    if (now := lines.now()) and now[1] != "...":
        lines.fail("more than one document" if now[1].startswith("---") else "unexpected indentation")
    return value


def _is_item(text: str) -> bool:
    return text == "-" or text.startswith(("- ", "-\t"))


def _node(lines: _Lines, parent: int):
    """What starts at the line at hand, which is right of the column ``parent``."""
    now = lines.now()
    if now is None or now[0] <= parent:
        return None
    column, text = now
    if column == 0 and re.match(r"(---|\.\.\.)(\s|$)", text):
        return None
    return _items(lines, column) if _is_item(text) else _pairs(lines, column) if _KEY.match(text) else _value(lines, parent, text)


def _items(lines: _Lines, column: int) -> list:
    out = []
    while (now := lines.now()) and now[0] == column and _is_item(now[1]):
        text = now[1][1:].lstrip()
        if not text or text.startswith("#"):
            lines.next()
        else:
            lines.keep(column + len(now[1]) - len(text), text)
        out.append(_node(lines, column))
    return out


def _pairs(lines: _Lines, column: int) -> dict:
    out = {}
    while (now := lines.now()) and now[0] == column and (found := _KEY.match(now[1])):
        key, text = found[1], now[1][found.end() :].lstrip()
        key = _quoted(key) if key[0] in "\"'" else key
        if text and not text.startswith("#"):
            out[key] = _value(lines, column, text)
            continue
        lines.next()
        below = lines.now()
        # A list may stand in the column of its key.
        out[key] = _items(lines, column) if below and below[0] == column and _is_item(below[1]) else _node(lines, column)
    return out


def _value(lines: _Lines, parent: int, text: str):
    """A value that starts with this rest of the line at hand."""
    if text[0] in "[{\"'":
        flow = _Flow(lines, text)
        value = flow.value("")
        rest = flow.text[flow.at :]
        if rest.strip() and not re.match(r"\s+#", rest):
            lines.fail("text after a value")
        lines.next()
        return value
    if block := _BLOCK.match(text):
        lines.next()
        return _block(lines, parent, block[1] == ">", block[3], int(block[2] or block[4] or 0))
    if text[0] in "&*!%@`":
        lines.fail(f"values that start with {text[0]} are not read")
    parts = [_plain(lines, text)]
    ended = parts[0] != text
    lines.next()
    while not ended and (now := lines.now()) and now[0] > parent:
        if _KEY.match(now[1]):
            lines.fail("a key within a value")
        parts.append(_plain(lines, now[1]))
        ended = parts[-1] != now[1]
        lines.next()
    return _text(" ".join(parts))


def _plain(lines: _Lines, text: str) -> str:
    text = re.split(r"\s#", text, maxsplit=1)[0].rstrip()
    if re.search(r":(\s|$)", text):
        lines.fail("a second key in a line")
    return text


def _text(text: str) -> str | None:
    return None if text in ("", "~", "null", "Null", "NULL") else text


def _folded(text: str) -> str:
    """Line ends within quoted text: one is a space, of more each but the first stays."""
    return re.sub(r"[ \t]*\n[ \t\n]*", lambda m: "\n" * (m[0].count("\n") - 1) or " ", text)


def _quoted(text: str) -> str:
    if text[0] == "'":
        return _folded(text[1:-1].replace("''", "'"))

    def one(m: re.Match) -> str:
        if m[1][0] in "xuU":
            return chr(int(m[1][1:], 16))
        if m[1] not in ESCAPES:
            raise ValueError(f"unknown escape \\{m[1]}")
        return ESCAPES[m[1]]

    # Only what stands between escapes is folded; an escaped line end joins the lines.
    text = re.sub(r"(?<!\\)((?:\\\\)*)\\\n[ \t]*", r"\1", text[1:-1])
    parts, at = [], 0
    for m in _ESCAPE.finditer(text):
        parts += [_folded(text[at : m.start()]), one(m)]
        at = m.end()
    return "".join([*parts, _folded(text[at:])])


def _block(lines: _Lines, parent: int, folds: bool, chomp: str, indent: int) -> str:
    indent = max(parent, 0) + indent if indent else 0
    found: list[str] = []
    while lines.at < len(lines.raw):
        line = lines.raw[lines.at]
        column = len(line) - len(line.lstrip(" "))
        if line.strip(" "):
            indent = indent or column
            if column <= parent or column < indent:
                break
        found.append(line[indent:] if indent else "")
        lines.at += 1
    ends = len(found)
    while ends and not found[ends - 1]:
        ends -= 1
    body, more = found[:ends], len(found) - ends
    if folds:
        text = ""
        for i, line in enumerate(body):
            text += line
            if i + 1 == len(body):
                break
            deep = line[:1] in (" ", "\t") or body[i + 1][:1] in (" ", "\t")
            after = next((x for x in body[i + 1 :] if x), "")
            if not line or deep or (not body[i + 1] and after[:1] in (" ", "\t")):
                text += "\n"
            elif body[i + 1]:
                text += " "
    else:
        text = "\n".join(body)
    return text + {"-": "", "+": "\n" * (more + bool(body)), "": "\n" if body else ""}[chomp]


class _Flow:
    """Quoted texts and values in brackets, which may go on over lines."""

    def __init__(self, lines: _Lines, text: str):
        self.lines, self.text, self.at = lines, text, 0

    def more(self) -> None:
        """The next line, after a line end."""
        self.lines.rest = None
        self.lines.at += 1
        if self.lines.at >= len(self.lines.raw):
            self.lines.at -= 1
            self.lines.fail("a value without an end")
        self.text, self.at = self.lines.raw[self.lines.at], 0

    def skip(self) -> str:
        """To the next character that counts."""
        while True:
            self.at += len(self.text[self.at :]) - len(self.text[self.at :].lstrip())
            if self.at < len(self.text) and not (self.text[self.at] == "#" and (not self.at or self.text[self.at - 1].isspace())):
                return self.text[self.at]
            self.more()

    def quoted(self) -> str:
        mark, parts = self.text[self.at], []
        begin, self.at = self.at, self.at + 1
        while True:
            if self.at >= len(self.text):
                parts.append(self.text[begin:])
                self.more()
                begin = 0
                self.text = self.text.lstrip()
                continue
            c = self.text[self.at]
            if c == "\\" and mark == '"' and self.at + 1 < len(self.text):
                self.at += 2
            elif c == mark == "'" and self.text[self.at + 1 : self.at + 2] == "'":
                self.at += 2
            elif c == mark:
                self.at += 1
                return _quoted("\n".join([*parts, self.text[begin : self.at]]))
            else:
                self.at += 1

    def value(self, ends: str):
        c = self.skip()
        if c in "\"'":
            return self.quoted()
        if c == "[":
            return self.items()
        if c == "{":
            return self.pairs()
        if c in "&*!%@`|>":
            self.lines.fail(f"values that start with {c} are not read")
        found = re.compile(r"(?:[^,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<!\s)#)*").match(self.text, self.at)
        self.at = found.end()
        return _text(found[0].strip())

    def pair(self, end: str) -> tuple:
        """A key and its value; the value is missing if it has none."""
        key = None if self.skip() == ":" else self.value(end)
        if self.skip() != ":":
            return (key,)
        self.at += 1
        return key, None if self.skip() in ("," + end) else self.value(end)

    def _until(self, end: str):
        self.at += 1
        while self.skip() != end:
            yield self.pair(end)
            if (c := self.skip()) == ",":
                self.at += 1
            elif c != end:
                self.lines.fail(f"expected , or {end}")
        self.at += 1

    def items(self) -> list:
        return [x[0] if len(x) == 1 else {x[0]: x[1]} for x in self._until("]")]

    def pairs(self) -> dict:
        return {x[0]: x[1] if len(x) > 1 else None for x in self._until("}")}
