"""YAML outlines against a generator of documents in every style."""

import json
import random

import pytest

from shelfspark.functions import outline

WORDS = ["guide", "F #1 guide", "a: b", "it's", 'say "x"', "- dash", "x:y", "#no", "", "two  spaces", "é ü", "[a]", "{b}", "tail ", "a, b", "\\ back", "1.10", "true", "?", "line\nbreak", "*star", "& and", "~", "null"]


def plain_ok(text, flow):
    if not text or text != text.strip() or "\n" in text or ": " in text or " #" in text or text.endswith(":") or text in ("~", "null", "?"):
        return False
    return text[0] not in "#-?:,[]{}&*!|>'\"%@`\\" and not (flow and set(text) & set(",[]{}:"))


def scalar(rng, text, flow=False, key=False):
    ways = ["double", "single"] if "\n" not in text else ["double"]
    if plain_ok(text, flow) and not (key and " #" in text):
        ways += ["plain"] * 3
    way = rng.choice(ways)
    if way == "double":
        return json.dumps(text, ensure_ascii=rng.random() < 0.3)
    return "'" + text.replace("'", "''") + "'" if way == "single" else text


def flow(rng, x):
    gap = rng.choice(["", " ", "\n      ", "  # note\n      "])
    if isinstance(x, list):
        return "[" + gap + (", " + gap).join(flow(rng, v) for v in x) + (rng.choice([",", ""]) if x else "") + gap + "]"
    if isinstance(x, dict):
        return "{" + gap + ", ".join(f"{scalar(rng, k, True, True)}: {flow(rng, v)}" for k, v in x.items()) + gap + "}"
    return scalar(rng, x, True)


def made(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.4:
        return rng.choice(WORDS)
    if kind < 0.7:
        return [made(rng, depth + 1) for _ in range(rng.randint(1, 3))]
    return {rng.choice(["name", "href", "items", "a key", "k:v", "q'", "é"]): made(rng, depth + 1) for _ in range(rng.randint(1, 3))}


def block(rng, x, column):
    """Lines after a dash or key, the first of which may go on in its line."""
    pad, note = " " * column, rng.choice(["", "", "  # note", "\n", f"\n{' ' * rng.randint(0, 9)}# a line"])
    if isinstance(x, str):
        if rng.random() < 0.25 and x == x.strip() and x and "  " not in x:
            mark = rng.choice(["|-", ">-"]) if "\n" not in x else "|-"
            return f" {mark}\n" + "".join(f"{pad}  {line}\n" for line in x.split("\n"))
        return f" {scalar(rng, x)}{note if not note.startswith(chr(10)) else ''}\n"
    if rng.random() < 0.25:
        return f" {flow(rng, x)}\n"
    lines = []
    for k, v in x.items() if isinstance(x, dict) else enumerate(x):
        head = f"{scalar(rng, k, False, True)}:" if isinstance(x, dict) else "-"
        lines.append(f"{pad}{head}" + block(rng, v, column + rng.choice([2, 4])))
    return note + "\n" + "".join(lines)


@pytest.mark.parametrize("seed", range(400))
def test_documents(seed):
    rng = random.Random(seed)
    tree = [made(rng) for _ in range(rng.randint(1, 4))] if rng.random() < 0.5 else {"items": made(rng), "z": made(rng)}
    text = block(rng, tree, 0).lstrip(" ")
    assert outline.read(text) == tree, text


def test_forms():
    text = """\ufeff--- # first
- name: "F #1 guide"   # quoted
  href: a.md#part
- name: >
    folded
    text

    more
  items:
  - name: Plain text
      over lines
    href: b
  - {name: flow, href: 'it''s', items: [{name: x}, y: z]}
-   - nested
    -
      k: v
- |+
    kept

- "two
   lines\\
   joined"
...
"""
    assert outline.read(text) == [
        {"name": "F #1 guide", "href": "a.md#part"},
        {"name": "folded text\nmore\n", "items": [{"name": "Plain text over lines", "href": "b"}, {"name": "flow", "href": "it's", "items": [{"name": "x"}, {"y": "z"}]}]},
        ["nested", {"k": "v"}], "kept\n\n", "two linesjoined",
    ]
    assert outline.read("") is None and outline.read("a:\nb: ~\n") == {"a": None, "b": None}


@pytest.mark.parametrize("text", ["- a\n  - b: c\n", "a: b: c\n", "- [a, b\n", "a: 'x\n", "- &x y\n", "a: *x\n", "a: 1\n---\nb: 2\n", "\tx: y\n", "a: \"\\q\"\n", "a: 'x' y\n", "- {a: b]\n", "a:\n    b: c\n  d: e\n"])
def test_unreadable(text):
    with pytest.raises(ValueError):
        outline.read(text)
