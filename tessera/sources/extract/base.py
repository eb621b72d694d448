"""What extractors share: the chunk dictionary, comment folding, and a scanner for languages with braces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

Chunk = dict


def chunk(kind: str, name: str, start: int, end: int, content: str, scope: str = "", language: str = "", **meta: str) -> Chunk:
    """Lines count from 1 and both ends belong to the chunk."""
    return {"kind": kind, "name": name, "scope": scope, "language": language, "content": content, "line_start": start, "line_end": end, "metadata": {"module": "", "names": "", "dots": "", "language_hint": ""} | meta}


def until_next(starts: list[int], total: int) -> list[int]:
    """Where each part ends if it goes on to the start of the next."""
    return [*starts[1:], total] if starts else []


def promoted(kind: str, nearest_is_class: bool) -> str:
    """A function right inside a class is a method."""
    return "method" if kind == "function" and nearest_is_class else kind


def fold_comments(chunks: list[Chunk], text: str, mark: str) -> list[Chunk]:
    """Comment runs right above a symbol become part of it; runs inside a symbol vanish; others stand alone.

    ``mark`` is a regex of a whole comment line. A run that a blank line parts from the symbol
    stays alone, and imports never take comments.
    """
    lines = text.split("\n")
    is_comment = [bool(re.match(mark, line)) for line in lines]
    inside = [(c["line_start"], c["line_end"]) for c in chunks if c["kind"] not in ("import", "comment")]
    by_start = {c["line_start"]: c for c in reversed(chunks) if c["kind"] not in ("import", "comment")}
    out, i = list(chunks), 0
    while i < len(lines):
        if not is_comment[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and is_comment[j]:
            j += 1
        start, end = i + 1, j
        below = by_start.get(end + 1)
        body = "\n".join(lines[i:j])
        if below is not None:
            below["content"], below["line_start"] = body + "\n" + below["content"], start
        elif not any(a <= start and end <= b for a, b in inside):
            out.append(chunk("comment", lines[i].strip(), start, end, body))
        i = j
    return sorted(out, key=lambda c: (c["line_start"], c["line_end"]))


@dataclass(frozen=True)
class Rule:
    """A declaration: ``pattern`` has a group ``name`` and matches at the start of a line's code."""

    kind: str
    pattern: str
    scope: bool = False
    top_only: bool = False
    class_like: bool = False


def masked(text: str, line_comment: str = "//", block: tuple[str, str] | None = ("/*", "*/"), quotes: str = "\"'`") -> str:
    """``text`` with comments and the inside of strings blanked, so that braces in them don't count. Length and lines stay."""
    out, i, n = list(text), 0, len(text)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if line_comment and text.startswith(line_comment, i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif block and text.startswith(block[0], i):
            end = text.find(block[1], i + len(block[0]))
            end = n if end < 0 else end + len(block[1])
            blank(i, end)
            i = end
        elif text[i] in quotes:
            q, j = text[i], i + 1
            while j < n and text[j] != q and (q == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            blank(i + 1, j)
            i = j + 1
        else:
            i += 1
    return "".join(out)


def scan_braces(text: str, rules: tuple[Rule, ...], language: str, line_comment: str = "//", quotes: str = "\"'`", class_like: tuple[str, ...] = ("class",)) -> Iterator[Chunk]:
    """Declarations of a language with braces: a declaration ends with its block, or at the semicolon or line end without one."""
    code = masked(text, line_comment, quotes=quotes)
    lines, plain = text.split("\n"), code.split("\n")
    offsets = [0]
    for line in plain:
        offsets.append(offsets[-1] + len(line) + 1)
    compiled = [(r, re.compile(r"\s*" + r.pattern)) for r in rules]
    open_scopes: list[tuple[int, str, bool]] = []  # end offset, name, class-like
    depth = 0
    for i, line in enumerate(plain):
        open_scopes = [s for s in open_scopes if s[0] > offsets[i]]
        for rule, pattern in compiled:
            m = pattern.match(line)
            if not m or (rule.top_only and depth > len([s for s in open_scopes])):
                continue
            end = _block_end(code, offsets[i] + m.end() - m.group().endswith("{"))
            last = code.count("\n", 0, max(end - 1, 0))
            raw = lines[i]
            name = raw[m.start("name") : m.end("name")].strip()
            scope = m.groupdict().get("receiver") or "::".join(s[1] for s in open_scopes if s[1])
            nearest = bool(open_scopes) and open_scopes[-1][2]
            yield chunk(promoted(rule.kind, nearest), name, i + 1, max(last, i) + 1, "\n".join(lines[i : max(last, i) + 1]), scope, language)
            if rule.scope:
                open_scopes.append((end, name, rule.class_like or rule.kind in class_like))
            break
        depth += line.count("{") - line.count("}")


def _block_end(code: str, at: int) -> int:
    """Offset after the block that opens next, or after the semicolon or line break that comes before any."""
    depth, round_ = 0, 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([":
            round_ += 1
        elif c in ")]":
            round_ -= 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif not depth and round_ <= 0 and (c == ";" or c == "\n" and not re.match(r"\s*(\{|[:,=]|->|where\b|throws\b|extends\b|implements\b)", code[i + 1 : i + 80])):
            return i + (c == ";")
    return len(code)
