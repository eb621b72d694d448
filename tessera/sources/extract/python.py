"""Python by the standard library's parser; a file that doesn't parse has no symbols."""

from __future__ import annotations

import ast
import re

from tessera.sources.extract.base import Chunk, chunk, fold_comments, promoted


def parsed(text: str) -> ast.Module | None:
    """The syntax tree; None where the parser gives up, by its own stack (which it reports as a lack of memory) or ours too."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def extract(path: str, text: str) -> list[Chunk]:
    tree = parsed(text)
    if tree is None:
        return []
    lines = text.split("\n")
    out: list[Chunk] = []

    def piece(node: ast.stmt, first: int | None = None) -> tuple[int, int, str]:
        start = first or node.lineno
        return start, node.end_lineno, "\n".join(lines[start - 1 : node.end_lineno])

    def targets(node: ast.expr) -> list[str]:
        if isinstance(node, ast.Name):
            return [node.id]
        if isinstance(node, ast.Starred):
            return targets(node.value)
        return [n for e in node.elts for n in targets(e)] if isinstance(node, (ast.Tuple, ast.List)) else []

    def walk(body: list[ast.stmt], scope: list[str], in_class: bool, top: bool) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([d.lineno for d in node.decorator_list] + [node.lineno])
                start, end, content = piece(node, first)
                kind = "class" if isinstance(node, ast.ClassDef) else promoted("function", in_class)
                out.append(chunk(kind, node.name, start, end, content, "::".join(scope), "python"))
                walk(node.body, [*scope, node.name], isinstance(node, ast.ClassDef), False)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    out.append(chunk("import", ast.unparse(node), *piece(node), "", "python", module=a.name))
            elif isinstance(node, ast.ImportFrom):
                names = "" if any(a.name == "*" for a in node.names) else ",".join(a.name for a in node.names)
                out.append(chunk("import", ast.unparse(node), *piece(node), "", "python", module=node.module or "", names=names, dots=str(node.level) if node.level else ""))
            elif isinstance(node, ast.TypeAlias):
                out.append(chunk("class", node.name.id, *piece(node), "::".join(scope), "python"))
            elif top and isinstance(node, (ast.Assign, ast.AnnAssign)):
                for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    out.extend(chunk("variable", n, *piece(node), "", "python") for n in targets(t))
            else:
                for inner in ("body", "orelse", "finalbody"):
                    walk(getattr(node, inner, None) or [], scope, in_class, False)
                for h in getattr(node, "handlers", []):
                    walk(h.body, scope, in_class, False)

    walk(tree.body, [], False, True)
    if tree.body and isinstance(tree.body[0], ast.Expr) and isinstance(tree.body[0].value, ast.Constant) and isinstance(tree.body[0].value.value, str):
        start, end, content = piece(tree.body[0])
        out.append(chunk("comment", content.strip("\"' \n").split("\n")[0], start, end, content, "", "python"))
    return fold_comments(out, text, r"\s*#")


def doc_spans(text: str) -> list[tuple[str, int, int]]:
    """(symbol, first line, last line) of docstrings, and of comment blocks right above a symbol without one."""
    tree = parsed(text)
    if tree is None:
        return []
    lines, out = text.split("\n"), []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                out.append((node.name, first.lineno, first.end_lineno))
                continue
            end = start = min([d.lineno for d in node.decorator_list] + [node.lineno]) - 1
            while start and re.match(r"\s*#", lines[start - 1]):
                start -= 1
            if start < end:
                out.append((node.name, start + 1, end))
    return sorted(out, key=lambda s: s[1])
