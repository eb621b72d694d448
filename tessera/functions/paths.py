"""Paths, names, references and identities as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def suffix(path: Column) -> Column:
    """The last extension with its dot; empty without one. A leading dot starts a name, not an extension."""
    return F.regexp_extract(path, r"[^/]+?(\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^./]+$", "")


def parent(path: Column) -> Column:
    """The directory; a path without one stays as it is."""
    return F.regexp_replace(path, r"/[^/]+$", "")


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")


def relative_parts(module: Column) -> Column:
    """struct<dots,rest>: ./x is (1, x), n times ../ is (n + 1, rest), anything else (0, module)."""
    ups = F.regexp_extract(module, r"^((?:\.\./)+)", 1)
    return (
        F.when(F.startswith(module, F.lit("./")), F.struct(F.lit(1).alias("dots"), F.substring(module, 3, 1 << 20).alias("rest")))
        .when(ups != "", F.struct((F.length(ups) / 3 + 1).cast("int").alias("dots"), F.regexp_replace(module, r"^(?:\.\./)+", "").alias("rest")))
        .otherwise(F.struct(F.lit(0).alias("dots"), module.alias("rest")))
    )


def substitute_prefix(module: Column, substitutions: list[tuple[str, str]]) -> Column:
    """The first prefix that fits is replaced."""
    out = None
    for prefix, new in substitutions:
        value = F.concat(F.lit(new), F.substring(module, len(prefix) + 1, 1 << 20))
        test = F.startswith(module, F.lit(prefix))
        out = F.when(test, value) if out is None else out.when(test, value)
    return module if out is None else out.otherwise(module)


def dotted_to_path(module: Column) -> Column:
    return F.translate(module, ".", "/")


def repo_relative(path: Column, root: str) -> Column:
    """The path below ``root`` with forward slashes, without doubled ones and ``./``."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), r"/(?:\./)*/*(?:\./)*", "/")
    top = "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in root.rstrip("/"))
    return F.regexp_replace(slashed, f"^(?:{top}/|\\./)", "")


def short_ref(ref: Column) -> Column:
    return F.regexp_replace(ref, r"^refs/(heads|tags|remotes)/", "")


def is_sha(ref: Column) -> Column:
    return F.rlike(ref, F.lit("^[0-9a-fA-F]{40}$"))


def slug(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def compose_scope(names: Column) -> Column:
    return F.array_join(F.filter(names, lambda n: n != ""), "::")


def chunk_id(path: Column, blob: Column, name: Column, line_start: Column) -> Column:
    """16 hex digits of the chunk's place: path, blob, name and 0-based first line."""
    return F.substring(F.sha2(F.concat_ws(":", path, blob, name, (line_start - 1).cast("string")), 256), 1, 16)


def version_parts(version: Column) -> Column:
    """A dotted version as integers; arrays compare as versions do."""
    return F.transform(F.split(version, r"\."), lambda p: p.cast("int"))


def is_binary(head: Column, sniffed: int = 8192) -> Column:
    """True where a NUL is among the first bytes."""
    return F.locate("\x00", F.substring(head.cast("binary"), 1, sniffed).cast("string")) > 0


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns cover the path: the last that fits decides, and ``!`` takes back."""
    out = F.lit(False)
    for pattern in patterns:
        regex, keep = ignore_regex(pattern)
        if regex:
            out = F.when(F.rlike(path, F.lit(regex)), F.lit(not keep)).otherwise(out)
    return out


def ignore_regex(pattern: str) -> tuple[str, bool]:
    """(regex over a relative path, whether it takes back) of one line of an ignore file; an empty regex for blanks and comments."""
    line = pattern.rstrip()
    if not line or line.startswith("#"):
        return "", False
    keep = line.startswith("!")
    line = line[keep:]
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
            continue
        if line[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in line[i + 1 :]:
            end = line.index("]", i + 1)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c, c if c.isalnum() or c in "_/" else "\\" + c)
        i += 1
    return ("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"), keep
