"""Text into chunks: overlapping line windows, and sections of marked-up prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.paths import chunk_id, compose_scope

LINES, OVERLAP = 50, 5


def line_windows(files: DataFrame, path: str = "file_path", text: str = "content", lines: int = LINES, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``lines`` lines that start every ``lines - overlap``, as long as the start is within the text; blank ones are left out.

    Columns: the file's own, and name, line_start, line_end, chunk (stripped text).
    """
    step = lines - overlap
    split = files.withColumn("__lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    starts = F.filter(F.sequence(F.lit(0), F.size("__lines"), F.lit(step)), lambda s: s < F.size("__lines"))
    out = split.select("*", F.explode(starts).alias("__start"))
    piece = F.slice("__lines", F.col("__start") + 1, F.lit(lines))
    body = F.regexp_replace(F.array_join(piece, "\n"), r"^\s+|\s+$", "")
    end = F.least(F.col("__start") + lines, F.size("__lines"))
    out = out.withColumns({"chunk": body, "line_start": F.col("__start") + 1, "line_end": end}).filter(F.col("chunk") != "")
    return out.withColumn("name", F.concat_ws("", F.col(path), F.lit(":"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))).drop("__lines", "__start")


def markdown_sections(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """Sections of ATX headings: (key, name, scope, level, line_start, content), a section's content ending at the next heading.

    The scope holds the open headings of smaller depth. Fenced code holds no headings. Texts
    without a heading give no row; line windows serve them.
    """
    lines = files.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    fence = F.rlike("line", F.lit(r"^\s*(```|~~~)")).cast("int")
    lines = lines.withColumn("fenced", F.sum(fence).over(w) % 2 == 1)
    mark = F.regexp_extract("line", r"^ {0,3}(#{1,6})(?:\s|$)", 1)
    lines = lines.withColumn("level", F.when(~F.col("fenced") & (mark != ""), F.length(mark)))
    lines = lines.withColumn("title", F.when(F.col("level").isNotNull(), F.regexp_replace(F.regexp_replace("line", r"^\s*#+\s*", ""), r"\s+#*\s*$", "")))
    lines = lines.withColumn("section", F.count("level").over(w))
    names = {f"h{d}": F.last(F.when(F.col("level") == d, F.col("title")), ignorenulls=True).over(w) for d in range(1, 7)}
    places = {f"p{d}": F.last(F.when(F.col("level") == d, F.col("n")), ignorenulls=True).over(w) for d in range(1, 7)}
    heads = lines.withColumns(names | places).filter(F.col("level").isNotNull())

    def open_at(d: int) -> Column:
        """The heading of depth d still open: no shallower one came after it."""
        reset = F.greatest(F.lit(-1), *[F.coalesce(F.col(f"p{e}"), F.lit(-1)) for e in range(1, d)]) if d > 1 else F.lit(-1)
        return F.when((F.col("level") > d) & (F.col(f"p{d}") > reset), F.col(f"h{d}"))

    scope = compose_scope(F.filter(F.array(*[open_at(d) for d in range(1, 6)]), lambda x: x.isNotNull()))
    heads = heads.select(key, "section", F.col("title").alias("name"), scope.alias("scope"), "level", (F.col("n") + 1).alias("line_start"))
    body = lines.filter(F.col("section") > 0).groupBy(key, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return heads.join(body, [key, "section"]).drop("section")


LINK = r"(?<!!)\[[^\]]*\]\(([^)\s]+)[^)]*\)"


def markdown_links(files: DataFrame, key: str = "file_path", text: str = "content") -> DataFrame:
    """Links to local files as import rows: (key, module, names), names being the fragment."""
    target = files.select(key, F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LINK), F.lit(1))).alias("target"))
    local = target.filter(~F.rlike("target", F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:|^//|^#")))
    fragment = F.when(F.contains("target", F.lit("#")), F.substring_index("target", "#", -1)).otherwise(F.lit(""))
    module = F.when(F.contains("target", F.lit("#")), F.expr("substring(target, 1, length(target) - length(substring_index(target, '#', -1)) - 1)")).otherwise(F.col("target"))
    return local.select(key, module.alias("module"), fragment.alias("names")).distinct()


def comment_runs(lines: DataFrame, key: str = "file_path", line: str = "line_start", end: str = "line_end") -> DataFrame:
    """Adds ``run``: comments that follow each other without a blank line share a number within their file."""
    w = Window.partitionBy(key).orderBy(line)
    starts = F.coalesce(F.col(line) > F.lag(end).over(w) + 1, F.lit(True)).cast("int")
    return lines.withColumn("__new", starts).withColumn("run", F.sum("__new").over(w)).drop("__new")


#: Marks of each markup.
RST_MARKS = (r"(?m)^[=\-~^\"'+#*]{3,}$", r"(?m)^\.\.\s+\w+::", r":\w+:`[^`]+`")
MARKDOWN_MARKS = (r"(?m)^#{1,6}\s+", r"(?m)^```")


def prose_markup(text: Column) -> Column:
    """``rst``, ``markdown`` or null: which of the two has more marks in the first 2048 characters; rst only if it has strictly more."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 2048)
    count = lambda patterns: sum((F.regexp_count(head, F.lit(p)) for p in patterns[1:]), F.regexp_count(head, F.lit(patterns[0])))
    rst, md = count(RST_MARKS), count(MARKDOWN_MARKS)
    return F.when((rst == 0) & (md == 0), F.lit(None).cast("string")).when(rst > md, "rst").otherwise("markdown")


def with_ids(chunks: DataFrame, path: str = "file_path", blob: str = "blob_sha") -> DataFrame:
    return chunks.withColumn("id", chunk_id(F.col(path), F.col(blob), F.col("name"), F.col("line_start")))
