"""Extraction as a DataFrame operator: files in, chunks out."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.paths import chunk_id
from tessera.functions.text import tokenise_code
from tessera.schema import META
from tessera.sources.languages import Language

RAW = f"file_path string, blob_sha string, kind string, name string, scope string, language string, content string, line_start int, line_end int, metadata {META}"


def extract_symbols(files: DataFrame, serials: list[tuple[str, int]] = (), languages: Mapping[str, Language] | None = None) -> DataFrame:
    """Chunks of files (file_path, blob_sha, language, content), with ids and tokens.

    Parsing is Python's part and is fed in Arrow batches; ids, tokens and serials are Spark
    expressions. Files are independent, so nothing is shuffled. ``languages`` are registrations with
    extractors and hooks of their own; they travel to the workers with the function. Statements that give the same id
    twice are kept once by the upsert.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tessera.sources.extract.registry import extract_file

        columns = ["file_path", "blob_sha", "kind", "name", "scope", "language", "content", "line_start", "line_end", "metadata"]
        for batch in batches:
            rows = [{"file_path": f.file_path, "blob_sha": f.blob_sha, **c} for f in batch.itertuples() for c in extract_file(f.file_path, f.content or "", f.language or "", languages=languages)]
            yield pd.DataFrame(rows, columns=columns)

    out = files.select("file_path", "blob_sha", "language", "content").mapInPandas(run, RAW)
    serial = F.lit(1)
    for language, n in serials:
        serial = F.when(F.col("language") == language, n).otherwise(serial)
    return out.withColumns(
        {
            "id": chunk_id(F.col("file_path"), F.col("blob_sha"), F.col("name"), F.col("line_start")),
            "extraction_serial": serial,
            "content_tokens": tokenise_code(F.col("content")),
            "name_tokens": tokenise_code(F.col("name")),
            "embedding": F.lit(None).cast("array<float>"),
            "embedding_truncated": F.lit(False),
        }
    )
