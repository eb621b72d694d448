"""Symbol extraction without grammars: per language, a function from (path, text) to chunk dictionaries."""

from tessera.sources.extract.registry import EXTRACTORS, extract_file

__all__ = ["EXTRACTORS", "extract_file"]
