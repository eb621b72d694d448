"""Garbage collection: which snapshots to keep, what dropping the others frees, and the drop itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.store import SNAPSHOT_KEY, Store, orphan_chunks, sweep_chunks, sweep_incomplete

MODES = ("HEAD_ONLY", "KEEP", "ORPHANS", "WATCHED", "WATCHED_ONLY")
KEPT_PREFIXES = ("refs/heads/", "refs/tags/", "refs/notes/")


def keep_set(mode: str, heads: DataFrame, local_refs: DataFrame, watched: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(repo_id, snapshot_sha) to keep.

    ``heads`` (repo_id, sha), ``local_refs`` (repo_id, name, sha), ``watched`` (repo_id, ref) and for
    KEEP ``named`` (repo_id, ref). A ref that doesn't resolve keeps nothing.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    pick = lambda df: df.select("repo_id", F.col("sha").alias("snapshot_sha"))
    by_name = local_refs.select("repo_id", "sha", F.explode(F.array("name", F.regexp_replace("name", "^refs/(heads|tags|remotes)/", ""))).alias("ref")).distinct()
    resolved = lambda refs: pick(refs.select("repo_id", "ref").distinct().join(by_name, ["repo_id", "ref"]))
    out = pick(heads)
    if mode == "KEEP" and named is not None:
        out = out.unionByName(resolved(named))
    if mode in ("WATCHED", "WATCHED_ONLY"):
        out = out.unionByName(resolved(watched))
    if mode == "WATCHED":
        kept = F.lit(False)
        for prefix in KEPT_PREFIXES:
            kept = kept | F.startswith("name", F.lit(prefix))
        out = out.unionByName(pick(local_refs.filter(kept)))
    return out.distinct()


def drop_set(store: Store, keep: DataFrame, worktrees: DataFrame | None = None) -> DataFrame:
    """Indexed snapshots outside ``keep``; the current working trees stay."""
    out = store.indexed_snapshots.select(*SNAPSHOT_KEY).join(keep, SNAPSHOT_KEY, "left_anti")
    return out if worktrees is None else out.join(worktrees, SNAPSHOT_KEY, "left_anti")


def chunk_split(store: Store, drop: DataFrame) -> DataFrame:
    """(dropped, kept): chunks that the dropped snapshots reference, by whether another snapshot still does.

    Two semi-joins on (blob, path); nothing is simulated, so it serves a dry run too.
    """
    place = ["blob_sha", "file_path"]
    dropped = store.file_snapshots.join(drop, SNAPSHOT_KEY, "left_semi").select(*place).distinct()
    others = store.file_snapshots.join(drop, SNAPSHOT_KEY, "left_anti").select(*place).distinct().withColumn("__kept", F.lit(True))
    found = store.chunks.select("id", *place).join(dropped, place, "left_semi").join(others, place, "left")
    return found.agg(F.count_if(F.col("__kept").isNull()).alias("dropped"), F.count("__kept").alias("kept"))


def dry_run(store: Store, drop: DataFrame) -> DataFrame:
    """One row: snapshots, file_snapshots, edges and chunks that dropping would remove."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    inside = lambda table: table.join(drop, SNAPSHOT_KEY, "left_semi")
    counts = one(drop, "snapshots").crossJoin(one(inside(store.file_snapshots), "file_snapshots")).crossJoin(one(inside(store.edges), "edges"))
    return counts.crossJoin(chunk_split(store, drop).select(F.col("dropped").alias("chunks")))


def drop_snapshots(store: Store, drop: DataFrame) -> Store:
    """The store without those snapshots and without the chunks that only they referenced."""
    left = lambda table: table.join(drop, SNAPSHOT_KEY, "left_anti").select(*table.columns)
    return sweep_chunks(store.but(file_snapshots=left(store.file_snapshots), edges=left(store.edges), indexed_snapshots=left(store.indexed_snapshots)))


def collect(store: Store, mode: str, heads: DataFrame, local_refs: DataFrame, named: DataFrame | None = None, worktrees: DataFrame | None = None) -> Store:
    """A full run: incomplete builds first, then the drop set, then chunks nobody references."""
    clean = sweep_incomplete(store)
    if mode == "ORPHANS":
        return sweep_chunks(clean)
    return drop_snapshots(clean, drop_set(clean, keep_set(mode, heads, local_refs, clean.watched_refs, named), worktrees))


def orphan_count(store: Store) -> DataFrame:
    return orphan_chunks(store).agg(F.count("*").alias("n"))
