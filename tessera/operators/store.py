"""Reads and mutations of the index as pure functions over DataFrames.

A chunk is stored once per content and path and seen through ``file_snapshots``, so a row of a
result is a chunk in a repository at a snapshot. Mutations return the new table.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.schema import CHUNK_RESULT

SNAPSHOT_KEY = ["repo_id", "snapshot_sha"]


@dataclass(frozen=True)
class Store:
    """The index's tables."""

    chunks: DataFrame
    file_snapshots: DataFrame
    edges: DataFrame
    repos: DataFrame
    indexed_snapshots: DataFrame
    watched_refs: DataFrame
    #: The full-text index over ``chunks``, where one has been written: (term, id, tf, dl, bucket) and one row of statistics.
    postings: DataFrame | None = None
    posting_stats: DataFrame | None = None
    #: (key, value): the version of the schema, the embedding model and its version.
    meta: DataFrame | None = None

    def but(self, **tables: DataFrame) -> Store:
        """The store with other tables; postings don't outlive the chunks that they were built from."""
        if "chunks" in tables and "postings" not in tables:
            tables |= {"postings": None, "posting_stats": None}
        return replace(self, **tables)


# --- reads ------------------------------------------------------------------

def at_snapshots(store: Store, refs: DataFrame | None = None, repo_id: int | None = None, snapshot: str | None = None, once: bool = False) -> DataFrame:
    """Chunks visible at the given snapshot, or at each (repo_id, snapshot_sha) of ``refs``; one row per snapshot that holds the chunk, with ``once`` per repository.

    ``refs`` is a request's handful of snapshots; Spark broadcasts it when its measured size is
    small and shuffles otherwise.
    """
    snaps = store.file_snapshots
    if repo_id is not None:
        snaps = snaps.filter(F.col("repo_id") == repo_id)
    if snapshot is not None:
        snaps = snaps.filter(F.col("snapshot_sha") == snapshot)
    if refs is not None:
        snaps = snaps.join(refs.select(*SNAPSHOT_KEY).distinct(), SNAPSHOT_KEY, "left_semi")
    snaps = snaps.select("repo_id", "file_path", "blob_sha").distinct() if once else snaps.select("repo_id", "snapshot_sha", "file_path", "blob_sha")
    return store.chunks.join(snaps, ["blob_sha", "file_path"])


def as_result(df: DataFrame, *extra: str) -> DataFrame:
    """The columns that queries return: vectors never leave, only whether there is one."""
    return df.withColumn("has_embedding", F.col("embedding").isNotNull()).select(*CHUNK_RESULT, *extra)


def get_chunks(store: Store, repo_id: int, snapshot: str, file_path: str | None = None, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Chunks at a snapshot in order of path and line; predicates that aren't given leave no trace in the plan."""
    out = at_snapshots(store, repo_id=repo_id, snapshot=snapshot)
    for column, value in (("file_path", file_path), ("kind", kind), ("name", name)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return as_result(out).orderBy("file_path", "line_start", "id")


def get_unembedded(store: Store, repo_id: int, snapshot: str, limit: int = 1000) -> DataFrame:
    """The next page of chunks without a vector, in a stable order."""
    return at_snapshots(store, repo_id=repo_id, snapshot=snapshot).filter(F.col("embedding").isNull()).select("id", "name", "content", "file_path", "line_start").orderBy("file_path", "line_start", "id").limit(limit)


def get_edges(store: Store, refs: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    out = store.edges.join(refs.select(*SNAPSHOT_KEY).distinct(), SNAPSHOT_KEY, "left_semi")
    for column, value in (("source_id", source), ("target_id", target), ("kind", kind)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def chunk_paths(store: Store, ids: DataFrame) -> DataFrame:
    return store.chunks.join(ids.select("id").distinct(), "id", "left_semi").select("id", "file_path")


def inbound_refs(store: Store, refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that point to ``targets``, each with its source chunk."""
    edges = get_edges(store, refs).join(targets.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    src = store.chunks.select(F.col("id").alias("source_id"), "file_path", F.col("kind").alias("source_kind"), "name", "line_start")
    return edges.join(src, "source_id").select("source_id", "target_id", "kind", "repo_id", "file_path", "source_kind", "name", "line_start").orderBy("file_path", "line_start", "source_id", "target_id")


def inbound_degree(store: Store, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Inbound edges per chunk over all ``refs``: a shared chunk gathers the edges of every repository."""
    edges = get_edges(store, refs)
    if ids is not None:
        edges = edges.join(ids.select(F.col("id").alias("target_id")).distinct(), "target_id", "left_semi")
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("degree"))


def latest_snapshots(store: Store) -> DataFrame:
    """The snapshot indexed last in each repository."""
    return store.indexed_snapshots.groupBy("repo_id").agg(F.max_by("snapshot_sha", F.struct("indexed_at", "snapshot_sha")).alias("snapshot_sha"), F.max("indexed_at").alias("indexed_at"))


def snapshot_languages(store: Store, paths: DataFrame) -> DataFrame:
    """(repo_id, file_path, detected_language): for every (repo_id, file_path) that some snapshot has, the language stored at the snapshot that is first by name."""
    rows = store.file_snapshots.join(paths.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_semi")
    return rows.groupBy("repo_id", "file_path").agg(F.min_by("detected_language", "snapshot_sha").alias("detected_language"))


def snapshot_language(store: Store, repo_id: int, file_path: str) -> DataFrame:
    """``snapshot_languages`` of one path."""
    rows = store.file_snapshots.filter((F.col("repo_id") == repo_id) & (F.col("file_path") == file_path))
    return rows.groupBy("repo_id", "file_path").agg(F.min_by("detected_language", "snapshot_sha").alias("detected_language")).select("detected_language")


def list_repos(store: Store) -> DataFrame:
    """Repositories by path, with the number of their watched refs."""
    watched = store.watched_refs.groupBy(F.col("repo_id").alias("id")).agg(F.count("*").alias("watched"))
    return store.repos.join(watched, "id", "left").select("id", "path", F.coalesce("watched", F.lit(0)).cast("long").alias("watched")).orderBy("path")


def snapshot_status(store: Store) -> DataFrame:
    """Chunks in all and with vectors for every snapshot, in one aggregate instead of two counts a snapshot."""
    return at_snapshots(store).groupBy(*SNAPSHOT_KEY).agg(F.count("*").alias("total"), F.count("embedding").alias("embedded"))


def read_blob(store: Store, snapshot: str, paths: DataFrame, repo_id: int | None = None) -> DataFrame:
    """Stored chunks (blob_sha, content) of the given paths at a snapshot, of one repository or all."""
    at = store.file_snapshots.filter(F.col("snapshot_sha") == snapshot).join(paths.select("file_path").distinct(), "file_path", "left_semi")
    at = at if repo_id is None else at.filter(F.col("repo_id") == repo_id)
    return store.chunks.join(at.select("file_path", "blob_sha"), ["file_path", "blob_sha"], "left_semi").select("blob_sha", "content")


def indexed_flags(store: Store, snapshot: str) -> DataFrame:
    """(id, has, has_any) of every repository: whether ``snapshot``, and whether any, is indexed."""
    per = store.indexed_snapshots.groupBy("repo_id").agg(F.max(F.col("snapshot_sha") == snapshot).alias("has"), F.lit(True).alias("has_any"))
    out = store.repos.join(per, F.col("id") == F.col("repo_id"), "left")
    return out.select("id", F.coalesce("has", F.lit(False)).alias("has"), F.coalesce("has_any", F.lit(False)).alias("has_any"))


def all_content(store: Store) -> DataFrame:
    return store.chunks.select("file_path", "name", "line_start", "content")


def watched_status(store: Store, refs: DataFrame) -> DataFrame:
    """(repo_id, ref, sha, indexed, total, embedded) of every watched ref.

    ``refs`` holds (repo_id, name, sha). A ref is the one of that name, else that of the name at
    origin, else a full sha as it stands; a ref that resolves to nothing has a null sha. Counts are
    those of the snapshot, 0 where it isn't indexed.
    """
    names = refs.groupBy("repo_id", "name").agg(F.max("sha").alias("sha"))
    exact = names.select("repo_id", F.col("name").alias("ref"), F.col("sha").alias("s1"))
    remote = names.filter(F.startswith("name", F.lit("origin/"))).select("repo_id", F.substr("name", F.lit(8)).alias("ref"), F.col("sha").alias("s2"))
    literal = F.when(F.rlike("ref", F.lit("^[0-9a-fA-F]{40}$")), F.col("ref"))
    at = store.watched_refs.join(exact, ["repo_id", "ref"], "left").join(remote, ["repo_id", "ref"], "left").select("repo_id", "ref", F.coalesce("s1", "s2", literal).alias("sha"))
    done = store.indexed_snapshots.select("repo_id", F.col("snapshot_sha").alias("sha"), F.lit(True).alias("indexed"))
    counts = snapshot_status(store).withColumnRenamed("snapshot_sha", "sha")
    out = at.join(done, ["repo_id", "sha"], "left").join(counts, ["repo_id", "sha"], "left")
    zero = lambda c: F.when(F.col("indexed"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return out.select("repo_id", "ref", "sha", F.coalesce("indexed", F.lit(False)).alias("indexed"), zero("total"), zero("embedded"))


def get_meta(store: Store, *keys: str) -> DataFrame:
    """(key, value) of those keys that are set."""
    return store.meta.filter(F.col("key").isin(*keys))


def blobs_current(store: Store, wanted: DataFrame, serials: DataFrame) -> DataFrame:
    """(blob_sha, up_to_date) of ``wanted`` (blob_sha, language).

    A blob is current if it has a chunk in the wanted language and no chunk whose language and
    extraction serial ``serials`` lacks; a blob without chunks isn't.
    """
    known = serials.select(F.col("language").alias("language"), "extraction_serial", F.lit(True).alias("known"))
    chunks = store.chunks.select("blob_sha", "language", "extraction_serial").join(F.broadcast(known), ["language", "extraction_serial"], "left")  # one row a language
    per = wanted.select("blob_sha", F.col("language").alias("wanted")).join(chunks, "blob_sha", "left").groupBy("blob_sha", "wanted")
    return per.agg(((F.count_if(F.col("language") == F.col("wanted")) > 0) & (F.count_if(F.col("language").isNotNull() & F.col("known").isNull()) == 0)).alias("up_to_date")).select("blob_sha", "up_to_date")


def changed_files(store: Store, repo_id: int, base: str, head: str) -> DataFrame:
    """Paths whose blob differs between two snapshots, deleted and new ones among them."""
    side = lambda sha, name: store.file_snapshots.filter((F.col("repo_id") == repo_id) & (F.col("snapshot_sha") == sha)).select("file_path", F.col("blob_sha").alias(name))
    both = side(base, "b").join(side(head, "h"), "file_path", "full")
    return both.filter(~F.col("b").eqNullSafe(F.col("h"))).select("file_path")


def names_for_commits(refs: DataFrame) -> DataFrame:
    """Reference names of every commit, sorted."""
    return refs.groupBy("sha").agg(F.array_sort(F.collect_set("name")).alias("names"))


def resolve_refs(wanted: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, sha): the ref itself, else the one of the same name at origin, else a full sha as it stands."""
    exact = refs.select(F.col("name").alias("n1"), F.col("sha").alias("s1"))
    remote = refs.select(F.col("name").alias("n2"), F.col("sha").alias("s2"))
    out = wanted.join(exact, F.col("ref") == F.col("n1"), "left").join(remote, F.concat(F.lit("origin/"), "ref") == F.col("n2"), "left")
    literal = F.when(F.rlike("ref", F.lit("^[0-9a-fA-F]{40}$")), F.col("ref"))
    return out.select("ref", F.coalesce("s1", "s2", literal).alias("sha"))


# --- mutations ----------------------------------------------------------------

def upsert_chunks(chunks: DataFrame, staged: DataFrame) -> DataFrame:
    """Staged chunks replace stored ones of the same id, but a vector that is stored stays. Repeats of an id within the batch count once."""
    columns = chunks.columns
    ids = staged.select("id").distinct()
    untouched = chunks.join(ids, "id", "left_anti").select(*columns)  # a small batch is broadcast here, and the store isn't shuffled
    new = staged.select("*", F.lit(0).alias("__age"))
    old = chunks.join(ids, "id", "left_semi").select("*", F.lit(1).alias("__age"))
    both = new.unionByName(old, allowMissingColumns=True)
    w = Window.partitionBy("id")
    ranked = both.withColumn("__n", F.row_number().over(w.orderBy("__age", *[F.col(c) for c in ("file_path", "line_start") if c in both.columns])))
    kept = ranked.withColumn("embedding", F.max(F.struct((F.col("__age") == 1).alias("o"), F.col("embedding"))).over(w)["embedding"])
    if "embedding_truncated" in both.columns:
        kept = kept.withColumn("embedding_truncated", F.coalesce(F.max(F.when(F.col("__age") == 1, F.col("embedding_truncated"))).over(w), F.lit(False)))
    return untouched.unionByName(kept.filter("__n = 1").select(*columns))


def set_meta(store: Store, **values: str) -> Store:
    """The keys take these values; others keep theirs."""
    spark = store.chunks.sparkSession
    rows = spark.createDataFrame(list(values.items()), "key string, value string")
    return store.but(meta=rows if store.meta is None else replace_rows(store.meta, rows, ["key"]))


def wipe(store: Store) -> Store:
    """Every table without its rows; the settings go too."""
    none = lambda df: None if df is None else df.limit(0)
    return Store(*[none(getattr(store, f.name)) for f in fields(Store)])


def replace_rows(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` take the place of rows with the same keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def insert_missing(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys aren't there yet are added once."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def replace_snapshot(table: DataFrame, repo_id: int, snapshot: str, rows: DataFrame) -> DataFrame:
    """All rows of a snapshot are exchanged for ``rows``."""
    return delete_where(table, (F.col("repo_id") == repo_id) & (F.col("snapshot_sha") == snapshot)).unionByName(rows.select(*table.columns))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    return table.filter(~F.coalesce(condition, F.lit(False)))


def update_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (id, embedding, truncated) set on their chunks; other chunks keep what they have."""
    new = vectors.select("id", F.col("embedding").alias("__e"), F.col("truncated").alias("__t"), F.lit(True).alias("__new"))
    out = chunks.join(new, "id", "left")
    values = {"embedding": F.when(F.col("__new"), F.col("__e")).otherwise(F.col("embedding")), "embedding_truncated": F.when(F.col("__new"), F.col("__t")).otherwise(F.col("embedding_truncated"))}
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in chunks.columns])


def clear_embeddings(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns({"embedding": F.lit(None).cast(chunks.schema["embedding"].dataType), "embedding_truncated": F.lit(False)})


def mark_indexed(table: DataFrame, repo_id: int, snapshot: str, at: Column | None = None) -> DataFrame:
    row = table.sparkSession.range(1).select(F.lit(repo_id).cast("int").alias("repo_id"), F.lit(snapshot).alias("snapshot_sha"), (F.current_timestamp() if at is None else at).alias("indexed_at"))
    return replace_rows(table, row, SNAPSHOT_KEY)


def register_repos(repos: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths that aren't registered get the next ids in order of path; the others keep theirs."""
    new = paths.select("path").distinct().join(repos.select("path"), "path", "left_anti")
    top = repos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    ids = (F.row_number().over(Window.orderBy("path")) + F.col("top")).cast("int")  # repositories, not files: few rows
    return repos.unionByName(new.crossJoin(F.broadcast(top)).select(ids.alias("id"), "path"))


def orphan_chunks(store: Store) -> DataFrame:
    """Chunks that no snapshot of any repository references, by blob and path together."""
    return store.chunks.join(store.file_snapshots.select("blob_sha", "file_path"), ["blob_sha", "file_path"], "left_anti")


def sweep_chunks(store: Store) -> Store:
    return store.but(chunks=store.chunks.join(store.file_snapshots.select("blob_sha", "file_path"), ["blob_sha", "file_path"], "left_semi").select(*store.chunks.columns))


def prune_edges(store: Store, repo_id: int) -> Store:
    """Edges of a repository at snapshots that have no files any more go."""
    live = store.file_snapshots.filter(F.col("repo_id") == repo_id).select("snapshot_sha").distinct()
    own = store.edges.filter(F.col("repo_id") == repo_id).join(live, "snapshot_sha", "left_semi").select(*store.edges.columns)
    return store.but(edges=store.edges.filter(F.col("repo_id") != repo_id).unionByName(own))


def sweep_incomplete(store: Store) -> Store:
    """Files and edges of snapshots that were never completed go, in repositories with a completed one."""
    done, built = store.indexed_snapshots.select(*SNAPSHOT_KEY), store.indexed_snapshots.select("repo_id").distinct()

    def kept(table: DataFrame) -> DataFrame:
        doubtful = table.join(built, "repo_id", "left_semi").join(done, SNAPSHOT_KEY, "left_semi")
        return table.join(built, "repo_id", "left_anti").unionByName(doubtful.select(*table.columns)).select(*table.columns)

    return store.but(file_snapshots=kept(store.file_snapshots), edges=kept(store.edges))


def forget_repo(store: Store, repo_id: int) -> Store:
    """Everything of a repository but its chunks, which others may share."""
    gone = lambda table: delete_where(table, F.col("repo_id") == repo_id)
    return store.but(file_snapshots=gone(store.file_snapshots), edges=gone(store.edges), repos=delete_where(store.repos, F.col("id") == repo_id), indexed_snapshots=gone(store.indexed_snapshots), watched_refs=gone(store.watched_refs))


def orphan_repo_ids(store: Store) -> DataFrame:
    """Repositories with files at a snapshot that was never completed."""
    return store.file_snapshots.join(store.indexed_snapshots.select(*SNAPSHOT_KEY), SNAPSHOT_KEY, "left_anti").select("repo_id").distinct()
