"""Raw feeds of a hosting service, read from exported JSON, and the tables they fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import columns as C
from ..operators import commits as commit_ops
from ..operators import users as user_ops


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON record per line; the schema is declared, never inferred."""
    return spark.read.schema(schema).json(path)


def stream_files(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of a Parquet table, whether it is one file or a folder of part files.

    A stream lists folders only, so a single file is listed in its folder by name.
    """
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = location.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if files.getFileStatus(location).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", location.getName()).parquet(location.getParent().toString())


def parse_json(lines: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """The same from a column of JSON text, as a message source delivers it."""
    return lines.select(F.from_json(column, schema).alias("record")).select("record.*")


# Repositories


def matching_repositories(raw: DataFrame, prefix: str) -> DataFrame:
    return raw.where(F.col("name").startswith(prefix))


def new_repositories(raw: DataFrame, known: DataFrame, prefix: str = "") -> DataFrame:
    """Repositories of the feed that begin with the prefix and are not stored yet."""
    found = (
        matching_repositories(raw, prefix)
        .select(F.col("name").alias("repository_name"), F.col("owner").alias("organisation_name"))
        .distinct()
    )
    keys = ["repository_name", "organisation_name"]
    return found.join(known.select(*keys), keys, "left_anti")


def stamp_fetched(repositories: DataFrame, raw: DataFrame, prefix: str, now: str) -> DataFrame:
    """The repository table with ``last_fetched_at`` set on the rows this fetch covered."""
    seen = (
        matching_repositories(raw, prefix)
        .select(F.col("name").alias("repository_name"), F.col("owner").alias("organisation_name"))
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    return (
        repositories.join(seen, ["repository_name", "organisation_name"], "left")
        .withColumn("last_fetched_at", F.when(F.col("_seen"), C.utc_literal(now)).otherwise(F.col("last_fetched_at")))
        .select(*repositories.columns)
    )


def list_repositories(repositories: DataFrame) -> DataFrame:
    return repositories.select(
        "repo_id",
        "repository_name",
        "organisation_name",
        F.concat_ws(" -- ", "organisation_name", "repository_name").alias("display_text"),
    )


# Commits


def branch_sightings(raw: DataFrame) -> DataFrame:
    return raw.select("repo_id", F.col("sha").alias("sha1"), "branch")


def _total(field: str) -> Column:
    return F.aggregate("files", F.lit(0).cast("bigint"), lambda total, file: total + F.coalesce(file[field], F.lit(0)))


def _touched(file: Column) -> Column:
    return (file["additions"] != 0) | (file["deletions"] != 0) | (file["changes"] != 0)


def commit_rows(raw: DataFrame) -> DataFrame:
    """Raw commit records as commit columns, people still by name and email."""
    files = raw.withColumn("files", F.coalesce("files", F.from_json(F.lit("[]"), raw.schema["files"].dataType)))
    return files.select(
        "repo_id",
        "seq",
        F.col("sha").alias("sha1"),
        F.col("author.name").alias("author_name"),
        F.col("author.email").alias("author_email"),
        F.col("committer.name").alias("committer_name"),
        F.col("committer.email").alias("committer_email"),
        F.col("message").alias("commit_message"),
        C.utc_instant(F.col("date")).alias("commit_date"),
        C.is_merge(F.col("parents")).alias("is_merge_commit"),
        C.only_parent(F.col("parents")).alias("parent"),
        _total("additions").alias("lines_added"),
        _total("deletions").alias("lines_removed"),
        _total("changes").alias("lines_changed"),
        F.size(F.filter("files", _touched)).cast("bigint").alias("files_changed"),
        "url",
    )


def ingest_commits(raw: DataFrame) -> DataFrame:
    """One row per commit, from the record that was seen first."""
    return commit_ops.first_sightings(commit_rows(raw)).drop("seq")


def find_new_commits(fetched: DataFrame, known: DataFrame) -> DataFrame:
    """Commits whose sha is not stored for their repository; a stored one keeps its first version."""
    return fetched.join(known.select("repo_id", "sha1"), ["repo_id", "sha1"], "left_anti")


def ingest_commit_files(raw: DataFrame) -> DataFrame:
    """One row per commit and file, from the record that was seen first."""
    first = commit_ops.first_sightings(raw.select("repo_id", F.col("sha").alias("sha1"), "seq", "files"))
    return first.select("repo_id", "sha1", F.explode("files").alias("file")).select(
        "repo_id",
        "sha1",
        "file.filename",
        F.col("file.additions").alias("lines_added"),
        F.col("file.deletions").alias("lines_deleted"),
        F.col("file.changes").alias("lines_changed"),
        F.col("file.blob_url").alias("url"),
        F.col("file.patch").alias("patch"),
    )


# Pull requests


def ingest_pull_requests(raw: DataFrame) -> DataFrame:
    """One row per pull request in any state, from its first page."""
    rows = raw.select(
        "repo_id",
        "number",
        "page",
        C.utc_instant(F.col("created_at")).alias("opened_at"),
        C.utc_instant(F.col("closed_at")).alias("closed_at"),
        F.col("user.name").alias("opened_by_name"),
        F.col("user.email").alias("opened_by_email"),
        F.col("merged_by.name").alias("merged_by_name"),
        F.col("merged_by.email").alias("merged_by_email"),
        "title",
        "body",
        "url",
    )
    return commit_ops.first_sightings(rows, "page", ("repo_id", "number")).drop("page")


def ingest_pr_comments(raw: DataFrame) -> DataFrame:
    """Issue comments and review comments of all pages in one table; repeats are kept."""

    def marked(column: str, kind: str) -> Column:
        pairs = F.transform(column, lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))
        return F.coalesce(pairs, F.array())

    both = F.concat(marked("comments", "issue"), marked("review_comments", "review"))
    return raw.select("repo_id", "number", F.explode(both).alias("m")).select(
        "repo_id",
        "number",
        "m.kind",
        F.col("m.c.user.name").alias("commenter_name"),
        F.col("m.c.user.email").alias("commenter_email"),
        F.col("m.c.body").alias("comment"),
        C.utc_instant(F.col("m.c.created_at")).alias("created_at"),
    )


# People


def commit_identities(raw: DataFrame) -> DataFrame:
    people = F.explode(F.array("author", "committer")).alias("who")
    return raw.select(people).where(F.col("who.name").isNotNull()).select("who.name", "who.email").distinct()


def review_identities(raw: DataFrame) -> DataFrame:
    def commenters(column: str) -> Column:
        return F.coalesce(F.transform(column, lambda c: c["user"]), F.array())

    people = F.concat(F.array("user", "merged_by"), commenters("comments"), commenters("review_comments"))
    return (
        raw.select(F.explode(people).alias("who"))
        .where(F.col("who.name").isNotNull())
        .select("who.name", "who.email")
        .distinct()
    )


def ingest_users(
    raw_commits: DataFrame, raw_pull_requests: DataFrame, users: DataFrame, domain: str, weak: bool = False
) -> DataFrame:
    """The users that a commit feed and a pull request feed add to the known ones."""
    people = commit_identities(raw_commits).unionByName(review_identities(raw_pull_requests))
    return user_ops.new_users(people, users, domain, weak)


def with_user_id(rows: DataFrame, users: DataFrame, role: str, domain: str, weak: bool = False) -> DataFrame:
    """Replaces ``<role>_name`` and ``<role>_email`` by ``<role>_id``; unknown people become NULL."""
    resolve = user_ops.resolve_weak if weak else user_ops.resolve_strict
    rest = [name for name in rows.columns if name not in (f"{role}_name", f"{role}_email")]
    named = rows.withColumnsRenamed({f"{role}_name": "name", f"{role}_email": "email"})
    return resolve(named, users, domain).withColumnRenamed("user_id", f"{role}_id").select(*rest, f"{role}_id")
