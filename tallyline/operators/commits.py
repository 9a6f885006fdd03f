"""Commits and their files, parents, branches and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

DISPLAY = ("commit_date", "lines_added", "lines_removed", "lines_changed", "commit_message", "url")


def single_parent(commits: DataFrame) -> DataFrame:
    """Commits that are analysed: neither merges nor roots."""
    return commits.where(C.is_analysable(F.col("is_merge_commit"), F.col("parent")))


def in_window(commits: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Both ends inclusive; a window with only one end does not filter."""
    if start is None or end is None:
        return commits
    return commits.where(F.col("commit_date").between(C.utc_literal(start), C.utc_literal(end)))


def source_files(files: DataFrame) -> DataFrame:
    return files.where(C.is_source_file(F.col("filename")))


def without_gui_files(files: DataFrame) -> DataFrame:
    return files.where(~C.is_gui_file(F.col("filename")))


def _modified() -> Column:
    return (F.col("lines_added") != 0) | (F.col("lines_deleted") != 0) | (F.col("lines_changed") != 0)


def modified_files(files: DataFrame) -> DataFrame:
    return files.where(_modified())


def by_author(commits: DataFrame, authors: DataFrame) -> DataFrame:
    """Commits written by any of the given users (``user_id``)."""
    return commits.join(authors.select(F.col("user_id").alias("author_id")), "author_id", "left_semi")


def validate(commits: DataFrame) -> DataFrame:
    """Adds ``problem``: NULL for a row that may be stored, otherwise why it may not."""
    return commits.withColumn(
        "problem",
        F.when(F.col("author_id").isNull() & F.col("committer_id").isNull(), "no author or committer")
        .when(F.col("commit_message").isNull(), "no message")
        .when(F.col("sha1").isNull(), "no sha")
        .when(F.col("repo_id").isNull(), "no repository"),
    )


def display(commits: DataFrame) -> DataFrame:
    return commits.select("repo_id", "sha1", *DISPLAY)


def parent_fields(commits: DataFrame) -> DataFrame:
    """Merge flag and single parent from the list of parents."""
    return commits.select(
        "*",
        C.is_merge(F.col("parents")).alias("is_merge_commit"),
        C.only_parent(F.col("parents")).alias("parent"),
    ).drop("parents")


def of_repositories(repositories: DataFrame, commits: DataFrame) -> DataFrame:
    return commits.join(repositories.select("repo_id", "repository_name", "organisation_name"), "repo_id")


def with_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Every commit with each of its files; a commit without files keeps one row.

    An outer join could not split the partition of a commit with very many
    files; an inner join can, and the commits without files are added to it.
    """
    bare = commits.join(files.select("commit_id").distinct(), "commit_id", "left_anti")
    return commits.join(files, "commit_id").unionByName(bare, allowMissingColumns=True)


def with_parent(commits: DataFrame) -> DataFrame:
    """Every commit next to the stored commit it builds on, if that is known."""
    parents = commits.select(
        "repo_id",
        F.col("sha1").alias("parent"),
        F.col("commit_id").alias("parent_commit_id"),
        F.col("author_id").alias("parent_author_id"),
        F.col("commit_date").alias("parent_date"),
    )
    return commits.join(parents, ["repo_id", "parent"], "left")


def with_author(commits: DataFrame, users: DataFrame) -> DataFrame:
    authors = users.select(F.col("user_id").alias("author_id"), "name", "email", "excluded")
    return commits.join(authors, "author_id")


def line_totals(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Line sums and number of modified files per commit, 0 where it has no files."""
    totals = files.groupBy("commit_id").agg(
        F.sum("lines_added").alias("lines_added"),
        F.sum("lines_deleted").alias("lines_removed"),
        F.sum("lines_changed").alias("lines_changed"),
        F.count_if(_modified()).alias("files_changed"),
    )
    names = ("lines_added", "lines_removed", "lines_changed", "files_changed")
    return (
        commits.select("commit_id")
        .join(totals, "commit_id", "left")
        .select("commit_id", *(F.coalesce(name, F.lit(0)).alias(name) for name in names))
    )


def branches(sightings: DataFrame) -> DataFrame:
    """The set of branches of every commit, as a long table."""
    return sightings.select("repo_id", "sha1", "branch").distinct()


def branch_counts(sightings: DataFrame) -> DataFrame:
    """One row per commit: on how many branches it was seen, and the first and last of them by name."""
    return branches(sightings).groupBy("repo_id", "sha1").agg(
        F.count(F.lit(1)).alias("n_branches"),
        F.min("branch").alias("first_branch"),
        F.max("branch").alias("last_branch"),
    )


def repository_branches(sightings: DataFrame) -> DataFrame:
    return sightings.select("repo_id", "branch").distinct()


def first_sightings(sightings: DataFrame, order: str = "seq", keys: tuple[str, ...] = ("repo_id", "sha1")) -> DataFrame:
    """The first record of every key, by default (repository, sha).

    A record without a place in the order comes last, and equal places are told
    apart by the rest of the record, so the choice does not depend on the layout.
    The least record combines on the map side: a commit seen very often costs no
    more than one partial row per task.
    """
    rest = [name for name in sightings.columns if name not in (*keys, order)]
    record = F.struct(F.col(order).isNull().alias("_last"), order, *rest)
    return (
        sightings.groupBy(*keys)
        .agg(F.min(record).alias("first"))
        .select(*keys, "first.*")
        .select(*sightings.columns)
    )


def latest(commits: DataFrame) -> DataFrame:
    """The newest commit of every repository, the greatest sha among equal dates."""
    return (
        commits.groupBy("repo_id")
        .agg(
            F.max_by(
                F.struct("commit_id", "sha1", "commit_date"), F.struct("commit_date", "sha1")
            ).alias("latest")
        )
        .select("repo_id", "latest.*")
    )


def calendar(commits: DataFrame) -> DataFrame:
    """Commits by UTC day, newest day first.

    A sort on the whole key is range partitioned, so one busy repository or day
    is spread over many tasks.
    """
    return commits.select("repo_id", F.to_date("commit_date").alias("day"), "sha1", *DISPLAY).orderBy(
        F.desc("day"), "repo_id", F.desc("commit_date"), "sha1"
    )


def calendar_days(commits: DataFrame) -> DataFrame:
    """Totals of every repository and day."""
    return commits.groupBy("repo_id", F.to_date("commit_date").alias("day")).agg(
        F.count(F.lit(1)).alias("n_commits"),
        F.sum("lines_added").alias("lines_added"),
        F.sum("lines_removed").alias("lines_removed"),
        F.sum("lines_changed").alias("lines_changed"),
    )


def newest_first(commits: DataFrame) -> DataFrame:
    return commits.orderBy(F.desc("commit_date"), "repo_id", "sha1")


def user_commits(commits: DataFrame) -> DataFrame:
    """The commits of every user, newest first within the user."""
    return commits.select("repo_id", "author_id", "sha1", *DISPLAY).orderBy(
        "repo_id", "author_id", F.desc("commit_date"), "sha1"
    )
