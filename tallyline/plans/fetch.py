"""Taking a fetched feed into the stored tables.

Every step returns the rows to add or the new table; writing them is up to the
caller, one snapshot per fetch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import commits as commit_ops
from ..operators import members
from ..operators import reviews
from ..operators.spread import join_one
from ..session import stored
from ..sources import feeds
from ..sources.store import Store


def high_water_marks(commits: DataFrame) -> DataFrame:
    """The newest date of every repository: one row each, columns ``repo_id``, ``mark``."""
    return commits.groupBy("repo_id").agg(F.max("commit_date").alias("mark"))


def merged_marks(marks: DataFrame, added: DataFrame) -> DataFrame:
    """The marks after a fetch added commits; the stored commits need not be read for them."""
    both = marks.select("repo_id", "mark").unionByName(high_water_marks(added))
    return both.groupBy("repo_id").agg(F.max("mark").alias("mark"))


def since_marks(feed: DataFrame, marks: DataFrame) -> DataFrame:
    """Commits of the feed that are not older than the mark of their repository.

    A repository without a mark takes everything, and a commit without a date is
    always taken. The mark itself is included, so the result overlaps with what is
    stored.
    """
    marks = marks.select("repo_id", F.col("mark").alias("_mark"))
    return (
        join_one(feed, marks, ["repo_id"], ["sha1"], "left")
        .where(F.col("_mark").isNull() | F.col("commit_date").isNull() | (F.col("commit_date") >= F.col("_mark")))
        .drop("_mark")
    )


def since_high_water_mark(feed: DataFrame, known: DataFrame, all_history: bool = False) -> DataFrame:
    """The same for a table of stored commits whose marks are not kept."""
    return feed if all_history else since_marks(feed, high_water_marks(known))


def new_commits(
    feed: DataFrame, known: DataFrame, all_history: bool = False, marks: DataFrame | None = None
) -> DataFrame:
    """The commits a fetch adds: recent ones, once each, that are not stored.

    With ``marks``, the ``known`` commits are read for the keys of its commits only.
    """
    if marks is None or all_history:
        recent = since_high_water_mark(feed, known, all_history)
    else:
        recent = since_marks(feed, marks)
    return feeds.find_new_commits(commit_ops.first_sightings(recent), known)


def fetch_into(store: Store, marks: Store, feed: DataFrame, all_history: bool = False) -> DataFrame:
    """One fetch into the stored tables: unseen commits are appended, and the marks of their repositories moved on.

    Of the stored commits only the buckets of the feed's repositories are read, of
    the marks only those of the same repositories. The commits go first: if the
    fetch fails before the marks are written, the next one takes a little more of
    the feed and finds it stored. Returns the commits that were added.
    """
    stored_keys = store.read(store.touched(feed)).select("repo_id", "sha1")
    known = marks.read(marks.touched(feed))
    added = stored(new_commits(feed, stored_keys, all_history, known).drop("seq"))
    store.append(added)
    moved = merged_marks(known.join(added, "repo_id", "left_semi"), added)
    marks.upsert(moved, ["repo_id"])
    return added


def fetch(
    raw_commits: DataFrame,
    raw_pull_requests: DataFrame,
    repositories: DataFrame,
    commits: DataFrame,
    pull_requests: DataFrame,
    users: DataFrame,
    teams: DataFrame,
    domain: str,
    weak: bool = False,
    raw_repositories: DataFrame | None = None,
    prefix: str = "",
    now: str | None = None,
    marks: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Everything one fetch adds to the stored tables, and its report.

    Ids are hashes of what tells rows apart (repository and sha, file name, pull
    request number), so no counter is needed and a fetch that runs again gives the
    same ids. Commits that may not be stored are ``refused``, with the reason, and
    so are their files. With ``raw_repositories``, ``new_repositories`` are those
    not stored yet and ``repositories`` the stored ones with the time of the fetch.
    With ``marks``, the stored commits are not read for them, and ``marks`` of the
    result are those after the fetch.

    The users it adds are written to the shared folder once: people are resolved in
    five places, and each would hold the plan of both feeds' people again.
    """
    added_users = stored(feeds.ingest_users(raw_commits, raw_pull_requests, users, domain, weak))
    everyone = users.unionByName(added_users)
    fresh = feeds.commit_rows(raw_commits)
    added = new_commits(fresh, commits, marks=marks).drop("seq")
    for role in ("author", "committer"):
        added = feeds.with_user_id(added, everyone, role, domain, weak)
    checked = commit_ops.validate(added.withColumn("commit_id", commit_id()))
    added = checked.where(F.col("problem").isNull()).drop("problem")
    files = feeds.ingest_commit_files(raw_commits).withColumn("commit_id", commit_id())
    files = files.withColumn("file_id", F.xxhash64("commit_id", "filename"))
    requests = reviews.unseen(feeds.ingest_pull_requests(raw_pull_requests), pull_requests)
    for role in ("opened_by", "merged_by"):
        requests = feeds.with_user_id(requests, everyone, role, domain, weak).withColumnRenamed(f"{role}_id", role)
    comments = feeds.with_user_id(
        feeds.ingest_pr_comments(raw_pull_requests), everyone, "commenter", domain, weak
    ).join(requests.select("repo_id", "number"), ["repo_id", "number"], "left_semi")
    everything = commits.select("repo_id", "author_id").unionByName(added.select("repo_id", "author_id"))
    out = {
        "users": added_users,
        "commits": added,
        "refused": checked.where(F.col("problem").isNotNull()).select("repo_id", "sha1", "problem"),
        "commit_files": files.join(added.select("commit_id"), "commit_id", "left_semi"),
        "commit_branches": commit_ops.branches(feeds.branch_sightings(raw_commits)),
        "pull_requests": requests.withColumn("pr_id", F.xxhash64("repo_id", "number")),
        "pr_comments": comments.withColumn("pr_id", F.xxhash64("repo_id", "number")),
        "report": members.fetch_report(repositories, everything, teams, everyone),
    }
    if marks is not None:
        out["marks"] = merged_marks(marks, added)
    if raw_repositories is not None:
        out["new_repositories"] = feeds.new_repositories(raw_repositories, repositories, prefix)
        if now is not None:
            out["repositories"] = feeds.stamp_fetched(repositories, raw_repositories, prefix, now)
    return out


def commit_id() -> Column:
    """The id of a fetched commit; raw feeds have none."""
    return F.xxhash64("repo_id", "sha1")
