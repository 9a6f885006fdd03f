"""The contribution summary of every repository, from tables or from file texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import changes as change_ops
from ..operators import commits as commit_ops
from ..operators import scoring
from ..sources import pages


def covered_commits(commits: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return commit_ops.in_window(commit_ops.single_parent(commits), start, end)


def changes_from_texts(
    commits: DataFrame, files: DataFrame, revisions: DataFrame, exclude_gui: bool = True
) -> DataFrame:
    """Typed changes of all covered commits, extracted from file revisions.

    Files are filtered before the texts are joined, and texts are joined before
    the Python step, so only texts that are compared are ever read by it.
    """
    wanted = scoring.analysable_changes(files.select("commit_id", "filename"), exclude_gui)
    named = commits.select("commit_id", "repo_id", "sha1", "parent").join(wanted, "commit_id")
    pairs = change_ops.pair_file_revisions(named, revisions, carry=["commit_id"])
    keys = ["commit_id", "filename"]
    return change_ops.extract_changes(change_ops.dealt(change_ops.marked(pairs, keys)), keys, "whole")


def summary(
    repositories: DataFrame,
    commits: DataFrame,
    changes: DataFrame,
    users: DataFrame,
    start: str | None = None,
    end: str | None = None,
    exclude_gui: bool = True,
) -> dict[str, DataFrame]:
    """All result tables of a summary; each is a plan over all repositories at once."""
    covered = covered_commits(commits, start, end)
    source = scoring.analysable_changes(changes, exclude_gui)
    if start is not None and end is not None:
        source = scoring.of_commits(source, covered)
    percents = scoring.score_percent(scoring.user_scores(covered, source), users)
    per_file = scoring.file_scores(covered, source).drop("n_changes")
    return {
        "repositories": repositories.join(covered.select("repo_id").distinct(), "repo_id", "left_semi"),
        "users": percents,
        "categories": scoring.user_category_counts(covered, source),
        "files": scoring.user_file_category_counts(covered, source),
        "shares": scoring.file_shares(per_file),
        "matrix": scoring.file_user_matrix(per_file, scoring.shown_users(covered, users)),
        "commits": scoring.users_with_commits(percents, covered),
    }


def documents(
    repositories: DataFrame,
    commits: DataFrame,
    changes: DataFrame,
    users: DataFrame,
    start: str | None = None,
    end: str | None = None,
    exclude_gui: bool = True,
) -> DataFrame:
    """The JSON document of every repository that has covered commits, as sortable lines."""
    covered = covered_commits(commits, start, end)
    named = repositories.join(covered.select("repo_id").distinct(), "repo_id", "left_semi").select(
        "repo_id",
        "repository_name",
        F.lit(start).cast("string").alias("start_date"),
        F.lit(end).cast("string").alias("end_date"),
    )
    return pages.summary_lines(named, covered, scoring.analysable_changes(changes, exclude_gui), users)
