"""Who works on a repository, and who does so without being on its team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import join_one

NO_TEAM = "no team is known"


def repository_members(
    commits: DataFrame, pull_requests: DataFrame, comments: DataFrame, users: DataFrame
) -> DataFrame:
    """Authors, pull request openers and commenters that are not excluded.

    Every part is made distinct before it is joined or united, so a very active
    user or pull request is one row from there on.
    """
    authors = commits.select("repo_id", F.col("author_id").alias("user_id")).distinct()
    openers = pull_requests.select("repo_id", F.col("opened_by").alias("user_id")).distinct()
    commenters = (
        comments.select("pr_id", F.col("commenter_id").alias("user_id"))
        .distinct()
        .join(pull_requests.select("pr_id", "repo_id"), "pr_id")
        .select("repo_id", "user_id")
    )
    people = authors.unionByName(openers).unionByName(commenters).distinct()
    included = users.where(~F.col("excluded")).select("user_id", "name", "email")
    return people.join(included, "user_id").select("repo_id", "user_id", "name", "email")


def users_outside_team(commits: DataFrame, teams: DataFrame, users: DataFrame) -> DataFrame:
    """Authors that are not excluded and not on the team of a repository that has one."""
    with_team = teams.select("repo_id").distinct()  # one row per repository
    authors = commits.select("repo_id", F.col("author_id").alias("user_id")).distinct()
    included = users.where(~F.col("excluded")).select("user_id")
    outside = authors.join(teams.select("repo_id", "user_id"), ["repo_id", "user_id"], "left_anti")
    return (
        join_one(outside, with_team, ["repo_id"], ["user_id"])
        .join(included, "user_id", "left_semi")
        .select("repo_id", "user_id")
    )


def repositories_without_team(repositories: DataFrame, teams: DataFrame) -> DataFrame:
    """Repositories whose members cannot be checked, with the reason."""
    reason = F.concat(
        F.lit("Members of "),
        "repository_name",
        F.lit(" were not checked: " + NO_TEAM),
    )
    return repositories.join(teams.select("repo_id").distinct(), "repo_id", "left_anti").select(
        "repo_id", "repository_name", reason.alias("reason")
    )


def repositories_with_duplicate_users(
    repositories: DataFrame, commits: DataFrame, teams: DataFrame, users: DataFrame
) -> DataFrame:
    outside = users_outside_team(commits, teams, users).select("repo_id").distinct()
    return repositories.join(outside, "repo_id", "left_semi").select("repo_id", "repository_name")


def fetch_report(
    fetched: DataFrame, commits: DataFrame, teams: DataFrame, users: DataFrame
) -> DataFrame:
    """What a fetch did, in one long table.

    One ``fetched`` row with the number of repositories, then a row per
    repository with duplicate users and per repository that has no team.
    """
    total = fetched.agg(
        F.lit("fetched").alias("kind"),
        F.lit(None).cast("string").alias("repository_name"),
        F.count(F.lit(1)).cast("string").alias("detail"),
    )
    duplicate = repositories_with_duplicate_users(fetched, commits, teams, users).select(
        F.lit("duplicate users").alias("kind"), "repository_name", F.lit(None).cast("string").alias("detail")
    )
    unchecked = repositories_without_team(fetched, teams).select(
        F.lit("unable to check").alias("kind"), "repository_name", F.col("reason").alias("detail")
    )
    return total.unionByName(duplicate).unionByName(unchecked)
