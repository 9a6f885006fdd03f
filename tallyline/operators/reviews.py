"""Pull requests and their comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _by(rows: DataFrame, users: DataFrame, column: str) -> DataFrame:
    return rows.join(users.select(F.col("user_id").alias(column)), column, "left_semi")


def opened_by(pull_requests: DataFrame, users: DataFrame) -> DataFrame:
    return _by(pull_requests, users, "opened_by")


def merged_by(pull_requests: DataFrame, users: DataFrame) -> DataFrame:
    return _by(pull_requests, users, "merged_by")


def comments_by(comments: DataFrame, users: DataFrame) -> DataFrame:
    return _by(comments, users, "commenter_id")


def display(pull_requests: DataFrame, repositories: DataFrame) -> DataFrame:
    names = repositories.select("repo_id", "repository_name")
    return pull_requests.join(names, "repo_id").select(
        "repository_name", "number", "title", "body", "url"
    )


def unseen(pull_requests: DataFrame, known: DataFrame) -> DataFrame:
    """Pull requests not stored yet, by repository and number."""
    return pull_requests.join(known.select("repo_id", "number"), ["repo_id", "number"], "left_anti")
