"""Summaries of many repositories in one job, keyed by run and repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import commits as commit_ops
from ..operators import scoring
from ..sources import pages

GROUP = ("run_id", "repo_id")
NOT_FOUND = "Repository not found"


def problem() -> Column:
    """Why a matcher cannot run, or NULL. A window is meant as soon as both of its ends have a text."""

    def bad(date: str) -> Column:
        return F.col(date).isNotNull() & _instant(date).isNull()

    return (
        F.when(F.col("exact_match").isNull(), "exactMatch is missing")
        .when(F.col("name").isNull(), "name is missing")
        .when(bad("start_date"), F.concat(F.lit("startDate is no instant: "), F.col("start_date")))
        .when(bad("end_date"), F.concat(F.lit("endDate is no instant: "), F.col("end_date")))
    )


def runnable(matchers: DataFrame) -> DataFrame:
    return matchers.where(problem().isNull())


def match_repositories(matchers: DataFrame, repositories: DataFrame) -> DataFrame:
    """Every matcher with each repository it selects; a repository may match several.

    Exact names are an equi-join. A prefix is too: each name is listed with its
    prefixes of the lengths that occur, so no matcher is compared with every
    repository. There are no more lengths than a name has characters.
    """
    matchers = runnable(matchers)
    exact = matchers.where("exact_match").join(
        repositories.select("repo_id", "repository_name", "organisation_name"),
        (F.col("name") == F.col("repository_name")) & (F.col("organisation") == F.col("organisation_name")),
    )
    by_prefix = matchers.where(~F.col("exact_match"))
    lengths = by_prefix.select(F.length("name").alias("n")).distinct().agg(F.collect_list("n")).scalar()
    prefixes = (
        repositories.select("repo_id", "repository_name", "organisation_name", lengths.alias("lengths"))
        .withColumn("n", F.explode("lengths"))
        .where(F.col("n") <= F.length("repository_name"))
        .withColumn("prefix", F.substring("repository_name", F.lit(1), F.col("n")))
        .drop("lengths", "n")
    )
    prefix = by_prefix.join(
        prefixes, (F.col("name") == F.col("prefix")) & (F.col("organisation") == F.col("organisation_name"))
    ).drop("prefix")
    names = [name for name in matchers.columns if name != "organisation"]
    return exact.unionByName(prefix).select("repo_id", "repository_name", "organisation_name", *names)


def unmatched_exact(matchers: DataFrame, repositories: DataFrame) -> DataFrame:
    """Exact names that no repository has; these runs fail."""
    known = repositories.select(
        F.col("repository_name").alias("name"), F.col("organisation_name").alias("organisation")
    )
    return runnable(matchers).where("exact_match").join(known, ["name", "organisation"], "left_anti")


def _instant(text: str) -> Column:
    return C.utc_instant(F.col(text))


def run_commits(matched: DataFrame, commits: DataFrame) -> DataFrame:
    """The commits each run analyses in each of its repositories, with the run's GUI option."""
    runs = matched.select(
        *GROUP, "exclude_gui", _instant("start_date").alias("_start"), _instant("end_date").alias("_end")
    )
    open_window = F.col("_start").isNull() | F.col("_end").isNull()
    return (
        commit_ops.single_parent(commits)
        .join(runs, "repo_id")
        .where(open_window | F.col("commit_date").between(F.col("_start"), F.col("_end")))
        .drop("_start", "_end")
    )


def user_percent(matched: DataFrame, commits: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """Score and percentage of every user in every run and repository."""
    source = scoring.analysable_changes(changes, exclude_gui=False)
    covered = run_commits(matched, commits)
    scores = scoring.user_scores(covered, scoring.of_commits(source, covered), GROUP)
    return scoring.score_percent(scores, users, GROUP)


def file_shares(matched: DataFrame, commits: DataFrame, changes: DataFrame) -> DataFrame:
    source = scoring.analysable_changes(changes, exclude_gui=False)
    covered = run_commits(matched, commits)
    return scoring.file_user_shares(covered, scoring.of_commits(source, covered), GROUP)


def documents(
    matched: DataFrame, commits: DataFrame, changes: DataFrame, users: DataFrame
) -> DataFrame:
    """The JSON document of every run and repository, as sortable lines."""
    covered = run_commits(matched, commits)
    source = scoring.of_commits(scoring.analysable_changes(changes, exclude_gui=False), covered)
    named = matched.select(*GROUP, "repository_name", "start_date", "end_date")
    return pages.summary_lines(named, covered, source, users, GROUP)


def report(matchers: DataFrame, repositories: DataFrame) -> DataFrame:
    """One row per run and repository: whether its summary was made, and why not."""
    done = match_repositories(matchers, repositories).select(
        "run_id",
        "repository_name",
        F.lit("succeeded").alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )
    failed = unmatched_exact(matchers, repositories).select(
        "run_id",
        F.col("name").alias("repository_name"),
        F.lit("failed").alias("status"),
        F.lit(NOT_FOUND).alias("reason"),
    )
    reason = problem()
    refused = matchers.where(reason.isNotNull()).select(
        "run_id", F.col("name").alias("repository_name"), F.lit("failed").alias("status"), reason.alias("reason")
    )
    return done.unionByName(failed).unionByName(refused)


def report_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_distinct("repository_name").alias("n_repositories")
    )
