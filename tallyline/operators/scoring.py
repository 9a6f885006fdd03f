"""From typed changes to scores, shares and counts.

Changes are always reduced to one narrow row per commit (and file, category)
before they meet the commits, so a commit or file with very many changes is
combined on the map side. Shares of a group come from a total that is
aggregated and joined back, never from a window over the group.

``group`` names the columns of ``commits`` that make one summary: the repository,
or a run and a repository. A boolean ``exclude_gui`` column on ``commits`` drops
GUI files per summary; without it, filter the changes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .commits import single_parent
from .spread import join_one

REPOSITORY = ("repo_id",)


def credited(changes: DataFrame) -> DataFrame:
    """Insertions and updates."""
    return changes.where(C.counts(F.col("change_op")))


def score_changes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("score", C.change_score(F.col("change_op"), F.col("entity_type")))


def categorise_changes(changes: DataFrame) -> DataFrame:
    return changes.withColumn("category", C.entity_category(F.col("entity_type")))


def analysable_changes(changes: DataFrame, exclude_gui: bool = True) -> DataFrame:
    """Changes to source files, without GUI files if so asked."""
    source = changes.where(C.is_source_file(F.col("filename")))
    return source.where(~C.is_gui_file(F.col("filename"))) if exclude_gui else source


def _per_commit(changes: DataFrame, *keys: str) -> DataFrame:
    """Totals per commit, and how much of them lies in GUI files."""
    counted, gui = C.counts(F.col("change_op")), C.is_gui_file(F.col("filename"))
    return (
        score_changes(changes)
        .groupBy("commit_id", *keys)
        .agg(
            F.sum("score").alias("score"),
            F.count_if(counted).alias("n_changes"),
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.when(gui, F.col("score")).otherwise(0)).alias("gui_score"),
            F.count_if(counted & gui).alias("gui_changes"),
            F.count_if(gui).alias("gui_rows"),
        )
    )


def owners(commits: DataFrame, group: Sequence[str]) -> DataFrame:
    """Which summary and user a commit belongs to, and whether GUI files count there."""
    flag = F.col("exclude_gui") if "exclude_gui" in commits.columns else F.lit(False)
    return commits.select("commit_id", *group, F.col("author_id").alias("user_id"), flag.alias("exclude_gui"))


def _left(total: str, gui: str) -> Column:
    """A total without its GUI part where that is excluded."""
    return F.col(total) - F.when(F.col("exclude_gui"), F.col(gui)).otherwise(0)


def _present(names: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(name).isNotNull() for name in names))


def of_commits(changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Changes of the given commits only, for a selection of them, such as a window, that leaves much out.

    Without a selection the aggregation per commit comes first: it combines on the
    map side, and only then do the commits drop what they do not cover.
    """
    return changes.join(commits.select("commit_id").distinct(), "commit_id", "left_semi")


def file_change_scores(changes: DataFrame) -> DataFrame:
    """Score and number of credited changes per commit and file; 0 where only deletions occur."""
    return _per_commit(changes, "filename").select("commit_id", "filename", "score", "n_changes")


def nonzero_files(file_scores: DataFrame) -> DataFrame:
    return file_scores.where("score != 0")


def commit_scores(commits: DataFrame, changes: DataFrame, group: Sequence[str] = REPOSITORY) -> DataFrame:
    """Score of every commit, 0 for one without changes."""
    return (
        owners(commits, group)
        .join(_per_commit(changes), "commit_id", "left")
        .select(
            "commit_id",
            *group,
            "user_id",
            F.coalesce(_left("score", "gui_score"), F.lit(0)).alias("score"),
            F.coalesce(_left("n_changes", "gui_changes"), F.lit(0)).alias("n_changes"),
        )
    )


def user_scores(commits: DataFrame, changes: DataFrame, group: Sequence[str] = REPOSITORY) -> DataFrame:
    """Score per summary and author; authors whose commits score nothing stay with 0."""
    return (
        commit_scores(commits, changes, group)
        .where(_present([*group, "user_id"]))
        .groupBy(*group, "user_id")
        .agg(F.sum("score").alias("score"))
    )


def shown_users(commits: DataFrame, users: DataFrame, group: Sequence[str] = REPOSITORY) -> DataFrame:
    """The authors of a summary that are not excluded."""
    included = users.where(~F.col("excluded")).select("user_id")
    authors = commits.select(*group, F.col("author_id").alias("user_id")).distinct()
    return authors.join(included, "user_id").select(*group, "user_id")


def score_percent(scores: DataFrame, users: DataFrame, group: Sequence[str] = REPOSITORY) -> DataFrame:
    """Adds each user's percentage of the summary, over users that are not excluded.

    Scores and totals read the same columns, so Spark computes the scores once.
    """
    included = users.where(~F.col("excluded")).select("user_id")
    kept = scores.join(included, "user_id")
    totals = kept.groupBy(*group).agg(F.sum("score").alias("total"))
    return (
        join_one(kept, totals, group, ["user_id"])
        .withColumn("percent", C.share(F.col("score") * 100, F.col("total")))
        .drop("total")
    )


def _authored(
    changes: DataFrame, commits: DataFrame, keys: Sequence[str], group: Sequence[str]
) -> DataFrame:
    """Totals per summary, author and keys.

    Missing authors and keys are dropped here and not by the joins that follow,
    so that the branches of a plan stay equal and Spark runs this part once.
    """
    return (
        _per_commit(changes, *keys)
        .join(owners(commits, group), "commit_id")
        .where(_present([*group, "user_id", *keys]) & (_left("n_rows", "gui_rows") > 0))
        .groupBy(*group, "user_id", *keys)
        .agg(
            F.sum(_left("score", "gui_score")).alias("score"),
            F.sum(_left("n_changes", "gui_changes")).alias("n_changes"),
        )
    )


def user_category_counts(
    commits: DataFrame, changes: DataFrame, group: Sequence[str] = REPOSITORY
) -> DataFrame:
    return _authored(credited(categorise_changes(changes)), commits, ("category", "change_op"), group)


def user_file_category_counts(
    commits: DataFrame, changes: DataFrame, group: Sequence[str] = REPOSITORY
) -> DataFrame:
    keys = ("filename", "category", "change_op")
    return _authored(credited(categorise_changes(changes)), commits, keys, group)


def summary_levels(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """The three levels of a summary from one pass.

    Level 1 is per user, level 2 per user and category, level 3 per user, file
    and category. Rows are expanded three times only after the reduction by
    (user, file, category).
    """
    finest = _authored(credited(categorise_changes(changes)), commits, ("filename", "category"), REPOSITORY)
    repo, user, file, category = (F.col(name) for name in ("repo_id", "user_id", "filename", "category"))
    levels = [(repo, user), (repo, user, category), (repo, user, file, category)]
    return (
        finest.groupingSets(levels, repo, user, file, category)
        .agg(
            F.grouping_id().alias("_gid"),
            F.sum("score").alias("score"),
            F.sum("n_changes").alias("n_changes"),
        )
        .withColumn("level", F.when(F.col("_gid") == 3, 1).when(F.col("_gid") == 2, 2).otherwise(3))
        .select("level", "repo_id", "user_id", "filename", "category", "score", "n_changes")
    )


def file_scores(commits: DataFrame, changes: DataFrame, group: Sequence[str] = REPOSITORY) -> DataFrame:
    """Score per summary, base file name and author, excluded authors too."""
    named = changes.withColumn("file", C.base_name(F.col("filename")))
    return _authored(named, commits, ("file",), group)


def file_user_shares(
    commits: DataFrame, changes: DataFrame, group: Sequence[str] = REPOSITORY
) -> DataFrame:
    return file_shares(file_scores(commits, changes, group).drop("n_changes"), group)


def file_shares(scores: DataFrame, group: Sequence[str] = REPOSITORY) -> DataFrame:
    """Each author's fraction of a file's score; NULL where the file scores 0."""
    totals = scores.groupBy(*group, "file").agg(F.sum("score").alias("total"))
    return (
        join_one(scores, totals, [*group, "file"], ["user_id"])
        .withColumn("share", C.share(F.col("score"), F.col("total")))
        .drop("total")
    )


def file_user_matrix(scores: DataFrame, shown: DataFrame) -> DataFrame:
    """The file by user chart of every repository in sparse form, from ``file_scores``.

    Cells that are not 0, for the users that are shown; every other cell is 0.
    A shown user without any cell and a file without a shown user still appear
    once, with the other coordinate NULL, so both axes are complete.

    Scores and shown users become one relation; both axes come out of one
    aggregation of it by GROUPING SETS, and cells out of its join with the axis of
    the files.
    """
    keys = ["repo_id", "user_id"]
    repo, file, user = (F.col(name) for name in ("repo_id", "file", "user_id"))
    people = shown.select(*keys, F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("score"), F.lit(True).alias("is_shown"))
    known = shown.select(*keys, F.lit(True).alias("is_shown"))
    # a user that is not shown counts in a file's total only
    entries = scores.select(*keys, "file", "score").join(known, keys, "left").unionByName(people)
    is_cell = F.coalesce(F.col("is_shown"), F.lit(False)) & F.col("file").isNotNull() & (F.col("score") != 0)
    entries = entries.select(*keys, "file", "score", F.coalesce("is_shown", F.lit(False)).alias("is_shown"), is_cell.alias("is_cell"))
    axes = (
        entries.groupingSets([(repo, file), (repo, user)], repo, file, user)
        .agg(
            F.grouping("file").alias("of_users"),
            F.sum("score").alias("total"),
            F.bool_or("is_cell").alias("any_cell"),
            F.bool_or("is_shown").alias("any_shown"),
        )
    )
    totals = axes.where((F.col("of_users") == 0) & F.col("any_cell")).select("repo_id", "file", "total")
    cells = join_one(entries.where("is_cell").select(*keys, "file", "score"), totals, ["repo_id", "file"], ["user_id"]).select(
        "repo_id", "file", "user_id", C.share(F.col("score"), F.col("total")).alias("share")
    )
    bare = axes.where(~F.col("any_cell") & F.when(F.col("of_users") == 1, F.col("any_shown")).otherwise(F.col("file").isNotNull()))
    return cells.unionByName(bare.select("repo_id", "file", "user_id", F.lit(0.0).alias("share")))


def pivot_users(matrix: DataFrame, user_ids: list[int]) -> DataFrame:
    """The dense chart: a row per file, a column per listed user, 0 where absent."""
    cells = [
        F.coalesce(F.sum(F.when(F.col("user_id") == user, F.col("share"))), F.lit(0.0)).alias(f"user_{user}")
        for user in user_ids
    ]
    return matrix.where(F.col("file").isNotNull()).groupBy("repo_id", "file").agg(*cells)


def users_with_commits(percents: DataFrame, commits: DataFrame) -> DataFrame:
    """Every shown user with each of their commits, newest first; the scores repeat.

    ``commits`` are those the scores come from, so every user has at least one
    and an inner join, whose busy keys can be split, loses nobody.
    """
    names = ("sha1", "commit_date", "commit_message", "url")
    own = commits.select("repo_id", F.col("author_id").alias("user_id"), *names)
    return (
        own.join(percents.select("repo_id", "user_id", "score", "percent"), ["repo_id", "user_id"])
        .select("repo_id", "user_id", "score", "percent", *names)
        .orderBy("repo_id", "user_id", F.desc("commit_date"), "sha1")
    )


def contribution_percent(
    commits: DataFrame, changes: DataFrame, users: DataFrame, exclude_gui: bool = True
) -> DataFrame:
    """The headline result: score and percentage of every user of every repository."""
    scores = user_scores(single_parent(commits), analysable_changes(changes, exclude_gui))
    return score_percent(scores, users)
