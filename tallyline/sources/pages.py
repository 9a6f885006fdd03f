"""Summaries as JSON documents and as report pages.

A document can be as large as the history of its repository, so it is never put
together in one value. It is a set of text lines with a sort key; written in
order, the lines of one repository are its document.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import scoring
from ..operators.commits import DISPLAY
from ..operators.spread import join_one
from ..session import stored

SORT = ("section", "a", "part", "b", "item", "c")
LATEST = 10**17  # microseconds, after every date a timestamp can hold in practice


def _quoted(text: Column) -> Column:
    packed = F.to_json(F.array(text))
    return F.substring(packed, F.lit(2), F.length(packed) - 2)


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _line(text: Column, section: int, **keys: Column | str | int) -> Column:
    """A document line as a struct; keys that are not given are empty."""

    def key(name: str) -> Column:
        value = keys.get(name)
        if name in ("part", "item"):
            return F.lit(value or 0).alias(name)
        return (F.lit("") if value is None else value).alias(name)

    return F.struct(F.lit(section).alias("section"), *(key(name) for name in SORT[1:]), text.alias("text"))


def _lines(rows: DataFrame, group: Sequence[str], *lines: Column) -> DataFrame:
    """Document lines of every row; rows that give several are read once."""
    if len(lines) == 1:
        return rows.select(*group, lines[0].alias("_line")).select(*group, "_line.*")
    return rows.select(*group, F.explode(F.array(*lines)).alias("_line")).select(*group, "_line.*")


def _after(text: Column, first: Column) -> Column:
    """An element of a list, with a comma before it unless it is the first."""
    return F.concat(F.when(first, F.lit("")).otherwise(F.lit(",")), text)


def _binned(rows: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """Score, and counts per category and kind of change as one JSON object; zero counts are left out.

    ``more`` are further totals of the same groups.
    """
    bins = []
    for category in sorted({*C.CATEGORIES.values(), C.OTHER_CATEGORY}):
        for op, word in (("INSERT", "additions"), ("UPDATE", "updates")):
            here = (F.col("category") == category) & (F.col("change_op") == op)
            bins.append(F.sum(F.when(here, F.col("n_changes"))).alias(f"{category} {word}"))
    totals = rows.groupBy(*keys).agg(F.sum("score").alias("sum_score"), *more, *bins)
    names = totals.columns[len(keys) + 1 + len(more) :]
    kept = totals.columns[: len(keys) + 1 + len(more)]
    return totals.select(*kept, F.to_json(F.struct(*names)).alias("binned"))


def unique_labels(people: DataFrame, users: DataFrame, group: Sequence[str]) -> DataFrame:
    """Adds ``excluded`` and the label of every user of a document, with the id where two users share it."""
    label = C.user_label(F.col("name"), F.col("email")).alias("label")
    named = people.join(users.select("user_id", label, "excluded"), "user_id")
    shared = named.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("_n"))
    with_id = F.concat("label", F.lit(" #"), F.col("user_id").cast("string"))
    return (
        join_one(named, shared, [*group, "label"], ["user_id"])
        .withColumn("label", F.when(F.col("_n") > 1, with_id).otherwise(F.col("label")))
        .drop("_n")
    )


def _detail(commits: DataFrame, changes: DataFrame, group: Sequence[str]) -> DataFrame:
    """Equal changes of one commit and file as one row, with the summaries they belong to.

    ``is_first`` marks the first change listed for its file and commit: a window over
    one file's changes in one commit, which lie together after the join of the owners.
    """
    what = F.concat_ws(" ", "change_op", "entity_type", "unique_name")
    typed = scoring.categorise_changes(scoring.score_changes(changes)).withColumn("what", what)
    reduced = typed.groupBy("commit_id", "filename", "category", "change_op", "what").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("n_changes")
    )
    hidden = F.col("exclude_gui") & C.is_gui_file(F.col("filename"))
    owned = reduced.join(scoring.owners(commits, group), "commit_id").where(~hidden).drop("exclude_gui")
    counts = C.counts(F.col("change_op"))
    listed = Window.partitionBy(*group, "user_id", "commit_id", "filename").orderBy(F.desc(counts), "what")
    return owned.withColumn("is_first", F.rank().over(listed) == 1)


def _seconds(name: str) -> Column:
    """The end of a window; NULL unless both ends are given."""
    both = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    return _number(F.when(both, C.epoch_seconds(C.utc_instant(F.col(name)))))


def summary_lines(
    summaries: DataFrame,
    commits: DataFrame,
    changes: DataFrame,
    users: DataFrame,
    group: Sequence[str] = scoring.REPOSITORY,
) -> DataFrame:
    """The JSON document of every summary as sortable lines.

    ``summaries`` has the group columns, repository_name, start_date and
    end_date; ``commits`` are those the summary covers and may carry
    ``exclude_gui``; ``changes`` are those in source files. What all parts of the
    documents share, changes by commit and file and the labels of users, is written
    to the shared folder once: branches that need other columns of it would run it
    again each. The first element of every list, which has no comma before it, comes
    out of the aggregation that the list's owner needs anyway, and reaches the
    elements with the owner's label, before there is any text.
    """
    group = list(group)
    user = [*group, "user_id"]
    label, file = F.col("label"), F.col("file")
    micros = F.timestamp_diff("MICROSECOND", C.epoch(), F.col("commit_date"))
    # a commit without a date comes last
    newest = F.concat(F.coalesce(F.lpad((F.lit(LATEST) - micros).cast("string"), 18, "0"), F.lit("9" * 18)), F.col("sha1"))
    place = F.concat_ws("/", F.lpad(F.col("commit_id").cast("string"), 20, "0"), "filename")

    # Users of a document, each with its label, its totals and what comes first in its lists.
    detail = stored(_detail(commits, changes, group))
    everyone = commits.groupBy(*group, F.col("author_id").alias("user_id")).agg(F.min(newest).alias("first_commit"))
    labels = stored(unique_labels(everyone, users, group))
    kinds = _binned(detail, user, F.min(place).alias("first_place"))
    scores = labels.where(~F.col("excluded")).join(kinds, user, "left")
    scores = scores.withColumn("score", F.coalesce("sum_score", F.lit(0)))
    totals = scores.groupBy(*group).agg(F.sum("score").alias("total"), F.min("label").alias("first_label"))
    shown = join_one(scores, totals, group, ["user_id"]).withColumn("percent", C.share(F.col("score") * 100, F.col("total")))

    head = F.concat(
        F.lit('{"repo":'),
        _quoted(F.col("repository_name")),
        F.lit(',"startDate":'),
        _seconds("start_date"),
        F.lit(',"endDate":'),
        _seconds("end_date"),
        F.lit(',"changesPerUser":{'),
    )
    user_head = F.concat(
        _quoted(label),
        F.lit(':{"contributionsScore":'),
        _number(F.col("score")),
        F.lit(',"contributionsScorePercent":'),
        _number(F.col("percent")),
        F.lit(',"binnedChangesCounts":'),
        F.coalesce("binned", F.lit("{}")),
        F.lit(',"commits":['),
    )
    lines = [
        _lines(summaries, group, _line(head, 0), _line(F.lit('},"changesPerFile":{'), 2), _line(F.lit("}}"), 4)),
        _lines(
            shown,
            group,
            _line(_after(user_head, label == F.col("first_label")), 1, a=label),
            _line(F.lit('],"changes":['), 1, a=label, part=2),
            _line(F.lit("]}"), 1, a=label, part=4),
        ),
    ]

    # Commits of a user, newest first.
    named = labels.where(~F.col("excluded")).select(*user, "label", "first_commit")
    own = commits.withColumnRenamed("author_id", "user_id").join(named, user)
    date = C.epoch_seconds(F.col("commit_date")).alias("date")
    commit = F.to_json(F.struct(date, *DISPLAY[1:]), {"ignoreNullFields": "false"})
    commit = _after(commit, newest == F.col("first_commit"))
    lines.append(_lines(own, group, _line(commit, 1, a=label, part=1, b=newest)))

    # Changed files of a user, each with its changes.
    placed = scores.select(*user, "label", "first_place")
    mine = detail.join(placed, user)
    files = _binned(mine, [*user, "label", "first_place", "commit_id", "filename"])
    file_head = F.concat(
        F.lit('{"fileName":'),
        _quoted(F.col("filename")),
        F.lit(',"score":'),
        _number(F.col("sum_score")),
        F.lit(',"binnedChangesCounts":'),
        F.col("binned"),
        F.lit(',"allChanges":['),
    )
    change = F.concat(
        F.lit('{"change":'), _quoted(F.col("what")), F.lit(',"count":'), _number(F.col("n_changes")), F.lit("}")
    )
    change = _after(change, F.col("is_first"))
    lines += [
        _lines(
            files,
            group,
            _line(_after(file_head, place == F.col("first_place")), 1, a=label, part=3, b=place),
            _line(F.lit("]}"), 1, a=label, part=3, b=place, item=2),
        ),
        _lines(scoring.credited(mine), group, _line(change, 1, a=label, part=3, b=place, item=1, c=F.col("what"))),
    ]

    # Files by name, each with the share of every user.
    per_user = detail.groupBy(*group, C.base_name(F.col("filename")).alias("file"), "user_id").agg(
        F.sum("score").alias("score")
    )
    per_user = per_user.join(labels.select(*user, "label"), user, "left")
    per_name = per_user.groupBy(*group, "file").agg(F.sum("score").alias("total"), F.min("label").alias("first_label"))
    shares = join_one(per_user.where(label.isNotNull()), per_name, [*group, "file"], ["user_id"])
    firsts = per_name.groupBy(*group).agg(F.min("file").alias("first_file"))
    names = join_one(per_name.select(*group, "file"), firsts, group, ["file"])
    share = F.concat(_quoted(label), F.lit(":"), _number(C.share(F.col("score"), F.col("total"))))
    lines += [
        _lines(
            names,
            group,
            _line(_after(F.concat(_quoted(file), F.lit(":{")), file == F.col("first_file")), 3, a=file),
            _line(F.lit("}"), 3, a=file, part=2),
        ),
        _lines(shares, group, _line(_after(share, label == F.col("first_label")), 3, a=file, part=1, b=label)),
    ]
    return reduce(DataFrame.unionByName, lines)


def page_lines(documents: DataFrame, template: str, placeholder: str, group: Sequence[str]) -> DataFrame:
    """Report pages: the template with the document in place of every placeholder."""
    pieces = template.split(placeholder)
    owners = documents.where("section = 0").select(*group)
    places = F.array(*(F.lit(2 * n + 1) for n in range(len(pieces) - 1)))
    inside = documents.select((F.lit(1) if len(pieces) == 2 else F.explode(places)).alias("place"), "*")
    fixed = F.array(
        *(F.struct(F.lit(2 * n).alias("place"), F.lit(piece).alias("text")) for n, piece in enumerate(pieces))
    )
    keys = [(F.lit(0) if name in ("section", "part", "item") else F.lit("")).alias(name) for name in SORT]
    around = owners.select(*group, F.explode(fixed).alias("f")).select("f.place", *group, *keys, "f.text")
    return inside.unionByName(around)


def read_template(spark: SparkSession, path: str) -> str:
    """The text of a template file, wherever Spark can read it."""
    return spark.read.text(path, wholetext=True).first().value


def write_documents(lines: DataFrame, path: str, group: Sequence[str], order: Sequence[str] = SORT) -> None:
    """One folder per document, named after all of its group; its part files, read in name order, are the text.

    The sort is range partitioned on the whole key, so a large document is
    written by many tasks.
    """
    (
        lines.orderBy(*group, *order)
        .select(F.concat_ws("-", *group).alias("document"), "text")
        .write.mode("overwrite")
        .partitionBy("document")
        .text(path)
    )
