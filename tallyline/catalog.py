"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import changes, commits, members, reviews, rows, scoring, users
from .plans import batch, contributions, fetch
from .schemas import BATCH_CONFIG
from .session import shared_dir
from .sources import config, feeds, pages
from .sources.store import Store
from .streaming.commits import commit_store, stream_ingest_commits
from .views import DOMAIN, GIVEN, Tables

WINDOW = ("1996-01-01T00:00:00Z", "1998-12-31T00:00:00Z")
STORED_UNTIL = "1999-06-30T00:00:00Z"
TEMPLATE = "<html><body><script>var data = SUMMARY_JSON;</script></body></html>"

Query = Callable[[Tables], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(function: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: function(Tables(spark, sf_dir))

    return {name: bound(function) for name, function in _QUERIES.items()}


# Tables: scan, count, look up, change


@query
def scan_users(t: Tables) -> DataFrame:
    return t.users


@query
def count_rows(t: Tables) -> DataFrame:
    return rows.count_rows(t.commits)


@query
def lookup_user_by_id(t: Tables) -> DataFrame:
    return rows.lookup(t.users, t.pull_requests.select(F.col("opened_by").alias("user_id")), "user_id")


@query
def user_exists(t: Tables) -> DataFrame:
    """For every account a stored commit or a feed may name: is it a known user?"""
    named = t.commits.select((F.col("author_id") * 2).alias("user_id"))
    return rows.exists(t.users, named, "user_id")


@query
def query_by_example(t: Tables) -> DataFrame:
    example = {"is_merge_commit": False, "commit_message": "1-URGENT", "author_id": None}
    return rows.by_example(t.commits, example).select("commit_id", "repo_id", "sha1", "author_id")


def _user_store(t: Tables) -> Store:
    """The users as a stored table."""
    store = Store(t.spark, shared_dir(t.spark), t.users.schema, by=["user_id"], buckets=16)
    store.append(t.users)
    return store


@query
def upsert_rows(t: Tables) -> DataFrame:
    renamed = t.users.where("excluded").select("user_id", F.upper("name").alias("name"), "email", F.lit(False).alias("excluded"))
    added = t.many_repositories.select(
        (F.col("repo_id") + 10_000_000).alias("user_id"),
        F.col("repository_name").alias("name"),
        F.lit(None).cast("string").alias("email"),
        F.lit(True).alias("excluded"),
    )
    store = _user_store(t)
    store.upsert(renamed.unionByName(added), ["user_id"])
    return store.read()


@query
def delete_rows(t: Tables) -> DataFrame:
    store = _user_store(t)
    store.delete(users.excluded(t.users), ["user_id"])
    return store.read()


@query
def delete_all_rows(t: Tables) -> DataFrame:
    store = _user_store(t)
    store.delete_all()
    return store.read()


# Feeds


def _raw_repositories(t: Tables) -> DataFrame:
    return t.many_repositories.select(F.col("repository_name").alias("name"), F.col("organisation_name").alias("owner"))


def _known_repositories(t: Tables) -> DataFrame:
    return t.many_repositories.where(F.col("repo_id") % 3 == 0)


PREFIX = "Supplier#00000"


@query
def list_repositories(t: Tables) -> DataFrame:
    return feeds.list_repositories(t.many_repositories)


@query
def filter_repos_by_prefix(t: Tables) -> DataFrame:
    return feeds.matching_repositories(_raw_repositories(t), PREFIX)


@query
def ingest_repositories(t: Tables) -> DataFrame:
    return feeds.new_repositories(_raw_repositories(t), _known_repositories(t), PREFIX)


@query
def stamp_repositories(t: Tables) -> DataFrame:
    never = t.many_repositories.withColumn("last_fetched_at", F.lit(None).cast("timestamp_ntz"))
    return feeds.stamp_fetched(never, _raw_repositories(t), PREFIX, "2024-05-01T10:00:00Z")


@query
def ingest_commits(t: Tables) -> DataFrame:
    return feeds.ingest_commits(t.raw_commits)


@query
def ingest_commit_files(t: Tables) -> DataFrame:
    return feeds.ingest_commit_files(t.raw_commits)


@query
def ingest_pull_requests(t: Tables) -> DataFrame:
    return feeds.ingest_pull_requests(t.raw_pull_requests)


@query
def ingest_pr_comments(t: Tables) -> DataFrame:
    return feeds.ingest_pr_comments(t.raw_pull_requests)


@query
def ingest_users(t: Tables) -> DataFrame:
    return feeds.ingest_users(t.raw_commits, t.raw_pull_requests, t.users, DOMAIN)


@query
def ingest_users_weak(t: Tables) -> DataFrame:
    return feeds.ingest_users(t.raw_commits, t.raw_pull_requests, t.users, DOMAIN, weak=True)


@query
def find_new_commits(t: Tables) -> DataFrame:
    stored = commits.in_window(t.commits, "1970-01-01T00:00:00Z", STORED_UNTIL)
    return feeds.find_new_commits(feeds.ingest_commits(t.raw_commits).select("repo_id", "sha1", "commit_date"), stored)


@query
def find_new_pull_requests(t: Tables) -> DataFrame:
    stored = t.pull_requests.where(F.col("merged_by").isNotNull())
    return reviews.unseen(feeds.ingest_pull_requests(t.raw_pull_requests), stored).select("repo_id", "number", "title")


@query
def commits_since_high_water_mark(t: Tables) -> DataFrame:
    stored = commits.in_window(t.commits, "1970-01-01T00:00:00Z", STORED_UNTIL)
    feed = feeds.commit_rows(t.raw_commits).select("repo_id", "seq", "sha1", "commit_date")
    return fetch.since_high_water_mark(feed, stored)


@query
def incremental_new_commits(t: Tables) -> DataFrame:
    stored = commits.in_window(t.commits, "1970-01-01T00:00:00Z", STORED_UNTIL)
    feed = feeds.commit_rows(t.raw_commits).select("repo_id", "seq", "sha1", "commit_date")
    return fetch.new_commits(feed, stored)


def _incremental(t: Tables) -> tuple[Store, Store]:
    """Stored commits and their marks after one fetch into both."""
    known = commits.in_window(t.commits, "1970-01-01T00:00:00Z", STORED_UNTIL).select("repo_id", "sha1", "commit_date")
    folder = shared_dir(t.spark)
    store = commit_store(t.spark, f"{folder}/commits", known.schema)
    store.append(known)
    marks = fetch.high_water_marks(known)
    mark_store = Store(t.spark, f"{folder}/marks", marks.schema, by=["repo_id"], buckets=16)
    mark_store.append(marks)
    feed = feeds.commit_rows(t.raw_commits).select("repo_id", "seq", "sha1", "commit_date")
    fetch.fetch_into(store, mark_store, feed)
    return store, mark_store


@query
def incremental_store(t: Tables) -> DataFrame:
    return _incremental(t)[0].read()


@query
def incremental_marks(t: Tables) -> DataFrame:
    return _incremental(t)[1].read()


@query
def fetched_commits(t: Tables) -> DataFrame:
    """The commits one whole fetch adds, with their people resolved."""
    return _fetch(t)["commits"].select("repo_id", "sha1", "author_id", "committer_id", "commit_date", "lines_added")


@query
def fetched_refused(t: Tables) -> DataFrame:
    """Commits that a fetch does not store, and why."""
    return _fetch(t)["refused"]


@query
def fetched_line_totals(t: Tables) -> DataFrame:
    """From the feed to a result: totals of the files a fetch stored, per commit it stored."""
    tables = _fetch(t)
    totals = commits.line_totals(tables["commits"], tables["commit_files"])
    return tables["commits"].select("commit_id", "repo_id", "sha1").join(totals, "commit_id").drop("commit_id")


@query
def fetched_members(t: Tables) -> DataFrame:
    """Who works on the repositories, by what a fetch stored."""
    tables = _fetch(t)
    comments = tables["pr_comments"].select("pr_id", "commenter_id")
    people = t.users.unionByName(tables["users"])
    return members.repository_members(tables["commits"], tables["pull_requests"], comments, people)


@query
def fetched_comments(t: Tables) -> DataFrame:
    return _fetch(t)["pr_comments"].select("repo_id", "number", "kind", "commenter_id", "comment")


def _fetch(t: Tables) -> dict[str, DataFrame]:
    stored = commits.in_window(t.commits, "1970-01-01T00:00:00Z", STORED_UNTIL)
    known = t.pull_requests.where(F.col("merged_by").isNotNull())
    return fetch.fetch(
        t.raw_commits, t.raw_pull_requests, t.repositories, stored, known, t.users, t.team_members, DOMAIN
    )


def _fetch_repositories(t: Tables) -> dict[str, DataFrame]:
    """A fetch whose feed lists the repositories with a prefix, some of them stored."""
    known = _known_repositories(t).withColumn("last_fetched_at", F.lit(None).cast("timestamp_ntz"))
    stored = commits.in_window(t.commits, "1970-01-01T00:00:00Z", STORED_UNTIL)
    return fetch.fetch(
        t.raw_commits, t.raw_pull_requests, known, stored, t.pull_requests, t.users, t.team_members, DOMAIN,
        raw_repositories=_raw_repositories(t), prefix=PREFIX, now="2024-05-01T10:00:00Z",
    )


@query
def fetched_new_repositories(t: Tables) -> DataFrame:
    return _fetch_repositories(t)["new_repositories"]


@query
def fetched_stamps(t: Tables) -> DataFrame:
    return _fetch_repositories(t)["repositories"]


def _stream_ingest(t: Tables) -> DataFrame:
    orders = feeds.stream_files(t.spark, f"{t.dir}/orders.parquet", GIVEN["orders"])
    copies = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    feed = orders.select("*", F.explode(copies).alias("copy")).select(
        (F.col("o_orderkey") % 25).alias("repo_id"),
        F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("sha1"),
        (F.col("o_orderkey") * 10 + F.col("copy")).alias("seq"),
        F.col("o_custkey").alias("author_id"),
        F.col("o_orderdate").alias("commit_date"),
    )
    folder = shared_dir(t.spark)
    store = commit_store(t.spark, f"{folder}/commits", feed.schema)
    stream_ingest_commits(feed, store, f"{folder}/checkpoint").awaitTermination()
    return store.read()


_QUERIES["stream_ingest_commits"] = _stream_ingest


# Commits and files


@query
def filter_single_parent_commits(t: Tables) -> DataFrame:
    return commits.single_parent(t.commits).select("commit_id", "repo_id", "sha1", "parent")


@query
def filter_date_window(t: Tables) -> DataFrame:
    return commits.in_window(t.commits, *WINDOW).select("commit_id", "repo_id", "commit_date")


@query
def filter_java_files(t: Tables) -> DataFrame:
    return commits.source_files(t.changes).select("commit_id", "filename")


@query
def filter_gui_files(t: Tables) -> DataFrame:
    return commits.without_gui_files(t.changes).select("commit_id", "filename")


@query
def filter_modified_files(t: Tables) -> DataFrame:
    return commits.modified_files(t.changes).select("commit_id", "filename", "lines_changed")


@query
def filter_excluded_users(t: Tables) -> DataFrame:
    return users.without_excluded(t.commits, t.users).select("commit_id", "repo_id", "author_id")


@query
def find_commits_by_author(t: Tables) -> DataFrame:
    return commits.by_author(t.commits, users.search(t.users, "noreply", "email")).select("commit_id", "sha1", "author_id")


@query
def validate_commits(t: Tables) -> DataFrame:
    key = F.col("commit_id")
    loose = t.commits.select(
        key,
        "repo_id",
        "sha1",
        F.when(key % 11 != 0, F.col("author_id")).alias("author_id"),
        "committer_id",
        F.when(key % 17 != 0, F.col("commit_message")).alias("commit_message"),
    )
    return commits.validate(loose).select("commit_id", "problem")


@query
def display_commits(t: Tables) -> DataFrame:
    return commits.display(t.commits)


@query
def commit_parent_fields(t: Tables) -> DataFrame:
    return commits.parent_fields(t.commit_parents)


@query
def join_repository_commits(t: Tables) -> DataFrame:
    joined = commits.of_repositories(t.repositories, t.commits)
    return joined.select("repository_name", "organisation_name", "commit_id", "sha1")


@query
def join_commit_files(t: Tables) -> DataFrame:
    return commits.with_files(t.commits.select("commit_id", "repo_id"), t.changes.select("commit_id", "filename"))


@query
def join_commit_parent(t: Tables) -> DataFrame:
    return commits.with_parent(t.commits).select(
        "commit_id", "repo_id", "parent_commit_id", "parent_author_id", "parent_date"
    )


@query
def join_commit_author(t: Tables) -> DataFrame:
    return commits.with_author(t.commits, t.users).select("commit_id", "author_id", "name", "email", "excluded")


@query
def commit_line_totals(t: Tables) -> DataFrame:
    return commits.line_totals(t.commits, t.changes)


@query
def commit_files_changed(t: Tables) -> DataFrame:
    return commits.line_totals(t.commits, t.changes).select("commit_id", "files_changed")


@query
def commit_branches(t: Tables) -> DataFrame:
    return commits.branches(t.branch_sightings)


@query
def commit_branch_counts(t: Tables) -> DataFrame:
    return commits.branch_counts(t.branch_sightings)


@query
def repository_branches(t: Tables) -> DataFrame:
    return commits.repository_branches(t.branch_sightings)


@query
def dedupe_commits_first_seen(t: Tables) -> DataFrame:
    seen = feeds.commit_rows(t.raw_commits).select("repo_id", "sha1", "seq", "commit_message", "commit_date")
    return commits.first_sightings(seen)


@query
def latest_commit_per_repo(t: Tables) -> DataFrame:
    return commits.latest(t.commits)


@query
def commits_newest_first(t: Tables) -> DataFrame:
    return commits.newest_first(t.commits).select("repo_id", "sha1", "commit_date")


@query
def commit_calendar(t: Tables) -> DataFrame:
    return commits.calendar(t.commits)


@query
def commit_calendar_days(t: Tables) -> DataFrame:
    return commits.calendar_days(t.commits)


@query
def user_commit_lists(t: Tables) -> DataFrame:
    return commits.user_commits(commits.single_parent(t.commits))


# Users


@query
def search_users(t: Tables) -> DataFrame:
    return users.search(t.users, "00042", "both").unionByName(users.search(t.users, "NOREPLY", "email", ignore_case=True))


@query
def list_excluded_users(t: Tables) -> DataFrame:
    return users.excluded(t.users)


@query
def find_user_by_name_email(t: Tables) -> DataFrame:
    wanted = feeds.commit_identities(t.raw_commits)
    return users.matching_identities(t.users, wanted)


@query
def user_label(t: Tables) -> DataFrame:
    return users.labels(t.users.withColumn("name", F.when(F.col("user_id") % 9 != 0, F.col("name"))))


@query
def fill_default_email(t: Tables) -> DataFrame:
    return users.fill_default_email(feeds.commit_identities(t.raw_commits), DOMAIN)


@query
def set_user_excluded(t: Tables) -> DataFrame:
    everyone = users.exclude_search(t.users, "noreply", "both")
    return users.set_excluded_ids(everyone, t.pull_requests.select(F.col("opened_by").alias("user_id")), False)


@query
def create_users(t: Tables) -> DataFrame:
    new = t.many_repositories.select(
        F.col("repository_name").alias("name"),
        F.lit(None).cast("string").alias("email"),
        (F.col("repo_id") % 2 == 0).alias("excluded"),
    )
    return users.create(t.users, new.unionByName(t.users.select("name", "email", "excluded")))


@query
def resolve_users_strict(t: Tables) -> DataFrame:
    return users.resolve_strict(feeds.commit_identities(t.raw_commits), t.users, DOMAIN)


@query
def resolve_users_weak(t: Tables) -> DataFrame:
    return users.resolve_weak(feeds.commit_identities(t.raw_commits), t.users, DOMAIN)


@query
def remap_users(t: Tables) -> DataFrame:
    moved, _, _ = users.remap_all(t.commits, t.pr_comments, t.pull_requests, t.user_mapping)
    return moved.select("commit_id", "author_id", "committer_id")


@query
def remap_comment_users(t: Tables) -> DataFrame:
    _, moved, _ = users.remap_all(t.commits, t.pr_comments, t.pull_requests, t.user_mapping)
    return moved.select("pr_id", "comment_no", "commenter_id")


@query
def remap_pull_request_users(t: Tables) -> DataFrame:
    _, _, moved = users.remap_all(t.commits, t.pr_comments, t.pull_requests, t.user_mapping)
    return moved.select("pr_id", "opened_by", "merged_by")


@query
def remap_problems(t: Tables) -> DataFrame:
    more = users.excluded(t.users).select(
        F.col("user_id").alias("old_user_id"), (F.col("user_id") + 1).alias("new_user_id")
    )
    return users.mapping_problems(t.user_mapping.unionByName(more))


@query
def user_alias_groups(t: Tables) -> DataFrame:
    return users.alias_groups(t.users)


# Pull requests and members


@query
def find_prs_by_opener(t: Tables) -> DataFrame:
    return reviews.opened_by(t.pull_requests, users.excluded(t.users)).select("pr_id", "repo_id", "opened_by")


@query
def find_prs_by_merger(t: Tables) -> DataFrame:
    return reviews.merged_by(t.pull_requests, users.excluded(t.users)).select("pr_id", "repo_id", "merged_by")


@query
def find_comments_by_user(t: Tables) -> DataFrame:
    return reviews.comments_by(t.pr_comments, users.excluded(t.users)).select("pr_id", "comment_no", "commenter_id", "comment")


@query
def display_pull_requests(t: Tables) -> DataFrame:
    return reviews.display(t.pull_requests, t.repositories)


@query
def repository_members(t: Tables) -> DataFrame:
    return members.repository_members(t.commits, t.pull_requests, t.pr_comments, t.users)


@query
def users_outside_team(t: Tables) -> DataFrame:
    return members.users_outside_team(t.commits, t.team_members, t.users)


@query
def repos_without_team(t: Tables) -> DataFrame:
    return members.repositories_without_team(t.repositories, t.team_members)


@query
def repos_with_duplicate_users(t: Tables) -> DataFrame:
    return members.repositories_with_duplicate_users(t.repositories, t.commits, t.team_members, t.users)


@query
def fetch_report(t: Tables) -> DataFrame:
    return members.fetch_report(t.repositories, t.commits, t.team_members, t.users)


# Scores


def _covered(t: Tables) -> DataFrame:
    return commits.single_parent(t.commits)


def _source(t: Tables) -> DataFrame:
    return scoring.analysable_changes(t.changes)


@query
def filter_deletions(t: Tables) -> DataFrame:
    return scoring.credited(t.changes).select("commit_id", "filename", "change_op", "entity_type")


@query
def score_changes(t: Tables) -> DataFrame:
    return scoring.score_changes(t.changes).select("commit_id", "filename", "change_op", "entity_type", "score")


@query
def categorise_changes(t: Tables) -> DataFrame:
    return scoring.categorise_changes(t.changes).select("commit_id", "filename", "entity_type", "category")


@query
def file_base_name(t: Tables) -> DataFrame:
    return t.changes.select("commit_id", C.base_name(F.col("filename")).alias("file"))


@query
def file_change_scores(t: Tables) -> DataFrame:
    return scoring.file_change_scores(_source(t))


@query
def filter_nonzero_files(t: Tables) -> DataFrame:
    return scoring.nonzero_files(scoring.file_change_scores(_source(t)))


@query
def files_by_name(t: Tables) -> DataFrame:
    shares = scoring.file_user_shares(_covered(t), _source(t))
    return shares.groupBy("repo_id", "file").agg(F.sum("score").alias("score")).orderBy("repo_id", "file")


@query
def commit_scores(t: Tables) -> DataFrame:
    return scoring.commit_scores(_covered(t), _source(t))


@query
def user_scores(t: Tables) -> DataFrame:
    return scoring.user_scores(_covered(t), _source(t))


@query
def user_score_percent(t: Tables) -> DataFrame:
    return scoring.contribution_percent(t.commits, t.changes, t.users)


@query
def format_percent(t: Tables) -> DataFrame:
    percents = scoring.contribution_percent(t.commits, t.changes, t.users)
    return percents.select("repo_id", "user_id", C.percent_text(F.col("percent")).alias("percent_text"))


@query
def user_category_counts(t: Tables) -> DataFrame:
    return scoring.user_category_counts(_covered(t), _source(t))


@query
def user_file_category_counts(t: Tables) -> DataFrame:
    return scoring.user_file_category_counts(_covered(t), _source(t))


@query
def summary_all_levels(t: Tables) -> DataFrame:
    return scoring.summary_levels(_covered(t), _source(t))


@query
def file_user_shares(t: Tables) -> DataFrame:
    return scoring.file_user_shares(_covered(t), _source(t))


@query
def file_user_matrix(t: Tables) -> DataFrame:
    tables = contributions.summary(t.repositories, t.commits, t.changes, t.users)
    return tables["matrix"]


@query
def file_user_chart(t: Tables) -> DataFrame:
    """The chart as a table with a column for each of some users."""
    tables = contributions.summary(t.repositories, t.commits, t.changes, t.users)
    return scoring.pivot_users(tables["matrix"], [1, 2, 4])


@query
def attach_user_commits(t: Tables) -> DataFrame:
    percents = scoring.contribution_percent(t.commits, t.changes, t.users)
    return scoring.users_with_commits(percents, _covered(t))


@query
def window_score_percent(t: Tables) -> DataFrame:
    """The headline result for a date window, GUI files included."""
    tables = contributions.summary(t.repositories, t.commits, t.changes, t.users, *WINDOW, exclude_gui=False)
    return tables["users"]


# Batch runs and reports


@query
def read_batch_config(t: Tables) -> DataFrame:
    entry = F.struct(
        (F.col("repo_id") % 2 == 0).alias("exactMatch"),
        F.col("repository_name").alias("name"),
        F.when(F.col("repo_id") % 3 != 0, F.col("repo_id") % 3 == 1).alias("excludeGUI"),
        F.when(F.col("repo_id") % 5 == 0, F.lit(WINDOW[0])).alias("startDate"),
        F.when(F.col("repo_id") % 5 == 0, F.lit(WINDOW[1])).alias("endDate"),
    )
    prefix = F.struct(
        F.lit(False).alias("exactMatch"),
        F.substring("repository_name", 1, 12).alias("name"),
        F.lit(None).cast("boolean").alias("excludeGUI"),
        F.lit(None).cast("string").alias("startDate"),
        F.lit(None).cast("string").alias("endDate"),
    )
    document = F.to_json(F.struct(F.col("organisation_name").alias("organisation"), F.array(entry, prefix).alias("repositories")))
    return config.matchers(feeds.parse_json(t.many_repositories.select(document.alias("value")), BATCH_CONFIG))


@query
def match_batch_repositories(t: Tables) -> DataFrame:
    return batch.match_repositories(_all_matchers(t), t.many_repositories).select(
        "run_id", "repo_id", "repository_name", "exact_match", "exclude_gui"
    )


def _all_matchers(t: Tables) -> DataFrame:
    """Exact matchers for every account, and one prefix matcher per nation."""
    prefixes = t.matchers.select(
        (-F.col("run_id") - 1).alias("run_id"),
        F.lit("COURSE").alias("organisation"),
        F.lit(False).alias("exact_match"),
        F.concat(F.lit("Supplier#"), F.lpad((F.col("run_id") % 10).cast("string"), 8, "0")).alias("name"),
        "exclude_gui",
        "start_date",
        "end_date",
    )
    # some of the accounts' matchers are wrong, each in its own way
    key = F.col("run_id") % 50
    accounts = t.many_matchers.withColumns(
        {
            "exact_match": F.when(key != 11, F.col("exact_match")),
            "start_date": F.when(key == 21, "2021-08-09").when(key == 31, "2021-08-09T00:00:00+02:00"),
            "end_date": F.when(key == 41, "2021-13-45T00:00:00Z").when(key == 31, "2022-01-01T00:00:00Z"),
        }
    )
    return accounts.unionByName(prefixes)


@query
def unmatched_exact_matchers(t: Tables) -> DataFrame:
    return batch.unmatched_exact(_all_matchers(t), t.many_repositories).select("run_id", "name")


@query
def batch_report(t: Tables) -> DataFrame:
    return batch.report(_all_matchers(t), t.many_repositories)


@query
def batch_report_counts(t: Tables) -> DataFrame:
    return batch.report_counts(batch.report(_all_matchers(t), t.many_repositories))


@query
def batch_user_percent(t: Tables) -> DataFrame:
    matched = batch.match_repositories(t.matchers, t.repositories)
    return batch.user_percent(matched, t.commits, t.changes, t.users)


@query
def batch_file_shares(t: Tables) -> DataFrame:
    matched = batch.match_repositories(t.matchers, t.repositories)
    return batch.file_shares(matched, t.commits, t.changes)


@query
def batch_documents(t: Tables) -> DataFrame:
    return batch.documents(batch.match_repositories(t.matchers, t.repositories), t.commits, t.changes, t.users)


@query
def batch_pages(t: Tables) -> DataFrame:
    """The report page of every run and repository."""
    lines = batch.documents(batch.match_repositories(t.matchers, t.repositories), t.commits, t.changes, t.users)
    return pages.page_lines(lines, TEMPLATE, "SUMMARY_JSON", batch.GROUP)


@query
def summary_json(t: Tables) -> DataFrame:
    return contributions.documents(t.repositories, t.commits, t.changes, t.users)


@query
def report_pages(t: Tables) -> DataFrame:
    lines = contributions.documents(t.repositories, t.commits, t.changes, t.users)
    return pages.page_lines(lines, TEMPLATE, "SUMMARY_JSON", ["repo_id"])


# Change extraction


def _pairs(t: Tables) -> DataFrame:
    covered = commits.single_parent(t.commits).select("commit_id", "repo_id", "sha1", "parent")
    return changes.pair_file_revisions(covered.join(t.store_files, "commit_id"), t.kept_revisions)


ENTITY = ("repo_id", "sha1", "filename", "entity_type", "unique_name", "owner", "method", "method_statements", "method_first")


@query
def pair_file_revisions(t: Tables) -> DataFrame:
    return _pairs(t)


@query
def extract_entities(t: Tables) -> DataFrame:
    return changes.extract_entities(t.file_revisions).select(*ENTITY, "lacks_constructor")


@query
def filter_boilerplate_methods(t: Tables) -> DataFrame:
    return changes.without_boilerplate(changes.extract_entities(t.file_revisions)).select(*ENTITY)


@query
def synthesise_nested_constructor(t: Tables) -> DataFrame:
    found = changes.extract_entities(t.file_revisions)
    return changes.synthesise_nested_constructors(found).select(
        "repo_id", "sha1", "filename", "entity_type", "unique_name", "owner"
    )


@query
def diff_entities(t: Tables) -> DataFrame:
    return changes.extract_changes(changes.dealt(changes.marked(_pairs(t))), whole="whole")


@query
def quarantine_failed_files(t: Tables) -> DataFrame:
    return changes.quarantine(_pairs(t))


@query
def diff_revision_lines(t: Tables) -> DataFrame:
    return changes.diff_revision_lines(t.document_pairs, ["doc_id"])


@query
def score_percent_from_texts(t: Tables) -> DataFrame:
    """The whole way: texts to changes to the share of every user."""
    covered = commits.single_parent(t.commits)
    found = contributions.changes_from_texts(covered, t.store_files, t.kept_revisions)
    return scoring.contribution_percent(t.commits, found, t.users)
