"""Identities: search, exclusion, aliases, resolution and remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .spread import join_one

ID_BUCKET_DIGITS = 3  # hex digits of the hash that picks a bucket: 4096 buckets
ID_BUCKETS = 16**ID_BUCKET_DIGITS


def _matches(term: str, field: str, ignore_case: bool) -> Column:
    wanted = term.lower() if ignore_case else term

    def has(name: str) -> Column:
        column = F.lower(name) if ignore_case else F.col(name)
        return F.coalesce(column.contains(wanted), F.lit(False))

    if field == "both":
        return has("name") | has("email")
    if field in ("name", "email"):
        return has(field)
    raise ValueError(f"search by name, email or both, not {field}")


def search(users: DataFrame, term: str, field: str = "both", ignore_case: bool = False) -> DataFrame:
    return users.where(_matches(term, field, ignore_case))


def excluded(users: DataFrame) -> DataFrame:
    return users.where("excluded")


def without_excluded(commits: DataFrame, users: DataFrame) -> DataFrame:
    """Commits whose author is a known user that is not excluded."""
    included = users.where(~F.col("excluded")).select(F.col("user_id").alias("author_id"))
    return commits.join(included, "author_id", "left_semi")


def matching_identities(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Users whose (name, email) is asked for; a missing email equals a missing email."""
    w = wanted.select(F.col("name").alias("_name"), F.col("email").alias("_email"))
    return users.join(
        w, (users["name"] == w["_name"]) & users["email"].eqNullSafe(w["_email"]), "left_semi"
    )


def labels(users: DataFrame) -> DataFrame:
    return users.select("user_id", C.user_label(F.col("name"), F.col("email")).alias("label"))


def fill_default_email(identities: DataFrame, domain: str) -> DataFrame:
    return identities.withColumn("email", C.email_or_default(F.col("name"), F.col("email"), domain))


def set_excluded(users: DataFrame, value: bool, condition: Column) -> DataFrame:
    return users.withColumn("excluded", F.when(condition, F.lit(value)).otherwise(F.col("excluded")))


def exclude_search(users: DataFrame, term: str, field: str, ignore_case: bool = False) -> DataFrame:
    return set_excluded(users, True, _matches(term, field, ignore_case))


def set_excluded_ids(users: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    """Sets the flag of every user listed in ``ids`` (``user_id``)."""
    flags = ids.select("user_id").distinct().withColumn("_listed", F.lit(True))
    return (
        users.join(flags, "user_id", "left")
        .withColumn("excluded", F.when(F.col("_listed"), F.lit(value)).otherwise(F.col("excluded")))
        .drop("_listed")
    )


def numbered(new: DataFrame, users: DataFrame) -> DataFrame:
    """Gives distinct (name, email) rows a ``user_id`` above every known one.

    Numbers run within 4096 hash buckets instead of over one global order, so no
    task sees all rows; an id depends only on the rows, never on task placement.
    """
    bucket = F.conv(F.substring(F.md5(F.concat_ws("\n", "name", "email")), 1, ID_BUCKET_DIGITS), 16, 10)
    order = Window.partitionBy("_bucket").orderBy("name", "email")
    top = F.coalesce(users.agg(F.max("user_id")).scalar(), F.lit(0))
    return (
        new.withColumn("_bucket", bucket.cast("bigint"))
        .withColumn("_nth", F.row_number().over(order) - 1)
        .withColumn("user_id", top + 1 + F.col("_nth") * ID_BUCKETS + F.col("_bucket"))
        .drop("_bucket", "_nth")
    )


def _identities(raw: DataFrame, domain: str) -> DataFrame:
    return fill_default_email(raw.where(F.col("name").isNotNull()).select("name", "email"), domain).distinct()


def new_users(raw: DataFrame, users: DataFrame, domain: str, weak: bool = False) -> DataFrame:
    """Users to add: identities met in a feed that no known user answers to.

    Strict matching compares name and email, weak matching the email alone; then
    one user per email is added, under the first name in order.
    """
    keys = ["email"] if weak else ["name", "email"]
    known = fill_default_email(users.select("name", "email"), domain).select(*keys)
    fresh = _identities(raw, domain).join(known, keys, "left_anti")
    if weak:
        fresh = fresh.groupBy("email").agg(F.min("name").alias("name"))
    return numbered(fresh, users).select("user_id", "name", "email", F.lit(False).alias("excluded"))


def create(users: DataFrame, rows: DataFrame) -> DataFrame:
    """The user table with the given (name, email, excluded) rows added where they are not known."""
    one_each = rows.groupBy("name", "email").agg(F.bool_or("excluded").alias("excluded"))
    known = users.select(F.col("name").alias("_name"), F.col("email").alias("_email"))
    fresh = one_each.join(
        known, (one_each["name"] == known["_name"]) & one_each["email"].eqNullSafe(known["_email"]), "left_anti"
    )
    return users.unionByName(numbered(fresh, users).select("user_id", "name", "email", "excluded"))


def resolve_strict(identities: DataFrame, users: DataFrame, domain: str) -> DataFrame:
    """Adds the ``user_id`` with the same name and email, the lowest where several have both."""
    known = (
        fill_default_email(users, domain).groupBy("name", "email").agg(F.min("user_id").alias("user_id"))
    )
    rest = [name for name in identities.columns if name not in ("name", "email")]
    return join_one(fill_default_email(identities, domain), known, ["name", "email"], rest or ["name"], "left")


def resolve_weak(identities: DataFrame, users: DataFrame, domain: str) -> DataFrame:
    """Adds the lowest ``user_id`` with the same email."""
    known = fill_default_email(users, domain).groupBy("email").agg(F.min("user_id").alias("user_id"))
    rest = [name for name in identities.columns if name != "email"]
    return join_one(fill_default_email(identities, domain), known, ["email"], rest, "left")


def mapping_problems(mapping: DataFrame) -> DataFrame:
    """Reasons not to use a mapping: an old user twice, or a new user that is itself replaced.

    The second covers chains and cycles of every length.
    """
    repeated = (
        mapping.groupBy("old_user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("old_user_id", F.lit("replaced more than once").alias("problem"))
    )
    targets = mapping.select("old_user_id", F.col("new_user_id").alias("_id"))
    sources = mapping.select(F.col("old_user_id").alias("_id"))
    chained = targets.join(sources, "_id", "left_semi").select(
        "old_user_id", F.lit("new user is replaced too").alias("problem")
    )
    return repeated.unionByName(chained).distinct()


def remap(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Replaces old users by new ones in one foreign key; check ``mapping_problems`` first."""
    m = mapping.select(F.col("old_user_id").alias(column), F.col("new_user_id").alias("_new"))
    return (
        rows.join(m, column, "left")
        .withColumn(column, F.coalesce("_new", column))
        .select(*rows.columns)
    )


def remap_all(
    commits: DataFrame, comments: DataFrame, pull_requests: DataFrame, mapping: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Moves authorship, comments, opened and merged pull requests; committers stay."""
    return (
        remap(commits, mapping, "author_id"),
        remap(comments, mapping, "commenter_id"),
        remap(remap(pull_requests, mapping, "opened_by"), mapping, "merged_by"),
    )


def alias_groups(users: DataFrame) -> DataFrame:
    """Users that share an email under different names, with the size of their group."""
    groups = (
        users.where(F.col("email").isNotNull())
        .select("email", "name")
        .distinct()
        .groupBy("email")
        .agg(F.count(F.lit(1)).alias("n_names"))
        .where("n_names > 1")
    )
    return join_one(users.select("email", "user_id", "name"), groups, ["email"], ["user_id"])
