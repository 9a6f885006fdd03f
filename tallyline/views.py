"""The project-history tables, derived from the given benchmark tables.

Every column is computed from its own row (``changes`` joins lineitem with part),
so a view costs no more than its scan and filters reach the files.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .functions import columns as C
from .schemas import INSTANT, LONG, RAW_COMMITS, RAW_PULL_REQUESTS, TEXT, struct
from .sources import feeds

DOMAIN = "example.edu"
NUMBER, SHORT = DoubleType(), IntegerType()

# The given tables; declared, so that no query starts with a job that looks at files.
GIVEN = {
    "region": struct(r_regionkey=SHORT, r_name=TEXT),
    "nation": struct(n_nationkey=SHORT, n_name=TEXT, n_regionkey=SHORT),
    "customer": struct(c_custkey=LONG, c_name=TEXT, c_nationkey=SHORT, c_acctbal=NUMBER, c_mktsegment=TEXT),
    "supplier": struct(s_suppkey=LONG, s_name=TEXT, s_nationkey=SHORT, s_acctbal=NUMBER),
    "part": struct(
        p_partkey=LONG, p_name=TEXT, p_brand=TEXT, p_type=TEXT, p_size=SHORT, p_retailprice=NUMBER
    ),
    "orders": struct(
        o_orderkey=LONG,
        o_custkey=LONG,
        o_orderstatus=TEXT,
        o_totalprice=NUMBER,
        o_orderdate=INSTANT,
        o_orderpriority=TEXT,
    ),
    "lineitem": struct(
        l_orderkey=LONG,
        l_partkey=LONG,
        l_suppkey=LONG,
        l_linenumber=SHORT,
        l_quantity=NUMBER,
        l_extendedprice=NUMBER,
        l_discount=NUMBER,
        l_tax=NUMBER,
        l_returnflag=TEXT,
        l_linestatus=TEXT,
        l_shipdate=INSTANT,
    ),
    "documents": struct(doc_id=LONG, text=TEXT, lang=TEXT, source=TEXT, n_chars=LONG),
    "conversations": struct(conv_id=LONG, turn=LONG, role=TEXT, text=TEXT),
}


def email_of(key: Column) -> Column:
    """Three aliases to an address, and one address many accounts share."""
    return F.when(key % 10 == 3, F.lit("noreply@users.example.edu")).otherwise(
        F.concat(F.lit("user"), F.floor(key / 3).cast("string"), F.lit("@example.edu"))
    )


def name_of(key: Column) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def _person(key: Column, email_missing: Column) -> Column:
    return F.struct(name_of(key).alias("name"), F.when(~email_missing, email_of(key)).alias("email"))


def _iso(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("name"),
            email_of(F.col("c_custkey")).alias("email"),
            (F.col("c_acctbal") < 0).alias("excluded"),
        )

    @cached_property
    def repositories(self) -> DataFrame:
        region = self.read("region")
        return self.read("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").cast("bigint").alias("repo_id"),
            F.col("n_name").alias("repository_name"),
            F.col("r_name").alias("organisation_name"),
        )

    @cached_property
    def many_repositories(self) -> DataFrame:
        """A repository list that grows with the data."""
        return self.read("supplier").select(
            F.col("s_suppkey").alias("repo_id"),
            F.col("s_name").alias("repository_name"),
            F.lit("COURSE").alias("organisation_name"),
        )

    @cached_property
    def _orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        earlier = F.concat(F.lit("c"), (key - 25).cast("string"))
        parents = (
            F.when(key < 25, F.array().cast("array<string>"))
            .when(F.col("o_orderstatus") == "P", F.array(earlier, F.concat(F.lit("m"), key.cast("string"))))
            .when(key % 101 == 0, F.array(earlier, F.lit("x"), F.lit("y")))
            .otherwise(F.array(earlier))
        )
        return self.read("orders").select(
            "*",
            (key % 25).alias("repo_id"),
            F.concat(F.lit("c"), key.cast("string")).alias("sha1"),
            parents.alias("parents"),
            F.concat(F.lit("https://git.example.edu/c/"), key.cast("string")).alias("url"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        """Each repository is a chain: a commit builds on the one 25 keys earlier."""
        key, author = F.col("o_orderkey"), F.col("o_custkey")
        return self._orders.select(
            key.alias("commit_id"),
            "repo_id",
            "sha1",
            C.only_parent(F.col("parents")).alias("parent"),
            C.is_merge(F.col("parents")).alias("is_merge_commit"),
            author.alias("author_id"),
            F.when(key % 7 != 0, author).alias("committer_id"),
            F.col("o_orderdate").alias("commit_date"),
            F.col("o_orderpriority").alias("commit_message"),
            (key % 97).alias("lines_added"),
            (author % 53).alias("lines_removed"),
            (key % 97 + author % 53).alias("lines_changed"),
            (key % 7).alias("files_changed"),
            "url",
        )

    @cached_property
    def commit_parents(self) -> DataFrame:
        return self._orders.select(F.col("o_orderkey").alias("commit_id"), "repo_id", "sha1", "parents")

    @cached_property
    def branch_sightings(self) -> DataFrame:
        key = F.col("l_orderkey")
        return self.read("lineitem").select(
            (key % 25).alias("repo_id"),
            F.concat(F.lit("c"), key.cast("string")).alias("sha1"),
            F.col("l_linestatus").alias("branch"),
            F.col("l_linenumber").cast("bigint").alias("seq"),
        )

    @cached_property
    def changes(self) -> DataFrame:
        """Changed files and typed changes in one view: one row per line item."""
        line = F.col("l_linenumber")
        entity = (
            F.when(line == 1, "CLASS").when(line == 2, "METHOD").when(line == 3, "FIELD").when(line == 4, "JAVADOC")
            .when(line == 5, "BLOCK_COMMENT").when(line == 6, "IF_STATEMENT").otherwise("METHOD_INVOCATION")
        )
        op = (
            F.when(F.col("l_returnflag") == "A", "INSERT").when(F.col("l_returnflag") == "N", "UPDATE").otherwise("DELETE")
        )
        folder = (
            F.when(F.col("p_type") == "PROMO", "view").when(F.col("p_type") == "SMALL", "ui").otherwise(F.lower("p_type"))
        )
        part = self.read("part").select(
            "p_partkey",
            F.concat(
                F.lit("src/"), folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")),
                F.when(F.col("p_size") % 5 == 0, ".md").otherwise(".java"),
            ).alias("filename"),
        )
        added = F.col("l_quantity").cast("bigint")
        deleted = F.round(F.col("l_discount") * 100).cast("bigint")
        return self.read("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("commit_id"),
            "filename",
            F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(added).cast("bigint").alias("lines_added"),
            F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(deleted).cast("bigint").alias("lines_deleted"),
            F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(added + deleted).cast("bigint").alias("lines_changed"),
            op.alias("change_op"),
            entity.alias("entity_type"),
            F.concat_ws(".", F.lit("Part"), F.col("l_partkey").cast("string")).alias("unique_name"),
        )

    @cached_property
    def pull_requests(self) -> DataFrame:
        conv = F.col("conv_id")
        return self.read("conversations").select("conv_id").distinct().select(
            conv.alias("pr_id"),
            conv.alias("number"),
            (conv % 25).alias("repo_id"),
            (conv % 150).alias("opened_by"),
            F.when(conv % 3 != 0, (conv + 1) % 150).alias("merged_by"),
            F.concat(F.lit("Change "), conv.cast("string")).alias("title"),
            F.when(conv % 4 != 0, F.concat(F.lit("Closes "), conv.cast("string"))).alias("body"),
            F.concat(F.lit("https://git.example.edu/p/"), conv.cast("string")).alias("url"),
        )

    @cached_property
    def pr_comments(self) -> DataFrame:
        return self.read("conversations").select(
            F.col("conv_id").alias("pr_id"),
            F.col("turn").alias("comment_no"),
            ((F.col("conv_id") + F.col("turn")) % 150).alias("commenter_id"),
            F.col("text").alias("comment"),
        )

    @cached_property
    def team_members(self) -> DataFrame:
        """Every customer is on the team of its nation; repositories 4, 9, 14, ... have none."""
        return self.read("customer").where(F.col("c_nationkey") % 5 != 4).select(
            F.col("c_nationkey").cast("bigint").alias("repo_id"), F.col("c_custkey").alias("user_id")
        )

    @cached_property
    def user_mapping(self) -> DataFrame:
        """Aliases move to the first account of their address."""
        key = F.col("c_custkey")
        return self.read("customer").where(key % 3 != 0).select(
            key.alias("old_user_id"), (key - key % 3).alias("new_user_id")
        )

    @cached_property
    def raw_commits(self) -> DataFrame:
        """JSON records, one per commit and branch; a commit touches up to three files."""
        key, author = F.col("o_orderkey"), F.col("o_custkey")
        who = F.when(key % 20 == 0, author + 1_000_000).otherwise(author)
        file = lambda n: F.struct(
            F.concat(F.lit("src/m"), ((key + n) % 11).cast("string"), F.lit("/File"), n.cast("string"), F.lit(".java")).alias("filename"),
            ((key + n) % 4).cast("bigint").alias("additions"),
            ((author * n) % 3).cast("bigint").alias("deletions"),
            ((key + n) % 4 + (author * n) % 3).cast("bigint").alias("changes"),
            F.when(n != 2, F.concat(F.lit("https://git.example.edu/b/"), n.cast("string"))).alias("blob_url"),
            F.concat(F.lit("@@ "), key.cast("string")).alias("patch"),
        )
        count = (key % 4).cast("int")
        files = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), file))
        branches = F.when(key % 3 == 0, F.array(F.lit("main"), F.lit("dev"))).otherwise(F.array(F.lit("main")))
        record = F.struct(
            "repo_id",
            F.when(key % 17 != 0, key * 2 + F.col("at")).alias("seq"),
            F.col("sha1").alias("sha"),
            F.col("branch"),
            _person(who, author % 6 == 0).alias("author"),
            F.when(key % 13 != 0, _person(author, F.lit(False))).alias("committer"),
            F.when(key % 41 != 0, F.concat(F.col("o_orderpriority"), F.lit(" on "), F.col("branch"))).alias("message"),
            F.when(key % 19 != 0, _iso(F.col("o_orderdate"))).alias("date"),
            "parents",
            "url",
            F.coalesce(files, F.array()).alias("files"),
        )
        lines = self._orders.select("*", F.posexplode(branches).alias("at", "branch")).select(
            F.to_json(record).alias("value")
        )
        return feeds.parse_json(lines, RAW_COMMITS)

    @cached_property
    def raw_pull_requests(self) -> DataFrame:
        """JSON records, one page per turn; even turns are issue comments, odd ones review comments."""
        conv, turn = F.col("conv_id"), F.col("turn")
        comment = F.array(
            F.struct(
                _person((conv + turn) % 150, conv % 6 == 0).alias("user"),
                F.col("text").alias("body"),
                F.lit("2024-03-01T12:00:00Z").alias("created_at"),
            )
        )
        record = F.struct(
            (conv % 25).alias("repo_id"),
            conv.alias("number"),
            F.when(conv % 11 != 3, turn).alias("page"),
            F.when(conv % 3 == 0, "open").otherwise("closed").alias("state"),
            _person(conv % 150, F.lit(False)).alias("user"),
            F.when(conv % 3 != 0, _person((conv + 1) % 150, F.lit(False))).alias("merged_by"),
            F.lit("2024-02-01T08:30:00Z").alias("created_at"),
            F.when(conv % 3 != 0, "2024-04-01T00:00:00+02:00").alias("closed_at"),
            F.concat(F.lit("Change "), conv.cast("string"), F.lit(" page "), turn.cast("string")).alias("title"),
            F.when(conv % 4 != 0, F.concat(F.lit("Closes "), conv.cast("string"))).alias("body"),
            F.concat(F.lit("https://git.example.edu/p/"), conv.cast("string")).alias("url"),
            F.when(turn % 2 == 0, comment).alias("comments"),
            F.when(turn % 2 == 1, comment).alias("review_comments"),
        )
        lines = self.read("conversations").select(F.to_json(record).alias("value"))
        return feeds.parse_json(lines, RAW_PULL_REQUESTS)

    @cached_property
    def file_revisions(self) -> DataFrame:
        """One Java file per repository, whose text at each commit follows from the commit's row.

        Every text has members of its own, and some texts are broken.
        """
        key, author = F.col("o_orderkey"), F.col("o_custkey")
        step = lambda n: F.concat(
            F.lit("  void step"), n.cast("string"), F.lit("() {\n    go("), (key + n).cast("string"), F.lit(");\n  }\n")
        )
        steps = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda n: n <= author % 4), step)
        text = F.concat(
            F.lit("public class Store {\n  private String name;\n  int id"), key.cast("string"), F.lit(";\n"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "  protected int extra = 0;\n").otherwise(""),
            F.lit("  public String getName() { return name; }\n"),
            F.lit("  public int total() {\n    return "), (author % 4).cast("string"), F.lit(";\n  }\n"),
            F.when(
                F.col("o_totalprice") > 250000,
                "  /** Checks. */\n  void check(int a) {\n    if (a < 0) {\n      throw new Error(\"low\");\n    }\n    log(a);\n  }\n",
            ).otherwise(""),
            F.array_join(steps, ""),
            F.when(key % 7 == 0, "  static class Part {\n    int size;\n  }\n").otherwise(""),
            F.when(key % 50 == 7, "  /* open\n").otherwise(""),
            F.lit("}\n"),
        )
        return self._orders.select("repo_id", "sha1", self._store_path().alias("filename"), text.alias("text"))

    @cached_property
    def kept_revisions(self) -> DataFrame:
        """The same where every tenth commit has lost the file."""
        return self.file_revisions.where(F.substring("sha1", -1, 1) != "9")

    @cached_property
    def store_files(self) -> DataFrame:
        """The file every analysed commit touches in ``file_revisions``."""
        return self.commits.select("commit_id", self._store_path().alias("filename"))

    @staticmethod
    def _store_path() -> Column:
        return F.concat(F.lit("src/m"), (F.col("repo_id") % 4).cast("string"), F.lit("/Store.java"))

    @cached_property
    def document_pairs(self) -> DataFrame:
        """Every document as the old text of the next one."""
        new = self.read("documents").select("doc_id", F.col("text").alias("new_text"))
        old = self.read("documents").select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("old_text"))
        return new.join(old, "doc_id", "left").select(
            "doc_id", F.coalesce("old_text", F.lit("")).alias("old_text"), F.coalesce("new_text", F.lit("")).alias("new_text")
        )

    @cached_property
    def matchers(self) -> DataFrame:
        """Batch matchers for the nation repositories, a few per organisation."""
        nation = F.col("n_nationkey")
        region = self.read("region")
        return self.read("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
            nation.alias("run_id"),
            F.col("r_name").alias("organisation"),
            (nation % 3 != 0).alias("exact_match"),
            F.when(nation % 3 == 0, F.substring("n_name", 1, 8))
            .when(nation % 11 == 10, F.concat(F.lit("OLD_"), "n_name"))
            .otherwise(F.col("n_name"))
            .alias("name"),
            (nation % 2 == 0).alias("exclude_gui"),
            F.when(nation % 4 == 1, "1996-01-01T00:00:00Z").alias("start_date"),
            F.when((nation % 4 == 1) | (nation % 4 == 2), "1999-12-31T00:00:00Z").alias("end_date"),
        )

    @cached_property
    def many_matchers(self) -> DataFrame:
        """Exact matchers that grow with the data, some of them without a repository."""
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.cast("int").alias("run_id"),
            F.lit("COURSE").alias("organisation"),
            F.lit(True).alias("exact_match"),
            F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0")).alias("name"),
            (key % 2 == 0).alias("exclude_gui"),
            F.lit(None).cast("string").alias("start_date"),
            F.lit(None).cast("string").alias("end_date"),
        )
