"""Declared schemas of the domain tables and of the raw feeds.

Instants are TIMESTAMP_NTZ in UTC, so results do not depend on the session zone.
Set-valued fields (branches of a commit, comments of a pull request) are long
tables of their own.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

LONG, TEXT, FLAG, INSTANT = LongType(), StringType(), BooleanType(), TimestampNTZType()


def struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


REPOSITORIES = struct(repo_id=LONG, repository_name=TEXT, organisation_name=TEXT, last_fetched_at=INSTANT)
GIT_USERS = struct(user_id=LONG, name=TEXT, email=TEXT, excluded=FLAG)
COMMITS = struct(
    commit_id=LONG,
    repo_id=LONG,
    sha1=TEXT,
    parent=TEXT,
    is_merge_commit=FLAG,
    author_id=LONG,
    committer_id=LONG,
    commit_date=INSTANT,
    commit_message=TEXT,
    lines_added=LONG,
    lines_removed=LONG,
    lines_changed=LONG,
    files_changed=LONG,
    url=TEXT,
)
COMMIT_BRANCHES = struct(repo_id=LONG, sha1=TEXT, branch=TEXT)
COMMIT_FILES = struct(
    file_id=LONG,
    commit_id=LONG,
    filename=TEXT,
    lines_added=LONG,
    lines_deleted=LONG,
    lines_changed=LONG,
    url=TEXT,
    patch=TEXT,
)
CHANGES = struct(
    commit_id=LONG, filename=TEXT, change_op=TEXT, entity_type=TEXT, unique_name=TEXT, parent_name=TEXT
)
FILE_REVISIONS = struct(repo_id=LONG, sha1=TEXT, filename=TEXT, text=TEXT)
PULL_REQUESTS = struct(
    pr_id=LONG,
    repo_id=LONG,
    number=LONG,
    opened_at=INSTANT,
    closed_at=INSTANT,
    opened_by=LONG,
    merged_by=LONG,
    title=TEXT,
    body=TEXT,
    url=TEXT,
)
PR_COMMENTS = struct(comment_id=LONG, pr_id=LONG, commenter_id=LONG, comment=TEXT, created_at=INSTANT)
TEAM_MEMBERS = struct(repo_id=LONG, user_id=LONG)
USER_MAPPING = struct(old_user_id=LONG, new_user_id=LONG)

PERSON = struct(name=TEXT, email=TEXT)
RAW_FILE = struct(filename=TEXT, additions=LONG, deletions=LONG, changes=LONG, blob_url=TEXT, patch=TEXT)
RAW_COMMENT = struct(user=PERSON, body=TEXT, created_at=TEXT)
# One record per commit and branch it was seen on.
RAW_COMMITS = struct(
    repo_id=LONG,
    seq=LONG,
    sha=TEXT,
    branch=TEXT,
    author=PERSON,
    committer=PERSON,
    message=TEXT,
    date=TEXT,
    parents=ArrayType(TEXT),
    url=TEXT,
    files=ArrayType(RAW_FILE),
)
# One record per page of a pull request; each page carries part of its comments.
RAW_PULL_REQUESTS = struct(
    repo_id=LONG,
    number=LONG,
    page=LONG,
    state=TEXT,
    user=PERSON,
    merged_by=PERSON,
    created_at=TEXT,
    closed_at=TEXT,
    title=TEXT,
    body=TEXT,
    url=TEXT,
    comments=ArrayType(RAW_COMMENT),
    review_comments=ArrayType(RAW_COMMENT),
)
RAW_REPOSITORIES = struct(name=TEXT, owner=TEXT)
BATCH_ENTRY = struct(exactMatch=FLAG, name=TEXT, excludeGUI=FLAG, startDate=TEXT, endDate=TEXT)
BATCH_CONFIG = struct(organisation=TEXT, repositories=ArrayType(BATCH_ENTRY))
