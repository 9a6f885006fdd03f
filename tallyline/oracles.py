"""The SQL each query is compared with, over the same given tables.

``VIEWS`` states the derived tables once more, in SQL; every oracle names the
views it needs.
"""

from __future__ import annotations

import re

EMAIL = (
    "CASE WHEN {k} % 10 = 3 THEN 'noreply@users.example.edu' "
    "ELSE 'user' || CAST({k} // 3 AS VARCHAR) || '@example.edu' END"
)
NAME = "'Customer#' || lpad(CAST({k} AS VARCHAR), 9, '0')"
STORE_LINES = {
    "fixed": "TRUE",
    "urgent": "o_orderpriority = '1-URGENT'",
    "checked": "o_totalprice > 250000",
    "nested": "o_orderkey % 7 = 0",
    "step1": "o_custkey % 4 >= 1",
    "step2": "o_custkey % 4 >= 2",
    "step3": "o_custkey % 4 >= 3",
}
# (condition, entity_type, unique_name, owner, method, statements, first statement, nested class without constructor)
STORE_ENTITIES = [
    ("fixed", "FIELD", "'Store.name : String'", "Store", None, None, None, False),
    ("fixed", "FIELD", "'Store.id' || o_orderkey || ' : int'", "Store", None, None, None, False),
    ("urgent", "FIELD", "'Store.extra : int'", "Store", None, None, None, False),
    ("fixed", "RETURN_STATEMENT", "'return name;'", "Store.getName()", "getName()", 1, "RETURN_STATEMENT", False),
    ("fixed", "METHOD", "'Store.getName()'", "Store", "getName()", 1, "RETURN_STATEMENT", False),
    ("fixed", "RETURN_STATEMENT", "'return ' || (o_custkey % 4) || ';'", "Store.total()", "total()", 1, "RETURN_STATEMENT", False),
    ("fixed", "METHOD", "'Store.total()'", "Store", "total()", 1, "RETURN_STATEMENT", False),
    ("checked", "JAVADOC", "'/** Checks. */'", "Store.check(int)", "check(int)", 4, "THROW_STATEMENT", False),
    ("checked", "THROW_STATEMENT", "'throw new Error(\"low\");'", "Store.check(int)", "check(int)", 4, "THROW_STATEMENT", False),
    ("checked", "THEN_STATEMENT", "'a < 0'", "Store.check(int)", "check(int)", 4, "THROW_STATEMENT", False),
    ("checked", "IF_STATEMENT", "'a < 0'", "Store.check(int)", "check(int)", 4, "THROW_STATEMENT", False),
    ("checked", "METHOD_INVOCATION", "'log(a);'", "Store.check(int)", "check(int)", 4, "THROW_STATEMENT", False),
    ("checked", "METHOD", "'Store.check(int)'", "Store", "check(int)", 4, "THROW_STATEMENT", False),
    ("step1", "METHOD_INVOCATION", "'go(' || (o_orderkey + 1) || ');'", "Store.step1()", "step1()", 1, "METHOD_INVOCATION", False),
    ("step1", "METHOD", "'Store.step1()'", "Store", "step1()", 1, "METHOD_INVOCATION", False),
    ("step2", "METHOD_INVOCATION", "'go(' || (o_orderkey + 2) || ');'", "Store.step2()", "step2()", 1, "METHOD_INVOCATION", False),
    ("step2", "METHOD", "'Store.step2()'", "Store", "step2()", 1, "METHOD_INVOCATION", False),
    ("step3", "METHOD_INVOCATION", "'go(' || (o_orderkey + 3) || ');'", "Store.step3()", "step3()", 1, "METHOD_INVOCATION", False),
    ("step3", "METHOD", "'Store.step3()'", "Store", "step3()", 1, "METHOD_INVOCATION", False),
    ("nested", "FIELD", "'Store.Part.size : int'", "Store.Part", None, None, None, False),
    ("nested", "CLASS", "'Store.Part'", "Store", None, None, None, True),
    ("fixed", "CLASS", "'Store'", "", None, None, None, False),
]


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


def _store_entities() -> str:
    parts = []
    for at, (condition, kind, name, owner, method, statements, first, lacks) in enumerate(STORE_ENTITIES):
        count = "CAST(NULL AS INT)" if statements is None else f"CAST({statements} AS INT)"
        parts.append(
            f"SELECT o_orderkey AS k, {at} AS ordinal, o_orderkey % 25 AS repo_id, 'c' || o_orderkey AS sha1, "
            f"'src/m' || (o_orderkey % 25 % 4) || '/Store.java' AS filename, '{kind}' AS entity_type, "
            f"{name} AS unique_name, '{owner}' AS owner, {_text(method)} AS method, {count} AS method_statements, "
            f"{_text(first)} AS method_first, {lacks} AS lacks_constructor FROM orders "
            f"WHERE o_orderkey % 50 <> 7 AND {STORE_LINES[condition]}"
        )
    return " UNION ALL ".join(parts)


VIEWS = {
    "users": f"""SELECT c_custkey AS user_id, c_name AS name, {EMAIL.format(k='c_custkey')} AS email,
        c_acctbal < 0 AS excluded FROM customer""",
    "repositories": """SELECT CAST(n_nationkey AS BIGINT) AS repo_id, n_name AS repository_name,
        r_name AS organisation_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "many_repositories": """SELECT s_suppkey AS repo_id, s_name AS repository_name,
        'COURSE' AS organisation_name FROM supplier""",
    "commits": """SELECT o_orderkey AS commit_id, o_orderkey % 25 AS repo_id, 'c' || o_orderkey AS sha1,
        CASE WHEN o_orderkey >= 25 AND o_orderstatus <> 'P' AND o_orderkey % 101 <> 0
            THEN 'c' || (o_orderkey - 25) END AS parent,
        o_orderkey >= 25 AND o_orderstatus = 'P' AS is_merge_commit,
        o_custkey AS author_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS committer_id,
        o_orderdate AS commit_date, o_orderpriority AS commit_message, o_orderkey % 97 AS lines_added,
        o_custkey % 53 AS lines_removed, o_orderkey % 97 + o_custkey % 53 AS lines_changed,
        o_orderkey % 7 AS files_changed, 'https://git.example.edu/c/' || o_orderkey AS url FROM orders""",
    "covered": "SELECT * FROM commits WHERE NOT is_merge_commit AND parent IS NOT NULL",
    "sightings": """SELECT l_orderkey % 25 AS repo_id, 'c' || l_orderkey AS sha1, l_linestatus AS branch
        FROM lineitem""",
    "changes": """SELECT l_orderkey AS commit_id,
        concat('src/', CASE p_type WHEN 'PROMO' THEN 'view' WHEN 'SMALL' THEN 'ui' ELSE lower(p_type) END, '/',
            replace(p_name, ' ', '_'), CASE WHEN p_size % 5 = 0 THEN '.md' ELSE '.java' END) AS filename,
        CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS lines_added,
        CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE CAST(round(l_discount * 100) AS BIGINT) END AS lines_deleted,
        CASE WHEN l_suppkey % 10 = 0 THEN 0
            ELSE CAST(l_quantity AS BIGINT) + CAST(round(l_discount * 100) AS BIGINT) END AS lines_changed,
        CASE l_returnflag WHEN 'A' THEN 'INSERT' WHEN 'N' THEN 'UPDATE' ELSE 'DELETE' END AS change_op,
        CASE l_linenumber WHEN 1 THEN 'CLASS' WHEN 2 THEN 'METHOD' WHEN 3 THEN 'FIELD' WHEN 4 THEN 'JAVADOC'
            WHEN 5 THEN 'BLOCK_COMMENT' WHEN 6 THEN 'IF_STATEMENT' ELSE 'METHOD_INVOCATION' END AS entity_type,
        'Part.' || l_partkey AS unique_name
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "scored": """SELECT *, CASE WHEN change_op = 'DELETE' THEN 0 WHEN entity_type = 'CLASS' THEN 100
            WHEN entity_type = 'METHOD' THEN 25 WHEN entity_type = 'FIELD' THEN 10
            WHEN entity_type IN ('JAVADOC', 'BLOCK_COMMENT', 'LINE_COMMENT') THEN 1 ELSE 3 END AS score,
        CASE entity_type WHEN 'CLASS' THEN 'Class' WHEN 'METHOD' THEN 'Method' WHEN 'FIELD' THEN 'Field'
            WHEN 'JAVADOC' THEN 'Documentation' WHEN 'BLOCK_COMMENT' THEN 'Documentation'
            WHEN 'LINE_COMMENT' THEN 'Documentation' ELSE 'Other' END AS category,
        regexp_replace(filename, '^.*/', '') AS file FROM changes""",
    "java": "SELECT * FROM scored WHERE filename LIKE '%java'",
    "source": "SELECT * FROM java WHERE filename NOT LIKE '%ui%' AND filename NOT LIKE '%view%'",
    "per_user": """SELECT c.repo_id, c.author_id AS user_id, CAST(sum(coalesce(s.score, 0)) AS BIGINT) AS score
        FROM covered c LEFT JOIN source s ON c.commit_id = s.commit_id GROUP BY ALL""",
    "percents": """SELECT p.repo_id, p.user_id, p.score, CAST(100 * p.score AS DOUBLE)
            / NULLIF(CAST(sum(p.score) OVER (PARTITION BY p.repo_id) AS DOUBLE), 0) AS percent
        FROM per_user p JOIN users u ON p.user_id = u.user_id WHERE NOT u.excluded""",
    "authored": """SELECT c.repo_id, c.author_id AS user_id, s.filename, s.file, s.category, s.change_op, s.score
        FROM covered c JOIN source s ON c.commit_id = s.commit_id""",
    "shares": """SELECT repo_id, file, user_id, score, CAST(score AS DOUBLE)
            / NULLIF(CAST(sum(score) OVER (PARTITION BY repo_id, file) AS DOUBLE), 0) AS share
        FROM (SELECT repo_id, file, user_id, CAST(sum(score) AS BIGINT) AS score FROM authored GROUP BY ALL)""",
    "cells": """SELECT s.repo_id, s.file, s.user_id, s.share FROM shares s
        JOIN percents p ON s.repo_id = p.repo_id AND s.user_id = p.user_id WHERE s.score <> 0""",
    "pull_requests": """SELECT DISTINCT conv_id AS pr_id, conv_id AS number, conv_id % 25 AS repo_id,
        conv_id % 150 AS opened_by, CASE WHEN conv_id % 3 <> 0 THEN (conv_id + 1) % 150 END AS merged_by,
        'Change ' || conv_id AS title, CASE WHEN conv_id % 4 <> 0 THEN 'Closes ' || conv_id END AS body,
        'https://git.example.edu/p/' || conv_id AS url FROM conversations""",
    "pr_comments": """SELECT conv_id AS pr_id, turn AS comment_no, (conv_id + turn) % 150 AS commenter_id,
        text AS comment FROM conversations""",
    "teams": """SELECT CAST(c_nationkey AS BIGINT) AS repo_id, c_custkey AS user_id FROM customer
        WHERE c_nationkey % 5 <> 4""",
    "authors": "SELECT DISTINCT repo_id, author_id AS user_id FROM commits",
    "outside": """SELECT a.repo_id, a.user_id FROM authors a JOIN users u ON a.user_id = u.user_id
        WHERE NOT u.excluded AND a.repo_id IN (SELECT repo_id FROM teams)
        AND NOT EXISTS (SELECT 1 FROM teams t WHERE t.repo_id = a.repo_id AND t.user_id = a.user_id)""",
    "mapping": """SELECT c_custkey AS old_user_id, c_custkey - c_custkey % 3 AS new_user_id FROM customer
        WHERE c_custkey % 3 <> 0""",
    "raw": f"""SELECT o_orderkey % 25 AS repo_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey * 2 + b.pos END AS seq, 'c' || o_orderkey AS sha1, b.branch,
        {NAME.format(k='who')} AS author_name,
        CASE WHEN o_custkey % 6 <> 0 THEN {EMAIL.format(k='who')} END AS author_email,
        CASE WHEN o_orderkey % 13 <> 0 THEN {NAME.format(k='o_custkey')} END AS committer_name,
        CASE WHEN o_orderkey % 13 <> 0 THEN {EMAIL.format(k='o_custkey')} END AS committer_email,
        CASE WHEN o_orderkey % 41 <> 0 THEN o_orderpriority || ' on ' || b.branch END AS commit_message,
        CASE WHEN o_orderkey % 19 <> 0 THEN o_orderdate END AS commit_date, o_orderkey, o_custkey
        FROM (SELECT *, CASE WHEN o_orderkey % 20 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS who FROM orders) o
        JOIN (VALUES (0, 'main'), (1, 'dev')) AS b(pos, branch) ON b.pos = 0 OR o_orderkey % 3 = 0""",
    "first_raw": """SELECT * FROM raw
        QUALIFY row_number() OVER (PARTITION BY repo_id, sha1 ORDER BY seq NULLS LAST, commit_message) = 1""",
    "raw_files": """SELECT repo_id, sha1, o_orderkey,
        'src/m' || ((o_orderkey + n) % 11) || '/File' || n || '.java' AS filename,
        (o_orderkey + n) % 4 AS lines_added, (o_custkey * n) % 3 AS lines_deleted,
        (o_orderkey + n) % 4 + (o_custkey * n) % 3 AS lines_changed,
        CASE WHEN n <> 2 THEN 'https://git.example.edu/b/' || n END AS url, '@@ ' || o_orderkey AS patch
        FROM (SELECT *, unnest(range(1, o_orderkey % 4 + 1)) AS n FROM first_raw)""",
    "commit_people": """SELECT DISTINCT name, email FROM (SELECT author_name AS name, author_email AS email FROM raw
        UNION ALL SELECT committer_name, committer_email FROM raw) WHERE name IS NOT NULL""",
    "review_people": f"""SELECT DISTINCT name, email FROM (
        SELECT {NAME.format(k='(conv_id % 150)')} AS name, {EMAIL.format(k='(conv_id % 150)')} AS email FROM conversations
        UNION ALL SELECT {NAME.format(k='((conv_id + 1) % 150)')}, {EMAIL.format(k='((conv_id + 1) % 150)')}
            FROM conversations WHERE conv_id % 3 <> 0
        UNION ALL SELECT {NAME.format(k='((conv_id + turn) % 150)')}, CASE WHEN conv_id % 6 <> 0 THEN
            {EMAIL.format(k='((conv_id + turn) % 150)')} END FROM conversations)""",
    "people": """SELECT DISTINCT name, coalesce(email, name || '@example.edu') AS email
        FROM (SELECT * FROM commit_people UNION ALL SELECT * FROM review_people)""",
    "known": "SELECT user_id, name, coalesce(email, name || '@example.edu') AS email FROM users",
    "added_users": """SELECT (SELECT max(user_id) FROM users) + 1 + 4096 * (row_number() OVER (
            PARTITION BY bucket ORDER BY name, email) - 1) + bucket AS user_id, name, email, FALSE AS excluded
        FROM (SELECT name, email, CAST('0x' || substr(md5(name || chr(10) || email), 1, 3) AS BIGINT) AS bucket
            FROM people WHERE (name, email) NOT IN (SELECT (name, email) FROM known))""",
    "everyone": """SELECT user_id, name, coalesce(email, name || '@example.edu') AS email FROM users
        UNION ALL SELECT user_id, name, email FROM added_users""",
    "stored": "SELECT * FROM commits WHERE commit_date <= TIMESTAMP '1999-06-30 00:00:00'",
    "marks": "SELECT repo_id, max(commit_date) AS mark FROM stored GROUP BY repo_id",
    "fetched": """SELECT r.repo_id, r.sha1, a.user_id AS author_id, b.user_id AS committer_id, r.commit_date, r.commit_message,
        CAST(coalesce((SELECT sum(lines_added) FROM raw_files f WHERE f.sha1 = r.sha1), 0) AS BIGINT) AS lines_added
        FROM first_raw r LEFT JOIN marks m ON m.repo_id = r.repo_id
        LEFT JOIN everyone a ON a.name = r.author_name
            AND a.email = coalesce(r.author_email, r.author_name || '@example.edu')
        LEFT JOIN everyone b ON b.name = r.committer_name AND b.email = r.committer_email
        WHERE (m.mark IS NULL OR r.commit_date IS NULL OR r.commit_date >= m.mark)
        AND (r.repo_id, r.sha1) NOT IN (SELECT (repo_id, sha1) FROM stored)""",
    "matchers": """SELECT n_nationkey AS run_id, r_name AS organisation, n_nationkey % 3 <> 0 AS exact_match,
        CASE WHEN n_nationkey % 3 = 0 THEN substr(n_name, 1, 8) WHEN n_nationkey % 11 = 10 THEN 'OLD_' || n_name
            ELSE n_name END AS name, n_nationkey % 2 = 0 AS exclude_gui,
        CASE WHEN n_nationkey % 4 = 1 THEN TIMESTAMP '1996-01-01 00:00:00' END AS start_date,
        CASE WHEN n_nationkey % 4 IN (1, 2) THEN TIMESTAMP '1999-12-31 00:00:00' END AS end_date
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "refused": """SELECT CAST(c_custkey AS INT) AS run_id, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name,
            CASE c_custkey % 50 WHEN 11 THEN 'exactMatch is missing' WHEN 21 THEN 'startDate is no instant: 2021-08-09'
                ELSE 'endDate is no instant: 2021-13-45T00:00:00Z' END AS reason
        FROM customer WHERE c_custkey % 50 IN (11, 21, 41)""",
    "all_matchers": """SELECT CAST(c_custkey AS INT) AS run_id, TRUE AS exact_match,
            'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, c_custkey % 2 = 0 AS exclude_gui FROM customer
        WHERE c_custkey % 50 NOT IN (11, 21, 41)
        UNION ALL SELECT -run_id - 1, FALSE, 'Supplier#' || lpad(CAST(run_id % 10 AS VARCHAR), 8, '0'), exclude_gui
            FROM matchers""",
    "matched": """SELECT m.run_id, r.repo_id, r.repository_name, m.exact_match, m.exclude_gui
        FROM all_matchers m JOIN many_repositories r
        ON CASE WHEN m.exact_match THEN r.repository_name = m.name ELSE starts_with(r.repository_name, m.name) END""",
    "unmatched": """SELECT run_id, name FROM all_matchers WHERE exact_match
        AND name NOT IN (SELECT repository_name FROM many_repositories)""",
    "run_commits": """SELECT m.run_id, c.repo_id, c.commit_id, c.author_id AS user_id, m.exclude_gui
        FROM matchers m JOIN repositories r ON m.organisation = r.organisation_name
            AND CASE WHEN m.exact_match THEN r.repository_name = m.name ELSE starts_with(r.repository_name, m.name) END
        JOIN covered c ON c.repo_id = r.repo_id
            AND (m.start_date IS NULL OR m.end_date IS NULL OR c.commit_date BETWEEN m.start_date AND m.end_date)""",
    "run_changes": """SELECT r.*, j.file, j.score FROM run_commits r JOIN java j ON r.commit_id = j.commit_id
        AND NOT (r.exclude_gui AND (j.filename LIKE '%ui%' OR j.filename LIKE '%view%'))""",
    "matrix": """SELECT * FROM cells
        UNION ALL SELECT p.repo_id, NULL, p.user_id, 0.0 FROM percents p WHERE NOT EXISTS
            (SELECT 1 FROM cells c WHERE c.repo_id = p.repo_id AND c.user_id = p.user_id)
        UNION ALL SELECT DISTINCT s.repo_id, s.file, NULL, 0.0 FROM shares s WHERE NOT EXISTS
            (SELECT 1 FROM cells c WHERE c.repo_id = s.repo_id AND c.file = s.file)""",
    "entities": _store_entities(),
    "pairs": """SELECT c.commit_id AS k, c.repo_id, c.sha1, c.commit_id - 25 AS old_k,
        'src/m' || (c.repo_id % 4) || '/Store.java' AS filename FROM covered c""",
    "readable": "SELECT * FROM pairs WHERE k % 50 <> 7 AND old_k % 50 <> 7",
    "kept_entities": """SELECT k, ordinal, entity_type, unique_name, owner FROM entities
        WHERE method IS DISTINCT FROM 'getName()' AND k % 10 <> 9
        UNION ALL SELECT k, ordinal, 'METHOD', 'Store.Part.Part()', 'Store.Part' FROM entities
            WHERE lacks_constructor AND k % 10 <> 9
        UNION ALL SELECT k, ordinal, 'CONSTRUCTOR_INVOCATION', 'super();', 'Store.Part.Part()' FROM entities
            WHERE lacks_constructor AND k % 10 <> 9""",
    "left_over": """SELECT *, row_number() OVER (PARTITION BY k, owner, entity_type, n > 0 ORDER BY ordinal, unique_name) AS nth
        FROM (SELECT k, entity_type, unique_name, owner, sum(side) AS n, min(ordinal) AS ordinal FROM (
                SELECT p.k, e.ordinal, e.entity_type, e.unique_name, e.owner, 1 AS side
                    FROM readable p JOIN kept_entities e ON e.k = p.k
                UNION ALL SELECT p.k, e.ordinal, e.entity_type, e.unique_name, e.owner, -1
                    FROM readable p JOIN kept_entities e ON e.k = p.old_k)
            GROUP BY k, entity_type, unique_name, owner HAVING sum(side) <> 0)""",
    "text_changes": """SELECT p.k, p.repo_id, p.sha1, p.filename, d.entity_type, d.unique_name, d.owner AS parent_name,
        CASE WHEN o.k IS NOT NULL THEN 'UPDATE' WHEN d.n > 0 THEN 'INSERT' ELSE 'DELETE' END AS change_op
        FROM left_over d JOIN readable p ON p.k = d.k
        LEFT JOIN left_over o ON o.k = d.k AND o.owner = d.owner AND o.entity_type = d.entity_type
            AND o.nth = d.nth AND (o.n > 0) <> (d.n > 0)
        WHERE NOT (d.n > 0 AND o.k IS NOT NULL)""",
}

DISPLAY = "commit_date, lines_added, lines_removed, lines_changed, commit_message, url"
STORE_TEXT = """'public class Store {' || chr(10) || '  private String name;' || chr(10)
    || '  int id' || o_orderkey || ';' || chr(10)
    || CASE WHEN o_orderpriority = '1-URGENT' THEN '  protected int extra = 0;' || chr(10) ELSE '' END
    || '  public String getName() { return name; }' || chr(10) || '  public int total() {' || chr(10)
    || '    return ' || (o_custkey % 4) || ';' || chr(10) || '  }' || chr(10)
    || CASE WHEN o_totalprice > 250000 THEN '  /** Checks. */' || chr(10) || '  void check(int a) {' || chr(10)
        || '    if (a < 0) {' || chr(10) || '      throw new Error("low");' || chr(10) || '    }' || chr(10)
        || '    log(a);' || chr(10) || '  }' || chr(10) ELSE '' END
    || CASE WHEN o_custkey % 4 >= 1 THEN '  void step1() {' || chr(10) || '    go(' || (o_orderkey + 1) || ');' || chr(10) || '  }' || chr(10) ELSE '' END
    || CASE WHEN o_custkey % 4 >= 2 THEN '  void step2() {' || chr(10) || '    go(' || (o_orderkey + 2) || ');' || chr(10) || '  }' || chr(10) ELSE '' END
    || CASE WHEN o_custkey % 4 >= 3 THEN '  void step3() {' || chr(10) || '    go(' || (o_orderkey + 3) || ');' || chr(10) || '  }' || chr(10) ELSE '' END
    || CASE WHEN o_orderkey % 7 = 0 THEN '  static class Part {' || chr(10) || '    int size;' || chr(10)
        || '  }' || chr(10) ELSE '' END
    || CASE WHEN o_orderkey % 50 = 7 THEN '  /* open' || chr(10) ELSE '' END || '}' || chr(10)"""
UNREADABLE = "'unterminated comment or text block'"
ENTITY = "repo_id, sha1, filename, entity_type, unique_name, owner, method, method_statements, method_first"
LINES = """SELECT {key} AS doc_id, {side} AS side,
    trim(regexp_replace(unnest(string_split(text, chr(10))), '[ \\t\\r\\f]+', ' ', 'g')) AS line FROM documents"""

# A double as Spark writes it: with an exponent from 10^7 on, here for whole numbers, and below 0.001.
_MANTISSA = "{d}[1] || '.' || coalesce(nullif(substr({d}, 2), ''), '0') || 'E' || {e}"


def _double(x: str) -> str:
    whole, small = f"CAST(CAST({x} AS BIGINT) AS VARCHAR)", f"CAST({x} AS VARCHAR)"
    digits = f"ltrim(substr({small}, 3), '0')"
    power = f"replace(split_part({small}, 'e', 1), '.', '')"
    return f"""CASE WHEN {x} IS NULL THEN 'null' WHEN {x} >= 1e7 THEN {_MANTISSA.format(d=f"rtrim({whole}, '0')", e=f"(length({whole}) - 1)")}
        WHEN {x} >= 0.001 OR {x} = 0 THEN {small}
        WHEN contains({small}, 'e') THEN {_MANTISSA.format(d=power, e=f"CAST(split_part({small}, 'e', 2) AS INT)")}
        ELSE {_MANTISSA.format(d=digits, e=f"-(length({small}) - 1 - length({digits}))")} END"""


def _bins() -> str:
    names = []
    for category in ("Class", "Documentation", "Field", "Method", "Other"):
        for op, word in (("INSERT", "additions"), ("UPDATE", "updates")):
            here = f"FILTER (category = '{category}' AND change_op = '{op}')"
            names.append(f"""'"{category} {word}":' || CAST(sum(n) {here} AS VARCHAR)""")
    return "'{' || concat_ws(',', " + ", ".join(names) + ") || '}'"


def _documents(group: str, docs: str, commits: str) -> str:
    """CTEs up to ``lines``, the document lines; ``commits`` has the group, commit_id, user_id and exclude_gui."""
    seconds = lambda name: f"CASE WHEN start_date IS NULL OR end_date IS NULL THEN 'null' ELSE {_double(f'epoch({name})')} END"
    comma = lambda within, key: f"CASE WHEN row_number() OVER (PARTITION BY {group}, {within} ORDER BY {key}) = 1 THEN '' ELSE ',' END"
    line = lambda section, a, part, b, item, c, text: f"""SELECT {group}, CAST({section} AS INT) AS section, {a} AS a, CAST({part} AS INT) AS part,
        {b} AS b, CAST({item} AS INT) AS item, {c} AS c, {text} AS text"""  # noqa: E731
    place = "lpad(CAST(commit_id AS VARCHAR), 20, '0') || '/' || filename"
    newest = "lpad(CAST(100000000000000000 - epoch_us(commit_date) AS VARCHAR), 18, '0') || sha1"
    key = "user_id, label, commit_id, filename"
    return f"""WITH docs AS ({docs}), own AS ({commits}),
    detail AS (SELECT {group}, user_id, commit_id, filename, file, category, change_op, concat_ws(' ', change_op, entity_type, unique_name) AS what,
        CAST(sum(score) AS BIGINT) AS score, count(*) AS n FROM own JOIN java USING (commit_id)
        WHERE NOT (exclude_gui AND (filename LIKE '%ui%' OR filename LIKE '%view%')) GROUP BY ALL),
    authors_named AS (SELECT {group}, user_id, excluded, name || ' (' || email || ')' AS base FROM (SELECT DISTINCT {group}, user_id FROM own) JOIN users USING (user_id)),
    labels AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY {group}, base) > 1 THEN base || ' #' || user_id ELSE base END AS label FROM authors_named),
    kinds AS (SELECT {group}, user_id, sum(score) AS score, {_bins()} AS binned FROM detail GROUP BY {group}, user_id),
    shown AS (SELECT {group}, user_id, label, CAST(coalesce(score, 0) AS BIGINT) AS score, coalesce(binned, '{{}}') AS binned,
        CAST(100 * coalesce(score, 0) AS DOUBLE) / NULLIF(CAST(sum(coalesce(score, 0)) OVER (PARTITION BY {group}) AS DOUBLE), 0) AS percent
        FROM labels LEFT JOIN kinds USING ({group}, user_id) WHERE NOT excluded),
    mine AS (SELECT detail.*, label FROM detail JOIN shown USING ({group}, user_id)),
    files AS (SELECT {group}, {key}, CAST(sum(score) AS BIGINT) AS score, {_bins()} AS binned FROM mine GROUP BY {group}, {key}),
    per_file AS (SELECT *, sum(score) OVER (PARTITION BY {group}, file) AS total
        FROM (SELECT {group}, file, user_id, CAST(sum(score) AS BIGINT) AS score FROM detail GROUP BY ALL)),
    names AS (SELECT DISTINCT {group}, file FROM detail),
    lines AS (
    {line(0, "''", 0, "''", 0, "''", f"""'{{"repo":"' || repository_name || '","startDate":' || {seconds("start_date")} || ',"endDate":' || {seconds("end_date")} || ',"changesPerUser":{{'""")} FROM docs
    UNION ALL {line(2, "''", 0, "''", 0, "''", """'},"changesPerFile":{'""")} FROM docs
    UNION ALL {line(4, "''", 0, "''", 0, "''", "'}}'")} FROM docs
    UNION ALL {line(1, "label", 0, "''", 0, "''", f"""{comma("1", "label")} || '"' || label || '":{{"contributionsScore":' || score
        || ',"contributionsScorePercent":' || {_double("percent")} || ',"binnedChangesCounts":' || binned || ',"commits":['""")} FROM shown
    UNION ALL {line(1, "label", 2, "''", 0, "''", """'],"changes":['""")} FROM shown
    UNION ALL {line(1, "label", 4, "''", 0, "''", "']}'")} FROM shown
    UNION ALL {line(1, "label", 1, newest, 0, "''", f"""{comma("label", newest)} || '{{"date":' || {_double("epoch(commit_date)")} || ',"lines_added":' || lines_added
        || ',"lines_removed":' || lines_removed || ',"lines_changed":' || lines_changed || ',"commit_message":"' || commit_message || '","url":"' || url || '"}}'""")}
        FROM own JOIN shown USING ({group}, user_id) JOIN commits USING ({"repo_id, " if "repo_id" in group else ""}commit_id)
    UNION ALL {line(1, "label", 3, place, 0, "''", f"""{comma("label", place)} || '{{"fileName":"' || filename || '","score":' || score
        || ',"binnedChangesCounts":' || binned || ',"allChanges":['""")} FROM files
    UNION ALL {line(1, "label", 3, place, 2, "''", "']}'")} FROM files
    UNION ALL {line(1, "label", 3, place, 1, "what", f"""{comma("label, commit_id, filename", "what")} || '{{"change":"' || what || '","count":' || n || '}}'""")}
        FROM mine WHERE change_op <> 'DELETE'
    UNION ALL {line(3, "file", 0, "''", 0, "''", f"""{comma("1", "file")} || '"' || file || '":{{'""")} FROM names
    UNION ALL {line(3, "file", 2, "''", 0, "''", "'}'")} FROM names
    UNION ALL {line(3, "file", 1, "label", 0, "''", f"""{comma("file", "label")} || '"' || label || '":' || {_double("CAST(score AS DOUBLE) / NULLIF(CAST(total AS DOUBLE), 0)")}""")}
        FROM per_file JOIN labels USING ({group}, user_id))"""


def _pages(group: str, documents: str, template: str = "<html><body><script>var data = SUMMARY_JSON;</script></body></html>") -> str:
    before, after = template.split("SUMMARY_JSON")
    fixed = lambda place, text: f"""SELECT {place} AS place, {group}, 0 AS section, '' AS a, 0 AS part, '' AS b, 0 AS item, '' AS c,
        '{text}' AS text FROM lines WHERE section = 0"""  # noqa: E731
    return f"{documents} SELECT 1 AS place, lines.* FROM lines UNION ALL {fixed(0, before)} UNION ALL {fixed(2, after)}"


ONE_EACH = _documents(
    "repo_id",
    """SELECT repo_id, repository_name, NULL::TIMESTAMP AS start_date, NULL::TIMESTAMP AS end_date FROM repositories
        WHERE repo_id IN (SELECT repo_id FROM covered)""",
    "SELECT repo_id, commit_id, author_id AS user_id, TRUE AS exclude_gui FROM covered",
)
OF_RUNS = _documents(
    "run_id, repo_id",
    """SELECT m.run_id, r.repo_id, r.repository_name, m.start_date, m.end_date FROM matchers m JOIN repositories r
        ON m.organisation = r.organisation_name
        AND CASE WHEN m.exact_match THEN r.repository_name = m.name ELSE starts_with(r.repository_name, m.name) END""",
    "SELECT * FROM run_commits",
)

ORACLES = {
    "summary_json": f"{ONE_EACH} SELECT * FROM lines",
    "report_pages": _pages("repo_id", ONE_EACH),
    "batch_documents": f"{OF_RUNS} SELECT * FROM lines",
    "batch_pages": _pages("run_id, repo_id", OF_RUNS),
    "scan_users": "SELECT * FROM users",
    "count_rows": "SELECT count(*) AS n_rows FROM commits",
    "lookup_user_by_id": "SELECT * FROM users WHERE user_id IN (SELECT opened_by FROM pull_requests)",
    "user_exists": """SELECT user_id, user_id IN (SELECT user_id FROM users) AS found
        FROM (SELECT DISTINCT author_id * 2 AS user_id FROM commits)""",
    "query_by_example": """SELECT commit_id, repo_id, sha1, author_id FROM commits
        WHERE NOT is_merge_commit AND commit_message = '1-URGENT'""",
    "upsert_rows": """SELECT * FROM users WHERE NOT excluded
        UNION ALL SELECT user_id, upper(name), email, FALSE FROM users WHERE excluded
        UNION ALL SELECT repo_id + 10000000, repository_name, NULL, TRUE FROM many_repositories""",
    "delete_rows": "SELECT * FROM users WHERE NOT excluded",
    "delete_all_rows": "SELECT * FROM users WHERE FALSE",
    "list_repositories": """SELECT repo_id, repository_name, organisation_name,
        organisation_name || ' -- ' || repository_name AS display_text FROM many_repositories""",
    "filter_repos_by_prefix": """SELECT repository_name AS name, organisation_name AS owner FROM many_repositories
        WHERE starts_with(repository_name, 'Supplier#00000')""",
    "ingest_repositories": """SELECT repository_name, organisation_name FROM many_repositories
        WHERE starts_with(repository_name, 'Supplier#00000') AND repo_id % 3 <> 0""",
    "stamp_repositories": """SELECT repo_id, repository_name, organisation_name,
        CASE WHEN starts_with(repository_name, 'Supplier#00000') THEN TIMESTAMP '2024-05-01 10:00:00' END
            AS last_fetched_at FROM many_repositories""",
    "ingest_commits": """SELECT r.repo_id, r.sha1, r.author_name, r.author_email, r.committer_name, r.committer_email,
        r.commit_message, r.commit_date, c.is_merge_commit, c.parent,
        CAST(coalesce(f.a, 0) AS BIGINT) AS lines_added, CAST(coalesce(f.d, 0) AS BIGINT) AS lines_removed,
        CAST(coalesce(f.c, 0) AS BIGINT) AS lines_changed, coalesce(f.n, 0) AS files_changed, c.url
        FROM first_raw r JOIN commits c ON c.sha1 = r.sha1
        LEFT JOIN (SELECT sha1, sum(lines_added) AS a, sum(lines_deleted) AS d, sum(lines_changed) AS c,
            count(*) FILTER (lines_changed <> 0) AS n FROM raw_files GROUP BY sha1) f ON f.sha1 = r.sha1""",
    "ingest_commit_files": """SELECT repo_id, sha1, filename, lines_added, lines_deleted, lines_changed, url, patch
        FROM raw_files""",
    "ingest_pull_requests": f"""SELECT repo_id, number, TIMESTAMP '2024-02-01 08:30:00' AS opened_at,
        CASE WHEN number % 3 <> 0 THEN TIMESTAMP '2024-03-31 22:00:00' END AS closed_at,
        {NAME.format(k='opened_by')} AS opened_by_name, {EMAIL.format(k='opened_by')} AS opened_by_email,
        CASE WHEN merged_by IS NOT NULL THEN {NAME.format(k='merged_by')} END AS merged_by_name,
        CASE WHEN merged_by IS NOT NULL THEN {EMAIL.format(k='merged_by')} END AS merged_by_email,
        title || ' page ' || (SELECT CASE WHEN number % 11 = 3 THEN min(CAST(turn AS VARCHAR)) ELSE CAST(min(turn) AS VARCHAR) END
            FROM conversations WHERE conv_id = number) AS title, body, url
        FROM pull_requests""",
    "ingest_pr_comments": f"""SELECT conv_id % 25 AS repo_id, conv_id AS number,
        CASE WHEN turn % 2 = 0 THEN 'issue' ELSE 'review' END AS kind,
        {NAME.format(k='((conv_id + turn) % 150)')} AS commenter_name,
        CASE WHEN conv_id % 6 <> 0 THEN {EMAIL.format(k='((conv_id + turn) % 150)')} END AS commenter_email,
        text AS comment, TIMESTAMP '2024-03-01 12:00:00' AS created_at FROM conversations""",
    "ingest_users": "SELECT * FROM added_users",
    "ingest_users_weak": """SELECT (SELECT max(user_id) FROM users) + 1 + 4096 * (row_number() OVER (
            PARTITION BY bucket ORDER BY name, email) - 1) + bucket AS user_id, name, email, FALSE AS excluded
        FROM (SELECT name, email, CAST('0x' || substr(md5(name || chr(10) || email), 1, 3) AS BIGINT) AS bucket
            FROM (SELECT min(name) AS name, email FROM people
                WHERE email NOT IN (SELECT email FROM known) GROUP BY email))""",
    "find_new_commits": """SELECT repo_id, sha1, commit_date FROM first_raw
        WHERE (repo_id, sha1) NOT IN (SELECT (repo_id, sha1) FROM stored)""",
    "find_new_pull_requests": """SELECT repo_id, number, title || ' page '
        || (SELECT CASE WHEN number % 11 = 3 THEN min(CAST(turn AS VARCHAR)) ELSE CAST(min(turn) AS VARCHAR) END
            FROM conversations WHERE conv_id = number) AS title
        FROM pull_requests WHERE merged_by IS NULL""",
    "commits_since_high_water_mark": """SELECT r.repo_id, r.seq, r.sha1, r.commit_date FROM raw r
        LEFT JOIN marks m ON m.repo_id = r.repo_id WHERE m.mark IS NULL OR r.commit_date IS NULL OR r.commit_date >= m.mark""",
    "incremental_new_commits": """SELECT r.repo_id, r.sha1, r.seq, r.commit_date FROM first_raw r
        LEFT JOIN marks m ON m.repo_id = r.repo_id WHERE (m.mark IS NULL OR r.commit_date IS NULL OR r.commit_date >= m.mark)
        AND (r.repo_id, r.sha1) NOT IN (SELECT (repo_id, sha1) FROM stored)""",
    "incremental_store": """SELECT repo_id, sha1, commit_date FROM stored
        UNION ALL SELECT r.repo_id, r.sha1, r.commit_date FROM first_raw r
        LEFT JOIN marks m ON m.repo_id = r.repo_id WHERE (m.mark IS NULL OR r.commit_date IS NULL OR r.commit_date >= m.mark)
        AND (r.repo_id, r.sha1) NOT IN (SELECT (repo_id, sha1) FROM stored)""",
    "incremental_marks": """SELECT repo_id, max(commit_date) AS mark FROM (
            SELECT repo_id, commit_date FROM stored UNION ALL SELECT repo_id, commit_date FROM first_raw)
        GROUP BY repo_id""",
    "fetched_new_repositories": """SELECT repository_name, organisation_name FROM many_repositories
        WHERE starts_with(repository_name, 'Supplier#00000') AND repo_id % 3 <> 0""",
    "fetched_stamps": """SELECT repo_id, repository_name, organisation_name,
        CASE WHEN starts_with(repository_name, 'Supplier#00000') THEN TIMESTAMP '2024-05-01 10:00:00' END AS last_fetched_at
        FROM many_repositories WHERE repo_id % 3 = 0""",
    "fetched_commits": """SELECT repo_id, sha1, author_id, committer_id, commit_date, lines_added FROM fetched
        WHERE commit_message IS NOT NULL""",
    "fetched_refused": "SELECT repo_id, sha1, 'no message' AS problem FROM fetched WHERE commit_message IS NULL",
    "fetched_line_totals": """SELECT f.repo_id, f.sha1, CAST(coalesce(sum(r.lines_added), 0) AS BIGINT) AS lines_added,
            CAST(coalesce(sum(r.lines_deleted), 0) AS BIGINT) AS lines_removed,
            CAST(coalesce(sum(r.lines_changed), 0) AS BIGINT) AS lines_changed,
            count(*) FILTER (r.lines_added <> 0 OR r.lines_deleted <> 0 OR r.lines_changed <> 0) AS files_changed
        FROM fetched f LEFT JOIN raw_files r ON r.sha1 = f.sha1 WHERE f.commit_message IS NOT NULL GROUP BY f.repo_id, f.sha1""",
    "fetched_members": f"""WITH somebody AS (
            SELECT repo_id, author_id AS user_id FROM fetched WHERE commit_message IS NOT NULL
            UNION SELECT p.repo_id, e.user_id FROM pull_requests p JOIN everyone e
                ON e.name = {NAME.format(k='opened_by')} AND e.email = {EMAIL.format(k='opened_by')} WHERE p.merged_by IS NULL
            UNION SELECT c.conv_id % 25, e.user_id FROM conversations c JOIN everyone e
                ON e.name = {NAME.format(k='((conv_id + turn) % 150)')}
                AND e.email = CASE WHEN conv_id % 6 <> 0 THEN {EMAIL.format(k='((conv_id + turn) % 150)')}
                    ELSE {NAME.format(k='((conv_id + turn) % 150)')} || '@example.edu' END WHERE conv_id % 3 = 0)
        SELECT s.repo_id, u.user_id, u.name, u.email FROM somebody s JOIN (SELECT user_id, name, email, excluded FROM users
            UNION ALL SELECT user_id, name, email, excluded FROM added_users) u ON u.user_id = s.user_id AND NOT u.excluded""",
    "fetched_comments": f"""SELECT conv_id % 25 AS repo_id, conv_id AS number,
        CASE WHEN turn % 2 = 0 THEN 'issue' ELSE 'review' END AS kind, e.user_id AS commenter_id, text AS comment
        FROM conversations LEFT JOIN everyone e ON e.name = {NAME.format(k='((conv_id + turn) % 150)')}
            AND e.email = CASE WHEN conv_id % 6 <> 0 THEN {EMAIL.format(k='((conv_id + turn) % 150)')}
                ELSE {NAME.format(k='((conv_id + turn) % 150)')} || '@example.edu' END
        WHERE conv_id % 3 = 0""",
    "stream_ingest_commits": """SELECT repo_id, sha1, commit_id * 10 + 1 AS seq, author_id, commit_date FROM commits""",
    "filter_single_parent_commits": "SELECT commit_id, repo_id, sha1, parent FROM covered",
    "filter_date_window": """SELECT commit_id, repo_id, commit_date FROM commits
        WHERE commit_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'""",
    "filter_java_files": "SELECT commit_id, filename FROM changes WHERE filename LIKE '%java'",
    "filter_gui_files": """SELECT commit_id, filename FROM changes
        WHERE filename NOT LIKE '%ui%' AND filename NOT LIKE '%view%'""",
    "filter_modified_files": """SELECT commit_id, filename, lines_changed FROM changes
        WHERE lines_added <> 0 OR lines_deleted <> 0 OR lines_changed <> 0""",
    "filter_excluded_users": """SELECT commit_id, repo_id, author_id FROM commits
        WHERE author_id IN (SELECT user_id FROM users WHERE NOT excluded)""",
    "find_commits_by_author": """SELECT commit_id, sha1, author_id FROM commits
        WHERE author_id IN (SELECT user_id FROM users WHERE contains(email, 'noreply'))""",
    "validate_commits": """SELECT commit_id, CASE
        WHEN commit_id % 11 = 0 AND committer_id IS NULL THEN 'no author or committer'
        WHEN commit_id % 17 = 0 THEN 'no message' END AS problem FROM commits""",
    "display_commits": f"SELECT repo_id, sha1, {DISPLAY} FROM commits",
    "commit_parent_fields": "SELECT commit_id, repo_id, sha1, is_merge_commit, parent FROM commits",
    "join_repository_commits": """SELECT repository_name, organisation_name, commit_id, sha1
        FROM repositories JOIN commits USING (repo_id)""",
    "join_commit_files": """SELECT c.commit_id, c.repo_id, f.filename
        FROM commits c LEFT JOIN changes f ON c.commit_id = f.commit_id""",
    "join_commit_parent": """SELECT c.commit_id, c.repo_id, p.commit_id AS parent_commit_id,
        p.author_id AS parent_author_id, p.commit_date AS parent_date
        FROM commits c LEFT JOIN commits p ON p.repo_id = c.repo_id AND p.sha1 = c.parent""",
    "join_commit_author": """SELECT c.commit_id, c.author_id, u.name, u.email, u.excluded
        FROM commits c JOIN users u ON u.user_id = c.author_id""",
    "commit_line_totals": """SELECT c.commit_id, CAST(coalesce(sum(f.lines_added), 0) AS BIGINT) AS lines_added,
        CAST(coalesce(sum(f.lines_deleted), 0) AS BIGINT) AS lines_removed,
        CAST(coalesce(sum(f.lines_changed), 0) AS BIGINT) AS lines_changed,
        count(*) FILTER (f.lines_added <> 0 OR f.lines_deleted <> 0 OR f.lines_changed <> 0) AS files_changed
        FROM commits c LEFT JOIN changes f ON c.commit_id = f.commit_id GROUP BY c.commit_id""",
    "commit_files_changed": """SELECT c.commit_id, count(f.commit_id) AS files_changed
        FROM commits c LEFT JOIN (SELECT commit_id FROM changes WHERE lines_changed <> 0) f
        ON c.commit_id = f.commit_id GROUP BY c.commit_id""",
    "commit_branches": "SELECT DISTINCT repo_id, sha1, branch FROM sightings",
    "commit_branch_counts": """SELECT repo_id, sha1, count(DISTINCT branch) AS n_branches, min(branch) AS first_branch,
        max(branch) AS last_branch FROM sightings GROUP BY repo_id, sha1""",
    "repository_branches": "SELECT DISTINCT repo_id, branch FROM sightings",
    "dedupe_commits_first_seen": """SELECT repo_id, sha1, seq, commit_message, commit_date FROM raw
        QUALIFY row_number() OVER (PARTITION BY repo_id, sha1 ORDER BY seq NULLS LAST, commit_message) = 1""",
    "latest_commit_per_repo": """SELECT repo_id, commit_id, sha1, commit_date FROM commits
        QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY commit_date DESC, sha1 DESC) = 1""",
    "commits_newest_first": "SELECT repo_id, sha1, commit_date FROM commits ORDER BY commit_date DESC, repo_id, sha1",
    "commit_calendar": f"SELECT repo_id, CAST(commit_date AS DATE) AS day, sha1, {DISPLAY} FROM commits",
    "commit_calendar_days": """SELECT repo_id, CAST(commit_date AS DATE) AS day, count(*) AS n_commits,
        CAST(sum(lines_added) AS BIGINT) AS lines_added, CAST(sum(lines_removed) AS BIGINT) AS lines_removed,
        CAST(sum(lines_changed) AS BIGINT) AS lines_changed FROM commits GROUP BY ALL""",
    "user_commit_lists": f"SELECT repo_id, author_id, sha1, {DISPLAY} FROM covered",
    "search_users": """SELECT * FROM users WHERE contains(name, '00042') OR contains(email, '00042')
        UNION ALL SELECT * FROM users WHERE contains(lower(email), 'noreply')""",
    "list_excluded_users": "SELECT * FROM users WHERE excluded",
    "find_user_by_name_email": """SELECT * FROM users u WHERE EXISTS (SELECT 1 FROM commit_people p
        WHERE p.name = u.name AND p.email IS NOT DISTINCT FROM u.email)""",
    "user_label": """SELECT user_id, CASE WHEN user_id % 9 = 0 THEN 'Overall' ELSE name || ' (' || email || ')' END
        AS label FROM users""",
    "fill_default_email": "SELECT name, coalesce(email, name || '@example.edu') AS email FROM commit_people",
    "set_user_excluded": """SELECT user_id, name, email, CASE WHEN user_id IN (SELECT opened_by FROM pull_requests)
        THEN FALSE WHEN contains(email, 'noreply') THEN TRUE ELSE excluded END AS excluded FROM users""",
    "create_users": """SELECT * FROM users UNION ALL
        SELECT (SELECT max(user_id) FROM users) + 1 + 4096 * (row_number() OVER (PARTITION BY bucket ORDER BY name) - 1)
            + bucket, name, NULL, excluded
        FROM (SELECT repository_name AS name, repo_id % 2 = 0 AS excluded,
            CAST('0x' || substr(md5(repository_name), 1, 3) AS BIGINT) AS bucket FROM many_repositories)""",
    "resolve_users_strict": """SELECT p.name, coalesce(p.email, p.name || '@example.edu') AS email, k.user_id
        FROM commit_people p LEFT JOIN known k
        ON k.name = p.name AND k.email = coalesce(p.email, p.name || '@example.edu')""",
    "resolve_users_weak": """SELECT p.name, coalesce(p.email, p.name || '@example.edu') AS email, k.user_id
        FROM commit_people p LEFT JOIN (SELECT email, min(user_id) AS user_id FROM known GROUP BY email) k
        ON k.email = coalesce(p.email, p.name || '@example.edu')""",
    "remap_users": """SELECT commit_id, coalesce(new_user_id, author_id) AS author_id, committer_id
        FROM commits LEFT JOIN mapping ON old_user_id = author_id""",
    "remap_comment_users": """SELECT pr_id, comment_no, coalesce(new_user_id, commenter_id) AS commenter_id
        FROM pr_comments LEFT JOIN mapping ON old_user_id = commenter_id""",
    "remap_pull_request_users": """SELECT pr_id, coalesce(a.new_user_id, opened_by) AS opened_by,
        coalesce(b.new_user_id, merged_by) AS merged_by FROM pull_requests
        LEFT JOIN mapping a ON a.old_user_id = opened_by LEFT JOIN mapping b ON b.old_user_id = merged_by""",
    "remap_problems": """WITH m AS (SELECT * FROM mapping UNION ALL
            SELECT user_id, user_id + 1 FROM users WHERE excluded)
        SELECT old_user_id, 'replaced more than once' AS problem FROM m GROUP BY old_user_id HAVING count(*) > 1
        UNION SELECT old_user_id, 'new user is replaced too' FROM m
            WHERE new_user_id IN (SELECT old_user_id FROM m)""",
    "user_alias_groups": """SELECT email, user_id, name, n_names FROM users JOIN
        (SELECT email, count(DISTINCT name) AS n_names FROM users GROUP BY email HAVING count(DISTINCT name) > 1)
        USING (email)""",
    "find_prs_by_opener": """SELECT pr_id, repo_id, opened_by FROM pull_requests
        WHERE opened_by IN (SELECT user_id FROM users WHERE excluded)""",
    "find_prs_by_merger": """SELECT pr_id, repo_id, merged_by FROM pull_requests
        WHERE merged_by IN (SELECT user_id FROM users WHERE excluded)""",
    "find_comments_by_user": """SELECT * FROM pr_comments
        WHERE commenter_id IN (SELECT user_id FROM users WHERE excluded)""",
    "display_pull_requests": """SELECT repository_name, number, title, body, url
        FROM pull_requests JOIN repositories USING (repo_id)""",
    "repository_members": """SELECT m.repo_id, m.user_id, u.name, u.email FROM (
            SELECT repo_id, author_id AS user_id FROM commits UNION SELECT repo_id, opened_by FROM pull_requests
            UNION SELECT repo_id, commenter_id FROM pr_comments JOIN pull_requests USING (pr_id)) m
        JOIN users u ON u.user_id = m.user_id WHERE NOT u.excluded""",
    "users_outside_team": "SELECT * FROM outside",
    "repos_without_team": """SELECT repo_id, repository_name,
        'Members of ' || repository_name || ' were not checked: no team is known' AS reason
        FROM repositories WHERE repo_id NOT IN (SELECT repo_id FROM teams)""",
    "repos_with_duplicate_users": """SELECT repo_id, repository_name FROM repositories
        WHERE repo_id IN (SELECT repo_id FROM outside)""",
    "fetch_report": """SELECT 'fetched' AS kind, NULL AS repository_name, CAST(count(*) AS VARCHAR) AS detail
            FROM repositories
        UNION ALL SELECT 'duplicate users', repository_name, NULL FROM repositories
            WHERE repo_id IN (SELECT repo_id FROM outside)
        UNION ALL SELECT 'unable to check', repository_name,
            'Members of ' || repository_name || ' were not checked: no team is known'
            FROM repositories WHERE repo_id NOT IN (SELECT repo_id FROM teams)""",
    "filter_deletions": "SELECT commit_id, filename, change_op, entity_type FROM changes WHERE change_op <> 'DELETE'",
    "score_changes": "SELECT commit_id, filename, change_op, entity_type, score FROM scored",
    "categorise_changes": "SELECT commit_id, filename, entity_type, category FROM scored",
    "file_base_name": "SELECT commit_id, file FROM scored",
    "file_change_scores": """SELECT commit_id, filename, CAST(sum(score) AS BIGINT) AS score,
        count(*) FILTER (change_op <> 'DELETE') AS n_changes FROM source GROUP BY ALL""",
    "filter_nonzero_files": """SELECT commit_id, filename, CAST(sum(score) AS BIGINT) AS score,
        count(*) FILTER (change_op <> 'DELETE') AS n_changes FROM source GROUP BY commit_id, filename
        HAVING sum(score) <> 0""",
    "files_by_name": """SELECT repo_id, file, CAST(sum(score) AS BIGINT) AS score FROM authored
        GROUP BY repo_id, file ORDER BY repo_id, file""",
    "commit_scores": """SELECT c.commit_id, c.repo_id, c.author_id AS user_id,
        CAST(coalesce(sum(s.score), 0) AS BIGINT) AS score, count(*) FILTER (s.change_op <> 'DELETE') AS n_changes
        FROM covered c LEFT JOIN source s ON c.commit_id = s.commit_id GROUP BY ALL""",
    "user_scores": "SELECT * FROM per_user",
    "user_score_percent": "SELECT * FROM percents",
    "format_percent": """SELECT repo_id, user_id, CASE WHEN percent < 1 THEN '<1' WHEN percent IS NOT NULL
        THEN printf('%.2f', percent) END AS percent_text FROM percents""",
    "user_category_counts": """SELECT repo_id, user_id, category, change_op, CAST(sum(score) AS BIGINT) AS score,
        count(*) AS n_changes FROM authored WHERE change_op <> 'DELETE' GROUP BY ALL""",
    "user_file_category_counts": """SELECT repo_id, user_id, filename, category, change_op,
        CAST(sum(score) AS BIGINT) AS score, count(*) AS n_changes FROM authored WHERE change_op <> 'DELETE' GROUP BY ALL""",
    "summary_all_levels": """SELECT CASE WHEN grouping(category) = 1 THEN 1 WHEN grouping(filename) = 1 THEN 2 ELSE 3 END
            AS level, repo_id, user_id, filename, category, CAST(sum(score) AS BIGINT) AS score, count(*) AS n_changes
        FROM authored WHERE change_op <> 'DELETE'
        GROUP BY GROUPING SETS ((repo_id, user_id), (repo_id, user_id, category), (repo_id, user_id, filename, category))""",
    "file_user_shares": "SELECT * FROM shares",
    "file_user_matrix": "SELECT * FROM matrix",
    "file_user_chart": """SELECT repo_id, file, coalesce(sum(share) FILTER (user_id = 1), 0.0) AS user_1,
        coalesce(sum(share) FILTER (user_id = 2), 0.0) AS user_2, coalesce(sum(share) FILTER (user_id = 4), 0.0) AS user_4
        FROM matrix WHERE file IS NOT NULL GROUP BY repo_id, file""",
    "attach_user_commits": """SELECT p.repo_id, p.user_id, p.score, p.percent, c.sha1, c.commit_date, c.commit_message, c.url
        FROM percents p LEFT JOIN covered c ON c.repo_id = p.repo_id AND c.author_id = p.user_id""",
    "window_score_percent": """WITH s AS (SELECT c.repo_id, c.author_id AS user_id,
            CAST(sum(coalesce(j.score, 0)) AS BIGINT) AS score
            FROM covered c JOIN users u ON u.user_id = c.author_id AND NOT u.excluded
            LEFT JOIN java j ON j.commit_id = c.commit_id
            WHERE c.commit_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY ALL)
        SELECT repo_id, user_id, score, CAST(100 * score AS DOUBLE)
            / NULLIF(CAST(sum(score) OVER (PARTITION BY repo_id) AS DOUBLE), 0) AS percent FROM s""",
    "read_batch_config": """SELECT CAST(0 AS INT) AS run_id, 'COURSE' AS organisation, repo_id % 2 = 0 AS exact_match,
            repository_name AS name, repo_id % 3 = 1 AS exclude_gui,
            CASE WHEN repo_id % 5 = 0 THEN '1996-01-01T00:00:00Z' END AS start_date,
            CASE WHEN repo_id % 5 = 0 THEN '1998-12-31T00:00:00Z' END AS end_date FROM many_repositories
        UNION ALL SELECT 1, 'COURSE', FALSE, substr(repository_name, 1, 12), FALSE, NULL, NULL FROM many_repositories""",
    "match_batch_repositories": "SELECT * FROM matched",
    "unmatched_exact_matchers": "SELECT * FROM unmatched",
    "batch_report": """SELECT run_id, repository_name, 'succeeded' AS status, NULL AS reason FROM matched
        UNION ALL SELECT run_id, name, 'failed', 'Repository not found' FROM unmatched
        UNION ALL SELECT run_id, name, 'failed', reason FROM refused""",
    "batch_report_counts": """SELECT status, count(*) AS n_runs, count(DISTINCT name) AS n_repositories
        FROM (SELECT 'succeeded' AS status, repository_name AS name FROM matched
            UNION ALL SELECT 'failed', name FROM unmatched UNION ALL SELECT 'failed', name FROM refused) GROUP BY status""",
    "batch_user_percent": """WITH s AS (SELECT r.run_id, r.repo_id, r.user_id,
            CAST(sum(coalesce(j.score, 0)) AS BIGINT) AS score
            FROM run_commits r JOIN users u ON u.user_id = r.user_id AND NOT u.excluded
            LEFT JOIN java j ON j.commit_id = r.commit_id
                AND NOT (r.exclude_gui AND (j.filename LIKE '%ui%' OR j.filename LIKE '%view%')) GROUP BY ALL)
        SELECT run_id, repo_id, user_id, score, CAST(100 * score AS DOUBLE)
            / NULLIF(CAST(sum(score) OVER (PARTITION BY run_id, repo_id) AS DOUBLE), 0) AS percent FROM s""",
    "batch_file_shares": """SELECT run_id, repo_id, file, user_id, score, CAST(score AS DOUBLE)
            / NULLIF(CAST(sum(score) OVER (PARTITION BY run_id, repo_id, file) AS DOUBLE), 0) AS share
        FROM (SELECT run_id, repo_id, file, user_id, CAST(sum(score) AS BIGINT) AS score FROM run_changes GROUP BY ALL)""",
    "pair_file_revisions": f"""WITH t AS (SELECT o_orderkey AS k, {STORE_TEXT} AS text FROM orders WHERE o_orderkey % 10 <> 9)
        SELECT p.repo_id, p.sha1, p.filename, coalesce(o.text, '') AS old_text, coalesce(n.text, '') AS new_text
        FROM pairs p LEFT JOIN t n ON n.k = p.k LEFT JOIN t o ON o.k = p.old_k""",
    "extract_entities": f"SELECT {ENTITY}, lacks_constructor FROM entities",
    "filter_boilerplate_methods": f"SELECT {ENTITY} FROM entities WHERE method IS DISTINCT FROM 'getName()'",
    "synthesise_nested_constructor": """SELECT repo_id, sha1, filename, entity_type, unique_name, owner FROM entities
        UNION ALL SELECT repo_id, sha1, filename, 'METHOD', 'Store.Part.Part()', 'Store.Part' FROM entities
            WHERE lacks_constructor
        UNION ALL SELECT repo_id, sha1, filename, 'CONSTRUCTOR_INVOCATION', 'super();', 'Store.Part.Part()' FROM entities
            WHERE lacks_constructor""",
    "diff_entities": """SELECT repo_id, sha1, filename, change_op, entity_type, unique_name, parent_name
        FROM text_changes""",
    "quarantine_failed_files": f"""SELECT repo_id, sha1, filename, CAST(1 AS INT) AS side, {UNREADABLE} AS error
            FROM pairs WHERE k % 50 = 7
        UNION ALL SELECT repo_id, sha1, filename, -1, {UNREADABLE} FROM pairs WHERE old_k % 50 = 7""",
    "diff_revision_lines": f"""SELECT doc_id, line, CASE WHEN sum(side) > 0 THEN 'INSERT' ELSE 'DELETE' END AS change_op,
        CAST(abs(sum(side)) AS BIGINT) AS n_lines FROM (
            {LINES.format(key='doc_id', side='1')} UNION ALL {LINES.format(key='doc_id + 1', side='-1')})
        WHERE line <> '' AND doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id, line HAVING sum(side) <> 0""",
    "score_percent_from_texts": """WITH s AS (SELECT c.repo_id, c.author_id AS user_id, CAST(sum(CASE
            WHEN t.k IS NULL OR t.change_op = 'DELETE' THEN 0 WHEN t.entity_type = 'CLASS' THEN 100
            WHEN t.entity_type = 'METHOD' THEN 25 WHEN t.entity_type = 'FIELD' THEN 10
            WHEN t.entity_type = 'JAVADOC' THEN 1 ELSE 3 END) AS BIGINT) AS score
            FROM covered c JOIN users u ON u.user_id = c.author_id AND NOT u.excluded
            LEFT JOIN text_changes t ON t.k = c.commit_id GROUP BY ALL)
        SELECT repo_id, user_id, score, CAST(100 * score AS DOUBLE)
            / NULLIF(CAST(sum(score) OVER (PARTITION BY repo_id) AS DOUBLE), 0) AS percent FROM s""",
}


def with_views(sql: str) -> str:
    """The statement after the views it uses, each stated before it is read."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(VIEWS[name])
                used.append(name)

    need(sql)
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    if not views:
        return sql
    own = re.match(r"\s*WITH\s+", sql)
    return f"WITH {views}, {sql[own.end():]}" if own else f"WITH {views} {sql}"


def all_oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLES.items()}
