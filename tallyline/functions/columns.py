"""Column expressions shared by the operators. All stay inside code generation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points per kind of changed element, and the category each belongs to.
WEIGHTS = {"CLASS": 100, "METHOD": 25, "FIELD": 10, "JAVADOC": 1, "BLOCK_COMMENT": 1, "LINE_COMMENT": 1}
OTHER_WEIGHT = 3
CATEGORIES = {
    "CLASS": "Class",
    "METHOD": "Method",
    "FIELD": "Field",
    "JAVADOC": "Documentation",
    "BLOCK_COMMENT": "Documentation",
    "LINE_COMMENT": "Documentation",
}
OTHER_CATEGORY = "Other"
# What makes a path a Java file, and a Java file a GUI file.
SOURCE_SUFFIX = "java"
GUI_WORDS = ("ui", "view")
ZONED = r"T\d\d:\d\d(:\d\d([.]\d+)?)?(Z|[+-]\d\d:?\d\d)$"


# What a declaration or statement is called, by its form and, for a statement, by the word it leads with.
FORM_TYPES = {
    "javadoc": "JAVADOC",
    "block": "BLOCK_COMMENT",
    "line": "LINE_COMMENT",
    "annotation": "ANNOTATION",
    "field": "FIELD",
    "class": "CLASS",
    "method": "METHOD",
    "then": "THEN_STATEMENT",
    "else": "ELSE_STATEMENT",
    "if": "IF_STATEMENT",
    "case": "SWITCH_CASE",
    "initialiser": "METHOD_INVOCATION",
}
COMPOUND_TYPES = {
    "for": "FOR_STATEMENT",
    "while": "WHILE_STATEMENT",
    "switch": "SWITCH_STATEMENT",
    "catch": "CATCH_CLAUSE",
    "synchronized": "SYNCHRONIZED_STATEMENT",
    "try": "TRY_STATEMENT",
    "do": "DO_STATEMENT",
    "finally": "FINALLY",
}
LEAD_TYPES = {
    "return": "RETURN_STATEMENT",
    "throw": "THROW_STATEMENT",
    "break": "BREAK_STATEMENT",
    "continue": "CONTINUE_STATEMENT",
    "assert": "ASSERT_STATEMENT",
    "this(": "CONSTRUCTOR_INVOCATION",
    "super(": "CONSTRUCTOR_INVOCATION",
    "new": "CLASS_INSTANCE_CREATION",
}


def _choose(column: Column, table: dict[str, object], default: object) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default))


def entity_type(shape: Column) -> Column:
    """The kind of a declaration or statement from its shape: form, lead, tail, assigns, declares. NULL without a form."""
    compound = F.when(shape["declares"], "FOREACH_STATEMENT").otherwise(_choose(shape["lead"], COMPOUND_TYPES, None))
    plain = (
        F.when(shape["lead"].isin(*LEAD_TYPES), _choose(shape["lead"], LEAD_TYPES, None))
        .when(shape["declares"], "VARIABLE_DECLARATION_STATEMENT")
        .when(shape["assigns"], "ASSIGNMENT")
        .when(shape["lead"].isin("++", "--"), "PREFIX_EXPRESSION")
        .when(shape["tail"].isin("++", "--"), "POSTFIX_EXPRESSION")
        .otherwise("METHOD_INVOCATION")
    )
    return (
        F.when(shape["form"] == "compound", compound)
        .when(shape["form"] == "plain", plain)
        .otherwise(_choose(shape["form"], FORM_TYPES, None))
    )


def entity_weight(entity_type: Column, weights: dict[str, int] = WEIGHTS, default: int = OTHER_WEIGHT) -> Column:
    return _choose(entity_type, weights, default)


def entity_category(entity_type: Column) -> Column:
    return _choose(entity_type, CATEGORIES, OTHER_CATEGORY)


def counts(change_op: Column) -> Column:
    """Deletions are not credited."""
    return change_op.isin("INSERT", "UPDATE")


def change_score(change_op: Column, entity_type: Column) -> Column:
    return F.when(counts(change_op), entity_weight(entity_type)).otherwise(F.lit(0))


def is_source_file(filename: Column) -> Column:
    return filename.endswith(SOURCE_SUFFIX)


def is_gui_file(filename: Column) -> Column:
    first, *rest = (filename.contains(word) for word in GUI_WORDS)
    for other in rest:
        first = first | other
    return first


def base_name(filename: Column) -> Column:
    return F.substring_index(filename, "/", -1)


def is_analysable(is_merge_commit: Column, parent: Column) -> Column:
    return ~is_merge_commit & parent.isNotNull()


def is_merge(parents: Column) -> Column:
    return F.size(F.coalesce(parents, F.array().cast("array<string>"))) == 2


def only_parent(parents: Column) -> Column:
    return F.when(F.size(parents) == 1, F.get(parents, F.lit(0)))


def user_label(name: Column, email: Column) -> Column:
    return F.when(name.isNull(), F.lit("Overall")).otherwise(F.format_string("%s (%s)", name, email))


def email_or_default(name: Column, email: Column, domain: str) -> Column:
    return F.coalesce(email, F.concat(name, F.lit("@" + domain)))


def percent_text(value: Column) -> Column:
    """Two decimals, or ``<1``; no text where there is no percentage."""
    return F.when(value < 1, F.lit("<1")).when(value.isNotNull(), F.format_string("%.2f", value))


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def utc_literal(instant: str) -> Column:
    """An ISO-8601 instant as a UTC literal, so that a filter on it reaches the scan."""
    parsed = datetime.fromisoformat(instant.replace("Z", "+00:00"))
    if parsed.tzinfo is None:
        raise ValueError(f"not an instant: {instant}")
    naive = (parsed - parsed.utcoffset()).replace(tzinfo=None)
    return F.lit(naive.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_instant(text: Column) -> Column:
    """An ISO-8601 instant with its zone as a UTC TIMESTAMP_NTZ; NULL where the text is none.

    A text without a zone would mean another instant in every session.
    """
    micros = F.unix_micros(F.try_to_timestamp(F.when(text.rlike(ZONED), text)))
    return F.timestamp_add("MICROSECOND", micros, epoch())


def epoch_seconds(instant: Column) -> Column:
    """Seconds since the epoch of a UTC TIMESTAMP_NTZ."""
    return F.timestamp_diff("MICROSECOND", epoch(), instant) / F.lit(1e6)


def share(part: Column, whole: Column) -> Column:
    """Part of a whole; NULL where the whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))
