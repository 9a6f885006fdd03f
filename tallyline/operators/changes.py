"""Typed changes from file revisions.

Texts travel on one row with their file; an Arrow step lists the declarations
and statements of a text, and the comparison runs in Spark over all files at
once. Files are filtered before any text is read.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructType

from ..functions import columns as C
from ..functions import java_source
from ..schemas import FLAG, TEXT, struct
from ..session import stored

# The methods that are never credited, by signature.
NAMED_BOILERPLATE = r"^(hashCode|equals)\("
GETTER = r"^get[a-zA-Z0-9]*\(\)$"
SETTER = r"^set[a-zA-Z0-9]*\([^,]*\)$"

ENTITY = struct(
    ordinal=IntegerType(),
    entity_type=TEXT,
    unique_name=TEXT,
    owner=TEXT,
    method=TEXT,
    method_statements=IntegerType(),
    method_first=TEXT,
    lacks_constructor=FLAG,
)
FIELDS = tuple(ENTITY.names)
SHAPE = struct(form=TEXT, lead=TEXT, tail=TEXT, assigns=FLAG, declares=FLAG)
# What the reader gives for each entity; kinds are told from shapes by column expressions.
READ = struct(
    ordinal=IntegerType(),
    shape=SHAPE,
    unique_name=TEXT,
    owner=TEXT,
    method=TEXT,
    method_statements=IntegerType(),
    first_shape=SHAPE,
    lacks_constructor=FLAG,
)
PAIR = ["repo_id", "sha1", "filename"]
SLICE = 256  # texts whose entities are held at once
KEPT = 256  # texts whose entities are remembered: copies, and the two sides of one revision

# The helper travels with the task, so executors need not have this package installed.
for module in (java_source, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(module)


def pair_file_revisions(files: DataFrame, revisions: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Each changed file with its text before and after; a missing text is empty.

    ``files`` has repo_id, sha1, parent and filename, and the columns of the
    commit that ``carry`` names. Both texts are looked up
    under the new name, so a renamed file has no old text. Texts are too bulky to
    broadcast, and the merge join leaves them spread for the step that reads them.
    """
    new = revisions.select(*PAIR, F.col("text").alias("new_text"))
    old = revisions.select(
        "repo_id", F.col("sha1").alias("parent"), "filename", F.col("text").alias("old_text")
    )
    return (
        files.groupBy(*PAIR)
        .agg(*(F.min(name).alias(name) for name in ("parent", *carry)))
        .join(new.hint("merge"), PAIR, "left")
        .join(old.hint("merge"), ["repo_id", "parent", "filename"], "left")
        .select(
            *PAIR,
            *carry,
            F.coalesce("old_text", F.lit("")).alias("old_text"),
            F.coalesce("new_text", F.lit("")).alias("new_text"),
        )
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of texts spread by all of the row before the texts are read.

    So neither the files they come from, nor merged shuffle partitions, nor a key
    with many texts decide how many tasks read them.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, F.xxhash64(*rows.columns))


def may_change(old: list[tuple], new: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """The entities of both sides without those that are equal, as often, on either.

    An owner and name stays as a whole or goes as a whole, whatever its kinds; classes
    without constructor stay, and whatever has the names of the two that they imply. So
    what goes cancels out in ``diff_entities`` and decides nothing there.
    """
    befores, afters = [entity[1:] for entity in old], [entity[1:] for entity in new]
    before, after = set(befores), set(afters)
    if len(before) == len(befores) and len(after) == len(afters):
        stay = before ^ after
    else:
        before, after = Counter(befores), Counter(afters)
        stay = {entity for entity in before.keys() | after.keys() if before[entity] != after[entity]}
    named = {entity[1:3] for entity in stay}
    for entity in afters + befores:
        if entity[-1]:
            name = f"{entity[1]}.{entity[1].rpartition('.')[2]}()"
            named |= {entity[1:3], ("super();", name), (name, entity[1])}
    return [entity for entity in old if entity[2:4] in named], [entity for entity in new if entity[2:4] in named]


def scan_texts(
    rows: DataFrame, keys: list[str], texts: dict[str, int], errors_only: bool = False, whole: str | None = None
) -> DataFrame:
    """One row per entity of every text column, marked with the column's ``side``.

    A row with an unreadable text gives no entities but one row per such text,
    with the reason in ``error``; with ``errors_only`` there are no other rows. Output leaves the task in small batches, so a
    task never holds the entities of more than a few hundred texts. ``whole`` names a column of rows
    that give all their entities; of two texts the others give those that ``may_change``.
    """
    fields = [rows.schema[key] for key in keys]
    schema = StructType([*fields, *struct(side=IntegerType(), error=TEXT), *READ])
    arrow = to_arrow_schema(schema)
    listed_in = java_source.unreadable if errors_only else java_source.listed

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=KEPT)
        def scanned(text: str) -> tuple[str | None, list[tuple]]:
            try:
                return None, listed_in(text)
            except java_source.SourceError as problem:  # one unreadable text must not stop the others
                return str(problem), []

        nothing = (None,) * len(READ)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                columns = [(side, part.column(name).to_pylist()) for name, side in texts.items()]
                every = part.column(whole).to_pylist() if whole else None
                at, out = [], []
                for row in range(part.num_rows):
                    found = [(side, *scanned(column[row])) for side, column in columns]
                    if any(error is not None for _, error, _ in found):
                        new = [(side, error, *nothing) for side, error, _ in found if error is not None]
                    else:
                        if every and not every[row]:
                            (old_side, _, old), (new_side, _, now) = found
                            old, now = may_change(old, now)
                            found = [(old_side, None, old), (new_side, None, now)]
                        new = [(side, None, *entity) for side, _, listed in found for entity in listed]
                    at += [row] * len(new)
                    out += new
                taken = part.select(keys).take(pa.array(at, pa.int64()))
                values = zip(*out) if out else [[] for _ in arrow.names[len(keys) :]]
                made = [column_of(column, arrow.field(len(keys) + n).type) for n, column in enumerate(values)]
                yield pa.RecordBatch.from_arrays([*taken.columns, *made], schema=arrow)

    return rows.select(*keys, *texts, *([whole] if whole else [])).mapInArrow(read, schema).select(
        *keys,
        "side",
        "error",
        "ordinal",
        C.entity_type(F.col("shape")).alias("entity_type"),
        "unique_name",
        "owner",
        "method",
        "method_statements",
        C.entity_type(F.col("first_shape")).alias("method_first"),
        "lacks_constructor",
    )


def column_of(values: Sequence, kind: pa.DataType) -> pa.Array:
    """An Arrow column; shapes are tuples, or None, and each different one is converted once."""
    if not pa.types.is_struct(kind):
        return pa.array(values, kind)
    numbers: dict[tuple | None, int] = {}
    at = [numbers.setdefault(value, len(numbers)) for value in values]
    shapes = pa.array([None if value is None else dict(zip(SHAPE.names, value)) for value in numbers], kind)
    return shapes.take(pa.array(at, pa.int64()))


def _with_constructors(entity: Column) -> Column:
    """The entity, and for a nested class without constructor the two it implies."""
    name = F.concat(
        entity["unique_name"], F.lit("."), F.substring_index(entity["unique_name"], ".", -1), F.lit("()")
    )

    def implied(entity_type: str, unique_name: Column, owner: Column) -> Column:
        return F.struct(
            entity["ordinal"].alias("ordinal"),
            F.lit(entity_type).alias("entity_type"),
            unique_name.alias("unique_name"),
            owner.alias("owner"),
            F.lit(None).cast("string").alias("method"),
            F.lit(None).cast("int").alias("method_statements"),
            F.lit(None).cast("string").alias("method_first"),
            F.lit(False).alias("lacks_constructor"),
        )

    return F.when(
        entity["lacks_constructor"],
        F.array(
            entity,
            implied("CONSTRUCTOR_INVOCATION", F.lit("super();"), name),
            implied("METHOD", name, entity["unique_name"]),
        ),
    ).otherwise(F.array(entity))


def extract_entities(revisions: DataFrame, text: str = "text") -> DataFrame:
    """The declarations and statements of every readable text, one row each."""
    keys = [name for name in revisions.columns if name != text]
    return scan_texts(dealt(revisions), keys, {text: 1}).where(F.col("error").isNull()).select(*keys, *FIELDS)


def synthesise_nested_constructors(found: DataFrame) -> DataFrame:
    """Adds the constructor and its ``super()`` call that a nested class without one implies."""
    rest = [name for name in found.columns if name not in FIELDS]
    both = F.explode(_with_constructors(F.struct(*FIELDS)))
    return found.select(*rest, both.alias("e")).select(*rest, "e.*")


def _is_boilerplate() -> Column:
    method, single = F.col("method"), F.col("method_statements") == 1
    return F.coalesce(
        method.rlike(NAMED_BOILERPLATE)
        | (method.rlike(GETTER) & single & (F.col("method_first") == "RETURN_STATEMENT"))
        | (method.rlike(SETTER) & single & (F.col("method_first") == "ASSIGNMENT")),
        F.lit(False),
    )


def without_boilerplate(found: DataFrame) -> DataFrame:
    """Drops generated-looking methods and everything inside them.

    Every entity carries the signature, size and first statement of its method,
    so this is a plain filter and needs no shuffle.
    """
    return found.where(~_is_boilerplate())


def scan_pairs(
    pairs: DataFrame, keys: list[str] = PAIR, errors_only: bool = False, whole: str | None = None
) -> DataFrame:
    """Entities of both sides of every pair; ``side`` is +1 for new and -1 for old."""
    return scan_texts(pairs, keys, {"old_text": -1, "new_text": 1}, errors_only, whole)


def quarantine(pairs: DataFrame) -> DataFrame:
    """Texts that cannot be read, with the reason; their files are left out and the rest goes on."""
    return scan_pairs(dealt(pairs), errors_only=True).where(F.col("error").isNotNull()).select(*PAIR, "side", "error")


def readable_entities(pairs: DataFrame, keys: list[str] = PAIR, whole: str | None = None) -> DataFrame:
    """What counts of both sides: no boilerplate, and the constructors nested classes imply."""
    found = scan_pairs(pairs, keys, whole=whole).where(F.col("error").isNull()).drop("error")
    return synthesise_nested_constructors(without_boilerplate(found))


def diff_entities(found: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """Insertions, deletions and updates between the two sides of every file.

    Equal entities cancel out by count. What is left of one owner and type is
    paired in text order: a deletion and an insertion make an update under the
    old name. Both sides of a file are read in one task, so equal entities cancel
    before the shuffle and only what is left crosses it. One more exchange brings a
    group together, which is part of one text, for both windows.
    """
    owner = [*keys, "owner", "entity_type"]
    left_over = (
        found.select(*owner, "unique_name", "side", "ordinal")
        .groupBy(*owner, "unique_name")
        .agg(F.sum("side").alias("n"), F.min("ordinal").alias("ordinal"))
        .where("n != 0")
        .withColumn("sign", F.signum("n").cast("int"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int"))))
        .repartition(*owner)
    )
    ordered = Window.partitionBy(*owner, "sign").orderBy("ordinal", "unique_name", "copy")
    both = Window.partitionBy(*owner)
    counted = (
        left_over.withColumn("nth", F.row_number().over(ordered))
        .withColumn("n_new", F.count_if(F.col("sign") > 0).over(both))
        .withColumn("n_old", F.count_if(F.col("sign") < 0).over(both))
    )
    paired = F.col("nth") <= F.least("n_new", "n_old")
    op = (
        F.when(paired & (F.col("sign") < 0), "UPDATE")
        .when(~paired & (F.col("sign") > 0), "INSERT")
        .when(~paired, "DELETE")
    )
    return (
        counted.withColumn("change_op", op)
        .where(F.col("change_op").isNotNull())
        .select(*keys, "change_op", "entity_type", "unique_name", F.col("owner").alias("parent_name"))
    )


def marked(pairs: DataFrame, keys: list[str] = PAIR) -> DataFrame:
    """The pairs, and in ``whole`` whether another pair has the same keys."""
    again = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    again = stored(again.select(*(F.col(key).alias(f"again_{key}") for key in keys), F.lit(True).alias("whole")))
    if again.isEmpty():
        return pairs.withColumn("whole", F.lit(False))
    same = [F.col(key).eqNullSafe(F.col(f"again_{key}")) for key in keys]
    return pairs.join(again, same, "left").select(*pairs.columns, F.coalesce("whole", F.lit(False)).alias("whole"))


def extract_changes(pairs: DataFrame, keys: list[str] = PAIR, whole: str | None = None) -> DataFrame:
    """From pairs of texts to typed changes; ``keys`` tell one pair from another.

    With ``whole``, the column of ``marked``, what is equal on both sides of a pair goes
    where the texts are read, but for pairs of the same keys, which are compared together.
    """
    return diff_entities(readable_entities(pairs, keys, whole), keys)


def _lines(text: Column) -> Column:
    cleaned = F.transform(F.split(text, "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t\r\f]+", " ")))
    return F.filter(cleaned, lambda line: line != "")


def diff_revision_lines(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Lines added to or removed from each text, as a multiset and without regard to spacing.

    Both sides go through one aggregation by (file, line); repeated lines are
    combined before the shuffle.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit(-1).alias("side"), _lines(F.col("old_text")).alias("lines")),
            F.struct(F.lit(1).alias("side"), _lines(F.col("new_text")).alias("lines")),
        )
    )
    return (
        pairs.select(*keys, sides.alias("s"))
        .select(*keys, "s.side", F.explode("s.lines").alias("line"))
        .groupBy(*keys, "line")
        .agg(F.sum("side").alias("n"))
        .where("n != 0")
        .select(
            *keys,
            "line",
            F.when(F.col("n") > 0, "INSERT").otherwise("DELETE").alias("change_op"),
            F.abs("n").alias("n_lines"),
        )
    )
