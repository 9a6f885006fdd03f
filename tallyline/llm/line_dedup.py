"""Fuzzy line deduplication with column functions only.

Normalised lines get a SimHash of their words, or of their pairs of characters where
spaces are rare. Lines of like size that agree in
two of its five blocks meet (three differing bits spoil three blocks at most), and
are linked if their hashes differ in three bits at most and their edit similarity
is high enough. One occurrence of each connected group of lines stays.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.columns import let, small
from tallyline.llm.components import components
from tallyline.session import shared_dir, stored

RADIUS, BLOCKS = 3, 5
SIMILARITY = 0.9
LEAST_WORDS = 1
WORD_CHARS = 8  # a line of so many characters for each of the least words takes part however few its spaces are
SPARSE = 16  # characters a word from which a line's features are its pairs of characters
LANE_BITS = 16  # bits of a sum, where four share a number
LANE_CHARS = 1 << (LANE_BITS - 1)  # lines of fewer characters have no more features than such a sum can count
COMMON_BITS = 20  # what two lines start or end with alike is found for up to two million characters
PIECE, MARK, LONGEST = 64, 12, 4  # characters of a piece and of the mark that it starts with; pieces that may be compared in one
GRAM = 8
SIZE_BITS = 13
SIZES = (1 << SIZE_BITS) - 1  # sizes from here on count as one
CELLS = 1 << 16  # buckets are counted by cells
HOT, HOT_ROWS = 16, 1000  # a cell of so many times the mean, and so many rows, is hot
SMALL_ROWS = 1_000_000  # ids, of 16 bytes or so each, that may be broadcast
PUNCTUATION = '.,;:!?|"'


def normalised(text: Column) -> Column:
    """Lower case, without punctuation, words apart by one space."""
    out = F.regexp_replace(F.lower(text), f"[{PUNCTUATION}]++", "")
    for mark in ("\t", "\r", "  ", "  "):
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return out


def lines(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """One row for each line of at least ``least_words`` words, or as long as these are: doc, body, n (line, from 0), key, size, plain.

    ``body`` is a hash of the whole text, so that rows of one id, or of none, are told apart.
    """
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = found.select("doc", F.xxhash64("text").alias("body"), F.posexplode(F.split(normalised(F.col("text")), "\n", -1)).alias("n", "line"))
    if least_words > 1:
        # at least so many spaces is cheap to see and leaves out most short lines; then words count
        spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
        counted = (spaces >= least_words - 1) & F.col("line").rlike(r"^\s*+(?:\S++\s++){%d}\S" % (least_words - 1))
        found = found.where(counted | (F.length(F.trim("line")) >= least_words * WORD_CHARS))
    found = found.select("doc", "body", "n", F.trim("line").alias("plain")).where(F.col("plain").rlike(r"\S"))
    return found.select("doc", "body", "n", F.xxhash64("plain").alias("key"), F.length("plain").alias("size"), "plain")


def _majority(found: DataFrame, lanes: int) -> DataFrame:
    """One row for each line: key, size, print (the bits set in over half of its features' hashes).

    A hash's 64 bits are added up ``lanes`` at a time, in equal parts of 64 / ``lanes`` sums.
    """
    width = 64 // lanes
    each = sum(1 << (width * k) for k in range(lanes))
    parts = found.select(F.monotonically_increasing_id().alias("row"), "key", "size", "plain", F.split("plain", " ", -1).alias("parts"))
    pairs = F.regexp_extract_all("plain", F.lit("(?s)(?=(..))"), F.lit(1))
    feature = F.explode(F.when(F.size("parts") * SPARSE < F.col("size"), pairs).otherwise(F.col("parts")))
    words = parts.select("row", "key", "size", feature.alias("word")).where("word <> ''")
    words = words.select("row", "key", "size", F.xxhash64("word").alias("hash"))
    sums = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(F.lit(each).cast("bigint"))).alias(f"s{k}") for k in range(width)]
    summed = words.groupBy("row", "key", "size").agg(F.count("*").alias("words"), *sums)
    # a part holding more than half of the words reaches its last bit but one once what is missing is added to all parts
    top = width - 2 if lanes > 1 else 0
    missing = (F.lit(1 << top) - F.floor(F.col("words") / 2) - 1) * F.lit(each).cast("bigint")
    bits = F.lit(0).cast("bigint")
    for k in range(width):
        if lanes > 1:
            over = F.shiftrightunsigned(F.col(f"s{k}") + missing, top).bitwiseAND(F.lit(each).cast("bigint"))
        else:
            over = (F.col(f"s{k}") * 2 > F.col("words")).cast("bigint")
        bits = bits.bitwiseOR(F.shiftleft(over, k))
    return summed.select("key", "size", bits.alias("print"))


def simhashes(found: DataFrame) -> DataFrame:
    """One row for each distinct line: key, print, size (characters), times. Copies of a line add one narrow row each."""
    each = _majority(found.where(F.col("size") < LANE_CHARS), 64 // LANE_BITS)
    each = each.unionByName(_majority(found.where(F.col("size") >= LANE_CHARS), 1))
    return each.groupBy("key").agg(F.max("print").alias("print"), F.max("size").alias("size"), F.count("*").alias("times"))


def _blocks(print_col: str, blocks: int, radius: int) -> Column:
    """All ways to agree in the blocks that differing bits must leave alone, as numbers for each ``band``."""
    ends = [64 * n // blocks for n in range(blocks + 1)]
    block = [F.shiftrightunsigned(print_col, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) for a, b in itertools.pairwise(ends)]
    chosen = itertools.combinations(block, blocks - radius)
    return F.array(*[F.xxhash64(F.lit(n), "band", *some) for n, some in enumerate(chosen)])


def _bands(similarity: float) -> Column:
    """Octaves of the size, and of the largest size that may be alike: lines alike share one, and few have two."""
    octave = lambda size: F.floor(F.log2(size)).cast("int")
    return F.sequence(octave(F.col("size")), octave(F.col("size") / (similarity - 1e-9)))


def _rank() -> Column:
    # times by powers of two, then size: few bits, as it goes along with every row of a bucket
    weight = F.least(F.floor(F.log2("times")), F.lit(15)).cast("int")
    return F.shiftleft(weight, SIZE_BITS).bitwiseOR(F.least(F.col("size"), F.lit(SIZES)))


def _near(other: str, other_rank: str, radius: int, similarity: float) -> Column:
    """Whether hashes are near, and sizes so that the edit similarity can be high enough; ``SIZES`` or more are one size."""
    a, b = F.col("rank").bitwiseAND(F.lit(SIZES)), F.col(other_rank).bitwiseAND(F.lit(SIZES))
    bits = F.bit_count(F.col("print").bitwiseXOR(F.col(other))) <= radius
    return bits & (F.abs(a - b) <= F.greatest(a, b) * (1 - similarity) + 1e-9)


def _members(keyed: DataFrame) -> DataFrame:
    """The lines of each bucket but its head (the most frequent line), beside the head: bucket, key, print, rank, to, to_print, top, crowd.

    ``crowd`` is whether the bucket holds more than two lines. One exchange and a
    running window find the heads, and buckets of one line go at once. Cells of
    buckets that hold far more rows than others are counted first (less than
    ``CELLS / HOT`` can be hot): there heads come out of an aggregation and are
    joined, so that no bucket has to fit one task.
    """
    cell = F.col("bucket").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = stored(keyed.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows")))
    mean = (counts.agg(F.sum("rows")).first()[0] or 0) / CELLS
    hot = [r.cell for r in counts.where(F.col("rows") > max(HOT * mean, HOT_ROWS)).select("cell").collect()]
    order = Window.partitionBy("bucket").orderBy(F.desc("rank"), "key")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    even = keyed.where(~cell.isin(hot)) if hot else keyed
    heads = [F.first(c).over(so_far).alias(name) for c, name in (("key", "to"), ("print", "to_print"), ("rank", "top"))]
    crowd = (F.count("*").over(so_far) > 2) | F.lead("key").over(order).isNotNull()
    out = even.select("bucket", "key", "print", "rank", *heads, crowd.alias("crowd"))
    if hot:
        many = keyed.where(cell.isin(hot))
        first = F.max(F.struct("rank", "key", "print")).alias("head")
        heads = many.groupBy("bucket").agg(first, F.count("*").alias("rows")).where("rows > 1")
        heads = stored(heads.select("bucket", F.col("head.key").alias("to"), F.col("head.print").alias("to_print"), F.col("head.rank").alias("top"), (F.col("rows") > 2).alias("crowd")))
        out = out.unionByName(many.join(heads, "bucket"))
    return out.where("key <> to")


def near_groups(
    known: DataFrame, found: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, similarity: float = SIMILARITY
) -> DataFrame:
    """Connected groups (node, root) of lines whose ``simhashes`` are near and which are alike.

    In each bucket all lines meet the head first. Lines not linked to it then
    meet those lines of the bucket that are not in their group yet and have a near
    hash, so no link between groups is lost, and no group of near lines gives all
    its pairs.
    """
    keyed = known.select("key", "print", "size", _rank().alias("rank"), F.explode(_bands(similarity)).alias("band"))
    keyed = keyed.select("key", "print", "rank", F.explode(_blocks("print", blocks, radius)).alias("bucket"))
    to_head = _near("to_print", "top", radius, similarity)
    members = stored(_members(keyed).withColumn("near", to_head).where("near or crowd").drop("to_print", "top"))
    direct = stored(_alike(members.where("near").select("key", "to").distinct(), found, similarity))
    groups = stored(components(direct, "key", "to"))
    known_roots = small(groups.withColumnRenamed("node", "key"), SMALL_ROWS)
    met = members.where("crowd").join(known_roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    others = met.select("bucket", "key", "print", "rank", "root")
    apart = met.join(small(direct, SMALL_ROWS), ["key", "to"], "left_anti").select("bucket", *[F.col(c).alias(f"from_{c}") for c in ("key", "print", "rank", "root")])
    near = _near("from_print", "from_rank", radius, similarity) & (F.col("root") != F.col("from_root"))
    pairs = apart.join(others, (apart.bucket == others.bucket) & near)
    pairs = pairs.select(F.greatest("key", "from_key").alias("key"), F.least("key", "from_key").alias("to")).distinct()
    more = stored(_alike(pairs, found, similarity))
    if more.isEmpty():
        return groups
    joined = groups.select(F.col("node").alias("key"), F.col("root").alias("to")).unionByName(more)
    return components(joined, "key", "to")


def _alike(pairs: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Pairs of keys whose lines have at least this edit similarity (1 - edits / length of the longer)."""
    pairs = stored(pairs)
    wanted = pairs.select("key").unionByName(pairs.select(F.col("to").alias("key"))).distinct()
    texts = found.select("key", "plain").join(small(wanted, SMALL_ROWS), "key", "left_semi")
    texts = stored(texts.groupBy("key").agg(F.min("plain").alias("plain")))
    both = pairs.join(texts, "key").join(texts.select(F.col("key").alias("to"), F.col("plain").alias("other")), "to")
    longest = F.greatest(F.length("plain"), F.length("other"))
    most = F.floor(longest * (1 - similarity) + 1e-9).cast("int")
    return both.where(_within(F.col("plain"), F.col("other"), most)).select("key", "to")


def _common(a: Column, b: Column) -> Column:
    """How many characters two strings start with alike, by halving steps."""
    steps = F.array(*[F.lit(1 << n) for n in range(COMMON_BITS, -1, -1)])
    shorter = F.least(F.length(a), F.length(b))

    def longer(at: Column, step: Column) -> Column:
        alike = F.substring(a, at + 1, step) == F.substring(b, at + 1, step)
        return F.when((at + step <= shorter) & alike, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), longer)


def _middle(a: Column, b: Column) -> Column:
    """What lies between what both strings start and end with alike, as a struct of a and b (reversed twice); this needs all the edits."""
    rest = lambda x, n: F.substring(x, n + 1, F.length(x))
    both = let(_common(a, b), lambda n: F.struct(F.reverse(rest(a, n)).alias("a"), F.reverse(rest(b, n)).alias("b")))
    return let(both, lambda x: let(_common(x.a, x.b), lambda n: F.struct(rest(x.a, n).alias("a"), rest(x.b, n).alias("b"))))


def _edits(a: Column, b: Column, most: Column) -> Column:
    """The edits that make one string of the other, -1 if more than ``most``."""
    return F.when(a == b, 0).otherwise(F.call_function("levenshtein", a, b, most))


def _pieced(a: Column, b: Column, most: Column) -> Column:
    """Whether at most so many edits make the pieces of one string those of the other, cut where a mark of ``a`` recurs in ``b``.

    The edits of all pieces are never fewer than those of the strings, and far
    cheaper to count. Where marks are missing for ``LONGEST`` pieces, it is false.
    """
    piece = F.greatest(F.lit(PIECE), F.ceil(F.sqrt(F.length(a))).cast("int"))
    last = F.length(a) - MARK
    marks = lambda size: F.when(last >= size, F.sequence(size, last, size)).otherwise(F.array().cast("array<int>"))
    state = lambda at, to, cost: F.struct(at.alias("at"), to.alias("to"), cost.alias("cost"))
    zero = F.lit(0)

    def cut(now: Column, at: Column, to: Column, size: Column) -> Column:
        """``now`` after the pieces that end at these places; its cost is over ``most`` if theirs is."""
        one, other = F.substring(a, now.at + 1, at - now.at), F.substring(b, now.to + 1, to - now.to)
        over = (at - now.at > size * LONGEST) | (to - now.to > size * LONGEST)
        edits = let(F.struct(one.alias("a"), other.alias("b")), lambda x: _edits(x.a, x.b, most - now.cost))
        return let(F.when(over, -1).otherwise(edits), lambda n: state(at, to, F.when(n < 0, most + 1).otherwise(now.cost + n)))

    def step(now: Column, at: Column, size: Column) -> Column:
        low = F.greatest(now.to, now.to + at - now.at - PIECE // 2)
        place = F.call_function("instr", F.substring(b, low + 1, F.lit(PIECE + MARK)), F.substring(a, at + 1, F.lit(MARK)))
        met = let(F.struct(low.alias("low"), place.alias("place")), lambda x: F.when(x.place > 0, cut(now, at, x.low + x.place - 1, size)).otherwise(now))
        lost = state(at, now.to, most + 1)
        return F.when(now.cost > most, now).when(at - now.at > size * LONGEST, lost).otherwise(met)

    def whole(size: Column) -> Column:
        done = F.aggregate(marks(size), state(zero, zero, zero), lambda now, at: step(now, at, size))
        end = lambda now: F.when(now.cost > most, now).otherwise(cut(now, F.length(a), F.length(b), size))
        return let(done, lambda now: end(now).cost <= most)

    return let(piece, whole)


def _missed(a: Column, b: Column) -> Column:
    """How many of the pieces of ``GRAM`` characters that ``a`` is cut into do not occur in ``b``: each needs an edit of its own."""
    grams = F.regexp_extract_all(a, F.lit("(?s).{%d}" % GRAM), F.lit(0))
    return F.size(F.filter(grams, lambda x: ~F.contains(b, x)))


def _within(a: Column, b: Column, most: Column) -> Column:
    """Whether at most so many edits make one string of the other.

    Two bounds on the edits decide most pairs; for the others the edits are counted.
    """
    exact = let(_middle(a, b), lambda x: F.call_function("levenshtein", x.a, x.b, most) >= 0)
    return F.when(let(most, lambda n: _pieced(a, b, n)), True).when(_missed(a, b) > most, False).otherwise(exact)


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    least_words: int = LEAST_WORDS, radius: int = RADIUS, blocks: int = BLOCKS,
) -> DataFrame:
    """The lines to remove: doc (the id), body (hash of the text), n (line, from 0), class (a key that its group shares).

    The occurrence of the smallest (id, body, n) in a group of equal or near
    lines stays; a null id comes first. Lines are compared whole. Lines of fewer
    than ``least_words`` words, and of fewer than ``WORD_CHARS`` characters for
    each of these, are never removed; with 1 all lines but blank ones take part.
    """
    path = shared_dir(docs.sparkSession)
    lines(docs, id_col, text_col, least_words).write.option("compression", "zstd").parquet(path)
    found = docs.sparkSession.read.parquet(path)
    known = stored(simhashes(found))
    roots = stored(near_groups(known, found, radius, blocks, similarity))
    alone = known.where("times > 1").join(roots, known.key == roots.node, "left_anti")
    groups = roots.select(F.col("node").alias("key"), F.col("root").alias("class"))
    groups = groups.unionByName(alone.select("key", F.col("key").alias("class")))
    met = stored(found.select("doc", "body", "n", "key").join(groups, "key").select("doc", "body", "n", "class"))
    first = stored(met.groupBy("class").agg(F.min(F.struct("doc", "body", "n")).alias("first")))
    here = F.struct("doc", "body", "n").eqNullSafe(F.col("first"))
    return met.join(first, "class").where(~here).select("doc", "body", "n", "class")


def dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_col: str = "n_removed", **settings: float
) -> DataFrame:
    """The documents with their repeated lines taken out of ``text_col``, and how many lines that were.

    What is left of a text keeps its characters, order and line ends. Null texts
    stay null, texts without repeats stay as they are. Rows that share an id, or
    have none, keep lines of their own; rows equal in id and text count as one
    document and lose the same lines. Other columns stay, whatever their names (a
    column named ``n_col`` is replaced); an empty table stays empty.
    """
    gone = repeats(docs, id_col, text_col, **settings)
    gone = stored(gone.groupBy("doc", "body").agg(F.collect_set("n").alias("gone")))
    total = gone.agg(F.sum(F.size("gone") + 4)).first()[0] or 0
    gone = F.broadcast(gone) if total <= 4 * SMALL_ROWS else gone
    columns = [c for c in docs.columns if c != n_col]
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("row"))
    row, text = F.col("row"), F.col("row")[text_col]
    joined = rows.join(gone, row[id_col].eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("body")), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda x, n: ~F.array_contains(F.col("gone"), n))
    rest = F.when(F.col("gone").isNotNull(), F.array_join(kept, "\n")).otherwise(text)
    count = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return joined.select(*[(rest if c == text_col else row[c]).alias(c) for c in columns], count.alias(n_col))
