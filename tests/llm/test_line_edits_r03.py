"""The finding on the CPU time of line deduplication, round 3: most pairs are decided by bounds on their edits."""

import random

from pyspark.sql import functions as F

from tallyline.llm import line_dedup


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _pairs():
    rng = random.Random(5)
    letters = "aeinorst é\U0001f600"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("", "a"), ("a", "a"), ("ab" * 200, "ba" * 200)]
    for size in (5, 63, 64, 76, 77, 150, 400, 700):
        for edits in (0, 1, size // 20, size // 10, size // 10 + 1, size // 7):
            line = text(size)
            other = list(line)
            for _ in range(edits):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice(["", text(1), other[at] + text(1)])
            pairs.append((line, "".join(other)))
            pairs.append((line, text(size)))
            cut = rng.randrange(size)
            pairs.append((line, line[cut:] + line[:cut]))
            pairs.append((line, text(size // 10) + line[: size - size // 10]))
    return pairs


def test_bounds_agree_with_edits(spark):
    rows = [(a, b, max(len(a), len(b)) // 10, _distance(a, b)) for a, b in _pairs()]
    table = spark.createDataFrame(rows, "a string, b string, most int, edits int")
    a, b, most = F.col("a"), F.col("b"), F.col("most")
    found = table.select(
        "edits", "most", line_dedup._within(a, b, most).alias("within"),
        line_dedup._pieced(a, b, most).alias("pieced"), line_dedup._missed(a, b).alias("missed"),
    ).collect()
    assert all(r.within == (r.edits <= r.most) for r in found)
    assert all(r.edits <= r.most for r in found if r.pieced)
    assert all(r.missed <= r.edits for r in found)


def test_bounds_decide_long_lines(spark):
    """Edits over the whole of both lines were counted for every such pair."""
    rng = random.Random(6)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    line = " ".join(rng.choice(words) for _ in range(600))
    near = line.split(" ")
    for at in range(5, 600, 40):
        near[at] = rng.choice(words)
    far = " ".join(rng.choice(words) for _ in range(600))
    table = spark.createDataFrame([(line, " ".join(near)), (line, far)], "a string, b string")
    most = F.floor(F.length("a") / 10).cast("int")
    found = table.select(line_dedup._pieced(F.col("a"), F.col("b"), most).alias("pieced"), (line_dedup._missed(F.col("a"), F.col("b")) > most).alias("apart"))
    assert [tuple(r) for r in found.collect()] == [(True, False), (False, True)]
