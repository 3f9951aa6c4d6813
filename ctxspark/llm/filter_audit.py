"""Interaction audit of five document filters: what each removes in every order of applying them.

A document's five failures make a mask, and everything the audit reports follows from the number of documents (and of
good and of toxic ones) in each cell (part, mask). So documents are reduced to at most 32 cells per part; each cell then
folds across the order array (a constant of the plan, which Spark ships with the tasks): ``transform`` takes each of the 120
orders, ``aggregate`` walks its five steps with the cell still alive or not, and the cell's 600 structs, weighted by its
counts, are merged with those of the part's other cells by elementwise sums.

Filters over whole texts (a null text is empty; words are maximal runs of ``[^\\x20\\x09-\\x0D]``, case-sensitive) fail at: A under
200 words; B distinct words below half; C over 2 % capitals A-Z; D any of ``#$%&*|``; E a text that a row with a smaller doc_id
has, too. Only SQL functions are used.

Equal texts are found by their SHA-256: a row is the first of its text where (digest, doc_id) meets the least doc_id of the
digest. That join's keys hold the doc_id, so a large group of copies is spread over all tasks.

Rows: an empty table gives no rows; a null source is part ``''`` (with the empty ones); a null doc_id is never a later copy, has
no label and makes no other row a copy; rows that repeat a doc_id and its text are not copies of each other; a doc_id with
several label rows is good (toxic) if one of them says 1; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxspark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
LEAST_WORDS = 200
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(doc_id, part, digest, mask): bit i of ``mask`` is set where filter i of A to D fails; no text is kept."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"),
                       F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    fails = [n < LEAST_WORDS,
             100 * F.size(F.array_distinct("words")) < 50 * n,
             100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 2 * F.length("text").cast("long"),
             F.col("text").rlike("[#$%&*|]")]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], 1).otherwise(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failing filters, E included."""
    rows = stored(failures(docs), "audit-rows")
    known = rows.where(F.col("doc_id").isNotNull())
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = (labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    later = F.when(F.col("first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    known = (known.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
             .select("part", (F.col("mask") + later).alias("mask"), "good", "toxic"))
    nameless = (rows.where(F.col("doc_id").isNull())
                .select("part", "mask", F.lit(None).cast("int").alias("good"), F.lit(None).cast("int").alias("toxic")))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def folded(order: Column, fails: Column, n: Column, good: Column, toxic: Column) -> Column:
    """The five weighted structs of one cell along one order."""
    alone = F.size(F.filter(fails, lambda x: x)) == 1

    def step(state: Column, f: Column) -> Column:
        alive, fail = state["alive"], F.get(fails, f)
        weigh = lambda when, count: F.when(when, count).otherwise(F.lit(0).cast("long"))
        here = F.struct(f.alias("filter"), weigh(alive & ~fail, n).alias("kept"), weigh(alive & fail, n).alias("removed"),
                        weigh(~alive & fail, n).alias("redundant"), weigh(fail & alone, n).alias("unique_fails"),
                        weigh(alive & fail, good).alias("good_lost"), weigh(alive & fail, toxic).alias("toxic_lost"))
        return F.struct((alive & ~fail).alias("alive"), F.concat(state["steps"], F.array(here)).alias("steps"))

    fields = "filter: int, " + ", ".join(f"{c}: bigint" for c in SUMS)
    none = F.array().cast(f"array<struct<{fields}>>")
    return F.aggregate(order, F.struct(F.lit(True).alias("alive"), none.alias("steps")), step, lambda s: s["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    orders = list(permutations(range(len(LETTERS))))
    n_steps = len(LETTERS)
    fails = F.array(*[F.col("mask").bitwiseAND(1 << i) != 0 for i in range(n_steps)])
    each = cells(docs, labels).select("part", "n", "good", "toxic", fails.alias("fails"))
    structs = F.flatten(F.transform(F.lit([list(o) for o in orders]), lambda o: folded(
        o, F.col("fails"), F.col("n"), F.col("good"), F.col("toxic"))))
    # at most 32 arrays of 600 structs meet in a part
    arrays = each.select("part", structs.alias("structs")).groupBy("part").agg(F.collect_list("structs").alias("all"))
    add = lambda x, y: F.struct(x["filter"].alias("filter"), *[(x[c] + y[c]).alias(c) for c in SUMS])
    merged = arrays.select("part", F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, add)).alias("sums"))
    shapley = F.transform(F.lit(list(range(n_steps))), lambda f: F.aggregate(
        "sums", F.lit(0).cast("long"), lambda total, x: total + F.when(x["filter"] == f, x["removed"]).otherwise(F.lit(0).cast("long"))))
    rows = merged.select("part", "sums", shapley.alias("shapley")).select("part", F.posexplode("sums").alias("at", "x"), "shapley")
    names = F.lit(["".join(LETTERS[f] for f in o) for o in orders])
    return rows.select("part", F.get(names, F.floor(F.col("at") / n_steps).cast("int")).alias("filter_order"),
                       (F.col("at") % n_steps + 1).cast("int").alias("step"), *[F.col(f"x.{c}") for c in SUMS],
                       F.get("shapley", F.col("x.filter")).alias("shapley"))
