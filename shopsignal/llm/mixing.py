"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Only DataFrame operations. Documents get a hash-random key and are range-sorted within their
source, a hot source over many partitions; prefix sums of sizes come from the distributed ordered
scan, and each source is cut at its budget, after as many whole epochs as the budget holds.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsignal.llm.common import fresh_names, materialize, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"


def count_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    spaces = " \t\n\x0b\f\r"
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "x"), spaces, "")).cast("bigint"), F.lit(0).cast("bigint"))


def prefix_sums(df: DataFrame, order: Sequence[str], value: str, name: str, spark_partitions: int) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each in the whole table's order.

    Rows are range-sorted and written with their partition's number; each partition is scanned on
    its own, and the sums of the partitions before it come from a summary of one row per partition.
    """
    names = fresh_names(df.columns, ("_part", "_own", "_before"))
    part, own, before = names.values()
    sorted_ = materialize(df.repartitionByRange(spark_partitions, *order).withColumn(part, F.spark_partition_id()), "ordered")
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sorted_.groupBy(part).agg(F.sum(value).alias(own))
    offsets = sums.select(part, (F.sum(own).over(Window.orderBy(part)) - F.col(own)).alias(before))   # a row per partition
    return sorted_.withColumn(own, F.sum(value).over(within) - F.col(value)).join(F.broadcast(offsets), part) \
        .withColumn(name, F.col(own) + F.col(before)).drop(part, own, before)


def source_targets(sizes: DataFrame, *, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), limit: int = 2,
                   partitions: int = 8) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Sources by code point, null last, take the weights in turn and share share[0] / share[1] of all
    sizes; a target stops at ``limit`` times its source's size and the excess is reshared by
    weight. In order of size per weight the stopped sources come first: a source stops if its limit
    is at most its share of what those before it leave.
    """
    up, down = share
    ranked = prefix_sums(sizes.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_one", F.lit(1).cast("bigint")),
                         ["_null", "source"], "_one", "_rank", partitions)
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    rated = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * limit)
    # exact order of cap / weight: compare cap * (product of the weights / weight)
    product = 1
    for x in weights:
        product *= x
    rated = rated.withColumn("_ratio", F.col("_cap") * (F.lit(product) / F.col("_w")).cast("bigint"))
    sums = prefix_sums(rated, ["_ratio", "_rank"], "_cap", "_caps", partitions)
    sums = prefix_sums(sums, ["_ratio", "_rank"], "_w", "_ws", partitions)
    whole = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"))
    weight = rated.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("all"))
    # literals below 2^31 are 32-bit whole numbers, and their products overflow
    total, all_w = F.lit(int(whole.first()["all"])).cast("bigint"), F.lit(int(weight.first()["all"])).cast("bigint")
    # cap <= w * (up / down * total - caps before) / (weights from here on), in whole numbers
    stop = F.col("_cap") * down * (all_w - F.col("_ws")) <= F.col("_w") * (total * up - F.col("_caps") * down)
    sums = sums.withColumn("_stop", stop)
    full = sums.filter("_stop").agg(F.coalesce(F.sum("_cap"), F.lit(0)).alias("c"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    left = F.lit(int(full["c"])).cast("bigint")
    rest = (F.col("_w") * (total * up - left * down)).cast("double") / F.nullif(F.lit(float(down)) * (all_w - F.lit(int(full["w"]))).cast("double"), F.lit(0.0))
    return sums.select("source", "source_size", F.when(F.col("_stop"), F.col("_cap").cast("double")).otherwise(rest).alias("target"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (5, 2, 1),
        share: tuple[int, int] = (3, 2), limit: int = 2, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """What the mix takes of every document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``epochs`` (whole times), ``part`` (words beside them), ``taken``, and the columns ``keep`` of ``docs``.

    ``size`` counts words; ``taken`` counts them with repeats: all whole epochs the source's budget
    (its target, rounded down) holds, then documents in the order of md5(seed, doc_id) up to the
    budget; the document at the cut gives only its first words. So a source's taken words are its
    budget exactly, no document is taken more than ``limit`` times, and reruns agree. Null, empty
    and blank texts have size 0 and are taken 0 times; a null source is a source of its own; rows
    that repeat are documents of their own (equal rows are interchangeable); a null doc_id sorts by
    the key of the empty id; an empty table gives no rows; other columns are not read, and those to
    keep must not be named like the results.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    sized = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                                    count_words(F.col(text).cast("string")).alias("size"), *keep), "sizes")
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sizes, weights=weights, share=share, limit=limit, partitions=n)
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    keyed = sized.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("_key", F.substring(key, 1, 16))
    sums = prefix_sums(keyed, ["_null", "source", "_key", "doc_id", "size", *keep], "size", "_sum", n)
    # the sum before a source's first document is the total of the sources before it
    firsts = prefix_sums(sizes.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "source_size", "_base", n) \
        .select(F.col("source").alias("_s"), "_base")
    per = targets.join(firsts, F.col("source").eqNullSafe(F.col("_s"))).drop("source")
    rows = sums.join(per, F.col("source").eqNullSafe(F.col("_s")), "left")
    budget = F.floor("target").cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0).cast("bigint"))
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - (F.col("_sum") - F.col("_base"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), part.alias("part"),
                       (epochs * F.col("size") + part).alias("taken"), *keep)


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, the one at a cut with its first words only.

    Cases as in ``mix``; a document without words is repeated for the whole epochs alone. Rows that share
    their id and size are told apart by all their columns (but maps), equal rows by their number only: those
    that repeat are written apart and numbered inside the tasks that hold them, and counts a task give each
    task's first number.
    """
    names = fresh_names([*docs.columns, "size", "source_size", "target", "epochs", "part", "taken"], ("_k1", "_k2", "_n", "_e", "_more", "_cut", "_copy", "_task", "_first", "_total"))
    k1, k2, nth, epochs, more, cut, copy, task, first_of_task, total = names.values()
    row = [F.col(c) for c, t in docs.dtypes if "map<" not in t and t != "variant"]
    keyed = docs.withColumn(k1, F.xxhash64(*row)).withColumn(k2, F.xxhash64(F.lit("second"), *row))
    slim = mix(keyed, doc_id=doc_id, source=source, text=text, keep=[k1, k2], **options)
    per = slim.groupBy(k1, k2).agg(F.min("epochs").alias(epochs), F.count_if((F.col("part") == F.col("size")) & (F.col("size") > 0)).alias(more),
                                   F.max(F.when(F.col("part") < F.col("size"), F.col("part")).otherwise(0)).alias(cut),
                                   F.count(F.lit(1)).alias(total))
    per = materialize(per, "taken")
    rows = keyed.join(per.filter(F.col(total) == 1), [k1, k2]).withColumn(nth, F.lit(1))
    repeated = materialize(per.filter(F.col(total) > 1), "repeated")
    if repeated.limit(1).count():
        within = F.row_number().over(Window.partitionBy(k1, k2, task).orderBy(F.lit(0)))
        many = keyed.withColumn(task, F.spark_partition_id()).join(repeated.select(k1, k2), [k1, k2], "left_semi")
        local = materialize(many.withColumn(nth, within), "numbered")
        held = local.groupBy(k1, k2, task).agg(F.count(F.lit(1)).alias(first_of_task))
        held = held.withColumn(first_of_task, F.sum(first_of_task).over(Window.partitionBy(k1, k2).orderBy(task)) - F.col(first_of_task))     # a row per task
        numbered = local.join(held.join(repeated, [k1, k2]), [k1, k2, task]).withColumn(nth, F.col(nth) + F.col(first_of_task))
        rows = rows.unionByName(numbered.select(rows.columns))
    whole = F.col(epochs) + (F.col(nth) <= F.col(more)).cast("long")
    short = (F.col(nth) == F.col(more) + 1) & (F.col(cut) > 0)
    rows = rows.withColumn(copy, F.explode(F.concat(
        F.array_repeat(F.lit(False), whole.cast("int")), F.when(short, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>")))))
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    first = F.array_join(F.slice(words, F.lit(1), F.col(cut).cast("int")), " ")
    return rows.withColumn(text, F.when(F.col(copy), first).otherwise(F.col(text))).select(*docs.columns)
