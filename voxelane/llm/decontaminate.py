"""Benchmark decontamination by templates: typed placeholders, a hash join of template windows, slot consistency.

DataFrame functions only. A token is a number, a word, or a marked word: a unit after a number, or a capitalised word inside a
sentence, taken for a name. Its template is a placeholder for its type, or the word itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, small_enough

# Units of measure and money that may follow a number.
UNITS = "km|cm|mm|m|miles?|feet|ft|inch|inches|kg|mg|g|lbs?|pounds?|tons?|l|ml|liters?|litres?|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|usd|eur|dollars?|euros?|cents?|percent|degrees?|mph|kwh|kw|w|v|hz"
NAME = r"([\p{Ll}\p{Nd},;:)] +)(\p{Lu})"
UNIT = rf"(\p{{Nd}} ?)((?i:{UNITS}))([^\p{{L}}\p{{Nd}}]|$)"
TOKEN = "\\p{Nd}+(?:[.,:/]\\p{Nd}+)*|\x01?[\\p{L}\\p{M}]+"
WINDOW, COVERAGE, BUCKET = 5, 0.7, 8


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text, with marked units and names; none for null."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\x01", " ")
    marked = F.regexp_replace(F.regexp_replace(plain, UNIT, "$1\x01u$2$3"), NAME, "$1\x01p$2")
    return F.regexp_extract_all(F.lower(marked), F.lit(TOKEN), F.lit(0))


def template(token: Column) -> Column:
    """The placeholder of a token, or the token."""
    first = F.substring(token, 1, 1)
    return F.when(first == "\x01", F.substring(token, 1, 2)).when(first.rlike(r"^\p{Nd}"), F.lit("\x01n")).otherwise(token)


def _hashes(tokens_: Column) -> Column:
    return F.transform(tokens_, lambda t: F.xxhash64(F.when(t < "a", template(t)).otherwise(t)))  # placeholders sort before letters


def _windows(hashes: Column, window: int) -> Column:
    """Hashes of all template windows, in order. The hashes must be a column: a lambda evaluates what it refers to each time."""
    pick = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
    return F.when(F.size(hashes) >= window, pick).otherwise(F.array().cast("array<bigint>"))


def _path(grid: Column) -> Column:
    """Codes (position * BUCKET + shift) of the heaviest alignment in a grid (position, shift) of weights, 0 where nothing meets.

    Every position takes one shift at most, and places in the document grow with positions. State s of a step: the next free place
    is at shift s. A change of shift costs 1, so large weights make fewest changes among the longest.
    """
    start = F.array_repeat(F.struct(F.lit(0).cast("bigint").alias("score"), F.array().cast("array<int>").alias("path")), BUCKET)

    def step(acc: Column, at: Column) -> Column:
        def state(s: Column) -> Column:
            skip = F.when(s == 0, F.greatest(F.get(acc, F.lit(0)), F.get(acc, F.lit(1)))).when(s < BUCKET - 1, F.get(acc, s + 1)).otherwise(F.get(acc, F.lit(0)))
            weight = F.get(at["weights"], s)
            turn = lambda a: F.when((F.size(a["path"]) > 0) & (F.try_element_at(a["path"], F.lit(-1)) % BUCKET != s), 1).otherwise(0)
            met = lambda a: F.struct((a["score"] + weight - turn(a)).alias("score"), F.concat(a["path"], F.array(at["spot"] * BUCKET + s)).alias("path"))
            return F.when(weight > 0, F.greatest(skip, F.array_max(F.transform(F.slice(acc, F.lit(1), s + 1), met)))).otherwise(skip)

        return F.transform(F.sequence(F.lit(0), F.lit(BUCKET - 1)), state)

    return F.aggregate(grid, start, step, lambda acc: F.array_max(acc)["path"])


def _one_place(each: DataFrame, coverage: float) -> DataFrame:
    """(doc, item, covered, n, same): single alignments of enough tokens in which each slot value stands for one value.

    Tried are each shift alone and the longest alignments, of those the one with most tokens equal to the item's own and the one
    with fewest changes of shift. None leaves out a token that meets, so one slot with another value still rejects it.
    """
    place = ["doc", "version", "item", "copy", "n", "phase", "bucket"]
    each = each.withColumn("s", (F.col("shift") - F.col("bucket") * BUCKET + F.col("phase") * (BUCKET // 2)).cast("int"))
    alone = each.select(*place, F.concat(F.lit("shift "), F.col("s").cast("string")).alias("way"), "spot", "iv", "dv")
    points = each.groupBy(*place).agg(F.map_from_entries(F.collect_set(F.struct((F.col("spot") * BUCKET + F.col("s")).alias("code"), F.struct("iv", "dv").alias("v")))).alias("points"))
    points = points.withColumn("way", F.explode(F.array(F.lit("own"), F.lit("all"))))

    def weights(i: Column) -> Column:
        def one(s: Column) -> Column:
            v = F.try_element_at(F.col("points"), i * BUCKET + s)
            return F.when(v.isNull(), 0).when((v["iv"] == v["dv"]) & (F.col("way") == "own"), 1_001_000).otherwise(1_000_000)

        return F.struct(i.alias("spot"), F.transform(F.sequence(F.lit(0), F.lit(BUCKET - 1)), one).alias("weights"))

    paths = points.withColumn("code", F.explode(_path(F.transform(F.sequence(F.lit(0), F.col("n") - 1), weights))))
    v = F.try_element_at(F.col("points"), F.col("code"))
    chosen = paths.select(*place, "way", F.floor(F.col("code") / BUCKET).cast("int").alias("spot"), v["iv"].alias("iv"), v["dv"].alias("dv"))
    way = [*place, "way"]
    values = alone.union(chosen).groupBy(*way, "iv").agg(F.count_distinct("dv").alias("values"), F.min("dv").alias("dv"), F.count_distinct("spot").alias("spots"))
    ways = values.groupBy(*way).agg(F.max(F.when(template(F.col("iv")) != F.col("iv"), F.col("values")).otherwise(1)).alias("most"), F.sum("spots").cast("int").alias("covered"), F.min(F.col("iv") == F.col("dv")).alias("same"))
    return ways.where((F.col("most") == 1) & (F.col("covered") >= F.lit(coverage) * F.col("n"))).select("doc", "item", "covered", "n", "same")


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(key, item_key, covered, item_tokens, same_slots): documents that hold a benchmark item, perhaps with other numbers, names and units.

    A document holds an item where windows of its templates, at nearly one offset (within a bucket of BUCKET, tried at two
    phases), cover at least the given share of the item's tokens, and each slot value of the item stands for one value
    throughout, over all hits of the bucket or along one alignment in it (repeating templates also hit at neighbouring
    offsets); the best place counts. same_slots says whether all values are the item's own. Items of fewer tokens than a
    window never match; nor do null texts. Null keys of documents or items are left out; of rows that repeat a key each text
    is looked at for itself, and the key has what any of them has. Texts of any length are read as a whole; other columns
    are not read, and empty tables give no rows. The window table of the items is broadcast up to BROADCAST_MB and shuffled beyond.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "leaks")
    bench = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.monotonically_increasing_id().alias("copy"), tokens(F.col(item_text)).alias("itokens"))
    bench = work.write(bench.where(F.size("itokens") >= window), "items")
    targets = bench.select("item", "copy", F.size("itokens").alias("n"), _hashes(F.col("itokens")).alias("hashes")).select("item", "copy", "n", F.posexplode(_windows(F.col("hashes"), window)).alias("ipos", "h"))
    targets = work.write(targets, "windows")
    side = F.broadcast(targets) if small_enough(targets) else targets
    # rows that repeat a key are told apart by their text; rows of equal key and text hold the same
    version = F.xxhash64(F.col(text).cast("string")).alias("version")
    probes = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), version, _hashes(tokens(F.col(text))).alias("hashes")).select("doc", "version", F.posexplode(_windows(F.col("hashes"), window)).alias("dpos", "h"))
    hits = probes.join(side, "h").select("doc", "version", "item", "copy", "n", "ipos", (F.col("dpos") - F.col("ipos")).alias("shift"))
    place = hits.withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("bucket", F.floor((F.col("shift") + F.col("phase") * (BUCKET // 2)) / BUCKET))
    group = ["doc", "version", "item", "copy", "n", "phase", "bucket"]
    found = place.groupBy(*group).agg(F.collect_set("ipos").alias("at"), F.collect_set(F.struct("ipos", "shift")).alias("pairs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i, i + window - 1)))))
    held = work.write(found.withColumn("covered", covered).where(F.col("covered") >= F.lit(coverage) * F.col("n")), "held")
    slotted = bench.where(F.exists("itokens", lambda t: template(t) != t)).select("item", "copy", "itokens")
    plain = held.join(slotted.select("item", "copy"), ["item", "copy"], "left_anti").select("doc", "item", "covered", "n", F.lit(True).alias("same"))
    check = held.join(slotted, ["item", "copy"])
    if check.limit(1).count():

        def spots(check: DataFrame) -> DataFrame:
            wanted = work.write(check.select("doc").distinct(), f"wanted-{uuid.uuid4().hex}")
            texts = docs.select(F.col(key).alias("doc"), version, F.col(text).alias("text")).join(F.broadcast(wanted) if small_enough(wanted) else wanted, "doc", "left_semi")
            texts = texts.dropDuplicates(["doc", "version"]).select("doc", "version", tokens(F.col("text")).alias("dtokens"))
            each = check.join(texts, ["doc", "version"]).withColumn("pair", F.explode("pairs")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(window - 1))))
            spot = F.col("pair.ipos") + F.col("k")
            each = each.select(*group, "covered", spot.alias("spot"), F.col("pair.shift").alias("shift"), F.get("itokens", spot).alias("iv"), F.get("dtokens", spot + F.col("pair.shift")).alias("dv"))
            return each.where(template(F.col("iv")) == template(F.col("dv")))

        values = spots(check).groupBy(*group, "covered", "iv").agg(F.count_distinct("dv").alias("values"), F.min("dv").alias("dv"))
        slots = values.groupBy(*group, "covered").agg(F.max(F.when(template(F.col("iv")) != F.col("iv"), F.col("values")).otherwise(1)).alias("most"), F.min(F.col("iv") == F.col("dv")).alias("same"))
        slots = work.write(slots, "slots")
        plain = plain.union(slots.where("most = 1").select("doc", "item", "covered", "n", "same"))
        mixed = slots.where("most > 1").select(*group)
        if mixed.limit(1).count():
            plain = plain.union(_one_place(spots(check.join(mixed, group, "left_semi")), coverage))
    best = plain.groupBy("doc", "item").agg(F.max(F.struct("covered", "same", "n")).alias("b"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("b.covered").alias("covered"), F.col("b.n").alias("item_tokens"), F.col("b.same").alias("same_slots"))


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs without those that hold an item; columns as before. Rows with a null key stay."""
    work = Workspace(docs.sparkSession, "leaks-drop")
    gone = work.write(leaks(docs, items, text, key, **how).select(F.col(key).alias("_gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if small_enough(gone) else gone, docs[key] == gone["_gone"], "left_anti")
