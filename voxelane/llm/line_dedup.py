"""Line deduplication: equal lines by hash, nearly equal ones by a segment-partition edit join.

DataFrame functions only. Of two lines within `edits` edits, one of edits + 1 disjoint segments of either stands unchanged in the
other, at a place that the number of edits beside it bounds. Lines are indexed by these segments and by a class of their length,
and probe the classes that partners may have. A line looks for its earliest partner, so a key's lines meet the earliest line of
the key first, and only lines that are still without an earlier partner meet the next ones: a family of close lines costs a row
a line, not a row a pair.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, small_enough

EDITS, LEAST_CHARS = 2, 24
#: Classes of lengths in a doubling; lines of each key that all its lines meet at once, and by how much that number grows a round.
CLASSES, LEADERS, GROWTH = 4, 2, 16
#: Lines that the search for hot keys looks at, and how many of them make a key hot. It only decides how rows are dealt to tasks.
SAMPLE, HOT = 20_000, 10


def rows_of(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, bool]:
    """((doc, copy, text, row), narrow): the rows, with all their columns in `row`. copy numbers the rows that repeat a key, by text; rows
    of equal key and text may swap numbers. Without repeated keys it is 0 and costs a count of the keys alone. narrow: whether keys
    are whole numbers of 32 bits and none repeats, so that a key and a line's number fit one long."""
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    whole = docs.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    ends = [F.min("doc").alias("lo"), F.max("doc").alias("hi")] if whole else [F.lit(None).alias("lo"), F.lit(None).alias("hi")]
    found = docs.groupBy(F.col(key).alias("doc")).count().where("doc IS NOT NULL").agg(F.max("count").alias("n"), *ends).first()
    if (found.n or 0) <= 1:
        return rows.withColumn("copy", F.lit(0)), whole and (found.lo is None or -(1 << 31) <= found.lo and found.hi < 1 << 32)
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text")) - 1), False


def lines_of(rows: DataFrame) -> DataFrame:
    """(doc, at, line): every line that isn't blank. at is the line's number, then the row's copy, in one long, so that (doc, at)
    orders all lines and names each; null keys and texts have none."""
    split = rows.where("doc IS NOT NULL AND text IS NOT NULL").select("doc", "copy", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split.where(F.trim("line") != "").select("doc", F.shiftleft(F.col("line_no").cast("long"), 31).bitwiseOR(F.col("copy")).alias("at"), "line")


def line_no(at: Column) -> Column:
    return F.shiftright(at, 31).cast("int")


def distinct_lines(lines: DataFrame, narrow: bool) -> DataFrame:
    """(line, doc, at, n): distinct lines, the first place of each and how often it occurs. A narrow place is one long, which a
    hash aggregate holds."""
    if not narrow:
        found = lines.groupBy("line").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
        return found.select("line", "first.doc", "first.at", "n")
    place = F.shiftleft(F.col("doc").cast("long"), 31).bitwiseOR(F.shiftright("at", 31))
    found = lines.select("line", place.alias("place")).groupBy("line").agg(F.min("place").alias("place"), F.count("*").alias("n"))
    kind = lines.schema["doc"].dataType.simpleString()
    return found.select("line", F.shiftright("place", 31).cast(kind).alias("doc"), F.shiftleft(F.col("place").bitwiseAND(F.lit((1 << 31) - 1)), 31).alias("at"), "n")


def _class(length: Column) -> Column:
    return F.floor(F.log2(length) * CLASSES).cast("int")


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """(key, own, doc, at, length) for lines (line, length, doc, at): the segments under which each is indexed (own), and those that
    it probes besides.

    Lines of a class of lengths have edits + 1 segments of one size; segment i is measured from the line's start where at most
    i <= edits - i edits can lie before it, else from its end. Probes are shifted by up to that many characters.
    """
    parts = edits + 1
    probes = [(far, i, shift) for far in sorted({0, *range(-edits, edits + 1, 2), edits}, key=abs) for i in range(parts) for shift in range(-min(i, edits - i), min(i, edits - i) + 1)]
    # exploded first, so that what is computed for each is one small expression
    each = lines.withColumn("p", F.explode(F.array(*[F.struct(F.lit(far).alias("far"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for far, i, shift in probes])))
    each = each.withColumn("cls", _class(F.col("length") + F.col("p.far"))).where((F.col("p.far") == 0) | (F.col("cls") != _class(F.col("length"))))
    size = F.floor(F.floor(F.pow(F.lit(2.0), F.col("cls") / CLASSES)) / parts).cast("int")
    start = F.when(2 * F.col("p.i") <= edits, size * F.col("p.i")).otherwise(F.col("length") - size * (parts - F.col("p.i"))) + 1 + F.col("p.shift")
    plain = F.octet_length("line") == F.col("length")  # one byte a character: bytes are found without walking the text
    key = F.when(plain, F.xxhash64("cls", "p.i", F.substring(F.col("line").cast("binary"), start, size))).otherwise(F.xxhash64("cls", "p.i", F.substring("line", start, size)))
    return each.select(key.alias("key"), ((F.col("p.far") == 0) & (F.col("p.shift") == 0)).alias("own"), "doc", "at", "length")


#: Letters that the bag of a line counts, and the bits of each count.
LETTERS, BITS = "etaoinsrhlducmgpwybf", 3
MOST = (1 << BITS) - 1


def bag(line: Column) -> Column:
    """Counts of the LETTERS of a line, modulo 2^BITS, in one long."""
    size = F.octet_length(line)
    parts = [F.shiftleft((size - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(MOST)), BITS * k) for k, c in enumerate(LETTERS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def may_be_near(a: Column, b: Column, edits: int) -> Column:
    """What the bags of lines within so many edits satisfy: an edit moves the sum of letter counts by two at most."""
    count = lambda x, k: F.shiftright(x, BITS * k).bitwiseAND(F.lit(MOST))
    gap = [F.abs(count(a, k) - count(b, k)) for k in range(len(LETTERS))]
    return sum((F.least(g, MOST + 1 - g) for g in gap), F.lit(0).cast("long")) <= 2 * edits


def _common(a: Column, b: Column, side) -> Column:
    """Length of the common prefix or suffix, by binary search with equality of ever shorter steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= F.length(a)) & (n + k <= F.length(b)) & (side(a, n + k) == side(b, n + k)), n + k).otherwise(n))


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once: a reference to a projected column may be replaced by what it computes."""
    return F.transform(F.array(value), use)[0]


def _distance_of(x: Column, y: Column, edits: int) -> Column:
    """edit_distance() of two strings, of what lies between their common prefix and suffix."""
    chars = lambda r, s: F.when(F.length(r) > s, F.split(F.substring(r, F.lit(1), F.length(r) - s), "")).otherwise(F.array().cast("array<string>"))
    inner = lambda r: _let(_common(r["x"], r["y"], lambda v, n: F.right(v, n)), lambda s: _let(F.struct(chars(r["x"], s).alias("x"), chars(r["y"], s).alias("y")), lambda c: edit_distance(c["x"], c["y"], edits)))
    rest = lambda p: _let(F.struct(F.substring(x, p + 1, F.length(x)).alias("x"), F.substring(y, p + 1, F.length(y)).alias("y")), inner)
    return _let(_common(x, y, lambda v, n: F.substring(v, F.lit(1), n)), rest)


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two arrays of characters, or null above `edits`: a bit-parallel automaton in a band.

    After j characters of b, bit k of level d says whether j - edits + k characters of a can be reached with d edits. All
    2 * edits + 1 places of the band move in one step: a match keeps a bit's place, an insertion lowers it, a deletion
    raises it. Once the last level is empty it stays so.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    start = F.array(*[F.lit(sum(1 << (edits + i) for i in range(d + 1)) & mask) for d in range(edits + 1)]).cast("array<int>")

    def step(levels: Column, j: Column) -> Column:
        char = F.get(b, j - 1)
        equal = sum((F.when((j - edits + k >= 1) & (F.get(a, j - edits + k - 1) == char), 1 << k).otherwise(0) for k in range(width)), F.lit(0))

        def raised(d: int, eq: Column):
            old = F.get(levels, d - 1)
            kept = F.get(levels, d).bitwiseAND(eq).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))
            return lambda done: F.concat(done, F.array(kept.bitwiseOR(F.shiftleft(F.get(done, d - 1), 1)).bitwiseAND(F.lit(mask))))

        def move(eq: Column) -> Column:
            out = F.array(F.get(levels, 0).bitwiseAND(eq))
            for d in range(1, edits + 1):
                out = F.transform(F.array(out), raised(d, eq))[0]
            return out

        return F.when(F.get(levels, edits) == 0, levels).otherwise(F.transform(F.array(equal), move)[0])

    last = F.aggregate(F.sequence(F.lit(1), F.size(b)), start, step)
    end = F.size(a) - F.size(b) + edits
    levels = F.when(F.size(b) == 0, start).otherwise(last)
    place = F.when((end >= 0) & (end < width), F.pow(F.lit(2), end).cast("int")).otherwise(0)
    reached = F.transform(levels, lambda r: (r.bitwiseAND(place) != 0).cast("int"))
    return F.nullif(F.array_position(reached, 1).cast("int"), F.lit(0)) - 1


#: Groups of letters whose counts a refined key holds in pairs.
GROUPS = 6


def refined(rows: DataFrame, edits: int) -> DataFrame:
    """Rows (key, bag, ...) under keys that hold some letter counts besides: lines within 2 edits that meet under a key still meet.

    An edit changes two letter counts at most, so that at least GROUPS - 2 * edits groups of letters keep theirs: two or more of six for
    up to 2 edits, and so one pair of groups or more. Without any group to rely on (3 edits) rows stay as they are.
    """
    sure = min(2, GROUPS - 2 * edits)
    if sure <= 0:
        return rows
    masks = [sum(MOST << BITS * k for k in range(len(LETTERS)) if k % GROUPS in some) for some in itertools.combinations(range(GROUPS), sure)]
    kept = [c for c in rows.columns if c != "key"]
    return rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))).select(F.xxhash64("key", "mask", F.col("bag").bitwiseAND(F.col("mask"))).alias("key"), *kept)


def _hot_keys(long: DataFrame, edits: int) -> DataFrame:
    """(key): keys that at least HOT of some SAMPLE lines, chosen by hash, are indexed under; so (edits + 1) * SAMPLE / HOT at most."""
    step = max(1, long.count() // SAMPLE)
    some = keyed(long.where(F.pmod(F.xxhash64("doc", "at"), F.lit(step)) == 0), edits).where("own")
    return some.groupBy("key").count().where(F.col("count") >= HOT).select("key")


def near_lines(distinct: DataFrame, work: Workspace, edits: int = EDITS, least_chars: int = LEAST_CHARS, leaders: int = LEADERS) -> DataFrame:
    """(doc, at, near_doc, near_at, edits): lines of a table of distinct lines (line, length, doc, at) that lie within `edits` edits
    of a line that first occurs earlier; the earliest such line. Lines under least_chars take no part.

    Rows of a key meet its first `leaders` index entries by a window. Rows of keys with more entries go on in rounds: each round
    takes GROWTH times as many entries, for rows whose earliest partner so far, if any, is later than those. Keys are refined()
    before, so that lines of one segment that cannot be near don't meet. A hot key's rows are salted in the window and enter the
    rounds as a whole, whose joins Spark can split.
    """
    if not 0 <= edits <= 3 or least_chars < (edits + 1) * 4:
        raise ValueError("the classes of lengths serve 0 to 3 edits and lines of four characters a segment at least")
    long = distinct.where(F.col("length") >= least_chars)
    hot = work.write(_hot_keys(long, edits), "hot")
    # own is the lowest bit of `at`, so that a row is three numbers and the key
    rows = keyed(long, edits).select("key", "doc", F.shiftleft("at", 1).bitwiseOR(F.col("own").cast("long")).alias("at"), "length")
    if not hot.limit(1).count():
        rows = rows.withColumn("salt", F.lit(0))
    else:
        rows = rows.join(F.broadcast(hot.withColumn("is_hot", F.lit(1))), "key", "left").withColumn("salt", F.when(F.col("is_hot") == 1, 1 + F.pmod(F.xxhash64("doc", "at"), F.lit(1024))).otherwise(0).cast("int")).drop("is_hot")
    own = F.col("at").bitwiseAND(F.lit(1)) == 1
    upto = Window.partitionBy("key", "salt").orderBy("doc", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.when(own, F.struct("doc", F.shiftright("at", 1).alias("at"), "length"))
    met = rows.withColumns({"seen": F.count(F.when(own, 1)).over(upto)} | {f"e{i}": F.nth_value(entry, i, True).over(upto) for i in range(1, leaders + 1)})
    mine = F.shiftright("at", 1)

    def partner(e: str) -> Column:
        earlier = (F.col(f"{e}.doc") < F.col("doc")) | ((F.col(f"{e}.doc") == F.col("doc")) & (F.col(f"{e}.at") < mine))
        return F.when(earlier & (F.abs(F.col("length") - F.col(f"{e}.length")) <= edits), F.struct(F.col(f"{e}.doc").alias("doc"), F.col(f"{e}.at").alias("at")))

    met = met.withColumn("hot", F.col("salt") > 0).withColumns({f"p{i}": partner(f"e{i}") for i in range(1, leaders + 1)})
    kept = met.where(F.col("hot") | (F.col("seen") > leaders) | F.coalesce(*[f"p{i}" for i in range(1, leaders + 1)]).isNotNull())
    found = work.write(kept.select("key", "doc", "at", "length", "hot", F.when(F.col("hot"), 0).otherwise(F.col("seen")).alias("seen"), F.array_compact(F.array(*[f"p{i}" for i in range(1, leaders + 1)])).alias("partners")), "met")
    work.release()
    pairs = found.where("NOT hot").select("doc", mine.alias("at"), F.explode("partners").alias("p")).select("doc", "at", F.col("p.doc").alias("near_doc"), F.col("p.at").alias("near_at")).distinct()
    crowd = found.where((F.col("seen") > leaders) | F.col("hot")).select("key", "doc", mine.alias("at"), "length", own.alias("own"))
    rounds = crowd.limit(1).count() > 0
    wanted = found.select("doc", mine.alias("at")).union(pairs.select(F.col("near_doc").alias("doc"), F.col("near_at").alias("at"))).distinct()
    wanted = work.write(wanted, "wanted")
    texts = work.write(distinct.join(F.broadcast(wanted) if small_enough(wanted) else wanted, ["doc", "at"], "left_semi").select("doc", "at", "line").withColumn("bag", bag(F.col("line"))), "texts")
    best = work.write(_verified(pairs, texts, edits), "near-0")
    if rounds:
        crowd = work.write(refined(crowd.join(texts.select("doc", "at", "bag"), ["doc", "at"]), edits), "crowd")
    targets, taken, k = crowd, 0, 0
    while rounds:
        # the crowd of a key has its entries after the first `leaders`, or all of a hot key
        most, k = GROWTH * max(1, taken), k + 1
        rank = F.row_number().over(Window.partitionBy("key").orderBy("doc", "at"))
        lead = crowd.where("own").withColumn("r", rank).where((F.col("r") <= most) & (F.col("r") > taken)).select("key", F.col("doc").alias("near_doc"), F.col("at").alias("near_at"), F.col("length").alias("near_length"), F.col("bag").alias("near_bag"))
        lead = work.write(lead, f"leaders-{k}")
        first = lead.groupBy("key").agg(F.min(F.struct("near_doc", "near_at")).alias("first"))
        limit = F.coalesce("limit", F.struct(F.col("doc").alias("near_doc"), F.col("at").alias("near_at"))).alias("limit")
        so_far = targets.join(best.select("doc", "at", F.struct("near_doc", "near_at").alias("limit")), ["doc", "at"], "left").select("key", "doc", "at", "length", "bag", limit)
        targets = work.write(so_far.join(first, "key").where("first < limit").drop("first"), f"targets-{k}")  # later entries are no use to the others
        if not targets.limit(1).count():
            break
        step = targets.join(F.broadcast(lead) if small_enough(lead) else lead, "key").where((F.struct("near_doc", "near_at") < F.col("limit")) & (F.abs(F.col("length") - F.col("near_length")) <= edits) & may_be_near(F.col("bag"), F.col("near_bag"), edits))
        both = best.union(_verified(step.select("doc", "at", "near_doc", "near_at").distinct(), texts, edits)).groupBy("doc", "at").agg(F.min(F.struct("near_doc", "near_at", "edits")).alias("b")).select("doc", "at", "b.*")
        best = work.write(both, f"near-{k}")
        taken, targets = most, targets.drop("limit")
    return best


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(doc, at, near_doc, near_at, edits): the earliest partner of each line that really lies within the edits."""
    mine, theirs = texts.select("doc", "at", F.col("line").alias("x"), F.col("bag").alias("bag_x")), texts.select(F.col("doc").alias("near_doc"), F.col("at").alias("near_at"), F.col("line").alias("y"), F.col("bag").alias("bag_y"))
    both = pairs.join(mine, ["doc", "at"]).join(theirs, ["near_doc", "near_at"]).where(may_be_near(F.col("bag_x"), F.col("bag_y"), edits))
    both = both.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    close = both.select("doc", "at", "near_doc", "near_at", F.explode(F.array(_distance_of(F.col("x"), F.col("y"), edits))).alias("edits")).where("edits IS NOT NULL")
    return close.groupBy("doc", "at").agg(F.min(F.struct("near_doc", "near_at", "edits")).alias("b")).select("doc", "at", "b.*")


def _found(rows: DataFrame, narrow: bool, work: Workspace, edits: int, least_chars: int) -> DataFrame:
    """(doc, at, exact, first_doc, first_at, edits): the lines that repeat an earlier one."""
    every = lines_of(rows)
    distinct = work.write(distinct_lines(every, narrow).withColumns({"length": F.length("line"), "h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))}), "distinct")
    work.release()
    near = near_lines(distinct.select("line", "length", "doc", "at"), work, edits, least_chars)
    firsts = distinct.select("h1", "h2", "doc", "at", "n").join(F.broadcast(near) if small_enough(near) else near, ["doc", "at"], "left").where("n > 1 OR near_doc IS NOT NULL")
    firsts = work.write(firsts.select("h1", "h2", F.col("doc").alias("own_doc"), F.col("at").alias("own_at"), "near_doc", "near_at", "edits"), "firsts")
    hashed = every.select("doc", "at", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"))
    exact = (F.col("doc") != F.col("own_doc")) | (F.col("at") != F.col("own_at"))
    found = hashed.join(F.broadcast(firsts) if small_enough(firsts) else firsts, ["h1", "h2"]).withColumn("exact", exact).where("exact OR near_doc IS NOT NULL")
    pick = lambda x: F.when(F.col("exact"), F.col(f"own_{x}")).otherwise(F.col(f"near_{x}"))
    return found.select("doc", "at", "exact", pick("doc").alias("first_doc"), pick("at").alias("first_at"), F.when(F.col("exact"), 0).otherwise(F.col("edits")).alias("edits"))


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, line_no, kind, first_doc, first_line, edits): the lines that repeat an earlier one, in order of key and line.

    kind is exact for all but the first place of equal lines (edits 0; first_doc and first_line name that place), and near
    for lines within `edits` edits of a different line that first occurs earlier (the earliest such line). Blank lines
    repeat nothing. Rows that repeat a key are rows of their own: of equal lines at one number the row of lesser text hash
    comes first. Null keys and texts have no lines, empty tables no rows; other columns are not read. Lines of any length
    are compared as a whole.
    """
    rows, narrow = rows_of(docs, text, key)
    found = _found(rows.drop("row"), narrow, Workspace(docs.sparkSession, "lines"), edits, least_chars)
    return found.select(F.col("doc").alias(key), line_no(F.col("at")).alias("line_no"), F.when(F.col("exact"), "exact").otherwise("near").alias("kind"), "first_doc", line_no(F.col("first_at")).alias("first_line"), "edits")


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", edits: int = EDITS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs with the repeated lines taken out of their texts; every row stays, if need be with an empty text.

    Kept lines are joined by newlines. Null keys and texts are left as they are; columns as before, whatever their names. Of
    rows that repeat a key each loses its own repeated lines.
    """
    work = Workspace(docs.sparkSession, "lines-drop")
    rows, narrow = rows_of(docs, text, key)
    found = _found(rows.drop("row"), narrow, work, edits, least_chars).withColumn("copy", F.col("at").bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    cut = work.write(found.groupBy("doc", "copy").agg(F.array_sort(F.collect_set(line_no(F.col("at")))).alias("cut")), "cut")
    joined = rows.join(F.broadcast(cut) if small_enough(cut) else cut, ["doc", "copy"], "left").withColumn("lines", F.when(F.col("cut").isNotNull(), F.split("text", "\n")))
    stops = F.concat("cut", F.array(F.size("lines")))
    starts = F.concat(F.array(F.lit(0)), F.transform("cut", lambda c: c + 1))
    runs = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda r: F.slice("lines", r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))))
    short = F.when(F.col("cut").isNull(), F.col("row")[text]).otherwise(F.array_join(F.flatten(runs), "\n"))
    return joined.select(*[(short if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
