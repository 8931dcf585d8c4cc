"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources in code point order, null last, get the weights 3, 1, 2, repeating, of 150 % of all tokens; a source stops at
twice its size, and the excess is shared anew by weight until none is above. In one pass: sorted by cap / weight, the water level
is the first at which no later source is full.

Schedule: slot i has the golden-ratio point i / phi mod 1, in units of 2^-40. Points go through the cumulative targets of the
sources, and the source in whose share a point falls gets the slot. Each source's documents lie in a shuffled order (by an md5 of
doc_id and text) on a line of tokens that is read at most twice and is cut into blocks of equal size; the r-th slot of a source
takes its r-th block. What a document is taken is what lies in blocks that have a slot, so that the schedule alone decides how much
of each source the mix holds: its target to within the few slots by which golden-ratio points miss an even share. Blocks must be
small beside a source for that: a source has the largest block of BLOCKS that its target holds LEAST_SLOTS times, and sources
with equal blocks share a schedule. Schedules run side by side; a slot's position in the mix is its share of its schedule's length.

Every table is distributed, that of the sources too: running sums over sources run within ranges of them.

Defined results: null, empty and blank texts have size 0 and are not taken; a null source is a source; rows with a null doc_id
take part; repeated rows take part one by one, and are one row with a count until they lie on the line; columns of other names
are carried along by `mix_rows` and ignored by `mix`; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.llm.common import hash60, materialize, n_words, ordered_totals, running_total

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
#: Tokens in a block, by falling size, and the slots that a source's target should have at least.
BLOCKS = (1024, 256, 64, 16, 4, 1)
LEAST_SLOTS = 1024
#: Points are whole numbers below 2^BITS; a slot moves on by STEP, the odd number nearest to 2^BITS / phi.
BITS = 40
STEP = round((1 << BITS) * 2 / (1 + math.sqrt(5))) | 1
#: Slots of which the ranks are found together, and repeated rows that are expanded together.
CHUNK = 1 << 15
EXPANDED = 4096
KEY = "__meshloom_key"


def point(slot: Column, step: int) -> Column:
    """slot * step mod 2^BITS, in two halves that stay within 64 bits for slots below 2^42."""
    half = 1 << 20
    return F.pmod(F.floor(slot / half) * (step * half % (1 << BITS)) + F.pmod(slot, F.lit(half)) * step, F.lit(1 << BITS))


def targets(sized: DataFrame) -> DataFrame:
    """(source, sid, n_rows, source_size, target, goal, block, lo, hi): one row for each source of sized (source, m, size).

    sid is its place in order; [lo, hi) its share of the points of the schedule of its block size.
    """
    found = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    ranked = ordered_totals(found.withColumn("none", F.col("source").isNull()).withColumn("one", F.lit(1).cast("long")), ["none", "source"], {"sid": "one"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod("sid", F.lit(len(WEIGHTS))) + 1).cast("int"))
    capped = ranked.withColumn("w", weight).withColumn("cap", REPEATS * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    filled = ordered_totals(capped, ["ratio", "sid"], {"full": "cap", "earlier": "w"})
    size, weights = filled.agg(F.sum("source_size"), F.sum("w")).first()
    rate = (SHARE * (size or 0) - F.col("full")) / (F.lit(weights) - F.col("earlier"))
    level = filled.agg(F.coalesce(F.max(F.when(rate <= F.col("ratio"), rate)), F.max("ratio"))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w"))
    block = F.lit(BLOCKS[-1])
    for b in BLOCKS[-2::-1]:
        block = F.when(F.col("goal") >= b * LEAST_SLOTS, F.lit(b)).otherwise(block)
    goals = filled.withColumn("target", target).withColumn("goal", F.floor("target")).withColumn("block", block.cast("long"))
    shared = ordered_totals(goals.select("source", "sid", "n_rows", "source_size", "target", "goal", "block"), ["block", "sid"], {"before": "goal"})
    of_block = F.broadcast(shared.groupBy("block").agg(F.sum("goal").alias("of"), F.min("before").alias("base")))  # a row for each of BLOCKS
    share = lambda x: F.floor(x / F.greatest("of", F.lit(1)) * float(1 << BITS))
    before = F.col("before") - F.col("base")
    out = shared.join(of_block, "block").withColumn("lo", share(before)).withColumn("hi", share(before + F.col("goal")))
    return materialize(out.drop("before", "of", "base"), "sources")


def schedule(sources: DataFrame, step: int = STEP) -> DataFrame:
    """(sid, rank, position): the slots of each source (sid, goal, block, lo, hi) in turn, and where in the mix they are."""
    spark = sources.sparkSession
    lengths = [(r["block"], -(-r["of"] // r["block"])) for r in sources.groupBy("block").agg(F.sum("goal").alias("of")).collect()]  # a row for each of BLOCKS
    shift = BITS - min(BITS, max(10, sources.count().bit_length()))
    cuts = sources.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(lo, {shift}), shiftright(hi - 1, {shift}))")))
    points = None
    for block, n in lengths:
        some = spark.range(n).select(F.lit(block).cast("long").alias("block"), F.col("id").alias("slot"), point(F.col("id"), step).alias("point"), ((F.col("id") + 0.5) / n).alias("position"))
        points = some if points is None else points.union(some)
    if points is None:
        return spark.createDataFrame([], "sid long, rank long, position double")
    cells = points.withColumn("cell", F.shiftright("point", shift))
    slots = cells.join(cuts.select("block", "cell", "sid", "lo", "hi"), ["block", "cell"]).where("point >= lo AND point < hi")
    slots = slots.select("sid", "slot", "position", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = slots.groupBy("sid", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return slots.withColumn("rank", rank).join(base, ["sid", "chunk"]).select("sid", (F.col("base") + F.col("rank")).alias("rank"), "position")


def mix(docs: DataFrame, key: Column | None = None, step: int = STEP) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first, second, KEY), one row per document.

    first and second are the positions of the slots that take the document's first words at the first and second reading; KEY is
    what key gives for the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.conv(F.substring(F.md5(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text).alias("size"), at.alias("at"), (F.lit(0) if key is None else key).alias(KEY))
    sized = materialize(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("m")), "sizes")
    sources = targets(sized)
    slots = schedule(sources, step)
    known = sources.select(F.col("source").alias("name"), "sid", "source_size", "target", "block")
    named = sized.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source").withColumn("words", F.col("size") * F.col("m"))
    placed = running_total(named, "sid", "at", ["doc_id", "size", KEY], "words", sources.select("sid", "n_rows"), "start")
    placed = materialize(_expanded(placed), "lines")
    # the pieces of a document on its source's line, which is read REPEATS times, by the block they lie in
    lines = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))
    cut = placed.where("size > 0").select("sid", "start", "size", "block", "source_size", lines.alias("line")).withColumn("lo", F.col("start") + F.col("line") * F.col("source_size"))
    cut = cut.withColumn("hi", F.col("lo") + F.col("size")).withColumn("rank", F.explode(F.expr("sequence(lo div block, (hi - 1) div block)")))
    words = F.least("hi", (F.col("rank") + 1) * F.col("block")) - F.greatest("lo", F.col("rank") * F.col("block"))
    pieces = cut.select("sid", "rank", "start", "line", words.alias("words"))
    positions = [F.min(F.when(F.col("line") == i, F.col("position"))).alias(name) for i, name in enumerate(("first", "second"))]
    taken = pieces.join(slots, ["sid", "rank"]).groupBy("sid", "start").agg(F.sum("words").alias("taken"), *positions)
    # a document without words shares its start with the next one, so the sign of its size is part of the key
    keyed = placed.withColumn("place", F.when(F.col("size") > 0, F.col("start")))
    out = keyed.join(taken.withColumnRenamed("start", "place"), ["sid", "place"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first", "second", KEY)


def _expanded(placed: DataFrame) -> DataFrame:
    """Rows that stand for m repeated ones, as these: they lie one after the other. Many of them are dealt out before that."""
    few = placed.where(f"m <= {EXPANDED}").withColumn("nth", F.explode(F.expr("sequence(0L, m - 1)")))
    parts = placed.where(f"m > {EXPANDED}").withColumn("part", F.explode(F.expr(f"sequence(0L, (m - 1) div {EXPANDED})")))
    many = parts.repartition("sid", "at", "part").withColumn("nth", F.explode(F.expr(f"sequence(part * {EXPANDED}, least(m, (part + 1) * {EXPANDED}) - 1)"))).drop("part")
    return few.unionByName(many).withColumn("start", F.col("start") + F.col("nth") * F.col("size")).drop("nth", "m", "words", "at")


def mix_rows(docs: DataFrame) -> DataFrame:
    """docs as mixed: each row as often as the mix takes it, to the nearest whole time; every partition in the order of the schedule.

    Rows are dealt to partitions by a hash, so that each partition is a sample of the mix, and a mix itself. A source then holds its target to within its slots' evenness and a document or two. Of rows that agree in doc_id, source and
    text, some are taken once more than others where their share asks for it.
    """
    key = F.xxhash64(*[F.col(c) for c in ("doc_id", "source", "text")])
    taken = mix(docs, key).groupBy(KEY).agg(F.count(F.lit(1)).alias("m"), F.round(F.sum("taken") / F.greatest(F.max("size"), F.lit(1))).cast("long").alias("c"), F.min("first").alias("first"), F.min("second").alias("second"))
    times = taken.where("c > 0").select(KEY, F.expr("c div m").alias("__meshloom_each"), F.expr("c % m").alias("__meshloom_more"), F.col("m").alias("n_rows"), F.coalesce("first", "second").alias("__meshloom_first"), F.coalesce("second", "first").alias("__meshloom_second"))
    joined = docs.withColumn(KEY, key).join(times.drop("n_rows"), KEY)
    even = joined.where("__meshloom_more = 0").withColumn("__meshloom_copies", F.col("__meshloom_each"))
    odd = joined.where("__meshloom_more > 0").withColumn("__meshloom_at", hash60(F.monotonically_increasing_id())).withColumn("__meshloom_one", F.lit(1).cast("long"))
    odd = running_total(odd, KEY, "__meshloom_at", [], "__meshloom_one", times.where("__meshloom_more > 0").select(KEY, "n_rows"), "__meshloom_rank").withColumn("__meshloom_copies", F.col("__meshloom_each") + (F.col("__meshloom_rank") < F.col("__meshloom_more")).cast("long")).drop("__meshloom_at", "__meshloom_one", "__meshloom_rank")
    copies = even.unionByName(odd).where("__meshloom_copies > 0").withColumn("__meshloom_copy", F.explode(F.expr("sequence(1L, __meshloom_copies)")))
    return copies.sortWithinPartitions(F.when(F.col("__meshloom_copy") % 2 == 1, F.col("__meshloom_first")).otherwise(F.col("__meshloom_second"))).select(*docs.columns)


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, substr(md5(coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')), 1, 15) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][sid % 3 + 1] AS w FROM s),
o AS (
  SELECT *, (2 * n) / w AS cap,
    coalesce(sum(2 * n) OVER (ORDER BY (2 * n) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_before,
    sum(w) OVER (ORDER BY (2 * n) / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    1.5::DOUBLE * sum(n) OVER () AS total
  FROM w),
l AS (SELECT *, (total - full_before) / rest AS lev FROM o),
level AS (SELECT coalesce(max(lev) FILTER (WHERE lev <= cap), max(cap)) AS level FROM l),
t AS (SELECT *, least((2 * n)::DOUBLE, level * w) AS target, floor(least((2 * n)::DOUBLE, level * w))::BIGINT AS goal FROM w, level),
b AS (SELECT *, CASE {' '.join(f'WHEN goal >= {LEAST_SLOTS * x} THEN {x}' for x in BLOCKS[:-1])} ELSE {BLOCKS[-1]} END AS block FROM t),
c AS (
  SELECT *, sum(goal) OVER (PARTITION BY block) AS all_of, coalesce(sum(goal) OVER (PARTITION BY block ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
u AS (SELECT *, floor(before::DOUBLE / greatest(all_of, 1) * {1 << BITS})::BIGINT AS lo, floor((before + goal)::DOUBLE / greatest(all_of, 1) * {1 << BITS})::BIGINT AS hi FROM c),
slots AS (SELECT block, unnest(range(ceil(max(all_of)::DOUBLE / block)::BIGINT)) AS i FROM u GROUP BY block),
points AS (SELECT block, ((i // {1 << 20}) * {STEP * (1 << 20) % (1 << BITS)} + (i % {1 << 20}) * {STEP}) % {1 << BITS} AS x FROM slots),
k AS (SELECT sid, count(*) AS got FROM u JOIN points p ON p.block = u.block AND x >= lo AND x < hi GROUP BY sid),
p AS (
  SELECT doc_id, size, n, target, least(coalesce(got, 0) * block, 2 * n) AS goal,
    coalesce(sum(size) OVER (PARTITION BY u.sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized JOIN u ON sized.source IS NOT DISTINCT FROM u.source LEFT JOIN k ON k.sid = u.sid)
SELECT doc_id, size, n AS source_size, target,
  (greatest(0, least(start + size, goal) - start) + greatest(0, least(n + start + size, goal) - n - start))::BIGINT AS taken
FROM p
"""


def op2(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
