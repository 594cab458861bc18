"""Mixing sources to target weights by a low-discrepancy schedule.

1. Sizes and targets: one row per source. Targets fill up by weight until each stops at ``cap`` times its source's size.
2. Every source's documents are shuffled by a hash; their words make one stream, cut in blocks of equal size. A document's
   place in its stream comes from sums over (source, hash range) and a window inside each, so a source that has a third of
   all documents is dealt to as many tasks as there are hash ranges.
3. The schedule: slot t takes the golden-ratio point frac((t + 1) / phi), in units of 2^-64, through the cumulative
   shares of slots to a source. Slots are ranked per source by counts per (source, run of slots) and a local rank in each run. The rank says
   which block a slot takes; ranks beyond a source's quota are passed over, and a quota that the points miss by a few
   slots (their discrepancy is logarithmic) is filled after the last slot.
4. Slots are joined with blocks by (source, block): how often a block is taken gives what each document contributes, and
   the first slot of its blocks in a round is the document's place in the mix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinspan.sources.scratch import kept

from ._common import cut, read_table

#: Weights of the sources by code point, repeating, null last; share of all sizes; most that a source gives, in its sizes.
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2
#: Words of a block at most, and blocks that a target is made of at least (smaller sources have smaller blocks).
BLOCK_WORDS, LEAST_BLOCKS = 4096, 1024
#: Slots of a run, documents of a hash range (about), and the seed of the shuffle.
RUN_SLOTS, RANGE_DOCS, SEED = 1 << 14, 512, "mix"
#: The golden ratio less 1, in units of 2^-64: points are exact whole numbers, the same in every engine.
GOLDEN = 11400714819323198485

WORDS = r"[^\x20\x09-\x0D]+"


def mark_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    return F.xxhash64(docs[id_col].cast("long"), docs[source_col].cast("string"), docs[text_col].cast("string"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, mark (a hash of id, source and text), size (words; null text: 0)."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), mark_of(docs, id_col, text_col, source_col).alias("mark"), F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, place, weight, source_size, target, block_words, quota (blocks that the mix takes), one row per source.

    A target is least(cap * size, level * weight), where level lets all targets sum to share of all sizes: what resharing
    the excess by weight ends at. Sources stop in the order of cap * size / weight, so one running sum finds the level.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a table of sources, not of documents
    everything = Window.partitionBy()
    w = sums.withColumn("place", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    w = w.withColumn("budget", F.sum("source_size").over(everything) * F.lit(share)).withColumn("most", (F.col("source_size") * cap).cast("double"))
    up = Window.orderBy(F.col("most") / F.col("weight"), "place")
    w = w.withColumn("stopped", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weights_left", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    w = w.withColumn("level_here", (F.col("budget") - F.col("stopped")) / F.col("weights_left"))
    # The first source, in that order, that the level does not fill; if all are filled, all stop.
    w = w.withColumn("level", F.min(F.when(F.col("level_here") * F.col("weight") <= F.col("most"), F.struct("stopped", "level_here"))).over(everything)["level_here"])
    w = w.withColumn("target", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight"))))
    w = w.withColumn("block_words", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("target") / LEAST_BLOCKS))).cast("long"))
    # The number of blocks whose words come nearest to the target; the last block of a pass may be short.
    per_pass = F.ceil(F.col("source_size") / F.col("block_words")).cast("long")
    done = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    rest = F.col("target") - done * F.col("source_size")
    low = F.floor(rest / F.col("block_words")).cast("long")
    short = F.least((low + 1) * F.col("block_words"), F.col("source_size"))
    more = F.when((low < per_pass) & (short - rest < rest - low * F.col("block_words")), low + 1).otherwise(low)
    w = w.withColumn("quota", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(done * per_pass + more, cap * per_pass)).cast("long"))
    return w.select("source", "place", "weight", "docs", "source_size", "target", "block_words", per_pass.alias("pass_blocks"), "quota")


def streams(rows: DataFrame, table: DataFrame, seed: str = SEED) -> DataFrame:
    """rows with place (of the source), source_size, target, block_words and start: the document's first word in its
    source's stream, whose order is that of md5(doc_id:seed), then doc_id, size and mark."""
    n = max(1, int((table.agg(F.sum("docs")).first()[0] or 0) / RANGE_DOCS))
    ranges = 1 << min(20, (n - 1).bit_length())
    facts = table.select("source", "place", "source_size", "target", "block_words", "quota")
    facts = kept(facts, "sources")  # Spark sends it to all tasks or shuffles by the size of its files
    named = rows.join(facts, rows["source"].eqNullSafe(facts["source"])).drop(facts["source"])
    hashed = named.withColumn("hash", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))))
    hashed = hashed.withColumn("range", F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long"), 32 - (ranges.bit_length() - 1)))
    sums = hashed.groupBy("place", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("place", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "range").orderBy("hash", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hashed.withColumn("upto", F.sum("size").over(within)).join(bases, ["place", "range"])
    return placed.withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("hash", "range", "upto", "base")


def schedule(spark: SparkSession, table: DataFrame) -> DataFrame:
    """slot, place, rank, block, round: which block of which source each slot takes, in the order of the mix.

    rank counts a source's slots from 0; block = rank modulo the blocks of a pass, round = the pass.
    """
    quotas = table.where("quota > 0").select("place", "quota", "pass_blocks").orderBy("place")
    few = quotas.toPandas()  # one row per source
    if not len(few):
        return spark.createDataFrame([], "slot long, place int, rank long, block long, round long")
    place, quota, blocks = (few[c].to_numpy() for c in ("place", "quota", "pass_blocks"))
    total = int(quota.sum())
    edges = np.array([-(-(int(x) << 64) // total) for x in np.cumsum(quota)[:-1]], dtype=np.uint64)

    def sources(first: int, last: int) -> np.ndarray:
        points = np.arange(first + 1, last + 1, dtype=np.uint64) * np.uint64(GOLDEN)  # modulo 2^64
        return np.searchsorted(edges, points, side="right")

    runs = -(-total // RUN_SLOTS)
    parts = min(runs, int(spark.conf.get("spark.sql.shuffle.partitions")) * 2)
    starts = spark.range(0, runs, 1, parts)

    def counts(batches):
        for batch in batches:
            for run in batch.column(0).to_pylist():
                found = np.bincount(sources(run * RUN_SLOTS, min(total, (run + 1) * RUN_SLOTS)), minlength=len(place))
                held = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), run)), pa.array(held.astype("int32")), pa.array(found[held].astype("int64"))], names=["run", "i", "n"])

    before = Window.partitionBy("i").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = cut(starts.mapInArrow(counts, "run long, i int, n long"))
    bases = per_run.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    per = bases.groupBy("run").agg(F.collect_list(F.struct("i", "base")).alias("bases"))  # sources per run at most

    def ranked(batches):
        for batch in batches:
            for run, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first = run * RUN_SLOTS
                source = sources(first, min(total, first + RUN_SLOTS))
                base = np.zeros(len(place), dtype="int64")
                for x in firsts:
                    base[x["i"]] = x["base"]
                order = np.argsort(source, kind="stable")
                begin = np.searchsorted(source[order], np.arange(len(place)))
                rank = np.empty(len(source), dtype="int64")
                rank[order] = np.arange(len(source)) - begin[source[order]]
                rank += base[source]
                kept = rank < quota[source]
                yield batch_of(first + np.flatnonzero(kept), source[kept], rank[kept])

    def missed(batches):
        """Ranks that the points have not reached."""
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rank = np.arange(n, quota[i])
                yield batch_of(np.full(len(rank), total), np.full(len(rank), i), rank)

    def batch_of(slot, source, rank):
        return pa.RecordBatch.from_arrays([pa.array(slot.astype("int64")), pa.array(place[source].astype("int32")), pa.array(rank.astype("int64")), pa.array((rank % blocks[source]).astype("int64")), pa.array((rank // blocks[source]).astype("int64"))], names=["slot", "place", "rank", "block", "round"])

    shape = "slot long, place int, rank long, block long, round long"
    reached = per_run.groupBy("i").agg(F.sum("n").alias("n"))
    every = spark.range(len(place)).select(F.col("id").cast("int").alias("i")).join(reached, "i", "left").select("i", F.coalesce("n", F.lit(0)).alias("n"))
    return per.mapInArrow(ranked, shape).unionByName(every.mapInArrow(missed, shape))


def fragments(placed: DataFrame) -> DataFrame:
    """doc rows cut at block borders: place, block, doc_id, size, first (word in the document), words."""
    first, last = F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_words"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.greatest(F.col("start"), F.col("block") * F.col("block_words")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    return pieces.withColumn("first", low - F.col("start")).withColumn("words", high - low)


def contributions(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs, with taken_0, taken_1, ...: the words that each round takes of it, from its first word on,
    and slot_0, slot_1, ...: the first slot that takes of it in that round (null if none does), its place in the mix."""
    rows = cut(sized(docs, id_col, text_col, source_col))
    table = cut(targets(rows, weights, share, cap))
    placed = cut(streams(rows, table, seed))
    rounds = range(cap)
    times = schedule(docs.sparkSession, table).groupBy("place", "block").agg(*(F.count_if(F.col("round") == r).alias(f"times_{r}") for r in rounds), *(F.min(F.when(F.col("round") == r, F.col("slot"))).alias(f"first_{r}") for r in rounds))
    kept = ["doc_id", "source", "mark", "size", "source_size", "target", "block_words", "quota", "place", "start"]
    # Documents with words have starts of their own in their source, so this sums each document's blocks.
    given = fragments(placed).join(times, ["place", "block"], "left").groupBy(*kept).agg(*(F.sum(F.col("words") * F.coalesce(F.col(f"times_{r}"), F.lit(0))).cast("long").alias(f"taken_{r}") for r in rounds), *(F.min(f"first_{r}").alias(f"slot_{r}") for r in rounds))
    empty = placed.where("size = 0").select(*kept, *(F.lit(0).cast("long").alias(f"taken_{r}") for r in rounds), *(F.lit(None).cast("long").alias(f"slot_{r}") for r in rounds))
    return given.unionByName(empty).drop("place")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, mark, size, source_size, target, block_words, quota, start, taken, slots: one row per row of docs.

    taken counts the words that the mix takes of the row, repeats included, at most cap times its size; slots are its
    places in the order of the mix, one for each round that takes of it (empty if none does). Null texts have
    size 0 and give nothing; a null source is a source of its own, the last; rows without an id and repeated rows are
    mixed like others; an empty table gives an empty result; other columns are ignored, whatever their names. Ties in the
    shuffle are ordered by id, size and text, so reruns agree.
    """
    out = contributions(docs, weights, share, cap, seed, id_col, text_col, source_col)
    out = out.withColumn("taken", sum((F.col(f"taken_{r}") for r in range(cap)), F.lit(0)).cast("long"))
    out = out.withColumn("slots", F.array_compact(F.array(*(F.col(f"slot_{r}") for r in range(cap)))))
    return out.drop(*(f"{name}_{r}" for name in ("taken", "slot") for r in range(cap)))


def mixed_documents(docs: DataFrame, cap: int = CAP, chars_col: str = "n_chars", **settings) -> DataFrame:
    """The mix itself, with the columns of docs (doc_id, text, source, n_chars and others): a row for each round that
    takes of a document. A document at the end of a source's last block is cut after the last word that is taken. Rows are
    dealt by hash, and each partition stands in the order of the mix, so any stretch of its file has the sources in
    proportion. Texts are shuffled once, by their marks."""
    given = contributions(docs, cap=cap, **settings)
    both = F.filter(F.array(*(F.struct(F.col(f"taken_{r}").alias("take"), F.col(f"slot_{r}").alias("slot")) for r in range(cap))), lambda t: t["take"] > 0)
    takes = given.select(F.col("mark").alias("_mark"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), both.alias("_takes")).where("size(_takes) > 0")
    # Rows alike in id, source and text are one here, with all their takes.
    takes = takes.groupBy("_mark", "_id", "_size").agg(F.flatten(F.collect_list("_takes")).alias("_takes"))
    same = Window.partitionBy("_mark").orderBy("doc_id", *(c for c in docs.columns if c not in ("doc_id", "text")))
    marked = docs.withColumn("_mark", mark_of(docs))
    own = marked.withColumn("_before", F.lag(F.struct("doc_id")).over(same)).where(~F.col("_before").eqNullSafe(F.struct("doc_id"))).drop("_before")
    # A mark of 64 bits may stand for rows of other ids. They are told apart after the join, by an expression that is no
    # join key, so that the window's shuffle serves the join.
    other = F.coalesce(F.col("doc_id").cast("long").bitwiseXOR(F.col("_id")), F.when(F.col("doc_id").isNull() & F.col("_id").isNull(), F.lit(0)), F.lit(1))
    joined = own.join(takes, "_mark").where(other == 0)
    rows = joined.withColumn("_take", F.explode("_takes")).withColumns({"_slot": F.col("_take")["slot"], "_take": F.col("_take")["take"]})
    blanks = r"[\x20\x09-\x0D]+"
    # Splitting off the first words leaves the rest as the last element.
    parts = F.split("text", blanks, (F.col("_take") + 1 + F.col("text").rlike(f"^{blanks}").cast("int")).cast("int"))
    head = F.regexp_replace(F.substring(F.col("text"), F.lit(1), F.length("text") - F.length(F.element_at(parts, -1))), f"{blanks}$", "")
    partial = F.col("_take") < F.col("_size")
    text = F.when(partial, head).otherwise(F.col("text"))
    return rows.withColumn(chars_col, F.when(partial, F.length(head)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)).withColumn("text", text).sortWithinPartitions("_slot", "doc_id", "_mark").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.array_min("slots"), F.lit(-1)).alias("first_slot"))


#: The same rows: a source's mix is its stream, twice over, up to the last block of its quota; the schedule gives the slots.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, CAST(CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget, CAST(source_size * 2 AS DOUBLE) AS most FROM s
), u AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w
), v AS (
  SELECT *, (SELECT (budget - stopped) / weights_left FROM u WHERE (budget - stopped) / weights_left * weight <= most ORDER BY stopped, place LIMIT 1) AS level FROM u
), t AS (
  SELECT *, CASE WHEN level IS NULL THEN most ELSE least(most, level * weight) END AS target FROM v
), b AS (
  SELECT *, CAST(greatest(1, least(4096, floor(target / 1024))) AS BIGINT) AS block_words FROM t
), p AS (
  SELECT *, (source_size + block_words - 1) // block_words AS pass_blocks, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS done FROM b
), r AS (
  SELECT *, target - done * source_size AS rest, CAST(floor((target - done * source_size) / block_words) AS BIGINT) AS low FROM p
), q AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(done * pass_blocks + CASE WHEN low < pass_blocks AND least((low + 1) * block_words, source_size) - rest < rest - low * block_words THEN low + 1 ELSE low END, 2 * pass_blocks) END AS quota FROM r
), e AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE quota // pass_blocks * source_size + least(quota % pass_blocks * block_words, source_size) END AS words FROM q
), o AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.words, e.place, e.block_words,
    coalesce(sum(d.size) OVER (PARTITION BY e.place ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':mix'), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), g AS (
  SELECT place, quota, pass_blocks, sum(quota) OVER (ORDER BY place) AS upto, sum(quota) OVER () AS slots FROM e WHERE quota > 0
), h AS (
  SELECT place, quota, pass_blocks, slots, ((upto - quota)::HUGEINT * 18446744073709551616 + slots - 1) // slots AS low, (upto::HUGEINT * 18446744073709551616 + slots - 1) // slots AS high FROM g
), i AS (
  SELECT slot, ((slot + 1)::HUGEINT * 11400714819323198485) % 18446744073709551616 AS point FROM (SELECT unnest(range((SELECT max(slots)::BIGINT FROM g))) AS slot)
), j AS (
  SELECT place, pass_blocks, quota, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM i JOIN h ON point >= low AND point < high
), n AS (
  SELECT place, pass_blocks, slots, unnest(range(met, quota::BIGINT)) AS rank FROM (SELECT h.place, pass_blocks, quota, slots, (SELECT count(*) FROM j WHERE j.place = h.place) AS met FROM h)
), k AS (
  SELECT place, rank % pass_blocks AS block, min(slot) AS slot
  FROM (SELECT place, pass_blocks, rank, slot FROM j WHERE rank < quota UNION ALL SELECT place, pass_blocks, rank, slots FROM n) GROUP BY 1, 2
), l AS (
  SELECT o.*, (SELECT min(slot) FROM k WHERE k.place = o.place AND block BETWEEN start // block_words AND (start + size - 1) // block_words AND size > 0) AS first_slot FROM o
)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - source_size - start)) AS BIGINT) AS taken,
  CAST(coalesce(first_slot, -1) AS BIGINT) AS first_slot
FROM l
"""
