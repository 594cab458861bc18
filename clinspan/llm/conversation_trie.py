"""The prefix trie of conversations, peeled from its deepest nodes up.

A node is a sequence of first turns. Each conversation's path is a list of keys, one for each depth: 128 bits that all turns
up to there take part in. From the deepest level up, the conversations that end at a depth are merged with the nodes that
survive from the level below; the last turn of each is stripped, and what is equal then is one node. A round reads one row for
each node of the level below, finds the nodes of its level and adds up their subtrees, in one grouping with partial sums.

Turns that a conversation shares with no other are nodes of one member each; they are known by their counts, need no rounds,
and aren't gathered. So there are as many rounds as the deepest shared node has turns.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinspan.operators.scan import running

from ._common import cut, fresh_dir, read_table

#: Turn numbers, and depths, of one conversation that a task sorts together; ids of a node that stand in one string.
SLICE, IDS = 4096, 4096
WORD = r"[^\x20\x09-\x0D]+"
NO_TURN = -(1 << 62)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 1), role, digest, words: turns in order; those of one number by role and the SHA-256 of their texts."""
    text = F.coalesce(conversations[text_col].cast("string"), F.lit(""))
    rows = conversations.select(
        conversations[conv_col].cast("long").alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"),
        F.sha2(text, 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    ).where("conv_id is not null").withColumn("_slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(NO_TURN)))
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    return running(rows, ["conv_id"], "_slice", order, {"pos": (F.lit(1), F.sum, lambda a, b: a + b, 0)}).drop("_slice", "turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, depth, role, digest, words) of rebuilt conversations, and conv_id, n_turns of all of them.

    A conversation c starts with the first crc32(c) % 4 turns of conversation c - c % 20 instead of its own."""
    borrowed_most = F.crc32(F.col("conv_id").cast("string")) % 4
    own = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = own.select("conv_id", "n", borrowed_most.alias("h"), (F.col("conv_id") - F.col("conv_id") % 20).alias("of"))
    convs = convs.join(own.select(F.col("conv_id").alias("of"), F.col("n").alias("n_of")), "of", "left")
    convs = convs.withColumn("p", F.least("h", F.coalesce("n_of", F.lit(0)))).select("conv_id", "h", "p", "of", (F.col("p") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    heads = turns.where("pos <= 3").withColumnsRenamed({"conv_id": "of", "pos": "depth"})
    head = convs.join(heads, "of").where("depth <= p").select("conv_id", "depth", "role", "digest", "words")
    tail = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("p")).alias("depth"), "role", "digest", "words")
    return head.unionByName(tail), convs.select("conv_id", "n_turns")


def keyed(rows: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2, words: k1 and k2 are of all turns up to depth, each at its depth."""
    parts = {"k1": F.xxhash64("depth", "role", "digest"), "k2": F.xxhash64("digest", F.lit(7), "role", "depth")}
    sliced = rows.withColumn("_slice", F.floor(F.col("depth") / SLICE))
    xor = lambda a, b: a.bitwiseXOR(b)
    return running(sliced, ["conv_id"], "_slice", ["depth"], {k: (v, F.bit_xor, xor, 0) for k, v in parts.items()}).select("conv_id", "depth", "k1", "k2", "words")


def ends_of(ended: DataFrame) -> DataFrame:
    """depth, k1, k2, ends: the SHA-256 of the ids (conv_id) that end there, ascending, joined by commas.

    Ids are sorted in pieces of bounded length; the pieces of a node stream in order through one task, which keeps the state
    of one hash, however many copies a conversation has."""
    chunk = F.floor(F.col("conv_id") / IDS).alias("chunk")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    pieces = ended.groupBy("depth", "k1", "k2", chunk).agg(ids)

    def run(batches):
        last, state, out = None, None, []
        for batch in batches:
            for depth, k1, k2, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (depth, k1, k2) == last:
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = (depth, k1, k2), hashlib.sha256()
                state.update(text.encode())
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if last is not None:
            out.append((*last, state.hexdigest()))
        yield batch_of(out)

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "k1", "k2", "ends"])

    sorted_ = pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "chunk")
    return sorted_.mapInArrow(run, "depth long, k1 long, k2 long, ends string")


SHARED = "path array<struct<k1:bigint,k2:bigint,words:bigint>>, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def peel(starts: DataFrame, folder: str) -> DataFrame:
    """Nodes (depth, k1, k2, up1, up2, conv_id, n_convs, n_children, n_leaves, saved_tokens) of the shared part.

    starts: a row for each node that something ends at: depth, path (its keys and words, from depth 1), conv_id (smallest),
    n_convs, n_children and n_leaves (of what goes on alone below it). Each level is written below folder, read once for the
    next level and once for the result."""
    spark = starts.sparkSession
    deepest = starts.agg(F.max("depth")).first()[0]
    if deepest is None:
        return spark.createDataFrame([], "depth long, k1 long, k2 long, up1 long, up2 long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    levels, below = [], None
    for depth in range(deepest, -1, -1):
        rows = starts.where(F.col("depth") == depth).select("path", "conv_id", "n_convs", "n_children", "n_leaves", F.lit(0).cast("long").alias("saved_tokens"))
        if below is not None:
            stripped = F.slice("path", 1, depth).alias("path")
            rows = rows.unionByName(below.select(stripped, "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens"))
        last = F.element_at("path", depth) if depth else F.lit(None)
        key = {k: last[k] if depth else F.lit(0).cast("long") for k in ("k1", "k2")}
        found = rows.withColumns(key).groupBy("k1", "k2").agg(F.any_value("path").alias("path"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
        words = F.element_at("path", depth)["words"] if depth else F.lit(0)
        level = found.select(
            "path", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves")).alias("n_leaves"),
            (F.col("saved_tokens") + (F.col("n_convs") - 1) * words).alias("saved_tokens"),
        )
        level.write.parquet(f"{folder}/{depth}")
        below = spark.read.schema(SHARED).parquet(f"{folder}/{depth}")
        at = lambda d, k: F.element_at("path", d)[k] if d > 0 else F.lit(0).cast("long")
        levels.append(below.select(F.lit(depth).cast("long").alias("depth"), at(depth, "k1").alias("k1"), at(depth, "k2").alias("k2"), at(depth - 1, "k1").alias("up1"), at(depth - 1, "k2").alias("up2"), "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"))
    return reduce(DataFrame.unionByName, levels)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conversation's id are left out, since no node could name them; null turns come first, null roles and texts
    are empty; turns of one number stand by role and digest, and repeated rows are turns of their own. An empty table gives an
    empty result; other columns are ignored, whatever their names. Long conversations are sorted in slices of their turn
    numbers (of a turn number that very many rows share, all rows are one slice). Rounds grow with the turns that the deepest
    pair of conversations shares.
    """
    spark = conversations.sparkSession
    turns = cut(numbered(conversations, conv_col, turn_col, role_col, text_col))
    rows, convs = rebuilt(turns)
    rows, convs = cut(keyed(rows)), cut(convs)
    # Turns that one conversation has alone; they are its last ones.
    counted = rows.groupBy("depth", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    alone = cut(counted.where("n = 1").select("conv_id", "depth"))
    shared = convs.join(alone.groupBy("conv_id").agg((F.min("depth") - 1).alias("u")), "conv_id", "left").withColumn("u", F.coalesce("u", "n_turns"))
    shared = cut(shared)
    upper = cut(rows.join(shared.select("conv_id", "u"), "conv_id").where("depth <= u"))
    here = upper.where("depth = u").select("conv_id", "k1", "k2")
    ends = cut(shared.join(here, "conv_id", "left").na.fill(0, ["k1", "k2"]))  # conv_id, n_turns, u, and the key of its last shared node
    goes_on = (F.col("n_turns") > F.col("u")).cast("long")
    starts = ends.groupBy(F.col("u").alias("depth"), "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(goes_on).alias("n_children"), F.sum(goes_on).alias("n_leaves"))
    paths = upper.join(starts.select("conv_id"), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "words"))).alias("path"))
    short = F.transform(F.coalesce("path", F.array().cast("array<struct<depth:bigint,k1:bigint,k2:bigint,words:bigint>>")), lambda x: F.struct(x["k1"], x["k2"], x["words"]))
    starts = cut(starts.join(paths, "conv_id", "left").withColumn("path", short))
    nodes = peel(starts, fresh_dir(spark, "trie"))

    ended = ends_of(ends.where("n_turns = u").select(F.col("u").alias("depth"), "k1", "k2", "conv_id"))
    upper_nodes = nodes.join(ended, ["depth", "k1", "k2"], "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY_SHA256)))
    first_alone = F.col("depth") == F.col("u") + 1
    last_alone = F.col("depth") == F.col("n_turns")
    lower_nodes = alone.join(ends.withColumnsRenamed({"k1": "up1", "k2": "up2"}), "conv_id").select(
        "depth", F.when(first_alone, F.col("up1")).alias("up1"), F.when(first_alone, F.col("up2")).alias("up2"), "conv_id", F.lit(1).cast("long").alias("n_convs"), F.when(last_alone, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last_alone, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY_SHA256).alias("ends"),
    )
    every = upper_nodes.drop("k1", "k2").unionByName(lower_nodes)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(parents, ["depth", "up1", "up2"], "left")
    up = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))  # below a turn of its own a conversation is its own parent
    return out.select("conv_id", "depth", up.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
SQL = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {_CRC} % 4 AS h, c - c % 20 AS b FROM (SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM turns)),
borrowed AS (SELECT c, h, (SELECT count(*) FROM turns WHERE conv_id = b AND pos <= h) AS p, b FROM convs),
rebuilt AS (SELECT c, pos AS depth, role, text FROM borrowed JOIN turns ON conv_id = b AND pos <= h UNION ALL SELECT c, pos - h + p, role, text FROM borrowed JOIN turns ON conv_id = c AND pos > h),
rows AS (SELECT c, depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, sha256(string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (PARTITION BY c ORDER BY depth)) AS k FROM rebuilt UNION ALL SELECT c, 0, 0, '' FROM convs),
lengths AS (SELECT c, max(depth) AS n FROM rows GROUP BY 1),
nodes AS (SELECT depth, k, min(c) AS m, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = n), '')) AS ends FROM rows JOIN lengths USING (c) GROUP BY 1, 2),
up AS (SELECT x.*, p.k AS pk, p.m AS pm FROM nodes x LEFT JOIN rows r ON r.c = x.m AND r.depth = x.depth - 1 LEFT JOIN nodes p ON p.depth = r.depth AND p.k = r.k),
children AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN children USING (depth, k)),
sums AS (SELECT r.depth, r.k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * x.words) AS saved FROM full_nodes x JOIN rows r ON r.c = x.m AND r.depth <= x.depth GROUP BY 1, 2)
SELECT m AS conv_id, depth, pm AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 FROM full_nodes JOIN sums USING (depth, k)
"""
