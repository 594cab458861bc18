"""Document fingerprints: a canonical exact digest; in equal buckets a second digest is compared, and bytes where that differs.

A text's canonical form is its compatibility normal form (NFKC), case-folded, normalised again, with every run of white
space as one blank and none at the ends. Its digest is the 128-bit xxh3 of the form's UTF-8. Rows are grouped by digest;
inside a group the forms' SHA-256 and lengths are compared first, 40 narrow bytes a row, so no text is shuffled for groups
whose rows agree in them, however many groups are shared: of equal buckets that comparison is the rule, bytes are the
exception. Where they differ under one digest, the canonical bytes themselves are fetched and compared: the second, third, ... form (by SHA-256) gets the suffix -1, -2, ...
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, id_and_text, join_copies, read_table, utf8

#: Ranges of ids per shuffle partition: several, since ranges are dealt to partitions by hash.
RANGES_PER_PARTITION = 4

#: Sampled beginnings of texts for each range of an id that fills several, and their length in code points.
CUT_SAMPLE, CUT_CHARS = 8, 128
#: Rows at the borders of ranges, which wait for their neighbours.
FIRST, LAST = 1, 2

#: A row beside the next one; of a row at a border only the first four columns.
PAIR_KINDS = {
    "range": "long", "kind": "int", "text": "string", "doc_id": "long", "n_chars": "long", "edited_sha256": "string", "digest": "string",
    "edited_digest": "string", "near_edited": "double", "near_next": "double", "form": "binary", "edited_form": "binary",
}
PAIR_SCHEMA = ", ".join(f"`{name}` {kind}" for name, kind in PAIR_KINDS.items())
ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = unicodedata.normalize("NFKC", text.casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(data: bytes, bits: int = 128) -> str:
    return xxhash.xxh3_128_hexdigest(data)[: bits // 4]


def form_mark(data: bytes) -> bytes:
    """SHA-256 and length of a canonical form: what tells forms of one digest apart."""
    return hashlib.sha256(data).digest() + len(data).to_bytes(8, "big")


def fingerprint_texts(docs: DataFrame, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, canonical, form (its mark) of each row of docs (null texts: empty)."""

    def run(batches):
        for batch in batches:
            forms = [canonical(t) for t in batch.column(1).to_pylist()]
            data = [utf8(c) for c in forms]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(d, bits) for d in data], pa.string()), pa.array(data, pa.binary()), pa.array(map(form_mark, data), pa.binary())], names=["doc_id", "digest", "canonical", "form"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest string, canonical binary, form binary")


def colliding_classes(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """(digest, form, ordinal) of the canonical forms of those digests that stand for several forms.

    texts: rows of ``fingerprint_texts``; rows: their digest and form, written before.
    """
    # Half of each digest's rows or more may be copies of one form: both halves of this aggregate keep two marks of it.
    clashing = cut(rows.groupBy("digest").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least <> most").select("digest"))
    shape = "digest string, form binary, ordinal int"
    if clashing.isEmpty():
        return rows.sparkSession.createDataFrame([], shape)
    forms = texts.join(clashing, "digest", "left_semi").groupBy("digest", "canonical").agg(F.min("form").alias("form")).select("digest", "form")
    return forms.withColumn("ordinal", F.row_number().over(Window.partitionBy("digest").orderBy("form")) - 1)


def _with_suffix(rows: DataFrame, classes: DataFrame, name: str, form: str) -> DataFrame:
    found = classes.select(F.col("digest").alias(name), F.col("form").alias(form), F.col("ordinal").alias(f"{name}_ordinal"))
    joined = rows.join(found, [name, form], "left")
    more = F.col(f"{name}_ordinal") > 0
    return joined.withColumn(name, F.when(more, F.concat(F.col(name), F.lit("-"), F.col(f"{name}_ordinal"))).otherwise(F.col(name))).drop(f"{name}_ordinal")


def canonical_classes(docs: DataFrame, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, class_id (smallest doc_id of the class), class_size: documents with equal canonical bytes.

    Null and empty texts form one class; null ids count in class_size; repeated rows count each; an empty table gives an
    empty result.
    """
    texts = fingerprint_texts(docs, bits, id_col, text_col)
    rows = cut(texts.select("doc_id", "digest", "form"))
    classes = cut(colliding_classes(texts, rows))
    named = rows if classes.isEmpty() else _with_suffix(rows, classes, "digest", "form")
    named = named.select("doc_id", F.col("digest").alias("fingerprint"))
    groups = named.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return join_copies(named, cut(groups.withColumn("copies", F.col("class_size"))), "fingerprint").select("doc_id", "fingerprint", "class_id", "class_size")


def _cuts(docs: DataFrame, n: int) -> tuple[np.ndarray, dict[int | None, list[str]]]:
    """Bounds of about n ranges of ids of like numbers of rows, ascending; and for each id that fills several of them (None:
    rows without an id) the beginnings of texts at which its rows are cut.

    One pass over ids. Only where an id fills several ranges a second pass samples the beginnings of its texts, about
    CUT_SAMPLE for each range: a cut decides where a row is sorted, never whether or how it is compared.
    """
    rows, known, quantiles = docs.agg(F.count(F.lit(1)), F.count("doc_id"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 4 * n)).first()
    filled = {i: c for i, c in Counter(quantiles or []).items() if c > 1}
    if n * (rows - known) > rows:
        filled[None] = -(-n * (rows - known) // rows)
    bounds = np.unique(np.array(quantiles or [], dtype="int64"))
    if not filled:
        return bounds, {}
    held = docs["doc_id"].isin([i for i in filled if i is not None])
    if None in filled:
        held = held | docs["doc_id"].isNull()
    starts = docs.where(held).sample(min(1.0, CUT_SAMPLE * n / rows), seed=0).select("doc_id", F.substring("text", 1, CUT_CHARS).alias("start"))
    seen = defaultdict(list)
    for doc_id, start, count in starts.groupBy("doc_id", "start").count().orderBy("start").collect():
        seen[doc_id].append((start, count))
    cuts = {}
    for doc_id, found in seen.items():
        ends = np.cumsum([count for _, count in found])
        at = np.searchsorted(ends, np.arange(1, filled[doc_id]) * ends[-1] / filled[doc_id])
        cuts[doc_id] = sorted({found[i][0] for i in at})
    return bounds, cuts


def _dealt(docs: DataFrame, n: int) -> DataFrame:
    """docs with the number of their range: ascending numbers go with descending ids (null last), equal ids with ascending texts."""
    bounds, cuts = _cuts(docs, n)
    step = n + 1

    @F.pandas_udf("long")
    def range_of(doc_id: pd.Series, no_id: pd.Series, start: pd.Series) -> pd.Series:
        ids = doc_id.to_numpy()
        place = len(bounds) - np.searchsorted(bounds, ids, side="right")
        out = np.where(no_id, len(bounds) + 1, place) * step
        for row in np.flatnonzero(start.notna()):
            # In the range that begins with this id, larger ids come before all its rows.
            out[row] += 1 + bisect.bisect_right(cuts[None if no_id[row] else int(ids[row])], start[row])
        return pd.Series(out)

    split = F.when(docs["doc_id"].isNull(), F.lit(None in cuts)).otherwise(docs["doc_id"].isin([i for i in cuts if i is not None]))
    start = F.when(split, F.substring("text", 1, CUT_CHARS))
    return docs.withColumn("range", range_of(F.coalesce("doc_id", F.lit(0)), F.isnull("doc_id"), start))


def _columns(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * len(PAIR_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(columns, PAIR_KINDS.values(), strict=True)], names=list(PAIR_KINDS))


class _Row:
    """A text with its canonical form and the digest of that."""

    def __init__(self, doc_id, text: str, bits: int):
        self.doc_id, self.text, self.form = doc_id, text, utf8(canonical(text))
        self.digest, self.bits = digest(self.form, bits), bits

    def followed_by(self, after: _Row) -> tuple:
        half = len(self.text) // 2
        edited = self.text[: len(self.text) - half] + after.text[:half]
        form = utf8(canonical(edited))
        mark = digest(form, self.bits)
        return (
            *(None, None, None, self.doc_id, len(self.text), hashlib.sha256(utf8(edited)).hexdigest(), self.digest, mark),
            *(float(self.digest == mark and self.form == form), float(self.digest == after.digest and self.form == after.form)),
            *(form_mark(self.form), form_mark(form)),
        )

    def border(self, in_range: int, kind: int) -> tuple:
        return (in_range, kind, self.text, self.doc_id, *[None] * (len(PAIR_KINDS) - 4))


def following_pairs(docs: DataFrame, bits: int = 128) -> DataFrame:
    """Rows of PAIR_KINDS: each row of docs (doc_id, text) beside the next one in descending order of doc_id (null last, equal
    ids by text); after the last comes the first.

    Texts are read once and shuffled once, by range. Inside a range a row meets the next; of each range the first and the
    last row are written with their texts, and a second, small step joins a range's last row with the first of the next.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _dealt(docs, parts * RANGES_PER_PARTITION)
    rows = rows.repartition(parts, "range").sortWithinPartitions("range", F.col("doc_id").desc_nulls_last(), "text").select("range", "doc_id", "text")

    def inside(batches):
        at, before = None, None
        for batch in batches:
            out = []
            for in_range, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                row = _Row(doc_id, text, bits)
                if in_range == at:
                    out.append(before.followed_by(row))
                else:
                    out += [before.border(at, LAST)] if before else []
                    out.append(row.border(in_range, FIRST))
                at, before = in_range, row
            yield _columns(out)
        if before:
            yield _columns([before.border(at, LAST)])

    def across(batches):
        for batch in batches:
            found = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            yield _columns([_Row(doc_id, text, bits).followed_by(_Row(None, after, bits)) for doc_id, text, after in found])

    met = cut(rows.mapInArrow(inside, PAIR_SCHEMA))
    firsts = met.where(F.col("kind") == FIRST).select(F.col("range").alias("next_range"), F.col("text").alias("after"))
    ranges = sorted(r["next_range"] for r in firsts.select("next_range").collect())  # one a range
    following = docs.sparkSession.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range long, next_range long")
    lasts = met.where(F.col("kind") == LAST).select("range", "doc_id", "text").join(following, "range").join(firsts, "next_range")
    return met.where(F.col("kind").isNull()).unionByName(lasts.select("doc_id", "text", "after").mapInArrow(across, PAIR_SCHEMA))


def edited_fingerprints(docs: DataFrame, bits: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last floor(n_chars / 2) code points are the first as many
    (or all) of the next document in descending order of doc_id; after the last document comes the first.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The digest is exact,
    so a likeness is 1.0 where digests and canonical bytes are equal, else 0.0. Null texts count as empty; null ids stand
    after all others; equal ids are ordered by text; a single document follows itself; an empty table gives an empty result.
    """
    texts = id_and_text(docs, id_col, text_col)
    pairs = cut(following_pairs(texts, bits))
    classes = cut(colliding_classes(fingerprint_texts(texts, bits), pairs.select("digest", "form")))
    if not classes.isEmpty():
        pairs = _with_suffix(_with_suffix(pairs, classes, "digest", "form"), classes, "edited_digest", "edited_form")
    return pairs.select("doc_id", "n_chars", "edited_sha256", F.col("digest").alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(read_table(spark, sf_dir, "documents"))
