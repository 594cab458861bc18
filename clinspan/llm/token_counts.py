"""Token counts: map-side two-tier lookup, without a shuffle of pre-tokens.

The first tier is a compact hash table, pre-token -> number of tokens, broadcast once. By default it comes from the
tokenizer itself: byte-pair merges are ranked by frequency, so the vocabulary's entries (and their capitalised and
space-led forms) are the frequent pre-tokens of such text; its size depends on the tokenizer alone, never on the corpus.
Callers may pass pre-tokens of their own, the most frequent first. Each chunk between blanks is looked up in the table; only
those that it lacks (rare words, words with punctuation) go through the second tier, a bounded cache of the worker, and are
encoded if they aren't there either. The table only saves work, counts don't depend on it. One scan, no exchange.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import id_and_text, read_table, utf8
from .pretokens import BYTE_LEVEL, ByteLevelCounts, load_tokenizer, ranks

#: A table never has more entries than this.
MAX_FREQUENT = 200_000

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_lengths(path: str, pretokens: Iterable[str] | None = None) -> dict[str, int]:
    """The broadcast table. pretokens: the caller's own choice instead of the vocabulary's; the first MAX_FREQUENT of it."""
    tokenizer = load_tokenizer(path)
    if pretokens is None:
        by_rank = sorted(tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        plain = [tokenizer.decode([i], skip_special_tokens=False) for _, i in by_rank]
        words = {p for p in plain if "�" not in p and BYTE_LEVEL.fullmatch(p)}
        letters = {p.strip() for p in words if p.strip().isalpha()}
        pretokens = sorted(words | letters | {f" {q}" for p in letters for q in (p, p.capitalize())} | {p.capitalize() for p in letters})
    chosen = [p for p in dict.fromkeys(pretokens) if p][:MAX_FREQUENT]
    return {p: len(e.ids) for p, e in zip(chosen, tokenizer.encode_batch(chosen, add_special_tokens=False), strict=True)}


def splits_as_byte_level(path: str) -> bool:
    """Whether a tokenizer's file is what the two tiers know: byte-pair merges in the order of their ids over the byte-level
    pattern, with nothing before or beside it. Pre-tokens of any other are another library's to find."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    model, split = found.get("model") or {}, found.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "unk_token"))
    if found.get("normalizer") or model.get("type") != "BPE" or not plain:
        return False
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    try:
        ranks(path, b"")
    except (KeyError, ValueError, TypeError):
        return False
    return True


class LibraryCounts:
    """Numbers of tokens by the tokenizer's own library, whole text by whole text: for files of any other kind."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            self.ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
        else:
            tokenizer = load_tokenizer(path)
            self.ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.ids(text))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024, pretokens: Iterable[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; repeated rows and rows without an id are counted like others; an empty
    table gives an empty result; other columns are ignored, whatever their names. Texts are never cut. Tokenizers of another
    kind than ``splits_as_byte_level`` knows (.json of ``tokenizers``, .model of ``sentencepiece``) count by their library.
    """
    spark = docs.sparkSession
    path = os.fspath(tokenizer_path)
    tiers = splits_as_byte_level(path)
    table = spark.sparkContext.broadcast(frequent_lengths(path, pretokens) if tiers else {})

    def count(batches):
        tokens = ByteLevelCounts(path, table.value) if tiers else LibraryCounts(path)
        for batch in batches:
            ids, sizes, counts = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                sizes.append(len(text) if text.isascii() else len(utf8(text)))
                counts.append(tokens.count(text))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(count, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
