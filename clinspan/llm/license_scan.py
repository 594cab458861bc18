"""License scans: fuzzy search for short notices.

A notice of up to k errors, cut in k + 1 pieces, has at least one piece without an error (pigeonhole principle). The
pieces of all notices are exact seeds of one automaton; around each seed that occurs, the regex library matches the whole
notice with bounded errors and gives its place and its number of edits. Texts are searched as lower-case words with single
blanks between them; spans are given in words and in code points of the text itself. Base phrases count exact places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import id_and_text, read_table, utf8

# Words, as the base phrases take them, with the capitals that folding makes small (fixed value).
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Base phrases and their labels (fixed values).
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
#: One error for each so many characters of a notice, at least one.
CHARS_PER_ERROR = 12
#: The separators as blanks, A-Z as a-z, all other bytes of UTF-8 as they are.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, found array<struct<label:string,start:int,end:int,first_word:int,edits:int,notice_chars:int>>"


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    errors: int

    def seeds(self, per_error: int = 1) -> list[tuple[int, str]]:
        """(offset, piece): per_error * (errors + 1) pieces of about equal length."""
        n = per_error * (self.errors + 1)
        edges = [len(self.text) * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Searcher:
    """The automaton of all seeds, and each notice's fuzzy pattern."""

    def __init__(self, notices: tuple[tuple[str, str], ...]):
        import ahocorasick
        import regex

        self.notices = [Notice(t, label, max(1, len(t) // CHARS_PER_ERROR)) for t, label in notices]
        self.patterns = [regex.compile(rf"(?b)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.errors}}}") for n in self.notices]
        self.halves = [[(offset, offset + len(piece), piece) for offset, piece in n.seeds(2)] for n in self.notices]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for offset, piece in n.seeds():
                by_piece.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in by_piece.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def search(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice number, edits) of the best match around each candidate. Of overlapping matches of one label
        stay those of the longest notice, among them the one with the fewest edits, then the longest, then the first.

        Each candidate place has a window of its own, as long as its notice and the errors on both sides, so the work
        follows the number of seeds that occur, however many copies of a notice stand side by side."""
        places = {(i, last + 1 - size - offset) for last, (size, uses) in self.automaton.iter(line) for i, offset in uses}
        found = set()
        for i, start in places:
            n = self.notices[i]
            # Of twice as many pieces, each error spoils one at most; the others stand within so many places of their own.
            low, high = start - n.errors, start + n.errors
            spoilt = 0
            for a, b, piece in self.halves[i]:
                spoilt += line.find(piece, max(0, low + a), max(0, high + b)) < 0
                if spoilt > n.errors:
                    break
            if spoilt > n.errors:
                continue
            m = self.patterns[i].search(line, max(0, start - n.errors), start + len(n.text) + n.errors)
            if m:
                found.add((m.start(), m.end(), i, sum(m.fuzzy_counts)))
        best, taken = [], {self.notices[i].label: bytearray(len(line)) for _, _, i, _ in found}
        for m in sorted(found, key=lambda m: (-len(self.notices[m[2]].text), m[3], m[0] - m[1], m[0], m[2])):
            mine = taken[self.notices[m[2]].label]
            if mine.find(1, m[0], m[1]) < 0:
                mine[m[0] : m[1]] = b"\1" * (m[1] - m[0])
                best.append(m)
        return sorted(best)


@cache
def searcher(notices: tuple[tuple[str, str], ...]) -> Searcher:
    return Searcher(notices)


def folded(text: str) -> tuple[str, int]:
    """Lower-case words with single blanks between them, and how many they are."""
    words = utf8(text).translate(FOLD).split(b" ")
    words = [w for w in words if w]
    return b" ".join(words).decode("utf-8", "surrogatepass"), len(words)


def base_places(line: str) -> list[tuple[int, str]]:
    """(start in words, label) of each place of a base phrase."""
    out, framed = [], f" {line} "
    for phrase, label in BASE_PHRASES.items():
        before, words = 0, 0  # blanks ahead of a place are words ahead of it
        at = framed.find(f" {phrase} ")
        while at >= 0:
            words += framed.count(" ", before, at)
            before = at
            out.append((words, label))
            at = framed.find(f" {phrase} ", at + 1)
    return sorted(out)


def scan_text(text: str, notices=NOTICES) -> dict:
    line, n_words = folded(text)
    base = base_places(line)
    found = searcher(notices).search(line)
    hits, labels, score = [], {label for _, label in base}, 1.0 if base else 0.0
    if found:
        places = [m.span() for m in WORD.finditer(text)]
        before = words = 0
        for a, b, i, edits in found:
            words += line.count(" ", before, a)
            before, first = a, words
            notice = searcher(notices).notices[i]
            last = first + line.count(" ", a, b) - (line[b - 1 : b] == " ")
            first += line[a : a + 1] == " "
            hits.append({"label": notice.label, "start": places[first][0], "end": places[max(first, min(last, n_words - 1))][1], "first_word": first, "edits": edits, "notice_chars": len(notice.text)})
            labels.add(notice.label)
            score = max(score, 1 - edits / len(notice.text))
    return {
        "n_words": n_words, "n_base": len(base), "first_word": base[0][0] if base else None, "last_word": base[-1][0] if base else None,
        "base_labels": ",".join(sorted({label for _, label in base})), "labels": ",".join(sorted(labels)), "score": score, "found": hits,
    }


def scan_licenses(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: words, places of base phrases, labels, a score (1 less the best match's share of edits;
    0 without a match) and the fuzzy matches with their spans, edits and notices.

    Null and empty texts have 0 words, no labels and score 0; rows without an id and repeated rows are kept; an empty
    table gives an empty result; other columns are ignored, whatever their names. Texts are read whole.
    """
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "found": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("first_word", pa.int32()), ("edits", pa.int32()), ("notice_chars", pa.int32())]))}

    def run(batches):
        for batch in batches:
            rows = [scan_text(t, notices) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents")).drop("found")
