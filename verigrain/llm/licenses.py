"""License scans: exact phrases, and short notices with a bounded number of edits.

A notice that may have k edits is split into k + 1 pieces; by the pigeonhole principle every occurrence has one of
them unchanged. One automaton finds all pieces of all notices in a single walk over the text, and only around a
piece does the regex library search the notice with its bounded-error matching and report the span and the edits.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from verigrain.llm.columns import free_name
from verigrain.llm.textkit import as_bytes, slices, words_of

#: Exact phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Notice:
    words: str
    label: str
    edits: int
    #: First words that must be unchanged, where they alone tell the licence.
    head: str = ""


#: Short notices and how many character edits each may have.
NOTICES = (
    Notice("gnu general public license", "gpl", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("apache license", "apache", 2),
    Notice("licensed under the apache license version", "apache", 4),
    Notice("mit license", "mit", 1, "mit"),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    Notice("creative commons attribution", "cc-by", 3),
    Notice("licensed under cc by", "cc-by", 2),
    Notice("redistribution and use in source and binary forms", "bsd", 5),
    Notice("mozilla public license", "mpl", 2),
    Notice("eclipse public license", "epl", 2),
    Notice("boost software license", "bsl", 2),
    Notice("isc license", "isc", 1, "isc"),
)


class NoticeSearch:
    """All occurrences of notices in texts made of words joined by single blanks."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        self.exact = [
            regex.compile(rf"(?b)(?<![^ ]){regex.escape(n.head)}(?:{regex.escape(n.words.removeprefix(n.head))}){{e<={n.edits}}}(?![^ ])") for n in notices
        ]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(notices):
            cuts = [round(i * len(n.words) / (n.edits + 1)) for i in range(n.edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                seeds.setdefault(n.words[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def candidates(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the windows around its seeds, merged as far as they stay short: the search for the best
        match reads a window once for each match in it."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                n, start = self.notices[k], end + 1 - size - at
                a, b = max(0, start - n.edits - 1), min(len(text), start + len(n.words) + n.edits + 1)
                own = windows.setdefault(k, [])
                if own and a <= own[-1][1] and b - own[-1][0] <= 4 * len(n.words):
                    own[-1] = own[-1][0], max(own[-1][1], b)
                else:
                    own.append((a, b))
        return windows

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of every match, not overlapping within a notice, in order. Of matches that
        overlap, the one of the fewest edits counts."""
        out = []
        for k, windows in sorted(self.candidates(text).items()):
            found = {
                (sum(m.fuzzy_counts), m.start(), m.end())
                for a, b in windows for m in self._matches(k, text, a, b) if m.end() == len(text) or text[m.end()] == " "
            }
            starts, ends = [], []
            for edits, start, end in sorted(found):
                at = bisect.bisect_left(ends, start)
                if at == len(starts) or starts[at] >= end:
                    starts.insert(at, start)
                    ends.insert(at, end)
                    out.append((k, start, end, edits))
        return sorted(out)

    def _matches(self, k: int, text: str, a: int, b: int) -> Iterator[regex.Match]:
        """Matches of a window in order. The best of what is left comes first from the pattern; others, of more edits,
        may lie before it, so the text up to the blank before it is searched again."""
        least = len(self.notices[k].words) - self.notices[k].edits
        for m in self.exact[k].finditer(text, a, b):
            if m.start() - 1 - a >= least:
                yield from self._matches(k, text, a, m.start() - 1)
            yield m
            a = m.end()


def scan_text(search: NoticeSearch, text: bytes, phrases: dict[str, str]) -> dict:
    """The row of one text, see ``scan_licenses``."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    places, base = [], set()
    for phrase, label in phrases.items():
        wanted = b" " + phrase.encode() + b" "
        at = joined.find(wanted)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = joined.find(wanted, at + 1)
    places = np.searchsorted(blanks, places).tolist()
    plain = joined[1:-1].decode("utf-8", "replace")
    found = search.find(plain)
    if found:
        blanks = blanks[1:-1] - 1 if plain.isascii() else np.cumsum([len(w) + 1 for w in plain.split(" ")])[:-1] - 1
    spans, labels, best = [], set(base), 1.0 if base else 0.0
    for k, start, end, edits in found:
        notice = search.notices[k]
        labels.add(notice.label)
        best = max(best, 1.0 - edits / len(notice.words))
        spans.append({"notice": notice.words, "first_word": int(np.searchsorted(blanks, start)), "last_word": int(np.searchsorted(blanks, end - 1)), "edits": edits})
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": best, "spans": spans,
    }


_SPAN = pa.struct([("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())])
_ROW = pa.struct([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(_SPAN)),
])
FIELDS = [f.name for f in _ROW]


def scan_licenses(docs: DataFrame, text_col: str = "text", notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] | None = None) -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters, counted from 0. n_base
    counts the places of ``phrases``, first_word and last_word are their smallest and largest start, null if there
    is none. labels holds the phrases' labels and those of notices found with edits; both lists are distinct,
    sorted and comma-joined. score is 1 for an exact find, less by the share of edited characters, 0 without any.
    spans lists each notice found: its words, first and last word of the span, and the edits.

    Null text: no words, labels "" and score 0. Repeated rows give equal rows; whole texts are searched; an empty
    table gives an empty result. Columns with the added names are replaced, all others kept.
    """
    phrases = BASE_PHRASES if phrases is None else phrases

    @arrow_udf(
        "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,"
        "spans:array<struct<notice:string,first_word:bigint,last_word:bigint,edits:int>>>"
    )
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = NoticeSearch(notices)
        for texts in columns:
            yield pa.array([scan_text(search, t, phrases) for some in slices(texts) for t in as_bytes(some)], _ROW)

    docs = docs.drop(*FIELDS)
    name = free_name(docs, "found")
    found = docs.withColumn(name, scan(F.col(text_col).cast("string")))
    return found.withColumns({c: F.col(f"{name}.{c}") for c in FIELDS}).drop(name)
