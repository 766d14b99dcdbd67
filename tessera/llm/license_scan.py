"""Fuzzy search for short licence notices.

Each notice with ``k`` allowed edits is split into ``k + 1`` pieces: by the pigeonhole principle any occurrence with at
most ``k`` edits holds one piece unchanged. An Aho-Corasick automaton over all pieces locates candidates in one pass
over the normalised words, and the regex library's bounded-error matching verifies the window around each candidate and
gives its edits and span.

Defined results: a null or empty text has no words, places or labels and score 0; repeated rows are scanned each for
itself; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Lists, fields, kind, map_rows, named, text_or_empty

# The phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Well-known openings of licence notices, as normalised words.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under cc by": "cc-by",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version": "mpl",
    "eclipse public license version": "epl",
    "free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software": "isc",
    "boost software license version": "bsl",
}
WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def edits(notice: str) -> int:
    """One edit for every twelve characters, two at least."""
    return max(2, len(notice) // 12)


@lru_cache(maxsize=1)
def _machines():
    import ahocorasick

    seeds: dict[bytes, list[tuple[int, int]]] = {}
    checks = []
    for i, (notice, label) in enumerate(NOTICES.items()):
        k, n = edits(notice), len(notice)
        cuts = [round(j * n / (k + 1)) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            seeds.setdefault(notice[a:b], []).append((i, a))
        checks.append((regex.compile(rf"(?b)(?<![^ ])(?:{notice}){{e<={k}}}(?![^ ])"), n, k, label))
    machine = ahocorasick.Automaton()
    for seed, where in seeds.items():
        machine.add_word(seed, (len(seed), where))
    machine.make_automaton()
    phrases = [(regex.compile(rf"(?<![^ ]){p}(?![^ ])"), p.count(" ") + 1, label) for p, label in PHRASES.items()]
    return machine, checks, phrases


def normal_words(text: str) -> list[bytes]:
    """A-Z in lower case, then the contract's words; bytes over 0x7F belong to words as the characters they spell do."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


def fuzzy(flat: str) -> list[dict]:
    """Verified occurrences in normalised text, each as (label, first character, end, edits); overlapping finds of one notice count once."""
    machine, checks, _ = _machines()
    found: dict[tuple[int, int, int], int] = {}
    tried: set[tuple[int, int]] = set()
    seen: dict[tuple[int, bool, str], tuple[int, int, int] | None] = {}  # equal windows of a text are verified once
    for last, (length, where) in machine.iter(flat):
        for i, at in where:
            rx, n, k, _ = checks[i]
            lo = max(0, last - length + 1 - at - k)
            if (i, lo) in tried:  # the pieces of one unchanged occurrence give one window
                continue
            tried.add((i, lo))
            lo = max(0, lo - 1)
            key = (i, lo > 0, flat[max(0, lo - 1) : lo + n + 2 * k + 3])  # with a character on either side, which the pattern looks at
            if key not in seen:
                m = rx.search(flat, lo, min(len(flat), lo + n + 2 * k + 2))
                seen[key] = (m.start() - lo, m.end() - lo, sum(m.fuzzy_counts)) if m else None
            if hit := seen[key]:
                found.setdefault((i, lo + hit[0], lo + hit[1]), hit[2])
    out, kept = [], {}
    for (i, a, b), e in sorted(found.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
        spans = kept.setdefault(i, [])  # disjoint, in order
        place = bisect_left(spans, (a, b))
        if (not place or spans[place - 1][1] <= a) and (place == len(spans) or b <= spans[place][0]):
            spans.insert(place, (a, b))
            out.append({"label": checks[i][3], "at": a, "till": b, "edits": e, "length": checks[i][1]})
    return sorted(out, key=lambda x: (x["at"], x["till"], x["label"]))


def _scan(rows: Lists) -> dict[str, list]:
    _, _, phrases = _machines()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
    out: dict[str, list] = {k: [] for k in names}
    for text in rows["_text"]:
        words = normal_words(text)
        flat = b" ".join(words).decode("utf-8", "replace")
        exact = [(m.start(), n, label) for rx, n, label in phrases for m in rx.finditer(flat)] if "license" in flat or "cc by" in flat else []
        near = fuzzy(flat)
        gaps = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le"), "<u4") == 32) if exact or near else ()
        word_at = lambda at: int(np.searchsorted(gaps, at))  # noqa: B023, E731
        places = [(word_at(at), n, label) for at, n, label in exact]
        base = {x[2] for x in places}
        starts = [x[0] for x in places]
        score = 1.0 if places else max((1 - m["edits"] / m["length"] for m in near), default=0.0)
        matches = [{"label": label, "first_word": at, "n_words": n, "edits": 0} for at, n, label in sorted(places)]
        matches += [{"label": m["label"], "first_word": word_at(m["at"]), "n_words": word_at(m["till"]) - word_at(m["at"]) + 1, "edits": m["edits"]} for m in near]
        for name, x in zip(names, (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {m["label"] for m in near})), score, matches)):
            out[name].append(x)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the contract's counts of exact places, ``labels`` with those of the fuzzy notices, ``score``
    (1 for an exact place, else one less the share of edits in the best notice) and ``matches``: label, first word,
    number of words and edits of every exact place and every verified notice. No shuffle: each text stands alone."""
    read = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    return map_rows(read, _scan, fields(("doc_id", kind(docs, id_col)), "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,first_word:long,n_words:long,edits:int>>"))
