"""License scans by a positional index of rare words.

Templates are word sequences. Of the template words that a document holds, the rarest by inverse
document frequency over all documents are looked up, as many as a match cannot all lose. Where their
places in the text and in a template agree, up to the words that may be inserted or missing, the
stretch is verified by its word edits and by the key phrases that must stand in it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .decontaminate import best_match

# Words after lower-casing A-Z are runs of digits, a-z and everything beyond ASCII.
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


@dataclass(frozen=True)
class Template:
    """``key_phrases`` must all stand in the match; at most ``1 - share`` edits per word may."""

    label: str
    text: str
    key_phrases: tuple[str, ...]
    share: float = 0.8
    base: bool = False


# Phrases and labels of the base, and sentences of published licenses.
TEMPLATES = (
    Template("gpl", "gnu general public license", ("gnu general public license",), 1.0, True),
    Template("apache", "apache license", ("apache license",), 1.0, True),
    Template("cc-by", "cc by", ("cc by",), 1.0, True),
    Template("mit", "mit license", ("mit license",), 1.0, True),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mpl", "mozilla public license", ("mozilla public license",), 1.0),
    Template("epl", "eclipse public license", ("eclipse public license",), 1.0),
    Template("cc-by-sa", "cc by sa", ("cc by sa",), 1.0),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), 1.0),
    Template("cc-by-nd", "cc by nd", ("cc by nd",), 1.0),
    Template("cc0", "cc0 1 0 universal", ("cc0 1 0",)),
    Template(
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("hereby granted free of charge", "without restriction"),
    ),
    Template(
        "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use", "source and binary forms"),
    ),
    Template(
        "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ("any purpose with or without fee",),
    ),
    Template(
        "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    Template(
        "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("boost", "boost software license", ("boost software license",), 1.0),
    Template(
        "bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        ("endorse or promote products", "prior written permission"),
    ),
    Template(
        "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license",
        ("apache license",),
    ),
    Template(
        "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license",),
    ),
)

# Starts of published license identifiers and the label of each.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache", "GPL-": "gpl", "LGPL-": "lgpl", "AGPL-": "agpl", "MPL-": "mpl", "EPL-": "epl",
    "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3", "ISC": "isc", "Unlicense": "unlicense", "BSL-1.0": "boost", "CC0-1.0": "cc0",
    "CC-BY-": "cc-by", "CC-BY-SA-": "cc-by-sa", "CC-BY-NC-": "cc-by-nc", "CC-BY-ND-": "cc-by-nd",
}
_TAG = "SPDX-License-Identifier"
TEMPLATES += tuple(Template(label, f"{_TAG} {name}", (f"{_TAG} {name}",), 1.0) for name, label in IDENTIFIERS.items())


def license_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class _Index:
    """Postings of all template words, ranked by inverse document frequency over the corpus."""

    def __init__(self, templates: tuple[Template, ...], frequency: dict[bytes, int], n_docs: int, anchors: int):
        self.templates, self.anchors = templates, anchors
        self.sequences = [license_words(t.text) for t in templates]
        self.phrases = [[license_words(p) for p in t.key_phrases] for t in templates]
        self.edits = [len(s) - math.ceil(t.share * len(s)) for t, s in zip(templates, self.sequences)]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, sequence in enumerate(self.sequences):
            for offset, word in enumerate(sequence):
                self.postings[word].append((number, offset))
        idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in self.postings}
        self.rank = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}

    def search(self, words: list[bytes]) -> dict[int, list[tuple[int, float]]]:
        """Starts of each template in a text, with the share of its words that need no edit there."""
        held = sorted(self.postings.keys() & set(words), key=self.rank.__getitem__)
        # A word that the text lacks takes one edit of each template that needs it.
        room = [edits - len(sequence) for edits, sequence in zip(self.edits, self.sequences)]
        for word in held:
            for number, _ in self.postings[word]:
                room[number] += 1
        chosen: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
        for word in held:  # the rarest first
            for number, offset in self.postings[word]:
                wanted = room[number] + 1 + (self.anchors if self.edits[number] else 0)
                if room[number] >= 0 and len(chosen[number]) < wanted:
                    chosen[number].append((word, offset))
        places: dict[bytes, list[int]] = {}
        found = defaultdict(list)
        for number, pairs in sorted(chosen.items()):
            if not pairs:
                continue
            for word, _ in pairs:
                if word not in places:
                    places[word] = _places(words, word)
            met = sorted((place - offset, offset) for word, offset in pairs for place in places[word])
            # Any match leaves all but ``room`` of the chosen words in place.
            if matches := sorted(set(self._matches(number, met, len(pairs) - room[number], words))):
                found[number] = matches
        return found

    def _matches(self, number: int, met: list[tuple[int, int]], need: int, words: list[bytes]) -> Iterator[tuple[int, float]]:
        sequence, edits = self.sequences[number], self.edits[number]
        low = 0
        while low < len(met):
            start = met[low][0]
            high = low
            while high < len(met) and met[high][0] <= start + edits:  # inserted and missing words shift what follows
                high += 1
            if len({offset for _, offset in met[low:high]}) < need:
                low += 1
                continue
            first = max(0, start - edits)
            part = words[first : start + len(sequence) + 2 * edits] if edits else words[start : start + len(sequence)] if start >= 0 else []
            if edits:
                distance, end = best_match(sequence, part)
                length = best_match(sequence[::-1], part[:end][::-1])[1]
            else:
                distance, end, length = int(part != sequence), len(part), len(part)
            if distance <= edits and all(_places_of(phrase, part[end - length : end]) for phrase in self.phrases[number]):
                yield first + end - length if edits else start, 1 - distance / len(sequence)
            low = high


def _places(words: list[bytes], word: bytes) -> list[int]:
    out, at = [], -1
    for _ in range(words.count(word)):
        at = words.index(word, at + 1)
        out.append(at)
    return out


def _places_of(phrase: list[bytes], words: list[bytes]) -> bool:
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def _document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word stands, and how many there are; one row per word comes back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        n = 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                n += 1
                for word in vocabulary.intersection(license_words(text)):
                    seen[word] += 1
        names = [None, *[w.decode() for w in seen]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return {w.encode(): n for w, n in counts.items() if w is not None}, counts.get(None, 0)


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, anchors: int = 2) -> DataFrame:
    """Licenses of each whole text: ``doc_id, n_words, places, labels, score``.

    ``places`` holds ``(label, base, start, share)`` of every verified place, in order of start.
    ``score`` is the largest share at a place, 0 without one: 1 less the word edits per template word.
    Of matches of one template that overlap the one with fewest edits counts. ``anchors`` more rare words
    than a match needs are looked up, which spares verifications and changes no result.
    A null text counts as empty: no words, no places. Null, equal and repeated ids are scanned row
    by row; other columns are not read. Templates are a parameter, so the index is as small as they are.
    """
    rows = texts(docs)
    vocabulary = frozenset(w for t in templates for w in license_words(t.text))
    frequency, n_docs = _document_frequency(rows, vocabulary)
    place = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("share", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(templates, frequency, n_docs, anchors)
        for batch in batches:
            n_words, places, scores = [], [], []
            for text in batch["text"].to_pylist():
                words = license_words(text)
                found = [
                    {"label": templates[k].label, "base": templates[k].base, "start": start, "share": share}
                    for k, starts in index.search(words).items() for start, share in starts
                ]
                n_words.append(len(words))
                places.append(sorted(found, key=lambda f: (f["start"], f["label"], not f["base"])))
                scores.append(max((f["share"] for f in found), default=0.0))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(places, pa.list_(place)), pa.array(scores, pa.float64())],
                names=["doc_id", "n_words", "places", "score"],
            )

    schema = "doc_id long, n_words long, places array<struct<label:string,base:boolean,start:long,share:double>>, score double"
    found = rows.mapInArrow(scan, schema)
    return found.withColumn("labels", F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))))
