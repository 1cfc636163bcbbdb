"""License scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.columns import ALNUM_BYTES, id_and_text, map_batches

# Phrases whose places are counted, and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Public licence notices as templates: (label, text, mandatory key phrases).
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("apache", "Licensed under the Apache License, Version 2.0.", ("apache license",)),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.",
     ("general public license",)),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
        ("general public license", "free software foundation"),
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License",
     ("creative commons attribution noncommercial",)),
    ("cc-by", "Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms", "following conditions are met"),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("mozilla public license",),
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)


def tokens(text: str) -> list[bytes]:
    """Words of a whole text: A-Z in lower case, cut at ASCII characters but digits and letters."""
    return text.encode().translate(ALNUM_BYTES).split()


def _phrase_places(phrase: bytes, joined: bytes) -> list[int]:
    """Word numbers at which the words of ``phrase`` stand consecutively."""
    places, at, seen, number = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        number += joined.count(b" ", seen, at)
        seen = at
        places.append(number)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return places


class TemplateIndex:
    """Anchors of every template and where they stand in it.

    The anchors of a template are its ``anchors`` words of highest inverse document frequency. Each
    occurrence of an anchor in a file at p votes for the template of a posting (template, q) starting
    at p - q; a start with votes of at least ``least_share`` of the template's anchors is verified:
    every mandatory phrase must stand in the file within ``slack`` words of its place.
    """

    def __init__(self, templates, idf: dict[bytes, float], anchors: int, least_share: float, slack: int):
        self.slack, self.templates, self.least = slack, [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, (label, text, phrases) in enumerate(templates):
            own = tokens(text)
            rare = sorted(set(own), key=lambda w: (-idf.get(w, math.inf), own.index(w)))[:anchors]
            keys = []
            for phrase in phrases:
                words = tokens(phrase)
                keys.append(
                    (words, next(i for i in range(len(own)) if own[i : i + len(words)] == words))
                )
            self.templates.append((label, own, keys))
            self.least.append(max(1, math.ceil(least_share * len(rare))))
            for place, word in enumerate(own):
                if word in rare:
                    self.postings[word].append((number, place))

    def _stands(self, file: list[bytes], words: list[bytes], at: int) -> bool:
        first = max(0, at - self.slack)
        return any(
            file[i : i + len(words)] == words
            for i in range(first, min(len(file), at + self.slack + 1))
        )

    def matches(self, file: list[bytes]) -> dict[str, float]:
        """Label to the largest share of a template's words found in their places."""
        votes: Counter = Counter()
        for p, word in enumerate(file):
            for number, q in self.postings.get(word, ()):
                votes[number, p - q] += 1
        found: dict[str, float] = {}
        for (number, start), count in votes.items():
            label, own, keys = self.templates[number]
            if count < self.least[number]:
                continue
            if all(self._stands(file, words, start + place) for words, place in keys):
                aligned = sum(
                    0 <= start + i < len(file) and file[start + i] == word for i, word in enumerate(own)
                )
                found[label] = max(found.get(label, 0.0), aligned / len(own))
        return found


def licence_words_idf(texts: DataFrame, templates=TEMPLATES) -> dict[bytes, float]:
    """Inverse document frequency over all rows of every word of the templates, and of no other."""
    known = {word for _, text, _ in templates for word in tokens(text)}

    def count(batches):
        seen: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch["text"]:
                rows += 1
                seen.update(known.intersection(tokens(text or "")))
        yield {"word": [*seen, b""], "n": [*seen.values(), rows]}

    counted = map_batches(texts.select("text"), count, "word binary, n long")
    totals = {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = totals.pop(b"", 0)
    return {word: math.log((rows + 1) / (totals.get(word, 0) + 1)) for word in known}


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, anchors: int = 6, least_share: float = 0.5, slack: int = 3
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: how often and
    where the base phrases stand, their labels, these and the labels of templates that matched, and
    the best share of a matched template's words in place (0 if none matched). Null text counts as
    empty: zero counts, null places, empty labels. Null ids and repeated rows stay; an empty table
    gives none. Two scans without a shuffle of texts: the first counts documents per licence word, whose
    number is that of the templates' words.
    """
    texts = id_and_text(docs)
    idf = licence_words_idf(texts, templates)
    phrases = [(b" ".join(tokens(p)), label) for p, label in BASE_PHRASES.items()]

    def scan(batches):
        index = TemplateIndex(templates, idf, anchors, least_share, slack)
        known = index.postings.keys()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                file = tokens(text or "")
                joined = b" " + b" ".join(file) + b" "
                places, base = [], set()
                for phrase, label in phrases:
                    if here := _phrase_places(phrase, joined):
                        places += here
                        base.add(label)
                found = index.matches(file) if not known.isdisjoint(file) else {}
                rows.append(
                    (
                        len(file), len(places), min(places, default=None), max(places, default=None),
                        ",".join(sorted(base)), ",".join(sorted(base | found.keys())),
                        max(found.values(), default=0.0),
                    )
                )
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
            yield {"doc_id": batch["doc_id"]} | dict(zip(names, map(list, zip(*rows))))

    return map_batches(
        texts,
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double",
    )
