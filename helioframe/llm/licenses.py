"""License scans: MinHash bands over overlapping windows find templates, shingle containment verifies them.

A template of m shingles is looked for in windows of 2 s shingles, s the next power of two from m, that begin every s
shingles: wherever it stands, one window holds it whole. Of such a window it makes up at least 0.18 even with a fifth
of its shingles changed, so with ``HASHES`` bands of one MinHash value each they share a band with a probability above
0.9999. A window can share a band only if it has a shingle that is the template's minimum for that hash; signatures are
computed for the windows that have one, which are all that can match. A match is a window that contains at least
``CONTAINED`` of the template's distinct five-word shingles, compared as words; of the shingles with a digit, which
tell versions apart, at least half.

A template is named ``license#form``, or by its license alone. Where matches of several licenses overlap, the one with the
most evidence, found shingles times containment, wins: a rival of about the same length by its containment, a whole text
over a notice inside it. All matches that remain are returned with their places, forms of one license side by side.

The templates are a parameter whose size does not grow with the data. ``license_templates.json`` has full texts, headers,
usual notices and SPDX lines of the common licenses; ``TEMPLATES`` are a few notices.

Defined cases: null and empty texts have no match; a template of fewer than five words is one shingle, sought as a run
of its words; overlapping matches of one template count once; repeated rows each get a row; templates without words are an
error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.common import WordHashes, as_bytes, mixed, shingle_hashes
from helioframe.llm.decontam import words_of

SIZE, HASHES, CONTAINED = 5, 48, 0.8
_SEEDS = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
FLIPS, FACTORS = _SEEDS[:HASHES], _SEEDS[HASHES:] | np.uint64(1)

# Notices of public licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: The file of the registered query.
TEMPLATE_FILE = str(Path(__file__).with_name("license_templates.json"))

MATCH = "struct<license:string,form:string,first_word:bigint,last_word:bigint,containment:double>"
FOUND = f"struct<n_words:bigint,matches:array<{MATCH}>>"
MATCH_ARROW = pa.list_(
    pa.struct([("license", pa.string()), ("form", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())])
)
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("matches", MATCH_ARROW)])


def read_templates(path: str = TEMPLATE_FILE) -> dict[str, str]:
    """The templates of a JSON file, a list of objects with license, form and text."""
    entries = json.loads(Path(path).read_text(encoding="utf-8"))
    return {f"{e['license']}#{e['form']}": e["text"] for e in entries}


def signature(hashes: np.ndarray) -> np.ndarray:
    return ((hashes[:, None] ^ FLIPS) * FACTORS).min(axis=0)


def settled(found: list[dict]) -> list[dict]:
    """The matches that no better match of another license overlaps, and of one template's overlapping ones the best."""
    # Only matches of one chain of overlapping places meet, so a text with many notices takes no square of their number.
    chains: list[list[dict]] = []
    end = -1
    for m in sorted(found, key=lambda m: m["first_word"]):
        if m["first_word"] > end:
            chains.append([])
        chains[-1].append(m)
        end = max(end, m["last_word"])
    out: list[dict] = []
    for chain in chains:
        taken: list[dict] = []
        for m in sorted(chain, key=lambda m: (-m["evidence"], m["license"], m["form"], m["first_word"])):
            over = [o for o in taken if o["first_word"] <= m["last_word"] and m["first_word"] <= o["last_word"]]
            if all(o["license"] == m["license"] and o["form"] != m["form"] for o in over):
                taken.append(m)
        out += taken
    return sorted(out, key=lambda m: (m["license"], m["first_word"], m["form"]))


class Templates:
    """Templates by their number of words in a shingle and their window step."""

    def __init__(self, texts: dict[str, str]):
        known = WordHashes()
        self.by_size: dict[int, dict[int, tuple[list, np.ndarray]]] = {}
        minima: dict[int, set[int]] = {}
        signatures: dict[tuple[int, int], list[np.ndarray]] = {}
        for name, text in sorted(texts.items()):
            words = words_of(text.encode())
            if not words:
                raise ValueError(f"template {name} has no words")
            size = min(SIZE, len(words))
            hashes = shingle_hashes(known.array(words), size)
            runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
            numbered = {r for r in runs if any(w.isdigit() or w[1:].isdigit() for w in r)}
            step = 1 << (len(hashes) - 1).bit_length()
            held = self.by_size.setdefault(size, {}).setdefault(step, ([], None))[0]
            held.append((*name.partition("#")[::2], runs, numbered))
            spread = (hashes[:, None] ^ FLIPS) * FACTORS
            signatures.setdefault((size, step), []).append(spread.min(axis=0))
            minima.setdefault(size, set()).update(hashes[spread.argmin(axis=0)].tolist())
        for (size, step), rows in signatures.items():
            self.by_size[size][step] = (self.by_size[size][step][0], np.array(rows))
        self.minima = {size: np.array(sorted(m), np.uint64) for size, m in minima.items()}

    def matches(self, words: list[bytes], hashes_of: WordHashes) -> list[dict]:
        found: list[dict] = []
        numbers = hashes_of.array(words)
        for size, by_step in self.by_size.items():
            if len(words) < size:
                continue
            hashes = shingle_hashes(numbers, size)
            minima = self.minima[size]
            near = minima[np.minimum(np.searchsorted(minima, hashes), len(minima) - 1)]
            at = np.flatnonzero(near == hashes)
            if not len(at):
                continue
            for step, (templates, signatures) in by_step.items():
                blocks = np.unique(np.concatenate([at // step, at // step - 1]))
                for first in (blocks[blocks >= 0] * step).tolist():
                    window = hashes[first : first + 2 * step]
                    if not len(window):
                        continue
                    hits = np.flatnonzero((signatures == signature(window)).any(axis=1)).tolist()
                    if hits:
                        runs: dict[tuple, list[int]] = {}
                        for i in range(first, first + len(window)):
                            runs.setdefault(tuple(words[i : i + size]), []).append(i)
                        for k in hits:
                            found += self.placed(templates[k], runs, size)
        return [{k: v for k, v in m.items() if k != "evidence"} for m in settled(found)]

    @staticmethod
    def placed(template, runs: dict[tuple, list[int]], size: int) -> Iterator[dict]:
        """The places of a template in a window, one after another; ``runs`` has the places of each shingle."""
        name, form, wanted, numbered = template
        after = -1
        while True:
            places = {r: next((i for i in runs.get(r, ()) if i > after), -1) for r in wanted}
            places = {r: i for r, i in places.items() if i >= 0}
            share = len(places) / len(wanted)
            if share < CONTAINED or 2 * sum(r in places for r in numbered) < len(numbered):
                return
            after = max(places.values())
            yield {
                "license": name,
                "form": form,
                "first_word": min(places.values()),
                "last_word": after + size - 1,
                "containment": share,
                "evidence": share * len(places),
            }


@lru_cache(maxsize=4)
def prepared(templates: tuple[tuple[str, str], ...]) -> Templates:
    """Made once in a worker."""
    return Templates(dict(templates))


def scanner(templates: dict[str, str]):
    items = tuple(sorted(templates.items()))

    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, hashes = prepared(items), WordHashes()
        for batch in batches:
            out = []
            for text in as_bytes(batch):
                words = words_of(text)
                out.append({"n_words": len(words), "matches": known.matches(words, hashes)})
            yield pa.array(out, FOUND_ARROW)

    return scan


def scanned(docs: DataFrame, into: str, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with a column ``into``: words and the licenses found with their places."""
    return docs.withColumn(into, scanner(templates or TEMPLATES)(F.col(text).cast("string")))


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    scan = scanner(templates or TEMPLATES)
    rows = docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text).cast("string")).alias("f"))
    names = F.array_distinct(F.transform("f.matches", lambda m: m["license"]))
    return rows.select(
        "doc_id",
        F.col("f.n_words").alias("n_words"),
        F.size(names).cast("bigint").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.get(F.col("f.matches"), 0)["first_word"].alias("first_word"),
        F.col("f.matches").alias("matches"),
    )
