"""Licence scans: a trained paragraph classifier with a calibrated unknown class, confirmed by template comparison."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.common import as_bytes, query, slices, table

#: Customary notices of each family (fixed values).
TEMPLATES = {
    "MIT": ["under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
             "SPDX-License-Identifier: LGPL-2.1-only"],
    "BSD": ["under the BSD License", "under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["under CC BY 4.0", "under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["under CC BY-SA 4.0", "under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["under CC BY-NC 4.0", "under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["under CC0 1.0", "dedicated to the public domain under CC0 1.0 Universal"],
}
OPENINGS = ["licensed", "released", "distributed", "available", "published", "this work is licensed", "this project is released", "the code is made available", "provided"]
#: Words that say nothing by themselves; an n-gram of these alone is no feature.
COMMON = set("a an and are as be by for from in is it its not of on or that the this to with you your all any may can use which has have was were will at we our".split())
UNKNOWN, NONE = "unknown", "none"
#: Words that open a comment line (signs that do are no words).
REMARKS = {b"rem", b"dnl"}
#: Paragraphs above twice this many words are classified in windows of so many, half overlapping.
WINDOW = 32
#: Step between the windows that slide over the words of several lines.
STEP = 8
#: Share of a template's word pairs that a paragraph must hold to confirm its family.
CONFIRM = 0.8

_KEEP = bytes(c if chr(c).isalnum() and c < 128 else c if c >= 128 else 32 for c in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def words(text: bytes) -> list[bytes]:
    """Lower-case runs of letters and digits; a run of digits is ``0``."""
    return [b"0" if w.isdigit() else w for w in text.translate(_KEEP).split()]


def grams(tokens: list[bytes], anchors: frozenset[bytes]) -> set[bytes]:
    """The 1- to 3-grams that hold an anchor word."""
    out = set()
    for i, w in enumerate(tokens):
        mark = False
        for n in range(1, 4):
            if i + n > len(tokens):
                break
            mark = mark or tokens[i + n - 1] in anchors
            if mark:
                out.add(b" ".join(tokens[i:i + n]))
    return out


def pairs(tokens: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(tokens, tokens[1:]))


def examples(seed: int) -> list[tuple[list[bytes], str]]:
    """Notices in varied company, notices of licences that belong to no family, and text that is no notice."""
    rng = np.random.default_rng(seed)
    split = lambda s: words(s.encode())
    vocabulary = sorted({w for ts in TEMPLATES.values() for t in ts for w in split(t)} | {w for o in OPENINGS for w in split(o)})
    common = sorted(w.encode() for w in COMMON)
    filler = lambda n: [common[int(rng.integers(len(common)))] if rng.random() < 0.4 else b"x%d" % rng.integers(10**6) for _ in range(n)]
    around = lambda core: filler(int(rng.integers(0, 14))) + core + filler(int(rng.integers(0, 14)))
    opening = lambda: split(OPENINGS[int(rng.integers(len(OPENINGS)))])
    out = []
    for family, templates in TEMPLATES.items():
        for t in templates:
            core = split(t)
            for _ in range(30):
                kept = [w for w in core if len(core) < 8 or rng.random() > 0.05]
                out.append((around((opening() if core[0] == b"under" else []) + kept), family))
    for _ in range(400):  # licence language around a name that no template has
        name = [b"x%d" % rng.integers(10**6) for _ in range(int(rng.integers(1, 4)))]
        tail = split(["license", "public license version 0", "community license", "license version 0", "licence agreement", "terms"][int(rng.integers(6))])
        out.append((around(opening() + split("under the") + name + tail), UNKNOWN))
    for _ in range(900):  # the same words out of order, ordinary uses of some of them, and plain text
        mixed = [vocabulary[int(rng.integers(len(vocabulary)))] for _ in range(int(rng.integers(1, 6)))]
        use = split(["a driver license was renewed", "the public version of the file", "we published a general notice", "conditions of any kind of use", "apache helicopters", "massachusetts mit students",
                     "free of charge", "the software foundation", "creative commons room", "version 0", "copyright law"][int(rng.integers(11))])
        out.append((around([[], mixed, use, filler(10)][int(rng.integers(4))]), NONE))
    return out


class Classifier:
    """Softmax regression over sparse word n-grams, trained on ``examples``; probabilities are calibrated on a held-out third."""

    def __init__(self, seed: int = 1, rounds: int = 400, trust: float = 0.9):
        data = examples(seed)
        self.classes = [*TEMPLATES, UNKNOWN, NONE]
        self.anchors = frozenset(w for ts in [*TEMPLATES.values(), OPENINGS, ["licence license terms agreement community"]] for t in ts for w in words(t.encode()) if w.decode() not in COMMON and w != b"0")
        sets = [grams(t, self.anchors) for t, _ in data]
        seen: dict[bytes, int] = {}
        for s in sets:
            for g in s:
                seen[g] = seen.get(g, 0) + 1
        self.index = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 5))}
        x = np.zeros((len(data), len(self.index)))
        for row, s in zip(x, sets, strict=True):
            row[[self.index[g] for g in s if g in self.index]] = 1
        y = np.array([self.classes.index(c) for _, c in data])
        held = np.random.default_rng(seed + 1).random(len(y)) < 1 / 3
        self.weight, self.bias = self._fit(x[~held], y[~held], rounds)
        # temperature: the one that makes the held-out labels likeliest; then the least trust whose accepted labels are right
        score = x[held] @ self.weight + self.bias
        heat = np.geomspace(0.2, 5, 41)
        loss = [-np.log(self._softmax(score / t)[np.arange(held.sum()), y[held]] + 1e-12).mean() for t in heat]
        self.heat = float(heat[int(np.argmin(loss))])
        p = self._softmax(score / self.heat)
        top = p[:, :-2].max(axis=1)
        right = p[:, :-2].argmax(axis=1) == y[held]
        steps = [t for t in np.arange(0.5, 1, 0.01) if right[top >= t].mean() >= 0.995] if (top >= 0.5).any() else []
        self.trust = float(min(steps, default=trust))
        self.held_out = float((p.argmax(axis=1) == y[held]).mean())
        # without an anchor word there are no features, and the bias alone must say "none": such text need not be looked at
        self.bias[-1] = max(self.bias[-1], self.bias[:-1].max() + 1e-6)
        self.templates = {f: [pairs(words(t.encode())) for t in ts] for f, ts in TEMPLATES.items()}

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        hot = np.eye(len(self.classes))[y]
        w, b, v, u = np.zeros((x.shape[1], hot.shape[1])), np.zeros(hot.shape[1]), 0.0, 0.0
        for _ in range(rounds):  # gradient steps with momentum
            miss = (self._softmax(x @ w + b) - hot) / len(y)
            v, u = 0.9 * v - (x.T @ miss + 1e-4 * w), 0.9 * u - miss.sum(axis=0)
            w, b = w + v, b + u
        return w, b

    def judge(self, tokens: list[bytes]) -> tuple[str, float, float]:
        """Family (or unknown, or none), its probability, and the largest share of a template of the family found."""
        at = [self.index[g] for g in grams(tokens, self.anchors) if g in self.index]
        p = self._softmax((self.weight[at].sum(axis=0) + self.bias) / self.heat)
        if p[-1] >= 0.5 or not at:
            return NONE, float(p[-1]), 0.0
        best = int(p[:-2].argmax())
        family, held = self.classes[best], pairs(tokens)
        share = max(len(t & held) / len(t) for t in self.templates[family])
        if p[best] >= self.trust and share >= CONFIRM:
            return family, float(p[best]), share
        return UNKNOWN, float(1 - p[-1]), share

    def scan(self, text: bytes) -> list[tuple[int, int, str, float, float]]:
        """``begin, end`` (bytes) of each line, or run of lines, with a licence notice, with its family, probability and template share."""
        out, begin, block = [], 0, []
        for line in text.split(b"\n"):
            tokens = words(line)
            if not tokens and block:
                out += self._block(block)
                block = []
            if not self.anchors.isdisjoint(tokens):
                step = len(tokens) if len(tokens) <= 2 * WINDOW else WINDOW // 2
                best = {}
                for i in range(0, max(1, len(tokens) - (WINDOW // 2 if step != len(tokens) else 0)), max(1, step)):
                    part = tokens if step == len(tokens) else tokens[i:i + WINDOW]
                    if self.anchors.isdisjoint(part):
                        continue
                    family, p, share = self.judge(part)
                    if family != NONE and (p, share) > best.get(family, (0.0, 0.0)):
                        best[family] = (p, share)
                if len(best) > 1:  # a window that cuts a notice in two is no notice of its own
                    best.pop(UNKNOWN, None)
                found = [(begin, begin + len(line), f, p, s) for f, (p, s) in sorted(best.items())]
            else:
                found = []
            if tokens:
                block.append((begin, begin + len(line), tokens[1:] if tokens[0] in REMARKS else tokens, found))
            begin += len(line) + 1
        return out + self._block(block)

    def _block(self, lines: list[tuple[int, int, list[bytes], list[tuple[int, int, str, float, float]]]]) -> list[tuple[int, int, str, float, float]]:
        """The findings of a run of lines without a blank one: those of its lines, and of notices that go over line ends.

        Windows slide over the words of all lines. A family that they confirm, and no line among theirs does, is a finding from
        the first to the last line that holds its words; lines of it that read like another, unknown licence are none by
        themselves. An unknown notice over several lines counts where no line of the window has a finding.
        """
        own = [x for _, _, _, found in lines for x in found]
        tokens = [w for _, _, ws, _ in lines for w in ws]
        if len(lines) < 2 or self.anchors.isdisjoint(tokens):
            return own
        line_of = [k for k, (_, _, ws, _) in enumerate(lines) for _ in ws]
        known, unknown = [], []
        for i in range(0, max(1, len(tokens) - WINDOW + STEP), STEP):
            part, at = tokens[i:i + WINDOW], line_of[i:i + WINDOW]
            if not part or at[0] == at[-1] or self.anchors.isdisjoint(part):
                continue
            family, p, share = self.judge(part)
            if family == NONE:
                continue
            if family == UNKNOWN:
                marks = [k for k, w in zip(at, part, strict=True) if w in self.anchors]
                unknown.append((marks[0], marks[-1], at[0], at[-1], p, share))
                continue
            template = max(self.templates[family], key=lambda t, held=pairs(part): len(t & held) / len(t))
            marks = [k for k, pair in zip(range(len(part)), zip(part, part[1:])) if pair in template]
            known.append((at[marks[0]], at[marks[-1] + 1], family, p, share))
        spans: list[list] = []  # per family, overlapping windows are one notice
        for a, b, family, p, share in sorted(known, key=lambda x: (x[2], x[0], x[1])):
            if any(f == family for k in range(a, b + 1) for _, _, f, *_ in lines[k][3]):
                continue
            if spans and spans[-1][2] == family and a <= spans[-1][1]:
                spans[-1][1:] = [max(b, spans[-1][1]), family, *max((p, share), tuple(spans[-1][3:]))]
            else:
                spans.append([a, b, family, p, share])
        inside = {k for a, b, *_ in spans for k in range(a, b + 1)}
        own = [x for k, (_, _, _, found) in enumerate(lines) for x in found if x[2] != UNKNOWN or k not in inside]
        taken = inside | {k for k, (_, _, _, found) in enumerate(lines) if found}
        loose: list[list] = []
        for a, b, first, last, p, share in unknown:
            if taken.isdisjoint(range(first, last + 1)):
                if loose and a <= loose[-1][1]:
                    loose[-1][1:] = [max(b, loose[-1][1]), UNKNOWN, *max((p, share), tuple(loose[-1][3:]))]
                else:
                    loose.append([a, b, UNKNOWN, p, share])
        return sorted(own + [(lines[a][0], lines[b][1], f, p, s) for a, b, f, p, s in spans + loose])


@functools.lru_cache(1)
def classifier() -> Classifier:
    return Classifier()


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, findings`` per input row: an array of ``start, end, family, probability, template_share`` per licence paragraph.

    Every line of the whole text is classified, long ones in overlapping windows, and so are windows over the words of all
    lines between two blank ones (lines of comment signs are blank), so hard-wrapped notices are found. A family needs a
    calibrated probability and the words of one of its templates; what reads like a licence otherwise is ``unknown``. Offsets
    are code points of the line, or of the lines that a notice goes over.

    Null and empty texts have no findings. Null or repeated ids are separate rows. Other columns play no part.
    """
    model = classifier()
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                found = []
                for text in as_bytes(part.column("text")):
                    hits = model.scan(text)
                    place = lambda k, t=text: len(t[:k].decode("utf-8", "replace"))
                    found.append([{"start": place(a), "end": place(b), "family": f, "probability": p, "template_share": s} for a, b, f, p, s in hits])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(kind))], ["doc_id", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, findings array<struct<start:int,end:int,family:string,probability:double,template_share:double>>")


@query("op8_licence_scan")
def op8_licence_scan(spark: SparkSession, d: str) -> DataFrame:
    found = scan_licences(table(spark, d, "documents"))
    known = "filter(findings, x -> x.family <> 'unknown')"
    return found.select("doc_id", F.expr(f"array_join(array_sort(array_distinct(transform({known}, x -> x.family))), ',')").alias("licences"),
                        F.expr(f"cast(size({known}) as bigint)").alias("n_confirmed"), F.expr(f"cast(size(findings) - size({known}) as bigint)").alias("n_unknown"),
                        F.expr("array_join(transform(findings, x -> concat(x.family, ':', x.start, ':', x.end)), ',')").alias("spans"),
                        F.expr("coalesce(array_max(transform(findings, x -> x.probability)), 0D)").alias("confidence"))
