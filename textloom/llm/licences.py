"""Licence scan with a positional rare-token index.

A licence notice is a template: its words in order, of which some runs are mandatory
key phrases. The index holds every place of every template word. Of a file's licence
words, those of the highest IDF (over all files) are looked up first: each key phrase of
each template whose key words the files at hold has one such word. Its occurrences
propose where the phrase would start; each phrase is verified there, word for word, and a
template's phrases are intersected by relative position, up to SLACK words apart between
one phrase and the next. Of what is left, the index tells how much of the template stands
at its places: the coverage, from 1 for the whole notice down to the key phrases' share.

The lookup is exact: a key phrase can't occur without its rarest word. IDF only
chooses which word that is, so it changes the work and not the result.

Defined results: null and empty texts hold none, nor does an empty table; very long texts
are scanned whole; null ids are reported; repeated rows are reported each once more (their
matches add up by doc_id); templates that match at the same place are reported each; case
and punctuation don't matter; only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches
from .textops import Words, pieces, words

#: Words that may be missing or added between two key phrases, whose distance is long in some notices.
SLACK = 3
#: Licence, notice; key phrases stand in brackets. The wording is that of the licences' own standard notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "[licensed under the apache license version 2 0]"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http [www apache org licenses license 2 0] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("Apache-1.1", "[this product includes software developed by the apache software foundation]"),
    ("MIT", "[released under the mit license]"),
    ("MIT", "[licensed under the mit license]"),
    ("MIT", "[permission is hereby granted free of charge to any person] [obtaining a copy of this software] and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("MIT-0", "permission is hereby granted free of charge to any person obtaining a copy [and to permit persons to whom the software is furnished to do so the software is provided as is]"),
    ("GPL-3.0", "this work is [licensed under the gnu general public license version 3]"),
    ("GPL-2.0", "[licensed under the gnu general public license version 2]"),
    ("GPL", "[you can redistribute it and or modify] it under the terms of the [gnu general public license]"),
    ("GPL-3.0", "as published by the free software foundation [either version 3 of the license or] at your option any later version"),
    ("GPL-2.0", "as published by the free software foundation [either version 2 of the license or] at your option any later version"),
    ("GPL-3.0", "[gnu general public license version 3 29 june 2007]"),
    ("GPL-2.0", "[gnu general public license version 2 june 1991]"),
    ("LGPL", "under the terms of the [gnu lesser general public license]"),
    ("LGPL-2.0", "under the terms of the [gnu library general public license]"),
    ("AGPL-3.0", "under the terms of the [gnu affero general public license]"),
    ("GFDL", "[gnu free documentation license]"),
    ("BSD", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that] the following conditions are met"),
    ("BSD-3-Clause", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that the following conditions are met] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [neither the name of]"),
    ("BSD-4-Clause", "[all advertising materials mentioning features or use of this software must display the following acknowledgement]"),
    ("ISC", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC", "[permission to use copy modify and distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("PostgreSQL", "[permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement]"),
    ("HPND", "[permission to use copy modify and distribute this software and its documentation for any purpose] is hereby granted [without fee provided that]"),
    ("MPL-2.0", "[subject to the terms of the mozilla public license v 2 0]"),
    ("MPL-1.1", "[subject to the mozilla public license version 1 1]"),
    ("EPL-2.0", "[made available under the terms of the eclipse public license 2 0]"),
    ("EPL-1.0", "[made available under the terms of the eclipse public license v1 0]"),
    ("CDDL-1.0", "[the terms of the common development and distribution license]"),
    ("EUPL-1.2", "[licensed under the eupl version 1 2]"),
    ("Zlib", "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software [permission is granted to anyone to use this software for any purpose]"),
    ("BSL-1.0", "[distributed under the boost software license version 1 0]"),
    ("BSL-1.0", "[permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation]"),
    ("Artistic-2.0", "[under the terms of the artistic license 2 0]"),
    ("MS-PL", "[microsoft public license ms pl]"),
    ("PSF-2.0", "[python software foundation license version 2]"),
    ("OFL-1.1", "[licensed under the sil open font license version 1 1]"),
    ("NCSA", "[university of illinois ncsa open source license]"),
    ("WTFPL", "[do what the fuck you want to public license]"),
    ("ODbL-1.0", "[made available under the open database license]"),
    ("CC-BY-4.0", "[licensed under cc by 4 0]"),
    ("CC-BY-SA-4.0", "[licensed under cc by sa 4 0]"),
    ("CC-BY-NC-4.0", "[licensed under cc by nc 4 0]"),
    ("CC-BY-ND-4.0", "[licensed under cc by nd 4 0]"),
    ("CC-BY-NC-SA-4.0", "[licensed under cc by nc sa 4 0]"),
    ("CC-BY-NC-ND-4.0", "[licensed under cc by nc nd 4 0]"),
    *[(f"CC-{c}-{v}", f"this work is [licensed under a creative commons {n} {v.replace('.', ' ')}]") for v in ("4.0", "3.0") for c, n in (("BY", "attribution"), ("BY-SA", "attribution sharealike"), ("BY-NC", "attribution noncommercial"), ("BY-ND", "attribution noderivatives"), ("BY-NC-SA", "attribution noncommercial sharealike"), ("BY-NC-ND", "attribution noncommercial noderivatives"))],
    ("CC0-1.0", "[licensed under cc0 1 0]"),
    ("CC0-1.0", "to the extent possible under law the author has [waived all copyright and related or neighboring rights]"),
    ("Unlicense", "[this is free and unencumbered software] released into the public domain"),
    ("Public-Domain", "[released into the public domain]"),
    ("Proprietary", "[all rights reserved]"),
    *[(i, f"[spdx license identifier {i.lower().replace('-', ' ').replace('.', ' ').replace('+', ' ').strip()}]") for i in ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "OFL-1.1", "0BSD", "WTFPL")],
]


def parsed(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[tuple[int, list[str]]]]]:
    """Licence and (place, words) of its key phrases."""
    out = []
    for name, notice in templates:
        phrases, at, inside = [], 0, None
        for piece in notice.replace("[", " [ ").replace("]", " ] ").split():
            if piece == "[":
                inside = (at, [])
            elif piece == "]":
                phrases.append(inside)
                inside = None
            else:
                if inside:
                    inside[1].append(piece)
                at += 1
        out.append((name, phrases))
    return out


class Index:
    """Places of all template words, and of each key phrase's rarest word."""

    def __init__(self, templates, df: dict[str, int] | None = None, notices: list[str] | None = None):
        self.templates = templates
        whole = [n.replace("[", " ").replace("]", " ").split() for n in notices or []]
        vocabulary = sorted({x for _, ps in templates for _, p in ps for x in p} | {x for n in whole for x in n})
        code = dict(zip(vocabulary, words([" ".join(vocabulary)]).hash.tolist(), strict=True))
        df = df or {}
        self.phrases = [[(at, np.array([code[x] for x in p], np.uint64)) for at, p in ps] for _, ps in templates]
        rarest = [[min(range(len(p)), key=lambda i: (df.get(p[i], 0), -len(p[i]), i)) for _, p in ps] for _, ps in templates]
        self.anchor = rarest
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ps) in enumerate(templates):
            for j, (_, p) in enumerate(ps):
                self.postings.setdefault(code[p[rarest[t][j]]], []).append((t, j))
        self.codes = np.array(sorted(self.postings), np.uint64)
        self.vocabulary, self.code = vocabulary, code
        self.need = [np.array(sorted({code[x] for _, p in ps for x in p}), np.uint64) for _, ps in templates]
        self.whole = [np.array([code[x] for x in n], np.uint64) for n in whole]

    def find(self, w: Words) -> list[tuple[int, int, int, int]]:
        """(document, template, first word, word after the last) of each match."""
        if len(w.hash) == 0:
            return []
        v = np.minimum(np.searchsorted(self.codes, w.hash), len(self.codes) - 1)
        at = np.flatnonzero(self.codes[v] == w.hash)
        doc, out = w.doc(), []
        places: dict[tuple[int, int], list[np.ndarray]] = {}
        order = np.argsort(v[at], kind="stable")
        at, which = at[order], v[at][order]
        held = np.unique(w.hash)
        can = [bool(np.isin(x, held, assume_unique=True).all()) for x in self.need]
        e = np.searchsorted(which, np.arange(len(self.codes) + 1))
        for i, c in enumerate(self.codes.tolist()):
            mine = at[e[i] : e[i + 1]]
            if len(mine):
                for t, j in self.postings[c]:
                    if not can[t]:
                        continue
                    places[t, j] = self._verified(w, doc, mine - self.anchor[t][j], self.phrases[t][j][1])
        for t, ps in enumerate(self.phrases):
            got = [places.get((t, j)) for j in range(len(ps))]
            if any(g is None or len(g) == 0 for g in got):
                continue
            first, last = got[0], got[0]
            for j in range(1, len(ps)):
                step = ps[j][0] - ps[j - 1][0]
                i = np.searchsorted(got[j], last + max(step - SLACK, len(ps[j - 1][1])))
                ok = i < len(got[j])
                nxt = got[j][np.minimum(i, len(got[j]) - 1)]
                ok &= (nxt <= last + step + SLACK) & (doc[nxt] == doc[last])
                first, last = first[ok], nxt[ok]
            out += [(int(doc[f]), t, int(f), int(x) + len(ps[-1][1])) for f, x in zip(first, last, strict=True)]
        return out

    def coverage(self, w: Words, t: int, first: int) -> float:
        """Share of the template's words that stand at their places, or up to SLACK words off, counted from the first key phrase."""
        at = first - self.phrases[t][0][0] + np.arange(len(self.whole[t]))
        hit = np.zeros(len(at), bool)
        for d in range(-SLACK, SLACK + 1):
            x = at + d
            ok = (x >= 0) & (x < len(w.hash))
            hit[ok] |= w.hash[x[ok]] == self.whole[t][ok]
        return float(hit.mean())

    @staticmethod
    def _verified(w: Words, doc: np.ndarray, start: np.ndarray, phrase: np.ndarray) -> np.ndarray:
        start = start[(start >= 0) & (start + len(phrase) <= len(w.hash))]
        start = start[doc[start] == doc[np.minimum(start + len(phrase) - 1, len(doc) - 1)]]
        for i, c in enumerate(phrase):
            start = start[w.hash[start + i] == c]
        return start


def _frequencies(codes: np.ndarray):
    def run(batches):
        total = np.zeros(len(codes), np.int64)
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                w = words(texts)
                v = np.minimum(np.searchsorted(codes, w.hash), len(codes) - 1)
                hit = codes[v] == w.hash
                total += np.bincount(np.unique(w.doc()[hit] * len(codes) + v[hit]) % len(codes), minlength=len(codes))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(codes), dtype=np.int32)), pa.array(total)], ["word", "n"])

    return run


def scan(spark: SparkSession, docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, licence, start, stop, coverage) of each notice, in characters of the text."""
    small_batches(spark)
    notices = [n for _, n in templates or TEMPLATES]
    ts = parsed(templates or TEMPLATES)
    plain = Index(ts, None, notices)
    codes = np.array([plain.code[x] for x in plain.vocabulary], np.uint64)
    order = np.argsort(codes)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.mapInArrow(_frequencies(codes[order]), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each licence word
    df = {plain.vocabulary[order[r[0]]]: r[1] for r in got}
    index = Index(ts, df, notices)

    def run(batches):
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                w = words(texts)
                found = index.find(w)
                if found:
                    base = w.base
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([f[0] for f in found])), pa.array([ts[f[1]][0] for f in found]), pa.array([int(w.start[f[2]] - base[f[0]]) for f in found], pa.int32()), pa.array([int(w.end[f[3] - 1] - base[f[0]]) for f in found], pa.int32()), pa.array([index.coverage(w, f[1], f[2]) for f in found], pa.float64())], ["doc_id", "licence", "start", "stop", "coverage"])

    return text.mapInArrow(run, "doc_id long, licence string, start int, stop int, coverage double")


def counted(found: DataFrame) -> DataFrame:
    """(doc_id, licence, notices)."""
    return found.groupBy("doc_id", "licence").agg(F.count("*").alias("notices"))


def oracle() -> str:
    """DuckDB SQL for ``counted(scan(...))`` over documents: a regular expression for each template over words that each have blanks of their own."""
    parts = []
    for name, ps in parsed():
        pattern = ""
        for j, (at, p) in enumerate(ps):
            if j:
                gap = at - ps[j - 1][0] - len(ps[j - 1][1])
                pattern += f"(?: [^ ]+ ){{{max(0, gap - SLACK)},{gap + SLACK}}}?"
            pattern += "".join(f" {x} " for x in p)
        parts.append(f"SELECT doc_id, '{name}' AS licence, len(regexp_extract_all(t, '{pattern}')) AS n FROM w")
    norm = r"' ' || regexp_replace(trim(regexp_replace(lower(text), '[^\pL\pN_]+', ' ', 'g')), ' ', '  ', 'g') || ' '"
    return f"WITH w AS (SELECT doc_id, {norm} AS t FROM documents WHERE text IS NOT NULL), m AS ({' UNION ALL '.join(parts)}) SELECT doc_id, licence, CAST(sum(n) AS BIGINT) AS notices FROM m WHERE n > 0 GROUP BY doc_id, licence"
