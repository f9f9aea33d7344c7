"""Each operator against a brute-force version, and on awkward tables."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, language_model, licences, near_duplicates, packing, passages, resample, sharding, surrogates, topk
from textloom.llm.exchange import gathered

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall(r"\w+", (text or "").lower())


def frame(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts, first)], SHAPE)


def awkward(spark):
    """Nulls, empty, blank, a very long text, repeated rows, and columns whose names operators might use."""
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (None, "Mr. Tom Ray", None), (2, None, None), (3, "", "x"), (4, "  \n ", "x"), (5, "word " * 60_000, "x"), (6, "é€𝒳 ß", "y"), (7, "...", "y"), (None, None, None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, "k", "s") for r in rows], "doc_id long, text string, lang string, n_chars long, a long, _gone long, key string, surrogate string")


def prose(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_is_kneser_ney(spark, order, monkeypatch):
    monkeypatch.setattr(language_model, "FEW", 2)
    texts = ["the cat sat on the mat", "The cat ate; the dog sat", "a dog on a mat sat", None, "", "the cat", "on the mat on the cat", "the cat sat on the mat again", "so so so so so so so so"]
    got = {r.doc_id: r for r in language_model.perplexity(spark, frame(spark, texts), order=order).collect()}
    padded = [["<s>"] * (order - 1) + tokens(t) + ["</s>"] if tokens(t) else [] for t in texts]
    runs = [[tuple(d[i : i + order]) for i in range(len(d) - order + 1)] for d in padded]
    counts = {order: Counter(x for d in runs for x in d)}
    for k in range(order - 1, 0, -1):  # how many different words stand before each
        counts[k] = Counter(x[1:] for x in counts[k + 1])
    d = {k: language_model.discounts([sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]) for k, c in counts.items()}

    def p(x):
        k = len(x)
        if k == 1:
            rest = sum(d[1][min(c, 3)] for c in counts[1].values())
            c = counts[1][x]
            return (max(c - d[1][min(c, 3)], 0) + rest / (len(counts[1]) + 1)) / sum(counts[1].values())
        seen = [c for y, c in counts[k].items() if y[:-1] == x[:-1]]
        if not seen:
            return p(x[1:])
        c = counts[k][x]
        return (max(c - d[k][min(c, 3)], 0) + sum(d[k][min(c, 3)] for c in seen) * p(x[1:])) / sum(seen)

    for x in (runs[0][0], runs[1][2], runs[2][3]):
        assert abs(sum(p((*x[:-1], *w)) for w in counts[1]) + p((*x[:-1], "unknown")) - 1) < 1e-9
    for i, mine in enumerate(runs, 1):
        if not mine:
            assert got[i].perplexity is None and got[i].n_words == 0
            continue
        bits = -sum(math.log2(p(x)) for x in mine)
        assert got[i].bits == pytest.approx(bits, rel=1e-9)
        assert got[i].perplexity == pytest.approx(2 ** (bits / len(mine)), rel=1e-9)


def test_language_model_of_other_texts(spark):
    """Unknown words and contexts; many parts; large counts."""
    rng = random.Random(31)
    corpus = frame(spark, [prose(rng, 200, 60) for _ in range(40)] + ["again " * 900])
    new = frame(spark, ["never seen words here", "again again again", "w1 w2 never w3", prose(rng, 50, 60)])
    got = [r.perplexity for r in language_model.perplexity(spark, new, corpus).orderBy("doc_id").collect()]
    assert got[1] < got[3] < got[2] and got[3] < got[0]
    n = np.array([1, 254, 255, 256, 70_000])
    columns = [np.array([5, 5, 7, 9, 9], np.uint32), np.array([1, 1, 1, 2, 2], np.uint32), np.array([3, 4, 1, 1, 2], np.uint32)]
    back, counts = language_model.decoded(language_model.encoded(columns, n), 3)
    assert all((a == b).all() for a, b in zip(back, columns, strict=True)) and (counts == n).all()


def naive_difference(sizes, k):
    """The k sums: the two partial partitions of largest spread (then first made) are combined, until one is left."""
    now = [(i, [x] + [0] * (k - 1)) for i, x in enumerate(sizes)]
    made = len(now)
    while len(now) > 1:
        now.sort(key=lambda p: (p[1][-1] - p[1][0], p[0]))
        (_, x), (_, y) = now[:2]
        now = [*now[2:], (made, sorted((a + b for a, b in zip(x, reversed(y), strict=True)), reverse=True))]
        made += 1
    return now[0][1]


def test_differencing():
    got, sums = sharding.difference([[8], [7], [6], [5], [4]], 2)
    assert sorted(sums) == [14, 16]
    rng = random.Random(3)
    for k in (1, 2, 3, 5, 8):
        sizes = [rng.randrange(1, 1000) for _ in range(80)]
        got, sums = sharding.difference([[x] for x in sizes], k)
        real = [0] * k
        for (s,), x in zip(got, sizes, strict=True):
            real[s] += x
        assert real == sums == naive_difference(sizes, k)


@pytest.mark.parametrize("shards", [257, 514, 1000])
def test_sharding_gives_as_many_shards_as_asked(spark, shards):
    rng = random.Random(shards)
    docs = frame(spark, ["x" * rng.randrange(1, 100) for _ in range(6000)])
    size = Counter()
    for r in sharding.shard(spark, docs, F.col("doc_id"), shards=shards).collect():
        size[r.shard_id] += r.bytes
    assert sorted(size) == list(range(shards)) and max(size.values()) - min(size.values()) < 60


@pytest.mark.parametrize(("most", "block"), [(256, 20_000), (4, 16)])
def test_sharding_keeps_groups(spark, monkeypatch, most, block):
    monkeypatch.setattr(sharding, "MOST", most)
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", block)
    rng = random.Random(5)
    docs = frame(spark, [None, "", *["x" * rng.randrange(1, 300) for _ in range(300)]])
    rows = sharding.shard(spark, docs, F.col("doc_id") % 120, shards=8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(1, 303))
    of, size = defaultdict(set), Counter()
    for r in rows:
        of[r.group_id].add(r.shard_id)
        size[r.shard_id] += r.bytes
    assert all(len(x) == 1 for x in of.values()) and len(size) == 8
    assert max(size.values()) - min(size.values()) < 400


def test_top_k(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 6)), 2)
    x[10:20] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, [1.0] * 6), (901, [float("nan")] * 6), (902, [1.0]), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5, x[5].tolist())]
    got = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=7, shard_size=64).collect()
    s = np.round(x @ x.T, 6)
    want = {(i, r + 1, j) for i in range(300) for r, j in enumerate(sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:7])}
    assert {(r.vec_id, r["rank"], r.neighbour_id) for r in got} == want and len(got) == len(want)
    assert topk.top_k(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    other = spark.createDataFrame([(1, [1.0], 5, 6, "a"), (2, [2.0], 5, 6, "b"), (2, [9.0], 5, 6, "b"), (3, [], 5, 6, "c")], "vec_id long, embedding array<double>, cell long, shard long, x string")
    assert sorted(map(tuple, topk.top_k(spark, other).collect())) == [(1, 1, 2, 2.0), (2, 1, 1, 2.0)]


def test_top_k_of_clusters_and_copies(spark):
    """Shards far apart are left out, copies beyond a shard are spread, and the answers are those of all pairs."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(100, 5)) + 30 * rng.normal(size=5) for _ in range(5)] + [np.ones((150, 5))])
    got = topk.top_k(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), k=5, shard_size=64).collect()
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -np.inf)
    want = {(i, r + 1, int(j)) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[i]))[:5])}
    assert {(r.vec_id, r["rank"], r.neighbour_id) for r in got} == want
    cells = topk.Cells.fit(x, 8)
    assert len(set(cells.of(x).tolist())) > 4 and len(set(cells.of(x[500:]).tolist())) == 1


def test_surrogates(spark):
    a = "Mr. Tom Ray wrote to tom.ray@corp.com from 10.20.3.44, call +1 555-123-4567. Card 4111 1111 1111 1111, SSN 123-45-6789."
    b = "Dr. Ray answered TOM.RAY@CORP.COM (+1 555 123 4567); Г-жа Анна Иванова, token = abcdef0123456789abcd"
    c = "Nothing here in 2024, version 1.2.3, is personal: 100 000 items."
    out = {r.doc_id: r for r in surrogates.pseudonymise(spark, frame(spark, [a, b, c, None, a])).collect()}
    x, y = out[1].text, out[2].text
    assert out[3].text == c and out[4].text is None and out[5].text == x and out[1].n_chars == len(x)
    for gone in ("Tom", "Ray", "tom.ray", "10.20.3.44", "123-4567", "4111 1111", "123-45-6789"):
        assert gone.lower() not in x.lower()
    card = re.search(r"\d{4} \d{4} \d{4} \d{4}", x).group().replace(" ", "")
    assert surrogates.luhn(card) == 0 and re.search(r"\+\d \d{3}-\d{3}-\d{4}", x) and re.search(r"\b\d\d\.\d\d\.\d\.\d\d\b", x)
    mail = re.search(r"\S+@\S+\.example\.com", x).group()
    assert mail.upper() in y
    assert re.search(r"Mr\. \w+ (\w+)", x).group(1) == re.search(r"Dr\. (\w+)", y).group(1)
    assert re.search(r"\+\d [\d-]+", x).group().replace("-", " ") in y
    assert re.search("Г-жа [А-Я][а-я]+ [А-Я][а-я]+", y) and "Анна" not in y
    assert re.search("token = [0-9a-f]{20}$", y) and "abcdef0123456789abcd" not in y
    assert surrogates.pseudonymise(spark, frame(spark, [a]), key=b"other").first().text != x


def test_surrogates_are_distinct(spark, monkeypatch):
    """With room for few surrogates, collisions are drawn again until none is left."""
    true = surrogates.surrogate
    few = {k: (parts[:3], {g: e[:1] for g, e in ends.items()}) for k, (parts, ends) in surrogates._SCRIPTS.items()}
    monkeypatch.setattr(surrogates, "_SCRIPTS", few)
    names = [a + b + c for a in ("Bo", "Ka", "Li") for b in ("ra", "ne", "so") for c in ("n", "l", "m")]
    forms = sorted(n.lower() for n in names)
    draws, attempt = [true("name", f) for f in forms], 0
    assert len(set(draws)) < len(forms)  # they do collide
    monkeypatch.undo()
    out = [r.text for r in surrogates.pseudonymise(spark, frame(spark, [f"Dr. {n} spoke" for n in names] * 2)).orderBy("doc_id").collect()]
    assert out[: len(names)] == out[len(names) :] and len(set(out)) == len(names)
    assert not {t.split()[1] for t in out} & set(names) and attempt == 0


def test_surrogates_follow_a_person(spark):
    texts = [
        "Mr. Tom Ray met Dr. Tom Ray. Later Ray and Tom Ray left; TOM waved, tom-toms and Rayon stayed.",
        "Г-жа Анна Иванова и Иванова. Miss Dupont-Martin, Mr. Sean O'Brien and O'Brien again.",
        "Mrs. Kim Lee sang. Kim danced.",
        "fe80::1ff:fe23:4567:890a and 2001:0db8:85a3:0000:0000:8a2e:0370:7334, call 020 7946 0958 or 01 23 45 67 89 at 12:30:45.",
    ]
    x = [r.text for r in surrogates.pseudonymise(spark, frame(spark, texts)).orderBy("doc_id").collect()]
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Dr\. (\w+) (\w+)\. Later (\w+) and (\w+) (\w+) left; (\w+) waved, tom-toms and Rayon stayed\.", x[0])
    assert m[1] == m[3] == m[6] and m[2] == m[4] == m[5] == m[7] and m[8] == m[1].upper() and m[1] != "Tom" and m[2] != "Ray"
    m = re.fullmatch(r"Г-жа ([А-Я]\w+) ([А-Я]\w+) и (\w+)\. Miss ([A-Z]\w+)-([A-Z]\w+), Mr\. ([A-Z]\w+) O'([A-Z]\w+) and O'(\w+) again\.", x[1])
    assert m[2] == m[3] and m[1][-1] in "ая" and m[2][-1] in "ая" and m[7] == m[8] and "Brien" not in x[1]
    female = surrogates._SCRIPTS["latin"][1]["f"]
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) sang\. (\w+) danced\.", x[2])
    assert m[1] == m[3] and m[1].endswith(tuple(female))
    assert re.fullmatch(r"[0-9a-f]{4}::[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]{4}:[0-9a-f]{4} and (?:[0-9a-f]{4}:){7}[0-9a-f]{4}, call 0\d\d \d{4} \d{4} or 0\d(?: \d\d){4} at 12:30:45\.", x[3])
    assert "7946" not in x[3] and "8a2e" not in x[3]


def test_surrogates_by_brute_force(spark):
    """Over a whole table: outside the mentions texts are the same; surrogates are a one-to-one map of the real values, which none of them equals."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mails = [f"write to u{i}@h{i:04d}.com or u{i}@h{i:04d}.com. Dr. Nam{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} x" for i in range(2000)]
    docs = docs.select("doc_id", "text").union(frame(spark, mails, 10**6).select("doc_id", "text"))
    new = {r.doc_id: r.text for r in surrogates.pseudonymise(spark, docs).collect()}
    to = defaultdict(lambda: defaultdict(set))
    for r in docs.collect():
        found, at, rest = surrogates.entities(r.text or ""), 0, new[r.doc_id] or ""
        for (a, b, kind, form, _), stop in zip(found, [*(f[0] for f in found[1:]), len(r.text or "")], strict=False):
            assert rest.startswith(r.text[at:a])
            rest = rest[a - at :]
            tail = r.text[b:stop]
            k = rest.index(tail) if tail else len(rest)
            to[kind][form].add(rest[:k].lower() if kind in ("email", "name") else re.sub(r"[^\w+]", "", rest[:k]) if kind in ("phone", "card", "ssn", "iban") else rest[:k])
            rest, at = rest[k:], b
        assert rest == (r.text or "")[at:]
    assert len(to["email"]) >= 2000 and {"email", "name", "phone"} <= set(to)
    for kind, forms in to.items():
        if kind in ("phone", "secret"):  # formats of one number differ in their country code
            continue
        drawn = [next(iter(x)) for x in forms.values()]
        assert all(len(x) == 1 for x in forms.values()), kind
        assert len(set(drawn)) == len(drawn) and not set(drawn) & set(forms), kind
    assert len({next(iter(x)).split("@")[1] for x in to["email"].values()}) == len({f.split("@")[1] for f in to["email"]})


def test_redraws_have_an_end():
    for kind, form in (("ssn", "123456789"), ("phone", "0123456"), ("ip", "1.2.3.4"), ("card", "4111111111111111"), ("domain", "x.com"), ("email", "a@x.com"), ("name", "li"), ("secret", "abcdef0123456789"), ("iban", "DE89370400440532013000"), ("ip6", "::1")):
        assert len({surrogates.surrogate(kind, form, i) for i in range(40)}) >= 25 and len(surrogates.surrogate(kind, form, 60)) > len(form)


def test_licences(spark):
    texts = ["Released under the MIT License.", "released under, the mit -- LICENSE; all rights reserved. All Rights Reserved!", "the mit license", None, "", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "Redistribution and use in source and binary forms x x x x x x x x x x are permitted provided that", "x " * 5000 + "licensed under CC BY-SA 4.0"]
    got = {(r.doc_id, r.licence): r.notices for r in licences.counted(licences.scan(spark, frame(spark, texts))).collect()}
    want = Counter()
    for i, t in enumerate(texts, 1):
        w = " ".join(tokens(t))
        for name, ps in licences.parsed():
            pattern = r"\b" + " ".join(ps[0][1])
            for (a, p), (b, q) in zip(ps, ps[1:], strict=False):
                gap = b - a - len(p)
                pattern += rf"(?: \S+){{{max(0, gap - licences.SLACK)},{gap + licences.SLACK}}}? " + " ".join(q)
            if n := len(re.findall(pattern + r"\b", w)):
                want[i, name] += n
    assert got == dict(want) and got[2, "Proprietary"] == 2 and (7, "BSD") not in got
    spans = licences.scan(spark, frame(spark, texts)).where("doc_id = 1").first()
    assert texts[0][spans.start : spans.stop] == "Released under the MIT License"


def test_licences_in_notices_of_their_own_wording(spark):
    """Notices as files carry them, not as the list spells them."""
    texts = {
        "MIT": 'Copyright (c) 2020 X\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction.',
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors",
        "ISC": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted",
        "GPL-2.0": "either version 2 of the License, or (at your option) any later version.",
        "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file)",
        "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0",
        "GPL-3.0-or-later": "// SPDX-License-Identifier: GPL-3.0-or-later",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,",
    }
    rows = licences.scan(spark, frame(spark, list(texts.values()))).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r.doc_id][r.licence] = r.coverage
    for i, name in enumerate(texts, 1):
        assert name in got[i], (name, dict(got[i]))
    assert "BSD" in got[2] and got[2]["BSD-3-Clause"] > 0.95 and got[1]["MIT"] < 0.9 and len({n for n, _ in licences.TEMPLATES}) >= 40


def test_kth_largest(spark):
    rng = random.Random(2)
    x = [rng.choice([rng.gauss(0, 100), 1.5, 2e6]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    for k in (1, 2, 100, 250, 499, 500):
        assert resample.kth_largest(df, "v", k) == sorted(x, reverse=True)[k - 1]


def test_resampling_keeps_good_documents(spark):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["river", "stone", "light", "paper", "music", "the", "of", "and"]) for _ in range(80)) for _ in range(300)]
    bad = [" ".join(rng.choice(["zzz", "qq", "click", "!!!", "$$$", "buy"]) for _ in range(80)) for _ in range(150)]
    docs = frame(spark, good + bad)
    known = labels(spark, [(i, int(i <= 300), 0) for i in range(1, 451) if i % 3 == 0])
    ids = {r.doc_id for r in resample.select(spark, docs, known).collect()}
    unseen = [i for i in range(1, 451) if i % 3]
    assert sum(i in ids for i in unseen if i <= 300) >= 0.97 * sum(i <= 300 for i in unseen)
    assert sum(i in ids for i in unseen if i > 300) <= 0.1 * sum(i > 300 for i in unseen)
    assert ids == {r.doc_id for r in resample.sample(spark, docs, known).collect()}
    assert resample.select(spark, docs, labels(spark)).count() == 450


def test_resampling_rejects_toxic_documents(spark):
    rng = random.Random(21)
    plain, slurs = ["river", "stone", "light", "paper", "music", "the", "of", "and"], ["idiot", "scum", "moron"]
    clean = [" ".join(rng.choice(plain) for _ in range(80)) for _ in range(300)]
    toxic = [" ".join(rng.choice(plain if rng.random() < 0.6 else slurs) for _ in range(80)) for _ in range(150)]
    docs = frame(spark, clean + toxic)
    known = labels(spark, [(i, 1, int(i > 300)) for i in range(1, 451) if i % 3 == 0])
    ids = {r.doc_id for r in resample.select(spark, docs, known).collect()}
    unseen = [i for i in range(1, 451) if i % 3]
    assert sum(i in ids for i in unseen if i <= 300) >= 0.97 * sum(i <= 300 for i in unseen)
    assert sum(i in ids for i in unseen if i > 300) <= 0.1 * sum(i > 300 for i in unseen)


def resampled(rows, known):
    """The sample, by counting strings: buckets are told apart by nothing but their hashes."""
    def buckets(t):
        w = [m.group() for m in re.finditer(r"\w+|[^\w\s]+", t or "")]
        h = [int(resample.words([x], fold=False, marks=True).hash[0]) for x in w]
        one = [x >> 48 for x in h]
        two = [int(resample.mix(np.array([(x * int(resample._G) + y) & (2**64 - 1)], np.uint64))[0]) >> 48 for x, y in zip(h, h[1:], strict=False)]
        return one + two

    of = {i: buckets(t) for i, t in rows}
    quality = {}
    for i, q, toxic in known:
        quality[i] = min(quality.get(i, 1), 0 if toxic == 1 else q)
    half = resampled.half
    good = [i for i in of if quality.get(i, 0) > 0 and half[i] == 0]
    raw, target = Counter(b for x in of.values() for b in x), Counter(b for i in good for b in of[i])
    share = sum(target.values()) / sum(raw.values())
    ratio = {b: math.log((target[b] + 50) / (share * raw[b] + 50)) for b in raw}
    weight = {i: sum(ratio[b] for b in x) for i, x in of.items()}
    g, bad = (sorted(weight[i] for i in quality if i in weight and half[i] == 1 and (quality[i] > 0) == kind) for kind in (True, False))
    values = sorted({*g, *bad})
    cuts = [values[0], *((a + b) / 2 for a, b in zip(values, values[1:], strict=False))]
    loss = [sum(20 / len(g) for x in g if x < c) - sum(1 / len(bad) for x in bad if x < c) for c in cuts]
    cut = cuts[min(range(len(cuts)), key=lambda i: (round(loss[i], 12), i))]
    k = sum(x >= cut for x in weight.values())
    draw = {i: weight[i] + resample.gumbel([i], [t])[0] for i, t in rows}
    return weight, set(sorted(draw, key=lambda i: -draw[i])[:k])


def test_resampling_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    resampled.half = {r[0]: r[1] for r in docs.select("doc_id", resample._half()).collect()}
    weight, want = resampled(rows, [tuple(r) for r in known.select("doc_id", "quality", "toxic").collect()])
    got = {r.doc_id: r for r in resample.sample(spark, docs, known).collect()}
    assert got.keys() == want and 0 < len(want) < len(rows)
    for i, r in got.items():
        assert r.log_weight == pytest.approx(weight[i], abs=1e-6)


def test_noise_is_of_the_whole_text():
    a, b = "one " + "same " * 100, "two " + "same " * 100
    x, y, z = resample.gumbel([7, 7, 7], [a, b, a])
    assert x != y and x == z
    draws = resample.gumbel(list(range(20_000)), ["t"] * 20_000)
    assert abs(draws.mean() - 0.5772) < 0.03 and abs(draws.std() - math.pi / math.sqrt(6)) < 0.03


def brute_spans(text, items, n=decontaminate.N_WORDS):
    grams = {}
    for i, t in items:
        w = tokens(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    at = [(m.group().lower(), *m.span()) for m in re.finditer(r"\w+", text or "")]
    spans, found = [], set()
    for k in range(len(at) - n + 1):
        if g := grams.get(tuple(x[0] for x in at[k : k + n])):
            spans.append((at[k][1], at[k + n - 1][2]))
            found |= g
    return decontaminate.merge(spans), sorted(found)


def test_decontamination(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    whole = frame(spark, [items[0][1], f"Before. {items[1][1].upper()} After.", f"{items[2][1]} {items[2][1]}", None, ""], first=10**6)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(whole)
    rows = docs.collect()
    want = {r.doc_id: s for r in rows if (s := brute_spans(r.text, items))[0]}
    got = {r.doc_id: ([(s.start, s.stop) for s in r.spans], r.item_ids) for r in decontaminate.contamination(spark, docs, bench).collect()}
    assert got == want and 10**6 + 1 in got
    left = {r.doc_id: r for r in decontaminate.remove(spark, docs, bench).collect()}
    for r in rows:
        t = decontaminate.cut(r.text, want[r.doc_id][0]) if r.doc_id in want else r.text
        if r.doc_id in want and not any(c.isalnum() for c in t):
            assert r.doc_id not in left
        else:
            assert left[r.doc_id].text == t and left[r.doc_id].n_chars == (None if t is None else len(t))
    none = spark.createDataFrame([(1, None), (2, "too short"), (None, "")], "item_id long, text string")
    assert decontaminate.contamination(spark, docs, none).count() == 0


def test_lookups_of_contexts_with_many_words(spark):
    """Counts and sums of contexts of few and of many words; those of many are searched one by one, in mapped files as plain arrays."""
    rng = np.random.default_rng(29)
    texts = [" ".join(f"a b{rng.zipf(1.3) % 300} c{rng.zipf(1.5) % 9}" for _ in range(60)) for _ in range(40)]
    m = language_model.Model(language_model.train(spark, frame(spark, texts), 2))
    columns, _ = language_model.ngrams(texts[:20] + ["a b1 unseen a"], m.files, m.n_words, 2)
    order = language_model.by_two(columns[0].astype(np.uint64), columns[1])
    assert (order.size, 0) == (len(columns[0]), (np.stack(columns)[:, order] != np.stack(columns)[:, np.lexsort(columns[::-1])]).sum())
    columns = list(np.unique(np.stack(columns, 1), axis=0).T)
    every = Counter(zip(*(c.tolist() for c in language_model.ngrams(texts, m.files, m.n_words, 2)[0]), strict=True))
    after = defaultdict(list)
    for (u, _), k in every.items():
        after[u].append(k)
    assert max(map(len, after.values())) > 4 * language_model.FEW
    count, sums = m._counts(columns)
    for u, w, c, t in zip(*(x.tolist() for x in columns), count.tolist(), sums.tolist(), strict=True):
        v = after[u]
        assert (c, t) == (every[u, w], [sum(v), v.count(1), v.count(2), sum(k > 2 for k in v)])
    assert all(type(a) is np.ndarray and type(a.base) is not np.memmap for arrays in m.files.open.values() if arrays for a in arrays if len(a))


def test_passages(spark):
    rng = random.Random(7)
    shared = [prose(rng, 70, 5000) for _ in range(6)]
    texts, holds = [], defaultdict(list)
    for i in range(1, 61):
        parts = [prose(rng, rng.randrange(20, 120), 5000)]
        if i % 3 == 0:
            k = i % 6 if i % 2 else i % 4
            w = shared[k].split()
            if i % 5 == 0:
                w[35:36] = ["changed", "words"]
            parts += [" ".join(w), prose(rng, 30, 5000)]
            holds[k].append(i)
        texts.append(" ".join(parts))
    texts += [None, "", "short text"]
    got = passages.repeated(spark, frame(spark, texts)).collect()
    pairs = {(r.first_doc_id, r.doc_id) for r in got}
    # a changed passage may also be found against the first that has the same change
    assert pairs >= {(ids[0], i) for ids in holds.values() for i in ids[1:]}
    assert pairs <= {(i, j) for ids in holds.values() for i in ids for j in ids if i < j}
    for r in got:
        a, b = tokens(texts[r.first_doc_id - 1][r.first_start : r.first_stop]), tokens(texts[r.doc_id - 1][r.start : r.stop])
        assert len(b) == r.words >= 68 and r.matching >= 0.8 * max(len(a), len(b))
    assert passages.repeated(spark, frame(spark, texts[:2] + texts[-3:])).count() == 0


def test_passage_near_a_longer_one(spark):
    """The best-scoring predecessor is out of reach; the one just before is not."""
    rng = random.Random(17)
    long, piece = prose(rng, 500, 5000), prose(rng, 57, 5000).split()
    first = f"{long} {prose(rng, 40, 5000)} {' '.join(piece)} {prose(rng, 30, 5000)}"
    second = f"{long} {prose(rng, 40, 5000)} {' '.join([*piece[:28], 'inserted', *piece[28:]])} {prose(rng, 30, 5000)}"
    got = sorted((r.start, r.words) for r in passages.repeated(spark, frame(spark, [first, second])).collect())
    assert len(got) == 2 and got[0][1] >= 500 and 57 <= got[1][1] <= 60
    seg = np.array([(0, 500, 0, 500, 300), (540, 568, 540, 568, 20), (568, 597, 569, 598, 20)])
    assert passages.chain(seg) == [[0], [1, 2]]


def test_passages_of_repeated_ids(spark):
    rng = random.Random(18)
    shared = prose(rng, 80, 5000)
    texts = [f"{prose(rng, n, 5000)} {shared} {prose(rng, 30, 5000)}" for n in (20, 90, 40)]
    base = passages.repeated(spark, frame(spark, texts)).collect()
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    same = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    assert Counter(passages.repeated(spark, same).collect()) == Counter(base) and base
    other = [(1, f"~ {prose(rng, 200, 5000)}"), (2, f"~ {shared[::-1]} {shared}"), (3, None)]  # "~" sorts after the words
    assert Counter(passages.repeated(spark, spark.createDataFrame(other + rows, "doc_id long, text string")).collect()) == Counter(base)


def test_passage_first_seen_in_parts(spark):
    rng = random.Random(19)
    w = prose(rng, 100, 5000).split()
    held = {5: w[:45], 6: w[45:], 20: w, 25: w[:30], 30: w}
    docs = spark.createDataFrame([(i, f"{prose(rng, 40, 5000)} {' '.join(p)} {prose(rng, 40, 5000)}") for i, p in held.items()], "doc_id long, text string")
    got = {(r.first_doc_id, r.doc_id): r.words for r in passages.repeated(spark, docs).collect()}
    assert got.keys() == {(20, 30), (6, 20), (6, 30)}  # 6 has 55 words of it
    assert 100 <= got[20, 30] <= 102


def test_word_said_over_and_over(spark):
    rng = random.Random(20)
    docs = frame(spark, [f"{prose(rng, n, 5000)} {'again ' * m} {prose(rng, 30, 5000)}" for n, m in ((20, 3000), (70, 3000), (40, 400))])
    got = {(r.first_doc_id, r.doc_id): r.words for r in passages.repeated(spark, docs).collect()}
    assert got[1, 2] >= 3000 and got[1, 3] >= 400
    assert len(passages.seeds(["again " * 3000])[0]) <= 3000 / passages.STEP + 1


def test_chains_against_all_predecessors():
    """The best chain's score, by trying every predecessor of every segment."""
    rng, k, gap = random.Random(22), passages.K, passages.MAX_GAP
    for _ in range(200):
        seg = []
        for _ in range(rng.randrange(2, 14)):
            a, b, n = rng.randrange(200), rng.randrange(200), rng.randrange(k, 30)
            seg.append((a, a + n, b, b + n + rng.randrange(2), rng.randrange(k, n + 1)))
        seg = sorted(set(seg), key=lambda x: (x[0], x[2]))
        best = []
        for i, (a0, _, b0, _, w) in enumerate(seg):
            got = [0.0]
            for j, (c0, c1, _, d1, _) in enumerate(seg):
                if j < i and max(c1 - k + 1, c0 + 1) <= a0 <= c1 + gap and b0 - gap <= d1 <= b0 + k - 1:
                    got.append(min(best[j], best[j] - passages.GAP_COST * (a0 - c1 + b0 - d1)))
            best.append(w + max(got))
        chains = passages.chain(np.array(seg))
        assert sorted(i for c in chains for i in c) == list(range(len(seg)))
        score = 0.0
        for i, j in zip([None, *chains[0]], chains[0], strict=False):
            d = 0 if i is None else passages.GAP_COST * (seg[j][0] - seg[i][1] + seg[j][2] - seg[i][3])
            score = seg[j][4] + (0 if i is None else min(score, score - d))
        assert score == pytest.approx(max(best))


def test_gaps_against_recursion():
    rng = random.Random(23)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert passages._gap(np.array(a), np.array(b)) == t[-1][-1]


@pytest.mark.parametrize(("changed", "kinds", "least"), [(0.05, "s", 0.97), (0.1, "s", 0.9), (0.1, "sid", 0.8), (0.15, "s", 0.75)])
def test_recall_of_changed_passages(spark, changed, kinds, least):
    """Passages of 80 words, each word changed with some chance, in unrelated surroundings."""
    rng = random.Random(24)
    rows = []
    for i in range(120):
        w = prose(rng, 80, 5000).split()
        v = []
        for x in w:
            kind = rng.choice(kinds) if rng.random() < changed else ""
            v += {"": [x], "s": [f"n{rng.randrange(5000)}"], "i": [f"n{rng.randrange(5000)}", x], "d": []}[kind]
        rows += [(i, f"{prose(rng, 40, 5000)} {' '.join(w)} {prose(rng, 40, 5000)}"), (1000 + i, f"{prose(rng, 60, 5000)} {' '.join(v)} {prose(rng, 60, 5000)}")]
    got = {(r.first_doc_id, r.doc_id) for r in passages.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= {(i, 1000 + i) for i in range(120)}
    assert len(got) >= least * 120, len(got)


def test_spans_of_a_hot_document(spark, monkeypatch):
    rng = random.Random(25)
    shared = prose(rng, 70, 5000)
    docs = frame(spark, [f"{prose(rng, 30, 5000)} {shared} {prose(rng, 30, 5000)}" for _ in range(40)])
    want = sorted(passages.repeated(spark, docs).collect())
    monkeypatch.setattr(passages, "SPANS", 5)
    assert sorted(passages.repeated(spark, docs).collect()) == want and len(want) >= 39


def varied(rng, w, n):
    """Words w with n of them changed, far from each other."""
    w = list(w)
    for i in rng.sample(range(1, len(w) // 10), n):
        w[10 * i + rng.randrange(3)] = f"c{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("n", [12, 45])  # 45: more than passages.COLD
def test_passages_of_every_pair(spark, n):
    """Each two of many texts of one passage are linked, copies of a passage to their first, a short line links none."""
    rng = random.Random(26)
    base, line, same = prose(rng, 90, 5000).split(), prose(rng, 20, 5000), prose(rng, 70, 5000)
    rows = [(i, f"{prose(rng, 30, 5000)} {varied(rng, base, 3)} {prose(rng, 80, 5000)} {line} {prose(rng, 80, 5000)}") for i in range(n)]
    rows += [(1000 + i, f"{prose(rng, 80, 5000)} {line} {prose(rng, 80, 5000)} {same} {prose(rng, 30, 5000)}") for i in range(n)]
    rows += [(2000 + i, rows[5][1]) for i in range(3)]
    got = passages.repeated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    pairs = {(r.first_doc_id, r.doc_id) for r in got}
    want = {(i, j) for j in range(n) for i in range(j)} | {(5, 2000 + i) for i in range(3)}
    assert {x for x in pairs if x[0] < 1000} == want
    same = {x for x in pairs if x[0] >= 1000}
    assert same >= {(1000, 1000 + i) for i in range(1, n)}
    if n > passages.COLD:  # the seeds at the passage's ends that few documents chose still link some others
        assert len(same) < n * (n - 1) // 4
    whole = [r for r in got if r.doc_id >= 2000]
    assert all(rows[5][1][r.start : r.stop] == rows[5][1] and r.words == r.matching == 290 - 20 + 30 for r in whole)


@pytest.mark.parametrize("n", [3, 12, 45])
def test_classes_against_every_pair(spark, n):
    """Stretches linked by any passage of ``repeated`` are of one class, others aren't; the query gives a row for each, not for each pair."""
    from textloom.llm.queries import QUERIES

    rng = random.Random(29)
    base, line, parts = prose(rng, 90, 5000).split(), prose(rng, 20, 5000), [prose(rng, 60, 5000).split() for _ in range(2)]
    rows = [(i, f"{prose(rng, 30, 5000)} {varied(rng, base, 3)} {prose(rng, 80, 5000)} {line} {prose(rng, 80, 5000)}") for i in range(n)]
    # halves first seen apart, whole in others
    rows += [(1000 + i, f"{prose(rng, 40, 5000)} {' '.join(w)} {line} {prose(rng, 40, 5000)}") for i, w in enumerate([*parts, *[parts[0] + parts[1]] * 3])]
    rows += [(2000 + i, rows[1][1]) for i in range(3)] + [(3000 + i, f"{prose(rng, 60, 5000)} {line} {prose(rng, 60, 5000)}") for i in range(n)]
    docs, text = spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)
    got, spans = passages.classes(spark, docs).collect(), defaultdict(list)
    for r in got:
        spans[r.doc_id].append((r.start, r.stop, r.class_id))
        assert len(tokens(text[r.doc_id][r.start : r.stop])) == r.words >= 50
        assert r.first_doc_id == int(r.class_id.split(":")[0]) <= r.doc_id
    root, linked = {}, passages.repeated(spark, docs).collect()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in linked:
        ends = [[s for s in spans[d] if s[0] < stop and start < s[1]] for d, start, stop in ((r.doc_id, r.start, r.stop), (r.first_doc_id, r.first_start, r.first_stop))]
        assert len(ends[0]) == len(ends[1]) == 1 and ends[0][0][2] == ends[1][0][2]
        x, y = find((r.doc_id, ends[0][0][0])), find((r.first_doc_id, ends[1][0][0]))
        root[x] = y
    assert {(r.doc_id, r.start) for r in got} == set(root)
    assert len({find(x) for x in root}) == len({r.class_id for r in got}) == 2
    assert len(got) == n + 5 + 3 and (n == 3 or len(linked) > len(got))
    assert "classes" in QUERIES["op8_passages"].__code__.co_names


def test_hot_links_against_all_pairs():
    """Pairs of occurrences with equal words beyond the run that both share, and the first of each longer run's copies."""
    rng, far = np.random.default_rng(27), passages.REACH

    def brute(a, b):
        r = next((k for k in range(far) if a[k] != b[k] or a[k] == 0), far)
        runs = lambda v, m: {(k, tuple(v[k : k + m])) for k in range(r, far - m + 1) if 0 not in v[k : k + m]}
        return r, bool(runs(a, 3) & runs(b, 3)) or bool({x for _, x in runs(a, 4)} & {x for _, x in runs(b, 4)})

    for n, most in ((40, 3), (60, 40), (50, 9)):
        near = np.repeat(rng.integers(1, 60000, (3, 2, far)), n // 3 + 1, 0)[rng.permutation(n)].astype(np.uint16)
        for k in range(n):
            for side in (0, 1):
                at = rng.integers(0, far, rng.integers(0, most))
                near[k, side, at] = rng.integers(1, 60000, len(at))
                if rng.random() < 0.3:
                    near[k, side, rng.integers(0, far) :] = 0
                elif rng.random() < 0.3:
                    cut = rng.integers(0, far)
                    near[k, side, cut:] = rng.integers(1, 60000, far - cut)
        group = np.sort(rng.integers(0, 2, n))
        got = set(zip(*(x.tolist() for x in passages.hot_links(group, near)), strict=True))
        must, may = set(), set()
        runs = {}
        for i in range(n):
            for j in range(i + 1, n):
                if group[i] == group[j]:
                    (left, x), (right, y) = (brute(near[i, s].tolist(), near[j, s].tolist()) for s in (0, 1))
                    if x or y:
                        must.add((i, j))
                    elif left + passages.K + right >= passages.MIN_WORDS:
                        runs.setdefault((i, j), (left, right))
        assert must <= got
        for (i, j), (left, right) in runs.items():
            alike = [k for k in range(j) if group[k] == group[i] and (near[k, 0, :left] == near[i, 0, :left]).all() and (near[k, 1, :right] == near[i, 1, :right]).all()]
            assert alike[0] == i or (alike[0], i) in got
            assert (alike[0], j) in got
            may |= {(alike[0], i), (alike[0], j)}
        short = {(i, j) for i, j in got - must if brute(near[i, 0].tolist(), near[j, 0].tolist())[0] + brute(near[i, 1].tolist(), near[j, 1].tolist())[0] + passages.K < passages.MIN_WORDS}
        assert not short


def test_hot_seeds_in_blocks(monkeypatch, tmp_path):
    """Blocks of a very hot seed's documents give the links that one task gives."""
    rng = random.Random(28)
    base = prose(rng, 90, 5000).split()
    texts = [f"{prose(rng, 30, 5000)} {varied(rng, base, 3)} {prose(rng, 30, 5000)}" for _ in range(60)]
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": texts})
    where, kinds = str(tmp_path), (np.int64, np.int64, np.int32, np.int32)

    def found():
        list(passages._match(where, 1)(passages._seed(1)([docs])))
        return Counter(x for _, got in gathered(passages._hot(1)(passages._around(where, 1)([docs])), kinds) for x in zip(*(v.tolist() for v in got), strict=True))

    want = found()
    assert want and max(want.values()) == 1
    monkeypatch.setattr(passages, "BLOCK", 10)
    monkeypatch.setattr(passages, "TOGETHER", 8)  # sets of pairs as sorted arrays
    assert found() == want


def test_extensions_of_many_pairs():
    rng, far = np.random.default_rng(31), passages.REACH
    a = rng.integers(1, 4, (400, far)).astype(np.uint32)
    b = a.copy()
    for k in range(400):  # changed words, words left out, texts that end
        at = rng.integers(0, far, rng.integers(0, 12))
        b[k, at] = rng.integers(1, 9, len(at))
        cut, n = int(rng.integers(0, far - 5)), int(rng.integers(0, 5))
        b[k] = np.concatenate((b[k, :cut], b[k, cut + n :], np.zeros(n, np.uint32)))
        a[k, rng.integers(far // 2, 2 * far) :] = 0
    got = list(zip(*(x.tolist() for x in passages.reaches(a, b)), strict=True))
    assert got == [passages.reached(x[x != 0], y[y != 0])[:2] for x, y in zip(a, b, strict=True)]
    assert len(set(got)) > 50


def test_short_lines_are_not_tried_pair_by_pair(tmp_path):
    """Texts that share a line of 16 words and three equal words after it give no links; where the line goes on, or another seed is near, all do."""
    rng, kinds = random.Random(32), (np.int64, np.int64, np.int32, np.int32)
    line, more = prose(rng, 16, 5000), prose(rng, 40, 5000)

    def linked(name, text):
        docs, where = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": [text() for _ in range(40)]}), str(tmp_path / name)
        list(passages._match(where, 1)(passages._seed(1)([docs])))
        return {x for _, (a, b, _, _) in gathered(passages._hot(1)(passages._around(where, 1)([docs])), kinds) for x in zip(a.tolist(), b.tolist(), strict=True)}

    word = lambda: f"u{rng.randrange(10**9)}"
    rest = lambda: " ".join(word() for _ in range(60))
    assert linked("short", lambda: f"{rest()} {line} {word()} one two three {rest()}") == set()
    every = {(i, j) for j in range(40) for i in range(j)}
    assert linked("long", lambda: f"{rest()} {line} {word()} {more} {rest()}") == every
    assert linked("near", lambda: f"{rest()} {line} {word()} one two three {' '.join(word() for _ in range(20))} {line} {rest()}") == every


def naive_best_fit(sizes, rule="norm"):
    caps = (packing.WINDOW, packing.DOCS, packing.ATTENTION)
    demand = [(n / caps[0], 1 / caps[1], n * n / caps[2]) for n in sizes]
    weight = [sum(d[i] for d in demand) / len(demand) for i in range(3)]
    bins, out = [], []
    for d in demand:
        best = None
        for j, left in enumerate(bins):
            after = [x - y for x, y in zip(left, d, strict=True)]
            if min(after) >= -1e-9:
                score = sum(w * x * x for w, x in zip(weight, after, strict=True)) if rule == "norm" else -sum(w * x * y for w, x, y in zip(weight, d, left, strict=True))
                if best is None or score < best[0] - 1e-12:
                    best = score, j, after
        if best is None:
            bins.append([1 - y for y in d])
            out.append(len(bins) - 1)
        else:
            bins[best[1]] = best[2]
            out.append(best[1])
    return out


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit(rule):
    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 2048) if rng.random() < 0.5 else rng.randrange(1, 60) for _ in range(600)), reverse=True)
    assert packing.best_fit(np.array(sizes), rule=rule).tolist() == naive_best_fit(sizes, rule)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, rule):
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([1, 5, 50, 300, 2048, 5000])) for _ in range(300)] + [None, "", "a, b."]
    rows = packing.pack(spark, frame(spark, texts), rule=rule).collect()
    bins, of = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        of[r.doc_id].append(r)
    for b in bins.values():
        assert sum(r.n_tokens for r in b) <= packing.WINDOW and len(b) <= packing.DOCS and sum(r.n_tokens**2 for r in b) <= packing.ATTENTION
        assert sorted(r.slot for r in b) == list(range(len(b)))
    for i, t in enumerate(texts, 1):
        n = len(re.findall(r"\w+|[^\w\s]", t or ""))
        mine = sorted(of[i], key=lambda r: r.piece)
        assert sum(r.n_tokens for r in mine) == n and [r.first_token for r in mine] == [k * packing.PIECE_TOKENS for k in range(len(mine))]


def shingles(text):
    w = tokens(text)
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randrange(60, 300), 3000).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            w = base[:]
            for _ in range(rng.choice([0, 1, 3])):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    texts += ["one two", "One, two!", None, "", "solo"] + [texts[0]] * 30
    docs = frame(spark, texts)
    got = {r.doc_id: (r.group_id, r.kept) for r in near_duplicates.groups(spark, docs).collect()}
    sets = [shingles(t) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j]))
    pairs = {(i, j): near(i, j) for i in range(len(texts)) for j in range(i)}
    sure = [p for p, x in pairs.items() if x >= 0.7]
    joined = lambda i, j: i + 1 in got and j + 1 in got and got[i + 1][0] == got[j + 1][0]
    assert all(joined(*p) for p in sure)
    assert not any(joined(*p) for p, x in pairs.items() if x < 0.05)
    for i, (g, kept) in got.items():
        assert kept == (i == g) and g == min(k for k, (h, _) in got.items() if h == g)
    left = {r.doc_id for r in near_duplicates.deduplicate(spark, docs).collect()}
    assert left == {i for i in range(1, len(texts) + 1) if i not in got or got[i][1]}


def test_superminhash_by_steps():
    """Against the algorithm as published: element by element, step by step, with a permutation of its own."""
    rng = np.random.default_rng(6)
    h = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    sig = near_duplicates.superminhash(h, np.zeros(40, np.int64), 1)[0]
    mix, g = near_duplicates.mix, int(near_duplicates._G)
    best = [2**64 - 1] * near_duplicates.SLOTS
    for e in h.tolist():
        p = list(range(near_duplicates.SLOTS))
        for j in range(near_duplicates.SLOTS):
            x = mix(np.array([(e + g * (j + 1)) & (2**64 - 1)], np.uint64))
            k = j + ((int(mix(x ^ near_duplicates._G)[0]) >> 32) * (near_duplicates.SLOTS - j) >> 32)
            p[j], p[k] = p[k], p[j]
            best[p[j]] = min(best[p[j]], j << 57 | int(x[0]) >> 7)
    assert sig.tolist() == best


def test_large_buckets_are_compared_in_pieces(spark, monkeypatch):
    rng = random.Random(12)
    base = prose(rng, 120, 3000).split()
    texts = []
    for _ in range(60):
        w = base[:]
        w[rng.randrange(120)] = f"new{rng.randrange(1000)}"
        texts.append(" ".join(w))
    docs = frame(spark, texts + [prose(rng, 50) for _ in range(5)])
    want = sorted(near_duplicates.groups(spark, docs).collect())
    monkeypatch.setattr(near_duplicates, "BUCKET", 7)
    assert sorted(near_duplicates.groups(spark, docs).collect()) == want and len(want) == 60
    members = spark.createDataFrame([(1, i, 50) for i in range(50)] + [(2, i, 3) for i in range(3)], "key long, doc_id long, n long")
    pieces = defaultdict(set)
    for r in near_duplicates.split(members, 7).collect():
        pieces[r.key].add(r.doc_id)
    met = {(i, j) for p in pieces.values() for i in p for j in p if i < j}
    assert met == {(i, j) for i in range(50) for j in range(i + 1, 50)} and all(len(p) < 40 for p in pieces.values())


def test_near_duplicates_of_repeated_ids(spark):
    rng = random.Random(13)
    a, b = f"a {prose(rng, 80)}", f"b {prose(rng, 80)}"
    docs = spark.createDataFrame([(1, b, 9), (1, a, 9), (2, a, 9), (3, b, 9), (4, b, 9)], "doc_id long, text string, _nth int")
    assert sorted((r.doc_id, r.group_id) for r in near_duplicates.groups(spark, docs).collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]
    assert sorted((r.doc_id, r.text, r._nth) for r in near_duplicates.deduplicate(spark, docs).collect()) == [(1, a, 9), (3, b, 9)]


def test_superminhash_estimates():
    rng = np.random.default_rng(5)
    error = []
    for _ in range(60):
        h = rng.integers(1, 1 << 62, 150).astype(np.uint64)
        both = np.concatenate((h[:100], h[50:]))
        sig = near_duplicates.superminhash(both, np.repeat([0, 1], 100), 2)
        error.append((sig[0] == sig[1]).mean() - 1 / 3)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < math.sqrt(2 / 9 / near_duplicates.SLOTS)  # below MinHash's


BENCH = [(1, "one two three four five six seven eight nine")]


def calls(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    return {
        "lm": lambda d: language_model.perplexity(spark, d),
        "sharding": lambda d: sharding.shard(spark, d, sharding.copies()),
        "pii": lambda d: surrogates.pseudonymise(spark, d),
        "licences": lambda d: licences.scan(spark, d),
        "sample": lambda d: resample.sample(spark, d, labels(spark, [(1, 1, 0), (None, 0, 0), (5, 0, None), (7, None, 1)])),
        "select": lambda d: resample.select(spark, d, labels(spark, [(1, 1, 0), (5, 0, 0)])),
        "contamination": lambda d: decontaminate.contamination(spark, d, bench),
        "remove": lambda d: decontaminate.remove(spark, d, bench),
        "passages": lambda d: passages.repeated(spark, d),
        "packing": lambda d: packing.pack(spark, d),
        "groups": lambda d: near_duplicates.groups(spark, d),
        "deduplicate": lambda d: near_duplicates.deduplicate(spark, d),
    }


NAMES = ["lm", "sharding", "pii", "licences", "sample", "select", "contamination", "remove", "passages", "packing", "groups", "deduplicate"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_and_empty_tables(spark, name):
    f, docs = calls(spark)[name], awkward(spark)
    rows = f(docs).collect()
    assert f(docs.limit(0)).collect() == []
    if name in ("lm", "sharding", "pii", "remove"):
        assert len(rows) == 10
    if name in ("pii", "select", "remove", "deduplicate"):
        assert set(rows[0].asDict()) == set(docs.columns)
    if name == "pii":
        assert sum(r.text is None for r in rows) == 2 and not any("Tom" in (r.text or "") for r in rows)
    if name == "deduplicate":  # one of the repeated rows goes
        assert len(rows) == 9
    if name == "packing":  # 60,000 tokens in 30 pieces
        assert sum(r.n_tokens for r in rows if r.doc_id == 5) == 60_000


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert (now := docs.count()) <= n
        n = now
    want = {(r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert {(r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()} == want


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Tables beside awkward documents: labels and a benchmark with nulls and repeats, and empty ones."""
    for name, rows in (("odd", True), ("none", False)):
        d = tmp_path_factory.mktemp(name)
        labels(spark, [(1, 1, 0), (1, 0, None), (None, 0, 0), (5, 0, 1), (6, 1, None), (9, None, 0)] * rows).write.parquet(f"{d}/labels.parquet")
        bench = [(1, "one two three four five six seven eight nine"), (1, "one two three four five six seven eight nine"), (None, "word " * 9), (2, None), (3, "")] * rows
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        yield_dirs.append(str(d))
    return yield_dirs


yield_dirs: list[str] = []


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("tables", [0, 1])
def test_pipeline_stages_on_awkward_tables(spark, odd_tables, stage, tables):
    name, f = corpus_pipeline.STAGES[stage]
    rows = [(1, "a b c", "en"), (1, "a b c", "en"), (None, "Mr. Tom Ray", None), (2, None, None), (3, "", "x"), (4, "  \n ", "x"), (6, "é€𝒳 ß", "y"), (7, "...", "y"), (None, None, None)]
    rng = random.Random(41)
    long = " ".join(f"{rng.choice(['Mr. Tom Ray', 'write a@b.org', 'w1', 'w2'])} {rng.randrange(10**6)}" for _ in range(20_000)) + " one two three four five six seven eight nine"
    rows += [(5, long, "x"), (8, long + " .", "x"), (9, "One two, three four five six seven eight nine!", "x")]
    shape = "doc_id long, text string, lang string, source string, n_chars long, _gone long, _nth int, _twice long, part string, shard int, x string, _pass int, cell int, key string, kind string, surrogate string, _bad boolean"
    docs = spark.createDataFrame([(*r, "s", None if r[1] is None else len(r[1]), 1, 2, 3, "p", 4, "x", 5, 6, "k", "kind", "s", True) for r in rows], shape)
    got = f(spark, docs, odd_tables[tables])
    found = got.collect()
    if stage < 4:
        assert got.columns == docs.columns
        assert all(r._nth == 2 and r.shard == 4 and r._bad and (r.n_chars is None if r.text is None else r.n_chars == len(r.text)) for r in found)
    ids = Counter(r.doc_id for r in found)
    if name == "near-duplicates":
        assert ids[1] == 1 and ids[5] == 1 and ids[8] == 0 and ids[None] == 2
    if name == "benchmark decontamination":
        assert ids[9] == tables and sum(ids.values()) == 11 + tables and all(("seven eight" in r.text) == bool(tables) for r in found if r.doc_id == 5)
    if name == "personal data":
        assert sum(ids.values()) == 12 and not any("Tom" in (r.text or "") or "a@b.org" in (r.text or "") for r in found)
    if name == "best-fit packing":
        assert len({r.bin_id for r in found if r.doc_id == 5}) > 9 and ids[2] == ids[3] == ids[4] == 0
    assert f(spark, docs.limit(0), odd_tables[tables]).collect() == []
