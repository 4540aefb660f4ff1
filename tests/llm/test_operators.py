"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import plain
from tripledger.llm import bpe_codec, language, licenses, minhash, packing, pii, quality, simhash, suffix_dedup, token_files

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["kept", "key", "node", "signals", "votes", "pattern", "spans", "start", "bucket", "text_hash", "ids", "island", "n_tokens", "one", "root"]
PASSAGE = "the same passage of more than fifty bytes stands in several documents "
TEXTS = [
    None, "", " \n\t ", "one", "Two words", PASSAGE, PASSAGE + "and goes on", "before " + PASSAGE, "ab" * 4_000, "x" * 30_000,
    " ".join(f"word{i}" for i in range(300)), " ".join(f"word{i}" for i in range(300)), " ".join(f"word{i}" for i in range(10, 300)),
    " ".join(f"w{i % 7}" for i in range(200)), "line one here\nline one here\nother\n", "a@b.c d.e@f.g.h%x@y.z 1.2.3.4.5.6.7.8 256.1.1.1",
    "+1 (017) 555-7713 4111 1111 1111 1111, 4111-1111-1111-1112 😀 a@b.co 😀", "Licensed under the Apache License, Version 2.0.\nbody text",
    "don't WE'LL <|endoftext|> ΑΣ é é 12.5%", "1" * 5_000, "ß" * 60 + "é" * 60, "ß" * 60 + "é" * 59 + "è",
]


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(TEXTS))


@pytest.fixture(scope="module")
def odd(spark, texts):
    rows = [(k, t, None if k % 5 == 0 else "en" if k % 2 else "de", None, None) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def given_texts(given):
    return {r.doc_id: r.text for r in given.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def twice(spark, odd):
    """Every row twice, and rows without doc_id."""
    return odd.unionByName(odd).unionByName(odd.filter("doc_id in (0, 5, 10)").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("which", ["odd", "given"])
def test_near_copies(request, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    want = plain.near_components(texts)
    rows = minhash.near_copies(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {k: (len(plain.shingle_set(t)), want[k], want[k] == k) for k, t in texts.items()}


def test_near_copies_of_repeated_rows(twice, none, texts):
    rows = minhash.near_copies(twice).collect()
    want = plain.near_components(texts)
    assert len(rows) == 2 * len(texts) + 3
    assert all(r.component_id == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash.near_copies(none).count() == 0


def test_a_group_of_chained_copies_costs_links_in_proportion(spark):
    base = [f"t{i}" for i in range(200)]
    rows = [(k, " ".join([*base[k:], *(f"n{k}_{i}" for i in range(k))])) for k in range(0, 120, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain.near_components(dict(rows))
    assert {r.doc_id: r.component_id for r in minhash.near_copies(docs).collect()} == want


@pytest.mark.parametrize("block", [4, 2_048])
def test_cells_of_a_bucket_link_what_is_apart(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    words = [f"t{i}" for i in range(120)]
    texts = {k: " ".join([*words[: 120 - k], *(f"n{k}_{i}" for i in range(k))]) for k in range(0, 36, 2)}
    signed = {r.doc_id: r for r in minhash.signatures(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    rows = [(b, k, k // 4, signed[k].n_shingles, signed[k].sketch, signed[k].bands) for k in texts for b in signed[k].bands]
    members = spark.createDataFrame(rows, "bucket long, node long, root long, n_shingles long, sketch array<long>, bands array<long>")
    got = minhash.links_apart(members, spark.createDataFrame(list(texts.items()), "node long, text string"), 75).collect()

    def joined(pairs):
        top = {k // 4: k // 4 for k in texts}
        for _ in top:
            for a, b in pairs:
                top[a // 4] = top[b // 4] = min(top[a // 4], top[b // 4])
        return top

    sets = {k: plain.shingle_set(t) for k, t in texts.items()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = [(a, b) for a in texts for b in texts if a < b and near(a, b)]
    assert got and all(near(r.a, r.b) and r.a // 4 != r.b // 4 for r in got)
    assert joined([(r.a, r.b) for r in got]) == joined(want)


def test_sketches_estimate_high_similarities(spark):
    one = np.arange(1, 1_001, dtype=np.uint64)
    for share in (0.75, 0.9, 0.98):
        n = int(1_000 * 2 * share / (1 + share))
        other = np.r_[one[:n], np.arange(5_000, 6_000 - n, dtype=np.uint64)]
        a, b = (minhash.odd_sketch(minhash.samples(minhash._mix(x))).view(np.int64).tolist() for x in (one, other))
        got = spark.createDataFrame([(a, b)], "a array<long>, b array<long>").select(minhash.sketch_similarity("a", "b")).first()[0]
        assert abs(got - share) < 0.12


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (102, 101)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("which", ["odd", "given"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    ids = sorted(texts)
    prints = {k: simhash.fingerprint(texts[k] or "") for k in ids}
    rows = {r.doc_id: r for r in simhash.search(docs).collect()}
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, after = texts[a] or "", texts[b] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = rows[a]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(text), plain.sha(new), f"{prints[a]:016x}")
        assert r.edited_fingerprint == f"{simhash.fingerprint(new):016x}"
        assert r.near_next == 1 - (prints[a] ^ prints[b]).bit_count() / 64
        assert r.n_near == (sum((prints[a] ^ x).bit_count() <= 3 for x in prints.values()) if a % 20 == 0 else None)


def test_simhash_of_repeated_rows_and_none(twice, none):
    assert simhash.search(twice).count() == twice.count()
    assert simhash.search(none).count() == 0


def test_block_tables_find_the_whole_radius(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    near = [centre]
    for n in (1, 2, 3, 3, 3, 4, 5):
        x = centre
        for bit in rng.choice(64, n, replace=False).tolist():
            x ^= 1 << bit
        near.append(x)
    prints = spark.createDataFrame([(simhash._signed(x & ((1 << 64) - 1)),) for x in near], "fingerprint long")
    got = simhash.neighbours(prints, prints.limit(1)).first()
    assert got.n_near == sum((x ^ near[0]).bit_count() <= 3 for x in near)


def test_pairs_within_nine_bits_are_returned(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(x) for x in base] + [int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in range(1, 13)]
    prints = spark.createDataFrame([(simhash._signed(x),) for x in near + near[:5]], "fingerprint long").repartition(3)
    asked = near[:30:3]
    queries = spark.createDataFrame([(simhash._signed(x),) for x in asked], "fingerprint long")
    for radius in (3, 9, 11):
        got = [tuple(r) for r in simhash.pairs(prints, queries, radius).collect()]
        want = [(simhash._signed(q), simhash._signed(x), (q ^ x).bit_count(), 2 if x in near[:5] else 1) for q in asked for x in set(near) if (q ^ x).bit_count() <= radius]
        assert sorted(got) == sorted(want)


def test_counts_equal_the_pairs(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, n, replace=False)) for b in base for n in range(0, 13)]
    prints = spark.createDataFrame([(simhash._signed(x),) for x in near + near[:5]], "fingerprint long").repartition(3)
    queries = prints.filter("fingerprint % 3 = 0").distinct()
    met = simhash.pairs(prints, queries).groupBy("fingerprint").agg(F.sum(F.when(F.col("distance") <= 3, F.col("n")).otherwise(0)), F.sum("n"), F.min("found"))
    assert sorted(map(tuple, simhash.found(prints, queries).collect())) == sorted(map(tuple, met.collect()))


def test_planted_near_copies_share_a_class(spark):
    words = [f"word{i}" for i in range(200)]
    texts = {20: " ".join(words), 21: " ".join([*words[:100], "other", *words[101:]]), 22: " ".join(f"else{i}" for i in range(200)), 23: " ".join(words), 40: " ".join([*words, "end"])}
    rows = {r.doc_id: r for r in simhash.search(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    assert (rows[20].n_found, rows[40].n_found, rows[21].n_found) == (4, 4, None)
    assert rows[20]["class"] == rows[40]["class"]
    assert rows[20]["class"] in {rows[k].fingerprint for k in (20, 21, 23, 40)}


def test_fingerprint_against_plain_votes(given_texts):
    import xxhash

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % (1 << 64)
        return x ^ (x >> 27)

    for text in [*TEXTS, *list(given_texts.values())[:40]]:
        words = [xxhash.xxh3_64_intdigest(w) for w in ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()).split()]
        terms = words + [mix((a * 3 + mix(b)) % (1 << 64)) for a, b in zip(words, words[1:], strict=False)]
        counts = {t: terms.count(t) for t in set(terms)} if len(terms) < 3_000 else {t: n for t, n in zip(*np.unique(np.array(terms, np.uint64), return_counts=True), strict=True)}
        votes = [sum((1 if int(t) >> bit & 1 else -1) * n**0.5 for t, n in counts.items()) for bit in range(64)]
        got = simhash.fingerprint(text or "")
        assert all(abs(v) < 1e-2 * len(terms) or (v > 0) == bool(got >> bit & 1) for bit, v in enumerate(votes))


def test_licenses(spark, odd, none, twice):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/LICENSE", notice), (2, "a/b/one.txt", "plain words here"), (3, "a/b/c/two.txt", notice.replace("Apache", "apache") + "\n" + "long words of other things " * 9),
        (4, "a/b/LICENSE", "Released under the MIT License."), (5, "a/b/c/d/three.txt", None), (6, "z/four.txt", ""), (7, None, "nothing"), (8, "a/five.txt", "nothing"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.origin, r.licensed_by) for r in licenses.scan(files).collect()}
    assert got == {
        1: ("Apache-2.0", "file", None), 2: ("MIT", "inherited", "a/b"), 3: ("Apache-2.0", "header", None), 4: ("MIT", "file", None),
        5: ("MIT", "inherited", "a/b"), 6: (None, None, None), 7: (None, None, None), 8: ("Apache-2.0", "inherited", "a"),
    }
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string"))
    assert licenses.scan(none.withColumn("path", path)).count() == 0
    assert licenses.scan(twice.withColumn("path", path)).count() == twice.count()


def test_licenses_equal_an_unpruned_cosine(given, given_texts):
    rows = licenses.scan(given.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))).collect()
    vocabulary = sorted({t for texts in licenses.TEMPLATES.values() for x in texts for t in licenses.terms(x)})
    found = {t: sum(t in licenses.terms(x or "") for x in given_texts.values()) for t in vocabulary} | {"": len(given_texts)}
    matcher = licenses.Matcher(licenses.TEMPLATES, found)
    for r in rows:
        text = (given_texts[r.doc_id] or "").lower()
        whole = matcher.best(licenses.terms(text))
        lines = max((matcher.best(licenses.terms(line)) for line in text.split("\n")), key=lambda x: x[0])
        want = (whole[1], "file") if whole[0] >= licenses.FILE_LEAST else (lines[1], "header") if lines[0] >= licenses.LINE_LEAST else None
        assert (want is None and r.origin in (None, "inherited")) or (r.license, r.origin) == want


def test_full_licence_texts_wrapped_headers_and_siblings(spark):
    full = {name: texts[0] for name, texts in licenses.full_texts().items() if texts[0] not in licenses.HEADERS.get(name, [])}
    assert {"Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(full)
    prose = "plain words of a file\n" * 3 + " ".join(f"word{i}" for i in range(300))
    header = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
"""
    grant = """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {}General Public License
 * as published by the Free Software Foundation; either version {}
 * of the License, or (at your option) any later version.
"""
    lines = {
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.", "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.", "CC-BY-4.0": "Licensed under CC BY 4.0.",
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.", None: "Licensed under the Apache License, Version 1.1.",
    }
    heads = {"Apache-2.0": header, "GPL-2.0": grant.format("", "2"), "GPL-3.0": grant.format("", "3"), "LGPL-2.1": grant.format("Lesser ", "2.1"), "AGPL-3.0": grant.format("Affero ", "3")}
    files, want = [], {}
    for name, text in full.items():
        wrapped = " ".join(text.split())
        files += [(f"{name}/LICENSE", "Copyright (c) 2020 Some One\n\n" + text), (f"{name}/src/a.txt", prose), (f"wrapped {name}/LICENSE", wrapped)]
        want |= {f"{name}/LICENSE": (name, "file"), f"{name}/src/a.txt": (name, "inherited"), f"wrapped {name}/LICENSE": (name, "file")}
    for name, line in lines.items():
        files += [(f"line {name}/a.txt", line + "\n" + prose), (f"line {name}/b.txt", prose), (f"named {name}/COPYING.md", line + "\n" + prose), (f"named {name}/b.txt", prose)]
        found = (name, name and "header")
        want |= {f"line {name}/a.txt": found, f"line {name}/b.txt": (None, None), f"named {name}/COPYING.md": found, f"named {name}/b.txt": (name, name and "inherited")}
    for name, head in heads.items():
        files.append((f"head {name}/a.c", head + prose))
        want[f"head {name}/a.c"] = (name, "header")
    frame = spark.createDataFrame([(i, path, text) for i, (path, text) in enumerate(files)], "doc_id long, path string, text string")
    assert {r.path: (r.license, r.origin) for r in licenses.scan(frame).collect()} == want


@pytest.mark.parametrize("which", ["odd", "given"])
def test_quality_counts(request, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    rows = quality.verdicts(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_quality_posteriors_equal_plain_expectation_maximisation(spark):
    rng = np.random.default_rng(5)
    good = rng.random(4_000) < 0.8
    n = len(quality.rules())
    bad = np.where(good[:, None], rng.random((4_000, n)) < 0.02, rng.random((4_000, n)) < 0.5)
    votes = np.where(rng.random((4_000, n)) < 0.1, quality.ABSTAIN, np.where(bad, quality.BAD, quality.GOOD))
    frame = spark.createDataFrame([(v.tolist(),) for v in votes], "votes array<int>")
    got = {tuple(r.votes): r.p_good for r in quality.fit(frame).collect()}
    prior, g, b = 0.8, np.full(n, 0.02), np.full(n, 0.4)

    def posterior(v):
        w = np.where(v == quality.BAD, np.log(g / b), np.where(v == quality.GOOD, np.log((1 - g) / (1 - b)), 0.0))
        return 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + w.sum(axis=-1))))

    for _ in range(30):
        q = posterior(votes)
        said = votes != quality.ABSTAIN
        rate = lambda mass: ((mass[:, None] * (votes == quality.BAD)).sum(0) + 0.01) / ((mass[:, None] * said).sum(0) + 1.0)
        prior, g, b = np.clip(q.mean(), 0.3, 0.98), np.clip(rate(q), 0.001, 0.05), np.clip(rate(1 - q), 0.2, 0.95)
    for v, p in got.items():
        assert abs(p - posterior(np.array(v))) < 1e-6
    assert np.mean([(got[tuple(v)] > 0.5) == y for v, y in zip(votes.tolist(), good, strict=True)]) > 0.97


def test_quality_keeps_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.verdicts(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.doc_id in labels and not r.base_failed]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1)
    assert sum(r.kept for r in rows if labels[r.doc_id] == 0) <= 0.1 * sum(labels[r.doc_id] == 0 for r in rows)


def test_quality_of_repeated_rows_and_none(twice, none):
    assert quality.verdicts(twice).count() == twice.count()
    assert quality.verdicts(none).count() == 0
    kept = quality.keep_good(twice)
    assert kept.columns == twice.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(2 * [r.doc_id for r in quality.verdicts(twice.filter("doc_id is not null").distinct()).filter("kept").collect()])


def check_packing(rows, ids, capacity=2_048):
    places = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + capacity]
        assert (r.length, r.ids_crc32, r.start) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()), capacity * r.piece)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("which", ["odd", "given"])
def test_packing(request, library, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in texts.items()}
    rows = packing.pack(packing.pieces(docs, VOCABULARY, 0, 2_048), 2_048).collect()
    assert len(rows) == sum(-(-len(x) // 2_048) for x in ids.values())
    least = -(-sum(map(len, ids.values())) // 2_048)
    assert check_packing(rows, ids) <= least * 1.02 + 1


def test_packing_of_repeated_rows_and_none(twice, none):
    pieces = packing.pieces(twice, VOCABULARY, 0, 64)
    assert packing.pack(pieces, 64, island_size=50).count() == pieces.count()
    assert packing.pack(packing.pieces(none, VOCABULARY, 0, 64), 64).count() == 0


def test_crossover_keeps_every_piece_once():
    lengths = [7, 5, 5, 4, 3, 3, 2, 2, 1, 9, 8, 1]
    island = packing.Island(lengths, 10, 1)
    a, b = island.best_fit([], island.by_size(list(range(12)))), island.best_fit([], list(range(12)))
    for _ in range(20):
        child = island.cross(a, b)
        assert sorted(i for bin_ in child for i in bin_) == list(range(12)) and all(island.fill(x) <= 10 for x in child)
        a, b = child, a
    assert len(island.evolve([[9, 1], [8, 2]], 4, 24)) == 5


@pytest.mark.parametrize("which", ["odd", "given"])
def test_pii_base(request, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    rows = pii.digest(pii.find(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain.base_spans(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == plain.sha(line)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_pii_selects_what_looks_like_the_confirmed(spark):
    card = lambda i: next(x for x in range(4_000_000_000_000_000 + 13 * i, 9_999_999_999_999_999) if plain.luhn(str(x)))
    rows = [(i, f"some words then {card(i)} and more") for i in range(60)] + [(100 + i, f"order {card(i) + 1} came") for i in range(60)]
    rows += [(500, f"two side by side {card(7)} {card(9)} here")]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[500] == "card:17:33,card:34:50"
    assert all(got[i] == "card:16:32" for i in range(60)) and not any(got[100 + i] for i in range(60))


def test_loose_forms_are_found_and_numbers_left_alone(spark):
    card = lambda i: next(x for x in range(4_000_000_000_000_000 + 13 * i, 9_999_999_999_999_999) if plain.luhn(str(x)))
    rows = [(i, f"write to user{i}@host{i}.org or call +1 (017) 555-{7000 + i} from 10.0.0.{i}, card {card(i)}") for i in range(60)]
    loose = {}
    for i in range(30):
        c = str(card(1_000 + i))
        loose[1_000 + i] = ("email", f"user{i} (at) host{i} (dot) org")
        loose[2_000 + i] = ("ip", ":".join(f"{(i * 7 + j * 4099) % 65536:x}" for j in range(8)))
        loose[3_000 + i] = ("phone", f"(415) 555-{3000 + i}" if i % 2 else f"415-555-{3000 + i}")
        loose[4_000 + i] = ("card", ".".join((c[:4], c[4:8], c[8:12], c[12:])))
    rows += [(k, f"please note {found} as given") for k, (_, found) in loose.items()]
    plain_numbers = [f"order {123456 + 977 * i} of lot {i}" for i in range(40)] + [f"in 2019-03-{10 + i % 20} at 12:{10 + i}:33 we had 3.{i} and {i * 1371}" for i in range(40)]
    plain_numbers += [f"article 9780{i:02d}4561230{i % 10} is out" for i in range(40)] + [f"version 1.2.3 build {20_000_000 + i * 13}" for i in range(40)]
    rows += [(9_000 + i, t) for i, t in enumerate(plain_numbers)]
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    want = {k: f"{kind}:12:{12 + len(found)}" for k, (kind, found) in loose.items()}
    hits = {kind: sum(got[k] == w for k, w in want.items() if w.startswith(kind)) for kind in pii.KINDS}
    assert min(hits.values()) >= 28, (hits, [got[k] for k in want if got[k] != want[k]][:5])
    assert not any(got[9_000 + i] for i in range(len(plain_numbers)))


def test_redaction(spark, none, twice):
    docs = spark.createDataFrame([(1, "mail a@b.co, 8.8.8.8 and +1 (017) 555-7713!", "x"), (2, None, "y"), (3, "😀 a@b.co", "z")], "doc_id long, text string, key string")
    got = {r.doc_id: (r.text, r.key) for r in pii.redact(docs).collect()}
    assert got == {1: ("mail <email>, <ip> and <phone>!", "x"), 2: (None, "y"), 3: ("😀 <email>", "z")}
    assert pii.redact(none).count() == 0 and pii.redact(twice).columns == twice.columns
    assert pii.find(none).count() == 0 and pii.find(twice).count() == twice.count()


def test_ranges_of_a_doc_id_that_holds_most_rows(spark):
    rows = [(7, f"text {i}") for i in range(300)] + [(None, f"none {i}") for i in range(100)] + [(k, f"own {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    tie = F.xxhash64("text")
    dealt = token_files.in_ranges(docs, tie).select("doc_id", tie.alias("tie"), F.spark_partition_id().alias("part")).collect()
    assert len(dealt) == len(rows)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie)
    ends = {}
    for r in dealt:
        low, high = ends.get(r.part, (key(r), key(r)))
        ends[r.part] = min(low, key(r)), max(high, key(r))
    spans = [ends[p] for p in sorted(ends)]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len({r.part for r in dealt if r.doc_id == 7}) > 1


def test_files_have_pages_and_give_selected_rows(spark, given, tmp_path):
    import pyarrow.parquet as pq

    folder = str(tmp_path / "ids")
    given = given.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).select((F.col("doc_id") + 1_000 * F.col("i")).alias("doc_id"), "text")
    token_files.write(given, VOCABULARY, end_id=1, folder=folder, row_group_bytes=200_000, rows_per_page=20)
    metas = [pq.ParquetFile(f) for f in sorted(tmp_path.glob("ids/part-*.parquet"))]
    assert sum(m.metadata.num_rows for m in metas) == given.count()
    assert max(m.metadata.num_row_groups for m in metas) > 1
    for m in metas:
        group = m.metadata.row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert all(c.has_column_index and c.has_offset_index for name, c in columns.items() if "." not in name)
        assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & {e for c in columns.values() for e in c.encodings}
        assert all(c.compression == "ZSTD" for c in columns.values())
    rows = token_files.read(spark, folder)
    plan = rows.filter("doc_id = 17").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan and "EqualTo(doc_id,17)" in plan and "ids" not in plan.split("ReadSchema")[1].split("\n")[0]
    whole = {r.doc_id: r for r in rows.collect()}
    one = rows.filter("doc_id = 17").first()
    assert (one.ids, one.n_tokens) == (whole[17].ids, len(whole[17].ids))
    assert rows.agg(F.sum("n_tokens")).first()[0] == sum(len(r.ids) for r in whole.values())


@pytest.mark.parametrize("which", ["odd", "given"])
def test_repeated_passages(request, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    rows = suffix_dedup.digest(suffix_dedup.remove(docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain.removed_repeats(texts)


def test_a_passage_in_a_third_of_the_rows_is_dealt_by_string(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 8)
    texts = {k: f"own start {k * 7919} of the row then {PASSAGE * 2}and an end of its own {k * 104729} goes on" if k % 3 == 0 else f"row {k} " + "unlike others " * (k % 5) for k in range(240)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    comparable = suffix_dedup._hashed(docs)
    found = suffix_dedup._look_up(comparable, suffix_dedup._answers(suffix_dedup._met(comparable.select("doc_id", "text", "text_hash")))).cache()
    most = lambda df: df.filter("anchor is not null").groupBy("anchor").count().agg(F.max("count")).first()[0]
    assert most(found) >= 40
    assert most(suffix_dedup._cool(found)) <= 20
    rows = suffix_dedup.digest(suffix_dedup.remove(docs)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == plain.removed_repeats(texts)


def test_bytes_around_a_cut_form_no_letter(spark):
    passage = "a passage in plain letters that is longer than fifty bytes"
    docs = spark.createDataFrame([(1, f"Ĩ{passage}Ī"), (2, f"one è{passage}ĩ two")], "doc_id long, text string")
    got = {r.key.doc_id: (bytes(r.kept), r.kept_text) for r in suffix_dedup.remove(docs, with_columns=True).collect()}
    assert got[2] == ("one é two".encode(), "one  two")


def test_repeats_of_repeated_rows_and_none(twice, none, texts):
    want = plain.removed_repeats(texts)
    rows = suffix_dedup.digest(suffix_dedup.remove(twice)).collect()
    assert len(rows) == twice.count()
    for r in rows:
        assert r.n_removed == (0 if r.doc_id is None else want[r.doc_id][1])
    assert suffix_dedup.remove(none).count() == 0


def test_suffix_classes_are_those_of_equal_strings():
    rng = np.random.default_rng(1)
    pool = rng.integers(97, 99, (40, 50), dtype=np.uint8)
    pool[20:, :48] = pool[0, :48]
    strings = pool[rng.integers(0, 40, 500)]
    classes = suffix_dedup.suffix_classes(strings)
    names = {}
    for c, s in zip(classes.tolist(), map(bytes, strings), strict=True):
        assert names.setdefault(s, c) == c
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_suffix_classes_without_ties(n):
    strings = np.frombuffer(b"".join(bytes([97 + i]) * 50 for i in range(n)), np.uint8).reshape(n, 50)
    assert suffix_dedup.suffix_classes(strings).tolist() == (list(range(n)) if n else [])


@pytest.mark.parametrize("which", ["odd", "given"])
def test_bpe_equals_the_library(request, library, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    rows = bpe_codec.decode(bpe_codec.encode(docs, VOCABULARY), VOCABULARY).collect()
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.ids, r.text) == (ids, library.decode(ids, skip_special_tokens=False))


def test_bpe_of_repeated_rows_and_none(twice, none):
    assert bpe_codec.encode(twice, VOCABULARY).count() == twice.count()
    assert bpe_codec.digest(bpe_codec.decode(bpe_codec.encode(none, VOCABULARY), VOCABULARY)).count() == 0


def test_bpe_words_that_fail_the_check_are_merged_exactly(library):
    rng = np.random.default_rng(2)
    tokens = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii()]
    words = ["".join(rng.choice(tokens, rng.integers(1, 4))) for _ in range(2_000)]
    codec = bpe_codec.codec(VOCABULARY)
    got = codec.encode_batch(words)
    assert codec.remerged > 0
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["odd", "given"])
def test_token_files(request, spark, library, tmp_path, which):
    docs = request.getfixturevalue(which)
    texts = request.getfixturevalue("texts" if which == "odd" else "given_texts")
    token_files.write(docs, VOCABULARY, 1, f"{tmp_path}/tokens")
    rows = {r.doc_id: r for r in token_files.digest(token_files.read(spark, f"{tmp_path}/tokens")).collect()}
    at = 0
    for k in sorted(texts):
        ids = [*library.encode(texts[k] or "", add_special_tokens=False).ids, 1]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_of_repeated_rows_and_none(spark, twice, none, tmp_path):
    token_files.write(twice, VOCABULARY, 1, f"{tmp_path}/a")
    rows = token_files.digest(token_files.read(spark, f"{tmp_path}/a")).orderBy("start").collect()
    assert len(rows) == twice.count() and [r.doc_id for r in rows][:3] == [None] * 3
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    token_files.write(none, VOCABULARY, 1, f"{tmp_path}/b")
    assert token_files.digest(token_files.read(spark, f"{tmp_path}/b")).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(language.learning_rows(docs))
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) > 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_without_letters_or_lessons(odd, none, twice, texts):
    model = language.fit(language.learning_rows(odd))
    rows = {r.doc_id: r for r in language.predict(odd, model).collect()}
    for k, t in texts.items():
        assert (rows[k].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    assert {r.lang_pred for r in language.predict(odd, language.fit(none)).collect()} == {"und"}
    assert language.predict(none, model).count() == 0 and language.predict(twice, model).count() == twice.count()


@pytest.mark.parametrize("n", [1, 2, 4, 9])
def test_codewords_differ(n):
    code = language.codewords(n)
    assert code.shape[0] == n and len({tuple(x) for x in code.tolist()}) == n
