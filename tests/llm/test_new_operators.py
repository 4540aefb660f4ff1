"""Line runs, fill-in-middle and ranked search against plain versions, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tripledger.functions.materialize import materialize
from tripledger.llm import fim, lexical, line_runs

SF = "/root/testdata/sf0.001"
CLASHING = ["key", "keys", "part", "batch", "holder", "last", "given", "shard", "bucket", "term", "score", "rank", "form", "output", "n", "df", "items"]
LONG = "this very line of text has more than forty characters"
EDGE = "é" * 40
TEXTS = [
    None, "", "\n", " \t\n\x0b\f\r\n", "one", LONG, LONG.upper() + "\nown", f"  {LONG}\t\r\nother\n{LONG}", f"a\n{LONG}\n\n", LONG, EDGE, EDGE[1:], EDGE + "\n" + EDGE,
    EDGE, EDGE + " ", " " + EDGE, EDGE, "x" * 50_000, "\n".join(f"line {i} of a text with very many different lines in it" for i in range(2_000)),
    "<P> marked", "a <S> b", "c <M>", "<P", "P><", "😀" * 9, "a€😀é" * 500, "ß<", "tie words here", "here tie words", "words words here tie",
] + [f"{LONG}\nunlike {i}" for i in range(4)]


@pytest.fixture(scope="module")
def texts():
    return dict(enumerate(TEXTS))


@pytest.fixture(scope="module")
def odd(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def given_texts(given):
    return {r.doc_id: r.text for r in given.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def twice(odd):
    """Every row twice, and rows without doc_id."""
    return odd.unionByName(odd).unionByName(odd.filter("doc_id < 12").withColumn("doc_id", F.lit(None).cast("long")))


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def plain_lines(rows, least_chars=40, least_docs=5):
    """rows: (doc_id, text); ids of None count as one document before all."""
    low = lambda k: -math.inf if k is None else k
    held = {}
    for k, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(plain_key(line), set()).add(low(k))
    gone = {key: max(ids) for key, ids in held.items() if len(key) >= least_chars and len(ids) >= least_docs}
    out = []
    for k, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if gone.get(plain_key(x), low(k)) == low(k)]
        out.append((k, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def some(rows):
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("which", ["odd", "given", "twice"])
@pytest.mark.parametrize(("batches", "fanout"), [(4, 3), (7, 2), (1, 2)])
def test_lines(request, which, batches, fanout):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = line_runs.deduplicate(docs, batches=batches, fanout=fanout).collect()
    assert some(got) == some(plain_lines(rows))


def test_runs_are_levelled_and_keep_counts(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    seen, holder = Counter(), {}
    for step in range(5):
        pairs = [(100 - 10 * step - d, bytes([k])) for d in range(3) for k in range(step, step + 4 + d)]
        for d, k in pairs:
            seen[k] += 1
            holder[k] = max(holder.get(k, d), d)
        runs.add(spark.createDataFrame(pairs, "doc_id long, key binary"))
        assert {bytes(r.key): (r.n_docs, r.holder) for r in runs.repeated(1).collect()} == {k: (seen[k], holder[k]) for k in seen}
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    names = [n for level in runs.levels for n in level]
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_a_line_in_a_third_of_the_rows_is_joined_apart(spark):
    rows = [(k, f"{LONG}\nrow {k} has a line of its own that is long enough too" if k % 3 == 0 else f"short {k}") for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert some(line_runs.deduplicate(docs).collect()) == some(plain_lines(rows))


def test_lines_of_no_rows(odd):
    assert line_runs.deduplicate(odd.limit(0)).count() == 0


def plain_fim(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", a, b - a, out, text


@pytest.mark.parametrize("which", ["odd", "given", "twice"])
def test_fill_in_middle(request, which):
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = fim.restore(fim.transform(docs)).collect()
    assert some(got) == some([plain_fim(*r) for r in rows])
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    hashes = fim.digest(fim.restore(fim.transform(docs))).collect()
    assert some(hashes) == some([(*x[:5], plain.sha(x[5]), plain.sha(x[6])) for x in (plain_fim(*r) for r in rows)])


def test_fill_in_middle_of_no_rows_and_other_markers(spark, odd):
    assert fim.restore(fim.transform(odd.limit(0))).count() == 0
    marks = ("[pre]", "[suf]", "[mid]")
    rows = fim.restore(fim.transform(odd, seed=7, fim_percent=100, spm_percent=50, markers=marks), marks).collect()
    assert some((r.doc_id, r.restored) for r in rows) == some((k, t or "") for k, t in enumerate(TEXTS))
    assert {r.form for r in rows if r.n} == {"psm", "spm"}
    for wrong in [("", "b", "c"), ("<a>", "<a>", "<b>"), ("<a>", "<<b>", "<c>"), ("[", "[a", "[b")]:
        with pytest.raises(ValueError, match="markers"):
            fim.transform(odd, markers=wrong)


def test_unit_ends_of_random_texts():
    draw = random.Random(5)
    for _ in range(300):
        parts = ["".join(draw.choice("aé€😀\n\x00\x7f") for _ in range(draw.randint(0, 20))) for _ in range(draw.randint(1, 6))]
        raws = [p.encode() for p in parts]
        units = fim.UnitEnds(b"".join(raws))
        ends = np.cumsum([len(r) for r in raws])
        first = units.rank(ends - [len(r) for r in raws])
        assert (units.rank(ends) - first).tolist() == [len(p) for p in parts]
        for i, p in enumerate(parts):
            wanted = np.arange(1, len(p) + 1)
            assert (units.select(first[i] + wanted) - (ends[i] - len(raws[i]))).tolist() == [len(p[:k].encode()) for k in wanted]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(rows, items, top=50):
    docs = [(k, Counter(plain_terms(t))) for k, t in rows]
    n_docs, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for k, t in items:
        asked.setdefault(k, set()).update(plain_terms(t))
    out = []
    for item, terms in asked.items():
        found = []
        for k, c in docs:
            if not c:
                continue
            m = 50 + (50 * c.total() * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, k is None, k or 0, k, score))
        out += [(item, i + 1, x[3], x[4]) for i, x in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return out


ITEMS = [
    (0, "the tie words"), (1, None), (2, ""), (3, "no such termxyz"), (4, LONG), (5, EDGE + " other own"), (6, "line of a text"), (7, "HERE here Here"),
    (7, "tie"), (None, "words unlike"), (8, "P S M marked"),
]


@pytest.mark.parametrize("which", ["odd", "given", "twice"])
@pytest.mark.parametrize(("shard_bytes", "together", "window", "top"), [(1 << 25, 256, 2_048, 50), (3_000, 2, 3, 4)])
def test_search(request, spark, monkeypatch, which, shard_bytes, together, window, top):
    monkeypatch.setattr(lexical, "SHARDS_TOGETHER", 2)
    docs = request.getfixturevalue(which)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = [*ITEMS, *((100 + i, t[:300]) for i, (_, t) in enumerate(rows[:8]) if t)]
    items = spark.createDataFrame(asked, "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHING})
    found = lexical.search(materialize(lexical.index(docs, shard_bytes)), items, top, together, window).collect()
    assert some(found) == some(plain_search(rows, asked, top))


def test_search_of_or_in_nothing(spark, odd):
    none = materialize(lexical.index(odd.limit(0)))
    some_items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(none, some_items).count() == 0
    assert lexical.search(materialize(lexical.index(odd)), some_items.limit(0)).count() == 0
    assert lexical.search(materialize(lexical.index(odd.filter("doc_id in (0, 1, 2)"))), some_items).count() == 0


def shard_lists(texts, words):
    """The lists of words in one shard of texts, and the number of documents."""
    shard = lexical._Shard()
    for k, t in enumerate(texts):
        shard.add(k, t)
    docs, *rows = [r for batch in shard.rows(0) for r in batch.to_pylist()]
    asked = {w.encode(): {"term": w.encode(), "weight": 3 + i, "items": [{"item_id": 0}]} for i, w in enumerate(words)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([r | {"query_block": 0, "wanted": list(asked.values())} for r in rows])
    norm_of = lambda n: 50 + n
    norm = norm_of(np.array(docs["lengths"], np.int64))
    return [lexical._List(r, norm, norm_of) for b in lexical._lists([batch]) for r in b.to_pylist()], norm


def test_blocks_are_rejected_before_they_are_unpacked():
    draw = random.Random(3)
    texts = [" ".join(["rare"] * (50 if k < 60 else k % 997 == 0) + ["often"] * (1 + (k < 2_000) * draw.randint(0, 9)) + ["pad"] * draw.randint(0, 9)) for k in range(9_000)]
    lists, norm = shard_lists(texts, ["often", "rare"])
    docs, scores = lexical.best_of_shard(lists, len(norm), 50, 256)
    want = np.zeros(len(norm), np.int64)
    fresh, _ = shard_lists(texts, ["often", "rare"])
    for x in fresh:
        x.add_range(0, len(norm), want)
    order = np.lexsort((np.arange(len(want)), -want))[:50]
    assert docs.tolist() == order.tolist()
    assert scores.tolist() == want[order].tolist()
    long = max(lists, key=lambda x: len(x.lasts))
    assert len(long._blocks) < len(long.lasts) / 4
    assert all(own.max() <= bound for x in fresh for b, bound in enumerate(x.bounds) for _, own in [x.block(b)])
