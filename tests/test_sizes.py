"""Joins and tables whose size in memory is not that of their files."""

from __future__ import annotations

from decimal import Decimal as D

from pyspark.sql import functions as F

from tripledger.functions.materialize import materialize
from tripledger.functions import ranking
from tripledger.operators import alcohol, matching, review
from tripledger.plans.registry import FILE_GROWTH, sized_by_rows
from tripledger.sources import tables as source


def _sides(spark):
    receipts = spark.createDataFrame(
        [("T1", f"r{i}.pdf", f"2026-01-{1 + i:02d}", "cafe blue", D("10.00") + i, "USD", 1) for i in range(20)],
        "trip_id string, source_file string, receipt_date string, vendor string, amount decimal(18,2), currency string, number_of_people int",
    ).selectExpr("* except (receipt_date)", "cast(receipt_date as date) receipt_date")
    groups = spark.createDataFrame(
        [("T1", f"g{i}", f"2026-01-{1 + i:02d}", "cafe blue", D("10.00") + i, "USD", D("14.00") + i, True, True) for i in range(20)],
        "trip_id string, group_id string, transaction_date string, description string, purchase_amount decimal(18,2), purchase_currency string, "
        "cad_amount decimal(18,2), match_eligible boolean, clean_legs boolean",
    ).selectExpr("* except (transaction_date)", "cast(transaction_date as date) transaction_date")
    return materialize(matching.receipt_side(receipts)), materialize(groups)


def test_exploded_features_never_pass_through_the_driver(spark):
    side, groups = _sides(spark)
    plan = matching.evidence_pairs(side, matching.card_rows(groups))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "BroadcastExchange" not in plan
    best = {r.group_id: r.source_file for r in matching.best_match(side, groups).collect()}
    assert best == {f"g{i}": f"r{i}.pdf" for i in range(20)}


def test_queries_take_tables_by_their_rows(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    size = lambda _, d: int(str(spark.read.parquet(f"{d}/t")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    key = "spark.sql.sources.fileCompressionFactor"
    before = spark.conf.get(key)
    spark.conf.set(key, "1.0")
    try:
        assert sized_by_rows(size)(spark, str(tmp_path)) == FILE_GROWTH * _plain(spark, size, key, str(tmp_path))
    finally:
        spark.conf.set(key, before)


def _plain(spark, size, key: str, d: str) -> int:
    spark.conf.set(key, "1.0")
    return size(spark, d)


def test_line_audit_reads_its_rows_from_one_table(spark):
    from tripledger.operators import reports

    expenses = spark.createDataFrame(
        [("T1", "a.pdf", "v", "CAD", 1, D("10.00"), D("3.00"), True, True, None), ("T1", "b.pdf", "v", "CAD", 2, D("8.00"), D("4.00"), True, False, "other")],
        "trip_id string, source_file string, vendor string, currency string, number_of_people int, amount decimal(18,2), sponsor_excluded_cad decimal(18,2), "
        "in_company boolean, in_sponsor boolean, exclusion_reason string",
    )
    lines = spark.createDataFrame(
        [("T1", "a.pdf", i, "wine", D("1.00"), True, True, False, "alcohol") for i in (1, 2, 3)],
        "trip_id string, source_file string, pos long, description string, amount decimal(18,2), is_alcohol boolean, in_company boolean, in_sponsor boolean, exclusion_reason string",
    )
    out = reports.line_audit(expenses, lines)
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.source_file, r.pos, r.removed_cad) for r in out.collect()) == [
        ("a.pdf", 1, D("1.00")), ("a.pdf", 2, D("1.00")), ("a.pdf", 3, D("1.00")), ("b.pdf", 0, D("4.00")),
    ]


def test_header_search_reads_only_files_without_a_signature(spark, monkeypatch):
    from tripledger.operators import layout

    rows = spark.createDataFrame(
        [
            ("T1", "amex.csv", 1, ["Date", "Date Processed", "Description", "Card Member", "Account", "Amount"]),
            ("T1", "amex.csv", 2, ["2026-01-02", "2026-01-02", "cafe", "Jo", "x1", "5.00"]),
            ("T1", "own.csv", 1, ["Export", None, ""]), ("T1", "own.csv", 2, ["When bought", "Shop details", "Price"]), ("T1", "own.csv", 3, ["2026-01-02", "cafe", "5.00"]),
        ],
        "trip_id string, source_file string, row_no long, cells array<string>",
    )
    search, asked = layout.header_candidates, []
    monkeypatch.setattr(layout, "header_candidates", lambda r: asked.append(r) or search(r))
    found = {r.source_file: (r.provider, r.header_row) for r in layout.detect_provider(rows).collect()}
    assert found == {"amex.csv": ("amex", 1), "own.csv": ("generic", 2)}
    assert {r.source_file for r in asked[0].collect()} == {"own.csv"}


def test_notices_of_many_files_are_few_batches(spark, tmp_path):
    from tripledger.streaming.streams import StatementIngest

    for i in range(120):
        (tmp_path / "in" / f"T{i}").mkdir(parents=True)
        (tmp_path / "in" / f"T{i}" / "a.csv").write_text("Date,Description,Amount,Currency\n13/07/2026,Shop,-10.00,EUR\n")
    ingest = StatementIngest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    ingest.scan()
    assert spark.read.parquet(ingest.notices).count() == 120
    assert len(list((tmp_path / "out" / "notices").glob("*.parquet"))) == 1


def test_keys_of_few_rows_are_numbered_by_one_shuffle(spark, monkeypatch):
    from tripledger.functions import ranking

    df = spark.createDataFrame([("a", i) for i in range(400)] + [("b", i) for i in range(5)] + [(None, i) for i in range(300)], "k string, o int").repartition(7)
    out = ranking.positions_within(df, ["k"], ["o"])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = sorted((str(r.k), r.o, r.o + 1) for r in df.collect())
    assert sorted((str(r.k), r.o, r.position) for r in out.collect()) == want
    monkeypatch.setattr(ranking, "MANY", 100)
    assert sorted((str(r.k), r.o, r.position) for r in ranking.positions_within(df, ["k"], ["o"]).collect()) == want


def test_a_rescan_numbers_its_lines_once(spark, tmp_path, monkeypatch):
    from tripledger.operators import lines
    from tripledger.plans import load_all
    from tripledger.plans.registry import QUERIES

    load_all()
    when = "timestamp '1996-01-02 00:00:00'"
    spark.sql(f"select 7L o_orderkey, 3L o_custkey, 'O' o_orderstatus, 900.5D o_totalprice, {when} o_orderdate, '2-HIGH' o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("select 5L p_partkey, 'blue cup' p_name").write.parquet(str(tmp_path / "part.parquet"))
    spark.sql("select 7L l_orderkey, 5L l_partkey, 2L l_suppkey, cast(id as int) l_linenumber, 10.0D l_extendedprice from range(1, 5)").write.parquet(str(tmp_path / "lineitem.parquet"))
    number, asked = lines.line_ids, []
    monkeypatch.setattr(lines, "line_ids", lambda rows: asked.append(rows) or number(rows))
    for name, rows in (("rev1_merge_rescan", 4), ("rev3_preserve_decisions", 5)):
        asked.clear()
        assert QUERIES[name](spark, str(tmp_path)).count() == rows and len(asked) == 1


def test_amounts_are_marked_once_and_only_beside_digits(spark):
    from tripledger.operators import receipt_text

    df = spark.createDataFrame([(1, "no amount here\nTotal USD 1,234.50\n$45.00\n7,25 x")], "id int, raw_text string")
    plan = receipt_text.with_lines(df)._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") <= 5
    (row,) = receipt_text.with_lines(df).selectExpr("transform(info, x -> size(x.money)) n", "transform(flatten(info.money), m -> m.amount) a").collect()
    assert row.n == [0, 1, 1, 1] and row.a == [D("1234.50"), D("45.00"), D("7.25")]


def test_documents_are_dealt_before_their_amounts_are_read(spark, tmp_path):
    from tripledger.plans import load_all
    from tripledger.plans.registry import QUERIES

    load_all()
    spark.createDataFrame([(1, "a 5.00"), (2, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["txt2_money_tokens_documents"](spark, str(tmp_path))
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.token_count for r in out.collect()} == {1: 1, 2: 0}


def test_line_match_leaves_only_its_result(spark):
    from pathlib import Path

    from tripledger.operators import review

    rows = spark.createDataFrame(
        [("T1", "a.pdf", i, d, D(a), False) for i, (d, a) in enumerate([("red wine", "5.00"), ("red wine", "5.00"), ("bread", "2.00"), ("breads", "2.00")], 1)],
        "trip_id string, source_file string, pos long, description string, amount decimal(18,2), is_alcohol boolean",
    )
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    before = set(shared.iterdir())
    out = review.fuzzy_line_match(rows, rows.withColumn("description", F.regexp_replace("description", "^bread$", "bred")))
    assert sorted((r.new_pos, r.stored_pos) for r in out.collect()) == [(1, 1), (2, 2), (3, 4), (4, 3)]
    assert len(set(shared.iterdir()) - before) <= 4


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_that_grow_never_pass_through_the_driver(spark):
    side, groups = _sides(spark)
    matched = materialize(matching.match_groups(side, groups))
    best, suggested = matching.best_match(side, groups), matching.suggestions(side, matched)
    assert "BroadcastExchange" not in _plan(best) + _plan(suggested) + _plan(matching.auto_assign(best, side))
    assert {(r.source_file, r.group_id) for r in suggested.filter("rank = 1").collect()} == {(f"r{i}.pdf", f"g{i}") for i in range(20)}


def test_written_rows_are_numbered_without_another_copy(spark, monkeypatch):
    df = materialize(spark.createDataFrame([(i % 7, i) for i in range(300)] + [(None, i) for i in range(150)], "k int, o int"))
    paths = []
    monkeypatch.setattr(ranking, "materialize", lambda x: paths.append(x.columns) or materialize(x))
    want = sorted((str(k), o, p) for k in [*range(7), None] for p, o in enumerate([o for o in range(300 if k is not None else 150) if k in (o % 7, None)], 1))
    for many in (100_000, 100, 43):
        monkeypatch.setattr(ranking, "MANY", many)
        paths.clear()
        got = ranking.positions_within(df, ["k"], ["o"], written=True)
        assert sorted((str(r.k), r.o, r.position) for r in got.collect()) == want
        assert paths[0] == ["_group"] and (many < 100_000 or len(paths) == 1)


def test_only_evidence_that_may_be_an_exception_meets_its_receipt(spark):
    receipts = spark.createDataFrame(
        [("T1", f"r{i}.pdf", "shop" if i else None, 0.9 if i < 3 else 0.5, i == 4, "company") for i in range(5)],
        "trip_id string, source_file string, vendor string, confidence double, reviewed boolean, claim_program string",
    )
    lines = spark.createDataFrame(
        [], "trip_id string, source_file string, line_id string, line_type string, description string, amount decimal(18,2), "
        "confidence double, alcohol_confidence decimal(3,2), manual boolean, line_reviewed boolean",
    )
    totals = spark.createDataFrame([], "trip_id string, source_file string, difference decimal(18,2), blocking boolean")
    out = review.receipt_exceptions(receipts, review.field_evidence(receipts), lines, totals)
    assert sorted((r.source_file, r.category) for r in out.collect()) == [("r0.pdf", "missing_field"), ("r3.pdf", "low_confidence_field")]
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Join", 2)[1]
    assert "0.72" in below


def test_manifest_lines_are_made_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(source, "materialize", lambda df: made.append(df.columns) or materialize(df))
    receipts = spark.createDataFrame([("T2", "b", "receipt"), ("T1", "a", "receipt")], "trip_id string, id string, kind string")
    reports = spark.createDataFrame([("T1", "trip_report"), ("T2", "trip_report")], "trip_id string, kind string")
    source.write_manifest(receipts, reports, str(tmp_path / "m"))
    assert made == [["trip_id", "value", "_order"]]
    r, t = source.read_manifest(spark, str(tmp_path / "m"))
    assert (r.count(), t.count()) == (2, 2)


def test_phrases_are_found_as_before(spark):
    texts = ["Red Wine, white wine", "gin & tonic 5%abv", "GIN AND TONIC", "Stone Wood lager", "garlic bread 10%", "Asaht", "pina colada", "redwine", "0.3% alc 4.5% alc/vol"]
    got = {r.description: (r.alcohol_reason, r.alcohol_matched_term) for r in alcohol.detect_alcohol(spark.createDataFrame([(t,) for t in texts], "description string")).collect()}
    assert got["Red Wine, white wine"] == ("alcohol category", "white wine") and got["redwine"][0] == "no alcohol evidence"
    assert got["gin & tonic 5%abv"] == ("explicit non-zero alcohol content", "5%") and got["GIN AND TONIC"] == ("recognized cocktail", "gin and tonic")
    assert got["Stone Wood lager"] == ("recognized alcohol brand", "stone wood") and got["Asaht"][1] == "asahi"
    assert got["0.3% alc 4.5% alc/vol"][1] == "4.5%" and got["garlic bread 10%"][0] == "no alcohol evidence"


def _in_slices(spark, monkeypatch, most: int, step):
    """Rows of a step whose tables are cut to slices of at most so many rows, and the folders it leaves."""
    from tripledger.functions import materialize as written

    whole = sorted(map(str, step().collect()))
    monkeypatch.setattr(written, "SLICE", most)
    out = step()
    assert sorted(map(str, out.collect())) == whole and whole
    return {f.rsplit("/", 1)[0] for f in out.inputFiles()}


def test_lines_are_matched_slice_by_slice(spark, monkeypatch):
    words = ["tea", "teas", "green tea", "cake", ""]
    rows = [(f"T{i % 3}", f"r{i % 13}", i, words[i % 5], D("5.00") + i % 4, i % 7 == 0) for i in range(300)]
    lines = spark.createDataFrame(rows, "trip_id string, source_file string, pos bigint, description string, amount decimal(18,2), is_alcohol boolean")
    left = _in_slices(spark, monkeypatch, 100, lambda: review.fuzzy_line_match(lines, lines.filter("pos % 3 <> 1")))
    assert len(left) >= 3  # each slice is written


def test_line_pairs_meet_once_and_only_within_reach(spark):
    rows = [("T", "r", 1, "tea", D("0.05"), False), ("T", "r", 2, "tea", D("0.07"), False), ("T", "r", 3, "teas", D("0.05"), False), ("T", "r", 4, "zzzzzzzzzz", D("0.05"), False)]
    lines = spark.createDataFrame(rows, "trip_id string, source_file string, pos bigint, description string, amount decimal(18,2), is_alcohol boolean")
    n, s = (review._with_kind(review._line_kinds(lines, x), x) for x in "ns")
    pairs = [(r.n_kind, r.s_kind) for r in review.fuzzy_candidates(n, s).collect()]
    assert len(pairs) == len(set(pairs)) == 10


def test_trips_are_matched_slice_by_slice(spark, monkeypatch):
    side, groups = (t.withColumn("trip_id", F.concat(F.lit("T"), F.substring(c, 2, 1))) for t, c in zip(_sides(spark), ("source_file", "group_id"), strict=True))
    assert len(_in_slices(spark, monkeypatch, 5, lambda: matching.best_match(side, groups))) == 4
    matched = materialize(matching.match_groups(side, groups))
    assert len(_in_slices(spark, monkeypatch, 5, lambda: matching.suggestions(side, matched))) == 4


def test_large_files_are_hashed_block_by_block(spark, tmp_path, monkeypatch):
    import hashlib

    from tripledger.sources import statements

    (tmp_path / "T1").mkdir()
    contents = {"a.csv": b"x" * 10, "b [1].csv": b"y\n" * 5_000, ".hidden.csv": b"z" * 9_000, "c.txt": b"q" * 8_000}
    for name, content in contents.items():
        (tmp_path / "T1" / name).write_bytes(content)
    monkeypatch.setattr(statements, "HASHED_WHOLE", 1_000)
    monkeypatch.setattr(statements, "_stream_sha256", lambda s, path, f=statements._stream_sha256: streamed.append(path) or f(s, path))
    streamed: list[str] = []
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")  # what a value of 2 GB is to a larger file
    try:
        rows = statements.scan_files(spark, str(tmp_path)).select("source_file", "size", "sha256", "supported").collect()
    finally:
        spark.conf.unset(key)
    assert {r.source_file: (r.size, r.sha256) for r in rows} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if n[0] != "."}
    assert len(streamed) == 2
    assert statements.scan_files(spark, str(tmp_path)).filter("source_file = 'b [1].csv'").first().content == contents["b [1].csv"]


def test_statement_files_are_written_by_all_tasks_over_older_ones(spark, tmp_path):
    from tripledger.plans import q_streams

    texts = lambda mark: spark.createDataFrame([(f"T{i}", f"f {i % 3}.csv", f"{mark} {i}\n\nb") for i in range(40)], "trip_id string, source_file string, content string").coalesce(1)
    q_streams.write_statement_files(texts("old"), str(tmp_path / "in"))
    tasks: list[int] = []
    kept = q_streams.spread
    try:
        q_streams.spread = lambda df: tasks.append(kept(df).rdd.getNumPartitions()) or kept(df)
        q_streams.write_statement_files(texts("new"), str(tmp_path / "in"))
    finally:
        q_streams.spread = kept
    assert tasks == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
    found = {(p.parent.name, p.name): p.read_text() for p in (tmp_path / "in").glob("*/*.csv")}
    assert found == {(f"T{i}", f"f {i % 3}.csv"): f"new {i}\n\nb\n" for i in range(40)}
    q_streams.remove_files(spark, f"{tmp_path}/in/*/f 1.csv")
    assert len(list((tmp_path / "in").glob("*/*.csv"))) == 40 - 13


def test_notices_are_dealt_by_bytes_too(spark, tmp_path, monkeypatch):
    from tripledger.streaming import streams

    (tmp_path / "in" / "T").mkdir(parents=True)
    for i in range(30):
        (tmp_path / "in" / "T" / f"{i}.csv").write_text("Date,Description,Amount,Currency\n13/07/2026,Shop,-10.00,EUR\n")
    monkeypatch.setattr(streams, "BYTES_PER_BATCH", 1_000)
    ingest = streams.StatementIngest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    ingest.scan()
    assert spark.read.parquet(ingest.notices).count() == 30
    assert len(list((tmp_path / "out" / "notices").glob("*.parquet"))) == 2


def test_changed_receipts_are_found_once(spark, tmp_path, monkeypatch):
    schema = "trip_id string, source_file string, pos bigint, description string, amount decimal(18,2), is_alcohol boolean"
    made: list[list[str]] = []
    monkeypatch.setattr(review, "materialize", lambda df: made.append(df.columns) or materialize(df))
    old = spark.createDataFrame([("T", f"r{i}", 1, "tea", D("1.00"), False) for i in range(4)], schema)
    new = spark.createDataFrame([("T", f"r{i}", 1, "tea" if i else "cake", D("1.00"), False) for i in range(5)], schema)
    out = review.line_changes(old, new, old.limit(1))
    assert {(r.source_file, r.before, r.after) for r in out.collect()} == {("r0", "tea — 1.00", "cake — 1.00"), ("r4", "No extracted purchase lines", "tea — 1.00")}
    assert made == [["trip_id", "source_file"]]
