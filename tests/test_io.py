"""Sources, sinks and the streaming folder ingest (files in fresh temp folders)."""

import os
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.operators import quality as K
from ledgerline.sinks import writers as B
from ledgerline.sources import files as A
from tests.conftest import rows


def _write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_multi_file_read(spark, tmpdir_path):
    _write(f"{tmpdir_path}/a.csv", "Invoice No.,City,Amount\n1,PUNE,10\n")
    _write(f"{tmpdir_path}/b.csv", "Amount,Invoice No.,City\n20,2,DELHI\n")
    _write(f"{tmpdir_path}/c.csv", "Invoice No.,City,Amount,Party Name\n3,SURAT,30,ACME\n")
    _write(f"{tmpdir_path}/~$a.csv", "garbage\n")
    _write(f"{tmpdir_path}/empty.csv", "")
    df = A.read_folder(spark, tmpdir_path)
    got = sorted(rows(df, "INVOICE_NO", "CITY", "AMOUNT", "CUSTOMER_NAME"))
    assert got == [("1", "PUNE", "10", None), ("2", "DELHI", "20", None), ("3", "SURAT", "30", "ACME")]
    typed = A.coerce_types(df)
    assert dict(typed.dtypes)["AMOUNT"] == "decimal(26,4)"


def test_json_and_read_time_coercion(spark, tmpdir_path):
    _write(f"{tmpdir_path}/r.json", '{"DATE": "2024-04-02", "amount": "x"}\n{"DATE": "bad", "amount": "12.5"}\n')
    df = A.read_time_coercion(A.read_json(spark, f"{tmpdir_path}/r.json"))
    out = rows(df, "amount", "FINANCIAL_YEAR", "MONTH")
    assert out == [(Decimal("0.0000"), "FY24-25", "APR-24"), (Decimal("12.5000"), "UNKNOWN", None)]


def _sales(spark, recs):
    return spark.createDataFrame(recs, "INVOICE_NO string, AMOUNT decimal(26,4), tenant_id string")


def test_incremental_append_and_clear(spark, tmpdir_path):
    path = f"{tmpdir_path}/sales"
    first = _sales(spark, [("1", Decimal(1), "t1"), ("2", Decimal(2), "t1"), ("1", Decimal(1), "t2")])
    assert B.load(first, path) == 3
    second = _sales(spark, [("1", Decimal(5), "t1"), ("3", Decimal(3), "t1"), ("3", Decimal(3), "t1"), ("3", Decimal(4), "t1"),
                            ("2", Decimal(2), "t2"), (None, Decimal(9), "t1")])
    # invoice 1 known for t1 -> dropped; new invoice 3 keeps all 3 lines; invoice 2 is new for tenant t2; NULL kept
    assert B.load(second, path) == 5
    assert B.load(second, path) == 0  # replay adds nothing (a stored NULL invoice matches NULL, as pandas isin does)
    assert B.clear_tenant(spark, path, "t2") == 2
    left = spark.read.parquet(path)
    assert left.where(F.col("tenant_id") == "t2").count() == 0
    assert left.where(F.col("tenant_id") == "t1").count() == 6


def test_exports_archive_audit(spark, tmpdir_path):
    df = _sales(spark, [("1", Decimal("1.5"), "t1"), ("2", None, "t1")])
    B.export_csv(df, f"{tmpdir_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmpdir_path}/csv")
    assert back.count() == 2
    B.export_json(df, f"{tmpdir_path}/json")
    text = "".join(open(os.path.join(f"{tmpdir_path}/json", f)).read() for f in os.listdir(f"{tmpdir_path}/json")
                   if f.endswith(".json"))
    assert '"AMOUNT":null' in text
    paths = B.archive({"summary": df}, f"{tmpdir_path}/arch", "2024-04-01")
    assert paths[0].endswith("summary/run_date=2024-04-01") and spark.read.parquet(paths[0]).count() == 2
    a = B.audit_row(spark, 5, 10)
    assert a.columns == ["RUN_TIMESTAMP", "NEW_RECORDS_ADDED", "TOTAL_RECORDS_AFTER_RUN"]
    req = rows(K.required_columns(df))
    assert ("CITY", False) in req


def test_snapshot_merge_old_wins(spark):
    old = _sales(spark, [("1", Decimal(10), "t"), ("1", Decimal(11), "t")])
    new = _sales(spark, [("1", Decimal(99), "t"), ("2", Decimal(5), "t")])
    out = dict(rows(B.merge_snapshot(old, new), "INVOICE_NO", "AMOUNT"))
    assert out == {"1": Decimal(10), "2": Decimal(5)}


def _stream_once(spark, base, files):
    from ledgerline.streaming.ingest_stream import start_ingest

    src = f"{base}/src"
    os.makedirs(src, exist_ok=True)
    for name, text in files:
        _write(f"{src}/{name}", text)
    q = start_ingest(spark, src, f"{base}/table", f"{base}/ckpt", trigger={"availableNow": True}, files_per_trigger=1,
                     archive_dir=f"{base}/archive", audit_path=f"{base}/audit", tenant_id="t", rejects_path=f"{base}/rejects")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/table")


HEAD = "Date,Invoice No.,Party Name,State,Amount\n"
LINES = ["2024-04-01,1,A,GOA,10\n", "2024-04-01,1,A,GOA,5\n", "2024-04-02,2,B,GOA,7\n", "2024-04-03,3,C,GOA,1\n"]


def test_stream_split_invariance_and_replay(spark, tmpdir_path):
    one = _stream_once(spark, f"{tmpdir_path}/one", [("f1.csv", HEAD + "".join(LINES))])
    two = _stream_once(spark, f"{tmpdir_path}/two", [("f1.csv", HEAD + "".join(LINES[:2])), ("f2.csv", HEAD + "".join(LINES[2:]))])
    five = _stream_once(spark, f"{tmpdir_path}/five", [(f"f{i}.csv", HEAD + line) for i, line in enumerate(
        [LINES[0] + LINES[1], LINES[2], LINES[3], "", "\n"])])  # invoices never span files
    key = ["INVOICE_NO", "AMOUNT"]
    assert sorted(rows(one, *key)) == sorted(rows(two, *key)) == sorted(rows(five, *key))
    # a new file repeating a known invoice adds only its new invoice; the audit logs each batch
    base = f"{tmpdir_path}/two"
    again = _stream_once(spark, base, [("f3.csv", HEAD + LINES[0] + "2024-04-04,4,D,GOA,2\n")])
    assert sorted(r[0] for r in again.select("INVOICE_NO").distinct().collect()) == ["1", "2", "3", "4"]
    assert again.where(F.col("INVOICE_NO") == "1").count() == 2
    audit = spark.read.parquet(f"{base}/audit")
    assert audit.count() == 3 and audit.agg(F.sum("NEW_RECORDS_ADDED")).collect()[0][0] == 5
    assert not os.path.exists(f"{base}/src/f1.csv") or os.path.exists(f"{base}/archive")


def test_empty_upload_rejected(spark, tmpdir_path):
    import pytest

    _write(f"{tmpdir_path}/e.csv", "")
    with pytest.raises(ValueError):
        A.read_upload(spark, f"{tmpdir_path}/e.csv")
    _write(f"{tmpdir_path}/ok.csv", "Amount,City\n1,X\n")
    assert A.read_upload(spark, f"{tmpdir_path}/ok.csv").count() == 1


def test_malformed_lines_are_set_aside(spark, tmpdir_path):
    """Rows in = stored + known + rejected; quotes and line breaks inside values are no faults."""
    _write(f"{tmpdir_path}/a.csv", 'Invoice No.,Item,Amount\n1,"12"" PIPE, BLACK",5\n2,"two\nlines",6\n3,short\n4,x,7,surplus\n')
    _write(f"{tmpdir_path}/empty.csv", "")
    df, rejects = A.read_folder_with_rejects(spark, tmpdir_path)
    assert sorted(rows(df, "INVOICE_NO", "ITEMNAME", "AMOUNT")) == [("1", '12" PIPE, BLACK', "5"), ("2", "two\nlines", "6")]
    assert sorted(r.reason for r in rejects.collect()) == ["empty file", "number of fields", "number of fields"]


def test_long_header_and_unreadable_file(spark, tmpdir_path):
    import pytest

    names = [f"COLUMN_{i:05d}" for i in range(9000)]  # a header of more than one block
    _write(f"{tmpdir_path}/wide.csv", ",".join(names) + "\n")
    assert A.read_upload(spark, f"{tmpdir_path}/wide.csv").columns == names
    with pytest.raises(Exception):
        A.read_folder(spark, [f"{tmpdir_path}/missing.csv"])


def test_tenants_stay_apart(spark, tmpdir_path):
    import pytest

    path = f"{tmpdir_path}/t"
    assert B.load(_sales(spark, [("1", Decimal(1), "007")]), path) == 1
    assert B.load(_sales(spark, [("1", Decimal(1), "7"), ("1", Decimal(2), "ACME:IN"), ("1", Decimal(9), "007")]), path) == 2
    assert B.load(spark.createDataFrame([("2", 3.0, "7")], "INVOICE_NO string, RATE double, TENANT_ID string"), path) == 1
    back = B.read_table(spark, path)
    assert "RATE" in back.columns and sorted(rows(back, "tenant_id")) == [("007",), ("7",), ("7",), ("ACME:IN",)]
    assert A.scan(spark, path, "007").count() == 1
    with pytest.raises(ValueError):
        B.load(_sales(spark, [("1", Decimal(1), "x")]).drop("tenant_id"), path)
    assert B.clear_tenant(spark, path, "ACME:IN") == 1 and B.clear_tenant(spark, path, "../t") == 0
    assert B.read_table(spark, path).count() == 3


def test_stream_keeps_tenants_apart(spark, tmpdir_path):
    from ledgerline.streaming.ingest_stream import process_batch
    from ledgerline.operators.ingest import IngestConfig

    head = "Date,Invoice No.,Party Name,State,Amount,Tenant Id\n"
    for i, t in enumerate(("A", "B")):
        _write(f"{tmpdir_path}/f{i}.csv", head + f"2024-04-01,1,X,GOA,10,{t}\n")
        assert process_batch(spark, [f"{tmpdir_path}/f{i}.csv"], i, f"{tmpdir_path}/table", None, IngestConfig(), None, None) == 1
    assert B.read_table(spark, f"{tmpdir_path}/table").count() == 2


def test_snapshot_order(spark, tmpdir_path):
    df = spark.createDataFrame([("1", "2024-01-01", 1.0, "m"), ("2", "2024-03-01", 2.0, "m"), ("3", "2024-02-01", 3.0, "m")],
                               "INVOICE_NO string, DATE string, AMOUNT double, MONTH string")
    out = B.merge_snapshot(df, df.limit(0))
    assert out.columns == ["DATE", "MONTH", "INVOICE_NO", "AMOUNT"]
    B.write_snapshot(out, f"{tmpdir_path}/s")
    files = sorted(f for f in os.listdir(f"{tmpdir_path}/s") if f.endswith(".parquet"))
    assert [r.DATE for f in files for r in spark.read.parquet(f"{tmpdir_path}/s/{f}").collect()] == ["2024-03-01", "2024-02-01", "2024-01-01"]


def test_checkpoint_folder_is_asked_for_off_local_mode(monkeypatch):
    import pytest

    from ledgerline import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Fake:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake())


def test_unfinished_fact_is_built_anew(spark, tmpdir_path, monkeypatch):
    from ledgerline.sources import tables as T
    from tests.conftest import SF_SMALL

    monkeypatch.setattr(T, "LAYOUT", f"test-{os.path.basename(tmpdir_path)}")
    good = T.sales(spark, SF_SMALL).count()
    target = next(iter(k for k in T._STORED_SCHEMAS if T.LAYOUT in k))
    os.remove(f"{target}/_SUCCESS".replace("file://", ""))
    T._STORED_SCHEMAS.pop(target)
    assert T.sales(spark, SF_SMALL).count() == good and os.path.exists(f"{target}/_SUCCESS".replace("file://", ""))


def test_replayed_batches_change_nothing(spark, tmpdir_path):
    """Also when the batch before the replay was cut off between its steps; the history is not part of any batch's plan."""
    from ledgerline.operators.ingest import IngestConfig
    from ledgerline.streaming import ingest_stream as S

    base = tmpdir_path
    head = "Date,Invoice No.,Party Name,State,Amount\n"
    _write(f"{base}/f0.csv", head + "2024-04-01,1,A,GOA,10\n2024-04-01,2,A,GOA,5\n2024-04-01,,A,GOA,6\n")
    _write(f"{base}/f1.csv", head + "2024-04-02,2,B,GOA,7\n2024-04-03,3,C,GOA,1\n2024-04-01,,A,GOA,8\n2024-04-03,3,C,GOA,2\n")
    _write(f"{base}/f2.csv", "Date,Party Name,State,Amount\n2024-04-02,X,GOA,70\n")
    _write(f"{base}/f3.csv", "Date,Party Name,State,Amount\n2024-04-02,X,GOA,71\n")

    def batch(i):
        return S.process_batch(spark, [f"{base}/f{i}.csv"], i, f"{base}/t", None, IngestConfig(), None, f"{base}/audit", "t")

    def stored():
        return sorted(repr(r) for r in rows(B.read_table(spark, f"{base}/t"), "INVOICE_NO", "AMOUNT", "batch_id"))

    assert [batch(0), batch(1), batch(2)] == [3, 2, 1]
    want = stored()
    for i in (2, 1, 2, 0):
        batch(i)
        assert stored() == want
    # batch 3 was staged, then the process died; it is run again
    raw, _ = A.read_folder_with_rejects(spark, [f"{base}/f3.csv"])
    S.stage_keys(spark, S.with_key(B.with_tenant(raw, "t"), 3), 3, f"{base}/t-state")
    assert batch(3) == 1 and len(stored()) == 7
    audit = spark.read.parquet(f"{base}/audit").orderBy("batch_id")
    assert rows(audit, "NEW_RECORDS_ADDED", "TOTAL_RECORDS_AFTER_RUN") == [(3, 3), (2, 5), (1, 6), (1, 7)]


def test_schema_is_kept_beside_the_table(spark, tmpdir_path):
    path = f"{tmpdir_path}/t"
    B.load(_sales(spark, [("1", Decimal(1), "a")]), path)
    B.load(spark.createDataFrame([("2", 3.0, "b")], "INVOICE_NO string, RATE double, tenant_id string"), path)
    assert B.kept_schema(spark, path).names == ["INVOICE_NO", "AMOUNT", "tenant_id", "RATE"]
    assert sorted(rows(B.read_table(spark, path), "INVOICE_NO", "AMOUNT", "RATE")) == [("1", Decimal(1), None), ("2", None, 3.0)]
    os.remove(f"{path}/{B.SCHEMA_FILE}")  # a table of another writer: footers are merged, and kept with the next load
    assert B.load(_sales(spark, [("2", Decimal(1), "a")]), path) == 1
    assert set(B.kept_schema(spark, path).names) == {"INVOICE_NO", "AMOUNT", "tenant_id", "RATE"}


def test_replace_leaves_the_old_table_when_the_write_fails(spark, tmpdir_path):
    import pytest

    path = f"{tmpdir_path}/t"
    B.replace_all(_sales(spark, [("1", Decimal(1), "a"), ("2", Decimal(1), "b")]), path)
    with pytest.raises(Exception):
        B.replace_all(_sales(spark, [("3", Decimal(1), "a")]).withColumn("AMOUNT", F.raise_error(F.lit("stop"))), path)
    assert B.read_table(spark, path).count() == 2
    B.replace_all(B.read_table(spark, path).where("tenant_id = 'b'"), path)  # from the table itself
    assert rows(B.read_table(spark, path), "INVOICE_NO") == [("2",)] and len(os.listdir(tmpdir_path)) == 1


def _scanned_rows(df):
    """Rows that the one Parquet scan of a plan without shuffles has read."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while "Scan parquet" not in node.nodeName():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


def test_batches_skip_row_groups_of_the_history(spark, tmpdir_path):
    """Few invoices: row groups whose Bloom filter has none of them are not read; many: those outside their range."""
    from ledgerline.sinks import writers as W

    path = f"{tmpdir_path}/history"
    # keys in no order: least and greatest of every file are alike, and too many for a dictionary
    stored = spark.range(240000).select(F.sha1(F.col("id").cast("string")).alias("INVOICE_NO"), F.lit("t").alias("tenant_id"), "id")
    assert W.load(stored.repartition(4, "id"), path) == 240000
    table = W.read_table(spark, path)
    known = table.where("id = 7").select("INVOICE_NO", "tenant_id", "id")
    batch = known.unionByName(spark.createDataFrame([("new", "t", -1), ("new", "u", -3)], known.schema))
    near = W.may_hold_keys(table, batch)
    assert 0 < _scanned_rows(near.select("INVOICE_NO")) < 240000 / 2
    assert near.where("id = 7").count() == 1
    batch = batch.unionByName(spark.createDataFrame([(None, "t", -2)], known.schema))
    plan = W.may_hold_keys(table, batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("[IsNull(INVOICE_NO)]") == 1 and plan.count("[In(INVOICE_NO") == 1  # two scans
    assert W.load(batch, path) == 3 and W.load(batch, path) == 0  # NULL numbers too


def test_pushed_keys_change_no_result(spark, tmpdir_path, monkeypatch):
    """Lists, ranges and no pushed filter keep the same rows of a batch, NULL numbers and all-NULL batches included."""
    from ledgerline.sinks import writers as W

    schema = "INVOICE_NO string, tenant_id string, QTY double"
    old = spark.createDataFrame([("1", "t", 1.0), ("2", "t", 1.0), (None, "u", 1.0), ("9", "u", 2.0)], schema)
    batches = [[("1", "t", 3.0), ("1", "u", 3.0), ("5", "t", 3.0)], [(None, "u", 4.0), (None, "t", 4.0)], [], [("2", "t", 5.0), (None, "u", 5.0)]]
    for few in (10_000, 0):
        monkeypatch.setattr(W, "FEW_KEYS", few)
        for i, recs in enumerate(batches):
            new = spark.createDataFrame(recs, schema)
            path = f"{tmpdir_path}/{few}-{i}"
            W.load(old, path)
            want = W.append_new(new, old).count()
            assert W.load(new, path) == want and W.read_table(spark, path).count() == 4 + want


def test_uploads_of_larger_tables_are_dealt_to_more_files(spark, monkeypatch):
    """Each upload file is written by one task: their number follows the size of the lines, the rows stay the same."""
    from ledgerline import catalog_io as I
    from tests.conftest import SF_SMALL

    before, seen, read = {tuple(r) for r in I.a2_rejects(spark, SF_SMALL).collect()}, [], I.A.read_folder_with_rejects
    monkeypatch.setattr(I.A, "read_folder_with_rejects", lambda s, paths: seen.append(len(paths)) or read(s, paths))
    monkeypatch.setattr(I.T, "buckets_for", lambda *_: 24)
    assert {tuple(r) for r in I.a2_rejects(spark, SF_SMALL).collect()} == before and seen[0] == 24


def _shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}


def test_writes_leave_no_shuffle_files(spark, tmpdir_path):
    """Loads, batches, exports and replacements; the session's own setting stays what it was."""
    from ledgerline.operators.ingest import IngestConfig
    from ledgerline.session import SHUFFLES_GO, shuffles_go
    from ledgerline.streaming.ingest_stream import process_batch

    _write(f"{tmpdir_path}/f.csv", HEAD + "".join(LINES) + '2024-04-04,4,"two\nlines",GOA,2\n')
    many = spark.range(2000).select(F.col("id").cast("string").alias("INVOICE_NO"), F.lit("t").alias("tenant_id")).repartition(3, "INVOICE_NO")
    own, before = spark.conf.get(SHUFFLES_GO), _shuffle_files(spark)
    assert B.load(many.where("INVOICE_NO < '5'"), f"{tmpdir_path}/t") + B.load(many, f"{tmpdir_path}/t") == 2000
    B.export_csv(many, f"{tmpdir_path}/csv")
    B.replace_all(many, f"{tmpdir_path}/r")
    assert _shuffle_files(spark) <= before
    assert process_batch(spark, [f"{tmpdir_path}/f.csv"], 0, f"{tmpdir_path}/s", None, IngestConfig(), None, None, "t") == 5
    assert os.listdir(f"{tmpdir_path}/s-state/records") == []
    assert spark.conf.get(SHUFFLES_GO) == own
    with shuffles_go(spark), shuffles_go(spark):
        assert spark.conf.get(SHUFFLES_GO) == "true"
    assert spark.conf.get(SHUFFLES_GO) == own


def test_new_keys_keep_the_same_rows_by_either_side(spark, tmpdir_path):
    """All, most, few and none of a batch's keys are new; NULL numbers too. Where all are, no join is planned."""
    from ledgerline.streaming import ingest_stream as S

    schema = f"{S.KEY_SCHEMA}, n int"
    recs = [(t, True, k, i) for i, (t, k) in enumerate([("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("b", None), ("a", None), ("a", "3")])]
    rows_ = spark.createDataFrame(recs, schema)
    staged = rows_.select(*S.KEY).distinct()
    for i, known in enumerate([[], [("a", "1")], [("b", None)], [("a", "1"), ("a", None), ("b", "1"), ("a", "2")], [r[::2][:2] for r in recs]]):
        first = spark.createDataFrame([r for r in {x[:3] for x in recs} if (r[0], r[2]) not in known], S.KEY_SCHEMA)
        out = S.rows_of_new_keys(rows_, staged, first, f"{tmpdir_path}/{i}")
        assert sorted(r.n for r in out.collect()) == [r[3] for r in recs if (r[0], r[2]) not in known]
        assert known or "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_tenants_without_stored_rows_are_not_joined(spark, tmpdir_path):
    from ledgerline.sinks import writers as W

    schema = "INVOICE_NO string, tenant_id string, QTY double"
    path = f"{tmpdir_path}/t"
    old = spark.createDataFrame([("1", "ACME:IN", 1.0), ("1", "50%", 1.0), ("2", None, 1.0)], schema)
    W.load(old, path)
    assert W._stored_tenants(spark, path, "tenant_id") == {"ACME:IN", "50%", None}
    new = spark.createDataFrame([("1", "ACME:IN", 2.0), ("1", "é", 2.0), ("1", "50%", 2.0), ("2", None, 2.0), ("1", None, 2.0), (None, "7", 2.0), ("2", "", 2.0)], schema)
    want = sorted(map(repr, rows(W.append_new(new, old))))
    assert sorted(map(repr, rows(W._unknown(new, W.read_table(spark, path), {"ACME:IN", "50%", None}, "INVOICE_NO", "tenant_id")))) == want and len(want) == 4
    plan = W._unknown(new.where("tenant_id = 'é'"), W.read_table(spark, path), {"ACME:IN"}, "INVOICE_NO", "tenant_id")
    assert plan.count() == 1
    assert W.load(new, path) == 4


def test_uploads_are_packed_and_bounded(spark, tmpdir_path):
    """Packed files hold at most so many lines, and are read back whole."""
    from ledgerline import catalog_io as I

    I._write_uploads([spark.range(25).select(F.col("id").cast("string").alias("No")).coalesce(1)], f"{tmpdir_path}/up", most_rows=10)
    files = A.list_files(spark, f"{tmpdir_path}/up", (I.PACKED,))
    assert len(files) == 3 and A.read_folder(spark, files, standardize=False).count() == 25
