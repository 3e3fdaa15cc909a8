"""Scenarios of the stored table: reads, snapshots, batches, flush, reopen, compaction, recovery."""

import json
import os
import random

import pytest

from keytide.functions.keys import successor
from keytide.functions.schema import InvalidRecord, KeyNotFound
from keytide.operators import compaction as C, readview as R
from keytide.sources.cli import Shell
from keytide.sources.commitlog import CommitConflict, CommitLog, CorruptLog, UnsafeStore
from keytide.sources.table import Config, KVTable
from keytide.streaming.ingest import into_table, latest_state


@pytest.fixture
def table(spark, tmp_path):
    return KVTable.open(spark, str(tmp_path / "t"))


@pytest.fixture
def plain(spark, tmp_path):
    """A table that compacts only when it is told to."""
    return KVTable.open(spark, str(tmp_path / "t"), Config(auto_compact=False))


def pairs(df):
    return [(r.key, r.value) for r in df.collect()]


def test_put_get_delete(table):
    table.put("a", "1")
    assert table.get("a") == "1"
    table.delete("a")
    with pytest.raises(KeyNotFound):
        table.get("a")
    table.delete("never there")
    table.put("a", "")
    assert table.get("a") == ""


def test_snapshots_see_their_past(table):
    table.put("x", "1")
    with table.snapshot() as s:
        assert s.read_seq == 1
        table.delete("x")
        table.put("y", "2")
        table.flush()
        assert table.get("x", s) == "1" and pairs(table.scan(s)) == [("x", "1")]
    assert pairs(table.scan()) == [("y", "2")]
    assert table.oldest_snapshot == table.next_seq


def test_range_and_prefix(table):
    for k in ("a", "b", "c", "user:1", "user:2", "usez", "sys:1"):
        table.put(k, k)
    s = table.snapshot()
    table.put("d", "d")
    table.flush()
    assert [k for k, _ in pairs(table.scan_range("a", "d", s))] == ["a", "b", "c"]
    assert [k for k, _ in pairs(table.scan_range(None, "b"))] == ["a"]
    assert [k for k, _ in pairs(table.scan_range("user:2", None))] == ["user:2", "usez"]
    assert pairs(table.scan_range("a", "a")) == []
    assert [k for k, _ in pairs(table.scan_prefix("user:"))] == ["user:1", "user:2"]
    assert len(pairs(table.scan_prefix(""))) == 8


def test_batch_is_atomic_and_ordered(table, tmp_path, spark):
    table.put("k", "old")
    assert table.write([("put", "k", "1"), ("put", "k", "2"), ("put", "j", None), ("delete", "z")]) == 5
    assert table.get("k") == "2" and table.get("j") == ""
    for bad in ([], [("put", "", "v")], [("merge", "a", "v")]):
        with pytest.raises(InvalidRecord):
            table.write(bad)
    table.close()
    again = KVTable.open(spark, str(tmp_path / "t"))
    assert again.next_seq == 6 and again.get("k") == "2"
    assert [r.seq for r in again.history("k").collect()] == [3, 2, 1]


def test_bulk_write_numbers_rows_densely(table, spark):
    rows = spark.range(1000).selectExpr("concat('k', lpad(id, 4, '0')) key", "string(id) value").repartition(7)
    assert table.write_frame(rows) == 1000
    assert sorted(r.seq for r in table.changelog().collect()) == list(range(1, 1001))
    with pytest.raises(InvalidRecord):
        table.write_frame(rows.limit(0))


def test_binary_keys(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "b"), Config(key_type="binary"))
    keys = [b"a", b"a\x00", b"ab", b"b", b"\xff", b"\xff\xff"]
    for k in keys:
        t.put(k, k)
    t.flush()
    assert [bytes(r.key) for r in t.scan().collect()] == sorted(keys)
    assert [bytes(r.key) for r in t.scan_prefix(b"a").collect()] == [b"a", b"a\x00", b"ab"]
    assert [bytes(r.key) for r in t.scan_prefix(b"\xff").collect()] == [b"\xff", b"\xff\xff"]
    assert bytes(t.get(b"a\x00")) == b"a\x00"


def test_successor():
    assert successor(b"a\xff") == b"b" and successor(b"\xff\xff") is None and successor("az") == "a{"
    assert successor("a\U0010ffff") == "b" and successor("퟿") == ""


def test_levels_compaction_keeps_reads(plain, spark, tmp_path):
    table = plain
    for i in range(5):
        table.put(f"key{i}", f"val{i}")
        if i == 4:
            table.put("key0", "val0-updated")
        table.flush()
    assert table.pick_level() == 0
    s = table.snapshot()
    before = pairs(table.scan())
    table.compact()
    assert [len(table.files(0)), len(table.files(1))] == [0, 1]
    assert pairs(table.scan()) == before == pairs(table.scan(s))
    assert table.vacuum() == [] and pairs(table.scan(s)) == before
    s.release()
    assert len(table.vacuum()) == 5
    table.checkpoint()
    table.close()
    assert pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == before


def test_tombstones_are_collected_only_when_no_snapshot_needs_them(table):
    table.put("key1", "value1")
    one = table.snapshot()
    table.delete("key1")
    two = table.snapshot()
    table.put("other", "x")
    table.flush()
    table.compact(0)
    assert table.get("key1", one) == "value1" and table.get_or_none("key1", two) is None
    assert table.history("key1").count() == 2
    one.release(), two.release()
    table.optimize()
    assert table.history("key1").count() == 0 and pairs(table.scan()) == [("other", "x")]
    table.delete("other")
    table.optimize()
    assert table.files() == [] and pairs(table.scan()) == []


def test_tombstone_stays_while_an_older_level_holds_the_key(table):
    """The input ends at a tombstone for the very key with which a file outside the input ends."""
    table.put("k", "old")
    table.flush()
    table.compact(0)
    table.compact(1)
    table.delete("k")
    table.flush()
    table.compact(0)
    assert [len(table.files(i)) for i in (1, 2)] == [1, 1]
    assert table.get_or_none("k") is None
    table.compact(1)
    assert table.get_or_none("k") is None and table.history("k").count() == 0


def test_overlap_and_scores(table):
    for a, b in (("a", "b"), ("d", "e"), ("g", "h")):
        table.write([("put", a, "1"), ("put", b, "2")])
        table.flush()
    names = [f.file for f in table.files(0)]
    assert [f.file for f in table.overlapping(0, b"b", b"d")] == names[:2]
    assert [f.file for f in table.overlapping(0, b"e", b"f")] == names[1:2]
    assert table.scores() == {0: 0.75} and table.pick_level() is None


def test_pruning_by_manifest(table):
    for k in "abc":
        table.put(k, k)
        table.flush()
    assert len(table.changelog(start="b", end="c").inputFiles()) == 1
    assert len(table.changelog().inputFiles()) == 3


def test_commit_log_faults(table, tmp_path, spark):
    table.put("a", "1")
    table.flush()
    other = KVTable.open(spark, str(tmp_path / "t"))
    table.put("b", "2")
    table.flush()
    other.put("c", "3")
    with pytest.raises(CommitConflict):
        other.flush()
    with pytest.raises(RuntimeError):
        other.put("d", "4")
    root = tmp_path / "t" / "_log"
    # a crash between the data files and the commit leaves files that no reader sees
    assert pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("a", "1"), ("b", "2")]
    last = sorted(p for p in os.listdir(root) if p.endswith(".json") and p[0] != ".")[-1]
    (root / last).write_text(json.dumps({"actions": [{}, {}], "end": 5}))
    crc = root / f".{last}.crc"
    crc.exists() and crc.unlink()
    with pytest.raises(CorruptLog):
        KVTable.open(spark, str(tmp_path / "t"))


def test_failed_write_does_not_reuse_numbers(table, monkeypatch):
    table.put("a", "1")
    table.flush()
    seq = table.next_seq
    monkeypatch.setattr(table.log, "commit", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    table.put("b", "2")
    with pytest.raises(OSError):
        table.flush()
    assert table.next_seq == seq + 1
    with pytest.raises(RuntimeError):
        table.get("a")


def test_random_traces_match_a_model(spark, tmp_path):
    for seed in range(2):
        rng, t, model, snaps, seq = random.Random(seed), KVTable.open(spark, str(tmp_path / f"m{seed}")), [], [], 0
        for _ in range(60):
            k, what = f"k{rng.randrange(6)}", rng.random()
            if what < 0.45:
                seq += 1
                model.append((k, seq, str(seq)))
                t.put(k, str(seq))
            elif what < 0.65:
                seq += 1
                model.append((k, seq, None))
                t.delete(k)
            elif what < 0.75:
                snaps.append((t.snapshot(), seq))
            elif what < 0.88:
                t.flush()
            elif what < 0.95 and t.files(0):
                t.compact(0)
        view = lambda s: sorted((k, v) for k, (q, v) in {k: (q, v) for k, q, v in model if q <= s}.items() if v is not None)
        for s, at in snaps[:3] + [(None, seq)]:
            assert pairs(t.scan(s)) == view(at)


def segment(tmp_path, name="t"):
    return sorted((tmp_path / name / "_wal").glob("*.log"))


def test_single_writes_survive_a_crash(table, spark, tmp_path):
    table.put("a", "1")
    table.write([("put", "b", "2"), ("delete", "a")])
    again = KVTable.open(spark, str(tmp_path / "t"))  # the first one never flushed
    assert pairs(again.scan()) == [("b", "2")] and again.next_seq == 4 and not again.files()
    again.close()  # a reader leaves the write log as it is
    assert len(segment(tmp_path)) == 1
    third = KVTable.open(spark, str(tmp_path / "t"))
    third.put("c", "3")
    third.close()
    assert segment(tmp_path) == [] and pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("b", "2"), ("c", "3")]


def test_binary_and_odd_values_in_the_write_log(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Config(key_type="binary", sync_writes=False, wal_dir=str(tmp_path / "elsewhere")))
    t.put(b"\x00\xff", b"\xfe")
    t.put(b"k", None)
    assert (tmp_path / "elsewhere").exists() and not (tmp_path / "t" / "_wal").exists()
    again = KVTable.open(spark, str(tmp_path / "t"), Config(wal_dir=str(tmp_path / "elsewhere")))
    assert [(bytes(r.key), bytes(r.value)) for r in again.scan().collect()] == [(b"\x00\xff", b"\xfe"), (b"k", b"")]


def test_torn_and_damaged_write_logs(table, spark, tmp_path):
    table.put("a", "1")
    table.put("b", "2")
    (f,) = segment(tmp_path)
    whole = f.read_bytes()
    f.write_bytes(whole[:-3])
    assert pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("a", "1")]
    f.write_bytes(whole[:20] + bytes([whole[20] ^ 1]) + whole[21:])
    with pytest.raises(CorruptLog):
        KVTable.open(spark, str(tmp_path / "t"))


def broken(*_, **__):
    raise OSError("disk")


@pytest.mark.parametrize("step", ["rows", "files", "statistics", "commit"])
def test_a_failed_flush_loses_nothing_and_stays(table, spark, tmp_path, monkeypatch, step):
    table.put("a", "1")
    table.flush()
    table.put("b", "2")
    table.delete("a")
    with monkeypatch.context() as m:
        if step == "rows":
            m.setattr(table, "_add", broken)
        elif step == "files":
            m.setattr("keytide.sources.table.normalise", broken)
        elif step == "statistics":
            m.setattr(table, "_stats", broken)
        else:
            m.setattr(table.log, "commit", broken)
        with pytest.raises(OSError):
            table.flush()
    for call in (table.flush, lambda: table.put("c", "3"), lambda: table.get("b"), table.compact):
        with pytest.raises(RuntimeError):
            call()
    table.close()
    again = KVTable.open(spark, str(tmp_path / "t"))
    assert pairs(again.scan()) == [("b", "2")] and again.next_seq == 4
    again.put("c", "3")
    again.flush()
    assert pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("b", "2"), ("c", "3")]


def test_a_write_that_the_log_refuses_is_not_acknowledged(table, spark, tmp_path, monkeypatch):
    table.put("a", "1")
    monkeypatch.setattr(table.wal, "append", broken)
    with pytest.raises(OSError):
        table.put("b", "2")
    with pytest.raises(RuntimeError):
        table.put("c", "3")
    assert pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("a", "1")]


def test_an_overtaken_writer_is_left_out(table, spark, tmp_path):
    other = KVTable.open(spark, str(tmp_path / "t"))
    for i in range(3):
        other.put(f"late{i}", "x")
    table.put("a", "1")
    table.flush()
    with pytest.raises(CommitConflict):
        other.flush()
    assert pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("a", "1")]


def test_upkeep_by_another_instance_loses_no_logged_write(plain, spark, tmp_path):
    for k in "ab":
        plain.put(k, k)
        plain.flush()
    plain.compact(0)
    plain.put("c", "c")
    plain.put("d", "d")
    plain.compact(1)  # a commit that leaves c and d in the write log
    want = [(k, k) for k in "abcd"]
    open_ = lambda: KVTable.open(spark, str(tmp_path / "t"), Config(auto_compact=False))
    open_().checkpoint()
    assert pairs(open_().scan()) == want
    assert len(open_().vacuum()) == 3
    assert pairs(open_().scan()) == want
    open_().compact(2)
    assert pairs(open_().scan()) == want and segment(tmp_path) == []


def test_a_full_buffer_is_flushed(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Config(buffer_bytes=200, auto_compact=False))
    for i in range(15):
        t.put(f"key{i:04d}", "v" * 30)
    assert len(t.files(0)) >= 2 and t.scan().count() == 15 == KVTable.open(spark, str(tmp_path / "t")).scan().count()


def test_compaction_and_checkpoints_come_by_themselves(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Config(l0_trigger=3, checkpoint_every=4))
    for i in range(7):
        t.put(f"k{i % 4}", str(i))
        t.flush()
    assert len(t.files(0)) < 3 and len(t.files(1)) == 1
    names = os.listdir(tmp_path / "t" / "_log")
    assert sum(n.endswith(".checkpoint") and n[0] != "." for n in names) == 1 and sum(n.endswith(".json") and n[0] != "." for n in names) <= 4
    t.put("unflushed", "1")
    t.checkpoint()
    again = KVTable.open(spark, str(tmp_path / "t"))
    assert pairs(again.scan()) == pairs(t.scan()) and again.next_seq == t.next_seq and again.files() == t.files()


def test_vacuum_remembers_and_finds(plain, spark, tmp_path, monkeypatch):
    for k in "ab":
        plain.put(k, k)
        plain.flush()
    plain.compact(0)
    with monkeypatch.context() as m:
        m.setattr(plain, "_delete", lambda name: False)
        assert plain.vacuum() == [] and len(plain._obsolete) == 2
    assert len(KVTable.open(spark, str(tmp_path / "t"))._obsolete) == 2
    assert len(plain.vacuum()) == 2
    again = KVTable.open(spark, str(tmp_path / "t"))
    assert again._obsolete == set() and again.vacuum() == []
    for name in ("data/crashed", "_stage/crashed"):
        (tmp_path / "t" / name).mkdir(parents=True)
        (tmp_path / "t" / name / "part-0.parquet").write_bytes(b"x")
    assert again.vacuum() == []
    assert {"data/crashed", "_stage/crashed"} <= set(again.vacuum(orphan_seconds=-1.0))
    assert pairs(again.scan()) == [("a", "a"), ("b", "b")]


def test_large_bulk_writes_are_dealt_by_key(spark, tmp_path):
    t = KVTable.open(spark, str(tmp_path / "t"), Config(target_file_bytes=2000, auto_compact=False))
    t.write_frame(spark.range(2000).selectExpr("concat('k', lpad(id * 7919 % 2000, 4, '0')) key", "string(id) value").repartition(3))
    files = t.files(0)
    assert len(files) > 2 and all(a.largest_key < b.smallest_key for a, b in zip(files, files[1:]))
    assert len(t.changelog(start="k0000", end="k0001").inputFiles()) == 1 and t.scan().count() == 2000


@pytest.mark.parametrize(("bloom", "codec"), [(True, "zstd"), (False, "snappy")])
def test_files_have_the_filter_and_the_codec_asked_for(spark, tmp_path, bloom, codec):
    t = KVTable.open(spark, str(tmp_path / "t"), Config(bloom=bloom, compression=codec))
    t.write_frame(spark.range(500).selectExpr("concat('k', lpad(id, 4, '0')) key", "string(id) value").coalesce(1))
    jvm = spark._jvm.org.apache.parquet.hadoop
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{t.path}/{t.files(0)[0].file}")
    reader = jvm.ParquetFileReader.open(jvm.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
    key = reader.getFooter().getBlocks().get(0).getColumns().get(0)
    assert key.getPath().toDotString() == "key" and (key.getBloomFilterOffset() > 0) == bloom and key.getCodec().toString() == codec.upper()
    if bloom:
        found = reader.readBloomFilter(key)
        hashed = lambda k: found.hash(spark._jvm.org.apache.parquet.io.api.Binary.fromString(k))
        assert all(found.findHash(hashed(f"k{i:04d}")) for i in range(0, 500, 50)) and sum(found.findHash(hashed(f"absent{i}")) for i in range(50)) < 10
    reader.close()


def test_publishing_by_rename_refuses_an_existing_version(table, spark, tmp_path):
    for part in (table.log, table.wal):
        part.local = False
    table.put("a", "1")
    table.put("b", "2")
    assert len(segment(tmp_path)) == 2
    table.flush()
    assert segment(tmp_path) == [] and pairs(KVTable.open(spark, str(tmp_path / "t")).scan()) == [("a", "1"), ("b", "2")]
    with pytest.raises(CommitConflict):
        table.log.commit(table.version, [])
    table.checkpoint(), table.checkpoint()
    with pytest.raises(UnsafeStore):
        CommitLog(spark, "http://localhost/t")


def test_equal_sequence_prefers_the_put(spark):
    log = spark.createDataFrame([("a", 10, 1, "x"), ("a", 9, 2, None), ("a", 9, 1, "y"), ("b", 1, 1, "z")], "key string, seq long, op int, value string")
    assert [(r.key, r.seq, r.op) for r in R.history(log).collect()] == [("a", 10, 1), ("a", 9, 1), ("a", 9, 2), ("b", 1, 1)]
    assert [tuple(r) for r in R.visible(log, 9).orderBy("key").collect()] == [("a", 9, "y"), ("b", 1, "z")]
    assert sorted((r.key, r.seq, r.op) for r in C.survivors(log, 9).collect()) == [("a", 9, 1), ("a", 10, 1), ("b", 1, 1)]


def test_plan_pushes_key_and_seq_but_not_op(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 2, None)], "key string, seq long, op int, value string")
    log.write.parquet(str(tmp_path / "p"))
    plan = R.scan_prefix(spark.read.parquet(str(tmp_path / "p")), "a", 5)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert plan.index("WindowGroupLimit") < plan.index("Exchange hashpartitioning(key") < plan.rindex("WindowGroupLimit")
    assert "GreaterThanOrEqual(key,a)" in pushed and "LessThan(key,b)" in pushed and "LessThanOrEqual(seq,5)" in pushed and "op" not in pushed.split("ReadSchema")[0]


def test_shell(spark, tmp_path):
    sh = Shell(spark)
    assert sh.run("GET a").startswith("ERROR")
    assert sh.run(f"open {tmp_path}/db") == "OK" and "open already" in sh.run("OPEN elsewhere")
    assert sh.run("PUT a  hello  world ") == "OK" and sh.run("PUT b").startswith("ERROR")
    assert sh.run("GET a") == "hello  world" and sh.run("get zz") == "NOT FOUND" and sh.run("DELETE zz") == "OK"
    assert sh.run("SCAN a b") == "a hello  world\nEND" and sh.run("SCAN b a").startswith("ERROR") and sh.run("SCAN -pre a").endswith("END")
    assert sh.run("SCAN -x a").startswith("ERROR") and sh.run("WHAT").startswith("ERROR") and sh.run("") == "" and sh.run("HELP")
    assert sh.run("EXIT") is None


def test_streams(spark, tmp_path, table):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string").coalesce(1).write.parquet(src)
    q = into_table(spark.readStream.schema("key string, value string").parquet(src), table, str(tmp_path / "cp"))
    q.processAllAvailable(), q.stop()
    assert pairs(table.scan()) == [("a", "1"), ("b", "2")] and list(table.applied.values()) == [0]
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", 2, 1, "new"), ("a", 1, 1, "old"), ("b", 3, 2, None)], "key string, seq long, op int, value string").write.parquet(log)
    q = latest_state(spark.readStream.schema("key string, seq long, op int, value string").parquet(log)).writeStream.format("memory").queryName("latest").outputMode("complete").start()
    q.processAllAvailable(), q.stop()
    assert sorted((r.key, r.seq) for r in spark.table("latest").collect()) == [("a", 2), ("b", 3)]
