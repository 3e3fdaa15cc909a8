"""KVTable: a changelog stored as Parquet files under an atomic commit log.

Single writer, many readers. A single write is in the write log before it returns (with ``sync_writes``, the default, on the
device) and waits in a buffer on the driver for the commit that ``flush`` (or a full buffer) makes; whoever opens the table reads what
the write log has beyond the last flush. Bulk writes go from executors straight to files. If a flush, a commit or the write log fails, the error
stays: nothing is dropped from the buffer, further calls raise, and reopening recovers what was acknowledged.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keytide.functions.keys import as_bytes, has_prefix, in_range, literal, successor
from keytide.functions.schema import DELETE, MAX_SEQ, N_LEVELS, PUT, InvalidRecord, KeyNotFound, changelog_schema, check_key, normalise
from keytide.operators import compaction, readview
from keytide.sources.commitlog import CommitLog
from keytide.sources.writelog import WriteLog


@dataclass(frozen=True)
class Config:
    """Omitted fields keep their defaults. ``block_size`` is the Parquet row group, in which readers skip by key; ``wal_dir`` the folder of
    the write log (``_wal`` in the table if None); ``auto_compact`` takes a step of compaction after a write to level 0 if a level is due;
    the commit log is folded every ``checkpoint_every`` commits."""

    buffer_bytes: int = 4 << 20
    l0_trigger: int = 4
    l1_max_bytes: int = 64 << 20
    compression: str = "zstd"
    block_size: int = 16 << 20
    target_file_bytes: int = 256 << 20
    bloom: bool = True
    sync_writes: bool = True
    auto_compact: bool = True
    key_type: str = "string"
    wal_dir: str | None = None
    checkpoint_every: int = 64


@dataclass(frozen=True)
class DataFile:
    file: str
    level: int
    smallest_key: bytes
    largest_key: bytes
    smallest_seq: int
    largest_seq: int
    n_entries: int
    file_size: int

    def action(self) -> dict:
        return self.__dict__ | {"action": "add", "smallest_key": self.smallest_key.hex(), "largest_key": self.largest_key.hex()}

    @classmethod
    def of(cls, a: dict) -> DataFile:
        return cls(**{k: bytes.fromhex(a[k]) if k.endswith("_key") else a[k] for k in cls.__dataclass_fields__})


@dataclass(frozen=True, eq=False)
class Snapshot:
    """A read sequence number and the files that hold it; pinned until released."""

    table: KVTable
    read_seq: int
    files: tuple[DataFile, ...]
    buffered: tuple[tuple, ...]

    def release(self) -> None:
        self.table._pins.pop(id(self), None)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.release()


class KVTable:
    def __init__(self, spark: SparkSession, path: str, config: Config):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self.log = CommitLog(spark, self.path)
        self.writer = uuid.uuid4().hex
        self._buffer: list[tuple] = []
        self._buffered_bytes = 0
        self._pins: dict[int, Snapshot] = {}
        self._error: Exception | None = None
        self._closed = self._wrote = False
        self.version, actions = self.log.replay()
        live, self._obsolete = compaction.live_files(actions)
        self._files = {f: DataFile.of(a) for f, a in live.items()}
        self.next_seq, self.cutoff, self._last_writer = 1, 0, ""
        self.applied: dict[str, int] = {}
        for a in actions:
            if a["action"] == "seq":
                self.next_seq = max(self.next_seq, a["next_seq"])
            elif a["action"] == "cutoff":
                self.cutoff = max(self.cutoff, a["seq"])
            elif a["action"] == "writer":
                self._last_writer = a["writer"]
            elif a["action"] == "stream":
                self.applied[a["stream"]] = a["batch"]
            elif a["action"] == "config":
                self.config = replace(self.config, key_type=a["key_type"])
        for f in self._files:
            if not self.log.fs.exists(self.log._path(f"{self.path}/{f}")):
                raise FileNotFoundError(f"{self.path}/{f} is in the log but not in storage")
        self.wal = WriteLog(spark, self.config.wal_dir or f"{self.path}/_wal", self.writer, self.config.sync_writes)
        self._recovered = [s.name for s in self.wal.segments()]
        rows, _ = self.wal.replay(self.cutoff, (self.version, self._last_writer))
        if rows:
            self._hold(rows)
            self.next_seq = max(self.next_seq, rows[-1][1] + 1)
        if self.version < 0:
            self._commit([{"action": "config", "key_type": self.config.key_type}])

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> KVTable:
        return cls(spark, path, config or Config())

    # writes

    def _ready(self) -> None:
        if self._closed:
            raise RuntimeError("the table is closed")
        if self._error is not None:
            raise RuntimeError("an earlier write failed; reopen the table") from self._error

    def _commit(self, actions: list[dict], takes_over: bool = True) -> None:
        """One more version. With ``takes_over``, other writers' logged writes count no more: whoever commits so holds them, or has put them in files."""
        try:
            self.log.commit(self.version + 1, [*actions, *([{"action": "writer", "writer": self.writer}] if takes_over else [])])
            self.version += 1
            self._wrote = True
            self._last_writer = self.writer if takes_over else self._last_writer
        except Exception as e:
            self._error = e
            raise

    def _take(self, n: int) -> int:
        """Sequence numbers are spent even if the write that wanted them fails."""
        base, self.next_seq = self.next_seq, self.next_seq + n
        if self.next_seq - 1 > MAX_SEQ:
            raise InvalidRecord("out of sequence numbers")
        return base

    def _hold(self, rows: list[tuple]) -> None:
        self._buffer += rows
        self._buffered_bytes += sum(len(r[0]) + len(r[3] or "") + 16 for r in rows)

    def put(self, key, value) -> int:
        return self.write([("put", key, value)])

    def delete(self, key) -> int:
        """A blind tombstone: deleting an absent key is no error."""
        return self.write([("delete", key)])

    def write(self, batch: list[tuple]) -> int:
        """An atomic batch of ("put", key, value) and ("delete", key): consecutive numbers in order, so
        the later record on a key wins; returns the last number. Nothing is acknowledged that the write log doesn't hold."""
        self._ready()
        if not batch:
            raise InvalidRecord("empty batch")
        for op, key, *_ in batch:
            check_key(key)
            if op not in ("put", "delete"):
                raise InvalidRecord(op)
        base, empty = self._take(len(batch)), "" if self.config.key_type == "string" else b""
        rows = [(key, base + i, PUT, v[0] if v and v[0] is not None else empty) if op == "put" else (key, base + i, DELETE, None) for i, (op, key, *v) in enumerate(batch)]
        try:
            self.wal.append(rows, self.version)
        except Exception as e:
            self._error = e
            raise
        self._wrote = True
        self._hold(rows)
        if self._buffered_bytes >= self.config.buffer_bytes:
            self.flush()
        return base + len(batch) - 1

    def write_frame(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """A bulk batch from a DataFrame of key, value and op (a put if absent), numbered in its partition
        order; returns the last number. Rows are staged to storage first, so that a rerun task can't number
        them differently. ``mark`` (a stream and its batch) is recorded by the same commit."""
        self._ready()
        self.flush()
        op = F.col("op") if "op" in rows.columns else F.lit(PUT)
        part = rows.select("key", op.cast("byte").alias("op"), "value", F.spark_partition_id().alias("_p"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_i"))
        stage = f"{self.path}/_stage/{uuid.uuid4().hex}"
        part.write.parquet(stage)
        try:
            staged = self.spark.read.parquet(stage)
            n = staged.count()
            if not n:
                raise InvalidRecord("empty batch")
            base = self._take(n)
            # a large batch is dealt out by key ranges, so that reads skip most of its files
            parts = self.log.fs.getContentSummary(self.log._path(stage)).getLength() // self.config.target_file_bytes
            self._add(compaction.dense_seqs(staged, base), level=0, parts=parts + 1 if parts else 0, mark=mark, cutoff=base + n - 1)
        finally:
            self.log.fs.delete(self.log._path(stage), True)
        self._after_level0()
        return base + n - 1

    def load_changelog(self, log: DataFrame) -> int:
        """Take over a changelog that has its sequence numbers, into a table without any rows; returns the last number."""
        self._ready()
        if self._files or self._buffer:
            raise RuntimeError("the table isn't empty")
        self.next_seq = max(self.next_seq, (log.agg(F.max("seq")).first()[0] or 0) + 1)
        self._add(log.select("key", "seq", "op", "value"), level=0, cutoff=self.next_seq - 1)
        self._after_level0()
        return self.next_seq - 1

    def flush(self) -> None:
        """Put buffered records into files by one commit; they leave the buffer and the write log after it."""
        if self._buffer:
            self._ready()
            rows = self._buffer
            try:
                self._add(self.spark.createDataFrame(rows, changelog_schema(self.config.key_type)).coalesce(1), level=0, cutoff=rows[-1][1], rows=len(rows))
            except Exception as e:
                self._error = e
                raise
            self._buffer, self._buffered_bytes = [], 0
            self.wal.drop(self.wal.rotate() + self._recovered)
            self._recovered = []
            self._after_level0()

    def _after_level0(self) -> None:
        """One step of compaction if it is due; files of one bulk write don't overlap and count as one at level 0."""
        level = self.pick_level() if self.config.auto_compact else None
        if level is not None and (level or len({f.file.rsplit("/", 1)[0] for f in self.files(0)}) >= self.config.l0_trigger):
            self.compact(level)

    def _add(self, log: DataFrame, level: int, removed: list[DataFile] = (), parts: int = 0, mark: tuple[str, int] | None = None, cutoff: int = 0, rows: int = 0) -> list[DataFile]:
        """Write files and publish them, with the removals, as one commit. Up to ``cutoff``, all acknowledged writes are in files then.
        ``rows``: of a file, if known, for the size of its Bloom filter."""
        log = normalise(log)
        log = log.repartitionByRange(parts, "key") if parts else log
        into = f"data/{uuid.uuid4().hex}"
        w = log.sortWithinPartitions("key", F.desc("seq"), "op").write.option("compression", self.config.compression).option("parquet.block.size", self.config.block_size)
        if self.config.bloom:
            w = w.option("parquet.bloom.filter.enabled#key", "true")
            w = w.option("parquet.bloom.filter.expected.ndv#key", rows) if rows else w
        w.parquet(f"{self.path}/{into}")
        new = self._stats(into, level)
        marks = [{"action": "stream", "stream": mark[0], "batch": mark[1]}] if mark else []
        marks += [{"action": "cutoff", "seq": cutoff}] if cutoff else []
        self._commit([f.action() for f in new] + [{"action": "remove", "file": f.file} for f in removed] + marks + [{"action": "seq", "next_seq": self.next_seq}])
        self.cutoff = max(self.cutoff, cutoff)
        if mark:
            self.applied[mark[0]] = mark[1]
        self._files |= {f.file: f for f in new}
        for f in removed:
            self._files.pop(f.file, None)
            self._obsolete.add(f.file)
        if self.version - self.log.base >= self.config.checkpoint_every:
            self.checkpoint()
        return new

    def _stats(self, into: str, level: int) -> list[DataFile]:
        if not any(s.getPath().getName().endswith(".parquet") for s in self.log.fs.listStatus(self.log._path(f"{self.path}/{into}"))):
            return []
        df = self.spark.read.schema(changelog_schema(self.config.key_type)).parquet(f"{self.path}/{into}")
        named = df.select("key", "seq", F.col("_metadata.file_name").alias("file_num"), F.col("_metadata.file_size").alias("size"))
        stats = compaction.file_stats(named, "file_num", F.max("size").alias("size")).collect()
        return [DataFile(f"{into}/{r.file_num}", level, as_bytes(r.smallest_key), as_bytes(r.largest_key), r.smallest_seq, r.largest_seq, r.n_entries, r.size) for r in stats]

    # reads

    def snapshot(self) -> Snapshot:
        self._ready()
        s = Snapshot(self, self.next_seq - 1, tuple(self._files.values()), tuple(self._buffer))
        self._pins[id(s)] = s
        return s

    @property
    def oldest_snapshot(self) -> int:
        return min((s.read_seq for s in self._pins.values()), default=self.next_seq)

    def changelog(self, at: Snapshot | None = None, start=None, end=None) -> DataFrame:
        """The versions a read may need: files whose keys or sequence numbers can't match are left out."""
        if at is None:
            self._ready()
        files, buffer, seq = (at.files, at.buffered, at.read_seq) if at else (tuple(self._files.values()), tuple(self._buffer), self.next_seq - 1)
        lo, hi = as_bytes(start), as_bytes(end)
        names = [f"{self.path}/{f.file}" for f in files if f.smallest_seq <= seq and (lo is None or f.largest_key >= lo) and (hi is None or f.smallest_key < hi)]
        schema = changelog_schema(self.config.key_type)
        log = self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        if buffer:
            log = log.unionByName(self.spark.createDataFrame(list(buffer), schema))
        return log.filter(F.col("seq") <= seq)

    def _read(self, at: Snapshot | None, start, end, where: Column) -> DataFrame:
        return readview.visible(self.changelog(at, start, end), where=where)

    def scan(self, at: Snapshot | None = None) -> DataFrame:
        return readview.ordered(self._read(at, None, None, F.lit(True)))

    def scan_range(self, start=None, end=None, at: Snapshot | None = None) -> DataFrame:
        return readview.ordered(self._read(at, start, end, in_range(start, end)))

    def scan_prefix(self, prefix, at: Snapshot | None = None) -> DataFrame:
        return readview.ordered(self._read(at, prefix or None, successor(prefix), has_prefix(prefix)))

    def get(self, key, at: Snapshot | None = None):
        check_key(key)
        nothing_between = key + ("\0" if isinstance(key, str) else b"\0")
        return readview.get_value(self.changelog(at, key, nothing_between), key)

    def get_or_none(self, key, at: Snapshot | None = None):
        try:
            return self.get(key, at)
        except KeyNotFound:
            return None

    def multi_get(self, keys: DataFrame, at: Snapshot | None = None) -> DataFrame:
        return readview.multi_get(self.changelog(at), keys)

    def history(self, key=None, at: Snapshot | None = None) -> DataFrame:
        return readview.history(self.changelog(at), None if key is None else F.col("key") == literal(key))

    # maintenance

    def files(self, level: int | None = None) -> list[DataFile]:
        return sorted((f for f in self._files.values() if level is None or f.level == level), key=lambda f: (f.level, f.smallest_key))

    def _limits(self) -> dict:
        return {"l0_trigger": self.config.l0_trigger, "l1_max_bytes": self.config.l1_max_bytes}

    def scores(self) -> dict[int, float]:
        return {level: score for level, _, _, score in compaction.level_scores(self._files.values(), **self._limits())}

    def pick_level(self) -> int | None:
        due = compaction.pick_compaction(self._files.values(), **self._limits())
        return due and due[0]

    def overlapping(self, level: int, smallest: bytes, largest: bytes) -> list[DataFile]:
        return compaction.overlapping(self.files(), level, smallest, largest)

    def compact(self, level: int | None = None) -> list[DataFile]:
        """Merge a level (the one most due if None) into the next: one commit adds and removes."""
        self._ready()
        if self._recovered:  # what another writer has logged goes into files before a commit of ours takes over
            self.flush()
        level = self.pick_level() if level is None else level
        if level is None:
            return []
        if not 0 <= level < N_LEVELS - 1:
            raise ValueError(f"level {level} can't be compacted")
        source = self.files(level) if level == 0 else self.files(level)[:1]
        if not source:
            return []
        lo, hi = min(f.smallest_key for f in source), max(f.largest_key for f in source)
        return self._merge(source + self.overlapping(level + 1, lo, hi), level + 1)

    def optimize(self, retain_history: bool = True) -> list[DataFile]:
        """Merge everything into the last level used; without history only what a new read sees stays."""
        self.flush()
        return self._merge(self.files(), max([1, *(f.level for f in self.files())]), retain_history) if self._files else []

    def _merge(self, inputs: list[DataFile], target: int, retain_history: bool = True) -> list[DataFile]:
        if not retain_history and self._pins:
            raise RuntimeError("history is still pinned by a snapshot")
        names, lo, hi = {f.file for f in inputs}, min(f.smallest_key for f in inputs), max(f.largest_key for f in inputs)
        bottom = not any(f.file not in names and f.smallest_key <= hi and f.largest_key >= lo for f in self._files.values())
        log = self.spark.read.schema(changelog_schema(self.config.key_type)).parquet(*(f"{self.path}/{f.file}" for f in inputs))
        kept = compaction.survivors(log, self.oldest_snapshot, bottom) if retain_history else compaction.latest_only(log)
        parts = max(1, -(-sum(f.file_size for f in inputs) // self.config.target_file_bytes))
        try:
            return self._add(kept, target, inputs, parts, rows=-(-sum(f.n_entries for f in inputs) // parts))
        except Exception as e:
            self._error = e
            raise

    def checkpoint(self) -> None:
        """Fold the log into the files that live, those still to be deleted, and the next number."""
        self._ready()
        live = [f.action() for f in self._files.values()]
        gone = [{"action": "remove", "file": f} for f in sorted(self._obsolete)]
        marks = [{"action": "stream", "stream": k, "batch": v} for k, v in self.applied.items()]
        marks += [{"action": "cutoff", "seq": self.cutoff}, {"action": "writer", "writer": self._last_writer}]
        self.log.checkpoint(self.version, gone + live + marks + [{"action": "seq", "next_seq": self.next_seq}, {"action": "config", "key_type": self.config.key_type}])

    def vacuum(self, orphan_seconds: float = 86_400.0) -> list[str]:
        """Delete files that no live version and no pinned snapshot needs, and data and staged files that no commit has named for
        ``orphan_seconds``, as a crash leaves them; returns what is gone. A file that can't be deleted is kept in mind."""
        self._ready()
        pinned = {f.file for s in self._pins.values() for f in s.files}
        gone = [f for f in sorted(self._obsolete) if f not in pinned and f not in self._files and self._delete(f)]
        if gone:
            self._commit([{"action": "forget", "files": gone}], takes_over=False)
            self._obsolete -= set(gone)
        return gone + self._orphans(pinned, orphan_seconds)

    def _delete(self, name: str) -> bool:
        path = self.log._path(f"{self.path}/{name}")
        self.log.fs.delete(path, True)
        return not self.log.fs.exists(path)

    def _orphans(self, pinned: set[str], seconds: float) -> list[str]:
        fs, path, known, out = self.log.fs, self.log._path, pinned | self._files.keys() | self._obsolete, []
        for kind in ("data", "_stage"):
            top = path(f"{self.path}/{kind}")
            for folder in fs.listStatus(top) if fs.exists(top) else []:
                inside = {f"{kind}/{folder.getPath().getName()}/{s.getPath().getName()}": s for s in fs.listStatus(folder.getPath())}
                newest = max([folder.getModificationTime(), *(s.getModificationTime() for s in inside.values())])
                if not inside.keys() & known and newest / 1000 < time.time() - seconds:
                    name = f"{kind}/{folder.getPath().getName()}"
                    out += [name] if self._delete(name) else []
        return out

    def close(self) -> None:
        """Flush and clean up, if this instance has written; what it only read stays as it is, in the write log too."""
        if not self._closed:
            if self._error is None and self._wrote:
                self.flush()
                self.vacuum()
            self.wal.rotate()
            self._closed = True
