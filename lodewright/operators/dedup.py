"""Messages delivered at least once, brought down to one copy each.

Identifiers are compared by exact value, not by hash. The arrivals of a batch are cut into a few waves by time and
folded to one per identifier and wave where they are read, so a message repeated a million times costs its shard a few
rows. Each shard has a dictionary of identifiers and a compressed bitmap of the codes already seen. The waves go through
it in their order: of each wave those arrivals are kept whose bit is not set, and then their bits are set. The new
bits and the new dictionary entries become visible together, by one rename.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.session import cut_lineage

ROWS_PER_SHARD, WAVES = 50_000, 16
_CHUNK = 1 << 16


class SeenBits:
    """A set of codes as compressed containers of 65,536 bits, each a bitmap or a sorted list of its members."""

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self._has = containers or {}

    @classmethod
    def loads(cls, blob: bytes | None) -> SeenBits:
        """The set of a blob that dumps() made; an empty set for none."""
        out: dict[int, np.ndarray] = {}
        data = zlib.decompress(blob) if blob else b""
        pos = 0
        while pos < len(data):
            high, size = np.frombuffer(data, dtype=np.int64, count=2, offset=pos)
            pos += 16
            if size < 0:
                out[int(high)] = np.unpackbits(np.frombuffer(data, np.uint8, _CHUNK // 8, pos)).astype(bool)
                pos += _CHUNK // 8
            else:
                bits = np.zeros(_CHUNK, dtype=bool)
                bits[np.frombuffer(data, np.uint16, size, pos)] = True
                out[int(high)], pos = bits, pos + 2 * int(size)
        return cls(out)

    def dumps(self) -> bytes:
        parts = []
        for high, bits in sorted(self._has.items()):
            members = np.flatnonzero(bits).astype(np.uint16)
            sparse = len(members) < _CHUNK // 16
            parts.append(np.array([high, len(members) if sparse else -1], dtype=np.int64).tobytes())
            parts.append(members.tobytes() if sparse else np.packbits(bits).tobytes())
        return zlib.compress(b"".join(parts))

    def contains(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes), dtype=bool)
        high = codes >> 16
        for h in np.unique(high):
            if (bits := self._has.get(int(h))) is not None:
                at = high == h
                out[at] = bits[codes[at] & (_CHUNK - 1)]
        return out

    def union(self, codes: np.ndarray) -> None:
        high = codes >> 16
        for h in np.unique(high):
            bits = self._has.setdefault(int(h), np.zeros(_CHUNK, dtype=bool))
            bits[codes[high == h] & (_CHUNK - 1)] = True

    def __len__(self) -> int:
        return int(sum(bits.sum() for bits in self._has.values()))


# ---- identity of a turn


def _tagged(value: Column, text: Column) -> Column:
    """The bytes of a recognised value, else those of the text; a first byte tells which."""
    return F.coalesce(F.concat(F.lit(b"\x01"), value), F.concat(F.lit(b"\x00"), F.encode(text, "UTF-8")), F.lit(b"\x02"))


def _sized(part: str) -> Column:
    """A part with its length in front, so that joined parts cannot be confused."""
    return F.concat(F.unhex(F.lpad(F.hex(F.length(part).cast("long")), 8, "0")), F.col(part))


def turn_identity(df: DataFrame, source: str = "source", session: str = "external_id", seq: str = "seq", digest: str = "content_hash") -> DataFrame:
    """The rows that have a source, a session and a seq, with column _ident: the exact identity of the turn as bytes.

    A UUID counts by its value however it is written (case, braces, urn:uuid:, without hyphens), a SHA-256
    likewise (case, prefix, base64); other spellings count by their trimmed text. Null hashes equal each other.
    """
    # Each step uses the expressions of the step before it once per column, so nothing is computed twice.
    known = df.where(F.col(source).isNotNull() & F.col(session).isNotNull() & F.col(seq).isNotNull())
    step = known.withColumns(
        {
            "_session": F.trim(session),
            "_digest": F.regexp_replace(F.trim(digest), r"^(?i:sha-?256[:=\-]|0x)\s*", ""),
            "_source": F.encode(F.col(source), "UTF-8"),
        }
    )
    step = step.withColumns({"_uuid": F.regexp_replace(F.lower("_session"), r"^urn:uuid:|[{}\-]", "")})
    base64 = F.try_to_binary(F.translate(F.rpad("_digest", 44, "="), "-_", "+/"), F.lit("base64"))
    step = step.withColumns(
        {
            "_session": _tagged(F.when(F.col("_uuid").rlike(r"^[0-9a-f]{32}\z"), F.unhex("_uuid")), F.col("_session")),
            "_digest": _tagged(
                F.when(F.col("_digest").rlike(r"^[0-9a-fA-F]{64}\z"), F.unhex("_digest")).when(F.col("_digest").rlike(r"^[A-Za-z0-9+/_\-]{43}=?\z"), base64), F.col("_digest")
            ),
        }
    )
    number = F.unhex(F.lpad(F.hex(F.col(seq).cast("long")), 16, "0"))
    return step.withColumn("_ident", F.concat(number, _sized("_source"), _sized("_session"), F.col("_digest"))).drop("_uuid", "_session", "_digest", "_source")


# ---- order of arrival as one number, so that the first arrival folds in a hash aggregate

_SHIFT, _BASE, _LATE = 2**63, 2 * 10**19, 4 * 10**18


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def _arrival(time: Column, key: Column) -> Column:
    """(time, key) as one decimal that sorts like the pair; a null time comes last."""
    us = F.coalesce(F.unix_micros(time), F.lit(_LATE)).cast("decimal(19,0)")
    return (us * _whole(_BASE).cast("decimal(20,0)") + (key.cast("decimal(20,0)") + _whole(_SHIFT))).cast("decimal(38,0)")


def _key_of(arrival: Column) -> Column:
    return (F.pmod(arrival, _whole(_BASE)) - _whole(_SHIFT)).cast("long")


# ---- the operator


class SeenStore:
    """Dictionaries and bitmaps of the identifiers seen so far, in a folder that all executors share.

    A batch writes its files first and then replaces the file that names the newest batch by a rename, so
    readers see a batch wholly or not at all and a batch that failed half-way leaves no trace but files
    nobody reads. One writer at a time. A batch reads the bitmaps of the shards it touches and the dictionary entries
    of its own identifiers; only these come to Python, so a shard's history may be of any size. The number of shards is
    fixed when the store is made; choose it for the largest batch to come, about 50,000 identifiers to a shard.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.shards, self._bits = 0, shards, {}
        current = jvm.org.apache.hadoop.fs.Path(self._root, "CURRENT")
        if self._fs.exists(current):
            said = json.loads(spark.read.text(f"{self.path}/CURRENT").first()[0])
            self.version, self.shards, self._bits = said["version"], said["shards"], {int(k): v for k, v in said["bits"].items()}

    def codes_of(self, arrivals: DataFrame) -> DataFrame:
        """arrivals (shard, ident, ...) with the code that each identifier has in its shard's dictionary, null for a new one."""
        if not self.version:
            return arrivals.withColumn("code", F.lit(None).cast("long"))
        words = self.spark.read.parquet(*(f"{self.path}/dictionary-{v}" for v in range(1, self.version + 1)))
        return arrivals.join(words.select("shard", "ident", "code"), ["shard", "ident"], "left")

    def bitmaps(self, shards: list[int]) -> DataFrame | None:
        """shard, bits, size (how many codes the shard has given out) of those of these shards that have any."""
        newest = [(s, self._bits[s]) for s in shards if s in self._bits]
        if not newest:
            return None
        # one folder for each shard, so the files of other shards are not opened
        return self.spark.read.parquet(*(f"{self.path}/bits-{v}/of={s}" for s, v in newest)).select("shard", "bits", "size")

    def commit(self, selected: DataFrame) -> None:
        """Writes the entries and bitmaps of a selection and makes them current."""
        version = self.version + 1
        rows = f"{self.path}/batch-{version}"
        selected.write.mode("overwrite").parquet(rows)
        written = self.spark.read.parquet(rows)
        written.where("bits IS NULL AND fresh").select("shard", "ident", "code").write.mode("overwrite").parquet(f"{self.path}/dictionary-{version}")
        touched = written.where("bits IS NOT NULL").select("shard", "bits", F.col("code").alias("size"), F.col("shard").alias("of"))
        touched.write.mode("overwrite").partitionBy("of").parquet(f"{self.path}/bits-{version}")
        bits = self._bits | {r.shard: version for r in touched.select("shard").collect()}
        jvm = self.spark.sparkContext._jvm
        draft, current = (jvm.org.apache.hadoop.fs.Path(self._root, n) for n in (f"CURRENT-{version}", "CURRENT"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "shards": self.shards, "bits": bits}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(draft, current, options)
        self.version, self._bits = version, bits

    def selection(self) -> DataFrame:
        """The selection of the newest batch."""
        return self.spark.read.parquet(f"{self.path}/batch-{self.version}")


_SELECTION = "shard int, ident binary, code long, kept long, fresh boolean, bits binary"


def _select(batch: pd.DataFrame, state: pd.DataFrame | None = None, remember: bool = True) -> pd.DataFrame:
    """The arrivals of one shard whose bit is not set when their wave comes, and one row with the shard's new bitmap.

    batch has ident, key, wave and the identifier's code where the dictionary has one; a wave has each identifier at most
    once. Identifiers are listed only where they are to be remembered. The bitmap's row has the number of codes as code.
    """
    shard = int(batch["shard"].iloc[0])
    has = state is not None and len(state) > 0
    seen = SeenBits.loads(state["bits"].iloc[0] if has else None)
    size = int(state["size"].iloc[0]) if has else 0
    batch = batch.sort_values(["wave", "key"], ignore_index=True)
    # Dictionary codes: those known, and the next free ones for new identifiers in order of arrival.
    local, idents = pd.factorize(batch["ident"].map(bytes))
    known = np.full(len(idents), -1, dtype=np.int64)
    if has:
        at = np.flatnonzero(batch["code"].notna())
        known[local[at]] = batch["code"].to_numpy()[at].astype(np.int64)
    fresh = known < 0
    known[fresh] = size + np.arange(int(fresh.sum()))
    codes, waves = known[local], batch["wave"].to_numpy()
    unseen = np.zeros(len(batch), dtype=bool)
    for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(waves)) + 1):
        unseen[rows] = ~seen.contains(codes[rows])
        seen.union(codes[rows[unseen[rows]]])
    chosen = {"shard": shard, "ident": batch["ident"] if remember else None, "code": codes, "kept": batch["key"], "fresh": fresh[local], "bits": None}
    chosen = pd.DataFrame(chosen, index=batch.index)[unseen]
    whole = pd.DataFrame({"shard": [shard], "ident": [None], "code": [size + int(fresh.sum())], "kept": [None], "fresh": [False], "bits": [seen.dumps()]})
    return pd.concat([chosen, whole], ignore_index=True) if len(chosen) else whole


Identity = Callable[[DataFrame], DataFrame]


def waves_of(batch: DataFrame, time: str, waves: int = WAVES) -> tuple[int, list[int]]:
    """How many rows a batch has, and the times (in microseconds) at which its second and later waves begin."""
    parts = F.array(*[F.lit(k / waves) for k in range(1, waves)])
    seen = batch.agg(F.count("*").alias("n"), F.percentile_approx(F.unix_micros(time), parts).alias("edges")).first()
    return seen["n"], sorted(set(seen["edges"] or []))


def select_unseen(batch: DataFrame, identity: Identity, time: str, key: str, shards: int, edges: list[int], store: SeenStore | None = None) -> DataFrame:
    """For each shard the first arrival of every identifier not seen yet, and one row with the shard's new bitmap.

    edges are the times at which the second and later waves begin; arrivals without a time are in the last wave of all.
    """
    us = F.unix_micros(F.col(time))
    wave = F.lit(0)
    for edge in edges:
        wave = wave + (us >= edge).cast("int")
    ids = (
        identity(batch)
        .where(F.col(key).isNotNull())
        .select(F.col("_ident").alias("ident"), F.coalesce(wave, F.lit(len(edges) + 1)).alias("wave"), _arrival(F.col(time), F.col(key)).alias("arrival"))
        .withColumn("shard", F.pmod(F.xxhash64("ident"), F.lit(shards)).cast("int"))
        .groupBy("shard", "ident", "wave")
        .agg(F.min("arrival").alias("arrival"))
        .select("shard", "ident", "wave", _key_of(F.col("arrival")).alias("key"))
    )
    if store is None:
        return ids.groupBy("shard").applyInPandas(lambda rows: _select(rows, remember=False), _SELECTION)
    coded = cut_lineage(store.codes_of(ids))
    state = store.bitmaps([r.shard for r in coded.select("shard").distinct().collect()])
    if state is None:
        return coded.groupBy("shard").applyInPandas(lambda rows: _select(rows), _SELECTION)
    return coded.groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(lambda rows, old: _select(rows, old), _SELECTION)


def shards_for(rows: int) -> int:
    return max(8, -(-rows // ROWS_PER_SHARD))


def kept_deliveries(batch: DataFrame, store: SeenStore | None = None, *, identity: Identity = turn_identity, time: str = "delivered_at", key: str = "delivery_id") -> DataFrame:
    """The key of the one delivery to keep of each message: the earliest, of equal times the smallest key.

    identity(batch) gives the rows that have one, with it in column _ident. With a store, messages kept in
    earlier batches are not kept again, and this batch is committed to it. A null time counts as the latest. A
    delivery without identity equals no other and is not listed here; deduplicate() keeps it. Rows without a
    key cannot be told apart and are left out too.
    """
    rows, edges = waves_of(batch, time)
    if store is None:
        chosen = select_unseen(batch, identity, time, key, shards_for(rows), edges)
    else:
        store.commit(select_unseen(batch, identity, time, key, store.shards, edges, store))
        chosen = store.selection()
    return chosen.where("bits IS NULL").select(F.col("kept").alias(key))


def redeliveries(batch: DataFrame, store: SeenStore | None = None, *, identity: Identity = turn_identity, time: str = "delivered_at", key: str = "delivery_id") -> DataFrame:
    """The key of every delivery of a message but the kept one. Fully repeated rows are one delivery."""
    return identity(batch).select(key).join(kept_deliveries(batch, store, identity=identity, time=time, key=key), key, "left_anti")


def deduplicate(batch: DataFrame, store: SeenStore | None = None, *, identity: Identity = turn_identity, time: str = "delivered_at", key: str = "delivery_id") -> DataFrame:
    """The rows of batch without redeliveries; rows without identity or key stay."""
    return batch.join(redeliveries(batch, store, identity=identity, time=time, key=key), key, "left_anti")
