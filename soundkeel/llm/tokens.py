"""Token ids in flat files, with a minimal perfect hash index over the documents.

``write`` sorts documents by key over range partitions; every task writes the ids of its
range to one shard file, two bytes an id where the vocabulary allows it, and a row per
document to a directory table.  Running sums over the shards give each its first position.

``build_index`` deals the keys to index partitions by hash.  A task builds the hash function of
its partition: level by level, keys that alone hit a bit set it, the others go on to
the next level; a key's slot is the rank of its bit.  Every slot stores a fingerprint of its
key, the shard, the offset and length in it, so a lookup takes a constant number of steps
and foreign keys are told apart.  A key may have several documents: they follow one another,
and their number in this shard and in all is stored with the first.
"""

from __future__ import annotations

import io
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from ..session import shared_dir
from .common import mixed, raw, stored
from .warc import file_system

KEYS_PER_PARTITION = 200_000
_GAMMA = 2.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


#: Space-separated words whose ids a worker remembers: half of them are those met last, the others those before.
MEMO_WORDS = 1_000_000
#: A space beside another white-space character: a token may reach over both.
_RUN = re.compile(r" (?:\s|(?<=\s ))")
#: Latin letters with ASCII marks behind them; and such words on lines of their own.
_PART = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+"
_PLAIN = re.compile(f"({_PART})([!-/:-@\\[-`{{-~]*)")
_LINES = re.compile(f"(?:{_PLAIN.pattern}\n)+{_PLAIN.pattern}")


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: the byte's own where it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Words(dict):
    """Ids (bytes) of words, each with the space before it, found as they are asked for.

    A byte-level pre-tokenizer takes a space and the letters behind it for one piece, marks behind letters for
    another, and a line feed between words for one.  Such words go to the merges alone, piece by piece; the rest through the
    whole library.
    """

    def __init__(self, tokenizer: Tokenizer, code: str):
        self.tokenizer, self.code, self.letters = tokenizer, code, _byte_letters()
        self.space, self.merges = self.letters[32], tokenizer.model.tokenize
        self.marks: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        # the whole library agrees that these are the pieces
        self.alone = True
        tried = ["été", "Wort.", "it's", "a'", "x###", "end.\nNext,", "a\nb\nc"]
        self.alone = all(self._split(x) in (None, self._packed(self._ids(" " + x))) for x in tried)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, text: str) -> bytes:
        written = text if text.isascii() and " " < text[0] else text.encode().decode("latin-1").translate(self.letters)
        return self._packed([t.id for t in self.merges(written)])

    def _mark(self, text: str) -> bytes:
        if text not in self.marks:
            self.marks[text] = self._piece(text)
        return self.marks[text]

    def _split(self, word: str) -> bytes | None:
        """Ids of a word of the known kinds."""
        if m := _PLAIN.fullmatch(word):
            return self[m[1]] + self._mark(m[2]) if m[2] else self._piece(" " + word)
        if "\n" in word and _LINES.fullmatch(word):
            first, *rest = word.split("\n")
            parts = [_PLAIN.fullmatch(x) for x in rest]
            return self[first] + b"".join(self._mark("\n") + self._piece(m[1]) + self._mark(m[2]) for m in parts)
        return None

    def __missing__(self, word: str) -> bytes:
        if (ids := self.before.get(word)) is not None:
            pass
        elif self.alone and word.isascii() and word.isalpha():
            ids = array(self.code, [t.id for t in self.merges(self.space + word)]).tobytes()
        else:
            ids = self._split(word) if self.alone else None
            ids = self._packed(self._ids(" " + word)) if ids is None else ids
        self[word] = ids
        return ids

    def turn(self) -> None:
        """The words met so far become those before; what is met again is taken from there."""
        self.before, self.marks = dict(self), {"": b""}
        self.clear()


class Encoder:
    """Ids of texts, with a memory of the words met.

    A byte-level tokenizer cuts a text before every space between two characters that are no white
    space, and never looks across such a cut.  So the ids of a text are those of its words, each with
    the space before it; texts with special tokens or a space beside other white space are encoded whole.
    """

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        if sys.byteorder != "little":
            raise RuntimeError("token files are little-endian")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.words = Words(self.tokenizer, {"<u2": "H", "<u4": "I"}[dtype])

    def _whole(self, text: str) -> bytes:
        return self.words._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > MEMO_WORDS // 2:
            self.words.turn()
        out, ids_of = [], self.words.__getitem__
        for t in texts:
            if _RUN.search(t) or any(s in t for s in self.special):
                out.append(self._whole(t))
            else:
                head, *rest = t.split(" ")
                out.append(self._whole(head) + b"".join(map(ids_of, rest)))
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, dtype: str) -> Encoder:
    """One encoder a worker, whose memory lasts over its tasks."""
    if (path, dtype) not in _ENCODERS:
        _ENCODERS[path, dtype] = Encoder(path, dtype)
    return _ENCODERS[path, dtype]


def key_text(key: Column) -> Column:
    """The text that is hashed for a key; null has one of its own."""
    return F.when(key.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), key.cast("string")))


def write(
    df: DataFrame, key: str, text: str, tokenizer: str, end_id: int, vocabulary: int = 50_257, shard_bytes: int = 24 << 20
) -> tuple[str, DataFrame]:
    """Writes the shards; returns their folder and the stored directory.

    Directory: shard, path, row, key, offset (ids before it in the shard), n_tokens.  Documents are
    in ascending key order (null first); equal keys by a hash of the text, then as
    met.  ``shard_bytes``: about the text that goes to a shard.  Null texts are empty: they hold
    the end id alone.
    """
    folder = shared_dir(df.sparkSession, "tokens")
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["key", F.xxhash64("text"), F.monotonically_increasing_id()]
    shards = rows.repartitionByRange(max(1, -(-size // shard_bytes)), *order).sortWithinPartitions("key", F.xxhash64("text"))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer, kind), TaskContext.get().partitionId()
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.ids"  # a retry writes another file; the directory names one
        out, row, offset = None, 0, 0
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            out = out or system.open_output_stream(f"{base}/{name}", compression=None)
            counts: list[int] = []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                for ids in enc.encode([x or "" for x in texts[at : at + 256]]):
                    out.write(ids + end)
                    counts.append(len(ids) // len(end) + 1)
            n = np.array(counts, np.int64)
            before = np.cumsum(n) - n + offset
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), pa.array([f"{folder}/{name}"] * len(n), pa.string()),
                 pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(before), pa.array(n)],
                ["shard", "path", "row", "key", "offset", "n_tokens"],
            )
            row, offset = row + len(n), offset + int(n.sum())
        if out is not None:
            out.close()

    schema = f"shard int, path string, row long, key {key_type}, offset long, n_tokens long"
    return folder, stored(shards.mapInArrow(run, schema), "tokens-directory")


def shard_table(directory: DataFrame) -> DataFrame:
    """(shard, path, ids, base): ids in the shard and ids before it; one row per shard file."""
    by = directory.groupBy("shard", "path").agg(F.sum("n_tokens").alias("ids"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return by.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def hashes(keys: Sequence[bytes]) -> np.ndarray:
    """(n, 2) 64-bit hashes of each key: one for the slots, one for the fingerprint."""
    out = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), ">u8").reshape(-1, 2)
    return out.astype(np.uint64)


def _place(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mixed(h[:, 0] + np.uint64((level + 1) * int(_STEP) & (1 << 64) - 1)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash function of distinct keys: levels of bits, a slot is a bit's rank."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            upto = np.cumsum(bits)
            self.ranks.append(total + upto - bits)
            total += int(upto[-1]) if len(upto) else 0
        self.size = total

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(h):
            n = max(8, int(_GAMMA * len(h)))
            at = _place(h, len(levels), n)
            bits = np.bincount(at, minlength=n) == 1
            levels.append(bits.astype(np.int64))
            h = h[~bits[at]]
            if len(levels) > 200:
                raise ValueError("equal keys in a perfect hash")
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that hit no bit."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = _place(h[left], level, len(bits))
            hit = bits[at] == 1
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> list[np.ndarray]:
        return [np.packbits(b.astype(np.uint8)) for b in self.levels]


ENTRY = np.dtype([("print", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n_tokens", "<i8"), ("row", "<i8"), ("here", "<i8"), ("runs", "<i4")])


def pack_index(h: np.ndarray, entries: np.ndarray) -> bytes:
    perfect = PerfectHash.build(h)
    slots = perfect.slots(h)
    table = np.zeros(len(h), ENTRY)
    entries["print"] = (h[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    table[slots] = entries
    out = io.BytesIO()
    np.savez(out, entries=table, sizes=np.array([len(x) for x in perfect.levels]), **{f"l{i}": x for i, x in enumerate(perfect.pack())})
    return out.getvalue()


class Index:
    """One index partition, loaded for lookups."""

    def __init__(self, data: bytes):
        z = np.load(io.BytesIO(data))
        self.entries = z["entries"]
        self.hash = PerfectHash([np.unpackbits(z[f"l{i}"])[:n].astype(np.int64) for i, n in enumerate(z["sizes"])])

    def find(self, keys: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the keys, and which of them the index knows."""
        h = hashes(keys)
        slots = self.hash.slots(h)
        if not len(self.entries):
            return np.zeros(len(h), ENTRY), np.zeros(len(h), bool)
        got = self.entries[np.maximum(slots, 0)]
        return got, (slots >= 0) & (got["print"] == (h[:, 1] & np.uint64(0xFFFFFFFF)))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows with a composite key text in ``k``, dealt to index partitions."""
    return rows.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))


def runs(directory: DataFrame) -> DataFrame:
    """One row per key and shard: its first document there and how many follow.

    ``k`` is the key's text with the number of the run (0 for its first shard).
    """
    by = directory.groupBy("key", "shard").agg(F.min(F.struct("row", "offset", "n_tokens")).alias("f"), F.count(F.lit(1)).alias("here"))
    w = Window.partitionBy("key")
    by = by.withColumn("run", F.row_number().over(w.orderBy("shard")) - 1).withColumn("runs", F.count(F.lit(1)).over(w))
    k = F.concat_ws("/", F.col("run").cast("string"), key_text(F.col("key")))
    return by.select(k.alias("k"), "shard", "f.*", "here", F.col("runs").cast("int").alias("runs"))


def build_index(directory: DataFrame, keys_per_partition: int = KEYS_PER_PARTITION) -> tuple[DataFrame, int]:
    """Index partitions (part, path, keys) as a stored table, and their number."""
    folder = shared_dir(directory.sparkSession, "tokens-index")
    rows = stored(runs(directory), "tokens-runs")
    parts = max(1, -(-rows.count() // keys_per_partition))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        out, part = [], t.column("part").to_numpy()
        for p in np.unique(part):
            x = t.filter(pa.array(part == p))
            h = hashes(raw(x.column("k").combine_chunks()))
            e = np.zeros(len(h), ENTRY)
            for c in ("shard", "offset", "n_tokens", "row", "here", "runs"):
                e[c] = x.column(c).to_numpy()
            name = f"index-{p:06d}-{uuid.uuid4().hex}.npz"
            with system.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(pack_index(h, e))
            out.append({"part": int(p), "path": f"{folder}/{name}", "keys": len(h)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("path", pa.string()), ("keys", pa.int64())]))

    dealt = _dealt(rows, parts).repartition(parts, "part")
    return stored(dealt.mapInArrow(run, "part int, path string, keys long"), "tokens-parts"), parts


def lookup(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Keyed access: adds the entry of each ``k`` (and known) from the index files.

    Keys travel to their partition's rows; a task opens an index file once for
    the keys of a batch.
    """
    asked = _dealt(keys, parts).join(index.select(F.col("part").alias("_p"), "path"), F.col("part") == F.col("_p")).drop("_p", "part")
    names = [c for c in ENTRY.names if c != "print"]
    types = {"shard": "int", "runs": "int"}
    schema = ", ".join([f"k string, key {keys.schema['key'].dataType.simpleString()}", *[f"{c} {types.get(c, 'long')}" for c in names], "known boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, Index] | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for path in t.column("path").unique().to_pylist():
                x = t.filter(pc.equal(t.column("path"), path))
                if opened is None or opened[0] != path:
                    system, name = file_system(path)
                    with system.open_input_file(name) as f:
                        opened = path, Index(f.read())
                ks = x.column("k").combine_chunks()
                e, known = opened[1].find(raw(ks))
                yield pa.RecordBatch.from_arrays(
                    [ks, x.column("key").combine_chunks(), *[pa.array(e[c]) for c in names], pa.array(known)], ["k", "key", *names, "known"]
                )

    return asked.select("k", "key", "path").sortWithinPartitions("path").mapInArrow(run, schema)


def find_documents(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """Where the documents of each ``key`` lie: a row per key and shard that has any.

    ``keys``: distinct keys in a column key.  Every key's first run tells how many there are.
    """
    first = keys.withColumn("k", F.concat_ws("/", F.lit("0"), key_text(F.col("key"))))
    found = stored(lookup(first, index, parts).filter("known"), "tokens-found")
    more = found.filter("runs > 1").select("key", F.explode(F.sequence(F.lit(1), F.col("runs") - 1)).alias("run"))
    more = more.select("key", F.concat_ws("/", F.col("run").cast("string"), key_text(F.col("key"))).alias("k"))
    return found.union(lookup(more, index, parts).filter("known"))


def read_documents(places: DataFrame, shards: DataFrame, directory: DataFrame, vocabulary: int = 50_257, end_id: int = 2) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the shard files.

    A place names the first of ``here`` documents that follow one another; where there are more,
    the end id of each closes it, told by the directory's lengths.
    """
    kind = "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    single = places.filter("here = 1").select("key", "shard", "offset", "n_tokens")
    follow = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("here") - 1)).alias("row")
    many = places.filter("here > 1").select("key", "shard", follow)
    many = many.join(directory.select("shard", "row", "offset", "n_tokens"), ["shard", "row"])
    rows = single.union(many.select("key", "shard", "offset", "n_tokens")).join(shards.select("shard", "path", "base"), "shard")
    key_type = places.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, opened = None, None
        width = np.dtype(kind).itemsize
        for batch in batches:
            crcs = []
            cols = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for offset, n, path in zip(*cols):
                if path != opened:
                    if file is not None:
                        file.close()
                    system, name = file_system(path)
                    file, opened = system.open_input_file(name), path
                ids = np.frombuffer(file.read_at(n * width, offset * width), dtype=kind)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
            start = pc.add(batch.column(5), batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), start, batch.column(3), pa.array(crcs, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"]
            )
        if file is not None:
            file.close()

    rows = rows.select("key", "shard", "offset", "n_tokens", "path", "base")
    block = F.floor(F.col("offset") / (8 << 20))
    rows = rows.repartition("shard", block).sortWithinPartitions("shard", "offset")
    return rows.mapInArrow(run, f"key {key_type}, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes all documents, indexes them, and reads every key's documents back through the index.

    Returns the key, start (ids of all documents before it), n_tokens and ids_crc32 of
    every document.
    """
    _, directory = write(df, key, text, tokenizer, end_id)
    shards = stored(shard_table(directory), "tokens-shards")
    index, parts = build_index(directory)
    keys = df.select(F.col(key).alias("key")).distinct()
    out = read_documents(find_documents(keys, index, parts), shards, directory)
    return out.withColumnRenamed("key", key)
