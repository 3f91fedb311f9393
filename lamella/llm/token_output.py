"""Token ids as compressed binary documents.

Container: a Parquet table of blocks in ascending document order, written by Spark
(so a failed task leaves nothing behind, on any store). The column ``payload`` of a
block holds one zstandard frame for each document; ``frame_from`` is the offset index
into it, next to each document's id and token count. All frames share one dictionary,
trained on the serialised id arrays of a bounded sample; its hash stands in every
block, and a reader refuses a block of another dictionary. One document is read by
pruning blocks on their id range and inflating one frame.

Edge cases: a null text is empty and yields the end id alone; null ids come first,
equal ids stand in order of a hash of their text; an empty table gives an empty
container; other columns are ignored. The whole text is encoded, however long.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import batch, buffer, keyed, parts
from lamella.storage import shared_folder

#: The dictionary: trained on at most so many documents, of at most so many characters each, from so many partitions; its bytes.
TRAIN_DOCUMENTS, TRAIN_CHARS, TRAIN_PARTS, DICTIONARY_BYTES = 1000, 8192, 32, 32768
BLOCK_BYTES = 4 << 20
_YOUNG = 600_000
#: Encoders of this worker by tokenizer path; their caches serve all its tasks.
_ENCODERS: dict[str, CachedEncoder] = {}


#: What two neighbouring bytes say about a cut between them: none, sure, if the byte after them begins a character that is no white space,
#: if the line feed before is one of itself, and that the character before must be looked at.
_NONE, _CUT, _SPACE, _FEED, _LOOK = range(5)


def _pairs() -> tuple[np.ndarray, np.ndarray]:
    code = np.arange(256)
    letter = (code >= 65) & (code <= 90) | (code >= 97) & (code <= 122)
    sign = (code > 32) & (code < 127) & ~letter & ~((code >= 48) & (code <= 57))
    ascii_visible = (code > 32) & (code < 127)
    # Two-byte characters from U+00C0 on and the longer ones of these first bytes hold no white space.
    visible = ascii_visible | (code >= 0xC3) & (code <= 0xDF) | (code == 0xE0) | (code >= 0xE4) & (code <= 0xED) | (code >= 0xF0)
    out = np.full((256, 256), _NONE, np.uint8)
    out[np.ix_(letter, sign)] = _CUT
    out[np.ix_(sign & (code != 39), letter)] = _CUT
    out[ascii_visible, 10] = _CUT
    out[ascii_visible, 32] = _SPACE
    out[10, visible] = _FEED
    out[0x80:0xC0, sign | (code == 10) | (code == 32)] = _LOOK
    return out.ravel(), visible


_PAIRS, _VISIBLE = _pairs()


def unit_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the texts ``data[bounds[d]:bounds[d + 1]]`` may be cut: at these places a token of the byte-level pre-tokenizer's
    pattern begins, whatever stands around. They are: a text's start; a space between two characters that are no white space;
    a line feed after such a character, and such a character after that line feed; an ASCII sign after a letter; an ASCII letter after a sign
    that is no apostrophe (which may begin a contraction)."""
    n = len(data)
    new = np.zeros(n, bool)
    kind = _PAIRS[(data[:-1].astype(np.uint16) << 8) | data[1:]]
    new[1:] = kind == _CUT
    space = np.flatnonzero(kind == _SPACE) + 1
    look = np.flatnonzero(kind == _LOOK) + 1
    if len(look):
        last, two, three, here = data[look - 1], data[np.maximum(look - 2, 0)], data[np.maximum(look - 3, 0)], data[look]
        short = (two >= 0xC3) & (two <= 0xDF)
        seen = short | (two >= 0x80) & (two < 0xC0) & ((three == 0xE0) | (three >= 0xE4) & (three <= 0xED))
        latin = short & (two <= 0xC9) & ~((two == 0xC3) & ((last == 0x97) | (last == 0xB7)))
        new[look[np.where(here == 10, seen, latin & (here != 32))]] = True
        space = np.concatenate([space, look[seen & (here == 32)]])
    # A space that ends its text has nothing after it.
    ends = np.zeros(n + 1, bool)
    ends[bounds] = True
    space = space[~ends[space + 1]]
    new[space[_VISIBLE[data[space + 1]]]] = True
    new[bounds[bounds < n]] = True
    # Of several line feeds the last is a token of its own only beside what follows.
    feed = np.flatnonzero(kind == _FEED) + 1
    new[feed[new[feed - 1]]] = True
    return np.flatnonzero(new)


class CachedEncoder:
    """Encodes whole texts with a tokenizer of the tokenizers library, once for each distinct unit (see unit_starts).

    A text is cut only where a pre-token begins, so its ids are the ids of its units in order. Texts
    that hold the start of a special token, and all texts of a tokenizer of another pattern, are encoded whole.
    The cache keeps the units of the last generations only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = spec.get("pre_tokenizer") or {}
        self.units = not spec.get("normalizer") and pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern.get("add_prefix_space")
        self.special = [x["content"].encode() for x in spec.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # one character of a byte-level token is one byte
        self.wide = len(self.size) > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def plain(self, text: str) -> bytes:
        return self._every([text])[0]

    def _every(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, units: list[str], between: str) -> list[bytes]:
        """Ids of each unit, from one text of all of them; ``between`` stands before each and is one token, or empty where a unit has a space."""
        raw, width = self.plain(between + between.join(units)), self.kind.itemsize
        ends = np.cumsum(self.size[np.frombuffer(raw, self.kind)])
        lengths = pc.binary_length(pa.array(units)).to_numpy().astype(np.int64) + len(between)
        stop = np.searchsorted(ends, np.cumsum(lengths)) + 1
        start = np.concatenate([[0], stop[:-1]]) + len(between)
        return list(map(raw.__getitem__, map(slice, (start * width).tolist(), (stop * width).tolist())))

    def _learn(self, units: list[str]) -> None:
        spaced, bare, odd = [], [], []
        for u in units:
            body = u[1:] if u[0] == " " else u
            (odd if body.strip() != body or not body else spaced if body is not u else bare).append(u)
        if spaced:
            self.young.update(zip(spaced, self._together(spaced, ""), strict=True))
        if bare:
            self.young.update(zip(bare, self._together(bare, "\n"), strict=True))
        if odd:
            self.young.update(zip(odd, self._every(odd), strict=True))

    def _known(self, units: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        out = list(map(young.get, units))
        missing = [i for i, x in enumerate(out) if x is None]
        if old and missing:
            for i in missing:
                if (x := old.get(units[i])) is not None:
                    out[i] = young[units[i]] = x
            missing = [i for i in missing if out[i] is None]
        collecting = gc.isenabled()
        gc.disable()  # only strings are made here, of which the collector would look through all again and again
        for k in range(0, len(missing), 20_000):
            self._learn([units[i] for i in missing[k : k + 20_000]])
        if collecting:
            gc.enable()
        for i in missing:
            out[i] = young[units[i]]
        if len(young) > _YOUNG:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (a string column without nulls), as bytes."""
        if not self.units:
            return self._every(texts.to_pylist())
        data, bounds = buffer(texts)
        if not len(data):
            return [b""] * len(texts)
        starts = unit_starts(data, bounds)
        offsets = np.append(starts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        ids = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        # All ids by one gather: unit after unit, each a stretch of ``store``.
        store = np.frombuffer(b"".join(ids), self.kind)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.kind.itemsize
        codes = coded.indices.to_numpy()
        many = size[codes]
        stop = np.cumsum(many, dtype=np.int64)
        kind = np.int32 if stop[-1] < 1 << 31 and len(store) < 1 << 31 else np.int64
        move = ((np.cumsum(size, dtype=np.int64) - size)[codes] - stop + many).astype(kind)
        every = store[np.repeat(move, many) + np.arange(stop[-1], dtype=kind)].tobytes()
        cut = (np.concatenate([[0], stop])[np.searchsorted(starts, bounds)] * self.kind.itemsize).tolist()
        out = [every[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        if self.special:
            found = pc.match_substring_regex(texts, "|".join(re.escape(x.decode()) for x in self.special))
            for i in np.flatnonzero(found.to_numpy(zero_copy_only=False)).tolist():
                out[i] = self.plain(texts[i].as_py())
        return out


BLOCK = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("token_from", pa.int64()), ("n_tokens", pa.int64()), ("dict_sha256", pa.string()),
    ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("frame_from", pa.list_(pa.int64())), ("payload", pa.binary()),
])
BLOCK_DDL = "part int, seq int, token_from long, n_tokens long, dict_sha256 string, ids array<long>, counts array<long>, frame_from array<long>, payload binary"


def _texts(b: pa.RecordBatch, column: int, size: int = 16 << 20) -> Iterator[tuple[int, pa.Array]]:
    _, offsets = buffer(b.column(column))
    row = 0
    while row < b.num_rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, b.column(column).slice(row, stop - row)
        row = stop


def _encode(path: str, end_id: int, dictionary: bytes, level: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encoder = _ENCODERS.get(path) or _ENCODERS.setdefault(path, CachedEncoder(path))
        end = np.asarray([end_id], encoder.kind).tobytes()
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=True, write_checksum=True)
        sha, part = hashlib.sha256(dictionary).hexdigest(), TaskContext.get().partitionId()
        ids, counts, frames, size, seq, before = [], [], [], 0, 0, 0

        def block():
            start = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).astype(np.int64)
            return batch(BLOCK, [part], [seq], [before], [sum(counts)], [sha], [ids], [counts], pa.array([start], pa.list_(pa.int64())), [b"".join(frames)])

        for b in batches:
            rows = b.column(0).to_pylist()
            for row, texts in _texts(b, 1):
                for i, raw in enumerate(encoder.encode(texts), row):
                    raw += end
                    ids.append(rows[i])
                    counts.append(len(raw) // encoder.kind.itemsize)
                    frames.append(press.compress(raw))
                    size += len(frames[-1])
                    if size >= BLOCK_BYTES:
                        yield block()
                        before += sum(counts)
                        ids, counts, frames, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield block()

    return run


def _train(rows: DataFrame, path: str, end_id: int) -> bytes:
    """The dictionary: from at most TRAIN_DOCUMENTS whole documents of at most TRAIN_CHARS characters, the first such
    of at most TRAIN_PARTS partitions evenly spread over the table, so that no pass over all texts is needed. Documents of any length are compressed with it."""
    import zstandard

    some = rows.where(F.length("text") <= TRAIN_CHARS).select("text").rdd
    total = some.getNumPartitions()
    chosen = sorted({i * total // TRAIN_PARTS for i in range(TRAIN_PARTS)}) if total else []
    each = -(-TRAIN_DOCUMENTS // max(1, len(chosen)))
    texts = some.context.runJob(some, lambda part: [r.text for r in islice(part, each)], chosen) if chosen else []
    encoder = CachedEncoder(path)
    end = np.asarray([end_id], encoder.kind).tobytes()
    samples = [encoder.plain(t) + end for t in texts[:TRAIN_DOCUMENTS]]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:  # the samples are too much alike to train on
        return b""


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int = 0, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every document of ``docs`` into a container at ``out``; returns ``out``.

    ``tokenizer``: path of a byte-level tokenizer file that every executor can open.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    dictionary = _train(rows, tokenizer, end_id)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary), end_id)], "dict_sha256 string, dictionary binary, end_id int").coalesce(1).write.parquet(f"{out}/dictionary")
    # As many parts as the input has at least, so that a part grows no larger than what a task reads.
    ordered = rows.repartitionByRange(max(parts(spark), rows.rdd.getNumPartitions()), F.col("row_id").asc_nulls_first(), "key_h").sortWithinPartitions(F.col("row_id").asc_nulls_first(), "key_h")
    blocks = ordered.select("row_id", "text").mapInArrow(_encode(tokenizer, end_id, dictionary, level), BLOCK_DDL)
    blocks.write.option("compression", "none").parquet(f"{out}/blocks")
    return out


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(bytes(row.dictionary)).hexdigest() != row.dict_sha256:
        raise ValueError(f"{path}: the dictionary does not have the hash it was stored with")
    return row.dict_sha256, bytes(row.dictionary)


def _inflater(sha: str, dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdDecompressor(dict_data=shared)

    def inflate(block_sha: str, count: int, frame: bytes) -> np.ndarray:
        if block_sha != sha:
            raise ValueError(f"a block needs dictionary {block_sha}, the container has {sha}")
        raw = press.decompress(frame)
        return np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4").astype("<u4")

    return inflate


def _summaries(sha: str, dictionary: bytes) -> Callable:
    schema = pa.schema([("part", pa.int32()), ("row_id", pa.int64()), ("token_from", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = _inflater(sha, dictionary)
        for b in batches:
            for i in range(b.num_rows):
                part, _, start, _, own, ids, counts, frame_from, payload = (b.column(k)[i].as_py() for k in range(9))
                crc, size = [], []
                for c, s, e in zip(counts, frame_from, frame_from[1:], strict=False):
                    crc.append(zlib.crc32(inflate(own, c, payload[s:e]).tobytes()))
                    size.append(e - s)
                froms = start + np.cumsum([0, *counts])[:-1]
                yield batch(schema, np.full(len(ids), part, np.int32), ids, froms, counts, crc, size)

    return run


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_bytes) of every document, from the stored frames."""
    sha, dictionary = _dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks") if _exists(spark, f"{path}/blocks") else None
    # One row for each written part, as many as there are partitions.
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    done = blocks.select(*BLOCK.names).mapInArrow(_summaries(sha, dictionary), "part int, row_id long, token_from long, n_tokens long, ids_crc32 long, n_bytes long")
    return done.join(offsets, "part").select(F.col("row_id").alias("doc_id"), (F.col("token_from") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "n_bytes")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """Ids of the documents of that id, inflating no other document."""
    sha, dictionary = _dictionary(spark, path)
    inflate = _inflater(sha, dictionary)
    hit = spark.read.parquet(f"{path}/blocks").where(F.array_contains("ids", F.lit(doc_id).cast("long")))
    cut = F.transform(F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.element_at("ids", (i + 1).cast("int")) == doc_id), lambda i: F.struct(
        F.element_at("counts", (i + 1).cast("int")).alias("n"),
        F.expr("payload").substr(F.element_at("frame_from", (i + 1).cast("int")).cast("int") + 1, (F.element_at("frame_from", (i + 2).cast("int")) - F.element_at("frame_from", (i + 1).cast("int"))).cast("int")).alias("frame"),
    ))
    return [inflate(r.dict_sha256, f.n, bytes(f.frame)).tolist() for r in hit.select("part", "seq", "dict_sha256", cut.alias("frames")).orderBy("part", "seq").collect() for f in r.frames]


def new_container(spark: SparkSession) -> str:
    """A fresh place for a container in the shared folder."""
    return f"{shared_folder(spark)}/lamella/tokens-{uuid.uuid4().hex}"
