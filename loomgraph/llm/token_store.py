"""Token ids in wavelet-matrix shards: succinct bit-planes with rank and select in one compressed file per shard.

Texts are dealt out by ranges of doc_id and sorted, each task encodes its range and cuts it into shards of
whole documents. A shard is one row of a Parquet file: the sorted alphabet of its ids, one zstd-compressed
bit-plane per bit of the alphabet rank (highest first, stable partition by the bit), the number of zeros of
each plane, and the running count of ones per 512-bit block. ``Shard`` answers access, rank (count), select
(occurrence) and range decoding from that row alone.

Encoding is memoised per piece between single blanks. A byte-level vocabulary splits at each blank that
stands between two characters that are no white space, so ids equal those of the whole text; texts with
other blanks, or with the text of a special token, are encoded whole.

Defined results: a null text is an empty document, only the end id; null doc_ids come first; repeated ids
follow each other in the order of their texts' hashes; an empty table gives no shard. A shard is never
larger than ``shard_tokens`` and its last document.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialise
from .common import shuffle_parts

END_ID = 2
SHARD_TOKENS = 1 << 20
BLOCK = 512  # bits between two rank samples
MEMO = 200_000  # pieces, and words, in each of the two generations that a worker remembers
SHARD_SCHEMA = ("part int, seq int, n_tokens bigint, alphabet binary, zeros array<int>, planes array<binary>, ranks array<binary>, "
                "doc_ids array<bigint>, lengths array<int>")
# fixed values: white space of either regular-expression engine, and control characters on which they differ
UNSURE = r"\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff"
ODD = re.compile(f"[{UNSURE}] | [{UNSURE}]|^ | $")
RARE = re.compile("[" + UNSURE.replace(r"\x00-\x20", r"\x00-\x09\x0b-\x1f") + "]")
# letters of Latin alphabets, then stops: runs that the vocabulary takes as they are
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class PieceEncoder:
    """ids of a text as little-endian unsigned 32-bit bytes. Pieces between single blanks and the words in
    them are looked up; new words go to the library's model, other new pieces and odd texts through it whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.line_end = self.ids(["\n"])[0]
        self.pieces: dict[str, dict[str, bytes]] = {"": {}, " ": {}}
        self.runs: dict[str, bytes] = {}
        self.older = {"": {}, " ": {}, "runs": {}}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def run(self, run: str) -> bytes:
        """ids of one run that the vocabulary never splits before merging: letters, or stops, with its blank."""
        found = self.older["runs"].get(run)
        if found is None:
            coded = run if run.isascii() and run[0] != " " else run.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
        self.runs[run] = found
        return found

    def piece(self, piece: str, blank: str) -> bytes | None:
        """ids of a piece made of words with stops on lines; None for any other piece."""
        runs, out = self.runs, b""
        for k, line in enumerate(piece.split("\n")):
            match = PLAIN.fullmatch(line)
            if not match:
                return None
            word, stops = match.groups()
            if k:
                out += self.line_end
            else:
                word = blank + word
            out += runs.get(word) or self.run(word)
            if stops:
                out += runs.get(stops) or self.run(stops)
        return out

    def odd(self, text: str) -> bool:
        """Whether a blank may not be a boundary somewhere, or a special token's text occurs."""
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return True
        return bool(RARE.search(text) and ODD.search(text)) or any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.runs) > MEMO:
            self.older["runs"], self.runs = self.runs, {}
        for blank, memo in self.pieces.items():
            if len(memo) > MEMO:
                self.older[blank], self.pieces[blank] = memo, {}
        out, split, new = [b""] * len(texts), {}, {"": set(), " ": set()}
        for k, t in enumerate(texts):
            if not t:
                continue
            if self.odd(t):
                out[k] = self.ids([t])[0]
                continue
            head, *tail = split[k] = t.split(" ")
            new[""].add(head)
            new[" "].update(tail)
        for blank, memo in self.pieces.items():
            whole = []
            older = self.older[blank]
            for x in new[blank].difference(memo):
                found = older.get(x) or self.piece(x, blank)
                if found is None:
                    whole.append(x)
                else:
                    memo[x] = found
            memo.update(zip(whole, self.ids([blank + x for x in whole]), strict=True))
        first, rest = self.pieces[""], self.pieces[" "]
        for k, parts in split.items():
            out[k] = first[parts[0]] + b"".join(map(rest.__getitem__, parts[1:]))
        return out


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process: later tasks go on with what earlier ones have looked up."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
    import tokenizers

    held = tokenizers.__dict__.setdefault("_piece_encoders", {})
    if path not in held:
        held[path] = PieceEncoder(path)
    return held[path]


def build_planes(symbols: np.ndarray, bits: int):
    """Planes (packed bits), zeros per plane and sampled ranks of a sequence of symbols below 2**bits."""
    planes, zeros, ranks = [], [], []
    for level in range(bits - 1, -1, -1):
        bit = (symbols & symbols.dtype.type(1 << level)) != 0
        off = symbols.take(np.flatnonzero(~bit))
        packed = np.packbits(bit, bitorder="little")
        full = np.zeros(-(-len(bit) // BLOCK) * BLOCK // 8, np.uint8)
        full[:len(packed)] = packed
        counts = np.bitwise_count(full.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        planes.append(packed)
        zeros.append(len(off))
        ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4"))
        symbols = np.concatenate((off, symbols.take(np.flatnonzero(bit))))
    return planes, zeros, ranks


def pack_shard(ids: np.ndarray) -> dict:
    import zstandard

    seen = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    seen[ids] = True
    alphabet = np.flatnonzero(seen).astype("<u4")
    place = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    place[alphabet] = np.arange(len(alphabet))
    bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 1
    planes, zeros, ranks = build_planes(place[ids], bits)
    z = zstandard.ZstdCompressor(level=1)
    squeeze = lambda x: z.compress(x.tobytes())
    return {"n_tokens": len(ids), "alphabet": squeeze(np.diff(alphabet, prepend=0).astype("<u4")), "zeros": zeros, "planes": [squeeze(p) for p in planes], "ranks": [squeeze(r) for r in ranks]}


class Shard:
    """A shard read back: access, rank, select and decoding on its bit-planes."""

    def __init__(self, n_tokens: int, alphabet: bytes, zeros, planes, ranks):
        import zstandard

        z = zstandard.ZstdDecompressor()
        self.n = int(n_tokens)
        self.alphabet = np.cumsum(np.frombuffer(z.decompress(alphabet), "<u4"), dtype=np.uint32)
        self.zeros = [int(x) for x in zeros]
        self.planes = [np.frombuffer(z.decompress(p), np.uint8) for p in planes]
        self.ranks = [np.frombuffer(z.decompress(r), "<u4") for r in ranks]

    def ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = i // BLOCK
        rest = self.planes[level][block * BLOCK // 8:(i + 7) // 8]
        bits = np.unpackbits(rest, bitorder="little")[:i - block * BLOCK]
        return int(self.ranks[level][block]) + int(bits.sum())

    def bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3] >> (i & 7)) & 1

    def select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane: binary search over the samples."""
        samples = self.ranks[level]
        counts = samples if bit else np.arange(len(samples), dtype=np.int64) * BLOCK - samples
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(counts[block])])

    def access(self, i: int) -> int:
        symbol = 0
        for level, zeros in enumerate(self.zeros):
            one = self.bit(level, i)
            before = self.ones(level, i)
            i = zeros + before if one else i - before
            symbol = symbol << 1 | one
        return int(self.alphabet[symbol])

    def _walk(self, token: int, i: int):
        k = int(np.searchsorted(self.alphabet, token))
        if k >= len(self.alphabet) or self.alphabet[k] != token:
            return None
        low, path = 0, []
        for level, zeros in enumerate(self.zeros):
            one = k >> (len(self.zeros) - 1 - level) & 1
            a, b = self.ones(level, low), self.ones(level, i)
            low, i = (zeros + a, zeros + b) if one else (low - a, i - b)
            path.append((one, zeros))
        return low, i, path

    def rank(self, token: int, i: int) -> int:
        """How often a token occurs before position i."""
        walk = self._walk(token, i)
        return walk[1] - walk[0] if walk else 0

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token; -1 if there are not so many."""
        walk = self._walk(token, self.n)
        if walk is None or not 0 <= k < walk[1] - walk[0]:
            return -1
        i = walk[0] + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one, zeros = walk[2][level]
            i = self.select_bit(level, one, i - zeros if one else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the stable partitions are undone from the last plane to the first."""
        symbols = np.zeros(self.n, np.uint16 if len(self.zeros) <= 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], bitorder="little", count=self.n).view(bool)
            above = np.empty_like(symbols)
            zeros = self.zeros[level]
            above[np.flatnonzero(~bit)] = symbols[:zeros]
            above[np.flatnonzero(bit)] = symbols[zeros:] | symbols.dtype.type(1 << (len(self.zeros) - 1 - level))
            symbols = above
        return self.alphabet[symbols]


def shards_of(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row (SHARD_SCHEMA) per shard; (part, seq) is the order of the shards, that of ascending doc_id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = worker_encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, lengths, held, n = [], [], [], 0
        end = np.array([end_id], "<u4").tobytes()

        def shard() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, **pack_shard(np.frombuffer(b"".join(held), "<u4")), "doc_ids": ids, "lengths": lengths}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256).to_pydict()
                for key, coded in zip(some["doc_id"], encoder.encode(some["text"]), strict=True):
                    held.append(coded + end)
                    ids.append(key)
                    lengths.append(len(coded) // 4 + 1)
                    n += lengths[-1]
                    if n >= shard_tokens:
                        yield shard()
                        ids, lengths, held, n, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARD_SCHEMA))
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("th"))
    parts = rows.repartitionByRange(shuffle_parts(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "th").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th")
    return parts.select("doc_id", "text").mapInArrow(encode, SHARD_SCHEMA)


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the shards (one file per task) and return them as read back from the files.

    Without ``path`` they go to a folder of their own below the shared checkpoint folder."""
    shards = shards_of(docs, tokenizer, **options)
    if path is None:
        ensure_checkpoint_dir(docs.sparkSession)
        return materialise(shards)
    shards.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, first): ids of all shards before each one, by sums per part first."""
    per = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    local = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)).alias("local"))
    return local.join(base, "part").select("part", "seq", (F.col("base") + F.col("local")).alias("first"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(part, seq, doc_id, offset, n_tokens, ids_crc32) decoded from the bit-planes."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                raw = Shard(row.n_tokens, row.alphabet, row.zeros, row.planes, row.ranks).decode().astype("<u4").tobytes()
                lengths = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pd.DataFrame({"part": row.part, "seq": row.seq, "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"),
                                    "offset": ends - lengths, "n_tokens": lengths, "ids_crc32": crc})

    schema = "part int, seq int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint"
    return shards.mapInPandas(decode, schema)


def digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    shards = write_shards(docs, tokenizer, **options)
    starts = shard_starts(shards.select("part", "seq", "n_tokens"))
    rows = read_documents(shards).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
