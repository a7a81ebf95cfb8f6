"""Token ids in a binary file format coded by a static range asymmetric numeral system (rANS).

Texts are tokenised once, into a stored table that also holds each task's token counts; the counts of all documents
give one shared frequency table. The ids are then put in doc_id order by range, and each range is written as one file
of independent blocks. Inside a block, `lanes` coders take turns, so both directions run as numpy operations over all
blocks and lanes of a file. A block's entry in the index is a checkpoint (first token, first word, start states) and
a checksum, so blocks can be decoded on their own, in parallel or in part.

File (little-endian): HEADER; doc ids i8[docs]; null flags u1[docs]; lengths u4[docs]; INDEX[blocks]; crc32 of all that;
states u8[blocks, lanes]; words u4; a final line feed. Files are written and read through Spark (text writer,
binaryFile source), so any store will do.

Defined cases: a null text is empty; every document ends with `end`; null ids stand first; rows that repeat an id stand
in the order of a hash of their tokens; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept, maybe_broadcast, pieces, release, shared_path, ship, split_words, stored

MAGIC = 0x53_4E_41_52  # "RANS"
HEADER = np.dtype([("magic", "<u4"), ("version", "<u4"), ("scale", "<u4"), ("lanes", "<u4"), ("table", "<u4"), ("ordinal", "<u4"), ("docs", "<u8"), ("tokens", "<u8"), ("blocks", "<u4"), ("words", "<u8")])
INDEX = np.dtype([("tokens", "<u4"), ("words", "<u4"), ("first_token", "<u8"), ("first_word", "<u8"), ("crc", "<u4")])
LOW = np.uint64(1 << 31)
#: Id that ends every document, tokens of a block, coders of a block, tokens of a file.
END, BLOCK, LANES, FILE_TOKENS = 2, 1 << 15, 32, 1_000_000
#: Chunks of text that a worker remembers with their ids; chunks that are encoded together.
CACHE, TOGETHER = 450_000, 1_000
#: Chunks of printable ASCII and Latin-1 letters: lower-casing and composing keep their length, and they hold no special token.
PLAIN = re.compile(rb"(?:[!-;=-~]|<(?!\|)|\xc2[\xa1-\xbf]|\xc3[\x80-\xbf])+")
PRINTABLE = bytes(range(0x21, 0x7F))


class ChunkCache:
    """Tokenises texts chunk by chunk and looks up what was seen before, if white space ends every token and is dropped.

    For other tokenizers texts are encoded as they are.
    """

    def __init__(self, path: str, most: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        # In a byte-level vocabulary a token's characters, but for the mark of a word's end, stand for one byte each.
        self.token_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for t, i in vocabulary.items():
            self.token_bytes[i] = len(t.removesuffix("</w>"))
        alone = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        #: Whether chunks can be encoded on their own.
        self.by_chunk = all(alone(t) == [i for c in t.split() for i in alone(c)] for t in ("a b", " Ab,\tc. \n\nd-e\x0b\x0c\r f", "é \u00fc, \u65e5 \u0301x"))
        #: Whether the tokenizer maps ASCII capitals to small letters itself.
        self.lower = [e.ids for e in self.run(["AZ"], add_special_tokens=False)] == [e.ids for e in self.run(["az"], add_special_tokens=False)]
        self.index: dict[bytes, int] = {}
        self.ids, self.ends, self.uses = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self, chunks: list[bytes]) -> np.ndarray:
        """Encode and remember new chunks; returns their numbers."""
        plain, single = [], []
        for a in range(0, len(chunks), TOGETHER):
            group = chunks[a : a + TOGETHER]
            if (text := b"".join(group)).isascii() and b"<|" not in text and not text.translate(None, PRINTABLE) and all(group):
                plain += range(a, a + len(group))
                continue
            for i, c in enumerate(group, a):
                (plain if PLAIN.fullmatch(c) else single).append(i)
        joined = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
        order, ids, sizes = [], [], []
        for group, e in zip(joined, self.run([b"\n".join([chunks[i] for i in g]).decode() for g in joined], add_special_tokens=False), strict=True):
            got = np.array(e.ids, np.uint32)
            upto = np.cumsum(self.token_bytes[got])
            want = np.cumsum([len(chunks[i]) for i in group])
            cuts = np.searchsorted(upto, want) + 1
            if not len(upto) or cuts[-1] != len(got) or (upto[cuts - 1] != want).any():
                single += group  # not a byte-level vocabulary of this kind
                continue
            order += group
            ids.append(got)
            sizes.append(np.diff(cuts, prepend=0))
        found = [e.ids for e in self.run([chunks[i].decode("utf-8", "replace") for i in single], add_special_tokens=False)]
        order += single
        ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        flat, ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
        n = len(self.index)
        at = int(self.ends[n - 1]) if n else 0
        self._room(n + len(chunks), at + len(flat))
        self.ids[at : at + len(flat)], self.ends[n : n + len(chunks)], self.uses[n : n + len(chunks)] = flat, at + ends, 0
        self.index.update(zip([chunks[i] for i in order], range(n, n + len(chunks)), strict=True))
        numbers = np.empty(len(chunks), np.int64)
        numbers[order] = np.arange(n, n + len(chunks))
        return numbers

    def _room(self, chunks: int, ids: int) -> None:
        while len(self.ends) < chunks:
            self.ends, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.uses))
        while len(self.ids) < ids:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])

    def forget(self) -> None:
        """Keep the chunks that were seen more than once since the last time; if they are too many, none."""
        n = len(self.index)
        kept = np.flatnonzero(self.uses[:n] > 1)
        if len(kept) > self.most // 2:
            kept = kept[:0]
        ends = self.ends[:n]
        sizes = np.diff(ends, prepend=0)[kept]
        upto = np.cumsum(sizes)
        ids = self.ids[np.repeat(ends[kept] - upto, sizes) + np.arange(sizes.sum())]
        keep = np.zeros(n, bool)
        keep[kept] = True
        place = np.cumsum(keep) - 1
        self.index = {c: int(place[i]) for c, i in self.index.items() if keep[i]}
        self.ids, self.ends, self.uses = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self._room(len(kept), len(ids))
        self.ids[: len(ids)], self.ends[: len(kept)] = ids, upto

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has. Null is empty."""
        if len(self.index) > self.most:
            self.forget()
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            found = [e.ids for e in self.run(texts.to_pylist(), add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if self.lower:  # ASCII texts may be lower-cased first, as the tokenizer does it anyway: there are fewer chunks
            plain = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
            texts = pc.if_else(plain, pc.ascii_lower(texts), texts)
        codes, chunks, per_text = split_words(texts, lower=False)
        chunks = chunks.tolist()
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            at[new] = self.learn([chunks[i] for i in new])
        self.uses[at] += np.bincount(codes, minlength=len(at)).astype(np.int32)
        ends = self.ends[at]
        starts = np.where(at > 0, self.ends[at - 1], 0)
        starts, sizes = starts[codes], (ends - starts)[codes]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        flat = self.ids[np.repeat(starts - upto + sizes, sizes) + np.arange(total)]
        bounds = np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(per_text)])]
        return flat, np.diff(bounds)


_caches: dict[str, ChunkCache] = kept()


def cache_for(path: str, most: int = CACHE) -> ChunkCache:
    if path not in _caches or _caches[path].most != most:
        _caches[path] = ChunkCache(path, most)
    return _caches[path]


def tokenise(docs: DataFrame, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text", remember: int = CACHE) -> DataFrame:
    """Stored table of (doc_id, ids) rows and of (token, count) rows. ids: zstd-compressed, unsigned 32 bits each.

    remember: chunks that a worker keeps; fewer take less memory and more time.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        cache, pack = cache_for(tokenizer, remember), zstandard.ZstdCompressor(level=1).compress
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for b in pieces(batch, 1, 2 << 20):
                flat, sizes = cache.encode(b.column(1))
                seen = np.bincount(flat, minlength=len(counts))
                counts = np.pad(counts, (0, len(seen) - len(counts))) + seen
                counts[end] += len(sizes)
                wide = 2 if len(counts) <= 1 << 16 else 4
                raw, cuts = flat.astype(f"<u{wide}").tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * wide
                ids = [bytes([wide]) + pack(raw[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                none = pa.nulls(b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), none, none], names=["doc_id", "ids", "token", "count"])
        used = np.flatnonzero(counts)
        none = pa.nulls(len(used))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used), pa.array(counts[used])], names=["doc_id", "ids", "token", "count"])
        release()

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return stored(slim.mapInArrow(run, "doc_id long, ids binary, token long, count long"), "ids")


class Table:
    """Frequencies scaled to 2**scale, each at least 1. tokens: ids that occur, ascending."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray, scale: int) -> None:
        self.tokens, self.freq, self.scale = tokens.astype(np.uint32), freq.astype(np.uint64), scale
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.number = np.zeros(int(self.tokens.max(initial=0)) + 1, np.uint32)
        self.number[self.tokens] = np.arange(len(self.tokens))
        self.crc = zlib.crc32(self.freq.tobytes(), zlib.crc32(self.tokens.tobytes()))

    @classmethod
    def fit(cls, tokens: np.ndarray, counts: np.ndarray) -> Table:
        scale = max(16, int(len(tokens)).bit_length() + 4)
        exact = counts / counts.sum() * (1 << scale)
        freq = np.maximum(1, np.floor(exact)).astype(np.int64)
        over = int(freq.sum()) - (1 << scale)
        # What is missing goes to, and what is too much comes from, the most frequent tokens; they can spare it.
        order = np.argsort(-freq, kind="stable")
        while over:
            step = np.clip(over, -len(order), len(order))
            some = order[freq[order] > 1][: abs(step)] if over > 0 else order[: abs(step)]
            freq[some] -= np.sign(over)
            over = int(freq.sum()) - (1 << scale)
        return cls(tokens, freq, scale)

    def to_bytes(self) -> bytes:
        body = np.array([self.scale, len(self.tokens)], "<u4").tobytes() + self.tokens.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        return body + np.array([zlib.crc32(body)], "<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        scale, n = np.frombuffer(raw, "<u4", 2).tolist()
        body = 8 + 8 * n
        if zlib.crc32(raw[:body]) != np.frombuffer(raw, "<u4", 1, body)[0]:
            raise ValueError("the frequency table is damaged")
        return cls(np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, "<u4", n, 8 + 4 * n), scale)


def _encode(symbols: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """symbols [blocks, steps, lanes] -> states [blocks, lanes], words of all blocks, words per block."""
    blocks, steps, lanes = symbols.shape
    scale, room = np.uint64(table.scale), np.uint64(63 - table.scale)
    x = np.full((blocks, lanes), LOW)
    words, counts = [], np.zeros((steps, blocks), np.int64)
    for t in range(steps - 1, -1, -1):
        s = symbols[:, t, :]
        f = table.freq.take(s, mode="clip")
        full = x >= (f << room)
        counts[t] = full.sum(1)
        words.append(x[full].astype(np.uint32))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        x = (q << scale) + (x - q * f) + table.start.take(s, mode="clip")
    # Words were made last step first; a block's words stand together, in the order in which they are read.
    made = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    block = np.repeat(np.tile(np.arange(blocks, dtype=np.int32), steps), counts.ravel())
    return x, made[np.argsort(block, kind="stable")], counts.sum(0)


def _decode(states: np.ndarray, words: np.ndarray, first: np.ndarray, steps: int, table: Table, slots: np.ndarray) -> np.ndarray:
    """The reverse: symbols [blocks, steps, lanes]."""
    blocks, lanes = states.shape
    x, at = states.astype(np.uint64), first.astype(np.int64).copy()
    scale, mask, wide = np.uint64(table.scale), np.uint64((1 << table.scale) - 1), np.uint64(32)
    out = np.empty((blocks, steps, lanes), np.uint32)
    for t in range(steps):
        low = x & mask
        s = slots.take(low.view(np.int64), mode="clip")
        out[:, t, :] = s
        x = table.freq.take(s, mode="clip") * (x >> scale) + low - table.start.take(s, mode="clip")
        need = x < LOW
        rank = np.cumsum(need, axis=1)
        x[need] = (x[need] << wide) | words[(at[:, None] + rank - 1)[need]]
        at += rank[:, -1]
    return out


def pack_file(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, table: Table, ordinal: int, block: int = BLOCK, lanes: int = LANES) -> bytes:
    """One file of the format, without its final line feed."""
    symbols = table.number[ids]
    whole, rest = divmod(len(symbols), block)
    parts = [_encode(symbols[: whole * block].reshape(whole, block // lanes, lanes), table)] if whole else []
    if rest:
        last = np.zeros((1, -(-rest // lanes), lanes), np.uint32)  # what is over is coded as the first symbol
        last.reshape(-1)[:rest] = symbols[whole * block :]
        parts.append(_encode(last, table))
    states, words, per_block = (np.concatenate([p[i] for p in parts]) if parts else np.zeros((0, lanes) if not i else 0, np.uint64) for i in range(3))
    words = words.astype("<u4")
    index = np.zeros(len(states), INDEX)
    index["tokens"] = [block] * whole + [rest] * bool(rest)
    index["words"], index["first_word"] = per_block, np.cumsum(per_block) - per_block
    index["first_token"] = np.arange(len(states)) * block
    for i, (a, n) in enumerate(zip(index["first_word"].tolist(), index["words"].tolist(), strict=True)):
        index["crc"][i] = zlib.crc32(words[a : a + n].tobytes(), zlib.crc32(states[i].astype("<u8").tobytes()))
    header = np.array([(MAGIC, 1, table.scale, lanes, table.crc, ordinal, len(doc_ids), len(ids), len(states), len(words))], HEADER)
    nulls = np.array([d is None for d in doc_ids], "u1")
    head = header.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + nulls.tobytes() + sizes.astype("<u4").tobytes() + index.tobytes()
    return head + np.array([zlib.crc32(head)], "<u4").tobytes() + states.astype("<u8").tobytes() + words.tobytes()


class TokenFile:
    """Reads a file; blocks(first, last) decodes a part from its checkpoints."""

    def __init__(self, raw: bytes, table: Table) -> None:
        self.table, self.head = table, np.frombuffer(raw, HEADER, 1)[0]
        if self.head["magic"] != MAGIC or self.head["table"] != table.crc:
            raise ValueError("not a token file of this frequency table")
        docs, blocks, lanes = (int(self.head[k]) for k in ("docs", "blocks", "lanes"))
        at = HEADER.itemsize
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.nulls = np.frombuffer(raw, "u1", docs, at + 8 * docs).astype(bool)
        self.sizes = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
        self.index = np.frombuffer(raw, INDEX, blocks, at + 13 * docs)
        at += 13 * docs + INDEX.itemsize * blocks
        if zlib.crc32(raw[:at]) != np.frombuffer(raw, "<u4", 1, at)[0]:
            raise ValueError("the file's index is damaged")
        self.states = np.frombuffer(raw, "<u8", blocks * lanes, at + 4).reshape(blocks, lanes)
        self.words = np.frombuffer(raw, "<u4", int(self.head["words"]), at + 4 + 8 * blocks * lanes)
        self.slots = np.repeat(np.arange(len(table.tokens), dtype=np.uint32), table.freq.astype(np.int64))

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks from first to last (exclusive), after their checksums are checked."""
        last = len(self.index) if last is None else last
        lanes, out = self.states.shape[1], []
        for i in range(first, last):
            a, n = int(self.index["first_word"][i]), int(self.index["words"][i])
            if zlib.crc32(self.words[a : a + n].tobytes(), zlib.crc32(self.states[i].tobytes())) != self.index["crc"][i]:
                raise ValueError(f"block {i} is damaged")
        while first < last:  # blocks of one length are decoded together
            n = int(self.index["tokens"][first])
            upto = first + 1
            while upto < last and self.index["tokens"][upto] == n:
                upto += 1
            symbols = _decode(self.states[first:upto], self.words, self.index["first_word"][first:upto], -(-n // lanes), self.table, self.slots)
            out.append(self.table.tokens[symbols.reshape(upto - first, -1)[:, :n].ravel()])
            first = upto
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, key: str = "doc_id", text: str = "text", remember: int = CACHE) -> int:
    """Write the files (path/files) and the shared table (path/table). Returns how many tokens there are."""
    spark = docs.sparkSession
    table_rows = tokenise(docs, tokenizer, end, key, text, remember)
    # One row per token id at most, so the driver's share is bounded by the vocabulary.
    found = table_rows.where("token is not null").groupBy("token").agg(F.sum("count").alias("count")).orderBy("token").toArrow()
    tokens, counts = found.column(0).to_numpy(), found.column(1).to_numpy()
    if not len(tokens):
        tokens, counts = np.array([end]), np.array([1])
    table, total = Table.fit(tokens, counts), int(counts.sum())
    raw = table.to_bytes()
    # From Arrow, as a list of rows would go through Python workers of their own, which then stay.
    spark.createDataFrame(pa.table({"b": pa.array([raw], pa.binary())})).select(F.col("b").cast("string")).write.text(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, own = zstandard.ZstdDecompressor().decompress, Table.from_bytes(raw)
        doc_ids, flat, sizes = [], [], []
        for b in batches:
            doc_ids += b.column(0).to_pylist()
            for x in b.column(1).to_pylist():
                ids = np.frombuffer(unpack(x[1:]), f"<u{x[0]}").astype(np.uint32) if len(x) > 1 else np.zeros(0, np.uint32)
                flat += [ids, np.array([end], np.uint32)]
                sizes.append(len(ids) + 1)
        if doc_ids:
            ordinal = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([pack_file(doc_ids, np.array(sizes), np.concatenate(flat), own, ordinal)], pa.binary())], names=["file"])
            del flat
            release()

    files = max(1, -(-total // FILE_TOKENS))
    # Rows of one id, and equal rows, are cut as well, so that no id is bound to one file.
    by = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("number").asc()]
    rows = table_rows.where("ids is not null").select("doc_id", "ids", F.xxhash64("ids").alias("hash"), F.monotonically_increasing_id().alias("number"))
    ordered = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).select("doc_id", "ids")
    ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string")).write.option("lineSep", "\n").text(f"{path}/files")
    return total


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(ordinal, place, doc_id, start_in_file, n_tokens, ids_crc32[, ids]) of every document in the files."""
    ship(spark)
    raw = bytes(spark.read.format("binaryFile").load(f"{path}/table/part-*").where("length > 0").first()["content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.from_bytes(raw)
        for b in batches:
            for content in b.column(0):
                if not content.as_buffer().size:
                    continue
                f = TokenFile(content.as_py(), table)
                ids = f.blocks().astype("<u4")
                if len(ids) != int(f.sizes.sum()):
                    raise ValueError("the file's lengths don't agree")
                cuts = np.concatenate([[0], np.cumsum(f.sizes, dtype=np.int64)])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                n = len(f.doc_ids)
                columns = [pa.array(np.full(n, int(f.head["ordinal"]))), pa.array(np.arange(n)), pa.array(f.doc_ids, mask=f.nulls), pa.array(cuts[:-1]), pa.array(f.sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release()

    schema = "ordinal long, place long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    contents = spark.read.format("binaryFile").load(f"{path}/files/part-*").select("content")
    return contents.mapInArrow(run, schema)


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, key: str = "doc_id", text: str = "text", remember: int = CACHE) -> DataFrame:
    """Write docs to path (default: a fresh shared folder), read the files back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, key=key, text=text, remember=remember)
    read = stored(read_tokens(spark, path), "read")
    files = file_starts(stored(read.groupBy("ordinal").agg(F.sum("n_tokens").alias("n")), "files"))
    return read.join(maybe_broadcast(files), "ordinal").select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def file_starts(files: DataFrame, together: int = 4096) -> DataFrame:
    """(ordinal, base): tokens of all files before, from (ordinal, n); files are summed `together` at a time first."""
    grouped = files.withColumn("group", F.floor(F.col("ordinal") / together))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(Window.orderBy("group")).alias("above"))
    within = grouped.withColumn("inside", before(Window.partitionBy("group").orderBy("ordinal")))
    return within.join(maybe_broadcast(groups), "group").select("ordinal", (F.col("above") + F.col("inside")).alias("base"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents written and read back."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
