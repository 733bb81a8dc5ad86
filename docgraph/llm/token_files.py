"""Token files: static range asymmetric numeral system (rANS) with shared frequencies.

A file set has three Parquet tables, so any storage Spark reaches can hold it:
``frequencies`` (one row per used token), ``blocks`` (one row per block, with its
payload) and ``documents`` (the place of each document).

A block is a run of whole documents of one shard, in the order of their ids.  Its
ids are dealt over ``LANES`` interleaved coder states: id i belongs to lane
i mod LANES.  Every lane codes with the same frequency table; a decoder needs
nothing but the block's row.  After every ``STEPS`` ids per lane there is a
checkpoint, the states and the place in the stream, from which decoding can begin;
a CRC-32 covers the payload and another one the ids.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docgraph.llm.bpe import ByteBpe, Places, byte_letters, ranges
from docgraph.llm.common import stored, text_parts
from docgraph.session import shared_dir

LANES = 1_024
#: Steps between checkpoints.
STEPS = 128
#: Ids at which a block is closed.
BLOCK_IDS = 1 << 18
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
END_ID = 2


def quantised(counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Used ids, ascending, and frequencies of at least one that add up to 2 ** SCALE_BITS."""
    ids = np.array(sorted(counts), np.int64)
    spare = (1 << SCALE_BITS) - len(ids)
    if spare < 0:
        raise ValueError("more ids than the frequency scale can tell apart")
    if not len(ids):
        return ids, ids
    n = np.array([counts[i] for i in ids.tolist()], np.float64)
    freq = 1 + np.floor(n / n.sum() * spare).astype(np.int64)
    freq[n.argmax()] += (1 << SCALE_BITS) - freq.sum()
    return ids, freq


class Coder:
    def __init__(self, ids: np.ndarray, freq: np.ndarray):
        self.ids = ids.astype(np.uint32)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.of_slot = np.repeat(np.arange(len(ids)), freq)
        self.place = np.full(int(ids.max(initial=0)) + 1, -1, np.int64)
        self.place[ids] = np.arange(len(ids))

    def encode(self, ids: np.ndarray) -> dict:
        """States, stream and checkpoints of a block."""
        n = len(ids)
        steps = -(-n // LANES)
        at = self.place[ids]
        state = np.full(LANES, LOW, np.uint64)
        chunks, sizes, marks = [], 0, []
        shift = np.uint64(63 - SCALE_BITS)
        for step in range(steps - 1, -1, -1):
            some = at[step * LANES : (step + 1) * LANES]
            x = state[: len(some)]
            f = self.freq[some]
            full = x >= (f << shift)
            if full.any():
                out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
                chunks.append(out)
                sizes += len(out)
                x = np.where(full, x >> WORD_BITS, x)
            high = x // f
            state[: len(some)] = (high << np.uint64(SCALE_BITS)) + (x - high * f) + self.start[some]
            if step % STEPS == 0:
                marks.append((step, sizes, state.copy()))
        stream = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
        marks = marks[::-1]
        payload = stream.tobytes()
        states = np.concatenate([m[2] for m in marks]).astype("<u8").tobytes() if marks else b""
        # The word at which a checkpoint goes on: words written before it come after it.
        places = np.array([sizes - m[1] for m in marks], "<i8").tobytes()
        return {"payload": payload, "states": states, "places": places, "payload_crc": zlib.crc32(states, zlib.crc32(payload)), "ids_crc": zlib.crc32(ids.astype("<u4").tobytes())}

    def decode(self, block: dict, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids [first * STEPS * LANES, ...) of a block, by its checkpoints ``first`` up to ``last``; all by default."""
        if zlib.crc32(block["states"], zlib.crc32(block["payload"])) != block["payload_crc"]:
            raise ValueError(f"checksum of block {block['shard']}:{block['number']} does not match")
        n = block["n_ids"]
        stream = np.frombuffer(block["payload"], "<u4").astype(np.uint64)
        states = np.frombuffer(block["states"], "<u8").reshape(-1, LANES)
        places = np.frombuffer(block["places"], "<i8")
        last = len(places) if last is None else last
        out = []
        mask = np.uint64((1 << SCALE_BITS) - 1)
        if first >= last:
            return np.zeros(0, np.uint32)
        state, at = states[first].copy(), int(places[first])
        for step in range(first * STEPS, min(last * STEPS, -(-n // LANES))):
            size = min(LANES, n - step * LANES)
            x = state[:size]
            slot = x & mask
            symbol = self.of_slot[slot]
            out.append(self.ids[symbol])
            x = self.freq[symbol] * (x >> np.uint64(SCALE_BITS)) + slot - self.start[symbol]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << WORD_BITS) | stream[at : at + len(low)]
            at += len(low)
            state[:size] = x
        return np.concatenate(out)


@lru_cache(2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: Words whose ids a Python worker keeps, about 200 bytes each.
ROOM = 700_000
#: Characters of them.
ROOM_CHARS = 20_000_000


LAST_LATIN = "\u024f"
#: Its lower case is two characters.
DOTTED_I = "\u0130"


# What comes before the model in the vocabularies that ``WordEncoder`` knows.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRE_TOKENIZERS = ["Split", "ByteLevel"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Marks whose run after letters is a piece of its own; an apostrophe may begin an ending, and the others an added token.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>")
IS_MARK = np.zeros(256, bool)
IS_MARK[[ord(c) for c in MARKS]] = True


def latin(word: str) -> bytes | None:
    """The lower case of Latin letters in normal form, marks after them included; None for other words."""
    core = word.rstrip(MARKS)
    if not core.isalpha() or max(core) > LAST_LATIN or DOTTED_I in core or not is_normalized("NFC", core):
        return None
    return word.lower().encode()


class WordMerges(ByteBpe):
    """The merges of a vocabulary whose last symbol of a piece has a suffix."""

    def __init__(self, content: dict):
        model = content["model"]
        kinds = [n["type"] for n in content["normalizer"]["normalizers"]], [p["type"] for p in content["pre_tokenizer"]["pretokenizers"]]
        split = content["pre_tokenizer"]["pretokenizers"][0]
        if kinds != (NORMALIZERS, PRE_TOKENIZERS) or split["pattern"]["Regex"] != SPLIT or not model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError("another normalizer, pre-tokenizer or model than is known here")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = np.int64(1 + max(vocab.values()))
        self.byte_id, self.last_id = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, b in byte_letters().items():
            self.byte_id[b], self.last_id[b] = vocab[letter], vocab[letter + suffix]
        self.take_merges(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])

    def encode_words(self, code: np.ndarray, lengths: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words, whose bytes lie one after the other, and how many each has.

        The last ``tails`` bytes of a word are marks; after letters they are a piece of their own.
        """
        last = np.cumsum(lengths) - 1
        two = (tails > 0) & (tails < lengths)
        end = np.zeros(len(code), bool)
        end[last] = True
        end[(last - tails)[two]] = True
        symbols = np.where(end, self.last_id[code], self.byte_id[code])
        tokens, counts = self.merged(symbols, np.cumsum(end) - end, int(end.sum()))
        return tokens, np.add.reduceat(counts, np.cumsum(1 + two) - 1 - two) if len(lengths) else counts


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space: the ids of a text are those of its words.

    Each new word is encoded once: those of Latin letters with marks after them, a piece
    of their own, by batched merge rounds, all others by the library.  Texts are then put
    together from the stored ids.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        with open(path, encoding="utf-8") as file:
            self.merges = WordMerges(json.load(file))
        self.forget()

    def forget(self) -> None:
        self.place = Places([])
        self.tokens = np.zeros(0, np.uint32)
        self.starts = self.counts = np.zeros(0, np.int64)
        self.held = 0

    def keep(self, places: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        """Stores the tokens of the words of some places."""
        self.counts[places] = counts
        self.starts[places] = len(self.tokens) + np.cumsum(counts) - counts
        self.tokens = np.concatenate([self.tokens, tokens]).astype(np.uint32)

    def learn(self) -> None:
        new, self.place.new = self.place.new, []
        first = len(self.counts)
        self.starts, self.counts = (np.append(x, np.zeros(len(new), np.int64)) for x in (self.starts, self.counts))
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        self.held += int(lengths.sum())
        plain = np.fromiter(map(str.isascii, new), bool, len(new)) & (lengths > 0)
        at = np.flatnonzero(plain)
        code = np.frombuffer("".join([new[i] for i in at.tolist()]).lower().encode(), np.uint8)
        if len(at):
            size = lengths[at]
            ends = np.cumsum(size)
            starts = np.cumsum(size) - size
            letter = (code >= ord("a")) & (code <= ord("z"))
            letters = np.add.reduceat(letter, starts, dtype=np.int64)
            marks = np.add.reduceat(IS_MARK[code], starts, dtype=np.int64)
            last = np.maximum.reduceat(np.where(letter, np.arange(len(code)), -1), starts)
            easy = (letters + marks == size) & ((letters == 0) | (last - starts + 1 == letters))
            self.keep(first + at[easy], *self.merges.encode_words(code[np.repeat(easy, size)], size[easy], marks[easy]))
            plain[at[~easy]] = False
        rest = np.flatnonzero(~plain & (lengths > 0)).tolist()
        accented = [(i, core) for i in rest if (core := latin(new[i]))]
        if accented:
            cores = [core for _, core in accented]
            sizes = np.fromiter(map(len, cores), np.int64, len(cores))
            of = np.array([i for i, _ in accented])
            code = np.frombuffer(b"".join(cores), np.uint8)
            marks = np.add.reduceat(IS_MARK[code], np.cumsum(sizes) - sizes, dtype=np.int64)
            self.keep(first + of, *self.merges.encode_words(code, sizes, marks))
        known = {i for i, _ in accented}
        slow = [i for i in rest if i not in known]
        # The library's results are large; a few thousand words at a time keep them few.
        for a in range(0, len(slow), 4_096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in slow[a : a + 4_096]], add_special_tokens=False)]
            self.keep(first + np.array(slow[a : a + 4_096]), np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.place) > ROOM or self.held > ROOM_CHARS:
            self.forget()
        places = []
        for text in texts:
            words = text.replace("\n", " ").split(" ")
            places.append(np.fromiter(map(self.place.__getitem__, words), np.int64, len(words)))
        self.learn()
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        counts = self.counts[at]
        tokens = self.tokens[ranges(self.starts[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, places)])]
        return [tokens[a:b] for a, b in zip(ends[:-1], ends[1:])]


@lru_cache(1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a Python worker."""
    return WordEncoder(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_rows(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """id and ids (binary, unsigned integers of ``width(path)``) with the end id.

    The first row of every part also has the ids of the part with their counts, so that
    the shared frequencies need no second pass over all ids.
    """
    kind = width(path)

    def run(batches):
        encoder = word_encoder(path)
        end = np.array([END_ID], kind).tobytes()
        for batch in batches:
            for ids, texts in text_parts(batch, 1_000_000):
                tokens = encoder.encode(texts)
                met = np.bincount(np.concatenate([*tokens, np.full(len(tokens), END_ID, np.uint32)]))
                used = np.flatnonzero(met)
                rest = [None] * (len(tokens) - 1)
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "ids": pa.array([t.astype(kind).tobytes() + end for t in tokens], pa.binary()),
                    "met": pa.array([used, *rest], pa.list_(pa.int64())), "times": pa.array([met[used], *rest], pa.list_(pa.int64())),
                })

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, ids binary, met array<long>, times array<long>")


def width(path: str) -> str:
    """The narrowest unsigned integers that hold the ids of a vocabulary."""
    return "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def as_ids(value, kind: str) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


BLOCK = "shard long, number long, n_ids long, documents binary, lengths binary, payload binary, states binary, places binary, payload_crc long, ids_crc long"
NO_ID = np.iinfo(np.int64).min


def blocks_of(symbols: np.ndarray, freq: np.ndarray, kind: str):
    """Blocks of one shard, which is one sorted partition."""

    def run(batches):
        coder = Coder(symbols, freq)
        shard, number = TaskContext.get().partitionId(), 0
        docs, parts, size = [], [], 0

        def block():
            ids = np.concatenate(parts)
            row = {"shard": shard, "number": number, "n_ids": len(ids), "documents": np.array(docs, "<i8").tobytes(), "lengths": np.array([len(p) for p in parts], "<i8").tobytes()} | coder.encode(ids)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

        for batch in batches:
            for i, ids in zip(batch["id"].to_pylist(), batch["ids"]):
                docs.append(NO_ID if i is None else i)
                parts.append(as_ids(ids, kind))
                size += len(parts[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    number += 1
                    docs, parts, size = [], [], 0
        if parts:
            yield block()

    return run


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, shard_rows: int = 8_192) -> None:
    """Encodes ``docs`` in ascending order of id into a file set at ``path``.

    Shards are ranges of ids of about ``shard_rows`` documents.  Null ids come first;
    a null or empty text is the end id alone; rows of one id lie side by side, in the
    order of a hash of their token ids.  An empty table gives a file set without blocks.
    Other columns are not read.
    """
    spark = docs.sparkSession
    where = vocabulary_path or vocabulary()
    kind = width(where)
    tokens = stored(token_rows(docs, id_col, text_col, where).withColumn("no", F.monotonically_increasing_id()), "tokens")
    listed = tokens.where("met IS NOT NULL").select(F.explode(F.arrays_zip("met", "times")).alias("c")).select("c.met", "c.times")
    counts = listed.groupBy(F.col("met").alias("token")).agg(F.sum("times").alias("n"))
    symbols, freq = quantised({r["token"]: r["n"] for r in counts.collect()})  # at most one row for each id of the vocabulary
    table = spark.createDataFrame([(int(s), int(f)) for s, f in zip(symbols, freq)], "token long, freq long")
    table.coalesce(1).write.parquet(f"{path}/frequencies")
    shards = max(1, -(-tokens.count() // shard_rows))
    # The number of a partition by range is the rank of its ids among the partitions.
    # Equal rows are told apart by number, so that many of them are not one partition.
    placed = tokens.select("id", "ids", F.xxhash64("ids").alias("h"), "no")
    ordered = placed.repartitionByRange(shards, "id", "h", "no").sortWithinPartitions("id", "h", "ids", "no").select("id", "ids")
    ordered.mapInArrow(blocks_of(symbols, freq, kind), BLOCK).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, decoded from the files: id, ``n_tokens``, ``ids_crc32``, its ``shard`` and ``block``, the ids ``before`` it in the block, and ``ids``."""
    table = spark.read.schema("token long, freq long").parquet(f"{path}/frequencies").orderBy("token").collect()
    symbols, freq = np.array([r["token"] for r in table], np.int64), np.array([r["freq"] for r in table], np.int64)

    def run(batches):
        coder = Coder(symbols, freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(row)
                if zlib.crc32(ids.astype("<u4").tobytes()) != row["ids_crc"]:
                    raise ValueError(f"ids of block {row['shard']}:{row['number']} do not match their checksum")
                docs, lengths = np.frombuffer(row["documents"], "<i8"), np.frombuffer(row["lengths"], "<i8")
                pieces = np.split(ids, np.cumsum(lengths)[:-1])
                columns = {
                    "id": pa.array([None if d == NO_ID else d for d in docs.tolist()], pa.int64()), "n_tokens": pa.array(lengths),
                    "ids_crc32": pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in pieces], pa.int64()),
                    "shard": pa.array([row["shard"]] * len(docs), pa.int64()), "block": pa.array([row["number"]] * len(docs), pa.int64()), "before": pa.array(np.cumsum(lengths) - lengths),
                }
                if with_ids:
                    columns["ids"] = pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, "id long, n_tokens long, ids_crc32 long, shard long, block long, before long" + ", ids array<int>" * with_ids)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, block and ``block_start``: the ids of all blocks before it."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks").select("shard", F.col("number").alias("block"), "n_ids")
    by_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = by_shard.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("in_shard", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return placed.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("block_start"))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes ``docs`` to a new file set in the shared folder and returns, read back from it: id, ``start``, ``n_tokens``, ``ids_crc32``."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, id_col, text_col)
    found = read(spark, path, with_ids=False).join(block_starts(spark, path), ["shard", "block"])
    return found.select(F.col("id").alias(id_col), (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
