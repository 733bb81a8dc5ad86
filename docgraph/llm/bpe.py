"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

A task splits texts into pieces, looks each piece up among those it has met, and
encodes the new ones together: the symbols of all pieces lie in one flat array,
every pair of neighbours is looked up by binary search among the sorted pair
keys, and in each round every piece merges all places of its lowest-rank pair.
The rounds go on with the pieces that still hold a known pair.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import text_parts

#: The piece pattern of byte-level BPE vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.int64(1) << 40
#: Pieces that a task keeps encoded.
ROOM = 150_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """The vocabulary of a byte-level BPE file, and what has been encoded with it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        letters, vocab = byte_letters(), content["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in content["added_tokens"]) or content["normalizer"]:
            raise ValueError("only plain added tokens and no normalizer are known here")
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        self.size = np.int64(size)
        self.take_merges(vocab, merges)
        self.pattern = regex.compile(PIECES)
        lengths = np.array([len(b) for b in self.bytes_of])
        self.byte_starts = np.concatenate([[0], np.cumsum(lengths)])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.forget()

    def take_merges(self, vocab: dict[str, int], merges: list) -> None:
        """Sorts the pairs by their key, for binary search."""
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = order.astype(np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.pair_made = made[order]
        rank_of = {int(t): r for r, t in enumerate(made)}
        late = any(rank_of.get(vocab[x], -1) > r for r, pair in enumerate(merges) for x in pair)
        if late or len(rank_of) < len(merges):
            raise ValueError("a merge comes before the merges of its parts; merging all places at once would differ")

    def forget(self) -> None:
        """Empties the store of encoded pieces, but for the added tokens."""
        self.place = Places((i,) for i in self.special.values())
        self.tokens = np.array([*self.special.values()], np.uint32)
        self.starts = np.arange(len(self.tokens) + 1)

    def ranked(self, symbols: np.ndarray, piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pairs that begin at places ``at``; ``NONE`` where there is no such merge."""
        after = np.minimum(at + 1, len(symbols) - 1)
        keys = symbols[at] * self.size + symbols[after]
        found = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        hit = (self.pair_keys[found] == keys) & (piece[at] == piece[after]) & (after > at)
        return np.where(hit, self.pair_ranks[found], NONE), self.pair_made[found]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in one array, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        return self.merged(symbols, np.repeat(np.arange(len(pieces)), lengths), len(pieces))

    def merged(self, symbols: np.ndarray, piece: np.ndarray, n_pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for first symbols and the ascending numbers of their pieces; ``symbols`` is used up."""
        rank, made = self.ranked(symbols, piece, np.arange(len(symbols)))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            live = best != NONE
            ended.append((piece[~live], symbols[~live]))
            here = np.flatnonzero((rank == best) & live)
            # Of overlapping places (as in a run of one letter) every second one merges, from the left.
            fresh = np.ones(len(here), bool)
            fresh[1:] = np.diff(here) != 1
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(here)), 0))
            here = here[(np.arange(len(here)) - run_start) % 2 == 0]
            symbols[here] = made[here]
            stale = np.zeros(len(symbols), bool)
            stale[here] = True
            stale[np.maximum(here - 1, 0)] = True
            live[here + 1] = False
            symbols, piece, rank, made, stale = symbols[live], piece[live], rank[live], made[live], stale[live]
            at = np.flatnonzero(stale)
            if len(at):
                rank[at], made[at] = self.ranked(symbols, piece, at)
        of, tokens = (np.concatenate(x) for x in zip(*ended)) if ended else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return tokens[np.argsort(of, kind="stable")].astype(np.uint32), np.bincount(of, minlength=n_pieces)

    def learn(self) -> None:
        """Encodes the pieces that have got a place since the last time."""
        new = self.place.new
        parts, counts = [self.tokens], [np.diff(self.starts)]
        for i in range(0, len(new), 50_000):
            tokens, n = self.encode_pieces([p.encode() for p in new[i : i + 50_000]])
            parts.append(tokens)
            counts.append(n)
        self.place.new = []
        self.tokens = np.concatenate(parts)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; strings of added tokens get their own ids."""
        if len(self.place) > ROOM:
            self.forget()
        places = [np.fromiter(map(self.place.__getitem__, part), np.int64, len(part)) for part in map(self.parts, texts)]
        self.learn()
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        counts = np.diff(self.starts)[at]
        tokens = self.tokens[ranges(self.starts[at], counts)]
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)]
        return [tokens[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def parts(self, text: str) -> list:
        """Pieces of a text; an added token is the tuple of its id."""
        if self.special_pattern is None or not self.special_pattern.search(text):
            return self.pattern.findall(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.pattern.findall(text[at : m.start()])
            out.append((self.special[m[0]],))
            at = m.end()
        return out + self.pattern.findall(text[at:])

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Text of each list of ids; bytes that are no UTF-8 become U+FFFD."""
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        counts = np.diff(self.byte_starts)[flat]
        data = self.all_bytes[ranges(self.byte_starts[flat], counts)].tobytes()
        ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Places(dict):
    """Numbers for pieces in the order in which they are first asked for."""

    def __init__(self, first):
        super().__init__((p, i) for i, p in enumerate(first))
        self.new: list[str] = []

    def __missing__(self, piece):
        value = self[piece] = len(self)
        self.new.append(piece)
        return value


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


@lru_cache(2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of an installed public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Bytes encoded together.
BATCH_BYTES = 1_000_000


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids`` (array), ``ids_sha256``, ``decoded_sha256``.

    ``ids`` is left out when ``with_ids`` is false.  A null text is encoded as an
    empty one: no tokens.  The decoded text is made from the ids.  Rows are taken
    as they come, so repeated rows and null ids stay; other columns are not read.
    """
    import hashlib

    where = path or vocabulary()

    def run(batches):
        bpe = loaded(where)
        for batch in batches:
            for ids, texts in text_parts(batch, BATCH_BYTES):
                tokens = bpe.encode(texts)
                decoded = bpe.decode(tokens)
                columns = {
                    "id": ids,
                    "n_tokens": pa.array([len(t) for t in tokens], pa.int64()),
                    "ids_sha256": [hashlib.sha256(t.astype("<u4").tobytes()).hexdigest() for t in tokens],
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in decoded],
                }
                if with_ids:
                    columns["ids"] = pa.array([t.astype(np.int32) for t in tokens], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return named.mapInArrow(run, schema).withColumnRenamed("id", id_col)
