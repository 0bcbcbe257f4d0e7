"""Byte-level BPE: trained on distributed word counts, frozen behind a digest, applied to each document where it is."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.functions.shared import new_dir
from corpusloom.functions.shipping import ship

#: Ids of the special tokens; bytes have 0 to 255, merges follow the specials.
SPECIALS = {"<pad>": 256, "<eos>": 257, "<user>": 258, "<assistant>": 259}
FIRST_MERGE = 260


class TokenizerIntegrityError(RuntimeError):
    """A frozen tokenizer is not what its lock says."""


@dataclass(frozen=True)
class Tokenizer:
    merges: tuple[tuple[int, int], ...]

    def as_dict(self) -> dict:
        return {"merges": [list(m) for m in self.merges], "pretokenizer": T.PRETOKEN, "specials": SPECIALS}

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    @property
    def vocabulary(self) -> int:
        return FIRST_MERGE + len(self.merges)

    def ranks(self) -> dict[tuple[int, int], int]:
        return {m: i for i, m in enumerate(self.merges)}

    def pieces(self) -> list[bytes]:
        out = [bytes([i]) for i in range(256)] + [b""] * len(SPECIALS)
        for a, b in self.merges:
            out.append(out[a] + out[b])
        return out


def encode_word(word: bytes, ranks: dict[tuple[int, int], int]) -> list[int]:
    """Merge the pair of the lowest rank, everywhere, until no pair has one."""
    ids = list(word)
    while len(ids) > 1:
        rank, pair = min((ranks.get(p, len(ranks)), p) for p in zip(ids, ids[1:]))
        if rank == len(ranks):
            break
        ids = _replace(ids, pair, FIRST_MERGE + rank)
    return ids


def _replace(ids: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, i = [], 0
    while i < len(ids):
        if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
            out.append(new)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


#: What the pre-tokenizer's pattern makes of each byte (0 white space, 1 a letter, 2 a digit, 3 another); bytes of text that are split together.
_KINDS = np.array([0 if i in b" \t\n\x0b\f\r" else 1 if chr(i).isalpha() and i < 128 else 2 if i in b"0123456789" else 3 for i in range(256)], np.uint8)
PIECE = 8 << 20


def split_words(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where words begin in the bytes of texts that begin at the bounds: what PRETOKEN finds in each text.

    Runs of one kind, digits each alone; a white run that is one space goes to the word after it.
    """
    kinds, first = _KINDS[data], np.zeros(len(data) + 1, bool)
    first[bounds] = True
    first = first[:-1]
    starts = (kinds == 2) | first
    starts[1:] |= kinds[1:] != kinds[:-1]
    starts[1:] &= ~(starts[:-1] & (data[:-1] == 32) & (kinds[1:] != 0) & ~first[1:])
    return np.flatnonzero(starts)


def _pieces(texts: pa.Array):
    """start, end, bytes, bounds of pieces of a binary array of texts without nulls: whole texts of PIECE bytes and a text at most."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = min(len(texts), max(start + 1, int(np.searchsorted(at, at[start] + PIECE))))
        yield start, end, held[at[start] : at[end]], at[start : end + 1] - at[start]
        start = end


def _distinct(data: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, binary, and each word's place among them."""
    ends = np.append(starts, len(data)).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy()


def word_counts(docs: DataFrame, text: str = "content") -> DataFrame:
    """word, n. Texts are split where they are; a row for each word of a piece of text is what meets."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for _, _, data, bounds in _pieces(b.column(0)):
                words, which = _distinct(data, split_words(data, bounds))
                yield pa.RecordBatch.from_arrays([words.view(pa.string()), pa.array(np.bincount(which, minlength=len(words)), pa.int64())], names=["word", "n"])

    return docs.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(words: DataFrame) -> DataFrame:
    """left, right, n: adjacent byte pairs of words, weighted: the first round of training."""
    raw = F.col("word").cast("binary")
    at = F.sequence(F.lit(1), F.octet_length(raw) - 1)
    paired = words.where(F.octet_length(raw) > 1).select("n", F.explode(F.transform(at, lambda i: F.hex(F.substring(raw, i, F.lit(2))))).alias("pair"))
    return paired.groupBy("pair").agg(F.sum("n").cast("long").alias("n"))


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of places in a row the first, third and so on: a merge's overlapping pairs."""
    if not (np.diff(hit) == 1).any():
        return hit
    at = np.arange(len(hit))
    return hit[(at - np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, at, 0))) % 2 == 0]


class Block:
    """Words as one array of ids, with -1 before the first and after each, and how often each is there. A merge is made in all of them at once."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.ids, self.n = ids, n

    @classmethod
    def of(cls, words: pa.Array, n: pa.Array, n_merges: int) -> Block:
        """words: binary. Words without two bytes have no pair."""
        held = pc.greater(pc.binary_length(words), 1)
        words, n = words.filter(held).cast(pa.large_binary()), n.filter(held)
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        ids = np.full(at[-1] - at[0] + len(words) + 1, -1, np.int16 if FIRST_MERGE + n_merges < 2**15 else np.int32)
        inside = np.ones(len(ids), bool)
        inside[at - at[0] + np.arange(len(at))] = False
        if len(words):
            ids[inside] = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
        return cls(ids, n.to_numpy(zero_copy_only=False).astype(np.int64))

    @staticmethod
    def _summed(*places: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.concatenate([c for c, _ in places])
        found, which = np.unique(codes, return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, which, np.concatenate([n for _, n in places]))
        return found[sums != 0], sums[sums != 0]

    def _pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that begin at the places, as left * 2**32 + right, and the counts of their words."""
        at = at[(self.ids[at] >= 0) & (self.ids[at + 1] >= 0)]
        return (self.ids[at].astype(np.int64) << 32) | self.ids[at + 1], self.n[np.searchsorted(np.flatnonzero(self.ids < 0)[1:], at)]

    def pairs(self, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Each pair once, and its count."""
        parts = [self._summed(self._pairs(np.arange(i, min(i + step, len(self.ids) - 1)))) for i in range(0, len(self.ids) - 1, step)]
        return self._summed(*parts) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def merge(self, pair: tuple[int, int], new: int) -> tuple[np.ndarray, np.ndarray]:
        """Put new in the pair's place, of overlapping ones in the first; returns the pairs whose counts change, and by how much."""
        hit = np.flatnonzero((self.ids[:-1] == pair[0]) & (self.ids[1:] == pair[1]))
        if pair[0] == pair[1]:
            hit = _apart(hit)
        if not len(hit):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, n = self._pairs(np.unique(np.concatenate([hit - 1, hit, hit + 1])))
        kept = np.ones(len(self.ids), bool)
        kept[hit + 1] = False
        self.ids[hit] = new
        self.ids = self.ids[kept]
        hit = hit - np.arange(len(hit))  # each one before it has lost a place
        return self._summed((codes, -n), self._pairs(np.unique(np.concatenate([hit - 1, hit]))))


def _changed(counts: dict[tuple[int, int], int], codes: np.ndarray, sums: np.ndarray) -> None:
    for code, n in zip(codes.tolist(), sums.tolist()):
        pair = (code >> 32, code & 0xFFFFFFFF)
        counts[pair] = counts.get(pair, 0) + n
        if not counts[pair]:
            del counts[pair]


def next_merges(counts: dict[tuple[int, int], int], most: int) -> list[tuple[int, int]]:
    """The next merge, and those that follow it whatever it does to other pairs.

    A merge of (a, b) leaves all pairs as they are but (x, a) and (b, y), which may lose; a pair with the new id stands where one of
    these stood, so no more often. A pair is next for certain if it is none of these and its count is above theirs. After (a, a)
    nothing is certain.
    """
    ranked = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    out: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    for i, (pair, n) in enumerate(ranked):
        if len(out) == most or n < 1:
            break
        if out and (out[-1][0] == out[-1][1] or n <= next((m for (x, y), m in islice(ranked, i, None) if y in lefts or x in rights), 0)):
            break
        out.append(pair)
        lefts.add(pair[0])
        rights.add(pair[1])
    return out


def train(words: DataFrame, n_merges: int, least: int = 1, limit: int = 2_000_000) -> Tokenizer:
    """Merges by count, ties by the smaller pair. Words counted less than `least` are left out; more than limit words stay distributed.

    The words are counted once, into the shared folder.
    """
    words = _stored(words.where(F.col("n") >= least).select(F.col("word").cast("binary").alias("word"), F.col("n").cast("long").alias("n")), "words")
    if words.count() > limit:
        return _train_distributed(words, n_merges)
    held = words.toArrow()
    block = Block.of(*(pa.concat_arrays([x.cast(t) for x in held[c].chunks]) if held.num_rows else pa.array([], t) for c, t in (("word", pa.large_binary()), ("n", pa.int64()))), n_merges)
    del held
    counts: dict[tuple[int, int], int] = {}
    _changed(counts, *block.pairs())
    merges: list[tuple[int, int]] = []
    while len(merges) < n_merges and counts:
        most = max(counts.values())
        merges.append(min(p for p, n in counts.items() if n == most))
        _changed(counts, *block.merge(merges[-1], FIRST_MERGE + len(merges) - 1))
    return Tokenizer(tuple(merges))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Words in a block of distributed training; rounds after which the blocks are written to the shared folder, which cuts their lineage.
BLOCK_WORDS, ROUNDS = 300_000, 16
_BLOCKS = "ids binary, n binary, codes binary, sums binary"


def _row(block: Block, codes: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (block.ids, block.n, codes, sums)], names=["ids", "n", "codes", "sums"])


def _train_distributed(words: DataFrame, n_merges: int) -> Tokenizer:
    """Executors hold the words in blocks of ids; a round makes the merges that are certain and brings the driver what they change of the pairs' counts."""
    spark = words.sparkSession
    ship(spark)
    kind = np.int16 if FIRST_MERGE + n_merges < 2**15 else np.int32

    def begin(batches):
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):
            if b is not None:
                held.append(b)
            if held and (b is None or sum(x.num_rows for x in held) >= BLOCK_WORDS):
                block = Block.of(*(pa.concat_arrays([x.column(c) for x in held]) for c in ("word", "n")), n_merges)
                held = []
                yield _row(block, *block.pairs())

    def further(found, first):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    block = Block(*(np.frombuffer(b.column(c)[i].as_buffer(), k) for c, k in (("ids", kind), ("n", np.int64))))
                    block.ids = block.ids.copy()
                    parts = [block.merge(pair, first + j) for j, pair in enumerate(found)]
                    yield _row(block, *block._summed(*parts))

        return run

    counts: dict[tuple[int, int], int] = {}
    merges: list[tuple[int, int]] = []
    old, blocks, rounds = [], words.mapInArrow(begin, _BLOCKS).persist(StorageLevel.MEMORY_AND_DISK), 0
    while True:
        for r in blocks.select("codes", "sums").collect():
            _changed(counts, np.frombuffer(r["codes"], np.int64), np.frombuffer(r["sums"], np.int64))
        for x in old:
            x.unpersist()
        found = next_merges(counts, n_merges - len(merges))
        if not found:
            break
        old, rounds = [blocks], rounds + 1
        if rounds % ROUNDS == 0:
            blocks = _stored(blocks, "blocks")
        blocks = blocks.mapInArrow(further(found, FIRST_MERGE + len(merges)), _BLOCKS).persist(StorageLevel.MEMORY_AND_DISK)
        merges += found
        if len(merges) == n_merges:
            break
    for x in [*old, blocks]:
        x.unpersist()
    return Tokenizer(tuple(merges))


def freeze(tokenizer: Tokenizer) -> tuple[str, str]:
    """(file, lock): the tokenizer and its digest as JSON."""
    return json.dumps(tokenizer.as_dict(), sort_keys=True), json.dumps({"sha256": tokenizer.digest})


def load_frozen(file: str, lock: str) -> Tokenizer:
    found = Tokenizer(tuple((a, b) for a, b in json.loads(file)["merges"]))
    if found.digest != json.loads(lock)["sha256"]:
        raise TokenizerIntegrityError("the tokenizer's digest is not the lock's")
    return found


def encode_words(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """word, ids of distinct words."""
    ship(words.sparkSession)
    ranks = tokenizer.ranks()

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"word": f["word"], "ids": [encode_word(w.encode(), ranks) for w in f["word"]]})

    return words.select("word").distinct().mapInPandas(run, "word string, ids array<int>")


class _Memo(dict):
    """Ids of words as bytes of 32-bit integers; emptied when it has grown beyond a bound."""

    def __init__(self, tokenizer: Tokenizer, most: int = 500_000):
        super().__init__()
        self.most, self.end = most, chr(tokenizer.vocabulary)
        self.merges = [(chr(a) + chr(b), chr(FIRST_MERGE + i)) for i, (a, b) in enumerate(tokenizer.merges)]

    def meet(self, words: set[bytes]) -> None:
        """All these words are held afterwards. New ones stand in one line, a character for an id, where each merge is made at once: a merge's
        ids are of earlier ones, so in order of rank no pair of a lower rank appears later."""
        if len(self) >= self.most:
            self.clear()
        if new := list(words.difference(self)):
            line = self.end.join(w.decode("latin-1") for w in new)
            for pair, one in self.merges:
                line = line.replace(pair, one)
            self.update(zip(new, (x.encode("utf-32-le", "surrogatepass") for x in line.split(self.end))))


#: Bytes of a word, and ids of a vocabulary, up to which words are merged side by side; beyond, in a line.
LONG_WORD, DENSE = 64, 2048


class _Merger:
    """Ids of the distinct words of a piece of text."""

    def __init__(self, tokenizer: Tokenizer):
        self.end, self.none = tokenizer.vocabulary, len(tokenizer.merges)
        self.longest = LONG_WORD if self.end <= DENSE else 0
        self.line = _Memo(tokenizer, 0 if self.longest else 500_000)
        if self.longest:
            ranks = np.full((self.end + 1, self.end + 1), self.none, np.int16)
            for i, pair in enumerate(tokenizer.merges):
                ranks[pair] = min(i, ranks[pair])
            self.ranks = ranks.ravel()

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words: binary. Their ids one after another, how many each has, and each word's place in that order."""
        size = pc.binary_length(words).to_numpy()
        short, long = np.flatnonzero(size <= self.longest), np.flatnonzero(size > self.longest)
        done = self._side_by_side(words.take(pa.array(short)) if len(long) else words, short) if len(short) else []
        if len(long):
            held = words.take(pa.array(long)).to_pylist()
            self.line.meet(set(held))
            found = [self.line[w] for w in held]
            done.append((long, np.array([len(x) // 4 for x in found]), np.frombuffer(b"".join(found), np.int32)))
        order, n, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        return ids, n, place

    def _side_by_side(self, words: pa.Array, which: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each round makes in each word its merge of the lowest rank, everywhere; words that have none are done."""
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        n = np.diff(at) + 1  # each word has the end after it, which no merge has
        ids = np.full(n.sum(), self.end, np.int32)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(n) - 1] = False
        ids[inside] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        done = []
        while len(which):
            rank = np.full(len(ids), self.none, np.int16)
            rank[:-1] = self.ranks[ids[:-1] * (self.end + 1) + ids[1:]]
            least = np.minimum.reduceat(rank, np.cumsum(n) - n)
            open_ = least < self.none
            if not open_.all():
                held = np.repeat(open_, n)
                done.append((which[~open_], n[~open_] - 1, (x := ids[~held])[x != self.end]))
                which, n, ids, rank, least = which[open_], n[open_], ids[held], rank[held], least[open_]
            hit = _apart(np.flatnonzero(rank == np.repeat(least, n)))
            ids[hit] = rank[hit].astype(np.int32) + FIRST_MERGE
            kept = np.ones(len(ids), bool)
            kept[hit + 1] = False
            n = np.add.reduceat(kept, np.cumsum(n) - n, dtype=np.int64) if len(n) else n
            ids = ids[kept]
        return done


def _encoded(docs: DataFrame, tokenizer: Tokenizer, key: str, columns: list[StructField], unit: list[bytes], given) -> DataFrame:
    """docs: key, content, prompt, response. The key, given(bytes of the documents' units, offsets of documents in bytes, n_tokens), and loss_start.

    unit: the bytes that stand for each id. Each document is encoded where it is: its words are places in a table of the units of distinct words.
    """
    ship(docs.sparkSession)
    conversation = F.col("prompt").isNotNull() & F.col("response").isNotNull()
    text = F.when(conversation, F.concat("prompt", F.lit(" "), "response")).otherwise(F.coalesce("content", F.lit("")))
    texts = docs.select(key, text.cast("binary").alias("_text"), F.when(conversation, F.octet_length("prompt")).cast("int").alias("_first"))
    eos, user, assistant = (SPECIALS[x] for x in ("<eos>", "<user>", "<assistant>"))

    def run(batches):
        merger, units = _Merger(tokenizer), pa.array(unit, pa.large_binary())
        for b in batches:
            for start, end, data, bounds in _pieces(b.column(1)):
                first = b.column(2).slice(start, end - start)
                paired, middle = first.is_valid().to_numpy(zero_copy_only=False), bounds[:-1] + first.fill_null(0).to_numpy()
                starts = split_words(data, np.concatenate([bounds, middle[paired]]))
                words, which = _distinct(data, starts)
                ids, n, place = merger.ids(words)
                n = np.concatenate([n, [1, 1, 1]])  # the special tokens follow the words of the table
                spelled = units.take(pa.array(np.concatenate([ids, [eos, user, assistant]])))
                at = np.frombuffer(spelled.buffers()[1], np.int64)[np.cumsum(np.append(0, n))]
                table = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), spelled.buffers()[2]])
                begins, ends, turns = (np.searchsorted(starts, x) for x in (bounds[:-1], bounds[1:], middle))
                special = np.column_stack([paired, paired, np.ones(len(paired), bool)])
                where, what = np.column_stack([begins, turns, ends])[special], np.broadcast_to(len(words) + np.array([1, 2, 0]), special.shape)[special]
                items = np.insert(place[which], where, what)
                of = np.cumsum(np.append(0, ends - begins + special.sum(axis=1)))  # where documents begin in the items
                tokens, joined = np.cumsum(np.append(0, n[items])), table.take(pa.array(items))
                loss = tokens[np.minimum(of[:-1] + turns - begins + 2, of[1:])] - tokens[of[:-1]]
                held = given(joined.buffers()[2], np.frombuffer(joined.buffers()[1], np.int64)[of], np.diff(tokens[of]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), *held, pa.array(loss.astype(np.int32), mask=~paired)], names=[key, *(x.name for x in columns), "loss_start"])

    return texts.mapInArrow(run, StructType([StructField(key, docs.schema[key].dataType), *columns, StructField("loss_start", IntegerType())]))


def encode_documents(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_key") -> DataFrame:
    """docs: key, lane, content, prompt, response. key, tokens, loss_start: text and <eos>, or <user> prompt <assistant> ' 'response <eos>."""

    def given(joined: pa.Buffer, at: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(at // 4, pa.int32()), pa.Array.from_buffers(pa.int32(), int(at[-1]) // 4, [None, joined]))]

    unit = [i.to_bytes(4, "little") for i in range(tokenizer.vocabulary)]
    return _encoded(docs, tokenizer, key, [StructField("tokens", ArrayType(IntegerType()))], unit, given)


def token_digests(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_key") -> DataFrame:
    """key, n_tokens, token_sha256, loss_start: of encode_documents' tokens, as decimal numbers with commas between."""

    def given(joined: pa.Buffer, at: np.ndarray, n: np.ndarray) -> list[pa.Array]:
        held = memoryview(joined)
        return [pa.array(n), pa.array([hashlib.sha256(held[x : y - 1]).hexdigest() for x, y in zip(at.tolist(), at[1:].tolist())])]

    unit = [b"%d," % i for i in range(tokenizer.vocabulary)]
    return _encoded(docs, tokenizer, key, [StructField("n_tokens", IntegerType()), StructField("token_sha256", StringType())], unit, given)


def decode(tokens: DataFrame, tokenizer: Tokenizer, column: str = "tokens") -> DataFrame:
    """tokens with text: pieces by id (the vocabulary bounds the lookup), specials left out."""
    ship(tokens.sparkSession)
    pieces = tokenizer.pieces()

    @F.arrow_udf("string")
    def joined(ids: pa.Array) -> pa.Array:
        at, values, held = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False), ids.is_valid().to_pylist()
        texts = (b"".join(map(pieces.__getitem__, values[at[i] : at[i + 1]].tolist())).decode("utf-8", "replace") if held[i] else None for i in range(len(ids)))
        return pa.array(texts, pa.string())

    return tokens.withColumn("text", joined(F.col(column)))
