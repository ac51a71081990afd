"""Token-id output: documents as ids in checksummed, range-coded blocks.

``encode_texts`` turns texts into ids (any tokenizer file of the tokenizers
library), ``write`` puts them into blocks in ascending id order, ``read`` and
``digests`` read the blocks back.

File format: a Parquet table with one row per block: ``shard`` (a range of the
document order), ``block`` (number in the shard), ``first`` (ids of the shard
before it), ``docs`` (its directory: number of the document in the shard, id,
ids in this block, whether the document ends here) and ``data``, the bytes of
``mixing_coder``: a head with count, size and CRC-32, then the coded ids.  A
block holds ``BLOCK_IDS`` ids (the last of a shard fewer), starts with a fresh
model and can be read without any other.  Documents cross blocks, never shards.

Size of work: a task holds ``mixing_coder.LANES`` blocks at a time; a shard is
some 4 million ids, however many documents there are; offsets of shards are
one row per shard.

Defined cases: null and empty texts have the end id alone; rows with one id
are ordered by text hash, repeated rows stay repeated; null ids come first;
text that spells a special token is ordinary text; an empty table gives no
block; extra columns are not read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import mixing_coder
from quire.llm.store import table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
BLOCK_IDS = 2048
SHARD_IDS = 1 << 22
PIECES_HELD = 300_000  # pieces of text whose ids a task remembers
# Fixed value: how a byte-level tokenizer of this kind divides a text before it merges bytes.
BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters on which the regex library and the tokenizer's own engine surely agree; a text with any other goes to the
# tokenizer whole.
_OTHER = r"[^\t-\r -~¡-ɏΑ-Ρα-ωА-я‐-‧‰-⁞]"


class Encoder:
    """Texts to ids with one tokenizer file."""

    def __init__(self, path: str):
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = ids_type(self.tok.get_vocab_size(with_added_tokens=True))
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_pieces = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                          and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding"))
        self.split = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.other = regex.compile(_OTHER).search
        self.held: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, new: list[str]):
        """(piece, ids) of pieces, those of letters in one text: a line break
        is a piece and an id of its own, so it parts their ids again."""
        plain = [p for p in new if p[-1].isalpha()]
        rest = [p for p in new if not p[-1].isalpha()]
        yield from zip(rest, self.whole(rest))
        cut = self.tok.encode("\n", add_special_tokens=False).ids
        if len(cut) != 1:
            yield from zip(plain, self.whole(plain))
            return
        for lo in range(0, len(plain), 2048):
            part = plain[lo:lo + 2048]
            ids = np.array(self.tok.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.kind)
            yield from zip(part, (x.tobytes() for x in _between(ids, cut[0])))

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers (``ids_type``)."""
        if not self.by_pieces:
            return self.whole(texts)
        odd = {i for i, t in enumerate(texts) if self.other(t)}
        pieces = [[] if i in odd else self.split(t) for i, t in enumerate(texts)]
        if len(self.held) > PIECES_HELD:
            self.held.clear()
        held = self.held
        new = list({p for ps in pieces for p in ps}.difference(held))
        held.update(self.pieces(new))
        out = [b"".join([held[p] for p in ps]) for ps in pieces]
        for i, ids in zip(sorted(odd), self.whole([texts[i] for i in sorted(odd)])):
            out[i] = ids
        return out


def _between(ids: np.ndarray, cut: int):
    """The parts of ``ids`` between the places of ``cut``."""
    ends = np.append(np.flatnonzero(ids == cut), len(ids))
    lo = 0
    for hi in ends:
        yield ids[lo:hi]
        lo = hi + 1


def ids_type(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def vocabulary(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encode_texts(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, tie, n, ids): the ids of each row with the end id, as bytes
    (``ids_type`` of the vocabulary)."""

    def run(batches):
        encode = Encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        wide = len(end)
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo:lo + 512]
                ids = [x + end for x in encode([t or "" for t in part["text"]])]
                yield pd.DataFrame({"id": part["id"], "tie": part["tie"], "n": [len(x) // wide for x in ids], "ids": ids})

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([src.schema["id"], T.StructField("tie", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return src.mapInPandas(run, schema)


def write(encoded: DataFrame, vocab: int, name: str = "token-blocks") -> DataFrame:
    """The written block table of ``encode_texts`` rows, all ids below ``vocab``."""
    encoded = table(encoded, "token-ids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    cores = encoded.sparkSession.sparkContext.defaultParallelism
    shard_ids = max(min(SHARD_IDS, total // cores), 128 * BLOCK_IDS)
    id_type, kind = encoded.schema["id"].dataType, ids_type(vocab)

    def run(batches):
        from pyspark import TaskContext

        shard, block, first, seq = TaskContext.get().partitionId(), 0, 0, 0
        wait, held, directory = [], 0, []            # pieces, their ids and documents of the open block
        full, dirs = [], []                          # closed blocks

        def rows():
            nonlocal full, dirs, block, first
            data = mixing_coder.encode(full, vocab)
            n = np.array([len(x) for x in full], np.int64)
            starts = first + np.cumsum(n) - n
            got = pd.DataFrame({"shard": shard, "block": block + np.arange(len(full)), "first": starts, "n": n,
                                "docs": dirs, "data": data})
            block, first = block + len(full), first + int(n.sum())
            full, dirs = [], []
            return got

        def close():
            nonlocal wait, held, directory
            full.append(np.concatenate(wait))
            dirs.append(directory)
            wait, held, directory = [], 0, []

        for pdf in batches:
            for id_, data in zip(pdf["id"], pdf["ids"]):
                ids, at = np.frombuffer(data, kind), 0
                while at < len(ids):
                    part = ids[at:at + BLOCK_IDS - held]
                    at += len(part)
                    wait.append(part)
                    held += len(part)
                    directory.append({"seq": seq, "id": id_, "n": len(part), "last": at == len(ids)})
                    if held == BLOCK_IDS:
                        close()
                        if len(full) == mixing_coder.LANES:
                            yield rows()
                seq += 1
        if held:
            close()
        if full:
            yield rows()

    doc = T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", id_type), T.StructField("n", T.LongType()),
                        T.StructField("last", T.BooleanType())])
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.LongType()),
                           T.StructField("first", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("docs", T.ArrayType(doc)), T.StructField("data", T.BinaryType())])
    ordered = encoded.repartitionByRange(max(1, -(-total // shard_ids)), "id", "tie").sortWithinPartitions("id", "tie")
    return table(ordered.select("id", "ids").mapInPandas(run, schema), name)


def read(blocks: DataFrame, vocab: int, keep_ids: bool = True) -> DataFrame:
    """Pieces of documents, decoded block by block: shard, block, seq, id, at
    (ids of the shard before the piece), n, last, crc and, if kept, ids."""
    id_type = blocks.schema["docs"].dataType.elementType["id"].dataType
    fields = [("shard", T.IntegerType()), ("block", T.LongType()), ("seq", T.LongType()), ("id", id_type),
              ("at", T.LongType()), ("n", T.LongType()), ("last", T.BooleanType()), ("crc", T.LongType()),
              ("ids", T.BinaryType())]
    fields = fields if keep_ids else fields[:-1]

    def pieces(wait):
        out = []
        for (shard, block, first, docs, _), ids in zip(wait, mixing_coder.decode([w[-1] for w in wait], vocab)):
            raw, at = ids.astype("<u4", copy=False).tobytes(), 0
            for d in docs:
                part = raw[4 * at:4 * (at + d["n"])]
                row = (shard, block, d["seq"], d["id"], first + at, d["n"], d["last"], zlib.crc32(part))
                out.append((*row, part) if keep_ids else row)
                at += d["n"]
        return pd.DataFrame(out, columns=[f for f, _ in fields])

    def run(batches):
        wait = []
        for pdf in batches:
            for row in zip(pdf["shard"], pdf["block"], pdf["first"], pdf["docs"], pdf["data"]):
                wait.append(row)
                if len(wait) == mixing_coder.LANES:
                    yield pieces(wait)
                    wait = []
        if wait:
            yield pieces(wait)

    return blocks.select("shard", "block", "first", "docs", "data") \
        .mapInPandas(run, T.StructType([T.StructField(a, b) for a, b in fields]))


_ZEROS = bytes(4 * BLOCK_IDS)


def joined_crc(parts) -> int:
    """CRC-32 of a text of several parts from (length in bytes, CRC-32) of each."""
    crc = 0
    for size, c in parts:
        while size > 0:  # the old checksum moves on over ``size`` zero bytes
            step = min(size, len(_ZEROS))
            crc = zlib.crc32(_ZEROS[:step], crc) ^ zlib.crc32(_ZEROS[:step])
            size -= step
        crc ^= c
    return crc


@F.pandas_udf(T.LongType())
def _joined(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: joined_crc((4 * x["n"], x["crc"]) for x in p))


def _offsets(blocks: DataFrame) -> DataFrame:
    """Ids of all shards before each (a row per shard)."""
    sizes = blocks.groupBy("shard").agg(F.sum("n").alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))


def documents(blocks: DataFrame, vocab: int) -> DataFrame:
    """(id, start, n, ids) of every document, put together from its pieces."""
    parts = read(blocks, vocab).groupBy("shard", "seq").agg(
        F.first("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("block", "ids"))).alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return parts.join(_offsets(blocks), "shard").select("id", (F.col("before") + F.col("at")).alias("start"), "n", whole.alias("ids"))


def digests(blocks: DataFrame, vocab: int) -> DataFrame:
    """(id, start, n, crc) of every document, from the decoded blocks."""
    parts = read(blocks, vocab, keep_ids=False).groupBy("shard", "seq").agg(
        F.first("id").alias("id"), F.min("at").alias("at"), F.sum("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("block", "n", "crc"))).alias("p"))
    return parts.join(_offsets(blocks), "shard").select("id", (F.col("before") + F.col("at")).alias("start"), "n",
                                                         _joined("p").alias("crc"))
