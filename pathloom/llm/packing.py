"""Concatenate-and-cut packing by two-pass prefix sums.

Pass one tokenises each input partition once, numbers its tokens from 0 and
writes the ids (two bytes each for this vocabulary) to the shared folder. The
partition totals, one number per partition, become global offsets by a prefix
sum. Pass two adds a partition's offset to its rows and cuts at multiples of
the window; nothing is shuffled, and a document that crosses a boundary yields
one record per window. The records are written, too, so that both passes get
small Arrow batches, and the ids go.
"""

from __future__ import annotations

import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop_stored, ship, stored, trim

WINDOW = 2048
#: Rows of an Arrow batch: their texts are held by the executor and by its Python worker.
BATCH_ROWS = 1000
EOD = 1
CACHE_WORDS = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Fixed value: the split pattern of byte-level pre-tokenisers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def rank_encoder(path: str):
    """An encoder of ordinary words with the same ids, several times as fast, or None.

    It exists where the file is a plain byte-level model whose merges are in
    the order of their ids: the lowest rank then is the first merge.
    """
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("unk_token"):
        return None
    # Byte-level vocabularies write a byte as itself if printable, else as the next sign from 256 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    sign = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = model["vocab"]
    ranks = {bytes(sign[c] for c in t): i for t, i in vocab.items() if t not in special}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if merged != sorted(x for x in ranks.values() if x >= 256) or sorted(ranks.values())[:256] != list(range(256)):
        return None
    words = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return (lambda w: words.encode_ordinary(w)), special


class CachedTokenizer:
    """Token ids as little-endian bytes, with whole words looked up in a cache.

    The vocabulary's pre-tokeniser never joins text across a single space that
    stands between two other characters, so a text is the concatenation of its
    space-led words. Texts with longer or other white space beside such a
    space are encoded whole.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.most, self.words = most, {}
        self.quick, self.special = rank_encoder(path) or (None, set())

    def _words(self, words: list[str]) -> list[bytes]:
        if self.quick is None or any(t in w for t in self.special for w in words):
            return self._encode(words)
        kind = self.dtype.char
        return [array(kind, self.quick(w)).tobytes() for w in words]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        words = [first, *[" " + w for w in rest]]
        new = [w for w in dict.fromkeys(words) if w not in self.words]
        if any(not (p := w[1:] if w[:1] == " " else w) or p[0].isspace() or p[-1].isspace() for w in new):
            return self._encode([text])[0]
        if len(self.words) + len(new) > self.most:
            self.words = {}
            new = list(dict.fromkeys(words))
        self.words.update(zip(new, self._words(new), strict=True))
        return b"".join(map(self.words.__getitem__, words))


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> CachedTokenizer:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    made = CachedTokenizer(path)
    trim()  # of the file, which was read twice
    return made


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Rows (part, doc_id, local, tokens, ids): ids of each document with the
    end marker, and its first token's number within the partition."""
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)

    def encode(batches):
        from pyspark import TaskContext

        part, local, tok = TaskContext.get().partitionId(), 0, _tokenizer(path)
        end = np.array([EOD], dtype=tok.dtype).tobytes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                ids = [tok.encode(t or "") + end for t in some.column(1).to_pylist()]
                tokens = np.array([len(x) for x in ids], dtype=np.int64) // tok.dtype.itemsize
                at = local + np.concatenate([[0], np.cumsum(tokens)[:-1]])
                local += int(tokens.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, dtype=np.int64)), some.column(0), pa.array(at), pa.array(tokens), pa.array(ids, pa.binary()), pa.array(np.full(len(ids), tok.dtype.itemsize, dtype=np.int32))], names=["part", "doc_id", "local", "tokens", "ids", "width"])
        trim()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, "part long, doc_id long, local long, tokens long, ids binary, width int")


def _cut(window: int):
    def cut(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows: list[list] = [[] for _ in range(7)]
                for doc, at, tokens, ids, width in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4")
                    begin = 0
                    while begin < tokens:
                        sequence, offset = divmod(at + begin, window)
                        n = min(window - offset, tokens - begin)
                        for out, v in zip(rows, (doc, begin, n, zlib.crc32(wide[begin : begin + n].tobytes()), tokens, sequence, offset), strict=True):
                            out.append(v)
                        begin += n
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=PIECES.replace(" long", "").split(", "))
        trim()

    return cut


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in windows of `window` tokens (PIECES).

    Every token lies in exactly one piece; all sequences but the last are
    full. Null text is empty and gives the end marker alone; identifiers may
    repeat or be null, each row is packed for itself. An empty table gives no
    piece.
    """
    table = stored(tokenised(docs, key, text, tokenizer), "tokens", BATCH_ROWS)
    totals = table.groupBy("part").agg(F.sum("tokens").alias("n"))
    # One row per input partition: small enough for one window and a broadcast.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = table.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local")).alias("at"), "tokens", "ids", "width")
    pieces = stored(placed.mapInArrow(_cut(window), PIECES), "pieces", BATCH_ROWS)
    drop_stored(table)
    return pieces


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
