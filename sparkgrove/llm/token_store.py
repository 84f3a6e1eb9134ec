"""Token-ID output: raw id shards with a minimal perfect hash index.

Layout of a store, all under one folder:

``shards/N.ids``        raw little-endian ids of consecutive documents, two bytes each
                        where the vocabulary allows it, else four; no headers
``docs/``               Parquet directory: doc_id, copy, shard, offset, n_tokens
``positions/``          Parquet: shard, first (ids in all shards before it)
``index/NNNNNN.mph``    minimal perfect hash of one bucket of keys: bit vectors of its
                        levels, then fingerprint, shard, offset and length by slot
``manifest.json``       id width, totals, buckets; written last

Documents are range-sorted, by doc_id (nulls last, equal ids by text) or by the caller's
order, encoded, and each partition streams its ids to shards of at most ``SHARD_IDS`` ids
or one document. A key is (doc_id, copy), copy counting rows of equal doc_id from 0 in
that order. To look a key up, its bucket and slot are computed, the stored fingerprint is
compared, and the slot's offset leads to the ids: constant time. The hash is built level by
level (Limasset et al., 2017): keys alone in their cell of a bit vector settle there,
others go to the next level; the rank of the cell is the slot.

Encoding: a tokenizer whose file has the normalizer and the pre-tokenizer of ``_BY_WORDS``
drops white space and splits words from each other before anything else, so each distinct
word is encoded once with the tokenizers library and remembered in the task's process; one
document of every slice is also encoded whole, and a difference raises. Any other
tokenizer encodes whole texts.

Defined results: null texts are empty and hold the end id only. Null doc_ids are keys
of their own. Repeated rows are documents of their own. An empty table gives a store
without shards. Columns besides doc_id, text and the order's are not read. A lost
executor's tasks run again and move the same files into place.
"""

from __future__ import annotations

import io
import json
import string
import zlib
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh_path, in_arrow, pieces, table
from .storage import located, read_bytes, written

END_ID = 1
#: UTF-8 bytes encoded at a time, and words remembered by one process.
SLICE_BYTES, MEMORY = 2 << 20, 200_000
#: Ids of a shard, and of what is read back at a time; a longer document stands alone.
SHARD_IDS, READ_IDS = 1 << 26, 1 << 20
#: Keys of an index bucket at most, on average; bits a key in each level of the hash.
BUCKET_KEYS, GAMMA, LEVELS = 1 << 16, 2, 40
_U = np.uint64

#: The parts of a tokenizer file with which words are encoded apart.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def by_words(config: dict) -> bool:
    """Whether a tokenizer file's content is one that encodes words apart."""
    tokens = config.get("added_tokens") or []
    apart = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in tokens)
    # nor may a special token look like a word of letters with punctuation after it
    odd = all((body := t["content"].rstrip(string.punctuation)) and not body.isalpha() for t in tokens)
    return apart and odd and config["model"]["type"] == "BPE" and all(config.get(k) == v for k, v in _BY_WORDS.items())


class _Letters(dict):
    """What a tokenizer makes of single letters; NUL for those it makes no one piece of."""

    def __init__(self, split):
        super().__init__()
        self.split = split

    def __missing__(self, code: int) -> str:
        made = self.split(chr(code))
        self[code] = made[0] if len(made) == 1 else "\0"
        return self[code]


class Encoder:
    """Ids of texts by one tokenizer file, word by word where that is exact."""

    _kept: dict = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), by_words(json.loads(Path(path).read_text()))
        self.model, self.normalizer, self.pre = self.tokenizer.model, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.special = {t.content: [i] for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = sorted(self.special, key=len, reverse=True)
        self.letters = _Letters(self._split)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each process, so that words stay known from task to task."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.pieces: dict[str, list[int]] = dict(self.special)
        self.pool, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _split(self, word: str) -> list[str]:
        for special in self.added:
            if special in word:  # is cut out before anything else, and is its own piece
                before, after = word.split(special, 1)
                return [*self._split(before), special, *self._split(after)]
        return [piece for piece, _ in self.pre.pre_tokenize_str(self.normalizer.normalize_str(word))]

    def _pieces(self, word: str) -> list[str]:
        """As the tokenizer splits a word; letters with punctuation after them, the
        most frequent case, are put together from what it makes of single letters."""
        body = word.rstrip(string.punctuation)
        if body.isalpha() and is_normalized("NFC", body):
            whole = body.translate(self.letters)
            if "\0" not in whole:
                return [whole, word[len(body) :]] if len(body) < len(word) else [whole]
        return self._split(word)

    def _learn(self, words: list[str]) -> None:
        n, ids, lengths, pieces = len(self.slots), [], [], self.pieces
        for word in words:
            found = []
            for piece in self._pieces(word):
                known = pieces.get(piece)
                if known is None:
                    known = pieces[piece] = [t.id for t in self.model.tokenize(piece)]
                found += known
            ids += found
            lengths.append(len(found))
            self.slots[word] = n
            n += 1
        starts = len(self.pool) + np.cumsum([0, *lengths])[:-1]
        self.pool = np.concatenate([self.pool, np.array(ids, np.uint32)])
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, np.array(lengths, np.int64)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids of each."""
        if not self.by_words:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, np.uint32)]), np.array([len(x) for x in found], np.int64)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.slots) > MEMORY:
            self.forget()
        self._learn([w for w in words if w not in self.slots])
        slots = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        index = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else slots
        lengths = self.lengths[index]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(self.starts[index] - before[:-1], lengths) + np.arange(before[-1])]
        bounds = before[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if len(texts):
            whole = self.tokenizer.encode(texts[0].as_py(), add_special_tokens=False).ids
            if not np.array_equal(whole, ids[: bounds[1]]):
                raise ValueError("this tokenizer's ids of words depend on their neighbours")
        return ids, np.diff(bounds)


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(counts), end_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(counts + 1) - 1] = False
    out[own] = ids
    return out


def _shards(path: str, tokenizer: str, width: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, attempt, encoder = context.partitionId() << 20, str(context.taskAttemptId()), Encoder.of(tokenizer)
        # slices of the task's documents: keys, ids with end ids, lengths
        made = (
            (part.column(0), _with_end(ids, counts, end_id), counts + 1)
            for batch in batches
            for part in pieces(batch, 1, SLICE_BYTES)
            for ids, counts in [encoder.encode(pc.fill_null(part.column(1), ""))]
        )
        waiting = next(made, None)
        while waiting:
            at = 0
            with written(f"{path}/shards/{shard}.ids", attempt) as out:
                while waiting and (not at or at + len(waiting[1]) <= SHARD_IDS):
                    keys, ids, n = waiting
                    out.write(ids.astype(f"<u{width}").tobytes())
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(n), shard)), pa.array(at + np.cumsum(n) - n), pa.array(n)], schema=schema)
                    at += len(ids)
                    waiting = next(made, None)
            shard += 1

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashed(ids: np.ndarray, none: np.ndarray, copies: np.ndarray, level: int) -> np.ndarray:
    salt = _mixed(np.array([level + 1], np.uint64) * _U(0x9E3779B97F4A7C15))
    return _mixed(_mixed(ids.astype(np.int64).view(np.uint64) ^ salt) + _mixed(copies.astype(np.uint64) * _U(2) + none.astype(np.uint64) + salt))


def _prints(ids, none, copies) -> np.ndarray:
    return (_hashed(ids, none, copies, LEVELS + 1) >> _U(32)).astype(np.uint32)


class PerfectHash:
    """Levels of bit vectors; ``rank`` has the set bits before each byte of them."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest  # rest: keys no level settled
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, ids: np.ndarray, none: np.ndarray, copies: np.ndarray) -> PerfectHash:
        left, sizes, vectors = np.arange(len(ids)), [], []
        for level in range(LEVELS):
            if not len(left):
                break
            size = -(-GAMMA * len(left) // 8) * 8
            cell = (_hashed(ids[left], none[left], copies[left], level) % _U(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            sizes.append(size)
            vectors.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[cell]]
        rest = np.stack([ids[left], none[left], copies[left]], axis=1).astype(np.int64)
        return cls(np.array(sizes, np.int64), np.concatenate([*vectors, np.zeros(0, np.uint8)]), rest)

    def slots(self, ids: np.ndarray, none: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """The slot of each key; a key that was not built in gets any, or -1."""
        out, left, at = np.full(len(ids), -1, np.int64), np.arange(len(ids)), 0
        for level, size in enumerate(self.sizes.tolist()):
            cell = (_hashed(ids[left], none[left], copies[left], level) % _U(size)).astype(np.int64) + 8 * at
            byte, bit = self.bits[cell >> 3], (cell & 7).astype(np.uint8)
            set_ = (byte >> bit & 1).astype(bool)
            below = np.bitwise_count(byte & ((1 << bit.astype(np.uint16)) - 1).astype(np.uint8))
            out[left[set_]] = (self.rank[cell >> 3] + below)[set_]
            left, at = left[~set_], at + size // 8
        if len(left) and len(self.rest):
            known = {tuple(k): self.rank[-1] + i for i, k in enumerate(self.rest.tolist())}
            out[left] = [known.get((int(ids[i]), int(none[i]), int(copies[i])), -1) for i in left]
        return out


def _keys(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = pdf["doc_id"].isna().to_numpy()
    ids = pdf["key"].to_numpy(np.int64)
    return ids, none, pdf["copy"].to_numpy(np.int64)


def _index(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyspark import TaskContext

        bucket, (ids, none, copies) = int(pdf["bucket"].iloc[0]), _keys(pdf)
        perfect = PerfectHash.build(ids, none, copies)
        order = np.argsort(perfect.slots(ids, none, copies))
        out = io.BytesIO()
        np.savez(
            out, sizes=perfect.sizes, bits=perfect.bits, rest=perfect.rest, prints=_prints(ids, none, copies)[order],
            shard=pdf["shard"].to_numpy(np.int64)[order], offset=pdf["offset"].to_numpy(np.int64)[order], n=pdf["n_tokens"].to_numpy(np.int64)[order],
        )
        with written(f"{path}/index/{bucket:06d}.mph", str(TaskContext.get().taskAttemptId())) as stream:
            stream.write(out.getvalue())
        return pd.DataFrame({"bucket": [bucket], "n": [len(pdf)]})

    return run


def _bucketed(keys: DataFrame, n_buckets: int) -> DataFrame:
    key = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    return keys.withColumns({"key": key, "bucket": F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n_buckets)).cast("int")})


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with copy: counted per id and shard first, so that no task holds all rows
    of an id."""
    inside = F.row_number().over(Window.partitionBy("doc_id", "shard").orderBy("offset")) - 1
    earlier = Window.partitionBy("doc_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = rows.groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("n"))
    goes_on = per_shard.select(F.col("doc_id").alias("of"), F.col("shard").alias("of_shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")).where("base > 0")
    joined = rows.withColumn("inside", inside).join(goes_on, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("shard") == F.col("of_shard")), "left")
    return joined.select("doc_id", (F.col("inside") + F.coalesce("base", F.lit(0))).alias("copy"), "shard", "offset", "n_tokens")


def write(docs: DataFrame, path: str, tokenizer: str, order: list[Column] | None = None, end_id: int = END_ID) -> dict:
    """Encodes ``docs`` (doc_id, text) into a new store at ``path``, in ``order`` or by
    doc_id; returns its manifest."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id) < 1 << 16 else 4
    names = [f"by{i}" for i in range(len(order or ()))]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c.alias(n) for c, n in zip(order or (), names)])
    by = [F.col(n).asc_nulls_last() for n in names] or [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = given.repartitionByRange(*by).sortWithinPartitions(*by, F.col("text").asc_nulls_first()).select("doc_id", "text")
    encoded = in_arrow(ordered, _shards(path, tokenizer, width, end_id), "doc_id long, shard long, offset long, n_tokens long")
    with Scratch(spark) as scratch:
        made = _numbered(scratch.table(encoded, "encoded"))
        made.write.parquet(f"{path}/docs")
    rows = spark.read.schema(made.schema).parquet(f"{path}/docs")
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first")).write.parquet(f"{path}/positions")
    n_docs, n_ids = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    n_buckets = max(1, n_docs // BUCKET_KEYS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_docs >> 8))
    built = _bucketed(rows, n_buckets).groupBy("bucket").applyInPandas(_index(path), "bucket int, n long")
    n_keys = built.agg(F.sum("n")).first()[0] or 0
    if n_keys != n_docs:
        raise ValueError(f"the index holds {n_keys} keys for {n_docs} documents")
    manifest = {"width": width, "end_id": end_id, "docs": n_docs, "ids": n_ids, "buckets": n_buckets}
    store, where = located(path)
    with store.open_output_stream(f"{where}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def manifest_of(path: str) -> dict:
    return json.loads(read_bytes(f"{path}/manifest.json"))


def keys(spark: SparkSession, path: str) -> DataFrame:
    """All keys of a store: doc_id, copy."""
    return spark.read.schema("doc_id long, copy long").parquet(f"{path}/docs")


def _find(path: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        with np.load(io.BytesIO(read_bytes(f"{path}/index/{int(pdf['bucket'].iloc[0]):06d}.mph"))) as f:
            held = {k: f[k] for k in f.files}
        ids, none, copies = _keys(pdf)
        slots = PerfectHash(held["sizes"], held["bits"], held["rest"]).slots(ids, none, copies)
        known = slots >= 0
        known[known] = held["prints"][slots[known]] == _prints(ids, none, copies)[known]
        at, rows = slots[known], pdf[known]
        return pd.DataFrame({"doc_id": rows["doc_id"], "copy": rows["copy"], "shard": held["shard"][at], "offset": held["offset"][at], "n_tokens": held["n"][at]})

    return run


def locate(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, copy) → the keys that the index knows, with shard, offset and
    n_tokens. Another key passes with the chance that fingerprints agree, 2**-32."""
    found = _bucketed(wanted.select("doc_id", "copy"), manifest_of(path)["buckets"]).groupBy("bucket")
    return found.applyInPandas(_find(path), "doc_id long, copy long, shard long, offset long, n_tokens long")


def _read(path: str, width: int, digest):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, shard = pdf.sort_values("offset"), int(pdf["shard"].iloc[0])
        store, at = located(f"{path}/shards/{shard}.ids")
        found = []
        with store.open_input_file(at) as f:
            for offset, n in zip(pdf["offset"].tolist(), pdf["n_tokens"].tolist()):
                f.seek(offset * width)
                found.append(digest(np.frombuffer(f.read(n * width), f"<u{width}")))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "copy": pdf["copy"], "start": pdf["first"] + pdf["offset"], "n_tokens": pdf["n_tokens"], "value": found})

    return run


def read(spark: SparkSession, path: str, wanted: DataFrame, digest=None, kind: str = "array<int>") -> DataFrame:
    """Keyed access: ``wanted`` (doc_id, copy) → doc_id, copy, start, n_tokens, value:
    the ids read from the shards, or ``digest`` of them as Spark type ``kind``."""
    part = F.floor(F.col("offset") / READ_IDS)
    first = spark.read.schema("shard long, first long").parquet(f"{path}/positions")
    found = locate(spark, path, wanted).join(first, "shard").groupBy("shard", part.alias("part"))
    return found.applyInPandas(_read(path, manifest_of(path)["width"], digest or np.ndarray.tolist), f"doc_id long, copy long, start long, n_tokens long, value {kind}")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def written_and_read(docs: DataFrame, tokenizer: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """Writes ``docs`` to a new store in the shared folder and reads every key back."""
    import public_tokenizers

    path = fresh_path(docs.sparkSession, "token-store")
    write(docs, path, tokenizer or public_tokenizers.path("word_bpe_49k.json"), order)
    back = read(docs.sparkSession, path, keys(docs.sparkSession, path), crc32, "long")
    return back.select("doc_id", "start", "n_tokens", F.col("value").alias("ids_crc32"))


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    return written_and_read(table(spark, sf_dir, "documents"))
