"""Token counts with a digest cache.

Texts are joined by the digests of their normalised content and of the tokenizer's file to counts stored before; only
distinct contents without a stored count are encoded, and their counts are appended to the cache.

Defined cases: a null text counts as the empty one (0 tokens); rows are kept as they are, repeated or with null ids; an
empty table gives an empty result and appends nothing; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import buffers, pieces
from .shared import shared_dir, stored, table, text_of

CACHE = "tokenizer binary, content binary, n_tokens long"
#: Distinct words, and pieces of words, whose counts a worker remembers before it starts anew.
MEMO_WORDS = 1_000_000
#: Rules that cut a word of visible ASCII characters into lower-case pieces, each of which the model encodes by itself.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: What these rules are for such words. ByteLevel leaves their characters as they are.
_VISIBLE, _PIECES = re.compile(rb"[\x21-\x7E]+").fullmatch, re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


def tokenizer_version(path: str) -> bytes:
    return hashlib.sha256(Path(path).read_bytes()).digest()


def drops_space(path: str) -> bool:
    """Whether the tokenizer's own rules make white space a pure separator, so that counts add up over words."""
    if not path.endswith(".json"):
        return False
    spec = json.loads(Path(path).read_text())
    kinds = lambda x: [x] if x and x["type"] != "Sequence" else [y for y in (x or {}).get("normalizers", []) + (x or {}).get("pretokenizers", [])]
    spaces = any(x["type"] == "Replace" and x["pattern"].get("Regex") == r"\s+" for x in kinds(spec.get("normalizer")))
    split = any(x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[^\s" in x["pattern"].get("Regex", "") for x in kinds(spec.get("pre_tokenizer")))
    strips = any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
    return spaces and split and not strips and spec.get("post_processor") is None


def added_words(path: str) -> list[bytes] | None:
    """The added tokens of a tokenizer with the rules that `_PIECES` stands for; None for any other one. A word that holds one is left to the library."""
    spec = json.loads(Path(path).read_text()) if drops_space(path) else {}
    added = spec.get("added_tokens", [])
    plain = spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _PRE_TOKENIZER and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
    return [x["content"].encode() for x in added] if plain and not any(x["normalized"] for x in added) else None


def normalised(text: Column, path: str) -> Column:
    """The content that decides the count: where white space only separates, runs of it are one space."""
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if drops_space(path) else text


class Counter:
    """Counts tokens of whole texts; loaded once a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.by_word, self.memo, self.pieces, self.added = drops_space(path), {}, {}, added_words(path)
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation(), t.no_padding()
            self.encode = lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]  # without places
            self.model = t.model
        elif path.endswith(".model"):
            from sentencepiece import SentencePieceProcessor

            t = SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in t.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no tokenizer library for {path}")

    def counts(self, texts: list[bytes]) -> list[int]:
        if not self.by_word:
            return [self.encode([t.decode()])[0] for t in texts]
        words = [t.split() for t in texts]  # at ASCII white space
        if new := set().union(*words).difference(self.memo):
            if len(self.memo) > MEMO_WORDS:
                self.memo, new = {}, set().union(*words)
            self.learn(new)
        return [sum(map(self.memo.__getitem__, x)) for x in words]

    def count(self, data: bytes) -> int:
        return self.counts([data])[0]

    def learn(self, words: set[bytes]) -> None:
        """Words of visible ASCII characters count by their pieces, which are far fewer; the library gets the others whole."""
        plain = set() if self.added is None else {w for w in words if _VISIBLE(w) and not any(x in w for x in self.added)}
        if len(self.pieces) > MEMO_WORDS:
            self.pieces = {}
        known, tokens = self.pieces, self.model.tokenize if plain else None
        for w in plain:
            n = 0
            for x in _PIECES(w.decode().lower()):
                if (k := known.get(x)) is None:
                    k = known[x] = len(tokens(x))
                n += k
            self.memo[w] = n
        rest = list(words - plain)
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            self.memo.update(zip(part, self.encode([w.decode() for w in part])))


_counters: dict[bytes, Counter] = {}


def counter_of(path: str, version: bytes) -> Counter:
    """The worker's counter: Spark uses a worker for many tasks, whose texts share most words."""
    if version not in _counters:
        _counters.clear()
        _counters[version] = Counter(path)
    return _counters[version]


def encoded(texts: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of (content, text)."""
    version = tokenizer_version(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path, version)
        for batch in batches:
            for part in pieces(batch):
                data, at = buffers(part.column(1))
                raw, at = data.tobytes(), at.tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.counts([raw[a:b] for a, b in zip(at, at[1:])]), pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, limit: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row; `cache`: a folder that all executors share, made if missing.

    The table is read twice: once for digests, which are all that is joined, and once for the texts of misses. Copies
    are merged on the map side before texts move.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    text = text_of(docs, text_column)
    keyed = docs.select(F.col(id_column), text.alias("text"), F.unhex(F.sha2(normalised(text, tokenizer), 256)).alias("content"))
    rows = stored(keyed.select(id_column, F.octet_length("text").cast("long").alias("n_bytes"), "content"), "token_rows")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = lambda: spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == F.lit(version)).select("content", "n_tokens")
    misses = keyed.groupBy("content").agg(F.first("text").alias("text")).join(known().select("content"), "content", "left_anti")
    encoded(misses, tokenizer).select(F.lit(version).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    counts = known().groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # one row even if two writers appended the same content
    # contents with more than a thousandth of the rows are a thousand at most: their rows meet them in a broadcast, not in one task
    hot = rows.groupBy("content").count().where(F.col("count") > rows.count() // 1000).select("content")
    hot = stored(hot.join(counts, "content"), "token_hot")
    rows = rows.join(F.broadcast(hot.withColumnRenamed("n_tokens", "hot_tokens")), "content", "left")
    rest = rows.where("hot_tokens is null").join(counts, "content").select(id_column, "n_bytes", "n_tokens")
    both = rows.where("hot_tokens is not null").select(id_column, "n_bytes", F.col("hot_tokens").alias("n_tokens")).union(rest)
    return both.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache lies in the shared folder and stays for later runs."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), f"{shared_dir(spark)}/token_cache")
