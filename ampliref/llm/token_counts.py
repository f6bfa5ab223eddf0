"""Token counts by a map-side lookup in two tiers.

Tier one is broadcast: the token count of every string of the tokenizer's own vocabulary, which are the strings that
byte-pair training found frequent; its size is that of the vocabulary. Tier two is a bounded cache in each worker:
pre-tokens that tier one misses are encoded once, in batches, by the tokenizer itself. No pre-token is ever shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import alone, chunks

#: Pre-tokens kept by a worker; beyond it the cache starts anew.
CACHE_ENTRIES = 300_000

# Fixed value: the public byte-level pre-tokenizer pattern, with white space spelt out as Unicode's White_Space
# property, since the regex module counts U+001C..U+001F as white space and the tokenizer does not.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast tier, then what this worker has encoded."""

    def __init__(self, model: str, frequent: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.frequent = frequent
        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t["content"] for t in json.loads(model).get("added_tokens", [])]
        self.find = regex.compile(PRE_TOKEN).findall

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, misses: list[str]) -> None:
        if len(self) + len(misses) > CACHE_ENTRIES + len(self.frequent):
            self.clear()
            self.update(self.frequent)
        self.update(zip(misses, (len(e.ids) for e in self.tokenizer.encode_batch(misses, add_special_tokens=False))))

    def count(self, texts: list[str]) -> list[int]:
        split = [None if any(s in t for s in self.special) else self.find(t) for t in texts]
        need = set(chain.from_iterable(x for x in split if x))
        if misses := sorted(need.difference(self)):
            self.learn(misses)
            if not need.issubset(self):  # the cache began anew
                self.learn(sorted(need.difference(self)))
        get = self.__getitem__
        return [self.whole(t) if x is None else sum(map(get, x)) for t, x in zip(texts, split)]


_WORKER: dict[str, Lengths] = {}


def _lengths(key: str, model: str, frequent: dict[str, int]) -> Lengths:
    """The worker's own, as a function of the module: a kernel's globals are copied for each task."""
    if key not in alone(_WORKER):
        _WORKER.clear()
        _WORKER[key] = Lengths(model, frequent)
    return _WORKER[key]


def check_model(model: str) -> None:
    """Refuses a file that doesn't cut texts as PRE_TOKEN does, or whose counts aren't a sum over pre-tokens."""
    spec = json.loads(model)
    cut = spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if not plain or spec.get("normalizer") or spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        raise ValueError("only byte-level BPE files with the byte-level pre-tokenizer, without prefix space, normaliser and dropout are supported")


def frequent_lengths(model: str) -> dict[str, int]:
    """Tier one. Vocabulary strings are read back through the tokenizer, so each has the count that it gives."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(model)
    strings = [s for s in tok.decode_batch([[i] for i in range(tok.get_vocab_size())], skip_special_tokens=True) if s and "�" not in s]
    import regex

    one = regex.compile(PRE_TOKEN)
    strings = [s for s in dict.fromkeys(strings) if one.fullmatch(s)]
    return dict(zip(strings, (len(e.ids) for e in tok.encode_batch(strings, add_special_tokens=False))))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of the tokenizers library without special tokens added; special strings inside a text count as
    that library counts them by default. Null text counts as empty (0 tokens). Repeated rows give repeated results;
    other columns are ignored. tokenizer_path: a byte-level BPE file, read on the driver and broadcast; another kind
    raises ValueError.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    check_model(model)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, frequent_lengths(model)))
    key = tokenizer_path

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(key, *shared.value)
        for batch in chunks(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = lengths.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
