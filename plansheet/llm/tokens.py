"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at ASCII white space and before the ASCII marks that end a word, which no token of the vocabulary crosses: its
normalizer turns white space into separators, its splitter drops them and parts letters and digits from marks, so the
parts' tokens in a row are the text's tokens. Texts are gathered into batches of about `batch_bytes` bytes whatever
their lengths, and a longer text spans several batches. Arrow splits a batch into words and numbers the distinct ones;
only parts not met before are encoded, in calls balanced by bytes, and counts are gathered by word number. The memo
holds parts of at most MEMO_BYTES bytes and is cut to its first half at a bound. Vocabularies that keep white space
aren't for this operator.

Nulls and empty texts count 0 bytes and 0 tokens. Repeated rows are counted each for itself; other columns than the
id and the text are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import table

_SPACE = re.compile(rb"[ \t-\r]")
#: Marks at a word's end, after a digit, an ASCII letter or a Latin-1 one: a token's boundary in any case.
_MARKS = r"([A-Za-z0-9]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([!-/:-@\[-`{-~]+)$"
MEMO_BYTES = 64  # longer parts hardly come again


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCodes:
    """Ids (little-endian unsigned 32 bits) or counts of texts, by parts that are memoized up to a bound."""

    def __init__(self, path: str, lengths: bool, memo_entries: int = 320_000, call_bytes: int = 1 << 16):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.lengths = Tokenizer.from_file(path), lengths
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, object] = {}
        self.long: dict[bytes, object] = {}  # of the parts asked for last, those not for the memo
        self.memo_entries, self.call_bytes = memo_entries, call_bytes
        self.special = {t.content.encode().lower()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()} | {b"\xcc", b"\xcd"}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.plain = None
        if suffix:  # words that the normalizer leaves as they are share a call; a token with the suffix ends each
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def _put(self, part: bytes, value: object) -> None:
        (self.memo if len(part) <= MEMO_BYTES else self.long)[part] = value

    def _each(self, raw: list[bytes]) -> None:
        for part, e in zip(raw, self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in raw], add_special_tokens=False)):
            self._put(part, len(e.ids) if self.lengths else np.array(e.ids, "<u4").tobytes())

    def _joined(self, raw: list[bytes]) -> None:
        [e] = self.plain.encode_batch_fast([b" ".join(raw).decode()], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        ends = np.nonzero(self.ends[ids])[0] + 1
        if len(ends) != len(raw):
            return self._each(raw)
        if self.lengths:
            values = np.diff(ends, prepend=0).tolist()
        else:
            held, at = ids.tobytes(), (4 * ends).tolist()
            values = [held[a:b] for a, b in zip([0, *at[:-1]], at)]
        for part, value in zip(raw, values):
            self._put(part, value)

    def learn(self, new: set[bytes]) -> None:
        """Encode the parts that are new, in calls balanced by bytes."""
        self.long.clear()
        if len(self.memo) > self.memo_entries:  # what was met first is what is common
            self.memo = dict(itertools.islice(self.memo.items(), self.memo_entries // 2))
        plain, other = [], []
        for part in new.difference(self.memo):
            if self.plain is not None and (part.islower() if part.isalpha() else _letters(part)):
                plain.append(part)
            else:
                other.append(part)
        for parts, run in ((plain, self._joined), (other, self._each)):
            at = size = 0
            for k, part in enumerate(parts, 1):
                size += len(part)
                if size >= self.call_bytes or k == len(parts):
                    run(parts[at:k])
                    at, size = k, 0

    def _values(self, parts: list[bytes]) -> list:
        """What each of the distinct parts of a batch gives."""
        out = list(map(self.memo.get, parts))
        new = [k for k, v in enumerate(out) if v is None and parts[k]]
        self.learn({parts[k] for k in new})
        for k in new:
            p = parts[k]
            out[k] = self.memo[p] if len(p) <= MEMO_BYTES else self.long[p]
        nothing = 0 if self.lengths else b""
        return [nothing if v is None else v for v in out]

    def _parts(self, texts: list[bytes], cut: bool) -> tuple[np.ndarray, np.ndarray, list]:
        """Each text's end among the parts, each part's number, and what the numbers stand for."""
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string(), safe=False))
        words = lists.values.dictionary_encode()
        ends, number, distinct = lists.offsets.to_numpy()[1:], words.indices.to_numpy(), words.dictionary.cast(pa.binary())
        if cut:  # the distinct words are cut, not the text
            inside = pc.split_pattern(pc.replace_substring_regex(distinct, _MARKS, r"\1 \2"), " ")
            coded, first = inside.values.dictionary_encode(), inside.offsets.to_numpy()
            many = np.diff(first)[number]
            past = np.cumsum(many)
            number = coded.indices.to_numpy()[np.repeat(first[:-1][number] - past + many, many) + np.arange(past[-1] if len(past) else 0)]
            ends, distinct = np.concatenate([[0], past])[ends], coded.dictionary
        return ends, number, self._values(distinct.to_numpy(zero_copy_only=False).tolist())

    def _run(self, texts: list[bytes], cut: bool) -> list:
        ends, number, values = self._parts(texts, cut)
        each = np.array(values, np.int64) if self.lengths else np.fromiter(map(len, values), np.int64, len(values)) // 4
        size = each[number]
        place = np.concatenate([[0], np.cumsum(size)])
        if self.lengths:
            return np.diff(place[ends], prepend=0).tolist()
        ids = np.frombuffer(b"".join(values), "<u4")
        at = np.repeat((np.cumsum(each) - each)[number] - place[:-1], size) + np.arange(place[-1])
        held, cuts = ids[at].tobytes(), (4 * place[ends]).tolist()
        return [held[a:b] for a, b in zip([0, *cuts[:-1]], cuts)]

    def encode(self, texts: list[bytes]) -> list:
        """Ids or counts of each text.

        ASCII letters are lower-cased first, as the vocabulary does, where that can't matter to what comes before it there:
        no special string in the text and no combining mark, with which a letter might compose in one case only.
        """
        out: list = [0 if self.lengths else b""] * len(texts)
        groups: dict[bool, list[int]] = {True: [], False: []}
        texts = list(texts)
        for k, t in enumerate(texts):
            low = t.lower()
            own = not any(x in low for x in self.special)
            groups[own].append(k)
            if own:
                texts[k] = low
        for cut, rows in groups.items():
            if rows:
                for k, v in zip(rows, self._run([texts[k] for k in rows], cut)):
                    out[k] = v
        return out


def _letters(part: bytes) -> bool:
    """Whether a part is lower-case letters up to the Latin blocks, which the normalizer leaves as they are."""
    x = part.decode("utf-8", "replace")
    return x.isalpha() and max(x) < "\u0250" and x == x.lower()


_CODES: dict[tuple, WordCodes] = {}


def word_codes(path: str, lengths: bool) -> WordCodes:
    """One for each Python worker, kept from task to task."""
    if (path, lengths) not in _CODES:
        _CODES[path, lengths] = WordCodes(path, lengths)
    return _CODES[path, lengths]


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """data in parts of about size bytes, each but the last ending before white space."""
    at = 0
    while len(data) - at > size and (m := _SPACE.search(data, at + size)):
        yield data[at : m.start()]
        at = m.start()
    yield data[at:] if at else data


def balanced(texts: pa.Array, size: int) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Groups of (row, piece, whether it is the row's last) of about size bytes; a longer text is in several groups."""
    group, held = [], 0
    for row in range(len(texts)):
        data = texts[row].as_py() or b""
        *more, last = pieces(data, size)
        for k, piece in enumerate([*more, last]):
            group.append((row, piece, k == len(more)))
            held += len(piece)
            if held >= size:
                yield group
                group, held = [], 0
    if group:
        yield group


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", context: int = 2048, batch_bytes: int = 4 << 20) -> DataFrame:
    """id, n_bytes, n_tokens and whether n_tokens is over `context`, for each row of df."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = word_codes(path, True)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            counts = [0] * len(texts)
            for group in balanced(texts, batch_bytes):
                for (row, _, _), n in zip(group, codes.encode([piece for _, piece, _ in group])):
                    counts[row] += n
            yield pa.RecordBatch.from_arrays([batch.column("id"), pc.binary_length(texts).fill_null(0).cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > context).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary())
