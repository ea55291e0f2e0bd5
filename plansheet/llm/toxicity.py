"""Toxicity with a noisy channel: obfuscated words are restored before they are scored.

Language model: letter trigrams (28 symbols) counted over all documents. Restoration: a white-space token with digits,
symbols, marks or a letter twice in a row, or a run of two or more single characters, is a lattice: a digit or symbol
may stand for a letter that looks like it, a mark or space may be dropped or end a word, a repeated letter may be
dropped. Viterbi's path under the model and the channel's costs is the restored text, and its words are scored beside
the written ones. Tokens and runs are decoded whole, whatever their length; the cost is linear in it.

Classifier: a decision list of word beginnings and whole words, fitted on at most `per_class` labelled rows of each
class (chosen by a hash of the id, equal texts once): among features with support in toxic rows and next to none in
others, the one that explains most toxic rows not yet explained is taken, again and again. Of features that the same
toxic rows have, equally often in others, one goes to the driver; the rest could never be taken after it. A feature's
weight is its smoothed share of toxic rows, and a text's score is 1 - product(1 - weight) over its features, or the
rest's rate where it has none. Only texts are inputs of a score.

The distinct tokens of about GROUP bytes of texts are looked at together, each once; what a worker holds is those and
a memo of at most `memo_entries` tokens of up to MEMO_CHARS characters.

Null and empty texts get the rate of rows without features. Rows without a usable label, or whose labels contradict each
other, are not learnt from. Repeated rows are scored each. Without labels every score is `PRIOR`. Other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import hidden, materialize, shown, table

SYMBOLS = 28  # end of word, a-z, another letter
PRIOR = 0.05
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
MARKS = set(".-_*~'`,:;/\\^=#")
LEET, KEEP_MARK, DROP_MARK, DROP_RUN, DROP_PAIR, BREAK = 0.7, 1.0, 0.5, 0.3, 3.0, 5.0
MEMO_CHARS = 40  # longer tokens hardly come again
GROUP = 1 << 20


def _classes() -> np.ndarray:
    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        x = chr(c).lower()[0]
        out[c] = ord(x) - 96 if "a" <= x <= "z" else 27 if x.isalpha() else 0
    return out


_CLASS = _classes()


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    return np.where(c < 0x250, _CLASS[np.minimum(c, 0x24F)], 27).astype(np.int32)


def groups(texts: pa.Array, size: int = GROUP) -> Iterator[pa.Array]:
    """texts in slices of about size bytes; a longer text is a slice of its own."""
    at = held = 0
    for k, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + n > size:
            yield texts.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(texts):
        yield texts.slice(at)


def count_trigrams(texts: list[str], total: np.ndarray, size: int = 1 << 17) -> None:
    """Adds each text's trigrams, a word's end before and after it, to total; runs of about size symbols at a time."""
    held = np.zeros(0, np.int32)
    ends = np.cumsum([len(t) + 1 for t in texts])  # texts are parted by one symbol 0, whose place in line is its text's end less 1; no trigram has it in the middle
    line, at = "\n".join(texts), 0
    while at <= len(line):
        part = symbols(line[at : at + size])
        s = np.concatenate([held if at else [0], part, [0] * (at + size > len(line))]).astype(np.int64)
        first = at - len(held) if at else -1  # the place in line of s[0]
        n = len(s) - 2
        if n > 0:
            cells = s[:-2] * (SYMBOLS * SYMBOLS) + s[1:-1] * SYMBOLS + s[2:]
            lo, hi = np.searchsorted(ends, [first + 2, first + 2 + n])
            total += np.bincount(cells, minlength=SYMBOLS**3) - np.bincount(cells[ends[lo:hi] - 2 - first], minlength=SYMBOLS**3)
        held, at = s[-2:], at + size


def trigram_counts(df: DataFrame) -> np.ndarray:
    """Counts of symbol trigrams over all texts; what reaches the driver is a number for each trigram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for part in groups(batch.column("text").cast(pa.binary())):
                count_trigrams([(t or b"").decode("utf-8", "replace") for t in part.to_pylist()], total)
        cells = np.nonzero(total)[0]
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(total[cells])], ["cell", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    for r in df.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of a symbol after two others, backed off to one and none."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    one = (c.sum((0, 1)) + 1) / (c.sum() + SYMBOLS)
    two = (c.sum(0) + 20 * one) / (c.sum(0).sum(1, keepdims=True) + 20)
    return np.log((c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20))


def _written(path: tuple) -> str:
    out = []
    while path:
        path, x = path
        out.append(x)
    return "".join(reversed(out))


def restore(token: str, model: list, spaced: bool = False) -> str:
    """The likeliest words of a token's lattice, with a space between words."""
    token = token.lower()
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # paths are linked, so that steps copy no text
    for i, ch in enumerate(token):
        repeat = i > 0 and ch == token[i - 1]
        run = repeat and (i > 1 and token[i - 2] == ch or i + 1 < len(token) and token[i + 1] == ch)
        options: list[tuple[int, str, float]] = []
        if ch.isalpha():
            options.append((int(_CLASS[ord(ch)]) if ord(ch) < 0x250 else 27, ch, 0.0))
            if repeat:
                options.append((-1, "", DROP_RUN if run else DROP_PAIR))
        elif ch in LOOKS_LIKE:
            options += [(ord(x) - 96, x, LEET) for x in LOOKS_LIKE[ch]]
            options.append((0, " ", BREAK))
            if repeat:
                options.append((-1, "", DROP_RUN if run else DROP_PAIR))
        elif ch == " " or ch in MARKS:
            options += [(0, " ", KEEP_MARK + spaced), (-1, "", 0.0 if spaced else DROP_MARK)]
        else:
            options.append((0, " ", 0.0))
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, out) in best.items():
            row = model[a][b]
            for c, x, extra in options:
                if c < 0:
                    key, value = (a, b), (cost + extra, out)
                elif c == 0 and b == 0:
                    key, value = (a, b), (cost + extra, out)
                else:
                    key, value = (b, c), (cost + extra - row[c], (out, x))
                if key not in new or value[0] < new[key][0]:
                    new[key] = value
        best = new
    ends = [(cost - (model[a][b][0] if b else 0.0), out) for (a, b), (cost, out) in best.items()]
    least = min(cost for cost, _ in ends)
    return min(_written(out) for cost, out in ends if cost == least)


_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[\d@$!|+(€£]")
_JOINED = re.compile(r"[^\W\d_][.\-_*~'`,:;/\\^=#]+[^\W\d_]")
_TWICE = re.compile(r"([^\W\d_])\1", re.IGNORECASE)


def noisy(token: str) -> bool:
    """Whether a token has symbols that look like letters, marks between letters, or a letter twice in a row."""
    return bool(len(token) > 1 and _SYMBOL.search(token) or _JOINED.search(token) or _TWICE.search(token))


def token_words(token: str, model: list) -> set[str]:
    """The words of a white-space token, as written and as restored."""
    words = set(_WORD.findall(token.lower()))
    bare = token.strip(".,;:!?\"'()[]{}")
    if noisy(bare):
        words |= set(_WORD.findall(restore(bare, model)))
    return words


def spaced_words(tokens: list[str], model: list) -> set[str]:
    """Words spelt out over runs of single characters."""
    out: set[str] = set()
    run: list[str] = []
    for t in [*tokens, ""]:
        if len(t) == 1 and not t.isspace():
            run.append(t)
        else:
            if len(run) > 1:
                words = _WORD.findall(restore(" ".join(run), model, True))
                out |= {w[k:] for w in words for k in range(3) if len(w) > k}  # single letters before it may have stuck
            run = []
    return out


def features(words: set[str]) -> set[str]:
    return {f"{w}$" for w in words} | {w[:k] for w in words for k in (4, 5, 6) if len(w) >= k}


def gathered(texts: pa.Array, found: Callable[[str], Collection[str]], spelt: Callable[[list[str]], Collection[str]]) -> list[set[str]]:
    """For each text what its tokens, each distinct one looked at once, and its runs of single characters give."""
    out: list[set[str]] = [set() for _ in range(len(texts))]
    lists = pc.ascii_split_whitespace(texts.fill_null(b"").cast(pa.string(), safe=False))
    words = lists.values.dictionary_encode()
    number, doc = words.indices.to_numpy(), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    names = [w.decode("utf-8", "replace") for w in words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()]
    parts = [w.split() for w in names]  # other white space than ASCII's
    sets = [found(p[0]) if len(p) == 1 else set().union(*map(found, p)) for p in parts]
    at = np.nonzero(np.fromiter(map(bool, sets), bool, len(sets))[number])[0]
    for k in np.unique(doc[at] * len(names) + number[at]).tolist():
        out[k // len(names)].update(sets[k % len(names)])
    odd = np.fromiter((w != "" and p != [w] for w, p in zip(names, parts)), bool, len(names))[number]
    slow = set(doc[odd].tolist())
    for d in slow:
        out[d].update(spelt((texts[d].as_py() or b"").decode("utf-8", "replace").split()))
    one = np.nonzero(np.fromiter((len(p) == 1 and len(p[0]) == 1 for p in parts), bool, len(names))[number])[0]
    for run in np.split(one, np.nonzero((np.diff(one) > 1) | (np.diff(doc[one]) > 0))[0] + 1):
        if len(run) > 1 and (d := int(doc[run[0]])) not in slow:
            out[d].update(spelt([names[k] for k in number[run].tolist()]))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(id, toxic, text) of at most per_class labelled rows of each class, none of them held out."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_x")).where("toxic = _x")
    picked = None
    for c in (1, 0):
        part = known.where((F.col("toxic") > 0) == bool(c)).select(F.col("doc_id").alias("id"), F.lit(c).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("id"))  # 2 * per_class rows at most
    return rows.select("id", "toxic", "text").dropDuplicates(["text", "toxic"])


def featured(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """(row, toxic, features) of rows (toxic, text), stored: the sample is restored once."""
    lm = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lm.value.tolist()
        for batch in batches:
            at = 0
            for part in groups(batch.column("text").cast(pa.binary())):
                got = gathered(part, lambda t: features(token_words(t, m)), lambda run: features(spaced_words(run, m)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(at, len(part)), pa.array(map(list, got), pa.list_(pa.string()))], ["toxic", "features"])
                at += len(part)
        pa.default_memory_pool().release_unused()

    out = rows.select("toxic", "text").mapInArrow(run, "toxic int, features array<string>")
    return materialize(out.select(F.monotonically_increasing_id().alias("row"), "toxic", "features"), "toxic-features")


def telling(seen: DataFrame, toxic: int, clean: int, support: int) -> list[tuple[str, int, int]]:
    """(feature, toxic rows, clean rows) of the features that the list may take, one of those alike, best first."""
    bad = F.col("toxic") == 1
    each = seen.select("row", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"),
        *(F.bit_xor(F.when(bad, F.xxhash64("row", F.lit(k)))).alias(f"x{k}") for k in (1, 2)),
    )
    enough = (F.col("t") / toxic > 20 * F.col("c") / clean) & (F.col("t") - 3 * toxic / clean * F.col("c") >= support)
    alike = each.where(enough).groupBy("t", "c", "x1", "x2").agg(F.max(F.struct((-F.length("feature")).alias("n"), F.col("feature").alias("f"))).alias("best"))
    return sorted(((r["f"], r["t"], r["c"]) for r in alike.select("best.f", "t", "c").collect()), key=lambda r: (-len(r[0]), r[0]), reverse=True)


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, per_class: int = 10_000, support: int = 3) -> dict:
    """The decision list: feature weights, and the rate of toxic rows among those without features."""
    sc = docs.sparkSession.sparkContext
    seen = featured(sample_rows(docs, labels, per_class), model)
    counts = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return {"weights": {}, "rest": PRIOR}
    figures = telling(seen, toxic, clean, support)
    names = sc.broadcast({f: k for k, (f, _, _) in enumerate(figures)})

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for batch in batches:
            got = [sorted(known[f] for f in fs if f in known) for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32()))], ["features"])

    holds = [np.array(r["features"], np.int64) for r in seen.where("toxic = 1").select("features").mapInArrow(matched, "features array<int>").collect()]  # per_class rows at most
    flat, starts = np.concatenate([np.empty(0, np.int64), *holds]), np.cumsum([0] + [len(h) for h in holds])
    order, row = np.argsort(flat, kind="stable"), np.repeat(np.arange(len(holds)), np.diff(starts))
    row, first = row[order], np.searchsorted(flat[order], np.arange(len(figures) + 1))
    share = toxic / clean  # a clean row in the sample stands for as many as a toxic one at even rates
    gain = np.diff(first) - 3 * share * np.array([c for _, _, c in figures], float)
    left = np.ones(len(holds), bool)
    weights: dict[str, float] = {}
    while len(gain) and gain[k := int(np.argmax(gain))] >= support:
        f, t, c = figures[k]
        weights[f] = (t + 0.5 * PRIOR) / (t + c * share + 0.5)
        new = row[first[k] : first[k + 1]]
        new = new[left[new]]
        left[new] = False
        for r in new.tolist():
            gain[flat[starts[r] : starts[r + 1]]] -= 1
        gain[k] = -np.inf
    rest = (left.sum() + 0.5) / (left.sum() + 9 * len(left) + 1)
    return {"weights": weights, "rest": float(min(0.45, rest))}


def score(docs: DataFrame, fitted: dict, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", memo_entries: int = 200_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score, *keep) for each row. The list and the model are of bounded size and broadcast."""
    sc = docs.sparkSession.sparkContext
    lm, told = sc.broadcast(model), sc.broadcast(fitted)
    text = text_col if text_col in keep else "_text"
    src = docs.select(F.col(id_col).alias("_id"), *([] if text_col in keep else [F.col(text_col).cast("string").alias(text)]), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, weights, rest = lm.value.tolist(), told.value["weights"], told.value["rest"]
        heads = {f[:4] for f in weights}
        none: tuple[str, ...] = ()
        memo: dict[str, tuple[str, ...]] = {}

        def hits(words: set[str]) -> tuple[str, ...]:
            some = {w for w in words if w[:4] in heads or f"{w}$" in weights}
            return tuple(f for f in features(some) if f in weights) if some else none

        def found(token: str) -> tuple[str, ...]:
            h = memo.get(token)
            if h is None:
                h = hits(token_words(token, m))
                if len(token) <= MEMO_CHARS:
                    memo[token] = h
            return h

        for batch in batches:
            out: list[float] = []
            for part in groups(batch.column(text).cast(pa.binary())):
                if len(memo) > memo_entries:
                    memo.clear()
                for got in gathered(part, found, lambda run: hits(spaced_words(run, m))):
                    out.append(1.0 - math.prod(1.0 - weights[f] for f in sorted(got)) if got else rest)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.float64()), *(batch.column(c) for c in keep)], ["_id", "score", *keep])
        memo.clear()
        pa.default_memory_pool().release_unused()

    kinds = "".join(f", `{c}` {src.schema[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, score double{kinds}").withColumnRenamed("_id", id_col)


def trained(docs: DataFrame, labels: DataFrame, per_class: int = 10_000) -> tuple[dict, np.ndarray]:
    model = log_model(trigram_counts(docs))
    return fit(docs, labels, model, per_class), model


def keep_clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """docs without the rows that score `limit` or more."""
    fitted, model = trained(docs, labels)
    df, names = hidden(docs, ("doc_id", "text"))
    out = score(df.withColumn("_key", F.lit(0)), fitted, model, "_key", keep=tuple(names.values()))
    return shown(out.where(F.col("score") < limit), names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fitted, model = trained(docs, table(spark, sf_dir, "labels"))
    out = score(docs, fitted, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
