"""Filter interaction audit: what each of five filters removes in every order they could run in, from joint-failure counts.

A document's five flags say which filters it fails. For each part (source) and each of the 32 sets of filters, the number
of documents that fail all of the set is a sum of products of flags. Everything else is inclusion-exclusion on these 32
numbers: survivors of a set are the alternating sum over its subsets (the Moebius inverse of the subset order); a step
removes the survivors of the filters before it less those after it; a filter's unique failures are the alternating sum
over the sets that hold it; and its Shapley value is the sum of the Harsanyi dividends of the sets that hold it, each
shared equally among the set's filters (times 120 that is a whole number, the sum over all orders). So the table is read
once, whatever the number of orders; the same numbers over good and toxic documents give what each step loses of these.

A copy's flags are those of its text, so documents are added up by (text, part) before texts meet across parts: a text
that a third of all rows share is a row for each task, then one for each part. Texts are compared by their SHA-256.

Null texts count as empty, and all empty texts are copies of each other. A null source is the part "", and the empty
string is the same part. A null doc_id counts as smaller than every other; rows with equal ids are no copies of each
other's smaller ids, so none of them fails E on account of the other. Repeated rows are documents of their own. A document
is good (toxic) if any row of labels for its id says 1; null labels say nothing. Other columns are ignored; an empty table
gives an empty audit.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.llm._common import WORD, materialize, table

FILTERS = "ABCDE"
SETS = range(1 << len(FILTERS))
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WEIGHTS = ("docs", "good", "toxic")


def text_flags(text: Column) -> list[Column]:
    """Flags of the filters that look at one text: too short, repetitive, too many capitals, odd symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("kinds")))
    n, kinds = F.col("_words.n"), F.col("_words.kinds")
    return [F.get(counts, F.lit(0)).alias("_words"), n < 200, 100 * kinds < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def flagged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, text_key, a, b, c, d) of documents: what each fails by itself, and its text's digest."""
    df = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words, *flags = text_flags(F.col("text"))
    df = df.withColumn("_words", words)
    return df.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("text_key"), *(f.cast("int").alias(k) for f, k in zip(flags, "abcd")))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, a, b, c, d, e, docs, good, toxic): documents of each part by the filters that they fail."""
    label = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    held = flagged(docs).join(label, "doc_id", "left")
    sums = [F.count(F.lit(1)).alias("docs"), *(F.count(k).alias(k) for k in WEIGHTS[1:])]
    held = held.groupBy("doc_id", "part", "text_key", *"abcd").agg(*sums)  # rows with one id
    age = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")  # null before all others
    first = F.min(F.struct(age.alias("age"), *WEIGHTS))
    texts = materialize(held.groupBy("text_key", "part", *"abcd").agg(*(F.sum(k).alias(k) for k in WEIGHTS), first.alias("first")), "audit-texts")
    oldest = texts.groupBy("text_key").agg(F.min("first.age").alias("oldest"))
    own = F.col("first.age") == F.col("oldest")  # this part holds the text's first document
    both = F.array(*(F.struct(F.lit(e).alias("e"), *(part(k).alias(k) for k in WEIGHTS)) for e, part in (
        (0, lambda k: F.when(own, F.col(f"first.{k}")).otherwise(0)), (1, lambda k: F.col(k) - F.when(own, F.col(f"first.{k}")).otherwise(0)))))
    split = texts.join(oldest, "text_key").select("part", *"abcd", F.explode(both).alias("s")).select("part", *"abcd", "s.*")
    return split.groupBy("part", *"abcde").agg(*(F.sum(k).alias(k) for k in WEIGHTS))


def joint_failures(seen: DataFrame) -> DataFrame:
    """(part, docs, good, toxic): for each weight an array of 32 counts, place s holding those that fail every filter of s (bit i: filter i)."""
    product = lambda k, s: " * ".join([k, *(f for i, f in enumerate("abcde") if s >> i & 1)])
    sums = seen.groupBy("part").agg(*(F.expr(f"sum({product(k, s)})").alias(f"{k}{s}") for k in WEIGHTS for s in SETS))
    return sums.select("part", *(F.array(*(f"{k}{s}" for s in SETS)).alias(k) for k in WEIGHTS))


def _summed(joint: str, term: str) -> str:
    """The sum over all sets t of a term; sign is 1 for sets of even size and -1 for others."""
    return f"aggregate(sequence(0, {len(SETS) - 1}), 0L, (x, t) -> x + {term.replace('sign', '(1 - 2 * (bit_count(t) % 2))').replace('joint', f'{joint}[t]')})"


def survivors(joint: str) -> Column:
    """For each set the number of those that fail none of its filters: the alternating sum over its subsets."""
    return F.expr(f"transform(sequence(0, {len(SETS) - 1}), s -> {_summed(joint, 'if(t & s = t, sign * joint, 0L)')})")


def unique_failures(joint: str) -> Column:
    """For each filter the number of those that fail it and no other: the alternating sum over the sets that hold it."""
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), i -> {_summed(joint, 'if(shiftright(t, i) & 1 = 1, -sign * joint, 0L)')})")


def shapley_sums(joint: str) -> Column:
    """For each filter what it removes, summed over all orders: equal shares of the dividends (the joint count, signed) of the sets that hold it."""
    return F.expr(f"transform(sequence(0, {len(FILTERS) - 1}), i -> {_summed(joint, f'if(shiftright(t, i) & 1 = 1, {len(ORDERS)} div bit_count(t) * -sign * joint, 0L)')})")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order and step; see the contract's columns in op11_filter_audit."""
    joint = materialize(joint_failures(patterns(docs, labels)), "audit-joint")  # a row for each part
    held = joint.select("part", F.col("docs").alias("joint"), unique_failures("docs").alias("unique"), shapley_sums("docs").alias("shapley"), *(survivors(k).alias(k) for k in WEIGHTS))
    steps = held.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    ran = lambda upto: F.expr("+".join(f"if(instr(filter_order, '{f}') <= {upto}, {1 << i}, 0)" for i, f in enumerate(FILTERS)))
    steps = steps.withColumns({"_before": ran("step - 1"), "_after": ran("step"), "_own": F.expr(f"ascii(substr(filter_order, step, 1)) - {ord(FILTERS[0])}")})
    gone = lambda k: F.get(k, F.col("_before")) - F.get(k, F.col("_after"))
    return steps.select(
        "part", "filter_order", "step", F.get("docs", F.col("_after")).alias("kept"), gone("docs").alias("removed"), (F.get("joint", F.col("_after") - F.col("_before")) - gone("docs")).alias("redundant"),
        F.get("unique", F.col("_own")).alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shapley", F.col("_own")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same audit by following every order: which step removes which document.
OP11_SQL = r"""
with words as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
label as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
flags as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, {
    'A': cast(len(w) < 200 as int), 'B': cast(100 * len(list_distinct(w)) < 50 * len(w) as int), 'C': cast(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) as int),
    'D': cast(regexp_matches(text, '[#$%&*|]') as int), 'E': cast(words.doc_id > min(words.doc_id) over (partition by text) as int)} as f from words left join label on words.doc_id = label.doc_id),
kinds as (select part, good, toxic, f, count(*) as n from flags group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as l),
orders as (select a.l || b.l || c.l || d.l || e.l as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
fails as (select k.*, map_from_entries([('A', f.A), ('B', f.B), ('C', f.C), ('D', f.D), ('E', f.E)]) as m, f.A + f.B + f.C + f.D + f.E as total from kinds k),
run as (select part, filter_order, step, n, good, toxic, total, m[substr(filter_order, step, 1)] as own, list_sum([m[substr(filter_order, i, 1)] for i in range(1, step)]) as before from fails, steps),
seen as (select part, filter_order, cast(step as int) as step, substr(filter_order, step, 1) as l, sum(case when own = 0 and coalesce(before, 0) = 0 then n else 0 end)::bigint as kept,
  sum(case when own = 1 and coalesce(before, 0) = 0 then n else 0 end)::bigint as removed, sum(case when own = 1 and before > 0 then n else 0 end)::bigint as redundant, sum(case when own = 1 and total = 1 then n else 0 end)::bigint as unique_fails,
  sum(case when own = 1 and coalesce(before, 0) = 0 then n * good else 0 end)::bigint as good_lost, sum(case when own = 1 and coalesce(before, 0) = 0 then n * toxic else 0 end)::bigint as toxic_lost from run group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, l) as bigint) as shapley from seen
"""
