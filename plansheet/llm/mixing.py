"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sources by code point (null last) weigh 5, 2, 1 and so on again; together they are to give `share` times all words, no
source more than `most` times its own, and what a source can't take is shared again by weight. A source's documents
are shuffled (by the MD5 of seed and id) and laid end to end, and every `block` words of that line are a block, the last
one shorter. Slot i of the schedule goes to the source in whose part of the cumulative targets the golden-ratio point
frac(i * phi) falls, in 32-bit integers, so that no digits are lost however many slots there are; the k-th slot of a
source takes block k of its line, from the start again after the last. A source's last slot is cut at its target, and the
few slots it lacks by the sequence's discrepancy are appended, each with a number of its own, so a source's taken words
are its target to the nearest word. The mix is in the order of its slots, where sources alternate by their targets.

Nothing is ordered in one task: positions and ranks are sums over hash buckets or runs of slots plus a sum inside one,
and points meet the sources' parts by cells of the unit interval. A name and some figures per source reach the driver;
whether they are broadcast is Spark's decision by their size.

Null texts have size 0; documents without words are taken 0 times. A null source is a source, the last. Null ids are
shuffled as the text "null". Repeated rows are documents of their own; other columns are kept in the mix as documents, and
ignored otherwise; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansheet.llm._common import WORD, hidden, materialize, shown, shuffle_parts, table

WEIGHTS = (5, 2, 1)
PHI = 2654435769  # the golden ratio's part after the point, times 2 ** 32
RUN = 1 << 16  # slots ranked in one task


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Water filling: by weight, at most `most` times the size, the excess shared again until none is above."""
    total, rest = share * sum(sizes), float(sum(weights))
    out = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        level = total / rest if rest else 0.0
        if most * sizes[i] <= level * weights[i]:
            out[i] = most * sizes[i]
            total -= out[i]
            rest -= weights[i]
        else:
            for j in order[k:]:
                out[j] = level * weights[j]
            break
    return out


def source_plan(sized: DataFrame, block: int, share: float, most: float) -> DataFrame:
    """A row for each source: name, number, size, target, words to take, blocks, slots, and its part [low, high) of 2 ** 32 points."""
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # a name and a number for each source
    rows = sorted(rows, key=lambda r: (r["source"] is None, str(r["source"]) if r["source"] is not None else ""))
    sizes, weights = [r["n"] for r in rows], [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(rows))]
    goals = targets(sizes, weights, share, most)
    out, at, total = [], 0.0, sum(goals) or 1.0
    for i, (r, goal) in enumerate(zip(rows, goals)):
        take, size = int(goal + 0.5), r["n"]
        per_epoch = -(-size // block)
        slots = 0 if not size else take // size * per_epoch + -(-(take % size) // block)
        low, at = int(at / total * (1 << 32) + 0.5), at + goal
        out.append((r["source"], i, size, goal, take, per_epoch, slots, low, int(at / total * (1 << 32) + 0.5)))
    return spark.createDataFrame(out, "source string, src int, source_size long, target double, take long, blocks long, slots long, low long, high long")


def placed(sized: DataFrame, plan: DataFrame, seed: int = 0, buckets: int = 3) -> DataFrame:
    """sized (doc_id, source, size, ...) with its source's figures and `at`, its first word's place in the shuffled line."""
    df = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(plan["source"]).withColumnRenamed("source", "_source")
    df = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("_bucket", F.substring("_h", 1, buckets))
    base = df.groupBy("src", "_bucket").agg(F.sum("size").alias("_n"))
    base = base.select("src", "_bucket", F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("src", "_bucket").orderBy("_h", "doc_id", "size", *(c for c in sized.columns if c not in ("doc_id", "source", "size")))
    df = df.join(base, ["src", "_bucket"])
    return df.withColumn("at", F.col("_base") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).drop("_h", "_bucket", "_base")


def point(i: Column) -> Column:
    """i * PHI modulo 2 ** 32, in two steps that can't overflow."""
    low32 = i.bitwiseAND(F.lit((1 << 32) - 1))
    high = (F.shiftright(low32, 16) * F.lit(PHI)).bitwiseAND(F.lit((1 << 16) - 1))
    return (F.shiftleft(high, 16) + low32.bitwiseAND(F.lit((1 << 16) - 1)) * F.lit(PHI)).bitwiseAND(F.lit((1 << 32) - 1))


def schedule(spark: SparkSession, plan: DataFrame, block: int) -> DataFrame:
    """Slots (slot, src, k, epoch, block, words): which block of which source comes when, and how much of it is taken."""
    total, n = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    shift = 32 - max(10, n.bit_length())  # about as many cells as sources, so that few sources share a cell
    own = plan.where("high > low").select("src", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("_cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), point(F.col("id")).alias("_u")).withColumn("_cell", F.shiftright("_u", shift))
    slots = slots.join(own, "_cell").where("_u >= low and _u < high").select("slot", "src").withColumn("_run", F.expr(f"slot div {RUN}"))
    runs = slots.groupBy("src", "_run").agg(F.count(F.lit(1)).alias("_n"))
    base = runs.select("src", "_run", F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    ranked = slots.join(base, ["src", "_run"]).withColumn("k", F.col("_base") + F.row_number().over(Window.partitionBy("src", "_run").orderBy("slot")) - 1)
    had = runs.groupBy("src").agg(F.sum("_n").alias("_had"))
    lacking = plan.join(had, "src", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).where("_had < slots")
    before = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)  # a row for each source
    lacking = lacking.withColumn("_first", F.lit(total) + F.coalesce(F.sum(F.col("slots") - F.col("_had")).over(before), F.lit(0)))
    appended = lacking.select("src", "_first", "_had", F.explode(F.sequence(F.col("_had"), F.col("slots") - 1)).alias("k")).select((F.col("_first") + F.col("k") - F.col("_had")).alias("slot"), "src", "k")
    every = ranked.select("slot", "src", "k").unionByName(appended).join(plan.select("src", "source_size", "take", "blocks", "slots"), "src").where("k < slots")
    every = every.withColumn("block", F.expr("k % blocks")).withColumn("epoch", F.expr("k div blocks"))
    words = F.least(F.lit(block), F.expr(f"source_size - block * {block}"), F.expr(f"take - epoch * source_size - block * {block}"))
    return every.select("slot", "src", "k", "epoch", "block", words.cast("long").alias("words"))


def mixture(at: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """The mix itself: for each slot the documents' runs of words (doc_id, src, at, size, slot, epoch, first, n)."""
    parts = at.where("size > 0").select("doc_id", "src", "at", "size", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))).alias("block"))
    parts = parts.withColumn("_lo", F.greatest("at", F.expr(f"block * {block}"))).withColumn("_hi", F.least(F.expr("at + size"), F.expr(f"(block + 1) * {block}")))
    out = parts.join(slots, ["src", "block"]).withColumn("n", F.least("_hi", F.expr(f"block * {block} + words")) - F.col("_lo"))
    return out.where("n > 0").select("doc_id", "src", "at", "size", "slot", "epoch", (F.col("_lo") - F.col("at")).alias("first"), "n")


def mix(df: DataFrame, block: int = 1024, share: float = 1.5, most: float = 2.0, seed: int = 0, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Each document's place and its source's figures with the columns in keep, stored, and the mixture."""
    spark = df.sparkSession
    sized = materialize(df.select("doc_id", "source", words_in(F.col("text")).alias("size"), *keep), "mix-sizes")
    plan = source_plan(sized, block, share, most)
    at = materialize(placed(sized, plan, seed), "mix-places")
    return at, mixture(at, schedule(spark, plan, block), block)


def addressed(df: DataFrame) -> DataFrame:
    """df with each row's file and place there, by which it can be told from rows like it; stored first if it isn't read from files."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_line"))
    except AnalysisException:
        return addressed(materialize(df, "mix-documents"))


def mixed(df: DataFrame, slots: bool = False, **how) -> DataFrame:
    """The mix as documents in the order of its slots: a row of df for each time it is taken, its text cut where a source's
    last slot ends. With slots, the slot where a row begins and the number of the copy follow."""
    plain, names = hidden(df)
    if slots:
        names |= {"slot": "_slot", "copy": "_copy"}
    rows = addressed(df)
    rows = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, plain.columns)), "_file", "_line")
    at, runs = mix(rows, keep=("_file", "_line"), **how)
    taken = runs.groupBy("src", "at", "epoch").agg(F.sum("n").alias("_taken"), F.min("slot").alias("_slot"))
    taken = at.where("size > 0").select("_file", "_line", "src", "at", "size").join(taken, ["src", "at"])
    taken = materialize(taken.select("_file", "_line", F.col("at").alias("_at"), F.col("size").alias("_size"), F.col("epoch").alias("_copy"), "_taken", "_slot"), "mix-taken")
    out = rows.join(taken, ["_file", "_line"])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_taken").cast("int")), " ")
    whole = F.col("_taken") >= F.col("_size")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(cut)))
    out = out.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    return shown(out.repartitionByRange(shuffle_parts(df.sparkSession), "_slot", "_at").sortWithinPartitions("_slot", "_at"), names)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, runs = mix(table(spark, sf_dir, "documents"))
    taken = runs.groupBy("src", "at").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    some = at.where("size > 0").join(taken, ["src", "at"], "left")
    none = at.where("size = 0")
    out = some.unionByName(none, allowMissingColumns=True)
    return out.select("doc_id", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_slots")), "first_slot")


#: The same schedule in SQL: points, their sources, ranks, and the slots over each document's blocks.
OP4_SQL = r"""
with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
stat as (select source, sum(size)::bigint as source_size from sized group by source),
numbered as (select *, row_number() over (order by source nulls last) as j from stat),
weighed as (select *, case (j - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as w from numbered),
ratio as (select *, row_number() over (order by 2e0 * source_size / w, source nulls last) as k from weighed),
run as (select *, 1.5e0 * sum(source_size) over () - coalesce(sum(2e0 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0e0) as rest,
  sum(w) over (order by k rows between current row and unbounded following) as weights from ratio),
free as (select coalesce(min(k), 1000000) as k0 from run where 2e0 * source_size > rest / weights * w),
level as (select rest / weights as l from run, free where k = k0),
goal as (select source, j, source_size, case when k < k0 then 2e0 * source_size else (select l from level) * w end as target from run, free),
taking as (select *, cast(floor(target + 0.5e0) as bigint) as take, sum(target) over (order by j rows between unbounded preceding and current row) / sum(target) over () as upto,
  cast(ceil(source_size / 1024e0) as bigint) as blocks from goal),
plan as (select *, cast(floor(coalesce(lag(upto) over (order by j), 0e0) * 4294967296e0 + 0.5e0) as bigint) as low, cast(floor(upto * 4294967296e0 + 0.5e0) as bigint) as high,
  case when source_size = 0 then 0 else take // source_size * blocks + cast(ceil((take % source_size) / 1024e0) as bigint) end as slots from taking),
points as (select i as slot, (i * 2654435769) % 4294967296 as u from (select unnest(range((select coalesce(sum(slots), 0)::bigint from plan))) as i)),
ranked as (select j, slot, row_number() over (partition by j order by slot) - 1 as k from points join plan on u >= low and u < high),
had as (select plan.j, slots, (select count(*) from ranked r where r.j = plan.j) as n from plan),
lack as (select j, n, slots, (select sum(slots)::bigint from plan) + coalesce(sum(greatest(slots - n, 0)) over (order by j rows between unbounded preceding and 1 preceding), 0)::bigint as base from had),
slot as (select r.j, k, slot from ranked r join plan on r.j = plan.j where k < slots
  union all select j, k, base + k - n as slot from (select *, unnest(range(n, slots)) as k from lack where n < slots)),
line as (select doc_id, size, g.*,
  sum(size) over (partition by s.source order by md5('0:' || coalesce(cast(doc_id as varchar), 'null')), doc_id, size rows between unbounded preceding and current row) - size as pos
  from sized s join plan g on s.source is not distinct from g.source),
ends as (select *, greatest(0, least(pos + size, take) - pos) as one, greatest(0, least(pos + size, take - source_size) - pos) as two from line)
select doc_id, size, source_size, target, cast(one + two as bigint) as taken,
  cast(case when one > 0 then (pos + one - 1) // 1024 - pos // 1024 + 1 else 0 end + case when two > 0 then (pos + two - 1) // 1024 - pos // 1024 + 1 else 0 end as bigint) as n_slots,
  case when one > 0 then slot.slot end as first_slot
from ends left join slot on slot.j = ends.j and slot.k = pos // 1024
"""
