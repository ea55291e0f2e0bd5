"""A Merkle manifest of a dataset: a digest of every document, a tree over each source, a tree over the sources, and proofs.

A document's leaf is a SHA-256 of its fields, each written with its length. Leaves of a source ascend by doc_id; every
three consecutive nodes become one until one is left, and the trees' roots, by source, become one root in the same way.

Nodes are numbered by a sort in ranges: a node's number is its place in its range plus the count of the ranges before it,
so a source with a third of all rows is many ranges. A block of 3 ** LEVELS aligned nodes is one task's group: a recursion
visits it in postorder, returns the subtree's digest, and as it unwinds appends to each contained leaf the siblings of
the node that it has just left. The blocks' roots are the nodes of the next traversal, a block's worth of levels higher,
and so on until every tree is one node; its paths are appended to those below. A block never holds more than
3 ** LEVELS nodes, whatever a source's size, and of upper levels a leaf only ever meets its block's path.

A proof is an array with an entry for each level: the siblings before and after the path's node, as bytes. Folding it with
any leaf is one aggregate over the array, which is how a copy of the data is checked against the manifest.

Null fields are written as "-". A null source is a source, the first; a null doc_id comes before the others of its source.
Equal ids go by the leaf's digest, and equal rows are leaves of their own. Other columns are ignored; a manifest of an
empty table is empty.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plansheet.llm._common import materialize, shuffle_parts, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels that one block's traversal climbs: at most 3 ** 7 = 2187 nodes a block.
LEVELS = 7
_PATH = "array<struct<before:binary,after:binary>>"


def leaf_digest(*fields: Column) -> Column:
    """The SHA-256, as bytes, of fields one after another: '-' for null, else byte count, ':' and value."""
    written = (F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields)
    return F.unhex(F.sha2(F.concat(*written), 256))


def parent(parts: list[bytes]) -> bytes:
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def climb(nodes: list[bytes], low: int, high: int, height: int, paths: list[list[tuple[bytes, bytes]]]) -> bytes:
    """The digest of the subtree over nodes[low:high], `height` levels high; its siblings are appended to every node's path."""
    if height == 0:
        return nodes[low]
    step = ARITY ** (height - 1)
    places = range(low, high, step)
    parts = [climb(nodes, at, min(at + step, high), height - 1, paths) for at in places]
    for k, at in enumerate(places):
        siblings = b"".join(parts[:k]), b"".join(parts[k + 1 :])
        for i in range(at, min(at + step, high)):
            paths[i].append(siblings)
    return parent(parts)


def height_of(n: int) -> int:
    """Levels above n nodes."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def numbered(df: DataFrame, tree: str, order: list[str], more: DataFrame | None = None) -> DataFrame:
    """df with at, a row's number in its tree by order, n, the tree's rows, and what more (_key, ...) says of the tree.

    df should be stored, as its ranges are sampled first. Trees' figures meet ranges, and rows only their range's, so a
    tree with many rows is as many keys as it has ranges.
    """
    spark = df.sparkSession
    by = [F.asc_nulls_first(c) for c in (tree, *order)]
    sorted_ = df.repartitionByRange(shuffle_parts(spark), *by).sortWithinPartitions(*by)
    placed = materialize(sorted_.withColumn("_row", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_row", 33)), "merkle-ranges")
    runs = placed.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    total = runs.groupBy(F.col("_tree").alias("_t")).agg(F.sum("_n").alias("n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    runs = runs.withColumn("_base", before).join(total, F.col("_tree").eqNullSafe(F.col("_t"))).drop("_t")
    if more is not None:
        runs = runs.join(more, F.col("_tree").eqNullSafe(F.col("_key"))).drop("_key")
    out = placed.join(runs, placed[tree].eqNullSafe(runs["_tree"]) & (F.col("_range") == F.col("_part")))
    return out.withColumn("at", F.col("_base") + F.col("_row") - F.col("_first")).drop("_row", "_range", "_part", "_n", "_first", "_base", "_tree")


def traverse(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes (tree, at, n, digest and others) with path, their siblings in their block of 3 ** levels, and top, the block's digest."""
    kind = pa.struct([("before", pa.binary()), ("after", pa.binary())])

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("at").drop_columns("_block")
        digests = t.column("digest").to_pylist()
        height = min(levels, height_of(t.column("n")[0].as_py()))
        paths: list[list[tuple[bytes, bytes]]] = [[] for _ in digests]
        top = climb(digests, 0, len(digests), height, paths)
        flat = [s for p in paths for s in p]
        steps = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.binary()) for k in (0, 1)], fields=list(kind))
        path = pa.ListArray.from_arrays(pa.array([height * i for i in range(len(digests) + 1)], pa.int32()), steps)
        return t.append_column("path", path).append_column("top", pa.array([top] * len(digests), pa.binary()))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return materialize(nodes.withColumn("_block", F.expr(f"at div {ARITY**levels}")).groupBy("tree", "_block").applyInArrow(block, f"{schema}, path {_PATH}, top binary"), "merkle-paths")


def forest(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, at, n, digest and others) with _block and path, their siblings there, and the blocks (tree, _block, _path, root) with what stands above."""
    size = ARITY**levels
    rows = traverse(nodes, levels)
    tops = rows.where(F.expr(f"at % {size} = 0")).select("tree", F.expr(f"at div {size}").alias("at"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("digest"))
    if tops.where("n > 1").isEmpty():
        blocks = tops.select("tree", F.col("at").alias("_block"), F.array().cast(_PATH).alias("_path"), F.col("digest").alias("root"))
    else:
        inner, above = forest(tops, levels)
        blocks = inner.join(above, ["tree", "_block"]).select("tree", F.col("at").alias("_block"), F.concat("path", "_path").alias("_path"), "root")
    return rows.drop("top").withColumn("_block", F.expr(f"at div {size}")), blocks


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, source, at, leaf, proof, subroot, root) and the columns of keep, digests as bytes, a row for each document."""
    keep = keep or {}
    leaves = materialize(docs.select("doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("digest"), *(c.alias(k) for k, c in keep.items())), "merkle-leaves")
    sources = numbered(materialize(leaves.select(F.lit(0).cast("bigint").alias("tree"), "source").distinct(), "merkle-sources"), "tree", ["source"])
    sources = materialize(sources, "merkle-sources")
    rows, blocks = forest(numbered(leaves, "source", ["doc_id", "digest", *keep], sources.select(F.col("source").alias("_key"), F.col("at").alias("tree"))), levels)
    subroots = materialize(blocks.where("_block = 0").select(F.col("tree").alias("at"), F.col("root").alias("digest")), "merkle-subroots")  # a row for each source
    inner, above = forest(sources.drop("source").join(subroots, "at"), levels)
    tops = inner.join(above, ["tree", "_block"]).select(F.col("at").alias("tree"), F.concat("path", "_path").alias("_above"), F.col("digest").alias("subroot"), F.col("root").alias("_root"))
    blocks = blocks.join(tops, "tree").select("tree", "_block", F.concat("_path", "_above").alias("_path"), "subroot", F.col("_root").alias("root"))
    return rows.join(blocks, ["tree", "_block"]).select("doc_id", "source", "at", F.col("digest").alias("leaf"), F.concat("path", "_path").alias("proof"), "subroot", "root", *keep)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, proof: Column) -> Column:
    """The root, as hex, that a leaf (hex) has by its proof."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(hexed(s["before"]), d, hexed(s["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """The SHA-256, as hex, of a proof's siblings as hex, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(hexed(s["before"]), hexed(s["after"]))), ""), 256)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    held = manifest(docs, {"tampered": leaf_digest(*(F.col(c) if c != "text" else tampered for c in FIELDS))})
    out = held.select("doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(F.col("root")).alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded(hexed(F.col("tampered")), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, nodes: str, top: int) -> str:
    """Views name0 (from nodes: tree, pos, digest) to the highest level, each with its siblings, and name_root; a tree ends at one node."""
    out = [f"{name}0 as (select tree, pos, digest, count(*) over (partition by tree) as n from {nodes})"]
    for k in range(top):
        out.append(f"{name}{k + 1} as (select tree, pos // 3 as pos, case when max(n) > 1 then sha256(string_agg(digest, '' order by pos)) else any_value(digest) end as digest, cast(ceil(max(n) / 3e0) as bigint) as n from {name}{k} group by 1, pos // 3)")
    return ", ".join([*out, f"{name}_root as (select tree, digest from {name}{top})"])


def _proof_sql(name: str, top: int) -> str:
    """For each node of level 0 the siblings before (b0, ...) and after (a0, ...) it on every level."""
    joins = " ".join(
        f"left join (select p.tree, p.pos, coalesce(string_agg(q.digest, '' order by q.pos) filter (q.pos < p.pos), '') as b{k}, coalesce(string_agg(q.digest, '' order by q.pos) filter (q.pos > p.pos), '') as a{k}, any_value(p.n) > 1 as u{k} "
        f"from {name}{k} p join {name}{k} q on p.tree = q.tree and p.pos // 3 = q.pos // 3 group by 1, 2) j{k} on j{k}.tree = z.tree and j{k}.pos = z.pos // {3**k}"
        for k in range(top)
    )
    return f"{name}_path as (select z.tree, z.pos, [{', '.join(f'{{b: b{k}, a: a{k}, u: u{k}}}' for k in range(top))}] as path from {name}0 z {joins})"


_FIELD = "case when {0} is null then '-' else octet_length(encode(cast({0} as varchar)))::varchar || ':' || cast({0} as varchar) end"
_CRC = ", ".join(["c0 as (select i, i as c from (select unnest(range(256)) as i))", *(f"c{k + 1} as (select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end as c from c{k})" for k in range(8)), "crc as (select list(c order by i) as t from c8)"])
#: The same trees, level by level, for up to 3 ** 12 documents a source and 3 ** 6 sources.
OP12_SQL = f"""
with {_CRC},
doc as (select *, {' || '.join(_FIELD.format(c) for c in FIELDS)} as own, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda d: ascii(d)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 as hit from documents, crc),
leaf as (select doc_id, source, sha256(own) as leaf, case when hit and text is not null then sha256({' || '.join(_FIELD.format(c if c != 'text' else "replace(text, chr(10), '')") for c in FIELDS)}) else sha256(own) end as tampered from doc),
spot as (select *, dense_rank() over (order by source nulls first) - 1 as tree, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaf),
docs as (select tree, pos, leaf as digest from spot), {_levels_sql('d', 'docs', 12)}, {_proof_sql('d', 12)},
tops as (select 0 as tree, tree as pos, digest from d_root), {_levels_sql('s', 'tops', 6)}, {_proof_sql('s', 6)},
held as (select s.doc_id, s.leaf, s.tampered, r.digest as subroot, t.digest as root, list_filter(list_concat(d_path.path, s_path.path), lambda x: x.u) as path
  from spot s join d_path on d_path.tree = s.tree and d_path.pos = s.pos join s_path on s_path.pos = s.tree join d_root r on r.tree = s.tree, s_root t),
fold as (select *, sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.b || x.a), 'string_agg', ''), '')) as proof_sha256,
  list_reduce(list_prepend({{b: tampered, a: '', u: true}}, path), lambda x, y: {{b: sha256(y.b || x.b || y.a), a: '', u: true}}).b as folded_root from held)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from fold
"""
