"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards; a node weighs as much as the shards below
it.  A document descends: at each level every child draws ``-ln(u) / weight`` with u
from a hash of the document and the child, and the smallest draw wins.  A child's
share is its weight, and a draw depends on the child alone, so a changed weight
moves documents only into or out of the subtree that holds it.  A new shard joins
as a subtree of its own at the root: no other draw changes, and documents move
only into it, however often the tree has grown before.

All of it is DataFrame code.  Slots are running counts over hash ranges, so no task
sees a whole shard.

Defined cases: a null text has size 16 and the checksum of an empty text (0); a
null doc_id is hashed as a word of its own; repeated rows take one slot each, in any
order; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.registry import query, table
from fleetlens.llm.running import hash_key, hash_unit, range_of, ranges, running_before
from fleetlens.session import cut

SHARDS = 40
REGIONS = 4
RACKS = 2
OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def base_tree(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> list[Leaf]:
    """Shards dealt to regions and racks as evenly as the numbers allow."""
    cells = regions * racks
    leaves = [Leaf(s * cells // shards // racks, s * cells // shards % racks, s) for s in range(shards)]
    return leaves


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, as a region of its own."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, 0, max(x.shard for x in tree) + 1, weight)]


def _children(leaves: list[Leaf], key) -> list[tuple[int, list[Leaf]]]:
    return [(k, list(v)) for k, v in groupby(sorted(leaves, key=key), key=key)]


def _winner(identity: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest weighted draw; ties go by value."""
    if len(children) == 1:
        return children[0][2]
    draws = [
        F.struct((-F.log(hash_unit(F.concat_ws("/", identity, F.lit(path)))) / F.lit(float(weight))).alias("d"), value.alias("v"))
        for path, weight, value in children
    ]
    return F.least(*draws)["v"]


def _by(column: Column, cases: list[tuple[int, Column]]) -> Column:
    out = None
    for key, value in cases:
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def place(rows: DataFrame, identity: str, tree: list[Leaf], out: str) -> DataFrame:
    """Add ``out``: the shard of the document named by the text column ``identity``."""
    weight = lambda leaves: sum(x.weight for x in leaves)
    me = F.col(identity)
    regions = _children(tree, lambda x: x.region)
    rows = rows.withColumn("_region", _winner(me, [(f"{r}", weight(v), F.lit(r)) for r, v in regions]))
    racks = [(r, _children(v, lambda x: x.rack)) for r, v in regions]
    rows = rows.withColumn("_rack", _by(F.col("_region"), [
        (r, _winner(me, [(f"{r}/{k}", weight(v), F.lit(k)) for k, v in cells])) for r, cells in racks
    ]))
    shards = _by(F.col("_region"), [
        (r, _by(F.col("_rack"), [
            (k, _winner(me, [(f"{r}/{k}/{x.shard}", x.weight, F.lit(x.shard)) for x in v])) for k, v in cells
        ])) for r, cells in racks
    ])
    return rows.withColumn(out, shards).drop("_region", "_rack")


def shard_documents(docs: DataFrame, *, tree: list[Leaf] | None = None) -> DataFrame:
    """Shard, slot and next shard of every document.

    Reads ``doc_id`` and ``text``.  Returns doc_id, size (UTF-8 bytes plus 16), text_crc32,
    law (always ``key``: document and tree decide), shard, slot (0, 1, 2, ... in each
    shard) and grown_shard, the shard under ``grow(tree)``.
    """
    tree = tree or base_tree()
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_id"),
    )
    rows = place(rows, "_id", tree, "shard")
    rows = cut(place(rows, "_id", grow(tree), "grown_shard").withColumn(
        # the checksum spreads rows without an id, or with a repeated one, over the ranges of their shard
        "_key", hash_key(F.concat_ws(":", "_id", F.col("text_crc32").cast("string")))
    ).drop("_id"))
    counts = rows.groupBy("shard").agg(F.count("*").alias("_rows"))  # one row per shard
    ranged = rows.join(F.broadcast(counts), "shard").withColumn("_range", range_of(F.col("_key"), ranges(F.col("_rows"))))
    ranged = ranged.withColumn("_one", F.lit(1))
    slots = running_before(ranged, ["shard"], "_range", ["_key", "doc_id", "size", "text_crc32"], "_one", "slot")
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def _tree_sql(tree: list[Leaf], level: str) -> str:
    """The nodes of one level as rows (parent, node, path, weight)."""
    nodes: dict[str, list] = {}
    for x in tree:
        parent, node, path = {
            "region": ("", x.region, f"{x.region}"),
            "rack": (f"{x.region}", x.rack, f"{x.region}/{x.rack}"),
            "shard": (f"{x.region}/{x.rack}", x.shard, f"{x.region}/{x.rack}/{x.shard}"),
        }[level]
        nodes.setdefault(path, [parent, node, 0.0])[2] += x.weight
    return ", ".join(f"('{p}', {n}, '{path}', {w}::DOUBLE)" for path, (p, n, w) in nodes.items())


def _descent_sql(tree: list[Leaf], name: str) -> str:
    draw = "-ln((('0x' || substr(md5(d.id || '/' || n.path), 1, 13))::BIGINT + 1) / 4503599627370496.0::DOUBLE) / n.w"
    step = lambda level, above: (
        f"{name}_{level} AS (SELECT d.id, min_by(n.path, {{'d': {draw}, 'v': n.node}}) AS path, min_by(n.node, {{'d': {draw}, 'v': n.node}}) AS node "
        f"FROM {above} d JOIN (VALUES {_tree_sql(tree, level)}) n(parent, node, path, w) ON n.parent = d.path GROUP BY d.id)"
    )
    return ", ".join([
        step("region", "(SELECT DISTINCT id, '' AS path FROM ids)"),
        step("rack", f"{name}_region"), step("shard", f"{name}_rack"),
    ])


# the checksum of a text, bit by bit from its bytes; its table comes from the polynomial
OP8_SQL = f"""
WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS (SELECT *, coalesce(doc_id::VARCHAR, 'null') AS id, encode(coalesce(text, '')) AS b FROM documents),
crc AS (SELECT doc_id, id, octet_length(b) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1])), 4294967295) AS text_crc32
  FROM ids, tab),
{_descent_sql(base_tree(), 'now')},
{_descent_sql(grow(base_tree()), 'grown')}
SELECT c.doc_id, c.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'key' AS law, a.node::INT AS shard,
  (row_number() OVER (PARTITION BY a.node ORDER BY substr(md5(c.id || ':' || c.text_crc32::BIGINT), 1, 13), c.doc_id, c.size, c.text_crc32) - 1)::BIGINT AS slot,
  g.node::INT AS grown_shard
FROM crc c JOIN now_shard a ON a.id = c.id JOIN grown_shard g ON g.id = c.id
"""


@query("op8_sharding", OP8_SQL)
def op8_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
