"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards with weights. A document descends from
the root: at each level every child draws -ln(u) / weight from a hash of the
document's id and the child's name, and the smallest draw wins, so a child is
chosen in proportion to its weight. A draw depends on nothing but id, name and
weight: if a subtree's weight rises, documents move only into it, if it falls
they move only out of it, and inside an unchanged subtree nothing moves.

The law of the query is `key`: doc_id and the number of shards decide. A tree
of more than the base's shards has each further shard in a region of its own,
so one more shard changes no weight of an older node and takes rows only into
itself. All draws are column expressions; the only shuffle is for slot numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._spark import numbered, table


@dataclass(frozen=True)
class Node:
    """A region, rack (children) or shard (shard number)."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    def load(self) -> float:
        return sum(c.load() for c in self.children) if self.children else self.weight


def tree(shards: int, base: int = 16, regions: int = 2, racks: int = 2) -> Node:
    """Up to `base` shards evenly in regions and racks; each further one in a region of its own."""
    first = min(shards, base)
    cells: list[list[list[int]]] = [[[] for _ in range(racks)] for _ in range(regions)]
    for s in range(first):
        cells[s * regions // base][s * regions * racks // base % racks].append(s)
    leaf = lambda s: Node(f"shard{s}", 1.0, (), s)
    found = []
    for g, row in enumerate(cells):
        own = tuple(Node(f"region{g}/rack{k}", children=tuple(map(leaf, x))) for k, x in enumerate(row) if x)
        if own:
            found.append(Node(f"region{g}", children=own))
    found += [Node(f"region+{s}", children=(Node(f"region+{s}/rack0", children=(leaf(s),)),)) for s in range(first, shards)]
    return Node("root", children=tuple(found))


def _pick(key: Column, candidates: Column) -> Column:
    """The candidate (name, weight, number) with the smallest draw -ln(u) / weight, ties to the lower number.

    u in (0, 1) comes from the first 52 bits of an md5 of key and name.
    """

    def draw(c: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), c["name"])), 1, 13), 16, 10).cast("double")
        return F.struct((-F.log((bits + 0.5) / F.lit(float(2**52))) / c["weight"]).alias("draw"), c["number"].alias("number"))

    return F.array_min(F.transform(candidates, draw))["number"]


def assign(df: DataFrame, root: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """df with the shard that each key descends to; one projection per level of the tree."""
    text = F.coalesce(F.col(key).cast("string"), F.lit("?"))
    nodes: list[Node] = []

    def listed(children: tuple[Node, ...]) -> Column:
        rows = []
        for c in children:
            nodes.append(c)
            rows.append(F.struct(F.lit(c.name).alias("name"), F.lit(float(c.load())).alias("weight"), F.lit(len(nodes) - 1).alias("number")))
        return F.array(*rows)

    df = df.withColumn("_node", _pick(text, listed(root.children)))
    level = range(len(nodes))
    while any(nodes[n].children for n in level):
        first, step = len(nodes), None
        for n in level:
            below = listed(nodes[n].children) if nodes[n].children else F.array(F.struct(F.lit(nodes[n].name).alias("name"), F.lit(1.0).alias("weight"), F.lit(n).alias("number")))
            step = (F.when if step is None else step.when)(F.col("_node") == n, below)
        df = df.withColumn("_node", _pick(text, step))
        level = range(first, len(nodes))
    return df.withColumn(out, F.element_at(F.create_map(*[F.lit(x) for n, c in enumerate(nodes) if c.shard is not None for x in (n, c.shard)]), F.col("_node")).cast("int")).drop("_node")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Defined results: a null text has size 1 and the checksum of no bytes; rows
    with one id share a shard and have slots of their own; a null id is the key
    "?"; an empty table gives an empty table.
    """
    own = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"),
    )
    placed = assign(assign(own, tree(shards)), tree(shards + 1), out="grown_shard")
    slotted = numbered(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _descent(node: Node, key: str) -> str:
    """The shard that a key descends to, as SQL."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _descent(node.children[0], key)
    draws = [f"-ln((('0x' || substr(md5({key} || '|{c.name}'), 1, 13))::BIGINT + 0.5) / {2**52}.0) / {float(c.load())}" for c in node.children]
    ways = " ".join(f"WHEN {k + 1} THEN {_descent(c, key)}" for k, c in enumerate(node.children))
    return f"CASE list_position([{', '.join(draws)}], list_min([{', '.join(draws)}])) {ways} END"


# bytes of a text are pairs of its hex digits; the checksum is folded over them with the table of the reversed polynomial
ORACLE = f"""
WITH steps AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)
), d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1,', 'g'), ','), lambda x: x <> ''), lambda x: ('0x' || x)::BIGINT) AS bytes,
         coalesce(doc_id::VARCHAR, '?') AS key
  FROM documents
), c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
         {_descent(tree(16), "key")} AS shard, {_descent(tree(17), "key")} AS grown_shard
  FROM d, steps
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard
FROM c
"""
