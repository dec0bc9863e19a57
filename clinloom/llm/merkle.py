"""A Merkle manifest of a dataset: leaves, roots and proofs, hashed in blocks by DuckDB.

Each row is a leaf. The leaves of a tree ascend by an order; while a tree has several nodes, every
8 consecutive ones (the last run may have fewer) become the sha256 of their joined hex texts.
The roots of the trees, in order of the trees' names, are in turn the leaves of one upper tree.

Spark numbers the leaves, range by range, and deals them out in aligned blocks of 4096 (8 to the
fourth), so a block is four whole levels of a tree whatever lies beside it. In a
block, which is one Arrow table of bounded size, DuckDB runs an ordered string_agg and sha256 for each level. The
blocks' roots are the next, 4096 times smaller, table, treated in the same way until each tree has one node.
Proofs go the other way: a block meets, by a cogroup, the path from its root to the top, and
DuckDB puts each leaf's siblings within the block before it.

No tree is in one task: at 100 TB (some 5e10 rows) there are three such rounds.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clinloom.llm.common import LOWER, UPPER, materialize, table

ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATHS = "tree string, pos long, path array<struct<before: string, after: string>>, subroot string, root string"


def leaf(fields: dict):
    """sha256, as hex, of columns by name: `-` for null, else the count of UTF-8 bytes, a colon and the value."""
    shown = [c.cast("string") for c in fields.values()]
    return F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in shown]).cast("binary"), 256)


def tree_name(col):
    """A name that is never null and sorts by bytes, null first."""
    return F.when(col.isNull(), "").otherwise(F.concat(F.lit("="), col.cast("string")))


def number(rows: DataFrame, order: list) -> DataFrame:
    """Add pos, the place of each row within its tree from 0, and n, the rows of the tree.

    Ranges of (tree, order) are sorted and counted where they lie; the counts of earlier ranges are then added. Rows
    equal in tree and order may be dealt to several ranges, so none is ever too large; which of them comes first is left
    open, so the order must tell rows apart unless they are equal in all that is read.
    """
    keys = ["tree", *order, F.col("_salt")]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema.fields]

    def run(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            at = []
            for tree in b.column("tree").to_pylist():
                n = n + 1 if tree == last else 0
                last = tree
                at.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], names=[*b.schema.names, "_part", "_at"])

    held = materialize(ranged.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in [*kinds, ("_part", "int"), ("_at", "bigint")])))
    sizes = held.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("size"))
    # one row a tree and range: these windows grow with the tasks, not with the rows
    before = F.coalesce(F.sum("size").over(Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("tree", "_part", before.alias("_base"), F.sum("size").over(Window.partitionBy("tree")).alias("n"))
    return held.join(sizes, ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


_CON = []


def _duckdb():
    """One engine a worker, with one thread and bounded memory."""
    if not _CON:
        _CON.append(duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}))
    return _CON[0]


def _height(n: int) -> int:
    """Levels of a block that lies in a tree of n nodes."""
    if n > BLOCK:
        return LEVELS
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def _levels(con, nodes: pa.Table, height: int) -> None:
    """Tables level_0 (pos, node) up to level_<height>, the block's root."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level_0 AS SELECT pos, node FROM nodes")
    con.unregister("nodes")
    for k in range(height):
        con.execute(f"CREATE OR REPLACE TEMP TABLE level_{k + 1} AS SELECT pos // {ARITY} AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM level_{k} GROUP BY pos // {ARITY}")


def _next(n: int) -> int:
    return 1 if n <= BLOCK else -(-n // BLOCK)


_NODES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())])


def _root_of_block(nodes: pa.Table) -> pa.Table:
    tree, pos, n = nodes["tree"][0].as_py(), nodes["pos"][0].as_py(), nodes["n"][0].as_py()
    height = _height(n)
    if height == 0:
        node = nodes["node"][0].as_py()
    else:
        con = _duckdb()
        _levels(con, nodes, height)
        ((node,),) = con.execute(f"SELECT node FROM level_{height}").fetchall()
    return pa.Table.from_pydict({"tree": [tree], "pos": [pos // BLOCK], "n": [_next(n)], "node": [node]}, schema=_NODES)


def _block():
    return F.expr(f"pos div {BLOCK}").alias("block")


def climb(level: DataFrame) -> list[DataFrame]:
    """From a level of numbered nodes (tree, pos, n, node) up to that of one node a tree: at least one more table."""
    out = [level]
    while len(out) < 2 or (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        nodes = out[-1].select("tree", "pos", "n", "node", _block())
        out.append(materialize(nodes.groupBy("tree", "block").applyInArrow(_root_of_block, "tree string, pos long, n long, node string")))
    return out


def _siblings(con, nodes: pa.Table, above: pa.Table) -> int:
    """Tables beside_<k> (pos, before, after): what joins a block's nodes of level k in their run; gives the block's height."""
    height = _height(nodes["n"][0].as_py())
    _levels(con, nodes.select(["pos", "node"]), height)
    for k in range(height):
        run = f"OVER (PARTITION BY pos // {ARITY} ORDER BY pos ROWS BETWEEN"
        before, after = (f"coalesce(string_agg(node, '') {run} {rows}), '')" for rows in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        con.execute(f"CREATE OR REPLACE TEMP TABLE beside_{k} AS SELECT pos, {before} AS before, {after} AS after FROM level_{k}")
    con.register("above", above)
    return height


def _paths_of_block(nodes: pa.Table, above: pa.Table) -> pa.Table:
    con = _duckdb()
    height = _siblings(con, nodes, above)
    steps = ", ".join(f"{{'before': s{k}.before, 'after': s{k}.after}}" for k in range(height))
    joins = " ".join(f"JOIN beside_{k} s{k} ON s{k}.pos = l.pos // {ARITY**k}" for k in range(height))
    path = f"list_concat([{steps}], a.path)" if height else "a.path"
    out = con.sql(f"SELECT a.tree, l.pos, {path} AS path, a.subroot, a.root FROM level_0 l {joins} CROSS JOIN above a").to_arrow_table()
    con.unregister("above")
    return out


def _proofs_of_block(nodes: pa.Table, above: pa.Table) -> pa.Table:
    con = _duckdb()
    height, path = _siblings(con, nodes, above), above["path"][0].as_py()
    con.register("given", pa.table({"row": pa.array(range(len(nodes)), pa.int32()), "pos": nodes["pos"], "start": nodes["start"]}))
    steps = ["f0 AS (SELECT row, pos, start AS f, '' AS p FROM given)"]
    for k in range(height):
        steps.append(f"f{k + 1} AS (SELECT row, w.pos, sha256(s.before || f || s.after) AS f, p || s.before || s.after AS p FROM f{k} w JOIN beside_{k} s ON s.pos = w.pos // {ARITY**k})")
    for k in range(len(path)):
        steps.append(f"f{height + k + 1} AS (SELECT row, sha256($b{k} || f || $a{k}) AS f, p FROM f{height + k})")
    values = {f"b{k}": x["before"] for k, x in enumerate(path)} | {f"a{k}": x["after"] for k, x in enumerate(path)} | {"rest": "".join(x["before"] + x["after"] for x in path)}
    got = con.sql(f"WITH {', '.join(steps)} SELECT f AS folded_root, sha256(p || $rest) AS proof_sha256 FROM f{height + len(path)} ORDER BY row", params=values).to_arrow_table()
    con.unregister("given")
    con.unregister("above")
    one = lambda name: pa.array([above[name][0].as_py()] * len(nodes), pa.string())
    kept = [c for c in nodes.column_names if c not in ("tree", "block", "pos", "n", "node", "start")]
    return pa.table({c: nodes[c] for c in kept} | {"leaf": nodes["node"], "subroot": one("subroot"), "root": one("root"), "proof_sha256": got["proof_sha256"], "folded_root": got["folded_root"]})


def _meet(level: DataFrame, above: DataFrame, each, schema: str) -> DataFrame:
    """A block of a level, at most BLOCK rows, meets the one row that holds the path above it."""
    return level.withColumn("block", _block()).groupBy("tree", "block").cogroup(above.groupBy("tree", "pos")).applyInArrow(each, schema)


class Manifest:
    """The levels of the trees of rows (tree, node and more), of their upper tree, and the paths from each leaf to the root.

    Rows of a tree ascend by `order`, then by node. No rows: no trees and no root.
    """

    def __init__(self, rows: DataFrame, order: list[str]):
        self.levels = climb(number(rows, [*order, "node"]))
        tops = self.levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
        self.upper = climb(number(tops, ["name"]))

    def root(self) -> str | None:
        top = self.upper[-1].first()
        return top.node if top else None

    def _above(self) -> DataFrame:
        """Paths of the nodes of the first level over the leaves."""
        at = self.upper[-1].selectExpr("tree", "pos", "cast(array() as array<struct<before: string, after: string>>) as path", "cast(null as string) as subroot", "node as root")
        for level in reversed(self.upper[:-1]):
            at = materialize(_meet(level.select("tree", "pos", "n", "node"), at, _paths_of_block, _PATHS))
        named = self.upper[0].select(F.col("name").alias("tree"), "pos", F.col("node").alias("subroot"))
        at = at.drop("tree", "subroot").join(named, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
        for level in reversed(self.levels[1:-1]):
            at = materialize(_meet(level, at, _paths_of_block, _PATHS))
        return at

    def paths(self) -> DataFrame:
        """(tree, pos, path, subroot, root) of every leaf: before and after it, on each level, what its siblings' hex texts join to."""
        return _meet(self.levels[0].select("tree", "pos", "n", "node"), self._above(), _paths_of_block, _PATHS)

    def proofs(self, start: str, keep: list[str]) -> DataFrame:
        """Of every leaf: columns to keep, leaf, subroot, root, proof_sha256 (of all its siblings, joined) and folded_root, the root that follows from the column `start` and those siblings."""
        level = self.levels[0].select(*keep, "tree", "pos", "n", "node", F.col(start).alias("start"))
        kinds = ", ".join(f"`{c}` {level.schema[c].dataType.simpleString()}" for c in keep)
        return _meet(level, self._above(), _proofs_of_block, f"{kinds}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(hit, leaf(fields | {"text": F.translate("text", UPPER, LOWER)})).otherwise(leaf(fields))
    rows = docs.select("doc_id", tree_name(F.col("lang")).alias("tree"), leaf(fields).alias("node"), tampered.alias("tampered"))
    return Manifest(rows, ["doc_id"]).proofs("tampered", ["doc_id"]).withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle() -> str:
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"
    whole = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    lowered = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, i: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)))"
    return f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {whole("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole(lowered)} ELSE {whole("text")} END AS start
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 8, n),
tops AS (
  SELECT lang, node, level, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, n, node FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 8, n),
sides AS (
  SELECT lang, level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (PARTITION BY lang, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1),
upper_sides AS (
  SELECT level, pos, coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(node, '') OVER (PARTITION BY level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM upper WHERE n > 1),
steps AS (
  SELECT p.lang, p.pos AS leaf_pos, s.level, s.before, s.after
  FROM placed p JOIN sides s ON s.lang IS NOT DISTINCT FROM p.lang AND s.pos = p.pos // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT p.lang, p.pos, t.level + u.level, u.before, u.after
  FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN upper_sides u ON u.pos = t.pos // (8 ** u.level)::BIGINT),
proofs AS (
  SELECT lang, leaf_pos, list({{'b': before, 'a': after}} ORDER BY level) AS path, string_agg(before || after, '' ORDER BY level) AS joined FROM steps GROUP BY lang, leaf_pos)
SELECT p.doc_id, p.leaf, t.node AS subroot, r.node AS root, sha256(coalesce(q.joined, '')) AS proof_sha256,
  f.folded AS folded_root, f.folded = r.node AS verified
FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang
CROSS JOIN (SELECT node FROM upper WHERE n = 1) r
LEFT JOIN proofs q ON q.lang IS NOT DISTINCT FROM p.lang AND q.leaf_pos = p.pos
CROSS JOIN LATERAL (SELECT list_reduce([p.start] || list_transform(coalesce(q.path, []), lambda x: x.b || ' ' || x.a), lambda f, x: sha256(string_split(x, ' ')[1] || f || string_split(x, ' ')[2])) AS folded) f
"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE_SQL = {"op12_merkle_manifest": _oracle()}
