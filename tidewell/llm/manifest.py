"""Merkle manifest of a dataset: a proof for every row, by ranks of a radix trie.

A row's leaf hashes its columns. In each source the leaves stand in the order of doc_id, and
every ``FANOUT`` consecutive nodes become one until a single one is left, the source's
subroot; the subroots, in the order of the sources, become the root in the same way.

A leaf's place follows from counts, without a global sort: rows are counted by the leading
hexadecimal digits of their keys, cells by the digits before (``STEP`` digits a level, so no window
over cells holds more than 16 ** STEP of them), and a row's rank is what is counted before its
cell and its place in the cell, which holds a bounded number of rows. The digits of that rank
to base FANOUT are the path of the leaf in the tree: the leaves with a common prefix of all but the
last ``LEVELS`` digits meet in one group, which is reduced that many levels at once, and so on with
the groups' tops. A group holds FANOUT ** LEVELS nodes at most, however large its source is.

Defined results: a null column hashes as ``-``; a null doc_id stands first in its source, and is
never tampered with; rows of one doc_id stand in the order of their leaves; equal rows get
places of their own; a null source is a source of its own, the first; an empty table gives an
empty result; columns with other names are ignored.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 3, 6
SPAN = FANOUT**LEVELS
#: Hexadecimal digits that a level of counts adds.
STEP = 3
#: Rows that a cell may hold before it is told apart by more digits.
CELL = 1 << 14
#: Digits of a first cell: a mark, and a doc_id but for its last two digits, so 256 ids share one.
FIRST = 15


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """A value with its length, or a dash: fields can't run into each other."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """The hash of a row; text in place of the row's own."""
    return digest(F.concat(*[field(text if text is not None and c == "text" else F.col(c)) for c in COLUMNS]))


def tampered() -> Column:
    """The text of the rows that are tampered with, else null: their line ends are lost."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen & F.contains("text", F.lit("\n")), F.replace("text", F.lit("\n"), F.lit("")))


def leaves(docs: DataFrame) -> DataFrame:
    """group, doc_id, leaf and the leaf after tampering (null where that changed nothing); key
    orders the rows of a group. The group is the source with a mark, which sorts null first."""
    group = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    bad = tampered()
    found = docs.select(*COLUMNS).select(
        group.alias("group"), "doc_id", leaf().alias("leaf"), F.when(bad.isNotNull(), leaf(bad)).alias("bad"),
        F.monotonically_increasing_id().alias("row"),
    )
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    key = F.concat(F.coalesce(F.concat(F.lit("1"), number), F.lit("0" * 17)), "leaf", F.lpad(F.hex("row"), 16, "0"))
    return found.select("group", key.alias("key"), "doc_id", "leaf", "bad")


def _before(cells: DataFrame, length: int, shared: int) -> DataFrame:
    """Adds before, the rows of the group in cells before this one, and total, those of the group.
    Cells are summed by the digits before their last, which are placed in the same way."""
    if length - STEP <= shared:
        group = Window.partitionBy("group")
        upto = F.sum("n").over(group.orderBy("cell"))
        return cells.select("group", "cell", (upto - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"))
    parent = F.substring("cell", 1, length - STEP)
    parents = cells.groupBy("group", parent.alias("parent")).agg(F.sum("n").alias("n"))
    placed = _before(parents.withColumnRenamed("parent", "cell"), length - STEP, shared).withColumnRenamed("cell", "parent")
    inside = F.sum("n").over(Window.partitionBy("group", "parent").orderBy("cell")) - F.col("n")
    named = cells.withColumn("parent", parent).withColumn("inside", inside)
    return named.join(placed, ["group", "parent"]).select("group", "cell", (F.col("before") + F.col("inside")).alias("before"), "total")


def ranked(rows: DataFrame, first: int = FIRST, most: int = CELL) -> DataFrame:
    """Adds rank, from 0, and total to rows of (group, key); keys are distinct in a group, and
    their order is that of their characters. rows must be a stored table."""
    low, high, longest = rows.agg(F.min("key"), F.max("key"), F.max(F.length("key"))).first()
    if low is None:
        return rows.select("*", F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("total"))
    shared = len(os.path.commonprefix([low, high]))
    length = max(first, shared + STEP)
    while True:
        cell = F.substring("key", 1, length)
        cells = materialize(rows.groupBy("group", cell.alias("cell")).agg(F.count("*").alias("n")), "cells")
        if length >= longest or cells.agg(F.max("n")).first()[0] <= most:
            break
        length += STEP
    placed = _before(cells, length, shared)
    inner = F.row_number().over(Window.partitionBy("group", "cell").orderBy("key"))
    named = rows.withColumn("cell", cell).withColumn("inner", inner)
    out = named.join(placed, ["group", "cell"])
    return out.select(*rows.columns, (F.col("before") + F.col("inner") - 1).cast("long").alias("rank"), F.col("total").cast("long"))


def _run(nodes: Column, at: Column) -> Column:
    """The digests of a run of siblings, joined."""
    return F.array_join(F.slice(nodes, at, F.lit(FANOUT)), "")


def _levels(leaves: Column, height: Column) -> Column:
    """A group's digests, level by level from its nodes to the top."""

    def climb(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / FANOUT).cast("int"))
        return F.concat(levels, F.array(F.transform(runs, lambda i: digest(_run(last, i * FANOUT + 1)))))

    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(leaves), climb)


def _siblings(levels: Column, at: Column) -> Column:
    """What stands left and right of the node at a place (from 0), on each level but the top."""

    def beside(nodes: Column, level: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(FANOUT)), level)).cast("int")
        first = F.floor(place / FANOUT).cast("int") * FANOUT
        last = F.least(first + FANOUT, F.size(nodes))
        left = F.array_join(F.slice(nodes, first + 1, place - first), "")
        right = F.array_join(F.slice(nodes, place + 2, last - place - 1), "")
        return F.struct(left.alias("left"), right.alias("right"))

    below = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(below, beside)


def reduced(nodes: DataFrame) -> DataFrame:
    """nodes: group, rank, total, digest, item. One row for each (group, chunk) of SPAN nodes: the
    items in order, the chunk's levels, its top, and how many chunks there are in all."""
    chunk = F.floor(F.col("rank") / SPAN).cast("long")
    met = nodes.groupBy("group", chunk.alias("chunk"), "total").agg(
        F.array_sort(F.collect_list(F.struct("rank", "digest", "item"))).alias("nodes")
    )
    height = sum((F.when(F.col("total") > FANOUT**i, 1).otherwise(0) for i in range(LEVELS)), F.lit(0))
    levels = _levels(F.col("nodes.digest"), height)
    made = met.select("group", "chunk", F.ceil(F.col("total") / SPAN).cast("long").alias("total"), F.col("nodes.item").alias("items"), levels.alias("levels"))
    return made.select("*", F.element_at(F.element_at("levels", -1), 1).alias("top"))


def _tree(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The rounds of reduction, each a stored table, until every group has one chunk."""
    rounds = []
    while True:
        rounds.append(materialize(reduced(nodes), name))
        tops = rounds[-1].select("group", F.col("chunk").alias("rank"), "total", F.col("top").alias("digest"), F.lit(None).cast("int").alias("item"))
        if rounds[-1].filter("total > 1").isEmpty():
            return rounds
        nodes = tops


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """above: group, chunk 0, proof. Gives group, rank, item, digest and proof of the first nodes: the
    siblings of each chunk's own levels, then what lies above the chunk."""
    for table in reversed(rounds):
        one = lambda item, i: F.struct(
            i.alias("at"), item.alias("item"), F.element_at(F.element_at("levels", 1), i + 1).alias("digest"),
            F.concat(_siblings(F.col("levels"), i), F.col("proof")).alias("proof"),
        )
        met = table.join(above, ["group", "chunk"])
        found = met.select("group", "chunk", F.inline(F.transform("items", one)))
        nodes = found.select("group", (F.col("chunk") * SPAN + F.col("at")).alias("chunk"), "item", "digest", "proof")
        above = nodes.select("group", "chunk", "proof")
    return nodes


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = ranked(materialize(leaves(docs), "leaves"))
    nodes = rows.select("group", "rank", "total", F.col("leaf").alias("digest"), F.struct("doc_id", "bad").alias("item"))
    trees = _tree(nodes, "tree")
    subroots = trees[-1].select(F.lit("").alias("group"), F.hex("group").alias("key"), F.col("group").alias("name"), F.col("top").alias("digest"))
    sources = ranked(materialize(subroots, "subroots", True), STEP)
    crown = _tree(sources.select("group", "rank", "total", "digest", F.struct("name").alias("item")), "crown")
    root = crown[-1].select("group", F.lit(0).cast("long").alias("chunk"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"))
    placed = _proofs(crown, root).select(F.col("item.name").alias("group"), F.lit(0).cast("long").alias("chunk"), F.col("digest").alias("subroot"), "proof")
    placed = materialize(placed, "placed", True)
    top = crown[-1].select(F.col("top").alias("root")).first()
    root = top["root"] if top else None
    found = _proofs(trees, placed.select("group", "chunk", "proof"))
    found = found.select("group", "item.doc_id", F.col("digest").alias("leaf"), F.coalesce("item.bad", "digest").alias("given"), "proof")
    found = found.join(placed.select("group", "subroot"), "group")
    joined = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("proof", F.col("given"), lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
    out = found.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), digest(joined).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
#: The CRC of a decimal number, bit by bit: DuckDB has no such function.
_CRC = (
    "xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),"
    " lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
)


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if c == "text" else c) for c in COLUMNS) + ")"


def _sql_tree(rows: str) -> str:
    """The levels of a forest: rows has grp, idx, digest."""
    return f"""
  SELECT grp, 0 AS lvl, idx, digest FROM {rows}
  UNION ALL
  SELECT grp, lvl + 1, idx // {FANOUT}, sha256(string_agg(digest, '' ORDER BY idx))
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM {{self}}) WHERE n > 1 GROUP BY grp, lvl, idx // {FANOUT}"""


SQL = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('1' || source, '0') AS grp, {_sql_leaf("text")} AS leaf,
         CASE WHEN {_CRC.format("doc_id")} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS given
  FROM documents),
docs AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, row_number() OVER () AS doc FROM given),
leaves AS (SELECT grp, idx, leaf AS digest FROM docs),
tree AS ({_sql_tree("leaves").format(self="tree")}),
tops AS (SELECT grp, max(lvl) AS height, arg_max(digest, lvl) AS subroot FROM tree GROUP BY grp),
ordered AS (SELECT grp AS name, 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, subroot AS digest FROM tops),
crown AS ({_sql_tree("ordered").format(self="crown")}),
heights AS (SELECT max(lvl) AS height, arg_max(digest, lvl) AS root FROM crown),
steps AS (
  SELECT d.doc, t.lvl, t.idx, d.idx // CAST(pow({FANOUT}, t.lvl) AS BIGINT) AS own, t.digest
  FROM docs d JOIN tops o ON o.grp = d.grp JOIN tree t ON t.grp = d.grp AND t.lvl < o.height
    AND t.idx // {FANOUT} = d.idx // CAST(pow({FANOUT}, t.lvl + 1) AS BIGINT)
  UNION ALL
  SELECT d.doc, o.height + t.lvl, t.idx, s.idx // CAST(pow({FANOUT}, t.lvl) AS BIGINT), t.digest
  FROM docs d JOIN tops o ON o.grp = d.grp JOIN ordered s ON s.name = d.grp JOIN crown t
    ON t.lvl < (SELECT height FROM heights) AND t.idx // {FANOUT} = s.idx // CAST(pow({FANOUT}, t.lvl + 1) AS BIGINT)),
sides AS (
  SELECT doc, lvl, coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS l,
         coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS r
  FROM steps GROUP BY doc, lvl),
fold AS (
  SELECT doc, 0 AS lvl, given AS acc FROM docs
  UNION ALL
  SELECT f.doc, f.lvl + 1, sha256(s.l || f.acc || s.r) FROM fold f JOIN sides s ON s.doc = f.doc AND s.lvl = f.lvl),
folded AS (SELECT doc, arg_max(acc, lvl) AS folded_root FROM fold GROUP BY doc),
proofs AS (SELECT doc, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof FROM sides GROUP BY doc)
SELECT d.doc_id, d.leaf, o.subroot, h.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded_root, f.folded_root = h.root AS verified
FROM docs d JOIN tops o ON o.grp = d.grp CROSS JOIN heights h JOIN folded f ON f.doc = d.doc LEFT JOIN proofs p ON p.doc = d.doc
"""
