"""A Merkle manifest of rows: per-group trees under one root, built from sparse forests that merge in any order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ARITY = 2
#: Levels of a tree that are built within one task, and nodes above these that treeReduce merges; more go through further such levels first.
LEVELS, MERGED = 8, 1 << 16
#: Rows of a partition when rows are put into order, about.
ORDERED = 200_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

#: A node's place: tree, level, index in the level.
Place = tuple[int, int, int]


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def width(leaves: int, level: int, arity: int = ARITY) -> int:
    """Nodes of a level of a tree with so many leaves."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


class Forest:
    """Nodes of trees by place, of which any part may be there: a commutative monoid under merged(), with the empty forest as its unit.

    open: nodes whose siblings aren't all there. made: all nodes that ever were there. sizes: a tree's leaves, which tell how many nodes a
    level has, and so when a run of siblings is complete though it is shorter than the others. A complete run becomes its parent at once.
    """

    def __init__(self, sizes: dict[int, int] | None = None, nodes: Iterable[tuple[Place, str]] = (), arity: int = ARITY) -> None:
        self.sizes, self.arity = dict(sizes or {}), arity
        self.open: dict[Place, str] = {}
        self.made: dict[Place, str] = {}
        for place, node in nodes:
            self.add(place, node)

    def add(self, place: Place, node: str) -> None:
        while True:
            tree, level, at = place
            self.open[place] = self.made[place] = node
            n = width(self.sizes[tree], level, self.arity)
            if n == 1:
                return
            first = at - at % self.arity
            run = [(tree, level, i) for i in range(first, min(first + self.arity, n))]
            if any(x not in self.open for x in run):
                return
            place, node = (tree, level + 1, at // self.arity), digest(*(self.open.pop(x) for x in run))

    def merged(self, other: Forest) -> Forest:
        """All of both. Which of two forests comes first, and how several are bracketed, changes nothing."""
        few, many = sorted((self, other), key=lambda f: len(f.made))
        out = Forest({**self.sizes, **other.sizes}, arity=self.arity)
        out.open, out.made = dict(many.open), {**few.made, **many.made}
        for place, node in few.open.items():
            out.add(place, node)
        return out

    def parts(self) -> tuple[dict, dict, dict]:
        """What it consists of, as plain values that travel between workers."""
        return self.sizes, self.open, self.made

    @classmethod
    def of(cls, sizes: dict[int, int], open_: dict[Place, str], made: dict[Place, str]) -> Forest:
        out = cls(sizes)
        out.open, out.made = open_, made
        return out

    def siblings(self, place: Place) -> Iterator[str]:
        """The others of the runs from a node up to its tree's root."""
        tree, level, at = place
        while (n := width(self.sizes[tree], level, self.arity)) > 1:
            first = at - at % self.arity
            yield from (self.made[tree, level, i] for i in range(first, min(first + self.arity, n)) if i != at)
            level, at = level + 1, at // self.arity

    def root(self, tree: int) -> str:
        level = 0
        while width(self.sizes[tree], level, self.arity) > 1:
            level += 1
        return self.made[tree, level, 0]


def folded(node: str, at: int, n: int, siblings: list[str], arity: int = ARITY) -> tuple[str, list[str]]:
    """The root that a leaf and its siblings make, and the siblings that are over, which are of trees above."""
    while n > 1:
        first = at - at % arity
        run = min(first + arity, n) - first
        own, siblings = siblings[: run - 1], siblings[run - 1 :]
        node = digest(*own[: at - first], node, *own[at - first :])
        at, n = at // arity, -(-n // arity)
    return node, siblings


def leaf(columns: Iterable[Column]) -> Column:
    """sha256 of columns as text, each `-` if null, else its UTF-8 bytes' count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """rows with part and pos: in the order of the keys all of a part come before the next, and pos ascends within; then before, the rows of earlier parts.

    Only the parts' counts meet in one task: as many rows as there are parts.
    """
    parts = max(1, math.ceil(rows.count() / ORDERED), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()))
    counts = placed.groupBy("part").agg(F.min("pos").alias("from"), F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("part", "from", before.alias("before")))
    return placed.join(starts, "part").withColumn("rank", F.col("pos") - F.col("from") + F.col("before")).drop("from", "before", "pos")


def ordered(rows: DataFrame, group: str, *by: str) -> DataFrame:
    """rows with tree, the number of their group in order (null first), n, its rows, and at, their place in it by `by` (nulls first). From 0.

    Rows are put into ranges of this order and numbered within their partition. A group with any share of the rows is in as many ranges as it
    needs; repeated rows too, as a number of the row breaks their tie.
    """
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = written(ranked(rows, [F.col(c).asc_nulls_first() for c in (group, *by, "tie")]).drop("tie"))
    spans = placed.groupBy("part", group).agg(F.min("rank").alias("low"), F.count(F.lit(1)).alias("c"))
    trees = written(spans.groupBy(group).agg(F.min("low").alias("first"), F.sum("c").alias("n")))
    trees = ranked(trees, [F.col("first")]).select(F.col(group).alias("g"), "first", "n", F.col("rank").alias("tree"))
    # By part and group: no task gets all of a large group.
    spans = spans.join(trees, F.col(group).eqNullSafe(F.col("g"))).select(F.col("part").alias("p"), "g", "first", "n", "tree")
    met = placed.join(spans, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return met.withColumn("at", F.col("rank") - F.col("first")).drop("part", "p", "g", "rank", "first")


def climbed(nodes: DataFrame, levels: int = LEVELS, merged: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """nodes (tree, n, at, node, row) with path, the digests of their siblings up to the root of their tree, end to end, and root; and the
    trees' roots (tree, root).

    Runs of ARITY^levels nodes are built up in one task each, as a forest whose open node is the run's root; the tasks give out these roots
    and their nodes' siblings. The forests of these roots, one a partition, are merged by treeReduce, in which every node becomes its parent
    as soon as its siblings are there. Only if roots are more than `merged` do they first go through such runs again, so what the driver and a
    broadcast hold is bounded whatever the table's size.
    """
    span = ARITY**levels
    kind = nodes.schema["row"].dataType.simpleString()
    names = ["tree", "n", "at", "node", "row", "block", "path"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(tree: int, n: int, block: int, run: list[tuple], row: pa.DataType) -> pa.RecordBatch:
            low = block * span
            forest = Forest({0: min(span, n - low)}, (((0, 0, at - low), node) for at, node, _ in run))
            top = forest.root(0)
            if n > span:  # a short run of a larger tree still climbs all levels
                for _ in range(sum(width(forest.sizes[0], k) == 1 for k in range(levels))):
                    top = digest(top)
            rows = [(tree, n, at, node, extra, block, path_of(forest, (0, 0, at - low))) for at, node, extra in run] + [(tree, -(-n // span), block, top, None, None, None)]
            types = pa.int64(), pa.int64(), pa.int64(), pa.string(), row, pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        run: list[tuple] = []
        now = row = None
        for batch in batches:
            row = batch.column(4).type
            for tree, n, at, node, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (tree, n, at // span):
                    if run:
                        yield given(*now, run, row)
                    now, run = (tree, n, at // span), []
                run.append((at, node, extra))
        if run:
            yield given(*now, run, row)

    dealt = nodes.select("tree", "n", "at", "node", "row").repartition("tree", F.floor(F.col("at") / span)).sortWithinPartitions("tree", "at")
    built = written(dealt.mapInArrow(build, f"tree long, n long, at long, node string, row {kind}, block long, path binary"))
    tops = built.where("block is null").select("tree", "n", "at", "node", F.lit(None).cast("int").alias("row"))
    above = tops.where("n = 1").select("tree", "at", F.lit(b"").alias("path"), F.col("node").alias("root"))
    higher = tops.where("n > 1")
    if count := higher.count():
        above = above.unionByName(reduced(higher, count) if count <= merged else climbed(higher, levels, merged)[0].select("tree", "at", "path", "root"))
    above = written(above)
    up = above.select(F.col("tree").alias("t"), F.col("at").alias("b"), F.col("path").alias("rest"), "root")
    own = built.where("block is not null").join(up, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")))
    return own.select("tree", "n", "at", "node", "row", F.concat("path", "rest").alias("path"), "root"), above.where("at = 0").select("tree", "root")


def path_of(forest: Forest, place: Place) -> bytes:
    return bytes.fromhex("".join(forest.siblings(place)))


def reduced(nodes: DataFrame, count: int) -> DataFrame:
    """(tree, at, path, root) of nodes, of which there are few: their forests, one a partition, merged by treeReduce."""

    def forest(rows: Iterator) -> Iterator[tuple]:
        own = Forest()
        for r in rows:
            own.sizes[r.tree] = r.n
            own.add((r.tree, 0, r.at), r.node)
        yield own.parts()

    parts = nodes.repartitionByRange(max(1, min(64, count // 16)), "tree", "at").rdd.mapPartitions(forest)
    sent = nodes.sparkSession.sparkContext.broadcast(parts.treeReduce(lambda a, b: Forest.of(*a).merged(Forest.of(*b)).parts()))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = Forest.of(*sent.value)
        for batch in batches:
            trees, places = (batch.column(i).to_pylist() for i in range(2))
            path = [path_of(whole, (t, 0, a)) for t, a in zip(trees, places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(path, pa.binary()), pa.array([whole.root(t) for t in trees], pa.string())], ["tree", "at", "path", "root"])

    return nodes.select("tree", "at").mapInArrow(paths, "tree long, at long, path binary, root string")


def manifest(docs: DataFrame, carried: dict[str, Column] | None = None, levels: int = LEVELS, merged: int = MERGED) -> DataFrame:
    """(doc_id, leaf, tree, n, at, path, subroot, trees, top_path, root) of each row, and what carried makes of it: a tree for each lang, and
    one over their roots.

    Leaves ascend by doc_id, a null one first, then by leaf; trees by lang, null first. path and top_path are the proof: digests of siblings from the
    leaf up to its subroot, and from there to root. A row alone in its lang is its subroot. Repeated rows are leaves of their own. Nulls in
    any column and empty texts are leaves like others, very long texts too, which the JVM hashes whole. An empty table gives no rows.
    """
    extra = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(name) for name, c in (carried or {}).items()))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(map(F.col, COLUMNS)).alias("node"), extra.alias("row")))
    leaves, subroots = climbed(ordered(rows, "lang", "doc_id", "node"), levels, merged)
    trees = subroots.count()
    top = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("at"), F.col("root").alias("node"), F.lit(None).cast("int").alias("row")), levels, merged)[0]
    top = written(top.select(F.col("at").alias("t"), F.col("path").alias("top_path"), F.col("root").alias("top")))
    named = leaves.join(top, F.col("tree") == F.col("t"))
    return named.select("row.doc_id", F.col("node").alias("leaf"), "tree", "n", "at", "path", F.col("root").alias("subroot"), F.lit(trees).cast("long").alias("trees"), "top_path", F.col("top").alias("root"), *(f"row.{c}" for c in carried or {}))


def refolded(proofs: DataFrame, leaf: str) -> DataFrame:
    """proofs of manifest() with folded_root: the root that a column's leaf makes with their siblings. A null leaf has a null root."""
    columns = proofs.columns
    used = ["tree", "n", "at", "path", "trees", "top_path", leaf]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, n, at, path, trees, top, node in zip(*(batch.column(columns.index(c)).to_pylist() for c in used), strict=True):
                hexed = (path + top).hex()
                rest = [hexed[i : i + 64] for i in range(0, len(hexed), 64)]
                if node is not None:
                    node, rest = folded(node, at, n, rest)
                    node, rest = folded(node, tree, trees, rest)
                out.append(node)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*columns, "folded_root"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in proofs.schema)
    return proofs.mapInArrow(fold, f"{kinds}, folded_root string")


def tampered(proofs: DataFrame, claimed: str) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of manifest(): whether the leaf claimed still makes the root."""
    checked = refolded(proofs, claimed)
    proof = F.sha2(F.lower(F.hex(F.concat("path", "top_path"))), 256)
    return checked.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """The same manifest and check in SQL, level after level of all trees."""
    sized = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda n_chars: "sha256(" + " || ".join(sized(n_chars if c == "n_chars" else c) for c in COLUMNS) + ")"

    def levels(name: str, start: str, tree: str) -> str:
        return f"{name} AS ({start} UNION ALL SELECT {tree}k + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY {tree}k, pos // 2)"

    def folds(name: str, start: str, nodes: str, tree: str) -> str:
        same = f"s.k = f.k AND s.pos = xor(f.pos, 1){' AND s.tree = f.tree' if tree else ''}"
        node = "CASE WHEN s.h IS NULL THEN sha256(node) WHEN f.pos % 2 = 0 THEN sha256(node || s.h) ELSE sha256(s.h || node) END"
        return f"{name} AS ({start} UNION ALL SELECT id, f.tree, f.k + 1, f.pos // 2, (f.n + 1) // 2, {node}, proof || coalesce(s.h, '') FROM {name} f LEFT JOIN {nodes} s ON {same} WHERE f.n > 1)"

    return f"""
    WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    d AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 7 = 0 AS forged FROM documents, crcs),
    e AS (SELECT *, CASE WHEN forged THEN n_chars + 1 ELSE n_chars END AS claimed_chars FROM d),
    l AS (SELECT doc_id, lang, {leaf_of('n_chars')} AS leaf, {leaf_of('claimed_chars')} AS claimed FROM e),
    p AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM l),
    {levels('own', 'SELECT tree, 0 AS k, pos, leaf AS h, n FROM p', 'tree, ')},
    sub AS (SELECT tree, h FROM own WHERE n = 1),
    {levels('top', 'SELECT 0 AS k, tree AS pos, h, (SELECT count(*) FROM sub) AS n FROM sub', '')},
    {folds('f1', "SELECT id, tree, 0 AS k, pos, n, claimed AS node, '' AS proof FROM p", 'own', 'tree')},
    {folds('f2', 'SELECT id, tree, 0 AS k, tree AS pos, (SELECT count(*) FROM sub) AS n, node, proof FROM f1 WHERE n = 1', 'top', '')}
    SELECT doc_id, leaf, sub.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
    FROM p JOIN sub USING (tree) JOIN f2 USING (id), (SELECT h FROM top WHERE n = 1) r WHERE f2.n = 1
    """


ORACLE = _sql()
