"""Merkle manifest: a digest of every row, a hash tree per group, a tree over the groups' roots, and proofs of membership.

A row's leaf is sha256 of its fields, each with its length in bytes. Leaves are sorted in runs by range of (group, id), so a
group that holds most rows is spread over many tasks; a run's first place follows from the sizes of the runs before it.
The node store is Parquet partitioned by level. It is built in bands of ``BAND`` levels: nodes are dealt by segments of
2^BAND successive places, each segment reads its nodes of the band's lowest level in order and writes those above, and
the next band reads only the highest of these. Proofs go the other way: band by band from the top, segments of all levels
of a band, sorted by coordinate, are merged with the path from their top to the root, so that what moves is a path a
segment, and a row's own path exists only inside the task that hashes it. No task holds more than a segment of 2^BAND rows;
the driver gets one size and the root.

Defined results: null fields hash as ``-``; a null group comes first and is a group of its own; null ids come first in
theirs; rows with equal ids go by their leaf, so repeated rows have one leaf at neighbouring places and a proof each. Where
an id is null, nothing is altered to test the proof. Empty and long texts are hashed whole. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scratch import shared_dir, written
from ._tables import table

#: Levels that a segment covers: a segment is 2^BAND nodes.
BAND = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, pos long, hash string, n long"


def digest(*parts: str) -> str:
    """Lower-case hex sha256 of the parts one after the other."""
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its number of UTF-8 bytes, a colon and its text, or ``-`` where null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a column ``tree``) plus ``pos``, the place from 0 within the tree by ``order``, and ``n``, the tree's size.

    Rows are sorted in runs by range. Only the runs' sizes are gathered, by tree; a window adds them up.
    """
    own = rows.columns
    run = F.shiftrightunsigned("at", 33)
    runs = written(rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id()), "runs")
    sizes = runs.groupBy("tree", run.alias("run")).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    by = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(by.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(sizes.select(F.col("tree").alias("of"), "run", (before - F.col("first")).alias("shift"), F.sum("rows").over(by).alias("n")), "sizes")
    placed = runs.withColumn("own_run", run).join(sizes, F.col("tree").eqNullSafe(F.col("of")) & (F.col("own_run") == F.col("run")))
    return placed.select(*own, (F.col("at") + F.col("shift")).alias("pos"), "n")


class Store:
    """Nodes of hash trees under ``path``, as Parquet partitioned by level; a band's levels are in ``above=<lowest level>``.

    Level 0 keeps the columns of ``rows`` beside (tree, pos, hash, n). ``depth`` is the height of the largest tree.
    """

    def __init__(self, rows: DataFrame, path: str):
        self.spark, self.path = rows.sparkSession, path
        rows.write.parquet(f"{path}/level=0")
        self.rows = self.spark.read.schema(rows.schema).parquet(f"{path}/level=0")
        most = self.rows.agg(F.max("n")).first()[0] or 1
        self.depth = (most - 1).bit_length()
        for low in range(0, self.depth, BAND):
            self._climb(low)

    def level(self, *levels: int) -> DataFrame:
        """(level, tree, pos, hash, n) of the levels named."""
        folder = lambda k: f"{self.path}/above={(k - 1) // BAND * BAND}" if k else self.path
        parts = [self.spark.read.schema(NODE).parquet(f"{folder(k)}/level={k}").withColumn("level", F.lit(k)) for k in levels if k <= self.depth]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _climb(self, low: int) -> None:
        """Writes the levels above ``low`` up to ``low + BAND`` from the nodes of ``low``."""

        def climb(key, nodes):
            nodes = nodes.sort_by("pos")
            hashes, start, n = nodes["hash"].to_pylist(), nodes["pos"][0].as_py(), nodes["n"][0].as_py()
            out = []
            for level in range(low + 1, low + BAND + 1):
                if n == 1:
                    break
                hashes, start, n = [digest(*hashes[i : i + 2]) for i in range(0, len(hashes), 2)], start >> 1, (n + 1) >> 1
                out += [(level, key[0].as_py(), start + i, h, n) for i, h in enumerate(hashes)]
            names = ("level", "tree", "pos", "hash", "n")
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, kinds))})

        nodes = self.level(low).where("n > 1").select("tree", "pos", "hash", "n", F.shiftright("pos", BAND).alias("segment"))
        nodes.groupBy("tree", "segment").applyInArrow(climb, f"level int, {NODE}").write.partitionBy("level").parquet(f"{self.path}/above={low}")

    def roots(self) -> DataFrame:
        """(tree, hash): what remains of each tree."""
        return self.level(*range(self.depth + 1)).where("n = 1").select("tree", "hash")

    def proofs(self, tops: DataFrame, emit: Callable, schema: str) -> DataFrame:
        """What ``emit`` makes of the rows of level 0 and their paths.

        ``tops``: (tree, path, root) with a path above each tree's own root. A path is a list of steps joined by commas, each
        the sibling's digest after ``L`` or ``R``, or ``-`` where a node has none. ``emit`` takes a segment's rows as a table,
        their paths as lists of steps, and the root; it returns a table of ``schema``.
        """
        height = F.ceil(F.log2("n")).cast("int")
        sizes = self.rows.where("pos = 0").select(F.col("tree").alias("of"), F.greatest(F.lit(0), F.floor((height - 1) / BAND)).cast("int").alias("band"))
        tops = written(tops.join(sizes, F.col("tree").eqNullSafe(F.col("of"))).select("tree", F.lit(0).cast("long").alias("segment"), "path", "root", "band"), "tops")
        given = None
        for band in reversed(range(max(1, -(-self.depth // BAND)))):
            own = tops.where(F.col("band") == band).drop("band")
            given = own if given is None else own.unionByName(given)
            inner = range(band * BAND + 1, min(self.depth, (band + 1) * BAND - 1) + 1)
            upper = given.select("tree", "segment", "path", "root", F.lit(None).cast("int").alias("up"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("hash"))
            if inner:
                nodes = self.level(*inner).where("n > 1")
                up = F.col("level") - band * BAND
                upper = upper.unionByName(nodes.select("tree", F.expr(f"shiftright(pos, {BAND} - (level - {band * BAND}))").alias("segment"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("root"), up.alias("up"), "pos", "hash"))
            base = self.rows if band == 0 else self.level(band * BAND).where("n > 1").drop("level")
            base = base.withColumn("segment", F.shiftright("pos", BAND))
            grown = base.groupBy("tree", "segment").cogroup(upper.groupBy("tree", "segment"))
            if band:
                given = written(grown.applyInArrow(_merge(_hand_down), "tree string, segment long, path string, root string"), "paths")
            else:
                return grown.applyInArrow(_merge(emit), schema)


def _merge(emit: Callable) -> Callable:
    """Of a segment's lowest nodes and the nodes and path above them: what ``emit`` makes of the nodes and their paths."""

    def merge(rows, above):
        rows = rows.sort_by("pos")
        place, left = rows["pos"].to_pylist(), rows["n"][0].as_py() if len(rows) else 0
        levels: list[dict[int, str]] = [dict(zip(place, rows["hash"].to_pylist()))] + [{} for _ in range(BAND)]
        path, root = "", None
        for step, top, up, pos, h in zip(*(above[c].to_pylist() for c in ("path", "root", "up", "pos", "hash"))):
            if up is None:
                path, root = step, top
            else:
                levels[up][pos] = h
        # the steps of a node, then those of its parent: each node's list is made once and shared by what stands below
        above_of = {p >> BAND: path.split(",") if path else [] for p in place}
        for up in reversed(range(BAND)):
            if (left - 1).bit_length() <= up:
                above_of = {p: s for p, s in ((p >> up, path.split(",") if path else []) for p in place)}
                continue
            found = {}
            for p in {q >> up for q in place}:
                sibling = levels[up].get(p ^ 1)
                found[p] = ["-" if sibling is None else ("L" if p & 1 else "R") + sibling, *above_of[p >> 1]]
            above_of = found
        return emit(rows, [above_of[p] for p in place], root)

    return merge


def _hand_down(rows: pa.Table, paths: list[list[str]], root: str) -> pa.Table:
    return pa.table({"tree": rows["tree"], "segment": rows["pos"], "path": pa.array([",".join(p) for p in paths], pa.string()), "root": pa.array([root] * len(rows), pa.string())})


def folded(start: str, path: list[str]) -> str:
    """The root that a leaf and the steps of its path give."""
    for step in path:
        start = digest(start) if step == "-" else digest(step[1:], start) if step[0] == "L" else digest(start, step[1:])
    return start


def proof_digest(path: list[str]) -> str:
    """sha256 of the siblings on a path, one after the other."""
    return digest(*(s[1:] for s in path))


def _store(rows: DataFrame, order: tuple[str, ...], base: str, name: str) -> Store:
    return Store(ranked(rows, *order), f"{base}/{name}")


def manifest(documents: DataFrame, altered: Column | None = None, base: str | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified) of every row of ``documents``.

    Needs the columns of ``FIELDS``; groups are those of ``lang``. ``altered``: a condition on rows whose n_chars counts one
    more when the proof is folded. ``proof`` holds the steps from leaf to root. ``base``: a folder for the node stores
    (``documents`` and ``groups``), else a new one under ``spark.checkpoint.dir``.
    """
    spark = documents.sparkSession
    base = base or f"{shared_dir(spark)}/merkle-{uuid.uuid4().hex}"
    fields = [F.col(c) for c in FIELDS]
    other = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    given = F.lit(None).cast("string") if altered is None else F.when(altered, leaf(*other))
    rows = written(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("tree"), leaf(*fields).alias("hash"), given.alias("given")), "leaves")
    groups = _store(rows, ("doc_id", "hash"), base, "documents")
    top = _store(groups.roots().select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "hash"), ("name",), base, "groups")
    root = top.roots().select("hash").first()
    root = root[0] if root else None

    def of_groups(rows: pa.Table, paths: list[list[str]], _) -> pa.Table:
        return pa.table({"tree": rows["name"], "path": pa.array([",".join(p) for p in paths], pa.string()), "root": rows["hash"]})

    above = top.proofs(spark.createDataFrame([(None, "", root)], "tree string, path string, root string"), of_groups, "tree string, path string, root string")

    def of_rows(rows: pa.Table, paths: list[list[str]], subroot: str) -> pa.Table:
        rest: dict[tuple[int, str], str] = {}

        def fold(h: str, path: list[str], pos: int) -> str:
            """Folds to the segment's top; the fold above it is made once for each digest that arrives there."""
            h = folded(h, path[:BAND])
            key = (pos >> BAND, h)
            if key not in rest:
                rest[key] = folded(h, path[BAND:])
            return rest[key]

        leaves, given = rows["hash"].to_pylist(), rows["given"].to_pylist()
        back = [fold(g or h, p, i) for h, g, p, i in zip(leaves, given, paths, rows["pos"].to_pylist())]
        text = lambda values: pa.array(values, pa.string())
        return pa.table({"doc_id": rows["doc_id"], "leaf": rows["hash"], "subroot": text([subroot] * len(rows)), "root": text([root] * len(rows)), "proof": pa.array(paths, pa.list_(pa.string())), "proof_sha256": text([proof_digest(p) for p in paths]), "folded_root": text(back), "verified": pa.array([b == root for b in back], pa.bool_())})

    return groups.proofs(above, of_rows, "doc_id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's leaf, roots, proof digest and the root that its proof gives after tampering."""
    documents = table(spark, sf_dir, "documents", *FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(documents, tampered).drop("proof")


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(**other: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(other.get(c, c)) for c in FIELDS) + ")"


#: Trees by recursion on levels; crc32 from its table of 256, made by recursion on bits.
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
rows AS (
  SELECT doc_id, lang, {_leaf_sql()} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) % 7 = 0 THEN {_leaf_sql(n_chars="(n_chars + 1)")} END AS given
  FROM documents, crc
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM rows
), nodes AS (
  SELECT 0 AS level, lang, pos, leaf AS h, n FROM placed
  UNION ALL SELECT level + 1, lang, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 2, n
), tops AS (
  SELECT lang, h, max(level) OVER () AS below, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, level AS height FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, pos, h, n FROM tops
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
), apex AS (SELECT h AS root, level AS height FROM upper WHERE n = 1),
steps AS (
  SELECT p.id, x.level, (p.pos >> x.level) & 1 AS side, s.h AS sibling
  FROM placed p JOIN (SELECT DISTINCT level, lang, n FROM nodes) x ON x.lang IS NOT DISTINCT FROM p.lang AND x.n > 1
  LEFT JOIN nodes s ON s.level = x.level AND s.lang IS NOT DISTINCT FROM p.lang AND s.pos = xor(p.pos >> x.level, 1)
  UNION ALL
  SELECT p.id, t.height + x.level, (t.pos >> x.level) & 1, s.h
  FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN (SELECT DISTINCT level, n FROM upper) x ON x.n > 1
  LEFT JOIN upper s ON s.level = x.level AND s.pos = xor(t.pos >> x.level, 1)
), proofs AS (
  SELECT id, coalesce(string_agg(sibling, '' ORDER BY level), '') AS siblings FROM steps GROUP BY id
), folds AS (
  SELECT id, 0 AS level, coalesce(given, leaf) AS h FROM placed
  UNION ALL SELECT f.id, f.level + 1, sha256(CASE WHEN s.side = 1 THEN coalesce(s.sibling, '') || f.h ELSE f.h || coalesce(s.sibling, '') END) FROM folds f JOIN steps s ON s.id = f.id AND s.level = f.level
), ends AS (SELECT id, arg_max(h, level) AS folded_root FROM folds GROUP BY id)
SELECT p.doc_id, p.leaf, t.h AS subroot, a.root, sha256(coalesce(q.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = a.root AS verified
FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang CROSS JOIN apex a JOIN ends e ON e.id = p.id LEFT JOIN proofs q ON q.id = p.id
"""
