"""The whole gate of a section as rules over tables: leads, graphs, comparison tables and tracks. Reports are as in ``validate``: (owner, severity, rule, detail).

The rules of one table are tried in one pass over it: a row carries the array of what it breaks, and only that is exploded. Nulls and blanks count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import vocab
from quire.operators import validate as V

# Fixed values
GIST_LEAST, FOCUS_LEAST, FOCUS_MOST = 30, 2, 4


def tried(rows: DataFrame, owner: str, *rules: tuple[Column, str, str, Column]) -> DataFrame:
    """rules: (when, severity, rule, detail). A rule whose condition is null isn't broken."""
    one = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))) for when, severity, rule, detail in rules]
    return rows.select(F.col(owner).cast("string").alias("owner"), F.explode(F.array_compact(F.array(*one))).alias("_b")).select("owner", "_b.*")


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\s+", ""), F.lit("")) == ""


def _outside(c: str, allowed) -> Column:
    return ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))


def _bare(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _at(*parts: str) -> Column:
    return F.concat_ws("/", *[F.col(p).cast("string") for p in parts])


def lead(rows: DataFrame, owner: str = "section_id", column: str = "lead") -> DataFrame:
    """A section's lead, struct<gist, focus: array>: absent is fine; else a gist of 30 characters and 2 to 4 points, none blank; a straight double quote is a warning each."""
    gist, focus = F.regexp_replace(F.col(f"{column}.gist"), r"^\s+|\s+$", ""), F.col(f"{column}.focus")
    n = F.coalesce(F.size(focus), F.lit(-1))
    good = n.between(FOCUS_LEAST, FOCUS_MOST)
    quoted = lambda c: F.contains(c, F.lit('"'))
    here = rows.where(F.col(column).isNotNull())
    whole = tried(
        here, owner, (_blank(gist), "error", "GIST_MISSING", F.lit("")), (~_blank(gist) & (F.length(gist) < GIST_LEAST), "error", "GIST_SHORT", F.length(gist)), (~good, "error", "FOCUS_COUNT", n),
        (quoted(F.col(f"{column}.gist")), "warning", "STRAIGHT_QUOTE", F.lit("gist")),
    )
    points = here.select(owner, good.alias("_good"), F.posexplode(focus).alias("_i", "_p"))
    return whole.unionByName(tried(points, owner, (F.col("_good") & _blank("_p"), "error", "FOCUS_BLANK", F.col("_i") + 1), (quoted(F.col("_p")), "warning", "STRAIGHT_QUOTE", F.lit("focus"))))


def nodes(rows: DataFrame, owner: str = "section_id") -> DataFrame:
    """Nodes (owner, view, id, label, short, cluster, evidence: array): what they have to have, and ids that repeat in a view."""
    at = _at("view", "id")
    own = tried(
        rows, owner, *[(_blank(c), "error", f"NODE_{c.upper()}", at) for c in ("label", "short", "cluster")], (_outside("cluster", vocab.CLUSTERS), "error", "CLUSTER", F.concat_ws(" ", at, "cluster")),
        (_bare("evidence"), "warning", "NODE_EVIDENCE", at),
    )
    return own.unionByName(V.duplicates(rows, owner, ["view", "id"], "NODE_ID"))


def edges(rows: DataFrame, known: DataFrame, owner: str = "section_id") -> DataFrame:
    """Edges (owner, view, from, to, rel, label, polarity, origin, evidence: array) of nodes ``known`` (owner, view, id): ends in their view, values of the vocabulary, no repeats."""
    at = F.concat_ws("/", F.col("view").cast("string"), F.concat_ws("->", F.col("from").cast("string"), F.col("to").cast("string")))
    relations = [r.rstrip("*") for names in vocab.RELATIONS.values() for r in names]
    out = tried(
        rows, owner, (_outside("rel", relations), "error", "REL", at), (_blank("label"), "error", "EDGE_LABEL", at), (_outside("polarity", vocab.POLARITIES), "error", "POLARITY", at),
        (_outside("origin", vocab.ORIGINS), "error", "ORIGIN", at), (_bare("evidence"), "error", "EDGE_EVIDENCE", at),
    ).unionByName(V.duplicates(rows, owner, ["view", "from", "to", "rel"], "EDGE"))
    for end in ("from", "to"):
        there = known.select(owner, "view", F.col("id").alias(end)).distinct()
        lost = rows.select(owner, "view", "from", "to", at.alias("_at")).join(there, [owner, "view", end], "left_anti")
        out = out.unionByName(V.broken(lost, owner, F.lit(True), "error", f"EDGE_{end.upper()}", F.col("_at")))
    return out


def matrix(cols: DataFrame, rows: DataFrame, cells: DataFrame, owner: str = "section_id") -> DataFrame:
    """Comparison tables: cols (owner, view, id, label), rows (with cluster) and cells (owner, view, row, col, mark, evidence: array): every cell is there with a known mark, and
    with evidence unless it is na; none is in an unknown column; and a view has both rows and columns."""
    key = [owner, "view"]
    named = lambda t, what: tried(t, owner, (_blank(F.col("id").cast("string")) | _blank("label"), "error", f"{what}_NAME", _at("view", "id")))
    out = named(cols, "COL").unionByName(named(rows, "ROW"))
    out = out.unionByName(tried(rows, owner, (~_blank("cluster") & _outside("cluster", vocab.CLUSTERS), "error", "ROW_CLUSTER", F.concat_ws(" ", _at("view", "id"), "cluster"))))
    grid = rows.select(*key, F.col("id").alias("row")).join(cols.select(*key, F.col("id").alias("col")), key).distinct()
    missing = grid.join(cells.select(*key, "row", "col"), [*key, "row", "col"], "left_anti")
    out = out.unionByName(V.broken(missing, owner, F.lit(True), "error", "CELL", _at("view", "row", "col")))
    marked = cells.join(rows.select(*key, F.col("id").alias("row")).distinct(), [*key, "row"], "left_semi")
    good = marked.join(cols.select(*key, F.col("id").alias("col")).distinct(), [*key, "col"], "left_semi")
    at = _at("view", "row", "col")
    out = out.unionByName(tried(good, owner, (_outside("mark", vocab.MARKS), "error", "MARK", F.concat_ws(" ", at, "mark")), (_bare("evidence") & ~F.coalesce(F.col("mark") == "na", F.lit(False)), "warning", "CELL_EVIDENCE", at)))
    strange = marked.join(cols.select(*key, F.col("id").alias("col")).distinct(), [*key, "col"], "left_anti")
    out = out.unionByName(V.broken(strange, owner, F.lit(True), "error", "CELL_COL", at))
    one_sided = rows.select(*key, F.lit("rows").alias("_has")).unionByName(cols.select(*key, F.lit("cols").alias("_has"))).groupBy(*key).agg(F.count_distinct("_has").alias("_n")).where("_n < 2")
    return out.unionByName(V.broken(one_sided, owner, F.lit(True), "error", "MATRIX", F.col("view")))


def tracks(rows: DataFrame, segments: DataFrame, owner: str = "section_id") -> DataFrame:
    """Tracks (owner, view, id, label, cluster, evidence: array) and their segments (owner, view, track, label, kind, len, evidence: array): names, kinds, positive lengths, at
    least one segment a track, and evidence on a segment or its track."""
    at = _at("view", "id")
    key = [owner, "view", "track"]
    out = tried(rows, owner, (_blank(F.col("id").cast("string")) | _blank("label"), "error", "TRACK_NAME", at), (~_blank("cluster") & _outside("cluster", vocab.CLUSTERS), "error", "TRACK_CLUSTER", at))
    empty = rows.select(owner, "view", F.col("id").alias("track")).join(segments.select(*key), key, "left_anti")
    out = out.unionByName(V.broken(empty, owner, F.lit(True), "error", "SEGMENTS", _at("view", "track")))
    backed = rows.groupBy(owner, "view", F.col("id").alias("track")).agg(F.max(~_bare("evidence")).alias("_backed"))
    on = _at("view", "track", "label")
    return out.unionByName(tried(
        segments.join(backed, key, "left"), owner, (_blank("label"), "error", "SEGMENT_LABEL", on), (_outside("kind", vocab.KINDS), "error", "KIND", on),
        (~F.coalesce(F.col("len") > 0, F.lit(False)), "error", "LENGTH", on), (_bare("evidence") & ~F.coalesce("_backed", F.lit(False)), "warning", "SEGMENT_EVIDENCE", on),
    ))
