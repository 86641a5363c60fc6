"""Containers as tables: files (owner, path, content, pages, dests), payloads (owner, name, content) and notes (owner, author). How a file is decoded is left to its reader;
what is asked of it is relational. Only sizes and hashes of payloads are shuffled, never their contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import vocab
from quire.operators import validate as V
from quire.sources import files as S

# Fixed values
ENTRIES_MOST = 64
MANIFEST = "format string, version int, pid string, pdf struct<pages: int>, payload map<string, struct<bytes: bigint, sha256: string>>"
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp"}


def manifests(payloads: DataFrame, name: str) -> DataFrame:
    """owner, manifest: that of each owner as a struct (nulls where it doesn't parse)."""
    return payloads.where(F.col("name") == name).groupBy("owner").agg(F.first(F.from_json(F.decode("content", "UTF-8"), MANIFEST)).alias("manifest"))


def owner_id(manifest: Column, path: Column) -> Column:
    """The id that the manifest names, else the file's name up to its first dot."""
    return F.coalesce(manifest["pid"], F.regexp_extract(path, r"([^/.]*)[^/]*$", 1))


def identified(files: DataFrame, payloads: DataFrame, name: str, form: str, marker: str | None = None) -> DataFrame:
    """owner, reason (null: a container), version, pid, pages, entries. Cheap tests come first: the magic, the marker (``name`` unless given) in the bytes, then what the reader found."""
    head = F.decode(F.substring("content", 1, 1024), "ISO-8859-1")
    found = files.select("owner", "path", "pages", F.contains(head, F.lit(S.PDF_MAGIC)).alias("_magic"), F.contains("content", F.lit((marker or name).encode())).alias("_marked"))
    counted = payloads.groupBy("owner").agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.max(F.col("name") == name), F.lit(False)).alias("_has"))
    x = found.join(counted, "owner", "left").join(manifests(payloads, name), "owner", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(no("_magic"), "magic").when(no("_marked"), "marker").when(F.col("entries").isNull(), "structure").when(F.coalesce("pages", F.lit(0)) <= 0, "pages")
        .when(no("_has"), "manifest").when(~F.coalesce(F.col("manifest.format") == form, F.lit(False)), "format")
    )
    return x.select("owner", reason.alias("reason"), "manifest.version", owner_id(F.col("manifest"), F.col("path")).alias("pid"), "pages", F.coalesce("entries", F.lit(0)).alias("entries"))


def verified(files: DataFrame, payloads: DataFrame, name: str, form: str, required=vocab.PAYLOADS, expected: DataFrame | None = None, each: int = S.PAYLOAD_MOST, total: int = S.TOTAL_MOST) -> DataFrame:
    """What is wrong with containers (owner, severity, rule, detail): no pages, too many entries, payloads missing, too large or other than their hashes, a manifest that
    contradicts the file, and, with ``expected`` (owner, pages, dests), pages or destinations that have changed. What isn't known isn't compared."""
    slim = payloads.select("owner", "name", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("sha"))
    listed = manifests(payloads, name)
    error = lambda rows, when, rule, detail: V.broken(rows, "owner", when, "error", rule, detail)
    out = error(files, F.coalesce("pages", F.lit(0)) <= 0, "PAGES", F.lit(""))
    sums = slim.groupBy("owner").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))
    out = out.unionByName(error(sums, F.col("n") > ENTRIES_MOST, "ENTRIES", F.col("n"))).unionByName(error(sums, (F.col("most") > each) | (F.col("bytes") > total), "CAPS", F.col("bytes")))
    wanted = files.select("owner", F.explode(F.array(*[F.lit(r) for r in required])).alias("name")).join(slim.select("owner", "name"), ["owner", "name"], "left_anti")
    out = out.unionByName(error(wanted, F.lit(True), "MISSING", F.col("name")))
    m = listed.join(files.select("owner", "pages"), "owner", "left")
    out = out.unionByName(error(m, ~F.coalesce(F.col("manifest.format") == form, F.lit(False)), "FORMAT", F.coalesce("manifest.format", F.lit(""))))
    out = out.unionByName(error(m, F.col("manifest.version").isNull(), "VERSION", F.lit(""))).unionByName(error(m, F.coalesce(F.col("manifest.pdf.pages") != F.col("pages"), F.lit(False)), "MANIFEST_PAGES", F.col("manifest.pdf.pages")))
    hashes = listed.select("owner", F.explode("manifest.payload").alias("name", "_p")).where("_p.sha256 <> ''").join(slim, ["owner", "name"])
    out = out.unionByName(error(hashes, F.col("sha") != F.col("_p.sha256"), "HASH", F.col("name")))
    if expected is not None:
        e = files.join(expected.select("owner", F.col("pages").alias("_pages"), F.col("dests").alias("_dests")), "owner")
        changed = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
        out = out.unionByName(error(e, changed("dests", "_dests"), "DESTS", F.col("dests"))).unionByName(error(e, changed("pages", "_pages") & (F.col("_pages") != 0), "PAGES_CHANGED", F.col("pages")))
    return out


def baseline(files: DataFrame, notes: DataFrame, author: str) -> DataFrame:
    """owner, pages, dests, ours, external: what has to be the same after a container is written again; notes whose author begins with ``author`` are ours."""
    ours = F.coalesce(F.startswith("author", F.lit(author)), F.lit(False))
    counted = notes.groupBy("owner").agg(F.count_if(ours).alias("ours"), F.count_if(~ours).alias("external"))
    zero = F.lit(0)
    return files.select("owner", "pages", "dests").join(counted, "owner", "left").withColumns({"ours": F.coalesce("ours", zero), "external": F.coalesce("external", zero)})


def image_url(content: Column, path: Column | None = None, mime: Column | None = None) -> Column:
    """An image's bytes as a data address for a model; its type as given, else by its name's extension, else PNG. One line, whatever its length
    (``base64`` breaks lines after 76 characters where the session says so)."""
    by_name = F.lit("image/png") if path is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in IMAGES.items() for x in p]), F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))), F.lit("image/png"))
    return F.concat(F.lit("data:"), by_name if mime is None else F.coalesce(F.nullif(mime, F.lit("")), by_name), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))
