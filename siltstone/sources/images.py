"""Container images as graphs of blobs that are named by their contents: index, manifests, configurations and layers, joined by digest."""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from siltstone.sources.files import LAYER_BUDGET, MAX_LAYERS, MAX_MEMBERS, PEEK, _layer

#: Deepest index of indices that is followed; blobs of an image that hold JSON at most these bytes. Fixed values.
DEEPEST, JSON_BYTES = 4, 4 << 20
DIGEST = r"^[a-z0-9+._-]+:([0-9a-f]{32,})$"
_MANIFEST = "manifests array<struct<digest:string>>, config struct<digest:string>, layers array<struct<digest:string, mediaType:string>>"
_SAVED = "array<struct<Config:string, Layers:array<string>>>"


def digest(name) -> F.Column:
    """The hexadecimal part of a digest; null if it is none."""
    found = F.regexp_extract(name, DIGEST, 1)
    return F.when(found != "", found)


def members_of(archives: DataFrame) -> DataFrame:
    """(image, member, content): regular members of tar archives (path, content), whole, as the parts of an image."""

    def expand(row: Row) -> Iterator[tuple]:
        try:
            with tarfile.open(fileobj=io.BytesIO(row.content), mode="r|*") as tar:
                for m in tar:
                    if m.isreg():
                        yield row.path, m.name.removeprefix("./"), tar.extractfile(m).read()
        except (tarfile.TarError, EOFError, OSError, zlib.error):
            return

    return _streamed(archives.select("path", "content"), expand, "image string, member string, content binary")


def _streamed(rows: DataFrame, expand: Callable[[Row], Iterator[tuple]], schema: str) -> DataFrame:
    """What expand makes of each row, one row at a time. An Arrow batch is ten thousand rows, whatever they weigh, and an archive is a row; rows of an
    RDD come in batches of some megabytes, so that a worker holds an archive or a few small ones."""
    return rows.sparkSession.createDataFrame(rows.rdd.flatMap(expand), schema, verifySchema=False)


def folders_of(files: DataFrame) -> DataFrame:
    """(image, member, content) of files (path, content) that lie in unpacked images: folders with a manifest.json, or with an oci-layout and an index.json."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    at = files.select(folder.alias("image"), name.alias("name")).where(F.col("name").isin("manifest.json", "oci-layout", "index.json"))
    roots = at.groupBy("image").agg(F.collect_set("name").alias("names"))
    roots = roots.where(F.array_contains("names", "manifest.json") | (F.array_contains("names", "oci-layout") & F.array_contains("names", "index.json"))).select("image")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(F.split("path", "/"), F.lit(1), n), "/"))
    inside = files.select("path", "content", F.explode(above).alias("image")).join(roots, "image")  # by each folder above a file
    return inside.select("image", F.expr("substring(path, length(image) + if(image = '', 1, 2))").alias("member"), "content")


def layers_of(parts: DataFrame, most: int | None = MAX_LAYERS) -> tuple[DataFrame, DataFrame]:
    """Parts of images -> (image, no, layer, content) of their layers in order, and (image, config) of their configurations.

    A saved image names its layers by member; an image layout by digests: its index names manifests (or further indices), a manifest its
    configuration and layers, each an equi-join with the blobs on (image, digest). Names that are missing, malformed or lead out of the image are
    passed over. Of an index the first manifest counts.
    """
    def text(rows: DataFrame) -> DataFrame:
        return rows.where(F.length("content") <= JSON_BYTES).withColumn("text", F.decode("content", "UTF-8"))

    saved = text(parts.where("member = 'manifest.json'")).select("image", F.try_element_at(F.from_json("text", _SAVED), F.lit(1)).alias("m")).where("m is not null")
    inside = lambda c: (c != "") & ~c.rlike(r"^[/\\]") & ~F.array_contains(F.split(c, "/"), "..")
    named = saved.select("image", F.posexplode("m.Layers").alias("no", "member")).where(inside(F.col("member")))
    by_name = named.join(parts, ["image", "member"]).select("image", "no", F.col("member").alias("layer"), "content")
    named = saved.select("image", F.col("m.Config").alias("member")).where(inside(F.col("member")))
    configs = text(named.join(parts, ["image", "member"])).select("image", F.col("text").alias("config"))

    blobs = parts.select("image", F.regexp_extract("member", "^blobs/[a-z0-9]+/([0-9a-f]{32,})$", 1).alias("digest"), "content").where("digest <> ''").dropDuplicates(["image", "digest"])
    layouts = parts.where("member = 'oci-layout'").select("image").distinct().join(saved.select("image"), "image", "left_anti")
    at = text(parts.where("member = 'index.json'").join(layouts, "image")).select("image", F.from_json("text", _MANIFEST).alias("m"))
    manifests = at.where("m.layers is not null")
    for _ in range(DEEPEST):
        first = at.where("m.layers is null").select("image", digest(F.try_element_at(F.col("m.manifests"), F.lit(1))["digest"]).alias("digest")).where("digest is not null")
        at = text(first.join(blobs, ["image", "digest"])).select("image", F.from_json("text", _MANIFEST).alias("m"))
        manifests = manifests.unionByName(at.where("m.layers is not null"))
    named = manifests.select("image", F.posexplode("m.layers").alias("no", "layer")).select("image", "no", digest(F.col("layer.digest")).alias("digest")).where("digest is not null")
    by_digest = named.join(blobs, ["image", "digest"]).select("image", "no", F.concat(F.lit("layer:"), F.substring("digest", 1, 12)).alias("layer"), "content")
    named = manifests.select("image", digest(F.col("m.config.digest")).alias("digest")).where("digest is not null")
    configs = configs.unionByName(text(named.join(blobs, ["image", "digest"])).select("image", F.col("text").alias("config")))
    layers = by_name.unionByName(by_digest)
    return (layers if most is None else layers.where(F.col("no") < most)), configs


def layer_members(layers: DataFrame, *, members: int | None = MAX_MEMBERS, peek: int | None = PEEK, budget: int | None = LAYER_BUDGET) -> DataFrame:
    """(image, no, layer, member, content): regular members of layers, streamed; None lifts a limit."""

    def expand(row: Row) -> Iterator[tuple]:
        for name, body in _layer(io.BytesIO(row.content), "", members, peek, budget):
            yield row.image, row.no, row.layer, name.removeprefix(">"), body

    return _streamed(layers.select("image", "no", "layer", "content"), expand, "image string, no int, layer string, member string, content binary")


def effective(found: DataFrame) -> DataFrame:
    """The members that an image shows: of a path the last layer counts; a whiteout (.wh.name) hides what lower layers have at and below the name, an
    opaque one (.wh..wh..opq) what they have in its folder. A member looks up its own path and each folder above it."""
    name, folder = F.element_at(F.split("member", "/"), -1), F.regexp_replace("member", "/?[^/]*$", "")
    marks = found.where(name.startswith(".wh."))
    hidden = F.when(name == ".wh..wh..opq", folder).otherwise(F.concat_ws("/", F.when(folder != "", folder), F.substring(name, 5, 1 << 20)))
    marks = marks.select("image", hidden.alias("at"), F.col("no").alias("above"), (name == ".wh..wh..opq").alias("opaque"))
    marks = marks.groupBy("image", "at").agg(F.max(F.when(~F.col("opaque"), F.col("above"))).alias("above"), F.max(F.when(F.col("opaque"), F.col("above"))).alias("opaque"))
    files = found.where(~name.startswith(".wh."))
    last = files.groupBy("image", "member").agg(F.max("no").alias("no"))
    steps = F.transform(F.sequence(F.lit(0), F.size(F.split("member", "/"))), lambda n: F.array_join(F.slice(F.split("member", "/"), F.lit(1), n), "/"))
    tried = last.select("image", "member", "no", F.explode(steps).alias("at")).join(marks, ["image", "at"])
    gone = tried.where((F.col("above") > F.col("no")) | ((F.col("at") != F.col("member")) & (F.col("opaque") > F.col("no")))).select("image", "member").distinct()
    return files.join(last, ["image", "member", "no"], "left_semi").join(gone, ["image", "member"], "left_anti")
