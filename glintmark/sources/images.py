"""Image archives by layer: credentials baked into configurations and layers, with the layer, and whether a later layer hides them.

An image archive is a tar file with a manifest (`manifest.json`, or `index.json` with its blobs) that names configurations and layers in order.
`read` indexes images by seeking from header to header, deals the layers out, and streams each from its place in the archive in
a task of its own, so neither an image nor a layer is held whole and a large image is read by many tasks. Layers may be plain, gzip, bzip2, xz or (if the library is there) zstd.

A file of a layer is hidden by a later one that has a file, link or whiteout (`.wh.name`) at its path or above it, a folder at its path, or an opaque mark (`.wh..wh..opq`)
above it. What is hidden can still be taken out of the image, so it is reported, with `removed_in`. A damaged layer gives what came before the damage and a
`failed` row; other layers come. Tar files without a manifest aren't images and give nothing.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import tarfile
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, tree
from .workers import reach

# Names of keys, stand-ins for values, names of files that are looked into.
PAIR = re.compile(r"(?im)^\s*([A-Z0-9_.-]*(?:SECRET|TOKEN|PASSW(?:OR)?D|API_?KEY|ACCESS_?KEY|PRIVATE_?KEY|CREDENTIAL)[A-Z0-9_.-]*)\s*[:=]\s*[\"']?([^\s\"'#]{4,})")
STAND_IN = re.compile("(?i)^(your[_-]|<|\\{|\\$|xxx|change[_-]?me|placeholder|example|none$|null$|true$|false$)")
TELLING = re.compile(r"(?i)\.(env|ini|conf|cfg|ya?ml|json|properties|txt)$|credential|secret|\.netrc|\.npmrc")

INDEX = ["image", "position", "layer", "start", "size", "kind", "key", "value"]
INDEX_SCHEMA = "image string, position int, layer string, start long, size long, kind string, key string, value string"
EVENT = ["image", "position", "layer", "kind", "at", "line", "key", "value"]
EVENT_SCHEMA = "image string, position int, layer string, kind string, at string, line int, key string, value string"


class Slice(io.RawIOBase):
    """A range of a file as a stream that is read forwards."""

    def __init__(self, source: BinaryIO, start: int, size: int) -> None:
        self.source, self.left = source, size
        source.seek(start)

    def read(self, n: int = -1) -> bytes:
        got = self.source.read(self.left if n < 0 else min(n, self.left)) if self.left else b""
        self.left -= len(got)
        return got


def index_rows(image: str, source: BinaryIO) -> Iterator[tuple]:
    """INDEX rows of an image: kind layer (position from 1), env (position 0) or failed, with the reason as value."""
    try:
        with tarfile.open(fileobj=source, mode="r:") as t:
            members = {posixpath.normpath(m.name): m for m in t}

            def member(name: str) -> tarfile.TarInfo:
                m = members[posixpath.normpath(name)]
                return member(posixpath.join(posixpath.dirname(m.name), m.linkname)) if m.issym() else m

            load = lambda name: json.load(t.extractfile(member(name)))
            blob = lambda d: "blobs/" + d["digest"].replace(":", "/")

            def of_index(found: dict) -> Iterator[tuple[str, list[str]]]:
                for d in found.get("manifests", []):
                    told = load(blob(d))
                    if "layers" in told:
                        yield blob(told["config"]), [blob(x) for x in told["layers"]]
                    else:
                        yield from of_index(told)

            if "manifest.json" in members:
                images = [(x.get("Config", ""), x.get("Layers") or []) for x in load("manifest.json")]
            else:
                images = list(of_index(load("index.json"))) if "index.json" in members else []
            for config, layers in images:
                env = ((load(config).get("config") or {}).get("Env") or []) if posixpath.normpath(config) in members else []
                for e in env:
                    if (m := PAIR.match(e)) and not STAND_IN.match(m[2]):
                        yield image, 0, config, None, None, "env", m[1], m[2]
                for k, name in enumerate(layers, 1):
                    if posixpath.normpath(name) in members:
                        yield image, k, name, member(name).offset_data, member(name).size, "layer", None, None
                    else:
                        yield image, k, name, None, None, "failed", None, "the layer isn't in the archive"
    except (*archives.BROKEN, KeyError, TypeError, AttributeError) as e:
        yield image, None, None, None, None, "failed", None, str(e) or type(e).__name__


def pairs(parts: Iterator[archives.Row]) -> Iterator[tuple[int, str, str]]:
    """line, key, value in the parts of a text; a value may stand lines below its key, in the next part."""
    tail, tail_line, last = "", 1, None
    for row in parts:
        within = last is not None and row.first_line == last
        text, first = (row.content, row.first_line) if last is None or within else (f"{tail}\n{row.content}", tail_line)
        had = 0 if last is None or within else len(tail)
        line, at = first, 0
        for m in PAIR.finditer(text):
            if m.end() > had and not STAND_IN.match(m[2]):
                line, at = line + text.count("\n", at, m.start(1)), m.start(1)
                yield line, m[1], m[2]
        last = row.first_line + row.content.count("\n")
        cut = text.rfind("\n", 0, len(text.rstrip())) + 1
        tail, tail_line = text[cut:], first + text.count("\n", 0, cut)


def layer_rows(image: str, position: int, layer: str, stream: BinaryIO, part_bytes: int = archives.PART) -> Iterator[tuple]:
    """EVENT rows of a layer: kind file, folder, whiteout, opaque (at: what it is about), value, failed."""
    try:
        magic = stream.read(4)
        stream = Joined(magic, stream)
        if magic == b"\x28\xb5\x2f\xfd":
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
        with tarfile.open(fileobj=stream, mode="r|*", tarinfo=archives.Header) as t:
            for m in t:
                t.members = []
                at = posixpath.normpath("/" + m.name).lstrip("/")
                folder, name = posixpath.split(at)
                if name == ".wh..wh..opq":
                    yield image, position, layer, "opaque", folder, None, None, None
                    continue
                if name.startswith(".wh."):
                    yield image, position, layer, "whiteout", posixpath.join(folder, name[4:]), None, None, None
                    continue
                yield image, position, layer, "folder" if m.isdir() else "file", at, None, None, None
                if m.isfile() and TELLING.search(m.name):
                    for line, key, value in pairs(archives.texts_of(at, image, t.extractfile(m), part_bytes)):
                        yield image, position, layer, "value", at, line, key, value
            if damage := getattr(t, "damage", None):
                raise tarfile.ReadError(damage)
    except (*archives.BROKEN, ImportError) as e:
        yield image, position, layer, "failed", None, None, None, str(e) or type(e).__name__


class Joined:
    """A stream with what was read of it before."""

    def __init__(self, before: bytes, rest: BinaryIO) -> None:
        self.before, self.rest = before, rest

    def read(self, n: int = -1) -> bytes:
        if not self.before:
            return self.rest.read(n)
        got, self.before = (self.before, b"") if n < 0 else (self.before[:n], self.before[n:])
        return got + (self.rest.read(n - len(got) if n >= 0 else -1) if n < 0 or len(got) < n else b"")


def frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    typed = lambda: pd.DataFrame(held, columns=columns).astype({c: "Int64" for c in ("position", "line", "start", "size") if c in columns})
    for row in rows:
        held.append(row)
        if len(held) >= 10_000:
            yield typed()
            held = []
    if held:
        yield typed()


def index(names: DataFrame) -> DataFrame:
    """INDEX rows of the images named (path)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                fs, name, _ = tree.place(path)
                with fs.open_input_file(name) as f:
                    yield from frames(index_rows(path, f), INDEX)

    return names.select("path").mapInPandas(run, INDEX_SCHEMA)


def events(indexed: DataFrame) -> DataFrame:
    """EVENT rows of all layers, each streamed from its place in its image; env and failed rows of the index go on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                fs, name, _ = tree.place(x.image)
                with fs.open_input_file(name) as f:
                    yield from frames(layer_rows(x.image, x.position, x.layer, Slice(f, x.start, x.size)), EVENT)

    reach(indexed.sparkSession)
    layers = indexed.where("kind = 'layer'").select("image", F.col("position").cast("long").alias("position"), "layer", "start", "size")
    dealt = layers.repartition(layers.sparkSession.sparkContext.defaultParallelism * 8, "image", "position")
    rest = indexed.where("kind <> 'layer'").select("image", "position", "layer", "kind", F.lit(None).cast("string").alias("at"), F.lit(None).cast("int").alias("line"), "key", "value")
    return dealt.mapInPandas(run, EVENT_SCHEMA).unionByName(rest)


def resolved(events: DataFrame) -> DataFrame:
    """The value rows of events with removed_in: the position of the first later layer that hides the file, null if it is there in the end.

    A file's path and those above it meet the events by equality, so no image, layer or folder is one group.
    """
    values = events.where("kind = 'value'")
    once = values.select("image", "position", "at").distinct()
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("at", "/"))), lambda k: F.array_join(F.slice(F.split("at", "/"), 1, k), "/"))
    keyed = once.select("image", "position", F.col("at").alias("file"), F.explode(above).alias("at"))
    hiding = events.where("kind in ('file', 'folder', 'whiteout', 'opaque')").select("image", F.col("position").alias("later"), "kind", "at")
    hit = keyed.join(hiding, ["image", "at"]).where("later > position and (kind in ('file', 'whiteout') or kind = 'folder' and at = file or kind = 'opaque' and at <> file)")
    removed = hit.groupBy("image", "position", F.col("file").alias("at")).agg(F.min("later").alias("removed_in"))
    return values.join(removed, ["image", "position", "at"], "left")


def read(spark: SparkSession, at: str | list[str], exclude: list[str] | None = None) -> DataFrame:
    """path (image!file), image, layer, position, line, key, value, type (image_env, image_layer, failed), removed_in, of the image archives (.tar) below at.

    Layers are read twice: for values, and for what hides them.
    """
    names = tree.listing(spark, at, exclude).where("lower(path) like '%.tar'")
    found = events(index(names))
    path = F.when(F.col("at").isNull(), F.col("image")).otherwise(F.concat_ws("!", "image", "at"))
    kind = F.when(F.col("kind") == "failed", "failed").when(F.col("kind") == "env", "image_env").otherwise("image_layer")
    told = resolved(found).unionByName(found.where("kind in ('env', 'failed')").withColumn("removed_in", F.lit(None).cast("int")))
    return told.select(path.alias("path"), "image", "layer", "position", "line", "key", "value", kind.alias("type"), "removed_in")


def rows(binary: DataFrame) -> DataFrame:
    """EVENT rows of images that are rows already (path, content): all layers of one in a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                def each(path: str = path, data: bytes = data) -> Iterator[tuple]:
                    for x in index_rows(path, io.BytesIO(data or b"")):
                        if x[5] == "layer":
                            yield from layer_rows(path, x[1], x[2], Slice(io.BytesIO(data), x[3], x[4]))
                        else:
                            yield path, x[1], x[2], x[5], None, None, x[6], x[7]

                yield from frames(each(), EVENT)

    reach(binary.sparkSession)
    return binary.select("path", "content").mapInPandas(run, EVENT_SCHEMA)
