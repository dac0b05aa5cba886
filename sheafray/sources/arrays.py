"""Readers and writers of chunked arrays, grid meshes and ragged stores.

Files are read with Spark's binaryFile source, so any file system Spark knows
will do, and decoded on the executors; one file is one row. Only metadata
(small JSON documents) is read on the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codecs import DECODE, ENCODE, FILTERS, decode_chunk


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document from any file system. Spark's sources pass over
    names that begin with a dot, as metadata files do, so Hadoop opens it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).open(where)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def array_meta(spark: SparkSession, path: str) -> dict:
    """Shape, chunks, dtype, order, codec, filters and separator of a zarr v2 array."""
    m = read_json(spark, f"{path}/.zarray")
    codec, filters = (m.get("compressor") or {}).get("id"), m.get("filters") or []
    if codec not in DECODE:
        raise ValueError(f"codec {codec} is not available")
    for f in filters:
        if f["id"] not in FILTERS:
            raise ValueError(f"filter {f['id']} is not available")
    return {"filters": filters, "shape": m["shape"], "chunks": m["chunks"], "dtype": m["dtype"], "order": m.get("order", "C"), "codec": codec, "separator": m.get("dimension_separator", "."), "fill": m.get("fill_value") or 0}


def pyramid(spark: SparkSession, path: str) -> dict[str, float]:
    """Level paths of an OME multiscale group and their scale."""
    m = read_json(spark, f"{path}/.zattrs")["multiscales"][0]["datasets"]
    return {d["path"]: next((float(t["scale"][-1]) for t in d.get("coordinateTransformations", []) if t.get("type") == "scale"), 1.0) for d in m}


def read_chunks(spark: SparkSession, path: str, z: tuple[int, int] | None = None) -> DataFrame:
    """(cz, cy, cx, data) of a 3-D zarr v2 array, data in C order; missing
    chunks are absent rows. ``z`` keeps the chunks that meet a voxel range, by
    their names, before anything is read."""
    meta = array_meta(spark, path)
    sep = re.escape(meta["separator"])
    place = rf"(\d+){sep}(\d+){sep}(\d+)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(place))
    keyed = files.select(*[F.regexp_extract("path", place, k).cast("int").alias(n) for k, n in enumerate(("cz", "cy", "cx"), 1)], "content", "length")
    if z:
        keyed = keyed.where((F.col("cz") >= z[0] // meta["chunks"][0]) & (F.col("cz") <= (z[1] - 1) // meta["chunks"][0]))
    shape, codec, filters, order, dtype = tuple(meta["chunks"]), meta["codec"], meta["filters"], meta["order"], np.dtype(meta["dtype"])

    def decode(batches):
        for rows in batches:
            out = []
            for raw in rows["content"]:
                data = decode_chunk(bytes(raw), codec, filters)
                if len(data) != int(np.prod(shape)) * dtype.itemsize:
                    raise ValueError("a chunk has another size than its metadata says")
                out.append(np.frombuffer(data, dtype).reshape(shape, order=order).tobytes("C"))
            yield rows[["cz", "cy", "cx"]].assign(data=out)

    return keyed.where("length > 0").select("cz", "cy", "cx", "content").mapInPandas(decode, "cz int, cy int, cx int, data binary")


def chunk_rows(spark: SparkSession, volume: np.ndarray, chunk: tuple[int, int, int]) -> DataFrame:
    """The chunk rows of an array in memory, for fixtures."""
    rows = []
    for cz, cy, cx in np.ndindex(*[-(-n // c) for n, c in zip(volume.shape, chunk, strict=True)]):
        block = np.zeros(chunk, volume.dtype)
        part = volume[cz * chunk[0] : (cz + 1) * chunk[0], cy * chunk[1] : (cy + 1) * chunk[1], cx * chunk[2] : (cx + 1) * chunk[2]]
        block[tuple(slice(0, n) for n in part.shape)] = part
        if block.any():
            rows.append((cz, cy, cx, bytearray(block.tobytes())))
    return spark.createDataFrame(rows, "cz int, cy int, cx int, data binary")


def chunk_files(chunks: DataFrame, separator: str = ".", codec: str | None = "zlib") -> DataFrame:
    """(path, content) of chunk rows as zarr files, dark chunks left out."""
    pack = ENCODE[codec]

    def encode(batches):
        for rows in batches:
            rows = rows[[any(d) for d in rows["data"]]]
            names = [separator.join(map(str, k)) for k in zip(rows["cz"], rows["cy"], rows["cx"], strict=True)]
            yield rows[[]].assign(path=names, content=[pack(bytes(d)) for d in rows["data"]])

    return chunks.select("cz", "cy", "cx", "data").mapInPandas(encode, "path string, content binary")


def save_files(files: DataFrame, root: str) -> int:
    """Write (path, content) rows below ``root``, a folder or a URI of a file
    system that all executors reach: to another name first, then moved, so
    that a repeated task leaves a whole file. Returns how many there are."""

    def write(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        system, top = fs.FileSystem.from_uri(root)
        for rows in batches:
            for name, content in zip(rows["path"], rows["content"], strict=True):
                target = f"{top.rstrip('/')}/{name}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as f:
                    f.write(content)
                if system.type_name == "hdfs" and system.get_file_info(target).type != fs.FileType.NotFound:
                    system.delete_file(target)  # a move there never replaces
                system.move(part, target)
            yield pd.DataFrame({"n": [len(rows)]})

    return files.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the first bit first, that widen one
    code early; 256 clears the table and 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        code = held >> bits - width
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("a TIFF strip with a code that is not in its table")
        if last:
            table.append(last + word[:1])
        out += word
        last = word
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    """Runs of bytes, each after its length."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


#: By TIFF's compression tag.
_TIFF_CODECS = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def _unpredicted(raw: bytes, width: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    """Rows of values from rows of differences: of values (2), or of the bytes
    of floats laid out by significance (3)."""
    if predictor == 1:
        return np.frombuffer(raw, dtype).reshape(-1, width)
    if predictor == 2 and dtype.kind in "ui":
        return np.cumsum(np.frombuffer(raw, dtype).reshape(-1, width), axis=1, dtype=dtype.newbyteorder("="))
    if predictor == 3 and dtype.kind == "f":
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(-1, width * dtype.itemsize), axis=1, dtype=np.uint8)
        values = np.ascontiguousarray(planes.reshape(-1, dtype.itemsize, width).transpose(0, 2, 1))
        return values.view(dtype.newbyteorder(">"))[..., 0]
    raise ValueError(f"a TIFF with the predictor {predictor} for {dtype}")


def decode_tiff(data: bytes) -> np.ndarray:
    """The image of a single-band TIFF, in strips or tiles: plain, or packed by
    deflate, LZW or PackBits, with or without a predictor."""
    end = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack(end + "I", data[4:8])
    (n,) = struct.unpack(end + "H", data[at : at + 2])
    sizes, tags = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}, {}
    for k in range(n):
        tag, kind, count, value = struct.unpack(end + "HHI4s", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if kind in sizes and kind != 2:
            form = f"{end}{count}{sizes[kind]}"
            size = struct.calcsize(form)
            where = struct.unpack(end + "I", value)[0] if size > 4 else None
            tags[tag] = struct.unpack(form, data[where : where + size] if where is not None else value[:size])
    packing, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if packing not in _TIFF_CODECS:
        raise ValueError(f"a TIFF with the compression {packing}")
    unpack = _TIFF_CODECS[packing]
    width, height, bits = tags[256][0], tags[257][0], tags.get(258, (1,))[0]
    dtype = np.dtype(f"{end}{ {1: 'u', 2: 'i', 3: 'f'}[tags.get(339, (1,))[0]] }{bits // 8}")
    if 322 in tags:
        tw, th = tags[322][0], tags[323][0]
        out, across = np.zeros((height, width), dtype), -(-width // tw)
        for k, (o, c) in enumerate(zip(tags[324], tags[325], strict=True)):
            tile = _unpredicted(unpack(data[o : o + c]), tw, dtype, predictor)
            r, q = k // across * th, k % across * tw
            out[r : r + th, q : q + tw] = tile[: height - r, : width - q]
        return out
    strips = [_unpredicted(unpack(data[o : o + c]), width, dtype, predictor) for o, c in zip(tags[273], tags[279], strict=True)]
    return np.concatenate(strips).astype(dtype, copy=False)[:height]


def encode_tiff(image: np.ndarray) -> bytes:
    """A one-strip little-endian TIFF of a 2-D array."""
    image = np.ascontiguousarray(image, image.dtype.newbyteorder("<"))
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    entries = [(256, 4, image.shape[1]), (257, 4, image.shape[0]), (258, 3, 8 * image.itemsize), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, image.shape[0]), (279, 4, image.nbytes), (339, 3, kind)]
    start = 8 + 2 + 12 * len(entries) + 4
    body = b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k == 4 else "<HH", *((start if t == 273 else v,) if k == 4 else (v, 0))) for t, k, v in entries)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + body + struct.pack("<I", 0) + image.tobytes()


def read_meshes(spark: SparkSession, root: str, rule: str = "nonnegative", spliced: bool = False) -> DataFrame:
    """(winding, variant, r, c, x, y, z, valid) of all ``wNNN`` folders that
    hold x.tif, y.tif and z.tif."""
    from ..operators.mesh import with_validity

    name = r"/w(\d{3,})([^/]*)/([xyz])\.tif$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif").load(root).where(F.col("path").rlike(name))
    parts = files.select(F.regexp_extract("path", name, 1).cast("int").alias("winding"), F.regexp_extract("path", name, 2).alias("variant"), F.regexp_extract("path", name, 3).alias("axis"), "content")
    if not spliced:
        parts = parts.where("variant = ''")

    def decode(rows):
        import pandas as pd

        grids = {a: decode_tiff(bytes(c)).astype(float) for a, c in zip(rows["axis"], rows["content"], strict=True)}
        if set(grids) != {"x", "y", "z"}:
            return pd.DataFrame({k: [] for k in ("winding", "variant", "r", "c", "x", "y", "z")})
        r, c = np.indices(grids["x"].shape)
        return pd.DataFrame({"winding": rows["winding"].iloc[0], "variant": rows["variant"].iloc[0], "r": r.ravel(), "c": c.ravel(), **{a: g.ravel() for a, g in grids.items()}})

    mesh = parts.groupBy("winding", "variant").applyInPandas(decode, "winding int, variant string, r int, c int, x double, y double, z double")
    return with_validity(mesh, rule)


def mesh_files(mesh: DataFrame) -> DataFrame:
    """(path, content) of meshes as TIFF folders; invalid vertices are -1. A
    winding is one grid and so one task."""

    def encode(rows):
        import pandas as pd

        shape = (int(rows["r"].max()) + 1, int(rows["c"].max()) + 1)
        out = []
        for a in "xyz":
            grid = np.full(shape, -1, np.float32)
            grid[rows["r"], rows["c"]] = np.where(rows["valid"], rows[a], -1)
            out.append((f"w{int(rows['winding'].iloc[0]):03d}/{a}.tif", encode_tiff(grid)))
        return pd.DataFrame(out, columns=["path", "content"])

    return mesh.groupBy("winding").applyInPandas(encode, "path string, content binary")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """(shard, ray_id, origin, step, seed_winding, crossings) of a crossing
    store: its manifest names the shards' npy files; a shard is one task."""
    manifest = read_json(spark, f"{root}/manifest.json")
    wanted = [(s["name"], name, a["file"]) for s in manifest["shards"] for name, a in s["arrays"].items()]
    names = spark.createDataFrame(wanted, "shard string, name string, file string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npy").load(root)
    tail = F.regexp_extract("path", r"([^/]+)/([^/]+\.npy)$", 1), F.regexp_extract("path", r"([^/]+\.npy)$", 1)
    rows = files.select(tail[0].alias("shard"), tail[1].alias("file"), "content").join(F.broadcast(names), ["shard", "file"])
    point = "struct<z:double,y:double,x:double>"

    def decode(part):
        import pandas as pd

        a = {n: np.load(io.BytesIO(bytes(c)), allow_pickle=False) for n, c in zip(part["name"], part["content"], strict=True)}
        off = a["crossing_offsets"]
        n = len(off) - 1
        vec = lambda v: [dict(zip("zyx", map(float, p), strict=True)) for p in v]
        crossings = [[{"t": float(t), "level": int(k)} for t, k in zip(a["crossing_t"][off[i] : off[i + 1]], a["crossing_level"][off[i] : off[i + 1]], strict=True)] for i in range(n)]
        return pd.DataFrame({"shard": part["shard"].iloc[0], "row": np.arange(n), "origin": vec(a["ray_origin_zyx"]), "step": vec(a["ray_step_zyx"]), "seed_winding": a.get("seed_winding", np.zeros(n)).astype(int), "crossings": crossings})

    rays = rows.groupBy("shard").applyInPandas(decode, f"shard string, row long, origin {point}, step {point}, seed_winding int, crossings array<struct<t:double,level:int>>")
    return rays.withColumn("ray_id", F.xxhash64("shard", "row"))


def store_files(rays: DataFrame) -> DataFrame:
    """(path, content, sha256, bytes) of rays as the arrays of each shard."""

    def encode(part):
        import pandas as pd

        part = part.sort_values("row")
        vec = lambda name, k: np.array([[p[a] for a in "zyx"] for p in part[name]], k).reshape(-1, 3)
        lists = list(part["crossings"])
        flat = [c for cs in lists for c in cs]
        arrays = {
            "ray_origin_zyx": vec("origin", "f4"),
            "ray_step_zyx": vec("step", "f4"),
            "crossing_offsets": np.concatenate([[0], np.cumsum([len(c) for c in lists])]).astype("i8"),
            "crossing_t": np.array([c["t"] for c in flat], "f4"),
            "crossing_level": np.array([c["level"] for c in flat], "i2"),
            "seed_winding": part["seed_winding"].to_numpy("i2"),
        }
        out = []
        for name, a in arrays.items():
            buffer = io.BytesIO()
            np.save(buffer, a, allow_pickle=False)
            raw = buffer.getvalue()
            out.append((f"{part['shard'].iloc[0]}/{name}.npy", raw, hashlib.sha256(raw).hexdigest(), len(raw)))
        return pd.DataFrame(out, columns=["path", "content", "sha256", "bytes"])

    return rays.groupBy("shard").applyInPandas(encode, "path string, content binary, sha256 string, bytes long")


def fingerprint(manifest: dict, volatile: tuple[str, ...] = ("fingerprint", "elapsed_seconds", "export_workers", "rays_per_task")) -> str:
    """SHA-256 of a manifest's canonical JSON (sorted keys, compact), without
    what changes from run to run."""

    def strip(x):
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k not in volatile}
        return [strip(v) for v in x] if isinstance(x, list) else x

    return hashlib.sha256(json.dumps(strip(manifest), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def read_axis(spark: SparkSession, path: str) -> DataFrame:
    """(z, y, x) of an axis document's control points."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.select(F.explode("control_points").alias("p")).select(*[F.col(f"p.{a}").cast("double").alias(a) for a in "zyx"])
