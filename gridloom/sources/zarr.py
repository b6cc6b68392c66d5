"""Zarr stores (versions 2 and 3) as tables of variables and chunks.

A store's one document of metadata is all that is opened to know its arrays, where it has one.  Chunks are addressed by number, never
listed: the scan is the data source of ``datasource``.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import ship
from gridloom.operators.select import Range, chunk_range, clamp_request
from gridloom.sources.codecs import DamagedChunk, UnsupportedCodec, decode, encode
from gridloom.sources.ranged import length, on_web, put, read_range, read_whole

VARIABLES = "name string, data_type string, shape array<long>, dims array<string>, chunk_shape array<long>, units string, long_name string, attributes map<string,string>, meta string"


def _text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _v2(path: str, meta: dict, attributes: dict) -> tuple:
    codecs = [{"name": f["id"], "configuration": f} for f in meta.get("filters") or []]
    if meta.get("compressor"):
        c = meta["compressor"]
        codecs.append({"name": c["id"], "configuration": c})
    info = {"dtype": meta["dtype"], "codecs": codecs, "fill": meta.get("fill_value"), "sep": meta.get("dimension_separator", "."), "prefix": "", "order": meta.get("order", "C")}
    return _row(path, np.dtype(meta["dtype"]).name, meta["shape"], meta["chunks"], attributes.get("_ARRAY_DIMENSIONS"), attributes, info)


def _v3(path: str, meta: dict, attributes: dict) -> tuple:
    codecs, grid, shard = meta.get("codecs", []), meta["chunk_grid"]["configuration"]["chunk_shape"], None
    if any(c["name"] == "sharding_indexed" for c in codecs):
        if len(codecs) > 1:
            raise UnsupportedCodec("codecs around shards")
        how = codecs[0]["configuration"]
        shard = {"shape": grid, "index": how["index_codecs"], "at": how.get("index_location", "end")}
        codecs, grid = how["codecs"], how["chunk_shape"]
        if any(c["name"] == "sharding_indexed" for c in codecs):
            raise UnsupportedCodec("shards in shards")
    endian = next((c.get("configuration", {}).get("endian", "little") for c in codecs if c["name"] == "bytes"), "little")
    kind = np.dtype(meta["data_type"])
    key = meta.get("chunk_key_encoding", {"name": "default"})
    sep = key.get("configuration", {}).get("separator", "/" if key["name"] == "default" else ".")
    info = {"dtype": kind.newbyteorder(">" if endian == "big" else "<").str, "codecs": codecs, "fill": meta.get("fill_value"), "sep": sep, "prefix": "c" + sep if key["name"] == "default" else "", "order": "C", "shard": shard}
    return _row(path, kind.name, meta["shape"], grid, meta.get("dimension_names"), attributes, info)


def _row(path, kind, shape, chunks, dims, attributes, info) -> tuple:
    names = {1: ["x"], 2: ["lat", "lon"], 3: ["time", "lat", "lon"], 4: ["time", "level", "lat", "lon"]}
    dims = list(dims) if dims and all(dims) else names.get(len(shape), [f"dim_{k}" for k in range(len(shape))])
    texts = {k: _text(v) for k, v in attributes.items()}
    return (path, kind, [int(n) for n in shape], dims, [int(n) for n in chunks], texts.get("units"), texts.get("long_name"), texts, json.dumps(info))


#: Documents that hold the metadata of a whole store: version 2's, and the root group of version 3.
CONSOLIDATED = (".zmetadata", "zarr.json")


def consolidated(store: str) -> dict[str, dict] | None:
    """Metadata documents by path out of the store's one document; None where it has none."""
    for name in CONSOLIDATED:
        raw = read_whole(f"{store.rstrip('/')}/{name}")
        if raw is None:
            continue
        root = json.loads(raw)
        if name == ".zmetadata":
            return root.get("metadata", {})
        inner = (root.get("consolidated_metadata") or {}).get("metadata")
        if inner is not None:
            return {name: root} | {f"{path}/{name}".lstrip("/"): doc for path, doc in inner.items()}
    return None


def _documents(spark: SparkSession, store: str) -> dict[str, dict]:
    """Metadata documents by path: the store's one document where there is one, else those of its groups and arrays.  Folders of chunks are
    never walked; Spark's readers pass over files with a leading dot, so the file system that they use is asked directly."""
    found = consolidated(store)
    if found is not None:
        return found
    if on_web(store):
        raise FileNotFoundError(f"{store} has no document of all its metadata, and folders on the web cannot be walked; open its arrays by name")
    found = {}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(store)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def load(folder, path: str, name: str) -> bool:
        file = jvm.org.apache.hadoop.fs.Path(folder, name)
        if not fs.exists(file):
            return False
        stream = fs.open(file)
        try:
            found[f"{path}/{name}".lstrip("/")] = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return True

    def walk(folder, path: str) -> None:
        load(folder, path, ".zattrs")
        if load(folder, path, ".zarray"):
            return
        if load(folder, path, "zarr.json") and found[f"{path}/zarr.json".lstrip("/")].get("node_type") == "array":
            return
        for status in fs.listStatus(folder):
            if status.isDirectory():
                walk(status.getPath(), f"{path}/{status.getPath().getName()}".lstrip("/"))

    walk(root, "")
    return found


def _described(path: str, documents: dict[str, dict]) -> tuple | None:
    """The row of ``variables`` of the array at a path; its attributes are those of the groups above it too, the nearest wins."""
    attributes, parts = {}, path.split("/") if path else []
    for k in range(len(parts) + 1):
        above = "/".join(parts[:k])
        attributes |= documents.get(f"{above}/.zattrs".lstrip("/"), {}) | documents.get(f"{above}/zarr.json".lstrip("/"), {}).get("attributes", {})
    for name, read in ((f"meta/root/{path}.array.json" if path else "meta/root.array.json", _early_v3), (f"{path}/zarr.json".lstrip("/"), _v3), (f"{path}/.zarray".lstrip("/"), _v2)):
        meta = documents.get(name)
        if meta is not None and (read is not _v3 or meta.get("node_type") == "array"):
            return read(path, meta, attributes | (meta.get("attributes", {}) if read is _early_v3 else {}))
    return None


def _early_v3(path: str, meta: dict, attributes: dict) -> tuple:
    """The form that version 3 had before it was final: documents below meta/root, chunks below data/root, one compressor."""
    grid = meta["chunk_grid"]
    codecs = [{"name": (c := meta["compressor"]).get("codec", "").rstrip("/").split("/")[-2 if "/" in c.get("codec", "") else -1], "configuration": c.get("configuration", {})}] if meta.get("compressor") else []
    sep = grid.get("separator", "/")
    info = {"dtype": np.dtype(meta["data_type"]).str, "codecs": codecs, "fill": meta.get("fill_value"), "sep": sep, "prefix": "c", "order": meta.get("chunk_memory_layout", "C")}
    return _row(path, np.dtype(meta["data_type"]).name, meta["shape"], grid["chunk_shape"], meta.get("dimension_names") or attributes.get("_ARRAY_DIMENSIONS"), attributes, info)


def open_array(store: str, variable: str) -> tuple:
    """The row of ``variables`` of one array, from the store's one document or else from the first of the array's possible documents that is
    there, and those of the groups above it; nothing is listed."""
    path, store = variable.strip("/"), store.rstrip("/")
    found = consolidated(store)
    if found is None or _described(path, found) is None:
        parts = path.split("/") if path else []
        keys = [f"meta/root/{path}.array.json" if path else "meta/root.array.json"]
        for k in range(len(parts) + 1):
            above = "/".join(parts[:k])
            keys += [f"{above}/{name}".lstrip("/") for name in ("zarr.json", ".zattrs")]
        keys.append(f"{path}/.zarray".lstrip("/"))
        found = {k: json.loads(raw) for k in keys if (raw := read_whole(f"{store}/{k}")) is not None}
    row = _described(path, found)
    if row is None:
        raise KeyError(variable)
    return row


def variables(spark: SparkSession, store: str) -> DataFrame:
    """One row per array of the store, with the attributes of the groups above it; the nearest wins."""
    found = _documents(spark, store)
    ends = ("/zarr.json", "/.zarray")
    paths = sorted({f"/{k}".rpartition("/")[0].lstrip("/") for k in found if f"/{k}".endswith(ends)})
    return spark.createDataFrame([row for p in paths if (row := _described(p, found))], VARIABLES)


def consolidate(spark: SparkSession, store: str, documents: dict[str, dict], version: int = 3) -> None:
    """Write the store's one document of all its metadata (by path below the store)."""
    if version == 2:
        put(f"{store.rstrip('/')}/.zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": documents}).encode())
        return
    inner = {k.removesuffix("zarr.json").rstrip("/"): v for k, v in documents.items() if k != "zarr.json"}
    root = {"zarr_format": 3, "node_type": "group", "attributes": documents.get("zarr.json", {}).get("attributes", {}), "consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": inner}}
    put(f"{store.rstrip('/')}/zarr.json", json.dumps(root).encode())


def _number(x, default=None):
    if isinstance(x, list):
        x = x[0] if x else None
    try:
        return float(x)
    except (TypeError, ValueError):
        return default


#: What the index of a shard says of both place and length of a chunk that is not there.
ABSENT = 2**64 - 1


def shard_index(file: str, count: int, codecs: str, at: str, verify: bool) -> np.ndarray | None:
    """Place and length of each of the ``count`` chunks in a shard, read by range; None where there is no shard."""
    chain = json.loads(codecs)
    size = count * 16
    stored = size + 4 * sum(c["name"] == "crc32c" for c in chain)
    total = length(file)
    if total is None:
        return None
    if total < stored or any(c["name"] not in ("bytes", "crc32c") for c in chain):
        raise DamagedChunk(file) if total < stored else UnsupportedCodec("codecs of a shard's index")
    raw = decode(read_range(file, 0 if at == "start" else total - stored, stored), chain, 8, verify)
    big = any(c.get("configuration", {}).get("endian") == "big" for c in chain)
    return np.frombuffer(raw, ">u8" if big else "<u8").reshape(count, 2)


class Layout:
    """Where the chunks of an array are and what their bytes mean; made from a row of ``variables``."""

    def __init__(self, row):
        _, _, self.shape, self.dims, self.sizes, _, _, attributes, meta = row
        info = json.loads(meta)
        self.kind, self.order, self.codecs, self.sep, self.prefix = np.dtype(info["dtype"]), info["order"], info["codecs"], info["sep"], info["prefix"]
        self.shard = info.get("shard")
        self.turns = [c["configuration"]["order"] for c in self.codecs if c["name"] == "transpose"]
        self.codecs = [c for c in self.codecs if c["name"] != "transpose"]
        self.default = _number(info["fill"], math.nan if self.kind.kind == "f" else 0.0)
        self.scaling = [_number(attributes.get(k)) for k in ("scale_factor", "add_offset", "valid_min", "valid_max")]
        self.fill = _number(attributes.get("_FillValue"), _number(attributes.get("missing_value")))

    def key(self, place) -> str:
        """Path of a chunk below the array; an array without dimensions has one chunk."""
        return self.prefix + self.sep.join(map(str, place)) if self.dims else (self.prefix.rstrip(self.sep) or "0")

    def content(self, folder: str, place, verify: bool = False, index_of=shard_index) -> bytes | None:
        """Bytes of a chunk of the array in a folder: a file of its own, or a range of a shard's file; ``index_of`` may remember what
        :func:`shard_index` gave."""
        if not self.shard:
            return read_whole(f"{folder}/{self.key(place)}")
        counts = [s // c for s, c in zip(self.shard["shape"], self.sizes, strict=True)]
        file = f"{folder}/{self.key([p // n for p, n in zip(place, counts, strict=True)])}"
        index = index_of(file, math.prod(counts), json.dumps(self.shard["index"]), self.shard["at"], verify)
        inner = int(np.ravel_multi_index([p % n for p, n in zip(place, counts, strict=True)], counts)) if counts else 0
        if index is None or int(index[inner, 0]) == ABSENT:
            return None
        return read_range(file, int(index[inner, 0]), int(index[inner, 1]))

    def values(self, content: bytes | None, place, calibrate: bool = True, verify: bool = False) -> np.ndarray:
        """Values of the part of a chunk that is inside the array; the fill value where there is no content."""
        size = [min(c, n - p * c) for p, c, n in zip(place, self.sizes, self.shape, strict=True)]
        if content is None:
            data = np.full(size, self.default)
        else:
            shape = self.sizes
            for turn in self.turns:
                shape = [shape[k] for k in turn]
            raw = np.frombuffer(decode(content, self.codecs, self.kind.itemsize, verify), self.kind).reshape(shape, order=self.order)
            for turn in reversed(self.turns):
                raw = raw.transpose(np.argsort(turn))
            data = raw[tuple(slice(0, n) for n in size)].astype(np.float64)
        if self.kind.kind == "b":
            return (data != 0).astype(np.float64)
        return calibrated(data, self.fill, *self.scaling) if calibrate else data


def chunks(spark: SparkSession, store: str, variable: str, calibrate: bool = True, verify: bool = False, **selections) -> DataFrame:
    """c_<dim> columns, origin, shape and values (row-major floats) of the chunks that the selections touch.  A chunk without a
    file holds the fill value.  With ``verify`` a chunk whose checksum does not fit its bytes fails the query.  Partitions are planned
    from the array's shape (``datasource``); no folder is listed."""
    from gridloom.sources import datasource

    table = datasource.scan(spark, store, variable, rows="chunks", calibrate=calibrate, verify=verify)
    layout = Layout(open_array(store, variable))
    for d, n, c in zip(layout.dims, layout.shape, layout.sizes, strict=True):
        if d in selections:
            first, last = chunk_range(clamp_request(selections[d], n), c)
            table = table.where((F.col(f"c_{d}") >= first) & (F.col(f"c_{d}") <= last))
    return table


def calibrated(data: np.ndarray, fill, factor, offset, low, high) -> np.ndarray:
    """Packed values to real ones: fill and out-of-range values become NaN."""
    bad = np.zeros(data.shape, bool)
    if fill is not None:
        bad |= np.abs(data - fill) <= max(abs(fill) * 1e-5, 1e-12)
    if low is not None:
        bad |= data < low
    if high is not None:
        bad |= data > high
    return np.where(bad, np.nan, data * (1 if factor is None else factor) + (offset or 0))


def cells(table: DataFrame, dims: list[str], **selections) -> DataFrame:
    """Cells of chunk rows: one index column per dimension and v, null where missing; only those inside the selections."""
    flat = table.select("origin", "shape", F.posexplode("values").alias("_p", "_v"))
    stride, out = F.lit(1), []
    for k in range(len(dims) - 1, -1, -1):
        n = F.element_at("shape", k + 1)
        out.append((F.element_at("origin", k + 1) + F.pmod(F.floor(F.col("_p") / stride), n)).cast("long").alias(dims[k]))
        stride = stride * n
    result = flat.select(*reversed(out), F.when(~F.isnan("_v"), F.col("_v").cast("double")).alias("v"))
    for d, s in selections.items():
        start, stop = s.bounds()
        result = result.where((F.col(d) >= start) & (F.col(d) < stop))
    return result


def write(table: DataFrame, store: str, variable: str, dims: list[str], shape: list[int], chunk_shape: list[int], attributes: dict | None = None, codecs: list[str | dict] | None = None, version: int = 3, data_type: str = "<f4", inner: list[int] | None = None) -> None:
    """Write chunk rows (c_<dim>, shape, values; row-major) as an array of a Zarr store, a file a chunk.

    A file is named by its chunk alone and written whole, so a task that runs twice leaves the same store.  Chunks at the upper
    edges are padded with missing values (integers: the attribute _FillValue).  Values are those that are stored: packed ones
    have to be packed before.  Chunks without a row get no file.  With ``inner`` (version 3) a row is a shard: its file holds chunks of that
    shape, which has to divide ``chunk_shape``, and an index of them at its end; those that lie outside the row's shape are left out.  A codec
    is a name, or a dict of ``name`` and ``configuration``."""
    ship(table.sparkSession)
    kind, codecs, attributes = np.dtype(data_type), codecs or [], attributes or {}
    fill = attributes.get("_FillValue", 0) if kind.kind != "f" else "NaN"
    if inner and (version != 3 or any(n % c for n, c in zip(chunk_shape, inner, strict=True))):
        raise ValueError("shards need version 3 and a shape that their chunks divide")
    usual = {"shuffle": {"elementsize": kind.itemsize}, "zstd": {"level": 3, "checksum": False}, "gzip": {"level": 5}, "blosc": {"typesize": kind.itemsize, "cname": "lz4", "clevel": 5, "shuffle": "shuffle" if version == 3 else 1, "blocksize": 0}}
    chain = [{"name": c, "configuration": usual.get(c, {})} if isinstance(c, str) else {"name": c["name"], "configuration": usual.get(c["name"], {}) | c.get("configuration", {})} for c in codecs]
    folder = f"{store.rstrip('/')}/{variable}"
    if version == 3:
        front = {"name": "bytes", "configuration": {"endian": "big" if data_type.startswith(">") else "little"}}
        parts = [front, *chain]
        if inner:
            parts = [{"name": "sharding_indexed", "configuration": {"chunk_shape": inner, "codecs": parts, "index_codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}], "index_location": "end"}}]
        meta = {"zarr_format": 3, "node_type": "array", "shape": shape, "data_type": kind.newbyteorder("=").name, "dimension_names": dims, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk_shape}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": fill, "codecs": parts, "attributes": attributes}
        documents, prefix, sep = {"zarr.json": meta}, "c/", "/"
    else:
        ids = [{"id": c["name"], **c["configuration"]} for c in chain]
        meta = {"zarr_format": 2, "shape": shape, "chunks": chunk_shape, "dtype": data_type, "fill_value": fill, "order": "C", "filters": ids[:-1] or None, "compressor": ids[-1] if ids else None}
        documents, prefix, sep = {".zarray": meta, ".zattrs": {**attributes, "_ARRAY_DIMENSIONS": dims}}, "", "."
    names = [f"c_{d}" for d in dims]

    def packed(data: np.ndarray, size: list[int]) -> bytes:
        if not inner:
            return encode(data.tobytes(), chain, kind.itemsize)
        counts = [n // c for n, c in zip(chunk_shape, inner, strict=True)]
        index, body = np.full((*counts, 2), ABSENT, "<u8"), bytearray()
        for at in np.ndindex(*counts):
            low = [k * c for k, c in zip(at, inner, strict=True)]
            if all(a < n for a, n in zip(low, size, strict=True)):
                piece = encode(data[tuple(slice(a, a + c) for a, c in zip(low, inner, strict=True))].tobytes(), chain, kind.itemsize)
                index[at] = len(body), len(piece)
                body += piece
        return bytes(body) + encode(index.tobytes(), [{"name": "crc32c"}], 8)

    def run(batches):
        for b in batches:
            places = list(zip(*[b.column(k).to_pylist() for k in range(len(dims))], strict=True))
            for place, size, values in zip(places, b.column(len(dims)).to_pylist(), b.column(len(dims) + 1), strict=True):
                data = np.full(chunk_shape, np.nan if kind.kind == "f" else fill, kind)
                data[tuple(slice(0, n) for n in size)] = values.values.to_numpy(zero_copy_only=False).reshape(size)
                put(f"{folder}/{prefix}{sep.join(map(str, place))}", packed(data, size))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    table.select(*names, "shape", "values").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    for name, document in documents.items():
        put(f"{folder}/{name}", json.dumps(document).encode())


def chunk_rows(rows: DataFrame, index: str, array: str, width: int, size: int, dims: tuple[str, str] = ("y", "x")) -> DataFrame:
    """Rows that hold one line of an array each (index, array of ``width``), as chunks of ``size`` lines; absent lines are NaN up to
    the last line of the chunk."""
    at = F.col(index).cast("long")
    chunks = rows.groupBy(F.floor(at / size).cast("long").alias(f"c_{dims[0]}")).agg(F.map_from_entries(F.collect_list(F.struct((at % size).alias("k"), F.col(array).alias("v")))).alias("_m"), F.max(at % size).alias("_last"))
    blank = F.array_repeat(F.lit(float("nan")), width)
    values = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_last")), lambda k: F.coalesce(F.try_element_at("_m", k).cast("array<double>"), blank)))
    return chunks.select(f"c_{dims[0]}", F.lit(0).cast("long").alias(f"c_{dims[1]}"), F.array(F.col("_last") + 1, F.lit(width).cast("long")).alias("shape"), values.alias("values"))
