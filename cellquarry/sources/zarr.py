"""zarr (version 2) arrays in folders or zip files, and the instrument layouts kept in them, without the zarr package."""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.functions.ids import cell_code, distinct_names
from cellquarry.operators.matrix import Matrix


#: Raised when what is written changes, so that cached copies are made again.
CONVERTER = 2


@dataclass(frozen=True)
class Store:
    """A zarr hierarchy by path: a folder, or a zip file (.zip)."""

    path: str

    def get(self, key: str) -> bytes | None:
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        if self.path.endswith(".zip"):
            with fs.open_input_file(root) as f, zipfile.ZipFile(f) as z:
                return z.read(key) if key in z.namelist() else None
        at = f"{root}/{key}"
        if fs.get_file_info(at).type != pafs.FileType.File:
            return None
        with fs.open_input_file(at) as f:
            return f.read()

    def children(self, group: str) -> list[str]:
        """Names right below a group, in order."""
        fs, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        if self.path.endswith(".zip"):
            with fs.open_input_file(root) as f, zipfile.ZipFile(f) as z:
                keys = [n[len(group) + 1 :] for n in z.namelist() if n.startswith(f"{group}/")]
            return sorted({k.split("/")[0] for k in keys if "/" in k})
        if fs.get_file_info(f"{root}/{group}").type != pafs.FileType.Directory:
            return []
        return sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/{group}")) if f.type == pafs.FileType.Directory)

    def attrs(self, name: str) -> dict:
        return json.loads(self.get(f"{name}/.zattrs".lstrip("/")) or b"{}")

    def meta(self, name: str) -> dict:
        found = self.get(f"{name}/.zarray")
        if found is None:
            raise KeyError(name)
        return json.loads(found)

    def has(self, name: str) -> bool:
        return self.get(f"{name}/.zarray") is not None

    def read(self, name: str, first: int = 0, last: int | None = None) -> np.ndarray:
        """Rows first .. last-1 of an array; only the chunks that hold them are opened."""
        m = self.meta(name)
        shape, chunks, kind = m["shape"], m["chunks"], np.dtype(m["dtype"])
        last = shape[0] if last is None else min(last, shape[0])
        out = np.full([max(last - first, 0), *shape[1:]], m["fill_value"] or 0, kind)
        sep = m.get("dimension_separator", ".")
        for at in np.ndindex(*(-(-s // c) for s, c in zip(shape, chunks, strict=True))):
            lo = at[0] * chunks[0]
            if lo >= last or lo + chunks[0] <= first:
                continue
            data = self.get(f"{name}/{sep.join(map(str, at))}")
            if data is None:
                continue
            block = np.frombuffer(decompress(data, m["compressor"]), kind).reshape(chunks, order=m.get("order", "C"))
            a, b = max(lo, first), min(lo + chunks[0], last)
            rest = tuple(slice(i * c, min((i + 1) * c, s)) for i, c, s in zip(at[1:], chunks[1:], shape[1:], strict=True))
            out[(slice(a - first, b - first), *rest)] = block[(slice(a - lo, b - lo), *(slice(0, s.stop - s.start) for s in rest))]
        return out


def decompress(data: bytes, how: dict | None) -> bytes:
    kind = (how or {}).get("id")
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if kind == "blosc":
        return unblosc(data)
    raise ValueError(f"compressor {kind} is not read")


def unblosc(data: bytes) -> bytes:
    """A blosc (version 1) frame with lz4, snappy, zlib or zstd inside; bytes may be shuffled."""
    flags, width, size, block = data[2], data[3], *struct.unpack_from("<II", data, 4)
    if flags & 2:
        return data[16 : 16 + size]
    codec = {1: "lz4_raw", 2: "snappy", 3: "zlib", 4: "zstd"}.get(flags >> 5)
    if codec is None or flags & 4:
        raise ValueError("blosclz and bit shuffling are not read")
    out = bytearray()
    starts = struct.unpack_from(f"<{-(-size // block)}i", data, 16)
    for i, at in enumerate(starts):
        n = min(block, size - i * block)
        parts = width if not flags & 16 and width <= 16 and block // width >= 128 and n == block else 1
        got = bytearray()
        for _ in range(parts):
            held = struct.unpack_from("<i", data, at)[0]
            piece, at = data[at + 4 : at + 4 + held], at + 4 + held
            want = n // parts
            got += piece if held == want else zlib.decompress(piece) if codec == "zlib" else pa.Codec(codec).decompress(piece, want, asbytes=True)
        if flags & 1 and width > 1:
            whole = len(got) // width * width
            got = np.frombuffer(bytes(got[:whole]), np.uint8).reshape(width, -1).T.tobytes() + bytes(got[whole:])
        out += got
    return bytes(out)


def _ranges(spark: SparkSession, n: int, step: int) -> DataFrame:
    parts = [(i, min(i + step, n)) for i in range(0, n, step)]
    return spark.createDataFrame(parts, "first long, last long").repartition(max(1, len(parts)))


def expression(spark: SparkSession, path: str, group: str = "cell_features", drop_aggregate: bool = True, step: int = 100) -> Matrix:
    """Feature-major columns (indptr by feature, indices of cells, data) as a matrix; each task reads a range of features.

    Names come from the group's attributes (feature_keys, feature_types); cell ids from cell_id (prefix, suffix).
    """
    store = Store(path)
    attrs, indptr = store.attrs(group), store.read(f"{group}/indptr").astype(np.int64)
    names, types = attrs["feature_keys"], attrs.get("feature_types", ["gene"] * len(attrs["feature_keys"]))

    def run(batches):
        s = Store(path)
        for b in batches:
            for first, last in zip(b["first"], b["last"], strict=True):
                at = indptr[first : last + 1]
                feats = np.repeat(np.arange(first, last), np.diff(at))
                yield pd.DataFrame({"row_id": s.read(f"{group}/indices", at[0], at[-1]).astype("int64") + 1, "col_id": feats + 1, "value": s.read(f"{group}/data", at[0], at[-1]).astype("float64")})

    t = _ranges(spark, len(names), step).mapInPandas(run, "row_id long, col_id long, value double")
    feats = distinct_names(spark.createDataFrame([(i + 1, n, k) for i, (n, k) in enumerate(zip(names, types, strict=True))], "col_id long, feat_id string, feat_type string"), "feat_id", "col_id")
    if drop_aggregate:
        feats = feats.where("feat_type != 'aggregate_gene'")
    n = store.meta(f"{group}/cell_id")["shape"][0]

    def cells(batches):
        s = Store(path)
        for b in batches:
            for first, last in zip(b["first"], b["last"], strict=True):
                got = s.read(f"{group}/cell_id", first, last)
                yield pd.DataFrame({"row_id": np.arange(first, last) + 1, "prefix": got[:, 0].astype("int64"), "suffix": got[:, 1].astype("int64")})

    ids = _ranges(spark, n, 100_000).mapInPandas(cells, "row_id long, prefix long, suffix long").select("row_id", cell_code(F.col("prefix"), F.col("suffix")).alias("cell_id"))
    return Matrix.of(t.join(feats.select("col_id"), "col_id", "left_semi"), ids, feats)


#: Columns of a transcript table, as the instrument ships them.
TRANSCRIPTS = "transcript_id long, cell_id string, overlaps_nucleus tinyint, feature_name string, x_location float, y_location float, z_location float, qv float, fov_name string, nucleus_distance float, codeword_index int"


def transcripts(spark: SparkSession, path: str, qv: float | None = None, step: int = 500_000) -> DataFrame:
    """Transcripts of flat arrays or of the tiles of the finest grid, in the instrument's columns; not valid ones drop, and those of a quality of ``qv`` or less.

    Cells are not known there: cell_id is UNASSIGNED. Fields of view without a name are FOV and their number.
    """
    store = Store(path)
    attrs = store.attrs("")
    names, fovs = attrs.get("gene_names", []), attrs.get("fov_names", [])
    tiles = [""] if store.has("location") else [f"grids/0/{t}/" for t in store.children("grids/0")]
    units = [(t, i, min(i + step, n)) for t in tiles if store.has(f"{t}location") for n in [store.meta(f"{t}location")["shape"][0]] for i in range(0, n, step)]

    def run(batches):
        s = Store(path)
        for b in batches:
            for tile, first, last in zip(b["tile"], b["first"], b["last"], strict=True):
                one = lambda name, tile=tile, first=first, last=last: s.read(f"{tile}{name}", first, last)
                xyz, gene, uid = one("location").astype("float32"), one("gene_identity").astype(int).ravel(), one("id").astype("int64")
                score = one("quality_score").astype("float32").ravel()
                keep = one("valid").ravel() == 1 if s.has(f"{tile}valid") else np.ones(len(xyz), bool)
                keep &= score > qv if qv is not None else True
                code = one("codeword_identity").astype("int32").ravel() if s.has(f"{tile}codeword_identity") else np.zeros(len(xyz), "int32")
                fov = uid[:, 1]
                known = len(fovs) > int(fov.max(initial=-1))
                out = pd.DataFrame({
                    "transcript_id": (65536 + fov) * 4294967296 + uid[:, 0],
                    "cell_id": "UNASSIGNED",
                    "overlaps_nucleus": np.zeros(len(xyz), "int8"),
                    "feature_name": [names[g] if 0 <= g < len(names) else None for g in gene] if names else [f"gene_{g}" for g in gene],
                    "x_location": xyz[:, 0], "y_location": xyz[:, 1], "z_location": xyz[:, 2], "qv": score,
                    "fov_name": [fovs[i] if known and fovs else f"FOV{i:03d}" for i in fov.tolist()],
                    "nucleus_distance": np.full(len(xyz), np.nan, "float32"), "codeword_index": code,
                })
                yield out[keep]

    rows = spark.createDataFrame(units, "tile string, first long, last long")
    return rows.repartition(max(1, len(units))).mapInPandas(run, TRANSCRIPTS)


def fingerprint(path: str) -> str:
    """A hash of what a store is: path, size and newest change of its files, and the version of this converter."""
    fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    info = fs.get_file_info(root)
    files = fs.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else [info]
    files = [f for f in files if f.type == pafs.FileType.File]
    state = [path, sum(f.size or 0 for f in files), max((f.mtime_ns or 0 for f in files), default=0), CONVERTER]
    return hashlib.sha256(json.dumps(state).encode()).hexdigest()[:16]


def cached_parquet(spark: SparkSession, path: str, cache: str, qv: float | None = None) -> str:
    """The store as Parquet below ``cache``: converted once for each state of its files, and again only when they change. Returns the folder."""
    out = f"{cache.rstrip('/')}/{layout(path)}-{fingerprint(path)}{'' if qv is None else f'-{qv:g}'}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_done")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        to_parquet(spark, path, out, qv, overwrite=True)
        fs.create(at, True).close()
    return out


def layout(path: str) -> str:
    """transcripts, expression or unknown, by the arrays that are there."""
    s = Store(path)
    return "transcripts" if s.has("gene_identity") or s.children("grids/0") else "expression" if s.has("cell_features/indptr") else "unknown"


def to_parquet(spark: SparkSession, path: str, out: str, qv: float | None = None, overwrite: bool = False, compression: str = "zstd") -> str:
    """Converts a zarr store to Parquet by its layout; returns the layout."""
    kind, mode = layout(path), "overwrite" if overwrite else "errorifexists"
    if kind == "transcripts":
        transcripts(spark, path, qv).write.mode(mode).option("compression", compression).parquet(out)
    elif kind == "expression":
        from cellquarry.sources.writers import write_matrix

        write_matrix(expression(spark, path), out, mode=mode, compression=compression)
    else:
        raise ValueError(f"no known layout in {path}")
    return kind
