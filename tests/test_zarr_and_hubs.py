import json
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cellquarry.sources import hubs, zarr


def blosc(data: bytes, width: int, codec: str, block: int) -> bytes:
    """A shuffled frame, by the published layout."""
    code, pieces = {"lz4_raw": 1, "zlib": 3, "zstd": 4}[codec], []
    for i in range(0, len(data), block):
        own = np.frombuffer(data[i : i + block], np.uint8)
        own = own.reshape(-1, width).T.tobytes()
        parts = width if len(own) == block and block // width >= 128 else 1
        out = b""
        for j in range(parts):
            piece = own[j * len(own) // parts : (j + 1) * len(own) // parts]
            got = zlib.compress(piece) if codec == "zlib" else pa.Codec(codec).compress(piece, asbytes=True)
            got = piece if len(got) >= len(piece) else got
            out += struct.pack("<i", len(got)) + got
        pieces.append(out)
    at, starts = 16 + 4 * len(pieces), b""
    for p in pieces:
        starts += struct.pack("<i", at)
        at += len(p)
    return struct.pack("<BBBBIII", 2, 1, code << 5 | 1, width, len(data), block, at) + starts + b"".join(pieces)


@pytest.mark.parametrize("codec", ["lz4_raw", "zlib", "zstd"])
def test_blosc(codec):
    for data in (np.arange(5000, dtype="<i4").tobytes(), np.zeros(37, "<f8").tobytes(), np.random.default_rng(0).bytes(4096)):
        for block in (1024, 8192):
            assert zarr.unblosc(blosc(data, 4 if len(data) % 8 else 8, codec, block)) == data


def put(z, name, a, chunks, compressor=None):
    z.writestr(f"{name}/.zarray", json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": compressor, "fill_value": 0, "order": "C", "filters": None}))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunks, strict=True))):
        block = np.zeros(chunks, a.dtype)
        part = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        block[tuple(slice(0, s) for s in part.shape)] = part
        raw = block.tobytes()
        z.writestr(f"{name}/{'.'.join(map(str, at))}", zlib.compress(raw) if compressor else raw)


def test_layouts(spark, tmp_path):
    (tmp_path / "x").mkdir()
    x = np.array([[0, 2, 0, 1], [5, 0, 0, 0], [1, 1, 1, 1]])
    feats, cells = np.nonzero(x)
    with zipfile.ZipFile(tmp_path / "x/cell_feature_matrix.zarr.zip", "w") as z:
        z.writestr("cell_features/.zattrs", json.dumps({"feature_keys": ["A", "B", "T"], "feature_types": ["gene", "control", "aggregate_gene"]}))
        put(z, "cell_features/indptr", np.array([0, 2, 3, 7], "<u4"), [4])
        put(z, "cell_features/indices", cells.astype("<u4"), [3], {"id": "zlib"})
        put(z, "cell_features/data", x[feats, cells].astype("<u4"), [3])
        put(z, "cell_features/cell_id", np.array([[i, 1] for i in range(4)], "<u4"), [3, 2])
    got = hubs.XeniumHub(spark, str(tmp_path / "x")).expression()
    assert sorted(got) == ["control", "gene"]
    assert sorted(map(tuple, got["gene"].named().collect())) == [("aaaaaaab-1", "A", 2.0), ("aaaaaaad-1", "A", 1.0)]
    with zipfile.ZipFile(tmp_path / "x/transcripts.zarr.zip", "w") as z:
        z.writestr(".zattrs", json.dumps({"gene_names": ["A", "B"]}))
        put(z, "location", np.array([[1, 2, 3], [4, 5, 6], [7, 8, 9]], "<f4"), [2, 3])
        put(z, "gene_identity", np.array([[0], [1], [1]], "<u2"), [2, 1])
        put(z, "quality_score", np.array([40, 10, 30], "<f4"), [2])
        put(z, "id", np.array([[7, 0], [8, 0], [9, 2]], "<u4"), [2, 2])
    t = hubs.XeniumHub(spark, str(tmp_path / "x")).transcripts().orderBy("transcript_id").collect()
    assert [(r.transcript_id, r.feat_ID, r.x_index, r.y_index) for r in t] == [(65536 << 32 | 7, "A", 1.0, -2.0), (65538 << 32 | 9, "B", 7.0, -8.0)]
    assert zarr.to_parquet(spark, str(tmp_path / "x/transcripts.zarr.zip"), str(tmp_path / "out"), 20) == "transcripts" and spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert zarr.to_parquet(spark, str(tmp_path / "x/cell_feature_matrix.zarr.zip"), str(tmp_path / "m")) == "expression"
    with pytest.raises(FileNotFoundError):
        hubs.XeniumHub(spark, str(tmp_path)).transcripts()


def test_other_hubs(spark, tmp_path):
    (tmp_path / "tx_file.csv").write_text("fov,target,x_global_px,y_global_px\n1,NegPrb,1,2\n2,ACTB,3,4\n")
    (tmp_path / "polygons.csv").write_text("fov,cellID,x_global_px,y_global_px\n1,5,0,0\n1,5,2,0\n1,5,2,2\n2,1,0,0\n2,1,1,0\n2,1,0,1\n")
    h = hubs.CosMxHub(spark, str(tmp_path))
    assert [(r.feat_ID, r.feat_type) for r in h.transcripts({"neg": "^Neg"}).orderBy("x_index").collect()] == [("NegPrb", "neg"), ("ACTB", "rna")]
    assert [r.poly_ID for r in h.polygons(3, [1]).collect()] == ["c_3_1_5"]
    spark.createDataFrame([("s1", "b1", "c1", True), ("s2", "b1", "c1", False), ("s3", "b2", None, False)], "square_002um string, square_008um string, cell_id string, in_nucleus boolean").write.parquet(str(tmp_path / "barcode_mappings.parquet"))
    v = hubs.VisiumHDHub(spark, str(tmp_path))
    assert [tuple(r) for r in v.mapping().collect()] == [("b1", "c1")]
    got = v.parents().collect()
    assert [(r.cell_id, r.in_nucleus, r.square_008um) for r in got] == [("c1", True, "b1")] and "square_002um" not in got[0].asDict()


def test_transcripts_in_tiles_are_cached(spark, tmp_path):
    path = str(tmp_path / "t.zarr.zip")

    def write(score):
        with zipfile.ZipFile(path, "w") as z:
            z.writestr(".zattrs", json.dumps({"gene_names": ["A", "B"], "fov_names": ["F7"]}))
            for k, tile in enumerate(("0,0", "1,0")):
                at = f"grids/0/{tile}"
                put(z, f"{at}/location", np.array([[k, 2, 3], [k, 5, 6]], "<f4"), [2, 3])
                put(z, f"{at}/gene_identity", np.array([[0], [k]], "<u2"), [2, 1])
                put(z, f"{at}/codeword_identity", np.array([[4], [5]], "<u2"), [2, 1])
                put(z, f"{at}/quality_score", np.array([score, 30], "<f4"), [2])
                put(z, f"{at}/valid", np.array([1, k], "<u1"), [2])
                put(z, f"{at}/id", np.array([[7, 0], [8, 0]], "<u4"), [2, 2])

    write(20)
    got = zarr.transcripts(spark, path).orderBy("x_location", "qv").collect()
    assert [(r.transcript_id & 15, r.feature_name, r.qv, r.fov_name, r.codeword_index, r.cell_id) for r in got] == [(7, "A", 20, "F7", 4, "UNASSIGNED"), (7, "A", 20, "F7", 4, "UNASSIGNED"), (8, "B", 30, "F7", 5, "UNASSIGNED")]
    assert zarr.layout(path) == "transcripts" and zarr.transcripts(spark, path, 20).count() == 1
    first = zarr.cached_parquet(spark, path, str(tmp_path / "c"), 20)
    stamp = (tmp_path / "c" / first.split("/")[-1] / "_done").stat().st_mtime_ns
    assert zarr.cached_parquet(spark, path, str(tmp_path / "c"), 20) == first and (tmp_path / "c" / first.split("/")[-1] / "_done").stat().st_mtime_ns == stamp
    assert spark.read.parquet(first).count() == 1 and len(spark.read.parquet(first).columns) == 11
    write(25)
    assert zarr.cached_parquet(spark, path, str(tmp_path / "c"), 20) != first
