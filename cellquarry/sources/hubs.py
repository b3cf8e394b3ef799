"""Instrument folders: where the files of each vendor lie, and the handles they give."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellquarry.operators.matrix import Matrix
from cellquarry.operators.spatial import parent_bins, points, polygons
from cellquarry.plans.indexing import with_row_index
from cellquarry.sources import readers, zarr


@dataclass(frozen=True)
class Hub:
    """A vendor's output folder; ``files`` may name other places for its parts."""

    spark: SparkSession
    root: str
    files: Mapping[str, str] = field(default_factory=dict)

    def at(self, part: str, *names: str) -> str:
        if part in self.files:
            return self.files[part]
        for n in names:
            if os.path.exists(f"{self.root}/{n}"):
                return f"{self.root}/{n}"
        raise FileNotFoundError(f"{part}: none of {', '.join(names)} in {self.root}")


class XeniumHub(Hub):
    """Transcripts, boundaries and expression, as Parquet, CSV, HDF5, MatrixMarket or zarr."""

    def transcripts(self, qv: float = 20.0, flip: bool = True) -> DataFrame:
        path = self.at("transcripts", "transcripts.parquet", "transcripts.csv.gz", "transcripts.zarr.zip")
        if ".zarr" in path:
            t = zarr.transcripts(self.spark, path, qv).withColumnRenamed("feature_name", "feat_ID")
            return points(t.withColumn("y_location", -F.col("y_location") if flip else F.col("y_location")), "x_location", "y_location")
        return readers.xenium_transcripts(self.spark, path, qv, flip)

    def polygons(self, what: str = "cell", split: bool = False, flip: bool = True) -> DataFrame:
        return readers.boundaries(self.spark, self.at(f"{what}_boundaries", f"{what}_boundaries.parquet", f"{what}_boundaries.csv.gz"), split, flip)

    def expression(self, remove_empty: bool = True) -> dict[str, Matrix]:
        """Matrices by feature type (one without types)."""
        path = self.at("expression", "cell_feature_matrix.zarr.zip", "cell_feature_matrix.h5", "cell_feature_matrix")
        if ".zarr" in path:
            m = zarr.expression(self.spark, path)
        elif path.endswith(".h5"):
            m = readers.tenx_h5(self.spark, path)
        else:
            named = lambda stem: next(str(p) for p in sorted(Path(path).glob(f"{stem}*")))
            m = readers.matrix_market(self.spark, named("matrix.mtx"), named("barcodes.tsv"), named("features.tsv"))
        m = readers.drop_empty_features(m) if remove_empty else m
        if "feat_type" not in m.feats.columns:
            return {"gene": m}
        kinds = [r[0] for r in m.feats.select("feat_type").distinct().collect()]
        return {k: m.subset(feats=m.feats.where(F.col("feat_type") == k).select("feat_id")) for k in sorted(kinds)}


class AteraHub(XeniumHub):
    """The same parts under the same names."""


class CosMxHub(Hub):
    def expression(self, slide: int = 1, fovs: Sequence[int] | None = None) -> Matrix:
        return readers.cosmx_expression(self.spark, self.at("expression", "exprMat_file.csv", "exprMat_file.csv.gz"), slide, fovs)

    def transcripts(self, keywords: Mapping[str, str] | None = None, rest: str = "rna", fovs: Sequence[int] | None = None) -> DataFrame:
        t = self.spark.read.csv(self.at("transcripts", "tx_file.csv", "tx_file.csv.gz"), header=True, inferSchema=True)
        t = t.where(F.col("fov").isin(list(fovs))) if fovs is not None else t
        t = readers.split_features(t.withColumnRenamed("target", "feat_ID"), keywords or {}, rest, "feat_ID")
        return points(t, "x_global_px", "y_global_px")

    def polygons(self, slide: int = 1, fovs: Sequence[int] | None = None) -> DataFrame:
        p = self.spark.read.csv(self.at("polygons", "polygons.csv", "polygons.csv.gz"), header=True, inferSchema=True)
        p = p.where(F.col("fov").isin(list(fovs))) if fovs is not None else p
        p = p.withColumn("poly_ID", F.format_string(f"c_{slide}_%d_%d", F.col("fov").cast("int"), F.col("cellID").cast("int")))
        return polygons(with_row_index(p, name="ord"), "poly_ID", "x_global_px", "y_global_px", "ord")


class VisiumHDHub(Hub):
    def expression(self, bin_um: int = 8, kind: str = "filtered") -> Matrix:
        return readers.tenx_h5(self.spark, self.at("expression", f"binned_outputs/square_{bin_um:03d}um/{kind}_feature_bc_matrix.h5"))

    def positions(self, bin_um: int = 8, in_tissue: bool = True) -> DataFrame:
        p = self.spark.read.parquet(self.at("positions", f"binned_outputs/square_{bin_um:03d}um/spatial/tissue_positions.parquet"))
        p = p.where("in_tissue = 1") if in_tissue else p
        return points(p.withColumnRenamed("barcode", "feat_ID"), "pxl_col_in_fullres", "pxl_row_in_fullres")

    def mapping(self, bin_um: int = 8) -> DataFrame:
        return readers.bin_mapping(self.spark, self.at("mapping", "barcode_mappings.parquet"), f"square_{bin_um:03d}um")

    def parents(self, unit: str = "cell_id") -> DataFrame:
        return readers.parent_units(self.spark.read.parquet(self.at("mapping", "barcode_mappings.parquet")), unit)


class StereoSeqHub(Hub):
    def bins(self, size: int = 100, gene_column: str = "geneName") -> Matrix:
        return readers.bin_records(readers.gef_records(self.spark, self.at("gef", "tissue.gef", "raw.gef"), size, gene_column))

    def cells(self, gene_column: str = "geneName") -> Matrix:
        return readers.cellbin_gef(self.spark, self.at("cellbin", "cellbin.gef", "tissue.cellbin.gef"), gene_column)

    def parents(self, records: DataFrame, size: int) -> DataFrame:
        return parent_bins(records, size)
