"""The assay: an immutable bundle of lazy tables with named trials and a log of what made them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.normalize import snap
from .operators.spatial import nn_scale
from .operators.tiling import adjust_counts, generate_tiles, shared_barcodes, split_barcodes


def trial_name(existing: list[str], tag: str) -> str:
    """tag, or tag.1, tag.2, ... if taken."""
    if tag not in existing:
        return tag
    n = 1
    while f"{tag}.{n}" in existing:
        n += 1
    return f"{tag}.{n}"


@dataclass(frozen=True)
class SpatialAssay:
    """cells: barcode, x, y, x_orig, y_orig, z. counts: layers (feature, barcode, value). embeddings:
    trials (barcode, vec). territories: trials (barcode, label). Every method returns a new assay."""

    name: str
    cells: DataFrame
    counts: dict[str, DataFrame] = field(default_factory=dict)
    tiles: DataFrame | None = None
    embeddings: dict[str, DataFrame] = field(default_factory=dict)
    active: DataFrame | None = None
    territories: dict[str, DataFrame] = field(default_factory=dict)
    deg: dict[str, DataFrame] = field(default_factory=dict)
    cost: DataFrame | None = None
    mapping: DataFrame | None = None
    image: DataFrame | None = None
    meta: dict = field(default_factory=dict)
    log: tuple = ()
    active_counts: str = "empty"
    active_embedding: str | None = None

    @staticmethod
    def build(coordinates: DataFrame, counts: DataFrame | None = None, image: DataFrame | None = None, name: str = "spatial_omics", scale: float | str = "auto", unit: str = "um", sparse: bool = False) -> SpatialAssay:
        """Of the barcodes that coordinates and counts share. sparse: cells without a row of counts have only zeros, and stay."""
        if not isinstance(coordinates, DataFrame):
            raise TypeError("coordinates must be a DataFrame")
        cells = coordinates
        if counts is not None:
            cells, counts = shared_barcodes(coordinates, counts)
            cells = coordinates if sparse else cells
        s = nn_scale(cells).first()["scale"] if scale == "auto" else float(scale)
        return SpatialAssay(name, snap(cells), {"raw": counts} if counts is not None else {}, image=image, meta={"scale": s, "unit": unit}, active_counts="raw" if counts is not None else "empty")._logged("build", scale=scale, unit=unit)

    def _logged(self, fun: str, **args) -> SpatialAssay:
        names = [n for n, _ in self.log]
        return replace(self, log=(*self.log, (trial_name(names, f"{self.name}_{fun}"), {k: str(v) for k, v in args.items()})))

    def add_counts(self, counts: DataFrame, raw: DataFrame | None = None, add_name: str | None = None, force: bool = False) -> SpatialAssay:
        if raw is None and "raw" not in self.counts and not force:
            raise ValueError("custom counts need raw counts, or force=True to use them as raw too")
        tag = trial_name(list(self.counts), add_name or "custom_counts")
        new = self.counts | {tag: counts}
        if raw is not None:
            new[f"raw_{tag}"] = raw
        elif "raw" not in new:
            new[f"raw_{tag}"] = counts
        return replace(self, counts=new, active_counts=tag)._logged("add_counts", add_name=tag, force=force)

    def add_embeddings(self, embeddings: DataFrame, add_name: str | None = None) -> SpatialAssay:
        kept = embeddings.join(self.cells.select("barcode"), "barcode", "left_semi")
        tag = trial_name(list(self.embeddings), add_name or "custom_embedding")
        return replace(self, embeddings=self.embeddings | {tag: kept}, active=kept, active_embedding=tag)._logged("add_embeddings", add_name=tag)

    def add_cells(self, labels: DataFrame, add_name: str | None = None) -> SpatialAssay:
        """labels: barcode, label; cells without one are `Undefined`."""
        if not {"barcode", "label"} <= set(labels.columns):
            raise ValueError("cell labels need barcode and label")
        if labels.join(self.cells, "barcode", "left_semi").isEmpty():
            raise ValueError("no cell label is of a barcode of the assay")
        full = self.cells.select("barcode").join(labels.dropDuplicates(["barcode"]), "barcode", "left").select("barcode", F.coalesce("label", F.lit("Undefined")).alias("label"))
        return self.add_trial(add_name or "Cells", full)._logged("add_cells")

    def add_trial(self, tag: str, labels: DataFrame) -> SpatialAssay:
        name = trial_name(list(self.territories), tag)
        return replace(self, territories=self.territories | {name: labels})

    def with_tiles(self, tensor_resolution: float = 1, filter_grid: float = 0.01, filter_threshold: float = 0.995) -> SpatialAssay:
        """Tiles of the cells. Counts become means over merged cells; cells, labels and embeddings are those of
        the tiles' barcodes: a merged one has no label (null) and no embedding, and its first member's
        original coordinates."""
        if self.tiles is not None:
            import warnings

            warnings.warn("the assay has tiles; they are kept", stacklevel=2)
            return self
        t = generate_tiles(self.cells.select("barcode", "x", "y"), tensor_resolution, filter_grid, filter_threshold)
        members = t.select("barcode").distinct()
        # what the assay holds goes by the tiles' barcodes from here on
        origins = t.where("origin = 1").groupBy("barcode").agg(F.min(F.struct("x", "y")).alias("at"))
        first = split_barcodes(members).join(self.cells.select(F.col("barcode").alias("member"), "x_orig", "y_orig", "z"), "member").groupBy(F.col("cell").alias("barcode")).agg(F.min_by(F.struct("x_orig", "y_orig", "z"), "member").alias("of"))
        cells = origins.join(first, "barcode").select("barcode", F.col("at.x").cast("double").alias("x"), F.col("at.y").cast("double").alias("y"), "of.x_orig", "of.y_orig", "of.z")
        labels = {n: members.join(d, "barcode", "left").select(*d.columns) for n, d in self.territories.items()}
        kept = lambda d: None if d is None else d.join(members, "barcode", "left_semi")
        return replace(self, tiles=t, cells=cells, counts={k: adjust_counts(c, members) for k, c in self.counts.items()}, territories=labels, embeddings={n: kept(d) for n, d in self.embeddings.items()}, active=kept(self.active))._logged("generate_tiles", tensor_resolution=tensor_resolution, filter_grid=filter_grid, filter_threshold=filter_threshold)

    def trial(self, name: str = "last", family: str | None = None) -> DataFrame:
        names = [n for n in self.territories if family is None or n.split(".")[0] == family]
        if not names:
            raise ValueError(f"no {family or 'territory'} trial: segment or isolate first")
        if name != "last" and name not in names:
            raise ValueError(f"no trial {name!r}: {', '.join(names)}")
        return self.territories[names[-1] if name == "last" else name]

    def get_counts(self, kind: str = "raw") -> DataFrame:
        hits = [n for n in self.counts if re.search(kind, n)]
        if not hits:
            raise ValueError(f"no counts {kind!r}: {', '.join(self.counts)}")
        return self.counts[kind if kind in self.counts else hits[0]]

    def counts_for(self, method: str | None = None, norm_method: str = "last") -> DataFrame:
        """The layer that a test works on: the active one (last) or that of a name; models of counts (DESeq2, QLF, LRT) take
        raw counts whatever is asked for. No such layer: ValueError."""
        if not self.counts:
            raise ValueError("the assay has no counts")
        name = self.active_counts if norm_method == "last" else norm_method
        if name not in self.counts:
            raise ValueError(f"no counts {name!r}: {', '.join(self.counts)}")
        if {"DEseq2": "DESeq2"}.get(method, method) in ("DESeq2", "QLF", "LRT"):
            if "raw" not in self.counts:
                raise ValueError(f"{method} needs raw counts")
            name = "raw"
        return self.counts[name]

    def identify_markers(self, seed=None, query=None, method: str = "wilcox", norm_method: str = "last", trial: str = "last", **options) -> SpatialAssay:
        """With markers of the trial's territories as a trial of deg (operators.markers)."""
        from .operators.markers import identify_markers

        cells = self.trial(trial).where("label is not null").select("barcode", F.col("label").alias("territory"))
        return self.with_markers(identify_markers(self.counts_for(method, norm_method), cells, seed, query, method, **options))

    def generate_embeddings(self, dim_reduction: str = "PCA", normalization: str = "log_norm", use_counts: str = "raw", **options) -> SpatialAssay:
        """With an embedding trial of the layer use_counts. Layers other than raw are taken as they are: their normalisation is
        none, whatever is asked for."""
        from .operators.embed import generate_embeddings

        if use_counts not in self.counts:
            raise ValueError(f"no counts {use_counts!r}: {', '.join(self.counts)}")
        norm = normalization if use_counts == "raw" else "none"
        return self.add_embeddings(generate_embeddings(self.counts[use_counts], self.cells, dim_reduction, norm, **options), dim_reduction)

    def get_coordinates(self, original: bool = False) -> DataFrame:
        return self.cells.select("barcode", F.col("x_orig").alias("x"), F.col("y_orig").alias("y")) if original else self.cells.select("barcode", "x", "y")

    def get_territories(self) -> DataFrame:
        """barcode, x, y and a column for each trial."""
        out = self.cells.select("barcode", "x", "y")
        for n, t in self.territories.items():
            out = out.join(t.select("barcode", F.col("label").alias(n)), "barcode", "left")
        return out

    def get_markers(self, trial: str = "last") -> DataFrame:
        if not self.deg or trial != "last" and trial not in self.deg:
            raise ValueError("no such marker trial")
        return self.deg[list(self.deg)[-1] if trial == "last" else trial]

    def get_cost(self, kinds: list[str] | None = None) -> DataFrame:
        if self.cost is None:
            raise ValueError("the assay was not mapped")
        return self.cost.where(F.col("kind").isin(kinds)) if kinds else self.cost

    def search_log(self, pattern: str) -> list[tuple[str, dict]]:
        return [(n, a) for n, a in self.log if any(re.search(pattern, x) for kv in a.items() for x in kv)]

    def summary(self) -> dict[str, int]:
        family = lambda f: sum(n.split(".")[0] == f for n in self.territories)
        return {"Segmentation": family("Segment"), "Territory": family("Territory"), "Morphing": family("Morphology"), "Layering": family("Layer")}

    def filtered(self, cells: list[str] | None = None, territories: list[str] | None = None, trial: str = "last", genes: list[str] | None = None) -> SpatialAssay:
        """A fresh assay of the barcodes in cells or in the territories, and of the genes. Cells that have no count (of these
        genes) stay."""
        if not (cells or territories or genes):
            raise ValueError("name cells, territories or genes")
        keep = self.cells.select("barcode")
        if cells or territories:
            some = keep.where(F.col("barcode").isin(cells)) if cells else keep.limit(0)
            if territories:
                some = some.union(self.trial(trial).where(F.col("label").isin([str(t) for t in territories])).select("barcode"))
            keep = some.distinct()
        raw = self.get_counts("raw")
        if genes:
            raw = raw.where(F.col("feature").isin(genes))
        return SpatialAssay.build(self.get_coordinates(True).join(keep, "barcode", "left_semi"), raw, name=self.name, scale=self.meta.get("scale", "auto"), sparse=True)

    def with_markers(self, found: DataFrame, tag: str = "DEG") -> SpatialAssay:
        return replace(self, deg=self.deg | {trial_name(list(self.deg), tag): found})._logged("identify_markers", tag=tag)

    def mapped_on(self, seed: SpatialAssay, matches: DataFrame, costs: DataFrame | None = None, trials: tuple[str, ...] = (), jitter: float = 0) -> SpatialAssay:
        """This assay at the places of the matched seeds (mapping.align), with the match's scores and the
        named label trials of the matched barcodes."""
        from .operators.mapping import align

        at = align(matches, seed.get_coordinates(original=True), jitter)
        own = at.select("barcode", F.col("from").cast("string").alias("source"))
        counts = {k: c.withColumnRenamed("barcode", "source").join(own, "source").select("feature", "barcode", "value") for k, c in self.counts.items()}
        labels = {t: own.join(self.territories[t].withColumnRenamed("barcode", "source"), "source").select("barcode", "label") for t in trials}
        return SpatialAssay(f"mapped_{self.name}", snap(at.select("barcode", "x", "y")), counts, territories=labels, cost=costs, mapping=at.select("barcode", "from", "to").join(matches, ["from", "to"]), meta=dict(self.meta), active_counts=self.active_counts)._logged("map_assays", jitter=jitter)

    def mapping_scores(self) -> DataFrame:
        """Coordinates, seed barcode and scores of a mapped assay."""
        if self.mapping is None:
            raise ValueError("the assay was not mapped")
        return self.cells.select("barcode", "x", "y").join(self.mapping, "barcode")

    def describe(self) -> dict:
        """What the assay holds, without running anything."""
        return {"assay": self.name, "tiles": self.tiles is not None, "counts": list(self.counts), "active_counts": self.active_counts, "embeddings": list(self.embeddings), "active_embedding": self.active_embedding, "territories": list(self.territories), "markers": list(self.deg), "mapped": self.mapping is not None}
