"""Pipelines of stages over a movie: what is active, what was done, which regions were accepted, and saving it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = "pos int, stage string, label string, params string, metrics string"
REGION = "roi int, source_method string, status string, params string"
OUTPUT = ("regions", "pixels", "transients", "artifacts")


@dataclass
class Step:
    stage: str
    label: str
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)


@dataclass
class Session:
    """The active movie with the steps that made it. Movies are lazy; ``commit`` names what came out of a stage."""

    spark: SparkSession
    original: DataFrame | None = None
    active: DataFrame | None = None
    mask: DataFrame | None = None
    regions: DataFrame | None = None
    pixels: DataFrame | None = None
    transients: DataFrame | None = None
    artifacts: DataFrame | None = None
    steps: list[Step] = field(default_factory=list)
    modality: set[str] = field(default_factory=set)
    data_path: str = ""

    def load(self, movie: DataFrame, path: str = "") -> Session:
        self.original = self.active = movie
        self.mask = self.regions = self.pixels = self.transients = self.artifacts = None
        self.steps, self.data_path = [Step("load", "Load", {"path": path})], path
        return self

    def commit(self, movie: DataFrame, label: str, stage: str, params: dict | None = None, metrics: dict | None = None) -> Session:
        self.active = movie
        self.steps.append(Step(stage, label, params or {}, metrics or {}))
        return self

    def commit_regions(self, regions: DataFrame, pixels: DataFrame, label: str, params: dict | None = None) -> Session:
        """Accepted regions (roi, source_method, status, params) join those there are; their numbers go on from the largest."""
        accepted = regions.filter("status = 'accepted'")
        counts = regions.agg(F.count(F.lit(1)), F.sum(F.when(F.col("status") == "accepted", 1).otherwise(0))).first()
        base = 0 if self.regions is None else (self.regions.agg(F.max("roi")).first()[0] or 0) + 1
        moved = accepted.withColumn("roi", F.col("roi") + base)
        own = pixels.join(accepted.select("roi"), "roi", "left_semi").withColumn("roi", F.col("roi") + base)
        self.regions = moved if self.regions is None else self.regions.unionByName(moved)
        self.pixels = own if self.pixels is None else self.pixels.unionByName(own)
        self.steps.append(Step("source_extraction", label, params or {}, {"rois_committed": counts[1] or 0, "rois_deleted": counts[0] - (counts[1] or 0)}))
        return self

    def commit_validation(self, transients: DataFrame, artifacts: DataFrame) -> Session:
        """Transients (roi, trans, t0, t1, class) and flags (roi, artifact) of the accepted regions; those of other numbers are left out,
        regions without a flag are no artifacts."""
        own = self.regions.select("roi").distinct()
        self.transients = transients.join(own, "roi", "left_semi")
        self.artifacts = own.join(artifacts.select("roi", "artifact"), "roi", "left").select("roi", F.coalesce("artifact", F.lit(False)).alias("artifact"))
        return self

    def clear_regions(self) -> Session:
        self.regions = self.pixels = self.transients = self.artifacts = None
        self.steps = [s for s in self.steps if s.stage != "source_extraction"]
        return self

    @property
    def labels(self) -> list[str]:
        return [s.label for s in self.steps]

    def step_table(self) -> DataFrame:
        return self.spark.createDataFrame([(k, s.stage, s.label, json.dumps(s.params, sort_keys=True), json.dumps(s.metrics, sort_keys=True)) for k, s in enumerate(self.steps)], STEP)

    def save(self, path: str) -> None:
        """The recipe (steps, path) and the output (regions, pixels, transients, artifact flags) as Parquet. Metrics belong to a step's position, so equal labels don't overwrite each other."""
        path, output = sibling_paths(path)
        self.step_table().withColumn("data_path", F.lit(self.data_path)).coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")
        for name in OUTPUT:
            df = getattr(self, name)
            if df is not None:
                df.write.mode("overwrite").parquet(f"{output}/{name}")

    @staticmethod
    def restore(spark: SparkSession, path: str, read=None) -> Session:
        """Steps, and regions with their validation if there is an output beside the recipe; the movie is read by ``read(path)``. Parameters of every stage come back."""
        path, output = sibling_paths(path)
        rows = spark.read.parquet(f"{path}/steps").orderBy("pos").collect()
        s = Session(spark, data_path=rows[0]["data_path"] if rows else "")
        if read and s.data_path:
            s.original = s.active = read(s.data_path)
        s.steps = [Step(r["stage"], r["label"], json.loads(r["params"]), json.loads(r["metrics"])) for r in rows]
        for name in OUTPUT:
            if _exists(spark, f"{output}/{name}"):
                setattr(s, name, spark.read.parquet(f"{output}/{name}"))
        return s

    def report(self) -> str:
        """Markdown, one section a step."""
        out = []
        for k, s in enumerate(self.steps):
            out += [f"## {k + 1}. {s.label}", ""]
            out += [f"- {n}: {v}" for n, v in (*s.params.items(), *s.metrics.items())] + [""]
        return "\n".join(out)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def sibling_paths(path: str) -> tuple[str, str]:
    """(recipe, output) folders of a session, given either or their common beginning."""
    base = path.rstrip("/")
    for end in ("_pipeline", "_output"):
        base = base.removesuffix(end)
    return f"{base}_pipeline", f"{base}_output"


def match_regions(regions: DataFrame, saved: DataFrame) -> DataFrame:
    """Regions with what was saved of them, by number; regions that weren't saved stay as they are."""
    return regions.join(saved, "roi", "left")


# Which extraction methods suit which recordings.
ADVICE = {
    ("cnmf", "one_photon"): "one-photon background is not flat: use the ring model",
    ("cnmf_e", "two_photon"): "the ring model is meant for one-photon background",
    ("pca_ica", "dense"): "independent components mix overlapping cells",
    ("online", "volumetric"): "online detection works on planes",
}


def advice(method: str, modality: set[str]) -> list[str]:
    return [text for (m, k), text in ADVICE.items() if m == method and k in modality]


def save_classification(times: DataFrame, classes: DataFrame, path: str) -> None:
    times.write.mode("overwrite").parquet(f"{path}/time_course")
    classes.write.mode("overwrite").parquet(f"{path}/transient")


def load_classification(spark: SparkSession, path: str, times: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Time courses that are there already stay."""
    return times if times is not None else spark.read.parquet(f"{path}/time_course"), spark.read.parquet(f"{path}/transient")
